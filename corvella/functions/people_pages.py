"""Who supervised and examined a thesis, from its certification page or its acknowledgements."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby, pairwise

Member = tuple[str, str, str | None]

# The roles and the lines and words that the pages are read by.
ROLES = (
    (r"\bco-?supervisor\b", "Co-Supervisor"),
    (r"\bsupervisor\b", "Supervisor"),
    (r"\bsupervisory committee member\b", "Supervisory Committee Member"),
    (r"\buniversity examiner\b", "University Examiner"),
    (r"\bexternal examiner\b", "External Examiner"),
)
CERTIFY = "the following individuals certify"
PAGE_STOPS = "abstract|table of contents|acknowledgment|dedication|preface"
PAGE_NOISE = "the following individuals certify|examining committee|entitled"
WRAPPED_STARTS = "University Columbia UBC SFU".split()
#: What no name begins with: as the start of a word, as a whole word, as a word that others follow.
NO_NAME_PREFIXES = "University UBC SFU Columbia Research".split()
NO_NAME_WORDS = "Professor Examiner Academic Abstract".split()
NO_NAME_LEADS = "additional examining of & ii iii iv v vi".split()
#: What ends a name: a dash before a title, words that run into it from the next line.
TITLES_AFTER_DASH = "Professor Assistant Associate Instructor".split()
STRAY_ENDS = "Thank You".split()
STRAY_PAIRS = (("Sessional", "Lec"), ("Sessional", "Let"), ("Senior", "Inst"))
NAME_LIMIT = 120
NOT_NAMES = "He She They We I It His Her Their This That The A An My In For At To With You Also".split()
PARTICLES = "de du da di van von le la el al den der dos das ter ten".split()
SECTION_CHARS, PAGE_LINES, NEAR_CHARS, FAR_CHARS, NAME_WORDS, NAME_CHARS = 3000, 60, 400, 150, 4, 60

_ROLES = tuple((re.compile(p, re.I), role) for p, role in ROLES)


def role_of(line: str) -> str | None:
    return next((role for pattern, role in _ROLES if pattern.search(line)), None)


# The certification page


@dataclass
class Line:
    """A line of the page: its kind is a role, a wall that no name is sought beyond, the stop of the page, or a person's text."""

    kind: str
    text: str
    role: str | None = None
    taken: bool = False


_STOP, _NOISE = re.compile(PAGE_STOPS, re.I), re.compile(PAGE_NOISE, re.I)
_NEW = re.compile(r"(?:Dr|Prof)\.|[A-Z][a-z]+ [A-Z].*,")
_PERSON = re.compile(r"[A-Z][a-z]+\s+[A-Z][a-z]")


def _starts(text: str, starts: Iterable[str]) -> bool:
    """Whether the text begins so, in either case."""
    return text.lower().startswith(tuple(x.lower() for x in starts))


def _page_lines(text: str) -> list[Line]:
    """The page's lines, with the tail of a wrapped affiliation on the line that it belongs to, up to the page's stop."""
    out: list[Line] = []
    for raw in map(str.strip, text.split("\n")):
        if _STOP.match(raw):
            break
        if not raw.strip("_"):
            continue
        if role := role_of(raw):
            out.append(Line("role", raw, role))
            continue
        fragment = len(raw) <= 40 and "," not in raw and not _PERSON.match(raw)
        if out and out[-1].kind != "role" and not _NEW.match(raw) and (fragment or _starts(raw, WRAPPED_STARTS) or raw.split()[0].lower() == "of" != raw.lower()):
            out[-1].text += " " + raw
        else:
            out.append(Line("text", raw))
    for line in out[:PAGE_LINES]:
        if line.kind == "text" and _NOISE.search(line.text):
            line.kind = "wall"
    return out[:PAGE_LINES]


def _without_strays(text: str) -> str:
    """A name up to a title behind a dash, and without words that belong to the next line."""
    for at, mark in enumerate(text):
        if mark in "–—-" and _starts(text[at + 1 :].lstrip(), TITLES_AFTER_DASH):
            text = text[:at].rstrip()
            break
    words = text.split(" ")
    low = [w.lower() for w in words]
    pairs = {(a.lower(), b.lower()) for a, b in STRAY_PAIRS}
    end = next((i for i in range(1, len(low) - 1) if any(low[i] == a and low[i + 1].startswith(b) for a, b in pairs)), len(low))
    if end == len(low) > 1 and low[-1] in {x.lower() for x in STRAY_ENDS}:
        end -= 1
    return " ".join(words[:end]).strip().removesuffix("-").strip()


def _names_someone(text: str) -> bool:
    """Whether a name is neither a label nor an institution nor a page number, by its words."""
    words = text.split()
    if not words or not 1 < len(text) < NAME_LIMIT:
        return False
    low = [w.lower() for w in words]
    label = any(a.endswith("committee") and b.startswith("member") for a, b in pairwise(low))
    lead = len(words) > 1 and low[0] in NO_NAME_LEADS
    whole = re.split(r"\W", low[0])[0] in {x.lower() for x in NO_NAME_WORDS}
    return not (label or lead or whole or _starts(text, NO_NAME_PREFIXES) or "Examiner" in re.split(r"\W+", text))


def _as_person(text: str) -> str:
    """A name without what ran into it; empty where it is none."""
    name = _without_strays(" ".join(text.split()))
    return name if _names_someone(name) else ""


def committee_page(text: str | None) -> list[Member]:
    """(name, role, affiliation) from the certification page.

    Roles cut the page into blocks of people's lines. A role on a person's own line stands in
    parentheses. Any other role takes the end of the block above it, unless another role took
    it or it is empty, and else the start of the block below.
    """
    at = (text or "").lower().find(CERTIFY)
    if at < 0:
        return []
    lines = _page_lines(text[at : at + SECTION_CHARS])
    blocks: list[list[Line]] = []
    roles: list[tuple[Line, int]] = []
    for is_role, part in groupby(lines, lambda x: x.kind == "role"):
        for line in part if is_role else ():
            roles.append((line, len(blocks)))
            blocks.append([])
        if not is_role:
            blocks.append(list(part))
    # One list of blocks, where a role's own place is an empty block.
    found: dict[tuple[str, str], str | None] = {}
    for line, place in roles:
        own = re.fullmatch(r"(.+?)\s*\([^)]+\)", line.text)
        name, home = (own[1].strip(), None) if own else _of_block(blocks, place)
        if name := _as_person(name):
            found.setdefault((name, line.role), home)
    return [(name, role, home) for (name, role), home in found.items()]


def _of_block(blocks: list[list[Line]], place: int) -> tuple[str, str | None]:
    above = blocks[place - 1] if place else []
    open_ = []
    for line in reversed(above[-2:]):
        if line.kind == "wall":
            break
        open_.append(line)
    below = blocks[place + 1] if place + 1 < len(blocks) else []
    if open_ and not open_[0].taken:
        line, more = open_[0], open_[1:]
    elif below:
        line, more = below[0], []
    else:
        return "", None
    line.taken = True
    name, _, home = (x.strip() for x in line.text.partition(","))
    return name, home or next((x.text for x in more if not x.taken), None) or None


# Acknowledgements


@dataclass(frozen=True)
class Person:
    start: int
    end: int
    name: str
    titled: bool


_TITLE = re.compile(r"(?:Drs?|Profs?|Professors?)\.?")
_NO_NAME = frozenset(NOT_NAMES) | frozenset("Committee Chair Supervisor Supervisors Advisory Supervisory Thesis Research Co-Supervisor Co-supervisor Member Members".split())
_WORD = re.compile(r"[^\s()]+|[()]")
_JOIN = re.compile(r"\s*(?:,\s*and|,|and|&)\s+")


def people(text: str) -> list[Person]:
    """People named in prose: up to four words in capitals, or particles between them, after a title or at least two of them."""
    out: list[Person] = []
    run: list[tuple[str, int, int]] = []
    title: int | None = None

    def close() -> None:
        nonlocal title
        while run and run[-1][0] in PARTICLES:
            run.pop()
        if run and (title is not None or len(run) > 1):
            name = " ".join(w for w, _, _ in run)
            if 3 <= len(name) <= NAME_CHARS:
                out.append(Person(run[0][1] if title is None else title, run[-1][2], name, title is not None))
        run.clear()
        title = None

    for m in _WORD.finditer(text):
        word = m[0].rstrip(",;:!?")
        if _TITLE.fullmatch(word):
            close()
            title = m.start()
        elif word[:1].isupper() and word not in _NO_NAME:
            ends = len(word) > 2 and word.endswith(".")
            word = word[:-1] if ends else word
            run.append((word, m.start(), m.start() + len(word)))
            if ends or len(m[0]) > len(word) or len(run) == NAME_WORDS:
                close()
        elif run and word in PARTICLES and word == m[0] and len(run) < NAME_WORDS:
            run.append((word, m.start(), m.end()))
        else:
            close()
    close()
    return out


@dataclass(frozen=True)
class Cue:
    """Words that give people a role. side: where they stand. many: whether a whole list has it, or its nearest person."""

    words: re.Pattern
    role: str
    side: str
    many: bool = False


CO, ONE, MEMBER = "Co-Supervisor", "Supervisor", "Supervisory Committee Member"
_KIND = r"(?:(?:research|thesis|doctoral)\s+)?"


def _cue(words: str, role: str, side: str, many: bool = False) -> Cue:
    return Cue(re.compile(words, re.I), role, side, many)


CUES = (
    _cue(rf"\b(?:my\s+{_KIND}|research\s+)co-?supervisors?\b", CO, "after", True),
    _cue(rf"\bmy\s+{_KIND}supervisors\b", CO, "after", True),
    _cue(rf"\b(?:my\s+{_KIND}|research\s+)supervisor\b", ONE, "after"),
    _cue(r"\bcommittee\s+chair\b", ONE, "after"),
    _cue(r"\(\s*co-?supervisor\s*\)", CO, "before"),
    _cue(r"\(\s*supervisor\s*\)", ONE, "before"),
    _cue(rf"(?:\bas\s+)?(?:\b(?:my|the)\s+)?\b{_KIND}co-?supervisors\b", CO, "before", True),
    _cue(rf"(?:\bas\s+)?(?:\b(?:my|the)\s+)?\b{_KIND}co-?supervisor\b", CO, "before"),
    _cue(rf"(?:\bas\s+)?(?:\b(?:my|the)\s+)?\b{_KIND}supervisor\b", ONE, "before"),
    _cue(r"(?:\bas\s+)?(?:\b(?:my|the)\s+)?\b(?:committee\s+chair|chair\s+of\s+(?:my\s+)?(?:the\s+)?committee)\b", ONE, "before"),
    _cue(r"\bas\s+(?:my\s+)?co-?advisor\b", CO, "before"),
    _cue(r"\bco-?advisor\b", CO, "after"),
    _cue(r"\bas\s+(?:my\s+)?co-?supervisor", CO, "far"),
    _cue(r"\bas\s+(?:my\s+)?supervisor", ONE, "far"),
    _cue(r"\bwas\s+the\s+(?:second|third|fourth|final|other|remaining)\s+member\s+of\s+my\b", MEMBER, "before"),
    _cue(r"\bcommittee\s+members?\b|\bmy\s+committee\s*(?=[,:])", MEMBER, "near"),
    _cue(r"\b(?:advisory|supervisory|thesis)\s+committee\s*[-:–—]", MEMBER, "after", True),
    _cue(r"\bcommittee\s+(?:consisting|comprised|composed|made\s+up)\s+of\b", MEMBER, "after", True),
)


def _section(text: str | None) -> str:
    """What follows the first acknowledgement heading that is no entry of a table of contents, blanks as one."""
    plain = (text or "").replace("\f", "\n")
    for heading in re.finditer(r"^[ \t]*acknow[a-z]{4,14}[ \t]*$\n?", plain, re.I | re.M):
        words = plain[heading.end() : heading.end() + 300].split()
        if len(words) >= 20 and not any("...." in w for w in words) and not re.fullmatch(r"[ivxl]+|\d{1,3}", words[0]):
            return " ".join(plain[heading.end() : heading.end() + SECTION_CHARS].split())
    return ""


def acknowledged(text: str | None) -> list[Member]:
    """(name, role, null) from the acknowledgements, in the order of the cues. Members are those who have no other role."""
    section = _section(text)
    named = people(section)
    # Lists: people with nothing but commas and conjunctions between them.
    head = list(range(len(named)))
    for i in range(1, len(named)):
        if _JOIN.fullmatch(section[named[i - 1].end : named[i].start]):
            head[i] = head[i - 1]
    found: dict[tuple[str, str], None] = {}

    def meant(cue: Cue, a: int, b: int) -> list[int]:
        after = next((i for i, p in enumerate(named) if p.start >= b), None)
        before = next((i for i in range(len(named) - 1, -1, -1) if named[i].end <= a), None)
        beside = after is not None and re.fullmatch(r"[\s,:–—-]*", section[b : named[after].start])
        if cue.side == "after":
            return ([i for i in range(after, len(named)) if head[i] == head[after]] if cue.many else [after]) if beside else []
        if cue.side == "near":
            listed = [i for i in range(after, len(named)) if head[i] == head[after]] if beside else []
            return listed + [i for i, p in enumerate(named) if p.titled and a <= p.start < a + NEAR_CHARS]
        if before is None:
            return []
        if cue.side == "far":
            return [before] if named[before].titled and a - named[before].end <= FAR_CHARS and "." not in section[named[before].end : a] else []
        gap = section[named[before].end : a]
        if not re.fullmatch(r",\s+|\s+", gap) or ("," not in gap and section[a] != "(" and not cue.words.pattern.startswith(r"\bwas")):
            return []
        return [i for i in range(before + 1) if head[i] == head[before]] if cue.many else [before]

    for cue in CUES:
        for m in cue.words.finditer(section):
            for i in meant(cue, m.start(), m.end()):
                name = named[i].name
                if cue.role != MEMBER or not {(name, CO), (name, ONE)} & found.keys():
                    found.setdefault((name, cue.role))
    return [(name, role, None) for name, role in found]


def members(text: str | None) -> list[Member]:
    """The certification page's people, or else those acknowledged."""
    return committee_page(text) or acknowledged(text)
