"""Personal data by bootstrapped contextual extraction (operator 4).

Identifiers that their form gives away are the seeds. The words around them become
lexical patterns; Spark scores the graph of patterns and instances in rounds, patterns
by the instances they meet and instances by the patterns they meet, and patterns of high
confidence find identifiers that the forms miss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.llm.columns import carried, restored
from corvella.llm.store import Cuts, text_batches

KINDS = ("email", "ip", "card", "phone")

#: The characters before the at sign of an address, and what must follow it.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: Digit runs with single dots between them, four at least, from the first of them on.
CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: A word with an at sign or a digit, sought from its start only.
MARKED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
#: Digit groups that go on with the next word.
GROUPS = re.compile(r"[0-9().+-]+")
EDGE = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses around each at sign. What stands before it is looked at once, however long it is."""
    low, at = 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        own = len(before) - len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if own else None
        if domain:
            yield at - own, domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Each four runs of a chain, those with a part above 255 left out."""
    for chain in CHAIN.finditer(text):
        at, parts = chain.start(), chain[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            if all(map(_octet, parts[i : i + 4])):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of the seeds by kind, then start; a failing match is dropped and not tried again.

    The time grows with the text's length alone, also for long runs of letters or digits.
    """
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        found += [(1, a, b) for a, b in _ips(text)]
        found += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _marked(text: str) -> Iterator[tuple[int, int]]:
    """Words with an at sign or a digit; digit groups with single spaces between them are one."""
    open_: tuple[int, int] | None = None
    for m in MARKED.finditer(text):
        a, b = m.span()
        group = GROUPS.fullmatch(text, a, b)
        if open_ and group and open_[1] + 1 == a and text[a - 1] == " ":
            open_ = open_[0], b
            continue
        if open_:
            yield open_
        open_ = (a, b) if group else None
        if not group:
            yield a, b
    if open_:
        yield open_


def _candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that may be identifiers and touch no seed: an at sign, or six digits that are most of the letters and digits."""
    out = []
    seeds = sorted((a, b) for _, a, b in taken)
    at = 0
    for a, b in _marked(text):
        part = text[a:b]
        a, b = a + len(part) - len(part.lstrip(EDGE.replace("(", ""))), b - (len(part) - len(part.rstrip(EDGE)))
        if a >= b:
            continue
        part = text[a:b]
        n = len(_digits(part))
        if not (0 < part.find("@") < len(part) - 1 or (n >= 6 and 2 * n >= sum(map(str.isalnum, part)))):
            continue
        while at < len(seeds) and seeds[at][1] <= a:
            at += 1
        if at == len(seeds) or seeds[at][0] >= b:
            out.append((a, b))
    return out


def _cue(word: str) -> str:
    """A word of the context: lower-cased, digits as 0, without signs at its ends."""
    return DIGIT.sub("0", (word.strip(EDGE) or word).lower())


def contexts(text: str, spots: list[tuple[int, int, int]]) -> list[list[str]]:
    """The lexical patterns around each of the spots (kind, start, end), which are in the order of their starts.

    They are the one and the two words before it, the one after it, and one on each side.
    Words are those of the gaps between spots, whole ones at any distance; beyond a gap the
    neighbouring spot itself stands as a word.
    """
    gaps, end = [], 0
    for _, a, b in spots:
        gaps.append(WORD.findall(text, end, a) if a > end else [])
        end = max(end, b)
    last = WORD.search(text, end)
    signs = ["\0seed" if k >= 0 else "\0spot" for k, _, _ in spots]
    out = []
    for i in range(len(spots)):
        left = [*map(_cue, gaps[i][-2:])]
        if len(left) < 2 and i:
            left = [*([_cue(gaps[i - 1][-1])] if not left and gaps[i - 1] else []), signs[i - 1], *left][-2:]
        after = gaps[i + 1] if i + 1 < len(spots) else [last[0]] if last else []
        right = _cue(after[0]) if after else signs[i + 1] if i + 1 < len(spots) else None
        found = [f"L|{left[-1]}"] if left else []
        if len(left) == 2:
            found.append(f"LL|{left[0]}|{left[1]}")
        if right is not None:
            found.append(f"R|{right}")
            if left:
                found.append(f"LR|{left[-1]}|{right}")
        out.append(found)
    return out


def _hashed(patterns: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), 11) - (1 << 63) for p in patterns]


def spots_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The seeds by kind, then start; and seeds and candidates (kind -1) by start."""
    seeds = base_spans(text)
    marked = "@" in text or DIGIT.search(text)
    return seeds, sorted([*seeds, *((-1, a, b) for a, b in (_candidates(text, seeds) if marked else ()))], key=lambda x: (x[1], x[2], x[0]))


SCAN = "doc_id string, th long, n_email long, n_ip long, n_card long, n_phone long, spans array<struct<kind:int,start:int,end:int>>, near array<struct<kind:int,start:int,end:int,instance:long,patterns:array<long>>>"


def scan(docs: DataFrame) -> DataFrame:
    """One pass over whole texts: seeds of each row, and all candidates with their patterns. Offsets are code points.

    th is a hash of the text; rows are told apart by doc_id and text. Null text counts as empty.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, th, text in zip(batch["doc_id"], batch["th"], batch["text"], strict=True):
                text = text or ""
                seeds, spots = spots_of(text)
                counts = [sum(k == i for k, _, _ in seeds) for i in range(len(KINDS))]
                near = [{"kind": k, "start": a, "end": b, "instance": xxhash.xxh64_intdigest(_instance(text[a:b]), 13) - (1 << 63), "patterns": _hashed(p)} for (k, a, b), p in zip(spots, contexts(text, spots) if spots else (), strict=True) if p]
                rows.append((doc, th, *counts, [{"kind": k, "start": a, "end": b} for k, a, b in seeds], near))
            yield pd.DataFrame(rows, columns=["doc_id", "th", "n_email", "n_ip", "n_card", "n_phone", "spans", "near"])

    # As text, an id passes pandas whole, also beside nulls.
    found = text_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), _key().alias("th"), "text").mapInPandas(each, SCAN)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _instance(text: str) -> str:
    """An identifier's identity: its letters, digits and at signs, lower-cased."""
    return "".join(c for c in text.lower() if c.isalnum() or c == "@")


#: Squared width of the interval that confidences are the lower ends of: five chances in a hundred are left out on that side.
WIDTH2 = 1.645**2


def least_share(hits: Column, n: Column) -> Column:
    """The lower end of Wilson's interval of a share: few instances give less confidence than many."""
    p = hits / n
    return (p + WIDTH2 / (2 * n) - F.sqrt(F.lit(WIDTH2) * (p * (1 - p) / n + WIDTH2 / (4 * n * n)))) / (1 + WIDTH2 / n)


def bootstrap(cuts: Cuts, near: DataFrame, support: int = 5, sure: float = 0.75, most_rounds: int = 100) -> DataFrame:
    """(pattern, kind, conf): the patterns of near(kind, instance, patterns) that come to be trusted.

    A pattern's confidence in a kind is the lower end of the interval of the share that its
    distinct instances' confidences in that kind have; it needs `support` instances' worth
    of them and a confidence of `sure`. An instance that is no seed has the confidence of its
    best trusted pattern. What is trusted stays so with the confidence that it was trusted
    at, and rounds go on until none is added. Edges are distinct and pre-aggregated, so a
    pattern or an instance in a third of the corpus is one row for each partner.
    """
    one = near.select("kind", "instance", F.explode(F.array_distinct("patterns")).alias("pattern"))
    edges = cuts.cut(one.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    totals = cuts.cut(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support), "totals")
    seeds = cuts.cut(edges.filter("kind >= 0").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("conf", F.lit(1.0)), "seeds")
    unknown = edges.filter("kind < 0").select("pattern", "instance").join(seeds.select("instance"), "instance", "left_anti")
    known, trusted = seeds, None
    for _ in range(most_rounds):
        met = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("conf").alias("hits"))
        scored = met.filter(F.col("hits") >= support).join(totals, "pattern").withColumn("conf", least_share(F.col("hits"), F.col("n"))).filter(F.col("conf") >= sure).select("pattern", "kind", "conf")
        fresh = cuts.cut(scored if trusted is None else scored.join(trusted, ["pattern", "kind"], "left_anti"), "fresh")
        if fresh.isEmpty():
            return fresh if trusted is None else trusted
        trusted = cuts.cut(fresh if trusted is None else trusted.unionByName(fresh), "trusted")
        best = unknown.join(trusted, "pattern").groupBy("instance").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("kind"), F.max("conf").alias("conf"))
        known = cuts.cut(seeds.unionByName(best), "known")
    raise RuntimeError(f"patterns were still being added after {most_rounds} rounds")


def find_personal(docs: DataFrame, support: int = 5, sure: float = 0.75) -> DataFrame:
    """(doc_id, th, n_email, n_ip, n_card, n_phone, seeds, spans): spans has the seeds, then what trusted patterns add.

    Both are array<struct<kind, start, end>> by kind, then start. Counts are of seeds. Every
    row of docs has one row, repeated ones too, and a null text counts as empty; the texts are
    read once and not shuffled. th is a hash of the text: rows are told apart by id and text.
    """
    cuts = Cuts(docs.sparkSession, "pii")
    seen = cuts.cut(scan(docs), "scan")
    trusted = bootstrap(cuts, seen.select(F.inline("near")), support, sure)
    spots = seen.filter(F.exists("near", lambda x: x["kind"] < 0)).select("doc_id", "th", F.inline("near")).filter("kind < 0")
    hits = spots.select("doc_id", "th", "start", "end", F.explode("patterns").alias("pattern")).join(trusted.withColumnRenamed("kind", "as_kind"), "pattern")
    best = hits.groupBy("doc_id", "th", "start", "end").agg(F.max_by("as_kind", F.struct("conf", -F.col("as_kind"))).alias("kind"))
    added = best.groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    added = added.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), "more")
    out = seen.drop("near").join(added, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__th")), "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    spans = F.array_sort(F.concat("spans", F.coalesce("more", none)))
    return out.select("doc_id", "th", "n_email", "n_ip", "n_card", "n_phone", F.col("spans").alias("seeds"), spans.alias("spans"))


def _listed(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def personal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row for each row of docs.

    Null and empty texts have no spans and the digest of no characters. Repeated rows and ids
    each have their row; of spans that start together those of the kind listed first come
    first. Other columns are not read; an empty table gives an empty result.
    """
    found = find_personal(docs)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(_listed("seeds"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


#: Trusted patterns that are sent to every task; with more of them the texts meet their spans in a join.
MOST_PATTERNS = 200_000


def mask(docs: DataFrame, support: int = 5, sure: float = 0.75) -> DataFrame:
    """docs, all columns, with personal data replaced by its kind in brackets; overlapping spans become one.

    The texts are read twice, to learn the patterns and to mask, and not shuffled. Texts without
    spans come back as they are, null ones too. If there are more than MOST_PATTERNS trusted
    patterns, the spans are found as by find_personal and joined to the texts.
    """
    cuts = Cuts(docs.sparkSession, "mask")
    trusted = bootstrap(cuts, scan(docs).select(F.inline("near")), support, sure)
    if trusted.count() > MOST_PATTERNS:
        return mask_spans(docs, find_personal(docs, support, sure))
    known: dict[int, tuple[float, int]] = {}
    for r in trusted.collect():
        known[r["pattern"]] = max(known.get(r["pattern"], (-1.0, 0)), (r["conf"], -r["kind"]))

    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        return pd.Series([covered(t, _with_added(t, known)) if t else t for t in texts], dtype=object)

    own = F.col("__row.text")
    return restored(carried(docs), docs.columns, text=F.when(F.rlike(own, F.lit("[0-9@]")), cover(own)).otherwise(own))


def _with_added(text: str, known: dict[int, tuple[float, int]]) -> list[dict]:
    """All spans of a text: its seeds and what the known patterns add."""
    seeds, spots = spots_of(text)
    spans = [{"kind": k, "start": a, "end": b} for k, a, b in seeds]
    if known and len(spots) > len(seeds):
        for (k, a, b), patterns in zip(spots, contexts(text, spots), strict=True):
            best = max((known[p] for p in _hashed(patterns) if p in known), default=None) if k < 0 else None
            if best:
                spans.append({"kind": -best[1], "start": a, "end": b})
    return spans


def mask_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs, all columns, with each span of `found` replaced by its kind in brackets; overlapping spans become one.

    Only rows with spans meet the texts; texts without spans come back as they are, null ones too.
    """
    spans = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), F.col("spans").alias("__spans")).dropDuplicates(["__doc", "__th"])

    @F.pandas_udf("string")
    def cover(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([covered(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    rows = carried(docs, __id=F.col("doc_id"), __of=_key())
    both = rows.join(spans.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__of") == F.col("__th")), "left")
    own = F.col("__row.text")
    text = F.when(F.col("__spans").isNull(), own).otherwise(cover(F.when(F.col("__spans").isNotNull(), own), F.col("__spans")))
    return restored(both, docs.columns, text=text)


def covered(text: str | None, spans) -> str | None:
    if spans is None or text is None:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[int, int, int]]) -> str:
    """SHA-256 of spans as they are listed, for tests."""
    return sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
