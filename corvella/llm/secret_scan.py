"""Secret scanning over a trigram inverted index (operator 8).

Each rule's regular expression gives a Boolean query over the trigrams that any match
must contain. Postings of those trigrams are intersected into candidate documents, and
only candidates are verified with the expression. A rule whose matches need no trigram
is scanned for in every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.llm.columns import hex_sha256, let
from corvella.llm.store import Cuts


@dataclass(frozen=True)
class SecretRule:
    """A match counts if group `group` has at least `least` characters; others are dropped without a second try."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The three base kinds, in the order in which ties are listed.
BASE_RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs of the class are maximal, so the length can stand in the expression.
    SecretRule("hex", r"[0-9a-f]{32,}", 0, 32),
)

#: Publicly documented token formats that the method adds.
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A Boolean query in disjunctive form: a document can match if it has all trigrams of one set. None: no trigram is needed.
Query = frozenset

#: Classes and alternations with more strings than this break a literal run.
MOST_STRINGS = 32

#: Trigrams of one conjunction that are looked up.
MOST_GRAMS = 6


def _strings(node) -> set[str] | None:
    """All strings that a parsed item matches, lower-cased, or None where they are many or unbounded."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
        chars = {chr(c).lower() for o, a in arg for c in ([a] if o is sre.LITERAL else range(a[0], a[1] + 1))}
        return chars if len(chars) <= 6 else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, item = arg
        inner = _sequence(item)
        if inner is None or high > 3:
            return None
        return {"".join(p) for k in range(low, int(high) + 1) for p in _power(inner, k)}
    return {""} if op is sre.AT else None


def _power(strings: set[str], k: int) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for _ in range(k):
        out = [x + (s,) for x in out for s in strings]
    return out


def _sequence(items) -> set[str] | None:
    out = {""}
    for node in items:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _grams(run: set[str]) -> set[Query] | None:
    """One conjunction for each string of a run; None if some string is too short to need a trigram."""
    each = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
    return None if frozenset() in each else each


def trigram_query(regex: str) -> set[Query] | None:
    """Sets of trigrams of which a match's lower-cased text has one whole set, or None if none are mandatory."""

    def of(items) -> set[Query] | None:
        found: set[Query] | None = None
        run = {""}

        def close(run: set[str]) -> None:
            nonlocal found
            more = _grams(run)
            if more:
                both = more if found is None else {a | b for a in found for b in more}
                found = both if len(both) <= MOST_STRINGS else found

        for node in items:
            strings = _strings(node)
            if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
                run = {a + b for a in run for b in strings}
                continue
            close(run)
            run = {""} if strings is None else strings
            if strings is None:
                op, arg = node
                inner = None
                if op is sre.SUBPATTERN:
                    inner = of(arg[3])
                elif op is sre.BRANCH:
                    each = [of(x) for x in arg[1]]
                    inner = None if None in each else set().union(*each)
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                    inner = of(arg[2])
                if inner:
                    both = inner if found is None else {a | b for a in found for b in inner}
                    found = both if len(both) <= MOST_STRINGS else found
        close(run)
        return found

    query = of(sre_parser.parse(regex))
    if not query:
        return None
    # Fewer trigrams ask for less and stay necessary; those with other signs than letters are rarer in prose.
    least = lambda sets: {c for c in sets if not any(other < c for other in sets)}
    return least({frozenset(sorted(c, key=lambda t: (t.isalpha(), t))[:MOST_GRAMS]) for c in least(query)})


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))


def trigrams_of(rules: tuple[SecretRule, ...]) -> list[str]:
    """The trigrams that the rules' queries ask for."""
    return sorted({t for r in rules for c in trigram_query(r.regex) or () for t in c})


def trigram_postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index over the given trigrams of lower-cased texts: (trigram, doc_id, th), one row a document that has it.

    th is the text's hash: rows are told apart by doc_id and text, so repeated and null ids are
    no special case. Written as a table, it serves any rules that ask for no other trigrams.
    """
    low = _keyed(docs).withColumn("low", F.lower("text"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])) if trigrams else F.array().cast("array<string>")
    return low.select(F.explode(has).alias("trigram"), "doc_id", "th")


#: Trigrams of one mask.
BITS = 60


def candidates(postings: DataFrame, queries: dict[str, set[Query]]) -> DataFrame:
    """Intersects postings: (doc_id, th, rules), the kinds whose Boolean query a document meets."""
    every = sorted({t for q in queries.values() for c in q for t in c})
    at = {t: divmod(i, BITS) for i, t in enumerate(every)}
    # Each trigram is a bit of one of as many masks as are needed.
    places = F.create_map(*[F.lit(x) for i, t in enumerate(every) for x in (t, i)])
    place = F.element_at(places, F.col("trigram"))
    bit = F.expr(f"shiftleft(1L, __place % {BITS})")
    masks = [F.coalesce(F.bit_or(F.when(F.expr(f"__place div {BITS} = {w}"), bit)), F.lit(0).cast("long")).alias(f"m{w}") for w in range(-(-len(every) // BITS))]
    found = postings.filter(F.col("trigram").isin(every)).withColumn("__place", place).groupBy("doc_id", "th").agg(*masks)

    def met(query: set[Query]) -> Column:
        def all_of(c: Query) -> Column:
            need: dict[int, int] = {}
            for t in c:
                word, place = at[t]
                need[word] = need.get(word, 0) | 1 << place
            return reduce(lambda a, b: a & b, [F.col(f"m{w}").bitwiseAND(F.lit(m).cast("long")) == m for w, m in need.items()])

        return reduce(lambda a, b: a | b, [all_of(c) for c in query])

    rules = F.array_compact(F.array(*[F.when(met(q), F.lit(k)) for k, q in queries.items()]))
    return found.select("doc_id", "th", rules.alias("rules")).filter(F.size("rules") > 0)


#: Matches whose places are added up together; the sums of such runs are added up once more.
RUN = 256


def _running(sizes: Column) -> Column:
    """Before each of an array's numbers, the sum of those before it: in runs, so that long arrays take time in proportion."""
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("out"))

    def sums(numbers: Column) -> Column:
        return F.aggregate(numbers, zero, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))["out"]

    def whole(x: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(x)), F.lit(RUN))
        runs = F.transform(firsts, lambda i: F.slice(x, i, F.lit(RUN)))
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, b: a + b))
        return let(runs, lambda r: let(sums(totals), lambda before: F.flatten(F.transform(r, lambda own, k: F.transform(sums(own), lambda s: s + F.get(before, k))))))

    return let(sizes, whole)


def _spans(text: Column, rule: SecretRule, order: int) -> Column:
    """array<struct<start, ord, end, kind>> of the matches that count, in code points, end exclusive.

    The pieces between matches and the matches themselves give the offsets.
    """
    hit = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    whole = F.struct(F.split(text, rule.regex, -1).alias("gap"), hit.alias("hit"), *([value.alias("val")] if rule.group else []))

    def walk(s: Column) -> Column:
        n = F.size(s["hit"])
        sizes = F.zip_with(F.slice(s["gap"], F.lit(1), n), s["hit"], lambda g, h: (F.length(g) + F.length(h)).cast("long"))

        def placed(before: Column) -> Column:
            def one(i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(s["gap"], i))
                return F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + F.length(F.get(s["hit"], i))).alias("end"), F.lit(rule.kind).alias("kind"))

            good = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.length(F.get(s["val" if rule.group else "hit"], i)) >= rule.least)
            return F.transform(good, one)

        return F.when(n > 0, let(_running(sizes), placed)).otherwise(F.array().cast(SPANS))

    return let(whole, walk)


SPANS = "array<struct<start:long,ord:int,end:long,kind:string>>"


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, postings: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans) for each row of docs: array<struct<start, ord, end, kind>> by start, then the rule's place in `rules`.

    Null and empty texts have no spans; repeated rows each have their own; other columns are
    not read; an empty table gives an empty result. postings is an index of these texts that
    has the rules' trigrams (see trigram_postings); without it the trigrams are indexed here.
    The texts are shuffled once, to meet their candidates.
    """
    cuts = Cuts(docs.sparkSession, "secrets")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    rows = _keyed(docs)
    if queries:
        index = cuts.cut(trigram_postings(docs, trigrams_of(rules)), "postings") if postings is None else postings
        able = candidates(index, queries).select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), "rules")
        rows = rows.join(able.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__th")), "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<string>"))
    each = []
    for i, r in enumerate(rules):
        wanted = F.array_contains("rules", r.kind) if r.kind in queries else F.rlike("text", F.lit(r.regex))
        each.append(F.when(wanted, _spans(F.col("text"), r, i)).otherwise(F.array().cast(SPANS)))
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of docs; null and empty texts have no spans and the digest of no characters."""
    found = find_secrets(docs)
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["ord"] == i)).cast("long").alias(f"n_{BASE_RULES[i].kind}")

    counts = [count(i) for i in range(len(BASE_RULES))]
    return found.select("doc_id", *counts, hex_sha256(_listed(base)).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
