"""Quality rules as weak supervision (operator 1).

Each rule votes for or against a document or abstains. Expectation-maximisation over
the counts of vote patterns estimates how often each rule is right about good and
about bad documents, and a document's posterior probability of being good replaces
the demand that it pass every rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.llm.columns import BLANK_RUN, let, words
from corvella.llm.store import Cuts

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """bad and good are SQL conditions on the measures; a document that meets neither, or both, gets no vote."""

    name: str
    bad: str
    good: str


#: Measures are per whole text. Where a rule sees no sign either way it abstains.
RULES = (
    Rule("symbols", "n_symbols > 0.05 * n_words", "n_symbols = 0"),
    Rule("letters", "n_letters < 0.85 * word_chars", "n_letters >= 0.93 * word_chars"),
    Rule("capitals", "n_upper > 0.3 * n_letters", "n_upper < 0.15 * n_letters"),
    Rule("exclaims", "n_exclaims > 0.2 * n_words", "n_exclaims <= 0.02 * n_words"),
    Rule("separators", "n_bare > 0.1 * n_words", "n_bare <= 0.02 * n_words"),
    Rule("variety", "n_distinct < 1.5 * sqrt(n_words)", "n_distinct > 2.5 * sqrt(n_words)"),
    Rule("doubles", "n_doubles > 0.1 * n_words", "n_doubles <= 0.03 * n_words"),
    Rule("word_length", "word_chars > 14 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
)


def _chars(text: Column, outside: str) -> Column:
    return F.length(F.regexp_replace(text, outside, ""))


def _repeat_words(w: Column) -> Column:
    """Words that lie in a window of eight words found twice or more.

    Window hashes are doubled up from word hashes in three passes. Most texts have no two
    equal ones; in the others they are sorted, and neighbours of one hash are compared word
    by word, so a collision does not count.
    """
    last = F.size(w) - WINDOW

    def pair(h: Column, by: int) -> Column:
        return F.zip_with(h, F.slice(h, by + 1, F.greatest(F.size(h) - by, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    def windows(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda s: let(F.sort_array(twice(s)), covered))

    def twice(s: Column) -> Column:
        same = lambda x, y: (x["h"] == y["h"]) & (F.slice(w, x["i"] + 1, F.lit(WINDOW)) == F.slice(w, y["i"] + 1, F.lit(WINDOW)))
        return F.transform(F.filter(s, lambda x, k: F.coalesce(F.when(k > 0, same(x, F.get(s, k - 1))), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))), lambda x: x["i"])

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).cast("long").alias("n"), (i + WINDOW).cast("int").alias("end")))["n"]

    none = F.lit(0).cast("long")
    hashes = let(let(let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: pair(h, 1)), lambda h: pair(h, 2)), lambda h: pair(h, 4))
    found = let(F.slice(hashes, F.lit(1), last + 1), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(windows(h)))
    return F.when(last < 1, none).otherwise(found)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures that rules are written over, from whole texts; null text has no words."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = base.withColumn("w", words(F.col("text"))).withColumn("l", F.split("text", "\n"))
    worded = F.filter("l", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = lambda c: c.cast("long")
    doubles = let(F.col("w"), lambda w: F.size(F.filter(w, lambda x, i: F.when(i > 0, F.get(w, i - 1) == x).otherwise(False))))
    return split.select(
        "doc_id",
        n(F.size("w")).alias("n_words"),
        n(F.length(F.regexp_replace("text", BLANK_RUN, ""))).alias("word_chars"),
        n(_chars(F.col("text"), r"[^#*$%&|<>]+")).alias("n_symbols"),
        n(let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        let(F.col("w"), _repeat_words).alias("n_repeat_words"),
        n(F.size("l")).alias("n_lines"),
        n(_chars(F.col("text"), r"\P{L}+")).alias("n_letters"),
        n(_chars(F.col("text"), r"\P{Lu}+")).alias("n_upper"),
        n(_chars(F.col("text"), r"[^!?]+")).alias("n_exclaims"),
        n(F.size(F.filter("w", lambda x: (F.length(x) <= 3) & ~x.rlike(r"[\p{L}\p{N}]")))).alias("n_bare"),
        n(F.size(F.array_distinct("w"))).alias("n_distinct"),
        n(doubles).alias("n_doubles"),
    )


def vote(rule: Rule) -> Column:
    bad, good = F.coalesce(F.expr(rule.bad), F.lit(False)), F.coalesce(F.expr(rule.good), F.lit(False))
    return F.when(bad & ~good, -1).when(good & ~bad, 1).otherwise(0)


def _log_odds(votes: list[Column] | Column, right_good: Column, right_bad: Column, prior: Column) -> Column:
    """Log odds of good against bad, given arrays of the votes and of the rules' accuracies."""
    each = F.zip_with(F.arrays_zip(votes.alias("v"), right_good.alias("g")), right_bad, lambda x, b: F.when(x["v"] == 1, F.log(x["g"]) - F.log(1 - b)).when(x["v"] == -1, F.log(1 - x["g"]) - F.log(b)).otherwise(0.0))
    return F.aggregate(each, F.log(prior) - F.log(1 - prior), lambda a, x: a + x)


def learn(patterns: DataFrame, n_rules: int, rounds: int = 40, prior: float = 0.9, right: tuple[float, float] = (0.98, 0.4)) -> dict:
    """EM over patterns(votes array<int>, n long), at most 3 ** n_rules rows: the prior and each rule's accuracy on good and on bad documents.

    The rounds are one SQL expression over the patterns, gathered as one row. Estimates are
    smoothed by one vote each way and kept within [0.01, 0.999], and a rule is never taken to
    be right about good documents less often than it is wrong about bad ones, so the classes
    cannot change places. Without documents the start values come back.
    """
    one = patterns.agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("p"))
    fill = lambda x: F.array_repeat(F.lit(float(x)), n_rules)
    start = F.struct(F.lit(float(prior)).alias("prior"), fill(right[0]).alias("g"), fill(right[1]).alias("b"))

    def step(s: Column, _: Column) -> Column:
        scored = F.transform(F.col("p"), lambda x: F.struct(x["votes"].alias("v"), x["n"].alias("n"), (x["n"] / (1 + F.exp(-_log_odds(x["votes"], s["g"], s["b"], s["prior"])))).alias("w")))

        def update(t: Column) -> Column:
            total = lambda f: F.aggregate(t, F.lit(0.0), lambda a, x: a + f(x))

            def rate(j: Column, sign: int, weight) -> Column:
                hit = total(lambda x: F.when(F.get(x["v"], j) == sign, weight(x)).otherwise(0.0))
                cast = total(lambda x: F.when(F.get(x["v"], j) != 0, weight(x)).otherwise(0.0))
                return (hit + 1) / (cast + 2)

            good = F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda j: F.least(F.greatest(rate(j, 1, lambda x: x["w"]), F.lit(0.01)), F.lit(0.999)))
            bad = F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda j: F.least(F.greatest(rate(j, -1, lambda x: x["n"] - x["w"]), F.lit(0.01)), F.lit(0.999)))
            bad = F.zip_with(good, bad, lambda g, b: F.greatest(b, 1 - g))
            share = (total(lambda x: x["w"]) + 1) / (total(lambda x: x["n"]) + 2)
            return F.struct(F.least(F.greatest(share, F.lit(0.05)), F.lit(0.99)).alias("prior"), good.alias("g"), bad.alias("b"))

        return let(scored, update)

    row = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m")).first()["m"]
    return {"prior": row["prior"], "good": list(row["g"]), "bad": list(row["b"])}


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """One row a document: its measures, one vote column a rule, p_good, base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows of eight.
    The estimate counts every row that the base leaves, repeated ones as often as they occur;
    those that fail it are decided. Empty and null texts fail; an empty table gives an empty result.
    """
    cuts = Cuts(docs.sparkSession, "rules")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    cast = [f"vote_{r.name}" for r in rules]
    seen = cuts.cut(measures(docs).withColumn("base_failed", base_failed).withColumns({c: vote(r) for c, r in zip(cast, rules, strict=True)}), "votes")
    model = learn(seen.filter(~F.col("base_failed")).groupBy(F.array(*cast).alias("votes")).agg(F.count(F.lit(1)).alias("n")), len(rules))
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    odds = _log_odds(F.array(*cast), numbers(model["good"]), numbers(model["bad"]), F.lit(model["prior"]))
    scored = seen.withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def rule_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good and the votes."""
    out = judged(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", *[c for c in out.columns if c.startswith("vote_")])
