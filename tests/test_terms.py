"""Terms and phrases found in Arrow UDFs, against their Column forms; and that texts are read once."""

import pytest
from pyspark.sql import functions as F

from corvella.functions import terms as T
from corvella.functions import text
from corvella.operators import phrases as P
from corvella.operators import topics as O

TEXTS = [
    "The well-being of rural schools: rural schools, policy reform and rural SCHOOLS policy reform again",
    "columbia schools 1999a 12 ----- a-b-c 2nd-grade Café naïve schools\x1cpolicy _under_score_ İstanbul KKelvin",
    "policy policy schools policy " * 40,
    "using schools better schools reform higher, schools; reform/policy reform of teachers in high poverty districts",
    "",
    None,
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def plain(rows, column):
    return {r[0]: r[1] for r in rows.select("doc_id", column.alias("x")).collect()}


def test_counts_equal_the_column_forms(rows):
    words = P.split_words(F.col("text"))
    for n in (2, 3, 4):
        want = plain(rows, P.in_row_counts(text.ngrams(words, n)))
        got = plain(rows, T.phrase_counts(F.col("text"), [n]))
        assert {k: sorted(v) for k, v in got.items()} == want
        assert any(want.values())
    want = plain(rows, P.in_row_counts(text.tokens(F.col("text"))))
    assert {k: sorted(v) for k, v in plain(rows, T.token_counts(F.col("text"))).items()} == want
    both = F.array_distinct(F.concat(text.ngrams(words, 2), text.ngrams(words, 3)))
    for limit in (0, 2, 140):
        assert plain(rows, T.first_phrases(F.col("text"), limit)) == plain(rows, F.slice(both, 1, limit) if limit else F.array().cast("array<string>"))


def test_no_phrase_goes_over_a_cut(spark):
    one = spark.createDataFrame([(1, "rural schools; policy reform")], "doc_id long, text string")
    assert {x.term for x in plain(one, T.phrase_counts(F.col("text"), (2, 3), "[:;,]"))[1]} == {"rural schools", "policy reform"}


def test_words_seen_are_bounded():
    assert T.Places()["schools"] == T.PART | T.START | T.END
    seen = T.Places.fromkeys(map(str, range(1 << 18)), 0)
    assert seen["schools"] and len(seen) == 1


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_texts_are_read_once(rows):
    """What is read several times is stored, not found anew in the texts."""
    found = P.doc_phrases(rows).groupBy("phrase").agg(F.count(F.lit(1)).alias("doc_freq"))
    assert scans(found) and not scans(P.phrase_quality(found))
    uses = rows.select("doc_id", F.inline(T.token_counts(F.col("text")))).withColumnRenamed("tf", "n")
    placed = uses.select(F.when(F.col("doc_id") == 1, -1).otherwise(1).alias("topic_id"), "term", "n").groupBy("topic_id", "term").agg(F.sum("n").alias("n"))
    assert not scans(O.class_weights(placed))
    assigned = rows.select("doc_id", F.when(F.col("doc_id") == 1, -1).otherwise(1).alias("topic_id"))
    moved = O.reassigned(uses, assigned)
    assert not scans(moved) and moved.count() == len(TEXTS)
