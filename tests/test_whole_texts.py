"""Queries over phrases take whole texts, however many phrases come first."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corvella.functions import held
from corvella.functions import terms as T
from corvella.functions import vocabulary as V
from corvella.functions.text import low_signal_phrase, low_signal_term
from corvella.operators import phrases as P
from corvella.operators.cut import stored
from corvella.plans import catalogue, texts
from corvella.sources.views import Tables
from tests.oracle import assert_equal

LATE = "fern ecology"


def filler(start: int) -> str:
    """Phrases of no other text, over 140 of them."""
    return " ".join(f"w{chr(97 + start)}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(160))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("late"))
    rows = [(i, f"A. {filler(i)}. Of {LATE} of moss garden of {'late stone bench' if i == 1 else ''}") for i in range(4)] + [(4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", ["phrase_kept", "phrase_quality"])
def test_late_phrases_have_a_quality(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = catalogue.queries()[name](spark, folder)
    assert {r.phrase: r.doc_freq for r in got.collect()}[LATE] == 4
    assert_equal(got, con, catalogue.oracle_sql()[name])


def test_late_phrases_are_in_the_dictionary(spark, folder):
    found = {r.canonical: r for r in texts.concept_dictionary(Tables(spark, folder)).collect()}
    assert LATE in {p for r in found.values() for p in (r.canonical, *r.variants)}
    assert found["late stone bench"].doc_freq == 1


def test_single_concepts_of_the_table_equal_those_of_documents(spark, folder):
    """What the table of phrases tells of one document's phrases is what joins by document give."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).withColumn("doc_id", F.col("doc_id") + 100))
    rows = texts.kept(P.doc_phrases(docs).groupBy("phrase").agg(F.count(F.lit(1)).alias("doc_freq")).filter("doc_freq >= 2"))
    several = P.consolidated(P.concepts_of(rows, P.phrase_clusters(rows)))
    want = several.unionByName(P.single_concepts(P.doc_phrases(docs), several))
    got = P.concept_dictionary(rows, P.phrase_table(docs), 64).drop("idf")
    of = lambda df: sorted((r.canonical, tuple(r.variants), r.doc_freq) for r in df.collect())
    assert of(got) == of(want) and len(of(got)) > 1000


def test_late_concepts_are_a_documents_terms(spark, folder):
    found = texts.document_concept_terms(Tables(spark, folder)).collect()
    assert {r.doc_id: r.concept for r in found if r["rank"] == 1}[1] == "late stone bench"


def test_concepts_of_the_corpus_equal_those_of_its_dictionary(spark, folder, monkeypatch):
    """Also where the bits find much that they do not hold."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(80).withColumn("doc_id", F.col("doc_id") + 100))
    more = spark.createDataFrame([(900, "Fern ecology: fern, walls. moss garden/moss garden walls, results indicated data collection two schools"), (901, "no sentence end fern ecology moss garden walls"), (None, "river stone bench. river stone bench")], "doc_id long, text string")
    docs = stored(docs.unionByName(more).repartition(3))
    shared = stored(P.doc_phrases(docs).groupBy("phrase").agg(F.count(F.lit(1)).alias("doc_freq")).filter("doc_freq >= 2"))
    rows = stored(texts.kept(shared))
    n = docs.count()
    of = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = of(P.document_concepts(texts.titled(docs), P.concept_dictionary(rows, P.phrase_table(docs), n), n))
    assert of(P.corpus_concepts(texts.titled(docs), shared, P.several_concepts(rows), n)) == want and len(want) > 500
    monkeypatch.setattr(P, "bits_of", lambda rows, column, n: bytes([255] * 512))
    assert of(P.corpus_concepts(texts.titled(docs), shared, P.several_concepts(rows), n)) == want


def test_bits_hold_their_strings(spark):
    words = [f"word {i}" for i in range(20000)]
    bits = held.bits_of(spark.createDataFrame([(w,) for w in words], "x string").repartition(3), "x", len(words))
    assert held.may_hold(bits, words).all()
    assert held.may_hold(bits, [f"other {i}" for i in range(20000)]).mean() < 0.05
    assert not held.may_hold(held.bits_of(spark.createDataFrame([], "x string"), "x", 0), words).any()


def test_rules_in_the_row_equal_the_columns(spark):
    some = [*V.LOW_TERMS, "fern ecology", "results indicate", "participants data schedule", "fern two", "one fern", "interview data", "data indicates fern", "fern review", "review fern", "will help fern"]
    some += [f"fern {w}" for w in (*V.WEAK_HEADS, *V.WEAK_ANYWHERE, *V.DISALLOWED, *V.TERM_HEADS)] + [f"{w} fern" for w in (*V.WEAK_HEADS, *V.WEAK_ANYWHERE, *V.DISALLOWED, *V.TERM_ANYWHERE)]
    got = spark.createDataFrame([(p,) for p in some], "phrase string").select("phrase", P.weak_single().alias("weak"), low_signal_term(F.col("phrase")).alias("little"), low_signal_phrase(F.split("phrase", " ")).alias("never")).collect()
    fine = [r for r in got if not r.never]
    assert all(T.weak(r.phrase) == r.weak and T.says_little(r.phrase) == r.little for r in fine) and len(fine) > 50
