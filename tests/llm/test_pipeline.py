"""The pipeline's stages on small tables, and registered queries with SQL."""

import math
import re

import corpus_pipeline
from corvella.llm import quality_classifier, queries
from tests.llm.cases import documents, empty
from tests.llm.test_near_copies import classes
from tests.llm.test_operators import added_slow, personal, shares_slow
from tests.oracle import assert_equal, connect

FOLDER = "/root/testdata/sf0.001"


def test_queries_equal_sql(spark):
    con = connect(FOLDER)
    for name, sql in queries.oracle_sql().items():
        assert_equal(queries.queries()[name](spark, FOLDER), con, sql)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]


def test_stages_keep_columns(spark, tmp_path):
    docs = documents(spark)
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.schema == docs.schema, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(packed) == ids(docs)


def test_stages_equal_slow_versions(spark, tmp_path):
    """Each stage on what its predecessor kept, against a version without tables."""
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    before = rows(docs)
    good = corpus_pipeline.quality(spark, docs, str(tmp_path))
    model = quality_classifier.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = lambda t: 1 / (1 + math.exp(-model.bias - sum(model.gain[b] * x for b, x in shares_slow(t, model.settings).items())))
    assert rows(good) == {i: t for i, t in before.items() if score(t) >= 0.3}
    for stage, slow in ((corpus_pipeline.lines, lines_text), (corpus_pipeline.near_copies, lambda r: {i: r[i] for i in set(classes(list(r.items())).values())}), (corpus_pipeline.personal_data, masked)):
        out = stage(spark, docs, "").cache()
        assert rows(out) == slow(rows(docs))
        assert [r for r in out.select("text", "n_chars").collect() if stage is not corpus_pipeline.near_copies and r.text is not None and r.n_chars != len(r.text)] == []
        docs = out


def lines_text(rows):
    """Texts without the lines that three share, but in the largest."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    held = {}
    for i, t in rows.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(i)
    gone = {k: max(s) for k, s in held.items() if len(s) >= 3}
    return {i: "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i) for i, t in rows.items()}


def masked(rows):
    """Base spans replaced, one after another; nothing is added on so few rows."""
    assert added_slow([t or "" for t in rows.values()], 5, 0.75) == set()
    out = {}
    for i, t in rows.items():
        parts, at = [], 0
        for kind, a, b in sorted(personal(t or ""), key=lambda s: (s[1], -s[2])):
            if a >= at:
                parts += [t[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        out[i] = t if t is None else "".join([*parts, t[at:]])
    return out


def test_run_on_empty_tables(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0
    assert out.groupBy("bin_id").sum("n_words").filter("bin_id is not null and `sum(n_words)` > 2048").count() == 0
