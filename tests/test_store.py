from corvella.operators import merge
from corvella.sources import store


def test_versions(spark, tmp_path):
    table = store.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    table.write(first)
    table.write(merge.upsert(table.read(), spark.createDataFrame([(2, "c"), (3, None)], "id int, v string"), "id", ("v",)))
    assert {tuple(r) for r in table.read().collect()} == {(1, "a"), (2, "c"), (3, None)}
    assert [v for v in table._versions()] == [0, 1]


def test_dictionary(spark, tmp_path):
    rows = spark.createDataFrame([("online learning", ["e learning", "digital learning"], 4, 1.5)], "canonical string, variants array<string>, doc_freq long, idf double")
    store.write_dictionary(rows, f"file://{tmp_path}/d")
    concepts, variants = store.read_dictionary(spark, f"file://{tmp_path}/d")
    assert concepts.first().idf == 1.5
    assert {tuple(r) for r in variants.collect()} == {("e learning", "online learning"), ("digital learning", "online learning")}
