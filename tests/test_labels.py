"""Label candidates against what their documents say."""

from corvella.operators import labels as L


def test_reviewed(spark):
    schema = "topic_id int, label string, origin int, warnings array<string>, score int"
    candidates = spark.createDataFrame([(1, "Reading in Early Grades", 0, [], 100), (1, "reading  in early grades", 1, ["too_long"], 85), (1, "Music for Young Children", 2, ["too_long"], 85), (2, "Forest Moss Ecology", 0, [], 100), (3, None, 0, ["empty_or_generic"], 0)], schema)
    documents = spark.createDataFrame([(1, f"Reading early grades {i}", "reading in the early grades") for i in range(12)] + [(2, "Forest moss ecology", "forest moss ecology")] * 4, "topic_id int, title string, abstract string")
    sizes = spark.createDataFrame([(1, 12), (2, 4)], "topic_id int, doc_count int")
    got = {(r.topic_id, r.label): (r.origin, r.warnings, r.score) for r in L.reviewed(candidates, documents, sizes).collect()}
    assert got == {
        (1, "Reading in Early Grades"): (0, [], 100),
        (1, "Music for Young Children"): (2, ["too_long", "low_label_coverage"], 60),
        (2, "Forest Moss Ecology"): (0, ["small_topic_review"], 75),
    }
