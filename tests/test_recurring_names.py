"""Names that recur are brought into form once."""

from corvella.functions import names
from corvella.operators import people as P


def test_names_are_remembered():
    names.fold.cache_clear()
    lists = [["Ann B. Lee", "Ann Lee", "Al Poe"]] * 100
    assert [names.merge_names(x) for x in lists] == [["Ann B. Lee", "Al Poe"]] * 100
    assert names.fold.cache_info().misses == 3


def test_forms_come_from_distinct_names(spark):
    rows = [(d, "Dr. Lee, Ann", None, "X") for d in range(3)] + [(1, "Ann Lee", "Supervisor", "Y"), (2, None, None, "X"), (2, "University of X", None, "X")]
    committee = spark.createDataFrame(rows, "doc_id long, name string, role string, affiliation string")
    docs = spark.createDataFrame([(d, 1990 + d) for d in range(3)], "doc_id long, year int")
    got = P.person_list(committee, docs)
    assert [tuple(r) for r in got.collect()] == [("ann lee", "Ann Lee", "Committee Member; Supervisor", "X; Y", 3, 1990, 1992)]
    assert "raw#" in got._jdf.queryExecution().optimizedPlan().toString()
