import pytest

from corvella.api import CorpusAnalytics
from corvella.operators import runs
from corvella.sources.views import Tables

FOLDER = "/root/testdata/sf0.001"


def test_slices(spark):
    whole = CorpusAnalytics(Tables(spark, FOLDER))
    part = CorpusAnalytics(Tables(spark, FOLDER), 500, degree="1-URGENT")
    assert part.documents.count() < 500 < whole.documents.count()
    assert {r.degree for r in part.bootstrap().collect()} == {"1-URGENT"}
    for c in (whole, part):
        for group in (c.analytics(), c.visualizations(), c.people(), c.document(7)):
            for df in group.values():
                df.collect()
    assert whole.top_cited(3).count() <= 3
    assert part.facets_of().filter("field = 'degree'").count() == 1


def test_parameters():
    assert runs.checked(max_records=10, page_size="100", index="x", term=None) == []
    assert len(runs.checked(max_records=10_000, page_size=0, scan_limit="x", query="y" * 501)) == 4
    with pytest.raises(ValueError, match="max_records"):
        CorpusAnalytics(None, 10_000)
