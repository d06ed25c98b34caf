"""Examples for the full-text parsers and the hit source."""

import pytest
from pyspark.sql import functions as F

from corvella.functions import parsers as P
from corvella.functions.people_pages import acknowledged, committee_page, members
from corvella.functions.references import bibliography, search_terms, starts_citation
from corvella.sources import hits as H

MEMBER = "Supervisory Committee Member"
AFTERWARDS = " Their questions made every chapter clearer, and the years in the lab would have been much duller without their company and good humour."


@pytest.mark.parametrize(
    ("text", "people"),
    [
        ("Above all I thank my supervisor, Dr. Maren Oduya, for steady advice. My committee members: Dr. Ilse Brandt and Prof. Teo Lund read every draft.", {("Maren Oduya", "Supervisor"), ("Ilse Brandt", MEMBER), ("Teo Lund", MEMBER)}),
        ("This work owes much to my supervisors, Dr. Rui Pereira and Dr. Anke Vos, who never tired of it.", {("Rui Pereira", "Co-Supervisor"), ("Anke Vos", "Co-Supervisor")}),
        ("Thanks go to Dr. Noor Haddad (Supervisor) and Dr. Pia Lehto (Co-Supervisor).", {("Noor Haddad", "Supervisor"), ("Pia Lehto", "Co-Supervisor")}),
        ("I was lucky in a committee comprised of Ana Ruiz, Bo Nyberg and Cora Quist.", {("Ana Ruiz", MEMBER), ("Bo Nyberg", MEMBER), ("Cora Quist", MEMBER)}),
        ("It was Emil Falk and Gita Rao, my research co-supervisors, who first saw it. In the end Hugo Stein was the final member of my thesis committee.", {("Emil Falk", "Co-Supervisor"), ("Gita Rao", "Co-Supervisor"), ("Hugo Stein", MEMBER)}),
        ("I owe my Thesis Committee - Drs. Ivo Kral, Jana Mraz, and Karl Otto - more than I can say.", {("Ivo Kral", MEMBER), ("Jana Mraz", MEMBER), ("Karl Otto", MEMBER)}),
        ("I thank Committee Chair Dr. Lena Moss. Also Dr. Milo Nash, the chair of my committee, and Dr. Nina Orr, committee chair in the last year.", {("Lena Moss", "Supervisor"), ("Milo Nash", "Supervisor"), ("Nina Orr", "Supervisor")}),
        ("Dr. Olaf Penn, as my co-advisor, came late; my other co-advisor, Dr. Petra Quinn, was there from the start.", {("Olaf Penn", "Co-Supervisor"), ("Petra Quinn", "Co-Supervisor")}),
        ("Nobody could have done more than Dr. Quentin van der Ree in those years as my supervisor.", {("Quentin van der Ree", "Supervisor")}),
        ("Dr. Rosa Saint. She was kind. I thank the University of Nowhere.", set()),
    ],
)
def test_acknowledged(text, people):
    assert {(n, r) for n, r, _ in acknowledged("Front matter\n\fACKNOWLEDGEMENTS\n" + text + AFTERWARDS)} == people


def test_acknowledgements_of_a_contents_page_are_passed_over():
    contents = "Acknowledgements\niv\nAbstract " + "word " * 40 + "\nAcknowledgments\nChapter one .... 5 " + "word " * 40
    real = "\nACKNOWLEDGMENTS\nI thank my supervisor Dr. Tilda Ulm for all of it." + AFTERWARDS
    assert acknowledged(contents + real) == [("Tilda Ulm", "Supervisor", None)]
    assert acknowledged(contents) == acknowledged(None) == acknowledged("Acknowledgements\nToo short.") == []


@pytest.mark.parametrize(
    ("page", "home"),
    [
        ("Vera Wolff, Professor, Botany\nSupervisor\nXaver Young, Lecturer, Law\nCo-Supervisor", "Professor, Botany"),
        ("Supervisor\n_______\nVera Wolff, Professor, Botany\nCo-Supervisor\nXaver Young, Law", "Professor, Botany"),
        ("Xaver Young (Co-Supervisor)\nVera Wolff (Supervisor)", None),
        ("Vera Wolff, Professor, Department of Trees,\nShrubs & Moss\nSupervisor\nXaver Young\nCo-Supervisor", "Professor, Department of Trees, Shrubs & Moss"),
    ],
)
def test_committee_page(page, home):
    found = committee_page("Title\nThe following individuals certify that they have read this work\n" + page + "\nAdditional Committee Members\nAbstract\nZoe Abel\nSupervisor")
    assert {(n, r): a for n, r, a in found if r != MEMBER}.keys() == {("Vera Wolff", "Supervisor"), ("Xaver Young", "Co-Supervisor")}
    assert {n: a for n, _, a in found}["Vera Wolff"] == home


def test_committee_page_is_preferred():
    both = "The following individuals certify it\nVera Wolff (Supervisor)\nAbstract\nAcknowledgements\nI thank my supervisor Dr. Tilda Ulm." + AFTERWARDS
    assert members(both) == [("Vera Wolff", "Supervisor", None)]
    assert members("") == members("no page") == []


def test_bibliography():
    text = (
        "Contents\nReferences\nChapter one says little.\n12REFERENCES\n\n"
        "31. Abel, Z. (2003). On the growth of mosses in wet\nyears. Journal of Moss, 4(2), 11-19.\n"
        "Bern, Y. (2001). A second entry that follows at once. Moss Press.\n\n"
        "C l a u s, X. (1999). L e t t e r s  far apart. Spaced Press, Upper Town.\n"
        "University of Ferns. A report of several pages upon the state of ferns. 2004.\n"
        "Toronto, ON: Fern House Publishers and Sons, 1998, reprinted in later years.\n\n"
        "77\n\nFigure 3 shows how the ferns and mosses of 1990 stood in the valley near the town.\n\n"
        "Appendix A\nDorn, W. (2005). An entry that comes too late to count. Late Press."
    )
    assert bibliography(text) == [
        "Abel, Z. (2003). On the growth of mosses in wet years. Journal of Moss, 4(2), 11-19.",
        "Bern, Y. (2001). A second entry that follows at once. Moss Press.",
        "Claus, X. (1999). Letters  far apart. Spaced Press, Upper Town.",
        "University of Ferns. A report of several pages upon the state of ferns. 2004. Toronto, ON: Fern House Publishers and Sons, 1998, reprinted in later years.",
    ]
    assert bibliography(None) == bibliography("no heading") == []


@pytest.mark.parametrize(
    ("line", "starts"),
    [("[7] Anything here", True), ("Abel, Zoe. Ferns", True), ("O'Dell-Ray, K. 1990", True), ("University, The", False), ("Toronto, ON: Fern", False), ("B.C.T.F. Bulletin. Teachers", True), ("Canada. Ministry", False), ("March 1980. Teachers", False), ("lower, Case", False), ("Ab, C", False), ("", False)],
)
def test_starts_citation(line, starts):
    assert starts_citation(line) is starts


def test_body_word_count(spark):
    text = "A thesis on ferns.\nReferences to ferns are in the last chapter, and there are very many of them which this line goes on to count.\nIt has few words.\nBIBLIOGRAPHY\nAbel, Z. (2003). Ferns."
    rows = spark.createDataFrame([(text,), ("",), (None,), ("two words",)], "t string")
    assert [r.n for r in rows.select(P.body_word_count(F.col("t")).alias("n")).collect()] == [30, None, None, 2]


def test_junk_citation(spark):
    texts = ["Abel, Zoe. The Book of Ferns. Moss Press, 1999.", "too short", "Retrieved from the pages of the fern society", "https://ferns.example/of/all/kinds/and/more", "Springfield, ON: Fernhouse", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.j for r in rows.select(P.junk_citation(F.col("t")).alias("j")).collect()] == [False, True, True, True, True, True]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Abel, Z. A. (1998). Ferns of the northern coast: a survey. Moss Press.", ("Abel", "Ferns of the northern coast")),
        ("Bern, Y. ( 1 9 9 1 ). (trans. Z. Abel). Letters to Dr. Dorn on ferns. Press.", ("Bern", "Letters to Dr. Dorn on ferns")),
        ("Bern, Yara. “The Fern at Night.” Moss Press, 1958.", ("Bern", "The Fern at Night")),
        ("[12] Claus, Xenia. 1982 The Fern Proposal. Upper Town: Spaced Press.", ("Claus", "The Fern Proposal")),
        ("Claus, Xenia. Ferns without years. Upper Town.", ("Claus", "Ferns without years")),
        ("Proceedings of the meeting on ferns. Upper Town.", (None, "Proceedings of the meeting on ferns")),
        ("Dorn, W. (2001). " + "fern and moss " * 9 + ".", ("Dorn", "fern and moss fern and moss fern and moss fern and moss fern and moss fern and")),
        ("", (None, None)),
        (None, (None, None)),
    ],
)
def test_search_terms(text, found):
    assert search_terms(text) == found


def test_tei(spark):
    person = "<author><persName><forename type='first'>{}</forename><surname>{}</surname></persName></author>"
    whole = (
        "<TEI xmlns='http://www.tei-c.org/ns/1.0'><biblStruct><analytic><title level='a'>On &amp; Off</title>" + person.format("Jo", "Poe") + person.format("Al", "O&apos;Hara") + "<author><persName><forename>No</forename></persName></author></analytic>"
        "<monogr><title level='j'>Journal</title><imprint><biblScope unit='volume'>4</biblScope><biblScope unit='issue'>2</biblScope><biblScope unit='page' from='7' to='9'/><date when='1999-01'/><publisher>Press</publisher></imprint></monogr></biblStruct>"
        "<biblStruct><monogr><title level='m'>A Book of Things</title><author><persName><surname>Lone</surname></persName></author><imprint><date>in 1987</date></imprint></monogr></biblStruct>"
        "<biblStruct><note type='raw_reference'>Only what was printed, 1950.</note></biblStruct>"
        "<biblStruct><monogr><title level='m'>Short</title></monogr></biblStruct>"
        "<biblStruct><monogr><title level='m'>Accessed on a day that is past</title></monogr></biblStruct>"
        "<biblStruct><title level='a'>never closed</biblStruct></TEI>"
    )
    df = spark.createDataFrame([(1, whole, "a"), (2, None, "b"), (3, "", "c"), (4, "<biblStruct", "d")], "id int, xml string, title string").withColumnRenamed("title", "kept")
    got = P.tei_references(df, "xml").collect()
    assert [tuple(r) for r in got] == [
        (1, "a", "Poe, Jo; O'Hara, Al. (1999). On & Off. Journal. 4(2). 7-9. Press", "Poe, Jo; O'Hara, Al", "On & Off", "1999", "Journal"),
        (1, "a", "Lone. (1987). A Book of Things", "Lone", "A Book of Things", "1987", None),
        (1, "a", "Only what was printed, 1950.", None, None, None, None),
    ]


def test_tei_is_parsed_once(spark):
    """Filters on what a reference says do not repeat its parsing below them."""
    df = P.tei_references(spark.createDataFrame([(1, "<biblStruct/>")], "id int, xml string"), "xml")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1


def fetch(start, size, columns, path=None, told="no"):
    """Hits from `start` on, of as many as the file at path says or else 7."""
    n = int(open(path).read()) if path else 7
    hits = [{"_id": str(i), "_source": {"id": f"1.{i}", "title": [f" T{i} "], "creator": "A, B", "dateIssued": "c1999", "extent": ["x", "210 leaves"]}} for i in range(start, min(start + size, n))]
    return {"data": {"hits": {"hits": hits} | ({"total": {"value": n if told == "right" else 100}} if told != "no" else {})}}


@pytest.mark.parametrize("options", [{"total": "7"}, {}, {"arg.told": "right"}, {"arg.told": "wrong"}, {"page_size": "100"}, {"total": "50", "page_size": "1"}])
def test_paged_hits(spark, options):
    """However the total is known, or if it is not: each hit once, in pages of the size asked for."""
    spark.dataSource.register(H.PagedHits)
    pages = spark.read.format("paged_hits").options(**{"fetch": "tests.test_parsers:fetch", "page_size": "3"} | options).load()
    assert pages.rdd.getNumPartitions() == {"1": 7, "100": 1}.get(options.get("page_size"), 3)
    got = H.records(H.hits(pages)).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [f"1.{i}" for i in range(7)]
    assert (got[0].title, got[0].author, got[0].year, got[0].page_count, got[0].page_source, got[0].affiliation) == ("T0", "A, B", 1999, 210, "metadata_extent", [])


@pytest.mark.parametrize(("options", "n"), [({"limit": "5"}, 5), ({"limit": "50"}, 7), ({"limit": "0"}, 0), ({"total": "0"}, 0)])
def test_limits(spark, options, n):
    spark.dataSource.register(H.PagedHits)
    pages = spark.read.format("paged_hits").options(**{"fetch": "tests.test_parsers:fetch", "page_size": "3"} | options).load()
    assert H.hits(pages).count() == n


def test_hits_as_a_stream(spark, tmp_path):
    """Hits that are added come in later batches; a run that starts in the middle goes on where the last ended, and a batch that failed comes again."""
    spark.dataSource.register(H.PagedHits)
    size = tmp_path / "n"

    def run(n, fail=False):
        size.write_text(str(n))
        stream = spark.readStream.format("paged_hits").options(**{"fetch": "tests.test_parsers:fetch", "page_size": "4", "arg.path": str(size)}).load()

        def write(batch, epoch):
            H.hits(batch).write.mode("overwrite").parquet(f"{tmp_path}/out/e={epoch}")
            if fail:
                raise RuntimeError("stopped")

        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(int(r.hit_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run(6) == list(range(6))
    with pytest.raises(Exception, match="stopped"):
        run(11, fail=True)
    assert run(13) == list(range(13))
    assert run(13) == list(range(13))


def test_record_fields(spark):
    rows = [
        '{"identifier": "x", "Title": " A  b ", "name": "no", "creator": [], "author": "Z", "supervisor": ["Dr. Ann Lee", ["Lee, Ann"]], "issued": 1987, "body": "one two", "keywords": [["k1"], "k2", ""], "uri": "https://a.org/items/2.17?x", "rights": 0, "degree": ["M", "D"]}',
        '{"_id": "1.5", "date": ["2001", "x"]}',
        '{"title": "T", "creator": {"a": 1}, "doi": "see https://b.org/pdf/9/3.25 there", "extent": "12 p."}',
        "no json",
    ]
    got = H.records(spark.createDataFrame([(r, None) for r in rows], "record string, hit_id string"), items="https://c.org/items/").collect()
    a, b, c, d = got
    assert len(H.records(spark.createDataFrame([(rows[0], None)], "record string, hit_id string")).columns) == 35
    assert (a.doc_id, a.title, a.authors, a.author, a.supervisors, a.supervisors_source, a.year, a.date) == ("2.17", "A b", [], "Unknown", ["Ann Lee"], "api", 1987, "1987")
    assert (a.subjects, a.word_count, a.char_count, a.rights, a.degree, a.page_count) == (["k1", "k2"], 2, 7, "", "M; D", 1)
    assert a.download_candidates == ["https://a.org/items/2.17?x", "https://c.org/items/x"] and a.download_status == "not_attempted"
    assert (b.doc_id, b.year, b.subjects, b.supervisors_source) == ("1.5", 2001, ["(Unspecified)"], None) and b.download_candidates == ["https://c.org/items/1.5"]
    assert (c.doc_id, c.authors, c.page_count, c.page_source) == ("3.25", ['{"a":1}'], 12, "metadata_extent")
    assert (d.doc_id, d.title, d.authors, d.word_count) == (":", "", [], 0)
    made = spark.range(3).selectExpr("""concat('{"id": ', id, '}') AS record""", "NULL AS hit_id")
    plan = H.records(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 1


def test_concepts_of_records(spark):
    known = spark.createDataFrame([("online learning", ["e learning"], 2, 1.5)], "canonical string, variants array<string>, doc_freq long, idf double")
    rows = spark.createDataFrame([('{"_id": "1.1", "title": "Online learning at school", "abstract": "e learning"}', None), ('{"_id": "1.2", "title": "None"}', None)], "record string, hit_id string")
    got = {r.doc_id: r.concept_terms for r in H.records(rows, dictionary=known, n_docs=9).collect()}
    assert got == {"1.1": ["online learning"], "1.2": []}


def test_hits_elsewhere(spark):
    rows = spark.createDataFrame([('{"results": [{"doc": {"id": "x"}}, {"id": "y"}]}',), ("not json",), (None,)], "payload string")
    assert sorted(r.record for r in H.hits(rows).collect()) == ['{"id":"x"}', '{"id":"y"}']


def test_records_open_each_record_once(spark):
    """Fields come out of one map of the record, not by a look-up of each name in the variant; long texts end at their counts."""
    found = spark.createDataFrame([('{"id": "1", "Title": "A  b", "full_text": " one \\n two\\u00a0three ", "subject": null, "keywords": ["k"]}', None), ("[1]", None)], "record string, hit_id string")
    out = H.records(found)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get") + plan.count("variantget") < 150
    rows = {r.title: r for r in out.collect()}
    assert (rows["A b"].word_count, rows["A b"].char_count, rows["A b"].subjects) == (3, 13, ["k"])
    assert (rows[""].word_count, rows[""].char_count, rows[""].author) == (0, 0, "Unknown")
