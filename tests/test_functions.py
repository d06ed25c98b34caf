"""Examples for scalar functions."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.functions import citations, names, similarity, text
from corvella.operators import citations as C
from corvella.operators import labels, merge, phrases, topics


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("a", "b", "low", "high"),
    [
        ("hello", "hello", 1, 1),
        ("smith, j (1998) educational leadership", "smith, j. (1998). educational leadership.", 0.9, 1),
        ("dewey, j. (1938). experience and education. macmillan.", "dewey, j (1938) experience and education macmillan", 0.9, 1),
        ("freire, p. (1970). pedagogy of the oppressed.", "freire, p. (1970). pedagogy of the oppresed.", 0.9, 1),
        ("smith, j. (1998). educational leadership.", "jones, a. (2002). teacher resilience.", 0, 0.8999),
        ("freire, p. (1970). pedagogy of the oppressed.", "dewey, j. (1938). experience and education.", 0, 0.8999),
        ("", "anything", 0, 0),
        (None, "anything", 0, 0),
        ("abcdefgh", "bcadefgh", 0.9375, 0.9375),
        ("abxxxxxx", "abyyyyyy", 0.6, 0.6),
    ],
)
def test_jaro_winkler(a, b, low, high):
    assert low - 1e-12 <= similarity.jaro_winkler(a, b) <= high + 1e-12


def test_similar_texts_are_those_of_the_slow_version():
    """One text with many at once, over all bounds, against one by one."""
    rng = random.Random(5)
    some = lambda k: "".join(rng.choices("abcd é\U0001f600", k=k))
    base = [some(rng.randint(0, 40)) for _ in range(40)]
    texts = base + ["".join(c for c in t if rng.random() > 0.1) for t in base] + [t[:5] + "".join(rng.sample(t[5:], len(t[5:]))) for t in base if len(t) > 5] + ["", "a"]
    table = similarity.TextTable(texts)
    for least in (0.0001, 0.7, 0.9, 1.0):
        for i, t in enumerate(texts):
            at, score = similarity.similar(table, i, table, least)
            want = {j: s for j, x in enumerate(texts) if (s := similarity.jaro_winkler(t, x)) >= least - 1e-12}
            assert dict(zip(at.tolist(), score.tolist())) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("word", "stem"), [("policies", "policy"), ("students", "student"), ("studies", "study"), ("class", "class"), ("leadership", "leadership")])
def test_stem(spark, word, stem):
    assert one(spark, text.plain_stem(F.col("w")), w=word) == stem


@pytest.mark.parametrize(
    ("a", "b", "low", "high"),
    [("educational leadership", "educational leadership", 1.2, 1.2), ("educational leader", "educational leadership", 0.7, 2), ("educational practices", "educational practitioners", 1 / 3, 1 / 3)],
)
def test_phrase_similarity(spark, a, b, low, high):
    found = one(spark, text.phrase_similarity(F.split("a", " "), F.split("b", " ")), a=a, b=b)
    assert low - 1e-9 <= found <= high + 1e-9


def test_names(spark):
    assert one(spark, names.ascii_key(names.person_name(F.col("n"))), n="Thomas J. Sork") == "thomas j sork"
    assert not names.compatible("thomas j sork", "thomas b sork")
    assert names.compatible("thomas j sork", "thomas sork")
    assert set(names.merge_names(["John Smith", "John J. Smith", "John B. Smith"])) == {"John J. Smith", "John B. Smith"}
    assert set(names.merge_names(["Deirdre M. Kelly", "Tom Sork"])) == {"Deirdre Kelly", "Tom Sork"}


@pytest.mark.parametrize(
    ("raw", "name"),
    [("Smith, John", "John Smith"), ("Dr. Anna Bell (UBC)", "Anna Bell"), ("supervisory committee", None), ("n/a", None), ("  ", None), ("Ellis, Jason, 1981-", "Jason Ellis"), ("__Mary_Poole__", "Mary Poole"), ("123", None), ("Supplier 000", "Supplier 000")],
)
def test_person_name(spark, raw, name):
    assert one(spark, names.person_name(F.col("n")), n=raw) == name


def test_affiliation(spark):
    assert one(spark, names.affiliation(F.col("a")), a=" The University of  British Columbia, simon fraser university") == "The University of British Columbia, SFU"
    assert one(spark, names.affiliation(F.col("a")), a="The University of British Columbia") == "UBC"


def test_years_and_pages(spark):
    assert one(spark, text.year_in(F.col("s")), s="c1998-2001") == 1998
    assert one(spark, text.year_in(F.col("s")), s="no year") is None
    assert one(spark, text.page_count(F.array("a", "b")), a="ill.", b="xii, 210 leaves") == 210
    assert one(spark, text.page_count(F.array("a")), a="none") is None


def test_tokens_and_phrases(spark):
    assert one(spark, text.tokens(F.col("s")), s="The Study of well-being in 2nd-grade Schools; Café") == ["well-being", "schools"]
    words = phrases.split_words(F.col("s"))
    found = one(spark, text.ngrams(words, 2), s="professional learning of three schools and better policy")
    assert found == ["professional learning"]


def test_canonical_text():
    assert text.canonical_text("Post-Secondary Education & e-learning at École UBC") == "higher education online learning at ecole university of british columbia"
    assert text.canonical_text(None) == ""


def test_methodologies(spark):
    found = one(spark, text.methodologies(F.col("s")), s="A case study with interviews, not a survey but qualitative")
    assert found == ["Case Study", "Interviews"]


def test_citation_hash(spark):
    same = ["The Human Condition. Cambridge, Mass.: Harvard", "Human Condition. cambridge, MA: Harvard."]
    assert one(spark, citations.citation_hash(F.col("c")), c=same[0]) == one(spark, citations.citation_hash(F.col("c")), c=same[1])
    assert one(spark, similarity.citation_year(F.col("c")), c="Smith (1998), 12345") == 1998


def test_pqf(spark):
    assert one(spark, citations.pqf_value(F.col("c")), c='a "b"\n\\c') == "a b c"


def test_fuzzy_resolution(spark):
    known = spark.createDataFrame([(1, "Smith, John. 2020. Educational Leadership in Canada.")], "id long, text string")
    new = spark.createDataFrame([(2, "Smith, Jon. 2020. Educational Leadership in Canada."), (3, "Nguyen, A. 2021. Community Schools and Care.")], "id long, text string")
    assert [(r.id_new, r.id_known) for r in C.best_matches(new, known).collect()] == [(2, 1)]


def fuzzy_slow(rows):
    """(best match of each, canonical of each) by comparing every pair of one block; rows are (id, text, n)."""
    year = lambda t: next((int(m[0]) for m in re.finditer(r"\b(?:1[89]\d{2}|20[0-2]\d)\b", t)), None)
    prefix = lambda t: t.strip().lower()[:3] if len(t.strip()) >= 3 else None

    def meet(new, known):
        y = year(known)
        return abs(year(new) - y) <= 1 if y and year(new) else not y and prefix(known) is not None and prefix(new) == prefix(known)

    score = lambda a, b: similarity.jaro_winkler(a.lower(), b.lower()) if a.lower() == b.lower() or meet(a, b) else 0
    best, canonical = {}, {}
    for i, t, _ in rows:
        found = max(((round(score(t, x), 9), -j) for j, x, _ in rows if j != i), default=(0, 0))
        if found[0] >= 0.9:
            best[i] = -found[1]
    heads = []
    for i, t, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        canonical[i] = next((j for j, x in heads if score(t, x) >= 0.9), i)
        if canonical[i] == i:
            heads.append((i, t))
    return best, canonical


@pytest.mark.parametrize("tile", [1024, 5])
def test_fuzzy_matches_and_clusters_equal_brute_force(spark, monkeypatch, tile):
    """Typing errors, equal texts in other letters, years beside each other and none, texts too short for a block."""
    monkeypatch.setattr(C, "TILE", tile)
    rng = random.Random(9)
    words = "fern moss lichen stone river valley school garden letter winter".split()
    texts = []
    for _ in range(25):
        base = f"{rng.choice(['Abel', 'Bern', 'Claus'])}, {rng.choice('XYZ')}. {' '.join(rng.sample(words, 4))}"
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(base))
            texts.append(base[:at] + rng.choice(["", "q", "zz"]) + base[at + 1 :] + rng.choice(["", " 1990", " 1991", " 1993", ". 1990"]))
    texts += [texts[3], texts[3].upper(), texts[7].lower(), "ab", "ab", "", " x 1990"]
    rows = [(i * 3 + 1, t, rng.randint(0, 3)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string").repartition(3)
    counts = spark.createDataFrame([(i, n) for i, _, n in rows if n], "citation_id long, n long")
    best, canonical = fuzzy_slow(rows)
    assert {r.id_new: r.id_known for r in C.best_matches(frame, frame).collect()} == best
    assert {r.id: r.canonical for r in C.cluster_first(frame, counts).collect()} == canonical
    assert len(best) > 20 and len(set(canonical.values())) < len(rows) - 20


def mutated(rng, text):
    """A text with up to six characters dropped, added or exchanged."""
    out = list(text)
    for _ in range(rng.randint(0, 6)):
        x = rng.randrange(len(out) + 1)
        if rng.random() < 0.4 and len(out) > 1:
            out.pop(min(x, len(out) - 1))
        elif rng.random() < 0.5:
            out.insert(x, rng.choice("abcdé漢 "))
        elif len(out) > 1:
            y, z = rng.randrange(len(out)), rng.randrange(len(out))
            out[y], out[z] = out[z], out[y]
    return "".join(out)


def tile_similar(new, known, least):
    a, b = similarity.TextTable(new), similarity.TextTable(known)
    found = similarity.similar_pairs(a, b, least, lambda i, j: np.ones(len(i), dtype=bool))
    return {(x, y): round(z, 9) for i, j, s in found for x, y, z in zip(i.tolist(), j.tolist(), s.tolist(), strict=True)}


@pytest.mark.parametrize("longest", [1, 3, 40, 64, 65, 130, 300, 700])
@pytest.mark.parametrize("least", [0.9, 0.75])
def test_tiles_equal_the_plain_similarity(longest, least, monkeypatch):
    """Texts of one word of bits, of several, and beyond; empty ones; portions of few pairs."""
    rng = random.Random(longest)
    base = ["".join(rng.choice("abcdefgh ij") for _ in range(rng.randint(1, longest))) for _ in range(12)]
    new = [mutated(rng, rng.choice(base)) for _ in range(40)] + [""]
    known = [mutated(rng, rng.choice(base)) for _ in range(45)] + ["", base[0]]
    slow = {(x, y): round(s, 9) for x, a in enumerate(new) for y, b in enumerate(known) if (s := similarity.jaro_winkler(a, b)) >= least}
    assert slow and tile_similar(new, known, least) == slow
    monkeypatch.setattr(similarity, "BYTES", 4096)
    assert tile_similar(new, known, least) == slow
    assert tile_similar(new, [], least) == tile_similar([], known, least) == tile_similar([""], [""], least) == {}


def test_a_text_of_a_million_characters_costs_no_matrix():
    texts = [f"smith, j. {i} educational leadership" for i in range(200)] + ["ab" * 500_000, "ab" * 499_990 + "cd" * 10]
    tracemalloc.start()
    found = tile_similar(texts, texts, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (200, 201) in found and (200, 0) not in found
    assert peak < 200e6


def test_best_match_is_that_of_all_tiles(spark, monkeypatch):
    """Tiles bounded by characters, and a best match that stands in another tile and portion than the second best."""
    monkeypatch.setattr(C, "CHARACTERS", 100)
    known = spark.createDataFrame([(i, f"smith, john 2020 leadership in schools {i}") for i in range(30)], "id long, text string")
    new = spark.createDataFrame([(100, "smith, john 2020 leadership in schools 17x")], "id long, text string")
    assert [(r.id_new, r.id_known) for r in C.best_matches(new, known).collect()] == [(100, 17)]


def test_clusters_follow_the_order(spark):
    texts = spark.createDataFrame([(1, "abcdefghij 1999 x"), (2, "abcdefghij 1999 y"), (3, "zzzz qqqq 1950 long other")], "id long, text string")
    counts = spark.createDataFrame([(1, 1), (2, 5), (3, 1)], "citation_id long, n long")
    assert {(r.id, r.canonical) for r in C.cluster_first(texts, counts).collect()} == {(1, 2), (2, 2), (3, 3)}


@pytest.mark.parametrize(("mode", "kept"), [("import_all", {"cached-1", "new-1", "cached-2"}), ("sync_differences", {"new-1"}), ("refresh_metadata", {"cached-1", "cached-2"}), ("sync_missing_pdfs", {"cached-1", "new-1", "cached-2"})])
def test_sync_modes(spark, mode, kept):
    rows = spark.createDataFrame([(x,) for x in ("cached-1", "new-1", "cached-2")], "id string")
    stored = rows.filter("id like 'cached%'")
    assert {r.id for r in merge.sync_rows(rows, stored, "id", mode).collect()} == kept


def test_phrase_quality_bounds(spark):
    rows = spark.createDataFrame([("community schools", 10)], "phrase string, doc_freq long")
    assert 8 < phrases.phrase_quality(rows).first()["quality"] <= 10
    judged = spark.createDataFrame([("community schools", 12, 0.2), ("school development", 2, 0.1)], "phrase string, doc_freq long, quality double").select("phrase", phrases.keep_phrase().alias("k"))
    assert {r.phrase: r.k for r in judged.collect()} == {"community schools": True, "school development": False}


@pytest.mark.parametrize(("label", "bag"), [("Student Achievement, Assessment, and Classroom Factors", False), ("achievement, mathematics, reading, variables", True), ("Achievement Mathematics Reading Variables", True), ("arts / music", True), ("", True)])
def test_keyword_bag(spark, label, bag):
    assert one(spark, labels.keyword_bag(F.col("l")), l=label) is bag


def test_hierarchy():
    merges = topics.ward_linkage([[0.0], [0.1], [5.0], [5.1]], [1, 1, 1, 1])
    assert topics.cut_hierarchy([10, 11, 12, 13], merges, 2) == {10: 0, 11: 0, 12: 1, 13: 1}
    assert topics.cut_hierarchy([10, 11], merges[:1], 10) == {10: 0, 11: 1}


def test_label_that_overfits(spark):
    label = "Same-Sex Social Support and Well-Being Enhancement"
    titles = [
        ("Submissiveness : a re-conceptualized view", "Trait submissiveness and counselling psychology."),
        ("Women's and men's networks in the workplace", "Gendered workplace networks and homosociality."),
        ("Parental involvement in career development of children", "Family cohesion and adolescent career maturity."),
        ("Same-sex social support and the enhancement of well-being", "Same-sex bonding, cross-sex bonding, social relations, and well-being."),
        ("Differentiation and enmeshment", "Family theory validation using Q-methodology."),
    ]
    documents = spark.createDataFrame([(37, t, a) for t, a in titles], "topic_id int, title string, abstract string")
    rows = spark.createDataFrame([(37, label, 5)], "topic_id int, label string, doc_count int")
    assert labels.evidence_warnings(rows, documents).first()["warnings"] == ["small_topic_review", "low_label_coverage", "overfits_single_document"]


def test_label_scores_and_choice(spark):
    given = [(1, "Topic 1: Teacher Identity and Practice.", 1), (2, "teacher identity and practice", 2), (2, "Learning in Online Schools", 3), (3, "research topic", 4)]
    candidates = spark.createDataFrame(given, "topic_id int, label string, created int")
    fallbacks = spark.createDataFrame([(1, "1_a_b"), (2, "2_c_d"), (3, "3_e_f"), (-1, "-1_x")], "topic_id int, label string")
    got = labels.scored(candidates, fallbacks)
    assert {(r.topic_id, r.label, r.score, tuple(r.warnings)) for r in got.collect()} == {
        (1, "Teacher Identity and Practice", 100, ()),
        (2, "teacher identity and practice", 40, ("duplicate",)),
        (2, "Learning in Online Schools", 100, ()),
        (3, None, 0, ("empty_or_generic",)),
    }
    overrides = spark.createDataFrame([(1, "Mine")], "topic_id int, label string")
    previous = spark.createDataFrame([(3, "Label: Older Name"), (2, "x")], "topic_id int, label string")
    chosen = labels.choose(fallbacks, overrides, got, previous)
    assert {tuple(r) for r in chosen.collect()} == {(1, "Mine", "override"), (2, "Learning in Online Schools", "candidate"), (3, "Older Name", "previous"), (-1, "Uncategorized", "outlier")}
