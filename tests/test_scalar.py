import math

import pytest
from pyspark.sql import functions as F

from canopy.functions import scalar as S
from canopy.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def text(spark, function, *values):
    return one(spark, function(*[F.col(f"c{i}") for i in range(len(values))]), **{f"c{i}": ("string", v) for i, v in enumerate(values)})


@pytest.mark.parametrize("doi, want", [(" https://doi.org/10.1/A ", "10.1/A"), ("HTTP://DX.DOI.ORG/10.1/b", "10.1/b"), ("DOI:10.1/c", "10.1/c"), ("doi:doi:x", "doi:x"), ("10.1/d", "10.1/d"), ("", ""), (None, None)])
def test_extract_doi(spark, doi, want):
    assert text(spark, S.extract_doi, doi) == want


@pytest.mark.parametrize("name, want", [("Ada M Lovelace", "Lovelace, Ada M"), ("Lovelace, Ada", "Lovelace, Ada"), ("  Plato ", "Plato"), ("A  B", "B, A"), ("", ""), (None, None)])
def test_invert_name(spark, name, want):
    assert text(spark, S.invert_name, name) == want


@pytest.mark.parametrize("first, last, want", [("107", "113", "107-113"), ("107", None, "107"), ("42", "42", "42"), ("107", "", "107"), (None, None, None), (None, "113", None), ("", "5", None)])
def test_page_range(spark, first, last, want):
    assert text(spark, S.page_range, first, last) == want


@pytest.mark.parametrize("index, want", [({"a": [0, 2], "b": [1]}, "a b a"), ({"a": [0], "b": [3]}, "a   b"), ({}, ""), (None, "")])
def test_invert_abstract(spark, index, want):
    assert one(spark, S.invert_abstract(F.col("m")), m=("map<string, array<int>>", index)) == want


SOURCE = "struct<display_name: string, type: string>"


@pytest.mark.parametrize(
    "primary, locations, want",
    [
        (("Journal A", "journal"), [], "Journal A"),
        (("Repo", "repository"), [("Repo", "repository"), ("Conf", "conference")], "Conf"),
        (("Repo", "repository"), [("Books", "ebook platform")], "Repo"),
        (None, [("Journal B", "journal")], "Journal B"),
        (None, [], None),
        (("Odd", ""), [("Journal B", "journal")], "Odd"),
    ],
)
def test_venue_source(spark, primary, locations, want):
    got = one(spark, S.venue_source(F.col("p"), F.col("l"))["display_name"], p=(f"struct<source: {SOURCE}>", (primary,)), l=(f"array<struct<source: {SOURCE}>>", [(x,) for x in locations]))
    assert got == want


def test_first_institution(spark):
    kind = "array<struct<institutions: array<struct<display_name: string>>>>"
    assert one(spark, S.first_institution(F.col("a")), a=(kind, [(None,), ([("",)],), ([("X",), ("Y",)],)])) == "X"
    assert one(spark, S.first_institution(F.col("a")), a=(kind, [])) is None


@pytest.mark.parametrize("raw, want", [("50% of A&B_C#", r"50\% of A\&B\_C\#"), (r"a\%b", r"a\%b"), (r"a\\%b", r"a\\\%b"), (r"a\\\%b", r"a\\\%b"), ("", ""), ("plain", "plain")])
def test_sanitize_latex(spark, raw, want):
    assert text(spark, S.sanitize_latex, raw) == want


@pytest.mark.parametrize("score, top, want", [(0, 100, 0), (-5, 100, 0), (10, 0, 0), (10, -1, 0), (100, 100, 1), (150, 100, 1), (1, 1, 1), (100, 10000, math.log1p(100) / math.log1p(10000))])
def test_normalize_score(spark, score, top, want):
    got = one(spark, S.normalize_score(F.col("s"), F.col("t")), s=("double", float(score)), t=("double", float(top)))
    assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("a, b, want", [("A1", "AAAAA2", "AAAAA2"), ("A1", "A2", "A1"), (None, "x", "x"), ("é", "ab", "ab")])
def test_keep_longest(spark, a, b, want):
    assert text(spark, S.keep_longest, a, b) == want


@pytest.mark.parametrize(
    "kind, venue, place, want",
    [
        ("conference-paper", None, None, "inproceedings"), ("article", "C", "conference", "inproceedings"), ("book", None, None, "book"), ("report", "R", "repository", "techreport"), ("book-chapter", "B", "book series", "incollection"),
        ("dissertation", None, "repository", "phdthesis"), ("article", "arXiv", "repository", "misc"), ("article", "Nature", "journal", "article"), (None, "Nature", None, "article"), (None, None, None, "misc"), ("article", "E", "ebook platform", "misc"),
    ],
)
def test_bib_entry_type(spark, kind, venue, place, want):
    assert text(spark, S.bib_entry_type, kind, venue, place) == want


@pytest.mark.parametrize(
    "authors, year, doi, ids, label, want",
    [
        (["Vaswani, Ashish"], 2017, None, ["x:1"], "L", "vaswani2017"), (["Müller-Lüdenscheidt, A"], 2001, None, [], "L", "muller-ludenscheidt2001"), ([], 2017, "https://doi.org/10.1/X.y", [], "L", "doi_10_1_x_y"),
        (None, None, None, ["openalex:https://openalex.org/W9"], "L", "w9"), (None, None, "", ["mag:77"], "L", "mag_77"), (None, None, None, None, "My Label!", "my_label"), (None, None, None, None, "", "article"), (None, None, None, None, "!!", "article"),
    ],
)
def test_citation_key(spark, authors, year, doi, ids, label, want):
    columns = {"a": ("array<string>", authors), "y": ("int", year), "d": ("string", doi), "i": ("array<string>", ids), "l": ("string", label)}
    assert one(spark, S.citation_key(*map(F.col, columns)), **columns) == want


def test_key_suffix():
    assert [S.key_suffix(n) for n in (0, 1, 26, 27, 28, 702, 703)] == ["", "a", "z", "aa", "ab", "zz", "aaa"]


def test_wrap_text():
    assert S.wrap_text("aa bb cc", 5) == "aa bb\ncc" and S.wrap_text("", 5) == "" and S.wrap_text("toolongword x", 4) == "toolongword\nx"


@pytest.mark.parametrize("title, label, start", [("A Study: of *Graphs*", "L", "a-study-of-graphs-"), (None, "My_Label", "my-label-"), ("", "", "article-"), ("!!!", "L", "article-"), ("x" * 80, "L", "x" * 60 + "-")])
def test_filename(spark, title, label, start):
    got = text(spark, S.filename, "id1", title, label)
    assert got.startswith(start) and got.endswith(".md") and len(got) == len(start) + 8 + 3


def test_simple_label_id_and_permalink(spark):
    columns = {"a": ("array<string>", ["Doe, Jane"]), "y": ("int", 2020), "v": ("string", "Nature"), "o": ("string", "7"), "p": ("string", None), "d": ("string", "10.1/x")}
    assert one(spark, S.simple_label(*map(F.col, "ayvopd")), **columns) == "Doe Jane, 2020, Nature, V7, DOI 10.1/x"
    assert one(spark, S.simple_id(F.col("a"), F.col("y")), **columns) == "doe2020"
    assert text(spark, S.permalink, "", "10.1/x") == "https://doi.org/10.1/x" and text(spark, S.permalink, "u", "d") == "u" and text(spark, S.permalink, None, "") is None


def test_query_identity(spark):
    from canopy.plans.engine import fingerprint, normal_query

    for q in ("QuAnTuM CoMpUtInG", "\tquantum\n  computing "):
        assert text(spark, S.normalize_query, q) == "quantum computing" == normal_query(q)
    assert text(spark, S.normalize_query, "   ") == ""
    for q in ('a "b" & <c>', "quantum computing", "naïve café"):
        assert one(spark, S.query_fingerprint(F.col("q"), F.lit(100)), q=("string", q)) == fingerprint(q, 100)
    assert len({fingerprint("a", 1), fingerprint("a", 2), fingerprint("b", 1), fingerprint("a", 1, 2)}) == 4


def test_display_query(spark):
    assert text(spark, S.display_query, "x" * 40) == "x" * 40 and text(spark, S.display_query, "x" * 41) == "x" * 37 + "..."


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("networks", "network"), ("at", "at")])
def test_porter(word, want):
    assert X.stem(word) == want


def test_query_phrases():
    assert X.query_phrases('"Citation networks" tree-of-science  ', stemmed=False) == [["citation"], ["networks"], ["tree", "of", "science"]]
    assert X.query_phrases(' " -- ') == []
