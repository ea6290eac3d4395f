import json

from canopy.schema import WORK, WORK_COLUMNS
from canopy.sources import export as X


def work(**values):
    return {c: None for c in WORK_COLUMNS} | values


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r[c] for c in WORK_COLUMNS) for r in rows], WORK)


def test_simple_markdown():
    head, tail = "# Moss on Roofs\n", "\n**keywords**: A, B\n\n## Abstract\n\nWe count moss.\n"
    base = work(title="Moss on Roofs", label="L", keywords=["A", "B"], abstract="We count moss.")
    link = "**link**: [{0}]({0})\n"
    assert X.markdown_simple(base | {"permalink": "https://roofs.example/moss"}) == head + link.format("https://roofs.example/moss") + tail
    assert X.markdown_simple(base | {"doi": "10.5555/moss7"}) == head + link.format("https://doi.org/10.5555/moss7") + tail
    assert X.markdown_simple(base) == head + tail


def test_reference():
    w = work(label="L", rich=True, authors=["Vale, Q."], title="Lichen Atlas", venue="Roof Letters", year=2024, doi="10.5555/lichen")
    assert X.reference(w) == 'Vale, Q., "Lichen Atlas", *Roof Letters*, 2024. doi: 10.5555/lichen.'
    assert X.reference(w | {"doi": None}).endswith(", 2024.") and X.reference(w | {"rich": False}) == "L"


def test_markdown_with_references(spark):
    works = frame(spark, work(label="W1", title="Moss: Roofs", abstract="x", ids=["k1"], rich=False)).selectExpr("'k1' as id", "*")
    refs = frame(spark, work(label="W2", title="Older Moss", authors=["Orr, Lin"], rich=True), work(label="W3", rich=False)).selectExpr("'k1' as source", "*")
    text = X.render(works, "markdown", refs)
    assert text.startswith('---\ntitle: "Moss: Roofs"\nrich: false\n---\n\n# Moss: Roofs') and "## References\n\nOrr, Lin" in text and "W3" not in text and text.endswith(X.SEPARATOR)


def test_bibtex_fields_and_order(spark):
    w = work(label="L", ids=["openalex:W1"], authors=["Orr, Lin", "Ude, P"], title="50% of A", venue="J & K", venue_type="journal", year=2024, volume="7", issue="2-3", page="1-9", doi="10.1/x", keywords=["a_b"], abstract="two\n lines", rich=True)
    text, infos = X.to_bibtex(frame(spark, w))
    assert text == (
        "@article{orr2024,\n    author   = {Orr, Lin and Ude, P},\n    title    = {50\\% of A},\n    journal  = {J \\& K},\n    year     = 2024,\n    volume   = 7,\n    number   = {2-3},\n    pages    = {1--9},\n"
        "    doi      = {10.1/x},\n    url      = {https://doi.org/10.1/x},\n    keywords = {a\\_b},\n    abstract = {two lines},\n}\n"
    )
    assert infos == [{"id": "openalex:W1", "citekey": "orr2024", "title": "50% of A", "year": 2024, "first_author": "Orr, Lin"}]
    assert "abstract" not in X.to_bibtex(frame(spark, w), abstracts=False)[0]
    hosted = X.to_bibtex(frame(spark, w | {"venue_type": "repository"}))[0]
    assert "@misc" in hosted and "howpublished = {J \\& K}" in hosted and X.S.REPOSITORY_NOTE in hosted


def test_cite_keys_are_told_apart():
    keys = X.cite_keys(["orr2024"] * 29)
    assert keys[:3] == ["orr2024", "orr2024a", "orr2024b"] and keys[26:] == ["orr2024z", "orr2024aa", "orr2024ab"]
    assert X.cite_keys(["a", "aa", "a", "a"]) == ["a", "aa", "ab", "ac"] and X.cite_keys(["aa", "a", "a"]) == ["aa", "a", "ab"]


def test_json_and_filenames(spark, tmp_path):
    works = frame(spark, work(label="L", ids=["k"], title="A b"))
    assert json.loads(X.render(works, "json"))[0]["title"] == "A b" and X.render(works, "filename").startswith("a-b-")
    X.write_json(works, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["title"] == "A b"
