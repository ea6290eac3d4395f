import random

import pytest

from canopy.llm import truncation as T

FULL = "The citation network grew by half since 1990. Leaves cite earlier works."
WHOLE = [
    FULL, FULL + '"', "Is it so? (in press)", "Done. © 2013 The Authors", "Done.\n\nReceived 3 May 2015", "Done.\n— Curated by the Somikizic group", "See this. https://doi.example/10.5555/1234567", "@book{a1999,\n  title = {On {B}ears},\n}", "[1] A, B. (1990). T. doi:10.1/rl.1234567\n[2] C, D. (1991). U. doi:10.1/rl.7654321",
    "Done. Keywords: open archive; leaf node", "---\ncategory: leaf\n---\nDone.\n\n## Keywords\n\n- leaf node\n- open archive", "本文分析了数据。", "The list could go on and on...", "Growth was small (p = 0.20).", "“Trees remember.”", FULL + " \n\t",
]
CUT = [
    "The citation network gr", "The citation network grew by", "Growth was observed (p = 0.", "@book{a1999,\n  title = {On Bears},\n  abstract = {All is said.", "[1] A, B. (1990). T. doi:10.1/rl.1234567\n[2] C, D. (1991). Ma", "[1] A, B. (1990). T. doi:10.1/rl.1234567\n[2] C, D. (1991). U. doi:10.1/rl.76",
    "Done. Keywords: open archive; lea", "Done.\n\n## Keywords\n\n- open archive\n- leaf no", "Done. © 2010 The", "Done.\n— Curated by the Somi", "本文分析了数", "Following Razakozar et al.", "Roots: A 1990; B 2", "Conclusions", "Trailing comma,", "```python\nprint(1)",
]


def flagged(spark, rows):
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "doc_id long, source string, text string, kind string")
    return {r["doc_id"] for r in T.flag_truncated(df).where("truncated").collect()}


def test_ends(spark):
    context = [("c", "Index terms: leaf node; open archive; leaf node; isotope ratio")]
    rows = [("a", t) for t in WHOLE] + [("a", t) for t in CUT] + context
    got = flagged(spark, rows)
    assert [t for i, (_, t) in enumerate(rows) if i < len(WHOLE) and i in got] == []
    assert [t for i, (_, t) in enumerate(rows) if len(WHOLE) <= i < len(WHOLE) + len(CUT) and i not in got] == []


def test_null_empty_blank_and_long(spark):
    rows = [("a", None), ("a", ""), ("a", " \n​"), (None, FULL), ("a", "word " * 40_000), ("a", "word " * 40_000 + "end.")]
    assert flagged(spark, rows) == {4}
    assert flagged(spark, []) == set()


@pytest.mark.parametrize("bytes_", [False, True])
def test_marks_and_lists_count_at_a_limit_only(spark, bytes_):
    rng = random.Random(1)
    words = ["größe" if bytes_ else "grown", "network", "leaf", "archive", "über" if bytes_ else "over"]
    rows = []
    for _ in range(200):
        text = " ".join(rng.choices(words, k=rng.randrange(20, 80))) + "."
        rows.append(("limited", text.encode()[:297].decode(errors="ignore") + "..." if bytes_ and len(text.encode()) > 300 else text if bytes_ else text[:297] + "..." if len(text) > 300 else text))
    rows += [("limited", "The list could go on and on..."), ("Limited ", "Keywords: leaf node; open archive"), ("free", "Keywords: open archive; leaf node")]
    got = flagged(spark, rows)
    cut = {i for i, (_, t) in enumerate(rows[:200]) if t.endswith("...")}
    assert len(cut) > 50 and got == cut


def test_rates(spark):
    df = spark.createDataFrame([(1, " A", "Cut off her"), (2, "a", FULL), (3, None, FULL), (4, "a", None)], "doc_id long, source string, text string")
    got = {r["source"]: (r["documents"], r["truncated"], r["rate"]) for r in T.truncation_rates(T.flag_truncated(df)).collect()}
    assert got == {"a": (2, 1, 0.5), "": (1, 0, 0.0)}


def test_marks_in_brackets_count_at_any_length(spark):
    marks = ["[...]", "[…]", "[truncated]", "(truncated)", "(more)", "(...)"]
    rows = [("a", "The network grew " * (i + 1) + m) for i, m in enumerate(marks)] + [("a", "The list could go on and on...")]
    assert flagged(spark, rows) == set(range(len(marks)))


def test_addresses_and_single_dois_are_cut_at_a_limit(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        text = " ".join(rng.choices(["grown", "network", "leaf"], k=rng.randrange(5, 60))) + "."
        rows.append(("limited", text[:200]))
    lead = "A sentence. https://doi.example/10.5555/"
    rows += [("limited", lead + "x" * (200 - len(lead))), ("limited", lead + "x" * 30)]
    lead = "[1] A, B. (1990). T. doi:10.1/"
    rows += [("limited", lead + "y" * (200 - len(lead))), ("limited", lead + "y" * 30)]
    got = flagged(spark, rows)
    assert {300, 302} <= got and not {301, 303} & got
