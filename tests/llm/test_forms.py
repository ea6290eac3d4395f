import random
import unicodedata

import pytest

from canopy.llm import forms

SAME = [
    ("Étude", "Étude"), ("ﬁne", "fine"), ("Ｗｉｄｅ　text", "Wide text"), ("Hozаmetіc", "Hozametic"), ("a​b­c", "abc"), ("a b", "a b"), ("  a  b ", "a b"), ("q̣̇", "q̣̇"), ("ё", "ë"), ("K", "K"),
    ("ǘ", "ǘ"), ("co‐op", "co-op"), ("한", "한"), ("Νew", "New"), ("e‍́", "é"), ("𝐀", "A"),
]
OTHER = [("a", "A"), ("é", "e"), ("x²", "x2"), ("a-b", "a–b"), ("ab", "a b"), ("①", "1"), ("it's", "it’s"), ("o", "ö")]


def form_of(spark, values):
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "id long, text string, form string")
    got = {r["id"]: r["form"] for r in forms.visual_forms(df, ["id"], "text").collect()}
    return [got.get(i) for i in range(len(values))]


def test_equal_looks(spark):
    got = form_of(spark, [x for pair in SAME for x in pair])
    for i, pair in enumerate(SAME):
        assert got[2 * i] == got[2 * i + 1], pair


def test_different_looks(spark):
    got = form_of(spark, [x for pair in OTHER for x in pair])
    for i, pair in enumerate(OTHER):
        assert got[2 * i] != got[2 * i + 1], pair


def test_null_empty_invisible_and_long(spark):
    long = "Ü" * 200_000 + "x"
    assert form_of(spark, [None, "", " 　 ", "​", long, "́"]) == [None, "", "", "", long, "́"]
    assert form_of(spark, []) == []


def brute(text):
    """The same form, one text at a time."""
    parts = "".join(map(forms._expand, text))
    runs = []
    for c in parts:
        k = forms._class(c)
        if k == 0 or not runs:
            runs.append(("", []) if k else (c, []))
        if k:
            runs[-1][1].append((k, c))
    known = dict(forms.compositions())
    out = ""
    for head, marks in runs:
        letter, rest, last = head, "", 0
        for k, c in sorted(marks, key=lambda m: m[0]):
            joined = known.get(head, {}).get(letter + c) if last < k else None
            letter, rest, last = (joined, rest, last) if joined else (letter, rest + c, k)
        out += letter + rest
    return " ".join(out.split())


def test_random_texts_against_brute_force(spark):
    rng = random.Random(5)
    pool = "abcAEoé ÜñçКирлоасе̧̣́̈ﬁＡｂ​ 　ΟΝ-‐.,한한ͅͅ"
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 25))) for _ in range(300)]
    got = form_of(spark, texts)
    assert got == [brute(t) for t in texts]
    assert form_of(spark, got) == got


def test_composed_letters_are_those_of_unicode(spark):
    texts = [unicodedata.normalize("NFD", c) for c in "éüñçåøżŁệǭ"]
    assert form_of(spark, texts) == [unicodedata.normalize("NFC", t) for t in texts]


WORKS = "work_id long, title string, authors array<string>, form string"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], WORKS)
    return sorted(tuple(r) for r in forms.look_alike_works(df).collect())


def test_pairs_of_works(spark):
    rows = [
        (1, "Über", ["A, B", None]), (2, "Über", ["А, B", None]), (3, "Über", ["A, B"]), (4, "über", None), (5, None, []), (6, " ", ["A, B", "C"]), (7, "​", ["A, B", None]),
    ]
    assert found(spark, rows) == [("authors", 1, 2), ("authors", 2, 7), ("title", 1, 2), ("title", 2, 3)]


def test_no_works_and_hot_title(spark):
    assert found(spark, []) == []
    rows = [(i, "Same title", None) for i in range(300)] + [(999, "Same title", None)]
    assert found(spark, rows) == [("title", i, 999) for i in range(300)]


@pytest.mark.parametrize("row", [(1, None, None), (1, "", []), (1, "x", [None])])
def test_single_rows(spark, row):
    assert found(spark, [row]) == []
