import random
from datetime import datetime as D

from canopy.llm import survivor

SCHEMA = "work_id long, title string, abstract string, times_cited int, rich boolean, updated_at timestamp, type string, year int, group_id string"
STAND_INS = ["No title", "[Title not available]", "Abstract not available.", "N/A", "-", "null", "Ｎｏ ｔｉｔｌｅ", " ", None, ""]


def works(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in set(survivor.CURRENT_FIELDS) - set(df.columns):
        df = df.selectExpr("*", f"cast(null as string) as {c}")
    return df


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["Short", "A longer title", "Über den Titel", "Über den Titel!", "  padded   out  ", "A longer titlè", *STAND_INS]
    rows, groups = [], []
    for i in range(1, 200):
        rows.append((i, rng.choice(texts), rng.choice(texts), rng.choice([None, -1, 0, 5]), rng.choice([True, False, None]), rng.choice([None, D(2024, 1, 1), D(2024, 2, 1)]), None, None, "clash"))
        groups.append((i, i % 40))
    got = {(r["group_id"], r["field"]): r["work_id"] for r in survivor.suppliers(works(spark, rows), spark.createDataFrame(groups, "work_id long, group_id long")).collect()}
    size = {"Short": 5, "A longer title": 14, "Über den Titel": 14, "Über den Titel!": 15, "  padded   out  ": 10, "A longer titlè": 14}
    want = {}
    for g in range(40):
        own = [r for r in rows if r[0] % 40 == g]
        trust = lambda r: (bool(r[4]), r[5] or D(1, 1, 1), -r[0])
        for field, c in (("title", 1), ("abstract", 2)):
            if usable := [r for r in own if r[c] in size]:
                want[g, field] = max(usable, key=lambda r: (size[r[c]], *trust(r)))[0]
        if usable := [r for r in own if r[3] is not None and r[3] >= 0]:
            want[g, "times_cited"] = max(usable, key=trust)[0]
    assert got == want


def test_currency_decides_where_stamps_are_missing(spark):
    old, new = D(2024, 1, 1), D(2024, 6, 1)
    rows, groups, n = [], [], 0
    for g in range(5):
        for kind, at in (("preprint", old), ("article", new)):
            n += 1
            rows.append((n, "t", None, 1, True, at, kind, None, ""))
            groups.append((n, g))
    for kind, at, year in (("preprint", new, 2020), ("article", None, None)):
        n += 1
        rows.append((n, "t", None, 1, kind == "article", at, kind, year, ""))
        groups.append((n, 9))
    for kind, at in (("book", None), ("report", None), ("report", None)):
        n += 1
        rows.append((n, None, None, None, None, at, kind, None, ""))
        groups.append((n, 10))
    g = spark.createDataFrame(groups, "work_id long, group_id long")
    w = works(spark, rows)
    learned = survivor.transitions(w.drop("group_id").join(g, "work_id"), "group_id", "updated_at", ["type"])
    assert [tuple(r) for r in learned.collect()] == [("type", "preprint", "article")]
    merged = {r["group_id"]: r for r in survivor.merged_records(w.drop("group_id"), g).collect()}
    assert merged[0]["type"] == "article" and merged[9]["type"] == "article" and merged[10]["type"] == "report"
    assert merged[9]["rich"] and merged[9]["n_rows"] == 2 and merged[9]["year"] == "2020" and not merged[10]["rich"] and merged[10]["title"] is None


def test_stand_ins_are_learned_from_unlinked_groups(spark):
    missing = "No abstract is available here; ask the publisher."
    rows = [(i, "T", missing, 1, True, None, None, None, "") for i in range(1, 5)] + [(5, "T", "Brief.", 1, True, None, None, None, ""), (6, "T", "We show that no abstract says this.", 1, True, None, None, None, "")]
    groups = spark.createDataFrame([(1, 1), (5, 1), (2, 2), (3, 3), (4, 3), (6, 4)], "work_id long, group_id long")
    got = {r["group_id"]: r["work_id"] for r in survivor.suppliers(works(spark, rows).drop("group_id"), groups).where("field = 'abstract'").collect()}
    assert got == {1: 5, 4: 6}


def test_precedence_follows_chains_whose_middle_is_absent(spark):
    pairs = spark.createDataFrame([("type", "a", "b"), ("type", "b", "c"), ("type", "c", "d"), ("year", "1", "2"), ("year", "2", "3"), ("year", "3", "1")], "field string, older string, newer string")
    got = {tuple(r) for r in survivor.closed(pairs).collect()}
    assert got == {("type", x, y) for x, y in ("ab", "bc", "cd", "ac", "bd", "ad")}
    assert survivor.closed(pairs.limit(0)).count() == 0


def test_empty(spark):
    g = spark.createDataFrame([], "work_id long, group_id long")
    assert survivor.suppliers(works(spark, []), g).count() == 0 and survivor.merged_records(works(spark, []).drop("group_id"), g).count() == 0
