import json
from pathlib import Path

import pytest

from canopy.schema import TABLES, WORK_COLUMNS
from canopy.sources import store as S


def works(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in WORK_COLUMNS) for r in rows], TABLES["works"])


def titles(store):
    return {r["label"]: r["title"] for r in store.table("works").collect()}


def test_another_writer_is_noticed_and_old_rows_stay_readable(spark, tmp_path):
    one = S.Store(spark, str(tmp_path))
    one.put("works", works(spark, {"label": "a", "title": "Moss on roofs"}))
    one.commit()
    two, before = S.Store(spark, str(tmp_path)), one.table("works")
    one.upsert(works(spark, {"label": "a", "title": "Moss"}, {"label": "b", "title": "Lichen"}))
    one.commit()
    assert [r["title"] for r in before.collect()] == ["Moss on roofs"] and titles(one) == {"a": "Moss", "b": "Lichen"}
    assert {r["label"]: r["terms"][0] for r in one.table("terms").collect()} == {"a": ["moss"], "b": ["lichen"]}
    two.upsert(works(spark, {"label": "c"}))
    with pytest.raises(S.StoreChanged):
        two.commit()
    assert titles(S.Store(spark, str(tmp_path))) == {"a": "Moss", "b": "Lichen"}


def test_folders_go_after_their_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "KEPT", 0)
    store = S.Store(spark, str(tmp_path))
    for _ in range(2):
        store.put("collections", store.empty("collections"))
        store.commit()
    assert len(list((tmp_path / "collections").iterdir())) == 1


def test_an_older_store_is_brought_to_this_version(spark, tmp_path):
    works(spark, {"label": "a", "title": "Moss"}).write.parquet(str(tmp_path / "works" / "x"))
    Path(tmp_path / "manifest.json").write_text(json.dumps({"version": 5, "tables": {"works": "works/x"}, "parts": {"nodes": {}, "links": {}}}))
    store = S.Store(spark, str(tmp_path))
    assert titles(store) == {"a": "Moss"}
    store.upsert(works(spark, {"label": "b"}))
    store.commit()
    again = S.Store(spark, str(tmp_path))
    assert titles(again) == {"a": "Moss", "b": None} and again.table("terms").count() == 2
    (tmp_path / "newer").mkdir()
    Path(tmp_path / "newer" / "manifest.json").write_text(json.dumps({"version": 99}))
    with pytest.raises(ValueError):
        S.Store(spark, str(tmp_path / "newer"))
