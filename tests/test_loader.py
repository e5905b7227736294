"""Record files and triple files, and reply parsers."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import classes, replies
from quarry.sources import loader


def write(folder, name, value):
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))


def test_folder(spark, tmp_path):
    write(tmp_path, "entity.json", [{"id": 0, "label": "Ann", "classname": "person"}, {"id": 1, "label": "", "name": "Paris"}, "skipped", {"value": 2}, {"id": 0, "label": "Anna", "classname": ["a", "b"]}])
    write(tmp_path, "relation.json", {"7": {"label": "livesIn"}, "x": {"id": 8, "name": "near", "domain": "d"}})
    write(tmp_path, "relation_new.json", [{"relation": "livesIn", "domains": "person", "tail_type": "city"}, {"id": 8, "domain": "late", "range": "r"}, {"id": 99, "domain": "none"}])
    write(tmp_path, "train2id.txt", "3\n0 1 7\n0 5 7 extra\n\n1 2\nx y z\n2 0 8\n")
    ds = loader.load(spark, str(tmp_path))
    ent = {r["id"]: r for r in ds.entities.collect()}
    assert {i: r["label"] for i, r in ent.items()} == {0: "Anna", 1: "Paris", 2: "2"}
    assert ent[0]["pos"] == 0 and ent[0]["classes"] == ["a", "b"]
    rel = {r["id"]: (r["label"], r["domain"], r["range"]) for r in ds.relations.collect()}
    assert rel == {7: ("livesIn", "person", "city"), 8: ("near", "d", "r")}
    rows = ds.denormalised().orderBy("seq").collect()
    assert [(r["h_id"], r["r_id"], r["t_id"]) for r in rows] == [(0, 7, 1), (0, 7, 5), (2, 8, 0)]
    assert rows[1]["t_label"] == "[UnknownEntity:5]"
    assert ds.id_space() == (3, 9) and ds.inspect()["triples"] == {"train": 3}
    assert {r["label"]: r["id"] for r in ds.label_index().collect()}["Anna"] == 0


def test_order_of_columns(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    rows = spark.createDataFrame([(0, 1, 7, 2), (1, 2, 8, 1)], "pos long, a long, b long, c long")
    assert loader.column_order(rows, ids(1, 2), ids(7, 8)) == "hrt"
    assert loader.column_order(rows.select("pos", "a", F.col("c").alias("b"), F.col("b").alias("c")), ids(1, 2), ids(7, 8)) == "htr"
    assert loader.column_order(rows.limit(0), ids(1), ids(7)) == "htr"


def test_record_without_id(spark, tmp_path):
    write(tmp_path, "entity.json", [{"label": "x"}])
    with pytest.raises(Exception, match="no id"):
        loader.entities(loader.json_items(spark, str(tmp_path / "entity.json"))).collect()
    write(tmp_path, "bad.json", "3")
    with pytest.raises(Exception, match="neither a list nor an object"):
        loader.json_items(spark, str(tmp_path / "bad.json")).collect()


def test_replies(spark):
    rows = [('{"selected_indices":[3,3,25,"1"]}',), ("I choose 4 then 99 and 2",), ("none",), (None,), ('<think>5</think>{"indices": []} 7',)]
    df = spark.createDataFrame(rows, "t string").select(replies.ranked_indices("t").alias("p"))
    got = [r["p"] for r in df.collect()]
    assert got[:3] == [[3, 1], [4, 2], None] and got[3] is None and got[4] == [7]
    assert df.limit(1).select(replies.complete_indices(F.array(F.lit(3).cast("long")), 3, 5).alias("c")).first()["c"] == [3, 0, 1]
    assert spark.createDataFrame([('text {"a":[1]}',)], "t string").select(replies.tolerant_json("t").alias("j")).first()["j"] == "[1]"


def test_classes(spark):
    df = spark.createDataFrame([("0789",), (" 52 ",), ("city",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(classes.is_numeric("x")).collect()] == [True, True, False, False, False]
    raw = spark.createDataFrame([('{"classname": "12", "class": "Tool"}',), ('{"types": {"k": ["u", null], "w": ""}}',), ("{}",), (None,)], "raw string")
    assert [r[0] for r in raw.select(classes.entity_classes("raw")).collect()] == [["tool"], ["u", "w"], [], []]
