import json

from quarry.functions import classes as cl
from quarry.operators import quality
from quarry.sources import loader

RECORDS = [
    {"id": 1, "classname": "Music_Group", "classid": None, "class_id": 7},  # a key that is present decides, null or not
    {"id": 2, "classname": "", "class_name": ["12", "City"]},
    {"id": 3, "class": 0},
    {"id": 4, "class_id": [], "subType": "x"},
    {"id": 5, "classname": None, "classid": ["8", "tool"], "types": []},
    {"id": 6},
]


def _entities(spark, records):
    items = spark.createDataFrame([(k, None, json.dumps(r)) for k, r in enumerate(records)], "pos long, key string, raw string")
    return loader.entities(items)


def test_classes_of_odd_records(spark):
    got = {r["id"]: r for r in _entities(spark, RECORDS).select("id", "class_id", cl.loader_classes("raw").alias("loaded"), cl.preferred_classes("raw").alias("preferred")).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == {1: None, 2: None, 3: "0", 4: "[]", 5: '["8","tool"]', 6: None}
    assert {k: r["loaded"] for k, r in got.items()} == {1: ["music group"], 2: ["12", "city"], 3: [], 4: [], 5: ["8", "tool"], 6: []}
    assert {k: r["preferred"] for k, r in got.items()} == {1: ["music group"], 2: ["city"], 3: ["0"], 4: [], 5: ["8", "tool"], 6: []}


def test_counters_and_examples(spark):
    c = quality.diagnosed(quality.counters(_entities(spark, RECORDS))).first().asDict()
    assert c == {
        "total_entities": 6, "has_classname": 2, "missing_classname": 4, "numeric_classname": 1, "non_numeric_classname": 1, "has_class_id": 2, "missing_class_id": 4, "numeric_class_id": 2, "non_numeric_class_id": 0,
        "current_loader_classes_contain_numeric": 2, "preferred_classes_contain_numeric": 2, "preferred_classes_missing": 2, "diagnosis": "numeric_classname_in_records",
    }
    rows = quality.examples(_entities(spark, RECORDS), 2).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["list"], r["place"])):
        by.setdefault(r["list"], []).append(r["id"])
    assert by["missing_classname_examples"] == [3, 4] and by["normal_classname_examples"] == [1] and by["numeric_class_id_examples"] == [3, 5]
    assert by["raw_class_field_examples"] == [1, 2] and [r["fields"] for r in rows if r["list"] == "preferred_numeric_class_examples" and r["id"] == 3] == [{"class": "0"}]


def test_diagnosis_follows_the_counters(spark):
    cases = [(1, 1, 1, "numeric_classname_in_records"), (0, 1, 0, "numbers_only_from_class_ids"), (0, 1, 1, "class_ids_need_names"), (0, 0, 0, "no_numeric_classes")]
    df = spark.createDataFrame(cases, "a int, b int, c int, want string")
    got = df.select(quality.diagnosis(df["a"], df["b"], df["c"]).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_empty_table(spark):
    none = _entities(spark, RECORDS).where("id < 0")
    c = quality.diagnosed(quality.counters(none)).first()
    assert c["total_entities"] == 0 and c["diagnosis"] == "no_numeric_classes" and quality.examples(none).count() == 0
