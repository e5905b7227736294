"""Queries over record loading and class accessors, on records that are built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import classes as cl
from quarry.operators import quality
from quarry.sources import loader

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def part_records(table):
    """(pos, key, raw): JSON records of parts whose id, label and class sit under various keys."""
    k, s = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    ident = F.when(k % 4 == 0, F.concat(F.lit('"id": '), s("p_partkey"))).when(k % 4 == 1, F.concat(F.lit('"entity_id": '), q(s("p_partkey")))).when(k % 4 == 2, F.concat(F.lit('"id": "x", "value": '), s("p_partkey"))).otherwise(F.lit('"other": 1'))
    label = F.when(k % 3 == 0, F.concat(F.lit('"label": "", "name": '), q(F.col("p_name")))).when(k % 3 == 1, F.concat(F.lit('"wordnet_id": '), q(F.col("p_brand")))).otherwise(F.lit('"label": null'))
    kind = F.when(k % 5 == 0, F.concat(F.lit('"classname": '), q(F.col("p_type")))).when(k % 5 == 1, F.concat(F.lit('"classes": ["12", '), q(F.col("p_type")), F.lit(', "", "A_b"]'))).when(k % 5 == 2, F.lit('"types": {"x": ["u", "v"], "w": "", "y": "z/t"}')).when(k % 5 == 3, F.lit('"classname": "77", "class_id": 5')).otherwise(F.lit('"classname": "77", "class": "Tool"'))
    return table("part").select(k.alias("pos"), F.when(k % 4 == 3, s("p_partkey")).alias("key"), F.concat(F.lit("{"), ident, F.lit(", "), label, F.lit(", "), kind, F.lit("}")).alias("raw"))


NAMED = r"CASE p_partkey % 5 WHEN 0 THEN lower(p_type) WHEN 1 THEN lower(p_type) || '|a b' WHEN 2 THEN 'u|v|w|z / t' WHEN 3 THEN '' ELSE 'tool' END"


@query("source_entities", f"SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_partkey::VARCHAR END AS label, CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS external_id, {NAMED} AS classes FROM part")
def _(table):
    e = loader.entities(part_records(table))
    return e.select("id", "label", "external_id", F.array_join("classes", "|").alias("classes"))


@query("source_duplicate_ids", "SELECT p_size::BIGINT AS id, max_by(p_name, p_partkey) AS label, min(p_partkey) AS pos FROM part GROUP BY p_size")
def _(table):
    rec = table("part").select(F.col("p_partkey").alias("pos"), F.lit(None).cast("string").alias("key"), F.to_json(F.struct(F.col("p_size").alias("id"), F.col("p_name").alias("label"))).alias("raw"))
    return loader.entities(rec).select("id", "label", "pos")


@query("source_relation_schema", "SELECT s_suppkey AS id, 'rel ' || s_suppkey AS label, CASE WHEN s_suppkey % 2 = 0 THEN 'own' WHEN s_suppkey % 3 = 0 THEN 'by id' WHEN s_suppkey % 3 = 1 THEN 'by name' END AS domain, CASE WHEN s_suppkey % 3 = 0 THEN 'range id' WHEN s_suppkey % 3 = 1 THEN 'range name' END AS range FROM supplier")
def _(table):
    s, k = table("supplier"), F.col("s_suppkey")
    name = F.concat(F.lit("rel "), k.cast("string"))
    rel = s.select(k.alias("pos"), F.lit(None).cast("string").alias("key"), F.to_json(F.struct(k.alias("relation_id"), name.alias("label"), F.when(k % 2 == 0, "own").alias("domain"))).alias("raw"))
    one = F.to_json(F.struct(k.alias("id"), F.lit("by id").alias("domains"), F.lit("range id").alias("tail_type")))
    two = F.to_json(F.struct(name.alias("relation"), F.lit("by name").alias("head_type"), F.lit("range name").alias("ranges")))
    extra = s.where(k % 3 < 2).select(k.alias("pos"), F.lit(None).cast("string").alias("key"), F.when(k % 3 == 0, one).otherwise(two).alias("raw"))
    extra = extra.unionAll(extra.select(F.col("pos") + 1_000_000, "key", F.regexp_replace("raw", '"(by|range) ', '"late ')))
    return loader.merge_schema(loader.relations(rel), extra).select("id", "label", "domain", "range")


@query("source_triple_lines", "SELECT l_orderkey AS a, l_partkey AS b, l_suppkey AS c, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 2 GROUP BY 1, 2, 3")
def _(table):
    s = lambda c: F.col(c).cast("string")
    k = F.col("l_linenumber") % 3
    line = F.concat(F.lit("  "), s("l_orderkey"), F.lit("\t"), s("l_partkey"), F.lit(" "), F.when(k == 2, F.lit("x")).otherwise(s("l_suppkey")), F.when(k == 1, F.lit(" more")).otherwise(F.lit("")))
    rows = table("lineitem").select(F.lit(1).cast("long").alias("pos"), line.alias("value"))
    lead = table("region").limit(1).select(F.lit(0).cast("long").alias("pos"), F.lit(" 12345 ").alias("value"))
    return loader.triple_lines(lead.unionAll(rows)).groupBy("a", "b", "c").agg(F.count("*").alias("n"))


@query("source_json_items", "SELECT r_regionkey::BIGINT AS pos, NULL::VARCHAR AS key, r_name AS label FROM region UNION ALL SELECT n_nationkey::BIGINT, n_name, n_name FROM nation")
def _(table):
    item = lambda c: F.to_json(F.struct(F.col(c).alias("label")))
    rows = table("region").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", item("r_name").alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("value"))
    named = table("nation").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.to_json(F.array("n_name")), F.lit("")).alias("n"), item("n_name").alias("j")))), lambda x: F.concat(F.regexp_replace(x["n"], r"^\[|\]$", ""), F.lit(":"), x["j"])), ","), F.lit("}")).alias("value"))
    return loader.items_of(rows.unionAll(named)).select("pos", "key", F.get_json_object("raw", "$.label").alias("label"))


@query("source_adapted", "SELECT l_orderkey AS h, l_partkey AS r, l_suppkey AS t, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def _(table):
    x = table("lineitem").select(F.col("l_orderkey").alias("head_id"), F.col("l_partkey").alias("r"), F.col("l_suppkey").alias("tail"))
    return loader.adapted(x).groupBy("h", "r", "t").agg(F.count("*").alias("n"))


@query("source_slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 10")
def _(table):
    return loader.sliced(table("orders").select("o_orderkey"), ["o_orderkey"], 10, 25)


@query("classes_of_records", f"SELECT p_partkey AS pos, {NAMED} AS classes, coalesce(nullif(split_part({NAMED}, '|', 1), ''), 'unknown') AS first, CASE p_partkey % 5 WHEN 1 THEN 'classes' WHEN 2 THEN 'types' WHEN 3 THEN 'classname|class_id' WHEN 4 THEN 'classname|class' ELSE 'classname' END AS keys FROM part")
def _(table):
    c = cl.entity_classes("raw")
    return part_records(table).select("pos", F.array_join(c, "|").alias("classes"), cl.primary_class(c).alias("first"), F.array_join(cl.class_type_keys("raw"), "|").alias("keys"))


@query("classes_ranges", "SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 2 = 0 THEN 'city|42|a b' ELSE 'place' END AS kept, CASE WHEN s_suppkey % 2 = 0 THEN 'city|a b' ELSE 'place' END AS range, CASE WHEN s_suppkey % 2 = 0 THEN 'person' ELSE '' END AS domain FROM supplier")
def _(table):
    raw = F.when(F.col("s_suppkey") % 2 == 0, '{"range": ["City", "42"], "tail_type": "A_b", "domain": "city", "head_type": "Person", "domains": null}').otherwise('{"ranges": {"Place": null}}')
    x = table("supplier").select(F.col("s_suppkey").alias("pos"), F.regexp_replace(raw, '"domain": "city", ', "").alias("raw"))
    return x.select("pos", F.array_join(cl.relation_range("raw", True), "|").alias("kept"), F.array_join(cl.relation_range("raw"), "|").alias("range"), F.array_join(cl.relation_domain("raw"), "|").alias("domain"))


COUNTED = {
    "has_classname": "0, 3, 4", "missing_classname": "1, 2", "numeric_classname": "3, 4", "non_numeric_classname": "0", "has_class_id": "3, 4", "missing_class_id": "0, 1, 2", "numeric_class_id": "3", "non_numeric_class_id": "4",
    "current_loader_classes_contain_numeric": "3, 4", "preferred_classes_contain_numeric": "3", "preferred_classes_missing": "9",
}


@query("quality_counters", "SELECT count(*) AS total_entities, " + ", ".join(f"count(*) FILTER (p_partkey % 5 IN ({k})) AS {name}" for name, k in COUNTED.items()) + ", 'numeric_classname_in_records' AS diagnosis FROM part")
def _(table):
    return quality.diagnosed(quality.counters(loader.entities(part_records(table))))


LISTED = {
    "numeric_classname_examples": "3, 4", "numeric_class_id_examples": "3", "current_loader_numeric_class_examples": "3, 4", "preferred_numeric_class_examples": "3",
    "missing_classname_examples": "1, 2", "normal_classname_examples": "0", "raw_class_field_examples": "0, 1, 2, 3, 4",
}
SHOWN = "CASE WHEN list LIKE 'current%' THEN CASE p_partkey % 5 WHEN 3 THEN '77|5' ELSE '77|tool' END WHEN list LIKE 'preferred%' THEN '5' END"


@query(
    "quality_examples",
    f"SELECT list, place, p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 3 THEN '77' WHEN 4 THEN '77' END AS classname, CASE p_partkey % 5 WHEN 3 THEN '5' WHEN 4 THEN 'Tool' END AS class_id, {SHOWN} AS classes FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY p_partkey) AS place FROM ("
    + " UNION ALL ".join(f"SELECT '{name}' AS list, p_partkey, p_type FROM part WHERE p_partkey % 5 IN ({k})" for name, k in LISTED.items()) + ")) WHERE place <= 10",
)
def _(table):
    e = quality.examples(loader.entities(part_records(table)))
    return e.select("list", F.col("place").cast("long").alias("place"), "id", "classname", "class_id", F.array_join("classes", "|").alias("classes"))


@query("quality_key_histogram", "SELECT k AS key, count(*) AS n FROM (SELECT unnest(string_split(CASE p_partkey % 5 WHEN 1 THEN 'classes' WHEN 2 THEN 'types' WHEN 3 THEN 'classname|class_id' WHEN 4 THEN 'classname|class' ELSE 'classname' END, '|')) AS k FROM part) GROUP BY 1")
def _(table):
    return quality.key_histogram(part_records(table))
