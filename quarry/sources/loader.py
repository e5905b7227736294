"""Reading a knowledge-graph folder: entity and relation records, triple files, JSON lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarry.functions import classes as cl

#: Record keys in the order in which they are tried.
ID_KEYS = {"entity": ("id", "entity_id", "idx", "index", "value"), "relation": ("id", "relation_id", "idx", "index", "value")}
LABEL_KEYS = {"entity": ("label", "name", "freebase_id", "wordnet_id"), "relation": ("label", "name", "freebase", "freebase_id", "id")}
EXTERNAL_KEYS = ("freebase_id", "freebase", "fb_id", "wn_id", "wordnet_id")
NAME_KEYS = ("label", "relation", "relation_label", "freebase", "freebase_id")
DOMAIN_ALIASES = ("domain", "domains", "head_type", "head_class")
RANGE_ALIASES = ("range", "ranges", "tail_type", "tail_class")


def field(key: str, raw="raw") -> Column:
    return F.get_json_object(F.col(raw), f"$.{key}")


def int_like(x: Column) -> Column:
    """A whole number, or the whole part of a number with decimals; null else."""
    return F.coalesce(x.try_cast("long"), F.when(x.rlike(r"^-?\d+\.\d+$"), x.try_cast("double").cast("long")))


def first_filled(keys, raw="raw") -> Column:
    """The first value that is neither null, empty, 0 nor false."""
    return F.coalesce(*(F.when(~field(k, raw).isin("", "0", "false", "[]", "{}"), field(k, raw)) for k in keys))


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """(pos, key, raw) of a JSON file whose root is a list, or an object (key: its name); items that are no objects go."""
    return items_of(spark.read.text(path, wholetext=True))


def items_of(texts: DataFrame) -> DataFrame:
    """(pos, key, raw) of a column `value` that holds a whole JSON document."""
    body = F.btrim(F.col("value"), F.lit(" \t\r\n"))
    checked = texts.select(F.when(body.startswith("[") | body.startswith("{"), body).otherwise(F.raise_error(F.lit("the JSON root is neither a list nor an object"))).alias("value"))
    rows = checked.where(F.col("value").startswith("[")).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "raw")).select("pos", F.lit(None).cast("string").alias("key"), "raw")
    named = checked.where(F.col("value").startswith("{")).select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "e")).select("pos", F.col("e.key").alias("key"), F.col("e.value").alias("raw"))
    return rows.unionAll(named).where(F.col("raw").startswith("{")).withColumn("pos", F.col("pos").cast("long"))


def record_id(kind: str) -> Column:
    return F.coalesce(*(int_like(field(k)) for k in ID_KEYS[kind]), F.col("key").try_cast("long"))


def _last_wins(df: DataFrame) -> DataFrame:
    """One row of each id: the last record at the first record's place."""
    return df.groupBy("id").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("id", "pos")]), "pos").alias("v"), F.min("pos").alias("pos")).select("id", "pos", "v.*")


def entities(items: DataFrame) -> DataFrame:
    """id, pos, label, external_id, classname, class_id, classes and raw of entity records; a record without an id is an error."""
    ident = F.coalesce(record_id("entity"), F.raise_error(F.lit("an entity has no id")).cast("long"))
    out = items.select(ident.alias("id"), "pos", F.coalesce(first_filled(LABEL_KEYS["entity"]), record_id("entity").cast("string")).alias("label"), first_filled(EXTERNAL_KEYS).alias("external_id"), first_filled(("classname", "class_name")).alias("classname"), cl.class_id("raw").alias("class_id"), cl.entity_classes("raw").alias("classes"), "raw")
    return _last_wins(out)


def relations(items: DataFrame) -> DataFrame:
    """id, pos, label, external_id, domain, range and raw of relation records."""
    ident = F.coalesce(record_id("relation"), F.raise_error(F.lit("a relation has no id")).cast("long"))
    out = items.select(ident.alias("id"), "pos", F.coalesce(first_filled(LABEL_KEYS["relation"]), record_id("relation").cast("string")).alias("label"), first_filled(EXTERNAL_KEYS).alias("external_id"), field("domain").alias("domain"), field("range").alias("range"), "raw")
    return _last_wins(out)


def merge_schema(rel: DataFrame, extra: DataFrame) -> DataFrame:
    """Fills null domains and ranges from supplementary records (pos, key, raw).

    A record with an id matches by it alone; otherwise by its names, labels before external ids.
    The first record that has a value counts.
    """
    e = extra.select("pos", record_id("relation").alias("xid"), F.array(*(field(k) for k in NAME_KEYS), F.col("key")).alias("names"), F.coalesce(*map(field, DOMAIN_ALIASES)).alias("xd"), F.coalesce(*map(field, RANGE_ALIASES)).alias("xr"))
    by_id = e.where("xid is not null").select(F.col("xid").alias("id"), "pos", "xd", "xr")
    names = e.where("xid is null").select("pos", "xd", "xr", F.posexplode("names").alias("k", "name")).where("name is not null")
    labels = rel.groupBy("label").agg(F.max_by("id", "pos").alias("id")).select(F.col("label").alias("name"), "id", F.lit(0).alias("w"))
    outer = rel.where("external_id is not null").groupBy("external_id").agg(F.max_by("id", "pos").alias("id")).select(F.col("external_id").alias("name"), "id", F.lit(1).alias("w"))
    hit = names.join(labels.unionAll(outer), "name").groupBy("pos").agg(F.min_by(F.struct("id", "xd", "xr"), F.struct("k", "w")).alias("v")).select("v.id", "pos", "v.xd", "v.xr")
    found = by_id.unionByName(hit)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    fill = found.groupBy("id").agg(first("xd").alias("xd"), first("xr").alias("xr"))
    j = rel.join(fill, "id", "left")
    return j.withColumn("domain", F.coalesce("domain", "xd")).withColumn("range", F.coalesce("range", "xr")).drop("xd", "xr")


def triple_lines(lines: DataFrame) -> DataFrame:
    """(pos, a, b, c) of text lines (pos, value): three whole numbers each, more tokens ignored.

    Blank lines do not count, and the first line is a header if it has one token.
    """
    t = lines.select("pos", F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    first = t.agg(F.min("pos").alias("lead"))  # one row
    t = t.join(F.broadcast(first)).where((F.col("pos") != F.col("lead")) | (F.size("w") > 1))
    num = lambda k: F.get("w", k).try_cast("long")
    return t.select("pos", num(0).alias("a"), num(1).alias("b"), num(2).alias("c")).where("a is not null and b is not null and c is not null")


def column_order(parsed: DataFrame, entity_ids: DataFrame, relation_ids: DataFrame, rows: int = 1000) -> str:
    """`htr` or `hrt`, by which order more of the first rows fit; a tie is `htr`."""
    head = parsed.orderBy("pos").limit(rows)
    e = F.broadcast(head.select(F.explode(F.array("a", "b", "c")).alias("id")).distinct().join(entity_ids.select("id"), "id", "left_semi"))  # at most 3 * rows
    r = F.broadcast(head.select(F.explode(F.array("b", "c")).alias("id")).distinct().join(relation_ids.select("id"), "id", "left_semi"))
    flag = lambda df, src, c: df.join(src.select(F.col("id").alias(c), F.lit(1).alias(f"_{c}{'r' if src is r else 'e'}")), c, "left")
    for src, c in ((e, "a"), (e, "b"), (e, "c"), (r, "b"), (r, "c")):
        head = flag(head, src, c)
    s = head.agg(F.count_if(F.expr("_ae = 1 and _be = 1 and _cr = 1")).alias("htr"), F.count_if(F.expr("_ae = 1 and _ce = 1 and _br = 1")).alias("hrt")).first()
    return "hrt" if s["hrt"] > s["htr"] else "htr"


def triples(spark: SparkSession, path: str, ent: DataFrame, rel: DataFrame, split: str) -> DataFrame:
    """(split, seq, h_id, r_id, t_id) of a triple file; a missing file gives no rows."""
    try:
        text = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], "split string, seq long, h_id long, r_id long, t_id long")
    parsed = triple_lines(text.select(F.monotonically_increasing_id().alias("pos"), "value"))
    h, r, t = ("a", "c", "b") if column_order(parsed, ent, rel) == "htr" else ("a", "b", "c")
    return parsed.select(F.lit(split).alias("split"), F.col("pos").alias("seq"), F.col(h).alias("h_id"), F.col(r).alias("r_id"), F.col(t).alias("t_id"))


@dataclass
class Dataset:
    """The three tables of a folder."""

    entities: DataFrame
    relations: DataFrame
    triples: DataFrame

    def denormalised(self) -> DataFrame:
        """Triples with labels and class names; unknown ids get placeholders."""
        e, r = self.entities, self.relations
        out = self.triples.join(e.select(F.col("id").alias("h_id"), F.col("label").alias("h_label"), F.col("classname").alias("h_classname")), "h_id", "left").join(e.select(F.col("id").alias("t_id"), F.col("label").alias("t_label"), F.col("classname").alias("t_classname")), "t_id", "left").join(r.select(F.col("id").alias("r_id"), F.col("label").alias("r_label")), "r_id", "left")
        hole = lambda kind, c: F.concat(F.lit(f"[Unknown{kind}:"), F.col(c).cast("string"), F.lit("]"))
        return out.withColumn("h_label", F.coalesce("h_label", hole("Entity", "h_id"))).withColumn("t_label", F.coalesce("t_label", hole("Entity", "t_id"))).withColumn("r_label", F.coalesce("r_label", hole("Relation", "r_id")))

    def label_index(self, table: str = "entities", column: str = "label") -> DataFrame:
        """(label, id): the last record of each label."""
        df = getattr(self, table).where(F.col(column).isNotNull())
        return df.groupBy(column).agg(F.max_by("id", "pos").alias("id"))

    def id_space(self) -> tuple[int, int]:
        """One more than the largest ids, from the records or else the triples."""
        n = self.entities.agg(F.max("id")).first()[0]
        m = self.relations.agg(F.max("id")).first()[0]
        if n is None:
            n = self.triples.agg(F.max(F.greatest("h_id", "t_id"))).first()[0]
        if m is None:
            m = self.triples.agg(F.max("r_id")).first()[0]
        if n is None or m is None:
            raise ValueError("there are neither records nor triples")
        return n + 1, m + 1

    def inspect(self, n: int = 5) -> dict:
        """Counts and the first rows."""
        return {"entities": self.entities.count(), "relations": self.relations.count(), "triples": {r["split"]: r["count"] for r in self.triples.groupBy("split").count().collect()}, "examples": [r.asDict() for r in self.denormalised().orderBy("split", "seq").limit(n).collect()]}


def load(spark: SparkSession, folder: str) -> Dataset:
    """Loads a folder; the entity and relation files are needed, the rest is optional."""
    ent = entities(json_items(spark, f"{folder}/entity.json"))
    rel = relations(json_items(spark, f"{folder}/relation.json"))
    try:
        rel = merge_schema(rel, json_items(spark, f"{folder}/relation_new.json"))
    except AnalysisException:
        pass
    parts = [triples(spark, f"{folder}/{s}2id.txt", ent, rel, s) for s in ("train", "valid", "test")]
    return Dataset(ent, rel, parts[0].unionAll(parts[1]).unionAll(parts[2]))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sliced(df: DataFrame, by: list, start: int = 0, most: int | None = None) -> DataFrame:
    """Rows start .. start + most in an order."""
    out = df.orderBy(*by).offset(start)
    return out if most is None or most < 0 else out.limit(most)


def adapted(df: DataFrame) -> DataFrame:
    """(h, r, t) of a table whose columns go by any usual names."""
    names = {"h": ("h", "h_id", "head", "head_id"), "r": ("r", "r_id", "relation", "relation_id"), "t": ("t", "t_id", "tail", "tail_id")}
    pick = lambda ks: F.coalesce(*(F.col(k) for k in ks if k in df.columns)).cast("long")
    return df.select(*(pick(ks).alias(n) for n, ks in names.items()))


