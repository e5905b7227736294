"""A report on the classes of entities: counters, examples, key histogram, diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import classes as cl


def _has_numeric(values) -> Column:
    return F.exists(values, cl.is_numeric)


def measured(entities: DataFrame) -> DataFrame:
    """Loaded entities (id, pos, label, classname, class_id, raw) with their loaded and preferred classes and what is wrong with them."""
    read = entities.select(
        "id", "pos", "label", "classname", "class_id", cl.class_type_fields("raw").alias("fields"),
        cl.loaded_names("raw").alias("names"), cl.loaded_ids("raw").alias("ids"), cl.loader_classes("raw").alias("current"), cl.preferred_classes("raw").alias("preferred"),
    )
    no_id = cl.is_empty("class_id") | F.coalesce(F.col("class_id").isin("[]", "{}"), F.lit(False))
    return read.select(
        "*", (F.size("names") > 0).alias("has_classname"), _has_numeric("names").alias("numeric_classname"), (~no_id).alias("has_class_id"), (~no_id & _has_numeric("ids")).alias("numeric_class_id"),
        _has_numeric("current").alias("numeric_current"), _has_numeric("preferred").alias("numeric_preferred"), (F.coalesce(F.size("fields"), F.lit(0)) > 0).alias("has_fields"),
    )


def counters(entities: DataFrame) -> DataFrame:
    """One row of counters over loaded entities."""
    n = lambda c, name: F.count_if(c).alias(name)
    name, number, ident, ident_number = (F.col(c) for c in ("has_classname", "numeric_classname", "has_class_id", "numeric_class_id"))
    return measured(entities).agg(
        F.count("*").alias("total_entities"),
        n(name, "has_classname"), n(~name, "missing_classname"), n(number, "numeric_classname"), n(name & ~number, "non_numeric_classname"),
        n(ident, "has_class_id"), n(~ident, "missing_class_id"), n(ident_number, "numeric_class_id"), n(ident & ~ident_number, "non_numeric_class_id"),
        n(F.col("numeric_current"), "current_loader_classes_contain_numeric"), n(F.col("numeric_preferred"), "preferred_classes_contain_numeric"), n(F.size("preferred") == 0, "preferred_classes_missing"),
    )


def examples(entities: DataFrame, n: int = 10) -> DataFrame:
    """The first n entities of each of the seven lists: list, place, id, label, classname, class_id, classes, fields."""
    none = F.lit(None).cast("array<string>")
    lists = (
        ("numeric_classname_examples", F.col("numeric_classname"), none), ("numeric_class_id_examples", F.col("numeric_class_id"), none),
        ("current_loader_numeric_class_examples", F.col("numeric_current"), F.col("current")), ("preferred_numeric_class_examples", F.col("numeric_preferred"), F.col("preferred")),
        ("missing_classname_examples", ~F.col("has_classname"), none), ("normal_classname_examples", F.col("has_classname") & ~F.col("numeric_classname"), none),
        ("raw_class_field_examples", F.col("has_fields"), none),
    )
    on = F.filter(F.array(*(F.when(c, F.struct(F.lit(name).alias("list"), classes.alias("classes"))) for name, c, classes in lists)), lambda x: x.isNotNull())
    rows = measured(entities).select("id", "pos", "label", "classname", "class_id", "fields", F.explode(on).alias("x")).select("x.list", "x.classes", "id", "pos", "label", "classname", "class_id", "fields")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("list").orderBy("pos", "id"))).where(F.col("place") <= n).drop("pos")


def key_histogram(entities: DataFrame) -> DataFrame:
    """How often each class or type key occurs in the raw records."""
    return entities.select(F.explode(cl.class_type_keys("raw")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "key")


def diagnosis(numeric_classname, numeric_current, numeric_preferred) -> Column:
    """Where numeric class names come from, by the counters of that name."""
    return (
        F.when(numeric_classname > 0, "numeric_classname_in_records").when((numeric_current > 0) & (numeric_preferred == 0), "numbers_only_from_class_ids")
        .when(numeric_preferred > 0, "class_ids_need_names").otherwise("no_numeric_classes")
    )


def diagnosed(counted: DataFrame) -> DataFrame:
    return counted.withColumn("diagnosis", diagnosis(F.col("numeric_classname"), F.col("current_loader_classes_contain_numeric"), F.col("preferred_classes_contain_numeric")))
