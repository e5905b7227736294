"""Classes, domains and ranges in loosely structured records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import col
from .text import normalize_class

#: Keys of raw records that may hold classes, class ids, ranges and domains.
CLASS_KEYS = ("classlabel", "class_label", "classname", "class_name", "classes", "types", "type")
CLASS_ID_KEYS = ("classid", "class_id", "class")
RANGE_KEYS = ("range", "ranges", "tail_type", "tail_class", "tail_domain", "object_type")
LOADED_KEYS = ("classname", "class_name")
PREFERRED_KEYS = ("classname", "class_name", "classes", "types", "type")
PREFERRED_ID_KEYS = ("class", "classid", "class_id")
DOMAIN_KEYS = ("domain", "domains", "head_type", "head_class", "subject_type")


def is_numeric(c) -> Column:
    """Only decimal digits between blanks."""
    return F.coalesce(col(c).rlike(r"^\s*\p{Nd}+\s*$"), F.lit(False))


def is_empty(c) -> Column:
    x = col(c).cast("string")
    return x.isNull() | (F.trim(x) == "")


def to_list(raw, key: str) -> Column:
    """The value under a key of a JSON record as strings.

    A list gives its non-blank items; an object gives for each entry its list, else its value, else
    its key; a scalar gives itself; null and a missing key give an empty list.
    """
    v = F.get_json_object(col(raw), f"$.{key}")
    none = F.array().cast("array<string>")
    filled = lambda a: F.filter(a, lambda s: s.isNotNull() & (F.trim(s) != ""))
    items = filled(F.from_json(v, "array<string>"))
    entries = F.map_entries(F.from_json(v, "map<string,string>"))

    def one(e):
        inner = F.when(e["value"].startswith("["), filled(F.from_json(e["value"], "array<string>")))
        return F.coalesce(inner, F.when(F.trim(F.coalesce(e["value"], F.lit(""))) != "", F.array(e["value"])).otherwise(filled(F.array(e["key"]))))

    return F.when(v.isNull(), none).when(v.startswith("["), F.coalesce(items, none)).when(v.startswith("{"), F.coalesce(F.flatten(F.transform(entries, one)), none)).otherwise(F.array(v))


def clean_distinct(values: Column) -> Column:
    """Normalised, non-blank, distinct in order."""
    return F.array_distinct(F.filter(F.transform(values, normalize_class), lambda x: x != ""))


def _under(raw, keys) -> Column:
    return F.concat(*(to_list(raw, k) for k in keys))


def without_numeric(values: Column) -> Column:
    return F.filter(values, lambda x: ~is_numeric(x))


def entity_classes(raw) -> Column:
    """Named classes of a record without numeric ones, else its class ids without numeric ones."""
    named = without_numeric(clean_distinct(_under(raw, CLASS_KEYS)))
    return F.when(F.size(named) > 0, named).otherwise(without_numeric(clean_distinct(_under(raw, CLASS_ID_KEYS))))


def relation_range(raw, keep_numeric: bool = False) -> Column:
    v = clean_distinct(_under(raw, RANGE_KEYS))
    return v if keep_numeric else without_numeric(v)


def relation_domain(raw, keep_numeric: bool = False) -> Column:
    v = clean_distinct(_under(raw, DOMAIN_KEYS))
    return v if keep_numeric else without_numeric(v)


def primary_class(classes) -> Column:
    return F.coalesce(F.try_element_at(col(classes), F.lit(1)), F.lit("unknown"))


def class_type_keys(raw) -> Column:
    """Top-level keys whose lower-cased name has `class` or `type`, in order."""
    return F.filter(F.json_object_keys(col(raw)), lambda k: F.lower(k).rlike("class|type"))


def class_type_fields(raw) -> Column:
    """The top-level keys of `class_type_keys` with their values as JSON."""
    return F.map_filter(F.from_json(col(raw), "map<string,string>"), lambda k, v: F.lower(k).rlike("class|type"))


def _first(raw, keys, holds, value) -> Column:
    """The value under the first key that holds, else null."""
    out = F.lit(None)
    for k in reversed(keys):
        out = F.when(holds(k), value(k)).otherwise(out)
    return out


def _is_present(raw):
    return lambda k: F.coalesce(F.array_contains(F.json_object_keys(col(raw)), k), F.lit(False))


def is_filled(v: Column) -> Column:
    """Neither null, empty, 0 nor false."""
    return F.coalesce(~v.isin("", "0", "false", "[]", "{}"), F.lit(False))


def class_id(raw) -> Column:
    """The value under the first class-id key that the record has, null included."""
    return _first(raw, CLASS_ID_KEYS, _is_present(raw), lambda k: F.get_json_object(col(raw), f"$.{k}"))


def loaded_names(raw) -> Column:
    """The class name that a record is loaded with, as a list."""
    holds = lambda k: is_filled(F.get_json_object(col(raw), f"$.{k}"))
    return F.coalesce(_first(raw, LOADED_KEYS, holds, lambda k: to_list(raw, k)), F.array().cast("array<string>"))


def loaded_ids(raw) -> Column:
    """The class id that a record is loaded with, as a list."""
    return F.coalesce(_first(raw, CLASS_ID_KEYS, _is_present(raw), lambda k: to_list(raw, k)), F.array().cast("array<string>"))


def _filled_ids(raw) -> Column:
    return F.when(is_filled(class_id(raw)), loaded_ids(raw)).otherwise(F.array().cast("array<string>"))


def loader_classes(raw) -> Column:
    """Loaded class name and class id together; an id of 0 is left out."""
    return clean_distinct(F.concat(loaded_names(raw), _filled_ids(raw)))


def preferred_classes(raw) -> Column:
    """Named classes without numeric ones, else all class ids, numeric ones too."""
    named = without_numeric(clean_distinct(_under(raw, PREFERRED_KEYS)))
    return F.when(F.size(named) > 0, named).otherwise(clean_distinct(F.concat(_filled_ids(raw), _under(raw, PREFERRED_ID_KEYS))))
