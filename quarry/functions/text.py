"""Text functions on columns: cleaning model output, normalising labels, writing evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import col, words


def squeeze(x: Column) -> Column:
    """Words joined by one space, without blanks at the ends."""
    return F.array_join(words(x), " ")


def normalize_answer(c) -> Column:
    """Trimmed, lower-cased, without a/an/the and ASCII punctuation, blanks squeezed; null gives ''."""
    x = F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))
    x = F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " ")
    return squeeze(F.regexp_replace(x, r"[!-/:-@\[-`{-~]", ""))


def remove_blocks(c) -> Column:
    """Without think, tool_call and tool_response blocks and <|..|> marks."""
    x = F.coalesce(col(c).cast("string"), F.lit(""))
    for tag in ("think", "tool_call", "tool_response"):
        x = F.regexp_replace(x, f"(?s)<{tag}>.*?</{tag}>", "")
    return F.btrim(F.regexp_replace(x, r"(?s)<\|.*?\|>", ""), F.lit(" \t\n\r\f\x0b"))


def after_answer(c) -> Column:
    """What follows the last `Answer:`, then the last `answer:`."""
    x = F.coalesce(col(c).cast("string"), F.lit(""))
    x = F.substring_index(F.substring_index(x, "Answer:", -1), "answer:", -1)
    return F.btrim(x, F.lit(" \t\n\r\f\x0b"))


def clean_raw_output(c) -> Column:
    return remove_blocks(after_answer(c))


def clean_final_answer(c) -> Column:
    return normalize_answer(clean_raw_output(c))


def normalize_class(c) -> Column:
    """Trimmed, `_` as a space, `/` set apart, blanks squeezed, lower-cased."""
    x = F.regexp_replace(F.regexp_replace(col(c).cast("string"), "_", " "), "/", " / ")
    return F.lower(squeeze(x))


def token_estimate(c) -> Column:
    """Words between white space; null and '' have none."""
    return F.coalesce(F.size(words(col(c).cast("string"))), F.lit(0)).cast("long")


def verbalize_relation(c) -> Column:
    """`/`, `_` and `.` as spaces, camel case and acronyms split, squeezed and lower-cased; blank results keep the label."""
    label = col(c).cast("string")
    x = F.regexp_replace(label, r"[/_.]", " ")
    x = F.regexp_replace(x, "(?<=[a-z])(?=[A-Z])", " ")
    x = F.lower(squeeze(F.regexp_replace(x, "(?<=[A-Z])(?=[A-Z][a-z])", " ")))
    return F.when(x == "", label).otherwise(x)


def fallback_question(head, relation) -> Column:
    return F.concat(
        F.lit('Given the head entity "'), col(head), F.lit('", which candidate entity best completes the relation "'), verbalize_relation(relation), F.lit('"?')
    )


def class_list(c) -> Column:
    """Classes joined by a comma, or `Unknown`."""
    return F.coalesce(F.nullif(F.array_join(F.filter(col(c), lambda x: F.trim(x) != ""), ", "), F.lit("")), F.lit("Unknown"))


def triple_text(h, r, t) -> Column:
    return F.concat(col(h), F.lit(" --["), col(r), F.lit("]--> "), col(t))


def path_text(steps) -> Column:
    """Text of an array of (h, r, t[, forward]) labels; a step that is not forward is drawn backwards."""
    s = col(steps)

    def step(x):
        return F.when(x["forward"], F.concat(F.lit("--["), x["r"], F.lit("]--> "), x["t"])).otherwise(F.concat(F.lit("<--["), x["r"], F.lit("]-- "), x["t"]))

    return F.when(F.size(s) == 0, F.lit("")).otherwise(F.concat_ws(" ", F.element_at(s, 1)["h"], F.array_join(F.transform(s, step), " ")))


def fixed(c, digits: int) -> Column:
    """A number with so many decimals, rounded half away from zero as a decimal."""
    return col(c).cast("decimal(30,12)").cast(f"decimal(30,{digits})").cast("string")


def score_suffix(score, eta) -> Column:
    return F.concat(F.lit(" (score="), fixed(score, 4), F.lit(", eta="), fixed(eta, 2), F.lit(")"))


def evidence_text(items) -> Column:
    """Numbered lines `i. [type; score=..] text` of an array of (type, score, text)."""
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), x["type"], F.lit("; score="), fixed(x["score"], 4), F.lit("] "), x["text"])
    return F.array_join(F.transform(col(items), line), "\n")


def strip_number(c) -> Column:
    return F.regexp_replace(col(c), r"^\d+\.\s*", "")


def pattern_text(c, most: int = 6) -> Column:
    """The first patterns in code point order, and how many more there are; `none` without any."""
    v = F.array_sort(F.filter(col(c), lambda x: F.trim(x) != ""))
    more = F.when(F.size(v) > most, F.concat(F.lit(", ... (+"), (F.size(v) - most).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.coalesce(F.size(v), F.lit(0)) <= 0, "none").otherwise(F.concat(F.array_join(F.slice(v, 1, most), ", "), more))


def pair_key(a, b) -> Column:
    return F.concat(F.lit("pair::"), normalize_class(a), F.lit("|||"), normalize_class(b))


def query_signature(relation_id, ranges, classes) -> Column:
    part = lambda c: F.array_join(F.array_sort(F.transform(col(c), normalize_class)), "||")
    return F.concat(F.lit("r="), col(relation_id).cast("string"), F.lit("::range="), part(ranges), F.lit("::classes="), part(classes))


def messages(user, system=None) -> Column:
    """Chat messages: an optional system message, then the user's."""
    make = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    said = F.lit(None).cast("string") if system is None else col(system)
    return F.filter(F.array(make("system", said), make("user", col(user))), lambda m: ~((m["role"] == "system") & (m["content"].isNull() | (m["content"] == ""))))


#: Other names of the judgement labels.
JUDGEMENTS = {
    "same": "subclass_or_same",
    "exact": "subclass_or_same",
    "subclass": "subclass_or_same",
    "subclass_or_equal": "subclass_or_same",
    "parent": "parent_of_range",
    "superclass": "parent_of_range",
    "superclass_of_range": "parent_of_range",
    "overlap": "overlap_related",
    "related": "overlap_related",
    "partially_related": "overlap_related",
    "different": "disjoint",
    "irrelevant": "disjoint",
    "unrelated": "disjoint",
}
#: The score of each judgement.
JUDGEMENT_SCORES = {
    "subclass_or_same": 1.0,
    "parent_of_range": 0.9,
    "overlap_related": 0.8,
    "disjoint": 0.5,
    "no_range_constraint": 1.0,
    "missing_entity_class": 0.8,
    "missing_class_text": 0.8,
    "no_llm_fallback": 0.8,
    "llm_error_fallback": 0.8,
}


def judgement(c) -> Column:
    """A judgement label in its normal form; unknown labels are `disjoint`."""
    x = F.regexp_replace(F.lower(F.trim(col(c))), "[- ]", "_")
    table = F.create_map(*(F.lit(v) for kv in JUDGEMENTS.items() for v in kv))
    named = F.coalesce(F.try_element_at(table, x), x)
    return F.when(named.isin(*JUDGEMENT_SCORES), named).otherwise("disjoint")


def judgement_score(c) -> Column:
    table = F.create_map(*(F.lit(v) for kv in JUDGEMENT_SCORES.items() for v in kv))
    return F.try_element_at(table, col(c))
