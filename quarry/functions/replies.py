"""Parsing what a language model replies: JSON, indices, questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import col, words
from .text import clean_raw_output

WHITE = " \t\n\r\f\x0b"
#: Keys that may hold the ranked indices, or the question, in the order they are tried.
INDEX_KEYS = ("selected_indices", "ranked_indices", "top10", "indices")
QUESTION_KEYS = ("question", "query", "natural_language_question")


def strip_fences(c) -> Column:
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), "(?i)```json", "")
    return F.btrim(F.regexp_replace(x, "```", ""), F.lit(WHITE))


def clean_reply(c) -> Column:
    """Without code fences and think blocks."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), "```json|```", "")
    return F.btrim(F.regexp_replace(x, "(?s)<think>.*?</think>", ""), F.lit(WHITE))


def json_object(c) -> Column:
    """From the first { to the last }, or null."""
    return F.nullif(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), F.lit(""))


def tolerant_json(c) -> Column:
    """The JSON of a reply as text: all of it, else from the first [ to the last ], else from { to }; else null."""
    text = strip_fences(clean_raw_output(c))
    tries = [text, F.regexp_extract(text, r"(?s)\[.*\]", 0), F.regexp_extract(text, r"(?s)\{.*\}", 0)]
    parsed = [F.try_parse_json(F.nullif(t, F.lit(""))) for t in tries]
    return F.to_json(F.coalesce(*parsed))


def _first_key(obj: Column, keys) -> Column:
    """The first value among some keys that is not null, empty or an empty list."""
    found = [F.get_json_object(obj, f"$.{k}") for k in keys]
    return F.coalesce(*(F.when(~f.isin("", "[]", "{}", "0", "false"), f) for f in found))


def _valid(numbers: Column, n: Column, k: int) -> Column:
    ok = F.filter(numbers, lambda x: x.isNotNull() & (x >= 0) & (x < n))
    return F.slice(F.array_distinct(ok), 1, k)


def ranked_indices(c, k: int = 10, n=20) -> Column:
    """Indices of a reply: the list under a known key, else every number in the text; in range, distinct, k at most; null without any."""
    limit = F.lit(n) if isinstance(n, int) else col(n)
    number = lambda s: F.coalesce(s.try_cast("long"), F.when(s.rlike(r"^-?\d+\.\d+$"), s.try_cast("double").cast("long")))

    def listed(text: Column) -> Column:
        items = F.from_json(_first_key(F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), text), INDEX_KEYS), "array<string>")
        picked = _valid(F.transform(items, number), limit, k)
        return F.when(F.size(picked) > 0, picked)

    def pick(clean: Column) -> Column:
        loose = _valid(F.transform(F.regexp_extract_all(clean, F.lit(r"\d+"), F.lit(0)), lambda s: s.try_cast("long")), limit, k)
        return F.coalesce(listed(clean), listed(json_object(clean)), listed(json_object(c)), F.when(F.size(loose) > 0, loose))

    # the cleaned reply is made once, as the variable of a transform
    return F.when(col(c).isNotNull(), F.get(F.transform(F.array(clean_reply(c)), pick), 0))


def complete_indices(c, k: int = 10, n=20) -> Column:
    """Indices followed by the unused ones in their order, k in all."""
    limit = (F.lit(n) if isinstance(n, int) else col(n)).cast("long")
    rest = F.when(limit > 0, F.sequence(F.lit(0).cast("long"), limit - 1)).otherwise(F.array().cast("array<long>"))
    given = F.filter(F.coalesce(col(c), F.array().cast("array<long>")), lambda x: (x >= 0) & (x < limit))
    return F.slice(F.array_distinct(F.concat(given, rest)), 1, k)


def parse_question(c, fallback) -> Column:
    """The question of a reply: from its JSON, else its first line with a ? or four words, else the fallback."""
    clean = clean_reply(c)
    obj = F.coalesce(json_object(clean), json_object(c))
    asked = F.nullif(F.btrim(_first_key(F.when(F.try_parse_json(obj).isNotNull(), obj), QUESTION_KEYS), F.lit(WHITE)), F.lit(""))
    lines = F.split(F.btrim(F.regexp_replace(clean, "Answer:", ""), F.lit(WHITE)), r"\r\n|\n|\r")
    lines = F.transform(F.filter(lines, lambda s: F.btrim(s, F.lit(WHITE)) != ""), lambda s: F.btrim(s, F.lit(" -\t\n\r\"'")))
    good = F.filter(lines, lambda s: s.contains("?") | (F.size(words(s)) >= 4))
    return F.coalesce(asked, F.try_element_at(good, F.lit(1)), col(fallback))


def first_integer(c) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"-?\d+", 0), F.lit("")).try_cast("long")


def all_integers(c) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"-?\d+"), F.lit(0)), lambda s: s.try_cast("long"))
