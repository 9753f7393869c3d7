"""Small column helpers shared by the operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null where the pattern or the group is absent."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def contains_any(text: Column, words) -> Column:
    """Whether any of the words occurs, as one alternation instead of one expression per word."""
    return text.rlike("|".join(re.escape(w) for w in words))


def like_escaped(text: str) -> str:
    """A LIKE pattern that finds ``text`` itself anywhere."""
    for ch in ("\\", "%", "_"):
        text = text.replace(ch, "\\" + ch)
    return f"%{text}%"


def icontains(col: Column, text: str) -> Column:
    return F.coalesce(F.ilike(col, F.lit(like_escaped(text))), F.lit(False))


def case_map(key: Column, mapping: dict, default: Column | None = None) -> Column:
    """Literal lookup table as an expression; stays inside code generation."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def percent(value: Column) -> Column:
    """A fraction as a whole percent, e.g. 0.8 -> '80%'."""
    return F.format_string("%.0f%%", value * F.lit(100.0))


def float_text(value: Column) -> Column:
    """Shortest decimal text of a double, never in exponent form: 1.0, 249.5, 12345678.0."""
    plain = value.cast("string")
    wide = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,8)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(plain.contains("E"), wide).otherwise(plain)


def _ascii_char(c: Column) -> Column:
    code = F.ascii(c)
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    high = F.lit(0xD800) + F.floor((code - 0x10000) / 0x400).cast("int")
    low = F.lit(0xDC00) + (code - 0x10000) % 0x400
    return (
        F.when(code < 128, c)
        .when(code < 0x10000, unit(code))
        .otherwise(F.concat(unit(high), unit(low)))
    )


def json_text(value: Column) -> Column:
    """A JSON string literal with ASCII escapes; null stays the word null."""
    whole = F.to_json(F.struct(value.alias("v")))
    s = F.substring(whole, F.lit(6), F.length(whole) - 6)
    # The per-character walk runs only for rows that have a non-ASCII character.
    s = F.when(value.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(s, ""), _ascii_char), "")).otherwise(s)
    return F.when(value.isNull(), "null").otherwise(s)


def json_bool(value: Column) -> Column:
    return F.when(value, F.lit("true")).otherwise(F.lit("false"))


def json_object(pairs: list[tuple[str, Column]]) -> Column:
    """An object in the given key order with ', ' and ': ' separators; values are JSON text already."""
    parts = []
    for i, (key, value) in enumerate(pairs):
        parts += [F.lit(("" if i == 0 else ", ") + f'"{key}": '), value]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def ratio(num: Column, den: Column, digits: int, empty: float | None) -> Column:
    """num/den as a percentage; ``empty`` where there is nothing to divide by."""
    return F.when(den > 0, F.round(num / den * 100.0, digits)).otherwise(F.lit(empty).cast("double"))
