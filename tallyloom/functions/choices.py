"""Choosing, merging and repairing values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "not known".
UNKNOWN = ("", "-", "—", "n/a", "na", "none", "null", "unknown", "不明", "なし", "未定")


def known(c: Column) -> Column:
    """Null for the spellings of "not known"; numbers stay, zero included."""
    return F.when(~F.lower(F.trim(c)).isin(*UNKNOWN), c)


def canon_choice(c: Column, tokens: list[str], exclusive: str | None = None) -> Column:
    """The given tokens a text contains, in their fixed order; ``exclusive`` stands alone only."""
    found = F.filter(F.array(*map(F.lit, tokens)), lambda t: c.contains(t))
    if exclusive:
        found = F.when(F.size(found) > 1, F.array_remove(found, exclusive)).otherwise(found)
    return F.array_join(found, ",")


def first_rule(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first rule whose needle the text contains, in the order given."""
    out = F.lit(None).cast("string")
    for needle, value in reversed(rules):
        out = F.when(c.contains(needle), F.lit(value)).otherwise(out)
    return out


def by_priority(candidates: list[tuple[str, Column]]) -> Column:
    """``struct(value, source)`` of the first candidate that is not null."""
    value = F.coalesce(*(c for _, c in candidates))
    source = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in candidates))
    return F.struct(value.alias("value"), source.alias("source"))


def fill_missing(main: dict[str, Column], other: dict[str, Column]) -> list[Column]:
    """Each field from ``main`` or else ``other``, and the array of fields that ``other`` filled."""
    out = [F.coalesce(c, other[k]).alias(k) if k in other else c.alias(k) for k, c in main.items()]
    filled = F.array_compact(F.array(*(F.when(main[k].isNull() & other[k].isNotNull(), F.lit(k)) for k in main if k in other)))
    return [*out, filled.alias("filled")]


def disagreements(answer: dict[str, Column], hint: dict[str, Column]) -> Column:
    """Names of the fields in which an answer differs from a hint that is given."""
    return F.array_compact(F.array(*(F.when(hint[k].isNotNull() & ~answer[k].eqNullSafe(hint[k]), F.lit(k)) for k in hint)))


def unwrap_json(c: Column) -> Column:
    """JSON text inside fences or chatter: from the first bracket to the last; null if there is none."""
    bare = F.regexp_replace(c, r"(?s)```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))


def issues(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that fail; a check that is null doesn't fail."""
    return F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks)))


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, else null: the reason a row is dropped."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(reasons):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def forced(value: Column, matrix: Column, pattern: str = r"\(([^)]+)\)") -> Column:
    """The matrix value, unless it names an alternative in brackets that ``value`` equals."""
    alternative = F.regexp_extract(matrix, pattern, 1)
    return F.when((alternative != "") & (value == alternative), value).otherwise(F.trim(F.regexp_replace(matrix, pattern, "")))


def valid_format(c: Column, kind: str) -> Column:
    """Whether a text is a date or an amount as people write them; null is not."""
    patterns = {"date": r"^\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?$", "amount": r"^[-△▲]?[¥￥]?\d{1,3}(?:,?\d{3})*(?:\.\d+)?円?$"}
    return F.coalesce(F.trim(c).rlike(patterns[kind]), F.lit(False))


def checked(c: Column, ok: Column, message: str) -> Column:
    """The value, or an error that stops the job where ``ok`` is false."""
    return F.when(ok, c).otherwise(F.raise_error(F.lit(message)).cast("string"))


def aliased(source: Column, fields: dict[str, tuple[list[str], str]]) -> list[Column]:
    """Typed columns of a map of texts: each field by the first of its keys that has a value.

    ``fields``: name to (keys, type). The type is guaranteed: what can't be read as it is
    null, ``array<string>`` is split at commas and lines and never null.
    """
    out = []
    for name, (keys, kind) in fields.items():
        c = F.coalesce(*(F.nullif(F.trim(F.try_element_at(source, F.lit(k))), F.lit("")) for k in keys))
        if kind == "array<string>":
            items = F.filter(F.transform(F.split(c, r"[,、\n]"), lambda x: F.trim(x)), lambda x: x != "")
            c = F.coalesce(items, F.array().cast(kind))
        elif kind != "string":
            c = F.regexp_replace(c, r"[,¥￥円\s]", "").try_cast(kind) if kind not in ("boolean", "date") else c.try_cast(kind)
        out.append(c.alias(name))
    return out


def search_phrases(parts: list[list[Column]], most: int) -> Column:
    """Phrases of the parts joined by a blank, null and blank parts left out, each once, at most ``most``."""
    phrases = F.array(*(F.nullif(F.trim(F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in ps))), F.lit("")) for ps in parts))
    return F.slice(F.array_distinct(F.array_compact(phrases)), 1, most)


def upload_action(size: Column, known_size: Column, name: Column, stamp: Column) -> Column:
    """``struct(action, name)`` of an upload against the file of its name: new, same (equal size), or a version with the date in its name."""
    from tallyloom.functions.text import versioned_name

    return F.when(known_size.isNull(), F.struct(F.lit("new").alias("action"), name.alias("name"))).when(size == known_size, F.struct(F.lit("same").alias("action"), name.alias("name"))).otherwise(F.struct(F.lit("version").alias("action"), versioned_name(name, stamp).alias("name")))
