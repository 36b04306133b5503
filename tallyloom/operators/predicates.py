"""Predicates built from data: boolean trees, dynamic filters and their reports."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import fold, match_key, squash
from tallyloom.operators.matching import closest_match, contains_pairs

NUMERIC = {"<=", ">=", "<", ">"}


def all_of(conditions: list[Column]) -> Column:
    """Conjunction; none is true, one is itself."""
    return reduce(and_, conditions) if conditions else F.lit(True)


def any_of(conditions: list[Column]) -> Column | None:
    """Disjunction; none gives None, one is itself."""
    return reduce(or_, conditions) if conditions else None


def tree(groups: list[list[Column]]) -> Column | None:
    """AND of OR-groups; empty groups count for nothing, no group gives None."""
    parts = [g for g in map(any_of, groups) if g is not None]
    return all_of(parts) if parts else None


def source_filter(source: str | None = None, projects: list[str] | None = None, first: str | None = None, last: str | None = None, *, prefix: str = "pjt_", unclassified: str | None = None) -> Column:
    """Equality, membership and an inclusive range of time: what a scan can push down.

    Projects match with and without ``prefix``; ``unclassified`` also lets rows of no
    project pass.
    """
    conditions = []
    if source:
        conditions.append(F.col("source") == source)
    if projects:
        names = sorted({n for p in projects for n in (p, prefix + p.removeprefix(prefix))})
        member = F.col("project").isin(*names)
        conditions.append((member | F.col("project").isNull() | (F.col("project") == unclassified)) if unclassified else member)
    if first:
        conditions.append(F.col("timestamp") >= F.lit(first).cast("timestamp"))
    if last:
        conditions.append(F.col("timestamp") <= F.lit(last).cast("timestamp"))
    return all_of(conditions)


def keyword_match(fields: list[str], keywords: list[str], *, normalised: bool = False) -> Column:
    """Any keyword in the fields, case and width ignored; no keyword, or blank ones only, matches all.

    ``normalised``: the fields hold :func:`tallyloom.functions.text.match_key` already.
    """
    wanted = [fold(k) for k in keywords or [] if k and k.strip()]
    if not wanted:
        return F.lit(True)
    hay = F.concat_ws(" \n", *fields)
    hay = hay if normalised else match_key(hay)
    return any_of([hay.contains(k) for k in wanted])


def person_match(address_fields: list[str], name_fields: list[str], address: str | None, spellings: list[str], *, normalised: bool = False) -> Column:
    """The address in an address field, or a spelling of two or more signs in a name field, case and width ignored."""
    key = (lambda c: c) if normalised else match_key
    conditions = []
    if address and address.strip():
        conditions.append(key(F.concat_ws(" \n", *address_fields)).contains(fold(address.strip())))
    wanted = [fold(s) for s in spellings if s and len(s) >= 2]
    if wanted:
        hay = key(F.concat_ws(" \n", *name_fields))
        conditions += [hay.contains(w) for w in wanted]
    return any_of(conditions) if conditions else F.lit(True)


def condition(df: DataFrame, name: str, op: str, value: Any) -> Column:
    """One dynamic condition. An unknown column or an operand that is no number is true; a
    cell that is no number is false for orderings; nulls are false but for inequality."""
    if name not in df.columns:
        return F.lit(True)
    c = F.col(f"`{name}`")
    if op in NUMERIC:
        try:
            n = float(value)
        except (TypeError, ValueError):
            return F.lit(True)
        cell = c.try_cast("double")
        return F.coalesce({"<=": cell <= n, ">=": cell >= n, "<": cell < n, ">": cell > n}[op], F.lit(False))
    text = c.cast("string")
    if op == "in":
        return F.coalesce(any_of([text.contains(str(v)) for v in value]) if value else F.lit(False), F.lit(False))
    tests = {"contains": text.contains(str(value)), "not_contains": ~text.contains(str(value)), "==": text == str(value), "!=": text != str(value)}
    return F.coalesce(tests[op], F.lit(op in ("not_contains", "!=")))


def canonical_column(name: str, columns: list[str], aliases: dict[str, str] | None = None) -> str:
    """Exact name, alias, unique prefix, else the name unchanged."""
    if name in columns:
        return name
    if aliases and aliases.get(name) in columns:
        return aliases[name]
    starts = [c for c in columns if c.startswith(name)]
    return starts[0] if len(starts) == 1 else name


def filters(df: DataFrame, spec: dict[str, tuple[str, Any]], aliases: dict[str, str] | None = None) -> list[Column]:
    return [condition(df, canonical_column(n, df.columns, aliases), op, v) for n, (op, v) in spec.items()]


def leave_one_out(df: DataFrame, spec: dict[str, tuple[str, Any]]) -> DataFrame:
    """``(filter, n_without)``: rows that pass when one filter is removed, in one pass."""
    conds = filters(df, spec)
    names = list(spec)
    counts = [F.sum(F.when(all_of(conds[:i] + conds[i + 1 :]), 1).otherwise(0)).cast("bigint").alias(f"_{i}") for i in range(len(names))]
    row = df.agg(*counts)
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.coalesce(f"_{i}", F.lit(0)).alias("n_without")) for i, n in enumerate(names)))).alias("r")).select("r.*")


def exclusion_hits(df: DataFrame, name_col: str, needles: DataFrame, needle_col: str, *, cutoff: float = 0.8) -> DataFrame:
    """What each needle excludes: ``(needle, name, how)``; ``name`` is the key of the names, without width, case and blanks.

    ``how``: holds (the name holds the needle), held (the needle holds the name), close (no
    name does either: the one most similar from ``cutoff`` on, ties to the greater), or
    unmatched with a null name. Containment is decided once for each distinct name.
    """
    key = lambda c: squash(match_key(F.col(c)))
    names = df.select(key(name_col).alias("_t")).where(F.length("_t") > 0).distinct()
    list_ = needles.select(F.col(needle_col).alias("needle"), key(needle_col).alias("_n")).where(F.length("_n") > 0).distinct()
    keys = list_.select("_n").distinct()
    holds = contains_pairs(names, keys, text="_t", needle="_n").withColumn("how", F.lit("holds"))
    held = contains_pairs(keys, names, text="_n", needle="_t").where("_t <> _n").withColumn("how", F.lit("held"))
    sure = holds.unionByName(held)
    left = keys.join(sure.select("_n"), "_n", "left_anti")
    close = closest_match(left, names, left_col="_n", right_col="_t", cutoff=cutoff).select("_t", "_n", F.lit("close").alias("how"))
    found = sure.unionByName(close)
    return list_.join(found, "_n", "left").select("needle", F.col("_t").alias("name"), F.coalesce("how", F.lit("unmatched")).alias("how"))


def excluded(df: DataFrame, name_col: str, needles: DataFrame, needle_col: str, *, cutoff: float = 0.8) -> DataFrame:
    """Rows whose name no needle excludes (see :func:`exclusion_hits`); null names stay."""
    hit = exclusion_hits(df, name_col, needles, needle_col, cutoff=cutoff).where("name is not null").select(F.col("name").alias("_t")).distinct()
    return df.withColumn("_k", squash(match_key(F.col(name_col)))).join(hit, F.col("_k") == F.col("_t"), "left_anti").drop("_k")
