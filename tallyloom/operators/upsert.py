"""Idempotent merges and change detection between an old and a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union by name in which each key keeps its row of highest ``order``, the new table's on ties."""
    u = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def merge_sets(old: DataFrame, new: DataFrame, key: str, *, first: str, sets: list[str]) -> DataFrame:
    """The old value of ``first`` stays where there is one; array columns become sorted unions."""
    o, n = old.alias("o"), new.alias("n")
    empty = F.array().cast("array<string>")
    union = [F.array_sort(F.array_union(F.coalesce(F.col(f"o.{s}"), empty), F.coalesce(F.col(f"n.{s}"), empty))).alias(s) for s in sets]
    return o.join(n, key, "full_outer").select(key, F.coalesce(f"o.{first}", f"n.{first}").alias(first), *union)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of the keys that the new table touches give way to the new rows."""
    missing = [k for k in keys if k not in old.columns or k not in new.columns]
    if missing:
        raise ValueError(f"key columns are missing: {missing}")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def not_yet(new: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key the sink doesn't have; with a partition key among ``keys`` it is pruned."""
    return new.join(done.select(*keys).distinct(), keys, "left_anti")


def fingerprint_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, state)``: new, changed, same or missing by comparing a struct of fields."""
    o = old.select(key, F.struct(*fields).alias("_o"), F.lit(True).alias("_in_o"))
    n = new.select(key, F.struct(*fields).alias("_n"), F.lit(True).alias("_in_n"))
    state = F.when(F.col("_in_o").isNull(), "new").when(F.col("_in_n").isNull(), "missing").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, state.alias("state"))


def duplicates_elsewhere(df: DataFrame, keys: list[str], own: str) -> DataFrame:
    """Rows whose key also occurs under another ``own`` value, counted before anything is paired."""
    several = df.groupBy(*keys).agg(F.min(own).alias("_lo"), F.max(own).alias("_hi")).where("_lo <> _hi").drop("_lo", "_hi")
    return df.join(several, keys, "left_semi")


def typed(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows cast to a schema, and the rows with a value that can't be cast, with ``bad`` naming the fields."""
    cast = [F.col(c).try_cast(t).alias(c) for c, t in types.items()]
    bad = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items())))
    d = df.withColumn("bad", bad)
    return d.where(F.size("bad") == 0).select(*cast), d.where(F.size("bad") > 0)
