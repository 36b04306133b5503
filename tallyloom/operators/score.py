"""Scoring, ranking and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.predicates import all_of, filters


def weighted_score(weights: dict[str, float]) -> Column:
    """Sum of weight times number; what is no number counts 0."""
    out = F.lit(0.0)
    for c, w in weights.items():
        out = out + F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)) * F.lit(float(w))
    return out


def ranked(df: DataFrame, *, id_col: str, spec: dict | None = None, weights: dict[str, float] | None = None, sort_by: str | None = None, ascending: bool = False, skip: int = 0, top: int | None = None, on_empty: str = "empty") -> DataFrame:
    """Filtered rows by score or by a column, after the first ``skip``, at most ``top``.

    ``on_empty="unfiltered"`` gives the unfiltered ranking where nothing passes, with
    ``fallback`` true.
    """
    kept = df.where(all_of(filters(df, spec or {}))).withColumn("fallback", F.lit(False))
    if on_empty == "unfiltered" and kept.isEmpty():
        kept = df.withColumn("fallback", F.lit(True))
    kept = kept.withColumn("score", weighted_score(weights or {}))
    key = F.col(sort_by) if sort_by else F.col("score")
    out = kept.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), id_col)
    if skip:
        out = out.offset(skip)
    return out.limit(top) if top is not None else out


def unknown_last(c: str, ascending: bool = True) -> list[Column]:
    """Order in which nulls come last both ways."""
    return [F.col(c).isNull().asc(), F.col(c).asc() if ascending else F.col(c).desc()]


def verified(value: Column, document: Column, margin: float = 15.0) -> Column:
    """The document's value where it differs by more than the margin."""
    return F.when(F.abs(document - value) > margin, document).otherwise(value)


def budget_verdict(df: DataFrame, *, price: str, budget: float, wanted: int) -> DataFrame:
    """One row: rows within, over and without price, how many more are wanted, and the verdict."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    r = df.agg(n(F.col(price) <= budget).alias("within"), n(F.col(price) > budget).alias("over"), n(F.col(price).isNull()).alias("unknown"))
    r = r.na.fill(0).withColumn("refill", F.greatest(F.lit(0), F.lit(wanted) - F.col("within")))
    return r.withColumn("verdict", F.when(F.col("within") >= wanted, "ok").when(F.col("within") + F.col("unknown") >= wanted, "check").otherwise("refill"))


def refilled(ranked_rows: DataFrame, *, price: str, budget: float, wanted: int, order: list[Column]) -> DataFrame:
    """The first ``wanted`` rows that the budget allows, filled up once from the next ranks: ``rank`` and ``batch`` 1 or 2.

    As many further ranks are looked at as the first ``wanted`` left short, and those within
    the budget join; ranks beyond are not looked at. Rows without a price are not within, but
    where they could make up the number nothing is filled up.
    """
    top = ranked_rows.orderBy(*order).limit(2 * wanted)
    all_ = Window.partitionBy(F.lit(1))  # 2 * wanted rows at most
    top = top.withColumn("rank", F.row_number().over(all_.orderBy(*order)))
    first = F.col("rank") <= wanted
    count = lambda c: F.sum(F.when(first & c, 1).otherwise(0)).over(all_)
    within, unknown = count(F.col(price) <= budget), count(F.col(price).isNull())
    short = F.when(within + unknown >= wanted, 0).otherwise(F.lit(wanted) - within)
    top = top.withColumn("_last", F.lit(wanted) + short)
    return top.where((F.col("rank") <= F.col("_last")) & (F.col(price) <= budget)).withColumn("batch", F.when(first, 1).otherwise(2)).drop("_last")


def in_given_order(df: DataFrame, key: str, selection: list[str]) -> DataFrame:
    """The rows of a selection with ``ordinal``, their place in it; a key given twice has its first place."""
    places = {k: i for i, k in reversed(list(enumerate(selection, 1)))}
    chosen = df.sparkSession.createDataFrame(list(places.items()), "_k string, ordinal int")
    return df.join(F.broadcast(chosen), F.col(key).cast("string") == F.col("_k")).drop("_k")  # as many rows as the selection
