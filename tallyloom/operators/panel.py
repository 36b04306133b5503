"""Periods compared: changes, trends, ratios and lookups in a matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import safe_div


def last_periods(df: DataFrame, *, by: list[str], period: str, n: int = 3) -> DataFrame:
    """Rows of the newest ``n`` periods with ``period_idx`` counting back from 0."""
    return df.withColumn("period_idx", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc(period))) - 1).where(F.col("period_idx") < n)


def unpivoted(df: DataFrame, ids: list[str], items: list[str], scale: dict[str, float] | None = None) -> DataFrame:
    """Wide to long ``(ids, item, value)`` with a factor per item."""
    cols = [(F.col(i).cast("double") * (scale or {}).get(i, 1.0)).alias(i) for i in items]
    return df.unpivot(ids, cols, "item", "value")


def ratio_panel(df: DataFrame, ratios: dict[str, tuple[Column, Column]], digits: int = 2) -> DataFrame:
    """Ratios rounded half to even; null on a null side or a zero base."""
    return df.select("*", *(safe_div(a, b, digits).alias(n) for n, (a, b) in ratios.items()))


def changes(df: DataFrame, *, by: list[str], order: str, value: str, levels: tuple[float, float] = (0.10, 0.20)) -> DataFrame:
    """Change against the row before: ``change`` over the absolute base, and ``flag`` missing,
    zero_base, none, some or big."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    d = df.withColumn("before", before).withColumn("change", F.try_divide(F.col(value) - F.col("before"), F.abs("before")))
    size = F.abs("change")
    flag = F.when(F.col("before").isNull() | F.col(value).isNull(), "missing").when(F.col("before") == 0, "zero_base").when(size >= levels[1], "big").when(size >= levels[0], "some").otherwise("none")
    return d.withColumn("flag", flag)


def trend(df: DataFrame, *, by: list[str], order: str, value: str, worse_is_up: Column) -> DataFrame:
    """``direction`` better, worse or same against the row before, and ``worsening``: worse twice running."""
    w = Window.partitionBy(*by).orderBy(order)
    p1, p2 = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    step = lambda a, b: F.when(a == b, "same").when((a > b) == worse_is_up, "worse").otherwise("better")
    d = df.withColumn("_p1", p1).withColumn("_p2", p2)
    direction = F.when(F.col("_p1").isNotNull() & F.col(value).isNotNull(), step(F.col(value), F.col("_p1")))
    twice = F.coalesce((direction == "worse") & (step(F.col("_p1"), F.col("_p2")) == "worse") & F.col("_p2").isNotNull(), F.lit(False))
    return d.withColumn("direction", direction).withColumn("worsening", twice).drop("_p1", "_p2")


def against_last_filled(df: DataFrame, *, table: str, period: str, row: str, value: str) -> DataFrame:
    """Each value beside that of the latest earlier period in which the table has any value.

    Which period that is, is decided per table on one row per (table, period).
    """
    filled = df.groupBy(table, period).agg((F.count(value) > 0).alias("any"))
    w = Window.partitionBy(table).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    prev = filled.select(table, period, F.last(F.when(F.col("any"), F.col(period)), ignorenulls=True).over(w).alias("prev"))
    old = df.select(table, row, F.col(period).alias("prev"), F.col(value).alias("prev_value"))
    return df.join(prev, [table, period]).join(old, [table, row, "prev"], "left").withColumn("diff", F.col(value) - F.col("prev_value"))


def worst_row(df: DataFrame, *, by: list[str], label: str, ranks: list[str]) -> DataFrame:
    """The label of highest rank in each group."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(label))
    return df.groupBy(*by).agg(F.max_by(label, F.struct(rank, F.col(label))).alias(label))


def matrix_lookup(df: DataFrame, matrix: DataFrame, *, row: Column, column: Column) -> DataFrame:
    """Class of the cell of a small matrix (row, col, class)."""
    return df.withColumn("row", row).withColumn("col", column).join(matrix, ["row", "col"], "left")


def top_concerns(df: DataFrame, *, by: str, priority: str, severity: str, blocked: Column, most: int = 5) -> DataFrame:
    """The first ``most`` rows by priority, then severity, without blocked ones."""
    w = Window.partitionBy(by).orderBy(priority, F.desc(severity))
    return df.where(~blocked).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
