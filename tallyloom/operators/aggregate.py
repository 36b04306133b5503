"""Aggregations: subtotals, modes, folds and merges. Sums are taken over decimals."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.session import bounded_rows


def by_class(df: DataFrame, keys: list[str], class_col: str, amount: str, classes: dict[str, list[str]]) -> DataFrame:
    """Sums of an amount for several classes in one pass; classes may overlap. Absent classes are 0."""
    sums = [F.coalesce(F.sum(F.when(F.col(class_col).isin(*members), F.col(amount))), F.lit(0).cast("decimal(38,2)")).alias(name) for name, members in classes.items()]
    return df.groupBy(*keys).agg(*sums)


def with_subtotals(df: DataFrame, region: str, branch: str, amount: str, *, unit: int = 1, digits: int = 3) -> DataFrame:
    """Branch rows, a subtotal per region and a grand total over the branches only.

    ``level`` is branch, region or total; sums are exact, then divided by ``unit`` and rounded.
    """
    r = df.rollup(region, branch).agg(F.sum(amount).alias("_s"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 0, "branch").when(F.col("_g") == 1, "region").otherwise("total")
    return r.select(level.alias("level"), region, branch, F.round(F.col("_s") / unit, digits).alias("value"))


def subtotals_of_rounded(df: DataFrame, region: str, branch: str, amount: str, *, unit: int = 1, digits: int = 0) -> DataFrame:
    """As ``with_subtotals``, but subtotals add what the branch rows show."""
    shown = df.groupBy(region, branch).agg(F.round(F.sum(amount) / unit, digits).alias("_v"))
    r = shown.rollup(region, branch).agg(F.sum("_v").alias("value"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 0, "branch").when(F.col("_g") == 1, "region").otherwise("total")
    return r.select(level.alias("level"), region, branch, "value")


def zero_filled(df: DataFrame, dims: list[DataFrame], value: str, limit: int = 100_000) -> DataFrame:
    """Every combination of small dimensions (each one column), absent ones with 0.

    The members of the dimensions are few (checked), so the grid is made of them directly.
    """
    members = [[r[0] for r in bounded_rows(d.distinct(), limit, "a dimension")] for d in dims]
    if math.prod(map(len, members)) > limit:
        raise ValueError(f"the grid has more than {limit} cells")
    schema = StructType([d.schema.fields[0] for d in dims])
    grid = df.sparkSession.createDataFrame(list(itertools.product(*members)), schema)
    return grid.join(df, grid.columns, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def grouped_lines(df: DataFrame, keys: list[str], *, order: str, amount: str, text: str, first: str, sep: str = "; ") -> DataFrame:
    """Lines of a group (null keys form groups): sum that is null only if all are, texts joined in
    order, first known value, order of appearance."""
    texts = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    known = F.min(F.when(F.col(first).isNotNull(), F.struct(order, first)))
    return df.groupBy(*keys).agg(
        F.min(order).alias("first_seen"), F.sum(amount).alias("amount"), bounded(F.array_join(F.transform(texts, lambda x: x[text]), sep), "grouped_lines").alias("texts"), known[first].alias(first), F.count("*").alias("n_lines")
    )


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent known value of a group, ties to the one seen first: ``(keys, value, n, n_values)``.

    Values are counted first, so only one row per (group, value) is ranked.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_o"))
    best = F.min_by(F.col(value), F.struct(-F.col("n"), F.col("_o"), F.col(value)))
    return c.groupBy(*keys).agg(best.alias(value), F.max("n").alias("n"), F.count("*").alias("n_values"))


def set_merge(df: DataFrame, key: str, *, values: str, first: str, order: str, sep: str | None = None) -> DataFrame:
    """Set of all values of a key, sorted, and the value of ``first`` seen first."""
    item = F.explode_outer(F.split(F.col(values), sep)) if sep else F.explode_outer(values) if dict(df.dtypes)[values].startswith("array") else F.col(values)
    e = df.select(key, order, first, item.alias("_v"))
    clean = F.when(F.trim("_v") != "", F.trim("_v"))
    return e.groupBy(key).agg(F.min_by(first, order).alias(first), F.array_sort(F.collect_set(clean)).alias(values))


def counts_of_counts(df: DataFrame, group: str, key: str) -> DataFrame:
    """Histogram of the number of rows per key in each group."""
    return df.groupBy(group, key).agg(F.count("*").alias("n_lines")).groupBy(group, "n_lines").agg(F.count("*").alias("n_keys"))


def pair_counts(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """How often each pair occurs for each key, with its rank."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by, a, b).agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), a, b)))


def rates(df: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Counts of rows for which each flag holds, and of all rows."""
    aggs = [F.sum(F.when(c, 1).otherwise(0)).cast("bigint").alias(n) for n, c in flags.items()]
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *aggs)


def fold_bodies(docs: DataFrame, *, by: str, total: str, order: str, tolerance: int = 3) -> DataFrame:
    """Documents that count: one whose total is the sum of at least two others counts alone; copies
    of a total count once. Adds ``counts``."""
    d = docs.withColumn("_k", F.xxhash64(F.col(by).isNull(), by))  # null keys are a group
    sums = d.groupBy("_k").agg(F.sum(total).alias("_s"), F.count("*").alias("_n"))
    rest = F.col("_s") - F.col(total)
    d = d.join(sums, "_k").withColumn("_cover", F.coalesce((F.abs(rest - F.col(total)) <= tolerance) & (F.col("_n") >= 3), F.lit(False)))
    covers = d.where("_cover").groupBy("_k").agg(F.min(order).alias("_first_cover"))
    copies = d.groupBy("_k", F.coalesce(F.col(total).cast("string"), F.lit("")).alias("_t")).agg(F.min(order).alias("_first_copy"))
    d = d.withColumn("_t", F.coalesce(F.col(total).cast("string"), F.lit(""))).join(covers, "_k", "left").join(copies, ["_k", "_t"])
    counts = F.when(F.col("_first_cover").isNotNull(), F.col(order) == F.col("_first_cover")).otherwise(F.col(order) == F.col("_first_copy"))
    return d.select(*docs.columns, counts.alias("counts"))


#: Rows that one row of a result may be joined from; more is an error.
MOST = 100_000


def bounded(c: Column, what: str, most: int = MOST) -> Column:
    """An aggregate that holds all rows of its group, or an error where there are too many."""
    return F.when(F.count("*") <= most, c).otherwise(F.raise_error(F.lit(f"a group of {what} has more than {most} rows")))


def fold_across(df: DataFrame, keys: list[str], *, order: Column, arrays: list[str], scalars: list[str]) -> DataFrame:
    """One row per key: scalars of the first row, arrays of all rows joined in order."""
    d = df.withColumn("_o", order)
    first = F.min(F.struct("_o", *scalars))

    def in_order(a: str) -> Column:
        return bounded(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(a)))), lambda x: x[a])), "fold_across").alias(a)

    joined = [in_order(a) for a in arrays]
    return d.groupBy(*keys).agg(first.alias("_f"), *joined, F.count("*").alias("n_folded")).select(*keys, *(F.col(f"_f.{s}").alias(s) for s in scalars), *arrays, "n_folded")


def bars(events: DataFrame, key: str, time: str, kind: str, start: str, end: str) -> DataFrame:
    """Start and end of each task from its log."""
    return events.groupBy(key).agg(F.min(F.when(F.col(kind) == start, F.col(time))).alias("started"), F.max(F.when(F.col(kind) == end, F.col(time))).alias("ended"))


def changes_summary(df: DataFrame, key: str, now: str, before: str, top: int = 3) -> DataFrame:
    """Difference and rate (null on a zero base) of each key; ``rank_up`` numbers the largest increases."""
    d = df.withColumn("diff", F.col(now) - F.col(before)).withColumn("rate", F.try_divide(F.col("diff"), F.col(before)))
    best = d.where("diff > 0").orderBy(F.desc("diff"), key).limit(top)
    best = best.select(key, F.row_number().over(Window.orderBy(F.desc("diff"), key)).alias("rank_up"))  # at most ``top`` rows
    return d.join(F.broadcast(best), key, "left")


def mode_of_main(df: DataFrame, *, main: str, value: str, order: str) -> DataFrame:
    """All rows of the most frequent ``main`` take its most frequent ``value``; ties to the first seen."""
    top = majority(df.withColumn("_g", F.lit(1)), ["_g"], main, order).select(F.col(main))
    best = majority(df.join(F.broadcast(top), main, "left_semi"), [main], value, order).select(main, F.col(value).alias("_best"))
    return df.join(F.broadcast(best), main, "left").withColumn(value, F.coalesce("_best", value)).drop("_best")


def require_present(df: DataFrame, column: str, values: list) -> DataFrame:
    """One row: the required values that a column lacks, and whether all are there."""
    need = F.array(*map(F.lit, values))
    found = df.where(F.col(column).isin(*values)).agg(F.collect_set(column).alias("_f"))
    return found.select(F.array_sort(F.array_except(need, "_f")).alias("missing")).withColumn("ok", F.size("missing") == 0)


def adopted(candidates: DataFrame, *, by: str, amount: str, sums: list[str], tolerance: int = 3) -> DataFrame:
    """Name of the first candidate sum within the tolerance of the amount, in order of priority; else the last."""
    choice = F.lit(sums[-1])
    for s in reversed(sums[:-1]):
        choice = F.when(F.coalesce(F.abs(F.col(s) - F.col(amount)) <= tolerance, F.lit(False)), F.lit(s)).otherwise(choice)
    return candidates.withColumn("adopted", choice)


def majority_page(df: DataFrame, keys: list[str], value: str, page: str) -> DataFrame:
    """:func:`majority` with ``page``, the first page on which the adopted value stands."""
    best = majority(df, keys, value, page)
    pages = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(page).alias("page"))
    return best.join(pages, [*keys, value])


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every known value, with its number, of the groups that hold more than one: ``(keys, value, n)``."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    several = c.groupBy(*keys).agg(F.count("*").alias("_k")).where("_k > 1").drop("_k")
    return c.join(several, keys, "left_semi")


def best_page(wanted: DataFrame, coords: DataFrame, adopted: DataFrame, citations: DataFrame, *, source: str = "source", item: str = "item", value: str = "value", page: str = "page", order: str = "ord") -> DataFrame:
    """The page (from 1) that shows each wanted (source, item, value), through five fall-backs: ``page`` and ``how``.

    adopted: the adopted page (from 0) has a place with the value; value: the least page with one;
    item: the least page with a place of the item; unplaced: the adopted page all the same; cited:
    the page of the first citation of the source, or else of the first of all; none: 0.
    """
    k = [source, item]
    a = adopted.groupBy(*k).agg(F.min(page).alias("_a"))
    by_item = coords.groupBy(*k).agg(F.min(page).alias("_any"))
    by_value = coords.where(F.col(value).isNotNull()).groupBy(*k, value).agg(F.min(page).alias("_exact"))
    on = coords.join(a, k).where(F.col(page) == F.col("_a")).select(*k, value).distinct().withColumn("_on", F.lit(True))
    own = citations.groupBy(source).agg(F.min_by(page, order).alias("_cite"))
    first = citations.agg(F.min_by(page, order).alias("_first"))  # one row
    j = wanted.join(a, k, "left").join(on, [*k, value], "left").join(by_value, [*k, value], "left").join(by_item, k, "left").join(own, source, "left").join(F.broadcast(first))
    how = F.when(F.col("_on"), "adopted").when(F.col("_exact").isNotNull(), "value").when(F.col("_any").isNotNull(), "item").when(F.col("_a").isNotNull(), "unplaced").when(F.coalesce("_cite", "_first").isNotNull(), "cited").otherwise("none")
    at = F.when(F.col("_on"), F.col("_a") + 1).otherwise(F.coalesce(F.col("_exact") + 1, F.col("_any") + 1, F.col("_a") + 1, F.col("_cite"), F.col("_first"), F.lit(0)))
    return j.select(*k, value, at.cast("int").alias("page"), how.alias("how"))


def merged_summaries(df: DataFrame, keys: list[str], *, order: str, lists: list[str], texts: list[str], sep: str = "\n") -> DataFrame:
    """Summaries of the batches of a key as one: lists joined in order without repeats, texts joined in order without blanks.

    A key has as many rows as it had batches, which bounds what one row holds.
    """
    out = []
    for c in lists:
        rows = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v"))))
        out.append(bounded(F.array_distinct(F.flatten(F.transform(rows, lambda x: x["v"]))), "merged_summaries").alias(c))
    for c in texts:
        rows = F.array_sort(F.collect_list(F.when(F.trim(c) != "", F.struct(order, F.col(c).alias("v")))))
        out.append(bounded(F.array_join(F.transform(rows, lambda x: x["v"]), sep), "merged_summaries").alias(c))
    return df.groupBy(*keys).agg(F.count("*").alias("n_batches"), *out)


def gathered(df: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """The least non-blank value of each field in a group, and whether there was one, several or none: ``<field>_is``."""
    aggs = []
    for f in fields:
        v = F.when(F.trim(f) != "", F.trim(f))
        aggs += [F.min(v).alias(f), F.when(F.min(v).isNull(), "none").when(F.min(v) == F.max(v), "one").otherwise("several").alias(f"{f}_is")]
    return df.groupBy(*by).agg(*aggs)
