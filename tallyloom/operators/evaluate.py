"""Predictions against truth as bags of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bag_counts(df: DataFrame, keys: list[str], alias: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(alias))


def bag_overlap(truth: DataFrame, pred: DataFrame, *, by: list[str], fields: list[str]) -> DataFrame:
    """Rows of a group found with equal fields, duplicates counted: ``(by, n_truth, n_pred, n_hit)``.

    The intersection of bags as the sum of the lesser counts: no row is paired.
    """
    keys = [*by, *fields]
    both = bag_counts(truth, keys, "t").withColumn("p", F.lit(0)).unionByName(bag_counts(pred, keys, "p").withColumn("t", F.lit(0)))
    j = both.groupBy(*keys).agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    return j.groupBy(*by).agg(F.sum("t").alias("n_truth"), F.sum("p").alias("n_pred"), F.sum(F.least("t", "p")).alias("n_hit"))


def equal_bags(truth: DataFrame, pred: DataFrame, *, by: list[str], fields: list[str]) -> DataFrame:
    o = bag_overlap(truth, pred, by=by, fields=fields)
    return o.withColumn("equal", (F.col("n_truth") == F.col("n_hit")) & (F.col("n_pred") == F.col("n_hit")))


def group_rates(truth: DataFrame, pred: DataFrame, *, by: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """Share of groups whose bags agree on each set of fields: ``(level, n_groups, n_equal, rate)``."""
    out = None
    for name, fields in levels.items():
        e = equal_bags(truth, pred, by=by, fields=fields).agg(F.count("*").alias("n_groups"), F.sum(F.col("equal").cast("bigint")).alias("n_equal")).select(F.lit(name).alias("level"), "n_groups", "n_equal")
        out = e if out is None else out.unionByName(e)
    return out.withColumn("rate", F.try_divide(F.col("n_equal").cast("double"), F.col("n_groups")))


def line_outcomes(pairs: DataFrame, fields: list[str], truth: str = "a", pred: str = "b") -> DataFrame:
    """Paired lines: hits, and how often each field is wrong."""
    same = [F.col(f"{truth}.{f}").eqNullSafe(F.col(f"{pred}.{f}")) for f in fields]
    every = same[0]
    for s in same[1:]:
        every = every & s
    return pairs.agg(F.count("*").alias("n_pairs"), F.sum(every.cast("bigint")).alias("n_hit"), *(F.sum((~s).cast("bigint")).alias(f"wrong_{f}") for s, f in zip(same, fields, strict=True)))


def cell_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells that differ, one side missing included: ``(keys, a, b)``."""
    j = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b")))


def changed_groups(a: DataFrame, b: DataFrame, group: str, member: str) -> DataFrame:
    """Groups of one side whose set of members is no group of the other side, both ways."""
    sets = lambda d: d.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("members")).select("members")
    sa, sb = sets(a), sets(b)
    return sa.exceptAll(sb).withColumn("side", F.lit("a")).unionByName(sb.exceptAll(sa).withColumn("side", F.lit("b")))


def line_accuracy(truth: DataFrame, pred: DataFrame, *, keys: list[str], fields: list[str], truth_order: str, pred_order: str, review: str) -> tuple[DataFrame, DataFrame]:
    """Predicted lines against true ones: one row of counts, and how often each set of fields is wrong.

    The n-th line of a key meets the n-th of the same key. A prediction is a hit if all
    ``fields`` are equal (null counting as empty), wrong if not, and has no counterpart if the key
    has no line left; true lines left over are counted. Lines without ``review`` text are confirmed
    automatically; ``auto_error_rate`` is their share that is wrong or without counterpart.
    """
    number = lambda d, o: d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(o)))
    side = lambda d, n: d.select(*keys, "_n", F.struct(*(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in fields)).alias(n))
    t = side(number(truth, truth_order), "_t")
    p = side(number(pred, pred_order), "_p").withColumn("_here", F.lit(True))
    auto = number(pred, pred_order).select(*keys, "_n", (F.trim(F.coalesce(F.col(review).cast("string"), F.lit(""))) == "").alias("_auto"))
    j = p.join(auto, [*keys, "_n"]).join(t, [*keys, "_n"], "full_outer")
    wrong = F.array_compact(F.array(*(F.when(F.col(f"_t.{f}") != F.col(f"_p.{f}"), F.lit(f)) for f in fields)))
    both = F.col("_here") & F.col("_t").isNotNull()
    j = j.withColumn("_case", F.when(F.col("_here").isNull(), "left").when(F.col("_t").isNull(), "none").when(F.size(wrong) > 0, "wrong").otherwise("hit")).withColumn("_wrong", F.when(both, F.array_join(wrong, ",")))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    case, auto_ = F.col("_case"), F.coalesce(F.col("_auto"), F.lit(False))
    row = j.agg(
        n(case == "hit").alias("n_hit"), n(case == "wrong").alias("n_wrong"), n(case == "none").alias("n_none"), n(case == "left").alias("n_truth_left"),
        n(auto_).alias("n_auto"), n(auto_ & (case == "wrong")).alias("n_auto_wrong"), n(auto_ & (case == "none")).alias("n_auto_none"),
    ).na.fill(0)
    row = row.withColumn("auto_error_rate", F.try_divide((F.col("n_auto_wrong") + F.col("n_auto_none")).cast("double"), F.col("n_auto").cast("double")))
    return row, j.where(case == "wrong").groupBy(F.col("_wrong").alias("fields")).agg(F.count("*").alias("n"))


def extraction_score(records: DataFrame, covers: DataFrame, truth: DataFrame, *, by: str, keys: list[str], amount: str, total: str, ok: str, unit: int = 1000) -> DataFrame:
    """Per label: records, failed checks, records that are in the truth (as bags), and whether the sum of
    the records is within (n - 1) units of the covers' total, as n amounts cut to the unit may be.

    ``(by, n, n_failed, n_found, diff, within)``; n counts the covers in the tolerance.
    """
    r = records.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.when(~F.col(ok), 1).otherwise(0)).cast("bigint").alias("n_failed"), F.sum(amount).alias("_s"))
    found = bag_overlap(truth, records, by=[by], fields=keys).select(by, F.col("n_hit").alias("n_found"))
    c = covers.groupBy(by).agg(F.sum(total).alias("_t"), F.count("*").alias("_c"))
    j = r.join(found, by, "left").join(c, by, "left").withColumn("diff", F.col("_s") - F.col("_t"))
    return j.select(by, "n", "n_failed", F.coalesce("n_found", F.lit(0)).alias("n_found"), "diff", (F.abs("diff") <= F.greatest(F.col("_c") - 1, F.lit(0)) * unit).alias("within"))


def voucher_issues(lines: DataFrame, vouchers: DataFrame, *, key: str, line: str, amount: str, total: str, codes: list[str], memo: str, reasons: tuple[str, ...] = ("値引", "相殺")) -> DataFrame:
    """``(key, issue, line)`` of each fault: sum (the lines don't add up to a total that is not 0), zero (a line of 0),
    a code that is empty (by its name), negative (without a reason in the memo). Nulls count as 0 and empty."""
    a = F.coalesce(F.col(amount), F.lit(0))
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    told = F.lit(False)
    for r in reasons:
        told = told | F.coalesce(F.col(memo), F.lit("")).contains(r)
    each = F.array_compact(F.array(F.when(a == 0, "zero"), *(F.when(blank(c), F.lit(c)) for c in codes), F.when((a < 0) & ~told, "negative")))
    of_line = lines.select(key, F.explode(each).alias("issue"), F.col(line).alias("line"))
    sums = lines.groupBy(key).agg(F.sum(a).alias("_s"))
    off = vouchers.join(sums, key, "left").where((F.coalesce(total, F.lit(0)) != 0) & (F.coalesce("_s", F.lit(0)) != F.col(total)))
    return of_line.unionByName(off.select(key, F.lit("sum").alias("issue"), F.lit(None).cast(lines.schema[line].dataType).alias("line")))
