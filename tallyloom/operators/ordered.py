"""Operators on ordered rows: look-ahead, runs, windows of pages and group automata."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut


def look_ahead_sum(df: DataFrame, *, by: str, order: str, amount: str, most: int = 13, least: int = 2, tolerance: int = 3) -> DataFrame:
    """``n_parts``: how many of the rows after a row make up its amount; null if none do.

    The rows must be at least ``least`` and at most ``most``, and the running sum must not
    have passed the amount. The frame is bounded, so a row carries ``most`` values at most.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1, most)
    ahead = F.collect_list(amount).over(w)
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_a"), F.lit(1))), lambda k: F.aggregate(F.slice("_a", F.lit(1), k), F.lit(0).cast("decimal(38,2)"), lambda x, y: (x + y).cast("decimal(38,2)")))
    d = df.withColumn("_a", ahead).withColumn("_s", F.when(F.size("_a") > 0, sums).otherwise(F.array().cast("array<decimal(38,2)>")))
    fit = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1))), lambda k: (F.abs(F.get("_s", k - 1) - F.col(amount)) <= tolerance) & (k >= least))
    return d.withColumn("n_parts", F.get(fit, F.lit(0))).drop("_a", "_s")


def automaton(df: DataFrame, *, by: str, order: str, step: Callable[[object, dict], tuple[object, object]], start: object, out: str, out_type: str = "int") -> DataFrame:
    """Rows of a group in order through a state machine: ``step(state, row) -> (state, output)``.

    For groupings no window can express. Groups are sorted within their partition and
    streamed through in Arrow batches, so only the state is held, never a group.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(by)
    types = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, begun = start, None, False
        for b in batches:
            outputs = []
            for key, row in zip(b.column(at).to_pylist(), b.to_pylist(), strict=True):
                if not begun or key != last:
                    state, last, begun = start, key, True
                state, value = step(state, row)
                outputs.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(outputs, types[out_type])], names=[*b.schema.names, out])

    return df.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, f"{fields}, `{out}` {out_type}")


def drop_subtotals(df: DataFrame, *, by: str, order: str, amount: str, flag: str = "is_subtotal") -> DataFrame:
    """Marks rows equal to the sum of the run of two or more rows before them that no subtotal has used."""

    def step(state: tuple, row: dict) -> tuple:
        total, n = state
        value = row[amount]
        if n >= 2 and value is not None and total == value:
            return (0, 0), True
        return ((total + (value or 0)), n + (value is not None)), False

    return automaton(df, by=by, order=order, step=step, start=(0, 0), out=flag, out_type="boolean")


def page_groups(docs: DataFrame, *, file: str, order: str, kind: str, party: str, month: str, total: str, out: str = "group_no") -> DataFrame:
    """Documents of a file in page order to vouchers.

    A worksheet opens a voucher that takes all that follows until another worksheet; an
    attachment joins the open voucher or waits for the next body; a body of the same party
    and month, or a copy of the open total, joins it; any other body opens a new one.
    """

    def step(state: tuple, row: dict) -> tuple:
        no, mode, key, amount, waiting = state
        k = (row[party], row[month])
        if row[kind] == "worksheet":
            no = no if waiting else no + 1
            return (no, "worksheet", None, None, False), no
        if row[kind] == "attachment":
            if no == 0:
                return (1, "waiting", None, None, True), 1
            return state, no
        same = key is not None and (k == key or (row[party] == key[0] and row[total] == amount))
        if mode == "worksheet" or same:
            return (no, mode, key or k, amount if amount is not None else row[total], False), no
        no = no if waiting else no + 1
        return (no, "body", k, row[total], False), no

    return automaton(docs, by=file, order=order, step=step, start=(0, "", None, None, False), out=out)


def page_windows(pages: DataFrame, *, file: str, n_pages: str, size: int = 8, back: int = 1, ahead: int = 3) -> DataFrame:
    """Overlapping windows of pages: ``(file, window, first, last, own_first, own_last)``."""
    starts = F.sequence(F.lit(0), F.floor((F.col(n_pages) - 1) / size).cast("int"))
    w = pages.where(F.col(n_pages) > 0).select(file, n_pages, F.explode(starts).alias("window"))
    own_first = F.col("window") * size + 1
    own_last = F.least(own_first + size - 1, F.col(n_pages).cast("int"))
    return w.select(file, "window", F.greatest(own_first - back, F.lit(1)).alias("first"), F.least(own_last + ahead, F.col(n_pages).cast("int")).alias("last"), own_first.alias("own_first"), own_last.alias("own_last"))


def keep(df: DataFrame, keys: list[str], order: list[Column], *, most: int = 1) -> DataFrame:
    """First ``most`` rows of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def islands(df: DataFrame, *, by: str, value: str) -> DataFrame:
    """Runs of consecutive integers: ``(by, first, last, n)``."""
    d = df.select(by, value).where(F.col(value).isNotNull()).distinct()
    d = d.withColumn("_g", F.col(value) - F.row_number().over(Window.partitionBy(by).orderBy(value)))
    return d.groupBy(by, "_g").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("_g")


def page_text(df: DataFrame, *, by: str, first: str = "first", last: str = "last") -> DataFrame:
    """Runs as text such as ``p2-p6;p28``."""
    one = F.when(F.col(first) == F.col(last), F.concat(F.lit("p"), F.col(first).cast("string"))).otherwise(F.concat(F.lit("p"), F.col(first).cast("string"), F.lit("-p"), F.col(last).cast("string")))
    return df.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(first).alias("f"), one.alias("t")))), lambda x: x["t"]), ";").alias("pages"))


def drop_rolling(df: DataFrame, *, by: str, order: str, text: str) -> DataFrame:
    """Without rows whose text the next row of the group repeats with more."""
    nxt = F.lead(text).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_next", nxt).where(F.col("_next").isNull() | ~F.col("_next").startswith(F.col(text))).drop("_next")


def numbered(df: DataFrame, *, by: str, order: str, out: str = "line_no") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(order)))


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Rows numbered from 1 in a total order, without one task that sees them all.

    Ranges are sorted apart; the number of rows before each range comes from a table of one
    row per partition. ``order`` must be a total order for a defined result.
    """
    # numbered in the order of the ranges before they are written
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    parts = parts.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = parts.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(offsets), "_p").withColumn(out, F.col("_before") + F.col("_i") + 1).drop("_m", "_p", "_i", "_before")


def group_sequence(df: DataFrame, *, group: str, order: str) -> DataFrame:
    """Groups numbered by their first row: ``(group, seq)``."""
    firsts = df.groupBy(group).agg(F.min(order).alias("_o"))
    return global_rank(firsts, ["_o", group], "seq").drop("_o")
