"""Matching and reconciliation: containment, candidates, staged and greedy assignment."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyloom.session import cut


def grams(c: Column, size: int) -> Column:
    """Distinct character n-grams of a text; texts shorter than ``size`` have none."""
    n = F.length(c) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contains_pairs(texts: DataFrame, needles: DataFrame, *, text: str, needle: str, size: int = 3) -> DataFrame:
    """Distinct (text, needle) pairs in which the text holds the needle, without a nested loop.

    Every needle has one key: of its grams of ``size`` characters the one that the fewest
    texts hold (counted first); texts have all their grams. The equality join on the gram
    is verified. Needles shorter than ``size`` join on all their characters. A needle with
    a gram that no text holds meets nothing.
    """
    t = texts.select(F.col(text).alias("_t")).where(F.length("_t") > 0).distinct()
    n = needles.select(F.col(needle).alias("_n")).where(F.length("_n") > 0).distinct()
    all_sizes = F.array_union(grams(F.col("_t"), size), F.flatten(F.array(*(grams(F.col("_t"), k) for k in range(1, size))))) if size > 1 else grams(F.col("_t"), 1)
    g = t.select("_t", F.explode(all_sizes).alias("_g"))
    held = g.groupBy("_g").agg(F.count("*").alias("_df"))
    own = n.select("_n", F.explode(F.when(F.length("_n") < size, F.array("_n")).otherwise(grams(F.col("_n"), size))).alias("_g"))
    rarest = own.join(held, "_g", "left").groupBy("_n").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), "_g")).alias("_k")).where("_k._df > 0").select("_n", F.col("_k._g").alias("_g"))
    return g.join(rarest, "_g").where(F.col("_t").contains(F.col("_n"))).select(F.col("_t").alias(text), F.col("_n").alias(needle))


def resolve_alias(df: DataFrame, aliases: DataFrame, *, key: str, alias: str, code: str, evidence: str, least: int = 3) -> DataFrame:
    """Code of each distinct key: the exact alias of most evidence, else the longest alias of
    at least ``least`` signs that holds the key or is held by it; null where two codes tie.

    ``(key, code, how)``; ``how`` is exact, contains or none.
    """
    keys = df.select(F.col(key).alias("k")).where(F.col(key).isNotNull()).distinct()
    al = aliases.select(F.col(alias).alias("a"), F.col(code).alias("c"), F.col(evidence).alias("e")).where(F.length("a") > 0)
    exact = al.groupBy("a").agg(F.max(F.struct("e", F.col("c"))).alias("m")).select(F.col("a").alias("k"), F.col("m.c").alias("exact"))
    long = al.where(F.length("a") >= least).select("a", "c").distinct()
    left = keys.join(exact, "k", "left_anti")
    a_in_k = contains_pairs(left, long, text="k", needle="a")
    k_in_a = contains_pairs(long, left.where(F.length("k") >= least), text="a", needle="k")
    near = a_in_k.select("k", "a").unionByName(k_in_a.select("k", "a")).distinct().join(long, "a")
    top = near.groupBy("k", F.length("a").alias("len")).agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    top = top.groupBy("k").agg(F.max(F.struct("len", "lo", "hi")).alias("m")).select("k", F.when(F.col("m.lo") == F.col("m.hi"), F.col("m.lo")).alias("near"))
    out = keys.join(exact, "k", "left").join(top, "k", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "contains").otherwise("none")
    return out.select(F.col("k").alias(key), F.coalesce("exact", "near").alias(code), how.alias("how"))


def candidates(left: DataFrame, right: DataFrame, *, on: list[str], left_id: str, right_id: str, left_date: str, right_date: str, days: int, top: int = 30) -> DataFrame:
    """Right rows for each left row: same key and a date within the window, or without any such
    row the nearest dates of the same key; ``top`` of them, ``stage`` strict or fallback.

    Both stages are the nearest rows by date, so no group is paired: right rows are numbered
    by date, a left row learns its place among them as-of its date, and joins the ``top``
    numbers before and after it by equality. Rows without a date are no candidates and
    have none; equal gaps go to the smaller id.
    """
    l_ = left.where(F.col(left_date).isNotNull()).select(left_id, *on, F.col(left_date).cast("date").alias("_d"))
    r_ = right.where(F.col(right_date).isNotNull()).select(right_id, *on, F.col(right_date).cast("date").alias("_d"))
    both = l_.select(left_id, *on, "_d", F.lit(1).alias("_left")).unionByName(r_.select(*on, "_d", F.lit(0).alias("_left")), allowMissingColumns=True)
    place = F.sum(1 - F.col("_left")).over(Window.partitionBy(*on).orderBy("_d", "_left").rowsBetween(Window.unboundedPreceding, 0))
    size = F.sum(1 - F.col("_left")).over(Window.partitionBy(*on))
    placed = both.withColumn("_at", place).withColumn("_size", size).where("_left = 1").select(left_id, *on, "_d", "_at", "_size")
    number = lambda *o: F.row_number().over(Window.partitionBy(*on).orderBy("_d", *o)).cast("bigint")
    before = placed.withColumn("_rn", F.explode(F.sequence(F.greatest(F.col("_at") - top + 1, F.lit(1)), F.greatest(F.col("_at"), F.lit(1))))).where("_rn <= _at")
    after = placed.withColumn("_rn", F.explode(F.sequence(F.least(F.col("_at") + 1, F.col("_size")), F.least(F.col("_at") + top, F.col("_size"))))).where("_rn > _at")
    # rows of one date: the smaller id is the nearer one on both sides
    near = before.join(r_.withColumn("_rn", number(F.desc(right_id))).withColumnRenamed("_d", "_e"), [*on, "_rn"])
    near = near.unionByName(after.join(r_.withColumn("_rn", number(F.asc(right_id))).withColumnRenamed("_d", "_e"), [*on, "_rn"]))
    near = near.withColumn("gap", F.abs(F.datediff("_d", "_e")))
    w = Window.partitionBy(left_id).orderBy("gap", right_id)
    ranked = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    strict = F.min("gap").over(Window.partitionBy(left_id)) <= days
    ranked = ranked.withColumn("_strict", strict).where(~F.col("_strict") | (F.col("gap") <= days))
    return ranked.select(left_id, right_id, "gap", F.when(F.col("_strict"), "strict").otherwise("fallback").alias("stage"), "rank")


def unique_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once; counted with map-side combine before the rows move."""
    once = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return df.join(once, keys, "left_semi")


def staged_match(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, stages: list[tuple]) -> DataFrame:
    """One-to-one match in stages: a stage (name, keys) joins rows whose key is unique on both
    sides among those left over; a stage (name, keys, value) pairs groups of equal size by a
    value that occurs once in each (:func:`pair_equal_groups`). ``(left_id, right_id, stage)``.
    """
    out = None
    for name, keys, *value in stages:
        if out is not None:
            left = left.join(out.select(left_id), left_id, "left_anti")
            right = right.join(out.select(right_id), right_id, "left_anti")
        if value:
            pairs = pair_equal_groups(left.dropna(subset=keys), right.dropna(subset=keys), keys=keys, left_id=left_id, right_id=right_id, value=value[0])
        else:
            pairs = unique_on(left, keys).select(left_id, *keys).join(unique_on(right, keys).select(right_id, *keys), keys)
        hit = cut(pairs.select(left_id, right_id, F.lit(name).alias("stage")))
        out = hit if out is None else out.unionByName(hit)
    return out


def match_report(left: DataFrame, right: DataFrame, matched: DataFrame, *, left_id: str, right_id: str) -> DataFrame:
    """Matches with every miss of both sides."""
    lo = left.select(left_id).join(matched, left_id, "left_anti").select(left_id, F.lit(None).cast(right.schema[right_id].dataType).alias(right_id), F.lit("left_only").alias("stage"))
    ro = right.select(right_id).join(matched, right_id, "left_anti").select(F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), right_id, F.lit("right_only").alias("stage"))
    return matched.unionByName(lo).unionByName(ro)


def choose_by_overlap(keys: DataFrame, sheets: DataFrame, *, key: str, sheet: str, least: float = 0.5, margin: float = 0.25) -> DataFrame:
    """Share of the keys that each sheet holds; ``chosen`` if it is enough and well ahead of the second."""
    k = keys.select(key).distinct()
    n_keys = k.count()
    hits = sheets.select(sheet, key).distinct().join(k, key).groupBy(sheet).agg(F.count("*").alias("hits"))
    rate = hits.withColumn("rate", F.try_divide(F.col("hits").cast("double"), F.lit(n_keys)))
    two = rate.orderBy(F.desc("rate"), sheet).limit(2)
    lead = two.agg(F.min_by(sheet, F.struct(-F.col("rate"), sheet)).alias("_best"), F.when(F.count("*") > 1, F.min("rate")).otherwise(0.0).alias("_second"))
    ranked = rate.join(F.broadcast(lead))  # one row
    return ranked.select(sheet, "hits", "rate", ((F.col(sheet) == F.col("_best")) & (F.col("rate") >= least) & (F.col("rate") - F.col("_second") >= margin)).alias("chosen"))


def bag_pairs(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """Pairs of the n-th row of each key on both sides: every row is used at most once."""
    ra = a.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_a)))
    rb = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_b)))
    return ra.alias("a").join(rb.alias("b"), [*keys, "_rn"])


def similarity(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio; 0 where a side is missing."""
    return 0.0 if not a or not b else SequenceMatcher(None, a, b).ratio()


def _signs(c: Column) -> Column:
    """Characters of a text with their number among equal ones, so that a bag is a set."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def fuzzy_match(left: DataFrame, right: DataFrame, *, left_col: str, right_col: str, cutoff: float = 0.8) -> DataFrame:
    """Distinct left texts with the right ones at least ``cutoff`` similar: ``(left, right, ratio,
    n_right)``; one right text is a match, several are open.

    Prefix filtering that loses nothing: texts of lengths x and y and ratio r share at least
    r (x + y) / 2 characters, and y is at least r x / (2 - r), so they share r x / (2 - r) of the
    x characters. With all characters ordered by rarity (counted over both sides), two such
    texts share one among the first x - ceil(r x / (2 - r)) + 1 of each. These are the keys of the
    equality join; lengths and the whole bags are compared before a pair is verified.
    """
    least = cutoff / (2 - cutoff)
    texts = lambda d, c: d.select(F.col(c).alias("t")).where(F.length("t") > 0).distinct().select("t", _signs(F.col("t")).alias("s"))
    ta, tb = texts(left, left_col), texts(right, right_col)
    rarity = ta.unionByName(tb).select(F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("n"))

    def keyed(d: DataFrame, name: str) -> DataFrame:
        order = d.select("t", F.explode("s").alias("g")).join(rarity, "g").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("o"))
        first = F.slice("o", F.lit(1), F.greatest(F.lit(1), F.size("o") - F.ceil(least * F.size("o") - 1e-9).cast("int") + 1))
        return order.select(F.col("t").alias(name), F.transform("o", lambda x: x["g"]).alias(f"s_{name}"), F.explode(first).alias("k")).select(name, f"s_{name}", F.col("k.g").alias("g"))

    both = F.size("s_a") + F.size("s_b")
    near = (F.size("s_a") >= least * F.size("s_b")) & (F.size("s_b") >= least * F.size("s_a")) & (2 * F.size(F.array_intersect("s_a", "s_b")) >= cutoff * both - 1e-9)
    pairs = keyed(ta, "a").join(keyed(tb, "b"), "g").where(near).select("a", "b").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ra, rb = x.column(0).to_pylist(), x.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([similarity(p, q) for p, q in zip(ra, rb, strict=True)], pa.float64())], names=["a", "b", "ratio"])

    hit = pairs.mapInArrow(run, "a string, b string, ratio double").where(F.col("ratio") >= cutoff)
    n = hit.groupBy("a").agg(F.count("*").alias("n_right"))
    return hit.join(n, "a").select(F.col("a").alias(left_col), F.col("b").alias(right_col), "ratio", "n_right")


def closest_match(left: DataFrame, right: DataFrame, *, left_col: str, right_col: str, cutoff: float = 0.5) -> DataFrame:
    """The most similar right text of each left text, ties to the greater text: ``(left, right, ratio)``."""
    f = fuzzy_match(left.select(F.col(left_col).alias("_l")), right.select(F.col(right_col).alias("_r")), left_col="_l", right_col="_r", cutoff=cutoff)
    return f.groupBy("_l").agg(F.max(F.struct("ratio", "_r")).alias("m")).select(F.col("_l").alias(left_col), F.col("m._r").alias(right_col), "m.ratio")


#: Pairs of a group that one task streams through in order; larger groups go on in rounds.
FIT = 1_000_000


def greedy_assign(pairs: DataFrame, *, by: str, left: str, right: str, score: str, rounds: int = 3, fit: int = FIT) -> DataFrame:
    """Greedy one-to-one assignment within each group by descending score, ties to larger ids.

    Rounds of mutual best pairs give the same result as the sequential greedy choice, in
    parallel for all groups, and take off most pairs. After ``rounds`` of them groups of at
    most ``fit`` pairs are sorted and streamed through one pass, which holds only the ids
    assigned; larger groups go on in rounds.
    """
    schema = pairs.select(by, left, right, score).schema
    rest = cut(pairs.select(by, left, right, score).where(F.col(score).isNotNull()))
    parts = []

    def best(of: str) -> DataFrame:
        return rest.groupBy(by, of).agg(F.max(F.struct(score, left, right)).alias("m")).select(by, "m.*")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: object = None
        used_l: set = set()
        used_r: set = set()
        started = False
        for b in batches:
            keep = []
            for i, (g, x, y) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)):
                if not started or g != group:
                    group, used_l, used_r, started = g, set(), set(), True
                if x not in used_l and y not in used_r:
                    used_l.add(x)
                    used_r.add(y)
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    done = 0
    while True:
        chosen = cut(best(left).join(best(right), [by, score, left, right]).select(by, left, right, score))
        if chosen.isEmpty():
            break
        parts.append(chosen)
        rest = cut(rest.join(chosen.select(by, left), [by, left], "left_anti").join(chosen.select(by, right), [by, right], "left_anti"))
        done += 1
        if done >= rounds:
            small = rest.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") <= fit).select(by)
            ready = rest.join(small, by, "left_semi").select(by, left, right, score).repartition(by).sortWithinPartitions(by, F.desc(score), F.desc(left), F.desc(right))
            parts.append(cut(ready.mapInArrow(stream, schema)))
            rest = cut(rest.join(small, by, "left_anti"))
    out = parts[0] if parts else rest
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vendor_candidates(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, name: str, date: str, days: int, top: int = 30) -> DataFrame:
    """Right rows that a left row may stand for: ``(left_id, right_id, gap, stage)``.

    Stage vendor: the normalised names hold one another, and the dates are within ``days`` or
    one is missing; all such rows. Left rows without any go to stage fallback: rows of any
    name within ``days``, both dates given, by day gap, then similarity of the names, then
    id; ``top`` of them.

    Names meet once for each distinct pair, dates by buckets of ``days``, so nothing is
    compared outside neighbouring buckets. The fallback looks only as far in days as it
    takes to have ``top`` rows, and compares distinct names, each with its ``top`` least ids.
    """
    d = F.col(date).cast("date")
    l_ = left.select(F.col(left_id).alias("_l"), F.col(name).alias("_ln"), d.alias("_ld"))
    r_ = right.select(F.col(right_id).alias("_r"), F.col(name).alias("_rn"), d.alias("_rd"))
    names_l, names_r = l_.select("_ln").distinct(), r_.select("_rn").distinct()
    pairs = contains_pairs(names_l, names_r, text="_ln", needle="_rn").unionByName(contains_pairs(names_r, names_l, text="_rn", needle="_ln").select("_ln", "_rn")).distinct()
    named = l_.join(pairs, "_ln")
    width = days + 1
    bucket = lambda c: F.floor(F.unix_date(c) / width)
    dated = named.where("_ld is not null").withColumn("_b", bucket(F.col("_ld")))
    near = r_.where("_rd is not null").withColumn("_b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda o: bucket(F.col("_rd")) + o)))
    within = F.abs(F.datediff("_ld", "_rd"))
    hits = dated.join(near, ["_rn", "_b"]).where(within <= days).select("_l", "_r", within.alias("gap"))
    open_ = named.where("_ld is null").join(r_, "_rn").select("_l", "_r", F.lit(None).cast("int").alias("gap"))
    open_ = open_.unionByName(dated.drop("_b").join(r_.where("_rd is null"), "_rn").select("_l", "_r", F.lit(None).cast("int").alias("gap")))
    vendor = cut(hits.unionByName(open_))
    rest = cut(l_.where("_ld is not null").join(vendor.select("_l"), "_l", "left_anti"))
    # how many days it takes to have enough rows, for each date of the left side
    per_day = r_.where("_rd is not null").groupBy("_rd").agg(F.count("*").alias("_c"))
    around = rest.select("_ld").distinct().withColumn("_o", F.explode(F.sequence(F.lit(-days), F.lit(days)))).withColumn("_rd", F.expr("date_add(_ld, _o)")).join(per_day, "_rd").withColumn("gap", F.abs("_o"))
    so_far = F.sum("_c").over(Window.partitionBy("_ld").orderBy("gap").rangeBetween(Window.unboundedPreceding, -1))
    wanted = around.withColumn("_before", F.coalesce(so_far, F.lit(0))).where(F.col("_before") < top).select("_ld", "_rd", "gap")  # 2 days + 1 rows a date
    least = F.slice(F.array_sort(F.collect_list("_r")), 1, top)
    by_name = r_.where("_rd is not null").withColumn("_rn", F.coalesce("_rn", F.lit(""))).withColumn("_k", F.row_number().over(Window.partitionBy("_rd", "_rn").orderBy("_r"))).where(F.col("_k") <= top).groupBy("_rd", "_rn").agg(least.alias("_ids"))
    meet = rest.select(F.coalesce("_ln", F.lit("")).alias("_ln"), "_ld").distinct().join(wanted, "_ld").join(by_name, "_rd")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("sim", pa.array([similarity(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)], pa.float64()))

    shape = meet.select("_ln", "_ld", "_rd", "gap", "_rn", "_ids")
    scored = shape.mapInArrow(alike, StructType([*shape.schema.fields, StructField("sim", DoubleType())])).select("_ln", "_ld", "gap", "sim", F.explode("_ids").alias("_r"))
    w = Window.partitionBy("_ln", "_ld").orderBy("gap", F.desc("sim"), "_r")
    best = scored.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top)
    fallback = rest.withColumn("_ln", F.coalesce("_ln", F.lit(""))).join(best, ["_ln", "_ld"]).select("_l", "_r", "gap", F.lit("fallback").alias("stage"))
    return vendor.withColumn("stage", F.lit("vendor")).unionByName(fallback).select(F.col("_l").alias(left_id), F.col("_r").alias(right_id), "gap", "stage")


def sum_within(left: DataFrame, right: DataFrame, *, on: str, total: str, amount: str, tolerance: int) -> DataFrame:
    """Groups whose parts sum to the total within a tolerance: ``(on, total, parts, diff, ok)``."""
    s = right.groupBy(on).agg(F.sum(amount).alias("parts"))
    j = left.join(s, on, "left").withColumn("diff", F.col(total) - F.coalesce("parts", F.lit(0)))
    return j.withColumn("ok", F.abs("diff") <= tolerance)


def near_amounts(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, left_amount: str, right_amount: str, tolerance: int) -> DataFrame:
    """Pairs of amounts within a tolerance by an equality join on integer buckets and neighbours."""
    width = tolerance + 1
    a = left.select(left_id, F.col(left_amount).alias("_a"), F.floor(F.col(left_amount) / width).alias("_b"))
    b = right.select(right_id, F.col(right_amount).alias("_c"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col(right_amount) / width) + d)).alias("_b"))
    return a.join(b, "_b").where(F.abs(F.col("_a") - F.col("_c")) <= tolerance).select(left_id, right_id, (F.col("_a") - F.col("_c")).alias("diff"))


def exact_cover(groups: DataFrame, required: DataFrame, *, by: str, item: str) -> DataFrame:
    """Owners whose groups hold every required item exactly once: ``(by, missing, extra, twice, ok)``."""
    g = groups.groupBy(by, item).agg(F.count("*").alias("n"))
    r = required.select(by, item).distinct().withColumn("req", F.lit(True))
    j = r.join(g, [by, item], "full_outer")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    out = j.groupBy(by).agg(n(F.col("n").isNull()).alias("missing"), n(F.col("req").isNull()).alias("extra"), n(F.col("n") > 1).alias("twice"))
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("twice") == 0))


def compare_runs(runs: DataFrame, *, run: str, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """Fields in which runs of one extraction differ, by key and ordinal: ``(keys, ordinal, field, n_values, n_runs)``."""
    w = Window.partitionBy(run, *keys).orderBy(order)
    r = runs.withColumn("ordinal", F.row_number().over(w))
    long = r.unpivot([run, *keys, "ordinal"], [F.col(f).cast("string").alias(f) for f in fields], "field", "value")
    n_runs = runs.select(run).distinct().count()
    cell = long.groupBy(*keys, "ordinal", "field").agg(F.count_distinct(F.coalesce("value", F.lit("\x00"))).alias("n_values"), F.count_distinct(run).alias("n_runs"))
    return cell.where((F.col("n_values") > 1) | (F.col("n_runs") < n_runs))


def pair_equal_groups(left: DataFrame, right: DataFrame, *, keys: list[str], left_id: str, right_id: str, value: str) -> DataFrame:
    """Groups of equal size on both sides, paired by their value where no value occurs twice in a group."""
    size = lambda d: d.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_distinct(value).alias("_v"))
    a, b = size(left), size(right)
    good = a.join(b, [*keys, "_n", "_v"]).where("_n = _v").select(*keys)
    w = Window.partitionBy(*keys).orderBy(value)
    ra = left.join(good, keys, "left_semi").withColumn("_rn", F.row_number().over(w))
    rb = right.join(good, keys, "left_semi").withColumn("_rn", F.row_number().over(w))
    return ra.select(left_id, *keys, "_rn").join(rb.select(right_id, *keys, "_rn"), [*keys, "_rn"]).select(left_id, right_id)


def truncated_totals(covers: DataFrame, blocks: DataFrame, *, cover: str, block: str, total: str, amount: str, unit: int = 1000) -> DataFrame:
    """Covers matched to blocks whose sum cut to the unit is their total; each block is used once, in order."""
    b = blocks.groupBy(block).agg(F.sum(amount).alias("_s")).select(block, (F.floor(F.col("_s") / unit) * unit).cast("bigint").alias(total))
    c = covers.select(cover, F.col(total).cast("bigint").alias(total))
    p = bag_pairs(c, b, [total], [cover], [block])
    return p.select(f"a.{cover}", f"b.{block}", total)


def owned(docs: DataFrame, lines: DataFrame, *, doc: str, first_page: str, own_first: str, own_last: str) -> tuple[DataFrame, DataFrame]:
    """Documents that start in their own page range, and the lines that belong to them."""
    kept = docs.where((F.col(first_page) >= F.col(own_first)) & (F.col(first_page) <= F.col(own_last)))
    return kept, lines.join(kept.select(doc), doc, "left_semi")
