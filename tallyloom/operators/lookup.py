"""Lookups against dimension tables. All are equality joins; Catalyst broadcasts a
dimension whose size it knows to be small and shuffles otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut


def code_lookup(df: DataFrame, rules: DataFrame, *, code_col: str, stages: list[str], sep: str = "-") -> DataFrame:
    """Segments of a code, each looked up under its stage: a column per stage.

    ``rules``: (stage, input, output). A missing segment or rule gives null.
    """
    parts = F.split(F.col(code_col), sep)
    out = df
    for i, stage in enumerate(stages):
        r = rules.where(F.col("stage") == stage).select(F.col("input").alias("_in"), F.col("output").alias(stage)).dropDuplicates(["_in"])
        out = out.withColumn("_in", F.get(parts, F.lit(i))).join(r, "_in", "left").drop("_in")
    return out


def lookup_twice(df: DataFrame, dim: DataFrame, *, key: str, dim_key: str, second: Column, value: str) -> DataFrame:
    """Value by key, or else by a second key such as the one without leading zeros."""
    d = dim.select(F.col(dim_key).alias("_k"), F.col(value).alias("_v")).dropDuplicates(["_k"])
    a = df.join(d.select(F.col("_k").alias("_k1"), F.col("_v").alias("_v1")), F.col(key) == F.col("_k1"), "left")
    b = a.join(d.select(F.col("_k").alias("_k2"), F.col("_v").alias("_v2")), second == F.col("_k2"), "left")
    return b.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_k2", "_v1", "_v2")


def missing_codes(df: DataFrame, masters: dict[str, DataFrame]) -> DataFrame:
    """Rows of which a code is in no master: ``missing`` names them. Each master: one column."""
    out = df
    flags = []
    for c, m in masters.items():
        k = m.columns[0]
        known = m.select(F.col(k).alias(f"_{c}")).where(F.col(k).isNotNull()).distinct().withColumn(f"_has_{c}", F.lit(True))
        out = out.join(known, F.col(c) == F.col(f"_{c}"), "left")
        flags.append(F.when(F.col(c).isNotNull() & F.col(f"_has_{c}").isNull(), F.lit(c)))
    out = out.withColumn("missing", F.array_compact(F.array(*flags))).where(F.size("missing") > 0)
    return out.drop(*(x for c in masters for x in (f"_{c}", f"_has_{c}")))


def unseen_pairs(df: DataFrame, history: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs that the history never had; silent where the history is empty."""
    seen = history.select(a, b).distinct()
    new = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    return new.limit(0) if history.isEmpty() else new.join(seen, [a, b], "left_anti")


def first_row_lookup(df: DataFrame, dim: DataFrame, *, on: str, order: str, values: dict[str, object]) -> DataFrame:
    """First row of the dimension by ``order`` for each key, with defaults where there is none."""
    first = dim.groupBy(on).agg(F.min(F.struct(order, *values)).alias("_f"))
    out = df.join(first, on, "left")
    for v, default in values.items():
        out = out.withColumn(v, F.coalesce(F.col(f"_f.{v}"), F.lit(default)))
    return out.drop("_f")


def inherit(children: DataFrame, parents: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Children take attributes of their parent where they have none."""
    p = parents.select(on, *(F.col(f).alias(f"_p_{f}") for f in fields))
    out = children.join(p, on, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f, f"_p_{f}"))
    return out.drop(*(f"_p_{f}" for f in fields))


def agreed_value(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value of a group if all its rows that have one agree, else null; and how many there are."""
    return df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count_distinct(value).alias("n_values")).select(*by, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(value), "n_values")


def spread_if_absent(df: DataFrame, by: str, field: str, fallback: str) -> DataFrame:
    """The group's fallback for all its rows if none of them has the field."""
    w = Window.partitionBy(by)
    has = F.max(F.col(field).isNotNull()).over(w)
    return df.withColumn(field, F.when(has, F.col(field)).otherwise(F.max(fallback).over(w)))


def known_references(df: DataFrame, known: DataFrame, *, id_col: str, refs_col: str, ref_key: str) -> DataFrame:
    """References that exist, in order; rows with none left are dropped."""
    r = df.select(id_col, F.posexplode(refs_col).alias("pos", ref_key)).join(known.select(ref_key).distinct(), ref_key, "left_semi")
    kept = r.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", ref_key))), lambda x: x[ref_key]).alias(refs_col))
    return df.drop(refs_col).join(kept, id_col)


def in_file_order(df: DataFrame, path_col: str, last: str) -> Column:
    """Sort key that puts paths with a word in them last."""
    return F.struct(F.col(path_col).contains(last), F.col(path_col))


def ancestors(nodes: DataFrame, *, node: str, parent: str, excluded: DataFrame | None = None) -> DataFrame:
    """``(node, ancestor, level)`` for every ancestor, however far; a node is never its own, so cycles end.

    The length of the paths known doubles each round (known paths joined end to end), so a
    chain of n parents takes log n rounds; a round that finds no new pair is the last.
    ``excluded``: nodes (one column) at which a path stops: they are ancestors, but nothing above them is.
    """
    edges = nodes.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).where("ancestor is not null and ancestor <> node").distinct()
    if excluded is not None:
        edges = edges.join(excluded.select(F.col(excluded.columns[0]).alias("node")).distinct(), "node", "left_anti")
    known = cut(edges.withColumn("level", F.lit(1)))
    n = known.count()
    while n:
        ahead = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_a"), F.col("level").alias("_l"))
        longer = known.join(ahead, "ancestor").where("node <> _a").select("node", F.col("_a").alias("ancestor"), (F.col("level") + F.col("_l")).alias("level"))
        known = cut(known.unionByName(longer).groupBy("node", "ancestor").agg(F.min("level").alias("level")))
        before, n = n, known.count()
        if n == before:
            break
    return known


def in_two_pools(df: DataFrame, first: DataFrame, second: DataFrame, *, key: str, value: str, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """``df`` with the value of its key and the pool it is from; the first pool goes before the second."""
    pool = first.select(key, value, F.lit(0).alias("_p")).unionByName(second.select(key, value, F.lit(1).alias("_p"))).where(F.col(key).isNotNull())
    best = pool.groupBy(key).agg(F.min(F.struct("_p", value)).alias("_b"))
    return df.join(best, key, "left").withColumn(value, F.col(f"_b.{value}")).withColumn("pool", F.when(F.col("_b._p") == 0, names[0]).when(F.col("_b._p") == 1, names[1])).drop("_b")
