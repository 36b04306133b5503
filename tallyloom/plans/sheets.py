"""Queries of the readers of positional cells, on cells made from the part and nation tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.plans.registry import Registry
from tallyloom.session import table
from tallyloom.sources import readers, writers

R = Registry()
query = R.query


def _cells(spark, d):
    """A sheet per brand: a title, a header in row 3, then a row per part."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("sheet"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 3).alias("row"), "p_partkey", "p_size", "p_type")
    body = writers.cells(p, sheet="sheet", row="row", values={"p_partkey": 2, "p_size": 3, "p_type": 5})
    head = F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in ((1, 1, "Title"), (3, 2, "key"), (3, 3, "size"), (3, 5, "type"))))
    heads = p.select("sheet").distinct().select("sheet", F.explode(head).alias("_c")).select("sheet", "_c.*")
    return heads.unionByName(body)


@query("select p_brand sheet, (row_number() over (partition by p_brand order by p_partkey) + 3)::int as row, p_partkey::varchar as key, p_size::varchar size, p_type as type from part")
def sheet_table(spark, d):
    return readers.sheet_table(_cells(spark, d), sheet="sheet", labels=["key", "size", "type"])


@query("select p_brand sheet, label, value from (select p_brand, min(p_partkey) k from part group by 1) cross join (select 'key' label, 'size' value union all select 'size', 'type')")
def right_of_label(spark, d):
    return readers.right_of_label(_cells(spark, d), ["key", "size"], 2, sheet="sheet")


@query("""
select p_partkey, last_value(case when p_size > 40 then p_brand end ignore nulls) over (partition by p_type order by p_partkey rows unbounded preceding) carried from part""")
def carried_forward(spark, d):
    p = table(spark, d, "part").withColumn("b", F.when(F.col("p_size") > 40, F.col("p_brand")))
    return readers.carried_forward(p, by="p_type", order="p_partkey", value="b", out="carried").select("p_partkey", "carried")


@query("""
select n_nationkey::varchar as "ref", case when n_nationkey % 5 = 4 then null else n_name end val from (select n_nationkey, case when n_nationkey % 5 = 4 then null else (select n_name from nation m where m.n_nationkey = (n.n_nationkey // 5) * 5) end n_name from nation n)""")
def cell_references(spark, d):
    """Cells that point to cells: chains of up to three steps, beyond that null."""
    n = table(spark, d, "nation")
    step = F.col("n_nationkey") % 5
    ref = F.concat(F.lit("A"), F.col("n_nationkey"))
    value = F.when(step == 0, F.col("n_name")).otherwise(F.concat(F.lit("=$A$"), F.col("n_nationkey") - 1))
    c = n.select(F.lit("s").alias("sheet"), ref.alias("ref"), value.alias("value"))
    r = readers.resolve_references(c, sheet="sheet", depth=3)
    return r.select(F.regexp_replace("ref", "A", "").alias("ref"), F.col("value").alias("val"))


@query("""
with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) rn, p_size from part) select p_brand, p_partkey, sum(case when p_size > 45 then 1 else 0 end) over (partition by p_brand order by rn)::int table_no from r qualify sum(case when p_size > 45 then 1 else 0 end) over (partition by p_brand order by rn) > 0""")
def stacked_tables(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("row"), F.when(F.col("p_size") > 45, "MARK").otherwise("x").alias("value"))
    return readers.stacked_tables(p, sheet="p_brand", marker="MARK").select("p_brand", "p_partkey", "table_no")


@query("""
select p_brand, 'small' item, sum(case when p_size < 25 then 1 else 0 end)::double as value from part group by 1 union all select p_brand, 'price', (sum(p_retailprice::decimal(18,2)) / 1000)::double from part group by 1""")
def wide_to_long(spark, d):
    from tallyloom.operators.panel import unpivoted

    g = table(spark, d, "part").groupBy("p_brand").agg(F.sum(F.when(F.col("p_size") < 25, 1).otherwise(0)).alias("small"), F.sum(F.col("p_retailprice").cast("decimal(18,2)")).alias("price"))
    return unpivoted(g, ["p_brand"], ["small", "price"], {"price": 0.001})


@query("""
with y as (select o_custkey, year(o_orderdate) y, count(*) n from orders group by 1, 2), r as (select *, dense_rank() over (partition by o_custkey order by y desc) - 1 i from y) select o_custkey, i::int period_idx, n from r where i < 3""")
def last_periods(spark, d):
    from tallyloom.operators.panel import last_periods as last

    y = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return last(y, by=["o_custkey"], period="y").select("o_custkey", "period_idx", "n")
