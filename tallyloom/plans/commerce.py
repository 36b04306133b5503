"""Queries of the core operators on the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import choices, dates, numbers
from tallyloom.operators import aggregate, evaluate, lookup, matching, ordered, panel, predicates, score, upsert
from tallyloom.plans.registry import Registry
from tallyloom.session import table

R = Registry()
query = R.query

MONEY = "decimal(18,2)"


def _class(c):
    """Confidence class of a priority: A to D."""
    return F.when(c.startswith("1"), "A").when(c.startswith("2"), "B").when(c.startswith("3"), "C").otherwise("D")


_CLASS_SQL = "case when o_orderpriority like '1%' then 'A' when o_orderpriority like '2%' then 'B' when o_orderpriority like '3%' then 'C' else 'D' end"


def _orders(spark, d):
    return table(spark, d, "orders").select("*", F.date_format("o_orderdate", "yyyy-MM").alias("ym"), _class(F.col("o_orderpriority")).alias("cls"), F.col("o_totalprice").cast(MONEY).alias("amount"))


_ORDERS_SQL = f"(select *, strftime(o_orderdate, '%Y-%m') ym, {_CLASS_SQL} cls, o_totalprice::decimal(18,2) amount from orders)"


@query("""
select p_partkey, round(2.0 * p_size + 0.01 * p_retailprice, 6) score from part
where p_brand like '%1%' and p_size <= 30 and p_retailprice >= 950
order by score desc, p_partkey limit 20 offset 5""")
def dynamic_filter_score(spark, d):
    p = table(spark, d, "part")
    spec = {"p_brand": ("contains", "1"), "p_size": ("<=", "30"), "p_retailprice": (">=", 950), "no_such": ("==", "x")}
    r = score.ranked(p, id_col="p_partkey", spec=spec, weights={"p_size": 2.0, "p_retailprice": 0.01}, skip=5, top=20)
    return r.select("p_partkey", F.round("score", 6).alias("score"))


@query("""
select "filter", n_without::bigint n_without from (
 select 'p_brand' as "filter", count(*) filter (where p_size <= 20 and p_retailprice >= 1000 and p_type not like '%3%') n_without from part
 union all select 'p_size', count(*) filter (where p_brand like '%2%' and p_retailprice >= 1000 and p_type not like '%3%') from part
 union all select 'p_retailprice', count(*) filter (where p_brand like '%2%' and p_size <= 20 and p_type not like '%3%') from part
 union all select 'p_type', count(*) filter (where p_brand like '%2%' and p_size <= 20 and p_retailprice >= 1000) from part)""")
def filter_leave_one_out(spark, d):
    return predicates.leave_one_out(table(spark, d, "part"), {"p_brand": ("contains", "2"), "p_size": ("<=", 20), "p_retailprice": (">=", 1000), "p_type": ("not_contains", "3")})


@query("""
select p_partkey from part p where not exists (select 1 from (select distinct lower(p_brand) b from part where p_size >= 49) x where contains(lower(p.p_brand), b) or contains(b, lower(p.p_brand)))""")
def exclusion_list(spark, d):
    p = table(spark, d, "part")
    return predicates.excluded(p, "p_brand", p.where("p_size >= 49").select(F.col("p_brand").alias("brand")).distinct(), "brand").select("p_partkey")


@query(f"""
select ym, cls, count(*) n, sum(amount)::double total from {_ORDERS_SQL} where o_orderstatus <> 'P' and amount > 0 group by ym, cls""")
def clean_and_sum(spark, d):
    o = _orders(spark, d).where((F.col("o_orderstatus") != "P") & (F.col("amount") > 0))
    return o.groupBy("ym", "cls").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query(f"""
select case when grouping(r_name) = 1 then 'total' when grouping(n_name) = 1 then 'region' else 'branch' end as level, r_name region, n_name branch,
 round(sum(amount) / 1000, 3)::double as value
from {_ORDERS_SQL} o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by grouping sets ((r_name, n_name), (r_name), ())""")
def rollup_subtotals(spark, d):
    j = _branches(spark, d)
    return aggregate.with_subtotals(j, "region", "branch", "amount", unit=1000, digits=3).withColumn("value", F.col("value").cast("double"))


def _branches(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("region"), F.col("n_name").alias("branch"))
    return _orders(spark, d).join(c, F.col("o_custkey") == F.col("c_custkey"))


@query(f"""
with b as (select r_name region, n_name branch, round(sum(amount) / 1000, 0) v from {_ORDERS_SQL} o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2)
select case when grouping(region) = 1 then 'total' when grouping(branch) = 1 then 'region' else 'branch' end as level, region, branch, sum(v)::double as value from b group by grouping sets ((region, branch), (region), ())""")
def rollup_of_rounded(spark, d):
    return aggregate.subtotals_of_rounded(_branches(spark, d), "region", "branch", "amount", unit=1000, digits=0).withColumn("value", F.col("value").cast("double"))


@query(f"""
select ym, coalesce(sum(amount) filter (where cls = 'A'), 0)::double a, coalesce(sum(amount) filter (where cls in ('B', 'C')), 0)::double bc, coalesce(sum(amount) filter (where cls in ('A', 'B', 'C')), 0)::double abc,
 coalesce(sum(amount) filter (where cls = 'D'), 0)::double d from {_ORDERS_SQL} group by ym""")
def three_classes(spark, d):
    r = aggregate.by_class(_orders(spark, d), ["ym"], "cls", "amount", {"a": ["A"], "bc": ["B", "C"], "abc": ["A", "B", "C"], "d": ["D"]})
    return r.select("ym", *(F.col(c).cast("double").alias(c) for c in ("a", "bc", "abc", "d")))


@query(f"""
with g as (select cls, o_orderstatus, count(*) n from {_ORDERS_SQL} where o_orderstatus <> 'O' group by 1, 2),
c as (select distinct cls from {_ORDERS_SQL}), s as (select distinct o_orderstatus from orders)
select c.cls, s.o_orderstatus, coalesce(n, 0)::bigint n from c cross join s left join g on g.cls = c.cls and g.o_orderstatus = s.o_orderstatus""")
def zero_filled_grid(spark, d):
    o = _orders(spark, d)
    g = o.where("o_orderstatus <> 'O'").groupBy("cls", "o_orderstatus").agg(F.count("*").alias("n"))
    return aggregate.zero_filled(g, [o.select("cls"), o.select("o_orderstatus")], "n")


@query(f"""
with y as (select o_custkey, year(o_orderdate) y, sum(amount) v from {_ORDERS_SQL} group by 1, 2),
l as (select *, lag(v) over (partition by o_custkey order by y) b, lag(v, 2) over (partition by o_custkey order by y) b2 from y)
select o_custkey, y::int y, round(case when b = 0 then null else (v - b)::double / abs(b)::double end, 6) change,
 case when b is null then 'missing' when b = 0 then 'zero_base' when abs((v - b)::double / b::double) >= 0.2 then 'big' when abs((v - b)::double / b::double) >= 0.1 then 'some' else 'none' end flag,
 case when b is null then null when v = b then 'same' when v < b then 'worse' else 'better' end direction,
 coalesce(b2 is not null and v < b and b < b2, false) worsening from l""")
def change_flags(spark, d):
    y = _orders(spark, d).groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("amount").alias("v"))
    c = panel.changes(y.withColumn("v", F.col("v").cast("double")), by=["o_custkey"], order="y", value="v")
    t = panel.trend(c, by=["o_custkey"], order="y", value="v", worse_is_up=F.lit(False))
    return t.select("o_custkey", "y", F.round("change", 6).alias("change"), "flag", "direction", "worsening")


@query("""
select l_suppkey, case when sum(q) = 0 then null else round_even((sum(e) / sum(q))::double, 2) end price_per_unit, round_even((sum(di) / sum(e))::double * 100, 2) discount_rate
from (select l_suppkey, l_quantity::decimal(18,2) q, l_extendedprice::decimal(18,2) e, (l_extendedprice * l_discount)::decimal(18,2) di from lineitem) group by 1""")
def ratio_panel(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast(MONEY).alias("q"), F.col("l_extendedprice").cast(MONEY).alias("e"), (F.col("l_extendedprice") * F.col("l_discount")).cast(MONEY).alias("di"))
    s = li.groupBy("l_suppkey").agg(*(F.sum(c).cast("double").alias(c) for c in ("q", "e", "di")))
    return panel.ratio_panel(s, {"price_per_unit": (F.col("e"), F.col("q")), "discount_rate": (F.col("di") * 100, F.col("e"))}).select("l_suppkey", "price_per_unit", "discount_rate")


@query("""
with c as (select c_custkey, case when c_acctbal < 0 then 1 when c_acctbal < 2500 then 2 when c_acctbal < 7500 then 3 else 4 end::int "row", case when c_mktsegment < 'C' then 'a' when c_mktsegment < 'H' then 'b' else 'c' end col from customer)
select c_custkey, "row", col, chr((64 + "row" + case col when 'a' then 0 when 'b' then 1 else 2 end)::int) class from c""")
def matrix_lookup(spark, d):
    cells = [(r, c, chr(64 + r + k)) for r in range(1, 5) for k, c in enumerate("abc")]
    m = spark.createDataFrame(cells, "row int, col string, class string")
    b = F.col("c_acctbal")
    row = F.when(b < 0, 1).when(b < 2500, 2).when(b < 7500, 3).otherwise(4)
    col = F.when(F.col("c_mktsegment") < "C", "a").when(F.col("c_mktsegment") < "H", "b").otherwise("c")
    return panel.matrix_lookup(table(spark, d, "customer"), m, row=row, column=col).select("c_custkey", "row", "col", "class")


@query("""
select o_custkey, case max(case o_orderstatus when 'F' then 1 when 'O' then 2 when 'P' then 3 end) when 1 then 'F' when 2 then 'O' else 'P' end o_orderstatus from orders group by 1""")
def worst_status(spark, d):
    return panel.worst_row(table(spark, d, "orders"), by=["o_custkey"], label="o_orderstatus", ranks=["F", "O", "P"])


@query("""
with s as (select l_orderkey, sum(l_extendedprice::decimal(18,2)) parts from lineitem group by 1)
select o_orderkey, (o_totalprice::decimal(18,2) - coalesce(parts, 0))::double diff, abs(o_totalprice::decimal(18,2) - coalesce(parts, 0)) <= 50000 ok from orders left join s on l_orderkey = o_orderkey""")
def voucher_sum_check(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_totalprice").cast(MONEY).alias("total"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast(MONEY).alias("amount"))
    return matching.sum_within(o, li, on="o_orderkey", total="total", amount="amount", tolerance=50000).select("o_orderkey", F.col("diff").cast("double").alias("diff"), "ok")


@query("""
select l_orderkey, l_linenumber, array_to_string(list_filter([case when l_partkey not in (select p_partkey from part where p_size < 40) then 'l_partkey' end, case when l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0) then 'l_suppkey' end], lambda x: x is not null), ',') missing
from lineitem where l_partkey not in (select p_partkey from part where p_size < 40) or l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0)""")
def master_anti_check(spark, d):
    m = {"l_partkey": table(spark, d, "part").where("p_size < 40").select("p_partkey"), "l_suppkey": table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")}
    r = lookup.missing_codes(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), m)
    return r.select("l_orderkey", "l_linenumber", F.array_join("missing", ",").alias("missing"))


@query("""
select distinct l_partkey, l_linenumber from lineitem where l_quantity >= 45 except select distinct l_partkey, l_linenumber from lineitem where l_quantity < 45""")
def combo_anti_check(spark, d):
    li = table(spark, d, "lineitem")
    return lookup.unseen_pairs(li.where("l_quantity >= 45"), li.where("l_quantity < 45"), "l_partkey", "l_linenumber")


@query("""
with a as (select o_custkey, o_orderstatus, o_orderpriority, count(*) t from orders where o_orderkey % 2 = 0 group by 1, 2, 3), b as (select o_custkey, o_orderstatus, o_orderpriority, count(*) p from orders where o_orderkey % 2 = 1 group by 1, 2, 3),
j as (select coalesce(a.o_custkey, b.o_custkey) k, coalesce(t, 0) t, coalesce(p, 0) p from a full join b on a.o_custkey = b.o_custkey and a.o_orderstatus = b.o_orderstatus and a.o_orderpriority = b.o_orderpriority)
select k o_custkey, sum(t)::bigint n_truth, sum(p)::bigint n_pred, sum(least(t, p))::bigint n_hit, sum(t) = sum(least(t, p)) and sum(p) = sum(least(t, p)) equal from j group by 1""")
def bag_overlap(spark, d):
    o = table(spark, d, "orders")
    return evaluate.equal_bags(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), by=["o_custkey"], fields=["o_orderstatus", "o_orderpriority"])


@query("""
with r as (select o_custkey, o_orderstatus s, o_orderkey % 2 side, o_orderpriority p from orders),
g as (select o_custkey, list(s order by s) filter (where side = 0) a, list(s order by s) filter (where side = 1) b, list(s || p order by s || p) filter (where side = 0) a2, list(s || p order by s || p) filter (where side = 1) b2 from r group by 1)
select 'status' as level, count(*) n_groups, count(*) filter (where a is not distinct from b) n_equal, round(count(*) filter (where a is not distinct from b)::double / count(*), 9) rate from g
union all select 'both', count(*), count(*) filter (where a2 is not distinct from b2), round(count(*) filter (where a2 is not distinct from b2)::double / count(*), 9) from g""")
def bag_rates(spark, d):
    o = table(spark, d, "orders")
    r = evaluate.group_rates(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), by=["o_custkey"], levels={"status": ["o_orderstatus"], "both": ["o_orderstatus", "o_orderpriority"]})
    return r.withColumn("rate", F.round("rate", 9))


@query("""
with x as (select *, row_number() over (partition by o_custkey, o_orderpriority, o_orderkey % 2 order by o_orderkey) rn from orders)
select a.o_orderkey truth_key, b.o_orderkey pred_key from x a join x b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority and a.rn = b.rn and a.o_orderkey % 2 = 0 and b.o_orderkey % 2 = 1""")
def bag_match(spark, d):
    o = table(spark, d, "orders")
    p = matching.bag_pairs(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderpriority"], ["o_orderkey"], ["o_orderkey"])
    return p.select(F.col("a.o_orderkey").alias("truth_key"), F.col("b.o_orderkey").alias("pred_key"))


@query("""
with x as (select *, row_number() over (partition by o_custkey, o_orderpriority, o_orderkey % 2 order by o_orderkey) rn from orders),
p as (select a.o_orderstatus = b.o_orderstatus s, year(a.o_orderdate) = year(b.o_orderdate) y from x a join x b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority and a.rn = b.rn and a.o_orderkey % 2 = 0 and b.o_orderkey % 2 = 1)
select count(*) n_pairs, count(*) filter (where s and y) n_hit, count(*) filter (where not s) wrong_o_orderstatus, count(*) filter (where not y) wrong_y from p""")
def line_outcomes(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    p = matching.bag_pairs(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderpriority"], ["o_orderkey"], ["o_orderkey"])
    return evaluate.line_outcomes(p, ["o_orderstatus", "y"])


@query("""
with c as (select c_custkey, c_nationkey nk, round(c_acctbal)::bigint bal, (round(c_acctbal / 10))::bigint dec from customer), s as (select s_suppkey, s_nationkey nk, round(s_acctbal)::bigint bal, (round(s_acctbal / 10))::bigint dec from supplier),
m1 as (select c_custkey, s_suppkey, 'exact' stage from c join s using (nk, bal) where (nk, bal) in (select (nk, bal) from c group by nk, bal having count(*) = 1) and (nk, bal) in (select (nk, bal) from s group by nk, bal having count(*) = 1)),
c2 as (select * from c where c_custkey not in (select c_custkey from m1)), s2 as (select * from s where s_suppkey not in (select s_suppkey from m1)),
m2 as (select c_custkey, s_suppkey, 'decade' stage from c2 join s2 using (nk, dec) where (nk, dec) in (select (nk, dec) from c2 group by nk, dec having count(*) = 1) and (nk, dec) in (select (nk, dec) from s2 group by nk, dec having count(*) = 1)),
m as (select * from m1 union all select * from m2)
select * from m union all select c_custkey, null, 'left_only' from c where c_custkey not in (select c_custkey from m) union all select null, s_suppkey, 'right_only' from s where s_suppkey not in (select s_suppkey from m)""")
def staged_match(spark, d):
    b = lambda c: (F.round(c).cast("bigint").alias("bal"), F.round(F.col(c) / 10).cast("bigint").alias("dec"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"), *b("c_acctbal"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nk"), *b("s_acctbal"))
    m = matching.staged_match(c, s, left_id="c_custkey", right_id="s_suppkey", stages=[("exact", ["nk", "bal"]), ("decade", ["nk", "dec"])])
    return matching.match_report(c, s, m, left_id="c_custkey", right_id="s_suppkey")


@query()
def candidate_join(spark, d):
    """Every line, thirty candidates each."""
    return _candidates(spark, d, table(spark, d, "lineitem"), top=30)


def _candidates(spark, d, lines, top):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("od"))
    li = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("s"))
    left = li.join(o.select("o_orderkey", "o_custkey"), "o_orderkey").select("line", "s", "o_custkey")
    return matching.candidates(left, o.withColumnRenamed("o_orderkey", "cand"), on=["o_custkey"], left_id="line", right_id="cand", left_date="s", right_date="od", days=60, top=top)


@query()
def tolerance_join(spark, d):
    """Every order and every line."""
    return _near_amounts(table(spark, d, "orders"), table(spark, d, "lineitem"))


def _near_amounts(orders, lines):
    a = orders.select("o_orderkey", F.round("o_totalprice").cast("bigint").alias("v"))
    b = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.round("l_extendedprice").cast("bigint").alias("w"))
    return matching.near_amounts(a, b, left_id="o_orderkey", right_id="line", left_amount="v", right_amount="w", tolerance=3)


@query("""
with h as (select o_custkey, o_orderkey, o_orderdate, o_orderpriority from orders)
select a.o_orderkey, count(b.o_orderkey) n_before, coalesce(max(b.o_orderkey), -1) last_before from h a left join h b on a.o_custkey = b.o_custkey and b.o_orderdate < date_trunc('month', a.o_orderdate) group by 1""")
def point_in_time(spark, d):
    """Orders of a customer in months strictly before each order: a running count over months, so no
    pair of orders is formed."""
    o = table(spark, d, "orders").withColumn("m", F.date_trunc("month", "o_orderdate"))
    m = o.groupBy("o_custkey", "m").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    w = Window.partitionBy("o_custkey").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    m = m.select("o_custkey", "m", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_before"), F.coalesce(F.max("last").over(w), F.lit(-1)).alias("last_before"))
    return o.join(m, ["o_custkey", "m"]).select("o_orderkey", "n_before", "last_before")


@query("""
with f as (select o_custkey, o_orderkey, floor(o_totalprice / 40000)::decimal(18,2) q from orders),
a as (select o_orderkey, q, list(q) over (partition by o_custkey order by o_orderkey rows between 1 following and 13 following) nx from f),
k as (select a.*, unnest(range(1, 14)) n from a)
select o_orderkey, min(n) filter (where n >= 2 and n <= coalesce(len(nx), 0) and abs(list_sum(nx[1:n]) - q) <= 1)::int n_parts from k group by 1""")
def look_ahead_sum(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 40000).cast(MONEY).alias("q"))
    return ordered.look_ahead_sum(o, by="o_custkey", order="o_orderkey", amount="q", tolerance=1).select("o_orderkey", "n_parts")


@query("""
with g as (select o_custkey, o_orderkey, o_orderkey // 4 v from (select distinct o_custkey, o_orderkey from orders)), u as (select distinct o_custkey, v from g), r as (select *, v - row_number() over (partition by o_custkey order by v) g from u)
select o_custkey, min(v) "first", max(v) "last", count(*) n from r group by o_custkey, g""")
def islands(spark, d):
    return ordered.islands(table(spark, d, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 4).cast("bigint").alias("v")), by="o_custkey", value="v")


@query("""
with u as (select distinct l_orderkey, l_linenumber v from lineitem where l_quantity > 20), r as (select *, v - row_number() over (partition by l_orderkey order by v) g from u), i as (select l_orderkey, min(v) f, max(v) l from r group by l_orderkey, g)
select l_orderkey, string_agg(case when f = l then 'p' || f else 'p' || f || '-p' || l end, ';' order by f) pages from i group by 1""")
def page_ranges(spark, d):
    i = ordered.islands(table(spark, d, "lineitem").where("l_quantity > 20").select("l_orderkey", F.col("l_linenumber").alias("v")), by="l_orderkey", value="v")
    return ordered.page_text(i, by="l_orderkey")


@query("""
select o_orderkey file, w::int "window", greatest(w * 8, 1)::int "first", least(w * 8 + 11, n)::int "last", (w * 8 + 1)::int own_first, least(w * 8 + 8, n)::int own_last
from (select o_orderkey, 1 + (o_orderkey % 30) n, unnest(range(0, 1 + ((o_orderkey % 30) // 8))) w from orders)""")
def page_windows(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), (1 + F.col("o_orderkey") % 30).alias("n_pages"))
    return ordered.page_windows(p, file="file", n_pages="n_pages")


@query("""
with c as (select o_custkey, o_orderpriority v, count(*) n, min(o_orderkey) o from orders group by 1, 2), r as (select *, row_number() over (partition by o_custkey order by n desc, o, v) rn, count(*) over (partition by o_custkey) k from c)
select o_custkey, v o_orderpriority, n, k n_values from r where rn = 1""")
def majority_vote(spark, d):
    return aggregate.majority(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("""
select o_custkey, kind, min(o_orderkey) first_seen, sum(case when o_totalprice < 50000 then null else o_totalprice::decimal(18,2) end)::double amount, count(*) n_lines, string_agg(o_orderstatus, '; ' order by o_orderkey) texts,
 first(o_orderpriority order by o_orderkey) filter (where o_orderstatus <> 'O') o_orderpriority
from (select *, case when o_orderkey % 3 = 0 then null else (o_orderkey % 3)::int end kind from orders) group by 1, 2""")
def grouped_lines(spark, d):
    o = table(spark, d, "orders").select(
        "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3).cast("int").alias("kind"), "o_orderkey", F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice").cast(MONEY)).alias("q"), "o_orderstatus",
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    g = aggregate.grouped_lines(o, ["o_custkey", "kind"], order="o_orderkey", amount="q", text="o_orderstatus", first="o_orderpriority")
    return g.select("o_custkey", "kind", "first_seen", F.col("amount").cast("double").alias("amount"), "n_lines", "texts", "o_orderpriority")


@query("""
select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'middle' when p_size < 51 then 'large' end size_band, greatest(0, least(p_size + 10, 30) - greatest(p_size, 10))::double overlap_10_30,
 case when p_retailprice < 1000 then p_retailprice * 10 else p_retailprice end scaled from part""")
def range_bins(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", numbers.bin_label(size, [0, 10, 30, 51], ["small", "middle", "large"]).alias("size_band"), numbers.overlap(size, size + 10, F.lit(10), F.lit(30)).alias("overlap_10_30"), numbers.unit_scaled(F.col("p_retailprice"), 1000, 10).alias("scaled")
    )


@query("""
select o_orderkey, ceil(amt * (day(last_day(od)) - day(od) + 1) / day(last_day(od)))::bigint prorated, floor(amt * 0.08)::bigint tax, (amt - round_even((amt / 1.10)::double, 0)::bigint)::bigint included,
 strftime(last_day(od), '%Y-%m-%d') month_end, strftime(last_day(od + interval 1 month), '%Y-%m-%d') next_end from (select o_orderkey, round(o_totalprice)::bigint amt, o_orderdate::date od from orders)""")
def proration(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice").cast("decimal(18,0)").alias("amt"), F.col("o_orderdate").cast("date").alias("od"))
    return o.select(
        "o_orderkey", numbers.prorated(F.col("amt"), F.col("od")).cast("bigint").alias("prorated"), numbers.floor_tax(F.col("amt"), F.lit("0.08").cast("decimal(5,2)")).cast("bigint").alias("tax"), numbers.included_tax(F.col("amt")).alias("included"),
        dates.month_end(F.col("od")).cast("string").alias("month_end"), dates.month_end(F.col("od"), 1).cast("string").alias("next_end"),
    )


@query("""
with m as (select date_trunc('month', o_orderdate)::date m, count(*) n, count(*) filter (where dayofweek(o_orderdate) between 1 and 5) on_weekday from orders group by 1)
select strftime(m, '%Y%m') ym, n, on_weekday, (select count(*) from generate_series(m::timestamp, last_day(m)::timestamp, interval 1 day) t(x) where dayofweek(x) between 1 and 5 and x::date <> date '1996-01-01')::int business_days from m""")
def calendar_join(spark, d):
    o = table(spark, d, "orders").withColumn("m", F.trunc("o_orderdate", "month"))
    g = o.groupBy("m").agg(F.count("*").alias("n"), F.sum(F.when(~F.dayofweek("o_orderdate").isin(1, 7), 1).otherwise(0)).cast("bigint").alias("on_weekday"))
    return g.select(F.date_format("m", "yyyyMM").alias("ym"), "n", "on_weekday", F.size(dates.business_days(F.col("m"), F.last_day("m"), ["1996-01-01"])).alias("business_days"))


@query("""
with recursive e as (select 'c' || c_custkey n, 'n' || c_nationkey p from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'r' || r_regionkey, 'world' from region),
a as (select n, p, 1 l from e union all select a.n, e.p, l + 1 from a join e on a.p = e.n) select n node, p ancestor, l::int as level from a""")
def ancestry(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("n"), F.concat(F.lit("n"), "c_nationkey").alias("p"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("n"), F.concat(F.lit("r"), "n_regionkey").alias("p"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("n"), F.lit("world").alias("p"))
    return lookup.ancestors(c.unionByName(n).unionByName(r), node="n", parent="p")


@query("""
with u as (select c_custkey, c_name, c_acctbal bal, 1 v from customer union all select c_custkey, c_name || '*', c_acctbal + 1, case when c_custkey % 3 = 0 then 2 else 0 end from customer where c_custkey % 2 = 0 union all select c_custkey + 1000000, 'new', 0, 2 from customer where c_custkey % 5 = 0),
r as (select *, row_number() over (partition by c_custkey order by v desc) rn from u) select c_custkey, c_name, bal, v from r where rn = 1""")
def upsert_merge(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("bal"), F.lit(1).alias("v"))
    a = old.where("c_custkey % 2 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("bal") + 1).alias("bal"), F.when(F.col("c_custkey") % 3 == 0, 2).otherwise(0).alias("v"))
    b = old.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("bal"), F.lit(2).alias("v"))
    return upsert.latest_wins(old, a.unionByName(b), ["c_custkey"], "v")


@query("""
with o as (select l_orderkey k, count(*) n, max(l_linenumber) m from lineitem where l_linenumber <= 4 group by 1), w as (select l_orderkey k, count(*) n, max(l_linenumber) m from lineitem where l_linenumber >= 2 group by 1)
select coalesce(o.k, w.k) l_orderkey, case when o.k is null then 'new' when w.k is null then 'missing' when o.n = w.n and o.m = w.m then 'same' else 'changed' end state from o full join w on o.k = w.k""")
def fingerprint_diff(spark, d):
    li = table(spark, d, "lineitem")
    f = lambda x: x.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"))
    return upsert.fingerprint_changes(f(li.where("l_linenumber <= 4")), f(li.where("l_linenumber >= 2")), "l_orderkey", ["n", "m"])


@query("""
select o_orderkey, o_custkey from orders where (o_custkey, year(o_orderdate), o_orderpriority) in (select (o_custkey, year(o_orderdate), o_orderpriority) from orders group by o_custkey, year(o_orderdate), o_orderpriority having min(o_orderkey) <> max(o_orderkey))""")
def duplicate_keys(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return upsert.duplicates_elsewhere(o, ["o_custkey", "y", "o_orderpriority"], "o_orderkey").select("o_orderkey", "o_custkey")


@query("""
select l_orderkey, count(*) filter (where n is null) missing, count(*) filter (where r is null) extra, count(*) filter (where n > 1) twice, count(*) filter (where n is null) = 0 and count(*) filter (where r is null) = 0 and count(*) filter (where n > 1) = 0 ok from (
 select coalesce(a.l_orderkey, b.l_orderkey) l_orderkey, n, r from (select l_orderkey, l_linenumber % 4 item, count(*) n from lineitem group by 1, 2) a full join (select distinct l_orderkey, l_linenumber item, true r from lineitem where l_linenumber < 4) b on a.l_orderkey = b.l_orderkey and a.item = b.item) group by 1""")
def exact_cover(spark, d):
    li = table(spark, d, "lineitem")
    return matching.exact_cover(li.select("l_orderkey", (F.col("l_linenumber") % 4).alias("item")), li.where("l_linenumber < 4").select("l_orderkey", F.col("l_linenumber").alias("item")), by="l_orderkey", item="item")


@query("""
with b as (select o_custkey k, o_orderkey ok, o_orderpriority q, o_orderstatus s from orders), v as (select k, ok, 'r1' run, q, s from b union all select k, ok, 'r2', case when ok % 5 = 0 then q || '*' else q end, s from b where ok % 11 <> 0),
n as (select *, row_number() over (partition by run, k order by ok) ord from v), u as (select k, ord, run, 'q' field, q val from n union all select k, ord, run, 's', s from n)
select k, ord ordinal, field, count(distinct val) n_values, count(distinct run) n_runs from u group by 1, 2, 3 having count(distinct val) > 1 or count(distinct run) < 2""")
def compare_runs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ok"), F.col("o_orderpriority").alias("q"), F.col("o_orderstatus").alias("s"))
    r2 = o.where("ok % 11 <> 0").withColumn("q", F.when(F.col("ok") % 5 == 0, F.concat("q", F.lit("*"))).otherwise(F.col("q")))
    return matching.compare_runs(o.withColumn("run", F.lit("r1")).unionByName(r2.withColumn("run", F.lit("r2"))), run="run", keys=["k"], fields=["q", "s"], order="ok")


@query("""
with k as (select distinct l_partkey % 40 k from lineitem), s as (select distinct p_brand, p_partkey % 40 k from part), h as (select p_brand, count(*) hits from s where k in (select k from k) group by 1), r as (select *, hits::double / (select count(*) from k) rate from h),
w as (select *, row_number() over (order by rate desc, p_brand) rk, coalesce(lead(rate) over (order by rate desc, p_brand), 0) nx from r)
select p_brand, hits, round(rate, 9) rate, rk = 1 and rate >= 0.5 and rate - nx >= 0.25 chosen from w""")
def sheet_choice(spark, d):
    k = table(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("k"))
    s = table(spark, d, "part").select("p_brand", (F.col("p_partkey") % 40).alias("k"))
    return matching.choose_by_overlap(k, s, key="k", sheet="p_brand").withColumn("rate", F.round("rate", 9))


@query("""
select l_suppkey, o_orderpriority, n, rk::int as rank from (select l_suppkey, o_orderpriority, count(*) n, row_number() over (partition by l_suppkey order by count(*) desc, o_orderpriority) rk from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)""")
def pair_histogram(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("one", F.lit(1))
    return aggregate.pair_counts(j, "l_suppkey", "o_orderpriority", "one").select("l_suppkey", "o_orderpriority", "n", "rank")


@query("""
with c as (select l_suppkey, l_orderkey, count(*) n_lines from lineitem group by 1, 2) select l_suppkey, n_lines, count(*) n_keys from c group by 1, 2""")
def counts_of_counts(spark, d):
    return aggregate.counts_of_counts(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


@query("""
select n_name, o_orderstatus, count(*) n, grouping_id(n_name, o_orderstatus)::bigint gid, approx_n from (select n_name, o_orderstatus, 0 approx_n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) group by cube (n_name, o_orderstatus), approx_n""")
def cube_counts(spark, d):
    n = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = table(spark, d, "orders").join(n, F.col("o_custkey") == F.col("c_custkey"))
    return j.cube("n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("gid")).withColumn("approx_n", F.lit(0))


@query("""
select o_orderkey, (ntile(4) over w)::int as "quarter", round(percent_rank() over w, 9) pr, round(cume_dist() over w, 9) cd from orders window w as (partition by o_custkey order by o_totalprice, o_orderkey)""")
def rank_functions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query("""
with p as (select p_partkey k, p_brand || ' ' || p_size::varchar v from part where p_partkey % 3 <> 0), q as (select p_partkey k, p_brand || ' ' || (case when p_partkey % 7 = 0 then p_size + 1 else p_size end)::varchar v from part where p_partkey % 5 <> 0)
select coalesce(p.k, q.k) k, p.v a, q.v b from p full join q on p.k = q.k where p.v is distinct from q.v""")
def cell_differences(spark, d):
    p = table(spark, d, "part")
    v = lambda c: F.concat_ws(" ", "p_brand", c.cast("string")).alias("v")
    a = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), v(F.col("p_size")))
    b = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), v(F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))))
    return evaluate.cell_differences(a, b, ["k"], "v")


@query("""
select "within", "over", "unknown", greatest(0, 50 - "within") refill, case when "within" >= 50 then 'ok' when "within" + "unknown" >= 50 then 'check' else 'refill' end verdict from (
 select count(*) filter (where pr <= 1000) "within", count(*) filter (where pr > 1000) "over", count(*) filter (where pr is null) "unknown" from (select case when p_size % 9 = 0 then null else p_retailprice end pr from part))""")
def budget_verdict(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice")).alias("pr"))
    return score.budget_verdict(p, price="pr", budget=1000, wanted=50)


@query("""
with s as (select c_nationkey k, sum(case when c_custkey % 2 = 0 then c_acctbal::decimal(18,2) else 0 end) a, sum(case when c_custkey % 2 = 1 then c_acctbal::decimal(18,2) else 0 end) b from customer group by 1), x as (select *, a - b diff from s),
u as (select k, row_number() over (order by diff desc, k) r from x where diff > 0)
select x.k, diff::double diff, round(case when b = 0 then null else diff::double / b::double end, 6) rate, case when r <= 3 then r end::int rank_up from x left join u on x.k = u.k""")
def changes_summary(spark, d):
    amt = F.col("c_acctbal").cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    s = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum(F.when(F.col("c_custkey") % 2 == 0, amt).otherwise(zero)).alias("a"), F.sum(F.when(F.col("c_custkey") % 2 == 1, amt).otherwise(zero)).alias("b"))
    r = aggregate.changes_summary(s, "k", "a", "b")
    return r.select("k", F.col("diff").cast("double").alias("diff"), F.round(F.try_divide(F.col("diff").cast("double"), F.col("b").cast("double")), 6).alias("rate"), "rank_up")


@query("""
with b as (select o_custkey, o_orderkey, o_totalprice::decimal(18,2) t from orders), w as (select *, sum(t) over (partition by o_custkey) - t rest, count(*) over (partition by o_custkey) n, row_number() over (partition by o_custkey, t order by o_orderkey) cp from b),
c as (select *, min(case when abs(rest - t) <= 3000 and n >= 3 then o_orderkey end) over (partition by o_custkey) fc from w)
select o_orderkey, case when fc is not null then o_orderkey = fc else cp = 1 end counts from c""")
def fold_bodies(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast(MONEY).alias("t"))
    return aggregate.fold_bodies(o, by="o_custkey", total="t", order="o_orderkey", tolerance=3000).select("o_orderkey", "counts")


@query("""
with x as (select p_partkey, 'p' || (p_partkey % 50) code, p_size from part)
select p_partkey, coalesce(a.n_name, b.n_name) n_name from x left join (select 'p' || n_nationkey k, n_name from nation where n_nationkey > 9) a on x.code = a.k left join (select n_nationkey k, n_name from nation) b on b.k = x.p_size""")
def lookup_twice(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey") % 50).alias("code"), F.col("p_size").cast("string").alias("s"))
    n = table(spark, d, "nation")
    dim = n.where("n_nationkey > 9").select(F.concat(F.lit("p"), "n_nationkey").alias("k"), "n_name").unionByName(n.select(F.col("n_nationkey").cast("string").alias("k"), "n_name"))
    return lookup.lookup_twice(p, dim, key="code", dim_key="k", second=F.col("s"), value="n_name").select("p_partkey", "n_name")


@query("""
with u as (select o_custkey, o_orderkey, row_number() over (order by o_orderdate, o_orderkey) seq_row from orders), f as (select o_custkey, min(o_orderdate) m from orders group by 1)
select o_custkey, row_number() over (order by m, o_custkey) seq from f""")
def group_sequence(spark, d):
    return ordered.group_sequence(table(spark, d, "orders"), group="o_custkey", order="o_orderdate")


@query("""
select o_orderkey, array_to_string(list_filter([case when not (o_totalprice > 1000) then 'total' end, case when not (o_orderstatus in ('F', 'O')) then 'status' end, case when not (o_custkey % 3 <> 0) then 'customer' end], lambda x: x is not null), ',') issues,
 case when o_orderstatus = 'P' then 'pending' when o_totalprice < 20000 then 'small' when year(o_orderdate) < 1993 then 'old' end reason from orders""")
def row_checks(spark, d):
    o = table(spark, d, "orders")
    i = choices.issues([("total", F.col("o_totalprice") > 1000), ("status", F.col("o_orderstatus").isin("F", "O")), ("customer", F.col("o_custkey") % 3 != 0)])
    r = choices.first_reason([("pending", F.col("o_orderstatus") == "P"), ("small", F.col("o_totalprice") < 20000), ("old", F.year("o_orderdate") < 1993)])
    return o.select("o_orderkey", F.array_join(i, ",").alias("issues"), r.alias("reason"))


@query("""
with a as (select p_brand g, p_size m from part where p_partkey % 2 = 0), b as (select p_brand g, p_size m from part where p_partkey % 3 = 0),
sa as (select list(distinct m order by m)::varchar members from a group by g), sb as (select list(distinct m order by m)::varchar members from b group by g)
select members, 'a' side from (select members from sa except all select members from sb) union all select members, 'b' from (select members from sb except all select members from sa)""")
def changed_groups(spark, d):
    p = table(spark, d, "part")
    r = evaluate.changed_groups(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0"), "p_brand", "p_size")
    return r.select(F.concat(F.lit("["), F.array_join(F.col("members").cast("array<string>"), ", "), F.lit("]")).alias("members"), "side")


@query()
def fuzzy_ratio_join(spark, d):
    p = table(spark, d, "part")
    return _fuzzy(p)


def _fuzzy(p):
    a = p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("a_name"))
    b = p.where("p_partkey % 2 = 1").select(F.col("p_name").alias("b_name"))
    return matching.fuzzy_match(a, b, left_col="a_name", right_col="b_name", cutoff=0.9)


@query()
def greedy_assign(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("l"), F.col("l_partkey").alias("r")).agg(F.count("*").alias("score"))
    return matching.greedy_assign(li, by="g", left="l", right="r", score="score")


def _placed(spark, d):
    """Lines with their place in the order; line numbers may stand twice."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return table(spark, d, "lineitem").withColumn("pos", F.row_number().over(w))


@query("""
with recursive l as (select l_orderkey, l_linenumber, case when l_quantity > 47 then 'worksheet' when l_quantity < 5 then 'attachment' else 'body' end kind, l_suppkey % 3 party, month(l_shipdate)::int m, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) rn from lineitem),
s as (select distinct l_orderkey, '' kind, null::bigint party, null::int m, null::double l_quantity, 0::bigint rn, 0 no, '' md, null::bigint kp, null::int km, null::double amt, false w from l
 union all select l.l_orderkey, l.kind, l.party, l.m, l.l_quantity, l.rn,
  case when l.kind = 'attachment' then greatest(s.no, 1) when l.kind = 'body' and (s.md = 'worksheet' or (s.kp is not null and l.party = s.kp and (l.m = s.km or l.l_quantity = s.amt))) then s.no when s.w then s.no else s.no + 1 end,
  case when l.kind = 'worksheet' then 'worksheet' when l.kind = 'attachment' then case when s.no = 0 then 'waiting' else s.md end when s.md = 'worksheet' or (s.kp is not null and l.party = s.kp and (l.m = s.km or l.l_quantity = s.amt)) then s.md else 'body' end,
  case when l.kind = 'worksheet' then null when l.kind = 'attachment' then s.kp when s.md = 'worksheet' or (s.kp is not null and l.party = s.kp and (l.m = s.km or l.l_quantity = s.amt)) then coalesce(s.kp, l.party) else l.party end,
  case when l.kind = 'worksheet' then null when l.kind = 'attachment' then s.km when s.md = 'worksheet' or (s.kp is not null and l.party = s.kp and (l.m = s.km or l.l_quantity = s.amt)) then coalesce(s.km, l.m) else l.m end,
  case when l.kind = 'worksheet' then null when l.kind = 'attachment' then s.amt when s.md = 'worksheet' or (s.kp is not null and l.party = s.kp and (l.m = s.km or l.l_quantity = s.amt)) then coalesce(s.amt, l.l_quantity) else l.l_quantity end,
  case when l.kind = 'attachment' then s.no = 0 or s.w else false end
 from s join l on l.l_orderkey = s.l_orderkey and l.rn = s.rn + 1)
select l_orderkey, rn pos, kind, party, m, l_quantity, no::int group_no from s where rn > 0""")
def group_state_machine(spark, d):
    li = _placed(spark, d).select("l_orderkey", "pos", F.when(F.col("l_quantity") > 47, "worksheet").when(F.col("l_quantity") < 5, "attachment").otherwise("body").alias("kind"), (F.col("l_suppkey") % 3).alias("party"), F.month("l_shipdate").alias("m"), "l_quantity")
    return ordered.page_groups(li, file="l_orderkey", order="pos", kind="kind", party="party", month="m", total="l_quantity")


@query("""
with recursive l as (select l_orderkey, l_linenumber, l_quantity::bigint q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) rn from lineitem),
s as (select l_orderkey, rn, q, false is_subtotal, q::bigint t, 1 n from l where rn = 1
 union all select l.l_orderkey, l.rn, l.q, s.n >= 2 and s.t = l.q, case when s.n >= 2 and s.t = l.q then 0 else s.t + l.q end, case when s.n >= 2 and s.t = l.q then 0 else s.n + 1 end from s join l on l.l_orderkey = s.l_orderkey and l.rn = s.rn + 1)
select l_orderkey, rn pos, q, is_subtotal from s""")
def subtotal_pruning(spark, d):
    li = _placed(spark, d).select("l_orderkey", "pos", F.col("l_quantity").cast("bigint").alias("q"))
    return ordered.drop_subtotals(li, by="l_orderkey", order="pos", amount="q")
