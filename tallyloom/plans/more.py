"""Further queries of the core operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import choices, dates, numbers, text
from tallyloom.operators import aggregate, lookup, matching, ordered, panel, resolve, score, search
from tallyloom.plans.registry import Registry
from tallyloom.session import table

R = Registry()
query = R.query
MONEY = "decimal(18,2)"


@query("""
with t as (select _id, lower(trim(subject)) t, sender, to_addr from raw where source in ('gmail', 'meeting')), n as (select distinct project, replace(lower(regexp_replace(project, '^pjt_', '')), '_', ' ') k from domain_map where project is not null),
e as (select _id, min(project) p from t join n on t.t = n.k group by 1), wd as (select _id, min(project) p from t join n on k <> '' and contains(t, k) group by 1),
a as (select _id, unnest(regexp_extract_all(lower(concat_ws(';', sender, to_addr)), '[a-z0-9._%+\\-]+@([a-z0-9\\-]+(?:\\.[a-z0-9\\-]+)+)', 1)) d, generate_subscripts(regexp_extract_all(lower(concat_ws(';', sender, to_addr)), '[a-z0-9._%+\\-]+@([a-z0-9\\-]+(?:\\.[a-z0-9\\-]+)+)', 1), 1) r from t),
m as (select lower(domain) d, min(project) project from domain_map where project is not null and domain is not null group by 1),
x as (select _id, project p, d, row_number() over (partition by _id order by min(r) + case when d = 'quayside.example' then 1000000 else 0 end, project, d) rn from a join m using (d) group by _id, project, d), dm as (select _id, p from x where rn = 1 and d <> 'quayside.example'),
ins as (select _id, bool_and(d = 'quayside.example') ok from a group by 1)
select t._id, coalesce(e.p, wd.p, dm.p) project, case when e.p is not null then 'topic' when wd.p is not null then 'word' when dm.p is not null then 'domain' when coalesce(ins.ok, false) then 'unclassified' else 'open' end how
from t left join e using (_id) left join wd using (_id) left join dm using (_id) left join ins using (_id)""")
def project_cascade(spark, d):
    r = table(spark, d, "raw").where("source in ('gmail', 'meeting')").select("_id", "subject", "sender", "to_addr")
    m = table(spark, d, "domain_map")
    return resolve.project_cascade(r, m, m, id_col="_id", topic="subject", headers=["sender", "to_addr"], own_domain="quayside.example")


@query("""
with p as (select p_partkey, p_brand, p_size, p_retailprice, case when p_size < 5 then 'small' when p_retailprice < 950 then 'cheap' end reason from part),
r as (select *, row_number() over (partition by p_brand, reason is null order by p_retailprice desc, p_partkey) rn from p), q as (select p_partkey, p_retailprice, case when reason is null and rn > 10 then 'over_group' else reason end reason from r),
k as (select p_partkey from q where reason is null order by p_retailprice desc, p_partkey limit 100)
select p_partkey, case when reason is null and p_partkey not in (select p_partkey from k) then 'over_total' else reason end reason from q""")
def evidence_cascade(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    r = search.capped_cascade(p, [("small", F.col("p_size") < 5), ("cheap", F.col("p_retailprice") < 950)], group="p_brand", order=[F.desc("p_retailprice"), F.asc("p_partkey")], per_group=10, total=100)
    return r.select("p_partkey", "reason")


@query("""
with l as (select l_orderkey k, min(l_suppkey) s, case when min(l_linenumber) > 1 then min(l_partkey) end p from lineitem group by 1)
select o_orderkey, coalesce(case when o_custkey % 2 = 0 then o_custkey end, s) code from orders left join l on k = o_orderkey""")
def inherit_codes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("code"))
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_suppkey").alias("code"))
    return lookup.inherit(o, p, "k", ["code"]).select(F.col("k").alias("o_orderkey"), "code")


@query("""
select o_orderkey, case when bool_or(o_orderpriority like '1%') over (partition by o_custkey) then case when o_orderpriority like '1%' then o_orderpriority end else max(o_orderstatus) over (partition by o_custkey) end code from orders""")
def spread_codes(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("code"))
    return lookup.spread_if_absent(o, "o_custkey", "code", "o_orderstatus").select("o_orderkey", "code")


@query("""
with f as (select o_custkey k, first(o_orderpriority order by o_orderkey) pr, first(o_orderstatus order by o_orderkey) st from orders group by 1) select c_custkey, coalesce(pr, 'none') o_orderpriority, coalesce(st, '?') o_orderstatus from (select c_custkey * 2 c_custkey from customer) left join f on k = c_custkey""")
def first_row_lookup(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("o_custkey"))
    r = lookup.first_row_lookup(c, table(spark, d, "orders"), on="o_custkey", order="o_orderkey", values={"o_orderpriority": "none", "o_orderstatus": "?"})
    return r.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus")


@query("""
select voucher_key, memo, array_to_string(list_filter([case when department is distinct from h and h is not null then 'department' end, case when segment is distinct from g and g is not null then 'segment' end], lambda x: x is not null), ',') wrong
from (select *, case when account like '1%' then '0001' when account like '2%' then '0002' end h, case when length(coalesce(memo, '')) % 2 = 0 then segment end g from journal)""")
def hint_disagreement(spark, d):
    hint = F.when(F.col("account").startswith("1"), "0001").when(F.col("account").startswith("2"), "0002")
    seg = F.when(F.length(F.coalesce("memo", F.lit(""))) % 2 == 0, F.col("segment"))
    w = choices.disagreements({"department": F.col("department"), "segment": F.col("segment")}, {"department": hint, "segment": seg})
    return table(spark, d, "journal").select("voucher_key", "memo", F.array_join(w, ",").alias("wrong"))


@query("""
with m as (select o_orderpriority m from (select o_orderpriority, count(*) n, min(o_orderkey) f from orders group by 1) order by n desc, f limit 1), b as (select o_orderstatus s from (select o_orderstatus, count(*) n, min(o_orderkey) f from orders where o_orderpriority = (select m from m) group by 1) order by n desc, f limit 1)
select o_orderkey, case when o_orderpriority = (select m from m) then (select s from b) else o_orderstatus end o_orderstatus from orders""")
def mode_of_main(spark, d):
    return aggregate.mode_of_main(table(spark, d, "orders"), main="o_orderpriority", value="o_orderstatus", order="o_orderkey").select("o_orderkey", "o_orderstatus")


@query()
def equal_groups(spark, d):
    """Every part, in groups of brand, type and size, paired by price."""
    p = table(spark, d, "part")
    side = lambda n, c: p.where(F.col("p_partkey") % 2 == n).select("p_brand", "p_type", "p_size", F.col("p_partkey").alias(c), F.col("p_retailprice").alias("v"))
    return matching.pair_equal_groups(side(0, "l"), side(1, "r"), keys=["p_brand", "p_type", "p_size"], left_id="l", right_id="r", value="v")


@query("""
with b as (select o_custkey, (floor(sum(o_totalprice::decimal(18,2)) / 1000) * 1000)::bigint t from orders group by 1), c as (select l_orderkey cover, (floor(sum(l_extendedprice::decimal(18,2)) / 1000) * 1000)::bigint t from lineitem group by 1)
select cover, o_custkey, t total from (select *, row_number() over (partition by t order by cover) rn from c) x join (select *, row_number() over (partition by t order by o_custkey) rn from b) y using (t, rn)""")
def truncated_totals(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cover")).agg((F.floor(F.sum(F.col("l_extendedprice").cast(MONEY)) / 1000) * 1000).cast("bigint").alias("total"))
    o = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").cast(MONEY).alias("amount"))
    return matching.truncated_totals(c, o, cover="cover", block="o_custkey", total="total", amount="amount")


@query("""
select p_partkey, case when w1 > 0 and w1 >= w2 and w1 >= w3 then 'a' when w2 > 0 and w2 >= w3 then 'b' when w3 > 0 then 'c' end band from (
 select p_partkey, greatest(0, least(h, 10) - greatest(l, 0)) w1, greatest(0, least(h, 30) - greatest(l, 10)) w2, greatest(0, least(h, 60) - greatest(l, 30)) w3 from (select p_partkey, p_size l, p_size + p_partkey % 40 h from part))""")
def largest_overlap(spark, d):
    low = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", numbers.best_band(low, low + F.col("p_partkey") % 40, [("a", 0, 10), ("b", 10, 30), ("c", 30, 60)]).alias("band"))


@query("""
with v as (select y from (values ('1992'), ('1995'), ('2030')) t(y) where y not in (select year(o_orderdate)::varchar from orders)) select coalesce(string_agg(y, ',' order by y), '') missing, count(*) = 0 ok from v""")
def month_presence(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").cast("string").alias("y"))
    return aggregate.require_present(o, "y", ["1992", "1995", "2030"]).withColumn("missing", F.array_join("missing", ","))


@query("""
select l_orderkey, case when abs(a - t) <= 100 then 'a' when abs(b - t) <= 100 then 'b' else 'c' end adopted from (select l_orderkey, sum(case when l_linenumber <= 2 then l_quantity end)::decimal(18,2) a, sum(case when l_returnflag = 'N' then l_quantity end)::decimal(18,2) b, sum(l_quantity)::decimal(18,2) c, (sum(l_quantity) + 90)::decimal(18,2) t from lineitem group by 1)""")
def adopted_sum(spark, d):
    q = F.col("l_quantity").cast(MONEY)
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linenumber") <= 2, q)).alias("a"), F.sum(F.when(F.col("l_returnflag") == "N", q)).alias("b"), F.sum(q).alias("c"), (F.sum(q) + 90).alias("t"))
    return aggregate.adopted(g, by="l_orderkey", amount="t", sums=["a", "b", "c"], tolerance=100).select("l_orderkey", "adopted")


@query("""
with x as (select o_orderkey doc, o_orderkey % 20 pg, 1 + (o_orderkey % 3) * 5 f from orders) select l_orderkey, count(*) n from lineitem where l_orderkey in (select doc from x where pg between f and f + 7) group by 1""")
def owned_lines(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 20).alias("pg"), (1 + (F.col("o_orderkey") % 3) * 5).alias("f")).withColumn("l", F.col("f") + 7)
    _, lines = matching.owned(o, table(spark, d, "lineitem"), doc="l_orderkey", first_page="pg", own_first="f", own_last="l")
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""
with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by case when o_orderpriority like '1%' then 0 else 1 end, o_totalprice desc, o_orderkey) rk from orders where o_orderstatus <> 'P') select o_custkey, o_orderkey, rk::int as rank from r where rk <= 5""")
def top_concerns(spark, d):
    o = table(spark, d, "orders").withColumn("pr", F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(1)).withColumn("sev", F.struct("o_totalprice", -F.col("o_orderkey")))
    return panel.top_concerns(o, by="o_custkey", priority="pr", severity="sev", blocked=F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey", "rank")


@query("""
select p_partkey, price from (select p_partkey, case when p_size % 9 = 0 then null else p_retailprice end price from part) order by price is null, price desc, p_partkey limit 60""")
def unknown_price_last(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice")).alias("price"))
    return p.orderBy(*score.unknown_last("price", ascending=False), "p_partkey").limit(60)


@query("""
select p_partkey, row_number() over (order by case when abs(dv - v) > 15 then dv else v end desc, p_partkey) - 1 as pos, case when abs(dv - v) > 15 then dv else v end::double as value from (select p_partkey, p_size v, (p_partkey * 7) % 50 dv from part) order by pos limit 40 offset 10""")
def verified_rerank(spark, d):
    p = table(spark, d, "part").select("p_partkey", score.verified(F.col("p_size"), (F.col("p_partkey") * 7) % 50).cast("double").alias("value"))
    top = p.orderBy(F.desc("value"), "p_partkey").offset(10).limit(40)
    return top.select("p_partkey", (F.row_number().over(Window.orderBy(F.desc("value"), "p_partkey")) + 9).cast("bigint").alias("pos"), "value")  # 40 rows


@query("""
with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 src from lineitem where l_linenumber <= 4 union all select l_orderkey, l_linenumber, l_partkey, l_suppkey + 1, 2 from lineitem where l_linenumber >= 3),
k as (select *, row_number() over (partition by l_orderkey, l_linenumber, l_partkey order by src, l_suppkey) rn from r) select l_orderkey, l_linenumber, l_partkey, l_suppkey, src from k where rn = 1""")
def overlap_merge(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    u = li.where("l_linenumber <= 4").withColumn("src", F.lit(1)).unionByName(li.where("l_linenumber >= 3").withColumn("l_suppkey", F.col("l_suppkey") + 1).withColumn("src", F.lit(2)))
    return ordered.keep(u, ["l_orderkey", "l_linenumber", "l_partkey"], [F.asc("src"), F.asc("l_suppkey")])


@query("""
select o_orderkey, y, strftime((od + interval 3 month)::date, '%Y-%m') later, valid from (select o_orderkey, o_orderdate::date od, [x for x in regexp_extract_all(o_orderkey::varchar || ' ' || year(o_orderdate)::varchar || ' 1984 2100', '(?:^| )([0-9]{4})(?= |$)', 1) if x::int between 1985 and 2100][1] y, true valid from orders where false)
union all select o_orderkey, year(o_orderdate)::varchar, strftime((o_orderdate::date + interval 3 month)::date, '%Y-%m'), regexp_matches(strftime(o_orderdate, '%Y/%m/%d'), '^[0-9]{4}/[0-9]{2}/[0-9]{2}$') from orders""")
def date_forms(spark, d):
    o = table(spark, d, "orders")
    written = F.date_format("o_orderdate", "yyyy/MM/dd")
    years = dates.year_candidates(F.concat_ws(" ", F.lit("x"), F.year("o_orderdate"), F.lit("1984 21000")))
    return o.select("o_orderkey", F.get(years, F.lit(0)).cast("string").alias("y"), F.date_format(F.add_months(dates.loose_date(written), 3), "yyyy-MM").alias("later"), choices.valid_format(written, "date").alias("valid"))


@query("""
select _id, trim(case when contains(lower(coalesce(subject, '')), 'invoice') then 'I' else '' end || case when contains(lower(coalesce(subject, '')), 'voucher') then 'V' else '' end) tag, lower(nullif(regexp_extract(coalesce(sender, ''), '([A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(?:\\.[A-Za-z0-9\\-]+)+)', 1), '')) email, len(list_distinct(regexp_extract_all(lower(coalesce(cc_bcc, '')), '[a-z0-9._%+\\-]+@[a-z0-9\\-]+(?:\\.[a-z0-9\\-]+)+'))) n_cc,
 substr(md5(source || chr(31) || coalesce(subject, '')), 1, 16) stable from raw where source = 'gmail'""")
def mail_parts(spark, d):
    s = F.lower(F.coalesce("subject", F.lit("")))
    tag = F.concat(F.when(s.contains("invoice"), "I").otherwise(""), F.when(s.contains("voucher"), "V").otherwise(""))
    return table(spark, d, "raw").where("source = 'gmail'").select("_id", tag.alias("tag"), text.first_email(F.col("sender")).alias("email"), F.size(text.emails(F.col("cc_bcc"))).cast("bigint").alias("n_cc"), text.stable_name(F.col("source"), F.coalesce("subject", F.lit(""))).alias("stable"))


@query("""
with x as (select event_id, user_id, 'hi <@U' || (user_id % 200) || '> and <@U' || (event_id % 300) || '>' t from events), u as (select 'U' || n_nationkey k, n_name from nation)
select event_id, replace(replace(t, '<@U' || (user_id % 200) || '>', coalesce('@' || a.n_name, '<@U' || (user_id % 200) || '>')), '<@U' || (event_id % 300) || '>', coalesce('@' || b.n_name, '<@U' || (event_id % 300) || '>')) t from x left join u a on a.k = 'U' || (user_id % 200) left join u b on b.k = 'U' || (event_id % 300)""")
def replace_mentions(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("hi <@U"), F.col("user_id") % 200, F.lit("> and <@U"), F.col("event_id") % 300, F.lit(">")).alias("t"))
    u = table(spark, d, "nation").select(F.concat(F.lit("U"), "n_nationkey").alias("k"), "n_name")
    return search.replace_mentions(e, u, id_col="event_id", text_col="t", user_id="k", user_name="n_name")


@query("""
select o_orderkey, coalesce(case when o_orderkey % 3 <> 0 then o_orderstatus end, o_orderpriority) a, case when o_orderkey % 3 = 0 then 'a' else '' end filled, case when o_orderkey % 3 <> 0 then 'main' else 'other' end source from orders""")
def fill_from_second(spark, d):
    o = table(spark, d, "orders").withColumn("m", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    pr = choices.by_priority([("main", F.col("m")), ("other", F.col("o_orderpriority"))])
    a, filled = choices.fill_missing({"a": F.col("m")}, {"a": F.col("o_orderpriority")})
    return o.select("o_orderkey", a, F.array_join(filled, ",").alias("filled"), pr["source"].alias("source"))
