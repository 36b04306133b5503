"""Queries of keys, vouchers, participants and picked files, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import dates, numbers, text
from tallyloom.operators import aggregate, evaluate, matching, resolve, search
from tallyloom.plans.registry import Registry
from tallyloom.plans.rules import _NARROW, _WIDE
from tallyloom.session import table
from tallyloom.sources import readers

R = Registry()
query = R.query


def _raw(spark, d):
    return table(spark, d, "raw")


_NF = f"nfc_normalize(translate(spelling, '{_WIDE}', '{_NARROW}'))"


@query(f"""
select distinct payee_code, spelling, translate(regexp_replace(regexp_replace({_NF}, '[\\s　]+', '', 'g'), '株式会社|有限会社|合同会社|一般社団法人|公益社団法人|公益財団法人|\\(株\\)|\\(有\\)|\\(同\\)|㈱|㈲|[・･‐-]', '', 'g'), '{"".join(text.VARIANTS)}', '{"".join(text.VARIANTS.values())}') payee,
 lower(regexp_replace(regexp_replace(spelling, '^\\d+', ''), '株式会社|有限会社|合同会社|\\(株\\)|（株）|\\(有\\)|（有）|㈱|㈲|支店|営業所|様|御中|・|[\\s　]', '', 'g')) vendor from payee_alias""")
def payee_keys(spark, d):
    a = table(spark, d, "payee_alias").select("payee_code", "spelling").distinct()
    return a.select("payee_code", "spelling", text.payee_key(F.col("spelling")).alias("payee"), text.vendor_key(F.col("spelling")).alias("vendor"))


@query("""
select o_orderkey, case when year(o_orderdate) >= 2019 then '令和' || (year(o_orderdate) - 2018) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' end era, lpad((o_orderkey % 9000 + 100)::varchar, 4, '0') vehicle,
 'Deck ' || o_orderkey || e'\\nhttps://x.test/d/' || o_orderkey identity from orders""")
def written_keys(spark, d):
    k = F.col("o_orderkey").cast("string")
    plate = F.concat(F.lit("港 ３０ き "), (F.col("o_orderkey") % 9000 + 100).cast("string"))
    url = F.concat(F.lit("https://www.X.test/d/"), k, F.lit("/?usp=share#top"))
    return table(spark, d, "orders").select("o_orderkey", dates.era_text(F.col("o_orderdate").cast("date")).alias("era"), text.vehicle_key(plate).alias("vehicle"), text.file_identity(F.concat(F.lit(" Deck "), k), url).alias("identity"))


@query("""
with l as (select p_partkey, case p_size % 4 when 0 then p_size || '-' || (p_size + 9) when 1 then p_size || 's' when 2 then 'over ' || p_size else 'all' end label, case p_size % 4 when 0 then p_size + 9 when 1 then p_size when 2 then p_size end top from part)
select p_partkey, case when top // 10 * 10 between 20 and 60 then (top // 10 * 10)::int end as "decade", case when coalesce(top // 10 * 10 between 20 and 60, false) then null else label end dropped from l""")
def age_decades(spark, d):
    s = F.col("p_size")
    label = F.when(s % 4 == 0, F.concat(s.cast("string"), F.lit("-"), (s + 9).cast("string"))).when(s % 4 == 1, F.concat(s.cast("string"), F.lit("s"))).when(s % 4 == 2, F.concat(F.lit("over "), s.cast("string"))).otherwise("all")
    return table(spark, d, "part").select("p_partkey", numbers.decade_of(label).alias("x")).select("p_partkey", "x.*")


@query("""
with l as (select *, row_number() over (partition by voucher_key order by account nulls first, department nulls first, sub nulls first, segment nulls first, amount nulls first, memo nulls first)::int n from journal),
s as (select voucher_key, sum(amount) s, sum(amount) + case when hash(voucher_key) is not null and length(voucher_key) % 2 = 0 then 1 else 0 end t from journal group by 1)
select voucher_key, 'zero' issue, n line from l where coalesce(amount, 0) = 0 union all select voucher_key, c, n from (select voucher_key, n, unnest([case when coalesce(trim(department), '') = '' then 'department' end, case when coalesce(trim(account), '') = '' then 'account' end, case when coalesce(trim(sub), '') = '' then 'sub' end]) c from l) where c is not null
 union all select voucher_key, 'negative', n from l where amount < 0 and not contains(coalesce(memo, ''), 'refund') union all select voucher_key, 'sum', null from s where coalesce(t, 0) <> 0 and coalesce(s, 0) <> t""")
def voucher_issues(spark, d):
    j = table(spark, d, "journal")
    order = [F.asc_nulls_first(c) for c in ("account", "department", "sub", "segment", "amount", "memo")]
    lines = j.withColumn("n", F.row_number().over(Window.partitionBy("voucher_key").orderBy(*order)))
    v = j.groupBy("voucher_key").agg(F.sum("amount").alias("s")).select("voucher_key", (F.col("s") + F.when(F.length("voucher_key") % 2 == 0, 1).otherwise(0)).alias("t"))
    return evaluate.voucher_issues(lines, v, key="voucher_key", line="n", amount="amount", total="t", codes=["department", "account", "sub"], memo="memo", reasons=("refund",))


@query("""
with g as (select payee_code k, min(nullif(trim(account), '')) a, max(nullif(trim(account), '')) b, min(nullif(trim(memo), '')) m, max(nullif(trim(memo), '')) n from journal group by 1)
select k payee_code, a account, case when a is null then 'none' when a = b then 'one' else 'several' end account_is, m memo, case when m is null then 'none' when m = n then 'one' else 'several' end memo_is from g""")
def gathered_attributes(spark, d):
    return aggregate.gathered(table(spark, d, "journal"), ["payee_code"], ["account", "memo"])


@query("""
with e as (select _id, i o, trim(x) x from (select _id, unnest(string_split(name, ';')) x, generate_subscripts(string_split(name, ';'), 1) * 2 i from raw where source = 'meeting' and name is not null)), s as (select _id, 1 o, trim(regexp_extract(sender, '([A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+)', 1)) x from raw where source = 'meeting' and sender is not null),
d as (select _id, o, x as "name", lower(regexp_replace(x, '[\\s　]+', '', 'g')) k from (select * from e union all select * from s) where x <> ''), g as (select _id, k, arg_min("name", o) as "name", min(o) o from d where k <> '' and k <> 'zoom' group by 1, 2)
select _id, (row_number() over (partition by _id order by o, k))::int pos, "name", not contains("name", '@') unresolved from g""")
def merged_participants(spark, d):
    """The first address of a meeting before the names of its people."""
    r = _raw(spark, d).where("source = 'meeting'")
    names = r.where("name is not null").select("_id", F.posexplode(F.split("name", ";")).alias("p", "n")).select("_id", ((F.col("p") + 1) * 2).alias("o"), "n", F.lit(None).cast("string").alias("e"))
    first = r.where("sender is not null").select("_id", F.lit(1).alias("o"), F.lit("").alias("n"), F.regexp_extract("sender", r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+)", 1).alias("e"))
    return resolve.merged_participants(first.unionByName(names), by="_id", order="o", name="n", email="e", blocked=("zoom",))


@query("""
with f as (select project, _id, regexp_replace(links[1], '\\s+$', '') n, case when contains(links[1], '.pdf') then 'pdf' when contains(links[1], '.md') then 'note' else 'other' end kind from raw where source in ('drive', 'file') and len(links) > 0 and project is not null),
b as (select *, case kind when 'note' then 1 when 'pdf' then 2 end r, regexp_replace(n, '[0-9a-f]{6,}', '', 'g') b from f), o as (select * from (select *, row_number() over (partition by project, b order by r, _id desc, n) k from b where r is not null) where k = 1)
select project, _id, place::int place from (select *, row_number() over (partition by project order by r, _id desc, n) place from o) where place <= 3""")
def picked_files(spark, d):
    f = _raw(spark, d).where("source in ('drive', 'file') and size(links) > 0 and project is not null").select("project", "_id", F.regexp_replace(F.get("links", F.lit(0)), r"\s+$", "").alias("n"))
    f = f.where("n is not null").withColumn("kind", F.when(F.col("n").contains(".pdf"), "pdf").when(F.col("n").contains(".md"), "note").otherwise("other"))
    p = search.picked_files(f, by=["project"], name="n", base=F.regexp_replace("n", "[0-9a-f]{6,}", ""), newness="_id", kind="kind", kinds=["note", "pdf"])
    return p.select("project", "_id", "place")


@query("""
with g as (select * from raw where source = 'gmail' and parents <> ''), l as (select parents from g group by 1 order by max("timestamp") desc nulls last, parents limit 15)
select _id, parents from (select *, row_number() over (partition by parents order by "timestamp" nulls last, _id) n from g where parents in (select parents from l)) where n <= 3""")
def capped_threads(spark, d):
    """The fifteen threads that moved last, three mails of each, as the feature has it."""
    return search.capped_threads(_raw(spark, d).where("source = 'gmail'"), thread="parents", time="timestamp", id_col="_id", rows=3).select("_id", "parents")


@query("""
select _id, case when coalesce(trim(note_path), '') = '' then 'no path' when content is null then 'missing' when trim(content, ' ') = '' then 'empty' end reason, case when coalesce(trim(note_path), '') <> '' and content is not null and trim(content, ' ') <> '' then substr(content, 1, 50) end as text, coalesce(length(content) > 50, false) truncated from raw""")
def notes_or_reasons(spark, d):
    return _raw(spark, d).select("_id", readers.note_or_reason(F.col("note_path"), F.col("content"), 50).alias("x")).select("_id", "x.*")


@query("""
with a as (select c_custkey i, c_nationkey k, c_mktsegment m, round(c_acctbal)::bigint b from customer where c_custkey % 2 = 0), z as (select c_custkey j, c_nationkey k, c_mktsegment m, round(c_acctbal)::bigint b from customer where c_custkey % 2 = 1),
u as (select i, j from (select k, b, min(i) i from a group by 1, 2 having count(*) = 1) x join (select k, b, min(j) j from z group by 1, 2 having count(*) = 1) y using (k, b)), a2 as (select * from a where i not in (select i from u)), z2 as (select * from z where j not in (select j from u)),
g as (select k, m from (select k, m, count(*) n, count(distinct b) d from a2 group by 1, 2) x join (select k, m, count(*) n, count(distinct b) d from z2 group by 1, 2) y using (k, m, n, d) where n = d)
select i, j, 'exact' stage from u union all select i, j, 'groups' from (select *, row_number() over (partition by k, m order by b) r from a2 where (k, m) in (select (k, m) from g)) x join (select *, row_number() over (partition by k, m order by b) r from z2 where (k, m) in (select (k, m) from g)) y using (k, m, r)""")
def staged_groups(spark, d):
    """Balances that are equal, then nations and segments with as many customers left on both sides, in the order of their balances."""
    c = table(spark, d, "customer")
    side = lambda n, i: c.where(F.col("c_custkey") % 2 == n).select(F.col("c_custkey").alias(i), F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("m"), F.round("c_acctbal").cast("bigint").alias("b"))
    return matching.staged_match(side(0, "i"), side(1, "j"), left_id="i", right_id="j", stages=[("exact", ["k", "b"]), ("groups", ["k", "m"], "b")])
