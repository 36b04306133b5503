"""Queries of the column functions, small readers and sources, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import choices, dates, numbers, text
from tallyloom.operators import aggregate, lookup, ordered, predicates
from tallyloom.plans.registry import Registry
from tallyloom.plans.rules import _NARROW, _WIDE
from tallyloom.session import table
from tallyloom.sources import paged, readers, writers
from tallyloom.streaming import ingest

R = Registry()
query = R.query


def _raw(spark, d):
    return table(spark, d, "raw")


@query("""
select _id, regexp_replace(name, '[\\s　]+', '', 'g') squashed, lower(trim(regexp_replace(name, '[\\s　]+', ' ', 'g'), ' ')) compared, lower(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(translate(name, '""" + _WIDE + """', '""" + _NARROW + """')), '[ 　\\t\\r\\n\\-_./\\\\・]', '', 'g'), '支店|チーム|営業', '', 'g'), '$', '')) branch,
 nullif(array_to_string(regexp_extract_all(translate(content, '０１２３４５６７８９', '0123456789'), '\\d+'), '-'), '') lot from raw where source <> 'meeting'""")
def text_keys(spark, d):
    n, c = F.col("name"), F.col("content")
    return _raw(spark, d).where("source <> 'meeting'").select("_id", text.squash(n).alias("squashed"), text.compare_key(n).alias("compared"), text.branch_key(n).alias("branch"), text.lot_key(c).alias("lot"))


@query("""
select o_orderkey, o_orderdate::date loose, case when year(o_orderdate) >= 1990 then o_orderdate::date end era, case when year(o_orderdate) >= 2000 then strftime(o_orderdate, '%Y%m') end ym, true same from orders""")
def written_dates(spark, d):
    """Dates written in four ways and in eras come out as they went in."""
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, F.date_format("day", "yyyy年M月d日")).when(k == 1, F.date_format("day", "yyyy/MM/dd")).when(k == 2, F.date_format("day", "yyyyMMdd")).otherwise(F.date_format("day", "yyyy.M.d"))
    year = F.year("day")
    tail = F.date_format("day", "M月d日")
    era = F.when(year >= 2019, F.concat(F.lit("令和"), F.when(year == 2019, F.lit("元")).otherwise((year - 2018).cast("string")), F.lit("年"), tail)).when(year >= 1990, F.concat(F.lit("平成"), (year - 1988).cast("string"), F.lit("年"), tail))
    ym = dates.year_month(F.concat(F.lit("from "), F.date_format("day", "yyyy-M"), F.lit(" on")))
    return o.select("o_orderkey", dates.loose_date(written).alias("loose"), dates.era_date(era).alias("era"), ym.alias("ym"), dates.same_month(F.date_format("day", "yyyyMM"), F.when(k > 1, F.date_format("day", "yyyyMM"))).alias("same"))


@query("""
with o as (select o_orderkey, o_orderdate::date a, case when o_orderkey % 5 = 0 then null else o_orderdate::date + (o_orderkey % 90)::int end b from orders)
select o_orderkey, coalesce(abs(b - a) <= 30, false) strict, coalesce(abs(b - a) <= 30, true) lenient, last_day(a + interval 2 month) month_end, date_trunc('month', a)::date - 0 + 0 first_day, coalesce(b, a + 1) filled,
 (date_trunc('month', a) + interval 12 month)::date next_start, (date_trunc('month', a) + interval 24 month)::date - 1 next_end from o""")
def date_windows(spark, d):
    a, b = F.col("a"), F.col("b")
    o = table(spark, d, "orders").withColumn("a", F.col("o_orderdate").cast("date"))
    o = o.withColumn("b", F.when(F.col("o_orderkey") % 5 != 0, F.date_add("a", (F.col("o_orderkey") % 90).cast("int"))))
    start = F.trunc("a", "month")
    period = dates.renewal_period(start, F.date_sub(F.add_months(start, 12), 1))
    return o.select(
        "o_orderkey", dates.within_days(a, b, 30, null_passes=False).alias("strict"), dates.within_days(a, b, 30, null_passes=True).alias("lenient"), dates.month_end(a, 2).alias("month_end"), F.get(dates.month_starts(a, a), F.lit(0)).alias("first_day"),
        dates.default_end(a.cast("timestamp"), b.cast("timestamp"), 24).cast("date").alias("filled"), period["start"].alias("next_start"), period["end"].alias("next_end"),
    )


@query("""
select _id, u, lower(regexp_extract(u, '^[a-zA-Z]+://(?:www\\.)?([^/:]+)', 1)) host, case when contains(u, '/rows') then 'sheet' when regexp_matches(u, '/f/') then 'file' end class, substr(md5(u || chr(31) || _id), 1, 16) stable from (select _id, unnest(links) u from raw) where regexp_matches(u, '^https?://[^\\s,;|"<>]+$')""")
def link_parts(spark, d):
    r = _raw(spark, d).select("_id", F.explode("links").alias("u")).where(F.col("u").rlike(r"^https?://[^\s,;|\"<>]+$"))
    u = F.col("u")
    return r.select("_id", "u", text.url_host(u).alias("host"), text.url_class(u, [("/rows", "sheet"), ("/f/", "file")]).alias("class"), text.stable_name(u, F.col("_id").cast("string")).alias("stable"))


@query("""
select p_partkey, p_name || e'\\n' || p_brand || ' & <' || p_size || '%' as stripped, 'Plan ' || p_partkey || '_20240305.xlsx' versioned, 'plan ' || p_partkey base, case when p_size > 25 then 'Plan' || '…' else 'Plan' end as cut, 2 + (p_size % 3 = 0)::int n_chunks from part""")
def made_texts(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    html = F.concat(F.lit("<script>var a = '<b>';</script><p>"), "p_name", F.lit("</p><b>"), "p_brand", F.lit("</b>&nbsp;&amp; &lt;"), size, F.lit("&#37; "))
    plan = F.concat(F.lit("Plan "), F.col("p_partkey").cast("string"))
    many = F.repeat(F.lit("abcde"), F.when(F.col("p_size") % 3 == 0, 5).otherwise(4))
    return p.select(
        "p_partkey", text.strip_html(html).alias("stripped"), text.versioned_name(F.concat(plan, F.lit(".xlsx")), F.lit("2024-03-05").cast("date")).alias("versioned"), text.base_name(F.concat(plan, F.lit("_v2.1.xlsx"))).alias("base"),
        text.truncate_marked(F.when(F.col("p_size") > 25, F.lit("Planning")).otherwise(F.lit("Plan")), 4).alias("cut"), F.size(text.chunks(many, 10)).alias("n_chunks"),
    )


@query("""
select o_orderkey, (case when o_orderkey % 3 = 0 then -1 else 1 end * o_totalprice::decimal(18,2))::double n, case when o_orderkey % 7 = 0 then null else round_even(o_totalprice::decimal(18,2)::double / 7, 2) end quotient, o_orderkey % 3 <> 0 or o_orderkey % 3 = 0 amount_ok, o_orderkey % 2 = 0 date_ok,
 case when o_totalprice < 100000 then o_totalprice * 10 else o_totalprice end scaled from orders""")
def written_numbers(spark, d):
    """Amounts written with separators, signs and brackets come out as they went in."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    shown = F.format_number(price, 2)
    k = F.col("o_orderkey")
    written = F.when(k % 3 == 0, F.when(k % 2 == 0, F.concat(F.lit("△"), shown)).otherwise(F.concat(F.lit("("), shown, F.lit(")")))).otherwise(F.concat(F.lit("¥"), shown))
    day = F.when(k % 2 == 0, "2024年3月5日").otherwise("3 March")
    return table(spark, d, "orders").select(
        "o_orderkey", numbers.to_number(written).cast("double").alias("n"), numbers.safe_div(price.cast("double"), F.when(k % 7 == 0, 0.0).otherwise(7.0)).alias("quotient"), choices.valid_format(F.concat(F.lit("¥"), shown), "amount").alias("amount_ok"), choices.valid_format(day, "date").alias("date_ok"),
        numbers.unit_scaled(F.col("o_totalprice"), 100000, 10.0).alias("scaled"),
    )


@query("""
with p as (select p_partkey, p_size * 10 v from part) select p_partkey, v::double v, case when v > 100 then (v / 100.0)::double else v::double end reduced from p""")
def reduced_prices(spark, d):
    """A price of ten thousands taken for one, at a small limit."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10).cast("double").alias("v"))
    return p.select("p_partkey", "v", numbers.reduced_price(F.col("v"), 100).alias("reduced"))


@query("""
select _id, case when contains(a, '@') and not regexp_matches(a, '^(?:no-?reply|postmaster|mailer-daemon|notifications?|alerts?|[a-z-]*bot)@') then a end person, case when lower(trim(project, ' ')) not in ('', '-', '—', 'n/a', 'na', 'none', 'null', 'unknown', '不明', 'なし', '未定') then project end known
from (select _id, lower(trim(sender, ' ')) a, project from raw)""")
def known_values(spark, d):
    return _raw(spark, d).select("_id", text.valid_person(F.col("sender")).alias("person"), choices.known(F.col("project")).alias("known"))


@query("""
select p_partkey from part where (p_size > 40 or p_size < 5) and (p_brand like '%1%' or p_retailprice > 1500)""")
def predicate_tree(spark, d):
    size, brand, price = F.col("p_size"), F.col("p_brand"), F.col("p_retailprice")
    return table(spark, d, "part").where(predicates.tree([[size > 40, size < 5], [], [brand.contains("1"), price > 1500]])).select("p_partkey")


@query("select _id from raw where project is null and \"timestamp\" is not null order by \"timestamp\" limit 40")
def pending_rows(spark, d):
    """The forty oldest rows of unfinished work, as the queue hands them out."""
    r = _raw(spark, d).where("timestamp is not null").withColumn("mark", F.when(F.col("project").isNull(), "open"))
    return ingest.pending(r, "mark", "open", "timestamp", 40).select("_id")


@query("select project, epoch_us(min(\"timestamp\")) oldest_us from raw where project is not null group by 1")
def resume_points(spark, d):
    return ingest.resume_point(_raw(spark, d).where("project is not null"), "project", "timestamp").select("project", F.unix_micros("oldest").alias("oldest_us"))


@query("""
with t as (select event_id, user_id, event_type || repeat('!', (event_id % 3)::int) x, row_number() over (partition by user_id order by event_id) rn from events), n as (select *, lead(x) over (partition by user_id order by event_id) nx from t)
select event_id, rn::int line_no from n where nx is null or not starts_with(nx, x)""")
def rolling_captions(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.concat("event_type", F.repeat(F.lit("!"), (F.col("event_id") % 3).cast("int"))).alias("x"))
    return ordered.drop_rolling(ordered.numbered(e, by="user_id", order="event_id"), by="user_id", order="event_id", text="x").select("event_id", "line_no")


@query("""
with f as (select _id, links[1] p from raw where source in ('drive', 'file') and links[1] is not null) select _id, row_number() over (order by contains(p, 'archive'), p, _id) r from f""")
def file_order(spark, d):
    """Files by path, those of the archive last, numbered over ranges."""
    f = _raw(spark, d).where("source in ('drive', 'file')").select("_id", F.get("links", F.lit(0)).alias("p")).where("p is not null")
    k = f.withColumn("k", lookup.in_file_order(f, "p", "archive"))
    return ordered.global_rank(k, ["k", "_id"], "r").select("_id", "r")


@query("""
with l as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) rn from lineitem)
select l_orderkey, string_agg(l_partkey::varchar, ',' order by rn) refs from l where l_partkey in (select p_partkey from part where p_size < 20) group by 1""")
def known_references(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(w)).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "l_partkey"))), lambda x: x["l_partkey"]).alias("refs"))
    known = table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("ref"))
    k = lookup.known_references(li, known, id_col="l_orderkey", refs_col="refs", ref_key="ref")
    return k.select("l_orderkey", F.array_join("refs", ",").alias("refs"))


@query("""
with e as (select parents k, _id, subject, coalesce(links, []) l from raw where source = 'gmail' and parents <> '')
select k, arg_min(_id, _id) _id, count(*) n_folded, array_to_string(flatten(list(l order by _id)), '|') links from e group by 1""")
def folded_threads(spark, d):
    """A row for each mail thread: the first mail, the links of all; a thread bounds what a row holds."""
    r = _raw(spark, d).where("source = 'gmail' and parents <> ''").select(F.col("parents").alias("k"), "_id", F.coalesce("links", F.array().cast("array<string>")).alias("links"))
    f = aggregate.fold_across(r, ["k"], order=F.col("_id"), arrays=["links"], scalars=["_id"])
    return f.select("k", "_id", "n_folded", F.array_join("links", "|").alias("links"))


@query("""
select _id, substr(content, 1, 100) as text, length(content) > 100 truncated from raw where source = 'drive' and content is not null""")
def note_texts(spark, d):
    n = readers.note_text(F.col("content"), 100)
    return _raw(spark, d).where("source = 'drive' and content is not null").select("_id", n.alias("n")).select("_id", "n.*")


@query("""
select email as id, coalesce(nullif(trim(name, ' '), ''), nullif(trim(company, ' '), '')) as name from people where email is not null and not coalesce(company = 'oakmere.example', false) and not contains(email, 'fuel')""")
def named_users(spark, d):
    p = table(spark, d, "people").where("email is not null").select(F.col("email").alias("id"), F.col("name").alias("n"), "company", (F.col("company") == "oakmere.example").alias("gone"), F.col("email").contains("fuel").alias("bot"))
    return readers.users_named(p, id_col="id", names=["n", "company"], deleted="gone", bot="bot")


@query("select lower(spelling) as key, arg_max(payee_code, evidence * 1000000 + length(spelling)) payee_code from (select *, row_number() over (partition by lower(spelling), evidence * 1000000 + length(spelling)) k, count(distinct payee_code) over (partition by lower(spelling)) m from payee_alias) where spelling is not null and m = 1 group by 1")
def last_listed(spark, d):
    """The payee of each spelling that has one only, as a listing gives it."""
    a = table(spark, d, "payee_alias").where("spelling is not null").withColumn("o", F.col("evidence") * 1000000 + F.length("spelling"))
    one = a.groupBy(F.lower("spelling").alias("l")).agg(F.count_distinct("payee_code").alias("m")).where("m = 1").select("l")
    return readers.last_listed(a.join(one, F.lower("spelling") == F.col("l"), "left_semi"), F.lower("spelling"), "payee_code", "o")


@query("select _id, case when regexp_matches(coalesce(name, ''), '[^\\x{0}-\\x{FF}]') and regexp_matches(coalesce(subject, ''), '[^\\x{0}-\\x{FF}]') then 'name,subject' when regexp_matches(coalesce(name, ''), '[^\\x{0}-\\x{FF}]') then 'name' else 'subject' end bad from raw where regexp_matches(coalesce(name, ''), '[^\\x{0}-\\x{FF}]') or regexp_matches(coalesce(subject, ''), '[^\\x{0}-\\x{FF}]')")
def not_encodable(spark, d):
    return writers.encodable(_raw(spark, d).select("_id", "name", "subject"), ["name", "subject"], "latin-1").select("_id", F.array_join("bad", ",").alias("bad"))


@query("select n_nationkey unit, i::int as n from nation, range(0, 12) t(i) where i < least(n_nationkey + 3, 7) and i >= 0")
def paged_rows(spark, d):
    """A paging service with as many rows as a unit's number and three, the newest first, read to seven rows."""
    units = table(spark, d, "nation").select("n_nationkey")
    rows = paged.read_paged(units, _service, "unit int, n int, age int", size=2, time="age", most=7)
    return rows.select("unit", "n")


def _service(unit: dict, token: str | None, size: int) -> tuple[list[dict], str | None]:
    at, total = int(token or 0), unit["n_nationkey"] + 3
    rows = [{"unit": unit["n_nationkey"], "n": i, "age": total - i} for i in range(at, min(total, at + size))]
    return rows, str(at + size) if at + size < total else None


@query("select k, n from (select p_partkey k, p_name n from part union all select s_suppkey, s_name from supplier)")
def united_tables(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"), F.lit(1).alias("beside"))
    return readers.union_all([p, s]).select("k", "n")
