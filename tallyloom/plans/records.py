"""Queries of the core operators on the unified records, the journal, events and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import choices, dates, numbers, text
from tallyloom.operators import aggregate, lookup, matching, ordered, panel, predicates, resolve, search, upsert
from tallyloom.plans.registry import Registry
from tallyloom.session import table
from tallyloom.sources import readers, writers

R = Registry()
query = R.query


def _raw(spark, d):
    return table(spark, d, "raw")


@query("""
with e as (select user_id, strftime(ts, '%Y-%m-%d') ym, case when event_type in ('view', 'click') then 'look' else 'act' end cls, value::decimal(18,3) v from events where value is not null),
m as (select cls, ym, sum(v) total from e group by 1, 2), p as (select *, lag(total) over (partition by cls order by ym) b from m)
select cls, ym, total::double total, round(case when b = 0 then null else (total - b)::double / abs(b)::double end, 6) change, case when b is null then 'missing' when b = 0 then 'zero_base' when abs((total - b)::double / b::double) >= 0.2 then 'big' when abs((total - b)::double / b::double) >= 0.1 then 'some' else 'none' end flag
from p order by total desc, cls, ym limit 50""")
def event_rollup_compare(spark, d):
    """The flagship: filter, class sums, change against the day before, order and top."""
    e = table(spark, d, "events").where(F.col("value").isNotNull())
    e = e.select(F.date_format("ts", "yyyy-MM-dd").alias("ym"), F.when(F.col("event_type").isin("view", "click"), "look").otherwise("act").alias("cls"), F.col("value").cast("decimal(18,3)").alias("v"))
    m = e.groupBy("cls", "ym").agg(F.sum("v").cast("double").alias("total"))
    c = panel.changes(m, by=["cls"], order="ym", value="total")
    return c.select("cls", "ym", "total", F.round("change", 6).alias("change"), "flag").orderBy(F.desc("total"), "cls", "ym").limit(50)


@query("""
select _id, (select count(*) > 25 from raw where source = 'gmail' and "timestamp" >= timestamptz '2024-03-01 00:00:00+00' and "timestamp" <= timestamptz '2025-06-30 00:00:00+00') truncated from raw
where source = 'gmail' and "timestamp" >= timestamptz '2024-03-01 00:00:00+00' and "timestamp" <= timestamptz '2025-06-30 00:00:00+00' order by "timestamp" desc nulls last, _id limit 25""")
def newest_in_range(spark, d):
    r = _raw(spark, d).where(predicates.source_filter("gmail", first="2024-03-01 00:00:00+00:00", last="2025-06-30 00:00:00+00:00"))
    return search.with_truncation(r, 25).select("_id", "truncated")


@query("""
with seeds as (select distinct parents from raw where source = 'gmail' and contains(lower(subject), 'invoice') and parents <> ''), g as (select * from raw where source = 'gmail'),
big as (select parents from g where parents in (select parents from seeds) group by 1 having count(distinct _id) >= 2)
select _id, parents from g where parents in (select parents from big)""")
def thread_expand(spark, d):
    g = _raw(spark, d).where("source = 'gmail'")
    return search.expand_threads(g.where(F.lower("subject").contains("invoice")), g, key="parents").select("_id", "parents")


@query("""
with s as (select _id, "timestamp" t, case when regexp_matches(parents, '^[0-9]+\\.[0-9]+$') then make_timestamptz((parents::decimal(20,6) * 1000000)::bigint) else try_cast(replace(parents, 'Z', '+00:00') as timestamptz) end pt, parents from raw where source = 'slack')
select p._id parent_id, c._id child_id from s p join s c on floor(epoch(p.t)) = floor(epoch(c.pt)) where coalesce(p.parents, '') = ''""")
def chat_children(spark, d):
    s = _raw(spark, d).where("source = 'slack'").select("_id", F.col("timestamp").alias("t"), "parents", dates.any_timestamp(F.col("parents"), "+00:00").alias("pt"))
    r = search.children_by_time(s.where("coalesce(parents, '') = ''"), s, parent_time="t", child_parent="pt")
    return r.select(F.col("p._id").alias("parent_id"), F.col("c._id").alias("child_id"))


@query("""
select key, n_queries, body_len from (
 select 'https://' || lower(regexp_extract(u, '^[a-zA-Z]+://(?:www\\.)?([^/]+)', 1)) || regexp_replace(regexp_replace(regexp_replace(u, '[?#].*$', ''), '/+$', ''), '^[a-zA-Z]+://[^/]+', '') as key, count(distinct source) n_queries, max(length(coalesce(content, ''))) body_len
 from (select source, content, unnest(links) u from raw) where u like 'http%' and not regexp_matches(u, '[\\s,;|"<>]') group by 1) order by n_queries desc, body_len desc, key limit 30""")
def url_canonical_pool(spark, d):
    r = _raw(spark, d).select("source", F.coalesce("content", F.lit("")).alias("content"), F.explode("links").alias("u")).where(F.col("u").startswith("http") & ~F.col("u").rlike(r"[\s,;|\"<>]"))
    return search.canonical_pool(r, key=text.canonical_url(F.col("u")), query_col="source", body_col="content", top=30).select("key", "n_queries", "body_len")


@query("""
with r as (select project, strftime("timestamp", '%Y-%m') as month, (row_number() over (partition by project, strftime("timestamp", '%Y-%m') order by "timestamp", _id) - 1) // 40 chunk, coalesce(subject, '') s from raw where source = 'drive' and "timestamp" is not null)
select project, month, chunk, count(*) n, sum(length(s)) + count(*) - 1 chars from r group by 1, 2, 3""")
def month_chunks(spark, d):
    r = _raw(spark, d).where("source = 'drive' and timestamp is not null")
    c = search.month_chunks(r, time_col="timestamp", by=["project"], text_col="subject", id_col="_id")
    return c.select("project", "month", "chunk", "n", F.length("text").cast("bigint").alias("chars"))


@query("""
with d as (select _id, regexp_extract_all(lower(concat_ws(';', to_addr, cc_bcc)), '[a-z0-9._%+\\-]+@([a-z0-9\\-]+(?:\\.[a-z0-9\\-]+)+)', 1) ds from raw where source = 'gmail'),
e as (select _id, unnest(ds) domain, generate_subscripts(ds, 1) rk from d), r as (select _id, domain, min(rk) + case when domain = 'quayside.example' then 1000000 else 0 end rk from e group by 1, 2),
m as (select lower(domain) domain, min(project) project from domain_map where project is not null and domain is not null group by 1), j as (select _id, rk, project, domain, row_number() over (partition by _id order by rk, project, domain) n from r join m using (domain))
select _id, project, domain from j where n = 1""")
def mail_project(spark, d):
    r = _raw(spark, d).where("source = 'gmail'")
    return resolve.mail_project(r, table(spark, d, "domain_map"), id_col="_id", headers=["to_addr", "cc_bcc"], own_domains=["quayside.example"])


@query("""
select _id, len(ds) > 0 and len(list_filter(ds, lambda x: x <> 'gaugeworks.test')) = 0 inside, len(list_distinct(ds)) n_domains, coalesce(ds[1], '-') first_domain from (
 select _id, regexp_extract_all(lower(coalesce(sender, '')), '[a-z0-9._%+\\-]+@([a-z0-9\\-]+(?:\\.[a-z0-9\\-]+)+)', 1) ds from raw where source = 'meeting')""")
def email_domain(spark, d):
    r = _raw(spark, d).where("source = 'meeting'")
    ds = text.domains_in_order(F.col("sender"))
    return r.select("_id", resolve.all_internal(["sender"], "gaugeworks.test").alias("inside"), F.size(ds).cast("bigint").alias("n_domains"), F.coalesce(F.get(ds, F.lit(0)), F.lit("-")).alias("first_domain"))


@query("""
with k as (select distinct payee_code, count(*) over (partition by payee_code) n_lines from journal)
select ym, n_lines, count(*) n_vouchers from (select ym, voucher_key, count(*) n_lines from journal group by 1, 2) group by 1, 2""")
def journal_line_histogram(spark, d):
    return aggregate.counts_of_counts(table(spark, d, "journal"), "ym", "voucher_key").select("ym", "n_lines", F.col("n_keys").alias("n_vouchers"))


@query("""
with a as (select payee_code c, spelling a, max(evidence) e from payee_alias group by 1, 2), keys as (select distinct spelling k from payee_alias where length(spelling) % 2 = 0 union select distinct substr(spelling, 1, 8) from payee_alias where length(spelling) > 9 union select distinct spelling || ' x' from payee_alias),
ex as (select k, c from (select k, c, row_number() over (partition by k order by e desc, c desc) rn from keys join a on k = a.a) where rn = 1),
near as (select k, a.a, c from (select k from keys where k not in (select k from ex)) k join a on length(a.a) >= 3 and (contains(k, a.a) or (length(k) >= 3 and contains(a.a, k)))),
t as (select k, min(c) lo, max(c) hi from (select *, max(length(a)) over (partition by k) mx from near) where length(a) = mx group by 1)
select keys.k spelling, coalesce(ex.c, case when lo = hi then lo end) payee_code, case when ex.c is not null then 'exact' when lo = hi then 'contains' else 'none' end how from keys left join ex on keys.k = ex.k left join t on keys.k = t.k""")
def alias_resolve(spark, d):
    al = table(spark, d, "payee_alias")
    s = F.col("spelling")
    keys = al.where(F.length(s) % 2 == 0).select(s).unionByName(al.where(F.length(s) > 9).select(F.substring(s, 1, 8).alias("spelling"))).unionByName(al.select(F.concat(s, F.lit(" x")).alias("spelling")))
    return matching.resolve_alias(keys, al, key="spelling", alias="spelling", code="payee_code", evidence="evidence")


@query("""
with j as (select distinct payee_code, ym, department, account, sub, segment, memo from journal), r as (select *, row_number() over (partition by payee_code order by ym desc nulls last, department nulls first, account nulls first, sub nulls first, segment nulls first, memo nulls first) rn from j)
select payee_code, ym, account, rn::int rn from r where rn <= 30""")
def payee_context(spark, d):
    j = table(spark, d, "journal").select("payee_code", "ym", "department", "account", "sub", "segment", "memo").distinct()
    w = Window.partitionBy("payee_code").orderBy(F.desc_nulls_last("ym"), *(F.asc_nulls_first(c) for c in ("department", "account", "sub", "segment", "memo")))
    return j.withColumn("rn", F.row_number().over(w)).where("rn <= 30").select("payee_code", "ym", "account", "rn")


@query("""
with v as (select payee_code, voucher_key, max(ym) ym from journal where payee_code is not null group by 1, 2), r as (select *, row_number() over (partition by payee_code order by ym desc nulls last, voucher_key) rn from v) select payee_code, voucher_key from r where rn <= 5""")
def recent_vouchers(spark, d):
    v = table(spark, d, "journal").where("payee_code is not null").groupBy("payee_code", "voucher_key").agg(F.max("ym").alias("ym"))
    return ordered.keep(v, ["payee_code"], [F.desc_nulls_last("ym"), F.asc("voucher_key")], most=5).select("payee_code", "voucher_key")


@query("""
with m as (select payee_code, ym, sum(amount) s from journal where payee_code is not null and ym is not null group by 1, 2)
select payee_code, ym, s::double total, coalesce(sum(s) over (partition by payee_code order by ym rows between unbounded preceding and 1 preceding), 0)::double before from m""")
def history_before_month(spark, d):
    """Sum of a payee strictly before each month: a running sum over months."""
    m = table(spark, d, "journal").where("payee_code is not null and ym is not null").groupBy("payee_code", "ym").agg(F.sum("amount").alias("s"))
    w = Window.partitionBy("payee_code").orderBy("ym").rowsBetween(Window.unboundedPreceding, -1)
    return m.select("payee_code", "ym", F.col("s").cast("double").alias("total"), F.coalesce(F.sum("s").over(w), F.lit(0)).cast("double").alias("before"))


@query("""
select payee_code, regexp_replace(regexp_replace(lower(memo), '[\\s　]+', '', 'g'), '[0-9]+', '#', 'g') item, department, account, coalesce(sub, '0000') sub, segment, count(*) n, max(ym) last_ym from journal where memo is not null and department is not null and account is not null and segment is not null group by 1, 2, 3, 4, 5, 6""")
def item_dictionary(spark, d):
    j = table(spark, d, "journal").where("memo is not null and department is not null and account is not null and segment is not null")
    return j.groupBy("payee_code", text.item_key(F.col("memo")).alias("item"), "department", "account", F.coalesce("sub", F.lit("0000")).alias("sub"), "segment").agg(F.count("*").alias("n"), F.max("ym").alias("last_ym"))


@query("""
with a as (select payee_code, count(distinct account) n, min(account) lo, max(account) hi from journal where payee_code is not null group by 1) select payee_code, case when lo = hi then lo end account, n n_values from a""")
def agreed_account(spark, d):
    return lookup.agreed_value(table(spark, d, "journal").where("payee_code is not null"), ["payee_code"], "account")


@query("""
with c as (select distinct voucher_key, split_part(voucher_no, '-', 1) s1, split_part(voucher_no, '-', 2) s2 from journal where voucher_no is not null)
select voucher_key, case when s1 in (select account from journal) then 'A' || s1 end account, case when s2 in (select department from journal) then 'D' || s2 end department from c""")
def code_lookup(spark, d):
    j = table(spark, d, "journal")
    rules = j.select(F.lit("account").alias("stage"), F.col("account").alias("input"), F.concat(F.lit("A"), "account").alias("output")).unionByName(j.select(F.lit("department").alias("stage"), F.col("department").alias("input"), F.concat(F.lit("D"), "department").alias("output"))).distinct()
    v = j.where("voucher_no is not null").select("voucher_key", "voucher_no").distinct().select("voucher_key", F.split_part("voucher_no", F.lit("-"), F.lit(1)).alias("s1"), F.split_part("voucher_no", F.lit("-"), F.lit(2)).alias("s2")).distinct()
    v = v.withColumn("code", F.concat_ws("-", "s1", "s2"))
    return lookup.code_lookup(v, rules, code_col="code", stages=["account", "department"]).select("voucher_key", "account", "department")


@query("""
with b as (select payee_code k, list_sort(list_distinct(list(trim(spelling)))) s, first(spelling order by evidence desc, spelling) f from payee_alias where payee_code is not null group by 1) select k payee_code, array_to_string(s, '|') spellings, f first_spelling from b""")
def alias_set_merge(spark, d):
    al = table(spark, d, "payee_alias").where("payee_code is not null").withColumn("first_spelling", F.col("spelling")).withColumn("o", F.struct(-F.col("evidence"), F.col("spelling")))
    m = aggregate.set_merge(al, "payee_code", values="spelling", first="first_spelling", order="o")
    return m.select("payee_code", F.array_join("spelling", "|").alias("spellings"), "first_spelling")


@query("""
with t as (select event_id, user_id, event_type, ts, value from events), d as (select user_id, ts::date dd, sum(value::decimal(18,3)) v from t group by 1, 2), days as (select distinct user_id % 3 tb, dd from (select user_id, ts::date dd from t)),
g as (select user_id % 3 tb, dd, bool_or(v is not null) a from d group by 1, 2), p as (select tb, dd, last_value(case when a then dd end ignore nulls) over (partition by tb order by dd rows between unbounded preceding and 1 preceding) pd from g)
select d.user_id, strftime(d.dd, '%Y-%m-%d') as day, strftime(p.pd, '%Y-%m-%d') prev, (d.v - o.v)::double diff from d join p on d.user_id % 3 = p.tb and d.dd = p.dd left join d o on o.user_id = d.user_id and o.dd = p.pd""")
def prev_nonnull_compare(spark, d):
    """Every user's days."""
    return _against_last_filled(table(spark, d, "events"))


def _against_last_filled(events):
    e = events.groupBy("user_id", F.col("ts").cast("date").alias("dd")).agg(F.sum(F.col("value").cast("decimal(18,3)")).alias("v")).withColumn("tb", F.col("user_id") % 3)
    r = panel.against_last_filled(e, table="tb", period="dd", row="user_id", value="v")
    return r.select("user_id", F.col("dd").cast("string").alias("day"), F.col("prev").cast("string").alias("prev"), F.col("diff").cast("double").alias("diff"))


@query("""
select event_id, try_cast(props::json->>'k' as int) k, length(props) n from events where props is not null""")
def json_props(spark, d):
    e = table(spark, d, "events").where("props is not null")
    return e.select("event_id", F.get_json_object(choices.unwrap_json(F.col("props")), "$.k").try_cast("int").alias("k"), F.length("props").cast("bigint").alias("n"))


@query("""
with e as (select * from events where event_id % 2 = 0 or user_id % 3 = 0), done as (select distinct user_id, strftime(ts, '%Y-%m-%d') m from events where event_id % 5 = 0) select event_id from e where (user_id, strftime(ts, '%Y-%m-%d')) not in (select (user_id, m) from done)""")
def incremental_anti(spark, d):
    e = table(spark, d, "events").withColumn("m", F.date_format("ts", "yyyy-MM-dd"))
    return upsert.not_yet(e.where("event_id % 2 = 0 or user_id % 3 = 0"), e.where("event_id % 5 = 0"), ["user_id", "m"]).select("event_id")


@query("""
select user_id, min(ts) filter (where event_type = 'view') is not null started, epoch_us(min(ts) filter (where event_type = 'view'))::bigint start_us, epoch_us(max(ts) filter (where event_type = 'purchase'))::bigint end_us from events group by 1""")
def task_bars(spark, d):
    b = aggregate.bars(table(spark, d, "events"), "user_id", "ts", "event_type", "view", "purchase")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return b.select("user_id", F.col("started").isNotNull().alias("started"), us("started").alias("start_us"), us("ended").alias("end_us"))


@query("""
with l as (select *, lead(event_type) over (partition by user_id order by ts, event_id) nx from events) select event_id from l where nx is null or not starts_with(nx, event_type)""")
def caption_dedup(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return ordered.drop_rolling(e, by="user_id", order="o", text="event_type").select("event_id")


@query("""
select doc_id from (select doc_id, row_number() over (partition by source, regexp_replace(lower(text), '[ \\n\\t\\r]+', ' ', 'g') order by doc_id) rn from documents where text is not null) where rn = 1""")
def copy_fold(spark, d):
    """First document of each (source, text key): the key is hashed before it moves."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.xxhash64(F.regexp_replace(F.lower("text"), r"[ \n\t\r]+", " ")).alias("h"), F.md5(F.regexp_replace(F.lower("text"), r"[ \n\t\r]+", " ")).alias("k"))
    return t.groupBy("source", "h", "k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""
with n as (select _id, source, subject, "timestamp" t, trim(regexp_replace(regexp_replace(lower(subject), '\\.[a-z0-9]{1,5}$', ''), '[\\s_-]*(?:v\\d+(?:\\.\\d+)*|\\(\\d+\\)|copy|final|\\d{8}|\\d{4})$', '')) base from raw where source in ('drive', 'file') and subject is not null),
r as (select *, row_number() over (partition by base order by t desc nulls last, _id) rn, case when subject like '%.pdf' then 1 when subject like '%.xlsx' then 2 else 3 end kind from n)
select _id, base, kind from r where rn = 1""")
def version_dedup(spark, d):
    r = _raw(spark, d).where("source in ('drive', 'file') and subject is not null").withColumn("base", text.base_name(F.col("subject")))
    kind = F.when(F.col("subject").endswith(".pdf"), 1).when(F.col("subject").endswith(".xlsx"), 2).otherwise(3)
    return ordered.keep(r, ["base"], [F.desc_nulls_last("timestamp"), F.asc("_id")]).select("_id", "base", kind.alias("kind"))


@query("""
select _id, regexp_extract(subject, '(20\\d\\d)\\D{0,3}(0?[1-9]|1[0-2])(?!\\d)', 1) y from raw where false union all
select _id, case when regexp_matches(coalesce(content, ''), '(^|[^0-9])(20[0-9][0-9](0[1-9]|1[0-2]))([0-9][0-9])?([^0-9]|$)') then 'yes' else 'no' end y from raw where source = 'file'""")
def packed_month_flag(spark, d):
    r = _raw(spark, d).where("source = 'file'")
    return r.select("_id", F.when(F.coalesce("content", F.lit("")).rlike(r"(^|[^0-9])(20[0-9][0-9](0[1-9]|1[0-2]))([0-9][0-9])?([^0-9]|$)"), "yes").otherwise("no").alias("y"))


@query("""
select _id, case when contains(lower(coalesce(content, '')), 'invoice') then 'billing' when contains(lower(coalesce(content, '')), 'contract') then 'legal' when contains(lower(coalesce(content, '')), 'vehicle') then 'fleet' end rule,
 array_to_string(list_filter(['invoice', 'contract', 'vehicle', 'worksheet'], lambda x: contains(lower(coalesce(content, '')), x)), ',') tokens, left(coalesce(content, ''), 80) || case when length(coalesce(content, '')) > 80 then '…' else '' end head, ceil(length(coalesce(content, '')) / 500.0)::int n_chunks from raw where source = 'drive'""")
def text_rules(spark, d):
    c = F.coalesce("content", F.lit(""))
    low = F.lower(c)
    return _raw(spark, d).where("source = 'drive'").select(
        "_id", choices.first_rule(low, [("invoice", "billing"), ("contract", "legal"), ("vehicle", "fleet")]).alias("rule"), choices.canon_choice(low, ["invoice", "contract", "vehicle", "worksheet"]).alias("tokens"), text.truncate_marked(c, 80).alias("head"), F.size(text.chunks(c, 500)).alias("n_chunks")
    )


@query("""
with b as (select voucher_key, memo, try_cast(regexp_replace(memo, '[^0-9]', '', 'g') as bigint) n, amount from journal where memo is not null)
select voucher_key, memo, amount::bigint amount, case when amount is null then '-' when amount > 0 then '+' || format('{:,}', amount::bigint) else format('{:,}', amount::bigint) end signed,
 (case when amount is null then null else amount * 2 end)::bigint doubled from b""")
def number_formats(spark, d):
    j = table(spark, d, "journal").where("memo is not null")
    nul = F.lit(None).cast("decimal(18,0)")
    return j.select("voucher_key", "memo", F.col("amount").cast("bigint").alias("amount"), numbers.signed_text(F.col("amount")).alias("signed"), numbers.apply_change(F.col("amount"), absolute=nul, plus=nul, percent=nul, rate=F.lit(2).cast("decimal(3,0)")).alias("doubled"))


@query("""
with u as (select project p, lower(domain) dm from domain_map where project is not null and domain is not null group by 1, 2), n as (select distinct project from raw where project is not null)
select n.project, count(dm) n_domains, count(dm) = 0 missing from n left join u on u.p = n.project group by 1""")
def target_projects(spark, d):
    m = table(spark, d, "domain_map").where("project is not null and domain is not null").select("project", F.lower("domain").alias("dm")).distinct()
    n = _raw(spark, d).where("project is not null").select("project").distinct()
    return n.join(m, "project", "left").groupBy("project").agg(F.count("dm").alias("n_domains")).withColumn("missing", F.col("n_domains") == 0)


@query("""
select source, count(*) n, count(*) filter (where content is null) no_content, count(*) filter (where "timestamp" is null) no_time, count(distinct project) n_projects from raw group by 1""")
def source_report(spark, d):
    r = _raw(spark, d)
    a = aggregate.rates(r, {"no_content": F.col("content").isNull(), "no_time": F.col("timestamp").isNull()}, ["source"])
    p = r.groupBy("source").agg(F.count_distinct("project").alias("n_projects"))
    return a.join(p, "source").select("source", "n", "no_content", "no_time", "n_projects")


@query("""
with l as (select _id, unnest(string_split(content, e'\\n')) line, generate_subscripts(string_split(content, e'\\n'), 1) - 1 line_no from raw where source = 'meeting' and content is not null)
select _id, count(*) filter (where not regexp_matches(line, '^\\s*$|^WEBVTT|^\\d+$|-->')) n_lines from l group by 1 having count(*) filter (where not regexp_matches(line, '^\\s*$|^WEBVTT|^\\d+$|-->')) > 0""")
def transcript_lines(spark, d):
    r = _raw(spark, d).where("source = 'meeting' and content is not null")
    return readers.transcript_lines(r, "_id", "content").groupBy("_id").agg(F.count("*").alias("n_lines"))


@query("""
select voucher_key, coalesce(payee_code, '') c1, coalesce(account, '0000') c2, coalesce(sub, '0000') c3, coalesce(amount::bigint::varchar, '0') c4, 'X' c5 from journal""")
def fixed_export(spark, d):
    j = table(spark, d, "journal").withColumn("amount", F.col("amount").cast("bigint"))
    e = writers.fixed_columns(j, [("voucher_key", "voucher_key", ""), ("c1", "payee_code", ""), ("c2", "account", "0000"), ("c3", "sub", "0000"), ("c4", "amount", "0"), ("c5", None, "X")])
    return e


@query("""
select voucher_key, memo is not null and not regexp_matches(memo, '[0-9]') bad, try_cast(memo as bigint) n from journal where false union all select voucher_key, try_cast(voucher_no as bigint) is null, null from journal where voucher_no is not null and try_cast(voucher_no as bigint) is null""")
def reject_untyped(spark, d):
    j = table(spark, d, "journal").where("voucher_no is not null").select("voucher_key", "voucher_no")
    _, bad = upsert.typed(j, {"voucher_key": "string", "voucher_no": "bigint"})
    return bad.select("voucher_key", F.lit(True).alias("bad"), F.lit(None).cast("bigint").alias("n"))


@query("""
with o as (select email, name, aliases from people where name is not null), n as (select email, name || ' new' nm, [upper(name)] al from people where length(name) % 2 = 0 union all select 'x' || email, name, ['a', 'b'] from people where length(name) % 3 = 0)
select coalesce(o.email, n.email) email, coalesce(o.name, nm) name, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.aliases, []), coalesce(al, [])))), '|') aliases from o full join n on o.email = n.email""")
def people_merge(spark, d):
    o = table(spark, d, "people").select("email", "name", "aliases")
    n = o.where("length(name) % 2 = 0").select("email", F.concat("name", F.lit(" new")).alias("name"), F.array(F.upper("name")).alias("aliases"))
    n = n.unionByName(o.where("length(name) % 3 = 0").select(F.concat(F.lit("x"), "email").alias("email"), "name", F.array(F.lit("a"), F.lit("b")).alias("aliases")))
    return upsert.merge_sets(o, n, "email", first="name", sets=["aliases"]).withColumn("aliases", F.array_join("aliases", "|"))


@query("""
with old as (select voucher_key, account, amount from journal where ym < 202407), nw as (select voucher_key, account, amount + 1 amount from journal where length(voucher_key) % 2 = 0 and ym >= 202401)
select voucher_key, account, amount::bigint amount from old where voucher_key not in (select voucher_key from nw) union all select voucher_key, account, amount::bigint from nw""")
def replace_by_key(spark, d):
    j = table(spark, d, "journal").select("voucher_key", "account", F.col("amount").cast("bigint").alias("amount"), "ym")
    new = j.where("length(voucher_key) % 2 = 0 and ym >= 202401").select("voucher_key", "account", (F.col("amount") + 1).alias("amount"))
    return upsert.replace_by_key(j.where("ym < 202407").drop("ym"), new, ["voucher_key"])


@query("""
with f as (select _id, parents, unnest(string_split(parents, ' / ')) p, generate_subscripts(string_split(parents, ' / '), 1) lv from raw where source = 'drive' and parents is not null) select p folder, lv::int as level, count(*) n from f group by 1, 2""")
def folder_levels(spark, d):
    r = _raw(spark, d).where("source = 'drive' and parents is not null").select("_id", F.posexplode(F.split("parents", " / ")).alias("lv", "folder"))
    return r.groupBy("folder", (F.col("lv") + 1).cast("int").alias("level")).agg(F.count("*").alias("n"))


@query("""
with p as (select payee_code, account, count(*) n from journal where payee_code is not null and account is not null group by 1, 2), r as (select *, row_number() over (partition by payee_code order by n desc, account) rn from p)
select payee_code, account, n, rn::int as rank from r""")
def account_history(spark, d):
    return aggregate.pair_counts(table(spark, d, "journal").withColumn("one", F.lit(1)), "payee_code", "account", "one").select("payee_code", "account", "n", "rank")


@query("""
select vec_id, label, round(list_dot_product(embedding::float[], (select embedding::float[] from embeddings order by vec_id limit 1))::double, 3) score from embeddings order by score desc, vec_id limit 20""")
def vector_top(spark, d):
    e = table(spark, d, "embeddings")
    q = F.array(*(F.lit(float(x)) for x in e.orderBy("vec_id").first()["embedding"]))
    dot = F.aggregate(F.zip_with("embedding", q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return e.select("vec_id", "label", F.round(dot, 3).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)
