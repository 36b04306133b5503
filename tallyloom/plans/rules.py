"""Queries of the matching rules, fall-backs and reports on the records, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import choices, text
from tallyloom.operators import aggregate, evaluate, judge, lookup, matching, predicates, resolve, score, search
from tallyloom.plans.registry import Registry
from tallyloom.session import table
from tallyloom.sources import readers
from tallyloom.streaming import ingest

R = Registry()
query = R.query

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("＇", "") + "　 "
_NARROW = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)).replace("'", "") + "  "


def key_sql(x: str) -> str:
    """SQL of :func:`tallyloom.functions.text.match_key`, for the signs that occur in the tables."""
    return f"replace(replace(lower(nfc_normalize(translate({x}, '{_WIDE}', '{_NARROW}'))), 'ß', 'ss'), '…', '...')"


def _raw(spark, d):
    return table(spark, d, "raw")


@query(f"""
with h as (select *, row_number() over (partition by source order by "timestamp" desc nulls last, _id) rn from raw where project in ('pjt_tax_north', 'tax_north') and (contains({key_sql("concat_ws(e' \\n', subject, content)")}, 'invoice') or contains({key_sql("concat_ws(e' \\n', subject, content)")}, 'voucher')))
select _id, source from h where rn <= case source when 'slack' then 5 when 'gmail' then 3 else 2 end""")
def search_keyword_topn(spark, d):
    r = _raw(spark, d).where(predicates.source_filter(projects=["tax_north"])).where(predicates.keyword_match(["subject", "content"], ["Ｉｎｖｏｉｃｅ", "voucher", " "]))
    return search.newest_per(r, "source", {"slack": 5, "gmail": 3, "meeting": 2, "drive": 2, "file": 2}).select("_id", "source")


@query(f"""
select _id from raw where contains({key_sql("concat_ws(e' \\n', sender, to_addr, cc_bcc)")}, 'gnovak@brightwell.example') or contains({key_sql("name")}, 'gwen novak') or contains({key_sql("name")}, 'novak g.') or contains({key_sql("name")}, '田辺 沙織')""")
def person_filter(spark, d):
    m = predicates.person_match(["sender", "to_addr", "cc_bcc"], ["name"], "GNovak@brightwell.example ", ["Gwen Novak", "Ｎｏｖａｋ G.", "g", "田辺　沙織"])
    return _raw(spark, d).where(m).select("_id")


@query(f"""
with v as (select distinct name q, trim({key_sql("name")}, ' ') v from raw where name is not null),
p as (select distinct lower(trim(email)) email, {key_sql("concat_ws(e' \\n', name, array_to_string(coalesce(aliases, []), e'\\n'), email)")} t from people where trim(email) <> ''),
h as (select distinct q, email from v join p on v.v <> '' and contains(t, v.v)),
a as (select q, case when count(*) = 1 then min(email) end email, case when count(*) = 1 then 'one' else 'ambiguous' end status, 'people' how from h group by 1),
r as (select distinct source, lower(trim(sender)) email, {key_sql("name")} t from raw where source in ('slack', 'drive', 'file') and contains(sender, '@') and not contains(sender, ',') and name is not null),
m as (select q, source, v, count(distinct r.email) n, min(r.email) email from (select * from v where v <> '' and q not in (select q from h)) o join r on contains(t, v) group by 1, 2, 3),
f as (select q, arg_min(email, case source when 'slack' then 1 when 'drive' then 2 else 3 end) email from m where n = 1 group by 1),
u as (select * from a union all select q, email, 'one', 'raw' from f)
select v.q as name, email, coalesce(status, 'none') status, how from (select distinct q from v) v left join u on v.q = u.q""")
def resolve_people(spark, d):
    return resolve.resolve_people(_raw(spark, d), table(spark, d, "people"), query="name", raw=_raw(spark, d))


_CLEAN_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '[(（\\[][^)）\\]]*[)）\\]]', '', 'g'), '^ +| +$', '', 'g'), '(?:様|さん|氏|殿|御中)$|^(?i:mr|mrs|ms|mx|dr)\\.?\\s+', '', 'g'), '^ +| +$', '', 'g')"
)


@query(f"""
with q as (select name q, {_CLEAN_SQL} c from (select distinct name from raw where source in ('slack', 'drive', 'file') and name is not null)), qq as (select * from q where c <> ''),
p as (select distinct email, concat_ws(e'\\n', name, array_to_string(coalesce(aliases, []), e'\\n')) t from people), pp as (select * from p where t <> ''),
f as (select q, count(*) n, min(email) email from qq join pp on contains(t, c) group by 1),
e as (select q, unnest(k) c, len(k) need from (select q, list_distinct(list_filter(regexp_split_to_array(regexp_replace(c, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[\\s　]+'), lambda x: x <> '')) k from qq where q not in (select q from f)) where len(k) >= 2),
m as (select q, email, t from e join pp on contains(t, c) group by q, need, email, t having count(*) = need), s as (select q, count(*) n, min(email) email from m group by 1)
select q as name, email from (select * from f union all select * from s) where n = 1 and email is not null""")
def addresses_of_names(spark, d):
    """Names of the sources in which a row is one person's."""
    return resolve.addresses_of_names(_raw(spark, d).where("source in ('slack', 'drive', 'file')"), table(spark, d, "people"), query="name")


@query("""
with p as (select email, unnest(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\s　._,\\-]+'), lambda x: x <> ''))) t from people),
q as (select distinct name from raw where name is not null), qt as (select name, unnest(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\s　._,\\-]+'), lambda x: x <> ''))) t from q), nd as (select name, count(*) need from qt group by 1),
h as (select qt.name, email, count(*) n from qt join p using (t) group by 1, 2), f as (select h.name, email from h join nd on h.name = nd.name and n = need)
select name, min(email) email from f group by 1 having count(distinct email) = 1""")
def resolve_by_tokens(spark, d):
    return resolve.by_all_tokens(_raw(spark, d).where(F.col("name").isNotNull()), table(spark, d, "people"), query="name")


def _company_sql(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_replace(trim({x}, ' '), '^pjt_', ''), '[（(\\[].*?[）)\\]]', '', 'g'), '[\\s　]+', '', 'g'))"


@query(f"""
with w as (select distinct split_part(subject, ' ', 1) q from raw where subject is not null union select distinct project from raw where project is not null union select distinct domain || 'さん' from domain_map where domain is not null),
b as (select q, regexp_replace(trim(q, ' '), '\\s*(さん|様|さま)$', '') b from w), c as (select q, {_company_sql("b")} c, case when contains(b, '.') then lower(b) end dd from b),
m as (select distinct trim(project, ' ') project, lower(regexp_replace(trim(domain, ' '), '^@+', '')) dm from domain_map where trim(project, ' ') <> ''), k as (select *, {_company_sql("project")} k from m),
h as (select distinct q, project, dm from c join k on (c <> '' and k <> '' and (contains(c, k) or contains(k, c))) or dd = dm), g as (select q, count(*) n, min(project) p, min(dm) dm from h group by 1)
select w.q, case when n = 1 then p end project, case when n = 1 then dm end as domain, case when n is null then 'none' when n = 1 then 'one' else 'ambiguous' end status from w left join g on w.q = g.q""")
def resolve_company(spark, d):
    r, m = _raw(spark, d), table(spark, d, "domain_map")
    q = r.where("subject is not null").select(F.split_part("subject", F.lit(" "), F.lit(1)).alias("q")).unionByName(r.where("project is not null").select(F.col("project").alias("q"))).unionByName(m.where("domain is not null").select(F.concat("domain", F.lit("さん")).alias("q"))).distinct()
    return resolve.resolve_company(q, m, query="q")


@query()
def exclusion_report(spark, d):
    """What the spellings of the payees exclude among the organisations and people."""
    return predicates.exclusion_hits(table(spark, d, "people"), "name", table(spark, d, "payee_alias"), "spelling").distinct()


def _invoices(spark, d):
    a = table(spark, d, "payee_alias").where("spelling is not null")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("evidence"))
    return a.select(F.concat_ws("|", "payee_code", "spelling").alias("id"), F.lower(F.regexp_replace("spelling", r"[\s　]+", "")).alias("n"), F.when(F.col("evidence") % 7 != 0, day).alias("d"), (F.col("evidence") % 2 == 0).alias("ledger"))


def _vendor_candidates(spark, d):
    i = _invoices(spark, d)
    left = i.where("not ledger").select(F.col("id").alias("invoice"), "n", "d")
    return matching.vendor_candidates(left, i.where("ledger").select(F.col("id").alias("row"), "n", "d"), left_id="invoice", right_id="row", name="n", date="d", days=31, top=30)


@query()
def vendor_candidates(spark, d):
    """Payee spellings of even evidence as the ledger, the others as invoices."""
    return _vendor_candidates(spark, d)


@query("""
with i as (select payee_code || '|' || spelling id, lower(regexp_replace(spelling, '[\\s　]+', '', 'g')) n, case when evidence % 7 <> 0 then date '2024-01-01' + evidence end d, evidence % 2 = 0 ledger from payee_alias where spelling is not null)
select a.id invoice, b.id as row, abs(date_diff('day', a.d, b.d))::int gap, 'vendor' stage from i a join i b on not a.ledger and b.ledger and a.n <> '' and b.n <> '' and (contains(a.n, b.n) or contains(b.n, a.n)) and coalesce(abs(date_diff('day', a.d, b.d)) <= 31, true)""")
def vendor_candidates_named(spark, d):
    """The candidates of the first stage."""
    return _vendor_candidates(spark, d).where("stage = 'vendor'")


_LINES_SQL = """
with x as (select o_custkey, o_orderpriority, o_orderkey, o_orderstatus s, year(o_orderdate)::varchar y, row_number() over (partition by o_custkey, o_orderpriority, o_orderkey % 2 order by o_orderkey) rn from orders),
j as (select t.s ts, t.y ty, p.s ps, p.y py, t.rn is null no_t, p.rn is null no_p, p.rn is not null and p.o_orderkey % 7 <> 1 auto from (select * from x where o_orderkey % 2 = 0) t full join (select * from x where o_orderkey % 2 = 1) p on t.o_custkey = p.o_custkey and t.o_orderpriority = p.o_orderpriority and t.rn = p.rn),
k as (select *, case when no_p then 'left' when no_t then 'none' when ts <> ps or ty <> py then 'wrong' else 'hit' end c from j)"""


def _lines(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate")).withColumn("review", F.when(F.col("o_orderkey") % 7 == 1, "look"))
    keys = ["o_custkey", "o_orderpriority"]
    return evaluate.line_accuracy(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), keys=keys, fields=["o_orderstatus", "y"], truth_order="o_orderkey", pred_order="o_orderkey", review="review")


@query(_LINES_SQL + """
select count(*) filter (where c = 'hit') n_hit, count(*) filter (where c = 'wrong') n_wrong, count(*) filter (where c = 'none') n_none, count(*) filter (where c = 'left') n_truth_left, count(*) filter (where auto) n_auto, count(*) filter (where auto and c = 'wrong') n_auto_wrong, count(*) filter (where auto and c = 'none') n_auto_none,
 (count(*) filter (where auto and c in ('wrong', 'none')))::double / count(*) filter (where auto) auto_error_rate from k""")
def line_accuracy(spark, d):
    return _lines(spark, d)[0]


@query(_LINES_SQL + """
select case when ts <> ps and ty <> py then 'o_orderstatus,y' when ts <> ps then 'o_orderstatus' else 'y' end fields, count(*) n from k where c = 'wrong' group by 1""")
def line_wrong_fields(spark, d):
    return _lines(spark, d)[1]


@query("""
with r as (select l_returnflag b, l_orderkey k, l_linenumber k2, l_quantity::decimal(18,2) a, l_discount < 0.09 ok from lineitem), t as (select * from r where k % 5 <> 0), c as (select l_returnflag b, l_linestatus, floor(sum(l_quantity::decimal(18,2)) / 1000) * 1000 t from lineitem group by 1, 2)
select r.b, count(*) n, count(*) filter (where not ok) n_failed, count(*) filter (where r.k % 5 <> 0) n_found, (sum(a) - (select sum(t) from c where c.b = r.b))::double diff, abs(sum(a) - (select sum(t) from c where c.b = r.b)) <= ((select count(*) from c where c.b = r.b) - 1) * 1000 "within" from r group by 1""")
def extraction_score(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("b"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("k2"), F.col("l_quantity").cast("decimal(18,2)").alias("a"), (F.col("l_discount") < 0.09).alias("ok"), "l_linestatus")
    c = r.groupBy("b", "l_linestatus").agg(F.sum("a").alias("s")).select("b", (F.floor(F.col("s") / 1000) * 1000).alias("t"))
    e = evaluate.extraction_score(r, c, r.where("k % 5 <> 0").select("b", "k", "k2"), by="b", keys=["k", "k2"], amount="a", total="t", ok="ok")
    return e.withColumn("diff", F.col("diff").cast("double"))


@query("""
with r as (select p_partkey, case when p_size % 9 = 0 then null else p_retailprice end pr, row_number() over (order by p_size desc, p_partkey) rk from part), t as (select * from r where rk <= 100),
v as (select count(*) filter (where rk <= 50 and pr <= 1300) w, count(*) filter (where rk <= 50 and pr is null) u from t)
select p_partkey, rk::int as rank, case when rk <= 50 then 1 else 2 end batch from t, v where pr <= 1300 and rk <= 50 + case when w + u >= 50 then 0 else 50 - w end""")
def refilled(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice")).alias("pr"))
    return score.refilled(p, price="pr", budget=1300, wanted=50, order=[F.desc("p_size"), F.asc("p_partkey")]).select("p_partkey", "rank", "batch")


@query("select n_name, o::int as ordinal from nation join (values ('NATION_7', 1), ('NATION_3', 2), ('NATION_21', 3), ('NATION_0', 5)) v(k, o) on n_name = k")
def in_given_order(spark, d):
    return score.in_given_order(table(spark, d, "nation"), "n_name", ["NATION_7", "NATION_3", "NATION_21", "NATION_3", "NATION_0", "nowhere"]).select("n_name", "ordinal")


@query("""
with c as (select payee_code, account, count(*) n, min(voucher_key) f from journal where payee_code is not null and account is not null group by 1, 2), r as (select *, row_number() over (partition by payee_code order by n desc, f, account) rk, count(*) over (partition by payee_code) n_values from c)
select payee_code, account, n, n_values, f page from r where rk = 1""")
def majority_page(spark, d):
    return aggregate.majority_page(table(spark, d, "journal").where("payee_code is not null"), ["payee_code"], "account", "voucher_key")


@query("select payee_code, account, n from (select payee_code, account, count(*) n, count(*) over (partition by payee_code) k from journal where payee_code is not null and account is not null group by 1, 2) where k > 1")
def value_conflicts(spark, d):
    return aggregate.conflicts(table(spark, d, "journal").where("payee_code is not null"), ["payee_code"], "account")


@query("""
with c as (select l_orderkey s, l_returnflag i, l_linestatus v, l_linenumber p from lineitem), w as (select distinct l_orderkey s, i, 'F' v from lineitem, (values ('R'), ('N'), ('A')) t(i)), a as (select distinct l_orderkey s, 'R' i, 2 p from lineitem where l_orderkey % 2 = 0),
ci as (select s, arg_min(p, o) p from (select l_orderkey s, l_linenumber p, l_orderkey * 10 + l_linenumber o from lineitem where l_orderkey % 3 = 0) group by 1), f as (select arg_min(l_linenumber, l_orderkey * 10 + l_linenumber) p from lineitem where l_orderkey % 3 = 0),
j as (select w.*, a.p ap, (select count(*) from c where c.s = w.s and c.i = w.i and c.v = w.v and c.p = a.p) > 0 hit, (select min(p) from c where c.s = w.s and c.i = w.i and c.v = w.v) ex, (select min(p) from c where c.s = w.s and c.i = w.i) an, ci.p cp, f.p fp from w left join a on w.s = a.s and w.i = a.i left join ci on ci.s = w.s, f)
select s as source, i as item, v as value, (case when hit then ap + 1 when ex is not null then ex + 1 when an is not null then an + 1 when ap is not null then ap + 1 else coalesce(cp, fp, 0) end)::int page, case when hit then 'adopted' when ex is not null then 'value' when an is not null then 'item' when ap is not null then 'unplaced' when coalesce(cp, fp) is not null then 'cited' else 'none' end how from j""")
def best_page(spark, d):
    li = table(spark, d, "lineitem")
    c = li.select(F.col("l_orderkey").alias("source"), F.col("l_returnflag").alias("item"), F.col("l_linestatus").alias("value"), F.col("l_linenumber").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    orders = li.select(F.col("l_orderkey").alias("source")).distinct()
    wanted = orders.select("source", F.explode(F.array(*map(F.lit, "RNA"))).alias("item"), F.lit("F").alias("value"))
    adopted = orders.where("source % 2 = 0").select("source", F.lit("R").alias("item"), F.lit(2).alias("page"))
    return aggregate.best_page(wanted, c, adopted, c.where("source % 3 = 0").select("source", "page", "ord"))


@query("""
select parents, count(*) n_batches, coalesce(string_agg(subject, e'\\n' order by _id) filter (where trim(subject, ' ') <> ''), '') subject, len(list_distinct(flatten(list(coalesce(links, []))))) n_links from raw where source = 'gmail' and parents <> '' group by 1""")
def merged_summaries(spark, d):
    """The subjects and links of each mail thread, whose length bounds a row."""
    m = aggregate.merged_summaries(_raw(spark, d).where("source = 'gmail' and parents <> ''"), ["parents"], order="_id", lists=["links"], texts=["subject"])
    return m.select("parents", "n_batches", "subject", F.size("links").cast("bigint").alias("n_links"))


@query("select count(*) n, count(distinct source) n_groups, case when count(*) = 0 then 'none' when count(*) > 300 then 'many' end reason from raw where project = 'pjt_tax_north'")
def replan(spark, d):
    return search.replan(_raw(spark, d).where("project = 'pjt_tax_north'"), group="source")


@query("""
select event_id, try_cast(props::json->>'k' as int) as level, [] as tags, props::json->>'k' as label from events""")
def aliased_fields(spark, d):
    e = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return e.select("event_id", *choices.aliased(F.col("m"), {"level": (["grade", "k"], "int"), "tags": (["labels"], "array<string>"), "label": (["k", "name"], "string")}))


@query("""
select p_partkey, list_distinct(list_filter([p_brand || ' ' || p_type, p_type, case when p_size > 20 then p_brand else p_type end], lambda x: x <> ''))[1:2] is not null ok, len(list_distinct([p_brand || ' ' || p_type, p_type, case when p_size > 20 then p_brand else p_type end])[1:2]) n, p_brand || ' ' || p_type as first_phrase from part""")
def search_phrases(spark, d):
    s = choices.search_phrases([[F.col("p_brand"), F.col("p_type")], [F.lit(" "), F.col("p_type")], [F.when(F.col("p_size") > 20, F.col("p_brand")).otherwise(F.col("p_type"))]], 2)
    return table(spark, d, "part").select("p_partkey", s.isNotNull().alias("ok"), F.size(s).cast("bigint").alias("n"), F.get(s, F.lit(0)).alias("first_phrase"))


@query("""
with f as (select _id, regexp_extract(regexp_replace(links[1], '\\s+$', ''), '([^/]+)$', 1) n, length(coalesce(content, '')) s, "timestamp" t from raw where source in ('drive', 'file') and len(links) > 0), k as (select n, arg_min(s, _id) ks, min(_id) id0 from f where n <> '' group by 1),
j as (select f.*, case when f._id <> id0 then ks end ks from f join k using (n))
select _id, case when ks is null then 'new' when s = ks then 'same' else 'version' end "action", case when ks is null or s = ks then n else regexp_replace(n, '\\.[A-Za-z0-9]{1,5}$', '') || '_' || strftime(t, '%Y%m%d') || regexp_extract(n, '(\\.[A-Za-z0-9]{1,5})$', 1) end as name from j""")
def upload_versions(spark, d):
    """Files of equal name: the first is new, the others are the same or a version of it."""
    f = _raw(spark, d).where("source in ('drive', 'file') and size(links) > 0").select("_id", F.regexp_extract(F.regexp_replace(F.get("links", F.lit(0)), r"\s+$", ""), "([^/]+)$", 1).alias("n"), F.length(F.coalesce("content", F.lit(""))).alias("s"), F.col("timestamp").alias("t")).where("n <> ''")
    k = f.groupBy("n").agg(F.min_by("s", "_id").alias("ks"), F.min("_id").alias("id0"))
    known = F.when(F.col("_id") != F.col("id0"), F.col("ks"))
    return f.join(k, "n").select("_id", choices.upload_action(F.col("s"), known, F.col("n"), F.col("t")).alias("u")).select("_id", "u.*")


@query("""
select _id, case when regexp_matches(n, '\\.(pdf|png|gif)$') then regexp_extract(n, '\\.(pdf|png|gif)$', 1) when regexp_matches(n, '\\.(jpg|jpeg)$') then 'jpeg' when regexp_matches(n, '\\.(xlsx|docx|pptx|zip)$') then 'zip' when regexp_matches(n, '\\.(txt|csv|md|json)$') then 'text' else 'unknown' end kind from (select _id, regexp_replace(lower(coalesce(links[1], '')), '\\s+$', '') n from raw where source in ('drive', 'file'))""")
def file_kinds(spark, d):
    r = _raw(spark, d).where("source in ('drive', 'file')")
    return r.select("_id", readers.file_kind(F.regexp_replace(F.coalesce(F.get("links", F.lit(0)), F.lit("")), r"\s+$", ""), F.encode("content", "UTF-8")).alias("kind"))


@query("""
with f as (select _id, regexp_replace(regexp_replace(trim(links[1], ' '), '[\\\\/:*?"<>|\\s]+', '_', 'g'), '^[._]+', '') s0 from raw where len(links) > 0), s as (select _id, case when s0 <> '' then s0 else 'file' end s from f), n as (select *, row_number() over (partition by lower(s) order by _id) n from s)
select _id, case when n = 1 then s else regexp_replace(s, '\\.[A-Za-z0-9]{1,5}$', '') || '_' || n || regexp_extract(s, '(\\.[A-Za-z0-9]{1,5})$', 1) end safe_name from n""")
def safe_file_names(spark, d):
    f = _raw(spark, d).where("size(links) > 0").select("_id", F.get("links", F.lit(0)).alias("n")).where("n is not null")
    return readers.safe_names(f, "n", order="_id").select("_id", "safe_name")


@query("""
with s as (select parents, min(_id) o from raw where source = 'gmail' and contains(lower(subject), 'invoice') and parents <> '' group by 1 order by o, parents limit 10), g as (select * from raw where source = 'gmail' and parents in (select parents from s))
select _id, parents from g where parents in (select parents from g group by 1 having count(distinct _id) >= 2)""")
def thread_expand_first(spark, d):
    """The threads of the first ten seeds, as the feature has it."""
    g = _raw(spark, d).where("source = 'gmail'")
    seeds = search.first_seeds(g.where(F.lower("subject").contains("invoice")), "parents", [F.col("_id")])
    return search.expand_threads(seeds, g, key="parents").select("_id", "parents")


@query("select _id from raw where \"timestamp\" > timestamptz '2024-06-30 17:00:00+00' and \"timestamp\" <= timestamptz '2024-07-01 00:00:00+00'")
def scheduled_lookback(spark, d):
    """The seven hours before a run that comes every six."""
    return ingest.lookback(_raw(spark, d), "timestamp", "2024-07-01 00:00:00+00:00", 7).select("_id")


@query("""
with u as (select strftime("timestamp", '%Y-%m') m, count(*) n from raw where "timestamp" is not null group by 1), s as (select strftime("timestamp", '%Y-%m') m, bool_or(source = 'meeting' and _id % 40 = 0) dn, min("timestamp") o from raw where "timestamp" is not null and project = 'pjt_tax_north' group by 1)
select u.m, u.n, epoch_us(s.o) resume_us from u left join s using (m) where not coalesce(dn, false)""")
def backward_sweep(spark, d):
    r = _raw(spark, d).where("timestamp is not null").withColumn("m", F.date_format("timestamp", "yyyy-MM"))
    state = r.where("project = 'pjt_tax_north'").select("m", F.coalesce((F.col("source") == "meeting") & (F.col("_id") % 40 == 0), F.lit(False)).alias("done"), F.col("timestamp").alias("oldest"))
    return ingest.sweep(r.groupBy("m").agg(F.count("*").alias("n")), state, unit="m", order="m").select("m", "n", F.unix_micros("resume_from").alias("resume_us"))


@query("""
select _id, case when contains(lower(coalesce(subject, '')), 'invoice') then 'billing' when contains(lower(coalesce(subject, '')), 'voucher') then 'ledger' else 'other' end as label, contains(lower(coalesce(subject, '')), 'invoice') or contains(lower(coalesce(subject, '')), 'voucher') valid from raw where source = 'gmail'""")
def mail_labels(spark, d):
    r = _raw(spark, d).where("source = 'gmail'").select("_id", "subject")
    return judge.classified(r, judge.keyword_classifier("subject", [("invoice", "billing"), ("voucher", "ledger"), ("contract", "unlisted")]), ["billing", "ledger"], key="_id", fallback="other")


@query("""
select _id, (row_number() over (partition by _id order by n))::int row_no, line from (select _id, unnest(string_split(content, e'\\n')) line, generate_subscripts(string_split(content, e'\\n'), 1) n from raw where source = 'file' and content is not null) where regexp_matches(line, '[0-9]')""")
def page_rows(spark, d):
    """Lines with a figure as the rows that a reader finds on a page."""
    r = _raw(spark, d).where("source = 'file' and content is not null").select("_id", "content")
    return judge.page_rows(r, _lines_with_figures, "line string", key="_id")


def _lines_with_figures(page: dict) -> list[dict]:
    return [{"line": x} for x in page["content"].split("\n") if any(c in "0123456789" for c in x)]


@query("""
with s as (select voucher_key, count(*) n, count(*) filter (where account is null) k from journal group by 1)
select voucher_key, n, n <= 3 by_judge from s""")
def rechecked_groups(spark, d):
    """A judge's number of lines stands for vouchers of three lines or fewer, the machine's for the others."""
    j = table(spark, d, "journal").groupBy("voucher_key").agg(F.count("*").alias("n"))
    ok = j.select("voucher_key", (F.col("n") <= 3).alias("ok"))
    answers = judge.judged(j, _echo, "n bigint", key="voucher_key")
    return judge.rechecked(answers, j, ok, by="voucher_key")


def _echo(rows: list[dict]) -> list[dict]:
    return [{"n": r["n"]} for r in rows]


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'second' else 'first' end \"by\", o_orderstatus decision from orders")
def judged_or(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return judge.judged_or(o, _two_of_three, _all_of_them, "decision string", key="o_orderkey", required=["decision"])


def _two_of_three(rows: list[dict]) -> list[dict]:
    return [{"decision": r["o_orderstatus"]} if r["o_orderkey"] % 3 else {} for r in rows]


def _all_of_them(rows: list[dict]) -> list[dict]:
    return [{"decision": r["o_orderstatus"]} for r in rows]


@query("""
with c as (select 'k' || c_custkey k, c_name v from customer where c_custkey % 3 = 0), s as (select 'k' || s_suppkey k, s_name v from supplier)
select o_orderkey, coalesce(c.v, s.v) v, case when c.v is not null then 'customer' when s.v is not null then 'supplier' end pool from orders o left join c on 'k' || o_custkey = c.k left join s on 'k' || o_custkey = s.k""")
def two_pools(spark, d):
    k = lambda c: F.concat(F.lit("k"), F.col(c).cast("string")).alias("k")
    c = table(spark, d, "customer").where("c_custkey % 3 = 0").select(k("c_custkey"), F.col("c_name").alias("v"))
    s = table(spark, d, "supplier").select(k("s_suppkey"), F.col("s_name").alias("v"))
    o = table(spark, d, "orders").select("o_orderkey", k("o_custkey"))
    return lookup.in_two_pools(o, c, s, key="k", value="v", names=("customer", "supplier")).select("o_orderkey", "v", "pool")


@query("select p_brand sheet, (6 + row_number() over (partition by p_brand order by p_partkey))::int as row, p_retailprice::decimal(18,2)::varchar sales, case when p_size % 4 = 0 then 'n/a' else p_size::varchar end profit, (case when p_size % 4 <> 0 then p_retailprice::decimal(18,2) - p_size end)::double as cost from part")
def fixed_sheet(spark, d):
    """Sheets with the header in row 5 and the data from row 7; the cost is what is left of the sales."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("sheet"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 6).alias("row"), F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("s"), F.when(F.col("p_size") % 4 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("q"))
    cells = p.select("sheet", "row", F.explode(F.array(F.struct(F.lit(2).alias("col"), F.col("s").alias("value")), F.struct(F.lit(4).alias("col"), F.col("q").alias("value")))).alias("c")).select("sheet", "row", "c.*")
    head = p.select("sheet").distinct().select("sheet", F.lit(5).alias("row"), F.explode(F.array(F.struct(F.lit(2).alias("col"), F.lit("Sales ").alias("value")), F.struct(F.lit(3).alias("col"), F.lit(" ").alias("value")), F.struct(F.lit(4).alias("col"), F.lit("Profit").alias("value")))).alias("c")).select("sheet", "row", "c.*")
    s = readers.fixed_sheet(cells.unionByName(head), sheet="sheet", header=5, first=7, columns={"Sales": "sales", "Profit": "profit"}, derived={"cost": ("sales", "profit")})
    return s.withColumn("cost", F.col("cost").cast("double"))


@query("select k, side from (select c_custkey k, 'no order' side from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 3 = 0) union all select distinct o_custkey, 'no customer' from orders where o_custkey % 50 = 0)")
def orphan_report(spark, d):
    """Customers against a third of the orders, and orders against customers of which every fiftieth is missing."""
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    third = o.where("o_orderkey % 3 = 0").select("k").distinct()
    none = matching.match_report(c, third.withColumnRenamed("k", "r"), c.join(third, "k").select("k", F.col("k").alias("r"), F.lit("both").alias("stage")), left_id="k", right_id="r").where("stage = 'left_only'")
    known = c.where("k % 50 <> 0").withColumnRenamed("k", "r")
    lost = matching.match_report(o.select("k").distinct(), known, o.select("k").distinct().join(known, F.col("k") == F.col("r")).select("k", "r", F.lit("both").alias("stage")), left_id="k", right_id="r").where("stage = 'left_only'")
    return none.select("k", F.lit("no order").alias("side")).unionByName(lost.select("k", F.lit("no customer").alias("side")))


@query("""
with v as (select voucher_key, payee_code, ym, sum(amount) t from journal group by 1, 2, 3), w as (select * from v union all select voucher_key || '-b', payee_code, ym, t from v where ym % 4 = 0)
select voucher_key, payee_code from w where (payee_code, ym, t) in (select (payee_code, ym, t) from w where payee_code is not null and ym is not null and t is not null group by payee_code, ym, t having min(voucher_key) <> max(voucher_key))""")
def voucher_duplicates(spark, d):
    """Vouchers with those of every fourth month entered again under another key."""
    from tallyloom.operators import upsert

    v = table(spark, d, "journal").groupBy("voucher_key", "payee_code", "ym").agg(F.sum("amount").alias("t"))
    again = v.where("ym % 4 = 0").withColumn("voucher_key", F.concat("voucher_key", F.lit("-b")))
    return upsert.duplicates_elsewhere(v.unionByName(again), ["payee_code", "ym", "t"], "voucher_key").select("voucher_key", "payee_code")


@query("""
select payee_code, spelling, lower(regexp_replace(regexp_replace(trim(regexp_replace(trim(spelling, ' '), '[(（\\[][^)）\\]]*[)）\\]]', '', 'g'), ' '), '(?:様|さん|氏|殿|御中)$|^(?i:mr|mrs|ms|mx|dr)\\.?\\s+', '', 'g'), '[\\s　]+', '', 'g')) k from payee_alias""")
def person_keys(spark, d):
    return table(spark, d, "payee_alias").select("payee_code", "spelling", text.person_key(F.col("spelling")).alias("k"))


@query("""
with l as (select _id, unnest(links) link, generate_subscripts(links, 1) - 1 pos from raw where source <> 'slack'), f as (select distinct _id, trim(regexp_replace(link, '\\s+$', ''), ' ') link, pos from l),
o as (select _id, link, min(pos) pos from f where link <> '' group by 1, 2), p as (select links[1] link, min(_id) file_id from raw where source in ('drive', 'file') group by 1)
select o._id, o.pos::int pos, o.link, file_id from o join p using (link)""")
def attachments_explode(spark, d):
    r = _raw(spark, d)
    files = r.where("source in ('drive', 'file')").select(F.get("links", F.lit(0)).alias("path"), F.col("_id").alias("file_id")).where("path is not null")
    return search.attachments(r.where("source <> 'slack'"), files, links_col="links", path_col="path", id_col="_id").select("_id", "pos", "link", "file_id")
