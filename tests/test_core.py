"""Core operators against brute force and golden rows."""

from __future__ import annotations

import itertools
import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import choices, dates, numbers, text
from tallyloom.operators import aggregate, evaluate, judge, lookup, matching, ordered, panel, predicates, score, upsert
from tallyloom.sources import readers, writers


def one(spark, expr, *values, types=None):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types or ["string"] * len(values), strict=True))
    return spark.createDataFrame([values], schema).select(expr(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("2024年3月分", "202403"), ("2024-12", "202412"), ("20240305", "202403"), ("2024/13", None), ("none", None), (None, None)])
def test_year_month(spark, given, want):
    assert one(spark, dates.year_month, given) == want


def test_dates(spark):
    assert one(spark, dates.era_date, "令和6年3月1日") == date(2024, 3, 1) and one(spark, dates.era_date, "R元.5.1") == date(2019, 5, 1)
    assert one(spark, dates.loose_date, "2024/2/29") == date(2024, 2, 29) and one(spark, dates.loose_date, "2024/2/30") is None
    t = lambda v: one(spark, lambda c: F.unix_seconds(dates.any_timestamp(c)), v)
    base = t("2024-01-02T00:00:00Z")
    assert base == t(str(base)) == t(str(base * 1000)) == t("2024-01-02T09:00:00") == t("2024-01-02 09:00:00+0900") and t("x") is None
    r = one(spark, dates.renewal_period, date(2023, 3, 1), date(2025, 2, 28), types=["date", "date"])
    assert (r["start"], r["end"]) == (date(2025, 3, 1), date(2027, 2, 28))
    assert one(spark, dates.year_candidates, "1984 to 1999, 2099 and 21000") == [1999, 2099]
    days = one(spark, lambda a, b: dates.business_days(a, b, ["2024-01-02"]), date(2024, 1, 1), date(2024, 1, 8), types=["date", "date"])
    assert [d.day for d in days] == [1, 3, 4, 5, 8]
    assert one(spark, lambda a, b: dates.within_days(a, b, 3, null_passes=True), None, date(2024, 1, 1), types=["date", "date"]) is True
    assert one(spark, dates.default_end, datetime(2024, 1, 1, 9), None, types=["timestamp_ntz", "timestamp_ntz"]) == datetime(2024, 1, 1, 10)


def test_numbers(spark):
    n = lambda v: one(spark, numbers.to_number, v)
    assert n("1,234円") == 1234 and n("△5") == -5 and n("(12.5)") == Decimal("-12.5") and n("０") == 0 and n("abc") is None and n("1.2.3") is None
    assert one(spark, lambda a, b: numbers.safe_div(a, b), 1.0, 0.0, types=["double"] * 2) is None
    assert one(spark, lambda a: numbers.included_tax(a), Decimal(1100), types=["decimal(18,0)"]) == 100
    assert one(spark, numbers.signed_text, Decimal(-1200), types=["decimal(18,0)"]) == "-1,200" and one(spark, numbers.signed_text, Decimal(5), types=["decimal(18,0)"]) == "+5"
    b = lambda v: (lambda r: r and (r["low"], r["high"]))(one(spark, numbers.range_bounds, v))
    assert b("10-20") == (10, 20) and b("under 10") == (0, 10) and b("over 50") == (50, float("inf")) and b("n/a") is None
    assert one(spark, lambda a: numbers.reduced_price(a), 500_000_000.0, types=["double"]) == pytest.approx(5.0)
    assert one(spark, lambda a: numbers.reduced_price(a), 9_999.0, types=["double"]) == 9_999.0


def test_text(spark):
    assert one(spark, text.nfkc, "ＡＢＣ ｶﾞ") == "ABC ガ" and one(spark, text.nfkc, None) is None
    assert one(spark, text.party_key, "001 株式会社 Lake-Works Ltd.") == "lakeworks" and one(spark, text.person_key, " 田辺　沙織 様") == "田辺沙織"
    assert one(spark, text.branch_key, "西港 支店") == "西港" and one(spark, text.lot_key, "１２番地の３") == "12-3" and one(spark, text.town_key, "緑町 3丁目") == "緑町三丁目"
    assert one(spark, text.emails, "A@x.test, b <a@X.test>; c@y.test") == ["a@x.test", "c@y.test"] and one(spark, text.emails, None) == []
    assert one(spark, text.display_names, '"Hill, Anna" <a@x.test>, Bob <b@x.test>') == ["Hill, Anna", "Bob"]
    assert one(spark, text.canonical_url, "HTTP://www.X.test/a/?q=1#z") == "https://x.test/a" and one(spark, text.strip_html, "<p>a &amp; b</p><script>x</script>c") == "a & b\nc"
    assert one(spark, lambda c: text.chunks(c, 3), "abcdefg") == ["abc", "def", "g"] and one(spark, lambda c: text.chunks(c, 3), "") == []
    assert one(spark, text.base_name, "Plan_v2.1.xlsx") == "plan" and one(spark, text.name_tokens, "annaHill-Stone") == ["anna", "hill", "stone"]
    assert one(spark, lambda c: text.windows_around(c, ["zz"], 2, 3), "abcdefzzgh") == ["abc", "efzz"]
    assert one(spark, text.valid_person, "No-Reply@x.test") is None and one(spark, text.valid_person, " A@x.test ") == "a@x.test"


def test_choices(spark):
    assert one(spark, choices.known, "不明") is None and one(spark, choices.known, "0") == "0"
    assert one(spark, lambda c: choices.canon_choice(c, ["a", "b", "none"], "none"), "none b a") == "a,b"
    r = one(spark, lambda a, b: choices.by_priority([("x", a), ("y", b)]), None, "v")
    assert (r["value"], r["source"]) == ("v", "y")
    assert one(spark, choices.unwrap_json, 'text ```json\n{"a": 1}\n``` end') == '{"a": 1}'
    assert one(spark, lambda v, m: choices.forced(v, m), "B", "A (B)") == "B" and one(spark, lambda v, m: choices.forced(v, m), "C", "A (B)") == "A"
    d = spark.createDataFrame([("x", None, "y", "z")], "a string, b string, c string, d string")
    got = d.select(*choices.fill_missing({"a": F.col("a"), "b": F.col("b")}, {"a": F.col("c"), "b": F.col("d")})).first()
    assert tuple(got) == ("x", "z", ["b"])


def test_dynamic_condition_rules(spark):
    df = spark.createDataFrame([("10", "x"), ("n/a", "y"), (None, None)], "v string, t string")
    n = lambda *a: df.where(predicates.condition(df, *a)).count()
    assert n("v", ">=", 5) == 1 and n("v", ">=", "abc") == 3 and n("missing", "==", 1) == 3 and n("t", "!=", "x") == 2 and n("t", "in", ["x", "("]) == 1
    assert predicates.tree([[], []]) is None and df.where(predicates.tree([[F.col("t") == "x", F.col("t") == "y"], []])).count() == 2
    assert predicates.canonical_column("si", ["size", "type"]) == "size" and predicates.canonical_column("q", ["size"]) == "q"
    r = score.ranked(df, id_col="v", spec={"t": ("==", "none")}, on_empty="unfiltered")
    assert r.count() == 3 and r.first()["fallback"]


def test_contains_pairs_equal_nested_loop(spark):
    rng = random.Random(2)
    w = lambda k: "".join(rng.choices("abc", k=rng.randrange(1, k)))
    texts, needles = {w(12) for _ in range(80)}, {w(6) for _ in range(60)}
    got = matching.contains_pairs(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(n,) for n in needles], "n string"), text="t", needle="n")
    assert {tuple(r) for r in got.collect()} == {(t, n) for t in texts for n in needles if n in t}


@pytest.mark.parametrize("cutoff", [0.7, 0.8, 0.9])
def test_fuzzy_match_loses_nothing(spark, cutoff):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcde ", k=rng.randrange(2, 14))).strip() or "a" for _ in range(60)]

    def typo(s):
        i = rng.randrange(len(s))
        return s[:i] + rng.choice("abcde") + s[i + rng.randrange(2) :]

    a, b = set(base), {typo(s) for s in base} | set(base[:10])
    got = matching.fuzzy_match(spark.createDataFrame([(x,) for x in a], "l string"), spark.createDataFrame([(x,) for x in b], "r string"), left_col="l", right_col="r", cutoff=cutoff)
    assert {(r["l"], r["r"]) for r in got.collect()} == {(x, y) for x in a for y in b if matching.similarity(x, y) >= cutoff}


def test_greedy_assign_equals_sequential(spark):
    rng = random.Random(6)
    pairs = [(g, left, r, rng.randrange(6)) for g in range(3) for left in range(6) for r in range(6) if rng.random() < 0.7]
    got = {tuple(r)[:3] for r in matching.greedy_assign(spark.createDataFrame(pairs, "g int, l int, r int, s int"), by="g", left="l", right="r", score="s").collect()}
    want, used = set(), set()
    for g, left, r, _ in sorted(pairs, key=lambda p: (p[3], p[1], p[2]), reverse=True):
        if (g, "l", left) not in used and (g, "r", r) not in used:
            used |= {(g, "l", left), (g, "r", r)}
            want.add((g, left, r))
    assert got == want


def test_near_amounts_equal_nested_loop(spark):
    rng = random.Random(8)
    a, b = [(i, rng.randrange(-40, 60)) for i in range(50)], [(i, rng.randrange(-40, 60)) for i in range(50)]
    got = matching.near_amounts(spark.createDataFrame(a, "i int, x int"), spark.createDataFrame(b, "j int, y int"), left_id="i", right_id="j", left_amount="x", right_amount="y", tolerance=3)
    assert {(r["i"], r["j"]) for r in got.collect()} == {(i, j) for (i, x), (j, y) in itertools.product(a, b) if abs(x - y) <= 3} and got.count() == got.distinct().count()


def test_ordered(spark):
    rows = [("f", 1, "attachment", 1, 1, 5), ("f", 2, "body", 1, 1, 9), ("f", 3, "body", 1, 1, 4), ("f", 4, "body", 2, 1, 7), ("f", 5, "body", 2, 2, 7), ("f", 6, "worksheet", 0, 0, 0), ("f", 7, "body", 3, 1, 1), ("g", 1, "body", 1, 1, 1)]
    df = spark.createDataFrame(rows, "file string, p int, kind string, party int, m int, total int")
    got = ordered.page_groups(df, file="file", order="p", kind="kind", party="party", month="m", total="total")
    assert [r["group_no"] for r in got.orderBy("file", "p").collect()] == [1, 1, 1, 2, 2, 3, 3, 1]
    s = spark.createDataFrame([("d", i, v) for i, v in enumerate([10, 20, 30, 5, 5, 10, 3])], "d string, i int, v int")
    assert [r["is_subtotal"] for r in ordered.drop_subtotals(s, by="d", order="i", amount="v").orderBy("i").collect()] == [False, False, True, False, False, True, False]
    r = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert all(x["v"] + 1 == x["rank"] for x in ordered.global_rank(r, ["v"]).collect())
    la = spark.createDataFrame([("a", i, Decimal(v)) for i, v in enumerate([50, 20, 30, 7, 7])], "b string, i int, v decimal(18,2)")
    assert [x["n_parts"] for x in ordered.look_ahead_sum(la, by="b", order="i", amount="v", tolerance=0).orderBy("i").collect()] == [2, None, None, None, None]


def test_panel_and_merge(spark):
    p = spark.createDataFrame([("t", 1, "r1", 5), ("t", 2, "r1", None), ("t", 2, "r2", None), ("t", 3, "r1", 8), ("t", 3, "r2", 1)], "t string, p int, r string, v int")
    got = {(x["p"], x["r"]): (x["prev"], x["diff"]) for x in panel.against_last_filled(p, table="t", period="p", row="r", value="v").collect()}
    assert got[3, "r1"] == (1, 3) and got[3, "r2"] == (1, None)
    c = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, None), (4, 4.0)], "o int, v double").withColumn("k", F.lit(1))
    assert [x["flag"] for x in panel.changes(c, by=["k"], order="o", value="v").orderBy("o").collect()] == ["missing", "zero_base", "missing", "missing"]
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0), (3, "e", 2)], "k int, v string, t int")
    merged = upsert.latest_wins(old, new, ["k"], "t")
    assert {(r["k"], r["v"]) for r in merged.collect()} == {(1, "a"), (2, "c"), (3, "e")}
    assert {tuple(r) for r in upsert.latest_wins(merged, new, ["k"], "t").collect()} == {tuple(r) for r in merged.collect()}
    good, bad = upsert.typed(spark.createDataFrame([("1",), ("x",), (None,)], "n string"), {"n": "int"})
    assert good.count() == 2 and bad.first()["bad"] == ["n"]
    with pytest.raises(ValueError):
        upsert.replace_by_key(old, new.drop("k"), ["k"])


def test_bags_keep_counts(spark):
    t = spark.createDataFrame([("g", "a"), ("g", "a"), ("g", None), ("h", "x")], "g string, v string")
    p = spark.createDataFrame([("g", "a"), ("g", None), ("g", "b")], "g string, v string")
    got = {r["g"]: tuple(r)[1:] for r in evaluate.bag_overlap(t, p, by=["g"], fields=["v"]).collect()}
    assert got == {"g": (3, 3, 2), "h": (1, 0, 0)}


def test_lookup(spark):
    n = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "n string, p string")
    assert {(r["node"], r["ancestor"]) for r in lookup.ancestors(n, node="n", parent="p").collect()} == set(itertools.permutations("abc", 2))
    d = spark.createDataFrame([(1, ["x", "q", "y"]), (2, ["q"])], "id int, refs array<string>")
    k = spark.createDataFrame([("x",), ("y",)], "ref string")
    assert [tuple(r) for r in lookup.known_references(d, k, id_col="id", refs_col="refs", ref_key="ref").collect()] == [(1, ["x", "y"])]


def test_fold_across_and_majority(spark):
    d = spark.createDataFrame([(1, 2, "b", ["x"]), (1, 1, "a", ["y", "z"]), (2, 1, "c", [])], "k int, o int, s string, a array<string>")
    assert {tuple(r) for r in map(lambda r: (r["k"], r["s"], tuple(r["a"]), r["n_folded"]), aggregate.fold_across(d, ["k"], order=F.col("o"), arrays=["a"], scalars=["s"]).collect())} == {(1, "a", ("y", "z", "x"), 2), (2, "c", (), 1)}
    m = spark.createDataFrame([("k", 1, "b"), ("k", 2, "a"), ("k", 3, None), ("k", 4, "a"), ("k", 5, "b")], "k string, o int, v string")
    assert tuple(aggregate.majority(m, ["k"], "v", "o").first()) == ("k", "b", 2, 2)


def test_csv_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf\xef\xbb\xbf" + "名,値\n東,1\n".encode())
    (tmp_path / "b.csv").write_bytes("名,値\n西,\n".encode("cp932"))
    (tmp_path / "c.csv").write_bytes(b"x,y\n1,2\n")
    df = readers.read_csv_bytes(spark, str(tmp_path), ["名", "値"])
    assert sorted((r["名"], r["値"], r["line"]) for r in df.collect()) == [("東", "1", 1), ("西", "", 1)]
    assert [r["path"].rsplit("/", 1)[1] for r in readers.unreadable(spark, str(tmp_path), ["名", "値"]).collect()] == ["c.csv"]
    assert readers.newest_file(spark, str(tmp_path), r"\.csv$").count() == 1


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    writers.upsert_table(new, path, ["k"], "t")
    writers.upsert_table(spark.createDataFrame([(2, "c", 2)], "k int, v string, t int"), path, ["k"], "t")
    writers.upsert_table(spark.createDataFrame([(2, "c", 2)], "k int, v string, t int"), path, ["k"], "t")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a", 1), (2, "c", 2)}
    nested = spark.createDataFrame([(1, ("x", ["p", "q"]))], "id int, m struct<a: string, b: array<string>>")
    assert tuple(writers.flattened(nested, "m", "m_").first()) == (1, "x", '["p","q"]')
    assert writers.encodable(spark.createDataFrame([("a",), ("😀",)], "t string"), ["t"], "cp932").count() == 1


def test_judge(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, candidates array<string>")
    got = {r["id"]: (r["decision"], r["choice"]) for r in judge.judged(d, judge.first_candidate, "decision string, choice string", key="id").collect()}
    assert got == {1: ("match", "a"), 2: ("no_match", None), 3: ("no_match", None)}
    whole, again = judge.with_required(judge.judged(d, judge.never, "decision string, choice string", key="id"), ["choice"])
    assert whole.count() == 0 and again.count() == 3


def test_paged_source(spark):
    from tallyloom.sources import paged

    def _pages(unit, token, size):
        if size > unit["most"]:
            raise paged.PayloadTooLarge
        at = int(token or 0)
        rows = [{"unit": unit["name"], "n": i} for i in range(at, min(at + size, unit["total"]))]
        return rows, str(at + size) if at + size < unit["total"] else None

    units = spark.createDataFrame([("a", 230, 30), ("b", 0, 100), ("c", 5, 100)], "name string, total int, most int")
    got = paged.read_paged(units, _pages, "unit string, n int")
    assert {r["unit"]: r["count"] for r in got.groupBy("unit").count().collect()} == {"a": 230, "c": 5} and got.distinct().count() == 235
    with pytest.raises(paged.PayloadTooLarge):
        list(paged.pages({"name": "x", "total": 9, "most": 3}, _pages, 100, 5))
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert paged.with_retry(flaky, sleep=waits.append) == "ok" and len(waits) == 2 and waits[0] < waits[1] * 2


def test_capped_cascade_and_bands(spark):
    from tallyloom.operators import search

    d = spark.createDataFrame([(i, i % 2, i) for i in range(10)], "id int, g int, v int")
    got = {r["id"]: r["reason"] for r in search.capped_cascade(d, [("low", F.col("v") < 2)], group="g", order=[F.desc("v")], per_group=3, total=4).collect()}
    assert got == {0: "low", 1: "low", 2: "over_group", 3: "over_group", 4: "over_total", 5: "over_total", 6: None, 7: None, 8: None, 9: None}
    b = lambda a, c: one(spark, lambda x, y: numbers.best_band(x, y, [("a", 0, 10), ("b", 10, 30)]), a, c, types=["double"] * 2)
    assert b(0.0, 20.0) == "a" and b(9.0, 20.0) == "b" and b(40.0, 50.0) is None


def test_header_search_and_references(spark):
    cells = spark.createDataFrame([("s", 1, 1, "t"), ("s", 2, 1, "k"), ("s", 2, 3, "v"), ("s", 3, 1, "a"), ("s", 3, 3, "1"), ("x", 9, 1, "k"), ("x", 9, 2, "v")], "sheet string, row int, col int, value string")
    assert [tuple(r) for r in readers.sheet_table(cells, sheet="sheet", labels=["k", "v"]).collect()] == [("s", 3, "a", "1")]
    refs = spark.createDataFrame([("s", "A1", "7"), ("s", "A2", "=A1"), ("s", "A3", "=$A$2"), ("s", "A4", "=A4")], "sheet string, ref string, value string")
    assert {r["ref"]: r["value"] for r in readers.resolve_references(refs, sheet="sheet").collect()} == {"A1": "7", "A2": "7", "A3": "7", "A4": None}


def test_swap_survives_a_crash_at_every_point(spark, tmp_path):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(str(p))
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, t int")
    want = {(1, "a"), (2, "c"), (3, "d")}
    for point in range(5):
        p = str(tmp_path / f"t{point}")
        fs = path(p).getFileSystem(conf)
        writers.upsert_table(old, p, ["k"], "t")
        merged = writers.latest_wins(spark.read.parquet(p), new, ["k"], "t")
        if point == 1:  # while the new table is written
            merged.write.parquet(p + ".new")
            fs.delete(path(p + ".new/_SUCCESS"), False)
        if point >= 2:
            merged.write.parquet(p + ".new")
        if point >= 3:  # between the renames
            fs.rename(path(p), path(p + ".old"))
            assert writers.read_table(spark, p).count() == 2
        if point == 4:  # before the old table is dropped
            fs.rename(path(p + ".new"), path(p))
        writers.upsert_table(new, p, ["k"], "t")
        assert {(r["k"], r["v"]) for r in writers.read_table(spark, p).collect()} == want
        assert not fs.exists(path(p + ".old")) and not fs.exists(path(p + ".new"))


def test_verified_append_and_resumable_export(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    p = str(tmp_path / "appended")
    assert writers.append_verified(a, p) == 3 and writers.append_verified(a.limit(1), p) == 1 and spark.read.parquet(p).count() == 4
    u = str(tmp_path / "units")
    assert writers.export_units(a, u, "k") == 2 and writers.export_units(a.withColumn("v", F.lit("y")), u, "k") == 0
    assert writers.export_units(a.unionByName(spark.createDataFrame([(3, "z")], "k int, v string")), u, "k") == 1
    assert sorted(r["v"] or "" for r in spark.read.parquet(u).collect()) == ["", "x", "x", "z"]
    with pytest.raises(ValueError, match="v: 1 rows"):
        writers.encoded(spark.createDataFrame([("x",), ("漢",)], "v string"), ["v"], "ascii")
    assert writers.encoded(a, ["v"], "ascii") is a


def test_scratch_deletes_what_was_cut(spark):
    import os

    from tallyloom import session

    with session.scratch(spark):
        df = session.cut(spark.range(5))
        assert df.count() == 5 and session.cut(df.limit(0)).count() == 0
        files = [f.removeprefix("file:").removeprefix("//") for f in df.inputFiles()]
        assert all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files))


def test_ancestors_of_any_depth(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("x", "n3"), ("y", "y"), ("z", None)]
    n = spark.createDataFrame(chain, "n string, p string")
    got = {(r["node"], r["ancestor"]): r["level"] for r in lookup.ancestors(n, node="n", parent="p").collect()}
    assert got == {(f"n{i}", f"n{j}"): j - i for i in range(40) for j in range(i + 1, 41)} | {("x", f"n{j}"): j - 2 for j in range(3, 41)}
    stop = spark.createDataFrame([("n5",)], "f string")
    got = {(r["node"], r["ancestor"]) for r in lookup.ancestors(n, node="n", parent="p", excluded=stop).collect()}
    assert ("n0", "n5") in got and ("n0", "n6") not in got and ("n5", "n6") not in got and ("n6", "n40") in got
    assert lookup.ancestors(n.limit(0), node="n", parent="p").count() == 0


def test_two_pools(spark):
    df, a, b = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string"), spark.createDataFrame([("a", 2), ("a", 1), (None, 9)], "k string, v int"), spark.createDataFrame([("a", 0), ("b", 3)], "k string, v int")
    assert {tuple(r) for r in lookup.in_two_pools(df, a, b, key="k", value="v").collect()} == {("a", 1, "first"), ("b", 3, "second"), ("c", None, None), (None, None, None)}


def test_similarity_join_equals_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("aab cd", k=rng.randrange(1, 12))).strip() or "a"
    a, b = list({word() for _ in range(60)}), list({word() for _ in range(60)})
    da, db = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    for cutoff in (0.5, 0.8):
        got = {(r["a"], r["b"]) for r in matching.fuzzy_match(da, db, left_col="a", right_col="b", cutoff=cutoff).collect()}
        assert got == {(x, y) for x in a for y in b if matching.similarity(x, y) >= cutoff}
    near = {r["a"]: r["b"] for r in matching.closest_match(da, db, left_col="a", right_col="b").collect()}
    for x in a:
        best = max(((matching.similarity(x, y), y) for y in b), default=None)
        assert near.get(x) == (best[1] if best[0] >= 0.5 else None)


def test_containment_equals_nested_loop_on_shared_beginnings(spark):
    rng = random.Random(13)
    texts = ["株式会社" + "".join(rng.choices("北南東西", k=rng.randrange(1, 5))) for _ in range(50)] + ["ab", "a", None, ""]
    needles = ["株式会社" + "".join(rng.choices("北南東西", k=rng.randrange(0, 3))) for _ in range(30)] + ["a", "北", "会社", None]
    got = {tuple(r) for r in matching.contains_pairs(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(n,) for n in needles], "n string"), text="t", needle="n").collect()}
    assert got == {(t, n) for t in texts if t for n in needles if n and n in t}


def test_greedy_choice_streams_after_its_rounds(spark):
    chain = [("g", f"l{i}", f"r{i + d}", 1000.0 - 2 * i - d) for i in range(60) for d in (0, 1)]
    rng = random.Random(14)
    pairs = chain + [("h", f"l{rng.randrange(20)}", f"r{rng.randrange(20)}", float(rng.randrange(30))) for _ in range(200)]
    pairs = list({p[:3]: p for p in pairs}.values())

    def greedy(rows):
        ul, ur, out = set(), set(), set()
        for g, x, y, s in sorted(rows, key=lambda p: (p[3], p[1], p[2]), reverse=True):
            if (g, x) not in ul and (g, y) not in ur:
                ul.add((g, x))
                ur.add((g, y))
                out.add((g, x, y))
        return out

    df = spark.createDataFrame(pairs, "g string, l string, r string, s double")
    for fit in (matching.FIT, 0):
        small = df if fit else df.where("g = 'h'")
        got = {(r["g"], r["l"], r["r"]) for r in matching.greedy_assign(small, by="g", left="l", right="r", score="s", rounds=2, fit=fit).collect()}
        assert got == greedy(p for p in pairs if fit or p[0] == "h")
    assert matching.greedy_assign(df.limit(0), by="g", left="l", right="r", score="s").count() == 0


def test_vendor_candidates_equal_brute_force(spark):
    from datetime import timedelta

    rng = random.Random(15)
    names = ["north gas", "north gas east", "south gas", "west", "", None, "midori", "hikari gas"]
    day = lambda: None if rng.random() < 0.2 else date(2024, 1, 1) + timedelta(days=rng.randrange(60))
    left = [(f"l{i:02d}", rng.choice([*names, "nobody", "gas n"]), day()) for i in range(40)]
    right = [(f"r{i:02d}", rng.choice(names), day()) for i in range(50)]
    want = set()
    for i, n, d in left:
        gap = lambda e, d=d: None if d is None or e is None else abs((d - e).days)
        hit = [(j, gap(e), "vendor") for j, m, e in right if n and m and (n in m or m in n) and (gap(e) is None or gap(e) <= 10)]
        if not hit and d is not None:
            near = sorted((gap(e), -matching.similarity(n, m), j) for j, m, e in right if gap(e) is not None and gap(e) <= 10)[:4]
            hit = [(j, g, "fallback") for g, _, j in near]
        want |= {(i, *h) for h in hit}
    got = matching.vendor_candidates(
        spark.createDataFrame(left, "l string, n string, d date"), spark.createDataFrame(right, "r string, n string, d date"), left_id="l", right_id="r", name="n", date="d", days=10, top=4
    )
    assert {tuple(r) for r in got.collect()} == want
