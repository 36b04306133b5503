"""Packed fields: segmentation, odd inputs and brute force."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from tallyloom.operators import packed

SCHEMA = "_id bigint, sender string, name string, cc_bcc string, links array<string>"
KINDS = {"sender": "address", "name": "name", "cc_bcc": "address", "links": "link"}


def _learn():
    names = ["Anna Hill", "Robert Stone", "Berta Lake", "Carl Wood"]
    rows = [(1000 + i, None, names[i % 4], None, None) for i in range(80)]
    rows += [(2000 + i, None, f"{names[i % 4]}; {names[(i + 1) % 4]}", None, [f"https://a.test/d/{i:016x}/view"]) for i in range(40)]
    rows += [(3000 + i, None, f"{'Hill Stone Lake Wood'.split()[i % 4]}, {'Anna Robert Berta Carl'.split()[i % 4]}", None, None) for i in range(20)]
    rows += [(4000 + i, None, "North Lift & Boiler Works Ltd", None, None) for i in range(10)]
    return rows


def test_packed_values(spark):
    rows = [
        (1, '"Hill, Anna" <a@x.test>; b@x.test\n', "Anna Hill, Robert Stone", "a@x.test,\n<B@x.test>;; c@x.test ; ", ["https://a.test/rows?ids=1,2&t=3.html; <notes/in/1.md>", "https://a.test/s/1;v=2/page.html"]),
        (2, "<mailto:a@x.test|a@x.test>", "Hill, Anna", '"Hill, Anna" <a@x.test>', ["https://a.test/s/1;v=2/page.html"]),
        (3, "a@x.test\tb@x.test", "\"Hill, Anna\" / 'Stone Robert'／Berta Lake", None, []),
        (4, None, "Anna Hill & Robert Stone", "", None), (5, " ; ; ", "North Lift & Boiler Works Ltd | Carl Wood", ";a@x.test;", ["", None]),
        (6, "Anna Hill; a@x.test", "Anna Hill and Carl Wood\nHill, Anna", "x", ["notes/a/1.md\nnotes/a/2.md"]),
    ]
    df = spark.createDataFrame(_learn() + rows + rows[:1], SCHEMA).withColumn("value", F.lit("clash")).withColumn("id", F.lit(7))
    got = {}
    for r in packed.packed_values(df, id_col="_id", fields=KINDS).where("_id < 100").orderBy("_id", "field", "pos").collect():
        got.setdefault((r["_id"], r["field"]), []).append(r["value"])
    assert got == {
        (1, "sender"): ["a@x.test", "b@x.test"], (1, "name"): ["Anna Hill", "Robert Stone"], (1, "cc_bcc"): ["a@x.test", "B@x.test", "c@x.test"],
        (1, "links"): ["https://a.test/rows?ids=1,2&t=3.html", "notes/in/1.md", "https://a.test/s/1;v=2/page.html"],
        (3, "sender"): ["a@x.test", "b@x.test"], (3, "name"): ["Hill, Anna", "Stone Robert", "Berta Lake"], (4, "name"): ["Anna Hill", "Robert Stone"], (5, "name"): ["North Lift & Boiler Works Ltd", "Carl Wood"],
        (6, "sender"): ["Anna Hill", "a@x.test"], (6, "name"): ["Anna Hill", "Carl Wood", "Hill, Anna"], (6, "links"): ["notes/a/1.md", "notes/a/2.md"],
    }
    single = packed.all_values(df, id_col="_id", fields={"name": "name"}).where("_id = 2").collect()
    assert [(r["pos"], r["value"]) for r in single] == [(1, "Hill, Anna")]


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packed.packed_values(empty, id_col="_id", fields=KINDS).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None), (None, None, "A B; C D", None, None)], SCHEMA)
    got = [tuple(r) for r in packed.packed_values(nulls, id_col="_id", fields=KINDS).orderBy("pos").collect()]
    assert got == [(None, "name", 1, "A B"), (None, "name", 2, "C D")]
    assert packed.packed_values(spark.createDataFrame([(1, None, "A B; " * 20000, None, None)], SCHEMA), id_col="_id", fields=KINDS).count() == 20000


def _paths(n):
    for cuts in itertools.product([0, 1], repeat=n - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), n]
        spans = list(zip(at, at[1:], strict=False))
        if all(j - i <= packed.MAX_JOIN for i, j in spans):
            yield spans


def test_viterbi_and_posteriors_equal_brute_force():
    run = ["A B", ", ", "C", ", ", "D E", " & ", "F"]
    value = {(i, j): packed.span_text(run, i, j) for i, j in packed.spans(run)}
    edges = [{"i": i, "j": j, "words": len(packed.shape(v, "name").replace(",", "").replace("&", "").split()), "c": float(len(v) % 4), "s": float((i + j) % 3)} for (i, j), v in value.items()]
    total = (50.0, 5.0)
    p = {(e["i"], e["j"]): math.exp(x) for by in packed._score(edges, total).values() for i, x, e in by}
    weight = {tuple(path): math.prod(p[s] for s in path) for path in _paths(4)}
    best = max(weight, key=lambda k: (weight[k], -len(k)))
    assert packed.best_path(edges, total) == list(best)
    z = sum(weight.values())
    for e, x in zip(edges, packed.expected(edges, total), strict=True):
        assert math.isclose(x, sum(w for k, w in weight.items() if (e["i"], e["j"]) in k) / z, rel_tol=1e-9)


def test_a_value_of_many_atoms(spark):
    firm = "Adams, Baker, Cole & Dunn LLP"
    rows = [(i, None, f'"{firm}"; Anna Hill', None, None) for i in range(10)] + [(100, None, f"{firm}, Robert Stone", None, None), (101, None, firm, None, None)]
    got = {}
    for r in packed.packed_values(spark.createDataFrame(_learn() + rows, SCHEMA), id_col="_id", fields={"name": "name"}).where("_id in (1, 100, 101)").orderBy("_id", "pos").collect():
        got.setdefault(r["_id"], []).append(r["value"])
    assert got == {1: [firm, "Anna Hill"], 100: [firm, "Robert Stone"]}
    assert (0, 30) in packed.spans(["A", ", "] * 30) and (3, 3 + packed.MAX_JOIN) in packed.spans(["A", ", "] * 30)


def test_long_open_runs(spark):
    names = [f"Anna{chr(65 + i % 26)} Hill{chr(65 + i // 26)}" for i in range(400)]
    df = spark.createDataFrame([*_learn(), (1, None, ", ".join(names), None, None), (2, None, "&".join(["x"] * 9000), None, None)], SCHEMA)
    got = [r["value"] for r in packed.packed_values(df, id_col="_id", fields={"name": "name"}).where("_id < 10").orderBy("pos").collect()]
    assert got == names


def test_long_values_without_edges_equal_brute_force(monkeypatch):
    monkeypatch.setattr(packed, "MAX_JOIN", 2)
    total = (50.0, 5.0)
    for kind, run in (("name", ["A B", ", ", "c", ", ", "D E", " & ", "F", ", ", "g h", ", ", "I"]), ("link", ["http://a/1", ",", "2", ",", "3", ";", "x/4", ",", "5", ",", "6"])):

        def edge(i, j, known=True, kind=kind, run=run):
            v = packed.span_text(run, i, j)
            s = 0.7 * (len(packed.span_text(run, i, i + 1)) % 3) if kind == "link" else 0.4 * ((i + j) % 3) * known
            return {"i": i, "j": j, "words": packed._counted(v, kind)[2], "c": (len(v) % 4) / 9 if known else 0.0, "s": s}

        n = (len(run) + 1) // 2
        short = {*packed.spans(run), (1, 5)}
        edges = [edge(*x) for x in sorted(short)]
        full = edges + [edge(i, j, False) for i in range(n) for j in range(i + 1, n + 1) if (i, j) not in short]
        p = {(e["i"], e["j"]): math.exp(x) for by in packed._score(full, total).values() for i, x, e in by}
        at = [[0, *(i + 1 for i, c in enumerate(cuts) if c), n] for cuts in itertools.product([0, 1], repeat=n - 1)]
        weight = {tuple(zip(a, a[1:], strict=False)): 0.0 for a in at}
        weight = {path: math.prod(p[s] for s in path) for path in weight}
        z = sum(weight.values())
        true = {s: sum(w for path, w in weight.items() if s in path) / z for s in p}
        assert packed.best_path(edges, total, kind) == list(max(weight, key=lambda k: (weight[k], -len(k))))
        found, others = packed.posteriors(edges, total, kind, 1e-300)
        got = {(e["i"], e["j"]): x for e, x in zip(edges, found, strict=True)} | {(i, j): x for i, j, x in others}
        assert got.keys() == true.keys() and all(math.isclose(got[s], true[s], rel_tol=1e-6) for s in true)
        # the best path may have a long value without an edge
        for e in edges:
            e["c"], e["s"] = (1e6 if (e["i"], e["j"]) in {(0, 1), (5, 6)} else 0.0), 0.0
        assert packed.best_path([e for e in edges if (e["i"], e["j"]) != (1, 5)], (5e6, 5.0), kind) == [(0, 1), (1, 5), (5, 6)]


def test_values_of_more_atoms_than_edges(spark):
    names = "Adams Baker Cole Dunn Evans Frost Grant Hayes Irwin Jones Keane Lewis Moore North Olsen".split()
    firm, other = (", ".join(x[:-1]) + f" & {x[-1]} LLP" for x in (names, [n + "by" for n in names]))
    rows = [(i, None, f'"{firm}"; Anna Hill', None, None) for i in range(10)]
    rows += [(100, None, f"{firm}, Robert Stone", None, None), (101, None, f"Anna Hill, {firm.upper()}, Robert Stone", None, None), (102, None, f"Berta Lake, {other}, Carl Wood", None, None)]
    got = {}
    for r in packed.packed_values(spark.createDataFrame(_learn() + rows, SCHEMA), id_col="_id", fields={"name": "name"}).where("_id between 100 and 102").orderBy("_id", "pos").collect():
        got.setdefault(r["_id"], []).append(r["value"])
    assert got == {100: [firm, "Robert Stone"], 101: ["Anna Hill", firm.upper(), "Robert Stone"], 102: ["Berta Lake", other, "Carl Wood"]}


def test_long_values_are_found_by_their_start():
    starts = {packed.heads(x, "name") for x in ("“" + ", ".join("ABCDEFGHIJKLM"), ", ".join("abcdefghijklmnop"))}
    assert len({key for key, _ in starts}) == 1


def test_every_cell_that_python_cuts_is_cut(spark):
    rows = [
        (1, "<a@x.test><b@x.test>", "Anna Hill　and　Carl Wood", "a@x.test　b@x.test", ["https://a.test/1　https://a.test/2"]),
        (2, "a@x.test\x85b@x.test", "Anna Hill\xa0&\xa0Carl Wood", "a@x.test", ["https://a.test/1"]),
    ]
    got = {}
    for r in packed.packed_values(spark.createDataFrame(_learn() + rows, SCHEMA), id_col="_id", fields=KINDS).where("_id < 10").orderBy("_id", "field", "pos").collect():
        got.setdefault((r["_id"], r["field"]), []).append(r["value"])
    two, people = ["a@x.test", "b@x.test"], ["Anna Hill", "Carl Wood"]
    assert got == {(1, "sender"): two, (1, "name"): people, (1, "cc_bcc"): two, (1, "links"): ["https://a.test/1", "https://a.test/2"], (2, "sender"): two, (2, "name"): people}


def test_links_and_addresses_that_stand_alone_count(spark):
    rows = [(i, f"Lift {'AB'[i % 2]} <{'ab'[i % 2]}@x.test>", None, None, [f"notes/{'ab'[i % 2]}.md"]) for i in range(100, 140)] + [(1, None, None, None, ["notes/a.md,notes/b.md"])]
    got = [tuple(r) for r in packed.packed_values(spark.createDataFrame(rows, SCHEMA), id_col="_id", fields=KINDS).collect()]
    assert sorted(got) == [(1, "links", 1, "notes/a.md"), (1, "links", 2, "notes/b.md")]
