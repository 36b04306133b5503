"""Several values packed in one field: one row per value, with its position.

Method: expectation-maximisation segmentation with Viterbi lattices. A cell is cut
into atoms at every possible delimiter; quoted spans and angle brackets are atomic.
Some delimiters always end a value, others (a comma, an ampersand) may also stand
inside one: "Surname, Given", "Lift & Boiler Works". A run of atoms joined by such
open delimiters is a lattice. The frequencies of values, and of their word shapes
as the back-off for rare ones, are learned from the whole column: values that stand
alone count at once, those in lattices by their expected counts, over a few rounds
of expectation and maximisation. The most probable path through each distinct
lattice gives the values.

A value may span any number of atoms. The spans of a run are quadratic in its length, so
those of more than ``MAX_JOIN`` atoms get an edge only if their value or shape stands alone
somewhere or counts in some run; the others differ by terms that add up over the atoms, and
running sums and maxima take them all in linear time.

Scale: cells are cut in the executors, equal runs are counted with map-side combine
before anything else, and only distinct open runs enter the lattice joins, in which
16-byte digests stand for runs, values and shapes. Nothing
but the number of values of each field (one row a field) comes to the driver. A run
that fills a third of all rows is one row of the lattice tables; the join back lets
AQE broadcast the small side or split the hot key.

Defined cases: null, empty and blank cells and empty entries have no value; a quote
that never closes is an ordinary character; equal cells give equal values; an empty
table gives an empty result. ``id_col`` identifies a row: repeated rows of one id
count once, a null id stays null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

#: Atoms up to which every candidate value of a run has an edge of its own. A longer one has an edge only once it,
#: or its shape, counts elsewhere; all others have the probability of a value never seen, summed in closed form.
MAX_JOIN = 12
#: Less is no count.
LEAST = 1e-9
#: Expected number of a long value in a run from which on it is known to the others: since the values that hold an
#: atom share a probability of one, edges stay linear in the length of a run.
LONG = 0.01
#: Typical probability of a word, for values never seen.
WORD = 0.01
#: Count every shape has from the start; less for each atom beyond the second.
SHAPE_PRIOR, LONGER = 0.05, 0.01
ROUNDS = 3

# Legal forms of organisations.
LEGAL = {"ltd", "limited", "inc", "incorporated", "llc", "l.l.c", "llp", "lp", "gmbh", "k.k", "kk", "corp", "co", "plc", "ag", "s.a", "株式会社", "有限会社"}

_QUOTED = r"\"[^\"]*\"|(?<![^\s;,|/、／&])'[^'\n]*'(?![^\s;,|/、／&])|<[^<>]*>"
_CUT = {
    "name": re.compile(_QUOTED + r"|(\s*[;,|、／/\n\t]+(?:[\s;,|、／/]*)|\s+(?:&|and)\s+)"),
    "address": re.compile(_QUOTED + r"|(\s*[;,|、\n\t]+[\s;,|、]*)"),
    "link": re.compile(_QUOTED + r"|([\s,;|]+)"),
}
_HARD = {"name": re.compile(r"[;|、／/\n\t]|,\s*,"), "address": re.compile(r"[;|、\n\t]|,\s*,"), "link": re.compile(r"[\s|]|[,;]{2}")}
# Blanks of Python's \s for the regular expressions of the JVM, whose \s is ASCII.
_S = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a cell must hold for more than one atom or address; the rest never reaches Python.
_OPEN = {"name": rf"[;,|、／/\n\t]|[{_S}](&|and)[{_S}]", "address": r"(?s)[;,|、\n\t]|@.*@", "link": rf"[{_S},;|]"}
_WHOLE_QUOTE = re.compile(r"\"[^\"]*\"|'[^'\n]*'")
_ADDRESS = re.compile(r"(?<![\w.\-])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+")
_HEAD = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*(?:://|/)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
#: Joins the atoms and delimiters of a run to its key.
_SEP = "\x1f"


def atoms(cell: str | None, kind: str) -> list[list[str]]:
    """Runs of a cell; a run is [atom, delimiter, atom, ...] with open delimiters only."""
    runs: list[list[str]] = []
    run: list[str] = []
    at = 0
    open_ = None
    for m in [*_CUT[kind].finditer(cell or ""), None]:
        if m is not None and m[1] is None:
            continue
        atom = (cell or "")[at : m.start() if m else None].strip()
        if atom:
            if run and open_ is not None:
                run += [open_, atom]
            else:
                if run:
                    runs.append(run)
                run = [atom]
            open_ = None
        if m is None:
            break
        at = m.end()
        hard = _HARD[kind].search(m[1]) or not run
        if not hard and (_WHOLE_QUOTE.fullmatch(run[-1]) or cell[at : at + 1] in "\"'"):
            hard = kind == "name"  # a quoted span is a value of its own
        if not hard and kind == "address":
            hard = "@" in run[-1]  # an entry is complete with its address
        if not hard and kind == "link" and _HEAD.match(cell[at : at + 40].lstrip("\"'<")):
            hard = bool(re.match(r"[\"'<]", cell[at : at + 1]))
        if hard:
            if run:
                runs.append(run)
            run, open_ = [], None
        else:
            open_ = m[1]
    if run:
        runs.append(run)
    return runs


def bare(value: str) -> str:
    """``value`` without outer blanks and enclosing quotes or angle brackets."""
    v = value.strip()
    while len(v) > 1 and (v[0] + v[-1] in ('""', "''", "<>", "“”")):
        v = v[1:-1].strip()
    return v


def shape(value: str, kind: str) -> str:
    """Word shape of a value: a small alphabet for the back-off probabilities."""
    if kind == "link":
        v = value.strip("\"'<> ")
        m = _HEAD.match(v)
        return ("u:" + m[0]) if m else "x"
    v = _ADDRESS.sub("@", value).strip("\"' ")
    out = []
    for w in re.findall(r"[^\s,&]+|[,&]", v):
        c = w.strip(".\"'<>")
        if w in ",&@" or c == "@":
            out.append(c or w)
        elif c.lower() == "and":
            out.append("&")
        elif c.lower() in LEGAL:
            out.append("L")
        elif w[0] == "(":
            out.append("P")
        elif _CJK.search(c):
            out.append("J")
        elif len(c) == 1:
            out.append("I")
        else:
            out.append("C" if c[:1].isupper() else "h")
    return " ".join(out)


def key(value: str) -> str:
    """Key under which a value is counted."""
    return " ".join(bare(value).casefold().split())


def digest(text: str) -> bytes:
    """Stands for a text of any length in the joins."""
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).digest()


def spans(run: list[str]) -> list[tuple[int, int]]:
    """Candidate values of a run with an edge from the start: (first atom, end atom)."""
    n = (len(run) + 1) // 2
    return [(i, j) for i in range(n) for j in range(i + 1, min(n, i + MAX_JOIN) + 1)] + ([(0, n)] if n > MAX_JOIN else [])


def span_text(run: list[str], i: int, j: int) -> str:
    return "".join(run[2 * i : 2 * j - 1])


def _log_sum(x: float, log_y: float) -> float:
    """Log of ``x`` plus the number of which ``log_y`` is the log."""
    if x <= 0:
        return log_y
    hi, lo = max(math.log(x), log_y), min(math.log(x), log_y)
    return hi + math.log1p(math.exp(lo - hi))


def _score(edges: list[dict], total: tuple[float, float]) -> dict[int, list[tuple[int, float, dict]]]:
    """Edges with their log probabilities by end; an unseen value gets what the values seen once tell (Good-Turing)."""
    by_end: dict[int, list[tuple[int, float, dict]]] = {}
    n, once = total
    for e in edges:
        words = e["words"]
        # in logarithms, since a whole run may be a value of thousands of words
        form = _log_sum(e["s"] or 0.0, math.log(SHAPE_PRIOR) + math.log(LONGER) * max(0, e["j"] - e["i"] - 2))
        p = _log_sum(e["c"] or 0.0, math.log(once) + form - math.log(n + 1) + math.log(WORD) * words) - math.log(n + once)
        by_end.setdefault(e["j"], []).append((e["i"], p, e))
    return by_end


class _Long:
    """Candidate values of more than ``MAX_JOIN`` atoms without evidence: those from i to j have the log
    probability ``flat[i]`` or, for their shape's prior, ``base + slope[j] - slope[i]``, whichever adds more."""

    def __init__(self, edges: list[dict], total: tuple[float, float], kind: str, n: int):
        seen, once = total
        one = {e["i"]: e for e in edges if e["j"] == e["i"] + 1}
        rest = math.log(once) - math.log(seen + 1) - math.log(seen + once)
        self.base = rest + math.log(SHAPE_PRIOR) - 2 * math.log(LONGER)
        self.slope, self.flat = [0.0], []
        link = kind == "link"
        if link:  # a link is one word, and has the shape of its first atom
            self.base += math.log(WORD)
        for i in range(n):
            self.slope.append(self.slope[-1] + math.log(LONGER) + (0.0 if link else math.log(WORD) * one[i]["words"]))
            s = one[i]["s"] if link else 0.0
            self.flat.append(rest + math.log(WORD) + math.log(s) if s else -math.inf)

    def log_p(self, i: int, j: int) -> float:
        return _add(self.base + self.slope[j] - self.slope[i], self.flat[i])


def _add(a: float, b: float) -> float:
    """Log of the sum of two numbers given by their logs."""
    hi, lo = max(a, b), min(a, b)
    return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))


def best_path(edges: list[dict], total: tuple[float, float], kind: str = "name") -> list[tuple[int, int]]:
    """Viterbi: (first atom, end atom) of the most probable segmentation; ties go to fewer values."""
    by_end = _score(edges, total)
    n = max(by_end)
    long = _Long(edges, total, kind, n) if n > MAX_JOIN else None
    best: list[tuple[float, int]] = [(0.0, 0)]
    back: list[int] = [0]
    sloped = flat = (-math.inf, 0, 0)  # best starts of long values: score without what the end adds, parts, atom
    for j in range(1, n + 1):
        paths = [(best[i][0] + p, best[i][1] - 1, i) for i, p, _ in by_end[j]]
        if j > MAX_JOIN:
            i = j - MAX_JOIN - 1
            sloped = max(sloped, (best[i][0] - long.slope[i], best[i][1], i), key=lambda x: x[:2])
            flat = max(flat, (best[i][0] + long.flat[i], best[i][1], i), key=lambda x: x[:2])
            paths += [(sloped[0] + long.base + long.slope[j], sloped[1] - 1, sloped[2]), (flat[0], flat[1] - 1, flat[2])]
        score, parts, i = max(paths, key=lambda x: x[:2])
        best.append((score, parts))
        back.append(i)
    out, j = [], n
    while j:
        out.append((back[j], j))
        j = back[j]
    return out[::-1]


def expected(edges: list[dict], total: tuple[float, float], kind: str = "name") -> list[float]:
    """Forward-backward: posterior probability of each candidate value, in the order of ``edges``."""
    return posteriors(edges, total, kind)[0]


def posteriors(edges: list[dict], total: tuple[float, float], kind: str, least: float = LONG) -> tuple[list[float], Iterator[tuple[int, int, float]]]:
    """:func:`expected`, and (first atom, end atom, posterior) of the values without an edge above ``least``."""
    by_end = _score(edges, total)
    n = max(by_end)
    long = _Long(edges, total, kind, n) if n > MAX_JOIN else None
    ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]

    def beyond(i: int, j: int, p: float) -> float:
        """What an edge adds to the sums of all long values, in which it is already taken for unseen."""
        if j - i <= MAX_JOIN:
            return p
        u = long.log_p(i, j)
        return p + math.log1p(-math.exp(u - p)) if u < p else -math.inf

    steps = {j: [(i, beyond(i, j, p)) for i, p, _ in by_end[j]] for j in by_end}
    sloped = flat = -math.inf
    for j in range(1, n + 1):
        for i, p in steps[j]:
            ahead[j] = _add(ahead[j], ahead[i] + p)
        if j > MAX_JOIN:
            i = j - MAX_JOIN - 1
            sloped, flat = _add(sloped, ahead[i] - long.slope[i]), _add(flat, ahead[i] + long.flat[i])
            ahead[j] = _add(ahead[j], _add(sloped + long.base + long.slope[j], flat))
    sloped = flat = -math.inf
    for j in range(n, 0, -1):
        if j + MAX_JOIN < n:
            k = j + MAX_JOIN + 1
            sloped, flat = _add(sloped, behind[k] + long.slope[k]), _add(flat, behind[k])
            behind[j] = _add(behind[j], _add(sloped + long.base - long.slope[j], flat + long.flat[j]))
        for i, p in steps[j]:
            behind[i] = _add(behind[i], behind[j] + p)
    found = {id(e): math.exp(min(0.0, ahead[i] + p + behind[j] - ahead[n])) for j in by_end for i, p, e in by_end[j]}

    def others() -> Iterator[tuple[int, int, float]]:
        if long is None:
            return
        known = {(e["i"], e["j"]) for e in edges}
        slope, tail = np.array(long.slope), np.array(behind) - ahead[n]
        top, top_flat = (np.maximum.accumulate(x[::-1])[::-1] for x in (slope + tail, tail))
        for i in range(n - MAX_JOIN):
            j0 = i + MAX_JOIN + 1
            if max(long.base - slope[i] + top[j0], long.flat[i] + top_flat[j0]) + ahead[i] < math.log(least / 2):
                continue
            p = np.logaddexp(long.base + slope[j0:] - slope[i], long.flat[i]) + ahead[i] + tail[j0:]
            for k in np.nonzero(p > math.log(least))[0].tolist():
                if (i, j0 + k) not in known:
                    yield i, j0 + k, math.exp(min(0.0, float(p[k])))

    return [found[id(e)] for e in edges], others()


def _parse(cells: DataFrame) -> DataFrame:
    """(rid, kind, cell) to (rid, kind, runs array<string>) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column(1).to_pylist()
            runs = [[_SEP.join(r) for r in atoms(c, k)] for c, k in zip(b.column(2).to_pylist(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(runs, pa.list_(pa.string()))], names=["rid", "kind", "runs"])

    return cells.mapInArrow(run, "rid string, kind string, runs array<string>")


def heads(start: str, kind: str) -> tuple[bytes, bytes]:
    """Digests by which values of more than ``MAX_JOIN`` atoms are found: of the first signs, and of the first
    words of the shape. ``start``: a value's first ``MAX_JOIN`` + 1 atoms at least."""
    signs = " ".join(start.casefold().split()).lstrip("\"'<“ ")[: 2 * MAX_JOIN - 4]
    return digest(signs), digest(" ".join(shape(start, kind).split()[:MAX_JOIN]))


def _with_shape(values: DataFrame) -> DataFrame:
    """Distinct values (kind, value, n) to (kind, key, shape, n, size, key_head, shape_head).

    ``key`` and ``shape`` are digests. ``size``: atoms of a value that a run would cut into more than
    ``MAX_JOIN``, with its :func:`heads`; else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                long = [None, None, None]
                if sum(map(t.count, (",", ";", "&", "and"))) >= MAX_JOIN:
                    runs = atoms(bare(t), k)
                    if len(runs) == 1 and len(runs[0]) > 2 * MAX_JOIN:
                        long = [(len(runs[0]) + 1) // 2, *heads(bare(t), k)]
                for c, x in zip(out, (digest(key(t)), digest(shape(t, k)), *long), strict=True):
                    c.append(x)
            types = (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            keys, shapes, *rest = (pa.array(c, t) for c, t in zip(out, types, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), keys, shapes, b.column(2), *rest], names=["kind", "key", "shape", "n", "size", "key_head", "shape_head"])

    return values.mapInArrow(run, "kind string, key binary, shape binary, n double, size int, key_head binary, shape_head binary")


_EDGE = "kind string, run binary, n double, i int, j int, key binary, shape binary, words int, p double"
_EDGE_NAMES = [c.split(" ")[0] for c in _EDGE.split(", ")]
_EDGE_TYPES = [pa.string(), pa.binary(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.float64()]


def _edge_batch(columns: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _EDGE_TYPES, strict=True)], names=_EDGE_NAMES)


def _counted(value: str, kind: str) -> tuple[bytes, bytes, int]:
    """Digests of the key and the shape of a value, and its number of words."""
    form = shape(value, kind)
    return digest(key(value)), digest(form), len(form.replace(",", "").replace("&", "").split())


def _edges(runs: DataFrame) -> DataFrame:
    """Distinct open runs (kind, run, text, n) to their candidate values, each with posterior 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = tuple([] for _ in _EDGE_NAMES)
            for k, r, text, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                run_ = text.split(_SEP)
                for i, j in spans(run_):
                    v = span_text(run_, i, j)
                    for c, x in zip(out, (k, r, n, i, j, *_counted(v, k), 0.0), strict=True):
                        c.append(x)
                if len(out[0]) > 50_000:
                    yield _edge_batch(out)
                    out = tuple([] for _ in _EDGE_NAMES)
            yield _edge_batch(out)

    return runs.select("kind", "run", "text", "n").mapInArrow(run, _EDGE)


def _lattices(edges: DataFrame, alone: DataFrame, alone_shapes: DataFrame) -> DataFrame:
    """One row per distinct open run with its edges, their counts c and shape counts s.

    Of shapes each distinct run counts once. :func:`left_out` takes off both what the
    run itself contributed.
    """
    hopes = edges.groupBy("kind", "key").agg(F.sum(F.col("p") * F.col("n")).alias("hope"))
    shapes = edges.groupBy("kind", "shape").agg(F.sum("p").alias("hope_s")).join(alone_shapes, ["kind", "shape"], "left")
    shapes = shapes.select("kind", "shape", (F.col("hope_s") + F.coalesce("n", F.lit(0.0))).alias("s"))
    values = hopes.join(alone.select("kind", "key", F.col("n").alias("c0")), ["kind", "key"], "left")
    return (
        edges.join(values, ["kind", "key"])
        .join(shapes, ["kind", "shape"])
        .groupBy("kind", "run")
        .agg(F.first("n").alias("n"), F.collect_list(F.struct("i", "j", "key", "shape", "words", "p", (F.coalesce("c0", F.lit(0.0)) + F.col("hope")).alias("c"), "s")).alias("edges"))
    )


def left_out(edges: list[dict], n: float) -> list[dict]:
    """Edges without what their run contributed to their counts in the round before: else every
    rare run would be explained best by itself."""
    own_key: dict[bytes, float] = {}
    own_shape: dict[bytes, float] = {}
    for e in edges:
        own_key[e["key"]] = own_key.get(e["key"], 0.0) + e["p"]
        own_shape[e["shape"]] = own_shape.get(e["shape"], 0.0) + e["p"]
    for e in edges:
        e["c"] = max(0.0, e["c"] - own_key[e["key"]] * n)
        e["s"] = max(0.0, e["s"] - own_shape[e["shape"]])
        # what is left of sums that cancel is no count
        e["c"], e["s"] = (x if x > LEAST else 0.0 for x in (e["c"], e["s"]))
    return edges


_WANTED = "array<struct<i:int,j:int,p:double,key:binary,shape:binary>>"


def _long_edges(wanted: DataFrame, long_runs: DataFrame) -> DataFrame:
    """Edges of the wanted spans (run, i, j, p, key, shape), each once; where a key or shape is given, only if it is the span's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = tuple([] for _ in _EDGE_NAMES)
            for r in b.to_pylist():
                run_ = r["text"].split(_SEP)
                done = set()
                for w in r["wanted"]:
                    i, j = w["i"], w["j"]
                    if (i, j) in done or 2 * j - 1 > len(run_):
                        continue
                    k, form, words = _counted(span_text(run_, i, j), r["kind"])
                    if w["key"] in (None, k) and w["shape"] in (None, form):
                        done.add((i, j))
                        for c, x in zip(out, (r["kind"], r["run"], r["n"], i, j, k, form, words, w["p"]), strict=True):
                            c.append(x)
            yield _edge_batch(out)

    each = wanted.groupBy("run").agg(F.collect_set(F.struct("i", "j", "p", "key", "shape")).cast(_WANTED).alias("wanted"))
    return long_runs.join(each, "run").select("kind", "run", "n", "text", "wanted").mapInArrow(run, _EDGE)


def _starts(long_runs: DataFrame) -> DataFrame:
    """(kind, run, i, key_head, shape_head) of every atom at which a long value may begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for k, r, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                run_ = text.split(_SEP)
                for i in range((len(run_) + 1) // 2 - MAX_JOIN):
                    for c, x in zip(out, (k, r, i, *heads(span_text(run_, i, i + MAX_JOIN + 1), k)), strict=True):
                        c.append(x)
            types = (pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["kind", "run", "i", "key_head", "shape_head"])

    return long_runs.select("kind", "run", "text").mapInArrow(run, "kind string, run binary, i int, key_head binary, shape_head binary")


def _spread(edges: DataFrame, long_runs: DataFrame, starts: DataFrame, alone: DataFrame) -> DataFrame:
    """``edges`` and those of the long spans whose value or shape stands alone or counts in some run."""
    size = (F.col("j") - F.col("i")).alias("size")
    counts = edges.where((F.col("j") - F.col("i") > MAX_JOIN) & (F.col("p") * F.greatest("n", F.lit(1.0)) > LONG))
    known = counts.join(starts, ["kind", "run", "i"]).select("kind", "key", "shape", size, "key_head", "shape_head")
    known = known.unionByName(alone.where("size is not null").select(*known.columns))
    none = F.lit(None).cast("binary")
    by_key = starts.join(known.select("kind", "key_head", "key", "size").distinct(), ["kind", "key_head"]).withColumn("shape", none)
    # the shape of a link is that of its first atom, whatever its length
    by_shape = starts.join(known.where("kind <> 'link'").select("kind", "shape_head", "shape", "size").distinct(), ["kind", "shape_head"]).withColumn("key", none)
    wanted = [x.select("run", "i", (F.col("i") + F.col("size")).alias("j"), F.lit(0.0).alias("p"), "key", "shape") for x in (by_key, by_shape)]
    wanted = wanted[0].unionByName(wanted[1]).join(edges.where((F.col("j") - F.col("i")) > MAX_JOIN).select("run", "i", "j"), ["run", "i", "j"], "left_anti")
    return edges.unionByName(_long_edges(wanted, long_runs))


def segment_runs(open_runs: DataFrame, alone: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Distinct open runs (kind, run, text, n) to (run, parts array<string>); ``run`` is a digest of kind and text.

    ``alone``: values that stand alone, from :func:`_with_shape`.
    """
    edges = cut(_edges(open_runs))
    alone = cut(alone)
    has_long = not edges.where(F.col("j") - F.col("i") > MAX_JOIN).isEmpty()
    if has_long:
        long_runs = cut(open_runs.where(F.size(F.split("text", _SEP)) > 2 * MAX_JOIN))
        starts = cut(_starts(long_runs))
        edges = cut(_spread(edges, long_runs, starts, alone))
    once = F.sum(F.when(F.col("n") == 1, 1.0).otherwise(0.0))
    totals = {r["kind"]: (r["n"], r["once"] + 1) for r in alone.groupBy("kind").agg(F.sum("n").alias("n"), once.alias("once")).collect()}
    shapes = cut(alone.groupBy("kind", "shape").agg(F.sum("n").alias("n")))
    # only what is sought
    sought = alone.join(edges.select("kind", "key"), ["kind", "key"], "left_semi") if not has_long else alone
    counted = cut(sought.groupBy("kind", "key").agg(F.sum("n").alias("n")))

    def e_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = tuple([] for _ in _EDGE_NAMES)
            for r in b.to_pylist():
                found, others = posteriors(left_out(r["edges"], r["n"]), totals.get(r["kind"], (0.0, 1.0)), r["kind"], LONG / max(r["n"], 1.0))
                new = ((i, j, None, None, None, p) for i, j, p in others)
                for values in itertools.chain(((e["i"], e["j"], e["key"], e["shape"], e["words"], p) for e, p in zip(r["edges"], found, strict=True)), new):
                    for c, x in zip(out, (r["kind"], r["run"], r["n"], *values), strict=True):
                        c.append(x)
            yield _edge_batch(out)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for r in b.to_pylist():
                run = r["text"].split(_SEP)
                parts.append([span_text(run, i, j) for i, j in best_path(left_out(r["edges"], r["n"]), totals.get(r["kind"], (0.0, 1.0)), r["kind"])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.list_(pa.string()))], names=["run", "parts"])

    for _ in range(rounds):
        edges = cut(_lattices(edges, counted, shapes).mapInArrow(e_step, _EDGE))
        if has_long:
            new = _long_edges(edges.where("key is null"), long_runs)
            edges = cut(_spread(cut(edges.where("key is not null").unionByName(new)), long_runs, starts, alone))
    paths = _lattices(edges, counted, shapes).join(open_runs.select("run", "text"), "run")
    return paths.select("run", "kind", "edges", "text", "n").mapInArrow(decode, "run binary, parts array<string>")


def _cells(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(id, field, elem, kind, cell) of every non-blank cell."""
    parts = []
    for name, kind in fields.items():
        c = F.col(f"`{name}`")
        is_array = dict(df.dtypes)[name].startswith("array")
        one = df.select(F.col(f"`{id_col}`").alias("id"), F.lit(name).alias("field"), F.lit(kind).alias("kind"), (F.posexplode(c) if is_array else F.posexplode(F.array(c))).alias("elem", "cell"))
        parts.append(one.where(F.col("cell").rlike(r"\S")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def all_values(df: DataFrame, *, id_col: str, fields: dict[str, str], only_packed: bool = False) -> DataFrame:
    """``(id, field, pos, value, entry)`` for each value of the given fields.

    ``fields``: column to kind (name, address or link); a column may be a string or an
    array of strings, whose elements are one field. ``value`` of an address is the
    address alone if there is one; ``entry`` is the whole entry. ``only_packed``: only
    fields of which at least one cell holds two or more values.
    """
    cells = _cells(df, id_col, fields)
    is_open = F.lit(False)
    for kind in set(fields.values()):
        is_open = is_open | ((F.col("kind") == kind) & F.col("cell").rlike(_OPEN[kind]))
    rid = F.concat_ws("\x1f", F.coalesce(F.col("id").cast("string"), F.lit("")), "field", F.col("elem").cast("string"))
    packed = cells.where(is_open).select(rid.alias("rid"), "kind", "cell")
    parsed = cut(_parse(packed))
    runs = parsed.select("rid", "kind", F.posexplode("runs").alias("at", "run"))
    has_open = F.instr("run", _SEP) > 0
    digested = F.unhex(F.md5(F.concat_ws(_SEP, "kind", "run")))
    distinct_runs = runs.groupBy("kind", "run").agg(F.count("*").cast("double").alias("n"))
    alone = cells.where(~is_open).groupBy("kind", F.trim("cell").alias("run")).agg(F.count("*").cast("double").alias("n"))
    alone = _with_shape(alone.unionByName(distinct_runs.where(~has_open)).groupBy("kind", "run").agg(F.sum("n").alias("n")))
    parts = segment_runs(distinct_runs.where(has_open).select("kind", digested.alias("run"), F.col("run").alias("text"), "n"), alone)
    closed = runs.where(~has_open).select("rid", "kind", "at", F.array("run").alias("parts"))
    opened = runs.where(has_open).withColumn("text", F.col("run")).withColumn("run", digested).join(parts, "run", "left").withColumn("run", F.col("text")).select("rid", "kind", "at", F.coalesce("parts", F.array("run")).alias("parts"))
    packed_values = closed.unionByName(opened).select("rid", "kind", "at", F.posexplode("parts").alias("sub", "entry"))
    back = F.split("rid", "\x1f")
    id_type = df.schema[id_col].dataType
    out = packed_values.select(back[0].try_cast(id_type).alias("id"), back[1].alias("field"), back[2].cast("int").alias("elem"), "kind", "at", "sub", "entry")
    single = cells.where(~is_open).select("id", "field", "elem", "kind", F.lit(0).alias("at"), F.lit(0).alias("sub"), F.col("cell").alias("entry"))
    arrays = [f for f, t in df.dtypes if f in fields and t.startswith("array")]
    # a cell of one value is a whole field, unless it is an element of an array
    beside = single.where(F.col("field").isin(arrays)) if arrays else single.limit(0)
    # repeated rows of one id are one field
    cell = F.struct("elem", "at", "sub", "nth", "value", "entry")
    grouped = _values(out.unionByName(beside)).groupBy("id", "field").agg(F.sort_array(F.collect_set(cell)).alias("all"))
    if only_packed:
        n = F.size(F.array_distinct(F.transform("all", lambda x: x["elem"])))
        grouped = grouped.where(F.size("all") > n)
    exploded = grouped.select("id", "field", F.posexplode("all").alias("pos", "v"))
    exploded = exploded.select(F.col("id").alias(id_col), "field", (F.col("pos") + 1).alias("pos"), F.col("v.value").alias("value"), F.col("v.entry").alias("entry"))
    if only_packed:
        return exploded
    whole = _values(single.where(~F.col("field").isin(arrays))).select(F.col("id").alias(id_col), "field", F.lit(1).alias("pos"), "value", "entry")
    return exploded.unionByName(whole)


def _values(entries: DataFrame) -> DataFrame:
    """Entries to values: addresses alone, the rest without quotes and brackets."""
    address = r"(?<![\w.\-])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+"
    found = F.regexp_extract_all("entry", F.lit(f"({address})"), 1)
    # the address in its first spelling where it is written twice
    first = F.filter(found, lambda x, i: F.expr("true") if i is None else (F.array_position(F.transform(found, F.lower), F.lower(x)) == i + 1))
    trimmed = F.regexp_replace("entry", r"^[\s\u3000\u00a0]+|[\s\u3000\u00a0]+$", "")
    quoted = F.regexp_replace(trimmed, r"^(?:\"\s*([^\"]*?)\s*\"|'\s*(.*?)\s*'|<\s*([^<>]*?)\s*>)$", "$1$2$3")
    quoted = F.regexp_replace(quoted, r"^(?:\"\s*([^\"]*?)\s*\"|<\s*([^<>]*?)\s*>)$", "$1$2")
    value = F.when((F.col("kind") == "address") & (F.size(found) > 0), first).otherwise(F.array(quoted))
    return entries.select("id", "field", "elem", "at", "sub", "entry", F.posexplode(value).alias("nth", "value")).where(F.col("value") != "")


def packed_values(df: DataFrame, *, id_col: str, fields: dict[str, str]) -> DataFrame:
    """``(id_col, field, pos, value)`` of the fields that hold several values."""
    return all_values(df, id_col=id_col, fields=fields, only_packed=True).drop("entry")
