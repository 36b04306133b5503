"""Reading level of each English document.

Method: regularised ordinal regression (proportional odds, L2) over lexical diversity,
word rarity, connective, clause-depth proxy and length features, calibrated to graded
text. Rarity has two sides: how rare a word is in the corpus (counted over all
documents), and how demanding the graded texts are that use it. The second is
cross-fitted, so that no graded text sees its own level.

Scale: words are counted in the JVM with map-side combine. Only words that make up at
least one in :data:`RAREST` of all words come to the driver, so there can be no more than
that many of them; a word below that share is as rare as the share, in every document
alike. The model is fitted on the driver on the graded texts (checked) and goes with the
tasks; the documents are scored in one pass, whose features are computed for a batch at
a time.

Defined cases: null and empty texts, texts of fewer than 40 blank-separated words and
texts that are not mainly English have no row, whatever their language tag says; words
without a grade take the mean of the words of their length; levels between two
thresholds go to the likelier one, ties to the lower. Equal texts get equal levels.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import bounded_rows, cut

SAMPLE_LIMIT = 20_000
#: A word is told from rarer ones down to a share of one in so many words; as many words at most have it.
RAREST = 200_000
LEAST_WORDS = 40
#: Strength of the L2 penalty; folds of the cross-fitting; weight of the mean in a word's grade.
PENALTY, FOLDS, SHRINK = 0.02, 10, 1.0

# Function words that tell English, German and others apart, and connectives.
ENGLISH = set("the of and to in a is was for it that on with as by at from this which be had are were or an not we i has have they no after before all out over under into".split())
GERMAN = set("der die das und ist nicht ein eine wird werden für auf mit von den dem des im zu über wir noch seit bitte sie an".split())
OTHER = set("le la les des et est une dans pour que qui el los las una por con del il che di per non".split())
GERMAN_ONLY, OTHER_ONLY = GERMAN - ENGLISH, OTHER - ENGLISH - GERMAN
CONNECTIVES = set(
    "although because while whereas despite notwithstanding therefore however moreover furthermore nevertheless consequently thereby insofar inasmuch albeit irrespective provided assuming pending once unless until since though if when which who whose that".split()
)
SUBORDINATE = set("which who whose that although because while whereas insofar inasmuch albeit unless if when once provided assuming notwithstanding despite".split())
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_SENTENCES = re.compile(r"[.?!;]+(?:\s|$)|\n")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def words(text: str) -> list[str]:
    t = unicodedata.normalize("NFKC", text).translate({0x200B: None, 0xFEFF: None, 0xAD: None})
    if "<" in t:
        t = _TAG.sub(" ", t)
    return _WORD.findall(t.casefold())


def is_english(text: str, ws: list[str], kinds: Counter[str] | None = None) -> bool:
    """Whether a text of enough words is mainly English."""
    if not ws or len(text.split()) < LEAST_WORDS:
        return False
    joined = "".join(ws)
    latin = len(joined) if joined.isascii() else sum(len(w) for w in ws if w.isascii())
    get = (Counter(ws) if kinds is None else kinds).__getitem__
    english, german, other = sum(map(get, ENGLISH)), sum(map(get, GERMAN_ONLY)), sum(map(get, OTHER_ONLY))
    return latin > 0.6 * len(joined) and english > german + other and english >= 0.05 * len(ws)


class Grades:
    """How demanding a word is, from the graded texts, and how rare in the corpus."""

    def __init__(self, texts: list[tuple[list[str], int]], counts: dict[str, int], total: int):
        seen: dict[str, list[int]] = defaultdict(list)
        for ws, level in texts:
            for w in set(ws):
                seen[w].append(level)
        mean = sum(lv for _, lv in texts) / max(1, len(texts))
        self.grade = {w: (sum(v) + SHRINK * mean) / (len(v) + SHRINK) for w, v in seen.items()}
        by_length: dict[int, list[float]] = defaultdict(list)
        for w, g in self.grade.items():
            by_length[min(len(w), 16)].append(g)
        self.by_length = {k: sum(v) / len(v) for k, v in by_length.items()}
        self.mean = mean
        # one row for each word that is told from others: grade, rarity, and what it counts for
        self.rarest = math.log(RAREST)
        named = sorted(self.grade.keys() | counts.keys() | ENGLISH | CONNECTIVES | SUBORDINATE)
        self.row = {w: i for i, w in enumerate(named)}
        grade = [self.grade.get(w) or self._by_length(len(w)) for w in named]
        rarity = [min(self.rarest, -math.log(max(counts.get(w, 0), 1e-9) / max(total, 1))) for w in named]
        self.table = np.array([grade, rarity, [w not in ENGLISH for w in named], [w in CONNECTIVES for w in named], [w in SUBORDINATE for w in named]], float).T
        self.lengths = np.array([self._by_length(k) for k in range(17)])

    def _by_length(self, size: int) -> float:
        return self.by_length.get(min(size, 16), self.mean)

    def features(self, texts: list[tuple[list[str], str]], kinds: list[Counter[str]] | None = None) -> np.ndarray:
        """One row for each (words, text); every text has a word."""
        sizes = np.array([len(ws) for ws, _ in texts])
        flat = [w for ws, _ in texts for w in ws]
        row, length = self.row, np.fromiter(map(len, flat), np.int64, len(flat))
        at = np.fromiter((row.get(w, -1) for w in flat), np.int64, len(flat))
        known = at >= 0
        values = self.table[at]
        grade = np.where(known, values[:, 0], self.lengths[np.minimum(length, 16)])
        rarity = np.where(known, values[:, 1], self.rarest)
        content = ~known | (values[:, 2] > 0)
        doc = np.repeat(np.arange(len(texts)), sizes)
        n_docs = len(texts)
        # texts of function words only: all their words are content
        content |= (np.bincount(doc, content, n_docs) == 0)[doc]
        c_doc, c_grade = doc[content], grade[content]
        c_n = np.bincount(c_doc, minlength=n_docs)
        order = np.lexsort((c_grade, c_doc))
        ranked, starts = c_grade[order], np.concatenate([[0], np.cumsum(c_n)[:-1]])

        def mean(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, x, n_docs) / sizes

        def quantile(q: float) -> np.ndarray:
            place = q * (c_n - 1)
            low = np.floor(place).astype(np.int64)
            a, b = ranked[starts + low], ranked[starts + np.minimum(low + 1, c_n - 1)]
            return a + (b - a) * (place - low)

        def share(lo: float, hi: float) -> np.ndarray:
            return np.bincount(c_doc, (lo <= c_grade) & (c_grade < hi), n_docs) / c_n

        kinds = kinds or [Counter(ws) for ws, _ in texts]
        sentences = np.array([max(1, len(_SENTENCES.findall(t))) for _, t in texts])
        commas = np.array([t.count(",") for _, t in texts])
        connective, subordinate = np.where(known, values[:, 3], 0), np.where(known, values[:, 4], 0)
        return np.stack(
            [
                np.bincount(c_doc, c_grade, n_docs) / c_n,
                *map(quantile, (0.25, 0.5, 0.75)),
                *(share(lo, hi) for lo, hi in ((0, 1.7), (1.7, 2.4), (2.4, 3.2), (3.2, 4.0), (4.0, 4.5), (4.5, 9))),
                mean(length),
                mean(length >= 8),
                mean(length >= 11),
                np.array([len(k) for k in kinds]) / sizes**0.8,
                np.array([sum(v == 1 for v in k.values()) for k in kinds]) / sizes**0.8,
                mean(rarity),
                100 * mean(connective),
                100 * (mean(subordinate) + commas / sizes),
                np.log(sizes),
                np.log(sizes / sentences),
            ],
            axis=1,
        )


class OrdinalRegression:
    """Proportional odds by gradient descent with L2; levels 1 to ``k``."""

    def fit(self, x: np.ndarray, y: np.ndarray, k: int, steps: int = 3000, rate: float = 0.3) -> OrdinalRegression:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = (x - self.mean) / self.scale
        w = np.zeros(z.shape[1])
        # thresholds as the first one and the logs of the gaps between them
        theta = np.concatenate([[-1.5], np.zeros(k - 2)])
        over = (y[:, None] > np.arange(1, k)[None, :]).astype(float)
        m_w, m_t, v_w, v_t = np.zeros_like(w), np.zeros_like(theta), np.zeros_like(w), np.zeros_like(theta)
        for step in range(1, steps + 1):
            gaps = np.exp(theta[1:])
            cuts = theta[0] + np.concatenate([[0.0], np.cumsum(gaps)])
            p = 1 / (1 + np.exp(-(z @ w)[:, None] + cuts[None, :]))
            d = (p - over) / len(y)
            g_w = z.T @ d.sum(1) + PENALTY * w
            d_cut = -d.sum(0)
            g_t = np.concatenate([[d_cut.sum()], np.array([d_cut[j + 1 :].sum() * gaps[j] for j in range(k - 2)])])
            for par, g, m, v in ((w, g_w, m_w, v_w), (theta, g_t, m_t, v_t)):
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.999 * v + 0.001 * g * g
                par -= rate * 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w, self.cuts = w, theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.scale) @ self.w
        p = 1 / (1 + np.exp(-s[:, None] + self.cuts[None, :]))
        over = np.concatenate([np.ones((len(s), 1)), p, np.zeros((len(s), 1))], axis=1)
        return 1 + np.argmax(over[:, :-1] - over[:, 1:], axis=1)


class LevelModel:
    """Grades of words and the regression, fitted on graded texts."""

    def __init__(self, samples: list[tuple[str, int]], counts: dict[str, int], total: int):
        graded = [(ws, int(lv), t) for t, lv in samples if (ws := words(t))]
        rows: list = [None] * len(graded)
        for f in range(FOLDS):
            held = [k for k in range(len(graded)) if k % FOLDS == f]
            if held:
                g = Grades([(ws, lv) for k, (ws, lv, _) in enumerate(graded) if k % FOLDS != f], counts, total)
                for k, x in zip(held, g.features([(graded[k][0], graded[k][2]) for k in held]), strict=True):
                    rows[k] = x
        x = np.array(rows)
        y = np.array([lv for _, lv, _ in graded])
        self.regression = OrdinalRegression().fit(x, y, int(y.max()))
        self.grades = Grades([(ws, lv) for ws, lv, _ in graded], counts, total)

    def levels(self, texts: list[tuple[list[str], str]], kinds: list[Counter[str]] | None = None) -> list[int]:
        return self.regression.predict(self.grades.features(texts, kinds)).tolist() if texts else []


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` over all documents."""
    text = F.lower(F.regexp_replace(F.regexp_replace(text_col, "[\u200b\ufeff\u00ad]", ""), _TAG.pattern, " "))
    return docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\p{L}+(?:['’-]\p{L}+)*)"), 1)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, samples: DataFrame, text_col: str = "text") -> LevelModel:
    rows = [(r["text"], r["level"]) for r in bounded_rows(samples.select("sample_id", "text", "level").orderBy("sample_id"), SAMPLE_LIMIT, "graded texts") if r["text"] and r["level"] is not None]
    counted = cut(word_counts(docs, text_col))
    total = counted.agg(F.sum("n")).first()[0] or 0
    counts = {r["word"]: r["n"] for r in counted.where(F.col("n") * RAREST >= total).collect()}  # RAREST words at most
    return LevelModel(rows, counts, total)


def reading_levels(docs: DataFrame, samples: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, level)`` of each English document of enough words."""
    model = fit(docs, samples, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, kinds = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if t and is_english(t, ws := words(t), seen := Counter(ws)):
                    at.append(k)
                    texts.append((ws, t))
                    kinds.append(seen)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(model.levels(texts, kinds), pa.int32())], names=[id_col, "level"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, level int")
