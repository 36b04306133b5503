"""Evaluation texts leaking into training text.

Method: template canonicalisation. Texts are brought to tokens without layout, markup,
case, width and punctuation; numbers (with the unit of an amount, which may be left out),
months and names become typed placeholders. Names are the capitalised words of the items,
so that they are known in any case. Template windows of every document are hash-joined
with the windows of the items: windows with a figure have three tokens and meet by their
template and one figure; windows of words alone, names and months typed, have five tokens
(ten signs in scripts without blanks) and meet by their template. From the windows that
meet, each sentence of the item is aligned with its place in the document (single changed
words allowed), and the values in its slots are checked for consistency: a question with
other figures or other names is no hit. The sentences found are chained in the item's
order. A document leaks an item if the chain covers a third of the item's wording,
instructions common to several items left out.

Scale: the items are held out and few (checked); their index goes with the tasks, as the
build side of a hash join. The documents are read once, whole, without shuffle. Chaining
takes n log n steps for n sentences found.

Defined cases: null, empty and blank texts contain nothing; items without tokens are
never found; equal documents give equal rows; items of equal text are all reported;
columns beyond id and text are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.session import bounded_rows

ITEM_LIMIT = 20_000
#: Tokens of a window with a figure, of a window of words, of one in a script without blanks; tokens that an
#: alignment may look beyond the sentence.
WINDOW, WORDS, SIGNS, SLACK = 3, 5, 10, 6
#: Share of equal tokens, place by place, from which a sentence without figures is aligned.
NEAR = 0.4
#: Share of an item's wording that makes a leak.
SHARE = 1 / 3
#: Of an aligned stretch: share of tokens and of slots that agree.
TOKENS_AGREE, SLOTS_AGREE = 0.55, 0.5
#: Slots with other figures (in stretches without figures: other names) for each slot that agrees.
OTHER_FIGURES = 0.3
#: Items in which a sentence without slots makes it a common instruction.
COMMON = 3

# Months, and units that may follow an amount or be left out.
MONTHS = {"january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"}
UNITS = {"yen", "円", "usd", "eur", "euro", "euros", "dollars"}
_TOKEN = re.compile(r"\d+(?:[.,\-]\d+)*|[぀-ヿ㐀-鿿々〆ー]|[^\W\d_぀-ヿ㐀-鿿]+(?:['’][^\W\d_]+)?")
_INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|(?<=[。？！])")


def tokens(text: str) -> list[str]:
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE)).casefold()
    return [t.replace(",", "") if t[0].isdigit() else t for t in _TOKEN.findall(text) if t not in UNITS]


_CAPITALISED = re.compile(r"(?<=[a-zß-ÿ,] )[A-ZÀ-Þ][a-zß-ÿ]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿々〆ー]")


class Index:
    """Windows of the items, with the item, its sentence and the place in it."""

    def __init__(self, items: list[tuple[int, str]]):
        self.names = {w.casefold() for _, text in items for w in _CAPITALISED.findall(text)} - MONTHS - {w for _, text in items for w in re.findall(r"(?<!\w)[a-zß-ÿ]+", text)}
        split = {i: [t for s in _SENTENCE.split(text) if (t := tokens(s))] for i, text in items}
        in_items: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for i, ss in split.items():
            for s in ss:
                if not any(t[0].isdigit() or t in MONTHS for t in s):
                    in_items[tuple(s)].add(i)
        self.sentences = {i: [s for s in ss if len(in_items.get(tuple(s), ())) < COMMON] for i, ss in split.items()}
        self.size = {i: sum(map(len, ss)) for i, ss in self.sentences.items()}
        self.figures: dict[tuple[str, ...], dict[tuple[int, str], list[tuple[int, int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.words: dict[tuple[str, ...], list[tuple[int, int, int]]] = defaultdict(list)
        self.begins: dict[tuple[str, str], set[int]] = defaultdict(set)
        for i, ss in self.sentences.items():
            for n, s in enumerate(ss):
                t = self.template(s)
                for k in range(len(s) - WINDOW + 1):
                    w = tuple(t[k : k + WINDOW])
                    for j, c in enumerate(w):
                        if c == "#":
                            self.figures[w][j, s[k + j]].append((i, n, k))
                size = SIGNS if sum(bool(_CJK.match(x)) for x in s) > len(s) / 2 else WORDS
                for k in range(len(s) - size + 1):
                    w = tuple(t[k : k + size])
                    if "#" not in w:
                        self.words[w].append((i, n, k))
                        self.begins[w[0], w[1]].add(size)

    def template(self, ts: list[str]) -> list[str]:
        names = self.names
        return ["#" if t[0].isdigit() else "M" if t in MONTHS else "N" if t in names else t for t in ts]

    def anchors(self, ts: list[str]) -> dict[int, dict[int, set[int]]]:
        """Item to sentence to the starts in the document that the windows met point to."""
        found: dict[int, dict[int, set[int]]] = {}
        t = self.template(ts)
        figures, words, begins = self.figures, self.words, self.begins
        for p in range(len(ts) - WINDOW + 1):
            a, b, c = t[p], t[p + 1], t[p + 2]
            if a == "#" or b == "#" or c == "#":
                by_slot = figures.get((a, b, c))
                if by_slot:
                    for j, x in enumerate((a, b, c)):
                        if x == "#":
                            for i, n, k in by_slot.get((j, ts[p + j]), ()):
                                found.setdefault(i, {}).setdefault(n, set()).add(p - k)
            for size in begins.get((a, b), ()):
                for i, n, k in words.get(tuple(t[p : p + size]), ()):
                    s = self.sentences[i][n]
                    start = p - k
                    if start >= -SLACK and sum(x == y for x, y in zip(s[max(0, -start) :], ts[max(0, start) : start + len(s)], strict=False)) >= NEAR * len(s):
                        found.setdefault(i, {}).setdefault(n, set()).add(start)
        return found

    def align(self, ts: list[str], sentence: list[str], start: int) -> tuple[int, int] | None:
        """(place in the document, tokens covered) of the sentence near ``start``."""
        low = max(0, start - SLACK)
        region = ts[low : start + len(sentence) + SLACK]
        matcher = SequenceMatcher(None, sentence, region, autojunk=False)
        blocks = [b for b in matcher.get_matching_blocks() if b.size]
        # a lone word far from the rest is chance
        while len(blocks) > 1 and blocks[0].size == 1 and blocks[1].a - blocks[0].a > 3:
            blocks.pop(0)
        while len(blocks) > 1 and blocks[-1].size == 1 and blocks[-1].a - blocks[-2].a - blocks[-2].size > 2:
            blocks.pop()
        if not blocks:
            return None
        first, last = blocks[0].a, blocks[-1].a + blocks[-1].size
        agreed = {k for b in blocks for k in range(b.a, b.a + b.size)}
        slots = [k for k in range(first, last) if sentence[k][0].isdigit()]
        held = sum(k in agreed for k in slots)
        if len(agreed) < TOKENS_AGREE * (last - first) or held < SLOTS_AGREE * len(slots):
            return None
        # other values in the same slots; a figure or name that another word replaces is only a changed word
        valued = (lambda t: t[0].isdigit()) if slots else self.names.__contains__
        other = 0
        for x, y in zip(blocks, blocks[1:], strict=False):
            mine, theirs = sentence[x.a + x.size : y.a], region[x.b + x.size : y.b]
            other += min(sum(map(valued, mine)), sum(map(valued, theirs)))
        # a stretch that ends where the values begin to differ is the same question with other values
        end = blocks[-1].b + blocks[-1].size
        if not held:
            for here, there in ((sentence[last : last + 1], region[end : end + 1]), (sentence[first - 1 : first], region[blocks[0].b - 1 : blocks[0].b])):
                if here and there:
                    other += (here[0][0].isdigit() and there[0][0].isdigit()) or (valued(here[0]) and valued(there[0]))
            if not slots:
                held = sum(valued(sentence[k]) for k in agreed)
        if other > OTHER_FIGURES * held or (not slots and last - first - len(agreed) > 1):
            return None
        return low + blocks[0].b, last - first

    def leaks(self, text: str) -> list[tuple[int, float]]:
        """(item, share of its wording) of the items that the text leaks."""
        ts = tokens(text)
        out = []
        places: dict[str, list[int]] | None = None
        for i, by_sentence in self.anchors(ts).items():
            sentences = self.sentences[i]
            if sum(len(s) for n, s in enumerate(sentences) if n in by_sentence or not any(t[0].isdigit() for t in s)) < SHARE * self.size[i]:
                continue  # even whole, the sentences met do not make the share
            best: list[tuple[int, int, int]] = []
            for n, s in enumerate(sentences):
                starts = by_sentence.get(n, ())
                if not starts and any(t[0].isdigit() for t in s):
                    continue
                if not starts:
                    # a sentence without numbers: by its first words, wherever they stand
                    if places is None:
                        places = defaultdict(list)
                        for p in range(len(ts) - 1):
                            places[ts[p] + " " + ts[p + 1]].append(p)
                    near = {p - k for k in (0, len(s) // 2) if k + 1 < len(s) for p in places.get(s[k] + " " + s[k + 1], ()) if p >= k}
                    starts = [p for p in near if sum(x == y for x, y in zip(s, ts[p : p + len(s)], strict=False)) >= NEAR * len(s)]
                for start in starts:
                    if hit := self.align(ts, s, start):
                        best.append((n, hit[0], hit[1]))
            covered = self._chain(best)
            if self.size[i] and covered >= SHARE * self.size[i]:
                out.append((i, covered / self.size[i]))
        return out

    @staticmethod
    def _chain(hits: list[tuple[int, int, int]]) -> int:
        """Most tokens covered by sentences that keep the item's order."""
        hits = sorted(set(hits))
        at = sorted({p for _, p, _ in hits})
        tree = [0] * (len(at) + 1)  # greatest cover up to a place, as a Fenwick tree
        best, k = 0, 0
        while k < len(hits):
            ready = []
            n = hits[k][0]
            while k < len(hits) and hits[k][0] == n:
                _, p, size = hits[k]
                j, cover = bisect_left(at, p), 0
                place = j + 1
                while j:
                    cover = max(cover, tree[j])
                    j -= j & -j
                ready.append((place, size + cover))
                k += 1
            for j, cover in ready:  # only sentences before this one may precede it
                best = max(best, cover)
                while j < len(tree):
                    tree[j] = max(tree[j], cover)
                    j += j & -j
        return best


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``(id_col, item_col, share)`` of each item that a document leaks."""
    rows = bounded_rows(items.select(item_col, "text"), ITEM_LIMIT, "the table of items")
    index = Index([(r[0], r[1]) for r in rows if r[0] is not None and r[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, item, share = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                if text:
                    for i, s in index.leaks(text):
                        at.append(k)
                        item.append(i)
                        share.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(share, pa.float64())], names=[id_col, item_col, "share"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, `{item_col}` bigint, share double")
