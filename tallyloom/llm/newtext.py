"""Quoted history and signatures in emails: only what the sender wrote anew.

Method: a sequence model (linear-chain conditional random field) labels the lines of a
mail as new, quoted, unmarked history, signature or notice. Each line gives several
features at once: its form, its prefix, punctuation and length, its position in the
mail, the forms of its neighbours, and whether it already stands in an earlier mail of
its thread by another sender (``thread_col``). Transitions carry what mails look like;
unmarked history begins at a separator or at a block of header lines (From, then Sent,
To or Subject) and runs to the end. A Viterbi search finds the best labels of the whole
mail. History that opens a mail is answered below it: it ends with its last marked
quotation, and the lines after that are labelled as a mail of their own.

The weights are fitted by self-training: hand-set potentials (:data:`EVIDENCE`,
:data:`MOVES`) label a sample of mails, mails in which a line they call new is proved
old by the thread are left out, and the field is fitted to the rest by conditional
likelihood with L2; it then labels the sample itself and is fitted once more.

Scale: lines of a thread meet as 64-bit hashes, grouped with map-side combine; only hashes of two mails or
more are joined back. The texts move once, to meet the line numbers found. The weights
are fitted on the driver on :data:`SAMPLE` mails at most, the first of the table; every
mail is labelled.

Defined cases: null and empty bodies have no line; blank lines have no label; lines end
at a newline and count from 1, blank ones included; a line cut at its end is judged by
what is left of it, the last line also as the beginning of a closing formula; mails
without thread or time are judged alone; equal mails of one place in a thread give equal
lines. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

LABELS = ("new", "quoted", "history", "signature", "notice")
_NO = -1e6

# Formulas that close a mail, marks of devices and words of notices.
CLOSINGS = (
    "best regards", "kind regards", "warm regards", "regards", "best wishes", "many thanks and best wishes", "many thanks", "thanks", "thank you", "cheers", "sincerely", "yours sincerely", "yours faithfully", "best", "all the best",
    "mit freundlichen grüßen", "freundliche grüße", "viele grüße", "beste grüße", "以上、よろしくお願いいたします", "よろしくお願いいたします", "よろしくお願いします", "以上", "敬具",
)
# How device lines and notices begin, for a last line that is cut off.
OPENINGS = ("-----original message", "---------- forwarded", "sent from my", "sent from the", "sent via", "get the", "gesendet von", "this message", "this e-mail", "this email", "the sender", "confidential", "please consider the environment", "diese nachricht", "diese e-mail")
_NOTICE = re.compile(
    r"(?i)\b(?:confidential(?:ity)?\b.*\b(?:e-?mail|message|contents|attachment)|(?:e-?mail|message)\b.*\b(?:meant|intended) (?:only|solely)|intended recipient|addressee\b|accepts? no liability|environment before printing|privileged|vertraulich|haftung|only valid with signature)|機密|本メール"
)
_DEVICE = re.compile(r"(?i)^(?:sent (?:from|via|with) (?:my|the)\b|get (?:the|our) .{0,30}\bapp\b|gesendet von|von meinem .{0,20}gesendet|envoyé de)|から送信$")
_CLOSING = re.compile(r"(?i)^(?:" + "|".join(map(re.escape, CLOSINGS)) + r")[\s,.!。]*$")
_RULE = re.compile(r"^\s*(?:-{2,}|={3,}|\*{3,}|_{3,}|~{3,}|[―—–─]{3,}|#{3,})\s*$")
_LONG_RULE = re.compile(r"^_{20,}\s*$")
_SPLIT = re.compile(r"(?i)^\s*-{3,}\s*(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|元のメッセージ|転送されたメッセージ)\s*-{3,}\s*$|^begin forwarded message:")
_HEADER = re.compile(r"(?i)^\s*(?:from|sent|date|to|cc|subject|von|gesendet|datum|an|betreff|差出人|送信日時|日時|宛先|件名)\s*[:：]\s*\S")
_FROM = re.compile(r"(?i)^\s*(?:from|von|差出人)\s*[:：]\s*\S")
_HEADER_WORDS = ("sent:", "date:", "to:", "cc:", "subject:", "gesendet:", "datum:", "an:", "betreff:", "送信日時:", "日時:", "宛先:", "件名:")
_INTRO = re.compile(
    r"(?i)^.{0,120}(?:\bwrote|\bschrieb|a écrit)\b[^.?!]{0,60}:\s*$|^.{2,60}\bwrote on \d{4}-\d\d-\d\d[^.]*:\s*$|^\s*\d{4}年\d{1,2}月\d{1,2}日.*(?:[:：]|のメール)\s*$|^on .{0,60}\d{4}.{0,60}<[^>]+>\s*$"
)
_WRAPPED = re.compile(r"(?i)^(?:on|am) .{0,30}\d{4}\b.{0,60}$")
_CONTACT = re.compile(
    r"(?i)^\s*(?:(?:t|tel|telephone|phone|mobile|mob|fax|m|e|email|e-mail|mail|web|☎|✆)[.:]?\s*[+(\d\w@].*\d.*|(?:e|email|e-mail|mail)\s*[:.]?\s*\S+@\S+|☎.*|\S+@\S+\.\S+|\d+[a-z]?\s+(?:[\w.'ß-]+\s+)+(?:street|st\.?|road|rd\.?|lane|avenue|ave\.?|way|close|drive|court)\b.*|[\w.ß-]*(?:straße|gasse|weg|allee|platz|ufer)\s+\d+.*|\d+[a-z]?\s+(?:[A-Z][\w'-]*\s+){1,3}(?:St|Rd|Ave|Ln)\b.*|(?:[\w'-]+\s+){1,3}\d+[a-z]?(?:,.*)?|[㐀-鿿ヶケァ-ヺー]+\d+(?:-\d+)+.*|[+(]?\d[\d\s()./+-]{6,})\s*$"
)
_ADDRESS = re.compile(r"^\d+[a-z]?\s+(?:[A-Z][\w'-]*\s+){1,4}(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Way|Close|Drive|Court|Square|Place|Terrace)(?:,| in\b|$)[^.?!]{0,40}$")
#: Ends of names that look like ends of sentences.
_ABBREVIATED = re.compile(r"^(?:[A-Z&][\w'&-]*\s+){1,5}(?:Inc|Ltd|Co|Corp|K\.K|LLC)\.$")
_GREETING = re.compile(r"(?i)^(?:(?:hi|hello|hey|dear|good (?:morning|afternoon|evening|day)|hallo|guten (?:tag|morgen)|sehr geehrte\w*|liebe\w*)\b.{0,60}|.{1,40}(?:様|さん|各位|御中)|お世話になっております.*)[\s,!:：。-]*$")
_NAME_COMMA = re.compile(r"^\s*(?:[A-ZÀ-Þ][\w.'ß-]*|[㐀-鿿]+)(?:[\s　]+(?:&\s+)?(?:[A-ZÀ-Þ][\w.'ß-]*|[㐀-鿿]+)){0,5}\s*(?:,| -)\s*$")
_NAME = re.compile(r"^\s*(?:[A-ZÀ-Þ][\w.'ß-]*|[㐀-鿿]+)(?:[\s　]+(?:(?:&|of|and)\s+)?(?:[A-ZÀ-Þ][\w.'ß-]*|[㐀-鿿]+)){0,5}\s*$")
_LOWER = re.compile(r"(?<!\S)[a-zß-ÿ]{2,}(?!\S)")
_SENTENCE = re.compile(r"[.?!。…！？:;][\"')\]]*\s*$")

#: Mails that the weights are fitted on at most; longer ones than ``SAMPLE_LINES`` are labelled but not fitted on.
SAMPLE, SAMPLE_LINES = 400, 40
#: Rounds of self-training, steps of the first fitting (later ones go on from it with fewer) and the L2 penalty.
ROUNDS, STEPS, PENALTY = 2, 50, 0.00001
#: Signs from which a line can be told to stand in another mail.
LEAST_SIGNS = 25

#: First potentials of the kinds of lines for the labels, in the order of LABELS.
EVIDENCE = {
    "blank": (0, 0, 0, 0, 0),
    "quoted": (-9, 4, 4, -4, -4),
    "intro": (-7, 4, 4, -4, -4),
    "split": (-9, -3, 7, -4, -4),
    "header": (-6, -1, 4, -3, -4),
    "rule": (-6, -4, 3, 4, -2),
    "closing": (-6, -4, 3, 4, -2),
    "contact": (-3, -4, 3, 3, -2),
    "device": (-7, -4, 4, 1, 4),
    "notice": (-6, -4, 4, 0, 4),
    "greeting": (3, -4, 3, -4, -4),
    "name": (-1, -4, 3, 2, -2),
    "short": (0.5, -4, 3, 1, -1),
    "text": (3, -5, 3, -4, -3),
}
#: The same for text that stands in an earlier mail of the thread by another sender.
PROVED = (-6, 3, 1, 0, 0)
#: First potentials of the moves, from the row's label to the column's.
MOVES = (
    (0.0, -0.5, 0.0, -1.0, -0.5),
    (-0.5, 0.0, 0.0, -3.0, -0.5),
    (_NO, _NO, 0.0, _NO, _NO),
    (-7.0, -0.5, 0.0, 0.0, 0.0),
    (-7.0, -0.5, 0.0, -2.0, 0.0),
)


def kinds(lines: list[str]) -> list[str]:
    """Form of each line, seen with its neighbours and its place."""
    out = []
    first = next((i for i, x in enumerate(lines) if x.strip()), 0)
    last = len(lines) - 1
    for i, line in enumerate(lines):
        text = line.strip(" \t\r　​")
        after = lines[i + 1].strip() if i < last else ""
        if not text:
            k = "blank"
        elif text[0] in ">|":
            k = "quoted"
        elif _SPLIT.match(text) or (_LONG_RULE.match(text) and _HEADER.match(after)):
            k = "split"
        elif _RULE.match(text):
            k = "rule"
        elif _CLOSING.match(text):
            k = "closing"
        elif text[-1] in ":：>" and _INTRO.match(text):
            k = "intro"
        elif after.endswith(("wrote:", "schrieb:")) and _WRAPPED.match(text) and len(after) < 80:
            k = "intro"
        elif _DEVICE.search(text):
            k = "device"
        elif _NOTICE.search(text):
            k = "notice"
        elif _FROM.match(text) and _continues_header(after, i + 1 == last):
            # the lines of a block whose separator stands above belong to that separator
            k = "header" if out and out[-1] == "split" else "split"
        elif _HEADER.match(text) and not (_is_prose(text) and (not out or out[-1] not in ("split", "header")) and not _HEADER.match(after)):
            k = "header"
        elif i == last and len(text) >= 3 and _begins_formula(text):
            k = "closing" if text[0] != "-" else "split"
        elif _GREETING.match(text) or (i == first and _NAME_COMMA.match(text)):
            k = "greeting"
        elif _ADDRESS.match(text):
            k = "contact"
        elif _is_prose(text) or len(text.split()) > 6 or (len(text) > 25 and "、" in text):
            k = "text"
        elif _CONTACT.match(text):
            k = "contact"
        elif _NAME_COMMA.match(text):
            k = "greeting"
        elif _NAME.match(text):
            k = "name"
        else:
            k = "short"
        out.append(k)
    return out


def _is_prose(text: str) -> bool:
    return (bool(_SENTENCE.search(text)) and not _ABBREVIATED.match(text)) or len(_LOWER.findall(text)) > 2


def _continues_header(after: str, cut: bool) -> bool:
    """Whether the line after a From line is a header line, or the beginning of one where the mail is cut."""
    t = after.rstrip("�").casefold().replace("：", ":")
    return bool(_HEADER.match(after)) or (bool(t) and any(t == w or (cut and w.startswith(t)) for w in _HEADER_WORDS))


def _begins_formula(text: str) -> bool:
    t = text.rstrip("�").casefold()
    return any(len(t) < len(c) and c.startswith(t) for c in CLOSINGS) or (len(t) >= 6 and any(o.startswith(t) or (t.startswith(o) and not _SENTENCE.search(t)) for o in OPENINGS))


KINDS = [k for k in EVIDENCE if k != "blank"]
#: Features of a line beside its own form and those of its neighbours.
SIGNS = ("one", "after a blank", "ends a sentence", "first", "among the first", "last", "among the last", "short", "long", "stands in the thread", "digits")
_FORM = {k: i for i, k in enumerate(KINDS)}
_BEFORE, _AFTER = len(KINDS), 2 * len(KINDS) + 1
_SIGN = 3 * len(KINDS) + 2
SIZE = _SIGN + len(SIGNS)
_HISTORY, _SPLIT_FORM = LABELS.index("history"), _FORM["split"]


def features(lines: list[str], ks: list[str], repeated: set[int]) -> list[tuple[int, ...]]:
    """Active features of each line that is not blank, in order; the first is its form."""
    at = [i for i, k in enumerate(ks) if k != "blank"]
    out = []
    for n, i in enumerate(at):
        text = lines[i].strip()
        k = ks[i]
        f = [_FORM[k], _BEFORE + (_FORM[ks[at[n - 1]]] if n else len(KINDS)), _AFTER + (_FORM[ks[at[n + 1]]] if n + 1 < len(at) else len(KINDS)), _SIGN]
        for sign, there in enumerate(
            (i > 0 and ks[i - 1] == "blank", bool(_SENTENCE.search(text[-6:])), n == 0, n < 3, n + 1 == len(at), n + 3 >= len(at), len(text) < 15, len(text) > 40, i in repeated and k == "text", any(map(str.isdigit, text[:40]))), 1
        ):
            if there:
                f.append(_SIGN + sign)
        out.append(tuple(f))
    return out


class LineModel:
    """Weights of the features and moves; before any fitting the first potentials."""

    def __init__(self) -> None:
        self.weights = np.zeros((SIZE, len(LABELS)))
        for k, e in EVIDENCE.items():
            if k != "blank":
                self.weights[_FORM[k]] = e
        self.weights[_SIGN + SIGNS.index("stands in the thread")] = PROVED
        self.moves = np.maximum(np.array(MOVES), -30.0)
        self.first = np.array([0.0, 0.0, -30.0, -2.0, -2.0])
        self.seen: dict[tuple[int, ...], tuple[float, ...]] = {}

    def scores(self, f: tuple[int, ...]) -> tuple[float, ...]:
        got = self.seen.get(f)
        if got is None:
            got = self.seen[f] = tuple(self.weights[list(f)].sum(0).tolist())
        return got

    def path(self, fs: list[tuple[int, ...]]) -> list[int]:
        """Viterbi: label of each line."""
        if not fs:
            return []
        moves, first = self.moves.tolist(), self.first.tolist()
        n = range(len(LABELS))
        # unmarked history begins with its mark and only there, and nothing follows it
        e = self.scores(fs[0])
        best = [(first[b] if b != _HISTORY else 0.0) + e[b] if (b == _HISTORY) == (fs[0][0] == _SPLIT_FORM) else _NO for b in n]
        back = []
        for f in fs[1:]:
            e = self.scores(f)
            now, prev = [], []
            for b in n:
                if b == _HISTORY and f[0] != _SPLIT_FORM:
                    top, at = best[b], b
                elif b != _HISTORY and f[0] == _SPLIT_FORM:
                    top, at = _NO * 2, 0
                else:
                    top, at = _NO * 2, 0
                    for a in n:
                        x = best[a] + moves[a][b] if a != _HISTORY or b == _HISTORY else _NO
                        if x > top:
                            top, at = x, a
                now.append(top + e[b])
                prev.append(at)
            best = now
            back.append(prev)
        at = max(n, key=best.__getitem__)
        out = [at]
        for prev in reversed(back):
            at = prev[at]
            out.append(at)
        return out[::-1]

    def labels(self, lines: list[str], repeated: set[int] = frozenset()) -> list[str]:
        """Label of each line; "" for blank ones. ``repeated``: lines (from 0) that stand in an earlier mail."""
        out: list[str] = []
        for part, at in parts(lines):
            ks, fs = part
            found = iter(self.path(features(lines[at : at + len(ks)], ks, {i - at for i in repeated} if repeated else repeated) if fs else []))
            out += ["" if k == "blank" else LABELS[next(found)] for k in ks]
        return out

    def fit(self, mails: list[tuple[list[tuple[int, ...]], list[int]]], steps: int = STEPS) -> None:
        """Conditional likelihood with L2 over (features, labels) of mails, forward and backward for all at once."""
        mails = [m for m in mails if m[0]]
        if not mails:
            return
        count, longest, n = len(mails), max(len(f) for f, _ in mails), len(LABELS)
        x = np.zeros((count, longest, SIZE))
        y = np.zeros((count, longest, n))
        blocked = np.zeros((count, longest, n))  # history begins with its mark and only there
        size = np.array([len(f) for f, _ in mails])
        for m, (fs, ys) in enumerate(mails):
            for t, (f, label) in enumerate(zip(fs, ys, strict=True)):
                x[m, t, list(f)] = 1
                y[m, t, label] = 1
                blocked[m, t] = np.where(np.arange(n) == _HISTORY, 0.0, -30.0) if f[0] == _SPLIT_FORM else np.where(np.arange(n) == _HISTORY, -30.0, 0.0)
        there = (np.arange(longest)[None, :] < size[:, None]).astype(float)
        flat = x.reshape(-1, SIZE)
        ahead, behind = np.zeros((longest, count, n)), np.zeros((longest, count, n))
        shut = np.zeros((n, n))
        shut[_HISTORY] = -30.0
        shut[_HISTORY, _HISTORY] = 0.0
        true_moves = np.einsum("mta,mtb->ab", y[:, :-1], y[:, 1:] * there[:, 1:, None])
        params = [self.weights, self.moves, self.first]
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        for step in range(1, steps + 1):
            e = (flat @ self.weights).reshape(count, longest, n)
            move = self.moves + shut

            def into(t: int, move=move) -> np.ndarray:
                return move[None] + np.where(np.eye(n)[_HISTORY][:, None] > 0, 0.0, blocked[:, t][:, None, :])

            lse = lambda z, axis: np.log(np.exp(z - z.max(axis, keepdims=True)).sum(axis)) + z.max(axis)
            ahead[0] = self.first + blocked[:, 0] + e[:, 0]
            for t in range(1, longest):
                new = lse(ahead[t - 1][:, :, None] + into(t), 1) + e[:, t]
                ahead[t] = np.where(there[:, t, None] > 0, new, ahead[t - 1])
            total = lse(ahead[-1], 1)
            behind[-1] = 0.0
            want_moves = np.zeros((n, n))
            for t in range(longest - 1, 0, -1):
                on = there[:, t, None, None] > 0
                pair = into(t) + (e[:, t] + behind[t])[:, None, :]
                want_moves += np.where(on, np.exp(ahead[t - 1][:, :, None] + pair - total[:, None, None]), 0.0).sum(0)
                behind[t - 1] = np.where(on[:, :, 0], lse(pair, 2), 0.0)
            p = np.exp(ahead + behind - total[None, :, None]).transpose(1, 0, 2) * there[:, :, None]
            lines = there.sum()
            grads = [
                flat.T @ (y - p).reshape(-1, n) / lines - PENALTY * self.weights,
                (true_moves - want_moves) / lines - PENALTY * self.moves,
                (y[:, 0] - p[:, 0]).sum(0) / lines - PENALTY * self.first,
            ]
            for par, g, (m, v) in zip(params, grads, state, strict=True):
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.99 * v + 0.01 * g * g
                par += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.seen = {}


def parts(lines: list[str]) -> list[tuple[tuple[list[str], bool], int]]:
    """((forms, any), first line) of what is labelled as one mail."""
    ks = kinds(lines)
    opening = next((k for k in ks if k != "blank"), "")
    marked = max((i for i, k in enumerate(ks) if k == "quoted"), default=-1)
    cuts = [0, marked + 1] if opening == "split" and marked >= 0 else [0]
    return [((part := ks[a:b], any(k != "blank" for k in part)), a) for a, b in zip(cuts, [*cuts[1:], len(ks)], strict=True)]


def labels(lines: list[str], repeated: set[int] = frozenset(), model: LineModel | None = None) -> list[str]:
    return (model or LineModel()).labels(lines, repeated)


def self_trained(sample: list[tuple[str | None, list[int] | None]]) -> LineModel:
    """The model fitted on (text, lines from 0 that stand in an earlier mail)."""
    model = LineModel()
    mails = []
    for text, old in sample:
        lines = text.split("\n") if text else []
        if 0 < len(lines) <= SAMPLE_LINES:
            proved = {i for i in old or () if i < len(lines) and kinds_of_text(lines[i])}
            mails.append([(features(lines[at : at + len(ks)], ks, {i - at for i in old or ()}), [i + at for i, k in enumerate(ks) if k != "blank"], proved) for (ks, any_), at in parts(lines) if any_])
    for r in range(ROUNDS):
        data = []
        for mail in mails:
            found = [model.path(fs) for fs, _, _ in mail]
            # a mail that the thread proves wrong is left out
            if not any(label == 0 and i in proved for labels_, (_, at, proved) in zip(found, mail, strict=True) for label, i in zip(labels_, at, strict=True)):
                data += [(fs, labels_) for labels_, (fs, _, _) in zip(found, mail, strict=True)]
        model.fit(data, STEPS // (r + 1))
    return model


def kinds_of_text(line: str) -> bool:
    """Whether a line is running text, and no greeting."""
    t = line.strip()
    return not _GREETING.match(t) and not _NAME_COMMA.match(t) and _is_prose(t)


def old_lines(mails: DataFrame, *, id_col: str, text_col: str, thread_col: str, author_col: str, time_col: str) -> DataFrame:
    """``(id_col, old)``: lines (from 0) of a mail that stand in an earlier mail of its thread by another sender."""
    author = F.lower(F.coalesce(F.nullif(F.regexp_extract(author_col, r"(?<![\w.\-])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+", 0), F.lit("")), F.col(author_col), F.lit("")))
    line = F.lower(F.regexp_replace("line", r"^[>|\s]+|\s+$", ""))
    lines = (
        mails.where((F.trim(thread_col) != "") & (F.col(text_col) != "") & F.col(time_col).isNotNull())
        .select(id_col, F.col(thread_col).alias("thread"), author.alias("author"), F.col(time_col).alias("at"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
        .where(F.length("line") >= LEAST_SIGNS)
        .select(id_col, F.xxhash64("thread", line).alias("line"), F.xxhash64("author").alias("author"), "at", "n")
    )
    first = lines.groupBy("line").agg(F.min(F.struct("at", "author")).alias("first"), F.max("at").alias("last")).where("first.at < last").select("line", "first")
    return lines.join(first, "line").where((F.col("first.at") < F.col("at")) & (F.col("first.author") != F.col("author"))).groupBy(id_col).agg(F.collect_set("n").alias("old"))


def new_lines(mails: DataFrame, *, id_col: str = "_id", text_col: str = "content", thread_col: str | None = "parents", author_col: str = "sender", time_col: str = "timestamp") -> DataFrame:
    """``(id_col, line_no, line)`` of each line written anew.

    ``thread_col``: the thread of a mail; None judges every mail alone.
    """
    some = mails.where(F.col(text_col) != "").select(id_col, text_col).limit(SAMPLE).collect()
    if thread_col is None:
        rows = mails.select(id_col, text_col, F.array().cast("array<int>").alias("old"))
        known = {}
    else:
        old = cut(old_lines(mails, id_col=id_col, text_col=text_col, thread_col=thread_col, author_col=author_col, time_col=time_col))
        rows = mails.select(id_col, text_col).join(old, id_col, "left").select(id_col, text_col, "old")
        known = {r[0]: r[1] for r in old.where(F.col(id_col).isin([r[0] for r in some])).collect()} if some else {}  # SAMPLE rows at most
    model = self_trained([(r[1], known.get(r[0])) for r in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, nos, texts = [], [], []
            for i, (text, old) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if not text:
                    continue
                lines = text.split("\n")
                for n, (label, line) in enumerate(zip(model.labels(lines, set(old or ())), lines, strict=True), 1):
                    if label == "new":
                        at.append(i)
                        nos.append(n)
                        texts.append(line)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], names=[id_col, "line_no", "line"])

    key = mails.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {key}, line_no int, line string")
