"""Speech transcripts into clean, ordered speaker turns.

Method: a semi-Markov conditional model over the cues of a transcript, taken by their
time. A segment is a whole turn of one speaker; its score adds up how well the labels of
its cues fit the speaker, the pause before it, the lexical continuity across its border,
whether its first cue has a label, and how many cues it spans. Neighbouring segments have
different speakers. The weights are fitted by conditional likelihood on transcripts whose
labels are sure (full names throughout), after their labels were shortened and left out
as often as in the sample. The segmental Viterbi search runs for every transcript and is
linear in its cues: segments of :data:`SPAN` cues or more share one weight. Hesitation
sounds and sound notes are removed when the turns are put together.

Speakers are the people behind the labels of the row: full names in any order or
case, given names, surnames, initials, roles in brackets and romanised spellings meet
in one key; the participants of the row and the table of people give the spellings.

Scale: one row is one transcript; no shuffle but the anti-join with cut rows. The
table of people is small (checked) and goes with the tasks. The weights are fitted on
the driver on :data:`SAMPLE` transcripts at most, the first of the table; every
transcript is decoded.

Defined cases: null, empty and cue-less texts give no turn; cues of equal time keep
their order in the text; a first cue without label has an unknown speaker; repeated
rows give their turns once for each row; without any surely labelled transcript the
weights stay at :data:`START`; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import bounded_rows

PEOPLE_LIMIT = 50_000

#: Transcripts that the weights are fitted on at most; longer ones than ``SAMPLE_CUES`` are decoded but not fitted on.
SAMPLE, SAMPLE_CUES = 300, 60
#: Cues from which the length of a turn makes no difference; steps and L2 penalty of the fitting.
SPAN, STEPS, PENALTY = 6, 80, 0.002

#: How a label fits a speaker: no label, the full name, a part of a name that other labels give in full,
#: a part of a listed participant's name, not at all.
NONE, FULL, PART, LISTED, MISFIT = range(5)
#: Features of a border between turns after the change itself.
BORDER = ("change", "no label", "pause over 3 s", "pause over 8 s", "shared words", "sentence goes on")
#: Weights before any fitting, in the order of the fits, the border and the spans.
START = np.array([0.0, 3.0, 1.5, 0.5, -3.0, -1.0, -3.0, 0.2, 0.2, -0.2, -0.2, *[0.0] * SPAN])

# Forms of cues, hesitation sounds and sound notes.
_TIMING = re.compile(r"^(?:(\d+):)?(\d\d):(\d\d)(?:[.,](\d{1,3}))?\s*-->")
_BLOCK = re.compile(r"^(?:(.{1,60}?)\s*)?\((?:(\d+):)?(\d\d):(\d\d)\)$")
_LINE = re.compile(r"^\[?(?:(\d+):)?(\d\d):(\d\d)(?:[.,]\d+)?\]?\s+(?:([^:：\n]{1,60}?)\s*[:：]\s*|(.{1,60}?) - )?(.*)$")
_VOICE = re.compile(r"^<v\s+([^>]+)>(.*?)(?:</v>)?$")
_LABEL = re.compile(r"^([^:：<>\n]{1,60}?)\s*[:：]\s*(.*)$")
_NOTE = re.compile(r"\(\([^()\n]*\)\)|\[[^\[\]\n]*\]|\([^()\n]*\)|(?<!\S)\*[^*\n]+\*|[♪♫][^♪♫\n]*[♪♫]|[♪♫]")
_SOUND = re.compile(r"(?i)^[(\"']*(?:u+h*m+|u+h+|e+r+m*|e+h+m*|a+h*m+|h+m+|m{2,}|えーと|えっと|あのー|うーん)[-,.!?…;:)\"']*$")
_ROLE = re.compile(r"\s*[(\[（][^()\[\]（）]*[)\]）]\s*")


# Titles before names.
TITLES = {"mr", "mrs", "ms", "mx", "dr", "prof"}


def romaji(people: list[tuple[str, str]]) -> dict[str, str]:
    """Kanji parts of names to the parts of their addresses: surname first, ``given.surname@``."""
    out: dict[str, str] = {}
    for name, email in people:
        parts = re.split(r"[\s　]+", (name or "").strip())
        local = (email or "").split("@")[0].lower().split(".")
        if len(parts) == 2 == len(local) and re.search(r"[぀-鿿]", parts[0]):
            out[parts[0]], out[parts[1]] = local[1], local[0]
    return out


def label_key(label: str, kana: dict[str, str]) -> tuple[str, ...]:
    """Sorted parts of a label; parts of one letter stand for an initial."""
    text = _ROLE.sub(" ", label)
    text = re.sub(r"(?:様|さん|氏)$", "", text.strip())
    parts = [q for p in re.split(r"[\s　,]+", text) if (q := p.strip(".").casefold()) and q not in TITLES]
    if len(parts) == 1 and parts[0] not in kana and re.fullmatch(r"[぀-鿿]{3,6}", parts[0]):
        for i in range(1, len(parts[0])):
            if parts[0][:i] in kana and parts[0][i:] in kana:
                parts = [parts[0][:i], parts[0][i:]]
                break
    return tuple(sorted(kana.get(p, p) for p in parts))


def _seconds(h: str | None, m: str, s: str, ms: str | None = None) -> float:
    return int(h or 0) * 3600 + int(m) * 60 + int(s) + (int(ms.ljust(3, "0")) / 1000 if ms else 0.0)


def words(text: str) -> list[str]:
    """Words spoken: without sound notes and hesitation sounds."""
    return [w for w in _NOTE.sub(" ", text).split() if not _SOUND.match(w)]


def cues(text: str, known: set[str], kana: dict[str, str]) -> list[tuple[float, str | None, list[str]]]:
    """(start, label, words) of the cues in the order of the text."""
    out: list[tuple[float, str | None, list[str]]] = []
    start: float | None = None
    label: str | None = None
    lines: list[tuple[str | None, str]] = []
    timed = False  # inside a cue whose lines follow its time

    def close() -> None:
        nonlocal lines
        if start is None:
            lines = []
            return
        kept: list[tuple[str | None, str]] = []
        for lab, t in lines:
            if kept:
                lab0, t0 = kept[-1]
                if lab in (lab0, None) and (t.startswith(t0) or _NOTE.sub("", t).strip().startswith(_NOTE.sub("", t0).strip() or "\0")):
                    kept[-1] = (lab0, t)
                    continue
                if lab is None or lab == lab0:
                    kept[-1] = (lab0, f"{t0} {t}")
                    continue
            kept.append((lab, t))
        for lab, t in kept or [(label, "")]:
            out.append((start, lab if lab is not None else label, words(t)))
        lines = []

    for line in text.split("\n"):
        line = line.strip().strip("​﻿")
        if not line:
            if timed and lines:
                close()
                start, label, timed = None, None, False
            continue
        if m := _TIMING.match(line):
            if timed:
                close()
            start, label, timed = _seconds(*m.groups()), None, True
        elif (m := _BLOCK.match(line)) and not re.search(r"[.?!]$", m[1] or ""):
            if timed:
                close()
            start, label, timed = _seconds(m[2], m[3], m[4]), m[1], True
        elif not timed and (m := _LINE.match(line)):
            out.append((_seconds(m[1], m[2], m[3]), m[4] or m[5], words(m[6])))
        elif timed:
            if m := _VOICE.match(line):
                lines.append((m[1], m[2]))
            elif (m := _LABEL.match(line)) and (k := label_key(m[1], kana)) and len(k) <= 4 and all(len(p) == 1 or p in known for p in k):
                lines.append((m[1], m[2]))
            else:
                lines.append((None, line.replace("</v>", "")))
    if timed:
        close()
    return out


def _fits(key: tuple[str, ...], speaker: tuple[str, ...]) -> bool:
    """Whether the parts of a label are parts, or initials of parts, of a name."""
    rest = list(speaker)
    for p in sorted(key, key=len, reverse=True):
        hit = next((q for q in rest if (q == p if len(p) > 1 else q.startswith(p))), None)
        if hit is None:
            return False
        rest.remove(hit)
    return True


def _is_full(key: tuple[str, ...]) -> bool:
    return len(key) > 1 and all(len(p) > 1 for p in key)


def participants(names: str | None, kana: dict[str, str]) -> list[tuple[str, ...]]:
    return [label_key(n.strip("\"' "), kana) for n in re.split(r"[;|、／/\n\t]+|,(?=\s*\S+[\s　]\S)|\s&\s|\sand\s", names or "") if n.strip("\"' ")]


def fits(keys: list[tuple[str, ...] | None], present: list[tuple[str, ...]]) -> tuple[list[tuple[str, ...]], list[list[int]]]:
    """Speakers of a transcript, and for each cue how its label fits each of them."""
    given = {k for k in keys if k}
    full = {k for k in given if _is_full(k)}
    speakers = set(full)
    kinds: dict[tuple[str, ...], dict[tuple[str, ...], int]] = {k: {k: FULL} for k in full}
    listed = {p for p in present if _is_full(p) and not any(_fits(p, f) for f in full)}
    for k in given - full:
        kinds[k] = {s: PART for s in full if _fits(k, s)} or {s: LISTED for s in listed if _fits(k, s)}
        speakers |= kinds[k].keys()
    # what nothing names in full is a speaker of its own, or the longer label that holds it
    for k in sorted(k for k in given if not kinds[k]):
        longer = [o for o in given if len(o) > len(k) and _fits(k, o)]
        if len(longer) == 1 and kinds[longer[0]]:
            kinds[k] = {s: PART for s in kinds[longer[0]]}
        else:
            kinds[k] = {longer[0] if len(longer) == 1 else k: PART}
            speakers |= kinds[k].keys()
    order = sorted(speakers) or [("",)]
    rows = {k: [found.get(s, MISFIT) for s in order] for k, found in kinds.items()}
    none = [NONE] * len(order)
    return order, [rows[k] if k else none for k in keys]


def borders(rows: list[tuple[float, tuple[str, ...] | None, list[str]]]) -> list[tuple[int, ...]]:
    """Features of a border before each cue, in the order of :data:`BORDER`."""
    out = []
    for k, (start, key, spoken) in enumerate(rows):
        before, _, said = rows[k - 1] if k else (start, None, [])
        pause = start - before
        shared = not {w.lower() for w in spoken[:4]}.isdisjoint(w.lower() for w in said[-4:])
        goes_on = bool(said and spoken) and said[-1][-1] not in ".?!。" and spoken[0][0].islower()
        out.append((1, key is None, pause > 3, pause > 8, shared, goes_on))
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top[~np.isfinite(top)] = 0.0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit(examples: list[tuple[list[list[int]], list[tuple[int, ...]], list[int]]]) -> np.ndarray:
    """Weights of greatest conditional likelihood with L2: (fits, borders, speaker of each cue) of each transcript.

    A turn of n cues passes the phases 1 to n, at most :data:`SPAN`, so that forward and
    backward sums over whole segments need one pass each, for all transcripts together.
    """
    examples = [x for x in examples if x[2]]
    if not examples:
        return START.copy()
    count, cues_, people_ = len(examples), max(len(x[2]) for x in examples), max(len(x[0][0]) for x in examples)
    kind = np.full((count, cues_, people_), -1)
    border = np.zeros((count, cues_, len(BORDER)))
    size = np.array([len(x[2]) for x in examples])
    seen = np.zeros(len(START))
    for b, (f, at, who) in enumerate(examples):
        kind[b, : len(f), : len(f[0])] = f
        border[b, : len(at)] = at
        run = 0
        for t, s in enumerate(who):
            seen[f[t][s]] += 1
            if t and who[t - 1] != s:
                seen[5:11] += at[t]
                seen[11 + min(run, SPAN) - 1] += 1
                run = 0
            run += 1
        seen[11 + min(run, SPAN) - 1] += 1
    one_hot = (kind[..., None] == np.arange(5)).astype(float)
    absent = np.where(kind < 0, -np.inf, 0.0)
    other = np.where(np.eye(people_, dtype=bool), -np.inf, 0.0)
    last = size - 1
    w, m, v = START.copy(), np.zeros(len(START)), np.zeros(len(START))
    for step in range(1, STEPS + 1):
        emit, change, span = one_hot @ w[:5] + absent, border @ w[5:11], w[11:]
        ahead = np.full((cues_, count, people_, SPAN), -np.inf)
        ahead[0, :, :, 0] = emit[:, 0]
        for t in range(1, cues_):
            ends = _lse(ahead[t - 1] + span, 2)
            ahead[t, :, :, 0] = _lse(ends[:, None, :] + other, 2) + change[:, t, None] + emit[:, t]
            ahead[t, :, :, 1:] = ahead[t - 1, :, :, :-1] + emit[:, t, :, None]
            ahead[t, :, :, -1] = np.logaddexp(ahead[t, :, :, -1], ahead[t - 1, :, :, -1] + emit[:, t])
        total = _lse(_lse(ahead[last, np.arange(count)] + span, 2), 1)
        want = np.zeros(len(w))
        behind = np.broadcast_to(span, (count, people_, SPAN))
        for t in range(cues_ - 1, -1, -1):
            final, inside = (last == t)[:, None, None], (last > t)[:, None, None]
            if t < cues_ - 1:
                coming = behind + emit[:, t + 1, :, None]
                into = _lse(coming[:, None, :, 0] + other, 2) + change[:, t + 1, None]
                leave = span + into[:, :, None]
                stay = np.concatenate([coming[:, :, 1:], coming[:, :, -1:]], axis=2)
                behind = np.where(final, span, np.logaddexp(leave, stay))
                with np.errstate(invalid="ignore"):
                    left = np.where(inside, np.exp(ahead[t] + leave - total[:, None, None]), 0.0)
                want[11:] += left.sum((0, 1))
            with np.errstate(invalid="ignore"):
                p = np.where(final | inside, np.exp(ahead[t] + behind - total[:, None, None]), 0.0)
            p = np.nan_to_num(p)
            want[11:] += np.where(final, p, 0.0).sum((0, 1))
            want[:5] += np.einsum("bs,bsk->k", p.sum(2), one_hot[:, t])
            if t:
                want[5:11] += p[:, :, 0].sum(1) @ border[:, t]
        g = (seen - np.nan_to_num(want)) / count - PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def segment(kinds: list[list[int]], at: list[tuple[int, ...]], weights: list[float]) -> list[int]:
    """Segmental Viterbi: the speaker of each cue."""
    fit_, change_, span = weights[:5], weights[5:11], weights[11:]
    everyone, phases = range(len(kinds[0])), range(SPAN)
    none = -1e18
    best = [[fit_[k], *[none] * (SPAN - 1)] for k in kinds[0]]
    begun: list[list[int]] = [[-1] * len(best)]  # speaker before a turn that begins here
    ended: list[list[int]] = []  # best phase of a turn that ends here
    longer: list[list[bool]] = [[False] * len(best)]  # whether a turn of SPAN cues or more had so many before
    for t in range(1, len(kinds)):
        phase = [max(phases, key=lambda k, b=b: b[k] + span[k]) for b in best]
        ends = [b[k] + span[k] for b, k in zip(best, phase, strict=True)]
        first = max(everyone, key=ends.__getitem__)
        second = max((s for s in everyone if s != first), key=ends.__getitem__, default=-1)
        change = sum(w for w, f in zip(change_, at[t], strict=True) if f)
        now, begin, long = [], [], []
        for s in everyone:
            e, b = fit_[kinds[t][s]], best[s]
            before = second if s == first else first
            begin.append(before)
            long.append(b[-1] > b[-2])
            now.append([(ends[before] + change + e) if before >= 0 else none, *(x + e for x in b[:-2]), max(b[-2], b[-1]) + e])
        best = now
        begun.append(begin)
        ended.append(phase)
        longer.append(long)
    phase = [max(phases, key=lambda k, b=b: b[k] + span[k]) for b in best]
    s = max(everyone, key=lambda s: best[s][phase[s]] + span[phase[s]])
    k, out = phase[s], []
    for t in range(len(kinds) - 1, -1, -1):
        out.append(s)
        if k == 0 and t:
            s = begun[t][s]
            k = ended[t - 1][s]
        elif t:
            k = SPAN - 1 if k == SPAN - 1 and longer[t][s] else k - 1
    return out[::-1]


def _rows(text: str, known: set[str], kana: dict[str, str]) -> list[tuple[float, tuple[str, ...] | None, list[str]]]:
    found = sorted(enumerate(cues(text, known, kana)), key=lambda x: (x[1][0], x[0]))
    return [(start, (label_key(label, kana) or None) if label and label.strip() else None, spoken) for _, (start, label, spoken) in found]


def examples(sample: list[tuple[str | None, str | None]], known: set[str], kana: dict[str, str]) -> list[tuple[list[list[int]], list[tuple[int, ...]], list[int]]]:
    """What :func:`fit` takes, from the (text, names) whose labels are sure, shortened and left out as in the sample."""
    all_rows = [(_rows(text, known, kana), participants(names, kana)) for text, names in sample if text]
    keys = [k for rows, _ in all_rows for _, k, _ in rows]
    partial = sum(bool(k) and not _is_full(k) for k in keys) / max(1, len(keys))
    left_out = sum(k is None for k in keys) / max(1, len(keys))
    rng = random.Random(len(keys))
    out = []
    for rows, present in all_rows:
        true = [k for _, k, _ in rows]
        if not 1 < len(rows) <= SAMPLE_CUES or not all(k and _is_full(k) for k in true):
            continue
        only_short = {k for k in set(true) if k in present and rng.random() < partial}  # never named in full
        shown: list[tuple[str, ...] | None] = []
        for t, k in enumerate(true):
            if t and true[t - 1] == k and rng.random() < min(0.9, 3 * left_out):
                shown.append(None)
            elif k in only_short or rng.random() < partial:
                keep = rng.randrange(len(k))
                shown.append(tuple(sorted(p if i == keep else p[0] for i, p in enumerate(k))) if rng.random() < 0.3 else (k[keep],))
            else:
                shown.append(k)
        speakers, kinds = fits(shown, present)
        if not set(true) <= set(speakers):
            continue
        masked = [(start, k, spoken) for (start, _, spoken), k in zip(rows, shown, strict=True)]
        out.append((kinds, borders(masked), [speakers.index(k) for k in true]))
    return out


def turns(text: str | None, names: str | None, known: set[str], kana: dict[str, str], weights: list[float] | None = None) -> list[tuple[int, str, list[str]]]:
    """(speaker_no, speaker, words) of each turn in order."""
    if not text:
        return []
    present = participants(names, kana)
    rows = _rows(text, known | {p for k in present for p in k}, kana)
    if not rows:
        return []
    first = next((i for i, (_, k, _) in enumerate(rows) if k), len(rows))  # cues before the first label have an unknown speaker
    who: list[tuple[str, ...]] = [("",)] * first
    if first < len(rows):
        speakers, kinds = fits([k for _, k, _ in rows[first:]], present)
        who += [speakers[s] for s in segment(kinds, borders(rows[first:]), START.tolist() if weights is None else weights)]
    out: list[tuple[int, str, list[str]]] = []
    number: dict[tuple[str, ...], int] = {}
    last = None
    for s, (_, _, spoken) in zip(who, rows, strict=True):
        if not spoken:
            continue
        if s == last:
            out[-1][2].extend(spoken)
        else:
            out.append((number.setdefault(s, len(number) + 1), " ".join(s), list(spoken)))
            last = s
    return out


def speaker_turns(transcripts: DataFrame, people: DataFrame, *, id_col: str = "_id", text_col: str = "content", name_col: str = "name", sample: DataFrame | None = None) -> DataFrame:
    """``(id_col, turn, speaker_no, speaker, n_words, text)`` of each turn of each row.

    ``sample``: transcripts to fit the weights on, ``transcripts`` themselves by default.
    """
    rows = bounded_rows(people.select("name", "email"), PEOPLE_LIMIT, "people")
    kana = romaji([(r["name"], r["email"]) for r in rows])
    known = {p for r in rows if r["name"] for p in label_key(r["name"], kana)}
    chosen = (transcripts if sample is None else sample).where(F.col(text_col) != "").select(text_col, name_col).limit(SAMPLE).collect()
    weights = fit(examples([(r[0], r[1]) for r in chosen], known, kana)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = [], []
            cols: tuple[list, ...] = ([], [], [], [], [])
            for i, (text, names) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for t, (no, who, spoken) in enumerate(turns(text, names, known, kana, weights), 1):
                    at.append(i)
                    for c, v in zip(cols, (t, no, who, len(spoken), " ".join(spoken)), strict=True):
                        c.append(v)
            ids = b.column(0).take(pa.array(at, pa.int64()))
            types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, "turn", "speaker_no", "speaker", "n_words", "text"])

    key = transcripts.schema[id_col].dataType.simpleString()
    return transcripts.select(id_col, text_col, name_col).mapInArrow(run, f"`{id_col}` {key}, turn int, speaker_no int, speaker string, n_words int, text string")
