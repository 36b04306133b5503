"""Personal information inside free text: found, replaced by placeholders or surrogates.

Detection: addresses, telephone and identity numbers and street addresses by their
formats; names of persons by the parts of the names in the table of people, by titles,
mentions, greetings, mail headers and speaker labels, in Latin and Japanese script.

Method of replacement: surrogate generation. A keyed hash (BLAKE2 with a secret) turns
each value into another of its type: digits into digits and letters into letters at the
same places, names part by part into pronounceable names of the same script and case, given
names into names that end as names of their gender do where it is known (lists of common
given names; the last sign of Japanese ones; others are neutral), streets into streets with the same form. The same part always gets the
same surrogate, so "Ms Hill", "Anna Hill" and "Anna" still belong together
(coreference). Distinct parts of names, and distinct values of other kinds, that meet in
one surrogate are found by a grouping over all of them and told apart by further rounds
of the hash until none meet (distinctness); the salts found are joined back to the
places in the texts. Initials go round a keyed circle of letters and can't meet.

Scale: texts are searched once, without shuffle; the table of people is small (checked)
and goes with the tasks. Only distinct values are grouped for the collision check. For
surrogates the texts and places are written and read again, and only places whose salt
is not 0 are joined to their rows.

Defined cases: null and empty fields have no value and stay as they are; where matches
overlap the longer one stands; equal values of one field and kind are reported once;
a value cut off by a field limit counts as far as it still has its form. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.turns import _ROLE, TITLES, romaji
from tallyloom.llm.variants import _LEGAL_FORMS, PEOPLE_LIMIT
from tallyloom.session import bounded_rows, cut, workdir

KINDS = ("email", "phone", "id_number", "address", "name")

# Forms of addresses, numbers and streets.
_EMAIL = re.compile(r"(?<![A-Za-z0-9_%+\-])[A-Za-z0-9_%+\-]+(?:\.[A-Za-z0-9_%+\-]+)*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_EMAIL_WORDS = re.compile(
    r"(?<![A-Za-z0-9._%+\-@])[a-z0-9_%+\-]+(?:(?:\.| ?[\[(]dot[\])] ?| dot )[a-z0-9_%+\-]+)*(?:@| ?\[at\] ?| ?\(at\) ?|＠| at )[a-z][a-z0-9\-]*(?:(?:\.| ?[\[(]dot[\])] ?| dot )[a-z][a-z0-9\-]*)*(?:\.| ?[\[(]dot[\])] ?| dot )[a-z]{2,}(?![A-Za-z0-9]| ?\[at\]| ?\(at\)| ?@| at [a-z0-9\-]+(?:\.| dot )[a-z])"
)
_NUMBER = re.compile(
    r"(?P<phone>\+\d{1,3}(?:[ .\-/]?\(0\))?(?:[ .\-/]?\d{1,8}){2,5}(?!\d)|(?<![\d\-/.])(?!\d{4} \d{4} \d{4}(?!\d))00\d{1,3}(?:[ \-]\d{1,8}){2,5}(?![\d\-])|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d\-/.,])0(?:\d{1,4}/\d{6,9}|\d{1,2} \d{3,4} \d{4}|\d{3} \d{3} \d{3,4}|\d{1,4}-\d{2,4}-\d{4})(?![\d\-]))"
    r"|(?P<id_number>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])|(?<![A-Za-z])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{2}\d{7}(?!\d)|(?<![\d\-])\d{2}-\d{4}-\d{6}(?![\d\-])|(?<![\d ,.\-])\d{4} \d{4} \d{4}(?! ?\d)|(?<![\d,.\-])(?<!\d )\d{4} \d{4} \d{4}(?! ?\d)|(?<![\d\-])(?<!\bref )\d{12}(?!\d))"
)
_DIGITS = re.compile(r"\d(?:[ ()./\-]{0,3}\d){5,}")
_STREETS = ("Street", "St.", "St", "Road", "Rd.", "Rd", "Lane", "Ln.", "Avenue", "Ave.", "Ave", "Way", "Close", "Drive", "Court", "Crescent", "Terrace", "Square", "Place", "Boulevard", "Blvd.", "Blvd")
_NUMBERED_AFTER = ("Street", "Road", "Lane", "Avenue", "Way", "Close", "Drive", "Court")
_STRASSEN = ("straße", "strasse", "weg", "gasse", "platz", "allee", "ufer", "ring", "damm", "markt")
_LAGEN = ("Am", "An der", "An den", "Im", "In der", "Auf dem", "Zum", "Zur", "Unter den", "Hinter dem")
_DIRECTIONS = "(?:(?:North|South|East|West|Old|New|Upper|Lower|Great|Little) )?"
_SUFFIX = "(?:" + "|".join(map(re.escape, _STREETS)) + ")"
_LAGE = "(?:" + "|".join(_LAGEN) + ")"
_STRASSE = "(?:" + "|".join(_STRASSEN) + ")"
#: Forms of addresses, each with pieces of which every match of the form holds one.
_ADDRESSES = (
    (tuple(dict.fromkeys(" " + w.rstrip(".") for w in _STREETS)), re.compile(r"(?<![\w\-/.,])\d{1,4}[a-z]? " + _DIRECTIONS + r"[A-Z][\w'\-]+(?: [A-Z][\w'\-]+)? " + _SUFFIX + r"(?!\w)")),
    (tuple(f" {w} " for w in _NUMBERED_AFTER), re.compile(r"(?<!\w)" + _DIRECTIONS + r"[A-Z][\w'\-]+ (?:" + "|".join(_NUMBERED_AFTER) + r") \d{1,4}[a-z]?(?![\w\-])")),
    (tuple(f"{w} " for w in _STRASSEN), re.compile(r"(?<!\w)[A-ZÄÖÜ][a-zäöüß\-]*" + _STRASSE + r" \d{1,4}[a-z]?(?![\w\-.])")),
    (tuple(f"{w} " for w in _LAGEN), re.compile(r"(?<!\w)" + _LAGE + r" (?:[A-ZÄÖÜ][\w\-]+ )?[A-ZÄÖÜ][a-zäöüß\-]+ \d{1,4}[a-z]?(?![\w\-.])")),
    (("市", "区"), re.compile(r"[㐀-鿿]{1,6}[市区][㐀-鿿々ヶケノァ-ヺー]{1,10}\d+(?:[-－−]\d+){1,3}")),
)
_W = "[A-Za-zÀ-ÖØ-öø-ÿĀ-ž'’\\-]"
_CAPS = re.compile(rf"(?<![A-Za-z0-9_@./\-À-ÿ])@?[A-ZÀ-ÖØ-Þ]{_W}*\.?(?:[ \u3000]{{1,2}}[A-ZÀ-ÖØ-Þ]{_W}*\.?)*|@[A-ZÀ-ÖØ-Þ]{_W}*(?: [A-ZÀ-ÖØ-Þ]{_W}*)?")
_TITLE = re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Mx|Dr|Prof)\.? ([A-ZÀ-ÖØ-Þ]{_W}+(?: [A-ZÀ-ÖØ-Þ]{_W}+)?)")
_LABELS = re.compile(r"^(?:\[?(?:\d+:)?\d\d:\d\d(?:[.,]\d+)?\]?[ \t]+([^:：\n]{1,60}?)(?:[:：]| - )|<v ([^>\n]+)>|(.{1,60}?) \((?:\d+:)?\d\d:\d\d\)$|([^:：<>\n]{1,60}?)[:：])", re.M)
_PART = re.compile(r"[^ \u3000]+")
_STREET_WORD = re.compile(_SUFFIX + r"$")
# Words that stand before a name at the beginning of a sentence or line.
_BEFORE_NAMES = {"ask", "hi", "hello", "hey", "dear", "morning", "afternoon", "evening", "with", "from", "by", "cc", "thanks", "regards", "cheers", "owner", "contact", "re", "fwd", "aw"}
_NO_SURNAME = {"the", "i", "a", "an", "is", "it", "we", "you", "they", "he", "she", "please", "could", "can", "did", "are", "in", "on", "at", "to", "and", "or", "of", "for", "my", "her", "his", "our", "about", "let", "ltd", "inc", "llc", "gmbh"}


@lru_cache(maxsize=100_000)
def fold(word: str) -> str:
    t = unicodedata.normalize("NFKC", word).casefold()
    return t.rstrip(".")


class Finder:
    """Finds personal information; holds the parts of the names of the people."""

    def __init__(self, people: list[tuple[str, str]]):
        kana = romaji(people)
        given, surname, japanese, japanese_given = set(), set(), set(), set()
        for name, _ in people:
            parts = re.split(r"[\s\u3000]+", (name or "").strip())
            if len(parts) != 2 or _LEGAL_FORMS.search(name) or fold(parts[1]) in {"llc", "ltd", "inc", "gmbh", "k.k"}:
                continue
            if re.search(r"[぀-鿿]", name):
                japanese.add(parts[0])
                japanese_given.add(parts[1])
            else:
                given.add(fold(parts[0]))
                surname.add(fold(parts[1]))
        for k, r in kana.items():
            (surname if k in japanese else given).add(r)
        self.given, self.surname = given, surname
        self.parts = given | surname
        if japanese:
            s = "|".join(sorted(map(re.escape, japanese), key=len, reverse=True))
            g = "|".join(sorted(map(re.escape, japanese_given), key=len, reverse=True))
            self.kanji = re.compile(rf"(?<![㐀-鿿])(?:{s})[ \u3000]?(?:{g})|(?<![㐀-鿿])(?:{s})(?![㐀-鿿]{{2}}|[市区町村支店営])|(?<![㐀-鿿])(?:{g})(?=さん|様|氏|くん|ちゃん)")
        else:
            self.kanji = None

    def _in_a_place(self, tokens: list[tuple[int, str]], k: int) -> bool:
        """Whether a surname alone is part of another name: "Oak Hill", "Stone Road"."""
        if k + 1 < len(tokens) and (_STREET_WORD.match(tokens[k + 1][1]) or fold(tokens[k + 1][1]) in self.given):
            return fold(tokens[k + 1][1]) not in self.given
        if k == 0:
            return False
        before = fold(tokens[k - 1][1])
        return before not in self.parts and before not in TITLES and before not in _BEFORE_NAMES and before not in _NO_SURNAME

    def names(self, text: str, transcript: bool) -> Iterator[tuple[int, int]]:
        given, surname = self.given, self.surname
        for m in _CAPS.finditer(text):
            at = m.start()
            run = m[0]
            if run[0] == "@":
                at += 1
                run = run[1:]
            if " " not in run and "\u3000" not in run:
                f = fold(run)
                if f in given or f in surname:
                    yield at, at + len(run.rstrip("."))
                continue
            tokens = [(at + t.start(), t[0]) for t in _PART.finditer(run)]
            k, n = 0, len(tokens)
            while k < n:
                start, word = tokens[k]
                f = fold(word)
                known_given, known_surname = f in given, f in surname
                end = start + len(word)
                if not (known_given or known_surname):
                    # an initial before a surname
                    if len(f) == 1 and word.endswith(".") and k + 1 < n and fold(tokens[k + 1][1]) in surname:
                        end = tokens[k + 1][0] + len(tokens[k + 1][1].rstrip("."))
                        yield start, end
                        k += 2
                        continue
                    k += 1
                    continue
                if word.endswith("."):
                    yield start, end - 1
                    k += 1
                    continue
                if not known_given and self._in_a_place(tokens, k):
                    k += 1
                    continue
                if k + 1 < n:
                    start2, word2 = tokens[k + 1]
                    f2 = fold(word2)
                    end2 = start2 + len(word2.rstrip("."))
                    if (known_given and f2 in surname) or (known_surname and f2 in given):
                        yield start, end2
                        k += 2
                        continue
                    if len(f2) == 1 and (word2.endswith(".") or text[end2 : end2 + 1] in ":：>(" or text[end2 : end2 + 2] in (" (", " -", " [")):
                        yield start, end2
                        k += 2
                        continue
                    if known_given and not known_surname and k + 2 == n and len(f2) > 2 and f2 not in _NO_SURNAME and m[0][0] != "@" and word2[1:] == word2[1:].lower():
                        yield start, end2
                        k += 2
                        continue
                yield start, end
                k += 1
        if "r " in text or "s " in text or "x " in text or ". " in text:
            for m in _TITLE.finditer(text):
                first, _, second = m[1].partition(" ")
                whole = second and (fold(first) in given or fold(second) in surname)
                yield m.start(1), m.start(1) + len(m[1] if whole else first)
        if self.kanji and not text.isascii():
            for m in self.kanji.finditer(text):
                yield m.span()
        if transcript:
            for m in _LABELS.finditer(text):
                label = next((g for g in m.groups() if g), "")
                bare = _ROLE.sub("", label).strip()
                tokens = re.split(r"[ \u3000]+", bare)
                if bare and len(tokens) <= 3 and all(len(fold(t)) == 1 or fold(t) in self.parts for t in tokens) and any(len(fold(t)) > 1 for t in tokens):
                    at = m.start() + m[0].index(bare)
                    yield at, at + len(bare.rstrip("."))

    def find(self, text: str, transcript: bool = False) -> list[tuple[int, int, str]]:
        """Spans (start, end, kind) in order, without overlaps."""
        spans: list[tuple[int, int, str]] = []
        if "@" in text:
            spans += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
        if " at " in text or "at]" in text or "at)" in text or "＠" in text or " dot " in text or "dot]" in text or "dot)" in text:
            spans += [(m.start(), m.end(), "email") for m in _EMAIL_WORDS.finditer(text)]
        at = 0
        for d in _DIGITS.finditer(text):
            # a number begins a few characters before its digits at most
            for m in _NUMBER.finditer(text, max(at, d.start() - 6), min(len(text), d.end() + 6)):
                spans.append((m.start(), m.end(), m.lastgroup))
                at = m.end()
        for pieces, form in _ADDRESSES:
            for p in pieces:
                if p in text:
                    spans += [(m.start(), m.end(), "address") for m in form.finditer(text)]
                    break
        spans += [(a, b, "name") for a, b in self.names(text, transcript)]
        if len(spans) < 2:
            return spans
        # formats before names, longer before shorter
        spans.sort(key=lambda s: (s[0], s[2] == "name", -s[1]))
        out: list[tuple[int, int, str]] = []
        for s in spans:
            if out and s[0] < out[-1][1]:
                last = out[-1]
                if (s[2] != "name") > (last[2] != "name") or ((s[2] != "name") == (last[2] != "name") and s[1] - s[0] > last[1] - last[0]):
                    out[-1] = s
                continue
            out.append(s)
        return out


def _finder(people: DataFrame) -> Finder:
    return Finder([(r["name"], r["email"]) for r in bounded_rows(people.select("name", "email"), PEOPLE_LIMIT, "people")])


def find_personal(df: DataFrame, people: DataFrame, *, id_col: str = "_id", fields: tuple[str, ...] = ("content", "subject"), transcript_col: str | None = None) -> DataFrame:
    """``(id_col, field, kind, value)``, a row for each distinct value of each field.

    ``transcript_col``: boolean column; where true the first field is a transcript with
    speaker labels.
    """
    finder = _finder(people)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            out: tuple[list, list, list] = ([], [], [])
            spoken = b.column(1).to_pylist()
            for f, name in enumerate(fields):
                for i, text in enumerate(b.column(2 + f).to_pylist()):
                    if not text:
                        continue
                    for kind, value in dict.fromkeys((k, text[s:e]) for s, e, k in finder.find(text, bool(spoken[i]) and f == 0)):
                        at.append(i)
                        for c, v in zip(out, (name, kind, value), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in out)], names=[id_col, "field", "kind", "value"])

    key = df.schema[id_col].dataType.simpleString()
    spoken = F.col(transcript_col) if transcript_col else F.lit(False)
    return df.select(id_col, spoken.alias("_spoken"), *fields).mapInArrow(run, f"`{id_col}` {key}, field string, kind string, value string")


#: Values whose surrogates a task keeps at hand.
CACHED = 50_000
# Syllables of surrogate names: a rule, not a list of names.
_ONSETS, _VOWELS, _CODAS = "bdfgklmnprstvz", "aeiou", ["", "n", "r", "l", "s"]
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CAPITALS_MARKED = "".join(c for c in map(chr, range(0xC0, 0x17F)) if c.isupper() and c.lower().upper() == c and len(c.lower()) == 1)
_STREET_NAME = re.compile(
    r"((?<!\w)" + _LAGE + r" (?:[A-ZÄÖÜ][\w\-]+ )?)[A-ZÄÖÜ][a-zäöüß\-]+"
    r"|[A-ZÄÖÜ][\w'\-]+(?= " + _SUFFIX + r")|[A-ZÄÖÜ][a-zäöüß\-]*?(?=" + _STRASSE + ")"
)
# Given names whose gender is commonly known, with common short forms; other names are neutral.
FEMALE = set(
    "abigail agnes alexandra alice amara anna anne barbara beatrice bianca camille carla caroline catherine charlotte christine clara claudia deborah delia diana dorothy eleanor elena elizabeth emily emma estelle eva farah florence greta hannah helen helene ilse ines irene iris jane jennifer johanna judith julia karen katherine kerstin laura linnea louise lucy margaret maria marta martha mary milena nadia nora olga olivia paloma pamela patricia paula priya rachel rebecca rosalind ruth sandra sara sarah selma sofia susan tamsin teresa vera victoria ximena yara "
    "liz beth kate kathy jen jenny maggie meg patty trish sue susie becky debbie vicky abby sandy".split()
)
MALE = set(
    "adam alexander andrew anthony anton basil benjamin carl cedric charles christopher daniel dario david dmitri edward emeka erik ewan felix florian frank frederick george gregory gustav henry hugo ivan jack jacob james john jonas jonathan jorge joseph karim kofi lawrence leopold luca lucas marco mark martin matthew michael nicholas oliver oskar otto paul peter philip raymond richard robert samuel simon stefan stephen steven theodore thomas timothy tomasz ulrich victor walter wendel william yusuf zoltan "
    "rob bob bobby rick rich dick will bill billy mike mick nick tom tommy chris dan danny ben sam joe joey ted ned matt greg tony jim jimmy dave steve tim jon chuck ray ron".split()
)
_ENDINGS = {"f": ("ina", "ella", "etta", "isa", "ika", "ora", "anna", "elia"), "m": ("ard", "ulf", "ander", "emar", "win", "etto", "is", "ek")}
_KANJI_ENDINGS = {"f": "子美香奈織恵里", "m": "郎夫男太樹平真"}
_KANJI_SURNAME, _KANJI_GIVEN = "青赤白石川木山田野原森林池島浜沢", "一二三子夫美明正和春夏秋冬幸光雪"


def _digest(secret: str, kind: str, text: str, salt: int) -> bytes:
    return hashlib.blake2b(f"{kind}\x1f{text}\x1f{salt}".encode(), key=secret.encode()[:64], digest_size=32).digest()


def gender(name: str) -> str:
    """f, m or "" for a given name, by the lists and by the last sign of Japanese names."""
    f = fold(name)
    if re.search(r"[㐀-鿿]", f):
        return next((g for g, signs in _KANJI_ENDINGS.items() if f[-1] in signs), "") if len(f) > 1 else ""
    return "f" if f in FEMALE else "m" if f in MALE else ""


def _word(d: bytes, like: str, salt: int = 0, kind: str = "") -> str:
    """A pronounceable word with the case of ``like``, ending like names of the gender ``kind``;
    longer after every eight salts, so that there is always room for one more.
    """
    out = []
    for k in range(min(2 + (len(like) > 5) + salt // 8, 10)):
        out.append(_ONSETS[d[3 * k] % 14] + _VOWELS[d[3 * k + 1] % 5] + _CODAS[d[3 * k + 2] % 5])
    word = "".join(out)
    if kind:
        word = re.sub(r"[aeiou][nrls]?$", "", word) + _ENDINGS[kind][d[20] % len(_ENDINGS[kind])]
    elif word[-1] in "aeiou":
        word += "nrls"[d[20] % 4]
    return word.upper() if like.isupper() and len(like) > 1 else word if like.islower() else word.capitalize()


@lru_cache(maxsize=1024)
def _initial(secret: str, letter: str) -> str:
    """The letter after ``letter`` on a keyed circle of its alphabet: no two letters meet and none stays."""
    alphabet = _CAPITALS if letter.isascii() else _CAPITALS_MARKED
    order = sorted(alphabet, key=lambda c: _digest(secret, "initial", c, 0))
    return order[(order.index(letter.upper()) + 1) % len(order)]


@lru_cache(maxsize=CACHED)
def _units(kind: str, value: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, key)`` of what is replaced as one: the parts of a name, else the whole value.

    Spellings with one key are one unit and get one salt.
    """
    if kind != "name":
        return [(0, len(value), kind, value.casefold() if kind == "email" else value if kind == "address" else re.sub(r"\W", "", value))]
    out = []
    for m in re.finditer(r"[^ \u3000]+", value):
        one = m[0].rstrip(".")
        if len(one) == 1 and one.upper() in _CAPITALS + _CAPITALS_MARKED:
            unit = "initial"
        else:
            unit = "given" if m.start() and re.search(r"[㐀-鿿]", m[0]) else "name"
        out.append((m.start(), m.end(), unit, fold(m[0])))
    return out


def _unit_surrogate(secret: str, unit: str, piece: str, salt: int) -> str:
    if unit == "initial":
        return _initial(secret, piece[0]) + piece[1:]
    if unit not in ("name", "given"):
        return _format_surrogate(secret, unit, piece, salt)
    d = _digest(secret, "name", fold(piece), salt)
    if re.search(r"[㐀-鿿]", piece):
        pool = _KANJI_GIVEN if unit == "given" else _KANJI_SURNAME
        if salt >= 8:
            return "".join(chr(0x4E00 + int.from_bytes(d[2 * (k % 16) : 2 * (k % 16) + 2], "big") % 20000) for k in range(len(piece)))
        made = "".join(pool[d[k % 32] % len(pool)] for k in range(len(piece)))
        kind = gender(piece) if unit == "given" else ""
        return made[:-1] + _KANJI_ENDINGS[kind][d[31] % 7] if kind else made
    return _word(d, piece, salt, gender(piece))


@lru_cache(maxsize=CACHED)
def surrogate(secret: str, kind: str, value: str, salt: int = 0) -> str:
    """Another value of the same type, script and format; always the same for the same value."""
    return _with_salts(secret, kind, value, [salt] * len(_units(kind, value)))


def _with_salts(secret: str, kind: str, value: str, salts: list[int]) -> str:
    out, at = [], 0
    for (start, end, unit, _), salt in zip(_units(kind, value), salts, strict=True):
        out += [value[at:start], _unit_surrogate(secret, unit, value[start:end], salt)]
        at = end
    return "".join([*out, value[at:]])


def _format_surrogate(secret: str, kind: str, value: str, salt: int) -> str:
    if kind == "email":
        d = _digest(secret, kind, value.casefold(), salt)
        m = re.match(r"(.+?)(@| ?\[at\] ?| ?\(at\) ?|＠| at )", value)
        local = m[1] if m else value
        new = re.sub(r"[A-Za-z0-9]+", lambda w: w[0] if w[0] == "dot" else _word(_digest(secret, "local", w[0].casefold() + d.hex()[:8], salt), w[0], salt).lower(), local)
        return new + (m[2] if m else "@") + ("mail dot example" if " dot " in value[len(local) :] else "mail.example")
    if kind == "address":
        d = _digest(secret, kind, value, salt)
        digits = iter(d[8:])
        number = re.sub(r"\d", lambda _: str(1 + next(digits, 0) % 9), value)
        if re.search(r"[㐀-鿿]", value):
            return re.sub(r"^[㐀-鿿]+(?=[市区])", lambda m: "".join(_KANJI_SURNAME[x % 16] for x in d[: len(m[0])]), number)
        return _STREET_NAME.sub(lambda m: (m[1] or "") + _word(d, m[0][len(m[1] or "") :], salt), number, count=1)
    # numbers keep punctuation, the country code and a leading zero
    d = _digest(secret, kind, re.sub(r"\W", "", value), salt)
    at = 0
    out = []
    head = re.match(r"\+\d{1,3}(?=\D)|00\d{2}|0", value) if kind == "phone" else None
    for i, c in enumerate(value):
        if c.isdigit() and not (head and i < head.end()):
            c = str(d[at % 32] % 10)
            at += 1
        elif c.isascii() and c.isupper():
            c = chr(65 + d[at % 32] % 26)
            at += 1
        out.append(c)
    return "".join(out)


_PIECES = "kind string, key string, piece string"
#: Places found in a row, and the units of their values: ``at`` is "span:unit".
_FOUND = "_spans array<struct<field: int, start: int, end: int, kind: string, value: string>>, _units array<struct<at: string, kind: string, key: string, piece: string>>"


def _found_arrays(found: list[list[tuple[int, int, int, str, str]]]) -> list[pa.Array]:
    """The columns of :data:`_FOUND` for the places of each row."""
    spans: tuple[list, ...] = ([], [], [], [], [])
    units: tuple[list, ...] = ([], [], [], [])
    span_ends, unit_ends = [0], [0]
    for row in found:
        for n, x in enumerate(row):
            for c, v in zip(spans, x, strict=True):
                c.append(v)
            for u, (start, end, unit, key) in enumerate(_units(x[3], x[4])):
                for c, v in zip(units, (f"{n}:{u}", unit, key, x[4][start:end]), strict=True):
                    c.append(v)
        span_ends.append(len(spans[0]))
        unit_ends.append(len(units[0]))

    def lists(columns: tuple[list, ...], names: list[str], types: list, ends: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names))

    return [
        lists(spans, ["field", "start", "end", "kind", "value"], [pa.int32()] * 3 + [pa.string()] * 2, span_ends),
        lists(units, ["at", "kind", "key", "piece"], [pa.string()] * 4, unit_ends),
    ]


def _salts(pieces: DataFrame, secret: str, rounds: int) -> DataFrame:
    """``(kind, key, salt)`` of the units of :data:`_PIECES` that need a salt above 0, so that no two
    units of a kind have one surrogate and none has that of a real unit.

    Rounds go on until nothing collides; if ``rounds`` do not suffice that is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, p, s = (b.column(i).to_pylist() for i in (0, 2, 3))
            made = [_units("name" if x in ("name", "given", "initial") else x, _unit_surrogate(secret, x, *y))[0][3] for x, *y in zip(k, p, s, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=["kind", "key", "piece", "salt", "made"])

    table = cut(pieces.distinct().withColumn("salt", F.lit(0)))
    real = cut(table.select("kind", F.col("key").alias("made")).where("kind <> 'initial'").distinct())
    for _ in range(rounds):
        made = cut(table.mapInArrow(run, f"{_PIECES}, salt int, made string"))
        kept = made.groupBy("kind", "made").agg(F.min("key").alias("kept"), F.max("key").alias("last")).where("kept <> last").drop("last")
        lost = made.join(kept, ["kind", "made"]).where("key <> kept").select("kind", "key")
        lost = cut(lost.unionByName(made.join(real, ["kind", "made"], "left_semi").select("kind", "key")).distinct().withColumn("up", F.lit(1)))
        if lost.isEmpty():
            return made.where("salt > 0").select("kind", "key", "salt").distinct()
        table = made.join(lost, ["kind", "key"], "left").select("kind", "key", "piece", (F.col("salt") + F.coalesce("up", F.lit(0))).cast("int").alias("salt"))
    raise ValueError(f"surrogates still collide after {rounds} rounds")


def _resolved(rows: DataFrame, secret: str, rounds: int) -> DataFrame:
    """``rows`` (``_row``, :data:`_FOUND`, others) with ``_salts``, the map of "span:unit" to the salts above 0."""
    units = rows.select("_row", F.explode("_units").alias("u")).select("_row", "u.*")
    salts = _salts(units.select("kind", "key", "piece"), secret, rounds)
    hit = units.select("_row", "at", "kind", "key").join(salts, ["kind", "key"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("at", "salt"))).alias("_salts"))
    return rows.drop("_units").join(hit, "_row", "left")


def _span_surrogate(secret: str, n: int, kind: str, value: str, salts: dict[str, int]) -> str:
    chosen = [salts.get(f"{n}:{u}", 0) for u in range(len(_units(kind, value)))] if salts else None
    return _with_salts(secret, kind, value, chosen) if chosen and any(chosen) else surrogate(secret, kind, value)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` numbered by ``_row``, written and read again, so that texts are searched once."""
    out = workdir(df.sparkSession, name)
    df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(out)
    return df.sparkSession.read.parquet(out)


def surrogate_table(found: DataFrame, secret: str, rounds: int = 200) -> DataFrame:
    """``(kind, value, surrogate)`` of the distinct values, without two values in one surrogate.

    Units (parts of names, whole values of other kinds) that collide, with each other or
    with a real unit of the kind, are hashed again with the next salt until none does; a
    part has one surrogate in all names. Spellings of one value (case aside) may share it.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, v = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, *_found_arrays([[(0, 0, len(y), x, y)] for x, y in zip(k, v, strict=True)])], names=["kind", "value", "_spans", "_units"])

    values = found.select("kind", "value").where(F.col("value").isNotNull()).distinct()
    rows = _resolved(_stored(values.mapInArrow(place, f"kind string, value string, {_FOUND}"), "surrogates"), secret, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, v, s = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_span_surrogate(secret, 0, x, y, dict(z or ())) for x, y, z in zip(k, v, s, strict=True)], pa.string())], names=["kind", "value", "surrogate"])

    return rows.select("kind", "value", "_salts").mapInArrow(run, "kind string, value string, surrogate string")


def _with_surrogates(df: DataFrame, finder: Finder, secret: str, rounds: int, id_col: str, fields: tuple[str, ...], spoken: Column) -> DataFrame:
    key = df.schema[id_col].dataType.simpleString()
    texts = ", ".join(f"`{f}` string" for f in fields)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spoken = b.column(1).to_pylist()
            found: list[list] = [[] for _ in spoken]
            for f in range(len(fields)):
                for i, text in enumerate(b.column(2 + f).to_pylist()):
                    if text:
                        found[i] += [(f, s, e, k, text[s:e]) for s, e, k in finder.find(text, bool(spoken[i]) and f == 0)]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *_found_arrays(found)], names=[id_col, *fields, "_spans", "_units"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, salts = b.column(1 + len(fields)), b.column(2 + len(fields)).to_pylist()
            ends = spans.offsets.to_pylist()
            first = ends[0]
            at_field, start, end, kind, value = (c.to_pylist() for c in spans.flatten().flatten())
            cols = [c.to_pylist() for c in b.columns[1 : 1 + len(fields)]]
            for i, (low, high) in enumerate(zip(ends, ends[1:], strict=False)):
                if low == high:
                    continue
                chosen = dict(salts[i]) if salts[i] else {}
                pieces: list[list[str]] = [[] for _ in fields]
                at = [0] * len(fields)
                for n, k in enumerate(range(low - first, high - first)):  # in the order of the text of each field
                    f = at_field[k]
                    new = _span_surrogate(secret, n, kind[k], value[k], chosen) if chosen else surrogate(secret, kind[k], value[k])
                    pieces[f] += [cols[f][i][at[f] : start[k]], new]
                    at[f] = end[k]
                for f, p in enumerate(pieces):
                    if p:
                        cols[f][i] = "".join([*p, cols[f][i][at[f] :]])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols)], names=[id_col, *fields])

    rows = _stored(df.select(id_col, spoken.alias("_spoken"), *fields).mapInArrow(find, f"`{id_col}` {key}, {texts}, {_FOUND}"), "redact")
    return _resolved(rows, secret, rounds).select(id_col, *fields, "_spans", "_salts").mapInArrow(write, f"`{id_col}` {key}, {texts}")


def redact(df: DataFrame, people: DataFrame, *, id_col: str = "_id", fields: tuple[str, ...] = ("content", "subject"), transcript_col: str | None = None, secret: str | None = None, rounds: int = 200) -> DataFrame:
    """``(id_col, *fields)`` with each value replaced and everything else unchanged.

    Without ``secret`` by a placeholder of its kind, such as ``[EMAIL]``; with it by its
    surrogate, whose collisions over all the values of ``df`` are resolved as in
    :func:`surrogate_table`.
    """
    finder = _finder(people)
    if secret is not None:
        return _with_surrogates(df, finder, secret, rounds, id_col, fields, F.col(transcript_col) if transcript_col else F.lit(False))

    def replace(text: str | None, spoken: bool) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, e, k in finder.find(text, spoken):
            out += [text[at:s], f"[{k.upper()}]"]
            at = e
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spoken = b.column(1).to_pylist()
            cols = [pa.array([replace(t, bool(s) and f == 0) for t, s in zip(b.column(2 + f).to_pylist(), spoken, strict=True)], pa.string()) for f in range(len(fields))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, *fields])

    key = df.schema[id_col].dataType.simpleString()
    spoken = F.col(transcript_col) if transcript_col else F.lit(False)
    return df.select(id_col, spoken.alias("_spoken"), *fields).mapInArrow(run, f"`{id_col}` {key}, " + ", ".join(f"`{f}` string" for f in fields))
