"""Problem 3: personal data in speech, found and replaced with typed placeholders.

Method: candidate gradient boosting. Generators with high recall propose overlapping spans of five kinds; boosted trees score each by its
format and context; thresholds calibrated by kind select spans; of overlapping ones the surest and then the longest stands. train.py fits
the trees on a bounded sample; models/pii.json holds them with the thresholds and the vocabulary of context words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .boosting import probability

MODEL = "pii.json"
KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = {"email": "EMAIL", "phone": "PHONE", "id_number": "ID", "address": "ADDRESS", "name": "NAME"}

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+-]*\s?(?:@|[\[(] ?at ?[\])])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(] ?dot ?[\])])\s?[A-Za-z0-9-]+)+", re.I)
_SAID_EMAIL = re.compile(r"(?<![A-Za-z0-9_-])[a-z0-9._+-]+(?: (?:dot|underscore|dash|hyphen|plus) [a-z0-9._+-]+)* at [a-z0-9-]+(?: (?:dash|hyphen) [a-z0-9-]+)*(?: dot [a-z0-9-]+)+", re.I)
_DIGITS = re.compile(r"(?<![\w.,+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ -]?)?\d{1,12}(?:[ .-]\d{2,6}){0,4}(?![A-Za-z0-9_]|[.,-]\d)", re.A)
_CODE = re.compile(r"(?<![A-Za-z0-9@.-])[A-Z]{1,5}[ -]?\d{4,9}(?:-\d{3,8})?[A-Z]?(?![A-Za-z0-9@]|-\d)|(?<![A-Za-z0-9@.-])[A-Z]{1,3}(?:-\d{2,7}){2,3}(?![A-Za-z0-9@]|-\d)", re.A)
_CAP = r"[A-ZÀ-Þ][A-Za-zÀ-ɏ'’]+(?:-[a-z]{2,4})?"
_STREET = re.compile(
    r"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|House|Room|Plot|Floor) ?[0-9]+[A-Z]?, ?)?(?<![\w-])[0-9]{1,5}(?:-[0-9]{1,4}){0,3}[A-Z]? (?:" + _CAP + r" ?){1,4}(?:,\s(?:Sector [0-9]+|(?:" + _CAP + r"\s?)+(?:[0-9]{4,6})?|[0-9]{4,7}))*(?:(?<=[a-z]) [0-9]{5,6}\b)?"
)
_JA = "㐀-䶿一-鿿々"
_JA_ADDRESS = re.compile(
    r"(?:〒 ?)?(?:[0-9]{3}-[0-9]{4}\s?)?(?:[" + _JA + r"]{1,3}[都道府県])?[" + _JA + r"]{1,4}[市区郡町村][" + _JA + r"ぁ-ヿ]{0,8}?[0-9]{1,4}(?:(?:丁目|番地|番|号|条|[-ー])[0-9]{0,4}){0,4}(?:号|番地)?(?:[ \n]?[" + _JA + r"ァ-ヿA-Za-z]{1,10}[0-9]{1,4}(?:階|号室|F))?"
)
_HI_ADDRESS = re.compile(r"(?:(?:फ्लैट|मकान|प्लॉट|यूनिट|घर)(?: नं\.?| संख्या)? ?[0-9०-९]+[A-Zक-ह]?, ?)?[0-9०-९]{1,4} [ऀ-ॣ]+(?: [ऀ-ॣ]+)?(?:, ?(?:सेक्टर [0-9०-९]+|[ऀ-ॣ]+(?: [ऀ-ॣ]+)?(?: ?[0-9]{6})?))+")
_LATIN_NAME = re.compile(r"(?<![A-Za-zÀ-ɏ@.\d_-])" + _CAP.replace("(?:-[a-z]{2,4})?", "") + r"(?:[ \n]" + _CAP.replace("(?:-[a-z]{2,4})?", "") + r")*")
_HONOR = "様|さん|氏|くん|君|殿|先生|部長|課長|係長|主任|社長|専務|常務|会長"
_JA_NAME = re.compile(r"(?<![" + _JA + r"ァ-ヺー])((?:[" + _JA + r"]{1,4}[ \n]?[" + _JA + r"]{1,4}|[" + _JA + r"]{1,6}|[ァ-ヺー]{2,10}))(?<![仕同模多異有])(?=" + _HONOR + ")")
_HI_WORD = r"(?!(?:ने|को|का|की|के|जी|से|में|पर|और|है|हैं)(?![ऀ-ॣ]))[ऀ-ॣ]{2,}"
_HI_PAIR = _HI_WORD + r"(?:[ \n]" + _HI_WORD + r")?"
_HI_NAME = re.compile(r"(?<![ऀ-ॣ])" + _HI_PAIR + r"(?=[ \n](?:जी|साहब|सर|भाई|मैडम)(?![ऀ-ॣ]))|(?<=डॉ\.[ \n])" + _HI_PAIR + r"|(?<=श्री[ \n])" + _HI_PAIR + r"|(?<=क्या[ \n])" + _HI_PAIR + r"(?=[ \n][0-9])|(?<![ऀ-ॣ])" + _HI_PAIR + r"(?=[ \n]ने(?![ऀ-ॣ]))")
_BEFORE = re.compile(r"(?:[A-Za-zÀ-ɏ']+\.?|[ऀ-ॣ]+\.?|[" + _JA + r"]+|[ぁ-ゟ]+|[ァ-ヺー]+|[^\s\w])\s*$")
_AFTER = re.compile(r"\s*([A-Za-zÀ-ɏ']+|[ऀ-ॣ]+|[" + _JA + r"]{1,2}|[ぁ-ゟ]{1,2}|[0-9]|[^\s\w])")


_TITLE = re.compile(r"(?:Dr|Mr|Ms|Mrs|Prof|डॉ|श्री|e\.g|vs|approx|No)\.$")
_AT = re.compile(r"[\[(] ?at ?[\])]", re.I)
_LONG = re.compile(r"\d[ .()-]{0,2}\d{3}")
_PLACE = re.compile(r"\d[A-Z]? [A-ZÀ-Þ]")
_TOWN = re.compile("[市区郡町村]")
_DEVA = re.compile("[ऀ-ॣ]")
_HONORED = re.compile(_HONOR)
_NONBLANK = re.compile(r"\S+")


class Span(NamedTuple):
    start: int
    end: int
    kind: int


def spans(s: str) -> Iterator[Span]:
    """Every candidate of a piece of speech; they may overlap. A pattern runs only where a character that it needs is there."""
    if "@" in s or _AT.search(s):
        for m in _EMAIL.finditer(s):
            yield Span(m.start(), m.end(), 0)
            if m.group().count(".") > 1:
                yield Span(m.start(), s.rindex(".", m.start(), m.end()), 0)
    if " dot " in s or " DOT " in s:
        for m in _SAID_EMAIL.finditer(s):
            yield Span(m.start(), m.end(), 0)
            if m.group().lower().count(" dot ") > 1:
                yield Span(m.start(), m.start() + m.group().lower().rindex(" dot "), 0)
    if _LONG.search(s):
        for m in _DIGITS.finditer(s):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 14:
                yield Span(m.start(), m.end(), 1)
                yield Span(m.start(), m.end(), 2)
        for m in _CODE.finditer(s):
            if sum(c.isdigit() for c in m.group()) >= 4:
                yield Span(m.start(), m.end(), 2)
    places = [_STREET] if _PLACE.search(s) else []
    if _TOWN.search(s):
        places.append(_JA_ADDRESS)
    if _DEVA.search(s):
        if "," in s:
            places.append(_HI_ADDRESS)
        for m in _HI_NAME.finditer(s):
            yield Span(m.start(), m.end(), 4)
            if " " in m.group():
                for w in re.finditer(r"\S+", m.group()):
                    yield Span(m.start() + w.start(), m.start() + w.end(), 4)
    for p in places:
        for m in p.finditer(s):
            yield Span(m.start(), m.start() + len(m.group().rstrip(" ,\n")), 3)
    for m in _LATIN_NAME.finditer(s):
        if m.group().isalpha():
            yield Span(m.start(), m.end(), 4)
            continue
        words = [(w.start() + m.start(), w.end() + m.start()) for w in _NONBLANK.finditer(m.group())]
        for i in range(len(words)):
            for j in range(i, min(i + 3, len(words))):
                yield Span(words[i][0], words[j][1], 4)
    if _HONORED.search(s):
        for m in _JA_NAME.finditer(s):
            yield Span(m.start(1), m.end(1), 4)


def context(s: str, start: int, end: int) -> tuple[str, str, str, bool]:
    """(word before, word before that, word behind, at the start of a sentence), in lower case. Between blanks a word is what stands there; in scripts without blanks a run of one kind of character."""
    before = s[max(0, start - 28) : start]
    tail = before.rstrip()
    first = not tail or tail[-1] in "!?。！？।|」\"" or tail[-1] == "." and not _TITLE.search(tail)
    if not tail or first:
        one = two = ""  # another sentence says nothing about this one
    elif tail[-1] > "\u2fff":
        m = _BEFORE.search(tail, max(0, len(tail) - 8))
        one = m.group() if m else ""
        rest = tail[: len(tail) - len(one)]
        m = _BEFORE.search(rest, max(0, len(rest) - 8)) if rest else None
        two = m.group().strip() if m else ""
    else:
        words = tail.lower().replace(",", " ").replace("…", " ").split() or [""]
        one, two = words[-1], words[-2] if len(words) > 1 else ""
        if two[-1:] in (".", "!", "?", "।", "|", '"'):
            two = ""
    m = _AFTER.match(s, end, end + 20)
    return one, two, m.group(1).lower() if m else "", first


def _bin(x: float, step: float, top: int) -> int:
    return max(0, min(top, int(x / step + top / 2)))


class Vocabulary:
    """Context words by kind with the bin of their log odds, and log odds of a name's letters."""

    def __init__(self, odds: dict[str, dict[str, int]], letters: dict[str, float]):
        self.odds, self.letters = odds, letters
        self.cache: dict[str, int] = {}
        self.slots = [tuple(odds.get(f"{k}{at}", {}) for at in ("-1", "-2", "+1")) for k in KINDS]

    def name_like(self, word: str) -> int:
        """0 to 8: how much the letters of a word read as a name."""
        got = self.cache.get(word)
        if got is None:
            w = f"^{word.lower()}$"
            g = [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]
            got = _bin(sum(self.letters.get(x, 0.0) for x in g) / max(1, len(g)), 0.25, 8)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = got
        return got


def features(s: str, c: Span, v: Vocabulary) -> tuple[int, ...]:
    """Small integers: format and context of a candidate."""
    text = s[c.start : c.end]
    one, two, nxt, first = context(s, c.start, c.end)
    a, b, d = v.slots[c.kind]
    ctx = (a.get(one, 4), b.get(two, 4), d.get(nxt, 4), int(first))
    if c.kind == 4:
        words = [text] if text.isalpha() else text.split()
        likes = [v.cache[w] if w in v.cache else v.name_like(w) for w in words]
        left = s[c.start - 1 : c.start] if c.start else ""
        wider = int(s[c.end : c.end + 1] in " \n" and s[c.end + 1 : c.end + 2].isupper()) + 2 * int(one[:1].isalpha() and s[max(0, c.start - 1 - len(one)) : c.start][:1].isupper())
        script = 0 if text[0] < "ɐ" else 1 if "ऀ" <= text[0] <= "ॿ" else 2
        return (*ctx, len(words), min(likes), max(likes), wider, script, int(left in "\"「(（"), int(s[c.end : c.end + 1] in "様さ氏部課君殿先主"))
    n = sum(x.isdigit() for x in text)
    letters = sum(x.isalpha() for x in text)
    groups = re.findall(r"\d+", text)
    sep = next((i for i, x in enumerate("- .", 1) if x in text), 0)
    lead = 1 if text[0] == "+" else 2 if text[0] == "(" else 3 if text[0] == "0" else 4 if text[0] == "〒" else 0
    return (*ctx, min(n, 20), min(letters, 60) // 2, min(len(groups), 8), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, sep, lead, min(text.count(","), 6), int(text[-1].isdigit()), int(text[:1].isalpha()))


class Finder:
    def __init__(self, model: dict):
        self.trees = model["trees"]
        self.least = model["thresholds"]
        self.v = Vocabulary(model["odds"], model["letters"])
        self.memo: dict[tuple, float] = {}

    @classmethod
    def load(cls) -> Finder:
        from importlib.resources import files

        return cls(json.loads(files(__package__).joinpath("models", MODEL).read_text("utf-8")))

    def score(self, s: str, c: Span) -> float:
        f = (c.kind, *features(s, c, self.v))
        p = self.memo.get(f)
        if p is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            p = self.memo[f] = probability(self.trees[KINDS[c.kind]], f[1:]) / self.least[KINDS[c.kind]]
        return p

    def find(self, s: str) -> list[Span]:
        """Selected spans, in order: those that reach their kind's threshold; of overlapping ones formats before names, then the surest, then the longest."""
        made = [(c.kind == 4, -round(p, 2), c.start - c.end, c) for c in set(spans(s)) if (p := self.score(s, c)) >= 1]
        taken: list[Span] = []
        for *_, c in sorted(made):
            if all(c.end <= t.start or c.start >= t.end for t in taken):
                taken.append(c)
        return sorted(taken)

    def in_text(self, folded: str) -> list[Span]:
        """Selected spans of the speech of a folded transcript, with positions in it."""
        from .sentences import _back, joined, units

        out = []
        for unit in units(folded):
            s, pieces = joined(folded, unit)
            out += [Span(_back(c.start, pieces), _back(c.end - 1, pieces) + 1, c.kind) for c in self.find(s)]
        return out


def _raw(text: str, at: list[int] | None, c: Span) -> tuple[int, int]:
    return (c.start, c.end) if at is None else ((at[c.start - 1] + 1 if c.start else 0), at[c.end - 1] + 1)


def _found():
    from .canon import aligned

    finder = Finder.load()

    def f(key, text):
        folded, at = aligned(text)
        got = {}
        for c in finder.in_text(folded):
            a, b = _raw(text, at, c)
            got[KINDS[c.kind], text[a:b].strip()] = None
        return [(key, kind, t) for kind, t in got]

    return f


def personal_data(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pii_kind, found_text: each different piece of personal data of each text, as it stands there. Null keys and texts give no row."""
    d = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return frames.rows_out(d, _found, f"{key} string, pii_kind string, found_text string", [(key, pa.string()), ("pii_kind", pa.string()), ("found_text", pa.string())]).distinct()


def _masked():
    from .canon import aligned

    finder = Finder.load()

    def f(key, text):
        if text is None:
            return [(key, None, None)]
        folded, at = aligned(text)
        names: dict[tuple[str, str], str] = {}
        count: dict[str, int] = {}
        out, last = [], 0
        for c in sorted(finder.in_text(folded)):
            a, b = _raw(text, at, c)
            if a < last:
                continue
            tag, found = TAGS[KINDS[c.kind]], text[a:b]
            if (tag, found) not in names:
                n = count[tag] = count.get(tag, 0) + 1
                while f"[{tag}_{n}]" in text:  # a text that holds the placeholder already keeps it
                    n = count[tag] = n + 1
                names[tag, found] = f"[{tag}_{n}]"
            out += [text[last:a], names[tag, found]]
            last = b
        return [(key, "".join(out) + text[last:], [(p, t) for (_, t), p in names.items()])]

    return f


def masked(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, masked, mapping: one row per row of df. The text with a typed placeholder for each piece of personal data in its speech, everything else unchanged; putting the mapping's texts back gives the text. A null text gives nulls."""
    d = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return frames.rows_out(
        d, _masked, f"{key} string, masked string, mapping map<string,string>",
        [(key, pa.string()), ("masked", pa.string()), ("mapping", pa.map_(pa.string(), pa.string()))],
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(frames.read(spark, folder, "analyze_requests", ["request_id", "transcript"]), "request_id", "transcript")


def p3_masked(spark: SparkSession, folder: str) -> DataFrame:
    return masked(frames.read(spark, folder, "analyze_requests", ["request_id", "transcript"]), "request_id", "transcript")


QUERIES = {"p3_found": p3_found, "p3_masked": p3_masked}
SQL: dict[str, str] = {}
