"""Problem 6: sentence boundaries across languages and scripts.

Method: candidate boundaries (final marks with their closers; gaps behind characters of scripts without word spaces) are classified
by a maximum-entropy model (logistic regression on neighbouring tokens, case, length, digits, script, quotation depth). It is trained on
boundaries that the layout makes sure: the ends of labelled turns against marks inside numbers, abbreviations, quotations and before
lower case. train.py fits it; models/sentences.json holds the weights.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

MODEL = "sentences.json"
MARKS = ".!?。！？।॥|…"
_CLOSE = "\"'”’」』)）]】〕》"
_OPEN = {"「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "“": "”", "〔": "〕", "《": "》"}
_CLOSES = set(_OPEN.values())
_CJK = "぀-ヿ㐀-䶿一-鿿々〆ー"
_CANDIDATE = re.compile(r"[ \t]?[" + re.escape(MARKS) + r"]+[" + re.escape(_CLOSE) + r"]*|(?<=[" + _CJK + r"])[ \t　]+(?=[" + _CJK + r"0-9A-Za-z「（(])")
_QUOTES = re.compile("[\"「」『』()（）\\[\\]【】“”〔〕《》]")
_LAST = re.compile(r"(?:[^\W_]|[ऀ-ॣ]|[.'’-])+$")
_FIRST = re.compile(r"[\s\"'“「『(（]*((?:[^\W_]|[ऀ-ॣ]|['’-])+)")
_TOKENS = 24


def _script(c: str) -> str:
    if not c:
        return "end"
    if c.isdigit():
        return "digit"
    if c.isascii() or "À" <= c <= "ɏ":
        return "upper" if c.isupper() else "lower" if c.isalpha() else "mark"
    if "ऀ" <= c <= "ॿ":
        return "deva"
    if "ぁ" <= c <= "ゟ":
        return "hira"
    if "゠" <= c <= "ヿ":
        return "kata"
    return "kanji" if c.isalpha() else "mark"


class Depth:
    """How deep each position lies in quotations and brackets; an unclosed one ends with the text."""

    def __init__(self, s: str):
        self.at: list[int] = []
        self.depth: list[int] = []
        stack: list[str] = []
        for m in _QUOTES.finditer(s):
            c = m.group()
            if stack and c == stack[-1]:
                stack.pop()
            elif c == '"':
                if '"' in stack:
                    del stack[stack.index('"') :]
                else:
                    stack.append('"')
            elif c in _OPEN:
                stack.append(_OPEN[c])
            elif c in _CLOSES and c in stack:
                del stack[stack.index(c) :]
            self.at.append(m.start())
            self.depth.append(len(stack))

    def after(self, i: int) -> int:
        """Depth behind the character at i."""
        lo, hi = 0, len(self.at)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.at[mid] <= i:
                lo = mid + 1
            else:
                hi = mid
        return self.depth[lo - 1] if lo else 0


def candidates(s: str) -> Iterator[tuple[int, int, bool]]:
    """(end, next start, marked): a boundary may lie behind s[end]."""
    for m in _CANDIDATE.finditer(s):
        body = m.group()
        marked = body.lstrip()[:1] in MARKS if body.strip() else False
        yield (m.end() - 1 if marked else m.start() - 1), m.end(), marked


def features(s: str, end: int, nxt: int, marked: bool, depth: int, opened: bool, tail: str | None = None) -> list[str]:
    """Names of the features that hold for a candidate. tail: the text that follows instead of s[nxt:] (training on the ends of turns)."""
    body = end
    while body >= 0 and s[body] in _CLOSE:
        body -= 1
    mark = s[body] if marked else ""
    closed = marked and body < end
    stem = body
    while marked and stem >= 0 and s[stem] in MARKS:
        stem -= 1
    many = marked and body - stem > 1
    before = s[max(0, stem + 1 - _TOKENS) : stem + 1].rstrip()
    m = _LAST.search(before)
    last = m.group() if m else ""
    after = s[nxt : nxt + _TOKENS] if tail is None else " " + tail[:_TOKENS]
    gap = "line" if "\n" in after[: len(after) - len(after.lstrip())] or (not marked and "\n" in s[end:nxt]) else "space" if (after[:1].isspace() or not marked) else "none"
    m = _FIRST.match(after)
    first = m.group(1) if m else ""
    low = last.lower()
    kind = _script(last[-1:] if last else before[-1:])
    case = _script(first[:1]) if after.strip() else "end"
    quoted = after.lstrip()[:1] in "\"'“「『(（"
    shape = "init" if len(last) == 1 and last.isupper() else "dots" if "." in last.strip(".") else "num" if last.isdigit() else f"len{min(len(last), 6)}"
    f = [
        "bias", f"mark={mark}", f"mark={mark}|gap={gap}", f"kind={kind}|case={case}", f"mark={mark}|kind={kind}|case={case}", f"mark={mark}|gap={gap}|case={case}",
        f"deep={depth > 0}|mark={mark}", f"closed={closed}|case={case}", f"many={many}|mark={mark}|case={case}", f"opened={opened}|mark={mark}",
    ]
    if depth > 0:
        f.append("deep")
    if mark == "." and kind in ("upper", "lower", "digit", "deva"):
        f += [f"last={low[-10:]}", f"shape={shape}", f"shape={shape}|case={case}", f"last={low[-10:]}|case={case}"]
    if not marked:
        f += [f"tail={before[-1:]}", f"tail={before[-2:]}", f"tail={kind}|{case}"]
    if quoted:
        f.append(f"quoted|closed={closed}")
    return f


class Model:
    def __init__(self, weights: dict[str, float]):
        self.w = weights

    @classmethod
    def load(cls) -> Model:
        from importlib.resources import files

        return cls(json.loads(files(__package__).joinpath("models", MODEL).read_text("utf-8")))

    def boundary(self, f: list[str]) -> float:
        w = self.w
        z = sum(w.get(x, 0.0) for x in f)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def units(text: str) -> Iterator[list[tuple[int, int]]]:
    """The speech of each labelled line with the unlabelled lines below it, as (start, end) in the folded text. Lines without speech are left out."""
    from .lines import lines

    now: list[tuple[int, int]] = []
    for line in lines(text):
        if line.label is not None and now:
            yield now
            now = []
        if line.spoken:
            now.append((line.start, line.end))
    if now:
        yield now


def joined(text: str, unit: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The unit's text with blanks for sound notes, and (position in it, position in text) of each piece."""
    from .lines import blank_notes

    out, at, pieces = [], 0, []
    for a, b in unit:
        pieces.append((at, a))
        out.append(text[a:b])
        at += b - a + 1
    return blank_notes("\n".join(out)), pieces


def spans(text: str, model: Model) -> Iterator[tuple[int, int]]:
    """(first, last) position in the folded text of each sentence."""
    from .lines import FILLER_LINE

    for unit in units(text):
        s, pieces = joined(text, unit)
        depth = Depth(s)
        start = 0
        ends: list[tuple[int, int]] = []
        size = len(s.rstrip())
        for end, nxt, marked in candidates(s):
            if end < start or end >= size:
                continue
            if end == size - 1:
                break
            deep = depth.after(end)
            if marked and s[nxt : nxt + 1].isalnum() and s[nxt].isascii() and s[end] == ".":
                continue  # within a number, address or version
            opened = bool(FILLER_LINE.match(s, start, end + 1))
            if model.boundary(features(s, end, nxt, marked, deep, opened)) > 0.5 and s[start : end + 1].strip() and not opened:
                ends.append((start, end))
                start = end + 1
        rest = s[start:size]
        if rest.strip() and not FILLER_LINE.match(rest):
            ends.append((start, size - 1))
        for a, b in ends:
            while a < b and s[a].isspace():
                a += 1
            while b > a and s[b].isspace():
                b -= 1
            yield _back(a, pieces), _back(b, pieces)


def _back(i: int, pieces: list[tuple[int, int]]) -> int:
    for at, pos in reversed(pieces):
        if i >= at:
            return pos + i - at
    return i


def _split():
    from .canon import aligned

    model = Model.load()

    def f(key, text):
        folded, at = aligned(text)
        out = []
        for no, (a, b) in enumerate(spans(folded, model), 1):
            if at is not None:
                a, b = (at[a - 1] + 1 if a else 0), at[b]
            out.append((key, no, a + 1, b + 1, text[a : b + 1]))
        return out

    return f


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, sentence_no, start_pos, end_pos, sentence: positions are code points from 1 in the text as it is stored.

    Null keys and texts give no row; a text without speech gives none. Repeated rows of one key and text count once. No shuffle but for that.
    """
    d = frames.distinct_text(df.select(key, text), key, text)
    return frames.rows_out(
        d, _split, f"{key} string, sentence_no int, start_pos int, end_pos int, sentence string",
        [(key, pa.string()), ("sentence_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("sentence", pa.string())],
    )


def _ends():
    from .canon import aligned

    model = Model.load()

    def f(key, text):
        folded, at = aligned(text)
        return [(key, (b if at is None else at[b]) + 1) for _, b in spans(folded, model)]

    return f


def sentence_ends(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, end_pos of each sentence, without the texts; see sentences. Repeats are removed after the split, so that no text is shuffled."""
    d = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return frames.rows_out(d, _ends, f"{key} string, end_pos int", [(key, pa.string()), ("end_pos", pa.int32())]).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_ends(frames.read(spark, folder, "analyze_requests", ["request_id", "transcript"]), "request_id", "transcript")


def p6_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(frames.read(spark, folder, "analyze_requests", ["request_id", "transcript"]), "request_id", "transcript")


def models() -> Path:
    return Path(__file__).resolve().parent / "models"


QUERIES = {"p6_found": p6_found, "p6_sentences": p6_sentences}
SQL: dict[str, str] = {}
