"""A transcript's lines in Python, with positions: the same fields as the SQL expressions of turns.py, for operators that work on whole texts."""

from __future__ import annotations

import re
from typing import NamedTuple

from . import speech

_L = r"[\ẁ-ͯऀ-ॣ.'’·-]"
_NAME = r"(?=[^\W\d_]|[ऀ-ॣ])" + _L + r"+(?:\s+" + _L + r"+){0,3}(?:\s*[\[(【][^\])】:0-9]+[\])】])?"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_CUE = re.compile(r"\s*" + _CLOCK + r"\s*-->")
_VOICE = re.compile(r"\s*<v(?:\.[\w.]+)?\s+([^>]+)>")
_STAMP_FIRST = re.compile(r"\s*\[?" + _CLOCK + r"\]?\s+(" + _NAME + r")\s*(?::|(?<=\s)-(?=\s|$))\s*")
_LABEL_FIRST = re.compile(r"\s*(" + _NAME + r")\s*(?:\(" + _CLOCK + r"\)\s*)?:(?!//)\s*(?:\[" + _CLOCK + r"\])?\s*")
_HEAD = re.compile(r"\s*(?:WEBVTT.*|NOTE(?:\s.*)?|STYLE|REGION)$")
NOTE = re.compile(speech.NOTE.replace(r"(?! ?", r"(?!\s?"))
_GAP = r"[\s,、。….!?！？।|~ー\-]*"
FILLER_LINE = re.compile(_GAP + r"(?:(?:" + "|".join(sorted(speech.FILLERS, key=len, reverse=True)) + r")(?![^\W\d_]|[ऀ-ॣ])" + _GAP + r")*$", re.I)
_TAIL = re.compile(r"\s*</v>\s*$")


class Line(NamedTuple):
    no: int  # from 1
    label: str | None
    start: int  # of the speech in the text, after label and stamp
    end: int
    spoken: bool  # holds more than notes and fillers


def blank_notes(s: str) -> str:
    """s with blanks in the place of sound notes; positions stay."""
    return NOTE.sub(lambda m: " " * len(m.group()), s) if _MAY_NOTE.search(s) else s


_MAY_NOTE = re.compile(r"[\[【♪*<(]|--")


def lines(text: str) -> list[Line]:
    """The lines of a folded text (see canon.aligned), split at line feeds."""
    out = []
    at = 0
    for no, raw in enumerate(text.split("\n"), 1):
        label, start, end = None, at, at + len(raw.rstrip("\r"))
        if not raw or raw.isspace() or _CUE.match(raw) or _HEAD.match(raw):
            out.append(Line(no, None, end, end, False))
            at += len(raw) + 1
            continue
        m = _VOICE.match(raw)
        if m:
            end = at + len(_TAIL.sub("", raw))
        else:
            m = _STAMP_FIRST.match(raw) or _LABEL_FIRST.match(raw)
        if m:
            label, start = m.group(1), at + m.end()
        spoken = start < end and not FILLER_LINE.match(blank_notes(text[start:end]))
        out.append(Line(no, label, min(start, end), end, spoken))
        at += len(raw) + 1
    return out
