"""Names as people type them, made comparable: parts of a cell, forms of a person, edit distance."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from .canon import visual_key

# Words around a name that are not part of it.
HONORIFICS = ("san", "sama", "kun", "chan", "sensei", "shi", "ji", "sir", "bhai", "madam")
HONORIFICS_CJK = ("さん", "様", "さま", "氏", "くん", "君", "ちゃん", "先生", "殿", "部長", "課長", "係長", "主任", "社長", "専務", "常務", "取締役", "会長")
HONORIFICS_DEVA = ("जी", "साहब", "सर", "भाई", "मैडम")
TITLES = ("dr", "mr", "mrs", "ms", "prof", "pm", "director", "manager", "engineer", "sales", "legal", "qa", "lead", "qa lead", "president", "vp", "chief", "डॉ", "श्री", "श्रीमती")
NOBODY = ("team", "all", "both", "everyone", "everybody", "unknown", "tbd", "tba", "none", "n/a", "na", "nobody", "group", "side", "anyone", "speaker")
# Short forms of given names.
NICKNAMES = {
    "abigail": "abby abbie gail", "deborah": "debbie deb debra", "elizabeth": "liz beth betty eliza lizzie lisa", "margaret": "maggie meg peggy marge greta",
    "katherine": "kate kathy katie kat kay", "william": "bill will billy willy liam", "robert": "bob rob bobby robbie bert", "jonathan": "jon jonny johnny nathan john",
    "theodore": "ted theo teddy", "gerald": "jerry gerry", "michael": "mike mick mickey", "thomas": "tom tommy", "richard": "rick dick rich", "james": "jim jimmy jamie",
    "edward": "ed eddie ned ted", "patricia": "pat patty trish", "susan": "sue susie", "christopher": "chris", "christine": "chris tina", "alexander": "alex sandy", "alexandra": "alex sandra",
    "samantha": "sam", "samuel": "sam", "benjamin": "ben", "daniel": "dan danny", "matthew": "matt", "anthony": "tony", "andrew": "andy drew", "joseph": "joe", "steven": "steve",
    "rebecca": "becky", "jennifer": "jen jenny", "jessica": "jess", "nicholas": "nick", "timothy": "tim", "charles": "charlie chuck", "victoria": "vicky tori", "frederick": "fred",
}

_SEP = re.compile(r"\s*(?:[&/;、+·・]|,\s*(?=[^,]+,)|\band\b|\baur\b|और|及び|および)\s*|\s+と\s+|\n", re.I)
_BRACKET = re.compile(r"[(\[【（〔][^)\]】）〕]*[)\]】）〕]|[\[(【].*$")
_WORD = re.compile(r"[ऀ-ॣ॰-ॿ]+|(?:(?![ऀ-ॿ])[^\W\d_])+(?:['’][^\W\d_]+)?")
_HON = re.compile(r"(?:(?<=\w)[-\s]+(?:" + "|".join(HONORIFICS) + r")\b\.?)+\s*$", re.I)
_HON_CJK = re.compile(r"\s*(?:" + "|".join(HONORIFICS_CJK) + r")\s*$")
_HON_DEVA = re.compile(r"\s+(?:" + "|".join(HONORIFICS_DEVA) + r")\s*$")
_TITLE = re.compile(r"^\s*(?:(?:" + "|".join(map(re.escape, sorted(TITLES, key=len, reverse=True))) + r")(?:\.\s*|\s+|:\s*))+", re.I)
# Romanisation systems drawn together, longer spellings first.
_ROMAN = (("shi", "si"), ("sh", "sy"), ("chi", "ti"), ("ch", "ty"), ("tsu", "tu"), ("fu", "hu"), ("ji", "zi"), ("dzu", "zu"), ("jy", "zy"), ("j", "zy"), ("cch", "tty"), ("tch", "tty"))
_LONG = re.compile(r"oh(?=[^aeiouy]|$)|ou|([aeiou])\1")


def _latin(word: str) -> str:
    w = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    for a, b in _ROMAN:
        w = w.replace(a, b)
    return _LONG.sub(lambda m: m.group(1) or "o", w)


def token(word: str) -> str:
    """One name word in comparable form: case, accents, long vowels and romanisation systems made one; other scripts as they are."""
    return _latin(word) if is_latin(word) else word


def plain(word: str) -> str:
    """One name word in lower case without accents, its spelling kept; other scripts as they are."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)) if is_latin(word) else word


def is_latin(word: str) -> bool:
    return word[0].isascii() or "LATIN" in unicodedata.name(word[0], "")


def clean(text: str) -> str:
    """A typed name without brackets, honorifics and titles."""
    s = _BRACKET.sub(" ", visual_key(text)).strip()
    for _ in range(2):
        s = _HON_CJK.sub("", _HON_DEVA.sub("", _HON.sub("", s)))
        s = _TITLE.sub("", s).strip()
    return s


def parts(cell: str | None) -> list[tuple[int, str]]:
    """The comparable forms of the persons that a cell names, numbered; groups and blanks give none.

    A form is its words joined by blanks, once with the systems of romanisation made one and, where that differs, once as spelt, so that
    a slip of the pen is one edit in one of them; initials only ("E.K.", "EK") give the letters joined, with a point first.
    """
    if not cell:
        return []
    out = []
    for i, piece in enumerate(_SEP.split(_BRACKET.sub(" ", visual_key(cell)))):
        s = clean(piece)
        if "," in s:
            a, b = s.split(",", 1)
            s = f"{b} {a}"
        words = _WORD.findall(s)
        if not words or any(w.lower() in NOBODY for w in words):
            continue
        if all(len(w) == 1 and is_latin(w) for w in words) and len(words) > 1:
            out.append((i, "." + "".join(words).lower()))
        elif len(words) == 1 and 2 <= len(s) <= 3 and s.isupper() and s.isascii():
            out.append((i, "." + s.lower()))
        else:
            out += [(i, form) for form in dict.fromkeys((" ".join(map(token, words)), " ".join(map(plain, words))))]
    return out


# Kinds of forms, the surest first; the second value is the edit radius.
FULL, NATIVE, NICK, INITIAL, FAMILY, GIVEN, NICK_ALONE, INITIALS = range(8)


def forms(full_name: str | None, native: str | None) -> Iterator[tuple[str, int, int]]:
    """(form, kind, radius) of a registered person. full_name is given name first; native is given first in Devanagari, family first elsewhere."""
    words = _WORD.findall(visual_key(full_name or ""))
    for spell in (token, plain) if words else ():
        g, f = spell(words[0]), spell(words[-1])
        if len(words) == 1:
            yield g, FULL, 1
            continue
        for form in {f"{g} {f}", f"{f} {g}", " ".join(map(spell, words))}:
            yield form, FULL, 1
        yield f"{g[0]} {f}", INITIAL, 1
        yield f"{f} {g[0]}", INITIAL, 0
        yield f, FAMILY, 1
        yield g, GIVEN, 1
        yield "." + words[0][0].lower() + words[-1][0].lower(), INITIALS, 0
        for n in NICKNAMES.get(plain(words[0]), "").split():
            n = spell(n)
            yield f"{n} {f}", NICK, 0
            yield f"{f} {n}", NICK, 0
            yield n, NICK_ALONE, 0
    words = _WORD.findall(visual_key(native or ""))
    if words:
        g, f = (words[0], words[-1]) if "ऀ" <= words[0][0] <= "ॿ" else (words[-1], words[0])
        for form in {f"{g} {f}", f"{f} {g}", g + f, f + g, " ".join(words)} if len(words) > 1 else {g}:
            yield form, NATIVE, 0
        if len(words) > 1:
            yield f, FAMILY, 0
            yield g, GIVEN, 0


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (optimal string alignment), or most + 1 if it is larger. Transposition is one edit."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            row.append(c)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def levenshtein(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]
