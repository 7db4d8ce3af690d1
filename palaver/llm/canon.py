"""One consistent form for text that looks alike (problem 1), with positions kept.

Method: quick-check properties mark the code points whose presence can make a text unstable (NFKC_QC or NFC_QC not Yes, non-zero
combining class, invisible, or member of a look-alike class). One compiled pattern cuts a text into stable stretches, which are copied
as they are, and unstable segments, each with the preceding starter as its boundary context. Only the segments are normalised, then
spliced back.
"""

from __future__ import annotations

import re
import unicodedata
from hashlib import blake2b

# Look-alike letters; the first row's characters read as the second row's.
_LATIN_LIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοАВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝ"
_LATIN = "ABEZHIKMNOPTYXvoABESIJKMHOPCTYXaeopcyxsijhdqw"
_KANA_LIKE = "力夕口二八工卜千三一へべぺ才厶"
_KANA = "カタロニハエトチミーヘベペオム"
_HYPHEN_LIKE = "‐‑‒–−"
#: Compatibility forms that do show: raised, lowered, circled, fractions, squared, vertical.
_SHOWN = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<vertical>")
_KEEP = set("…‥")

INVISIBLE = {
    chr(c)
    for a, b in ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0000, 0xE0FFF))
    for c in range(a, b + 1)
}
_SPACES = "\u00a0 \u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f　"
_LOOKS = dict(zip(_LATIN_LIKE, _LATIN, strict=True)) | dict(zip(_KANA_LIKE, _KANA, strict=True)) | dict.fromkeys(_HYPHEN_LIKE, "-") | {"〜": "~"}


def _ranges(chars: list[int]) -> str:
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"\\U{chars[i]:08x}" + (f"-\\U{chars[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


def _tables() -> tuple[dict[int, str], dict[int, str], str, str]:
    """Maps for the comparison form and for the readable form, the class of unstable code points and that of combining marks."""
    key: dict[int, str] = {}
    read: dict[int, str] = {}
    unstable, marks = [], []
    for c in [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        ch = chr(c)
        if ch in INVISIBLE:
            key[c] = read[c] = ""
            unstable.append(c)
            continue
        if unicodedata.combining(ch):
            marks.append(c)
        folded = ch
        if ch not in _KEEP and not unicodedata.is_normalized("NFKC", ch):
            tag = unicodedata.decomposition(ch).split(" ")[0]
            if tag not in _SHOWN:
                folded = unicodedata.normalize("NFKC", ch)
                if folded.startswith(" ") and len(folded) > 1:
                    folded = ch  # a spacing accent is a character of its own
        if ch in _SPACES:
            folded = " "
        look = "".join(_LOOKS.get(x, x) for x in folded)
        if folded != ch:
            read[c] = folded
        if look != ch:
            key[c] = look
        # NFC quick check "maybe": the mark could join the starter before it.
        if folded != ch or look != ch or (unicodedata.combining(ch) and _may_join(ch)) or 0x1161 <= c <= 0x11C2:
            unstable.append(c)
    return key, read, _ranges(unstable), _ranges(marks)


_JOINERS: set[str] = set()


def _may_join(ch: str) -> bool:
    if not _JOINERS:
        for c in range(0xC0, 0x3100):
            d = unicodedata.decomposition(chr(c))
            if d and not d.startswith("<") and " " in d and unicodedata.is_normalized("NFC", chr(c)):
                _JOINERS.add(chr(int(d.split(" ")[1], 16)))
        _JOINERS.update("़\u3099\u309a়਼଼")
    return ch in _JOINERS


KEY_MAP, READ_MAP, _U, _M = _tables()
# Classes stay within the basic plane, where they compile to a bit map. A text with wider code points takes a pattern of its own, to which
# each of these is unstable.
_BMP = re.compile(r"\\U000[1-9a-f][0-9a-f]{4}(?:-\\U000[1-9a-f][0-9a-f]{4})?")
_U, _M = _BMP.sub("", _U), _BMP.sub("", _M)
_WIDE = re.compile("[\U00010000-\U0010ffff]")
# A starter as context, then marks and unstable code points; or two marks in a row, whose order may be off.
_SEGMENT, _SEGMENT_WIDE = (re.compile(f"[^{u}{_M}]?(?:[{_M}]*[{u}][{u}{_M}]*|[{_M}]{{2,}})") for u in (_U, _U + "\U00010000-\U0010ffff"))
_NFC = unicodedata.normalize


def _key(m: re.Match) -> str:
    return _NFC("NFC", m.group().translate(KEY_MAP))


def visual_key(text: str | None) -> str | None:
    """The form in which texts that show the same characters in the same places are equal. Case, digits, words, marks and line breaks stay. None stays None."""
    if text is None or text.isascii():
        return text
    return _segments(text).sub(_key, text)


def _segments(text: str) -> re.Pattern:
    return _SEGMENT_WIDE if _WIDE.search(text) else _SEGMENT


_WORD = re.compile(r"[^\W\d_]+")
_KATAKANA = re.compile("[ァ-ヺー]")


def _readable_word(m: re.Match) -> str:
    """Look-alikes inside one run of letters take the script of the letters beside them."""
    w = m.group()
    if not any(c in _LOOKS for c in w):
        return w
    if any(c.isascii() for c in w) or all(c in _LOOKS for c in w) and w[0] in _LATIN_LIKE and len(w) < 3:
        w = "".join(_LOOKS[c] if c in _LATIN_LIKE else c for c in w)
    if any(c in _KANA_LIKE for c in w):
        out = list(w)
        for i, c in enumerate(w):
            if c in _KANA_LIKE:
                before, after = w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
                solid = [x for x in (before, after) if x and _KATAKANA.match(x)]
                if solid and (len(solid) == 2 or not (before if solid[0] is after else after).strip() or c in "一へべぺ"):
                    out[i] = _LOOKS[c]
        w = "".join(out)
    return w


def canonical(text: str | None) -> str | None:
    """A readable consistent form: width, composition, spaces and invisible characters made one, look-alikes set to the script around them."""
    if text is None:
        return None
    if not text.isascii():
        text = _segments(text).sub(lambda m: _NFC("NFC", m.group().translate(READ_MAP)), text)
    return _WORD.sub(_readable_word, text)


def digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


# --- the same fold with positions, for the operators that report positions or found text ---
_ONE = {c: v for c, v in KEY_MAP.items() if len(v) == 1 and chr(c) not in _KANA_LIKE + "〜"} | {ord("…"): "…"}
_DROP = {c: v for c, v in KEY_MAP.items() if len(v) != 1}
_MOVES = re.compile("[" + _ranges(sorted(c for c in _DROP if c < 0x10000)) + "\u0300-\u036f\uff9e\uff9f\u3099\u309a]")
_ALL = _ONE | _DROP
_CLUSTER = re.compile("[\\s\\S][\u0300-\u036f\uff9e\uff9f\u3099\u309a़]*")

_SINGLE = re.compile("[" + _ranges(sorted(c for c in _ONE if c < 0x10000 and chr(c) != _ONE[c])) + "]")


def _single(m: re.Match) -> str:
    return _ONE[ord(m.group())]


def aligned(text: str) -> tuple[str, list[int] | None]:
    """text folded for matching, and for each character of it the position in text (from 0) of its last code point; None: the positions are the same."""
    if text.isascii():
        return text, None
    if not _MOVES.search(text):
        return _SINGLE.sub(_single, text), None
    out: list[str] = []
    at: list[int] = []
    for m in _CLUSTER.finditer(text):
        new = _NFC("NFC", m.group().translate(_ALL))
        out.append(new)
        at += [m.end() - 1] * len(new)
    return "".join(out), at

