"""Text as columns. All patterns that mean words or blanks of any script carry (?U)."""

from __future__ import annotations

import itertools
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon

# Neighbouring ranges are written as one: each range of a class costs a test for every character.
JA = "\\u3040-\\u30ff\\u4e00-\\u9fff"


def words(c: Column) -> Column:
    """Runs between blanks of any kind; none for an empty text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def clean(c: Column) -> Column:
    """Composed characters, line feeds only, at most one empty line, lines and text stripped. Null stays null."""
    c = F.when(c.rlike(r"[^\x00-\x7f]"), _nfc(c)).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(c, "\n"), strip), "\n"))


_JP_CHAR = "\\u3000-\\u30ff\\u4e00-\\u9fff\\uff00-\\uffef"


def language(c: Column) -> Column:
    """ja, en or mixed by the share of Japanese characters (over a twentieth) and the number of Latin words (over five). Null and blank: en."""
    total = F.length(F.translate(c, " \n", ""))
    jp = F.length(F.regexp_replace(c, f"[^{_JP_CHAR}]+", ""))
    en = F.regexp_count(c, F.lit("[a-zA-Z]{3,}"))
    ja = jp / F.greatest(total, F.lit(1)) > 0.05
    return F.when(c.rlike(r"(?U)\S") & ja, F.when(en > 5, "mixed").otherwise("ja")).otherwise("en")


def language_name(c: Column) -> Column:
    return F.when(c == "ja", "Japanese").when(c == "en", "English").when(c == "mixed", "Mixed (JA/EN)").otherwise("Unknown")


def features(c: Column) -> Column:
    """Struct of flags of a language; unknown ones as for English."""
    out = None
    for lang, flags in lexicon.FEATURES.items():
        s = F.struct(*(F.lit(v).alias(n) for n, v in zip(lexicon.FEATURE_NAMES, flags, strict=True)))
        out = F.when(c == lang, s) if out is None else out.when(c == lang, s)
    return out.otherwise(F.struct(*(F.lit(v).alias(n) for n, v in zip(lexicon.FEATURE_NAMES, lexicon.FEATURES["en"], strict=True))))


#: Stands where a transcript was cut; seven words, which count.
NOTICE = "[... the middle part left out ...]"


def truncated(c: Column, most: int = 1200) -> Column:
    """Over `most` words: the first three fifths, a notice, the last two fifths."""
    w = words(c)
    a, b = int(most * 0.6), int(most * 0.4)
    cut = F.concat(F.array_join(F.slice(w, 1, a), " "), F.lit(f"\n\n{NOTICE}\n\n"), F.array_join(F.slice(w, -b, b), " "))
    return F.when(F.size(w) > most, cut).otherwise(c)


def summary_bullets(c: Column) -> Column:
    """How many bullets a summary is asked for: 3, 5, 7, or 8 and more, by 200, 600 and 1200 words."""
    n = F.size(words(c))
    return F.when(n < 200, 3).when(n < 600, 5).when(n < 1200, 7).otherwise(8)


def token_budget(c: Column) -> Column:
    n = F.size(words(c))
    return F.when(n < 300, 1500).when(n < 800, 2000).when(n < 2000, 2500).otherwise(3000)


def hinglish(c: Column) -> Column:
    """At least three occurrences of Hindi words in Latin letters."""
    marks = F.array(*map(F.lit, lexicon.HINGLISH))
    return F.size(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)")), lambda w: F.array_contains(marks, w))) >= 3


def large_model(c: Column, lang: Column) -> Column:
    """Whether a text goes to the large model: Japanese, mixed, Hinglish or over 600 words."""
    return c.rlike("[\\u3040-\\u9fff]") | lang.isin("ja", "mixed") | hinglish(c) | (F.size(words(c)) > 600)


# Labels that count as speakers, and lines that count as turns.
_HINT = r"(?m)^\s*(\[[A-Z]+_\d+\]|[A-Za-z぀-鿿][^\n:：\[\]]{0,30}?)\s*[:：]"


def speaker_hint(c: Column) -> Column:
    """The first ten labels, each once whatever its case, in order; placeholders too."""
    got = F.transform(F.regexp_extract_all(c, F.lit(_HINT)), lambda n: strip(F.regexp_replace(n, r"\s*\([^)]*\)", "")))
    got = F.filter(got, lambda n: (n != "") & ~n.rlike("^[0-9]+$"))
    first = F.filter(got, lambda n, i: F.array_position(F.transform(got, F.lower), F.lower(n)) == i + 1)
    return F.when(F.size(first) > 0, F.array_join(F.slice(first, 1, 10), ", ")).otherwise("Not detected")


_TURN = r"(?m)(?:^|\n)\s*(?:\[[A-Z]+_\d+\]|[A-Za-z぀-鿿][^\n:：]{0,30}?)[:：]"


def degenerate(c: Column) -> Column:
    """Not empty, at most 40 words, under two labelled turns and under two speakers."""
    n = F.size(words(c))
    hint = speaker_hint(c)
    speakers = F.when(hint == "Not detected", 0).otherwise(F.size(F.split(hint, ",")))
    return (n > 0) & (n <= 40) & (F.regexp_count(c, F.lit(_TURN)) < 2) & (speakers < 2)


def joined_labels(c: Column) -> Column:
    """A label alone on its line is put before the next line. The pattern is a fixed value."""
    return F.regexp_replace(c, r"(?m)^(?!https?:)([A-Za-z][A-Za-z\s.'\-]{1,38}?)\s*:\s*\n(?=[ \t]*\S)", "$1: ")


def has_labels(c: Column) -> Column:
    """At least two of the first 40 lines that aren't blank begin with a label. The patterns are fixed values."""
    name = r"[\w\s　-鿿]{1,40}"
    pats = [rf"(?U)^\*?\*?{name}\*?\*?\s*[：:]\s*\S", rf"(?U)^\[{name}\]\s*[：:]\s*\S", rf"(?U)^【{name}】\s*[：:]\s*\S"]
    lines = F.slice(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), 1, 40)
    return F.size(F.filter(lines, lambda x: reduce(lambda a, b: a | b, (x.rlike(p) for p in pats)))) >= 2


def labelled(c: Column) -> Column:
    """Bold marks removed; paragraphs (else lines) numbered as speakers where the text has no labels."""
    plain = F.regexp_replace(c, r"\*\*", "")
    keep = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")
    paras, lines = keep(F.split(plain, r"\n{2,}")), keep(F.split(plain, "\n"))
    parts = F.when(F.size(paras) > 0, paras).otherwise(lines)
    return F.when(has_labels(plain), plain).otherwise(F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("Speaker "), (i + 1).cast("string"), F.lit(": "), p)), "\n"))


def safe_id(c: Column, most: int = 64) -> Column:
    return F.substring(F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_"), 1, most)


def bullets(c: Column, fallback: Column) -> Column:
    """The bullets of at least four words, else the fallback."""
    good = F.filter(c, lambda b: F.size(words(b)) >= 4)
    return F.when(F.size(good) > 0, good).otherwise(fallback)


def ja_tokens(c: Column) -> Column:
    """Lower case; each kana or kanji is a token, other runs split at blanks; then pairs of neighbouring Japanese characters."""
    low = F.lower(c)
    units = words(F.regexp_replace(low, f"([{JA}])", " $1 "))
    cjk = F.regexp_extract_all(low, F.lit(f"([{JA}])"))
    return F.concat(units, _with_next(cjk, lambda a, b: F.concat(a, b)))


def _with_next(items: Column, f) -> Column:
    """f of each item and the next. An array of one binds the items, so that they are made once."""
    return F.transform(F.array(items), lambda a: F.filter(F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), f), lambda x: x.isNotNull()))[0]


def word_set(c: Column) -> Column:
    return F.array_distinct(words(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", "")))


def word_list(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)")))


def list_overlap(x: Column, y: Column) -> Column:
    """Common words of two word lists by the larger number of words; 0 where either has none."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def word_overlap(a: Column, b: Column) -> Column:
    """list_overlap of two texts."""
    return list_overlap(word_list(a), word_list(b))


def topic_terms(c: Column) -> Column:
    """Kanji runs, katakana runs and Latin words of four letters, without stop words."""
    got = F.concat(F.regexp_extract_all(c, F.lit("([\\u4e00-\\u9fff]{2,})")), F.regexp_extract_all(c, F.lit("([\\u30a0-\\u30ff]{2,})")), F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]{4,})")), F.lower))
    return F.array_except(F.array_distinct(got), F.array(*map(F.lit, lexicon.TOPIC_STOPS)))


def code_switches(c: Column) -> Column:
    """Changes between Japanese and other tokens, without stamps, labels and numbers."""
    t = F.regexp_replace(F.regexp_replace(c, r"\[\d{2}:\d{2}(?::\d{2})?\]", ""), r"(?mU)^[\w　-鿿]+[:：]\s*", "")
    tokens = F.filter(F.transform(words(t), lambda w: F.regexp_replace(w, r"(?U)[^\w぀-鿿]", "")), lambda w: (w != "") & ~w.rlike(r"^\d+$"))
    ja = F.transform(tokens, lambda w: w.rlike("[\\u3040-\\u30ff\\u4e00-\\u9fff\\u3400-\\u4dbf]"))
    return F.size(F.filter(_with_next(ja, lambda a, b: a != b), lambda x: x))


def match_name(c: Column) -> Column:
    """A name without honorifics, blanks, hyphens and underscores."""
    n = F.lower(strip(c))
    for s in ("さん", "様", "くん", "ちゃん", "先生", "部長", "課長", "san", "-san"):
        n = F.replace(n, F.lit(s), F.lit(""))
    return strip(F.regexp_replace(n, r"(?U)[\s\-_]", ""))


def names_match(a: Column, b: Column) -> Column:
    """Equal, one in the other, or the same first three characters; empty names never."""
    x, y = match_name(a), match_name(b)
    three = (F.length(x) >= 3) & (F.length(y) >= 3) & (F.substring(x, 1, 3) == F.substring(y, 1, 3))
    return (x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x) | three)


def grade(c: Column) -> Column:
    return F.when(c >= 0.8, "EXCELLENT").when(c >= 0.6, "GOOD").when(c >= 0.4, "FAIR").otherwise("POOR")


def clock(c: Column) -> Column:
    """Seconds of the day of 10:00 AM, 10:00AM, 10:00:00 or 10:00; else null."""
    s = F.upper(F.trim(c))
    m = lambda i: F.regexp_extract(s, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?\s?([AP]M)?$", i)
    h, mi, se, half = m(1).try_cast("int"), m(2).try_cast("int"), F.coalesce(m(3).try_cast("int"), F.lit(0)), m(4)
    twelve = half != ""
    hour = F.when(twelve, F.pmod(h, F.lit(12)) + F.when(half == "PM", 12).otherwise(0)).otherwise(h)
    ok = (mi < 60) & (se < 60) & F.when(twelve, h.between(1, 12) & (m(3) == "")).otherwise(h < 24)
    return F.when(ok, hour * 3600 + mi * 60 + se).cast("int")


def hits(c: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases the text holds."""
    return reduce(lambda a, b: a + b, (F.contains(c, F.lit(p)).cast("int") for p in phrases))


def keigo(c: Column) -> Column:
    """Register by markers: one high one is enough, else two medium ones."""
    return F.when(hits(c, lexicon.KEIGO_HIGH) >= 1, "high").when(hits(c, lexicon.KEIGO_MEDIUM) >= 2, "medium").otherwise("low")


def keigo_expected(c: Column) -> Column:
    return F.when(hits(c, lexicon.KEIGO_HIGH_EXPECTED) >= 2, "high").when(hits(c, lexicon.KEIGO_MEDIUM_EXPECTED) >= 3, "medium").otherwise("low")


#: Numbers in a pseudo-embedding.
PSEUDO = 384


def pseudo_embedding(c: Column, size: int = PSEUDO) -> Column:
    """Code points by a thousand of the first characters, padded with zeros."""
    v = F.transform(F.filter(F.split(F.substring(c, 1, size), ""), lambda x: x != ""), lambda x: F.ascii(x) / 1000.0)
    return F.concat(v, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(v)))


def pseudo_vectors(texts: pa.Array, size: int = PSEUDO) -> np.ndarray:
    """The pseudo-embeddings of an Arrow array of texts without nulls, a row each."""
    out = np.zeros((len(texts), size))
    for row, b in zip(out, texts.cast(pa.binary()).to_pylist(), strict=True):
        points = np.frombuffer(b.decode("utf-8", "replace")[:size].encode("utf-32-le"), "<u4")
        row[: len(points)] = points
    return out / 1000.0


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def rouge1(a: Column, b: Column) -> Column:
    """F1 of two token sets, to three places; 0 where either is empty."""
    n, x, y = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return F.when((x == 0) | (y == 0) | (n == 0), 0.0).otherwise(F.bround(2.0 * n / (x + y), 3))


def literal_map(pairs) -> Column:
    return F.create_map(*itertools.chain(*((F.lit(k), F.lit(v)) for k, v in pairs)))


# Stop words of the similarity of two Japanese or English texts.
_SIMILAR_STOPS = ("の", "は", "が", "を", "に", "で", "と", "も", "か", "な", "て", "し", "た", "です", "ます", "する", "いる", "ある", "こと", "ため", "the", "a", "an", "is", "are", "to", "of", "and", "or", "in")


def similarity(a: Column, b: Column) -> Column:
    """F1 of the tokens of two texts without stop words, to three places; 0 where one has none."""
    stops = F.array(*map(F.lit, _SIMILAR_STOPS))
    return rouge1(F.array_except(F.array_distinct(ja_tokens(a)), stops), F.array_except(F.array_distinct(ja_tokens(b)), stops))


def context_of(c: Column, phrase: Column, window: int = 100, kept: int = 120) -> Column:
    """The text around the first hit of a phrase, whatever its case: `window` characters on either side, stripped, the first `kept`; null without a hit."""
    at = F.position(F.lower(phrase), F.lower(c))
    start = F.greatest(at - window, F.lit(1))
    return F.when(at > 0, F.substring(strip(F.substr(c, start, at + F.length(phrase) + window - start)), 1, kept))


def speaker_before(c: Column, phrase: Column) -> Column:
    """The last word before a colon that stands before the first hit of a phrase and is no number, else Unknown."""
    at = F.position(F.lower(phrase), F.lower(c))
    names = F.filter(F.regexp_extract_all(F.substr(c, F.lit(1), F.greatest(at - 1, F.lit(0))), F.lit(r"([^\s\[\]:：\n]{2,30})\s*[:：]")), lambda n: ~n.rlike(r"^\d+$"))
    return F.when((at > 0) & (F.size(names) > 0), F.element_at(names, -1)).otherwise("Unknown")


def failure_class(c: Column) -> Column:
    """What kind of failure an error text tells of."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low == "", "none").when(low.rlike("rate|limit|quota|429"), "rate_limit").when(low.rlike("time ?out|timed"), "timeout").when(low.rlike("auth|key|401|403"), "auth").otherwise("other")
