"""Problem 10: long spans that stand word for word in more than one document.

Method: suffix automata of reference passages; documents stream through them for matching statistics, and maximal spans of at least the
threshold are reported and can be removed. Which passages can match is found first, without loss: of every window of LEAST - GRAM + 1
consecutive grams of GRAM characters the one with the least hash is kept, so two texts with LEAST characters in common keep a gram in common.
Only stretches around such grams become passages; a passage's automaton meets the passages that share a gram with it. The references grow
with the corpus, so their automata are sent to the tasks that need them, by shuffle, instead of to all.

One plan serves every size. What no other document shares is dropped before the shuffles by a bit set of BITS bits, which is broadcast and
can't grow with the data; the joins behind it are exact, so a bit that is set by chance costs time only.

A gram kept by more than MANY documents isn't paired: its occurrences form classes on the exact window of LEAST characters. Windows with
the same documents are one class, and pairs, where they must be listed, come from its blocks (frames.block_pairs).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import cut
from . import frames

LEAST, GRAM, MANY = 200, 80, 48
#: Longest passage of one automaton; a longer one is cut into pieces that overlap by LEAST - 1.
PIECE = 8_000
#: Bits of the set that stands for the keys of a join: 2**20 words of 64, so 16 MB at most are broadcast whatever the data.
BITS = 1 << 26
_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = _powers[base] = np.cumprod(np.full(size, base, dtype=np.uint64))
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k code points, by prefix sums of a polynomial modulo 2**64."""
    c = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(77))
    n = len(c)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * _power(_B, n))])
    return _mix((sums[k:] - sums[:-k]) * _power(_INV, n)[: n - k + 1])


def _slide(a: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each window of w entries, in about log2(w) passes."""
    s = 1
    while 2 * s <= w:
        a = f(a[:-s], a[s:])
        s *= 2
    return f(a[: len(a) - (w - s)], a[w - s :]) if s < w else a


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the entries that are least in some window of w."""
    if not len(h):
        return np.empty(0, np.int64)
    if len(h) <= w:
        return np.flatnonzero(h == h.min())
    edge = np.zeros(w - 1, np.uint64)
    low = np.concatenate([edge, _slide(h, w, np.minimum), edge])
    return np.flatnonzero(_slide(low, w, np.maximum) == h)


class Automaton:
    """Suffix automaton of one text, with the end of a first occurrence of each state."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        nxt, link, length, end = self.next, self.link, self.length, self.end
        for i, c in enumerate(text):
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            end.append(i)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    end.append(end[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def spans(self, text: str, least: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, start in the automaton's text) of the maximal matches of at least `least` characters, none within another."""
        nxt, link, length = self.next, self.link, self.length
        s = n = 0
        held: tuple[int, int, int] | None = None
        for i, c in enumerate(text):
            if c in nxt[s]:
                s = nxt[s][c]
                n += 1
            else:
                if n >= least:
                    held = (i - n, i, self.end[s] + 1 - n)
                    yield held
                while s and c not in nxt[s]:
                    s = link[s]
                    n = length[s]
                if c in nxt[s]:
                    s = nxt[s][c]
                    n += 1
                else:
                    s = n = 0
        if n >= least:
            yield len(text) - n, len(text), self.end[s] + 1 - n


def _grams():
    def f(doc, text):
        h = gram_hashes(text, GRAM)
        at = winnow(h, LEAST - GRAM + 1)
        return zip([doc] * len(at), h[at].view(np.int64).tolist(), at.tolist(), strict=True)

    return f


def _passages(most: int):
    def pieces(doc, text, found):
        """One row for each gram of each passage: the passage's place and, on its first row, its text."""
        out = []
        start = end = None
        grams: list[tuple[int, int]] = []

        def close():
            a = start
            while True:
                b = min(a + most, end)
                inside = dict.fromkeys(g for p, g in grams if a <= p and p + GRAM <= b)
                out.extend((doc, a, g, text[a:b] if i == 0 else None, None, None) for i, g in enumerate(inside))
                if b == end:
                    break
                a = b - LEAST + 1  # every window of LEAST characters lies in one piece

        for p, g in found:
            a, b = max(0, p + GRAM - LEAST), min(len(text), p + LEAST)
            if end is not None and a <= end:
                end = max(end, b)
            else:
                if end is not None:
                    close()
                start, end, grams = a, b, []
            grams.append((p, g))
        if end is not None:
            close()
        return out

    def windows(doc, text, places):
        """Hashes of the exact windows that hold a gram which many documents hold."""
        h = gram_hashes(text, LEAST)
        keep = np.zeros(len(h), bool)
        for p in places:
            keep[max(0, p + GRAM - LEAST) : p + 1] = True
        at = np.flatnonzero(keep)
        # a second hash from another gram length makes the key 128 bits wide
        tail = gram_hashes(text, LEAST - 1)[at]
        return [(doc, p, None, None, a, b) for a, b, p in zip(h[at].view(np.int64).tolist(), tail.view(np.int64).tolist(), at.tolist(), strict=True)]

    def f(doc, text, found):
        rare = sorted((x["pos"], x["gram"]) for x in found if not x["many"])
        many = [x["pos"] for x in found if x["many"]]
        return (pieces(doc, text, rare) if rare else []) + (windows(doc, text, many) if many else [])

    return f


def _matches():
    place: tuple | None = None
    hashes = np.empty(0, np.uint64)
    automaton: Automaton | None = None

    def f(doc_a, at_a, text_a, doc_b, at_b, text_b):
        nonlocal place, hashes, automaton
        if place != (doc_a, at_a):
            place, hashes, automaton = (doc_a, at_a), np.sort(gram_hashes(text_a, LEAST)), None
        # Passages that share a gram but no window of LEAST characters need no automaton.
        own = gram_hashes(text_b, LEAST)
        at = np.searchsorted(hashes, own)
        if not len(hashes) or not (hashes[np.minimum(at, len(hashes) - 1)] == own).any():
            return []
        automaton = automaton or Automaton(text_a)
        return [(doc_a, at_a + x, doc_b, at_b + i, at_b + j) for i, j, x in automaton.spans(text_b, LEAST)]

    return f


_SPAN = [("doc_a", pa.int64()), ("start_a", pa.int64()), ("doc_b", pa.int64()), ("start_b", pa.int64()), ("end_b", pa.int64())]


def _bit(key: str) -> tuple[Column, Column]:
    """Word and bit of a key in the set."""
    h = F.pmod(F.xxhash64(key), F.lit(BITS))
    return F.floor(h / 64).cast("int"), (h % 64).cast("int")


def _bit_set(keys: DataFrame, key: str) -> DataFrame:
    """The set of the keys' bits: rows of word and bits, BITS / 64 at most."""
    word, bit = _bit(key)
    return keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _with_bit(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """df with _in: whether the key's bit is set. False is certain, True may be chance."""
    word, bit = _bit(key)
    d = df.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    return d.withColumn("_in", F.coalesce(F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(False))).drop("_word", "_bits")


def _may(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows of df whose key may be in the set; none that is in it is lost."""
    return _with_bit(df, key, bits).where("_in").drop("_in")


class Shared:
    """What the documents share, as stage tables that the results below are drawn from.

    docs has doc_id (unique) and text; nulls and texts under LEAST characters take no part.
    """

    def __init__(self, docs: DataFrame):
        d = docs.where(f"doc_id IS NOT NULL AND length(text) >= {LEAST}").select("doc_id", "text")
        grams = cut(frames.rows_out(d, _grams, "doc_id bigint, gram bigint, pos int", [("doc_id", pa.int64()), ("gram", pa.int64()), ("pos", pa.int32())]))
        g = grams.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
        held = cut(g.select("gram", (F.col("n") > MANY).alias("many")))
        shared = cut(_may(grams, "gram", cut(_bit_set(held, "gram"))).join(held, "gram"))
        where = shared.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "gram", "many")).alias("found"))
        texts = _may(d, "doc_id", cut(_bit_set(shared, "doc_id"))).join(where, "doc_id")
        kinds = [("doc_id", pa.int64()), ("at", pa.int64()), ("gram", pa.int64()), ("piece", pa.string()), ("h", pa.int64()), ("h2", pa.int64())]
        rows = cut(frames.rows_out(texts, partial(_passages, PIECE), "doc_id bigint, at bigint, gram bigint, piece string, h bigint, h2 bigint", kinds))
        self.pieces = rows.where("gram IS NOT NULL").select("doc_id", "at", "gram", "piece")
        w = rows.where("h IS NOT NULL").select("doc_id", "at", "h", "h2")
        many = w.groupBy("h", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
        #: doc_id, at, h, h2, lo, hi: the windows of hot grams that several documents hold, with the first and last of these.
        self.windows = cut(w.join(many, ["h", "h2"]))

    def spans(self, both: bool = False) -> DataFrame:
        """doc_a, start_a, doc_b, start_b, end_b: maximal spans of doc_b (positions from 0, end excluded) that stand in doc_a too, at start_a, for grams that aren't hot.

        both: each pair in both orders; else doc_a < doc_b only. Spans end where a piece of PIECE characters ends; what they cover together is exact.
        """
        g = self.pieces.select("doc_id", "at", "gram")
        a, b = (g.select(F.col("doc_id").alias(f"doc_{x}"), F.col("at").alias(f"at_{x}"), "gram") for x in "ab")
        pairs = a.join(b, "gram").where("doc_a <> doc_b" if both else "doc_a < doc_b").select("doc_a", "at_a", "doc_b", "at_b").distinct()
        p = self.pieces.where("piece IS NOT NULL")
        pa_, pb = (p.select(F.col("doc_id").alias(f"doc_{x}"), F.col("at").alias(f"at_{x}"), F.col("piece").alias(f"piece_{x}")) for x in "ab")
        rows = pairs.join(pb, ["doc_b", "at_b"]).join(pa_, ["doc_a", "at_a"]).select("doc_a", "at_a", "piece_a", "doc_b", "at_b", "piece_b")
        schema = "doc_a bigint, start_a bigint, doc_b bigint, start_b bigint, end_b bigint"
        return frames.rows_out(rows.sortWithinPartitions("doc_a", "at_a"), _matches, schema, _SPAN)

    def covered(self, earlier: bool = False) -> DataFrame:
        """doc_id, start, end: spans that together cover all that stands in another document, or in one of a smaller id."""
        spans = self.spans(both=not earlier).select(F.col("doc_b").alias("doc_id"), F.col("start_b").alias("start"), F.col("end_b").alias("end"))
        w = self.windows.where("doc_id > lo") if earlier else self.windows
        return spans.union(w.select("doc_id", F.col("at").alias("start"), (F.col("at") + LEAST).alias("end"))).distinct()

    def classes(self) -> DataFrame:
        """h, h2, n, doc_id: the members of each class of documents that hold a window of hot grams in common; windows with the same documents are one class."""
        held = self.windows.select("h", "h2", "doc_id").distinct()
        # Exclusive or of two hashes of each document: the same for the same documents.
        sign = held.groupBy("h", "h2").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
        one = sign.groupBy("n", "x", "y").agg(F.min(F.struct("h", "h2")).alias("w")).select("w.h", "w.h2", "n")
        return held.join(one, ["h", "h2"])

    def pairs(self) -> DataFrame:
        """doc_a, doc_b (smaller first): the pairs that share a span. A class is dealt to blocks, so that no task holds all its pairs."""
        hot = frames.block_pairs(self.classes().withColumnRenamed("doc_id", "doc"), ["h", "h2"], ["doc"]).where("doc_a < doc_b").select("doc_a", "doc_b")
        return self.spans().select("doc_a", "doc_b").union(hot).distinct()


def shared_pairs(docs: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b (smaller first): the pairs of documents with a common run of at least LEAST characters."""
    return Shared(docs).pairs().select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cover():
    return lambda doc, spans: [(doc, len(m), sum(e - s for s, e in m)) for m in [_merged(spans)]]


def shared_parts(docs: DataFrame) -> DataFrame:
    """doc_id, n_spans, shared_chars, n_chars, shared_part: how much of each document stands in others; 0 for those that share nothing or are null or empty."""
    per = Shared(docs).covered().groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    cover = frames.rows_out(per, _cover, "doc_id bigint, n_spans bigint, shared_chars bigint", [("doc_id", pa.int64()), ("n_spans", pa.int64()), ("shared_chars", pa.int64())])
    n = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    out = docs.where("doc_id IS NOT NULL").select("doc_id", n.alias("n_chars")).join(cover, "doc_id", "left").na.fill(0, ["n_spans", "shared_chars"])
    return out.select("doc_id", "n_spans", "shared_chars", "n_chars", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_part"))


def _kept():
    def f(doc, text, spans):
        out, at = [], 0
        for s, e in _merged(spans or ()):
            out.append(text[at:s])
            at = e
        return [(doc, "".join(out) + text[at:], bool(spans))]

    return f


def without_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, cut_out: each document without the spans that a document of a smaller id holds, so that the first copy of each stays. A null text stays null.

    Only texts that can hold such a span are shuffled; the rest pass by.
    """
    spans = cut(Shared(docs).covered(earlier=True))
    d = _with_bit(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "doc_id", cut(_bit_set(spans, "doc_id")))
    per = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    rows = d.where("_in AND text IS NOT NULL").select("doc_id", "text").join(per, "doc_id", "left")
    pruned = frames.rows_out(rows, _kept, "doc_id bigint, text string, cut_out boolean", [("doc_id", pa.int64()), ("text", pa.string()), ("cut_out", pa.bool_())])
    return pruned.union(d.where("NOT _in OR text IS NULL").select("doc_id", "text", F.lit(False)))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_pairs(frames.read(spark, folder, "documents", ["doc_id", "text"]))


def p10_shared_parts(spark: SparkSession, folder: str) -> DataFrame:
    return shared_parts(frames.read(spark, folder, "documents", ["doc_id", "text"]))


def p10_without_spans(spark: SparkSession, folder: str) -> DataFrame:
    return without_spans(frames.read(spark, folder, "documents", ["doc_id", "text"])).select("doc_id", F.length("text").alias("kept_chars"), F.md5("text").alias("kept_md5"), "cut_out")


QUERIES = {"p10_found": p10_found, "p10_shared_parts": p10_shared_parts, "p10_without_spans": p10_without_spans}
_G = f"g AS (SELECT DISTINCT doc_id, i, md5(substr(text, i, {LEAST})) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - {LEAST - 2})) AS i FROM documents WHERE length(text) >= {LEAST}))"
_ISLANDS = f"""(SELECT doc_id, min(i) AS s, max(i) + {LEAST} AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
 SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LEAST} THEN 1 ELSE 0 END AS new FROM w)) GROUP BY doc_id, k)"""
SQL = {
    "p10_found": f"""WITH {_G}, d AS (SELECT DISTINCT doc_id, h FROM g),
 m AS (SELECT h FROM d GROUP BY h HAVING count(*) > 1) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT * FROM d SEMI JOIN m USING (h)) a JOIN (SELECT * FROM d SEMI JOIN m USING (h)) b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_shared_parts": f"""WITH {_G}, m AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)), w AS (SELECT doc_id, i FROM g SEMI JOIN m USING (h)),
 c AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS shared_chars FROM {_ISLANDS} GROUP BY doc_id)
 SELECT doc_id, coalesce(n_spans, 0) AS n_spans, CAST(coalesce(shared_chars, 0) AS BIGINT) AS shared_chars, coalesce(length(text), 0) AS n_chars, CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / length(text) ELSE 0.0 END AS shared_part
 FROM documents LEFT JOIN c USING (doc_id) WHERE doc_id IS NOT NULL""",
    "p10_without_spans": f"""WITH {_G}, m AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h), w AS (SELECT g.doc_id, g.i FROM g JOIN m USING (h) WHERE g.doc_id > m.lo),
 x AS (SELECT doc_id, list(struct_pack(s := s, e := e) ORDER BY s) AS spans FROM {_ISLANDS} GROUP BY doc_id),
 k AS (SELECT doc_id, spans IS NOT NULL AS cut_out, CASE WHEN spans IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(spans) + 2),
  lambda j: CASE WHEN j > len(spans) THEN substr(text, spans[len(spans)].e) WHEN j = 1 THEN substr(text, 1, spans[1].s - 1) ELSE substr(text, spans[j - 1].e, spans[j].s - spans[j - 1].e) END), '') END AS text FROM documents LEFT JOIN x USING (doc_id) WHERE doc_id IS NOT NULL)
 SELECT doc_id, length(text) AS kept_chars, md5(text) AS kept_md5, cut_out FROM k""",
}
