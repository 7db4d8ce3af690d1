"""Problem 1: texts that show the same characters in different code points."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import cut
from . import frames


def _canonical():
    from .canon import canonical, digest, visual_key

    def f(key, text):
        if text is None:
            return [(key, None, None, False)]
        c = canonical(text)
        return [(key, c, digest(visual_key(text)), c != text)]

    return f


def canonical_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each row's text in one consistent form, with the digest of its comparison form.

    Columns: key, canonical, visual_key, changed. One row out per row in; a null text gives nulls and False, an empty one the empty text.
    Other columns of df play no part, whatever their names.
    """
    kind = df.schema[key].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    d = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return frames.rows_out(d, _canonical, f"{key} {kind}, canonical string, visual_key string, changed boolean", [(key, arrow), ("canonical", pa.string()), ("visual_key", pa.string()), ("changed", pa.bool_())])


def _digests():
    from .canon import digest, visual_key

    return lambda key, text: [(key, digest(visual_key(text)), digest(text))]


def same_text_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of keys (smaller first) whose texts show the same but differ as strings. Nulls take no part; equal strings are no pair.

    Only digests are shuffled. Groups of one text only are dropped by an aggregation with partial sums, so a hot group of equal copies
    costs one row per task; the rest of a group meets in blocks, and only different strings are a pair.
    """
    d = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    base = cut(frames.rows_out(d, _digests, "k string, v string, h string", [("k", pa.string()), ("v", pa.string()), ("h", pa.string())]))
    mixed = base.groupBy("v").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("v")
    rows = base.join(mixed, "v", "left_semi").distinct()
    n = rows.groupBy("v").agg(F.count("*").alias("n"))
    pairs = frames.block_pairs(rows.join(n, "v"), ["v"], ["k", "h"]).where("k_a < k_b AND h_a <> h_b")
    return pairs.select(F.col("k_a").alias(f"{key}_a"), F.col("k_b").alias(f"{key}_b")).distinct()


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_text_pairs(frames.read(spark, folder, "analyze_requests", ["request_id", "transcript"]), "request_id", "transcript")


def p1_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_text(frames.read(spark, folder, "analyze_requests", ["request_id", "transcript"]), "request_id", "transcript")


def _sql() -> str:
    """The pairs by whole-text normalisation: what the segments must come to. Maps of one code point, the Latin ligatures and the invisible ones."""
    from .canon import KEY_MAP

    lit = lambda t: "'" + t.replace("'", "''") + "'"
    one = {c: v for c, v in KEY_MAP.items() if len(v) == 1 and c < 0x10000}
    gone = "".join(f"\\x{{{c:x}}}" for c, v in KEY_MAP.items() if v == "" and c < 0x10000)
    key = f"regexp_replace(transcript, '[{gone}]', '', 'g')"
    for c in range(0xFB00, 0xFB07):
        key = f"replace({key}, {lit(chr(c))}, {lit(KEY_MAP[c])})"
    key = f"nfc_normalize(translate({key}, {lit(''.join(map(chr, one)))}, {lit(''.join(one.values()))}))"
    return f"""WITH k AS (SELECT DISTINCT request_id, transcript, {key} AS v FROM analyze_requests WHERE request_id IS NOT NULL AND transcript IS NOT NULL)
 SELECT DISTINCT a.request_id AS request_id_a, b.request_id AS request_id_b FROM k a JOIN k b ON a.v = b.v AND a.request_id < b.request_id AND a.transcript <> b.transcript"""


QUERIES = {"p1_found": p1_found, "p1_canonical_text": p1_canonical}
SQL = {"p1_found": _sql()}
