"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import frames

#: A ranks file of a public byte-level tokenizer, on every executor; a parameter of every operator here, and of the queries by SETTING.
SETTING = "spark.palaver.tokenizer"
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Its published split pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which a text is given to the tokenizer in pieces.
PIECE = 200_000
#: Where a piece may end: before a blank that follows no blank, where a token ends in any case.
_EDGE = re.compile(r"(?<=\S)[ \n]")


def counter(path: str = RANKS):
    """A function from a text to its number of tokens; null counts 0. Very long texts are cut where tokens end anyway; a stretch without such a place isn't cut, so the number is exact."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("palaver", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def count(text: str | None) -> int:
        if not text:
            return 0
        n = at = 0
        while len(text) - at > PIECE and (m := _EDGE.search(text, at + PIECE)):
            n += len(encode(text[at : m.start()]))
            at = m.start()
        return n + len(encode(text[at:]))

    return count


def sized(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, source, cluster, tokens of each document with an id. cluster is the same for texts that differ in case and blanks only."""

    def make():
        from hashlib import blake2b

        count = counter(path)

        def f(doc, text, source):
            key = blake2b(" ".join((text or "").lower().split()).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            return [(doc, source, int.from_bytes(key, "little", signed=True), count(text))]

        return f

    kinds = [("doc_id", pa.int64()), ("source", pa.string()), ("cluster", pa.int64()), ("tokens", pa.int64())]
    return frames.rows_out(docs.where("doc_id IS NOT NULL").select("doc_id", "text", "source"), make, "doc_id bigint, source string, cluster bigint, tokens bigint", kinds)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with their sizes in tokens of the tokenizer that the session's SETTING names, else RANKS."""
    return sized(frames.read(spark, folder, "documents", ["doc_id", "text", "source"]), spark.conf.get(SETTING, RANKS))
