"""Batches of Arrow columns through plain Python functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import ship


def read(spark: SparkSession, folder: str, table: str, columns: list[str]) -> DataFrame:
    """The named columns of one table; Parquet reads no others."""
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*columns)


def rows_out(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, fields: list[tuple[str, pa.DataType]], batch: int = 20_000) -> DataFrame:
    """For each row of df, the rows that the function gives for its columns. make() is called once per task, so that tables and models load once."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        kinds = [k for _, k in fields]
        names = [n for n, _ in fields]
        out: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.extend(f(*row))
                if len(out) >= batch:
                    yield _pack(out, kinds, names)
                    out = []
        if out:
            yield _pack(out, kinds, names)

    return df.mapInArrow(run, schema)


def _pack(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


#: Members of a group that meet in one task when its pairs are listed, about.
BLOCK = 1_000


def block_pairs(members: DataFrame, keys: list[str], extra: list[str], most: int | None = None) -> DataFrame:
    """Pairs of the members of each group: keys, and each column of extra as NAME_a and NAME_b; each pair in both orders, and each member with itself.

    members has the keys, their number n, and extra, whose first column deals the members to blocks of about `most` (BLOCK). A pair of
    blocks is a task's unit, so no task holds all pairs of a hot group.
    """
    c = members.withColumn("_blocks", F.ceil(F.col("n") / (most or BLOCK)).cast("int"))
    c = c.withColumn("_own", F.pmod(F.xxhash64(extra[0]), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    side = lambda x, first, second: c.select(*keys, F.col(first).alias("_block_a"), F.col(second).alias("_block_b"), *(F.col(e).alias(f"{e}_{x}") for e in extra))
    return side("a", "_own", "_other").join(side("b", "_other", "_own"), [*keys, "_block_a", "_block_b"]).drop("_block_a", "_block_b")


def distinct_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """df without nulls and without repeated rows of one key and text. Repeats within a task are dropped before the shuffle, which carries the texts."""
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).dropDuplicates([key, text])
