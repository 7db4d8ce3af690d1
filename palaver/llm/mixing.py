"""Problem 9: mixing sources to target weights.

Method: hash-random keys, a range sort within each source, distributed prefix sums of token counts, and a cut at each source's exact budget,
with whole epochs before the last, partial one. Prefix sums are local to range partitions plus the sums of the partitions before, so a source
with a third of all rows is spread over as many tasks as it fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..stage import cut
from . import frames
from .tokens import documents


#: Most rows of the table of targets, which goes to every task.
MOST_TARGETS = 10_000


def prefixes(items: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, tokens, upto: tokens of the source up to and with the document, in hash-random order."""
    keyed = items.select("doc_id", "source", "tokens", F.xxhash64(F.lit(seed), "doc_id").alias("key"))
    ranged = cut(keyed.repartitionByRange("source", "key", "doc_id").withColumn("part", F.spark_partition_id()))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("source", "part").agg(F.sum("tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    local = W.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    rows = ranged.withColumn("local", F.sum("tokens").over(local))
    return rows.join(sums.select("source", "part", "base"), ["source", "part"]).select("doc_id", "source", "tokens", (F.col("base") + F.col("local")).alias("upto"))


def budgets(items: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """source, target_share, max_repeats, have, budget. Without a total the mix is as large as the caps on repeats allow.

    A source without documents has nothing to give; the others keep their proportions to each other, and the report shows the shares reached.
    """
    have = items.groupBy("source").agg(F.sum("tokens").alias("have"))
    t = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(have, "source", "left").na.fill(0, ["have"])
    every = W.partitionBy()  # one row a target
    given = F.col("have") > 0
    t = t.withColumn("most", F.min(F.when(given, F.col("max_repeats") * F.col("have") / F.col("target_share"))).over(every)).withColumn("shares", F.sum(F.when(given, F.col("target_share"))).over(every))
    most = F.least(F.col("most"), F.lit(total) / F.col("shares")) if total is not None else F.col("most")
    return t.select("source", "target_share", "max_repeats", "have", F.when(F.col("have") > 0, F.floor(F.col("target_share") * most + 1e-6)).otherwise(F.lit(0)).cast("bigint").alias("budget"))


def mix(items: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11) -> DataFrame:
    """source, doc_id, epoch, tokens: the records of the mix. Each source stops before the record that would pass its budget; no record comes more than max_repeats times.

    items has doc_id, source, tokens (see tokens.sized). Records without tokens, source or target take no part. More than MOST_TARGETS targets are an error.
    """
    if targets.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    d = items.where("tokens > 0 AND source IS NOT NULL").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    p = prefixes(d, seed)
    b = budgets(d, targets, total).where("budget > 0").select("source", "budget", "have", "max_repeats")
    whole = F.floor(F.col("budget") / F.col("have"))
    times = F.least(F.col("max_repeats"), whole + (F.col("upto") <= F.col("budget") - whole * F.col("have")).cast("bigint"))
    m = p.join(F.broadcast(b), "source").withColumn("times", times.cast("int")).where("times > 0")
    return m.select("source", "doc_id", F.explode(F.sequence(F.lit(1), "times")).alias("epoch"), "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, tokens, actual_share, most_repeats of every target, with 0 where a source gave nothing."""
    per = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("epoch").alias("most_repeats"))
    out = targets.where("source IS NOT NULL").select("source", "target_share").join(per, "source", "left").na.fill(0, ["tokens", "most_repeats"])
    return out.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(W.partitionBy()))


def _items(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = frames.read(spark, folder, "mix_targets", ["source", "target_share", "max_repeats"])
    return cut(documents(spark, folder).select("doc_id", "source", "tokens")), targets


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(*_items(spark, folder))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    items, targets = _items(spark, folder)
    return shares(mix(items, targets), targets)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
