"""Problem 8: filling containers of fixed capacity.

Method: conflict-constrained best fit. Bins are held in the order of their residual, each with bitmaps of the sources and duplicate
clusters in it; an item goes to the tightest bin that can take it: the search starts at the least sufficient residual and moves on to the
next while a bin conflicts. Two documents of one duplicate cluster never share a container.

Documents are dealt to packers by hash, so that each packs a bounded number, all capacities alike; bins that stay slack are opened again and
their items packed together in a second round.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import cut
from . import frames
from .tokens import documents

#: Items that one packer holds in memory (sizes and ids only), and the fill from which a bin is closed in the first round.
PER_PACKER, CLOSED = 40_000, 0.97
#: Most kinds of container.
KINDS = 100


def best_fit(items: list[tuple[int, int, int, str | None]], capacity: int, sources_apart: bool = False) -> list[list[tuple[int, int, int, str | None]]]:
    """Bins of (size, id, cluster, source) items, none larger than capacity. The largest come first; ties by id, so the result is the same in any order of input.

    Two items of one cluster never share a bin; with sources_apart two of one source neither. Of equally tight bins that can take an item
    the first that holds its source is chosen, else the first: all of them are looked at, by their bitmaps.
    """
    names: dict[str | None, int] = {}
    marks: dict[int, int] = {}
    shared = {c for c, n in _counts(x[2] for x in items).items() if n > 1}
    residuals: list[int] = []  # in order, each once
    at: dict[int, dict[int, None]] = {}  # bins by residual, in the order they came to it
    own: dict[tuple[int, int], dict[int, None]] = {}  # the same by residual and source
    bins: list[list] = []
    clusters: list[int] = []
    sources: list[int] = []

    def place(b: int, left: int) -> None:
        if left not in at:
            insort(residuals, left)
        at.setdefault(left, {})[b] = None
        for x in dict.fromkeys(names[i[3]] for i in bins[b]):
            own.setdefault((left, x), {})[b] = None

    def take(b: int, left: int) -> None:
        del at[left][b]
        if not at[left]:
            del at[left], residuals[bisect_left(residuals, left)]
        for x in dict.fromkeys(names[i[3]] for i in bins[b]):
            del own[left, x][b]
            if not own[left, x]:
                del own[left, x]

    for item in sorted(items, key=lambda x: (-x[0], x[1])):
        size, _, cluster, source = item
        bit = 1 << marks.setdefault(cluster, len(marks)) if cluster in shared else 0
        name = names.setdefault(source, len(names))
        sbit = 1 << name
        best = None
        for i in range(bisect_left(residuals, size), len(residuals)):
            left = residuals[i]
            groups = (at[left],) if sources_apart else (own.get((left, name), ()), at[left])
            best = next((b for g in groups for b in g if not clusters[b] & bit and not (sources_apart and sources[b] & sbit)), None)
            if best is not None:
                break
        if best is None:
            bins.append([item])
            clusters.append(bit)
            sources.append(sbit)
            if capacity > size:
                place(len(bins) - 1, capacity - size)
            continue
        take(best, left)
        bins[best].append(item)
        clusters[best] |= bit
        sources[best] |= sbit
        if left > size:
            place(best, left - size)
    return bins


def _counts(xs) -> dict:
    out: dict = {}
    for x in xs:
        out[x] = out.get(x, 0) + 1
    return out


_SCHEMA = "container_kind string, capacity bigint, packer int, bin int, doc_id bigint, piece int, cluster bigint, source string, tokens bigint, used bigint"


def _packer(apart: bool, keys, pdf):
    import pandas as pd

    kind, capacity, packer = keys[0], int(keys[1]), keys[2]
    pieces = {i: (d, p) for i, (d, p) in enumerate(sorted(zip(pdf["doc_id"], pdf["piece"], strict=True)))}
    where = {v: k for k, v in pieces.items()}
    src = [None if pd.isna(s) else s for s in pdf["source"]]
    items = [(int(t), where[d, p], int(c), s) for d, p, c, s, t in zip(pdf["doc_id"], pdf["piece"], pdf["cluster"], src, pdf["tokens"], strict=True)]
    rows = []
    for b, held in enumerate(best_fit(items, capacity, apart)):
        used = sum(x[0] for x in held)
        rows += [(kind, capacity, packer, b, *pieces[i], c, s, t, used) for t, i, c, s in held]
    return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in _SCHEMA.split(", ")])


def containers(docs: DataFrame, kinds: DataFrame, packers: int | None = None, sources_apart: bool = False) -> DataFrame:
    """container_kind, container_id, doc_id, piece_no, source, tokens, used, capacity: where each document, or each piece of a larger one, lies.

    kinds has container_kind and capacity_tokens. A document larger than the capacity is split into full pieces and a rest; no other is
    split. sources_apart: no container has two documents of one source. Empty and null texts have no tokens and take no container. Without documents or kinds there is no row.
    """

    def pack(keys, pdf):
        return _packer(sources_apart, keys, pdf)

    k = kinds.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").limit(KINDS + 1).collect()
    if len(k) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of container")
    pairs = F.array(*(F.struct(F.lit(r.container_kind).alias("container_kind"), F.lit(int(r.capacity_tokens)).cast("bigint").alias("capacity")) for r in k)) if k else F.expr("array(named_struct('container_kind', '', 'capacity', 1L))")
    d = cut(docs.where("tokens > 0").select("doc_id", "source", "cluster", "tokens"))
    n = packers or max(1, -(-d.count() // PER_PACKER))
    one = d.select("*", F.inline(pairs)).where(F.lit(bool(k)))
    p = one.select("*", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / F.col("capacity")).cast("int"))).alias("piece"))
    size = F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity"))
    p = p.select("container_kind", "capacity", "doc_id", "piece", "source", "cluster", size.alias("tokens"))
    full, rest = p.where("tokens = capacity"), p.where("tokens < capacity")
    first = cut(rest.withColumn("packer", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).groupBy("container_kind", "capacity", "packer").applyInPandas(pack, _SCHEMA))
    closed = F.col("used") >= F.col("capacity") * CLOSED
    again = first.where(~closed).select("container_kind", "capacity", "doc_id", "piece", "source", "cluster", "tokens")
    # Slack bins hold little: their items are packed by fewer packers, again with a bounded number each.
    fewer = max(1, -(-again.count() // (3 * PER_PACKER)))
    second = again.withColumn("packer", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(fewer)).cast("int")).groupBy("container_kind", "capacity", "packer").applyInPandas(pack, _SCHEMA)
    a = first.where(closed).select("*", F.format_string("a%d-%d", "packer", "bin").alias("c"))
    b = second.select("*", F.format_string("b%d-%d", "packer", "bin").alias("c"))
    c = full.select("*", F.col("tokens").alias("used"), F.format_string("f%d-%d", "doc_id", "piece").alias("c"))
    cols = ["container_kind", "c", "doc_id", "piece", "source", "tokens", "used", "capacity"]
    out = a.select(*cols).union(b.select(*cols)).union(c.select(*cols))
    return out.select("container_kind", F.col("c").alias("container_id"), "doc_id", (F.col("piece") + 1).alias("piece_no"), "source", "tokens", "used", "capacity")


def fill(packed: DataFrame) -> DataFrame:
    """container_kind, containers, tokens, room_left: how full the containers are."""
    per = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t"), F.max("capacity").alias("c"))
    return per.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), (1 - F.sum("t") / F.sum("c")).alias("room_left"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return containers(documents(spark, folder), frames.read(spark, folder, "container_sizes", ["container_kind", "capacity_tokens"]))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill(p8_containers(spark, folder))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
