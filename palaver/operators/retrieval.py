"""Vector search and result caches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import PSEUDO, pseudo_embedding, pseudo_vectors, safe_id
from ..sources.seed import MEETINGS, rows
from ..stage import cut, ship
from .signals import _LEVEL, _RISK
from .texts import SQL as TEXT_SQL

#: Numbers in the query vectors that one pass over the store carries to its tasks, about (32 MB: 65,536 vectors of 64 numbers, 10,922 of 384); they are dealt to passes by hash.
BLOCK = 1 << 22
#: Rows and queries of one matrix product in a task (16 MB).
TILE = 2_048
#: Places of a cosine; equal vectors are equally near, wherever they stand in a block.
PLACES = 9
#: Cosine from which a semantic cache answers.
SEMANTIC = 0.92


def topk(store: DataFrame, queries: DataFrame, k: int, least: float | None = None, same: str | None = None, other: bool = False) -> DataFrame:
    """query_id, vec_id, similarity, place: for each query (query_id, embedding[, same]) the k rows of the store (vec_id, embedding[, same]) of the highest cosine.

    Exact, so the recall is 1. Queries go through the store in blocks of about BLOCK numbers; each block's rows are written before the next is
    read, so the driver holds one block at a time. Each task keeps its k best, and only those are shuffled. same: a column that must be equal
    (null equals null), applied before the cosine. other: rows of the query's own id don't count. least is applied after the cut at k. Cosines
    count to PLACES places, and ties go to the lower vec_id; null, empty and zero vectors match nothing, and vectors meet only those of their
    own length. Where embedding is a text, it stands for its pseudo-embedding, which the tasks make of it: texts are read and sent at a fraction
    of what their vectors take.
    """
    cols = ["query_id", "embedding", *([same] if same else [])]
    size = F.when(F.length("embedding") > 0, PSEUDO) if dict(queries.dtypes)["embedding"] == "string" else F.size("embedding")
    q = queries.where(F.col("query_id").isNotNull() & (size > 0)).select(*cols)
    n, numbers = q.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = min(n, -(-numbers // BLOCK))
    out = None
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if rows.num_rows:
            found = _block(store, rows, k, least, same, other)
            found = cut(found) if blocks > 1 else found
            out = found if out is None else out.union(found)
    if out is None:
        return store.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, similarity double, place int")
    w = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    best = out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return best if least is None else best.where(F.col("similarity") >= least)


def _units(ids: pa.Array, emb: pa.Array, keys: pa.Array | None) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(length, key), ids in order and unit vectors of all rows of that length and key; rows without an id or a direction are left out."""
    text = pa.types.is_string(emb.type) or pa.types.is_large_string(emb.type)
    sizes = np.where(ids.is_valid(), np.where(emb.is_valid(), PSEUDO, 0) if text else pc.fill_null(pc.list_value_length(emb), 0), 0)
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = pa.array(sizes == size)
        x = pseudo_vectors(emb.filter(own)) if text else emb.filter(own).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
        norm = np.linalg.norm(x, axis=1)
        at: dict = {}
        for i, key in enumerate(keys.filter(own).to_pylist() if keys is not None else [None] * len(x)):
            at.setdefault(key, []).append(i)
        v = ids.filter(own).to_numpy().astype(np.int64)
        for key, held in at.items():
            i = np.array(held)
            i = i[(norm[i] > 0) & np.isfinite(norm[i])]
            if len(i):
                i = i[np.argsort(v[i], kind="stable")]
                yield (size, key), v[i], x[i] / norm[i][:, None]


def _search(vec: np.ndarray, x: np.ndarray, ids: np.ndarray, unit: np.ndarray, s: np.ndarray, v: np.ndarray, least: float, other: bool) -> None:
    """Merges the rows vec, x into the k best of the queries ids, unit: cosines s and ids v, a row for each query, best first.

    The product is of single precision and says only which pairs can be among the best; their cosines are counted in double precision.
    """
    k = s.shape[1]
    # What a cosine of unit vectors in single precision is off by, at most, and what rounding hides.
    off = (x.shape[1] + 8) * 2.0**-24 + 2 * 10.0**-PLACES
    near = x.astype(np.float32) @ unit.astype(np.float32).T
    if other:
        lo, hi = np.searchsorted(ids, vec, "left"), np.searchsorted(ids, vec, "right")
        for i in np.flatnonzero(lo < hi):
            near[i, lo[i] : hi[i]] = -2
    floor = np.maximum(s[:, -1], least) - off
    cols = np.flatnonzero(near.max(axis=0) >= floor)
    if not len(cols):
        return
    near, floor = near[:, cols], np.maximum(floor[cols], -1.5)
    if len(near) > k:
        floor = np.maximum(floor, np.partition(near, -k, axis=0)[-k] - 2 * off)
    i, j = np.nonzero(near >= floor)
    if not len(i):
        return
    j = cols[j]
    c = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + TILE]], unit[j[a : a + TILE]]) for a in range(0, len(i), TILE)]).round(PLACES)
    order = np.lexsort((vec[i], -c, j))
    i, j, c = i[order], j[order], c[order]
    own, start, count = np.unique(j, return_index=True, return_counts=True)
    place = np.arange(len(j)) - np.repeat(start, count)
    row = np.repeat(np.arange(len(own)), count)
    ok = place < k
    both_s, both_v = np.full((len(own), 2 * k), -np.inf), np.zeros((len(own), 2 * k), np.int64)
    both_s[:, :k], both_v[:, :k] = s[own], v[own]
    both_s[row[ok], k + place[ok]], both_v[row[ok], k + place[ok]] = c[ok], vec[i[ok]]
    first = np.lexsort((both_v, -both_s), axis=1)[:, :k]
    s[own], v[own] = np.take_along_axis(both_s, first, 1), np.take_along_axis(both_v, first, 1)


def _block(store: DataFrame, rows: pa.Table, k: int, least: float | None, same: str | None, other: bool) -> DataFrame:
    ship(store.sparkSession)
    column = lambda c: pa.concat_arrays(rows.column(c).chunks)
    held = {key: (ids, unit) for key, ids, unit in _units(column("query_id"), column("embedding"), column(same) if same else None)}
    least = -np.inf if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {key: (np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)) for key, (ids, _) in held.items()}
        for b in batches:
            for key, vec, x in _units(b.column(0), b.column(1), b.column(2) if same else None):
                if key in held:
                    ids, unit, s, v = *held[key], *best[key]
                    for r in range(0, len(vec), TILE):
                        for q in range(0, len(ids), TILE):
                            _search(vec[r : r + TILE], x[r : r + TILE], ids[q : q + TILE], unit[q : q + TILE], s[q : q + TILE], v[q : q + TILE], least, other)
        for key, (s, v) in best.items():
            i, j = np.nonzero(s >= max(least, -2))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(held[key][0][i]), pa.array(v[i, j]), pa.array(s[i, j])], names=["query_id", "vec_id", "similarity"])

    return store.select("vec_id", "embedding", *([same] if same else [])).mapInArrow(run, "query_id bigint, vec_id bigint, similarity double")


def nearest_other(store: DataFrame, queries: DataFrame, least: float = SEMANTIC, same: str | None = None) -> DataFrame:
    """query_id, vec_id, similarity of the nearest row of the whole store other than the query's own, where its cosine reaches least; same: a column that must be equal, such as the language."""
    return topk(store, queries, 1, least, same, other=True).select("query_id", "vec_id", "similarity")


def cache_key(text, language=None):
    """md5 of language and stripped text, as a column."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.md5(body if language is None else F.concat(F.coalesce(language, F.lit("en")), F.lit("::"), body))


def cache_latest(entries: DataFrame, key: str, at: str) -> DataFrame:
    """The last write of each key; equal times go to the greater row."""
    w = W.partitionBy(key).orderBy(F.col(at).desc(), F.xxhash64(*entries.columns).desc())
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cache_get(asked: DataFrame, entries: DataFrame, key: str, at: str, as_of, ttl: str = "INTERVAL 24 HOURS") -> DataFrame:
    """asked with the entry of its key that is younger than the ttl at as_of; misses have nulls."""
    e = cache_latest(entries, key, at)
    return asked.join(e, key, "left").withColumn("hit", F.col(at).isNotNull() & (F.col(at) > as_of - F.expr(ttl)) & (F.col(at) <= as_of))


def upsert(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Both tables, the latest row of each key."""
    return cache_latest(old.unionByName(new, allowMissingColumns=True), key, at)


def meeting_rows(analysed: DataFrame, at) -> DataFrame:
    """Rows of the meeting store from analysed meetings (meeting_id, transcript, summary, language, risk_level, risk_label, keigo, speakers, actions): document, pseudo-embedding and metadata. Upsert them by meeting_id and date."""
    doc = F.concat(F.col("transcript"), F.lit("\n\nSUMMARY: "), F.coalesce(F.array_join("summary", " "), F.lit("")))
    return analysed.select(
        "meeting_id", doc.alias("document"), pseudo_embedding(doc).alias("embedding"), at.alias("date"), "language", F.coalesce("risk_level", F.lit("NONE")).alias("soft_risk"), F.coalesce("risk_label", F.lit("UNKNOWN")).alias("halluc_risk"),
        F.coalesce("keigo", F.lit("unknown")).alias("keigo_level"), F.coalesce("speakers", F.lit(0)).alias("speaker_count"), F.coalesce("actions", F.lit(0)).alias("action_count"), F.length("transcript").alias("char_length"),
    )


def excerpt(document):
    """The first 300 characters before the summary."""
    return F.substring(F.split(document, "\n\nSUMMARY:")[0], 1, 300)


def vector_rows(results: DataFrame, at) -> DataFrame:
    """Rows of the semantic cache from results (user_id, language, masked, result): the first 2000 characters of the masked text, its digest as id."""
    return results.select(F.substring(F.regexp_replace("user_id", "[^a-zA-Z0-9_-]", "_"), 1, 40).alias("user_id"), "language", F.md5("masked").alias("doc_id"), F.substring("masked", 1, 2000).alias("document"), pseudo_embedding(F.substring("masked", 1, 2000)).alias("embedding"), "result", at.alias("stored_at"))


def purge(entries: DataFrame, user: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What is left of a cache after clearing one user's entries, or all, and how many entries are cleared (one row, `cleared`). Entries without a user are nobody's, so only clearing all takes them."""
    gone = F.lit(True) if user is None else F.coalesce(F.col("user_id") == user, F.lit(False))
    return entries.where(~gone), entries.agg(F.coalesce(F.sum(gone.cast("int")), F.lit(0)).alias("cleared"))


def users(seen: DataFrame) -> DataFrame:
    """user_id, email, name, first_seen, last_seen, visits of visits (user_id, seen_at, email, name): what is known of a user stays as first seen, only the last visit moves. Of several first visits at one time the least email and name count."""
    first = F.min(F.struct("seen_at", "email", "name"))
    g = seen.where("user_id IS NOT NULL").groupBy("user_id").agg(first.alias("f"), F.max("seen_at").alias("last_seen"), F.count("*").alias("visits"))
    return g.select("user_id", "f.email", "f.name", F.col("f.seen_at").alias("first_seen"), "last_seen", "visits")


def meeting_count(store: DataFrame) -> DataFrame:
    """meetings, languages, chars of a meeting store (meeting_id, language, char_length): its size, each meeting once."""
    return store.groupBy("meeting_id", "language").agg(F.max("char_length").alias("c")).agg(F.countDistinct("meeting_id").alias("meetings"), F.countDistinct("language").alias("languages"), F.coalesce(F.sum("c"), F.lit(0)).alias("chars"))


def patterns(spark: SparkSession) -> DataFrame:
    """pattern_id, category, attribute, sentence, embedding: the library of sentences that show roles, phases, deadlines, commitments and escalation, with stand-in vectors."""
    d = spark.createDataFrame([*lexicon.PATTERNS], "pattern_id string, category string, attribute string, sentence string")
    return d.withColumn("embedding", pseudo_embedding(F.col("sentence")))


def match_patterns(texts: DataFrame, library: DataFrame, k: int = 3, least: float = 0.65, category: str | None = None) -> DataFrame:
    """text_id, pattern_id, place, similarity: for each text (text_id, embedding) the k nearest sentences of the library, if asked for of one category, then those that reach least.

    The library is a table of fixed size and goes to every task; the texts stay where they are, and their cosines are one matrix product a batch.
    """
    own = library if category is None else library.where(F.col("category") == category)
    held = own.select("pattern_id", "embedding").orderBy("pattern_id").collect()
    ids = [r.pattern_id for r in held]
    m = np.array([r.embedding for r in held], dtype=float).reshape(len(held), -1)
    unit = m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            key, emb = b.column(0).to_pylist(), b.column(1).to_pylist()
            ok = [i for i, e in enumerate(emb) if e is not None and len(e) == unit.shape[1]]
            x = np.array([emb[i] for i in ok], dtype=float).reshape(len(ok), unit.shape[1])
            n = np.linalg.norm(x, axis=1)
            s = np.round((x / np.where(n > 0, n, 1)[:, None]) @ unit.T, PLACES)
            for j, i in enumerate(ok):
                if n[j] > 0:
                    best = np.argsort(-s[j], kind="stable")[:k]
                    out += [(key[i], ids[p], place, float(s[j, p])) for place, p in enumerate(best, 1) if s[j, p] >= least]
            if out:
                t, p, place, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(p), pa.array(place, pa.int32()), pa.array(v, pa.float64())], names=["text_id", "pattern_id", "place", "similarity"])

    return texts.select("text_id", "embedding").mapInArrow(run, "text_id string, pattern_id string, place int, similarity double")


def history(entries: DataFrame, user: str, at: str, most: int = 5) -> DataFrame:
    """The most recent entries of each user, numbered, with a label."""
    w = W.partitionBy(user).orderBy(F.col(at).desc(), F.xxhash64(*entries.columns))
    return entries.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).withColumn("label", F.date_format(at, "MM/dd HH:mm"))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label")
    return e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def q_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk(*_vectors(spark, folder), 5).select("query_id", "vec_id", "place", F.round("similarity", 6).alias("similarity"))


def q_topk_label(spark: SparkSession, folder: str) -> DataFrame:
    return topk(*_vectors(spark, folder), 3, same="label").select("query_id", "vec_id", "place")


def q_semantic_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest other vector of each query where its cosine reaches .2, as a semantic cache would answer; at the cache's own .92 the given vectors have no hit."""
    return nearest_other(*_vectors(spark, folder), 0.2).select("query_id", "vec_id")


def q_exact_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Requests against a cache that holds each text's result from when it was last received, and the finished jobs': whether it was there and under a day old when the request was stored."""
    r = spark.read.parquet(f"{folder}/analyze_requests.parquet").where("transcript IS NOT NULL").select("request_id", cache_key(F.col("transcript")).alias("k"), "received_at", "ingested_at").distinct()
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").where("transcript IS NOT NULL AND finished_at IS NOT NULL").select(cache_key(F.col("transcript")).alias("k"), F.to_timestamp("finished_at").alias("cached_at"))
    e = r.select("k", F.col("received_at").alias("cached_at")).union(j).distinct()
    hit = cache_get(r.select("request_id", "k", F.col("ingested_at").alias("asked")), e, "k", "cached_at", F.col("asked"))
    return hit.groupBy(F.col("cached_at").isNotNull().alias("known"), "hit").agg(F.count("*").alias("requests"))


def q_users(spark: SparkSession, folder: str) -> DataFrame:
    """Visitors: the kind of event by which each came first stands for what was known at the first visit."""
    e = spark.read.parquet(f"{folder}/events.parquet").select("user_id", F.col("ts").alias("seen_at"), F.lit(None).cast("string").alias("email"), F.col("event_type").alias("name"))
    return users(e)


def q_history(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_id", "ts")
    w = W.partitionBy("user_id").orderBy(F.col("ts").desc(), "event_id")
    return e.withColumn("place", F.row_number().over(w)).where("place <= 5").select("user_id", "event_id", "place")


def q_cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Entries and characters of results by account, as a cache would report."""
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").where("result IS NOT NULL").select("job_id", "account_id", "result").distinct()
    return j.groupBy(safe_id(F.col("account_id").cast("string"), 64).alias("user_dir")).agg(F.count("*").alias("entries"), F.sum(F.length("result")).alias("chars"))


def q_store(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the meeting store of every request: sizes, and what the scans say of its language, risk and register."""
    from ..functions.text import keigo, language
    from . import grounding, signals

    m = signals.risk(grounding._requests(spark, folder))
    a = spark.read.parquet(f"{folder}/action_items.parquet").where("request_id IS NOT NULL").select(F.col("request_id").alias("meeting_id"), "item_id").distinct().groupBy("meeting_id").agg(F.count("*").cast("int").alias("actions"))
    t = F.col("transcript")
    d = m.join(a, "meeting_id", "left").withColumn("language", language(t)).withColumn("keigo", keigo(t)).withColumn("summary", F.array(F.lit("none"))).withColumn("risk_label", F.lit(None).cast("string")).withColumn("speakers", F.lit(None).cast("int"))
    s = meeting_rows(d, F.timestamp_seconds(F.lit(0)))
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3)
    return s.select("meeting_id", "char_length", "language", "soft_risk", "halluc_risk", "keigo_level", "action_count", F.length("document").alias("doc_chars"), total.alias("embedding_sum"), F.length(excerpt(F.col("document"))).alias("excerpt_chars"))


def q_count(spark: SparkSession, folder: str) -> DataFrame:
    """Size of the store of all requests."""
    r = spark.read.parquet(f"{folder}/analyze_requests.parquet").where("transcript IS NOT NULL")
    return meeting_count(r.select(F.col("request_id").alias("meeting_id"), "language", F.length("transcript").alias("char_length")))


def q_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """The library's sentences nearest to what was said, by stand-in vectors."""
    s = spark.read.parquet(f"{folder}/said_vs_meant_items.parquet").where("item_id IS NOT NULL AND said IS NOT NULL").groupBy(F.col("item_id").alias("text_id")).agg(F.min("said").alias("said"))
    d = s.select("text_id", pseudo_embedding(F.col("said")).alias("embedding"))
    return match_patterns(d, patterns(spark)).select("text_id", "pattern_id", "place", F.round("similarity", 6).alias("similarity"))


def q_cached_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What the semantic cache would answer for each document: the nearest other text of its language, at the cache's own .92, by stand-in vectors of the text (they tell no more than its first 384 characters)."""
    d = spark.read.parquet(f"{folder}/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").alias("vec_id"), "lang", F.substring("text", 1, PSEUDO).alias("embedding"))
    q = d.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return nearest_other(d, q, same="lang").select("query_id", "vec_id")


def q_ask(spark: SparkSession, folder: str) -> DataFrame:
    """Questions to the store: the three nearest documents of each query vector and the prompt made of their excerpts; a model's answer is a column to come."""
    from .reports import rag_prompt

    found = topk(*_vectors(spark, folder), 3)
    d = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 300).alias("excerpt"))
    q = found.join(d, "vec_id").select("query_id", "place", F.lit("What was decided?").alias("question"), F.col("vec_id").cast("string").alias("meeting_id"), "excerpt")
    return rag_prompt(q).select("query_id", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


def q_vector_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the semantic cache of every job with a result."""
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").where("transcript IS NOT NULL AND result IS NOT NULL")
    j = j.select(F.col("account_id").cast("string").alias("user_id"), "language", F.col("transcript").alias("masked"), "result").distinct()
    v = vector_rows(j, F.timestamp_seconds(F.lit(0)))
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3)
    return v.select("user_id", "language", "doc_id", F.length("document").alias("document_chars"), total.alias("embedding_sum"), F.length("result").alias("result_chars"))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").where("transcript IS NOT NULL AND finished_at IS NOT NULL")
    return j.select(cache_key(F.col("transcript")).alias("k"), F.to_timestamp("finished_at").alias("cached_at"), F.col("account_id").cast("string").alias("user_id"))


def q_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the exact cache once every finished job was written: the last write of each key."""
    e = _entries(spark, folder)
    return upsert(e, e.limit(0), "k", "cached_at").select("k", "cached_at")


def q_purge(spark: SparkSession, folder: str) -> DataFrame:
    """What clearing the cache of account 1 takes and leaves."""
    left, gone = purge(_entries(spark, folder), "1")
    return gone.select(F.lit("cleared").alias("what"), F.col("cleared").cast("bigint").alias("entries")).union(left.agg(F.count("*")).select(F.lit("left"), F.col("count(1)")))


QUERIES = {"meeting_store_rows": q_store, "cosine_topk": q_topk, "cosine_topk_filtered": q_topk_label, "semantic_cache_hits": q_semantic_cache, "semantic_cache_documents": q_cached_documents, "meeting_count": q_count, "vector_cache_rows": q_vector_rows, "exact_cache_entries": q_entries, "cache_purge": q_purge, "pattern_matches": q_patterns, "ask_prompts": q_ask, "exact_cache_hits": q_exact_cache, "user_upserts": q_users, "session_history": q_history, "cache_stats": q_cache_stats}
_COS = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9)"
_RANK = f"""SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS place
 FROM embeddings q JOIN embeddings e ON"""
_PSEUDO = lambda c: f"list_resize(list_transform(string_split({c}, ''), lambda x: unicode(x) / 1000.0), 384, 0.0)"
_LEAST = "(SELECT request_id AS meeting_id, min(transcript) AS transcript FROM analyze_requests WHERE transcript IS NOT NULL GROUP BY 1)"
SQL = {
    "meeting_store_rows": f"""SELECT r.meeting_id, length(r.transcript) AS char_length, l.language, r.risk_level AS soft_risk, 'UNKNOWN' AS halluc_risk, k.keigo AS keigo_level, coalesce(a.n, 0) AS action_count, length(r.transcript) + 15 AS doc_chars,
 round(list_sum(list_transform(string_split(left(r.transcript || chr(10) || chr(10) || 'SUMMARY: none', 384), ''), lambda c: unicode(c) / 1000.0)), 3) AS embedding_sum, least(300, length(string_split(r.transcript, chr(10) || chr(10) || 'SUMMARY:')[1])) AS excerpt_chars
 FROM (SELECT *, {_LEVEL} AS risk_level FROM ({_RISK.replace('SELECT m.meeting_id,', 'SELECT m.meeting_id, m.transcript,').replace(MEETINGS, _LEAST)})) r JOIN ({TEXT_SQL["language_detect"].replace(MEETINGS, _LEAST)}) l USING (meeting_id)
 JOIN ({TEXT_SQL["keigo_levels"].replace(MEETINGS, _LEAST)}) k USING (meeting_id) LEFT JOIN (SELECT request_id AS meeting_id, count(DISTINCT item_id) AS n FROM action_items GROUP BY 1) a ON a.meeting_id = r.meeting_id""",
    "meeting_count": "SELECT count(DISTINCT meeting_id) AS meetings, count(DISTINCT language) AS languages, sum(c) AS chars FROM (SELECT request_id AS meeting_id, language, max(length(transcript)) AS c FROM analyze_requests WHERE transcript IS NOT NULL GROUP BY 1, 2)",
    "pattern_matches": f"""WITH e AS (SELECT pattern_id, {_PSEUDO("sentence")} AS embedding FROM {rows([(p, s) for p, _, _, s in lexicon.PATTERNS], "p(pattern_id, sentence)")}),
 q AS (SELECT item_id AS text_id, {_PSEUDO("left(min(said), 384)")} AS embedding FROM said_vs_meant_items WHERE item_id IS NOT NULL AND said IS NOT NULL GROUP BY 1 HAVING min(said) <> '')
 SELECT text_id, pattern_id, place, round(s, 6) AS similarity FROM (SELECT text_id, pattern_id, {_COS} AS s, CAST(row_number() OVER (PARTITION BY text_id ORDER BY {_COS} DESC, pattern_id) AS INT) AS place FROM q CROSS JOIN e) WHERE place <= 3 AND s >= 0.65""",
    "semantic_cache_documents": f"""WITH e AS (SELECT doc_id AS vec_id, lang, {_PSEUDO("left(text, 384)")} AS embedding FROM documents WHERE text <> '')
 SELECT query_id, vec_id FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS place FROM e q JOIN e ON q.lang IS NOT DISTINCT FROM e.lang AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) WHERE place = 1 AND s >= 0.92""",
    "ask_prompts": f"""WITH f AS (SELECT query_id, place, vec_id, left(text, 300) AS excerpt FROM ({_RANK} TRUE WHERE q.vec_id % 20 = 0) JOIN documents ON doc_id = vec_id WHERE place <= 3),
 p AS (SELECT query_id, 'Meetings:' || chr(10) || coalesce(string_agg('[' || place || '] ' || vec_id || ': ' || excerpt, chr(10) ORDER BY place), '') || chr(10) || chr(10) || 'Question: What was decided?' AS prompt FROM f GROUP BY 1) SELECT query_id, length(prompt) AS prompt_chars, md5(prompt) AS prompt_md5 FROM p""",
    "cosine_topk": f"SELECT query_id, vec_id, place, round(s, 6) AS similarity FROM ({_RANK} TRUE WHERE q.vec_id % 20 = 0) WHERE place <= 5",
    "cosine_topk_filtered": f"SELECT query_id, vec_id, place FROM ({_RANK} q.label = e.label WHERE q.vec_id % 20 = 0) WHERE place <= 3",
    "semantic_cache_hits": f"SELECT query_id, vec_id FROM ({_RANK} e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) WHERE place = 1 AND s >= 0.2",
    "vector_cache_rows": """SELECT CAST(account_id AS VARCHAR) AS user_id, language, md5(transcript) AS doc_id, least(2000, length(transcript)) AS document_chars, round(list_sum(list_transform(string_split(left(transcript, 384), ''), lambda c: unicode(c) / 1000.0)), 3) AS embedding_sum, length(result) AS result_chars
 FROM (SELECT DISTINCT account_id, language, transcript, result FROM analysis_jobs WHERE transcript IS NOT NULL AND result IS NOT NULL)""",
    "exact_cache_entries": "SELECT md5(trim(transcript, ' ' || chr(10) || chr(13) || chr(9))) AS k, max(CAST(finished_at AS TIMESTAMP)) AS cached_at FROM analysis_jobs WHERE transcript IS NOT NULL AND finished_at IS NOT NULL GROUP BY 1",
    "cache_purge": """WITH e AS (SELECT coalesce(account_id = 1, FALSE) AS gone FROM analysis_jobs WHERE transcript IS NOT NULL AND finished_at IS NOT NULL)
 SELECT 'cleared' AS what, count(*) FILTER (WHERE gone) AS entries FROM e UNION ALL SELECT 'left', count(*) FILTER (WHERE NOT gone) FROM e""",
    "exact_cache_hits": """WITH r AS (SELECT DISTINCT request_id, md5(trim(transcript, ' ' || chr(10) || chr(13) || chr(9))) AS k, received_at, ingested_at FROM analyze_requests WHERE transcript IS NOT NULL),
 j AS (SELECT k, max(cached_at) AS cached_at FROM (SELECT k, CAST(received_at AS TIMESTAMP) AS cached_at FROM r UNION ALL SELECT md5(trim(transcript, ' ' || chr(10) || chr(13) || chr(9))), CAST(finished_at AS TIMESTAMP) FROM analysis_jobs WHERE transcript IS NOT NULL AND finished_at IS NOT NULL) GROUP BY 1)
 SELECT cached_at IS NOT NULL AS known, coalesce(cached_at > CAST(ingested_at AS TIMESTAMP) - INTERVAL 24 HOURS AND cached_at <= CAST(ingested_at AS TIMESTAMP), FALSE) AS hit, count(*) AS requests FROM r LEFT JOIN j USING (k) GROUP BY 1, 2""",
    "user_upserts": "SELECT user_id, CAST(NULL AS VARCHAR) AS email, arg_min(event_type, (ts, event_type)) AS name, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS visits FROM events WHERE user_id IS NOT NULL GROUP BY 1",
    "session_history": "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events) WHERE place <= 5",
    "cache_stats": "SELECT CAST(account_id AS VARCHAR) AS user_dir, count(*) AS entries, sum(length(result)) AS chars FROM (SELECT DISTINCT job_id, account_id, result FROM analysis_jobs WHERE result IS NOT NULL) GROUP BY 1",
}
