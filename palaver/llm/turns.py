"""Problem 7: transcripts into clean, ordered speaker turns.

Method: fields by SQL expressions, speakers forward-filled by windows, marked noise removed, runs found as gaps and islands. All windows
lie over one hash partitioning by record; a record is one transcript, so no window grows with the corpus.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..stage import cut
from . import frames, speech
from .link_names import resolve

_WIDE = "：（）［］－‐‑–−０１２３４５６７８９＜＞　\u00a0\u2003\u2009\u202f\u2002"
_THIN = ":()[]-----0123456789<>      "
_HIDDEN = r"[\u00ad\u200b-\u200f\u2060-\u206f\ufeff\ufe00-\ufe0f]"


def lines_of(docs: DataFrame) -> DataFrame:
    """record_id, account_id, line_no, label, stamp (seconds), said (text without label and notes), spoken, by line of each transcript.

    docs has record_id, account_id, transcript. Nulls give no line. Of several rows of one record the one with the least hash of its text counts, once.
    Each line is matched once: the match is rewritten as stamp, label and text with marks between, which are then split.
    """
    d = docs.where("record_id IS NOT NULL AND transcript IS NOT NULL").select(
        "record_id", "account_id", F.struct(F.xxhash64("transcript").alias("h"), F.monotonically_increasing_id().alias("i")).alias("version"),
        F.split(F.translate(F.when(F.col("transcript").rlike(_HIDDEN), F.regexp_replace("transcript", _HIDDEN, "")).otherwise(F.col("transcript")), _WIDE, _THIN), r"\r\n|\n|\r").alias("ls"),
    )
    e = d.select("record_id", "account_id", "version", F.posexplode("ls").alias("at", "x"))
    x = F.col("x")
    # A label ends in a colon, or has a stamp, which holds one; a voice tag and a cue hold ">".
    may = F.contains(x, F.lit(":")) | F.contains(x, F.lit(">"))
    cut_up = (
        F.when(~may, F.concat(F.lit("\x01\x01"), x))
        .when(F.contains(x, F.lit(">")) & x.rlike(speech.CUE), F.regexp_replace(x, speech.CUE, "$1\x01\x01\x02"))
        .when(F.contains(x, F.lit("<v")), F.regexp_replace(x, speech.VOICE, "\x01$1\x01$2"))
        .otherwise(F.regexp_replace(F.regexp_replace(x, speech.STAMP_FIRST, "$1\x01$2\x01$3"), speech.LABEL_FIRST, "$2$3\x01$1\x01$4"))
    )
    parts = F.split(F.col("y"), "\x01", 3)
    e = e.select("record_id", "account_id", "version", (F.col("at") + 1).alias("line_no"), cut_up.alias("y")).withColumn("p", parts)
    plain = F.size("p") < 3
    text = F.when(plain, F.col("y")).otherwise(F.col("p")[2])
    e = e.select(
        "record_id", "account_id", "version", "line_no", F.when(~plain, F.nullif(F.trim(F.col("p")[0]), F.lit(""))).alias("clock"), F.when(~plain, F.nullif(F.trim(F.col("p")[1]), F.lit(""))).alias("label"),
        text.startswith("\x02").alias("cue"), text.alias("text"),
    )
    head = F.col("cue") | F.col("text").rlike(speech.VTT_HEAD)
    tagged = F.when(F.contains("text", F.lit("</v")), F.regexp_replace("text", "</?v[^>]*>", "")).otherwise(F.col("text"))
    noted = F.when(tagged.rlike(_MAY_NOTE), F.regexp_replace(tagged, speech.NOTE, " ")).otherwise(tagged)
    e = e.select("record_id", "account_id", "version", "line_no", "clock", "label", "cue", F.when(head, F.lit("")).otherwise(noted).alias("said"))
    parts = F.split(F.regexp_replace("clock", "[.,].*$", ""), ":")
    sec = F.aggregate(parts, F.lit(0), lambda a, b: a * 60 + b.cast("int")) + F.coalesce(F.concat(F.lit("0."), F.nullif(F.regexp_extract("clock", "[.,](\\d+)$", 1), F.lit(""))).cast("double"), F.lit(0.0))
    spoken = ~F.col("said").rlike(speech.FILLER_LINE)
    return e.select("record_id", "account_id", "version", "line_no", "label", sec.alias("stamp"), "cue", F.trim(F.regexp_replace("said", r"\s+", " ")).alias("said"), spoken.alias("spoken"))


_MAY_NOTE = r"[\[【♪*<(]|--"


def units_of(docs: DataFrame, text: bool = True) -> DataFrame:
    """Labelled lines with the unlabelled speech below them: record_id, account_id, unit, label, stamp, spoken and, with text, said; in order of the lines. Speech before any label has a null label.

    What is shuffled are labels, stamps and marks; the speech itself only if it is asked for.
    """
    rec = W.partitionBy("record_id")
    row = F.struct("label", "stamp", "cue", "spoken", *(["said"] if text else []))
    # As an array of one or none, so that the filter doesn't have the expressions of its columns made a second time.
    keep = F.filter(F.array(row), lambda x: x["label"].isNotNull() | x["cue"] | x["spoken"])
    e = lines_of(docs).select("record_id", "account_id", "version", "line_no", F.inline(keep))
    e = e.withColumn("first", F.min("version").over(rec)).where("version = first")
    run = rec.orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("unit", F.count("label").over(run)).withColumn("cue_at", F.last(F.when(F.col("cue"), F.col("stamp")), ignorenulls=True).over(run))
    e = e.withColumn("at", F.coalesce(F.when(~F.col("cue"), F.col("stamp")), F.col("cue_at")))
    said = []
    if text:
        lines = F.array_sort(F.collect_list(F.when(F.col("spoken"), F.struct("line_no", "said"))))
        said = [F.concat_ws(" ", F.transform(lines, lambda l: l["said"])).alias("said")]
    return e.groupBy("record_id", "unit").agg(
        F.first("account_id", ignorenulls=True).alias("account_id"), F.max("label").alias("label"), F.min(F.when(F.col("label").isNotNull() | (F.col("spoken") & (F.col("unit") == 0)), F.struct("line_no", "at")))["at"].alias("stamp"),
        F.max("spoken").alias("spoken"), *said,
    )


def _key():
    from .canon import visual_key
    from .names import parts

    def f(account, name):
        p = parts(name)
        # An unregistered speaker is known by the words of the label, in any order; an anonymous one by the label without blanks.
        key = " ".join(sorted(p[0][1].split())) if p else "".join(visual_key(name).lower().replace("_0", "").split()).replace("_", "")
        return [(account, name, key)]

    return f


def turns(docs: DataFrame, people: DataFrame, text: bool = True) -> DataFrame:
    """record_id, turn_no, speaker_no, speaker (label of the first line) and, with text, text: each run of one speaker's lines, in order.

    By stamp where all spoken units bear one, else as they stand. Labels that mean one registered person of the account are one speaker;
    a label that could mean several is the one of them who speaks in this transcript under a clear label, if just one does.
    """
    units = cut(units_of(docs, text).where("spoken"))
    labels = units.where("label IS NOT NULL").select("account_id", F.col("label").alias("name")).distinct()
    who = resolve(labels, people).where("part = 0").select("account_id", F.col("name").alias("label"), "persons")
    keys = frames.rows_out(labels, _key, "account_id bigint, label string, own string", [("account_id", pa.int64()), ("label", pa.string()), ("own", pa.string())])
    # The account may be null: its labels have keys of their own, but no registered person.
    names = cut(keys.join(who, ["account_id", "label"], "left").select(F.coalesce("account_id", F.lit(-1)).alias("acc"), "label", "own", "persons"))
    u = units.withColumn("acc", F.coalesce("account_id", F.lit(-1))).join(names, ["acc", "label"], "left")
    rec = W.partitionBy("record_id")
    clear = F.when(F.size("persons") == 1, F.col("persons")[0])
    u = u.withColumn("clear", F.collect_set(clear).over(rec)).withColumn("stamped", F.min(F.col("stamp").isNotNull()).over(rec))
    mine = F.array_intersect("persons", "clear")
    person = F.when(F.size("persons") == 1, F.col("persons")[0]).when(F.size(mine) == 1, mine[0])
    u = u.withColumn("speaker", F.coalesce(F.concat(F.lit("p"), person.cast("string")), F.concat(F.lit("l"), F.col("own")), F.lit("")))
    u = u.withColumn("place", F.row_number().over(rec.orderBy(F.when(F.col("stamped"), F.col("stamp")), "unit")))
    line = rec.orderBy("place")
    u = u.withColumn("new", F.coalesce((F.col("speaker") != F.lag("speaker").over(line)).cast("int"), F.lit(1)))
    u = u.withColumn("turn_no", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    u = u.withColumn("first", F.min("turn_no").over(W.partitionBy("record_id", "speaker")))
    u = u.withColumn("speaker_no", F.dense_rank().over(rec.orderBy("first")))
    said = [F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda s: s["said"])).alias("text")] if text else []
    return u.groupBy("record_id", "turn_no").agg(F.max("speaker_no").cast("int").alias("speaker_no"), F.min_by("label", "place").alias("speaker"), *said)


def _docs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    a = frames.read(spark, folder, "analyze_requests", ["request_id", "account_id", "transcript"]).withColumnRenamed("request_id", "record_id")
    b = frames.read(spark, folder, "analysis_jobs", ["job_id", "account_id", "transcript"]).withColumnRenamed("job_id", "record_id")
    return a.union(b), frames.read(spark, folder, "people", ["person_id", "account_id", "full_name", "name_native"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return turns(*_docs(spark, folder), text=False).select("record_id", "turn_no", "speaker_no")


def p7_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns(*_docs(spark, folder))


QUERIES = {"p7_found": p7_found, "p7_turns": p7_turns}
SQL: dict[str, str] = {}
