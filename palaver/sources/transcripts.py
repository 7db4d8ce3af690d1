"""Reading transcripts: plain text, WebVTT, JSON, speech-recognition segments, raw model answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from .seed import rows

#: Largest upload, in bytes, and the formats that speech recognition takes.
MOST_BYTES = 25 * 1024 * 1024
AUDIO = ("mp3", "mp4", "wav", "m4a", "ogg", "webm", "flac")


# A timing line and a voice tag of WebVTT.
_TIMING, _VOICE = r"\d{2}:\d{2}[\d:,.]+\s*-->\s*", "^<v ([^>]+)>(.*)</v>"


def vtt_text(c: Column) -> Column:
    """WebVTT as text: heads, notes, timings and empty lines dropped, voice tags as labels."""
    lines = F.transform(F.split(c, r"\r\n|\n|\r"), strip)
    keep = F.filter(lines, lambda x: (x != "") & ~x.startswith("WEBVTT") & ~x.startswith("NOTE") & ~x.rlike(_TIMING))
    said = F.transform(keep, lambda x: F.when(x.rlike(_VOICE), F.concat(F.regexp_extract(x, _VOICE, 1), F.lit(": "), strip(F.regexp_extract(x, _VOICE, 2)))).otherwise(x))
    return F.array_join(said, "\n")


def json_text(c: Column) -> Column:
    """A JSON string, the first text among transcript, text, content and body, or utterances as labelled lines; anything else as it is."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    field = F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string")) for k in ("transcript", "text", "content", "body")))
    said = F.from_json(c, "array<struct<speaker:string,name:string,text:string,content:string,message:string>>")
    who, what = lambda u: F.coalesce(u["speaker"], u["name"], F.lit("")), lambda u: F.coalesce(u["text"], u["content"], u["message"], F.lit(""))
    lines = F.transform(F.filter(said, lambda u: what(u) != ""), lambda u: F.when(who(u) != "", F.concat(who(u), F.lit(": "), what(u))).otherwise(what(u)))
    return F.when(v.isNull(), c).when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("OBJECT"), F.coalesce(field, c)).when(kind.startswith("ARRAY"), F.array_join(lines, "\n")).otherwise(c)


def uploads(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """path, length, status, text of the files of a folder: text, WebVTT and JSON as text, bad bytes replaced.

    Every file has a row, but for empty ones, which the file source skips. Its status is `read`; `audio` for formats that speech recognition takes; `too_large` beyond `most` bytes, whose
    content isn't loaded. Only files that are read have a text.
    """
    f = spark.read.format("binaryFile").load(path)
    ending = F.lower(F.substring_index("path", ".", -1))
    status = F.when(F.col("length") > most, "too_large").when(ending.isin(*AUDIO), "audio").otherwise("read")
    t = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.when(ending == "vtt", vtt_text(t)).when(ending == "json", json_text(t)).otherwise(t)
    read = f.where((F.col("length") <= most) & ~ending.isin(*AUDIO)).select("path", "length", F.lit("read").alias("status"), text.alias("text"))
    # The rest is scanned without its content.
    rest = f.select("path", "length", status.alias("status")).where("status <> 'read'")
    return read.unionByName(rest.withColumn("text", F.lit(None).cast("string")))


def segment_turns(segments: DataFrame, gap: float = 1.5, speakers: int = 5) -> DataFrame:
    """meeting_id, seq, line of recognition segments (meeting_id, seq, start, end, text): after a silence longer than gap the next of the speakers talks."""
    w = W.partitionBy("meeting_id").orderBy("seq")
    new = ((F.col("start") - F.lag("end").over(w)) > gap).cast("int")
    d = segments.where("meeting_id IS NOT NULL").withColumn("n", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = F.floor("start").cast("int")
    line = F.format_string("[%02d:%02d] Speaker %d: %s", (s / 60).cast("int"), s % 60, F.col("n") % speakers + 1, strip(F.coalesce("text", F.lit(""))))
    return d.where(strip(F.coalesce("text", F.lit(""))) != "").select("meeting_id", "seq", line.alias("line"))


_FENCE = re.compile(r"```(?:json)?|```")


def first_object(raw: str | None) -> str | None:
    """The first JSON object in a model's answer, thoughts and fences dropped, open brackets closed; null if there is none."""
    if raw is None:
        return None
    s = _FENCE.sub("", re.sub(r"(?s)<think>.*?</think>", "", raw))
    decode = json.JSONDecoder()
    at = s.find("{")
    while at >= 0:
        try:
            value, _ = decode.raw_decode(s, at)
            return json.dumps(value, ensure_ascii=False)
        except ValueError:
            pass
        stack, quoted, esc = [], False, False
        for c in s[at:]:
            if quoted:
                esc, quoted = (c == "\\" and not esc), not (c == '"' and not esc)
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
        body = re.sub(r",\s*$", "", s[at:].rstrip() + ('"' if quoted else ""))
        try:
            return json.dumps(json.loads(body + "".join(reversed(stack))), ensure_ascii=False)
        except ValueError:
            at = s.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def answer_json(s: pd.Series) -> pd.Series:
    """Model answers as JSON text; see first_object."""
    return s.map(first_object)


SEGMENTS = (("A1", 1, 0.0, 2.0, "hello"), ("A1", 2, 2.4, 4.0, "all"), ("A1", 3, 6.0, 7.0, " next "), ("A1", 4, 8.5, 9.0, "same"), ("A1", 5, 10.6, 12.0, "third"), ("A2", 1, 0.0, 1.0, "only"), ("A2", 2, 2.6, 3.0, ""))
FILES = (
    ("F1", "json", '{"text": "Mori: hi"}'), ("F2", "json", '[{"speaker": "Abe", "text": "yes"}, {"name": "Ono", "content": "no"}, {"text": "x"}]'), ("F3", "json", '"plain"'), ("F4", "json", "not json"), ("F5", "json", '{"a": 1}'),
    ("F6", "vtt", "WEBVTT\n\nNOTE x\n00:00:01.000 --> 00:00:02.000\n<v Mori>hello </v>\n\n00:00:03.000 --> 00:00:04.000\nplain line"),
)


#: Answers as models give them: (id, raw text, keys and title of what is read). Thoughts, fences, cut-off ends, more than one object, none.
ANSWERS = (
    ("A1", '<think>{"x": 1}</think>```json\n{"meeting_title": "T1", "summary": ["a"]}\n```', 2, "T1"), ("A2", 'Sure: {"meeting_title": "T2", "summary": ["a", "b', 2, "T2"), ("A3", "no object", None, None),
    ("A4", '{"meeting_title": "T4"} and {"x": 2}', 1, "T4"), ("A5", '{bad} then {"meeting_title": "T5", "a": {"b": [1, 2', 2, "T5"), ("A6", "", None, None), ("A7", '{"meeting_title": "a \\"b\\" }", "k": [{"z": 1},', 2, 'a "b" }'),
)


def q_asr(spark: SparkSession, folder: str) -> DataFrame:
    """Segments as turns: the events of each user stand for segments, besides a small case."""
    e = spark.read.parquet(f"{folder}/events.parquet").where("user_id IS NOT NULL AND ts IS NOT NULL")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6
    d = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("meeting_id"), F.col("event_id").alias("seq"), start.alias("start"), (start + F.abs("value") % 3).alias("end"), F.col("event_type").alias("text"))
    case = spark.createDataFrame([*SEGMENTS], "meeting_id string, seq bigint, start double, end double, text string")
    return segment_turns(d.unionByName(case))


def q_vtt(spark: SparkSession, folder: str) -> DataFrame:
    """WebVTT jobs as text: number of lines and characters."""
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").where("transcript IS NOT NULL AND transcript LIKE 'WEBVTT%'").select("job_id", "transcript").distinct()
    t = vtt_text(F.col("transcript"))
    return j.select("job_id", F.length(t).alias("chars"), F.size(F.split(t, "\n")).alias("lines"))


def q_json(spark: SparkSession, folder: str) -> DataFrame:
    """Texts out of JSON: objects with a transcript, utterances with or without a speaker, and the odd shapes of a small case."""
    case = spark.createDataFrame([*FILES], "file_id string, format string, content string")
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").where("transcript IS NOT NULL").select("job_id", "transcript").distinct()
    u = spark.read.parquet(f"{folder}/said_vs_meant_items.parquet").where("item_id IS NOT NULL").select("item_id", "speaker", "said").distinct()
    d = case.union(j.select("job_id", F.lit("json"), F.to_json(F.struct(F.lit(1).alias("version"), F.col("transcript").alias("content")))))
    d = d.union(u.select("item_id", F.lit("json"), F.to_json(F.array(F.struct("speaker", F.col("said").alias("message"))))))
    return d.select("file_id", F.when(F.col("format") == "vtt", vtt_text(F.col("content"))).otherwise(json_text(F.col("content"))).alias("text"))


def q_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Results of jobs read as model answers, and answers with thoughts, fences or a cut-off end: number of keys and title."""
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").where("result IS NOT NULL").select("job_id", "result").distinct()
    case = spark.createDataFrame([(i, raw) for i, raw, _, _ in ANSWERS], "job_id string, result string")
    a = j.union(case).select("job_id", answer_json(F.col("result")).alias("a"))
    return a.select("job_id", F.size(F.json_object_keys("a")).alias("keys"), F.get_json_object("a", "$.meeting_title").alias("title"))


QUERIES = {"asr_speaker_turns": q_asr, "vtt_to_text": q_vtt, "json_to_text": q_json, "llm_json_parse": q_answers}
_SEGMENTS_SQL = f"""(SELECT * FROM {rows(SEGMENTS, "s(meeting_id, seq, start, stop, txt)")} UNION ALL SELECT 'u' || user_id, event_id, t, t + abs(value) % 3, event_type FROM (SELECT *, (epoch_us(CAST(ts AS TIMESTAMP)) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL))"""
_FILE_TEXTS = [("F1", "Mori: hi"), ("F2", "Abe: yes\nOno: no\nx"), ("F3", "plain"), ("F4", "not json"), ("F5", '{"a": 1}'), ("F6", "Mori: hello\nplain line")]
SQL = {
    "asr_speaker_turns": f"""SELECT meeting_id, seq, printf('[%02d:%02d] Speaker %d: %s', CAST(floor(start / 60) AS INT), CAST(floor(start) AS INT) % 60, CAST(n % 5 + 1 AS INT), trim(txt)) AS line FROM (SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY seq) AS n
  FROM (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY meeting_id ORDER BY seq) > 1.5 THEN 1 ELSE 0 END AS new FROM {_SEGMENTS_SQL})) WHERE trim(txt) <> ''""",
    "json_to_text": f"""SELECT * FROM {rows(_FILE_TEXTS, "t(file_id, text)")} UNION ALL SELECT DISTINCT job_id, transcript FROM analysis_jobs WHERE transcript IS NOT NULL
  UNION ALL SELECT item_id, CASE WHEN coalesce(said, '') = '' THEN '' WHEN coalesce(speaker, '') <> '' THEN speaker || ': ' || said ELSE said END FROM (SELECT DISTINCT item_id, speaker, said FROM said_vs_meant_items WHERE item_id IS NOT NULL)""",
    "vtt_to_text": r"""SELECT job_id, length(t) AS chars, len(string_split(t, chr(10))) AS lines FROM (SELECT job_id, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(transcript, '\r\n|\n|\r'), lambda x: trim(x, ' ' || chr(9) || chr(12288) || chr(160))),
  lambda x: x <> '' AND NOT starts_with(x, 'WEBVTT') AND NOT starts_with(x, 'NOTE') AND NOT regexp_matches(x, '\d{2}:\d{2}[\d:,.]+\s*-->\s*')),
  lambda x: CASE WHEN regexp_matches(x, '^<v ([^>]+)>(.*)</v>') THEN regexp_extract(x, '^<v ([^>]+)>(.*)</v>', 1) || ': ' || trim(regexp_extract(x, '^<v ([^>]+)>(.*)</v>', 2), ' ' || chr(9) || chr(12288) || chr(160)) ELSE x END), chr(10)) AS t
  FROM (SELECT DISTINCT job_id, transcript FROM analysis_jobs WHERE transcript LIKE 'WEBVTT%'))""",
    "llm_json_parse": f"""SELECT job_id, len(json_keys(result)) AS keys, result ->> '$.meeting_title' AS title FROM (SELECT DISTINCT job_id, result FROM analysis_jobs WHERE result IS NOT NULL)
  UNION ALL SELECT * FROM {rows([(i, k, t) for i, _, k, t in ANSWERS], "a(job_id, keys, title)")}""",
}
