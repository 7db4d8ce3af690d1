"""Turns and what their order tells: stalls, silences, closing summaries, talk time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import clock, strip, topic_terms, words
from ..sources.seed import MEETINGS, meetings
from ..sources.seed import text as lit
from .people import HINTS_SQL, name_sql, normal_name, role_hints, strip_sql

# A labelled line, a label with a clock stamp, and the head of a message in an exported chat.
_LINE = r"^(?:\[\d{2}:\d{2}(?::\d{2})?\]\s*)?([^\n:：\[\]]+)\s*[:：]\s*(.*)$"


def turns(df: DataFrame) -> DataFrame:
    """meeting_id, turn_idx (from 0), speaker, raw_label, text. Lines without a label, with a number or a mere title for one, belong to the turn above; those before the first turn are dropped."""
    e = df.select("meeting_id", F.posexplode(F.split("transcript", "\n")).alias("pos", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    label, text = strip(F.regexp_extract("line", _LINE, 1)), strip(F.regexp_extract("line", _LINE, 2))
    e = e.select("meeting_id", "pos", "line", label.alias("label"), text.alias("said")).withColumn("name", F.when(F.col("label") != "", normal_name(F.col("label"))))
    number = F.col("label").rlike("^[0-9]+$")
    new = (F.col("label") != "") & ~number & (F.coalesce("name", F.lit("")) != "")
    said = F.when(new | ((F.col("label") != "") & ~number), F.col("said")).otherwise(F.col("line"))
    e = e.select("meeting_id", "pos", new.alias("new"), F.when(new, F.col("name")).alias("name"), F.when(new, F.col("label")).alias("label"), said.alias("said"))
    w = W.partitionBy("meeting_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("turn", F.sum(F.col("new").cast("int")).over(w)).where("turn > 0")
    g = e.groupBy("meeting_id", "turn").agg(F.max("name").alias("speaker"), F.max("label").alias("raw_label"), F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("t"))
    return g.select("meeting_id", (F.col("turn") - 1).cast("int").alias("turn_idx"), "speaker", "raw_label", F.array_join(F.transform("t", lambda s: s["said"]), " ").alias("text"))


def hedged(c: Column) -> Column:
    return F.exists(F.array(*(F.lit(p) for p, _ in lexicon.SOFT)), lambda p: F.contains(c, p))


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(a)


def topic_stalls(t: DataFrame, lookahead: int = 6) -> DataFrame:
    """meeting_id, stalled_turn, pivot_turn, circled_back_turn: a hedged turn whose topic the next drops (overlap at most .25) and one of the following takes up again (at least .34). Frames are bounded, so no self-join."""
    line = W.partitionBy("meeting_id").orderBy("turn_idx")
    d = t.withColumn("terms", topic_terms(F.col("text"))).withColumn("next", F.lead("terms").over(line)).withColumn("later", F.collect_list(F.struct("turn_idx", "speaker", "terms")).over(line.rowsBetween(2, lookahead)))
    d = d.where(hedged(F.col("text")) & (F.size("terms") > 0) & F.col("next").isNotNull()).where(_overlap(F.col("terms"), F.col("next")) <= 0.25)
    back = F.filter("later", lambda x: (F.size(x["terms"]) > 0) & (_overlap(F.col("terms"), x["terms"]) >= 0.34))
    d = d.withColumn("back", F.get(back, F.lit(0))).where("back IS NOT NULL")
    return d.select("meeting_id", F.col("turn_idx").alias("stalled_turn"), F.col("speaker").alias("stalled_speaker"), (F.col("turn_idx") + 1).alias("pivot_turn"), F.col("back.turn_idx").alias("circled_back_turn"), F.col("back.speaker").alias("circled_back_speaker"))


def senior_silence(t: DataFrame, hints: DataFrame, min_silence: int = 3, min_rank: int = 5) -> DataFrame:
    """meeting_id, senior_speaker, silence_starts_turn, silence_length_turns, junior_speaker, pivot_turn: a senior silent for at least min_silence turns, and the first lower-ranked speaker soon after who leaves the topic."""
    r = t.join(hints.select("meeting_id", "speaker", "role", "rank"), ["meeting_id", "speaker"], "left").na.fill(0, ["rank"]).withColumn("terms", topic_terms(F.col("text")))
    line, own = W.partitionBy("meeting_id").orderBy("turn_idx"), W.partitionBy("meeting_id", "speaker").orderBy("turn_idx")
    r = r.withColumn("n", F.count("*").over(W.partitionBy("meeting_id"))).withColumn("end", F.coalesce(F.lead("turn_idx").over(own), F.col("n")))
    r = r.withColumn("later", F.collect_list(F.struct("turn_idx", "speaker", "rank", "terms")).over(line.rowsBetween(1, min_silence + 1)))
    r = r.where((F.col("rank") >= min_rank) & (F.col("end") - F.col("turn_idx") >= min_silence) & (F.size("terms") > 0))
    off = F.filter("later", lambda x: (x["turn_idx"] < F.col("end")) & (x["rank"] < F.col("rank")) & (F.size(x["terms"]) > 0) & (_overlap(F.col("terms"), x["terms"]) < 0.2))
    r = r.withColumn("off", F.get(off, F.lit(0))).where("off IS NOT NULL")
    return r.select("meeting_id", F.col("speaker").alias("senior_speaker"), F.col("role").alias("senior_role"), F.col("turn_idx").alias("silence_starts_turn"), (F.col("end") - F.col("turn_idx")).alias("silence_length_turns"), F.col("off.speaker").alias("junior_speaker"), F.col("off.turn_idx").alias("pivot_turn"))


def closing_summarizer(t: DataFrame, hints: DataFrame, min_rank: int = 5) -> DataFrame:
    """meeting_id, speaker, role, turn_idx, turns: who of at least min_rank closes in one of the last three turns, after at most one turn in the first three fifths. The last such turn counts."""
    r = t.join(hints.select("meeting_id", "speaker", "role", "rank"), ["meeting_id", "speaker"], "left").na.fill(0, ["rank"])
    every, own = W.partitionBy("meeting_id"), W.partitionBy("meeting_id", "speaker")
    r = r.withColumn("last", F.max("turn_idx").over(every))
    r = r.withColumn("early", F.sum((F.col("turn_idx") < F.col("last") * 0.6).cast("int")).over(own)).withColumn("own", F.count("*").over(own))
    says = F.exists(F.array(*map(F.lit, lexicon.CLOSING)), lambda m: F.contains(F.col("text"), m))
    r = r.where((F.col("turn_idx") >= F.col("last") - 2) & says & (F.col("rank") >= min_rank) & (F.col("early") <= 1))
    b = r.groupBy("meeting_id").agg(F.max(F.struct("turn_idx", "speaker", "role", "own")).alias("b"))
    return b.select("meeting_id", "b.speaker", "b.role", "b.turn_idx", F.col("b.own").alias("turns"))


_CLOCKED = r"(?m)^([A-Za-z぀-鿿][^\n:：]{0,30}?)\s*[:：]\s*(?:\[?(\d{1,2}:\d{2}(?::\d{2})?)\]?)?"
_EXPORT = r"(?mi)^([A-Za-z][A-Za-z\s\.]{1,35}?)\s+(?:\([^)]+\)\s+)?(\d{1,2}:\d{2}\s*[AP]M)\s*$"


def talk_weights(df: DataFrame) -> DataFrame:
    """meeting_id, name, weight, pos of the first turn from clock stamps: a turn weighs 1 within a minute of the one before, .5 within five, else .01; midnight is passed. Under two stamped turns there is no row."""
    pick = lambda p, i: F.regexp_extract_all("transcript", F.lit(p), i)
    pairs = lambda p: F.arrays_zip(pick(p, F.lit(1)).alias("name"), pick(p, F.lit(2)).alias("at"))
    export = F.filter(pairs(_EXPORT), lambda x: ~F.contains(F.lower(x["name"]), F.lit("view")))
    e = df.select("meeting_id", F.posexplode(F.when(F.col("transcript").rlike(_EXPORT), export).otherwise(pairs(_CLOCKED))).alias("pos", "p"))
    e = e.select("meeting_id", "pos", strip(F.regexp_replace(F.regexp_replace("p.name", r"\s+", " "), "(?i)\\s*sent the following.*", "")).alias("name"), clock(F.col("p.at")).alias("sec")).where("sec IS NOT NULL AND length(name) >= 2")
    w = W.partitionBy("meeting_id").orderBy("pos")
    gap = F.pmod(F.col("sec") - F.lag("sec").over(w), F.lit(86400))
    e = e.withColumn("weight", F.when(gap.isNull(), 1.0).when(gap <= 60, 1.0).when(gap <= 300, 0.5).otherwise(0.01)).withColumn("n", F.count("*").over(W.partitionBy("meeting_id"))).where("n >= 2")
    return e.groupBy("meeting_id", "name").agg(F.sum("weight").alias("weight"), F.min("pos").alias("pos"))


def talk_time(df: DataFrame) -> DataFrame:
    """meeting_id, name, weight, talk_time_pct: talk_weights as shares of 100. The first name takes what rounding leaves."""
    g = talk_weights(df)
    every = W.partitionBy("meeting_id")
    g = g.withColumn("pct", F.bround(F.col("weight") * 100 / F.sum("weight").over(every)).cast("int"))
    rest = 100 - F.sum("pct").over(every)
    return g.select("meeting_id", "name", "weight", (F.col("pct") + F.when(F.row_number().over(every.orderBy("pos")) == 1, rest).otherwise(0)).cast("int").alias("talk_time_pct"))


def weighed(speakers: Column, weights: Column) -> Column:
    """Result speakers (structs with name, talk_time_pct) with the shares of the clock: a speaker takes the weight of the first name (weights: name, weight in order of first turn) that has theirs as a word or is theirs. Where no weight matches they stay; the first takes what rounding leaves."""
    low = lambda s: F.lower(strip(F.coalesce(s["name"], F.lit(""))))
    hit = lambda s: F.coalesce(F.get(F.filter(weights, lambda w: F.array_contains(words(F.lower(w["name"])), low(s)) | (F.lower(w["name"]) == low(s))), F.lit(0))["weight"], F.lit(0.0))
    add = lambda a, of, zero: F.aggregate(a, F.lit(zero), lambda t, x: t + of(x))
    raw = F.transform(speakers, lambda s: F.struct(s.alias("s"), hit(s).alias("w")))
    # A name that is listed twice counts once in the total.
    total = lambda a: add(F.array_distinct(F.transform(a, lambda x: F.struct(x["s"]["name"].alias("name"), x["w"].alias("w")))), lambda x: x["w"], 0.0)
    one = F.transform(F.array(F.struct(raw.alias("raw"), total(raw).alias("total"))), lambda o: F.transform(o["raw"], lambda x: x["s"].withField("talk_time_pct", F.bround(x["w"] * 100 / o["total"]).cast("int"))))
    rest = F.transform(one, lambda a: F.transform(a, lambda s, i: s.withField("talk_time_pct", s["talk_time_pct"] + F.when(i == 0, 100 - add(a, lambda x: x["talk_time_pct"], 0)).otherwise(0))))[0]
    return F.when(F.coalesce(total(raw), F.lit(0.0)) > 0, rest).otherwise(speakers)


def q_turns(spark: SparkSession, folder: str) -> DataFrame:
    t = turns(meetings(spark, folder))
    return t.groupBy("meeting_id").agg(F.count("*").alias("turns"), F.countDistinct("speaker").alias("speakers"), F.sum(F.length("text")).alias("chars"))


def q_stalls(spark: SparkSession, folder: str) -> DataFrame:
    return topic_stalls(turns(meetings(spark, folder)))


def q_silence(spark: SparkSession, folder: str) -> DataFrame:
    m = meetings(spark, folder)
    return senior_silence(turns(m), role_hints(m))


def q_closing(spark: SparkSession, folder: str) -> DataFrame:
    m = meetings(spark, folder)
    return closing_summarizer(turns(m), role_hints(m))


def q_talk(spark: SparkSession, folder: str) -> DataFrame:
    return talk_time(meetings(spark, folder)).drop("weight")


def q_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of characters by speaker."""
    t = turns(meetings(spark, folder)).groupBy("meeting_id", "speaker").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("turns"))
    return t.withColumn("total", F.sum("chars").over(W.partitionBy("meeting_id")))


QUERIES = {"turns_parsed": q_turns, "topic_stalls": q_stalls, "senior_silence": q_silence, "closing_summarizer": q_closing, "talk_time_from_clock": q_talk, "talk_share_chars": q_shares}
_P = "'^(?:\\[\\d{2}:\\d{2}(?::\\d{2})?\\]\\s*)?([^\\n:：\\[\\]]+)\\s*[:：]\\s*(.*)$'"
_TURNS = f"""(SELECT meeting_id, turn - 1 AS turn_idx, max(CASE WHEN new THEN name END) AS speaker, string_agg(said, ' ' ORDER BY pos) AS text FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY meeting_id ORDER BY pos) AS turn FROM (
 SELECT meeting_id, pos, name, label <> '' AND NOT regexp_matches(label, '^[0-9]+$') AND name <> '' AS new, CASE WHEN label <> '' AND NOT regexp_matches(label, '^[0-9]+$') THEN said ELSE line END AS said
 FROM (SELECT *, {name_sql("label")} AS name FROM (SELECT meeting_id, pos, line, {strip_sql(f"regexp_extract(line, {_P}, 1)")} AS label, {strip_sql(f"regexp_extract(line, {_P}, 2)")} AS said FROM (
 SELECT meeting_id, pos, {strip_sql("line")} AS line FROM (SELECT meeting_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT meeting_id, string_split(transcript, chr(10)) AS l FROM {MEETINGS}))) WHERE line <> '')))) WHERE turn > 0 GROUP BY meeting_id, turn)"""
_TERMS = f"""list_filter(list_distinct(list_concat(list_concat(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), regexp_extract_all(text, '[\\x{{30a0}}-\\x{{30ff}}]{{2,}}')),
 list_transform(regexp_extract_all(text, '[A-Za-z]{{4,}}'), lambda w: lower(w)))), lambda w: w NOT IN ({", ".join(map(lit, lexicon.TOPIC_STOPS))}))"""
_T = f"t AS (SELECT meeting_id, turn_idx, speaker, text, {_TERMS} AS terms FROM {_TURNS}), h AS ({HINTS_SQL}), r AS (SELECT t.*, coalesce(h.role, '') AS role, coalesce(h.rank, 0) AS rank FROM t LEFT JOIN h USING (meeting_id, speaker))"
_any = lambda phrases: "(" + " OR ".join(f"contains(t.text, {lit(p)})" for p in phrases) + ")"
_BL = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_part = lambda i: f"regexp_extract(stamp, '^(\\d{{1,2}}):(\\d{{2}})(?::(\\d{{2}}))?\\s?([AP]M)?$', {i})"
_RC, _RE = (p.replace("'", "''").replace("぀-鿿", "\\x{3040}-\\x{9fff}") for p in (_CLOCKED, _EXPORT))
#: Common table expressions up to w: meeting_id, name, weight, pos of talk_weights.
WEIGHTS_SQL = f"""x AS (SELECT meeting_id, regexp_extract_all(transcript, '{_RE}', 1) AS en, regexp_extract_all(transcript, '{_RE}', 2) AS ea, regexp_extract_all(transcript, '{_RC}', 1) AS cn, regexp_extract_all(transcript, '{_RC}', 2) AS ca FROM {MEETINGS}),
 p AS (SELECT meeting_id, CASE WHEN len(en) > 0 THEN list_filter(list_zip(en, ea), lambda z: NOT contains(lower(z[1]), 'view')) ELSE list_zip(cn, ca) END AS z FROM x),
 u AS (SELECT meeting_id, generate_subscripts(z, 1) - 1 AS pos, unnest(z) AS z FROM p), v AS (SELECT meeting_id, pos, regexp_replace(regexp_replace(regexp_replace(z[1], '\\s+', ' ', 'g'), '(?i)\\s*sent the following.*', '', 'g'), '^{_BL}+|{_BL}+$', '', 'g') AS name, upper(trim(z[2])) AS stamp FROM u),
 k AS (SELECT meeting_id, pos, name, try_cast({_part(1)} AS INT) AS h, try_cast({_part(2)} AS INT) AS mi, coalesce(try_cast({_part(3)} AS INT), 0) AS se, {_part(3)} AS sx, {_part(4)} AS half FROM v),
 c AS (SELECT meeting_id, pos, name, CASE WHEN half <> '' THEN h % 12 + CASE WHEN half = 'PM' THEN 12 ELSE 0 END ELSE h END * 3600 + mi * 60 + se AS sec FROM k WHERE mi < 60 AND se < 60 AND CASE WHEN half <> '' THEN h BETWEEN 1 AND 12 AND sx = '' ELSE h < 24 END AND length(name) >= 2),
 g AS (SELECT *, (((sec - lag(sec) OVER (PARTITION BY meeting_id ORDER BY pos)) % 86400) + 86400) % 86400 AS gap, count(*) OVER (PARTITION BY meeting_id) AS n FROM c),
 w AS (SELECT meeting_id, name, sum(CASE WHEN gap IS NULL OR gap <= 60 THEN 1.0 WHEN gap <= 300 THEN 0.5 ELSE 0.01 END) AS weight, min(pos) AS pos FROM g WHERE n >= 2 GROUP BY 1, 2)"""
SQL = {
    "topic_stalls": f"""WITH {_T} SELECT t.meeting_id, t.turn_idx AS stalled_turn, t.speaker AS stalled_speaker, t.turn_idx + 1 AS pivot_turn, l.turn_idx AS circled_back_turn, l.speaker AS circled_back_speaker
 FROM t JOIN t n ON n.meeting_id = t.meeting_id AND n.turn_idx = t.turn_idx + 1 JOIN t l ON l.meeting_id = t.meeting_id AND l.turn_idx BETWEEN t.turn_idx + 2 AND t.turn_idx + 6 WHERE {_any([p for p, _ in lexicon.SOFT])} AND len(t.terms) > 0
 AND len(list_intersect(t.terms, n.terms)) / len(t.terms) <= 0.25 AND len(l.terms) > 0 AND len(list_intersect(t.terms, l.terms)) / len(t.terms) >= 0.34 QUALIFY row_number() OVER (PARTITION BY t.meeting_id, t.turn_idx ORDER BY l.turn_idx) = 1""",
    "senior_silence": f"""WITH {_T}, e AS (SELECT *, coalesce(lead(turn_idx) OVER (PARTITION BY meeting_id, speaker ORDER BY turn_idx), count(*) OVER (PARTITION BY meeting_id)) AS stop FROM r)
 SELECT e.meeting_id, e.speaker AS senior_speaker, e.role AS senior_role, e.turn_idx AS silence_starts_turn, e.stop - e.turn_idx AS silence_length_turns, l.speaker AS junior_speaker, l.turn_idx AS pivot_turn FROM e JOIN r l ON l.meeting_id = e.meeting_id AND l.turn_idx BETWEEN e.turn_idx + 1 AND e.turn_idx + 4
 WHERE e.rank >= 5 AND e.stop - e.turn_idx >= 3 AND len(e.terms) > 0 AND l.turn_idx < e.stop AND l.rank < e.rank AND len(l.terms) > 0 AND len(list_intersect(e.terms, l.terms)) / len(e.terms) < 0.2 QUALIFY row_number() OVER (PARTITION BY e.meeting_id, e.turn_idx ORDER BY l.turn_idx) = 1""",
    "closing_summarizer": f"""WITH {_T}, g AS (SELECT *, max(turn_idx) OVER (PARTITION BY meeting_id) AS last FROM r), e AS (SELECT *, sum(CASE WHEN turn_idx < last * 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id, speaker) AS early, count(*) OVER (PARTITION BY meeting_id, speaker) AS own FROM g)
 SELECT meeting_id, speaker, role, turn_idx, own AS turns FROM e t WHERE turn_idx >= last - 2 AND {_any(lexicon.CLOSING)} AND rank >= 5 AND early <= 1 QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY turn_idx DESC) = 1""",
    "talk_time_from_clock": f"""WITH {WEIGHTS_SQL},
 q AS (SELECT meeting_id, name, pos, CAST(round_even(CAST(weight AS DOUBLE) * 100 / sum(CAST(weight AS DOUBLE)) OVER (PARTITION BY meeting_id), 0) AS INT) AS pct FROM w)
 SELECT meeting_id, name, CAST(pct + CASE WHEN row_number() OVER (PARTITION BY meeting_id ORDER BY pos) = 1 THEN 100 - sum(pct) OVER (PARTITION BY meeting_id) ELSE 0 END AS INT) AS talk_time_pct FROM q""",
    "turns_parsed": f"SELECT meeting_id, count(*) AS turns, count(DISTINCT speaker) AS speakers, sum(length(text)) AS chars FROM {_TURNS} GROUP BY meeting_id",
    "talk_share_chars": f"SELECT *, sum(chars) OVER (PARTITION BY meeting_id) AS total FROM (SELECT meeting_id, speaker, sum(length(text)) AS chars, count(*) AS turns FROM {_TURNS} GROUP BY meeting_id, speaker)",
}
