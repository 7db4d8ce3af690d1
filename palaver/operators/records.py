"""Rows that are kept of an analysis: log rows, evaluation metrics, notes on risk, speakers in order, gates and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import _SIMILAR_STOPS, code_switches, keigo, language, similarity, strip, word_set
from ..sources.seed import MEETINGS, meetings, rows
from ..sources.seed import text as lit
from . import dynamics, grounding, people, signals, texts
from .evaluation import _tok
from .reports import export_filename

#: Least characters of a transcript that is analysed.
LEAST_CHARS = 20
#: Tiers in the order of a report, and their severity.
TIERS = (("T", "HIGH"), ("G", "HIGH"), ("H", "HIGH"), ("M", "MEDIUM"), ("L", "LOW"))
# What a reader should make of the signals; the first that applies.
NOTES = {
    "termination": "A contract or partnership was ended in plain words. Polite form doesn't make it open to talks.",
    "gate": "Agreement here isn't approval: someone outside the meeting decides. Wait for it in writing.",
    "high": "Several signs of failing performance beside hedged words. Speak about remedies before the next meeting.",
    "indirect": "A refusal may have been put indirectly. Ask again for intent and dates.",
    "none": "No signs of refusal.",
}


def note(df: DataFrame) -> Column:
    """The key of NOTES for rows of signals.risk."""
    high = F.col("risk_level")
    return F.when(F.col("termination_n") > 0, "termination").when(F.col("gate_n") > 0, "gate").when(high == "HIGH", "high").when(high.isin("MEDIUM", "LOW"), "indirect").otherwise("none")


def detected(c: Column) -> Column:
    """The rejection signals of a text as structs of severity and phrase: terminations, gates, high, medium and low ones, each tier in the order of its list."""
    found = signals.scan(c, signals.REJECTIONS)
    tier = lambda a, t, s: F.transform(F.filter(a, lambda e: e["tier"] == t), lambda e: F.struct(F.lit(s).alias("severity"), e["phrase"].alias("phrase")))
    # An array of one, so that the text is scanned once.
    return F.transform(F.array(found), lambda a: F.concat(*(tier(a, t, s) for t, s in TIERS)))[0]


def cultural_notes(df: DataFrame) -> DataFrame:
    """meeting_id, total_signals, detected, note of meetings (meeting_id, transcript). A null or empty transcript has no signals and the note `none`."""
    d = signals.risk(df)
    return d.select("meeting_id", "total_signals", detected(F.coalesce("transcript", F.lit(""))).alias("detected"), note(d).alias("note"))


def speakers_in_order(df: DataFrame) -> DataFrame:
    """meeting_id, place, speaker, chars: the speakers of each meeting by what they said, the most first; equal ones by name."""
    t = dynamics.turns(df).groupBy("meeting_id", "speaker").agg(F.sum(F.length("text")).alias("chars"))
    w = W.partitionBy("meeting_id").orderBy(F.col("chars").desc(), "speaker")
    return t.select("meeting_id", F.row_number().over(w).alias("place"), "speaker", "chars")


def long_enough(c: Column) -> Column:
    """Whether a transcript is long enough to be analysed; null isn't."""
    return F.coalesce(F.length(strip(c)) >= LEAST_CHARS, F.lit(False))


def audit_rows(meetings_: DataFrame, items: DataFrame, claims: DataFrame) -> DataFrame:
    """The log row of each analysed meeting (meeting_id, transcript), with items (meeting_id, item_id, flag) and claims (meeting_id, claim, least): the documented columns but for time, session and duration, which the caller knows. Append them with write.mode("append").json."""
    t = F.col("transcript")
    d = signals.risk(meetings_).withColumn("language", language(t)).withColumn("keigo_level", keigo(t)).withColumn("code_switches", code_switches(t))
    flagged = F.sum(F.coalesce("flag", F.lit(False)).cast("int"))
    a = items.groupBy("meeting_id").agg(F.count("*").alias("action_items_total"), flagged.alias("action_items_flagged"))
    s = people.speakers(meetings_).groupBy("meeting_id").agg(F.count("*").alias("speakers_detected"))
    r = grounding.risk(grounding.verify_claims(claims, meetings_, None)).select("meeting_id", F.col("overall_hallucination_risk").alias("hallucination_rate"), F.col("risk_label").alias("hallucination_risk"))
    j = d.join(a, "meeting_id", "left").join(s, "meeting_id", "left").join(r, "meeting_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(
        F.col("meeting_id").alias("session_id"), F.length(t).alias("transcript_chars"), "language", zero("action_items_total"), zero("action_items_flagged"),
        F.coalesce("hallucination_rate", F.lit(0.0)).alias("hallucination_rate"), F.coalesce("hallucination_risk", F.lit("UNKNOWN")).alias("hallucination_risk"),
        F.col("risk_level").alias("soft_rejection_risk"), F.col("total_signals").alias("soft_rejection_count"), zero("speakers_detected"), "keigo_level", "code_switches",
        F.lit("success").alias("status"),
    )


def metric_rows(scores: DataFrame, key: str = "case_id") -> DataFrame:
    """key, metric, value: every number of an evaluation, a row each, for a table of runs. Nulls give no row."""
    names = [c for c, kind in scores.dtypes if c != key and kind in ("int", "bigint", "double", "float")]
    one = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))
    return scores.select(key, F.inline(one)).where("value IS NOT NULL")


def average(scores: DataFrame, column: str = "overall_score") -> DataFrame:
    """cases, average: the mean of a score over all cases, to one place."""
    return scores.agg(F.count(column).alias("cases"), F.bround(F.avg(column), 1).alias("average"))


# --- queries ---
def q_notes(spark: SparkSession, folder: str) -> DataFrame:
    d = cultural_notes(meetings(spark, folder))
    return d.select("meeting_id", "total_signals", F.array_join(F.transform("detected", lambda e: F.concat_ws(":", e["severity"], e["phrase"])), "|").alias("detected"), "note")


def q_order(spark: SparkSession, folder: str) -> DataFrame:
    return speakers_in_order(meetings(spark, folder))


def q_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and requests by whether they are long enough."""
    d = spark.read.parquet(f"{folder}/analyze_requests.parquet").select(F.col("request_id").alias("text_id"), F.col("transcript").alias("t")).distinct()
    e = spark.read.parquet(f"{folder}/said_vs_meant_items.parquet").select(F.col("item_id").alias("text_id"), F.col("said").alias("t")).distinct()
    return d.union(e).groupBy(long_enough(F.col("t")).alias("passes")).agg(F.count("*").alias("texts"))


def q_audit(spark: SparkSession, folder: str) -> DataFrame:
    a = spark.read.parquet(f"{folder}/action_items.parquet").where("request_id IS NOT NULL")
    a = a.select(F.col("request_id").alias("meeting_id"), "item_id", "task", "owner", "deadline", "flag").distinct()
    return audit_rows(grounding._requests(spark, folder), a, grounding._claims(spark, folder))


def q_side(spark: SparkSession, folder: str) -> DataFrame:
    """Speakers to whom a signal is attributed."""
    from .results import japan_side

    return japan_side(signals.signals(meetings(spark, folder))).select("meeting_id", F.array_join("speakers", "|").alias("speakers"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    s = spark.read.parquet(f"{folder}/said_vs_meant_items.parquet").where("item_id IS NOT NULL")
    return s.select("item_id", "said", "reading", "meant").distinct()


def q_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """How alike what was said and what was meant are, and how many words each has."""
    s = _items(spark, folder).where("said IS NOT NULL AND meant IS NOT NULL")
    return s.select("item_id", "said", "meant", similarity(F.col("said"), F.col("meant")).alias("similarity"), F.size(word_set(F.col("said"))).alias("said_words"), F.size(word_set(F.col("meant"))).alias("meant_words")).drop("said", "meant")


def q_greetings(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each item that may be nemawashi signals, once mere greetings are left out."""
    s = _items(spark, folder)
    every = F.array_compact(F.array("said", "reading", "meant"))
    return s.select("item_id", F.size(every).alias("given"), F.size(signals.without_greetings(every)).alias("kept"))


def q_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the export files of finished jobs."""
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").where("finished_at IS NOT NULL").select("job_id", "language", "finished_at").distinct()
    return j.select("job_id", export_filename(F.coalesce("language", F.lit("en")), F.col("finished_at").try_cast("timestamp")).alias("file_name"))


QUERIES = {
    "cultural_notes": q_notes, "speakers_by_talk": q_order, "length_gate": q_gate, "audit_rows": q_audit, "japan_side": q_side, "text_similarity": q_similarity, "greeting_filter": q_greetings,
    "export_filenames": q_files,
}
_LEAST = "(SELECT request_id AS meeting_id, min(transcript) AS transcript FROM analyze_requests WHERE transcript IS NOT NULL GROUP BY 1)"
_LISTED = rows([(p, k, t, c, i) for i, (p, k, t, c, _) in enumerate(signals.REJECTIONS)], "l(phrase, kind, tier, ci, pos)")
_AT = "CASE tier " + " ".join(f"WHEN '{t}' THEN {i}" for i, (t, _) in enumerate(TIERS)) + " END"
_SEVERITY = "CASE tier " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in TIERS) + " END"
_NOT = "(" + ", ".join(map(lit, _SIMILAR_STOPS)) + ")"
_sim = lambda c: f"list_filter({_tok(c)}, lambda w: w NOT IN {_NOT})"
_word = "[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_set = lambda c: f"len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '{_word}', '', 'g'), '{texts._BLANK}+'), lambda w: w <> '')))"
_BARE = "regexp_replace(s, '[。、！？…「」『』\\s]', '', 'g')"
_GREETINGS = "[" + ", ".join(lit("".join(c for c in g if c not in "。、！？…「」『』 ")) for g in lexicon.NEMAWASHI_EXCLUDED) + "]"
_KEPT = f"""list_filter(given, lambda s: regexp_matches(s, '[\\x{{3040}}-\\x{{9fff}}\\x{{ff65}}-\\x{{ff9f}}]') AND len(list_filter({_GREETINGS}, lambda g: g = {_BARE} OR length(g) / greatest(length({_BARE}), 1) > 0.85)) = 0)"""
SQL = {
    "cultural_notes": f"""WITH h AS (SELECT m.meeting_id, string_agg({_SEVERITY} || ':' || phrase, '|' ORDER BY {_AT}, pos) AS detected FROM {MEETINGS} m JOIN {_LISTED} ON contains(CASE WHEN l.ci THEN lower(m.transcript) ELSE m.transcript END, l.phrase) GROUP BY 1)
 SELECT meeting_id, total_signals, coalesce(detected, '') AS detected, CASE WHEN termination_n > 0 THEN 'termination' WHEN gate_n > 0 THEN 'gate' WHEN risk_level = 'HIGH' THEN 'high' WHEN risk_level IN ('MEDIUM', 'LOW') THEN 'indirect' ELSE 'none' END AS note
 FROM (SELECT *, {signals._LEVEL} AS risk_level FROM ({signals._RISK})) LEFT JOIN h USING (meeting_id)""",
    "speakers_by_talk": f"SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY chars DESC, speaker) AS INT) AS place, speaker, chars FROM (SELECT meeting_id, speaker, sum(length(text)) AS chars FROM {dynamics._TURNS} GROUP BY 1, 2)",
    "length_gate": f"""SELECT coalesce(length({texts._strip("t")}) >= {LEAST_CHARS}, FALSE) AS passes, count(*) AS texts FROM (SELECT DISTINCT request_id AS text_id, transcript AS t FROM analyze_requests UNION ALL SELECT DISTINCT item_id, said FROM said_vs_meant_items) GROUP BY 1""",
    "audit_rows": f"""SELECT r.meeting_id AS session_id, length(r.transcript) AS transcript_chars, l.language, coalesce(a.n, 0) AS action_items_total, coalesce(a.f, 0) AS action_items_flagged, coalesce(h.rate, 0) AS hallucination_rate,
 CASE WHEN h.rate IS NULL THEN 'UNKNOWN' WHEN h.rate < 0.15 THEN 'LOW' WHEN h.rate < 0.35 THEN 'MEDIUM' ELSE 'HIGH' END AS hallucination_risk, r.risk_level AS soft_rejection_risk, r.total_signals AS soft_rejection_count, coalesce(s.n, 0) AS speakers_detected, k.keigo AS keigo_level, c.switches AS code_switches, 'success' AS status
 FROM (SELECT *, {signals._LEVEL} AS risk_level FROM ({signals._RISK.replace('SELECT m.meeting_id,', 'SELECT m.meeting_id, m.transcript,').replace(MEETINGS, _LEAST)})) r JOIN ({texts.SQL["language_detect"].replace(MEETINGS, _LEAST)}) l USING (meeting_id)
 JOIN ({texts.SQL["keigo_levels"].replace(MEETINGS, _LEAST)}) k USING (meeting_id) JOIN ({texts.SQL["code_switches"].replace(MEETINGS, _LEAST)}) c USING (meeting_id)
 LEFT JOIN (SELECT meeting_id, count(*) AS n FROM ({people.speakers_sql(_LEAST)}) GROUP BY 1) s USING (meeting_id) LEFT JOIN (SELECT meeting_id, round_even(flagged_total * 1.0 / total_claims, 3) AS rate FROM ({grounding.RISK_SQL})) h USING (meeting_id)
 LEFT JOIN (SELECT request_id AS meeting_id, count(*) AS n, count(*) FILTER (WHERE flag) AS f FROM (SELECT DISTINCT request_id, item_id, task, owner, deadline, flag FROM action_items WHERE request_id IS NOT NULL) GROUP BY 1) a USING (meeting_id)""",
    "japan_side": f"SELECT meeting_id, string_agg(DISTINCT speaker, '|' ORDER BY speaker) AS speakers FROM ({signals.SQL['signal_rows']}) WHERE speaker <> 'Unknown' GROUP BY 1",
    "text_similarity": f"""SELECT item_id, CASE WHEN len(x) = 0 OR len(y) = 0 OR len(list_intersect(x, y)) = 0 THEN 0 ELSE round_even(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 3) END AS similarity, said_words, meant_words
 FROM (SELECT item_id, {_sim("said")} AS x, {_sim("meant")} AS y, {_set("said")} AS said_words, {_set("meant")} AS meant_words FROM (SELECT DISTINCT item_id, said, reading, meant FROM said_vs_meant_items WHERE item_id IS NOT NULL AND said IS NOT NULL AND meant IS NOT NULL))""",
    "greeting_filter": f"SELECT item_id, len(given) AS given, len({_KEPT}) AS kept FROM (SELECT item_id, list_filter([said, reading, meant], lambda s: s IS NOT NULL) AS given FROM (SELECT DISTINCT item_id, said, reading, meant FROM said_vs_meant_items WHERE item_id IS NOT NULL))",
    "export_filenames": "SELECT job_id, 'transcript_analysis_' || coalesce(language, 'en') || '_' || strftime(CAST(finished_at AS TIMESTAMP), '%Y%m%d_%H%M%S') || '.json' AS file_name FROM (SELECT DISTINCT job_id, language, finished_at FROM analysis_jobs WHERE finished_at IS NOT NULL)",
}
