"""Analysis results: schema, defaults, stand-in extraction, health, status, ranking of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip, words
from ..sources.seed import MEETINGS, rows
from . import grounding, signals
from .people import strip_sql
from .texts import _WORDS

#: What a model's answer holds; unknown keys are ignored.
RESULT = (
    "meeting_title string, full_summary string, summary array<string>, key_decisions array<string>, action_items array<struct<task:string,owner:string,deadline:string>>, "
    "sentiment array<struct<speaker:string,score:string,label:string>>, speakers array<struct<name:string,talk_time_pct:double,tone:string,tone_label:string,tone_intensity:int>>, "
    "japan_insights struct<keigo_level:string,nemawashi_signals:array<string>,code_switch_count:int>"
)
# Tones, their label where none is given, and points by risk level.
TONE_LABEL = "Professional tone"
TONES = ("aggressive", "assertive", "neutral", "cooperative", "deferential", "hesitant")
RISK_POINTS = (("NONE", 25), ("MINIMAL", 20), ("LOW", 15), ("MEDIUM", 8), ("HIGH", 0), ("CRITICAL", 0))


def parse(raw: Column) -> Column:
    """A JSON answer as a RESULT struct; a key of another type is null, so one bad field doesn't lose the row."""
    return F.from_json(raw, RESULT, {"mode": "PERMISSIVE"})


def title(summary: Column, full: Column) -> Column:
    """Eight words of the first bullet, else of the summary, without icons."""
    src = F.coalesce(F.nullif(F.get(summary, F.lit(0)), F.lit("")), full, F.lit(""))
    w = words(F.regexp_replace(src, "^[\U0001f4cb\U0001f465\U0001f4dd⚠️\\s]+", ""))
    return F.when(F.size(w) == 0, "Meeting Analysis").otherwise(F.concat(F.array_join(F.slice(w, 1, 8), " "), F.when(F.size(w) > 8, "…").otherwise("")))


def filled(r: str) -> Column:
    """The struct column r with defaults: title, empty lists, tones of the list, talk time scaled to 100 or shared equally where there is none."""
    c = F.col(r)
    sp = F.coalesce(c["speakers"], F.array().cast("array<struct<name:string,talk_time_pct:double,tone:string,tone_label:string,tone_intensity:int>>"))
    pct = lambda x: F.coalesce(x["talk_time_pct"], F.lit(0.0))
    total = F.aggregate(sp, F.lit(0.0), lambda s, x: s + pct(x))
    share = lambda x: F.when(total == 0, F.bround(F.lit(100.0) / F.size(sp))).when(total == 100, pct(x)).otherwise(F.bround(pct(x) * 100 / total))
    tone = lambda x: F.when(F.lower(x["tone"]).isin(*TONES), x["tone"]).otherwise("neutral")
    speakers = F.transform(sp, lambda x: F.struct(x["name"].alias("name"), share(x).cast("int").alias("talk_time_pct"), tone(x).alias("tone"), F.coalesce(x["tone_label"], F.lit(TONE_LABEL)).alias("tone_label"), F.coalesce(x["tone_intensity"], F.lit(3)).alias("tone_intensity")))
    none = F.array().cast("array<string>")
    ji = F.struct(F.coalesce(c["japan_insights"]["keigo_level"], F.lit("unknown")).alias("keigo_level"), F.coalesce(c["japan_insights"]["nemawashi_signals"], none).alias("nemawashi_signals"), F.coalesce(c["japan_insights"]["code_switch_count"], F.lit(0)).alias("code_switch_count"))
    return F.struct(
        F.when(F.coalesce(strip(c["meeting_title"]), F.lit("")) != "", c["meeting_title"]).otherwise(title(c["summary"], c["full_summary"])).alias("meeting_title"), F.coalesce(c["full_summary"], F.lit("")).alias("full_summary"),
        F.coalesce(c["summary"], F.array(F.lit("No summary available."))).alias("summary"), F.coalesce(c["key_decisions"], none).alias("key_decisions"),
        F.coalesce(c["action_items"], F.array().cast("array<struct<task:string,owner:string,deadline:string>>")).alias("action_items"), F.coalesce(c["sentiment"], F.array().cast("array<struct<speaker:string,score:string,label:string>>")).alias("sentiment"),
        speakers.alias("speakers"), ji.alias("japan_insights"),
    )


_MOCK = r"(?m)(?:^|\n)\s*(?!https?:)([A-Za-z][A-Za-z\s.']{1,35}?)\s*[:：]"


def stand_in(c: Column) -> Column:
    """The RESULT of a text without a model: its labels as speakers of equal shares and neutral mood."""
    got = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(_MOCK)), strip), lambda n: (F.length(n) >= 2) & ~F.lower(n).isin("http", "https", "view", "sorry", "would", "could")))
    names = F.when(F.size(got) > 0, got).otherwise(F.array(F.lit("Speaker A"), F.lit("Speaker B")))
    n, w = F.size(names), F.size(words(c))
    pct = F.bround(F.lit(100.0) / n)
    bullets = F.concat(F.array(F.concat(F.lit("Transcript: "), w.cast("string"), F.lit(" words"))), F.array_repeat(F.lit("No model answer."), F.when(w < 200, 2).when(w < 600, 4).otherwise(6)))
    return F.struct(
        F.concat(F.lit("Demo Analysis — "), n.cast("string"), F.when(n > 1, " Speakers").otherwise(" Speaker")).alias("meeting_title"), F.lit("").alias("full_summary"), bullets.alias("summary"), F.array().cast("array<string>").alias("key_decisions"),
        F.array(F.struct(F.lit("No action items without a model answer.").alias("task"), F.get(names, F.lit(0)).alias("owner"), F.lit("N/A").alias("deadline"))).alias("action_items"),
        F.transform(names, lambda x: F.struct(x.alias("speaker"), F.lit("neutral").alias("score"), F.lit("no model answer").alias("label"))).alias("sentiment"),
        F.transform(names, lambda x: F.struct(x.alias("name"), pct.alias("talk_time_pct"), F.lit("neutral").alias("tone"), F.lit(TONE_LABEL).alias("tone_label"), F.lit(3).alias("tone_intensity"))).alias("speakers"),
        F.struct(F.lit("unknown").alias("keigo_level"), F.array().cast("array<string>").alias("nemawashi_signals"), F.lit(0).alias("code_switch_count")).alias("japan_insights"),
    )


def has_owner(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("TBD")).isin("TBD", "Unknown", "")


def has_date(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("TBD")).isin("TBD", "N/A", "")


def health(df: DataFrame, gate_cap: bool = False) -> DataFrame:
    """df (sentiment, items with owner, deadline, flag, or their numbers items_n, owned_n, dated_n; risk_level, terminated, gate, hallucination_risk) with health_score and health_label. gate_cap: at most 55 behind an approval gate."""
    s = F.coalesce("sentiment", F.array().cast("array<string>"))
    weight = lambda x: F.when(F.lower(x) == "positive", 1.0).when(F.lower(x) == "neutral", 0.6).when(F.lower(x) == "negative", 0.1).otherwise(0.5)
    mood = F.when(F.size(s) == 0, 15).otherwise(F.bround(F.aggregate(s, F.lit(0.0), lambda a, x: a + weight(x)) / F.size(s) * 30).cast("int"))
    if "items" in df.columns:
        good = F.filter("items", lambda i: ~F.coalesce(i["flag"], F.lit(False)))
        n, owned, dated = F.coalesce(F.size("items"), F.lit(0)), F.size(F.filter(good, lambda i: has_owner(i["owner"]))), F.size(F.filter(good, lambda i: has_date(i["deadline"])))
    else:
        n, owned, dated = (F.coalesce(c, F.lit(0)) for c in ("items_n", "owned_n", "dated_n"))
    clear = F.when(n <= 0, 10).otherwise(F.bround((owned + dated) / (2 * n) * 25).cast("int"))
    risk = F.lit(25)
    for word, p in RISK_POINTS:
        risk = F.when(F.col("risk_level") == word, p).otherwise(risk)
    ground = F.bround((1 - F.coalesce("hallucination_risk", F.lit(0.0))) * 20).cast("int")
    score = F.least(mood + clear + risk + ground, F.lit(100))
    if gate_cap:
        score = F.when(F.col("gate"), F.least(score, F.lit(55))).otherwise(score)
    score = F.when(F.col("terminated"), F.least(score, F.lit(22))).otherwise(score)
    d = df.withColumn("health_score", score)
    label = F.when(F.col("terminated"), "Contract Terminated").when(F.col("health_score") >= 80, "Productive Meeting").when(F.col("health_score") >= 60, "Mostly Aligned").when(F.col("health_score") >= 40, "Needs Follow-up").otherwise("High Risk")
    return d.withColumn("health_label", label)


def status(risk_level: Column, dynamics: Column, strict: bool = False) -> Column:
    """ESCALATE, WATCH or ON_TRACK by risk and the number of structural events; strict lets CRITICAL escalate."""
    high = risk_level.isin("HIGH", "CRITICAL") if strict else risk_level == "HIGH"
    return F.when(high, "ESCALATE").when(risk_level.isin("MEDIUM", "LOW") | (dynamics >= 1), "WATCH").otherwise("ON_TRACK")


def severity_rank(c: Column) -> Column:
    return F.when(F.upper(c) == "HIGH", 3).when(F.upper(c) == "MEDIUM", 2).when(F.upper(c) == "LOW", 1).otherwise(0)


def top_signals(s: DataFrame, group: str, most: int = 4, *tie: str) -> DataFrame:
    """The gravest rows of each group by severity, then confidence (or the given columns), numbered."""
    w = W.partitionBy(group).orderBy(severity_rank(F.col("severity")).desc(), *(F.col(t) for t in tie))
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def japan_side(signals: DataFrame) -> DataFrame:
    """meeting_id, speakers whom a signal is attributed to."""
    return signals.where("speaker <> 'Unknown'").groupBy("meeting_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))


CASES = (
    ("H1", "positive", "NONE", False, "Mori", "Friday", False, 0.0), ("H1", "neutral", "NONE", False, "TBD", "", False, 0.0), ("H2", "negative", "CRITICAL", True, "Abe", "Monday", True, 0.5), ("H3", "neutral", "MEDIUM", False, "Unknown", "N/A", False, 0.25),
)


def q_health(spark: SparkSession, folder: str) -> DataFrame:
    d = spark.createDataFrame([*CASES], "id string, mood string, risk_level string, terminated boolean, owner string, deadline string, flag boolean, hallucination_risk double")
    g = d.groupBy("id", "risk_level", "terminated", "hallucination_risk").agg(F.collect_list("mood").alias("sentiment"), F.collect_list(F.struct("owner", "deadline", "flag")).alias("items"))
    return health(g.withColumn("gate", F.lit(False))).select("id", "health_score", "health_label")


def q_request_health(spark: SparkSession, folder: str) -> DataFrame:
    """Health of every request from its transcript's risk, its items and the grounding of its claims; the tables hold no moods, so these count as missing. Items are counted, not collected."""
    m = grounding._requests(spark, folder)
    a = spark.read.parquet(f"{folder}/action_items.parquet").where("request_id IS NOT NULL").select(F.col("request_id").alias("meeting_id"), "item_id", "task", "owner", "deadline", "flag").distinct()
    good = lambda c: F.sum((c & ~F.coalesce("flag", F.lit(False))).cast("int"))
    n = a.groupBy("meeting_id").agg(F.count("*").alias("items_n"), good(has_owner(F.col("owner"))).alias("owned_n"), good(has_date(F.col("deadline"))).alias("dated_n"))
    h = grounding.q_risk(spark, folder).select("meeting_id", F.bround(F.col("flagged_total") / F.col("total_claims"), 3).alias("hallucination_risk"))
    d = signals.risk(m).join(n, "meeting_id", "left").join(h, "meeting_id", "left").withColumn("sentiment", F.array().cast("array<string>"))
    d = d.withColumn("terminated", F.col("termination_n") > 0).withColumn("gate", F.col("gate_n") > 0)
    return health(d).select("meeting_id", "health_score", "health_label")


def q_top(spark: SparkSession, folder: str) -> DataFrame:
    """The four gravest said-versus-meant items of each request."""
    s = spark.read.parquet(f"{folder}/said_vs_meant_items.parquet").where("request_id IS NOT NULL").select("request_id", "item_id", "severity").distinct()
    return top_signals(s, "request_id", 4, "item_id").select("request_id", "item_id", "place")


#: Answers with and without what a result needs: (id, answer, then what comes out: title, bullets, actions, register, shares of talk time, tones).
ANSWERS = (
    ("R1", '{"summary": ["one two three four five six seven eight nine", "b"], "action_items": [{"task": "x"}], "japan_insights": {"keigo_level": "high"}}', "one two three four five six seven eight…", 2, 1, "high", "", ""),
    ("R2", "{}", "Meeting Analysis", 1, 0, "unknown", "", ""), ("R3", "broken", "Meeting Analysis", 1, 0, "unknown", "", ""), ("R4", '{"meeting_title": "  ", "full_summary": "a b", "summary": []}', "a b", 0, 0, "unknown", "", ""),
    ("R5", '{"meeting_title": "T", "speakers": [{"name": "A", "talk_time_pct": 30, "tone": "odd"}, {"name": "B", "talk_time_pct": 90, "tone": "Assertive"}]}', "T", 1, 0, "unknown", "25,75", "neutral,Assertive"),
    ("R6", '{"meeting_title": "T", "speakers": [{"name": "A"}, {"name": "B"}, {"name": "C", "tone": "hesitant"}], "action_items": "none"}', "T", 1, 0, "unknown", "33,33,33", "neutral,neutral,hesitant"),
)


def q_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Job results, and answers that lack this or that, with defaults filled."""
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").where("result IS NOT NULL").select("job_id", "result").distinct()
    case = spark.createDataFrame([r[:2] for r in ANSWERS], "job_id string, result string")
    f = j.union(case).withColumn("r", parse(F.col("result"))).select("job_id", filled("r").alias("f"))
    each = lambda c: F.array_join(F.transform("f.speakers", lambda x: x[c].cast("string")), ",")
    return f.select("job_id", "f.meeting_title", F.size("f.summary").alias("bullets"), F.size("f.action_items").alias("actions"), F.col("f.japan_insights.keigo_level").alias("keigo_level"), each("talk_time_pct").alias("talk"), each("tone").alias("tones"))


def q_mock(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.seed import meetings

    m = meetings(spark, folder).select("meeting_id", stand_in(F.col("transcript")).alias("r"))
    return m.select("meeting_id", "r.meeting_title", F.size("r.speakers").alias("speakers"), F.size("r.summary").alias("bullets"))


_LEAST = "(SELECT request_id AS meeting_id, min(transcript) AS transcript FROM analyze_requests WHERE transcript IS NOT NULL GROUP BY 1)"
_SEV = "CASE upper(severity) WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
QUERIES = {"health_score": q_health, "request_health": q_request_health, "top_signals": q_top, "result_defaults": q_answers, "mock_extraction": q_mock}
SQL = {
    "request_health": f"""SELECT meeting_id, score AS health_score, CASE WHEN terminated THEN 'Contract Terminated' WHEN score >= 80 THEN 'Productive Meeting' WHEN score >= 60 THEN 'Mostly Aligned' WHEN score >= 40 THEN 'Needs Follow-up' ELSE 'High Risk' END AS health_label FROM (
 SELECT meeting_id, termination_n > 0 AS terminated, CAST(CASE WHEN termination_n > 0 THEN least(s, 22) ELSE least(s, 100) END AS INT) AS score FROM (SELECT r.meeting_id, termination_n, 15 + CASE WHEN coalesce(n, 0) = 0 THEN 10 ELSE round_even((owned + dated) * 25.0 / (2 * n), 0) END
 + CASE risk_level WHEN 'NONE' THEN 25 WHEN 'MINIMAL' THEN 20 WHEN 'LOW' THEN 15 WHEN 'MEDIUM' THEN 8 ELSE 0 END + round_even((1 - coalesce(round_even(flagged_total * 1.0 / total_claims, 3), 0)) * 20, 0) AS s
 FROM (SELECT *, {signals._LEVEL} AS risk_level FROM ({signals._RISK.replace(signals.MEETINGS, _LEAST)})) r LEFT JOIN ({grounding.RISK_SQL}) h USING (meeting_id) LEFT JOIN (SELECT request_id AS meeting_id, count(*) AS n,
 count(*) FILTER (WHERE NOT coalesce(flag, FALSE) AND coalesce(owner, 'TBD') NOT IN ('TBD', 'Unknown', '')) AS owned, count(*) FILTER (WHERE NOT coalesce(flag, FALSE) AND coalesce(deadline, 'TBD') NOT IN ('TBD', 'N/A', '')) AS dated
 FROM (SELECT DISTINCT request_id, item_id, task, owner, deadline, flag FROM action_items WHERE request_id IS NOT NULL) GROUP BY 1) i USING (meeting_id)))""",
    "mock_extraction": f"""SELECT meeting_id, 'Demo Analysis — ' || n || CASE WHEN n > 1 THEN ' Speakers' ELSE ' Speaker' END AS meeting_title, n AS speakers, 1 + CASE WHEN w < 200 THEN 2 WHEN w < 600 THEN 4 ELSE 6 END AS bullets FROM (
 SELECT meeting_id, CASE WHEN len(g) > 0 THEN len(g) ELSE 2 END AS n, w FROM (SELECT meeting_id, len({_WORDS}) AS w, list_filter(list_distinct(list_transform(regexp_extract_all(transcript, '(?m)(?:^|\\n)\\s*([A-Za-z][A-Za-z\\s.'']{{1,35}}?)\\s*[:：]', 1), lambda x: {strip_sql("x")})),
 lambda x: length(x) >= 2 AND lower(x) NOT IN ('http', 'https', 'view', 'sorry', 'would', 'could')) AS g FROM {MEETINGS}))""",
    "top_signals": f"SELECT request_id, item_id, place FROM (SELECT request_id, item_id, row_number() OVER (PARTITION BY request_id ORDER BY {_SEV} DESC, item_id) AS place FROM (SELECT DISTINCT request_id, item_id, severity FROM said_vs_meant_items WHERE request_id IS NOT NULL)) WHERE place <= 4",
    "result_defaults": f"""SELECT job_id, coalesce(nullif(trim(result ->> '$.meeting_title'), ''), 'Meeting Analysis') AS meeting_title, 1 AS bullets, 0 AS actions, 'unknown' AS keigo_level, '' AS talk, '' AS tones FROM (SELECT DISTINCT job_id, result FROM analysis_jobs WHERE result IS NOT NULL)
 UNION ALL SELECT * FROM {rows([(r[0], *r[2:]) for r in ANSWERS], "a(job_id, meeting_title, bullets, actions, keigo_level, talk, tones)")}""",
    "health_score": f"""SELECT id, score AS health_score, CASE WHEN terminated THEN 'Contract Terminated' WHEN score >= 80 THEN 'Productive Meeting' WHEN score >= 60 THEN 'Mostly Aligned' WHEN score >= 40 THEN 'Needs Follow-up' ELSE 'High Risk' END AS health_label FROM (
 SELECT id, terminated, CASE WHEN terminated THEN least(s, 22) ELSE s END AS score FROM (SELECT id, terminated, CAST(least(100, round_even(avg(CASE mood WHEN 'positive' THEN 1.0 WHEN 'neutral' THEN 0.6 ELSE 0.1 END) * 30, 0) + round_even(sum(CASE WHEN flag THEN 0 ELSE CAST(owner NOT IN ('TBD', 'Unknown', '') AS INT) + CAST(deadline NOT IN ('TBD', 'N/A', '') AS INT) END) * 25.0 / (2 * count(*)), 0)
 + CASE risk_level WHEN 'NONE' THEN 25 WHEN 'MINIMAL' THEN 20 WHEN 'LOW' THEN 15 WHEN 'MEDIUM' THEN 8 ELSE 0 END + round_even((1 - max(hr)) * 20, 0)) AS INT) AS s FROM {rows(CASES, 'c(id, mood, risk_level, terminated, owner, deadline, flag, hr)')} GROUP BY id, terminated, risk_level))""",
}
