"""Statistics and trends of an analysis log; the same expressions serve a batch and a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..stage import cut
from .schema_drift import LOG_ROWS_SQL, log_rows

#: Layout of a log row.
SCHEMA = (
    "timestamp string, session_id string, transcript_chars int, language string, provider string, duration_ms double, summary_bullets int, action_items_total int, action_items_flagged int, hallucination_rate double, "
    "hallucination_risk string, soft_rejection_risk string, soft_rejection_count int, speakers_detected int, keigo_level string, code_switches int, error string, status string"
)
# Scores of risk levels; strict counts CRITICAL too.
SCORES = ("NONE", "MINIMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def read_log(spark: SparkSession, path: str, include_errors: bool = False) -> DataFrame:
    """Rows of JSON lines; lines that can't be read are skipped, rows that aren't successes too unless asked for."""
    d = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return d if include_errors else d.where("status = 'success'")


def last(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows in the given order (top-n, no full sort)."""
    return rows.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def stats_columns() -> list[Column]:
    return [
        F.count("*").alias("total_analyses"), F.avg("duration_ms").alias("avg_duration_ms"), F.min("duration_ms").alias("min_duration_ms"), F.max("duration_ms").alias("max_duration_ms"),
        F.avg(F.col("error").isNotNull().cast("double")).alias("error_rate"), F.avg("hallucination_rate").alias("avg_hallucination_rate"), F.sum(F.col("hallucination_risk").isin("HIGH", "MEDIUM").cast("int")).alias("high_risk_analyses"),
    ]


def stats(rows: DataFrame) -> DataFrame:
    return rows.agg(*stats_columns())


def distribution(rows: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(column, F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def risk_score(c: Column, strict: bool = False) -> Column:
    """0 to 4; CRITICAL counts 0 as unknown words do, or 5 if strict."""
    words = SCORES if strict else SCORES[:-1]
    return F.greatest(F.array_position(F.array(*map(F.lit, words)), F.upper(F.coalesce(c, F.lit("NONE")))) - 1, F.lit(0))


#: Parts that a group's rows are dealt to before its ends are known.
PARTS = 16


def directions(rows: DataFrame, group: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """group, metric, n, recent, older, trend of each named value: the mean of the last three against the three before (with four or five values, against the first three); 15 % either way counts.

    Nulls don't count; a group without values has no row. Each part of a group keeps its own ends, and only those meet, so a group with a
    third of all rows, or all of them, is shared by many tasks.
    """
    one = F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("v")) for k, v in values.items()))
    d = rows.select(*group, F.struct(*order).alias("_at"), F.inline(F.filter(one, lambda x: x["v"].isNotNull())))
    keys = [*group, "metric"]

    def ends(df: DataFrame, *by: str) -> DataFrame:
        w = W.partitionBy(*by)
        return df.withColumn("back", F.row_number().over(w.orderBy(F.col("_at").desc(), "v"))).withColumn("fore", F.row_number().over(w.orderBy("_at", F.col("v").desc())))

    kept = ends(d.withColumn("_part", F.pmod(F.xxhash64("_at"), F.lit(PARTS))), *keys, "_part").where("back <= 6 OR fore <= 3").select(*keys, "_at", "v")
    n = d.groupBy(*keys).agg(F.count("*").alias("n"))
    e = ends(kept, *keys).join(n, keys)
    older = F.when(F.col("n") >= 6, F.col("back").between(4, 6)).otherwise(F.col("fore") <= 3)
    g = e.groupBy(*keys, "n").agg(F.avg(F.when(F.col("back") <= 3, F.col("v"))).alias("recent"), F.avg(F.when(older, F.col("v"))).alias("older"))
    return g.withColumn("trend", F.when(F.col("n") < 4, "stable").when(F.col("recent") > F.col("older") * 1.15, "up").when(F.col("recent") < F.col("older") * 0.85, "down").otherwise("stable"))


def direction(rows: DataFrame, group: list[str], order: list[str], value: Column) -> DataFrame:
    """directions of one value: group, n, recent, older, trend."""
    return directions(rows, group, order, {"value": value}).drop("metric")


#: Columns whose values are counted, and what stands for none.
COUNTED = (("keigo_level", "unknown"), ("provider", "unknown"), ("language", "unknown"), ("hallucination_risk", "UNKNOWN"), ("soft_rejection_risk", "NONE"))


def series(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """group, order and place with the seven series of the trend charts, a row each entry: label of its time, risk score, hallucination percentage, seconds, action items, code switches, speakers."""
    n = lambda c: F.coalesce(c, F.lit(0))
    w = W.partitionBy(*group).orderBy(*order)
    return rows.select(
        *group, *order, F.row_number().over(w).alias("place"), F.date_format(F.col("timestamp").try_cast("timestamp"), "MM/dd HH:mm").alias("label"), risk_score(F.col("soft_rejection_risk")).alias("soft_rejection_score"), F.bround(F.coalesce("hallucination_rate", F.lit(0.0)) * 100, 1).alias("hallucination_pct"),
        F.bround(F.coalesce("duration_ms", F.lit(0.0)) / 1000, 1).alias("duration_sec"), n("action_items_total").alias("action_items"), n("code_switches").alias("code_switches"), n("speakers_detected").alias("speakers"),
    )


def distributions(rows: DataFrame, group: list[str], *order: str) -> DataFrame:
    """group, name, value, n of the five counted columns; with an order also first, when a value comes first."""
    one = F.array(*(F.struct(F.lit(c).alias("name"), F.coalesce(c, F.lit(none)).alias("value")) for c, none in COUNTED))
    d = rows.select(*group, F.struct(*order).alias("_at") if order else F.lit(0).alias("_at"), F.explode(one).alias("_d"))
    g = d.groupBy(*group, F.col("_d.name").alias("name"), F.col("_d.value").alias("value")).agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    return g if order else g.drop("first")


def trends(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """group with directions of risk, hallucination rate and duration, averages, percentage of HIGH, the most used provider and language (of equal ones the first seen), and alerts as flags."""
    values = {"soft_rejection": risk_score(F.col("soft_rejection_risk")), "hallucination": F.col("hallucination_rate") * 100, "duration": F.col("duration_ms") / 1000}
    out = directions(rows, group, order, values).groupBy(*group).agg(*(F.max(F.when(F.col("metric") == k, F.col("trend"))).alias(f"{k}_trend") for k in values))
    a = rows.groupBy(*group).agg(
        F.count("*").alias("total"), F.avg(F.col("duration_ms") / 1000).alias("avg_duration_sec"), F.avg(F.col("hallucination_rate") * 100).alias("avg_hallucination_pct"), F.avg("action_items_total").alias("avg_action_items"),
        F.avg("code_switches").alias("avg_code_switches"), F.sum((F.col("soft_rejection_risk") == "HIGH").cast("int")).alias("high_n"), F.sum(F.contains("provider", F.lit("mock")).cast("int")).alias("mock_n"),
        F.min("timestamp").alias("first_date"), F.max("timestamp").alias("last_date"),
    )
    place = F.row_number().over(W.partitionBy(*group, "name").orderBy(F.col("n").desc(), "first"))
    top = distributions(rows, group, *order).where(F.col("name").isin("provider", "language")).withColumn("place", place).where("place = 1")
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    top = top.groupBy(*group).agg(of("provider").alias("most_used_provider"), of("language").alias("most_common_language"))
    d = a.withColumn("high_soft_rejection_pct", F.bround(F.coalesce("high_n", F.lit(0)) / F.col("total") * 100, 1)).join(out, group, "left").join(top, group, "left")
    return d.withColumn("soft_rejection_alert", (F.col("soft_rejection_trend") == "up") | (F.col("high_n") >= 2)).withColumn("hallucination_alert", (F.col("avg_hallucination_pct") > 30) | (F.col("hallucination_trend") == "up")).withColumn("mock_alert", F.col("mock_n") / F.col("total") > 0.5)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    """The log rows of every layout, read once and kept as a stage table."""
    return cut(log_rows(spark.read.parquet(f"{folder}/audit_log_lines.parquet").select("stream_id", "file_seq", "line_no", "line")))


def q_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).agg(F.count("*").alias("total"), F.round(F.avg("value"), 4).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors"))


def q_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return distribution(_events(spark, folder), "event_type")


def q_direction(spark: SparkSession, folder: str) -> DataFrame:
    return direction(_events(spark, folder), ["user_id"], ["ts", "event_id"], F.col("value")).select("user_id", "n", "trend")


def q_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


def q_last(spark: SparkSession, folder: str) -> DataFrame:
    """The last 50 rows, as the log's reader takes them."""
    return last(_events(spark, folder), 50, "ts", "event_id").select("event_id", "event_type")


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """df with its doubles to so many places, so that the order of summation doesn't show."""
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def q_audit_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of each deployment's audit log over all its layouts."""
    return _rounded(_audit(spark, folder).groupBy("stream_id").agg(*stats_columns()))


def q_audit_trends(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(trends(_audit(spark, folder), ["stream_id"], ["timestamp", "file_seq", "line_no"]))


def q_audit_series(spark: SparkSession, folder: str) -> DataFrame:
    return series(_audit(spark, folder), ["stream_id"], ["timestamp", "file_seq", "line_no"])


def q_audit_distributions(spark: SparkSession, folder: str) -> DataFrame:
    return distributions(_audit(spark, folder), ["stream_id"])


def q_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of jobs by account and state, with the mean duration."""
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").select("job_id", "account_id", "status", "duration_ms").distinct()
    return j.groupBy("account_id").agg(F.count("*").alias("jobs"), *(F.sum((F.col("status") == s).cast("int")).alias(s) for s in ("queued", "running", "done", "failed")), F.round(F.avg("duration_ms"), 3).alias("avg_ms"))


QUERIES = {"log_stats": q_stats, "log_breakdown": q_breakdown, "trend_direction": q_direction, "daily_distribution": q_daily, "recent_entries": q_last, "audit_log_stats": q_audit_stats, "audit_log_trends": q_audit_trends, "audit_log_series": q_audit_series, "audit_log_distributions": q_audit_distributions, "queue_stats": q_jobs}
_SCORE = "CASE upper(coalesce(soft_rejection_risk, 'NONE')) WHEN 'MINIMAL' THEN 1 WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 4 ELSE 0 END"
_ORDER = "timestamp NULLS FIRST, file_seq NULLS FIRST, line_no NULLS FIRST"
_BACK = "timestamp DESC NULLS LAST, file_seq DESC NULLS LAST, line_no DESC NULLS LAST"
_COUNTED = " UNION ALL ".join(f"SELECT stream_id, timestamp, file_seq, line_no, '{c}' AS name, coalesce({c}, '{none}') AS value FROM r" for c, none in COUNTED)


def _trend_sql(name: str, value: str) -> str:
    return f"""{name} AS (SELECT stream_id, CASE WHEN n < 4 THEN 'stable' WHEN recent > older * 1.15 THEN 'up' WHEN recent < older * 0.85 THEN 'down' ELSE 'stable' END AS trend FROM (SELECT stream_id, n, avg(v) FILTER (WHERE back <= 3) AS recent,
 avg(v) FILTER (WHERE CASE WHEN n >= 6 THEN back BETWEEN 4 AND 6 ELSE fore <= 3 END) AS older FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY {_BACK}, v) AS back, row_number() OVER (PARTITION BY stream_id ORDER BY {_ORDER}, v DESC) AS fore, count(*) OVER (PARTITION BY stream_id) AS n
 FROM (SELECT stream_id, timestamp, file_seq, line_no, CAST({value} AS DOUBLE) AS v FROM r) WHERE v IS NOT NULL) GROUP BY stream_id, n))"""


SQL = {
    "audit_log_stats": f"""SELECT stream_id, count(*) AS total_analyses, round(avg(duration_ms), 4) AS avg_duration_ms, round(min(duration_ms), 4) AS min_duration_ms, round(max(duration_ms), 4) AS max_duration_ms, round(avg(CASE WHEN error IS NULL THEN 0.0 ELSE 1.0 END), 4) AS error_rate,
 round(avg(hallucination_rate), 4) AS avg_hallucination_rate, CAST(sum(CASE WHEN hallucination_risk IN ('HIGH', 'MEDIUM') THEN 1 WHEN hallucination_risk IS NOT NULL THEN 0 END) AS BIGINT) AS high_risk_analyses FROM ({LOG_ROWS_SQL}) GROUP BY stream_id""",
    "audit_log_series": f"""SELECT stream_id, timestamp, file_seq, line_no, row_number() OVER (PARTITION BY stream_id ORDER BY {_ORDER}) AS place, strftime(timestamp, '%m/%d %H:%M') AS label, {_SCORE} AS soft_rejection_score, round_even(coalesce(hallucination_rate, 0) * 100, 1) AS hallucination_pct,
 round_even(coalesce(duration_ms, 0) / 1000, 1) AS duration_sec, coalesce(action_items_total, 0) AS action_items, coalesce(code_switches, 0) AS code_switches, coalesce(speakers_detected, 0) AS speakers FROM ({LOG_ROWS_SQL})""",
    "audit_log_distributions": f"WITH r AS ({LOG_ROWS_SQL}) SELECT stream_id, name, value, count(*) AS n FROM ({_COUNTED}) GROUP BY ALL",
    "audit_log_trends": f"""WITH r AS ({LOG_ROWS_SQL}), {_trend_sql("t1", _SCORE)}, {_trend_sql("t2", "hallucination_rate * 100")}, {_trend_sql("t3", "duration_ms / 1000")},
 a AS (SELECT stream_id, count(*) AS total, avg(duration_ms / 1000) AS avg_duration_sec, avg(hallucination_rate * 100) AS avg_hallucination_pct, avg(action_items_total) AS avg_action_items, avg(code_switches) AS avg_code_switches,
 CAST(sum(CASE WHEN soft_rejection_risk = 'HIGH' THEN 1 WHEN soft_rejection_risk IS NOT NULL THEN 0 END) AS BIGINT) AS high_n, CAST(sum(CASE WHEN contains(provider, 'mock') THEN 1 WHEN provider IS NOT NULL THEN 0 END) AS BIGINT) AS mock_n, min(timestamp) AS first_date, max(timestamp) AS last_date FROM r GROUP BY stream_id),
 d AS (SELECT stream_id, name, value, count(*) AS n, min((timestamp, file_seq, line_no)) AS first FROM ({_COUNTED}) WHERE name IN ('provider', 'language') GROUP BY ALL),
 top AS (SELECT stream_id, max(CASE WHEN name = 'provider' THEN value END) AS most_used_provider, max(CASE WHEN name = 'language' THEN value END) AS most_common_language FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, name ORDER BY n DESC, first) AS p FROM d) WHERE p = 1 GROUP BY stream_id)
 SELECT stream_id, total, round(avg_duration_sec, 4) AS avg_duration_sec, round(avg_hallucination_pct, 4) AS avg_hallucination_pct, round(avg_action_items, 4) AS avg_action_items, round(avg_code_switches, 4) AS avg_code_switches, high_n, mock_n, first_date, last_date,
 round(round_even(coalesce(high_n, 0) * 100.0 / total, 1), 4) AS high_soft_rejection_pct, t1.trend AS soft_rejection_trend, t2.trend AS hallucination_trend, t3.trend AS duration_trend, most_used_provider, most_common_language,
 t1.trend = 'up' OR high_n >= 2 AS soft_rejection_alert, avg_hallucination_pct > 30 OR t2.trend = 'up' AS hallucination_alert, mock_n / total > 0.5 AS mock_alert
 FROM a LEFT JOIN t1 USING (stream_id) LEFT JOIN t2 USING (stream_id) LEFT JOIN t3 USING (stream_id) LEFT JOIN top USING (stream_id)""",
    "log_stats": "SELECT count(*) AS total, round(avg(value), 4) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events",
    "log_breakdown": "SELECT coalesce(event_type, 'unknown') AS value, count(*) AS n FROM events GROUP BY 1",
    "trend_direction": """SELECT user_id, n, CASE WHEN n < 4 THEN 'stable' WHEN recent > older * 1.15 THEN 'up' WHEN recent < older * 0.85 THEN 'down' ELSE 'stable' END AS trend FROM (SELECT user_id, n, avg(value) FILTER (WHERE back <= 3) AS recent,
 avg(value) FILTER (WHERE CASE WHEN n >= 6 THEN back BETWEEN 4 AND 6 ELSE fore <= 3 END) AS older FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fore,
 count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL) GROUP BY user_id, n)""",
    "daily_distribution": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "recent_entries": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "queue_stats": """SELECT account_id, count(*) AS jobs, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed,
 round(avg(duration_ms), 3) AS avg_ms FROM (SELECT DISTINCT job_id, account_id, status, duration_ms FROM analysis_jobs) GROUP BY 1""",
}
