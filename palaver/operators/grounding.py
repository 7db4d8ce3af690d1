"""Whether claims stand on their transcript: token overlap, flags, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import JA, ja_tokens, list_overlap, word_list
from ..sources.seed import text as lit

#: Under these overlaps a claim is flagged.
TASK, BULLET, SPEAKER = 0.20, 0.15, 0.05


def _content(c: Column) -> Column:
    return F.array_except(F.array_distinct(ja_tokens(c)), F.array(*map(F.lit, lexicon.GROUNDING_STOPS)))


# A run is taken from its first character only and never given back, so a long line without a colon is read once.
_NAMES = r"(?U)(?<![^\s\[\]:：])([^\s\[\]:：]++)\s*[:：]"
_STOPS_LATIN = "|".join(w for w in lexicon.GROUNDING_STOPS if w.isascii())
_STOPS_JA = "".join(w for w in lexicon.GROUNDING_STOPS if len(w) == 1 and not w.isascii())


def source(c: Column) -> Column:
    """A transcript, and the words before its colons, made ready for overlap: `latin`, its words in lower case between blanks, `ja`, its Japanese characters, and whether there is `any` token but stop words.

    A token stands in the transcript just if it stands between blanks in the one or within the other, so no list of tokens is built or shuffled.
    """
    names = F.filter(F.regexp_extract_all(c, F.lit(_NAMES)), lambda n: ~n.rlike(r"^\d+$"))
    low = F.lower(F.concat_ws(" ", c, F.array_join(names, " ")))
    latin, ja = F.concat(F.lit(" "), F.regexp_replace(low, rf"(?U)[{JA}\s]+", " "), F.lit(" ")), F.regexp_replace(low, f"[^{JA}]+", "")
    # Two Japanese characters make a pair, and no pair of stop words of one character is a stop word.
    some = latin.rlike(f" (?!(?:{_STOPS_LATIN}) )[^ ]") | (F.length(ja) >= 2) | ja.rlike(f"[^{_STOPS_JA}]")
    return F.when(c.isNotNull(), F.struct(latin.alias("latin"), ja.alias("ja"), some.alias("any")))


def overlap(claim: Column, src: Column) -> Column:
    """Share of the claim's tokens in the source, to three places. 0 for an empty claim or source, .5 where only stop words are claimed."""
    held = lambda t: F.contains(src["ja"], t) | F.contains(src["latin"], F.concat(F.lit(" "), t, F.lit(" ")))
    # An array of one, so that the claim's tokens are made once.
    share = F.transform(F.array(_content(claim)), lambda a: F.when(F.size(a) == 0, 0.5).otherwise(F.bround(F.size(F.filter(a, held)) / F.size(a), 3)))[0]
    return F.when(claim.isNull() | (claim == "") | src.isNull() | ~src["any"], 0.0).otherwise(share)


def sources(meetings: DataFrame) -> DataFrame:
    """meeting_id, source: once per meeting, before the join with its claims."""
    return meetings.select("meeting_id", source(F.col("transcript")).alias("source"))


def verify_actions(items: DataFrame, meetings: DataFrame) -> DataFrame:
    """items (meeting_id, item_id, task, owner, deadline) with scores, confidence and hallucination_flag. Items whose meeting is unknown score 0 but for a missing deadline, which counts 1."""
    j = items.join(sources(meetings), "meeting_id", "left")
    none = F.lower(F.coalesce("deadline", F.lit(""))).isin("not specified", "tbd", "—", "")
    src = F.col("source")
    j = j.withColumn("task_score", overlap(F.col("task"), src)).withColumn("owner_score", overlap(F.col("owner"), src)).withColumn("deadline_score", F.when(none, 1.0).otherwise(overlap(F.col("deadline"), src)))
    j = j.withColumn("confidence", F.bround(0.6 * F.col("task_score") + 0.3 * F.col("owner_score") + 0.1 * F.col("deadline_score"), 3))
    return j.withColumn("hallucination_flag", F.col("task_score") < TASK).drop("source")


def verify_claims(claims: DataFrame, meetings: DataFrame, least: float | None = BULLET) -> DataFrame:
    """claims (meeting_id, claim_id, claim) with grounding_score and hallucination_flag: summary bullets, or speakers with least=SPEAKER. With least=None each claim's own column `least` holds."""
    j = claims.join(sources(meetings), "meeting_id", "left").withColumn("grounding_score", overlap(F.col("claim"), F.col("source")))
    return j.withColumn("hallucination_flag", F.col("grounding_score") < (F.col("least") if least is None else F.lit(least))).drop("source")


def risk(*checked: DataFrame) -> DataFrame:
    """meeting_id, total_claims, flagged_total, overall_hallucination_risk, risk_label over any number of checked claims."""
    every = None
    for c in checked:
        d = c.select("meeting_id", F.col("hallucination_flag").cast("int").alias("f"))
        every = d if every is None else every.union(d)
    g = every.groupBy("meeting_id").agg(F.count("*").alias("total_claims"), F.sum("f").alias("flagged_total"))
    r = F.bround(F.col("flagged_total") / F.col("total_claims"), 3)
    return g.withColumn("overall_hallucination_risk", r).withColumn("risk_label", F.when(r < 0.15, "LOW").when(r < 0.35, "MEDIUM").otherwise("HIGH"))


def risk_label(r: Column) -> Column:
    return F.when(r < 0.15, "LOW").when(r < 0.35, "MEDIUM").when(r.isNotNull(), "HIGH")


def verify(r: Column, transcript: Column) -> Column:
    """Struct of task_low (by action item), flagged_total, total_claims of a result struct over its own transcript: verify_actions and verify_claims within the row, for action items, bullets and the speakers of the moods. An empty transcript flags nothing."""
    low = lambda claims, least: lambda source: F.transform(claims, lambda c: (transcript != "") & (overlap(c, source) < least))
    tasks, points, moods = low(F.transform(r["action_items"], lambda i: i["task"]), TASK), low(r["summary"], BULLET), low(F.transform(r["sentiment"], lambda i: i["speaker"]), SPEAKER)
    # An array of one, so that the transcript is made ready once.
    f = F.transform(F.array(source(F.coalesce(transcript, F.lit("")))), lambda s: F.struct(tasks(s).alias("tasks"), points(s).alias("points"), moods(s).alias("moods")))
    yes = lambda a: F.size(F.filter(a, lambda x: x))
    return F.transform(f, lambda x: F.struct(x["tasks"].alias("task_low"), (yes(x["tasks"]) + yes(x["points"]) + yes(x["moods"])).alias("flagged_total"), (F.size(x["tasks"]) + F.size(x["points"]) + F.size(x["moods"])).alias("total_claims")))[0]


def rescued(task: Column, transcript: Column, least: float = 0.35) -> Column:
    """Whether a sentence of the transcript is so like the task that its flag is cleared: rescue within the row. An empty task and one that begins with a warning sign aren't looked at."""
    sentences = F.transform(F.split(transcript, "[.!?。！？\\n]+"), word_list)
    # Too few of the task's words anywhere in the transcript: no sentence can be like it, and none is taken apart.
    enough = lambda x, low: F.size(F.filter(x, lambda w: F.contains(low, w))) >= least * F.size(x)
    # An array of one, so that the task's words are made once.
    bound = F.array(F.struct(word_list(task).alias("x"), F.lower(transcript).alias("low")))
    like = F.exists(bound, lambda b: enough(b["x"], b["low"]) & F.exists(sentences, lambda y: list_overlap(b["x"], y) >= least))
    return (F.coalesce(task, F.lit("")) != "") & ~task.startswith("⚠️") & like


def rescue(items: DataFrame, meetings: DataFrame, least: float = 0.35) -> DataFrame:
    """Flagged items (meeting_id, item_id, task) with the best similarity to a sentence of the meeting; from `least` on the flag is cleared. Similarity is word overlap where no embedding is supplied.

    An item meets its meeting's sentences within one row, so no pairs are shuffled. Without a meeting, a task or a sentence the similarity is 0.
    """
    s = meetings.select("meeting_id", F.transform(F.filter(F.split("transcript", "[.!?。！？\\n]+"), lambda x: F.trim(x) != ""), word_list).alias("sentences"))
    like = F.array_max(F.flatten(F.transform(F.array(word_list(F.col("task"))), lambda x: F.transform("sentences", lambda y: list_overlap(x, y)))))
    j = items.join(s, "meeting_id", "left").select("meeting_id", "item_id", F.coalesce(like, F.lit(0.0)).alias("sim"))
    g = j.groupBy("meeting_id", "item_id").agg(F.max("sim").alias("semantic_grounding"))
    return g.withColumn("rescued", F.col("semantic_grounding") >= least)


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with a transcript, the least of several."""
    r = spark.read.parquet(f"{folder}/analyze_requests.parquet").where("transcript IS NOT NULL").select(F.col("request_id").alias("meeting_id"), "transcript")
    return r.groupBy("meeting_id").agg(F.min("transcript").alias("transcript"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/action_items.parquet").where("request_id IS NOT NULL").select(F.col("request_id").alias("meeting_id"), "item_id", "task", "owner", "deadline").distinct()


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    """meeting_id, claim, least: tasks, commitments and speakers as claims, each with its limit."""
    a = _items(spark, folder).select("meeting_id", F.col("task").alias("claim"), F.lit(TASK).alias("least"))
    for table, column, least in (("commitment_items", "text", BULLET), ("said_vs_meant_items", "speaker", SPEAKER)):
        d = spark.read.parquet(f"{folder}/{table}.parquet").where("request_id IS NOT NULL").select("request_id", "item_id", column).distinct()
        a = a.union(d.select(F.col("request_id").alias("meeting_id"), F.col(column).alias("claim"), F.lit(least).alias("least")))
    return a


def q_actions(spark: SparkSession, folder: str) -> DataFrame:
    v = verify_actions(_items(spark, folder), _requests(spark, folder))
    return v.select("meeting_id", "item_id", "hallucination_flag", *((F.round(F.col(c) * 1000)).cast("int").alias(c) for c in ("task_score", "owner_score", "deadline_score")))


def q_risk(spark: SparkSession, folder: str) -> DataFrame:
    """Risk of every request from its tasks, commitments and speakers, which meet its transcript in one join."""
    r = risk(verify_claims(_claims(spark, folder), _requests(spark, folder), None))
    return r.select("meeting_id", "total_claims", "flagged_total", "risk_label")


def q_rescue(spark: SparkSession, folder: str) -> DataFrame:
    m = _requests(spark, folder)
    flagged = verify_actions(_items(spark, folder), m).where("hallucination_flag")
    return rescue(flagged.select("meeting_id", "item_id", "task"), m).groupBy("rescued").agg(F.count("*").alias("items"))


_JC = "[\\x{3040}-\\x{309f}\\x{30a0}-\\x{30ff}\\x{4e00}-\\x{9fff}]"
_WS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_NOT = "(" + ", ".join(map(lit, lexicon.GROUNDING_STOPS)) + ")"


def _tok(c: str) -> str:
    cjk = f"regexp_extract_all(lower({c}), '{_JC}')"
    return f"""list_filter(list_distinct(list_concat(list_concat({cjk}, regexp_split_to_array(regexp_replace(lower({c}), '{_JC}', ' ', 'g'), '{_WS}+')), list_transform(range(1, len({cjk})), lambda i: {cjk}[i] || {cjk}[i + 1]))), lambda w: w <> '' AND w NOT IN {_NOT})"""


def _score(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' OR source IS NULL THEN 0 WHEN len(t_{c}) = 0 THEN 500 ELSE CAST(round_even(len(list_filter(t_{c}, lambda w: list_contains(source, w))) * 1000.0 / len(t_{c}), 0) AS INT) END"


_SRC = f"""src AS (SELECT meeting_id, {_tok("full_text")} AS source FROM (SELECT meeting_id, transcript || ' ' || array_to_string(list_filter(regexp_extract_all(transcript, '([^\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\[\\]:：]+){_WS}*[:：]', 1), lambda n: NOT regexp_matches(n, '^[0-9]+$')), ' ') AS full_text
  FROM (SELECT request_id AS meeting_id, min(transcript) AS transcript FROM analyze_requests WHERE transcript IS NOT NULL GROUP BY 1)))"""
_IT = "it AS (SELECT DISTINCT request_id AS meeting_id, item_id, task, owner, deadline FROM action_items WHERE request_id IS NOT NULL)"
_W = "[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}]+"
_wl = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '{_W}'))"
#: total_claims, flagged_total of every request; also for the health of a request.
RISK_SQL = f"""WITH {_SRC}, {_IT}, cl AS (SELECT meeting_id, task AS claim, 200 AS least FROM it UNION ALL SELECT meeting_id, claim, 150 FROM (SELECT DISTINCT request_id AS meeting_id, item_id, text AS claim FROM commitment_items WHERE request_id IS NOT NULL)
 UNION ALL SELECT meeting_id, claim, 50 FROM (SELECT DISTINCT request_id AS meeting_id, item_id, speaker AS claim FROM said_vs_meant_items WHERE request_id IS NOT NULL)),
 j AS (SELECT cl.*, source, {_tok("claim")} AS t_claim FROM cl LEFT JOIN src USING (meeting_id))
 SELECT meeting_id, count(*) AS total_claims, count(*) FILTER (WHERE {_score("claim")} < least) AS flagged_total FROM j GROUP BY meeting_id"""
QUERIES = {"claim_grounding": q_actions, "hallucination_risk": q_risk, "semantic_rescue": q_rescue}
SQL = {
    "claim_grounding": f"""WITH {_SRC}, {_IT}, j AS (SELECT it.*, src.source, {_tok("task")} AS t_task, {_tok("owner")} AS t_owner, {_tok("deadline")} AS t_deadline FROM it LEFT JOIN src USING (meeting_id))
 SELECT meeting_id, item_id, {_score("task")} < 200 AS hallucination_flag, {_score("task")} AS task_score, {_score("owner")} AS owner_score, CASE WHEN lower(coalesce(deadline, '')) IN ('not specified', 'tbd', '—', '') THEN 1000 ELSE {_score("deadline")} END AS deadline_score FROM j""",
    "hallucination_risk": f"SELECT * EXCLUDE (r), CASE WHEN r < 0.15 THEN 'LOW' WHEN r < 0.35 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_label FROM (SELECT *, round_even(flagged_total * 1.0 / total_claims, 3) AS r FROM ({RISK_SQL}))",
    "semantic_rescue": f"""WITH {_SRC}, {_IT}, j AS (SELECT it.*, source, {_tok("task")} AS t_task FROM it LEFT JOIN src USING (meeting_id)), f AS (SELECT meeting_id, item_id, {_wl("task")} AS x FROM j WHERE {_score("task")} < 200),
 s AS (SELECT meeting_id, {_wl("s")} AS y FROM (SELECT meeting_id, unnest(regexp_split_to_array(transcript, '[.!?。！？\n]+')) AS s FROM (SELECT request_id AS meeting_id, min(transcript) AS transcript FROM analyze_requests WHERE transcript IS NOT NULL GROUP BY 1))),
 b AS (SELECT f.meeting_id, f.item_id, coalesce(max(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / greatest(len(x), len(y)) END), 0) >= 0.35 AS rescued FROM f LEFT JOIN s USING (meeting_id) GROUP BY 1, 2)
 SELECT rescued, count(*) AS items FROM b GROUP BY rescued""",
}
