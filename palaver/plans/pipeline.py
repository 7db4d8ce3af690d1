"""The whole analysis as one plan: one row per meeting, nothing lost where a stage has nothing to say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators import dynamics, grounding, people, privacy, results, signals, texts
from ..sources.seed import MEETINGS, meetings, rows
from ..sources.seed import text as lit
from ..stage import cut


def analyze(m: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """meeting_id with language, counts of personal data, risk, verdict, register, code switches, turns, structural events, talk time, grounding, status and health.

    m has meeting_id and transcript, one row a meeting. answers (meeting_id, raw_json) are model answers to the masked text; their placeholders
    are put back. Without one a meeting gets the stand-in extraction. Names are unified and talk time is taken from the clock before the claims
    are held against the transcript. Scans and grounding are within the row; turns, hints, events, weights and names are one shuffle by meeting
    each, joined to the meetings from the left.
    """
    c = m.withColumn("transcript", text.joined_labels(text.clean(F.col("transcript"))))
    if answers is None:
        c = cut(c.withColumn("s", results.stand_in(F.col("transcript"))).withColumn("r", results.filled("s")).drop("s"))
    else:
        c = cut(c)
        a = answers.join(c, "meeting_id").withColumn("m", privacy.mask("transcript")["mapping"])
        a = a.select("meeting_id", results.parse(privacy.restore_json("raw_json", "m")).alias("a"))
        c = c.join(a, "meeting_id", "left").withColumn("s", results.stand_in(F.col("transcript")))
        c = cut(c.withColumn("r", F.when(F.col("a").isNotNull(), results.filled("a")).otherwise(results.filled("s"))).drop("a", "s"))
    base = privacy.counts(signals.outcome(c)).withColumn("language", text.language(F.col("transcript"))).withColumn("keigo", text.keigo(F.col("transcript"))).withColumn("code_switches", text.code_switches(F.col("transcript")))
    r = F.col("r")
    weights = dynamics.talk_weights(c).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "weight"))).alias("weights"))
    said = c.select("meeting_id", F.explode(people.result_names(r)).alias("name"))
    known = cut(people.speakers(c))
    names = people.best_match(said, known).groupBy("meeting_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "matched"))).alias("names"))
    base = base.join(weights, "meeting_id", "left").join(names, "meeting_id", "left")
    base = base.withColumn("r", r.withField("speakers", dynamics.weighed(r["speakers"], F.coalesce("weights", F.array().cast("array<struct<pos:int,name:string,weight:double>>"))))).withColumn("r", people.unified(r, F.coalesce("names", F.create_map().cast("map<string,string>"))))
    base = base.withColumn("v", grounding.verify(r, F.col("transcript"))).withColumn("items", F.zip_with("r.action_items", "v.task_low", lambda i, low: F.struct(i["owner"].alias("owner"), i["deadline"].alias("deadline"), (low & ~grounding.rescued(i["task"], F.col("transcript"))).alias("flag"))))
    base = base.withColumn("hallucination_risk", F.bround(F.col("v.flagged_total") / F.greatest("v.total_claims", F.lit(1)), 3)).drop("weights", "names")
    # Read by several stages each, so written once.
    t = cut(dynamics.turns(c))
    hints = cut(people.hints_of(known))
    n = t.groupBy("meeting_id").agg(F.count("*").alias("turns"), F.countDistinct("speaker").alias("speakers"))
    events = dynamics.topic_stalls(t).select("meeting_id").union(dynamics.senior_silence(t, hints).select("meeting_id")).groupBy("meeting_id").agg(F.count("*").alias("events"))
    close = dynamics.closing_summarizer(t, hints).select("meeting_id", F.col("speaker").alias("closing_speaker"))
    d = base.join(n, "meeting_id", "left").join(events, "meeting_id", "left").join(close, "meeting_id", "left").na.fill(0, ["turns", "speakers", "events"])
    d = d.withColumn("status_flag", results.status(F.col("risk_level"), F.col("events"), strict=True))
    d = d.withColumn("sentiment", F.transform("r.sentiment", lambda s: s["score"]))
    d = results.health(d.withColumn("terminated", F.col("termination_n") > 0).withColumn("gate", F.col("gate_n") > 0))
    return d.select(
        "meeting_id", "language", "emails", "jp_phones", "intl_phones", "risk_level", "verdict", "total_signals", "keigo", "code_switches", "turns", "speakers", "events", "closing_speaker", "status_flag", "health_score", "health_label",
        F.col("r.meeting_title").alias("meeting_title"), "hallucination_risk", F.when(F.col("transcript") != "", grounding.risk_label(F.col("hallucination_risk"))).otherwise("UNKNOWN").alias("risk_label"),
        F.size(F.filter("items", lambda i: i["flag"])).alias("actions_flagged"), F.transform("r.speakers", lambda s: F.struct(s["name"].alias("name"), s["talk_time_pct"].alias("talk_time_pct"))).alias("talk_time"),
    )


def q_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of every request and of the seed, without model answers; shares of talk time as text."""
    shares = F.array_join(F.transform("talk_time", lambda x: F.concat_ws(":", x["name"], x["talk_time_pct"].cast("string"))), "|")
    return analyze(meetings(spark, folder)).withColumn("talk_time", shares)


QUERIES = {"meeting_reports": q_reports}


def _sql() -> str:
    """The whole plan in SQL, of the queries of its stages over the cleaned meetings."""
    over = lambda q: q.replace(MEETINGS, "cm")
    strip = texts._strip
    lines = f"array_to_string(list_transform(string_split(regexp_replace(regexp_replace(nfc_normalize(transcript), '\\r\\n?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: {strip('x')}), chr(10))"
    joined = f"regexp_replace({strip(lines)}, '(?m)^([A-Za-z][A-Za-z\\s.''\\-]{{1,38}}?)\\s*:\\s*\\n([ \\t]*[^\\s])', '\\1: \\2', 'g')"
    label = "'(?m)(?:^|\\n)\\s*([A-Za-z][A-Za-z\\s.'']{1,35}?)\\s*[:：]'"
    task, bullet = "No action items without a model answer.", "No model answer."
    tok, source = grounding._tok, grounding._SRC.replace("(SELECT request_id AS meeting_id, min(transcript) AS transcript FROM analyze_requests WHERE transcript IS NOT NULL GROUP BY 1)", "cm")
    low = f"CASE WHEN transcript = '' THEN FALSE ELSE {grounding._score('claim')} < least END"
    scan = lambda q: f"({over(q)})"
    word = grounding._wl
    return f"""WITH cm AS (SELECT meeting_id, {joined} AS transcript FROM {MEETINGS}), {source}, {over(dynamics.WEIGHTS_SQL)},
 g0 AS (SELECT meeting_id, transcript, len({texts._WORDS}) AS words, list_transform(regexp_extract_all(transcript, {label}, 1), lambda x: {people.strip_sql("x")}) AS raw FROM cm),
 g1 AS (SELECT *, list_filter(list_distinct(raw), lambda x: length(x) >= 2 AND lower(x) NOT IN ('http', 'https', 'view', 'sorry', 'would', 'could')) AS g FROM g0),
 g2 AS (SELECT meeting_id, transcript, words, CASE WHEN len(g) > 0 THEN list_transform(list_sort(list_transform(g, lambda x: struct_pack(at := list_position(raw, x), name := x))), lambda x: x.name) ELSE ['Speaker A', 'Speaker B'] END AS names FROM g1),
 sp AS (SELECT meeting_id, unnest(names) AS name, generate_subscripts(names, 1) AS pos, round_even(100.0 / len(names), 0) AS p, len(names) AS cnt FROM g2),
 sp2 AS (SELECT *, CAST(CASE WHEN p * cnt = 100 THEN p ELSE round_even(p * 100 / (p * cnt), 0) END AS INT) AS pct FROM sp),
 sn AS (SELECT * FROM {rows(lexicon.SURNAMES, 'v(roman, kanji)')}), kn AS ({people.speakers_sql("cm")}), nn AS (SELECT DISTINCT meeting_id, name, {people.name_sql("name")} AS n FROM sp),
 nh AS (SELECT nn.*, kn.speaker, kn.first_pos, CASE WHEN kn.speaker IS NULL OR n = '' THEN NULL WHEN n = kn.speaker THEN 1 WHEN lower(n) = lower(kn.speaker) THEN 2 WHEN (SELECT max(kanji) FROM sn WHERE roman = lower(n)) = kn.speaker THEN 3
 WHEN (SELECT max(roman) FROM sn WHERE kanji = n) = lower(kn.speaker) THEN 3 WHEN contains(kn.speaker, n) OR contains(n, kn.speaker) THEN 4 END AS how FROM nn LEFT JOIN kn USING (meeting_id)),
 nm AS (SELECT meeting_id, name, coalesce(arg_min(speaker, (how, first_pos, speaker)) FILTER (WHERE how IS NOT NULL), n) AS matched FROM nh GROUP BY meeting_id, name, n),
 wt AS (SELECT sp2.meeting_id, sp2.name, sp2.pos, sp2.pct, coalesce(arg_min(CAST(w.weight AS DOUBLE), w.pos), 0) AS wgt FROM sp2 LEFT JOIN w ON w.meeting_id = sp2.meeting_id AND (list_contains(list_filter(regexp_split_to_array(lower(w.name), '{texts._BLANK}+'), lambda x: x <> ''), lower(sp2.name)) OR lower(w.name) = lower(sp2.name)) GROUP BY ALL),
 wp AS (SELECT *, sum(wgt) OVER (PARTITION BY meeting_id) AS total FROM wt), wq AS (SELECT *, CASE WHEN total > 0 THEN CAST(round_even(wgt * 100 / total, 0) AS INT) ELSE pct END AS pp FROM wp),
 wr AS (SELECT meeting_id, name, pos, pp + CASE WHEN total > 0 AND pos = 1 THEN 100 - sum(pp) OVER (PARTITION BY meeting_id) ELSE 0 END AS pp FROM wq),
 tt AS (SELECT meeting_id, string_agg(matched || ':' || CAST(s AS INT), '|' ORDER BY pos) AS talk_time FROM (SELECT meeting_id, matched, min(pos) AS pos, sum(pp) AS s FROM wr JOIN nm USING (meeting_id, name) GROUP BY 1, 2) GROUP BY 1),
 cl AS (SELECT meeting_id, transcript, 'task' AS kind, {lit(task)} AS claim, 200 AS least, 1 AS times FROM g2 UNION ALL SELECT meeting_id, transcript, 'b', 'Transcript: ' || words || ' words', 150, 1 FROM g2
 UNION ALL SELECT meeting_id, transcript, 'b', {lit(bullet)}, 150, CASE WHEN words < 200 THEN 2 WHEN words < 600 THEN 4 ELSE 6 END FROM g2 UNION ALL SELECT g2.meeting_id, transcript, 's', matched, 50, 1 FROM g2 JOIN sp USING (meeting_id) JOIN nm USING (meeting_id, name)),
 cs AS (SELECT cl.*, source, {tok("claim")} AS t_claim FROM cl LEFT JOIN src USING (meeting_id)), cf AS (SELECT meeting_id, kind, times, {low} AS low FROM cs),
 cr AS (SELECT meeting_id, sum(CASE WHEN low THEN times ELSE 0 END) AS flagged, sum(times) AS total, bool_or(kind = 'task' AND low) AS task_low FROM cf GROUP BY 1),
 rs AS (SELECT meeting_id, bool_or(len(y) > 0 AND len(list_intersect({word(lit(task))}, y)) / greatest(len({word(lit(task))}), len(y)) >= 0.35) AS saved FROM (SELECT meeting_id, {word("s")} AS y FROM (SELECT meeting_id, unnest(regexp_split_to_array(transcript, '[.!?。！？\n]+')) AS s FROM cm)) GROUP BY 1),
 ev AS (SELECT meeting_id, count(*) AS events FROM (SELECT meeting_id FROM {scan(dynamics.SQL["topic_stalls"])} UNION ALL SELECT meeting_id FROM {scan(dynamics.SQL["senior_silence"])}) GROUP BY 1),
 a AS (SELECT g2.meeting_id, g2.transcript, ln.language, pc.emails, pc.jp_phones, pc.intl_phones, v.risk_level, v.verdict, v.total_signals, kg.keigo, sw.switches AS code_switches, coalesce(tp.turns, 0) AS turns, coalesce(tp.speakers, 0) AS speakers, coalesce(ev.events, 0) AS events, cz.speaker AS closing_speaker,
 'Demo Analysis — ' || len(names) || CASE WHEN len(names) > 1 THEN ' Speakers' ELSE ' Speaker' END AS meeting_title, round_even(cr.flagged * 1.0 / cr.total, 3) AS hallucination_risk, CASE WHEN cr.task_low AND NOT coalesce(rs.saved, FALSE) THEN 1 ELSE 0 END AS actions_flagged, tt.talk_time,
 (SELECT matched FROM nm WHERE nm.meeting_id = g2.meeting_id AND nm.name = names[1]) AS owner FROM g2 JOIN {scan(texts.SQL["language_detect"])} ln USING (meeting_id) JOIN {scan(privacy.SQL["pii_counts"])} pc USING (meeting_id) JOIN {scan(signals.SQL["meeting_verdict"])} v USING (meeting_id)
 JOIN {scan(texts.SQL["keigo_levels"])} kg USING (meeting_id) JOIN {scan(texts.SQL["code_switches"])} sw USING (meeting_id) LEFT JOIN {scan(dynamics.SQL["turns_parsed"])} tp USING (meeting_id) LEFT JOIN ev USING (meeting_id)
 LEFT JOIN {scan(dynamics.SQL["closing_summarizer"])} cz USING (meeting_id) JOIN cr USING (meeting_id) LEFT JOIN rs USING (meeting_id) LEFT JOIN tt USING (meeting_id)),
 h AS (SELECT *, 18 + CASE WHEN actions_flagged = 0 AND owner NOT IN ('TBD', 'Unknown', '') THEN 12 ELSE 0 END + CASE risk_level WHEN 'NONE' THEN 25 WHEN 'MINIMAL' THEN 20 WHEN 'LOW' THEN 15 WHEN 'MEDIUM' THEN 8 ELSE 0 END + round_even((1 - hallucination_risk) * 20, 0) AS s FROM a)
 SELECT * EXCLUDE (s, transcript, owner), CASE WHEN transcript = '' THEN 'UNKNOWN' WHEN hallucination_risk < 0.15 THEN 'LOW' WHEN hallucination_risk < 0.35 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_label,
 CASE WHEN risk_level IN ('HIGH', 'CRITICAL') THEN 'ESCALATE' WHEN risk_level IN ('MEDIUM', 'LOW') OR events >= 1 THEN 'WATCH' ELSE 'ON_TRACK' END AS status_flag, CAST(CASE WHEN verdict = 'REJECTED' THEN least(s, 22) ELSE s END AS INT) AS health_score,
 CASE WHEN verdict = 'REJECTED' THEN 'Contract Terminated' WHEN s >= 80 THEN 'Productive Meeting' WHEN s >= 60 THEN 'Mostly Aligned' WHEN s >= 40 THEN 'Needs Follow-up' ELSE 'High Risk' END AS health_label FROM h"""


SQL = {"meeting_reports": _sql()}
