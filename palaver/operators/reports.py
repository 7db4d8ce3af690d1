"""Results as text, tables and plans: notes, minutes, cultural report, slide plan, export bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bullets
from ..sources.seed import text as lit
from ..stage import cut
from . import dynamics, people, signals
from .people import role, role_sql
from .results import top_signals


# The customary words of minutes where something is missing, and the heads of its parts.
NO_NAME, NO_PEOPLE, NO_TOPIC, NO_DECISION, NO_ACTION, NO_DATE = "会議議事録", "出席者情報なし / Not identified", "議題情報なし / Agenda not extracted", "明示的な決定事項なし / No explicit decisions recorded", "アクションアイテムなし / No action items recorded", "未定"
HEADS = ("## 出席者", "## 議題", "## 決定事項", "## アクションアイテム")
#: Items of one kind on a page of a report; a meeting has as many pages as its items need.
SHOWN = 200


def _lines(*parts: Column) -> Column:
    """The parts that aren't null, one below the other."""
    return F.concat_ws("\n", *parts)


def _section(head: str, rule: str, body: Column, show: Column) -> Column:
    return F.when(show, F.concat_ws("\n", F.lit(head), F.lit(rule), body, F.lit("")))


def _or(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def text_notes(r: str) -> Column:
    """A result struct (summary, action_items with flag, sentiment, speakers) as plain text."""
    c = F.col(r)
    acts = F.transform(c["action_items"], lambda i: F.concat(F.lit("- "), _or(i["task"], ""), F.when(i["flag"], " [FLAGGED]").otherwise(""), F.lit("\n    Owner: "), _or(i["owner"], "TBD"), F.lit("   Deadline: "), _or(i["deadline"], "TBD")))
    mood = F.transform(c["sentiment"], lambda s: F.concat(F.lit("- "), _or(s["speaker"], ""), F.lit(": "), F.upper(_or(s["score"], ""))))
    who = F.transform(c["speakers"], lambda s: F.concat(F.lit("- "), _or(s["name"], ""), F.lit(": "), _or(s["talk_time_pct"].cast("string"), "0"), F.lit("% ("), _or(s["tone"], ""), F.lit(")")))
    points = F.transform(c["summary"], lambda b, i: F.concat((i + 1).cast("string"), F.lit(". "), b))
    rule = "-" * 20
    return _lines(
        F.lit("MEETING ANALYSIS"), F.lit("=" * 40), F.lit(""), _section("OVERVIEW", rule, c["full_summary"], _or(c["full_summary"], "") != ""), _section("KEY POINTS", rule, F.array_join(points, "\n"), F.size(c["summary"]) > 0),
        _section("ACTION ITEMS", rule, F.array_join(acts, "\n"), F.size(c["action_items"]) > 0), _section("SENTIMENT", rule, F.array_join(mood, "\n"), F.size(c["sentiment"]) > 0), _section("SPEAKERS", rule, F.array_join(who, "\n"), F.size(c["speakers"]) > 0),
    )


def markdown_notes(r: str) -> Column:
    c = F.col(r)
    acts = F.transform(c["action_items"], lambda i: F.concat(F.lit("- **"), _or(i["task"], ""), F.lit("**"), F.when(i["flag"], " ⚠").otherwise(""), F.lit("  \n  Owner: "), _or(i["owner"], "TBD"), F.lit("  Deadline: "), _or(i["deadline"], "TBD"), F.lit("\n")))
    points = F.array_join(F.transform(c["summary"], lambda b: F.concat(F.lit("- "), b, F.lit("\n"))), "")
    return F.concat(
        F.lit("# Meeting Analysis\n"), F.when(_or(c["full_summary"], "") != "", F.concat(F.lit("## Overview\n"), c["full_summary"], F.lit("\n"))).otherwise(""), F.when(F.size(c["summary"]) > 0, F.concat(F.lit("## Key Points\n"), points)).otherwise(""),
        F.when(F.size(c["action_items"]) > 0, F.concat(F.lit("\n## Action Items\n"), F.array_join(acts, ""))).otherwise(""),
    )


def export_bundle(meta: Column, transcript: Column, analysis: Column) -> Column:
    """The JSON bundle of metadata, transcript and analysis."""
    return F.to_json(F.struct(meta.alias("metadata"), transcript.alias("transcript"), analysis.alias("analysis")))


def export_filename(lang: Column, at: Column) -> Column:
    return F.format_string("transcript_analysis_%s_%s.json", lang, F.date_format(at, "yyyyMMdd_HHmmss"))


def approval_chain(hints: DataFrame) -> DataFrame:
    """meeting_id, chain: speakers with a rank, the highest first."""
    g = hints.where("rank > 0").groupBy("meeting_id").agg(F.collect_list(F.struct((-F.col("rank")).alias("r"), "speaker", "role")).alias("c"))
    return g.select("meeting_id", F.transform(F.array_sort("c"), lambda x: F.struct(x["speaker"].alias("approver"), x["role"].alias("role"))).alias("chain"))


def minutes(c: str, at: Column, more_decisions: Column | None = None, more_actions: Column | None = None) -> Column:
    """A result struct as a plan of formal minutes; what is missing gets the customary words, unless another page has it. at replaces the clock."""
    here = lambda more, words: words if more is None else F.when(more, F.slice(words, 1, 0)).otherwise(words)
    r = F.col(c)
    who = F.transform(r["speakers"], lambda s: F.concat(_or(s["name"], "不明"), F.when(s["talk_time_pct"] > 0, F.concat(F.lit(" — 発言比率 "), s["talk_time_pct"].cast("string"), F.lit("%"))).otherwise("")))
    topics = F.filter(r["summary"], lambda b: F.length(F.trim(b)) > 4)
    fallback = F.when(_or(r["full_summary"], "") != "", F.concat(F.substring(r["full_summary"], 1, 120), F.when(F.length(r["full_summary"]) > 120, "...").otherwise(""))).otherwise(NO_TOPIC)
    acts = F.transform(F.filter(r["action_items"], lambda i: _or(i["task"], "") != ""), lambda i: F.struct(i["task"].alias("task"), _or(i["owner"], "TBD").alias("owner"), _or(i["deadline"], NO_DATE).alias("deadline")))
    none = F.array(F.struct(F.lit(NO_ACTION).alias("task"), F.lit("—").alias("owner"), F.lit("—").alias("deadline")))
    return F.struct(
        _or(F.nullif(r["meeting_title"], F.lit("")), NO_NAME).alias("title"), F.date_format(at, "yyyy年MM月dd日 HH:mm").alias("held_at"), F.when(F.size(who) > 0, who).otherwise(F.array(F.lit(NO_PEOPLE))).alias("attendees"),
        F.when(F.size(topics) > 0, topics).otherwise(F.array(fallback)).alias("topics"), F.when(F.size(r["key_decisions"]) > 0, r["key_decisions"]).otherwise(here(more_decisions, F.array(F.lit(NO_DECISION)))).alias("decisions"),
        F.when(F.size(acts) > 0, acts).otherwise(here(more_actions, none)).alias("actions"),
    )


def minutes_text(m: str, before: Column | None = None) -> Column:
    """The plan of minutes as Markdown; before: how many actions earlier pages have."""
    p, start = F.col(m), F.lit(0) if before is None else before
    acts = F.transform(p["actions"], lambda a, i: F.concat(F.lit("| "), (start + i + 1).cast("string"), F.lit(" | "), a["task"], F.lit(" | "), a["owner"], F.lit(" | "), a["deadline"], F.lit(" |")))
    item = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    return _lines(F.concat(F.lit("# "), p["title"]), F.concat(F.lit("日時: "), p["held_at"]), F.lit(HEADS[0]), item(p["attendees"]), F.lit(HEADS[1]), item(p["topics"]), F.lit(HEADS[2]), item(p["decisions"]), F.lit(HEADS[3]), F.array_join(acts, "\n"))


def cultural_report(df: DataFrame) -> DataFrame:
    """meeting_id, report (Markdown) of rows (meeting_id, title, risk_level, signals as text, decisions, chain, closing_speaker, pivots, stalls): the cultural reading of a meeting; sections without content say so."""
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    item = lambda c, empty: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(empty)
    chain = F.transform(F.coalesce("chain", F.array().cast("array<struct<approver:string,role:string>>")), lambda x: F.concat(x["approver"], F.when(_or(x["role"], "") != "", F.concat(F.lit(" ("), x["role"], F.lit(")"))).otherwise("")))
    close = F.when(F.col("closing_speaker").isNotNull(), F.concat(F.lit("- "), F.col("closing_speaker"))).otherwise("- None detected")
    return df.select("meeting_id", _lines(
        F.concat(F.lit("# "), _or(F.col("title"), "会議")), F.concat(F.lit("Soft rejection risk: "), _or(F.col("risk_level"), "NONE")), F.lit("## Signals"), item(none("signals"), "- None detected"), F.lit("## Decisions"), item(none("decisions"), "- None recorded"),
        F.lit("## Approval chain"), item(chain, "- 未指定 / Unassigned"), F.lit("## Closing"), close, F.concat(F.lit("Silences: "), _or(F.col("pivots").cast("string"), "0"), F.lit("; stalls: "), _or(F.col("stalls").cast("string"), "0")),
    ).alias("report"))


def slide_plan(df: DataFrame) -> DataFrame:
    """meeting_id, slide_number, slide_type, title, bullets of rows (meeting_id, summary, decisions, actions as text, signals as text, watch as text); slides without content are left out and the rest numbered."""
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    first = F.when(F.size(empty("summary")) > 0, F.slice(empty("summary"), 1, 3)).otherwise(F.array(F.lit("The analysis has nothing to summarise.")))
    decided = F.when(F.size(empty("decisions")) > 0, F.transform(F.slice(empty("decisions"), 1, 4), lambda d: F.concat(F.lit("Decided: "), d))).otherwise(F.array(F.lit("The transcript holds no explicit decision.")))
    steps = F.when(F.size(empty("actions")) > 0, F.slice(empty("actions"), 1, 5)).otherwise(F.array(F.lit("The meeting left nobody with a task.")))
    s = lambda kind, title, b, show: F.struct(F.lit(kind).alias("slide_type"), F.lit(title).alias("title"), b.alias("bullets"), show.alias("show"))
    yes = F.lit(True)
    all_ = F.array(
        s("cover", "Meeting Summary", F.array().cast("array<string>"), yes), s("bottom_line", "In short", bullets(first, F.slice(first, 1, 1)), yes), s("said_vs_meant", "Said and meant", F.slice(empty("signals"), 1, 3), F.size(empty("signals")) > 0),
        s("decisions", "Decisions", decided, yes), s("risk_watch", "To watch", F.slice(empty("watch"), 1, 4), F.size(empty("watch")) > 0), s("closing", "Next", bullets(steps, F.slice(steps, 1, 1)), yes),
    )
    d = df.select("meeting_id", F.posexplode(F.filter(all_, lambda x: x["show"])).alias("n", "s"))
    return d.select("meeting_id", (F.col("n") + 1).alias("slide_number"), "s.slide_type", "s.title", "s.bullets")


def rag_prompt(found: DataFrame) -> DataFrame:
    """query_id, prompt of retrieved rows (query_id, place, question, meeting_id, excerpt)."""
    one = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("meeting_id"), F.lit(": "), F.substring("excerpt", 1, 300))
    g = found.groupBy("query_id", "question").agg(F.array_sort(F.collect_list(F.struct("place", one.alias("t")))).alias("c"))
    return g.select("query_id", F.concat(F.lit("Meetings:\n"), F.array_join(F.transform("c", lambda x: x["t"]), "\n"), F.lit("\n\nQuestion: "), F.col("question")).alias("prompt"))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as result structs, made of the item tables, in pages of SHOWN items of a kind in the order of their id, with the numbers of all; tasks_n counts the actions with a task, tasks_before those of earlier pages."""
    every, line = W.partitionBy("request_id"), W.partitionBy("request_id").orderBy("item_id")
    page = (F.floor((F.row_number().over(line) - 1) / SHOWN) + 1).cast("int")
    has = (F.coalesce("task", F.lit("")) != "").cast("int")
    a = spark.read.parquet(f"{folder}/action_items.parquet").where("request_id IS NOT NULL").select("request_id", "item_id", "task", "owner", "deadline", "flag").distinct()
    a = a.withColumn("page", page).withColumn("has", has).withColumn("before", F.sum("has").over(line.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("has")).withColumn("n", F.count("*").over(every)).withColumn("t", F.sum("has").over(every))
    a = a.groupBy("request_id", "page").agg(F.first("n").alias("actions_n"), F.first("t").alias("tasks_n"), F.min("before").alias("tasks_before"), F.array_sort(F.collect_list(F.struct("item_id", "task", "owner", "deadline", "flag"))).alias("action_items"))
    c = spark.read.parquet(f"{folder}/commitment_items.parquet").where("request_id IS NOT NULL").select("request_id", "item_id", "text").distinct()
    c = c.withColumn("page", page).withColumn("n", F.count("*").over(every)).groupBy("request_id", "page").agg(F.first("n").alias("decisions_n"), F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("c"))
    # A page that only one kind reaches has the other's numbers from the pages before.
    j = a.join(c, ["request_id", "page"], "full")
    of_all = lambda n: F.coalesce(F.max(n).over(every), F.lit(0)).alias(n)
    none = F.array().cast("array<string>")
    return j.select(
        F.col("request_id").alias("meeting_id"), "page", F.max("page").over(every).alias("pages"), of_all("actions_n"), of_all("decisions_n"), of_all("tasks_n"), F.coalesce("tasks_before", F.lit(0)).alias("tasks_before"),
        F.struct(
            F.lit("").alias("meeting_title"), F.lit("").alias("full_summary"), none.alias("summary"), F.coalesce(F.transform("c", lambda x: x["text"]), none).alias("key_decisions"),
            F.coalesce("action_items", F.array().cast("array<struct<item_id:string,task:string,owner:string,deadline:string,flag:boolean>>")).alias("action_items"),
            F.array().cast("array<struct<speaker:string,score:string>>").alias("sentiment"), F.array().cast("array<struct<name:string,talk_time_pct:int,tone:string>>").alias("speakers"),
        ).alias("r"),
    )


def q_notes(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select("meeting_id", "page", "pages", "actions_n", "decisions_n", text_notes("r").alias("notes"))


def q_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select("meeting_id", "page", "pages", "actions_n", "decisions_n", markdown_notes("r").alias("notes"))


def q_minutes(spark: SparkSession, folder: str) -> DataFrame:
    m = _results(spark, folder).withColumn("m", minutes("r", F.timestamp_seconds(F.lit(0)), (F.col("decisions_n") > 0) | (F.col("page") > 1), (F.col("tasks_n") > 0) | (F.col("page") > 1)))
    return m.select("meeting_id", "page", "pages", "actions_n", "decisions_n", minutes_text("m", F.col("tasks_before")).alias("minutes"))


def q_slides(spark: SparkSession, folder: str) -> DataFrame:
    """The slides of every request: decisions and steps of its items, the gravest said-versus-meant items as signals, those of HIGH or MEDIUM severity to watch."""
    acts = F.transform("r.action_items", lambda i: F.concat(_or(i["task"], ""), F.lit(" (Owner: "), _or(i["owner"], "TBD"), F.lit(", Due: "), _or(i["deadline"], "TBD"), F.lit(")")))
    v = spark.read.parquet(f"{folder}/said_vs_meant_items.parquet").where("request_id IS NOT NULL").select(F.col("request_id").alias("meeting_id"), "item_id", "said", "meant", "severity").distinct()
    line = F.struct("place", F.concat(_or(F.col("said"), ""), F.lit(" → "), _or(F.col("meant"), "")).alias("t"))
    texts = lambda c: F.transform(F.array_sort(c), lambda x: x["t"])
    top = top_signals(v, "meeting_id", 4, "item_id").groupBy("meeting_id").agg(texts(F.collect_list(line)).alias("signals"), texts(F.collect_list(F.when(F.upper("severity").isin("HIGH", "MEDIUM"), line))).alias("watch"))
    d = _results(spark, folder).where("page = 1").select("meeting_id", F.col("r.summary").alias("summary"), F.col("r.key_decisions").alias("decisions"), acts.alias("actions"))
    return slide_plan(d.join(top, "meeting_id", "left")).select("meeting_id", "slide_number", "slide_type", F.size("bullets").alias("bullets"))


def q_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """What the bundle of each finished job holds, read back from its JSON."""
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").where("result IS NOT NULL").select("job_id", "language", "transcript", "result").distinct()
    b = export_bundle(F.struct(F.col("job_id"), F.col("language")), F.col("transcript"), F.col("result"))
    at = lambda path: F.get_json_object("b", path)
    d = j.select("job_id", b.alias("b"))
    return d.select("job_id", F.size(F.json_object_keys("b")).alias("keys"), at("$.metadata.job_id").alias("held_id"), at("$.metadata.language").alias("language"), F.length(at("$.transcript")).alias("chars"), F.get_json_object(at("$.analysis"), "$.meeting_title").alias("title"))


def q_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Registered persons with a title by account, the highest rank first."""
    p = spark.read.parquet(f"{folder}/people.parquet").where("job_title IS NOT NULL").select(F.col("account_id").cast("string").alias("meeting_id"), F.col("full_name").alias("speaker"), role(F.col("job_title")).alias("h"))
    return approval_chain(p.select("meeting_id", "speaker", "h.role", "h.rank")).select("meeting_id", F.size("chain").alias("steps"), F.col("chain")[0]["approver"].alias("top"))


def q_cultural(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.seed import meetings

    m = meetings(spark, folder)
    t, h = cut(dynamics.turns(m)), cut(people.role_hints(m))
    s = signals.signals(m).groupBy("meeting_id").agg(F.array_sort(F.collect_set(F.concat("speaker", F.lit(": "), "phrase"))).alias("signals"))
    n = lambda d, c: d.groupBy("meeting_id").agg(F.count("*").alias(c))
    d = signals.risk(m).select("meeting_id", "risk_level").join(s, "meeting_id", "left").join(approval_chain(h), "meeting_id", "left")
    d = d.join(dynamics.closing_summarizer(t, h).select("meeting_id", F.col("speaker").alias("closing_speaker")), "meeting_id", "left").join(n(dynamics.senior_silence(t, h), "pivots"), "meeting_id", "left").join(n(dynamics.topic_stalls(t), "stalls"), "meeting_id", "left")
    return cultural_report(d.withColumn("title", F.lit(None).cast("string")).withColumn("decisions", F.array().cast("array<string>")))


QUERIES = {"cultural_report": q_cultural, "text_notes": q_notes, "markdown_notes": q_markdown, "formal_minutes": q_minutes, "slide_plan": q_slides, "export_bundle": q_bundle, "approval_chain": q_chain}
_A = f"""a AS (SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY item_id) - 1) // {SHOWN} + 1 AS page, sum(CASE WHEN coalesce(task, '') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY item_id) AS k,
 sum(CASE WHEN coalesce(task, '') <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS tasks_n FROM (SELECT DISTINCT request_id, item_id, task, owner, deadline, flag FROM action_items WHERE request_id IS NOT NULL)),
 c AS (SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY item_id) - 1) // {SHOWN} + 1 AS page FROM (SELECT DISTINCT request_id, item_id, text FROM commitment_items WHERE request_id IS NOT NULL)),
 p AS (SELECT request_id, page FROM a UNION SELECT request_id, page FROM c), n AS (SELECT request_id, max(page) AS pages FROM p GROUP BY 1), na AS (SELECT request_id, count(*) AS n, max(tasks_n) AS t FROM a GROUP BY 1), nc AS (SELECT request_id, count(*) AS n FROM c GROUP BY 1),
 m AS (SELECT request_id, page, pages, coalesce(na.n, 0) AS actions_n, coalesce(nc.n, 0) AS decisions_n, coalesce(na.t, 0) AS tasks_n FROM p JOIN n USING (request_id) LEFT JOIN na USING (request_id) LEFT JOIN nc USING (request_id))"""
_NL = "chr(10)"


def _paged(items: str, notes: str) -> str:
    return f"WITH {_A}, i AS ({items}) SELECT m.request_id AS meeting_id, CAST(page AS INT) AS page, CAST(pages AS INT) AS pages, actions_n, decisions_n, {notes} FROM m LEFT JOIN i USING (request_id, page)"


_ACT = "coalesce(task, '')"
_TEXT_ITEMS = f"""SELECT request_id, page, string_agg('- ' || {_ACT} || CASE WHEN flag THEN ' [FLAGGED]' ELSE '' END || {_NL} || '    Owner: ' || coalesce(owner, 'TBD') || '   Deadline: ' || coalesce(deadline, 'TBD'), {_NL} ORDER BY item_id) AS body FROM a GROUP BY 1, 2"""
_MD_ITEMS = f"""SELECT request_id, page, string_agg('- **' || {_ACT} || '**' || CASE WHEN flag THEN ' ⚠' ELSE '' END || '  ' || {_NL} || '  Owner: ' || coalesce(owner, 'TBD') || '  Deadline: ' || coalesce(deadline, 'TBD') || {_NL}, '' ORDER BY item_id) AS body FROM a GROUP BY 1, 2"""
_MINUTE_ITEMS = f"""SELECT request_id, page, acts, decided, before FROM p LEFT JOIN (SELECT request_id, page, string_agg('| ' || k || ' | ' || task || ' | ' || coalesce(owner, 'TBD') || ' | ' || coalesce(deadline, {lit(NO_DATE)}) || ' |', {_NL} ORDER BY item_id) FILTER (WHERE {_ACT} <> '') AS acts,
 min(k - CASE WHEN {_ACT} <> '' THEN 1 ELSE 0 END) AS before FROM a GROUP BY 1, 2) USING (request_id, page) LEFT JOIN (SELECT request_id, page, string_agg('- ' || text, {_NL} ORDER BY item_id) AS decided FROM c GROUP BY 1, 2) USING (request_id, page)"""
_MINUTES = f"""concat_ws({_NL}, '# ' || {lit(NO_NAME)}, '日時: 1970年01月01日 00:00', {lit(HEADS[0])}, '- ' || {lit(NO_PEOPLE)}, {lit(HEADS[1])}, '- ' || {lit(NO_TOPIC)}, {lit(HEADS[2])}, coalesce(decided, CASE WHEN decisions_n > 0 OR page > 1 THEN '' ELSE '- ' || {lit(NO_DECISION)} END),
 {lit(HEADS[3])}, coalesce(acts, CASE WHEN tasks_n > 0 OR page > 1 THEN '' ELSE '| ' || (coalesce(before, 0) + 1) || ' | ' || {lit(NO_ACTION)} || ' | — | — |' END)) AS minutes"""
_COUNT = lambda q: f"(SELECT meeting_id, count(*) AS n FROM ({q}) GROUP BY 1)"
SQL = {
    "cultural_report": f"""WITH s AS (SELECT meeting_id, string_agg('- ' || x, {_NL} ORDER BY x) AS body FROM (SELECT DISTINCT meeting_id, speaker || ': ' || phrase AS x FROM ({signals.SQL["signal_rows"]})) GROUP BY 1),
 c AS (SELECT meeting_id, string_agg('- ' || speaker || CASE WHEN role <> '' THEN ' (' || role || ')' ELSE '' END, {_NL} ORDER BY rank DESC, speaker, role) AS body FROM ({people.HINTS_SQL}) WHERE rank > 0 GROUP BY 1)
 SELECT r.meeting_id, concat_ws({_NL}, '# 会議', 'Soft rejection risk: ' || r.risk_level, '## Signals', coalesce(s.body, '- None detected'), '## Decisions', '- None recorded', '## Approval chain', coalesce(c.body, '- 未指定 / Unassigned'), '## Closing', coalesce('- ' || z.speaker, '- None detected'),
 'Silences: ' || coalesce(p.n, 0) || '; stalls: ' || coalesce(t.n, 0)) AS report FROM (SELECT *, {signals._LEVEL} AS risk_level FROM ({signals._RISK})) r LEFT JOIN s USING (meeting_id) LEFT JOIN c USING (meeting_id) LEFT JOIN ({dynamics.SQL["closing_summarizer"]}) z USING (meeting_id)
 LEFT JOIN {_COUNT(dynamics.SQL["senior_silence"])} p USING (meeting_id) LEFT JOIN {_COUNT(dynamics.SQL["topic_stalls"])} t USING (meeting_id)""",
    "text_notes": _paged(_TEXT_ITEMS, f"'MEETING ANALYSIS' || {_NL} || repeat('=', 40) || {_NL} || CASE WHEN body IS NOT NULL THEN {_NL} || 'ACTION ITEMS' || {_NL} || repeat('-', 20) || {_NL} || body || {_NL} ELSE '' END AS notes"),
    "markdown_notes": _paged(_MD_ITEMS, f"'# Meeting Analysis' || {_NL} || CASE WHEN body IS NOT NULL THEN {_NL} || '## Action Items' || {_NL} || body ELSE '' END AS notes"),
    "formal_minutes": _paged(_MINUTE_ITEMS, _MINUTES),
    "slide_plan": f"""WITH {_A}, s AS (SELECT request_id, count(*) AS n, count(*) FILTER (WHERE upper(severity) IN ('HIGH', 'MEDIUM')) AS w FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE upper(severity) WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, item_id) AS k
 FROM (SELECT DISTINCT request_id, item_id, said, meant, severity FROM said_vs_meant_items WHERE request_id IS NOT NULL)) WHERE k <= 4 GROUP BY 1),
 q AS (SELECT m.*, coalesce(s.n, 0) AS sn, coalesce(s.w, 0) AS sw FROM m LEFT JOIN s USING (request_id) WHERE page = 1),
 x AS (SELECT request_id, 1 AS o, 'cover' AS slide_type, 0 AS bullets FROM q UNION ALL SELECT request_id, 2, 'bottom_line', 1 FROM q UNION ALL SELECT request_id, 3, 'said_vs_meant', least(3, sn) FROM q WHERE sn > 0
 UNION ALL SELECT request_id, 4, 'decisions', CASE WHEN decisions_n > 0 THEN least(4, decisions_n) ELSE 1 END FROM q UNION ALL SELECT request_id, 5, 'risk_watch', least(4, sw) FROM q WHERE sw > 0 UNION ALL SELECT request_id, 6, 'closing', CASE WHEN actions_n > 0 THEN least(5, actions_n) ELSE 1 END FROM q)
 SELECT request_id AS meeting_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY o) AS INT) AS slide_number, slide_type, CAST(bullets AS INT) AS bullets FROM x""",
    "approval_chain": f"""SELECT CAST(account_id AS VARCHAR) AS meeting_id, count(*) AS steps, first(full_name ORDER BY h.rank DESC, full_name) AS top FROM (SELECT account_id, full_name, {role_sql("job_title")} AS h FROM people WHERE job_title IS NOT NULL) WHERE h.rank > 0 GROUP BY 1""",
    "export_bundle": "SELECT job_id, 3 AS keys, job_id AS held_id, language, length(transcript) AS chars, result ->> '$.meeting_title' AS title FROM (SELECT DISTINCT job_id, language, transcript, result FROM analysis_jobs WHERE result IS NOT NULL)",
}
