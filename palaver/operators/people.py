"""Speakers: labels to names, one name for all spellings, rank by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import literal_map, strip
from ..sources.seed import MEETINGS, meetings, rows

_ROLE = "さん|様|くん|ちゃん|先生|部長|課長|社長|専務|常務|係長|主任|san"
#: Owners that are nobody in particular.
NOBODY = ("tbd", "both", "all", "team")


def normal_name(c: Column, anchored: bool = False) -> Column:
    """A label without brackets, honorifics and titles; empty for a mere title. anchored: `san` is removed at the end only, so that "Sanjay" stays."""
    n = strip(c)
    n = F.regexp_replace(F.regexp_replace(n, r"(?U)^([^(]*?)\s*\)$", "$1"), r"(?U)^\(\s*([^)]*)$", "$1")
    n = F.regexp_replace(F.regexp_replace(n, r"(?U)\s*\([^)]*\)", ""), r"(?U)\s*【[^】]*】", "")
    n = strip(F.regexp_replace(n, rf"(?iU)[\s-]*(?:{_ROLE})\s*$" if anchored else rf"(?iU)\s*(?:{_ROLE})\s*", ""))
    return F.when(F.lower(n).isin(*lexicon.ROLE_ONLY), "").otherwise(n)


# A run is taken from its first character only and never given back, so a long line without a colon is read once.
_ANY_LABEL = r"(?<![^\n:：\[\]])([^\n:：\[\]]++)[:：]"


def speakers(df: DataFrame) -> DataFrame:
    """meeting_id, speaker, raw_label, first_pos, turns: each normalised name before any colon with its last raw label."""
    # Each label once a meeting, with its first and last place and its number, so that few names are normalised and shuffled.
    every = F.transform(F.regexp_extract_all("transcript", F.lit(_ANY_LABEL)), strip)
    place = lambda a, r: F.array_position(a, r) - 1
    one = lambda a: F.transform(F.array_distinct(a), lambda r: F.struct(r.alias("raw"), place(a, r).alias("pos"), (F.size(a) - 1 - place(F.reverse(a), r)).alias("last"), F.size(F.filter(a, lambda x: x == r)).alias("n")))
    e = df.select("meeting_id", F.inline(F.flatten(F.transform(F.array(every), one))))
    e = e.where(~F.col("raw").rlike("^[0-9]+$")).withColumn("speaker", normal_name(F.col("raw"))).where(F.length("speaker") >= 2)
    return e.groupBy("meeting_id", "speaker").agg(F.max_by("raw", "last").alias("raw_label"), F.min("pos").alias("first_pos"), F.sum("n").alias("turns"))


def role(c: Column) -> Column:
    """Struct of title and rank of a label: the text in brackets first, then the label; the highest rank, 0 without a title."""
    inside = F.regexp_extract(c, r"[\(（【]([^\)）】]*)[\)）】]", 1)

    def candidates(t: Column, bracket: bool) -> Column:
        low = F.lower(t)
        hit = [(F.contains(t, F.lit(w)), w, r) for w, r in lexicon.RANK_JA] + [(low.rlike(rf"\b{w}\b"), w, r) for w, r in lexicon.RANK_EN]
        return F.array_compact(F.array(*(F.when(has, F.struct((F.trim(t) if bracket else F.lit(w)).alias("role"), F.lit(r).alias("rank"))) for has, w, r in hit)))

    every = F.concat(candidates(inside, True), candidates(c, False))
    none = F.struct(F.lit("").alias("role"), F.lit(0).alias("rank"))
    return F.aggregate(every, none, lambda best, x: F.when(x["rank"] > best["rank"], x).otherwise(best))


def role_hints(df: DataFrame) -> DataFrame:
    """meeting_id, speaker, role, rank of meetings (meeting_id, transcript)."""
    return hints_of(speakers(df))


def hints_of(s: DataFrame) -> DataFrame:
    """role_hints of a table of speakers."""
    r = role(F.col("raw_label"))
    return s.select("meeting_id", "speaker", r["role"].alias("role"), r["rank"].alias("rank"))


def best_match(names: DataFrame, known: DataFrame) -> DataFrame:
    """meeting_id, name, matched: each name as the transcript's speakers have it: the same, the same but for case, the other script, one within the other, else as it is.

    Ties go to the speaker who talks first. An empty normalised name (a mere title) matches nobody.
    """
    kanji, roman = literal_map(lexicon.SURNAMES), literal_map((k, r) for r, k in lexicon.SURNAMES)
    n = names.where("name IS NOT NULL").select("meeting_id", "name").distinct().withColumn("n", normal_name(F.col("name")))
    j = n.join(known.select("meeting_id", "speaker", "first_pos"), "meeting_id", "left")
    a, b = F.col("n"), F.col("speaker")
    how = F.when(b.isNull() | (a == ""), None).when(a == b, 1).when(F.lower(a) == F.lower(b), 2).when(kanji[F.lower(a)] == b, 3).when(F.lower(b) == roman[a], 3).when(F.contains(b, a) | F.contains(a, b), 4)
    best = j.withColumn("how", how).groupBy("meeting_id", "name", "n").agg(F.min(F.when(F.col("how").isNotNull(), F.struct("how", "first_pos", "speaker"))).alias("b"))
    return best.select("meeting_id", "name", F.coalesce("b.speaker", "n").alias("matched"), F.coalesce("b.how", F.lit(0)).alias("how"))


def unify(spoken: DataFrame, known: DataFrame) -> DataFrame:
    """meeting_id, name, talk_time_pct of result speakers (meeting_id, pos, name, talk_time_pct) under one name, talk time summed, in the order of first mention."""
    m = spoken.join(best_match(spoken, known), ["meeting_id", "name"])
    g = m.groupBy("meeting_id", "matched").agg(F.sum("talk_time_pct").alias("talk_time_pct"), F.min("pos").alias("pos"))
    return g.select("meeting_id", "pos", F.col("matched").alias("name"), "talk_time_pct")


def result_names(r: Column) -> Column:
    """The names of a result struct that are unified: speakers, moods, owners who are somebody."""
    owners = F.filter(F.transform(r["action_items"], lambda i: i["owner"]), lambda n: (n != "") & ~F.lower(n).isin(*NOBODY))
    return F.array_distinct(F.concat(F.transform(r["speakers"], lambda s: s["name"]), F.transform(r["sentiment"], lambda s: s["speaker"]), owners))


def unified(r: Column, names: Column) -> Column:
    """The result struct under the names of the map names (name -> matched): moods and owners renamed, speakers renamed and those of one name merged, talk time summed."""
    named = lambda n: F.coalesce(names[n], n)
    owner = lambda n: F.when(F.lower(n).isin(*NOBODY), n).otherwise(named(n))
    sp = F.transform(r["speakers"], lambda s: s.withField("name", named(s["name"])))
    own = lambda a, n: F.filter(a, lambda s: s["name"].eqNullSafe(n))
    one = F.transform(F.array(sp), lambda a: F.transform(F.array_distinct(F.transform(a, lambda s: s["name"])), lambda n: own(a, n)[0].withField("talk_time_pct", F.aggregate(own(a, n), F.lit(0), lambda t, s: t + F.coalesce(s["talk_time_pct"], F.lit(0))))))[0]
    return r.withField("speakers", one).withField("sentiment", F.transform(r["sentiment"], lambda s: s.withField("speaker", named(s["speaker"])))).withField("action_items", F.transform(r["action_items"], lambda i: i.withField("owner", owner(i["owner"]))))


def q_speakers(spark: SparkSession, folder: str) -> DataFrame:
    return speakers(meetings(spark, folder)).select("meeting_id", "speaker", "raw_label", "turns")


def q_roles(spark: SparkSession, folder: str) -> DataFrame:
    return role_hints(meetings(spark, folder)).where("rank > 0")


def _owned(spark: SparkSession, folder: str) -> DataFrame:
    a = spark.read.parquet(f"{folder}/action_items.parquet").where("request_id IS NOT NULL AND owner IS NOT NULL").select(F.col("request_id").alias("meeting_id"), F.col("owner").alias("name"))
    return a.where(~F.lower("name").isin(*NOBODY))


def q_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Owners of action items as their transcripts name them: how many by kind of match."""
    m = spark.read.parquet(f"{folder}/analyze_requests.parquet").where("transcript IS NOT NULL").groupBy(F.col("request_id").alias("meeting_id")).agg(F.min("transcript").alias("transcript"))
    return best_match(_owned(spark, folder), speakers(m)).groupBy("how").agg(F.count("*").alias("names"))


def q_unify(spark: SparkSession, folder: str) -> DataFrame:
    """The stand-in's speakers under the names that the transcript has for them, talk time summed."""
    from .results import stand_in

    m = meetings(spark, folder)
    sp = m.select("meeting_id", F.posexplode(F.transform(stand_in(F.col("transcript"))["speakers"], lambda x: F.struct(x["name"].alias("name"), x["talk_time_pct"].alias("pct")))).alias("pos", "s"))
    u = unify(sp.select("meeting_id", "pos", "s.name", F.col("s.pct").alias("talk_time_pct")), speakers(m))
    return u.select("meeting_id", "pos", "name", F.col("talk_time_pct").cast("bigint").alias("talk_time_pct"))


def q_surnames(spark: SparkSession, folder: str) -> DataFrame:
    d = spark.createDataFrame([*lexicon.SURNAMES], "romaji string, kanji string")
    return d.groupBy(F.length("kanji").alias("characters")).agg(F.count("*").alias("names"), F.min("romaji").alias("first"))


def q_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Rank of the registered persons' titles by account."""
    p = spark.read.parquet(f"{folder}/people.parquet").where("job_title IS NOT NULL")
    w = W.partitionBy("account_id").orderBy(F.col("rank").desc(), "person_id")
    r = p.select("account_id", "person_id", role(F.col("job_title"))["rank"].alias("rank"))
    return r.withColumn("place", F.row_number().over(w)).where("place = 1").select("account_id", "person_id", "rank")


QUERIES = {"speaker_names": q_speakers, "role_hints": q_roles, "unified_owners": q_unified, "unified_speakers": q_unify, "surname_dictionary": q_surnames, "senior_by_account": q_titles}
_WS = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def name_sql(c: str) -> str:
    """normal_name in SQL."""
    n = f"regexp_replace(regexp_replace({strip_sql(c)}, '^([^(]*?){_WS}*\\)$', '\\1'), '^\\({_WS}*([^)]*)$', '\\1')"
    n = f"regexp_replace(regexp_replace({n}, '{_WS}*\\([^)]*\\)', '', 'g'), '{_WS}*【[^】]*】', '', 'g')"
    n = strip_sql(f"regexp_replace({n}, '(?i){_WS}*(?:{_ROLE}){_WS}*', '', 'g')")
    return f"CASE WHEN lower({n}) IN (" + ", ".join("'" + r + "'" for r in lexicon.ROLE_ONLY) + f") THEN '' ELSE {n} END"


_RANK = "greatest(" + ", ".join([f"CASE WHEN contains(job_title, '{w}') THEN {r} ELSE 0 END" for w, r in lexicon.RANK_JA] + [rf"CASE WHEN regexp_matches(lower(job_title), '\b{w}\b') THEN {r} ELSE 0 END" for w, r in lexicon.RANK_EN]) + ")"


def role_sql(c: str) -> str:
    """role in SQL: a struct of role and rank."""
    inside = f"regexp_extract({c}, '[\\(（【]([^\\)）】]*)[\\)）】]', 1)"

    def candidates(t: str, bracket: bool) -> str:
        one = lambda has, w, r: f"CASE WHEN {has} THEN struct_pack(role := {f'trim({t})' if bracket else repr(w)}, rank := {r}) END"
        return "[" + ", ".join([one(f"contains({t}, '{w}')", w, r) for w, r in lexicon.RANK_JA] + [one(f"regexp_matches(lower({t}), '\\b{w}\\b')", w, r) for w, r in lexicon.RANK_EN]) + "]"

    every = f"list_filter(list_concat({candidates(inside, True)}, {candidates(c, False)}), lambda x: x IS NOT NULL)"
    return f"list_reduce(list_prepend(struct_pack(role := '', rank := 0), {every}), lambda best, x: CASE WHEN x.rank > best.rank THEN x ELSE best END)"


def speakers_sql(table: str) -> str:
    """speakers in SQL: meeting_id, speaker, raw_label, first_pos, turns."""
    return f"""SELECT meeting_id, speaker, max_by(raw, pos) AS raw_label, min(pos) AS first_pos, count(*) AS turns FROM (SELECT meeting_id, pos, raw, {name_sql("raw")} AS speaker FROM (SELECT meeting_id, pos, {strip_sql("raw")} AS raw FROM (
 SELECT meeting_id, unnest(r) AS raw, generate_subscripts(r, 1) AS pos FROM (SELECT meeting_id, regexp_extract_all(transcript, '(?:\\[\\d{{2}}:\\d{{2}}(?::\\d{{2}})?\\]\\s*)?([^\\n:：\\[\\]]+)[:：]', 1) AS r FROM {table}))) WHERE NOT regexp_matches(raw, '^[0-9]+$')) WHERE length(speaker) >= 2 GROUP BY meeting_id, speaker"""


HINTS_SQL = f"SELECT meeting_id, speaker, h.role AS role, h.rank AS rank FROM (SELECT meeting_id, speaker, {role_sql('raw_label')} AS h FROM ({speakers_sql(MEETINGS)}))"
_LEAST = "(SELECT request_id AS meeting_id, min(transcript) AS transcript FROM analyze_requests WHERE transcript IS NOT NULL GROUP BY 1)"
SQL = {
    "speaker_names": f"SELECT meeting_id, speaker, raw_label, turns FROM ({speakers_sql(MEETINGS)})",
    "role_hints": f"SELECT * FROM ({HINTS_SQL}) WHERE rank > 0",
    "unified_owners": f"""WITH sn AS (SELECT * FROM {rows(lexicon.SURNAMES, 'v(roman, kanji)')}), k AS ({speakers_sql(_LEAST)}), n AS (SELECT DISTINCT request_id AS meeting_id, owner AS name, {name_sql("owner")} AS n FROM action_items
 WHERE request_id IS NOT NULL AND owner IS NOT NULL AND lower(owner) NOT IN ({", ".join(f"'{w}'" for w in NOBODY)})),
 j AS (SELECT n.meeting_id, n.name, min(CASE WHEN k.speaker IS NULL OR n.n = '' THEN NULL WHEN n.n = k.speaker THEN 1 WHEN lower(n.n) = lower(k.speaker) THEN 2 WHEN (SELECT max(kanji) FROM sn WHERE roman = lower(n.n)) = k.speaker THEN 3
 WHEN (SELECT max(roman) FROM sn WHERE kanji = n.n) = lower(k.speaker) THEN 3 WHEN contains(k.speaker, n.n) OR contains(n.n, k.speaker) THEN 4 END) AS how FROM n LEFT JOIN k USING (meeting_id) GROUP BY 1, 2) SELECT coalesce(how, 0) AS how, count(*) AS names FROM j GROUP BY 1""",
    "unified_speakers": f"""WITH sn AS (SELECT * FROM {rows(lexicon.SURNAMES, 'v(roman, kanji)')}), k AS ({speakers_sql(MEETINGS)}),
 g AS (SELECT meeting_id, list_filter(list_distinct(list_transform(regexp_extract_all(transcript, '(?m)(?:^|\\n)\\s*([A-Za-z][A-Za-z\\s.'']{{1,35}}?)\\s*[:：]', 1), lambda x: {strip_sql("x")})), lambda x: length(x) >= 2 AND lower(x) NOT IN ('http', 'https', 'view', 'sorry', 'would', 'could')) AS g, regexp_extract_all(transcript, '(?m)(?:^|\\n)\\s*([A-Za-z][A-Za-z\\s.'']{{1,35}}?)\\s*[:：]', 1) AS raw FROM {MEETINGS}),
 o AS (SELECT meeting_id, CASE WHEN len(g) > 0 THEN list_sort(g, 'ASC') ELSE ['Speaker A', 'Speaker B'] END AS names, list_transform(raw, lambda x: {strip_sql("x")}) AS raw FROM g),
 u AS (SELECT meeting_id, unnest(names) AS name, len(names) AS cnt, raw FROM o), f AS (SELECT meeting_id, name, cnt, coalesce(list_position(raw, name), CASE WHEN name = 'Speaker A' THEN 1 ELSE 2 END) AS seen FROM u),
 s AS (SELECT meeting_id, name, row_number() OVER (PARTITION BY meeting_id ORDER BY seen) - 1 AS pos, round_even(100.0 / cnt, 0) AS pct, {name_sql("name")} AS n FROM f),
 h AS (SELECT s.*, k.speaker, k.first_pos, CASE WHEN k.speaker IS NULL OR s.n = '' THEN NULL WHEN s.n = k.speaker THEN 1 WHEN lower(s.n) = lower(k.speaker) THEN 2 WHEN (SELECT max(kanji) FROM sn WHERE roman = lower(s.n)) = k.speaker THEN 3
 WHEN (SELECT max(roman) FROM sn WHERE kanji = s.n) = lower(k.speaker) THEN 3 WHEN contains(k.speaker, s.n) OR contains(s.n, k.speaker) THEN 4 END AS how FROM s LEFT JOIN k USING (meeting_id)),
 b AS (SELECT meeting_id, name, pos, pct, n, arg_min(speaker, (how, first_pos, speaker)) FILTER (WHERE how IS NOT NULL) AS matched FROM h GROUP BY ALL)
 SELECT meeting_id, min(pos) AS pos, coalesce(matched, n) AS name, CAST(sum(pct) AS BIGINT) AS talk_time_pct FROM b GROUP BY meeting_id, coalesce(matched, n)""",
    "surname_dictionary": f"SELECT length(kanji) AS characters, count(*) AS names, min(romaji) AS first FROM {rows(lexicon.SURNAMES, 's(romaji, kanji)')} GROUP BY 1",
    "senior_by_account": f"SELECT account_id, person_id, rank FROM (SELECT account_id, person_id, {_RANK} AS rank, row_number() OVER (PARTITION BY account_id ORDER BY {_RANK} DESC, person_id) AS n FROM people WHERE job_title IS NOT NULL) WHERE n = 1",
}
