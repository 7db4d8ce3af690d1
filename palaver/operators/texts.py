"""Queries of the text functions, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..sources.seed import MEETINGS, meetings
from ..sources.seed import text as lit

def q_language(spark: SparkSession, folder: str) -> DataFrame:
    m = meetings(spark, folder).select("meeting_id", text.language(F.col("transcript")).alias("language"))
    return m.select("meeting_id", "language", text.language_name(F.col("language")).alias("display_name"), *(text.features(F.col("language"))[n].alias(n) for n in lexicon.FEATURE_NAMES))


def q_budgets(spark: SparkSession, folder: str) -> DataFrame:
    m = meetings(spark, folder).withColumn("lang", text.language(F.col("transcript")))
    return m.select(
        "meeting_id", F.size(text.words(F.col("transcript"))).alias("words"), text.summary_bullets(F.col("transcript")).alias("bullets"), text.token_budget(F.col("transcript")).alias("max_tokens"), text.hinglish(F.col("transcript")).alias("hinglish"),
        text.large_model(F.col("transcript"), F.col("lang")).alias("large_model"), F.size(text.words(text.truncated(F.col("transcript"), 100))).alias("kept_words"),
    )


def q_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of both job tables cleaned: lengths before and after."""
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").where("transcript IS NOT NULL").select("job_id", "transcript").distinct()
    c = text.clean(F.col("transcript"))
    return j.select("job_id", F.length("transcript").alias("chars"), F.length(c).alias("clean_chars"), F.size(F.split(c, "\n")).alias("lines"))


def q_labels(spark: SparkSession, folder: str) -> DataFrame:
    m = meetings(spark, folder)
    return m.select("meeting_id", text.has_labels(F.col("transcript")).alias("has_labels"), text.speaker_hint(F.col("transcript")).alias("hint"), text.degenerate(F.col("transcript")).alias("degenerate"), F.length(text.joined_labels(F.col("transcript"))).alias("joined_chars"), F.length(text.labelled(F.col("transcript"))).alias("labelled_chars"))


def q_tokens(spark: SparkSession, folder: str) -> DataFrame:
    m = meetings(spark, folder).select("meeting_id", text.ja_tokens(F.col("transcript")).alias("t"), text.topic_terms(F.col("transcript")).alias("terms"))
    return m.select("meeting_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"), F.size("terms").alias("topic_terms"))


def q_switches(spark: SparkSession, folder: str) -> DataFrame:
    return meetings(spark, folder).select("meeting_id", text.code_switches(F.col("transcript")).alias("switches"))


def q_keigo(spark: SparkSession, folder: str) -> DataFrame:
    return meetings(spark, folder).select("meeting_id", text.keigo(F.col("transcript")).alias("keigo"), text.keigo_expected(F.col("transcript")).alias("expected"))


def q_names(spark: SparkSession, folder: str) -> DataFrame:
    """Typed owners against the registered names of their account by the fuzzy predicate: how many match. Distinct names first."""
    a = spark.read.parquet(f"{folder}/action_items.parquet").where("owner IS NOT NULL AND account_id IS NOT NULL").select("account_id", "owner").distinct()
    p = spark.read.parquet(f"{folder}/people.parquet").select("account_id", "full_name")
    j = a.join(p, "account_id").where(text.names_match(F.col("owner"), F.col("full_name")))
    return a.join(j.groupBy("account_id", "owner").agg(F.count("*").alias("n")), ["account_id", "owner"], "left").select("account_id", "owner", F.coalesce("n", F.lit(0)).alias("matches"))


def q_cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the exact cache: md5 of language and stripped text, and the safe id of the job."""
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").where("transcript IS NOT NULL").select("job_id", "language", "transcript").distinct()
    return j.select("job_id", F.md5(F.concat(F.coalesce("language", F.lit("en")), F.lit("::"), F.regexp_replace(F.col("transcript"), r"^[ \n\r\t]+|[ \n\r\t]+$", ""))).alias("cache_key"), text.safe_id(F.col("job_id"), 40).alias("safe_id"))


_JP = "[\\x{3000}-\\x{303f}\\x{3040}-\\x{309f}\\x{30a0}-\\x{30ff}\\x{4e00}-\\x{9fff}\\x{ff00}-\\x{ffef}]"
_LANG = f"""CASE WHEN trim(transcript, ' ' || chr(10) || chr(9) || chr(12288)) = '' THEN 'en' WHEN len(regexp_extract_all(transcript, '{_JP}')) / greatest(length(replace(replace(transcript, ' ', ''), chr(10), '')), 1) > 0.05
  THEN CASE WHEN len(regexp_extract_all(transcript, '[a-zA-Z]{{3,}}')) > 5 THEN 'mixed' ELSE 'ja' END ELSE 'en' END"""
_WS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_WORDS = f"list_filter(regexp_split_to_array(transcript, '{_WS}+'), lambda w: w <> '')"
_FLAGS = ", ".join("CASE language " + " ".join(f"WHEN '{lang}' THEN {str(v[i]).lower()}" for lang, v in lexicon.FEATURES.items()) + f" END AS {n}" for i, n in enumerate(lexicon.FEATURE_NAMES))
_HING = "len(list_filter(regexp_extract_all(lower(transcript), '[a-z]+'), lambda w: w IN (" + ", ".join(map(lit, lexicon.HINGLISH)) + "))) >= 3"


def _hits(phrases: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(transcript, {lit(p)}) AS INT)" for p in phrases) + ")"


def q_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of failure of jobs."""
    j = spark.read.parquet(f"{folder}/analysis_jobs.parquet").select("job_id", "error").distinct()
    return j.groupBy(text.failure_class(F.col("error")).alias("kind")).agg(F.count("*").alias("jobs"))


QUERIES = {
    "failure_classes": q_failures, "language_detect": q_language, "prompt_budgets": q_budgets, "clean_text_lengths": q_clean, "speaker_labels": q_labels, "ja_tokens": q_tokens, "code_switches": q_switches, "keigo_levels": q_keigo,
    "fuzzy_name_matches": q_names, "exact_cache_keys": q_cache_keys,
}
def _fuzzy(c: str) -> str:
    out = f"lower(trim({c}, ' ' || chr(9) || chr(12288)))"
    for w in ("さん", "様", "くん", "ちゃん", "先生", "部長", "課長", "san", "-san"):
        out = f"replace({out}, '{w}', '')"
    return f"regexp_replace({out}, '[\\s\\x{{a0}}\\x{{3000}}_-]', '', 'g')"


_FUZZY = f"""SELECT a.account_id, a.owner, count(p.full_name) AS matches FROM (SELECT DISTINCT account_id, owner, {_fuzzy("owner")} AS x FROM action_items WHERE owner IS NOT NULL AND account_id IS NOT NULL) a
 LEFT JOIN (SELECT account_id, full_name, {_fuzzy("full_name")} AS y FROM people) p ON p.account_id = a.account_id AND x <> '' AND y <> '' AND (x = y OR contains(x, y) OR contains(y, x) OR length(x) >= 3 AND length(y) >= 3 AND left(x, 3) = left(y, 3)) GROUP BY a.account_id, a.owner"""
_JC = "[\\x{3040}-\\x{309f}\\x{30a0}-\\x{30ff}\\x{4e00}-\\x{9fff}]"
_strip = lambda c: f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_BLANK = "[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_CJK = "\\x{3040}-\\x{9fff}"
_NAMES = f"list_filter(list_transform(regexp_extract_all(transcript, '(?m)^\\s*(\\[[A-Z]+_\\d+\\]|[A-Za-z{_CJK}][^\\n:：\\[\\]]{{0,30}}?)\\s*[:：]', 1), lambda n: {_strip("regexp_replace(n, '\\s*\\([^)]*\\)', '', 'g')")}), lambda n: n <> '' AND NOT regexp_matches(n, '^[0-9]+$'))"
_FIRST = "list_filter(names, lambda n, i: list_position(list_transform(names, lambda x: lower(x)), lower(n)) = i)"
_LABEL = f"[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}-\\x{{9fff}}]{{1,40}}"
_HAS = lambda c: f"len(list_filter(list_filter(list_transform(string_split({c}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')[:40], lambda x: regexp_matches(x, '^\\*?\\*?{_LABEL}\\*?\\*?{_BLANK}*[：:]{_BLANK}*[^\\s]') OR regexp_matches(x, '^\\[{_LABEL}\\]{_BLANK}*[：:]{_BLANK}*[^\\s]') OR regexp_matches(x, '^【{_LABEL}】{_BLANK}*[：:]{_BLANK}*[^\\s]'))) >= 2"
_keep = lambda c: f"list_filter(list_transform({c}, lambda x: {_strip('x')}), lambda x: x <> '')"
#: meeting_id, transcript, names, hint, degenerate: what the label and prompt queries draw from.
HINT_SQL = f"""SELECT *, coalesce(list_aggregate({_FIRST}[:10], 'string_agg', ', '), 'Not detected') AS hint, n > 0 AND n <= 40 AND turns < 2 AND len({_FIRST}[:10]) < 2 AS degenerate FROM (SELECT meeting_id, transcript, {_NAMES} AS names, len({_WORDS}) AS n,
 len(regexp_extract_all(transcript, '(?m)(?:^|\\n)\\s*(?:\\[[A-Z]+_\\d+\\]|[A-Za-z{_CJK}][^\\n:：]{{0,30}}?)[:：]')) AS turns FROM {MEETINGS})"""
SQL = {
    "clean_text_lengths": f"""SELECT job_id, length(transcript) AS chars, length(c) AS clean_chars, len(string_split(c, chr(10))) AS lines FROM (SELECT job_id, transcript, {_strip("array_to_string(list_transform(string_split(regexp_replace(regexp_replace(nfc_normalize(transcript), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: " + _strip("x") + "), chr(10))")} AS c
  FROM (SELECT DISTINCT job_id, transcript FROM analysis_jobs WHERE transcript IS NOT NULL))""",
    "speaker_labels": f"""SELECT meeting_id, {_HAS("transcript")} AS has_labels, hint, degenerate, length(regexp_replace(transcript, '(?m)^([A-Za-z][A-Za-z\\s.''\\-]{{1,38}}?)\\s*:\\s*\\n([ \\t]*[^\\s])', '\\1: \\2', 'g')) AS joined_chars,
  length(CASE WHEN {_HAS("plain")} THEN plain ELSE array_to_string(list_transform(CASE WHEN len(paras) > 0 THEN paras ELSE ls END, lambda p, i: 'Speaker ' || i || ': ' || p), chr(10)) END) AS labelled_chars
  FROM (SELECT *, {_keep("regexp_split_to_array(plain, '\\n{2,}')")} AS paras, {_keep("string_split(plain, chr(10))")} AS ls FROM (SELECT *, replace(transcript, '**', '') AS plain FROM ({HINT_SQL})))""",
    "failure_classes": """SELECT kind, count(*) AS jobs FROM (SELECT CASE WHEN coalesce(error, '') = '' THEN 'none' WHEN regexp_matches(lower(error), 'rate|limit|quota|429') THEN 'rate_limit' WHEN regexp_matches(lower(error), 'time ?out|timed') THEN 'timeout'
 WHEN regexp_matches(lower(error), 'auth|key|401|403') THEN 'auth' ELSE 'other' END AS kind FROM (SELECT DISTINCT job_id, error FROM analysis_jobs)) GROUP BY kind""",
    "fuzzy_name_matches": _FUZZY,
    "language_detect": f"SELECT meeting_id, language, CASE language WHEN 'ja' THEN 'Japanese' WHEN 'en' THEN 'English' ELSE 'Mixed (JA/EN)' END AS display_name, {_FLAGS} FROM (SELECT meeting_id, {_LANG} AS language FROM {MEETINGS})",
    "prompt_budgets": f"""SELECT meeting_id, n AS words, CASE WHEN n < 200 THEN 3 WHEN n < 600 THEN 5 WHEN n < 1200 THEN 7 ELSE 8 END AS bullets, CASE WHEN n < 300 THEN 1500 WHEN n < 800 THEN 2000 WHEN n < 2000 THEN 2500 ELSE 3000 END AS max_tokens,
  hinglish, regexp_matches(transcript, '[\\x{{3040}}-\\x{{9fff}}]') OR lang IN ('ja', 'mixed') OR hinglish OR n > 600 AS large_model, CASE WHEN n > 100 THEN 107 ELSE n END AS kept_words
  FROM (SELECT meeting_id, transcript, len({_WORDS}) AS n, {_LANG} AS lang, {_HING} AS hinglish FROM {MEETINGS})""",
    "ja_tokens": f"""SELECT meeting_id, len(t) + len(p) AS tokens, len(list_distinct(list_concat(t, p))) AS distinct_tokens, terms AS topic_terms FROM (SELECT meeting_id, list_concat(c, list_filter(regexp_split_to_array(regexp_replace(low, '{_JC}', ' ', 'g'), '{_WS}+'), lambda w: w <> '')) AS t,
  list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]) AS p, len(list_filter(list_distinct(list_concat(list_concat(regexp_extract_all(transcript, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), regexp_extract_all(transcript, '[\\x{{30a0}}-\\x{{30ff}}]{{2,}}')),
  list_transform(regexp_extract_all(transcript, '[A-Za-z]{{4,}}'), lambda w: lower(w)))), lambda w: w NOT IN ({", ".join(map(lit, lexicon.TOPIC_STOPS))}))) AS terms
  FROM (SELECT meeting_id, transcript, lower(transcript) AS low, regexp_extract_all(lower(transcript), '{_JC}') AS c FROM {MEETINGS}))""",
    "keigo_levels": f"""SELECT meeting_id, CASE WHEN {_hits(lexicon.KEIGO_HIGH)} >= 1 THEN 'high' WHEN {_hits(lexicon.KEIGO_MEDIUM)} >= 2 THEN 'medium' ELSE 'low' END AS keigo,
  CASE WHEN {_hits(lexicon.KEIGO_HIGH_EXPECTED)} >= 2 THEN 'high' WHEN {_hits(lexicon.KEIGO_MEDIUM_EXPECTED)} >= 3 THEN 'medium' ELSE 'low' END AS expected FROM {MEETINGS}""",
    "exact_cache_keys": """SELECT job_id, md5(coalesce(language, 'en') || '::' || trim(transcript, ' ' || chr(10) || chr(13) || chr(9))) AS cache_key, left(regexp_replace(job_id, '[^a-zA-Z0-9_-]', '_', 'g'), 40) AS safe_id
  FROM (SELECT DISTINCT job_id, language, transcript FROM analysis_jobs WHERE transcript IS NOT NULL)""",
    "code_switches": f"""SELECT meeting_id, coalesce(len(list_filter(range(2, len(j) + 1), lambda i: j[i] <> j[i - 1])), 0) AS switches FROM (SELECT meeting_id, list_transform(list_filter(list_transform(list_filter(regexp_split_to_array(
  regexp_replace(regexp_replace(transcript, '\\[\\d{{2}}:\\d{{2}}(?::\\d{{2}})?\\]', '', 'g'), '(?m)^[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\x{{3000}}-\\x{{9fff}}]+[:：]{_WS}*', '', 'g'), '{_WS}+'), lambda w: w <> ''),
  lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\x{{3040}}-\\x{{9fff}}]', '', 'g')), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$')), lambda w: regexp_matches(w, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]')) AS j FROM {MEETINGS})""",
}
