"""Lexicon scans: which phrases a transcript holds, what they add up to, who said them.

A phrase counts once per transcript, and phrases within phrases count too. The lists are literals of the plan, so a scan is a filter over a
constant array within the row: no join, no shuffle.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as x
from ..functions.text import context_of, speaker_before
from ..sources.seed import MEETINGS, meetings, rows, text

#: (kind, tier, phrases, ignoring case, confidence)
REJECTION = (
    ("termination", "T", x.TERMINATION_EN, True, 0.97), ("termination", "T", x.TERMINATION_JA, False, 0.99), ("approval_gate", "G", x.GATE_EN, True, 0.93), ("approval_gate", "G", x.GATE_JA, False, 0.95),
    ("high", "H", x.HIGH_EN, True, 0.88), ("high", "H", x.HIGH_JA, False, 0.88),
)
DEAL = (
    ("confirmation", "", x.ACCEPT_EN, True, 0.95), ("confirmation", "", x.ACCEPT_JA, False, 0.96), ("conditional", "", x.CONDITIONAL_EN, True, 0.90), ("conditional", "", x.CONDITIONAL_JA, False, 0.92),
    ("deferred", "", x.DEFERRED_EN, True, 0.88), ("deferred", "", x.DEFERRED_JA, False, 0.90), ("informational", "", x.INFORMATIONAL_EN, True, 0.85), ("informational", "", x.INFORMATIONAL_JA, False, 0.88),
)


def _entries(groups) -> list[tuple[str, str, str, bool, float]]:
    """(phrase, kind, tier, ignoring case, confidence), each phrase once."""
    out: dict[tuple[str, str], tuple] = {}
    for kind, tier, phrases, ci, conf in groups:
        for p in phrases:
            out.setdefault((kind, p), (p.lower() if ci else p, kind, tier, ci, conf))
    return list(out.values())


REJECTIONS = _entries(REJECTION) + [(p.lower() if any(c.isascii() and c.isalpha() for c in p) else p, "soft", "M" if c >= 0.8 else "L", any(ch.isascii() and ch.isalpha() for ch in p), c) for p, c in x.SOFT]
DEALS = _entries(DEAL)
ENGLISH = [(p.lower(), kind, sev, True, conf) for kind, group in (("hedging", x.HEDGING_EN), ("power", x.POWER_EN), ("passive", x.PASSIVE_EN), ("escalation", x.ESCALATION_EN)) for p, conf, sev in group]
HINDI = [(p.lower(), d, cat, sev, conf) for p, d, cat, conf, sev in x.HINDI]
_FIELDS = "phrase string, kind string, tier string, ci boolean, confidence double"


def lexicon_rows() -> list[tuple[str, str, str, bool, float]]:
    return REJECTIONS + DEALS + ENGLISH


def listing(spark: SparkSession) -> DataFrame:
    """The scanned phrases as a table."""
    return spark.createDataFrame(lexicon_rows(), _FIELDS)


@cache
def _literal_sql(entries: tuple) -> str:
    q = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "array(" + ", ".join(f"named_struct('phrase', {q(p)}, 'kind', {q(k)}, 'tier', {q(t)}, 'ci', {str(c).lower()}, 'confidence', {v}D)" for p, k, t, c, v in entries) + ")"


def _literal(entries) -> Column:
    """The entries as a constant array: one expression text, as thousands of column objects take longer to make than to search."""
    return F.expr(_literal_sql(tuple(entries)))


def _once(c: Column, f) -> Column:
    """f of a struct of the text, its lower case and the scripts in it, bound once, so that they aren't made again for each phrase."""
    t = F.coalesce(c, F.lit(""))
    bound = F.struct(F.lower(t).alias("low"), t.alias("text"), t.rlike("[A-Za-z]").alias("latin"), t.rlike("[\\u3040-\\u30ff\\u4e00-\\u9fff]").alias("ja"))
    return F.get(F.transform(F.array(bound), f), F.lit(0))


def _held(phrases: tuple[str, ...]):
    return lambda t: F.filter(F.array(*map(F.lit, phrases)), lambda e: F.contains(t["text"], e))


def scan(c: Column, entries) -> Column:
    """The entries that a text holds, in the order of the list. Null counts as empty, and the empty text holds none."""
    # A phrase without regard to case has Latin letters, any other is Japanese: a text without the script needs no search.
    return _once(c, lambda t: F.filter(_literal(entries), lambda e: F.when(e["ci"], t["latin"] & F.contains(t["low"], e["phrase"])).otherwise(t["ja"] & F.contains(t["text"], e["phrase"]))))


# Fixed value: a label at the start of a line.
_LABEL = r"^\*?\*?([^:*\[\]【】\n]{1,50}?)\*?\*?\s*[：:]\s*"


def speaker_of(c: Column, phrase: Column, ci: Column) -> Column:
    """The label of the first line that holds the phrase and has one, else Unknown."""
    lines = F.split(c, "\n")
    holds = F.filter(lines, lambda s: F.contains(F.when(ci, F.lower(s)).otherwise(s), phrase) & F.trim(s).rlike(_LABEL))
    name = F.regexp_replace(F.regexp_extract(F.trim(F.get(holds, F.lit(0))), _LABEL, 1), r"^[* \[\]【】]+|[* \[\]【】]+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown"))


def signals(df: DataFrame, entries=None) -> DataFrame:
    """meeting_id, phrase, kind, tier, confidence, speaker: one row per phrase that a transcript holds."""
    e = df.select("meeting_id", "transcript", F.explode(scan(F.col("transcript"), entries or REJECTIONS)).alias("s"))
    return e.select("meeting_id", "s.phrase", "s.kind", "s.tier", "s.confidence", speaker_of(F.col("transcript"), F.col("s.phrase"), F.col("s.ci")).alias("speaker"))


def _count(c: str, field: str, value: str) -> Column:
    return F.size(F.filter(c, lambda e: e[field] == value))


def risk(df: DataFrame) -> DataFrame:
    """df with counts by tier, total and risk_level. A text without signals is NONE; null counts as empty."""
    d = df.withColumn("_s", scan(F.coalesce("transcript", F.lit("")), REJECTIONS))
    for n, t in (("termination_n", "T"), ("gate_n", "G"), ("high_n", "H"), ("medium_n", "M"), ("low_n", "L")):
        d = d.withColumn(n, _count("_s", "tier", t))
    h, m = F.col("high_n"), F.col("medium_n")
    level = (
        F.when(F.col("termination_n") > 0, "CRITICAL").when((F.col("gate_n") > 0) & (h >= 3), "CRITICAL").when((F.col("gate_n") > 0) | (h >= 3), "HIGH")
        .when((h >= 1) | (m >= 2), "MEDIUM").when(m >= 1, "LOW").when(F.col("low_n") > 0, "MINIMAL").otherwise("NONE")
    )
    return d.withColumn("total_signals", F.size("_s")).withColumn("risk_level", level).drop("_s")


def outcome(df: DataFrame) -> DataFrame:
    """risk(df) with counts of deal signals and the verdict: the first of termination, condition, acceptance, deferral, gate, information, risk."""
    d = risk(df).withColumn("_d", scan(F.coalesce("transcript", F.lit("")), DEALS))
    for k in ("confirmation", "conditional", "deferred", "informational"):
        d = d.withColumn(f"{k}_n", _count("_d", "kind", k))
    verdict = (
        F.when(F.col("termination_n") > 0, "REJECTED").when(F.col("conditional_n") > 0, "CONDITIONAL").when(F.col("confirmation_n") > 0, "APPROVED").when(F.col("deferred_n") > 0, "DEFERRED")
        .when(F.col("gate_n") > 0, "PENDING").when(F.col("informational_n") > 0, "INFORMATIONAL").when(F.col("risk_level").isin("HIGH", "MEDIUM"), "AT_RISK").otherwise("UNCLEAR")
    )
    return d.withColumn("verdict", verdict).drop("_d")


def english(df: DataFrame) -> DataFrame:
    """English friction by category, its risk level, and the strength of commitments."""
    low = F.lower(F.coalesce("transcript", F.lit("")))
    d = df.withColumn("_s", scan(low, ENGLISH))
    for k in ("hedging", "power", "passive", "escalation"):
        d = d.withColumn(f"{k}_n", _count("_s", "kind", k))
    for k in ("HIGH", "MEDIUM", "LOW"):
        d = d.withColumn(f"{k.lower()}_n", _count("_s", "tier", k))
    h, m, lo = F.col("high_n"), F.col("medium_n"), F.col("low_n")
    level = F.when((F.col("escalation_n") > 0) | (h >= 2), "HIGH").when((h >= 1) | (m >= 3), "MEDIUM").when((m >= 1) | (lo >= 3), "LOW").when(F.size("_s") > 0, "MINIMAL").otherwise("NONE")
    weak, strong = (F.size(_once(low, _held(p))) for p in (x.WEAK_COMMITMENT, x.STRONG_COMMITMENT))
    d = d.withColumn("friction_level", level).withColumn("weak_n", weak).withColumn("strong_n", strong)
    return d.withColumn("commitment", F.when(F.col("strong_n") > F.col("weak_n"), "STRONG").when(F.col("weak_n") > 0, "WEAK").otherwise("MODERATE")).drop("_s")


def hindi(df: DataFrame) -> DataFrame:
    """Hindi indirection by category (Latin letters without case, else Devanagari), its risk level, and formality."""
    c = F.coalesce("transcript", F.lit(""))
    lit = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(cat).alias("kind"), F.lit(sev).alias("tier")) for p, d, cat, sev, _ in HINDI))
    d = df.withColumn("_s", _once(c, lambda t: F.filter(lit, lambda e: F.contains(t["low"], e["p"]) | F.contains(t["text"], e["d"]))))
    d = d.withColumn("hindi_n", F.size("_s"))
    for k in sorted({e[2] for e in HINDI}):
        d = d.withColumn(f"{k.lower()}_n", _count("_s", "kind", k))
    high, medium = _count("_s", "tier", "HIGH"), _count("_s", "tier", "MEDIUM")
    level = F.when((high >= 2) | ((F.col("indirect_no_n") > 0) & (F.col("face_saving_n") > 0)), "HIGH").when((high >= 1) | (medium >= 2), "MEDIUM").when(F.col("hindi_n") > 0, "LOW").otherwise("NONE")
    formal = F.size(F.filter(F.array(*map(F.lit, x.HINDI_FORMAL)), lambda e: F.contains(c, e)))
    intents = F.filter(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")) for p, i in x.HINDI_INTENTS)), lambda e: F.contains(c, e["p"]))
    d = d.withColumn("hindi_risk", level).withColumn("formal_n", formal).withColumn("intents", F.transform(intents, lambda e: e["i"]))
    d = d.withColumn("rejection_n", F.size(F.filter("intents", lambda i: i.isin("REJECTION", "LIKELY_REJECTION")))).withColumn("uncertain_n", F.size(F.filter("intents", lambda i: i.isin("UNCERTAIN", "DEFERRAL"))))
    return d.withColumn("formality", F.when(F.col("formal_n") >= 3, "high").when(F.col("formal_n") >= 1, "medium").otherwise("low")).drop("_s", "intents")


def nemawashi(c: Column) -> Column:
    """The nemawashi keywords that a text holds."""
    return F.filter(F.array(*map(F.lit, x.NEMAWASHI)), lambda p: F.contains(c, p))


def nemawashi_roots(c: Column) -> Column:
    """Roots found by their stem, as a stand-in where no morphological analyser is installed."""
    stems = F.array(*(F.struct(F.lit(b).alias("base_form"), F.lit(b[:-2] if b.endswith("する") else b.rstrip("い")).alias("stem"), F.lit(i).alias("intent"), F.lit(v).alias("confidence")) for b, i, v in x.NEMAWASHI_ROOTS))
    return F.transform(F.filter(stems, lambda r: F.contains(c, r["stem"])), lambda r: F.struct(r["base_form"], r["intent"], r["confidence"]))


def without_greetings(signals_: Column) -> Column:
    """Signals without the greetings that aren't any, compared without marks and blanks."""
    bare = lambda s: F.regexp_replace(s, r"[。、！？…「」『』\s]", "")
    out = F.array(*(F.lit("".join(c for c in g if c not in "。、！？…「」『』 ")) for g in x.NEMAWASHI_EXCLUDED))
    return F.filter(signals_, lambda s: s.rlike("[\\u3040-\\u9fff\\uff65-\\uff9f]") & ~F.exists(out, lambda g: (g == bare(s)) | (F.length(g) / F.greatest(F.length(bare(s)), F.lit(1)) > 0.85)))


# --- queries ---
def q_signal_rows(spark: SparkSession, folder: str) -> DataFrame:
    return signals(meetings(spark, folder))


def q_deal_signals(spark: SparkSession, folder: str) -> DataFrame:
    return signals(meetings(spark, folder), DEALS).drop("tier")


def q_risk(spark: SparkSession, folder: str) -> DataFrame:
    return risk(meetings(spark, folder)).drop("transcript")


def q_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return outcome(meetings(spark, folder)).select("meeting_id", "risk_level", "verdict", "total_signals", "confirmation_n", "conditional_n", "deferred_n", "informational_n")


def q_english(spark: SparkSession, folder: str) -> DataFrame:
    return english(meetings(spark, folder)).drop("transcript")


def q_hindi(spark: SparkSession, folder: str) -> DataFrame:
    return hindi(meetings(spark, folder)).drop("transcript")


def q_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark).groupBy("kind", "tier").agg(F.count("*").alias("phrases"), F.max("confidence").alias("top_confidence"))


def q_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """English friction phrases with the text around their first hit and the speaker before it."""
    m = meetings(spark, folder)
    e = m.select("meeting_id", "transcript", F.explode(scan(F.lower("transcript"), ENGLISH)).alias("s"))
    return e.select("meeting_id", "s.phrase", F.length(context_of(F.col("transcript"), F.col("s.phrase"))).alias("context_chars"), speaker_before(F.col("transcript"), F.col("s.phrase")).alias("speaker"))


def q_nemawashi(spark: SparkSession, folder: str) -> DataFrame:
    m = meetings(spark, folder)
    return m.select("meeting_id", F.size(nemawashi(F.col("transcript"))).alias("keywords"), F.size(nemawashi_roots(F.col("transcript"))).alias("roots"))


def _table(entries) -> str:
    return rows([(p, k, t, c, v) for p, k, t, c, v in entries], "l(phrase, kind, tier, ci, confidence)")


def _hits(entries) -> str:
    return f"SELECT m.meeting_id, m.transcript, l.* FROM {MEETINGS} m JOIN {_table(entries)} ON contains(CASE WHEN l.ci THEN lower(m.transcript) ELSE m.transcript END, l.phrase)"


_SPEAKER_SQL = r"""coalesce(nullif(trim(regexp_extract(trim(list_filter(string_split(transcript, chr(10)), lambda s: contains(CASE WHEN ci THEN lower(s) ELSE s END, phrase)
  AND regexp_matches(trim(s), '^\*?\*?([^:*\[\]【】\n]{1,50}?)\*?\*?\s*[：:]\s*'))[1]), '^\*?\*?([^:*\[\]【】\n]{1,50}?)\*?\*?\s*[：:]\s*', 1), '* []【】'), ''), 'Unknown')"""


def _tiers(kinds: tuple[str, ...], field: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {field} = '{k}') AS {n}" for k, n in kinds)


_T = (("T", "termination_n"), ("G", "gate_n"), ("H", "high_n"), ("M", "medium_n"), ("L", "low_n"))
_RISK = f"""SELECT m.meeting_id, {_tiers(_T, 'h.tier')}, count(h.phrase) AS total_signals FROM {MEETINGS} m LEFT JOIN ({_hits(REJECTIONS)}) h ON h.meeting_id = m.meeting_id AND h.transcript = m.transcript GROUP BY m.meeting_id, m.transcript"""
_LEVEL = """CASE WHEN termination_n > 0 OR gate_n > 0 AND high_n >= 3 THEN 'CRITICAL' WHEN gate_n > 0 OR high_n >= 3 THEN 'HIGH' WHEN high_n >= 1 OR medium_n >= 2 THEN 'MEDIUM' WHEN medium_n >= 1 THEN 'LOW' WHEN low_n > 0 THEN 'MINIMAL' ELSE 'NONE' END"""
_D = tuple((k, f"{k}_n") for k in ("confirmation", "conditional", "deferred", "informational"))
_DEALS = f"""SELECT m.meeting_id, m.transcript, {_tiers(_D, 'h.kind')} FROM {MEETINGS} m LEFT JOIN ({_hits(DEALS)}) h ON h.meeting_id = m.meeting_id AND h.transcript = m.transcript GROUP BY m.meeting_id, m.transcript"""
_E = tuple((k, f"{k}_n") for k in ("hedging", "power", "passive", "escalation"))
_S = (("HIGH", "high_n"), ("MEDIUM", "medium_n"), ("LOW", "low_n"))
_HK = tuple((k, f"{k.lower()}_n") for k in sorted({e[2] for e in HINDI}))


def _sum(phrases, what: str) -> str:
    return " + ".join(f"CAST(contains({what}, {text(p)}) AS INT)" for p in phrases)


_BL = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_strip = lambda c: f"regexp_replace({c}, '^{_BL}+|{_BL}+$', '', 'g')"
QUERIES = {
    "signal_rows": q_signal_rows, "deal_signals": q_deal_signals, "risk_tiers": q_risk, "meeting_verdict": q_verdict, "english_friction": q_english, "hindi_signals": q_hindi,
    "phrase_contexts": q_contexts, "lexicon_listing": q_lexicon, "nemawashi_signals": q_nemawashi,
}
SQL = {
    "signal_rows": f"SELECT meeting_id, phrase, kind, tier, CAST(confidence AS DOUBLE) AS confidence, {_SPEAKER_SQL} AS speaker FROM ({_hits(REJECTIONS)})",
    "deal_signals": f"SELECT meeting_id, phrase, kind, CAST(confidence AS DOUBLE) AS confidence, {_SPEAKER_SQL} AS speaker FROM ({_hits(DEALS)})",
    "risk_tiers": f"SELECT *, {_LEVEL} AS risk_level FROM ({_RISK})",
    "meeting_verdict": f"""SELECT meeting_id, risk_level, total_signals, confirmation_n, conditional_n, deferred_n, informational_n, CASE WHEN termination_n > 0 THEN 'REJECTED' WHEN conditional_n > 0 THEN 'CONDITIONAL'
  WHEN confirmation_n > 0 THEN 'APPROVED' WHEN deferred_n > 0 THEN 'DEFERRED' WHEN gate_n > 0 THEN 'PENDING' WHEN informational_n > 0 THEN 'INFORMATIONAL' WHEN risk_level IN ('HIGH', 'MEDIUM') THEN 'AT_RISK' ELSE 'UNCLEAR' END AS verdict
  FROM (SELECT r.*, {_LEVEL} AS risk_level, d.* EXCLUDE (meeting_id, transcript) FROM ({_RISK.replace('SELECT m.meeting_id,', 'SELECT m.meeting_id, m.transcript,')}) r JOIN ({_DEALS}) d ON d.meeting_id = r.meeting_id AND d.transcript = r.transcript)""",
    "english_friction": f"""SELECT *, CASE WHEN escalation_n > 0 OR high_n >= 2 THEN 'HIGH' WHEN high_n >= 1 OR medium_n >= 3 THEN 'MEDIUM' WHEN medium_n >= 1 OR low_n >= 3 THEN 'LOW' WHEN hedging_n + power_n + passive_n + escalation_n > 0 THEN 'MINIMAL' ELSE 'NONE' END AS friction_level,
  CASE WHEN strong_n > weak_n THEN 'STRONG' WHEN weak_n > 0 THEN 'WEAK' ELSE 'MODERATE' END AS commitment FROM (SELECT m.meeting_id, {_tiers(_E, 'h.kind')}, {_tiers(_S, 'h.tier')},
  {_sum(x.WEAK_COMMITMENT, 'lower(m.transcript)')} AS weak_n, {_sum(x.STRONG_COMMITMENT, 'lower(m.transcript)')} AS strong_n FROM {MEETINGS} m LEFT JOIN ({_hits(ENGLISH)}) h ON h.meeting_id = m.meeting_id AND h.transcript = m.transcript GROUP BY m.meeting_id, m.transcript)""",
    "hindi_signals": f"""SELECT * EXCLUDE (hi, me), CASE WHEN hi >= 2 OR indirect_no_n > 0 AND face_saving_n > 0 THEN 'HIGH' WHEN hi >= 1 OR me >= 2 THEN 'MEDIUM' WHEN hindi_n > 0 THEN 'LOW' ELSE 'NONE' END AS hindi_risk,
  CASE WHEN formal_n >= 3 THEN 'high' WHEN formal_n >= 1 THEN 'medium' ELSE 'low' END AS formality FROM (SELECT m.meeting_id, count(l.p) AS hindi_n, {_tiers(_HK, 'l.kind')},
  count(*) FILTER (WHERE l.tier = 'HIGH') AS hi, count(*) FILTER (WHERE l.tier = 'MEDIUM') AS me, {_sum(x.HINDI_FORMAL, 'm.transcript')} AS formal_n,
  {_sum([p for p, i in x.HINDI_INTENTS if i in ('REJECTION', 'LIKELY_REJECTION')], 'm.transcript')} AS rejection_n, {_sum([p for p, i in x.HINDI_INTENTS if i in ('UNCERTAIN', 'DEFERRAL')], 'm.transcript')} AS uncertain_n
  FROM {MEETINGS} m LEFT JOIN {rows([(p, d, c, s) for p, d, c, s, _ in HINDI], 'l(p, d, kind, tier)')} ON contains(lower(m.transcript), l.p) OR contains(m.transcript, l.d) GROUP BY m.meeting_id, m.transcript)""",
    "phrase_contexts": f"""WITH m AS (SELECT meeting_id, transcript, l.phrase, strpos(lower(transcript), l.phrase) AS hit FROM {MEETINGS} m JOIN {_table(ENGLISH)} ON contains(lower(m.transcript), l.phrase)),
 c AS (SELECT meeting_id, phrase, substr(transcript, greatest(hit - 100, 1), hit + length(phrase) + 100 - greatest(hit - 100, 1)) AS around, list_filter(regexp_extract_all(left(transcript, hit - 1), '([^\\s\\[\\]:：\\n]{{2,30}})\\s*[:：]', 1), lambda n: NOT regexp_matches(n, '^[0-9]+$')) AS names FROM m)
 SELECT meeting_id, phrase, least(120, length({_strip("around")})) AS context_chars, CASE WHEN len(names) > 0 THEN names[len(names)] ELSE 'Unknown' END AS speaker FROM c""",
    "lexicon_listing": f"SELECT kind, tier, count(*) AS phrases, CAST(max(confidence) AS DOUBLE) AS top_confidence FROM {_table(REJECTIONS + DEALS + ENGLISH)} GROUP BY kind, tier",
    "nemawashi_signals": f"""SELECT meeting_id, {_sum(x.NEMAWASHI, 'transcript')} AS keywords, {_sum([b[:-2] if b.endswith('する') else b.rstrip('い') for b, _, _ in x.NEMAWASHI_ROOTS], 'transcript')} AS roots FROM {MEETINGS}""",
}
