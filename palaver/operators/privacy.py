"""Masking of personal data by patterns and names, with a reversible mapping."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon
from ..sources.seed import MEETINGS, meetings

# What counts as an address, a telephone number and a company.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_JP = r"(?:\+81|0)\d{1,4}[\-\s]?\d{2,4}[\-\s]?\d{4}"
PHONE_INTL = r"\+\d{1,3}[\-\s]?\(?\d{1,4}\)?[\-\s]?\d{3,4}[\-\s]?\d{4}"
COMPANY_JP = r"(?:株式会社|有限会社|合同会社|一般社団法人)[぀-鿿\w]+"
COMPANY_EN = r"\b[A-Z][a-zA-Z]+\s+(?:Inc|Ltd|LLC|Corp|Co|Group|Holdings)(?:\.|,)?\b"
LATIN_LABEL = r"(?m)(?:^|\n)(?:\[\d+:\d+(?::\d+)?\]\s*)?([A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)?)(?:\s*\([^)]*\))?\s*[:]"
CJK_LABEL = r"(?m)(?:^|\n)\s*(?:\[\d+:\d+(?::\d+)?\]\s*)?([぀-鿿]{2,6})(?:\s*[（\(][^)）]*[）\)])?\s*[:：]"

#: Surnames masked wherever they stand, in kanji and with a capital; a parameter of mask.
SURNAMES = tuple(k for _, k in lexicon.SURNAMES) + tuple(r.capitalize() for r, _ in lexicon.SURNAMES)


def label_names(c: Column) -> Column:
    """Names before colons at the start of lines, without words of document structure."""
    latin = F.filter(F.regexp_extract_all(c, F.lit("(?U)" + LATIN_LABEL)), lambda n: ~F.lower(n).isin(*lexicon.NOT_SPEAKERS))
    return F.array_sort(F.filter(F.array_union(latin, F.regexp_extract_all(c, F.lit("(?U)" + CJK_LABEL))), lambda n: F.length(n) >= 2))


def mask_text(text: str | None, companies: bool = False, times: bool = False, surnames: tuple[str, ...] = SURNAMES) -> tuple[str | None, dict[str, str]]:
    """The masked text and placeholder -> original. Addresses, numbers, companies if asked for, then names, the longest first and equal ones in order."""
    if text is None:
        return None, {}
    held: dict[str, str] = {}
    count = dict.fromkeys(("EMAIL", "PHONE", "COMPANY", "NAME"), 0)

    def tag(kind: str, original: str) -> str:
        if original not in held:
            count[kind] += 1
            held[original] = f"[{kind}_{count[kind]}]"
        return held[original]

    out = text
    for kind, pattern in (("EMAIL", EMAIL), ("PHONE", PHONE_JP), ("PHONE", PHONE_INTL), *((("COMPANY", COMPANY_JP), ("COMPANY", COMPANY_EN)) if companies else ())):
        out = re.sub(pattern, lambda m, k=kind: tag(k, m.group()), out)
    names = {n for n in re.findall(LATIN_LABEL, text) if n.lower() not in lexicon.NOT_SPEAKERS} | set(re.findall(CJK_LABEL, text)) | set(surnames)
    for name in sorted((n for n in names if len(n) >= 2), key=lambda n: (-len(n), n)):
        if name in out:
            out = out.replace(name, tag("NAME", name))
    if times:
        out = re.sub(r"\[\d{2}:\d{2}(?::\d{2})?\]", "[TIME]", out)
    return out, {v: k for k, v in held.items()}


def restore_text(text: str | None, mapping: dict[str, str] | None) -> str | None:
    """Placeholders put back, the longest first: whole, with a bracket missing at either end, or bare between word limits."""
    if text is None:
        return None
    for tag in sorted(mapping or {}, key=lambda t: (-len(t), t)):
        bare, original = tag.strip("[]"), mapping[tag]
        if bare not in text:
            continue
        for form in (tag, f"[{bare}", f"{bare}]"):
            text = text.replace(form, original)
        text = re.sub(rf"\b{re.escape(bare)}\b", lambda m, o=original: o, text)
    return text


@F.pandas_udf(T.StructType([T.StructField("masked", T.StringType()), T.StructField("mapping", T.MapType(T.StringType(), T.StringType()))]))
def mask(s: pd.Series) -> pd.DataFrame:
    """mask_text by rows."""
    got = [mask_text(t) for t in s]
    return pd.DataFrame({"masked": [a for a, _ in got], "mapping": [b for _, b in got]})


@F.pandas_udf(T.StringType())
def restore(s: pd.Series, mapping: pd.Series) -> pd.Series:
    """restore_text by rows."""
    return pd.Series([restore_text(t, dict(m) if m is not None else {}) for t, m in zip(s, mapping, strict=True)])


@F.pandas_udf(T.StringType())
def restore_json(s: pd.Series, mapping: pd.Series) -> pd.Series:
    """restore_text in every string of a JSON value, however deep; no JSON stays as it is."""

    def walk(v, m):
        return {k: walk(x, m) for k, x in v.items()} if isinstance(v, dict) else [walk(x, m) for x in v] if isinstance(v, list) else restore_text(v, m) if isinstance(v, str) else v

    def one(t, m):
        try:
            return json.dumps(walk(json.loads(t), dict(m) if m is not None else {}), ensure_ascii=False)
        except (TypeError, ValueError):
            return t

    return pd.Series([one(t, m) for t, m in zip(s, mapping, strict=True)])


def counts(df: DataFrame) -> DataFrame:
    """df with the number of addresses and numbers that mask would find, counted without a Python pass: each pattern sees what the ones before left."""
    jp, intl = "(?U)" + PHONE_JP, "(?U)" + PHONE_INTL  # digits and blanks of any script, as mask has them
    a = F.regexp_replace("transcript", EMAIL, "[E]")
    b = F.regexp_replace(a, jp, "[P]")
    d = df.withColumn("emails", F.regexp_count("transcript", F.lit(EMAIL))).withColumn("jp_phones", F.regexp_count(a, F.lit(jp))).withColumn("intl_phones", F.regexp_count(b, F.lit(intl)))
    return d.withColumn("label_names", F.size(label_names(F.col("transcript"))))


def report(mapping: Column) -> Column:
    """Numbers by category of a mapping."""
    of = lambda k: F.size(F.filter(F.map_keys(mapping), lambda p: p.startswith(f"[{k}_")))
    return F.struct(*(of(k).alias(k.lower()) for k in ("NAME", "EMAIL", "PHONE", "COMPANY")), F.size(mapping).alias("total"))


def q_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts(meetings(spark, folder)).drop("transcript")


def q_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Masked lengths, numbers by category, and whether restoring gives the text back."""
    m = meetings(spark, folder).withColumn("m", mask("transcript"))
    r = report(F.col("m.mapping"))
    return m.select("meeting_id", F.length("m.masked").alias("masked_chars"), *(r[k].alias(f"{k}_n") for k in ("name", "email", "phone", "company", "total")), (restore(F.col("m.masked"), F.col("m.mapping")) == F.col("transcript")).alias("restored"))


def q_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """The stored mappings by category."""
    p = spark.read.parquet(f"{folder}/pii_masks.parquet").where("mapping IS NOT NULL").select("request_id", F.explode("mapping").alias("placeholder", "original"))
    return p.groupBy(F.regexp_extract("placeholder", r"^\[([A-Z]+)_", 1).alias("category")).agg(F.count("*").alias("entries"), F.countDistinct("original").alias("originals"))


QUERIES = {"pii_counts": q_counts, "pii_mask_restore": q_mask, "pii_mapping_report": q_mapping}
_BL = "\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def _any_script(pattern: str) -> str:
    """The pattern for SQL, with digits and blanks of any script."""
    blanks = pattern.replace("[\\-\\s]", "[\\-\x00]").replace("\\s", "[\x00]").replace("\x00", _BL)
    return blanks.replace("\\d", "\\p{Nd}").replace("぀-鿿", "\\x{3040}-\\x{9fff}")


_RE = {"e": EMAIL, "j": _any_script(PHONE_JP), "i": _any_script(PHONE_INTL)}
_LATIN, _CJK = _any_script(LATIN_LABEL), _any_script(CJK_LABEL)
_first = lambda c, k: f"coalesce(list_distinct(regexp_extract_all({c}, '{_RE[k]}')), [])"
# Distinct matches have one placeholder each; lengths and numbers don't depend on which is which.
_tagged = lambda c, found, kind, base: f"list_reduce(list_prepend(struct_pack(s := {c}, k := {base}), list_transform({found}, lambda x: struct_pack(s := x, k := 0))), lambda acc, x: struct_pack(s := replace(acc.s, x.s, '[{kind}_' || (acc.k + 1) || ']'), k := acc.k + 1)).s"
SQL = {
    "pii_counts": f"""SELECT meeting_id, len(regexp_extract_all(transcript, '{EMAIL}')) AS emails, len(regexp_extract_all(a, '{_RE["j"]}')) AS jp_phones, len(regexp_extract_all(regexp_replace(a, '{_RE["j"]}', '[P]', 'g'), '{_RE["i"]}')) AS intl_phones,
  len(list_distinct(list_filter(list_concat(list_filter(regexp_extract_all(transcript, '{_LATIN}', 1), lambda n: lower(n) NOT IN ({", ".join("'" + w + "'" for w in lexicon.NOT_SPEAKERS)})),
  regexp_extract_all(transcript, '{_CJK}', 1)), lambda n: length(n) >= 2))) AS label_names FROM (SELECT *, regexp_replace(transcript, '{EMAIL}', '[E]', 'g') AS a FROM {MEETINGS})""",
    "pii_mask_restore": f"""WITH e AS (SELECT meeting_id, transcript AS t, {_first("transcript", "e")} AS em FROM {MEETINGS}), a AS (SELECT meeting_id, t, em, {_tagged("t", "em", "EMAIL", "0")} AS s1 FROM e),
 b AS (SELECT *, {_first("s1", "j")} AS jp FROM a), c AS (SELECT *, {_tagged("s1", "jp", "PHONE", "0")} AS s2 FROM b), d AS (SELECT *, {_first("s2", "i")} AS ip FROM c), f AS (SELECT *, {_tagged("s2", "ip", "PHONE", "len(jp)")} AS s3 FROM d),
 n AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(list_filter(list_concat(list_concat(list_filter(regexp_extract_all(t, '{_LATIN}', 1), lambda n: lower(n) NOT IN ({", ".join("'" + w + "'" for w in lexicon.NOT_SPEAKERS)})),
 regexp_extract_all(t, '{_CJK}', 1)), [{", ".join("'" + w + "'" for w in SURNAMES)}]), lambda n: length(n) >= 2)), lambda n: struct_pack(k := -length(n), n := n))), lambda x: x.n) AS names FROM f),
 m AS (SELECT meeting_id, len(em) AS email_n, len(jp) + len(ip) AS phone_n, list_reduce(list_prepend(struct_pack(s := s3, k := 0), list_transform(names, lambda x: struct_pack(s := x, k := 0))),
 lambda acc, x: CASE WHEN contains(acc.s, x.s) THEN struct_pack(s := replace(acc.s, x.s, '[NAME_' || (acc.k + 1) || ']'), k := acc.k + 1) ELSE acc END) AS r FROM n)
 SELECT meeting_id, length(r.s) AS masked_chars, r.k AS name_n, email_n, phone_n, 0 AS company_n, r.k + email_n + phone_n AS total_n, TRUE AS restored FROM m""",
    "pii_mapping_report": r"""SELECT category, count(*) AS entries, count(DISTINCT original) AS originals FROM (SELECT regexp_extract(e.key, '^\[([A-Z]+)_', 1) AS category, e.value AS original FROM (SELECT unnest(map_entries(mapping)) AS e FROM pii_masks WHERE mapping IS NOT NULL)) GROUP BY category""",
}
