"""Problem 2: JSON log rows whose layout drifts between files; one consistent table, and every change.

Method: column lifespan catalogue. Each file's fields, names and types (what a footer would hold) are gathered; per stream and field, name
or type, lag finds the islands of consecutive files; their starts and endings are the changes. Casts come from the alias table.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..stage import cut

# The documented columns of a log row.
FIELDS = {
    "timestamp": "timestamp", "session_id": "string", "transcript_chars": "int", "language": "string", "provider": "string", "duration_ms": "double", "summary_bullets": "int",
    "action_items_total": "int", "action_items_flagged": "int", "hallucination_rate": "double", "hallucination_risk": "string", "soft_rejection_risk": "string",
    "soft_rejection_count": "int", "speakers_detected": "int", "keigo_level": "string", "code_switches": "int", "error": "string", "status": "string",
}
# Names under which files hold a documented column; a path where it lies in another object.
ALIASES = {
    "keigo_level": ("keigo", "keigoLevel", "keigo_lvl", "politeness_level", "japan_insights.keigo_level"),
    "code_switches": ("codeSwitches", "code_switch_count", "lang_switches", "n_switches", "japan_insights.code_switch_count"),
    "soft_rejection_risk": ("Soft_Rejection_Risk", "rejection_risk", "softRejectionRisk", "soft_risk", "soft_rejections.risk_level"),
    "duration_ms": ("_duration_ms", "latency_ms"), "provider": ("_provider", "llm_provider"), "speakers_detected": ("speaker_count",),
}
#: Objects that hold fields rather than being one.
CONTAINERS = ("japan_insights", "soft_rejections")
#: Where a retyped field is an object, its own value is this key of it; where it is an array or a word, how it becomes a number or a word.
VALUE_KEYS = ("level", "value", "risk_level", "count")
# The words of a level, and the digit of the first.
LEVELS = {"keigo_level": (("low", "medium", "high"), 1), "soft_rejection_risk": (("NONE", "MINIMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL"), 0)}


def alias_map() -> dict[str, str]:
    return {f: f for f in FIELDS} | {a: f for f, names in ALIASES.items() for a in names}


def _loose(name: str) -> str:
    return name.lower().replace("_", "")


def loose_map() -> dict[str, str]:
    """The alias table by names without case and underscores, for spellings that the table doesn't list."""
    return {_loose(k): v for k, v in alias_map().items()}


def _canonical(name: Column) -> Column:
    table, loose = (F.create_map(*itertools.chain(*((F.lit(k), F.lit(v)) for k, v in m.items()))) for m in (alias_map(), loose_map()))
    return F.coalesce(table[name], loose[F.lower(F.replace(name, F.lit("_"), F.lit("")))], name)


def _kind(v: Column) -> Column:
    """string, number, boolean, array or object by the first character of the value as JSON; null for a JSON null."""
    c = F.substring(F.to_json(v), 1, 1)
    return F.when(c == '"', "string").when(c == "{", "object").when(c == "[", "array").when(c.isin("t", "f"), "boolean").when(c != "n", "number")


def _parsed(lines: DataFrame) -> DataFrame:
    """stream_id, file_seq, line_no, v: v is null for lines that are no whole JSON object or are error rows."""
    d = lines.where("stream_id IS NOT NULL AND file_seq IS NOT NULL").select("stream_id", "file_seq", "line_no", F.try_parse_json("line").alias("v"))
    status, kind = F.try_variant_get("v", "$.status", "string"), F.try_variant_get("v", "$.error_type", "string")
    good = F.schema_of_variant("v").startswith("OBJECT") & ~F.coalesce(status == "error", F.lit(False)) & kind.isNull()
    return d.withColumn("v", F.when(good, F.col("v")))


def readable(lines: DataFrame) -> DataFrame:
    """stream_id, file_seq, line_no, v: the lines that are whole JSON objects and no error rows. Null and cut-off lines are left out."""
    return _parsed(lines).where("v IS NOT NULL")


def catalogue(lines: DataFrame) -> DataFrame:
    """stream_id, file_seq, name, kind: what each file holds, once; a file that holds nothing readable has a row of nulls.

    kind is null where a value is null. A line is read once, inner objects in the same pass, and rows are reduced before the shuffle.
    """
    tvf = lines.sparkSession.tvf
    top = _parsed(lines).lateralJoin(tvf.variant_explode_outer(F.col("v").outer())).select("stream_id", "file_seq", "key", "value")
    top = top.select("stream_id", "file_seq", F.col("key").alias("outer_key"), F.col("value").alias("whole"), F.when(F.col("key").isin(*CONTAINERS), F.col("value")).alias("w"))
    deep = top.lateralJoin(tvf.variant_explode_outer(F.col("w").outer()))
    inner = F.col("w").isNotNull()
    # An element of an array has no key, so it is no field.
    name = F.when(inner, F.concat(F.col("outer_key"), F.lit("."), F.col("key"))).otherwise(F.col("outer_key"))
    d = deep.select("stream_id", "file_seq", name.alias("name"), _kind(F.when(inner, F.col("value")).otherwise(F.col("whole"))).alias("kind"))
    return d.select("stream_id", "file_seq", "name", F.when(F.col("name").isNotNull(), F.col("kind")).alias("kind")).distinct()


def _parts(seen: DataFrame) -> DataFrame:
    """The catalogue with part, a range of consecutive files of a stream, and halo: each part also has the file before its first one, as a halo, so that every comparison stays within a part and a long stream is shared by many tasks."""
    d = cut(cut(seen).repartitionByRange("stream_id", "file_seq").withColumn("part", F.spark_partition_id()))
    ends = d.groupBy("stream_id", "part").agg(F.max("file_seq").alias("last"))
    # One row for each range that a stream spans, so at most as many as there are tasks.
    ends = ends.withColumn("file_seq", F.lag("last").over(W.partitionBy("stream_id").orderBy("part"))).where("file_seq IS NOT NULL")
    halo = d.drop("part").join(ends.select("stream_id", "file_seq", "part"), ["stream_id", "file_seq"])
    return d.withColumn("halo", F.lit(False)).unionByName(halo.withColumn("halo", F.lit(True)))


def changes(lines: DataFrame) -> DataFrame:
    """stream_id, file_seq, field_name, change_kind: per file from a stream's second on, what differs from the file before.

    lag and lead over each field's files find its islands: one that starts is `added`, one that ended in the file before is `removed`. Where
    the field lies in both files, a name that the file before didn't use is `renamed`, and a type that it didn't have is `retyped`, if it had
    any. Files without a readable line hold nothing. An empty table gives no row.
    """
    d = _parts(catalogue(lines))
    per = d.groupBy("stream_id", "part", "halo", "file_seq", _canonical(F.col("name")).alias("field")).agg(F.collect_set("name").alias("names"), F.collect_set("kind").alias("kinds"))
    # The rows of one file are peers: the file before is the greatest number below this one, the next the least above (a growing frame either way).
    files, below = W.partitionBy("stream_id", "part"), (W.unboundedPreceding, -1)
    near = per.withColumn("next", F.min("file_seq").over(files.orderBy(F.desc("file_seq")).rangeBetween(*below))).withColumn("prev", F.max("file_seq").over(files.orderBy("file_seq").rangeBetween(*below)))
    line = W.partitionBy("stream_id", "part", "field").orderBy("file_seq")
    f = near.where("field IS NOT NULL").withColumn("was", F.lag(F.struct("file_seq", "names", "kinds")).over(line)).withColumn("then", F.lead("file_seq").over(line))
    held = F.coalesce(F.col("was.file_seq") == F.col("prev"), F.lit(False))
    new = lambda c: F.size(F.array_except(c, f"was.{c}")) > 0
    here = ~F.col("halo") & F.col("prev").isNotNull()
    gone = F.col("next").isNotNull() & ~F.coalesce(F.col("then") == F.col("next"), F.lit(False))
    event = lambda when, seq, kind: F.when(when, F.struct(F.col(seq).alias("file_seq"), F.lit(kind).alias("kind")))
    events = F.array_compact(F.array(
        event(here & ~held, "file_seq", "added"), event(gone, "next", "removed"), event(here & held & new("names"), "file_seq", "renamed"),
        event(here & held & (F.size("was.kinds") > 0) & new("kinds"), "file_seq", "retyped"),
    ))
    e = f.select("stream_id", "field", F.explode(events).alias("e"))
    return e.select("stream_id", F.col("e.file_seq").cast("int").alias("file_seq"), F.col("field").alias("field_name"), F.col("e.kind").alias("change_kind"))


def _cast(field: str) -> Column:
    """The documented column from whichever name holds a value; objects give their own value, arrays their length or joined text, levels in digits their word."""
    kind = FIELDS[field]
    found = []
    for path in (field, *ALIASES.get(field, ())):
        at = "$" + "".join(f"['{p}']" for p in path.split("."))
        text = F.try_variant_get("v", at, "string")
        inner = F.coalesce(*(F.try_variant_get("v", f"{at}.{k}", "string") for k in VALUE_KEYS))
        is_array = F.try_variant_get("v", at, "array<string>")
        if kind == "string":
            found.append(F.when(is_array.isNotNull(), F.concat_ws(",", is_array)).otherwise(F.coalesce(inner, F.when(~F.coalesce(text, F.lit("")).startswith("{"), text))))
        elif kind == "int":
            found.append(F.when(is_array.isNotNull(), F.size(is_array).cast("string")).otherwise(F.coalesce(inner, text)))
        else:
            found.append(text)
    c = F.coalesce(*found)
    if field in LEVELS:
        words, low = LEVELS[field]
        number = c.try_cast("int") - low
        c = F.when(number.between(0, len(words) - 1), F.element_at(F.array(*map(F.lit, words)), number + 1)).otherwise(F.upper(c) if words[0].isupper() else F.lower(c))
    return c.try_cast(kind).alias(field) if kind != "string" else c.alias(field)


def log_rows(lines: DataFrame) -> DataFrame:
    """stream_id, file_seq, line_no and the documented columns, one row per readable row that isn't an error row; repeated lines once."""
    d = readable(lines).select("stream_id", "file_seq", "line_no", *(_cast(f) for f in FIELDS))
    return d.distinct()


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/audit_log_lines.parquet").select("stream_id", "file_seq", "line_no", "line")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return changes(_lines(spark, folder))


def p2_log_rows(spark: SparkSession, folder: str) -> DataFrame:
    return log_rows(_lines(spark, folder))


def _sql() -> str:
    pairs = ", ".join(f"('{a}', '{f}')" for a, f in alias_map().items())
    loose = ", ".join(f"('{a}', '{f}')" for a, f in loose_map().items())
    inner = ", ".join(f"'{c}'" for c in CONTAINERS)
    return f"""
WITH alias(name, field) AS (VALUES {pairs}), spelt(name, field) AS (VALUES {loose}),
ok AS (SELECT stream_id, file_seq, line FROM audit_log_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT'
  AND coalesce(json_extract_string(line, '$.status'), '') <> 'error' AND json_extract_string(line, '$.error_type') IS NULL),
top AS (SELECT stream_id, file_seq, j.key AS key, j.value AS value, j.type AS type FROM ok, json_each(ok.line) j),
flat AS (SELECT stream_id, file_seq, key AS name, type FROM top WHERE key NOT IN ({inner})
  UNION ALL SELECT stream_id, file_seq, top.key || '.' || j.key, j.type FROM top, json_each(top.value) j WHERE top.key IN ({inner}) AND top.type = 'OBJECT'),
seen AS (SELECT DISTINCT stream_id, file_seq, coalesce(a.field, l.field, f.name) AS field, f.name,
  CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'ARRAY' THEN 'array' WHEN type = 'OBJECT' THEN 'object' END AS kind
  FROM flat f LEFT JOIN alias a ON a.name = f.name LEFT JOIN spelt l ON l.name = lower(replace(f.name, '_', ''))),
files AS (SELECT stream_id, file_seq, lag(file_seq) OVER (PARTITION BY stream_id ORDER BY file_seq) AS prev FROM (SELECT DISTINCT stream_id, file_seq FROM audit_log_lines)),
fld AS (SELECT DISTINCT stream_id, file_seq, field FROM seen),
now AS (SELECT f.stream_id, f.file_seq, f.prev, s.field FROM files f JOIN fld s ON s.stream_id = f.stream_id AND s.file_seq = f.file_seq WHERE f.prev IS NOT NULL),
was AS (SELECT f.stream_id, f.file_seq, f.prev, s.field FROM files f JOIN fld s ON s.stream_id = f.stream_id AND s.file_seq = f.prev),
added AS (SELECT stream_id, file_seq, field FROM now EXCEPT SELECT stream_id, file_seq, field FROM was),
removed AS (SELECT stream_id, file_seq, field FROM was EXCEPT SELECT stream_id, file_seq, field FROM now),
stay AS (SELECT n.stream_id, n.file_seq, n.prev, n.field FROM now n JOIN was w ON w.stream_id = n.stream_id AND w.file_seq = n.file_seq AND w.field = n.field),
renamed AS (SELECT DISTINCT t.stream_id, t.file_seq, t.field FROM stay t JOIN seen s ON s.stream_id = t.stream_id AND s.file_seq = t.file_seq AND s.field = t.field
  WHERE NOT EXISTS (SELECT 1 FROM seen p WHERE p.stream_id = t.stream_id AND p.file_seq = t.prev AND p.field = t.field AND p.name = s.name)),
retyped AS (SELECT DISTINCT t.stream_id, t.file_seq, t.field FROM stay t JOIN seen s ON s.stream_id = t.stream_id AND s.file_seq = t.file_seq AND s.field = t.field AND s.kind IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM seen p WHERE p.stream_id = t.stream_id AND p.file_seq = t.prev AND p.field = t.field AND p.kind = s.kind)
  AND EXISTS (SELECT 1 FROM seen p WHERE p.stream_id = t.stream_id AND p.file_seq = t.prev AND p.field = t.field AND p.kind IS NOT NULL))
SELECT stream_id, file_seq, field AS field_name, 'added' AS change_kind FROM added
UNION ALL SELECT stream_id, file_seq, field, 'removed' FROM removed
UNION ALL SELECT stream_id, file_seq, field, 'renamed' FROM renamed
UNION ALL SELECT stream_id, file_seq, field, 'retyped' FROM retyped"""


def _cast_sql(field: str) -> str:
    kind = FIELDS[field]
    found = []
    for path in (field, *ALIASES.get(field, ())):
        at = "$" + "".join(f'."{p}"' for p in path.split("."))
        inner = "coalesce(" + ", ".join(f"json_extract_string(line, '{at}.{k}')" for k in VALUE_KEYS) + ")"
        text, of = f"json_extract_string(line, '{at}')", f"json_type(line, '{at}')"
        if kind == "string":
            found.append(f"CASE {of} WHEN 'ARRAY' THEN array_to_string(json_extract_string(line, '{at}[*]'), ',') WHEN 'OBJECT' THEN {inner} ELSE {text} END")
        elif kind == "int":
            found.append(f"CASE {of} WHEN 'ARRAY' THEN CAST(json_array_length(line, '{at}') AS VARCHAR) WHEN 'OBJECT' THEN {inner} ELSE {text} END")
        else:
            found.append(text)
    c = "coalesce(" + ", ".join(found) + ")"
    if field in LEVELS:
        words, low = LEVELS[field]
        listed = ", ".join(f"'{w}'" for w in words)
        fold = "upper" if words[0].isupper() else "lower"
        c = f"CASE WHEN regexp_full_match({c}, '[0-9]+') AND try_cast({c} AS INT) BETWEEN {low} AND {low + len(words) - 1} THEN [{listed}][try_cast({c} AS INT) - {low} + 1] ELSE {fold}({c}) END"
    if kind == "int":
        return f"CASE WHEN regexp_full_match({c}, '[+-]?[0-9]+') THEN try_cast({c} AS INT) END AS {field}"
    return f"{c} AS {field}" if kind == "string" else f"try_cast({c} AS {kind}) AS {field}"


LOG_ROWS_SQL = f"""SELECT DISTINCT stream_id, file_seq, line_no, {", ".join(map(_cast_sql, FIELDS))} FROM audit_log_lines WHERE json_valid(line) AND json_type(line) = 'OBJECT'
  AND coalesce(json_extract_string(line, '$.status'), '') <> 'error' AND json_extract_string(line, '$.error_type') IS NULL"""
QUERIES = {"p2_found": p2_found, "p2_log_rows": p2_log_rows}
SQL = {"p2_found": _sql(), "p2_log_rows": LOG_ROWS_SQL}
