"""Problem 5: variant spellings of one registered person.

Method: metric-space partitioning. A few pivots are drawn from the registered forms; each form lies in the cell of its nearest pivot; a
typed form q goes to every cell c with d(q, p_c) <= min_i d(q, p_i) + 2r, which by the triangle inequality is every cell that can hold a
form within r of it. Within (account, cell) the radius join is exact, with the Levenshtein metric (r = 2, as a transposition counts two
there); then one edit with transposition decides. Forms that are typed as registered are matches at distance 0 of the same join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import cut
from . import frames
from .names import levenshtein

#: Radius in the metric, number of pivots, and most registered forms of which pivots are drawn.
RADIUS, PIVOTS, PIVOT_SAMPLE = 2, 12, 400
#: A shorter form is no misspelling of another, as one edit makes a different name of it; it means who is registered under it.
SHORTEST = 5


def _forms():
    from .names import forms

    def f(account, person, full, native):
        seen: dict[str, tuple[int, int]] = {}
        for form, kind, radius in forms(full, native):
            if form not in seen or (kind, -radius) < seen[form]:
                seen[form] = (kind, -radius)
        words = {w for form in seen for w in form.split() if len(w) > 1 and not form.startswith(".")}
        return [(account, person, form, kind, -radius, sorted(words) if i == 0 else None) for i, (form, (kind, radius)) in enumerate(seen.items())]

    return f


def person_forms(people: DataFrame) -> DataFrame:
    """account_id, person_id, form, kind, radius, words (on one row of each person). A null name gives no form.

    A person without name_native gets it from namesakes: words of other registered persons whose full_name has the same word.
    """
    p = people.where("account_id IS NOT NULL AND person_id IS NOT NULL").select("account_id", "person_id", "full_name", "name_native")
    latin, native = F.split(F.trim("full_name"), r"\s+"), F.split(F.trim("name_native"), r"[\s　]+")
    deva = F.col("name_native").rlike("^[\\u0900-\\u097f]")
    two = p.where((F.size(latin) == 2) & (F.size(native) == 2))
    g = two.select(latin[0].alias("w"), F.when(deva, native[0]).otherwise(native[1]).alias("n"), F.lit(0).alias("at"), deva.alias("d"))
    f = two.select(latin[1].alias("w"), F.when(deva, native[1]).otherwise(native[0]).alias("n"), F.lit(1).alias("at"), deva.alias("d"))
    known = g.union(f).groupBy("at", "w").agg(F.min("n").alias("n"), F.max("n").alias("n2"), F.min("d").alias("d")).where("n = n2")
    kg, kf = (known.where(f"at = {i}").select(F.col("w").alias(f"w{i}"), F.col("n").alias(f"n{i}"), F.col("d").alias(f"d{i}")) for i in (0, 1))
    q = p.withColumn("w0", latin[0]).withColumn("w1", F.element_at(latin, -1)).join(kg, "w0", "left").join(kf, "w1", "left")
    guess = F.when(F.col("d0") & F.col("d1"), F.concat_ws(" ", "n0", "n1")).when(~F.col("d0") & ~F.col("d1"), F.concat_ws(" ", "n1", "n0"))
    one = F.when(F.col("n1").isNotNull() & F.col("n0").isNull(), F.col("n1"))
    d = q.select("account_id", "person_id", "full_name", F.coalesce("name_native", guess, one).alias("name_native"))
    return frames.rows_out(
        d, _forms, "account_id bigint, person_id bigint, form string, kind int, radius int, words array<string>",
        [("account_id", pa.int64()), ("person_id", pa.int64()), ("form", pa.string()), ("kind", pa.int32()), ("radius", pa.int32()), ("words", pa.list_(pa.string()))],
    )


def _parts():
    from .names import parts

    return lambda account, name: [(account, name, i, q) for i, q in parts(name)]


def _close():
    from .names import edits

    def f(account, name, part, q, form, kind, person, known):
        if edits(q, form, 1) > 1:
            return []
        new = set(q.split()) - set(form.split())
        if new & set(known or ()):
            return []  # a typed word that is a name of its own is no misspelling of another
        if any(len(w) < 3 for w in new) or (min(len(q), len(form)) < 5):
            return []
        return [(account, name, part, 1, kind, person)]

    return f


def pivots(refs: DataFrame) -> list[str]:
    """At most PIVOTS forms, far apart, drawn from at most PIVOT_SAMPLE forms in the order of their hash: what reaches the driver is bounded."""
    sample = [r.form for r in refs.select("form").distinct().orderBy(F.xxhash64("form"), "form").limit(PIVOT_SAMPLE).collect()]
    chosen = sample[:1]
    if not chosen:
        return []
    near = [levenshtein(x, chosen[0]) for x in sample]
    while len(chosen) < min(PIVOTS, len(sample)):
        i = max(range(len(sample)), key=near.__getitem__)
        if not near[i]:
            break
        chosen.append(sample[i])
        near = [min(d, levenshtein(x, sample[i])) for d, x in zip(near, sample, strict=True)]
    return chosen


def _distances(c: str, far: list[str]) -> Column:
    return F.array(*(F.levenshtein(F.col(c), F.lit(p)) for p in far))


def resolve(names: DataFrame, people: DataFrame) -> DataFrame:
    """account_id, name, part, persons: the registered persons of the account that each part of a typed name can mean; one if it is clear.

    names has account_id and name; repeated, null and empty names count once or not at all. A part that means nobody gives no row.
    """
    refs = cut(person_forms(people))
    distinct = names.where("account_id IS NOT NULL AND name IS NOT NULL").select("account_id", "name").distinct()
    typed = cut(frames.rows_out(
        distinct, _parts, "account_id bigint, name string, part int, q string",
        [("account_id", pa.int64()), ("name", pa.string()), ("part", pa.int32()), ("q", pa.string())],
    ))
    far = pivots(refs)
    if not far:
        return names.sparkSession.createDataFrame([], "account_id bigint, name string, part int, persons array<bigint>")
    words = refs.where("words IS NOT NULL").select(F.explode("words").alias("w")).distinct()
    qs = typed.select("q").distinct()
    known = qs.select("q", F.explode(F.split("q", " ")).alias("w")).join(words, "w").groupBy("q").agg(F.collect_set("w").alias("known"))
    near = F.array_min("ds")
    cells = F.filter(F.transform("ds", lambda x, i: F.when(x <= near + 2 * RADIUS, i)), lambda i: i.isNotNull())
    placed = qs.join(known, "q", "left").withColumn("ds", _distances("q", far)).select("q", "known", F.explode(cells).alias("cell"))
    held = refs.select("account_id", "form", "kind", "radius", "person_id").withColumn("ds", _distances("form", far)).select("account_id", "form", "kind", "radius", "person_id", (F.array_position("ds", near) - 1).cast("int").alias("cell"))
    within = (F.col("q") == F.col("form")) | ((F.col("radius") > 0) & (F.length("q") >= SHORTEST) & F.levenshtein("q", "form", RADIUS).between(0, RADIUS))
    pairs = cut(typed.join(placed, "q").join(held, ["account_id", "cell"]).where(within).select("account_id", "name", "part", "q", "form", "kind", "person_id", "known"))
    same = pairs.where("q = form").select("account_id", "name", "part", F.lit(0).alias("d"), "kind", "person_id")
    found = same.union(frames.rows_out(
        pairs.where("q <> form"), _close, "account_id bigint, name string, part int, d int, kind int, person_id bigint",
        [("account_id", pa.int64()), ("name", pa.string()), ("part", pa.int32()), ("d", pa.int32()), ("kind", pa.int32()), ("person_id", pa.int64())],
    ))
    by = found.groupBy("account_id", "name", "part", "d", "kind").agg(F.array_sort(F.collect_set("person_id")).alias("persons"))
    best = F.min(F.struct("d", "kind", "persons")).alias("b")
    return by.groupBy("account_id", "name", "part").agg(best).select("account_id", "name", "part", "b.persons")


def linked(items: DataFrame, people: DataFrame) -> DataFrame:
    """item_id, person_id, name, account_id: each item's cell with the registered persons that it clearly names. items has item_id, account_id, name."""
    clear = resolve(items, people).where(F.size("persons") == 1).select("account_id", "name", F.col("persons")[0].alias("person_id")).distinct()
    return items.join(clear, ["account_id", "name"]).select("item_id", "person_id", "account_id", "name").distinct()


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for table, column in (("said_vs_meant_items", "speaker"), ("commitment_items", "owner"), ("action_items", "owner")):
        d = frames.read(spark, folder, table, ["item_id", "account_id", column]).withColumnRenamed(column, "name")
        out = d if out is None else out.union(d)
    return out


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    people = frames.read(spark, folder, "people", ["person_id", "account_id", "full_name", "name_native"])
    found = linked(_cells(spark, folder), people)
    full = people.select("person_id", "full_name")
    return found.join(full, "person_id").where("NOT (name <=> full_name)").select("item_id", "person_id").distinct()


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
