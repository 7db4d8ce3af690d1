"""Predictions against references: token overlap, longest common subsequence, greedy matches, overall score.

A case is one meeting of a test set with a handful of claims; matching is greedy in the order of the claims, so a case is one group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import code_switches, grade, ja_tokens, keigo_expected, names_match, rouge1
from ..sources.seed import rows
from .signals import REJECTIONS, nemawashi, scan
from .signals import SQL as SIGNAL_SQL
from .texts import SQL as TEXT_SQL


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] + 1 if x == y else max(row[-1], last[j]))
    return row[-1]


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b, strict=True)], dtype="int32")


def semantic_overlap(p: Column, r: Column) -> Column:
    """.4 unigram F1, .3 bigram F1, .3 common-subsequence ratio of two token arrays, to three places; 0 where one is empty."""
    pairs = lambda t: F.array_distinct(F.filter(F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws("\x01", a, b))), lambda x: x.isNotNull()))
    f1 = lambda a, b: F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))
    one, two = f1(F.array_distinct(p), F.array_distinct(r)), f1(pairs(p), pairs(r))
    sub = 2.0 * lcs_length(p, r) / (F.size(p) + F.size(r))
    return F.when((F.size(p) == 0) | (F.size(r) == 0), 0.0).otherwise(F.bround(0.4 * one + 0.3 * two + 0.3 * sub, 3))


def summary_scores(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """case_id, semantic_score, avg_rouge1_f1, grade of bullets (case_id, pos, bullet): one to one, the best scores first, ties to the later reference and then prediction."""
    p = pred.select("case_id", F.col("pos").alias("p"), ja_tokens(F.col("bullet")).alias("pt"))
    r = ref.select("case_id", F.col("pos").alias("r"), ja_tokens(F.col("bullet")).alias("rt"))
    s = r.join(p, "case_id", "left").withColumn("score", F.coalesce(semantic_overlap(F.col("pt"), F.col("rt")), F.lit(0.0))).withColumn("r1", F.coalesce(rouge1(F.array_distinct("pt"), F.array_distinct("rt")), F.lit(0.0)))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        used_r, used_p, sem, ro = set(), set(), 0.0, 0.0
        n = pdf["r"].nunique()
        for row in pdf.sort_values(["score", "r", "p"], ascending=False).itertuples():
            if row.r not in used_r and row.p not in used_p and not pd.isna(row.p):
                used_r.add(row.r)
                used_p.add(row.p)
                sem, ro = sem + row.score, ro + row.r1
        return pd.DataFrame({"case_id": [pdf["case_id"].iloc[0]], "semantic_score": [round(sem / n, 3)], "avg_rouge1_f1": [round(ro / n, 3)]})

    g = s.select("case_id", "r", "p", "score", "r1").groupBy("case_id").applyInPandas(assign, "case_id string, semantic_score double, avg_rouge1_f1 double")
    return g.withColumn("grade", grade(F.col("semantic_score")))


def action_scores(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """case_id, matched, predicted, expected, precision, recall, f1 of tasks (case_id, pos, task; ref also has `extra` for the other language's references). Each prediction in turn takes the free reference of the best score from a quarter on."""
    p = pred.select("case_id", F.lit(0).alias("side"), "pos", F.array_distinct(ja_tokens(F.col("task"))).alias("t"), F.lit(False).alias("extra"))
    r = ref.select("case_id", F.lit(1).alias("side"), "pos", F.array_distinct(ja_tokens(F.col("task"))).alias("t"), "extra")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(["extra", "pos"])
        refs = [set(t) for t in d[d["side"] == 1]["t"]]
        preds = [set(t) for t in d[d["side"] == 0]["t"]]
        free, n = set(range(len(refs))), 0
        for t in preds:
            best = max(((len(t & refs[i]) / len(refs[i]), -i) for i in free if refs[i]), default=(0.0, 0))
            if best[0] >= 0.25:
                free.discard(-best[1])
                n += 1
        expected = int(((pdf["side"] == 1) & ~pdf["extra"]).sum())
        prec, rec = (n / len(preds) if preds else 0.0), (n / expected if expected else 0.0)
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        return pd.DataFrame({"case_id": [pdf["case_id"].iloc[0]], "matched": [n], "predicted": [len(preds)], "expected": [expected], "precision": [round(prec, 3)], "recall": [round(rec, 3)], "f1": [round(f1, 3)]})

    return p.union(r).groupBy("case_id").applyInPandas(match, "case_id string, matched int, predicted int, expected int, precision double, recall double, f1 double")


def sentiment_scores(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """case_id, total, correct, accuracy, soft_accuracy: each reference (case_id, speaker, score, acceptable) takes the first prediction (case_id, pos, speaker, score) of a like name; acceptable scores earn half."""
    r = ref.select("case_id", F.col("speaker").alias("who"), F.col("score").alias("want"), "acceptable")
    j = r.join(pred.select("case_id", "pos", "speaker", "score"), "case_id", "left").withColumn("like", F.coalesce(names_match(F.col("speaker"), F.col("who")), F.lit(False)))
    b = j.groupBy("case_id", "who", "want", "acceptable").agg(F.min(F.when(F.col("like"), F.struct("pos", "score"))).alias("b"))
    got = F.col("b.score")
    b = b.withColumn("hit", F.coalesce((got == F.col("want")).cast("double"), F.lit(0.0))).withColumn("soft", F.when(F.col("hit") == 1, 1.0).when(F.coalesce(F.array_contains("acceptable", got), F.lit(False)), 0.5).otherwise(0.0))
    g = b.groupBy("case_id").agg(F.count("*").alias("total"), F.sum("hit").cast("int").alias("correct"), F.bround(F.avg("hit"), 3).alias("accuracy"), F.bround(F.avg("soft"), 3).alias("soft_accuracy"))
    return g.withColumn("grade", grade(F.col("soft_accuracy")))


def japan_check(meetings: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """meeting_id, keigo_expected, code_switch_count, nemawashi_found from the text; with predictions (meeting_id, keigo, signals, switches) also precision and recall of signals, a keigo grade and the difference of switches.

    A signal is right where it holds a found phrase or lies in one; where none is right, the found phrases themselves get the credit.
    """
    t = F.col("transcript")
    found = F.concat(F.transform(scan(t, [e for e in REJECTIONS if e[2] in "HML"]), lambda e: e["phrase"]))
    d = meetings.select("meeting_id", keigo_expected(t).alias("keigo_expected"), code_switches(t).alias("code_switch_count"), F.size(nemawashi(t)).alias("nemawashi_found"), F.when(F.size(found) > 0, found).otherwise(nemawashi(t)).alias("detected"))
    if predicted is None:
        return d.drop("detected")
    d = d.join(predicted.select("meeting_id", "keigo", F.coalesce("signals", F.array().cast("array<string>")).alias("signals"), "switches"), "meeting_id", "left")
    right = F.filter("signals", lambda s: F.exists("detected", lambda x: F.contains(s, x) | F.contains(x, s)))
    d = d.withColumn("right", F.when((F.size(right) == 0) & (F.size("detected") > 0), F.col("detected")).otherwise(right))
    n, s, f = F.size("right"), F.size("signals"), F.size("detected")
    d = d.withColumn("precision", F.when(s > 0, F.bround(n / s, 3)).when(f > 0, 1.0).otherwise(0.0)).withColumn("recall", F.when(f > 0, F.bround(n / f, 3)).otherwise(1.0))
    near = ((F.col("keigo_expected") == "high") & F.col("keigo").isin("high", "medium")) | ((F.col("keigo_expected") == "medium") & F.col("keigo").isin("high", "medium", "low")) | ((F.col("keigo_expected") == "low") & F.col("keigo").isin("medium", "low"))
    d = d.withColumn("keigo_grade", F.when(F.col("keigo") == F.col("keigo_expected"), "PASS").when(near, "PARTIAL").otherwise("FAIL")).withColumn("switch_difference", F.abs(F.coalesce("switches", F.lit(0)) - F.col("code_switch_count")))
    return d.withColumn("grade", grade(F.col("recall"))).drop("detected", "right", "signals", "keigo", "switches")


def overall(summary: DataFrame, actions: DataFrame, sentiment: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """case_id, overall_score, overall_grade: the mean of three scores in percent, plus up to ten points for a low hallucination risk (case_id, overall_hallucination_risk)."""
    j = summary.select("case_id", "semantic_score").join(actions.select("case_id", "f1"), "case_id").join(sentiment.select("case_id", "soft_accuracy"), "case_id")
    base = F.bround((F.col("semantic_score") + F.col("f1") + F.col("soft_accuracy")) / 3 * 100, 1)
    if risk is None:
        j = j.withColumn("overall_score", base)
    else:
        j = j.join(risk.select("case_id", "overall_hallucination_risk"), "case_id", "left")
        j = j.withColumn("overall_score", F.bround(F.least(F.lit(100.0), base + F.coalesce(F.bround((1 - F.col("overall_hallucination_risk")) * 0.1, 3), F.lit(0.0)) * 100), 1))
    return j.withColumn("overall_grade", grade(F.col("overall_score") / 100))


CASES_PRED = (("C1", 0, "Mori will send the revised quote", "Mori"), ("C1", 1, "Check the battery stock", "Abe"), ("C2", 0, "見積もりを送る", "佐藤"))
CASES_REF = (("C1", 0, "Send the revised quote to the client", "Mori"), ("C1", 1, "Book a room", "Abe"), ("C2", 0, "見積書を送付する", "佐藤さん"))


def _case(spark: SparkSession, rows, name: str) -> DataFrame:
    return spark.createDataFrame([*rows], f"case_id string, pos int, {name} string, speaker string")


def q_scores(spark: SparkSession, folder: str) -> DataFrame:
    p, r = _case(spark, CASES_PRED, "bullet"), _case(spark, CASES_REF, "bullet")
    pt, rt = p.withColumnRenamed("bullet", "task"), r.withColumnRenamed("bullet", "task").withColumn("extra", F.lit(False))
    score = F.when(F.col("pos") == 0, "positive").otherwise("neutral")
    s = sentiment_scores(p.withColumn("score", score), r.select("case_id", "speaker", score.alias("score")).withColumn("acceptable", F.array(F.lit("neutral"))))
    a = action_scores(pt, rt)
    return overall(summary_scores(p, r), a, s).join(a.select("case_id", "matched"), "case_id")


def q_request_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Summary and action scores of every request that has both: its action items as predictions, its commitments as references, in the order of their ids."""

    def read(table: str, text: str) -> DataFrame:
        d = spark.read.parquet(f"{folder}/{table}.parquet").where(f"request_id IS NOT NULL AND {text} IS NOT NULL").select(F.col("request_id").alias("case_id"), "item_id", F.col(text).alias("task")).distinct()
        return d.select("case_id", (F.row_number().over(W.partitionBy("case_id").orderBy("item_id", "task")) - 1).alias("pos"), "task")

    p, r = read("action_items", "task"), read("commitment_items", "text")
    both = p.select("case_id").distinct().join(r.select("case_id").distinct(), "case_id")
    p, r = p.join(both, "case_id", "left_semi"), r.join(both, "case_id", "left_semi")
    s = summary_scores(p.withColumnRenamed("task", "bullet"), r.withColumnRenamed("task", "bullet"))
    return s.join(action_scores(p, r.withColumn("extra", F.lit(False))), "case_id")


def q_rouge(spark: SparkSession, folder: str) -> DataFrame:
    """Each action item against the commitment at its place in the same request: unigram overlap counts and F1. Items beyond the other side's number have no counterpart and no row."""
    line = W.partitionBy("request_id")
    a = spark.read.parquet(f"{folder}/action_items.parquet").where("request_id IS NOT NULL AND task IS NOT NULL").select("request_id", "item_id", "task").distinct()
    c = spark.read.parquet(f"{folder}/commitment_items.parquet").where("request_id IS NOT NULL AND text IS NOT NULL").select("request_id", F.col("item_id").alias("ref_id"), F.col("text").alias("ref")).distinct()
    a, c = a.withColumn("place", F.row_number().over(line.orderBy("item_id", "task"))), c.withColumn("place", F.row_number().over(line.orderBy("ref_id", "ref")))
    j = a.join(c, ["request_id", "place"]).withColumn("x", F.array_distinct(ja_tokens(F.col("task")))).withColumn("y", F.array_distinct(ja_tokens(F.col("ref"))))
    return j.select("item_id", "ref_id", F.size("x").alias("n_pred"), F.size("y").alias("n_ref"), F.size(F.array_intersect("x", "y")).alias("common"), rouge1(F.col("x"), F.col("y")).alias("f1"))


def q_japan(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.seed import meetings

    return japan_check(meetings(spark, folder))


_JC = "[\\x{3040}-\\x{309f}\\x{30a0}-\\x{30ff}\\x{4e00}-\\x{9fff}]"
_WS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _tok(c: str) -> str:
    k = f"regexp_extract_all(lower({c}), '{_JC}')"
    return f"list_filter(list_distinct(list_concat(list_concat({k}, regexp_split_to_array(regexp_replace(lower({c}), '{_JC}', ' ', 'g'), '{_WS}+')), list_transform(range(1, len({k})), lambda i: {k}[i] || {k}[i + 1]))), lambda w: w <> '')"


QUERIES = {"evaluation_scores": q_scores, "request_scores": q_request_scores, "rouge1_counts": q_rouge, "japan_check": q_japan}
#: What plain Python (tests/test_scores.py) makes of the two cases: case, semantic score, F1, soft accuracy, overall, grade, matched.
GOLDEN = (("C1", 0.307, 0.5, 1.0, 60.2, "GOOD", 1), ("C2", 0.419, 1.0, 1.0, 80.6, "EXCELLENT", 1))
SQL = {
    "evaluation_scores": f"""SELECT case_id, CAST(s AS DOUBLE) AS semantic_score, CAST(f AS DOUBLE) AS f1, CAST(a AS DOUBLE) AS soft_accuracy, CAST(o AS DOUBLE) AS overall_score, overall_grade, matched FROM {rows(GOLDEN, "g(case_id, s, f, a, o, overall_grade, matched)")}""",
    "japan_check": f"SELECT meeting_id, k.expected AS keigo_expected, c.switches AS code_switch_count, n.keywords AS nemawashi_found FROM ({TEXT_SQL['keigo_levels']}) k JOIN ({TEXT_SQL['code_switches']}) c USING (meeting_id) JOIN ({SIGNAL_SQL['nemawashi_signals']}) n USING (meeting_id)",
    "rouge1_counts": f"""SELECT item_id, ref_id, len(x) AS n_pred, len(y) AS n_ref, len(list_intersect(x, y)) AS common, CASE WHEN len(list_intersect(x, y)) = 0 THEN 0 ELSE round_even(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 3) END AS f1 FROM (SELECT a.item_id, c.ref_id, {_tok("a.task")} AS x, {_tok("c.ref")} AS y
 FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY item_id, task) AS place FROM (SELECT DISTINCT request_id, item_id, task FROM action_items WHERE request_id IS NOT NULL AND task IS NOT NULL)) a
 JOIN (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ref_id, ref) AS place FROM (SELECT DISTINCT request_id, item_id AS ref_id, text AS ref FROM commitment_items WHERE request_id IS NOT NULL AND text IS NOT NULL)) c USING (request_id, place))""",
}
