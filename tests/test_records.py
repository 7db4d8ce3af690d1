"""Store, streams, uploads and records: cases with nulls, ties, empty tables and clashing names."""

import json
import math

import pytest
from pyspark.sql import functions as F

from palaver import stage
from palaver.operators import evaluation, grounding, logs, records, retrieval
from palaver.sources import transcripts
from palaver.streaming import log_stream


def test_users_keep_what_was_first_known(spark):
    rows = [("u", 2, "b@x.test", "B", 1), ("u", 1, "a@x.test", "A", 1), ("u", 3, None, None, 1), ("t", 1, "z@x.test", None, 1), ("t", 1, "y@x.test", "Y", 1), (None, 1, "n@x.test", "N", 1)]
    d = spark.createDataFrame(rows, "user_id string, seen_at int, email string, name string, visits int")
    got = {r.user_id: tuple(r)[1:] for r in retrieval.users(d).collect()}
    assert got == {"u": ("a@x.test", "A", 1, 3, 3), "t": ("y@x.test", "Y", 1, 1, 2)}
    assert retrieval.users(d.limit(0)).count() == 0


def test_purge_counts(spark):
    d = spark.createDataFrame([("u", 1), ("u", 2), ("v", 3), (None, 4)], "user_id string, k int")
    for user, kept, gone in (("u", {3, 4}, 2), ("none", {1, 2, 3, 4}, 0), (None, set(), 4)):
        left, n = retrieval.purge(d, user)
        assert ({r.k for r in left.collect()}, n.first().cleared) == (kept, gone)
    assert retrieval.purge(d.limit(0))[1].first().cleared == 0


def test_meeting_count(spark):
    d = spark.createDataFrame([("a", "ja", 5), ("a", "ja", 5), ("b", None, 7)], "meeting_id string, language string, char_length int")
    assert tuple(retrieval.meeting_count(d).first()) == (2, 1, 12) and tuple(retrieval.meeting_count(d.limit(0)).first()) == (0, 0, 0)


def test_topk_in_blocks_keeps_ties_and_keys(spark, monkeypatch):
    """Several passes give what one gives; equal vectors tie by id; a null key equals null."""
    rows = [(i, [math.cos(i % 7), math.sin(i % 7)], "k" if i % 2 else None) for i in range(60)] + [(100, None, "k"), (101, [], "k"), (102, [0.0, 0.0], "k"), (None, [1.0, 0.0], "k")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, k string")
    q = d.where("vec_id % 20 = 0 OR vec_id >= 100").withColumnRenamed("vec_id", "query_id")
    whole = {tuple(r) for r in retrieval.topk(d, q, 3, same="k").collect()}
    monkeypatch.setattr(retrieval, "BLOCK", 1)
    assert {tuple(r) for r in retrieval.topk(d, q, 3, same="k").collect()} == whole
    assert {(r[0], r[1]) for r in whole if r[0] == 0} == {(0, 0), (0, 14), (0, 28)}
    assert retrieval.topk(d, q.limit(0), 3).count() == 0


def test_patterns_by_category(spark):
    lib = retrieval.patterns(spark)
    d = lib.select(F.col("pattern_id").alias("text_id"), "embedding").union(spark.createDataFrame([("none", None)], "text_id string, embedding array<double>"))
    best = retrieval.match_patterns(d, lib, k=1).collect()
    assert {(r.text_id, r.pattern_id) for r in best} == {(r.pattern_id, r.pattern_id) for r in lib.collect()}
    assert all(r.pattern_id.startswith("deadline") for r in retrieval.match_patterns(d, lib, category="DEADLINE").collect())
    assert lib.count() == 34


def test_uploads_all_have_a_row(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Mori: hé".encode() + b"\xff")
    (tmp_path / "b.VTT").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<v Mori>hello</v>\n")
    (tmp_path / "c.json").write_text('{"text": "Mori: hi"}')
    (tmp_path / "d.mp3").write_bytes(b"\0" * 10)
    (tmp_path / "e.txt").write_text("x" * 101)
    (tmp_path / "f.txt").write_text("")
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.text) for r in transcripts.uploads(spark, str(tmp_path), most=100).collect()}
    assert got["a.txt"] == ("read", "Mori: hé�") and got["b.VTT"] == ("read", "Mori: hello") and got["c.json"] == ("read", "Mori: hi")
    assert got["d.mp3"] == ("audio", None) and got["e.txt"] == ("too_large", None) and "f.txt" not in got


def test_stream_drains_to_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = log_stream.log_stream(spark, str(folder))
    assert log_stream.drain(rows, "none", "append").count() == 0
    row = {"session_id": "a", "duration_ms": 1.0, "status": "success"}
    (folder / "a.jsonl").write_text(json.dumps(row) + "\n" + json.dumps(row | {"session_id": "b"}) + "\n")
    kept = str(tmp_path / "progress")
    assert {r.session_id for r in log_stream.drain(rows, "first", "append", kept).collect()} == {"a", "b"}
    (folder / "b.jsonl").write_text(json.dumps(row | {"session_id": "c"}) + "\n")
    assert {r.session_id for r in log_stream.drain(rows, "second", "append", kept).collect()} == {"c"}  # progress goes on


def test_stage_tables_can_be_cleared(spark):
    d = stage.cut(spark.range(5))
    assert d.count() == 5
    stage.clear(spark)
    assert not stage._written
    with pytest.raises(Exception):
        d.count()


def test_directions_of_a_group_in_parts(spark, monkeypatch):
    """The ends of a group are the same however many parts its rows are dealt to; ties, nulls and groups without values."""
    rows = [("a", i // 2, float(i % 11)) for i in range(200)] + [("b", i, None) for i in range(5)] + [("c", i, 1.0 + i) for i in range(4)]
    d = spark.createDataFrame(rows, "g string, i int, v double")
    seen = []
    for parts in (1, 5, 64):
        monkeypatch.setattr(logs, "PARTS", parts)
        seen.append({tuple(r) for r in logs.direction(d, ["g"], ["i"], F.col("v")).collect()})
    assert seen[0] == seen[1] == seen[2] and {r[0] for r in seen[0]} == {"a", "c"}
    assert logs.direction(d, [], ["i"], F.col("v")).first().n == 204 and logs.direction(d.limit(0), ["g"], ["i"], F.col("v")).count() == 0


def test_records_of_nulls_and_nothing(spark):
    m = spark.createDataFrame([("a", "Director: We have decided not to renew ."), ("b", ""), ("c", None)], "meeting_id string, transcript string")
    got = {r.meeting_id: r for r in records.cultural_notes(m).collect()}
    assert got["a"].note == "termination" and got["a"].detected[0].severity == "HIGH" and got["b"].note == got["c"].note == "none" and list(got["c"].detected) == []
    assert records.cultural_notes(m.limit(0)).count() == 0 and records.speakers_in_order(m.where("meeting_id <> 'a'")).count() == 0
    gate = spark.createDataFrame([(" " * 30,), ("x" * 20,), ("  " + "x" * 19 + "　",), (None,)], "t string")
    assert [r[0] for r in gate.select(records.long_enough(F.col("t"))).collect()] == [False, True, False, False]
    items = spark.createDataFrame([("a", "1", True), ("a", "2", None)], "meeting_id string, item_id string, flag boolean")
    claims = spark.createDataFrame([("a", "renew", 0.2), ("a", "office chairs", 0.2), ("gone", "x", 0.2)], "meeting_id string, claim string, least double")
    rows = {r.session_id: r for r in records.audit_rows(m, items, claims).collect()}
    assert (rows["a"].action_items_total, rows["a"].action_items_flagged, rows["a"].hallucination_rate, rows["a"].soft_rejection_risk) == (2, 1, 0.5, "CRITICAL")
    assert (rows["b"].hallucination_risk, rows["c"].transcript_chars, set(rows)) == ("UNKNOWN", None, {"a", "b", "c"})
    assert set(rows["a"].asDict()) <= {x.split(" ")[0] for x in logs.SCHEMA.split(", ")}


def test_metrics_and_average(spark):
    d = spark.createDataFrame([("a", 90.0, 1, None), ("b", 85.25, 2, 0.5)], "case_id string, overall_score double, matched int, f1 double")
    assert {tuple(r) for r in records.metric_rows(d).collect()} == {("a", "overall_score", 90.0), ("a", "matched", 1.0), ("b", "overall_score", 85.25), ("b", "matched", 2.0), ("b", "f1", 0.5)}
    assert tuple(records.average(d).first()) == (2, 87.6) and records.average(d.limit(0)).first().average is None
    scores = evaluation.q_scores(spark, "")
    assert records.average(scores).first().cases == 2


def test_grounding_edges(spark):
    """Empty, null and stop-word claims and sources; a claim over several meetings; clashing names."""
    m = spark.createDataFrame([("a", "Mori: send the quote . 見積もり"), ("b", "the of and"), ("c", ""), ("d", "のは")], "meeting_id string, transcript string")
    claims = [("send the quote", "a", 1.0), ("the of", "a", 0.5), ("the of", "b", 0.0), ("", "a", 0.0), (None, "a", 0.0), ("x", "c", 0.0), ("x", "gone", 0.0), ("見積", "a", 1.0), ("見も", "a", 0.5), ("the", "d", 0.5)]
    d = spark.createDataFrame([(str(i), i_m, c, 0.5) for i, (c, i_m, _) in enumerate(claims)], "claim_id string, meeting_id string, claim string, latin double")
    got = {int(r.claim_id): r.grounding_score for r in grounding.verify_claims(d, m).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(claims)}
