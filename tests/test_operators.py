"""Privacy, people, turns, grounding, evaluation, retrieval, logs, results: golden cases and plain Python."""

import json
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palaver.functions.text import pseudo_embedding, pseudo_vectors
from palaver.operators import dynamics, evaluation, grounding, logs, people, privacy, reports, results, retrieval, schema_drift
from palaver.plans import pipeline
from palaver.sources.seed import seed
from palaver.streaming import log_stream


@pytest.mark.parametrize("src,want", [("[NAME_1] said", "Mori said"), ("[NAME_1 said", "Mori said"), ("NAME_1] said", "Mori said"), ("NAME_1 said", "Mori said"), ("[NAME_10]", "Abe"), ("MY_NAME_1_field", "MY_NAME_1_field")])
def test_restore(src, want):
    assert privacy.restore_text(src, {"[NAME_1]": "Mori", "[NAME_10]": "Abe"}) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abM田中森@.0123456789-+: \nTanaka", max_size=80))
def test_mask_round_trip(s):
    masked, mapping = privacy.mask_text(s)
    assert privacy.restore_text(masked, mapping) == s


def test_mask_cases(spark):
    masked, mapping = privacy.mask_text("Mori: write to mori@example.com or 03-1234-5678\nNote: x")
    assert "mori@example.com" not in masked and "03-1234-5678" not in masked and "Note" in masked and masked.startswith("[NAME_1]:")
    assert set(mapping.values()) >= {"mori@example.com", "03-1234-5678", "Mori"}
    d = spark.createDataFrame([(None,), ("",)], "t string")
    assert [tuple(r.m) for r in d.select(privacy.mask("t").alias("m")).collect()] == [(None, {}), ("", {})]
    j = spark.createDataFrame([('{"a": ["[NAME_1]", {"b": "NAME_1 x"}]}', {"[NAME_1]": 'O"x'})], "t string, m map<string,string>")
    assert json.loads(j.select(privacy.restore_json("t", "m")).first()[0]) == {"a": ['O"x', {"b": 'O"x x'}]}


@pytest.mark.parametrize("raw,want,rank", [("Tanaka (Director)", "Tanaka", 5), ("田中部長", "田中", 5), ("Dev)", "", 0), ("(PM)", "", 2), ("Lee【CTO】", "Lee", 7), ("Mori", "Mori", 0), ("director", "", 5)])
def test_labels(spark, raw, want, rank):
    r = spark.createDataFrame([(raw,)], "t string").select(people.normal_name(F.col("t")).alias("n"), people.role(F.col("t")).alias("r")).first()
    assert r.n == want and r.r["rank"] == rank


def test_best_match_and_unify(spark):
    t = spark.createDataFrame([("m", "田中: a\nSato (PM): b\nDirector: c")], "meeting_id string, transcript string")
    names = spark.createDataFrame([("m", 0, "Tanaka", 30.0), ("m", 1, "sato", 20.0), ("m", 2, "田中", 10.0), ("m", 3, "Director", 5.0), ("m", 4, "Kim", 1.0)], "meeting_id string, pos int, name string, talk_time_pct double")
    got = {r.name: r.matched for r in people.best_match(names, people.speakers(t)).collect()}
    assert got == {"Tanaka": "田中", "sato": "Sato", "田中": "田中", "Director": "", "Kim": "Kim"}
    assert {r.name: r.talk_time_pct for r in people.unify(names, people.speakers(t)).collect()}["田中"] == 40.0


def test_turns_and_talk_time(spark):
    d = spark.createDataFrame([("a", "lost\nMori: one\ntwo\n10: x\nPM: three\nAbe: four"), ("b", "")], "meeting_id string, transcript string")
    got = [(r.turn_idx, r.speaker, r.text) for r in dynamics.turns(d).orderBy("meeting_id", "turn_idx").collect()]
    assert got == [(0, "Mori", "one two 10: x three"), (1, "Abe", "four")]
    talk = {(r.meeting_id, r.name): r.talk_time_pct for r in dynamics.talk_time(seed(spark)).collect()}
    assert talk["S17", "Mori"] == 60 and talk["S17", "Abe"] == 40


def test_structure(spark):
    t, h = dynamics.turns(seed(spark)), people.role_hints(seed(spark))
    s = dynamics.topic_stalls(t).where("meeting_id = 'S18'").first()
    assert (s.stalled_turn, s.pivot_turn, s.circled_back_turn) == (1, 2, 4)
    q = dynamics.senior_silence(t, h).where("meeting_id = 'S18'").first()
    assert q.senior_speaker == "Tanaka" and q.silence_length_turns == 6
    c = dynamics.closing_summarizer(t, h).where("meeting_id = 'S18'").first()
    assert c.speaker == "Tanaka" and c.turn_idx == 6


def test_grounding(spark):
    m = spark.createDataFrame([("m", "Tanaka: send the revised quote by Friday\nSato: ok")], "meeting_id string, transcript string")
    items = spark.createDataFrame([("m", "1", "send the revised quote", "Tanaka", "Friday"), ("m", "2", "buy office chairs", "Lee", None), ("m", "3", None, None, ""), ("x", "4", "a task", "b", "c"), ("m", "5", "the of", "Sato", "tbd")], "meeting_id string, item_id string, task string, owner string, deadline string")
    got = {r.item_id: (r.task_score, r.hallucination_flag, r.confidence) for r in grounding.verify_actions(items, m).collect()}
    assert got["1"] == (1.0, False, 1.0) and got["2"] == (0.0, True, 0.1) and got["3"] == (0.0, True, 0.1) and got["4"][1] and got["5"][0] == 0.5
    r = grounding.risk(grounding.verify_actions(items, m)).where("meeting_id = 'm'").first()
    assert (r.flagged_total, r.total_claims, r.risk_label) == (2, 4, "HIGH")
    assert {x.item_id: x.rescued for x in grounding.rescue(items.select("meeting_id", "item_id", "task"), m).collect()}["1"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_lcs(a, b):
    def slow(i, j):
        return 0 if i == len(a) or j == len(b) else slow(i + 1, j + 1) + 1 if a[i] == b[j] else max(slow(i + 1, j), slow(i, j + 1))

    assert evaluation.lcs(a, b) == slow(0, 0)


def test_evaluation(spark):
    got = {r.case_id: r for r in evaluation.q_scores(spark, "").collect()}
    assert got["C1"].matched == 1 and 0 < got["C1"].overall_score <= 100 and got["C2"].overall_grade in ("EXCELLENT", "GOOD", "FAIR", "POOR")


def test_topk_brute_force(spark):
    rows = [(i, [math.sin(i * k) for k in range(1, 5)], i % 3) for i in range(60)] + [(60, None, 0), (61, [0.0] * 4, 1), (62, [], 2)]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = store.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for same in (None, "label"):
        got = {}
        for r in retrieval.topk(store, q, 4, same=same).collect():
            got.setdefault(r.query_id, []).append((r.place, r.vec_id))
        for i in (0, 20, 40):
            if any(rows[i][1]):
                want = sorted((-round(cos(rows[i][1], e), 12), v) for v, e, lab in rows[:60] if any(e) and (same is None or lab == rows[i][2]))[:4]
                assert [v for _, v in sorted(got[i])] == [v for _, v in want]
    assert retrieval.topk(store.limit(0), q.limit(0), 3).count() == 0


def test_topk_of_mixed_lengths(spark):
    """Every query finds the rows of its own length, whatever stands first in the block."""
    rows = [(i, [math.sin(i * k) for k in range(1, 3 + i % 3)], 0) for i in range(1, 31)]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for same in (None, "label"):
        got = {}
        for r in retrieval.topk(store, store.withColumnRenamed("vec_id", "query_id"), 3, same=same).collect():
            got.setdefault(r.query_id, []).append((r.place, r.vec_id))
        for i, e, _ in rows:
            assert [v for _, v in sorted(got[i])] == [v for _, v in sorted((-round(cos(e, x), 12), v) for v, x, _ in rows if len(x) == len(e))[:3]]


def test_semantic_cache_searches_every_row(spark, tmp_path):
    """The nearest other vector counts though it is itself a query; by default from .92 on."""
    angle = {0: 0.0, 20: 0.1, 40: 1.0, 3: 0.5, 7: 2.0, 60: 0.0}
    rows = [(i, [math.cos(a), math.sin(a)], "x") for i, a in angle.items()]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    store.write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {}
    for i in (0, 20, 40, 60):
        want[i] = min((round(-math.cos(angle[i] - a), 12), j) for j, a in angle.items() if j != i)
    assert {r.query_id: r.vec_id for r in retrieval.q_semantic_cache(spark, str(tmp_path)).collect()} == {i: j for i, (_, j) in want.items()}
    q = store.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    assert {r.query_id for r in retrieval.nearest_other(store, q).collect()} == {i for i, (s, _) in want.items() if -s >= 0.92}


def test_search_holds_tiles_only(spark, monkeypatch):
    """The memory of a task doesn't grow with the queries of a block times the rows of a batch, and blocks count numbers, not vectors."""
    store = spark.range(8_000).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k) for k in range(1, 9))).alias("embedding"))
    searches, real = [], type(store).mapInArrow
    monkeypatch.setattr(type(store), "mapInArrow", lambda self, f, *a, **kw: searches.append(f) or real(self, f, *a, **kw))
    retrieval.topk(store, store.withColumnRenamed("vec_id", "query_id"), 1)
    batch = store.toArrow().combine_chunks().to_batches()[0]
    tracemalloc.start()
    found = [r for b in searches[0](iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(searches) == 1 and len(found) == 7_999 and peak < 150e6
    monkeypatch.setattr(retrieval, "BLOCK", 8_000)
    searches.clear()
    retrieval.topk(store, store.where("vec_id < 3000").withColumnRenamed("vec_id", "query_id"), 1)
    assert len(searches) == 3


def test_search_across_tiles_and_batches(spark):
    """Near and equal cosines, several rows of one id, several tiles and batches: as counted in double precision, pair by pair."""
    rng = np.random.default_rng(7)
    x = 1 + 0.003 * rng.standard_normal((5_000, 6))  # all cosines lie within what single precision and the ninth place can tell
    x[3_000:3_400] = x[:400] * rng.integers(1, 5, 400)[:, None]
    ids = rng.permutation(5_000)
    ids[4_000:4_050] = ids[:50]
    store = spark.createDataFrame([(int(i), e.tolist()) for i, e in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").coalesce(2)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    at = np.flatnonzero(ids % 2 == 0)
    c = np.round(u[at] @ u.T, retrieval.PLACES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2300")
    try:
        q = store.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id")
        for k, other in ((3, False), (2, True)):
            got, want = {}, {}
            for r in retrieval.topk(store, q, k, other=other).collect():
                got.setdefault(r.query_id, []).append(r.similarity)
                assert not (other and r.query_id == r.vec_id)
            for a, row in zip(at, c, strict=True):
                want.setdefault(int(ids[a]), []).extend(np.sort(row[ids != ids[a]] if other else row)[-k:])
            assert got.keys() == want.keys()
            assert all(np.allclose(sorted(got[i]), sorted(want[i])[-k:], atol=2e-9) for i in want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_stand_for_their_vectors(spark):
    """A search over texts finds what one over their pseudo-embeddings finds."""
    texts = [None, "", "a", "abc", "b" * 500, "काम ठीक", "会議は三時😀", "会議は四時😀", "c" * 383 + "😀x", "\x00", "e\u0301\n", "é\n"]
    d = spark.createDataFrame([*enumerate(texts)], "vec_id long, t string")
    vectors, heads = d.select("vec_id", pseudo_embedding(F.col("t")).alias("embedding")), d.select("vec_id", F.col("t").alias("embedding"))
    for r in vectors.join(d, "vec_id").where("t IS NOT NULL").collect():
        assert pseudo_vectors(pa.array([r.t])).tolist() == [r.embedding]
    found = [{tuple(r) for r in retrieval.topk(x, x.withColumnRenamed("vec_id", "query_id"), 4).collect()} for x in (vectors, heads)]
    assert found[0] == found[1] and len({q for q, *_ in found[0]}) == len(texts) - 3


def test_nearest_other_of_repeated_rows(spark):
    """Rows of the query's own id don't take the places of others, however many there are."""
    store = spark.createDataFrame([(20, [1.0, 2.0])] * 3 + [(7, [1.0, 2.1]), (5, [1.0, 9.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in retrieval.nearest_other(store, store.where("vec_id = 20").withColumnRenamed("vec_id", "query_id")).collect()] == [(20, 7)]


def test_cache_ttl_and_last_write(spark):
    e = spark.createDataFrame([("k", "2025-01-01 00:00:00", "old"), ("k", "2025-01-02 00:00:00", "new"), ("z", "2024-01-01 00:00:00", "stale")], "k string, at string, v string").withColumn("at", F.to_timestamp("at"))
    a = spark.createDataFrame([("k",), ("z",), ("none",)], "k string")
    got = {r.k: (r.hit, r.v) for r in retrieval.cache_get(a, e, "k", "at", F.to_timestamp(F.lit("2025-01-02 12:00:00"))).collect()}
    assert got == {"k": (True, "new"), "z": (False, "stale"), "none": (False, None)}
    assert retrieval.upsert(e, e, "k", "at").count() == 2


def test_trend(spark):
    d = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate([1, 1, 1, 9, 9, 9])] + [("s", i, 5.0) for i in range(9)] + [("few", 0, 1.0)] + [("five", i, float(v)) for i, v in enumerate([9, 9, 9, 1, 1])], "g string, i int, v double")
    assert {r.g: r.trend for r in logs.direction(d, ["g"], ["i"], F.col("v")).collect()} == {"u": "up", "s": "stable", "few": "stable", "five": "down"}


def test_trend_pack(spark):
    rows = [("s", f"2025-01-0{i}T09:30:00", i, p, lang, k, r, soft, 0.125, 1500.0, 2, 3, i, "x") for i, (p, lang, k, r, soft) in enumerate([("mock", "ja", "high", "LOW", "HIGH"), ("groq", None, "low", None, "NONE"), ("groq", "en", None, "LOW", None), ("mock", "ja", "high", "HIGH", "HIGH")], 1)]
    d = spark.createDataFrame(rows, "g string, timestamp string, i int, provider string, language string, keigo_level string, hallucination_risk string, soft_rejection_risk string, hallucination_rate double, duration_ms double, action_items_total int, code_switches int, speakers_detected int, error string")
    t = logs.trends(d, ["g"], ["timestamp", "i"]).first()
    assert (t.most_used_provider, t.most_common_language, t.high_soft_rejection_pct) == ("mock", "ja", 50.0)
    got = {(r.name, r.value): r.n for r in logs.distributions(d, ["g"]).collect()}
    assert got == {
        ("provider", "mock"): 2, ("provider", "groq"): 2, ("language", "ja"): 2, ("language", "en"): 1, ("language", "unknown"): 1, ("keigo_level", "high"): 2, ("keigo_level", "low"): 1, ("keigo_level", "unknown"): 1,
        ("hallucination_risk", "LOW"): 2, ("hallucination_risk", "UNKNOWN"): 1, ("hallucination_risk", "HIGH"): 1, ("soft_rejection_risk", "HIGH"): 2, ("soft_rejection_risk", "NONE"): 2,
    }
    s = logs.series(d, ["g"], ["timestamp", "i"]).orderBy("place").collect()
    assert [tuple(r)[3:] for r in s] == [(i, f"01/0{i} 09:30", x, 12.5, 1.5, 2, 3, i) for i, x in ((1, 4), (2, 0), (3, 0), (4, 4))]


def test_talk_time_by_a_word_of_the_name(spark):
    """A result speaker takes the clock's weight of the first name that has theirs as a word; the first speaker takes what rounding leaves."""
    t = "Hiro Tanaka: [10:00] a\nSato: [10:00:30] b\nYuki Tanaka: [10:20] c\nSato: [10:21] d"
    w = dynamics.talk_weights(spark.createDataFrame([("m", t)], "meeting_id string, transcript string")).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "weight"))).alias("w"))
    for names, want in ((["tanaka", "Sato", "Kim"], [33, 67, 0]), (["Kim"], [9]), (["Yuki Tanaka", "SATO "], [0, 100])):
        sp = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(9).alias("talk_time_pct")) for n in names))
        assert [x.talk_time_pct for x in w.select(dynamics.weighed(sp, F.col("w")).alias("s")).first().s] == want


def test_log_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    row = {"timestamp": "2025-01-01T00:00:00", "duration_ms": 10.0, "hallucination_rate": 0.1, "hallucination_risk": "HIGH", "provider": "mock", "status": "success"}
    (folder / "a.jsonl").write_text(json.dumps(row) + "\nbroken {\n" + json.dumps(row | {"status": "error"}) + "\n")
    (folder / "b.jsonl").write_text(json.dumps(row | {"duration_ms": 30.0, "provider": "local"}) + "\n")
    batch = logs.stats(logs.read_log(spark, str(folder))).first()
    live = log_stream.drain(log_stream.stats_stream(log_stream.log_stream(spark, str(folder))), "live_stats").first()
    assert batch.total_analyses == 2 and tuple(batch) == tuple(live)


def test_results_and_reports(spark):
    raw = '{"summary": ["one two three four five six seven eight nine"], "speakers": [{"name": "Mori", "talk_time_pct": 30, "tone": "odd"}, {"name": "Abe", "talk_time_pct": 30}], "japan_insights": null}'
    f = spark.createDataFrame([(raw,), ("{}",), ("broken",)], "t string").withColumn("r", results.parse(F.col("t"))).select(results.filled("r").alias("f")).collect()
    assert f[0].f.meeting_title == "one two three four five six seven eight…" and [s.talk_time_pct for s in f[0].f.speakers] == [50, 50] and f[0].f.speakers[0].tone == "neutral"
    assert f[1].f.summary == ["No summary available."] and f[1].f.meeting_title == "Meeting Analysis"
    assert {r.id: r.health_score for r in results.q_health(spark, "").collect()}["H2"] <= 22
    d = spark.createDataFrame([("m", ["a b c d e"], [], ["task one two three (Owner: x, Due: y)"], [], ["w"])], "meeting_id string, summary array<string>, decisions array<string>, actions array<string>, signals array<string>, watch array<string>")
    assert [r.slide_type for r in reports.slide_plan(d).orderBy("slide_number").collect()] == ["cover", "bottom_line", "decisions", "risk_watch", "closing"]


def test_reports_list_every_item(spark, tmp_path):
    """A meeting with more items than a page holds has them all, on pages numbered through."""
    n = 2 * reports.SHOWN + 7
    acts = [("big", f"a{i:05}", f"<task {i}>" if i % 5 else None, "Mori", "Friday", False) for i in range(n)] + [("small", "a", "<one>", None, None, True)]
    spark.createDataFrame(acts, "request_id string, item_id string, task string, owner string, deadline string, flag boolean").write.parquet(str(tmp_path / "action_items.parquet"))
    said = [("big", f"c{i:05}", f"<decision {i}>") for i in range(reports.SHOWN + 1)]
    spark.createDataFrame(said, "request_id string, item_id string, text string").write.parquet(str(tmp_path / "commitment_items.parquet"))
    moods = [("big", f"s{i}", "yes", f"no {i}", "HIGH" if i == 3 else "LOW") for i in range(6)] + [("big", "s0", "yes", "no 0", "LOW"), (None, "x", "a", "b", "HIGH")]
    spark.createDataFrame(moods, "request_id string, item_id string, said string, meant string, severity string").write.parquet(str(tmp_path / "said_vs_meant_items.parquet"))
    f = str(tmp_path)
    notes, md, formal = ({(r.meeting_id, r.page): r for r in q(spark, f).collect()} for q in (reports.q_notes, reports.q_markdown, reports.q_minutes))
    for got in (notes, md, formal):
        assert sorted(got) == [("big", 1), ("big", 2), ("big", 3), ("small", 1)]
        assert {(r.pages, r.actions_n, r.decisions_n) for r in got.values() if r.meeting_id == "big"} == {(3, n, reports.SHOWN + 1)}
    text = lambda got, c: "".join(got["big", p][c] for p in (1, 2, 3))
    for t in (text(notes, "notes"), text(md, "notes"), text(formal, "minutes")):
        assert all(t.count(x[2]) == 1 for x in acts[:n] if x[2])
    t = text(formal, "minutes")
    assert all(t.count(x[2]) == 1 for x in said) and "No explicit decisions" not in t and "No action items" not in t
    rows = [x.split(" | ") for x in t.split("\n") if x.startswith("| ") or "## アクションアイテム" in x and " | " in x]
    assert [int(x[0].strip("| ")) for x in rows] == list(range(1, len(rows) + 1)) and len(rows) == sum(bool(x[2]) for x in acts[:n])
    assert "No explicit decisions" in formal["small", 1].minutes
    slides = {(r.meeting_id, r.slide_type): r.bullets for r in reports.q_slides(spark, f).collect()}
    assert slides["big", "said_vs_meant"] == 3 and slides["big", "risk_watch"] == 1 and slides["big", "cover"] == 0 and ("small", "risk_watch") not in slides


def test_health_and_scores_of_every_request(spark, tmp_path):
    write = lambda rows, kinds, name: spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / f"{name}.parquet"))
    write([("a", "Mori: send the revised quote by Friday"), ("b", "Mori: send the revised quote by Friday"), ("c", "Mori: hello")], "request_id string, transcript string", "analyze_requests")
    write([("a", "1", "send the revised quote", "Mori", "Friday", False), ("b", "1", "purchase office chairs", "Ghost", "Monday", True), ("b", "2", "send the revised quote", "TBD", "Friday", None)], "request_id string, item_id string, task string, owner string, deadline string, flag boolean", "action_items")
    write([("a", "1", "send the revised quote")], "request_id string, item_id string, text string", "commitment_items")
    write([("a", "1", "Mori")], "request_id string, item_id string, speaker string", "said_vs_meant_items")
    got = {r.meeting_id: r.health_score for r in results.q_request_health(spark, str(tmp_path)).collect()}
    assert got == {"a": 15 + 25 + 25 + 20, "b": 15 + round(1 / 4 * 25) + 25 + 10, "c": 15 + 10 + 25 + 20}
    assert [(r.case_id, r.matched, r.f1) for r in evaluation.q_request_scores(spark, str(tmp_path)).collect()] == [("a", 1, 1.0)]


def test_pipeline_keeps_every_meeting(spark):
    out = pipeline.analyze(seed(spark))
    assert out.count() == seed(spark).count() and out.where("health_score IS NULL OR verdict IS NULL").count() == 0
    answers = spark.createDataFrame([("S01", '{"meeting_title": "T", "sentiment": [{"speaker": "Mori", "score": "positive"}]}')], "meeting_id string, raw_json string")
    assert pipeline.analyze(seed(spark), answers).where("meeting_id = 'S01'").first().meeting_title == "T"


def test_pipeline_grounds_answers(spark):
    """Claims that don't stand on the transcript cost health; names are unified, placeholders put back and talk time taken from the clock, by the names of the answer as the reference does."""
    t = "Mori: [10:00] send the revised quote by Friday\n田中: [10:00:30] yes\nMori: [10:03] so\nAbe: [10:20] bye"
    m = spark.createDataFrame([(i, t) for i in ("good", "bad", "alone")] + [("empty", "")], "meeting_id string, transcript string")
    held = {v: k for k, v in privacy.mask_text(t)[1].items()}

    def answer(task, bullet, *who):
        return json.dumps({"summary": [bullet], "action_items": [{"task": task, "owner": who[0], "deadline": "Friday"}], "sentiment": [{"speaker": w, "score": "neutral"} for w in who], "speakers": [{"name": w, "talk_time_pct": 50} for w in who]})

    a = [("good", answer("send the revised quote", "Mori will send the quote", held["Mori"], "Tanaka")), ("bad", answer("purchase office chairs", "Everybody praised unrelated furniture", "Ghost", "Phantom")), ("empty", answer("x", "y", "Ghost"))]
    got = {r.meeting_id: r for r in pipeline.analyze(m, spark.createDataFrame(a, "meeting_id string, raw_json string")).collect()}
    good, bad = got["good"], got["bad"]
    assert (good.hallucination_risk, good.risk_label, good.actions_flagged) == (0.0, "LOW", 0) and [tuple(x) for x in good.talk_time] == [("Mori", 100), ("田中", 0)]
    assert (bad.hallucination_risk, bad.risk_label, bad.actions_flagged) == (1.0, "HIGH", 1) and [tuple(x) for x in bad.talk_time] == [("Ghost", 50), ("Phantom", 50)]
    assert good.health_score - bad.health_score == 20 + 25
    assert (got["empty"].hallucination_risk, got["empty"].risk_label, got["empty"].actions_flagged) == (0.0, "UNKNOWN", 0)
    assert got["alone"].hallucination_risk > 0 and got["alone"].actions_flagged == 1


def test_grounding_within_the_row(spark):
    """verify and rescued say what verify_actions, verify_claims and rescue say over tables."""
    t = "Tanaka: send the revised quote by Friday\nSato: ok. 見積書を金曜日までに送ります"
    m = spark.createDataFrame([("m", t)], "meeting_id string, transcript string")
    tasks, points, who = ["send the revised quote", "buy office chairs", "見積書を送る", "the of", "ok", "", None], ["the quote is due by Friday", "nothing of the sort happened yesterday evening", ""], ["Tanaka", "Ghost"]
    raw = json.dumps({"action_items": [{"task": x} for x in tasks], "summary": points, "sentiment": [{"speaker": w} for w in who]})
    r = m.withColumn("r", results.parse(F.lit(raw))).withColumn("v", grounding.verify(F.col("r"), F.col("transcript")))
    r = r.select("v.*", F.transform("r.action_items", lambda i: grounding.rescued(i["task"], F.col("transcript"))).alias("saved")).first()
    table = lambda name, xs: spark.createDataFrame([("m", f"{i:02}", x) for i, x in enumerate(xs)], f"meeting_id string, {name} string, x string")
    acts = grounding.verify_actions(table("item_id", tasks).select("meeting_id", "item_id", F.col("x").alias("task"), F.lit("").alias("owner"), F.lit("").alias("deadline")), m)
    claims = [grounding.verify_claims(table("claim_id", xs).withColumnRenamed("x", "claim"), m, least) for xs, least in ((points, grounding.BULLET), (who, grounding.SPEAKER))]
    want = grounding.risk(acts, *claims).first()
    assert list(r.task_low) == [x.hallucination_flag for x in acts.orderBy("item_id").collect()] and (r.flagged_total, r.total_claims) == (want.flagged_total, want.total_claims)
    assert list(r.saved) == [x.rescued for x in grounding.rescue(acts.select("meeting_id", "item_id", "task"), m).orderBy("item_id").collect()]


def _drift(spark, files):
    rows = [(1, seq, n, x) for seq, lines in files for n, x in enumerate(lines, 1)]
    d = spark.createDataFrame(rows, "stream_id long, file_seq int, line_no int, line string")
    return {(r.file_seq, r.field_name, r.change_kind) for r in schema_drift.changes(d).collect()}, d


def test_schema_drift(spark):
    got, d = _drift(spark, [
        (1, ['{"keigo_level": "high", "code_switches": 3, "a": null}', '{"keigo_level": null}', '{"cut": ', None]),
        (2, ['{"keigo": 2, "code_switches": 3.5, "japan_insights": {}}', '{"status": "error", "error_type": "x", "zzz": 1}']),
        (4, ['{"japan_insights": {"keigo_level": "low"}, "codeSwitches": [1, 2], "a": true}', '{"japan_insights": {"keigo_level": "low"}, "codeSwitches": [1, 2], "a": true}']),
        (5, []), (6, ["not json"]), (7, ['{"a": "x"}']),
    ])
    assert got == {
        (2, "a", "removed"), (2, "keigo_level", "renamed"), (2, "keigo_level", "retyped"), (4, "keigo_level", "renamed"), (4, "keigo_level", "retyped"), (4, "code_switches", "renamed"), (4, "code_switches", "retyped"), (4, "a", "added"),
        (6, "keigo_level", "removed"), (6, "code_switches", "removed"), (6, "a", "removed"), (7, "a", "added"),
    }
    rows = {(r.file_seq, r.line_no): r for r in schema_drift.log_rows(d).collect()}
    assert rows[1, 1].keigo_level == "high" and rows[2, 1].keigo_level == "medium" and rows[4, 1].keigo_level == "low" and rows[4, 1].code_switches == 2
    empty = spark.createDataFrame([], "stream_id long, file_seq int, line_no int, line string")
    assert schema_drift.changes(empty).count() == 0 and schema_drift.log_rows(empty).count() == 0


def test_schema_drift_of_nulls_and_long_streams(spark):
    one = lambda files: _drift(spark, list(enumerate(files, 1)))
    got, _ = one([['{"error": null, "a": 1}'], ['{"error": "x", "a": null}'], ['{"error": "y", "a": "t"}'], ['{"error": 5, "a": "u"}']])
    assert got == {(4, "error", "retyped")}  # nulls have no type, so what follows them is no change of type
    got, _ = one([['{"KEIGO": "low"}'], ['{"keigo_level": "low"}'], ["{}"], ["not json"], ['{"japan_insights": {"keigo_level": "low"}}'], ['{"japan_insights": {"keigo_level": [1]}}']])
    assert got == {(2, "keigo_level", "renamed"), (3, "keigo_level", "removed"), (5, "keigo_level", "added"), (6, "keigo_level", "retyped")}
    # One stream with nearly all files: its ranges lie in several parts, and what changes between two parts isn't lost.
    files = [['{"a": 1}' if i % 3 else '{"b": "x"}'] for i in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got, d = one(files)
    assert len(set(r.part for r in schema_drift._parts(schema_drift.catalogue(d)).select("part").collect())) > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    has = lambda i: "a" if i % 3 else "b"
    assert got == {(i + 1, f, k) for i in range(1, 200) if has(i) != has(i - 1) for f, k in ((has(i), "added"), (has(i - 1), "removed"))}
