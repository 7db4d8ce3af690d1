"""Shared spans, packing and mixing."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import mixing, packing, shared_spans as ss, tokens


def brute(texts, least):
    grams = {k: {t[i : i + least] for i in range(len(t) - least + 1)} for k, t in texts.items() if t}
    return {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 12))
def test_every_window_keeps_a_least_entry(h, w):
    a = np.array(h, dtype=np.uint64)
    got = set(ss.winnow(a, w).tolist())
    for i in range(max(1, len(h) - w + 1)):
        part = range(i, min(i + w, len(h)))
        low = min(h[j] for j in part)
        assert all(j in got for j in part if h[j] == low)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=25), st.text(alphabet="ab", max_size=25), st.integers(1, 5))
def test_automaton_spans(a, b, least):
    got = list(ss.Automaton(a).spans(b, least))
    for i, j, x in got:
        assert b[i:j] == a[x : x + j - i] and j - i >= least
    covered = {k for i, j, _ in got for k in range(i, j)}
    want = {k for i in range(len(b)) for j in range(i + least, len(b) + 1) if b[i:j] in a for k in range(i, j)}
    assert covered == want


def test_gram_hashes_match_equality():
    rng = random.Random(1)
    t = "".join(rng.choice("abcあ😀") for _ in range(300))
    h = ss.gram_hashes(t, 4)
    by: dict = {}
    for i, x in enumerate(h.tolist()):
        assert by.setdefault(t[i : i + 4], x) == x
    assert len(set(by.values())) == len(by) and len(ss.gram_hashes("abc", 4)) == 0


def corpus():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh かな") for _ in range(n))
    part = [word(n) for n in (199, 200, 260, 450)]
    texts = {i: word(rng.randint(0, 400)) for i in range(20)}
    for i in range(20, 60):
        texts[i] = word(rng.randint(0, 150)) + rng.choice(part) + word(rng.randint(0, 150))
    texts |= {100: part[3], 101: part[3], 102: part[3][:230] + word(40) + part[3][230:], 103: None, 104: "", 105: "z" * 600, 106: "z" * 201}
    return texts


def test_shared_pairs_brute_force(spark, monkeypatch):
    texts = corpus()
    d = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, gram long")
    want = brute(texts, 200)
    for many, piece in ((48, 8000), (4, 8000), (48, 320)):  # the second sends the hot grams the other way, the third cuts passages
        monkeypatch.setattr(ss, "MANY", many)
        monkeypatch.setattr(ss, "PIECE", piece)
        assert {tuple(r) for r in ss.shared_pairs(d).collect()} == want
    parts = {r.doc_id: r for r in ss.shared_parts(d).collect()}
    assert len(parts) == len(texts) and parts[104].shared_part == 0 and parts[100].shared_part == 1.0 and parts[103].n_chars == 0
    for k, t in texts.items():
        others = {texts[j][i : i + 200] for j in texts if j != k and texts[j] for i in range(len(texts[j]) - 199)}
        cover = {x for i in range(len(t or "") - 199) if t[i : i + 200] in others for x in range(i, i + 200)}
        assert parts[k].shared_chars == len(cover), k
    assert ss.shared_pairs(d.limit(0)).count() == 0
    kept = {r.doc_id: r for r in ss.without_spans(d).collect()}
    assert len(kept) == len(texts) and kept[103].text is None and kept[104].text == ""
    for k, t in texts.items():
        earlier = {texts[j][i : i + 200] for j in texts if j < k and texts[j] for i in range(len(texts[j]) - 199)}
        cover = {x for i in range(len(t or "") - 199) if t[i : i + 200] in earlier for x in range(i, i + 200)}
        assert t is None or kept[k].text == "".join(c for i, c in enumerate(t) if i not in cover), k
        assert kept[k].cut_out == bool(cover)
    assert ss.without_spans(d.limit(0)).count() == 0


def test_hot_footer(spark, monkeypatch):
    """A footer in most documents: one class for all its windows, its pairs from blocks; every link is kept."""
    monkeypatch.setattr(ss.frames, "BLOCK", 50)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    footer = word(320)
    texts = {i: word(60) + chr(0x4E00 + i) + (footer if i % 3 else word(300)) for i in range(300)}
    shared = ss.Shared(spark.createDataFrame([*texts.items()], "doc_id long, text string"))
    assert shared.pieces.count() == 0 and shared.classes().select("h", "h2").distinct().count() == 1
    held = [i for i in texts if i % 3]
    assert {tuple(r) for r in shared.pairs().collect()} == {(a, b) for a in held for b in held if a < b}


def test_bit_set_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(ss, "BITS", 1 << 10)
    d = spark.range(50_000).withColumnRenamed("id", "doc_id")
    bits = ss._bit_set(d.where("doc_id < 5000"), "doc_id")
    assert bits.count() <= 16
    assert ss._may(d, "doc_id", bits).where("doc_id < 5000").count() == 5000
    few = ss._bit_set(d.where("doc_id < 20"), "doc_id")
    got = {r.doc_id for r in ss._may(d, "doc_id", few).collect()}
    assert set(range(20)) <= got and len(got) < 3000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 6)), max_size=40))
def test_best_fit(items):
    rows = [(size, i, c, "s") for i, (size, c) in enumerate(items)]
    bins = packing.best_fit(rows, 20)
    assert sorted(x[1] for b in bins for x in b) == list(range(len(items)))
    for b in bins:
        assert sum(x[0] for x in b) <= 20
        assert len({x[2] for x in b}) == len(b)  # no two of one cluster


def test_containers(spark):
    docs = [(i, f"s{i % 3}", i % 7 if i < 50 else 1000 + i, n) for i, n in enumerate([1, 5, 9, 10, 3, 25, 30, 31, 7, 2] * 12)] + [(900, None, 5, 0)]
    d = spark.createDataFrame(docs, "doc_id long, source string, cluster long, tokens long")
    kinds = spark.createDataFrame([("k10", 10), ("k16", 16)], "container_kind string, capacity_tokens int")
    for packers in (1, 3):
        got = packing.containers(d, kinds, packers).collect()
        for kind, cap in (("k10", 10), ("k16", 16)):
            mine = [r for r in got if r.container_kind == kind]
            total: dict = {}
            pieces: dict = {}
            for r in mine:
                total[r.container_id] = total.get(r.container_id, 0) + r.tokens
                pieces.setdefault(r.doc_id, []).append(r.tokens)
            assert max(total.values()) <= cap
            assert {k: sum(v) for k, v in pieces.items()} == {i: n for i, _, _, n in docs if n}
            assert all(len(v) == -(-n // cap) for i, _, _, n in docs if n for v in [pieces[i]])
    assert packing.containers(d.limit(0), kinds).count() == 0 and packing.containers(d, kinds.limit(0)).count() == 0
    assert packing.fill(packing.containers(d, kinds)).count() == 2


def test_prefixes_and_mix(spark):
    rng = random.Random(2)
    rows = [(i, "abc"[min(2, int(rng.random() * 5) // 2)], rng.randint(1, 50)) for i in range(400)] + [(900, None, 5), (901, "untargeted", 7), (902, "a", 0)]
    d = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 4), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    p = mixing.prefixes(d.where("source = 'a' AND tokens > 0"), 11).collect()
    assert max(r.upto for r in p) == sum(n for _, s, n in rows if s == "a") and len({r.upto for r in p}) == len(p)
    m = mixing.mix(d, targets).collect()
    have = {s: sum(n for _, x, n in rows if x == s) for s in "abc"}
    most = min({"a": 1, "b": 3, "c": 4}[s] * have[s] / {"a": 0.5, "b": 0.3, "c": 0.15}[s] for s in "abc")
    for s, share, cap in (("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 4)):
        got = sum(r.tokens for r in m if r.source == s)
        assert share * most - 50 <= got <= share * most + 1e-6
        assert max(r.epoch for r in m if r.source == s) <= cap
        assert len({(r.doc_id, r.epoch) for r in m if r.source == s}) == len([r for r in m if r.source == s])
    rep = {r.source: r for r in mixing.shares(mixing.mix(d, targets), targets).collect()}
    assert rep["none"].tokens == 0 and abs(rep["a"].actual_share - 0.5 / 0.95) < 0.05
    assert sum(r.tokens for r in mixing.mix(d, targets, total=300).collect()) <= 300
    assert mixing.mix(d.limit(0), targets).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(d, spark.range(mixing.MOST_TARGETS + 1).selectExpr("string(id) AS source", "0.1 AS target_share", "1 AS max_repeats"))


def test_best_fit_prefers_the_source_among_all_equal_bins():
    rows = [(6, i, i, f"s{i}") for i in range(40)] + [(4, 100, 100, "s37")]
    held = next(b for b in packing.best_fit(rows, 10) if any(x[1] == 100 for x in b))
    assert {x[3] for x in held} == {"s37"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 6), st.integers(0, 3)), max_size=40))
def test_best_fit_with_sources_apart(items):
    rows = [(size, i, c, f"s{s}") for i, (size, c, s) in enumerate(items)]
    bins = packing.best_fit(rows, 20, sources_apart=True)
    assert sorted(x[1] for b in bins for x in b) == list(range(len(items)))
    for b in bins:
        assert sum(x[0] for x in b) <= 20 and len({x[2] for x in b}) == len(b) == len({x[3] for x in b})


def test_token_counts(monkeypatch):
    count = tokens.counter()
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word", " ", "\n", "  ", "…", "漢字", "\n\n", "12", "\t", "\u3000"]) for _ in range(4000)), "x" * 5000, "あ" * 3000, "a " * 3000]
    whole = [count(t) for t in texts]
    monkeypatch.setattr(tokens, "PIECE", 700)  # cut as very long texts are: the number is the same, with or without blanks
    assert [count(t) for t in texts] == whole
    monkeypatch.undo()
    assert count(None) == 0 and count("") == 0 and count("hello world") >= 2
    assert abs(count("word " * 100_000) - 100_000) < 20
