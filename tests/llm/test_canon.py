"""Canonical form and same-text pairs."""

import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import canon, same_text

SAME = [("ＡＢ１：", "AB1:"), ("café", "café"), ("a​b﻿c­", "abc"), ("a b", "a b"), ("Ѕаmе", "Same"), ("ガ", "ｶﾞ"), ("ペッパ一ミル", "ペッパーミル"), ("ﬁne", "fine"), ("क़", "क़"), ("x‑y", "x-y"), ("⽇", "日")]
OTHER = [("a", "A"), ("1", "2"), ("a b", "ab"), ("a.", "a"), ("a\nb", "a b"), ("x²", "x2"), ("…", "..."), ("を", "も"), ("①", "1")]
TEXTS = st.text(alphabet="aé́Ａ１ｶﾞガ一ー力カ​  кkेक़q\n…²😀𝐀\U0001d165\U0001d16d", max_size=30)


def test_pairs():
    for a, b in SAME:
        assert canon.visual_key(a) == canon.visual_key(b), (a, b)
    for a, b in OTHER:
        assert canon.visual_key(a) != canon.visual_key(b), (a, b)
    assert canon.visual_key(None) is None and canon.visual_key("") == "" and canon.canonical(None) is None


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_key_is_stable_and_segments_are_enough(s):
    k = canon.visual_key(s)
    assert canon.visual_key(k) == k
    whole = unicodedata.normalize("NFC", s.translate(canon.KEY_MAP))
    assert k == whole  # splicing normalised segments gives what normalising the whole text gives


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_aligned_positions(s):
    folded, at = canon.aligned(s)
    if at is None:
        assert len(folded) == len(s)
    else:
        assert len(at) == len(folded) and at == sorted(at) and all(0 <= i < len(s) for i in at)


def test_readable_form_keeps_kanji():
    assert canon.canonical("入口の力") == "入口の力" and canon.canonical("アン力ー") == "アンカー" and canon.canonical("Ｓаmple") == "Sample"


def test_same_text_pairs_brute_force(spark):
    rng = random.Random(3)
    base = ["Mori: same text one", "森: ガス。", "x", ""]
    rows = []
    for i in range(60):
        t = rng.choice(base)
        t = t if rng.random() < 0.5 else t.replace("o", "о") if rng.random() < 0.5 else t.replace(" ", " ")
        rows.append((f"r{i:02d}", t, "extra"))
    rows += [rows[0], rows[1], ("n1", None, "x"), (None, "x", "x")]
    d = spark.createDataFrame(rows, "id string, text string, k string")
    got = {tuple(r) for r in same_text.same_text_pairs(d, "id", "text").collect()}
    live = {(i, t) for i, t, _ in rows if i and t is not None}
    want = {(a, b) for a, s in live for b, t in live if a < b and s != t and canon.visual_key(s) == canon.visual_key(t)}
    assert got == want and want
    assert same_text.same_text_pairs(d.limit(0), "id", "text").count() == 0
    assert same_text.canonical_text(d, "id", "text").count() == len(rows)
