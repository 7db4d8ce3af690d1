"""Evaluation against plain Python: the two cases, and every request of a small table with ties, nulls and repeats."""

import re
from functools import lru_cache

from palaver.operators import evaluation as ev

_CJK = "[぀-ヿ一-鿿]"


def tokens(text):
    low = text.lower()
    c = re.findall(_CJK, low)
    return re.sub(f"({_CJK})", r" \1 ", low).split() + [a + b for a, b in zip(c, c[1:])]


def common(a, b):
    @lru_cache(None)
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

    return f(0, 0)


def overlap(p, r):
    if not p or not r:
        return 0.0
    f1 = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0
    return round(0.4 * f1(set(p), set(r)) + 0.3 * f1(set(zip(p, p[1:])), set(zip(r, r[1:]))) + 0.3 * 2 * common(tuple(p), tuple(r)) / (len(p) + len(r)), 3)


def summary(preds, refs):
    """Mean of the scores of a one-to-one choice, the best pairs first."""
    pairs = sorted(((overlap(tokens(p), tokens(r)), j, i) for i, p in enumerate(preds) for j, r in enumerate(refs)), reverse=True)
    used_p, used_r, total = set(), set(), 0.0
    for s, j, i in pairs:
        if j not in used_r and i not in used_p:
            used_r.add(j)
            used_p.add(i)
            total += s
    return round(total / len(refs), 3)


def actions(preds, refs):
    """Matches, and F1: each prediction in turn takes the free reference of which it has the most, from a quarter on."""
    free, n = set(range(len(refs))), 0
    for p in preds:
        best = max(((len(set(tokens(p)) & set(tokens(refs[i]))) / len(set(tokens(refs[i]))), -i) for i in free if tokens(refs[i])), default=(0.0, 0))
        if best[0] >= 0.25:
            free.discard(-best[1])
            n += 1
    p, r = n / len(preds), n / len(refs)
    return n, round(2 * p * r / (p + r), 3) if p + r else 0.0


def test_cases(spark):
    got = {r.case_id: r for r in ev.q_scores(spark, "").collect()}
    for case, sem, f1, soft, total, grade, matched in ev.GOLDEN:
        p = [t for c, _, t, _ in ev.CASES_PRED if c == case]
        r = [t for c, _, t, _ in ev.CASES_REF if c == case]
        assert (sem, (matched, f1)) == (summary(p, r), actions(p, r))
        assert total == round((sem + f1 + soft) / 3 * 100, 1)
        row = got[case]
        assert (row.semantic_score, row.f1, row.soft_accuracy, row.overall_score, row.overall_grade, row.matched) == (sem, f1, soft, total, grade, matched)


def test_every_request(spark, tmp_path):
    preds = {"a": ["send the quote", "book a room", "book a room"], "b": ["見積もりを送る", "Check the stock list"], "c": ["x"], "e": ["...", "alpha beta"]}
    refs = {"a": ["send the revised quote", "book the large room"], "b": ["在庫を確認する", "見積書を送る", "check stock"], "d": ["y"], "e": ["alpha", "alpha beta gamma"]}

    def write(rows, column, name):
        d = [(k, f"{k}{i}", t) for k, ts in rows.items() for i, t in enumerate(ts)]
        d += d[:2] + [(None, "n", "z"), ("a", "z", None)]  # repeats, no request, no text
        spark.createDataFrame(d, f"request_id string, item_id string, {column} string").write.parquet(str(tmp_path / f"{name}.parquet"))

    write(preds, "task", "action_items")
    write(refs, "text", "commitment_items")
    got = {r.case_id: (r.semantic_score, r.matched, r.f1) for r in ev.q_request_scores(spark, str(tmp_path)).collect()}
    assert got == {k: (summary(preds[k], refs[k]), *actions(preds[k], refs[k])) for k in "abe"}
