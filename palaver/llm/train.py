"""Fits the models of this subpackage. python -m palaver.llm.train FOLDER NAME...; each model is fitted on at most the stated number of rows."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Most transcripts that a model is fitted on, drawn by the hash of their id.
SENTENCE_TEXTS = 4000


def bounded(spark: SparkSession, folder: str, table: str, key: str, columns: list[str], most: int) -> list:
    return spark.read.parquet(f"{folder}/{table}.parquet").select(key, *columns).orderBy(F.xxhash64(F.lit("fit"), F.col(key))).limit(most).collect()


# Words by which a sentence goes on behind a quotation.
CARRY_ON = {"aur", "और", "ऐसा", "aisa", "कहा", "कहकर", "bole", "बोले"}
# Abbreviations whose point ends no sentence.
ABBREVIATIONS = {"dr", "mr", "mrs", "ms", "prof", "no", "nos", "rs", "e.g", "i.e", "vs", "approx", "ver", "st", "fig", "cf", "dept", "est", "v", "vol", "pp", "sr", "jr", "क्र", "रु", "डॉ", "श्री", "सं"}


def sentence_rows(texts: list[str]) -> list[tuple[list[str], int]]:
    """Candidates whose nature the layout or the neighbouring characters make sure."""
    from .canon import aligned
    from .sentences import _CLOSE as CLOSERS
    from .sentences import _FIRST, _LAST, MARKS, Depth, candidates, features, joined, units

    rows = []
    for text in texts:
        folded, _ = aligned(text)
        made = [joined(folded, u)[0].rstrip() for u in units(folded)]
        for i, s in enumerate(made):
            follow = made[i + 1].lstrip() if i + 1 < len(made) else None
            depth = Depth(s)
            size = len(s)
            for end, nxt, marked in candidates(s):
                if end >= size - 1:
                    continue
                deep = depth.after(end)
                after = s[nxt:].lstrip()[:1]
                body = end
                while body > 0 and s[body] in CLOSERS:
                    body -= 1
                mark, closed = s[body], marked and body < end
                stem = body
                while stem >= 0 and s[stem] in MARKS:
                    stem -= 1
                m = _LAST.search(s[max(0, stem - 15) : stem + 1])
                last = m.group().lower() if m else ""
                m = _FIRST.match(s[nxt:nxt + 24])
                first = m.group(1).lower() if m else ""
                sure = None
                if deep or closed and (after.islower() or "ぁ" <= after <= "ゟ" or first in CARRY_ON):
                    sure = 0
                elif not marked:
                    sure = 0 if mark in "、," or after in "、,)）" else None
                elif mark in ".…" and (after.islower() or after.isdigit() and last in ABBREVIATIONS):
                    sure = 0
                elif mark == "." and (last in ABBREVIATIONS or len(last) == 1 and last.isalpha()) or mark in ".…" and s[body - 1] in ".…":
                    sure = 0
                elif mark in "。।!?|" and after and after not in MARKS and (s[nxt : nxt + 1].isspace() or not s[end].isascii()):
                    sure = 1
                if sure is not None:
                    rows.append((features(s, end, nxt, marked, deep, False), sure))
            if follow and s:
                end = size - 1
                marked = s[end] in MARKS or s[end] in "\"」)" and s[end - 1 : end] in tuple(MARKS)
                deep = depth.after(end)
                if not deep:
                    rows.append((features(s, end, size, marked, deep, False, follow), 1))
                    if not marked and s[end] > "ぁ":
                        rows += [(features(s, end, size, False, deep, False, follow), 1)] * 2
            # A blank between two characters within a name or after a comma is no boundary.
            for j in range(1, size - 1, 37):
                if s[j].isalpha() and s[j + 1].isalpha() and s[j] > "ぁ" and s[j + 1] > "ぁ" and not depth.after(j):
                    rows.append((features(s[: j + 1] + " " + s[j + 1 :], j, j + 2, False, 0, False), 0))
    return rows


def train_sentences(spark: SparkSession, folder: str) -> None:
    from . import logistic
    from .sentences import MODEL, models

    texts = [r.transcript for r in bounded(spark, folder, "analyze_requests", "request_id", ["transcript"], SENTENCE_TEXTS) if r.transcript]
    rows = sentence_rows(texts)
    cut = len(rows) * 9 // 10
    w = logistic.fit(rows[:cut])
    wrong = sum((sum(w.get(x, 0) for x in f) > 0) != bool(y) for f, y in rows[cut:])
    print(f"sentences: {len(rows)} rows, {sum(y for _, y in rows)} boundaries, {len(w)} weights, held-out errors {wrong} of {len(rows) - cut}")
    models().joinpath(MODEL).write_text(json.dumps(w, ensure_ascii=False, indent=0), "utf-8")


#: Most documents that the language classifiers are fitted on, and lines of each class.
LANGUAGE_TEXTS, LANGUAGE_LINES = 4000, 6000


def language_rows(docs: list) -> list[tuple[str, int]]:
    """(line, class) of documents with a label; the script decides where it can, the label between the languages written in Latin letters."""
    import re

    from .canon import aligned
    from .languages import CLASSES, _bare
    from .lines import blank_notes, lines

    rows: list[tuple[str, int]] = []
    have = dict.fromkeys(CLASSES, 0)
    for d in docs:
        folded, _ = aligned(d.text)
        for x in lines(folded):
            s = _bare(blank_notes(folded[x.start : x.end]))
            kana, deva, latin = (len(re.findall(p, s)) for p in ("[ぁ-ゟ]", "[ऀ-ॣ]", "[a-z]"))
            cls = "ja" if kana > 5 else "hi-Deva" if deva > 10 else {"en": "en", "hi": "hi-Latn"}.get(d.lang) if latin > 20 else None
            if cls and x.spoken and have[cls] < LANGUAGE_LINES:
                have[cls] += 1
                rows.append((s, CLASSES.index(cls)))
                words = s.split()
                if len(words) > 8 and have[cls] % 3 == 0:  # pieces, as folded lines are
                    rows.append((" ".join(words[-4:]), CLASSES.index(cls)))
    return rows


def train_languages(spark: SparkSession, folder: str) -> None:
    import random

    import numpy as np

    from .languages import _TOKEN, CLASSES, CODE, MODEL, Model, classify, grams
    from .sentences import models

    docs = [r for r in bounded(spark, folder, "documents", "doc_id", ["text", "lang"], LANGUAGE_TEXTS) if r.text]
    rows = language_rows(docs)
    rng = random.Random(5)
    rng.shuffle(rows)
    cut = len(rows) * 9 // 10
    seen: dict[str, int] = {}
    made = [[g for w in _TOKEN.findall(t.lower()) for g in grams(w)] for t, _ in rows]
    for f in made[:cut]:
        for x in set(f):
            seen[x] = seen.get(x, 0) + 1
    vocab = {x: i for i, (x, n) in enumerate(sorted(seen.items())) if n >= 12}
    vocab = {x: i for i, x in enumerate(vocab)}
    w, g, b = np.zeros((len(vocab), CODE.shape[1])), np.full((len(vocab), CODE.shape[1]), 1e-3), np.zeros(CODE.shape[1])
    scale = 8.0
    data = [(np.array([vocab[x] for x in f if x in vocab], dtype=int), len(f), CODE[y]) for f, (_, y) in zip(made, rows, strict=True)]
    for _ in range(4):
        order = list(range(cut))
        rng.shuffle(order)
        for i in order:
            f, n, code = data[i]
            if not n:
                continue
            z = (w[f].sum(axis=0) / n + b) * scale
            e = -code / (1 + np.exp(code * z))
            u, c = np.unique(f, return_counts=True)
            d = e[None] * (c / n)[:, None] * scale
            g[u] += d * d
            w[u] -= 0.3 * d / np.sqrt(g[u])
            b -= 0.002 * e
    big = np.abs(w).max(axis=1)
    keep = [x for x, i in vocab.items() if big[i] > 0.25]
    model = Model({x: [round(float(v), 2) for v in w[vocab[x]]] for x in keep}, [round(float(v), 3) for v in b], scale)
    got = classify(model, [t for t, _ in rows[cut:]])
    wrong = sum(c[0] != CLASSES[y] for c, (_, y) in zip(got, rows[cut:], strict=True))
    print(f"languages: {len(rows)} lines, {len(keep)} n-grams of {len(vocab)}, held-out errors {wrong} of {len(rows) - cut}")
    models().joinpath(MODEL).write_text(json.dumps({"bias": [round(float(v), 3) for v in b], "scale": scale, "weights": model.w}, ensure_ascii=False, separators=(",", ":")), "utf-8")


#: Most transcripts that the trees are fitted on.
PII_TEXTS = 6000


# Words beside a number or place that make its nature sure; everything else is left to the trees.
ORDER_CUES = ("order", "part", "room", "invoice", "ticket", "注文", "案件", "部品番号", "आदेश", "क्र")
ID_CUES = ("visa", "passport", "badge", "identity", "licence number", "pehchaan", "aadhaar", "पहचान", "आधार", "入館", "申請書", "身分", "免許", "旅券", "マイナンバー")
PHONE_CUES = ("direct line", "call me", "phone", "mobile", "desk moved to", "number hai", "mera number", "मेरा नंबर", "फ़ोन", "直通", "電話", "携帯", "fax", "dial")
PLACE_CUES = ("marg,", "road,", "street,", "lane, ", "avenue", "-cho", "sector", "मार्ग", "गली", "सेक्टर", "丁目", "番地", "県", "都", "府", "市", "〒")


def _sure_kind(s: str, c, held: set[str]) -> int | None:
    """Label of a candidate that isn't a name, where cues, format or an earlier masker's mapping make it sure."""
    import re

    from .pii import KINDS

    t = s[c.start : c.end]
    kind = KINDS[c.kind]
    known = re.sub(r"\s+", " ", t).strip(" 。.") in held
    if kind == "email":
        if re.match(r"\.[A-Za-z0-9]|\s?(?:dot|\[dot\]) ", s[c.end : c.end + 8], re.I):
            return 0  # cut short
        return 1 if known or re.search(r"@|\[at\]", t) or " dot " in t.lower() else 0
    if kind == "address":
        return int(known or sum(x in t.lower() for x in PLACE_CUES) > 0)
    near = s[max(0, c.start - 34) : c.start].lower()
    at = {k: max((near.rfind(x) for x in cues), default=-1) for k, cues in (("order", ORDER_CUES), ("id_number", ID_CUES), ("phone", PHONE_CUES))}
    nearest = max(at, key=at.__getitem__)
    if at[nearest] >= 0:
        return int(nearest == kind)
    if known:
        digits = sum(x.isdigit() for x in t)
        tel = t[0] in "+(" or t[0] == "0" and digits in (10, 11)
        return int(tel == (kind == "phone"))
    return None


def pii_rows(texts: list, names: set[str]) -> list[tuple]:
    """(piece of speech, candidate, label). A candidate for a name is one if all its words are words of registered persons; the other kinds are labelled by sure cues and by an earlier masker's mapping of the request."""
    import re

    from .canon import aligned, visual_key
    from .names import plain
    from .pii import KINDS, spans
    from .sentences import joined, units

    rows = []
    for r in texts:
        folded, _ = aligned(r.transcript)
        held = {re.sub(r"\s+", " ", visual_key(v)).strip(" 。.") for v in (r.mapping or {}).values() if v}
        for u in units(folded):
            s, _ = joined(folded, u)
            got = set(spans(s))
            places = [c for c in got if c.kind == 3 and _sure_kind(s, c, held)]
            got = {c for c in got if c.kind != 4 or all(c.end <= p.start or p.end <= c.start for p in places)}
            good = {c for c in got if c.kind == 4 and all(plain(w) in names for w in s[c.start : c.end].split())}
            for c in got:
                t = s[c.start : c.end]
                if KINDS[c.kind] == "name":
                    inner = any(g != c and g.start <= c.start and c.end <= g.end for g in good)
                    half = c not in good and any(plain(w) in names for w in t.split())
                    y = int(c in good and not inner)
                    if not y and not inner and (re.match(r"様|さん|氏|部長| ji\b| जी", s[c.end : c.end + 4]) or re.search(r"(?:Dr|Mr|Ms|डॉ)\. $", s[max(0, c.start - 5) : c.start])):
                        continue  # a person who isn't registered, most likely
                    if half and not inner and not any(c.start <= g.start and g.end <= c.end for g in good):
                        continue
                else:
                    y = _sure_kind(s, c, held)
                    if y is None:
                        continue
                rows.append((s, c, y))
    return rows


def swapped(rows: list[tuple], times: int = 4) -> list[tuple]:
    """rows with copies of the names' contexts around other names of the same script and number of words, so that the context counts and not the name."""
    import random

    from .pii import Span

    rng = random.Random(9)
    good = [(s, c) for s, c, y in rows if c.kind == 4 and y]
    pool: dict[tuple, list[str]] = {}
    shape = lambda t: (t.count(" "), t[0] < "ɐ", "ऀ" <= t[0] <= "ॿ")
    for s, c in good:
        pool.setdefault(shape(s[c.start : c.end]), []).append(s[c.start : c.end])
    out = []
    for s, c in good:
        for _ in range(times):
            t = rng.choice(pool[shape(s[c.start : c.end])])
            out.append((s[: c.start] + t + s[c.end :], Span(c.start, c.start + len(t), 4), 1))
    every = rows + out
    rng.shuffle(every)
    return every


def train_pii(spark: SparkSession, folder: str) -> None:
    import math
    import re
    from collections import Counter

    import numpy as np

    from . import boosting
    from .canon import visual_key
    from .names import plain
    from .pii import KINDS, MODEL, Vocabulary, context, features
    from .sentences import models

    req = spark.read.parquet(f"{folder}/analyze_requests.parquet").where("transcript IS NOT NULL").select("request_id", "transcript").dropDuplicates(["request_id"])
    masks = spark.read.parquet(f"{folder}/pii_masks.parquet").select("request_id", "mapping").dropDuplicates(["request_id"])
    texts = req.join(masks, "request_id", "left").orderBy(F.xxhash64(F.lit("fit"), "request_id")).limit(PII_TEXTS).collect()
    names: set[str] = set()
    for r in spark.read.parquet(f"{folder}/people.parquet").select("full_name", "name_native").limit(5000).collect():
        for x in (r.full_name, r.name_native):
            w = re.findall(r"\S+", visual_key(x or ""))
            names |= {plain(i) for i in w} | ({"".join(w)} if x is r.name_native else set())
    rows = pii_rows(texts, names)
    cut = len(rows) * 85 // 100
    rows[:cut], cut = (more := swapped(rows[:cut])), len(more)
    letters: Counter = Counter()
    other: Counter = Counter()
    odds: dict[str, dict[str, int]] = {}
    by: dict[str, list[Counter]] = {}
    words = {(w, int(plain(w) in names)) for s, c, _ in rows[:cut] if c.kind == 4 for w in s[c.start : c.end].split()}
    words |= {(w, 1) for w in names if w}
    for w, y in words:
        w = f"^{w.lower()}$"
        (letters if y else other).update({w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)})
    a, b = sum(letters.values()) + 1, sum(other.values()) + 1
    like = {g: round(math.log((letters[g] + 0.5) / a) - math.log((other[g] + 0.5) / b), 2) for g in letters | other if letters[g] + other[g] >= 3}
    base = {k: [1, 1] for k in range(5)}
    for s, c, y in rows[:cut]:
        one, two, nxt, _ = context(s, c.start, c.end)
        base[c.kind][y] += 1
        for slot, w in ((f"{KINDS[c.kind]}-1", one), (f"{KINDS[c.kind]}-2", two), (f"{KINDS[c.kind]}+1", nxt)):
            by.setdefault(slot, [Counter(), Counter()])[y][w] += 1
    for slot, (no, yes) in by.items():
        k = next(i for i, x in enumerate(KINDS) if slot[: len(x)] == x)
        prior = base[k][1] / sum(base[k])
        odds[slot] = {}
        for w in no | yes:
            n = no[w] + yes[w]
            if n >= 6:
                p = (yes[w] + 2 * prior) / (n + 2)
                z = math.log(p / (1 - p)) - math.log(prior / (1 - prior))
                q = max(0, min(8, round(z / 0.7 + 4)))
                if q != 4:
                    odds[slot][w] = q
    v = Vocabulary(odds, like)
    trees, least = {}, {}
    for k, kind in enumerate(KINDS):
        x = [features(s, c, v) for s, c, _ in rows if c.kind == k]
        y = np.array([y for _, c, y in rows if c.kind == k], float)
        mine = np.array(x, dtype=int)
        n = int(len(y) * 0.85)
        if kind == "name":
            # Persons who aren't registered are labelled as none; where a first model sees a name all the same, the row is left out of the second.
            p = boosting.probabilities(boosting.fit(mine[:n], y[:n], rounds=30, depth=4), mine[:n])
            keep = (y[:n] > 0) | (p < 0.1)
            m = boosting.fit(mine[:n][keep], y[:n][keep], rounds=80, depth=4, rate=0.25, l2=1.0, least=1.5)
        else:
            m = boosting.fit(mine[:n], y[:n], rounds=30)
        p = boosting.probabilities(m, mine[n:])
        # Of what is personal, the labels hold a share only: half of the mean score of the labelled ones is the even point.
        share = float(p[y[n:] > 0].mean()) if y[n:].any() else 1.0
        least[kind] = round(share / 2, 4)
        trees[kind] = m
        got, true = p >= least[kind], y[n:] > 0
        print(f"pii {kind}: {len(y)} candidates, {int(y.sum())} labelled; held out: {int(got.sum())} selected, {int((got & true).sum())} of {int(true.sum())} labelled; threshold {least[kind]}")
    models().joinpath(MODEL).write_text(json.dumps({"thresholds": least, "letters": like, "odds": odds, "trees": trees}, ensure_ascii=False, separators=(",", ":")), "utf-8")


if __name__ == "__main__":
    s = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    for name in sys.argv[2:]:
        globals()[f"train_{name}"](s, sys.argv[1])
