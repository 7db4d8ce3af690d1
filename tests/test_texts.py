"""Text functions against plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from palaver.functions import text
from palaver.sources import transcripts as tr
from palaver.sources.seed import SEED

SAMPLES = [t for _, t in SEED] + ["  a　b \r\n\r\n\r\n\r\nc\r d  ", "ガ", "é x", " \n ", "漢字 かな mixed words here are some more text", "日本 go 日本 2 go", "Mori:\nhello\n\nhttps:\nx"]


def one(spark, column, values=SAMPLES):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in d.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def ja_tokens(s):
    s = s.lower()
    is_ja = lambda c: bool(re.match(r"[぀-ヿ一-鿿]", c))
    out, run = [], ""
    for c in s + "\n":
        if is_ja(c) or c in " \t\n":
            out += run.split()
            run = ""
            if is_ja(c):
                out.append(c)
        else:
            run += c
    cjk = [c for c in s if is_ja(c)]
    return out + [a + b for a, b in zip(cjk, cjk[1:])]


def clean(s):
    s = re.sub(r"\n{3,}", "\n\n", unicodedata.normalize("NFC", s).replace("\r\n", "\n").replace("\r", "\n"))
    return "\n".join(x.strip() for x in s.split("\n")).strip()


def test_tokens_and_clean(spark):
    assert [sorted(x) for x in one(spark, text.ja_tokens)] == [sorted(ja_tokens(s)) for s in SAMPLES]
    assert one(spark, text.clean) == [clean(s) for s in SAMPLES]
    assert one(spark, text.clean, [None, ""]) == [None, ""]


def test_language_and_switches(spark):
    assert one(spark, text.language, ["", "hello", "こんにちは", "これは長い日本語の文章です one and two three four five six seven"]) == ["en", "en", "ja", "mixed"]
    assert one(spark, text.code_switches, ["日本 go 日本 2 go", "", "a b", "Mori: 会議 start [10:00] 終了"]) == [3, 0, 0, 2]


def test_clock(spark):
    assert one(spark, text.clock, ["10:00", "10:00:05", "1:30 PM", "12:00AM", "25:00", "x", "9:61"]) == [36000, 36005, 48600, 0, None, None, None]


@pytest.mark.parametrize("a,b,same", [("Tanaka-san", "tanaka", True), ("田中部長", "田中", True), ("", "x", False), ("Sato", "Saito", False), ("Satomi", "Satoru", True)])
def test_names_match(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(text.names_match(F.col("a"), F.col("b"))).first()[0] is same


def test_truncation_and_labels(spark):
    long = " ".join(f"w{i}" for i in range(1300))
    cut = one(spark, text.truncated, [long, "short"])
    assert cut[1] == "short" and cut[0].startswith("w0 w1") and cut[0].endswith("w1299") and len(cut[0].split()) == 1207
    assert one(spark, text.has_labels, ["Mori: a\nAbe: b", "Mori: a", "no", ""]) == [True, False, False, False]
    assert one(spark, text.labelled, ["one\n\ntwo", "Mori: a\nAbe: b"]) == ["Speaker 1: one\nSpeaker 2: two", "Mori: a\nAbe: b"]
    assert one(spark, text.joined_labels, ["Mori:\nhello", "https:\nx"]) == ["Mori: hello", "https:\nx"]
    assert one(spark, text.speaker_hint, ["[NAME_1]: a\nmori (PM): b\nMori: c", "none"]) == ["[NAME_1], mori", "Not detected"]
    assert one(spark, text.degenerate, ["Mori: hi", "Mori: hi\nAbe: yes", ""]) == [True, False, False]


def test_rounding_is_half_even(spark):
    assert spark.range(1).select(F.bround(F.lit(12.5))).first()[0] == 12


def test_sources(spark):
    case = spark.createDataFrame([x[2:] for x in tr.FILES if x[0] == "F2"], "content string")
    assert case.select(tr.json_text(F.col("content"))).first()[0] == "Abe: yes\nOno: no\nx"
    d = spark.createDataFrame([*tr.SEGMENTS], "meeting_id string, seq int, start double, end double, text string")
    assert [r.line for r in tr.segment_turns(d).orderBy("meeting_id", "seq").collect()][2] == "[00:06] Speaker 2: next"
    assert tr.segment_turns(d.limit(0)).count() == 0


@pytest.mark.parametrize("raw,want", [('<think>x</think>```json\n{"a": 1}\n```', '{"a": 1}'), ('text {"a": [1, {"b": "c', '{"a": [1, {"b": "c"}]}'), ("none", None), (None, None), ('{"a": 1} {"b": 2}', '{"a": 1}')])
def test_model_answers(raw, want):
    assert tr.first_object(raw) == want
