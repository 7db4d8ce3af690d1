"""The seed corpus against its expected risk and verdict, and the counts of the lists."""

import pytest
from pyspark.sql import functions as F

from palaver.functions import lexicon
from palaver.operators import signals
from palaver.sources.seed import seed

EXPECTED = {
    "S01": ("NONE", 0, "APPROVED"), "S02": ("CRITICAL", 1, "REJECTED"), "S03": ("NONE", 0, "CONDITIONAL"), "S04": ("NONE", 0, "DEFERRED"), "S05": ("HIGH", 1, "PENDING"), "S06": ("NONE", 0, "INFORMATIONAL"),
    "S07": ("MEDIUM", 1, "AT_RISK"), "S08": ("NONE", 0, "UNCLEAR"), "S09": ("CRITICAL", 4, "PENDING"), "S10": ("LOW", 1, "UNCLEAR"), "S11": ("LOW", 2, "UNCLEAR"), "S12": ("MINIMAL", 1, "UNCLEAR"), "S13": ("NONE", 0, "CONDITIONAL"),
    "S14": ("CRITICAL", 1, "REJECTED"), "S20": ("NONE", 0, "UNCLEAR"),
}


def test_seed_outcomes(spark):
    got = {r.meeting_id: (r.risk_level, r.total_signals, r.verdict) for r in signals.outcome(seed(spark)).collect()}
    assert {k: got[k] for k in EXPECTED} == EXPECTED


def test_speaker_of_first_signal(spark):
    got = {r.meeting_id: r.speaker for r in signals.signals(seed(spark)).collect()}
    assert got["S02"] == "Director" and got["S05"] == "Ueda" and got["S10"] == "鈴木" and got["S14"] == "Unknown"
    deals = {r.meeting_id: r.speaker for r in signals.signals(seed(spark), signals.DEALS).collect()}
    assert deals["S01"] == "Mori"


def test_list_sizes():
    assert len(signals.REJECTIONS) == 129 and len(signals.DEALS) == 81 and len(signals.ENGLISH) == 51 and len(signals.HINDI) == 30
    assert len(lexicon.GROUNDING_STOPS) == 63 and len(lexicon.NOT_SPEAKERS) == 57 and len(lexicon.SURNAMES) == 108


def test_phrases_have_the_script_that_the_scan_asks_for():
    import re

    for phrase, _, _, ci, _ in signals.lexicon_rows():
        assert re.search("[A-Za-z]" if ci else "[\u3040-\u30ff\u4e00-\u9fff]", phrase), phrase


def test_null_empty_and_clashing_columns(spark):
    d = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", "x" * 100_000 + " decided to end", 3)], "meeting_id string, transcript string, verdict_note int")
    got = {r.meeting_id: r.verdict for r in signals.outcome(d).collect()}
    assert got == {"a": "UNCLEAR", "b": "UNCLEAR", "c": "REJECTED"}
    assert signals.outcome(d.limit(0)).count() == 0


def test_english_and_hindi(spark):
    e = {r.meeting_id: r for r in signals.english(seed(spark)).collect()}
    assert e["S15"].power_n >= 2 and e["S15"].friction_level == "HIGH"
    h = {r.meeting_id: r for r in signals.hindi(seed(spark)).collect()}
    assert h["S16"].hindi_risk == "HIGH" and h["S16"].formality in ("medium", "high") and h["S08"].hindi_risk == "NONE"
    assert h["S22"].rejection_n == 2


def test_greetings_are_no_signals(spark):
    long = "前向きに対応したいと思いますが社内の確認が必要かもしれません"
    d = spark.createDataFrame([(["ありがとうございます。", long, "難しい", "ok"],)], "s array<string>")
    # A signal not much longer than some greeting is dropped as well: the rule compares lengths only.
    assert d.select(signals.without_greetings(F.col("s")).alias("s")).first().s == [long]


@pytest.mark.parametrize("text,roots", [("検討しました", 1), ("懸念があり難しい", 2), ("", 0)])
def test_roots(spark, text, roots):
    assert len(spark.createDataFrame([(text,)], "t string").select(signals.nemawashi_roots(F.col("t")).alias("r")).first().r) == roots
