"""A small corpus that exercises what the tables don't hold: one constant for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEED = (
    ("S01", "Mori: We accept your proposal."),
    ("S02", "Director: We have decided not to renew."),
    ("S03", "Client: That is approved subject to a price cut."),
    ("S04", "Okada: The decision is postponed until June."),
    ("S05", "Ueda: We need approval from the legal team."),
    ("S06", "Abe: This is just an update."),
    ("S07", "Goto: The launch has not met our expectations."),
    ("S08", "Ono: See you on Tuesday."),
    ("S09", "Ueda: We need approval from the board. It has not met our expectations, despite multiple opportunities, and we still need to review."),
    ("S10", "鈴木: 難しいかもしれません。"),
    ("S11", "田中: はい、承知しました。"),
    ("S12", "佐藤: 社内で確認いたします。"),
    ("S13", "Mori: We accept on the condition that the price drops.\nAbe: We accept your proposal."),
    ("S14", "Mori: Hello.\nand we decided to end\nAbe: yes"),
    ("S15", "Lee: We'll circle back on this, I'll try to have it by Friday.\nKim: You need to understand, this is unacceptable. I will escalate."),
    ("S16", "Rao: Dekhte hain, kal dekhenge. Ji bilkul.\nVerma: ऊपर से बात करता हूँ। धन्यवाद, आपका सहयोग।"),
    ("S17", "Mori: [10:00] hi\nAbe: [10:00:30] yes\nMori: [10:03] so\nAbe: [10:20] bye"),
    ("S18", "Tanaka (Director): The battery supplier contract needs a decision.\nSato: 難しいかもしれません。battery supplier costs are high.\nMori: Lunch menus arrived yesterday.\nAbe: Holiday calendar looks fine.\nMori: The battery supplier question again.\nAbe: Travel bookings are open.\nTanaka (Director): To summarize, thank you all."),
    ("S19", "Okada: mail okada@example.com or call 03-1234-5678 or +44 20 7946 0958\n佐藤: 株式会社テスト様へ"),
    ("S20", ""),
    ("S21", "Sato: こんにちは hello さん good 会議 meeting です ok"),
    ("S22", "Kapoor: koi baat nahi, देखते हैं, हम विचार करेंगे, अभी नहीं। कृपया जी धन्यवाद"),
)


def seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*SEED], "meeting_id string, transcript string")


def meetings(spark: SparkSession, folder: str) -> DataFrame:
    """meeting_id, transcript: every request's transcript, repeats once, and the seed."""
    r = spark.read.parquet(f"{folder}/analyze_requests.parquet").where("transcript IS NOT NULL").select("request_id", "transcript").distinct()
    return r.withColumnRenamed("request_id", "meeting_id").union(seed(spark))


def text(value: str) -> str:
    """value as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def rows(values, names: str) -> str:
    """values as an SQL table."""
    one = lambda v: "NULL" if v is None else text(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r if isinstance(r, tuple) else (r,))) + ")" for r in values) + f") AS {names}"


MEETINGS = "(SELECT DISTINCT request_id AS meeting_id, transcript FROM analyze_requests WHERE transcript IS NOT NULL UNION ALL SELECT * FROM " + rows(SEED, "s(meeting_id, transcript)") + ")"
