"""The audit log as a stream: the batch expressions over a file source."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.logs import SCHEMA, stats_columns
from ..stage import checkpoint_dir


def log_stream(spark: SparkSession, folder: str, include_errors: bool = False) -> DataFrame:
    """Rows of JSON lines as files arrive in a folder; broken lines are dropped."""
    d = spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").json(folder)
    return d if include_errors else d.where("status = 'success'")


def stats_stream(rows: DataFrame, *group: str) -> DataFrame:
    """Running statistics, by group if any; for complete output."""
    return rows.groupBy(*group).agg(*stats_columns())


def drain(rows: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All that is there now, run through the stream and written as Parquet files in the shared folder: a queue's batch, read back as a table.

    checkpoint is where progress is kept, by default in the shared folder too, so that a lost executor or a restart goes on where it was. In
    complete mode each micro-batch replaces the table; in append or update mode it is added under its number, once.
    """
    spark = rows.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    out = f"{base}/rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    q = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint or f"{base}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        return spark.read.schema(rows.schema).parquet(out).select(*rows.columns)
    except AnalysisException:  # nothing has arrived, so nothing was written
        return spark.createDataFrame([], rows.schema)
