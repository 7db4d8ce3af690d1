"""Stage boundaries that survive the loss of an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: spark.checkpoint.dir of the session. Only where that is unset and one machine is all there is (tests), a local folder; on a cluster its lack is an error."""
    sc = spark.sparkContext
    here = sc._jsc.sc().getCheckpointDir()
    if here.isDefined():
        return here.get()
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: stage tables are written there")
        path = tempfile.mkdtemp(prefix="palaver-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written as a Parquet table in the shared checkpoint folder, so that later steps read it instead of computing it again. The tables go by clear(), or when the session's Python process ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/palaver-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(clear, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def clear(spark: SparkSession) -> None:
    """Removes the stage tables written so far: for callers that are done with the results of their queries, as between two queries of a bench."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while _written:
            p = jvm.org.apache.hadoop.fs.Path(_written.pop())
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session is gone already; the folder is the cluster's to clear
        _written.clear()


def ship(spark: SparkSession) -> None:
    """Gives this package's source to the executors, once per context, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_palaver_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="palaver-src-")) / "palaver_src.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._palaver_shipped = True
