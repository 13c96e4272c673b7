"""Tables kept between the steps of one query, and side tables of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder under spark.checkpoint.dir, which the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/stored-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to a new shared folder and read again: computed once, safe from lost executors."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what stored() wrote for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            df._stored_at = None
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def pinned(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df worked out once: as a local table, whose size the planner knows, if it has at most so many rows; else stored."""
    few = df.limit(rows + 1).toArrow()
    if few.num_rows > rows:
        return stored(df)
    out = df.sparkSession.createDataFrame(few, df.schema)
    out._rows = few.num_rows
    return out


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, for the planner to choose. Rows of pinned
    tables are known, others are counted."""
    n = getattr(df, "_rows", None)
    return F.broadcast(df) if (df.limit(rows + 1).count() if n is None else n) <= rows else df
