"""Helpers shared by the corpus operators: reading, cutting lineage, graph components, ordered sums."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: White space that separates words, as a character class body for Java, RE2 and Python patterns.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode only, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: it is computed once, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df marked for broadcast if it has at most so many (short) rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def forget(*frames: DataFrame) -> None:
    """Delete what stored() wrote for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            df._stored_at = None
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Within it, jobs hand at most so many rows at a time to Python: for rows that may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def sliced(batches, rows: int = 256):
    """The batches of a task in slices of at most so many rows: what Python makes of a slice's texts is freed before the next."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def unit(*cols) -> Column:
    """A number in [0, 1) that depends on the values of cols alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def high_bits(col: Column, bits: int) -> Column:
    """The top bits of a signed 64-bit hash, in the hash's unsigned order."""
    return F.shiftrightunsigned(col, 64 - bits).cast("int")


def ranked(df: DataFrame, part: list[str], bucket: str, order: list[str], out: str, size: str | None = None) -> DataFrame:
    """A running rank, or a running sum of `size` before the row, within `part` by (bucket, order).

    The rows of a part are ranked inside small buckets; a table with one row for each (part, bucket) carries what
    stands before a bucket. So no task gets a whole part.
    """
    what = F.sum(size) if size else F.count(F.lit(1))
    sums = df.groupBy(*part, bucket).agg(what.alias("_in"))
    before = W.partitionBy(*[F.col(c) for c in part] or [F.lit(0)]).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*part, bucket, F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"))
    w = W.partitionBy(*part, bucket).orderBy(*order)
    own = F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) if size else F.row_number().over(w) - 1
    return df.withColumn("_own", own).join(offsets, [*part, bucket]).withColumn(out, F.col("_own") + F.col("_before")).drop("_own", "_before")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): one row (node, component) per node, component the smallest node.

    Alternating large-star and small-star rounds; a round keeps at most one row per node and edge, minima are
    combined before the shuffle, and each round is written to the shared folder.
    """
    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    cur = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = mark(cur)
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stored(small.union(own.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = mark(nxt)
        forget(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())


def joined_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links (u, v) inside a task: nodes and the smallest node that each is joined to, nodes that are that themselves left out."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, z = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        least = np.minimum(root[a], root[z])
        np.minimum.at(new, a, least)
        np.minimum.at(new, z, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.nonzero(root != np.arange(len(ids)))[0]
    return ids[moved], ids[root[moved]]


def with_components(docs: DataFrame, comps: DataFrame, id_col: str) -> DataFrame:
    """docs with component_id: the component of its id, or the id itself where it has no link."""
    return docs.join(comps.withColumnRenamed("node", id_col), id_col, "left").withColumn("component_id", F.coalesce("component", id_col)).drop("component")


def fields(*pairs: tuple[str, T.DataType | str]) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(n, kinds.get(k, k) if isinstance(k, str) else k) for n, k in pairs])
