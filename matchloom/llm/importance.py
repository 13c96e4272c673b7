"""Importance resampling towards a target: hashed n-gram features, a gain for each bucket, the highest noisy weights drawn.

A document is scanned once for its features: the scan keeps the running CRC-32 states of the last n starts and extends each
by a space and the next word, so every n-gram's bucket is known without building its text. The scan goes through a text in
pieces of PIECE bytes and hands on its states, so memory does not grow with the text.

The first pass counts buckets (one array of `buckets` numbers in a task, one row per bucket and task shuffled), the driver
makes that many gains, and the second pass weighs each document. Ranks come from one range sort of small rows and one
number for each of its partitions.

Defined results: a null or empty text has no words, no features and weight 0; a row without doc_id draws its noise as the
empty text and comes last among equal scores; rows with equal ids and texts have equal scores and successive ranks; an
empty table gives no rows, an empty target no target features; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fields, stored

PIECE = 1 << 18
#: Bytes of words stay, A-Z lower-cased; all other ASCII bytes part words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a piece of it at a time."""
    raw = (text or "").encode().translate(_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def extended(words: list[bytes], ring: list[int], n: int) -> tuple[np.ndarray, list[int]]:
    """CRC-32 of each run of up to n words that ends at one of these, and the states that the next words extend; ring: the
    states so far, of the longest run first."""
    crc, out = zlib.crc32, []
    for w in words:
        more = b" " + w
        ring = [crc(more, state) for state in ring]
        ring.append(crc(w))
        out += ring
        if len(ring) == n:
            del ring[0]
    return np.array(out, dtype=np.int64), ring


def features(text: str | None, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end at them) of a text, a piece at a time."""
    ring: list[int] = []
    for words in pieces(text):
        crcs, ring = extended(words, ring, n)
        yield len(words), crcs % buckets


def _counted(n: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                for _, at in features(text.as_py(), n, buckets):
                    total += np.bincount(at, minlength=buckets)
        has = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, n: int = 3, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) over all texts, buckets without features left out."""
    each = docs.select("text").mapInArrow(_counted(n, buckets), fields(("bucket", "long"), ("n", "long")))
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Thousandths of the log ratio of target and raw frequency of each bucket, both with one more count in every bucket.

    Both tables hold at most `buckets` rows, which the driver reads.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, df in ((s, raw), (t, target)):
        for bucket, n in df.collect():
            counts[bucket] = n
    up, down = (t + 1) * (s.sum() + buckets), (s + 1) * (t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(a / z)) for a, z in zip(up.tolist(), down.tolist())], dtype=np.int64)


def _weighed(n: int, gain: np.ndarray):
    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1):
                words = count = weight = 0
                for has, at in features(text.as_py(), n, len(gain)):
                    words, count, weight = words + has, count + len(at), weight + int(gain[at].sum())
                out.append((words, count, weight))
            cols = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, gain: np.ndarray, n: int = 3) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_weighed(n, gain), fields(("doc_id", "long"), ("n_words", "long"), ("n_features", "long"), ("weight", "long")))


def select(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, n: int = 3, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight, score (weight with Gumbel noise) and rank of every row; the rank is null for rows not
    drawn. Drawn are so many percent, rounded down, of the rows with at least `least_words` words."""
    weighed = weigh(docs, gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets), buckets), n)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("may", F.col("n_words") >= least_words)
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    placed = stored(scored.sort(*order).withColumn("at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sums = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("may"), 1)).alias("may_n"))
    every = W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("n").over(every.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("part", before.alias("before"), F.floor(F.sum("may_n").over(every) * percent / 100).alias("drawn"))
    ranked = placed.withColumn("part", part).join(F.broadcast(sums), "part").withColumn("place", F.col("before") + inside + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (F.col("place") <= F.col("drawn")), F.col("place")).alias("rank"))
