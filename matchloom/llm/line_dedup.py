"""Line dedup: lines that several documents hold stay in the first of them only.

Normalised lines are exploded and hashed (two 64-bit hashes); distinct documents are counted by hash; a line held by
`documents` of them or more goes from all but the smallest doc_id; a document is put together again by line position.

Two shuffles count (by hash and document, then by hash), both combined before. Keys held by more than one row in HOT of all
rows are at most HOT by that very rule, and are broadcast; all others have at most a 10,000th of the rows and are joined by
shuffle. Texts are shuffled once, by document.

Defined results: a null text is the empty one, an empty text is one empty line; rows with the same doc_id are one document
(a line repeated inside it stays) and are told apart by their texts, so repeated rows have equal results; rows without a
doc_id are one document after all others; an empty table gives no rows; a long text is one row of an array, and the work
on it is linear in its lines; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

HOT = 10_000
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW = ["unnamed", "id", "t1", "t2"]
KEY = ["h1", "h2"]


def normalised(line: Column) -> Column:
    """The key of a line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.split(text, "\n", -1).alias("lines"),
    )


def repeated_lines(lines: DataFrame, documents: int) -> DataFrame:
    """Keys (h1, h2) that at least so many documents hold, with their number and the first of them."""
    each = lines.groupBy(*KEY, "unnamed", "id").agg(F.count(F.lit(1)).alias("n"))
    sums = each.groupBy(*KEY).agg(F.count(F.lit(1)).alias("held_by"), F.sum("n").alias("n"), F.min(F.struct("unnamed", "id")).alias("first"))
    return sums.where(F.col("held_by") >= documents)


def dedup(docs: DataFrame, least: int = 10, documents: int = 2) -> DataFrame:
    """doc_id, text (what stays of it), n_lines and n_dropped of every row; keys of fewer than `least` code points always stay."""
    rows = _rows(docs)
    key = F.col("key")
    each = rows.select(*ROW, F.posexplode("lines").alias("pos", "line")).select(*ROW, "pos", normalised(F.col("line")).alias("key")).where(F.length("key") >= least)
    lines = stored(each.select(*ROW, "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))
    repeated = stored(repeated_lines(lines, documents))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > F.lit(total)
    hot = repeated.where(is_hot).select(*KEY, F.col("first").alias("hot_first"))
    rest = repeated.where(~is_hot).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first")
    # A line that is settled by the broadcast meets nothing in the shuffled join: its key there is its own place.
    settled = F.col("hot_first").isNotNull()
    lined = lines.join(F.broadcast(hot), KEY, "left").select(*ROW, "pos", "hot_first", F.when(settled, F.xxhash64("t1", "pos")).otherwise(F.col("h1")).alias("h1"), F.when(settled, F.col("id")).otherwise(F.col("h2")).alias("h2"))
    met = lined.join(rest, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & F.col("hot_first").isNull(), "left")
    first = F.coalesce("hot_first", "first")
    gone = met.where(first.isNotNull() & (first != F.struct("unnamed", "id"))).groupBy(*ROW).agg(F.collect_set("pos").alias("gone"))
    gone = stored(gone)
    forget(lines, repeated)
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("gone", F.array().cast("array<int>")))
    return rows.join(gone, ROW, "left").select(
        "doc_id",
        F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n").alias("text"),
        n.cast("long").alias("n_lines"),
        (n - F.size(kept)).cast("long").alias("n_dropped"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """dedup() with the hash of what stays instead of the text."""
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
