"""Mixing sources to target weights by Sainte-Lague apportionment (native: DataFrame functions only).

A source's target is its weight's share of all words, at most `most` times its own words; what is cut off is shared
again by weight (water filling). Blocks of equal size are given out by highest quotients t / (2k - 1), for growing
numbers of blocks, one step per shard; since a larger house never takes a seat away, the differences are each shard's
integer quotas. A source's documents stand in a seeded order; its stream of words, repeated at most `most` times, is
cut into blocks, and each shard in turn draws its quota of blocks from that stream. A document's `parts` name the pass,
the shard and the blocks that take its words; what is taken of it is their sum.

Block size: `block_words`, or less where that would be more than 1% of the smallest positive target.
Very long texts span several blocks, and shards. Ties in the seeded order go by doc_id; repeated rows are documents of
their own. Null text has size 0; null source is a source of its own, the last; a document of size 0 is never taken;
an empty table gives an empty result. Extra columns are ignored, and kept by
mixed_documents whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, high_bits, ranked, stored


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def seeded(docs: DataFrame, seed: int) -> DataFrame:
    """The columns that decide on a document: its source, size and place in the seeded order."""
    return docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("place"))


def targets(sized: DataFrame, most: int = 3) -> DataFrame:
    """One row per source: source, ord, source_size, weight, target."""
    everything, by_name = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("ord", F.row_number().over(by_name)).withColumn("weight", ((F.col("ord") - 1) % 3 + 1).cast("double"))
    cap = F.col("source_size") * F.lit(float(most))
    by_ratio = W.orderBy(cap / F.col("weight"), "ord")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    src = (
        src.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("rest"))
        .withColumn("holds", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.coalesce(F.min(F.when(F.col("holds"), F.struct(F.col("cap") / F.col("weight"), F.col("ord"), F.col("level")))).over(everything)["level"], F.lit(0.0))
    return src.withColumn("target", F.least("cap", level * F.col("weight"))).select("source", "ord", "source_size", "weight", "target")


def quotas(goal: DataFrame, block_words: int = 64, shards: int = 8) -> DataFrame:
    """Blocks by (source, shard): ord, shard, blocks, block. Sums over shards are the Sainte-Lague seats."""
    everything = W.partitionBy()
    goal = goal.where("target > 0")
    goal = (
        goal.withColumn("total", F.sum("target").over(everything)).withColumn("n", F.count(F.lit(1)).over(everything))
        .withColumn("block", F.greatest(F.lit(1.0), F.least(F.lit(float(block_words)), F.floor(F.min("target").over(everything) / 100))))
        .withColumn("house", F.floor(F.col("total") / F.col("block") + 0.5))
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("house", F.floor(F.col("house") * F.col("shard") / shards))
    )

    def seats(n):
        return F.floor(F.col("target") * n / F.col("total") + 0.5).cast("long")

    goal = goal.withColumn("sure", seats(F.greatest(F.col("house") - F.col("n"), F.lit(0)))).withColumn("reach", seats(F.col("house") + F.col("n")))
    each = W.partitionBy("shard")
    goal = goal.withColumn("open", F.col("house") - F.sum("sure").over(each))
    claim = goal.where("reach > sure").select("ord", "shard", "open", "target", F.explode(F.sequence(F.col("sure") + 1, F.col("reach"))).alias("k"))
    best = each.orderBy((F.col("target") / (2 * F.col("k") - 1)).desc(), "ord", "k")
    won = claim.withColumn("rank", F.row_number().over(best)).where("rank <= open").groupBy("ord", "shard").agg(F.count(F.lit(1)).alias("won"))
    upto = goal.join(won, ["ord", "shard"], "left").select("ord", "shard", "block", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("upto"))
    step = W.partitionBy("ord").orderBy("shard")
    return upto.select("ord", "shard", (F.col("upto") - F.coalesce(F.lag("upto").over(step), F.lit(0))).alias("blocks"), F.col("block").cast("long").alias("block"))


def plan(sized: DataFrame, block_words: int = 64, shards: int = 8, most: int = 3) -> DataFrame:
    """One row per source: its target, its shards' stretches of the word stream, how often all of it is taken, and how many words more."""
    goal = targets(sized, most)
    upto = W.partitionBy("ord").orderBy("shard")  # one row per shard
    seats = quotas(goal, block_words, shards).withColumn("to", F.sum("blocks").over(upto)).withColumn("from", F.col("to") - F.col("blocks"))
    stretch = F.struct("shard", (F.col("from") * F.col("block")).alias("from"), (F.col("to") * F.col("block")).alias("to"))
    seats = seats.groupBy("ord").agg(F.max(F.col("to") * F.col("block")).alias("words"), F.max("block").alias("block"), F.sort_array(F.collect_list(stretch)).alias("stretches"))
    goal = goal.join(seats, "ord", "left").withColumn("end", F.col("source_size") * most)
    words = F.least(F.coalesce("words", F.lit(0)), F.col("end"))
    goal = goal.withColumn("words", words)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    return goal.withColumn("full", full).withColumn("more", F.col("words") - F.col("full") * F.col("source_size"))


def _parts(most: int):
    """What each shard takes of a document in each pass over its source: pass, shard, first and last block, words."""
    def of(turn):
        lo = turn * F.col("source_size") + F.col("before")
        hi = lo + F.col("size")
        met = F.filter("stretches", lambda x: (x["from"] < F.least(hi, F.col("end"))) & (x["to"] > lo))
        a, z = lambda x: F.greatest(x["from"], lo), lambda x: F.least(x["to"], hi)
        block = lambda c: F.floor(c / F.col("block")).cast("long")
        return F.transform(met, lambda x: F.struct(turn.alias("turn"), x["shard"].alias("shard"), block(a(x)).alias("first_block"), block(z(x) - 1).alias("last_block"), (z(x) - a(x)).alias("words")))

    parts = F.flatten(F.transform(F.array(*[F.lit(r).cast("long") for r in range(most)]), of))
    return F.when((F.col("size") > 0) & F.col("stretches").isNotNull(), parts).otherwise(F.array().cast("array<struct<turn:bigint,shard:int,first_block:bigint,last_block:bigint,words:bigint>>"))


def mix(docs: DataFrame, seed: int = 7, block_words: int = 64, shards: int = 8, most: int = 3) -> DataFrame:
    """Per document: doc_id, source, place, size, source_size, target, taken (words, repeats counted), parts."""
    sized = stored(seeded(docs, seed).withColumn("bucket", high_bits(F.col("place"), 12)))
    goal = stored(plan(sized, block_words, shards, most))
    own = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    own = ranked(own, ["ord"], "bucket", ["place", "doc_id"], "before", "size").withColumn("parts", _parts(most))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return own.select("doc_id", "source", "place", "size", "source_size", "target", taken.alias("taken"), "parts", "full", F.col("before").alias("words_before"), "more")


def mixed_documents(docs: DataFrame, seed: int = 7, block_words: int = 64, shards: int = 8, most: int = 3) -> DataFrame:
    """The documents of the mix with their own columns: a document stands once for each time that it is taken, in whole or in part.

    Only the small table of places is shuffled; a source's last place decides in a map over the documents.
    """
    taken = mix(docs, seed, block_words, shards, most)
    at = F.struct(high_bits(F.col("place"), 12).alias("bucket"), F.col("place").alias("place"))
    last = stored(taken.groupBy("source").agg(F.max("full").alias("full"), F.max(F.when(F.col("words_before") < F.col("more"), at)).alias("last")))
    d, last = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")), last.select(F.struct("source", "full", "last").alias("m"))
    both = d.join(last, F.col("d.source").eqNullSafe(F.col("m.source")))
    place = F.xxhash64(F.lit(seed), "d.doc_id", "d.text")
    again = F.when(F.struct(high_bits(place, 12).alias("bucket"), place.alias("place")) <= F.col("m.last"), 1).otherwise(0)
    copies = F.when(F.col("d.text").rlike(WORD), F.col("m.full") + again).otherwise(0)
    return both.withColumn("n", copies.cast("int")).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).select("d.*")
