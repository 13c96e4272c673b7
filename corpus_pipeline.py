"""A training corpus in five stages: toxic documents go, one document of each near-duplicate group stays, documents with
benchmark passages go, sources are mixed to their weights, and what is left is dealt to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import decontamination, mixing, ngram_join, sharding, toxicity
from matchloom.llm.common import broadcast_if_small, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, unchanged.

    Null, empty and wordless texts score as such and stay unless the labels speak against them; very long texts are scored
    whole; repeated rows, ties and null ids are judged by their text alone, each row for itself; other columns, whatever
    their names, are passed on; an empty table gives an empty one.
    """
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), [], only_clean=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: that of the smallest id, rows without one last; ties by text.

    A row is known by its id and text, so rows that share an id, or have none, are grouped by their texts as any others are,
    and of rows with equal ids and texts one stays. Null, empty and wordless texts are linked with nothing: only their
    repeated rows (same id, same text) go. Very long texts are compared whole; other columns, whatever their names, are
    passed on; an empty table gives an empty one.
    """
    name = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    named = docs.select(name.alias("_name"), "doc_id", "text")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_name")
    places = named.groupBy("_name").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
    linked = stored(ngram_join.join(named.select(F.col("_name").alias("doc_id"), "text")).select(F.col("doc_id").alias("_name"), "component_id").distinct())
    # Groups of several names; the first of a group is a minimum, combined before the shuffle.
    many = stored(linked.groupBy("component_id").agg(F.min("_name").alias("a"), F.max("_name").alias("b")).where("a < b").select("component_id"))
    members = stored(linked.join(broadcast_if_small(many), "component_id").join(places, "_name").select("_name", "component_id", "place"))
    first = stored(members.groupBy("component_id").agg(F.min("place").alias("first")))
    gone = stored(members.join(broadcast_if_small(first), "component_id").where(F.col("place") != F.col("first")).select("_name"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), name.alias("_name"))
    left = rows.join(broadcast_if_small(gone), "_name", "left_anti")
    twice = stored(places.where("n > 1").select("_name"))
    if not twice.isEmpty():
        again = left.join(twice, "_name", "left_semi").dropDuplicates(["_name"])
        left = left.join(twice, "_name", "left_anti").unionByName(again)
    return left.select("d.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, unchanged.

    Null and empty texts hold no item and stay; very long texts are read whole; repeated rows and ties are judged alike;
    other columns, whatever their names, are passed on; an empty table of documents or of items takes nothing away.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole or in part, three times at most.

    Null, empty and wordless texts have no words to take and go; a null source is one of its own, the last; repeated rows
    and null ids are rows of their own; ties fall by a seeded order of ids and texts; the columns of documents are
    returned; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix.

    Null texts have size 16 and are linked with nothing; equal texts are linked, so repeated rows share a shard as far as
    the quotas allow; null ids and ties are dealt by a seeded order; very long texts count as one row, as the law is rows;
    an empty table gives an empty one.
    """
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("balanced_sharding", deal_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
