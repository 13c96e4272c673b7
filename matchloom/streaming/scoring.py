"""Arriving mentions scored against stored rubrics, with the best evidence of each person kept as state.

A person's mentions may come over any number of batches, in any order and more than once: state holds the best evidence for
each term and the earliest place of any, and both only grow. State is a table in the checkpoint's folder, evidence/batch=,
which a batch adds to: it merges its mentions with what earlier batches hold of the same people, in one aggregate, and
writes all terms of those whose evidence has changed. It scores these anew and whole, and writes them to a folder of its own
too, so that a batch that is tried again replaces itself and reads nothing of its first try; of a person, the latest batch
counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching
from ..sources.store import small

STATE = "candidate_id {0}, term_id string, v double, ord long, field string, phrase string, have_ord long"


def better(a: tuple | None, b: tuple) -> tuple:
    """Of two (v, ord, field, phrase, have_ord), the better evidence, with the earlier have_ord: the rule of merged()."""
    if a is None:
        return b
    return (*max(a[:4], b[:4], key=lambda x: (x[0], -x[1], x[2] or "", x[3] or "")), min(a[4], b[4]))


def merged(new: DataFrame, held: DataFrame) -> DataFrame:
    """All terms of the people in whose evidence `new` changes anything against `held`; both as STATE, with any number of
    rows for a person's term, those of a value above 0 count. All of a person's rows are moved together, once."""
    rows = new.withColumn("_held", F.lit(False)).unionByName(held.withColumn("_held", F.lit(True))).repartition("candidate_id")
    counts = F.col("v") > 0
    pick = F.when(counts, F.struct("v", (-F.col("ord")).alias("o"), "field", "phrase"))
    was = lambda c: F.when(F.col("_held"), c)
    best = rows.groupBy("candidate_id", "term_id").agg(F.max(pick).alias("b"), F.min(F.when(counts, F.col("have_ord"))).alias("have_ord"), F.max(was(pick)).alias("b0"), F.min(was(F.col("have_ord"))).alias("o0"))
    moved = ~(F.col("b").eqNullSafe(F.col("b0")) & F.col("have_ord").eqNullSafe(F.col("o0")))
    best = best.withColumn("_moved", F.max(moved).over(W.partitionBy("candidate_id"))).where("_moved and b is not null")
    return best.select("candidate_id", "term_id", "b.v", (-F.col("b.o")).alias("ord"), "b.field", "b.phrase", "have_ord")


def score_arrivals(mentions: DataFrame, route: DataFrame, requirements: DataFrame, out: str, checkpoint: str, surface: DataFrame | None = None) -> StreamingQuery:
    """Skill scores of arriving people, in a folder for each batch; latest_scores() reads them."""
    spark, state = mentions.sparkSession, f"{checkpoint}/evidence"
    schema = STATE.format(mentions.schema["candidate_id"].dataType.simpleString())
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{state}/batch=-1")

    def one(arrived: DataFrame, number: int) -> None:
        held = spark.read.schema(f"{schema}, batch long").parquet(state).where(F.col("batch") < number).drop("batch")
        people = arrived.select("candidate_id").distinct()
        some = small(people)
        if some is not people:  # few people: only their state is moved
            held = held.join(some, "candidate_id", "left_semi")
        new = matching.with_values(arrived, surface).select("candidate_id", "term_id", "v", F.col("ord").cast("long").alias("ord"), "field", "phrase").withColumn("have_ord", F.col("ord"))
        merged(new, held).write.mode("overwrite").parquet(f"{state}/batch={number}")
        have = spark.read.schema(schema).parquet(f"{state}/batch={number}").drop("ord").repartition("candidate_id")
        scores = matching.skill_scores(matching.term_routes(have, route, requirements))
        scores.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return mentions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_scores(spark: SparkSession, out: str) -> DataFrame:
    """Of each person the rows of the last batch that scored them."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("candidate_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["candidate_id", "batch"], "left_semi").drop("batch")
