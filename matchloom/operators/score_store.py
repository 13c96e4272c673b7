"""Requirement scores kept between rubrics: scored once, read again for as long as what they depend on is the same.

A role's assessment key changes with its requirements, tiers and terms, not with weights or the threshold: a role whose key
is known needs no work. A requirement's key holds all that its scores depend on (terms, blocked terms, and the caller's
version of evidence and vocabulary), so a requirement that only moves to another tier, or that several roles share, is
scored once.

In the folder: scores/batch=/requirement_key= as Parquet, and one row in keys/ for each requirement of a batch, written
after its scores. A fill that dies between the two leaves scores that nothing reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import pinned

KEYS, ASSESSMENTS = "batch string, requirement_key string", "assessment_key string"


def assessment_keys(requirements: DataFrame) -> DataFrame:
    """role_id, assessment_key: 16 hex digits of the role's requirements in order, each with source, kind, terms and tier."""
    one = F.struct("req_pos", "source", "kind", "term_ids", "tier")
    each = requirements.groupBy("role_id").agg(F.sort_array(F.collect_list(one)).alias("r"))
    return each.select("role_id", F.substring(F.sha2(F.to_json(F.transform("r", lambda x: x.dropFields("req_pos"))), 256), 1, 16).alias("assessment_key"))


class ScoreStore:
    """version: names the evidence and the vocabulary; scores of another version are never read."""

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.folder, self.version = spark, folder, version
        for name, schema in (("keys", KEYS), ("assessments", ASSESSMENTS)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _held(self) -> DataFrame:
        """requirement_key, batch: a requirement that two fills scored at the same time is read from one of them."""
        return self._read("keys", KEYS).groupBy("requirement_key").agg(F.min("batch").alias("batch"))

    def keyed(self, requirements: DataFrame) -> DataFrame:
        """The skill requirements with terms, and their keys; others have no scores."""
        what = F.struct(F.lit(self.version).alias("version"), "kind", "term_ids", "blocked")
        return requirements.where("kind = 'skill' and size(term_ids) > 0").withColumn("requirement_key", F.sha2(F.to_json(what), 256))

    def fill(self, requirements: DataFrame, score: Callable[[DataFrame], DataFrame]) -> int:
        """Score what is missing and return how many requirements that were.

        score: from requirements(role_id, req_pos, ...) to (candidate_id, role_id, req_pos, score) and, as those of
        skill_scores, (via, field, phrase); all fills of a store give the same columns.
        """
        keys = assessment_keys(requirements).withColumn("assessment_key", F.concat("assessment_key", F.lit(f" {self.version}")))
        new_roles = pinned(keys.join(self._read("assessments", ASSESSMENTS), "assessment_key", "left_anti"))
        if new_roles.isEmpty():
            return 0
        moved = self.keyed(requirements.join(F.broadcast(new_roles.select("role_id")), "role_id", "left_semi"))  # roles of a rubric set
        moved = moved.join(self._held().select("requirement_key"), "requirement_key", "left_anti")
        missing = pinned(moved.dropDuplicates(["requirement_key"]).withColumn("role_id", F.col("requirement_key")).withColumn("req_pos", F.lit(0)).drop("requirement_key"))
        n = missing.count()
        if n:
            batch = uuid.uuid4().hex
            found = score(missing).withColumnRenamed("role_id", "requirement_key").drop("req_pos")
            found.hint("rebalance", "requirement_key").write.partitionBy("requirement_key").parquet(f"{self.folder}/scores/batch={batch}")
            missing.select(F.lit(batch).alias("batch"), F.col("role_id").alias("requirement_key")).write.mode("append").parquet(f"{self.folder}/keys")
        new_roles.select("assessment_key").distinct().write.mode("append").parquet(f"{self.folder}/assessments")
        return n

    def scores(self, requirements: DataFrame) -> DataFrame:
        """(candidate_id, role_id, req_pos, score[, via, field, phrase]) of these requirements, from the store alone."""
        want = pinned(self.keyed(requirements).join(self._held(), "requirement_key").select("role_id", "req_pos", "requirement_key", "batch"))
        batches = sorted(r["batch"] for r in want.select("batch").distinct().collect())  # one a fill
        cols = ["candidate_id", "role_id", "req_pos", "score", "via", "field", "phrase"]
        paths = [f"{self.folder}/scores/batch={b}" for b in batches]
        if not paths:
            return want.select(F.lit(None).cast("long").alias("candidate_id"), "role_id", "req_pos", F.lit(0.0).alias("score"), *[F.lit("").alias(c) for c in cols[4:]]).where("false")
        rows = self.spark.read.option("basePath", f"{self.folder}/scores").parquet(*paths)
        return rows.join(F.broadcast(want), ["batch", "requirement_key"]).select(*[c for c in cols if c in ("role_id", "req_pos") or c in rows.columns])
