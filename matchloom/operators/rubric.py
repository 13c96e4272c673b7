"""Rubrics as data: requirements with tiers, blocked terms, weights; steering as edits of these tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Default weights, threshold and most finalists.
WEIGHTS = {"required": 80.0, "preferred": 10.0, "availability": 5.0, "location": 5.0}
THRESHOLD, MOST = 56.0, 50
TIERS = ("required", "preferred", "dropped")
# Requirements that any holder of a role meets, which count as preferred only.
BASELINE = (
    "written communication", "communication skills", "verbal communication", "interpersonal skills", "presentation skills",
    "content creation", "data visualization", "troubleshooting", "problem solving", "problem-solving", "attention to detail",
    "time management", "organizational skills", "analytical skills", "critical thinking", "teamwork", "collaboration",
    "adaptability", "multitasking", "customer service", "reporting",
)


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if abs(sum(weights.values()) - 100) > 1e-6:
        raise ValueError(f"weights sum to {sum(weights.values())}, not to 100")
    return weights


def requirement_terms(terms: DataFrame, pillar: str = "skill") -> DataFrame:
    """key, term_ids (sorted): the terms that claim a requirement string, by key."""
    claims = terms.where(F.col("pillar") == pillar).select("term_id", F.explode("from_requirements").alias("f")).withColumn("key", X.normalize_key(F.col("f")))
    return claims.groupBy("key").agg(F.sort_array(F.collect_set("term_id")).alias("term_ids"))


def compile_rubrics(roles: DataFrame, terms: DataFrame, demote: bool = True) -> DataFrame:
    """requirement(role_id, req_pos, source, kind, tier, term_ids, verifiable, blocked, exp_min, exp_max, baseline_demoted)."""
    item = lambda tier: lambda s: F.struct(s.alias("source"), F.lit(tier).alias("cell"))
    slots = roles.select("role_id", F.posexplode(F.concat(F.transform("required", item("required")), F.transform("nice", item("preferred")))).alias("req_pos", "s")).select("role_id", "req_pos", "s.source", "s.cell")
    key = X.normalize_key(F.col("source"))
    plain = F.transform(F.array(*map(F.lit, BASELINE)), X.normalize_key)
    basic = roles.sparkSession.range(1).select(F.explode(plain).alias("key")).distinct().withColumn("basic", F.lit(True))
    skill = slots.withColumn("key", key).join(requirement_terms(terms), "key", "left").join(F.broadcast(basic), "key", "left").drop("key")  # the list above
    none = F.array().cast("array<string>")
    low = (F.col("cell") == "required") & F.coalesce("basic", F.lit(False)) & F.lit(demote)
    skill = skill.withColumn("term_ids", F.coalesce("term_ids", none)).withColumn("baseline_demoted", low).withColumn("tier", F.when(low, "preferred").otherwise(F.col("cell")))
    others = skill.select("role_id", F.col("req_pos").alias("other"), F.explode("term_ids").alias("t"))
    blocked = skill.select("role_id", "req_pos").join(others, "role_id").where("other <> req_pos").groupBy("role_id", "req_pos").agg(F.collect_set("t").alias("b"))
    skill = skill.join(blocked, ["role_id", "req_pos"], "left").withColumn("blocked", F.sort_array(F.array_except(F.coalesce("b", none), "term_ids")))
    skill = skill.select("role_id", "req_pos", "source", F.lit("skill").alias("kind"), "tier", "term_ids", (F.size("term_ids") > 0).alias("verifiable"), "blocked", F.lit(None).cast("int").alias("exp_min"), F.lit(None).cast("int").alias("exp_max"), "baseline_demoted")
    span = F.concat(F.col("exp_min").cast("string"), F.lit("-"), F.col("exp_max").cast("string"), F.lit(" years of relevant "), F.col("title"), F.lit(" experience"))
    years = roles.select("role_id", (F.size("required") + F.size("nice")).alias("req_pos"), span.alias("source"), F.lit("experience").alias("kind"), F.lit("required").alias("tier"), none.alias("term_ids"), F.lit(True).alias("verifiable"), none.alias("blocked"), "exp_min", "exp_max", F.lit(False).alias("baseline_demoted"))
    return skill.unionByName(years)


def rubrics(roles: DataFrame, weights: dict[str, float] = WEIGHTS, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """rubric(role_id, w_required, w_preferred, w_availability, w_location, threshold, most)."""
    check_weights(weights)
    return roles.select("role_id", *[F.lit(float(weights[k])).alias(f"w_{k}") for k in WEIGHTS], F.lit(float(threshold)).alias("threshold"), F.lit(most).alias("most"))


def apply_steering(requirements: DataFrame, rubric: DataFrame, retier: DataFrame | None = None, weights: dict[str, float] | None = None, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """New requirements and rubric. retier(role_id, source, tier, ord): the last row for a source wins. Blocked terms stay."""
    if retier is not None:
        last = retier.groupBy("role_id", "source").agg(F.max_by("tier", "ord").alias("_t"))
        last = last.withColumn("_t", F.when(F.col("_t").isin(*TIERS), F.col("_t")).otherwise(F.raise_error(F.lit("unknown tier"))))
        requirements = requirements.join(last, ["role_id", "source"], "left").withColumn("tier", F.coalesce("_t", "tier")).drop("_t")
    if weights is not None:
        check_weights(weights)
        for k in WEIGHTS:
            rubric = rubric.withColumn(f"w_{k}", F.lit(float(weights[k])))
    if threshold is not None:
        rubric = rubric.withColumn("threshold", F.lit(float(threshold)))
    return requirements, rubric


def steered(requirements: DataFrame, rubric: DataFrame, retier: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New requirements and rubric of every role that settings(role_id, w_..., threshold) name, as a reply's reader returns
    them; other roles stay."""
    requirements, _ = apply_steering(requirements, rubric, retier.join(settings.select("role_id"), "role_id", "left_semi"))
    new = settings.select("role_id", *[F.col(f"w_{k}").alias(f"_{k}") for k in WEIGHTS], F.col("threshold").alias("_threshold"))
    out = rubric.join(new, "role_id", "left")
    for k in WEIGHTS:
        out = out.withColumn(f"w_{k}", F.coalesce(f"_{k}", f"w_{k}")).drop(f"_{k}")
    return requirements, out.withColumn("threshold", F.coalesce("_threshold", "threshold")).drop("_threshold").select(rubric.columns)


def assessment_key(requirements: list) -> str:
    """The key of one role's requirements (rows in order): it changes with tiers and terms, not with weights."""
    rows = [{"source": r["source"], "kind": r["kind"], "term_ids": list(r["term_ids"]), "tier": r["tier"]} for r in sorted(requirements, key=lambda r: r["req_pos"])]
    return hashlib.sha256(json.dumps(rows, sort_keys=True).encode()).hexdigest()[:16]


def steering_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """role_id, source, tier_before, tier_after of the requirements that moved."""
    b = before.select("role_id", "req_pos", "source", F.col("tier").alias("tier_before"))
    return b.join(after.select("role_id", "req_pos", F.col("tier").alias("tier_after")), ["role_id", "req_pos"]).where("tier_before <> tier_after").select("role_id", "source", "tier_before", "tier_after")
