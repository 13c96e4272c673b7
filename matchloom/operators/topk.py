"""Shortlists without scoring everyone: bounds first, exact scores only for pairs that can still be finalists.

For every person and role with evidence, a few 64-bit masks say which requirements some evidence reaches at each of LEVELS
levels of value; they come from one aggregate of bit_or, combined before the shuffle. With a plain sum of relevant years,
availability and location they bound the total from above. The pairs with the highest bounds of each role are scored first;
the totals found give the role's floor (its threshold, or the last place that can still be taken), and of all other pairs
only those whose bound reaches the floor are scored. The result is that of scoring everyone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..sources.store import stored
from . import matching, selection

LEVELS = 20
#: Requirements from this place on count as met in a bound.
BITS = 60
#: What rounding may add: years by half a hundredth, a share of years by half a thousandth, a total by half a tenth and its
#: four parts by half a thousandth each.
YEARS_SLACK, SHARE_SLACK, TOTAL_SLACK = 0.006, 0.001, 0.053
PAIR = ["candidate_id", "role_id"]


def _bit(place: Column) -> Column:
    return F.pow(F.lit(2.0), place).cast("long")  # exact below 2^53, and powers of two beyond


class Field:
    """All that pairs are scored from: have, routes, people, past roles with their occupations, roles' target occupations,
    adjacent occupations, roles, requirements and rubric. What grows with the people is read three times, so it is stored."""

    def __init__(self, have, route, people, past, targets, near, roles, requirements, rubric, country_of=matching.COUNTRY_OF):
        self.have, self.people, self.past = stored(have), stored(people), stored(past)
        self.route, self.targets, self.near = route, targets, near
        self.roles, self.requirements, self.rubric, self.country_of = roles, requirements, rubric, country_of

    def scored(self, pairs: DataFrame) -> DataFrame:
        """Exact scores of these pairs, from their people's evidence and past roles alone."""
        who = pairs.select("candidate_id").distinct()
        skills = matching.skill_scores(matching.term_routes(self.have, self.route, self.requirements, pairs))
        years = matching.relevant_years(self.past.join(who, "candidate_id", "left_semi"), self.targets, self.near)
        experience = matching.experience_scores(self.people, self.requirements, years, pairs=pairs)
        return matching.match_scores(skills, experience, matching.location_scores(self.people, self.roles, self.country_of, pairs), self.requirements, self.rubric)

    def frame(self) -> DataFrame:
        """A row for each role: masks of its tiers, their sizes, how many of them ask for years, how many a bound takes as
        met, the span of years, and the weights."""
        tier, skill, years = F.col("tier"), F.col("kind") == "skill", F.col("kind") == "experience"
        bit = F.when(skill & (F.col("req_pos") < BITS), _bit(F.col("req_pos")))
        agg = [F.min("exp_min").alias("exp_min"), F.max("exp_max").alias("exp_max")]
        for name in ("required", "preferred"):
            own = tier == name
            agg += [F.coalesce(F.bit_or(F.when(own, bit)), F.lit(0)).alias(f"{name}_mask"), F.count_if(own).alias(f"{name}_n"), F.count_if(own & years).alias(f"{name}_years"), F.count_if(own & ~years & bit.isNull()).alias(f"{name}_free")]
        return self.requirements.groupBy("role_id").agg(*agg).join(self.rubric, "role_id")

    def masks(self) -> DataFrame:
        """candidate_id, role_id, m1, m2 ... of every pair with evidence: the requirements reached at each level."""
        factor = F.when(F.col("route") == 2, F.col("weight")).otherwise(1.0)
        reach = matching.reaches(self.route, self.requirements).where(F.col("req_pos") < BITS)
        gain = reach.groupBy("have", "role_id", factor.alias("factor")).agg(F.bit_or(_bit(F.col("req_pos"))).alias("bits"))
        rows = self.have.select("candidate_id", F.col("term_id").alias("have"), "v").join(gain, "have").select(*PAIR, "bits", X.py_round(F.col("v") * F.col("factor"), 3).alias("v"))
        return rows.groupBy(*PAIR).agg(*[F.coalesce(F.bit_or(F.when(F.col("v") > (k - 1) / LEVELS, F.col("bits"))), F.lit(0)).alias(f"m{k}") for k in range(1, LEVELS + 1)])

    def bounds(self, pairs: DataFrame) -> DataFrame:
        """pairs with `bound`, which no pair's total exceeds; pairs without masks have no evidence."""
        years = matching.relevant_past(self.past, self.targets, self.near).groupBy(*PAIR).agg(F.sum("y").alias("y"))
        places = matching.location_scores(self.people, self.roles, self.country_of, pairs)
        rows = pairs.join(places, PAIR).join(years, PAIR, "left").join(self.frame(), "role_id")
        y = F.coalesce("y", F.lit(0.0))
        fit = F.when(y + YEARS_SLACK <= 0, 0.0).when(y - YEARS_SLACK > F.col("exp_max"), 0.85).when(y + YEARS_SLACK >= F.col("exp_min"), 1.0).otherwise((y + YEARS_SLACK) / F.col("exp_min") + SHARE_SLACK)
        fit = F.when(F.col("y").isNull(), 0.0).otherwise(F.coalesce(fit, F.lit(1.0)))

        def part(name: str) -> Column:
            met = sum((F.bit_count(F.coalesce(F.col(f"m{k}"), F.lit(0)).bitwiseAND(F.col(f"{name}_mask"))) for k in range(1, LEVELS + 1)), F.lit(0)) / LEVELS
            return F.when(F.col(f"{name}_n") > 0, F.col(f"w_{name}") * (met + F.col(f"{name}_free") + F.col(f"{name}_years") * fit) / F.col(f"{name}_n")).otherwise(0.0)

        total = part("required") + part("preferred") + F.col("w_availability") * F.col("availability_score") + F.col("w_location") * F.col("location_score")
        return rows.select(*PAIR, (total + TOTAL_SLACK).alias("bound"))


def shortlist(field: Field, order: str = "candidate_id", fallback_n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(finalists as selection.shortlist gives them, and role_id, scored, people: how many were scored exactly of how many)."""
    rubric = field.rubric
    k = max(rubric.agg(F.max("most")).first()[0] or 0, fallback_n)
    bound = stored(field.bounds(field.masks()))
    top = W.partitionBy("role_id").orderBy(F.desc("bound"), order)
    seeds = stored(bound.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k).select(*PAIR))
    first = stored(field.scored(seeds))
    totals = first.groupBy("role_id").agg(F.sort_array(F.collect_list("total"), asc=False).alias("t"))  # k a role at most
    last = F.get("t", F.col("most") - 1)
    floor = F.when(F.col("t")[0] >= F.col("threshold"), F.greatest("threshold", F.coalesce(last, F.col("threshold")))).otherwise(F.get("t", F.lit(fallback_n - 1)))
    floors = field.frame().join(totals, "role_id", "left").withColumn("floor", F.coalesce(floor, F.lit(float("-inf"))))
    line = floors.select("role_id", "floor")
    rest = bound.join(line, "role_id").where("bound >= floor").join(seeds, PAIR, "left_anti").select(*PAIR)
    # People without evidence count only in roles whose floor they can reach at all.
    free = lambda name: F.when(F.col(f"{name}_n") > 0, F.col(f"w_{name}") * (F.col(f"{name}_free") + F.col(f"{name}_years")) / F.col(f"{name}_n")).otherwise(0.0)
    most = free("required") + free("preferred") + F.col("w_availability") + F.col("w_location") + TOTAL_SLACK
    open_ = stored(floors.where(most >= F.col("floor")).select("role_id", "floor"))
    more = stored(rest if open_.isEmpty() else rest.union(_without_evidence(field, bound, open_)))
    scored = first.unionByName(field.scored(more))
    finalists = selection.shortlist(scored, rubric, order, fallback_n)
    people = field.people.agg(F.count(F.lit(1)).alias("people"))
    counts = seeds.union(more).groupBy("role_id").agg(F.count(F.lit(1)).alias("scored"))
    return finalists, field.roles.select("role_id").join(counts, "role_id", "left").fillna(0, ["scored"]).join(F.broadcast(people))  # one row


def _without_evidence(field: Field, bound: DataFrame, open_: DataFrame) -> DataFrame:
    every = matching.with_roles(field.people.select("candidate_id"), open_, None).select(*PAIR).join(bound, PAIR, "left_anti")
    bare = field.bounds(every.select(*PAIR, *[F.lit(0).cast("long").alias(f"m{k}") for k in range(1, LEVELS + 1)]))
    return bare.join(open_, "role_id").where("bound >= floor").select(*PAIR)
