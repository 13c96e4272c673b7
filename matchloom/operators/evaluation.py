"""Evaluation of links and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..sources.store import stored


def link_metrics(golden: DataFrame, mentions: DataFrame, id_col: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall. golden(id, field, text, expected); mentions(id, field, phrase, term_id, ord).

    The first mention of the same field and phrase counts, case ignored. A wrong term is a false positive only.
    """
    first = mentions.groupBy(id_col, "field", F.lower("phrase").alias("low")).agg(F.min_by("term_id", "ord").alias("found"))
    both = golden.withColumn("low", F.lower("text")).join(first, [id_col, "field", "low"], "left")
    hit, want = F.col("found").isNotNull(), F.col("expected").isNotNull()
    out = both.agg(
        F.count_if(want & hit & (F.col("found") == F.col("expected"))).alias("tp"),
        F.count_if(hit & (~want | (F.col("found") != F.col("expected")))).alias("fp"),
        F.count_if(want & ~hit).alias("fn"),
        F.count_if(~want & ~hit).alias("tn"),
    )
    ratio = lambda other: F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(other)), F.lit(1.0))
    return out.withColumn("precision", ratio("fp")).withColumn("recall", ratio("fn"))


def regressions(now: dict, base: dict) -> list[str]:
    """What got worse: precision or recall fell, or more groups are inconsistent."""
    out = [f"{k} fell from {base[k]} to {now[k]}" for k in ("precision", "recall") if now[k] < base[k] - 1e-9]
    if now.get("inconsistent", 0) > base.get("inconsistent", 0):
        out.append(f"inconsistent groups rose from {base['inconsistent']} to {now['inconsistent']}")
    return out


def positions(scores: DataFrame, group: str, score: str, id_col: str) -> DataFrame:
    """scores with rank (from 0) by falling score, ties by id, null scores last, and n, the group's size.

    One range sort by all three, so neither a large group nor many equal scores fall to one task. A group lies in few
    neighbouring partitions; one row for each of them carries what stands before it.
    """
    order = [F.asc_nulls_first(group), F.desc_nulls_last(score), F.col(id_col)]
    placed = stored(scores.sort(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    each = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = W.partitionBy(group)  # a row a partition at most
    each = each.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first", (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("n"))
    out = placed.join(each, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_g", "_p", "_first", "_before")


def sample_across(scores: DataFrame, group: str, score: str, id_col: str, n: int) -> DataFrame:
    """n rows of each group spread evenly over its ranking, first and last included."""
    every = positions(scores, group, score, id_col)
    steps = scores.sparkSession.range(n).select((F.col("id") * 1.0).alias("i"))
    at = every.select(group, "n").distinct().join(F.broadcast(steps)).select(group, X.py_round(F.col("i") * (F.col("n") - 1) / F.lit(float(max(1, n - 1))), 0).cast("int").alias("rank")).distinct()  # n rows
    return every.where(F.col("n") > n).join(at, [group, "rank"], "left_semi").unionByName(every.where(F.col("n") <= n).select(*[c for c in every.columns])) if n > 1 else every.where("rank = 0")


def precision_at_k(scores: DataFrame, grades: DataFrame, group: str, score: str, id_col: str, k: int, relevant: int = 2) -> DataFrame:
    """(group, precision): among the graded of the first k, the share graded `relevant` or more; none graded: 0."""
    w = W.partitionBy(group).orderBy(F.col(score).desc(), id_col)
    top = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    got = top.join(grades, [group, id_col], "left").groupBy(group)
    return got.agg(F.coalesce(F.try_divide(F.count_if(F.col("grade") >= relevant).cast("double"), F.count("grade")), F.lit(0.0)).alias("precision"))


def ndcg_at_k(scores: DataFrame, grades: DataFrame, group: str, score: str, id_col: str, k: int) -> DataFrame:
    """(group, ndcg): gain 2^grade - 1, discount log2(place + 1), ungraded 0; without any gain 1."""
    def gained(order):
        return lambda rows: rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("place") <= k).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("place", ((F.pow(F.lit(2.0), F.coalesce("grade", F.lit(0))) - 1) / F.log2(F.col("place") + 1)).alias("g")))).alias("l"))

    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + x["g"])
    dcg = scores.join(grades, [group, id_col], "left").transform(gained([F.col(score).desc(), id_col])).select(group, total.alias("dcg"))
    ideal = grades.transform(gained([F.col("grade").desc(), id_col])).select(group, total.alias("idcg"))
    out = dcg.join(ideal, group, "left")
    return out.select(group, F.when(F.coalesce("idcg", F.lit(0.0)) == 0, 1.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def ranking_report(scores: DataFrame, grades: DataFrame, group: str, score: str, id_col: str) -> DataFrame:
    """(group, precision_at_5, ndcg_at_10, n_graded), rounded to four places."""
    p = precision_at_k(scores, grades, group, score, id_col, 5)
    n = ndcg_at_k(scores, grades, group, score, id_col, 10)
    c = grades.groupBy(group).agg(F.count(F.lit(1)).alias("n_graded"))
    return p.join(n, group).join(c, group, "left").select(group, X.py_round(F.col("precision"), 4).alias("precision_at_5"), X.py_round(F.col("ndcg"), 4).alias("ndcg_at_10"), F.coalesce("n_graded", F.lit(0)).alias("n_graded"))


CASES = "case_id string, role_id string, tiers map<string,string>, weight string, weight_way string, threshold_way string, refusal boolean"


def steering_report(cases: DataFrame, before: DataFrame, after: DataFrame, runs: DataFrame) -> DataFrame:
    """(case_id, passed, wrong): steered rubrics held against what each case expects.

    cases as CASES: tiers that must be set, the weight and the threshold that must go "up" or "down", whether a refusal is
    expected. before(role_id, source, tier); after(case_id, source, tier); runs(case_id, weights_before, weights_after:
    maps, threshold_before, threshold_after, refused: how many parts were refused). One full join of both rubrics tells
    what moved: tiers that a case names must be set, and where it names any, no other may move. An empty case fails.
    """
    base = cases.select("case_id", "role_id", "tiers").join(before, "role_id").select("case_id", "tiers", "source", F.col("tier").alias("old"))
    both = base.join(after.select("case_id", "source", F.col("tier").alias("new")), ["case_id", "source"], "full").drop("tiers").join(cases.select("case_id", "tiers"), "case_id")
    want = F.try_element_at("tiers", F.col("source"))
    off = F.when(want.isNotNull(), ~want.eqNullSafe(F.col("new"))).otherwise((F.size("tiers") > 0) & ~F.col("old").eqNullSafe(F.col("new")))
    named = both.where("source is not null").groupBy("case_id").agg(F.sort_array(F.collect_list(F.when(off, F.concat("source", F.lit(" is "), F.coalesce("new", F.lit("gone")))))).alias("moved"), F.collect_set("source").alias("sources"))
    out = cases.join(named, "case_id", "left").join(runs, "case_id", "left")
    way = lambda w, a, b: F.when(w == "up", b > a).when(w == "down", b < a)
    some = (F.size("tiers") > 0) | F.col("weight").isNotNull() | F.col("threshold_way").isNotNull() | F.col("refusal")
    none = F.array().cast("array<string>")
    lacking = F.filter(F.map_keys("tiers"), lambda k: ~F.coalesce(F.array_contains("sources", k), F.lit(False)))
    checks = [
        (~some, "nothing is expected"),
        (F.col("weight").isNotNull() & ~F.coalesce(way(F.col("weight_way"), F.try_element_at("weights_before", F.col("weight")), F.try_element_at("weights_after", F.col("weight"))), F.lit(False)), "the weight did not move that way"),
        (F.col("threshold_way").isNotNull() & ~F.coalesce(way(F.col("threshold_way"), F.col("threshold_before"), F.col("threshold_after")), F.lit(False)), "the threshold did not move that way"),
        (F.col("refusal") & (F.coalesce("refused", F.lit(0)) == 0), "nothing was refused"),
        (~F.col("refusal") & (F.coalesce("refused", F.lit(0)) > 0) & (F.size("tiers") == 0) & F.col("weight").isNull(), "something was refused"),
    ]
    said = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))
    wrong = F.concat(F.coalesce("moved", none), F.transform(lacking, lambda k: F.concat(k, F.lit(" is missing"))), said)
    return out.select("case_id", (F.size(wrong) == 0).alias("passed"), wrong.alias("wrong"))


def untraced(evidence: DataFrame, fields: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """Scored evidence (id, field, phrase, score) whose phrase does not stand in the person's field."""
    out = evidence.where("score > 0").join(fields.select(id_col, "field", F.lower("text").alias("_t")), [id_col, "field"], "left")
    return out.where(~F.coalesce(F.col("_t").contains(F.lower("phrase")), F.lit(False))).drop("_t")


def unexplained_rejects(matched: DataFrame, past: DataFrame, targets: DataFrame, skills: DataFrame, requirements: DataFrame, rubric: DataFrame) -> DataFrame:
    """(role_id, candidate_id, total): people who held a role's very occupation, lie below its threshold and lack no required skill.

    skills has a row for each requirement with evidence; a pair lacks one if fewer of the required ones score above 0.
    """
    held = past.where("own_weight = 1").select("candidate_id", "occupation_id").distinct().join(targets.select("role_id", "occupation_id"), "occupation_id").select("role_id", "candidate_id")
    need = requirements.where("kind = 'skill' and tier = 'required'")
    met = skills.where("score > 0").join(need.select("role_id", "req_pos"), ["role_id", "req_pos"]).groupBy("role_id", "candidate_id").agg(F.count(F.lit(1)).alias("_met"))
    below = matched.join(rubric.select("role_id", "threshold"), "role_id").where("total < threshold").join(held, ["role_id", "candidate_id"], "left_semi")
    out = below.join(need.groupBy("role_id").agg(F.count(F.lit(1)).alias("_need")), "role_id", "left").join(met, ["role_id", "candidate_id"], "left")
    return out.where(F.coalesce("_met", F.lit(0)) >= F.coalesce("_need", F.lit(0))).select("role_id", "candidate_id", "total")


def hole_audit(skills: DataFrame, finalists: DataFrame, requirements: DataFrame, holes: int = 2) -> DataFrame:
    """One row: finalists, those with `holes` or more unmet required skills, and requirement slots met over all pairs.

    skills has a row for each requirement with evidence; what is unmet follows from the size of the rubric.
    """
    need = requirements.where("kind = 'skill' and tier = 'required'")
    met = skills.where("score > 0").join(finalists.select("role_id", "candidate_id"), ["role_id", "candidate_id"], "left_semi").join(need.select("role_id", "req_pos"), ["role_id", "req_pos"], "left_semi").groupBy("role_id", "candidate_id").agg(F.count(F.lit(1)).alias("_met"))
    out = finalists.select("role_id", "candidate_id").join(met, ["role_id", "candidate_id"], "left").join(need.groupBy("role_id").agg(F.count(F.lit(1)).alias("_need")), "role_id", "left")
    slots = skills.agg(F.count_if(F.col("score") > 0).alias("slots_met"))
    unmet = F.coalesce("_need", F.lit(0)) - F.coalesce("_met", F.lit(0))
    return out.agg(F.count(F.lit(1)).alias("finalists"), F.count_if(unmet >= holes).alias("with_holes")).join(slots)
