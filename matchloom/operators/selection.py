"""Ranking, shortlists, strengths, gaps and briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..sources.store import small

# The wording and layout of gaps and briefs below, the order of gaps by kind, and the prose fields whose absence is a gap.
PRIORITY = {"absent_required": 0, "absent_preferred": 1, "adjacent_substitution": 2, "unverifiable": 3, "empty_field": 4, "logistics": 5}
PROSE = ("projects", "extra_curriculars", "education", "certifications")


def shortlist(scores: DataFrame, rubric: DataFrame, order: str = "candidate_id", fallback_n: int = 5) -> DataFrame:
    """The finalists alone. The filter on the rank, by the largest `most` of the rubrics, lets Spark keep that many per task."""
    most = rubric.agg(F.max("most")).first()[0] or 0
    out = scores.join(rubric.select("role_id", "threshold", "most"), "role_id")
    w = W.partitionBy("role_id").orderBy(F.col("total").desc(), order)
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(most, fallback_n))
    top = W.partitionBy("role_id")  # at most `most` rows
    out = out.withColumn("fallback", F.max("total").over(top) < F.col("threshold"))
    take = F.when(F.col("fallback"), F.col("rank") <= fallback_n).otherwise((F.col("total") >= F.col("threshold")) & (F.col("rank") <= F.col("most")))
    return out.where(take).drop("threshold", "most")


def excluded(scores: DataFrame, finalists: DataFrame) -> DataFrame:
    """Everyone who is no finalist of the role."""
    few = finalists.select("role_id", "candidate_id")
    few._rows = getattr(finalists, "_rows", None)
    return scores.join(small(few), ["role_id", "candidate_id"], "left_anti")


def assessments(scores: DataFrame, ids: list | DataFrame | None = None) -> DataFrame:
    """The results of some candidates, or all: ids as a list or as a table (candidate_id)."""
    if ids is None:
        return scores
    return scores.join(ids.select("candidate_id").distinct(), "candidate_id", "left_semi") if isinstance(ids, DataFrame) else scores.where(F.col("candidate_id").isin(ids))


def requirement_scores(pairs: DataFrame, scores: DataFrame, requirements: DataFrame) -> DataFrame:
    """A row for every skill requirement of these pairs (role_id, candidate_id) only; without evidence: 0, absent."""
    need = requirements.where("kind = 'skill'").select("role_id", "req_pos", "source", "tier", "verifiable")
    out = pairs.select("role_id", "candidate_id").join(need, "role_id").join(scores, ["candidate_id", "role_id", "req_pos"], "left")
    return out.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("via", F.coalesce("via", F.lit("absent")))


def strengths(scores: DataFrame) -> DataFrame:
    """Skill requirements with evidence, with their place by falling score, ties by position."""
    w = W.partitionBy("role_id", "candidate_id").orderBy(F.col("score").desc(), "req_pos")
    return scores.where("score > 0").withColumn("place", F.row_number().over(w))


def gaps(scores: DataFrame, people: DataFrame, matched: DataFrame) -> DataFrame:
    """(role_id, candidate_id, kind, detail, place): what is missing, in order of priority.

    scores: a row for every skill requirement (role_id, candidate_id, req_pos, source, tier, verifiable, score, via, phrase).
    """
    named = F.concat(F.lit('"'), F.col("source"), F.lit('" ('), F.col("tier"), F.lit(")"))
    kind = F.when(~F.col("verifiable"), "unverifiable").when((F.col("score") == 0) & (F.col("tier") == "required"), "absent_required").when(F.col("score") == 0, "absent_preferred").when(F.col("via") == "adjacent", "adjacent_substitution")
    detail = (
        F.when(~F.col("verifiable"), F.concat(named, F.lit(" — no vocabulary term exists for this yet")))
        .when(F.col("score") == 0, F.concat(named, F.lit(" — no evidence in the profile")))
        .otherwise(F.concat(named, F.lit(' — credited via a related skill ("'), F.col("phrase"), F.lit('"), not named directly')))
    )
    skill = scores.withColumn("kind", kind).where("kind is not null").select("role_id", "candidate_id", "kind", detail.alias("detail"), F.col("req_pos").alias("seq"))
    empty = F.filter(F.array(*[F.when(X.blank(F.col(f)), F.lit(f)) for f in PROSE]), lambda x: x.isNotNull())
    pair = matched.join(people, "candidate_id").withColumn("_e", empty)
    key = ["role_id", "candidate_id"]
    blank = pair.where(F.size("_e") > 0).select(*key, F.lit("empty_field").alias("kind"), F.concat(F.lit("no "), F.array_join("_e", ", "), F.lit(" listed on the profile")).alias("detail"), F.lit(10_000).alias("seq"))
    notice = pair.where("availability_score < 1").select(*key, F.lit("logistics").alias("kind"), F.concat(F.lit('notice period: "'), F.coalesce("notice_raw", F.lit("")), F.lit('" — not immediately available')).alias("detail"), F.lit(10_001).alias("seq"))
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "unknown").otherwise(F.col(c))
    away = pair.where("location_score < 1").select(*key, F.lit("logistics").alias("kind"), F.concat(F.lit("location: "), known("city"), F.lit(", "), known("country"), F.lit(" — not the role's location")).alias("detail"), F.lit(10_002).alias("seq"))
    every = skill.union(blank).union(notice).union(away)
    order = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("kind")), F.lit(9))
    w = W.partitionBy(*key).orderBy(order, "seq")
    return every.withColumn("place", F.row_number().over(w)).drop("seq")


def top_gaps(gap: DataFrame, n: int = 3) -> DataFrame:
    return gap.where(F.col("place") <= n)


def padded_questions(questions, details):
    """The first questions, one for each gap; a missing one is the gap's own text."""
    return F.transform(details, lambda d, i: F.coalesce(F.get(questions, i), d))


def brief_lines(finalists: DataFrame, strong: DataFrame, gap: DataFrame, experience: DataFrame, people: DataFrame, texts: DataFrame | None = None, n: int = 3) -> DataFrame:
    """One row per finalist with the parts of its brief. texts(role_id, candidate_id, summary, differentiator, questions) may come from any generator."""
    key = ["role_id", "candidate_id"]
    s = strong.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "source", "via", "field", "phrase"))).alias("strengths"))
    g = top_gaps(gap, n).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "detail"))), lambda x: x["detail"]).alias("details"))
    out = finalists.join(s, key, "left").join(g, key, "left").join(experience.select(*key, "stated_years", "implied_years", "conflict"), key).join(people.select("candidate_id", "headline"), "candidate_id")
    none = F.array().cast("array<string>")
    if texts is None:
        out = out.withColumn("summary", F.lit("")).withColumn("differentiator", F.lit("")).withColumn("questions", none)
    else:
        out = out.join(texts, key, "left")
    return out.withColumn("questions", padded_questions(F.coalesce("questions", none), F.coalesce("details", none)))


def render_briefs(lines: DataFrame, roles: DataFrame, rubric: DataFrame) -> DataFrame:
    """(role_id, markdown): the briefs of a role's finalists in order of rank."""
    num = X.short_number
    nl = F.lit("\n")
    strong = F.coalesce("strengths", F.array().cast("array<struct<place:int,source:string,via:string,field:string,phrase:string>>"))
    bullets = F.array_join(F.transform(strong, lambda s: F.concat(F.lit("- "), s["source"], F.lit(" — "), s["via"], F.lit(", from "), s["field"], F.lit(' ("'), s["phrase"], F.lit('")\n'))), "")
    off = F.when(F.col("conflict") & F.col("stated_years").isNotNull(), F.concat(F.lit(" — profile states "), num(F.col("stated_years")), F.lit("y, dates imply "), num(F.col("implied_years")), F.lit("y"))).otherwise("")
    asks = F.array_join(F.transform("questions", lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q, nl)), "")
    part = F.concat(
        F.lit("## "), F.col("candidate_id").cast("string"), F.lit(" — "), num(F.col("total")), F.lit("\n\n_"), F.coalesce("headline", F.lit("")), F.lit("_\n\n"), F.coalesce("summary", F.lit("")), F.lit("\n\n**What sets them apart:** "), F.coalesce("differentiator", F.lit("")), F.lit("\n\n"),
        F.when(F.size(strong) > 0, F.concat(F.lit("**Strengths**\n"), bullets, nl)).otherwise(""),
        F.lit("**Relevant experience:** "), num(F.col("implied_years")), F.lit("y"), off, F.lit("\n\n"),
        F.when(F.size("questions") > 0, F.concat(F.lit("**Questions**\n"), asks, nl)).otherwise(""),
        F.lit("---\n\n"),
    )
    body = lines.groupBy("role_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "").alias("body"), F.max("fallback").alias("fallback"), F.count(F.lit(1)).alias("n"))
    out = body.join(roles.select("role_id", "title"), "role_id").join(rubric.select("role_id", "threshold"), "role_id")
    note = F.when(F.col("fallback"), F.concat(F.lit("_No candidate cleared the shortlist threshold of "), num(F.col("threshold")), F.lit(". Showing the highest-scoring "), F.col("n").cast("string"), F.lit(" instead — consider lowering the threshold._\n\n"))).otherwise("")
    return out.select("role_id", F.concat(F.regexp_replace(F.concat(F.lit("# "), F.col("role_id").cast("string"), F.lit(" — "), F.col("title"), F.lit("\n\n"), note, F.col("body")), r"(?U)\s+$", ""), nl).alias("markdown"))
