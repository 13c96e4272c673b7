"""Scoring of rubrics against people: pure joins and aggregates.

People x roles is what the result holds; requirements, routes and rubrics are vocabulary-sized and planned as broadcast
sides by their measured size. Each person's evidence is aggregated once and used for all rubrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import small
from .vocabulary import mirrored, narrower_closure

# How much a field's evidence counts; other fields count whole.
FIELD_STRENGTH = {"skills": 1.0, "projects": 1.0, "past_roles": 1.0, "headline": 0.9, "certifications": 0.75, "education": 0.7, "extra_curriculars": 0.6}
ADJACENT = 0.6
# The country of a role's city, both as keys.
COUNTRY_OF = {
    "dubai": "uae", "abu-dhabi": "uae", "sharjah": "uae", "riyadh": "saudi-arabia", "jeddah": "saudi-arabia",
    "cairo": "egypt", "alexandria": "egypt", "amman": "jordan", "beirut": "lebanon", "doha": "qatar",
}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def with_values(mentions: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    """mentions(candidate_id, term_id, field, phrase, relation, ord[, key]) with their value v; those above 0 count. A phrase
    that is one of the term's related phrases is capped at its weight. key: the phrase's, where its maker knows it for fewer
    rows. Callers leave out what does not count when they aggregate: a filter here works each value out several times."""
    base = F.when(F.col("relation") == "met", 1.0).otherwise(ADJACENT)
    rows = mentions
    if surface is not None:
        cap = surface.where("pillar = 'skill' and kind = 'related'").groupBy("term_id", "key").agg(F.min_by("weight", "ord").alias("cap"))
        rows = (rows if "key" in rows.columns else rows.withColumn("key", X.normalize_key(F.col("phrase")))).join(cap, ["term_id", "key"], "left")
        base = F.least(base, F.coalesce("cap", F.lit(1.0)))
    strength = F.coalesce(F.try_element_at(literal_map(FIELD_STRENGTH), F.col("field")), F.lit(1.0))
    return rows.withColumn("_x", base * strength).withColumn("v", X.py_round(F.col("_x"), 3)).drop("_x")


def have_terms(mentions: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    """(candidate_id, term_id, v, field, phrase, have_ord): the best evidence per term, the earliest on ties."""
    rows, counts = with_values(mentions, surface), F.col("v") > 0
    best = rows.groupBy("candidate_id", "term_id").agg(F.max(F.when(counts, F.struct("v", (-F.col("ord")).alias("o"), "field", "phrase"))).alias("b"), F.min(F.when(counts, F.col("ord"))).alias("have_ord"))
    return best.where("b is not null").select("candidate_id", "term_id", "b.v", "b.field", "b.phrase", "have_ord")


def have_values(mentions: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    """(candidate_id, term_id, v): have_terms without saying which evidence it is. All of a person's rows lie together, so
    what is made of them needs no other shuffle, and neither places nor texts are moved."""
    rows = with_values(mentions, surface).select("candidate_id", "term_id", "v").repartition("candidate_id")
    return rows.groupBy("candidate_id", "term_id").agg(F.max("v").alias("v")).where("v > 0")


def routes(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """(have, term_id, route, weight): 0 the term itself, 1 a narrower one below it, 2 an adjacent one."""
    own = terms.where("pillar = 'skill'").select(F.col("term_id").alias("have"), "term_id", F.lit(0).alias("route"), F.lit(1.0).alias("weight"))
    down = narrower_closure(edges).where("src <> dst").select(F.col("src").alias("have"), F.col("dst").alias("term_id"), F.lit(1).alias("route"), F.lit(1.0).alias("weight"))
    side = mirrored(edges).where("pillar = 'skill'").select(F.col("src").alias("have"), F.col("dst").alias("term_id"), F.lit(2).alias("route"), "weight")
    return own.union(down).union(side)


def reaches(route: DataFrame, requirements: DataFrame) -> DataFrame:
    """(have, role_id, req_pos, term_pos, term_id, route, weight): what a term had counts for. Blocked terms do not serve as
    narrower or adjacent evidence."""
    need = requirements.where("kind = 'skill'").select("role_id", "req_pos", "blocked", F.posexplode("term_ids").alias("term_pos", "term_id"))
    return need.join(route, "term_id").where((F.col("route") == 0) | ~F.array_contains("blocked", F.col("have"))).drop("blocked")


def term_routes(have: DataFrame, route: DataFrame, requirements: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Best route per (candidate_id, role_id, req_pos, term_id): v, via, field, phrase, term_pos; of these pairs
    (candidate_id, role_id) only, if given.

    A direct hit goes before any other; else the highest value, then the earliest evidence, then narrower before adjacent.
    """
    own, on = have.withColumnRenamed("term_id", "have"), ["have"]
    if pairs is not None:
        own, on = own.join(pairs.select("candidate_id", "role_id"), "candidate_id"), ["have", "role_id"]
    rows = own.join(reaches(route, requirements), on)
    value = F.when(F.col("route") == 2, X.py_round(F.col("v") * F.col("weight"), 3)).otherwise(F.col("v"))
    via = F.element_at(F.array(F.lit("direct"), F.lit("narrower"), F.lit("adjacent")), F.col("route") + 1)
    pick = F.struct((F.col("route") == 0).alias("direct"), value.alias("v"), (-F.col("have_ord")).alias("o"), (-F.col("route")).alias("r"), via.alias("via"), "field", "phrase")
    best = rows.groupBy("candidate_id", "role_id", "req_pos", "term_pos", "term_id").agg(F.max(pick).alias("b"))
    return best.where("b.v > 0").select("candidate_id", "role_id", "req_pos", "term_pos", "term_id", "b.v", "b.via", "b.field", "b.phrase")


def skill_scores(found: DataFrame) -> DataFrame:
    """Best term of each requirement that has any evidence: the highest value, the first on ties."""
    best = found.groupBy("candidate_id", "role_id", "req_pos").agg(F.max(F.struct("v", (-F.col("term_pos")).alias("p"), "via", "field", "phrase", "term_id")).alias("b"))
    return best.select("candidate_id", "role_id", "req_pos", F.col("b.v").alias("score"), "b.via", "b.field", "b.phrase")


def skill_values(have: DataFrame, route: DataFrame, requirements: DataFrame) -> DataFrame:
    """(candidate_id, role_id, req_pos, score): the scores of skill_scores(term_routes()), from have_values alone."""
    rows = have.withColumnRenamed("term_id", "have").join(small(reaches(route, requirements)), "have")
    value = F.when(F.col("route") == 2, X.py_round(F.col("_x"), 3)).otherwise(F.col("v"))
    rows = rows.withColumn("_x", F.col("v") * F.col("weight")).withColumn("value", value)
    each = rows.groupBy("candidate_id", "role_id", "req_pos", "term_pos").agg(F.max(F.when(F.col("route") == 0, F.col("value"))).alias("direct"), F.max("value").alias("any"))
    each = each.withColumn("v", F.coalesce("direct", "any")).where("v > 0")
    return each.groupBy("candidate_id", "role_id", "req_pos").agg(F.max("v").alias("score"))


def with_absent(scores: DataFrame, people: DataFrame, requirements: DataFrame) -> DataFrame:
    """A row for every person and skill requirement; those without evidence score 0, absent."""
    every = people.select("candidate_id").join(small(requirements.where("kind = 'skill'").select("role_id", "req_pos", "source", "tier", "verifiable")))
    out = every.join(scores, ["candidate_id", "role_id", "req_pos"], "left")
    return out.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("via", F.coalesce("via", F.lit("absent")))


def role_occupations(roles: DataFrame, surface: DataFrame) -> DataFrame:
    from .vocabulary import resolve_surface

    return resolve_surface(roles, "title", surface, "occupation").withColumnRenamed("term_id", "occupation_id")


def relevant_past(past: DataFrame, targets: DataFrame, near: DataFrame) -> DataFrame:
    """(candidate_id, role_id, pos, y) of past(candidate_id, pos, title, occupation_id, own_weight, duration_years): the
    years that a past role counts for a role, which are its own times its weight, times 1 for the target occupation or the
    weight of an adjacent one."""
    same = targets.where("occupation_id is not null").select("role_id", F.col("occupation_id").alias("src"), F.lit(1.0).alias("rel"))
    side = targets.join(near.where("pillar = 'occupation'"), F.col("occupation_id") == F.col("dst")).where("src <> occupation_id").select("role_id", "src", F.col("weight").alias("rel"))
    rel = same.union(side)
    own = past.where("occupation_id is not null")
    return own.join(rel, F.col("occupation_id") == F.col("src")).select("candidate_id", "role_id", "pos", (F.col("duration_years") * F.col("own_weight") * F.col("rel")).alias("y"))


def relevant_years(past: DataFrame, targets: DataFrame, near: DataFrame) -> DataFrame:
    """(candidate_id, role_id, years): the sum over past roles, in the order of positions."""
    rows = relevant_past(past, targets, near)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "y")))
    years = rows.groupBy("candidate_id", "role_id").agg(ordered.alias("l")).select("candidate_id", "role_id", X.py_round(F.aggregate("l", F.lit(0.0), lambda a, x: a + x["y"]), 2).alias("years"))
    return years


def experience_trace(past: DataFrame) -> DataFrame:
    """(candidate_id, trace): the mapped past roles with years and weights."""
    one = F.concat(F.col("title"), F.lit(" "), X.short_number(F.col("duration_years")), F.lit("y x"), F.format_string("%.2f", F.col("own_weight")))
    return past.where("occupation_id is not null").groupBy("candidate_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", one.alias("s")))), lambda x: x["s"]), "; ").alias("trace"))


def with_roles(people: DataFrame, roles: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """people beside every role, or beside the roles that pairs (candidate_id, role_id) name."""
    return people.join(small(roles)) if pairs is None else people.join(pairs.select("candidate_id", "role_id"), "candidate_id").join(roles, "role_id")


def experience_scores(people: DataFrame, requirements: DataFrame, years: DataFrame, trace: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(candidate_id, role_id, req_pos, score, stated_years, implied_years, conflict[, trace])."""
    need = requirements.where("kind = 'experience'").select("role_id", "req_pos", "exp_min", "exp_max")
    need._rows = getattr(requirements, "_rows", None)
    out = with_roles(people.select("candidate_id", "stated_years"), need, pairs).join(years, ["candidate_id", "role_id"], "left")
    out = out.withColumn("implied_years", F.coalesce("years", F.lit(0.0)))
    off = F.col("stated_years").isNull() | (~F.isnan("stated_years") & (F.abs(F.col("stated_years") - F.col("implied_years")) > 2))
    out = out.withColumn("conflict", off).withColumn("score", X.band_fit(F.col("implied_years"), F.col("exp_min"), F.col("exp_max")))
    cols = ["candidate_id", "role_id", "req_pos", "score", "stated_years", "implied_years", "conflict"]
    if trace is not None:
        return out.join(trace, "candidate_id", "left").select(*cols, F.coalesce("trace", F.lit("no relevant role")).alias("trace"))
    return out.select(*cols)


def location_scores(people: DataFrame, roles: DataFrame, country_of: dict[str, str] = COUNTRY_OF, pairs: DataFrame | None = None) -> DataFrame:
    """(candidate_id, role_id, availability_score, location_score)."""
    key = X.normalize_key(F.col("location"))
    want = roles.select("role_id", key.alias("want_key"), F.try_element_at(literal_map(country_of), key).alias("want_country"))
    out = with_roles(people.select("candidate_id", "city", "country", "notice_days"), want, pairs)
    return out.select("candidate_id", "role_id", X.availability(F.col("notice_days")).alias("availability_score"), F.coalesce(X.location_fit(F.col("want_key"), F.col("want_country"), F.col("city"), F.col("country")), F.lit(0.0)).alias("location_score"))


def match_scores(skills: DataFrame, experience: DataFrame, places: DataFrame, requirements: DataFrame, rubric: DataFrame) -> DataFrame:
    """(role_id, candidate_id, four components, availability_score, location_score, total).

    Means are over all requirements of a tier, so those without evidence need no row: a tier's size comes from the rubric.
    """
    tiers = requirements.groupBy("role_id").agg(F.count_if(F.col("tier") == "required").alias("n_req"), F.count_if(F.col("tier") == "preferred").alias("n_pref"))
    frame = rubric.join(tiers, "role_id")
    kinds = requirements.select("role_id", "req_pos", "tier")
    rows = skills.select("candidate_id", "role_id", "req_pos", "score").join(kinds.where("tier <> 'dropped'"), ["role_id", "req_pos"])
    exp = experience.select("candidate_id", "role_id", "req_pos", "score").join(kinds.where("tier <> 'dropped'"), ["role_id", "req_pos"])
    pair = ["candidate_id", "role_id"]
    each = lambda df, name: df.groupBy(*pair).agg(F.collect_list(F.struct("req_pos", "tier", "score")).alias(name))

    def mean(tier, n):
        total = F.aggregate(F.filter("s", lambda x: x["tier"] == tier), F.lit(0.0), lambda a, x: a + x["score"])
        return F.when(F.col(n) > 0, F.coalesce(total, F.lit(0.0)) / F.col(n)).otherwise(0.0)

    none = F.array().cast("array<struct<req_pos:int,tier:string,score:double>>")
    every = F.sort_array(F.concat(F.coalesce("_skills", none), F.coalesce("_years", none)))
    out = places.join(each(rows, "_skills"), pair, "left").join(each(exp, "_years"), pair, "left").withColumn("s", every).join(frame, "role_id")
    parts = {"required": mean("required", "n_req"), "preferred": mean("preferred", "n_pref"), "availability": F.col("availability_score"), "location": F.col("location_score")}
    for k, v in parts.items():
        out = out.withColumn(f"{k}_component", X.py_round(F.col(f"w_{k}") * v, 3))
    total = X.py_round(F.col("required_component") + F.col("preferred_component") + F.col("availability_component") + F.col("location_component"), 1)
    return out.withColumn("total", total).select("role_id", "candidate_id", *[f"{k}_component" for k in parts], "availability_score", "location_score", "total")
