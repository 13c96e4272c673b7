"""Entity linking without a model: field unpivot, phrase links, groundedness, occupations, consistency.

A model may stand in for link_fields(): requests.extraction_requests() asks it, requests.linked_replies() reads its replies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .phrases import phrases_within

# Which profile fields a linker reads together.
GROUPS = {"list": ("headline", "skills"), "prose": ("projects", "extra_curriculars", "education", "certifications")}


def unpivot_fields(people: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(id, field, text) of the non-blank fields; fields maps a field's name to its column."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(col).alias("text")) for name, col in fields.items()])
    return people.select(id_col, F.explode(pairs).alias("f")).select(id_col, "f.field", "f.text").where(~X.blank(F.col("text")))


def link_list_field(fields: DataFrame, id_col: str, surface: DataFrame) -> DataFrame:
    """Mentions of comma-list entries: a surface of equal key is met; else a related phrase, equal but for case, is adjacent."""
    item = fields.where("field = 'skills'").select(id_col, "field", F.posexplode(X.split_list(F.col("text"))).alias("pos", "phrase")).withColumn("key", X.normalize_key(F.col("phrase")))
    exact = surface.where("pillar = 'skill' and kind = 'surface'").groupBy("key").agg(F.min(F.struct("term_ord", "term_id")).alias("s"))
    near = surface.where("pillar = 'skill' and kind = 'related'").withColumn("low", F.lower(X.strip(F.col("phrase")))).groupBy("low").agg(F.min(F.struct("term_ord", "ord", "term_id")).alias("r"))
    out = item.join(exact, "key", "left").withColumn("low", F.lower("phrase")).join(near, "low", "left")
    return out.where("s is not null or r is not null").select(id_col, "field", "pos", "phrase", F.coalesce("s.term_id", "r.term_id").alias("term_id"), F.when(F.col("s").isNotNull(), "met").otherwise("adjacent").alias("relation"))


def link_prose(fields: DataFrame, id_col: str, surface: DataFrame, first: bool = False) -> DataFrame:
    """Adjacent mentions of related phrases inside prose, case ignored, within words too: all phrases in one pass. first:
    of equal phrases only the first in vocabulary order."""
    near = surface.where("pillar = 'skill' and kind = 'related'").select("term_ord", F.col("ord").alias("pos"), "term_id", "phrase")
    if first:
        near = near.groupBy(F.lower("phrase").alias("_low")).agg(F.min(F.struct(*near.columns)).alias("m")).select("m.*")
    near = near.withColumn("relation", F.lit("adjacent"))
    prose = fields.where(F.col("field").isin(*GROUPS["prose"])).select(id_col, "field", "text")
    return phrases_within(prose, "text", near).select(id_col, "field", "pos", "phrase", "term_id", "relation", "term_ord")


def link_fields(fields: DataFrame, id_col: str, surface: DataFrame) -> DataFrame:
    """Both kinds of mentions, one for each (id, field, phrase but for case): of a list its first entry, of prose the first
    term in vocabulary order that has the phrase."""
    listed = link_list_field(fields, id_col, surface).withColumn("at", F.struct("pos", F.lit(0).alias("o")))
    prose = link_prose(fields, id_col, surface, first=True).withColumn("at", F.struct(F.col("term_ord").alias("pos"), F.col("pos").alias("o"))).drop("term_ord")
    first = listed.unionByName(prose).groupBy(id_col, "field", F.lower("phrase").alias("_low")).agg(F.min(F.struct("at", "pos", "term_id", "phrase", "relation")).alias("m"))
    return first.select(id_col, "field", "m.pos", "m.term_id", "m.phrase", "m.relation")


def ground(mentions: DataFrame, fields: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(grounded mentions, rejected ones with a reason). mentions carry the group that they came from."""
    allowed = F.create_map(*[x for g, fs in GROUPS.items() for x in (F.lit(g), F.array(*map(F.lit, fs)))])
    out = mentions.join(fields.withColumnRenamed("text", "_text"), [id_col, "field"], "left")
    reason = (
        F.when(~F.coalesce(F.array_contains(allowed[F.col("group")], F.col("field")), F.lit(False)), "field not of this group")
        .when(F.coalesce("phrase", F.lit("")) == "", "empty phrase")
        .when(~F.coalesce(F.lower("_text").contains(F.lower("phrase")), F.lit(False)), "phrase not in the field")
    )
    out = out.withColumn("reason", reason).drop("_text")
    return out.where("reason is null").drop("reason"), out.where("reason is not null")


def golden_links(fields: DataFrame, id_col: str, surface: DataFrame) -> DataFrame:
    """(id, field, text, expected): what a linker must find, from the vocabulary alone.

    Every entry of a list with its term (by surface, else by related phrase, else null), and every related phrase that
    stands in a prose field; one row for each text of a field, case ignored.
    """
    item = fields.where("field = 'skills'").select(id_col, "field", F.posexplode(X.split_list(F.col("text"))).alias("pos", "text"))
    found = link_list_field(fields, id_col, surface).select(id_col, "field", "pos", "term_id")
    listed = item.join(found, [id_col, "field", "pos"], "left").select(id_col, "field", "text", F.struct("pos", F.lit(0).alias("o"), "text", "term_id").alias("c"))
    prose = link_prose(fields, id_col, surface).select(id_col, "field", F.col("phrase").alias("text"), F.struct(F.col("term_ord").alias("pos"), F.col("pos").alias("o"), F.col("phrase").alias("text"), "term_id").alias("c"))
    first = listed.unionByName(prose).groupBy(id_col, "field", F.lower("text").alias("low")).agg(F.min("c").alias("c"))
    return first.select(id_col, "field", F.col("c.text").alias("text"), F.col("c.term_id").alias("expected"))


def unlinked(golden: DataFrame, mentions: DataFrame, id_col: str) -> DataFrame:
    """Known texts whose term the person has no mention of at all."""
    have = mentions.select(id_col, F.col("term_id").alias("expected")).distinct()
    return golden.where("expected is not null").join(have, [id_col, "expected"], "left_anti")


def resolve_occupations(roles: DataFrame, title: str, surface: DataFrame) -> DataFrame:
    """roles with occupation_id and own_weight: a surface counts 1, else a related title its weight, else null and 0."""
    best = surface.where("pillar = 'occupation'").groupBy("key").agg(F.min(F.struct(F.when(F.col("kind") == "surface", 0).otherwise(1).alias("r"), "term_ord", "ord", "term_id", "weight")).alias("o"))
    out = roles.withColumn("key", X.normalize_key(F.col(title))).join(best, "key", "left")
    return out.withColumn("occupation_id", F.col("o.term_id")).withColumn("own_weight", F.coalesce("o.weight", F.lit(0.0))).drop("key", "o")


def duplicate_consistency(people: DataFrame, mentions: DataFrame, id_col: str, same: list[str], field: str = "skills") -> DataFrame:
    """One row: groups of people equal in `same` with two linked members or more, and those whose term sets differ."""
    linked = mentions.select(id_col).distinct()
    terms = mentions.where(F.col("field") == field).groupBy(id_col).agg(F.concat_ws(",", F.sort_array(F.collect_set("term_id"))).alias("terms"))
    each = people.join(linked, id_col, "left_semi").join(terms, id_col, "left").withColumn("terms", F.coalesce("terms", F.lit("")))
    groups = each.groupBy(*same).agg(F.count(F.lit(1)).alias("members"), F.min("terms").alias("lo"), F.max("terms").alias("hi")).where("members > 1")
    return groups.agg(F.count_if(F.col("lo") != F.col("hi")).alias("inconsistent"), F.count(F.lit(1)).alias("checked"))
