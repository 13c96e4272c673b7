"""Cleaning of scanned tables: quarantine, full-row dedupe, typed parsing, conflict reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def split_blank_ids(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with an id, quarantine of the others with a reason)."""
    gone = F.coalesce(X.strip(F.col(id_col).cast("string")), F.lit("")) == ""
    return rows.where(~gone), rows.where(gone).withColumn("reason", F.lit(f"blank {id_col}"))


def _row_key(rows: DataFrame, skip: list[str]):
    same = [c for c in rows.columns if c not in skip]
    return F.sha2(F.to_json(F.struct(*same), {"ignoreNullFields": "false"}), 256)


def dedupe_full_row(rows: DataFrame, id_col: str, position: str) -> tuple[DataFrame, DataFrame]:
    """(first row by position of each group equal in all columns but id and position, groups: kept_id, dropped_ids).

    The survivor comes from a minimum, which is combined before the shuffle, so a hot group is no hot task.
    """
    keyed = rows.withColumn("_key", _row_key(rows, [id_col, position]))
    first = keyed.groupBy("_key").agg(F.min(F.struct(position, id_col)).alias("f"), F.count(F.lit(1)).alias("n"))
    marked = keyed.join(first, "_key")
    main = marked.where((F.col(position) == F.col(f"f.{position}")) & F.col(id_col).eqNullSafe(F.col(f"f.{id_col}"))).select(*rows.columns)
    gone = marked.where(f"n > 1 and {position} > f.{position}")
    groups = gone.groupBy("_key").agg(F.first(f"f.{id_col}").alias("kept_id"), F.sort_array(F.collect_list(F.struct(position, id_col))).alias("d"))
    return main, groups.select("kept_id", F.transform("d", lambda x: x[id_col]).alias("dropped_ids"))


def experience_conflicts(people: DataFrame, stated: str, durations: str) -> DataFrame:
    """people with implied_years and conflict: stated years missing, or over two off the sum of durations."""
    total = F.aggregate(F.coalesce(F.col(durations), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    implied = X.py_round(total, 2)
    off = F.col(stated).isNull() | (~F.isnan(stated) & (F.abs(F.col(stated) - implied) > 2))
    return people.withColumn("implied_years", implied).withColumn("conflict", off)


def first_seen(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values with the place where each is first seen."""
    return rows.groupBy(value).agg(F.min(F.struct(*order)).alias("first_at"))


def parse_candidates(raw: DataFrame, ref: str, strict: bool = True) -> DataFrame:
    """Typed candidates from rows of strings."""
    day = F.to_date(F.lit(ref))
    place = X.parse_location(F.col("location"))
    roles = X.past_roles(F.col("past_roles"), day, strict)
    return raw.withColumn("past_roles", roles).select(
        "candidate_id", "headline", F.col("skills").alias("skills_raw"), "projects", "extra_curriculars", "education", "certifications", "past_roles",
        X.stated_years(F.col("experience_years")).alias("stated_years"), place["city"].alias("city"), place["country"].alias("country"),
        F.col("notice_period").alias("notice_raw"), X.notice_days(F.col("notice_period"), day, strict).alias("notice_days"), *(["row_index"] if "row_index" in raw.columns else []),
    )


def parse_roles(raw: DataFrame) -> DataFrame:
    """Typed roles; an experience range that is no range fails."""
    span = r"^(\d+)\s*-\s*(\d+)\s*years?"
    good = X.strip(F.col("experience_range")).rlike(span)

    def bound(i):
        value = F.regexp_extract(X.strip(F.col("experience_range")), span, i).try_cast("int")
        return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit("experience range not understood: "), F.col("experience_range"))).cast("int"))

    return raw.select("role_id", "title", "department", X.split_list(F.col("required_skills")).alias("required"), X.split_list(F.col("nice_to_have_skills")).alias("nice"), bound(1).alias("exp_min"), bound(2).alias("exp_max"), "seniority", "location")


def load_candidates(raw: DataFrame, ref: str, strict: bool = True) -> dict[str, DataFrame]:
    """Main table and side tables of a load: candidates, quarantine, duplicates, conflicts."""
    good, quarantine = split_blank_ids(raw, "candidate_id")
    kept, groups = dedupe_full_row(good, "candidate_id", "row_index")
    people = parse_candidates(kept, ref, strict)
    durations = people.withColumn("_d", F.transform("past_roles", lambda r: r["duration_years"]))
    conflicts = experience_conflicts(durations, "stated_years", "_d").where("conflict").select("candidate_id", "stated_years", "implied_years")
    return {"candidates": people, "quarantine": quarantine, "duplicates": groups, "conflicts": conflicts}
