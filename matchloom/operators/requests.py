"""Requests to a text model and its replies, as tables.

A request is a row: its key, `system`, `user` and what the reply may hold. Who answers is up to the caller: `answered`
runs any function from requests to replies inside the tasks; every other function here is plain columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .linking import GROUPS, ground
from .rubric import WEIGHTS


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def answered(requests: DataFrame, key: list[str], answer: Callable[[str, str], str], concurrent: int = 8, attempts: int = 3) -> DataFrame:
    """key and `reply`: answer(system, user) for each request, null where all attempts fail. Calls run in the tasks, so many
    at a time in each; replies keep the order of their requests."""
    def one(request):
        for _ in range(attempts):
            try:
                return answer(*request)
            except Exception:  # a failed call leaves its request without a reply
                continue
        return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrent) as pool:
            for p in parts:
                yield p[key].assign(reply=list(pool.map(one, zip(p["system"], p["user"]))))

    rows = requests.select(*key, "system", "user")
    return rows.mapInPandas(run, rows.select(*key).withColumn("reply", F.lit(None).cast("string")).schema)


def vocabulary_block(terms: DataFrame, pillar: str = "skill") -> DataFrame:
    """One row, `block`: a line for each term of the pillar by id, with its surfaces and related phrases."""
    named = F.transform("related", lambda r: F.concat(r["phrase"], F.lit("("), r["weight"].cast("string"), F.lit(")")))
    line = F.concat_ws(" | ", "term_id", F.when(F.size("surfaces") > 0, F.concat(F.lit("surfaces: "), F.array_join("surfaces", ", "))), F.when(F.size("related") > 0, F.concat(F.lit("related: "), F.array_join(named, ", "))))
    lines = F.sort_array(F.collect_list(F.struct("term_id", line.alias("line"))))
    return terms.where(F.col("pillar") == pillar).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("block"))


def profile_lines(fields: DataFrame, id_col: str) -> DataFrame:
    """(id, group, lines): the non-blank fields of each group, in the group's order; a person without any has no row."""
    place = F.create_map(*[F.lit(x) for g in GROUPS.values() for i, f in enumerate(g) for x in (f, i)])
    group = F.create_map(*[F.lit(x) for g, fs in GROUPS.items() for f in fs for x in (f, g)])
    rows = fields.select(id_col, F.try_element_at(group, F.col("field")).alias("group"), F.struct(F.try_element_at(place, F.col("field")).alias("i"), F.concat("field", F.lit(": "), X.strip(F.col("text"))).alias("line")).alias("l"))
    rows = rows.where(F.col("group").isNotNull()).groupBy(id_col, "group").agg(F.sort_array(F.collect_list("l")).alias("l"))
    return rows.select(id_col, "group", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))


def extraction_requests(fields: DataFrame, id_col: str, terms: DataFrame, sections: dict[str, str]) -> DataFrame:
    """(id, group, system, user, terms, fields): one request for each person and field group that has any text."""
    block = vocabulary_block(terms).join(terms.where("pillar = 'skill'").agg(F.sort_array(F.collect_set("term_id")).alias("terms")))  # one row
    rows = profile_lines(fields, id_col).join(F.broadcast(block))
    user = filled(sections["user"], candidate_id=F.col(id_col).cast("string"), group_label=F.col("group"), profile_lines=F.col("lines"), vocabulary_block=F.col("block"))
    allowed = F.create_map(*[x for g, fs in GROUPS.items() for x in (F.lit(g), F.array(*map(F.lit, fs)))])
    return rows.select(id_col, "group", F.lit(sections.get("system", "")).alias("system"), user.alias("user"), "terms", allowed[F.col("group")].alias("fields"))


REPLY = "mentions array<struct<term:string,field:string,phrase:string,relation:string>>"


def linked_replies(replies: DataFrame, fields: DataFrame, id_col: str, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, rejected, results) of replies(id, group, reply), a JSON text or null.

    A null or unreadable reply is a failed group; the person's other groups stay, marked partial. A mention that its text
    does not bear out is rejected with a reason, and so is, with terms(term_id), one of another term or relation. results: id, partial, failed_groups, n_mentions, n_rejected.
    """
    read = replies.withColumn("r", F.from_json("reply", REPLY)).withColumn("failed", F.col("r.mentions").isNull())
    raw = read.where("not failed").select(id_col, "group", F.posexplode("r.mentions").alias("ord", "m")).select(id_col, "group", "ord", F.col("m.term").alias("term_id"), "m.field", "m.phrase", "m.relation")
    if terms is None:
        kept, rejected = ground(raw, fields, id_col)
    else:
        known = terms.select("term_id").distinct().withColumn("_known", F.lit(True))
        raw = raw.join(known, "term_id", "left").withColumn("reason", F.when(F.col("_known").isNull(), "unknown term").when(~F.coalesce(F.col("relation").isin("met", "adjacent"), F.lit(False)), "unknown relation")).drop("_known")
        kept, rejected = ground(raw.where("reason is null").drop("reason"), fields, id_col)
        rejected = rejected.unionByName(raw.where("reason is not null"))
    count = lambda df, name: df.groupBy(id_col).agg(F.count(F.lit(1)).alias(name))
    failed = F.sort_array(F.collect_set(F.when(F.col("failed"), F.col("group"))))
    out = read.groupBy(id_col).agg(failed.alias("failed_groups")).withColumn("partial", F.size("failed_groups") > 0)
    out = out.join(count(kept, "n_mentions"), id_col, "left").join(count(rejected, "n_rejected"), id_col, "left")
    return kept, rejected, out.fillna(0, ["n_mentions", "n_rejected"])


def drafting_requests(pillar: str, requirements: DataFrame, profiles: DataFrame, sections: dict[str, str]) -> DataFrame:
    """One request that drafts a pillar's terms from distinct strings: requirements(text), profiles(text)."""
    block = lambda df, name: df.select("text").distinct().agg(F.array_join(F.transform(F.sort_array(F.collect_list("text")), lambda x: F.concat(F.lit("- "), x)), "\n").alias(name))
    one = block(requirements, "a").join(block(profiles, "b"))  # one row each; the strings of a vocabulary
    return one.select(F.lit(pillar).alias("pillar"), F.lit(sections.get("system", "")).alias("system"), filled(sections["user"], pillar=F.lit(pillar), requirement_strings=F.col("a"), candidate_strings=F.col("b")).alias("user"))


def steering_requests(guidance: DataFrame, roles: DataFrame, requirements: DataFrame, sections: dict[str, str]) -> DataFrame:
    """guidance(role_id, text) to requests; `sources` are the only requirements that a reply may move."""
    skill = requirements.where("kind = 'skill'").groupBy("role_id").agg(F.sort_array(F.collect_list(F.struct("req_pos", "source", "tier"))).alias("r"))
    rows = guidance.join(roles.select("role_id", "title"), "role_id").join(skill, "role_id")
    lines = F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["source"], F.lit(" ("), x["tier"], F.lit(")"))), "\n")
    user = filled(sections["user"], role_title=F.col("title"), requirements=lines, guidance=F.col("text"))
    return rows.select("role_id", F.lit(sections.get("system", "")).alias("system"), user.alias("user"), F.transform("r", lambda x: x["source"]).alias("sources"))


def brief_requests(lines: DataFrame, gap: DataFrame, roles: DataFrame, sections: dict[str, str], n: int = 3) -> DataFrame:
    """One request a role for the briefs of its finalists: lines as selection.brief_lines gives them, gap with its places."""
    strong = F.coalesce(F.array_join(F.transform("strengths", lambda s: F.concat(F.lit("- "), s["source"], F.lit(": "), s["phrase"])), "\n"), F.lit(""))
    top = gap.where(F.col("place") <= n).groupBy("role_id", "candidate_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "kind", "detail"))), lambda g: F.concat(F.lit("- ["), g["kind"], F.lit("] "), g["detail"])), "\n").alias("gaps"))
    rows = lines.join(top, ["role_id", "candidate_id"], "left")
    part = F.concat_ws("\n", F.concat(F.lit("candidate "), F.col("candidate_id").cast("string")), strong, F.coalesce("gaps", F.lit("")))
    body = rows.groupBy("role_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("candidates"))
    body = body.join(roles.select("role_id", "title"), "role_id")
    return body.select("role_id", F.lit(sections.get("system", "")).alias("system"), filled(sections["user"], role_title=F.col("title"), candidates=F.col("candidates")).alias("user"))


def rubric_text(rubric: DataFrame, requirements: DataFrame) -> DataFrame:
    """(role_id, text): a role's weights and threshold, and a line for each requirement with its tier."""
    head = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), X.short_number(F.col(f"w_{k}"))) for k in WEIGHTS], F.concat(F.lit("threshold "), X.short_number(F.col("threshold"))))
    line = F.concat(F.lit("- "), F.col("source"), F.lit(" ["), F.col("tier"), F.lit("]"))
    each = requirements.groupBy("role_id").agg(F.sort_array(F.collect_list(F.struct("req_pos", line.alias("line")))).alias("l"))
    return rubric.join(each, "role_id", "left").select("role_id", F.concat_ws("\n", head, F.transform("l", lambda x: x["line"])).alias("text"))


def assessment_text(matched: DataFrame, scores: DataFrame, experience: DataFrame | None = None) -> DataFrame:
    """(role_id, candidate_id, text): a pair's total, a line for each requirement with its evidence and, with
    experience(role_id, candidate_id, implied_years, score), one for that; for questions about results."""
    found = F.concat(F.col("score").cast("string"), F.lit(" "), F.col("via"), F.lit(", "), F.coalesce("field", F.lit("")), F.lit(' "'), F.coalesce("phrase", F.lit("")), F.lit('"'))
    line = F.concat(F.lit("- "), F.col("source"), F.lit(" ["), F.col("tier"), F.lit("]: "), F.when(F.col("score") > 0, found).otherwise("none"))
    each = scores.groupBy("role_id", "candidate_id").agg(F.sort_array(F.collect_list(F.struct("req_pos", line.alias("line")))).alias("l"))
    head = F.concat(F.col("candidate_id").cast("string"), F.lit(" total="), F.col("total").cast("string"))
    key, years = ["role_id", "candidate_id"], F.lit(None).cast("string")
    out = matched.select(*key, "total").join(each, key, "left")
    if experience is not None:
        out = out.join(experience.select(*key, "implied_years", F.col("score").alias("_fit")), key, "left")
        years = F.concat(F.lit("- experience: "), F.col("implied_years").cast("string"), F.lit(" years, "), F.col("_fit").cast("string"))
    return out.select(*key, F.concat_ws("\n", head, F.transform("l", lambda x: x["line"]), years).alias("text"))


def answer_requests(questions: DataFrame, text: DataFrame, sections: dict[str, str]) -> DataFrame:
    """questions(role_id, question) with the texts of the role's results, few by choice of the caller."""
    body = text.groupBy("role_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("candidate_id", "text"))), lambda x: x["text"]), "\n\n").alias("results"))
    rows = questions.join(body, "role_id", "left")
    none = F.coalesce("results", F.lit("no results"))
    return rows.select("role_id", F.lit(sections.get("system", "")).alias("system"), filled(sections["user"], question=F.col("question"), results=none).alias("user"))
