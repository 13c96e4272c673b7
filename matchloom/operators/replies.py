"""Replies of a text model: kept by request, and read into tables.

A reply is a JSON text. Readers return what they took and what they refused with a reason; nothing is taken from a reply
that cannot be read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import forget, stored
from .requests import answered
from .rubric import TIERS, WEIGHTS
from .selection import padded_questions, top_gaps

REPLIES = "request string, reply string"


class ReplyTable:
    """Replies by a hash of their request, so that a request is answered once however often and by whomever it is asked.

    What is missing is worked out once and asked for in tasks that write their replies as each ends. All tasks that run at a
    time hold about `wave` requests: a run that is killed loses one wave, and the next run asks only for the rest. A request
    that fails is not written; it is asked again next time.
    """

    def __init__(self, spark: SparkSession, folder: str, wave: int = 10_000):
        self.spark, self.folder, self.wave = spark, folder, wave
        spark.createDataFrame([], REPLIES).write.mode("ignore").parquet(folder)

    def held(self) -> DataFrame:
        return self.spark.read.schema(REPLIES).parquet(self.folder).groupBy("request").agg(F.min("reply").alias("reply"))

    def addressed(self, requests: DataFrame) -> DataFrame:
        return requests.withColumn("request", F.sha2(F.to_json(F.struct("system", "user"), {"ignoreNullFields": "false"}), 256))

    def ask(self, requests: DataFrame, answer: Callable[[str, str], str], concurrent: int = 8, attempts: int = 3) -> DataFrame:
        """requests with `reply`, null where all attempts failed. Equal requests are one question."""
        rows = self.addressed(requests)
        missing = stored(rows.select("request", "system", "user").dropDuplicates(["request"]).join(self.held(), "request", "left_anti"))
        try:
            each = max(1, self.wave // self.spark.sparkContext.defaultParallelism)
            own = missing.repartition(max(1, -(-missing.count() // each)), "request")
            # Version 2: a task's file is in its place when the task ends, whatever becomes of the others.
            answered(own, ["request"], answer, concurrent, attempts).where("reply is not null").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(self.folder)
        finally:
            forget(missing)
        return rows.join(self.held(), "request", "left").drop("request")


STEERING = "weights map<string,double>, threshold double, retier array<struct<requirement_source:string,new_tier:string>>, unsupported array<struct<guidance:string,reason:string>>, diff_en string"


def steering_replies(replies: DataFrame, requirements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(retier, settings, unsupported, rejected) of replies(role_id, reply).

    retier(role_id, source, tier, ord) and settings(role_id, w_..., threshold, diff) are what rubric.steered() takes;
    unsupported(role_id, guidance, reason) is what the model would not do; rejected(role_id, what, reason) what the reply
    asks for and cannot have: other tiers, requirements that the role does not have, weights that do not sum to 100, which
    refuse the whole reply, as does one that cannot be read.
    """
    read = replies.select("role_id", F.from_json("reply", STEERING).alias("r"))
    names = list(WEIGHTS)
    total = sum((F.coalesce(F.try_element_at("r.weights", F.lit(n)), F.lit(float("nan"))) for n in names), F.lit(0.0))
    why = F.when(F.col("r.weights").isNull() | F.col("r.threshold").isNull(), "unreadable").when(F.isnan(total) | (F.size(F.map_keys("r.weights")) != len(names)), "not the four weights").when(F.abs(total - 100) > 1e-6, "weights do not sum to 100")
    read = read.withColumn("why", why)
    fine = read.where("why is null")
    settings = fine.select("role_id", *[F.col("r.weights")[n].alias(f"w_{n}") for n in names], "r.threshold", F.col("r.diff_en").alias("diff"))
    has = requirements.select("role_id", "source").distinct().withColumn("has", F.lit(True))
    moves = fine.select("role_id", F.posexplode("r.retier").alias("ord", "m")).select("role_id", F.col("m.requirement_source").alias("source"), F.col("m.new_tier").alias("tier"), "ord").join(has, ["role_id", "source"], "left")
    moves = moves.withColumn("why", F.when(F.col("has").isNull(), "no such requirement").when(~F.coalesce(F.col("tier").isin(*TIERS), F.lit(False)), "unknown tier"))
    rejected = read.where("why is not null").select("role_id", F.lit("reply").alias("what"), F.col("why").alias("reason")).union(moves.where("why is not null").select("role_id", F.coalesce("source", F.lit("")), "why"))
    unsupported = fine.select("role_id", F.inline("r.unsupported"))
    return moves.where("why is null").select("role_id", "source", "tier", "ord"), settings, unsupported, rejected


DRAFT = (
    "terms array<struct<id:string,canonical:string,aliases:array<string>,narrower:array<string>,adjacent:array<struct<term:string,weight:double>>,related:array<struct<phrase:string,weight:double>>,from_requirements:array<string>>>, "
    "unmapped array<struct<string:string,reason:string>>"
)


def draft_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(draft, unmapped, rejected) of replies(pillar, reply): drafted terms as vocabulary.from_draft() takes them, with their
    pillar; strings that the draft left over; terms without an id or a name, of an id drafted before, or with a weight
    outside 0 to 1."""
    read = replies.select("pillar", F.from_json("reply", DRAFT).alias("r"))
    none = F.array().cast("array<string>")
    each = read.select("pillar", F.posexplode("r.terms").alias("ord", "t")).select("pillar", "ord", "t.*")
    first = each.groupBy("pillar", "id").agg(F.min("ord").alias("first"))
    each = each.join(first, ["pillar", "id"], "left")
    off = lambda c: F.coalesce(F.exists(c, lambda x: ~F.coalesce(x["weight"].between(0, 1), F.lit(False))), F.lit(False))
    named = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    why = F.when(~named("id") | ~named("canonical"), "no id or name").when(F.col("first") < F.col("ord"), "id drafted before").when(off(F.col("adjacent")) | off(F.col("related")), "weight outside 0 to 1")
    each = each.withColumn("why", why)
    lists = [F.coalesce(c, none).alias(c) for c in ("aliases", "narrower")]
    draft = each.where("why is null").select("pillar", "ord", "id", "canonical", *lists, F.coalesce("adjacent", F.array().cast("array<struct<term:string,weight:double>>")).alias("adjacent"), F.coalesce("related", F.array().cast("array<struct<phrase:string,weight:double>>")).alias("related"), F.coalesce("from_requirements", none).alias("from_requirements"))
    unread = read.where("r.terms is null").select("pillar", F.lit(None).cast("string").alias("id"), F.lit("unreadable").alias("reason"))
    return draft, read.select("pillar", F.inline("r.unmapped")), each.where("why is not null").select("pillar", "id", F.col("why").alias("reason")).union(unread)


BRIEFS = "briefs array<struct<candidate_id:string,summary:string,differentiator:string,questions:array<string>>>"


def brief_replies(replies: DataFrame, finalists: DataFrame, gap: DataFrame, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(texts as selection.brief_lines() takes them, rejected) of replies(role_id, reply).

    As many questions as the finalist has top gaps: more are cut, a missing one is the gap's own text. A person who is no
    finalist of the role, or is told of twice, is rejected, and so is a reply that cannot be read.
    """
    key = ["role_id", "candidate_id"]
    read = replies.select("role_id", F.from_json("reply", BRIEFS).alias("r"))
    each = read.select("role_id", F.posexplode("r.briefs").alias("ord", "b")).select("role_id", "ord", F.col("b.candidate_id").alias("said"), "b.summary", "b.differentiator", "b.questions")
    ids = finalists.select("role_id", "candidate_id", F.col("candidate_id").cast("string").alias("said")).distinct()
    each = each.join(each.groupBy("role_id", "said").agg(F.min("ord").alias("first")), ["role_id", "said"], "left").join(ids, ["role_id", "said"], "left")
    each = each.withColumn("why", F.when(F.col("candidate_id").isNull(), "no finalist").when(F.col("first") < F.col("ord"), "told of before"))
    details = top_gaps(gap, n).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "detail"))), lambda x: x["detail"]).alias("details"))
    none = F.array().cast("array<string>")
    texts = each.where("why is null").join(details, key, "left").select(*key, F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("differentiator", F.lit("")).alias("differentiator"), padded_questions(F.coalesce("questions", none), F.coalesce("details", none)).alias("questions"))
    unread = read.where("r.briefs is null").select("role_id", F.lit(None).cast("string").alias("said"), F.lit("unreadable").alias("reason"))
    return texts, each.where("why is not null").select("role_id", "said", F.col("why").alias("reason")).union(unread)
