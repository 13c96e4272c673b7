"""Scans and sinks: candidate and role CSV, vocabulary and links as JSON or tables, prompts, settings."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..operators.vocabulary import checked_edges, checked_terms, surfaces, validation_errors
from .store import stored

CANDIDATE_COLUMNS = ("candidate_id", "headline", "skills", "experience_years", "past_roles", "certifications", "education", "projects", "extra_curriculars", "location", "notice_period")
ROLE_COLUMNS = ("role_id", "title", "department", "required_skills", "nice_to_have_skills", "experience_range", "seniority", "location")


def scan_csv(spark: SparkSession, path: str, columns: tuple[str, ...], position: str | None = None, many_lines: bool = True) -> DataFrame:
    """A CSV of strings with a fixed schema; empty cells are empty strings. position adds the row's place, from 0 and without
    gaps, in the order of file names and of rows in a file.

    many_lines: cells may hold line ends, so a file is read by one task. Without, large files are split.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=many_lines, escape='"', quote='"')
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in columns]
    if not position:
        return rows.select(*texts)
    return positioned(rows.select(*texts, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")), position).select(*columns, position)


def positioned(rows: DataFrame, position: str) -> DataFrame:
    """rows(_file, _block, ...) of a file scan with their place: first the rows of each split are counted, then a running sum
    over the splits, one row each, says where a split begins. Within a split a task reads in order."""
    once = stored(rows.withColumn("_at", F.monotonically_increasing_id()))
    split = once.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    begin = split.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return once.join(begin, ["_file", "_block"]).withColumn(position, F.col("_before") + F.col("_at") - F.col("_first")).drop("_file", "_block", "_at", "_first", "_before")


def scan_candidates(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, CANDIDATE_COLUMNS, "row_index")


def scan_roles(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, ROLE_COLUMNS)


TERM = "id string, pillar string, label string, surfaces array<string>, related map<string,double>, from_requirements array<string>"
EDGE = "pillar string, src string, dst string, kind string, weight double"


def read_vocabulary(spark: SparkSession, path: str) -> tuple[str, DataFrame, DataFrame]:
    """(version, terms, edges) of one JSON document."""
    doc = spark.read.schema(f"version string, terms array<struct<{_colons(TERM)}>>, edges array<struct<{_colons(EDGE)}>>").json(path, multiLine=True)
    version = doc.first()["version"]
    terms = doc.select(F.posexplode("terms").alias("ord", "t")).select("t.pillar", F.col("t.id").alias("term_id"), "ord", "t.label", "t.surfaces", F.transform(F.map_entries("t.related"), lambda e: F.struct(e["key"].alias("phrase"), e["value"].alias("weight"))).alias("related"), "t.from_requirements")
    edges = doc.select(F.posexplode("edges").alias("ord", "e")).select("e.*", "ord")
    return version, checked_terms(terms), checked_edges(edges)


def _colons(schema: str) -> str:
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", schema)


def write_vocabulary(version: str, terms: DataFrame, edges: DataFrame, path: str) -> None:
    """The same document again; a vocabulary is small."""
    t = [{"id": r["term_id"], "pillar": r["pillar"], "label": r["label"], "surfaces": list(r["surfaces"]), "related": {x["phrase"]: x["weight"] for x in r["related"]}, "from_requirements": list(r["from_requirements"])} for r in terms.orderBy("ord").collect()]
    e = [{k: r[k] for k in ("pillar", "src", "dst", "kind", "weight")} for r in edges.orderBy("ord").collect()]
    Path(path).write_text(json.dumps({"version": version, "terms": t, "edges": e}, indent=2, ensure_ascii=False) + "\n")


def _checked_tables(terms: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """term, surface with keys, edge with adjacency both ways. A vocabulary with errors is refused."""
    wrong = validation_errors(terms, edges).limit(5).collect()
    if wrong:
        raise ValueError(f"the vocabulary has errors: {[tuple(r) for r in wrong]}")
    back = edges.where("kind = 'adjacent'").select("pillar", F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "weight", "ord")
    both = edges.select("pillar", "src", "dst", "kind", "weight", "ord").union(back)
    return {"term": terms.select("pillar", "term_id", "ord", "label"), "surface": surfaces(terms), "edge": both}


def _loaded(surface: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surfaces, edges) of a stored vocabulary: a related phrase of weight 1 is a surface, an adjacent pair is one sorted row."""
    near = edge.where("kind = 'adjacent'").groupBy("pillar", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind").agg(F.min_by("weight", "ord").alias("weight"), F.min("ord").alias("ord"))
    surface = surface.withColumn("kind", F.when(F.col("weight") == 1.0, "surface").otherwise("related"))
    return surface, edge.where("kind = 'narrower'").select("pillar", "src", "dst", "kind", "weight", "ord").union(near.select("pillar", F.col("a").alias("src"), F.col("b").alias("dst"), "kind", "weight", "ord"))


def store_vocabulary(terms: DataFrame, edges: DataFrame, path: str) -> None:
    """The vocabulary as Parquet folders by pillar."""
    for name, df in _checked_tables(terms, edges).items():
        df.write.mode("overwrite").partitionBy("pillar").parquet(f"{path}/{name}")


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _loaded(spark.read.parquet(f"{path}/surface"), spark.read.parquet(f"{path}/edge"))


BUCKETED_BY = {"term": "term_id", "surface": "key", "edge": "src"}


def store_vocabulary_tables(terms: DataFrame, edges: DataFrame, prefix: str, path: str, buckets: int = 64) -> None:
    """The vocabulary as tables of the catalog, prefix_term and so on, bucketed and sorted by what they are joined on: a join
    on it shuffles the other side alone."""
    for name, df in _checked_tables(terms, edges).items():
        key = BUCKETED_BY[name]
        # By bucket, so that each task writes whole buckets and not a file of each.
        df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", f"{path}/{name}").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{prefix}_{name}")


def load_vocabulary_tables(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    return _loaded(spark.table(f"{prefix}_surface"), spark.table(f"{prefix}_edge"))


LINKS = "candidate_id string, partial boolean, failed_groups array<string>, mentions array<struct<term:string,field:string,phrase:string,relation:string>>, rejected array<struct<group:string,reason:string,raw:map<string,string>>>"


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Linked candidates; a file without rejected mentions is fine."""
    return spark.read.schema(LINKS).json(path, multiLine=True).withColumn("rejected", F.coalesce("rejected", F.array().cast("array<struct<group:string,reason:string,raw:map<string,string>>>")))


def mentions_of(links: DataFrame) -> DataFrame:
    return links.select("candidate_id", F.posexplode("mentions").alias("ord", "m")).select("candidate_id", "ord", F.col("m.term").alias("term_id"), "m.field", "m.phrase", "m.relation")


def write_links(links: DataFrame, path: str) -> None:
    links.withColumn("partial", F.size("failed_groups") > 0).write.mode("overwrite").json(path)


# Fixed values in the next two functions: the headings and the fence of a prompt file.
def prompt_sections(text: str) -> dict[str, str]:
    """The parts of a prompt file by their second-level headings, in lower case."""
    parts = re.split(r"^##\s+(System|User|Schema)\s*$", text, flags=re.M)
    return {name.lower(): body.strip() for name, body in zip(parts[1::2], parts[2::2])}


def fenced_json(text: str) -> dict:
    m = re.search(r"```json\s*\n(.*?)```", text, re.S)
    if not m:
        raise ValueError("no fenced JSON")
    return json.loads(m[1])


def read_settings(path: str, env: dict[str, str], required: tuple[str, ...] = ("REFERENCE_DATE",)) -> dict[str, str]:
    """KEY=value lines; the environment's value goes first for keys that the file has."""
    got = {}
    for line in Path(path).read_text().splitlines():
        key, eq, value = line.partition("=")
        if eq and not line.lstrip().startswith("#"):
            got[key.strip()] = env.get(key.strip(), value.strip().strip("\"'"))
    missing = [k for k in required if not got.get(k)]
    if missing:
        raise ValueError(f"settings missing: {missing}")
    return got
