"""The driver's tables seen as people, evidence, roles and a vocabulary, and the same views as SQL for comparison.

Customers are people, their parts' brands are evidence, their orders are past roles; ten roles and a vocabulary of brands
are literals made by rule.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..sources.store import pinned, small

REF = "2002-01-01"
FIELD_OF = {"1-URGENT": "skills", "2-HIGH": "projects", "3-MEDIUM": "headline", "4-NOT SPECIFIED": "certifications", "5-LOW": "extra_curriculars"}
REGIONS = ("africa", "america", "asia", "europe", "middle-east")
COUNTRY_OF = {f"nation-{k}": REGIONS[k % 5] for k in range(25)}
TITLES = ("1-URGENT", "2-HIGH", "5-LOW")
#: What lines of an order are placed by; lines that are equal in all of it are the same evidence.
PLACED = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]

BRANDS = [f"Brand#{k}" for k in range(1, 26)]
TERMS = [("skill", b, i, b, [b], [("red widget", 0.7), ("hot gear", 0.5)] if i % 5 == 4 else [], [b] + ([f"Brand#{i + 1} or near"] if i % 6 == 5 else []) + ([f"Brand#{i} or near"] if i % 6 == 0 and i else [])) for i, b in enumerate(BRANDS)]
TERMS += [
    ("occupation", "URGENT_DESK", 25, "Urgent", ["1-URGENT"], [], []),
    ("occupation", "HIGH_DESK", 26, "High", ["2-HIGH"], [("3-MEDIUM", 0.7)], []),
    ("occupation", "LOW_DESK", 27, "Low", ["5-LOW"], [], []),
]
EDGES = [("skill", "Brand#2", "Brand#1", "narrower", 1.0), ("skill", "Brand#3", "Brand#2", "narrower", 1.0), ("skill", "Brand#12", "Brand#11", "narrower", 1.0), ("skill", "Brand#25", "Brand#12", "narrower", 1.0)]
EDGES += [("skill", f"Brand#{k}", f"Brand#{k + 13}", "adjacent", 0.6) for k in range(1, 11)] + [("skill", "Brand#9", "Brand#4", "adjacent", 0.5), ("occupation", "HIGH_DESK", "URGENT_DESK", "adjacent", 0.6)]
EDGES = [(*e, i) for i, e in enumerate(EDGES)]
ROLES = [
    (f"R{k:03d}", TITLES[k % 3], [f"Brand#{k}", f"Brand#{k + 7}", f"Brand#{6 + 6 * (k % 3)} or near"] + (["Problem Solving"] if k % 2 else ["no such thing"]), [f"Brand#{k + 3}", "teamwork"], 1 + k % 3, 3 + k % 4, f"NATION_{2 * k}")
    for k in range(1, 11)
]
RETIER = [("R001", "Brand#1", "preferred", 0), ("R001", "Brand#8", "dropped", 1), ("R001", "Brand#1", "dropped", 2), ("R002", "Brand#9", "preferred", 3)]
STEERED = {"required": 60.0, "preferred": 20.0, "availability": 15.0, "location": 5.0}


def literal(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Rows as a local relation, whose size the planner knows."""
    kind = T._parse_datatype_string(schema)
    table = pa.Table.from_pylist([dict(zip(kind.names, map(_plain, r))) for r in rows], schema=to_arrow_schema(kind))
    return spark.createDataFrame(table, kind)


def _plain(v):
    """Pairs of a phrase and a weight as Arrow wants them."""
    return [{"phrase": x[0], "weight": x[1]} for x in v] if isinstance(v, list) and v and isinstance(v[0], tuple) else v


def terms(spark: SparkSession) -> DataFrame:
    return literal(spark, TERMS, "pillar string, term_id string, ord int, label string, surfaces array<string>, related array<struct<phrase:string,weight:double>>, from_requirements array<string>")


def edges(spark: SparkSession) -> DataFrame:
    return literal(spark, EDGES, "pillar string, src string, dst string, kind string, weight double, ord int")


def roles(spark: SparkSession) -> DataFrame:
    return literal(spark, ROLES, "role_id string, title string, required array<string>, nice array<string>, exp_min int, exp_max int, location string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    c = table(spark, sf_dir, "customer").join(last, "c_custkey", "left")
    c = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    days = F.datediff(F.to_date(F.lit(REF)), F.to_date("last")) % 90
    k = F.col("c_custkey")
    return c.select(
        k.alias("candidate_id"), F.col("c_mktsegment").alias("headline"), F.col("n_name").alias("city"), F.col("r_name").alias("country"), F.when(days % 7 != 0, days).alias("notice_days"),
        F.when(k % 11 != 0, (k % 15).cast("double")).alias("stated_years"), F.when(days % 7 != 0, F.concat(days.cast("string"), F.lit(" days"))).alias("notice_raw"),
        F.when(k % 4 == 0, "-").otherwise(F.col("c_name")).alias("projects"), F.when(k % 5 != 0, F.col("c_name")).alias("education"), F.col("c_name").alias("certifications"), F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("extra_curriculars"),
    )


PEOPLE_SQL = f"""people AS (
  SELECT c_custkey AS candidate_id, c_mktsegment AS headline, n_name AS city, r_name AS country,
         CASE WHEN days % 7 <> 0 THEN days END AS notice_days,
         CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 15 AS DOUBLE) END AS stated_years,
         CASE WHEN days % 7 <> 0 THEN days || ' days' END AS notice_raw,
         CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE c_name END AS projects, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS education,
         c_name AS certifications, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS extra_curriculars
  FROM customer LEFT JOIN (SELECT o_custkey, CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{REF}') AS INTEGER) % 90 AS days FROM orders GROUP BY 1) ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def mentions(spark: SparkSession, sf_dir: str, who: DataFrame | None = None) -> DataFrame:
    """The evidence of all people or, with who(candidate_id), of a few: then only their orders' lines are moved. Keys are
    made for parts, not for lines."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    if who is not None:
        orders = small(pinned(orders.join(small(who.select(F.col("candidate_id").alias("o_custkey"))), "o_custkey", "left_semi")))
        line = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    # Lines are placed within their order first, so that what they are sorted by is not moved to their person.
    line = line.select("l_orderkey", "l_partkey", "l_returnflag", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*PLACED)).alias("l_at"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", X.normalize_key(F.col("p_name")).alias("key")), F.col("l_partkey") == F.col("p_partkey"))
    field = F.create_map(*[F.lit(x) for kv in FIELD_OF.items() for x in kv])[F.col("o_orderpriority")]
    w = W.partitionBy("o_custkey").orderBy("l_orderkey", "l_at")  # a person's own lines
    return rows.select(F.col("o_custkey").alias("candidate_id"), F.col("p_brand").alias("term_id"), field.alias("field"), F.col("p_name").alias("phrase"), F.when(F.col("l_returnflag") == "A", "adjacent").otherwise("met").alias("relation"), F.row_number().over(w).alias("ord"), "key")


MENTIONS_SQL = """mentions AS (
  SELECT o_custkey AS candidate_id, p_brand AS term_id, p_name AS phrase, CASE WHEN l_returnflag = 'A' THEN 'adjacent' ELSE 'met' END AS relation,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'skills' WHEN '2-HIGH' THEN 'projects' WHEN '3-MEDIUM' THEN 'headline' WHEN '4-NOT SPECIFIED' THEN 'certifications' ELSE 'extra_curriculars' END AS field,
         row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def past_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = F.datediff(F.to_date(F.lit(REF)), F.to_date("o_orderdate"))
    return o.select(F.col("o_custkey").alias("candidate_id"), F.row_number().over(w).alias("pos"), F.col("o_orderpriority").alias("title"), X.py_round(days / F.lit(3652.5), 2).alias("duration_years"), F.year("o_orderdate").alias("start_year"))


def quoted(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(quoted(x) for x in v) + "]"
    return f"{v!r}e0" if isinstance(v, float) else str(v)


def values(name: str, cols: str, rows) -> str:
    return f"{name}({cols}) AS (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def sround(x: str, d: int) -> str:
    """The rounding of py_round as SQL; x is a non-negative column."""
    m, hi = f"1e{d}", f"({x} * 134217729e0 - ({x} * 134217729e0 - {x}))"
    p = f"({x} * {m})"
    err, fr = f"(({hi} * {m} - {p}) + ({x} - {hi}) * {m})", f"({p} - floor({p}))"
    up = f"({fr} > 5e-1 OR ({fr} = 5e-1 AND ({err} > 0 OR ({err} = 0 AND CAST(floor({p}) AS BIGINT) % 2 <> 0))))"
    return f"((floor({p}) + CASE WHEN {up} THEN 1e0 ELSE 0e0 END) / {m})"


def skey(x: str) -> str:
    """normalize_key as SQL."""
    s = f"lower(trim({x}))"
    for a, b in X.SPELLED:
        s = f"replace({s}, '{a}', ' {b} ')"
    return f"regexp_replace(regexp_replace({s}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


TERMS_SQL = values("terms", "pillar, term_id, ord, surface", [(p, t, o, s[0]) for p, t, o, _, s, _, _ in TERMS])
RELATED_SQL = values("related", "pillar, term_id, ord, phrase, weight, rord", [(p, t, o, x, w, i) for p, t, o, _, _, r, _ in TERMS for i, (x, w) in enumerate(r)])
CLAIMS_SQL = values("claims", "pillar, term_id, source", [(p, t, f) for p, t, _, _, _, _, fs in TERMS for f in fs])
EDGES_SQL = values("edges", "pillar, src, dst, kind, weight, ord", EDGES)
ROLES_SQL = values("roles", "role_id, title, required, nice, exp_min, exp_max, location", ROLES)
PAST_SQL = f"""past0 AS (
  SELECT o_custkey AS candidate_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderpriority AS title,
         date_diff('day', CAST(o_orderdate AS DATE), DATE '{REF}') / 3652.5e0 AS d, year(o_orderdate) AS start_year FROM orders),
past AS (SELECT candidate_id, pos, title, {sround("d", 2)} AS duration_years, start_year FROM past0)"""
