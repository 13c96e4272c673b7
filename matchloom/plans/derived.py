"""A vocabulary, its graph and roles that grow with the driver's tables, and the same as SQL.

Parts and suppliers are terms; a part is narrower than the first supplier that delivers it, a supplier than the one of half
its number; parts of neighbouring numbers are adjacent. Suppliers are roles, which ask for the brands that they deliver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .analogue import table

NONE = "array<string>"
TERM_COLS = ["pillar", "term_id", "ord", "label", "surfaces", "related", "from_requirements"]
EDGE_COLS = ["pillar", "src", "dst", "kind", "weight", "ord"]


def _id(letter: str, key) -> Column:
    return F.concat(F.lit(letter), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _term(rows: DataFrame, letter: str, key: str, label: str, surfaces: Column, claims: Column, base: int) -> DataFrame:
    related = F.array().cast("array<struct<phrase:string,weight:double>>")
    return rows.select(F.lit("skill").alias("pillar"), _id(letter, key).alias("term_id"), (F.col(key) + base).cast("int").alias("ord"), F.col(label).alias("label"), surfaces.alias("surfaces"), related.alias("related"), claims.alias("from_requirements"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts (every tenth size has no surface; the smaller half by size claim their names), suppliers and nations."""
    none = F.array().cast(NONE)
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    own = F.when(size % 10 != 0, F.array(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")))).otherwise(none)
    parts = _term(part, "P", "p_partkey", "p_name", own, F.when(size <= 25, F.array("p_name", "p_type")).otherwise(none), 0)
    suppliers = _term(table(spark, sf_dir, "supplier"), "S", "s_suppkey", "s_name", F.array("s_name"), none, 500_000_000)
    nations = _term(table(spark, sf_dir, "nation"), "N", "n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 1, F.array("n_name")).otherwise(none), none, 1_000_000_000)
    return parts.union(suppliers).union(nations)


TERMS_SQL = """terms AS (SELECT 'P' || p_partkey AS term_id, p_partkey AS ord, CASE WHEN p_size % 10 <> 0 THEN [p_name || ' ' || p_partkey] ELSE [] END AS surfaces, CASE WHEN p_size <= 25 THEN [p_name, p_type] ELSE [] END AS claims FROM part
  UNION ALL SELECT 'S' || s_suppkey, s_suppkey + 500000000, [s_name], [] FROM supplier UNION ALL SELECT 'N' || n_nationkey, n_nationkey + 1000000000, CASE WHEN n_nationkey % 2 = 1 THEN [n_name] ELSE [] END, [] FROM nation)"""


def edges(spark: SparkSession, sf_dir: str, faulty: bool = False) -> DataFrame:
    """faulty: with edges to no term, edges of terms to themselves, and narrower edges that close circles."""
    part, line, sup = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    k, s = F.col("p_partkey"), F.col("s_suppkey")

    def edge(rows, src, dst, kind, weight, order):
        return rows.select(F.lit("skill").alias("pillar"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), weight.cast("double").alias("weight"), order.cast("long").alias("ord"))

    one = F.lit(1.0)
    first = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s"))
    out = edge(first, _id("P", k), _id("S", "s"), "narrower", one, k)
    out = out.union(edge(sup.where("s_suppkey > 0"), _id("S", s), _id("S", F.floor(s / 2)), "narrower", one, s))
    out = out.union(edge(part, _id("P", k), _id("P", k + 1), "adjacent", F.col("p_size") / F.lit(50.0), 2 * k))
    out = out.union(edge(part, _id("P", k), _id("P", k - 1), "adjacent", (F.lit(51) - F.col("p_size")) / F.lit(50.0), 2 * k + 1))
    if faulty:
        out = out.union(edge(part.where("p_size = 1"), _id("P", k), _id("X", k), "adjacent", one, k)).union(edge(part.where("p_size = 2"), _id("P", k), _id("P", k), "adjacent", one, k))
        out = out.union(edge(sup.where("s_suppkey % 10 = 7"), _id("S", F.floor(s / 4)), _id("S", s), "narrower", one, s))
    return out


EDGES_SQL = """edges AS (SELECT 'skill' AS pillar, 'P' || l_partkey AS src, 'S' || min(l_suppkey) AS dst, 'narrower' AS kind, 1e0 AS weight, l_partkey AS ord FROM lineitem GROUP BY l_partkey
  UNION ALL SELECT 'skill', 'S' || s_suppkey, 'S' || (s_suppkey // 2), 'narrower', 1e0, s_suppkey FROM supplier WHERE s_suppkey > 0
  UNION ALL SELECT 'skill', 'P' || p_partkey, 'P' || (p_partkey + 1), 'adjacent', p_size / 50e0, 2 * p_partkey FROM part UNION ALL SELECT 'skill', 'P' || p_partkey, 'P' || (p_partkey - 1), 'adjacent', (51 - p_size) / 50e0, 2 * p_partkey + 1 FROM part)"""
FAULTY_SQL = EDGES_SQL[:-1] + """
  UNION ALL SELECT 'skill', 'P' || p_partkey, 'X' || p_partkey, 'adjacent', 1e0, p_partkey FROM part WHERE p_size = 1 UNION ALL SELECT 'skill', 'P' || p_partkey, 'P' || p_partkey, 'adjacent', 1e0, p_partkey FROM part WHERE p_size = 2
  UNION ALL SELECT 'skill', 'S' || (s_suppkey // 4), 'S' || s_suppkey, 'narrower', 1e0, s_suppkey FROM supplier WHERE s_suppkey % 10 = 7)"""


def brand_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term for each brand of the parts, with its first three names by part as related phrases; every third brand and the
    next one claim a requirement together."""
    k = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    brand = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.slice(F.array_sort(F.collect_set("p_name")), 1, 3).alias("names"))
    both = F.concat(F.lit("Brand#"), (k - k % 3).cast("string"), F.lit(" or next"))
    claims = F.when(k % 3 < 2, F.array("p_brand", both)).otherwise(F.array("p_brand"))
    related = F.transform("names", lambda n, i: F.struct(n.alias("phrase"), (F.lit(0.7) - i * F.lit(0.125)).alias("weight")))
    return brand.select(F.lit("skill").alias("pillar"), F.col("p_brand").alias("term_id"), k.alias("ord"), F.col("p_brand").alias("label"), F.array("p_brand").alias("surfaces"), related.alias("related"), claims.alias("from_requirements"))


BRANDS_SQL = """brands AS (SELECT p_brand AS term_id, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS ord, list_sort(list(DISTINCT p_name))[1:3] AS names FROM part GROUP BY 1),
claims AS (SELECT 'skill' AS pillar, term_id, unnest(CASE WHEN ord % 3 < 2 THEN [term_id, 'Brand#' || (ord - ord % 3) || ' or next'] ELSE [term_id] END) AS source FROM brands)"""


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role for each supplier: the four brands that it delivers most are required, and two requirements by rule; the next
    two are nice to have."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    most = line.groupBy("l_suppkey", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    top = most.withColumn("r", F.row_number().over(W.partitionBy("l_suppkey").orderBy(F.desc("n"), "p_brand"))).where("r <= 6")
    six = top.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "p_brand"))), lambda x: x["p_brand"]).alias("b"))
    both = table(spark, sf_dir, "supplier").join(six, "s_suppkey").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    k = F.col("s_suppkey")
    more = F.array(F.concat(F.lit("Brand#"), (k % 24).cast("string"), F.lit(" or next")), F.when(k % 2 == 1, "Problem Solving").otherwise("no such thing"))
    title = F.element_at(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("5-LOW")), (k % 3 + 1).cast("int"))
    return both.select(_id("S", k).alias("role_id"), title.alias("title"), F.concat(F.slice("b", 1, 4), more).alias("required"), F.concat(F.slice("b", 5, 2), F.array(F.lit("teamwork"))).alias("nice"), (1 + k % 3).cast("int").alias("exp_min"), (3 + k % 4).cast("int").alias("exp_max"), F.col("n_name").alias("location"))


ROLES_SQL = """most AS (SELECT l_suppkey, p_brand, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_brand) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
six AS (SELECT l_suppkey AS s_suppkey, list(p_brand ORDER BY r) AS b FROM most WHERE r <= 6 GROUP BY 1),
roles AS (SELECT 'S' || s_suppkey AS role_id, ['1-URGENT', '2-HIGH', '5-LOW'][1 + s_suppkey % 3] AS title, b[1:4] || ['Brand#' || (s_suppkey % 24) || ' or next', CASE WHEN s_suppkey % 2 = 1 THEN 'Problem Solving' ELSE 'no such thing' END] AS required, b[5:6] || ['teamwork'] AS nice,
  CAST(1 + s_suppkey % 3 AS INTEGER) AS exp_min, CAST(3 + s_suppkey % 4 AS INTEGER) AS exp_max, n_name AS location FROM supplier JOIN six USING (s_suppkey) JOIN nation ON n_nationkey = s_nationkey)"""


def retier(roles_: DataFrame) -> DataFrame:
    """Of each role: the first requirement preferred, then dropped where the number of years allows; the second preferred."""
    first, second = F.col("required")[0], F.col("required")[1]
    row = lambda source, tier, at: F.struct(source.alias("source"), F.lit(tier).alias("tier"), F.lit(at).alias("ord"))
    rows = F.array(row(first, "preferred", 0), row(second, "preferred", 1), row(F.when(F.col("exp_min") > 1, first), "dropped", 2))
    return roles_.select("role_id", F.inline(rows)).where("source is not null")


RETIER_SQL = """retier AS (SELECT role_id, required[1] AS source, 'preferred' AS t, 0 AS ord FROM roles UNION ALL SELECT role_id, required[2], 'preferred', 1 FROM roles UNION ALL SELECT role_id, required[1], 'dropped', 2 FROM roles WHERE exp_min > 1)"""
