"""The controlled vocabulary as small tables: terms, surfaces, edges, closure, audits and patches.

term(pillar, term_id, ord, label, surfaces, related, from_requirements): related is array<struct(phrase, weight)>.
edge(pillar, src, dst, kind, weight, ord).
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..sources.store import forget, small, stored

PILLARS, KINDS = ("skill", "occupation"), ("narrower", "adjacent")


def checked_terms(terms: DataFrame) -> DataFrame:
    return terms.withColumn("pillar", F.when(F.col("pillar").isin(*PILLARS), F.col("pillar")).otherwise(F.raise_error(F.lit("unknown pillar"))))


def checked_edges(edges: DataFrame) -> DataFrame:
    fine = F.col("pillar").isin(*PILLARS) & F.col("kind").isin(*KINDS) & F.col("weight").between(0, 1)
    return edges.withColumn("weight", F.when(fine, F.col("weight")).otherwise(F.raise_error(F.lit("an edge has an unknown pillar or kind, or a weight outside 0 to 1"))))


def surfaces(terms: DataFrame) -> DataFrame:
    """pillar, key, term_id, weight, kind (surface before related), term_ord, ord."""
    own = terms.select("pillar", "term_id", F.col("ord").alias("term_ord"), F.posexplode("surfaces").alias("ord", "phrase")).withColumn("weight", F.lit(1.0)).withColumn("kind", F.lit("surface"))
    near = terms.select("pillar", "term_id", F.col("ord").alias("term_ord"), F.posexplode("related").alias("ord", "r")).select("pillar", "term_id", "term_ord", "ord", F.col("r.phrase").alias("phrase"), F.col("r.weight").alias("weight"), F.lit("related").alias("kind"))
    return own.unionByName(near).withColumn("key", X.normalize_key(F.col("phrase")))


def resolve_surface(rows: DataFrame, phrase: str, surface: DataFrame, pillar: str) -> DataFrame:
    """rows with term_id: the first term in vocabulary order with an equal surface key, or null."""
    keys = surface.where((F.col("pillar") == pillar) & (F.col("kind") == "surface")).groupBy("key").agg(F.min(F.struct("term_ord", "term_id")).alias("t"))
    return rows.withColumn("key", X.normalize_key(F.col(phrase))).join(keys, "key", "left").withColumn("term_id", F.col("t.term_id")).drop("t", "key")


#: Graphs of at most so many edges, and closures of so many pairs, are worked out on the driver.
FEW_EDGES, FEW_PAIRS = 20_000, 200_000


def _few(edges: DataFrame) -> list[tuple[str, str]] | None:
    """The edges (src, dst), if there are few of them."""
    rows = edges.limit(FEW_EDGES + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= FEW_EDGES else None


def _paths(pairs: list[tuple[str, str]]) -> list[tuple[str, str]] | None:
    """All (src, dst) with a path, if there are few of them."""
    below: dict[str, set[str]] = {}
    for a, z in pairs:
        below.setdefault(a, set()).add(z)
    out: list[tuple[str, str]] = []
    for a in below:
        seen, todo = set(), list(below[a])
        while todo:
            z = todo.pop()
            if z not in seen:
                seen.add(z)
                todo += below.get(z, ())
        out += [(a, z) for z in seen]
        if len(out) > FEW_PAIRS:
            return None
    return out


def narrower_closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path of narrower edges; cycles end too.

    A small graph is closed on the driver and planned as a local table. In a large one each round joins only the pairs
    that the last round found with all found so far, on both sides, so paths double in length and no pair is made again
    from two old ones; a round writes its new pairs alone.
    """
    one = edges.where("kind = 'narrower'").select("src", "dst").distinct()
    few = _few(one)
    paths = None if few is None else _paths(few)
    if paths is not None:
        return one.sparkSession.createDataFrame(pa.table({"src": pa.array([p[0] for p in paths], pa.string()), "dst": pa.array([p[1] for p in paths], pa.string())}), "src string, dst string")
    new = stored(one)
    out, every = [new], new
    while True:
        left = new.alias("a").join(every.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        right = every.alias("a").join(new.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        new = stored(left.union(right).distinct().join(every, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return every
        out.append(new)
        every = reduce(DataFrame.union, out)


def cyclic_terms(edges: DataFrame) -> DataFrame:
    """term_id of every term on a cycle of narrower edges.

    Terms that nothing is narrower than, or that are narrower than nothing, lie on no cycle: they are trimmed, round by
    round, each round from what the last one left. Only what stays, which is nothing for a sound graph, is closed.
    """
    cur, n = edges.where("kind = 'narrower'").select("src", "dst").distinct(), None
    if _few(cur) is None:
        cur = stored(cur)
        while True:
            size = cur.count()
            if size == n or not size:
                break
            n = size
            fed = cur.join(cur.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            nxt = stored(fed.join(cur.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            forget(cur)
            cur = nxt
    return narrower_closure(cur.withColumn("kind", F.lit("narrower"))).where("src = dst").select(F.col("src").alias("term_id"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Adjacent edges in both directions with the first edge's weight."""
    near = edges.where("kind = 'adjacent'")
    both = near.select("pillar", "src", "dst", "weight", "ord").union(near.select("pillar", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "ord"))
    return both.groupBy("pillar", "src", "dst").agg(F.min_by("weight", "ord").alias("weight"))


def validation_errors(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, detail: cycles, edges to no term of their pillar, edges to themselves, terms without surface and edge."""
    loops = cyclic_terms(edges).select(F.lit("cycle").alias("kind"), F.col("term_id").alias("detail"))
    ends = edges.select("pillar", "src", "dst", F.explode(F.array("src", "dst")).alias("term_id"))
    dangling = ends.join(terms.select("pillar", "term_id"), ["pillar", "term_id"], "left_anti").select(F.lit("dangling_edge").alias("kind"), F.concat_ws("->", "src", "dst").alias("detail")).distinct()
    own = edges.where("src = dst").select(F.lit("self_edge").alias("kind"), F.col("src").alias("detail"))
    orphan = terms.where(F.size("surfaces") == 0).join(ends.select("term_id"), "term_id", "left_anti").select(F.lit("orphan_term").alias("kind"), F.col("term_id").alias("detail"))
    return loops.union(dangling).union(own).union(orphan)


def unmatched_requirements(wanted: DataFrame, terms: DataFrame, pillar: str) -> DataFrame:
    """Requirement strings (column source) that no term claims; compared as they are."""
    known = terms.where(F.col("pillar") == pillar).select(F.explode("from_requirements").alias("source"))
    return wanted.select("source").distinct().join(known, "source", "left_anti")


def surface_collisions(surface: DataFrame) -> DataFrame:
    """Keys that two terms of a pillar own."""
    owners = surface.where("kind = 'surface'").groupBy("pillar", "key").agg(F.countDistinct("term_id").alias("owners"))
    return owners.where("owners > 1")


def from_draft(draft: DataFrame, pillar: str) -> tuple[DataFrame, DataFrame]:
    """(terms, edges) of drafted terms(ord, id, canonical, aliases, narrower, adjacent array<struct(term, weight)>, related, from_requirements).

    Surfaces: canonical, aliases, narrower forms, each once. Adjacency: sorted pairs, first weight wins, unknown ends dropped.
    """
    terms = draft.select(F.lit(pillar).alias("pillar"), F.col("id").alias("term_id"), "ord", F.col("canonical").alias("label"), F.array_distinct(F.concat(F.array("canonical"), "aliases", "narrower")).alias("surfaces"), "related", "from_requirements")
    pairs = draft.select("id", "ord", F.posexplode("adjacent").alias("pos", "a")).select(F.least("id", "a.term").alias("src"), F.greatest("id", "a.term").alias("dst"), F.col("a.weight").alias("weight"), F.struct("ord", "pos").alias("at"))
    pairs = pairs.groupBy("src", "dst").agg(F.min_by("weight", "at").alias("weight"), F.min("at").alias("at"))
    known = terms.select("term_id")
    for end in ("src", "dst"):
        pairs = pairs.join(known.withColumnRenamed("term_id", end), end, "left_semi")
    edges = pairs.select(F.lit(pillar).alias("pillar"), "src", "dst", F.lit("adjacent").alias("kind"), "weight", (F.row_number().over(W.orderBy("at")) - 1).alias("ord"))
    return terms, edges


def patched(draft: DataFrame, add_narrower: DataFrame | None = None, add_related: DataFrame | None = None, merge: tuple[str, str] | None = None, drop_adjacent: list[tuple[str, str]] = ()) -> DataFrame:
    """Reviewed changes to drafted terms; applying them twice changes nothing more.

    add_narrower(id, phrase), add_related(id, phrase, weight); merge: (kept, merged) terms; drop_adjacent: pairs of ids.
    """
    out = draft
    if add_narrower is not None:
        more = add_narrower.groupBy("id").agg(F.sort_array(F.collect_list("phrase")).alias("_m"))
        out = out.join(more, "id", "left").withColumn("narrower", F.array_distinct(F.concat("narrower", F.coalesce("_m", F.array().cast("array<string>"))))).drop("_m")
    if add_related is not None:
        more = add_related.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("phrase", "weight"))).alias("_m"))
        none = F.array().cast("array<struct<phrase:string,weight:double>>")
        out = out.join(more, "id", "left")
        fresh = F.filter(F.coalesce("_m", none), lambda x: ~F.exists("related", lambda r: r["phrase"] == x["phrase"]))
        out = out.withColumn("related", F.concat("related", fresh)).drop("_m")
    for a, b in drop_adjacent:
        other = F.when(F.col("id") == a, F.lit(b)).when(F.col("id") == b, F.lit(a)).otherwise(F.lit(""))
        out = out.withColumn("_o", other).withColumn("adjacent", F.filter("adjacent", lambda x: x["term"] != F.col("_o"))).drop("_o")
    if merge:
        kept, gone = merge
        extra = out.where(F.col("id") == gone).select(F.col("aliases").alias("_a"), F.col("from_requirements").alias("_f"))
        out = out.where(F.col("id") != gone).join(small(extra, 1), F.col("id") == kept, "left")
        none = F.array().cast("array<string>")
        out = out.withColumn("aliases", F.array_distinct(F.concat("aliases", F.coalesce("_a", none)))).withColumn("from_requirements", F.array_distinct(F.concat("from_requirements", F.coalesce("_f", none)))).drop("_a", "_f")
        out = out.withColumn("adjacent", F.filter("adjacent", lambda x: x["term"] != gone))
    return out.select(draft.columns)


OPERATIONS = "kind string, id string, other string, phrase string, weight double, ord int"


def apply_operations(draft: DataFrame, unmapped: DataFrame, operations: DataFrame, pillar: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(draft, unmapped, edges, log) after reviewed changes, a row each, as OPERATIONS has them; twice is as once.

    narrower: phrase is a narrower form of id. related: phrase is related to id by weight. drop: id and other are not
    adjacent. merge: other becomes id, which takes its aliases and requirements; nothing stays adjacent to it. edge: id is
    narrower than other, both being terms in the end. Changes of a term meet it in one join, whatever their number;
    unmapped strings that a change has placed go. log is operations with `applied`: not for terms that are not there, nor
    for merges into a term that is itself merged.
    """
    ids = draft.select("id").withColumn("_own", F.lit(True))
    merged = operations.where("kind = 'merge'").select(F.col("other").alias("id")).distinct().withColumn("_gone", F.lit(True))
    ops = operations.join(ids, "id", "left").join(merged, "id", "left").join(ids.select(F.col("id").alias("other"), F.col("_own").alias("_other")), "other", "left")
    there, both = F.col("_own").isNotNull(), F.col("_own").isNotNull() & F.col("_other").isNotNull()
    applied = F.when(F.col("kind").isin("narrower", "related"), there).when(F.col("kind") == "merge", both & F.col("_gone").isNull() & (F.col("id") != F.col("other"))).when(F.col("kind").isin("drop", "edge"), both).otherwise(F.lit(False))
    log = ops.withColumn("applied", applied).select(*operations.columns, "applied")
    good = log.where("applied")
    merges = good.where("kind = 'merge'").select(F.col("id").alias("kept"), F.col("other").alias("id"), "ord")

    def change(rows, id_, at, narrower=None, related=None, drop=None, aliases=None, claims=None):
        none, pair = F.lit(None).cast("array<string>"), F.lit(None).cast("struct<phrase:string,weight:double>")
        text = F.lit(None).cast("string")
        return rows.select(F.col(id_).alias("id"), F.struct(F.col(at).alias("at"), (narrower if narrower is not None else text).alias("narrower"), (related if related is not None else pair).alias("related"), (drop if drop is not None else text).alias("drop"), (aliases if aliases is not None else none).alias("aliases"), (claims if claims is not None else none).alias("claims")).alias("c"))

    drops = good.where("kind = 'drop'")
    near = draft.select("id", F.explode("adjacent").alias("a")).select("id", F.col("a.term").alias("other")).join(merges.select(F.col("id").alias("other"), "ord"), "other")
    changes = change(good.where("kind = 'narrower'"), "id", "ord", narrower=F.col("phrase"))
    changes = changes.union(change(good.where("kind = 'related'"), "id", "ord", related=F.struct("phrase", "weight")))
    changes = changes.union(change(drops, "id", "ord", drop=F.col("other"))).union(change(drops, "other", "ord", drop=F.col("id"))).union(change(near, "id", "ord", drop=F.col("other")))
    changes = changes.union(change(merges.join(draft.select("id", "aliases", "from_requirements"), "id"), "kept", "ord", aliases=F.col("aliases"), claims=F.col("from_requirements")))
    each = changes.groupBy("id").agg(F.sort_array(F.collect_list("c")).alias("_c"))
    out = draft.join(merges.select("id"), "id", "left_anti").join(each, "id", "left")
    none = F.array().cast("array<string>")

    def more(name):
        return F.coalesce(F.array_compact(F.transform("_c", lambda x: x[name])), F.array().cast("array<struct<phrase:string,weight:double>>") if name == "related" else none)

    fresh = F.filter(more("related"), lambda x: ~F.exists("related", lambda r: r["phrase"] == x["phrase"]))
    fresh = F.aggregate(fresh, F.array().cast("array<struct<phrase:string,weight:double>>"), lambda a, x: F.when(F.exists(a, lambda r: r["phrase"] == x["phrase"]), a).otherwise(F.concat(a, F.array(x))))  # the first of equal phrases
    many = lambda name: F.coalesce(F.flatten(F.array_compact(F.transform("_c", lambda x: x[name]))), none)
    out = out.withColumn("narrower", F.array_distinct(F.concat("narrower", more("narrower")))).withColumn("related", F.concat("related", fresh))
    out = out.withColumn("aliases", F.array_distinct(F.concat("aliases", many("aliases")))).withColumn("from_requirements", F.array_distinct(F.concat("from_requirements", many("claims"))))
    out = out.withColumn("_d", more("drop")).withColumn("adjacent", F.filter("adjacent", lambda a: ~F.array_contains(F.col("_d"), a["term"]))).select(draft.columns)
    placed = good.where("kind in ('narrower', 'related')").select(F.col("phrase").alias("string")).distinct()
    left = unmapped.join(placed, "string", "left_anti").select(unmapped.columns)
    edges = good.where("kind = 'edge'").join(merges.select("id"), "id", "left_anti").join(merges.select(F.col("id").alias("other")), "other", "left_anti")
    edges = edges.select(F.lit(pillar).alias("pillar"), F.col("id").alias("src"), F.col("other").alias("dst"), F.lit("narrower").alias("kind"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "ord")
    return out, left, edges, log
