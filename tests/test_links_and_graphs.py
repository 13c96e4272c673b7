"""Phrases in prose, ties of links, large graphs, ranks with ties and nulls: against plain Python."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchloom.operators import evaluation, linking, phrases, vocabulary
from matchloom.plans import derived
from matchloom.sources import files

SF = "/root/testdata/sf0.001"
SURFACE = "pillar string, term_id string, term_ord int, ord int, phrase string, weight double, kind string, key string"


def related(spark, rows):
    return spark.createDataFrame([("skill", t, o, i, p, 0.7, "related", p) for t, o, i, p in rows], SURFACE)


def test_hits_do_not_repeat_the_text():
    """A long text with many hits: rows come out in parts, and nothing of a text's size is made for each of them."""
    wanted = [f"{i:04d}" for i in range(2_000)]
    text = " ".join(wanted) * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([text] * 40)], names=["id", "text"])
    shared = SimpleNamespace(value=phrases.automaton(wanted))
    before = pa.total_allocated_bytes()
    most, got = 0, []
    for out in phrases._found(shared, False)([batch]):
        most = max(most, pa.total_allocated_bytes() - before)
        got.append((out.num_rows, set(out.column("id").to_pylist())))
    assert sum(n for n, _ in got) == 40 * 2_000 and set().union(*[s for _, s in got]) == set(range(40))
    assert len(got) == 2 and most < 20_000_000  # 80,000 copies of the text are 4,000 MB


@pytest.mark.parametrize("part", [phrases.PART, 12])
def test_phrases_are_found_as_contains_finds_them(spark, part):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abAB é\n") for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (61, "É b"), (62, "ab" * 20_000)]
    wanted = [(f"T{i}", "".join(rng.choice("abA é") for _ in range(rng.randint(1, 4)))) for i in range(50)] + [("E", ""), ("E2", ""), ("N", None), ("T0", "ab"), ("T1", "AB")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    got = phrases.phrases_within(df, "text", spark.createDataFrame(wanted, "term string, phrase string"), part=part)
    want = [(i, t, p) for i, s in texts for t, p in wanted if s is not None and p is not None and p.lower() in s.lower()]
    assert sorted((r["id"], r["term"], r["phrase"]) for r in got.collect()) == sorted(want)


def test_no_phrases_and_no_texts(spark):
    none = spark.createDataFrame([], "term string, phrase string")
    df = spark.createDataFrame([(1, "text")], "id long, text string")
    assert phrases.phrases_within(df, "text", none).count() == 0
    assert phrases.phrases_within(df.limit(0), "text", spark.createDataFrame([("T", "t")], "term string, phrase string")).count() == 0


def test_a_hundred_thousand_phrases(spark):
    """Runs of three words of all documents, looked for in all documents: the same as Python finds in every tenth."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    runs = set()
    for _, t in docs:
        w = (t or "").split(" ")
        runs |= {" ".join(w[k : k + 3]) for k in range(len(w) - 2)}
    wanted = sorted(runs) + [f"no such run {k}" for k in range(100_000 - len(runs))]
    assert len(wanted) >= 100_000
    got = phrases.phrases_within(spark.createDataFrame(docs, "id long, text string").repartition(4), "text", spark.createDataFrame([(p,) for p in wanted], "phrase string"))
    found = {}
    for r in got.collect():
        found.setdefault(r["id"], set()).add(r["phrase"])
    for i, t in docs[::20]:
        low = (t or "").lower()
        assert found.get(i, set()) == {p for p in wanted if p.lower() in low}


def test_shared_phrases_go_to_the_first_term_as_in_the_golden_set(spark):
    surface = related(spark, [("A", 0, 0, "other words"), ("A", 0, 1, "built pipes"), ("B", 1, 0, "Built Pipes"), ("C", 2, 0, "pipes")])
    fields = spark.createDataFrame([("p", "projects", "We rebuilt pipes."), ("p", "skills", "built PIPES, pipes, Pipes")], "candidate_id string, field string, text string")
    got = {(r["field"], r["phrase"].lower()): r["term_id"] for r in linking.link_fields(fields, "candidate_id", surface).collect()}
    assert got == {("projects", "built pipes"): "A", ("projects", "pipes"): "C", ("skills", "built pipes"): "A", ("skills", "pipes"): "C"}
    gold = {(r["field"], r["text"].lower()): r["expected"] for r in linking.golden_links(fields, "candidate_id", surface).collect()}
    assert gold == got
    m = evaluation.link_metrics(linking.golden_links(fields, "candidate_id", surface), linking.link_fields(fields, "candidate_id", surface).withColumn("ord", F.lit(0)), "candidate_id").first()
    assert (m["tp"], m["fp"], m["fn"]) == (4, 0, 0)


def test_blank_phrases_are_looked_for_and_empty_ones_rejected(spark):
    claims = spark.createDataFrame([(1, "projects", "prose", " "), (2, "projects", "prose", " "), (3, "projects", "prose", ""), (4, "projects", "prose", None)], "id long, field string, group string, phrase string")
    fields = spark.createDataFrame([(1, "projects", "two words"), (2, "projects", "word"), (3, "projects", "x"), (4, "projects", "x")], "id long, field string, text string")
    kept, rejected = linking.ground(claims, fields, "id")
    assert [r["id"] for r in kept.collect()] == [1]
    assert {r["id"]: r["reason"] for r in rejected.collect()} == {2: "phrase not in the field", 3: "empty phrase", 4: "empty phrase"}


def paths(pairs):
    below = {}
    for a, z in pairs:
        below.setdefault(a, set()).add(z)
    out = set()
    for a in below:
        todo = list(below[a])
        while todo:
            z = todo.pop()
            if (a, z) not in out:
                out.add((a, z))
                todo += below.get(z, ())
    return out


@pytest.mark.parametrize("limits", [(20_000, 200_000), (20_000, 3), (0, 0)])  # on the driver, its result too large, in rounds
def test_closure_and_cycles(spark, monkeypatch, limits):
    monkeypatch.setattr(vocabulary, "FEW_EDGES", limits[0])
    monkeypatch.setattr(vocabulary, "FEW_PAIRS", limits[1])
    rng = random.Random(7)
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(13)] + [("a13", "b0"), ("b0", "b1"), ("b1", "b2"), ("b2", "b0"), ("b2", "c0"), ("c0", "c1"), ("c1", "d0"), ("d0", "d0"), ("d0", "e")]
    pairs += [(f"r{rng.randint(0, 25)}", f"r{rng.randint(26, 40)}") for _ in range(40)] + [("a0", "a1")]
    edges = spark.createDataFrame([("skill", a, z, "narrower", 1.0, i) for i, (a, z) in enumerate(pairs)] + [("skill", "e", "a0", "adjacent", 0.5, 99)], "pillar string, src string, dst string, kind string, weight double, ord int")
    want = paths(pairs)
    got = [tuple(r) for r in vocabulary.narrower_closure(edges).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sorted(r["term_id"] for r in vocabulary.cyclic_terms(edges).collect()) == sorted(a for a, z in want if a == z) == ["b0", "b1", "b2", "d0"]
    assert vocabulary.narrower_closure(edges.where("kind = 'none'")).count() == vocabulary.cyclic_terms(edges.where("ord < 5")).count() == 0


def test_closure_of_the_tables_graph_by_both_ways(spark, monkeypatch):
    edges = derived.edges(spark, SF, faulty=True)
    small = sorted(map(tuple, vocabulary.narrower_closure(edges).collect()))
    loops = sorted(map(tuple, vocabulary.cyclic_terms(edges).collect()))
    monkeypatch.setattr(vocabulary, "FEW_EDGES", 0)
    assert sorted(map(tuple, vocabulary.narrower_closure(edges).collect())) == small
    assert sorted(map(tuple, vocabulary.cyclic_terms(edges).collect())) == loops and loops


def test_positions_with_ties_nulls_and_few_rows(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, 0.5, 0.5, 0.5, 1.0, float(i)])) for g in ("a", "b", None) for i in range(40)] + [("c", 1, None), ("c", 0, None), ("d", 5, 2.0)]
    rng.shuffle(rows)
    got = evaluation.positions(spark.createDataFrame(rows, "g string, id long, score double").repartition(5), "g", "score", "id").collect()
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        want += [(g, i, s, k, len(own)) for k, (_, i, s) in enumerate(own)]
    assert sorted(((r["g"], r["id"], r["score"], r["rank"], r["n"]) for r in got), key=repr) == sorted(want, key=repr)


def test_bucketed_vocabulary_is_joined_where_it_lies(spark, tmp_path):
    terms, edges = derived.terms(spark, SF).where("term_id not like 'N%'"), derived.edges(spark, SF).where("src <> 'P0' and dst not in ('P-1', 'P200')")
    files.store_vocabulary(terms, edges, f"{tmp_path}/plain")
    files.store_vocabulary_tables(terms, edges, "kept", f"file://{tmp_path}/tables", buckets=4)
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    for plain, kept in zip(files.load_vocabulary(spark, f"{tmp_path}/plain"), files.load_vocabulary_tables(spark, "kept")):
        assert rows(plain) == rows(kept) and rows(plain)
    surface, _ = files.load_vocabulary_tables(spark, "kept")
    part = spark.read.parquet(f"{SF}/part.parquet").withColumn("said", F.concat_ws(" ", "p_name", "p_partkey"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = vocabulary.resolve_surface(part, "said", surface, "skill")
        plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        got = {r["p_partkey"]: r["term_id"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan  # of the parts alone
    assert all(t in (None, f"P{k}") for k, t in got.items()) and sum(t is not None for t in got.values()) > 100
