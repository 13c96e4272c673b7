"""Bounded shortlists, stored requirement scores and stateful arrivals against scoring everything at once."""

import itertools
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matchloom.operators import linking, matching, rubric, selection, topk, vocabulary
from matchloom.operators.score_store import ScoreStore, assessment_keys
from matchloom.plans import analogue as A
from matchloom.plans import registry
from matchloom.streaming import scoring

SF = "/root/testdata/sf0.001"
TERM = "pillar string, term_id string, ord int, label string, surfaces array<string>, related array<struct<phrase:string,weight:double>>, from_requirements array<string>"
MENTION = "candidate_id long, term_id string, field string, phrase string, relation string, ord long"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(21)
    names = [f"T{i}" for i in range(90)]
    terms = [("skill", t, i, t, [t], [(f"near {t}", 0.7)] if i % 4 == 0 else [], [t] + (["either"] if i < 2 else [])) for i, t in enumerate(names)] + [("occupation", "CHEF", 100, "Chef", ["Chef"], [("Cook", 0.5)], []), ("occupation", "BAKER", 101, "Baker", ["Baker"], [], [])]
    edges = [("skill", "T3", "T2", "narrower", 1.0, 0), ("skill", "T2", "T1", "narrower", 1.0, 1), ("occupation", "BAKER", "CHEF", "adjacent", 0.6, 2)] + [("skill", f"T{i}", f"T{i + 5}", "adjacent", round(0.3 + i % 5 / 10, 1), 3 + i) for i in range(12)]
    roles = [
        ("R1", "Chef", ["T0", "T1", "either", "nothing"], ["T9", "teamwork"], 2, 4, "Riyadh"), ("R2", "Baker", ["T2", "T6"], [], 1, 9, "Cairo"),
        ("R3", "Pilot", ["T80", "T81"], ["T82"], 3, 5, "Dubai"), ("R4", "Chef", names[:35] + ["none"] * 5, names[10:45], 2, 3, "Doha"),
    ]
    people = [(i, rng.choice(["Riyadh", "Cairo", "Dubai", "", None]), rng.choice(["Egypt", "UAE", "Saudi Arabia"]), rng.choice([None, 0, 20, 40, 100]), rng.choice([None, 3.0])) for i in range(80)]
    fields = list(matching.FIELD_STRENGTH)
    mentions = [(i, rng.choice(names[:40]), rng.choice(fields), rng.choice(["p", "near T4", "near T8"]), rng.choice(["met", "adjacent"]), k) for i in range(70) for k in range(rng.randint(0, 12))]
    past = [(i, k, rng.choice(["Chef", "Cook", "Baker", "Driver"]), rng.choice([0.0, 0.5, 1.25, 4.0])) for i in range(75) for k in range(rng.randint(0, 3))]
    t = spark.createDataFrame(terms, TERM)
    e = spark.createDataFrame(edges, "pillar string, src string, dst string, kind string, weight double, ord int")
    r = spark.createDataFrame(roles, "role_id string, title string, required array<string>, nice array<string>, exp_min int, exp_max int, location string")
    surface = vocabulary.surfaces(t).cache()
    return {
        "roles": r, "req": rubric.compile_rubrics(r, t).cache(), "surface": surface, "route": matching.routes(e, t).cache(), "near": vocabulary.mirrored(e), "targets": matching.role_occupations(r, surface),
        "people": spark.createDataFrame(people, "candidate_id long, city string, country string, notice_days int, stated_years double").cache(), "mentions": spark.createDataFrame(mentions, MENTION).cache(),
        "past": linking.resolve_occupations(spark.createDataFrame(past, "candidate_id long, pos int, title string, duration_years double"), "title", surface).cache(),
    }


def every(w, rub):
    skills = matching.skill_scores(matching.term_routes(matching.have_terms(w["mentions"], w["surface"]), w["route"], w["req"]))
    exp = matching.experience_scores(w["people"], w["req"], matching.relevant_years(w["past"], w["targets"], w["near"]))
    return matching.match_scores(skills, exp, matching.location_scores(w["people"], w["roles"]), w["req"], rub)


@pytest.mark.parametrize("threshold, most, fallback", [(40.0, 4, 2), (99.5, 50, 3), (5.0, 3, 5), (0.0, 90, 5)])
def test_bounded_shortlist_equals_scoring_everyone(world, threshold, most, fallback):
    w, rub = world, rubric.rubrics(world["roles"], threshold=threshold, most=most)
    field = topk.Field(matching.have_terms(w["mentions"], w["surface"]).cache(), w["route"], w["people"], w["past"], w["targets"], w["near"], w["roles"], w["req"], rub)
    got, counts = topk.shortlist(field, fallback_n=fallback)
    totals = every(w, rub).cache()
    want = selection.shortlist(totals, rub, fallback_n=fallback)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    over = field.bounds(field.masks()).join(totals, ["candidate_id", "role_id"]).where("total > bound")
    assert over.count() == 0
    n = {r["role_id"]: r["scored"] for r in counts.collect()}
    assert set(n) == {"R1", "R2", "R3", "R4"} and all(0 <= x <= 80 for x in n.values())
    if most < 50:
        assert sum(n.values()) < 4 * 80 * 0.7


def test_share_of_pruned_pairs_over_the_tables(spark):
    n = registry.queries()["shortlist_scored_pairs"](spark, "/root/testdata/sf0.01").collect()
    assert len(n) == 10 and sum(r["scored"] for r in n) < 0.5 * sum(r["people"] for r in n)


def test_score_store(spark, world, tmp_path):
    w, calls = world, []
    have = matching.have_terms(w["mentions"], w["surface"]).cache()

    def score(r):
        calls.append(r.count())
        return matching.skill_scores(matching.term_routes(have, w["route"], r))

    def same(store, req):
        want = score(req)
        assert sorted(map(str, store.scores(req).select(*want.columns).collect())) == sorted(map(str, want.collect()))

    small = w["req"].where("role_id in ('R1', 'R2')")
    store = ScoreStore(spark, f"file://{tmp_path}/scores", "v1")
    assert store.scores(small).count() == 0
    terms = small.where("kind = 'skill' and size(term_ids) > 0")
    assert store.fill(small, score) == terms.select("term_ids", "blocked").distinct().count() == calls[-1]
    same(store, small)
    before = len(calls)
    retier = spark.createDataFrame([("R1", "T0", "preferred", 0), ("R1", "T1", "dropped", 1)], "role_id string, source string, tier string, ord int")
    moved, rub = rubric.apply_steering(small, rubric.rubrics(w["roles"]), retier, {"required": 60.0, "preferred": 20.0, "availability": 15.0, "location": 5.0}, 40.0)
    assert store.fill(small, score) == 0 and store.fill(moved, score) == 0 and len(calls) == before  # tiers move no score
    assert ScoreStore(spark, store.folder, "v1").fill(moved, score) == 0
    same(store, moved)
    other = small.withColumn("term_ids", F.when((F.col("role_id") == "R2") & (F.col("req_pos") == 0), F.array(F.lit("T7"))).otherwise(F.col("term_ids")))
    assert store.fill(other, score) == 1
    same(store, other)
    same(store, small)
    newer = ScoreStore(spark, store.folder, "v2")
    assert newer.scores(small).count() == 0 and newer.fill(small, score) > 1
    same(newer, small)


def test_a_fill_that_dies_leaves_nothing_that_is_read(spark, world, tmp_path):
    have = matching.have_terms(world["mentions"], world["surface"])
    req = world["req"].where("role_id = 'R1'")
    store = ScoreStore(spark, f"file://{tmp_path}/scores", "v")
    score = lambda r: matching.skill_scores(matching.term_routes(have, world["route"], r))
    orphan = store.keyed(req).select("requirement_key").limit(1).withColumn("candidate_id", F.lit(-1)).withColumn("score", F.lit(1.0)).withColumn("via", F.lit("x")).withColumn("field", F.lit("x")).withColumn("phrase", F.lit("x"))
    orphan.write.partitionBy("requirement_key").parquet(f"{store.folder}/scores/batch=dead")
    with pytest.raises(ZeroDivisionError):
        store.fill(req, lambda r: 1 / 0)
    assert store.fill(req, score) > 0
    assert store.scores(req).where("candidate_id = -1").count() == 0


def test_assessment_keys(world):
    key = lambda df: {r["role_id"]: r["assessment_key"] for r in assessment_keys(df).collect()}
    base = key(world["req"])
    assert len(base) == len(set(base.values())) == 4 and all(len(k) == 16 for k in base.values())
    assert key(world["req"].orderBy(F.desc("req_pos"))) == base
    moved = key(world["req"].withColumn("tier", F.when((F.col("role_id") == "R1") & (F.col("req_pos") == 0), "dropped").otherwise(F.col("tier"))))
    assert moved["R1"] != base["R1"] and moved["R2"] == base["R2"]


def test_steered_scores_from_the_store_read_no_lineitem(spark):
    df = registry.queries()["match_scores_from_store"](spark, SF)
    files = df.inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_values_are_those_of_the_evidence(spark, world):
    zero = spark.createDataFrame([(1, "T5", "skills", "near T4", "met", 99), (79, "T4", "skills", "worthless", "met", 0)], MENTION)
    surface = world["surface"].unionByName(world["surface"].where("kind = 'related' and term_id = 'T4'").withColumns({"phrase": F.lit("worthless"), "key": F.lit("worthless"), "weight": F.lit(0.0)}))
    mentions = world["mentions"].unionByName(zero)
    have = matching.have_terms(mentions, surface)
    assert have.where("candidate_id = 79").count() == 0
    want = matching.skill_scores(matching.term_routes(have, world["route"], world["req"])).select("candidate_id", "role_id", "req_pos", "score")
    got = matching.skill_values(matching.have_values(mentions, surface), world["route"], world["req"]).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["match_scores", "match_scores_steered"])
def test_totals_move_no_places_of_lines(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" in plan and not any(c in plan for c in ("l_linenumber", "l_extendedprice"))


@pytest.mark.parametrize("name", ["gaps", "top_gaps", "strengths", "brief_markdown", "brief_texts", "assessment_text"])
def test_explanations_store_no_evidence_of_others(spark, name):
    assert not any("stored-" in f for f in registry.queries()[name](spark, SF).inputFiles())


@pytest.mark.parametrize("name", ["gate_holes", "same_occupation_rejects", "excluded", "match_scores_from_store"])
def test_what_is_stored_of_everyone_is_narrow(spark, name):
    files = [f for f in registry.queries()[name](spark, SF).inputFiles() if "stored-" in f]
    assert files and all(set(pq.read_schema(f.removeprefix("file://")).names) <= {"candidate_id", "role_id", "req_pos", "score", "total"} for f in files)


def test_evidence_of_some_people(spark):
    who = spark.createDataFrame([(1,), (7,), (149,)], "candidate_id long")
    every = A.mentions(spark, SF)
    got, want = A.mentions(spark, SF, who), every.join(who, "candidate_id", "left_semi").select(*every.columns)
    assert want.count() > 0 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_batch_adds_only_people_whose_evidence_changes(spark, world, tmp_path):
    first = world["mentions"].where("candidate_id between 1 and 40")
    better = spark.createDataFrame([(3, "T1", "skills", "p", "met", -1)], MENTION)
    for part in (first, first.where("candidate_id < 20"), better):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(world["mentions"].schema).parquet(f"{tmp_path}/in")
        scoring.score_arrivals(arriving, world["route"], world["req"], f"{tmp_path}/out", f"{tmp_path}/state", world["surface"]).awaitTermination()
    held = spark.read.parquet(f"{tmp_path}/state/evidence")
    people = {b: {r[0] for r in held.where(F.col("batch") == b).select("candidate_id").collect()} for b in range(3)}
    assert people == {0: {r[0] for r in first.select("candidate_id").collect()}, 1: set(), 2: {3}}
    assert held.where("batch = 2").count() == first.where("candidate_id = 3").unionByName(better).select("term_id").distinct().count()


def test_better_evidence_is_the_same_in_any_order():
    rows = [(1.0, 5, "a", "p", 5), (1.0, 2, "a", "q", 2), (0.6, 0, "a", "z", 0), (1.0, 2, "b", "q", 2), (1.0, 5, "a", "p", 5)]
    got = set()
    for order in itertools.permutations(rows):
        best = None
        for r in order:
            best = scoring.better(best, r)
        got.add(best)
    assert got == {(1.0, 2, "b", "q", 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_into_batches_gives_the_batch_result(spark, world, tmp_path, seed):
    rng = random.Random(seed)
    rows = [tuple(r) for r in world["mentions"].collect()]
    parts = [[] for _ in range(3)]
    for r in rows:
        for k in rng.sample(range(3), rng.choice([1, 1, 2])):  # late ones, and some twice
            parts[k].append(r)
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part + part[:5], MENTION).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(world["mentions"].schema).parquet(f"{tmp_path}/in")
        scoring.score_arrivals(arriving, world["route"], world["req"], f"{tmp_path}/out", f"{tmp_path}/state", world["surface"]).awaitTermination()
    want = matching.skill_scores(matching.term_routes(matching.have_terms(world["mentions"], world["surface"]), world["route"], world["req"]))
    got = scoring.latest_scores(spark, f"{tmp_path}/out").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
