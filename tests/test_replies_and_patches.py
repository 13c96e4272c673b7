"""Replies kept and read, patches by one merge, positions over many files, links written, briefs written."""

import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from matchloom.operators import evaluation, replies, requests, rubric, sinks, vocabulary
from matchloom.sources import files


def test_a_killed_run_asks_only_the_rest(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()
    rows = [(i, "s", f"question {i % 37}") for i in range(60)] + [(60, None, "question 1"), (61, "s", None)]
    asked = spark.createDataFrame(rows, "id long, system string, user string").repartition(3)

    def answer_until(stop):
        def answer(system, user):
            n = int((user or "question 99").split()[1])
            (log / f"{stop}-{system}-{user}").touch()
            if n >= stop:
                raise RuntimeError("down")
            return f"{system}/{user}"

        return answer

    table = replies.ReplyTable(spark, f"file://{tmp_path}/replies", wave=5)
    first = {r["id"]: r["reply"] for r in table.ask(asked, answer_until(20), attempts=2).collect()}
    assert len(first) == 62 and all((r is None) == ((i % 37 if i < 60 else 1 if i == 60 else 99) >= 20) for i, r in first.items())
    again = replies.ReplyTable(spark, f"file://{tmp_path}/replies", wave=5)
    got = [(r["id"], r["reply"]) for r in again.ask(asked, answer_until(100)).orderBy("id").collect()]
    assert got == [(i, f"{s}/{u}") for i, s, u in rows]
    second = {p.name for p in log.iterdir() if p.name.startswith("100-")}
    assert second == {f"100-s-question {n}" for n in range(20, 37)} | {"100-s-None"}
    assert len(again.held().collect()) == 39


def test_requests_are_worked_out_once_and_a_crash_keeps_finished_tasks(spark, tmp_path):
    made, said = tmp_path / "made", tmp_path / "said"
    made.mkdir(), said.mkdir()

    def source(parts):
        (made / uuid.uuid4().hex).touch()
        yield from parts

    asked = spark.createDataFrame([(i, "s", f"question {i}") for i in range(60)], "id long, system string, user string").coalesce(1)
    asked = asked.mapInPandas(source, asked.schema)

    def answer_until(most):
        def answer(system, user):
            if len(list(said.iterdir())) >= most:
                os._exit(1)
            (said / f"{most} {user}").touch()
            return user.upper()

        return answer

    table = replies.ReplyTable(spark, f"file://{tmp_path}/replies", wave=4)
    with pytest.raises(Exception):
        table.ask(asked, answer_until(30))
    held = table.held().count()
    assert 30 - 2 * 4 * 3 <= held <= 30  # what ran then is lost: four tasks of a request or a few
    got = {r["id"]: r["reply"] for r in table.ask(asked, answer_until(1_000)).collect()}
    assert got == {i: f"QUESTION {i}" for i in range(60)}
    assert len([p for p in said.iterdir() if p.name.startswith("1000 ")]) == 60 - held
    assert len(list(made.iterdir())) <= 4  # twice for each run, whatever the number of waves


def test_retries_and_order(spark, tmp_path):
    (tmp_path / "n").mkdir()

    def answer(system, user):
        tries = len(list((tmp_path / "n").glob(f"{user}-*")))
        (tmp_path / "n" / f"{user}-{tries}").touch()
        if tries < 2:
            raise RuntimeError("not yet")
        return user.upper()

    df = spark.createDataFrame([(i, "", f"u{i}") for i in range(20)], "id long, system string, user string").coalesce(1)
    assert [(r["id"], r["reply"]) for r in requests.answered(df, ["id"], answer, concurrent=4).collect()] == [(i, f"U{i}") for i in range(20)]


def test_links_of_other_terms_are_rejected(spark):
    fields = spark.createDataFrame([("A", "skills", "Docker, Helm")], "id string, field string, text string")
    said = [{"term": "DOCKER", "field": "skills", "phrase": "docker", "relation": "met"}, {"term": "MADE_UP", "field": "skills", "phrase": "helm", "relation": "met"}, {"term": "DOCKER", "field": "skills", "phrase": "helm", "relation": "owns"}, {"field": "skills", "phrase": "helm", "relation": "met"}, {"term": "DOCKER", "field": "skills", "phrase": "podman", "relation": "met"}]
    reply = spark.createDataFrame([("A", "list", json.dumps({"mentions": said}))], "id string, group string, reply string")
    terms = spark.createDataFrame([("DOCKER",), ("DOCKER",), ("HELM",)], "term_id string")
    kept, rejected, out = requests.linked_replies(reply, fields, "id", terms)
    assert [r["term_id"] for r in kept.collect()] == ["DOCKER"]
    assert sorted(r["reason"] for r in rejected.collect()) == ["phrase not in the field", "unknown relation", "unknown term", "unknown term"]
    assert (out.first()["n_mentions"], out.first()["n_rejected"]) == (1, 4)


REQ = "role_id string, req_pos int, source string, kind string, tier string"


def test_steering_replies(spark):
    req = spark.createDataFrame([(r, k, s, "skill", "required") for r in ("R1", "R2", "R3", "R4", "R5") for k, s in enumerate(("a", "b", "c"))], REQ)
    w = {"required": 50, "preferred": 30, "availability": 10, "location": 10}
    said = [
        ("R1", {"weights": w, "threshold": 40, "retier": [{"requirement_source": "a", "new_tier": "preferred"}, {"requirement_source": "zz", "new_tier": "dropped"}, {"requirement_source": "b", "new_tier": "best"}, {"requirement_source": "a", "new_tier": "dropped"}], "unsupported": [{"guidance": "be nice", "reason": "no such dial"}], "diff_en": "less a"}),
        ("R2", {"weights": w | {"required": 60}, "threshold": 40, "retier": [{"requirement_source": "a", "new_tier": "dropped"}], "unsupported": []}),
        ("R3", {"weights": w | {"luck": 0}, "threshold": 40, "retier": []}), ("R4", {"threshold": 1}),
    ]
    df = spark.createDataFrame([(r, json.dumps(x)) for r, x in said] + [("R5", "no json"), ("R6", None)], "role_id string, reply string")
    retier, settings, unsupported, rejected = replies.steering_replies(df, req)
    assert sorted(map(tuple, retier.collect())) == [("R1", "a", "dropped", 3), ("R1", "a", "preferred", 0)]
    assert [tuple(r) for r in settings.collect()] == [("R1", 50.0, 30.0, 10.0, 10.0, 40.0, "less a")]
    assert [tuple(r) for r in unsupported.collect()] == [("R1", "be nice", "no such dial")]
    assert sorted(map(tuple, rejected.collect())) == [("R1", "b", "unknown tier"), ("R1", "zz", "no such requirement"), ("R2", "reply", "weights do not sum to 100"), ("R3", "reply", "not the four weights"), ("R4", "reply", "unreadable"), ("R5", "reply", "unreadable"), ("R6", "reply", "unreadable")]
    rub = rubric.rubrics(req.select("role_id").distinct())
    new, rub2 = rubric.steered(req, rub, retier, settings)
    assert {(r["role_id"], r["source"]): r["tier"] for r in new.collect() if r["tier"] != "required"} == {("R1", "a"): "dropped"}
    by = {r["role_id"]: r for r in rub2.collect()}
    assert by["R1"]["threshold"] == 40.0 and by["R1"]["w_preferred"] == 30.0 and by["R2"]["threshold"] == 56.0 and len(by) == 5
    assert rub2.columns == rub.columns


def term(id_, **more):
    return {"id": id_, "canonical": id_.lower(), "aliases": [], "narrower": [], "adjacent": [], "related": [], "from_requirements": []} | more


def test_draft_replies(spark):
    said = {"terms": [term("A", aliases=["x"], adjacent=[{"term": "B", "weight": 0.5}]), term("B", related=[{"phrase": "p", "weight": 0.7}]), term("A"), term("C", adjacent=[{"term": "A", "weight": 2}]), {"id": "D", "canonical": "d"}, term("")], "unmapped": [{"string": "odd", "reason": "no skill"}]}
    df = spark.createDataFrame([("skill", json.dumps(said)), ("occupation", "?")], "pillar string, reply string")
    draft, unmapped, rejected = replies.draft_replies(df)
    assert [(r["ord"], r["id"]) for r in draft.orderBy("ord").collect()] == [(0, "A"), (1, "B"), (4, "D")]
    assert [tuple(r) for r in unmapped.collect()] == [("skill", "odd", "no skill")]
    assert sorted((r["pillar"], r["id"] or "", r["reason"]) for r in rejected.collect()) == [("occupation", "", "unreadable"), ("skill", "", "no id or name"), ("skill", "A", "id drafted before"), ("skill", "C", "weight outside 0 to 1")]
    terms, edges = vocabulary.from_draft(draft, "skill")
    assert {r["term_id"]: list(r["surfaces"]) for r in terms.collect()} == {"A": ["a", "x"], "B": ["b"], "D": ["d"]}
    assert [(r["src"], r["dst"], r["weight"]) for r in edges.collect()] == [("A", "B", 0.5)]


def test_brief_replies(spark):
    fin = spark.createDataFrame([("R1", 1), ("R1", 2), ("R1", 3)], "role_id string, candidate_id long")
    gap = spark.createDataFrame([("R1", 1, "k", f"gap {k}", k) for k in range(1, 6)] + [("R1", 2, "k", "only gap", 1)], "role_id string, candidate_id long, kind string, detail string, place int")
    one = lambda c, *q: {"candidate_id": c, "summary": f"s{c}", "differentiator": "d", "questions": list(q)}
    df = spark.createDataFrame([("R1", json.dumps({"briefs": [one("1", "q1"), one("2", "a", "b", "c"), one("3", "x"), one("9", "y"), one("1", "later")]})), ("R2", "-")], "role_id string, reply string")
    texts, rejected = replies.brief_replies(df, fin, gap)
    assert {r["candidate_id"]: (r["summary"], list(r["questions"])) for r in texts.collect()} == {1: ("s1", ["q1", "gap 2", "gap 3"]), 2: ("s2", ["a"]), 3: ("s3", [])}
    assert sorted((r["role_id"], r["said"] or "", r["reason"]) for r in rejected.collect()) == [("R1", "1", "told of before"), ("R1", "9", "no finalist"), ("R2", "", "unreadable")]


DRAFT = "ord int, id string, canonical string, aliases array<string>, narrower array<string>, adjacent array<struct<term:string,weight:double>>, related array<struct<phrase:string,weight:double>>, from_requirements array<string>"


def patched_by_hand(terms, unmapped, ops):
    terms = {t["id"]: json.loads(json.dumps(t)) for t in terms}
    gone_ids = {o["other"] for o in ops if o["kind"] == "merge"}
    log, placed, edges, was = [], set(), [], dict(terms)
    for o in sorted(ops, key=lambda o: o["ord"]):
        a, z = was.get(o["id"]), was.get(o["other"])
        ok = a is not None if o["kind"] in ("narrower", "related") else a is not None and z is not None and o["kind"] in ("drop", "edge", "merge")
        if o["kind"] == "merge":
            ok = ok and o["id"] not in gone_ids and a is not z
        log.append((o["kind"], o["id"], o["other"], o["phrase"], ok))
        if not ok:
            continue
        if o["kind"] == "narrower" and o["phrase"] not in a["narrower"]:
            a["narrower"].append(o["phrase"])
        if o["kind"] == "related" and o["phrase"] not in [r["phrase"] for r in a["related"]]:
            a["related"].append({"phrase": o["phrase"], "weight": o["weight"]})
        if o["kind"] in ("narrower", "related"):
            placed.add(o["phrase"])
        if o["kind"] == "drop":
            a["adjacent"] = [x for x in a["adjacent"] if x["term"] != o["other"]]
            z["adjacent"] = [x for x in z["adjacent"] if x["term"] != o["id"]]
        if o["kind"] == "merge":
            a["aliases"] = list(dict.fromkeys(a["aliases"] + z["aliases"]))
            a["from_requirements"] = list(dict.fromkeys(a["from_requirements"] + z["from_requirements"]))
            terms.pop(o["other"], None)
            for t in was.values():
                t["adjacent"] = [x for x in t["adjacent"] if x["term"] != o["other"]]
    for o in ops:
        if o["kind"] == "edge" and o["id"] in terms and o["other"] in terms:
            edges.append((o["id"], o["other"]))
    return terms, [u for u in unmapped if u not in placed], sorted(edges), log


@pytest.mark.parametrize("seed", range(3))
def test_operations_as_by_hand_and_twice_as_once(spark, seed):
    rng = random.Random(seed)
    ids = [f"T{i}" for i in range(12)]
    terms = [term(t, ord=i, aliases=[f"alias {i % 5}", f"own {i}"], narrower=["n0"][: i % 2], adjacent=[{"term": rng.choice(ids), "weight": 0.5} for _ in range(3)], related=[{"phrase": "r0", "weight": 0.3}][: i % 3], from_requirements=[f"need {i % 4}"]) for i, t in enumerate(ids)]
    ops = [{"kind": k, "id": rng.choice(ids + ["NONE"]), "other": rng.choice(ids + ["NONE"]) if k in ("drop", "edge") else None, "phrase": rng.choice(["n0", "n1", "r0", "r1", "odd"]) if k in ("narrower", "related") else None, "weight": round(rng.random(), 2)} for k in rng.choices(["narrower", "related", "drop", "edge"], k=40)]
    ops += [{"kind": "merge", "id": a, "other": z, "phrase": None, "weight": None} for a, z in (("T1", "T2"), ("T1", "T3"), ("T2", "T4"), ("T5", "NONE"), ("NONE", "T6"))] + [{"kind": "what", "id": "T0", "other": "T1", "phrase": "x", "weight": 1.0}]
    rng.shuffle(ops)
    ops = [o | {"ord": i} for i, o in enumerate(ops)]
    draft = spark.createDataFrame([[t[c.split()[0]] for c in ("ord", "id", "canonical", "aliases", "narrower", "adjacent", "related", "from_requirements")] for t in terms], DRAFT)
    unmapped = spark.createDataFrame([("n1", "?"), ("never", "?")], "string string, reason string")
    table = spark.createDataFrame([[o[c] for c in ("kind", "id", "other", "phrase", "weight", "ord")] for o in ops], vocabulary.OPERATIONS)
    got, left, edges, log = vocabulary.apply_operations(draft, unmapped, table, "skill")
    want, want_left, want_edges, want_log = patched_by_hand(terms, ["n1", "never"], ops)
    plain = lambda df: {r["id"]: json.loads(json.dumps(r.asDict(recursive=True))) for r in df.collect()}
    rows = plain(got)
    assert rows == {i: {c: t[c] for c in rows[i]} for i, t in want.items()}
    assert sorted(r["string"] for r in left.collect()) == sorted(want_left)
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == want_edges
    assert [(r["kind"], r["id"], r["other"], r["phrase"], r["applied"]) for r in log.orderBy("ord").collect()] == want_log
    twice, left2, _, _ = vocabulary.apply_operations(got, left, table, "skill")
    assert plain(twice) == rows and left2.count() == left.count()


def test_positions_over_many_files_and_splits(spark, tmp_path):
    rng = random.Random(9)
    want = []
    for f in range(5):
        lines = [(f"id{f}-{i}", "x" * rng.randint(0, 60)) for i in range(rng.choice([0, 1, 4000]))]
        (tmp_path / f"part-{f}.csv").write_text("a,b\n" + "".join(f"{a},{b}\n" for a, b in lines))
        want += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        rows = files.scan_csv(spark, str(tmp_path), ("a", "b"), "at", many_lines=False)
        got = sorted((r["at"], r["a"], r["b"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, a, b) for i, (a, b) in enumerate(want)] and len(got) > 3000
    whole = files.scan_csv(spark, str(tmp_path), ("a", "b"), "at")
    assert sorted((r["at"], r["a"], r["b"]) for r in whole.collect()) == got


def test_links_are_written_and_read_again(spark, tmp_path):
    made = spark.createDataFrame([("A", False, ["prose"], [("T", "skills", "t", "met")], [("list", "why", {"k": "v"})]), ("B", True, [], [], [])], files.LINKS)
    files.write_links(made, f"{tmp_path}/links")
    back = spark.read.schema(files.LINKS).json(f"{tmp_path}/links")
    assert {r["candidate_id"]: (r["partial"], len(r["mentions"]), len(r["rejected"])) for r in back.collect()} == {"A": (True, 1, 1), "B": (False, 0, 0)}


def test_steering_report(spark):
    cases = spark.createDataFrame([("c1", "R", {"a": "dropped"}, None, None, None, False), ("c2", "R", {}, "required", "up", "down", False), ("c3", "R", {}, None, None, None, True), ("c4", "R", {}, None, None, None, False)], evaluation.CASES)
    before = spark.createDataFrame([("R", "a", "required"), ("R", "b", "required")], "role_id string, source string, tier string")
    after = spark.createDataFrame([(c, s, "dropped" if (c, s) == ("c1", "a") else "required") for c in ("c1", "c2", "c3", "c4") for s in "ab"], "case_id string, source string, tier string")
    w = {"required": 80.0}
    runs = spark.createDataFrame([("c1", w, w, 56.0, 56.0, 0), ("c2", w, {"required": 90.0}, 56.0, 40.0, 0), ("c3", w, w, 56.0, 56.0, 0), ("c4", w, w, 56.0, 56.0, 0)], "case_id string, weights_before map<string,double>, weights_after map<string,double>, threshold_before double, threshold_after double, refused int")
    got = {r["case_id"]: (r["passed"], list(r["wrong"])) for r in evaluation.steering_report(cases, before, after, runs).collect()}
    assert got == {"c1": (True, []), "c2": (True, []), "c3": (False, ["nothing was refused"]), "c4": (False, ["nothing is expected"])}


def test_briefs_are_written_a_file_a_role(spark, tmp_path):
    briefs = spark.createDataFrame([("R1", "# R1 — Chef\n\nfirst\n"), ("R2", "# R2 — Baker\n")], "role_id string, markdown string")
    for _ in range(2):  # written again, they replace themselves
        sinks.write_markdown(briefs, f"{tmp_path}/briefs")
    got = {p.name: "".join(f.read_text() for f in p.glob("part-*")) for p in (tmp_path / "briefs").glob("role_id=*")}
    assert got == {"role_id=R1": "# R1 — Chef\n\nfirst\n\n", "role_id=R2": "# R2 — Baker\n\n"}
