"""The matching engine on a small fixture: evidence, routes, scores, selection, explanation, evaluation, sinks, session."""

import json

import pytest
from pyspark.sql import functions as F

from matchloom.operators import evaluation, ingest, linking, matching, requests, rubric, selection, session, sinks, vocabulary
from matchloom.sources import files

TERM = "pillar string, term_id string, ord int, label string, surfaces array<string>, related array<struct<phrase:string,weight:double>>, from_requirements array<string>"
EDGE = "pillar string, src string, dst string, kind string, weight double, ord int"


@pytest.fixture(scope="module")
def world(spark):
    terms = [
        ("skill", "DOCKER", 0, "Docker", ["Docker"], [("wrote a Dockerfile", 0.7)], ["Docker"]), ("skill", "KUBERNETES", 1, "Kubernetes", ["Kubernetes", "K8s"], [], ["Kubernetes"]),
        ("skill", "CI_CD", 2, "CI/CD", ["CI/CD", "Jenkins"], [], ["CI/CD"]), ("skill", "TERRAFORM", 3, "Terraform", ["Terraform"], [], ["Terraform"]), ("skill", "SQL", 4, "SQL", ["SQL"], [], ["SQL"]),
        ("skill", "POSTGRESQL", 5, "PostgreSQL", ["PostgreSQL"], [], []), ("occupation", "BACKEND", 6, "Backend", ["Backend Engineer"], [("Software Engineer", 0.7)], []), ("occupation", "DEVOPS", 7, "DevOps", ["DevOps Engineer"], [], []),
    ]
    edges = [("skill", "DOCKER", "KUBERNETES", "adjacent", 0.6, 0), ("occupation", "BACKEND", "DEVOPS", "adjacent", 0.6, 1), ("skill", "POSTGRESQL", "SQL", "narrower", 1.0, 2)]
    roles = [("R008", "DevOps Engineer", ["CI/CD", "Docker", "Kubernetes"], ["Terraform", "SQL"], 4, 7, "Riyadh")]
    t, e = spark.createDataFrame(terms, TERM), spark.createDataFrame(edges, EDGE)
    r = spark.createDataFrame(roles, "role_id string, title string, required array<string>, nice array<string>, exp_min int, exp_max int, location string")
    return {"terms": t, "edges": e, "roles": r, "surface": vocabulary.surfaces(t), "req": rubric.compile_rubrics(r, t)}


MENTION = "candidate_id string, term_id string, field string, phrase string, relation string, ord int"


def test_have_terms(spark, world):
    rows = [("A", "DOCKER", "certifications", "docker cert", "adjacent", 0), ("B", "DOCKER", "skills", "wrote a Dockerfile", "met", 0), ("C", "SQL", "skills", "SQL", "met", 1), ("C", "SQL", "projects", "used SQL", "met", 0)]
    got = {(r["candidate_id"], r["term_id"]): r for r in matching.have_terms(spark.createDataFrame(rows, MENTION), world["surface"]).collect()}
    assert got["A", "DOCKER"]["v"] == 0.45 and got["B", "DOCKER"]["v"] == 0.7
    assert got["C", "SQL"]["phrase"] == "used SQL" and got["C", "SQL"]["have_ord"] == 0


def scores(spark, world, rows, req=None):
    have = matching.have_terms(spark.createDataFrame(rows, MENTION), world["surface"])
    req = world["req"] if req is None else req
    return matching.skill_scores(matching.term_routes(have, matching.routes(world["edges"], world["terms"]), req))


def test_routes(spark, world):
    got = {(r["candidate_id"], r["req_pos"]): r for r in scores(spark, world, [("A", "DOCKER", "skills", "Docker", "met", 0), ("B", "POSTGRESQL", "headline", "PostgreSQL", "met", 0)]).collect()}
    assert got["A", 1]["via"] == "direct" and got["A", 1]["score"] == 1.0
    assert ("A", 2) not in got  # Docker is another requirement of the role, so it cannot stand for Kubernetes
    assert got["B", 4]["via"] == "narrower" and got["B", 4]["score"] == 0.9
    free = world["req"].withColumn("blocked", F.array().cast("array<string>"))
    got = {(r["candidate_id"], r["req_pos"]): r for r in scores(spark, world, [("A", "DOCKER", "skills", "Docker", "met", 0)], free).collect()}
    assert got["A", 2]["via"] == "adjacent" and got["A", 2]["score"] == 0.6


def test_direct_goes_before_a_better_adjacent_route(spark, world):
    free = world["req"].withColumn("blocked", F.array().cast("array<string>"))
    rows = [("A", "KUBERNETES", "extra_curriculars", "k8s", "adjacent", 0), ("A", "DOCKER", "skills", "Docker", "met", 1)]
    got = {r["req_pos"]: r for r in scores(spark, world, rows, free).collect()}
    assert got[2]["via"] == "direct" and got[2]["score"] == 0.36


def full_match(spark, world):
    people = spark.createDataFrame([("C1", "Riyadh", "Saudi Arabia", 0, 5.0, "h", None, "-", "x", "", "y"), ("C2", "Cairo", "Egypt", 45, None, "h2", "45 days", "a", "b", "c", "d")], "candidate_id string, city string, country string, notice_days int, stated_years double, headline string, notice_raw string, projects string, extra_curriculars string, education string, certifications string")
    past = spark.createDataFrame([("C1", 0, "DevOps Engineer", 3.0), ("C1", 1, "Software Engineer", 5.0), ("C2", 0, "Chef", 9.0)], "candidate_id string, pos int, title string, duration_years double")
    own = linking.resolve_occupations(past, "title", world["surface"])
    years = matching.relevant_years(own, matching.role_occupations(world["roles"], world["surface"]), vocabulary.mirrored(world["edges"]))
    exp = matching.experience_scores(people, world["req"], years, matching.experience_trace(own))
    skill = scores(spark, world, [("C1", "DOCKER", "skills", "Docker", "met", 0), ("C1", "CI_CD", "skills", "Jenkins", "met", 1)])
    places = matching.location_scores(people, world["roles"])
    rub = rubric.rubrics(world["roles"])
    return people, own, exp, skill, places, rub, matching.match_scores(skill, exp, places, world["req"], rub)


def test_match_scores_and_briefs(spark, world):
    people, own, exp, skill, places, rub, match = full_match(spark, world)
    e = {r["candidate_id"]: r for r in exp.collect()}
    assert e["C1"]["implied_years"] == 3.0 + round(5.0 * 0.7 * 0.6, 2) and e["C1"]["trace"] == "DevOps Engineer 3y x1.00; Software Engineer 5y x0.70"
    assert e["C2"]["implied_years"] == 0.0 and e["C2"]["conflict"] and e["C2"]["trace"] == "no relevant role"
    m = {r["candidate_id"]: r for r in match.collect()}
    assert m["C1"]["required_component"] == 60.0 and m["C1"]["total"] == 70.0  # (1 + 1 + 0 + 1) / 4 of 80, 0 of 10, 5, 5
    assert m["C2"]["total"] == 2.5
    fin = selection.shortlist(match, rub)
    assert [(r["candidate_id"], r["fallback"]) for r in fin.collect()] == [("C1", False)]
    high = selection.shortlist(match, rubric.rubrics(world["roles"], threshold=90.0))
    assert sorted((r["candidate_id"], r["rank"], r["fallback"]) for r in high.collect()) == [("C1", 1, True), ("C2", 2, True)]
    every = matching.with_absent(skill, people, world["req"])
    gap = selection.gaps(every, people, match)
    kinds = [r["kind"] for r in gap.where("candidate_id = 'C1'").orderBy("place").collect()]
    assert kinds == ["absent_required", "absent_preferred", "absent_preferred", "empty_field"]
    lines = selection.brief_lines(fin, selection.strengths(every), gap, exp, people)
    text = selection.render_briefs(lines, world["roles"], rub).first()["markdown"]
    assert text.startswith("# R008 — DevOps Engineer\n\n## C1 — 70\n\n_h_\n")
    assert '**Strengths**\n- CI/CD — direct, from skills ("Jenkins")\n- Docker — direct, from skills ("Docker")\n' in text
    assert "**Relevant experience:** 5.1y\n" in text and '1. "Kubernetes" (required) — no evidence in the profile\n' in text
    assert text.endswith("---\n")
    payload = json.loads(sinks.chat_messages(lines, world["roles"]).first()["payload"])
    assert payload["text"].endswith(": 1 finalists") and payload["attachments"][0]["title"] == "C1, h"
    assert "C1, 70 points: CI/CD, Docker" in payload["blocks"][0]["text"]["text"]
    asks = requests.brief_requests(lines, gap, world["roles"], {"user": "{role_title}|{candidates}"}).first()["user"]
    assert asks.startswith("DevOps Engineer|candidate C1\n- CI/CD: Jenkins") and "[absent_required]" in asks
    note = selection.render_briefs(selection.brief_lines(high, selection.strengths(every), gap, exp, people), world["roles"], rubric.rubrics(world["roles"], threshold=90.0)).first()["markdown"]
    assert "_No candidate cleared the shortlist threshold of 90. Showing the highest-scoring 2 instead" in note


def test_shortlist_keeps_as_many_as_a_rubric_returns(spark):
    scores = spark.createDataFrame([(role, i, float(i)) for role in "ab" for i in range(100)], "role_id string, candidate_id long, total double")
    rubric = spark.createDataFrame([("a", 10.0, 70), ("b", 10.0, 3)], "role_id string, threshold double, most int")
    got = selection.shortlist(scores, rubric).select("role_id", "candidate_id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted([("a", 99 - k, k + 1) for k in range(70)] + [("b", 99 - k, k + 1) for k in range(3)])
    assert selection.excluded(scores, selection.shortlist(scores, rubric)).count() == 127
    assert selection.assessments(scores, [1, 2]).count() == 4 and selection.assessments(scores, scores.select("candidate_id").limit(3)).count() == 6


def test_steering(spark, world):
    rub = rubric.rubrics(world["roles"])
    retier = spark.createDataFrame([("R008", "Docker", "dropped", 0), ("R008", "Docker", "preferred", 1)], "role_id string, source string, tier string, ord int")
    after, r = rubric.apply_steering(world["req"], rub, retier, {"required": 70, "preferred": 10, "availability": 15, "location": 5}, 50.0)
    cases = [("fine", "R008", {"Docker": "preferred"}, None, None, None, False), ("other", "R008", {"Kubernetes": "preferred"}, None, None, None, False), ("missing", "R008", {"COBOL": "preferred"}, None, None, None, False), ("empty", "R008", {}, None, None, None, False), ("weight", "R008", {}, "availability", "up", "down", False), ("way", "R008", {}, "availability", "down", None, False), ("refusal", "R008", {}, None, None, None, True)]
    runs = spark.createDataFrame([(c[0], {"availability": 5.0}, {"availability": 15.0}, 56.0, 50.0, 0) for c in cases], "case_id string, weights_before map<string,double>, weights_after map<string,double>, threshold_before double, threshold_after double, refused int")
    table = spark.createDataFrame(cases, evaluation.CASES)
    got = {r["case_id"]: r for r in evaluation.steering_report(table, world["req"], table.select("case_id").join(after.select("source", "tier")), runs).collect()}
    assert {k for k, r in got.items() if r["passed"]} == {"fine", "weight"} and len(got) == len(cases)
    assert "COBOL is missing" in got["missing"]["wrong"] and "Kubernetes is required" in got["other"]["wrong"]
    assert r.first()["threshold"] == 50.0
    with pytest.raises(ValueError):
        rubric.rubrics(world["roles"], {"required": 90, "preferred": 10, "availability": 5, "location": 5})
    key = rubric.assessment_key(world["req"].collect())
    assert key != rubric.assessment_key(after.collect()) and len(key) == 16


def test_baseline_demotion(spark, world):
    roles = spark.createDataFrame([("R1", "X", ["Problem-Solving", "Docker"], ["teamwork"], 1, 2, "")], world["roles"].schema)
    got = [(r["tier"], r["baseline_demoted"], r["verifiable"]) for r in rubric.compile_rubrics(roles, world["terms"]).orderBy("req_pos").collect()]
    assert got == [("preferred", True, False), ("required", False, True), ("preferred", False, False), ("required", False, True)]


def test_vocabulary_checks(spark, world, tmp_path):
    closed = spark.createDataFrame([("skill", "A", "B", "narrower", 1.0, 0), ("skill", "B", "C", "narrower", 1.0, 1), ("skill", "C", "A", "narrower", 1.0, 2)], EDGE)
    assert vocabulary.narrower_closure(closed).count() == 9
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert vocabulary.validation_errors(world["terms"], world["edges"]).count() == 0
    with pytest.raises(Exception, match="weight"):
        vocabulary.checked_edges(spark.createDataFrame([("skill", "A", "B", "adjacent", 1.5, 0)], EDGE)).collect()


def test_vocabulary_files(spark, world, tmp_path):
    path = f"{tmp_path}/v.json"
    files.write_vocabulary("1", world["terms"], world["edges"], path)
    version, terms, edges = files.read_vocabulary(spark, path)
    assert version == "1"
    assert sorted(map(str, terms.select(*world["terms"].columns).collect())) == sorted(map(str, world["terms"].collect()))
    assert sorted(edges.select("src", "dst", "weight").collect()) == sorted(world["edges"].select("src", "dst", "weight").collect())
    files.store_vocabulary(terms, edges, f"{tmp_path}/store")
    surface, back = files.load_vocabulary(spark, f"{tmp_path}/store")
    assert back.count() == 3 and surface.where("kind = 'related'").count() == 2
    bad = spark.createDataFrame([("skill", "DOCKER", "NOWHERE", "adjacent", 0.5, 0)], EDGE)
    with pytest.raises(ValueError):
        files.store_vocabulary(terms, bad, f"{tmp_path}/bad")


def test_load_candidates(spark, tmp_path):
    head = ",".join(files.CANDIDATE_COLUMNS)
    row = 'C1,h,"SQL, Docker",7,"Dev, X (Doha) — 2022–Present: a",,-,p,,"Cairo, Egypt",1 month'
    (tmp_path / "c.csv").write_text("\n".join([head, row, row.replace("C1", "C2"), row.replace("C1", " "), row.replace("C1", "C3").replace(",7,", ",five years,")]) + "\n")
    got = ingest.load_candidates(files.scan_candidates(spark, str(tmp_path / "c.csv")), "2026-08-19")
    assert sorted(r["candidate_id"] for r in got["candidates"].collect()) == ["C1", "C3"]
    assert got["quarantine"].first()["reason"] == "blank candidate_id"
    assert [(r["kept_id"], r["dropped_ids"]) for r in got["duplicates"].collect()] == [("C1", ["C2"])]
    assert sorted(r["candidate_id"] for r in got["conflicts"].collect()) == ["C1", "C3"]
    (tmp_path / "r.csv").write_text(",".join(files.ROLE_COLUMNS) + '\nR1,T,D,"a, b",-,3-6 years,S,Doha\n')
    r = ingest.parse_roles(files.scan_roles(spark, str(tmp_path / "r.csv"))).first()
    assert (r["required"], r["nice"], r["exp_min"], r["exp_max"]) == (["a", "b"], [], 3, 6)


def test_linking(spark, world):
    rows = [("C1", "skills", "docker, Wrote a Dockerfile, cooking"), ("C1", "projects", "I wrote a dockerfile once")]
    fields = spark.createDataFrame(rows, "candidate_id string, field string, text string")
    got = sorted((r["field"], r["phrase"], r["term_id"], r["relation"]) for r in linking.link_fields(fields, "candidate_id", world["surface"]).collect())
    assert got == [("projects", "wrote a Dockerfile", "DOCKER", "adjacent"), ("skills", "Wrote a Dockerfile", "DOCKER", "adjacent"), ("skills", "docker", "DOCKER", "met")]
    claims = spark.createDataFrame([("C1", "projects", "prose", "DOCKERFILE"), ("C1", "skills", "prose", "docker"), ("C1", "projects", "prose", ""), ("C1", "projects", "prose", "helm")], "candidate_id string, field string, group string, phrase string")
    good, bad = linking.ground(claims, fields, "candidate_id")
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["empty phrase", "field not of this group", "phrase not in the field"]


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("R", f"C{k:03d}", 100.0 - k) for k in range(20)], "g string, id string, total double")
    grades = spark.createDataFrame([("R", "C000", 3), ("R", "C002", 1), ("R", "C004", 2), ("R", "C010", 3)], "g string, id string, grade int")
    assert abs(evaluation.precision_at_k(ranked, grades, "g", "total", "id", 5).first()["precision"] - 2 / 3) < 1e-12
    none = grades.limit(0)
    assert evaluation.precision_at_k(ranked, none, "g", "total", "id", 5).first()["precision"] == 0.0
    assert evaluation.ndcg_at_k(ranked, none, "g", "total", "id", 10).first()["ndcg"] == 1.0
    perfect = spark.createDataFrame([("R", f"C{k:03d}", 3 - k) for k in range(4)], "g string, id string, grade int")
    assert evaluation.ndcg_at_k(ranked, perfect, "g", "total", "id", 10).first()["ndcg"] == 1.0
    assert sorted(r["rank"] for r in evaluation.sample_across(ranked, "g", "total", "id", 5).collect()) == [0, 5, 10, 14, 19]
    assert evaluation.regressions({"precision": 0.9, "recall": 1.0, "inconsistent": 1}, {"precision": 1.0, "recall": 1.0, "inconsistent": 0}) != []


def test_session(tmp_path):
    sent = []
    s = session.Session(lambda r, g: {"role": r, "guidance": g}, lambda r: [1], lambda x, note: f"# {x}{note or ''}", lambda q, st: f"re {q}", lambda m: sent.append(m) or "ok", tmp_path / "s.json")
    state = s.start("R1")
    state = s.resume(state, session.parse_command("amend: less docker"))
    state = s.resume(state, session.parse_command("amend: more sql"))
    assert state["rubric"]["guidance"] == "less docker\nmore sql" and state["gate"] == session.RUBRIC_GATE
    state = s.resume(state, session.parse_command("ask: why"))
    assert state["answer"] == "re why" and not sent
    state = s.resume(s.load(), session.resume_payload("approve"))
    assert state["gate"] == session.SUMMARY_GATE and not sent
    state = s.resume(state, session.resume_payload("edit", "!"))
    assert state["markdown"] == "# [1]!"
    done = s.resume(state, session.resume_payload("approve"))
    assert sent == ["# [1]!"] and done["gate"] == session.DONE
    assert s.switch(done, "R2")["calls"] == done["calls"] + 1
    with pytest.raises(session.CallBudgetExceeded):
        s.start("R1", calls=40)
    with pytest.raises(ValueError):
        session.resume_payload("maybe")


def test_requests_and_replies(spark, world):
    fields = spark.createDataFrame([("A", "skills", "Docker, Jenkins"), ("A", "projects", "wrote a Dockerfile"), ("B", "headline", "hi")], "id string, field string, text string")
    asked = requests.extraction_requests(fields, "id", world["terms"], {"system": "s", "user": "{candidate_id}/{group_label}/{profile_lines}/{vocabulary_block}"})
    got = {(r["id"], r["group"]): r for r in asked.collect()}
    assert set(got) == {("A", "list"), ("A", "prose"), ("B", "list")}
    assert got["A", "prose"]["user"].startswith("A/prose/projects: wrote a Dockerfile/CI_CD | surfaces: CI/CD, Jenkins\n") and "related: wrote a Dockerfile(0.7)" in got["B", "list"]["user"]

    def answer(system, user):
        if user.startswith("B"):
            raise RuntimeError("down")
        one = {"term": "DOCKER", "field": "skills", "phrase": "docker", "relation": "met"}
        return json.dumps({"mentions": [one, one | {"phrase": "Ansible"}] if "/list/" in user else []})

    kept, rejected, results = requests.linked_replies(requests.answered(asked, ["id", "group"], answer), fields, "id")
    assert [(r["id"], r["term_id"]) for r in kept.collect()] == [("A", "DOCKER")]
    assert [r["reason"] for r in rejected.collect()] == ["phrase not in the field"]
    assert {(r["id"], r["partial"], tuple(r["failed_groups"]), r["n_mentions"], r["n_rejected"]) for r in results.collect()} == {("A", False, (), 1, 1), ("B", True, ("list",), 0, 0)}
    golden = linking.golden_links(fields, "id", world["surface"])
    assert {(r["id"], r["field"], r["text"], r["expected"]) for r in golden.collect()} == {("A", "skills", "Docker", "DOCKER"), ("A", "skills", "Jenkins", "CI_CD"), ("A", "projects", "wrote a Dockerfile", "DOCKER")}
    assert [r["text"] for r in linking.unlinked(golden, kept, "id").collect()] == ["Jenkins"]
    guided = requests.steering_requests(spark.createDataFrame([("R008", "more SQL")], "role_id string, text string"), world["roles"], world["req"], {"user": "{role_title}: {guidance}\n{requirements}"}).first()
    assert guided["user"].startswith("DevOps Engineer: more SQL\n- CI/CD (required)") and "Terraform" in guided["sources"]
    drafted = requests.drafting_requests("skill", fields.select("text"), fields.select("text"), {"user": "{pillar}\n{requirement_strings}"}).first()["user"]
    assert drafted.startswith("skill\n- Docker, Jenkins")
    asked = requests.answer_requests(spark.createDataFrame([("R1", "why?")], "role_id string, question string"), spark.createDataFrame([("R1", "C", "C total=1.0")], "role_id string, candidate_id string, text string"), {"user": "{question} {results}"})
    assert asked.first()["user"] == "why? C total=1.0"


def test_prompts_settings_and_webhook(tmp_path):
    text = "# x\n## System\nbe kind\n## User\nhi\n## Schema\n```json\n{\"a\": 1}\n```\n"
    parts = files.prompt_sections(text)
    assert parts["system"] == "be kind" and files.fenced_json(parts["schema"]) == {"a": 1}
    (tmp_path / ".env").write_text("# c\nREFERENCE_DATE='2026-08-19'\nOTHER=1\n")
    assert files.read_settings(tmp_path / ".env", {"OTHER": "2", "ELSE": "3"}) == {"REFERENCE_DATE": "2026-08-19", "OTHER": "2"}
    with pytest.raises(ValueError):
        files.read_settings(tmp_path / ".env", {}, ("KEY",))
    got = []
    client = sinks.WebhookClient("u", lambda u, b: got.append(json.loads(b)) or (200, "ok"))
    assert client.post("plain") == "ok" and got == [{"text": "plain"}]
    with pytest.raises(RuntimeError):
        sinks.WebhookClient("u", lambda u, b: (500, "no")).post("plain")


def test_links_and_stream(spark, world, tmp_path):
    doc = [{"candidate_id": "A", "partial": False, "failed_groups": [], "mentions": [{"term": "DOCKER", "field": "skills", "phrase": "Docker", "relation": "met"}]}]
    (tmp_path / "l.json").write_text(json.dumps(doc))
    m = files.mentions_of(files.read_links(spark, str(tmp_path / "l.json")))
    assert m.count() == 1
    from matchloom.streaming.scoring import score_arrivals

    m.write.parquet(f"{tmp_path}/in")
    q = score_arrivals(spark.readStream.schema(m.schema).parquet(f"{tmp_path}/in"), matching.routes(world["edges"], world["terms"]), world["req"], f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
