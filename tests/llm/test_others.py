"""Chats, embeddings, toxicity, decontamination and the pipeline, against brute force or planted cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import chat, decontamination, embeddings, toxicity

from .conftest import SCHEMA, make_docs, words

CHATS = [
    (1, 0, "user", "hi ### there </turn> \\ \\\\ ####"), (1, 1, "assistant", "one: two\n### User: no"), (2, 0, "user", "hi ### there </turn> \\ \\\\ ####"), (2, 1, "assistant", "other"),
    (3, 0, "user", "hi ### there </turn> \\ \\\\ ####"), (3, 1, "assistant", "one: two\n### User: no"), (3, 2, "user", None), (3, 3, None, "odd"), (4, 1, "sys: tem\\", ""), (4, 0, "assistant", "😀é" * 50),
    (5, 0, "assistant", "x " * 20000), (6, 0, "user", "<</turn></turn>#"), (6, 0, "user", "<</turn></turn>#"), (None, 0, "user", "lost"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit(0)).withColumn("node", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.digest(df).collect()}
    want = {}
    for c, n, role, text in CHATS + [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]:
        want.setdefault(c, []).append((n, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat.head(a) + chat.escape(b) + chat.END) for _, a, b in turns)


def test_chat_tree_shares_nodes_and_attends_to_ancestors(spark):
    df = spark.createDataFrame([c for c in CHATS if c[0] in (1, 2, 3)], "conv_id long, turn long, role string, text string")
    f = chat.format_chats(df)
    nodes = {bytes(r["node"]): r for r in f.nodes.collect()}
    assert len(nodes) == 5  # 2 + 1 + 2 of eight turns
    spans = sorted((r["offset"], r["offset"] + r["n"]) for r in nodes.values())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # every token once, no gap
    line = {}
    for r in f.members.collect():
        line.setdefault(bytes(r["leaf"]), {})[r["depth"]] = bytes(r["node"])
    for path in line.values():
        for depth, name in path.items():
            up = [nodes[path[d]] for d in range(depth)]
            assert [(a["begin"], a["end"]) for a in nodes[name]["attends"]] == [(u["offset"], u["offset"] + u["n"]) for u in up]
            assert nodes[name]["position"] == sum(u["n"] for u in up)
            assert all(u["offset"] < nodes[name]["offset"] for u in up)


def test_chat_with_a_node_on_all_paths(spark):
    """One first turn for all conversations, joined in parts: the same result as in one."""
    made = [(c, n, "user" if n % 2 == 0 else "assistant", "system prompt" if n == 0 else f"text {c % 40} {n}") for c in range(60) for n in range(3)]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    got = [chat.format_chats(df, most=most) for most in (5, 4096)]
    assert got[0].hot.count() == 1 and got[1].hot.count() == 0
    for rows in (lambda x: x.nodes.select("node", "offset", "position", "attends"), chat.read_back):
        a, b = (sorted(map(repr, rows(x).collect())) for x in got)
        assert a == b
    assert got[0].nodes.count() == 1 + 40 * 2 and chat.read_back(got[0]).count() == 60


def test_chat_empty(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_escape_round_trip():
    rng = random.Random(3)
    for _ in range(2000):
        turns = [("".join(rng.choices(r"ab: \#</turn>", k=rng.randint(0, 8))), "".join(rng.choice(["#", "\\", "<", "</turn>", "### ", "x", "\n", ": "]) for _ in range(rng.randint(0, 9)))) for _ in range(3)]
        assert chat.parse("".join(chat.head(r) + chat.escape(t) + chat.END for r, t in turns)) == turns


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    p = embeddings.decode_e8(x)
    assert len(embeddings.ROOTS) == 240 and np.allclose((embeddings.ROOTS**2).sum(axis=1), 2)
    gap = ((x - p) ** 2).sum(axis=1)
    assert all((gap <= ((x - p - r) ** 2).sum(axis=1) + 1e-12).all() for r in embeddings.ROOTS)
    twice = np.rint(p * 2)
    assert np.allclose(twice, p * 2) and ((twice % 2 == 0).all(axis=1) | (twice % 2 == 1).all(axis=1)).all() and (np.rint(p.sum(axis=1)) % 2 == 0).all()


def made_vectors():
    rng = np.random.default_rng(7)
    rows, k = [], 0
    for _ in range(60):
        c = rng.normal(size=64)
        for _ in range(6):
            v = c + rng.normal(size=64) * rng.choice([0.0, 0.1, 0.25, 0.3])
            rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
            k += 1
    rows += [(k + i, rows[0][1], rows[0][2]) for i in range(600)]  # a large group of copies
    k = len(rows)
    rows += [(k, None, 1), (k + 1, [0.0] * 64, 1), (k + 2, [float("nan")] * 64, 1), (k + 3, rows[0][1], None), (k + 4, [], 1), (k + 5, [1.0, 2.0], 1), (k + 6, [2.0, 4.0], 1), (k + 7, [float("inf")] * 64, 1)]
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_embeddings_against_brute_force(spark, block):
    rows = made_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(1)).withColumn("n", F.lit(1))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, block=block).collect()}
    fine = [(i, np.array(v), g) for i, v, g in rows if v and g is not None and np.isfinite(v).all() and np.any(v)]
    links, root = 0, {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    degree = {i: 0 for i, _, _ in rows}
    for x, (i, v, g) in enumerate(fine):
        for j, w, h in fine[:x]:
            if g == h and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                degree[i] += 1
                degree[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(got) == set(degree)
    have = sum(r["n_links"] for r in got.values())
    assert have <= sum(degree.values()) and have >= 0.98 * sum(degree.values())
    assert all(r["n_links"] <= degree[i] for i, r in got.items())
    assert sum(got[i]["component_id"] != find(i) for i in got) <= 0.03 * len(got)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_finds_all_words_within_its_edits():
    terms = [("idiot", False), ("moron", False), ("worthless", False), ("scum", False), ("chlla", True), ("disgusting", False)]
    lexicon = toxicity.Lexicon(terms)
    rng = random.Random(5)
    for _ in range(5000):
        t = rng.choice(terms)[0]
        w = list(t)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "o", "i"])
        w = "".join(w)
        near = [(lev(w, t), t) for t, stem in terms if not stem and lev(w, t) <= toxicity.errors(t, False)]
        m = lexicon.match(w)
        if near:
            assert m == (*min(near), False)
        else:
            assert m == ((0, "chlla", True) if w.startswith("chlla") else None)


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["idiot", "moron", "scum", "worthless"]
    rows, labels = [], []
    for i in range(400):
        w = words(rng, 60)
        toxic = i % 5 == 0
        if toxic:
            for b in rng.sample(bad, 3):
                w.insert(rng.randrange(len(w)), b)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, " ".join(words(rng, 30) + ["idoit", "morron", "worthles", "scum"])), (1003, " ".join(words(rng, 20000)))]
    labels += [(None, 1, 1), (2000, 1, None), (3, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(3)).withColumn("exact", F.lit(3))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.digest(docs, table).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    wrong = [i for i in range(400) if got[i]["predicted"] != int(i % 5 == 0)]
    assert len(wrong) <= 4 and all(i % 5 for i in wrong)  # a syllable word may lie near a term
    assert got[1002]["predicted"] == 1  # one term and two misspelled ones
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0
    kept = toxicity.score(docs, toxicity.train(docs, table), [], only_clean=True)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_tells_quotation_from_abuse(spark):
    """The same terms, in clean rows as often as in toxic ones, but there in quotation marks or after a verb of reporting."""
    rng = random.Random(21)
    bad = ["idiot", "moron", "scum", "worthless"]
    rows, labels = [], []
    for i in range(600):
        w = words(rng, 60)
        for b in rng.sample(bad, 3) if i % 3 else []:
            at = rng.randrange(len(w))
            w[at:at] = [b] if i % 3 == 1 else [f'"{b}"'] if i % 2 else ["said", b]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.digest(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    wrong = [i for i in held if got[i]["predicted"] != int(i % 3 == 1)]
    assert len(held) > 90 and len(wrong) <= len(held) // 20


def test_apostrophes_are_no_quotation_marks():
    tokens = toxicity.TOKENS.findall("don't be an idiot, it's ’late’ l'idiot")
    assert [t for t in tokens if t in toxicity.QUOTES] == ["’", "’"] and tokens.count("idiot") == 2
    assert not toxicity.quoted_at(tokens, tokens.index("idiot"))
    tokens = toxicity.TOKENS.findall("they called him 'an idiot' today")
    assert toxicity.quoted_at(tokens, tokens.index("idiot"))


def test_toxicity_counts_terms_in_bounded_parts(monkeypatch):
    """A task hands its counts on before they are many, whatever its texts hold; the sums are those of one part."""
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(words(rng, 50) + [f"idiot{'abcdefgh'[i % 8]}"]) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([int(i % 7 == 0) for i in range(300)], pa.int32())], names=["text", "toxic"])

    def counts(held):
        monkeypatch.setattr(toxicity, "HELD", held, raising=False)
        parts, every = list(toxicity._frequencies(batch.slice(i, 10) for i in range(0, 300, 10))), {}
        for r in (r for p in parts for r in p.to_pylist()):
            c = every.setdefault((r["term"], r["stem"]), [0, 0, 0])
            c[0], c[1], c[2] = c[0] + r["clean"], c[1] + r["toxic"], c[2] | r["slots"]
        return parts, every

    (whole,), every = counts(10**6)
    parts, same = counts(500)
    assert same == every and whole.num_rows > 3000
    assert len(parts) > 3 and max(p.num_rows for p in parts) < 500 + 10 * 51 * 4


def test_toxicity_without_labels(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(make_docs(), SCHEMA)
    assert {r["score"] for r in toxicity.digest(docs, none).collect()} == {0.0}
    assert toxicity.digest(empty, none).count() == 0


def test_running_sums_of_signed_bits():
    """Four bits summed at a time, up to the longest piece and beyond it, are the sums of each bit, also of the heaviest words alone."""
    rng = np.random.default_rng(8)
    for n in (0, 1, 50, decontamination.PIECE, decontamination.PIECE + 1):
        for signed in (rng.integers(-8, 9, (n, 64)), np.full((n, 64), 8), np.full((n, 64), -8)):
            run = decontamination.sums((signed + 8).astype(np.uint16))
            want = np.concatenate([np.zeros((1, 64), dtype=int), np.cumsum(signed, axis=0)])
            assert (run == want).all()
            for size in (1, 12, 58):
                if n >= size:
                    assert (decontamination.prints(run, size) == np.packbits(((want[size:] - want[:-size]) > 0).ravel()).view(np.uint16).reshape(-1, 4)).all()
    texts = [f"word{i % 700} of some{i % 31} kind" for i in range(4000)]
    scanner = decontamination.Scanner(decontamination.Index([(1, " ".join(texts[90:100]))]), words=100)  # its table is filled anew, and passed by for longer texts
    assert scanner.scan(" ".join(texts[:2000]))[1] == (1.0, 360) and scanner.scan(" ".join(texts[85:105]))[1] == (1.0, 20)
    with_table = decontamination.Scanner(decontamination.Index([(1, " ".join(texts[90:100]))]))
    assert with_table.scan(" ".join(texts[:2000])) == scanner.scan(" ".join(texts[:2000]))


def test_decontamination(spark):
    rng = random.Random(11)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([3, 7, 15, 22, 40, 60, 90])] + [(90, None), (91, ""), (None, "x y z")]
    plain = [(i, " ".join(words(rng, 200))) for i in range(30)]
    planted = {}
    rows = list(plain)
    for k, t in items[:7]:
        w = words(rng, 50)
        w[20:20] = re.sub("^.", lambda m: m[0].upper(), t).split()
        rows.append((100 + k, " ".join(w)))
        planted[100 + k] = k
        if len(t.split()) >= 60:
            v = t.split()
            v[len(v) // 2] = "edited"
            rows.append((200 + k, " ".join(words(rng, 30) + v + words(rng, 30))))
            planted[200 + k] = k
    rows += [(300, None), (301, ""), (302, " ".join(words(rng, 40_000)) + " " + items[4][1]), (303, items[5][1]), (303, items[5][1])]
    planted |= {302: 4, 303: 5}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (100, 3):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.find(docs, bench, most_items=most).collect()}
        assert set(planted.items()) <= got
        assert all(i >= 100 or k < 2 for i, k in got)  # clean documents hold none of the longer items
    index = decontamination.Index([(k, t) for k, t in items if k is not None and t])
    for i, t in rows:  # what is reported is what the similarity says
        for k, (s, at) in decontamination.Scanner(index).scan(t).items():
            w, own = decontamination.words_of(t), decontamination.words_of(dict(items)[k])
            assert abs(decontamination.similarity(decontamination.shingles(own), decontamination.shingles(w[at : at + len(own)])) - s) < 0.35 and s >= 0.8
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns
    assert not {r["doc_id"] for r in left.select("doc_id").collect()} & set(planted)
    assert decontamination.find(docs.limit(0), bench).count() == 0 and decontamination.find(docs, bench.limit(0)).count() == 0


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(3)
    index = decontamination.Index([(k, " ".join(f"word{k}x{i}" for i in range(40))) for k in range(50)])
    tables = next(iter(index.classes.values()))
    for _ in range(500):
        k, v = int(rng.integers(len(tables.prints))), 0
        for b in rng.choice(64, rng.integers(0, decontamination.RADIUS + 1), replace=False):
            v |= 1 << int(b)
        got = (tables.prints[k : k + 1] ^ np.uint64(v)).view(np.uint16).reshape(1, 4)
        assert k in tables.near(got)[1]


def test_windows_are_sized_by_their_item():
    for n in [*range(1, 1400), 5000, 5001, 100_000]:
        every = decontamination.windows_of(n)
        sizes = sorted({size for size, _ in every})
        assert 0.68 * n <= sizes[-1] <= n and all((size, at) in every for size in sizes for at in (0, n - size))
        assert n < 9 or sizes[0] <= 0.8 * n


def test_repeated_item_ids_and_long_items(spark):
    """Rows of one id with different texts are found by any of them; windows of thousands of words are exact."""
    rng = random.Random(12)
    one, two, long = (" ".join(words(rng, n)) for n in (30, 40, 6000))
    bench = spark.createDataFrame([(1, one), (1, two), (1, one), (2, long)], "item_id long, text string")
    cut = " ".join(long.split()[300:])
    docs = [(1, one), (2, two), (3, "other words " + one), (4, long), (5, cut), (6, " ".join(long.split()[:3000])), (7, " ".join(words(rng, 500)))]
    docs += [(1, one), (None, two)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontamination.find(df, bench).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (None, 1)], key=str)
    assert sorted(r["doc_id"] for r in decontamination.clean(df, bench).collect()) == [6, 7]


@pytest.mark.parametrize("edge", ["cut begin", "cut end", "whole, cut begin", "whole, cut end", "whole, cut both", "whole"])
def test_decontamination_recall_at_the_edges_of_texts(spark, edge):
    """Items cut where a text begins or ends, or that are the whole text, some edited: through find(), against laying every
    place of the text on the item; for each kind of edit."""
    rng = random.Random(edge)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([9, 12, 15, 18, 22, 26, 30, 35, 42, 50, 58, 70, 80, 95, 112, 130, 156, 190, 218, 250])]
    rows, there = [], {}
    for edit in ("none", "changed", "dropped", "added", "swapped"):
        for k, t in items:
            for share in (0, 0.02, 0.05, 0.08, 0.12, 0.15):
                w = t.split()
                cut = max(1, round(share * len(w))) if edge != "whole" else 0
                begin = cut if "begin" in edge else cut // 2 if "both" in edge else 0
                end = cut if "end" in edge else cut - cut // 2 if "both" in edge else 0
                w = w[begin : len(w) - end]
                if edit != "none":
                    at = rng.randrange(1, len(w))
                    w[at - 1 : at + 1] = {"changed": [w[at - 1], "zq"], "dropped": [w[at - 1]], "added": [w[at - 1], "zq", w[at]], "swapped": [w[at], w[at - 1]]}[edit]
                text = w + words(rng, 60) if edge == "cut begin" else words(rng, 60) + w if edge == "cut end" else w
                own, n = decontamination.shingles(t.lower().split()), len(t.split())
                if max(decontamination.similarity(own, decontamination.shingles(text[max(0, s) : max(0, s + n)])) for s in range(-n // 4, max(2, len(text) - n // 2))) >= 0.8:
                    there.setdefault(edit, set()).add((len(rows), k))
                rows.append((len(rows), k, " ".join(text)))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for edit, want in there.items():
        assert len(want) > 20 and len(found & want) >= 0.9 * len(want), (edit, len(found & want), len(want))
    assert found <= {(i, k) for i, k, _ in rows}


@pytest.mark.parametrize("kind", ["copy", "changed", "dropped", "added", "swapped"])
def test_decontamination_recall_against_brute_force(kind):
    """Items edited in texts, of all edits that leave a similarity of 0.8 somewhere: found at least nine times in ten."""
    rng = random.Random(kind)
    items = [(k, " ".join(words(rng, rng.randint(12, 220)))) for k in range(60)]
    scanner = decontamination.Scanner(decontamination.Index(items))
    there = found = 0
    for k, t in items:
        for _ in range(4):
            w = t.split()
            for _ in range(max(1, len(w) // 60)):
                at = rng.randrange(len(w))
                if kind == "changed":
                    w[at] = words(rng, 1)[0]
                elif kind == "dropped":
                    del w[at]
                elif kind == "added":
                    w.insert(at, words(rng, 1)[0])
                elif kind == "swapped" and at:
                    w[at - 1], w[at] = w[at], w[at - 1]
            n, text = len(t.split()), words(rng, 40) + w + words(rng, 40)
            own = decontamination.shingles(decontamination.words_of(t))
            if max(decontamination.similarity(own, decontamination.shingles(text[s : s + n])) for s in range(30, 52)) >= 0.8:
                there += 1
                found += k in scanner.scan(" ".join(text))
    assert there > 60 and found >= 0.9 * there, (found, there)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, cols = docs.count(), docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == cols, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 3:
            assert 0.7 * n <= docs.count() <= n
            n = docs.count()
    assert docs.count() > 0 and {"doc_id", "shard", "slot"} <= set(docs.columns)
