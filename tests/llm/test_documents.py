"""The document operators against brute force over a small table with every odd case, and over an empty one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from matchloom.llm import langid, mixing, ngram_join, pii, sharding, substring_dedup

from matchloom.llm.words import word_hashes

from .conftest import make_docs

TEXTS = {r[0]: r[1] for r in make_docs()}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, key="doc_id"):
    got = [r.asDict() for r in df.collect()]
    assert len(got) == len(TEXTS)
    return {r[key]: r for r in got}


def smallest(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_ngram_join(docs):
    sets = {}
    for i, t in TEXTS.items():
        w = WORD.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = smallest(ids, links)
    for small in (ngram_join.SMALL, 2):  # with short lists only, and through leaders and blocks
        got = rows(ngram_join.join(docs, small, 1 << 20 if small > 2 else 3000))
        assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
        assert {i: r["component_id"] for i, r in got.items()} == root


def test_pairs_of_a_short_list_end_at_their_sketches():
    """Sets of one list that share little give no pairs, those that link all do, whatever their sizes."""
    import numpy as np
    import pyarrow as pa

    rng, sets = np.random.default_rng(12), []
    for n in (5, 60, 300, 500, 510, 515, 3000):
        for _ in range(8):
            s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            less = s[rng.random(len(s)) > 0.1]
            sets += [s, less, np.unique(np.concatenate([less, rng.integers(0, 2**63, len(s) // 12).astype(np.uint64)]))]
    sets = [s for s in sets if len(s)]
    sigs = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([ngram_join.signature(s) for s in sets], pa.binary())], names=["a", "sig"])
    (sketched,) = ngram_join._sketches([sigs])
    m = len(sets)
    cols = [np.zeros(m, dtype=np.int64), np.arange(m), np.array([len(s) for s in sets], dtype=np.int32), np.zeros(m, dtype=np.int32), np.arange(m), np.full(m, np.nan)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), sketched.column(1)], names=["key", "a", "n", "p", "component", "sim", "sketch"])
    got = {tuple(r.values()) for b in ngram_join._open_pairs([batch.slice(0, 50), batch.slice(50)]) for r in b.to_pylist()}
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    linked = {(i, j) for i in range(m) for j in range(i + 1, m) if 100 * (c := both(i, j)) >= 80 * (len(sets[i]) + len(sets[j]) - c)}
    assert len(linked) > 60 and linked <= got
    apart = [(i, j) for i, j in got if i // 3 != j // 3 and 60 <= min(len(sets[i]), len(sets[j])) < 1000]
    assert not apart  # of over a thousand pairs whose sizes would do


def passages_and_copies(spark, tasks=12):
    """(documents, texts, number of plain documents): long texts that share one of two passages, a few in each scan task, then copies with edits or cut short."""
    rng = random.Random(21)
    passages = [[f"p{k}w{i}" for i in range(70)] for k in range(2)]
    texts = [[f"d{i}w{j}" for j in range(rng.randint(60, 160))] for i in range(60)]
    for i, t in enumerate(texts):
        at = rng.randrange(len(t))
        t[at:at] = passages[i % 2]
    plain = len(texts)
    for i in range(0, 60, 4):
        for share in (0.02, 0.1, 0.2, 0.3):
            w = list(texts[i])
            if i % 8:
                w = w[: int(len(w) * (1 - share))]
            else:
                w[10 : 10 + int(share * len(w))] = [f"e{i}x{share}y{j}" for j in range(int(share * len(w)))]
            texts.append(w)
    texts = [" ".join(t) for t in texts]
    # Rows are dealt by turns: of 20 tasks, each has one passage in three plain documents.
    rows = [(i, texts[i]) for k in range(tasks) for i in range(k, len(texts), tasks)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, tasks), "doc_id long, text string")
    return df, texts, plain


def test_ngram_join_with_shared_passages_and_edited_copies(spark):
    df, texts, _ = passages_and_copies(spark)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest(range(len(texts)), links)
    assert 15 < len(set(want)) - len(set(want.values())) < 60  # some copies link, some do not
    for small in (ngram_join.SMALL, 2):
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(df, small).collect()} == want


def test_passages_leave_no_lists(spark):
    """A passage that stands in a few documents of each task is known as frequent over all; documents that share no more than it meet in no list."""
    df, texts, plain = passages_and_copies(spark, 20)
    alone = df.where(F.col("doc_id") < plain)
    scan = ngram_join.stored(alone.mapInArrow(ngram_join._scan, ngram_join.fields(("doc_id", "long"), ("n", "long"), ("sid", "long"), ("sig", "binary"))))
    often = ngram_join.often_slots(scan)
    assert 2 * 60 <= len(often[0]) <= 2 * 66 and (often[1] >= 20).all()
    posted = ngram_join.fields(("key", "long"), ("sid", "long"), ("n", "int"), ("p", "int"), ("z", "int"))

    def lists(docs, known):
        return ngram_join.shared_lists(docs.select("text").mapInArrow(ngram_join._postings(spark.sparkContext.broadcast(known)), posted))

    assert lists(alone, often).count() == 0
    # Where no frequency is known, what stands in no list tells, if the passage is a small part.
    longer = alone.withColumn("text", F.concat_ws(" ", "text", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("m"), "doc_id", F.lit("w"), i))))
    assert lists(longer, (often[0][:0], often[1][:0])).count() == 0


def test_ngram_join_long_lists_across_components(spark):
    """One long list whose members are linked in chains, not all through the leader."""
    base = [f"w{i}" for i in range(60)]
    texts = []
    for g in range(3):
        own = [f"g{g}x{i}" for i in range(300)]
        for k in range(6):
            v = list(own)
            v[10 * k : 10 * k + 8 * k] = [f"e{g}{k}y{i}" for i in range(8 * k)]
            texts.append(" ".join(base + v))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(df, 2).collect()}
    assert got == smallest(range(len(texts)), links)
    assert len(set(got.values())) > 1


def expected_dedup():
    seen, out = set(), {}
    for i in sorted(TEXTS):
        w = WORD.findall(TEXTS[i] or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(docs):
    got = rows(substring_dedup.digest(docs))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == expected_dedup()


def test_substring_dedup_with_hot_keys_and_small_shards(docs):
    d = substring_dedup.Dedup(docs, shard_words=500, often=3)
    got = {r["doc"]: r["removed"] for r in d.changed.collect()}
    want = expected_dedup()
    firsts = {r["first"] for r in d.first.collect()}
    assert {i: n for i, n in got.items() if n} == {i: want[i][1] for i in firsts if want[i][1]}


def test_substring_dedup_with_repeated_rows_and_null_ids(spark):
    def run(name, n):
        return [f"{name}{i}" for i in range(n)]

    p, q = run("p", 30), run("q", 25)
    a, b = " ".join(run("a", 10) + p + run("b", 10)), " ".join(run("c", 5) + p)
    rows = [(7, a), (7, a), (9, b), (9, b), (7, " ".join(run("d", 8) + q)), (3, " ".join(q + run("e", 9)))]
    rows += [(None, " ".join(run(n, 6) + run("z", 22) + run(n + n, 30))) for n in "fgh"] + [(None, " ".join(run("g", 6) + run("z", 22) + run("gg", 30)))] * 2 + [(None, "too short"), (None, None), (None, "too short")]
    name = lambda t: substring_dedup.name_of(word_hashes(pa.array([t], pa.string()), False)[0])[0]
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], name(r[1]))):
        w = (t or "").split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.digest(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    d = substring_dedup.Dedup(df, shard_words=50, often=1)  # hot keys
    assert sorted(r["removed"] for r in d.changed.collect() if r["removed"]) == sorted(n for _, m, n, _ in want if n and n < m)


def test_substring_dedup_of_periodic_texts(spark):
    """Repeated lines inside one document: equal windows that share the place of no other document."""
    line = [f"w{i}" for i in range(13)]
    rows = [(1, " ".join(line * 20)), (2, " ".join(["x"] * 90 + line * 3)), (3, " ".join(["x", "y"] * 40))]
    seen, want = set(), {}
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        want[i] = sum(gone)
    got = substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == want


def test_fm_index_agrees_with_search():
    import numpy as np

    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = substring_dedup.FMIndex(text)
    begin = rng.integers(0, 270, 200)
    end = begin + rng.integers(1, 25, 200)
    raw = bytes(text.tolist())
    assert index.earlier(begin, end).tolist() == [raw.find(raw[a:z]) < a for a, z in zip(begin.tolist(), end.tolist())]


def test_sharding(docs):
    got = rows(sharding.shard(docs, shards=5))
    by = defaultdict(list)
    for i, r in got.items():
        raw = (TEXTS[i] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by[r["shard"]].append(r["slot"])
    assert len(by) == 5 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    homes = defaultdict(set)
    for i, r in got.items():
        if TEXTS[i] is not None:
            homes[TEXTS[i]].add(r["shard"])
    assert sum(len(h) > 1 for h in homes.values()) <= 1  # the group of 41 is larger than a shard


def test_sharding_repeated_rows(docs):
    got = sharding.shard(docs.union(docs), shards=40).collect()
    assert len(got) == 2 * len(TEXTS)
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got)


def cut_groups(got):
    homes = defaultdict(set)
    for r in got:
        homes[r["text_crc32"]].add(r["shard"])
    return sum(len(h) > 1 for h in homes.values())


def test_sharding_of_copies_alone(spark):
    """Every text has copies, so only leavers and whole moves make room."""
    for copies, texts, shards, most in ((2, 2000, 40, 0), (3, 900, 9, 0), (2, 780, 40, 39)):
        df = spark.createDataFrame([(c * texts + i, f"text {i}") for c in range(copies) for i in range(texts)], "doc_id long, text string")
        got = sharding.shard(df, shards=shards).collect()
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        assert len(got) == copies * texts and len(by) == shards
        assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert cut_groups(got) <= most


def test_sharding_with_few_unlinked_rows(spark):
    texts = [f"text {i}" for i in range(1000)] * 2 + [f"alone {i}" for i in range(100)]
    got = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=40).collect()
    assert len(got) == 2100 and cut_groups(got) <= 1


def test_mixing(docs):
    got = rows(mixing.mix(docs))
    source = {r[0]: r[3] for r in make_docs()}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for i, r in got.items():
        assert r["size"] == len(WORD.findall(TEXTS[i] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        size[source[i]] += r["size"]
        taken[source[i]] += r["taken"]
        target[source[i]] = r["target"]
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    open_, left, want = set(names), float(sum(size.values())), {}
    while True:
        per = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if per * weight[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
        left -= sum(want[s] for s in over)
        open_ -= over
    want |= {s: per * weight[s] for s in open_}
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= max(1, 0.01 * target[s])
    assert rows(mixing.mix(docs)) == got
    # The words that each shard draws from a source are its quota of blocks.
    by_shard, quota = defaultdict(int), {}
    for i, r in got.items():
        assert r["taken"] == sum(p["words"] for p in r["parts"])
        for p in r["parts"]:
            by_shard[source[i], p["shard"]] += p["words"]
            assert p["first_block"] <= p["last_block"] and 0 <= p["turn"] < 3
    goal = mixing.targets(mixing.seeded(docs, 7).drop("place"))
    ord_of = {r["ord"]: r for r in goal.collect()}
    for q in mixing.quotas(goal).collect():
        quota[ord_of[q["ord"]]["source"], q["shard"]] = q["blocks"] * q["block"]
    for (s, shard), n in quota.items():
        assert by_shard[s, shard] == n or sum(v for (x, _), v in quota.items() if x == s) > 3 * size[s]


def test_quotas_are_the_seats_of_highest_quotients(spark):
    t = [1000.0, 610.0, 333.0, 57.0, 3.0]
    goal = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "ord int, target double")
    each = mixing.quotas(goal, block_words=7, shards=4)
    house, seats, by_shard = int(sum(t) / 1 + 0.5), [0] * len(t), {}
    for shard in range(1, 5):  # a larger house keeps what a smaller one gave
        before = list(seats)
        while sum(seats) < house * shard // 4:
            seats[max(range(len(t)), key=lambda i: t[i] / (2 * seats[i] + 1))] += 1
        by_shard |= {(i, shard): s - b for i, (s, b) in enumerate(zip(seats, before))}
    assert each.first()["block"] == 1 and {(r["ord"], r["shard"]): r["blocks"] for r in each.collect()} == by_shard
    got = each.groupBy("ord").agg(F.sum("blocks").alias("b"), F.first("block").alias("block")).collect()
    block = got[0]["block"]
    house = int(sum(t) / block + 0.5)
    seats = [0] * len(t)
    for _ in range(house):
        k = max(range(len(t)), key=lambda i: t[i] / (2 * seats[i] + 1))
        seats[k] += 1
    assert {r["ord"]: r["b"] for r in got} == {i: s for i, s in enumerate(seats)}


def test_mixed_documents_match_what_is_taken(docs):
    taken = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    copies = {r["doc_id"]: r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id").count().collect()}
    for i, r in taken.items():
        assert copies.get(i, 0) == (-(-r["taken"] // r["size"]) if r["size"] else 0)
    out = mixing.mixed_documents(docs.withColumn("_full", F.lit("x")).withColumn("d", F.lit("y")).withColumn("m", F.lit("z")))
    assert out.columns == [*docs.columns, "_full", "d", "m"]
    assert [tuple(r) for r in out.select("_copies", "size", "_full", "d", "m").distinct().collect()] == [("clash", "clash", "x", "y", "z")]


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
PRIVATE = [
    "a@b.com_x@c.de and é😀 x.y+z@mail-1.example.com, .@a.b a@b @c.d a@-.-",
    "1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.4 12.34.56.78.90.12 9999.1.1.1.1",
    "4539 1488 0343 6467 4539-1488-0343-6467 45391488034364671 4539148803436467 12 3 4",
    "+1 (988) 555-2485 ++49 (0)30.1234567- +123 +1234567890123456 +1 +4( 12345678",
    "😀" * 50 + " q@w.er " + "7" * 6000 + " " + "a." * 5000 + "@x.y " + "+1" + "." * 3000,
    "call +1 988 555 2485 or 1 988 555 2485; card 4539 1488 0343 6467", "", None, "@", "+", "1.1.1.",
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, t or "", re.A):
            n = sum(c.isdigit() for c in m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= n <= 19 and luhn(m[0]) or kind == "phone" and 8 <= n <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark):
    df = spark.createDataFrame(list(enumerate(PRIVATE * 2)), "doc_id long, text string").withColumn("base", F.lit("clash")).withColumn("t", F.lit(1))
    got = {r["doc_id"]: r for r in pii.digest(df).collect()}
    for i, t in enumerate(PRIVATE * 2):
        want = base_spans(t)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [r[f"n_{k}"] for k, _ in PATTERNS] == [sum(w.startswith(k) for w in want) for k, _ in PATTERNS]
        spans = [s for s in r["spans"].split(",") if s]
        assert set(want) <= set(spans)
        places = sorted(tuple(map(int, s.split(":")[1:])) for s in set(spans) - set(want))
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))


def card(rng):
    d = [rng.randrange(10) for _ in range(15)]
    return next(c for c in ("".join(map(str, d + [x])) for x in range(10)) if luhn(c))


def test_pii_adds_disguised_spans(spark):
    """Disguised data are found from what base spans teach; dates, versions, times and numbers that fail Luhn stay, and so do all base spans."""
    rng = __import__("random").Random(2)
    word, n = lambda: "".join(rng.choices("abcdefgh", k=6)), rng.randrange
    dotted = lambda sep: sep.join(str(n(1, 255)) for _ in range(4))
    fours = lambda c, sep: sep.join(c[i : i + 4] for i in range(0, 16, 4))
    plain, noise, hidden = [], [], []
    for _ in range(150):
        plain.append(f"please write to {word()}@{word()}.com or call +1 ({n(200, 999)}) 555-{n(1000, 9999)} today")
        plain.append(f"the card {fours(card(rng), ' ')} was used from host {dotted('.')} again")
        bad = "".join(str(n(10)) for _ in range(16))
        noise.append(f"on {n(10, 29)}.{n(10, 13)}.{n(1990, 2030)} release {n(10)}.{n(10)} at {n(24)}:{n(10, 60)} took {n(300, 999)}:{n(300, 999)}:{n(300, 999)}:{n(300, 999)} steps" + ("" if luhn(bad) else f" of lot {fours(bad, '.')} here"))
    for _ in range(8):
        for before, span in (("please write to ", f"{word()} (at) {word()} (dot) org"), ("the card ", fours(card(rng), ".")), ("used from host ", dotted("[.]")), ("or call ", f"001 ({n(200, 999)}) 555-{n(1000, 9999)}")):
            hidden.append((before + span + " today", len(before), len(before) + len(span)))
    texts = plain + noise + [t for t, _, _ in hidden]
    got = [r["spans"].split(",") if r["spans"] else [] for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all(g == base_spans(t) for g, t in zip(got[: len(plain)], plain))
    assert sum(g != base_spans(t) for g, t in zip(got[len(plain) :], noise)) <= 0.02 * len(noise)
    hits = [any(s.endswith(f":{a}:{b}") for s in g) for g, (_, a, b) in zip(got[len(plain) + len(noise) :], hidden)]
    assert [sum(hits[k::4]) for k in range(4)] == [8] * 4


def test_pii_of_a_text_with_50_000_hits(spark):
    """Positions, context and counts over long lists, with hits side by side and signs outside the basic plane."""
    text = "😀" + " ".join(f"u{i}@ex{i}.com 10.1.{i % 256}.{i % 300}" for i in range(25_000))
    r = pii.digest(spark.createDataFrame([(1, text), (2, "write a@b.com")], "doc_id long, text string")).where("doc_id = 1").first()
    want = base_spans(text)
    assert len(want) > 45_000 and r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_sums_and_leftmost_spans_against_loops(spark):
    rng = __import__("random").Random(5)
    rows = [(n, [rng.randrange(9) for _ in range(n)], sorted((a, a + rng.randrange(1, 12)) for a in rng.choices(range(3 * n + 1), k=n))) for n in (0, 1, 2, 63, 64, 65, 129, 500)]
    df = spark.createDataFrame(rows, "id int, a array<int>, x array<struct<s:int,e:int>>")
    for r in df.select("a", "x", pii.sums_before(F.col("a")).alias("sums"), pii.leftmost(F.col("x")).alias("taken"), F.transform("x", lambda w: pii.touches(w, pii.leftmost(F.col("x")))).alias("met")).collect():
        assert r["sums"] == [sum(r["a"][:i]) for i in range(len(r["a"]))]
        at, want = 0, []
        for s, e in r["x"]:
            if s >= at:
                want, at = want + [(s, e)], e
        assert r["taken"] == want and r["met"] == [any(a < e and b > s for a, b in want) for s, e in r["x"]]


def test_pii_empty(empty):
    assert pii.digest(empty).count() == 0


def test_pii_redacts(spark):
    df = spark.createDataFrame([(1, "write a@b.com or +1 (988) 555-2485 now"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(df, pii.spans(df)).collect()}
    assert got == {1: "write <email> or <phone> now", 2: None}


def test_boosting_learns_a_rule():
    import itertools

    cells = [dict(zip(pii.FEATURES, v)) | {"n": 50, "pos": 50 if v[3] and v[1] < 2 else 0} for v in itertools.product(range(2), range(3), range(2), range(2), range(2), [0], [0], [0])]
    start, trees = pii.boost(cells)
    assert all((pii.value(start, trees, c) > 0) == (c["pos"] > 0) for c in cells)


def test_language_id(spark):
    rng = __import__("random").Random(1)
    kinds = {"de": "der die das und nicht schön für".split(), "en": "the and of this that with".split(), "fr": "le la les été où et".split()}
    made = [(i, " ".join(rng.choices(kinds[g], k=12)), g) for i, g in ((i, sorted(kinds)[i % 3]) for i in range(150))]
    made += [(200, None, "en"), (201, "", "fr"), (202, "12 345 !?", "de"), (203, "the and of", None), (204, "x" * 3000, "en"), (205, "the " * 30000, "en")]
    got = {r["doc_id"]: r for r in langid.digest(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(made)
    for i, t, lang in made:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if i < 200:
            assert r["lang_pred"] == lang
    assert sum(got[i]["lang_pred"] == g for i, _, g in made[:150] if got[i]["held_out"]) == sum(got[i]["held_out"] for i, _, _ in made[:150])
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203, 205)] == ["und", "und", "und", "en", "en"]


def test_forward_sum_over_segmentations():
    """Against the sum over all segmentations of a word, one by one."""
    import math

    import numpy as np

    names = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]
    probs = np.array([[0.3, 0.2, 0.1, 0.15, 0.1, 0.1, 0.05, 1e-9]])

    def brute(s):
        if not s:
            return 1.0
        return sum(probs[0, names.index(s[:n])] * brute(s[n:]) for n in range(1, len(s) + 1) if s[:n] in names)

    for w in ("a", "ab", "babab", "abababababababab"):
        got = langid.word_scores(langid.Pieces(names), probs, [w])[0, 0]
        assert abs(got - math.log(brute("▁" + w))) < 1e-9
    # A long word: the same sum, place by place, with no cut anywhere.
    w = "▁" + "babaabbab" * 60
    a = [1.0] + [0.0] * len(w)
    log = 0.0
    for j in range(1, len(w) + 1):
        a[j] = sum(a[i] * probs[0, names.index(w[i:j])] for i in range(max(0, j - 3), j) if w[i:j] in names)
        if j % 5 == 0:
            a, log = [x / a[j] for x in a], log + math.log(a[j])
    got = langid.word_scores(langid.Pieces(names), probs, [w[1:]])[0, 0]
    assert abs(got - log - math.log(a[-1])) < 1e-6


def test_expected_counts_over_segmentations():
    """Against the segmentations of short words one by one, and of a long word by exact fractions, with no cut anywhere."""
    from collections import Counter
    from fractions import Fraction as Q

    names = ["▁", "a", "b", "ab", "▁a", "ba", "bab"]
    flat, unknown = Q(1, len(names)), Q(1, 1000 * len(names))

    def weight(s):
        return flat if s in names else unknown if len(s) == 1 else 0

    def brute(word):
        a = [Q(1)] + [Q(0)] * len(word)
        b = [Q(0)] * len(word) + [Q(1)]
        spans = [(i, j) for i in range(len(word)) for j in range(i + 1, min(len(word), i + 3) + 1)]
        for i, j in spans:
            a[j] += a[i] * weight(word[i:j])
        for i, j in reversed(spans):
            b[i] += b[j] * weight(word[i:j])
        out = Counter()
        for i, j in spans:
            out[word[i:j] if word[i:j] in names else None] += a[i] * weight(word[i:j]) * b[j] / a[-1]
        return out

    def one_by_one(word):
        out, total = Counter(), Q(0)
        todo = [(0, Q(1), ())]
        while todo:
            at, w, used = todo.pop()
            if at == len(word):
                total += w
                for s in used:
                    out[s if s in names else None] += w
            todo += [(at + n, w * weight(word[at : at + n]), (*used, word[at : at + n])) for n in (1, 2, 3) if at + n <= len(word) and weight(word[at : at + n])]
        return Counter({s: n / total for s, n in out.items()})

    for w in ("a", "babab", "abcab"):
        got = one_by_one("▁" + w)
        assert all(abs(got[s] - n) < 1e-12 for s, n in brute("▁" + w).items())
    words = Counter({"a": 3, "babab": 2, "abcab": 1, "ccc": 4, "babaabbab" * 20 + "c" + "ab" * 30: 2})
    want = Counter()
    for w, n in words.items():
        for s, x in brute("▁" + w).items():
            want[s] += n * x
    got = langid.expected_counts(langid.Pieces(names), words)
    assert all(abs(got[k] - float(want[s])) < 1e-9 * max(1, float(want[s])) for k, s in enumerate([*names, None]))


def test_empty_tables(empty):
    assert ngram_join.join(empty).count() == 0
    assert substring_dedup.digest(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert pii.digest(empty).count() == 0
    assert langid.digest(empty).count() == 0
