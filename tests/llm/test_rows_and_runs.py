"""Periodic runs, importance resampling and line dedup against brute force, over every odd case."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import importance, line_dedup, periodic_runs
from matchloom.llm.queries import op11_periodic_runs, op12_importance_resampling

from .conftest import make_docs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHES = ("runs", "top", "start", "period", "weight", "rank", "place", "part", "bucket", "lines", "gone", "h1", "first", "pos", "id", "t1", "n")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text)


def runs_of(w, least=24, times=3):
    """Every stretch that no neighbour extends, with its smallest period: by trying all periods at all places."""
    n, best = len(w), {}
    for q in range(1, n // times + 1):
        a = 0
        while a + q < n:
            z = a
            while z + q < n and w[z] == w[z + q]:
                z += 1
            if z > a and z + q - a >= max(least, times * q):
                best.setdefault((a, z + q), q)
            a = z + 1
    return sorted((a, z - a, q) for (a, z), q in best.items())


def planted(i, w):
    if i is None or zlib.crc32(str(i).encode()) % 10 or not w:
        return w
    g, n = zlib.crc32(str(i).encode()) // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]


def run_digest(i, text):
    w = planted(i, WORD.findall(text or ""))
    found = runs_of(w)
    top = (None,) * 4
    for a, n, q in found:
        if top[0] is None or n * top[2] > top[1] * q:
            top = (a, n, q, 1000 * n // q)
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    return (i, len(found), *top, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def odd_docs():
    rng = random.Random(11)
    rows = [(i, t) for i, t, *_ in make_docs() if i < 67]
    for i in range(200, 320):  # few words, so that runs abound, touch and overlap
        rows.append((i, " ".join(rng.choice("ab" if i % 2 else "abc") for _ in range(rng.randint(1, 90)))))
    for i in range(320, 360):
        p = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
        rows.append((i, " \n".join([rng.choice("xyz") for _ in range(5)] + p * rng.randint(2, 9) + p[: rng.randint(0, len(p))] + list("zyx"))))
    rows += [(400, "w " * 3000), (401, "a b c d e f g " * 400), (-12, "neg " * 30), (None, "x y z " * 20), (None, "x y z " * 20), (None, None), (200, rows[-5][1]), (7, "one line\n" * 40)]
    return rows


def test_runs_against_brute_force_in_numpy():
    rng = random.Random(5)
    for least, times in ((24, 3), (6, 2), (3, 3)):
        docs = [[rng.choice("ab"[: rng.randint(1, 2)] + "c" * (i % 3)) for _ in range(rng.randint(0, 70))] for i in range(150)]
        ids = np.array([ord(x) for d in docs for x in d])
        got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(ids, np.cumsum([0, *map(len, docs)]), least, times))))
        assert got == [(d, *r) for d, w in enumerate(docs) for r in runs_of(w, least, times)]


def test_periodic_runs(spark):
    rows = odd_docs()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    same(periodic_runs.digest(df).collect(), [run_digest(*r) for r in rows])


def test_periodic_runs_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 64)
    rng = random.Random(2)
    w = [rng.choice("ab") for _ in range(3000)]
    w[500:900] = (["p", "q", "r", "s", "t"] * 80)[:400]
    got = periodic_runs.find_runs(np.array([ord(x) for x in w]), np.array([0, len(w)]))
    assert list(zip(*(x.tolist() for x in got[1:]))) == runs_of(w)


def test_periodic_runs_of_a_long_text(spark):
    """A text of one word, a million times: one run; and of a period that ends in the middle."""
    rows = [(1, "la " * 1_000_000), (2, "start " + "a b c d e f g h i j k " * 30_000 + "a b c stop")]
    got = {r["doc_id"]: r for r in periodic_runs.collapse(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 1_000_000, 1)] and got[1]["text"] == "la"
    assert [tuple(x) for x in got[2]["runs"]] == [(1, 330_003, 11)] and got[2]["text"] == "start a b c d e f g h i j k stop"


def test_periodic_runs_of_an_empty_table(spark, empty):
    assert periodic_runs.digest(empty).count() == 0


def test_op11_whole_result(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(op11_periodic_runs(spark, SF).collect(), [run_digest(i, t) for i, t in docs])


def grams(text):
    w = LOW.findall(lower(text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target, percent=5):
    every = [(i, *grams(t)) for i, t in docs]
    s, t = [0] * 10_000, [0] * 10_000
    for counts, bags in ((s, (b for *_, b in every)), (t, (grams(x)[1] for x in target))):
        for bag in bags:
            for b in bag:
                counts[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, bag in every:
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        weight = sum(gain[b] for b in bag)
        out.append([i, len(bag), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("piece", [1 << 18, 7])
def test_features_go_on_across_pieces(monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    text = "The <b>QUICK</b> brown-fox Äé 42 x\x00y\n" * 9 + "end"
    got = [(n, at.tolist()) for n, at in importance.features(text, 3, 10_000)]
    n, want = grams(text)
    assert sum(x for x, _ in got) == n and sorted(b for _, at in got for b in at) == sorted(want)


def test_importance_resampling(spark):
    rows = odd_docs() + [(500 + i, t) for i, (_, t) in enumerate(odd_docs())]
    target = ["the an er on " * 20, None, "", "Oranges-and lemons", "a b c a b c"]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").withColumn("bucket", F.lit(0))
    got = importance.select(df, goal, percent=40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got.collect(), resampled(rows, target, 40))


def test_importance_resampling_of_empty_tables(spark, empty):
    goal = spark.createDataFrame([], "text string")
    assert importance.select(empty, goal).count() == 0
    rows = [(i, "w " * 30) for i in range(40)]
    same(importance.select(spark.createDataFrame(rows, "doc_id long, text string"), goal).collect(), resampled(rows, []))


def test_op12_whole_result(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    same(op12_importance_resampling(spark, SF).collect(), resampled(docs, target))


def line_digest(rows):
    """By doc_id, as the docstring has it: rows without one are one document after the others."""
    held, place = {}, lambda i: (i is None, i or 0)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(place(i))
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == place(i)]
        out.append((i, len(every), len(every) - len(kept), sha("\n".join(kept))))
    return out


def line_rows():
    rng = random.Random(13)
    pool = [f"a shared line {i}" for i in range(12)] + ["short", "123456789", "1234567890", "ÀÉÎÕÜ àéîõü", "\tÀÉÎÕÜ àéîõü \r", "  A SHARED LINE 3\x0b", "nine😀chars", "", " "]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line {i} {k}" for k in range(rng.randint(0, 30)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "\n"), (93, "\n\n a shared line 1"), (5, rows[5][1]), (5, "a shared line 2\nother text of five"), (94, "only here, twice\nonly here, twice")]
    rows += [(None, "a shared line 1\nonly in nameless rows"), (None, "a shared line 1\nonly in nameless rows"), (None, "only in nameless rows\nand once more"), (-3, "a shared line 1\r\nA Shared Line 4")]
    rows += [(95, "\n".join(f"long text, line {k % 30_000}" for k in range(60_000))), (96, "\n".join(f"long text, line {k}" for k in range(0, 30_000, 2)))]
    return rows + [(100 + i, "boilerplate of them all\na shared line 7") for i in range(60)]


@pytest.mark.parametrize("hot", [line_dedup.HOT, 20, 1])  # some keys are broadcast: none, the commonest, all but none
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rows = line_rows()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = line_dedup.digest(df)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    same(got.collect(), line_digest(rows))


def test_line_dedup_with_a_higher_threshold(spark):
    rows = [(i, "\n".join(["held by all of them", f"held by two {i // 2}", f"own line of {i}"])) for i in range(10)]
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), documents=3).collect()}
    assert all(got[i] == ["held by all of them"] * (i == 0) + [f"held by two {i // 2}", f"own line of {i}"] for i in range(10))


def test_line_dedup_of_an_empty_table(spark, empty):
    assert line_dedup.digest(empty).count() == 0
