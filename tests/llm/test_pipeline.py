"""Every stage of the pipeline on odd rows: nulls, empty, wordless and very long texts, ties, repeated rows, rows that share an
id or have none, clashing columns, empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from .conftest import SCHEMA, words

SF = "/root/testdata/sf0.001"
CLASHES = ("_name", "component_id", "score", "n", "d", "place", "item_id", "shard", "size", "key", "label", "first", "sid", "m", "source_size")


def odd_rows():
    rng = random.Random(17)
    base = [" ".join(words(rng, rng.randint(30, 80))) for _ in range(12)]
    near = [t.replace(t.split()[3], "changed", 1) for t in base]
    rows = [(i, t) for i, t in enumerate(base)] + [(20 + i, t) for i, t in enumerate(base[:6])] + [(40 + i, t) for i, t in enumerate(near)]
    rows += [(i, t) for i, t in enumerate(base[:4])]  # repeated rows
    rows += [(None, base[1]), (None, base[1]), (None, " ".join(words(rng, 40))), (None, base[7] + " and more"), (3, base[9])]  # null ids, an id with another text
    rows += [(60, None), (60, None), (61, ""), (62, ""), (63, " \n\t "), (64, "one"), (65, "one"), (66, "?!"), (None, None), (67, " ".join(words(rng, 60_000))), (68, base[0].upper())]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if k % 3 else None, ("s1", "s2", None)[k % 3], len(t or "")) for k, (i, t) in enumerate(odd_rows())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def shingle_set(t):
    w = "".join(c.lower() if c < "\x80" else c for c in t or "").split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_one_row_of_each_group_stays(spark, odd):
    rows = sorted(set(odd_rows()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    out = stages()["ngram_jaccard_join"](spark, odd, SF)
    assert out.columns == odd.columns
    assert {tuple(r[c] for c in CLASHES) for r in out.collect()} == {("clash",) * len(CLASHES)}
    kept = texts(out)
    assert sum(kept.values()) == len(groups) and set(kept.values()) == {1}
    for group in groups.values():
        mine = [r for r in kept if r in group]
        assert len(mine) == 1 and mine[0][0] == group[0][0]  # the smallest id, none last


def test_repeats_of_every_row_change_nothing(spark, odd):
    stage = stages()["ngram_jaccard_join"]
    assert texts(stage(spark, odd.union(odd), SF)) == texts(stage(spark, odd, SF))


@pytest.mark.parametrize("name", ["toxicity", "benchmark_decontamination"])
def test_filters_judge_each_row_by_its_text(spark, odd, name):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    bad = "filler words here " * 5 + item
    more = spark.createDataFrame([(500, bad), (500, bad), (None, bad), (501, item)], "doc_id long, text string")
    every = odd.unionByName(more, allowMissingColumns=True)
    out = stages()[name](spark, every, SF)
    assert out.columns == every.columns
    before, after = texts(every), texts(out)
    assert all(after[k] in (0, n) for k, n in before.items()) and set(after) <= set(before)  # equal rows alike, none new
    verdict = {}
    for (_, t), n in before.items():
        verdict.setdefault(t, set()).add(bool(after[(_, t)]))
    assert all(len(v) == 1 for v in verdict.values())
    assert {(61, ""), (62, ""), (60, None), (None, None), (63, " \n\t ")} <= set(after)
    if name == "benchmark_decontamination":
        assert set(before) - set(after) == {(500, bad), (None, bad), (501, item)}
    else:
        assert set(texts(odd)) == set(after) & set(texts(odd))  # nothing here is toxic


def test_the_mix_takes_rows_with_words(spark, odd):
    out = stages()["source_mixing"](spark, odd, SF)
    assert out.columns == odd.columns
    before, after = texts(odd), texts(out)
    assert set(after) <= {k for k in before if (k[1] or "").split()}
    assert all(after[k] <= 3 * n for k, n in before.items())


def test_every_row_gets_a_shard(spark, odd):
    rows = stages()["balanced_sharding"](spark, odd, SF).collect()
    assert len(rows) == odd.count()
    by = Counter(r["shard"] for r in rows)
    n, shards = len(rows), 40
    assert all(by[s] in (n // shards, -(-n // shards)) for s in range(shards))
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s])) for s in by)


@pytest.mark.parametrize("name", ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "balanced_sharding"])
def test_stages_on_an_empty_table(spark, odd, name):
    out = stages()[name](spark, odd.limit(0), SF)
    assert out.count() == 0
    assert name == "balanced_sharding" or out.columns == odd.columns
