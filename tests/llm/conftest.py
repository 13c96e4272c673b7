import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ("the an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve").split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def make_docs():
    """Copies, near copies, shared passages, repeats within a text, short, empty, null and very long texts."""
    rng = random.Random(4)
    passage, rows = words(rng, 60), []
    for i in range(60):
        w = words(rng, rng.randint(30, 120))
        if i % 6 == 1:
            w = rows[-1][1].split()
        if i % 6 == 2:
            w = rows[-1][1].split()
            w[rng.randrange(len(w))] = "changed"
        if i % 5 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randint(0, 10) : rng.randint(40, 60)]
        if i % 17 == 0:
            w = w + w[:30]
        rows.append((i, " ".join(w) if i % 2 else "\n".join(w) + "  "))
    rows += [(60, None), (61, ""), (62, "   \t\n "), (63, "one"), (64, "ONE"), (65, "a b c"), (66, "a  B c"), (67, " ".join(words(rng, 20_000)))]
    rows += [(68 + i, rows[10][1]) for i in range(40)]
    return [(i, t, ("en", "fr", None)[i % 3], (None, "s1", "s2", "s10", "Ä")[i % 5 if i % 2 else 1], len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    """The documents, with more columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(make_docs(), SCHEMA).repartition(3)
    for c in ("key", "size", "bucket", "sid", "place", "score", "hub", "n", "spans", "text_", "_copies", "shard", "ranges", "target"):
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
