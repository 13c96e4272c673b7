"""Many phrases looked for in many texts at once, with an automaton over all of them.

The phrases are a vocabulary. The automaton (Aho-Corasick) is built once on the driver from at most PART characters of
phrases, broadcast, and run over each text in the tasks: time is linear in the texts and in what is found, whatever the
number of phrases. A vocabulary of more characters is cut by hash into parts of about that size, and the texts are read once
for each part. Within means as contains(lower(text), lower(phrase)) means it: inside words too, and an empty phrase is
within every text that is not null.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = 16_000_000
#: Rows that a task hands on at a time, but for those of one text.
HITS = 50_000


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in phrases:
        out.add_word(p, p)
    if len(out):
        out.make_automaton()
    return out


def _found(shared, always: bool, most: int = HITS):
    """The last column of a batch is the text; each row comes out once for each phrase within it, about `most` rows at a
    time. Only the other columns are repeated: texts are long, and a text may have many hits."""
    def run(batches):
        search = shared.value
        for b in batches:
            texts, rows, found = b.column(b.num_columns - 1), [], []

            def put():
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[:-1]], pa.array(found, pa.string())], names=[*b.schema.names[:-1], "low"])

            for i in range(b.num_rows):
                text = texts[i].as_py()
                if text is None:
                    continue
                hits = {p for _, p in search.iter(text)} if len(search) else set()
                if always:
                    hits.add("")
                rows += [i] * len(hits)
                found += hits
                if len(rows) >= most:
                    yield put()
                    rows, found = [], []
            if rows:
                yield put()

    return run


def phrases_within(texts: DataFrame, text: str, phrases: DataFrame, phrase: str = "phrase", part: int = PART) -> DataFrame:
    """The rows of texts, without the text itself, beside each row of phrases whose phrase is within it, case ignored.

    Both tables' other columns are returned, so their names must differ.
    """
    spark = texts.sparkSession
    named = phrases.where(F.col(phrase).isNotNull()).withColumn("low", F.lower(phrase))
    distinct = named.select("low").distinct()
    size = distinct.agg(F.sum(F.length("low") + 1)).first()[0] or 0
    parts = max(1, -(-size // part))
    keys = [c for c in texts.columns if c != text]
    rows = texts.select(*keys, F.lower(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("low", T.StringType())])
    found = []
    for k in range(parts):
        own = distinct if parts == 1 else distinct.where(F.pmod(F.xxhash64("low"), F.lit(parts)) == k)
        some = [r["low"] for r in own.collect()]  # a part: its size was checked
        shared = spark.sparkContext.broadcast(automaton([p for p in some if p]))
        found.append(rows.mapInArrow(_found(shared, "" in some), schema))
    hits = reduce(DataFrame.unionAll, found)
    return hits.join(F.broadcast(named) if parts == 1 else named, "low").drop("low")
