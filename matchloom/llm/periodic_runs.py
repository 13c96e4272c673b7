"""Periodic runs: stretches of words that repeat with a period, found by power-of-two names, and their repeats dropped.

Karp, Miller and Rosenberg: a block of 2^k words is named by the pair of names of its halves, so two blocks are equal if
their names are. The longest common extension of two places is read from the names, longest blocks first.

A run of period q repeats itself for at least max(least - q, (times - 1) q) words, which holds a whole block of a grid whose
step is the largest power of two that fits. So only grid blocks are compared with the blocks q words on, for all q of an
octave at once: n comparisons for each octave. Of the blocks of one stretch only the first is extended to both sides.
Documents in which no block of the smallest size stands twice have no run and leave after the first levels.

All of it runs in NumPy over some MB of texts at a time, without hashes of blocks and without suffix sorting; nothing is
shuffled. Work is n log n in the words of a text, memory 8 n log n bytes.

Defined results: a null or empty text has no words and no runs; a null doc_id is kept, and such a text is never altered by
`planted`; repeated rows have equal results; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields
from .words import split

SLICE = 4 << 20
PAIRS = 1 << 22
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


def planted_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a repeated stretch in one document of ten, chosen and shaped by the id."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _grid(q: int, least: int, times: int) -> int:
    """k of the largest block 2^k of which one on a grid of its own size lies in any stretch that repeats with period q."""
    return (max(least - q, (times - 1) * q) + 1).bit_length() - 2


class Names:
    """Names of all blocks of 2^k words of several documents, level by level; -1 where a block leaves its document."""

    def __init__(self, ids: np.ndarray, begin: np.ndarray):
        self.levels = [ids.astype(np.int64)]
        self.begin = begin
        self.doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        self.end = begin[1:][self.doc]

    def grow(self, k: int) -> None:
        while len(self.levels) <= k:
            half, name = 1 << len(self.levels) - 1, self.levels[-1]
            at = np.nonzero(np.arange(len(name)) + 2 * half <= self.end)[0]
            out = np.full(len(name), -1, dtype=np.int64)
            if len(at):
                out[at] = np.unique(name[at] * (name.max() + 1) + name[at + half], return_inverse=True)[1]
            self.levels.append(out)

    def repeating(self, k: int) -> np.ndarray:
        """Documents in which a block of level k stands twice."""
        name = self.levels[k]
        at = np.nonzero(name >= 0)[0]
        code = np.sort(self.doc[at] * (name.max(initial=0) + 1) + name[at])
        return np.unique(code[1:][code[1:] == code[:-1]] // (name.max(initial=0) + 1))

    def only(self, docs: np.ndarray) -> Names:
        keep = np.isin(self.doc, docs)
        size = np.diff(self.begin)[docs]
        out = Names(self.levels[0][keep], np.concatenate([[0], np.cumsum(size)]))
        out.levels = [x[keep] for x in self.levels]
        return out

    def candidates(self, k: int, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) of grid blocks of level k that stand again one period on, while the grid block before does not."""
        name, step, n = self.levels[k], 1 << k, len(self.doc)
        grid = np.arange(0, n, step)
        grid = grid[name[grid] >= 0]
        grid = grid[np.bincount(name[name >= 0])[name[grid]] > 1]
        at, per = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        rows = max(1, PAIRS // len(periods))
        for a in range(0, len(grid), rows):
            i = grid[a : a + rows, None]
            j = np.minimum(i + periods, n - 1)
            r, c = np.nonzero((name[i] == name[j]) & (self.doc[i] == self.doc[j]) & (j == i + periods))
            i, q = grid[a + r], periods[c]
            b = np.maximum(i - step, 0)
            again = (i >= step) & (self.doc[b] == self.doc[i]) & (name[b] == name[b + q])
            at.append(i[~again])
            per.append(q[~again])
        return np.concatenate(at), np.concatenate(per)

    def extended(self, i: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of the stretch with period q around the block of level k at i."""
        first, last = i.copy(), i + q + (1 << k)
        begin, end, top = self.begin[:-1][self.doc[i]], self.end[i], len(self.levels) - 1
        for level in range(top, -1, -1):
            name, step = self.levels[level], 1 << level
            for forward in (True, False):
                alive = np.arange(len(i))
                while len(alive):
                    if forward:
                        alive = alive[last[alive] + step <= end[alive]]
                        x = last[alive]
                        alive = alive[name[x] == name[x - q[alive]]]
                        last[alive] += step
                    else:
                        alive = alive[first[alive] - step >= begin[alive]]
                        x = first[alive] - step
                        alive = alive[name[x] == name[x + q[alive]]]
                        first[alive] -= step
                    if level < top:  # below the top a second block of this size cannot match
                        break
        return first, last


def find_runs(ids: np.ndarray, begin: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period.

    ids: numbers of the words of all documents; begin: where each document begins, and the end.
    """
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    if not len(ids):
        return none
    names = Names(ids, begin)
    low = min(_grid(q, least, times) for q in range(1, least + 1))
    names.grow(low)
    docs = names.repeating(low)
    if not len(docs):
        return none
    names = names.only(docs)
    most = int(np.diff(names.begin).max()) // times
    if not most:
        return none
    level = np.array([_grid(q, least, times) for q in range(1, most + 1)])
    names.grow(int(level.max()))
    found = []
    for k in np.unique(level).tolist():
        i, q = names.candidates(k, np.nonzero(level == k)[0] + 1)
        first, last = names.extended(i, q, k)
        ok = last - first >= np.maximum(least, times * q)
        found.append((first[ok], last[ok], q[ok]))
    first, last, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, last, first))  # the smallest period of a stretch
    first, last, q = first[order], last[order], q[order]
    new = np.append(True, (np.diff(first) != 0) | (np.diff(last) != 0))[: len(first)]
    first, last, q = first[new], last[new], q[new]
    doc = names.doc[first]
    start = first - names.begin[doc]
    order = np.lexsort((q, start, doc))
    return docs[doc[order]], start[order], (last - first)[order], q[order]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most SLICE characters in all, or of one row."""
    a = held = 0
    for z, size in enumerate(pa.compute.utf8_length(texts).to_pylist()):
        if z > a and held + (size or 0) > SLICE:
            yield a, z
            a, held = z, 0
        held += size or 0
    if a < len(texts):
        yield a, len(texts)


def _collapsed(least: int, times: int, planted: bool):
    def run(batches):
        for b in batches:
            for lo, hi in _slices(b.column(1)):
                ids = b.column(0)[lo:hi]
                words = [split(t) for t in b.column(1)[lo:hi].to_pylist()]
                if planted:
                    words = [planted_words(i, w) for i, w in zip(ids.to_pylist(), words)]
                begin = np.cumsum([0, *map(len, words)])
                named = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy()
                doc, start, length, period = find_runs(named, begin, least, times)
                at = np.searchsorted(doc, np.arange(len(words) + 1))
                for d in np.unique(doc).tolist():
                    edge = np.zeros(len(words[d]) + 1, dtype=np.int64)
                    own = slice(at[d], at[d + 1])
                    np.add.at(edge, start[own] + period[own], 1)
                    np.add.at(edge, start[own] + length[own], -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    words[d] = [w for w, g in zip(words[d], gone.tolist()) if not g]
                runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"]))
                text = pa.array([b" ".join(w) for w in words], pa.string())
                yield pa.RecordBatch.from_arrays([ids, runs, text], names=["doc_id", "runs", "text"])

    return run


def collapse(docs: DataFrame, least: int = 24, times: int = 3, planted: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period in words, by start and period) and text: the words that no run holds
    beyond its first period, joined by one space. A run is a stretch of at least `least` words and `times` periods.

    planted: the operator is shown texts that planted_words() has altered.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_collapsed(least, times, planted), fields(("doc_id", "long"), ("runs", T.ArrayType(RUN)), ("text", "string")))


def digest(docs: DataFrame) -> DataFrame:
    """Number of runs, the run of most periods and hashes of all runs and of what is kept, over texts with planted repeats."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    first = F.array_sort("runs", lambda a, b: F.when(more(a, b), -1).when(more(b, a), 1).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    top = collapse(docs, planted=True).withColumn("top", F.get(first, F.lit(0)))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(F.expr("1000 * top.length div top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
