"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of word characters in lower case; a word weighs as many as it has letters, eight at most. The sizes of
windows are the rungs of a ladder; an item's windows have the largest rung within its length, so that a window is nearly
as long as its item, and, from nine words on, the largest within 0.8 of it, so that an item cut at the edge of a text, or
a whole text that lacks some of it, still holds a window. An item gives the fingerprints of its first, middle and last
window of each size; a document the fingerprint of every window of every size in use, from running sums of the words'
signed bits. Fingerprints of 64 bits are split into four blocks of 16: two of them within radius seven differ by one bit at most in some block, so four
tables, in which a fingerprint stands under each block's value and its sixteen neighbours, find all pairs within the
radius; a window meets only the fingerprints of its own four buckets. Each pair found lays the window's place against the
item, and the weighted Jaccard similarity of the five-word shingles (each weighs its letters, counted as often as it
occurs) decides, 0.8 or more; a place that misses it by less than 0.2 is tried up to three words to either side, as words
added or lost before a window move it. Shorter items and texts are one shingle.

What the fingerprints lose: an edited item of similarity 0.8 to 0.9 can lie beyond radius seven; recall against laying
every window against every item is at least 0.9 in the tests, by kind of edit, inside texts, at their edges and for whole
texts.

The benchmark is a bounded set: it is taken in parts of `most_items`, each indexed once, broadcast, and matched in a pass
over the documents. Very long texts are read whole, a piece at a time. Null or empty texts match nothing, nor do null or
wordless items. Repeated rows are judged alike; of places of one item in a text the most similar, then the first, is
reported. Rows of one item_id with different texts are one item of several texts, found by any of them. Extra columns are
ignored by find() and kept by clean(). Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, sliced

WORDS = re.compile(r"\w+")
FIRST_RUNGS = [1, 2, 3, 4, 6, 8, 12, 16]
K = 5
CUT, NEAR, SHIFTS = 0.8, 0.2, (-1, 1, -2, 2, -3, 3)
RADIUS = 7
HEAVY = 8  # what a word weighs at most
PIECE = ((1 << 16) - 1) // (2 * HEAVY)  # words; sums of signed bits over so many, each raised by HEAVY, fit 16 bits
BLOCKS = np.arange(4, dtype=np.int32) << 16
FLIPS = np.array([0, *(1 << k for k in range(16))], dtype=np.uint16)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def shingles(words: list[str]) -> Counter:
    return Counter([" ".join(words[i : i + K]) for i in range(len(words) - K + 1)] if len(words) >= K else [" ".join(words)] if words else [])


def similarity(a: Counter, b: Counter) -> float:
    weigh = lambda s: len(s) - s.count(" ")
    both = sum(weigh(s) * min(n, b[s]) for s, n in a.items() if s in b)
    every = sum(weigh(s) * n for s, n in a.items()) + sum(weigh(s) * n for s, n in b.items()) - both
    return both / every if every else 0.0


def signs(word: str) -> np.ndarray:
    bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(word, seed=11)], dtype=np.uint64).view(np.uint8)).astype(np.int16)
    return (2 * bits - 1) * min(len(word), HEAVY)


def window_prints(matrix: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of `size` words, as four 16-bit blocks each; matrix: words x 64 signed bits."""
    return prints(sums((matrix + HEAVY).astype(np.uint16)), size)


def sums(raised: np.ndarray) -> np.ndarray:
    """Exact running sums of signed bits; raised: words x 64 of them, each plus HEAVY. Up to PIECE words, four bits are summed at a time."""
    n = len(raised)
    if n > PIECE:
        run = np.zeros((n + 1, 64), dtype=np.int64)
        np.cumsum(raised, axis=0, dtype=np.int64, out=run[1:])
        return run - HEAVY * np.arange(n + 1)[:, None]
    run = np.zeros((n + 1, 16), dtype=np.uint64)
    np.cumsum(raised.view(np.uint64), axis=0, out=run[1:])
    return (run.view(np.uint16) - (HEAVY * np.arange(n + 1)).astype(np.uint16)[:, None]).view(np.int16)


def prints(run: np.ndarray, size: int) -> np.ndarray:
    return np.packbits((run[size:] > run[:-size]).ravel()).view(np.uint16).reshape(-1, 4)


def rung(n: float) -> int:
    """The largest rung of the ladder within n; from 16 on a rung is 1.4 of the one before, to the next even number."""
    if n < FIRST_RUNGS[-1]:
        return max(w for w in FIRST_RUNGS if w <= n)
    out = FIRST_RUNGS[-1]
    while (up := 2 * round(0.7 * out)) <= n:
        out = up
    return out


def windows_of(n: int) -> list[tuple[int, int]]:
    """Sizes and starts of the windows of an item of n words."""
    sizes = {rung(n)} | ({rung(CUT * n)} if n >= 9 else set())
    return sorted({(size, at) for size in sizes for at in (0, (n - size) // 2, n - size)})


class Buckets:
    """Fingerprints of one size of windows, in four tables by the values of a block within one bit."""

    def __init__(self, marks: list[tuple[np.ndarray, int, int]]):
        fp = np.array([m[0] for m in marks])
        self.prints = np.ascontiguousarray(fp).view(np.uint64).ravel()
        self.items, self.starts = np.array([m[1] for m in marks]), np.array([m[2] for m in marks])
        value = (fp[:, :, None] ^ FLIPS).astype(np.int32) + BLOCKS[:, None]
        who = np.broadcast_to(np.arange(len(fp), dtype=np.int32)[:, None, None], value.shape).ravel()
        order = np.argsort(value.ravel(), kind="stable")
        self.begin, self.who = np.searchsorted(value.ravel()[order], np.arange((4 << 16) + 1)).astype(np.int32), who[order]
        self.any = np.diff(self.begin) > 0

    def near(self, got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, fingerprint) pairs within the radius; a pair can come up once for each block."""
        value = (got + BLOCKS).ravel()
        at = np.flatnonzero(self.any[value])  # few windows have any fingerprint in their bucket
        value = value[at]
        lo = self.begin[value]
        n = self.begin[value + 1] - lo
        at, first = np.repeat(at >> 2, n), np.repeat(lo - np.cumsum(n) + n, n)
        mark = self.who[first + np.arange(len(at))]
        fit = np.flatnonzero(np.bitwise_count(got.view(np.uint64).ravel()[at] ^ self.prints[mark]) <= RADIUS)
        return at[fit], mark[fit]


class Index:
    """The items' texts by number, and the fingerprints of their windows by size."""

    def __init__(self, items: list[tuple[int, str]]):
        each = [(i, w) for i, t in dict.fromkeys(items) if (w := words_of(t))]
        self.ids, self.words = [i for i, _ in each], [w for _, w in each]
        self.shingles = [shingles(w) for w in self.words]
        marks: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for e, w in enumerate(self.words):
            matrix = np.array([signs(x) for x in w], dtype=np.int16)
            got: dict[int, np.ndarray] = {}
            for size, at in windows_of(len(w)):
                if size not in got:
                    got[size] = window_prints(matrix, size)
                marks.setdefault(size, []).append((got[size][at], e, at))
        self.classes = {size: Buckets(rows) for size, rows in sorted(marks.items())}
        self.longest = max(self.classes, default=1)

    def candidates(self, run: np.ndarray):
        """(number, start of the item, begin and end of the window) for each window within the radius of one of its fingerprints."""
        found = set()
        for size, tables in self.classes.items():
            if len(run) > size:
                at, mark = tables.near(prints(run, size))
                if len(at):
                    found.update(zip(tables.items[mark].tolist(), (at - tables.starts[mark]).tolist(), at.tolist(), (at + size).tolist()))
        return found


class Numbers(dict):
    """Words by number, in the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Scanner:
    """Finds items in whole texts; keeps the words' signed bits in a bounded table."""

    def __init__(self, index: Index, most: float = 0.8, words: int = 1 << 17):
        self.index, self.most, self.limit = index, most, words
        self.ids, self.table, self.filled = Numbers(), np.zeros((words, 64), dtype=np.uint16), 0

    def matrix(self, words: list[str]) -> np.ndarray:
        """The words' signed bits, each plus HEAVY."""
        if len(self.ids) + len(words) > self.limit:
            self.ids, self.filled = Numbers(), 0
            if len(words) > self.limit:
                return np.array([signs(w) + HEAVY for w in words], dtype=np.uint16)
        at = np.fromiter(map(self.ids.__getitem__, words), dtype=np.intp, count=len(words))
        if len(self.ids) > self.filled:
            new = list(islice(reversed(self.ids), len(self.ids) - self.filled))[::-1]
            raw = np.array([xxhash.xxh64_intdigest(w, seed=11) for w in new], dtype=np.uint64).view(np.uint8).reshape(-1, 8)
            heavy = np.fromiter(map(len, new), dtype=np.int64, count=len(new)).clip(max=HEAVY).astype(np.uint16)[:, None]
            self.table[self.filled : len(self.ids)] = np.unpackbits(raw, axis=1) * (2 * heavy) + (HEAVY - heavy)
            self.filled = len(self.ids)
        return self.table.take(at, axis=0)

    def runs(self, words: list[str]) -> np.ndarray:
        return sums(self.matrix(words))

    def laid(self, words: list[str], e: int, start: int) -> float:
        """Similarity of an item to as many words of the text from there, or what there is of them."""
        return similarity(self.index.shingles[e], shingles(words[max(0, start) : max(0, start + len(self.index.words[e]))]))

    def best(self, words: list[str], found: set[tuple[int, int]]) -> dict[int, tuple[float, int]]:
        """Of the places found for each item, the most similar, if it reaches the threshold."""
        best = {}
        for e, start in sorted(found, key=lambda x: (x[1], x[0])):
            item = self.index.ids[e]
            s = self.laid(words, e, start)
            if self.most - NEAR <= s < self.most:
                s, start = max(((self.laid(words, e, start + d), start + d) for d in SHIFTS), key=lambda x: x[0])
            if s >= self.most and s > best.get(item, (0.0, 0))[0]:
                best[item] = (s, max(0, start))
        return best

    def scan(self, text: str | None) -> dict[int, tuple[float, int]]:
        """item: (similarity, first word), of the best place of each item that reaches the threshold."""
        return next(self.scan_all([text]))

    def scan_all(self, texts: list[str | None]):
        """scan() of each text: many short texts share one run of words, a long text is taken in overlapping pieces."""
        over, group, held = self.index.longest, [], 0
        for text in texts:
            words = words_of(text)
            if held and held + len(words) > PIECE:
                yield from self._group(group)
                group, held = [], 0
            if len(words) > PIECE:
                found, step = set(), max(over, PIECE - over + 1)
                for at in range(0, len(words), step):
                    found.update((i, s + at) for i, s, _, _ in self.index.candidates(self.runs(words[at : at + step + over - 1])))
                yield from self._group(group)
                group, held = [], 0
                yield self.best(words, found)
            else:
                group.append(words)
                held += len(words)
        yield from self._group(group)

    def _group(self, group: list[list[str]]):
        if not group:
            return
        ends = np.cumsum([len(w) for w in group])
        found: list[set] = [set() for _ in group]
        for item, start, a, z in self.index.candidates(self.runs([w for words in group for w in words])) if ends[-1] else ():
            d = int(np.searchsorted(ends, a, side="right"))
            if z <= ends[d]:  # the window lies in one text
                found[d].add((item, start - int(ends[d]) + len(group[d])))
        for words, f in zip(group, found):
            yield self.best(words, f)


def item_parts(benchmark: DataFrame, most_items: int):
    """The benchmark on the driver, in parts of about most_items rows."""
    parts = -(-benchmark.count() // most_items)
    for p in range(parts):
        yield sorted((r["item_id"], r["text"]) for r in benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).where("item_id is not null and text is not null").select("item_id", "text").collect())


def find(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, most_items: int = 20_000) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, similarity, first_word."""
    schema = fields(("doc_id", "long"), ("item_id", "long"), ("similarity", "double"), ("first_word", "long"))
    out = docs.sparkSession.createDataFrame([], schema)
    for items in item_parts(benchmark, most_items):
        def run(batches, index=docs.sparkSession.sparkContext.broadcast(Index(items))):  # at most most_items items
            scanner = Scanner(index.value, least)
            for b in sliced(batches):
                rows = [(d, i, s, at) for d, best in zip(b.column(0).to_pylist(), scanner.scan_all(b.column(1).to_pylist())) for i, (s, at) in sorted(best.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=schema.names)

        out = out.union(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, most_items: int = 20_000) -> DataFrame:
    """The rows of docs in which no item is found, unchanged."""
    for items in item_parts(benchmark, most_items):
        def run(batches, index=docs.sparkSession.sparkContext.broadcast(Index(items))):
            scanner = Scanner(index.value, least)
            for b in sliced(batches):
                yield b.filter(pa.array([not best for best in scanner.scan_all(b.column(b.schema.get_field_index("text")).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
