"""Substring dedup with a compressed FM-index per shard.

A window is 20 consecutive words. Documents with equal word sequences are settled first: all but the one with the
smallest id are covered whole. For the rest, windows are routed by content: each window belongs to the eight-word run
with the smallest hash in it, so equal windows meet under one key, and neighbouring windows with one key form a segment.
Keys that occur once are dropped. Segments go to shards of about `shard_words` words by key; under a key that occurs
very often each window is a segment of its own, routed by its own hash, and a task sends on only the first of equal
ones, since the others are known to be covered.

A shard indexes its segments in order of document and start: suffix order over 32 words, Burrows-Wheeler transform,
and a wavelet matrix over packed bits. Backward search runs for many windows at once; it goes on while the suffix range
holds an earlier start (a range minimum). A segment that matches whole is covered at once, otherwise its windows are
searched one by one; matched windows are joined into intervals and reported. Covered words are removed and the rest is
written back.

Null text has no words. Fewer than 20 words: no window. Ties: doc_id, the name of the word sequence and start decide;
null goes before all. A word sequence is indexed once, under its smallest doc_id; doc_id need not be unique: all other
rows with that sequence, those with the same or no doc_id too, are copies. Empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, fields, forget, small_batches, stored
from .words import grams, split, word_hashes

WINDOW, K, DEPTH = 20, 8, 32
STEP = 128  # rows hashed at a time
BLOCK = 16  # suffixes
FIRST = -(1 << 63)


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of every `width` numbers in a row, by doubling."""
    at, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        have += step
    return at


def segments_of(h: np.ndarray, begin: np.ndarray):
    """For the rows of one piece: (row, key, first window, one past the last) of runs of windows with one smallest run of K words in one place."""
    n = np.diff(begin) - WINDOW + 1
    n[n < 0] = 0
    row = np.repeat(np.arange(len(n)), n)
    if not len(row):
        return row, np.zeros(0, dtype=np.uint64), row, row
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    g = grams(h, K)
    least = sliding_min(g, WINDOW - K + 1)[begin[row] + place]
    cut = np.nonzero(np.append(True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])))[0]
    last = np.append(cut[1:], len(row)) - 1
    return row[cut], g[least[cut]], place[cut], place[last] + 1


def name_of(h: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a word sequence, as two signed numbers."""
    d = xxhash.xxh3_128_digest(h.tobytes(), seed=len(h))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _pieces(column):
    """(first row, hashes, begins) of the column's words, STEP rows at a time."""
    for lo in range(0, len(column), STEP):
        yield lo, *word_hashes(column.slice(lo, STEP), False)


def _scan(batches):
    """Per document: hash of the raw text as given, words, a 128-bit name of the word sequence, and the hash of the whole text as joined words."""
    for b in batches:
        n, x, y = [], [], []
        for _, h, begin in _pieces(b.column(1)):
            for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()):
                name = name_of(h[a:z])
                n.append(z - a)
                x.append(name[0])
                y.append(name[1])
        sha = [hashlib.sha256(b" ".join(split(t))).hexdigest() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "raw", "n_words", "x", "y", "sha"])


def _occurrences(batches):
    """key, name (of the word sequence), from, to (windows), sure. Keys met twice in a batch are sure to repeat; one row stands for them elsewhere."""
    seen: set[int] = set()
    for b in batches:
        cols = [[], [], [], []]
        for _, h, begin in _pieces(b.column(0)):
            row, key, lo, hi = segments_of(h, begin)
            names = np.zeros(len(begin) - 1, dtype=np.int64)
            fresh = np.zeros(len(begin) - 1, dtype=bool)
            for r in np.unique(row).tolist():
                names[r] = name = name_of(h[begin[r] : begin[r + 1]])[0]
                if name not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(name)
                    fresh[r] = True
            new = fresh[row]
            for c, v in zip(cols, (key.view(np.int64), names[row], lo.astype(np.int32), hi.astype(np.int32))):
                c.append(v[new])
        if not cols[0]:
            continue
        key, name, lo, hi = map(np.concatenate, cols)
        order = np.argsort(key, kind="stable")
        key, name, lo, hi = key[order], name[order], lo[order], hi[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        run = np.cumsum(new) - 1
        sure = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, dtype=bool)
        tokens = np.nonzero(new & sure)[0]  # one row for each sure key, with an empty range, twice the weight of a single one
        none = np.full(len(tokens), -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, key[tokens]])), pa.array(np.concatenate([name, name[tokens]])), pa.array(np.concatenate([lo, none]).astype(np.int32)), pa.array(np.concatenate([hi, none]).astype(np.int32)), pa.array(np.concatenate([sure, np.zeros(len(tokens), dtype=bool)]))], names=["key", "name", "lo", "hi", "sure"])


def _repeated(batches):
    """From rows sorted by (sure, key, name, lo): those whose key has two places."""
    held = None

    def flush(c):
        key, name, lo, hi, sure = c
        same = np.append(False, (key[1:] == key[:-1]) & (name[1:] == name[:-1]) & (lo[1:] == lo[:-1]) & ~sure[1:])
        key, name, lo, hi, sure = (v[~same] for v in c)
        run = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (sure[1:] != sure[:-1]))) - 1
        weight = np.where(lo < 0, 2, 1)
        keep = (sure | (np.bincount(run, weight)[run] > 1)) & (lo >= 0)
        return pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (name, lo, hi, key)], names=["name", "lo", "hi", "key"])

    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        if not len(cols[0]):
            continue
        open_from = len(cols[0])
        if not cols[4][-1]:  # sure rows can go at once; the last key may go on
            open_from = int(np.nonzero(np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[4][1:] != cols[4][:-1])))[0][-1])
        held = [c[open_from:] for c in cols]
        if open_from:
            yield flush([c[:open_from] for c in cols])
    if held is not None and len(held[0]):
        yield flush(held)


def _segments(batches):
    """key, doc, name, start, words; a negative number of words marks a covered window: start and nothing to index."""
    pending: dict[int, tuple] = {}

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.list_(pa.int64()))], names=["key", "doc", "name", "start", "words"])

    def emit(out, key, doc, name, start, w):
        for c, v in zip(out, (key, doc, name, start, w)):
            c.append(v)

    for b in batches:
        out = [[], [], [], [], []]
        docs, names, every = (b.column(i).to_pylist() for i in (0, 1, 3))
        rows_of = ((lo + i, h[begin[i] : begin[i + 1]]) for lo, h, begin in _pieces(b.column(2)) for i in range(len(begin) - 1))
        for i, h in rows_of:
            doc, name, ranges = docs[i], names[i], every[i]
            whole = grams(h, WINDOW).view(np.int64).tolist() if any(r["hot"] for r in ranges) else []
            h = h.view(np.int64)
            for r in ranges:
                if not r["hot"]:
                    emit(out, r["key"], doc, name, r["lo"], h[r["lo"] : r["hi"] + WINDOW - 1])
                    continue
                for s in range(r["lo"], r["hi"]):
                    k = whole[s]
                    old, new = pending.get(k), (doc, name, s, h[s : s + WINDOW])
                    if old is not None:
                        first, later = (old, new) if old[:3] <= new[:3] else (new, old)
                        emit(out, k ^ later[1], *later[:3], [])
                        new = first
                    pending[k] = new
            if len(pending) > 100_000:
                for k, place in pending.items():
                    emit(out, k, *place)
                pending.clear()
        if out[0]:
            yield rows(out)
    if pending:
        out = [[], [], [], [], []]
        for k, place in pending.items():
            emit(out, k, *place)
        yield rows(out)


class Bits:
    """Packed bits with ranks."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % 64 + 64, dtype=bool)
        self.word = np.packbits(np.concatenate([bits, pad]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.word), dtype=np.int64)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.word[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class FMIndex:
    """Suffix order over DEPTH symbols, wavelet matrix of the transform, and minima of starts over suffix ranges."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.n, self.text = n, text
        rank = text.astype(np.int64)
        step = 1
        while step < DEPTH:
            nxt = np.append(rank[step:] + 1, np.zeros(min(step, n), dtype=np.int64))
            pair = rank * (nxt.max() + 1) + nxt
            rank = np.unique(pair, return_inverse=True)[1]
            step *= 2
        self.order = np.argsort(rank, kind="stable").astype(np.int32)
        bwt = text[self.order - 1]
        sigma = int(text.max()) + 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            one = (bwt >> level & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(int(n - one.sum()))
            bwt = np.concatenate([bwt[~one], bwt[one]])
        # Minima over suffix ranges: running minima inside blocks, and a sparse table over whole blocks only.
        pad = np.append(self.order, np.full(-n % BLOCK, np.iinfo(np.int32).max, dtype=np.int32)).reshape(-1, BLOCK)
        self.upto = np.minimum.accumulate(pad, axis=1).ravel()
        self.onward = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
        self.minima, width = [pad.min(axis=1)], 1
        while 2 * width <= len(pad):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before i, plus its place in the last level's order."""
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            r = self.bits[k].rank(i)
            i = np.where(one, self.zeros[k] + r, i - r)
        return i

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Suffix ranges with a symbol put before."""
        both = self.occurrences(np.concatenate([symbol, symbol, symbol]), np.concatenate([lo, hi, np.zeros_like(lo)]))
        lo, hi, base = np.split(both, 3)
        return self.starts[symbol] + lo - base, self.starts[symbol] + hi - base

    def first_start(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest text place in each (not empty) suffix range."""
        first, last = lo // BLOCK, (hi - 1) // BLOCK
        out = np.minimum(self.onward[lo], self.upto[hi - 1]).astype(np.int64)
        inside = np.nonzero(first == last)[0]  # a range in one block: look at its places
        if len(inside):
            at = lo[inside, None] + np.arange(BLOCK)
            out[inside] = np.where(at < hi[inside, None], self.order[np.minimum(at, self.n - 1)], self.n).min(axis=1)
        far = np.nonzero(last - first > 1)[0]
        k = np.frexp((last[far] - first[far] - 1).astype(float))[1] - 1
        for level in np.unique(k):
            at = far[k == level]
            m = self.minima[level]
            out[at] = np.minimum(out[at], np.minimum(m[first[at] + 1], m[last[at] - (1 << int(level))]))
        return out

    def earlier(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether text[begin:end) also starts at an earlier place, for many patterns at once."""
        alive = np.arange(len(begin))
        lo, hi = np.zeros(len(begin), dtype=np.int64), np.full(len(begin), self.n, dtype=np.int64)
        at = end.copy()
        found = np.zeros(len(begin), dtype=bool)
        while len(alive):
            at[alive] -= 1
            p = at[alive]
            a, z = self.step(self.text[p], lo[alive], hi[alive])
            lo[alive], hi[alive] = a, z
            good = self.first_start(a, z) < p  # the pattern itself is in the range
            found[alive[good & (p == begin[alive])]] = True
            alive = alive[good & (p > begin[alive])]
        return found


def covered_windows(docs: np.ndarray, starts: np.ndarray, words: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(document, from, to) in words, of the windows in these segments that also start earlier in one of them."""
    order = np.lexsort((starts, docs))
    docs, starts, words = docs[order], starts[order], [words[i] for i in order]
    size = np.array([len(w) for w in words])
    flat, ids = np.unique(np.concatenate(words), return_inverse=True)
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum() + len(size)), dtype=np.int64)  # 0 parts segments
    body = np.ones(len(text), dtype=bool)
    body[begin + size] = False
    text[body] = ids + 1
    index = FMIndex(text)
    # Patterns of over DEPTH - 1 words are matched in overlapping parts no longer than that; each part holds whole windows.
    part, first, last = [], [], []
    for s in range(0, int(size.max()) - WINDOW + 1, DEPTH - WINDOW):
        has = np.nonzero(size - WINDOW >= s)[0]
        part.append(has)
        first.append(np.full(len(has), s))
        last.append(np.minimum(size[has], s + DEPTH - 1))
    part, first, last = map(np.concatenate, (part, first, last))
    whole = index.earlier(begin[part] + first, begin[part] + last)
    out = [(part[whole], first[whole], last[whole])]
    rest = np.nonzero(~whole)[0]
    n = last[rest] - first[rest] - WINDOW + 1
    seg = np.repeat(rest, n)
    s = first[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    hit = index.earlier(begin[part[seg]] + s, begin[part[seg]] + s + WINDOW)
    out.append((part[seg][hit], s[hit], s[hit] + WINDOW))
    seg, a, z = (np.concatenate(x) for x in zip(*out))
    return list(zip(docs[seg].tolist(), (starts[seg] + a).tolist(), (starts[seg] + z).tolist()))


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[list[int]] = []
    for d, a, z in sorted(spans):
        if out and out[-1][0] == d and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], z)
        else:
            out.append([d, a, z])
    return [tuple(x) for x in out]


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    # Documents by their place in the order of id and name.
    doc, name = pdf["doc"].to_numpy(), pdf["name"].to_numpy()
    order = np.lexsort((name, doc))
    new = np.append(True, (np.diff(doc[order]) != 0) | (np.diff(name[order]) != 0))[: len(order)]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    doc, name = doc[order][new], name[order][new]
    size, start = pdf["words"].map(len).to_numpy(), pdf["start"].to_numpy().astype(np.int64)
    spans = [(d, s, s + WINDOW) for d, s in zip(place[size == 0].tolist(), start[size == 0].tolist())]
    rest = size > 0
    if rest.any():
        spans += covered_windows(place[rest], start[rest], [np.asarray(w, dtype=np.int64) for w in pdf["words"][rest]])
    spans = merged(spans)
    at = np.array([d for d, _, _ in spans], dtype=np.int64)
    return pd.DataFrame({"doc": doc[at], "name": name[at], "a": np.array([a for _, a, _ in spans], dtype=np.int32), "z": np.array([z for _, _, z in spans], dtype=np.int32)})


def _kept(texts_too: bool):
    """Per changed document: words removed, the hash of what is left and, with texts_too, what is left."""
    def run(batches):
        for b in batches:
            n, sha, text = [], [], []
            for t, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                w = split(t)
                keep = np.ones(len(w), dtype=bool)
                for s in spans:
                    keep[s["a"] : s["z"]] = False
                left = b" ".join(x for x, k in zip(w, keep.tolist()) if k)
                n.append(int((~keep).sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                text.append(left.decode() if texts_too else None)
            cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(cols[: 4 + texts_too], names=["doc", "name", "removed", "left_sha", "left_text"][: 4 + texts_too])

    return run


class Dedup:
    """scan: every row, by number, with the name of its words; first: the row that stands for a name; covered(doc, name, spans): intervals in it."""

    def __init__(self, docs: DataFrame, shard_words: int = 150_000, often: int = 2_000, texts_too: bool = True):
        rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc_id"), "text", F.xxhash64("text").alias("raw"))
        self.scan = scan = stored(rows.mapInArrow(_scan, fields(("doc_id", "long"), ("raw", "long"), ("n_words", "long"), ("x", "long"), ("y", "long"), ("sha", "string"))).withColumn("row", F.monotonically_increasing_id()))
        least = scan.where(f"n_words >= {WINDOW}").groupBy("x", "y").agg(F.min(F.struct("doc_id", "raw", "row")).alias("f"))
        self.first = least.select("x", "y", F.col("f.doc_id").alias("first"), F.col("f.raw").alias("first_raw"), F.col("f.row").alias("first_row"))
        occ = rows.select("text").mapInArrow(_occurrences, fields(("key", "long"), ("name", "long"), ("lo", "int"), ("hi", "int"), ("sure", "boolean")))
        target = F.when(F.col("sure"), F.xxhash64("name", "lo")).otherwise(F.xxhash64("key"))
        rep = occ.repartition(target).sortWithinPartitions("sure", "key", "name", "lo").mapInArrow(_repeated, fields(("name", "long"), ("lo", "int"), ("hi", "int"), ("key", "long")))
        rep = stored(rep)
        hot = rep.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > often).select("key", F.lit(True).alias("hot"))
        hot = stored(hot)
        rep_hot = rep.join(broadcast_if_small(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        ranges = rep_hot.groupBy("name").agg(F.collect_set(F.struct("lo", "hi", "key", "hot")).alias("ranges"))
        ranges = ranges.join(self.first.select(F.col("x").alias("name"), "first", "first_raw"), "name")
        texts = rows.join(ranges, (rows["doc_id"] == ranges["first"]) & (rows["raw"] == ranges["first_raw"]))
        # One row for each name, on the join's own keys; the row can repeat.
        self.texts = stored(texts.groupBy("doc_id", "raw", "name").agg(F.first("text").alias("text"), F.first("ranges").alias("ranges")).select("doc_id", "name", "text", "ranges"))
        total = rep.agg(F.sum(F.col("hi") - F.col("lo") + WINDOW)).first()[0] or 0
        shards = max(1, -(-int(total) // shard_words))
        seg = self.texts.mapInArrow(_segments, fields(("key", "long"), ("doc", "long"), ("name", "long"), ("start", "int"), ("words", T.ArrayType(T.LongType()))))
        found = seg.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(lambda pdf: _search(pdf), fields(("doc", "long"), ("name", "long"), ("a", "int"), ("z", "int")))
        self.covered = found.groupBy("doc", "name").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
        out = [("doc", "long"), ("name", "long"), ("removed", "long"), ("left_sha", "string"), *([("left_text", "string")] if texts_too else [])]
        self.changed = stored(self.texts.select(F.col("doc_id").alias("doc"), "name", "text").join(self.covered, ["doc", "name"]).select("doc", "name", "text", "spans").mapInArrow(_kept(texts_too), fields(*out)))
        forget(rep, hot, self.texts)


def digest(docs: DataFrame) -> DataFrame:
    d = Dedup(docs, texts_too=False)
    copies = F.coalesce(F.col("first_row") != F.col("row"), F.lit(False))
    out = d.scan.join(d.first, ["x", "y"], "left").withColumn("copy", copies)
    out = out.join(d.changed.select("doc", "name", "removed", "left_sha"), (F.col("doc") == F.col("doc_id")) & (F.col("name") == F.col("x")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.when(F.col("doc_id") != FIRST, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), empty).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    )
