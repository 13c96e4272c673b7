"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct five-word shingles. Equal sets form one class. Each class posts the shingles of its
prefix (all but the last 0.8 n in a global order), with its size and the shingle's position: two sets of similarity 0.8
share one of these. The order is by hash, but shingles that stand in more documents than chance explains come last, by count;
any order gives the same links, this one keeps lists short. A list is the postings of one shingle by several sets; its
smallest set leads it.

Index-level skipping: a shingle of a set's region (the low hashes, which every set posts) that stands in no list stands
in no other set. That bounds a set's overlap with any other; members that cannot link by it leave their lists at once. Two
members of a list are candidates only if their sizes, bounds and positions, as those of their first common shingle, allow
the needed overlap. Members of a long list stand in blocks by size; a member
goes on only if some block of its list that has another component holds a position that allows the overlap, so blocks are
skipped by their smallest position, unread.

Answer-level skipping: every set is first compared with the leaders of its lists alone. Links through leaders make
components, and only pairs across components go on. In a list of up to `small` sets these pairs are verified one by one,
unless the two similarities to the leader, x and y, rule them out (|x - y| over 0.2; Jaccard distance is a metric), or
their signatures do, bitmaps that bound the overlap from above; short ones (sketches) stand beside each posting, so most
pairs end where the list is read. In
the longer lists of a leader X a set's answers are derived from X's: with the shingles that A lacks and those it has
beyond X, |A and B| = |X| - |X\\A| - |X\\B| + |(X\\A) and (X\\B)| + |(A\\X) and (B\\X)|. So blocks of such differences
meet, never whole sets, and one matrix product gives all overlaps of two blocks. A task hands on a spanning forest
of the components that it joins.

Null or wordless texts: empty set, no link. Fewer words than five: the whole sequence is the one shingle. Very long texts
are taken whole; a batch of sets is bounded by rows, a block by bytes. Repeated rows and ties are equal sets, and repeated
doc_ids keep a row each. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, fields, forget, joined_roots, small_batches, stored
from .words import grams, sequence, word_hashes

K = 5
SMALL = 512
SKETCH = 16  # words of 64 bits
COUNT_BITS = 22
NUM, DEN = 80, 100
REGION = np.uint64(0.18 * 2**64)  # hashes below it are posted by every set, unless often met
STEP = 128  # rows hashed at a time


def _row_sets(column):
    """Sorted distinct shingle hashes of each whole text."""
    for lo in range(0, len(column), STEP):
        h, begin = word_hashes(column.slice(lo, STEP), True)
        g = grams(h, K)
        for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()):
            if z - a >= K:
                s = np.sort(g[a : z - K + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            else:
                yield np.array([sequence(h[a:z])], dtype=np.uint64) if z > a else np.zeros(0, dtype=np.uint64)


def set_id(s: np.ndarray) -> int:
    return int(np.array([sequence(s)]).view(np.int64)[0])


def _scan(batches):
    """doc_id, n, sid for each row, sig for each set new to this task; and, with a null n, a count for each slot of shingles that is often met in it."""
    count, seen = np.zeros(1 << COUNT_BITS, dtype=np.int32), set()
    for b in batches:
        n, sid, sig = [], [], []
        for s in _row_sets(b.column(1)):
            n.append(len(s))
            sid.append(set_id(s) if len(s) else None)
            sig.append(None)
            if len(s) and sid[-1] not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sid[-1])
                sig[-1] = signature(s)
                np.add.at(count, (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "sid", "sig"])
    often = np.nonzero(count > 1 + count.mean() + math.sqrt(count.mean()))[0]
    yield pa.RecordBatch.from_arrays([pa.array(often, pa.int64()), pa.nulls(len(often), pa.int64()), pa.array(count[often], pa.int64()), pa.nulls(len(often), pa.binary())], names=["doc_id", "n", "sid", "sig"])


def above(reports: int, mean: float) -> float:
    """More than chance adds up to in a slot, where tasks have sent so many reports of this mean to all slots."""
    each = reports / (1 << COUNT_BITS)
    return 3 + mean * (each + 4 * math.sqrt(each))


def often_slots(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots that hold more than chance explains, and their counts: at most 2 ** COUNT_BITS numbers each, whatever the input.

    A task reports any slot a little over its mean; only the sums over all tasks tell a passage that stands in a few
    documents of each task from chance.
    """
    reports = scan.where("n is null")
    sent, mean = reports.agg(F.count(F.lit(1)), F.avg("sid")).first()
    got = reports.groupBy("doc_id").agg(F.sum("sid").alias("c")).where(F.col("c") > F.lit(above(sent, mean or 0.0))).toPandas()
    slots, counts = got["doc_id"].to_numpy(np.int64), got["c"].to_numpy(np.int64)
    order = np.argsort(slots)
    return slots[order], counts[order]


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _postings(often):
    """key, sid, n, p for the prefix of every set, and for the rest of its region, if that goes on; z is the region's length.

    The region's shingles come first in the order and are posted by every set that has them, so one that stands in no
    list stands in no other set. A copy in the same task posts nothing new.
    """
    def run(batches):
        (slots, counts), seen = often.value, set()
        for b in batches:
            keys, sids, sizes, places, regions = [], [], [], [], []
            for s in _row_sets(b.column(0)):
                sid = set_id(s) if len(s) else None
                if sid is None or sid in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sid)
                top, n = prefix_length(len(s)), len(s)
                z = int(np.searchsorted(s, REGION))
                if len(slots):
                    slot = (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
                    at = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
                    rank = np.where(slots[at] == slot, counts[at], 0)
                    last = np.nonzero(rank)[0]
                    z -= int((last < z).sum())
                    if len(last):  # the others keep their order by hash
                        s = np.concatenate([s[rank == 0], s[last[np.argsort(rank[last], kind="stable")]]])
                top = max(top, z)
                keys.append(s[:top])
                sids.append(np.full(top, sid, dtype=np.int64))
                sizes.append(np.full(top, n, dtype=np.int32))
                places.append(np.arange(top, dtype=np.int32))
                regions.append(np.full(top, z, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (sids, sizes, places, regions))], names=["key", "sid", "n", "p", "z"])

    return run


def shared_lists(posts: DataFrame) -> DataFrame:
    """key, lead, a, n, p, most, and the leader's _n, _p and _most: the lists in which some members may link.

    Postings move once; those of lists of several sets, few of all, once more. most bounds a set's overlap with any other:
    its size less the shingles of its region that stand in no list. The smaller set of a linked pair needs most >= 8/9 of its
    size, so a list without such a set goes, as do members that are too far from being the larger one.
    """
    w = Window.partitionBy("key")
    several = posts.select("*", F.min("sid").over(w).alias("_lo"), F.max("sid").over(w).alias("_hi")).where("_lo < _hi")
    several = stored(several.dropDuplicates(["key", "sid"]).select("key", F.col("sid").alias("a"), "n", "p", "z"))
    most = stored(several.groupBy("a").agg((F.max("n") - F.max("z") + F.count_if(F.col("p") < F.col("z"))).alias("most")))
    rows = several.drop("z").join(broadcast_if_small(most, 200_000), "a")
    as_small = has_room("most", "n", "n")
    rows = rows.withColumn("_least", F.min(F.when(as_small, F.col("n"))).over(w)).where(as_small | has_room("most", "n", "_least"))
    w = w.orderBy("a").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    led = rows.select("key", "a", "n", "p", "most", F.first("a").over(w).alias("lead"), F.last("a").over(w).alias("_last"), *[F.first(c).over(w).alias(f"_{c}") for c in ("n", "p", "most")])
    out = stored(led.where("lead < _last").drop("_last"))
    forget(several, most)
    return out


def has_room(most: str, n: str, m: str) -> Column:
    """Whether an overlap of `most` is enough for sets of n and m elements."""
    return F.col(most).cast("long") * (NUM + DEN) >= (F.col(n).cast("long") + F.col(m)) * NUM


def may_link(n1, p1, n2, p2, least):
    """Whether sizes and positions of a common shingle, if it is the first, leave room for enough overlap; n1 <= n2. For arrays and columns."""
    return (DEN * n1 >= NUM * n2) & (least(n1 - p1, n2 - p2) * (NUM + DEN) >= NUM * (n1 + n2))


def _open_pairs(batches):
    """From members of short lists, sorted by key: candidate pairs (a, b) across components, whose sketches leave room for a link."""
    held = None

    def flush(c):
        key, sid, n, p, comp, sim, sketch, *most = c
        most = most[0] if most else n
        starts = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
        size, out = np.diff(np.append(starts, len(key))), []
        for m in np.unique(size[size > 1]):
            rows = starts[size == m][:, None] + np.arange(m)[None, :]
            i, j = np.triu_indices(m, 1)
            for lo in range(0, len(rows), max(1, 400_000 // int(m * m))):
                at = rows[lo : lo + max(1, 400_000 // int(m * m))]
                x, y = at[:, i].ravel(), at[:, j].ravel()
                x, y = np.where(n[x] <= n[y], x, y), np.where(n[x] <= n[y], y, x)
                ok = may_link(n[x], p[x], n[y], p[y], np.minimum) & (comp[x] != comp[y]) & ~(np.abs(sim[x] - sim[y]) > (DEN - NUM) / DEN + 1e-9)
                x, y = x[ok], y[ok]
                ok = np.minimum(most[x], most[y]).astype(np.int64) * (NUM + DEN) >= NUM * (n[x].astype(np.int64) + n[y])
                x, y = x[ok], y[ok]
                ok = room(n, sketch, x, y)
                out.append(np.column_stack([sid[x[ok]], sid[y[ok]]]))
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.zeros((0, 2), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        if len(cols[0]):
            last = np.nonzero(cols[0] != cols[0][-1])[0]
            last = int(last[-1]) + 1 if len(last) else 0  # the last list may go on
            held = [c[last:] for c in cols]
            if last:
                yield flush([c[:last] for c in cols])
    if held is not None:
        yield flush(held)


def signature(s: np.ndarray) -> bytes:
    """A bitmap of the set's hashes by their low bits, four to eight bits for each element."""
    m = 1 << max(8, int(4 * len(s) - 1).bit_length())
    bits = np.zeros(m, dtype=bool)
    bits[(s & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def common_at_most(n: int, m: int, x: bytes, y: bytes) -> int:
    """A bound on the overlap of sets of n and m elements: a slot that one lacks is an element that it lacks."""
    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    least = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, least), axis=0) for v in (x, y))
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def folded(v: np.ndarray, n: int) -> np.ndarray:
    """The bitmap v of 64-bit words on n of them: a slot is the union of those that fall on it."""
    return np.bitwise_or.reduce(v.reshape(-1, n), axis=0)


def _sketches(batches):
    """a, sketch: signatures at a quarter of their length, 128 bytes at most, to go with each posting of a short list."""
    for b in batches:
        each = [np.frombuffer(v, dtype=np.uint64) for v in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([folded(v, min(SKETCH, max(4, len(v) // 4))).tobytes() for v in each], pa.binary())], names=["a", "sketch"])


def room(n: np.ndarray, sketch: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of rows (x, y) of sets of n elements, whether their sketches leave room for a link."""
    words = np.array([len(v) // 8 for v in sketch])
    least, fit = np.minimum(words[x], words[y]), np.ones(len(x), dtype=bool)
    for w in np.unique(least).tolist():
        for at in np.array_split(at := np.nonzero(least == w)[0], -(-len(at) // 65_536)):
            rows, where = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
            bits = np.stack([folded(np.frombuffer(sketch[r], dtype=np.uint64), w) for r in rows.tolist()])
            u, v = bits[where[: len(at)]], bits[where[len(at) :]]
            most = np.minimum(n[x[at]] - np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64), n[y[at]] - np.bitwise_count(v & ~u).sum(axis=1, dtype=np.int64))
            fit[at] = most * (NUM + DEN) >= NUM * (n[x[at]].astype(np.int64) + n[y[at]])
    return fit


def _near_signatures(batches):
    for b in batches:
        fit = [common_at_most(n, m, x, y) * (NUM + DEN) >= NUM * (n + m) for n, m, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(fit, pa.bool_()))


def plausible(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs whose signatures leave room for a link."""
    left, right = (sigs.select(F.col("sid").alias(i), F.col("n").alias(f"n_{i}"), F.col("sig").alias(f"sig_{i}")) for i in ("a", "b"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_near_signatures, fields(("a", "long"), ("b", "long"))))


def _text_sets(batches):
    for b in batches:
        sets = list(_row_sets(b.column(1)))
        own = pa.array([len(s) > 0 and set_id(s) == sid for s, sid in zip(sets, b.column(0).to_pylist())], pa.bool_())  # not a namesake's text
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "items"]).filter(own)


def sets_of(ids: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """sid, items of the wanted sets, from the whole texts of the documents that stand for them."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = stored(first.join(ids, "sid", "left_semi").withColumnRenamed("doc_id", "_id"))
    side = broadcast_if_small(wanted)
    texts = texts.join(side, texts["doc_id"].eqNullSafe(side["_id"])).select("sid", "text")
    out = stored(texts.mapInArrow(_text_sets, fields(("sid", "long"), ("items", "binary"))).dropDuplicates(["sid"]))
    forget(wanted)
    return out


def _compared(differences: bool):
    """a, b, both, every for pairs with their sets; with differences, also what b lacks of a and has beyond it."""
    def run(batches):
        for b in batches:
            both, every, minus, plus = [], [], [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                in_y = y[at] == x
                n = int(in_y.sum())
                both.append(n)
                every.append(len(x) + len(y) - n)
                if differences:
                    minus.append(x[~in_y].tobytes())
                    plus.append(np.setdiff1d(y, x, assume_unique=True).tobytes())
            cols = [b.column(0), b.column(1), pa.array(both, pa.int64()), pa.array(every, pa.int64())]
            more = [pa.array(minus, pa.binary()), pa.array(plus, pa.binary())] if differences else []
            yield pa.RecordBatch.from_arrays(cols + more, names=["a", "b", "both", "every"] + ["minus", "plus"][: len(more)])

    return run


def compared(pairs: DataFrame, docs: DataFrame, first: DataFrame, differences: bool = False) -> DataFrame:
    """Pairs (a, b) of sets compared exactly."""
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    with small_batches(pairs.sparkSession, 64):
        sets = sets_of(ids, docs, first)
        left, right = sets.select(F.col("sid").alias("a"), F.col("items").alias("x")), sets.select(F.col("sid").alias("b"), F.col("items").alias("y"))
        more = [("minus", "binary"), ("plus", "binary")] if differences else []
        out = stored(pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_compared(differences), fields(("a", "long"), ("b", "long"), ("both", "long"), ("every", "long"), *more)))
    forget(sets)
    return out


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements any two of these sets have in common: one matrix product."""
    x, y = (np.concatenate(v) if v else np.zeros(0, dtype=np.uint64) for v in (left, right))
    both = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    places = []
    for flat, parts in ((x, left), (y, right)):
        row = np.repeat(np.arange(len(parts)), [len(v) for v in parts])
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        fit = both[at] == flat if len(both) else np.zeros(0, dtype=bool)
        places.append((row[fit], at[fit]) if len(both) else (row[:0], row[:0]))
    for lo in range(0, len(both), 4096):
        m = []
        for (row, at), parts in zip(places, (left, right)):
            dense = np.zeros((len(parts), min(4096, len(both) - lo)), dtype=np.float32)
            use = (at >= lo) & (at < lo + 4096)
            dense[row[use], at[use] - lo] = 1
            m.append(dense)
        out += np.rint(m[0] @ m[1].T).astype(np.int64)
    return out


def _derived(batches):
    """From two blocks of one leader's sets (or one twice): a link for every component that they join to another."""
    def side(part):
        longs = [np.array([r[k] for r in part], dtype=np.int64) for k in ("n", "both", "component")]
        sets = [[np.frombuffer(r[k], dtype=np.uint64) for r in part] for k in ("minus", "plus")]
        return (*longs, *sets, np.array([r["sim"] for r in part]))

    for b in batches:
        out = []
        for lead_n, same, left, right in zip(*(b.column(i).to_pylist() for i in range(4))):
            n, have, c, minus, plus, sim = side(left)
            n2, have2, c2, minus2, plus2, sim2 = side(left if same else right)
            need = NUM * (n[:, None] + n2[None, :])
            ok = (c[:, None] != c2) & (DEN * np.minimum(n[:, None], n2) >= NUM * np.maximum(n[:, None], n2)) & (np.abs(sim[:, None] - sim2) <= (DEN - NUM) / DEN + 1e-9)
            ok &= (np.minimum(have[:, None], have2) + np.minimum((n - have)[:, None], n2 - have2)) * (NUM + DEN) >= need
            if same:
                ok = np.triu(ok, 1)
            rows, cols = np.nonzero(ok.any(axis=1))[0], np.nonzero(ok.any(axis=0))[0]
            if not len(rows):
                continue
            pick = lambda v, at: [v[i] for i in at.tolist()]
            overlap = have[rows, None] + have2[cols] - lead_n + shared(pick(minus, rows), pick(minus2, cols)) + shared(pick(plus, rows), pick(plus2, cols))
            i, j = np.nonzero(ok[np.ix_(rows, cols)] & (overlap * (NUM + DEN) >= need[np.ix_(rows, cols)]))
            if len(i):
                out.append(np.column_stack(joined_roots(c[rows[i]], c2[cols[j]])))  # a component's name is one of its sets
        if out:
            out = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])


BAND = math.log(DEN / NUM)


def with_partners(members: DataFrame) -> DataFrame:
    """Members of long lists that some other component's block of the same list may link with, by size and position."""
    rows = members.withColumn("band", F.floor(F.log("n") / BAND).cast("int"))
    blocks = rows.groupBy("key", "band").agg(F.min("p").alias("p0"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    near = blocks.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    # As the smaller set, its own position must allow the link; as the larger one, the block's smallest position must.
    fits = lambda n, p: p * (NUM + DEN) <= n * (DEN - NUM)
    ok = ((F.col("lo") != F.col("component")) | (F.col("hi") != F.col("component"))) & (fits(F.col("n"), F.col("p")) & (F.col("n1") >= F.col("n")) | fits(F.col("n1"), F.col("p0")) & (F.col("n0") <= F.col("n")))
    return rows.join(near, ["key", "band"]).where(ok).select("lead", "a").distinct()


def derived_links(wanted: DataFrame, comps: DataFrame, docs: DataFrame, first: DataFrame, block_bytes: int) -> DataFrame:
    """Links (u, v) between sets of one leader (wanted: lead, a) in different components, from their answers to the leader."""
    # The leader compares with itself too: it lacks nothing.
    known = compared(wanted.select(F.col("lead").alias("a"), F.col("a").alias("b")), docs, first, differences=True)
    rows = known.select(F.col("a").alias("lead"), F.col("b").alias("a"), "both", "every", "minus", "plus")
    rows = rows.withColumn("n", F.col("both") + F.expr("length(plus) div 8")).withColumn("lead_n", F.col("both") + F.expr("length(minus) div 8"))
    rows = rows.join(comps.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a")).withColumn("sim", F.col("both") / F.col("every"))
    rows = rows.withColumn("band", F.floor(F.log("n") / BAND).cast("int"))
    size = rows.groupBy("lead", "band").agg(F.ceil(F.sum(F.greatest(F.length("minus") + F.length("plus"), F.lit(1024))) / block_bytes).cast("int").alias("blocks"))
    size = stored(size)
    blocks = rows.join(size, ["lead", "band"]).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    blocks = stored(blocks.groupBy("lead", "lead_n", "band", "salt").agg(F.collect_list(F.struct("n", "both", "component", "sim", "minus", "plus")).alias("part")))
    forget(known)
    upto = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = size.withColumn("salt", F.explode(upto)).withColumn("salt2", F.explode(F.sequence(F.col("salt"), F.col("blocks") - 1))).select("lead", "band", "salt", F.col("band").alias("band2"), "salt2")
    other = size.select("lead", (F.col("band") - 1).alias("band"), F.col("band").alias("band2"), F.explode(upto).alias("salt2"))
    next_ = size.withColumn("salt", F.explode(upto)).join(other, ["lead", "band"]).select("lead", "band", "salt", "band2", "salt2")
    pairs = own.union(next_)
    right = blocks.select("lead", F.col("band").alias("band2"), F.col("salt").alias("salt2"), F.col("part").alias("other"))
    same = (F.col("band") == F.col("band2")) & (F.col("salt") == F.col("salt2"))
    both = pairs.join(blocks, ["lead", "band", "salt"]).join(right, ["lead", "band2", "salt2"]).select("lead_n", same.alias("same"), "part", F.when(~same, F.col("other")).alias("other"))
    with small_batches(docs.sparkSession, 4):
        out = stored(both.mapInArrow(_derived, fields(("u", "long"), ("v", "long"))))
    forget(size, blocks)
    return out


def join(docs: DataFrame, small: int = SMALL, block_bytes: int = 1 << 20) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    with small_batches(spark, 1024):
        scan = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, fields(("doc_id", "long"), ("n", "long"), ("sid", "long"), ("sig", "binary"))))
        often = spark.sparkContext.broadcast(often_slots(scan))
        lists = shared_lists(docs.select("text").mapInArrow(_postings(often), fields(("key", "long"), ("sid", "long"), ("n", "int"), ("p", "int"), ("z", "int"))))
    sets = scan.where("n is not null").select("doc_id", "n", "sid")
    first = stored(sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id")))
    small_first = F.col("n") <= F.col("_n")
    pick = lambda x, y: F.when(small_first, F.col(x)).otherwise(F.col(y))
    with_lead = lists.where("a <> lead").where(has_room("most", "n", "_n") & has_room("_most", "n", "_n")).where(may_link(pick("n", "_n"), pick("p", "_p"), pick("_n", "n"), pick("_p", "p"), F.least))
    in_lists = lists.select(F.col("a").alias("sid")).distinct()
    sigs = stored(scan.where("sig is not null").select("sid", "n", "sig").join(in_lists, "sid", "left_semi").dropDuplicates(["sid"]))
    done = compared(plausible(with_lead.select(F.col("lead").alias("a"), F.col("a").alias("b")).distinct(), sigs), docs, first)
    linked = F.col("both") * DEN >= F.col("every") * NUM
    comps = stored(components(done.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))))
    # Pairs across components, in lists that hold several.
    now = lists.drop("_n", "_p", "_most").join(comps.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    open_ = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("key", "size")
    now = now.join(open_, "key")
    known = done.select(F.col("a").alias("lead"), F.col("b").alias("a"), (F.col("both") / F.col("every")).alias("sim"))
    now = stored(now.join(known, ["lead", "a"], "left").withColumn("sim", F.when(F.col("a") == F.col("lead"), 1.0).otherwise(F.coalesce("sim", F.lit(float("nan"))))))
    sketches = sigs.select(F.col("sid").alias("a"), "sig").mapInArrow(_sketches, fields(("a", "long"), ("sketch", "binary")))
    short = now.where(F.col("size") <= small).join(sketches, "a").select("key", "a", "n", "p", "component", "sim", "sketch", "most").repartition("key").sortWithinPartitions("key", "a")
    pairs = short.mapInArrow(_open_pairs, fields(("a", "long"), ("b", "long"))).distinct()
    pairs = plausible(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"), sigs)
    more = compared(pairs, docs, first)
    links = more.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
    wanted = stored(with_partners(now.where(F.col("size") > small)))
    derived = None
    if not wanted.isEmpty():
        derived = derived_links(wanted, comps, docs, first, block_bytes)
        links = links.union(derived)
    if not links.isEmpty():
        old, comps = comps, stored(components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links)))
        forget(old)
    forget(lists, sigs, done, now, pairs, more, wanted, *([derived] if derived is not None else []))
    # Ids of sets to the smallest document of their component, then one join with the documents.
    roots = first.join(comps.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "doc_id", F.coalesce("component", "sid").alias("root"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = roots.join(least, "root").select("sid", "component_id")
    full = sets.where("sid is not null").join(by_set, "sid").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return full.union(sets.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
