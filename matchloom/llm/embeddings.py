"""Embedding near-duplicates by lattice hashing.

Equal vectors of a label form one class. In each of `tables` tables two orthonormal random projections to eight
dimensions, scaled and shifted, are decoded to their nearest E8 lattice points; a class stands in the cell of its own two
points and in the `probes` neighbouring cells that lie nearest to it. Two classes meet in a cell that one of them owns.
The classes of a cell are held in blocks of at most about `block` vectors; block against block, cosines in double
precision verify the candidates. Each pair of blocks is a group of its own, so a hot cell is spread over as many tasks as
it has pairs of blocks. A pair of vectors counts in the first cell where it meets, so links are counted inside the tasks,
and a task hands on degrees and a spanning forest, never all pairs.

Null labels; vectors that are null, empty, zero, or hold null or non-finite components; and rows without vec_id link
with nothing: n_links 0, component_id = vec_id. Vectors of different lengths do not link. Repeated rows are other
vectors. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, components, fields, forget, joined_roots, small_batches, stored


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        v = np.array([0.5 if m >> k & 1 else -0.5 for k in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


ROOTS = _roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    f = np.rint(x)
    odd = np.nonzero(f.sum(axis=1) % 2 != 0)[0]
    if len(odd):
        gap = x[odd] - f[odd]
        k = np.abs(gap).argmax(axis=1)
        f[odd, k] += np.where(gap[np.arange(len(odd)), k] >= 0, 1, -1)
    return f


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the nearer of D8 and D8 shifted by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def _hash(points: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(points), np.uint64(salt * 2 + 1) * np.uint64(0x9E3779B97F4A7C15))
    for c in (points * 2).astype(np.int64).astype(np.uint64).T:
        h = (h ^ c) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


class Lattice:
    def __init__(self, dim: int, tables: int, probes: int, scale: float, seed: int):
        self.tables, self.probes = tables, probes
        rng = np.random.default_rng([seed, dim])
        wide = max(dim, 16)
        self.maps = [np.linalg.qr(rng.standard_normal((wide, 16)))[0][:dim] * (scale * np.sqrt(dim / 64)) for _ in range(tables)]
        self.shifts = [rng.random(16) for _ in range(tables)]

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes): the own cell, then the probed ones."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for t in range(self.tables):
                x = unit @ self.maps[t] + self.shifts[t]
                own, near = [], []
                for b in range(2):
                    y = x[:, 8 * b : 8 * b + 8]
                    p = decode_e8(y)
                    gap = ((y - p) ** 2).sum(axis=1)[:, None] - 2 * (y - p) @ ROOTS.T + 2  # squared distances to the neighbours
                    best = np.argsort(gap, axis=1, kind="stable")[:, : self.probes]
                    own.append(p)
                    near.append((p, best, np.take_along_axis(gap, best, axis=1) - ((y - p) ** 2).sum(axis=1)[:, None]))
                a, b = _hash(own[0], 2 * t), _hash(own[1], 2 * t + 1)
                out[:, t, 0] = a + b
                extra = np.concatenate([near[0][2], near[1][2]], axis=1)
                cells = np.concatenate([np.stack([_hash(near[0][0] + ROOTS[near[0][1][:, k]], 2 * t) + b for k in range(self.probes)], axis=1), np.stack([a + _hash(near[1][0] + ROOTS[near[1][1][:, k]], 2 * t + 1) for k in range(self.probes)], axis=1)], axis=1)
                pick = np.argsort(extra, axis=1, kind="stable")[:, : self.probes]
                out[:, t, 1:] = np.take_along_axis(cells, pick, axis=1)
        return out


def _vectors(column) -> list[np.ndarray]:
    return [np.asarray(v, dtype=np.float64) for v in column.to_pylist()]


def _cells(settings):
    def run(batches):
        lattices = {}
        for b in batches:
            ids, vecs = np.array(b.column(0).to_pylist(), dtype=np.int64), _vectors(b.column(1))
            dims = np.array([len(v) for v in vecs])
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                x = np.array([vecs[i] for i in at])
                x /= np.linalg.norm(x, axis=1)[:, None]
                lat = lattices.setdefault(dim, Lattice(dim, *settings))
                k = lat.keys(x)
                n = k.shape[1] * k.shape[2]
                own = np.tile(np.arange(n) % k.shape[2] == 0, len(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], n)), pa.array(k.reshape(-1).view(np.int64)), pa.array(own)], names=["rep", "cell", "own"])

    return run


def _members(column):
    """Of a list column of (salt, rep, v, n): bounds of the rows, salts, reps, n, bounds of the vectors, all components."""
    flat = column.values
    vec = flat.field("v")
    return column.offsets.to_numpy(), *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("salt", "rep", "n")), vec.offsets.to_numpy(), vec.values.to_numpy(zero_copy_only=False).astype(np.float64)


def _hits(batch, least: float):
    """Per vector length: linked members (i, j) of the batch, with the cell where each pair was found; unit vectors by member."""
    cells, first, second = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    rows, salts, reps, weights, bounds, values = _members(batch.column(3))
    found, units = {}, {}
    for r in range(len(cells)):
        lo, hi = rows[r], rows[r + 1]
        dim = int(bounds[lo + 1] - bounds[lo])
        x = values[bounds[lo] : bounds[hi]].reshape(hi - lo, dim)
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        if first[r] == second[r]:
            i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
        else:
            left = salts[lo:hi] == first[r]
            a, z = np.nonzero(left)[0], np.nonzero(~left)[0]
            i, j = np.nonzero(x[a] @ x[z].T >= least)
            i, j = a[i], z[j]
        if len(i):
            found.setdefault(dim, []).append((i + lo, j + lo, np.full(len(i), cells[r])))
            units.setdefault(dim, []).append((np.arange(lo, hi), x))
    return reps, weights, found, units


def _verify(settings, least: float, most: int = 1 << 16):
    """Block against block: degrees (kind 0: rep, links) and a spanning forest (kind 1: rep, rep)."""
    def links(lattice, reps, units, found):
        """Of the pairs, those that are found in the first cell where they meet; keys are made once for each vector of the batch."""
        at, x = np.concatenate([a for a, _ in units]), np.concatenate([x for _, x in units])
        ids, one, back = np.unique(reps[at], return_index=True, return_inverse=True)
        row = np.zeros(len(reps), dtype=np.int64)
        row[at] = back
        keys = lattice.keys(x[one])
        i, j, cell = (np.concatenate(c) for c in zip(*found))
        for k in range(0, len(i), most):
            a, z = i[k : k + most], j[k : k + most]
            ka, kz = keys[row[a]], keys[row[z]]
            in_own_a, in_own_z = (kz == ka[:, :, :1]).any(axis=2), (ka == kz[:, :, :1]).any(axis=2)
            n, t = np.arange(len(a)), (in_own_a | in_own_z).argmax(axis=1)
            oa, oz, in_a, in_z = ka[n, t, 0], kz[n, t, 0], in_own_a[n, t], in_own_z[n, t]
            first = np.where(in_a & in_z, np.minimum(oa, oz), np.where(in_a, oa, oz))
            mine = first == cell[k : k + most].view(np.uint64)
            yield a[mine], z[mine]

    def run(batches):
        lattices = {}
        for b in batches:
            reps, weights, found, units = _hits(b, least)
            for dim in found:
                lattice = lattices.setdefault(dim, Lattice(dim, *settings))
                for i, j in links(lattice, reps, units[dim], found[dim]):
                    who, at = np.unique(np.concatenate([reps[i], reps[j]]), return_inverse=True)
                    degree = np.zeros(len(who), dtype=np.int64)
                    np.add.at(degree, at, np.concatenate([weights[j], weights[i]]))
                    node, root = joined_roots(reps[i], reps[j]) if len(i) else (who, who)
                    kind = np.repeat(np.array([0, 1], dtype=np.int32), [len(who), len(node)])
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([who, node])), pa.array(np.concatenate([degree, root]))], names=["kind", "a", "b"])

    return run


def near_duplicates(rows: DataFrame, least: float = 0.93, tables: int = 10, probes: int = 4, scale: float = 4.0, block: int = 256, seed: int = 3) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept. Links between 0.93 and 1 are found with a recall of at least 0.98 in the tests."""
    settings = (tables, probes, scale, seed)
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", "label", F.when(fine, F.col("embedding")).alias("embedding"))
    classes = stored(rows.where("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    cells = classes.select("rep", "embedding").mapInArrow(_cells(settings), fields(("rep", "long"), ("cell", "long"), ("own", "boolean")))
    named = classes.select("rep", "label", F.size("embedding").alias("dim"))
    cells = stored(cells.join(named, "rep").select(F.xxhash64("label", "dim", "cell").alias("key"), "cell", "rep", "own"))
    full = stored(cells.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("owned")).where("size > 1 and owned").select("key", "size"))
    # Cells of very many vectors, at most one for so many rows, are looked up where the rows are; the others by shuffle.
    hot = broadcast_if_small(full.where(F.col("size") > 16 * block))
    members = cells.join(hot, "key").unionByName(cells.join(hot, "key", "left_anti").join(full, "key"))
    # Every pair of a cell's blocks is a group of its own: a vector goes to each group that its block is in.
    blocks = F.ceil(F.col("size") / block).cast("int")
    members = members.select("cell", "key", "rep", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    members = members.join(classes.select("rep", F.col("embedding").alias("v"), "n"), "rep")
    group = [F.least("salt", "with").alias("first"), F.greatest("salt", "with").alias("second")]
    pairs = members.groupBy("key", "cell", *group).agg(F.collect_list(F.struct("salt", "rep", "v", "n")).alias("part")).where(F.size("part") > 1)
    with small_batches(rows.sparkSession, 128):
        found = stored(pairs.select("cell", "first", "second", "part").mapInArrow(_verify(settings, least), fields(("kind", "int"), ("a", "long"), ("b", "long"))))
    forget(full, cells)
    degree = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    roots = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    each = classes.join(degree, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    each = each.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(each, ["label", "embedding"], "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))
