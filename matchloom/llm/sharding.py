"""Balanced label propagation into shards (native: DataFrame functions only); law "rows".

Documents with the same link value (equal texts) are neighbours. Linked documents begin in seeded shards; in each round
a group votes with one row per shard, its members move to the shard that holds most of them, and a shard admits groups
by a seeded draw at the rate that its quota leaves room for, expected leavers counted as room. Rounds go on until no
group is split or their number stops falling. Groups larger than half a shard are cut into seeded parts first.

Then whole groups are seated: a shard keeps what ends within its quota, largest first. All other groups, those still
split too, are laid out in a row over the places left. Those that would lie across the end of a shard, fewer than there
are shards, go where they fit, and only those that fit nowhere are cut. Unlinked documents come last and fill the places
left, so that the counts of any two shards differ by one at most.

Null text: size 16, CRC 0, no neighbours. Empty texts are equal texts. Repeated rows each get a slot of their own.
An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import forget, high_bits, ranked, stored, unit


def _rates(room: list[int], flow: dict[tuple[int, int], int]) -> list[float]:
    """The highest rates at which shards can admit movers, flow[source, target], within their room and what leaves them."""
    demand = [0] * len(room)
    for (_, t), n in flow.items():
        demand[t] += n
    rate = [1.0 if d else 0.0 for d in demand]
    for _ in range(1000):  # falls toward the highest fixed point
        space = list(room)
        for (s, t), n in flow.items():
            space[s] += n * rate[t]
        new = [min(1.0, max(0.0, x) / d) if d else 0.0 for x, d in zip(space, demand)]
        step = max(map(abs, (x - y for x, y in zip(rate, new))), default=0.0)
        rate = new
        if step < 1e-6:
            break
    return rate


def _propagate(linked: DataFrame, quota: list[int]) -> DataFrame:
    """linked(doc_id, ..., hub, shard) after rounds of moves, until no group is split or their number stops falling."""
    r, before = 0, None
    while True:
        votes = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        w = W.partitionBy("hub")  # at most one row per shard
        order = w.orderBy(F.col("n").desc(), F.xxhash64("hub", "shard"))
        votes = votes.withColumn("all", F.sum("n").over(w)).withColumn("target", F.first("shard").over(order))
        split = stored(votes.where("n < all").select("hub", "shard", "n", "target"))
        left = split.where("shard = target").count()
        if not left or before is not None and left >= before:
            forget(split)
            return linked
        flow = {(x["shard"], x["target"]): x["n"] for x in split.where("shard <> target").groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}  # a row per two shards
        load = {x["shard"]: x["n"] for x in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        rate = _rates([q - load.get(s, 0) for s, q in enumerate(quota)], flow)
        moves = split.where("shard = target").where(unit(F.lit(r), "hub") < F.element_at(F.array(*map(F.lit, rate)), F.col("target") + 1)).select("hub", "target")
        old, linked = linked, stored(linked.join(moves, "hub", "left").withColumn("shard", F.coalesce("target", "shard")).select(linked.columns))
        forget(old, split)
        r, before = r + 1, left


def _longs(v):
    return F.array(*[F.lit(int(x)).cast("long") for x in v])


def _ends(room: list[int]) -> list[int]:
    return list(accumulate(room))


def _seat(linked: DataFrame, quota: list[int]) -> DataFrame:
    """linked with each group whole in one shard, within the quotas; shard is null in groups that must be cut."""
    units = linked.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.min("shard").alias("shard"), F.max("shard").alias("last"))
    # Larger groups first, in the buckets too.
    units = stored(units.withColumn("bucket", (63 - F.floor(F.log2("members")).cast("int")) * 4096 + high_bits(F.col("hub"), 12)))
    order = [F.col("members").desc(), "hub"]
    home = ranked(units.where("shard = last"), ["shard"], "bucket", order, "at", "members")
    home = stored(home.where(F.col("at") + F.col("members") <= F.element_at(_longs(quota), F.col("shard") + 1)).select("hub", "shard", "members"))

    def room_after(room: list[int], seated: DataFrame) -> list[int]:
        held = {x["shard"]: x["n"] for x in seated.groupBy("shard").agg(F.sum("members").alias("n")).collect()}  # a row per shard
        return [q - held.get(s, 0) for s, q in enumerate(room)]

    room = room_after(quota, home)
    ends = _longs(_ends(room))
    rest = ranked(units.join(home, "hub", "left_anti").select("hub", "members", "bucket"), [], "bucket", order, "at", "members")
    rest = rest.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col("at"))))
    rest = stored(rest.withColumn("fits", F.col("at") + F.col("members") <= F.element_at(ends, F.col("shard") + 1)).select("hub", "shard", "members", "fits"))
    laid = rest.where("fits").select("hub", "shard", "members")
    room, placed = room_after(room, laid), []
    for x in sorted(rest.where("not fits").collect(), key=lambda x: (-x["members"], x["hub"])):  # fewer rows than shards
        s = min((s for s, q in enumerate(room) if q >= x["members"]), key=lambda s: (room[s], s), default=None)
        if s is not None:
            room[s] -= x["members"]
            placed.append((x["hub"], s))
    seats = home.select("hub", "shard").union(laid.select("hub", "shard"))
    if placed:
        seats = seats.union(rest.where("not fits").select("hub", F.try_element_at(F.create_map(*[F.lit(v).cast(k) for hub, s in placed for v, k in ((hub, "long"), (s, "int"))]), F.col("hub"))))
    out = stored(linked.drop("shard").join(seats, "hub", "left"))
    forget(linked, units, home, rest)
    return out


def shard(docs: DataFrame, shards: int = 40, seed: int = 5) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("group"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("place"))
    rows = stored(rows)
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = rows.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / max(1, quota[-1] // 2)).cast("int")
    rows_in = rows.join(groups, "group", "left").withColumn("hub", F.when(F.col("members") > 1, F.xxhash64("group", F.when(parts > 1, F.pmod(F.xxhash64("place"), parts)).otherwise(0))))
    keep = ["doc_id", "size", "text_crc32", "place", "hub"]
    rows_in = stored(rows_in.select(*keep))
    forget(rows)
    linked = stored(rows_in.where("hub is not null").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(shards)).cast("int")))
    linked = _seat(_propagate(linked, quota), quota)
    # Whole groups hold a shard's first slots.
    whole = linked.where("shard is not null").withColumn("bucket", high_bits(F.col("hub"), 6) * 64 + high_bits(F.col("place"), 6))
    whole = ranked(whole, ["shard"], "bucket", ["hub", "place", "doc_id"], "slot")
    held = {x["shard"]: x["n"] for x in linked.where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
    room = [q - held.get(s, 0) for s, q in enumerate(quota)]
    ends = _ends(room)
    # Cut groups, each in one run, then the rest in a seeded order fill the open slots.
    least = ["doc_id", "size", "text_crc32", "place"]
    pool = linked.where("shard is null").select(*least, "hub").union(rows_in.where("hub is null").select(*least, "hub"))
    bucket = F.when(F.col("hub").isNull(), high_bits(F.col("place"), 12) + 4096).otherwise(high_bits(F.col("hub"), 12))
    pool = ranked(pool.withColumn("bucket", bucket), [], "bucket", ["hub", "place", "doc_id"], "rank")
    pool = pool.withColumn("shard", F.size(F.filter(_longs(ends), lambda e: e <= F.col("rank"))))
    pool = pool.withColumn("slot", F.element_at(_longs([q - e for e, q in zip(ends, quota)]), F.col("shard") + 1) + F.col("rank"))
    out = ["doc_id", "size", "text_crc32", "shard", "slot"]
    both = whole.select(*out).union(pool.select(*out))
    return both.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
