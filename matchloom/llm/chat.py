"""Chat formatting as a prefix tree of turns.

A turn is written `### role: text</turn>` and a line feed; a backslash, and the first sign of a control string, inside
a text or a role gets a backslash before it, so that the text comes back whole. Conversations that share their first
turns share those nodes of the tree: a node's name is a hash over all turns up to it. Distinct paths are sorted by
their nodes, which puts a subtree's paths side by side; a path emits the nodes that no earlier path holds, so every
node's tokens come once, depth first. Each node gets the first position id (tokens before it on its path), its offset in
the emitted stream, and the offsets of its ancestors' token intervals, which with its own earlier tokens are all that
its tokens attend to. The loss mask covers the tokens of assistant texts; heads, texts and ends are encoded apart.

Turns go by number, ties by role and text. Null text or role: empty. Null turn numbers come first. Rows without a
conv_id form one conversation with a null conv_id. Repeated conversations share all nodes and emit nothing new. An empty
table gives empty results; extra columns are ignored. A conversation is one row in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import broadcast_if_small, fields, stored

CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
IN_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:(?= )")
ESCAPED = re.compile(r"\\(.)", re.S)
END = "</turn>\n"


def escape(s: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return ESCAPED.sub(r"\1", s)


def head(role: str) -> str:
    return "### " + IN_ROLE.sub(lambda m: "\\" + m[0], role) + ": "


_TURN = re.compile(r"### ((?:[^\\:]|\\.|:(?! ))*): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation; fails if anything is left over."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def encoder(path: str | None = None):
    """A public byte-level BPE; its file's path is a parameter."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TURNS = T.ArrayType(fields(("turn", "long"), ("role", "string"), ("text", "string")))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns in order."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _paths(batches):
    for b in batches:
        conv, leaf, path = [], [], []
        for c, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            names, last = [], b""
            for t in turns:
                h = hashlib.sha256(last)
                for x in (t["role"], t["text"]):
                    raw = x.encode()
                    h.update(len(raw).to_bytes(8, "big") + raw)
                last = h.digest()[:16]
                names.append({"node": last, "role": t["role"], "text": t["text"]})
            conv.append(c)
            leaf.append(last)
            path.append(names)
        kind = pa.list_(pa.struct([("node", pa.binary()), ("role", pa.string()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(leaf, pa.binary()), pa.array(path, kind)], names=["conv_id", "leaf", "path"])


PATHS = fields(("conv_id", "long"), ("leaf", "binary"), ("path", T.ArrayType(fields(("node", "binary"), ("role", "string"), ("text", "string")))))


def _encoded(path: str | None):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            cols = [[], [], []]
            for role, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                a, body, z = enc.encode_ordinary(head(role)), enc.encode_ordinary(escape(text)), enc.encode_ordinary(END)
                cols[0].append(a + body + z)
                cols[1].append(len(a))
                cols[2].append(len(a) + (len(body) if role == "assistant" else 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["node", "tokens", "loss_from", "loss_to"])

    return run


def _hot(members: DataFrame, most: int) -> DataFrame:
    """Nodes that stand on more than `most` paths, at most one for so many rows of members, and in how many parts each is joined."""
    many = members.groupBy("node").agg(F.count(F.lit(1)).alias("paths")).where(F.col("paths") > most)
    return broadcast_if_small(stored(many.select("node", F.ceil(F.col("paths") / most).cast("int").alias("parts"))))


def _with_nodes(members: DataFrame, nodes: DataFrame, hot: DataFrame, by: str) -> DataFrame:
    """members joined with their nodes; a hot node's row is repeated for each of its parts, and its members are dealt to them by `by`."""
    left = members.join(hot, "node", "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1)))).drop("parts")
    right = nodes.join(hot, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
    return left.join(right, ["node", "part"]).drop("part")


class Formatted:
    """convs(conv_id, leaf), members(leaf, depth, node), nodes(node, depth, n, tokens, offset, position, attends...), hot(node, parts)."""

    def __init__(self, convs, members, nodes, hot):
        self.convs, self.members, self.nodes, self.hot = convs, members, nodes, hot


def format_chats(rows: DataFrame, tokenizer: str | None = None, most: int = 4096) -> Formatted:
    """The prefix tree; a node on more than `most` distinct paths, such as a common system prompt, is joined in parts."""
    paths = stored(conversations(rows).mapInArrow(_paths, PATHS))
    distinct = paths.groupBy("leaf").agg(F.min(F.struct(F.transform("path", lambda x: x["node"]).alias("names"))).alias("p")).select("leaf", F.col("p.names").alias("names"))
    # A range sort puts equal beginnings side by side; the id grows along the sorted partitions.
    ordered = stored(distinct.repartitionByRange("names").sortWithinPartitions("names").select("leaf", "names", F.monotonically_increasing_id().alias("place")))
    members = ordered.select("leaf", "place", F.posexplode("names").alias("depth", "node"))
    hot = _hot(members, most)
    owner = members.groupBy("node").agg(F.min("place").alias("place"), F.min("depth").alias("depth"))
    texts = paths.select(F.explode("path").alias("x")).select("x.*").groupBy("node").agg(F.min(F.struct("role", "text")).alias("t")).select("node", "t.role", "t.text")
    tokens = stored(texts.mapInArrow(_encoded(tokenizer), fields(("node", "binary"), ("tokens", T.ArrayType(T.IntegerType())), ("loss_from", "int"), ("loss_to", "int"))))
    sizes = stored(owner.join(tokens.select("node", F.size("tokens").alias("n")), "node").withColumn("part", F.shiftright("place", 33)))
    # Offsets: running sums inside the sorted partitions, and one number for each partition.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    w = W.partitionBy("part").orderBy("place", "depth").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("own", F.coalesce(F.sum("n").over(w), F.lit(0))).join(starts, "part").select("node", "depth", "n", (F.col("own") + F.col("start")).alias("offset"))
    placed = stored(placed)
    # Ancestors come from the path of the node's owner.
    own = owner.select("node", "place", "depth")
    line = _with_nodes(members.select("place", F.col("depth").alias("up"), "node"), placed.select("node", "n", "offset"), hot, "place")
    line = line.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("up", F.col("offset").alias("begin"), (F.col("offset") + F.col("n")).alias("end")))).alias("line"))
    up = F.filter("line", lambda x: x["up"] < F.col("depth"))
    attends = own.join(line, "place").select("node", F.transform(up, lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"))).alias("attends"))
    attends = attends.withColumn("position", F.aggregate("attends", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"]))
    nodes = stored(placed.join(tokens, "node").join(attends, "node"))
    return Formatted(paths.select("conv_id", "leaf"), members.select("leaf", "depth", "node"), nodes, hot)


def _read_back(path: str | None):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            out = [[], [], [], [], [], []]
            for leaf, nodes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw, loss = [], []
                for x in nodes:
                    raw.append(enc.decode_bytes(x["tokens"]))
                    loss.append(unescape(enc.decode_bytes(x["tokens"][x["loss_from"] : x["loss_to"]]).decode()))
                text, masked = b"".join(raw).decode(), "".join(loss)
                turns = parse(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                for col, v in zip(out, (leaf, len(turns), said.hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text))):
                    col.append(v)
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def read_back(chats: Formatted, tokenizer: str | None = None) -> DataFrame:
    """Per conversation, from the tokens that were emitted: its turns, what the loss mask holds, and its formatted length."""
    nodes = _with_nodes(chats.members, chats.nodes.select("node", "tokens", "loss_from", "loss_to"), chats.hot, "leaf")
    lines = nodes.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "tokens", "loss_from", "loss_to"))).alias("line"))
    lines = lines.mapInArrow(_read_back(tokenizer), fields(("leaf", "binary"), ("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")))
    return chats.convs.join(lines, "leaf").drop("leaf").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def digest(rows: DataFrame) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = rows.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.select("conv_id", "turn", "role", "text").unionByName(more)))
