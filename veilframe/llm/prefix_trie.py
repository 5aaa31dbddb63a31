"""Prefix trie of conversations: the Cartesian tree over the LCP array of the sorted conversations.

Conversations are sorted by their turns; between neighbours stands the length of their longest common prefix (LCP) in
turns. The Cartesian tree over these numbers is the trie: for an LCP value, the nearest smaller values to both sides bound
the interval of conversations that share it; nodes of one interval bound and equal LCP are one, depths that no LCP names are
the unary nodes between a node and its parent, and all numbers of a node are sums or minima over its interval.

All nearest smaller values are found in parallel over blocks, the range partitions of the sort. A block is one stream with a
stack as deep as one conversation; it finishes the nodes that lie inside it and hands on a partial node for each depth that
touches its first or last row. Blocks meet only in their summaries (a row a block: first and last conversation, smallest LCP):
from these follow the LCPs across borders and, by the block minima, in which block a partial node begins. Partial nodes of one
beginning are merged by sums. Nothing else is gathered; what grows with the number of conversations is only ever sorted,
streamed or joined.

A turn is a 16-byte digest of role and text (SHA-256, cut), so texts leave their tasks only as digests and lengths. One
conversation is one row: 16 bytes a turn and 8 for its length.

Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out. Turns come by number, null
first; turns of equal number by digest, repeated rows are turns of their own. A conversation may be empty after rebuilding;
it then ends at the root. No conversations have no trie: no rows, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions_for

WIDTH = 16  # bytes of a turn's digest
SHARED = 9  # a rebuilt conversation takes fewer than so many turns from its neighbour
_ROWS = 20_000  # rows of a batch that a block hands on

# kind: 0 finished node, 1 partial node. start: its first row within the block, the third part of its name (block, depth, start)
_NODE = "kind byte, block int, depth int, start long, left boolean, right boolean, n long, least long, children long, leaves long, psum long, before long, ends string, up long"
_SUMMARY = "block int, first binary, last binary, sizes array<long>, low int"
_OUT = _NODE + ", " + _SUMMARY.removeprefix("block int, ")


# ---- conversations ----
def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of struct(turn digest, bytes of its text) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256)), 1, WIDTH)
    rows = conversations.where("conv_id is not null").select("conv_id", F.struct(F.col("turn").isNotNull().alias("told"), "turn", digest.alias("id"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return per.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("turns"))


def rebuild(seqs: DataFrame) -> DataFrame:
    """Every conversation c anew: the first h turns of conversation c - c % 5, then its own turns after its first h; h = crc32(c) % 9."""
    heads = seqs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED - 1).alias("lent"))
    own = seqs.withColumn("base", F.expr("conv_id - conv_id % 5")).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int"))
    nothing = F.slice("turns", 1, 0)
    taken = F.slice(F.coalesce("lent", nothing), F.lit(1), F.col("h"))
    kept = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(taken, kept).alias("turns"))


# ---- one block ----
def lcp(a: bytes, b: bytes) -> int:
    """Turns that two conversations share at their beginning."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


class _Open:
    """A node on the stack."""

    __slots__ = ("start", "before", "n", "least", "children", "leaves", "psum", "ends")

    def __init__(self, start: int, before: int):
        self.start, self.before = start, before  # before: bytes of the turns above the node's own
        self.n, self.least, self.children, self.leaves, self.psum = 0, None, 0, 0, 0
        self.ends: list[int] | None = None


class _Block:
    """The nodes of one block, from its conversations in order."""

    def __init__(self, block: int):
        self.block, self.rows, self.stack, self.row = block, [], [], -1
        self.first = self.last = b""
        self.first_sizes: list[int] = []
        self.low: int | None = None

    def add(self, conv: int, key: bytes, sizes: list[int]) -> None:
        self.row += 1
        n = len(key) // WIDTH
        if self.row == 0:
            self.first, self.first_sizes = key, sizes
            shared = -1
        else:
            shared = lcp(self.last, key)
            self.low = shared if self.low is None else min(self.low, shared)
            if len(self.stack) - 1 > shared:
                self.stack[-1].leaves += 1  # nothing goes on from the conversation before
            while len(self.stack) - 1 > shared:
                self._pop(False)
        sums = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        if shared >= 0:
            self.stack[-1].psum += sums[shared]
        for depth in range(shared + 1, n + 1):
            self.stack.append(_Open(self.row, sums[depth - 1] if depth else 0))
        top = self.stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        top.ends = top.ends or []
        top.ends.append(conv)
        self.last = key

    def _pop(self, right: bool) -> None:
        depth = len(self.stack) - 1
        x = self.stack.pop()
        up = None
        if self.stack:
            above = self.stack[-1]
            above.n += x.n
            above.least = x.least if above.least is None else min(above.least, x.least)
            above.children += 1
            above.leaves += x.leaves
            above.psum += x.psum
            up = above.start
        left = x.start == 0
        names = ",".join(map(str, x.ends)) if x.ends else ""
        partial = left or right
        if not partial:
            names = hashlib.sha256(names.encode()).hexdigest()
        self.rows.append((int(partial), self.block, depth, x.start, left, right, x.n, x.least, x.children, x.leaves, x.psum, x.before, names, up))

    def close(self) -> None:
        while self.stack:
            self._pop(True)

    def summary(self) -> dict:
        return {"block": self.block, "first": self.first, "last": self.last, "sizes": self.first_sizes, "low": self.low}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range partition in its order: its nodes, then its summary (kind 2)."""
    from pyspark import TaskContext

    names = [c.split()[0] for c in _OUT.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int8(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32()], strict=True)))

    def hand_on(rows: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True), *[[None] * len(rows)] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    block = _Block(TaskContext.get().partitionId())
    for b in batches:
        for conv, key, sizes in zip(b.column("conv_id").to_pylist(), b.column("key").to_pylist(), b.column("sizes").to_pylist(), strict=True):
            block.add(conv, key, sizes)
            if len(block.rows) >= _ROWS:
                yield hand_on(block.rows)
                block.rows = []
    block.close()
    for at in range(0, len(block.rows), _ROWS):
        yield hand_on(block.rows[at : at + _ROWS])
    if block.row >= 0:
        yield pa.RecordBatch.from_pylist([{"kind": 2, **block.summary()}], schema)


# ---- across blocks ----
def borders(summaries: DataFrame) -> DataFrame:
    """Of each block: left and right, the LCPs across its borders (-1 at the ends), turns of its last conversation, low, the smallest LCP that
    a node must not go under to span the block from before it, and the bytes of its first conversation's turns. One row a block goes through one task."""
    order = Window.orderBy("block")
    both = summaries.withColumn("ahead", F.lag("last").over(order)).withColumn("behind", F.lead("first").over(order))

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            left = [-1 if a is None else lcp(a, f) for a, f in zip(b["ahead"], b["first"], strict=True)]
            right = [-1 if n is None else lcp(x, n) for x, n in zip(b["last"], b["behind"], strict=True)]
            low = [v if pd.isna(m) else min(v, int(m)) for v, m in zip(left, b["low"], strict=True)]
            shared = [int(sum(s[: max(v, 0)])) for v, s in zip(left, b["sizes"], strict=True)]
            yield pd.DataFrame({"block": b["block"], "x_left": left, "x_right": right, "turns": b["last"].map(len) // WIDTH, "z": low, "shared": shared})

    return both.mapInPandas(across, "block int, x_left int, x_right int, turns int, z int, shared long")


class _Minima:
    """Nearest block before a given one whose minimum is under a depth: chains of smaller values over the block minima."""

    def __init__(self, rows: list[tuple[int, int]]):
        self.blocks = [b for b, _ in rows]
        self.z = [z for _, z in rows]
        self.place = {b: k for k, b in enumerate(self.blocks)}
        self.smaller: list[int] = []
        for k, z in enumerate(self.z):
            j = k - 1
            while j >= 0 and self.z[j] >= z:
                j = self.smaller[j]
            self.smaller.append(j)

    def owner(self, block: int, depth: int) -> int:
        j = self.place[block] - 1
        while self.z[j] >= depth:
            j = self.smaller[j]
        return self.blocks[j]


def conversation_trie(seqs: DataFrame) -> DataFrame:
    """seqs: conv_id, turns (array of struct(id, size)). A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = seqs.sparkSession
    work = Workspace(spark, "trie")
    keyed = seqs.select("conv_id", F.expr("unhex(array_join(transform(turns, x -> hex(x.id)), ''))").alias("key"), F.col("turns.size").alias("sizes"))
    keyed = work.table(keyed, "keyed")  # range bounds are drawn from it, so it is read twice
    ordered = keyed.repartitionByRange(partitions_for(spark), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = work.table(ordered.mapInArrow(_blocks, _OUT), "blocks")
    edges = work.table(borders(found.where("kind = 2").select(*(c.split()[0] for c in _SUMMARY.split(", ")))), "borders")
    # a row a range partition, so the broadcast is bounded by their number
    box = spark.sparkContext.broadcast(_Minima([(r.block, r.z) for r in edges.select("block", "z").orderBy("block").collect()]))

    def owners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([box.value.owner(k, d) if over else k for k, d, over in zip(b["block"], b["depth"], b["over"], strict=True)], dtype="int32")

    owner = F.pandas_udf(owners, "int")
    partial = found.where("kind = 1").join(F.broadcast(edges), "block")
    partial = partial.withColumn("over", F.col("left") & (F.col("x_left") >= F.col("depth")))
    partial = partial.withColumn("owner", owner(F.struct("block", "depth", "over")))
    # what only the borders tell: a child that goes on is counted where it begins; the first conversation shares with the one before the block; the last one may end a branch
    partial = (
        partial.withColumn("children", F.col("children") - (F.col("over") & (F.col("x_left") > F.col("depth"))).cast("long"))
        .withColumn("psum", F.col("psum") + F.when(F.col("over"), F.col("shared")).otherwise(0))
        .withColumn("leaves", F.col("leaves") + (F.col("right") & (F.col("turns") > F.col("x_right"))).cast("long"))
    )
    # a node that begins and ends in one block keeps its name; one that goes on is named by the block and depth it begins with
    partial = work.table(partial.withColumn("goes", F.when(F.col("right"), F.lit(-1)).otherwise(F.col("start"))).withColumn("node", F.when(F.col("over"), F.lit(-1)).otherwise(F.col("goes"))), "partial")
    name = ["owner", "depth", "node"]
    ups = F.min(F.when(~F.col("over"), F.struct("block", "start", "up")))
    sums = partial.groupBy(*name).agg(*(F.sum(c).alias(c) for c in ("n", "children", "leaves", "psum")), F.min("least").alias("least"), F.min("before").alias("before"), ups.alias("top"))
    sums = work.table(sums.join(_ends(partial, name), name, "left"), "sums")
    whole = sums.select(F.col("owner").alias("block"), "depth", F.col("top.start").alias("start"), "n", "least", "children", "leaves", "psum", "before", F.coalesce("ends", F.lit(_EMPTY)).alias("ends"), F.col("top.up").alias("up"))
    inner = found.where("kind = 0").select(whole.columns)
    nodes = inner.unionByName(whole)
    # parents: named as their block saw them; only nodes of two or more conversations have children of another first row
    seen = partial.select("block", "depth", "start", *name[::2]).join(sums.select(*name, "least", "n"), name).select("block", "depth", "start", "least")
    parents = found.where("kind = 0 and n > 1").select("block", "depth", "start", "least").unionByName(seen)
    parents = work.table(parents.select("block", (F.col("depth") + 1).alias("depth"), F.col("start").alias("up"), F.col("least").alias("parent_conv_id")), "parents")
    nodes = work.table(nodes, "nodes")
    joined = nodes.join(parents, ["block", "depth", "up"], "left")
    saved = F.col("psum") - (F.col("n") - 1) * F.col("before")
    return joined.select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


_EMPTY = hashlib.sha256(b"").hexdigest()


def _ends(partial: DataFrame, name: list[str]) -> DataFrame:
    """SHA-256 of the ids that end at each merged node: its pieces lie in order of the blocks and pass through the hash one by one."""
    pieces = partial.where("ends <> ''").select(*name, "block", "ends").repartition(*name).sortWithinPartitions(*name, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        done: list[tuple] = []
        for b in batches:
            for *key, piece in zip(*(b.column(c).to_pylist() for c in (*name, "ends")), strict=True):
                if key != held:
                    if state:
                        done.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
        if state:
            done.append((*held, state.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], [*name, "ends"])

    return pieces.mapInArrow(run, "owner int, depth int, node long, ends string")
