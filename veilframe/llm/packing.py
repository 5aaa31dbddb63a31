"""Best-fit packing of whole documents into fixed-size sequences by minimum bin slack.

Only lengths decide a packing, and there are at most ``capacity`` different ones: the corpus is tokenised
once, its pieces are counted by length, and the packing is planned on that histogram. For each bin the longest
remaining length is joined by the fullest feasible combination of the other available lengths, found by subset
sums over a bitset; the combination is repeated while its lengths last and then removed. A length ends a
combination's run at most capacity / length times, so a plan has under capacity * (1 + ln capacity) combinations,
however large the corpus. Pieces take their places by rank within their length: a prefix sum of the
counts by task gives the ranks, without bringing any length to one task.

Documents end with ``end_id``; only those over the capacity are cut, into full pieces after a first one that
may be shorter. Null texts are empty documents (one token); repeated rows are packed each. No documents give no rows;
other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .tokens import encoder

CAPACITY = 1024


def fullest(counts: list[int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``; of equal sums, long lengths first."""
    lengths = [n for n in range(min(room, len(counts) - 1), 0, -1) if counts[n]]
    mask = (1 << (room + 1)) - 1
    layers, bits = [], 1
    for n in lengths:
        layers.append(bits)
        copies, step = min(counts[n], room // n), 1
        while copies:  # binary splitting of the multiplicity
            take = min(step, copies)
            bits |= bits << (n * take) & mask
            copies -= take
            step *= 2
        if bits >> room & 1:
            break
    total = bits.bit_length() - 1
    out: dict[int, int] = {}
    for n, before in zip(reversed(lengths[: len(layers)]), reversed(layers), strict=True):
        k = 0
        while not before >> total & 1:
            total -= n
            k += 1
        if k:
            out[n] = k
    return out


def plan_bins(counts: list[int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """counts[n]: pieces of length n. Combinations in order, each with the number of bins that it fills."""
    left, plan = list(counts), []
    longest = len(left) - 1
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return plan
        left[longest] -= 1
        bins = fullest(left, capacity - longest)
        left[longest] += 1
        bins[longest] = bins.get(longest, 0) + 1
        times = min(left[n] // k for n, k in bins.items())
        for n, k in bins.items():
            left[n] -= k * times
        plan.append((bins, times))


class Places:
    """Sequence and offset of the r-th piece of each length."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for bins, times in plan:
            offset = 0
            for n, k in sorted(bins.items(), reverse=True):
                rows.setdefault(n, []).append((used.get(n, 0), first, k, offset))
                used[n] = used.get(n, 0) + k * times
                offset += n * k
            first += times
        self.by_length = {n: np.array(r, np.int64) for n, r in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            rows = self.by_length[n]
            row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
            nth = rank[at] - row[:, 0]
            sequence[at] = row[:, 1] + nth // row[:, 2]
            offset[at] = row[:, 3] + nth % row[:, 2] * n
        return sequence, offset


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """Pieces with the task that made them and their rank among its pieces of that length."""
    tail = struct.pack("<I", end_id)
    names = ["id", "piece", "start", "length", "ids_crc32", "task", "nth", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, codec, seen = TaskContext.get().partitionId(), encoder(tokenizer), [0] * (capacity + 1)
        for b in batches:
            row, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = codec.encode(text) + tail
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    row.append(i)
                    out.append((k, start, length, zlib.crc32(part), task, seen[length], part))
                    seen[length] += 1
            kinds = [pa.int32(), *[pa.int64()] * 5, *[pa.binary()] * with_ids]
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *columns], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the piece's ids (bytes) if asked for."""
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    pieces = work.table(tokenised_pieces(docs, tokenizer, end_id, capacity, with_ids, id_col, text_col), "pieces")
    by_task = work.table(pieces.groupBy("task", "length").count(), "by-task")
    counts = [0] * (capacity + 1)
    for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect():  # a row per length: at most the capacity
        counts[r.length] = r.n
    places = spark.sparkContext.broadcast(Places(plan_bins(counts, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = work.table(by_task.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            keep = [b.column(c) for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*(c for c in b.schema.names if c != "rank"), "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    ranked = pieces.join(bases, ["task", "length"]).select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("base") + F.col("nth")).alias("rank"))
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
