"""Filter interaction audit: what each filter removes in every order in which five filters can run.

A document fails some of five filters, so it is one of 32 masks. ``TABLE[mask, order]`` says at which step of an order
it is removed, if at all; a task looks the masks of its documents up and counts removals by part, order, step and label
with ``np.bincount``. The partial arrays of the tasks are summed by part and slot, and the report of a part is worked out
from its sums alone: no document is looked at twice, and none is gathered by part.

Filters (words are runs of anything but space and ASCII control white space, case-sensitive):
A under 200 words; B distinct words under half of the words; C more than 2 % of the code points are A-Z;
D holds one of ``#$%&*|``; E equals the text of a smaller id anywhere in the table, whether removed or not.

Null texts are empty. A document without id has no smaller one and is none for others, so it never fails E; rows that
repeat an id with one text are equal to each other, not smaller. Several label rows of an id count as one that is marked
where any of them is; documents without labels or without id are unmarked. Null sources are the part of the empty string. An empty
table has no parts and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
MASKS = 1 << STEPS
MIN_WORDS = 200
HELD_PARTS = 64  # parts that a task counts before it hands them on
_PLACES = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
_FAILS = (np.arange(MASKS)[:, None] >> np.arange(STEPS)) & 1  # mask, filter
_BY_STEP = _FAILS[:, _PLACES]  # mask, order, step: fails the filter of that step
TABLE = np.where(_BY_STEP.any(2), _BY_STEP.argmax(2), STEPS)  # mask, order: the step that removes, or STEPS
_SLOTS = len(ORDERS) * (STEPS + 1)  # then a slot for each mask
_LABELS = 4  # 0 neither, 1 quality, 2 toxic, 3 both
_UPPER = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))  # bytes that begin no code point
_SIGNS = b"#$%&*|"


def failed(text: bytes) -> int:
    """The mask of the filters A to D that a text fails."""
    words = text.split()  # bytes split at exactly the white space above
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INNER))
    signs = len(text) > len(text.translate(None, _SIGNS))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 2 * points) << 2 | signs << 3


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or b"" for t in as_bytes(b.column("text"))]
        masks = pa.array([failed(t) for t in texts], pa.int8())
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), masks, digests], ["doc_id", "part", "mask", "digest"])


def masks_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: part, mask (0 to 31), label (0 to 3). Texts stay in their tasks; narrow rows are joined.

    Equality is decided by SHA-256. The first of equal texts is found by a grouping with partial minima, and is joined
    back by digest and id together, so thousands of copies do not meet in one task.
    """
    work = Workspace(documents.sparkSession, "audit")
    source = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = work.table(source.mapInArrow(_measure, f"doc_id {kind}, part string, mask byte, digest binary"), "rows")
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    first = F.coalesce("is_first", F.lit(False)) | F.col("doc_id").isNull()
    rows = rows.join(work.table(firsts, "firsts"), ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(first, 0).otherwise(16))
    marked = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    told = labels.where("doc_id is not null").groupBy("doc_id").agg((marked("quality") + 2 * marked("toxic")).alias("label"))
    joined = rows.join(work.table(told, "labels"), "doc_id", "left")
    return joined.select("part", F.col("mask").cast("int").alias("mask"), F.coalesce("label", F.lit(0)).cast("int").alias("label"))


class _Counts:
    """The arrays of the parts that a task has met."""

    def __init__(self) -> None:
        self.by_part: dict[str, np.ndarray] = {}

    def add(self, parts: list[str], masks: np.ndarray, labels: np.ndarray) -> None:
        names, which = np.unique(np.array(parts, object), return_inverse=True)
        steps = TABLE[masks] + np.arange(len(ORDERS)) * (STEPS + 1)  # document, order: slot
        base = (which * (_SLOTS + MASKS))[:, None]
        slots = np.concatenate([steps + base, (masks + _SLOTS)[:, None] + base], 1)
        found = np.bincount((slots * _LABELS + labels[:, None]).ravel(), minlength=len(names) * (_SLOTS + MASKS) * _LABELS)
        for name, counts in zip(names, found.reshape(len(names), _SLOTS + MASKS, _LABELS), strict=True):
            if name in self.by_part:
                self.by_part[name] += counts
            else:
                self.by_part[name] = counts

    def flush(self) -> Iterator[pa.RecordBatch]:
        for part, counts in self.by_part.items():
            slots = np.flatnonzero(counts.any(1))
            c = counts[slots]
            columns = [pa.array([part] * len(slots)), pa.array(slots.astype(np.int32)), pa.array(c.sum(1)), pa.array(c[:, 1] + c[:, 3]), pa.array(c[:, 2] + c[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "slot", "n", "good", "toxic"])
        self.by_part = {}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Counts()
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            x = b.slice(at, 1024)
            held.add(x.column("part").to_pylist(), x.column("mask").to_numpy(), x.column("label").to_numpy())
            if len(held.by_part) > HELD_PARTS:
                yield from held.flush()
    yield from held.flush()


def report(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of one part from its summed array (slot by n, good, toxic): order major, step minor."""
    gone = counts[:_SLOTS].reshape(len(ORDERS), STEPS + 1, 3)[:, :STEPS]
    masks = counts[_SLOTS:, 0]
    fails = (masks @ _FAILS)[_PLACES]
    unique = masks[1 << np.arange(STEPS)][_PLACES]
    removed = gone[:, :, 0]
    share = np.bincount(_PLACES.ravel(), removed.ravel(), STEPS).astype(np.int64)[_PLACES]
    out = {"kept": masks.sum() - removed.cumsum(1), "removed": removed, "redundant": fails - removed, "unique_fails": unique, "good_lost": gone[:, :, 1], "toxic_lost": gone[:, :, 2], "shapley": share}
    return {k: v.ravel() for k, v in out.items()}


_REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for part, slots in zip(b["part"], b["slots"], strict=True):
            counts = np.zeros((_SLOTS + MASKS, 3), np.int64)
            for x in slots:
                counts[x["slot"]] = x["n"], x["good"], x["toxic"]
            head = {"part": part, "filter_order": np.repeat(ORDERS, STEPS), "step": np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))}
            yield pd.DataFrame(head | report(counts))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents: doc_id, text, source. labels: doc_id, quality, toxic. A row per part, order and step, zeros included.

    A part's sums are at most 752 rows of three numbers, so its report is made in one task whatever its size.
    """
    partial = masks_of(documents, labels).mapInArrow(_count, "part string, slot int, n long, good long, toxic long")
    sums = partial.groupBy("part", "slot").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    slots = sums.groupBy("part").agg(F.collect_list(F.struct("slot", "n", "good", "toxic")).alias("slots"))
    return slots.mapInPandas(_finish, _REPORT)
