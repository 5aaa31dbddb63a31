"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows scans every document's words.

Words are the ASCII-lower-cased runs of letters, digits and non-ASCII characters. A window is ``n``
consecutive words of an item (an item of fewer is one window). Words outside the benchmark's vocabulary
break the scan at once; runs inside it are hashed with a rolling polynomial, looked up, and every hash hit is
verified word by word. The scan needs no shuffle.

The set is broadcast in blocks of about ``block_words`` words of benchmark text, as arrays (some 25 bytes a window, and the
distinct words). A benchmark beyond one block is scanned block by block over numbered rows and the hits are merged by row, so
no broadcast grows with the benchmark; an item longer than a block is cut into slices that overlap by a window less a word.

Null and empty texts have no words and are never contaminated; items without words or id are left out;
repeated items count once; repeated documents each keep a row. Without items no document is contaminated, without documents
there are no rows; other columns of the documents pass through ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes

WINDOW = 13
BLOCK_WORDS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class WindowSet:
    """Windows of the benchmark by length: sorted rolling hashes, each with a place in the items' words and the items that hold it."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.items)}
        words, places, at = [], {}, 0
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int32)
            if size := min(n, len(ids)):
                words.append(ids)
                places.setdefault(size, []).append((at, len(ids) - size + 1, number[item]))
                at += len(ids)
        self.words = np.concatenate([*words, np.empty(0, np.int32)])
        self.by_size = [(size, *self._index(size, np.array(runs))) for size, runs in sorted(places.items())]

    def _index(self, size: int, runs: np.ndarray) -> tuple:
        """base, hashes of distinct windows, a place of each, and its items: owners[bounds[k] : bounds[k + 1]]."""
        count = runs[:, 1]
        place = np.repeat(runs[:, 0] - np.cumsum(count) + count, count) + np.arange(count.sum())
        owner = np.repeat(runs[:, 2], count).astype(np.int32)
        base = BASE
        while True:
            h = rolling((self.words[place + k] for k in range(size)), base)
            order = np.lexsort((owner, h))
            first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            sizes = np.diff(np.append(first, len(order)))
            one = np.repeat(place[order[first]], sizes)
            if all((self.words[place[order] + k] == self.words[one + k]).all() for k in range(size)):
                break
            base += np.uint64(2)  # two different windows of one hash
        group = np.repeat(np.arange(len(first)), sizes)
        new = np.append(True, (group[1:] != group[:-1]) | (owner[order][1:] != owner[order][:-1]))
        return base, h[order[first]], place[order[first]], np.searchsorted(group[new], np.arange(len(first) + 1)), owner[order][new]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which words are hit, and the items that occur."""
        edge = np.zeros(len(words) + 1, np.int64)
        found: list[np.ndarray] = []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        misses = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, base, hashes, place, bounds, owners in self.by_size:
            if len(ids) < size:
                continue
            at = np.flatnonzero(misses[size:] == misses[:-size])
            if not len(at):
                continue
            h = rolling((ids[at + k] for k in range(size)), base)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[k] == h
            at, k = at[same], k[same]
            exact = np.ones(len(at), bool)
            for j in range(size):
                exact &= self.words[place[k] + j] == ids[at + j]
            at, k = at[exact], np.unique(k[exact])
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            found += [owners[bounds[w] : bounds[w + 1]] for w in k.tolist()]
        names = np.unique(np.concatenate(found)).tolist() if found else []
        return np.cumsum(edge[:-1]) > 0, [self.items[k] for k in names]


def rolling(columns: Iterable[np.ndarray], base: np.uint64) -> np.ndarray:
    total = np.zeros(1, np.uint64)
    for c in columns:
        total = total * base + c.astype(np.uint64) + np.uint64(1)
    return total


def ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given word ranges."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, text[last:]])


_HITS = "rid long, id {kind}, n_words long, spans array<struct<first:long,end:long>>, items array<string>"


def _scan_block(source: DataFrame, items: list[tuple[str, bytes]], n: int, kind: str, all_rows: bool) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(WindowSet(items, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            keep, count, spans, names = [], [], [], []
            for i, text in enumerate(as_bytes(b.column(2))):
                words = words_of(text)
                hit, found = index.scan(words)
                if all_rows or found:
                    keep.append(i)
                    count.append(len(words))
                    spans.append([{"first": s, "end": e} for s, e in ranges(hit)])
                    names.append(found)
            rows = b.take(pa.array(keep, pa.int64()))
            span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(count, pa.int64()), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))], names=["rid", "id", "n_words", "spans", "items"])

    return source.mapInArrow(run, _HITS.format(kind=kind))


def benchmark_blocks(bench: DataFrame, block_words: int, n: int = WINDOW, item_col: str = "item_id", item_text: str = "text"):
    """A function that gathers the items of block k, and the number of blocks."""
    step = max(n, block_words // 8)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                words = words_of(text)
                rows += [(item, k, b" ".join(part), len(part)) for k in range(0, max(1, len(words) - n + 1), step) if (part := words[k : k + step + n - 1])]
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["item", "first", "words", "n"])

    items = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    items = Workspace(bench.sparkSession, "benchmark").table(items.mapInArrow(slices, "item string, first long, words binary, n long"), "items")
    blocks = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // block_words))
    items = items.withColumn("block", F.expr(f"pmod(xxhash64(item, first), {blocks})"))
    return lambda k: [(r.item, bytes(r.words)) for r in items.where(F.col("block") == k).collect()], blocks


def find_contamination(docs: DataFrame, bench: DataFrame, n: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document: rid (row number), id, n_words, spans (word ranges that occur in the benchmark, end exclusive), items."""
    part, blocks = benchmark_blocks(bench, block_words, n, item_col, item_text)
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if blocks > 1:  # read once a block, so the numbers must stay
        numbered = Workspace(docs.sparkSession, "contamination").table(numbered, "rows")
    return _find(numbered, part, blocks, n)


def _find(source: DataFrame, part, blocks: int, n: int) -> DataFrame:
    kind = source.schema["id"].dataType.simpleString()
    out = _scan_block(source, part(0), n, kind, True)
    if blocks == 1:
        return out
    for k in range(1, blocks):
        out = out.unionByName(_scan_block(source, part(k), n, kind, False))
    merged = out.groupBy("rid").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # at most a row a block
    joined = """aggregate(spans, cast(array() as array<struct<first:long,end:long>>), (done, x) ->
        CASE WHEN size(done) > 0 AND element_at(done, -1).end >= x.first
             THEN concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'end', greatest(element_at(done, -1).end, x.end))))
             ELSE concat(done, array(x)) END)"""
    return merged.withColumn("spans", F.expr(joined))


def measure(hits: DataFrame, share: int = 20) -> DataFrame:
    """n_hit and contaminated: at least one word in ``share`` is hit."""
    hit = F.expr("aggregate(spans, 0L, (t, x) -> t + x.end - x.first)")
    return hits.withColumn("n_hit", hit).withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def decontaminate(docs: DataFrame, bench: DataFrame, action: str = "drop", n: int = WINDOW, share: int = 20, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without contamination, in their own columns.

    ``drop`` leaves out contaminated documents and keeps the others as they are; ``remove`` keeps every
    document and cuts the hit words out of its text.
    """
    if action not in ("drop", "remove"):
        raise ValueError(f"unknown action {action}")
    items, blocks = benchmark_blocks(bench, block_words, n)
    if blocks == 1:
        return _judge(docs, items(0), action, n, share, text_col)
    mark = "_veil_rid"
    numbered = Workspace(docs.sparkSession, "contamination").table(docs.withColumn(mark, F.monotonically_increasing_id()), "rows")
    hits = measure(_find(numbered.select(F.col(mark).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, blocks, n), share)
    if action == "drop":
        bad = hits.where("contaminated").select(F.col("rid").alias(mark))
        return numbered.join(bad, mark, "left_anti").select(*docs.columns)
    spans = hits.where("size(spans) > 0").select(F.col("rid").alias(mark), F.col("spans").alias("_veil_spans"))

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut(t.encode(), [(x["first"], x["end"]) for x in s]).decode() for t, s in zip(text, spans, strict=True)], dtype=object)

    joined = numbered.join(spans, mark, "left")
    return joined.withColumn(text_col, F.when(F.col("_veil_spans").isNotNull(), cleaned(F.col(text_col), F.col("_veil_spans"))).otherwise(F.col(text_col))).select(*docs.columns)


def _judge(docs: DataFrame, items: list[tuple[str, bytes]], action: str, n: int, share: int, text_col: str) -> DataFrame:
    """With the whole benchmark in one broadcast, each document is judged where it is read."""
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(items, n))

    def hits(text: str | None):
        words = words_of((text or "").encode())
        return shared.value.scan(words)[0]

    def clean(text: pd.Series) -> pd.Series:
        out = [(hits(t).sum(), t) for t in text] if action == "drop" else []
        return pd.Series([not n_hit or share * n_hit < len(words_of(t.encode())) for n_hit, t in out])

    def removed(text: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not (h := hits(t)).any() else cut(t.encode(), ranges(h)).decode() for t in text], dtype=object)

    if action == "drop":
        return docs.where(F.pandas_udf(clean, "boolean")(F.col(text_col)))
    return docs.withColumn(text_col, F.pandas_udf(removed, "string")(F.col(text_col)))
