"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint is the bitwise majority of the XXH64 of its word shingles. Equal fingerprints are
merged first, so exact copies cost one row. Candidates share two of six bit blocks (four flipped bits leave
two blocks whole: no pair is lost). Within a bucket the table of Hamming distances to ``PIVOTS`` reference
fingerprints is computed once; a pair whose distances to any pivot differ by more than the radius is
discarded by the triangle inequality, the rest are verified. A bucket gives a spanning forest, never all
its pairs; a bucket over ``TILE`` rows goes to a second stage as tiles of two chunks.

Null or empty texts have fingerprint zero and link like any other; null ids keep their row; rows that repeat an id each
have a row, with the smallest id that any of their texts reaches. No documents give no rows; other columns are not looked at.

Pairs within a bucket are tested all: with d distinct fingerprints about 15 d^2 / 2^21 pairs, which grows with the square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, Workspace, as_bytes, run_starts, sorted_runs
from .components import connected_components

SEED = 42
RADIUS = 4
PIVOTS = 16
TILE = 8192
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit, bits


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: the first outputs of the splitmix64 generator."""
    state, out = 0, []
    for _ in range(count):
        state = (state + 0x9E3779B97F4A7C15) % 2**64
        z = (state ^ (state >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def shingle_hashes(text: bytes | None, words: int = 4) -> list[int]:
    """XXH64 of each word shingle of a text's UTF-8 bytes; of the whole where it has fewer words, none without words."""
    from xxhash import xxh64_intdigest

    tokens = (text or b"").lower().split()
    if not tokens:
        return []
    if len(tokens) <= words:
        return [xxh64_intdigest(b" ".join(tokens), SEED)]
    plain = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-words] + 1])
    return [xxh64_intdigest(plain[s:e], SEED) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes | None, words: int = 4, chunk: int = 1 << 18) -> int:
    """Unsigned 64-bit fingerprint of a text's UTF-8 bytes; zero without words."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for k in range(0, len(values), chunk):
        total += np.unpackbits(values[k : k + chunk].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in as_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _links(fp: np.ndarray, starts: np.ndarray, radius: int, table: np.ndarray, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of the runs of fp given by starts. split: of one run, only pairs with an end on either side of it."""
    n = len(fp)
    forest = Forest(n)
    last = np.repeat(starts[1:], np.diff(starts)) - 1  # each row's last row of its bucket
    alive = np.flatnonzero(last > np.arange(n)) if split is None else np.arange(min(split, n))
    shift = 1
    while len(alive):
        other = alive + shift
        inside = other <= last[alive]
        alive, other = alive[inside], other[inside]
        a, b = (alive, other) if split is None else (alive[other >= split], other[other >= split])
        new = forest.label[a] != forest.label[b]
        a, b = a[new], b[new]
        for p in range(table.shape[1]):  # pivot tables: one coordinate over the radius discards the pair
            if not len(a):
                break
            near = np.abs(table[a, p] - table[b, p]) <= radius
            a, b = a[near], b[near]
        close = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        forest.link(a[close], b[close])
        shift += 1
    return forest.edges()


def _table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


EDGE = pa.schema([("big", pa.bool_()), ("k", pa.int32()), ("v", pa.int64()), ("chunk", pa.int32()), ("src", pa.int64()), ("dst", pa.int64())])


def _rows(big: bool, k, v, chunk, src, dst) -> pa.RecordBatch:
    n = len(src)
    fill = lambda x, kind: pa.array(np.broadcast_to(np.asarray(x), n).astype(kind))
    return pa.RecordBatch.from_arrays([fill(big, bool), fill(k, np.int32), fill(v, np.int64), fill(chunk, np.int32), fill(src, np.int64), fill(dst, np.int64)], schema=EDGE)


def _bucket_pass(radius: int, tile: int):
    """Rows (k, v, fp) sorted: links of small buckets, and the rows of large ones numbered in chunks."""
    refs = pivots()

    def small(k: np.ndarray, v: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = run_starts(k, v)
        sizes = np.diff(starts)
        for i in np.flatnonzero(sizes > tile):
            rows = slice(starts[i], starts[i + 1])
            yield _rows(True, k[rows], v[rows], np.arange(sizes[i]) // tile, fp[rows], fp[rows])
        keep = np.repeat(sizes <= tile, sizes) & np.repeat(sizes > 1, sizes)
        k, v, x = k[keep], v[keep], fp[keep].view(np.uint64)
        if len(x):
            a, b = _links(x, run_starts(k, v), radius, _table(x, refs))
            yield _rows(False, 0, 0, 0, x[a].view(np.int64), x[b].view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, done = None, 0  # a large bucket that is passed on as it comes, and how many of its rows went
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        for b in batches:
            if not b.num_rows:
                continue
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, b.columns, strict=True)]
            while len(held[0]):
                k, v, fp = held
                if key is not None:
                    n = int(np.argmax((k != key[0]) | (v != key[1]))) if (k[-1], v[-1]) != key else len(k)
                    if n:
                        yield _rows(True, k[:n], v[:n], (done + np.arange(n)) // tile, fp[:n], fp[:n])
                    done, held = done + n, [x[n:] for x in held]
                    if not len(held[0]):
                        break
                    key = None
                    continue
                cut = int(run_starts(k, v)[-2])
                if len(k) - cut > tile:
                    key, done = (k[-1], v[-1]), 0
                elif len(k) < 4 * tile:
                    break
                if cut:
                    yield from small(k[:cut], v[:cut], fp[:cut])
                    held = [x[cut:] for x in held]
                if key is None:
                    break
        if len(held[0]):
            yield from small(*held)

    return run


def _tile_pass(radius: int):
    """Rows (k, v, i, j, fp, chunk) sorted by tile: links within chunk i when i = j, else across the two chunks."""
    refs = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, ["k", "v", "i", "j"], 1):
            k, v, i, j, fp, chunk = (t.column(c).to_numpy() for c in ("k", "v", "i", "j", "fp", "chunk"))
            starts = run_starts(k, v, i, j)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                order = np.argsort(chunk[s:e], kind="stable")
                x = fp[s:e][order].view(np.uint64)
                split = None if i[s] == j[s] else int((chunk[s:e] == i[s]).sum())
                a, b = _links(x, np.array([0, len(x)]), radius, _table(x, refs), split)
                yield _rows(False, 0, 0, 0, x[a].view(np.int64), x[b].view(np.int64))

    return run


def near_links(work: Workspace, distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """distinct(fp long, no repeats) -> (src, dst): links whose components are those of all pairs within ``radius`` (at most 4)."""
    if radius > 4:
        raise ValueError("the blocks lose no pair up to 4 differing bits")
    keys = []
    for k, pair in enumerate(combinations(BLOCKS, 2)):
        mask = sum(((1 << bits) - 1) << first for first, bits in pair)
        mask = mask - 2**64 if mask >= 2**63 else mask
        keys.append(F.struct(F.lit(k).cast("int").alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")))
    exploded = distinct.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.k", "x.v", "fp")
    found = exploded.repartition("k", "v").sortWithinPartitions("k", "v", "fp").mapInArrow(_bucket_pass(radius, tile), "big boolean, k int, v long, chunk int, src long, dst long")
    found = work.table(found, "pairs")
    links = found.where("not big").select("src", "dst")
    big = found.where("big").select("k", "v", "chunk", F.col("src").alias("fp"))
    if big.isEmpty():
        return links
    sizes = big.groupBy("k", "v").agg(F.max("chunk").alias("last"))
    tiles = big.join(sizes, ["k", "v"]).select("k", "v", "chunk", "fp", F.explode(F.expr("sequence(0, last)")).alias("o"))
    tiles = tiles.select("k", "v", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "fp", "chunk")
    across = tiles.repartition("k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j").mapInArrow(_tile_pass(radius), "big boolean, k int, v long, chunk int, src long, dst long")
    return links.unionByName(across.select("src", "dst"))


def settled(work: Workspace, fps: DataFrame, distinct: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """fps(id, fp), distinct(fp, least id) and roots of fps -> a row per id: fp and component_id, the smallest id of the component."""
    linked = work.table(distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "least"), "linked")
    by_root = work.table(linked.groupBy("root").agg(F.min("least").alias("lowest")), "by-root")
    moved = work.table(linked.join(by_root, "root").select("fp", "lowest"), "moved")
    final = work.table(distinct.join(moved, "fp", "left").select("fp", F.coalesce("lowest", "least").alias("component_id")), "final")
    return fps.join(final, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = RADIUS, tile: int = TILE, similarity: float | None = None) -> DataFrame:
    """A row per document: id, fp (signed long) and component_id, the smallest id reachable by links of ``radius`` bits or fewer.

    With ``similarity`` (0.8) links are pairs of that Jaccard similarity of their ``words``-word shingles or more, verified on
    the shingles; see ``near_copies``.
    """
    if similarity is not None:
        from .near_copies import FIFTHS, near_copy_groups

        if similarity != FIFTHS / 5:
            raise ValueError("the bands and the radius are set for a similarity of 0.8")
        return near_copy_groups(docs, id_col, text_col, words)
    work = Workspace(docs.sparkSession, "simhash")
    fps = work.table(fingerprints(docs, id_col, text_col, words), "fps")
    distinct = work.table(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(work, near_links(work, distinct.select("fp"), radius, tile))
    return settled(work, fps, distinct, roots, id_col)
