"""SimHash near-duplicates at a similarity of word shingles: the operator's form beyond a few differing bits.

A text's shingles are a set; texts with the same set are merged first. Each set has a SimHash fingerprint of 128 bits.
At a Jaccard similarity of 0.8 two fingerprints differ in about 19 bits, where bit blocks lose most pairs (see
README), so bands of MinHash values propose the pairs: of ``BANDS`` bands of ``ROWS`` values, one of similarity ``s``
shares none with probability (1 - s^4)^30, 1.4e-7 at 0.8 and less above. A bucket's rows then have a pivot table:
Hamming distances to reference fingerprints of the bucket. Pairs whose sizes rule out the similarity, or whose
distances to any pivot differ by more than ``RADIUS``, or whose fingerprints do, are discarded; survivors are verified on the
shingles themselves. A first round links each row with the nearest of its buckets' centres: a pair for each row of a tile and
one for each two centres at most. In the second, rows that still have a candidate in another component meet again with their
sets, and pairs are verified where they meet: only links leave a task, so neither round gives all pairs of a group. A bucket
over ``TILE`` rows is dealt in chunks: each alone in the first round, in the second as tiles of two, of which one at least is
of rows outside the bucket's largest component.

Null and empty texts have no shingle and are copies of each other; null ids keep their row; rows that repeat an id and a
text are copies. Shingles are compared by a 64-bit hash. No documents give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, Workspace, as_bytes, run_starts, sorted_runs
from .components import connected_components
from .simhash import pivots, settled

WORDS = 5
FIFTHS = 4  # least similarity: four fifths
BANDS, ROWS = 30, 4
RADIUS = 44  # of 128 bits; a pair of similarity 0.8 differs in 19 on average, in more than 44 with probability under 1e-6 (1e-5 for sets of five)
PIVOTS = 8
CELLS = 1 << 20
TILE = 4096  # rows of a bucket that a task compares at once
MAX_BROADCAST = 200_000  # rows of the table of larger buckets up to which it is broadcast

_RANDOM = pivots(BANDS * ROWS + ROWS + 257) | np.uint64(1)
_FACTORS, _BYTES, _BASE = _RANDOM[: BANDS * ROWS + ROWS], _RANDOM[-257:-1], int(_RANDOM[-1])
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Hashes of all word shingles of a text at once: differences of one prefix sum of a polynomial over its bytes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.up, self.down = _powers(_BASE, 1 << 12), _powers(_INVERSE, 1 << 12)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The set of a text's shingles; of the whole where it has fewer words, none without words."""
        plain = b" ".join((text or b"").lower().split())
        if not plain:
            return np.empty(0, np.uint64)
        raw = np.frombuffer(plain, np.uint8)
        while len(raw) > len(self.up):
            self.up, self.down = (_powers(b, 2 * len(self.up)) for b in (_BASE, _INVERSE))
        gaps = np.flatnonzero(raw == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(raw))
        take = max(1, len(starts) - self.words + 1)
        starts, ends = starts[:take], ends[-take:]
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * self.down[: len(raw)], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * self.up[starts] + (ends - starts).astype(np.uint64)
        h = np.sort(mixed(h))
        return h[np.append(True, h[1:] != h[:-1])]


def signature(h: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    factors = _FACTORS[: BANDS * ROWS, None]
    for k in range(0, len(h), 1024):
        np.minimum(least, (factors * h[None, k : k + 1024]).min(axis=1), out=least)
    return least


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """The bitwise majority of 128 bits of each hash, as two words."""
    total = np.zeros(128, np.int64)
    for k in range(0, len(h), 1 << 14):
        part = np.stack([h[k : k + (1 << 14)], mixed(~h[k : k + (1 << 14)])], axis=1)
        total += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(id, fp, n, bands, left, right): hash and size of the set of shingles, band values and the SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        shingles = Shingler(words)
        for b in batches:
            fp, n, bands, bits = [], [], [], []
            for t in as_bytes(b.column(1)):
                h = shingles(t)
                fp.append(xxh64_intdigest(h.tobytes(), words))
                n.append(len(h))
                bands.append((signature(h).reshape(BANDS, ROWS) * _FACTORS[BANDS * ROWS :]).sum(axis=1, dtype=np.uint64))
                bits.append(wide_fingerprint(h).view(np.int64))
            flat = pa.array(np.concatenate([*bands, np.empty(0, np.uint64)]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), flat)
            wide = np.array(bits, np.int64).reshape(-1, 2)
            columns = [b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int32()), lists, pa.array(wide[:, 0].copy()), pa.array(wide[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "n", "bands", "left", "right"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long, n int, bands array<long>, left long, right long")


def shingle_sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """texts(fp, text) -> (fp, h array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                sets = [shingles(t).view(np.int64) for t in as_bytes(b.column(1))]
                ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names=["fp", "h"])

    return texts.select("fp", "text").mapInArrow(run, "fp long, h array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: those that are not alone in theirs. Holds a batch and a row."""
    held, alone = None, True  # the last row, and whether it is the only one of its bucket so far
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([held, b] if held else [b])
        k, v = t.column("k").to_numpy(), t.column("v").to_numpy()
        next_same = np.append((k[1:] == k[:-1]) & (v[1:] == v[:-1]), False)
        last_same = np.append(not alone, next_same[:-1])
        keep = next_same | last_same
        yield from t.filter(pa.array(np.append(keep[:-1], False))).combine_chunks().to_batches()
        held, alone = t.slice(t.num_rows - 1).combine_chunks().to_batches()[0], not last_same[-1]
    if held and not alone:
        yield held


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def centres(wide: np.ndarray) -> np.ndarray:
    """Up to four rows of a bucket: each the nearest to the bitwise majority of those that no earlier one is near to.

    Copies with a few changes each are closer to what they are copies of than to each other, and so is their majority.
    """
    out, left = [], np.arange(len(wide))
    while len(left) and len(out) < 4:
        bits = np.unpackbits(wide[left].view(np.uint8).reshape(len(left), -1), axis=1)
        middle = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(left)).view(np.uint64)
        out.append(left[_apart(wide[left], middle[None]).argmin()])
        left = left[_apart(wide[left], wide[out[-1]][None]) > RADIUS // 2]
        left = left[left != out[-1]]
    return np.array(out)


KEY = ["k", "v", "a", "b"]
LIGHT = ("k", "v", "a", "b", "chunk", "fp", "n", "left", "right", "root")


class Tile:
    """The rows of one tile: a bucket, or two chunks of a large one whose cross pairs are meant."""

    def __init__(self, columns: dict[str, np.ndarray], s: int, e: int):
        self.fp, self.n, self.root, chunk = (columns[c][s:e] for c in ("fp", "n", "root", "chunk"))
        self.wide = np.stack([columns["left"][s:e], columns["right"][s:e]], axis=1).view(np.uint64)
        self.side = chunk if columns["a"][s] != columns["b"][s] else None
        self.single = (self.root == self.root[0]).all()

    def pairs(self, one: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates (i, j) of different roots with i among ``one``, in the order of ``one``: sizes and pivots discard, fingerprints verify."""
        size = len(self.fp)
        table = _apart(self.wide[:, None], self.wide[None, :: max(1, size // PIVOTS)][:, :PIVOTS]) if size > PIVOTS else np.empty((size, 0), np.int16)
        step = max(1, CELLS // size)
        for at in range(0, len(one), step):
            x = one[at : at + step, None]
            near = (self.root[x] != self.root[None]) & (5 * np.minimum(self.n[x], self.n[None]) >= FIFTHS * np.maximum(self.n[x], self.n[None]))
            if self.side is not None:
                near &= self.side[x] != self.side[None]
            for p in range(table.shape[1]):
                near &= np.abs(table[x, p] - table[None, :, p]) <= RADIUS
            i, j = np.nonzero(near)
            i = x[i, 0]
            close = _apart(self.wide[i], self.wide[j]) <= RADIUS
            yield i[close], j[close]

    def few(self) -> np.ndarray:
        """Rows outside the largest root: pairs within it need no look."""
        roots, where, count = np.unique(self.root, return_inverse=True, return_counts=True)
        return np.flatnonzero(where != count.argmax())


def _tiles(t: pa.Table) -> Iterator[tuple[Tile, int, int]]:
    columns = {c: t.column(c).to_numpy() for c in LIGHT}
    starts = run_starts(*(columns[c] for c in KEY))
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        tile = Tile(columns, s, e)
        if not tile.single:
            yield tile, s, e


def star(tile: Tile) -> np.ndarray:
    """Candidate pairs (i, j) of a tile: of each row with the nearest centre, and of a row near to two centres with the other one, for each two."""
    i, j = (np.concatenate(x) for x in zip(*tile.pairs(centres(tile.wide)), strict=True))
    order = np.lexsort((i, _apart(tile.wide[i], tile.wide[j]), j))
    i, j = i[order], j[order]
    nearest = np.append(True, j[1:] != j[:-1])[: len(j)]
    second = np.flatnonzero(~nearest & np.append(False, nearest[:-1])[: len(j)])
    between = np.sort(np.stack([i[second - 1], i[second]], axis=1), axis=1)
    far = np.argsort(_apart(tile.wide[i[second]], tile.wide[j[second]]), kind="stable")
    once = second[far[np.unique(between[far], axis=0, return_index=True)[1]]]
    kept = np.append(np.flatnonzero(nearest), once)
    return np.stack([i[kept], j[kept]], axis=1)


def _star_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted tiles -> candidate pairs of their stars."""
    for t in sorted_runs(batches, KEY):
        found = [np.sort(tile.fp[star(tile)], axis=1) for tile, _, _ in _tiles(t)]
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["src", "dst"])


def _live_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted tiles -> their rows that still have a candidate of another root."""
    for t in sorted_runs(batches, KEY):
        live = np.zeros(t.num_rows, bool)
        for tile, s, _ in _tiles(t):
            for i, j in tile.pairs(tile.few()):
                live[s + i] = live[s + j] = True
        yield from t.filter(pa.array(live)).combine_chunks().to_batches()


def _verify_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted tiles with their sets of shingles -> links: enough of them to join all rows of a tile that links join."""
    for t in sorted_runs(batches, KEY, 2000):
        src, dst = [], []
        sets = t.column("h").combine_chunks()
        flat, ends = sets.flatten().to_numpy(), np.append(0, np.cumsum(sets.value_lengths().to_numpy()))
        for tile, s, e in _tiles(t):
            ids = np.unique(flat[ends[s] : ends[e]], return_inverse=True)[1]
            first = ends[s : e + 1] - ends[s]
            mark = np.zeros(len(ids) + 1, bool)
            forest = Forest(e - s)
            by_root = np.argsort(tile.root, kind="stable")
            same = tile.root[by_root][1:] == tile.root[by_root][:-1]
            forest.link(by_root[1:][same], by_root[:-1][same])
            for i, j in tile.pairs(tile.few()):
                bounds = run_starts(i)
                for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    x = int(i[p])
                    ys = j[p:q][forest.label[j[p:q]] != forest.label[x]]
                    if not len(ys):
                        continue
                    own = ids[first[x] : first[x + 1]]
                    mark[own] = True
                    size = tile.n[ys].astype(np.int64)
                    at = np.cumsum(size) - size
                    common = np.add.reduceat(mark[ids[np.repeat(first[ys] - at, size) + np.arange(size.sum())]], at, dtype=np.int64)
                    mark[own] = False
                    good = ys[(5 + FIFTHS) * common >= FIFTHS * (size + tile.n[x])]
                    forest.link(np.full(len(good), x), good)
                    src.append(np.full(len(good), tile.fp[x]))
                    dst.append(tile.fp[good])
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])


def in_tiles(work: Workspace, shared: DataFrame, tile: int) -> DataFrame:
    """Rows by bucket, each with its chunk and the number of chunks: one, or in a bucket over the size of a tile several.

    Two rows share a chunk in some bands and not in others, so that stars of chunks meet.
    """
    sizes = shared.groupBy("k", "v").count().where(F.col("count") > tile).withColumn("chunks", F.ceil(F.col("count") / tile).cast("int")).drop("count")
    sizes = work.table(sizes, "sizes")
    near = F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST else sizes
    rows = shared.join(near, ["k", "v"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return rows.withColumn("chunk", F.expr("cast(pmod(xxhash64(fp, k), chunks) as int)"))


def across_roots(work: Workspace, rooted: DataFrame, tile: int) -> DataFrame:
    """in_tiles with roots -> a row for each tile of it. Large buckets: rows of the root with most of them are in chunks of their own that only meet chunks of others."""
    roots = rooted.where("chunks > 1").groupBy("k", "v", "root").count().groupBy("k", "v")
    mixed = roots.agg(F.max_by("root", "count").alias("most"), F.max("count").alias("m"), F.sum("count").alias("n"))
    mixed = mixed.select("k", "v", "most", F.ceil((F.col("n") - F.col("m")) / tile).cast("int").alias("others"), F.ceil(F.col("m") / tile).cast("int").alias("same"))
    mixed = work.table(mixed, "mixed")
    near = F.broadcast(mixed) if mixed.count() <= MAX_BROADCAST else mixed
    rows = rooted.join(near, ["k", "v"], "left").where("others is null or others > 0")
    place = "case when others is null then 0 when root = most then others + pmod(xxhash64(fp, k), same) else pmod(xxhash64(fp, k), others) end"
    meets = "case when others is null then 1 when root = most then others else others + same end"
    rows = rows.withColumn("chunk", F.expr(f"cast({place} as int)")).withColumn("o", F.explode(F.expr(f"sequence(0, {meets} - 1)")))
    return rows.withColumn("a", F.least("chunk", "o")).withColumn("b", F.greatest("chunk", "o")).select(*LIGHT)


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, tile: int = TILE) -> DataFrame:
    """A row per document: id, fp of its set of shingles and component_id, the smallest id reachable by links of similarity 0.8 or more."""
    work = Workspace(docs.sparkSession, "near-copies")
    signed = work.table(signatures(docs, id_col, text_col, words), "signed")
    first = [F.first(c).alias(c) for c in ("n", "bands", "left", "right")]
    distinct = work.table(signed.groupBy("fp").agg(F.min("id").alias("least"), *first), "distinct")
    buckets = distinct.select("fp", "n", "left", "right", F.posexplode("bands").alias("k", "v")).select("k", "v", "fp", "n", "left", "right")
    shared = work.table(buckets.repartition("k", "v").sortWithinPartitions("k", "v").mapInArrow(_shared, buckets.schema), "shared")
    rows = work.table(in_tiles(work, shared, tile), "rows")
    texts = docs.select(F.col(id_col).alias("least"), F.col(text_col).alias("text"))
    sets_of = lambda fps: shingle_sets(fps.distinct().join(distinct.select("fp", "least"), "fp").join(texts, "least"), words)
    dealt = lambda tiles: tiles.repartition(*KEY).sortWithinPartitions(*KEY, "fp")

    stars = rows.withColumn("a", F.col("chunk")).withColumn("b", F.col("chunk")).withColumn("root", F.col("fp")).select(*LIGHT)
    pairs = work.table(dealt(stars).mapInArrow(_star_pass, "src long, dst long").distinct(), "pairs")
    sets = work.table(sets_of(pairs.select(F.explode(F.array("src", "dst")).alias("fp"))), "star-sets")
    both = pairs.join(sets.select(F.col("fp").alias("src"), F.col("h").alias("x")), "src").join(sets.select(F.col("fp").alias("dst"), F.col("h").alias("y")), "dst")
    both = both.select("src", "dst", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total"))
    links = work.table(both.where((5 + FIFTHS) * F.col("common") >= FIFTHS * F.col("total")).select("src", "dst"), "star-links")
    roots = connected_components(work, links, "star-cc")

    rooted = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tiles = across_roots(work, rooted, tile)
    live = work.table(dealt(tiles).mapInArrow(_live_pass, tiles.schema), "live")
    sets = work.table(sets_of(live.select("fp")), "sets")
    held = dealt(live.join(sets, "fp").select(*LIGHT, "h"))
    more = work.table(held.mapInArrow(_verify_pass, "src long, dst long").distinct(), "links")
    if not more.isEmpty():
        roots = connected_components(work, links.unionByName(more), "cc")
    return settled(work, signed.select("id", "fp"), distinct.select("fp", "least"), roots, id_col)
