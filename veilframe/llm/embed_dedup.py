"""Embedding near-duplicates by an exact metric range join.

Vectors of a group (equal label and length) are compared as unit vectors, where cosine >= c is a distance
<= r = sqrt(2 - 2c). Pivots drawn from each large group part it into Voronoi cells; the triangle
inequality bounds how near the cell border a vector must be to reach a partner beyond it
((cos_home - cos_other) / |p_home - p_other| <= r), and only those are replicated to that cell. Every cell then
joins on its own: a vector counts its links in its home cell, where all its partners are present, so
nothing is counted twice. The number of pivots of a group is the largest whose measured mean
replication stays within ``max_copies``. A cell of more than ``cell`` vectors is dealt out as pairs of chunks of that size, so a
task's memory does not grow with the corpus (the number of its tiles does, with the square of a cell's size).

Vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link with
nothing. Rows with a null vec_id count links but join no component (component_id null). Rows that share a
vec_id are one node. No vectors give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, Workspace, run_starts, sorted_runs
from .components import connected_components

COSINE = 0.98
CELL = 4096
MAX_GROUPS = 1024  # groups that get pivots: the largest ones; the others are one cell each, dealt as tiles
SAMPLE = 20_000  # vectors from which pivots are drawn
MAX_PIVOTS = 64  # of a group
PIVOT_NUMBERS = 4 << 20  # components of all pivots: 32 MiB of broadcast
TILE_KEY = ["label", "dim", "cell", "a", "b"]
MAX_BROADCAST = 200_000  # rows of the table of large cells up to which it is broadcast


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # the squares of very large or small components leave the range
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def reach(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector and the cells (n x pivots) in which it must be present."""
    cos = units @ pivots.T
    home = cos.argmax(axis=1)
    gap = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)[home]
    lead = cos[np.arange(len(units)), home][:, None] - cos
    present = lead <= radius * gap + 1e-9
    present[np.arange(len(units)), home] = True
    return home, present


def choose_pivots(sample: np.ndarray, size: int, radius: float, cell: int, max_copies: float) -> np.ndarray | None:
    """Pivots of a group of ``size`` vectors, from its sample; None: one cell."""
    apart = [0]
    for i in range(1, len(sample)):
        if len(apart) >= min(MAX_PIVOTS, -(-size // cell)):
            break
        if (sample[apart] @ sample[i] < 0.9).all():
            apart.append(i)
    best, k = None, 2
    while k <= len(apart):
        pivots = sample[apart[:k]]
        if reach(sample, pivots, radius)[1].sum() / len(sample) <= max_copies:
            best = pivots
        k *= 2
    return best


_CELLS = "rid long, vec_id {kind}, label {label}, dim int, cell int, own boolean, vec binary"


def _assign(shared, radius: float, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            rid, vec_id, label, dim, ok, emb = b.columns
            flat = emb.flatten().to_numpy(zero_copy_only=False)
            end = np.cumsum(np.array([x or 0 for x in dim.to_pylist()], np.int64))
            labels, dims, valid = label.to_pylist(), dim.to_pylist(), ok.to_pylist()
            take, cell, own, vec = [], [], [], []
            groups: dict = {}
            for i in range(b.num_rows):
                if not valid[i]:
                    take.append(i), cell.append(None), own.append(True), vec.append(None)
                elif (labels[i], dims[i]) not in pivots:
                    take.append(i), cell.append(0), own.append(True), vec.append(flat[end[i] - dims[i] : end[i]].astype(width).tobytes())
                else:
                    groups.setdefault((labels[i], dims[i]), []).append(i)
            for key, rows in groups.items():
                x = np.stack([flat[end[i] - key[1] : end[i]] for i in rows]).astype("<f8")
                home, present = reach(unit(x), pivots[key], radius)
                for j, i in enumerate(rows):
                    for c in np.flatnonzero(present[j]).tolist():
                        take.append(i), cell.append(c), own.append(c == home[j]), vec.append(x[j].astype(width).tobytes())
            t = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([rid.take(t), vec_id.take(t), label.take(t), dim.take(t), pa.array(cell, pa.int32()), pa.array(own, pa.bool_()), pa.array(vec, pa.binary())], names=["rid", "vec_id", "label", "dim", "cell", "own", "vec"])

    return run


def _join_cells(cosine: float, width: str, block: int = 512):
    """Sorted by tile. Left rows (owned) meet right rows: link counts of the left rows and a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("src", pa.int64()), ("dst", pa.int64())])
        for t in sorted_runs(batches, TILE_KEY, 20_000):
            starts = run_starts(*(t.column(c).to_numpy() for c in TILE_KEY))
            vecs = t.column("vec").to_pylist()
            rid, node = t.column("rid").to_numpy(), t.column("node").to_numpy(zero_copy_only=False)
            left, right = t.column("left").to_numpy(zero_copy_only=False), t.column("right").to_numpy(zero_copy_only=False)
            counts, links = [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s < 2:
                    continue
                x = unit(np.frombuffer(b"".join(vecs[s:e]), width).reshape(e - s, -1).astype("<f8"))
                forest, n = Forest(e - s), np.zeros(e - s, np.int64)
                l_at, r_at = np.flatnonzero(left[s:e]), np.flatnonzero(right[s:e])
                y = x[r_at]
                for k in range(0, len(l_at), block):
                    rows = l_at[k : k + block]
                    near = x[rows] @ y.T >= cosine
                    near &= rid[s:e][rows][:, None] != rid[s:e][r_at][None]
                    n[rows] = near.sum(axis=1)
                    i, j = np.nonzero(near)
                    forest.link(rows[i], r_at[j])
                some = np.flatnonzero(n)
                counts.append((rid[s:e][some], n[some]))
                i, j = forest.edges()
                links.append((node[s:e][i], node[s:e][j]))
            for found, empty in ((counts, False), (links, True)):
                x, y = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
                none = pa.nulls(len(x), pa.int64())
                pair = [pa.array(v, pa.int64(), from_pandas=True) for v in (x, y)]
                yield pa.RecordBatch.from_arrays([none, none, *pair] if empty else [*pair, none, none], schema=schema)

    return run


def embedding_links(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, max_copies: float = 3.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A row per vector: id, n_links (other vectors of its label with cosine >= ``cosine``), component_id."""
    spark = vectors.sparkSession
    work = Workspace(spark, "embed")
    radius = float(np.sqrt(2 - 2 * cosine))
    width = "<f4" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"
    base = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.size(vec_col).alias("dim"), F.col(vec_col).cast("array<double>").alias("e"))
    finite = F.expr("coalesce(label is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(e, x -> x <> 0), false)")
    base = base.select("rid", "vec_id", "label", F.when(F.col("dim") < 0, None).otherwise(F.col("dim")).alias("dim"), finite.alias("ok"), "e")
    big = base.where("ok").groupBy("label", "dim").count().where(F.col("count") > cell).orderBy(F.desc("count"), "label", "dim").limit(MAX_GROUPS).collect()
    pivots: dict = {}
    if big:
        total = sum(r["count"] for r in big)
        names = spark.createDataFrame([(r.label, r.dim) for r in big], base.select("label", "dim").schema)
        drawn = base.where("ok").join(F.broadcast(names), ["label", "dim"]).where(F.expr(f"pmod(xxhash64(rid), {1 << 30})") < int(min(1.0, SAMPLE / total) * (1 << 30)))
        by_group: dict = {}
        for r in drawn.select("label", "dim", "e").collect():
            by_group.setdefault((r.label, r.dim), []).append(r.e)
        room = PIVOT_NUMBERS
        for r in big:
            if r.dim * MAX_PIVOTS > room:
                break
            if (rows := by_group.get((r.label, r.dim))) and (found := choose_pivots(unit(np.array(rows)), r["count"], radius, cell, max_copies)) is not None:
                pivots[r.label, r.dim] = found
                room -= found.size
    kinds = {"kind": vectors.schema[id_col].dataType.simpleString(), "label": vectors.schema[label_col].dataType.simpleString()}
    cells = work.table(base.mapInArrow(_assign(spark.sparkContext.broadcast(pivots), radius, width), _CELLS.format(**kinds)), "cells")
    placed = cells.where("cell is not null").withColumn("node", F.col("vec_id").cast("long"))
    sizes = placed.groupBy("label", "dim", "cell").count().where(F.col("count") > cell).withColumn("chunks", F.ceil(F.col("count") / cell).cast("int")).drop("count")
    sizes = work.table(sizes, "sizes")
    if sizes.count() <= MAX_BROADCAST:
        sizes = F.broadcast(sizes)
    chunk = F.expr("cast(pmod(xxhash64(rid), coalesce(chunks, 1)) as int)")
    dealt = placed.join(sizes, ["label", "dim", "cell"], "left").withColumn("chunk", chunk)
    role = lambda left, a, b: f"transform(sequence(0, coalesce(chunks, 1) - 1), o -> named_struct('a', {a}, 'b', {b}, 'left', {left} or chunk = o and own, 'right', not {left} or chunk = o))"
    dealt = dealt.withColumn("tile", F.explode(F.expr(f"concat({role('false', 'o', 'chunk')}, filter({role('true', 'chunk', 'o')}, x -> own and x.a <> x.b))")))
    dealt = dealt.select("label", "dim", "cell", "tile.a", "tile.b", "tile.left", "tile.right", "rid", "node", "vec")
    joined = dealt.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY).mapInArrow(_join_cells(cosine, width), "rid long, n long, src long, dst long")
    joined = work.table(joined, "joined")
    counts = work.table(joined.where("rid is not null").groupBy("rid").agg(F.sum("n").alias("n")), "counts")
    roots = connected_components(work, joined.where("src is not null and dst is not null").select("src", "dst"))
    owned = cells.where("own").select("rid", "vec_id")
    out = owned.join(counts, "rid", "left").join(roots, owned["vec_id"] == roots["node"], "left")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("root", F.col("vec_id").cast("long")).alias("component_id"))
