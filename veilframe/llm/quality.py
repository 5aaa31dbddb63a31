"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts. Training bins every statistic by quantiles, grows trees level by
level from gradient histograms under the logistic loss, and flattens them into arrays in heap order
(children of node k at 2k + 1 and 2k + 2); prediction walks all rows through all trees at once in numpy.

The trees are fitted to at most ``TRAIN_ROWS`` labelled rows (drawn by hash, expected number); held-out rows are never
used. Null and empty texts have statistics of zero and get a score like any other. Without labelled rows
every score is 0.5; labels without a document and null labels are left out. Rows that repeat an id are scored each; no
documents give no rows; other columns pass through ``score_quality``, those named like its results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

TRAIN_ROWS = 30_000
THRESHOLD = 0.3

_CLASSES = np.zeros((256, 9))
for _b in range(256):
    _c = chr(_b)
    for _k, _in in enumerate((_c.isascii() and _c.islower(), _c.isascii() and _c.isupper(), _c.isascii() and _c.isdigit(), _c in " \t\r\n", _c in ".,;:", _c in "#%&$*@^~=+<>", _c in "|_/\\{}[]", _c in "!?", 0x80 <= _b < 0xC0)):
        _CLASSES[_b, _k] = _in
STATISTICS = 28


def statistics(text: bytes | None) -> list[float]:
    """Statistics of a text's UTF-8 bytes."""
    text = text or b""
    classes = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    n = max(1.0, len(text) - classes[8])  # code points
    words = text.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    top = [c for _, c in counts.most_common(10)]
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    ends = Counter(w[-1:] for w in words)
    symbol_ends = sum(ends[c] for c in (b"#", b"%", b"&", b"$", b"*", b"@", b"!", b"|"))
    again = sum(map(bytes.__eq__, words, words[1:]))
    sentences = max(1, sum(text.count(c) for c in (b".", b"!", b"?")))
    return [
        np.log1p(n), np.log1p(len(words)), float(sizes.mean()) if len(words) else 0.0, float(sizes.std()) if len(words) else 0.0, *(classes[:8] / n),
        len(counts) / m, (top[0] / m) if top else 0.0, sum(top) / m, pairs / m, again / m, symbol_ends / m, len(set(lines)) / k, np.log1p(len(lines)), len(words) / k,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, sum(w.isupper() for w in counts) / max(1, len(counts)), sum(w.isdigit() for w in counts) / max(1, len(counts)), len(words) / sentences, classes[8] / n, text.count(b"http") / m, max((len(w) for w in counts), default=0),
    ]


class Trees:
    """Flattened trees: arrays (tree, node) of feature, threshold and value."""

    def __init__(self, base: float, depth: int, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.depth, self.feature, self.threshold, self.value = base, depth, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            node = np.zeros((len(x), len(self.feature)), np.int64)
            tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            total += self.value[tree, node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 4.0) -> Trees:
    """Histogram gradient boosting under the logistic loss. ``least``: hessian weight of a child."""
    n, d = x.shape
    if not n or y.min() == y.max():
        share = (y.sum() + 1) / (n + 2)
        return Trees(float(np.log(share / (1 - share))), 0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)  # value <= edge[b]: bin <= b
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    inner, whole = 2**depth - 1, 2 ** (depth + 1) - 1
    feature, threshold, value = np.zeros((trees, whole), np.int64), np.full((trees, whole), np.inf), np.zeros((trees, whole))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = node - first
            best = np.full(wide, 1e-9)
            pick = np.full((wide, 2), -1)
            gt, ht = np.bincount(local, g, wide), np.bincount(local, h, wide)
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = local * bins + binned[:, j]
                gl, hl = (np.bincount(key, w, wide * bins).reshape(wide, bins).cumsum(axis=1)[:, : len(edges[j])] for w in (g, h))
                gr, hr = gt[:, None] - gl, ht[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gt**2 / (ht + ridge))[:, None]
                gain[(hl < least) | (hr < least)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(wide), at]
                better = top > best
                best[better] = top[better]
                pick[better] = np.stack([np.full(wide, j), at], axis=1)[better]
            for k in range(wide):
                if pick[k, 0] >= 0:
                    feature[t, first + k], threshold[t, first + k] = pick[k, 0], edges[pick[k, 0]][pick[k, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        local = node - inner
        leaf = -rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + ridge)
        value[t, inner:] = leaf
        margin += leaf[local]
    return Trees(base, depth, feature, threshold, value)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents' other columns and an array ``stats``."""
    kept = [c for c in docs.columns if c not in (text_col, "stats")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t) for t in as_bytes(b.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(stats, pa.list_(pa.float64()))], names=[*kept, "stats"])

    return docs.select(*kept, F.col(text_col)).mapInArrow(run, f"{fields}, stats array<double>")


def train_quality(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, id_col: str = "doc_id", label_col: str = "quality") -> Trees:
    """Trees fitted to the documents' labels; a document with several label rows has their mean, rounded; of texts that share an id one is learned from."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.round(F.avg(label_col)).alias("y"))
    share = int(min(1.0, most_rows / max(1, known.count())) * (1 << 30))
    known = known.where(F.expr(f"pmod(xxhash64({id_col}), {1 << 30}) < {share}"))
    near = F.broadcast(known)  # most_rows, expected
    rows = with_statistics(docs.select(id_col, "text").join(near, id_col).select(id_col, "y", "text")).groupBy(id_col).agg(F.min(F.struct("stats", "y")).alias("row")).select("row.*").collect()
    x = np.array([r.stats for r in rows]).reshape(len(rows), STATISTICS)
    return fit_trees(x, np.array([r.y for r in rows], float))


def score_quality(docs: DataFrame, trees: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents' other columns, score (probability of label 1) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    kept = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in as_bytes(b.column(len(kept)))]).reshape(b.num_rows, STATISTICS)
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.select(*kept, F.col(text_col)).mapInArrow(run, f"{fields}, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled documents that are not held out, score all."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    flagged = docs.select("doc_id", "text").withColumn("held_out", held)
    trees = train_quality(flagged.where("not held_out"), labels)
    return score_quality(flagged, trees)
