"""Incremental line deduplication that can be undone: exact reference counts behind sharded cuckoo filters.

A line's key is the line without outer white space, ASCII letters in lower case; a 128-bit digest stands for it. A
``LineIndex`` keeps, in the shared folder,

* deltas of a reference-count table: for every key in how many documents it occurs. ``insert`` and ``delete`` each add one
  small delta; a key's count is the sum over the deltas, ``compact`` folds them into one.
* cuckoo filters of the keys that are frequent (counted in ``min_docs`` documents or more), cut into shards by digest. An
  insertion that lifts a key over the threshold puts its fingerprint in, a deletion that takes it below removes it: what
  was dropped from a document comes back as soon as its line is rare again. A shard that runs full is built anew from the counts.

``filter_lines`` scans documents once. A line that its shard's filter does not know is kept at once; a line that it knows is
frequent unless it is one of the known keys that only look like one, which the exact counts have told when the shard was made
("exceptions", about one rare key in 8,000). Filters and exceptions together are broadcast while they measure ``MAX_BROADCAST``
or less. Beyond that the lines that a shard's filter passes meet its counts in a join and the dropped numbers go back to their
documents, so no broadcast grows with the corpus. Both ways give the same rows.

Each row is a document of its own, also rows that repeat an id; null ids are like others. Null and empty texts are one empty
line, which is never dropped (keys under ``min_chars`` code points never are). No documents, no rows. Other columns pass
through; columns named like the results are replaced. Deleting a document that was never inserted is an error and leaves the
index as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, as_bytes

MIN_DOCS = 10
SHARD_KEYS = 1 << 14  # frequent keys that a shard is laid out for
SLOTS = 4  # fingerprints of a bucket
MAX_BROADCAST = 64 << 20
_KICKS = 500
_HASHES, _HELD_DOCS = 1 << 20, 1 << 16  # line digests, and documents, that a task holds before it hands them on
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEY = "hi long, lo long"
_FILTER = "shard int, buckets binary, n_keys long, exceptions binary"


# ---- keys ----
def line_keys(text: bytes | None, min_chars: int = 1) -> list[bytes]:
    """The key of every line; keys that are too short are empty."""
    keys = [x.strip() for x in (text or b"").lower().split(b"\n")]  # of bytes: exactly ASCII letters and white space
    if min_chars > 1:
        keys = [k if len(k.decode(errors="replace")) >= min_chars else b"" for k in keys]
    return keys


def digests(keys: list[bytes]) -> np.ndarray:
    """(n, 2) int64: 128 bits of each key; empty keys give zeros, which no counted key has."""
    nothing = bytes(16)
    joined = b"".join([xxhash.xxh3_128_digest(k) if k else nothing for k in keys])
    return np.frombuffer(joined, np.int64).reshape(-1, 2)


def distinct_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of an (n, 2) array and how often each occurs."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    rows = pairs[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1))) if len(rows) else np.empty(0, np.int64)
    return rows[first], np.diff(np.append(first, len(rows)))


def shards_of(hi: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the top bits of the digest; ``shards`` is a power of two."""
    return (hi.view(np.uint64) >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(hi), np.int64)


# ---- cuckoo filters ----
def places(hi: np.ndarray, lo: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint (16 bits, never 0) and both buckets of each key; each bucket follows from the other and the fingerprint."""
    fp = ((lo.view(np.uint64) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    one = (lo.view(np.uint64) & np.uint64(buckets - 1)).astype(np.int64)
    return fp, one, other(one, fp, buckets)


def other(bucket: np.ndarray, fp: np.ndarray, buckets: int) -> np.ndarray:
    return bucket ^ ((fp.astype(np.uint64) * _MIX >> np.uint64(40)) & np.uint64(buckets - 1)).astype(np.int64)


class CuckooFilter:
    """Fingerprints in buckets of four, each key in one of two buckets."""

    def __init__(self, keys: int = 0, table: bytes | None = None):
        if table is None:
            size = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85)))))
            self.table = np.zeros((size, SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()

    def has(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp, one, two = places(hi, lo, len(self.table))
        return (self.table[one] == fp[:, None]).any(1) | (self.table[two] == fp[:, None]).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False as soon as a key finds no place: the shard is then built anew, larger."""
        table, rng = self.table, np.random.default_rng(len(self.table))
        for fp, one, two in zip(*places(hi, lo, len(table)), strict=True):
            for at in (one, two):
                if len(free := np.flatnonzero(table[at] == 0)):
                    table[at, free[0]] = fp
                    break
            else:
                at = (one, two)[rng.integers(2)]
                for _ in range(_KICKS):
                    k = rng.integers(SLOTS)
                    fp, table[at, k] = table[at, k], fp
                    at = int(other(np.array([at]), np.array([fp]), len(table))[0])
                    if len(free := np.flatnonzero(table[at] == 0)):
                        table[at, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out keys that were put in; equal fingerprints are one another's copies, so any of them may go."""
        for fp, one, two in zip(*places(hi, lo, len(self.table)), strict=True):
            at = one if (self.table[one] == fp).any() else two
            self.table[at, np.flatnonzero(self.table[at] == fp)[0]] = 0

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> "CuckooFilter":
        size = len(hi)
        while True:
            made = cls(size)
            if made.insert(hi, lo):
                return made
            size = max(2 * size, 8)


class Shards:
    """All filters side by side, for lookups of many lines at once."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], shards: int):
        self.shards = shards
        tables = {s: np.frombuffer(t, np.uint16).reshape(-1, SLOTS) for s, t, _ in rows}
        sizes = np.array([len(tables[s]) if s in tables else 0 for s in range(shards)])
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.table = np.concatenate([*(tables[s] for s in sorted(tables)), np.zeros((1, SLOTS), np.uint16)])
        odd = np.concatenate([*(np.frombuffer(e, np.int64).reshape(-1, 2) for _, _, e in rows), np.empty((0, 2), np.int64)])
        self.exceptions = set(map(tuple, odd.tolist()))

    def passes(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Which lines the filters know."""
        shard = shards_of(hi, self.shards)
        size = np.maximum(self.sizes[shard], 1).astype(np.uint64)
        fp = ((lo.view(np.uint64) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = lo.view(np.uint64) & (size - np.uint64(1))
        two = one ^ ((fp.astype(np.uint64) * _MIX >> np.uint64(40)) & (size - np.uint64(1)))
        there = self.sizes[shard] > 0
        at = np.where(there, self.starts[shard], len(self.table) - 1)
        hit = (self.table[at + np.where(there, one, 0).astype(np.int64)] == fp[:, None]).any(1) | (self.table[at + np.where(there, two, 0).astype(np.int64)] == fp[:, None]).any(1)
        return hit & ((hi != 0) | (lo != 0))

    def frequent(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """``passes`` less the exceptions: exact for keys that the index has counted."""
        hit = self.passes(hi, lo)
        if self.exceptions:
            for k in np.flatnonzero(hit).tolist():
                hit[k] = (int(hi[k]), int(lo[k])) not in self.exceptions
        return hit


# ---- counting ----
def key_counts(docs: DataFrame, sign: int = 1, min_chars: int = 1) -> DataFrame:
    """hi, lo, n: in how many of these documents each key occurs, times ``sign``. A task sums its own documents first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def hand_on() -> pa.RecordBatch:
            keys, n = distinct_pairs(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n * sign)], ["hi", "lo", "n"])

        for b in batches:
            for text in as_bytes(b.column("text")):
                own, _ = distinct_pairs(digests(line_keys(text, min_chars)))
                own = own[own.any(1)]
                held.append(own)
                size += len(own)
                if size >= _HASHES or len(held) >= _HELD_DOCS:
                    yield hand_on()
                    held, size = [], 0
        if size:
            yield hand_on()

    return docs.select("text").mapInArrow(count, _KEY + ", n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


class LineIndex:
    """Reference counts and filters of the lines of a corpus, kept in a folder of the shared store."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = 1, shard_keys: int = SHARD_KEYS, max_broadcast: int = MAX_BROADCAST):
        self.spark, self.min_docs, self.min_chars, self.shard_keys, self.max_broadcast = spark, min_docs, min_chars, shard_keys, max_broadcast
        self.work = Workspace(spark, "lines")
        self.step = 0
        self.deltas: list[DataFrame] = []
        self.filters: DataFrame | None = None
        self.shards = 1

    # -- changes --
    def insert(self, docs: DataFrame) -> "LineIndex":
        return self._change(docs, 1)

    def delete(self, docs: DataFrame) -> "LineIndex":
        return self._change(docs, -1)

    def counts(self) -> DataFrame:
        """hi, lo, n of all keys with documents left."""
        if not self.deltas:
            return self.spark.createDataFrame([], _KEY + ", n long")
        if len(self.deltas) == 1:
            return self.deltas[0]
        rows = self.deltas[0]
        for d in self.deltas[1:]:
            rows = rows.unionByName(d)
        return rows.groupBy("hi", "lo").agg(F.sum("n").alias("n")).where("n <> 0")

    def compact(self) -> "LineIndex":
        """Fold all deltas into one table."""
        if len(self.deltas) > 1:
            self.deltas = [self._table(self.counts(), "counts")]
        return self

    def _table(self, df: DataFrame, name: str) -> DataFrame:
        self.step += 1
        return self.work.table(df, f"{name}-{self.step}")

    def _change(self, docs: DataFrame, sign: int) -> "LineIndex":
        delta = self._table(key_counts(docs, sign, self.min_chars), "delta")
        if not self.deltas:
            if sign < 0 and not delta.isEmpty():
                raise ValueError("a document was deleted that the index does not hold")
            self.deltas, self.filters = [delta], None
            return self
        before = self.counts().withColumnRenamed("n", "old")
        changed = self._table(delta.join(before, ["hi", "lo"], "left").select("hi", "lo", "n", F.coalesce("old", F.lit(0)).alias("old")), "changed")
        if sign < 0 and not changed.where("old + n < 0").isEmpty():
            raise ValueError("a document was deleted that the index does not hold")
        self.deltas.append(delta)
        if self.filters is not None:
            self._update(changed)
        return self

    # -- filters --
    def build(self) -> "LineIndex":
        """Lay out the shards for the frequent keys and fill them from the counts."""
        frequent = self.counts().where(F.col("n") >= self.min_docs).count()
        self.shards = 1 << max(0, int(np.ceil(np.log2(max(1, frequent) / self.shard_keys))))
        self.filters = self._table(self._built(self.counts(), self.shards), "filters")
        return self

    def _built(self, counts: DataFrame, shards: int) -> DataFrame:
        """Filters of these counts. Frequent keys make the shards; then rare keys are tried at them, where they lie, for exceptions."""
        made = self._table(_by_shard(counts.where(F.col("n") >= self.min_docs), shards).groupBy("shard").applyInPandas(_make, _FILTER), "made")
        return self._with_exceptions(made, counts, shards)

    def _with_exceptions(self, made: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
        """The shards of ``made`` with the rare keys of ``counts`` that they take for frequent. Rare keys are spread by digest: no shard gathers them, only the few that pass."""
        rare = counts.where(F.col("n") < self.min_docs)
        odd = self._passing(rare.select("hi", "lo"), made, shards).withColumn("shard", _shard_column(shards))
        lists = odd.groupBy("shard").applyInPandas(_exceptions, "shard int, odd binary")
        return made.drop("exceptions").join(lists, "shard", "left").select("shard", "buckets", "n_keys", F.coalesce("odd", F.lit(b"")).alias("exceptions"))

    def _passing(self, keys: DataFrame, made: DataFrame, shards: int) -> DataFrame:
        """The rows of ``keys`` (hi, lo and others) that the filters know."""
        columns = keys.columns
        if self._size(made) <= self.max_broadcast:
            box = self.spark.sparkContext.broadcast(Shards([(r.shard, bytes(r.buckets), b"") for r in made.select("shard", "buckets").collect()], shards))  # of checked size

            def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.filter(pa.array(box.value.passes(b.column("hi").to_numpy(), b.column("lo").to_numpy())))

            return keys.mapInArrow(look, keys.schema)
        # a filter and a slice of its shard's keys meet: salted, so the lines of a hot key spread over tasks
        salt = 16
        spread = keys.withColumn("shard", _shard_column(shards)).withColumn("salt", F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(salt)).cast("int"))
        copies = made.select("shard", "buckets").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        fp = F.pmod(F.shiftrightunsigned("lo", 48), F.lit(65535)) + 1
        joined = spread.join(copies, ["shard", "salt"]).withColumn("fp", fp)

        def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for b in batches:
                hit = np.zeros(len(b), bool)
                for table, own in b.groupby("buckets", sort=False).groups.items():
                    rows = b.loc[own]
                    hit[own] = CuckooFilter(table=table).has(rows["hi"].to_numpy(), rows["lo"].to_numpy())
                yield pd.Series(hit)

        return joined.where(F.pandas_udf(test, "boolean")(F.struct("hi", "lo", "buckets"))).select(*columns)

    def _update(self, changed: DataFrame) -> None:
        """Carry keys that crossed the threshold into the filters; shards that run full are laid out anew from the counts."""
        went = F.when((F.col("old") < self.min_docs) & (F.col("old") + F.col("n") >= self.min_docs), 1).when((F.col("old") >= self.min_docs) & (F.col("old") + F.col("n") < self.min_docs), -1)
        crossed = _by_shard(changed.withColumn("went", went).where("went is not null"), self.shards).select("shard", "hi", "lo", "went")
        updated = self._table(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(_move, _FILTER + ", full boolean"), "moved")
        largest = updated.agg(F.max("n_keys").alias("most"), F.max(F.col("full").cast("int")).alias("full")).first()
        if largest.full or (largest.most or 0) > 4 * self.shard_keys:
            self.build()
            return
        self.filters = self._table(self._with_exceptions(updated.drop("full"), self.counts(), self.shards), "filters")

    @staticmethod
    def _size(filters: DataFrame) -> int:
        extra = F.length("exceptions") if "exceptions" in filters.columns else F.lit(0)
        return filters.agg(F.coalesce(F.sum(F.length("buckets") + extra), F.lit(0)).alias("n")).first().n

    # -- use --
    def filter_lines(self, docs: DataFrame) -> DataFrame:
        """The documents of the index with ``kept_text``, ``n_lines`` and ``n_dropped``: lines whose key is frequent now are gone."""
        if self.filters is None:
            self.build()
        docs = docs.drop("kept_text", "n_lines", "n_dropped")
        return self._filter_by_broadcast(docs) if self._size(self.filters) <= self.max_broadcast else self._filter_by_join(docs)

    def _filter_by_broadcast(self, docs: DataFrame) -> DataFrame:
        rows = [(r.shard, bytes(r.buckets), bytes(r.exceptions)) for r in self.filters.collect()]  # of checked size
        box, min_chars = self.spark.sparkContext.broadcast(Shards(rows, self.shards)), self.min_chars

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _with_kept(b, (box.value.frequent(*digests(line_keys(t, min_chars)).T.copy()) for t in as_bytes(b.column("text"))))

        return docs.mapInArrow(cut, _kept_schema(docs))

    def _filter_by_join(self, docs: DataFrame) -> DataFrame:
        min_chars = self.min_chars

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row, text in zip(b.column("_row").to_pylist(), as_bytes(b.column("text")), strict=True):
                    d = digests(line_keys(text, min_chars))
                    at = np.flatnonzero(d.any(1))
                    yield pa.RecordBatch.from_arrays([pa.array(d[at, 0]), pa.array(d[at, 1]), pa.array(np.full(len(at), row)), pa.array(at.astype(np.int32))], ["hi", "lo", "_row", "line"])

        numbered = self._table(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")  # read twice, so the numbers must stay
        found = self._passing(numbered.select("_row", "text").mapInArrow(lines, _KEY + ", _row long, line int"), self.filters, self.shards)
        frequent = self._table(self.counts().where(F.col("n") >= self.min_docs).select("hi", "lo"), "frequent")
        sure = self._table(found, "passed").join(frequent, ["hi", "lo"], "left_semi")
        gone = self._table(sure.groupBy("_row").agg(F.collect_list("line").alias("_gone")), "gone")  # at most a document's own lines

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _with_kept(b.select([c for c in b.schema.names if c != "_gone"]), _marks(b))

        joined = numbered.join(gone, "_row", "left")
        return joined.select(*docs.columns, "_gone").mapInArrow(cut, _kept_schema(docs))


def _marks(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    for text, gone in zip(as_bytes(b.column("text")), b.column("_gone").to_pylist(), strict=True):
        out = np.zeros((text or b"").count(b"\n") + 1, bool)
        out[gone or []] = True
        yield out


def _kept_schema(docs: DataFrame) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "kept_text string", "n_lines long", "n_dropped long"])


def _with_kept(b: pa.RecordBatch, gone: Iterator[np.ndarray]) -> pa.RecordBatch:
    kept, lines, dropped = [], [], []
    for text, out in zip(as_bytes(b.column("text")), gone, strict=True):
        parts = (text or b"").split(b"\n")
        lines.append(len(parts))
        dropped.append(int(out.sum()))
        kept.append(b"\n".join(p for p, x in zip(parts, out.tolist(), strict=True) if not x) if dropped[-1] else text or b"")
    more = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
    return pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "kept_text", "n_lines", "n_dropped"])


def _shard_column(shards: int):
    return F.shiftrightunsigned("hi", 64 - shards.bit_length() + 1).cast("int") if shards > 1 else F.lit(0)


def _by_shard(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", _shard_column(shards))


def _make(own: pd.DataFrame) -> pd.DataFrame:
    own = own.sort_values(["hi", "lo"])  # the same filter whichever order rows come in
    made = CuckooFilter.of(own["hi"].to_numpy(), own["lo"].to_numpy())
    return pd.DataFrame({"shard": [own["shard"].iloc[0]], "buckets": [made.table.tobytes()], "n_keys": [len(own)], "exceptions": [b""]})


def _move(held: pd.DataFrame, crossed: pd.DataFrame) -> pd.DataFrame:
    """One shard after its keys that became rare have gone and those that became frequent have come."""
    rows = held if len(held) else pd.DataFrame({"shard": [crossed["shard"].iloc[0]], "buckets": [CuckooFilter(len(crossed)).table.tobytes()], "n_keys": [0], "exceptions": [b""]})
    made = CuckooFilter(table=rows["buckets"].iloc[0])
    crossed = crossed.sort_values(["hi", "lo"])
    gone, come = crossed[crossed["went"] < 0], crossed[crossed["went"] > 0]
    made.delete(gone["hi"].to_numpy(), gone["lo"].to_numpy())
    fits = made.insert(come["hi"].to_numpy(), come["lo"].to_numpy())
    return pd.DataFrame({"shard": rows["shard"].to_numpy(), "buckets": [made.table.tobytes()], "n_keys": [int(rows["n_keys"].iloc[0]) + len(come) - len(gone)], "exceptions": [b""], "full": [not fits]})


def _exceptions(own: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [own["shard"].iloc[0]], "odd": [np.ascontiguousarray(own[["hi", "lo"]].to_numpy(np.int64)).tobytes()]})


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, **layout) -> DataFrame:
    """The documents with ``kept_text``: lines found in ``min_docs`` of them or more are gone from all."""
    return LineIndex(docs.sparkSession, min_docs, min_chars, **layout).insert(docs).filter_lines(docs)
