"""Token-id files: one independent zstandard frame per document, a trailing seek table with per-frame checksums.

Layout of a file: a frame per document (its ids, little-endian unsigned 32-bit), one index frame (the
documents' ids), then the seek table of the zstandard seekable format: a skippable frame with the
compressed size, size and XXH64 checksum of every frame. Any zstandard reader can read the whole file; ``TokenFile``
reads the table and then only the frames it is asked for. Files follow each other in ascending document
order. Every task attempt writes a file of its own, and only the files of successful attempts enter the
manifest, so lost executors and retries leave no half-written data in the result.

Null ids come first, null texts are empty; documents with equal ids keep a row each, in a fixed order by
their text's hash. No documents give no file and no rows; other columns are not written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions_for
from .tokens import encoder

# Fixed values of the zstandard seekable format
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

FILE_BYTES = 256 << 20  # of text in a file, about


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    def __init__(self, uri: str, level: int = 3):
        import zstandard

        filesystem, path = _open(uri)
        filesystem.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = filesystem.open_output_stream(path, compression=None)
        self.codec = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.keys: list[int | None] = []

    def _frame(self, raw: bytes) -> None:
        from xxhash import xxh64_intdigest

        frame = self.codec.compress(raw)
        self.out.write(frame)
        self.table.append((len(frame), len(raw), xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self._frame(ids)

    def close(self) -> None:
        known = bytes(k is not None for k in self.keys)
        self._frame(np.array([k or 0 for k in self.keys], "<i8").tobytes() + known)
        entries = b"".join(struct.pack("<III", *t) for t in self.table)
        footer = struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class TokenFile:
    """Random access to a file's documents."""

    def __init__(self, uri: str):
        import zstandard

        filesystem, path = _open(uri)
        self.file = filesystem.open_input_file(path)
        self.codec = zstandard.ZstdDecompressor()
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError(f"no seek table at the end of {uri}")
        table = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(count, 3)
        self.sizes, self.checksums = table[:, :2].astype(np.int64), table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        raw = self._frame(count - 1)
        n = count - 1
        self.keys = [k if known else None for k, known in zip(np.frombuffer(raw, "<i8", n).tolist(), raw[8 * n :], strict=True)]

    def _frame(self, k: int) -> bytes:
        return self._check(k, self.file.read_at(int(self.sizes[k, 0]), int(self.starts[k])))

    def _check(self, k: int, frame: bytes) -> bytes:
        from xxhash import xxh64_intdigest

        raw = self.codec.decompress(frame, max_output_size=max(1, int(self.sizes[k, 1])))
        if len(raw) != self.sizes[k, 1] or xxh64_intdigest(raw) & 0xFFFFFFFF != self.checksums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, k: int) -> bytes:
        """Document k's ids; reads its frame only."""
        return self._frame(k)

    def scan(self, block: int = 8 << 20) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order, read in large blocks."""
        k, n = 0, len(self)
        while k < n:
            end = k + 1
            while end < n and self.starts[end + 1] - self.starts[k] <= block:
                end += 1
            data = self.file.read_at(int(self.starts[end] - self.starts[k]), int(self.starts[k]))
            for i in range(k, end):
                at = int(self.starts[i] - self.starts[k])
                yield self.keys[i], self._check(i, data[at : at + int(self.sizes[i, 0])])
            k = end


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write the documents in ascending id order; the manifest lists the files in that order: path, docs, tokens, base (tokens before it)."""
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        uri = f"{root}/tokens-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        codec, writer, tokens = encoder(tokenizer), None, 0
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                writer = writer or TokenFileWriter(uri)
                ids = codec.encode(text) + tail
                tokens += len(ids) // 4
                writer.add(k, ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "path": uri, "docs": len(writer.keys), "tokens": tokens}])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    files = max(partitions_for(docs.sparkSession), -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // FILE_BYTES))
    rows = rows.repartitionByRange(files, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    found = sorted(rows.mapInArrow(run, "part long, path string, docs long, tokens long").collect(), key=lambda r: r.part)
    manifest, base = [], 0
    for r in found:
        manifest.append({"path": r.path, "docs": r.docs, "tokens": r.tokens, "base": base})
        base += r.tokens
    return manifest


def read_token_files(spark: SparkSession, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start, n_tokens, ids_crc32, and the ids as bytes if asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for key, raw in TokenFile(path).scan():
                    rows.append((key, at, len(raw) // 4, zlib.crc32(raw), *[raw] * with_ids))
                    at += len(raw) // 4
                    if len(rows) == 2000:
                        yield _batch(rows, with_ids)
                        rows = []
                yield _batch(rows, with_ids)

    files = spark.createDataFrame([(m["path"], m["base"]) for m in manifest], "path string, base long")
    return files.repartition(max(1, len(manifest))).mapInArrow(run, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[k for k, _ in kinds])


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write to the shared folder and read back."""
    work = Workspace(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, write_token_files(docs, work.path("files"), tokenizer, end_id, id_col, text_col))
