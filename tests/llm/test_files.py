"""Archives, token files, packing and the pipeline: exact round trips and brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD

from veilframe.llm import packing, warc
from veilframe.llm.common import Workspace
from veilframe.llm.token_files import TokenFile, read_token_files, token_files, write_token_files
from veilframe.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, row long")


@pytest.mark.parametrize("segment", [64, 8192])
def test_archives_round_trip(spark, segment):
    rng = random.Random(4)
    part = warc.PART.decode()
    rows = [(i, f"http://e.org/{i}?q=é\r\nX: y", "".join(rng.choice("abé\n\r ") for _ in range(rng.randrange(0, 400)))) for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (52, "u", None), (53, "u", part * 3), (54, "u", "0\r\n\r\n" + part), (55, "u", "same"), (56, "u", "same"), (57, "u", "same"), (57, "u", "same"), (None, "u", "same"), (None, "u", "alone"), (60, "u", "z" * 100000)]
    work = Workspace(spark)
    warc.write_archives(pages_of(spark, rows), work.path("a"), work, segment)
    got = warc.read_archives(spark, work.path("a"), with_payload=True).collect()
    assert len(got) == len(rows)
    text = lambda h: (h or "").encode()
    top = defaultdict(lambda: -1)
    for p, _, h in rows:
        top[text(h)] = max(top[text(h)], -1 if p is None else p)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    for p, _, h in rows:
        for r in by[p] if p is not None else []:
            assert r.payload_bytes == len(text(h)) and r.payload_digest == base64.b32encode(hashlib.sha1(text(h)).digest()).decode()
            assert r.record_type == "revisit" or bytes(r.payload) == text(h)
            assert r.refers_to == (None if r.record_type == "response" else top[text(h)])
            if p != 57:
                assert (r.record_type == "response") == (p == top[text(h)])
    assert sorted(r.record_type for r in by[57]) == ["response", "revisit"]
    assert sorted((r.record_type, r.refers_to) for r in by[None]) == [("response", None), ("revisit", 57)]
    assert warc.archive_pages(pages_of(spark, [])).count() == 0


def test_archives_are_plain_zstandard(spark):
    """A reader that knows nothing of the delimiter sees one long WARC with segments in it."""
    import glob

    import zstandard

    work = Workspace(spark)
    warc.write_archives(pages_of(spark, [(1, "u", "abc" * 200)]), work.path("a"), work, 100)
    data = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f, "rb"), read_across_frames=True).read() for f in glob.glob(work.path("a").removeprefix("file://") + "/part-*"))
    (total,) = re.findall(rb"WARC-Segment-Total-Length: (\d+)", data)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response") and data.count(b"WARC-Type: continuation") == math.ceil(int(total) / 100) - 1


def test_missing_segment_is_an_error(spark):
    work = Workspace(spark)
    warc.write_archives(pages_of(spark, [(1, "u", "abc" * 200)]), work.path("a"), work, 100)
    whole = spark.read.option("lineSep", warc.PART.decode()).text(work.path("a")).select(F.col("value").cast("binary").alias("b")).collect()
    some = [bytes(r.b) for k, r in enumerate(whole) if k != 3]
    spark.createDataFrame([(bytearray(x),) for x in some], "b binary").select(F.col("b").cast("string")).write.option("lineSep", warc.PART.decode()).text(work.path("b"))
    with pytest.raises(Exception, match="segment"):
        warc.read_archives(spark, work.path("b")).collect()


def test_chunks():
    for data in (b"", b"a", b"\r\n" * 5000):
        assert warc.unchunked(warc.chunked(data, 7)) == data
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"


def test_encoder_equals_the_library(library):
    rng = random.Random(8)
    mine = Encoder(default_path())
    texts = [t for _, t in ODD] + ["a  b", " a", "a\n b \n\n c", "it's  we'll\tx ' s", "x <|endoftext|> y", "１２ a\x1cb\xa0c d", "  x", "Füße №5 ½ ² x"]
    alphabet = "ab C1.'\n\t é½² \x1c　日<|>"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == library(t), repr(t)


def test_token_files(spark, docs, library):
    rows = [*ODD, *((i, f"text number {i} " * (i % 9)) for i in range(50, 400))]
    work = Workspace(spark)
    manifest = write_token_files(docs(rows), work.path("t"), default_path())
    got = read_token_files(spark, manifest, with_ids=True).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    start = 0
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(np.array([*library(t), 0], "<u4").tobytes())
    for r in got:
        assert bytes(r.ids) in texts[r.doc_id] and r.start == start and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        start += r.n_tokens
    f = TokenFile(manifest[-1]["path"])
    assert f.ids(len(f) - 1) == bytes(got[-1].ids)  # random access
    assert token_files(docs([]), default_path()).count() == 0


def test_damaged_frame_is_an_error(spark, docs):
    work = Workspace(spark)
    (m,) = write_token_files(docs([(1, "some words here")]), work.path("t"), default_path())
    path = m["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[12] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017
        TokenFile(m["path"]).ids(0)


def packed(rows, lengths, capacity):
    """Sequences if the rows are a valid packing of the lengths."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert pieces.keys() == lengths.keys()
    for doc, parts in pieces.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == lengths[doc]
        assert all(p[1] == sum(q[2] for q in parts[: p[0]]) for p in parts)
        assert len(parts) == max(1, math.ceil(lengths[doc] / capacity)) and all(p[2] == capacity for p in parts[1:])
    return len(bins)


def test_packing(spark, docs, library):
    rows = [(i, t) for i, t in dict(ODD).items() if i is not None] + [(i, f"w{i} " * (i % 37)) for i in range(100, 400)]
    lengths = {i: len(library(t)) + 1 for i, t in rows}
    for capacity in (64, 1024):
        got = packing.pack_documents(docs(rows), default_path(), capacity, with_ids=True).collect()
        n = packed(got, lengths, capacity)
        assert n <= math.ceil(sum(lengths.values()) / capacity) * 1.02 + 2
        text = dict(rows)
        for r in got:
            ids = np.array([*library(text[r.doc_id]), 2], "<u4")[r.start : r.start + r.length].tobytes()
            assert bytes(r.ids) == ids and zlib.crc32(ids) == r.ids_crc32
    twice = packing.pack_documents(docs([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)]), default_path()).collect()
    assert len(twice) == 4 and len({(r.sequence_id, r.offset) for r in twice}) == 4
    assert packing.pack_documents(docs([]), default_path()).count() == 0


def test_fullest_is_the_best_subset():
    rng = random.Random(6)
    for _ in range(300):
        counts = [0, *(rng.choice([0, 0, 1, 2]) for _ in range(14))]
        room = rng.randrange(0, 30)
        sums = {0}
        for n, c in enumerate(counts):
            for _ in range(c):
                sums |= {s + n for s in sums if s + n <= room}
        got = packing.fullest(counts, room)
        assert sum(n * k for n, k in got.items()) == max(sums) and all(0 < k <= counts[n] for n, k in got.items())


def test_plan_places_all_and_stays_small():
    rng = random.Random(9)
    counts = [0, *(int(rng.expovariate(1 / 5000)) for _ in range(1024))]
    plan = packing.plan_bins(counts)
    used = [0] * 1025
    for bins, times in plan:
        assert sum(n * k for n, k in bins.items()) <= 1024
        for n, k in bins.items():
            used[n] += k * times
    assert used == counts and len(plan) < 1024 * 8
    least = max(math.ceil(sum(n * c for n, c in enumerate(counts)) / 1024), sum(counts[513:]))  # no two of these share a sequence
    assert sum(t for _, t in plan) <= least * 1.02


def test_warc_query_equals_sql(spark, sf):
    from veilframe.llm import oracles, queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    got = [tuple(r[c] for c in cols) for r in queries.op2_warc_segments(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({oracles.OP2})").fetchall(), key=str)


def test_pipeline_stages(spark, docs, library):
    """Every stage against a brute-force version over planted cases."""
    import corpus_pipeline

    from tests.llm.test_near_copies import brute_roots
    from tests.llm.test_scans import brute_contamination

    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [*real, (9001, "12 34 !!", "en"), (9002, None, "en"), (9003, real[0][1], real[0][2]), (9004, "the of and " + items[3][1] + " in the end", "en"), (9005, "write to the and of a.b@example.org and to the of [at] once", "en"), (9003, real[0][1], real[0][2])]
    given = docs(rows)
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]
    work = Workspace(spark)

    kept = work.table(stage["language_id"](spark, given, sf), "1")
    assert kept.columns == given.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert ids == sorted(r[0] for r in rows if r[0] not in (9001, 9002))

    unique = work.table(stage["near_duplicates"](spark, kept, sf), "2")
    before = sorted((r.doc_id, r.text) for r in kept.collect())
    assert sorted(r.doc_id for r in unique.collect()) == sorted(before[i][0] for i in set(brute_roots(before)))

    clean = work.table(stage["decontamination"](spark, unique, sf), "3")
    before = [(r.doc_id, r.text) for r in unique.collect()]
    left = [d for d, (n, h, _) in zip(before, brute_contamination(before, items), strict=True) if not (h and 20 * h >= n)]
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == sorted(left) and 9004 not in dict(left)

    private = work.table(stage["personal_data"](spark, clean, sf), "4")
    after = {r.doc_id: r for r in private.collect()}
    assert after.keys() == dict(left).keys() and after[9005].text == "write to the and of [EMAIL] and to the of [at] once"
    assert all(r.n_chars == len(r.text) for r in after.values())

    lengths = {i: len(library(r.text)) + 1 for i, r in after.items()}
    packed(stage["packing"](spark, private, sf).collect(), lengths, 1024)
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_of_nothing(spark, docs):
    import corpus_pipeline

    empty = docs([])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "/root/testdata/sf0.001")
        assert out.count() == 0
