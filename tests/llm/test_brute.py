"""Registered queries and learners against plain brute-force versions."""

import zlib
from collections import Counter

import numpy as np
import pytest

from veilframe.llm import langid, quality, queries, warc
from veilframe.llm.common import Workspace
from veilframe.llm.tokens import default_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_flat_trees_equal_a_walk_from_node_to_node():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)).round(1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0).astype(float)
    trees = quality.fit_trees(x, y, trees=12, depth=3)

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            k = 0
            for _ in range(trees.depth):
                k = 2 * k + (2 if row[f[k]] > t[k] else 1)
            total += v[k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x])


def test_histogram_splits_equal_exhaustive_ones():
    """With a bin for every value, the first tree's root is the best of all splits of all columns."""
    rng = np.random.default_rng(2)
    for _ in range(10):
        x = rng.integers(0, 8, size=(60, 3)).astype(float)
        y = (x[:, rng.integers(3)] + rng.normal(size=60) > 4).astype(float)
        if y.min() == y.max():
            continue
        trees = quality.fit_trees(x, y, trees=1, depth=1, least=0.5)
        p = y.mean()
        g, h = p - y, np.full(60, p * (1 - p))
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        best = {(j, t): gain(x[:, j] <= t) + gain(x[:, j] > t) for j in range(3) for t in np.unique(x[:, j])[:-1] if h[x[:, j] <= t].sum() >= 0.5 <= h[x[:, j] > t].sum()}
        at = trees.feature[0, 0], trees.threshold[0, 0]
        left = x[:, at[0]] <= at[1]
        assert gain(left) + gain(~left) == pytest.approx(max(best.values()))


def plain_ngrams(text):
    out, word = Counter(), ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = "\x01" + word + "\x01"
            out.update(word)
            out.update(padded[i : i + 2] for i in range(len(padded) - 1))
            out.update(padded[i : i + 3] for i in range(len(padded) - 2))
            word = ""
    return out


def code(gram):
    total = 0
    for c in gram:
        total = total << 21 | ord(c)
    return total


def plain_rank(counts, most):
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:most])}


def test_registered_languages_equal_dictionaries(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    profiles = {}
    for d, text, lang in docs:
        if not held(d) and lang is not None and text is not None:
            profiles.setdefault(lang, Counter()).update(plain_ngrams(text))
    profiles = {lang: plain_rank(c, langid.PROFILE) for lang, c in profiles.items()}
    got = {r.doc_id: r for r in queries.op9_language_profiles(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, text, _ in docs:
        own = plain_rank(plain_ngrams(text), langid.OWN)
        apart = {lang: sum(min(abs(rank - p[g]), langid.PROFILE) if g in p else langid.PROFILE for g, rank in own.items()) for lang, p in profiles.items()}
        want = min(apart, key=lambda lang: (apart[lang], lang)) if own else langid.UNKNOWN
        assert (got[d].lang_pred, got[d].held_out) == (want, held(d))
        assert got[d].score == pytest.approx(1 - apart[want] / (langid.PROFILE * len(own)) if own else 0)


def test_registered_token_files_and_packing(spark, sf, library):
    ids = {r.doc_id: library(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    at, want = 0, {}
    for d in sorted(ids):
        want[d] = (at, len(ids[d]) + 1, crc([*ids[d], 0]))
        at += len(ids[d]) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_files(spark, sf).collect()} == want
    pieces, used = {}, {}
    for r in queries.op10_pack_min_slack(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for d, parts in pieces.items():
        whole, parts = [*ids[d], 2], sorted(parts)
        assert [p[1] for p in parts] == [sum(q[2] for q in parts[:k]) for k in range(len(parts))] and sum(p[2] for p in parts) == len(whole)
        assert all(c == crc(whole[s : s + n]) for _, s, n, c in parts) and all(n == 1024 for _, _, n, _ in parts[1:])
    for places in used.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024
    assert len(used) <= 1.02 * sum(len(x) + 1 for x in ids.values()) / 1024 + 1


def test_damaged_archives_are_reported(spark):
    html = "".join(chr(33 + i * 7 % 90) for i in range(30_000))
    pages = spark.createDataFrame([(1, "http://a", html), (2, "http://b", "short"), (3, "http://c", html[::-1])], "page_id long, url string, html string")
    work = Workspace(spark, "damaged")
    warc.write_archives(pages, work.path("whole"), work)
    import zstandard

    read = lambda frame: warc.parse_record(zstandard.ZstdDecompressor().stream_reader(frame, read_across_frames=True).read())[0]
    frames = [bytes(r.f) for r in spark.read.option("lineSep", warc.PART.decode()).text(work.path("whole")).selectExpr("cast(value as binary) f").collect()]
    frames = [f for f in frames if not (read(f).get("warc-segment-number") == "2" and "page:3" in read(f)["warc-segment-origin-id"])] + [b"no record"]
    spark.createDataFrame([(f,) for f in frames], "f binary").selectExpr("cast(f as string) value").write.option("lineSep", warc.PART.decode()).text(work.path("cut"))
    got = warc.read_archives(spark, work.path("cut"), report=True).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in got) == [(0, "damaged"), (0, "damaged"), (1, "response"), (2, "response")]
    assert any("page:3" in (r.problem or "") and "segment 2" in r.problem for r in got)
    with pytest.raises(Exception, match="segment 2 is missing|Unknown frame|not a WARC"):
        warc.read_archives(spark, work.path("cut")).collect()


def test_vectors_of_extreme_sizes_and_many_tiles(spark):
    from veilframe.llm.embed_dedup import embedding_links

    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 4))
    rows, scale = [], [1e-200, 1.0, 1e200]
    for i in range(180):
        v = (base[i % 12] + rng.normal(size=4) * 0.05) * scale[i % 3]
        rows.append((i, v.tolist(), i % 2))
    got = embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell=16).collect()
    u = np.array([np.array(v) / np.abs(v).max() for _, v, _ in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.arange(180)[:, None] != np.arange(180)) & (np.arange(180)[:, None] % 2 == np.arange(180) % 2)
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(near.sum(axis=1).tolist())) and near.any()
