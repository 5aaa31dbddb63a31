"""The pipeline's near copies against exact Jaccard similarities of five-word shingles."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import ODD
from tests.llm.test_pairs import groups

from veilframe.llm import near_copies, simhash
from veilframe.llm.common import Workspace


def brute_roots(rows):
    """Of sorted rows, the first row of each row's group."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    return groups(len(rows), links)


def brute_groups(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    return [(rows[i][0], rows[r][0]) for i, r in enumerate(brute_roots(rows))]


def planted():
    """Copies with every fifth to fiftieth word changed, chains, a common passage in half of the texts."""
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, rows = text(60), []
    for _ in range(60):
        base = text(rng.randrange(8, 200)) + passage * rng.randrange(2)
        for _ in range(rng.randrange(1, 6)):
            base = [f"x{rng.randrange(4000)}" if rng.random() < rng.choice([0, 0.005, 0.01, 0.02, 0.03]) else w for w in base]
            rows.append((len(rows), " ".join(base)))
    return rows


def test_near_copies_equal_brute_force(spark, docs):
    rows = planted()
    got = simhash.simhash_groups(docs(rows), words=5, similarity=0.8).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == brute_groups(rows)


def test_large_buckets_are_tiled(spark, docs):
    """Copies that are near to one text but not to each other, in buckets of many tiles."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        at = rng.randrange(100)
        rows.append((i, " ".join(base[:at] + [f"x{i}", f"y{i}"] + base[at + 2 :])))
    rows += [(200 + i, " ".join(base[:60] + [f"z{j}" for j in range(60 + i)])) for i in range(6)]
    got = near_copies.near_copy_groups(docs(rows), tile=16).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == brute_groups(rows)


def test_near_copies_odd_rows(spark, docs):
    rows = [r for r in ODD if r[0] is not None]
    got = simhash.simhash_groups(docs(rows), words=5, similarity=0.8).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == brute_groups(rows)
    assert simhash.simhash_groups(docs(ODD), words=5, similarity=0.8).count() == len(ODD)
    assert simhash.simhash_groups(docs([]), words=5, similarity=0.8).count() == 0


def test_shingles_are_those_of_the_words():
    f = near_copies.Shingler()
    for text in (b"", b" \n", b"one", b"A b c D e", b"a b c d e f", b"x y " * 9000, "é ü ñ ß 日本語 \U0001f600 ".encode() * 3):
        w = text.lower().split()
        plain = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
        assert len(f(text)) == len(plain)
    assert set(f(b"a b c d e f").tolist()) & set(f(b"q a  b c d\te").tolist()) and len(f(b"ab c d e f")) == len(f(b"a bc d e f")) == 1
    assert set(f(b"ab c d e f").tolist()) != set(f(b"a bc d e f").tolist())


def test_fingerprint_and_pivots_lose_no_pair_of_the_similarity():
    rng = random.Random(8)
    f = near_copies.Shingler(1)
    for n in (5, 10, 45, 300):
        for _ in range(200):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = base[: n - n // 9] + [f"x{rng.randrange(10**6)}" for _ in range(n // 9)] if n > 9 else base[:-(n // 5)]
            a, b = (near_copies.wide_fingerprint(f(" ".join(t).encode())) for t in (base, other))
            assert near_copies._apart(a, b) <= near_copies.RADIUS


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pipeline_stage_reaches_the_similarity(spark, sf):
    import corpus_pipeline

    given = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in given.collect()]
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, given, "")
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, c in brute_groups(rows) if d == c]


def starred(size):
    """Candidate pairs of the first round in one bucket: a quarter of the rows near to each of four texts, all within the radius."""
    rng = np.random.default_rng(size)
    bits = np.zeros((size, 128), np.uint8)
    for i in range(size):
        bits[i, i % 4 * 16 : i % 4 * 16 + 16] = 1
        bits[i, 64 + rng.choice(64, 2, replace=False)] = 1
    wide = np.packbits(bits, axis=1).view(np.int64)
    one, ids = np.zeros(size, np.int64), np.arange(size)
    columns = {"k": one, "v": one, "a": one, "b": one, "chunk": one, "fp": ids, "n": one + 100, "left": wide[:, 0].copy(), "right": wide[:, 1].copy(), "root": ids}
    t = pa.table({c: columns[c] for c in near_copies.LIGHT})
    return [(r["src"], r["dst"]) for b in near_copies._star_pass(iter(t.to_batches())) for r in b.to_pylist()]


@pytest.mark.parametrize("size", [2, 3, 40, 400, 800])
def test_first_round_has_a_pair_for_each_row(size):
    pairs = starred(size)
    assert len(pairs) <= size + 6
    assert set(groups(size, pairs)) == {0}


def test_second_round_deals_large_buckets_by_the_rows_outside_the_largest_component(spark):
    """Each pair of two components meets in one tile; those of the largest do not, and a bucket of one component has no tile."""
    rows = [(0, 7, i, 1 if i < 60 else i) for i in range(64)] + [(1, 7, i, 1) for i in range(64)] + [(2, 7, i, i) for i in range(20)] + [(3, 7, i, i) for i in range(5)]
    size = {k: sum(r[0] == k for r in rows) for k in range(4)}
    given = [(k, v, fp, root, 10, 0, 0, 0, -(-size[k] // 8)) for k, v, fp, root in rows]
    rooted = spark.createDataFrame(given, "k int, v long, fp long, root long, n int, left long, right long, chunk int, chunks long")
    dealt = near_copies.across_roots(Workspace(spark, "test"), rooted, 8).collect()
    met = []
    for tile in {(r.k, r.a, r.b) for r in dealt}:
        held = [r for r in dealt if (r.k, r.a, r.b) == tile]
        met += [(r.k, r.fp, q.fp) for r in held for q in held if r.fp < q.fp and r.root != q.root and (r.a == r.b or r.chunk != q.chunk)]
    want = [(p[0], p[2], q[2]) for p in rows for q in rows if p[0] == q[0] and p[2] < q[2] and p[3] != q[3]]
    assert sorted(met) == sorted(want)
    of = [sum(r.k == k for r in dealt) for k in range(4)]
    assert of[0] == 4 * 9 + 60 and of[1] == 0 and of[3] == 5
