"""Near duplicates and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from tests.llm.conftest import ODD

from veilframe.llm.common import Forest, Workspace
from veilframe.llm.components import connected_components
from veilframe.llm.embed_dedup import choose_pivots, embedding_links, reach, unit
from veilframe.llm.simhash import fingerprint, near_links, simhash_groups


def groups(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_equals_the_definition():
    for text in [t for _, t in ODD] + ["A b C d E f", "a  b\x0bc\x0cd e", "Ä ö Ü"]:
        assert fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_forest_keeps_the_smallest():
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    f = Forest(200)
    for k in range(0, 150, 10):
        a, b = np.array(links[k : k + 10]).T
        f.link(a, b)
    assert f.label.tolist() == groups(200, links)


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(5)
    links = {"path": [(i, i + 1) for i in range(300)], "star": [(299, i) for i in range(299)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "empty": []}[shape]
    got = connected_components(Workspace(spark), spark.createDataFrame([*links, *links[:3], *[(x, x) for x in range(3)]] + [(None, 1)], "src long, dst long")).collect()
    want = groups(301, links)
    assert {r.node: r.root for r in got} == {i: want[i] for i in range(301) if any(i in x and x[0] != x[1] for x in links)}


@pytest.mark.parametrize("tile", [8192, 7])
def test_near_links_lose_none(spark, tile):
    """A ball of near copies, chains and random fingerprints; with small tiles the large buckets are split."""
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    for _ in range(120):
        x = centre
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            x ^= 1 << b
        fps.add(x)
    x = rng.getrandbits(64)
    for _ in range(30):
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    f = np.array(fps, np.uint64)
    signed = f.view(np.int64).tolist()
    links = near_links(Workspace(spark), spark.createDataFrame([(v,) for v in signed], "fp long"), tile=tile).collect()
    place = {v: i for i, v in enumerate(signed)}
    pairs = [(place[r.src], place[r.dst]) for r in links]
    every = [(i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 4) if i < j]
    assert groups(len(f), pairs) == groups(len(f), every)
    assert len(pairs) < 15 * len(f)  # forests, not all pairs


def test_simhash_groups_on_odd_rows(spark, docs):
    rows = simhash_groups(docs(ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by[1] == by[2] == by[3] == 1 and by[6] == by[7] == 6 and by[4] == 4
    assert simhash_groups(docs([])).count() == 0


def test_registered_simhash_query(spark, sf):
    from veilframe.llm.queries import op4_simhash_near_dedup

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = np.array([plain_fingerprint(t) for _, t in docs], np.uint64)
    root = groups(len(docs), [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4) if i < j])
    want = {d: (f"{int(fps[i]):016x}", docs[root[i]][0]) for i, (d, _) in enumerate(docs)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash_near_dedup(spark, sf).collect()} == want


def test_registered_embedding_query(spark, sf):
    from veilframe.llm.queries import op5_embedding_near_dedup

    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    links = brute_links(rows)
    root = groups(len(rows), links)
    want = {r[0]: (sum(i in x for x in links), rows[root[i]][0], root[i] == i) for i, r in enumerate(rows)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op5_embedding_near_dedup(spark, sf).collect()} == want


def brute_links(rows):
    ok = {}
    for i, (_, label, e) in enumerate(rows):
        if label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e):
            ok[i] = np.array(e, float)
    links = []
    for i in ok:
        for j in ok:
            if i < j and rows[i][1] == rows[j][1] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.98:
                links.append((i, j))
    return links


@pytest.mark.parametrize("cell", [4096, 24])
def test_embedding_links(spark, cell):
    """Clusters of every tightness; small cells bring pivots, replication and tiles into play."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(260):
        centre = rng.normal(size=8) if k % 13 == 0 or not rows else np.array(rows[rng.integers(len(rows))][2])
        rows.append((k, int(rng.integers(2)), (centre + rng.normal(size=8) * rng.choice([0, 0.02, 0.08, 0.2])).tolist()))
    rows = [(i, lab, [float(np.float32(x)) for x in e]) for i, lab, e in rows]
    rows += [(300, None, rows[0][2]), (301, 1, None), (302, 1, [0.0] * 8), (303, 1, [float("nan")] * 8), (304, 1, [float("inf")] * 8), (305, 0, [1.0, 2.0]), (306, 0, [1.0, 2.0]), (307, 0, []), (308, 1, [None] * 8)]
    links = brute_links(rows)
    want = groups(len(rows), links)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), cell=cell, max_copies=8.0).collect()}
    assert got == {rows[i][0]: (sum(i in x for x in links), rows[want[i]][0]) for i in range(len(rows))}


def test_embedding_odd_rows(spark):
    schema = "vec_id long, label int, embedding array<double>, rid int, cell string"
    rows = [(None, 1, [1.0, 0.0], 1, "a"), (5, 1, [1.0, 0.0], 1, "a"), (5, 1, [1.0, 0.0], 1, "a"), (6, 1, [1.0, 0.01], 1, "a")]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_links(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(5, 3, 5), (5, 3, 5), (6, 3, 5), (None, 3, None)]
    assert embedding_links(spark.createDataFrame([], schema)).count() == 0


def test_replication_bound_holds():
    rng = np.random.default_rng(2)
    x = unit(np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(5, 6)).repeat(60, 0) + rng.normal(size=(300, 6)) * 0.05]))
    pivots = choose_pivots(x, 10_000, 0.2, 500, 20.0)
    home, present = reach(x, pivots, 0.2)
    near = x @ x.T >= 0.98
    for i in range(len(x)):
        assert present[near[i], home[i]].all()
