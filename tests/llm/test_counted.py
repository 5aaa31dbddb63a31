"""Prefix trie and its blocks, line index and filter audit, against brute force on odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import ODD

from veilframe.llm import filter_audit as fa
from veilframe.llm import line_dedup as ld
from veilframe.llm import prefix_trie as pt

CONV = "conv_id long, turn long, role string, text string, depth long, least string, id int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turn_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0, turn_key(role or "", text or "")), (role or "", text or "")))
    own = {c: [t for _, t in sorted(x, key=lambda x: x[0])] for c, x in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        convs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    kids = Counter(n[:-1] for n in nodes if n)
    leaves, saved = Counter(), Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1].encode()) if n else 0
    return Counter(
        (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n))))
        for n, m in nodes.items()
    )


def run_trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONV)
    out = pt.conversation_trie(pt.rebuild(pt.sequences(df)))
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return Counter(tuple(r[c] for c in names) for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    """Few different turns, so prefixes are shared across all blocks; conversations that are equal, prefixes of others, empty, odd."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), -7, -10, 10**12]:
        for t in range(rng.choice([0, 1, 1, 2, 3, 8, 12])):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["a", "a", "a", "é😀", None])))
    rows += [(3, 1, "user", "a"), (3, 1, "user", "a"), (4, None, "x", "y"), (None, 1, "a", "b")]
    rows += [(100 + k, t, "s", f"long {t}") for k in range(3) for t in range(300)]
    assert run_trie(spark, rows) == brute_trie(rows)


def test_trie_of_one_text_and_of_none(spark):
    same = [(c, t, "user", "hello") for c in range(0, 400, 5) for t in range(3)]  # multiples of five keep their own turns: one leaf
    got = run_trie(spark, same)
    assert got == brute_trie(same) and sum(got.values()) == 4
    assert not run_trie(spark, []) and not run_trie(spark, [(None, 1, "a", "b")])
    lone = [(5, 0, None, None)]
    assert run_trie(spark, lone) == brute_trie(lone)


def test_block_minima():
    rng = random.Random(3)
    for _ in range(200):
        z = [-1, *(rng.randrange(0, 6) for _ in range(20))]
        m = pt._Minima([(3 * k, v) for k, v in enumerate(z)])
        for k in range(1, len(z)):
            for d in range(7):
                assert m.owner(3 * k, d) == 3 * max(j for j in range(k) if z[j] < d)


# ---- lines ----
def brute_lines(texts, least):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\r\x0b\x0c"))
    split = [(t or "").split("\n") for t in texts]
    often = {k for k, n in Counter(k for x in split for k in {key(y) for y in x}).items() if k and n >= least}
    return [(len(x), sum(key(y) in often for y in x), "\n".join(y for y in x if key(y) not in often)) for x in split]


def line_texts(seed, n):
    rng = random.Random(seed)
    lines = [f"line {k}" for k in range(40)] + ["", "  ", "É", "\tLINE 1\r", "Line 2 ", "\x1cline 3"]
    return [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for i in range(n)] + ODD


def shown(df):
    return Counter((r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect())


@pytest.mark.parametrize("layout", [{}, {"shard_keys": 4}, {"shard_keys": 4, "max_broadcast": 0}])
def test_lines(spark, docs, layout):
    rows = line_texts(1, 80)
    frame = docs(rows).withColumn("kept_text", F.lit(1))
    out = ld.drop_repeated_lines(frame, 5, **layout)
    assert out.columns == [*docs([]).columns, "kept_text", "n_lines", "n_dropped"]
    assert shown(out) == Counter((*r[:2], *x) for r, x in zip(rows, brute_lines([r[1] for r in rows], 5), strict=True))
    assert ld.drop_repeated_lines(docs([]), 5, **layout).count() == 0


@pytest.mark.parametrize("layout", [{"shard_keys": 4}, {"shard_keys": 4, "max_broadcast": 0}])
def test_lines_come_and_go(spark, docs, layout):
    """After insertions and deletions the index gives what a fresh one over the documents that are left gives; dropped lines come back."""
    a, b, c = line_texts(1, 50), line_texts(2, 40), [(900 + i, f"late line {i % 9}\nline 1") for i in range(90)]
    index = ld.LineIndex(spark, 6, **layout).insert(docs(a)).build().insert(docs(b)).insert(docs(c)).delete(docs(b))
    rows = a + c
    want = Counter((*r[:2], *x) for r, x in zip(rows, brute_lines([r[1] for r in rows], 6), strict=True))
    assert shown(index.filter_lines(docs(rows))) == want
    assert shown(index.compact().filter_lines(docs(rows))) == want
    index.delete(docs(c))
    assert shown(index.filter_lines(docs(a))) == Counter((*r[:2], *x) for r, x in zip(a, brute_lines([r[1] for r in a], 6), strict=True))
    with pytest.raises(ValueError, match="does not hold"):
        index.delete(docs(c[:1]))
    assert shown(index.filter_lines(docs(a))) == Counter((*r[:2], *x) for r, x in zip(a, brute_lines([r[1] for r in a], 6), strict=True))


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    keys = rng.integers(-(2**63), 2**63 - 1, (20_000, 2))
    made = ld.CuckooFilter.of(keys[:, 0], keys[:, 1])
    assert made.has(keys[:, 0], keys[:, 1]).all() and (made.table != 0).sum() == len(keys)
    other = rng.integers(-(2**63), 2**63 - 1, (50_000, 2))
    assert made.has(other[:, 0], other[:, 1]).mean() < 0.001
    made.delete(keys[:10_000, 0], keys[:10_000, 1])
    assert made.has(keys[10_000:, 0], keys[10_000:, 1]).all() and made.has(keys[:10_000, 0], keys[:10_000, 1]).mean() < 0.001
    sharded = ld.Shards([(s, ld.CuckooFilter.of(*keys[(own := ld.shards_of(keys[:, 0], 8) == s)].T.copy()).table.tobytes(), b"") for s in range(8) if s != 3], 8)
    known = sharded.passes(keys[:, 0], keys[:, 1])
    assert known[ld.shards_of(keys[:, 0], 8) != 3].all() and not known[ld.shards_of(keys[:, 0], 8) == 3].any() and own.any()


def test_a_shard_knows_its_exceptions(spark):
    """Rare keys that share a frequent key's fingerprint and bucket are told apart by the counts."""
    index = ld.LineIndex(spark, 2)
    rows = [(7, 1, 5), (8, 1, 1), (9, 3, 1)]  # same low half: same fingerprint and bucket
    index.deltas = [spark.createDataFrame(rows, "hi long, lo long, n long")]
    index.build()
    shard = index.filters.first()
    lookup = ld.Shards([(shard.shard, bytes(shard.buckets), bytes(shard.exceptions))], index.shards)
    hi, lo = np.array([7, 8, 9]), np.array([1, 1, 3])
    assert lookup.passes(hi, lo)[:2].all() and lookup.frequent(hi, lo).tolist() == [True, False, False]


# ---- filters ----
def brute_audit(rows, labels):
    import re
    from itertools import permutations

    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall("[^ \t-\r]+", t)
        f = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)]
        docs.append((part or "", {x for x, y in zip("ABCDE", f, strict=True) if y}, i in good, i in toxic))
    out = []
    for part in {p for p, *_ in docs}:
        own, share, lines = [d for d in docs if d[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                share[x] += len(gone)
                lines.append((part, order, k + 1, len(left), len(gone), sum(x in d[1] for d in own) - len(gone), sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*r, share[r[1][r[2] - 1]]) for r in lines]
    return Counter(out)


def test_audit(spark, docs):
    rng = random.Random(4)
    body = lambda n: " ".join(rng.choice(["a", "b", "Word", "c\x0bd", "é", "#x", *(f"w{k}" for k in range(300))]) for _ in range(n))
    texts = [body(rng.choice([3, 50, 190, 200, 260])) for _ in range(30)] + ["A" * 40, "x " * 300, ""]
    rows = [(i, rng.choice(texts), rng.choice(["p", "q", "", None])) for i in range(150)]
    rows += [(i, t, "odd") for i, t, *_ in ODD] + [(200 + k, texts[0], f"only{k}") for k in range(70)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (10**9, 1, 1)]
    frame = spark.createDataFrame([(i, t, s, 1, "z", 3) for i, t, s in rows], "doc_id long, text string, source string, mask int, part string, label int").repartition(5)
    told = spark.createDataFrame([(*x, "e") for x in labels], "doc_id long, quality int, toxic int, part string")
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    got = Counter(tuple(r[c] for c in names) for r in fa.audit(frame, told).collect())
    assert got == brute_audit(rows, labels)
    assert fa.audit(frame.limit(0), told).count() == 0 and fa.audit(frame.limit(3), told.limit(0)).count() > 0


def test_first_failures():
    for mask in range(32):
        for k, order in enumerate(fa.ORDERS):
            want = next((s for s, x in enumerate(order) if mask >> "ABCDE".index(x) & 1), 5)
            assert fa.TABLE[mask, k] == want
