"""The registered quality query against a plain version: its own statistics, the rows learned from, and each score by a walk from node to node."""

import math
import re
import statistics as st
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import ODD

from veilframe.llm import quality, queries


def plain_statistics(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\r\x0b\x0c]+", text) if w]
    n, m = max(1, len(text)), max(1, len(words))
    size = [len(w.encode()) for w in words]
    kinds = [lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in " \t\r\n", lambda c: c in ".,;:", lambda c: c in "#%&$*@^~=+<>", lambda c: c in "|_/\\{}[]", lambda c: c in "!?"]
    often = sorted(Counter(words).values(), reverse=True)
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    k = max(1, len(lines))
    distinct = set(words)
    upper = [w for w in distinct if re.search("[A-Z]", w) and not re.search("[a-z]", w)]
    return [
        math.log1p(n), math.log1p(len(words)), st.fmean(size) if size else 0, st.pstdev(size) if size else 0, *(sum(map(f, text)) / n for f in kinds),
        len(distinct) / m, often[0] / m if often else 0, sum(often[:10]) / m, len(set(zip(words, words[1:]))) / m, sum(a == b for a, b in zip(words, words[1:])) / m, sum(w[-1] in "#%&$*@!|" for w in words) / m,
        len(set(lines)) / k, math.log1p(len(lines)), len(words) / k, sum(x.rstrip(" \t\r\x0b\x0c")[-1] in ".!?" for x in lines) / k, len(upper) / max(1, len(distinct)), sum(re.fullmatch("[0-9]+", w) is not None for w in distinct) / max(1, len(distinct)),
        len(words) / max(1, sum(text.count(c) for c in ".!?")), sum(0x80 <= b < 0xC0 for b in text.encode()) / n, text.count("http") / m, max(size, default=0),
    ]


def test_statistics_of_odd_texts():
    for _, text, *_ in [*ODD, (1, "A b.\n\n a b A b!? http://x 12 É\x0bZZ\n  \nA b.")]:
        assert quality.statistics(None if text is None else text.encode()) == pytest.approx(plain_statistics(text))


def test_quality_query(spark, monkeypatch):
    sf, learned = "/root/testdata/sf0.01", []

    def keep(x, y, **kw):
        trees = fit(x, y, **kw)
        learned.append((x, y, trees))
        return trees

    fit = quality.fit_trees
    monkeypatch.setattr(quality, "fit_trees", keep)
    got = {r.doc_id: r for r in queries.op3_quality_trees(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    ((x, y, trees),) = learned
    rows = sorted([*map(float, plain_statistics(docs[i])), float(q)] for i, q in labels.items() if i in docs and not held(i))
    assert np.allclose(sorted([*a, b] for a, b in zip(x.tolist(), y.tolist(), strict=True)), rows)

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            k = 0
            for _ in range(trees.depth):
                k = 2 * k + (2 if row[f[k]] > t[k] else 1)
            total += v[k]
        return 1 / (1 + math.exp(-total))

    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r.held_out == held(i) and r.score == pytest.approx(walk(quality.statistics(None if docs[i] is None else docs[i].encode()))) and r.predicted == int(r.score >= 0.3)
    judged = [(got[i].score, q) for i, q in labels.items() if held(i)]
    wins = [(a > b) + (a == b) / 2 for a, p in judged for b, q in judged if p == 1 and q == 0]
    assert sum(wins) / len(wins) > 0.8
