"""Decontamination, personal data, languages, quality and licences."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import ODD

from veilframe.llm import decontaminate as dc
from veilframe.llm import licenses, pii, queries
from veilframe.llm.langid import UNKNOWN, keep_languages, learn_profiles, ngram_codes, predict_documents
from veilframe.llm.quality import STATISTICS, fit_trees, quality_scores, statistics


def brute_contamination(docs, items, n=13):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            iw = words(it)
            size = min(n, len(iw))
            wins = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if size else set()
            for i in range(len(w) - size + 1 if size else 0):
                if tuple(w[i : i + size]) in wins:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


def brute_cut(row, items, n=13):
    """The row without its hit words: each run of them goes with what lies between its words."""
    if row[1] is None:
        return row
    at = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", row[1])]
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), row[1][s:e]) for s, e in at]
    hit = set()
    for item, text in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if item is not None else []
        size = min(n, len(w))
        for i in range(len(words) - size + 1 if size else 0):
            if any(words[i : i + size] == w[k : k + size] for k in range(len(w) - size + 1)):
                hit |= set(range(i, i + size))
    gone = set()
    for k in hit:
        gone |= set(range(at[k][0], at[k + 1][0] if k + 1 in hit else at[k][1]))
    return row[0], "".join(c for i, c in enumerate(row[1]) if i not in gone)


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_contamination(spark, docs, block):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ß"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(0, 30))) for i in range(12)] + [(12, None), (3, text(5)), (None, "w1 w2")]
    rows = [(i, text(rng.randrange(0, 60)) + " " + (rng.choice(items)[1] or "").upper() + "! " + text(9)) for i in range(60)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.measure(dc.find_contamination(docs(rows), bench, block_words=block)).orderBy("rid").collect()
    want = brute_contamination(rows, [x for x in items if x[0] is not None])
    assert [(r.n_words, r.n_hit, list(dict.fromkeys(r["items"]))) for r in got] == want
    kept = dc.decontaminate(docs(rows), bench, block_words=block)
    clean = [r for r, (n, h, _) in zip(rows, want, strict=True) if not (h and 20 * h >= n)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(clean, key=str)
    cut = dc.decontaminate(docs(rows), bench, "remove", block_words=block)
    assert cut.columns == docs([]).columns
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted((brute_cut(r, items) for r in rows), key=str)


def test_blocks_of_windows_stay_small():
    """A block of a million words must fit a worker many times over; here a tenth of one, of words that hardly repeat."""
    import pickle
    import tracemalloc

    rng = random.Random(3)
    items = [(str(i), " ".join(f"w{rng.randrange(60_000)}" for _ in range(1000)).encode()) for i in range(100)]
    tracemalloc.start()
    windows = dc.WindowSet(items)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20e6 and len(pickle.dumps(windows)) < 5e6
    hit, found = windows.scan(dc.words_of(items[7][1])[100:200] + [b"zzz"])
    assert hit.tolist() == [True] * 100 + [False] and found == ["7"]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(dc, "BASE", np.uint64(1))  # all orders of the same words collide
    windows = dc.WindowSet([("a", b"x y z"), ("b", b"z y x")], 3)
    assert windows.scan([b"x", b"y", b"z"])[1] == ["a"] and windows.scan([b"z", b"y", b"x"])[1] == ["b"] and windows.scan([b"y", b"x", b"z"])[1] == []


def test_contamination_without_rows(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_contamination(docs([]), bench).count() == 0
    assert dc.decontaminate(docs(ODD), bench).count() == len(ODD)


def brute_spans(text):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d))) or (kind == "phone" and not 8 <= len(d) <= 15):
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1.@-+ ()9 2@5.%_xé０а​", max_size=60))
def test_base_spans_equal_the_patterns(text):
    base, added = pii.find(text)
    assert base == brute_spans(text)
    assert all(0 <= s < e <= len(text) for _, s, e in added)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("joe at example dot com", "email", "joe at example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("card ４１１１ １１１１ １１１１ １１１１ ok", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("call plus four nine one seven one two three four five six", "phone", "plus four nine one seven one two three four five six"),
        ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("a​b@c.de x", "email", None),
    ],
)
def test_disguises(text, kind, part):
    base, added = pii.find(text)
    if part:
        assert [(k, text[s:e]) for k, s, e in added] == [(kind, part)]
    assert pii.redact(text, base + added).count(f"[{kind.upper()}]") == 1


@pytest.mark.parametrize("text", ["meet at example.com", "the dot at noon", "one two", "look at a. dot b"])
def test_prose_stays(text):
    assert pii.find(text) == ([], [])


def test_personal_data_rows(spark, docs):
    rows = [*ODD, (20, "mail a@b.co and 1.2.3.4 or 4111 1111 1111 1111 or +1 (555) 123-4567"), (21, "4111 1111 1111 1112 256.1.1.1 +1 2")]
    got = pii.scan_personal_data(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[20].n_email, by[20].n_ip, by[20].n_card, by[20].n_phone) == (1, 1, 1, 1)
    assert by[20].base_sha256 == hashlib.sha256(pii.joined(brute_spans(rows[-2][1])).encode()).hexdigest()
    assert by[21].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact_documents(docs(rows)).collect()}
    assert clean[20] == "mail [EMAIL] and [IP] or [CARD] or [PHONE]" and clean[1] is None


def test_language_accuracy_and_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op9_language_profiles(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, docs):
    rows = [*((i, t, "en") for i, t in ODD), *((100 + i, f"der hund und die katze nummer {i}", "de") for i in range(8))]
    got = predict_documents(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == UNKNOWN and by[1].score == 0
    assert by[100].lang_pred == "de"
    assert {r.doc_id for r in keep_languages(docs(rows), 0.2).collect()} >= {100, 101}
    assert predict_documents(docs([])).count() == 0
    assert learn_profiles(docs([(1, "x", None)])).languages == []
    assert ngram_codes("ab").tolist() and not len(ngram_codes("12 !"))


def test_quality_accuracy_and_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op3_quality_trees(spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(4, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs(ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_scores(docs(ODD), none).collect()} == {0.5}
    assert quality_scores(docs([]), labels).count() == 0
    assert all(len(statistics(t and t.encode())) == STATISTICS for _, t in ODD)


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < 0)).astype(float)
    t = fit_trees(x[:2000], y[:2000])
    assert np.mean((t.score(x[2000:]) > 0.5) == y[2000:]) > 0.97


def test_licences_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(licenses.duckdb_sql()).fetchall())
    got = queries.op7_license_scan(spark, sf).select("doc_id", "n_scored", "n_confirmed", "families", "unconfirmed").collect()
    assert sorted(map(tuple, got)) == want


PLAIN_NOTICES = {
    "MIT": ["Released under the MIT License.", "This repository is licensed under the MIT license.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "The code is licensed under the Apache License, Version 2.0, and so are its tests"],
    "GPL-2.0": ["Licensed under the GNU General Public License v2.0."],
    "GPL-3.0": ["Our work is licensed under the GNU General Public License, version 3.", "Licensed under the GPLv3."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License."],
    "AGPL-3.0": ["The server is licensed under the GNU Affero General Public License, version 3."],
    "CC-BY": ["Licensed under CC BY 4.0."],
    "CC-BY-SA": ["All pages are licensed under CC BY-SA 4.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0."],
    "BSD": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
}
NO_FAMILY = [
    "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Artistic License 2.0", "Licensed under the Artistic License 2.0.", "Licensed under the EUPL, Version 1.2 or later", "Licensed under the WTFPL.",
    "Licensed under the Frobnicate License, version 3.", "Licensed under the Mulan Permissive Software License, Version 2.", "This text is licensed under the Design Science License.", "He has held a driving license since 2004; copyright is not his field.",
    "Permission to enter is hereby granted to any person with a ticket.", "The license of the MIT lab was renewed.", "No warranty is given for the Apache helicopter, version 2.0.",
]


def test_licences_of_labelled_notices(spark, docs):
    """Notices of the families and, without a family, of other licences and of none; half of them are stated nowhere in the module."""
    labelled = [(c, t) for c, texts in PLAIN_NOTICES.items() for t in texts] + [("", t) for t in NO_FAMILY]
    rows = [(i, f"Some prose first.\n\n{t}\n\nMore prose.") for i, (_, t) in enumerate(labelled)]
    got = {r.doc_id: r.families for r in licenses.scan_licences(docs(rows)).collect()}
    assert [got[i] for i in range(len(rows))] == [c for c, _ in labelled]
    assert licenses.model().held_out_accuracy > 0.65  # of notices and grants left out whole, 18 classes


def test_licences_odd_rows(spark, docs):
    rows = [*ODD, (30, "x\nReleased under the MIT License.\ny"), (30, "Licensed under CC BY-NC 4.0."), (31, "the license plate of the car"), (32, "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.")]
    got = licenses.scan_licences(docs(rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r.families for r in got if r.families) == ["Apache-2.0,GPL-3.0", "CC-BY-NC", "MIT"]
    assert licenses.scan_licences(docs([])).count() == 0
    plan = licenses.scan_licences(docs(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan and "Join" not in plan


def test_scan_matches_registered_query(spark, sf):
    rows = queries.op1_decontaminate(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {d[0]: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), bool(h) and 20 * h >= n) for d, (n, h, i) in zip(docs, brute_contamination(docs, items), strict=True)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want


def test_registered_personal_data_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_personal_data(spark, sf).collect():
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in pii.KINDS)
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(","))
