"""Names of any form in questions and masked texts, and an engine that fails closed."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilframe.operators import engine, names, rewrite

SYMBOLS = "case_id long, entity_type string, canonical string, preferred_original string, sequence int, confidence double, marker string"


def symbol(case, kind, name, n):
    return (case, kind, f"Q:{name}", name, n, 1.0, f"OBF_P{case}_{kind[:3].upper()}_{n:04d}_00")


def brute_hits(text, entries):
    """(start, end, marker) of every whole occurrence of every name."""
    out = set()
    for name, marker in entries:
        for m in re.finditer(rf"(?<![A-Za-z0-9_$#])(?=((?i:{re.escape(name)})))", text):
            end = m.start() + len(m[1])
            if end == len(text) or not re.match("[A-Za-z0-9_$#]", text[end]):
                out.add((m.start(), end, marker))
    return out


@pytest.mark.parametrize("limit", [names.MAX_BROADCAST, 0])
def test_hits_equal_brute_force(spark, limit):
    rng = random.Random(7)
    bits = ["ab", "x-y", "Order ID", "é é", "..", "ID", "Order", "$v", "ab cd", "ab cd ef", "İx!", '"q w"', "(+)", "ORDER id"]
    entries = {c: [symbol(c, rng.choice(["table", "column", "index"]), n, k) for k, n in enumerate([*bits, *(f"{a} {b}" for a in bits[:5] for b in bits[:5])])] for c in (1, 2)}
    texts = [(i, rng.choice([1, 2, 3, None]), "".join(rng.choice([*bits, " ", ",", "x", "OBF_P1_TAB_0000_00"]) for _ in range(rng.randrange(12)))) for i in range(300)] + [(900, 1, None), (901, 1, "")]
    frame = spark.createDataFrame([*texts, texts[3]], "id int, case_id long, text string")
    symbols = spark.createDataFrame([x for v in entries.values() for x in [*v, v[0]]] + [(None, "table", "Q:zzz", "zzz", 1, 1.0, "m"), (1, "bind", "Q:hid", "hidden", 9, 1.0, "m"), (1, "table", "Q:n", None, 10, 1.0, "m")], SYMBOLS)
    got = names.with_hits(frame, symbols, max_broadcast=limit).collect()
    known = {c: [(r.name, r.marker) for r in names.names_of(symbols).where(F.col("case_id") == c).collect()] for c in (1, 2)}
    assert len(got) == len(texts) + 1 and ("q w", entries[1][bits.index('"q w"')][-1]) in known[1]
    for r in got:
        assert {(h.start, h.end, h.marker) for h in r.hits} == brute_hits(r.text or "", known.get(r.case_id, ())), r


def test_masking_prefers_longer_names(spark):
    rows = [symbol(1, "table", "Order", 1), symbol(1, "column", "Order ID", 2), symbol(1, "view", "Order ID Log", 3), symbol(1, "index", "x-y", 4), symbol(1, "table", "ORDERS", 5)]
    symbols = spark.createDataFrame(rows, SYMBOLS)
    asked = spark.createDataFrame([(1, 1, "why is order id slow in ORDERS and X-Y? ORDER ID LOG, order; x-yz"), (1, 1, "twice"), (1, 1, "twice"), (None, None, "Order ID")], "question_id int, case_id long, text string")
    got = Counter(r.masked for r in rewrite.mask_questions(asked, symbols).collect())
    m = [r[-1] for r in rows]
    assert got == Counter({f"why is {m[1]} slow in {m[4]} and {m[3]}? {m[2]}, {m[0]}; x-yz": 1, "twice": 2, "Order ID": 1})
    leaks = rewrite.leak_findings(asked, symbols, "question_id", text="text")
    assert {(r.word, r.start) for r in leaks.collect()} == {("ORDER ID", 7), ("ORDERS", 24), ("X-Y", 35), ("ORDER ID LOG", 40), ("ORDER", 7)}


def test_many_names_in_many_questions(spark):
    """4,000 names of two words in 5,000 questions: none is left, by either way."""
    symbols = spark.createDataFrame([symbol(1, "column", f"Bay {i} North", i) for i in range(4000)], SYMBOLS)
    asked = spark.range(5000).select(F.lit(1).cast("long").alias("case_id"), F.concat(F.lit("is bay "), F.col("id") % 4000, F.lit(" north or BAY "), (F.col("id") * 7) % 4000, F.lit(" NORTH full?")).alias("text"))
    for limit in (names.MAX_BROADCAST, 0):
        masked = rewrite.mask_questions(asked, symbols, max_broadcast=limit)
        assert masked.where(~F.lower("masked").contains("north")).count() == 5000


CASES = [(1, "AAAA"), (1, "AAAA"), (2, "BBBB"), (4, "DDDD"), (4, "EEEE"), (5, None), (None, "FFFF"), (6, "no good")]


@pytest.fixture(params=[engine.MAX_MAPPING, 0])
def odd(spark, request):
    secret = "select secret_col from hr.secret_table where k = 'deep'"
    rows = [(c, 10, 0, secret) for c in (1, 2, 3, 4, 5, 6, None)] + [(1, 10, 0, secret), (1, 10, 1, "select other_col from hr.secret_table"), (1, None, 2, secret), (2, 11, 0, None), (3, 12, 0, ""), (3, 13, 0, None)]
    artifacts = spark.createDataFrame(rows, "case_id long, artifact_id long, position int, text string")
    return rows, engine.pseudonymise(artifacts, spark.createDataFrame(CASES, "case_id long, prefix string"), max_mapping=request.param)


def test_nothing_readable_goes_out(odd):
    rows, out = odd
    back = rewrite.exact_restore(out.masked).collect()
    assert Counter((r.case_id, r.artifact_id, r.position, r.text) for r in back) == Counter(rows)
    for r in back:
        assert r.restored == r.text and not re.search("secret|deep|other_col", r.masked or "")
        assert ((r.masked or "") == engine.WITHHELD) == bool(r.text and r.case_id not in (1, 2))
    codes = {(r.case_id, r.code) for r in out.findings.collect()}
    assert {(c, "case_unknown") for c in (3, 4, 5, 6, None)} <= codes and not {c for c, code in codes if code == "case_unknown"} & {1, 2}


def test_a_span_without_marker_withholds(spark):
    rows = spark.createDataFrame([(1, 1, 0, "select a from b")], "case_id long, artifact_id long, position int, text string")
    from veilframe.operators.detection import with_parsed

    parsed = with_parsed(rows.withColumn("row_id", F.lit(0).cast("long"))).withColumn("_sure", F.lit(True))
    nothing = spark.createDataFrame([(1, "column", "U:A", "column", "OBF_X_COL_0001_00")], "case_id long, entity_type string, canonical string, final_type string, marker string")
    for small in (True, False):
        r = engine._rewritten(parsed, nothing, small).first()._done
        assert r.masked == engine.WITHHELD and r.problem == "marker_missing" and r.replacements[0].original == "select a from b"


def test_registry_of_repeated_rows_and_kept_parses(spark):
    art = spark.createDataFrame([(1, 1, 0, "select a from b"), (1, 2, 1, "select c from b")], "case_id long, artifact_id long, position int, text string")
    cases = spark.createDataFrame([(1, "AAAA")], "case_id long, prefix string")
    first = engine.pseudonymise(art, cases)
    table = engine.parse_table(art)
    more = spark.createDataFrame([(1, 3, 2, "select a, d from b")], art.schema)
    grown = table.union(engine.parse_table(art.union(more), table))
    assert table.count() == 2 and grown.count() == 3
    again = engine.pseudonymise(art.union(more), cases, first.symbols.union(first.symbols), parses=grown)
    assert {(r.canonical, r.sequence) for r in again.symbols.collect()} == {("U:A", 1), ("U:B", 2), ("U:C", 3), ("U:D", 4)}
    assert all(r.restored == r.text for r in rewrite.exact_restore(again.masked).collect())


def test_rewriting_by_several_keys(spark):
    art = spark.createDataFrame([(1, 7, "ab"), (2, 7, "ab"), (2, 7, "ab"), (None, None, "ab")], "case_id int, artifact_id int, text string")
    spans = spark.createDataFrame([(1, 7, 0, 1, "X"), (2, 7, 1, 2, "Y"), (2, 7, 1, 2, "Y"), (None, None, 0, 2, "Z")], "case_id int, artifact_id int, start int, end int, marker string")
    got = Counter((r.case_id, r.masked) for r in rewrite.apply_replacements(art, spans, ["case_id", "artifact_id"]).collect())
    assert got == Counter({(1, "Xb"): 1, (2, "aY"): 2, (None, "Z"): 1})


def test_answers_of_repeated_ids(spark):
    symbols = spark.createDataFrame([symbol(1, "table", "lanes", 1), symbol(1, "table", "lanes", 1)], SYMBOLS)
    marker = symbol(1, "table", "lanes", 1)[-1]
    rows = spark.createDataFrame([(5, 1, f"see {marker} and {marker.lower()}, OBF_P1_X_1"), (5, 1, "none"), (None, None, marker), (6, 9, marker)], "answer_id int, case_id long, text string")
    got = {(r.answer_id, r.restored, r.n_restored, tuple(r.unknown)) for r in rewrite.restore_answers(rows, symbols).collect()}
    assert got == {(5, "see lanes and lanes, OBF_P1_X_1", 2, ("OBF_P1_X_1",)), (5, "none", 0, ()), (None, marker, 0, ()), (6, marker, 0, ())}
