"""Statements matched by one sort against a comparison of all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.operators import statements as st
from veilframe.operators.sql_text import normal_tokens


def signature(text):
    toks = normal_tokens((text or "").replace("\x1f", " "))
    kind = lambda t: next((n for n, p in st._TYPES if re.match(p, t)), "P")
    return [f"{kind(t)}:{t}" for t in toks], "".join(re.sub(r"\s", "", t) if t.startswith("/*+") else t for t in toks)


def expected(text, known):
    """(case, how) by the rule itself, token by token."""
    x, raw = signature(text)
    if not x:
        return None, None
    for mine, fits, theirs in (
        (x, lambda k: len(k) >= 12, [(c, signature(t)[0]) for c, t in known]),
        ([raw], lambda k: len(k[0]) >= 80, [(c, [signature(t)[1]]) for c, t in known]),
    ):
        theirs = [(c, k) for c, k in theirs if k and k != [""]]
        begins = lambda a, b: fits(a) and len(a) <= len(b) and a[:-1] == b[: len(a) - 1] and b[len(a) - 1].startswith(a[-1])
        joined = lambda k: "\x1f".join(k)
        equal = [c for c, k in theirs if k == mine]
        if equal and (mine is x or fits(mine)):
            return min(equal), "same"
        under = [(len(joined(k)), c) for c, k in theirs if k != mine and begins(k, mine)]
        if under:
            longest = max(n for n, _ in under)
            return min(c for n, c in under if n == longest), "continues"
        into = [(joined(k), c) for c, k in theirs if k != mine and begins(mine, k)]
        if into:
            return min(into)[1], "cut_off"
    return None, None


WORDS = ["a", "b", "col", "'it''s x'", '"Q n"', ":b1", "12", "123", "=", "and", "(", ")", ",", "/*+ FULL(t)  X */", "é"]


def texts(rng, n, stems):
    """Statements over a few long beginnings, cut and carried on anywhere, in other spaces, cases and comments."""
    words = WORDS
    out = []
    for _ in range(n):
        s = "select " + rng.choice(stems)
        act = rng.randrange(5)
        if act == 0:
            s = s[: rng.randint(1, len(s))]
        elif act == 1:
            s += " " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        elif act == 2:
            s = s.replace(" ", "\n  ") + " -- end"
        elif act == 3:
            s = s[: rng.randint(30, 200)].upper().replace("IT''S X", "it''s x") + ";"
        out.append(s)
    return out


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 3), (3, 40), (4, 200)])
def test_matches_equal_all_pairs(spark, seed, parts):
    """With few and many ranges, so that chains of prefixes cross their edges."""
    rng = random.Random(seed)
    stems = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60))) for _ in range(4)]
    known = [(k, t) for k, t in enumerate(texts(rng, 30, stems))]
    shown = [(k, t) for k, t in enumerate(texts(rng, 300, stems))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = st.match_statements(spark.createDataFrame(shown, "k int, text string"), spark.createDataFrame(known, "case_id int, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {k: expected(t, known) for k, t in shown}
    assert {r.k: (r.matched_case, r.match) for r in got} == want
    assert {h for _, h in want.values()} == {None, "same", "continues", "cut_off"}


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows, clashing columns, unknown cases, empty tables."""
    long = "select " + ", ".join(f"c{i}" for i in range(40)) + " from t"
    shown = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, long + " where a = 1", "x"), (2, long + " where a = 1", "x"), (3, long[:100], "x"), (4, "-- only words", "x")], "case_id int, text string, match string")
    known = spark.createDataFrame([(9, long), (7, long.upper()), (None, long + " where a = 1"), (5, None), (6, " ")], "case_id int, text string")
    got = sorted((r.case_id, r.matched_case, r.match) for r in st.match_statements(shown, known).where("matched_case IS NOT NULL").collect())
    assert got == [(2, 7, "continues"), (2, 7, "continues"), (3, 7, "cut_off")]
    assert st.match_statements(shown, known).count() == 6
    assert st.match_statements(shown, known.where("case_id < 0")).where("match IS NOT NULL").count() == 0
    assert st.match_statements(shown.where("case_id < 0"), known).count() == 0


def test_one_beginning_for_all_spreads(spark):
    """Every statement shares a long beginning: ranges stay even and every nested prefix is found."""
    stem = "select " + " , ".join(f"c{i}" for i in range(20))
    known = spark.range(0, 2000).select(F.col("id").alias("case_id"), F.concat(F.lit(stem + " , d"), F.lpad("id", 6, "0"), F.lit(" from t")).alias("text"))
    shown = spark.range(0, 2000).select("id", F.concat(F.lit(stem + " , d"), F.lpad("id", 6, "0"), F.lit(" from t where x = 1")).alias("text"))
    got = st.match_statements(shown, known)
    assert got.where("matched_case = id AND match = 'continues'").count() == 2000
