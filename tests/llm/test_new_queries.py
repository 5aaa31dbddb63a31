"""The queries of line dedup, prefix trie and filter audit against their SQL."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from veilframe.llm import oracles, queries


@pytest.mark.parametrize("name", ["op11_line_refcounts", "op12_prefix_trie", "op13_filter_audit"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    rel = con.execute(oracles.SQL[name])
    columns = [d[0] for d in rel.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    want = Counter(rel.fetchall())
    assert want and Counter(tuple(r[c] for c in columns) for r in df.collect()) == want
