"""Every registered query with SQL equals it, on the smallest tables."""

import ast
import glob
import os
from collections import Counter

import duckdb
import pytest

from veilframe.operators import spans
from veilframe.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.execute(SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == Counter(tuple(map(plain, r)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_other_queries_run(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if name == "pseudonymise":
        assert all(r.restores for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("path", sorted(glob.glob(f"{os.path.dirname(registry.__file__)}/*.py")), ids=os.path.basename)
def test_module_names_are_bound_once(path):
    """Queries read the texts of their module when they run, so a later text of the same name would replace theirs."""
    with open(path) as f:
        body = ast.parse(f.read()).body
    names = [t.id for node in body if isinstance(node, ast.Assign) for t in node.targets if isinstance(t, ast.Name)]
    names += [node.name for node in body if isinstance(node, ast.FunctionDef)]
    assert [n for n, count in Counter(names).items() if count > 1] == []


def test_types_are_reconciled_within_a_case(spark):
    """One other type is adopted; two, none, fragments alone or another case leave an identifier; null keys stay."""
    rows = [
        (1, 1, "A", "identifier"), (2, 1, "A", "table"), (3, 1, "A", "table"), (4, 1, "B", "identifier"), (5, 1, "B", "table"), (6, 1, "B", "view"),
        (7, 1, "C", "identifier"), (8, 1, "C", "fragment"), (9, 2, "A", "identifier"), (10, 1, None, "identifier"), (11, 1, None, "table"),
    ]
    got = spans.reconcile_types(spark.createDataFrame(rows, "span_id int, case_id int, canonical string, entity_type string")).collect()
    want = {1: "table", 2: "table", 3: "table", 4: "identifier", 5: "table", 6: "view", 7: "identifier", 8: "fragment", 9: "identifier", 10: "identifier", 11: "table"}
    assert sorted((r.span_id, r.entity_type) for r in got) == sorted(want.items())
