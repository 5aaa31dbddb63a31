"""The DataFrame path: registry, rewriting, restore, store, answers, sources, streaming."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tests.core import fixtures as fx

from veilframe.operators import answers, engine, rewrite, symbols, workflow
from veilframe.operators.detection import kind_column, kind_of
from veilframe.operators.store import Store
from veilframe.sources import text as sources


@pytest.fixture(scope="module")
def artifacts(spark):
    rows = [(c, c * 10 + i, i, t) for c in (1, 2) for i, t in enumerate(fx.ALL.values())] + [(3, 30, 0, None), (3, 31, 1, ""), (3, 32, 2, "OBF_ABCD_TBL_0001_AA was here")]
    return spark.createDataFrame(rows, "case_id long, artifact_id long, position int, text string")


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(1, "AAAA"), (2, "BBBB"), (3, "ABCD")], "case_id long, prefix string")


@pytest.fixture(scope="module")
def result(artifacts, cases):
    return engine.pseudonymise(artifacts, cases)


def test_kind_column_equals_python(artifacts):
    for r in artifacts.select("text", kind_column(F.col("text")).alias("k")).collect():
        assert r.k == kind_of(r.text or "")


def test_round_trip(artifacts, result):
    back = rewrite.exact_restore(result.masked).collect()
    assert len(back) == artifacts.count()
    assert all(r.restored == r.text for r in back)
    plan = next(r.masked for r in back if r.artifact_id == 11)
    assert "IX_PARCEL" not in plan and "00:00:02.88" in plan and "OBF_AAAA_IDX_" in plan


def test_registry_rules(result):
    rows = result.symbols.collect()
    for case in (1, 2):
        own = [r for r in rows if r.case_id == case]
        assert sorted(r.sequence for r in own) == list(range(1, len(own) + 1))
        assert len({(r.entity_type, r.canonical) for r in own}) == len(own)
    m = next(r for r in rows if r.case_id == 1 and r.sequence == 7)
    core = f"AAAA:{symbols.CODE[m.entity_type]}:7:1"
    assert m.marker == f"OBF_AAAA_{symbols.CODE[m.entity_type]}_0007_{hashlib.blake2s(core.encode(), digest_size=2).hexdigest()[:2].upper()}"
    assert symbols.validate_mapping(result.symbols).count() == 0


def test_mapping_is_stable_and_goes_on(spark, artifacts, cases, result):
    first = engine.pseudonymise(artifacts.where("position < 2"), cases)
    second = engine.pseudonymise(artifacts, cases, existing=first.symbols)
    old = {(r.case_id, r.entity_type, r.canonical): r.marker for r in first.symbols.collect()}
    new = {(r.case_id, r.entity_type, r.canonical): r.marker for r in second.symbols.collect()}
    assert old.items() <= new.items() and len(set(new.values())) == len(new)


def test_findings(result):
    codes = {(r.artifact_id, r.code) for r in result.findings.collect()}
    assert (32, "input_marker_collision") in codes and (11, "xplan_unknown_section_masked") in codes and (32, "unknown_artifact_replaced") in codes


def test_restore_refuses_changed_text(result):
    changed = result.masked.where("artifact_id = 11").withColumn("masked", F.concat(F.lit("x"), "masked"))
    with pytest.raises(Exception, match="marker"):
        rewrite.exact_restore(changed, result.replacements.select("artifact_id", "output_start", "output_end", "original", "marker")).collect()


def test_splices_agree(spark):
    df = spark.createDataFrame([("a\U0001f600bcd", [(0, 1, "X"), (2, 4, "YY")]), ("abc", []), ("", []), ("q", None)], "text string, parts array<struct<start:int,end:int,marker:string>>")
    rows = df.select(rewrite.splice(F.col("text"), F.coalesce("parts", F.expr("cast(array() as array<struct<start:int,end:int,marker:string>>)"))).alias("a"), rewrite.splice_long(F.col("text"), F.col("parts")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == ["X\U0001f600YYd", "abc", "", "q"]


def test_answers_come_back(spark, result):
    marker = next(r.marker for r in result.symbols.collect() if r.case_id == 1 and r.canonical == "U:LANES" and r.entity_type == "table")
    texts = spark.createDataFrame([(1, 1, f"use {marker.lower()} not OBF_AAAA_TBL_9999_00 nor x{marker}"), (2, 1, "plain")], "answer_id int, case_id long, text string")
    rows = {r.answer_id: r for r in rewrite.restore_answers(texts, result.symbols).collect()}
    assert rows[1].restored.lower().startswith("use lanes not obf_aaaa_tbl_9999_00 nor x") and rows[1].unknown == ["OBF_AAAA_TBL_9999_00"] and rows[2].restored == "plain"


def test_ranks_over_many_tasks(spark):
    rows = [(i % 3, (i * 7919) % 1000) for i in range(1000)]
    got = symbols.rank_in_group(spark.createDataFrame(rows, "g int, o int"), "g", ["o"], "r").collect()
    for g in range(3):
        own = sorted((r.o, r.r) for r in got if r.g == g)
        assert [r for _, r in own] == list(range(1, len(own) + 1))
    assert symbols.rank_in_group(spark.createDataFrame([], "g int, o int"), "g", ["o"], "r").count() == 0


def test_short_markers(spark):
    def fnv(s):
        h = 2166136261
        for c in s.encode():
            h = (h ^ c) * 16777619 % 2**32
        return f"{h & 255:02X}"

    row = spark.range(1).select(symbols.short_marker(F.lit("AB2"), F.lit("table"), F.lit(47)).alias("m")).withColumn("ok", symbols.short_marker_valid(F.col("m"))).first()
    assert row.m == "OBF_AB2_TBL_001B_" + fnv("AB2_TBL_001B") and row.ok


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert store.version("t") == 0 and store.write("t", df) == 1
    store.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"])
    store.append("t", spark.createDataFrame([(4, "e")], "id int, v string"))
    store.delete("t", spark.createDataFrame([(1,)], "id int"), ["id"])
    assert sorted(map(tuple, store.read("t").collect())) == [(2, "c"), (3, "d"), (4, "e")] and store.read("t", 1).count() == 2
    store.delete_case(3, {"t": "id", "missing": "id"})
    assert store.read("t").count() == 2
    (tmp_path / "s" / "_schema=1").rename(tmp_path / "s" / "_schema=9")
    assert Store(spark, f"file://{tmp_path}/s").version("t") == 0 and (tmp_path / "s.incompatible-1").exists()


def test_decode_chain():
    assert sources.decode("﻿привет".encode()) == "привет"
    assert sources.decode("select 1".encode("utf-16")) == "select 1"
    assert sources.decode("привет!".encode("cp1251")) == "привет!"
    assert sources.decode(bytes([0x98, 0xFF, 0x98])) == "\x98ÿ\x98" and sources.decode(None) is None


def test_corpus_rules(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.sql").write_text("select TOP_SECRET from t")
    (tmp_path / "a" / "lost.txt").write_text("nothing here")
    (tmp_path / "a" / "free.log").write_text("has PRIVATE_WORD")
    (tmp_path / "a" / "expectations.json").write_text('{"schemaVersion":1,"suite":"a","source":"s","cases":[{"file":"x.sql","kind":"sql","replace":["t"],"minOccurrences":2},{"file":"gone.sql","kind":"odd"}]}')
    cases, problems = sources.read_corpus(spark, f"file://{tmp_path}")
    by = {r.file.rsplit("/")[-1]: r for r in cases.collect()}
    assert by["x.sql"].replace == ["t", "TOP_SECRET"] and by["x.sql"].registered and by["free.log"].replace == ["PRIVATE_WORD"]
    found = sorted((r.rule, r.what.rsplit("/")[-1]) for r in problems.collect())
    assert found == [("bad_kind", "gone.sql"), ("missing_file", "gone.sql"), ("unregistered_without_sentinel", "lost.txt")]
    assert sources.read_uploads(spark, f"file://{tmp_path}").count() == 3


def test_corpus_values(spark, tmp_path):
    """What a file of expectations may hold."""
    import json

    (tmp_path / "b").mkdir()
    for name in ("x.sql", "y.sql", "z.sql", "w.sql"):
        (tmp_path / "b" / name).write_text("select TOP_SECRET from t")
    row = lambda file, **more: {"file": file, "kind": "sql", "replace": ["t"], "keep": [], "minOccurrences": 1, "allowFindings": [], "tags": [], **more}
    cases = [row("x.sql"), row("y.sql", keep=["a", "a"]), row("z.sql", tags=[""], minOccurrences=0), row("w.sql", kind=None), row("v.pdf")]
    (tmp_path / "b" / "expectations.json").write_text(json.dumps({"schemaVersion": 1, "suite": "B b", "source": "", "cases": cases}))
    _, problems = sources.read_corpus(spark, f"file://{tmp_path}/b")
    assert sorted((r.rule, r.what) for r in problems.collect()) == [
        ("bad_extension", "v.pdf"), ("bad_min_occurrences", "z.sql"), ("bad_suite", "B b"), ("empty_value", "z.sql"),
        ("missing_field", "w.sql"), ("missing_file", "v.pdf"), ("no_source", "B b"), ("repeated_value", "y.sql"),
    ]


def test_checksums_of_markers(spark):
    """The registered rows against the digest itself, and a fixed vector."""
    import hashlib

    from veilframe.functions.vocabulary import CODE
    from veilframe.plans import registry

    rows = registry.queries()["marker_blake2s"](spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        _, prefix, code, number, check = r.marker.split("_")
        assert code == CODE[r.entity_type] and number == f"{r.sequence:04d}"
        assert check == hashlib.blake2s(f"{prefix}:{code}:{r.sequence}:1".encode(), digest_size=2).hexdigest()[:2].upper()
    assert len({(r.case_id, r.marker) for r in rows}) == len(rows) > 1000


def test_compact_markers_of_odd_rows(spark):
    """Nulls, unknown cases and repeated rows restore nothing or alike; a checksum that does not fit is left."""
    from pyspark.sql import functions as F

    from veilframe.operators import rewrite, symbols

    known = spark.createDataFrame([(1, "table", "LANES", 1)], "case_id int, entity_type string, preferred_original string, sequence int").withColumn("marker", symbols.short_marker(F.lit("CASE"), F.col("entity_type"), F.col("sequence")))
    good = known.first().marker
    wrong = good[:-2] + ("00" if good[-2:] != "00" else "01")
    rows = [(1, 1, f"{good} {good.lower()} {wrong}"), (1, 1, f"{good} {good.lower()} {wrong}"), (2, 1, None), (3, None, good), (4, 9, good), (5, 1, "")]
    got = rewrite.restore_compact(spark.createDataFrame(rows, "answer_id int, case_id int, text string"), known).collect()
    assert sorted((r.answer_id, r.restored, r.n_restored, r.unknown) for r in got if r.answer_id != 2) == [
        (1, f"LANES LANES {wrong}", 2, [wrong]), (1, f"LANES LANES {wrong}", 2, [wrong]), (3, good, 0, [good]), (4, good, 0, [good]), (5, "", 0, [])
    ]
    assert [(r.restored, r.n_restored, r.unknown) for r in got if r.answer_id == 2] == [(None, 0, [])]


PAGE = """<html><head><style>x{}</style></head><body><h2>Find <b>it</b></h2><p>Use <code>a`b</code> and <a href="https://e.org/x">link</a>, <a href="javascript:x">bad</a> <em>now</em><br>OBF_AAAA_TBL_0001_FF *</p>
<div style="display: none">gone</div><p hidden>gone</p><ul><li>one<ol start="3"><li>deep</li></ol></li><li>two</li></ul><blockquote>said</blockquote><hr>
<pre><code class="language-oracle">select 1
from t</code></pre><table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table><table><tr><td>2</td><td>3</td></tr></table>
<div data-d-component="cards"><div><span>Rows</span><span>12</span></div><div><span>Cost</span><span>7</span></div></div><script>bad()</script>"""


def test_html_answers():
    out = answers.html_to_markdown(PAGE)
    assert out.startswith("## Find **it**\n\nUse ``a`b`` and [link](https://e.org/x), bad *now*\nOBF_AAAA_TBL_0001_FF")
    assert "gone" not in out and "bad()" not in out
    assert "- one\n  3. deep\n- two" in out and "> said" in out and "\n---\n" in out
    assert "```sql\nselect 1\nfrom t\n```" in out
    assert "| a | b\\|c |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |" in out
    assert "| Metric | Value |" in out and "| Cost | 7 |" in out
    assert answers.html_to_markdown(None) == "" and answers.html_to_markdown("<div>" * 5000 + "x") == "x"


def test_plain_answers():
    assert answers.plain_to_markdown("sql\n```\nselect\t1\n```\na\tb\n1\t2\n\n\n\nend ") == "```sql\nselect\t1\n```\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nend"
    assert answers.plain_to_markdown("a\tb") == "a\tb" and answers.plain_to_markdown(None) == ""
    assert answers.answer_to_markdown("x y", "<p>x <b>y</b></p>") == "x **y**" and answers.answer_to_markdown("other", "<p>x</p>") == "other"


def test_restored_html():
    shown = answers.restored_html("# T\n`OBF_A_TBL_1` **x** <i>\n```sql\nOBF_A_TBL_1 < 2\n```", {"OBF_A_TBL_1": "<b>"})
    assert shown == '<h1>T</h1>\n<p><code>&lt;b&gt;</code> <strong>x</strong> &lt;i&gt;</p>\n<pre><code class="language-sql">&lt;b&gt; &lt; 2</code></pre>'


def test_titles_and_status(spark):
    row = spark.range(1).select(workflow.title_from_question(F.lit("a  b\n" + "x" * 80)).alias("t"), rewrite.validation_status(F.lit(1), F.lit(True)).alias("s")).first()
    assert len(row.t) == 60 and row.t.startswith("a b x") and row.t.endswith("…") and row.s == "warning"


def test_stream_registry(spark, tmp_path, cases):
    """Batches, a restart from the checkpoint, repeated and late rows: numbers go on, none is given twice."""
    from veilframe.streaming.registry import keep_registry

    schema = "case_id long, artifact_id long, position int, start int, entity_type string, canonical string, original string, confidence double"
    rows = [
        [(1, 1, 4, 5, "table", "U:B", "b", 0.5), (1, 1, 4, 0, "table", "U:A", "a", 1.0), (2, 9, 0, 0, "table", "U:A", "a", 1.0), (None, 9, 0, 0, "table", "U:N", "n", 1.0)],
        [(1, 2, 5, 0, "table", "U:B", "B", 0.9), (1, 2, 5, 9, "column", "U:C", "c", 1.0), (1, 2, 5, 20, "column", "U:C", "C", 1.0)],
        [(1, 0, 0, 0, "view", "U:LATE", "late", 1.0), (1, 0, 0, 9, "table", "U:A", "a", 1.0)],
    ]
    for part in rows:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # the second start finds nothing new
            keep_registry(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), cases, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = sorted((r.case_id, r.canonical, r.preferred_original, r.sequence) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "U:A", "a", 1), (1, "U:B", "b", 2), (1, "U:C", "c", 3), (1, "U:LATE", "late", 4), (2, "U:A", "a", 1)]
    assert spark.read.parquet(f"{tmp_path}/out").where("marker like 'OBF\\_AAAA\\_%'").count() == 4


def test_sql_functions(spark):
    from veilframe.functions.sql import register

    register(spark)
    row = spark.sql("SELECT veil_kind(t) AS k, veil_spans(t) AS s, veil_html_markdown('<b>x</b>') AS m, veil_plain_markdown('a') AS p FROM (SELECT 'select a from b' AS t)").first()
    assert tuple(row) == ("sql", '[[7, 8, "column"], [14, 15, "table"]]', "**x**", "a")
    rows = spark.sql("SELECT i, s.start, s.entity_type, s.canonical FROM VALUES (1, 'select a from b'), (2, NULL), (3, '') AS x(i, t), LATERAL veil_spans(t) s").collect()
    assert sorted(map(tuple, rows)) == [(1, 7, "column", "U:A"), (1, 14, "table", "U:B")]
    masks = spark.sql("SELECT veil_obfuscate(t, map('column:U:A', 'X', 'table:U:B', 'Y')) AS m, veil_obfuscate(t, map('column:U:A', 'X')) AS w, veil_obfuscate(t, NULL) AS n FROM VALUES ('select a from b'), (NULL) AS x(t)").collect()
    assert [tuple(r) for r in masks] == [("select X from Y", engine.WITHHELD, engine.WITHHELD), (None, None, None)]
    back = spark.sql("SELECT veil_restore('obf_x_tbl_1, xOBF_X_TBL_1 OBF_X_TBL_12', map('OBF_X_TBL_1', 'lanes')) AS r, veil_restore('a', NULL) AS s, veil_restore(NULL, map('a', 'b')) AS n").first()
    assert tuple(back) == ("lanes, xOBF_X_TBL_1 OBF_X_TBL_12", "a", None)


def test_token_rows_of_rows_that_share_keys(spark):
    from veilframe.operators import spans

    rows = spark.createDataFrame([(1, "ab cd"), (1, "xyz w"), (None, "q"), (2, None), (3, "")], "id int, text string")
    got = sorted(((r.id or 0, r.i, r.token, r.start, r.end) for r in spans.token_rows(rows, ["id"], "text", "[a-z]+").collect()))
    assert got == [(0, 0, "q", 0, 1), (1, 0, "ab", 0, 2), (1, 0, "xyz", 0, 3), (1, 1, "cd", 3, 5), (1, 1, "w", 4, 5)]
    beside = spans.token_rows(spark.createDataFrame([(1, '"A"@"B" x')], "id int, text string"), ["id"], "text", '"[^"]*"|[a-z]', around=True).orderBy("i").collect()
    assert [(r.token, r.before, r.after) for r in beside] == [('"A"', "", "@"), ('"B"', "@", " "), ("x", " ", "")]
