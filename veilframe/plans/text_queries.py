"""Queries over the text engine's operators: scanning, detection, lexing, spans, symbols, rewriting."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sql import register
from ..functions.vocabulary import CODE, GLOBAL_KEPT, GLOBAL_MASKED, HINT_WORDS, by_label
from ..operators import answers, casebook, detection, engine, rewrite, spans, sql_text, statements, symbols
from ..operators.scratch import spread, written
from ..sources import text as sources
from . import base
from .base import SQL, duck_tokens, plain, query

WORD = rewrite.WORD


@query("word_spans", f"SELECT doc_id, i, token, s AS start_at, e AS end_at FROM ({duck_tokens('SELECT * FROM documents', 'doc_id', 'text', WORD)})")
def word_spans(t):
    rows = spans.token_rows(t.documents, ["doc_id"], "text", WORD)
    return rows.withColumnsRenamed({"start": "start_at", "end": "end_at"})


@query("line_spans", f"SELECT doc_id, i, s AS start_at, e AS end_at FROM ({duck_tokens('SELECT * FROM documents', 'doc_id', 'text', '[^' + chr(92) + 'n]*' + chr(92) + 'n|[^' + chr(92) + 'n]+$')})")
def line_spans(t):
    rows = spans.token_rows(t.documents, ["doc_id"], "text", spans.LINE)
    return rows.select("doc_id", "i", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(
    "trimmed_spans",
    r"""SELECT conv_id, turn, CAST(length(t) - length(regexp_replace(t, '^\s+', '')) AS INTEGER) AS start_at, CAST(length(regexp_replace(t, '\s+$', '')) AS INTEGER) AS end_at
    FROM (SELECT conv_id, turn, '  ' || text || chr(10) || ' ' AS t FROM conversations)""",
)
def trimmed_spans(t):
    padded = t.conversations.select("conv_id", "turn", F.concat(F.lit("  "), "text", F.lit("\n ")).alias("t"))
    return padded.select("conv_id", "turn", spans.trimmed_bounds(F.col("t")).alias("b")).select("conv_id", "turn", F.col("b.start").alias("start_at"), F.col("b.end").alias("end_at"))


@query(
    "size_guard",
    "SELECT lang, count(*) AS n, CAST(count(*) FILTER (WHERE length(text) <= 104857600 AND octet_length(encode(text)) <= 104857600) AS BIGINT) AS accepted, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents GROUP BY lang",
)
def size_guard(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(sources.within_limit(F.col("text"))).alias("accepted"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"))


_SECRETS = "SELECT c_custkey, 'col_' || c_mktsegment || '_SECRET, PRIVATE_' || CAST(c_custkey % 9 AS STRING) || ' and private$x ' || c_name || ' col_' || c_mktsegment || '_SECRET' AS text FROM {customer}"


@query("sentinel_values", f"""SELECT c_custkey, string_agg(w, ',' ORDER BY first) AS words FROM (SELECT c_custkey, w, min(i) AS first FROM (
    SELECT c_custkey, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT c_custkey, regexp_extract_all(text, '{sources.SENTINEL}') AS w FROM ({plain(_SECRETS)}))) GROUP BY c_custkey, w) GROUP BY c_custkey""")
def sentinel_values(t):
    return t.sql(_SECRETS).select("c_custkey", F.array_join(sources.sentinels(F.col("text")), ",").alias("words"))


def _rule(kind, some):
    return f"WHEN {' OR '.join('(' + ' AND '.join(_match(p) for p in every) + ')' for every in some)} THEN '{kind}'"


def _match(p):
    p = p.replace(r"\A", "^") if p.startswith("(?i)") else p
    return f"regexp_matches(text, '{p}')"


_KIND_SQL = r"CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 'unknown' " + " ".join(_rule(k, s) for k, s in detection.RULES) + " ELSE 'unknown' END"


@query("detect_kind", f"SELECT artifact_id, {_KIND_SQL} AS kind FROM ({plain(base.MIXED)})")
def detect_kind(t):
    return t.sql(base.MIXED).select("artifact_id", detection.kind_column(F.col("text")).alias("kind"))


@query("detect_kind_pages", f"SELECT page_id, {_KIND_SQL} AS kind FROM (SELECT page_id, html AS text FROM pages)")
def detect_kind_pages(t):
    return t.pages.select("page_id", detection.kind_column(F.col("html")).alias("kind"))


_REGION = pa.struct([("kind", pa.string()), ("start_at", pa.int32()), ("end_at", pa.int32())])


def _marked_by(texts, kind, head=""):
    """Marks that a kind's reader makes in texts under a heading: text, start, end, original, entity_type; places count from the text's own beginning."""
    whole = texts.select("artifact_id", F.concat(F.lit(head), "text").alias("text"), F.lit(kind).alias("kind"))
    found = detection.with_parsed(whole, kind_col="kind").select("artifact_id", F.explode("parsed.spans").alias("s"), F.expr(f"substring(text, {len(head)} + 1)").alias("text"))
    own = found.where(F.col("s.start") >= len(head))
    return own.select("artifact_id", "text", (F.col("s.start") - len(head)).alias("start"), (F.col("s.end") - len(head)).alias("end"), "s.original", "s.entity_type")


_REPORTS = "SELECT artifact_id, 'intro' || chr(10) || CASE WHEN artifact_id % 2 = 0 THEN 'SQL Monitoring Report' || chr(10) || 'body' || chr(10) ELSE '' END || 'SQL_ID x' || CAST(artifact_id AS STRING) || ', child number 1' || chr(10) || 'Plan hash value: 1' || chr(10) || 'row' || chr(10) || 'Plan hash value: 2' || chr(10) || 'end' AS text FROM (" + base.MIXED + ") m"


@query(
    "report_regions",
    f"""WITH r AS ({plain(_REPORTS)}), l AS (SELECT artifact_id, text, s, token, CASE WHEN token LIKE 'SQL Mon%' THEN 'sql_monitor' WHEN token LIKE 'SQL_ID%' THEN 'plan' WHEN token LIKE 'Plan hash%' THEN 'hash' END AS h
        FROM ({duck_tokens('SELECT * FROM r', 'artifact_id, text', 'text', '[^' + chr(92) + 'n]+')})),
    h AS (SELECT *, lag(h) OVER (PARTITION BY artifact_id ORDER BY s) AS before FROM l WHERE h IS NOT NULL),
    st AS (SELECT artifact_id, text, s, CASE WHEN h = 'sql_monitor' THEN h ELSE 'xplan' END AS kind FROM h WHERE NOT (h = 'hash' AND before = 'plan'))
    SELECT artifact_id, kind, s AS start_at, CAST(length(rtrim(text[:coalesce(lead(s) OVER (PARTITION BY artifact_id ORDER BY s), length(text))], chr(10))) AS INTEGER) AS end_at FROM st""",
)
def report_regions(t):
    """Whole reports of pastes by the segmenting reader."""
    found = F.arrow_udf(lambda texts: pa.array([[{"kind": k, "start_at": s, "end_at": e} for k, s, e in detection.report_regions(x)] for x in texts.to_pylist()], pa.list_(_REGION)), "array<struct<kind:string,start_at:int,end_at:int>>")
    return t.sql(_REPORTS).select("artifact_id", F.explode(found("text")).alias("r")).select("artifact_id", "r.*")


# A report runs to the end of the paste; other materials are what the fence holds, trimmed
_FENCED = f"""SELECT artifact_id, kind, CAST(11 + length(text) - length(ltrim(text)) AS INTEGER) AS start_at, CAST(CASE WHEN kind IN ('xplan', 'sql_monitor') THEN 15 + length(text) ELSE 11 + length(rtrim(text)) END AS INTEGER) AS end_at
    FROM (SELECT *, CASE artifact_id % 7 WHEN 2 THEN 'xplan' WHEN 3 THEN 'sql_monitor' WHEN 4 THEN 'outline' WHEN 5 THEN 'predicates' ELSE 'sql' END AS kind FROM ({plain(base.MIXED)}))"""


@query("split_materials", _FENCED)
def split_materials(t):
    """Materials of pastes by the segmenting reader."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, s, e) for i, x in zip(b["artifact_id"], b["text"], strict=True) for k, s, e in detection.split_materials(x)]
            yield pd.DataFrame(rows, columns=["artifact_id", "kind", "start_at", "end_at"])

    fenced = t.sql("SELECT artifact_id, 'see' || chr(10) || '```sql' || chr(10) || text || chr(10) || '```' AS text FROM (" + base.MIXED + ") m")
    return fenced.mapInPandas(run, "artifact_id long, kind string, start_at int, end_at int")


@query("parse_prompts")
def parse_prompts(t):
    asked = t.sql("SELECT artifact_id, 'help: ' || text AS text FROM (" + base.MIXED + ") m")
    rows = detection.with_parsed(asked, prompt=True)
    return rows.select("artifact_id", "parsed.kind", F.size("parsed.spans").alias("n_spans"), F.to_json("parsed.findings.code").alias("findings"))


_LINES = f"SELECT artifact_id, i AS line, replace(token, chr(10), '') AS text FROM ({duck_tokens(plain(base.PLANS), 'artifact_id', 'text', '[^' + chr(92) + 'n]*' + chr(92) + 'n')})"


def _plan_lines(t):
    return spans.token_rows(t.sql(base.PLANS), ["artifact_id"], "text", "[^\\n]*\\n").select("artifact_id", F.col("i").alias("line"), F.replace("token", F.lit("\n"), F.lit("")).alias("text"))


_CELLS = f"""SELECT artifact_id, line, CAST(i - 2 AS INTEGER) AS i, cell, CAST(e - length(cell) AS INTEGER) AS start_at, CAST(e AS INTEGER) AS end_at FROM (
    SELECT artifact_id, line, i, n, p[i] AS cell, sum(length(p[i]) + 1) OVER (PARTITION BY artifact_id, line ORDER BY i) - 1 AS e FROM (
        SELECT artifact_id, line, p, len(p) AS n, unnest(range(1, len(p) + 1)) AS i FROM (SELECT artifact_id, line, string_split(text, '|') AS p FROM ({_LINES})))) WHERE i > 1 AND i < n"""


@query("table_cells", _CELLS)
def table_cells(t):
    rows = spans.cell_rows(_plan_lines(t), ["artifact_id", "line"], "text")
    return rows.withColumnsRenamed({"start": "start_at", "end": "end_at"})


def _plan_names(found):
    """A plan's names by line and by place in their cell."""
    line = F.regexp_count(F.expr("substring(text, 1, start)"), F.lit("\n"))
    part = F.row_number().over(Window.partitionBy("artifact_id", "line").orderBy("start")) - 1
    return found.withColumn("line", line).select("artifact_id", "line", part.alias("part"), F.col("original").alias("name"), "entity_type")


def _plan_names_sql(order):
    case = " ".join(f"WHEN contains(operation, '{w}') THEN '{w.lower()}'" for w in order)
    return f"""WITH c AS ({_CELLS}), r AS (SELECT artifact_id, line, max(CASE WHEN i = 1 THEN trim(cell) END) AS operation, max(CASE WHEN i = 2 THEN trim(cell) END) AS name FROM c WHERE line > 0 GROUP BY ALL),
    p AS (SELECT artifact_id, line, CASE {case} ELSE 'identifier' END AS kind, string_split(name, '.') AS p FROM r WHERE name <> ''),
    u AS (SELECT artifact_id, line, kind, len(p) AS n, unnest(range(len(p))) AS part, unnest(p) AS name FROM p)
    SELECT artifact_id, line, CAST(part AS INTEGER) AS part, name, CASE WHEN part < n - 1 THEN 'schema' ELSE kind END AS entity_type FROM u"""


@query("plan_names_xplan", _plan_names_sql(["TABLE", "VIEW", "PARTITION", "INDEX"]))
def plan_names_xplan(t):
    return _plan_names(_marked_by(t.sql(base.PLANS), "xplan"))


@query("plan_names_monitor", _plan_names_sql(["INDEX", "VIEW", "TABLE"]))
def plan_names_monitor(t):
    return _plan_names(_marked_by(t.sql(base.PLANS), "sql_monitor", "SQL Monitoring Report\n\nSQL Plan Monitoring Details (Plan Hash Value=1)\n=====\n"))


@query("plan_header_fields", rf"""SELECT artifact_id, regexp_extract(text, 'SQL_ID\s+([a-z0-9]+)\s*,\s*child number\s+(\d+)', 1) AS sql_id, regexp_extract(text, 'child number\s+(\d+)', 1) AS child, regexp_extract(text, 'Plan hash value\s*[:=]\s*(\d+)', 1) AS plan_hash
    FROM ({plain(base.MIXED)})""")
def plan_header_fields(t):
    """What the plan reader marks in headers; texts of other kinds have none."""
    art = t.sql(base.MIXED)
    read = detection.with_parsed(art)
    first = lambda kind: F.coalesce(F.get(F.filter("parsed.spans", lambda s: s["entity_type"] == kind), 0)["original"], F.lit(""))
    return read.select("artifact_id", first("sql_id").alias("sql_id"), first("execution_id").alias("child"), first("plan_hash").alias("plan_hash"))


_MASKED = by_label(GLOBAL_MASKED)
_LABEL_CASE = " ".join(f"WHEN label IN ({', '.join(repr(x) for x in labels)}) THEN '{kind}'" for kind, labels in GLOBAL_MASKED.items())


@query("monitor_global_fields", rf"""WITH l AS (SELECT artifact_id, unnest(string_split(text, chr(10))) AS line FROM ({plain(base.GLOBALS)})),
    f AS (SELECT artifact_id, lower(regexp_extract(line, '^\s*([^:]+?)\s*:\s*(.*?)\s*$', 1)) AS label, regexp_extract(line, '^\s*([^:]+?)\s*:\s*(.*?)\s*$', 2) AS value FROM l)
    SELECT artifact_id, label, value, CASE {_LABEL_CASE} ELSE 'fragment' END AS entity_type FROM f WHERE value NOT IN ('', '-') AND label NOT IN ({', '.join(repr(x) for x in GLOBAL_KEPT)})""")
def monitor_global_fields(t):
    """Values of the global section that the monitor reader marks, with their labels."""
    found = _marked_by(t.sql(base.GLOBALS), "sql_monitor", "SQL Monitoring Report\n\nGlobal Information\n-----\n")
    line = F.element_at(F.split(F.expr("substring(text, 1, start)"), "\n"), -1)
    return found.select("artifact_id", F.lower(F.trim(F.regexp_extract(line, r"^\s*([^:]+?)\s*:", 1))).alias("label"), F.col("original").alias("value"), "entity_type")


_PIPE_BINDS = "SELECT o_orderkey AS artifact_id, ' :B' || CAST(o_orderkey % 9 AS STRING) || ' (VARCHAR2) = ' || CASE o_orderkey % 3 WHEN 0 THEN chr(39) || o_orderpriority || chr(39) WHEN 1 THEN CAST(o_custkey AS STRING) ELSE 'NULL' END AS text FROM {orders}"


@query("bind_values", rf"""WITH b AS (SELECT artifact_id, regexp_extract(text, ':([A-Za-z0-9_$#]+)', 1) AS bind, regexp_extract(text, '=\s*(.+?)\s*$', 1) AS value FROM ({plain(_PIPE_BINDS)}))
    SELECT artifact_id, bind, CASE WHEN value LIKE '''%' THEN value[2:-2] ELSE value END AS value, CASE WHEN value LIKE '''%' THEN 'string_literal' WHEN regexp_matches(value, '^[0-9]+$') THEN 'number_literal' END AS entity_type FROM b""")
def bind_values(t):
    """Binds and their values by the monitor reader; a value that it leaves is NULL."""
    found = _marked_by(t.sql(_PIPE_BINDS), "sql_monitor", "SQL Monitoring Report\n\nBind Variables\n-----\n")
    bind, value = F.col("entity_type") == "bind", F.col("entity_type") != "bind"
    per = found.groupBy("artifact_id").agg(F.max(F.when(bind, F.col("original"))).alias("bind"), F.coalesce(F.max(F.when(value, F.col("original"))), F.lit("NULL")).alias("value"), F.max(F.when(value, F.col("entity_type"))).alias("entity_type"))
    return per


# ---- expressions, canonical keys, symbols ----
_EXPR = duck_tokens(plain(base.PREDICATES), "artifact_id, case_id, position, text", "text", spans.EXPRESSION)
_STAY = ", ".join(repr(x) for x in ("ACCESS", "FILTER", "AND", "OR", "IN", "NOT", *sorted(spans._functions())))
EXPR_SQL = f"""SELECT artifact_id, case_id, position, i, CAST(s + lead_in AS INTEGER) AS s, CAST(e - tail AS INTEGER) AS e, text[s + lead_in + 1:e - tail] AS original, entity_type FROM (
    SELECT *, CASE WHEN token[1] IN ('"', '''', ':') THEN 1 ELSE 0 END AS lead_in, CASE WHEN token[1] IN ('"', '''') THEN 1 ELSE 0 END AS tail,
        CASE WHEN token[1] = '"' THEN CASE WHEN s > 0 AND text[s] = '@' THEN 'query_block' WHEN text[e + 1] IN ('@', '.') THEN 'alias' ELSE 'column' END
             WHEN token[1] = '''' THEN 'string_literal' WHEN token[1] = ':' THEN 'bind' WHEN regexp_matches(token, '^(SEL|SET|INS|UPD|DEL|MRG)[$]') THEN 'query_block'
             WHEN regexp_matches(token, '^[0-9]') THEN 'number_literal' WHEN text[e + 1] = '(' AND upper(token) NOT IN ({_STAY}) THEN 'function' END AS entity_type FROM ({_EXPR}))"""
CANON_SQL = """CASE WHEN entity_type IN ('string_literal', 'comment', 'fragment') THEN original WHEN entity_type IN ('number_literal', 'datetime_literal') THEN upper(original)
    WHEN regexp_matches(original, '^[A-Z][A-Z0-9_$#]*$') THEN 'U:' || original ELSE 'Q:' || original END"""
_CODE_CASE = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODE.items()) + " END"
# An operation's number at the head of a line is no literal
SPAN_SQL = f"""SELECT artifact_id, case_id, position, s, e, original, entity_type, {CANON_SQL} AS canonical FROM ({EXPR_SQL}) WHERE entity_type IS NOT NULL"""
REG_SQL = f"""SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY fp, fs, entity_type, canonical) AS INTEGER) AS sequence FROM (
    SELECT case_id, entity_type, canonical, min(position) AS fp, arg_min(s, position * 1000000 + s) AS fs, arg_min(original, position * 1000000 + s) AS preferred_original FROM ({SPAN_SQL}) GROUP BY ALL)"""
MARK = f"'OBF_C' || case_id || '_' || {_CODE_CASE} || '_' || CASE WHEN sequence < 10000 THEN lpad(CAST(sequence AS VARCHAR), 4, '0') ELSE CAST(sequence AS VARCHAR) END"
PLACED_SQL = f"""SELECT x.*, {MARK.replace('case_id', 'x.case_id').replace('CASE entity_type', 'CASE x.entity_type')} AS marker FROM ({SPAN_SQL}) x JOIN ({REG_SQL}) r ON x.case_id = r.case_id AND x.entity_type = r.entity_type AND x.canonical = r.canonical"""


def _spans(t):
    rows = spans.expression_tokens(spread(t.sql(base.PREDICATES)), ["artifact_id", "case_id", "position"], "text").where("entity_type is not null")
    return rows.withColumn("canonical", spans.canonical_key(F.col("original"), F.col("entity_type"))).withColumn("confidence", F.lit(1.0))


def _registry(found):
    ranked = symbols.rank_in_group(symbols.first_seen(found).withColumn("p", F.col("first.position")).withColumn("s", F.col("first.start")), "case_id", ["p", "s", "entity_type", "canonical"], "sequence")
    mark = F.format_string("OBF_C%s_%s_%04d", F.col("case_id"), symbols.entity_code(F.col("entity_type")), F.col("sequence"))
    return ranked.withColumn("marker", mark)


def _marked(t):
    key = ["case_id", "entity_type", "canonical"]
    found = written(_spans(t).select("artifact_id", *key, "position", "start", "end", "original", "confidence"))  # read twice
    return found.select("artifact_id", *key, "start", "end", "original").join(_registry(found).select(*key, "marker"), key).drop(*key)


@query("expression_tokens", f"SELECT artifact_id, i, s AS start_at, e AS end_at, original, entity_type FROM ({EXPR_SQL})")
def expression_tokens(t):
    rows = spans.expression_tokens(spread(t.sql(base.PREDICATES)), ["artifact_id", "case_id", "position"], "text")
    return rows.select("artifact_id", "i", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "original", "entity_type")


@query("token_types", f"SELECT case_id, entity_type, count(*) AS n FROM ({EXPR_SQL}) GROUP BY ALL")
def token_types(t):
    return spans.expression_tokens(spread(t.sql(base.PREDICATES)), ["artifact_id", "case_id", "position"], "text").groupBy("case_id", "entity_type").agg(F.count("*").alias("n"))


@query("canonical_keys", f"SELECT entity_type, canonical, count(*) AS n, count(DISTINCT original) AS n_lexemes FROM ({SPAN_SQL}) GROUP BY ALL")
def canonical_keys(t):
    return _spans(t).groupBy("entity_type", "canonical").agg(F.count("*").alias("n"), F.countDistinct("original").alias("n_lexemes"))


@query("symbol_registry", f"SELECT case_id, entity_type, canonical, preferred_original, sequence, {MARK} AS marker FROM ({REG_SQL})")
def symbol_registry(t):
    return _registry(_spans(t)).select("case_id", "entity_type", "canonical", "preferred_original", "sequence", "marker")


@query("symbol_registry_incremental", f"""WITH old AS (SELECT case_id, entity_type, canonical, CAST(row_number() OVER (PARTITION BY case_id ORDER BY fp, fs, entity_type, canonical) AS INTEGER) AS sequence FROM (
        SELECT case_id, entity_type, canonical, min(position) AS fp, arg_min(s, position * 1000000 + s) AS fs FROM ({SPAN_SQL}) WHERE artifact_id % 2 = 0 GROUP BY ALL)),
    fresh AS (SELECT case_id, entity_type, canonical, min(position) AS fp, arg_min(s, position * 1000000 + s) AS fs FROM ({SPAN_SQL}) x WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.case_id = x.case_id AND o.entity_type = x.entity_type AND o.canonical = x.canonical) GROUP BY ALL)
    SELECT * FROM old UNION ALL SELECT f.case_id, entity_type, canonical, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY f.case_id ORDER BY fp, fs, entity_type, canonical) AS INTEGER)
    FROM fresh f LEFT JOIN (SELECT case_id, max(sequence) AS last FROM old GROUP BY case_id) m ON m.case_id = f.case_id""")
def symbol_registry_incremental(t):
    """A second run over more artifacts keeps every number and goes on from the last."""
    found = _spans(t)
    cases = found.select("case_id").distinct().withColumn("prefix", symbols.case_prefix(F.col("case_id")))
    first = symbols.register(found.where("artifact_id % 2 = 0"), cases)
    return symbols.register(found, cases, first).select("case_id", "entity_type", "canonical", "sequence")


@query("case_prefixes", """SELECT c_custkey AS case_id, array_to_string(list_transform([3, 2, 1, 0], lambda k: 'ABCDEFGHJKLMNPQRSTUVWXYZ23456789'[CAST((c_custkey >> CAST(5 * k AS INTEGER)) % 32 + 1 AS INTEGER)]), '') AS prefix FROM customer""")
def case_prefixes(t):
    return t.customer.select(F.col("c_custkey").alias("case_id"), symbols.case_prefix(F.col("c_custkey")).alias("prefix"))


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split(core, ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda a, c: (xor(a, c) * 16777619) & 4294967295)"
_B36 = "lpad(array_to_string(list_transform([3, 2, 1, 0], lambda k: '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'[CAST((sequence // CAST(pow(36, k) AS BIGINT)) % 36 + 1 AS INTEGER)]), ''), 4, '0')"
_SHORT = f"""SELECT case_id, entity_type, sequence, 'OBF_' || core || '_' || upper(printf('%02x', CAST({_FNV} & 255 AS INTEGER))) AS marker FROM (
    SELECT case_id, entity_type, sequence, 'C' || case_id || '_' || {_CODE_CASE} || '_' || {_B36} AS core FROM ({plain(base.SYMBOLS)}))"""


def _short(t):
    return t.sql(base.SYMBOLS).withColumn("marker", symbols.short_marker(F.concat(F.lit("C"), F.col("case_id")), F.col("entity_type"), F.col("sequence")))


@query("marker_fnv", _SHORT)
def marker_fnv(t):
    return _short(t).select("case_id", "entity_type", "sequence", "marker")


@query("marker_fnv_verify", f"SELECT count(*) AS n, count(*) AS n_valid, CAST(count(*) FILTER (WHERE marker[-1] = '0') AS BIGINT) AS n_valid_changed FROM ({_SHORT})")
def marker_fnv_verify(t):
    rows = _short(t).select("marker", symbols.short_marker_valid(F.col("marker")).alias("ok"), symbols.short_marker_valid(F.concat(F.expr("left(marker, length(marker) - 1)"), F.lit("0"))).alias("changed"))
    return rows.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_valid"), F.count_if("changed").alias("n_valid_changed"))


@query("marker_blake2s")
def marker_blake2s(t):
    return t.sql(base.SYMBOLS).select("case_id", "entity_type", "sequence", symbols.marker(symbols.case_prefix(F.col("case_id")), F.col("entity_type"), F.col("sequence")).alias("marker"))


_BROKEN = base.SYMBOLS + " UNION ALL SELECT CAST(7 AS BIGINT), 'table', 'X', 'U:X', 1, 'OBF_bad' FROM {region} WHERE r_regionkey < 2"


@query("mapping_validation", f"""WITH m AS ({plain(_BROKEN)})
    SELECT case_id, 'bad_marker' AS problem, marker AS what FROM m WHERE NOT regexp_matches(marker, '^OBF_[A-Z0-9]{{1,8}}_[A-Z]{{2,5}}_[0-9A-Z]{{4,}}_[0-9A-F]{{2}}$')
    UNION ALL SELECT case_id, 'duplicate_marker', marker FROM m GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT case_id, 'duplicate_sequence', CAST(sequence AS VARCHAR) FROM m GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT case_id, 'duplicate_key', entity_type || '|' || canonical FROM m GROUP BY ALL HAVING count(*) > 1""")
def mapping_validation(t):
    return symbols.validate_mapping(t.sql(_BROKEN))


@query("mapping_merge", f"""WITH m AS ({plain(base.SYMBOLS)}), a AS (SELECT case_id, marker, sequence FROM m), b AS (SELECT case_id - case_id % 2 AS case_id, marker, sequence FROM m)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE (case_id, marker) NOT IN (SELECT (case_id, marker) FROM a)""")
def mapping_merge(t):
    """Every case's mapping takes up that of the odd case after it; what both hold stays once."""
    m = t.sql(base.SYMBOLS).select("case_id", "marker", "sequence")
    return symbols.merge_mappings(m, m.withColumn("case_id", F.expr("case_id - case_id % 2")))


_CLEARED = f"""WITH m AS ({plain(base.SYMBOLS)}), d AS (SELECT c_custkey % 50 AS case_id FROM customer GROUP BY ALL HAVING min(c_acctbal) > (SELECT avg(low) FROM (SELECT min(c_acctbal) AS low FROM customer GROUP BY c_custkey % 50)))
    SELECT 'one' AS cleared, case_id, count(*) AS n FROM m WHERE case_id <> 7 GROUP BY case_id
    UNION ALL SELECT 'some', case_id, count(*) FROM m WHERE case_id NOT IN (SELECT case_id FROM d) GROUP BY case_id
    UNION ALL SELECT 'some, mappings gone', NULL, count(*) FROM d UNION ALL SELECT 'all', NULL, 0"""


@query("mapping_clear", _CLEARED)
def mapping_clear(t):
    """Mappings left after one case, the cases of the better customers, and all are cleared, and how many of the second went."""
    m = t.sql(base.SYMBOLS)
    low = t.customer.groupBy((F.col("c_custkey") % 50).alias("case_id")).agg(F.min("c_acctbal").alias("low"))
    doomed = low.join(F.broadcast(low.agg(F.avg("low").alias("mean"))), F.col("low") > F.col("mean")).select("case_id")  # one row
    per = lambda name, df: df.groupBy("case_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("cleared"), "case_id", "n")
    one = t.spark.createDataFrame([(7,)], "case_id long")
    total = lambda name, df: df.select(F.lit(name).alias("cleared"), F.lit(None).cast("long").alias("case_id"), "n")
    out = per("one", symbols.clear_mappings(m, one)).unionByName(per("some", symbols.clear_mappings(m, doomed)))
    gone = symbols.mapping_cases(m).join(doomed, "case_id", "left_semi").agg(F.count("*").alias("n"))
    return out.unionByName(total("some, mappings gone", gone)).unionByName(total("all", symbols.clear_mappings(m).agg(F.count("*").alias("n"))))


# ---- span algebra ----
@query("span_dedupe", f"SELECT doc_id, span_id, s AS start_at, e AS end_at, priority FROM ({plain(base.SPANS)}) QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY priority DESC, pos) = 1")
def span_dedupe(t):
    rows = spans.dedupe_spans(t.sql(base.SPANS).withColumnsRenamed({"s": "start", "e": "end"}))
    return rows.select("doc_id", "span_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "priority")


_FOLD = f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, -priority, s - e, span_id) AS k FROM (SELECT * FROM ({plain(base.SPANS)}) QUALIFY row_number() OVER (PARTITION BY doc_id, s, e ORDER BY priority DESC, pos) = 1)),
    f(doc_id, k, last_id, last_end, last_priority, done) AS (
        SELECT doc_id, k, span_id, e, priority, CAST([] AS BIGINT[]) FROM d WHERE k = 1
        UNION ALL SELECT f.doc_id, d.k, CASE WHEN d.s >= last_end OR d.priority > last_priority THEN d.span_id ELSE last_id END, CASE WHEN d.s >= last_end OR d.priority > last_priority THEN d.e ELSE last_end END,
            CASE WHEN d.s >= last_end OR d.priority > last_priority THEN d.priority ELSE last_priority END, CASE WHEN d.s >= last_end THEN list_append(done, last_id) ELSE done END
        FROM f JOIN d ON d.doc_id = f.doc_id AND d.k = f.k + 1)
    SELECT doc_id, unnest(list_append(done, last_id)) AS span_id FROM f QUALIFY k = max(k) OVER (PARTITION BY doc_id)"""


@query("span_overlap_fold", _FOLD)
def span_overlap_fold(t):
    rows = t.sql(base.SPANS).withColumnsRenamed({"s": "start", "e": "end"})
    per = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "start", "end", "priority", "span_id"))).alias("a"))
    return per.select("doc_id", F.explode(spans.fold_overlaps(F.col("a"))).alias("x")).select("doc_id", "x.span_id")


@query("span_overlap_pairs", f"WITH p AS ({plain(base.SPANS)}) SELECT a.doc_id, a.span_id AS a_span_id, b.span_id AS b_span_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.span_id < b.span_id AND a.s < b.e AND b.s < a.e")
def span_overlap_pairs(t):
    return spans.overlap_pairs(t.sql(base.SPANS).withColumnsRenamed({"s": "start", "e": "end"}))


_TYPED = "SELECT l_orderkey % 40 AS case_id, 'U:N' || CAST(l_partkey % 60 AS STRING) AS canonical, CASE WHEN l_linenumber = 1 AND l_partkey % 3 = 0 THEN 'table' WHEN l_linenumber = 2 AND l_partkey % 6 = 0 THEN 'view' ELSE 'identifier' END AS entity_type, l_orderkey * 10 + l_linenumber AS span_id FROM {lineitem}"


@query("reconcile_types", f"""WITH s AS ({plain(_TYPED)}), k AS (SELECT case_id, canonical, min(entity_type) AS sole FROM s WHERE entity_type NOT IN ('identifier', 'fragment') GROUP BY ALL HAVING count(DISTINCT entity_type) = 1)
    SELECT span_id, s.case_id, s.canonical, CASE WHEN entity_type = 'identifier' THEN coalesce(sole, entity_type) ELSE entity_type END AS entity_type FROM s LEFT JOIN k ON s.case_id = k.case_id AND s.canonical = k.canonical""")
def reconcile_types(t):
    return spans.reconcile_types(t.sql(_TYPED))


# ---- rewriting ----
_MANIFEST = f"SELECT *, CAST(s + coalesce(sum(length(marker) - (e - s)) OVER (PARTITION BY artifact_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS o FROM ({PLACED_SQL})"


@query("replacement_manifest", f"SELECT artifact_id, s AS start_at, e AS end_at, marker, o AS output_start, CAST(o + length(marker) AS INTEGER) AS output_end FROM ({_MANIFEST})")
def replacement_manifest(t):
    rows = rewrite.manifest(_marked(t))
    return rows.select("artifact_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "marker", "output_start", "output_end")


_MASK_SQL = f"""WITH p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY artifact_id ORDER BY s), 0) AS done FROM ({PLACED_SQL})), a AS ({plain(base.PREDICATES)}),
    m AS (SELECT artifact_id, string_agg(a.text[done + 1:s] || marker, '' ORDER BY s) AS head, max(e) AS last FROM p JOIN a USING (artifact_id) GROUP BY artifact_id)
    SELECT artifact_id, head || text[last + 1:] AS masked FROM a JOIN m USING (artifact_id)"""


@query("mask_text", _MASK_SQL)
def mask_text(t):
    return rewrite.apply_replacements(t.sql(base.PREDICATES), _marked(t)).select("artifact_id", "masked")


@query("mask_text_builtin", _MASK_SQL)
def mask_text_builtin(t):
    """The same splice by built-in functions alone, for short texts."""
    parts = _marked(t).groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "marker"))).alias("parts"))
    return t.sql(base.PREDICATES).join(parts, "artifact_id").select("artifact_id", rewrite.splice(F.col("text"), F.col("parts")).alias("masked"))


@query("exact_restore", f"SELECT artifact_id, text AS restored, true AS same FROM ({plain(base.PREDICATES)})")
def exact_restore(t):
    back = rewrite.exact_restore(rewrite.apply_with_manifest(t.sql(base.PREDICATES), _marked(t)))
    return back.select("artifact_id", "restored", (F.col("restored") == F.col("text")).alias("same"))


_ANS_TOK = duck_tokens(plain(base.ANSWERS), "answer_id, case_id, text", "text", "[A-Za-z0-9_]*(?:OBF|obf)_[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+[A-Za-z0-9_]*")
_ANS = f"""WITH t AS (SELECT * FROM ({_ANS_TOK}) WHERE upper(token) LIKE 'OBF^_%' ESCAPE '^'), y AS ({plain(base.SYMBOLS)}),
    h AS (SELECT t.*, y.preferred_original FROM t LEFT JOIN y ON y.case_id = t.case_id AND upper(y.marker) = upper(token))"""


@query("answer_restore", _ANS + f""", k AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY answer_id ORDER BY s), 0) AS done FROM h WHERE preferred_original IS NOT NULL),
    g AS (SELECT answer_id, string_agg(text[done + 1:s] || preferred_original, '' ORDER BY s) AS head, max(e) AS last FROM k GROUP BY answer_id)
    SELECT a.answer_id, coalesce(head || text[last + 1:], text) AS restored FROM ({plain(base.ANSWERS)}) a LEFT JOIN g USING (answer_id)""")
def answer_restore(t):
    return rewrite.restore_answers(t.sql(base.ANSWERS), t.sql(base.SYMBOLS)).select("answer_id", "restored")


@query("unknown_markers", _ANS + " SELECT answer_id, string_agg(DISTINCT token, ',' ORDER BY token) AS markers FROM h WHERE preferred_original IS NULL AND upper(token) LIKE 'OBF^_C' || case_id || '^_%' ESCAPE '^' GROUP BY answer_id")
def unknown_markers(t):
    return rewrite.restore_answers(t.sql(base.ANSWERS), t.sql(base.SYMBOLS)).where("size(unknown) > 0").select("answer_id", F.array_join("unknown", ",").alias("markers"))


# A known compact marker, one whose checksum does not fit, one of no symbol, and words that only look like markers
_COMPACT_TEXT = "'Look at ' || lower(marker) || ', ' || {bad} || ' and OBF_C1_TBL_000Z_0' || CAST(c_custkey % 10 AS STRING) || '; x' || marker || ' obf_c' || CAST(c_custkey % 50 AS STRING) || '_more of ' || marker || '.'".replace("{bad}", "substring(marker, 1, length(marker) - 2) || CASE WHEN marker LIKE '%00' THEN '01' ELSE '00' END")
_COMPACT = f"SELECT c_custkey AS answer_id, c_custkey % 50 AS case_id, marker, preferred_original, {_COMPACT_TEXT} AS text FROM {{customer}} JOIN markers ON case_id = c_custkey % 50 AND entity_type = 'table' AND sequence = c_nationkey + 1"


@query("compact_restore", f"""WITH names AS ({plain(base.SYMBOLS)}), markers AS (SELECT m.*, n.preferred_original FROM ({_SHORT}) m JOIN names n USING (case_id, entity_type, sequence)), a AS ({plain(_COMPACT)})
    SELECT answer_id, replace(replace(text, lower(marker), preferred_original), ' of ' || marker || '.', ' of ' || preferred_original || '.') AS restored, 2 AS n_restored,
        array_to_string(list_sort([substring(marker, 1, length(marker) - 2) || CASE WHEN marker LIKE '%00' THEN '01' ELSE '00' END, 'OBF_C1_TBL_000Z_0' || answer_id % 10, 'obf_c' || case_id || '_more']), ',') AS unknown FROM a""")
def compact_restore(t):
    """Compact markers in answers, restored where symbol and checksum agree."""
    known = t.sql(base.SYMBOLS).withColumn("marker", symbols.short_marker(F.concat(F.lit("C"), F.col("case_id")), F.col("entity_type"), F.col("sequence")))
    known.createOrReplaceTempView("markers")
    try:
        asked = t.sql(_COMPACT)
    finally:
        t.spark.catalog.dropTempView("markers")
    return rewrite.restore_compact(asked.select("answer_id", "case_id", "text"), known).select("answer_id", "restored", "n_restored", F.array_join("unknown", ",").alias("unknown"))


@query("marker_counts", f"SELECT answer_id, CAST(len(regexp_extract_all(text, '(?i)OBF_[A-Z0-9]+(?:_[A-Z0-9]+)+')) AS INTEGER) AS n FROM ({plain(base.ANSWERS)})")
def marker_counts(t):
    return t.sql(base.ANSWERS).select("answer_id", F.regexp_count("text", F.lit("(?i)OBF_[A-Z0-9]+(?:_[A-Z0-9]+)+")).alias("n"))


_WORDMAP = f"""SELECT case_id, upper(preferred_original) AS word, arg_min(marker, ord * 100000 + sequence) AS marker, arg_min(entity_type, ord * 100000 + sequence) AS entity_type FROM (
    SELECT *, CASE entity_type WHEN 'table' THEN 1 ELSE 4 END AS ord FROM ({plain(base.SYMBOLS)})) WHERE length(preferred_original) >= 3 AND regexp_matches(preferred_original, '^{WORD}$') GROUP BY ALL"""
_Q_HITS = f"SELECT q.*, w.marker, w.entity_type, w.word FROM ({duck_tokens(plain(base.QUESTIONS), 'question_id, case_id, text', 'text', WORD)}) q JOIN ({_WORDMAP}) w ON w.case_id = q.case_id AND w.word = upper(token)"


@query("question_mask", f"""WITH k AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY question_id ORDER BY s), 0) AS done FROM ({_Q_HITS})),
    g AS (SELECT question_id, string_agg(text[done + 1:s] || marker, '' ORDER BY s) AS head, max(e) AS last FROM k GROUP BY question_id)
    SELECT q.question_id, coalesce(head || text[last + 1:], text) AS masked FROM ({plain(base.QUESTIONS)}) q LEFT JOIN g USING (question_id)""")
def question_mask(t):
    return rewrite.mask_questions(t.sql(base.QUESTIONS), t.sql(base.SYMBOLS)).select("question_id", "masked")


_ASKED = f"SELECT question_id, case_id, string_agg(piece, '' ORDER BY i) AS text FROM ({plain(base.NAMED_PIECES)}) GROUP BY ALL"


def _asked(t):
    return t.sql(f"SELECT question_id, case_id, array_join(transform(array_sort(collect_list(struct(i, piece))), x -> x.piece), '') AS text FROM ({base.NAMED_PIECES}) GROUP BY question_id, case_id")


@query("question_mask_names", f"""SELECT question_id, string_agg(CASE WHEN code IS NULL THEN piece ELSE 'OBF_C' || case_id || '_' || code || '_' || lpad(CAST(sequence AS VARCHAR), 4, '0') || '_AB' END, '' ORDER BY i) AS masked FROM ({plain(base.NAMED_PIECES)}) GROUP BY question_id""")
def question_mask_names(t):
    """Names that are no single word: quoted, spaced, hyphenated, one within another."""
    return rewrite.mask_questions(_asked(t), t.sql(base.NAMED_SYMBOLS)).select("question_id", "masked")


@query("leak_check_names", f"""WITH p AS (SELECT *, sum(length(piece)) OVER (PARTITION BY question_id ORDER BY i) - length(piece) AS s FROM ({plain(base.NAMED_PIECES)}))
    SELECT question_id, entity_type, upper(piece) AS word, CAST(min(s) AS INTEGER) AS start_at FROM p WHERE entity_type IS NOT NULL GROUP BY ALL""")
def leak_check_names(t):
    """The same names by the leak check, in blocks that meet the texts by case."""
    return rewrite.leak_findings(_asked(t), t.sql(base.NAMED_SYMBOLS), "question_id", text="text", max_broadcast=0).select("question_id", "entity_type", "word", F.col("start").alias("start_at"))


@query("leak_check", f"SELECT question_id, entity_type, word, min(s) AS start_at, 'possible_unmasked_symbol' AS code FROM ({_Q_HITS}) GROUP BY ALL")
def leak_check(t):
    rows = rewrite.leak_findings(t.sql(base.QUESTIONS), t.sql(base.SYMBOLS), "question_id", text="text")
    return rows.withColumnRenamed("start", "start_at")


@query("marker_collisions", f"SELECT answer_id, 'input_marker_collision' AS code FROM ({plain(base.ANSWERS)}) WHERE contains(upper(text), 'OBF_C' || case_id || '_')")
def marker_collisions(t):
    art = t.sql(base.ANSWERS)
    cases = art.select("case_id", F.concat(F.lit("C"), F.col("case_id")).alias("prefix")).distinct()
    return rewrite.collision_findings(art, cases, "answer_id")


@query("validation_status", f"""WITH f AS (SELECT question_id, count(DISTINCT entity_type || word) AS n FROM ({_Q_HITS}) GROUP BY question_id)
    SELECT q.question_id, CASE WHEN q.question_id % 5 = 0 THEN 'pending' WHEN coalesce(n, 0) > 0 THEN 'warning' ELSE 'ok' END AS status FROM ({plain(base.QUESTIONS)}) q LEFT JOIN f USING (question_id)""")
def validation_status(t):
    q = t.sql(base.QUESTIONS)
    n = rewrite.leak_findings(q, t.sql(base.SYMBOLS), "question_id", "case_id", "text").groupBy("question_id").agg(F.count("*").alias("n"))
    return q.join(n, "question_id", "left").select("question_id", rewrite.validation_status(F.coalesce("n", F.lit(0)), F.col("question_id") % 5 != 0).alias("status"))


@query("pseudonymise")
def pseudonymise(t):
    """The whole engine over predicate texts: masked text and whether it restores exactly."""
    art = t.sql(base.PREDICATES)
    cases = art.select("case_id").distinct().withColumn("prefix", symbols.case_prefix(F.col("case_id")))
    out = engine.pseudonymise(art, cases)
    back = rewrite.exact_restore(out.masked)
    return back.select("artifact_id", "case_id", "kind", "masked", (F.col("restored") == F.col("text")).alias("restores"))


# The number of an operation, at the head of a line, is no literal
_TOLD = f"SELECT x.* FROM ({SPAN_SQL}) x JOIN ({plain(base.PREDICATES)}) p ON p.artifact_id = x.artifact_id WHERE x.s > 0 AND p.text[x.s] <> chr(10)"


@query("engine_masks", _MASK_SQL.replace(SPAN_SQL, _TOLD))
def engine_masks(t):
    """The whole engine over predicate texts: readers, registry, markers and splice, against SQL that finds and numbers the names by itself; check digits left out."""
    art = t.sql(base.PREDICATES)
    cases = art.select("case_id").distinct().withColumn("prefix", F.concat(F.lit("C"), "case_id"))
    out = engine.pseudonymise(art, cases)
    return out.masked.select("artifact_id", F.regexp_replace("masked", "(OBF_C[0-9]+_[A-Z]+_[0-9]{4,})_[0-9A-F]{2}", "$1").alias("masked"))


@query("engine_odd_rows", f"""WITH a AS ({plain(base.ODD_ARTIFACTS)}), c AS (SELECT case_id, min(prefix) = max(prefix) AS sure FROM ({plain(base.ODD_CASES)}) GROUP BY case_id)
    SELECT artifact_id, a.case_id, count(*) AS n, CASE WHEN coalesce(sure, false) THEN 0 ELSE count(*) END AS n_withheld, CAST(0 AS BIGINT) AS n_readable, true AS restores
    FROM a LEFT JOIN c ON c.case_id = a.case_id GROUP BY artifact_id, a.case_id, sure""")
def engine_odd_rows(t):
    """Nothing goes out readable: null and missing cases, cases of two prefixes, artifact ids in several cases, rows that come twice."""
    out = engine.pseudonymise(t.sql(base.ODD_ARTIFACTS), t.sql(base.ODD_CASES))
    back = rewrite.exact_restore(out.masked)
    readable = F.contains("masked", F.lit("O_CUSTKEY")) | F.contains("masked", F.lit("MY_FN"))
    return back.groupBy("artifact_id", "case_id").agg(F.count("*").alias("n"), F.count_if(F.col("masked") == engine.WITHHELD).alias("n_withheld"), F.count_if(readable).alias("n_readable"), F.every(F.col("restored") == F.col("text")).alias("restores"))


@query("parse_artifacts")
def parse_artifacts(t):
    """Entity counts of mixed artifacts by the readers of their kinds."""
    rows = detection.with_parsed(t.sql(base.MIXED)).select("parsed.kind", F.explode("parsed.spans").alias("s"))
    return rows.groupBy("kind", "s.entity_type").agg(F.count("*").alias("n"))


def _pieced(t):
    """The texts whose pieces are ``base.PIECES``."""
    return t.sql(f"SELECT artifact_id, kind, array_join(transform(array_sort(collect_list(struct(i, piece))), x -> x.piece), '') AS text FROM ({base.PIECES}) GROUP BY artifact_id, kind")


@query("reader_spans", f"""SELECT artifact_id, kind, CAST(e - length(piece) AS INTEGER) AS start_at, CAST(e AS INTEGER) AS end_at, piece AS original, entity_type
    FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY artifact_id ORDER BY i) AS e FROM ({plain(base.PIECES)})) WHERE entity_type IS NOT NULL""")
def reader_spans(t):
    """What the engine's readers find in texts of every kind: places, lexemes and types, against the pieces the texts are made of."""
    found = detection.with_parsed(_pieced(t)).select("artifact_id", F.col("parsed.kind").alias("kind"), F.explode("parsed.spans").alias("s"))
    return found.select("artifact_id", "kind", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.original").alias("original"), F.col("s.entity_type").alias("entity_type"))


@query("masked_texts", f"""SELECT artifact_id, string_agg(CASE WHEN entity_type IS NULL THEN piece ELSE '<' || entity_type || '>' END, '' ORDER BY i) AS masked, true AS restores FROM ({plain(base.PIECES)}) GROUP BY artifact_id""")
def masked_texts(t):
    """Every text through the whole engine: markers by type in place of what the readers find, and the exact way back."""
    art = _pieced(t).select(F.col("artifact_id").alias("case_id"), "artifact_id", F.lit(0).alias("position"), "text")
    art = written(art)
    cases = art.select("case_id").withColumn("prefix", F.lit("AB2"))
    out = engine.pseudonymise(art, cases)
    back = rewrite.exact_restore(out.masked)
    mark, kinds = "OBF_AB2_([A-Z]+)_[0-9]{4,}_[0-9A-F]{2}", F.create_map(*(F.lit(x) for kind, code in CODE.items() for x in (code, f"<{kind}>")))
    codes = F.regexp_extract_all("masked", F.lit(mark), F.lit(1))
    shown = F.array_join(F.zip_with(F.split("masked", mark, -1), codes, lambda gap, code: F.concat(gap, F.when(code.isNull(), "").otherwise(F.coalesce(kinds[code], code)))), "")
    return back.select("artifact_id", shown.alias("masked"), (F.col("restored") == F.col("text")).alias("restores"))


@query("sql_span_rows", SQL["reader_spans"])
def sql_span_rows(t):
    """The same spans by the table function, laterally, in SQL."""
    register(t.spark)
    return t.spark.sql("SELECT artifact_id, kind, s.start AS start_at, s.end AS end_at, s.original, s.entity_type FROM {texts}, LATERAL veil_spans(text) s", texts=_pieced(t))


@query("sql_obfuscate", f"SELECT artifact_id, masked FROM ({SQL['masked_texts']})")
def sql_obfuscate(t):
    """Texts masked in SQL by a mapping that SQL builds from their spans."""
    register(t.spark)
    return t.spark.sql(
        "SELECT artifact_id, veil_obfuscate(text, map_from_entries(transform(veil_keys(text), k -> struct(k.entity_type || ':' || k.canonical, '<' || k.entity_type || '>')))) AS masked FROM {texts}",
        texts=_pieced(t),
    )


@query("sql_restore", SQL["answer_restore"])
def sql_restore(t):
    """Answers restored in SQL by their case's mapping."""
    register(t.spark)
    return t.spark.sql(
        "WITH m AS (SELECT case_id, map_from_entries(collect_set(struct(marker, preferred_original))) AS mapping FROM {symbols} GROUP BY case_id) SELECT answer_id, veil_restore(text, mapping) AS restored FROM {answers} a LEFT JOIN m ON m.case_id = a.case_id",
        symbols=t.sql(base.SYMBOLS),
        answers=t.sql(base.ANSWERS),
    )


# ---- SQL identity ----
_STATEMENTS = "SELECT o_orderkey AS artifact_id, o_custkey % 50 AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'select  *' || chr(10) || '  from orders where o_custkey = ' ELSE 'SELECT * FROM orders WHERE o_custkey = ' END || CAST(o_custkey AS STRING) || ' and note = ' || chr(39) || CASE WHEN o_orderkey % 5 = 0 THEN 'it' || chr(39) || chr(39) || 's Late' WHEN o_orderkey % 5 = 1 THEN 'LATE' ELSE 'late' END || chr(39) || CASE WHEN o_orderkey % 3 = 0 THEN ' -- ' || o_orderpriority WHEN o_orderkey % 3 = 1 THEN ' /* x */;' ELSE '' END AS text FROM {orders}"
_Q = lambda pattern: pattern.replace("'", "''")
_NORM = f"array_to_string(list_transform(list_filter(regexp_extract_all(text, '{_Q(sql_text.IDENTITY_TOKEN)}'), lambda x: NOT regexp_matches(x, '{_Q(sql_text._LEFT_OUT)}')), lambda x: CASE WHEN regexp_matches(x, '{_Q(sql_text._VERBATIM)}') THEN x ELSE upper(x) END), chr(31))"
_normal = sql_text.statement_identity


@query("sql_fingerprint", f"SELECT artifact_id, {_NORM} AS normalized, sha256({_NORM}) AS fingerprint FROM ({plain(_STATEMENTS)})")
def sql_fingerprint(t):
    n = t.sql(_STATEMENTS).select("artifact_id", _normal(F.col("text")).alias("normalized"))
    return n.withColumn("fingerprint", F.sha2("normalized", 256))


@query("sql_identity", f"SELECT case_id, count(*) AS n, count(DISTINCT f) AS n_statements, arg_min(f, artifact_id) AS fingerprint FROM (SELECT *, sha256({_NORM}) AS f FROM ({plain(_STATEMENTS)})) GROUP BY case_id")
def sql_identity(t):
    f = t.sql(_STATEMENTS).withColumn("f", F.sha2(_normal(F.col("text")), 256))
    return f.groupBy("case_id").agg(F.count("*").alias("n"), F.countDistinct("f").alias("n_statements"), F.min_by("f", "artifact_id").alias("fingerprint"))


_TAIL = "AND\x1fO_ORDERKEY\x1f>\x1f1\x1fAND\x1fX\x1f=\x1f2"


@query("sql_prefix_compatible", f"""SELECT artifact_id, a = b OR (len(x) >= 12 AND y[1:len(x) - 1] = x[1:len(x) - 1] AND starts_with(y[len(x)], x[len(x)])) OR (length(a) >= 80 AND starts_with(b, a)) AS compatible FROM (
    SELECT *, string_split(a, chr(31)) AS x, string_split(b, chr(31)) AS y FROM (SELECT artifact_id, CASE WHEN artifact_id % 2 = 0 THEN {_NORM}[:35 + artifact_id % 20] ELSE {_NORM} END AS a, {_NORM} || chr(31) || '{_TAIL}' AS b FROM ({plain(_STATEMENTS)})))""")
def sql_prefix_compatible(t):
    """A shown statement is compatible with the known one if it is equal, or cut off: tokens or a long prefix agree. By the casebook's own rule."""
    n = t.sql(_STATEMENTS).withColumn("n", _normal(F.col("text")))
    ab = n.select("artifact_id", F.expr("CASE WHEN artifact_id % 2 = 0 THEN substring(n, 1, cast(35 + artifact_id % 20 as int)) ELSE n END").alias("a"), F.concat("n", F.lit("\x1f" + _TAIL)).alias("b"))
    rule = F.arrow_udf(lambda a, b: pa.array([casebook.compatible(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_()), "boolean")
    return ab.select("artifact_id", rule("a", "b").alias("compatible"))


# Statements of the cases (customers), and shown ones of orders: as known, in other spaces, carried on, cut anywhere, or of no case
_CASE_TEXT = "'SELECT n.n_name, c.c_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey = ' || CAST({key} AS STRING) || CASE WHEN {key} % 2 = 0 THEN ' AND c.c_acctbal > ' || CAST({key} % 7 AS STRING) || ' ORDER BY 1' ELSE '' END"
_CASE_STATEMENTS = f"SELECT c_custkey AS case_id, {_CASE_TEXT.replace('{key}', 'c_custkey')} AS text FROM {{customer}} WHERE c_custkey % 3 <> 0"
_SHOWN_STATEMENTS = f"""SELECT artifact_id, CASE artifact_id % 5 WHEN 0 THEN text WHEN 1 THEN lower(replace(text, ' ', chr(10))) || ' -- as sent' WHEN 2 THEN text || ' AND c.c_phone = ' || chr(39) || 'x' || chr(39) WHEN 3 THEN substring(text, 1, CAST(60 + artifact_id % 90 AS INT)) ELSE substring(text, 1, CAST(artifact_id % 60 AS INT)) END AS text
    FROM (SELECT o_orderkey AS artifact_id, {_CASE_TEXT.replace('{key}', 'o_custkey')} AS text FROM {{orders}}) s"""
_TOKENED = lambda q: f"""SELECT *, array_to_string(tk, chr(31)) AS tokens, len(tk) AS n, array_to_string(list_transform(tk, lambda x: x[3:]), '') AS raw FROM (SELECT * EXCLUDE (text), list_transform(list_filter(string_split({_NORM}, chr(31)), lambda x: x <> ''), lambda x:
    CASE WHEN x[1] = chr(39) THEN 'S:' WHEN regexp_full_match(x, '[0-9]+([.][0-9]+)?') THEN 'N:' WHEN regexp_matches(x, '^[A-Za-z0-9_$#]') THEN 'W:' ELSE 'P:' END || x) AS tk FROM ({plain(q)}))"""  # noqa: E731


@query("sql_continuations", f"""WITH k AS ({_TOKENED(_CASE_STATEMENTS)}), s AS ({_TOKENED(_SHOWN_STATEMENTS)}),
    d AS (SELECT DISTINCT tokens, n, raw FROM s WHERE n > 0),
    p AS (SELECT d.tokens, k.case_id, 1 AS form, k.tokens AS key, k.tokens = d.tokens AS same, length(k.tokens) < length(d.tokens) AS under FROM d JOIN k ON k.tokens = d.tokens OR (k.n >= 12 AND starts_with(d.tokens, k.tokens)) OR (d.n >= 12 AND starts_with(k.tokens, d.tokens))
        UNION ALL SELECT d.tokens, k.case_id, 2, k.raw, k.raw = d.raw, length(k.raw) < length(d.raw) FROM d JOIN k ON (length(k.raw) >= 80 AND starts_with(d.raw, k.raw)) OR (length(d.raw) >= 80 AND starts_with(k.raw, d.raw))),
    b AS (SELECT *, CASE WHEN same THEN 'same' WHEN under THEN 'continues' ELSE 'cut_off' END AS how FROM p
        QUALIFY row_number() OVER (PARTITION BY tokens ORDER BY form, NOT same, NOT under, CASE WHEN under THEN -length(key) ELSE 0 END, key, case_id) = 1)
    SELECT artifact_id, b.case_id AS matched_case, b.how AS match FROM s LEFT JOIN b USING (tokens)""")
def sql_continuations(t):
    """The case that each shown statement belongs to: the same, carried on, or cut off."""
    return statements.match_statements(t.sql(_SHOWN_STATEMENTS), t.sql(_CASE_STATEMENTS)).select("artifact_id", "matched_case", "match")


_HINTED = "SELECT o_orderkey AS artifact_id, 'select /*+ FULL(o) INDEX(o IX_' || CAST(o_custkey % 30 AS STRING) || ') MATERIALIZE */ 1 from t /* c' || CAST(o_custkey AS STRING) || ' */' AS text FROM {orders}"


@query("hint_words", f"""SELECT artifact_id, w, CAST(i AS INTEGER) AS i, CASE WHEN upper(w) IN ({', '.join(repr(x) for x in sorted(HINT_WORDS))}) THEN 'kept' ELSE 'identifier' END AS treatment FROM (
    SELECT artifact_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT artifact_id, regexp_extract_all(regexp_extract(text, '/[*][+]([^*]*)[*]/', 1), '[A-Za-z_][A-Za-z0-9_]*') AS w FROM ({plain(_HINTED)})))""")
def hint_words(t):
    """The words of a hint; those that the SQL reader marks are identifiers, the others stay. Each text is looked at by itself: no row leaves its task."""
    hint = "/[*][+]([^*]*)[*]/"
    read = detection.with_parsed(spread(t.sql(_HINTED)).withColumn("kind", F.lit("sql")), kind_col="kind")
    body = F.regexp_extract("text", hint, 1).alias("body")
    marks = F.transform("parsed.spans", lambda s: s["start"] - F.regexp_instr("text", F.lit(hint)) - 2).alias("marks")  # places in the body
    words = spans.token_rows(read.select("artifact_id", body, marks), ["artifact_id", "marks"], "body", "[A-Za-z_][A-Za-z0-9_]*")
    return words.select("artifact_id", F.col("token").alias("w"), "i", F.when(F.array_contains("marks", F.col("start")), "identifier").otherwise("kept").alias("treatment"))


@query("comment_bodies", f"SELECT artifact_id, trim(regexp_extract(text, '/[*] ([^*+]*)[*]/', 1)) AS body FROM ({plain(_HINTED)})")
def comment_bodies(t):
    """Comments that the SQL reader marks."""
    return _marked_by(t.sql(_HINTED), "sql").where("entity_type = 'comment'").select("artifact_id", F.col("original").alias("body"))


@query("unique_texts", f"SELECT sha256(text) AS h, count(*) AS n, min(artifact_id) AS first_id FROM (SELECT artifact_id % 100 AS k, artifact_id, 'select ' || CAST(case_id AS VARCHAR) AS text FROM ({plain(_STATEMENTS)})) GROUP BY h")
def unique_texts(t):
    """Equal texts once, by content hash: the parse runs on these."""
    rows = t.sql(_STATEMENTS).select("artifact_id", F.concat(F.lit("select "), F.col("case_id").cast("string")).alias("text"))
    return rows.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.min("artifact_id").alias("first_id"))


# ---- answers ----
@query("html_to_markdown")
def html_to_markdown(t):
    return t.pages.select("page_id", answers.html_markdown("html").alias("markdown"))


_TSV = "SELECT c_custkey, 'a' || chr(9) || 'b' || chr(13) || chr(10) || CAST(c_custkey AS STRING) || chr(9) || c_name || chr(10) || 'tail' AS text FROM {customer}"


@query("tsv_to_markdown", f"SELECT c_custkey, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_custkey || ' | ' || c_name || ' |' || chr(10) || 'tail' AS markdown FROM customer")
def tsv_to_markdown(t):
    return t.sql(_TSV).select("c_custkey", answers.plain_markdown("text").alias("markdown"))


@query("newline_normalise", f"SELECT c_custkey, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM ({plain(_TSV)})")
def newline_normalise(t):
    return t.sql(_TSV).select("c_custkey", answers.normalise_newlines(F.col("text")).alias("text"))


@query("restored_html")
def restored_html(t):
    """Markdown answers as safe HTML, markers restored after parsing."""
    show = F.pandas_udf(_show_answers, "string")
    return t.sql(base.ANSWERS).select("answer_id", show(F.concat(F.lit("# "), "text")).alias("html"))


def _show_answers(rows: pd.Series) -> pd.Series:
    return rows.map(lambda x: answers.restored_html(x, {"OBF_C1_TBL_0001_AB": "<ALGERIA>"}))
