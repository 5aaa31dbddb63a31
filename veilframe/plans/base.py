"""Registration of queries with their SQL twins, and the synthetic artifacts that both sides build from the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


class Tables:
    """The input tables by name, and SQL over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, **args) -> DataFrame:
        """SQL whose tables are named in braces, read from this folder."""
        import re

        used = {t: getattr(self, t) for t in TABLES if f"{{{t}}}" in text}
        text = re.sub(r"[{}]", lambda m: m[0] * 2, text)  # other braces are text
        for t in used:
            text = text.replace(f"{{{{{t}}}}}", f"{{{t}}}")
        return self.spark.sql(text, args=args or None, **used)


def query(name: str, sql: str | None = None):
    """Register f(Tables) -> DataFrame under a name, with DuckDB SQL for the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def same(name: str, text: str):
    """A query whose SQL both engines run: tables in braces."""
    QUERIES[name] = lambda spark, sf_dir: Tables(spark, sf_dir).sql(text)
    SQL[name] = plain(text)


def plain(text: str) -> str:
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def duck_tokens(source: str, keys: str, text: str, pattern: str) -> str:
    """token_rows in DuckDB: keys, i, token, s (start), e (end)."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT {keys}, CAST(i AS INTEGER) AS i, token, CAST(e - length(token) AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM (
        SELECT {keys}, i, token, sum(length(gap) + length(token)) OVER (PARTITION BY {keys} ORDER BY i) AS e FROM (
            SELECT {keys}, unnest(tok) AS token, unnest(gap[1:len(tok)]) AS gap, unnest(range(len(tok))) AS i FROM (
                SELECT {keys}, regexp_extract_all({text}, '{pattern}') AS tok, regexp_split_to_array({text}, '{pattern}') AS gap FROM ({source}))))"""


# Predicate texts of orders: 50 cases
PREDICATES = """SELECT o_orderkey AS artifact_id, o_custkey % 50 AS case_id, o_orderkey AS position,
    '1 - access("O"."O_CUSTKEY"=' || CAST(o_custkey AS STRING) || ' AND "O"."O_ORDERSTATUS"=' || chr(39) || o_orderstatus || chr(39) || ')' || chr(10)
    || '2 - filter("C"@"SEL$1"."C_NATIONKEY"=:B' || CAST(o_custkey % 5 AS STRING) || ' AND "O"."O_ORDERPRIORITY"<>' || chr(39) || o_orderpriority || chr(39)
    || ' AND MY_FN("O"."O_TOTAL")>' || CAST(o_orderkey % 1000 AS STRING) || '.5)' AS text FROM {orders}"""

# One artifact of each kind and plain prose, by customer
MIXED = """SELECT c_custkey AS artifact_id, CASE c_custkey % 7
    WHEN 0 THEN 'select c_name from customer where c_custkey = ' || CAST(c_custkey AS STRING)
    WHEN 1 THEN '-- note' || chr(10) || '/* more */ (WITH x AS (SELECT 1 FROM dual) SELECT * FROM x)'
    WHEN 2 THEN 'SQL_ID abc' || CAST(c_custkey AS STRING) || ', child number 0' || chr(10) || 'Plan hash value: ' || CAST(c_custkey * 7 AS STRING) || chr(10) || '| Id | Operation |'
    WHEN 3 THEN 'SQL Monitoring Report' || chr(10) || 'Global Information' || chr(10) || ' Status : DONE'
    WHEN 4 THEN '  /*+ BEGIN_OUTLINE_DATA FULL(@"SEL$1") END_OUTLINE_DATA */'
    WHEN 5 THEN '   3 - filter("C"."C_ACCTBAL">' || CAST(c_custkey AS STRING) || ')'
    ELSE 'please explain why ' || c_name || ' is slow' END AS text FROM {customer}"""

# Plan tables of three rows by part
PLANS = """SELECT p_partkey AS artifact_id, '| Id  | Operation                    | Name        | Rows |' || chr(10)
    || '|   0 | SELECT STATEMENT             |             |      |' || chr(10)
    || '|*  1 |  TABLE ACCESS BY INDEX ROWID | T_' || CAST(p_partkey % 97 AS STRING) || ' | ' || CAST(p_size AS STRING) || ' |' || chr(10)
    || '|*  2 |   INDEX RANGE SCAN           | S.IX_' || CAST(p_partkey AS STRING) || ' | 17 |' || chr(10) AS text FROM {part}"""

# Monitor reports' global section by supplier
GLOBALS = """SELECT s_suppkey AS artifact_id, ' Status              :  DONE' || chr(10) || ' Session             :  ' || s_name || ' (' || CAST(s_suppkey AS STRING) || ':7)' || chr(10)
    || ' SQL ID              :  q' || CAST(s_suppkey * 31 AS STRING) || chr(10) || ' Duration            :  ' || CAST(s_suppkey % 60 AS STRING) || 's' || chr(10)
    || ' Service             :  svc_' || CAST(s_nationkey AS STRING) || chr(10) || ' Mystery Field       :  m' || CAST(s_suppkey AS STRING) || chr(10) || ' Host                :  -' AS text FROM {supplier}"""

# Texts of every kind in pieces, each with the type that a reader must give it (null: it stays): artifact_id, kind, i, piece, entity_type.
# The pieces of an order's text joined are the text; their running lengths are the expected spans.
_PIECES = (
    ("sql", ["select ", ("l", "alias"), ".", ("lane_@c", "column"), ", count(*) from ", ("depot_@m", "schema"), ".", ("lanes_@c", "table"), " ", ("l", "alias"), " where ", ("l", "alias"), ".", ("state", "column"), " = '", ("@p", "string_literal"), "' and ", ("l", "alias"), ".", ("load_kg", "column"), " > ", ("@k", "number_literal")]),
    ("sql", ["select /*+ FULL(", ("w", "alias"), ") ", ("CRATE_@m", "identifier"), " */ upper(", ("w", "alias"), ".", ("berth", "column"), ") as ", ("code_@c", "alias"), ", ", ("pick_lane", "function"), "(", ("w", "alias"), ".", ("dock", "column"), "), ", ("q'[kept 'aside' @m]'", "string_literal"), " from ", ("parcels_@c", "table"), " ", ("w", "alias"), " join ", ("tides_@m", "table"), "@", ("harbor_link", "db_link"), ".", ("dock_net", "db_link"), " ", ("r", "alias"), " on ", ("r", "alias"), ".", ("tide_id", "column"), " = ", ("w", "alias"), ".", ("tide_no", "column"), " -- ", ("night crew @c", "comment"), "@n where ", ("w", "alias"), ".", ("weight_kg", "column"), " between ", ("12.75", "number_literal"), " and :", ("max_@m", "bind"), " and ", ("w", "alias"), '."', ("Gate @c", "column"), '" like N\'', ("кран%", "string_literal"), "' /* ", ("holds @p", "comment"), " */ order by ", ("code_@c", "alias")]),
    ("sql", ["insert into ", ("depot", "schema"), ".", ("log_@c", "table"), " (", ("parcel_no", "column"), ", ", ("remark", "column"), ") values (", ("@k", "number_literal"), ", '", ("@p", "string_literal"), "')"]),
    ("sql", ["merge into ", ("lanes_@c", "table"), " ", ("l", "alias"), " using ", ("boats", "table"), " ", ("b", "alias"), " on (", ("l", "alias"), ".", ("lane_id", "column"), " = ", ("b", "alias"), ".", ("boat_lane", "column"), ") when matched then update set ", ("l", "alias"), ".", ("load_kg", "column"), " = ", ("@k", "number_literal")]),
    ("sql", [("begin null; end;", "fragment")]),
    ("predicates", ['   1 - access("', ("P", "alias"), '"."', ("LANE_@c", "column"), '"="', ("L", "alias"), '"."', ("LANE_ID", "column"), '")@n   2 - filter("', ("P", "alias"), '"."', ("STATE", "column"), "\"='", ("@p", "string_literal"), "' AND \"", ("P", "alias"), '"."', ("KG", "column"), '">', ("@k", "number_literal"), ")"]),
    ("outline", ['/*+@n  BEGIN_OUTLINE_DATA@n  FULL(@"', ("SEL$@m", "query_block"), '" "', ("L@c", "identifier"), '"@"', ("SEL$@m", "query_block"), '")@n  END_OUTLINE_DATA@n*/']),
    ("xplan", ["Plan hash value: ", ("@k", "plan_hash"), "@n@n| Id | Operation | Name | Rows |@n| 1 | TABLE ACCESS FULL | ", ("LANES_@c", "table"), " | 77 |@n| 2 | INDEX RANGE SCAN | ", ("DEPOT_@m", "schema"), ".", ("IX_@c", "index"), " | 9 |@n| 3 | VIEW | ", ("V_@m", "view"), " | 8 |@n"]),
    ("xplan", ["SQL_ID  ", ("a@kz", "sql_id"), ", child number ", ("@m", "execution_id"), "@n-------------------------------------@ndelete from ", ("gates_@c", "table"), " where ", ("kind", "column"), " = '", ("@p", "string_literal"), "'@n@nPlan hash value: ", ("@k", "plan_hash"), "@n@nQuery Block Name / Object Alias (identified by operation id):@n-----@n   1 - ", ("DEL$1", "query_block"), " / ", ("G", "alias"), "@", ("DEL$1", "query_block"), '@n@nOutline Data@n-----@n  /*+@n  BEGIN_OUTLINE_DATA@n  FULL(@"', ("DEL$1", "query_block"), '" "', ("G", "alias"), '"@"', ("DEL$1", "query_block"), '")@n  END_OUTLINE_DATA@n  */@n@nPredicate Information (identified by operation id):@n-----@n   1 - filter(', ("TIDE_OK", "function"), '("', ("G", "alias"), '"."', ("DOCK", "column"), '")>:', ("B@m", "bind"), ')@n@nColumn Projection Information (identified by operation id):@n-----@n   1 - "', ("G", "alias"), '"."', ("LOAD_KG", "column"), '"[NUMBER,22]@n@nPeeked Binds (identified by position):@n-----@n   1 - :', ("B@m", "bind"), " (NUMBER): ", ("17.5", "number_literal"), "@n   2 - :", ("C@m", "bind"), " (VARCHAR2(12)): '", ("spring @c", "string_literal"), "'@n@nRemote SQL Information (identified by operation id):@n-----@nselect ", ("depth", "column"), " from ", ("tides_@m", "table"), '@n@nNote@n-----@n   - dynamic statistics used: dynamic sampling (level=2)@n   - SQL plan baseline "', ("BASE_@c", "identifier"), '" used for this statement@n   - ', ("tell the foreman of @m", "fragment"), "@n"]),
    ("xplan", ["Plan hash value: ", ("@k", "plan_hash"), "@n@nCrane Remarks@n-------------@n", ("the big one squeaks @c", "fragment"), "@n"]),
    ("sql_monitor", ["SQL Monitoring Report@n@nGlobal Information@n------------------------------@n Status : DONE@n Session : ", ("USER_@c (@m:7)", "session_id"), "@n SQL ID : ", ("q@c", "sql_id"), "@n Service : ", ("svc_@m", "service"), "@n Ferry : ", ("boat @c", "fragment"), "@n Duration : 5s@n"]),
    ("sql_monitor", ["SQL Monitoring Report@n@nSQL Text@n------------------------------@nupdate ", ("gates_@c", "table"), " set ", ("kind", "column"), " = '", ("@p", "string_literal"), "'@n@nGlobal Information@n------------------------------@n Program : ", ("crane_@m", "program"), "@n Module/Action : ", ("load/@c", "module"), "@n@nBinds@n=====@n| Name | Position | Value |@n=====@n| :", ("CUT@m", "bind"), " | 1 | ", ("@k", "number_literal"), " |@n=====@n@nSQL Plan Monitoring Details (Plan Hash Value=", ("7@k", "plan_hash"), ")@n=====@n| Id | Operation | Name | Rows |@n=====@n|  1 | INDEX RANGE SCAN | ", ("IX_@c", "index"), " | 5 |@n=====@n@nParallel Execution Details (DOP=6)@n=====@n| Name | Server# | Username | Wait |@n=====@n| p004 | ", ("31:@k", "session_id"), " | ", ("DOCKER_@c", "user"), " | 0.75 |@n=====@n"]),
    ("unknown", [("why is lane @c slow", "fragment")]),
    # names typed by scope: nested queries and WITH, arguments that hold a FROM, aliases without AS, sorted by, other literals
    ("sql", ["with ", ("late_@m", "alias"), " (", ("k", "alias"), ", ", ("n", "alias"), ") as (select ", ("gate_id", "column"), ", count(*) from ", ("depot", "schema"), ".", ("gates_@c", "table"), " ", ("g", "alias"), " where exists (select ", ("@k", "number_literal"), " from ", ("crews", "table"), " ", ("w", "alias"), " where ", ("w", "alias"), ".", ("gate_no", "column"), " = ", ("g", "alias"), ".", ("gate_id", "column"), ") group by ", ("gate_id", "column"), ") select extract(year from ", ("opened_@m", "column"), ") ", ("yr", "alias"), ", trim(both '", ("x", "string_literal"), "' from ", ("label", "column"), ") ", ("tag_@c", "alias"), ", case when ", ("n", "column"), " > ", ("5", "number_literal"), " then ", ("n", "column"), " end ", ("busy", "alias"), " from ", ("late_@m", "alias"), " join (select ", "*", " from ", ("tides", "table"), ") ", ("s", "alias"), " using (", ("k", "column"), ") order by ", ("tag_@c", "alias"), ", ", ("yr", "alias"), " desc"]),
    ("sql", ["create unique index ", ("depot", "schema"), ".", ("ix_@c", "index"), " on ", ("depot", "schema"), ".", ("lanes_@m", "table"), " (", ("lane_no", "column"), ", upper(", ("label", "column"), "))"]),
    ("sql", ["create table ", ("depot", "schema"), ".", ("berths_@c", "table"), " (", ("berth_no", "column"), " number, ", ("dock_@m", "column"), " varchar2(", ("@k", "number_literal"), ") not null, constraint ", ("pk_berth", "constraint"), " primary key (", ("berth_no", "column"), "), foreign key (", ("dock_@m", "column"), ") references ", ("harbor", "schema"), ".", ("docks", "table"), " (", ("dock_id", "column"), "))"]),
    ("sql", ["grant select on ", ("depot", "schema"), ".", ("lanes_@c", "table"), " to ", ("mate_@m", "user"), ", ", ("clerk", "user")]),
    ("sql", ["update ", ("gates_@c", "table"), " ", ("g", "alias"), " set ", ("g", "alias"), ".", ("kind", "column"), " = (select max(", ("t", "alias"), ".", ("kind", "column"), ") from ", ("tides_@m", "table"), "@", ("far_link", "db_link"), " ", ("t", "alias"), ") where ", ("note", "column"), " = ", ("q'!it's @p!'", "string_literal"), " and ", ("depot", "schema"), ".", ("clerk_pkg", "identifier"), ".", ("is_due", "function"), "(", ("g", "alias"), ".", ("due_at", "column"), ") = ", ("1", "number_literal")]),
    ("sql", ["lock table ", ("depot", "schema"), ".", ("lanes_@c", "table"), " in exclusive mode"]),
    ("sql", ["rename ", ("lanes_@c", "table"), " to ", ("old_lanes_@m", "table")]),
    ("sql", ["analyze table ", ("depot", "schema"), ".", ("lanes_@c", "table")]),
)
_FILLED = "replace(replace(replace(replace(replace(piece, '@c', CAST(o_custkey AS STRING)), '@m', CAST(o_custkey % 9 AS STRING)), '@p', o_orderpriority), '@k', CAST(o_orderkey AS STRING)), '@n', chr(10))"
_ROWS = ", ".join(
    "({}, '{}', {}, '{}', {})".format(k, kind, i, (p if isinstance(p, str) else p[0]).replace("'", "@q"), "CAST(NULL AS STRING)" if isinstance(p, str) else f"'{p[1]}'")
    for k, (kind, cells) in enumerate(_PIECES)
    for i, p in enumerate(cells)
)
PIECES = f"SELECT o_orderkey AS artifact_id, kind, i, replace({_FILLED}, '@q', chr(39)) AS piece, entity_type FROM {{orders}} JOIN (VALUES {_ROWS}) AS x(k, kind, i, piece, entity_type) ON o_orderkey % {len(_PIECES)} = k"

# Overlapping spans by line item
SPANS = """SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_orderkey * 10 + l_linenumber AS span_id, CAST(l_partkey % 40 AS INTEGER) AS s, CAST(l_partkey % 40 + 1 + l_suppkey % 12 AS INTEGER) AS e,
    CAST(l_suppkey % 4 * 10 AS INTEGER) AS priority FROM {lineitem}"""

# Symbols by nation and region name: cases 0..49
SYMBOLS = """SELECT CAST(c AS BIGINT) AS case_id, entity_type, name AS preferred_original, 'U:' || name AS canonical, sequence,
    'OBF_C' || CAST(c AS STRING) || '_' || code || '_' || lpad(CAST(sequence AS STRING), 4, '0') || '_AB' AS marker
    FROM (SELECT 'table' AS entity_type, 'TBL' AS code, upper(replace(n_name, ' ', '_')) AS name, n_nationkey + 1 AS sequence FROM {nation}
          UNION ALL SELECT 'schema', 'SCH', upper(replace(r_name, ' ', '_')), r_regionkey + 101 FROM {region}) x
    CROSS JOIN (SELECT DISTINCT c_custkey % 50 AS c FROM {customer}) y"""

# Questions by customer that name nations
QUESTIONS = """SELECT c_custkey AS question_id, c_custkey % 50 AS case_id, 'why is ' || lower(replace(n_name, ' ', '_')) || ' joined to Region ' || replace(r_name, ' ', '_') || ' and ' || replace(n_name, ' ', '_') || 'X, see ' || c_name AS text
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

# Symbols whose names are no single word, beside words: quoted, with spaces, one within another, with a hyphen
NAMED_SYMBOLS = """SELECT CAST(c AS BIGINT) AS case_id, entity_type, name AS preferred_original, 'Q:' || name AS canonical, sequence, 'OBF_C' || CAST(c AS STRING) || '_' || code || '_' || lpad(CAST(sequence AS STRING), 4, '0') || '_AB' AS marker
    FROM (SELECT 'column' AS entity_type, 'COL' AS code, chr(34) || 'Berth ' || CAST(n_nationkey AS STRING) || chr(34) AS name, n_nationkey + 201 AS sequence FROM {nation}
          UNION ALL SELECT 'view', 'VIW', 'Berth ' || CAST(n_nationkey AS STRING) || ' Log', n_nationkey + 301 FROM {nation}
          UNION ALL SELECT 'index', 'IDX', 'IX-' || CAST(n_nationkey AS STRING), n_nationkey + 401 FROM {nation}
          UNION ALL SELECT 'table', 'TBL', upper(replace(n_name, ' ', '_')), n_nationkey + 1 FROM {nation}) x
    CROSS JOIN (SELECT DISTINCT c_custkey % 50 AS c FROM {customer}) y"""
# Questions by customer in pieces, each with the symbol it names (null: it stays)
NAMED_PIECES = """SELECT c_custkey AS question_id, c_custkey % 50 AS case_id, i, replace(replace(piece, '@n', CAST(c_nationkey AS STRING)), '@w', lower(replace(n_name, ' ', '_'))) AS piece, entity_type, code, CAST(base + c_nationkey AS INT) AS sequence
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey CROSS JOIN (VALUES (0, 'why is ', NULL, NULL, 0), (1, 'berth @n', 'column', 'COL', 201), (2, ' slow, not ', NULL, NULL, 0), (3, 'BERTH @n LOG', 'view', 'VIW', 301), (4, ' nor xix-@n, ix-@na, berth @nz', NULL, NULL, 0),
        (5, ': ', NULL, NULL, 0), (6, 'ix-@n', 'index', 'IDX', 401), (7, '/', NULL, NULL, 0), (8, '"Berth @n"', 'column', 'COL', 201), (9, ' of é', NULL, NULL, 0), (10, '@w', 'table', 'TBL', 1), (11, '?', NULL, NULL, 0)) AS p(i, piece, entity_type, code, base)"""
# Artifacts of null, missing and twice-named cases, and rows that come twice
ODD_ARTIFACTS = f"""SELECT CAST(artifact_id - artifact_id % 3 AS BIGINT) AS artifact_id, CASE WHEN artifact_id % 11 = 0 THEN NULL ELSE case_id END AS case_id, position, text FROM ({PREDICATES}) p
    UNION ALL SELECT artifact_id, case_id, position, text FROM ({PREDICATES}) q WHERE artifact_id % 7 = 0"""
ODD_CASES = """SELECT c_custkey % 50 AS case_id, 'C' || CAST(CASE WHEN c_custkey % 10 = 4 THEN c_custkey ELSE c_custkey % 50 END AS STRING) AS prefix FROM {customer} WHERE c_custkey % 10 <> 3"""
# Answers by customer that hold known markers in any case, unknown ones and words that only look like one
ANSWERS = """SELECT c_custkey AS answer_id, c_custkey % 50 AS case_id, 'Look at obf_c' || CAST(c_custkey % 50 AS STRING) || '_tbl_' || lpad(CAST(c_nationkey + 1 AS STRING), 4, '0') || '_ab, then OBF_C'
    || CAST(c_custkey % 50 AS STRING) || '_TBL_0999_' || CAST(c_custkey % 90 + 10 AS STRING) || ' and xOBF_C1_TBL_0001_AB; ' || c_name AS text FROM {customer}"""

# Runs, their artifacts and responses from conversations
RUNS = "SELECT DISTINCT conv_id * 100 + turn AS run_id, conv_id AS case_id, turn AS created_at FROM {conversations} WHERE role = 'user'"
RESPONSES = "SELECT DISTINCT conv_id * 100 + turn - 1 AS run_id, conv_id AS case_id FROM {conversations} WHERE role = 'assistant' AND conv_id % 3 <> 0"
ARTIFACTS = "SELECT DISTINCT conv_id * 100 + turn AS artifact_id, conv_id AS case_id, conv_id * 1000 + turn * 10 + CASE WHEN turn % 4 = 0 THEN 1 ELSE 0 END AS current_revision_id, turn % 5 <> 4 AS is_active FROM {conversations}"
RUN_ARTIFACTS = "SELECT DISTINCT conv_id * 100 + turn - turn % 2 AS run_id, conv_id * 1000 + turn * 10 AS revision_id FROM {conversations}"
