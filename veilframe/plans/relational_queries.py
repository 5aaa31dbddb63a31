"""Queries of workflow, store, query shapes and functions over the star schema and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import oracle
from ..functions.vocabulary import PROMPT_FOLLOW_UP, PROMPT_MATERIALS, PROMPT_QUESTION, TYPE_LABELS
from ..operators import scratch, workflow
from ..operators.detection import STRONG_SQL_START
from ..operators.store import Store
from . import base
from .base import plain, query, same
from .text_queries import _KIND_SQL

# ---- prompts and workflow ----
_PROMPT_ART = """SELECT conv_id AS run_id, turn AS position, CASE turn % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'xplan' ELSE 'other' END AS kind, 'doc ' || CAST(turn AS STRING) AS display_name, text || ' ' AS text
    FROM {conversations} WHERE turn % 2 = 0"""
_PROMPT_Q = "SELECT conv_id AS run_id, turn AS position, ' ' || text || ' ' AS text FROM {conversations} WHERE turn % 2 = 1"
_LABELS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_LABELS.items()) + " ELSE upper(kind) END"


@query("prompt_assembly", rf"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY position) AS number FROM ({plain(_PROMPT_ART)})),
    ab AS (SELECT run_id, string_agg('=== ' || {_LABELS} || ' #' || number || ': ' || display_name || ' ===' || chr(10) || chr(10) || regexp_replace(text, '\s+$', ''), chr(10) || chr(10) ORDER BY position) AS b FROM a GROUP BY run_id),
    q AS (SELECT run_id, regexp_replace(regexp_replace(text, '\s+$', ''), '^\s+', '') AS text, row_number() OVER w AS n, count(*) OVER (PARTITION BY run_id) AS c FROM ({plain(_PROMPT_Q)}) WHERE trim(text) <> '' WINDOW w AS (PARTITION BY run_id ORDER BY position)),
    qb AS (SELECT run_id, string_agg('=== {PROMPT_QUESTION}' || CASE WHEN c > 1 THEN ' #' || n ELSE '' END || ' ===' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS b FROM q GROUP BY run_id),
    r AS (SELECT DISTINCT conv_id AS run_id FROM conversations)
    SELECT run_id, CASE WHEN ab.b IS NULL AND qb.b IS NULL THEN '' ELSE regexp_replace(CASE WHEN ab.b IS NULL THEN '{PROMPT_FOLLOW_UP}' ELSE '{PROMPT_MATERIALS}' END || coalesce(chr(10) || chr(10) || qb.b, '') || coalesce(chr(10) || chr(10) || ab.b, ''), '\s+$', '') || chr(10) END AS prompt
    FROM r LEFT JOIN ab USING (run_id) LEFT JOIN qb USING (run_id)""")
def prompt_assembly(t):
    runs = t.conversations.select(F.col("conv_id").alias("run_id")).distinct()
    return workflow.prompts(runs, t.sql(_PROMPT_ART), t.sql(_PROMPT_Q))


@query("prompt_counters", f"SELECT run_id, position, kind, CAST(row_number() OVER (PARTITION BY run_id, kind ORDER BY position) AS INTEGER) AS number FROM ({plain(_PROMPT_ART)})")
def prompt_counters(t):
    return workflow.numbered_artifacts(t.sql(_PROMPT_ART)).select("run_id", "position", "kind", "number")


_COMPOSED = "SELECT artifact_id, CASE artifact_id % 11 WHEN 3 THEN 'as OBF_AB2_TBL_0001_FF says' WHEN 4 THEN 'CREATE TABLE t (a int)' WHEN 5 THEN 'what is a plan hash?' WHEN 8 THEN 'a | b - c' ELSE text END AS text, 'AB2' AS prefix, artifact_id % 2 = 0 AS has_run, artifact_id % 13 = 0 AS has_file FROM (" + base.MIXED + ") m"
_STRONG = STRONG_SQL_START.replace(r"\A", "^")


@query("composer_classify", rf"""WITH x AS (SELECT *, {_KIND_SQL} AS kind FROM ({plain(_COMPOSED)})), y AS (SELECT *,
        has_file OR (CASE WHEN kind = 'sql' THEN regexp_matches(text, '{_STRONG}') ELSE kind <> 'unknown' END) AS m, regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])OBF_' || prefix || '_[A-Za-z0-9_]+') AND has_run AS r,
        length(text) >= 400 OR len(string_split(text, chr(10))) >= 9 OR (contains(text, '|') AND contains(text, '-')) OR regexp_matches(text, '(?i)\b(?:predicate|outline|plan hash|sql_id)\b') AS l FROM x)
    SELECT artifact_id, CASE WHEN m THEN 'material' WHEN r THEN 'response' WHEN l THEN NULL ELSE 'question' END AS submission,
        CASE WHEN m THEN 'oracle_material' WHEN r THEN 'known_case_marker' WHEN l THEN 'ambiguous_long_text' ELSE 'plain_text' END AS reason, CAST(CASE WHEN m THEN 1.0 WHEN r THEN 0.98 WHEN l THEN 0.35 ELSE 0.9 END AS DOUBLE) AS confidence FROM y""")
def composer_classify(t):
    return workflow.composer(t.sql(_COMPOSED)).select("artifact_id", "submission", "reason", "confidence")


@query("title_from_question", r"SELECT conv_id, turn, CASE WHEN length(f) > 60 THEN rtrim(f[:59]) || '…' ELSE f END AS title FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM conversations)")
def title_from_question(t):
    return t.conversations.select("conv_id", "turn", workflow.title_from_question(F.col("text")).alias("title"))


@query("latest_run", f"SELECT case_id, max(run_id) AS run_id FROM ({plain(base.RUNS)}) r WHERE created_at = (SELECT max(created_at) FROM ({plain(base.RUNS)}) s WHERE s.case_id = r.case_id) GROUP BY case_id")
def latest_run(t):
    return workflow.latest_runs(t.sql(base.RUNS))


@query("cycle_state", f"""WITH r AS ({plain(base.RUNS)}), l AS (SELECT case_id, arg_max(run_id, created_at) AS top FROM r GROUP BY case_id)
    SELECT run_id, r.case_id, CASE WHEN run_id IN (SELECT run_id FROM ({plain(base.RESPONSES)})) THEN 'closed' WHEN run_id = top THEN 'open' ELSE 'stale' END AS state FROM r JOIN l USING (case_id)""")
def cycle_state(t):
    return workflow.cycle_state(t.sql(base.RUNS), t.sql(base.RESPONSES)).select("run_id", "case_id", "state")


_UNSENT = f"SELECT artifact_id, case_id, current_revision_id FROM ({plain(base.ARTIFACTS)}) WHERE is_active AND current_revision_id NOT IN (SELECT revision_id FROM ({plain(base.RUN_ARTIFACTS)}) WHERE run_id IN (SELECT run_id FROM ({plain(base.RESPONSES)})))"


@query("unsent_artifacts", _UNSENT)
def unsent_artifacts(t):
    return workflow.unsent_artifacts(t.sql(base.ARTIFACTS), t.sql(base.RUN_ARTIFACTS), t.sql(base.RESPONSES)).select("artifact_id", "case_id", "current_revision_id")


@query("context_changed", f"SELECT DISTINCT conv_id AS case_id, conv_id IN (SELECT case_id FROM ({_UNSENT})) AND conv_id IN (SELECT case_id FROM ({plain(base.RESPONSES)})) AS context_changed FROM conversations")
def context_changed(t):
    return workflow.context_changed(t.sql(base.ARTIFACTS), t.sql(base.RUN_ARTIFACTS), t.sql(base.RESPONSES))


@query("sidebar_state", f"""SELECT c.case_id, CASE WHEN c.case_id % 17 = 0 THEN 'warning' WHEN n_resp > 0 THEN 'response' WHEN n_run > 0 THEN 'prompt' ELSE 'material' END AS state FROM (SELECT DISTINCT conv_id AS case_id FROM conversations) c
    LEFT JOIN (SELECT case_id, count(*) AS n_run FROM ({plain(base.RUNS)}) GROUP BY 1) r USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n_resp FROM ({plain(base.RESPONSES)}) GROUP BY 1) p USING (case_id)""")
def sidebar_state(t):
    cases = t.sql(base.ARTIFACTS).groupBy("case_id").agg(F.count("*").alias("n_art"))
    runs = t.sql(base.RUNS).groupBy("case_id").agg(F.count("*").alias("n_run"))
    resp = t.sql(base.RESPONSES).groupBy("case_id").agg(F.count("*").alias("n_resp"))
    warned = F.when(F.col("case_id") % 17 == 0, 1).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return cases.join(runs, "case_id", "left").join(resp, "case_id", "left").select("case_id", workflow.sidebar_state(F.col("n_art"), zero("n_run"), zero("n_resp"), warned).alias("state"))


_SNAP = """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '[{"id":"a' || CAST(turn AS STRING) || '","text":"first"},{"text":"second"}]' WHEN 1 THEN '["plain","  "]' WHEN 2 THEN '[]' END AS snapshot, CASE WHEN conv_id % 2 = 0 THEN role END AS legacy FROM {conversations}"""


@query("question_items", """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'a' || turn || '=first,q-2=second' WHEN 1 THEN 'q-1=plain' ELSE CASE WHEN conv_id % 2 = 0 THEN 'q-1=' || role ELSE '' END END AS items FROM conversations""")
def question_items(t):
    items = workflow.question_items(F.col("snapshot"), F.col("legacy"))
    return t.sql(_SNAP).select("conv_id", "turn", F.array_join(F.transform(items, lambda q: F.concat(q["id"], F.lit("="), q["text"])), ",").alias("items"))


# ---- JSON of runs and cases: the casebook's tables drawn from conversations ----
_TALK = "(SELECT conv_id, turn, max(role) AS role, max(text) AS text FROM {conversations} WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn)"
_VIEWS = {
    "cases": f"SELECT CAST(conv_id AS STRING) AS case_id, 'talk ' || CAST(conv_id AS STRING) AS title, 'C' || CAST(conv_id % 50 AS STRING) AS prefix FROM {_TALK} t GROUP BY conv_id",
    "runs": f"SELECT CAST(conv_id * 100 + turn AS STRING) AS run_id, CAST(conv_id AS STRING) AS case_id, text AS prompt, CASE WHEN turn % 3 = 0 THEN 'ok' ELSE 'warning' END AS status, CAST(turn AS DOUBLE) AS created_at FROM {_TALK} t WHERE turn % 2 = 0",
    "questions": f"SELECT CAST(conv_id * 100 + turn - turn % 2 AS STRING) AS run_id, turn AS position, 'q' || CAST(turn AS STRING) AS question_id, text FROM {_TALK} t WHERE turn % 6 <> 4",
    "artifacts": f"SELECT CAST(conv_id * 100 + turn AS STRING) AS artifact_id, CAST(conv_id AS STRING) AS case_id, CASE WHEN turn % 2 = 0 THEN 'sql' ELSE 'xplan' END AS kind, 'm' || CAST(turn AS STRING) AS display_name, CASE WHEN turn % 5 = 0 THEN NULL ELSE CAST(turn AS STRING) END AS current_revision_id, turn % 5 <> 4 AS is_active, CAST(turn AS DOUBLE) AS created_at FROM {_TALK} t",
    "revisions": f"SELECT CAST(conv_id * 100 + turn AS STRING) AS artifact_id, k AS version FROM {_TALK} t JOIN (VALUES (1), (2), (3)) AS v(k) ON turn % 4 >= k",
    "run_artifacts": f"SELECT CAST(conv_id * 100 + turn - turn % 4 AS STRING) AS run_id, CAST(conv_id * 1000 + turn AS STRING) AS revision_id, CASE WHEN turn % 2 = 0 THEN 'sql' ELSE 'xplan' END AS kind, 'm' || CAST(turn AS STRING) AS display_name, CAST(turn AS INT) AS position, text AS masked FROM {_TALK} t WHERE turn % 3 <> 0",
    "replacements": f"SELECT CAST(conv_id * 100 + turn - turn % 4 AS STRING) AS run_id, CAST(conv_id * 1000 + turn AS STRING) AS revision_id, k FROM {_TALK} t JOIN (VALUES (1), (2), (3), (4)) AS v(k) ON turn % 5 >= k",
    "responses": f"SELECT CAST(conv_id * 100 + turn - 1 AS STRING) AS run_id, 'r' || CAST(turn AS STRING) AS response_id, text AS restored_text, split(role, 'i') AS unknown_markers, CAST(turn AS DOUBLE) AS created_at FROM {_TALK} t WHERE turn % 2 = 1",
}
_VIEW_CTES = "WITH " + ", ".join(f"{n} AS ({plain(q)})" for n, q in _VIEWS.items())


@query("json_run_views", _VIEW_CTES + """, q AS (SELECT run_id, list({'id': question_id, 'text': text} ORDER BY position, question_id) AS l FROM questions GROUP BY run_id),
    n AS (SELECT run_id, revision_id, count(*) AS n FROM replacements GROUP BY ALL),
    a AS (SELECT run_id, list({'type': kind, 'display_name': display_name, 'obfuscated_text': masked, 'replacement_count': coalesce(n, 0)} ORDER BY position, revision_id) AS l FROM run_artifacts LEFT JOIN n USING (run_id, revision_id) GROUP BY run_id),
    r AS (SELECT run_id, list({'id': response_id, 'restored_text': restored_text, 'unknown_markers': unknown_markers} ORDER BY created_at, response_id) AS l FROM responses GROUP BY run_id)
    SELECT run_id, CAST(to_json({'id': run_id, 'case_id': case_id, 'prompt_text': prompt, 'validation_status': status, 'question_items': coalesce(q.l, []), 'artifacts': coalesce(a.l, []), 'responses': coalesce(r.l, [])}) AS VARCHAR) AS body
    FROM runs LEFT JOIN q USING (run_id) LEFT JOIN a USING (run_id) LEFT JOIN r USING (run_id)""")
def json_run_views(t):
    return workflow.run_views(*(t.sql(_VIEWS[n]) for n in ("runs", "questions", "run_artifacts", "replacements", "responses")))


@query("json_case_views", _VIEW_CTES + """, n AS (SELECT artifact_id, count(*) AS n FROM revisions GROUP BY ALL),
    a AS (SELECT case_id, list({'id': artifact_id, 'type': kind, 'display_name': display_name, 'current_revision_id': current_revision_id, 'revision_count': coalesce(n, 0)} ORDER BY created_at, artifact_id) AS l FROM artifacts LEFT JOIN n USING (artifact_id) WHERE is_active GROUP BY case_id),
    m AS (SELECT run_id, count(*) AS n FROM responses GROUP BY ALL),
    r AS (SELECT case_id, list({'id': run_id, 'validation_status': status, 'response_count': coalesce(n, 0)} ORDER BY created_at, run_id) AS l FROM runs LEFT JOIN m USING (run_id) GROUP BY case_id)
    SELECT case_id, CAST(to_json({'id': case_id, 'title': title, 'token_prefix': prefix, 'artifacts': coalesce(a.l, []), 'runs': coalesce(r.l, [])}) AS VARCHAR) AS body FROM cases LEFT JOIN a USING (case_id) LEFT JOIN r USING (case_id)""")
def json_case_views(t):
    return workflow.case_views(*(t.sql(_VIEWS[n]) for n in ("cases", "artifacts", "revisions", "runs", "responses")))


# ---- relational operators of the store ----
same("point_filter", "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_custkey = 42")
same("uniqueness_probe", "SELECT count(*) AS n FROM (SELECT 1 AS one FROM {customer} WHERE c_name = 'Customer#000000007' LIMIT 1) x")
same("order_by_updated", "SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderdate DESC, o_orderkey")
same("multi_key_sort", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM {orders} ORDER BY o_orderstatus, o_orderpriority DESC, o_orderkey")
same("exists_active", "SELECT DISTINCT case_id FROM (" + base.ARTIFACTS + ") a WHERE is_active")
same("join_revisions", "SELECT r.run_id, a.artifact_id FROM (" + base.RUN_ARTIFACTS + ") r JOIN (" + base.ARTIFACTS + ") a ON r.revision_id = a.current_revision_id WHERE a.is_active")
same("json_case_view", """SELECT c_custkey, '{"case_id":' || CAST(c_custkey AS STRING) || ',"title":"' || c_name || '"}' AS body FROM {customer}""")


@query("json_case_detail", """SELECT c_custkey, '{"case_id":' || c_custkey || ',"title":"' || c_name || '","orders":' || count(o_orderkey) || '}' AS body FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""")
def json_case_detail(t):
    """A case as JSON with a child count: children are counted before they are joined."""
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    c = t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("title"), F.coalesce("orders", F.lit(0)).alias("orders"))).alias("body"))


@query("delete_in_subquery", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_in_subquery(t):
    doomed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(doomed, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


same("delete_is_null", "SELECT conv_id, turn FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role END AS r FROM {conversations}) x WHERE NOT (r IS NULL AND conv_id % 2 = 0)")


@query("cascade_delete", """WITH o AS (SELECT * FROM orders WHERE o_custkey % 10 <> 3) SELECT 'customer' AS tbl, count(*) AS n FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT 'orders', count(*) FROM o
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)""")
def cascade_delete(t):
    doomed = t.orders.where("o_custkey % 10 = 3").select("o_orderkey")
    lines = t.lineitem.join(doomed, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    parts = [("customer", t.customer.where("c_custkey % 10 <> 3")), ("orders", t.orders.where("o_custkey % 10 <> 3")), ("lineitem", lines)]
    out = None
    for name, rows in parts:
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("bulk_update", "SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal FROM supplier")
def bulk_update(t):
    touched = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("hit"))
    rows = t.supplier.join(touched, "s_nationkey", "left")
    return rows.select("s_suppkey", F.when(F.col("hit"), F.col("s_acctbal") + 100).otherwise(F.col("s_acctbal")).alias("s_acctbal"))


@query("eager_load", "SELECT c_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3 GROUP BY c_custkey")
def eager_load(t):
    """Children by the parents' keys: a semi-join, then one grouped list per parent."""
    keys = t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    kept = t.orders.join(keys, "o_custkey", "left_semi")
    return kept.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("orders"))


same("count_by_type", "SELECT o_custkey % 50 AS case_id, o_orderpriority, count(*) AS n FROM {orders} GROUP BY o_custkey % 50, o_orderpriority")
same("distinct_type_sets", "SELECT o_custkey, min(o_orderstatus) AS low, max(o_orderstatus) AS high, count(DISTINCT o_orderstatus) AS n FROM {orders} GROUP BY o_custkey")
same("set_difference", "SELECT c_custkey FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
same("max_version", "SELECT o_custkey, max(o_orderkey % 100) + 1 AS next_version FROM {orders} GROUP BY o_custkey")


@query("soft_delete", "SELECT artifact_id, CASE WHEN artifact_id % 10 = 1 THEN false ELSE is_active END AS is_active FROM (" + plain(base.ARTIFACTS) + ") WHERE NOT (artifact_id % 10 = 1 AND current_revision_id NOT IN (SELECT revision_id FROM (" + plain(base.RUN_ARTIFACTS) + ")))")
def soft_delete(t):
    """Deleted artifacts become inactive; those that no run used go."""
    used = t.sql(base.RUN_ARTIFACTS).select(F.col("revision_id").alias("current_revision_id")).distinct().withColumn("used", F.lit(True))
    rows = t.sql(base.ARTIFACTS).join(used, "current_revision_id", "left")
    doomed = F.col("artifact_id") % 10 == 1
    return rows.where(~(doomed & F.col("used").isNull())).select("artifact_id", F.when(doomed, False).otherwise(F.col("is_active")).alias("is_active"))


@query("ordered_projection", "SELECT conv_id, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS line FROM conversations GROUP BY conv_id")
def ordered_projection(t):
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.length("text")).alias("x")))).alias("a"))
    return rows.select("conv_id", F.array_join(F.transform("a", lambda x: x["x"]), " ").alias("line"))


# ---- query shapes ----
same("shape_scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity > 49 AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'")
same("shape_index_range", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey BETWEEN 100 AND 220")
same("shape_unique_scan", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey = 7")
same("shape_hash_join_agg", "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM {customer} JOIN {orders} ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY c_mktsegment")
same("shape_scalar_agg", "SELECT count(*) AS n, max(o_totalprice) AS top, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM {orders} WHERE o_orderpriority <> '5-LOW'")


@query("shape_topk_rownumber", "SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def shape_topk_rownumber(t):
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", rn.alias("rn")).where("rn <= 3")


_TREE = "SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey div 2 END AS parent FROM {part}"


@query("shape_connect_by", """WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part),
    h(node, depth, path) AS (SELECT node, 1, '/' || node FROM n WHERE node = 2 UNION ALL SELECT n.node, depth + 1, path || '/' || n.node FROM h JOIN n ON n.parent = h.node AND NOT contains(path || '/', '/' || n.node || '/')) SELECT node, CAST(depth AS INTEGER) AS depth, path FROM h""")
def shape_connect_by(t):
    """START WITH node 2 CONNECT BY NOCYCLE PRIOR node = parent, with level and path."""
    return t.sql("WITH RECURSIVE n AS (" + _TREE + """), h(node, depth, path) AS (SELECT node, 1, '/' || CAST(node AS STRING) FROM n WHERE node = 2
        UNION ALL SELECT n.node, depth + 1, path || '/' || CAST(n.node AS STRING) FROM h JOIN n ON n.parent = h.node WHERE NOT contains(path || '/', '/' || CAST(n.node AS STRING) || '/')) SELECT node, depth, path FROM h""")


@query("shape_json_value", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 GROUP BY event_type")
def shape_json_value(t):
    k = oracle.json_value(F.col("props"), "$.k").cast("long")
    return t.events.withColumn("k", k).where("k % 2 = 0").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


same("shape_cte_union_all", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT o_custkey, n, 'many' AS label FROM big WHERE n >= 15 UNION ALL SELECT o_custkey, n, 'few' FROM big WHERE n <= 5")
same("shape_between_agg", "SELECT l_returnflag, count(*) AS n FROM {lineitem} WHERE l_discount BETWEEN 0.02 AND 0.05 AND l_returnflag <> 'N' GROUP BY l_returnflag")


@query("shape_bind", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_custkey < 500")
def shape_bind(t):
    return t.sql("SELECT count(*) AS n FROM {orders} WHERE o_orderstatus = :status AND o_custkey < :top", status="O", top=500)


@query("shape_pivot", """SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f_n, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS o_n, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS p_n FROM orders GROUP BY o_orderpriority""")
def shape_pivot(t):
    wide = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(f"{c.lower()}_n") for c in ("F", "O", "P")))


same("shape_outer_join", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
same("shape_ansi_join", "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
same("shape_nested_loops", "SELECT a.r_regionkey AS a_key, b.r_regionkey AS b_key FROM {region} a LEFT JOIN {region} b ON a.r_regionkey < b.r_regionkey")
same("shape_minus", "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F'")
same("shape_intersect", "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F'")
same("shape_inline_view", "SELECT v.o_orderstatus, v.n FROM (SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus) v WHERE v.n > 10")
same("shape_like_prefix", "SELECT c_custkey, c_name FROM {customer} WHERE c_name LIKE 'Customer#00000001%' AND c_acctbal > 0")
same("shape_fast_dual", "SELECT c_custkey, (SELECT 1) AS one, (SELECT 'X') AS dummy FROM {customer}")
same("shape_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15")
same("shape_insert_select", "SELECT c_custkey, c_name FROM {customer} UNION ALL SELECT 900000 + s_suppkey, s_name FROM {supplier} WHERE s_acctbal > 0")
same("shape_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM {customer}")
same("shape_delete", "SELECT c_custkey FROM {customer} WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal < 1000)")


@query("shape_qualify", "SELECT c_nationkey, c_custkey FROM customer QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def shape_qualify(t):
    best = F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey")))
    return t.customer.groupBy("c_nationkey").agg(best.alias("c_custkey"))


@query("shape_merge", """SELECT coalesce(c.c_custkey, s.k) AS k, CASE WHEN s.k IS NULL THEN c.c_acctbal ELSE s.v END AS v FROM customer c FULL JOIN (SELECT s_suppkey * 20 AS k, s_acctbal AS v FROM supplier) s ON c.c_custkey = s.k""")
def shape_merge(t):
    """WHEN MATCHED update, WHEN NOT MATCHED insert: a full outer join on unique keys."""
    source = t.supplier.select((F.col("s_suppkey") * 20).alias("k"), F.col("s_acctbal").alias("v"))
    rows = t.customer.join(source, F.col("c_custkey") == F.col("k"), "full")
    return rows.select(F.coalesce("k", "c_custkey").alias("k"), F.when(F.col("k").isNull(), F.col("c_acctbal")).otherwise(F.col("v")).alias("v"))


@query("shape_partition_pruning", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderstatus")
def shape_partition_pruning(t):
    """Rows written by status; the read prunes to one folder."""
    spark = t.spark
    path = scratch.scratch_path(spark)
    t.orders.select("o_orderkey", "o_orderstatus").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).where("o_orderstatus = 'P'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("shape_materialized_cte", "WITH s AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey) SELECT a.o_custkey, a.total FROM s a WHERE a.total > (SELECT avg(total) * 2 FROM s)")
def shape_materialized_cte(t):
    s = scratch.written(t.orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")))
    return s.crossJoin(F.broadcast(s.agg((F.avg("total") * 2).alias("bar")))).where("total > bar").select("o_custkey", "total")


# ---- functions ----
@query("fn_null", """SELECT c_custkey, coalesce(x, 'none') AS nvl, CASE WHEN x IS NOT NULL THEN 'some' ELSE 'none' END AS nvl2, CASE WHEN c_acctbal IS NULL OR y IS NULL THEN NULL ELSE greatest(c_acctbal, y) END AS greatest, CASE WHEN y IS NULL THEN NULL ELSE least(c_acctbal, y) END AS least
    FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS x, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey AS DOUBLE) END AS y FROM customer)""")
def fn_null(t):
    c = t.customer.select("c_custkey", "c_acctbal", oracle.empty_is_null(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))).alias("x"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey").cast("double")).alias("y"))
    return c.select("c_custkey", F.nvl("x", F.lit("none")).alias("nvl"), oracle.nvl2(F.col("x"), F.lit("some"), F.lit("none")).alias("nvl2"), oracle.greatest(F.col("c_acctbal"), F.col("y")).alias("greatest"), oracle.least(F.col("c_acctbal"), F.col("y")).alias("least"))


@query("fn_decode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS label FROM orders")
def fn_decode(t):
    return t.orders.select("o_orderkey", oracle.decode(F.col("o_orderstatus"), F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open"), F.lit("other")).alias("label"))


@query("fn_dates", """SELECT o_orderkey, CASE WHEN d = last_day(d) THEN last_day(CAST(d + INTERVAL 1 MONTH AS DATE)) ELSE CAST(d + INTERVAL 1 MONTH AS DATE) END AS next_month, CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(extract(year FROM d) AS INTEGER) AS y,
    strftime(d, '%Y-%m') AS ym FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def fn_dates(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", oracle.add_months(d, 1).alias("next_month"), F.trunc(d, "month").alias("month_start"), F.year(d).alias("y"), F.date_format(d, "yyyy-MM").alias("ym"))


@query("fn_numbers", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, trunc(c_acctbal) AS t, CAST(c_custkey % 7 AS BIGINT) AS m, c_custkey & 12 AS b FROM customer")
def fn_numbers(t):
    x, k = F.col("c_acctbal"), F.col("c_custkey")
    return t.customer.select("c_custkey", F.abs(x).alias("a"), F.ceil(x).cast("double").alias("c"), F.floor(x).cast("double").alias("f"), oracle.trunc_number(x).alias("t"), (k % 7).alias("m"), oracle.bitand(k, F.lit(12)).alias("b"))


same("fn_strings", "SELECT c_custkey, lower(c_name) AS l, upper(c_mktsegment) AS u, substring(c_name, 10, 4) AS s, rtrim(c_name || '  ') AS r, trim('  ' || c_name || ' ') AS t FROM {customer}")


@query("fn_regex", "SELECT c_custkey, regexp_matches(c_name, '0[1-5]$') AS hit, regexp_replace(c_name, '[0-9]+', 'N') AS masked, regexp_extract(c_name, '[0-9]+') AS digits FROM customer")
def fn_regex(t):
    return t.customer.select("c_custkey", F.regexp_like("c_name", F.lit("0[1-5]$")).alias("hit"), F.regexp_replace("c_name", "[0-9]+", "N").alias("masked"), F.regexp_substr("c_name", F.lit("[0-9]+")).alias("digits"))


@query("fn_listagg", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def fn_listagg(t):
    return t.nation.groupBy("n_regionkey").agg(oracle.listagg(F.col("n_name"), "; ", F.col("n_name")).alias("names"))


@query("fn_rank", "SELECT s_suppkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000), s_suppkey) AS INTEGER) AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000))")
def fn_rank(t):
    step = F.floor(F.col("s_acctbal") / 1000)
    w = Window.partitionBy("s_nationkey").orderBy(step)
    return t.supplier.select("s_suppkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy(step, "s_suppkey")).alias("n"))


same("fn_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM {orders}")


@query("fn_conversion", "SELECT c_custkey, TRY_CAST(c_name AS INTEGER) AS bad, TRY_CAST(regexp_extract(c_name, '[0-9]+') AS INTEGER) AS num, CAST(c_custkey AS VARCHAR) AS txt FROM customer")
def fn_conversion(t):
    return t.customer.select("c_custkey", F.col("c_name").try_cast("int").alias("bad"), F.regexp_substr("c_name", F.lit("[0-9]+")).try_cast("int").alias("num"), F.col("c_custkey").cast("string").alias("txt"))


@query("fn_json", "SELECT event_id, json_extract_string(props, '$.k') AS v, json_extract_string(props, '$.k') IS NOT NULL AS has_k, json_extract_string(props, '$.zz') IS NOT NULL AS has_z FROM events")
def fn_json(t):
    p = F.col("props")
    return t.events.select("event_id", oracle.json_value(p, "$.k").alias("v"), oracle.json_exists(p, "$.k").alias("has_k"), oracle.json_exists(p, "$.zz").alias("has_z"))


@query("fn_json_table", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json_table(t):
    return t.events.select("event_id", F.from_json("props", "k long").alias("j")).select("event_id", "j.k")


same("fn_aggregates", "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM {lineitem} GROUP BY l_returnflag")


# ---- streaming (an extension) ----
@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(t):
    """The events as a stream of files, counted by hour and type with a watermark; all windows, closed or not."""
    from ..streaming.registry import windowed_counts

    spark = t.spark
    path = scratch.scratch_path(spark)
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
    counts = windowed_counts(stream, "1 hour").select(F.col("window.start").alias("window_start"), "event_type", "n")

    def keep(rows, batch):
        rows.write.mode("overwrite").parquet(f"{path}/out/{batch}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.option("recursiveFileLookup", "true").schema("window_start timestamp, event_type string, n long").parquet(f"{path}/out")
    return done.groupBy("window_start", "event_type").agg(F.max("n").alias("n")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# ---- the store's own writes ----
_ACCOUNTS = "SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance FROM {customer}"
_SUPPLIERS = "SELECT 10000000 + s_suppkey AS key, s_nationkey AS nation, s_acctbal AS balance FROM {supplier}"
_RAISED = "SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal + 1000 AS balance FROM {customer} WHERE c_acctbal < 0"


def _store(t):
    """A store with the customers' accounts."""
    store = Store(t.spark, scratch.scratch_path(t.spark))
    store.write("accounts", t.sql(_ACCOUNTS))
    return store


@query("store_append", plain(f"{_ACCOUNTS} UNION ALL {_SUPPLIERS}"))
def store_append(t):
    store = _store(t)
    store.append("accounts", t.sql(_SUPPLIERS))
    return store.read("accounts")


@query("store_upsert", plain("SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal + CASE WHEN c_acctbal < 0 THEN 1000 ELSE 0 END AS balance FROM {customer}"))
def store_upsert(t):
    store = _store(t)
    store.upsert("accounts", t.sql(_RAISED), ["key"])
    return store.read("accounts")


@query("store_delete", plain(f"SELECT * FROM ({_ACCOUNTS}) WHERE balance >= 0"))
def store_delete(t):
    store = _store(t)
    store.delete("accounts", t.sql(_RAISED), ["key"])
    return store.read("accounts")


@query("store_cascade", plain(f"SELECT 'accounts' AS stored, nation, count(*) AS n FROM ({_ACCOUNTS}) WHERE nation <> 3 GROUP BY nation UNION ALL SELECT 'suppliers', nation, count(*) FROM ({_SUPPLIERS}) WHERE nation <> 3 GROUP BY nation"))
def store_cascade(t):
    """A nation's rows go from both tables."""
    store = _store(t)
    store.write("suppliers", t.sql(_SUPPLIERS))
    store.delete_case(3, {"accounts": "nation", "suppliers": "nation"})
    counts = [store.read(n).groupBy("nation").agg(F.count("*").alias("n")).select(F.lit(n).alias("stored"), "nation", "n") for n in ("accounts", "suppliers")]
    return counts[0].unionByName(counts[1])
