"""Prompts, composer rules and the life of a case: what is sent, open, closed, or left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import PROMPT_FOLLOW_UP, PROMPT_MATERIALS, PROMPT_QUESTION, TYPE_LABELS
from .detection import STRONG_SQL_START, kind_column


def type_label(kind: Column) -> Column:
    pairs = [F.lit(x) for kv in TYPE_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.upper(kind))


def numbered_artifacts(artifacts: DataFrame, run: str = "run_id") -> DataFrame:
    """artifacts with ``number``: a counter per type within a run, by position."""
    return artifacts.withColumn("number", F.row_number().over(Window.partitionBy(run, "kind").orderBy("position")))


def prompts(runs: DataFrame, artifacts: DataFrame, questions: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, prompt): preamble, questions, then artifacts by position, parted by blank lines; empty without content.

    artifacts: run, position, kind, display_name, text; questions: run, position, text.
    """
    right = lambda c: F.regexp_replace(c, r"\s+$", "")
    clean = questions.withColumn("text", F.regexp_replace(right(F.col("text")), r"^\s+", "")).where("text <> ''")
    asked = clean.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("_q"))
    shown = numbered_artifacts(artifacts, run)
    block = F.concat(F.lit("=== "), type_label(F.col("kind")), F.lit(" #"), F.col("number"), F.lit(": "), F.col("display_name"), F.lit(" ===\n\n"), right(F.col("text")))
    shown = shown.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))).alias("_a"))
    joined = runs.join(asked, run, "left").join(shown, run, "left")
    many = F.transform("_q", lambda x, i: F.concat(F.lit(f"=== {PROMPT_QUESTION} #"), i + 1, F.lit(" ===\n\n"), x["text"]))
    one = F.transform("_q", lambda x: F.concat(F.lit(f"=== {PROMPT_QUESTION} ===\n\n"), x["text"]))
    none = F.expr("cast(array() as array<string>)")
    parts = F.concat(
        F.array(F.when(F.col("_a").isNotNull(), PROMPT_MATERIALS).otherwise(PROMPT_FOLLOW_UP)),
        F.coalesce(F.when(F.size("_q") == 1, one).otherwise(many), none),
        F.coalesce(F.transform("_a", lambda x: x["b"]), none),
    )
    text = F.concat(right(F.array_join(parts, "\n\n")), F.lit("\n"))
    return joined.select(run, F.when(F.col("_a").isNull() & F.col("_q").isNull(), "").otherwise(text).alias("prompt"))


def composer(texts: DataFrame, text: str = "text", prefix: str = "prefix", has_run: str = "has_run", has_file: str = "has_file") -> DataFrame:
    """texts with submission (material, response, question or null), reason and confidence."""
    t = F.col(text)
    kind = kind_column(t)
    strong = F.when(kind == "sql", t.rlike(STRONG_SQL_START)).otherwise(kind != "unknown")
    mark = F.concat(F.lit("(?i)(?<![A-Za-z0-9_])OBF_"), F.col(prefix), F.lit("_[A-Za-z0-9_]+(?![A-Za-z0-9_])"))
    material = F.col(has_file) | strong
    response = F.regexp_like(t, mark) & F.col(has_run)
    long = (F.length(t) >= 400) | (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) >= 8) | (F.contains(t, F.lit("|")) & F.contains(t, F.lit("-"))) | t.rlike(r"(?i)\b(?:predicate|outline|plan hash|sql_id)\b")
    pick = lambda *v: F.when(material, v[0]).when(response, v[1]).when(long, v[2]).otherwise(v[3])
    return texts.withColumn("submission", pick("material", "response", None, "question")).withColumn("reason", pick("oracle_material", "known_case_marker", "ambiguous_long_text", "plain_text")).withColumn("confidence", pick(1.0, 0.98, 0.35, 0.9))


def title_from_question(text: Column) -> Column:
    """Spaces collapsed; over 60 characters, the first 59 and an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > 60, F.concat(F.rtrim(F.substring(flat, 1, 59)), F.lit("…"))).otherwise(flat)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each case: maximum over a struct, combined before the shuffle."""
    return runs.groupBy("case_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


def cycle_state(runs: DataFrame, responses: DataFrame) -> DataFrame:
    """runs with state: closed (has a response), open (the case's latest without one) or stale."""
    closed = responses.select("run_id").distinct().withColumn("_c", F.lit(True))
    latest = latest_runs(runs).select(F.col("run_id").alias("_latest"))
    joined = runs.join(closed, "run_id", "left").join(latest, runs["run_id"] == latest["_latest"], "left")
    return joined.withColumn("state", F.when(F.col("_c"), "closed").when(F.col("_latest").isNotNull(), "open").otherwise("stale")).drop("_c", "_latest")


def unsent_artifacts(artifacts: DataFrame, run_artifacts: DataFrame, responses: DataFrame) -> DataFrame:
    """Active artifacts whose current revision is in no closed run."""
    sent = run_artifacts.join(responses.select("run_id").distinct(), "run_id", "left_semi").select(F.col("revision_id").alias("current_revision_id"))
    return artifacts.where("is_active").join(sent, "current_revision_id", "left_anti")


def context_changed(artifacts: DataFrame, run_artifacts: DataFrame, responses: DataFrame) -> DataFrame:
    """(case_id, context_changed): a response exists and an active revision was not sent."""
    left = unsent_artifacts(artifacts, run_artifacts, responses).select("case_id").distinct().withColumn("_u", F.lit(True))
    answered = responses.select("case_id").distinct().withColumn("_a", F.lit(True))
    cases = artifacts.select("case_id").distinct()
    out = cases.join(left, "case_id", "left").join(answered, "case_id", "left")
    return out.select("case_id", F.coalesce(F.col("_u") & F.col("_a"), F.lit(False)).alias("context_changed"))


def sidebar_state(n_artifacts: Column, n_runs: Column, n_responses: Column, n_warnings: Column) -> Column:
    return F.when(n_warnings > 0, "warning").when(n_responses > 0, "response").when(n_runs > 0, "prompt").when(n_artifacts > 0, "material").otherwise("empty")


def question_items(snapshot: Column, legacy: Column) -> Column:
    """Questions of a run as array<struct<id, text>>: objects or strings of the JSON list, else the single legacy text; ids default to q-N."""
    items = F.from_json(snapshot, "array<string>")
    parsed = F.transform(
        items,
        lambda x, i: F.struct(
            F.coalesce(F.when(x.startswith("{"), F.get_json_object(x, "$.id")), F.concat(F.lit("q-"), i + 1)).alias("id"),
            F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x).alias("text"),
        ),
    )
    kept = F.filter(parsed, lambda q: F.coalesce(F.trim(q["text"]) != "", F.lit(False)))
    single = F.when(F.coalesce(F.trim(legacy) != "", F.lit(False)), F.array(F.struct(F.lit("q-1").alias("id"), legacy.alias("text"))))
    return F.coalesce(F.when(F.size(kept) > 0, kept), single, F.expr("cast(array() as array<struct<id:string,text:string>>)"))


def _listed(rows: DataFrame, key: str, order: list[str], out: str, **fields: Column) -> DataFrame:
    """(key, out): a key's rows as an array of structs in order."""
    item = F.struct(*order, F.struct(*(c.alias(n) for n, c in fields.items())).alias("_item"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_l")).select(key, F.transform("_l", lambda x: x["_item"]).alias(out))


def _bodies(rows: DataFrame, key: str, lists: dict[str, DataFrame], **fields: Column) -> DataFrame:
    """(key, body): fields and lists as one JSON object in the order given; nulls are written, lists without rows are empty."""
    for name, listed in lists.items():
        rows = rows.join(listed, key, "left").withColumn(name, F.coalesce(name, F.from_json(F.lit("[]"), listed.schema[name].dataType.simpleString())))
    parts = [*(c.alias(n) for n, c in fields.items()), *lists]
    return rows.select(key, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("body"))


def run_views(runs: DataFrame, questions: DataFrame, run_artifacts: DataFrame, replacements: DataFrame, responses: DataFrame) -> DataFrame:
    """(run_id, body): each run as JSON, with its questions, masked materials with their numbers of replacements, and answers.

    Tables and columns are those of the casebook. A run without any of these has empty lists.
    """
    c = F.col
    counts = replacements.groupBy("run_id", "revision_id").agg(F.count("*").alias("_n"))
    shown = run_artifacts.join(counts, ["run_id", "revision_id"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    lists = {
        "question_items": _listed(questions, "run_id", ["position", "question_id"], "question_items", id=c("question_id"), text=c("text")),
        "artifacts": _listed(shown, "run_id", ["position", "revision_id"], "artifacts", type=c("kind"), display_name=c("display_name"), obfuscated_text=c("masked"), replacement_count=c("_n")),
        "responses": _listed(responses, "run_id", ["created_at", "response_id"], "responses", id=c("response_id"), restored_text=c("restored_text"), unknown_markers=c("unknown_markers")),
    }
    return _bodies(runs, "run_id", lists, id=c("run_id"), case_id=c("case_id"), prompt_text=c("prompt"), validation_status=c("status"))


def case_views(cases: DataFrame, artifacts: DataFrame, revisions: DataFrame, runs: DataFrame, responses: DataFrame) -> DataFrame:
    """(case_id, body): each case as JSON, with its materials in use and its runs."""
    c = F.col
    versions = revisions.groupBy("artifact_id").agg(F.count("*").alias("_n"))
    used = artifacts.where("is_active").join(versions, "artifact_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    answered = responses.groupBy("run_id").agg(F.count("*").alias("_n"))
    made = runs.join(answered, "run_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    lists = {
        "artifacts": _listed(used, "case_id", ["created_at", "artifact_id"], "artifacts", id=c("artifact_id"), type=c("kind"), display_name=c("display_name"), current_revision_id=c("current_revision_id"), revision_count=c("_n")),
        "runs": _listed(made, "case_id", ["created_at", "run_id"], "runs", id=c("run_id"), validation_status=c("status"), response_count=c("_n")),
    }
    return _bodies(cases, "case_id", lists, id=c("case_id"), title=c("title"), token_prefix=c("prefix"))


def restored_views(restored: DataFrame, key: str = "revision_id") -> DataFrame:
    """(key, body): restored materials as JSON."""
    return restored.select(key, F.to_json(F.struct(F.col("restored").alias("restored_text")), {"ignoreNullFields": "false"}).alias("body"))
