"""The life of cases on a store: materials, revisions, questions, runs, answers. One user action is one call.

Tables are small next to the texts; each call reads what it needs, computes with the engine's operators and
writes new versions. A case has one writer at a time, as the registry's numbers must not be given twice.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.text import MAX_BYTES
from . import answers, engine, rewrite, symbols, workflow
from .detection import kind_of, split_materials, statements
from .sql_text import normal_tokens
from .statements import match_statements
from .store import Store

TABLES = {
    "cases": "case_id string, number long, title string, prefix string, statement string, created_at double",
    "artifacts": "artifact_id string, case_id string, kind string, display_name string, current_revision_id string, is_active boolean, created_at double",
    "revisions": "revision_id string, artifact_id string, case_id string, version int, text string, created_at double",
    "questions": "question_id string, case_id string, run_id string, text string, position long",
    "runs": "run_id string, case_id string, prompt string, status string, created_at double",
    "run_artifacts": "run_id string, case_id string, revision_id string, artifact_id string, kind string, display_name string, position int, masked string",
    "replacements": "run_id string, case_id string, revision_id string, start int, end int, original string, marker string, output_start int, output_end int",
    "findings": "run_id string, case_id string, revision_id string, code string",
    "responses": "response_id string, run_id string, case_id string, raw_text string, restored_text string, unknown_markers array<string>, created_at double",
    "symbols": "case_id string, entity_type string, canonical string, preferred_original string, sequence int, confidence double, marker string, last_used_at double",
}


class CaseError(ValueError):
    """The action does not fit the case's state."""


class SqlMismatch(CaseError):
    """The material shows another statement than the case."""


def normalized_statement(text: str) -> str:
    """A statement's tokens as ``sql_text.statement_identity`` takes them from a column."""
    return "\x1f".join(normal_tokens(text))


def compatible(a: str, b: str) -> bool:
    """Equal, or the shorter one is the other cut off: tokens agree and the last may be a beginning, or a long beginning agrees."""
    short, long = sorted((a, b), key=len)
    x, y = short.split("\x1f"), long.split("\x1f")
    return a == b or (len(short) >= 80 and long.startswith(short)) or (12 <= len(x) <= len(y) and x[:-1] == y[: len(x) - 1] and y[len(x) - 1].startswith(x[-1]))


class Casebook:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name) if self.store.version(name) else self.spark.createDataFrame([], TABLES[name])

    def _add(self, name: str, *rows: tuple) -> None:
        self.store.append(name, self.spark.createDataFrame(list(rows), TABLES[name]))

    def _rows(self, name: str, case_id: str) -> DataFrame:
        return self.table(name).where(F.col("case_id") == case_id)

    def _case(self, case_id: str):
        row = self._rows("cases", case_id).first()
        if row is None:
            raise CaseError(f"no case {case_id}")
        return row

    # ---- cases ----
    def create_case(self, title: str = "New case") -> str:
        number = (self.table("cases").agg(F.max("number")).first()[0] or 0) + 1
        prefix = self.spark.range(1).select(symbols.case_prefix(F.lit(number))).first()[0]
        case_id = uuid.uuid4().hex
        self._add("cases", (case_id, number, title[:200], prefix, None, time.time()))
        return case_id

    def rename_case(self, case_id: str, title: str) -> None:
        if not title.strip() or len(title) > 200:
            raise CaseError("a title has 1 to 200 characters")
        self._case(case_id)
        self.store.upsert("cases", self._rows("cases", case_id).withColumn("title", F.lit(title.strip())), ["case_id"])

    def delete_case(self, case_id: str) -> None:
        self._case(case_id)
        self.store.delete_case(case_id, dict.fromkeys([*TABLES, "parses"], "case_id"))

    def list_cases(self) -> DataFrame:
        """Cases, the last touched first, with their state."""
        per = lambda name, out: self.table(name).groupBy("case_id").agg(F.count("*").alias(out))
        out = self.table("cases")
        for name, n in (("artifacts", "n_artifacts"), ("runs", "n_runs"), ("responses", "n_responses")):
            out = out.join(per(name, n), "case_id", "left").withColumn(n, F.coalesce(n, F.lit(0)))
        warned = self.table("runs").groupBy("case_id").agg(F.count_if(F.col("status") == "warning").alias("n_warnings"))
        out = out.join(warned, "case_id", "left").withColumn("n_warnings", F.coalesce("n_warnings", F.lit(0)))
        return out.withColumn("state", workflow.sidebar_state(*map(F.col, ("n_artifacts", "n_runs", "n_responses", "n_warnings")))).orderBy(F.desc("created_at"))

    # ---- materials ----
    def _check_identity(self, case, kind: str, text: str) -> None:
        for shown in map(normalized_statement, statements(text, kind)):
            if case.statement is None:
                fixed = self._rows("cases", case.case_id).withColumn("statement", F.lit(shown))
                self.store.upsert("cases", fixed, ["case_id"])
                case = self._case(case.case_id)
            elif not compatible(case.statement, shown):
                raise SqlMismatch("the material shows another statement than the case")

    def cases_of(self, shown: DataFrame, text: str = "text") -> DataFrame:
        """shown with ``matched_case`` and ``match``: the case whose statement each text shows, for any number of texts and cases at once."""
        return match_statements(shown, self.table("cases").select("case_id", F.col("statement").alias(text)), text)

    def add_materials(self, case_id: str, text: str, name: str = "material") -> list[str]:
        """One artifact for each material of a paste; the whole as unknown if none is recognised."""
        if len(text) > MAX_BYTES or len(text.encode()) > MAX_BYTES:
            raise CaseError("the text is over 100 MiB")
        parts = split_materials(text) or [("unknown", 0, len(text))]
        added = []
        for k, (kind, s, e) in enumerate(parts, 1):
            self._check_identity(self._case(case_id), kind, text[s:e])
            artifact, revision, now = uuid.uuid4().hex, uuid.uuid4().hex, time.time()
            self._add("artifacts", (artifact, case_id, kind, f"{name} · {k}" if len(parts) > 1 else name, revision, True, now))
            self._add("revisions", (revision, artifact, case_id, 1, text[s:e], now))
            added.append(artifact)
        self._refresh(case_id)
        return added

    def revise(self, artifact_id: str, text: str) -> str:
        """A new revision; earlier ones stay as they are."""
        row = self.table("artifacts").where(F.col("artifact_id") == artifact_id).first()
        if row is None:
            raise CaseError(f"no artifact {artifact_id}")
        kind = kind_of(text)
        kind = row.kind if kind == "unknown" else kind
        version = self.table("revisions").where(F.col("artifact_id") == artifact_id).agg(F.max("version")).first()[0] + 1
        revision = uuid.uuid4().hex
        self._add("revisions", (revision, artifact_id, row.case_id, version, text, time.time()))
        self.store.upsert("artifacts", self.spark.createDataFrame([(artifact_id, row.case_id, kind, row.display_name, revision, row.is_active, row.created_at)], TABLES["artifacts"]), ["artifact_id"])
        self._refresh(row.case_id)
        return revision

    def delete_artifact(self, artifact_id: str) -> None:
        """Out of use; gone altogether if no run used it."""
        row = self.table("artifacts").where(F.col("artifact_id") == artifact_id).first()
        one = self.spark.createDataFrame([(artifact_id,)], "artifact_id string")
        if self.table("run_artifacts").where(F.col("artifact_id") == artifact_id).isEmpty():
            for name in ("artifacts", "revisions"):
                self.store.delete(name, one, ["artifact_id"])
        else:
            off = self.table("artifacts").where(F.col("artifact_id") == artifact_id).withColumn("is_active", F.lit(False))
            self.store.upsert("artifacts", off, ["artifact_id"])
        self._refresh(row.case_id)

    # ---- runs ----
    def _open_run(self, case_id: str):
        states = workflow.cycle_state(self._rows("runs", case_id), self._rows("responses", case_id))
        return states.where("state = 'open'").first()

    def _refresh(self, case_id: str) -> None:
        """An open run follows its case: materials that changed are masked anew."""
        if open_run := self._open_run(case_id):
            self._build(case_id, open_run.run_id)

    def ask(self, case_id: str, text: str) -> str:
        """Add a question to the open run, or begin one; the run's prompt is built anew."""
        if not text.strip():
            raise CaseError("the question is empty")
        self._case(case_id)
        open_run = self._open_run(case_id)
        run_id = open_run.run_id if open_run else uuid.uuid4().hex
        self._add("questions", (uuid.uuid4().hex, case_id, run_id, text.strip(), time.time_ns()))
        return self._build(case_id, run_id)

    def edit_question(self, question_id: str, text: str | None) -> None:
        """Change a question of the open run, or delete it (None). A closed run stays as it is; an empty open run goes."""
        row = self.table("questions").where(F.col("question_id") == question_id).first()
        open_run = row and self._open_run(row.case_id)
        if not open_run or open_run.run_id != row.run_id:
            raise CaseError("the question's run is closed")
        mine = self.table("questions").where(F.col("question_id") == question_id)
        if text is None:
            self.store.delete("questions", mine, ["question_id"])
        else:
            self.store.upsert("questions", mine.withColumn("text", F.lit(text.strip())), ["question_id"])
        if self.table("questions").where(F.col("run_id") == row.run_id).isEmpty():
            for name in ("runs", "run_artifacts", "replacements", "findings"):
                if self.store.version(name):
                    self.store.write(name, self.table(name).where(F.col("run_id") != row.run_id))
        else:
            self._build(row.case_id, row.run_id)

    def _build(self, case_id: str, run_id: str) -> str:
        case = self._case(case_id)
        closed = workflow.unsent_artifacts(self._rows("artifacts", case_id), self._rows("run_artifacts", case_id), self._rows("responses", case_id))
        pending = closed.join(self._rows("revisions", case_id).select(F.col("revision_id").alias("current_revision_id"), "text"), "current_revision_id")
        place = F.row_number().over(Window.partitionBy("case_id").orderBy("created_at", "artifact_id")) - 1  # the materials of one prompt
        sent = pending.select(F.col("current_revision_id").alias("revision_id"), "artifact_id", "kind", "display_name", place.alias("position"), "text")
        source = sent.select(F.lit(case_id).alias("case_id"), F.col("revision_id").alias("artifact_id"), "position", "text")
        held = {r.revision_id for r in self.table("run_artifacts").where(F.col("run_id") == run_id).select("revision_id").collect()}  # of one prompt
        if not self.run(run_id) or held != {r.revision_id for r in sent.select("revision_id").collect()}:
            self._mask(case, run_id, sent, source)
        return self._prompt(case_id, run_id)

    def _mask(self, case, run_id: str, sent: DataFrame, source: DataFrame) -> None:
        """Mask a run's materials anew. Parses are kept by content with their case, so a text is parsed once, whichever of its runs show it, and goes with the case."""
        case_id = case.case_id
        cases = self.spark.createDataFrame([(case_id, case.prefix)], "case_id string, prefix string")
        kept = lambda: self.store.read("parses").where(F.col("case_id") == case_id) if self.store.version("parses") else None
        self.store.append("parses", engine.parse_table(source, kept()).withColumn("case_id", F.lit(case_id)))
        had = self._rows("symbols", case_id)
        out = engine.pseudonymise(source, cases, had.drop("last_used_at"), parses=kept())
        stamped = symbols.touched(out.symbols, had, out.replacements.select(F.lit(case_id).alias("case_id"), "marker"), F.lit(time.time()))
        self.store.upsert("symbols", stamped.select(*(f.split()[0] for f in TABLES["symbols"].split(", "))), ["case_id"])
        stamp = lambda df: df.withColumn("run_id", F.lit(run_id)).withColumn("case_id", F.lit(case_id))
        put = lambda name, df: self.store.upsert(name, stamp(df).select(*(f.split()[0] for f in TABLES[name].split(", "))), ["run_id"]) if not df.isEmpty() else self.store.version(name) and self.store.write(name, self.table(name).where(F.col("run_id") != run_id))
        put("run_artifacts", sent.drop("text").join(out.masked.select(F.col("artifact_id").alias("revision_id"), "masked"), "revision_id"))
        put("replacements", out.replacements.withColumnRenamed("artifact_id", "revision_id"))
        put("findings", out.findings.withColumnRenamed("artifact_id", "revision_id"))

    def _prompt(self, case_id: str, run_id: str) -> str:
        """The run's prompt from its masked materials and its questions; a follow-up question over unchanged materials needs no more than this."""
        known = self._rows("symbols", case_id)
        asked = self.table("questions").where(F.col("run_id") == run_id)
        masked = rewrite.mask_questions(asked, known).select("run_id", "position", F.col("masked").alias("text"))
        shown = self.table("run_artifacts").where(F.col("run_id") == run_id).select("run_id", "position", "kind", "display_name", F.col("masked").alias("text"))
        one = self.spark.createDataFrame([(run_id,)], "run_id string")
        prompt = workflow.prompts(one, shown, masked).first().prompt
        n = self.table("findings").where(F.col("run_id") == run_id).count()
        self.store.upsert("runs", self.spark.createDataFrame([(run_id, case_id, prompt, "pending" if not prompt else "warning" if n else "ok", time.time())], TABLES["runs"]), ["run_id"])
        return run_id

    def run(self, run_id: str):
        return self.table("runs").where(F.col("run_id") == run_id).first()

    def restored_sources(self, run_id: str) -> DataFrame:
        """The run's materials restored from what was sent, marker by marker."""
        mine = lambda name: self.table(name).where(F.col("run_id") == run_id)
        return rewrite.exact_restore(mine("run_artifacts").select("revision_id", "masked"), mine("replacements"), "revision_id")

    # ---- JSON ----
    def case_json(self, case_id: str) -> str:
        self._case(case_id)
        return workflow.case_views(*(self._rows(name, case_id) for name in ("cases", "artifacts", "revisions", "runs", "responses"))).first().body

    def run_json(self, run_id: str) -> str:
        if self.run(run_id) is None:
            raise CaseError(f"no run {run_id}")
        mine = (self.table(name).where(F.col("run_id") == run_id) for name in ("runs", "questions", "run_artifacts", "replacements", "responses"))
        return workflow.run_views(*mine).first().body

    def restored_json(self, run_id: str) -> DataFrame:
        """(revision_id, body): the run's restored materials."""
        return workflow.restored_views(self.restored_sources(run_id))

    # ---- answers ----
    def respond(self, case_id: str, text: str, page: str | None = None) -> str:
        """The answer to the latest run, as Markdown with known markers restored; it closes the run."""
        latest = workflow.latest_runs(self._rows("runs", case_id)).first()
        if latest is None or not self.run(latest.run_id).prompt:
            raise CaseError("no prompt was sent yet")
        answer = answers.answer_to_markdown(text, page)
        frame = self.spark.createDataFrame([("a", case_id, answer)], "answer_id string, case_id string, text string")
        got = rewrite.restore_answers(frame, self._rows("symbols", case_id)).first()
        response = uuid.uuid4().hex
        self._add("responses", (response, latest.run_id, case_id, text, got.restored, got.unknown, time.time()))
        if got.unknown:
            self._add("findings", (latest.run_id, case_id, None, "unknown_response_markers"))
        return response

    def submit(self, case_id: str, text: str, mode: str = "auto", name: str | None = None, page: str | None = None) -> tuple[str, object]:
        """Sort a message into material, response or question and act on it; ambiguous ones are for the user to say."""
        case = self._case(case_id)
        if mode == "auto":
            row = self.spark.createDataFrame([(text, case.prefix, not self._rows("runs", case_id).isEmpty(), name is not None)], "text string, prefix string, has_run boolean, has_file boolean")
            mode = workflow.composer(row).first().submission
        if mode == "material":
            return mode, self.add_materials(case_id, text, name or "material")
        if mode == "response":
            return mode, self.respond(case_id, text, page)
        if mode == "question":
            return mode, self.ask(case_id, text)
        raise CaseError("say whether this is a material, a question or a response")
