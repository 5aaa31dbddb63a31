"""A case from paste to restored answer."""

import pytest
from pyspark.sql import functions as F
from tests.core import fixtures as fx

from veilframe.operators.casebook import Casebook, CaseError, SqlMismatch, compatible, normalized_statement


def test_statement_identity():
    a = normalized_statement("select  a, 'x' from t -- c\n where b = 1 and c = 2 and d = 3")
    assert a == normalized_statement("SELECT A, 'x' FROM t WHERE b=1 and C=2 and d = 3;")
    assert compatible(a, normalized_statement("SELECT A, 'x' FROM t WHERE b=1 and C=2 an")) and not compatible(a, normalized_statement("select z from q"))


def test_life_of_a_case(spark, tmp_path):
    book = Casebook(spark, f"file://{tmp_path}/book")
    case, other = book.create_case(), book.create_case("other")
    assert book._case(case).prefix != book._case(other).prefix
    kind, (plan,) = book.submit(case, fx.PLAN)
    assert kind == "material"
    with pytest.raises(SqlMismatch):
        book.add_materials(case, "select something_else from nowhere")
    kind, run = book.submit(case, "why is lanes slow?")
    sent = book.run(run)
    prefix = book._case(case).prefix
    assert kind == "question" and f"why is OBF_{prefix}_TBL_" in sent.prompt and "LANES" not in sent.prompt and "00:00:02.88" in sent.prompt and sent.status == "warning"
    assert [r.restored for r in book.restored_sources(run).collect()] == [fx.PLAN.strip()]
    marker = book.table("symbols").where("canonical = 'U:IX_PARCEL' and entity_type = 'index'").first().marker
    kind, _ = book.submit(case, f"rebuild {marker} and OBF_{prefix}_TBL_7777_00")
    answer = book.table("responses").first()
    assert kind == "response" and answer.restored_text == f"rebuild IX_PARCEL and OBF_{prefix}_TBL_7777_00" and answer.unknown_markers == [f"OBF_{prefix}_TBL_7777_00"]
    question = book.table("questions").first().question_id
    with pytest.raises(CaseError, match="closed"):
        book.edit_question(question, "later")
    follow = book.ask(case, "and then?")
    assert follow != run and "DBMS_XPLAN" not in book.run(follow).prompt
    book.revise(plan, fx.PLAN.replace("5381", "5382"))
    again = book.run(follow).prompt
    assert "5382" in again and marker in again and "and then?" in again
    book.delete_artifact(plan)
    assert "DBMS_XPLAN" not in book.run(follow).prompt and book.table("artifacts").where(~F.col("is_active")).count() == 1
    assert {r.case_id: r.state for r in book.list_cases().collect()}[other] == "empty"
    book.rename_case(case, "named")
    with pytest.raises(CaseError):
        book.submit(other, "x" * 500)
    book.delete_case(case)
    assert book.table("symbols").count() == 0 and book.list_cases().count() == 1


def test_a_follow_up_question_parses_nothing(spark, tmp_path, monkeypatch):
    """An open run whose materials did not change masks its questions only; a second material is parsed, the first one is not again."""
    from veilframe.operators import casebook, engine

    book = Casebook(spark, f"file://{tmp_path}/book")
    case = book.create_case()
    book.add_materials(case, "select lane_no from lanes")
    run = book.ask(case, "why is lanes slow?")
    first = book.run(run).prompt
    monkeypatch.setattr(casebook.engine, "pseudonymise", lambda *a, **k: pytest.fail("masked again"))
    assert book.ask(case, "and lane_no?") == run
    materials = lambda prompt: prompt.split("=== ВОПРОС")[0]
    assert "lane_no" not in book.run(run).prompt and materials(first) == materials(book.run(run).prompt)
    monkeypatch.undo()
    parsed = []
    monkeypatch.setattr(engine, "parse_table", lambda a, k, real=engine.parse_table: parsed.append(real(a, k).count()) or real(a, k))
    book.add_materials(case, "Plan hash value: 12")
    assert book.ask(case, "now?") == run and parsed == [1]
    assert book.store.read("parses").count() == 2
    book.delete_case(case)
    assert book.store.read("parses").count() == 0


def test_last_use_and_json(spark, tmp_path):
    """A known symbol that is used again marks all of its case as used; runs, cases and restored texts as JSON; cases found by statement."""
    import json

    book = Casebook(spark, f"file://{tmp_path}/book")
    case = book.create_case("a title")
    text = "select lane_no, lane_name, depth, width, opened, closed from lanes where lane_no = 17 and depth > 3"
    book.add_materials(case, text)
    run = book.ask(case, "why is lanes slow?")
    first = {r.marker: r.last_used_at for r in book.table("symbols").collect()}
    assert len(set(first.values())) == 1
    body = json.loads(book.run_json(run))
    assert list(body) == ["id", "case_id", "prompt_text", "validation_status", "question_items", "artifacts", "responses"]
    assert body["artifacts"][0]["type"] == "sql" and body["artifacts"][0]["replacement_count"] > 8 and "lane" not in body["artifacts"][0]["obfuscated_text"]
    assert [q["text"] for q in body["question_items"]] == ["why is lanes slow?"] and body["responses"] == []
    shown = json.loads(book.case_json(case))
    assert shown["title"] == "a title" and shown["artifacts"][0]["revision_count"] == 1 and shown["runs"] == [{"id": run, "validation_status": body["validation_status"], "response_count": 0}]
    assert [json.loads(r.body) for r in book.restored_json(run).collect()] == [{"restored_text": text}]
    with pytest.raises(CaseError):
        book.run_json("none")
    frame = spark.createDataFrame([(1, text.upper()), (2, text + " order by 1"), (3, text[:60]), (4, "select 1 from dual")], "k int, text string")
    assert {r.k: (r.matched_case, r.match) for r in book.cases_of(frame).collect()} == {1: (case, "same"), 2: (case, "continues"), 3: (case, "cut_off"), 4: (None, None)}
    book.respond(case, "done")
    book.add_materials(case, text + " order by opened")
    book.ask(case, "and now?")
    later = {r.marker: r.last_used_at for r in book.table("symbols").collect()}
    assert set(first) <= set(later) and len(set(later.values())) == 1 and min(later.values()) > max(first.values())
