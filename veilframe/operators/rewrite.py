"""Rewriting: splice markers in, restore them, mask questions, and look for what leaked.

Texts are told apart by ``doc``, a column or a list of columns. Rows that repeat a key must be equal: they then share their spans
and each is rewritten. Keys may be null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import names
from .model import listed
from .scratch import written
from .spans import running_sums, token_rows
from .symbols import short_marker_valid

WORD = names.WORD
MARKER = "OBF_[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+"
# The form of a compact marker, and of what else looks like one
COMPACT = r"(?i)\bOBF_[A-Z0-9]{1,12}_[A-Z0-9]{2,8}_[0-9A-Z]{4,8}_[0-9A-F]{2}\b"
LOOKALIKE = r"(?i)\bOBF_[A-Z0-9_]{4,80}\b"


def _keys(doc: str | list[str]) -> list[str]:
    return [doc] if isinstance(doc, str) else list(doc)


def _attach(texts: DataFrame, parts: DataFrame, doc: str | list[str]) -> DataFrame:
    """Left join by null-safe keys."""
    keys = _keys(doc)
    renamed = parts.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    hit = F.lit(True)
    for k in keys:
        hit = hit & texts[k].eqNullSafe(renamed[f"_key_{k}"])
    return texts.join(renamed, hit, "left").drop(*(f"_key_{k}" for k in keys))


def manifest(spans: DataFrame, doc: str | list[str] = "artifact_id") -> DataFrame:
    """Each replacement with its place in the output: the running change of length moves it."""
    before = Window.partitionBy(*_keys(doc)).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.length("marker") - (F.col("end") - F.col("start"))).over(before), F.lit(0))
    return spans.withColumn("output_start", (F.col("start") + moved).cast("int")).withColumn("output_end", F.col("output_start") + F.length("marker"))


def splice(text: Column, parts: Column, start: str = "start", end: str = "end", new: str = "marker") -> Column:
    """Built-in splice for short texts: parts is an array of structs sorted by start, without overlaps."""
    bounds = F.transform(parts, lambda x, i: F.concat(F.substring(text, F.when(i == 0, 1).otherwise(F.get(parts, i - 1)[end] + 1), x[start] - F.when(i == 0, 0).otherwise(F.get(parts, i - 1)[end])), x[new]))
    tail = F.when(F.size(parts) > 0, F.substring(text, F.element_at(parts, -1)[end] + 1, F.length(text))).otherwise(text)
    return F.concat(F.array_join(bounds, ""), tail)


def _splicer(checked: bool = False):
    """Replace parts of texts, in time linear in both; if ``checked`` each part must stand at its place, in any case."""

    def run(texts: pa.Array, starts: pa.Array, ends: pa.Array, news: pa.Array, olds=None) -> pa.Array:
        sizes = starts.value_lengths().to_pylist()
        starts, ends, news, olds = (listed(x.flatten()) for x in (starts, ends, news, olds if checked else news))
        out, last = [], 0
        for text, n in zip(listed(texts), sizes, strict=True):
            first, last = last, last + (n or 0)
            if text is None or not n:
                out.append(text)
                continue
            pieces, done = [], 0
            for k in range(first, last):
                s = starts[k]
                if s < done:
                    raise ValueError("replacements overlap")
                if checked and text[s : ends[k]] != olds[k] and text[s : ends[k]].upper() != olds[k].upper():
                    raise ValueError("a marker is not at its place")
                pieces += (text[done:s], news[k])
                done = ends[k]
            pieces.append(text[done:])
            out.append("".join(pieces))
        return pa.array(out, pa.string())

    return F.arrow_udf((lambda t, s, e, n, o: run(t, s, e, n, o)) if checked else (lambda t, s, e, n: run(t, s, e, n)), "string")


def splice_long(text: Column, parts: Column) -> Column:
    """Splice of any length: parts is an array of structs (start, end, marker) sorted by start."""
    return _splicer()(text, parts["start"], parts["end"], parts["marker"])


def restore_long(text: Column, parts: Column) -> Column:
    """Check and undo replacements: parts sorted by output_start, with original and marker. Other fields of them are not read."""
    return _splicer(True)(text, parts["output_start"], parts["output_end"], parts["original"], parts["marker"])


def apply_replacements(artifacts: DataFrame, spans: DataFrame, doc: str | list[str] = "artifact_id", text: str = "text") -> DataFrame:
    """artifacts with ``masked``: every span replaced by its marker. spans: doc, start, end, marker; equal spans count once."""
    parts = spans.groupBy(*_keys(doc)).agg(F.array_sort(F.collect_set(F.struct("start", "end", "marker"))).alias("_parts"))
    return _attach(artifacts, parts, doc).withColumn("masked", splice_long(F.col(text), F.col("_parts"))).drop("_parts")


def apply_with_manifest(artifacts: DataFrame, spans: DataFrame, doc: str | list[str] = "artifact_id", text: str = "text") -> DataFrame:
    """``apply_replacements`` and ``manifest`` by one grouping of the spans and one join: ``masked`` and ``replacements``, which ``exact_restore`` reads.

    spans: doc, start, end, original, marker; equal spans count once. A text without spans has null replacements.
    """
    parts = spans.groupBy(*_keys(doc)).agg(F.array_sort(F.collect_set(F.struct("start", "end", "original", "marker"))).alias("_parts"))
    moved = running_sums(F.transform("_parts", lambda x: F.length(x["marker"]) - (x["end"] - x["start"])))
    rows = _attach(artifacts, parts, doc).withColumn("masked", splice_long(F.col(text), F.col("_parts"))).withColumn("_moved", moved)
    out_end = lambda x, i: x["end"] + F.get("_moved", i)
    placed = F.transform("_parts", lambda x, i: F.struct((out_end(x, i) - F.length(x["marker"])).alias("output_start"), out_end(x, i).alias("output_end"), x["original"].alias("original"), x["marker"].alias("marker")))
    return rows.withColumn("replacements", placed).drop("_parts", "_moved")


def exact_restore(masked: DataFrame, replacements: DataFrame | None = None, doc: str | list[str] = "artifact_id") -> DataFrame:
    """The source texts from masked ones: each marker is checked at its place and gives way to its own lexeme.

    Without ``replacements`` the texts carry them, as the engine's do, and nothing is shuffled.
    """
    if replacements is None:
        return masked.withColumn("restored", restore_long(F.col("masked"), F.col("replacements")))
    parts = replacements.groupBy(*_keys(doc)).agg(F.array_sort(F.collect_set(F.struct("output_start", "output_end", "original", "marker"))).alias("_parts"))
    return _attach(masked, parts, doc).withColumn("restored", restore_long(F.col("masked"), F.col("_parts"))).drop("_parts")


def restore_answers(answers: DataFrame, symbols: DataFrame, case: str = "case_id", text: str = "text") -> DataFrame:
    """answers with ``restored`` (known markers, in any case, give way to the first-seen lexeme), ``n_restored``, and ``unknown`` (other markers of the case's prefix, sorted).

    Answers are told apart by row, so ids may repeat or be null; those of a null or unknown case come back as they are.
    """
    rows = written(answers.withColumn("_row", F.monotonically_increasing_id()))
    found = token_rows(rows, ["_row", case], text, "(?i)" + f"[A-Za-z0-9_]*{MARKER}[A-Za-z0-9_]*").where(F.upper("token").startswith("OBF_"))
    known = symbols.groupBy(case, F.upper("marker").alias("_u")).agg(F.min_by("preferred_original", "sequence").alias("preferred_original"))
    prefixes = known.groupBy(case).agg(F.min(F.split("_u", "_")[1]).alias("_prefix"))
    hits = found.withColumn("_u", F.upper("token")).join(known, [case, "_u"], "left").join(prefixes, case)
    own = F.col("_u").startswith(F.concat(F.lit("OBF_"), F.col("_prefix"), F.lit("_")))
    part = F.struct("start", "end", F.col("preferred_original").alias("marker"))
    per = hits.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when(F.col("preferred_original").isNotNull(), part))).alias("_parts"),
        F.array_sort(F.collect_set(F.when(F.col("preferred_original").isNull() & own, F.col("token")))).alias("unknown"),
    )
    joined = rows.join(per, "_row", "left").withColumn("restored", splice_long(F.col(text), F.col("_parts")))
    return joined.withColumn("n_restored", F.coalesce(F.size("_parts"), F.lit(0))).withColumn("unknown", F.coalesce("unknown", F.expr("cast(array() as array<string>)"))).drop("_parts", "_row")


def restore_compact(answers: DataFrame, symbols: DataFrame, case: str = "case_id", text: str = "text") -> DataFrame:
    """As ``restore_answers`` for compact markers, which carry a checksum: one that does not fit is not restored, known or not.

    ``unknown`` lists, once each and sorted, whatever looks like a marker after restoration, which is every marker left and what an
    original may hold. Null texts stay null with nothing found; answers of a null or unknown case come back as they are.
    """
    rows = written(answers.withColumn("_row", F.monotonically_increasing_id()))
    found = token_rows(rows, ["_row", case], text, COMPACT).withColumn("_u", F.upper("token")).where(short_marker_valid(F.col("_u")))
    known = symbols.groupBy(case, F.upper("marker").alias("_u")).agg(F.min_by("preferred_original", "sequence").alias("preferred_original"))
    part = F.struct("start", "end", F.col("preferred_original").alias("marker"))
    per = found.join(known, [case, "_u"]).groupBy("_row").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    joined = rows.join(per, "_row", "left").withColumn("restored", splice_long(F.col(text), F.col("_parts")))
    left = F.array_sort(F.array_distinct(F.regexp_extract_all("restored", F.lit(LOOKALIKE), F.lit(0))))
    nothing = F.expr("cast(array() as array<string>)")
    return joined.withColumn("n_restored", F.coalesce(F.size("_parts"), F.lit(0))).withColumn("unknown", F.coalesce(left, nothing)).drop("_parts", "_row")


def mask_questions(questions: DataFrame, symbols: DataFrame, case: str = "case_id", text: str = "text", **limits) -> DataFrame:
    """questions with ``masked``: whole names of known symbols, of one word or any other form and in any case, give way to their markers.

    Names that are no word go first, longest first, then words beside them. Own markers are words of their own and stay.
    """
    found = names.with_hits(questions, symbols, case, text, "_hits", **limits)
    return found.withColumn("masked", names.replace_hits(F.col(text), F.col("_hits"))).drop("_hits")


def leak_findings(masked: DataFrame, symbols: DataFrame, doc: str | list[str] = "artifact_id", case: str = "case_id", text: str = "masked", **limits) -> DataFrame:
    """possible_unmasked_symbol, once per text, type and name of any form, with its first place."""
    keys = _keys(doc)
    found = names.with_hits(masked.select(*dict.fromkeys([*keys, case, text])), symbols, case, text, "_hits", **limits)
    hits = found.select(*keys, F.explode("_hits").alias("h")).select(*keys, "h.entity_type", "h.word", "h.start")
    return hits.groupBy(*keys, "entity_type", "word").agg(F.min("start").alias("start")).withColumn("code", F.lit("possible_unmasked_symbol"))


def collision_findings(sources: DataFrame, cases: DataFrame, doc: str | list[str] = "artifact_id", case: str = "case_id", text: str = "text") -> DataFrame:
    """input_marker_collision: sources that already hold the case's prefix."""
    joined = sources.join(cases.select(case, "prefix").distinct(), case)
    return joined.where(F.contains(F.upper(text), F.concat(F.lit("OBF_"), F.upper("prefix"), F.lit("_")))).select(*_keys(doc), F.lit("input_marker_collision").alias("code"))


def validation_status(n_findings: Column, has_prompt: Column) -> Column:
    return F.when(~has_prompt, "pending").when(n_findings > 0, "warning").otherwise("ok")
