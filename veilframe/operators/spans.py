"""Span algebra on columns and rows: offsets of regex matches, lines, cells, deduplication, overlap, reconciliation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import settle_order

LINE = "[^\\n]*\\n|[^\\n]+$"


def _running(lengths: pa.Array) -> pa.Array:
    """Running sums within each list."""
    bounds = lengths.offsets.to_numpy() - lengths.offsets[0].as_py()
    total = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(total[1:] - np.repeat(total[bounds[:-1]], np.diff(bounds)), pa.int32()))


def running_sums(lengths: Column) -> Column:
    """Running sums of an array of integers, null taken as empty: numbers alone leave the JVM, and no row is shuffled for a sum within itself."""
    return F.arrow_udf(_running, "array<int>")(F.coalesce(lengths, F.expr("cast(array() as array<int>)")))


def token_rows(df: DataFrame, keys: list[str], text: str, pattern: str, around: bool = False) -> DataFrame:
    """A row per match of ``pattern`` (which must not match the empty string): keys, i (from 0), token, start, end; with ``around`` also the characters before and after.

    Matches and the gaps between them come from built-in functions; running sums of their lengths give code-point offsets. Rows
    that share keys stay apart, and no row leaves its task.
    """
    parts = df.select(*keys, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("_tok"), F.split(text, pattern, -1).alias("_gap"))
    zipped = ["_tok", "_gap"]
    if around:
        later = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
        parts = parts.withColumns({"_past": F.concat(F.array(F.lit("")), "_tok"), "_next": later("_gap"), "_then": later("_tok")})
        zipped += ["_past", "_next", "_then"]
    ends = running_sums(F.transform("_tok", lambda t, i: F.length(F.get("_gap", i)) + F.length(t)))
    rows = parts.withColumn("_end", ends).select(*keys, F.posexplode(F.arrays_zip(*zipped, "_end")).alias("i", "_x")).where(F.col("_x._tok").isNotNull())
    beside = []
    if around:
        beside = [F.expr("right(if(_x._gap = '', _x._past, _x._gap), 1)").alias("before"), F.expr("left(if(_x._next = '', coalesce(_x._then, ''), _x._next), 1)").alias("after")]
    return rows.select(*keys, "i", F.col("_x._tok").alias("token"), (F.col("_x._end") - F.length("_x._tok")).alias("start"), F.col("_x._end").alias("end"), *beside)


def trimmed_bounds(text: Column) -> Column:
    """struct(start, end) of the text without outer white space; null if none is left."""
    lead = F.length(text) - F.length(F.regexp_replace(text, r"(?U)^\s+", ""))
    end = F.length(F.regexp_replace(text, r"(?U)\s+$", ""))
    return F.when(text.rlike(r"(?U)\S"), F.struct(lead.cast("int").alias("start"), end.cast("int").alias("end")))


def cell_rows(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """A row per table cell of a line: keys, i (from 0), cell, start, end; cells stand between neighbouring bars."""
    parts = lines.select(*keys, F.split(text, r"\|", -1).alias("_p"))
    ends = running_sums(F.transform("_p", lambda c: F.length(c) + 1))
    rows = parts.withColumn("_e", ends).select(*keys, F.size("_p").alias("_n"), F.posexplode(F.arrays_zip("_p", "_e")).alias("_i", "_x")).where("_i > 0 and _i < _n - 1")
    return rows.select(*keys, (F.col("_i") - 1).alias("i"), F.col("_x._p").alias("cell"), (F.col("_x._e") - F.length("_x._p") - 1).alias("start"), (F.col("_x._e") - 1).alias("end"))


def dedupe_spans(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Of spans at one place the highest priority stays; of equals the first by ``pos``."""
    best = F.row_number().over(Window.partitionBy(doc, "start", "end").orderBy(F.desc("priority"), "pos"))
    return spans.withColumn("_n", best).where("_n = 1").drop("_n")


def _settled(spans: pa.Array) -> pa.Array:
    """Positions of the spans that stay, by the sweep that settles what readers mark."""
    flat = spans.flatten()
    column = lambda c: flat.field(flat.type.get_field_index(c)).to_pylist()
    start, end, rank = column("start"), column("end"), column("priority")
    bounds = spans.offsets.to_numpy() - spans.offsets[0].as_py()
    kept = [settle_order(start[a:b], end[a:b], rank[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return pa.array(kept, pa.list_(pa.int32()))


def fold_overlaps(spans: Column) -> Column:
    """The spans (array of structs start, end, priority, ...) that stay, left to right, none over another; of equal ones the first in the array."""
    kept = F.arrow_udf(_settled, "array<int>")(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["priority"].alias("priority"))))
    return F.transform(kept, lambda k: F.get(spans, k))


def overlap_pairs(spans: DataFrame, doc: str = "doc_id", block: int = 64) -> DataFrame:
    """Pairs of spans of a document that overlap (first < second by id): an equi-join on blocks of positions, kept where the later start lies in the block."""
    blocks = spans.withColumn("_b", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")))
    a = blocks.select(doc, "_b", *(F.col(c).alias(f"a_{c}") for c in ("span_id", "start", "end")))
    b = blocks.select(doc, "_b", *(F.col(c).alias(f"b_{c}") for c in ("span_id", "start", "end")))
    hit = (F.col("a_span_id") < F.col("b_span_id")) & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    once = F.expr(f"greatest(a_start, b_start) div {block}") == F.col("_b")
    return a.join(b, [doc, "_b"]).where(hit & once).select(doc, "a_span_id", "b_span_id")


def reconcile_types(spans: DataFrame, symbols: DataFrame | None = None, case: str = "case_id") -> DataFrame:
    """Untyped identifiers take the only type that their canonical key has elsewhere in the case or among its symbols."""
    voters = spans.select(case, "canonical", "entity_type")
    if symbols is not None:
        voters = voters.unionByName(symbols.select(case, "canonical", "entity_type"))
    known = voters.where(~F.col("entity_type").isin("identifier", "fragment")).groupBy(case, "canonical").agg(F.min("entity_type").alias("_low"), F.max("entity_type").alias("_high"))
    single = known.where("_low = _high").select(case, "canonical", F.col("_low").alias("_only"))
    adopts = (F.col("entity_type") == "identifier") & F.col("_only").isNotNull()
    return spans.join(single, [case, "canonical"], "left").withColumn("entity_type", F.when(adopts, F.col("_only")).otherwise(F.col("entity_type"))).drop("_only").select(*spans.columns)


def expression_tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Predicates lexed by built-in functions only: token rows with entity type (null: stays) and content bounds."""
    rows = token_rows(df, keys, text, EXPRESSION, around=True)
    before, after = F.col("before"), F.col("after")
    first = F.substring("token", 1, 1)
    kind = (
        F.when(first == '"', F.when(before == "@", "query_block").when(after.isin("@", "."), "alias").otherwise("column"))
        .when(first == "'", "string_literal")
        .when(first == ":", "bind")
        .when(F.col("token").rlike("^(SEL|SET|INS|UPD|DEL|MRG)[$]"), "query_block")
        .when(first.rlike("[0-9]"), "number_literal")
        .when((after == "(") & ~F.upper("token").isin("ACCESS", "FILTER", "AND", "OR", "IN", "NOT", *sorted(_functions())), "function")
    )
    quoted = first.isin('"', "'")
    lead = F.when(quoted | (first == ":"), 1).otherwise(0)
    tail = F.when(quoted, 1).otherwise(0)
    original = F.substring(F.col("token"), lead + 1, F.length("token") - lead - tail)
    rows = rows.withColumn("entity_type", kind).withColumn("start", F.col("start") + lead).withColumn("end", F.col("end") - tail)
    return rows.withColumn("original", original).drop("before", "after")


def _functions() -> frozenset[str]:
    from ..functions.vocabulary import FUNCTIONS

    return FUNCTIONS


# Names, literals and words of a predicate; free of look-arounds
EXPRESSION = '"[^"]*"|\'[^\']*\'|:[A-Za-z_][A-Za-z0-9_]*|[A-Za-z_][A-Za-z0-9_$#]*|[0-9]+(?:[.][0-9]+)?'


def canonical_key(original: Column, entity_type: Column) -> Column:
    """Key by which lexemes are one symbol; names in reports count as unquoted when they need no quotes."""
    name = F.when(original.rlike("^[A-Z][A-Z0-9_$#]*$"), F.concat(F.lit("U:"), original)).otherwise(F.concat(F.lit("Q:"), original))
    return F.when(entity_type.isin("string_literal", "comment", "fragment"), original).when(entity_type.isin("number_literal", "datetime_literal"), F.upper(original)).otherwise(name)
