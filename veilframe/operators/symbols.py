"""The symbol registry: stable markers per case, numbered by first appearance, never reused."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.vocabulary import CODE
from .scratch import written

PREFIX_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"  # fixed value: no letters or digits that are read for others


def case_prefix(index: Column, size: int = 4) -> Column:
    """A prefix per case index, unique below 32 ** size: the index in base 32 over letters that are not mistaken."""
    digit = lambda k: F.substring(F.lit(PREFIX_LETTERS), (F.shiftright(index, 5 * k) % 32 + 1).cast("int"), F.lit(1))
    return F.concat(*(digit(k) for k in reversed(range(size))))


def entity_code(entity_type: Column) -> Column:
    pairs = [F.lit(x) for kv in CODE.items() for x in kv]
    return F.element_at(F.create_map(*pairs), entity_type)


@F.pandas_udf(StringType())
def checksum(core: pd.Series) -> pd.Series:
    """First two hex digits of the two-byte BLAKE2s of prefix:code:sequence:1. Spark has no BLAKE2s; symbols are few."""
    return core.map(_check_digits)


def _check_digits(core: str) -> str:
    return hashlib.blake2s(core.encode(), digest_size=2).hexdigest()[:2].upper()


def marker_text(prefix: str, entity_type: str, sequence: int) -> str:
    """``marker`` of one symbol."""
    code = CODE[entity_type]
    return f"OBF_{prefix}_{code}_{sequence:04d}_{_check_digits(f'{prefix}:{code}:{sequence}:1')}"


def marker(prefix: Column, entity_type: Column, sequence: Column) -> Column:
    code = entity_code(entity_type)
    core = F.concat_ws(":", prefix, code, sequence.cast("string"), F.lit("1"))
    return F.format_string("OBF_%s_%s_%04d_%s", prefix, code, sequence, checksum(core))


def fnv_byte(text: Column) -> Column:
    """Low byte of the 32-bit FNV-1a of an ASCII string, as two upper-case hex digits, by built-in functions."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    h = F.aggregate(letters, F.lit(2166136261).cast("long"), lambda acc, c: (acc.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.hex(h.bitwiseAND(F.lit(255))), 2, "0")


def short_marker(prefix: Column, entity_type: Column, sequence: Column) -> Column:
    """The compact variant: sequence in base 36, FNV checksum over the rest."""
    core = F.concat_ws("_", prefix, entity_code(entity_type), F.lpad(F.conv(sequence.cast("string"), 10, 36), 4, "0"))
    return F.concat(F.lit("OBF_"), core, F.lit("_"), fnv_byte(core))


def short_marker_valid(text: Column) -> Column:
    """Whether a compact marker's checksum fits its core."""
    core = F.regexp_extract(text, "^OBF_(.*)_[0-9A-F]{2}$", 1)
    return (core != "") & (fnv_byte(core) == F.right(text, F.lit(2)))


def first_seen(spans: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, entity_type, canonical) with the first place, its lexeme and the highest confidence."""
    place = F.struct("position", "start")
    return spans.groupBy(case, "entity_type", "canonical").agg(F.min(place).alias("first"), F.min_by("original", place).alias("preferred_original"), F.max("confidence").alias("confidence"))


def rank_in_group(df: DataFrame, group: str, order: list[str], out: str, few: bool = False) -> DataFrame:
    """1-based rank of each row in its group without bringing a group to one task, unless the caller has found all rows to be ``few``.

    Rows are range-partitioned by (group, order), so a large group spreads over tasks; a row's global
    index is its place in the partition plus the rows of the partitions before; the rank is its distance
    from the group's first index. The order must be total.
    """
    if few:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_m", F.monotonically_increasing_id())
    rows = written(rows)  # else every use below could draw other range bounds
    rows = rows.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sizes.select("_part", before.alias("_base"))), "_part").withColumn("_g", F.col("_base") + F.col("_at"))  # a row per partition
    firsts = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_g").alias("_first"))
    ranked = rows.join(firsts, rows[group].eqNullSafe(firsts["_group"]))
    return ranked.withColumn(out, (F.col("_g") - F.col("_first") + 1).cast("int")).select(*df.columns, out)


def unique_symbols(registry: DataFrame, case: str = "case_id") -> DataFrame:
    """A registry whose keys are there once: of repeated ones the lowest sequence stays."""
    key = [case, "entity_type", "canonical"]
    rest = [c for c in registry.columns if c not in key]
    return registry.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("sequence", "marker")).alias("_r")).select(*key, "_r.*")


def register(spans: DataFrame, cases: DataFrame, existing: DataFrame | None = None, case: str = "case_id") -> DataFrame:
    """The registry after these spans (case, position, start, entity_type, canonical, original, confidence)."""
    return register_keys(first_seen(spans, case), cases, existing, case)


def register_keys(seen: DataFrame, cases: DataFrame, existing: DataFrame | None = None, case: str = "case_id", few: bool = False) -> DataFrame:
    """The registry after these keys: existing symbols (confidence raised to the highest seen) and new ones.

    seen: case, entity_type, canonical, first (place), preferred_original, confidence; a key may come several times, as it
    does after types were adopted. New symbols are numbered on from the case's highest sequence in the order of first
    appearance. ``cases``: case, prefix; equal rows are one, and a case with none has no symbols: what it would have named
    stays without a marker, which the engine withholds. ``few``: the keys fit one task, as their measured size says. Columns: case, entity_type, canonical, preferred_original, sequence, confidence, marker.
    """
    key = [case, "entity_type", "canonical"]
    seen = seen.where(F.col(case).isNotNull()).groupBy(*key).agg(F.min("first").alias("first"), F.min_by("preferred_original", "first").alias("preferred_original"), F.max("confidence").alias("confidence"))
    prefixes = cases.groupBy(case).agg(F.min("prefix").alias("prefix"))
    if existing is None:
        fresh, last, kept = seen, None, None
    else:
        fresh = seen.join(existing.select(*key), key, "left_anti")
        last = existing.groupBy(case).agg(F.max("sequence").alias("_last"))
        raised = seen.select(*key, F.col("confidence").alias("_seen"))
        kept = existing.join(raised, key, "left").withColumn("confidence", F.greatest("confidence", "_seen")).drop("_seen")
    fresh = fresh.join(prefixes, case)
    fresh = rank_in_group(fresh.withColumn("_p", F.col("first.position")).withColumn("_s", F.col("first.start")), case, ["_p", "_s", "entity_type", "canonical"], "sequence", few).drop("_p", "_s", "first")
    if last is not None:
        fresh = fresh.join(last, case, "left").withColumn("sequence", (F.col("sequence") + F.coalesce("_last", F.lit(0))).cast("int")).drop("_last")
    fresh = fresh.withColumn("marker", marker(F.col("prefix"), F.col("entity_type"), F.col("sequence"))).drop("prefix")
    columns = [*key, "preferred_original", "sequence", "confidence", "marker"]
    return fresh.select(*columns) if kept is None else kept.select(*columns).unionByName(fresh.select(*columns))


def validate_mapping(symbols: DataFrame, case: str = "case_id") -> DataFrame:
    """Problems of a mapping: bad markers, and markers, sequences or keys that occur twice in a case."""
    bad = symbols.where(~F.col("marker").rlike("^OBF_[A-Z0-9]{1,8}_[A-Z]{2,5}_[0-9A-Z]{4,}_[0-9A-F]{2}$")).select(case, F.lit("bad_marker").alias("problem"), F.col("marker").alias("what"))
    out = bad
    for name, columns in (("marker", ["marker"]), ("sequence", ["sequence"]), ("key", ["entity_type", "canonical"])):
        twice = symbols.groupBy(case, *columns).count().where("count > 1")
        out = out.unionByName(twice.select(case, F.lit(f"duplicate_{name}").alias("problem"), F.concat_ws("|", *(F.col(c).cast("string") for c in columns)).alias("what")))
    return out


def merge_mappings(target: DataFrame, source: DataFrame, case: str = "case_id") -> DataFrame:
    """The target's symbols and those of the source whose markers it lacks."""
    return target.unionByName(source.join(target.select(case, "marker"), [case, "marker"], "left_anti").select(*target.columns))


def mapping_cases(symbols: DataFrame, case: str = "case_id") -> DataFrame:
    """The cases that have a mapping."""
    return symbols.select(case).distinct()


def clear_mappings(symbols: DataFrame, doomed: DataFrame | None = None, case: str = "case_id") -> DataFrame:
    """What is left when the mappings of the ``doomed`` cases are cleared, or of all cases without it."""
    return symbols.where(F.lit(False)) if doomed is None else symbols.join(doomed.select(case), case, "left_anti").select(*symbols.columns)


def touched(registry: DataFrame, existing: DataFrame, used: DataFrame, now: Column, case: str = "case_id") -> DataFrame:
    """registry with ``last_used_at``: where a run used any symbol that the case had, all of the case's symbols were used now; else new ones were, and the others stay.

    existing: case, marker, last_used_at; used: case, marker.
    """
    again = existing.join(used.select(case, "marker"), [case, "marker"], "left_semi").select(case).distinct().withColumn("_again", F.lit(True))
    old = existing.select(case, "marker", F.col("last_used_at").alias("_old"))
    joined = registry.join(old, [case, "marker"], "left").join(again, case, "left")
    return joined.withColumn("last_used_at", F.when(F.col("_again"), now).otherwise(F.coalesce("_old", now))).select(*registry.columns, "last_used_at")
