"""Functions with the semantics of the recognised dialect where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any_null(*columns: Column) -> Column:
    out = columns[0].isNull()
    for c in columns[1:]:
        out = out | c.isNull()
    return out


def greatest(*columns: Column) -> Column:
    """Null if any argument is null."""
    return F.when(~_any_null(*columns), F.greatest(*columns))


def least(*columns: Column) -> Column:
    return F.when(~_any_null(*columns), F.least(*columns))


def empty_is_null(text: Column) -> Column:
    return F.when(text != "", text)


def add_months(date: Column, months) -> Column:
    """The end of a month maps to the end of a month."""
    moved = F.add_months(date, months)
    return F.when(F.to_date(date) == F.last_day(date), F.last_day(moved)).otherwise(moved)


def trunc_number(x: Column, digits: int = 0) -> Column:
    """Towards zero."""
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def bitand(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def ora_hash(x: Column, buckets: int) -> Column:
    """A stable bucket 0..buckets (of another hash than the dialect's)."""
    return F.pmod(F.xxhash64(x), F.lit(buckets + 1))


def decode(x: Column, *pairs: Column) -> Column:
    """Pairs of value and result, and a default if their number is odd; null matches null."""
    default = pairs[-1] if len(pairs) % 2 else F.lit(None)
    out = None
    for value, result in zip(pairs[::2], pairs[1::2], strict=False):
        hit = x.eqNullSafe(value)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out.otherwise(default)


def nvl2(x: Column, present: Column, absent: Column) -> Column:
    return F.when(x.isNotNull(), present).otherwise(absent)


def json_value(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def json_exists(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).isNotNull()


def listagg(column: Column, delimiter: str, order: Column) -> Column:
    """Aggregate: values in the order of ``order``, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), column.alias("v")))), lambda x: x["v"]), delimiter)
