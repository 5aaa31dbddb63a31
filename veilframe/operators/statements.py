"""Which known statement a shown one is, continues, or is cut from, for any number of both at once.

Two statements are one if their tokens are equal, or if one is the other cut off: at least ``MIN_TOKENS`` tokens agree and the
last of them may itself be cut, or at least ``MIN_RAW`` characters of the texts without spaces and comments agree to the end of
the shorter. Both forms of "cut off" are prefixes of a string, so all of them come out of one sort: range partitions are read
in order with a stack of open prefixes, which is as deep as prefixes of one statement are nested. No pair of statements is
compared, and a beginning that a third of all statements share spreads over tasks like any other range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .scratch import spread, written
from .sql_text import statement_identity

MIN_TOKENS = 12
MIN_RAW = 80
UNIT = "\x1f"
_TYPES = (("S", "^[nN]?[qQ]?'"), ("Q", '^"'), ("H", r"^/\*\+"), ("N", "^[0-9]+([.][0-9]+)?$"), ("W", "^[A-Za-z0-9_$#]"))


def typed_tokens(identity: Column) -> Column:
    """The tokens of a ``statement_identity`` as TYPE:VALUE: S literal, Q quoted name, H hint, N number, W word, P sign."""
    tokens = F.filter(F.split(identity, UNIT), lambda t: t != "")

    def typed(t: Column) -> Column:
        kind = F.lit("P")
        for name, pattern in reversed(_TYPES):
            kind = F.when(t.rlike(pattern), name).otherwise(kind)
        return F.concat(kind, F.lit(":"), t)

    return F.transform(tokens, typed)


def raw_signature(identity: Column) -> Column:
    """The tokens without anything between them, hints without spaces: what survives other cuts into tokens."""
    bare = F.transform(F.split(identity, UNIT), lambda t: F.when(t.startswith("/*+"), F.regexp_replace(t, r"\s", "")).otherwise(t))
    return F.array_join(bare, "")


def signatures(statements: DataFrame, text: str = "text") -> DataFrame:
    """statements with ``tokens`` (joined by unit separators), ``n_tokens`` and ``raw``. Null and empty texts have none: null."""
    known = statements.withColumn("_i", statement_identity(F.translate(F.col(text), UNIT, " ")))
    parted = known.withColumns({"_t": typed_tokens(F.col("_i")), "raw": raw_signature(F.col("_i"))}).drop("_i")  # a projection for each step, so that none is computed twice
    some = F.size("_t") > 0
    return parted.withColumns({"tokens": F.when(some, F.array_join("_t", UNIT)), "n_tokens": F.when(some, F.size("_t")), "raw": F.when(some, F.col("raw"))}).drop("_t")


def _shared(a: str, b: str) -> int:
    """Leading characters that two strings share, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


_SWEPT = "what string, block int, id long, other long, length long, first string, last string"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range of keys. Rows out, by ``what``:

    under: key ``id`` and the longest known key ``other`` that begins it; without one, ``length`` characters shared with the range's first key.
    into: key ``id`` and the next known key ``other``, which it begins.
    begun, cut: keys still open at the end, known or waiting, with their lengths.
    known: the range's first known key and its characters shared with the first key. edge: first and last key, and what they share.
    """
    from pyspark import TaskContext

    block = TaskContext.get().partitionId()
    schema = pa.schema([("what", pa.string()), ("block", pa.int32()), ("id", pa.int64()), ("other", pa.int64()), ("length", pa.int64()), ("first", pa.string()), ("last", pa.string())])
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)
    first = last = None
    begun, cut = [], []  # (length, id) of known keys, and of others that no known key has followed; all begin the last key
    met_known, same = False, 0
    for b in batches:
        out = []
        for i, key, known, fits in zip(*(b.column(c).to_pylist() for c in ("id", "key", "known", "fits")), strict=True):
            if first is None:
                first, same = key, len(key)
            else:
                n = _shared(last, key)
                same = min(same, n)
                for stack in (begun, cut):
                    while stack and stack[-1][0] > n:
                        stack.pop()
            last = key
            out.append(("under", block, i, begun[-1][1] if begun else None, 0 if begun else same, None, None))
            if known:
                out += [("into", block, k, i, None, None, None) for _, k in cut]
                cut.clear()
                if not met_known:
                    met_known = True
                    out.append(("known", block, i, None, same, None, None))
            if fits:
                (begun if known else cut).append((len(key), i))
        if out:
            yield pack(out)
    if first is not None:
        ends = [("begun", block, i, None, n, None, None) for n, i in begun] + [("cut", block, i, None, n, None, None) for n, i in cut]
        yield pack([*ends, ("edge", block, None, None, same, first, last)])


@F.arrow_udf(LongType())
def _bridge(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else _shared(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())


def _over_edges(swept: DataFrame) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """What passes from range to range: (block, length, id) of known keys open where a block begins, and (id, known id) of waiting keys that a later block's first known key follows.

    The driver sees numbers only: a few for each range and for each key nested across its edge.
    """
    edges = swept.where("what = 'edge'").select("block", "first", "last", "length")
    numbers = {r.block: i for i, r in enumerate(edges.select("block").sort("block").collect())}
    order = swept.sparkSession.createDataFrame([(b, i) for b, i in numbers.items()] or [(-1, -1)], "block int, at int")
    placed = edges.join(F.broadcast(order), "block")  # a row a range
    before = placed.select((F.col("at") + 1).alias("at"), F.col("last").alias("_last"))
    joints = placed.join(before, "at", "left").select("block", "length", _bridge("_last", "first").alias("bridge")).collect()
    ends: dict[tuple[str, int], list] = {}
    for r in swept.where("what IN ('begun', 'cut', 'known')").select("what", "block", "length", "id").collect():
        ends.setdefault((r.what, r.block), []).append((r.length, r.id))
    carried, met = [], []
    begun, cut = [], []
    for r in sorted(joints, key=lambda r: r.block):
        begun, cut = ([x for x in stack if x[0] <= (r.bridge or 0)] for stack in (begun, cut))
        carried += [(r.block, n, i) for n, i in begun]
        for at, known in ends.get(("known", r.block), ()):
            met += [(i, known) for n, i in cut if n <= at]
            cut = []  # keys after a known one that they do not begin begin none
        begun, cut = ([*(x for x in stack if x[0] <= r.length), *ends.get((what, r.block), ())] for what, stack in (("begun", begun), ("cut", cut)))
    return carried, met


def prefix_links(keys: DataFrame) -> DataFrame:
    """(id, under, into) for keys (id, key, known, fits): the longest known key that begins this one and is not it, and the first known key in order that this one begins.

    Keys are distinct; only those that fit may be the shorter of two. ``into`` is found for keys that are not known.
    """
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    swept = written(keys.select("id", "key", "known", "fits").repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(_sweep, _SWEPT))
    carried, met = _over_edges(swept)
    over = spark.createDataFrame(carried, "block int, length long, id long").groupBy("block").agg(F.collect_list(F.struct("length", F.col("id").alias("key_id"))).alias("_open"))
    under = swept.where("what = 'under'").select("block", "id", "other", "length").join(F.broadcast(over), "block", "left")  # numbers of keys nested across an edge
    reach = F.array_max(F.filter("_open", lambda x: x["length"] <= F.col("length")))["key_id"]
    under = under.select("id", F.coalesce("other", reach).alias("under"))
    into = swept.where("what = 'into'").select("id", F.col("other").alias("into")).unionByName(spark.createDataFrame(met, "id long, into long"))
    return under.join(into, "id", "left")


def _matched(statements: DataFrame, key: str, fits: Column, same_fits_only: bool) -> DataFrame:
    """(key, case, how) for the distinct values of a signature; null where nothing matches."""
    found = statements.groupBy(F.col(key).alias("key")).agg(F.min("_case").alias("_case"), F.first(fits).alias("fits"))
    base = written(found.withColumn("known", F.col("_case").isNotNull()).withColumn("id", F.monotonically_increasing_id()))
    links = prefix_links(base)
    case_of = lambda name: base.where("known").select(F.col("id").alias(name), F.col("_case").alias(f"_{name}"))
    joined = base.join(links, "id").join(case_of("under"), "under", "left").join(case_of("into"), "into", "left")
    same = F.when(F.col("fits") | F.lit(not same_fits_only), F.col("_case"))
    how = F.when(same.isNotNull(), "same").when(F.col("_under").isNotNull(), "continues").when(F.col("_into").isNotNull(), "cut_off")
    return joined.select("key", F.coalesce(same, "_under", "_into").alias("found"), how.alias("how"))


def match_statements(shown: DataFrame, known: DataFrame, text: str = "text", case: str = "case_id") -> DataFrame:
    """shown with ``matched_case`` and ``match``: the case in ``known`` (case, text) whose statement each shown text is.

    By tokens first, then by the raw text: ``same``; ``continues``, of the longest known statement that begins it; ``cut_off``, of the
    first known statement in the order of signatures that it begins. Statements of several cases count for the smallest. Both
    columns are null where no case matches, as for null and empty texts; known rows without a case or a statement are left out. Rows
    of ``shown`` may repeat and keep all their columns, except two of these names.
    """
    rows = written(signatures(spread(shown).drop("matched_case", "match").withColumn("_text", F.col(text)), "_text").withColumnsRenamed({"tokens": "_tokens", "n_tokens": "_n", "raw": "_raw"}).drop("_text"))
    told = signatures(known.where(F.col(case).isNotNull()).select(F.col(case).alias("_case"), F.col(text).alias("_text")), "_text").select("_case", F.col("tokens").alias("_tokens"), F.col("n_tokens").alias("_n"), F.col("raw").alias("_raw"))
    every = told.unionByName(rows.select(F.lit(None).cast(told.schema["_case"].dataType).alias("_case"), "_tokens", "_n", "_raw")).where("_tokens IS NOT NULL")
    every = written(every.groupBy("_tokens").agg(F.min("_case").alias("_case"), F.first("_n").alias("_n"), F.first("_raw").alias("_raw")))
    by_tokens = _matched(every, "_tokens", F.col("_n") >= MIN_TOKENS, False).select(F.col("key").alias("_tokens"), F.col("found").alias("_a"), F.col("how").alias("_b"))
    by_raw = _matched(every, "_raw", F.length("_raw") >= MIN_RAW, True).select(F.col("key").alias("_raw"), F.col("found").alias("_c"), F.col("how").alias("_d"))
    answer = written(every.select("_tokens", "_raw").join(by_tokens, "_tokens").join(by_raw, "_raw").select("_tokens", F.coalesce("_a", "_c").alias("matched_case"), F.coalesce("_b", "_d").alias("match")))
    return rows.join(answer, "_tokens", "left").drop("_tokens", "_n", "_raw")
