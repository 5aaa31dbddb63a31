"""Structured Streaming over the batch operators: a symbol registry that grows with its stream, and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import symbols

NEW_SYMBOL = "case_id long, entity_type string, canonical string, preferred_original string, sequence int, confidence double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Registrar(StatefulProcessor):
    """The symbols of a case: which keys have numbers, and the last number given. State is read and written key by key, so a batch costs what it brings."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "entity_type string, canonical string", "sequence int")
        self.last = handle.getValueState("last", "sequence int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen: dict[tuple[str, str], tuple] = {}
        for part in rows:
            for kind, canonical, position, start, original, sure in part[["entity_type", "canonical", "position", "start", "original", "confidence"]].itertuples(index=False):
                place = (position, start, original, sure)
                held = seen.get((kind, canonical))
                seen[kind, canonical] = place if held is None else (*min(held, place)[:3], max(held[3], sure))
        fresh = sorted((place[:2], name, place[2:]) for name, place in seen.items() if not self.known.containsKey(name))
        number = self.last.get()[0] if self.last.exists() else 0
        out = []
        for _, (kind, canonical), (original, sure) in fresh:
            number += 1
            self.known.updateValue((kind, canonical), (number,))
            out.append((key[0], kind, canonical, original, number, sure))
        if out:
            self.last.update((number,))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in NEW_SYMBOL.split(", ")])

    def close(self) -> None:
        pass


def registry_stream(spans_stream: DataFrame) -> DataFrame:
    """New symbols as their spans arrive: case_id, entity_type, canonical, preferred_original, sequence, confidence, each key of a case once.

    Within a batch numbers follow the first appearance (position, start); a late row whose key is known gets nothing new, another
    the next number, and no number is given twice. State commits with the batch, so a replayed batch gives the same numbers.
    Rows of a null case are left out. The session must keep state in RocksDB (``use_rocksdb``).
    """
    rows = spans_stream.where("case_id is not null").select("case_id", "entity_type", "canonical", F.col("position").cast("long"), F.col("start").cast("long"), "original", "confidence")
    return rows.groupBy("case_id").transformWithStateInPandas(statefulProcessor=Registrar(), outputStructType=NEW_SYMBOL, outputMode="Append", timeMode="None")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def keep_registry(spans_stream: DataFrame, cases: DataFrame, path: str, checkpoint: str):
    """Append the stream's new symbols with their markers to a table of files at ``path``: a batch writes its own symbols only."""
    use_rocksdb(spans_stream.sparkSession)
    prefixes = cases.groupBy("case_id").agg(F.min("prefix").alias("prefix"))
    named = registry_stream(spans_stream).join(prefixes, "case_id").withColumn("marker", symbols.marker(F.col("prefix"), F.col("entity_type"), F.col("sequence"))).drop("prefix")
    return named.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts per window and key; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
