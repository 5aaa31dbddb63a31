"""The engine's operators as SQL functions of a session.

Scalars: veil_kind(text); veil_spans(text), JSON; veil_keys(text), the distinct types and keys of its spans; veil_obfuscate(text, mapping); veil_restore(text, mapping); veil_html_markdown(html);
veil_plain_markdown(text). Table function: veil_spans(text), a row per span, for ``FROM texts, LATERAL veil_spans(text)``.

A mapping to obfuscate with is a map from ``entity_type || ':' || canonical`` to the marker; a text with a span that it lacks is
withheld whole. A mapping to restore with is a map from marker to lexeme; markers are found whole and in any case, others stay.
Null texts stay null, a null mapping is empty; the spans and keys of a null text are none.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SPAN_COLUMNS = "start int, end int, entity_type string, canonical string, original string, reader string, confidence double, form string"
_MARKER = re.compile(r"(?<![A-Za-z0-9_])OBF_[A-Za-z0-9_]+", re.I)


def register(spark: SparkSession) -> None:
    from ..operators import answers
    from ..operators.detection import kind_of, parse

    def kinds(texts: pa.Array) -> pa.Array:
        return pa.array([kind_of(t or "") for t in texts.to_pylist()], pa.string())

    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([json.dumps([[s.start, s.end, s.entity_type] for s in parse(t or "").spans]) for t in texts.to_pylist()], pa.string())

    spark.udf.register("veil_kind", F.arrow_udf(kinds, "string"))
    spark.udf.register("veil_spans", F.arrow_udf(spans, "string"))
    spark.udf.register("veil_keys", F.arrow_udf(_keys, "array<struct<entity_type:string,canonical:string>>"))
    spark.udf.register("veil_obfuscate", F.arrow_udf(_obfuscate, "string"))
    spark.udf.register("veil_restore", F.arrow_udf(_restore, "string"))
    spark.udf.register("veil_html_markdown", answers.html_markdown)
    spark.udf.register("veil_plain_markdown", answers.plain_markdown)
    spark.udtf.register("veil_spans", F.udtf(SpanRows, returnType=SPAN_COLUMNS))


class SpanRows:
    """The spans of one text as rows."""

    def eval(self, text: str):
        from ..operators.detection import parse

        yield from (tuple(s) for s in parse(text or "").spans)


def _pairs(maps: pa.Array) -> list[dict]:
    from ..operators.model import listed

    pairs, out, last = maps.cast(pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))), [], 0
    flat = pairs.flatten()
    keys, values = listed(flat.field(0)), listed(flat.field(1))
    for n in pairs.value_lengths().to_pylist():
        first, last = last, last + (n or 0)
        out.append(dict(zip(keys[first:last], values[first:last], strict=True)))
    return out


def _keys(texts: pa.Array) -> pa.Array:
    from ..operators.detection import parse
    from ..operators.model import listed

    types, keys, bounds = [], [], [0]
    for text in listed(texts):
        found = parse(text or "")
        for kind, key in dict.fromkeys(zip(found.types, found.keys, strict=True)):
            types.append(kind)
            keys.append(key)
        bounds.append(len(types))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(types, pa.string()), pa.array(keys, pa.string())], ["entity_type", "canonical"]))


def _obfuscate(texts: pa.Array, mappings: pa.Array) -> pa.Array:
    from ..operators.detection import parse
    from ..operators.engine import WITHHELD

    out = []
    for text, known in zip(texts.to_pylist(), _pairs(mappings), strict=True):
        pieces, at = [], 0
        found = parse(text or "")
        for start, end, kind, key in zip(found.starts, found.ends, found.types, found.keys, strict=True):
            marker = known.get(f"{kind}:{key}")
            if marker is None:
                pieces, at, text = [WITHHELD], 0, ""
                break
            pieces += [text[at:start], marker]
            at = end
        out.append(None if text is None else "".join([*pieces, text[at:]]))
    return pa.array(out, pa.string())


def _restore(texts: pa.Array, mappings: pa.Array) -> pa.Array:
    out = []
    for text, known in zip(texts.to_pylist(), _pairs(mappings), strict=True):
        upper = {k.upper(): v for k, v in known.items() if v is not None}
        out.append(None if text is None else _MARKER.sub(lambda m: upper.get(m[0].upper(), m[0]), text))
    return pa.array(out, pa.string())
