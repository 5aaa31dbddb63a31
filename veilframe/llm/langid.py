"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (one to three letters, words bounded by a mark) in
rank order. A document's own most frequent n-grams are compared to every profile by the out-of-place
distance: the sum over its n-grams of how far apart the two ranks are, a missing n-gram counting as the
profile length. The nearest profile wins; equal distances go to the first language by name.

Profiles are counted over at most ``TRAIN_DOCS`` training documents (drawn by hash, expected number), whole texts.
Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was learned.
Rows that repeat an id are predicted each; no documents give no rows; other columns pass through ``identify``, those named
like its results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRAIN_DOCS = 50_000
PROFILE = 400  # n-grams of a language
OWN = 300  # n-grams of a document
CODES = 1 << 20  # n-grams of a language that a task holds before it counts them
UNKNOWN = "und"
_EDGE = 1  # the word boundary, as a code point that no letter has
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def ngram_codes(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a text: up to three code points of 21 bits each."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    is_letter = letters()[points.astype(np.int64)]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    points = np.where(is_letter, points, _EDGE).astype(np.uint64)
    keep = np.ones(len(points), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    s = np.concatenate([[_EDGE], points[keep], [_EDGE]]).astype(np.uint64)
    edge = s == _EDGE
    two = (s[:-1] << np.uint64(21) | s[1:])[~(edge[:-1] & edge[1:])]
    three = (s[:-2] << np.uint64(42) | s[1:-1] << np.uint64(21) | s[2:])[~edge[1:-1]]
    return np.concatenate([s[~edge], two, three])


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, in rank order; ties by code."""
    codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(codes)))
    if len(counts) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        some = np.flatnonzero(counts >= least)
        starts, counts = starts[some], counts[some]
    return codes[starts[np.argsort(-counts, kind="stable")[:most]]]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.languages = sorted(profiles)
        self.size = size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.uint64))
        self.ranks = np.full((len(self.codes) + 1, len(self.languages)), -1, np.int32)  # the last row: in no profile
        for j, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, np.array(profiles[name], np.uint64)), j] = np.arange(len(profiles[name]))

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (1 - its distance / the largest possible) and margin (1 - its distance / the runner-up's)."""
        own = ranked(ngram_codes(text), OWN)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0, 0.0
        at = np.searchsorted(self.codes, own)
        at = np.where((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == own), at, len(self.codes))
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, self.size, np.minimum(np.abs(theirs - np.arange(len(own))[:, None]), self.size)).sum(axis=0)
        order = np.argsort(apart, kind="stable")
        best = float(apart[order[0]])
        margin = 1 - best / float(apart[order[1]]) if len(order) > 1 and apart[order[1]] else 0.0
        return self.languages[order[0]], 1 - best / (self.size * len(own)), margin


def learn_profiles(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most_docs: int = TRAIN_DOCS, size: int = PROFILE) -> Profiles:
    """Profiles from rows with a text and a language. Their number of entries is languages x size."""
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h")).where("lang is not null and text is not null")
    total = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).count()
    share = int(min(1.0, most_docs / max(1, total)) * (1 << 30))

    def counted_codes(lang: str, some: list[np.ndarray]) -> pa.RecordBatch:
        codes, counts = np.unique(np.concatenate(some), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], names=["lang", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[np.ndarray], int]] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                some, size = held.get(lang.as_py(), ([], 0))
                some.append(codes := ngram_codes(text.as_py()))
                held[lang.as_py()] = some, size + len(codes)
                if size + len(codes) > CODES:
                    yield counted_codes(lang.as_py(), held.pop(lang.as_py())[0])
        for lang, (some, _) in held.items():
            yield counted_codes(lang, some)

    counted = rows.where(F.expr(f"pmod(h, {1 << 30}) < {share}")).select("text", "lang").mapInArrow(run, "lang string, code long, n long")
    counted = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "code", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r.lang, r.rank)):
        profiles.setdefault(r.lang, []).append(r.code)
    return Profiles(profiles, size)


def language_of(text: Column, profiles: Profiles) -> Column:
    """struct(lang_pred, score, margin) of a text column."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(profiles)

    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [shared.value.classify(t) for t in texts]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "margin"])

    return F.pandas_udf(classify, "lang_pred string, score double, margin double")(text)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The documents with lang_pred, score and margin added (columns of those names are replaced)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "margin")]
    found = docs.select(*kept, language_of(F.col(text_col), profiles).alias("_veil_lang"))
    return found.select(*kept, "_veil_lang.lang_pred", "_veil_lang.score", "_veil_lang.margin")


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang -> doc_id, held_out, lang_pred, score, margin: learn from the documents that are not held out, predict all."""
    profiles = learn_profiles(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), profiles).drop("text")


def keep_languages(docs: DataFrame, least_score: float) -> DataFrame:
    """The documents, unchanged, without those that are ``und`` or score under ``least_score``."""
    found = docs.withColumn("_veil_lang", language_of(F.col("text"), learn_profiles(docs.where(~held_out()))))
    return found.where((F.col("_veil_lang.lang_pred") != UNKNOWN) & (F.col("_veil_lang.score") >= least_score)).select(*docs.columns)
