"""From raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written and
read again as the next one's docs. All but the last return the columns of ``documents``.

1. language_id leaves out documents without a letter and those unlike every learned language.
2. near_duplicates keeps the document with the smallest id of each group of near copies: links of texts whose
   five-word shingles have a Jaccard similarity of 0.8 or more.
3. decontamination leaves out documents that the benchmark contaminates; others stay as they are.
4. personal_data replaces personal data, plain or disguised, in the texts and renews n_chars.
5. packing returns the pieces with their places in the sequences.

Null and empty texts have no letter and go in stage 1, like rows of an unknown language. Rows that repeat an id are documents of
their own; of equal or similar texts the smallest id stays, a null id before all, then the row read first. No documents give no
rows at every stage. Columns beside those of ``documents`` pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import Workspace, read_table
from veilframe.llm.decontaminate import decontaminate
from veilframe.llm.langid import keep_languages
from veilframe.llm.packing import pack_documents
from veilframe.llm.pii import redact_documents
from veilframe.llm.simhash import simhash_groups
from veilframe.llm.tokens import default_path

LEAST_SCORE = 0.2  # of a language; a document below it resembles none


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_languages(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered = docs.withColumn("_veil_row", F.monotonically_increasing_id())  # parts rows that repeat an id
    numbered = Workspace(spark, "numbered").table(numbered, "rows")  # read twice, so the numbers must stay
    keyed = numbered.select(F.struct("doc_id", "_veil_row").alias("key"), "text")
    copies = simhash_groups(keyed, "key", words=5, similarity=0.8).where("key <> component_id").select("key._veil_row")
    return numbered.join(copies, "_veil_row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact_documents(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, default_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

# Components of near copies and the packing have no SQL; tests/llm compares every stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
