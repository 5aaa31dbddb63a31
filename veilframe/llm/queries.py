"""The registered queries of the corpus operators: thin projections of each operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination, measure

    hits = measure(find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))
    names = F.array_sort(F.array_distinct("items"))
    return hits.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(read_table(spark, sf_dir, "pages")).drop("url", "problem")


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    out = simhash_groups(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import embedding_links

    out = embedding_links(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import scan_personal_data

    return scan_personal_data(read_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licences

    return scan_licences(read_table(spark, sf_dir, "documents")).drop("paragraphs")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files
    from .tokens import default_path

    return token_files(read_table(spark, sf_dir, "documents"), default_path())


def op9_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict_documents

    return predict_documents(read_table(spark, sf_dir, "documents"))


def op10_pack_min_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import default_path

    return pack_documents(read_table(spark, sf_dir, "documents"), default_path())


def op11_line_refcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines

    out = drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie, rebuild, sequences

    return conversation_trie(rebuild(sequences(read_table(spark, sf_dir, "conversations"))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import licenses, oracles

    return oracles.SQL | {"op7_license_scan": licenses.duckdb_sql()}
