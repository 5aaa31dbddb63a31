"""Sources and sinks: pasted and uploaded texts, corpora with expectations, sentinels, prompts as files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_BYTES = 100 << 20
EXTENSIONS = ("sql", "txt", "log", "out")
ENCODINGS = ("utf-8-sig", "utf-16", "cp1251", "latin-1")  # fixed value: tried in this order; the last never fails
SENTINEL = r"(?i)[A-Za-z0-9_$#]*(?:PRIVATE|SECRET)[A-Za-z0-9_$#]*"

EXPECTATIONS = "schemaVersion int, suite string, source string, cases array<struct<file:string,kind:string,replace:array<string>,keep:array<string>,minOccurrences:int,allowFindings:array<string>,tags:array<string>>>"


def decode(data: bytes | None) -> str | None:
    for name in ENCODINGS:
        try:
            return None if data is None else bytes(data).decode(name)
        except UnicodeDecodeError:
            pass


@F.pandas_udf(StringType())
def decoded(data: pd.Series) -> pd.Series:
    return data.map(decode)


def within_limit(text: Column) -> Column:
    """Whether a text is accepted: at most 100 MiB in code points and in UTF-8."""
    return (F.length(text) <= MAX_BYTES) & (F.octet_length(text) <= MAX_BYTES)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, text, problem of the files with accepted extensions under a folder, decoded by the chain; a larger file has no text but a problem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(path)
    small = F.col("length") <= MAX_BYTES
    return files.select("path", decoded(F.when(small, F.col("content"))).alias("text"), F.when(~small, "over 100 MiB").alias("problem"))


def sentinels(text: Column) -> Column:
    """Words that mark secrets, once each, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(SENTINEL), F.lit(0)))


_LISTS = ("replace", "keep", "allowFindings", "tags")  # the lists of a registered file


def read_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """A corpus folder as (cases, problems).

    cases: suite, file, kind, text, replace (with the sentinels of the text), keep, min_occurrences,
    allow_findings, registered. problems: rule, what - unregistered files without sentinels, registered files
    that are missing, files registered twice, paths that leave the suite, bad versions, suites, kinds and
    extensions, a missing file name or kind, empty or repeated values, large files, and an empty corpus. Lists that are left out are empty.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    files = files.select("path", "length", decoded("content").alias("text"))
    sheets = spark.read.schema(EXPECTATIONS).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "expectations.json").json(root).withColumn("base", F.regexp_replace(F.input_file_name(), "[^/]*$", ""))
    listed = sheets.select("schemaVersion", "suite", "base", F.explode("cases").alias("c")).select("schemaVersion", "suite", "base", "c.*")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    listed = listed.withColumn("at", plain(F.concat("base", "file")))
    files = files.withColumn("at", plain(F.col("path")))
    joined = files.join(listed, "at", "full")
    words = sentinels(F.col("text"))
    cases = joined.where("text is not null").select(
        "suite", F.coalesce("file", "at").alias("file"), "kind", "text", F.array_distinct(F.concat(F.coalesce("replace", F.array().cast("array<string>")), words)).alias("replace"),
        F.coalesce("keep", F.array().cast("array<string>")).alias("keep"), F.coalesce("minOccurrences", F.lit(1)).alias("min_occurrences"),
        F.coalesce("allowFindings", F.array().cast("array<string>")).alias("allow_findings"), F.col("file").isNotNull().alias("registered"),
    )
    rules = [
        ("unregistered_without_sentinel", joined.where(F.col("file").isNull() & (F.size(words) == 0)), "at"),
        ("missing_file", joined.where("text is null"), "file"),
        ("path_leaves_suite", listed.where("file like '/%' or file like '%..%'"), "file"),
        ("bad_version", sheets.where("schemaVersion is null or schemaVersion <> 1"), "suite"),
        ("bad_kind", listed.where("kind not in ('sql', 'xplan', 'sql_monitor', 'outline', 'predicates')"), "file"),
        ("bad_suite", sheets.where("suite is null or not suite rlike '^[a-z0-9][a-z0-9-]*$'").select(F.coalesce("suite", "base").alias("suite")), "suite"),
        ("no_source", sheets.where("coalesce(source, '') = ''").select(F.coalesce("suite", "base").alias("suite")), "suite"),
        ("missing_field", listed.where("file is null or kind is null").select(F.coalesce("file", "suite", "base").alias("file")), "file"),
        ("bad_min_occurrences", listed.where("minOccurrences < 1"), "file"),
        ("bad_extension", listed.where(~F.lower("file").rlike(r"[.](?:" + "|".join(EXTENSIONS) + ")$")), "file"),
        ("empty_value", listed.where(" or ".join(f"array_contains({c}, '')" for c in _LISTS)), "file"),
        ("repeated_value", listed.where(" or ".join(f"size(array_distinct({c})) < size({c})" for c in _LISTS)), "file"),
        ("empty_corpus", files.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(root).alias("root")), "root"),
        ("too_large", files.where(f"length > {10 << 20}"), "at"),
        ("registered_twice", listed.groupBy("at").count().where("count > 1"), "at"),
        ("duplicate_suite", sheets.groupBy("suite").count().where("count > 1"), "suite"),
    ]
    problems = None
    for rule, rows, what in rules:
        part = rows.select(F.lit(rule).alias("rule"), F.col(what).alias("what"))
        problems = part if problems is None else problems.unionByName(part)
    return cases, problems


def write_prompts(prompts: DataFrame, path: str) -> None:
    """Prompts as text files, one row a record."""
    prompts.select("prompt").write.mode("overwrite").text(path)
