"""Sources: files and tables with explicit schemas, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = "agent_id int, table_name string, `group` string, difficulty string, question string, answer string, evidence string, expected string, expected_all array<string>"
EXTENSIONS = ("pdf", "docx", "md", "txt")  # fixed values: the kinds of upload that are taken
UPLOAD_LIMIT = 50 * 1024 * 1024


def text_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """path, text, error for every file below a folder that matches; an empty file is a row with an error."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.when(F.trim("value") == "", "empty file").alias("error"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else Latin-1; a leading byte-order mark goes."""
    plain = content.cast("string")
    return F.regexp_replace(F.when(F.is_valid_utf8(plain), plain).otherwise(F.decode(content, "ISO-8859-1")), "^﻿", "")


def uploads(files: DataFrame, limit: int | None = UPLOAD_LIMIT) -> DataFrame:
    """files(name, content binary): name, text and error; kinds not taken, empty and oversize files (without a limit, none is
    that) give an error."""
    kind = F.lower(F.regexp_extract("name", r"\.([^./\\]+)$", 1))
    size = F.length("content")
    error = F.when(~kind.isin(*EXTENSIONS), "kind not taken").when(size == 0, "empty")
    if limit is not None:
        error = error.when(size > limit, "too large")
    return files.select("name", F.when(error.isNull(), decoded(F.col("content"))).alias("text"), error.alias("error"))


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return uploads(files.select(F.col("path").alias("name"), "content"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; rows without question or agent are left out."""
    return spark.read.schema(CASE_SCHEMA).json(path).where("trim(question) <> '' and agent_id is not null")


def lines(df: DataFrame, column: str = "text") -> DataFrame:
    """One row per line, without blank lines and lines that start with a hash sign."""
    line = F.trim("line")
    return df.select(F.explode(F.split(column, "\n")).alias("line")).where((line != "") & ~line.startswith("#"))


# The axes of the experiment matrix.
CHUNKINGS, SEARCHES, RERANKERS = ("fixed", "markdown"), ("vector", "text", "hybrid"), ("none", "keywords")


def experiments(spark: SparkSession, k: int = 5) -> DataFrame:
    """The experiment matrix: every way of cutting chunks, kind of search, use of a hypothetical answer (which a model has to
    write and is not run here) and reranker, with a name and the number of results that count. Fixed and small."""
    rows = [(f"{c}-{s}" + "-hyde" * h + f"-{r}" * (r != "none"), c, s, h, r, k) for c in CHUNKINGS for s in SEARCHES for h in (False, True) for r in RERANKERS]
    return spark.createDataFrame(rows, "experiment string, chunking string, search_type string, use_hyde boolean, reranker string, k int")
