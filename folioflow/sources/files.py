"""Scans of course files, logs and saved state, and the sinks beside them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.functions import text as T

# The endings that can be indexed.
ENDINGS = [".pdf", ".md", ".markdown", ".txt"]
MAX_FILES = 120


def ending(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def supported_files(spark: SparkSession, folder: str, limit: int | None = MAX_FILES) -> DataFrame:
    """(path, modificationTime, length, content) below a folder, in order of path, as many as a collection takes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(ending("path").isin(ENDINGS))
    return files if limit is None else files.orderBy("path").limit(limit)


@F.pandas_udf(StringType())
def _decoded(contents: pd.Series) -> pd.Series:
    """UTF-8 text; what is not valid is left out, which no built-in decoder does."""
    return contents.map(lambda c: None if c is None else bytes(c).decode("utf-8", errors="ignore"))


def text_files(files: DataFrame) -> DataFrame:
    """(path, text) of files that are no PDF, normalised."""
    return files.where(ending("path") != ".pdf").select("path", T.normalize_text(_decoded("content")).alias("text"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(event, payload, raw) of a log of JSON lines; blank lines go, bad ones are kept raw."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    good = parsed.isNotNull() & F.ltrim("value").startswith("{")
    return rows.select(
        F.when(good, F.coalesce(F.get_json_object("value", "$.event"), F.lit("log_event"))).otherwise("raw_log_line").alias("event"),
        F.when(good, F.col("value")).alias("payload"),
        F.when(~good, F.col("value")).alias("raw"),
    )


def write_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("append").text(path)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved application state by an explicit schema; what the schema lacks is dropped."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_state(state: DataFrame, path: str) -> None:
    """State without secrets."""
    state.drop("apiKey").write.mode("overwrite").json(path)
