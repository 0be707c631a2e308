"""Settings, model names and paths as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least, most, default and whether a setting is a whole number.
RANGES = {
    "cpuThreads": (1, 64, 4, True),
    "contextLength": (512, 32768, 2048, True),
    "maxLength": (64, 8192, 4096, True),
    "promptBatchSize": (1, 4096, 128, True),
    "temperature": (0, 2, 0.7, False),
    "topP": (0, 1, 0.4, False),
    "topK": (0, 1000, 40, True),
    "minP": (0, 1, 0, False),
    "repeatPenaltyTokens": (0, 4096, 64, True),
    "repeatPenalty": (1, 3, 1.18, False),
    "gpuLayers": (-1, 999, -1, True),
    "maxSources": (1, 10, 4, True),
}


def clamp(x: Column | str, setting: str) -> Column:
    """A setting's value from text: the default where it is no finite number, else rounded and within its range."""
    low, high, default, whole = RANGES[setting]
    n = (F.col(x) if isinstance(x, str) else x).try_cast("double")
    bad = n.isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    value = F.floor(n + 0.5).cast("double") if whole else n
    return F.when(bad, F.lit(float(default))).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def sorted_models(models: DataFrame, preferred: str) -> DataFrame:
    """(id, pos): preferred prefix first, then larger numbers first, then by name."""
    numbers = F.transform(F.regexp_extract_all("id", F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int"))
    padded = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.coalesce(F.get(numbers, k), F.lit(-1)))
    rows = models.distinct().withColumn("n", padded)
    order = [F.when(F.col("id").startswith(preferred), 0).otherwise(1), *(F.desc(F.col("n")[k]) for k in range(4)), F.col("id")]
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order))).select("id", "pos")  # a provider's list


def inside(parent: Column, child: Column) -> Column:
    return (child == parent) | child.startswith(F.concat(parent, F.lit("/")))


def material_kind(path: Column, is_folder: Column) -> Column:
    return F.when(is_folder, "folder").when(F.lower(path).endswith(".pdf"), "pdf").otherwise("document")


def remote_key(base: Column, name: Column) -> Column:
    return F.substring(F.sha2(F.concat(base, F.char(F.lit(0)), name), 256), 1, 24)


def local_key(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 16)
