"""The materials of a library as rows: what is new, what an index adds, and a preview of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T


def first_file(files: DataFrame, path: str = "path") -> DataFrame:
    """One row: the path that comes first, whatever its case."""
    return files.agg(F.min(F.struct(F.lower(path).alias("low"), F.col(path).alias("own")))["own"].alias(path))


def preview(pages: DataFrame, cleaned: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, pos, text) of one file: two raw and two cleaned pages (page, text), six chunks (page, chunk_index, chunk_text), cut where long."""

    def first(rows: DataFrame, kind: str, n: int, longest: int, text: str, *order: str) -> DataFrame:
        few = rows.orderBy(*order).limit(n).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("rows"))  # n rows
        return few.select(F.lit(kind).alias("kind"), F.posexplode(F.col("rows.t")).alias("pos", "t")).select("kind", "pos", T.truncate_preview("t", longest).alias("text"))

    return first(pages, "raw", 2, 6000, "text", "page").unionByName(first(cleaned, "cleaned", 2, 6000, "text", "page")).unionByName(first(chunks, "chunk", 6, 1500, "chunk_text", "page", "chunk_index"))


def with_new(existing: DataFrame, incoming: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """Materials with the incoming ones that are not among them in front; ``part`` and ``pos`` give the order."""
    fresh = incoming.join(existing.select(*key).distinct(), key, "left_anti")
    return fresh.withColumn("part", F.lit(0)).unionByName(existing.withColumn("part", F.lit(1)).select(*incoming.columns, "part")).orderBy("part", pos)


def merge_indexed(pending: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id, path, status, pending_first): indexed rows, with the status of a pending row of the same id or else the same path
    where that is paused; pending rows that no indexed row stands for come first."""
    p = pending.select(F.col("id").alias("p_id"), F.col("path").alias("p_path"), F.col("status").alias("p_status"))
    by_id = p.groupBy("p_id").agg(F.min("p_status").alias("id_status"))
    by_path = p.groupBy("p_path").agg(F.min("p_status").alias("path_status"))
    rows = indexed.join(by_id, F.col("id") == F.col("p_id"), "left").join(by_path, F.col("path") == F.col("p_path"), "left")
    known = F.coalesce("id_status", "path_status")
    status = F.when((known == "paused") & (F.col("status") == "indexing"), known).otherwise(F.col("status"))
    rest = pending.join(indexed.select("id").distinct(), "id", "left_anti").join(indexed.select("path").distinct(), "path", "left_anti")
    return rest.select("id", "path", "status", F.lit(True).alias("pending_first")).unionByName(rows.select("id", "path", status.alias("status"), F.lit(False).alias("pending_first")))


def listed(rows: DataFrame) -> DataFrame:
    """Materials by the text of their last known time, latest first; pos counts from 1."""
    time = F.coalesce("indexed_at", "added_at", F.col("updated").cast("string"))
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(time.desc(), "id")))  # a library's few materials


def picked(rows: DataFrame, is_folder: Column) -> DataFrame:
    """What a picked path (id, path) starts as."""
    name = F.regexp_replace("path", "^.*/", "")
    return rows.select(
        "id",
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("title"),
        F.lit("indexing").alias("status"),
        F.when(is_folder, "folder").otherwise("document").alias("kind"),
        F.when(is_folder, "Parsing folder").otherwise("Parsing file").alias("detail"),
        F.when(is_folder, 0).otherwise(1).alias("files"),
        F.lit(False).alias("is_active"),
        F.lit("parsing").alias("phase"),
        F.lit(1).alias("percent"),
    )


def allowed_pdfs(sources: DataFrame, materials: DataFrame) -> DataFrame:
    """Sources (path) that are PDF files of a material (kind, path): its own path, or below it where it is a folder."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    keyed = sources.where(F.lower("path").endswith(".pdf")).withColumn("own_path", F.col("path")).withColumn("above", F.explode(above))
    kept = keyed.join(materials.select(F.col("path").alias("above"), "kind").distinct(), "above").where((F.col("above") == F.col("own_path")) | (F.col("kind") == "folder"))
    return kept.select(*sources.columns).distinct()


def cached_thumbnail(root: str, resolved: Column, given: Column, path: Column, page: Column) -> Column:
    """The first picture below the cache: the catalog's, the source's own, or where that of a page would be."""
    made = F.concat(F.lit(f"{root}/"), F.substring(F.sha2(path, 256), 1, 20), F.lit("/page-"), F.lpad(page.cast("string"), 4, "0"), F.lit(".png"))
    return F.coalesce(*(F.when(F.lower(c).endswith(".png") & c.startswith(f"{root}/"), c) for c in (resolved, given, made)))
