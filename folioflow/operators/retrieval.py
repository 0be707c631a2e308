"""Search: exact top-k by inner product, ranks over models, and the rows of sources."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.embedding import dot

DEFAULT_LIMIT = 4
OVER_FETCH = 8


def top_k(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "vec_id") -> DataFrame:
    """The k best rows of each query, ranked; Catalyst keeps k a partition before the shuffle (WindowGroupLimit)."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_top(batches, queries: list[tuple[int, list[float]]], k: int):
    ids, matrix = np.array([q for q, _ in queries], dtype=np.int64), np.array([v for _, v in queries], dtype=np.float64)
    best_ids, best = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = np.array(batch.column(1).to_pylist(), dtype=np.float64)
        own = batch.column(0).to_numpy()
        scores = matrix @ vectors.T
        own = np.broadcast_to(own, scores.shape)
        if best is not None:
            scores, own = np.hstack([best, scores]), np.hstack([best_ids, own])
        order = np.lexsort((own, -np.round(scores, 12)), axis=1)[:, :k]
        best, best_ids = np.take_along_axis(scores, order, 1), np.take_along_axis(own, order, 1)
    if best is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(best_ids.ravel()), pa.array(best.ravel())], ["query_id", "vec_id", "score"])


def vector_top_k(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = DEFAULT_LIMIT, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact top k of a request's queries over all vectors: (query_id, vec_id, score, rank).

    The queries (a request's few, not a table) go to the tasks; each multiplies Arrow
    batches and keeps k a query, so one small shuffle merges the partitions.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector)
    found = rows.mapInArrow(partial(_block_top, queries=queries, k=k), "query_id long, vec_id long, score double")
    return top_k(found, k)


def _blocks_top(batches, k: int):
    """Rows (block, asks, id, v) in order, vectors before queries: the k best of each query in each block, whose vectors are held."""
    block, held, ready = None, [], None
    for batch in batches:
        for s in range(0, batch.num_rows, 512):
            part = batch.slice(s, 512)
            blocks, asks = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks) != 0)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if blocks[a] != block:
                    block, held, ready = blocks[a], [], None
                own = part.slice(a, b - a)
                ids, matrix = own.column(2).to_numpy(), own.column(3).flatten().to_numpy().astype(np.float64).reshape(b - a, -1)
                if not asks[a]:
                    held.append((ids, matrix))
                elif held:
                    ready = ready or tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    scores = matrix @ ready[1].T
                    order = np.lexsort((np.broadcast_to(ready[0], scores.shape), -np.round(scores, 12)), axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, order.shape[1])), pa.array(ready[0][order].ravel()), pa.array(np.take_along_axis(scores, order, 1).ravel())], ["query_id", "vec_id", "score"])


def all_top_k(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_LIMIT, key: str = "vec_id", vector: str = "embedding", block_rows: int = 50_000) -> DataFrame:
    """Exact top k of every query of a table over all vectors: (query_id, vec_id, score, rank).

    Vectors are dealt to blocks, each of which one task holds; queries visit every block in Arrow batches. Of each
    query and block k rows are shuffled, never the pairs.
    """
    blocks = max(1, -(-vectors.count() // block_rows))
    held = vectors.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    met = held.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("block", "asks")
    return top_k(met.mapInArrow(partial(_blocks_top, k=k), "query_id long, vec_id long, score double"), k)


def vector_top_k_filtered(vectors: DataFrame, queries: list[tuple[int, list[float]]], allowed: Column, k: int = DEFAULT_LIMIT, over_fetch: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Top k among allowed rows: exact, or with ``over_fetch`` as an index does that filters afterwards and may return fewer."""
    if over_fetch is None:
        return vector_top_k(vectors.where(allowed), queries, k, key, vector)
    wide = vector_top_k(vectors, queries, max(over_fetch * k, k), key, vector).drop("rank")
    return top_k(wide.join(vectors.where(allowed).select(key), key, "left_semi"), k)


def best_per_row(hits: DataFrame, key: str = "vec_id") -> DataFrame:
    """Hits of several models to one a row: the best score, of equal ones the first model."""
    return hits.groupBy(key).agg(F.max(F.struct("score", (-F.col("model_pos")).alias("p"), "model")).alias("b")).select(key, F.col("b.score").alias("score"), F.col("b.model").alias("model"))


def search_rank(hits: DataFrame, limit: int | None = DEFAULT_LIMIT, key: str = "vec_id") -> DataFrame:
    """The best rows of a search in order; no limit or 0 means four."""
    limit = limit or DEFAULT_LIMIT
    best = best_per_row(hits, key).orderBy(F.desc("score"), key).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # ``limit`` rows


def source_rows(chunks: DataFrame, documents: DataFrame, folders: DataFrame, items: DataFrame, collections: DataFrame, state: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """Chunks with their document, folder, collection, state and page thumbnail.

    Documents hang on folders: where collections share a folder, a chunk has a row in each.
    """
    return (
        chunks.join(documents, "document_id")
        .join(folders, "folder_id")
        .join(items, "folder_id")
        .join(collections, "collection_id")
        .join(state, "collection_id")
        .join(thumbnails, ["document_id", "page"], "left")
    )


def rank_then_fetch(ranked: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ranked ids in rank order. ``ranked`` is a search's limit long, so it is broadcast; duplicates by id collapse."""
    return F.broadcast(ranked).join(rows, key).dropDuplicates([key]).orderBy("rank")


def project_source(rows: DataFrame, tokens: Column) -> DataFrame:
    """The fields of a source card."""
    text = T.normalize_text("chunk_text")
    return rows.select(
        T.source_title(F.col("collection_name"), F.col("document_title")).alias("title"),
        T.locator(F.col("page_start"), F.col("page_end"), F.col("chunk_index")).alias("locator"),
        T.excerpt(text, tokens).alias("excerpt"),
        text.alias("context"),
        "chunk_id",
        "document_id",
        "collection_name",
        "path",
        "page_start",
        "page_end",
        "score",
    )


def merge_sources(primary: DataFrame, secondary: DataFrame, limit: int, key: str = "source_key", position: str = "pos") -> DataFrame:
    """Primary then secondary sources, the first of each key, up to the limit."""
    both = primary.withColumn("part", F.lit(0)).unionByName(secondary.withColumn("part", F.lit(1)))
    first = both.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("part", position))).where("turn = 1")
    return first.orderBy("part", position).limit(limit).drop("turn")


def starter_sources(documents: DataFrame, chunks: DataFrame, limit: int, seed: int | None = None) -> DataFrame:
    """Chunks of the first document (by lower-case path, then id) that has any: a seeded sample, in page order."""
    first = documents.join(chunks.select("document_id").distinct(), "document_id", "left_semi").orderBy(F.lower("path"), "document_id").limit(1)
    order = F.md5(F.concat_ws(":", F.lit(str(seed or 0)), F.col("chunk_id").cast("string")))
    return chunks.join(F.broadcast(first.select("document_id")), "document_id").orderBy(order).limit(limit).orderBy(F.coalesce("page", F.lit(0)), "chunk_id")


def search_reason(enabled: Column, ready: Column, has_chunks: Column, hits: Column) -> Column:
    """Why a search has no sources; null if it has."""
    return F.when(enabled == 0, F.when(ready > 0, "no_enabled_materials").otherwise("no_materials")).when(~has_chunks, "no_indexed_chunks").when(hits == 0, "no_matching_sources")


__all__ = ["best_per_row", "dot", "merge_sources", "project_source", "rank_then_fetch", "search_rank", "search_reason", "source_rows", "starter_sources", "top_k", "vector_top_k", "vector_top_k_filtered"]
