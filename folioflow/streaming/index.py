"""Incremental indexing of a stream of documents: only chunks without a vector are embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.chunking import chunk_documents
from folioflow.operators.embedding import hashed_embedding, missing

SIGNATURE = ["doc_id", "chunk_text"]


def index_batch(docs: DataFrame, path: str, embed: Callable[[str], Column] = hashed_embedding) -> DataFrame:
    """Chunks of a batch that the index at ``path`` has no vector for, embedded."""
    spark = docs.sparkSession
    chunks = chunk_documents(docs)
    schema = chunks.withColumn("embedding", embed("chunk_text")).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    index = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    return missing(chunks, index, SIGNATURE).withColumn("embedding", embed("chunk_text"))


def start(docs: DataFrame, path: str, checkpoint: str, embed: Callable[[str], Column] = hashed_embedding) -> StreamingQuery:
    """Index a stream (doc_id, text). A batch that runs again finds its chunks embedded and adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        index_batch(batch, path, embed).write.mode("append").parquet(path)

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
