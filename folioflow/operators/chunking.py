"""Chunks of documents and pages, with offsets, section headings and checkpoint batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

BATCH = 50


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where a scan has fewer partitions than that (one large file); as they are otherwise, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = T.MIN_DOCUMENT_WORDS) -> DataFrame:
    """(key, chunk_index, chunk_text, words): chunks of more than four words of documents with enough words.

    One row in, an array out, exploded: no shuffle. ``spread`` the rows first where few scan partitions hold much text.
    """
    counted = F.transform(T.chunk_text(text), lambda c: F.struct(c.alias("chunk_text"), T.count_words(c).alias("words")))
    # exploded as an expression: of a column Catalyst would filter on its size first and compute the chunks twice
    long_enough = F.filter(counted, lambda c: c["words"] > T.MIN_CHUNK_WORDS)
    rows = docs.where(T.count_words(text) >= min_words).select(key, F.posexplode(long_enough).alias("k", "c"))
    return rows.select(key, (F.col("k") + 1).alias("chunk_index"), "c.chunk_text", "c.words")


def with_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, start_offset, end_offset): where each chunk's first 80 characters are found, from the last chunk's end on."""
    clean = T.normalize_text(text)
    rows = docs.select(key, clean.alias("clean"), T.chunk_text(text).alias("chunks"))
    start = F.struct(F.array().cast("array<struct<s:int,e:int,c:string>>").alias("done"), F.lit(0).alias("at"))

    def add(acc: Column, chunk: Column) -> Column:
        found = F.call_function("locate", F.substring(chunk, 1, 80), F.col("clean"), acc["at"] + 1) - 1
        place = F.when(found < 0, acc["at"]).otherwise(found).cast("int")
        end = F.least(F.length("clean"), place + F.length(chunk)).cast("int")
        return F.struct(F.concat(acc["done"], F.array(F.struct(place.alias("s"), end.alias("e"), chunk.alias("c")))).alias("done"), end.alias("at"))

    placed = F.aggregate("chunks", start, add, lambda acc: F.filter(acc["done"], lambda c: T.count_words(c["c"]) > T.MIN_CHUNK_WORDS))
    rows = rows.select(key, F.posexplode(placed).alias("k", "c"))
    return rows.select(key, (F.col("k") + 1).alias("chunk_index"), F.col("c.s").alias("start_offset"), F.col("c.e").alias("end_offset"))


def last_header(chunk: Column | str, article: bool = False, chapter: bool = True) -> Column:
    """The last section heading among a chunk's lines; null if there is none."""
    found = F.filter(F.transform(T.lines(chunk), lambda x: T.section_header(x, article, chapter)), lambda h: h.isNotNull())
    return F.get(found, F.size(found) - 1)


def carried(header: Column | str, by: list[str], order: list[str]) -> Column:
    """The last heading so far, over rows of the same ``by`` in ``order``."""
    return F.last(header, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def chunk_pages(pages: DataFrame, article: bool = False, chapter: bool = True) -> DataFrame:
    """(document_id, page, chunk_index, chunk_text, words, section_header) of cleaned pages.

    A heading holds on: within a page over all of its chunks, from page to page only where a
    kept chunk carried it. Both are windows over a document's chunks.
    """
    rows = pages.select("document_id", "page", F.posexplode(T.chunk_text("text")).alias("k", "chunk_text"))
    rows = rows.withColumn("words", T.count_words("chunk_text")).withColumn("own", last_header("chunk_text", article, chapter))
    rows = rows.withColumn("own", carried("own", ["document_id", "page"], ["k"])).where(F.col("words") > T.MIN_CHUNK_WORDS)
    rows = rows.withColumn("section_header", carried("own", ["document_id"], ["page", "k"]))
    rows = rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "k")))
    return rows.select("document_id", "page", "chunk_index", "chunk_text", "words", "section_header")


def batch_ids(position: Column, first_file: Column | bool = True, batch: int = BATCH) -> Column:
    """The checkpoint batch of a newly embedded chunk (position from 1 in its file): the first file flushes after one chunk."""
    first_file = F.lit(first_file) if isinstance(first_file, bool) else first_file
    return F.when(first_file, F.ceil((position - 1) / batch)).otherwise(F.ceil(position / batch)).cast("long")


def index_percent(phase: Column, done: Column, total: Column) -> Column:
    """Progress of an indexing job: parsing to 30, chunking to 45, embedding to 90, saving 95, done 100; halves to even."""
    return (
        F.when(phase == "parsing", 1 + F.bround((done - 1) / total * 29))
        .when(phase == "chunking", 30 + F.bround(done / total * 15))
        .when(phase == "embedding", F.least(F.lit(90), 45 + F.bround(done / total * 45)))
        .when(phase == "saving", F.lit(95))
        .otherwise(F.lit(100))
        .cast("int")
    )
