"""Conversations: completed turns, message windows, unused picks, and a whole search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import embedding
from folioflow.operators.chunking import chunk_documents, spread

RECENT = 12


def completed_turns(messages: DataFrame, last: int) -> DataFrame:
    """(conv_id, back, question, answer): the last turns with an answer, newest first; the last answer counts."""
    seg = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = messages.withColumn("seg", seg).where("seg > 0")
    question = F.max(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"]
    answer = F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text")))
    pairs = rows.groupBy("conv_id", "seg").agg(question.alias("question"), answer.alias("a")).where("a is not null")
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("seg")))
    return pairs.withColumn("back", back).where(F.col("back") <= last).select("conv_id", "back", "question", F.col("a.text").alias("answer"))


def recent_messages(messages: DataFrame, last: int = RECENT) -> DataFrame:
    """The last messages of each conversation, trimmed; blank ones go after the count."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("back", back).where(F.col("back") <= last).select("conv_id", "turn", "role", T.strip("text").alias("text")).where("text != ''")


def chat_messages(messages: DataFrame, system: str, prompt: str, context: str) -> DataFrame:
    """(conv_id, messages): system text, recent messages in order, and the prompt with its context."""
    asked = f"{context}\n\nQuestion: {prompt}" if context else prompt
    rows = recent_messages(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    own = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))

    def one(role: str, content: str) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), F.lit(content).alias("content")))

    first = [one("system", system.strip())] if system.strip() else []
    return rows.select("conv_id", F.concat(*first, own, one("user", asked)).alias("messages"))


def pick_unused(pool: DataFrame, used: DataFrame, key: str, order: str, n: int = 4) -> DataFrame:
    """n of the pool whose key is not used, all of it where none is left; in the order of a hash."""
    fresh = pool.join(F.broadcast(used), key, "left_anti")  # ``used`` is what one quiz has asked
    chosen = pool if fresh.isEmpty() else fresh
    return chosen.orderBy(F.md5(F.col(order).cast("string").cast("binary"))).limit(n)


def answer_sources(spark: SparkSession, sf_dir: str, questions: int = 5, limit: int = 4) -> DataFrame:
    """Documents to chunks to hashed vectors to each question's best sources: (item_id, rank, doc_id, chunk_index, score, locator, excerpt).

    Questions are a request's few rows, so they are broadcast; chunks are never collected.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chunks = chunk_documents(spread(docs, "doc_id")).withColumn("v", embedding.hashed_embedding("chunk_text"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(questions).select("item_id", T.distinct_tokens("text").alias("tokens"), embedding.hashed_embedding("text").alias("q"))
    hits = chunks.crossJoin(F.broadcast(asked)).withColumn("score", F.round(embedding.dot("q", "v"), 4))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "chunk_index")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.select("item_id", "rank", "doc_id", "chunk_index", "score", T.locator(F.lit(None).cast("int"), F.lit(None).cast("int"), F.col("chunk_index")).alias("locator"), T.excerpt("chunk_text", F.slice("tokens", 1, 8)).alias("excerpt"))
