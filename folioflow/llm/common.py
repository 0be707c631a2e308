"""Helpers that the training-data operators share.

Nothing here collects rows of the corpus: what reaches the driver is one row per
partition, per file or per source.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as Java's and Python's regular expressions write them.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Used only by a local master whose session names no checkpoint folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/folioflow"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` where it is set.

    Without it a local session, whose driver is the only executor, uses a local folder; on a cluster that
    would lose files, so there it is an error.
    """
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if spark._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return spark._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again; its lineage ends there, and the shuffles that made it go."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for made in _scratch:
        made.append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Collects the tables that are stored meanwhile, so that they can be released once what they led to is stored."""
    made: list[DataFrame] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch.remove(made)


def release(*tables: DataFrame) -> None:
    """Delete what :func:`store` wrote for tables that nothing reads any more: all that used them is stored itself."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows (a few integers each) up to which a table is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000


def bounded(table: DataFrame) -> DataFrame:
    """A stored table of a few integers a row, to be broadcast if its rows are few enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


#: A number for each row, unlike any column of the tables.
ROW = "__row"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows, stored once with a number each, so that steps may join by it whatever their ids."""
    return store(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def whole_text(text: str | Column = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def rows_of(batches: Iterator[pa.RecordBatch], at_most: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to few rows, so that what a step builds of one batch stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, at_most):
            yield batch.slice(k, at_most)


#: What empties the tables that a worker keeps from task to task.
FORGET: list[Callable[[], None]] = []


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def gives_back(step: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """An Arrow step after which the worker returns freed memory to the system; workers outlive their tasks, and idle ones count too.

    What a worker remembers for the tasks of another step goes before it; a step that has ``keeps`` uses that itself.
    """

    @wraps(step)
    def run(*args, **kwargs) -> Iterator[pa.RecordBatch]:
        if not getattr(step, "keeps", False):
            for forget in FORGET:
                forget()
        try:
            yield from step(*args, **kwargs)
        finally:
            give_back()

    return run


def keeps(step: Callable) -> Callable:
    """Marks a step whose workers remember something from task to task."""
    step.keeps = True
    return step


#: Ranges that a table is dealt into, at most: what their bounds take is bounded.
MAX_RANGES = 1 << 16
FIRST = -(1 << 63)


class Ranges:
    """Deals rows of an integer key, and a hash of 64 bits that breaks ties, into ranges of about as many rows.

    Bounds are quantiles of the key (null: the least); a key that takes several of them, as where
    one key holds a third of all rows, is cut by the hash. They decide balance, never results, and are
    numbers in an Arrow step, not literals of a plan.
    """

    def __init__(self, df: DataFrame, key: str, ranges: int):
        ranges = max(1, min(ranges, MAX_RANGES))
        values = df.select(F.coalesce(F.col(key).cast("double"), F.lit(float(FIRST))).alias("k"))
        found = values.approxQuantile("k", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
        self.bounds = np.sort(np.clip(np.array(found, dtype=np.float64), -(2.0**63), 2.0**63 - 1024)).astype(np.int64)
        self.n = len(self.bounds) + 1
        self.split = bool(len(self.bounds) > 1 and (np.diff(self.bounds) == 0).any())

    def of(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(self.bounds, keys, side=s) for s in ("left", "right"))
        share = ((ties >> 32).astype(np.int64) + (1 << 31)) / 2.0**32
        return np.where(high > low, low + 1 + np.minimum((share * (high - low)).astype(np.int64), np.maximum(high - low - 1, 0)), low).astype(np.int32)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, root), root the smallest node reachable.

    Alternating large and small stars over joins; each round is written to the shared folder,
    so lineage stays short and a lost executor costs one round. Nodes without links, self links
    and links with a null end give no rows; repeated links count once.
    """
    spark = edges.sparkSession
    kind = edges.schema[a].dataType
    e = store(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast(kind).alias("a"), F.least(a, b).cast(kind).alias("b"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == state:
            stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = (now["n"], now["h"])
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        following = store(small, "links")
        release(e)
        e = following


@gives_back
def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) of a table to rows (node, root)."""
    parts = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while ((above := root[root]) != root).any():
            root = above
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(nodes[root[k : k + (1 << 16)]])], ["node", "root"])


def united(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """What :func:`components` gives of links between integers, stored; by one task where they are few enough to be broadcast.

    Its rounds take some ten jobs each, and what Spark remembers of jobs, plans and tasks is memory of the driver.
    """
    links = store(edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")), "links")
    found = components(links) if links.count() > BROADCAST_ROWS else links.coalesce(1).mapInArrow(_united, "node long, root long")
    return store(found, "roots")
