"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact distance.

Largest inner product becomes nearest point: vectors are parted by norm (a range holds norms between a half and the whole of
its largest), scaled by their range's largest norm, and get one more component that makes all norms 1; a query is
scaled to norm 1 and gets 0. So one long vector does not crowd all others into a bucket. Each of
TABLES tables of a range hashes a point by HASHES functions floor((a . x + b) / WIDTH) with Gaussian a. A query
visits, in every table, the PROBES buckets reached from its own by the perturbations that are most
likely to succeed: those with the least sum of squared distances from the query's projections to the walls
that they cross. Buckets are visited where they lie; each task keeps the best of what a query meets, and the
tables' candidates are merged.

Scores are inner products of the original vectors in double precision, each a sum in one fixed order, so equal
vectors have equal scores wherever they are computed; ranks go by score, then by the smaller id.

Every row is indexed. No bucket is capped: one that holds more than SPLIT vectors is split among tasks, and
its queries visit every part. A query that meets fewer than k candidates (or fewer than there are) is
answered by a scan of all rows in blocks, so it is exact. Equal vectors tie, so of a group of equal vectors the
neighbours with the smallest ids are enough; the index holds those, exactly as many as a query may return and one more.

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold null or
non-finite components take no part, as query or candidate; null ids take no part; repeated
rows (same id and vector) count once; with fewer candidates than k all are returned; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import release, store

TABLES, HASHES, PROBES = 4, 8, 128
#: Width of a bucket in standard deviations of a projection.
WIDTH = 2.5
#: Ranges of norms; the last one holds all that are shorter.
RANGES = 16
SEED = 11
SPLIT = 4_096
#: Bytes of vectors that one task holds, about.
TASK_BYTES = 1 << 24
K = 20


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): ids and double vectors that take part, each once."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fine).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0)).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column without nulls, a row each, without a Python object for a number."""
    return column.flatten().to_numpy().astype(np.float64, copy=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the same order."""
    return np.ascontiguousarray(a * b).sum(axis=1)


class Tables:
    """The hash functions of all tables and a query's probing sequence, for vectors of norm 1 at most."""

    def __init__(self, dimension: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.width, self.tables, self.hashes = width, tables, hashes  # a projection's standard deviation is 1
        self.a = draw.standard_normal((dimension + 1, tables * hashes))
        self.b = draw.uniform(0, self.width, tables * hashes)

    def places(self, x: np.ndarray, top: np.ndarray | None = None) -> np.ndarray:
        """Projections in units of a bucket: rows x tables x hashes. Points are scaled by ``top``, queries to norm 1."""
        x = x / np.abs(x).max(axis=1, keepdims=True) if top is None else x / top[:, None]
        if top is None:
            x, more = x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros(len(x))
        else:
            more = np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))
        return ((np.column_stack([x, more]) @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.hashes)

    def keys(self, buckets: np.ndarray) -> np.ndarray:
        """One integer for each bucket (... x hashes): eight bits of each place."""
        return (((buckets + 128) & 255).astype(np.int64) << (8 * np.arange(self.hashes) % 64)).sum(axis=-1)

    def probes(self, place: np.ndarray, n: int) -> np.ndarray:
        """The n likeliest buckets of one table for a query: the least sums of squared steps.

        Sets of perturbations are made in ascending score by shifting and expanding the sorted
        single steps, and those that move a hash both ways are skipped.
        """
        own = np.floor(place)
        inside = place - own
        steps = sorted([(float(x) ** 2, k, -1) for k, x in enumerate(inside)] + [(float(1 - x) ** 2, k, 1) for k, x in enumerate(inside)])
        out, queue = [own], [(steps[0][0], (0,))]
        while queue and len(out) < n:
            score, chosen = heapq.heappop(queue)
            last = chosen[-1]
            if last + 1 < len(steps):
                grown = steps[last + 1][0]
                heapq.heappush(queue, (score - steps[last][0] + grown, (*chosen[:-1], last + 1)))
                heapq.heappush(queue, (score + grown, (*chosen, last + 1)))
            if len({steps[k][1] for k in chosen}) == len(chosen):
                moved = own.copy()
                for k in chosen:
                    moved[steps[k][1]] += steps[k][2]
                out.append(moved)
        return np.array(out).astype(np.int64)


def _index(batches: Iterator[pa.RecordBatch], made: Tables) -> Iterator[pa.RecordBatch]:
    """Rows (id, v, range, top) to a row for each table; a table's number tells its range too."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(2).to_numpy()
        keys = made.keys(np.floor(made.places(matrix(batch.column(1)), batch.column(3).to_numpy())).astype(np.int64))
        for t in range(made.tables):
            yield pa.RecordBatch.from_arrays([pa.array((part * made.tables + t).astype(np.int32)), pa.array(keys[:, t].copy()), batch.column(0), batch.column(1)], ["t", "key", "id", "v"])


def _probe(batches: Iterator[pa.RecordBatch], made: Tables, n: int, parts: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) to the buckets that a query visits; the sequence is the same in every range of norms."""
    for batch in batches:
        for s in range(0, batch.num_rows, 64):
            part = batch.slice(s, 64)
            t, key, row = [], [], []
            for k, place in enumerate(made.places(matrix(part.column(1)))):
                for j in range(made.tables):
                    found = made.keys(made.probes(place[j], n))
                    for r in parts:
                        t.append(np.full(len(found), r * made.tables + j, dtype=np.int32))
                        key.append(found)
                        row.append(np.full(len(found), k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(t)), pa.array(np.concatenate(key)), part.column(0).take(pa.array(np.concatenate(row)))], ["t", "key", "id"])


class Best:
    """The k best candidates that each of a task's queries has met: ids, and exact scores."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def add(self, queries: np.ndarray, points: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        rough = points @ vectors.T  # its sums differ in their last bits with the place of a vector
        slack = 4e-16 * (points.shape[1] + 8) * np.abs(points) @ np.abs(vectors).max(axis=0)
        keep = min(self.k + 1, len(ids))  # one may be the query itself
        least = np.partition(rough, -keep, axis=1)[:, -keep] - 2 * slack
        row, at = np.nonzero(rough >= least[:, None])
        scores = products(points[row], vectors[at])
        for q, i, s in zip(queries.tolist(), np.split(ids[at], ends := np.searchsorted(row, np.arange(1, len(queries)))), np.split(scores, ends), strict=True):
            self.found.setdefault(q, []).append((i, s))
            if sum(len(i) for i, _ in self.found[q]) > 16 * (self.k + 1):
                self.found[q] = [self.best(q)]

    def best(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([x for x, _ in self.found[q]])
        scores = np.concatenate([x for _, x in self.found[q]])
        ids, first = np.unique(ids, return_index=True)
        own = ids != q
        ids, scores = ids[own], scores[first][own]
        order = np.lexsort((ids, -scores))[: self.k]
        return ids[order], scores[order]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _visit(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (task, is_query, id, v, buckets) sorted by task, vectors first; a task's vectors are held."""

    def meet(held: list[pa.RecordBatch], asked: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held or not asked:
            return
        ids, vectors = (np.concatenate(x) for x in ([b.column(2).to_numpy() for b in held], [matrix(b.column(3)) for b in held]))
        bucket = np.concatenate([b.column(4).flatten().to_numpy() for b in held])  # a vector has one
        order = np.argsort(bucket, kind="stable")
        ids, vectors, bucket = ids[order], vectors[order], bucket[order]
        names, starts = np.unique(bucket, return_index=True)
        ends = np.append(starts[1:], len(bucket))
        for part in asked:
            queries, points, best = part.column(2).to_numpy(), matrix(part.column(3)), Best(k)
            sought = part.column(4).flatten().to_numpy()
            asker = np.repeat(np.arange(len(queries)), part.column(4).value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(names, sought), len(names) - 1)
            hit = names[at] == sought
            at, asker = at[hit], asker[hit]
            by = np.argsort(at, kind="stable")
            at, asker = at[by], asker[by]
            for own, rows in zip(np.unique(at).tolist(), np.split(asker, np.flatnonzero(np.diff(at)) + 1), strict=True) if len(at) else ():
                best.add(queries[rows], points[rows], ids[starts[own] : ends[own]], vectors[starts[own] : ends[own]])
            found = [(q, *best.best(q)) for q in best.found]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found])), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([x for _, _, x in found]))], schema=_FOUND)

    task, held = None, []
    for batch in batches:
        for s in range(0, batch.num_rows, 512):
            part = batch.slice(s, 512)
            tasks, is_query = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(tasks) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1).tolist(), len(tasks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if tasks[a] != task:
                    task, held = tasks[a], []
                if is_query[a]:
                    yield from meet(held, [part.slice(a, b - a)])
                else:
                    held.append(part.slice(a, b - a))


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): one row for each candidate, and of each query the nearest."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, is_query, k: int = K, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, width: float = WIDTH, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by inner product, ties to the smaller id.

    ``is_query`` is a condition on ``id``; candidates are all other usable rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))  # squares of scaled components neither vanish nor overflow
    norm = most * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / most) * (x / most)))
    rows = store(rows.withColumn("norm", norm), "vectors")
    facts = rows.select(F.max("norm").alias("top"), F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = F.least(F.floor(F.log2(F.lit(facts["top"]) / F.col("norm"))), F.lit(RANGES - 1)).cast("int")
    rows = rows.withColumn("range", part)
    tops = {r["range"]: r["top"] for r in rows.groupBy("range").agg(F.max("norm").alias("top")).collect()}  # RANGES at most
    top = F.element_at(F.array(*(F.lit(tops.get(r, 1.0)) for r in range(RANGES))), F.col("range") + 1)
    made = Tables(facts["d"], tables, hashes, width)
    same = Window.partitionBy("v").orderBy("id")
    index = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("id", "v", "range", top.alias("top"))
    index = index.mapInArrow(partial(_index, made=made), "t int, key long, id long, v array<double>")
    index = index.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 20)))
    parts = index.groupBy("t", "key").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    bucket = F.xxhash64("t", "key", "part")
    task_rows = max(SPLIT, TASK_BYTES // (8 * facts["d"]))
    n_tasks = max(2 * spark.sparkContext.defaultParallelism, -(-facts["n"] * tables // task_rows))
    task = F.pmod("bucket", F.lit(n_tasks)).cast("int")
    held = index.join(parts, ["t", "key"]).withColumn("part", F.pmod("place", "parts").cast("int")).withColumn("bucket", bucket)
    held = held.select(task.alias("task"), F.lit(False).alias("is_query"), "id", "v", F.array("bucket").alias("buckets"))
    queries = rows.where(is_query).select("id", "v")
    asked = queries.mapInArrow(partial(_probe, made=made, n=probes, parts=sorted(tops)), "t int, key long, id long").join(parts, ["t", "key"])
    asked = asked.select("id", "t", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("bucket", bucket)
    # a query's vector goes to a task once, with the buckets that it visits there
    asked = asked.groupBy(task.alias("task"), "id").agg(F.collect_list("bucket").alias("buckets"))
    asked = asked.join(queries, "id").select("task", F.lit(True).alias("is_query"), "id", "v", "buckets")
    met = held.unionByName(asked).repartitionById(n_tasks, "task").sortWithinPartitions("task", "is_query")
    found = store(_merged(met.mapInArrow(partial(_visit, k=k), "query_id long, vec_id long, score double"), k), "neighbours")

    # queries that met too few: all rows, in blocks
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, facts["n"] - 1))
    lacking = store(queries.join(full, F.col("id") == F.col("query_id"), "left_anti"), "lacking")
    if not lacking.isEmpty():
        blocks = max(spark.sparkContext.defaultParallelism, -(-facts["n"] // task_rows))
        all_ = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("task"), F.lit(False).alias("is_query"), "id", "v", F.array(F.lit(0).cast("long")).alias("buckets"))
        asks = lacking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("task"), F.lit(True).alias("is_query"), "id", "v", F.array(F.lit(0).cast("long")).alias("buckets"))
        met = all_.unionByName(asks).repartitionById(blocks, "task").sortWithinPartitions("task", "is_query")
        more = _merged(met.mapInArrow(partial(_visit, k=k), "query_id long, vec_id long, score double"), k)
        found = found.join(full, "query_id", "left_semi").unionByName(more)
    return found.select("query_id", "rank", "vec_id", "score")
