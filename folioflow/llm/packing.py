"""Mixture-controlled packing: deficit round-robin over one token queue for each source.

Every window (a sequence of 4096 tokens) is filled to the sources' target proportions. A
source's credit grows by its share of each window and falls by what it places; what is left
(a deficit or a surplus, under a token or so) goes into the next window. The stream of
windows is cut into blocks that tasks fill side by side: the same round-robin over blocks
gives each block its interval of every queue and the credits it starts with, so deficits
carry across windows and across partitions. Documents are cut where a share ends.

Only the last block can end within a window; its rest is laid out as sequences whose lengths
are powers of two, which take no padding.

A queue holds a source's documents in the order in which the table is read. What the driver plans and
broadcasts is two numbers for each source and block, CELLS at most; where there are more blocks, it plans
groups of them, and the tasks that need a group's blocks plan those by the same rounds. A task holds the tokens of
one block, whatever the size of the table. Sources must be few (thousands), documents need not.

Defined cases: null text is an empty document (the end id alone); null source is a queue of
its own; repeated rows are packed each; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import gives_back, keeps, rows_of, store, whole_text
from folioflow.llm.tokens import crc32_of, encoder

SEQUENCE = 4096
END_ID = 2
#: Windows in a block, whose tokens a task holds.
BLOCK_WINDOWS = 256
#: Sources times groups of blocks that the driver plans, at most; each takes 16 bytes of the broadcast plan.
CELLS = 1 << 22
#: Rows (a partition and source each) up to which their queue positions are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def round_robin(credit: np.ndarray, weights: np.ndarray, left: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: (tokens that each queue places, credits after), filling ``room`` if the queues can."""
    room = min(room, int(left.sum()))
    live = np.where(left > 0, weights, 0.0)
    if live.sum() <= 0:
        live = (left > 0).astype(float)
    credit = np.where(left > 0, credit, 0.0) + room * live / max(live.sum(), 1e-300)
    take = np.minimum(np.maximum(np.floor(credit), 0).astype(np.int64), left)
    while (short := room - int(take.sum())) != 0:
        if short > 0:  # to those that are owed most, and in proportion where queues have run dry
            open_ = np.flatnonzero(take < left)
            share = live[open_] if live[open_].sum() > 0 else np.ones(len(open_))
            more = np.minimum(np.floor(short * share / share.sum()).astype(np.int64), (left - take)[open_])
            if not more.any():
                owed = np.argsort(-(credit - take)[open_], kind="stable")[:short]
                more[owed] = 1
            take[open_] += more
        else:  # from those that are owed least
            held = np.flatnonzero(take > 0)
            take[held[np.argsort((credit - take)[held], kind="stable")[: -short]]] -= 1
    return take, credit - take


def rounds(totals: np.ndarray, weights: np.ndarray, room: int, credit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounds of ``room`` tokens until the queues are empty: (first token of each queue in each and the totals, credits at each start)."""
    starts, credits, left = [np.zeros(len(totals), dtype=np.int64)], [], totals.copy()
    while left.sum() > 0:
        credits.append(credit)
        take, credit = round_robin(credit, weights, left, room)
        left = left - take
        starts.append(starts[-1] + take)
    return np.array(starts), np.array(credits).reshape(len(credits), len(totals))


class Plan:
    """Which tokens of each queue lie in which block, and the credits that a block starts with."""

    def __init__(self, names: list[str], totals: np.ndarray, weights: np.ndarray, window: int = SEQUENCE, block_windows: int = BLOCK_WINDOWS, cells: int = CELLS):
        self.names, self.weights, self.window, self.block_windows = names, weights, window, block_windows
        blocks = -(-(-(-int(totals.sum()) // window)) // block_windows)
        self.inner = max(1, -(-blocks // max(1, min(1 << 16, cells // max(1, len(totals))))))  # blocks in a group
        self.starts, self.credits = rounds(totals, weights, self.inner * block_windows * window, np.zeros(len(totals)))
        self.numbers, self.known = {q: k for k, q in enumerate(names)}, (-1, None)

    def group(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens of the blocks of a group, one row more at the end, and credits; a group with fewer blocks has fewer rows."""
        if self.inner == 1:
            return self.starts[g : g + 2], self.credits[g : g + 1]
        if self.known[0] != g:
            starts, credits = rounds(self.starts[g + 1] - self.starts[g], self.weights, self.block_windows * self.window, self.credits[g])
            self.known = (g, (self.starts[g] + starts, credits))
        return self.known[1]

    def cut(self, queue: int, at: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(block, start, end) of the parts of n tokens that lie at a place of a queue."""
        done, g = 0, int(np.searchsorted(self.starts[:, queue], at, side="right")) - 1
        while done < n:
            bounds = self.group(g)[0][:, queue]
            k = int(np.searchsorted(bounds, at + done, side="right")) - 1
            while done < n and k + 1 < len(bounds):
                end = min(n, int(bounds[k + 1]) - at)
                if end > done:
                    yield g * self.inner + k, done, end
                    done = end
                k += 1
            g += 1

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(credits, tokens of each queue) of a block."""
        starts, credits = self.group(b // self.inner)
        k = b % self.inner
        return credits[k], starts[k + 1] - starts[k]


@gives_back
@keeps
def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and the tokens of the same queue that the partition holds before."""
    part, before = TaskContext.get().partitionId(), {}
    encode, end = encoder(path).all16, np.array([end_id], dtype="<u2").tobytes()
    for batch in rows_of(batches):
        ids = [x + end for x in encode(batch.column(2).to_pylist())]
        at = []
        for queue, x in zip(batch.column(1).to_pylist(), ids, strict=True):
            at.append(before.get(queue, 0))
            before[queue] = at[-1] + len(x) // 2
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * len(ids), pa.int32()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "queue", "part", "before", "ids"])


@gives_back
def _cut(batches: Iterator[pa.RecordBatch], plan: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, queue, at, ids) to a piece for each block that a document lies in."""
    schema = pa.schema([("block", pa.int64()), ("queue", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in rows_of(batches):
        out = []
        for doc_id, queue, at, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            q, n = plan.value.numbers[queue], len(ids) // 2
            out += [(block, q, at + start, doc_id, start, n, ids[2 * start : 2 * end]) for block, start, end in plan.value.cut(q, at, n)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def layout(credit: np.ndarray, weights: np.ndarray, amounts: np.ndarray, window: int = SEQUENCE) -> list[tuple[int, np.ndarray]]:
    """The rounds of a block: (sequence length, tokens of each queue), short powers of two at the end."""
    rounds, left = [], amounts.copy()
    while (rest := int(left.sum())) > 0:
        room = window if rest >= window else 1 << (rest.bit_length() - 1)
        take, credit = round_robin(credit, weights, left, room)
        left = left - take
        rounds.append((room, take))
    return rounds


@gives_back
def _packed(batches: Iterator[pa.RecordBatch], plan: Broadcast, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of _cut sorted by (block, queue, at); a block's tokens are held until it ends."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])

    def fill(block: int, queues: dict[int, list]) -> Iterator[pa.RecordBatch]:
        out, at, made = [], {q: [0, 0] for q in queues}, plan.value  # for each queue: its piece, and ids used of it
        sources = {q: made.names[q][1:] if made.names[q] else None for q in queues}
        credit, amounts = made.block(block)
        for k, (_, take) in enumerate(layout(credit, made.weights, amounts, made.window)):
            offset = 0
            for q in np.flatnonzero(take):
                want, place, pieces = int(take[q]), at[q], queues[int(q)]
                while want:
                    doc_id, start, doc_tokens, ids = pieces[place[0]]
                    used = place[1]
                    n = min(want, len(ids) // 2 - used)
                    own = ids[2 * used : 2 * (used + n)]
                    out.append((doc_id, sources[int(q)], start + used, n, crc32_of(own), doc_tokens, block * made.block_windows + k, offset, own if with_ids else None))
                    offset, want, place[1] = offset + n, want - n, used + n
                    if 2 * place[1] == len(ids):
                        place[0], place[1] = place[0] + 1, 0
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    block, queues = None, {}
    for batch in batches:
        for b, q, _, doc_id, start, doc_tokens, ids in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if b != block and queues:
                yield from fill(block, queues)
                queues = {}
            block = b
            queues.setdefault(q, []).append((doc_id, start, doc_tokens, ids))
    if queues:
        yield from fill(block, queues)


def pack(docs: DataFrame, tokenizer: str, weights: dict[str | None, float] | None = None, window: int = SEQUENCE, end_id: int = END_ID, block_windows: int = BLOCK_WINDOWS, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents, placed: columns of PIECES and the source.

    ``weights`` are target proportions by source; the default is each source's share of all
    tokens, by which every window holds the corpus's own mixture and all queues end together.
    A source that has no weight, or whose queue is all that is left, fills what others leave.
    """
    spark = docs.sparkSession
    queue = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = docs.select(F.col("doc_id").cast("long"), queue.alias("queue"), whole_text().alias("text"))
    rows = store(rows.mapInArrow(partial(_encoded, path=tokenizer, end_id=end_id), "doc_id long, queue string, part int, before long, ids binary"), "packing-ids")
    parts = rows.groupBy("queue", "part").agg(F.sum(F.length("ids") / 2).cast("long").alias("n"))
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals, key=lambda q: (q == "", q))
    sizes = np.array([totals[q] for q in names], dtype=np.int64)
    shares = sizes.astype(float) if weights is None else np.array([float(weights.get(q[1:] if q else None, 0.0)) for q in names])
    plan = spark.sparkContext.broadcast(Plan(names, sizes, shares, window, block_windows))  # 16 bytes x CELLS at most
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("queue", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if parts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = rows.join(bases, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "ids")
    cut = placed.mapInArrow(partial(_cut, plan=plan), "block long, queue int, at long, doc_id long, start long, doc_tokens long, ids binary")
    cut = cut.repartition("block").sortWithinPartitions("block", "queue", "at")
    return cut.mapInArrow(partial(_packed, plan=plan, with_ids=with_ids), PIECES)
