"""Sharding by balanced label propagation, with DataFrame operations only.

Documents that share a hub (by default: an equal text) are neighbours. Linked documents start
in the shard of their hash. In each round every hub takes the shard in which most of its
bytes lie, every document wants the shard of most of its hubs, and moves happen as far as the
wanted shard's quota of free bytes goes, hub by hub in a seeded order; what does not fit waits
for the next round. Rounds end when nothing moves. Documents without neighbours cut no edges
wherever they lie: they fill each shard up to the mean, in a seeded order.

Law ``bytes``: sizes (UTF-8 bytes plus 1) of shards are equal up to about one document, as long
as documents without neighbours can make up what linked ones leave; a group larger than a
shard is split at the quota.

The driver sees numbers by shard and bounds of hash ranges, never documents. Cumulative sums run over
2**RANGE_BITS ranges of a hash, and only within a range are documents ordered.

Defined cases: null text is an empty one (size 1); null ids are rows like any other; repeated
rows share their text and so are neighbours; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import store

SHARDS = 8
ROUNDS = 6
RANGE_BITS = 12
SEED = 5


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, hub, place) of every row; hub stands for the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("hub"))
    return rows.withColumn("place", F.xxhash64(F.lit(SEED), "doc_id", "hub"))


def _range(column: str):
    return F.shiftrightunsigned(F.col(column), 64 - RANGE_BITS).cast("int")


def propagate(linked: DataFrame, members: DataFrame, room: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(row, size, place, shard): linked rows (row, size, place) moved towards their neighbours.

    ``members`` has (row, hub); ``room`` is a shard's quota in bytes.
    """
    state = store(linked.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")), "shards")
    single = members.groupBy("row").count().where("count > 1").isEmpty()
    for _ in range(rounds):
        votes = members.join(state, "row").groupBy("hub", "shard").agg(F.sum("size").alias("w"))
        labels = votes.groupBy("hub").agg(F.max(F.struct("w", (-F.col("shard")).alias("s"))).alias("best")).select("hub", (-F.col("best.s")).alias("want"), F.col("best.w").alias("w"))
        wishes = members.join(labels, "hub")
        if single:
            wishes = wishes.select("row", "want", F.xxhash64("hub").alias("turn"))
        else:  # most hubs, then the heaviest, decide
            wishes = wishes.groupBy("row", "want").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min(F.xxhash64("hub")).alias("turn"))
            wishes = wishes.groupBy("row").agg(F.max(F.struct("n", "w", (-F.col("want")).alias("s"), "turn")).alias("best")).select("row", (-F.col("best.s")).alias("want"), F.col("best.turn").alias("turn"))
        moves = state.join(wishes, "row").withColumn("step", _range("turn") * 64 + F.shiftrightunsigned("place", 58).cast("int"))
        loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
        free = {s: room - loads.get(s, 0) for s in range(shards)}
        asked = moves.where("want != shard").groupBy("want", "step").agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("want").orderBy("step"))
        quota = F.element_at(F.array(*(F.lit(free[s]) for s in range(shards))), F.col("want") + 1)
        # steps before the first that is beyond the quota
        bounds = {r["want"]: r["step"] for r in asked.withColumn("upto", upto).where(F.col("upto") > quota).groupBy("want").agg(F.min("step").alias("step")).collect()}
        bound = F.element_at(F.array(*(F.lit(bounds.get(s, 1 << 30)) for s in range(shards))), F.col("want") + 1)
        goes = (F.col("want") != F.col("shard")) & (F.col("step") < bound)
        state = store(moves.select("row", "size", "place", F.when(goes, F.col("want")).otherwise(F.col("shard")).alias("shard"), goes.alias("moved")), "shards")
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    return state.select("row", "size", "place", "shard")


def _fill(rows: DataFrame, free: list[int]) -> DataFrame:
    """Rows (size, place) in seeded order cut into shards where their running size passes each one's free bytes."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    open_ = [max(0, f) for f in free]
    scale = total / sum(open_) if sum(open_) else 0.0
    ends, at = [], 0.0
    for f in open_:
        at += f * scale if scale else total / len(open_)
        ends.append(at)
    rows = rows.withColumn("range", _range("place"))
    sums = rows.groupBy("range").agg(F.sum("size").alias("n"))  # 2 ** RANGE_BITS rows at most
    sums = sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("range").orderBy("place", "row").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("before") + inside - F.col("size") / 2
    shard = sum((F.when(middle >= F.lit(e), 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    return rows.join(F.broadcast(sums), "range").withColumn("shard", shard.cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, members: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    rows = store(sized(docs).withColumn("row", F.monotonically_increasing_id()), "sharding")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    room = -(-total // shards)
    if members is None:
        groups = rows.groupBy("hub").count().where("count > 1").select("hub")
        members = store(rows.join(groups, "hub").select("row", "hub"), "sharding-hubs")
    linked = rows.join(members.select("row").distinct(), "row", "left_semi").select("row", "size", "place")
    alone = rows.join(members.select("row").distinct(), "row", "left_anti").select("row", "size", "place")
    moved = propagate(linked, members, room, shards)
    loads = {r["shard"]: r["n"] for r in moved.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    placed = moved.select("row", "shard").unionByName(_fill(alone, [room - loads.get(s, 0) for s in range(shards)]).select("row", "shard"))
    placed = rows.join(placed, "row").withColumn("range", _range("place"))
    counts = placed.groupBy("shard", "range").count()
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "range").orderBy("place", "row"))
    slots = placed.withColumn("rank", rank).join(F.broadcast(bases), ["shard", "range"])  # shards x ranges rows
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
