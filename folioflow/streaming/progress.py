"""Progress and log events: filters and latest-value state, the same on tables and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of event names that are always worth a line.
TROUBLE = r"(?i)error|failed|failure|timeout|stderr|force_kill"


def worth_logging(events: DataFrame, allowed: list[str], name: str = "event_type") -> DataFrame:
    return events.where(F.col(name).isin(allowed) | F.col(name).rlike(TROUBLE))


def latest_only(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The last request of each key; answers to earlier ones are stale."""
    return events.groupBy(key).agg(F.max(seq).alias(seq))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100 * done / total + 0.5)).otherwise(0).cast("long")


def settled_sum(name: str) -> Column:
    """The sum of a group's few numbers, compensated and in order of size: the same in whatever order rows come."""

    def add(held: Column, x: Column) -> Column:
        s, now = held["s"], held["s"] + x
        lost = F.when(F.abs(s) >= F.abs(x), (s - now) + x).otherwise((x - now) + s)
        return F.struct(now.alias("s"), (held["c"] + lost).alias("c"))

    def done(held: Column) -> Column:
        return F.when(F.isnan(held["c"]), held["s"]).otherwise(held["s"] + held["c"])  # infinite sums lose nothing

    values = F.array_sort(F.collect_list(F.col(name).cast("double")))
    total = F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), add, done)
    return F.when(F.count(name) > 0, total)


def pull_progress(events: DataFrame) -> DataFrame:
    """(model, completed, total, percent) from the last event of each layer (model, digest, seq, completed, total)."""
    layers = events.groupBy("model", "digest").agg(F.max(F.struct("seq", "completed", "total")).alias("e"))
    sums = layers.groupBy("model").agg(settled_sum("e.completed").alias("completed"), settled_sum("e.total").alias("total"))
    return sums.withColumn("percent", percent(F.col("completed"), F.col("total")))
