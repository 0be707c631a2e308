"""Tables of saved state: materials, models and conversations as they are restored and as they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import models as M
from folioflow.functions import state as S


def identity(model: str = "embedding_model", model_id: str = "embedding_model_id") -> Column:
    """What tells which materials can be searched together."""
    return F.coalesce(F.col(model), F.col(model_id), F.lit(""))


def restored_materials(rows: DataFrame) -> DataFrame:
    """Materials with what an older version left out: kind, detail, whether they are on, today's phases."""
    kind = F.coalesce("kind", F.when(F.lower("title").contains("folder"), "folder").otherwise("document"))
    open_ = F.col("status").isin("indexing", "paused")
    return rows.select(
        "id",
        "title",
        F.when(F.col("status") == "indexing", "Parsing").otherwise(F.col("detail")).alias("detail"),
        "status",
        kind.alias("kind"),
        F.coalesce("is_active", F.col("status") == "ready").alias("is_active"),
        F.when(open_, S.phase(F.col("phase"))).otherwise(F.col("phase")).alias("phase"),
        F.when(open_, S.phase_percent(F.col("phase"), F.col("percent"))).otherwise(F.col("percent").cast("int")).alias("percent"),
        F.when(open_, S.phase_message(F.col("phase"), F.col("message"))).otherwise(F.col("message")).alias("message"),
    )


def restored_models(rows: DataFrame) -> DataFrame:
    """Models of known engines, with roles and statuses that hold after a restart."""
    keyed = F.when(M.blank(F.col("api_key")), "needsRuntime").otherwise(F.coalesce("status", F.lit("ready")))
    local = F.when(F.col("status") == "downloading", "incomplete").otherwise(F.coalesce("status", F.when(F.col("path").isNotNull(), "ready").otherwise("missing")))
    status = F.when(F.col("engine") == "ollama", F.coalesce("status", F.lit("ready"))).when(F.col("engine") == "remote", keyed).otherwise(local)
    role = F.when(F.col("engine") == "python", F.coalesce("role", F.lit("generator"))).when(F.col("role").isin("embedder", "both"), F.col("role")).otherwise("generator")
    return rows.where(F.col("engine").isin(M.ENGINES)).select("id", "name", "engine", role.alias("role"), status.alias("status"))


def restored_conversations(rows: DataFrame, saved_version: str, version: str, fresh_id: str) -> DataFrame:
    """(id, title, pos): the saved conversations behind a fresh one; another version's are not kept.

    rows: (id, title, messages, pos). A saved conversation without messages and under the title of new ones is the fresh one.
    """
    kept = rows if saved_version == version else rows.limit(0)
    is_fresh = (F.col("messages") == 0) & (F.col("title") == "New Study Chat")
    kept = kept.withColumn("fresh", F.coalesce(is_fresh, F.lit(False)))
    made = rows.sparkSession.createDataFrame([(fresh_id, "New Study Chat", 0, -1, True)], kept.schema)
    kept = kept.unionByName(made.join(kept.where("fresh").select(F.lit(True).alias("x")).limit(1), F.lit(True), "left_anti"))
    lead = F.row_number().over(Window.partitionBy("fresh").orderBy("pos"))
    order = Window.orderBy(F.when(F.col("fresh") & (F.col("n") == 1), 0).otherwise(1), "pos")  # one user's conversations
    return kept.withColumn("n", lead).select("id", "title", (F.row_number().over(order) - 1).alias("pos"))


def compatible_active(rows: DataFrame) -> DataFrame:
    """Active materials that share the first embedding identity there is, in order of pos; all if none has one."""
    active = rows.where((F.col("status") == "ready") & F.coalesce("is_active", F.lit(True))).withColumn("identity", identity())
    first = active.where("identity != ''").agg(F.min(F.struct("pos", "identity"))["identity"].alias("first"))  # one row
    return active.crossJoin(F.broadcast(first)).where("first is null or identity = first").drop("first", "identity")


def activated(rows: DataFrame, material: str) -> DataFrame:
    """Materials after one is switched: on, it switches off the ready ones that cannot be searched with it."""
    rows = rows.withColumn("identity", identity())
    target = rows.where((F.col("id") == material) & (F.col("status") == "ready")).select((~F.coalesce("is_active", F.lit(True))).alias("next"), F.col("identity").alias("its"))
    met = rows.join(F.broadcast(target.limit(1)), F.lit(True), "left")
    ready, active = F.col("status") == "ready", F.coalesce("is_active", F.lit(True))
    after = F.when(F.col("next").isNull() | ~ready, F.col("is_active")).when(F.col("id") == material, F.col("next")).when(F.col("next") & active & (F.col("identity") != F.col("its")), False).otherwise(F.col("is_active"))
    return met.withColumn("is_active", after).drop("identity", "next", "its")


def transition(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Materials after events (id, action): pause, resume or remove, where their status allows it.

    Only what is being indexed can be paused; what is not and has a path can be resumed; without an embedder (has_embedder) a
    resumed one needs review; removing works from every status. An event for another material does nothing.
    """
    met = rows.join(events, "id", "left")
    action, status = F.coalesce("action", F.lit("")), F.col("status")
    paused = (action == "pause") & (status == "indexing")
    resumed = (action == "resume") & (status != "indexing") & F.col("path").isNotNull()
    after = F.when(paused, "paused").when(resumed & F.col("has_embedder"), "indexing").when(resumed, "needsReview").otherwise(status)
    detail = F.when(paused, "Paused").when(resumed & F.col("has_embedder"), "Resuming").when(resumed, "Needs embedder").otherwise(F.col("detail"))
    percent = F.when(resumed & F.col("has_embedder"), F.greatest(F.lit(1), F.coalesce("percent", F.lit(1)))).when(resumed, F.lit(None)).otherwise(F.when(paused, F.coalesce("percent", F.lit(0))).otherwise(F.col("percent")))
    kept = met.where(action != "remove")
    return kept.select("id", after.alias("status"), detail.alias("detail"), F.when(paused | resumed, False).otherwise(F.col("is_active")).alias("is_active"), percent.alias("percent"))


def after_downloads(models: DataFrame, progress: DataFrame) -> DataFrame:
    """Models (id, status, path, size) with the last progress (model_id, seq, status, path, total) of their downloads."""
    last = progress.groupBy("model_id").agg(F.max(F.struct("seq", "status", "path", "total")).alias("p"))
    met = models.join(last, models["id"] == last["model_id"], "left")
    changed = F.col("p").isNotNull()
    return met.select("id", F.when(changed, M.status_of_download(F.col("p.status"))).otherwise(F.col("status")).alias("status"), F.coalesce("p.path", "path").alias("path"), F.coalesce("p.total", "size").alias("size"))


def pulls(events: DataFrame) -> DataFrame:
    """(model, status, percent, active) of each pull by its last event (model, seq, status, percent)."""
    last = events.groupBy("model").agg(F.max(F.struct("seq", "status", "percent")).alias("e"))
    status = M.status_of_pull(F.col("e.status"))
    return last.select("model", status.alias("status"), M.clamped_percent(F.col("e.percent")).alias("percent"), (status == "downloading").alias("active"))


def source_tray(messages: DataFrame, expanded: str | None = None, cards: int = 5) -> DataFrame:
    """(conversation, id, sources): the expanded assistant message's sources, else the newest's that has some."""
    have = messages.where((F.col("role") == "assistant") & (F.size("sources") > 0))
    best = have.groupBy("conversation").agg(F.max(F.struct((F.col("id") == F.lit(expanded)).alias("wanted"), "pos", "id", "sources")).alias("m"))
    return best.select("conversation", "m.id", F.slice("m.sources", 1, cards).alias("sources"))


def timed_out(events: DataFrame, limit: int = 180) -> DataFrame:
    """(request, timed_out): whether a request was silent for longer than ``limit`` seconds; events are (request, at), end last."""
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("request").orderBy("at"))
    return events.withColumn("gap", gap).groupBy("request").agg(F.coalesce(F.max(F.col("gap") > limit), F.lit(False)).alias("timed_out"))


def key_values(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value) with new values in place of old ones."""
    return old.join(new, "key", "left_anti").select("key", "value").unionByName(new.select("key", "value"))


def distinct_in_order(rows: DataFrame, key: list[str], pos: str, by: list[str]) -> DataFrame:
    """The first row of each key within a group, in order of pos."""
    n = F.row_number().over(Window.partitionBy(*by, *key).orderBy(pos))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")
