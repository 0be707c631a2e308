"""Queries of models, saved state, material transitions, logs and sources: on the tables where they have such rows, else on inline rows."""

from __future__ import annotations

import base64
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import models as M
from folioflow.functions import state as S
from folioflow.operators import state
from folioflow.plans.registry import Registry, table, values_sql
from folioflow.sources import logs

R = Registry()


def _rows(rows: list[tuple], names: str, kinds: str):
    """Inline rows as a SQL table and as a maker of a DataFrame; empty text stands for nothing there."""
    columns = names.split(", ")
    schema = ", ".join(f"{c} {k}" for c, k in zip(columns, kinds.split(", "), strict=True))
    sql = f"(SELECT {', '.join(f'CAST({c} AS {_SQL[k]}) AS {c}' for c, k in zip(columns, kinds.split(', '), strict=True))} FROM {values_sql(rows)} v({names}))"
    return sql, lambda spark: spark.createDataFrame(rows, schema)


_SQL = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}

# -- models -------------------------------------------------------------------------------------

_MODELS_SQL, _models = _rows(
    [
        ("m1", "Llama", "ollama", "generator", "ready", None, None, None),
        ("m2", "nomic-embed-text", "ollama", "embedder", "ready", None, None, None),
        ("m3", "Both", "remote", "both", "ready", None, "key", None),
        ("m4", "No key", "remote", None, "ready", None, "  ", None),
        ("m5", "File", "python", "embedder", "downloading", "/m/bge-small-v1.5-q4_K_M.gguf", None, "bge-small-v1.5-q4_K_M.gguf"),
        ("m6", "Gone", "ollama", "odd", "missing", None, None, None),
        ("m7", "Bare", "python", None, None, None, None, "Llama-3-8B-f16.gguf"),
        ("m8", "Other", "else", "both", "ready", None, None, "qwen2-7b.gguf"),
        ("m9", "Path", "python", "both", None, "/m/x.gguf", None, "deepseek r1 int8"),
        (None, "Nameless", None, "both", "ready", None, None, "llama3-Q5_1"),
    ],
    "id, name, engine, role, status, path, api_key, filename",
    "string, string, string, string, string, string, string, string",
)


def _usable_sql(role: str) -> str:
    return f"coalesce(engine <> 'python' AND NOT coalesce(status IN ('needsRuntime', 'missing'), false) AND coalesce(role, 'generator') IN ('{role}', 'both'), false)"


@R.add("model_role_filters", f"SELECT name, {_usable_sql('generator')} AS can_generate, {_usable_sql('embedder')} AS can_embed FROM {_MODELS_SQL}")
def model_role_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [F.col(c) for c in ("engine", "role", "status")]
    return _models(spark).select("name", M.usable(*own, "generator").alias("can_generate"), M.usable(*own, "embedder").alias("can_embed"))


_INSTALLED_SQL, _installed = _rows(
    [("llama3.2:3b", "llama3.2:3b", "llama", 2.0), ("nomic-embed-text:latest", None, "nomic-bert", 0.3), ("mxbai", "mxbai-embed-large", None, 0.7), ("e5small", None, None, 0.1), ("my-e5", None, "bert", 0.1), (None, "llama3.2", "x", 0.2), ("bert", None, "MiniLM v2", 0.4)],
    "name, model, family, size",
    "string, string, string, double",
)


@R.add("infer_role", rf"SELECT name, model, CASE WHEN regexp_matches(lower(concat_ws(' ', name, coalesce(model, ''), coalesce(family, ''))), '\b(embed|embedding|nomic|bge|minilm|e5)\b') THEN 'embedder' ELSE 'generator' END AS role FROM {_INSTALLED_SQL}")
def infer_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _installed(spark).select("name", "model", M.inferred_role(F.col("name"), F.col("model"), F.col("family")).alias("role"))


@R.add("installed_models", f"WITH m AS (SELECT coalesce(nullif(model, ''), name) AS name, size FROM {_INSTALLED_SQL} WHERE coalesce(nullif(model, ''), name) IS NOT NULL), n AS (SELECT *, regexp_replace(lower(trim(name)), ':latest$', '') AS plain FROM m) SELECT name, size, (SELECT bool_or(plain = 'llama3.2' OR starts_with(plain, 'llama3.2:')) FROM n) AS has_chat, (SELECT bool_or(plain = 'bge-m3' OR starts_with(plain, 'bge-m3:')) FROM n) AS has_embedder FROM n")
def installed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.functions.names import same_model

    rows = _installed(spark).select(F.coalesce(F.nullif("model", F.lit("")), "name").alias("name"), "size").where("name is not null")
    flags = rows.agg(*(F.max(same_model(F.col("name"), F.lit(x))).alias(c) for c, x in (("has_chat", "llama3.2"), ("has_embedder", "bge-m3"))))
    return rows.crossJoin(F.broadcast(flags))  # one row of flags


@R.add(
    "filename_quant_type",
    f"SELECT name, coalesce(nullif(regexp_extract(filename, '(?i)(?:^|[-_. ])(q[0-9](?:[-_][a-z0-9]+)*|f16|fp16|bf16|int8|int4)(?:\\.gguf)?$', 1), ''), 'GGUF') AS quant, CASE WHEN contains(lower(coalesce(filename, '')), 'llama-3') OR contains(lower(coalesce(filename, '')), 'llama3') THEN 'LLaMA3' WHEN contains(lower(coalesce(filename, '')), 'qwen') THEN 'qwen2' WHEN contains(lower(coalesce(filename, '')), 'deepseek') THEN 'deepseek' ELSE 'GGUF' END AS type FROM {_MODELS_SQL}",
)
def filename_quant_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark).select("name", M.quant_of(F.col("filename")).alias("quant"), M.type_of(F.col("filename")).alias("type"))


@R.add(
    "normalize_models",
    f"""SELECT id, name, engine,
    CASE WHEN engine = 'python' THEN coalesce(role, 'generator') WHEN role IN ('embedder', 'both') THEN role ELSE 'generator' END AS role,
    CASE engine WHEN 'ollama' THEN coalesce(status, 'ready') WHEN 'remote' THEN CASE WHEN trim(coalesce(api_key, '')) = '' THEN 'needsRuntime' ELSE coalesce(status, 'ready') END
        ELSE CASE WHEN status = 'downloading' THEN 'incomplete' ELSE coalesce(status, CASE WHEN path IS NULL THEN 'missing' ELSE 'ready' END) END END AS status
    FROM {_MODELS_SQL} WHERE engine IN ('python', 'ollama', 'remote')""",
)
def normalize_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.restored_models(_models(spark))


@R.add("ollama_pull_key", f"SELECT name, 'http://host:11434' || '::' || regexp_replace(lower(trim(name)), ':latest$', '') AS key FROM {_INSTALLED_SQL}")
def pull_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _installed(spark).select("name", M.pull_key(F.lit("http://host:11434"), F.col("name")).alias("key"))


_ERRORS_SQL, _errors = _rows([(404, "x"), (500, "Model 'a' NOT found"), (500, "file does not exist"), (500, "busy"), (400, None), (None, "it does not exist")], "status, detail", "int, string")


@R.add("missing_model_error", f"SELECT status, detail, coalesce(status = 404 OR regexp_matches(detail, '(?i)file does not exist|model.*not found|not found|does not exist'), false) AS missing FROM {_ERRORS_SQL}")
def missing_model_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark).select("status", "detail", M.is_missing_error(F.col("status"), F.col("detail")).alias("missing"))


@R.add("engine_dispatch", f"SELECT name, CASE engine WHEN 'ollama' THEN 'local' WHEN 'remote' THEN 'remote' ELSE 'rejected' END AS target FROM {_MODELS_SQL}")
def engine_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark).select("name", M.engine_for(F.col("engine")).alias("target"))


_RUNS_SQL, _runs = _rows([("cpu", 20, 0.0), ("gpu", 20, 0.05), ("auto", -1, -0.1), (None, 3, None)], "device, layers, min_p", "string, int, double")


@R.add("completion_options", f"SELECT device, CASE WHEN device = 'cpu' THEN 0 ELSE layers END AS gpu_layers, CASE WHEN min_p > 0 THEN min_p END AS min_p FROM {_RUNS_SQL}")
def completion_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark).select("device", M.options(F.col("device"), F.col("layers"), F.col("min_p")).alias("o")).select("device", "o.*")


_PULLS_SQL, _pulls = _rows([("a", 1, "starting", 0.0, None, 10), ("a", 2, "downloading", 41.5, None, 10), ("a", 3, "complete", 100.0, "/p/a", 10), ("b", 1, "starting", None, None, None), ("b", 2, "pulling", 140.0, None, 7), ("c", 1, "removed", -3.0, None, 1), ("d", 5, "error", 12.4, None, 9), ("d", 4, "complete", 100.0, "/p/d", 9)], "model, seq, status, percent, path, total", "string, int, string, double, string, int")


@R.add(
    "pull_lifecycle",
    f"SELECT model, status, percent, status = 'downloading' AS active FROM (SELECT model, CASE WHEN status IN ('complete', 'incomplete', 'removed', 'error') THEN status ELSE 'downloading' END AS status, CAST(greatest(0, least(100, floor(coalesce(percent, 0) + 0.5))) AS INTEGER) AS percent FROM {_PULLS_SQL} QUALIFY row_number() OVER (PARTITION BY model ORDER BY seq DESC) = 1)",
)
def pull_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pulls(_pulls(spark))


_LOCAL_SQL, _local = _rows([("a", "downloading", "/old", 1), ("b", "ready", "/b", 2), ("d", "downloading", None, None), ("z", "ready", "/z", 4)], "id, status, path, size", "string, string, string, int")


@R.add(
    "download_status",
    f"SELECT id, CASE WHEN p.model IS NULL THEN m.status WHEN p.status = 'complete' THEN 'ready' WHEN p.status = 'incomplete' THEN 'incomplete' WHEN p.status = 'error' THEN 'downloadError' ELSE 'downloading' END AS status, coalesce(p.path, m.path) AS path, coalesce(p.total, m.size) AS size FROM {_LOCAL_SQL} m LEFT JOIN (SELECT * FROM {_PULLS_SQL} QUALIFY row_number() OVER (PARTITION BY model ORDER BY seq DESC) = 1) p ON m.id = p.model",
)
def download_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.after_downloads(_local(spark), _pulls(spark).withColumnRenamed("model", "model_id"))


# -- materials ------------------------------------------------------------------------------------

_MATERIALS_SQL, _materials = _rows(
    [
        (0, "a", "Intro to Disks.pdf", "ready", True, None, None, "nomic-embed-text", None, None, None, None, "/lib/Intro to Disks.pdf", 100, "Done", True),
        (1, "b", "Course Folder", "ready", None, "id2", "bge-small", None, None, "extracting", 30.4, "Reading files", "/lib/course", None, "Done", True),
        (2, "c", "Notes.md", "indexing", False, "id2", None, None, None, "queued", 0.2, "Waiting", "/lib/notes.md", 3, "x", True),
        (3, "d", "Old", "paused", None, None, None, "llama-cpp:123", "folder", "embedding", 250.0, None, "/lib/old", 40, "y", False),
        (4, "e", " ", "ready", False, "id3", "id3-name", "remote-openai:9", "document", None, None, None, "/lib/e.txt", None, "z", True),
        (5, "f", "Same  embedder.txt", "ready", True, None, "Qwen3 v2", "nomic-embed-text", None, "saving", 9.0, "Saving", None, None, "w", True),
        (6, "g", "Review", "needsReview", None, None, None, None, None, "extracting", None, None, "/lib/g", 0, "v", False),
        (7, "h", "Second", "indexing", None, None, None, None, None, None, None, "", "/lib/h", None, "u", True),
    ],
    "pos, id, title, status, is_active, embedding_model_id, embedding_model_name, embedding_model, kind, phase, percent, message, path, files, detail, has_embedder",
    "int, string, string, string, boolean, string, string, string, string, string, double, string, string, int, string, boolean",
)
_IDENTITY = "coalesce(embedding_model, embedding_model_id, '')"


@R.add(
    "normalize_materials",
    f"""SELECT id, title, CASE WHEN status = 'indexing' THEN 'Parsing' ELSE detail END AS detail, status,
    coalesce(kind, CASE WHEN contains(lower(title), 'folder') THEN 'folder' ELSE 'document' END) AS kind, coalesce(is_active, status = 'ready') AS is_active,
    CASE WHEN status NOT IN ('indexing', 'paused') THEN phase WHEN phase IN ('chunking', 'embedding', 'saving', 'complete', 'error') THEN phase ELSE 'parsing' END AS phase,
    CASE WHEN status NOT IN ('indexing', 'paused') THEN CAST(trunc(percent) AS INTEGER) ELSE CAST(greatest(CASE WHEN phase = 'queued' THEN 1 ELSE 0 END, least(100, floor(coalesce(percent, 1) + 0.5))) AS INTEGER) END AS percent,
    CASE WHEN status NOT IN ('indexing', 'paused') THEN message WHEN phase = 'queued' THEN 'Parsing' WHEN phase = 'extracting' THEN regexp_replace(coalesce(nullif(message, ''), 'Parsing'), '^Reading', 'Parsing') ELSE coalesce(nullif(message, ''), 'Parsing') END AS message
    FROM {_MATERIALS_SQL}""",
)
def normalize_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.restored_materials(_materials(spark))


_ACTIVE = "status = 'ready' AND coalesce(is_active, true)"


@R.add("compatible_active", f"WITH a AS (SELECT *, {_IDENTITY} AS own FROM {_MATERIALS_SQL} WHERE {_ACTIVE}) SELECT id, title FROM a WHERE coalesce(own = (SELECT own FROM a WHERE own <> '' ORDER BY pos LIMIT 1), true)")
def compatible_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.compatible_active(_materials(spark)).select("id", "title")


@R.add(
    "exclusive_activation",
    f"""SELECT t.id AS switched, m.id, CASE WHEN m.status <> 'ready' OR t.status <> 'ready' THEN m.is_active WHEN m.id = t.id THEN NOT coalesce(t.is_active, true)
    WHEN NOT coalesce(t.is_active, true) AND coalesce(m.is_active, true) AND coalesce(m.embedding_model, m.embedding_model_id, '') <> coalesce(t.embedding_model, t.embedding_model_id, '') THEN false ELSE m.is_active END AS is_active
    FROM {_MATERIALS_SQL} m, {_MATERIALS_SQL} t WHERE t.id IN ('a', 'c', 'e')""",
)
def exclusive_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _materials(spark)
    parts = [state.activated(rows, x).select(F.lit(x).alias("switched"), "id", "is_active") for x in ("a", "c", "e")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ACTIONS_SQL, _actions = _rows([("a", "resume"), ("b", "pause"), ("c", "pause"), ("d", "resume"), ("e", "remove"), ("f", "resume"), ("g", "resume"), ("zz", "remove")], "id, action", "string, string")


@R.add(
    "material_transitions",
    f"""SELECT m.id, CASE WHEN paused THEN 'paused' WHEN resumed THEN CASE WHEN has_embedder THEN 'indexing' ELSE 'needsReview' END ELSE status END AS status,
    CASE WHEN paused THEN 'Paused' WHEN resumed THEN CASE WHEN has_embedder THEN 'Resuming' ELSE 'Needs embedder' END ELSE detail END AS detail,
    CASE WHEN paused OR resumed THEN false ELSE is_active END AS is_active,
    CASE WHEN resumed AND has_embedder THEN greatest(1, coalesce(percent, 1)) WHEN resumed THEN NULL WHEN paused THEN coalesce(percent, 0) ELSE percent END AS percent
    FROM (SELECT m.*, coalesce(action, '') AS act, coalesce(action = 'pause' AND status = 'indexing', false) AS paused, coalesce(action = 'resume' AND status <> 'indexing' AND path IS NOT NULL, false) AS resumed
        FROM {_MATERIALS_SQL} m LEFT JOIN {_ACTIONS_SQL} e ON m.id = e.id) m WHERE act <> 'remove'""",
)
def material_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.transition(_materials(spark), _actions(spark))


@R.add("embedding_models_for_materials", f"WITH w AS (SELECT embedding_model_id AS id FROM {_MATERIALS_SQL} WHERE embedding_model_id <> '' ORDER BY pos LIMIT 1), m AS (SELECT * FROM {_MODELS_SQL} WHERE {_usable_sql('embedder')}) SELECT id, name FROM m WHERE id IN (SELECT id FROM w) OR NOT EXISTS (SELECT 1 FROM m JOIN w USING (id))")
def embedding_models_for_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _materials(spark).where("embedding_model_id != ''").agg(F.min(F.struct("pos", "embedding_model_id"))["embedding_model_id"].alias("wanted"))
    models = _models(spark).where(M.usable(F.col("engine"), F.col("role"), F.col("status"), "embedder"))
    met = models.crossJoin(F.broadcast(wanted))  # one row
    there = met.agg(F.coalesce(F.max(F.col("id") == F.col("wanted")), F.lit(False)).alias("there"))
    return met.crossJoin(F.broadcast(there)).where(~F.col("there") | (F.col("id") == F.col("wanted"))).select("id", "name")


def _embedder_sql(x: str) -> str:
    token = rf"list_filter(string_split_regex(coalesce({x}, ''), '[-_\s:/.]+'), lambda t: regexp_matches(t, '(?i)[a-z0-9]'))[1]"
    cased = f"CASE WHEN upper({token}) = 'BGE' THEN 'BGE' WHEN regexp_full_match({token}, '(?i)[0-9]+(\\.[0-9]+)?B') THEN upper({token}) WHEN regexp_full_match({token}, '(?i)v[0-9]+(\\.[0-9]+)?') THEN lower({token}) ELSE upper({token}[1]) || {token}[2:] END"
    return f"CASE WHEN starts_with(coalesce({x}, ''), 'llama-cpp:') OR starts_with(coalesce({x}, ''), 'remote-openai:') THEN NULL ELSE {cased} END"


@R.add("embedder_label", f"SELECT id, CASE WHEN own IS NULL OR first IS NULL THEN own ELSE first || '-' || own END AS label FROM (SELECT id, coalesce({_embedder_sql('embedding_model')}, {_embedder_sql('embedding_model_name')}) AS own, nullif(string_split(trim(regexp_replace(regexp_replace(title, '(?i)\\.(pdf|md|markdown|txt)$', ''), '\\s+', ' ', 'g')), ' ')[1], '') AS first FROM {_MATERIALS_SQL})")
def embedder_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materials(spark).select("id", M.embedder_label(F.col("title"), F.col("embedding_model"), F.col("embedding_model_name")).alias("label"))


@R.add("no_materials_reason", f"SELECT what, CASE WHEN count(*) FILTER (WHERE status = 'ready') > 0 THEN 'no_enabled_materials' ELSE 'no_materials' END AS reason FROM (SELECT 'all' AS what, status FROM {_MATERIALS_SQL} UNION ALL SELECT 'open', status FROM {_MATERIALS_SQL} WHERE status <> 'ready') GROUP BY what")
def no_materials_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _materials(spark)
    both = rows.select(F.lit("all").alias("what"), "status").unionByName(rows.where("status != 'ready'").select(F.lit("open").alias("what"), "status"))
    return both.groupBy("what").agg(F.when(F.count_if(F.col("status") == "ready") > 0, "no_enabled_materials").otherwise("no_materials").alias("reason"))


_TIMES_SQL, _times = _rows([("a", "2024-01-02T00:00:00Z", None, 5), ("b", None, "2024-03-01T00:00:00Z", 6), ("c", None, None, 1700000000000), ("d", "2023-01-01T00:00:00Z", "2025-01-01T00:00:00Z", 7)], "id, indexed_at, added_at, updated", "string, string, string, long")


@R.add("list_order", f"SELECT id, CAST(row_number() OVER (ORDER BY coalesce(indexed_at, added_at, CAST(updated AS VARCHAR)) DESC, id) AS INTEGER) AS pos FROM {_TIMES_SQL}")
def list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.operators.materials import listed

    return listed(_times(spark)).select("id", "pos")


@R.add("pick_material", f"SELECT id, regexp_extract(regexp_replace(path, '^.*/', ''), '^(.+?)(?:\\.[^.]*)?$', 1) AS title, 'indexing' AS status, CASE WHEN kind = 'folder' THEN 'folder' ELSE 'document' END AS kind, CASE WHEN kind = 'folder' THEN 'Parsing folder' ELSE 'Parsing file' END AS detail, CASE WHEN kind = 'folder' THEN 0 ELSE 1 END AS files, false AS is_active, 'parsing' AS phase, 1 AS percent FROM {_MATERIALS_SQL} WHERE path IS NOT NULL")
def pick_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.operators.materials import picked

    return picked(_materials(spark).where("path is not null"), F.col("kind").eqNullSafe("folder"))


_SAVED_SQL, _saved = _rows([("c1", "About disks", 4, 0), ("c2", "New Study Chat", 0, 1), ("c3", "New Study Chat", 0, 2), ("c4", "New Study Chat", 2, 3)], "id, title, messages, pos", "string, string, int, int")


def _restored_sql(where: str) -> str:
    kept = f"SELECT *, messages = 0 AND title = 'New Study Chat' AS fresh FROM {_SAVED_SQL} WHERE {where}"
    every = f"SELECT id, title, pos, fresh FROM ({kept}) UNION ALL SELECT 'new', 'New Study Chat', -1, true WHERE NOT EXISTS (SELECT 1 FROM ({kept}) WHERE fresh)"
    return f"SELECT id, title, CAST(row_number() OVER (ORDER BY first DESC, pos) - 1 AS INTEGER) AS pos FROM (SELECT *, fresh AND row_number() OVER (PARTITION BY fresh ORDER BY pos) = 1 AS first FROM ({every}))"


@R.add("merge_saved_state", f"SELECT 'same' AS version, * FROM ({_restored_sql('true')}) UNION ALL SELECT 'other', * FROM ({_restored_sql('false')}) UNION ALL SELECT 'busy', * FROM ({_restored_sql('messages > 0')})")
def merge_saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _saved(spark)
    parts = [state.restored_conversations(r, v, "2", "new").select(F.lit(n).alias("version"), "*") for n, r, v in (("same", rows, "2"), ("other", rows, "1"), ("busy", rows.where("messages > 0"), "2"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_KV_SQL, _kv = _rows([("version", "1"), ("model", "a")], "key, value", "string, string")
_KV2_SQL, _kv2 = _rows([("version", "2"), ("new", "x")], "key, value", "string, string")


@R.add("schema_kv", f"SELECT * FROM {_KV2_SQL} UNION ALL SELECT * FROM {_KV_SQL} WHERE key NOT IN (SELECT key FROM {_KV2_SQL})")
def schema_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.key_values(_kv(spark), _kv2(spark))


# -- sources ---------------------------------------------------------------------------------------


@R.add("quiz_source_key", "SELECT doc_id, source || '|' || doc_id || CASE WHEN coalesce(lang, '') = '' THEN '' ELSE '|' || lang END || CASE WHEN trim(substr(text, 1, 120)) = '' THEN '' ELSE '|' || substr(text, 1, 120) END AS key FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def quiz_source_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source is not null and text is not null")
    return rows.select("doc_id", S.source_identity(F.col("source"), F.col("doc_id"), F.col("lang"), F.substring("text", 1, 120)).alias("key"))


@R.add("used_keys_union", "SELECT conv_id, array_to_string(list_sort(list_distinct(list(role) || list(CAST(turn % 3 AS VARCHAR)))), '|') AS keys FROM conversations GROUP BY conv_id")
def used_keys_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("used"), F.collect_set((F.col("turn") % 3).cast("string")).alias("fresh"))
    return rows.select("conv_id", F.array_join(F.array_sort(S.union_of_keys(F.col("used"), F.col("fresh"))), "|").alias("keys"))


@R.add("carried_sources", "SELECT conv_id, array_to_string(flatten(list(CASE WHEN turn % 3 = 0 THEN [] ELSE ['s' || turn, 't' || turn, 'u' || turn] END ORDER BY turn, role, text))[1:2], ',') AS sources FROM conversations GROUP BY conv_id")
def carried_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn").cast("string")
    own = F.when(F.col("turn") % 3 != 0, F.array(*(F.concat(F.lit(x), t) for x in "stu")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", own.alias("s")))).alias("turns"))
    return rows.select("conv_id", F.array_join(S.carried(F.transform("turns", lambda x: x["s"])), ",").alias("sources"))


@R.add("quiz_question_texts", "SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM conversations WHERE role = 'user' AND trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def quiz_question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.functions.text import strip

    rows = table(spark, sf_dir, "conversations").withColumn("kind", F.when(F.col("role") == "user", "quizQuestion"))
    return rows.where("kind = 'quizQuestion'").select("conv_id", "turn", strip("text").alias("text")).where("text != ''")


@R.add("source_tray", "SELECT conv_id AS conversation, turn AS id, array_to_string(list_transform(range(turn % 4 + 3), lambda k: 'x' || k)[1:5], ',') AS sources FROM conversations WHERE role = 'assistant' AND turn % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def source_tray(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("turn") % 4 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("turn") % 4 + 2), lambda k: F.concat(F.lit("x"), k.cast("string"))))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation"), F.col("turn").alias("id"), F.col("turn").alias("pos"), "role", made.alias("sources"))
    return state.source_tray(rows).withColumn("sources", F.array_join("sources", ","))


@R.add("log_source_projection", "SELECT doc_id, source AS title, lang AS locator, substr(text, 1, 50) AS excerpt FROM documents")
def log_source_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("locator"), F.substring("text", 1, 50).alias("excerpt"), F.lit("secret").alias("apiKey"))
    kept = [c for c in S.LOGGED if c in rows.columns]
    return rows.select("doc_id", *kept)


_QUOTES = [
    (1, '"The platter spins at a constant speed, and the arm moves across it." So it is fast.'),
    (2, "“seek time is the time that the arm needs, to reach the right track of a disk” is what it says"),
    (3, '"Nothing of this is in any of the sources that were given to you here."'),
    (4, '"too short" and no more'),
    (5, 'Before "The platter spins at a constant speed, and the arm moves across it."'),
    (6, None),
]
_QUOTES_SQL, _quotes = _rows(_QUOTES, "id, text", "int, string")
_EXCERPTS = ["Seek time is the time that the arm needs to reach the right track", "On a disk the PLATTER spins at a constant speed; and the arm moves across it -- always", "else"]


def _plain_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@R.add(
    "quoted_source_index",
    f"SELECT id, (SELECT min(k) FROM (VALUES {', '.join(f'({k}, {chr(39)}{x}{chr(39)})' for k, x in enumerate(_EXCERPTS, 1))}) e(k, x) WHERE q <> '' AND (contains({_plain_sql('x')}, q) OR contains(q, {_plain_sql('x')}))) AS number FROM (SELECT id, {_plain_sql('coalesce(regexp_extract(text, ' + chr(39) + S.QUOTE + chr(39) + ', 1), ' + chr(39) * 2 + ')')} AS q FROM {_QUOTES_SQL})",
)
def quoted_source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(spark).select("id", S.quoted_source(F.col("text"), F.array(*map(F.lit, _EXCERPTS))).cast("int").alias("number"))


_LOOKUPS_SQL, _lookups = _rows(
    [("s1", "/lib/course/a.pdf", "3", None), ("s2", "/lib/course/b.PDF", "0", "T"), ("s3", "/lib/course2/c.pdf", "2.6", None), ("s4", "/lib/Intro to Disks.pdf", "x", None), ("s5", "/lib/course/n.txt", "1", None), ("s6", None, "1", None)],
    "id, path, page, title",
    "string, string, string, string",
)


@R.add(
    "source_pdf_resolve",
    f"SELECT s.id, s.path, coalesce(s.title, regexp_extract(s.path, '([^/]*)\\.[^./]*$', 1)) AS title, CASE WHEN try_cast(page AS DOUBLE) > 0 THEN CAST(floor(try_cast(page AS DOUBLE) + 0.5) AS INTEGER) END AS page FROM {_LOOKUPS_SQL} s WHERE lower(s.path) LIKE '%.pdf' AND EXISTS (SELECT 1 FROM {_MATERIALS_SQL} m WHERE s.path = m.path OR (m.kind = 'folder' OR contains(lower(m.title), 'folder')) AND starts_with(s.path, m.path || '/'))",
)
def source_pdf_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.operators.materials import allowed_pdfs

    found = allowed_pdfs(_lookups(spark), state.restored_materials(_materials(spark)).select("id", "kind").join(_materials(spark).select("id", "path"), "id"))
    return found.select("id", "path", F.coalesce("title", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)).alias("title"), S.page_number(F.col("page")).alias("page"))


@R.add("thumbnail_resolve", f"SELECT id, CASE WHEN page_ IS NULL THEN NULL ELSE '/cache/' || substr(sha256(path), 1, 20) || '/page-' || lpad(CAST(page_ AS VARCHAR), 4, '0') || '.png' END AS thumbnail FROM (SELECT id, path, CASE WHEN try_cast(page AS DOUBLE) > 0 THEN CAST(floor(try_cast(page AS DOUBLE) + 0.5) AS INTEGER) END AS page_ FROM {_LOOKUPS_SQL} WHERE path IS NOT NULL)")
def thumbnail_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.operators.materials import cached_thumbnail

    rows = _lookups(spark).where("path is not null")
    return rows.select("id", cached_thumbnail("/cache", F.lit("/elsewhere/p.png"), F.lit("/cache/x.jpg"), F.col("path"), S.page_number(F.col("page"))).alias("thumbnail"))


# -- prompts, lists, numbers, times ---------------------------------------------------------------------


@R.add("chat_template", "SELECT conv_id, string_agg(role || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) || chr(10) || chr(10) || 'assistant:' || chr(10) AS prompt FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", S.unrendered(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("prompt"))


_LISTS_SQL, _lists = _rows([(1, '["a", 2, "b", null, {"c": "d"}]'), (2, "not json"), (3, '{"a": "b"}'), (4, None), (5, "[]"), (6, '["x y"]'), (7, "")], "id, value", "int, string")


@R.add("json_list", f"SELECT id, array_to_string([json_extract_string(x, '$') FOR x IN CAST(CASE WHEN json_type(v) = 'ARRAY' THEN v ELSE '[]' END AS JSON[]) IF json_type(x) = 'VARCHAR'], '|') AS items FROM (SELECT id, CASE WHEN json_valid(value) THEN value ELSE '[]' END AS v FROM {_LISTS_SQL})")
def json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark).select("id", F.array_join(S.string_list(F.col("value")), "|").alias("items"))


@R.add("format_number", "SELECT DISTINCT n_chars AS n, printf('%,d', n_chars) AS text FROM (SELECT n_chars FROM documents WHERE n_chars IS NOT NULL UNION ALL SELECT CAST(n_chars AS BIGINT) * 1000003 FROM documents WHERE n_chars IS NOT NULL)")
def format_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").where("n_chars is not null").select(F.col("n_chars").cast("long").alias("n"))
    return n.unionByName(n.select((F.col("n") * 1000003).alias("n"))).distinct().select("n", S.grouped_number(F.col("n")).alias("text"))


_SAID_SQL, _said = _rows([(1, "Error invoking remote method 'engine:chat': Error: fetch failed"), (2, "Error invoking remote method 'x': Error:   "), (3, "connect ECONNREFUSED 127.0.0.1:11434"), (4, "Plain trouble "), (5, None), (6, "ERROR INVOKING REMOTE METHOD 'a b': error: Busy")], "id, text", "int, string")


@R.add("error_text", f"SELECT id, CASE WHEN regexp_matches(t, '{S.UNREACHABLE}') THEN '{S.NOT_RUNNING}' ELSE t END AS text FROM (SELECT id, coalesce(nullif(trim(regexp_replace(text, '{S.REMOTE_PREFIX.replace(chr(39), chr(39) * 2)}', '')), ''), 'Could not reach it.') AS t FROM {_SAID_SQL})")
def error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark).select("id", S.readable_error(F.col("text"), "Could not reach it.").alias("text"))


@R.add("iso_local", "SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS seconds, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS millis FROM events")
def iso_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", F.regexp_replace(S.iso_local(F.col("ts")), "Z$", "+00:00").alias("seconds"), F.regexp_replace(S.iso_local(F.col("ts"), True), "Z$", "+00:00").alias("millis"))


# -- logs and bytes ----------------------------------------------------------------------------------------

_LINES = [(1, 0, '{"event": "start", "time": "t0", "score": 0.12345}'), (1, 1, "  "), (1, 2, "broken {"), (1, 3, '{"time": "t1", "title": " ", "documentTitle": "Doc"}'), (1, 4, '{"event": "search_done_now"}'), (2, 0, " raw "), (2, 1, "[1]")]
_LINES_SQL, _lines = _rows(_LINES, "log, pos, value", "int, int, string")
_GOOD = "json_valid(value) AND starts_with(ltrim(value), '{')"


def _field(name: str) -> str:
    return f"CASE WHEN {_GOOD} THEN json_extract_string(value, '$.{name}') END"


@R.add(
    "read_log",
    f"SELECT log, CASE WHEN {_GOOD} THEN k || '-' || coalesce({_field('time')}, '') || '-' || coalesce({_field('event')}, 'event') ELSE k || '-raw' END AS id, CASE WHEN {_GOOD} THEN coalesce({_field('event')}, 'log_event') ELSE 'raw_log_line' END AS event, CASE WHEN NOT ({_GOOD}) THEN trim(value) END AS raw FROM (SELECT *, row_number() OVER (PARTITION BY log ORDER BY pos) - 1 AS k FROM {_LINES_SQL} WHERE trim(value) <> '')",
)
def read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.numbered_log(_lines(spark))


@R.add("log_accessors", f"SELECT log, pos, coalesce(nullif(trim({_field('title')}), ''), {_field('documentTitle')}, 'Source ' || (pos + 1)) AS title, printf('%.3f', CAST({_field('score')} AS DOUBLE)) AS score, replace({_field('event')}, '_', ' ') AS event FROM {_LINES_SQL}")
def log_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda name: F.when(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"), F.get_json_object("value", f"$.{name}"))
    score = get("score").try_cast("double")
    return _lines(spark).select("log", "pos", S.first_filled(get("title"), get("documentTitle"), F.concat(F.lit("Source "), (F.col("pos") + 1).cast("string"))).alias("title"), F.when(score.isNotNull(), F.format_string("%.3f", score)).alias("score"), F.replace(get("event"), F.lit("_"), F.lit(" ")).alias("event"))


@R.add("tail_log", "SELECT doc_id, CASE WHEN strlen(text) > 500 THEN right(text, 500) ELSE text END AS tail FROM documents")
def tail_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", logs.tail(F.col("text"), 500).alias("tail"))


_PIECES_SQL, _pieces = _rows([(1, 0, '{"id": 1}\n{"i'), (1, 1, 'd": 2}\r\n'), (1, 2, "\nnoise\n"), (1, 3, '{"id": 3}'), (2, 0, '{"id": 9}\n')], "stream, pos, data", "int, int, string")


@R.add("ndjson_framing", f"SELECT stream, CAST(k - 1 AS INTEGER) AS n, line FROM (SELECT stream, generate_subscripts(s, 1) AS k, len(s) AS total, unnest(s) AS line FROM (SELECT stream, string_split_regex(string_agg(data, '' ORDER BY pos), '\\r?\\n') AS s FROM {_PIECES_SQL} GROUP BY stream)) WHERE k < total AND trim(line) <> '' AND json_valid(line)")
def ndjson_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.frames(_pieces(spark))


@R.add("progress_timeout", "SELECT user_id, coalesce(max(gap) > 3600, false) AS timed_out FROM (SELECT user_id, epoch(CAST(ts AS TIMESTAMP)) - lag(epoch(CAST(ts AS TIMESTAMP))) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) GROUP BY user_id")
def progress_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), F.col("ts").cast("timestamp").cast("double").alias("at"))
    return state.timed_out(rows, 3600).withColumnRenamed("request", "user_id")


@R.add("scan_embedding_blob", "SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def scan_embedding_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as blobs and read back."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", logs.blob_of("embedding").alias("b"))
    return rows.select("vec_id", logs.vector_of("b").alias("v")).select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


_HEADER = b"GGUF" + struct.pack("<IQQ", 3, 0, 3) + b"".join([struct.pack("<Q", 1) + b"n" + struct.pack("<II", 4, 7), struct.pack("<Q", 1) + b"a" + struct.pack("<IIQ", 9, 8, 2) + (struct.pack("<Q", 2) + b"xy") * 2, struct.pack("<Q", 23) + b"tokenizer.chat_template" + struct.pack("<IQ", 8, 5) + b"hello"])
_FILES_SQL, _files = _rows([(1, base64.b64encode(_HEADER).decode()), (2, base64.b64encode(_HEADER[:60]).decode()), (3, base64.b64encode(b"other").decode())], "id, data", "int, string")


@R.add("gguf_metadata", f"SELECT id, CASE WHEN starts_with(d, 'GGUF') AND contains(d, 'tokenizer.chat_template') THEN right(d, 5) END AS template FROM (SELECT id, decode(list_aggregate([CASE WHEN c > 127 THEN '?' ELSE chr(c) END FOR c IN list_transform(range(octet_length(from_base64(data))), lambda k: CAST('0x' || substr(hex(from_base64(data)), 2 * k + 1, 2) AS INTEGER))], 'string_agg', '')::BLOB) AS d FROM {_FILES_SQL})")
def gguf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark).select("id", logs.header_strings("tokenizer.chat_template")(F.unbase64("data")).alias("template"))


# -- listings ----------------------------------------------------------------------------------------------

_CARDS_SQL, _cards = _rows([("llama3 chat", "12,345", "/library/llama3"), ("qwen coder", "x", "https://h/q"), ("nomic embed", None, "library/nomic"), ("Llama guard", "7", "")], "name, tags, href", "string, string, string")


@R.add("search_filter_limit", f"SELECT q, name FROM (SELECT q, name, row_number() OVER (PARTITION BY q ORDER BY name) AS k FROM {_CARDS_SQL}, (VALUES ('llama'), ('LLAMA chat'), (' '), ('zzz'), ('e')) v(q) WHERE trim(q) <> '' AND list_bool_and([contains(lower(name), t) FOR t IN string_split(lower(trim(q)), ' ')])) WHERE k <= 2")
def search_filter_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.sources.listings import searched

    parts = [searched(_cards(spark), q, 2).select(F.lit(q).alias("q"), "name") for q in ("llama", "LLAMA chat", " ", "zzz", "e")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.add("tag_count", f"SELECT name, try_cast(regexp_extract(replace(tags, ',', ''), '^\\s*([+-]?[0-9]+)', 1) AS INTEGER) AS tags FROM {_CARDS_SQL}")
def tag_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.sources.listings import count_of

    return _cards(spark).select("name", count_of(F.col("tags")).alias("tags"))


@R.add("absolute_url", f"SELECT name, CASE WHEN href = '' THEN 'https://site/library' WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:') THEN href ELSE 'https://site/' || regexp_replace(href, '^/+', '') END AS url FROM {_CARDS_SQL}")
def absolute_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.sources.listings import absolute

    return _cards(spark).select("name", absolute(F.col("href"), "https://site").alias("url"))
