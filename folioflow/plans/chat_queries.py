"""Queries of vectors, conversations, events, and functions on inline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import chat, study
from folioflow.functions import settings as S
from folioflow.functions import text as T
from folioflow.operators import chunking, conversation, embedding, retrieval
from folioflow.plans.registry import Registry, table, values_sql
from folioflow.plans.text_queries import compact_sql, strip_sql
from folioflow.streaming import progress

R = Registry()

# -- vectors ----------------------------------------------------------------------------------


def positive_zero(x):
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, q): the mean vector of each label, as a request's few queries; all vectors make them."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    means = parts.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("m"))
    return means.select(F.col("label").cast("long").alias("query_id"), F.transform("m", lambda p: p["x"]).alias("q"))


_SCORES = "scores AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings v, embeddings q)"
_CENTRES = "parts AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), centres AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY k) AS q FROM (SELECT label, k, avg(x) AS x FROM parts GROUP BY ALL) GROUP BY label), near AS (SELECT query_id, vec_id, list_inner_product(q, embedding::DOUBLE[]) AS s FROM embeddings, centres)"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)"


@R.add("vector_topk_exact", f"WITH {_SCORES} SELECT query_id, vec_id, round(s, 4) AS score, CAST({_RANK} AS INTEGER) AS rank FROM scores WHERE label < 5 QUALIFY rank <= 4")
def vector_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    found = retrieval.all_top_k(v.where("label < 5"), v, 4)
    return found.select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@R.add("vector_topk_ref", f"WITH {_SCORES}, wide AS (SELECT * FROM scores QUALIFY {_RANK} <= 32) SELECT query_id, vec_id, round(s, 4) AS score, CAST({_RANK} AS INTEGER) AS rank FROM wide WHERE label < 5 QUALIFY rank <= 4")
def vector_topk_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    wide = retrieval.all_top_k(v, v, 4 * retrieval.OVER_FETCH).drop("rank")
    found = retrieval.top_k(wide.join(v.where("label < 5").select("vec_id"), "vec_id", "left_semi"), 4)
    return found.select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@R.add("query_x_chunks", f"WITH {_CENTRES} SELECT query_id, vec_id, CASE WHEN round(s, 4) = 0 THEN 0.0 ELSE round(s, 4) END AS score FROM near")
def query_x_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v.crossJoin(F.broadcast(centroids(spark, sf_dir))).select(  # a request's few queries
        "query_id", "vec_id", positive_zero(F.round(embedding.dot("q", "embedding"), 4)).alias("score")
    )


@R.add("inner_product", "SELECT vec_id, round(list_inner_product(list_reverse(embedding::DOUBLE[]), embedding::DOUBLE[]), 4) AS dot FROM embeddings")
def inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(embedding.dot(F.reverse("embedding"), "embedding"), 4).alias("dot"))


def _norm_sql(x: str) -> str:
    return f"sqrt(list_inner_product({x}::DOUBLE[], {x}::DOUBLE[]))"


_SCALED = "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: 0.0::DOUBLE) ELSE list_transform(embedding::DOUBLE[], lambda x: x * (vec_id + 1)) END AS v FROM embeddings"


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(F.col("vec_id") + 1.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * by).alias("v"))


_LENGTHS = f"SELECT vec_id, CASE WHEN {_norm_sql('v')} = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS norm, CASE WHEN {_norm_sql('v')} = 0 THEN 0.0 ELSE round(v[1] / {_norm_sql('v')}, 4) END AS first FROM ({_SCALED})"


@R.add("l2_normalize_engine", _LENGTHS)
def l2_normalize_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir).select("vec_id", embedding.normalize("v").alias("u")).select("vec_id", F.round(embedding.norm("u"), 4).alias("norm"), F.round(F.col("u")[0], 4).alias("first"))


@R.add("l2_normalize_matrix", _LENGTHS)
def l2_normalize_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir).select("vec_id", embedding.normalize_rows("v").alias("u")).select("vec_id", F.round(embedding.norm("u"), 4).alias("norm"), F.round(F.col("u")[0], 4).alias("first"))


_HITS = f"{_CENTRES}, hits AS (SELECT vec_id, 'm' || query_id AS model, query_id AS model_pos, CASE WHEN round(s, 4) = 0 THEN 0.0 ELSE round(s, 4) END AS score FROM near)"
_BEST = "best AS (SELECT vec_id, score, model FROM hits QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, model_pos) = 1)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query_x_chunks(spark, sf_dir)
    return rows.select("vec_id", F.concat(F.lit("m"), F.col("query_id").cast("string")).alias("model"), F.col("query_id").alias("model_pos"), "score")


@R.add("max_score_per_row", f"WITH {_HITS}, {_BEST} SELECT * FROM best")
def max_score_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.best_per_row(_hits(spark, sf_dir))


@R.add("union_models", f"WITH {_HITS} SELECT vec_id, max(score) AS score FROM hits GROUP BY vec_id")
def union_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir)
    return h.where("model = 'm0'").unionByName(h.where("model != 'm0'")).groupBy("vec_id").agg(F.max("score").alias("score"))


@R.add("search_rank", f"WITH {_HITS}, {_BEST} SELECT vec_id, score, model, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM best QUALIFY rank <= 4")
def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_rank(_hits(spark, sf_dir), 0)


# -- conversations -----------------------------------------------------------------------------

_TURNS = """
m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations),
pairs AS (SELECT conv_id, seg, arg_max(CASE WHEN role = 'user' THEN text END, turn) FILTER (role = 'user') AS question, arg_max(text, turn) FILTER (role = 'assistant') AS answer FROM m WHERE seg > 0 GROUP BY ALL HAVING count(*) FILTER (role = 'assistant') > 0),
recent AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seg DESC) AS back FROM pairs QUALIFY back <= 2)"""


@R.add("completed_turns", f"WITH {_TURNS} SELECT conv_id, CAST(back AS INTEGER) AS back, question, answer FROM recent")
def completed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.completed_turns(table(spark, sf_dir, "conversations"), 2).select("conv_id", "back", "question", "answer")


@R.add("recent_messages", f"SELECT conv_id, turn, role, {strip_sql('text')} AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 12 AND {strip_sql('text')} <> ''")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.recent_messages(table(spark, sf_dir, "conversations"))


@R.add("chat_messages", f"WITH r AS (SELECT conv_id, turn, role, {strip_sql('text')} AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 12 AND {strip_sql('text')} <> '') SELECT conv_id, CAST(count(*) + 2 AS INTEGER) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS body FROM r GROUP BY conv_id")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation.chat_messages(table(spark, sf_dir, "conversations"), "You answer from notes.", "What next?", "")
    inner = F.expr("slice(messages, 2, size(messages) - 2)")
    return found.select("conv_id", F.size("messages").alias("n"), F.md5(F.array_join(F.transform(inner, lambda m: F.concat_ws(":", m["role"], m["content"])), "|").cast("binary")).alias("body"))


@R.add("conversation_title", f"SELECT conv_id, turn, CASE WHEN len({compact_sql('text')}) > 28 THEN {strip_sql('substr(' + compact_sql('text') + ', 1, 28)')} || '...' WHEN {compact_sql('text')} = '' THEN 'New Study Chat' ELSE {compact_sql('text')} END AS title FROM conversations")
def conversation_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.conversation_title("text").alias("title"))


@R.add("retrieval_query", f"WITH {_TURNS} SELECT conv_id, 'Previous question: ' || {compact_sql('question')} || chr(10) || 'Previous answer: ' || CASE WHEN len({compact_sql('answer')}) > 900 THEN {strip_sql('substr(' + compact_sql('answer') + ', 1, 899)')} || '…' ELSE {compact_sql('answer')} END || chr(10) || 'Follow-up: explain that' AS query FROM recent WHERE back = 1")
def retrieval_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation.completed_turns(table(spark, sf_dir, "conversations"), 1)
    return turns.select("conv_id", chat.retrieval_query(F.lit(" explain  that"), F.col("question"), F.col("answer")).alias("query"))


@R.add("dedup_first", "SELECT text, min(conv_id * 1000 + turn) AS pos FROM conversations GROUP BY text")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("text", (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return rows.groupBy("text").agg(F.min("pos").alias("pos"))


@R.add("merge_sources", "WITH b AS (SELECT doc_id AS pos, source AS source_key, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS part FROM documents), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY part, pos) = 1) SELECT pos, source_key FROM f ORDER BY part, pos LIMIT 12")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("source_key"), "lang")
    return retrieval.merge_sources(d.where(english), d.where(~english), 12).select("pos", "source_key")


@R.add("select_quiz_sources", "SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2') ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT 4")
def select_quiz_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", F.col("source").alias("key"))
    used = spark.createDataFrame([("src1",), ("src2",)], "key string")
    return conversation.pick_unused(pool, used, "key", "doc_id").select("doc_id")


# -- events --------------------------------------------------------------------------------------


@R.add("log_sink", "SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup') OR regexp_matches(event_type, '(?i)error|failed|failure|timeout|stderr|force_kill')")
def log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.worth_logging(table(spark, sf_dir, "events"), ["purchase", "signup"]).select("event_id", "event_type")


@R.add("request_sequence", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def request_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.latest_only(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


@R.add("pull_progress", "WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT user_id, round(sum(v), 4) AS completed, CAST(count(*) * 100 AS DOUBLE) AS total, CAST(floor(100 * sum(v) / (count(*) * 100) + 0.5) AS BIGINT) AS percent FROM l GROUP BY user_id")
def pull_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null").select(F.col("user_id").alias("model"), F.col("event_type").alias("digest"), F.col("event_id").alias("seq"), F.col("value").alias("completed"), F.lit(100.0).alias("total"))
    return progress.pull_progress(e).select(F.col("model").alias("user_id"), F.round("completed", 4).alias("completed"), "total", "percent")


@R.add("index_progress", "SELECT doc_id, CAST(1 + round_even((doc_id - 1) / n * 29, 0) AS INTEGER) AS parsing, CAST(least(90, 45 + round_even(doc_id / n * 45, 0)) AS INTEGER) AS embedding FROM documents, (SELECT count(*) AS n FROM documents)")
def index_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    d, n = F.col("doc_id"), F.lit(rows.count())
    return rows.select("doc_id", chunking.index_percent(F.lit("parsing"), d, n).alias("parsing"), chunking.index_percent(F.lit("embedding"), d, n).alias("embedding"))


# -- functions on inline rows ---------------------------------------------------------------------


_PROMPTS = [(1, "Why?"), (2, "explain that"), (3, "What about RAID 5?"), (4, "Describe the history of storage systems in detail"), (5, "is this the same"), (6, "  More   details!! "), (7, ""), (8, "be more specific.")]
_FOLLOW = " OR ".join(f"regexp_matches(p, '{x}')" for x in chat.FOLLOW_UPS)


@R.add("is_followup", f"SELECT id, p <> '' AND ({_FOLLOW} OR (len(regexp_split_to_array(p, '\\s+')) <= 6 AND regexp_matches(p, '{chat.POINTERS}'))) AS flag FROM (SELECT id, regexp_replace(lower({compact_sql('t')}), '[?.!]+$', '') AS p FROM {values_sql(_PROMPTS)} v(id, t))")
def is_followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_PROMPTS, "id int, t string").select("id", chat.is_follow_up("t").alias("flag"))


_ANSWERS = [(1, "According to source 2, discks spin. They do (source 1)."), (2, "The excerpt 3 states that reads are fast."), (3, "Plain answer."), (4, "Based on the context, it is so. Do not mention excerpt labels here. Fine."), (5, "As noted in passage 9, yes.")]


def _strip_sql(x: str) -> str:
    for k, p in enumerate(chat.CITATIONS):
        first = ", 'g'" if k in (4, 5, 6, 7) else ""
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', ''{first})"
    return strip_sql(rf"regexp_replace({x}, '\s{{2,}}', ' ', 'g')")


@R.add("strip_citations", f"SELECT id, {_strip_sql('t')} AS text FROM {values_sql(_ANSWERS)} v(id, t)")
def strip_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_ANSWERS, "id int, t string").select("id", chat.strip_citations("t").alias("text"))


@R.add("cited_source_index", "SELECT * FROM (VALUES (1, 2), (2, 3), (3, NULL), (4, NULL), (5, NULL)) v(id, number)")
def cited_source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_ANSWERS, "id int, t string").select("id", chat.cited_number("t", F.lit(3)).alias("number"))


@R.add("reorder_sources", "SELECT * FROM (VALUES (1, 'b,a,c'), (2, 'c,a,b'), (3, 'a,b,c'), (4, 'a,b,c'), (5, 'a,b,c')) v(id, sources)")
def reorder_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_ANSWERS, "id int, t string").withColumn("s", F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return rows.select("id", F.array_join(chat.move_to_front(F.col("s"), chat.cited_number("t", F.lit(3))), ",").alias("sources"))


_BYTES = [(0,), (500,), (1536,), (2560,), (1048576,), (5347738,), (3221225472,)]


@R.add("format_bytes", f"SELECT n, CASE WHEN n < 1048576 THEN CAST(greatest(1, round_even(n / 1024, 0)) AS BIGINT) || ' KB' WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.2f GB', n / 1073741824) END AS text FROM {values_sql(_BYTES)} v(n)")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_BYTES, "n long").select("n", T.format_bytes("n").alias("text"))


_COUNTS = [("off", "3"), ("on", "1"), ("on", "2"), ("on", "3"), ("on", "9"), ("on", None)]


@R.add("followup_count", f"SELECT mode, n, CASE WHEN mode = 'off' THEN 0 WHEN n IS NULL THEN 4 WHEN CAST(n AS DOUBLE) <= 2 THEN 2 ELSE 4 END AS count FROM {values_sql(_COUNTS)} v(mode, n)")
def followup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_COUNTS, "mode string, n string").select("mode", "n", chat.follow_up_count(F.col("mode"), F.col("n")).alias("count"))


_SETTINGS = [(1, "0.5"), (2, "-4"), (3, "99999"), (4, "x"), (5, None), (6, "NaN"), (7, "7.5")]


@R.add("settings_clamp", f"SELECT id, CAST(CASE WHEN try_cast(t AS DOUBLE) IS NULL OR isnan(try_cast(t AS DOUBLE)) THEN 4 ELSE greatest(1, least(64, floor(try_cast(t AS DOUBLE) + 0.5))) END AS DOUBLE) AS threads, CAST(CASE WHEN try_cast(t AS DOUBLE) IS NULL OR isnan(try_cast(t AS DOUBLE)) THEN 0.7 ELSE greatest(0, least(2, try_cast(t AS DOUBLE))) END AS DOUBLE) AS temperature FROM {values_sql(_SETTINGS)} v(id, t)")
def settings_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_SETTINGS, "id int, t string").select("id", S.clamp("t", "cpuThreads").alias("threads"), S.clamp("t", "temperature").alias("temperature"))


@R.add("settings_merge", "SELECT * FROM (VALUES (1, 5.0::DOUBLE), (2, 3.0::DOUBLE), (3, 1.0::DOUBLE)) v(id, value)")
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 5.0, 3.0, 1.0), (2, None, 3.0, 1.0), (3, None, None, 1.0)], "id int, request double, model double, base double")
    return rows.select("id", F.coalesce("request", "model", "base").alias("value"))


_MODELS = [("gpt-4.1",), ("gpt-4",), ("gpt-3.5-turbo",), ("o1",), ("gpt-4.10",)]


@R.add("sort_model_ids", "SELECT * FROM (VALUES ('gpt-4.10', 1), ('gpt-4.1', 2), ('gpt-4', 3), ('gpt-3.5-turbo', 4), ('o1', 5)) v(id, pos)")
def sort_model_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sorted_models(spark.createDataFrame(_MODELS, "id string"), "gpt-")


@R.add("quiz_focus_cycle", "SELECT n, [" + ", ".join(f"'{a}'" for a in study.QUIZ_AREAS) + "][greatest(n - 1, 0) % 5 + 1] AS area FROM (VALUES (0), (1), (5), (6), (13)) v(n)")
def quiz_focus_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(0,), (1,), (5,), (6,), (13,)], "n int").select("n", study.quiz_area(F.col("n")).alias("area"))


_LISTS = [(1, '["What is RAID?", "Why?", "no"]'), (2, "1. What is a disk?\n2) How fast?\n- What is a disk?"), (3, "Here are some:\n* Is it so?"), (4, "none")]


@R.add("parse_followups_ts", "SELECT * FROM (VALUES (1, 'What is RAID?|Why?'), (2, 'What is a disk?|How fast?'), (3, 'Is it so?'), (4, '')) v(id, questions)")
def parse_followups_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_LISTS, "id int, t string").select("id", F.array_join(chat.question_list("t"), "|").alias("questions"))


_PATHS = [("/a/b", "/a/b"), ("/a/b", "/a/b/c.pdf"), ("/a/b", "/a/bc"), ("/a/b", "/a")]


@R.add("path_containment", f"SELECT parent, child, child = parent OR starts_with(child, parent || '/') AS inside FROM {values_sql(_PATHS)} v(parent, child)")
def path_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_PATHS, "parent string, child string").select("parent", "child", S.inside(F.col("parent"), F.col("child")).alias("inside"))


_HEADERS = [(1, "Chapter 3: Disks"), (2, "12.1 Magnetic Disks"), (3, "chapter one"), (4, "- 1.2 item"), (5, "Section 4")]


@R.add("section_header", rf"SELECT id, CASE WHEN NOT regexp_matches(t, '^\s*(?:[-*•▪]|\d+[.)])\s+') AND (regexp_matches(t, '(?i)^(?:chapter|section)\s+\d+\b(?:\s*[:.-]\s*\S.*)?$') OR regexp_matches(t, '^\d+(?:\.\d+)+\s+\S.{{0,100}}$')) THEN t END AS header FROM {values_sql(_HEADERS)} v(id, t)")
def section_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_HEADERS, "id int, t string").select("id", T.section_header("t", chapter=True).alias("header"))


@R.add("material_kind", "SELECT * FROM (VALUES ('/a/b.PDF', 'pdf'), ('/a/c.md', 'document'), ('/a/d', 'folder')) v(path, kind)")
def material_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("/a/b.PDF", False), ("/a/c.md", False), ("/a/d", True)], "path string, is_folder boolean")
    return rows.select("path", S.material_kind(F.col("path"), F.col("is_folder")).alias("kind"))


@R.add("model_keys", "SELECT substr(sha256('http://x/v1' || chr(0) || 'm'), 1, 24) AS remote, substr(sha1('/models/a.gguf'), 1, 16) AS local")
def model_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(S.remote_key(F.lit("http://x/v1"), F.lit("m")).alias("remote"), S.local_key(F.lit("/models/a.gguf")).alias("local"))


@R.add("flagship")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.answer_sources(spark, sf_dir)
