"""Queries over a catalog derived from ``documents``: collection = source, folder = source and language.

Small catalog tables join by broadcast where Spark's statistics say so; chunks are the large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions.chat import source_key
from folioflow.operators import catalog, embedding, retrieval
from folioflow.plans.registry import Registry
from folioflow.plans.text_queries import KEPT, compact_sql, documents, kept_chunks, normalize_sql

R = Registry()

_VIEWS = """
d0 AS (SELECT doc_id, text, source, lang, CAST(replace(source, 'src', '') AS BIGINT) + 1 AS collection_id, '/lib/' || source || '/' || lang AS folder_path FROM documents),
folders AS (SELECT folder_path AS path, min(doc_id) AS folder_id, min(collection_id) AS collection_id FROM d0 GROUP BY folder_path),
items AS (SELECT collection_id, folder_id FROM folders),
docs AS (SELECT d0.doc_id AS document_id, folder_id, folder_path || '/' || d0.doc_id || '.txt' AS document_path FROM d0 JOIN folders ON path = folder_path),
collections AS (SELECT DISTINCT collection_id, source AS name, CASE WHEN collection_id % 5 = 0 THEN '' ELSE 'm' || collection_id % 2 END AS embedding_model FROM d0),
state AS (SELECT collection_id, CASE WHEN collection_id % 4 = 3 THEN 'needsReview' ELSE 'ready' END AS status, CASE WHEN collection_id % 7 = 0 THEN NULL ELSE collection_id % 3 <> 0 END AS is_active, '/lib/' || name AS import_path, collection_id * 10 AS file_count FROM collections)
"""
_CHUNK_VIEWS = f"""{KEPT}, {_VIEWS},
chunks AS (SELECT doc_id * 1000 + chunk_index AS chunk_id, doc_id AS document_id, chunk_index AS page, chunk_text, words FROM kept),
thumbs AS (SELECT document_id, page, '/thumbs/' || document_id || '.png' AS thumbnail_path FROM chunks WHERE document_id % 5 = 0 AND page = 1),
vectors AS (SELECT 'm' || document_id % 2 AS model, folder_id, chunk_id FROM chunks JOIN docs USING (document_id) WHERE document_id % 3 <> 0)
"""


def views(spark: SparkSession, sf_dir: str, with_chunks: bool = False) -> dict[str, DataFrame]:
    number = F.replace("source", F.lit("src"), F.lit("")).cast("long") + 1
    d0 = documents(spark, sf_dir).select("doc_id", "source", number.alias("collection_id"), F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang").alias("path"))
    folders = d0.groupBy("path").agg(F.min("doc_id").alias("folder_id"), F.min("collection_id").alias("collection_id"))
    docs = d0.select("doc_id", "path").join(folders.select("path", "folder_id"), "path").select(F.col("doc_id").alias("document_id"), "folder_id", F.concat("path", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("document_path"))
    collections = d0.select("collection_id", F.col("source").alias("name")).distinct().withColumn("embedding_model", F.when(F.col("collection_id") % 5 == 0, "").otherwise(F.concat(F.lit("m"), (F.col("collection_id") % 2).cast("string"))))
    state = collections.select(
        "collection_id",
        F.when(F.col("collection_id") % 4 == 3, "needsReview").otherwise("ready").alias("status"),
        F.when(F.col("collection_id") % 7 != 0, F.col("collection_id") % 3 != 0).alias("is_active"),
        F.concat(F.lit("/lib/"), "name").alias("import_path"),
        (F.col("collection_id") * 10).alias("file_count"),
    )
    out = {"folders": folders.select("folder_id", "path"), "items": folders.select("collection_id", "folder_id"), "documents": docs, "collections": collections, "state": state}
    if with_chunks:
        chunks = kept_chunks(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("chunk_index").alias("page"), "chunk_text", "words")
        out["chunks"] = chunks
        out["thumbnails"] = chunks.where((F.col("document_id") % 5 == 0) & (F.col("page") == 1)).select("document_id", "page", F.concat(F.lit("/thumbs/"), F.col("document_id").cast("string"), F.lit(".png")).alias("thumbnail_path"))
        out["embeddings"] = chunks.where(F.col("document_id") % 3 != 0).join(docs, "document_id").select(F.concat(F.lit("m"), (F.col("document_id") % 2).cast("string")).alias("model"), "folder_id", "chunk_id")
    return out


_ROWS = f"""WITH {_CHUNK_VIEWS}, rows AS (SELECT chunk_id, chunks.document_id, chunks.page, chunk_text, words, folder_id, document_path, folders.path AS folder_path, items.collection_id, name, status, is_active, thumbnail_path
FROM chunks JOIN docs USING (document_id) JOIN folders USING (folder_id) JOIN items USING (folder_id) JOIN collections ON collections.collection_id = items.collection_id
JOIN state ON state.collection_id = items.collection_id LEFT JOIN thumbs ON thumbs.document_id = chunks.document_id AND thumbs.page = chunks.page)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, with_chunks=True)
    return retrieval.source_rows(v["chunks"], v["documents"], v["folders"].withColumnRenamed("path", "folder_path"), v["items"], v["collections"], v["state"], v["thumbnails"])


@R.add("source_rows", f"{_ROWS} SELECT chunk_id, document_id, page, document_path, folder_path, collection_id, name, status, thumbnail_path FROM rows")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("chunk_id", "document_id", "page", "document_path", "folder_path", "collection_id", "name", "status", "thumbnail_path")


@R.add("rank_then_fetch", f"{_ROWS}, ranked AS (SELECT chunk_id, row_number() OVER (ORDER BY words DESC, chunk_id) AS rank FROM chunks QUALIFY rank <= 20) SELECT CAST(rank AS INTEGER) AS rank, chunk_id, document_path, name FROM ranked JOIN rows USING (chunk_id) WHERE status = 'ready'")
def rank_then_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    top = rows.orderBy(F.desc("words"), "chunk_id").limit(20).select("chunk_id", "words")
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("words"), "chunk_id"))).select("chunk_id", "rank")  # 20 rows
    return retrieval.rank_then_fetch(ranked, rows.where("status = 'ready'")).select("rank", "chunk_id", "document_path", "name")


_TITLE = "CASE WHEN name = document_path THEN name ELSE name || ' / ' || document_path END"


@R.add("source_projection", f"{_ROWS} SELECT chunk_id, {_TITLE} AS title, CASE WHEN page > 0 THEN 'Page ' || page ELSE 'Chunk 1' END AS locator, md5({normalize_sql('chunk_text')}) AS context, document_id, name AS collection_name, document_path AS path FROM rows")
def source_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("chunk_id", "chunk_text", "document_id", F.col("name").alias("collection_name"), F.col("document_path").alias("path"), F.col("document_path").alias("document_title"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.lit(1).alias("chunk_index"), F.lit(0.0).alias("score"))
    out = retrieval.project_source(rows, F.array(F.lit("the")))
    return out.select("chunk_id", "title", "locator", F.md5(F.col("context").cast("binary")).alias("context"), "document_id", "collection_name", "path")


@R.add("public_sources", f"{_ROWS} SELECT chunk_id, {_TITLE} AS title FROM rows")
def public_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("chunk_id", T.source_title(F.col("name"), F.col("document_path")).alias("title"), F.col("chunk_text").alias("context")).drop("context")


@R.add("source_key", f"{_ROWS} SELECT chunk_id, md5(concat_ws('|', collection_id, document_id, chunk_id, document_path, page, '', substr(chunk_text, 1, 120))) AS key FROM rows")
def source_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c) for c in ("collection_id", "document_id", "chunk_id", "document_path", "page")]
    return _rows(spark, sf_dir).select("chunk_id", F.md5(source_key(*parts, F.lit(None), F.substring("chunk_text", 1, 120)).cast("binary")).alias("key"))


@R.add(
    "excerpt",
    rf"""WITH {KEPT}, c AS (SELECT doc_id * 1000 + chunk_index AS chunk_id, chunk_text AS t, lower(chunk_text) AS low FROM kept),
    hits AS (SELECT chunk_id, unnest(list_filter(range(len(low)), lambda k: substr(low, CAST(k AS BIGINT) + 1, 4) = 'ment' OR substr(low, CAST(k AS BIGINT) + 1, 3) = 'ing')) AS h FROM c),
    scored AS (SELECT a.chunk_id, a.h, count(*) AS n FROM hits a JOIN hits b ON a.chunk_id = b.chunk_id AND abs(a.h - b.h) <= 260 GROUP BY ALL),
    best AS (SELECT chunk_id, h FROM scored QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, h) = 1),
    w AS (SELECT chunk_id, t, greatest(0, coalesce(h, 0) - 420) AS s, least(len(t), coalesce(h, 0) + 420) AS e FROM c LEFT JOIN best USING (chunk_id))
    SELECT chunk_id, CASE WHEN s > 0 THEN '...' ELSE '' END || {compact_sql('substr(t, s + 1, e - s)')} || CASE WHEN e < len(t) THEN '...' ELSE '' END AS excerpt FROM w""",
)
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_chunks(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_id"), T.excerpt("chunk_text", F.array(F.lit("ment"), F.lit("ing"))).alias("excerpt"))


@R.add("has_chunks", f"WITH {_CHUNK_VIEWS} SELECT EXISTS (SELECT 1 FROM chunks JOIN docs USING (document_id) JOIN items USING (folder_id) WHERE collection_id IN (1, 2)) AS has_chunks")
def has_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, with_chunks=True)
    found = v["chunks"].join(v["documents"], "document_id").join(v["items"].where(F.col("collection_id").isin(1, 2)), "folder_id", "left_semi").limit(1)
    return found.agg((F.count("*") > 0).alias("has_chunks"))


@R.add("embedded_signatures", f"WITH {_CHUNK_VIEWS} SELECT DISTINCT document_path, md5(chunk_text) AS chunk, page FROM chunks JOIN docs USING (document_id) JOIN items USING (folder_id) JOIN vectors ON vectors.chunk_id = chunks.chunk_id AND vectors.folder_id = docs.folder_id AND model = 'm1' WHERE collection_id IN (1, 2, 3)")
def embedded_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, with_chunks=True)
    own = v["items"].where(F.col("collection_id").isin(1, 2, 3)).select("folder_id").distinct()
    rows = v["chunks"].join(v["documents"].join(own, "folder_id", "left_semi"), "document_id").join(v["embeddings"].where("model = 'm1'").select("chunk_id", "folder_id"), ["chunk_id", "folder_id"])
    return rows.select("document_path", F.md5(F.col("chunk_text").cast("binary")).alias("chunk"), "page").distinct()


@R.add("incremental_anti", f"WITH {_CHUNK_VIEWS} SELECT chunk_id FROM chunks WHERE NOT EXISTS (SELECT 1 FROM vectors v JOIN chunks c USING (chunk_id) WHERE c.document_id = chunks.document_id AND c.page IS NOT DISTINCT FROM chunks.page AND c.chunk_text = chunks.chunk_text)")
def incremental_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, with_chunks=True)
    done = v["chunks"].join(v["embeddings"], "chunk_id").select("document_id", "page", "chunk_text")
    return embedding.missing(v["chunks"], done, ["document_id", "page", "chunk_text"]).select("chunk_id")


@R.add("find_existing_chunk", f"WITH {_CHUNK_VIEWS}, asked AS (SELECT document_id, CASE WHEN page = 2 THEN NULL ELSE page END AS page, chunk_text FROM chunks) SELECT c.chunk_id FROM asked a JOIN chunks c ON c.document_id = a.document_id AND c.chunk_text = a.chunk_text AND coalesce(c.page, -1) = coalesce(a.page, -1)")
def find_existing_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = views(spark, sf_dir, with_chunks=True)["chunks"]
    asked = chunks.select("document_id", F.when(F.col("page") != 2, F.col("page")).alias("page"), "chunk_text")
    return catalog.existing_chunks(asked, chunks, ["document_id", "chunk_text", "page"]).select("chunk_id")


@R.add("starter_document_exists", f"WITH {_CHUNK_VIEWS} SELECT document_id FROM docs WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = docs.document_id)")
def starter_document_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, with_chunks=True)
    return v["documents"].join(v["chunks"], "document_id", "left_semi").select("document_id")


@R.add("starter_sources", f"WITH {_CHUNK_VIEWS}, own AS (SELECT docs.* FROM docs JOIN items USING (folder_id) WHERE collection_id = 2), first AS (SELECT document_id FROM own WHERE document_id IN (SELECT document_id FROM chunks) ORDER BY lower(document_path), document_id LIMIT 1) SELECT chunk_id, page FROM (SELECT chunk_id, page FROM chunks JOIN first USING (document_id) ORDER BY md5('0:' || chunk_id) LIMIT 4)")
def starter_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, with_chunks=True)
    own = v["documents"].join(v["items"].where("collection_id = 2"), "folder_id").withColumnRenamed("document_path", "path")
    return retrieval.starter_sources(own, v["chunks"], 4).select("chunk_id", "page")


@R.add("resolve_source", f"{_ROWS} SELECT chunk_id, document_id, document_path, name FROM rows WHERE chunk_id = 8001 OR (document_id = 4 AND page = 1) OR document_path = '/none' ORDER BY CASE WHEN chunk_id = 8001 THEN 0 ELSE 1 END, chunk_id LIMIT 1")
def resolve_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.col("chunk_id") == 8001) | ((F.col("document_id") == 4) & (F.col("page") == 1)) | (F.col("document_path") == "/none")
    return _rows(spark, sf_dir).where(hit).orderBy(F.when(F.col("chunk_id") == 8001, 0).otherwise(1), "chunk_id").limit(1).select("chunk_id", "document_id", "document_path", "name")


@R.add("collections_for_import_path", f"WITH {_VIEWS} SELECT DISTINCT c.collection_id FROM collections c LEFT JOIN state s USING (collection_id) LEFT JOIN items i USING (collection_id) LEFT JOIN folders f ON f.folder_id = i.folder_id LEFT JOIN docs d ON d.folder_id = f.folder_id WHERE s.import_path IN ('/lib/src3') OR f.path IN ('/lib/src5/en') OR d.document_path IN (SELECT document_path FROM docs WHERE document_id = 7)")
def collections_for_import_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    path = v["documents"].where("document_id = 7").select("document_path")
    return catalog.collections_for_paths(v["collections"], v["state"], v["items"], v["folders"], v["documents"], spark.createDataFrame([("/lib/src3",), ("/lib/src5/en",)], "path string").unionByName(path.withColumnRenamed("document_path", "path")))


@R.add("material_id_by_path", f"WITH {_VIEWS} SELECT min(collection_id) AS collection_id FROM state WHERE import_path = '/lib/src3'")
def material_id_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    found = catalog.collections_for_paths(v["collections"], v["state"], v["items"], v["folders"], v["documents"], spark.createDataFrame([("/lib/src3",)], "path string"))
    return found.agg(F.min("collection_id").alias("collection_id"))


@R.add("embedding_models_for_collections", f"WITH {_CHUNK_VIEWS} SELECT DISTINCT model FROM vectors JOIN folders USING (folder_id) JOIN items USING (folder_id) WHERE items.collection_id IN (1, 2)")
def embedding_models_for_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, with_chunks=True)
    return v["embeddings"].join(v["items"].where(F.col("collection_id").isin(1, 2)), "folder_id", "left_semi").select("model").distinct()


@R.add("embedding_models_by_collection", f"WITH {_VIEWS} SELECT collection_id, embedding_model FROM collections WHERE embedding_model <> '' AND collection_id IN (1, 2, 4, 5)")
def embedding_models_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("1",), ("2",), ("material-x",), ("4",), ("5",)], "id string")
    return catalog.models_by_collection(asked, views(spark, sf_dir)["collections"])


@R.add("active_materials", f"WITH {_VIEWS} SELECT collection_id FROM state WHERE status = 'ready' AND is_active IS DISTINCT FROM false")
def active_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.active(views(spark, sf_dir)["state"]).select("collection_id")


@R.add("enabled_ids", f"WITH {_VIEWS} SELECT collection_id, CAST(pos AS INTEGER) AS pos FROM (VALUES (8, 0), (2, 1), (1, 3)) a(collection_id, pos) JOIN state USING (collection_id) WHERE status = 'ready' AND is_active")
def enabled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.enabled(spark.createDataFrame([(8, 0), (2, 1), (8, 2), (1, 3), (3, 4)], "collection_id long, pos int"), views(spark, sf_dir)["state"])


@R.add("orphan_folders", f"WITH {_VIEWS} SELECT folder_id FROM folders WHERE folder_id NOT IN (SELECT folder_id FROM items WHERE collection_id NOT IN (1, 2))")
def orphan_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return v["folders"].join(v["items"].where(~F.col("collection_id").isin(1, 2)), "folder_id", "left_anti").select("folder_id")


@R.add("list_materials", f"WITH {_VIEWS} SELECT c.collection_id, name, status, min(f.path) AS folder_path FROM collections c LEFT JOIN state USING (collection_id) LEFT JOIN items i ON i.collection_id = c.collection_id LEFT JOIN folders f ON f.folder_id = i.folder_id GROUP BY ALL")
def list_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    return catalog.list_materials(v["collections"], v["state"], v["items"], v["folders"]).select("collection_id", "name", "status", "folder_path")


@R.add("summarize_material", f"WITH {_CHUNK_VIEWS}, w AS (SELECT folder_id, document_id, sum(words) AS words, count(chunk_id) AS chunks FROM docs LEFT JOIN chunks USING (document_id) GROUP BY ALL) SELECT collection_id, count(*) AS file_count, CAST(coalesce(sum(words), 0) AS BIGINT) AS word_count, CAST(sum(chunks) AS BIGINT) AS chunk_count, count(*) FILTER (chunks > 0) AS ready_count, CASE WHEN count(*) FILTER (chunks > 0) > 0 THEN 'ready' ELSE 'needsReview' END AS status FROM w JOIN items USING (folder_id) GROUP BY collection_id")
def summarize_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, with_chunks=True)
    per = v["chunks"].groupBy("document_id").agg(F.sum("words").alias("words"), F.count("*").alias("chunks"))
    return catalog.summarize(v["documents"].join(per, "document_id", "left").join(v["items"], "folder_id"))


@R.add("dump_index", f"{_ROWS} SELECT chunk_id, name, model, md5(chunk_text) AS chunk FROM rows LEFT JOIN vectors USING (chunk_id)")
def dump_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, with_chunks=True)
    return _rows(spark, sf_dir).join(v["embeddings"].select("chunk_id", "model"), "chunk_id", "left").orderBy("chunk_id").select("chunk_id", "name", "model", F.md5(F.col("chunk_text").cast("binary")).alias("chunk"))


@R.add("materials_display", f"WITH {_VIEWS} SELECT collection_id, file_count || ' files - 1,234 words - 0 chunks' AS detail FROM state")
def materials_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir)["state"].select("collection_id", catalog.detail(F.col("file_count"), F.lit(1234), F.lit(0)).alias("detail"))


@R.add("pdf_thumbnails", f"WITH {_VIEWS} SELECT document_id, substr(sha256(document_path), 1, 20) || '/page-0003.png' AS path FROM docs")
def pdf_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir)["documents"].select("document_id", catalog.thumbnail_path(F.col("document_path"), F.lit(3)).alias("path"))
