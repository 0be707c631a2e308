"""The library's catalog: tables as immutable Parquet snapshots, mutations as joins, reads as DataFrames.

Parquet tables have no MERGE, so a mutation writes the tables that it changes as new folders and then adds a
numbered pointer file that names every table's folder; the highest one that is whole counts. Nothing is deleted or renamed for
that, so readers see the old version or the new one, never half of one or none. A pointer is created only if its
number is free: of two writers that began with one version the second fails and may start anew.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The tables and their columns.
SCHEMAS = {
    "collections": "collection_id long, name string, start_update_time long, last_update_time long, embedding_model string",
    "folders": "folder_id long, path string",
    "items": "collection_id long, folder_id long",
    "documents": "document_id long, folder_id long, document_time long, document_path string",
    "chunks": "chunk_id long, document_id long, chunk_text string, file string, title string, author string, subject string, keywords string, page int, line_from int, line_to int, words int, tokens int, chunk_size int, section_header string",
    "embeddings": "model string, folder_id long, chunk_id long, embedding array<float>",
    "thumbnails": "document_id long, page int, thumbnail_path string, updated_at string",
    "state": "collection_id long, status string, kind string, import_path string, embedding_model_id string, embedding_model_name string, cleaning_profile_id string, cleaning_profile_name string, cleaning_profile_version string, cleaning_rule_ids array<string>, detail string, added_at string, indexed_at string, is_active boolean, file_count long, size_bytes long, word_count long, page_count long, chunk_count long, chunk_size int, error string",
}
CHUNK_IDENTITY = ["document_id", "chunk_text", "page", "line_from", "line_to", "chunk_size"]


def path_candidates(path: str | None) -> list[str]:
    """A path as given and without a scheme or dots, each once."""
    import posixpath

    if not path:
        return []
    raw = path.replace("file://", "", 1)
    return list(dict.fromkeys(p for p in (raw, posixpath.normpath(raw)) if p))


def collections_for_paths(collections: DataFrame, state: DataFrame, items: DataFrame, folders: DataFrame, documents: DataFrame, paths: DataFrame) -> DataFrame:
    """Collections imported from one of the paths, or with a folder or document of that path: three semi joins, not a disjunction."""
    by_import = state.join(F.broadcast(paths), state["import_path"] == paths["path"], "left_semi").select("collection_id")
    by_folder = folders.join(F.broadcast(paths), "path", "left_semi").select("folder_id")
    by_document = documents.join(F.broadcast(paths), documents["document_path"] == paths["path"], "left_semi").select("folder_id")
    through = items.join(by_folder.unionByName(by_document), "folder_id", "left_semi").select("collection_id")
    return collections.join(by_import.unionByName(through), "collection_id", "left_semi").select("collection_id")


def existing_chunks(asked: DataFrame, chunks: DataFrame, identity: list[str] = CHUNK_IDENTITY) -> DataFrame:
    """Asked chunks that exist, with their chunk_id: equal in every part, null to null."""
    a, c = asked.alias("a"), chunks.alias("c")
    same = F.lit(True)
    for x in identity:
        same = same & F.col(f"a.{x}").eqNullSafe(F.col(f"c.{x}"))
    return a.join(c, same).select("a.*", "c.chunk_id")


def models_by_collection(asked: DataFrame, collections: DataFrame) -> DataFrame:
    """The embedding model of each asked id that is a number and has one."""
    ids = asked.select(F.col("id").try_cast("long").alias("collection_id")).where("collection_id is not null").distinct()
    return collections.join(ids, "collection_id", "left_semi").where("embedding_model is not null and embedding_model != ''").select("collection_id", "embedding_model")


def active(state: DataFrame) -> DataFrame:
    """Ready materials that are not switched off; unknown counts as on."""
    return state.where(F.col("collection_id").isNotNull() & (F.col("status") == "ready") & ~F.col("is_active").eqNullSafe(False))


def enabled(asked: DataFrame, state: DataFrame) -> DataFrame:
    """Asked ids, each once in the order asked, that are stored as ready and on."""
    first = asked.groupBy("collection_id").agg(F.min("pos").alias("pos"))
    return first.join(state.where("status = 'ready' and is_active"), "collection_id", "left_semi").orderBy("pos")


def list_materials(collections: DataFrame, state: DataFrame, items: DataFrame, folders: DataFrame) -> DataFrame:
    first = items.join(folders, "folder_id").groupBy("collection_id").agg(F.min("path").alias("folder_path"))
    return collections.join(state, "collection_id", "left").join(first, "collection_id", "left")


def summarize(files: DataFrame) -> DataFrame:
    """Totals of files (collection_id, document_id, words, chunks) by material."""
    ready = F.count_if(F.col("chunks") > 0)
    return files.groupBy("collection_id").agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("word_count"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunk_count"),
        ready.alias("ready_count"),
        F.when(ready > 0, "ready").otherwise("needsReview").alias("status"),
    )


def detail(files: Column, words: Column, chunks: Column) -> Column:
    unit = F.when(files == 1, "file").otherwise("files")
    return F.concat(files.cast("string"), F.lit(" "), unit, F.lit(" - "), F.format_number(words, 0), F.lit(" words - "), F.format_number(chunks, 0), F.lit(" chunks"))


def thumbnail_path(document_path: Column, page: Column) -> Column:
    return F.concat(F.substring(F.sha2(document_path, 256), 1, 20), F.format_string("/page-%04d.png", page))


def folder_for_import(path: Column, kind: Column) -> Column:
    return F.when(kind == "folder", path).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


class Catalog:
    """Versions of the tables under one root; every mutation makes one version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._path = hadoop
        self._fs = hadoop(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions: a pointer file names each table's folder ------------------------------------

    def _versions(self) -> list[str]:
        """Names of pointer files, the latest first."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted((n for n in names if n.startswith("v-")), reverse=True)

    def _read(self, name: str) -> dict[str, str] | None:
        """A pointer's content; none while it is being written."""
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _pointer(self) -> tuple[int, dict[str, str]]:
        for name in self._versions():
            if (found := self._read(name)) is not None:
                return int(name[2:]), found
        return 0, {}

    def table(self, name: str) -> DataFrame:
        folder = self._pointer()[1].get(name)
        if folder is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        have = self.spark.read.parquet(f"{self.root}/{folder}")
        want = self.spark.createDataFrame([], SCHEMAS[name])
        return want.unionByName(have, allowMissingColumns=True)  # columns added since come as nulls

    def commit(self, **tables: DataFrame) -> None:
        """Write changed tables, then the pointer to them; fails if another writer was first."""
        number, pointer = self._pointer()
        for name, df in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            pointer[name] = folder
        out = self._fs.create(self._path(f"{self.root}/v-{number + 1:012d}"), False)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()

    def vacuum(self, keep: int = 2) -> None:
        """Delete the folders that none of the last ``keep`` versions names, and older pointers; nobody may be reading them."""
        versions = self._versions()
        used = {folder for name in versions[:keep] for folder in (self._read(name) or {}).values()}
        for f in self._fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name in versions[keep:] or (f.isDirectory() and name not in used):
                self._fs.delete(f.getPath(), True)

    # -- mutations ---------------------------------------------------------------------------

    def _numbered(self, rows: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
        """New rows numbered after the largest id, in order, without a task that sorts them all.

        They are written in ranges; a range's number begins after the rows of those before it.
        """
        top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("n")).first()["n"]
        path = f"{self.root}/new-{uuid.uuid4().hex}"
        place = F.monotonically_increasing_id()
        ranged = rows.drop(key).repartitionByRange(*order).sortWithinPartitions(*order)
        ranged.withColumn("__range", F.shiftright(place, 33)).withColumn("__at", place.bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
        new = self.spark.read.parquet(path)
        sizes = new.groupBy("__range").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
        return new.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range").withColumn(key, F.lit(top) + F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")

    def add_folders(self, paths: DataFrame) -> None:
        """Insert folders (path) that are not there yet."""
        old = self.table("folders")
        new = paths.select("path").distinct().join(old, "path", "left_anti")
        self.commit(folders=old.unionByName(self._numbered(new, old, "folder_id", ["path"]).select(*old.columns)))

    def add_documents(self, rows: DataFrame) -> None:
        """Upsert documents (document_path, folder_id, document_time) by path; ids stay."""
        old = self.table("documents")
        given = rows.select("document_path", "folder_id", "document_time").dropDuplicates(["document_path"])
        known = old.select("document_id", "document_path").join(given, "document_path")
        new = self._numbered(given.join(old, "document_path", "left_anti"), old, "document_id", ["document_path"])
        kept = old.join(given, "document_path", "left_anti")
        self.commit(documents=kept.select(*old.columns).unionByName(known.select(*old.columns)).unionByName(new.select(*old.columns)))

    def add_chunks(self, rows: DataFrame) -> None:
        """Insert chunks whose six-part identity is not there yet; words default to a count, tokens to words."""
        old = self.table("chunks")
        full = self.spark.createDataFrame([], SCHEMAS["chunks"]).unionByName(rows, allowMissingColumns=True).drop("chunk_id")
        same = F.lit(True)
        for c in CHUNK_IDENTITY:
            same = same & full[c].eqNullSafe(old[c])
        new = full.join(old, same, "left_anti").dropDuplicates(CHUNK_IDENTITY)
        new = new.withColumn("words", F.coalesce("words", F.size(F.split(F.trim("chunk_text"), r"\s+")))).withColumn("tokens", F.coalesce("tokens", "words"))
        self.commit(chunks=old.unionByName(self._numbered(new, old, "chunk_id", ["document_id", "page", "chunk_text"]).select(*old.columns)))

    def put_embeddings(self, rows: DataFrame) -> None:
        """Insert or replace vectors by (model, folder, chunk)."""
        old = self.table("embeddings")
        key = ["model", "folder_id", "chunk_id"]
        self.commit(embeddings=old.join(rows, key, "left_anti").select(*old.columns).unionByName(rows.select(*old.columns)))

    def put_collection(self, collection: DataFrame, state: DataFrame, items: DataFrame) -> None:
        """Upsert collections with their state and folders; start_update_time is kept."""
        old, old_state, old_items = self.table("collections"), self.table("state"), self.table("items")
        given = self.spark.createDataFrame([], SCHEMAS["collections"]).unionByName(collection, allowMissingColumns=True)
        start = old.select("collection_id", F.col("start_update_time").alias("kept_time"))
        given = given.join(start, "collection_id", "left").withColumn("start_update_time", F.coalesce("kept_time", "start_update_time")).drop("kept_time")
        given_state = self.spark.createDataFrame([], SCHEMAS["state"]).unionByName(state, allowMissingColumns=True)
        self.commit(
            collections=old.join(given, "collection_id", "left_anti").unionByName(given),
            state=old_state.join(given_state, "collection_id", "left_anti").unionByName(given_state),
            items=old_items.unionByName(items.select("collection_id", "folder_id")).distinct(),
        )

    def replace_thumbnails(self, rows: DataFrame) -> None:
        """Replace the thumbnails of the documents given; rows without page or path are skipped."""
        old = self.table("thumbnails")
        good = rows.where("page > 0 and thumbnail_path is not null and thumbnail_path != ''")
        self.commit(thumbnails=old.join(rows.select("document_id").distinct(), "document_id", "left_anti").unionByName(good.select(*old.columns)))

    def set_active(self, ids: DataFrame, is_active: bool) -> None:
        """Switch materials on or off; one without a state gets a ready one."""
        old = self.table("state")
        flipped = old.join(ids.withColumn("hit", F.lit(True)), "collection_id", "left").withColumn("is_active", F.when(F.col("hit"), F.lit(is_active)).otherwise(F.col("is_active"))).select(*old.columns)
        new = ids.join(old, "collection_id", "left_anti").select("collection_id", F.lit("ready").alias("status"), F.lit(is_active).alias("is_active"))
        self.commit(state=flipped.unionByName(new, allowMissingColumns=True))

    # -- the life of an index -------------------------------------------------------------------

    def collections_for_path(self, path: str) -> DataFrame:
        """Collections imported from a path, or that hold a folder or document of it."""
        paths = self.spark.createDataFrame([(p,) for p in path_candidates(path)], "path string")
        return collections_for_paths(self.table("collections"), self.table("state"), self.table("items"), self.table("folders"), self.table("documents"), paths)

    def models_of(self, ids: DataFrame) -> list[str]:
        """The embedding models whose vectors lie in folders of collections."""
        own = self.table("items").join(ids, "collection_id", "left_semi").select("folder_id").distinct()
        return sorted(r["model"] for r in self.table("embeddings").join(own, "folder_id", "left_semi").select("model").distinct().collect())

    def replace_existing(self, path: str, material: str | None = None) -> list[str]:
        """Delete the collection of a numeric material id, else all of the import path; returns the models whose vectors went."""
        if material is not None and material.isdigit():
            ids = self.spark.createDataFrame([(int(material),)], "collection_id long")
        else:
            ids = self.collections_for_path(path).select("collection_id")
        models = self.models_of(ids)
        self.delete_collections(ids)
        return models

    def begin_index(self, collection: DataFrame, state: DataFrame, folders: DataFrame, documents: DataFrame) -> None:
        """Folders (path), documents (document_path, path, document_time), and the collection with its state as being indexed."""
        self.add_folders(folders)
        known = self.table("folders")
        own = known.join(folders.select("path").distinct(), "path", "left_semi")
        self.add_documents(documents.join(known, "path").select("document_path", "folder_id", "document_time"))
        items = collection.select("collection_id").crossJoin(own.select("folder_id"))  # one collection's folders
        self.put_collection(collection, state.drop("status").withColumn("status", F.lit("indexing")), items)

    def pending(self, chunks: DataFrame, model: str) -> DataFrame:
        """Chunks (document_path, chunk_text, page) that have no vector of the model yet: what a resumed index has to do."""
        done = self.table("embeddings").where(F.col("model") == model).join(self.table("chunks"), "chunk_id").join(self.table("documents"), "document_id")
        keys = ["document_path", "chunk_text", "page"]
        a, b = chunks.alias("a"), done.select(*keys).distinct().alias("b")
        return a.join(b, (F.col("a.document_path") == F.col("b.document_path")) & (F.col("a.chunk_text") == F.col("b.chunk_text")) & F.col("a.page").eqNullSafe(F.col("b.page")), "left_anti")

    def append_batch(self, rows: DataFrame, model: str) -> None:
        """A batch (document_path, chunk_text, page, embedding, further columns of chunks): chunks, then their vectors."""
        documents = self.table("documents").select("document_id", "folder_id", "document_path")
        rows = rows.join(documents, "document_path")
        self.add_chunks(rows.drop("document_path", "folder_id", "embedding"))
        c, r = self.table("chunks").alias("c"), rows.alias("r")
        same = (F.col("r.document_id") == F.col("c.document_id")) & (F.col("r.chunk_text") == F.col("c.chunk_text")) & F.col("r.page").eqNullSafe(F.col("c.page"))
        self.put_embeddings(r.join(c, same).select(F.lit(model).alias("model"), "r.folder_id", "c.chunk_id", F.col("r.embedding").cast("array<float>").alias("embedding")))

    def finish_index(self, collection_id: int, status: str, at: str, gone: list[str] = ()) -> list[str]:
        """Set the final state with its counts; returns the models whose search structures are built anew, those of deleted vectors too."""
        ids = self.spark.createDataFrame([(collection_id,)], "collection_id long")
        own = self.table("items").join(ids, "collection_id", "left_semi").select("folder_id").distinct()
        documents = self.table("documents").join(own, "folder_id", "left_semi")
        chunks = self.table("chunks").join(documents.select("document_id"), "document_id", "left_semi")
        files = documents.count()
        sums = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
        old = self.table("state")
        new = {"status": F.lit(status), "indexed_at": F.lit(at), "file_count": F.lit(files).cast("long"), "chunk_count": F.lit(sums["chunks"]).cast("long"), "word_count": F.lit(sums["words"]).cast("long"), "is_active": F.lit(status == "ready")}
        hit = F.col("collection_id") == collection_id
        self.commit(state=old.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in old.columns)))
        return sorted({*self.models_of(ids), *gone})

    def delete_by_path(self, path: str) -> bool:
        return self.delete_collections(self.collections_for_path(path).select("collection_id"))

    def delete_collections(self, ids: DataFrame) -> bool:
        """Delete collections; folders that no other uses go with their documents, chunks, vectors and thumbnails."""
        collections, items = self.table("collections"), self.table("items")
        if collections.join(ids, "collection_id", "left_semi").isEmpty():
            return False
        left = items.join(ids, "collection_id", "left_anti")
        orphans = items.join(ids, "collection_id", "left_semi").join(left, "folder_id", "left_anti").select("folder_id").distinct()
        documents = self.table("documents")
        gone = documents.join(orphans, "folder_id", "left_semi").select("document_id")
        chunks = self.table("chunks")
        lost = chunks.join(gone, "document_id", "left_semi").select("chunk_id")
        self.commit(
            collections=collections.join(ids, "collection_id", "left_anti"),
            state=self.table("state").join(ids, "collection_id", "left_anti"),
            items=left,
            folders=self.table("folders").join(orphans, "folder_id", "left_anti"),
            documents=documents.join(orphans, "folder_id", "left_anti"),
            chunks=chunks.join(gone, "document_id", "left_anti"),
            embeddings=self.table("embeddings").join(lost, "chunk_id", "left_anti"),
            thumbnails=self.table("thumbnails").join(gone, "document_id", "left_anti"),
        )
        return True
