"""The document engine: queries against DuckDB, fixtures of branches the tables never reach, catalog, stream."""

import os
import shutil
import subprocess
import sys
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from folioflow.functions import chat, study
from folioflow.functions import text as T
from folioflow.operators import chunking, cleaning
from folioflow.operators.catalog import Catalog
from folioflow.operators.embedding import HashEmbedder, embed_column
from folioflow.plans import queries as core
from folioflow.sources import files
from folioflow.streaming import index, progress

DATA = "/root/testdata/sf0.001"
QUICK = ["normalize_text", "count_words", "tokenize", "pack_sentences", "chunk_index", "paragraphize", "repeated_edge_lines", "vector_topk_ref", "source_rows", "incremental_anti", "resolve_source", "completed_turns", "html_strip", "pull_progress", "strip_citations", "settings_clamp", "excerpt", "conversation_title", "md_normalize", "normalize_urls", "unique_name", "search_term_for_source", "parse_followups_py", "clean_quiz_question", "quiz_prompts", "source_context", "scrape_library", "list_remote_models", "pdf_text_search", "clean_page", "preview_projection", "header_carry", "merge_indexed_pending", "new_materials_minus_existing", "display_model_name", "safe_filename", "model_role_filters", "normalize_models", "normalize_materials", "exclusive_activation", "material_transitions", "merge_saved_state", "quoted_source_index", "source_pdf_resolve", "json_list", "read_log", "ndjson_framing", "gguf_metadata", "scan_embedding_blob", "source_tray", "query_x_chunks", "vector_topk_exact", "merge_sources"]


def rows(df):
    return sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).map(lambda v: round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", QUICK)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "events", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(core.queries()[name](spark, DATA).toPandas()) == rows(con.sql(core.oracle_sql()[name]).df())


def test_entry_and_names(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(core.oracle_sql()) <= set(core.queries()) <= set(entry_module.queries())


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_library_lives_without_the_training_data_operators(tmp_path, pipeline_too):
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    shutil.copytree(os.path.join(root, "folioflow"), tmp_path / "folioflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "folioflow" / "llm" / "__pycache__").mkdir(parents=True)  # what is left where files were deleted
    for name in ("__spark_entry__.py",) if pipeline_too else ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(os.path.join(root, name), tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q) and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column("t")).first()[0]


def test_cleaning_branches(spark):
    assert one(spark, T.normalize_text, " a\x00b  c\td\n\n\n\ne  ") == "ab c\td\n\ne"
    assert one(spark, T.normalize_extracted, "a \r\nb\t\tc\rd") == "a\nb c\nd"
    assert one(spark, T.repair_hyphens, "a-\nb-\nc") == "ab-\nc"
    assert one(spark, cleaning.paragraphs, "one line\nwrapped here.\n\n- item\nThe Heading\nrest of it.") == "one line wrapped here.\n\n- item\n\nThe Heading\n\nrest of it."
    assert one(spark, lambda t: T.section_header(t, article=True), "== Early life ==") == "Early life"
    assert cleaning.resolve_rules("none", ["merge_wrapped_lines", "x"]) == ["normalize_text", "merge_wrapped_lines"]


def test_pages_lose_repeated_edges_and_carry_headings(spark):
    body = "Many words follow here so that this paragraph is kept whole."
    pages = [("d", k, f"Course Notes\n{'Chapter 12: Magnetic Disks' + chr(10) if k == 1 else ''}{body} {k}.\nend mark") for k in (1, 2)]
    clean = cleaning.clean_pages(spark.createDataFrame(pages, "document_id string, page int, text string"))
    assert all("Course Notes" not in r["text"] and "end mark" not in r["text"] for r in clean.collect())
    chunks = chunking.chunk_pages(clean).orderBy("page").collect()
    assert [r["section_header"] for r in chunks] == ["Chapter 12: Magnetic Disks"] * 2 and [r["chunk_index"] for r in chunks] == [1, 2]


def test_entities_decode_once(spark):
    assert one(spark, T.html_text, "<p>&amp;lt; &#65;&#x1F600;&#X41; &bogus; &#55296; &NBSP;x&</p>") == "&lt; A😀A &bogus; &#55296; x&"
    assert one(spark, T.html_text, "") == "" and one(spark, T.html_text, None) is None


def test_places_of_a_token(spark):
    assert one(spark, lambda t: T.find_all(t, F.lit("aa")), "aaa é aa") == [0, 1, 6]
    assert one(spark, lambda t: T.find_all(t, F.lit("x")), "aaa") == []


def test_page_search_runs_across_pieces(spark):
    pages = [("d", 1, 0, "Magnetic"), ("d", 1, 1, " "), ("d", 1, 2, "DISKS spin"), ("d", 1, 3, "fast"), ("d", 2, 0, "magnetic  disks"), ("d", 2, 1, "magnetic"), ("d", 2, 2, "disks")]
    items = spark.createDataFrame(pages, "document_id string, page int, item int, text string")
    found = lambda q: sorted((r["page"], r["item"]) for r in study.page_matches(items, q).collect())
    assert found("Magnetic disks") == [(1, 0), (1, 2), (2, 0)]
    assert found("  ") == [] and found("none such") == []


def test_empty_conversation_has_a_title(spark):
    assert one(spark, chat.conversation_title, "  ") == "New Study Chat"


def test_batches(spark):
    got = spark.range(1, 9).select(chunking.batch_ids(F.col("id"), True, 3).alias("b")).groupBy("b").count().orderBy("b").collect()
    assert [r["count"] for r in got] == [1, 3, 3, 1]


def test_index_is_begun_resumed_finished_and_replaced(spark, tmp_path):
    from folioflow.operators.chunking import chunk_documents
    from folioflow.operators.embedding import hashed_embedding

    c = Catalog(spark, str(tmp_path / "catalog"))
    texts = [(f"/lib/{k}.txt", " ".join(f"word{k}x{j} goes on." for j in range(400))) for k in range(3)]
    docs = spark.createDataFrame([(p, "/lib", 5, t) for p, t in texts], "document_path string, path string, document_time long, text string")
    chunks = chunk_documents(docs, "document_path").select("document_path", "chunk_text", F.lit(None).cast("int").alias("page"), "words", hashed_embedding("chunk_text").alias("embedding"))

    def begin(n):
        row = spark.createDataFrame([(n, f"Lib {n}", 1, 1, "m1")], "collection_id long, name string, start_update_time long, last_update_time long, embedding_model string")
        state = spark.createDataFrame([(n, "/lib", "folder")], "collection_id long, import_path string, kind string")
        c.begin_index(row, state, docs.select("path").distinct(), docs.select("document_path", "path", "document_time"))

    begin(1)
    assert c.table("state").first()["status"] == "indexing" and c.table("documents").count() == 3
    total = chunks.count()
    half = chunks.where("document_path = '/lib/0.txt'")
    c.append_batch(half, "m1")
    left = c.pending(chunks, "m1")
    assert left.count() == total - half.count() > 0  # what a resumed index has to do
    c.append_batch(left, "m1")
    c.append_batch(half, "m1")  # a batch that comes again adds nothing
    assert c.pending(chunks, "m1").isEmpty() and c.table("chunks").count() == c.table("embeddings").count() == total
    assert sorted(r["chunk_id"] for r in c.table("chunks").collect()) == list(range(1, total + 1))
    assert c.finish_index(1, "ready", "2024-01-01T00:00:00+00:00", ["old"]) == ["m1", "old"]
    row = c.table("state").first()
    assert (row["status"], row["file_count"], row["chunk_count"], row["is_active"]) == ("ready", 3, total, True)
    before = c._versions()[0]
    assert c.replace_existing("file:///lib") == ["m1"] and c.table("chunks").isEmpty() and c.table("folders").isEmpty()
    assert c._versions()[0] > before
    begin(2)
    c.vacuum()
    assert len(c._versions()) == 2 and c.delete_by_path("/lib") and not c.delete_by_path("/lib")
    number, _ = c._pointer()
    (tmp_path / "catalog" / f"v-{number + 1:012d}").write_text('{"collections": "half')  # a pointer that is being written does not count
    assert c._pointer()[0] == number


def test_lines_end_at_any_terminator(spark):
    assert one(spark, T.lines, "a\r\nb\rc\x0cd\u2028e\n") == ["a", "b", "c", "d", "e"] and one(spark, T.lines, "a\n\nb") == ["a", "", "b"]
    pages = [("d", k, f"Course Notes\x0cMany words follow here so that this is kept {k}.\x0cend mark") for k in (1, 2)]
    found = cleaning.repeated_edge_lines(spark.createDataFrame(pages, "document_id string, page int, text string"))
    assert {r["key"] for r in found.collect()} == {"course notes", "end mark"}


def test_paragraphs_of_a_long_text(spark):
    text = "\n\n".join(f"line {k} of it\nwraps here." for k in range(30_000))
    assert one(spark, cleaning.paragraphs, text) == "\n\n".join(f"line {k} of it wraps here." for k in range(30_000))
    assert one(spark, cleaning.paragraphs, "\n\n alpha runs\nbeta runs on.\n\n\ngamma runs on.\n- d\n- e\nzeta runs on.\n") == "alpha runs beta runs on.\n\ngamma runs on.\n\n- d\n\n- e\n\nzeta runs on."


def test_whole_tables_are_searched_in_blocks(spark):
    from folioflow.operators import retrieval

    v = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(120).cache()
    one_block = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.all_top_k(v, v, 3).collect()}
    many = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.all_top_k(v, v, 3, block_rows=17).collect()}
    assert one_block == many and len(many) == 360


def test_catalog_life(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "catalog"))
    c.add_folders(spark.createDataFrame([("/a",), ("/b",), ("/a",)], "path string"))
    ids = {r["path"]: r["folder_id"] for r in c.table("folders").collect()}
    c.add_documents(spark.createDataFrame([("/a/x.md", ids["/a"], 1), ("/b/y.md", ids["/b"], 1)], "document_path string, folder_id long, document_time long"))
    c.add_documents(spark.createDataFrame([("/a/x.md", ids["/a"], 2)], "document_path string, folder_id long, document_time long"))
    docs = {r["document_path"]: r for r in c.table("documents").collect()}
    assert len(docs) == 2 and docs["/a/x.md"]["document_time"] == 2
    chunk = spark.createDataFrame([(docs["/a/x.md"]["document_id"], "some words here", None)], "document_id long, chunk_text string, page int")
    c.add_chunks(chunk)
    c.add_chunks(chunk)
    assert [(r["words"], r["tokens"]) for r in c.table("chunks").collect()] == [(3, 3)]
    vector = lambda x: spark.createDataFrame([("m", ids["/a"], 1, [x])], "model string, folder_id long, chunk_id long, embedding array<float>")
    c.put_embeddings(vector(1.0))
    c.put_embeddings(vector(2.0))
    assert [r["embedding"] for r in c.table("embeddings").collect()] == [[2.0]]
    for k, (folder, start) in enumerate((("/a", 5), ("/b", 6), ("/a", 9))):
        own = 1 + k % 2
        c.put_collection(
            spark.createDataFrame([(own, f"n{k}", start)], "collection_id long, name string, start_update_time long"),
            spark.createDataFrame([(own, "ready", True)], "collection_id long, status string, is_active boolean"),
            spark.createDataFrame([(own, ids[folder])], "collection_id long, folder_id long"),
        )
    kept = {r["collection_id"]: r for r in c.table("collections").collect()}
    assert kept[1]["start_update_time"] == 5 and kept[1]["name"] == "n2"
    c.set_active(spark.createDataFrame([(1,), (7,)], "collection_id long"), False)
    assert {r["collection_id"]: r["is_active"] for r in c.table("state").collect()} == {1: False, 2: True, 7: False}
    gone = spark.createDataFrame([(1,)], "collection_id long")
    assert c.delete_collections(gone) and not c.delete_collections(gone)
    assert [r["path"] for r in c.table("folders").collect()] == ["/b"]
    assert c.table("chunks").count() == c.table("embeddings").count() == 0 and c.table("documents").count() == 1


def test_stream_embeds_only_new_chunks(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "index")
    text = "These are more than twenty words in all so that the document is long enough to be kept as a chunk of text."
    for k in range(2):
        spark.createDataFrame([(1, text), (k + 2, f"{text} {k}")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        index.start(spark.readStream.schema("doc_id long, text string").parquet(source), out, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_files_logs_and_embedder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.MD").write_bytes(b"x \xff  y")
    (tmp_path / "b.docx").write_bytes(b"no")
    found = files.supported_files(spark, str(tmp_path))
    assert [r["text"] for r in files.text_files(found).collect()] == ["x y"]
    (tmp_path / "log.txt").write_text('{"event": "a"}\n\nbroken\n{"x": 1}\n')
    assert sorted(r["event"] for r in files.read_log(spark, str(tmp_path / "log.txt")).collect()) == ["a", "log_event", "raw_log_line"]
    vector = spark.createDataFrame([("disks and databases",)], "t string").select(embed_column(HashEmbedder)(F.col("t"))).first()[0]
    assert len(vector) == 64 and abs(sum(x * x for x in vector) - 1) < 1e-9


def test_progress_is_the_same_in_any_order(spark):
    """The plain sum of these is 102.5 or next below it, by their order: 20.5 percent rounds up only as what it is."""
    values = [2.66, 0.15, 58.13, 34.69, 6.87]
    orders = list(permutations(values))
    rows = [(f"m{m}", f"d{k}", 1, v, 100.0) for m, order in enumerate(orders) for k, v in enumerate(order)]
    rows += [("none", "d", 1, None, None), ("big", "d", 1, float("inf"), 100.0), ("big", "e", 1, 1.0, None), ("later", "d", 1, 9.0, 100.0), ("later", "d", 2, 50.0, 100.0)]
    events = spark.createDataFrame(rows, "model string, digest string, seq int, completed double, total double")
    got = {r["model"]: tuple(r)[1:] for r in progress.pull_progress(events.where("model != 'big'")).collect()}
    assert {got[f"m{m}"] for m in range(len(orders))} == {(102.5, 500.0, 21)}
    assert got["none"] == (None, None, 0) and got["later"] == (50.0, 100.0, 50)
    assert progress.pull_progress(events.where("model = 'big'")).select("completed", "total").first() == (float("inf"), 100.0)
