"""Queries of prompts, suggestions, titles, listings and page search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import names, study
from folioflow.functions import text as T
from folioflow.operators import chunking, cleaning, materials
from folioflow.plans.registry import Registry, values_sql
from folioflow.plans.text_queries import HEADING_SQL, KEPT, compact_sql, documents, extracted_sql, strip_sql
from folioflow.sources import listings

R = Registry()


def text_sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TITLES = [(1, "Disks.PDF"), (2, " My  notes.v2.markdown"), (3, "plain"), (4, None), (5, "a.txt.md")]


@R.add("clean_material_title", rf"SELECT id, {compact_sql(r'''regexp_replace(coalesce(t, ''), '(?i)\.(pdf|md|markdown|txt)$', '')''')} AS title FROM {values_sql(_TITLES)} v(id, t)")
def clean_material_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_TITLES, "id int, t string").select("id", study.clean_title("t").alias("title"))


_MARKDOWN = [(1, "Two kinds: - Fast ones - slow ones; * Tape"), (2, "Steps: 1. Read 2. write. 3. **Done**"), (3, "**Head** - Next\r\nline"), (4, "2 - 3 = x")]
_LEADS = [(r"[.!?:;)]", "[*-]"), (r"\*\*", "[*-]"), (r"[.!?:;)]", r"\d+\.")]


def _markdown_sql(x: str) -> str:
    x = f"replace({x}, chr(13) || chr(10), chr(10))"
    for lead, mark in _LEADS:
        x = rf"regexp_replace({x}, '({lead})\s+({mark})\s+(\*\*|[A-Z0-9])', '\1' || chr(10) || '\2 \3', 'g')"
    return strip_sql(x)


@R.add("md_normalize", f"SELECT id, {_markdown_sql('t')} AS text FROM {values_sql(_MARKDOWN)} v(id, t)")
def md_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_MARKDOWN, "id int, t string").select("id", study.list_lines("t").alias("text"))


_URLS = [(1, " http://localhost:11434/api/ "), (2, "https://host/v1//"), (3, ""), (4, None), (5, "http://host:1/api")]


@R.add("normalize_urls", f"WITH u AS (SELECT id, regexp_replace({strip_sql('t')}, '/+$', '') AS remote, regexp_replace(regexp_replace(regexp_replace({strip_sql('coalesce(t, chr(32))')}, '/+$', ''), '/api$', ''), '/+$', '') AS l FROM {values_sql(_URLS)} v(id, t)) SELECT id, remote, CASE WHEN l IN ('', 'http://localhost:11434') THEN 'http://127.0.0.1:11434' ELSE l END AS local FROM u")
def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_URLS, "id int, t string").select("id", study.base_url("t").alias("remote"), study.local_server_url("t").alias("local"))


@R.add("estimate_pages", "WITH p AS (SELECT doc_id, CAST(least(7, greatest(1, floor(300 * 7 / n_chars) + 1)) AS INTEGER) AS first, CAST(floor(900 * 7 / n_chars) + 1 AS INTEGER) AS z FROM documents WHERE n_chars > 0) SELECT doc_id, first, least(7, greatest(first, z)) AS last FROM p")
def estimate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = study.estimated_pages(F.lit(300), F.lit(900), F.col("n_chars"), F.lit(7))
    return documents(spark, sf_dir).where("n_chars > 0").select("doc_id", pages.alias("p")).select("doc_id", "p.first", "p.last")


_LABELS = [(1, 2, 5, "Chunk 1"), (2, 3, 3, "x"), (3, None, 4, "Chunk 7"), (4, 0, 0, "y"), (5, 4, None, "z")]


@R.add("page_label", f"SELECT id, CASE WHEN coalesce(a, 0) <> 0 AND coalesce(z, 0) > a THEN 'Pages ' || a || '-' || z WHEN coalesce(a, 0) <> 0 THEN 'Page ' || a ELSE l END AS label FROM {values_sql(_LABELS)} v(id, a, z, l)")
def page_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_LABELS, "id int, a int, z int, l string").select("id", study.page_label(F.col("a"), F.col("z"), F.col("l")).alias("label"))


@R.add("unique_name", "SELECT * FROM (VALUES (1, 'Notes (3)'), (2, 'Disks'), (3, 'Course materials'), (4, 'Maths (2)')) v(id, name)")
def unique_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.array(*map(F.lit, ["Notes", "Notes (2)", "Maths", "Maths (3)"]))
    rows = spark.createDataFrame([(1, " Notes "), (2, "Disks"), (3, " "), (4, "Maths")], "id int, t string")
    return rows.select("id", study.unique_name(F.col("t"), taken).alias("name"))


_EXCERPTS = [(1, "...Short. This sentence is long enough to look for. Another one."), (2, "only  a few words..."), (3, "..."), (4, "w" * 130)]


@R.add("search_term_for_source", f"SELECT * FROM (VALUES (1, 'This sentence is long enough to look for.'), (2, 'only a few words'), (3, ''), (4, '{'w' * 120}')) v(id, term)")
def search_term_for_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_EXCERPTS, "id int, t string").select("id", study.search_term("t").alias("term"))


_INSTRUCTIONS = [(1, "Ask {count} things.", 4), (2, "Ask.", 1), (3, "Ask.", 2)]


@R.add("followup_instruction", f"SELECT id, CASE WHEN contains(t, '{{count}}') THEN replace(t, '{{count}}', CAST(n AS VARCHAR)) ELSE 'Generate ' || n || ' suggested follow-up question' || CASE WHEN n = 1 THEN '' ELSE 's' END || '.' || chr(10) || t END AS text FROM {values_sql(_INSTRUCTIONS)} v(id, t, n)")
def followup_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_INSTRUCTIONS, "id int, t string, n int").select("id", study.follow_up_instruction(F.col("t"), F.col("n")).alias("text"))


_REPLIES = [(1, '["What is RAID?", "why  not", "1. How fast is it?"]'), (2, "- What is a disk? and\n2) what is a DISK?\n* Where is\nit kept?\nWhat is a Disk?"), (3, "none"), (4, "Why " + "so " * 70 + "long?"), (5, "[]")]


@R.add("parse_followups_py", f"SELECT * FROM (VALUES (1, 'What is RAID?|How fast is it?'), (2, 'What is a disk?|Where is' || chr(10) || 'it kept?'), (3, ''), (4, '{('Why ' + 'so ' * 70)[:177].rstrip()}...'), (5, '')) v(id, questions)")
def parse_followups_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_REPLIES, "id int, t string").select("id", F.array_join(study.suggestions("t"), "|").alias("questions"))


_QUIZ = [(1, "Quiz question 2 of 5: What  is a disk?"), (2, "Sure!\n- 1. Question: Why spin?"), (3, "Tell me how disks work? yes"), (4, "No."), (5, '"Is it so?"')]


@R.add("clean_quiz_question", "SELECT * FROM (VALUES (1, 'What is a disk?'), (2, 'Why spin?'), (3, 'how disks work?'), (4, NULL), (5, 'Is it so?')) v(id, question)")
def clean_quiz_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_QUIZ, "id int, t string").select("id", study.quiz_question("t").alias("question"))


_AREAS = "[" + ", ".join(map(text_sql, study.QUIZ_AREAS)) + "]"
_ASKED = "WITH q AS (SELECT * FROM (VALUES (1, []::VARCHAR[]), (2, ['What is a disk?']), (7, ['Why?', 'How?'])) v(n, asked))"


@R.add(
    "quiz_prompts",
    f"""{_ASKED} SELECT n, concat_ws(chr(10), 'Create quiz question ' || n || ' of 5.', 'Focus on ' || {_AREAS}[(n - 1) % 5 + 1] || '.', {text_sql(study.QUIZ_TASK)},
    CASE WHEN len(asked) = 0 THEN {text_sql(study.QUIZ_NONE_ASKED)} ELSE {text_sql(study.QUIZ_ASKED)} || chr(10) || array_to_string(list_transform(asked, lambda q, i: i || '. ' || q), chr(10)) END, {text_sql(study.QUIZ_RULES)}) AS question,
    {text_sql(study.QUIZ_GRADING)} || chr(10) || chr(10) || 'Quiz question ' || n || ' of 5: Why?' || chr(10) || 'Student answer: So.' AS feedback FROM q""",
)
def quiz_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, []), (2, ["What is a disk?"]), (7, ["Why?", "How?"])], "n int, asked array<string>")
    n, five = F.col("n"), F.lit(5)
    return rows.select("n", study.quiz_question_prompt(n, five, F.col("asked")).alias("question"), study.quiz_feedback_prompt(n, five, F.lit("Why?"), F.lit("So.")).alias("feedback"))


_SOURCES = [(1, []), (2, [("Disks", "/a.pdf", "Page 2", "1.1 Heads", "Heads  move."), (None, None, " ", None, None)])]


def _block(local: bool) -> str:
    place = "CASE WHEN id = 2 THEN 'Locator: Page 2' || chr(10) END || " if local else ""
    return f"'Collection: Disks' || chr(10) || 'Path: /a.pdf' || chr(10) || {place}'Section: 1.1 Heads' || chr(10)"


@R.add(
    "source_context",
    f"""SELECT id, CASE WHEN id = 1 THEN '' ELSE {text_sql(study.CONTEXT_LOCAL)} || {_block(True)} || 'Text: Heads move.' || chr(10) || chr(10) || 'Collection: Library' || chr(10) || 'Path: ' || chr(10) || 'Text: ' || chr(10) || chr(10) END AS local,
    CASE WHEN id = 1 THEN '' ELSE {text_sql(study.CONTEXT_REMOTE)} || {_block(False)} || 'Text: Heads  move.' || chr(10) || 'Collection: Library' || chr(10) || 'Path: ' || chr(10) || 'Text: ' END AS remote FROM (VALUES (1), (2)) v(id)""",
)
def source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_SOURCES, f"id int, s array<struct<{', '.join(c.replace(' ', ':') for c in study.SOURCE.split(', '))}>>")
    return rows.select("id", study.source_context(F.col("s")).alias("local"), study.source_context(F.col("s"), remote=True).alias("remote"))


_CARDS = """<ul><li x-test-model class="c"><a href="/library/alpha"><span x-test-search-response-title>Alpha</span></a><p></p><p>A &lt;small&gt; model &#8212; ok</p>
<span x-test-capability>tools</span><span x-test-capability>vision</span><span x-test-size>8b</span><span x-test-pull-count>1.2M</span><span x-test-tag-count>1,024</span><span x-test-updated>2 days ago</span></li>
<li x-test-model><div x-test-model-title title="Beta &amp; co">old</div></li><li x-test-model><span x-test-search-response-title>ALPHA</span></li><li>none</li></ul>"""


@R.add("scrape_library", "SELECT * FROM (VALUES (0, 'Alpha', 'A <small> model — ok', 'https://ollama.com/library/alpha', 'tools,vision', '8b', '1.2M', 1024, '2 days ago'), (1, 'Beta & co', '', 'https://ollama.com/library', '', '', NULL, NULL, NULL)) v(pos, name, description, url, capabilities, sizes, pulls, tag_count, updated)")
def scrape_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = listings.library_cards(spark.createDataFrame([(1, _CARDS)], "page_id long, html string"))
    return cards.select("pos", "name", "description", "url", F.array_join("capabilities", ",").alias("capabilities"), F.array_join("sizes", ",").alias("sizes"), "pulls", "tag_count", "updated")


_OPEN = '{"data": [{"id": " gpt-4.1 "}, {"id": "o1"}, {"id": "gpt-4.1"}, {"id": null}, {"id": "gpt-5"}]}'
_NATIVE = '{"models": [{"name": "models/gemini-2", "supportedGenerationMethods": ["generateContent"]}, {"name": "models/embed", "supportedGenerationMethods": ["embedContent"]}, {"name": "models/gemini-10", "supportedGenerationMethods": ["generateContent", "x"]}]}'


@R.add("list_remote_models", "SELECT * FROM (VALUES ('open', 'gpt-5', 1), ('open', 'gpt-4.1', 2), ('open', 'o1', 3), ('native', 'gemini-10', 1), ('native', 'gemini-2', 2)) v(kind, id, pos)")
def list_remote_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [listings.remote_models(spark.createDataFrame([(p,)], "payload string"), native).select(F.lit(kind).alias("kind"), "id", "pos") for kind, p, native in (("open", _OPEN, False), ("native", _NATIVE, True))]
    return kinds[0].unionByName(kinds[1])


@R.add(
    "pdf_text_search",
    f"""WITH i AS (SELECT source AS document_id, doc_id AS page, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS item, {compact_sql('lower(unnest(s))')} AS t FROM (SELECT source, doc_id, string_split(text, chr(10)) AS s FROM documents)),
    direct AS (SELECT document_id, page, item FROM i WHERE contains(t, 'data is')),
    joined AS (SELECT page, string_agg(t, ' ' ORDER BY item) AS full_text FROM i WHERE t <> '' AND page NOT IN (SELECT page FROM direct) GROUP BY page),
    placed AS (SELECT document_id, page, item, coalesce(sum(len(t) + 1) OVER (PARTITION BY page ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, len(t) AS n FROM i WHERE t <> ''),
    parts AS (SELECT page, string_split(full_text, 'data is') AS p FROM joined),
    hits AS (SELECT page, unnest(list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[:k], lambda x: len(x))) + (k - 1) * 7)) AS h FROM parts)
    SELECT document_id, page, item FROM direct UNION ALL SELECT DISTINCT document_id, page, item FROM placed JOIN hits USING (page) WHERE s < h + 7 AND s + n > h""",
)
def pdf_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = documents(spark, sf_dir).select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), F.posexplode(T.lines("text")).alias("item", "text"))
    return study.page_matches(items, "Data  is")


# -- names, materials and previews ---------------------------------------------------------------

_OUTPUT = [(1, "<<<ANSWER>>> So it is. <<<END>>>"), (2, "plain")]


@R.add("answer_markers", f"SELECT id, {strip_sql(chr(114) + 'eplace(replace(t, ' + text_sql('<<<ANSWER>>>') + ', ' + chr(39) * 2 + '), ' + text_sql('<<<END>>>') + ', ' + chr(39) * 2 + ')')} AS text FROM {values_sql(_OUTPUT)} v(id, t)")
def answer_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_OUTPUT, "id int, t string").select("id", names.without_marks(F.col("t")).alias("text"))


_SECRETS = [(1, "key k-1 is bad, k-1!", "k-1"), (2, "no key", ""), (3, "x" * 600, None)]


@R.add("redact_secret", f"SELECT id, substr(CASE WHEN coalesce(s, '') <> '' THEN replace(t, s, '[redacted]') ELSE t END, 1, 500) AS text FROM {values_sql(_SECRETS)} v(id, t, s)")
def redact_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_SECRETS, "id int, t string, s string").select("id", names.redacted(F.col("t"), F.col("s")).alias("text"))


_FILES = [("/a/b.PDF", False), ("/a/c.markdown", False), ("/d.txt", False), ("/a/e", True), ("x/y.docx", False)]


@R.add("file_type_label", rf"SELECT path, CASE WHEN regexp_matches(lower(path), '\.pdf$') THEN 'PDF' WHEN regexp_matches(lower(path), '\.(md|markdown)$') THEN 'Markdown' WHEN regexp_matches(lower(path), '\.txt$') THEN 'Text file' ELSE 'Document' END AS label FROM {values_sql(_FILES)} v(path, is_folder)")
def file_type_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_FILES, "path string, is_folder boolean").select("path", names.file_type(F.col("path")).alias("label"))


@R.add("folder_for_import", f"SELECT path, CASE WHEN is_folder THEN path ELSE coalesce(nullif(regexp_replace(path, '/[^/]*$', ''), ''), '/') END AS folder FROM {values_sql(_FILES)} v(path, is_folder)")
def folder_for_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_FILES, "path string, is_folder boolean").select("path", names.import_folder(F.col("path"), F.col("is_folder")).alias("folder"))


@R.add("safe_filename", r"SELECT t, trim(t) <> '' AND NOT regexp_matches(t, '[/\\]') AND t NOT IN ('.', '..') AS safe FROM (VALUES ('a.gguf'), (' '), ('../a'), ('a\b'), ('..')) v(t)")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("a.gguf",), (" ",), ("../a",), ("a\\b",), ("..",)], "t string").select("t", names.safe_filename(F.col("t")).alias("safe"))


_NAMES = [("Llama3:latest", "llama3"), ("llama3:8b", "llama3"), ("llama3", "llama3:8b"), ("llama31", "llama3")]


@R.add("model_name_match", f"WITH n AS (SELECT a, b, regexp_replace(lower(trim(a)), ':latest$', '') AS x, regexp_replace(lower(trim(b)), ':latest$', '') AS y FROM {values_sql(_NAMES)} v(a, b)) SELECT a, b, x = y OR starts_with(x, y || ':') AS same FROM n")
def model_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_NAMES, "a string, b string").select("a", "b", names.same_model(F.col("a"), F.col("b")).alias("same"))


@R.add("display_model_name", "SELECT * FROM (VALUES (1, 'Own'), (2, 'remote-1'), (3, 'model.q4'), (4, 'Local Model')) v(id, name)")
def display_model_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, " Own ", "r", "/p"), (2, "", "remote-1", None), (3, None, " ", "/m/model.q4.gguf"), (4, None, None, "")], "id int, n string, r string, p string")
    return rows.select("id", names.model_name(F.col("n"), F.col("r"), F.col("p")).alias("name"))


_BUDGETS = [(1, 4096, 0.7), (2, 64, 0.0), (3, 160, 2.0)]


@R.add("followup_budget", f"SELECT id, least(n, 160) AS tokens, CAST(greatest(0.2, least(0.8, t)) AS DOUBLE) AS temperature FROM {values_sql(_BUDGETS)} v(id, n, t)")
def followup_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_BUDGETS, "id int, n int, t double")
    return rows.select("id", names.follow_up_budget(F.col("n"), F.col("t")).alias("b")).select("id", "b.tokens", "b.temperature")


@R.add("preview_first_file", "SELECT min_by(source, lower(source)) AS path FROM documents")
def preview_first_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materials.first_file(documents(spark, sf_dir).select(F.col("source").alias("path")))


def _cut_sql(x: str, n: int) -> str:
    return rf"CASE WHEN len({x}) > {n} THEN regexp_replace(substr({x}, 1, {n - 1}), '\s+$', '') || '…' ELSE {x} END"


@R.add(
    "preview_projection",
    f"""WITH {KEPT}, f AS (SELECT min_by(source, lower(source)) AS source FROM documents), p AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents JOIN f USING (source)),
    n AS (SELECT doc_id, {extracted_sql('text')} AS t FROM p), z AS (SELECT t, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM n WHERE t <> ''),
    c AS (SELECT chunk_text, row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS pos FROM kept WHERE doc_id IN (SELECT doc_id FROM p))
    SELECT 'raw' AS kind, CAST(pos AS INTEGER) AS pos, md5({_cut_sql('text', 6000)}) AS text FROM p WHERE pos < 2
    UNION ALL SELECT 'cleaned', CAST(pos AS INTEGER), md5({_cut_sql('t', 6000)}) FROM z WHERE pos < 2
    UNION ALL SELECT 'chunk', CAST(pos AS INTEGER), md5({_cut_sql('chunk_text', 1500)}) FROM c WHERE pos < 6""",
)
def preview_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("source").alias("path"), F.col("source").alias("document_id"), F.col("doc_id").alias("page"), "text")
    own = docs.join(F.broadcast(materials.first_file(docs)), "path", "left_semi")  # one row
    chunks = chunking.chunk_documents(chunking.spread(own.select("page", "text"), "page"), key="page")
    found = materials.preview(own, cleaning.clean_pages(own.drop("path"), "minimal"), chunks)
    return found.select("kind", "pos", F.md5(F.col("text").cast("binary")).alias("text"))


@R.add("header_carry", f"WITH lines AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), h AS (SELECT doc_id, pos, CASE WHEN coalesce({HEADING_SQL}, false) THEN l END AS own FROM (SELECT *, {strip_sql('line')} AS l FROM lines)) SELECT doc_id, pos, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS header FROM h")
def header_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(T.lines("text")).alias("pos", "line"))
    own = F.when(T.is_heading("line"), T.strip("line"))
    return rows.withColumn("own", own).select("doc_id", "pos", chunking.carried("own", ["doc_id"], ["pos"]).alias("header"))


@R.add("locator", "SELECT doc_id, CASE WHEN doc_id % 4 > doc_id % 3 AND doc_id % 3 > 0 THEN 'Pages ' || doc_id % 3 || '-' || doc_id % 4 WHEN doc_id % 3 > 0 THEN 'Page ' || doc_id % 3 ELSE 'Chunk ' || doc_id END AS locator FROM documents")
def locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return documents(spark, sf_dir).select("doc_id", T.locator((d % 3).cast("int"), (d % 4).cast("int"), d).alias("locator"))


_OLD = [(0, "/a", "m1"), (1, "/b", "m1")]
_NEW = [(0, "/b", "m1"), (1, "/b", "m2"), (2, "/c", "m1")]


@R.add("new_materials_minus_existing", f"WITH o AS (SELECT * FROM {values_sql(_OLD)} v(pos, path, model)), n AS (SELECT * FROM {values_sql(_NEW)} v(pos, path, model)) SELECT pos, path, model, 0 AS part FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = n.path AND o.model = n.model) UNION ALL SELECT *, 1 FROM o")
def new_materials_minus_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "pos int, path string, model string"
    return materials.with_new(spark.createDataFrame(_OLD, kind), spark.createDataFrame(_NEW, kind), ["path", "model"])


@R.add("merge_indexed_pending", "SELECT * FROM (VALUES ('p3', '/c', 'indexing', true), ('1', '/a', 'paused', false), ('2', '/b', 'ready', false), ('4', '/d', 'paused', false)) v(id, path, status, pending_first)")
def merge_indexed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "id string, path string, status string"
    pending = spark.createDataFrame([("1", "/x", "paused"), ("p2", "/b", "paused"), ("p3", "/c", "indexing"), ("p4", "/d", "paused")], kind)
    indexed = spark.createDataFrame([("1", "/a", "indexing"), ("2", "/b", "ready"), ("4", "/d", "indexing")], kind)
    return materials.merge_indexed(pending, indexed)
