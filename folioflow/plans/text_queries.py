"""Queries of the text functions: cleaning, words, sentences, chunks, pages, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import chunking, cleaning
from folioflow.plans.registry import Registry, table

R = Registry()


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def normalize_sql(x: str) -> str:
    return strip_sql(rf"regexp_replace(regexp_replace(replace({x}, chr(0), ''), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def extracted_sql(x: str) -> str:
    x = rf"regexp_replace(replace({x}, chr(0), ''), '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '(?m)[ \t]+$', '', 'g')"
    return strip_sql(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def compact_sql(x: str) -> str:
    return strip_sql(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def _quoted(p: str) -> str:
    return p.replace("'", "''")


SENTENCES = _quoted(T.SENTENCE_PATTERN)
WORDS = _quoted(T.WORD_PATTERN)
TOKENS = _quoted(T.TOKEN_PATTERN)
STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def count_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WORDS}'))"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{TOKENS}'), lambda t: len(t) > 1 AND NOT list_contains({STOPS}, t))"


def _items(x: str) -> str:
    return f"list_prepend({{'done': []::VARCHAR[], 'cur': ''}}, list_transform({x}, lambda t: {{'done': []::VARCHAR[], 'cur': t}}))"


_FLUSH = "CASE WHEN a.cur <> '' THEN list_append(a.done, a.cur) ELSE a.done END"


def sentences_sql(x: str) -> str:
    return f"CASE WHEN len(regexp_extract_all({x}, '{SENTENCES}')) > 0 THEN regexp_extract_all({x}, '{SENTENCES}') ELSE [{x}] END"


def pack_sql(x: str) -> str:
    found = f"list_filter(list_transform({sentences_sql(x)}, lambda t: {strip_sql('t')}), lambda t: t <> '')"
    slices = f"list_transform(range(CAST((len(x.cur) - 1) // 1000 + 1 AS BIGINT)), lambda k: {strip_sql('substr(x.cur, CAST(k AS BIGINT) * 1000 + 1, 1000)')})"
    fold = f"""list_reduce({_items(found)}, lambda a, x: CASE
        WHEN len(x.cur) > 1000 THEN {{'done': list_concat({_FLUSH}, {slices}), 'cur': ''}}
        WHEN a.cur <> '' AND len(a.cur) + 1 + len(x.cur) > 1000 THEN {{'done': {_FLUSH}, 'cur': x.cur}}
        ELSE {{'done': a.done, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END}} END)"""
    return f"list_transform([{fold}], lambda a: list_filter({_FLUSH}, lambda s: s <> ''))[1]"


#: All chunks of documents, before short ones and short documents are dropped: (doc_id, chunks).
CHUNKS = rf"""
clean AS (SELECT doc_id, {normalize_sql('text')} AS c FROM documents),
segments AS (SELECT doc_id, flatten(list_transform(list_filter(list_transform(regexp_split_to_array(c, '\n{{2,}}'), lambda s: {strip_sql('s')}), lambda s: s <> ''),
    lambda s: CASE WHEN len(s) > 1000 THEN {pack_sql('s')} ELSE [s] END)) AS segs FROM clean),
folded AS (SELECT doc_id, list_reduce({_items('segs')}, lambda a, x: CASE
        WHEN a.cur <> '' AND len(a.cur) + 2 + len(x.cur) > 1000 THEN {{'done': {_FLUSH}, 'cur': x.cur}}
        ELSE {{'done': a.done, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || chr(10) || chr(10) || x.cur END}} END) AS a FROM segments),
chunked AS (SELECT doc_id, list_filter({_FLUSH}, lambda s: s <> '') AS chunks FROM folded)
"""
#: Kept chunks with their ordinal and words: (doc_id, chunk_index, chunk_text, words).
KEPT = f"""{CHUNKS},
listed AS (SELECT doc_id, list_filter(chunks, lambda c: {count_sql('c')} > 4) AS chunks FROM chunked JOIN documents USING (doc_id) WHERE {count_sql('text')} >= 20),
chunk AS (SELECT doc_id, CAST(generate_subscripts(chunks, 1) AS INTEGER) AS chunk_index, unnest(chunks) AS chunk_text FROM listed),
kept AS (SELECT *, CAST({count_sql('chunk_text')} AS INTEGER) AS words FROM chunk)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def kept_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents."""
    return chunking.chunk_documents(chunking.spread(documents(spark, sf_dir).select("doc_id", "text"), "doc_id"))


def _scalar(name: str, column, sql: str):
    @R.add(name, f"SELECT doc_id, {sql} AS value FROM documents")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).select("doc_id", column().alias("value"))


_scalar("normalize_text", lambda: F.md5(T.normalize_text("text").cast("binary")), f"md5({normalize_sql('text')})")
_scalar("normalize_extracted", lambda: F.md5(T.normalize_extracted("text").cast("binary")), f"md5({extracted_sql('text')})")
_scalar("line_key", lambda: F.md5(T.line_key("text").cast("binary")), f"md5(lower({compact_sql('text')}))")
_scalar("compact_text", lambda: F.md5(T.compact("text").cast("binary")), f"md5({compact_sql('text')})")
_scalar("truncate_text", lambda: T.truncate_text("text", 200), f"CASE WHEN len({compact_sql('text')}) > 200 THEN {strip_sql('substr(' + compact_sql('text') + ', 1, 199)')} || '…' ELSE {compact_sql('text')} END")
_scalar("truncate_preview", lambda: T.truncate_preview("text", 300), r"CASE WHEN len(text) > 300 THEN regexp_replace(substr(text, 1, 299), '\s+$', '') || '…' ELSE text END")
_scalar("count_words", lambda: T.count_words("text").cast("long"), f"CAST({count_sql('text')} AS BIGINT)")
_scalar("tokenize", lambda: F.array_join(T.tokenize("text"), " "), f"array_to_string({tokens_sql('text')}, ' ')")
_scalar("distinct_tokens", lambda: F.array_join(T.distinct_tokens("text"), " "), f"array_to_string(list_sort(list_distinct({tokens_sql('text')})), ' ')")
_scalar("split_sentences", lambda: F.array_join(T.split_sentences("text"), "|"), f"array_to_string({sentences_sql('text')}, '|')")
_scalar("doc_min_words", lambda: F.when(T.count_words("text") >= T.MIN_DOCUMENT_WORDS, "ready").otherwise("needsReview"), f"CASE WHEN {count_sql('text')} >= 20 THEN 'ready' ELSE 'needsReview' END")
_scalar("norm_source_match", lambda: F.md5(T.source_match_text("text").cast("binary")), rf"md5({strip_sql(r'regexp_replace(lower(text), ' + chr(39) + r'[^\p{L}\p{N}]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')})")
_scalar("repair_hyphens", lambda: F.md5(T.repair_hyphens("text").cast("binary")), r"md5(regexp_replace(text, '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g'))")


@R.add("pack_sentences", f"SELECT doc_id, array_to_string({pack_sql('text')}, '|') AS packed FROM documents")
def pack_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.pack_sentences("text"), "|").alias("packed"))


@R.add("chunk_text", f"WITH {CHUNKS} SELECT doc_id, CAST(len(chunks) AS INTEGER) AS n_chunks, array_to_string(chunks, '|') AS chunks FROM chunked")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = T.chunk_text("text")
    return documents(spark, sf_dir).select("doc_id", chunks.alias("c")).select("doc_id", F.size("c").alias("n_chunks"), F.array_join("c", "|").alias("chunks"))


@R.add("chunk_min_words", f"WITH {KEPT} SELECT doc_id, chunk_index, words FROM kept")
def chunk_min_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_chunks(spark, sf_dir).select("doc_id", "chunk_index", "words")


@R.add("chunk_index", f"WITH {KEPT} SELECT doc_id, chunk_index, chunk_text FROM kept")
def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_chunks(spark, sf_dir).select("doc_id", "chunk_index", "chunk_text")


@R.add("batch_ids", f"WITH {KEPT}, first AS (SELECT min(doc_id) AS f FROM kept) SELECT doc_id, chunk_index, CAST(CASE WHEN doc_id = f THEN ceil((chunk_index - 1) / 3) ELSE ceil(chunk_index / 3) END AS BIGINT) AS batch_id FROM kept, first")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = kept_chunks(spark, sf_dir).select("doc_id", "chunk_index")
    first = chunks.agg(F.min("doc_id").alias("first"))
    return chunks.crossJoin(F.broadcast(first)).select("doc_id", "chunk_index", chunking.batch_ids(F.col("chunk_index"), F.col("doc_id") == F.col("first"), 3).alias("batch_id"))


@R.add(
    "chunk_offsets",
    f"""WITH {CHUNKS}, placed AS (SELECT doc_id, c, chunks, list_reduce(list_prepend({{'at': 0, 's': []::INTEGER[], 'e': []::INTEGER[], 't': ''}}, list_transform(chunks, lambda t: {{'at': 0, 's': []::INTEGER[], 'e': []::INTEGER[], 't': t}})),
        lambda a, x: {{'at': CAST(least(len(c), a.at + coalesce(nullif(strpos(substr(c, a.at + 1), substr(x.t, 1, 80)), 0) - 1, 0) + len(x.t)) AS INTEGER),
            's': list_append(a.s, CAST(a.at + coalesce(nullif(strpos(substr(c, a.at + 1), substr(x.t, 1, 80)), 0) - 1, 0) AS INTEGER)),
            'e': list_append(a.e, CAST(least(len(c), a.at + coalesce(nullif(strpos(substr(c, a.at + 1), substr(x.t, 1, 80)), 0) - 1, 0) + len(x.t)) AS INTEGER)), 't': ''}}) AS a FROM chunked JOIN clean USING (doc_id)),
    each AS (SELECT doc_id, unnest(chunks) AS t, unnest(a.s) AS start_offset, unnest(a.e) AS end_offset, generate_subscripts(chunks, 1) AS k FROM placed)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS chunk_index, start_offset, end_offset FROM each WHERE {count_sql('t')} > 4""",
)
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_offsets(documents(spark, sf_dir))


_LINES = "lines AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


@R.add("is_list_line", rf"WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, regexp_matches(line, '^\s*(?:[-*•▪]|\d+[.)])\s+') AS flag FROM lines")
def is_list_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.lines("text")).alias("pos", "line")).select("doc_id", "pos", T.is_list_line("line").alias("flag"))


_HEADINGS = "[" + ", ".join(f"'{w}'" for w in T.HEADING_WORDS) + "]"
HEADING_SQL = rf"""(len(l) > 0 AND len(l) <= 90 AND NOT regexp_matches(l, '^\s*(?:[-*•▪]|\d+[.)])\s+') AND NOT regexp_matches(l, '[.,;:]$') AND len(regexp_split_to_array(l, '\s+')) <= 10
    AND ((len(regexp_replace(l, '\P{{L}}', '', 'g')) > 0 AND upper(l) = l AND lower(regexp_replace(l, '\P{{L}}', '', 'g')) <> regexp_replace(l, '\P{{L}}', '', 'g')) OR regexp_matches(l, '(?i)^(?:chapter|section)\s+\d+')
    OR len(list_filter(list_transform(regexp_split_to_array(l, '\s+'), lambda w: regexp_replace(w, '[^A-Za-z0-9]', '', 'g')), lambda w: w <> '' AND (list_contains({_HEADINGS}, lower(w)) OR regexp_matches(w, '^[A-Z]')))) >= 0.75 * len(regexp_split_to_array(l, '\s+'))))"""


@R.add("is_heading", rf"WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, coalesce({HEADING_SQL}, false) AS flag FROM (SELECT *, {strip_sql('line')} AS l FROM lines)")
def is_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.lines("text")).alias("pos", "line")).select("doc_id", "pos", T.is_heading("line").alias("flag"))


def paragraphs_sql(table: str) -> str:
    """Common table expressions from a table (doc_id, text) to ``paragraphed`` (doc_id, value)."""
    return rf"""pl AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {table})),
    ps AS (SELECT doc_id, pos, {strip_sql('line')} AS l FROM pl),
    k AS (SELECT *, l = '' AS blank, regexp_matches(l, '^\s*(?:[-*•▪]|\d+[.)])\s+') OR coalesce({HEADING_SQL}, false) AS alone FROM ps),
    b AS (SELECT *, CASE WHEN blank OR alone OR coalesce(lag(blank OR alone) OVER (PARTITION BY doc_id ORDER BY pos), true) THEN 1 ELSE 0 END AS cut FROM k),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM b),
    p AS (SELECT doc_id, grp, string_agg(l, ' ' ORDER BY pos) AS para FROM g WHERE NOT blank GROUP BY ALL),
    paragraphed AS (SELECT doc_id, coalesce(string_agg(para, chr(10) || chr(10) ORDER BY grp) FILTER (WHERE para IS NOT NULL), '') AS value FROM {table} LEFT JOIN p USING (doc_id) GROUP BY doc_id)"""


@R.add("paragraphize", f"WITH {paragraphs_sql('documents')} SELECT doc_id, md5(value) AS value FROM paragraphed")
def paragraphize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(cleaning.paragraphs("text").cast("binary")).alias("value"))


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of their source."""
    return chunking.spread(documents(spark, sf_dir).select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), "text"), "page")


_EDGE = rf"""{_LINES}, s AS (SELECT doc_id, pos, {strip_sql('line')} AS l FROM lines),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS z FROM s WHERE l <> ''),
edges AS (SELECT DISTINCT source AS document_id, doc_id AS page, l AS line FROM n JOIN documents USING (doc_id) WHERE a <= 3 OR z <= 3)"""
_REPEATED = rf"""{_EDGE}, counted AS (SELECT document_id, lower(regexp_replace(line, '\s+', ' ', 'g')) AS key, count(*) AS n FROM edges GROUP BY ALL),
sizes AS (SELECT source AS document_id, count(*) AS pages FROM documents GROUP BY ALL)"""


@R.add("edge_lines", f"WITH {_EDGE} SELECT document_id, page, line FROM edges")
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.edge_lines(source_pages(spark, sf_dir))


@R.add("edge_key_len", rf"WITH {_EDGE} SELECT document_id, page, lower(regexp_replace(line, '\s+', ' ', 'g')) AS key FROM edges WHERE len(lower(regexp_replace(line, '\s+', ' ', 'g'))) BETWEEN 4 AND 140")
def edge_key_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.edge_lines(source_pages(spark, sf_dir)).select("document_id", "page", T.line_key("line").alias("key")).where(F.length("key").between(4, 140))


@R.add("repeated_edge_lines", f"WITH {_REPEATED} SELECT document_id, key, n FROM counted JOIN sizes USING (document_id) WHERE len(key) BETWEEN 4 AND 140 AND pages >= 2 AND n >= greatest(2, round_even(pages * 0.02, 0))")
def repeated_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.repeated_edge_lines(source_pages(spark, sf_dir), share=0.02)


@R.add(
    "remove_repeated_edges",
    rf"""WITH {_REPEATED}, keys AS (SELECT document_id, list(key) AS keys FROM counted JOIN sizes USING (document_id) WHERE len(key) BETWEEN 4 AND 140 AND pages >= 2 AND n >= greatest(2, round_even(pages * 0.02, 0)) GROUP BY ALL)
    SELECT doc_id, CAST(len(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(keys, []), lower({compact_sql('x')}))), chr(10))) AS INTEGER) AS n_chars
    FROM documents LEFT JOIN keys ON document_id = source""",
)
def remove_repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = source_pages(spark, sf_dir)
    keys = cleaning.repeated_edge_lines(pages, share=0.02).groupBy("document_id").agg(F.collect_set("key").alias("keys"))
    kept = cleaning.remove_lines("text", F.coalesce("keys", F.array().cast("array<string>")))
    return pages.join(F.broadcast(keys), "document_id", "left").select(F.col("page").alias("doc_id"), F.length(kept).alias("n_chars"))


@R.add(
    "clean_page",
    rf"""WITH {_REPEATED}, own AS (SELECT document_id, list(key) AS keys FROM counted JOIN sizes USING (document_id) WHERE len(key) BETWEEN 4 AND 140 AND pages >= 2 AND n >= greatest(2, round_even(pages * 0.6, 0)) GROUP BY ALL),
    base AS (SELECT source, doc_id, {extracted_sql('text')} AS t FROM documents),
    cut AS (SELECT doc_id, CASE WHEN keys IS NULL THEN t ELSE array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT list_contains(keys, lower({compact_sql('x')}))), chr(10)) END AS t FROM base LEFT JOIN own ON document_id = source),
    whole AS (SELECT doc_id, regexp_replace(t, '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g') AS text FROM cut), {paragraphs_sql('whole')},
    clean AS (SELECT doc_id, {extracted_sql('value')} AS text FROM paragraphed)
    SELECT source AS document_id, doc_id AS page, clean.text FROM clean JOIN documents USING (doc_id) WHERE clean.text <> ''""",
)
def clean_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_pages(source_pages(spark, sf_dir), "course")


@R.add("chunk_pages")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_pages(cleaning.clean_pages(source_pages(spark, sf_dir), "course"))


def html_sql(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for name, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{by}')"
    return compact_sql(x)


@R.add("html_strip", f"SELECT page_id, md5({html_sql('html')}) AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_text("html").cast("binary")).alias("text"))


@R.add("first_paragraph", f"SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: {html_sql('p')}), lambda t: t <> '')[1] AS text FROM pages")
def first_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.first_paragraph("html").alias("text"))


@R.add("match_tokens_all", rf"SELECT page_id, len(list_filter(['the', 'com'], lambda t: NOT contains({strip_sql(chr(114)+'egexp_replace(lower(url), ' + chr(39) + '[^a-z0-9]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, t))) = 0 AS hit FROM pages")
def match_tokens_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.match_all_tokens(F.lit("the x com"), "url").alias("hit"))
