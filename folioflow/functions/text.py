"""Text functions as columns: cleaning, words, sentences, chunks, excerpts.

Every function takes and returns columns of built-in expressions, so it runs inside
generated code or as a higher-order function on the JVM. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_CHARS = 1000
MIN_CHUNK_WORDS = 4
MIN_DOCUMENT_WORDS = 20

# Words that queries and texts are compared without.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "does", "for", "from", "how", "i", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with"]

# Words that a heading may have in lower case.
HEADING_WORDS = ["a", "an", "and", "as", "for", "in", "of", "on", "or", "the", "to", "with"]

# Headings of articles that count without any mark.
ARTICLE_HEADINGS = ["abstract", "background", "biography", "career", "early life", "early life and education", "education", "external links", "history", "overview", "personal life", "political career", "political positions", "presidency of the house of representatives and disy", "public image", "references"]

# Patterns that define words, tokens, sentences and list lines.
WORD_PATTERN = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"
TOKEN_PATTERN = r"[a-z0-9]+(?:['-][a-z0-9]+)?"
SENTENCE_PATTERN = r"""[^.!?]+[.!?]+["')\]]?|[^.!?]+$"""
LIST_PATTERN = r"^\s*(?:[-*•▪]|\d+[.)])\s+"

# Characters that count as white space at the ends of a text.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column | str, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: inside lambdas and conditions an expression is otherwise computed anew at each mention."""
    return F.transform(F.array(_col(x)), use)[0]


def _sub(x: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(x, F.lit(pattern), F.lit(by))


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(_col(x), F.lit(SPACES))


def normalize_text(x: Column | str) -> Column:
    """No NUL, runs of blanks to one space (one tab stays), at most one empty line, no edges."""
    x = F.replace(_col(x), F.lit("\0"), F.lit(""))
    return strip(_sub(_sub(x, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def normalize_extracted(x: Column | str) -> Column:
    """normalize_text for extracted pages: line ends unified, every run of blanks to a space, lines trimmed at the right."""
    x = _sub(F.replace(_col(x), F.lit("\0"), F.lit("")), r"\r\n?", "\n")
    x = F.replace(_sub(x, r"[ \t]+", " "), F.lit(" \n"), F.lit("\n"))
    return strip(_sub(x, r"\n{3,}", "\n\n"))


def compact(x: Column | str) -> Column:
    """All white space to single spaces, none at the ends."""
    return strip(_sub(_col(x), r"(?U)\s+", " "))


def line_key(x: Column | str) -> Column:
    """What lines are compared by: compact and lower-case."""
    return F.lower(compact(x))


# What ends a line.
LINE_END = r"(?:\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029])"


def lines(x: Column | str) -> Column:
    """The lines of a text, whatever ends them; an end of line at its very end begins no other line."""
    return F.split(F.regexp_replace(_col(x), LINE_END + r"\z", ""), LINE_END)


def repair_hyphens(x: Column | str) -> Column:
    return _sub(_col(x), r"([A-Za-z])-\n([A-Za-z])", "$1$2")


def is_list_line(x: Column | str) -> Column:
    return _col(x).rlike(LIST_PATTERN)


def is_heading(x: Column | str) -> Column:
    """A short line that looks like a heading: numbered, in capitals, or mostly capitalised words."""

    def capitalised(parts: Column) -> Column:
        bare = F.transform(parts, lambda w: F.regexp_replace(w, "[^A-Za-z0-9]", ""))
        capital = F.filter(bare, lambda w: (w != "") & (F.lower(w).isin(HEADING_WORDS) | w.rlike("^[A-Z]")))
        return (F.size(parts) <= 10) & (F.size(capital) >= F.size(parts) * 0.75)

    def test(line: Column) -> Column:
        letters = F.regexp_replace(line, r"\P{L}", "")
        loud = (F.length(letters) > 0) & (F.upper(line) == line) & (F.lower(letters) != letters)
        numbered = line.rlike(r"(?i)^(?:chapter|section)\s+\d+")
        fits = (F.length(line) > 0) & (F.length(line) <= 90) & ~line.rlike("[.,;:]$") & ~is_list_line(line)
        parts = F.split(line, r"\s+")
        return fits & (let(parts, capitalised) | ((F.size(parts) <= 10) & (loud | numbered)))

    return F.coalesce(let(strip(x), test), F.lit(False))


def section_header(x: Column | str, article: bool | Column = False, chapter: bool | Column = False) -> Column:
    """The section heading that a line is, under the two rules; null if it is none."""
    article, chapter = (F.lit(r) if isinstance(r, bool) else r for r in (article, chapter))
    raw = strip(x)

    def bare(c: Column) -> Column:
        return _sub(strip(_sub(c, r"\s+", " ")), r"^[ =#\t]+|[ =#\t]+$", "")

    line = bare(_col(x))
    hashed, wiki = F.regexp_extract(raw, r"^#{1,6}\s+(.+?)\s*$", 1), F.regexp_extract(raw, r"^={2,6}\s*(.+?)\s*={2,6}$", 1)
    usable = (F.length(line) > 0) & (F.length(line) <= 120) & ~is_list_line(line)
    found = (
        F.when(article & (hashed != ""), bare(hashed))
        .when(article & (wiki != ""), bare(wiki))
        .when(article & line_key(line).isin(ARTICLE_HEADINGS), line)
        .when(chapter & line.rlike(r"(?i)^(?:chapter|section)\s+\d+\b(?:\s*[:.-]\s*\S.*)?$"), line)
        .when(chapter & line.rlike(r"^\d+(?:\.\d+)+\s+\S.{0,100}$"), line)
    )
    return F.when(usable, found)


def words(x: Column | str) -> Column:
    return F.regexp_extract_all(_col(x), F.lit(WORD_PATTERN), F.lit(0))


def count_words(x: Column | str) -> Column:
    return F.regexp_count(_col(x), F.lit(WORD_PATTERN))


def tokenize(x: Column | str) -> Column:
    """Lower-case tokens of two characters or more that are no stop words, in order."""
    found = F.regexp_extract_all(F.lower(_col(x)), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def distinct_tokens(x: Column | str) -> Column:
    return F.array_sort(F.array_distinct(tokenize(x)))


def split_sentences(x: Column | str) -> Column:
    x = _col(x)
    found = F.regexp_extract_all(x, F.lit(SENTENCE_PATTERN), F.lit(0))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(x)))


def _empty() -> Column:
    return F.array().cast("array<string>")


def _fold(items: Column, joint: str, limit: int, slices: bool) -> Column:
    """Greedy packing: items joined while they fit; with slices, longer ones are cut hard."""

    def add(acc: Column, item: Column) -> Column:
        done, cur = acc["done"], acc["cur"]
        flushed = F.when(cur != "", F.concat(done, F.array(cur))).otherwise(done)
        joined = F.when(cur == "", item).otherwise(F.concat(cur, F.lit(joint), item))
        fits = (cur == "") | (F.length(cur) + len(joint) + F.length(item) <= limit)
        packed = F.when(fits, F.struct(done.alias("done"), joined.alias("cur"))).otherwise(F.struct(flushed.alias("done"), item.alias("cur")))
        if not slices:
            return packed
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(item) - 1) / limit).cast("int")), lambda k: strip(F.substring(item, k * limit + 1, F.lit(limit))))
        return F.when(F.length(item) > limit, F.struct(F.concat(flushed, parts).alias("done"), F.lit("").alias("cur"))).otherwise(packed)

    start = F.struct(_empty().alias("done"), F.lit("").alias("cur"))
    return F.aggregate(items, start, add, lambda acc: F.filter(F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]), lambda s: s != ""))


def pack_sentences(x: Column | str, limit: int = CHUNK_CHARS) -> Column:
    """Sentences joined by a space up to the limit; a longer sentence is cut every ``limit`` characters."""
    found = F.filter(F.transform(split_sentences(x), strip), lambda s: s != "")
    return _fold(found, " ", limit, slices=True)


def segments(x: Column | str, limit: int = CHUNK_CHARS) -> Column:
    """Paragraphs of a normalised text, long ones packed by sentence."""
    parts = F.filter(F.transform(F.split(_col(x), r"\n{2,}"), strip), lambda s: s != "")
    return F.flatten(F.transform(parts, lambda s: F.when(F.length(s) > limit, pack_sentences(s, limit)).otherwise(F.array(s))))


def chunk_text(x: Column | str, limit: int = CHUNK_CHARS) -> Column:
    """Chunks of a raw text, before short ones are dropped."""
    return F.transform(_fold(segments(normalize_text(x), limit), "\n\n", limit, slices=False), strip)


def truncate_preview(x: Column | str, limit: int) -> Column:
    x = _col(x)
    return F.when(F.length(x) > limit, F.concat(_sub(F.substring(x, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(x)


def truncate_text(x: Column | str, limit: int) -> Column:
    return let(compact(x), lambda c: F.when(F.length(c) > limit, F.concat(strip(F.substring(c, 1, max(0, limit - 1))), F.lit("…"))).otherwise(c))


def find_all(text: Column | str, token: Column) -> Column:
    """The places (from 0, ascending, overlaps too) where a token starts: a split in front of each, and its running length."""
    text = _col(text)
    start = F.struct(F.array().cast("array<int>").alias("places"), F.lit(0).alias("at"))

    def add(acc: Column, piece: Column) -> Column:
        places = F.when((acc["at"] > 0) | text.startswith(token), F.concat(acc["places"], F.array(acc["at"]))).otherwise(acc["places"])
        return F.struct(places.alias("places"), (acc["at"] + F.length(piece)).alias("at"))

    pieces = F.split(text, F.concat(F.lit(r"(?=\Q"), token, F.lit(r"\E)")))
    return F.when(text.contains(token), F.aggregate(pieces, start, add, lambda acc: acc["places"])).otherwise(F.array().cast("array<int>"))


def excerpt(text: Column | str, tokens: Column, near: int = 260, around: int = 420) -> Column:
    """The stretch around the hit with most hits near it (the first such), compact, with dots where it is cut."""
    text = _col(text)

    def most(hits: Column) -> Column:
        return F.array_max(F.transform(hits, lambda h: F.struct(F.size(F.filter(hits, lambda o: F.abs(o - h) <= near)).alias("n"), (-h).alias("at"))))["at"]

    def cut(center: Column) -> Column:
        start, end = F.greatest(F.lit(0), center - around), F.least(F.length(text), center + around)
        body = compact(F.substring(text, start + 1, end - start))
        return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))

    hits = let(F.lower(text), lambda low: F.flatten(F.transform(tokens, lambda t: find_all(low, t))))
    return let(F.coalesce(-let(hits, most), F.lit(0)), cut)


def locator(page_start: Column, page_end: Column, chunk_index: Column) -> Column:
    start, end = F.nullif(page_start, F.lit(0)), F.nullif(page_end, F.lit(0))
    return F.when(end > start, F.format_string("Pages %d-%d", start, end)).when(start.isNotNull(), F.format_string("Page %d", start)).otherwise(F.format_string("Chunk %d", F.coalesce(chunk_index, F.lit(1))))


def source_title(material: Column, document: Column) -> Column:
    material = F.coalesce(F.nullif(material, F.lit("")), F.lit("Course material"))
    document = F.coalesce(F.nullif(document, F.lit("")), material)
    return F.when(material == document, material).otherwise(F.concat(material, F.lit(" / "), document))


def format_bytes(x: Column | str) -> Column:
    x = _col(x).cast("double")
    return F.when(x < 1 << 20, F.concat(F.greatest(F.lit(1), F.bround(x / 1024)).cast("long").cast("string"), F.lit(" KB"))).when(x < 1 << 30, F.format_string("%.1f MB", x / (1 << 20))).otherwise(F.format_string("%.2f GB", x / (1 << 30)))


# Entities by name.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
ENTITY_PATTERN = r"&(?:#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,9}|[a-zA-Z]+);"


def decode_entities(x: Column | str) -> Column:
    """Named and numeric entities as characters, each once; unknown names and numbers that are no character stay."""

    def character(entity: Column) -> Column:
        name = F.lower(F.regexp_replace(entity, "[&;]", ""))
        number = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 9)).cast("long")
        code = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        valid = number.between(0, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        out = F.when(valid, code)
        for known, by in ENTITIES.items():
            out = out.when(name == known, by)
        return out.otherwise(entity)

    def joined(text: Column) -> Column:
        parts, entities = F.split(text, ENTITY_PATTERN), F.regexp_extract_all(text, F.lit(ENTITY_PATTERN), F.lit(0))
        return F.array_join(F.zip_with(parts, entities, lambda p, e: F.when(e.isNull(), p).otherwise(F.concat(p, character(e)))), "")

    return let(_col(x), lambda text: F.when(text.contains("&"), joined(text)).otherwise(text))


def html_text(x: Column | str) -> Column:
    """Tags to spaces, entities decoded, compact."""
    return compact(decode_entities(_sub(_col(x), r"<[^>]*>", " ")))


def first_paragraph(x: Column | str) -> Column:
    """The text of the first <p> that has any."""
    found = F.regexp_extract_all(_col(x), F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    return F.get(F.filter(F.transform(found, html_text), lambda t: t != ""), F.lit(0))


def match_all_tokens(query: Column | str, text: Column | str) -> Column:
    """Every token of the query (two characters or more) occurs in the text or in the text without spaces."""
    clean = strip(_sub(F.lower(_col(text)), "[^a-z0-9]+", " "))
    tokens = F.filter(F.split(strip(_sub(F.lower(_col(query)), "[^a-z0-9]+", " ")), " "), lambda t: F.length(t) >= 2)
    return F.forall(tokens, lambda t: clean.contains(t) | F.replace(clean, F.lit(" "), F.lit("")).contains(t))


def source_match_text(x: Column | str) -> Column:
    return strip(_sub(F.lower(_col(x)), r"[^\p{L}\p{N}]+", " "))
