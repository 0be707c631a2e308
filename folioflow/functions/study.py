"""Prompts, suggestions, titles and search terms of a study session, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.names import without_marks
from folioflow.functions.text import compact, let, locator, normalize_text, strip

# What leads the sources of a prompt, with the library's own model and with a remote one.
CONTEXT_LOCAL = """Use the context below only when it is relevant to the question.
Answer directly. Do not quote the context before answering. Do not mention context labels.
If the context does not contain the answer, say that plainly.

### Context:
"""
CONTEXT_REMOTE = """Use the context below only when it is relevant to the question.
Answer directly. Do not quote the context before answering. Do not mention context labels, source labels, excerpt labels, locators, or page numbers.
If the context does not contain the answer, say that plainly.

### Context:
"""

# What the questions of a quiz turn to, one after the other.
QUIZ_AREAS = [
    "core definitions and central concepts",
    "important properties, theorems, conditions, or rules",
    "worked examples, procedures, or applications",
    "comparisons, contrasts, or relationships between concepts",
    "edge cases, limitations, common mistakes, or consequences",
]

# The wording of quiz prompts.
QUIZ_TASK = """Make it one short-answer question from the provided PDF excerpts.
Ask about one concrete course concept, theorem, definition, example, procedure, or relationship that the excerpts support.
Prefer questions that test understanding, such as why, how, explain, compare, apply, or what condition must hold.
Avoid broad book-overview questions such as "What is this book about?" or "What is this book on?"
Avoid trivial wording, document metadata, title pages, copyright or licensing text, tables of contents, prefaces, acknowledgments, author names, file names, and page-location facts unless they are central to the course content."""
QUIZ_ASKED = "Previous quiz questions to avoid repeating or paraphrasing:"
QUIZ_NONE_ASKED = "Previous quiz questions: none."
QUIZ_RULES = """Do not repeat or lightly rephrase a previous quiz question.
Do not answer the question.
Do not mention page numbers, page ranges, locators, source labels, excerpt labels, or where the answer appears.
Do not ask questions whose answer depends on knowing a page number or location.
Return only the question."""
QUIZ_GRADING = """You are running a short-answer study quiz.
Grade the student answer using only the provided PDF excerpts.
Be concise and specific.
Address the learner directly as "you". Do not say "the student".
Do not start with "Feedback:".
Use this structure exactly:
Good/Partial/Needs work. One concise sentence explaining the grade.
Expected answer:
- One concise answer.
Do not ask a new quiz question.
Do not mention page numbers, page ranges, locators, source labels, excerpt labels, or where the answer appears.
Refer to the concept directly instead of saying phrases like "as stated on page 36"."""

# Words that open a suggested question, and a quiz question.
SUGGESTED = r"\b(?:What|Where|How|Why|When|Who|Which|Whose|Whom)\b[^?]*\?"
QUIZZED = r"(?i)\b(?:What|Why|How|When|Where|Which|Who)\b[^?\n]*\?"

SOURCE = "collection string, path string, locator string, section string, text string"


def _labelled(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value, F.lit("\n"))).otherwise("")


def source_context(sources: Column, remote: bool = False) -> Column:
    """The sources (array of SOURCE structs) as a prompt's context; blank without sources. A remote model is not told locators."""

    def block(s: Column) -> Column:
        head = [F.lit("Collection: "), F.coalesce(F.nullif(s["collection"], F.lit("")), F.lit("Library")), F.lit("\nPath: "), F.coalesce(s["path"], F.lit("")), F.lit("\n")]
        place = [] if remote else [_labelled("Locator", strip(s["locator"]))]
        text = F.coalesce(s["text"], F.lit(""))
        return F.concat(*head, *place, _labelled("Section", s["section"] if remote else strip(s["section"])), F.lit("Text: "), text if remote else F.concat(normalize_text(text), F.lit("\n\n")))

    body = F.array_join(F.transform(sources, block), "\n" if remote else "")
    return F.when(F.size(sources) > 0, F.concat(F.lit(CONTEXT_REMOTE if remote else CONTEXT_LOCAL), body)).otherwise("")


def quiz_area(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, QUIZ_AREAS)), F.pmod(F.greatest(number - 1, F.lit(0)), F.lit(len(QUIZ_AREAS))) + 1)


def quiz_question_prompt(number: Column, total: Column, asked: Column) -> Column:
    """What a model is told to make the number-th question; ``asked`` are the questions before."""
    before = F.when(F.size(asked) > 0, F.concat(F.lit(QUIZ_ASKED + "\n"), F.array_join(F.transform(asked, lambda q, k: F.concat((k + 1).cast("string"), F.lit(". "), q)), "\n"))).otherwise(QUIZ_NONE_ASKED)
    return F.concat_ws("\n", F.format_string("Create quiz question %d of %d.", number, total), F.concat(F.lit("Focus on "), quiz_area(number), F.lit(".")), F.lit(QUIZ_TASK), before, F.lit(QUIZ_RULES))


def quiz_feedback_prompt(number: Column, total: Column, question: Column, answer: Column) -> Column:
    return F.concat(F.lit(QUIZ_GRADING), F.format_string("\n\nQuiz question %d of %d: ", number, total), question, F.lit("\nStudent answer: "), answer)


def quiz_question(x: Column | str) -> Column:
    """The question of a model's reply: its first line that ends in a question mark, else the first question in it; null if none."""
    text = F.col(x) if isinstance(x, str) else x

    def bare(line: Column) -> Column:
        line = strip(line)
        for mark in (r"^[-*•\s]+", r"^\d+[.)]\s*", r"(?i)^quiz question\s*\d*(?:\s*of\s*\d+)?\s*[:.-]\s*", r"(?i)^question\s*\d*\s*[:.-]\s*", r"""^["']|["']$"""):
            line = F.regexp_replace(line, mark, "")
        return strip(line)

    asked = F.get(F.filter(F.transform(F.split(text, "\n"), bare), lambda q: q.endswith("?")), F.lit(0))
    return compact(F.coalesce(asked, F.nullif(F.regexp_extract(text, QUIZZED, 0), F.lit(""))))


def suggestions(x: Column | str, limit: int = 4, longest: int = 180) -> Column:
    """Suggested questions of a reply: a JSON array's items, else every question in it; long ones cut, repeats (in any case) dropped."""
    text = without_marks(F.col(x) if isinstance(x, str) else x)

    def question(item: Column) -> Column:
        item = F.regexp_replace(item, r"^\s*(?:[-*•]+|\d+[\).\:-])\s*", "")
        asked = strip(F.regexp_extract(F.btrim(strip(item), F.lit(" \"'`")), SUGGESTED, 0))
        return F.when(F.length(asked) > longest, F.concat(F.rtrim(F.substring(asked, 1, longest - 3)), F.lit("..."))).otherwise(asked)

    def first_ones(found: Column) -> Column:
        return let(F.transform(found, F.lower), lambda low: F.filter(found, lambda q, k: (q != "") & (F.array_position(low, F.lower(q)) == k + 1)))

    listed = F.from_json(text, "array<string>")
    items = F.when(F.size(listed) > 0, listed).otherwise(F.regexp_extract_all(text, F.lit(SUGGESTED), F.lit(0)))
    return F.slice(let(F.transform(items, question), first_ones), 1, limit)


def follow_up_instruction(prompt: Column, count: Column) -> Column:
    """The instruction with its count filled in, or led by it."""
    led = F.concat(F.lit("Generate "), count.cast("string"), F.when(count == 1, " suggested follow-up question.\n").otherwise(" suggested follow-up questions.\n"), prompt)
    return F.when(prompt.contains("{count}"), F.replace(prompt, F.lit("{count}"), count.cast("string"))).otherwise(led)


def search_term(x: Column | str) -> Column:
    """What to look for in a document to find an excerpt: its first sentence of 24 characters or more, at most 120 of them."""
    bare = strip(F.regexp_replace(F.regexp_replace(F.col(x) if isinstance(x, str) else x, r"\s+", " "), r"^\.\.\.|\.\.\.$", ""))
    return let(bare, lambda b: strip(F.substring(F.coalesce(F.get(F.filter(F.split(b, r"(?<=[.!?])\s+"), lambda s: F.length(s) >= 24), F.lit(0)), b), 1, 120)))


def clean_title(x: Column | str) -> Column:
    return compact(F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), r"(?i)\.(pdf|md|markdown|txt)$", ""))


def list_lines(x: Column | str) -> Column:
    """Markdown whose inline bullets and numbers begin lines of their own."""
    text = F.regexp_replace(F.col(x) if isinstance(x, str) else x, "\r\n", "\n")
    for lead, mark in ((r"[.!?:;)]", r"[*-]"), (r"\*\*", r"[*-]"), (r"[.!?:;)]", r"\d+\.")):
        text = F.regexp_replace(text, rf"({lead})\s+({mark})\s+(?=\*\*|[A-Z0-9])", "$1\n$2 ")
    return strip(text)


def page_label(page_start: Column, page_end: Column, otherwise: Column) -> Column:
    """Pages of a source; its own locator where it has none."""
    return F.when(F.coalesce(page_start, F.lit(0)) != 0, locator(page_start, page_end, F.lit(None).cast("int"))).otherwise(otherwise)


def estimated_pages(start: Column, end: Column, total: Column, pages: Column) -> Column:
    """(first, last) page of a stretch of text, as if pages were equally long; null without pages or text."""

    def page(at: Column) -> Column:
        return (F.floor(at * pages / total) + 1).cast("int")

    first = F.least(pages, F.greatest(F.lit(1), page(start)))
    return F.when((pages > 0) & (total > 0), F.struct(first.alias("first"), F.least(pages, F.greatest(first, page(end))).alias("last")))


def unique_name(wanted: Column, taken: Column) -> Column:
    """The wanted name, or the first of "name (2)", "name (3)" ... that is not among the taken ones."""
    base = F.coalesce(F.nullif(strip(wanted), F.lit("")), F.lit("Course materials"))
    names = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda k: F.when(k == 1, base).otherwise(F.concat(base, F.lit(" ("), k.cast("string"), F.lit(")"))))
    return F.get(F.filter(names, lambda n: ~F.array_contains(taken, n)), F.lit(0))


def base_url(x: Column | str) -> Column:
    return F.regexp_replace(strip(x), "/+$", "")


def local_server_url(x: Column | str) -> Column:
    """A local model server's address without its API path; the usual one where none is given."""
    bare = base_url(F.regexp_replace(base_url(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))), "/api$", ""))
    return F.when(bare.isin("", "http://localhost:11434"), "http://127.0.0.1:11434").otherwise(bare)


def page_matches(items: DataFrame, query: str) -> DataFrame:
    """(document_id, page, item): pieces of page text (document_id, page, item, text) that a search marks.

    A page's pieces that contain the query; where none does, those that the query runs across
    in the page's joined text. One group is one page, so groups stay small.
    """
    sought = F.lit(" ".join(query.lower().split()))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("item", compact(F.lower("text")).alias("t")))), lambda p: p)
    pages = items.groupBy("document_id", "page").agg(pieces.alias("p"))
    own = F.filter("p", lambda p: p["t"].contains(sought))

    def placed(acc: Column, p: Column) -> Column:
        at = F.when(acc["at"] > 0, acc["at"] + 1).otherwise(0)
        return F.struct(F.concat(acc["done"], F.array(F.struct(p["item"].alias("item"), at.alias("s"), (at + F.length(p["t"])).alias("e")))).alias("done"), (at + F.length(p["t"])).alias("at"))

    def found(acc: Column, part: Column) -> Column:
        at = acc["at"] + F.length(part)
        return F.struct(F.concat(acc["done"], F.array(at)).alias("done"), (at + F.length(sought)).alias("at"))

    def across(shown: Column) -> Column:
        kind = shown_type
        spans = F.aggregate(shown, F.struct(F.array().cast(f"array<struct<item:{kind},s:int,e:int>>").alias("done"), F.lit(0).alias("at")), placed, lambda acc: acc["done"])
        parts = F.split(F.array_join(F.transform(shown, lambda p: p["t"]), " "), F.concat(F.lit(r"\Q"), sought, F.lit(r"\E")))
        starts = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("at")), found, lambda acc: acc["done"])
        return let(starts, lambda m: F.transform(F.filter(spans, lambda s: F.exists(m, lambda a: (s["s"] < a + F.length(sought)) & (s["e"] > a))), lambda s: s["item"]))

    shown_type = items.schema["item"].dataType.simpleString()
    marked = let(own, lambda o: F.when(F.size(o) > 0, F.transform(o, lambda p: p["item"])).otherwise(let(F.filter("p", lambda p: p["t"] != ""), across)))
    return pages.where(sought != "").select("document_id", "page", F.explode(marked).alias("item"))
