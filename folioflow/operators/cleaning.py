"""Page cleaning over DataFrames of (document_id, page, text).

Repeated edge lines are found with two aggregations (no window over a document's lines), and
the small set of them meets the pages by a join on the document; everything else is row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T

# The rules in the order in which they apply, and the profiles that select them.
RULES = ["normalize_text", "remove_repeated_edges", "repair_hyphenated_breaks", "merge_wrapped_lines", "detect_article_section_headers", "detect_chapter_section_headers"]
PROFILES = {
    "course": ["normalize_text", "remove_repeated_edges", "repair_hyphenated_breaks", "merge_wrapped_lines", "detect_chapter_section_headers"],
    "article": ["normalize_text", "remove_repeated_edges", "repair_hyphenated_breaks", "merge_wrapped_lines", "detect_article_section_headers"],
    "minimal": ["normalize_text"],
}
DEFAULT_PROFILE = "course"
EDGE = 3
SHARE = 0.6


def resolve_rules(profile: str | None = None, rules: list[str] | str | None = None) -> list[str]:
    """The known rules of a selection, or of the profile, in their order; normalising is always among them."""
    name = (profile or DEFAULT_PROFILE).strip()
    chosen = PROFILES.get(name, PROFILES[DEFAULT_PROFILE]) if rules is None else [rules] if isinstance(rules, str) else rules
    return [r for r in RULES if r in chosen or r == "normalize_text"]


def edge_lines(pages: DataFrame, edge: int = EDGE) -> DataFrame:
    """(document_id, page, line): the first and last non-blank lines of each page, each once."""
    found = F.filter(F.transform(T.lines("text"), T.strip), lambda x: x != "")
    ends = T.let(found, lambda f: F.array_distinct(F.concat(F.slice(f, 1, edge), F.slice(f, F.greatest(F.size(f) - edge + 1, F.lit(1)), F.lit(edge)))))
    return pages.select("document_id", "page", F.explode(ends).alias("line"))


def repeated_edge_lines(pages: DataFrame, edge: int = EDGE, share: float = SHARE) -> DataFrame:
    """(document_id, key, n): edge lines of at least max(2, share of pages) pages of a document of two or more."""
    keys = edge_lines(pages, edge).withColumn("key", T.line_key("line")).where(F.length("key").between(4, 140))
    counts = keys.groupBy("document_id", "key").agg(F.count("*").alias("n"))
    sizes = pages.groupBy("document_id").agg(F.count("*").alias("pages")).where("pages >= 2")
    return counts.join(sizes, "document_id").where(F.col("n") >= F.greatest(F.lit(2), F.bround(F.col("pages") * share).cast("int"))).select("document_id", "key", "n")


def remove_lines(text: Column | str, keys: Column) -> Column:
    """A text without the lines whose keys are in an array."""
    kept = F.filter(T.lines(text), lambda x: T.let(T.line_key(x), lambda k: (k == "") | ~F.array_contains(keys, k)))
    return F.array_join(kept, "\n")


def paragraphs(text: Column | str) -> Column:
    """Wrapped lines joined to paragraphs: blank lines end them, list and heading lines stand alone."""
    marked = F.transform(F.transform(T.lines(text), T.strip), lambda x: F.struct(x.alias("line"), (T.is_list_line(x) | T.is_heading(x)).alias("alone")))

    def led(items: Column) -> Column:
        """Each line led by what parts it from the one before: time grows with the text, not with its square."""

        def one(x: Column, k: Column) -> Column:
            before = F.get(items, k - 1)
            ends = (before["line"] == "") | before["alone"] | x["alone"]
            return F.when(x["line"] == "", "").when(F.coalesce(ends, F.lit(False)), F.concat(F.lit("\n\n"), x["line"])).when(k == 0, x["line"]).otherwise(F.concat(F.lit(" "), x["line"]))

        return F.array_join(F.transform(items, one), "")

    return F.regexp_replace(T.let(marked, led), r"\A\n\n", "")


def clean_pages(pages: DataFrame, profile: str | None = None, rules: list[str] | str | None = None) -> DataFrame:
    """Pages with their cleaned text; pages that end up empty go."""
    chosen = resolve_rules(profile, rules)
    out = pages.withColumn("raw", F.coalesce("text", F.lit(""))).withColumn("text", T.normalize_extracted("raw"))
    if "remove_repeated_edges" in chosen:
        keys = repeated_edge_lines(pages).groupBy("document_id").agg(F.collect_set("key").alias("keys"))
        out = out.join(keys, "document_id", "left").withColumn("text", F.when(F.col("keys").isNull(), F.col("text")).otherwise(remove_lines("text", F.col("keys")))).drop("keys")
    if "repair_hyphenated_breaks" in chosen:
        out = out.withColumn("text", T.repair_hyphens("text"))
    if "merge_wrapped_lines" in chosen:
        out = out.withColumn("text", paragraphs("text"))
    # exploded, not filtered: a filter on the cleaned text would clean every page twice
    clean = F.explode(F.filter(F.array(T.normalize_extracted("text")), lambda t: t != "")).alias("text")
    return out.select(*(clean if c == "text" else F.col(f"`{c}`") for c in out.columns if c != "raw"))
