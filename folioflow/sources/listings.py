"""Listings of models: cards of a library's HTML, and JSON lists of remote services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.settings import sorted_models
from folioflow.functions.text import compact, first_paragraph, html_text

# The attributes that mark the parts of a card, and the site that its links start from.
CARD, TITLE, OLD_TITLE = "x-test-model", "x-test-search-response-title", "x-test-model-title"
CAPABILITY, SIZE, PULLS, TAGS, UPDATED = "x-test-capability", "x-test-size", "x-test-pull-count", "x-test-tag-count", "x-test-updated"
SITE = "https://ollama.com"


def marked_texts(html: Column, attribute: str) -> Column:
    """The texts, blank ones left out, of elements that carry an attribute."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<[^>]*\b{attribute}\b[^>]*>(.*?)</[^>]+>"), F.lit(1))
    return F.filter(F.transform(found, html_text), lambda t: t != "")


def marked_text(html: Column, attribute: str) -> Column:
    found = F.regexp_extract(html, rf"(?is)<[^>]*\b{attribute}\b[^>]*>(.*?)</[^>]+>", 1)
    return F.nullif(html_text(found), F.lit(""))


def absolute(href: Column, site: str = SITE) -> Column:
    """A link as it is if it has a scheme, else below the site; without one the library's own page."""
    return F.when(href == "", f"{site}/library").when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).otherwise(F.concat(F.lit(site + "/"), F.regexp_replace(href, "^/+", "")))


def count_of(x: Column) -> Column:
    """The whole number that a text begins with, commas left out."""
    return F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int")


def searched(cards: DataFrame, query: str, limit: int = 20, name: str = "name") -> DataFrame:
    """Cards that have every word of the query in their names, at least one of them and at most ``limit``; a blank query finds none."""
    words = query.lower().split()
    hit = F.lit(bool(words))
    for w in words:
        hit = hit & F.lower(name).contains(w)
    return cards.where(hit).orderBy(name).limit(max(1, limit))


def library_cards(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Cards of models on each page: (key, pos, name, description, url, capabilities, sizes, pulls, tag_count, updated), the first of each name."""
    cards = F.regexp_extract_all(html, F.lit(rf"(?is)<li\b[^>]*\b{CARD}\b[^>]*>(.*?)</li>"), F.lit(1))
    rows = pages.select(key, F.posexplode(cards).alias("pos", "card"))
    card = F.col("card")
    quoted = compact(html_text(F.regexp_extract(card, rf"""(?i)<[^>]*\b{OLD_TITLE}\b[^>]*\btitle=["']([^"']+)["'][^>]*>""", 1)))
    href = F.regexp_extract(card, r"""(?i)<a\b[^>]*href=["']([^"']+)["'][^>]*>""", 1)
    url = absolute(href)
    tags = count_of(marked_text(card, TAGS))
    rows = rows.select(
        key,
        "pos",
        F.coalesce(marked_text(card, TITLE), F.nullif(quoted, F.lit("")), marked_text(card, OLD_TITLE)).alias("name"),
        F.coalesce(first_paragraph(card), F.lit("")).alias("description"),
        url.alias("url"),
        marked_texts(card, CAPABILITY).alias("capabilities"),
        marked_texts(card, SIZE).alias("sizes"),
        marked_text(card, PULLS).alias("pulls"),
        tags.alias("tag_count"),
        marked_text(card, UPDATED).alias("updated"),
    ).where("name is not null")
    turn = F.row_number().over(Window.partitionBy(key, F.lower("name")).orderBy("pos"))
    return rows.withColumn("turn", turn).where("turn = 1").drop("turn")


def remote_models(payloads: DataFrame, native: bool = False, method: str = "generateContent") -> DataFrame:
    """(id, pos) of a service's JSON list in a column ``payload``; a native list names the methods that its models support."""
    if native:
        listed = F.from_json("payload", "models array<struct<name:string,supportedGenerationMethods:array<string>>>")["models"]
        ids = F.transform(F.filter(listed, lambda m: F.array_contains(m["supportedGenerationMethods"], method)), lambda m: F.regexp_replace(F.trim(m["name"]), "^models/", ""))
    else:
        ids = F.transform(F.from_json("payload", "data array<struct<id:string>>")["data"], lambda m: F.trim(m["id"]))
    return sorted_models(payloads.select(F.explode(ids).alias("id")).where("id != ''"), "gemini-" if native else "gpt-")
