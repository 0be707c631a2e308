"""Saved state, logs, sources and errors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import normalize_text, source_match_text, strip

# Phases of indexing, patterns of errors, what a log keeps of a source.
PHASES = ["chunking", "embedding", "saving", "complete", "error"]
REMOTE_PREFIX = r"(?i)^Error invoking remote method '[^']+': Error:\s*"
UNREACHABLE = r"(?i)fetch failed|failed to fetch|econnrefused|connection refused|connect.*11434"
NOT_RUNNING = "Ollama is not running yet."
LOGGED = ["title", "locator", "documentTitle", "collectionName", "sectionHeader", "path", "pageStart", "pageEnd", "score", "retrievalMode", "embeddingModel", "chunkEmbeddingModel", "excerpt"]
QUOTE = r"^\s*[\"“]([^\"”]{40,1000})[\"”]"


def quoted_source(text: Column, excerpts: Column) -> Column:
    """The number (from 1) of the first source whose excerpt holds what the text begins by quoting, or lies in it."""
    quoted = source_match_text(F.regexp_extract(text, QUOTE, 1))
    plain = F.transform(excerpts, source_match_text)
    found = F.get(F.filter(F.transform(plain, lambda x, k: F.when(x.contains(quoted) | F.contains(quoted, x), k + 1)), lambda k: k.isNotNull()), F.lit(0))
    return F.when(quoted != "", found)


def source_identity(*parts: Column) -> Column:
    """Parts as text joined by bars; blank ones are left out."""
    said = F.array(*(p.cast("string") for p in parts))
    return F.array_join(F.filter(said, lambda p: p.isNotNull() & (F.trim(p) != "")), "|")


def union_of_keys(used: Column, fresh: Column) -> Column:
    return F.array_union(used, fresh)


def carried(turns: Column, limit: int = 2) -> Column:
    """The first sources of the last turns (arrays of sources)."""
    return F.slice(F.flatten(F.transform(turns, lambda t: F.coalesce(t, F.array().cast("array<string>")))), 1, max(0, limit))


def phase(raw: Column) -> Column:
    return F.when(raw.isin(PHASES), raw).otherwise("parsing")


def phase_message(raw: Column, message: Column) -> Column:
    """What progress says, in the words of today's phases."""
    said = F.coalesce(F.nullif(message, F.lit("")), F.lit("Parsing"))
    return F.when(raw == "queued", "Parsing").when(raw == "extracting", F.regexp_replace(said, "^Reading", "Parsing")).otherwise(said)


def phase_percent(raw: Column, percent: Column) -> Column:
    least = F.when(raw == "queued", 1).otherwise(0)
    return F.greatest(least, F.least(F.lit(100), F.floor(F.coalesce(percent, F.lit(1.0)) + 0.5))).cast("int")


def readable_error(x: Column, fallback: str) -> Column:
    text = F.coalesce(F.nullif(strip(F.regexp_replace(x, REMOTE_PREFIX, "")), F.lit("")), F.lit(fallback))
    return F.when(text.rlike(UNREACHABLE), NOT_RUNNING).otherwise(text)


def iso_local(ts: Column, millis: bool = False) -> Column:
    """A timestamp of the session's zone with its offset, as +00:00 for UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSxxx" if millis else "yyyy-MM-dd'T'HH:mm:ssxxx")


def string_list(x: Column) -> Column:
    """The strings of a JSON array; anything else in it is left out, bad JSON is no list."""
    parts = F.try_variant_get(F.try_parse_json(x), "$", "array<variant>")
    strings = F.filter(parts, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(strings, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def grouped_number(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def first_filled(*parts: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(p) != "", p) for p in parts))


def page_number(x: Column) -> Column:
    """A positive page, rounded; else null."""
    n = x.try_cast("double")
    return F.when((n > 0) & (n < float("inf")), F.floor(n + 0.5).cast("int"))


def unrendered(messages: Column) -> Column:
    """Messages (role, content) as text where no template renders them, open for the answer."""
    said = F.transform(messages, lambda m: F.concat(m["role"], F.lit(":\n"), m["content"]))
    return F.concat(F.array_join(said, "\n\n"), F.lit("\n\nassistant:\n"))


def prompt_messages(system: Column, prompt: Column, context: Column) -> Column:
    """The messages (role, content) that a prompt makes: the system's if it is not blank, then the user's."""
    user = F.struct(F.lit("user").alias("role"), F.concat(context, normalize_text(prompt)).alias("content"))
    lead = F.struct(F.lit("system").alias("role"), strip(F.coalesce(system, F.lit(""))).alias("content"))
    return F.when(lead["content"] != "", F.array(lead, user)).otherwise(F.array(user))
