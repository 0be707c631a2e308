"""Conversation functions as columns: follow-ups, citations, suggestions, prompts, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import compact, let, strip, truncate_text

# Prompts that only make sense after another turn.
FOLLOW_UPS = [
    r"^(?:be\s+)?more\s+specific$",
    r"^(?:explain|elaborate|expand)(?:\s+(?:that|this|it|more))?$",
    r"^(?:tell me more|go deeper|more details|give(?: me)? more details|be precise|be clearer)$",
    r"^(?:why|how so|what do you mean)$",
    r"^what about\b",
]
POINTERS = r"\b(?:that|this|it|they|them|those|above|previous|same)\b"

# The patterns of citations that answers are stripped of, in order.
_LABEL = "(?:source|excerpt|passage|context|citation|evidence|reference)"
_BY = r"(?:according to|as (?:stated|noted|shown|reported) in|per|from)"
_ON = r"(?:according to|as (?:stated|noted|shown|reported) in|from|based on)\s+(?:this|the)\s+(?:excerpt|context|source|text)\s*,?\s*"
CITATIONS = [
    rf'(?i)^\s*["“][^"”]{{40,1000}}["”]\s*(?:so,\s*)?{_ON}',
    rf"(?i)^\s*{_BY}\s+(?:the\s+)?{_LABEL}\s+\d+\s*,?\s*",
    rf"(?i)^\s*(?:the\s+)?{_LABEL}\s+\d+\s+(?:states|says|notes|indicates|mentions|reports)\s+(?:that\s+)?",
    rf"(?i)^\s*(?:so,\s*)?{_ON}",
    rf"(?i)\s*[(\[](?:{_LABEL})\s+\d+[)\]]",
    rf"(?i)\b{_BY}\s+(?:the\s+)?{_LABEL}\s+\d+\s*,?\s*",
    rf"(?i)\b(?:so,\s*)?{_ON}",
    r"""(?i)\s*[^.!?]*(?:source numbers?|excerpt labels?|excerpts?\s+label(?:led|ed)|phrases like\s+["']?according to)[^.!?]*[.!?]""",
]


def is_follow_up(x: Column | str) -> Column:
    text = F.regexp_replace(F.lower(compact(x)), r"[?.!]+$", "")
    anchored = F.lit(False)
    for p in FOLLOW_UPS:
        anchored = anchored | text.rlike(p)
    return (text != "") & (anchored | ((F.size(F.split(text, r"\s+")) <= 6) & text.rlike(POINTERS)))


def retrieval_query(prompt: Column, question: Column, answer: Column, longest: int = 900) -> Column:
    """The prompt, led by the turn before where it follows up."""
    led = F.concat(F.lit("Previous question: "), compact(question), F.lit("\nPrevious answer: "), truncate_text(answer, longest), F.lit("\nFollow-up: "), compact(prompt))
    return F.when(is_follow_up(prompt) & question.isNotNull() & answer.isNotNull(), led).otherwise(compact(prompt))


def strip_citations(x: Column | str) -> Column:
    text = F.col(x) if isinstance(x, str) else x
    for p in CITATIONS:
        text = F.regexp_replace(text, F.lit(p), F.lit(""))
    return strip(F.regexp_replace(text, r"\s{2,}", " "))


def cited_number(x: Column | str, sources: Column) -> Column:
    """The first cited number that is one of the sources' (from 1); null if none is."""
    text = F.col(x) if isinstance(x, str) else x
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b{_LABEL}\s+(\d+)\b"), F.lit(1)), lambda n: F.expr("1") * n.cast("int"))
    return F.get(F.filter(found, lambda n: (n >= 1) & (n <= sources)), F.lit(0))


def move_to_front(items: Column, number: Column) -> Column:
    """The array with its number-th element first."""
    k = F.coalesce(number, F.lit(1))
    return F.when(F.size(items) == 0, items).otherwise(F.concat(F.slice(items, k, F.lit(1)), F.slice(items, F.lit(1), k - 1), F.slice(items, k + 1, F.greatest(F.size(items) - k, F.lit(0)))))


def source_key(*parts: Column) -> Column:
    """Parts as text joined by bars, nulls blank."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def conversation_title(x: Column | str, longest: int = 28) -> Column:
    return let(compact(x), lambda text: F.when(F.length(text) > longest, F.concat(strip(F.substring(text, 1, longest)), F.lit("..."))).when(text == "", "New Study Chat").otherwise(text))


def follow_up_count(mode: Column, n: Column) -> Column:
    """0 where suggestions are off, 2 up to two, else 4."""
    n = n.cast("double")
    return F.when(mode == "off", 0).when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 4).when(n <= 2, 2).otherwise(4)


def question_list(x: Column | str, limit: int = 4, longest: int = 180) -> Column:
    """Questions of a suggestion text: a JSON array's, else what ends in a question mark; bullets and repeats gone."""
    text = F.col(x) if isinstance(x, str) else x
    listed = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<string>")
    asked = F.regexp_extract_all(text, F.lit(r"([^?\n]*\?)"), F.lit(1))
    clean = F.transform(F.coalesce(listed, asked), lambda q: compact(F.regexp_replace(q, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.array_distinct(F.filter(clean, lambda q: q.endswith("?") & (F.length(q) <= longest))), 1, limit)
