"""Names of models, files and folders, and what must not be shown, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import strip

# What marks an answer in a model's output, and what stands for a secret.
ANSWER_MARKS = ["<<<ANSWER>>>", "<<<END>>>"]
REDACTED = "[redacted]"


def without_marks(x: Column) -> Column:
    for mark in ANSWER_MARKS:
        x = F.replace(x, F.lit(mark), F.lit(""))
    return strip(x)


def redacted(x: Column, secret: Column, longest: int = 500) -> Column:
    """A message without a secret (a blank one hides nothing), at most ``longest`` characters."""
    return F.substring(F.when(F.coalesce(secret, F.lit("")) != "", F.replace(x, secret, F.lit(REDACTED))).otherwise(x), 1, longest)


def safe_filename(x: Column) -> Column:
    """Whether a name is one file's: not blank, without separators, no folder's."""
    return F.coalesce((strip(x) != "") & ~x.rlike(r"[/\\]") & ~x.isin(".", ".."), F.lit(False))


def file_type(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), "PDF").when(low.rlike(r"\.(md|markdown)$"), "Markdown").when(low.endswith(".txt"), "Text file").otherwise("Document")


def import_folder(path: Column, is_folder: Column) -> Column:
    """A folder is imported as it is, a file by the folder that holds it."""
    return F.when(is_folder, path).otherwise(F.coalesce(F.nullif(F.regexp_replace(path, "/[^/]*$", ""), F.lit("")), F.lit("/")))


def same_model(installed: Column, wanted: Column) -> Column:
    """Whether an installed model is the wanted one: equal without the tag "latest", or with some tag of it."""
    have, want = (F.regexp_replace(F.lower(strip(c)), ":latest$", "") for c in (installed, wanted))
    return (have == want) | have.startswith(F.concat(want, F.lit(":")))


def model_name(name: Column, remote: Column, path: Column) -> Column:
    """What a model is called: its name, else its remote name, else its file's, else "Local Model"."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    given = [F.nullif(strip(c), F.lit("")) for c in (name, remote, stem)]
    return F.coalesce(*given, F.lit("Local Model"))


def follow_up_budget(longest: Column, temperature: Column) -> Column:
    """(tokens, temperature) that suggestions are generated with."""
    return F.struct(F.least(longest, F.lit(160)).alias("tokens"), F.greatest(F.lit(0.2), F.least(F.lit(0.8), temperature)).alias("temperature"))
