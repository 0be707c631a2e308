"""Models as columns: roles, statuses, names from files, options, where a request goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import strip

# Engines, statuses that rule a model out, words that tell an embedder, endings of sequences.
ENGINES = ["python", "ollama", "remote"]
UNUSABLE = ["needsRuntime", "missing"]
EMBEDDER_WORDS = r"\b(embed|embedding|nomic|bge|minilm|e5)\b"
QUANT = r"(?i)(?:^|[-_. ])(q\d(?:[-_][a-z0-9]+)*|f16|fp16|bf16|int8|int4)(?:\.gguf)?$"
STOPS = ["</s>", "<|im_end|>", "<|eot_id|>"]
MISSING = r"(?i)file does not exist|model.*not found|not found|does not exist"
OPAQUE = ["llama-cpp:", "remote-openai:"]


def blank(x: Column) -> Column:
    return F.coalesce(strip(x), F.lit("")) == ""


def usable(engine: Column, role: Column, status: Column, wanted: str) -> Column:
    """Whether a model can be offered as a generator or an embedder."""
    ruled_out = (engine == "python") | F.coalesce(status.isin(UNUSABLE), F.lit(False))
    return F.coalesce(~ruled_out & F.coalesce(role, F.lit("generator")).isin(wanted, "both"), F.lit(False))


def inferred_role(name: Column, model: Column, family: Column) -> Column:
    label = F.lower(F.concat_ws(" ", name, F.coalesce(model, F.lit("")), F.coalesce(family, F.lit(""))))
    return F.when(label.rlike(EMBEDDER_WORDS), "embedder").otherwise("generator")


def quant_of(filename: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(filename, QUANT, 1), F.lit("")), F.lit("GGUF"))


def type_of(filename: Column) -> Column:
    low = F.lower(F.coalesce(filename, F.lit("")))
    return F.when(low.rlike("llama-?3"), "LLaMA3").when(low.contains("qwen"), "qwen2").when(low.contains("deepseek"), "deepseek").otherwise("GGUF")


def pull_key(base: Column, name: Column) -> Column:
    return F.concat(base, F.lit("::"), F.regexp_replace(F.lower(strip(name)), ":latest$", ""))


def is_missing_error(status: Column, detail: Column) -> Column:
    return F.coalesce((status == 404) | detail.rlike(MISSING), F.lit(False))


def engine_for(engine: Column) -> Column:
    """Where a chat request goes: a local or a remote service, or nowhere."""
    return F.when(engine == "ollama", "local").when(engine == "remote", "remote").otherwise("rejected")


def options(device: Column, gpu_layers: Column, min_p: Column) -> Column:
    """Layers on the GPU (none on a CPU), and min_p only where it is above 0."""
    return F.struct(F.when(device == "cpu", F.lit(0)).otherwise(gpu_layers.cast("int")).alias("gpu_layers"), F.when(min_p > 0, min_p).alias("min_p"))


def status_of_download(status: Column) -> Column:
    return F.when(status == "complete", "ready").when(status == "incomplete", "incomplete").when(status == "error", "downloadError").otherwise("downloading")


def status_of_pull(status: Column) -> Column:
    return F.when(status.isin("complete", "incomplete", "removed", "error"), status).otherwise("downloading")


def clamped_percent(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.coalesce(x, F.lit(0.0)) + 0.5))).cast("int")


def title_case(token: Column) -> Column:
    """A token of a model's name as it is shown: sizes in capitals, versions in lower case, else its first letter large."""
    return F.when(F.upper(token) == "BGE", "BGE").when(token.rlike(r"(?i)^\d+(?:\.\d+)?B$"), F.upper(token)).when(token.rlike(r"(?i)^v\d+(?:\.\d+)?$"), F.lower(token)).otherwise(F.concat(F.upper(F.substring(token, 1, 1)), F.substring(token, 2, 1 << 20)))


def embedder_name(label: Column) -> Column:
    """The first word of an embedding model's name; keys that name no model to a reader are hidden."""
    hidden = F.lit(False)
    for p in OPAQUE:
        hidden = hidden | F.coalesce(label.startswith(p), F.lit(False))
    token = F.get(F.filter(F.split(F.coalesce(label, F.lit("")), r"[-_\s:/.]+"), lambda x: x.rlike("(?i)[a-z0-9]")), F.lit(0))
    return F.when(~hidden & token.isNotNull(), title_case(token))


def embedder_label(title: Column, model: Column, name: Column) -> Column:
    """Collection-Embedder: the first words of both, or what there is of the embedder."""
    embedder = F.coalesce(embedder_name(model), embedder_name(name))
    clean = strip(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)\.(pdf|md|markdown|txt)$", ""), r"\s+", " "))
    first = F.nullif(F.get(F.split(clean, " "), F.lit(0)), F.lit(""))
    return F.when(embedder.isNull() | first.isNull(), embedder).otherwise(F.concat(first, F.lit("-"), embedder))
