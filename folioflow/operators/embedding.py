"""Embeddings: vector arithmetic, deterministic hashed embedders, and the provider interface."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T

DIMENSIONS = 64


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column | str, least: float = 1e-12) -> Column:
    """A vector of unit length; zeros where the norm is at most ``least`` (as a query is embedded)."""
    scaled = lambda x, n: F.when(n <= least, F.transform(x, lambda _: F.lit(0.0))).otherwise(F.transform(x, lambda y: y.cast("double") / n))
    return T.let(v, lambda x: T.let(norm(x), lambda n: scaled(x, n)))


def normalize_rows(v: Column | str) -> Column:
    """A vector of unit length; a zero vector stays (as an index is built)."""
    return T.let(v, lambda x: T.let(norm(x), lambda n: F.transform(x, lambda y: y.cast("double") / F.when(n == 0, 1.0).otherwise(n))))


def hashed_embedding(text: Column | str, dimensions: int = DIMENSIONS) -> Column:
    """A bag of tokens hashed by md5 into ``dimensions`` counts, of unit length; JVM only."""
    places = F.transform(T.tokenize(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dimensions)).cast("int"))
    counts = T.let(places, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: (F.size(ps) - F.size(F.array_remove(ps, d))).cast("double")))
    return normalize(counts)


class Provider(Protocol):
    """What an embedding provider offers: a key that names its vectors, and vectors of texts."""

    key: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Tokens hashed by blake2b into 64 counts, of unit length: a provider without a model."""

    key = "hash:blake2b-64"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * DIMENSIONS
            for t in re.findall(T.TOKEN_PATTERN, text.lower()):
                if len(t) > 1 and t not in T.STOP_WORDS:
                    v[int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest()[:4], "little") % DIMENSIONS] += 1
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n > 1e-12 else v)
        return out


class HttpProvider:
    """Vectors from an OpenAI-style endpoint; inputs are cut to ``longest`` characters, a request holds one batch."""

    def __init__(self, base_url: str, model: str, api_key: str | None = None, longest: int = 8000, timeout: float = 45.0):
        self.url, self.model, self.api_key, self.longest, self.timeout = base_url.rstrip("/") + "/embeddings", model, api_key, longest, timeout
        self.key = "remote-openai:" + hashlib.sha256(f"{base_url}\0{model}".encode()).hexdigest()[:24]

    def embed(self, texts: list[str]) -> list[list[float]]:
        import json
        import urllib.request

        body = json.dumps({"model": self.model, "input": [t[: self.longest] for t in texts]}).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as got:
            return [row["embedding"] for row in json.loads(got.read())["data"]]


def embed_column(make: Callable[[], Provider]) -> Callable[[Column], Column]:
    """A column function of a provider; each task makes one and feeds it Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make()
        for texts in batches:
            yield pd.Series(provider.embed(texts.fillna("").tolist()))

    return run


def missing(chunks: DataFrame, embedded: DataFrame, on: list[str]) -> DataFrame:
    """Chunks whose signature has no vector yet: a null-safe anti join."""
    same = F.lit(True)
    for c in on:
        same = same & chunks[c].eqNullSafe(embedded[c])
    return chunks.join(embedded.select(*on).distinct(), same, "left_anti")
