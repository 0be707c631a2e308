"""Logs as lines: their end, their framing, their fields; vectors and model headers as bytes."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType

#: Characters at the end of a log that are shown.
TAIL = 512_000
# Bytes of a number of each type in a model file's header.
WIDTHS = {0: 1, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 1, 10: 8, 11: 8, 12: 8}
STRING, ARRAY = 8, 9


def tail(text: Column, most: int = TAIL) -> Column:
    """The end of a text that has more bytes than ``most``: so many characters."""
    return F.when(F.octet_length(text) > most, F.right(text, F.lit(most))).otherwise(text)


def frames(chunks: DataFrame, stream: str = "stream", pos: str = "pos", data: str = "data") -> DataFrame:
    """(stream, n, line): complete lines of a stream that arrives in pieces; the unended rest and what is no JSON object stay out."""
    whole = chunks.groupBy(stream).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, data))), lambda x: x[data]), "").alias("text"))
    lines = F.split("text", r"\r?\n")
    rows = whole.select(stream, F.posexplode(F.slice(lines, F.lit(1), F.size(lines) - 1)).alias("n", "line"))
    return rows.where((F.trim("line") != "") & F.try_parse_json("line").isNotNull())


@F.pandas_udf(ArrayType(FloatType()))
def vector_of(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a blob; null stays null."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(bytes(b), dtype="<f4"))


@F.pandas_udf(BinaryType())
def blob_of(vectors: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def header_string(data: bytes, key: str) -> str | None:
    """The string under a key in a model file's header; null if it has none or breaks off."""
    at = 0

    def take(form: str):
        nonlocal at
        size = struct.calcsize(form)
        (x,) = struct.unpack_from(form, data, at)
        at += size
        return x

    def text() -> str:
        nonlocal at
        n = take("<Q")
        if at + n > len(data):
            raise struct.error("the header breaks off")
        at += n
        return data[at - n : at].decode("utf-8", errors="replace")

    def skip(kind: int) -> None:
        nonlocal at
        if kind == STRING:
            text()
        elif kind == ARRAY:
            inner, n = take("<I"), take("<Q")
            if inner in WIDTHS:
                at += WIDTHS[inner] * n
            else:
                for _ in range(n):
                    skip(inner)
        elif kind in WIDTHS:
            at += WIDTHS[kind]
        else:
            raise struct.error("unknown type")

    try:
        if data[:4] != b"GGUF":
            return None
        at = 4
        take("<I")
        take("<Q")
        for _ in range(take("<Q")):
            name, kind = text(), take("<I")
            if name == key:
                return text() if kind == STRING else None
            skip(kind)
    except struct.error:
        pass
    return None


def header_strings(key: str):
    """A function of a column of file contents."""

    @F.pandas_udf(StringType())
    def found(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else header_string(bytes(c), key))

    return found


def numbered_log(lines: DataFrame, log: str = "log", pos: str = "pos", value: str = "value") -> DataFrame:
    """(log, id, event, raw) of the lines of logs: JSON objects by their event, others as they are; blank lines do not count."""
    rows = lines.where(F.trim(value) != "").withColumn("k", F.row_number().over(Window.partitionBy(log).orderBy(pos)) - 1)
    good = F.try_parse_json(value).isNotNull() & F.ltrim(value).startswith("{")
    event, time = F.get_json_object(value, "$.event"), F.get_json_object(value, "$.time")
    number = F.col("k").cast("string")
    return rows.select(
        log,
        F.when(good, F.concat_ws("-", number, F.coalesce(time, F.lit("")), F.coalesce(event, F.lit("event")))).otherwise(F.concat(number, F.lit("-raw"))).alias("id"),
        F.when(good, F.coalesce(event, F.lit("log_event"))).otherwise("raw_log_line").alias("event"),
        F.when(~good, F.trim(value)).alias("raw"),
    )
