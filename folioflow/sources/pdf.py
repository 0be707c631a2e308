"""Pages of PDF files; needs a PDF library, which is looked for when pages are read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.files import ending

SCHEMA = "path string, page int, text string, page_count int"


def pages(files: DataFrame, page_limit: int | None = None) -> DataFrame:
    """(path, page, text, page_count) of PDF files (path, content); pages without text go, but count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pypdfium2

        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with pypdfium2.PdfDocument(content) as pdf:
                    for k in range(min(len(pdf), page_limit or len(pdf))):
                        if text := pdf[k].get_textpage().get_text_range():
                            out.append({"path": path, "page": k + 1, "text": text, "page_count": len(pdf)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("page_count", pa.int32())]))

    return files.where(ending("path") == ".pdf").select("path", "content").mapInArrow(run, SCHEMA)


def page_bytes(files: DataFrame) -> DataFrame:
    """(path, url): a file as a data URL."""
    return files.select("path", F.concat(F.lit("data:application/pdf;base64,"), F.base64("content")).alias("url"))
