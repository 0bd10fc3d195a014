"""Main text of web pages by the recurrent block labeller."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.html_blocks import blocks
from pagewright.llm.html_model import Reader, label, trained

#: Characters of HTML whose blocks are in memory together (one page may be longer).
MOST_CHARS = 4_000_000


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each of (page_id, url, html): the blocks labelled as main text, joined by line ends."""
    model = pages.sparkSession.sparkContext.broadcast(trained())  # about 200 kB

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weights = Reader(), model.value
        for t in tables:
            texts, some, size = [], [], 0

            def flush(some: list, texts: list) -> None:
                for page, main in zip(some, label(weights, reader, some), strict=True):
                    texts.append("\n".join(b.text for b, m in zip(page, main, strict=True) if m))

            for page in t.column("html").to_pylist():
                some.append(blocks(page or ""))
                size += len(page or "")
                if size > MOST_CHARS:
                    flush(some, texts)
                    some, size = [], 0
            flush(some, texts)
            yield pa.RecordBatch.from_arrays([t.column("page_id"), t.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages. A null or empty html, or one without main text, gives an empty text; repeated rows repeat."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
