"""Books that go on page by page: a keyed state for each book, and a trace to which every event is written once.

The state of a book (pages done, last page, section, status) lives in the query's state store and is saved with each
micro-batch's offsets; a page that comes again changes nothing. A batch writes its events to a folder of its own, and
a batch that is run again after a failure replaces that folder, so an event is there once however often a query stops.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

PAGE = "doc_id long, page int, total_pages int, reasons array<string>, section string"
EVENT = "doc_id long, step int, page int, done int, queued int, section string, status string"
#: The state store that keyed states of any shape need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Book(StatefulProcessor):
    """done, queued, section and status of a book, and which of its pages are done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page int", "queued boolean")
        self.book = handle.getValueState("book", "done int, queued int, section string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        done, queued, section = self.book.get() if self.book.exists() else (0, 0, None)
        events = []
        # a book's new pages of one batch, in order
        for r in pd.concat(list(rows)).sort_values("page", kind="stable").itertuples(index=False):
            if self.pages.containsKey((int(r.page),)):
                continue
            look = r.reasons is not None and len(r.reasons) > 0
            done, queued, section = done + 1, queued + look, r.section if isinstance(r.section, str) else section
            self.pages.updateValue((int(r.page),), (bool(look),))
            ended = done >= int(r.total_pages)
            events.append((key[0], done, int(r.page), done, queued, section, "in_progress" if not ended else "visual_review" if queued else "completed"))
        if events:
            self.book.update((done, queued, section))
        yield pd.DataFrame(events, columns=[c.split()[0] for c in EVENT.split(", ")]).astype({"section": object})

    def close(self) -> None:
        pass


def follow(spark: SparkSession, source: str, sink: str, checkpoint: str, files: int = 1_000) -> StreamingQuery:
    """Follows page files (PAGE, Parquet) as they appear in source; events (EVENT) go to a folder of sink for each batch, of at most
    so many files. Ends when all present files are done; started again with the same checkpoint it goes on from there.

    The session must use the RocksDB state store (ROCKSDB). Rows without doc_id or page are left out."""
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files).parquet(source).filter("doc_id IS NOT NULL AND page IS NOT NULL")
    events = pages.groupBy("doc_id").transformWithStateInPandas(Book(), EVENT, "Append", "none")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace(spark: SparkSession, sink: str) -> DataFrame:
    """doc_id, step, page, done, queued, section, status: all events so far."""
    return spark.read.schema(EVENT).parquet(sink)


def states(events: DataFrame) -> DataFrame:
    """doc_id, pages, last_page, queued, section, status: each book as its last event left it."""
    last = F.max_by(F.struct("page", "done", "queued", "section", "status"), "step").alias("e")
    d = events.groupBy("doc_id").agg(last)
    return d.select("doc_id", F.col("e.done").alias("pages"), F.col("e.page").alias("last_page"), F.col("e.queued").alias("queued"), F.col("e.section").alias("section"), F.col("e.status").alias("status"))


#: Which status may follow which: a book begins in progress, goes to review if pages are queued, and may begin anew.
LEGAL = {None: ("in_progress",), "in_progress": ("in_progress", "needs_review", "visual_review", "completed"), "needs_review": ("needs_review", "visual_review", "in_progress"), "visual_review": ("visual_review", "completed", "completed_with_review_items", "in_progress"), "completed": ("completed", "in_progress"), "completed_with_review_items": ("completed_with_review_items", "visual_review", "completed", "in_progress")}


def illegal_steps(events: DataFrame) -> DataFrame:
    """doc_id, step, before, status: the first step of each book's events(doc_id, step, status) whose status may not follow the one
    before. A status that is null or unknown may follow nothing, and nothing may follow it but a new beginning."""
    order = Window.partitionBy("doc_id").orderBy("step")
    d = events.select("doc_id", "step", "status", F.lag("status").over(order).alias("before"), F.row_number().over(order).alias("_n"))
    first = (F.col("_n") == 1) & (F.col("status") == "in_progress")
    legal = F.col("status").eqNullSafe("in_progress") & (F.col("_n") > 1)
    for before, after in LEGAL.items():
        if before is not None:
            legal = legal | ((F.col("before") == before) & F.col("status").isin(*after))
    bad = d.filter(~(F.coalesce(first, F.lit(False)) | F.coalesce(legal, F.lit(False))))
    return bad.groupBy("doc_id").agg(F.min(F.struct("step", "before", "status")).alias("s")).select("doc_id", "s.step", "s.before", "s.status")
