"""Reports of documents as they arrive. Beyond the batch engine's scope: the same plan, run once for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagewright.plans.report import Inputs, report


def stream_reports(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Reads (doc_id, text) Parquet files as they appear in source and writes their reports to a folder of sink for each
    batch. A batch that is run again replaces its own folder, so reports are there once. Ends when all present files are done."""

    def write(docs: DataFrame, batch: int) -> None:
        report(Inputs(docs)).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    files = spark.readStream.schema("doc_id long, text string").parquet(source)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
