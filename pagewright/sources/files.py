"""Tables from folders of files, and files from tables. All reading and writing is Spark's, so any store will do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import IMAGE_SUFFIXES


def _name(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """doc_id (the file's name without suffix), path, text, valid: whole files. `valid` tells whether the bytes are UTF-8;
    where they aren't, the text is null and the run goes on (see unread)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(_name(F.col("path")).alias("doc_id"), "path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))


def unread(texts: DataFrame) -> DataFrame:
    """doc_id, path, error of the files of read_texts that aren't UTF-8."""
    return texts.filter(~F.col("valid")).select("doc_id", "path", F.lit("Markdown could not be read as UTF-8").alias("error"))


def read_json_texts(spark: SparkSession, path: str, column: str = "state", pattern: str = "*.json") -> DataFrame:
    """doc_id and the whole file as `column`; whether it is JSON is for the rules to say."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select(_name(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias(column))


def list_assets(spark: SparkSession, root: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """path (below root) and length of image files; contents aren't read. With doc_ids(doc_id) root holds a
    folder for each document: doc_id, path (below that folder), length."""
    suffix = "*.{" + ",".join([*IMAGE_SUFFIXES, *(s.upper() for s in IMAGE_SUFFIXES)]) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(root).select("path", "length")
    base = root.split(":", 1)[-1].rstrip("/").lstrip("/")
    listed = found.select(F.regexp_replace(F.col("path"), "^.*" + "\\Q" + base + "\\E/", "").alias("path"), "length")
    if doc_ids is None:
        return listed
    # a path's first folder is the document that it belongs to
    owned = listed.select(F.substring_index("path", "/", 1).alias("doc_id"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), "length")
    return doc_ids.select("doc_id").join(owned, "doc_id")


def list_sources(spark: SparkSession, path: str, suffix: str = "pdf", only: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, path of source files in order of name, all or those named (with or without suffix)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path).select("path").withColumn("doc_id", _name(F.col("path")))
    kept = found.filter(F.col("doc_id").isin(*[o.removesuffix("." + suffix) for o in only])) if only else found
    return kept.select("doc_id", "path").orderBy("doc_id")


def layout_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, blocks array<struct<type, lines array<struct<spans array<struct<text, x0, y0, x1, y1>>>>>>) to the
    lines table of operators.layout: texts of spans joined, boxes united, empty lines left out."""
    from pagewright.functions.text import compact

    b = pages.select("doc_id", "page", F.posexplode("blocks").alias("block_index", "b")).filter(F.col("b.type") == 0)
    rows = b.select("doc_id", "page", "block_index", F.posexplode("b.lines").alias("line_index", "l")).filter(F.size("l.spans") > 0)
    box = {c: f(F.col(f"l.spans.{c}")) for c, f in (("x0", F.array_min), ("y0", F.array_min), ("x1", F.array_max), ("y1", F.array_max))}
    text = compact(F.array_join("l.spans.text", ""))
    out = rows.select("doc_id", "page", "block_index", "line_index", *[v.alias(k) for k, v in box.items()], text.alias("text")).filter("text <> '' AND x0 IS NOT NULL")
    return out.withColumn("ord", F.col("block_index") * 100_000 + F.col("line_index"))


def page_counts(lines: DataFrame) -> DataFrame:
    """doc_id, pages: the greatest page number of each document's lines; null pages don't count. Documents without lines have no row."""
    return lines.groupBy("doc_id").agg(F.max("page").alias("pages"))


def page_range(first, last):
    """The pages from first to last; null if they aren't in order."""
    return F.when(first <= last, F.sequence(first, last))


def page_list(spec, total):
    """Sorted distinct page numbers of a comma-separated list; null if one is no page."""
    pages = F.array_sort(F.array_distinct(F.transform(F.split(spec, ","), lambda x: F.trim(x).try_cast("int"))))
    return F.when(F.forall(pages, lambda p: p.isNotNull() & p.between(1, total)), pages)


def delete(plan: DataFrame, root: str) -> DataFrame:
    """Deletes the files root/doc_id/path of plan(doc_id, path); doc_id, path, error: what happened to each, null if it is gone.

    Tasks delete through pyarrow's filesystem of root, which all executors must see. What isn't there is gone already; a file
    that may not be deleted stays, and the others go on. Nothing happens before an action on the result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for t in batches:
            said = []
            for doc, path in zip(t.column("doc_id").to_pylist(), t.column("path").to_pylist(), strict=True):
                try:
                    store.delete_file(f"{base.rstrip('/')}/{doc}/{path}")
                    said.append(None)
                except FileNotFoundError:
                    said.append(None)
                except OSError as e:
                    said.append(str(e))
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("path"), pa.array(said, pa.string())], ["doc_id", "path", "error"])

    kind = plan.schema["doc_id"].dataType.simpleString()
    return plan.select("doc_id", "path").mapInArrow(run, f"doc_id {kind}, path string, error string")


def write_reports(json_rows: DataFrame, path: str) -> None:
    """A JSON line a document."""
    json_rows.select("json").write.mode("overwrite").text(path)


def append_trace(events: DataFrame, path: str) -> None:
    """Adds events in files by a hash of doc_id, so that a document's are together without a folder for each."""
    events.repartition("doc_id").sortWithinPartitions("doc_id").write.mode("append").json(path)


def write_state(states: DataFrame, path: str) -> None:
    """Replaces the states as a whole."""
    states.write.mode("overwrite").parquet(path)
