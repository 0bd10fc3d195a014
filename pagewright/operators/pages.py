"""Checks of page markers: coverage, duplicates, gaps, printed numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page_lists(markers: DataFrame) -> DataFrame:
    """doc_id and the ordered lists of its pages and known printed pages."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "pdf_page", "printed_page")))
    d = markers.groupBy("doc_id").agg(listed.alias("_l"))
    return d.select("doc_id", F.col("_l.pdf_page").alias("pages"), F.array_compact(F.col("_l.printed_page")).alias("printed"), F.size("_l").alias("markers"))


def duplicate_pages(markers: DataFrame) -> DataFrame:
    return markers.groupBy("doc_id", "pdf_page").agg(F.count("*").alias("times")).filter("times > 1")


def coverage(lists: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, covered, gaps of documents with expected(doc_id, first_page, last_page)."""
    d = expected.join(lists, "doc_id", "left").withColumn("_want", F.sequence("first_page", "last_page"))
    pages = F.coalesce(F.col("pages"), F.array().cast("array<int>"))
    gaps = F.when(F.size(pages) > 0, F.array_sort(F.array_except("_want", pages)))
    return d.select("doc_id", (pages == F.col("_want")).alias("covered"), gaps.alias("gaps"))


def printed_breaks(markers: DataFrame) -> DataFrame:
    """doc_id, seq, previous, printed_page where known printed numbers don't go up by one."""
    previous = F.lag("printed_page").over(Window.partitionBy("doc_id").orderBy("seq"))
    known = markers.filter(F.col("printed_page").isNotNull()).withColumn("previous", previous)
    return known.filter(F.col("printed_page") != F.col("previous") + 1).select("doc_id", "seq", "previous", "printed_page")


def printed_range(lists: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, matches: whether the first and last known printed numbers are those of expected(doc_id, first_printed, last_printed)."""
    d = expected.join(lists, "doc_id", "left")
    same = (F.try_element_at("printed", F.lit(1)) == F.col("first_printed")) & (F.try_element_at("printed", F.lit(-1)) == F.col("last_printed"))
    return d.select("doc_id", F.coalesce(same, F.lit(False)).alias("matches"))
