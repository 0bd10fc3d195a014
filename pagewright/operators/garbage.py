"""Traces of broken text extraction: replacement and private-use characters, letters of scripts that don't belong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T

#: Unexpected letters so near each other make a cluster; so many are shown.
NEAR, SHOWN = 24, 8


def letter_positions(docs: DataFrame) -> DataFrame:
    """doc_id, seq, start, letter of unexpected letters."""
    found = T.find(docs, ["doc_id"], "text", "(" + T.unexpected_letters() + ")", {"letter": 1})
    return found.select("doc_id", "seq", "start", "letter")


def clusters(letters: DataFrame) -> DataFrame:
    """doc_id, examples for documents where two letters in a row stand at most NEAR characters apart."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    d = letters.withColumn("_gap", F.col("start") - F.lag("start").over(order))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("seq") < SHOWN, F.struct("seq", "letter")))), lambda x: x["letter"]), "")
    return d.groupBy("doc_id").agg(F.bool_or(F.col("_gap") <= NEAR).alias("_near"), shown.alias("examples")).filter("_near").select("doc_id", "examples")


def garbage(docs: DataFrame) -> DataFrame:
    """doc_id, ord, pattern for each kind of garbage in a document."""
    marks = [(F.col("text").contains("�"), "replacement character U+FFFD"), (F.col("text").rlike(T.PRIVATE_USE), "private-use character")]
    plain = docs.select("doc_id", F.posexplode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in marks]))).alias("ord", "pattern"))
    near = clusters(letter_positions(docs)).select("doc_id", F.lit(2).alias("ord"), F.concat(F.lit("clustered unexpected-script letters near text: "), "examples").alias("pattern"))
    return plain.unionByName(near)


#: One character that might be garbage: beyond Latin, general punctuation and ideographs. A cheap test before thousands of ranges;
#: Java looks through a text some six times as fast for one of these ranges as for a character of none of their complement.
SUSPECT = r"[\x{aa}\x{ba}\x{2b0}-\x{1fff}\x{2070}-\x{33ff}\x{4dc0}-\x{4dff}\x{a000}-\x{10ffff}]"


def sanitized(line: Column) -> Column:
    """struct(line, changed): extraction garbage as squares. A null line stays null."""
    bad = "�|" + T.RUNNER_PRIVATE_USE + "|" + T.unexpected_letters(T.RUNNER_EXPECTED_SCRIPTS)
    shown = F.when(line.rlike(SUSPECT), F.regexp_replace(line, bad, "□")).otherwise(line)
    return F.struct(shown.alias("line"), F.when(line.rlike(SUSPECT), line.rlike(bad)).otherwise(False).alias("changed"))
