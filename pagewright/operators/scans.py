"""Scans of Markdown texts into tables of what they hold, and the as-of join of findings to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T

KINDS = ("display", "inline", "parenthesized", "bracketed")


def page_markers(docs: DataFrame) -> DataFrame:
    """doc_id, seq, start, pdf_page, printed_page (null if absent or unknown) of (doc_id, text)."""
    found = T.find(docs, ["doc_id"], "text", T.PAGE_MARKER, {"p": 1, "q": 2})
    return found.select("doc_id", "seq", "start", F.expr("try_cast(p AS INT)").alias("pdf_page"), F.expr("try_cast(q AS INT)").alias("printed_page"))


def math_spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, seq, start, line, content of the spans in all four kinds of delimiters. Kinds may overlap."""
    patterns = (T.DISPLAY_MATH, T.INLINE_MATH, T.PAREN_MATH, T.BRACKET_MATH)
    parts = [T.find(docs, ["doc_id"], "text", p, {"content": 1}).withColumn("kind", F.lit(k)) for k, p in zip(KINDS, patterns, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "kind", "seq", "start", "line", "content")


#: The patterns of KINDS, and a text without which none of a kind is there.
_PATTERNS = ((T.DISPLAY_MATH, "$$"), (T.INLINE_MATH, "$"), (T.PAREN_MATH, "\\("), (T.BRACKET_MATH, "\\["))


def marks_of(text: Column) -> Column:
    """The page markers in a text: array<struct<seq, start, line, p, q>>, numbers as texts."""
    return T.matches(text, T.PAGE_MARKER, {"p": 1, "q": 2}, text.contains("<!--"))


def spans_of(text: Column, marks: Column) -> Column:
    """The spans of all kinds in a text, in the order of their starts, then of kinds: array<struct<start, rank, seq, kind, line,
    pdf_page, content>>. The page is that of the last of `marks` (marks_of) at or before the start; null before the first.

    The text is scanned by one projection; spans are merged and sorted inside the row."""
    page = lambda start: F.try_element_at(F.filter(marks, lambda m: m["start"] <= start), F.lit(-1))["p"].try_cast("int")

    def of_kind(rank: int) -> Column:
        pattern, sign = _PATTERNS[rank]
        found = T.matches(text, pattern, {"content": 1}, text.contains(sign))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["seq"].alias("seq"), F.lit(KINDS[rank]).alias("kind"), m["line"].alias("line"), page(m["start"]).alias("pdf_page"), m["content"].alias("content")))

    return F.array_sort(F.concat(*[of_kind(k) for k in range(len(KINDS))]))


def ordered_spans(docs: DataFrame) -> DataFrame:
    """doc_id, ord, kind, seq, start, line, pdf_page, content: the spans of each text numbered in their order, from one scan.

    Kinds may overlap: a span of one that starts inside another's is a row of its own. Null and empty texts have none."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_marks", marks_of(F.col("text")))
    rows = d.select("doc_id", F.posexplode(spans_of(F.col("text"), F.col("_marks"))).alias("ord", "s"))
    return rows.select("doc_id", "ord", *[F.col(f"s.{c}").alias(c) for c in ("kind", "seq", "start", "line", "pdf_page", "content")])


def image_refs(docs: DataFrame) -> DataFrame:
    """doc_id, seq, alt, ref of local images: no URLs, without fragment and query, percent-decoded."""
    found = T.find(docs, ["doc_id"], "text", T.IMAGE, {"alt": 1, "angled": 2, "bare": 3})
    ref = F.when(F.col("angled") != "", F.col("angled")).otherwise(F.col("bare"))
    local = found.withColumn("ref", ref).filter(~F.col("ref").rlike(T.URL))
    return local.select("doc_id", "seq", "alt", T.decoded(F.substring_index(F.substring_index("ref", "#", 1), "?", 1)).alias("ref"))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title of heading lines."""
    rows = docs.filter(F.col("text").contains("#")).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("k", "line")).filter(F.col("line").rlike(T.HEADING))
    return rows.select("doc_id", (F.col("k") + 1).alias("line_no"), F.char_length(F.regexp_extract("line", T.HEADING, 1)).alias("level"), T.strip(F.regexp_extract("line", T.HEADING, 2)).alias("title"))


def heading_jumps(heads: DataFrame) -> DataFrame:
    """Headings whose level is more than one below the heading before: doc_id, line_no, previous, level."""
    previous = F.lag("level").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return heads.withColumn("previous", previous).filter(F.col("level") > F.col("previous") + 1).select("doc_id", "line_no", "previous", "level")


def with_page(findings: DataFrame, markers: DataFrame) -> DataFrame:
    """Adds pdf_page to findings (doc_id, start, ...): the page of the last marker at or before start, null before the first.

    One window over both tables, sorted by place."""
    columns = findings.columns
    both = findings.withColumns({"_mark": F.lit(None).cast("int"), "_late": F.lit(1)}).unionByName(markers.select("doc_id", "start", F.col("pdf_page").alias("_mark"), F.lit(0).alias("_late")), allowMissingColumns=True)
    last = F.last("_mark", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("start", "_late").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("pdf_page", last).filter("_late = 1").select(*columns, "pdf_page")


def page_segments(docs: DataFrame) -> DataFrame:
    """doc_id, seq, pdf_page, start, end, head of the runner's pages: from a marker to the next or to the end of the text."""
    found = T.find(docs, ["doc_id"], "text", T.RUNNER_PAGE_MARKER, {"p": 1})
    sized = found.join(docs.select("doc_id", F.char_length("text").cast("long").alias("_n")), "doc_id")
    end = F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("seq")), F.col("_n"))
    return sized.select("doc_id", "seq", F.expr("try_cast(p AS INT)").alias("pdf_page"), "start", end.alias("end"))


def note_counts(docs: DataFrame) -> DataFrame:
    """doc_id, notes: how many transcription notes each text has. A null text has null, an empty one 0."""
    return docs.select("doc_id", F.regexp_count("text", F.lit(T.NOTE)).cast("long").alias("notes"))


def cjk_runs(spans: DataFrame) -> DataFrame:
    """Each run of CJK characters in a span: the span's columns and run_seq, run."""
    return spans.select("*", F.posexplode(F.regexp_extract_all("content", F.lit(T.CJK + "+"), F.lit(0))).alias("run_seq", "run"))
