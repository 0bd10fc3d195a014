"""Merging reviewed decisions: matching them to candidates, their rules, page and document outcomes, what they add to the text.

records(doc_id, page, ord, candidate_index, candidate_id, candidate, source_asset, context_asset, context_type,
source_candidates array<int>) are what was expected; supplied(doc_id, page, ord, d VARIANT) what reviewers handed in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from pagewright.functions import text as T
from pagewright.operators.state import RUNNER_DISPOSITIONS, VISUAL, filled, get, int_of, is_kind, items, number_of, page_of, rules, text_of


def book_key(c: Column) -> Column:
    """The name of a book's file without folder and `.pdf`, case folded."""
    return T.casefold(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?i)\.pdf$", ""))


def given(v: Column) -> Column:
    """Whether a field is there and not null."""
    return v.isNotNull() & ~is_kind(v, "null")


def first_given(entry: Column, *names: str) -> Column:
    """The first of these fields that an object has, null values included."""
    return F.coalesce(*[get(entry, n) for n in names])


def of_book(entry: Column, book: Column) -> Column:
    """Whether an entry names this book or none."""
    return T.once(first_given(entry, "book", "source_book"), lambda named: ~given(named) | F.coalesce(book_key(text_of(named)) == book_key(book), F.lit(False)))


def _candidate(entry: Column) -> Column:
    return T.once(first_given(entry, "candidate", "source_text", "source"), lambda c: F.coalesce(T.strip(text_of(c)), F.lit("")))


def _exploded(df: DataFrame, value: Column, pos: str, key: str, out: str) -> DataFrame:
    """A row for each element of an array or field of an object, by a lateral table function; none for anything else."""
    each = df.sparkSession.tvf.variant_explode(value.outer())
    return df.lateralJoin(each.select(F.col("pos").alias(pos), F.col("key").alias(key), F.col("value").alias(out)))


def _one(v: Column) -> Column:
    """A list of the one value."""
    return F.to_variant_object(F.array(v))


def decision_files(files: DataFrame) -> DataFrame:
    """(doc_id, book, json) to doc_id, what, page, ord, d, candidate, error: everything that a file of decisions says of its book.

    what is `decision`, or `visual` or `text` for pages that were confirmed as a whole, or `file` for an error of the whole
    file. A file is a list of decisions, or an object with `formula_decisions` or else `decisions`, or where these are
    empty one of `pages` with `formulas` whose pages count as confirmed. Decisions for other books are left out; rows that
    can't be used have an error, and the run goes on. ord counts within the list, or within the page's list."""
    d = files.select("doc_id", "book", F.try_parse_json("json").alias("v"))
    v, listed = F.col("v"), first_given(F.col("v"), "formula_decisions", "decisions")
    is_list, is_object, pages = is_kind(v, "array"), is_kind(v, "object"), is_kind(get(v, "pages"), "object")
    empty = ~given(listed) | F.to_json(listed).isin("[]", "{}", '""', "0", "false")
    paged = is_object & empty & pages
    wrong = (
        F.when(v.isNull(), "file is not valid JSON").when(~is_list & ~is_object, "visual decision file must contain an object or list")
        .when(is_object & ~paged & listed.isNotNull() & ~is_kind(listed, "array"), "formula_decisions must be a list")
    )
    lists = lambda f: F.when(is_object, get(v, f))
    part = lambda what, value: F.struct(F.lit(what).alias("what"), value.alias("list"))
    decided = F.when(is_list, v).when(paged, get(v, "pages")).otherwise(F.when(is_kind(listed, "array"), listed))
    parts = F.array(part("decision", decided), part("visual", lists("visual_confirmed_pages")), part("text", lists("text_visual_confirmed_pages")))
    rows = d.select("doc_id", "book", wrong.alias("_wrong"), paged.alias("_paged"), F.explode(parts).alias("p")).select("doc_id", "book", "_wrong", "p.what", F.col("p.list").alias("_list"), (F.col("_paged") & (F.col("p.what") == "decision")).alias("_paged"))
    outer = _exploded(rows.filter("_wrong IS NULL"), F.col("_list"), "_pos", "_key", "_value").filter((F.col("_paged") & is_kind(F.col("_value"), "object")) | (~F.col("_paged") & F.col("_key").isNull()))
    # a page counts as confirmed by itself, beside its decisions
    inner = F.when(F.col("_paged"), get("_value", "formulas")).otherwise(_one(F.col("_value")))
    each = _exploded(outer.filter("what = 'decision'"), inner, "_at", "_name", "d").filter(~F.col("_paged") | is_kind(F.col("d"), "object"))
    entry, ordinal = is_kind(F.col("d"), "object"), F.when(F.col("_paged"), F.col("_at")).otherwise(F.col("_pos"))
    mine = each.filter(~entry | of_book(F.col("d"), F.col("book")))
    raw = get("d", "pdf_page")
    page = F.when(raw.isNull(), page_of(F.col("_key"))).otherwise(number_of(raw).try_cast("int"))
    lacks = (_candidate(F.col("d")) == "") & ~given(get("d", "candidate_index")) & ~filled(get("d", "candidate_id"))
    error = F.when(~entry, "formula decision must be an object").when(page.isNull(), "formula decision has invalid pdf_page").when(lacks, "formula decision lacks candidate/source_text or candidate id")
    decisions = mine.select("doc_id", "what", page.alias("page"), ordinal.alias("ord"), "d", _candidate(F.col("d")).alias("candidate"), error.alias("error"))
    none, no_text = F.lit(None).cast("variant").alias("d"), F.lit(None).cast("string")
    marked = F.when(F.col("_paged"), page_of(F.col("_key"))).otherwise(number_of(F.col("_value")).try_cast("int"))
    field = F.when(F.col("what") == "text", "text_visual_confirmed_pages").otherwise("visual_confirmed_pages")
    looked = outer.filter("_paged OR what <> 'decision'").select("doc_id", F.when(F.col("_paged"), "visual").otherwise(F.col("what")).alias("what"), marked.alias("page"), F.col("_pos").alias("ord"), none, no_text.alias("candidate"), F.when(marked.isNull(), F.concat(field, F.lit(" contains an invalid page"))).alias("error"))
    broken = d.filter(wrong.isNotNull()).select("doc_id", F.lit("file").alias("what"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("ord"), none, no_text.alias("candidate"), wrong.alias("error"))
    return decisions.unionByName(looked).unionByName(broken)


def load_decisions(files: DataFrame) -> DataFrame:
    """doc_id, page, ord, d, candidate, error: the decisions of files, and errors of whole files; see decision_files."""
    return decision_files(files).filter("what IN ('decision', 'file')").drop("what")


def confirmed_pages(files: DataFrame) -> DataFrame:
    """doc_id, page, what (visual or text): pages that reviewers looked at as a whole or decided on."""
    found = decision_files(files if "book" in files.columns else files.withColumn("book", F.lit(""))).filter("error IS NULL")
    return found.select("doc_id", "page", F.when(F.col("what") == "text", "text").otherwise("visual").alias("what")).distinct()


def load_selection(files: DataFrame) -> DataFrame:
    """(doc_id, book, json) to doc_id, page, ord, candidate_index, candidate_id, candidate, error of an audit selection.

    A file is an object of `books` that each have `items` or else `candidates`, an object with `items`, or a list. Items
    for other books are left out. An item with a text stands for that text alone, one without for its index or the number at the end of
    its id. Items that can't be used have an error; ord counts within the list."""
    d = files.select("doc_id", "book", F.try_parse_json("json").alias("v"))
    v, books = F.col("v"), is_kind(get("v", "books"), "object")
    listed = F.when(is_kind(v, "object"), F.coalesce(get(v, "items"), v)).otherwise(v)
    wrong = F.when(v.isNull(), "file is not valid JSON").when(~books & ~is_kind(listed, "array"), "formula selection must contain an items list")
    rows = d.select("doc_id", "book", wrong.alias("_wrong"), books.alias("_by_book"), F.when(books, get(v, "books")).otherwise(listed).alias("_list"))
    outer = _exploded(rows.filter("_wrong IS NULL"), F.col("_list"), "_pos", "_key", "_value").filter(~F.col("_by_book") | is_kind(F.col("_value"), "object"))
    each = _exploded(outer, F.when(F.col("_by_book"), first_given(F.col("_value"), "items", "candidates")).otherwise(_one(F.col("_value"))), "_at", "_name", "d")
    entry = is_kind(F.col("d"), "object")
    named = first_given(F.col("d"), "book", "source_book")
    # an item of a book has the book's name unless it says another
    mine = F.when(F.col("_by_book") & get("d", "book").isNull(), book_key(F.col("_key")) == book_key(F.col("book"))).otherwise(of_book(F.col("d"), F.col("book")))
    kept = each.filter(F.when(F.col("_by_book"), entry & mine).otherwise(~entry | ~given(named) | mine))
    index, said, page = get("d", "candidate_index"), get("d", "candidate_id"), number_of(get("d", "pdf_page")).try_cast("int")
    text = _candidate(F.col("d"))
    end = F.regexp_extract(text_of(said), r"(?i)(?:formula|candidate)[-_]0*(\d+)$", 1).try_cast("int")
    number = int_of(index).try_cast("int")
    error = (
        F.when(~entry, "formula selection item must be an object").when(page.isNull(), "formula selection item has invalid pdf_page").when(page <= 0, "formula selection item has non-positive pdf_page")
        .when(given(index) & (F.coalesce(int_of(index), F.lit(0)) <= 0), "formula selection item has invalid candidate_index").when(given(said) & ~filled(said), "formula selection item has invalid candidate_id")
        .when((text == "") & ~given(index) & ~filled(said), "formula selection item lacks candidate/source_text or candidate id")
        .when((text == "") & (number != end), "candidate_index disagrees with candidate_id").when((text == "") & number.isNull() & end.isNull(), "formula selection item cannot resolve a candidate")
    )
    found = kept.select(
        "doc_id", page.alias("page"), F.when(F.col("_by_book"), F.col("_at")).otherwise(F.col("_pos")).alias("ord"), F.when(text == "", F.coalesce(number, end)).alias("candidate_index"), F.when(text == "", text_of(said)).alias("candidate_id"),
        F.when(text != "", text).alias("candidate"), error.alias("error"),
    )
    broken = d.filter(wrong.isNotNull()).select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in (("page", "int"), ("ord", "int"), ("candidate_index", "int"), ("candidate_id", "string"), ("candidate", "string"))], wrong.alias("error"))
    return found.unionByName(broken)


def select_candidates(regions: DataFrame, selection: DataFrame) -> DataFrame:
    """doc_id, page, ord, candidate_index, error: what the entries of a selection stand for, on the pages that it names.

    Entries are taken in order. One with an index stands for that candidate, whose text must be its own if it has one; one
    with a text alone for the first candidate of that text that no entry before it took, by index or text. An entry for a candidate
    that was taken before gives no row. Entries that stand for nothing have an error and take nothing; null texts of
    candidates are nobody's. The fold runs over one page's short lists."""
    key = ["doc_id", "page"]
    here = regions.groupBy(*key).agg(F.collect_list(F.struct(F.col("candidate_index").cast("int").alias("i"), F.col("text").alias("t"))).alias("_l")).select(*key, F.array_sort("_l").alias("_c"))
    good = selection.filter("error IS NULL")
    entry = F.struct("ord", F.col("candidate_index").cast("int").alias("i"), F.when(F.col("candidate") != "", F.col("candidate")).alias("t"))
    asked = good.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("_s")).join(here, key, "left")
    kind = "ord: INT, candidate_index: INT, error: STRING"
    none, missing = F.expr(f"CAST(array() AS ARRAY<STRUCT<{kind}>>)"), F.lit(None).cast("int")

    def step(acc: Column, e: Column) -> Column:
        taken = lambda i: F.exists(acc, lambda a: F.coalesce(a["candidate_index"] == i, F.lit(False)) & a["error"].isNull())
        at = F.filter("_c", lambda c: c["i"] == e["i"])
        free = F.filter("_c", lambda c: (c["t"] == e["t"]) & ~taken(c["i"]))
        found = F.when(e["i"].isNotNull(), F.try_element_at(at, F.lit(1))["i"]).otherwise(F.try_element_at(free, F.lit(1))["i"])
        wrong = F.when(found.isNull(), F.when(e["i"].isNotNull(), "candidate_index not found").otherwise("candidate not found")).when(
            e["i"].isNotNull() & e["t"].isNotNull() & ~F.coalesce(F.try_element_at(at, F.lit(1))["t"] == e["t"], F.lit(False)), "candidate text doesn't match"
        )
        row = F.struct(e["ord"].cast("int").alias("ord"), F.coalesce(found, e["i"], missing).alias("candidate_index"), wrong.alias("error"))
        return F.when(wrong.isNull() & taken(found), acc).otherwise(F.concat(acc, F.array(row)))

    out = asked.withColumn("_c", F.coalesce("_c", F.expr("CAST(array() AS ARRAY<STRUCT<i: INT, t: STRING>>)"))).select(*key, F.inline(F.aggregate("_s", none, step)))
    return out.unionByName(selection.filter("error IS NOT NULL").select(*key, F.col("ord").cast("int").alias("ord"), F.col("candidate_index").cast("int").alias("candidate_index"), "error"))


def selected_regions(regions: DataFrame, resolved: DataFrame | None) -> DataFrame:
    """The regions that a selection names, all without one."""
    return regions if resolved is None else regions.join(resolved.filter("error IS NULL").select("doc_id", "page", "candidate_index").distinct(), ["doc_id", "page", "candidate_index"], "left_semi")


def candidate_records(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Records, and for pages without any those made from candidates(doc_id, page, ord, candidate)."""
    bare = candidates.join(records.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    i = F.col("ord") + 1
    made = bare.select(
        "doc_id", "page", "ord", i.cast("int").alias("candidate_index"), F.format_string("pdf-page-%03d-formula-%02d", "page", i).alias("candidate_id"), "candidate",
        F.format_string("assets/pdf_page_%03d_formula_%02d.png", "page", i).alias("source_asset"), F.lit(None).cast("string").alias("context_asset"), F.lit("line").alias("context_type"), F.array(i.cast("int")).alias("source_candidates"),
    )
    return records.select(made.columns).unionByName(made)


#: What merging reads of a decision: texts, and of these the ones that a record fills in.
_TEXTS = ("disposition", "verification", "latex", "reason", "unresolved_reason", "candidate_id", "source_asset", "context_asset", "context_type")
_FILLED = ("candidate_id", "source_asset", "context_asset", "context_type")
_READ = (*_TEXTS, "candidate_index", "source_pdf_page", "source_candidates")


def decision_fields(supplied: DataFrame) -> DataFrame:
    """supplied with what is read of d as plain columns: texts t_*, whether a field is there and not null g_*, numbers, the list of candidates.

    Each field is taken out of its VARIANT once; what isn't of a field's kind is null."""
    d = supplied.withColumn("_v", F.try_variant_get("d", "$", f"struct<{', '.join(f'{n}: variant' for n in _READ)}>"))
    d = d.withColumns({f"_k_{n}": F.schema_of_variant(F.col("_v")[n]) for n in _READ})
    is_a = lambda n, k: F.coalesce(F.startswith(F.col(f"_k_{n}"), F.lit(k)), F.lit(False))
    number = lambda n: F.when(is_a(n, "BIGINT"), F.try_variant_get(F.col("_v")[n], "$", "bigint"))
    there = lambda n: F.col(f"_k_{n}").isNotNull() & ~is_a(n, "VOID")
    listed = F.when(is_a("source_candidates", "ARRAY"), F.transform(F.try_variant_get(F.col("_v")["source_candidates"], "$", "array<variant>"), int_of))
    index = F.when(is_a("candidate_index", "BIGINT"), number("candidate_index")).when(there("candidate_index"), number_of(F.col("_v")["candidate_index"]))
    out = {f"t_{n}": F.when(is_a(n, "STRING"), F.try_variant_get(F.col("_v")[n], "$", "string")) for n in _TEXTS} | {f"g_{n}": there(n) for n in (*_FILLED, "candidate_index", "source_pdf_page", "source_candidates")}
    return d.withColumns(out | {"i_match": index.try_cast("int"), "i_candidate_index": number("candidate_index"), "i_source_pdf_page": number("source_pdf_page"), "has_reason": F.col("_k_reason").isNotNull(), "i_source_candidates": F.coalesce(listed, F.array().cast("array<bigint>"))}).drop("_v", *[f"_k_{n}" for n in _READ])


_KEY = ["doc_id", "page"]


def _matched(records: DataFrame, fields: DataFrame, keep: list[str], more: list[str]) -> DataFrame:
    """doc_id, page, r, s: each record with its decision (of decision_fields), null without one; keep and more name what is wanted of both.

    In order of records each takes the first decision not yet taken whose index is its own, or whose id or text is. A
    decision whose index is no number is passed over. Records and decisions meet by page once, and the fold runs over one page's short lists."""
    listed = lambda names: F.array_sort(F.collect_list(F.struct(*names)))
    want = records.groupBy(*_KEY).agg(listed(["ord", "candidate_index", "candidate_id", "candidate", *keep]).alias("_r"))
    bad = (F.col("g_candidate_index") & F.col("i_match").isNull()).alias("bad")
    have = fields.groupBy(*_KEY).agg(listed(["ord", bad, F.col("i_match").alias("i"), F.col("t_candidate_id").alias("id"), F.col("candidate").alias("t"), *more]).alias("_s"))

    def step(acc: Column, r: Column) -> Column:
        same = lambda s: ~s["bad"] & (F.coalesce(s["i"] == r["candidate_index"], F.lit(False)) | F.coalesce(s["id"] == r["candidate_id"], F.lit(False)) | F.coalesce(s["t"] == r["candidate"], F.lit(False)))
        free = F.transform("_s", lambda s, k: same(s) & ~F.array_contains(acc, (k + 1).cast("bigint")))
        return F.concat(acc, F.array(F.coalesce(F.array_position(free, True), F.lit(0).cast("bigint"))))

    taken = F.aggregate("_r", F.array().cast("array<bigint>"), step)
    pairs = T.once(taken, lambda at: F.transform("_r", lambda r, k: F.struct(r.alias("r"), F.get("_s", F.get(at, k).cast("int") - 1).alias("s"))))
    return want.join(have, _KEY, "left").select(*_KEY, F.inline(pairs))


def match(records: DataFrame, supplied: DataFrame) -> DataFrame:
    """doc_id, page, ord, given: for each record the ord of its decision, null without one; see _matched."""
    return _matched(records, decision_fields(supplied), [], []).select(*_KEY, F.col("r.ord").cast("int").alias("ord"), F.col("s.ord").cast("int").alias("given"))


def merged(records: DataFrame, supplied: DataFrame) -> DataFrame:
    """Each record (r_*) with its decision's fields, what the decision leaves out filled in from the record (f_*).

    gone_* is where neither has the field; given is the decision's ord, null without one."""
    own = ["source_asset", "context_asset", "context_type", "source_candidates"]
    said = [*[f"t_{n}" for n in _TEXTS if n != "candidate_id"], *[f"g_{n}" for n in (*_FILLED, "candidate_index", "source_pdf_page", "source_candidates")], "i_candidate_index", "i_source_pdf_page", "has_reason", "i_source_candidates"]
    d = _matched(records, decision_fields(supplied), own, said)
    r, s = (lambda n: F.col(f"r.{n}")), (lambda n: F.col(f"s.{n}"))
    absent = lambda n: ~F.coalesce(s(f"g_{n}"), F.lit(False))
    text = lambda n: F.when(absent(n), r(n)).otherwise(s("id") if n == "candidate_id" else s(f"t_{n}"))
    return d.select(
        *_KEY, r("ord").alias("ord"), s("ord").cast("int").alias("given"), r("candidate").alias("r_candidate"), s("t").alias("s_candidate"), *[text(n).alias(f"f_{n}") for n in _FILLED],
        *[(absent(n) & r(n).isNull()).alias(f"gone_{n}") for n in ("source_asset", "context_asset", "candidate_index")], F.when(absent("candidate_index"), r("candidate_index").cast("bigint")).otherwise(s("i_candidate_index")).alias("f_candidate_index"),
        F.coalesce(F.when(absent("source_candidates"), r("source_candidates").cast("array<bigint>")).otherwise(s("i_source_candidates")), F.array().cast("array<bigint>")).alias("f_source_candidates"),
        F.when(absent("source_pdf_page"), F.col("page").cast("bigint")).otherwise(s("i_source_pdf_page")).alias("number"), *[s(f"t_{n}").alias(n) for n in ("disposition", "verification", "latex", "reason", "unresolved_reason")], F.coalesce(s("has_reason"), F.lit(False)).alias("has_reason"),
    )


def _is_filled(c: Column) -> Column:
    return F.coalesce(T.strip(c) != "", F.lit(False))


def executable_errors(m: DataFrame, assets: DataFrame) -> DataFrame:
    """Adds errors to merged records: the rules a decision must meet before it may change the text. Records without decision have none.

    assets(doc_id, path) are the files below the document's folder."""
    what = F.coalesce(F.col("disposition"), F.lit(""))
    files = assets.select("doc_id", F.col("path")).distinct()
    for f in ("source_asset", "context_asset"):
        m = m.withColumn(f"_{f}", T.normal_path(F.col(f"f_{f}")))
        m = m.join(files.select("doc_id", F.col("path").alias(f"_{f}"), F.lit(True).alias(f"_has_{f}")), ["doc_id", f"_{f}"], "left")
    known = lambda f: F.coalesce(F.col(f"_has_{f}"), F.lit(False))

    def path_rules(f: str, wanted: Column) -> list[tuple[Column, Column | str]]:
        value, given, full = F.col(f"f_{f}"), wanted & ~F.col(f"gone_{f}"), _is_filled(F.col(f"f_{f}"))
        ok = given & full
        return [
            (given & ~full, f"{f} must be a non-empty relative path"), (ok & value.startswith("/"), f"{f} must stay relative to the Markdown directory"),
            (ok & ~value.startswith("/") & F.col(f"_{f}").isNull(), f"{f} escapes the Markdown directory"), (ok & F.col(f"_{f}").isNotNull() & ~known(f), F.concat(F.lit(f"{f} does not exist: "), value)),
        ]

    number, visual = F.col("number"), what.isin(*VISUAL)
    reason = F.when(F.col("has_reason"), F.col("reason")).otherwise(F.col("unresolved_reason"))
    bad_items = F.exists("f_source_candidates", lambda x: F.coalesce(x, F.lit(0)) <= 0)
    errors = rules([
        (F.coalesce(F.col("s_candidate"), F.lit("")).isin("") == F.lit(False), F.when(F.col("s_candidate") != F.col("r_candidate"), "decision candidate does not match the selected PDF candidate")),
        (what == "conservative_latex", "legacy conservative_latex is not an executable decision"),
        (~what.isin("conservative_latex", *RUNNER_DISPOSITIONS), F.concat(F.lit("unknown disposition: "), F.coalesce(F.concat(F.lit("'"), F.col("disposition"), F.lit("'")), F.lit("None")))),
        (F.coalesce(F.col("verification"), F.lit("")) != "visual", "verification must be visual"),
        *path_rules("source_asset", F.lit(True)),
        (F.coalesce(number, F.lit(0)) <= 0, "source_pdf_page must be a positive integer"),
        ((F.coalesce(number, F.lit(0)) > 0) & (number != F.col("page")), F.format_string("source_pdf_page must match candidate page %d", "page")),
        (~known("source_asset") & F.coalesce(number != F.col("page"), F.lit(True)), "source_asset or matching source_pdf_page is required"),
        (visual & F.col("gone_context_asset"), "context_asset is required"),
        *path_rules("context_asset", visual),
        (visual & ~F.coalesce(F.col("f_context_type").isin("line", "region"), F.lit(False)), "context_type must be line or region"),
        (visual & (F.size("f_source_candidates") == 0), "source_candidates must be a non-empty list"),
        (visual & (F.size("f_source_candidates") > 0) & bad_items, "source_candidates must contain positive integers"),
        (visual & ~_is_filled(F.col("f_candidate_id")), "candidate_id must be a non-empty string"),
        ((what == "latex_confirmed") & ~_is_filled(F.col("latex")), "latex_confirmed requires non-empty latex"),
        ((what == "crop_only") & ~_is_filled(F.col("unresolved_reason")), "crop_only requires unresolved_reason"),
        (what.isin("not_formula", "removed") & ~_is_filled(reason), F.concat(what, F.lit(" requires a concrete reason"))),
        (~F.col("gone_candidate_index") & (F.coalesce(F.col("f_candidate_index"), F.lit(0)) <= 0), "candidate_index must be a positive integer"),
    ])
    none = F.array().cast("array<string>")
    return m.withColumn("errors", F.when(F.col("given").isNull(), none).otherwise(errors)).drop("_source_asset", "_context_asset", "_has_source_asset", "_has_context_asset")


def accepted(checked: DataFrame) -> DataFrame:
    """Decisions that broke no rule, as they are written into a state: doc_id, page, ord, disposition, the candidate's own text as
    candidate, source and source_text, provenance, and the reason, which falls back to unresolved_reason where one is asked for."""
    d = checked.filter(F.col("given").isNotNull() & (F.size("errors") == 0))
    reason = F.when(F.col("has_reason"), F.col("reason")).when(F.col("disposition").isin("not_formula", "removed"), F.col("unresolved_reason"))
    own = {n: F.col("r_candidate") for n in ("candidate", "source", "source_text")}
    kept = {n: F.col(f"f_{n}") for n in _FILLED}
    return d.select("doc_id", "page", "ord", "disposition", *[c.alias(n) for n, c in own.items()], F.col("page").alias("pdf_page"), F.col("f_candidate_index").cast("int").alias("candidate_index"), *[c.alias(n) for n, c in kept.items()], F.col("f_source_candidates").cast("array<int>").alias("source_candidates"), "latex", reason.alias("reason"), "unresolved_reason")


def unused(supplied: DataFrame, matches: DataFrame, queued: DataFrame) -> DataFrame:
    """Decisions that no record took: doc_id, page, ord, decision ("unexpected candidate" on queued(doc_id, page), "unexpected page" elsewhere)."""
    rows = supplied.select(*_KEY, F.col("ord").cast("int").alias("s"))
    rows = rows.unionByName(matches.filter("given IS NOT NULL").select(*_KEY, F.col("given").cast("int").alias("t")), allowMissingColumns=True)
    rows = rows.unionByName(queued.select(*_KEY, F.lit(True).alias("q")), allowMissingColumns=True)
    pages = rows.groupBy(*_KEY).agg(F.collect_list("s").alias("s"), F.collect_set("t").alias("t"), F.coalesce(F.bool_or("q"), F.lit(False)).alias("q"))
    left = F.filter("s", lambda x: ~F.col("q") | ~F.array_contains("t", x))
    return pages.select(*_KEY, "q", F.explode(left).alias("ord")).select(*_KEY, "ord", F.when(F.col("q"), "unexpected candidate").otherwise("unexpected page").alias("decision"))


def visual_disposition(has_assets: Column, confirmed: Column, reasons: Column) -> Column:
    """What becomes of a page's images; null if nothing calls for them."""
    has = lambda r: F.array_contains(reasons, r)
    look = F.lit("visual_review_required")
    return (
        F.when(has_assets & confirmed, "necessary_crop_retained").when(has_assets, look)
        .when(has("visual-evidence-not-cropped") & confirmed, "markdown_sufficient")
        .when(has("embedded-visual-retention") | has("visual-evidence-not-cropped"), look)
        .when(has("meaningful-visual-cue"), F.when(confirmed, "markdown_sufficient").otherwise(look))
    )


def text_disposition(confirmed: Column, reasons: Column) -> Column:
    """What becomes of a page's broken text; null where nothing is wrong with it or its reasons are null."""
    return F.when(F.array_contains(reasons, "text-layer-anomaly"), F.when(confirmed, "placeholder_retained").otherwise("visual_review_required"))


def page_outcomes(queued: DataFrame, checked: DataFrame, extra: DataFrame, confirmed: DataFrame) -> DataFrame:
    """doc_id, page, visual, text, status of queued(doc_id, page, reasons, has_assets), by the records' errors (executable_errors),
    unused decisions and confirmed_pages. Crops that failed to render keep a page in the queue; those of contexts don't."""
    key = ["doc_id", "page"]
    of_records = checked.groupBy(*key).agg(F.bool_or(F.col("given").isNull() | (F.size("errors") > 0)).alias("_bad"), F.bool_or((F.size("errors") == 0) & (F.col("disposition") == "crop_only")).alias("_crop"))
    of_extra = extra.filter("decision = 'unexpected candidate'").select(*key, F.lit(True).alias("_extra")).distinct()
    marks = confirmed.groupBy(*key).agg(F.bool_or(F.col("what") == "visual").alias("_v"), F.bool_or(F.col("what") == "text").alias("_t"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    d = queued.join(of_records, key, "left").join(of_extra, key, "left").join(marks, key, "left")
    d = d.withColumns({"visual": visual_disposition(F.col("has_assets"), no("_v"), F.col("reasons")), "text": text_disposition(no("_t"), F.col("reasons"))})
    failed = F.arrays_overlap("reasons", F.array(F.lit("formula-crop-render-failed"), F.lit("visual-crop-render-failed")))
    look = "visual_review_required"
    missing = no("_bad") | no("_extra") | F.coalesce(F.col("visual") == look, F.lit(False)) | F.coalesce(F.col("text") == look, F.lit(False)) | failed
    return d.select(*key, "visual", "text", F.when(missing, look).when(no("_crop"), "completed_with_review_items").otherwise("visually_verified").alias("status"))


def document_outcomes(pages: DataFrame) -> DataFrame:
    """doc_id, status: still in review, completed with items, or completed."""
    worst = F.max(F.when(F.col("status") == "visual_review_required", 2).when(F.col("status") == "completed_with_review_items", 1).otherwise(0))
    return pages.groupBy("doc_id").agg(worst.alias("_w")).select("doc_id", F.when(F.col("_w") == 2, "visual_review").when(F.col("_w") == 1, "completed_with_review_items").otherwise("completed").alias("status"))


def disposition_counts(checked: DataFrame) -> DataFrame:
    """doc_id and how many of its decisions that broke no rule have each disposition. Books without such decisions have no row."""
    good = checked.filter((F.col("given").isNotNull()) & (F.size("errors") == 0))
    return good.groupBy("doc_id").agg(*[F.count_if(F.col("disposition") == d).alias(d) for d in VISUAL])


def pending_items(checked: DataFrame) -> DataFrame:
    """doc_id, page, ord, reason, note: what reviewed crops leave open, and the note that goes into the page."""
    d = checked.filter((F.size("errors") == 0) & (F.col("disposition") == "crop_only")).withColumn("reason", F.col("unresolved_reason"))
    note = F.concat(F.format_string("PDF 第 %d 页公式已视觉检查，但结构仍不安全；保留裁剪并未生成 LaTeX：", "page"), F.col("reason"))
    return d.select("doc_id", "page", "ord", "reason", note.alias("note"))


def trace(checked: DataFrame, extra: DataFrame) -> DataFrame:
    """doc_id, page, ord, decision, inspected, errors: the append-only events of a merge."""
    none = F.array().cast("array<string>")
    decision = F.when(F.col("given").isNull(), None).when(F.size("errors") > 0, "invalid").otherwise(F.col("disposition"))
    errors = F.when(F.col("given").isNull(), F.array(F.lit("missing visual decision"))).otherwise(F.col("errors"))
    a = checked.select("doc_id", "page", "ord", decision.alias("decision"), (F.col("given").isNotNull() & (F.size("errors") == 0)).alias("inspected"), errors.alias("errors"))
    why = F.when(F.col("decision") == "unexpected page", "decision page was not in the Phase 1 review queue").otherwise("decision has no matching formula candidate")
    return a.unionByName(extra.select("doc_id", "page", "ord", "decision", F.lit(False).alias("inspected"), F.coalesce(F.array(why), none).alias("errors")))


def formula_blocks(checked: DataFrame) -> DataFrame:
    """doc_id, page, ord, block: what a confirmed formula adds to its page."""
    d = checked.filter((F.size("errors") == 0) & (F.col("disposition") == "latex_confirmed"))
    source = F.coalesce(F.when(_is_filled(F.col("f_source_asset")), F.col("f_source_asset")), F.format_string("PDF page %d", "page"))
    context = F.when(_is_filled(F.col("f_context_asset")), F.concat(F.lit("Visual context source (Agent inspection): `"), F.col("f_context_asset"), F.lit("`\n\n"))).otherwise("")
    block = F.concat(F.lit("### Visually reconstructed formula\n\nText-layer locator (secondary only): `"), F.col("r_candidate"), F.lit("`\n\nVisual source (Agent inspection): `"), source, F.lit("`\n\n"), context, F.lit("$$\n"), F.col("latex"), F.lit("\n$$"))
    return d.select("doc_id", "page", "ord", block.alias("block"))


def text_pieces(docs: DataFrame) -> DataFrame:
    """doc_id, k, page, piece: texts cut once, before each of their page markers; page is null for what stands before the first."""
    cut = F.split("text", "(?=" + T.RUNNER_PAGE_MARKER.replace("(?U)", "") + ")", -1)
    pieces = docs.select("doc_id", F.posexplode(cut).alias("k", "piece"))
    number = F.regexp_extract("piece", "^" + T.RUNNER_PAGE_MARKER.replace("(?U)", ""), 1)
    return pieces.select("doc_id", "k", number.try_cast("int").alias("page"), "piece")


def with_additions(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pieces (of text_pieces) with blocks(doc_id, page, ord, block) at the ends of their pages; a row a page, as before."""
    added = blocks.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]).alias("_b"))
    return with_blocks(pieces.join(added, ["doc_id", "page"], "left"), F.col("_b"))


def with_blocks(pieces: DataFrame, blocks: Column) -> DataFrame:
    """Pieces with the blocks that are listed in their own row at their ends; what stands before the first page stays as it is."""
    body = F.regexp_replace("piece", rf"(?U){T.SPACE}+$", "")
    whole = F.concat(body, F.when(blocks.isNotNull(), F.concat(F.lit("\n\n"), F.array_join(blocks, "\n\n"))).otherwise(""), F.lit("\n\n"))
    return pieces.select("doc_id", "k", "page", F.when(F.col("page").isNull(), F.col("piece")).otherwise(whole).alias("piece"))


#: Characters of a book beyond which it isn't made one string.
MOST_CHARS = 1 << 29


def book_texts(pieces: DataFrame) -> DataFrame:
    """doc_id, text: pieces put together, in order of k. A book of more than MOST_CHARS characters is an error: it stays in pieces."""
    size = F.sum(F.char_length("piece").cast("long"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "")
    sizes = pieces.groupBy("doc_id").agg(size.alias("_n"))
    large = F.raise_error(F.concat(F.lit("a book is too large to be one text: "), F.col("doc_id").cast("string"))).cast("boolean")
    fitting = sizes.filter(F.when(F.col("_n") > MOST_CHARS, large).otherwise(F.lit(True))).select("doc_id")
    return pieces.join(fitting, "doc_id").groupBy("doc_id").agg(joined.alias("text"))


def book_digests(pieces: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, digest, sums: the MD5 of each book's text, pieces in order of k, of any size, and the sums of columns of its pieces: a book's pieces are sorted and pass through
    its digest one after the other, so no more than a batch of them is held. Null pieces count as empty."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, running, totals, schema = None, None, [], pa.schema([("doc_id", kind), ("digest", pa.string()), *[(n, pa.int64()) for n in sums]])
        done = lambda: pa.RecordBatch.from_arrays([pa.array([book], kind), pa.array([running.hexdigest()]), *[pa.array([t], pa.int64()) for t in totals]], schema=schema)
        for batch in batches:
            for doc_id, piece, *more in zip(batch.column(0).to_pylist(), batch.column(1), *[batch.column(k + 2).to_pylist() for k in range(len(sums))]):
                if running is None or doc_id != book:
                    if running is not None:
                        yield done()
                    book, running, totals = doc_id, hashlib.md5(), [0] * len(sums)
                running.update((piece.as_buffer() or b"") if piece.is_valid else b"")
                totals = [t + (x or 0) for t, x in zip(totals, more)]
        if running is not None:
            yield done()

    doc_type = pieces.schema["doc_id"].dataType
    kind = to_arrow_type(doc_type)
    ordered = pieces.select("doc_id", "k", F.col("piece").cast("binary").alias("piece"), *[F.col(n).cast("bigint").alias(n) for n in sums]).repartition("doc_id").sortWithinPartitions("doc_id", "k", "piece")
    return ordered.select("doc_id", "piece", *sums).mapInArrow(digests, ", ".join([f"doc_id {doc_type.simpleString()}", "digest string", *[f"{n} bigint" for n in sums]]))


def notes_as_blocks(notes: DataFrame) -> DataFrame:
    """Distinct notes of a page in order, as blocks for with_additions."""
    d = notes.select("doc_id", "page", "note").distinct()
    return d.select("doc_id", "page", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("note")).alias("ord"), F.concat(F.lit("> [Transcription note: "), "note", F.lit("]")).alias("block"))
