"""The report of each document: all checks, errors and warnings, one verdict.

Texts are scanned once: one projection takes what the checks need out of each as arrays, and facts are expressions over
these, so texts are never shuffled. Checks and verdict are expressions over a document's facts. The detectors of
pagewright.operators give the same findings as rows, with places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import assets as A
from pagewright.operators import garbage as G
from pagewright.operators import math as M
from pagewright.operators import state as ST


@dataclass(frozen=True)
class Inputs:
    """What a report looks at besides docs(doc_id, text). Checks whose input isn't given pass or aren't listed.

    assets(doc_id, path); expected(doc_id, first_page, last_page); printed(doc_id, first_printed, last_printed);
    states(doc_id, state JSON); manifests(doc_id, manifest JSON, path: the document's path)."""

    docs: DataFrame
    assets: DataFrame | None = None
    expected: DataFrame | None = None
    printed: DataFrame | None = None
    states: DataFrame | None = None
    manifests: DataFrame | None = None
    forbidden: tuple[str, ...] = ()
    require_printed: bool = False
    require_stem: bool = False


def manifest_problems(found: DataFrame) -> Column:
    """The problems of a document's manifest (v, path) beside its facts refs and pages."""
    named = ST.text_of(ST.get("v", "output_markdown"))
    said, listed = ST.get("v", "images"), ST.get("v", "pdf_pages")
    numbers = F.transform(ST.items(listed), lambda x: ST.number_of(x).try_cast("int"))
    return ST.rules([
        (F.col("v").isNull(), "manifest is not valid JSON"),
        ((named != "") & (named != F.col("path")), "manifest output_markdown does not point to the validated Markdown"),
        (said.isNotNull() & ~F.coalesce(ST.int_of(said) == F.col("refs"), F.lit(False)), F.concat(F.lit("manifest images="), F.to_json(said), F.lit(" but Markdown has "), F.col("refs").cast("string"), F.lit(" local image references"))),
        (ST.is_kind(listed, "array") & (F.size("pages") > 0) & (numbers != F.col("pages")), "manifest pdf_pages differs from Markdown page markers"),
    ])


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _all(pattern: str, group: int, when: Column) -> Column:
    """All matches of a group in the text, where a cheap test lets them be."""
    return F.when(when, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(_none("string"))


def _pairs(c: Column) -> Column:
    """struct(a, b) of each element of an array and the one after."""
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.arrays_zip(F.slice(c, 1, n).alias("a"), F.slice(c, 2, n).alias("b"))


def _how_many(c: Column, holds) -> Column:
    return F.size(F.filter(c, holds))


def _repeated(c: Column) -> Column:
    """How many values occur more than once in an array."""
    return F.size(F.array_distinct(F.transform(F.filter(_pairs(F.array_sort(c)), lambda p: p["a"] == p["b"]), lambda p: p["a"])))


def scanned(docs: DataFrame, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """What the checks need of each text, as arrays, from one scan; the texts themselves end here."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    has = lambda x: F.col("text").contains(x)
    image = [_all(T.IMAGE, g, has("![")) for g in (1, 2, 3)]
    parts = F.arrays_zip(image[0].alias("alt"), image[1].alias("angled"), image[2].alias("bare"))
    target = F.transform(parts, lambda m: F.struct(T.strip(m["alt"]).alias("alt"), F.when(m["angled"] != "", m["angled"]).otherwise(m["bare"]).alias("ref")))
    clean = lambda r: T.decoded(F.substring_index(F.substring_index(r, "#", 1), "?", 1))
    refs = F.transform(F.filter(target, lambda m: ~m["ref"].rlike(T.URL)), lambda m: F.struct(m["alt"].alias("alt"), clean(m["ref"]).alias("ref")))
    heads = F.when(has("#"), F.filter(T.lines(F.col("text")), lambda x: x.rlike(T.HEADING))).otherwise(_none("string"))
    letter = T.unexpected_letters()
    between = F.split("text", letter, -1)
    near = F.exists(F.slice(between, 2, F.greatest(F.size(between) - 2, F.lit(0))), lambda x: F.char_length(x) < G.NEAR)
    counts = M.delimiter_columns()
    return d.select(
        "doc_id", F.transform(_all(T.PAGE_MARKER, 1, has("<!--")), lambda x: x.try_cast("int")).alias("pages"), F.transform(_all(T.PAGE_MARKER, 2, has("<!--")), lambda x: x.try_cast("int")).alias("printed"),
        F.transform(refs, lambda m: F.struct(m["alt"].alias("alt"), m["ref"].alias("ref"), T.normal_path(m["ref"]).alias("target"))).alias("images"),
        _all(T.DISPLAY_MATH, 1, has("$$")).alias("display_math"), F.concat(_all(T.INLINE_MATH, 1, has("$")), _all(T.PAREN_MATH, 1, has("\\(")), _all(T.BRACKET_MATH, 1, has("\\["))).alias("other_math"),
        F.transform(heads, lambda x: F.char_length(F.regexp_extract(x, T.HEADING, 1))).alias("levels"),
        F.regexp_count("text", F.lit(T.NOTE)).alias("notes"), (has("\ufffd").cast("int") + F.col("text").rlike(T.PRIVATE_USE).cast("int") + F.when(F.col("text").rlike(letter), near).otherwise(False).cast("int")).alias("garbage"),
        *[c.alias(f"n_{k}") for k, c in counts.items()], sum((has(t).cast("int") for t in forbidden), F.lit(0)).alias("forbidden"),
    )


#: The facts of a document, all longs.
FACTS = ("refs", "unique_refs", "outside", "duplicate_refs", "alt", "missing", "orphans", "markers", "duplicate_pages", "known_printed", "printed_breaks", "uncovered", "gaps", "expects", "printed_range", "delimiters", "display_blocks", "inline_markers", "braces", "mojibake", "prose", "artifact_fail", "artifacts", "headings", "jumps", "garbage", "notes", "forbidden", "manifest", "state_errors", "state_warnings", "has_state")


def facts(inp: Inputs) -> DataFrame:
    """One row a document with a column for each of FACTS, 0 where nothing was found. Null texts are empty.

    The text is scanned once; what other tables say of a document is joined by doc_id."""
    d = scanned(inp.docs, inp.forbidden).withColumn("math", F.concat("display_math", "other_math"))
    refs, known = F.col("images.ref"), F.array_compact("printed")
    count = lambda c: F.size(c)
    braced = lambda c: M.brace_positions(c)
    bare = F.transform("display_math", lambda c: F.struct(c.alias("c"), M.without_labels(c).alias("b")))
    score = F.transform(bare, lambda s: M.points({k: F.coalesce(x, F.lit(False)) for k, x in M.artifact_signals(s["c"], s["b"]).items()}))
    runs = F.flatten(F.transform("math", lambda c: F.regexp_extract_all(c, F.lit(T.CJK + "+"), F.lit(0))))
    stems = F.lit(inp.require_stem)
    found = {
        "refs": count("images"), "unique_refs": F.size(F.array_distinct(refs)), "outside": _how_many(F.col("images"), lambda m: m["target"].isNull()), "duplicate_refs": _repeated(refs),
        "alt": _how_many(F.col("images"), lambda m: m["alt"] == "") + _how_many(F.col("images"), lambda m: stems & m["target"].isNotNull() & (A.stem(m["ref"]) != m["alt"])),
        "markers": count("pages"), "duplicate_pages": _repeated(F.transform("pages", lambda p: F.coalesce(p, F.lit(-1)))), "known_printed": F.size(known), "printed_breaks": _how_many(_pairs(known), lambda p: p["b"] != p["a"] + 1),
        "delimiters": sum((x.cast("int") for x in M.unbalanced(*[F.col(f"n_{k}") for k in ("display", "inline", "paren_open", "paren_close", "bracket_open", "bracket_close")])), F.lit(0)),
        "display_blocks": F.floor(F.col("n_display") / 2), "inline_markers": F.col("n_inline"),
        "braces": _how_many(F.col("math"), lambda c: (c.contains("{") | c.contains("}")) & F.exists(F.array(braced(c)), lambda b: (F.size(b["open"]) > 0) | (F.size(b["close"]) > 0))),
        "prose": _how_many(F.col("math"), lambda c: M.without_labels(c).rlike(T.CJK)),
        "artifact_fail": _how_many(F.col("_score"), lambda x: x >= M.FAIL_FROM), "artifacts": _how_many(F.col("_score"), lambda x: x >= M.WARN_FROM),
        "headings": count("levels"), "jumps": _how_many(_pairs(F.col("levels")), lambda p: p["b"] > p["a"] + 1), "garbage": F.col("garbage"), "notes": F.col("notes"), "forbidden": F.col("forbidden"), "mojibake": F.col("_mojibake"),
    }
    d = d.withColumns({"_score": score, "_mojibake": M.mojibake_count(runs)})
    d = d.select("doc_id", "pages", known.alias("_known"), F.array_distinct("images.target").alias("_targets"), F.col("images.target").alias("_all_targets"), *[c.cast("long").alias(k) for k, c in found.items()])
    zero = F.lit(0).cast("long")
    more = {k: zero for k in FACTS if k not in found}
    if inp.assets is not None:
        files = inp.assets.groupBy("doc_id").agg(F.array_sort(F.collect_set("path")).alias("_files"))  # the files of one document's folder
        d = d.join(files, "doc_id", "left").withColumn("_files", F.coalesce("_files", _none("string")))
        image = lambda x: x.contains(".") & F.lower(F.element_at(F.split(x, r"\."), -1)).isin(*T.IMAGE_SUFFIXES)
        more["missing"] = _how_many(F.col("_all_targets"), lambda t: t.isNotNull() & ~F.array_contains("_files", F.coalesce(t, F.lit(""))))
        more["orphans"] = F.size(F.array_except(F.filter("_files", image), "_targets"))
    if inp.expected is not None:
        d = d.join(inp.expected.select("doc_id", F.sequence("first_page", "last_page").alias("_want")), "doc_id", "left")
        more["uncovered"], more["expects"] = F.when(F.col("pages") != F.col("_want"), 1).otherwise(0), F.when(F.col("_want").isNotNull(), 1).otherwise(0)
        more["gaps"] = F.when((F.size("pages") > 0) & F.col("_want").isNotNull(), F.size(F.array_except("_want", "pages"))).otherwise(0)
    if inp.printed is not None:
        d = d.join(inp.printed.select("doc_id", "first_printed", "last_printed"), "doc_id", "left")
        same = (F.try_element_at("_known", F.lit(1)) == F.col("first_printed")) & (F.try_element_at("_known", F.lit(-1)) == F.col("last_printed"))
        more["printed_range"] = F.when(F.col("first_printed").isNull(), 0).when(F.coalesce(same, F.lit(False)), 1).otherwise(2)
    if inp.manifests is not None:
        d = d.join(inp.manifests.select("doc_id", "path", F.try_parse_json("manifest").alias("v"), F.lit(1).alias("_told")), "doc_id", "left")
        more["manifest"] = F.when(F.col("_told") == 1, F.size(manifest_problems(d))).otherwise(0)
    if inp.states is not None:
        states = ST.state_report(inp.states).select("doc_id", F.size("errors").alias("_se"), F.size("warnings").alias("_sw"))
        d = d.join(states, "doc_id", "left")
        more |= {"state_errors": F.coalesce("_se", zero), "state_warnings": F.coalesce("_sw", zero), "has_state": F.col("_se").isNotNull().cast("long")}
    d = d.withColumns({k: c.cast("long") for k, c in more.items()})
    return d.select("doc_id", *FACTS)


#: The checks in order.
CHECKS = ("images.exists", "images.path_safety", "images.duplicates", "images.alt", "images.orphans", "pages.coverage", "pages.duplicates", "pages.continuity", "pages.printed", "pages.printed_range", "math.delimiters", "math.braces", "math.mojibake", "math.chinese_prose", "math.extraction_artifact", "markdown.headings", "text.garbage", "notes.excessive", "text.forbidden", "manifest.consistency", "workflow.state")


def checked(f: DataFrame, require_printed: bool = False) -> DataFrame:
    """Facts with errors, warnings (how many entries each list would have), checks (array of id, status) and status."""
    c, one = F.col, lambda cond: F.when(cond, 1).otherwise(0)
    some = lambda n: c(n) > 0
    excessive = (c("notes") >= 10) & ((c("notes") / F.greatest(F.lit(1), c("markers")) >= 0.20) | (c("notes") >= 25))
    unknown = F.lit(require_printed) & (c("known_printed") < c("markers"))
    printed = unknown | ((c("known_printed") >= 2) & some("printed_breaks"))
    no_markers = (c("expects") == 0) & (c("markers") == 0)
    artifact = F.when(some("artifact_fail"), "FAIL").when(some("artifacts"), "WARN").otherwise("PASS")
    fail, warn = lambda cond: F.when(cond, "FAIL").otherwise("PASS"), lambda cond: F.when(cond, "WARN").otherwise("PASS")
    status = {
        "images.exists": fail(some("missing")), "images.path_safety": fail(some("outside")), "images.duplicates": warn(some("duplicate_refs")), "images.alt": warn(some("alt")), "images.orphans": warn(some("orphans")),
        "pages.coverage": F.when(some("uncovered"), "FAIL").when(no_markers, "WARN").otherwise("PASS"), "pages.duplicates": fail(some("duplicate_pages")),
        "pages.continuity": F.when(some("expects") & some("markers"), warn(some("gaps"))), "pages.printed": warn(printed), "pages.printed_range": F.when(some("printed_range"), fail(c("printed_range") == 2)),
        "math.delimiters": fail(some("delimiters")), "math.braces": fail(some("braces")), "math.mojibake": fail(some("mojibake")), "math.chinese_prose": fail(some("prose")), "math.extraction_artifact": artifact,
        "markdown.headings": warn(some("jumps") | (c("headings") == 0)), "text.garbage": fail(some("garbage")), "notes.excessive": warn(excessive), "text.forbidden": fail(some("forbidden")), "manifest.consistency": fail(some("manifest")),
        "workflow.state": F.when(some("has_state"), F.when(some("state_errors"), "FAIL").when(some("state_warnings"), "WARN").otherwise("PASS")),
    }
    once = ("missing", "outside", "uncovered", "duplicate_pages", "braces", "mojibake", "prose", "artifact_fail", "garbage", "manifest")
    errors = sum((one(some(n)) for n in once), F.lit(0)) + one(c("printed_range") == 2) + c("delimiters") + c("forbidden") + c("state_errors")
    warnings = sum((one(some(n)) for n in ("duplicate_refs", "alt", "orphans", "gaps")), F.lit(0)) + one(no_markers) + one(printed) + one(some("artifacts") & ~some("artifact_fail")) + c("jumps") + one(c("headings") == 0) + one(excessive) + c("state_warnings")
    d = f.withColumns({"errors": errors.cast("long"), "warnings": warnings.cast("long")})
    listed = F.filter(F.array(*[F.struct(F.lit(k).alias("check_id"), status[k].alias("status")) for k in CHECKS]), lambda x: x["status"].isNotNull())
    return d.withColumns({"checks": listed, "status": F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS")})


def report(inp: Inputs) -> DataFrame:
    """One row a document: its facts, checks, numbers of errors and warnings, and status."""
    return checked(facts(inp), inp.require_printed)


def check_rows(reports: DataFrame) -> DataFrame:
    """doc_id, ord, check_id, status: a row for each check."""
    return reports.select("doc_id", F.posexplode("checks").alias("ord", "c")).select("doc_id", "ord", "c.check_id", "c.status")


def exit_code(strict: bool = False) -> Column:
    """Of a report: 0 if it passes (with warnings too, unless strict), else 1."""
    return F.when(F.col("status") == "PASS", 0).when((F.col("status") == "WARN") & ~F.lit(strict), 0).otherwise(1)


def as_json(reports: DataFrame) -> DataFrame:
    """doc_id, json: each report as a JSON object, schema_version 2."""
    body = F.struct(F.lit(2).alias("schema_version"), *[F.col(c) for c in reports.columns])
    return reports.select("doc_id", F.to_json(body).alias("json"))
