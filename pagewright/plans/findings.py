"""The whole report of each document: every check with its message and details, errors and warnings in order, a summary.

A text is scanned by one projection. What it holds (markers, images, spans with places and pages, headings) stays in arrays
of the document's row, other tables are joined by doc_id, and all findings are expressions over these. Details are
VARIANT, since every check has fields of its own. `plans.report` has the same verdicts as counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import assets as A
from pagewright.operators import garbage as G
from pagewright.operators import math as M
from pagewright.operators import scans as S
from pagewright.operators import state as ST
from pagewright.plans.report import Inputs, manifest_problems


def _none(kind: str) -> Column:
    return F.expr(f"CAST(array() AS ARRAY<{kind}>)")


def listed(c: Column) -> Column:
    """Numbers as `[1, 2]`."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))


def _twice(c: Column) -> Column:
    """The values that occur more than once, in order."""
    pairs = lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.when(a == b, a))
    return T.once(F.array_sort(c), lambda x: F.array_distinct(F.array_compact(pairs(x))))


def _steps(c: Column, holds) -> Column:
    """struct(a, b) of neighbours for which `holds`."""
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.filter(F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), holds)


def scanned(docs: DataFrame, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """What each text holds, as arrays; the text itself ends here. Null texts are empty."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text, has = F.col("text"), lambda x: F.col("text").contains(x)
    image = T.matches(text, T.IMAGE, {"alt": 1, "angled": 2, "bare": 3}, has("!["))
    target = F.transform(image, lambda m: F.struct(T.strip(m["alt"]).alias("alt"), F.when(m["angled"] != "", m["angled"]).otherwise(m["bare"]).alias("ref")))
    refs = F.transform(F.filter(target, lambda m: ~m["ref"].rlike(T.URL)), lambda m: F.struct(m["alt"].alias("alt"), T.decoded(F.substring_index(F.substring_index(m["ref"], "#", 1), "?", 1)).alias("ref")))
    images = F.transform(refs, lambda m: F.struct(m["alt"].alias("alt"), m["ref"].alias("ref"), T.normal_path(m["ref"]).alias("target")))
    heads = F.array_compact(F.transform(T.lines(text), lambda x, k: F.when(x.rlike(T.HEADING), F.struct((k + 1).alias("line"), F.char_length(F.regexp_extract(x, T.HEADING, 1)).alias("level")))))
    letter = T.unexpected_letters()
    near = lambda between: F.exists(F.slice(between, 2, F.greatest(F.size(between) - 2, F.lit(0))), lambda x: F.char_length(x) < G.NEAR)
    examples = F.concat(F.lit("clustered unexpected-script letters near text: "), F.array_join(F.slice(F.regexp_extract_all(text, F.lit("(" + letter + ")"), F.lit(1)), 1, G.SHOWN), ""))
    garbage = F.array_compact(F.array(
        F.when(has("�"), "replacement character U+FFFD"), F.when(text.rlike(T.PRIVATE_USE), "private-use character"),
        F.when(text.rlike(letter), F.when(T.once(F.split(text, letter, -1), near), examples)),
    ))
    terms = F.array_compact(F.array(*[F.when(has(t), F.lit(t)) for t in forbidden])) if forbidden else _none("STRING")
    d = d.withColumn("marks", S.marks_of(text))
    return d.select(
        "doc_id", F.transform("marks", lambda m: m["p"].try_cast("int")).alias("pages"), F.transform("marks", lambda m: m["q"].try_cast("int")).alias("printed"), images.alias("images"), S.spans_of(text, F.col("marks")).alias("spans"),
        F.when(has("#"), heads).otherwise(_none("STRUCT<line: INT, level: INT>")).alias("heads"), garbage.alias("garbage"), F.regexp_count(text, F.lit(T.NOTE)).alias("notes"), terms.alias("forbidden"),
        *[c.alias(f"n_{k}") for k, c in M.delimiter_columns().items()],
    )


def with_math(d: DataFrame) -> DataFrame:
    """Adds what spans have wrong: braces, mojibake, prose, artifacts, arrays of findings with messages."""
    place = lambda s: [s["kind"].alias("kind"), s["line"].alias("line"), s["pdf_page"].alias("pdf_page")]
    at = lambda s, said: F.concat(s["kind"], F.lit(" math at line "), s["line"].cast("string"), F.lit(said))
    braced = F.transform(F.filter("spans", lambda s: s["content"].rlike("[{}]")), lambda s: F.struct(s.alias("s"), M.brace_positions(s["content"]).alias("b")))
    braces = F.transform(
        F.filter(braced, lambda x: (F.size(x["b"]["open"]) > 0) | (F.size(x["b"]["close"]) > 0)),
        lambda x: F.struct(
            *place(x["s"]), T.snippet(x["s"]["content"]).alias("snippet"),
            F.struct(x["b"]["open"].alias("unmatched_open_positions"), x["b"]["close"].alias("unmatched_close_positions"), (F.size(x["b"]["open"]) - F.size(x["b"]["close"])).alias("balance")).alias("diagnostics"),
            at(x["s"], " has unbalanced or improperly nested unescaped LaTeX braces").alias("message"),
        ),
    )
    prose = F.transform(F.filter("spans", lambda s: M.without_labels(s["content"]).rlike(T.CJK)), lambda s: F.concat(at(s, " contains likely Chinese prose: "), T.snippet(s["content"], 160)))
    run = lambda s: F.transform(T.matches(s["content"], "(" + T.CJK + "+)", {"run": 1}, s["content"].rlike(T.CJK)), lambda m: F.struct(*place(s), (s["start"] + m["start"]).alias("at"), m["run"].alias("run"), T.snippet(s["content"]).alias("snippet")))
    scored = F.transform(F.filter("spans", lambda s: s["kind"] == "display"), lambda s: F.struct(s.alias("s"), T.once(M.without_labels(s["content"]), lambda b: M.evidence(s["content"], b)).alias("signals")))
    totals = F.transform(scored, lambda x: F.struct(x["s"].alias("s"), x["signals"].alias("signals"), F.aggregate(x["signals"], F.lit(0), lambda a, g: a + g["score"]).alias("score")))
    page = lambda s: F.coalesce(F.concat(F.lit("PDF page "), s["pdf_page"].cast("string")), F.lit("the nearest source page"))
    artifacts = F.transform(
        F.filter(totals, lambda x: x["score"] >= M.WARN_FROM),
        lambda x: F.struct(
            F.when(x["score"] >= M.FAIL_FROM, "FAIL").otherwise("WARN").alias("status"), x["score"].alias("artifact_score"), x["signals"].alias("signals"), x["s"]["pdf_page"].alias("pdf_page"), x["s"]["line"].alias("line"), T.snippet(x["s"]["content"]).alias("snippet"),
            F.concat(page(x["s"]), F.lit(" math block appears to contain flattened extraction artifacts; reopen the source page and visually verify it.")).alias("message"),
        ),
    )
    d = d.withColumns({"braces": braces, "prose": prose, "_runs": F.flatten(F.transform("spans", run)), "artifacts": artifacts})
    d = d.withColumn("_said", M.recovered_runs(F.transform("_runs", lambda r: r["run"])))
    both = F.filter(F.arrays_zip(F.col("_runs").alias("r"), F.col("_said").alias("x")), lambda z: z["x"]["recovered"].isNotNull())
    key = lambda z: F.struct(z["r"]["at"].alias("at"), F.char_length(z["r"]["run"]).alias("n"), z["x"]["recovered"].alias("said"))
    # a run in spans of two kinds is one finding, that of the span before
    first = lambda found: F.filter(found, lambda z, k: F.array_position(F.transform(found, key), key(z)) == k + 1)
    mojibake = F.transform(
        T.once(both, first),
        lambda z: F.struct(
            z["r"]["kind"].alias("kind"), z["r"]["line"].alias("line"), z["r"]["pdf_page"].alias("pdf_page"), z["r"]["run"].alias("span"), z["x"]["recovered"].alias("recovered"), z["x"]["codec"].alias("codec"), z["r"]["snippet"].alias("snippet"),
            F.concat(at(z["r"], " contains likely UTF-8-as-"), z["x"]["codec"], F.lit(" mojibake; validator does not repair the formula")).alias("message"),
        ),
    )
    return d.withColumn("mojibake", mojibake).drop("_runs", "_said", "spans")


def joined(d: DataFrame, inp: Inputs) -> DataFrame:
    """Adds what other tables say of a document: missing, orphans, want, first_printed, last_printed, problems, manifest, state."""
    refs = F.col("images")
    if inp.assets is not None:
        files = inp.assets.groupBy("doc_id").agg(F.array_sort(F.collect_set("path")).alias("_files"))  # the files of one document's folder
        d = d.join(files, "doc_id", "left").withColumn("_files", F.coalesce("_files", _none("STRING")))
        image = lambda x: x.contains(".") & F.lower(F.element_at(F.split(x, r"\."), -1)).isin(*T.IMAGE_SUFFIXES)
        absent = F.array_except(F.array_distinct("images.target"), "_files")
        missing = T.once(absent, lambda gone: F.transform(F.filter(refs, lambda m: m["target"].isNotNull() & F.array_contains(gone, m["target"])), lambda m: m["ref"]))
        d = d.withColumns({"missing": missing, "orphans": F.array_except(F.filter("_files", image), F.array_distinct("images.target"))}).drop("_files")
    else:
        d = d.withColumns({"missing": _none("STRING"), "orphans": _none("STRING")})
    left = lambda d, other, *columns: d.join(other.select("doc_id", *columns), "doc_id", "left")
    d = left(d, inp.expected, F.sequence("first_page", "last_page").alias("want")) if inp.expected is not None else d.withColumn("want", F.lit(None).cast("array<int>"))
    d = left(d, inp.printed, "first_printed", "last_printed") if inp.printed is not None else d.withColumns({c: F.lit(None).cast("int") for c in ("first_printed", "last_printed")})
    if inp.manifests is not None:
        d = left(d, inp.manifests, "path", F.try_parse_json("manifest").alias("v"), F.lit(True).alias("told"))
        d = d.withColumn("refs", F.size("images")).withColumn("problems", F.when(F.col("told"), manifest_problems(d.withColumn("refs", F.size("images"))))).drop("refs", "path")
    else:
        d = d.withColumns({"v": F.lit(None).cast("variant"), "told": F.lit(None).cast("boolean"), "problems": F.lit(None).cast("array<string>")})
    if inp.states is None:
        return d.withColumn("state", F.lit(None).cast("struct<status: string, workflow_status: string, queued: int, pending: int, errors: array<string>, warnings: array<string>>"))
    # rules are held against the states of these documents alone; those of others would meet no row
    told = ST.state_report(inp.states.join(inp.docs.select("doc_id"), "doc_id", "left_semi"))
    return left(d, told, F.struct("status", "workflow_status", "queued", "pending", "errors", "warnings").alias("state"))


def _object(**fields: Column) -> Column:
    return F.to_variant_object(F.struct(*[c.alias(k) for k, c in fields.items()]))


def _plural(c: Column, said: str) -> Column:
    return F.concat(F.size(c).cast("string"), F.lit(said))


def whole_reports(inp: Inputs) -> DataFrame:
    """doc_id, status, summary, pages, printed_pages, missing_images, orphan_assets, duplicate_image_references, checks
    (array<struct<id, status, message, details VARIANT>>), errors, warnings (arrays of messages): one row a document.

    Checks, errors and warnings stand in the order in which they are made. A null or empty text is checked as an empty one; where
    a doc_id repeats each of its rows is a document."""
    d = joined(with_math(scanned(inp.docs, inp.forbidden)), inp)
    c = F.col
    known = F.array_compact("printed")
    outside = F.transform(F.filter("images", lambda m: m["target"].isNull()), lambda m: m["ref"])
    odd = F.concat(F.transform(F.filter("images", lambda m: m["alt"] == ""), lambda m: m["ref"]), F.transform(F.filter("images", lambda m: F.lit(inp.require_stem) & m["target"].isNotNull() & (A.stem(m["ref"]) != m["alt"])), lambda m: m["ref"]))
    rules = M.unbalanced(*[c(f"n_{k}") for k in ("display", "inline", "paren_open", "paren_close", "bracket_open", "bracket_close")])
    said = [F.format_string("unbalanced display-math delimiters: %d occurrences of $$", "n_display"), F.format_string("unbalanced inline-math delimiters: %d unescaped $ markers", "n_inline")]
    said += [F.format_string(rf"unbalanced {sign} delimiters: %d open vs %d close", f"n_{k}_open", f"n_{k}_close") for sign, k in ((r"\\( \\)", "paren"), (r"\\[ \\]", "bracket"))]
    jumps = F.transform(_steps(c("heads"), lambda p: p["b"]["level"] > p["a"]["level"] + 1), lambda p: F.format_string("heading level jumps from H%d to H%d at line %d", p["a"]["level"], p["b"]["level"], p["b"]["line"]))
    d = d.withColumns({
        "known": known, "outside": outside, "twice": _twice(c("images.ref")), "odd": odd, "again": _twice(c("pages")), "gaps": F.when(F.size("pages") > 0, F.array_sort(F.array_except("want", "pages"))),
        "delimiters": F.array_compact(F.array(*[F.when(r, m) for r, m in zip(rules, said, strict=True)])), "headings": F.when(F.size("heads") == 0, F.array(F.lit("Markdown has no headings"))).otherwise(jumps),
        "breaks": F.transform(_steps(known, lambda p: p["b"] != p["a"] + 1), lambda p: F.array(p["a"], p["b"])), "bad": F.filter("artifacts", lambda x: x["status"] == "FAIL"),
        "ratio": F.round(c("notes") / F.greatest(F.lit(1), F.size("pages")), 4), "many": (c("notes") >= 10) & ((c("notes") / F.greatest(F.lit(1), F.size("pages")) >= 0.20) | (c("notes") >= 25)),
    })
    some = lambda n: F.size(c(n)) > 0
    covered, no_want = c("pages") == c("want"), c("want").isNull()
    unknown = F.lit(inp.require_printed) & (F.size("known") != F.size("pages"))
    in_range = F.coalesce((F.try_element_at("known", F.lit(1)) == c("first_printed")) & (F.try_element_at("known", F.lit(-1)) == c("last_printed")), F.lit(False))
    empty = F.parse_json(F.lit("{}"))

    def check(name: str, *cases: tuple[Column | None, str, Column | str, Column]) -> Column:
        """A check whose first case that holds gives status, message and details; the last one holds always if its condition is None."""
        out = None
        for cond, status, message, details in cases:
            row = F.struct(F.lit(name).alias("id"), F.lit(status).alias("status"), (message if isinstance(message, Column) else F.lit(message)).alias("message"), details.alias("details"))
            out = (F.when(cond, row) if out is None else out.when(cond, row)) if cond is not None else (row if out is None else out.otherwise(row))
        return F.array_compact(F.array(out))

    broken, gap, state = c("told") & c("v").isNull(), F.size(F.coalesce("gaps", _none("INT"))) > 0, c("state")
    checks = F.concat(
        check("images.exists", (some("missing"), "FAIL", "referenced image(s) are missing", _object(paths=c("missing"))), (None, "PASS", "all local image references exist", _object(count=F.size("images")))),
        check("images.path_safety", (some("outside"), "FAIL", "image paths escape the Markdown directory", _object(paths=c("outside"))), (None, "PASS", "image paths stay inside the Markdown directory", empty)),
        check("images.duplicates", (some("twice"), "WARN", "duplicate image references found", _object(paths=c("twice"))), (None, "PASS", "no duplicate image references", empty)),
        check("images.alt", (some("odd"), "WARN", "image alt text is incomplete or unstable", _object(paths=c("odd"))), (None, "PASS", "image alt text is present", empty)),
        check("images.orphans", (some("orphans"), "WARN", "orphan visual assets found", _object(paths=c("orphans"))), (None, "PASS", "no orphan visual assets", empty)),
        check(
            "pages.coverage", (covered, "PASS", "page markers exactly cover the requested pages", _object(pages=c("pages"))), (~no_want, "FAIL", "page marker coverage mismatch", _object(actual=c("pages"), expected=c("want"))),
            (some("pages"), "PASS", "PDF page markers are present", _object(count=F.size("pages"))), (None, "WARN", "no PDF page markers found", empty),
        ),
        check("pages.duplicates", (some("again"), "FAIL", "duplicate PDF page markers found", _object(pages=c("again"))), (None, "PASS", "no duplicate PDF page markers", empty)),
        check("pages.continuity", (~no_want & some("pages") & gap, "WARN", "page marker gaps detected", _object(gaps=c("gaps"))), (~no_want & some("pages"), "PASS", "page marker continuity is acceptable", empty)),
        check(
            "pages.printed", (unknown, "WARN", "printed page mapping is incomplete", empty), ((F.size("known") >= 2) & some("breaks"), "WARN", "printed page continuity needs review", _object(transitions=c("breaks"))),
            (F.size("known") >= 2, "PASS", "printed page sequence is continuous where known", empty), (None, "PASS", "printed page mapping is optional or insufficient to check", empty),
        ),
        check("pages.printed_range", (c("first_printed").isNotNull() & in_range, "PASS", "printed page range matches the requested range", empty), (c("first_printed").isNotNull(), "FAIL", "printed page range mismatch", _object(actual=c("known")))),
        check("math.delimiters", (some("delimiters"), "FAIL", "LaTeX delimiters are unbalanced", _object(errors=c("delimiters"))), (None, "PASS", "LaTeX delimiters are balanced", empty)),
        check("math.braces", (some("braces"), "FAIL", "unbalanced or improperly nested LaTeX braces; validator does not repair formulas", _object(findings=c("braces"))), (None, "PASS", "all math spans have balanced unescaped LaTeX braces", empty)),
        check("math.mojibake", (some("mojibake"), "FAIL", "likely UTF-8-as-GBK mojibake found inside math; validator does not repair formulas", _object(findings=c("mojibake"))), (None, "PASS", "no likely UTF-8-as-GBK mojibake inside math", empty)),
        check("math.chinese_prose", (some("prose"), "FAIL", "math block(s) contain likely Chinese prose; visually recheck the source page", _object(blocks=c("prose"))), (None, "PASS", "no obvious Chinese prose inside math", empty)),
        check(
            "math.extraction_artifact",
            *[(cond, word, "reopen each flagged source page and visually verify the formula; validator does not repair formulas", _object(findings=c("artifacts"), pdf_pages=F.array_sort(F.array_distinct(F.array_compact("artifacts.pdf_page"))))) for cond, word in ((some("bad"), "FAIL"), (some("artifacts"), "WARN"))],
            (None, "PASS", "no high-probability formula extraction artifacts", empty),
        ),
        check("markdown.headings", (some("headings"), "WARN", "Markdown heading structure needs review", _object(details=c("headings"))), (None, "PASS", "Markdown heading structure is present", empty)),
        check("text.garbage", (some("garbage"), "FAIL", "suspicious Unicode garbage found; recheck the source page", _object(patterns=c("garbage"))), (None, "PASS", "no obvious extraction garbage", empty)),
        check("notes.excessive", (c("many"), "WARN", "excessive unresolved transcription notes; resolve visually when possible", _object(count=c("notes"), page_ratio=c("ratio"))), (None, "PASS", "transcription note volume is not excessive", _object(count=c("notes"), page_ratio=c("ratio")))),
        F.when(some("forbidden"), F.transform("forbidden", lambda t: F.struct(F.lit("text.forbidden").alias("id"), F.lit("FAIL").alias("status"), F.lit("forbidden residual text found").alias("message"), _object(value=t).alias("details")))).otherwise(check("text.forbidden", (None, "PASS", "no forbidden residual text found", empty))),
        check(
            "manifest.consistency", (broken, "FAIL", "manifest is not valid JSON", _object(present=F.lit(False))), (some("problems"), "FAIL", F.array_join("problems", "; "), _object(present=F.lit(True), problems=c("problems"), manifest=c("v"))),
            (c("told"), "PASS", "optional manifest is consistent", _object(present=F.lit(True), problems=c("problems"), manifest=c("v"))), (None, "PASS", "no optional manifest supplied", _object(present=F.lit(False))),
        ),
        check(
            "workflow.state", (state.isNotNull() & state["queued"].isNull(), "FAIL", "conversion state could not be read", _object(error=F.get(state["errors"], F.lit(0)))),
            *[(state.isNotNull() & (state["status"] == s), s, m, _object(workflow_status=state["workflow_status"], visual_review_required=state["queued"], pending_review=state["pending"])) for s, m in (("PASS", "conversion workflow state is structurally valid"), ("WARN", "conversion workflow state needs review"), ("FAIL", "conversion workflow state needs review"))],
        ),
    )
    one = lambda cond, message: F.when(cond, F.array(message if isinstance(message, Column) else F.lit(message))).otherwise(_none("STRING"))
    of_state = lambda f: F.coalesce(state[f], _none("STRING"))
    errors = F.concat(
        one(some("missing"), _plural(c("missing"), " referenced image(s) are missing")), one(some("outside"), _plural(c("outside"), " image reference(s) escape the Markdown directory")),
        one(~no_want & ~F.coalesce(covered, F.lit(False)), F.concat(F.lit("page markers "), listed(c("pages")), F.lit(" do not match requested pages "), listed(c("want")))), one(some("again"), F.concat(F.lit("duplicate page markers: "), listed(c("again")))),
        one(c("first_printed").isNotNull() & ~in_range, F.concat(F.lit("printed page range does not match requested range "), listed(F.array("first_printed", "last_printed")))), c("delimiters"), one(some("braces"), _plural(c("braces"), " math block(s) have unbalanced LaTeX braces")),
        one(some("mojibake"), _plural(c("mojibake"), " math block(s) contain likely UTF-8-as-GBK mojibake")), one(some("prose"), _plural(c("prose"), " math block(s) contain likely Chinese prose")), one(some("bad"), _plural(c("bad"), " high-confidence formula extraction artifact(s) require visual recheck")),
        one(some("garbage"), F.concat(F.lit("suspicious Unicode garbage requires visual recheck: "), F.array_join("garbage", ", "))), F.transform("forbidden", lambda t: F.concat(F.lit("forbidden residual text found: '"), t, F.lit("'"))), one(some("problems"), F.array_join("problems", "; ")), of_state("errors"),
    )
    warnings = F.concat(
        one(some("twice"), _plural(c("twice"), " image path(s) are referenced more than once")), one(some("odd"), _plural(c("odd"), " image alt/path issue(s) need review")), one(some("orphans"), _plural(c("orphans"), " visual asset(s) are not referenced by Markdown")),
        one(no_want & ~some("pages"), "no PDF page markers found"), one(~no_want & gap, F.concat(F.lit("page marker gaps detected: "), listed(c("gaps")))),
        one(unknown, F.concat((F.size("pages") - F.size("known")).cast("string"), F.lit(" printed page marker(s) are unknown"))), one(~unknown & (F.size("known") >= 2) & some("breaks"), "printed page numbers are not continuous where known"),
        one(some("artifacts") & ~some("bad"), _plural(c("artifacts"), " formula block(s) may contain extraction artifacts and require visual recheck")), c("headings"),
        one(c("many"), F.concat(F.lit("excessive unresolved transcription notes: "), c("notes").cast("string"), F.lit(" note(s) across "), F.size("pages").cast("string"), F.lit(" page marker(s)"))), of_state("warnings"),
    )
    summary = F.struct(
        F.size("images").alias("image_references"), F.size(F.array_distinct("images.ref")).alias("unique_image_references"), F.size("orphans").alias("orphan_assets"), F.size("pages").alias("page_markers"), c("n_inline").alias("inline_math_markers"), F.floor(c("n_display") / 2).alias("display_math_blocks"),
        F.size("braces").alias("suspicious_math_braces"), F.size("mojibake").alias("suspicious_math_mojibake"), F.size("prose").alias("suspicious_math_blocks"), F.size("artifacts").alias("suspicious_formula_artifact"), c("notes").alias("transcription_notes"), F.size("garbage").alias("suspicious_garbage"),
        F.size("heads").alias("headings"), F.lit(inp.require_printed).alias("printed_page_check_required"), state["workflow_status"].alias("workflow_status"), state["queued"].alias("visual_review_required"), state["pending"].alias("pending_review"),
    )
    out = d.select(
        "doc_id", summary.alias("summary"), "pages", c("printed").alias("printed_pages"), c("missing").alias("missing_images"), c("orphans").alias("orphan_assets"), c("twice").alias("duplicate_image_references"), checks.alias("checks"), errors.alias("errors"), warnings.alias("warnings"),
    )
    return out.withColumn("status", F.when(some("errors"), "FAIL").when(some("warnings"), "WARN").otherwise("PASS"))


def message_rows(reports: DataFrame) -> DataFrame:
    """doc_id, ord, severity, message: errors, then warnings, in the report's order."""
    of = lambda severity, column: F.transform(column, lambda m: F.struct(F.lit(severity).alias("severity"), m.alias("message")))
    return reports.select("doc_id", F.posexplode(F.concat(of("error", "errors"), of("warning", "warnings"))).alias("ord", "m")).select("doc_id", "ord", "m.severity", "m.message")


def check_rows(reports: DataFrame) -> DataFrame:
    """doc_id, ord, check_id, status, message, details (JSON): the checks in the report's order."""
    rows = reports.select("doc_id", F.posexplode("checks").alias("ord", "c"))
    return rows.select("doc_id", "ord", F.col("c.id").alias("check_id"), "c.status", "c.message", F.to_json("c.details").alias("details"))


def artifact_rows(reports: DataFrame) -> DataFrame:
    """doc_id, ord, status, artifact_score, signal, points, evidence (JSON), pdf_page, line, snippet, message: a row for each signal of
    each flattened formula, read back from the details of its check."""
    found = reports.select("doc_id", F.explode(F.filter("checks", lambda x: x["id"] == "math.extraction_artifact")).alias("c")).select("doc_id", F.posexplode(ST.items(ST.get("c.details", "findings"))).alias("ord", "f"))
    signals = found.select("doc_id", "ord", "f", F.explode(ST.items(ST.get("f", "signals"))).alias("s"))
    text, number = lambda v, f: F.try_variant_get(v, "$." + f, "string"), lambda v, f: F.try_variant_get(v, "$." + f, "int")
    return signals.select("doc_id", "ord", text("f", "status").alias("status"), number("f", "artifact_score").alias("artifact_score"), text("s", "id").alias("signal"), number("s", "score").alias("points"), F.to_json(ST.get("s", "evidence")).alias("evidence"), number("f", "pdf_page").alias("pdf_page"), number("f", "line").alias("line"), text("f", "snippet").alias("snippet"), text("f", "message").alias("message"))


def as_json(reports: DataFrame) -> DataFrame:
    """doc_id, json: each report as a JSON object, schema_version 2; details stand in their checks. Nulls are kept."""
    # a check's own fields and those of its details are one object
    head = lambda x: F.regexp_replace(F.to_json(F.struct(x["id"].alias("id"), x["status"].alias("status"), x["message"].alias("message"))), r"\}$", "")
    inner = F.transform("checks", lambda x: F.regexp_replace(F.concat(head(x), F.lit(","), F.regexp_replace(F.to_json(x["details"]), r"^\{", "")), r",\}$", "}"))
    rest = F.to_json(F.struct(F.lit(2).alias("schema_version"), *[F.col(n) for n in ("doc_id", "status", "summary", "pages", "printed_pages", "missing_images", "orphan_assets", "duplicate_image_references", "errors", "warnings")]), {"ignoreNullFields": "false"})
    return reports.select("doc_id", F.concat(F.regexp_replace(rest, r"\}$", ""), F.lit(',"checks":['), F.array_join(inner, ","), F.lit("]}")).alias("json"))
