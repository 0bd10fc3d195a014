"""Rules of a review state: a JSON object a document, kept as VARIANT, since rules tell missing, wrong and empty apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T

# The vocabulary of states and decisions.
STATUSES = ("in_progress", "needs_review", "visual_review", "completed", "completed_with_review_items")
FINAL = ("completed", "completed_with_review_items")
DISPOSITIONS = ("latex_confirmed", "crop_only", "confirmed_text_only", "not_formula", "markdown_sufficient", "removed")
RUNNER_DISPOSITIONS = ("latex_confirmed", "crop_only", "not_formula", "removed", "markdown_sufficient")
VISUAL = ("latex_confirmed", "crop_only", "not_formula", "removed")
UNREVIEWED = ("需回看", "待视觉", "待复核", "以后复核", "需要打开原页", "confirm later", "review later", "reopen the pdf", "reopen source page")


def get(v: Column | str, path: str) -> Column:
    return F.try_variant_get(v, "$." + path, "variant")


def kind(v: Column) -> Column:
    """object, array, string, int, bool, null or other; SQL null if missing."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
        .when(s == "BIGINT", "int").when(s == "BOOLEAN", "bool").when(s == "VOID", "null").otherwise("other")
    )


def is_kind(v: Column, k: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(_SCHEMAS[k])), F.lit(False))


class Field:
    """A field of a state that is looked at several times: read once into a struct, whose parts the rules ask for."""

    def __init__(self, name: str):
        self.c = F.col(name)

    @staticmethod
    def read(v: Column) -> Column:
        return F.struct(v.alias("v"), F.schema_of_variant(v).alias("t"), F.try_variant_get(v, "$", "string").alias("s"), F.try_variant_get(v, "$", "bigint").alias("i"))

    @property
    def value(self) -> Column:
        return self.c["v"]

    @property
    def given(self) -> Column:
        return self.c["t"].isNotNull()

    def is_kind(self, k: str) -> Column:
        return F.coalesce(F.startswith(self.c["t"], F.lit(_SCHEMAS[k])), F.lit(False))

    @property
    def text(self) -> Column:
        return F.when(self.is_kind("string"), self.c["s"])

    @property
    def filled(self) -> Column:
        return F.coalesce(T.strip(self.text) != "", F.lit(False))

    @property
    def integer(self) -> Column:
        return F.when(self.is_kind("int"), self.c["i"])

    @property
    def items(self) -> Column:
        return items(self.value)


#: How the schema of each kind of value begins.
_SCHEMAS = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "int": "BIGINT", "bool": "BOOLEAN", "null": "VOID"}


def with_fields(d: DataFrame, v: Column, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, Field]]:
    """d with a column for each field of v."""
    return d.withColumns({f"_f_{n}": Field.read(get(v, n)) for n in names}), {n: Field(f"_f_{n}") for n in names}


def text_of(v: Column) -> Column:
    """A string's text; null for anything else."""
    return F.when(is_kind(v, "string"), F.try_variant_get(v, "$", "string"))


def filled(v: Column) -> Column:
    return F.coalesce(T.strip(text_of(v)) != "", F.lit(False))


def int_of(v: Column) -> Column:
    """An integer's value; null for anything else, booleans too."""
    return F.when(is_kind(v, "int"), F.try_variant_get(v, "$", "bigint"))


def page_of(c: Column) -> Column:
    """A page number from text, null if it isn't one (or beyond 32 bits)."""
    return T.integer(c).try_cast("int")


def number_of(v: Column) -> Column:
    """What int() makes of a value: integers, booleans, decimal numbers without their fraction, texts of integers. Null for anything else."""
    def read(x: Column) -> Column:
        number = F.try_variant_get(x, "$", "double")
        return (
            F.when(is_kind(x, "int"), F.try_variant_get(x, "$", "bigint")).when(is_kind(x, "string"), T.integer(F.try_variant_get(x, "$", "string"))).when(is_kind(x, "bool"), F.try_variant_get(x, "$", "boolean").cast("bigint"))
            .when(F.schema_of_variant(x).rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("bigint"))
        )

    return T.once(v, read)


def items(v: Column) -> Column:
    """An array's elements; an empty one for anything else."""
    return F.coalesce(F.when(is_kind(v, "array"), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def fields(v: Column) -> Column:
    """An object's fields as a map; an empty one for anything else."""
    return F.coalesce(F.when(is_kind(v, "object"), F.try_variant_get(v, "$", "map<string,variant>")), F.create_map().cast("map<string,variant>"))


def length(v: Column) -> Column:
    return F.size(items(v))


def parsed(states: DataFrame) -> DataFrame:
    """(doc_id, state JSON) to doc_id, v, readable: v is null where the text is no JSON object."""
    d = states.select("doc_id", F.try_parse_json("state").alias("v"))
    return d.select("doc_id", F.when(is_kind(F.col("v"), "object"), F.col("v")).alias("v"), is_kind(F.col("v"), "object").alias("readable"))


def place(part: int, key: Column, at: Column) -> Column:
    """Where an entry of a state stands: its part, its page's name there, its number."""
    return F.struct(F.lit(part).alias("part"), key.alias("key"), at.cast("int").alias("at"))


def decisions(states: DataFrame) -> DataFrame:
    """doc_id, page (null if none or no number), ord, d: standalone decisions, then those of the page map (one decision or its list
    `formulas`), pages in the order of their names; ord sorts them."""
    alone = states.select("doc_id", F.lit(None).cast("int").alias("page"), F.posexplode(items(get("v", "formula_decisions"))).alias("at", "d")).select("doc_id", "page", place(0, F.lit(""), F.col("at")).alias("ord"), "d")
    paged = states.select("doc_id", F.explode(fields(get("v", "visual_review_decisions"))).alias("k", "p")).filter(is_kind(F.col("p"), "object"))
    one = F.when(get("p", "disposition").isNotNull(), F.array("p")).otherwise(items(get("p", "formulas")))
    rows = paged.select("doc_id", page_of(F.col("k")).alias("page"), "k", F.posexplode(one).alias("at", "d"))
    return alone.unionByName(rows.select("doc_id", "page", place(1, F.col("k"), F.col("at")).alias("ord"), "d"))


def rules(conditions: list[tuple[Column, Column | str]]) -> Column:
    """The messages of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for c, m in conditions]))


def _bad_list(v: Column) -> Column:
    return F.exists(items(v), lambda x: F.coalesce(int_of(x), F.lit(0)) <= 0)


def decision_errors(entries: DataFrame, states: DataFrame) -> DataFrame:
    """doc_id, page, ord, k, error: the provenance rules of each decision in their order. Context is asked for only where the state has candidate records."""
    lists = F.filter(F.map_entries(fields(get("v", "formula_candidate_records"))), lambda e: page_of(e["key"]).isNotNull() & is_kind(e["value"], "array"))
    flags = states.select("doc_id", (F.size(lists) > 0).alias("_context"))
    names = ("disposition", "verification", "source_asset", "source_pdf_page", "context_asset", "context_type", "source_candidates", "candidate_id", "latex", "unresolved_reason", "reason", "candidate_index")
    d_, f = with_fields(entries.join(flags, "doc_id"), F.col("d"), names)
    d_ = d_.withColumns({"disposition": f["disposition"].text, "_object": is_kind(F.col("d"), "object"), "_n": F.size(f["source_candidates"].items)})
    what = F.coalesce(F.col("disposition"), F.lit(""))
    at = F.when(F.col("page").isNotNull(), F.format_string(" on PDF page %d", "page")).otherwise("")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    seen, context = what.isin(*VISUAL), F.col("_context") & what.isin(*VISUAL)
    path = f["context_asset"].text
    relative = f["context_asset"].filled & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")
    source = f["source_asset"].filled | (F.coalesce(f["source_pdf_page"].integer, F.lit(0)) > 0)
    reason = F.when(f["reason"].given, f["reason"].filled).otherwise(f["unresolved_reason"].filled)
    index = f["candidate_index"]
    known = rules([
        (seen & (F.coalesce(f["verification"].text, F.lit("")) != "visual"), say(what, " formula decision", at, " lacks verification: visual")),
        (seen & ~source, say(what, " formula decision", at, " lacks source_asset or source_pdf_page")),
        (context & ~F.coalesce(relative, F.lit(False)), say(what, " formula decision", at, " lacks relative context_asset")),
        (context & ~F.coalesce(f["context_type"].text.isin("line", "region"), F.lit(False)), say(what, " formula decision", at, " lacks context_type line/region")),
        (context & (F.col("_n") == 0), say(what, " formula decision", at, " lacks source_candidates")),
        (context & (F.col("_n") > 0) & _bad_list(f["source_candidates"].value), say(what, " formula decision", at, " has invalid source_candidates")),
        (context & ~f["candidate_id"].filled, say(what, " formula decision", at, " lacks candidate_id")),
        ((what == "latex_confirmed") & ~f["latex"].filled, say("latex_confirmed formula decision", at, " lacks non-empty latex")),
        ((what == "crop_only") & ~f["unresolved_reason"].filled, say("crop_only formula decision", at, " lacks unresolved_reason")),
        (what.isin("not_formula", "removed") & ~reason, say(what, " formula decision", at, " lacks a concrete reason")),
        (index.given & ~index.is_kind("null") & (F.coalesce(index.integer, F.lit(0)) <= 0), say("formula decision", at, " has invalid candidate_index")),
    ])
    shown = F.when(F.col("disposition").isNotNull(), F.concat(F.lit("'"), F.col("disposition"), F.lit("'"))).otherwise(F.coalesce(F.to_json(f["disposition"].value), F.lit("None")))
    errors = (
        F.when(~F.col("_object"), F.array(say("formula decision", at, " must be an object")))
        .when(what == "conservative_latex", F.array(say("formula decision", at, " uses legacy conservative_latex; use latex_confirmed")))
        .when(~what.isin(*DISPOSITIONS), F.array(say("formula decision", at, " has unknown disposition: ", shown)))
        .otherwise(known)
    )
    return d_.select("doc_id", "page", "ord", F.posexplode(errors).alias("k", "error"))


def verified_page_errors(entries: DataFrame, states: DataFrame) -> DataFrame:
    """doc_id, page, error: verified pages whose candidates and decisions don't match in number, and what isn't a page."""
    raw = get("v", "visual_verified_pdf_pages")
    no_list = states.filter(raw.isNotNull() & ~is_kind(raw, "array")).select("doc_id", F.lit(None).cast("int").alias("page"), F.lit("visual_verified_pdf_pages must be a list").alias("error"))
    listed = states.select("doc_id", F.explode(items(raw)).alias("x")).withColumn("page", number_of(F.col("x")).try_cast("int"))
    odd = listed.filter(F.col("page").isNull()).select("doc_id", "page", F.concat(F.lit("visual_verified_pdf_pages contains a non-integer page: "), F.coalesce(F.concat(F.lit("'"), text_of(F.col("x")), F.lit("'")), F.to_json("x"))).alias("error"))
    asked = states.select("doc_id", F.explode(fields(get("v", "formula_candidates"))).alias("k", "c")).select("doc_id", page_of(F.col("k")).alias("page"), length(F.col("c")).alias("n")).filter("page IS NOT NULL AND n > 0")
    given = entries.filter(F.col("page").isNotNull()).groupBy("doc_id", "page").agg(F.count("*").alias("m"))
    both = listed.filter(F.col("page").isNotNull()).select("doc_id", "page").join(asked, ["doc_id", "page"]).join(given, ["doc_id", "page"], "left")
    message = F.when(F.col("m").isNull(), F.format_string("visually_verified PDF page %d lacks formula decisions", "page")).when(F.col("m") != F.col("n"), F.format_string("visually_verified PDF page %d has %d formula decisions for %d formula candidate(s)", "page", "m", "n"))
    return no_list.unionByName(odd).unionByName(both.select("doc_id", "page", message.alias("error")).filter(F.col("error").isNotNull()))


def pending_errors(states: DataFrame) -> DataFrame:
    """doc_id, ord, k, error: items of pending_review must say what was seen and is unresolved."""
    d = states.select("doc_id", F.posexplode(items(get("v", "pending_review"))).alias("ord", "i"))
    d, f = with_fields(d, F.col("i"), ("pdf_page", "type", "kind", "status", "reason"))
    label = F.format_string("pending_review[%d]", "ord")
    truthy = lambda x: x.given & ~F.coalesce(F.to_json(x.value).isin('""', "null", "false", "0", "[]", "{}"), F.lit(False))
    reason = T.casefold(f["reason"].text)
    unreviewed = F.exists(F.array(*map(F.lit, UNREVIEWED)), lambda p: F.contains(reason, p))
    of_object = rules([
        (F.coalesce(f["pdf_page"].integer, F.lit(0)) <= 0, F.concat(label, F.lit(" must identify a positive integer pdf_page"))),
        (~(truthy(f["type"]) | truthy(f["kind"])), F.concat(label, F.lit(" must identify its type or kind"))),
        (F.coalesce(f["status"].text, F.lit("")) != "visually_reviewed_unresolved", F.concat(label, F.lit(" must use status: visually_reviewed_unresolved"))),
        (~f["reason"].filled, F.concat(label, F.lit(" must contain a concrete reason"))),
        (f["reason"].filled & unreviewed, F.concat(label, F.lit(" reason still describes unperformed visual review"))),
    ])
    errors = F.when(is_kind(F.col("i"), "object"), of_object).otherwise(F.array(F.concat(label, F.lit(" must be an object with a concrete PDF page and reason"))))
    return d.select("doc_id", "ord", F.posexplode(errors).alias("k", "error"))


def workflow(states: DataFrame) -> DataFrame:
    """doc_id, workflow_status, queued, pending, errors, warnings: the rules on status and queues."""
    d, f = with_fields(states, F.col("v"), ("visual_review_required", "pending_review", "status"))
    queue, pending, status = (f[n] for n in ("visual_review_required", "pending_review", "status"))
    shown = F.coalesce(F.concat(F.lit("'"), status.text, F.lit("'")), F.to_json(status.value), F.lit("None"))
    d = d.select("doc_id", status.text.alias("workflow_status"), F.size(queue.items).alias("queued"), F.size(pending.items).alias("pending"), (queue.given & ~queue.is_kind("array")).alias("_q"), (pending.given & ~pending.is_kind("array")).alias("_p"), shown.alias("_s"))
    s = F.coalesce(F.col("workflow_status"), F.lit(""))
    errors = rules([
        (~s.isin(*STATUSES), F.concat(F.lit("unknown conversion workflow status: "), F.col("_s"))),
        (F.col("_q"), "visual_review_required must be a list"),
        (F.col("_p"), "pending_review must be a list"),
        (s.isin(*FINAL) & (F.col("queued") > 0), "a final workflow state cannot retain visual_review_required pages"),
    ])
    warnings = rules([
        (s.isin(*FINAL) & (F.col("pending") > 0), F.format_string("final workflow state reports %d unresolved pending_review item(s)", "pending")),
        ((s == "completed") & (F.col("pending") > 0), "completed state has unresolved pending_review items; prefer completed_with_review_items"),
        ((s == "completed_with_review_items") & (F.col("pending") == 0), "completed_with_review_items has no pending_review items"),
        ((s == "visual_review") & (F.col("queued") == 0), "visual_review has no queued pages"),
    ])
    return d.select("doc_id", "workflow_status", "queued", "pending", errors.alias("errors"), warnings.alias("warnings"))


def state_report(raw: DataFrame) -> DataFrame:
    """doc_id, status, workflow_status, queued, pending, n_decisions, errors, warnings of (doc_id, state JSON).

    Errors are those of status and queues, then of decisions, verified pages and pending items, each in their order. A text
    that is no JSON object fails with the error that it could not be read."""
    states = parsed(raw)
    good = states.filter("readable")
    entries = decisions(good)
    placed = lambda d, part, ordinal, k: d.select("doc_id", F.struct(F.lit(part).alias("part"), ordinal.alias("ord"), k.alias("k"), F.col("error")).alias("e"))
    found = placed(decision_errors(entries, good), 0, F.col("ord"), F.col("k")).unionAll(placed(verified_page_errors(entries, good), 1, place(0, F.lit(""), F.coalesce("page", F.lit(0))), F.lit(0))).unionAll(placed(pending_errors(good), 2, place(0, F.lit(""), F.col("ord")), F.col("k")))
    more = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["error"]).alias("_more"))
    counted = entries.groupBy("doc_id").agg(F.count("*").alias("n_decisions"))
    none = F.array().cast("array<string>")
    d = workflow(good).join(more, "doc_id", "left").join(counted, "doc_id", "left")
    d = d.select("doc_id", "workflow_status", "queued", "pending", F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"), F.concat("errors", F.coalesce("_more", none)).alias("errors"), "warnings")
    unread = states.filter("NOT readable").select("doc_id", F.lit(None).cast("string").alias("workflow_status"), F.lit(None).cast("int").alias("queued"), F.lit(None).cast("int").alias("pending"), F.lit(0).cast("long").alias("n_decisions"), F.array(F.lit("conversion state could not be read")).alias("errors"), none.alias("warnings"))
    status = F.when(F.size("errors") > 0, "FAIL").when(F.size("warnings") > 0, "WARN").otherwise("PASS")
    return d.unionByName(unread).withColumn("status", status)
