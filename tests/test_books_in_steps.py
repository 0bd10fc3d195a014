"""Books page by page as a stream, legal status changes, stale crops, and what a book may be."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import layout, merge
from pagewright.sources import files
from pagewright.streaming import books

PAGES = [(d, p, 3 + d, ["look"] if (d + p) % 4 == 0 else [], f"s{p}" if p % 2 else None) for d in range(4) for p in range(1, 4 + d)]


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", books.ROCKSDB)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def state_by_hand(rows):
    out = {}
    for d in {r[0] for r in rows}:
        mine = sorted({r[1]: r for r in rows if r[0] == d}.values(), key=lambda r: r[1])
        queued = sum(bool(r[3]) for r in mine)
        ended = len(mine) >= mine[0][2]
        out[d] = (len(mine), queued, "in_progress" if not ended else "visual_review" if queued else "completed")
    return out


def test_a_book_goes_on_where_it_stopped(store, tmp_path):
    spark, (source, sink, checkpoint) = store, (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    add = lambda rows: spark.createDataFrame(rows, books.PAGE).coalesce(1).write.mode("append").parquet(source)
    first = [r for r in PAGES if r[1] <= 2]
    add(first)
    books.follow(spark, source, sink, checkpoint).awaitTermination(180)
    seen = sorted(map(tuple, books.trace(spark, sink).collect()), key=str)
    assert {r.doc_id: (r.pages, r.queued, r.status) for r in books.states(books.trace(spark, sink)).collect()} == state_by_hand(first)
    # the driver stopped after the batch was written and before it was marked as done: the batch runs again
    marks = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))
    marks[-1].unlink()
    for crc in (tmp_path / "state" / "commits").glob(f".{marks[-1].name}.crc"):
        crc.unlink()
    books.follow(spark, source, sink, checkpoint).awaitTermination(180)
    assert sorted(map(tuple, books.trace(spark, sink).collect()), key=str) == seen
    # pages that came before come again with the rest
    add([r for r in PAGES if r[1] >= 2])
    books.follow(spark, source, sink, checkpoint).awaitTermination(180)
    events = books.trace(spark, sink)
    assert {r.doc_id: (r.pages, r.queued, r.status) for r in books.states(events).collect()} == state_by_hand(PAGES)
    assert events.count() == len(PAGES) == events.select("doc_id", "page").distinct().count() and books.illegal_steps(events).collect() == []
    steps = {}
    for r in events.orderBy("doc_id", "step").collect():
        steps.setdefault(r.doc_id, []).append((r.step, r.done))
    assert all(v == [(k + 1, k + 1) for k in range(len(v))] for v in steps.values())


def test_illegal_steps(spark):
    traces = {0: ["in_progress", "visual_review", "completed"], 1: ["completed"], 2: ["in_progress", "completed_with_review_items"], 3: ["in_progress", "completed", "visual_review"], 4: ["in_progress", None, "completed"], 5: ["in_progress", "completed", "in_progress", "odd"], 6: []}
    rows = [(d, k, s) for d, t in traces.items() for k, s in enumerate(t)]
    got = {r.doc_id: (r.step, r.before, r.status) for r in books.illegal_steps(spark.createDataFrame(rows, "doc_id long, step int, status string")).collect()}
    assert got == {1: (0, None, "completed"), 2: (1, "in_progress", "completed_with_review_items"), 3: (2, "completed", "visual_review"), 4: (1, "in_progress", None), 5: (3, "in_progress", "odd")}


def test_stale_crops_are_planned_and_deleted(spark, tmp_path):
    names = ["assets/pdf_page_001_visual_01.png", "assets/pdf_page_002_formula_01.png", "assets/pdf_page_002_formula_02_context.png", "assets/photo.png", "assets/old/pdf_page_001_visual_01.png", "pdf_page_001_visual_01.png"]
    for n in names:
        (tmp_path / "b" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "b" / n).write_bytes(b"1")
    listed = files.list_assets(spark, str(tmp_path), spark.createDataFrame([("b",)], "doc_id string"))
    kept = spark.createDataFrame([("b", names[1])], "doc_id string, path string")
    plan = layout.stale_crops(listed, kept)
    assert sorted(r.path for r in plan.collect()) == [names[0], names[2]] and all((tmp_path / "b" / n).exists() for n in names)
    gone = plan.union(spark.createDataFrame([("b", "assets/not_there.png")], "doc_id string, path string"))
    assert all(r.error is None for r in files.delete(gone, str(tmp_path)).collect())
    assert [n for n in names if (tmp_path / "b" / n).exists()] == [names[1], *names[3:]]


def test_a_book_that_is_too_large_stays_in_pieces(spark, monkeypatch):
    pieces = spark.createDataFrame([(0, 0, "abc"), (0, 1, "def"), (1, 0, "x")], "doc_id long, k int, piece string")
    assert {r.doc_id: r.text for r in merge.book_texts(pieces).collect()} == {0: "abcdef", 1: "x"}
    monkeypatch.setattr(merge, "MOST_CHARS", 5)
    with pytest.raises(Exception, match="too large"):
        merge.book_texts(pieces).collect()


def test_accepted_decisions_fall_back_on_the_unresolved_reason(spark):
    records = spark.createDataFrame([(0, 1, k, k + 1, f"id{k + 1}", t, "a.png", "c.png", "line", [k + 1]) for k, t in enumerate(["x", "y", "z"])], "doc_id long, page int, ord int, candidate_index int, candidate_id string, candidate string, source_asset string, context_asset string, context_type string, source_candidates array<int>")
    given = [{"disposition": "removed", "unresolved_reason": "u"}, {"disposition": "not_formula", "reason": "r", "unresolved_reason": "u"}, {"disposition": "latex_confirmed", "latex": " "}]
    supplied = spark.createDataFrame([(0, 1, k, json.dumps(g | {"candidate_index": k + 1, "verification": "visual"})) for k, g in enumerate(given)], "doc_id long, page int, ord int, j string").select("doc_id", "page", "ord", F.parse_json("j").alias("d"), F.lit("").alias("candidate"))
    files_ = spark.createDataFrame([(0, "a.png"), (0, "c.png")], "doc_id long, path string")
    got = merge.accepted(merge.executable_errors(merge.merged(records, supplied), files_)).orderBy("ord").collect()
    assert [(r.ord, r.candidate, r.source_text, r.pdf_page, r.reason, r.candidate_id, r.source_candidates) for r in got] == [(0, "x", "x", 1, "u", "id1", [1]), (1, "y", "y", 1, "r", "id2", [2])]


def test_merged_records_are_plain_columns_and_pages_are_dealt_out_once(spark, tmp_path):
    """Decisions are read once: no rule looks into a VARIANT again; lists of records and decisions are not shuffled to meet."""
    from pagewright.plans import catalog

    line = "SELECT id DIV 3 AS l_orderkey, id % 5 AS l_suppkey, id % 16 AS l_partkey, CAST(id % 3 AS INT) AS l_linenumber FROM range(48)"
    spark.sql(line).write.parquet(str(tmp_path / "lineitem.parquet"))
    records, supplied, _, _ = catalog._records(spark, str(tmp_path))
    m = merge.merged(records, supplied)
    assert not [f.name for f in m.schema.fields if "variant" in f.dataType.simpleString()]
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan  # of line items, once for each side
    given = {(r.doc_id, r.page, r.ord): r.given for r in m.collect()}
    kinds = {(r.doc_id, r.page, r.ord): r.kind for r in catalog._made(spark, str(tmp_path)).collect()}
    assert len(given) == 48 and all(given[k] == (None if kind == 7 else k[2]) for k, kind in kinds.items())


def test_what_decisions_leave_out_comes_from_the_record(spark):
    records = spark.createDataFrame([(0, 1, k, k + 1, f"id{k + 1}", "t", "a//b/../c.png", None, "line", [k + 1]) for k in range(5)], "doc_id long, page int, ord int, candidate_index int, candidate_id string, candidate string, source_asset string, context_asset string, context_type string, source_candidates array<int>")
    given = [{"source_asset": None}, {"source_asset": 5, "context_asset": "x"}, {"source_candidates": "no", "reason": None}, {"source_candidates": [1, "x", 0]}, {"source_pdf_page": "1", "context_type": 3}]
    supplied = spark.createDataFrame([(0, 1, k, json.dumps(g | {"candidate_index": str(k + 1)})) for k, g in enumerate(given)], "doc_id long, page int, ord int, j string").select("doc_id", "page", "ord", F.parse_json("j").alias("d"), F.lit("").alias("candidate"))
    got = merge.merged(records, supplied).orderBy("ord").collect()
    assert [r.given for r in got] == [0, 1, 2, 3, 4] and [r.f_candidate_index for r in got] == [None] * 5 and not any(r.gone_candidate_index for r in got)
    assert [(r.f_source_asset, r.gone_source_asset) for r in got] == [("a//b/../c.png", False), (None, False), *[("a//b/../c.png", False)] * 3]
    assert [(r.f_context_asset, r.gone_context_asset) for r in got] == [(None, True), ("x", False), *[(None, True)] * 3]
    assert [r.f_source_candidates for r in got] == [[1], [2], [], [1, None, 0], [5]] and [r.number for r in got] == [1, 1, 1, 1, None] and [r.f_context_type for r in got] == ["line"] * 4 + [None]
    assert [r.has_reason for r in got] == [False, False, True, False, False]
    files_ = spark.createDataFrame([(0, "a/c.png")], "doc_id long, path string")
    errors = [r.errors for r in merge.executable_errors(merge.merged(records, supplied), files_).orderBy("ord").collect()]
    assert not any("source_asset does not exist" in e for r in errors for e in r) and "source_asset must be a non-empty relative path" in errors[1]


def test_a_book_of_any_size_has_a_digest_of_its_whole_text(spark, tmp_path):
    import hashlib

    from pagewright.plans import catalog

    texts = {0: ["ä", "b\n", None, "c"], 1: ["x"], None: ["y", ""]}
    pieces = spark.createDataFrame([(d, k, t, len(t or "")) for d, ts in texts.items() for k, t in reversed(list(enumerate(ts)))], "doc_id long, k int, piece string, n int")
    got = {r.doc_id: (r.digest, r.n) for r in merge.book_digests(pieces, ("n",)).collect()}
    assert got == {d: (hashlib.md5("".join(t or "" for t in ts).encode()).hexdigest(), sum(len(t or "") for t in ts)) for d, ts in texts.items()}
    assert merge.book_digests(pieces.filter("false")).collect() == []
    spark.createDataFrame([("s", 2, "one"), ("s", 1, "two"), ("t", 3, None), ("t", 4, "three")], "source string, doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in catalog.merged_markdown(spark, str(tmp_path)).collect()}
    page = lambda n, text: f"<!-- PDF page {n} -->\n\n{text}\n\n> [Transcription note: checked page {n}]\n\n"
    whole = {"s": page(1, "two") + page(2, "one"), "t": page(4, "three")}
    assert {d: (r.n_chars, r.notes, r.digest) for d, r in rows.items()} == {d: (len(t), t.count("> ["), hashlib.md5(t.encode()).hexdigest()) for d, t in whole.items()}
