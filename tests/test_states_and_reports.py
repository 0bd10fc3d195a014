"""Review states, merging, layout and the document report on small cases."""

import json

from pyspark.sql import functions as F

from pagewright.operators import layout, merge, scans, state
from pagewright.plans import report


def states(spark, *objects):
    return spark.createDataFrame([(k, o if isinstance(o, str) else json.dumps(o)) for k, o in enumerate(objects)], "doc_id long, state string")


GOOD = {"disposition": "latex_confirmed", "verification": "visual", "source_pdf_page": 3, "latex": "x"}


def test_state_verdicts(spark):
    pending = {"pdf_page": 2, "kind": "formula", "status": "visually_reviewed_unresolved", "reason": "blot"}
    cases = [
        ({"status": "completed", "visual_review_required": [], "pending_review": []}, "PASS"),
        ({"status": "completed", "visual_review_required": [1]}, "FAIL"),
        ({"status": "visual_review", "visual_review_required": [1]}, "PASS"),
        ({"status": "completed", "pending_review": [pending]}, "WARN"),
        ({"status": "completed_with_review_items", "pending_review": [pending | {"reason": "需回看原 PDF 页面。"}]}, "FAIL"),
        ({"status": "completed_with_review_items", "pending_review": [pending | {"pdf_page": True}]}, "FAIL"),
        ({"status": "completed", "formula_decisions": [GOOD]}, "PASS"),
        ({"status": "completed", "formula_decisions": [GOOD | {"source_pdf_page": True}]}, "FAIL"),
        ({"status": "completed", "formula_decisions": [GOOD | {"disposition": "conservative_latex"}]}, "FAIL"),
        ({"status": "completed", "formula_decisions": [GOOD], "formula_candidate_records": {"3": []}}, "FAIL"),
        ({"status": "completed", "visual_verified_pdf_pages": [4], "formula_candidates": {"4": ["x"]}}, "FAIL"),
        ({"status": "completed", "visual_verified_pdf_pages": [4], "formula_candidates": {"4": ["x"]}, "visual_review_decisions": {"4": GOOD}}, "PASS"),
        ("[1]", "FAIL"), ("{", "FAIL"),
    ]
    got = {r.doc_id: r.status for r in state.state_report(states(spark, *[c for c, _ in cases])).collect()}
    assert [got[k] for k in range(len(cases))] == [s for _, s in cases]


def test_greedy_match_takes_the_first_that_fits(spark):
    records = spark.createDataFrame([(0, 1, k, k + 1, f"id{k + 1}", t, "a.png", "c.png", "line", [k + 1]) for k, t in enumerate(["x", "x", "y"])], "doc_id long, page int, ord int, candidate_index int, candidate_id string, candidate string, source_asset string, context_asset string, context_type string, source_candidates array<int>")
    given = [{"candidate": "x"}, {"candidate_index": "no", "candidate": "x"}, {"candidate_index": 3}]
    supplied = spark.createDataFrame([(0, 1, k, json.dumps(g), g.get("candidate", "")) for k, g in enumerate(given)], "doc_id long, page int, ord int, j string, candidate string").withColumn("d", F.parse_json("j"))
    assert sorted((r.ord, r.given) for r in merge.match(records, supplied).collect()) == [(0, 0), (1, None), (2, 2)]


def test_loading_decisions_and_selections(spark):
    files = spark.createDataFrame([
        (0, "Book.pdf", json.dumps([{"pdf_page": 2, "candidate": " x "}, {"pdf_page": 2, "book": "other", "candidate": "y"}])),
        (1, "Book.pdf", json.dumps({"pages": {"7": {"formulas": [{"candidate_id": "f-1"}]}}})),
        (2, "Book.pdf", json.dumps({"decisions": [{"pdf_page": "z", "candidate": "q"}, {"pdf_page": 1}]})),
    ], "doc_id long, book string, json string")
    got = sorted((r.doc_id, r.page, r.candidate, r.error) for r in merge.load_decisions(files).collect() if r.doc_id < 2)
    assert got == [(0, 2, "x", None), (1, 7, "", None)]
    assert all(r.error for r in merge.load_decisions(files).filter("doc_id = 2").collect())
    chosen = merge.load_selection(spark.createDataFrame([(0, "b", json.dumps({"items": [{"book": "B.pdf", "pdf_page": 1, "candidate_id": "pdf-page-001-formula-02"}, {"pdf_page": 1, "candidate": "t"}]}))], "doc_id long, book string, json string"))
    regions = spark.createDataFrame([(0, 1, 1, "t"), (0, 1, 2, "u")], "doc_id long, page int, candidate_index int, text string")
    assert sorted((r.candidate_index, r.error) for r in merge.select_candidates(regions, chosen).collect()) == [(1, None), (2, None)]


def test_noise_counts_short_pages_twice(spark):
    pages = spark.createDataFrame([(0, p, "Title\nbody %d\n12" % p) for p in range(2)], "doc_id long, page int, text string")
    counts = spark.createDataFrame([(0, 2)], "doc_id long, pages long")
    lines = layout.text_lines(pages)
    noise = layout.noise_lines(lines, counts)
    assert sorted((r.line, r.times) for r in noise.collect()) == [("12", 4), ("Title", 4)]
    assert sorted(r.line for r in layout.clean_lines(lines, noise).collect()) == ["body 0", "body 1"]


def test_line_classes(spark):
    cases = {"第一章 运动": "heading", "1.2. Motion": "heading", "1. It moves.": "bullet", "（一）甲": "bullet", "问题": "heading", "Aside —": "heading", "plain": "text"}
    got = {r.line: r["class"] for r in layout.line_classes(spark.createDataFrame([(c,) for c in cases], "line string")).collect()}
    assert got == cases


def test_page_markdown(spark):
    lines = spark.createDataFrame([(0, 1, k, t) for k, t in enumerate(["第一章 运动", "one", "two.", "三", "四。", "1. It moves."])], "doc_id long, page int, ord int, line string")
    notes = spark.createDataFrame([(0, 1, 0, "n")], "doc_id long, page int, ord int, note string")
    got = layout.page_markdown(layout.paragraphs(lines), notes).first().markdown
    assert got == "<!-- PDF page 1 -->\n\n## 第一章 运动\n\none two.\n\n三四。\n\n- 1. It moves.\n\n> [Transcription note: n]\n\n"
    segments = scans.page_segments(spark.createDataFrame([(0, got)], "doc_id long, text string"))
    assert [(r.pdf_page, r.start, r.end) for r in segments.collect()] == [(1, 0, len(got))]


def test_regions_and_groups(spark):
    sizes = spark.createDataFrame([(0, 20, 360.0, 480.0)], "doc_id long, page int, page_width double, page_height double")
    lines = spark.createDataFrame([(0, 20, 0, 0, 68.0, 103.0, 142.0, 122.0, "F=ma"), (0, 20, 1, 1, 68.0, 173.0, 162.0, 192.0, "vx=v0"), (0, 20, 2, 1, 69.0, 174.0, 150.0, 190.0, "a=b")], "doc_id long, page int, ord int, block_index int, x0 double, y0 double, x1 double, y1 double, text string")
    regions = layout.formula_regions(lines, sizes)
    assert [r.candidate_id for r in regions.orderBy("candidate_index").collect()] == ["pdf-page-020-formula-01", "pdf-page-020-formula-02"]
    groups = layout.region_groups(regions, layout.related_pairs(regions))
    assert [r.candidate_indices for r in groups.orderBy("group_first").collect()] == [[1], [2]]
    near = spark.createDataFrame([(0, 1, 1, 40.0, 100.0, 90.0, 116.0), (0, 1, 2, 94.0, 101.0, 145.0, 117.0)], "doc_id long, page int, candidate_index int, x0 double, y0 double, x1 double, y1 double")
    assert [r.candidate_indices for r in layout.region_groups(near, layout.related_pairs(near)).collect()] == [[1, 2]]
    context = layout.group_contexts(groups, lines, sizes).orderBy("group_id").collect()
    assert [(r.context_type, r.context_filename) for r in context] == [("line", "pdf_page_020_formula_01_context.png"), ("line", "pdf_page_020_formula_02_context.png")]


def test_boxes(spark):
    cases = {"10, 20, 110, 220": (10.0, 20.0, 110.0, 220.0), "10,20,10,220": None, "1,2,3": None, "a,b,c,d": None}
    d = spark.createDataFrame([(c,) for c in cases], "c string").select("c", layout.parse_box(F.col("c")).alias("b"))
    assert {r.c: tuple(r.b) if r.b else None for r in d.collect()} == cases


def test_report_verdicts(spark):
    page = "# t\n\n<!-- PDF page 1 -->\n\n"
    docs = spark.createDataFrame([(0, page + "![a](a.png) $$F=ma$$"), (1, page + "![a](gone.png) $x"), (2, page + "$$h F_f =Gx=G\\sin\\theta=G （1） l$$"), (3, ""), (4, page + "[Transcription note: x]\n" * 10)], "doc_id long, text string")
    files = spark.createDataFrame([(0, "a.png")], "doc_id long, path string")
    manifests = spark.createDataFrame([(0, json.dumps({"images": 1, "pdf_pages": [1]}), "m")], "doc_id long, manifest string, path string")
    got = {r.doc_id: (r.status, r.errors, r.warnings) for r in report.report(report.Inputs(docs, assets=files, manifests=manifests)).collect()}
    assert got == {0: ("PASS", 0, 0), 1: ("FAIL", 2, 0), 2: ("WARN", 0, 1), 3: ("WARN", 0, 2), 4: ("WARN", 0, 1)}


def test_files(spark, tmp_path):
    from pagewright.sources import files

    (tmp_path / "assets").mkdir()
    (tmp_path / "a.md").write_text("# ä\n")
    (tmp_path / "b.md").write_bytes(b"\xff")
    (tmp_path / "assets/x.PNG").write_bytes(b"1")
    texts = files.read_texts(spark, str(tmp_path))
    assert {r.doc_id: (r.text, r.valid) for r in texts.collect()} == {"a": ("# ä\n", True), "b": (None, False)}
    assert [(r.doc_id, r.error) for r in files.unread(texts).collect()] == [("b", "Markdown could not be read as UTF-8")]
    (tmp_path / "books/one/assets").mkdir(parents=True)
    (tmp_path / "books/one/assets/y.png").write_bytes(b"22")
    listed = files.list_assets(spark, str(tmp_path / "books"), spark.createDataFrame([("one",), ("two",)], "doc_id string"))
    assert [tuple(r) for r in listed.collect()] == [("one", "assets/y.png", 2)]
    assert sorted(r.path for r in files.list_assets(spark, str(tmp_path)).collect()) == ["assets/x.PNG", "books/one/assets/y.png"]
    (tmp_path / "s.json").write_text('{"status": "completed"}')
    assert [tuple(r) for r in files.read_json_texts(spark, str(tmp_path)).collect()] == [("s", '{"status": "completed"}')]
    for name in ("B2.pdf", "B1.pdf", "C.pdf"):
        (tmp_path / name).write_bytes(b"%PDF")
    assert [r.doc_id for r in files.list_sources(spark, str(tmp_path)).collect()] == ["B1", "B2", "C"]
    assert [r.doc_id for r in files.list_sources(spark, str(tmp_path), only=("C.pdf", "B1")).collect()] == ["B1", "C"]
    files.write_reports(spark.createDataFrame([("1", "{}")], "doc_id string, json string"), str(tmp_path / "r"))
    files.append_trace(spark.createDataFrame([("1", 2), ("2", 3)], "doc_id string, page int"), str(tmp_path / "t"))
    files.append_trace(spark.createDataFrame([("1", 4)], "doc_id string, page int"), str(tmp_path / "t"))
    files.write_state(spark.createDataFrame([("1", "{}")], "doc_id string, state string"), str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "r")).count() == 1 and spark.read.json(str(tmp_path / "t")).count() == 3 and spark.read.parquet(str(tmp_path / "w")).count() == 1
    b = spark.sql("SELECT 'd' AS doc_id, 1 AS page, array(named_struct('type', 0, 'lines', array(named_struct('spans', array(named_struct('text', 'a  ', 'x0', 1D, 'y0', 2D, 'x1', 3D, 'y1', 4D), named_struct('text', 'b', 'x0', 3D, 'y0', 1D, 'x1', 5D, 'y1', 4D)))))) AS blocks")
    assert [(r.ord, r.text, r.x0, r.y0, r.x1, r.y1) for r in files.layout_lines(b).collect()] == [(0, "a b", 1.0, 1.0, 5.0, 4.0)]
    assert files.page_counts(files.layout_lines(b)).first().pages == 1
    spec = spark.sql("SELECT * FROM VALUES ('3, 1,1'), ('0'), ('x'), ('9') t(s)").select("s", files.page_list(F.col("s"), F.lit(5)).alias("p"))
    assert {r.s: r.p for r in spec.collect()} == {"3, 1,1": [1, 3], "0": None, "x": None, "9": None}
    assert spark.range(1).select(files.page_range(F.lit(2), F.lit(4)).alias("a"), files.page_range(F.lit(4), F.lit(2)).alias("b")).first() == ([2, 3, 4], None)


def test_books_begin_and_are_told_of(spark):
    books = layout.fresh_books(spark.createDataFrame([("B", "/s/B.pdf", "/t/B.md", 2)], "doc_id string, path string, output string, total_pages int"), "n", "r")
    row = books.first()
    first = json.loads(row.state)
    assert row.text.startswith("# B\n\n> [Transcription note: ") and row.text.endswith("\n\n## 目录与正文\n\n")
    assert first["requested_pdf_pages"] == [1, 2] and first["status"] == "in_progress" and first["current_section"] is None and first["formula_candidates"] == {} and first["schema_version"] == 3
    assert json.loads(layout.status_lines(books).first().line) == {"book": "B", "status": "in_progress", "completed_pdf_pages": 0, "visual_review_required": 0, "pending_review": 0, "formula_latex_confirmed": 0, "execution_trace": None}
    pages = spark.createDataFrame([("B", 2, 1), ("B", 5, 3)], "doc_id string, page int, n int")
    assert sorted((r.page, r.done, r.n_so_far) for r in layout.progress(pages, ["n"]).collect()) == [(2, 1, 1), (5, 2, 4)]


def test_groups_of_candidates_and_files_of_pages(spark):
    contexts = spark.createDataFrame([(0, 1, "g1", [1, 3], "c.png"), (0, 1, "g2", [2], "d.png")], "doc_id long, page int, group_id string, candidate_indices array<int>, context_filename string")
    assert sorted((r.candidate_index, r.group_id) for r in layout.candidate_rows(contexts).collect()) == [(1, "g1"), (2, "g2"), (3, "g1")]
    images = spark.createDataFrame([(0, 1, 2), (0, 1, 1)], "doc_id long, page int, rank int")
    formulas = spark.createDataFrame([(0, 1, 3)], "doc_id long, page int, candidate_index int")
    got = layout.page_assets(images, formulas, contexts).first().assets
    assert got == ["assets/pdf_page_001_visual_01.png", "assets/pdf_page_001_visual_02.png", "assets/pdf_page_001_formula_03.png", "assets/c.png", "assets/d.png"]


def test_additions_go_to_their_pages(spark):
    text = "head  \n<!-- PDF page 1 -->\n\none\n\n<!-- PDF page 2 -->\n\ntwo \n"
    pieces = merge.text_pieces(spark.createDataFrame([(0, text), (1, "none "), (2, None)], "doc_id long, text string"))
    blocks = spark.createDataFrame([(0, 2, 1, "B"), (0, 2, 0, "A"), (0, 9, 0, "C")], "doc_id long, page int, ord int, block string")
    got = {r.doc_id: r.text for r in merge.book_texts(merge.with_additions(pieces, blocks)).collect()}
    assert got == {0: "head  \n<!-- PDF page 1 -->\n\none\n\n<!-- PDF page 2 -->\n\ntwo\n\nA\n\nB\n\n", 1: "none "}


def _detected(spark, docs, files):
    """The facts of a report by the detectors that give rows with places."""
    from pagewright.operators import assets, garbage, math, pages

    refs, markers, spans, heads = scans.image_refs(docs), scans.page_markers(docs), scans.math_spans(docs), scans.headings(docs)
    scores = math.artifact_scores(spans)
    tables = {
        "refs": refs, "unique_refs": refs.select("doc_id", "ref").distinct(), "outside": assets.escaping(refs), "duplicate_refs": assets.duplicates(refs), "alt": assets.alt_issues(refs, True), "missing": assets.missing(refs, files), "orphans": assets.orphans(refs, files),
        "markers": markers, "duplicate_pages": pages.duplicate_pages(markers), "known_printed": markers.filter("printed_page IS NOT NULL"), "printed_breaks": pages.printed_breaks(markers), "delimiters": math.delimiter_errors(math.delimiter_counts(docs)), "braces": math.brace_findings(spans),
        "mojibake": math.mojibake_findings(scans.cjk_runs(spans)), "prose": math.prose_findings(spans), "artifacts": math.artifact_findings(scores), "artifact_fail": math.artifact_findings(scores).filter("status = 'FAIL'"), "headings": heads, "jumps": scans.heading_jumps(heads), "garbage": garbage.garbage(docs),
    }
    return {name: {r.doc_id: r["count"] for r in t.groupBy("doc_id").count().collect()} for name, t in tables.items()}


def test_one_scan_finds_what_the_detectors_find(spark):
    texts = [
        "# a\n\n### b\n<!-- PDF page 1 | printed page 4 -->\n![x](a.png) ![](../b.png \"t\") ![a](<a%20b.png>) ![x](a.png#f) ![u](https://e.org/x.png)\n$$x_{1$$ $a$ \\(中\\) \\[y}\\]",
        "<!-- PDF page 2 --><!-- PDF page 2 | printed page 9 --><!-- PDF page 3 | printed page unknown --><!-- PDF page 4 | printed page 11 -->\n$$\\text{骞冲潎}$$ $$v102 v02＋2a1x10 3.42＋2 k 7 m 8$$ $ \\(",
        "Ж a ג b \ufffd \ue000 $$\nh F_f =Gx=G\\sin\\theta=G （1） l\n$$ ## no heading", "Ж" + " " * 24 + "ג$$中$$", "", None, "plain", "$$a= =b\n12\n34$$ $$$ {", "##### deep\n# up\n## down\n\n![](x.png)![](x.png)![](x.png)",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pages", F.lit("clash"))
    files = spark.createDataFrame([(0, "a.png"), (0, "z.JPG"), (0, "n.txt"), (8, "y.gif"), (8, "x.png")], "doc_id long, path string")
    rows = report.report(report.Inputs(docs, assets=files, require_stem=True)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for name, want in _detected(spark, docs, files).items():
        assert {r.doc_id: r[name] for r in rows if r[name]} == want, name
    assert {r.doc_id: r.status for r in rows if r.doc_id in (4, 5)} == {4: "WARN", 5: "WARN"}


def test_coverage_manifests_and_states_of_a_report(spark):
    page = "# t\n\n<!-- PDF page 1 | printed page 5 -->\n<!-- PDF page 3 | printed page 6 -->\n"
    docs = spark.createDataFrame([(k, page) for k in range(4)], "doc_id long, text string")
    want = spark.createDataFrame([(0, 1, 3, 5, 6), (1, 1, 1, 5, 7)], "doc_id long, first_page int, last_page int, first_printed int, last_printed int")
    manifests = spark.createDataFrame([(0, json.dumps({"images": 0, "pdf_pages": ["1", 3], "output_markdown": "p"}), "p"), (1, json.dumps({"images": True, "pdf_pages": [1], "output_markdown": "q"}), "p"), (2, "{", "p")], "doc_id long, manifest string, path string")
    given = states(spark, {"status": "completed"}, "{", {"status": "visual_review"})
    got = {r.doc_id: r for r in report.report(report.Inputs(docs, expected=want, printed=want, manifests=manifests, states=given)).collect()}
    assert [(got[k].uncovered, got[k].gaps, got[k].expects, got[k].printed_range) for k in range(4)] == [(1, 1, 1, 1), (1, 0, 1, 2), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert [got[k].manifest for k in range(4)] == [0, 3, 1, 0]
    assert [(got[k].state_errors, got[k].state_warnings, got[k].has_state) for k in range(4)] == [(0, 0, 1), (1, 0, 1), (0, 1, 1), (0, 0, 0)]
    assert [len(got[k].checks) for k in range(4)] == [21, 21, 19, 18]
    none = docs.filter("false")
    assert report.report(report.Inputs(none, assets=spark.createDataFrame([], "doc_id long, path string"))).collect() == []
    unknown = spark.createDataFrame([(0, page.replace("printed page 6", "printed page unknown"))], "doc_id long, text string")
    assert [report.report(report.Inputs(unknown, require_printed=x)).first().status for x in (False, True)] == ["PASS", "WARN"]
    assert [r.exit_code for r in report.report(report.Inputs(docs)).select(report.exit_code().alias("exit_code")).collect()] == [0] * 4
