"""The whole report: messages, details and evidence against hand-written ones and plain loops; spans in order; lines in their rows."""

import json
import random
import re

from pyspark.sql import functions as F

from pagewright.operators import assets, layout, math, scans
from pagewright.plans import findings, report

PAGE = "# Title\n\n<!-- PDF page 4 | printed page 12 -->\n\n"


def docs(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def whole(spark, *texts, **inputs):
    r = findings.whole_reports(report.Inputs(docs(spark, *texts), **inputs))
    return {x.doc_id: json.loads(x.json) for x in findings.as_json(r).collect()}


def checks(r):
    return {c["id"]: c for c in r["checks"]}


def test_a_clean_document(spark):
    files = spark.createDataFrame([(0, "assets/a.png")], "doc_id long, path string")
    r = whole(spark, PAGE + "![a](assets/a.png)\n\n$$F=ma$$\n", assets=files)[0]
    assert r["status"] == "PASS" and r["errors"] == r["warnings"] == [] and r["pages"] == [4] and r["printed_pages"] == [12] and r["schema_version"] == 2
    assert r["summary"] == {
        "image_references": 1, "unique_image_references": 1, "orphan_assets": 0, "page_markers": 1, "inline_math_markers": 0, "display_math_blocks": 1, "suspicious_math_braces": 0, "suspicious_math_mojibake": 0, "suspicious_math_blocks": 0,
        "suspicious_formula_artifact": 0, "transcription_notes": 0, "suspicious_garbage": 0, "headings": 1, "printed_page_check_required": False, "workflow_status": None, "visual_review_required": None, "pending_review": None,
    }
    assert [c["id"] for c in r["checks"]] == [c for c in report.CHECKS if c not in ("pages.continuity", "pages.printed_range", "workflow.state")]
    assert all(c["status"] == "PASS" for c in r["checks"]) and checks(r)["images.exists"]["count"] == 1 and checks(r)["manifest.consistency"]["present"] is False


def test_everything_that_is_wrong_with_one_document(spark):
    text = "\n".join([
        "# t", "### u", "<!-- PDF page 1 | printed page 5 -->", "![](../x.png) ![n](gone.png) ![n](gone.png)", "<!-- PDF page 1 | printed page 9 -->", "<!-- PDF page 3 -->", "$$v102 v02+2a1x10 3.42+2 k 7 m 8$$", "$$a= =b\n12\n34$$ $$\\text{骞冲潎} 力 {$$",
        "lone $ and  � Ж א", *["[transcription note: x]"] * 10, "secret",
    ])
    one = lambda **c: spark.createDataFrame([(0, *c.values())], "doc_id long, " + ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in c.items()))
    r = whole(
        spark, text, assets=one(path="assets/left.PNG"), expected=one(first_page=1, last_page=4), printed=one(first_printed=5, last_printed=8), states=one(state='{"status":"done","pending_review":{}}'),
        manifests=one(manifest='{"images":7,"pdf_pages":["1",2],"output_markdown":"y.md"}', path="x.md"), forbidden=("secret", "absent"),
    )[0]
    assert r["status"] == "FAIL" and r["errors"] == [
        "2 referenced image(s) are missing", "1 image reference(s) escape the Markdown directory", "page markers [1, 1, 3] do not match requested pages [1, 2, 3, 4]", "duplicate page markers: [1]", "printed page range does not match requested range [5, 8]",
        "unbalanced inline-math delimiters: 1 unescaped $ markers", "1 math block(s) have unbalanced LaTeX braces", "1 math block(s) contain likely UTF-8-as-GBK mojibake", "1 math block(s) contain likely Chinese prose", "1 high-confidence formula extraction artifact(s) require visual recheck",
        "suspicious Unicode garbage requires visual recheck: replacement character U+FFFD, private-use character, clustered unexpected-script letters near text: Жא", "forbidden residual text found: 'secret'",
        "manifest output_markdown does not point to the validated Markdown; manifest images=7 but Markdown has 3 local image references; manifest pdf_pages differs from Markdown page markers", "unknown conversion workflow status: 'done'", "pending_review must be a list",
    ]
    assert r["warnings"] == [
        "1 image path(s) are referenced more than once", "1 image alt/path issue(s) need review", "1 visual asset(s) are not referenced by Markdown", "page marker gaps detected: [2, 4]", "printed page numbers are not continuous where known", "heading level jumps from H1 to H3 at line 2",
        "excessive unresolved transcription notes: 10 note(s) across 3 page marker(s)",
    ]
    c = checks(r)
    assert c["images.exists"]["paths"] == ["gone.png", "gone.png"] and c["images.orphans"]["paths"] == ["assets/left.PNG"] and c["pages.printed"]["transitions"] == [[5, 9]] and c["pages.continuity"]["gaps"] == [2, 4]
    brace = c["math.braces"]["findings"][0]
    assert brace["line"] == 10 and brace["pdf_page"] == 3 and brace["diagnostics"] == {"unmatched_open_positions": [13], "unmatched_close_positions": [], "balance": 1} and brace["kind"] == "display"
    said = c["math.mojibake"]["findings"][0]
    assert (said["span"], said["recovered"], said["codec"], said["line"]) == ("骞冲潎", "平均", "gbk", 10)
    assert c["math.chinese_prose"]["blocks"] == ["display math at line 10 contains likely Chinese prose: \\text{骞冲潎} 力 {"]
    first, second = c["math.extraction_artifact"]["findings"]
    assert (first["status"], first["artifact_score"], first["line"], first["pdf_page"]) == ("FAIL", 7, 7, 3) and first["message"].startswith("PDF page 3 math block appears")
    assert [(s["id"], s["score"], s["evidence"]) for s in first["signals"]] == [
        ("digit_letter_flattening", 2, ["v102", "v02"]), ("isolated_number_fragments", 2, ["7", "8"]), ("low_latex_structure_density", 1, {"structure_hits": 0}),
        ("dense_alternating_tokens", 2, {"tokens": ["v", "102", "v", "02", "2", "a", "1", "x", "10", "3.42", "2", "k"], "transitions": 11}),
    ]
    assert [(s["id"], s["evidence"]) for s in second["signals"]] == [("fraction_like_broken_structure", ["12", "34"])] and c["math.extraction_artifact"]["pdf_pages"] == [3]
    assert c["workflow.state"] | {"visual_review_required": 0} == {"id": "workflow.state", "status": "FAIL", "message": "conversion workflow state needs review", "workflow_status": "done", "visual_review_required": 0, "pending_review": 0}
    assert c["manifest.consistency"]["manifest"]["images"] == 7 and c["notes.excessive"]["page_ratio"] == 3.3333


def test_evidence_has_caps(spark):
    text = "$$" + " ".join(f"ab{k}" for k in range(20)) + " " + " ".join(f"（{k}）" for k in range(9)) + "$$"
    found = checks(whole(spark, text)[0])["math.extraction_artifact"]["findings"][0]
    shown = {s["id"]: s["evidence"] for s in found["signals"]}
    assert shown["digit_letter_flattening"] == [f"ab{k}" for k in range(8)] and shown["orphan_equation_label"] == [f"（{k}）" for k in range(4)] and len(shown["fullwidth_math_punctuation"]) == 8 and len(shown["dense_alternating_tokens"]["tokens"]) == 12


def test_the_whole_report_counts_what_the_short_one_counts(spark):
    rng = random.Random(5)
    parts = ["$$a= =b\n12\n34$$", "$x", "$", "{", "}", "\\(", "\\)", "<!-- PDF page 2 -->", "<!-- PDF page 3 | printed page 7 -->", "# a\n", "#### b\n", "![](a/b.png)", "![b](../c.png)", "\\[骞冲潎\\]", "$$力$$", "�", "\n", "[Transcription note: y]", "v102 v02 "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(150)] + [None, ""]
    d = docs(spark, *texts)
    short = {r.doc_id: r for r in report.report(report.Inputs(d)).collect()}
    for k, r in whole(spark, *texts).items():
        assert (r["status"], len(r["errors"]), len(r["warnings"])) == (short[k].status, short[k].errors, short[k].warnings), texts[k]
        assert [(c["id"], c["status"]) for c in r["checks"]] == [(c.check_id, c.status) for c in short[k].checks]


PATTERNS = {"display": r"\$\$([\s\S]*?)\$\$", "inline": r"(?<!\$)\$(?!\$)([^$\n]*?)(?<!\\)\$(?!\$)", "parenthesized": r"\\\(([\s\S]*?)(?<!\\)\\\)", "bracketed": r"\\\[([\s\S]*?)(?<!\\)\\\]"}


def test_spans_of_all_kinds_in_order(spark):
    rng = random.Random(6)
    parts = ["$$", "$", "\\(", "\\)", "\\[", "\\]", "x", " ", "\n", "力", "😀", "<!-- PDF page 7 -->", "<!-- PDF page 8 -->", "\\$"]
    texts = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(120)] + [None, "", "$a$" * 300]
    want = set()
    for k, t in enumerate(texts):
        found = [(m.start(), rank, n, kind, m[1]) for rank, (kind, p) in enumerate(PATTERNS.items()) for n, m in enumerate(re.finditer(p, t or ""))]
        marks = [(m.start(), int(m[1])) for m in re.finditer(r"<!-- PDF page (\d) -->", t or "")]
        for o, (start, _, n, kind, content) in enumerate(sorted(found)):
            want.add((k, o, kind, n, start, (t or "").count("\n", 0, start) + 1, next((p for s, p in reversed(marks) if s <= start), None), content))
    got = [tuple(r) for r in scans.ordered_spans(docs(spark, *texts)).collect()]
    assert set(got) == want and len(got) == len(want)
    kept = scans.math_spans(docs(spark, *texts)).select("doc_id", "kind", "seq", "start", "line", "content").collect()
    assert {(w[0], *w[2:6], w[7]) for w in want} == {tuple(r) for r in kept}


def test_lines_in_their_rows_are_those_of_the_table(spark):
    rng = random.Random(7)
    words = ["第一章 运动", "1.2. Motion", "1. It moves.", "（一）甲", "plain", "word.", "三", "—————", "12", "Running head", "Жx", "a�b", "end!", "  spaced\t out "]
    rows = [(d, p, "\n".join(rng.choice(words) for _ in range(rng.randrange(0, 14)))) for d in range(3) for p in range(12)] + [(3, 0, None), (3, 1, "")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    lines = layout.text_lines(pages)
    noise, edge = layout.noise_lines(lines, counts), layout.edge_noise(layout.page_lines(pages), counts)
    same = lambda a, b, *c: sorted(map(tuple, a.select(*c).collect())) == sorted(map(tuple, b.select(*c).collect()))
    assert same(noise, edge, "doc_id", "line", "times") and noise.count() > 3
    cleaned = layout.cleaned_pages(layout.page_lines(pages), edge)
    table = layout.clean_lines(lines, noise)
    assert same(table, cleaned.select("doc_id", "page", F.inline("lines")), "doc_id", "page", "ord", "line", "changed")
    parts = layout.page_parts(cleaned)
    assert same(layout.paragraphs(table), parts.select("doc_id", "page", F.inline("parts")), "doc_id", "page", "part", "kind", "body")
    assert same(layout.page_markdown(layout.paragraphs(table)), layout.parts_markdown(parts.filter(F.size("parts") > 0)), "doc_id", "page", "markdown")


def test_noise_beyond_the_bound_meets_pages_by_a_join(spark, monkeypatch):
    pages = layout.page_lines(spark.createDataFrame([(0, p, f"Head\nbody {p}") for p in range(6)], "doc_id long, page int, text string"))
    noise = layout.edge_noise(pages, spark.createDataFrame([(0, 6)], "doc_id long, pages long"))
    monkeypatch.setattr(layout, "MOST_NOISE", 0)
    assert [[x.line for x in r.lines] for r in layout.cleaned_pages(pages, noise).orderBy("page").collect()] == [[f"body {p}"] for p in range(6)]


def test_links_are_followed(spark):
    refs = ["a/x.png", "b/x.png", "c/x.png", "d/x.png", "up/../x.png", "e", "f/x", "plain/../y", "../z", "/abs", "g/./h/../i.png"]
    links = [(0, "a", "real"), (0, "b", "../out"), (0, "c", "d"), (0, "d", "c"), (0, "e", "/etc/passwd"), (0, "up", "real/deep"), (0, "f", "k"), (0, "k/x", "../../w"), (1, "plain", "../no"), (0, "g/h", "../j/k")]
    want = {
        "a/x.png": ("real/x.png", "inside"), "b/x.png": (None, "outside"), "c/x.png": (None, "loop"), "d/x.png": (None, "loop"), "up/../x.png": ("real/x.png", "inside"), "e": (None, "outside"), "f/x": (None, "outside"), "plain/../y": ("y", "inside"), "../z": (None, "outside"), "/abs": (None, "outside"),
        "g/./h/../i.png": ("j/i.png", "inside"),
    }
    d = spark.createDataFrame([(0, k, r) for k, r in enumerate(refs)] + [(2, 0, "q/../r")], "doc_id long, seq int, ref string")
    got = {(r.doc_id, r.ref): (r.target, r.fate) for r in assets.through_links(d, spark.createDataFrame(links, "doc_id long, path string, target string")).collect()}
    assert got == {(0, r): w for r, w in want.items()} | {(2, "q/../r"): ("r", "inside")}


def test_runs_of_lists_are_recovered(spark):
    d = spark.createDataFrame([(0, ["骞冲潎", "平均", "鍘媫"]), (1, []), (2, ["中"])], "k int, runs array<string>")
    got = {r.k: [(x.recovered, x.codec) for x in r.x] for r in d.select("k", math.recovered_runs(F.col("runs")).alias("x")).collect()}
    assert got == {0: [("平均", "gbk"), (None, None), ("压}", "gbk")], 1: [], 2: [(None, None)]}
