"""Scans and checks against small independent specifications in Python."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagewright.functions import text as T
from pagewright.operators import assets, garbage, math, pages, scans


def docs(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_markers_offsets_are_code_points(spark):
    t = "𠀀x\n<!-- PDF page 3 | printed page 7 -->\n<!--  PDF page 4 | printed page unknown--> <!-- PDF page 5 -->"
    found = scans.page_markers(docs(spark, t, "", "none"))
    want = [(m.start(), int(m.group(1)), int(m.group(2)) if m.group(2) and m.group(2) != "unknown" else None) for m in re.finditer(r"<!--\s*PDF page\s+(\d+)(?:\s*\|\s*printed page\s+(\d+|unknown))?\s*-->", t)]
    assert [r[2:] for r in rows(found, "doc_id", "seq")] == want


def test_spans_of_all_kinds(spark):
    t = "$$a\nb$$ $x$ \\(y\\) \\[z\\] \\$ $q\\$ $"
    found = scans.math_spans(docs(spark, t))
    kinds = (("display", r"\$\$([\s\S]*?)\$\$"), ("inline", r"(?<!\$)\$(?!\$)([^$\n]*?)(?<!\\)\$(?!\$)"), ("parenthesized", r"\\\(([\s\S]*?)(?<!\\)\\\)"), ("bracketed", r"\\\[([\s\S]*?)(?<!\\)\\\]"))
    want = sorted((k, m.start(), t.count("\n", 0, m.start()) + 1, m.group(1)) for k, p in kinds for m in re.finditer(p, t))
    assert sorted((r.kind, r.start, r.line, r.content) for r in found.collect()) == want


def test_image_references(spark):
    t = "![a](x.png) ![](<b c.png>) ![u](http://e.org/i.png) ![q](p%20q.png?x#y) ![+](a+b%zz.png 'title')"
    assert [(r.alt, r.ref) for r in scans.image_refs(docs(spark, t)).orderBy("seq").collect()] == [("a", "x.png"), ("", "b c.png"), ("q", "p q.png"), ("+", "a+b%zz.png")]


def test_headings_and_jumps(spark):
    d = docs(spark, "# a\n### b\r\n## c\u2028###### d  \n#no", "plain")
    heads = scans.headings(d)
    assert rows(heads.select("line_no", "level", "title"), "line_no") == [(1, 1, "a"), (2, 3, "b"), (3, 2, "c"), (4, 6, "d")]
    assert rows(scans.heading_jumps(heads), "line_no") == [(0, 2, 1, 3), (0, 4, 2, 6)]


def test_as_of_page_is_null_before_the_first(spark):
    d = docs(spark, "$$a$$ <!-- PDF page 9 --> $$b$$")
    found = scans.with_page(scans.math_spans(d).filter("kind = 'display'"), scans.page_markers(d))
    assert [r.pdf_page for r in found.orderBy("start").collect()] == [None, 9]


def braces(s):
    opens, closes, stack, slashes = [], [], [], 0
    for i, c in enumerate(s):
        if c == "\\":
            slashes += 1
            continue
        escaped, slashes = slashes % 2, 0
        if escaped:
            continue
        if c == "{":
            stack.append(i)
        elif c == "}":
            stack.pop() if stack else closes.append(i)
    return stack, closes


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="{}\\a\n𠀀", max_size=12), min_size=1, max_size=30))
def test_braces_against_a_stack(spark, texts):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, c string").select("k", math.brace_positions(__import__("pyspark").sql.functions.col("c")).alias("b"))
    for r in d.collect():
        assert (r.b["open"], r.b["close"]) == braces(texts[r.k]), texts[r.k]


def test_artifact_scores_of_fixtures(spark):
    cases = {
        "\nF 1.4 2 a= = m/s2=2 m/s\n": 9, "\n1 1 x= at2= \\times2 \\times25 m =25 m\n": 7, "\nh F_f =Gx=G\\sin\\theta=G （1） l\n": 3, "\nv102 v02＋2a1x10 3.42＋2 \\cdots\n": 6,
        "\nx=\\frac12 at^2\n": 0, "\nF_f=G\\sin\\theta\n": 0, "\na=\\frac{\\Delta v}{\\Delta t}\n": 0, "\n\\Deltav 中常用的方法。 a=\\Deltat\n": 1,
    }
    d = docs(spark, *[f"$${c}$$" for c in cases])
    got = {r.content: r.score for r in math.artifact_scores(scans.math_spans(d)).collect()}
    assert got == cases


def test_prose_and_mojibake(spark):
    d = docs(spark, "$$\\Delta 中常用$$", "$$\\text{合力}=F$$", *[f"$$\\text{{{x}}}$$" for x in ("骞冲潎", "鍘媫", "鐢瞹", "鐑瓆", "閲嶅姟")])
    spans = scans.math_spans(d)
    assert [r.doc_id for r in math.prose_findings(spans).collect()] == [0]
    found = math.mojibake_findings(scans.cjk_runs(spans)).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == [2, 3, 4, 5, 6] and found[0].recovered == "平均"


def test_garbage(spark):
    d = docs(spark, "a � b", "x\ue000", "Ж and א", "Ж" + " " * 24 + "א", "ªº", "日本語 καλά é", "")
    got = {(r.doc_id, r.pattern.split(":")[0]) for r in garbage.garbage(d).collect()}
    near = "clustered unexpected-script letters near text"
    assert got == {(0, "replacement character U+FFFD"), (1, "private-use character"), (2, near), (4, near)}


def test_delimiters(spark):
    d = docs(spark, "$$a", "$a \\$", "\\(a", "\\[a\\]", "$$$ $")
    got = {(r.doc_id, r.error.split(":")[0]) for r in math.delimiter_errors(math.delimiter_counts(d)).collect()}
    assert got == {(0, "unbalanced display-math delimiters"), (1, "unbalanced inline-math delimiters"), (2, r"unbalanced \\( \\) delimiters"), (4, "unbalanced display-math delimiters")}


def test_assets(spark):
    d = docs(spark, "![a](assets/a.png) ![](assets/../b.png) ![c](../c.png) ![a](assets/a.png)")
    files = spark.createDataFrame([(0, "assets/a.png"), (0, "assets/z.PNG"), (0, "notes.txt")], "doc_id long, path string")
    refs = scans.image_refs(d)
    assert [r.ref for r in assets.missing(refs, files).collect()] == ["assets/../b.png"]
    assert [r.ref for r in assets.escaping(refs).collect()] == ["../c.png"]
    assert [r.path for r in assets.orphans(refs, files).collect()] == ["assets/z.PNG"]
    assert rows(assets.duplicates(refs), "ref") == [(0, "assets/a.png", 2)]
    assert sorted((r.ref, r.issue) for r in assets.alt_issues(refs, True).collect()) == [("assets/../b.png", "empty"), ("assets/../b.png", "stem")]


def test_pages(spark):
    d = docs(spark, "<!-- PDF page 1 | printed page 5 --><!-- PDF page 1 | printed page 7 --><!-- PDF page 4 -->")
    m = scans.page_markers(d)
    lists = pages.page_lists(m)
    want = spark.createDataFrame([(0, 1, 4, 5, 7), (1, 1, 2, 1, 2)], "doc_id long, first_page int, last_page int, first_printed int, last_printed int")
    assert rows(pages.coverage(lists, want), "doc_id") == [(0, False, [2, 3]), (1, False, None)]
    assert rows(pages.printed_breaks(m), "seq") == [(0, 1, 5, 7)]
    assert rows(pages.printed_range(lists, want), "doc_id") == [(0, True), (1, False)]
    assert rows(pages.duplicate_pages(m), "pdf_page") == [(0, 1, 2)]


def test_lines_like_splitlines(spark):
    texts = ["a\r\nb\rc\x0bd\u2028e\n", "", "\n", "x", "a\n\nb\x85c"]
    got = {r.text: r.l for r in docs(spark, *texts).select("text", T.lines(__import__("pyspark").sql.functions.col("text")).alias("l")).collect()}
    assert got == {t: t.splitlines() for t in texts}


def test_normal_paths(spark):
    F = __import__("pyspark").sql.functions
    cases = {"a/b": "a/b", "a/../b": "b", "../a": None, "a/../../b": None, "/a": None, "./a//b": "a/b"}
    got = {r.p: r.n for r in spark.createDataFrame([(c,) for c in cases], "p string").select("p", T.normal_path(F.col("p")).alias("n")).collect()}
    assert got == cases
