"""Layout inside a page's row: the same as by tables, and no more of it is shuffled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import garbage, layout
from pagewright.operators import state as ST
from pagewright.plans import catalog, findings
from pagewright.plans.report import Inputs


def rows(df, *keys):
    return df.orderBy(*keys).collect()


def test_pages_have_the_groups_and_contexts_of_tables(spark):
    r, texts = random.Random(7), ["F=ma", "plain words", "v = 2x", None, "E＝mc^2 and more", "中文中文中文=x"]
    data = []
    for doc, page in [(d, p) for d in range(6) for p in (1, 9, 20)]:
        for k in range(r.choice((1, 4, 14, 30))):
            x, y = r.uniform(-20, 300), r.uniform(-20, 460)
            data.append((doc, page, k, r.choice((None, k // 3)), x, y, r.choice((x + r.uniform(5, 150), None)) if r.random() < 0.1 else x + r.uniform(5, 150), y + r.choice((9.0, 12.5, 14.0, 60.0)), r.choice(texts)))
    lines = spark.createDataFrame(data, "doc_id long, page int, ord int, block_index int, x0 double, y0 double, x1 double, y1 double, text string")
    sizes = spark.createDataFrame([(d, p, 360.0, 480.0) for d in range(5) for p in (1, 9, 20)], "doc_id long, page int, page_width double, page_height double")
    regions = layout.formula_regions(lines, sizes)
    pairs = layout.related_pairs(regions)
    groups = layout.region_groups(regions, pairs)
    contexts = layout.group_contexts(groups, lines, sizes)
    pages = layout.page_candidates(lines, sizes)
    assert regions.count() > 40 and pairs.count() > 10
    key = ("doc_id", "page")
    assert rows(layout.rows_of(pages, "regions"), *key, "candidate_index") == rows(regions.drop("candidate_id").select("doc_id", "page", "candidate_index", "text", *layout.BOX), *key, "candidate_index")
    of = lambda name, f: layout.rows_of(pages.select(*key, f(F.col("regions")).alias(name)), name)
    assert rows(of("pairs", layout.pairs_of), *key, "a", "b") == rows(pairs, *key, "a", "b")
    assert rows(of("groups", layout.groups_of), *key, "group_first") == rows(groups, *key, "group_first")
    found = rows(layout.page_contexts(pages), *key, "group_id")
    assert found == rows(contexts, *key, "group_id") and {x.context_type for x in found} == {"line", "region"}


def test_contexts_deal_lines_out_once(spark):
    plan = catalog.QUERIES["group_contexts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and "Window" not in plan  # the lines, and the sizes made from them


@pytest.mark.parametrize("name", ["clean_lines", "paragraphs", "page_markdown", "merged_markdown"])
def test_pages_are_made_once(spark, name):
    """No filter below a generator makes a page's lines or parts once more to look at their number."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if re.match(r"[\s:+|-]*Filter ", x) and "transform(" in x]


def test_pages_without_parts_have_no_markdown(spark):
    pages = spark.createDataFrame([(0, 1, "a\nb."), (0, 2, " \n\t"), (0, 3, None)], "doc_id long, page int, text string")
    parts = layout.page_parts(layout.cleaned_pages(layout.page_lines(pages), spark.createDataFrame([], "doc_id long, line string")))
    assert [tuple(r) for r in layout.parts_markdown(parts, blank=False).collect()] == [(0, 1, "<!-- PDF page 1 -->\n\na b.\n\n")]
    assert layout.parts_markdown(parts).count() == 3


def test_what_might_be_garbage():
    """Every character but those that can't be."""
    known = [(0, 0xA9), (0xAB, 0xB9), (0xBB, 0x2AF), (0x2000, 0x206F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF)]
    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", garbage.SUSPECT))
    assert not garbage.SUSPECT.startswith("[^")
    assert all((pattern.match(chr(k)) is None) == any(a <= k <= b for a, b in known) for k in range(0x110000))


def test_lines_of_odd_white_space(spark):
    odd = ["a  b\t\tc \u3000\n\u00a0\r\n x\u2003 \u2002y \u2028\u3000\u3000z\x1c \t", "", " ", "\n", "one\n", "\ta", None]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, text string")
    slow = F.filter(F.transform(text.lines(F.col("text")), text.compact), lambda x: x != "")
    assert all(a == b for a, b in d.select(text.filled_lines(F.col("text")), slow).collect())
    assert d.select(text.filled_lines(F.col("text"))).first()[0] == ["a b c", "x y", "z"]


def test_lines_are_put_together_in_order(spark):
    cases = {("a", "b", "中", "文", "c"): "a b中文c", (" a ",): "a", ("a", "", "b"): "a  b", ("", "", "x"): "x", ("中", "", "x"): "中x", (): ""}
    d = spark.createDataFrame([(list(c),) for c in cases], "x array<string>")
    assert {tuple(r.x): r.y for r in d.select("x", layout.join_lines(F.col("x")).alias("y")).collect()} == cases


def test_states_of_other_documents_are_not_looked_into(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "# t"), (1, "# u"), (2, "# v"), (3, None)], "doc_id long, text string")
    states = spark.createDataFrame([(1, '{"status": "done"}'), (2, "[1"), (7, '{"status": "done"}'), (None, "{}")], "doc_id long, state string")
    seen, whole = [], ST.state_report
    monkeypatch.setattr(ST, "state_report", lambda raw: seen.append(sorted(r.doc_id for r in raw.collect())) or whole(raw))
    got = findings.message_rows(findings.whole_reports(Inputs(docs, states=states))).filter("severity = 'error'")
    assert sorted((r.doc_id, r.message) for r in got.collect()) == [(1, "unknown conversion workflow status: 'done'")] * 2 + [(2, "conversion state could not be read")]
    assert seen == [[1, 2]]
