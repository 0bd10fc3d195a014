"""Files of reviewers: loading, selections against a plain loop, case folding and integers as Python has them."""

import json
import random
import sys
import unicodedata

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import merge
from pagewright.operators import state as ST


def chosen_by_hand(texts, entries):
    """(ord, index, error) of each entry that takes a candidate or stands for nothing."""
    used, out = set(), []
    for ordinal, index, text in entries:
        if index is not None:
            wrong = "candidate_index not found" if not 1 <= index <= len(texts) else "candidate text doesn't match" if text and texts[index - 1] != text else None
            at = index
        else:
            free = [k + 1 for k, t in enumerate(texts) if t == text and k + 1 not in used]
            at, wrong = (free[0], None) if free else (None, "candidate not found")
        if wrong:
            out.append((ordinal, at, wrong))
        elif at not in used:
            used.add(at)
            out.append((ordinal, at, None))
    return out


def test_selections_are_those_of_a_plain_loop(spark):
    rng = random.Random(4)
    regions, entries, want = [], [], set()
    for page in range(1, 120):
        texts = [rng.choice("xyz") for _ in range(rng.randrange(0, 7))]
        regions += [(0, page, k + 1, t) for k, t in enumerate(texts)]
        asked = [(k, rng.choice([None, None, *range(1, 8)]), rng.choice("xyzw")) for k in range(rng.randrange(0, 9))]
        asked = [(k, i, t if i is None or rng.random() < 0.3 else None) for k, i, t in asked]
        entries += [(0, page, *e) for e in asked]
        want |= {(page, *r) for r in chosen_by_hand(texts, asked)}
    rng.shuffle(entries)
    selection = spark.createDataFrame([(*e, None) for e in entries], "doc_id long, page int, ord int, candidate_index int, candidate string, error string")
    got = merge.select_candidates(spark.createDataFrame(regions, "doc_id long, page int, candidate_index int, text string"), selection).collect()
    assert len(got) == len(want) and {(r.page, r.ord, r.candidate_index, r.error) for r in got} == want


def test_an_index_takes_what_a_text_took_before(spark):
    regions = spark.createDataFrame([(0, 1, 1, "x"), (0, 1, 2, "x")], "doc_id long, page int, candidate_index int, text string")
    selection = spark.createDataFrame([(0, 1, 0, None, "x", None), (0, 1, 1, 1, None, None), (0, 1, 2, 1, None, None)], "doc_id long, page int, ord int, candidate_index int, candidate string, error string")
    assert [(r.ord, r.candidate_index, r.error) for r in merge.select_candidates(regions, selection).collect()] == [(0, 1, None)]


def files(spark, *objects, book="Book.pdf"):
    return spark.createDataFrame([(k, book, o if isinstance(o, str) or o is None else json.dumps(o)) for k, o in enumerate(objects)], "doc_id long, book string, json string")


def test_decision_files_of_all_shapes(spark):
    entry = {"pdf_page": 2, "candidate": " x "}
    cases = [
        [entry, entry | {"book": "other"}], {"decisions": [entry]}, {"formula_decisions": [], "decisions": [entry], "pages": {"4": {"formulas": [{"candidate": "y"}, 7]}, "5": 1}}, {"formula_decisions": {"a": 1}}, "{", None, "[]", {"decisions": [3, {"pdf_page": [1], "candidate": "x"}]},
        {"visual_confirmed_pages": ["x", 3], "text_visual_confirmed_pages": ["4"]},
    ]
    got = sorted((r.doc_id, r.what, -1 if r.page is None else r.page, r.candidate, r.error) for r in merge.decision_files(files(spark, *cases)).collect())
    lost = "file is not valid JSON"
    assert got == [
        (0, "decision", 2, "x", None), (1, "decision", 2, "x", None), (2, "decision", 4, "y", None), (2, "visual", 4, None, None), (3, "file", -1, None, "formula_decisions must be a list"), (4, "file", -1, None, lost), (5, "file", -1, None, lost),
        (7, "decision", -1, "", "formula decision must be an object"), (7, "decision", -1, "x", "formula decision has invalid pdf_page"), (8, "text", 4, None, None), (8, "visual", -1, None, "visual_confirmed_pages contains an invalid page"), (8, "visual", 3, None, None),
    ]
    assert merge.decision_files(files(spark).limit(0)).collect() == []
    pages = sorted((r.doc_id, r.page, r.what) for r in merge.confirmed_pages(files(spark, *cases)).collect())
    assert pages == [(0, 2, "visual"), (1, 2, "visual"), (2, 4, "visual"), (8, 3, "visual"), (8, 4, "text")]


def test_an_item_with_a_text_stands_for_the_text_alone(spark):
    got = merge.load_selection(files(spark, {"items": [{"pdf_page": 1, "candidate": "t", "candidate_index": 5, "candidate_id": "formula-6"}, {"pdf_page": 1, "candidate_id": "formula-06"}]})).orderBy("ord").collect()
    assert [(r.candidate_index, r.candidate_id, r.candidate, r.error) for r in got] == [(None, None, "t", None), (6, "formula-06", None, None)]


def test_case_folding_is_pythons(spark):
    rng = random.Random(1)
    odd = [ch for ch in map(chr, range(0x110000)) if ch.casefold() != ch or ch.lower() != ch]
    words = ["straße", "STRASSE", "ẞ", "Σίσυφος", "ΣΊΣΥΦΟΣ", "İstanbul", "ŉ", "ﬃ", ""] + ["".join(rng.choice(odd) for _ in range(6)) for _ in range(600)]
    got = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").select("w", T.casefold(F.col("w")).alias("f")).collect()
    assert all(r.f == (None if r.w is None else r.w.casefold()) for r in got)


def test_integers_are_pythons(spark):
    rng = random.Random(2)
    digits = [ch for ch in map(chr, range(sys.maxunicode)) if unicodedata.decimal(ch, None) is not None]
    parts = [*"0123456789", "_", "+", "-", " ", " ", "\x1c", ".", "x", "²"]
    said = ["".join(rng.choice(parts if rng.random() < 0.8 else digits) for _ in range(rng.randrange(0, 6))) for _ in range(4000)] + ["9223372036854775807", "", " +1_000 "]
    def by_python(t):
        try:
            return int(t)
        except ValueError:
            return None

    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", T.integer(F.col("t")).alias("n")).collect()
    assert all(r.n == by_python(r.t) for r in got) and sum(r.n is not None for r in got) > 400
    assert spark.createDataFrame([("9223372036854775808",), (None,)], "t string").select(T.integer(F.col("t")).alias("n")).collect() == [(None,), (None,)]


def test_numbers_of_json_values(spark):
    values = [3, -2.7, 2.7, 1e3, True, False, "7", " 1_0 ", "x", None, [1], {"a": 1}]
    want = [3, -2, 2, 1000, 1, 0, 7, 10, None, None, None, None]
    d = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, j string").select("k", ST.number_of(F.parse_json("j")).alias("n"))
    assert [r.n for r in d.orderBy("k").collect()] == want


def test_page_names_as_python_reads_them(spark):
    names = ["7", "007", " 12 ", "+3", "-3", "1_0", "１２", "٣", "2147483647", "2147483648", "1234567890", "", " ", "x", "1.0", "1__0", "²", None]

    def by_python(t):
        try:
            return n if t is not None and abs(n := int(t)) < 1 << 31 else None
        except ValueError:
            return None

    got = spark.createDataFrame([(t,) for t in names], "t string").select("t", ST.page_of(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: by_python(t) for t in names}


def test_pages_of_any_digits_in_a_state(spark):
    visual = {"disposition": "conservative_latex"}
    state = {"status": "in_progress", "formula_candidates": {"１２": ["a"], "x": ["b"]}, "visual_review_decisions": {"１２": {"formulas": [visual]}, "1234567890": visual, "x": visual}}
    d = spark.createDataFrame([("b", json.dumps(state))], "doc_id string, state string")
    assert sorted(r.page or 0 for r in ST.decisions(ST.parsed(d)).collect()) == [0, 12, 1234567890]


def test_sums_before(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(100) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 200, 1000)]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, v array<long>").select("k", T.before(F.col("v")).alias("b"))
    assert all(r.b == [sum(lists[r.k][:n]) for n in range(len(lists[r.k]))] for r in d.collect())
