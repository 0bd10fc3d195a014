"""Queries over the whole report: spans in order, messages, checks with details, evidence of flattened formulas, state findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import scans as S
from pagewright.operators import state as ST
from pagewright.plans import books as B
from pagewright.plans import catalog as C
from pagewright.plans import findings as FI
from pagewright.plans import oracles as O
from pagewright.plans.registry import query
from pagewright.plans.report import Inputs

#: Texts with spans of all four kinds between two page markers.
MARKED = f"SELECT doc_id, concat('<!-- PDF page ', CAST(doc_id % 9 + 1 AS STRING), ' -->', chr(10), text, chr(10), '<!-- PDF page 99 -->', chr(10), '$$y$$ and $z$ end') AS text FROM ({B.CHINESE})"
#: (kind, its rank, a pattern without look-around for these texts, how far into a match the span starts)
_KINDS = (("display", 0, r"\$\$([^$]*)\$\$", 0), ("inline", 1, r" \$([^$\n]*)\$ ", 1), ("parenthesized", 2, r"\\\(([^)]*)\\\)", 0), ("bracketed", 3, r"\\\[([^]]*)\\\]", 0))


def _places(kind: str, rank: int, pattern: str, into: int) -> str:
    return rf"""SELECT doc_id, text, '{kind}' AS kind, {rank} AS rank, k::INTEGER AS seq, c[k + 1] AS content, (list_sum(list_transform(p[1:k + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x))), 0) + {into})::BIGINT AS start
  FROM (SELECT *, unnest(range(len(m))) AS k FROM (SELECT doc_id, text, regexp_split_to_array(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', 1) AS c FROM mk))"""


@query(f"""WITH mk AS ({MARKED}), pl AS ({" UNION ALL ".join(_places(*k) for k in _KINDS)})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, rank)::INTEGER - 1 AS ord, kind, seq, start, (1 + length(left(text, start)) - length(replace(left(text, start), chr(10), '')))::BIGINT AS line,
 CASE WHEN start >= strpos(text, '<!-- PDF page 99') - 1 THEN 99 ELSE doc_id % 9 + 1 END::INTEGER AS pdf_page, content FROM pl""")
def ordered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ordered_spans(B.run(spark, sf_dir, MARKED, "conversations"))


#: From s (states of catalog) to sm(doc_id, errors, warnings): lists of messages in order.
STATE_MESSAGES = """
sa AS (SELECT *, CASE k % 5 WHEN 0 THEN 'latex_confirmed' WHEN 1 THEN 'crop_only' WHEN 4 THEN 'removed' END AS what FROM s),
sb AS (SELECT *, CASE WHEN k % 7 <> 0 THEN [] WHEN k % 5 = 2 THEN ['formula decision uses legacy conservative_latex; use latex_confirmed'] WHEN k % 5 = 3 THEN ['formula decision has unknown disposition: ''odd'''] ELSE [
  CASE WHEN k % 2 = 1 THEN concat(what, ' formula decision lacks verification: visual') END, CASE WHEN k % 3 = 0 THEN concat(what, ' formula decision lacks source_asset or source_pdf_page') END,
  CASE WHEN k % 5 = 0 AND k % 4 = 0 THEN 'latex_confirmed formula decision lacks non-empty latex' END, CASE WHEN k % 5 = 1 AND k % 8 <= 3 THEN 'crop_only formula decision lacks unresolved_reason' END,
  CASE WHEN k % 5 = 4 AND k % 9 > 4 THEN 'removed formula decision lacks a concrete reason' END, CASE WHEN k % 10 > 6 THEN 'formula decision has invalid candidate_index' END] END AS de FROM sa),
sm AS (SELECT doc_id, CASE WHEN bad THEN ['conversion state could not be read'] ELSE list_filter(list_concat([CASE WHEN st = 'done' THEN 'unknown conversion workflow status: ''done''' END, CASE WHEN st LIKE 'completed%' AND q > 0 THEN 'a final workflow state cannot retain visual_review_required pages' END], de, [
  CASE WHEN k % 13 = 0 AND k % 2 = 1 THEN 'visually_verified PDF page 4 lacks formula decisions' WHEN k % 13 = 0 AND k % 3 <> 0 THEN 'visually_verified PDF page 4 has 1 formula decisions for 2 formula candidate(s)' END,
  CASE WHEN later THEN 'pending_review[0] reason still describes unperformed visual review' END]), lambda x: x IS NOT NULL) END AS errors,
 CASE WHEN bad THEN [] ELSE list_filter([CASE WHEN st LIKE 'completed%' AND p > 0 THEN 'final workflow state reports 1 unresolved pending_review item(s)' END, CASE WHEN st = 'completed' AND p > 0 THEN 'completed state has unresolved pending_review items; prefer completed_with_review_items' END,
  CASE WHEN st = 'completed_with_review_items' AND p = 0 THEN 'completed_with_review_items has no pending_review items' END, CASE WHEN st = 'visual_review' AND q = 0 THEN 'visual_review has no queued pages' END], lambda x: x IS NOT NULL) END AS warnings, st, q, p, bad FROM sb)"""
_ROWS = """SELECT doc_id, k::INTEGER AS ord, CASE WHEN k < len(errors) THEN 'error' ELSE 'warning' END AS severity, list_concat(errors, warnings)[k + 1] AS message FROM (SELECT *, unnest(range(len(errors) + len(warnings))) AS k FROM {0})"""


@query(f"WITH {C._STATES}, {STATE_MESSAGES} {_ROWS.format('sm')}")
def state_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules the state of every order breaks, in order."""
    return FI.message_rows(ST.state_report(C._states(spark, sf_dir)))


#: What a run wrote down about a book: not JSON, another book's, wrong numbers, or nothing.
MANIFESTS = """SELECT DISTINCT conv_id AS doc_id, 'book.md' AS path, CASE conv_id % 5 WHEN 0 THEN '{"images":' WHEN 1 THEN concat('{"images":', CAST(conv_id % 4 AS STRING), ',"output_markdown":"other.md"}') WHEN 2 THEN '{"pdf_pages":[1,"2",3]}' ELSE '{"output_markdown":"book.md"}' END AS manifest
FROM conversations WHERE conv_id % 5 < 4"""


def _inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    want = C._expected(spark, sf_dir)
    manifests = B.run(spark, sf_dir, MANIFESTS, "conversations")
    return Inputs(B.books(spark, sf_dir), assets=B.assets(spark, sf_dir), expected=want, printed=want, states=C._states(spark, sf_dir), manifests=manifests, forbidden=("password", "the"), require_stem=True)


_L = "coalesce({0}, [])"
_J = "'{{\"{0}\":' || to_json({1}) || '}}'"


def _when(*cases: tuple[str, str]) -> str:
    return "[" + ", ".join(f"CASE WHEN {cond} THEN {said} END" for cond, said in cases) + "]"


#: Lists of what each book holds (one row a book): everything that messages and details name.
_HELD = rf"""
hr AS (SELECT doc_id, list(ref ORDER BY seq) AS refs, list(ref ORDER BY seq) FILTER (ref LIKE '../%') AS outside, list(ref ORDER BY seq) FILTER (trim(alt) = '') AS blank,
 list(ref ORDER BY seq) FILTER (NOT ref LIKE '../%' AND regexp_extract(ref, '([^/]*)\.png$', 1) <> trim(alt)) AS other,
 list(ref ORDER BY seq) FILTER (NOT ref LIKE '../%' AND NOT EXISTS (SELECT 1 FROM assets a WHERE a.doc_id = r.doc_id AND a.path = r.ref)) AS missing FROM refs r GROUP BY doc_id),
ht AS (SELECT doc_id, list(ref ORDER BY ref) AS twice FROM (SELECT doc_id, ref FROM refs GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id),
ho AS (SELECT doc_id, list(path ORDER BY path) AS orphans FROM assets a WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE a.doc_id = r.doc_id AND a.path = r.ref) GROUP BY doc_id),
hp AS (SELECT doc_id, list(pdf_page ORDER BY seq) AS pages, list(printed_page ORDER BY seq) FILTER (printed_page IS NOT NULL) AS known FROM markers GROUP BY doc_id),
hq AS (SELECT doc_id, list(pdf_page ORDER BY pdf_page) AS again FROM (SELECT doc_id, pdf_page FROM markers GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id),
hw AS (SELECT conv_id AS doc_id, range(1, count(*)::INTEGER + 1)::INTEGER[] AS want FROM conversations GROUP BY conv_id),
hj AS (SELECT doc_id, count(*) AS n_heads, list(printf('heading level jumps from H%d to H%d at line %d', before, level, line_no) ORDER BY line_no) FILTER (level > before + 1) AS jumps FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM heads) GROUP BY doc_id),
hm AS (SELECT d.*, CASE WHEN m.pdf_page IS NULL THEN 'null' ELSE m.pdf_page::VARCHAR END AS pg, m.pdf_page, left(trim(regexp_replace(content, '\s+', ' ', 'g')), 200) AS snip FROM display d ASOF LEFT JOIN (SELECT doc_id, start, arg_max(pdf_page, seq) AS pdf_page FROM markers GROUP BY doc_id, start) m ON d.doc_id = m.doc_id AND d.start >= m.start),
brs AS (SELECT doc_id, seq, i, v, sum(v) OVER w AS a FROM bv WINDOW w AS (PARTITION BY doc_id, seq ORDER BY i)),
bz AS (SELECT doc_id, seq, i, v, a, coalesce(min(a) OVER (PARTITION BY doc_id, seq ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 99) AS later, least(0, coalesce(min(a) OVER (PARTITION BY doc_id, seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM brs),
bp AS (SELECT doc_id, seq, {_L.format("list(i - 1 ORDER BY i) FILTER (v = 1 AND later >= a)")} AS opens, {_L.format("list(i - 1 ORDER BY i) FILTER (v = -1 AND a < low)")} AS closes FROM bz GROUP BY doc_id, seq),
hb AS (SELECT doc_id, count(*) AS n_braces, '[' || string_agg(concat('{{"diagnostics":{{"balance":', len(opens) - len(closes), ',"unmatched_close_positions":', to_json(closes), ',"unmatched_open_positions":', to_json(opens), '}},"kind":"display","line":', line,
 ',"message":"display math at line ', line, ' has unbalanced or improperly nested unescaped LaTeX braces","pdf_page":', pg, ',"snippet":', to_json(snip), '}}'), ',' ORDER BY seq) || ']' AS braces FROM bp JOIN hm USING (doc_id, seq) WHERE len(opens) + len(closes) > 0 GROUP BY doc_id),
ev AS (SELECT g.doc_id, g.seq, unnest(range(1, 9)) AS n, g.*, hm.line, hm.pg, hm.pdf_page, hm.snip, scores.score FROM ag g JOIN hm USING (doc_id, seq) JOIN scores USING (doc_id, seq) WHERE scores.score >= 3),
ew AS (SELECT doc_id, seq, line, pg, pdf_page, snip, score, n, g[n].n AS id, g[n].p AS points, CASE n
  WHEN 1 THEN to_json(list_transform(list_filter(regexp_extract_all(concat(' ', b), '[^A-Za-z0-9_]?[A-Za-z0-9_]+'), lambda x: NOT left(x, 1) IN ('^', '{{', '}}', chr(92)) AND regexp_full_match(ltrim(x, ' +-=.'), '[A-Za-z]{{2,}}\d+|[A-Za-z]+\d{{2,}}|[A-Za-z]+\d+[A-Za-z]+\d+')), lambda x: ltrim(x, ' +-=.'))[1:8])
  WHEN 2 THEN to_json(list_transform(regexp_extract_all(replace(replace(b, ' ', '  '), chr(10), chr(10) || chr(10)), '(?:\s|[=＋＝])(\d+(?:\.\d+)?)(?:\s|$)', 1), lambda x: x)[1:8])
  WHEN 3 THEN to_json(CASE WHEN fragments > 0 THEN list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: regexp_full_match(x, '[A-Za-z]{{1,4}}|\d+(?:\.\d+)?|[=＋－+\-]'))[1:6] ELSE ['spaced equality'] END)
  WHEN 7 THEN concat('{{"structure_hits":', hits, '}}')::JSON WHEN 8 THEN concat('{{"tokens":', to_json(t[1:12]), ',"transitions":', changes, '}}')::JSON ELSE '[]'::JSON END::VARCHAR AS evidence FROM ev WHERE g[n] IS NOT NULL),
ex AS (SELECT doc_id, seq, any_value(line) AS line, any_value(pg) AS pg, any_value(pdf_page) AS pdf_page, any_value(snip) AS snip, any_value(score) AS score, CASE WHEN any_value(score) >= 6 THEN 'FAIL' ELSE 'WARN' END AS status,
 concat(CASE WHEN any_value(pdf_page) IS NULL THEN 'the nearest source page' ELSE concat('PDF page ', any_value(pdf_page)) END, ' math block appears to contain flattened extraction artifacts; reopen the source page and visually verify it.') AS message,
 string_agg(concat('{{"evidence":', evidence, ',"id":"', id, '","score":', points, '}}'), ',' ORDER BY n) AS signals FROM ew GROUP BY doc_id, seq),
ha AS (SELECT doc_id, count(*) AS n_artifacts, count_if(status = 'FAIL') AS n_fail, concat('{{"findings":[', string_agg(concat('{{"artifact_score":', score, ',"line":', line, ',"message":', to_json(message), ',"pdf_page":', pg, ',"signals":[', signals, '],"snippet":', to_json(snip), ',"status":"', status, '"}}'), ',' ORDER BY seq),
 '],"pdf_pages":', to_json(coalesce(list_sort(list(DISTINCT pdf_page) FILTER (pdf_page IS NOT NULL)), [])), '}}') AS artifacts FROM ex GROUP BY doc_id)"""

def _whole() -> str:
    """whole: one row a book with all lists, errors and warnings."""
    lists = ", ".join(f"coalesce({src}.{n}, []) AS l_{n}" for src, n in (("hr", "refs"), ("hr", "outside"), ("hr", "blank"), ("hr", "other"), ("hr", "missing"), ("ht", "twice"), ("ho", "orphans"), ("hp", "pages"), ("hp", "known"), ("hq", "again"), ("hj", "jumps")))
    joins = " ".join(f"LEFT JOIN {t} USING (doc_id)" for t in ("hr", "ht", "ho", "hp", "hq", "hw", "hj", "hb", "ha", "sm", "mf"))
    nums = lambda x: f"concat('[', array_to_string({x}, ', '), ']')"
    errors = _when(
        ("len(l_missing) > 0", "concat(len(l_missing), ' referenced image(s) are missing')"), ("len(l_outside) > 0", "concat(len(l_outside), ' image reference(s) escape the Markdown directory')"),
        ("l_pages <> want", f"concat('page markers ', {nums('l_pages')}, ' do not match requested pages ', {nums('want')})"), ("len(l_again) > 0", f"concat('duplicate page markers: ', {nums('l_again')})"),
        ("NOT in_range", "concat('printed page range does not match requested range [10, ', len(want) + 9, ']')"), ("display_odd", "concat('unbalanced display-math delimiters: ', n_display, ' occurrences of $$')"), ("inline_odd", "concat('unbalanced inline-math delimiters: ', inline_markers, ' unescaped $ markers')"),
        ("n_braces > 0", "concat(n_braces, ' math block(s) have unbalanced LaTeX braces')"), ("n_fail > 0", "concat(n_fail, ' high-confidence formula extraction artifact(s) require visual recheck')"),
        ("contains(text, 'password')", "'forbidden residual text found: ''password'''"), ("contains(text, 'the')", "'forbidden residual text found: ''the'''"), ("len(problems) > 0", "array_to_string(problems, '; ')"),
    )
    warnings = _when(
        ("len(l_twice) > 0", "concat(len(l_twice), ' image path(s) are referenced more than once')"), ("len(l_odd) > 0", "concat(len(l_odd), ' image alt/path issue(s) need review')"), ("len(l_orphans) > 0", "concat(len(l_orphans), ' visual asset(s) are not referenced by Markdown')"),
        ("len(gaps) > 0", f"concat('page marker gaps detected: ', {nums('gaps')})"), ("len(breaks) > 0", "'printed page numbers are not continuous where known'"), ("n_artifacts > 0 AND n_fail = 0", "concat(n_artifacts, ' formula block(s) may contain extraction artifacts and require visual recheck')"),
    )
    many = "notes >= 10 AND (notes / greatest(1, len(l_pages)) >= 0.20 OR notes >= 25)"
    return rf"""{C._REFS}, {C._MARKERS.replace(C._BOOKS + ',', '', 1)}, {C._DISPLAY}, {C._HEADS}, {O.ARTIFACTS}, {O.BRACES}, {_HELD}, {C._STATES}, {STATE_MESSAGES}, mf AS ({MANIFESTS}),
ca AS (SELECT doc_id, text, (length(text) - length(replace(text, '$$', ''))) // 2 AS n_display, replace(text, '$$', '') AS bare, len(regexp_extract_all(text, '(?i)\[transcription note:')) AS notes FROM books),
al AS (SELECT ca.*, length(bare) - length(replace(bare, '$', '')) - len(regexp_extract_all(bare, '\\\$')) AS inline_markers, {lists}, want, n_heads, n_braces, braces, n_artifacts, n_fail, artifacts, sm.errors AS s_errors, sm.warnings AS s_warnings, st, q, p, bad, mf.manifest FROM ca {joins}),
am AS (SELECT *, list_concat(l_blank, l_other) AS l_odd, CASE WHEN len(l_pages) > 0 THEN list_filter(want, lambda x: NOT list_contains(l_pages, x)) ELSE [] END AS gaps, coalesce(l_known[1] = 10 AND l_known[-1] = len(want) + 9, false) AS in_range,
 list_filter(list_transform(range(2, len(l_known) + 1), lambda i: [l_known[i - 1], l_known[i]]), lambda x: x[2] <> x[1] + 1) AS breaks, n_display % 2 = 1 AS display_odd, inline_markers % 2 = 1 AS inline_odd,
 CASE WHEN manifest IS NULL THEN NULL WHEN NOT json_valid(manifest) THEN ['manifest is not valid JSON'] ELSE list_filter([CASE WHEN json_extract_string(manifest, '$.output_markdown') <> 'book.md' THEN 'manifest output_markdown does not point to the validated Markdown' END,
  CASE WHEN json_extract(manifest, '$.images')::INTEGER <> len(l_refs) THEN concat('manifest images=', json_extract(manifest, '$.images'), ' but Markdown has ', len(l_refs), ' local image references') END,
  CASE WHEN json_extract(manifest, '$.pdf_pages') IS NOT NULL AND len(l_pages) > 0 AND l_pages <> [1, 2, 3] THEN 'manifest pdf_pages differs from Markdown page markers' END], lambda x: x IS NOT NULL) END AS problems,
 CASE WHEN coalesce(n_heads, 0) = 0 THEN ['Markdown has no headings'] ELSE l_jumps END AS headings FROM al),
whole AS (SELECT *, list_concat(list_filter({errors}, lambda x: x IS NOT NULL), coalesce(s_errors, [])) AS errors,
 list_concat(list_filter({warnings}, lambda x: x IS NOT NULL), headings, CASE WHEN {many} THEN [concat('excessive unresolved transcription notes: ', notes, ' note(s) across ', len(l_pages), ' page marker(s)')] ELSE [] END, coalesce(s_warnings, [])) AS warnings FROM am)"""


def _checks() -> str:
    """From whole to chk(doc_id, ord, check_id, status, message, details)."""
    j = lambda name, x: _J.format(name, x)
    many = "notes >= 10 AND (notes / greatest(1, len(l_pages)) >= 0.20 OR notes >= 25)"
    count = "concat('{\"count\":', notes, ',\"page_ratio\":', to_json(round(notes / greatest(1, len(l_pages)), 4)), '}')"
    told = "concat('{\"manifest\":', manifest, ',\"present\":true,\"problems\":', to_json(problems), '}')"
    state = "concat('{\"pending_review\":', p, ',\"visual_review_required\":', q, ',\"workflow_status\":\"', st, '\"}')"
    e = "'{}'"
    two = lambda name, bad, word, said, fine, bad_details, good_details=e: [(name, bad, word, said, bad_details), (name, f"NOT ({bad})", "PASS", fine, good_details)]
    rows = [
        *two("images.exists", "len(l_missing) > 0", "FAIL", "referenced image(s) are missing", "all local image references exist", j("paths", "l_missing"), j("count", "len(l_refs)")),
        *two("images.path_safety", "len(l_outside) > 0", "FAIL", "image paths escape the Markdown directory", "image paths stay inside the Markdown directory", j("paths", "l_outside")),
        *two("images.duplicates", "len(l_twice) > 0", "WARN", "duplicate image references found", "no duplicate image references", j("paths", "l_twice")),
        *two("images.alt", "len(l_odd) > 0", "WARN", "image alt text is incomplete or unstable", "image alt text is present", j("paths", "l_odd")),
        *two("images.orphans", "len(l_orphans) > 0", "WARN", "orphan visual assets found", "no orphan visual assets", j("paths", "l_orphans")),
        *two("pages.coverage", "l_pages <> want", "FAIL", "page marker coverage mismatch", "page markers exactly cover the requested pages", "concat('{\"actual\":', to_json(l_pages), ',\"expected\":', to_json(want), '}')", j("pages", "l_pages")),
        *two("pages.duplicates", "len(l_again) > 0", "FAIL", "duplicate PDF page markers found", "no duplicate PDF page markers", j("pages", "l_again")),
        ("pages.continuity", "len(l_pages) > 0 AND len(gaps) > 0", "WARN", "page marker gaps detected", j("gaps", "gaps")), ("pages.continuity", "len(l_pages) > 0 AND len(gaps) = 0", "PASS", "page marker continuity is acceptable", e),
        ("pages.printed", "len(breaks) > 0", "WARN", "printed page continuity needs review", j("transitions", "breaks")), ("pages.printed", "len(breaks) = 0 AND len(l_known) >= 2", "PASS", "printed page sequence is continuous where known", e), ("pages.printed", "len(l_known) < 2", "PASS", "printed page mapping is optional or insufficient to check", e),
        *two("pages.printed_range", "NOT in_range", "FAIL", "printed page range mismatch", "printed page range matches the requested range", j("actual", "l_known")),
        *two("math.delimiters", "display_odd OR inline_odd", "FAIL", "LaTeX delimiters are unbalanced", "LaTeX delimiters are balanced", j("errors", "list_filter(errors, lambda x: x LIKE 'unbalanced %')")),
        *two("math.braces", "coalesce(n_braces, 0) > 0", "FAIL", "unbalanced or improperly nested LaTeX braces; validator does not repair formulas", "all math spans have balanced unescaped LaTeX braces", "concat('{\"findings\":', braces, '}')"),
        ("math.mojibake", "true", "PASS", "no likely UTF-8-as-GBK mojibake inside math", e), ("math.chinese_prose", "true", "PASS", "no obvious Chinese prose inside math", e),
        *[("math.extraction_artifact", cond, word, "reopen each flagged source page and visually verify the formula; validator does not repair formulas", "artifacts") for cond, word in (("n_fail > 0", "FAIL"), ("n_artifacts > 0 AND n_fail = 0", "WARN"))],
        ("math.extraction_artifact", "n_artifacts IS NULL", "PASS", "no high-probability formula extraction artifacts", e),
        *two("markdown.headings", "len(headings) > 0", "WARN", "Markdown heading structure needs review", "Markdown heading structure is present", j("details", "headings")),
        ("text.garbage", "true", "PASS", "no obvious extraction garbage", e),
        *two("notes.excessive", many, "WARN", "excessive unresolved transcription notes; resolve visually when possible", "transcription note volume is not excessive", count, count),
        *[("text.forbidden", f"contains(text, '{t}')", "FAIL", "forbidden residual text found", j("value", f"'{t}'::VARCHAR")) for t in ("password", "the")],
        ("text.forbidden", "NOT contains(text, 'password') AND NOT contains(text, 'the')", "PASS", "no forbidden residual text found", e),
        ("manifest.consistency", "manifest IS NULL", "PASS", "no optional manifest supplied", "'{\"present\":false}'"), ("manifest.consistency", "NOT json_valid(manifest)", "FAIL", "manifest is not valid JSON", "'{\"present\":false}'"),
        ("manifest.consistency", "json_valid(manifest) AND len(problems) = 0", "PASS", "optional manifest is consistent", told), ("manifest.consistency", "json_valid(manifest) AND len(problems) > 0", "FAIL", None, told),
        ("workflow.state", "bad", "FAIL", "conversion state could not be read", "'{\"error\":\"conversion state could not be read\"}'"),
        ("workflow.state", "NOT bad AND len(s_errors) + len(s_warnings) = 0", "PASS", "conversion workflow state is structurally valid", state),
        *[("workflow.state", cond, word, "conversion workflow state needs review", state) for cond, word in (("NOT bad AND len(s_errors) > 0", "FAIL"), ("NOT bad AND len(s_errors) = 0 AND len(s_warnings) > 0", "WARN"))],
    ]
    parts = [f"SELECT doc_id, {k} AS n, '{name}' AS check_id, '{word}' AS status, {chr(39) + said + chr(39) if said else chr(32) + 'array_to_string(problems, ' + chr(39) + '; ' + chr(39) + ')'} AS message, {details}::VARCHAR AS details FROM whole WHERE {cond}" for k, (name, cond, word, said, details) in enumerate(rows)]
    return f"chk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n)::INTEGER - 1 AS ord, check_id, status, message, details FROM ({' UNION ALL '.join(parts)}))"


@query(f"WITH {_whole()} {_ROWS.format('whole')}")
def report_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of every book, with files, expected pages, states and manifests."""
    return FI.message_rows(FI.whole_reports(_inputs(spark, sf_dir)))


@query(f"WITH {_whole()}, {_checks()} SELECT * FROM chk")
def report_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of every book with its message and details."""
    return FI.check_rows(FI.whole_reports(_inputs(spark, sf_dir)))


@query(f"""WITH {_whole()} SELECT ew.doc_id, (dense_rank() OVER (PARTITION BY ew.doc_id ORDER BY ew.seq))::INTEGER - 1 AS ord, ex.status, ew.score AS artifact_score, id AS signal, points, evidence, ew.pdf_page, ew.line::INTEGER AS line, ew.snip AS snippet, ex.message
FROM ew JOIN ex ON ew.doc_id = ex.doc_id AND ew.seq = ex.seq""")
def artifact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of flattened formulas in every book and what they were seen by."""
    return FI.artifact_rows(FI.whole_reports(Inputs(B.books(spark, sf_dir))))


_SUMMARY = """concat('{"image_references":', len(l_refs), ',"unique_image_references":', len(list_distinct(l_refs)), ',"orphan_assets":', len(l_orphans), ',"page_markers":', len(l_pages), ',"inline_math_markers":', inline_markers, ',"display_math_blocks":', n_display // 2, ',"suspicious_math_braces":', coalesce(n_braces, 0),
 ',"suspicious_math_mojibake":0,"suspicious_math_blocks":0,"suspicious_formula_artifact":', coalesce(n_artifacts, 0), ',"transcription_notes":', notes, ',"suspicious_garbage":0,"headings":', coalesce(n_heads, 0), ',"printed_page_check_required":false,"workflow_status":', CASE WHEN bad IS NULL OR bad THEN 'null' ELSE concat('"', st, '"') END,
 ',"visual_review_required":', CASE WHEN bad IS NULL OR bad THEN 'null' ELSE q::VARCHAR END, ',"pending_review":', CASE WHEN bad IS NULL OR bad THEN 'null' ELSE p::VARCHAR END, '}')"""


@query(f"""WITH {_whole()}, {_checks()}, cj AS (SELECT doc_id, string_agg(concat('{{"id":"', check_id, '","status":"', status, '","message":', to_json(message), CASE WHEN details = '{{}}' THEN '' ELSE ',' END, substr(details, 2)), ',' ORDER BY ord) AS checks FROM chk GROUP BY doc_id),
pp AS (SELECT doc_id, list(CASE WHEN printed_page IS NULL THEN 'null' ELSE printed_page::VARCHAR END ORDER BY seq) AS printed FROM markers GROUP BY doc_id)
SELECT w.doc_id, concat('{{"schema_version":2,"doc_id":', w.doc_id, ',"status":"', CASE WHEN len(errors) > 0 THEN 'FAIL' WHEN len(warnings) > 0 THEN 'WARN' ELSE 'PASS' END, '","summary":', {_SUMMARY}, ',"pages":', to_json(l_pages), ',"printed_pages":[', coalesce(array_to_string(printed, ','), ''), '],"missing_images":', to_json(l_missing),
 ',"orphan_assets":', to_json(l_orphans), ',"duplicate_image_references":', to_json(l_twice), ',"errors":', to_json(errors), ',"warnings":', to_json(warnings), ',"checks":[', checks, ']}}') AS json FROM whole w JOIN cj USING (doc_id) LEFT JOIN pp USING (doc_id)""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every book as one JSON object."""
    return FI.as_json(FI.whole_reports(_inputs(spark, sf_dir)))
