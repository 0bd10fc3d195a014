"""DuckDB SQL that states the rows of the larger queries from the tables alone. Parts are named subqueries that build on
`books(doc_id, text)` and on the parts before them; regular expressions do without look-around."""

from __future__ import annotations

from pagewright.plans import books as B

#: Fixed values of the screen for flattened formulas, as SQL.
_COMMANDS = "'frac','dfrac','tfrac','sqrt','cdot','times','mathrm','text','operatorname','sin','cos','tan','log','ln','Delta','alpha','beta','gamma','theta','mu','pi','sum','int','le','ge','approx','pm','perp','parallel'"
#: From display(doc_id, seq, start, content) to scores(doc_id, seq, start, score, signals).
ARTIFACTS = r"""
ab AS (SELECT doc_id, seq, start, content AS c, regexp_replace(content, '\\(?:text|mathrm|operatorname)\s*\{[^{}]*\}', '', 'g') AS b FROM display),
aw AS (SELECT *, regexp_extract_all(b, '[A-Za-z]+|\d+(?:\.\d+)?') AS t, len(regexp_extract_all(c, '[_^{}]')) + len(list_filter(regexp_extract_all(c, '\\([A-Za-z]+)', 1), lambda x: list_contains([COMMANDS], x))) AS hits,
  len(list_filter(string_split(b, chr(10)), lambda x: regexp_full_match(trim(x), '[A-Za-z]{1,4}|\d+(?:\.\d+)?|[=＋－+\-]'))) AS fragments,
  len(regexp_extract_all(replace(replace(b, ' ', '  '), chr(10), '  '), '(?:\s|[=＋＝])\d+(?:\.\d+)?(?:\s|$)')) AS numbers FROM ab),
ak AS (SELECT *, list_transform(t, lambda x: regexp_matches(x, '^[A-Za-z]')) AS k FROM aw),
ac AS (SELECT *, len(list_filter(range(2, len(k) + 1), lambda i: k[i] <> k[i - 1])) AS changes FROM ak),
ag AS (SELECT *, [
  CASE WHEN regexp_matches(b, '(?:^|[^_^{}\\A-Za-z0-9])(?:[A-Za-z]{2,}\d+|[A-Za-z]+\d{2,}|[A-Za-z]+\d+[A-Za-z]+\d+)(?:$|[^A-Za-z0-9_])') THEN {'n': 'digit_letter_flattening', 'p': 2} END,
  CASE WHEN numbers >= 2 AND length(b) >= 20 THEN {'n': 'isolated_number_fragments', 'p': 2} END,
  CASE WHEN fragments >= 2 OR (regexp_matches(b, '=\s*=') AND NOT contains(b, '\frac')) THEN {'n': 'fraction_like_broken_structure', 'p': 3} END,
  CASE WHEN regexp_matches(b, '(?:^|[^\\^_{}A-Za-z])(?:m\s*/\s*s|N\s*/\s*kg|m\s*·\s*s)\s*\d+(?:$|[^A-Za-z0-9])') THEN {'n': 'flattened_unit_exponent', 'p': 1} END,
  CASE WHEN regexp_matches(b, '[（），。＋－＝：；]') THEN {'n': 'fullwidth_math_punctuation', 'p': 1} END,
  CASE WHEN regexp_matches(b, '（\s*\d+\s*）') THEN {'n': 'orphan_equation_label', 'p': 2} END,
  CASE WHEN length(b) >= 24 AND hits <= 2 AND regexp_matches(b, '[A-Za-z]') AND regexp_matches(b, '\d') THEN {'n': 'low_latex_structure_density', 'p': 1} END,
  CASE WHEN len(k) >= 7 AND changes >= 4 AND hits <= 3 THEN {'n': 'dense_alternating_tokens', 'p': 2} END] AS g FROM ac),
scores AS (SELECT doc_id, seq, start, coalesce(list_sum(list_transform(list_filter(g, lambda x: x IS NOT NULL), lambda x: x.p)), 0)::INTEGER AS score, array_to_string(list_transform(list_filter(g, lambda x: x IS NOT NULL), lambda x: x.n), ',') AS signals FROM ag)""".replace("COMMANDS", _COMMANDS)

#: From display to braces(doc_id, seq): spans with an unmatched brace.
BRACES = r"""
bs AS (SELECT doc_id, seq, regexp_replace(content, '\\(.|\n)', '  ', 'g') AS c FROM display),
bk AS (SELECT doc_id, seq, unnest(range(1, length(c) + 1)) AS i, c FROM bs WHERE contains(c, '{') OR contains(c, '}')),
bv AS (SELECT doc_id, seq, i, CASE substr(c, i, 1) WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END AS v FROM bk),
bw AS (SELECT doc_id, seq, v, sum(v) OVER (PARTITION BY doc_id, seq ORDER BY i) AS a FROM bv),
braces AS (SELECT doc_id, seq FROM bw GROUP BY ALL HAVING least(0, min(a)) < 0 OR sum(v) <> 0)"""


def facts(forbidden: str | None = None, assets: bool = False, expected: bool = False, stem: bool = False) -> str:
    """facts: the columns of the report, from books, markers, display, heads, refs (and assets), scores, braces."""
    want = "e AS (SELECT conv_id AS doc_id, count(*)::INTEGER AS n FROM conversations GROUP BY conv_id)," if expected else ""
    lost = """fm AS (SELECT doc_id, count(*) AS missing FROM refs r WHERE NOT ref LIKE '../%' AND NOT EXISTS (SELECT 1 FROM assets a WHERE a.doc_id = r.doc_id AND a.path = r.ref) GROUP BY doc_id),
fo AS (SELECT doc_id, count(*) AS orphans FROM assets a WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE a.doc_id = r.doc_id AND a.path = r.ref) GROUP BY doc_id),""" if assets else ""  # fmt: skip
    stems = " + count_if(NOT ref LIKE '../%' AND regexp_extract(ref, '([^/]*)\\.png$', 1) <> trim(alt))" if stem else ""
    term = f"contains(text, '{forbidden}')::BIGINT" if forbidden else "0::BIGINT"
    pages = """(coalesce(p.pages, []) <> range(1, e.n + 1)::INTEGER[])::BIGINT AS uncovered, CASE WHEN p.pages IS NULL THEN 0 ELSE len(list_filter(range(1, e.n + 1)::INTEGER[], lambda x: NOT list_contains(p.pages, x))) END::BIGINT AS gaps, 1::BIGINT AS expects,
 CASE WHEN coalesce(p.printed[1] = 10 AND p.printed[-1] = e.n + 9, false) THEN 1 ELSE 2 END::BIGINT AS printed_range""" if expected else "0::BIGINT AS uncovered, 0::BIGINT AS gaps, 0::BIGINT AS expects, 0::BIGINT AS printed_range"  # fmt: skip
    found = "coalesce(fm.missing, 0)::BIGINT AS missing, coalesce(fo.orphans, 0)::BIGINT AS orphans" if assets else "0::BIGINT AS missing, 0::BIGINT AS orphans"
    joins = ("LEFT JOIN fm USING (doc_id) LEFT JOIN fo USING (doc_id)" if assets else "") + (" LEFT JOIN e USING (doc_id)" if expected else "")
    return rf"""
fr AS (SELECT doc_id, count(*) AS refs, count(DISTINCT ref) AS unique_refs, count_if(ref LIKE '../%') AS outside, count_if(trim(alt) = ''){stems} AS alt FROM refs GROUP BY doc_id),
fd AS (SELECT doc_id, count(*) AS duplicate_refs FROM (SELECT doc_id, ref FROM refs GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id), {lost} {want}
fp AS (SELECT doc_id, list(pdf_page ORDER BY seq) AS pages, list(printed_page ORDER BY seq) FILTER (printed_page IS NOT NULL) AS printed, count(*) AS markers FROM markers GROUP BY doc_id),
fq AS (SELECT doc_id, count(*) AS duplicate_pages FROM (SELECT doc_id, pdf_page FROM markers GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id),
fs AS (SELECT doc_id, count_if(score >= 6) AS artifact_fail, count_if(score >= 3) AS artifacts FROM scores GROUP BY doc_id),
fb AS (SELECT doc_id, count(*) AS braces FROM braces GROUP BY doc_id),
fh AS (SELECT doc_id, count(*) AS headings, count_if(level > before + 1) AS jumps FROM (SELECT doc_id, level, lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM heads) GROUP BY doc_id),
ft AS (SELECT doc_id, text, (length(text) - length(replace(text, '$$', ''))) // 2 AS dm, replace(text, '$$', '') AS bare FROM books),
fc AS (SELECT doc_id, text, dm, length(bare) - length(replace(bare, '$', '')) - len(regexp_extract_all(bare, '\\\$')) AS im FROM ft),
facts AS (SELECT fc.doc_id, coalesce(refs, 0)::BIGINT AS refs, coalesce(unique_refs, 0)::BIGINT AS unique_refs, coalesce(outside, 0)::BIGINT AS outside, coalesce(duplicate_refs, 0)::BIGINT AS duplicate_refs, coalesce(alt, 0)::BIGINT AS alt, {found},
 coalesce(p.markers, 0)::BIGINT AS markers, coalesce(duplicate_pages, 0)::BIGINT AS duplicate_pages, coalesce(len(p.printed), 0)::BIGINT AS known_printed,
 coalesce(len(list_filter(range(2, len(p.printed) + 1), lambda i: p.printed[i] <> p.printed[i - 1] + 1)), 0)::BIGINT AS printed_breaks, {pages},
 (dm % 2 + im % 2 + (len(regexp_extract_all(text, '\\\(')) <> len(regexp_extract_all(text, '\\\)')))::INT + (len(regexp_extract_all(text, '\\\[')) <> len(regexp_extract_all(text, '\\\]')))::INT)::BIGINT AS delimiters,
 (dm // 2)::BIGINT AS display_blocks, im::BIGINT AS inline_markers, coalesce(braces, 0)::BIGINT AS braces, 0::BIGINT AS mojibake, 0::BIGINT AS prose, coalesce(artifact_fail, 0)::BIGINT AS artifact_fail, coalesce(artifacts, 0)::BIGINT AS artifacts,
 coalesce(headings, 0)::BIGINT AS headings, coalesce(jumps, 0)::BIGINT AS jumps, (contains(text, chr(65533))::INT + regexp_matches(text, '[\x{{E000}}-\x{{F8FF}}]')::INT)::BIGINT AS garbage,
 len(regexp_extract_all(text, '(?i)\[transcription note:'))::BIGINT AS notes, {term} AS forbidden, 0::BIGINT AS manifest, 0::BIGINT AS state_errors, 0::BIGINT AS state_warnings, 0::BIGINT AS has_state
 FROM fc LEFT JOIN fr USING (doc_id) LEFT JOIN fd USING (doc_id) LEFT JOIN fp p USING (doc_id) LEFT JOIN fq USING (doc_id) LEFT JOIN fs USING (doc_id) LEFT JOIN fb USING (doc_id) LEFT JOIN fh USING (doc_id) {joins}),
counted AS (SELECT *, ((missing > 0)::INT + (outside > 0)::INT + (uncovered > 0)::INT + (duplicate_pages > 0)::INT + (braces > 0)::INT + (mojibake > 0)::INT + (prose > 0)::INT + (artifact_fail > 0)::INT + (garbage > 0)::INT + (manifest > 0)::INT + (printed_range = 2)::INT + delimiters + forbidden + state_errors)::BIGINT AS errors,
 ((duplicate_refs > 0)::INT + (alt > 0)::INT + (orphans > 0)::INT + (gaps > 0)::INT + (expects = 0 AND markers = 0)::INT + (known_printed >= 2 AND printed_breaks > 0)::INT + (artifacts > 0 AND artifact_fail = 0)::INT + jumps + (headings = 0)::INT
 + (notes >= 10 AND (notes / greatest(1, markers) >= 0.20 OR notes >= 25))::INT + state_warnings)::BIGINT AS warnings FROM facts),
reports AS (SELECT *, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM counted)"""


def _two(bad: str, word: str) -> str:
    return f"CASE WHEN {bad} THEN '{word}' ELSE 'PASS' END"


_STATUS = [
    ("images.exists", _two("missing > 0", "FAIL")), ("images.path_safety", _two("outside > 0", "FAIL")), ("images.duplicates", _two("duplicate_refs > 0", "WARN")), ("images.alt", _two("alt > 0", "WARN")), ("images.orphans", _two("orphans > 0", "WARN")),
    ("pages.coverage", _two("markers = 0", "WARN")), ("pages.duplicates", _two("duplicate_pages > 0", "FAIL")), ("pages.printed", _two("known_printed >= 2 AND printed_breaks > 0", "WARN")), ("math.delimiters", _two("delimiters > 0", "FAIL")),
    ("math.braces", _two("braces > 0", "FAIL")), ("math.mojibake", _two("mojibake > 0", "FAIL")), ("math.chinese_prose", _two("prose > 0", "FAIL")), ("math.extraction_artifact", "CASE WHEN artifact_fail > 0 THEN 'FAIL' WHEN artifacts > 0 THEN 'WARN' ELSE 'PASS' END"),
    ("markdown.headings", _two("jumps > 0 OR headings = 0", "WARN")), ("text.garbage", _two("garbage > 0", "FAIL")), ("notes.excessive", _two("notes >= 10 AND (notes / greatest(1, markers) >= 0.20 OR notes >= 25)", "WARN")), ("text.forbidden", _two("forbidden > 0", "FAIL")), ("manifest.consistency", _two("manifest > 0", "FAIL")),
]
#: The checks of a report to which nothing but documents and assets was given.
CHECK_ROWS = " UNION ALL ".join(f"SELECT doc_id, {k} AS ord, '{check}' AS check_id, {status} AS status FROM reports" for k, (check, status) in enumerate(_STATUS))

#: Line classes over a column line.
HEADING = r"""(length(line) <= 110 AND (regexp_matches(line, '^第[一二三四五六七八九十百零〇]+章[\s　]+.{1,100}$') OR (regexp_matches(line, '^(?:\d{1,2}(?:[.．]\d{1,2})?|\d{1,2})[.．、]\s*.{1,100}$') AND NOT right(line, 1) IN ('.', ';', '。', '！', '？', '；')) OR (length(line) <= 42 AND right(line, 1) = '—')))"""
BULLET = r"""regexp_matches(line, '^(?:\d+[.．、]|[（(][一二三四五六七八九十]+[）)])')"""
#: From cl(doc_id, page, ord, line) to parts(doc_id, page, part, kind, body) and md(doc_id, page, markdown).
PARAGRAPHS = rf"""
pk AS (SELECT *, CASE WHEN {HEADING} THEN 'heading' WHEN {BULLET} THEN 'bullet' ELSE 'text' END AS kind, right(line, 1) IN ('。', '！', '？', '；', '.', '!', '?', ';') AS ends FROM cl),
pl2 AS (SELECT *, lag(line) OVER w AS prev, kind <> 'text' OR coalesce(lag(ends) OVER w OR lag(kind) OVER w <> 'text', true) AS new FROM pk WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)),
pn AS (SELECT *, (sum(new::INT) OVER (PARTITION BY doc_id, page ORDER BY ord))::BIGINT AS part, CASE WHEN new THEN '' WHEN unicode(right(prev, 1)) < 128 AND unicode(left(line, 1)) < 128 THEN ' ' ELSE '' END AS sep FROM pl2),
parts AS (SELECT doc_id, page, part, arg_min(kind, ord) AS kind, trim(string_agg(concat(sep, line), '' ORDER BY ord)) AS body FROM pn GROUP BY doc_id, page, part),
md AS (SELECT doc_id, page, concat(regexp_replace(concat('<!-- PDF page ', page, ' -->', chr(10), chr(10), string_agg(CASE kind WHEN 'heading' THEN concat(CASE WHEN regexp_matches(body, '^第[一二三四五六七八九十百零〇]+章[\s　]+.{{1,100}}$') THEN '## ' ELSE '### ' END, body)
  WHEN 'bullet' THEN concat('- ', body) ELSE body END, concat(chr(10), chr(10)) ORDER BY part)), '\s+$', ''), chr(10), chr(10)) AS markdown FROM parts GROUP BY doc_id, page)"""

#: From the regions of books to cand(doc_id, page, candidate_index, ...): a fold over each page's likely formulas.
FORMULAS = f"""
g AS ({B.REGIONS}),
fx AS (SELECT doc_id, page, ord, text, greatest(x0 - 8, 0.0) AS x0, greatest(y0 - 8, 0.0) AS y0, least(x1 + 8, 480.0) AS x1, least(y1 + 8, 640.0) AS y1 FROM g WHERE text LIKE '%=%'),
fy AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page ORDER BY ord, x0, y0, x1, y1))::BIGINT AS k FROM fx WHERE x1 - x0 >= 18 AND y1 - y0 >= 10 AND (x1 - x0) * (y1 - y0) <= 480 * 640 * 0.22 AND NOT (page <= 15 AND y0 > 480)),
fold AS (SELECT DISTINCT doc_id, page, 0::BIGINT AS k, []::STRUCT(text VARCHAR, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS kept FROM fy
  UNION ALL SELECT s.doc_id, s.page, f.k, CASE WHEN len(list_filter(s.kept, lambda r: greatest(f.x0, r.x0) < least(f.x1, r.x1) AND greatest(f.y0, r.y0) < least(f.y1, r.y1) AND (f.x1 - f.x0) * (f.y1 - f.y0) <= (r.x1 - r.x0) * (r.y1 - r.y0) * 1.25)) > 0 THEN s.kept
    ELSE list_append(s.kept, struct_pack(text := f.text, x0 := f.x0, y0 := f.y0, x1 := f.x1, y1 := f.y1)) END FROM fold s JOIN fy f ON f.doc_id = s.doc_id AND f.page = s.page AND f.k = s.k + 1),
fz AS (SELECT doc_id, page, arg_max(kept, k)[1:6] AS kept FROM fold GROUP BY doc_id, page),
fi AS (SELECT doc_id, page, unnest(range(1, len(kept) + 1)) AS i, kept FROM fz),
cand AS (SELECT doc_id, page, i::INTEGER AS candidate_index, printf('pdf-page-%03d-formula-%02d', page, i) AS candidate_id, kept[i].text AS text, kept[i].x0 AS x0, kept[i].y0 AS y0, kept[i].x1 AS x1, kept[i].y1 AS y1 FROM fi)"""

#: From c(doc_id, page, candidate_index, x0, y0, x1, y1) to pairs(doc_id, page, a, b).
PAIRS = """
m AS (SELECT p.doc_id, p.page, p.candidate_index AS a, q.candidate_index AS b, greatest(0.0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS vo, least(p.y1 - p.y0, q.y1 - q.y0) AS vd, greatest(0.0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) AS ho,
  least(p.x1 - p.x0, q.x1 - q.x0) AS hd, greatest(p.x0, q.x0) - least(p.x1, q.x1) AS hg, greatest(p.y0, q.y0) - least(p.y1, q.y1) AS vg, abs(p.y0 + (p.y1 - p.y0) / 2 - q.y0 - (q.y1 - q.y0) / 2) AS cd, greatest(p.y1 - p.y0, q.y1 - q.y0) AS maxh
  FROM c p JOIN c q ON p.doc_id = q.doc_id AND p.page = q.page AND p.candidate_index < q.candidate_index),
pairs AS (SELECT doc_id, page, a, b FROM m WHERE (CASE WHEN vd > 0 THEN vo / vd ELSE 0 END >= 0.35 AND cd <= greatest(6.0, maxh * 0.70) AND hg <= greatest(120.0, vd * 6.0)) OR (CASE WHEN hd > 0 THEN ho / hd ELSE 0 END >= 0.30 AND vg <= greatest(18.0, maxh * 0.90)))"""
#: From pairs to grp(doc_id, page, group_first, members, x0, y0, x1, y1, member_height).
GROUPED = """
e AS (SELECT doc_id, page, a, b FROM pairs UNION SELECT doc_id, page, b, a FROM pairs),
reach AS (SELECT doc_id, page, candidate_index AS v, candidate_index AS r FROM c UNION SELECT e.doc_id, e.page, e.b, reach.r FROM reach JOIN e ON e.doc_id = reach.doc_id AND e.page = reach.page AND e.a = reach.v),
lab AS (SELECT doc_id, page, v, min(r) AS group_first FROM reach GROUP BY doc_id, page, v),
grp AS (SELECT l.doc_id, l.page, l.group_first, list(v ORDER BY v) AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(y1 - y0) AS member_height FROM lab l JOIN c ON c.doc_id = l.doc_id AND c.page = l.page AND c.candidate_index = l.v GROUP BY l.doc_id, l.page, l.group_first)"""
#: From grp and g to the contexts of groups.
CONTEXTS = """
tall AS (SELECT doc_id, page, quantile_cont(y1 - y0, 0.5) AS high FROM g GROUP BY doc_id, page),
near AS (SELECT grp.*, tall.high, g.ord, g.x0 AS lx0, g.y0 AS ly0, g.x1 AS lx1, g.y1 AS ly1, abs((g.y0 + g.y1) / 2 - (grp.y0 + grp.y1) / 2) AS off, (least(g.x1, grp.x1) > greatest(g.x0, grp.x0) AND least(g.y1, grp.y1) > greatest(g.y0, grp.y0)) AS meets
  FROM grp JOIN tall USING (doc_id, page) JOIN g USING (doc_id, page)),
anch AS (SELECT *, meets OR off <= greatest(high * 0.85, 8.0) AS anchor FROM near),
clos AS (SELECT doc_id, page, group_first, arg_min((ly0 + ly1) / 2, struct_pack(o := off, n := ord)) FILTER (anchor) AS closest, list(DISTINCT ord) FILTER (anchor) AS homes FROM anch GROUP BY doc_id, page, group_first),
kinds AS (SELECT a.*, closest, homes, CASE WHEN closest IS NOT NULL AND y1 - y0 <= greatest(high * 2.0, member_height * 1.35) THEN 'line' ELSE 'region' END AS kind FROM anch a JOIN clos USING (doc_id, page, group_first)),
fitting AS (SELECT *, CASE kind WHEN 'line' THEN anchor AND abs((ly0 + ly1) / 2 - closest) <= greatest(high * 0.85, 8.0)
  ELSE ly1 >= y0 - high * 2.2 AND ly0 <= y1 + high * 2.2 AND ((least(lx1 - lx0, x1 - x0) > 0 AND greatest(least(lx1, x1) - greatest(lx0, x0), 0.0) >= 0.15 * least(lx1 - lx0, x1 - x0)) OR coalesce(list_contains(homes, ord), false)) END AS fits FROM kinds),
counted7 AS (SELECT *, sum(fits::INT) OVER (PARTITION BY doc_id, page, group_first ORDER BY ord ROWS UNBOUNDED PRECEDING) AS nth FROM fitting),
shown AS (SELECT *, fits AND (kind = 'line' OR nth <= 7) AS s FROM counted7),
boxes AS (SELECT doc_id, page, group_first, any_value(members) AS members, any_value(kind) AS kind, any_value(high) AS high, any_value(member_height) AS mh, list(ord ORDER BY ord) FILTER (s) AS lines,
  least(any_value(x0), min(lx0) FILTER (s)) AS bx0, least(any_value(y0), min(ly0) FILTER (s)) AS by0, greatest(any_value(x1), max(lx1) FILTER (s)) AS bx1, greatest(any_value(y1), max(ly1) FILTER (s)) AS by1 FROM shown GROUP BY doc_id, page, group_first)
SELECT doc_id, page, printf('pdf-page-%03d-group-%02d', page, group_first) AS group_id, array_to_string(members, ',') AS candidate_indices, kind AS context_type, coalesce(array_to_string(lines, ','), '') AS context_lines,
  round_even(greatest(bx0 - greatest(high * 0.75, mh * 0.35), 0.0), 2) AS x0, round_even(greatest(by0 - greatest(high * 0.65, mh * 0.30), 0.0), 2) AS y0, round_even(least(bx1 + greatest(high * 0.75, mh * 0.35), 480.0), 2) AS x1, round_even(least(by1 + greatest(high * 0.65, mh * 0.30), 640.0), 2) AS y1,
  CASE WHEN len(members) = 1 THEN printf('pdf_page_%03d_formula_%02d_context.png', page, members[1]) ELSE printf('pdf_page_%03d_formula_group_%02d_%02d_context.png', page, members[1], members[-1]) END AS context_filename FROM boxes"""
