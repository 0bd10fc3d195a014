"""Queries over files of reviewers: decisions, selections, and what their entries stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import assets as A
from pagewright.operators import layout as L
from pagewright.operators import merge as ME
from pagewright.operators import scans as S
from pagewright.operators import state as ST
from pagewright.plans import books as B
from pagewright.plans import catalog as C
from pagewright.plans import oracles as O
from pagewright.plans.registry import query
from pagewright.streaming import books as SB

#: A file of decisions for every order: all shapes that are read, and all that aren't. Both engines make the same texts.
DECISIONS = """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'dir/Straße.pdf' WHEN 1 THEN 'STRASSE' ELSE 'plain.PDF' END AS book, CASE CAST(o_orderkey % 37 % 14 AS INT)
  WHEN 0 THEN concat('[{"pdf_page":', o_orderkey % 90, ',"candidate":" x ","disposition":"removed"},{"pdf_page":"3","book":"strasse.pdf","candidate":"y"},{"pdf_page":" 1_2 ","source_book":"a/PLAIN","source_text":"z"}]')
  WHEN 1 THEN concat('{"decisions":[{"pdf_page":"', o_orderkey % 50, '","candidate_index":', o_orderkey % 4, '},{"pdf_page":"z","candidate":"q"},{"pdf_page":4},5,{"pdf_page":null,"candidate":"w"}]}')
  WHEN 2 THEN concat('{"formula_decisions":[],"pages":{"', o_orderkey % 70, '":{"formulas":[{"candidate_id":"f-1"},3,{"candidate":"n","pdf_page":8}]},"88":4,"z":{"formulas":[{"candidate":"q"}]}}}')
  WHEN 3 THEN '{"formula_decisions":{"a":1}}' WHEN 4 THEN '[{"pdf_page":1' WHEN 5 THEN '"text"' WHEN 6 THEN '{"decisions":null}'
  WHEN 7 THEN concat('{"visual_confirmed_pages":[', o_orderkey % 30, ',"+2","x",2.7,true,null],"text_visual_confirmed_pages":[" 4 ",[1]]}')
  WHEN 8 THEN concat('{"formula_decisions":[{"candidate":null,"source_text":"s","pdf_page":6,"candidate_id":"c_', o_orderkey % 5, '"},{"candidate":7,"candidate_index":null,"pdf_page":1}],"visual_confirmed_pages":[9]}')
  WHEN 9 THEN '{"pages":[1]}' WHEN 10 THEN '{"decisions":[{"pdf_page":5,"book":3,"candidate":"no text"},{"pdf_page":5,"book":null,"candidate":"any book"}]}'
  WHEN 11 THEN '[]' WHEN 12 THEN '{"pages":{"11":{},"12":{"formulas":[{"source":"u","book":"plain"}]}},"visual_confirmed_pages":[13]}' ELSE '7' END AS json
FROM orders
"""
#: Names of books by which entries are known, case folded (for the names above).
_KEY = "regexp_replace(replace(lower(regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '(?i)\\.pdf$', '')), 'ß', 'ss'), '^$', '')"
_INT = """CASE json_type({0}) WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(json_extract_string({0}, '$')), '[+-]?\\d+(_\\d+)*') THEN replace(trim(json_extract_string({0}, '$')), '_', '')::INTEGER END
  WHEN 'UBIGINT' THEN ({0})::INTEGER WHEN 'BIGINT' THEN ({0})::INTEGER WHEN 'DOUBLE' THEN trunc(({0})::DOUBLE)::INTEGER WHEN 'BOOLEAN' THEN ({0})::BOOLEAN::INTEGER END"""
_FIELDS = lambda e: f"trim(coalesce(CASE WHEN json_type(coalesce(json_extract({e}, '$.candidate'), json_extract({e}, '$.source_text'), json_extract({e}, '$.source'))) = 'VARCHAR' THEN json_extract_string(coalesce(json_extract({e}, '$.candidate'), json_extract({e}, '$.source_text'), json_extract({e}, '$.source')), '$') END, ''))"
_GIVEN = "coalesce(json_type({0}) <> 'NULL', false)"
_FILLED = "coalesce(json_type({0}) = 'VARCHAR' AND trim(json_extract_string({0}, '$')) <> '', false)"
_NAMED = "coalesce(json_extract(e, '$.book'), json_extract(e, '$.source_book'))"


@query(f"""WITH f AS ({DECISIONS}), v AS (SELECT doc_id, book, CASE WHEN json_valid(json) THEN json::JSON END AS v FROM f),
t AS (SELECT *, json_type(v) AS ty, coalesce(json_extract(v, '$.formula_decisions'), json_extract(v, '$.decisions')) AS li FROM v),
s AS (SELECT *, ty = 'OBJECT' AND coalesce(json_type(json_extract(v, '$.pages')) = 'OBJECT', false) AND (li IS NULL OR json_type(li) = 'NULL' OR li::VARCHAR IN ('[]', '{{}}', '""', '0', 'false')) AS paged FROM t),
w AS (SELECT *, CASE WHEN v IS NULL THEN 'file is not valid JSON' WHEN ty NOT IN ('ARRAY', 'OBJECT') THEN 'visual decision file must contain an object or list' WHEN ty = 'OBJECT' AND NOT paged AND li IS NOT NULL AND json_type(li) <> 'ARRAY' THEN 'formula_decisions must be a list' END AS wrong FROM s),
l AS (SELECT doc_id, book, NULL AS pk, unnest(range(json_array_length(x)::INTEGER)) AS k, x FROM (SELECT doc_id, book, CASE WHEN ty = 'ARRAY' THEN v ELSE li END AS x FROM w WHERE wrong IS NULL AND NOT paged)),
pg AS (SELECT doc_id, book, json_extract(v, '$.pages') AS p, unnest(json_keys(json_extract(v, '$.pages'))) AS pk FROM w WHERE wrong IS NULL AND paged), pp AS (SELECT doc_id, book, pk, json_extract(p, '$."' || pk || '"') AS x FROM pg),
pl AS (SELECT doc_id, book, pk, unnest(range(coalesce(json_array_length(json_extract(x, '$.formulas')), 0)::INTEGER)) AS k, json_extract(x, '$.formulas') AS x FROM pp WHERE json_type(x) = 'OBJECT'),
e AS (SELECT doc_id, book, pk, k, json_extract(x, '$[' || k || ']') AS e FROM (SELECT * FROM l UNION ALL SELECT * FROM pl)),
m AS (SELECT * FROM e WHERE CASE WHEN json_type(e) <> 'OBJECT' THEN pk IS NULL ELSE NOT {_GIVEN.format(_NAMED)} OR coalesce(json_type({_NAMED}) = 'VARCHAR' AND {_KEY.format(f"json_extract_string({_NAMED}, '$')")} = {_KEY.format("book")}, false) END),
n AS (SELECT *, CASE WHEN json_type(e) <> 'OBJECT' THEN NULL WHEN json_extract(e, '$.pdf_page') IS NULL THEN {_INT.format("to_json(pk)")} ELSE {_INT.format("(json_extract(e, '$.pdf_page'))")} END AS page, {_FIELDS("e")} AS cand FROM m),
c AS (SELECT doc_id, 'visual' AS what, {_INT.format("to_json(pk)")} AS page FROM pp WHERE json_type(x) = 'OBJECT'
  UNION ALL SELECT doc_id, what, {_INT.format("x")} FROM (SELECT doc_id, what, json_extract(y, '$[' || k || ']') AS x FROM (SELECT doc_id, what, y, unnest(range(json_array_length(y)::INTEGER)) AS k FROM (
   SELECT doc_id, 'visual' AS what, json_extract(v, '$.visual_confirmed_pages') AS y FROM w WHERE wrong IS NULL AND ty = 'OBJECT' UNION ALL SELECT doc_id, 'text', json_extract(v, '$.text_visual_confirmed_pages') FROM w WHERE wrong IS NULL AND ty = 'OBJECT') WHERE y IS NOT NULL)))
SELECT doc_id, 'decision' AS what, page, k::INTEGER AS ord, cand AS candidate, CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.disposition') END AS disposition, CASE WHEN json_type(e) <> 'OBJECT' THEN 'formula decision must be an object' WHEN page IS NULL THEN 'formula decision has invalid pdf_page'
  WHEN cand = '' AND NOT {_GIVEN.format("(json_extract(e, '$.candidate_index'))")} AND NOT {_FILLED.format("(json_extract(e, '$.candidate_id'))")} THEN 'formula decision lacks candidate/source_text or candidate id' END AS error FROM n
UNION ALL SELECT doc_id, what, page, NULL, NULL, NULL, CASE WHEN page IS NULL THEN CASE what WHEN 'text' THEN 'text_visual_confirmed_pages contains an invalid page' ELSE 'visual_confirmed_pages contains an invalid page' END END FROM c
UNION ALL SELECT doc_id, 'file', NULL, NULL, NULL, NULL, wrong FROM w WHERE wrong IS NOT NULL""")
def decision_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ME.decision_files(B.run(spark, sf_dir, DECISIONS, "orders"))
    ordinal = F.when(F.col("what") == "decision", F.col("ord"))  # the pages of a map have no order
    return found.select("doc_id", "what", "page", ordinal.alias("ord"), "candidate", ST.text_of(ST.get("d", "disposition")).alias("disposition"), "error")


#: A file with a selection for every customer, in three shapes and with every error.
SELECTIONS = """
SELECT c_custkey AS doc_id, CASE c_custkey % 2 WHEN 0 THEN 'B.pdf' ELSE 'groß' END AS book, CASE CAST(c_custkey % 11 AS INT)
  WHEN 0 THEN concat('{"books":{"b":{"items":[{"pdf_page":', c_custkey % 9, ',"candidate_id":"pdf-page-001-formula-0', c_custkey % 7, '"},4,{"pdf_page":2,"book":"x","candidate":"t"},{"pdf_page":2,"book":"GROSS.pdf","candidate":"own"}]},"GROSS.PDF":{"candidates":[{"pdf_page":"3","candidate":"t ","candidate_index":5}]},"c":7}}')
  WHEN 1 THEN '{"items":[{"book":"b","pdf_page":1,"candidate_index":2},{"book":"GROẞ","pdf_page":true,"candidate_index":3},{"pdf_page":1,"candidate":"t"}]}'
  WHEN 2 THEN concat('[{"pdf_page":', c_custkey % 5 - 1, ',"candidate_index":1},{"candidate_index":1},{"pdf_page":1,"candidate_index":0},{"pdf_page":1,"candidate_index":true},{"pdf_page":1,"candidate_index":"1"}]')
  WHEN 3 THEN '[{"pdf_page":1,"candidate_id":" "},{"pdf_page":1,"candidate_id":5},{"pdf_page":1},{"pdf_page":1,"candidate":""},{"pdf_page":1,"candidate_id":"formula-2","candidate_index":3},{"pdf_page":1,"candidate_id":"CANDIDATE_007","candidate_index":7},{"pdf_page":1,"candidate_id":"f-2"}]'
  WHEN 4 THEN '{"items":{"a":1}}' WHEN 5 THEN '{"other":[]}' WHEN 6 THEN '3' WHEN 7 THEN '{]' WHEN 8 THEN '[1,"t",null]' WHEN 9 THEN '{"books":{"B":{"items":[{"pdf_page":"1_0","source":"s","candidate_index":4}]}}}' ELSE '{"items":[]}' END AS json
FROM customer
"""


@query(f"""WITH f AS ({SELECTIONS}), v AS (SELECT doc_id, book, CASE WHEN json_valid(json) THEN json::JSON END AS v FROM f),
t AS (SELECT *, coalesce(json_type(json_extract(v, '$.books')) = 'OBJECT', false) AS by_book, CASE WHEN json_type(v) = 'OBJECT' THEN coalesce(json_extract(v, '$.items'), v) ELSE v END AS li FROM v),
w AS (SELECT *, CASE WHEN v IS NULL THEN 'file is not valid JSON' WHEN NOT by_book AND json_type(li) <> 'ARRAY' THEN 'formula selection must contain an items list' END AS wrong FROM t),
bk AS (SELECT doc_id, book, json_extract(v, '$.books') AS b, unnest(json_keys(json_extract(v, '$.books'))) AS bk FROM w WHERE wrong IS NULL AND by_book), bb AS (SELECT doc_id, book, bk, json_extract(b, '$."' || bk || '"') AS b FROM bk),
bi AS (SELECT doc_id, book, bk, coalesce(b -> 'items', b -> 'candidates') AS x FROM bb WHERE json_type(b) = 'OBJECT' UNION ALL SELECT doc_id, book, NULL, li FROM w WHERE wrong IS NULL AND NOT by_book),
bj AS (SELECT *, unnest(range(json_array_length(x)::INTEGER)) AS k FROM bi), e AS (SELECT doc_id, book, bk, k, json_extract(x, '$[' || k || ']') AS e FROM bj),
m AS (SELECT * FROM e WHERE CASE WHEN json_type(e) <> 'OBJECT' THEN bk IS NULL WHEN bk IS NOT NULL AND json_extract(e, '$.book') IS NULL THEN {_KEY.format("bk")} = {_KEY.format("book")} ELSE NOT {_GIVEN.format(_NAMED)} OR coalesce({_KEY.format(f"replace(json_extract_string({_NAMED}, '$'), 'ẞ', 'ss')")} = {_KEY.format("book")}, false) END),
n AS (SELECT doc_id, k, e, json_extract(e, '$.candidate_index') AS i, json_extract(e, '$.candidate_id') AS c, json_type(e) = 'OBJECT' AS o, CASE WHEN json_type(e) = 'OBJECT' THEN {_INT.format("(json_extract(e, '$.pdf_page'))")} END AS page, {_FIELDS("e")} AS t FROM m),
r AS (SELECT *, CASE WHEN json_type(i) IN ('UBIGINT', 'BIGINT') THEN i::INTEGER END AS num, CASE WHEN json_type(c) = 'VARCHAR' THEN try_cast(regexp_extract(json_extract_string(c, '$'), '(?i)(?:formula|candidate)[-_]0*(\\d+)$', 1) AS INTEGER) END AS fin FROM n)
SELECT doc_id, page, k::INTEGER AS ord, CASE WHEN t = '' THEN coalesce(num, fin) END AS candidate_index, CASE WHEN t = '' AND json_type(c) = 'VARCHAR' THEN json_extract_string(c, '$') END AS candidate_id, CASE WHEN t <> '' THEN t END AS candidate,
 CASE WHEN NOT o THEN 'formula selection item must be an object' WHEN page IS NULL THEN 'formula selection item has invalid pdf_page' WHEN page <= 0 THEN 'formula selection item has non-positive pdf_page' WHEN {_GIVEN.format("i")} AND coalesce(num, 0) <= 0 THEN 'formula selection item has invalid candidate_index'
 WHEN {_GIVEN.format("c")} AND NOT {_FILLED.format("c")} THEN 'formula selection item has invalid candidate_id' WHEN t = '' AND NOT {_GIVEN.format("i")} AND NOT {_FILLED.format("c")} THEN 'formula selection item lacks candidate/source_text or candidate id'
 WHEN t = '' AND num <> fin THEN 'candidate_index disagrees with candidate_id' WHEN t = '' AND num IS NULL AND fin IS NULL THEN 'formula selection item cannot resolve a candidate' END AS error FROM r
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, wrong FROM w WHERE wrong IS NOT NULL""")
def selection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ME.load_selection(B.run(spark, sf_dir, SELECTIONS, "customer"))


#: Entries for candidates c: by text, by index (one beyond, one twice), by both, in an order of their own.
ENTRIES = """
SELECT doc_id, page, CAST((candidate_index * 7 + page * 3) % 11 * 10 + candidate_index AS INT) AS ord, CASE (page + candidate_index) % 5 WHEN 0 THEN NULL WHEN 1 THEN candidate_index WHEN 2 THEN candidate_index + 1 WHEN 3 THEN candidate_index ELSE NULL END AS candidate_index,
  CASE (page + candidate_index) % 5 WHEN 0 THEN text WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN CASE WHEN page % 3 = 0 THEN 'other' ELSE text END ELSE text END AS candidate FROM c
UNION ALL SELECT doc_id, page, CAST(200 + candidate_index AS INT), CASE WHEN page % 2 = 0 THEN candidate_index END, CASE WHEN page % 2 = 0 THEN NULL ELSE text END FROM c WHERE candidate_index <= 2
"""


@query(f"""WITH RECURSIVE {O.FORMULAS}, c AS (SELECT doc_id, page, candidate_index, text FROM cand), en AS ({ENTRIES}), es AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS k FROM en),
cs AS (SELECT doc_id, page, list(text ORDER BY candidate_index) AS t FROM c GROUP BY ALL),
sel AS (SELECT doc_id, page, t, 0::BIGINT AS k, []::INTEGER[] AS used, NULL::INTEGER AS ord, NULL::INTEGER AS found, NULL::VARCHAR AS error FROM cs
 UNION ALL SELECT doc_id, page, t, k, CASE WHEN error IS NULL AND NOT list_contains(used, found) THEN list_append(used, found) ELSE used END, CASE WHEN error IS NULL AND list_contains(used, found) THEN NULL ELSE ord END, found, error FROM (
  SELECT s.doc_id, s.page, s.t, e.k, s.used, e.ord, e.candidate_index AS i, e.candidate AS want,
   CASE WHEN e.candidate_index IS NOT NULL THEN e.candidate_index ELSE list_filter(range(1, len(s.t) + 1), lambda n: s.t[n] = e.candidate AND NOT list_contains(s.used, n::INTEGER))[1]::INTEGER END AS found,
   CASE WHEN e.candidate_index > len(s.t) THEN 'candidate_index not found' WHEN e.candidate_index IS NULL AND len(list_filter(range(1, len(s.t) + 1), lambda n: s.t[n] = e.candidate AND NOT list_contains(s.used, n::INTEGER))) = 0 THEN 'candidate not found'
    WHEN e.candidate_index IS NOT NULL AND e.candidate IS NOT NULL AND s.t[e.candidate_index] <> e.candidate THEN 'candidate text doesn''t match' END AS error
  FROM sel s JOIN es e ON e.doc_id = s.doc_id AND e.page = s.page AND e.k = s.k + 1))
SELECT doc_id, page, ord, found AS candidate_index, error FROM sel WHERE ord IS NOT NULL""")
def selection_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all kinds against the candidates of each page; many candidates of a page have the same text."""
    c = L.formula_regions(B.run(spark, sf_dir, B.REGIONS, "lineitem"), B.run(spark, sf_dir, B.SIZES, "lineitem")).select("doc_id", "page", "candidate_index", "text")
    entries = spark.sql(ENTRIES.replace("FROM c", "FROM {c}"), c=c).withColumn("error", F.lit(None).cast("string"))
    return ME.select_candidates(c, entries)


@query(f"""WITH RECURSIVE {O.FORMULAS}, c AS (SELECT doc_id, page, candidate_index, text FROM cand), en AS ({ENTRIES}),
e AS (SELECT en.doc_id, en.page, en.candidate_index FROM en JOIN c USING (doc_id, page, candidate_index) WHERE en.candidate_index IS NOT NULL AND (en.candidate IS NULL OR en.candidate = c.text) AND en.ord < 200)
SELECT doc_id, page, candidate_index, text FROM c WHERE EXISTS (SELECT 1 FROM e WHERE e.doc_id = c.doc_id AND e.page = c.page AND e.candidate_index = c.candidate_index)""")
def selected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that a selection by index leaves, in the order of their pages."""
    c = L.formula_regions(B.run(spark, sf_dir, B.REGIONS, "lineitem"), B.run(spark, sf_dir, B.SIZES, "lineitem")).select("doc_id", "page", "candidate_index", "text")
    entries = spark.sql(ENTRIES.replace("FROM c", "FROM {c}"), c=c).filter("candidate_index IS NOT NULL AND ord < 200").withColumn("error", F.lit(None).cast("string"))
    return ME.selected_regions(c, ME.select_candidates(c, entries))


_BARE = "SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS INT) AS ord, concat('c ', CAST(k AS STRING)) AS candidate FROM (SELECT l_suppkey AS doc_id, CAST(l_partkey % 30 + 1 AS INT) AS page, l_orderkey * 10 + l_linenumber AS k FROM lineitem WHERE l_orderkey % 5 = 0) t"
_KEPT = "SELECT doc_id, page, 1 AS n FROM (SELECT DISTINCT l_suppkey AS doc_id, CAST(l_partkey % 30 + 1 AS INT) AS page FROM lineitem WHERE l_orderkey % 7 = 0) t"


@query(f"""WITH b AS ({_BARE}), k AS ({_KEPT}) SELECT doc_id, page, ord, (ord + 1)::INTEGER AS candidate_index, printf('pdf-page-%03d-formula-%02d', page, ord + 1) AS candidate_id, candidate, printf('assets/pdf_page_%03d_formula_%02d.png', page, ord + 1) AS source_asset, NULL AS context_asset, 'line' AS context_type, (ord + 1)::VARCHAR AS source_candidates
FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = b.doc_id AND k.page = b.page) UNION ALL SELECT doc_id, page, 0, 1, 'own', 'kept', NULL, 'c.png', 'region', '1,2' FROM k""")
def candidate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of pages that have some, and those made from bare candidates of the pages that have none."""
    kept = B.run(spark, sf_dir, _KEPT, "lineitem").select(
        "doc_id", "page", F.lit(0).alias("ord"), F.lit(1).alias("candidate_index"), F.lit("own").alias("candidate_id"), F.lit("kept").alias("candidate"), F.lit(None).cast("string").alias("source_asset"), F.lit("c.png").alias("context_asset"), F.lit("region").alias("context_type"), F.array(F.lit(1), F.lit(2)).alias("source_candidates"),
    )
    out = ME.candidate_records(B.run(spark, sf_dir, _BARE, "lineitem"), kept)
    return out.withColumn("source_candidates", F.array_join(F.transform("source_candidates", lambda x: x.cast("string")), ","))


#: Links in the folders of some books: out of it, in a circle, through another folder, to an absolute path.
LINKS = """
SELECT DISTINCT conv_id AS doc_id, path, target FROM (
  SELECT conv_id, 'assets' AS path, '../shared' AS target FROM conversations WHERE conv_id % 6 = 0 UNION ALL SELECT conv_id, 'assets', 'img' FROM conversations WHERE conv_id % 6 = 1 UNION ALL SELECT conv_id, 'img', './assets/../assets' FROM conversations WHERE conv_id % 6 = 1
  UNION ALL SELECT conv_id, 'assets/p3.png', '../pics/x.png' FROM conversations WHERE conv_id % 6 = 2 UNION ALL SELECT conv_id, 'pics', 'deep/pics' FROM conversations WHERE conv_id % 6 = 2 UNION ALL SELECT conv_id, 'assets/p4.png', '/etc/p4.png' FROM conversations WHERE conv_id % 6 = 2
  UNION ALL SELECT conv_id, 'assets', 'media/now' FROM conversations WHERE conv_id % 6 = 3 UNION ALL SELECT conv_id, 'media/now', '../old' FROM conversations WHERE conv_id % 6 = 3 UNION ALL SELECT conv_id, 'old/p5.png', '../../p5.png' FROM conversations WHERE conv_id % 6 = 3) t
"""


@query(f"""WITH RECURSIVE {C._REFS}, ln AS ({LINKS}), way AS (SELECT doc_id, seq, ref, []::VARCHAR[] AS done, string_split(ref, '/') AS rest, 'inside' AS fate, 0 AS n FROM refs
 UNION ALL SELECT w.doc_id, w.seq, w.ref, CASE WHEN w.rest[1] IN ('', '.') THEN w.done WHEN w.rest[1] = '..' THEN w.done[1:len(w.done) - 1] WHEN l.target IS NOT NULL THEN w.done ELSE list_append(w.done, w.rest[1]) END,
  CASE WHEN l.target IS NOT NULL THEN list_concat(string_split(l.target, '/'), w.rest[2:]) ELSE w.rest[2:] END, CASE WHEN (w.rest[1] = '..' AND len(w.done) = 0) OR l.target LIKE '/%' THEN 'outside' ELSE 'inside' END, w.n + 1
 FROM way w LEFT JOIN ln l ON l.doc_id = w.doc_id AND NOT w.rest[1] IN ('', '.', '..') AND l.path = array_to_string(list_append(w.done, w.rest[1]), '/') WHERE len(w.rest) > 0 AND w.fate = 'inside' AND w.n < 200),
ends AS (SELECT doc_id, seq, any_value(ref) AS ref, arg_max(fate, n) AS fate, arg_max(done, n) AS done, arg_max(rest, n) AS rest FROM way GROUP BY doc_id, seq)
SELECT doc_id, seq, ref, CASE WHEN fate = 'inside' AND len(rest) = 0 THEN array_to_string(done, '/') END AS target, CASE WHEN fate = 'inside' AND len(rest) > 0 THEN 'loop' ELSE fate END AS fate FROM ends""")
def linked_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every image reference of every book leads when the links of its folder are followed."""
    refs = S.image_refs(B.books(spark, sf_dir)).select("doc_id", "seq", "ref")
    return A.through_links(refs, B.run(spark, sf_dir, LINKS, "conversations"))


#: What lies in a book's folder: crops of an earlier run, crops that are still used, and files of others.
FOLDER = """
SELECT DISTINCT doc_id, path FROM (
  SELECT l_suppkey AS doc_id, concat('assets/pdf_page_0', CAST(l_partkey % 40 + 1 AS STRING), '_formula_0', CAST(l_linenumber AS STRING), '.png') AS path FROM lineitem
  UNION ALL SELECT l_suppkey, concat('assets/pdf_page_', CAST(l_partkey % 9 AS STRING), '_visual_', CAST(l_linenumber AS STRING), CASE WHEN l_partkey % 2 = 0 THEN '.png' ELSE '.PNG' END) FROM lineitem
  UNION ALL SELECT l_suppkey, concat('assets/old/pdf_page_1_visual_', CAST(l_linenumber AS STRING), '.png') FROM lineitem UNION ALL SELECT l_suppkey, concat('assets/photo', CAST(l_linenumber AS STRING), '.png') FROM lineitem) t
"""
_USED = "SELECT DISTINCT l_suppkey AS doc_id, concat('assets/pdf_page_0', CAST(l_partkey % 40 + 1 AS STRING), '_formula_0', CAST(l_linenumber AS STRING), '.png') AS path FROM lineitem WHERE l_quantity > 25"


@query(f"WITH f AS ({FOLDER}), u AS ({_USED}) SELECT doc_id, path FROM f WHERE (path LIKE 'assets/pdf\\_page\\_%\\_visual\\_%.png' ESCAPE '\\' OR path LIKE 'assets/pdf\\_page\\_%\\_formula\\_%.png' ESCAPE '\\') AND NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = f.doc_id AND u.path = f.path)")
def stale_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crops of earlier runs that go when books begin anew."""
    return L.stale_crops(B.run(spark, sf_dir, FOLDER, "lineitem"), B.run(spark, sf_dir, _USED, "lineitem"))


#: A trace of status changes for every order.
STEPS = "SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS step, CASE WHEN l_linenumber = 1 AND l_partkey % 5 > 0 THEN 'in_progress' WHEN l_partkey % 7 < 2 THEN 'in_progress' WHEN l_partkey % 7 = 2 THEN 'needs_review' WHEN l_partkey % 7 = 3 THEN 'visual_review' WHEN l_partkey % 7 = 4 THEN 'completed' WHEN l_partkey % 7 = 5 THEN 'completed_with_review_items' END AS status FROM lineitem"


@query(f"""WITH t AS ({STEPS}), l AS (SELECT *, lag(status) OVER w AS before, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY step)),
b AS (SELECT *, CASE WHEN n = 1 THEN status = 'in_progress' WHEN status = 'in_progress' THEN true WHEN status IS NULL OR before IS NULL THEN false WHEN before = 'in_progress' THEN status IN ('needs_review', 'visual_review', 'completed') WHEN before = 'needs_review' THEN status IN ('needs_review', 'visual_review')
 WHEN before = 'visual_review' THEN status IN ('visual_review', 'completed', 'completed_with_review_items') WHEN before = 'completed' THEN status = 'completed' ELSE status IN ('completed_with_review_items', 'visual_review', 'completed') END AS fine FROM l)
SELECT doc_id, arg_min(step, step) AS step, (arg_min(struct_pack(b := before), step)).b AS before, (arg_min(struct_pack(s := status), step)).s AS status FROM b WHERE NOT coalesce(fine, false) GROUP BY doc_id""")
def illegal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first change of status of every order's trace that may not be."""
    return SB.illegal_steps(B.run(spark, sf_dir, STEPS, "lineitem"))


@query(f"""WITH m AS ({C._MADE}) SELECT doc_id, page, ord, CASE WHEN kind < 2 THEN 'latex_confirmed' WHEN kind = 3 THEN 'crop_only' WHEN kind = 4 THEN 'not_formula' ELSE 'removed' END AS disposition, concat('x_', ord) AS candidate, concat('x_', ord) AS source, concat('x_', ord) AS source_text, page AS pdf_page, ord AS candidate_index,
 printf('pdf-page-%03d-formula-%02d', page, ord) AS candidate_id, concat('assets/p', ord, '.png') AS source_asset, concat('assets/c', ord, '.png') AS context_asset, 'line' AS context_type, ord::VARCHAR AS source_candidates, CASE WHEN kind < 2 THEN 'x^2' END AS latex, CASE WHEN kind IN (4, 6) THEN 'a label' END AS reason, CASE WHEN kind = 3 THEN 'smudged' END AS unresolved_reason
FROM m WHERE kind IN (0, 1, 3, 4, 6)""")
def accepted_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions that broke no rule, as states keep them."""
    out = ME.accepted(C._merged(spark, sf_dir)[0])
    return out.withColumn("source_candidates", F.array_join(F.transform("source_candidates", lambda x: x.cast("string")), ","))


@query(r"""WITH n AS (SELECT doc_id::INTEGER AS page, source AS doc_id, doc_id % 3 AS k FROM documents) SELECT doc_id, page, concat('<!-- PDF page ', page, ' -->', chr(10), chr(10), '### 1. Title', CASE WHEN k > 0 THEN concat(chr(10), chr(10), '> [Transcription note: look]') ELSE '' END,
 CASE WHEN k = 1 THEN concat(chr(10), chr(10), '![PDF page ', page, ' formula visual evidence](assets/a_formula_1.png)', chr(10), chr(10), '![PDF page ', page, ' necessary visual evidence](assets/b.png)') ELSE '' END, chr(10), chr(10)) AS markdown FROM n""")
def page_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of Markdown for every document with its notes and visual files."""
    d = B.table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page"), (F.col("doc_id") % 3).alias("k"))
    part = F.array(F.struct(F.lit(1).cast("long").alias("part"), F.lit("heading").alias("kind"), F.lit("1. Title").alias("body")))
    none = F.array().cast("array<string>")
    d = d.withColumns({"parts": part, "notes": F.when(F.col("k") > 0, F.array(F.lit("look"))).otherwise(none), "visuals": F.when(F.col("k") == 1, F.array(F.lit("assets/a_formula_1.png"), F.lit("assets/b.png"))).otherwise(none)})
    return L.parts_markdown(d, F.col("notes"), F.col("visuals"))


#: A decision for every line item, with each of the faults that a rule asks about.
_FAULTY = """
SELECT l_orderkey AS doc_id, CAST(l_suppkey % 4 + 1 AS INT) AS page, CAST(row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 4 ORDER BY l_linenumber, l_partkey) AS INT) AS n, CAST(l_partkey % 23 AS INT) AS k FROM lineitem
"""
_DECISION = """
SELECT doc_id, page, n, k, concat('{"candidate_index":', n, ',"verification":"', CASE WHEN k = 4 THEN 'ocr' ELSE 'visual' END, '","latex":"', CASE WHEN k = 19 THEN ' ' ELSE 'x' END, '"', CASE k WHEN 3 THEN '' WHEN 2 THEN ',"disposition":"odd"' WHEN 17 THEN ',"disposition":"crop_only"'
  WHEN 18 THEN ',"disposition":"removed","unresolved_reason":" "' WHEN 21 THEN ',"disposition":"conservative_latex"' ELSE ',"disposition":"latex_confirmed"' END,
  CASE k WHEN 1 THEN ',"candidate":"other"' WHEN 5 THEN ',"source_asset":" "' WHEN 6 THEN ',"source_asset":"/a.png"' WHEN 7 THEN ',"source_asset":"x/../../a.png"' WHEN 8 THEN ',"source_asset":"assets/none.png"' WHEN 9 THEN ',"source_pdf_page":-1' WHEN 10 THEN ',"source_pdf_page":99'
  WHEN 11 THEN ',"source_pdf_page":99,"source_asset":"assets/none.png"' WHEN 12 THEN ',"context_asset":"gone.png"' WHEN 13 THEN ',"context_type":"page"' WHEN 14 THEN ',"source_candidates":[]' WHEN 15 THEN ',"source_candidates":[1,0]' WHEN 16 THEN ',"candidate_id":""' WHEN 22 THEN ',"source_asset":5' ELSE '' END, '}') AS d FROM f
"""


@query(f"""WITH f AS ({_FAULTY}), e AS (SELECT doc_id, page, n, CASE k WHEN 1 THEN ['decision candidate does not match the selected PDF candidate'] WHEN 2 THEN ['unknown disposition: ''odd'''] WHEN 3 THEN ['unknown disposition: None'] WHEN 4 THEN ['verification must be visual']
 WHEN 5 THEN ['source_asset must be a non-empty relative path'] WHEN 6 THEN ['source_asset must stay relative to the Markdown directory'] WHEN 7 THEN ['source_asset escapes the Markdown directory'] WHEN 8 THEN ['source_asset does not exist: assets/none.png'] WHEN 9 THEN ['source_pdf_page must be a positive integer']
 WHEN 10 THEN [concat('source_pdf_page must match candidate page ', page)] WHEN 11 THEN ['source_asset does not exist: assets/none.png', concat('source_pdf_page must match candidate page ', page), 'source_asset or matching source_pdf_page is required'] WHEN 12 THEN ['context_asset does not exist: gone.png']
 WHEN 13 THEN ['context_type must be line or region'] WHEN 14 THEN ['source_candidates must be a non-empty list'] WHEN 15 THEN ['source_candidates must contain positive integers'] WHEN 16 THEN ['candidate_id must be a non-empty string'] WHEN 17 THEN ['crop_only requires unresolved_reason'] WHEN 18 THEN ['removed requires a concrete reason']
 WHEN 19 THEN ['latex_confirmed requires non-empty latex'] WHEN 20 THEN ['context_asset is required'] WHEN 21 THEN ['legacy conservative_latex is not an executable decision'] WHEN 22 THEN ['source_asset must be a non-empty relative path'] ELSE [] END AS errors FROM f)
SELECT doc_id, page, n AS ord, i::INTEGER AS nth, errors[i + 1] AS error FROM (SELECT *, unnest(range(len(errors))) AS i FROM e)""")
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules each decision breaks, in order."""
    made = spark.sql(_DECISION.replace("FROM f", "FROM {f}").replace("'{\"candidate", "'{{\"candidate").replace("'}')", "'}}')"), f=B.run(spark, sf_dir, _FAULTY, "lineitem"))
    n = F.col("n")
    records = made.select(
        "doc_id", "page", n.alias("ord"), n.alias("candidate_index"), F.format_string("pdf-page-%03d-formula-%02d", "page", n).alias("candidate_id"), F.format_string("x_%d", n).alias("candidate"), F.format_string("assets/p%d.png", n).alias("source_asset"),
        F.when(F.col("k") != 20, F.format_string("assets/c%d.png", n)).alias("context_asset"), F.lit("line").alias("context_type"), F.array(n).alias("source_candidates"),
    )
    supplied = made.select("doc_id", "page", n.alias("ord"), F.parse_json("d").alias("d"), F.when(F.col("k") == 1, "other").otherwise("").alias("candidate"))
    assets = records.select("doc_id", F.explode(F.array_compact(F.array("source_asset", "context_asset"))).alias("path"))
    checked = ME.executable_errors(ME.merged(records, supplied), assets)
    return checked.select("doc_id", "page", "ord", F.posexplode("errors").alias("nth", "error"))


#: Every line item is a page with some of all that calls for a look.
_SEEN = """
SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS page, CAST(l_partkey % 3 AS INT) AS n_candidates, l_suppkey % 2 = 0 AS has_math_cue, CAST(l_partkey % 4 AS INT) AS n_images, l_partkey % 5 = 0 AS has_visual_cue,
  l_partkey % 7 = 0 AS has_anomaly, CAST(l_suppkey % 3 AS INT) AS n_assets, CAST(l_partkey % 11 AS INT) AS k FROM lineitem
"""
_FAILED = {1: ("formula-crop-render-failed",), 2: ("visual-crop-render-failed",), 3: ("formula-context-crop-render-failed",), 4: ("visual-crop-render-failed", "formula-crop-render-failed", "visual-crop-render-failed")}


@query(f"""WITH p AS ({_SEEN}), r AS (SELECT doc_id, page, list_sort(list_distinct(list_filter(list_concat([CASE WHEN n_candidates > 0 THEN 'formula-or-mathematical-expression' WHEN has_math_cue THEN 'possible-mathematical-expression' END, CASE WHEN has_visual_cue THEN 'meaningful-visual-cue' END,
 CASE WHEN n_images > 0 THEN 'embedded-visual-retention' END, CASE WHEN has_anomaly THEN 'text-layer-anomaly' END, CASE WHEN (has_visual_cue OR has_math_cue) AND n_assets = 0 THEN 'visual-evidence-not-cropped' END],
 CASE k {" ".join(f"WHEN {k} THEN [{', '.join(repr(x) for x in v)}]" for k, v in _FAILED.items())} ELSE [] END), lambda x: x IS NOT NULL))) AS reasons FROM p)
SELECT doc_id, page, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0""")
def all_review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why pages need a look, with every reason that there is."""
    seen = B.run(spark, sf_dir, _SEEN, "lineitem")
    failed = F.array().cast("array<string>")
    for k, names in _FAILED.items():
        failed = F.when(F.col("k") == k, F.array(*map(F.lit, names))).otherwise(failed)
    return L.review_reasons(seen.withColumn("failed", failed)).select("doc_id", "page", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH g AS ({B.REGIONS}), s AS (SELECT doc_id, page, ord, greatest(x0 - 6, 0.0) AS x0, greatest(y0 - 6, 0.0) AS y0, least(x1 + 6, 480.0) AS x1, least(y1 + 6, 640.0) AS y1 FROM g) SELECT * FROM s WHERE x1 > x0 AND y1 > y0""")
def crop_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crop of each region would show of its page."""
    regions = B.run(spark, sf_dir, B.REGIONS, "lineitem").select("doc_id", "page", "ord", "x0", "y0", "x1", "y1")
    return L.crop_clip(regions, B.run(spark, sf_dir, B.SIZES, "lineitem"))


#: Arguments of a renderer as somebody typed them.
_TYPED = """
SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey % 9 AS INT) AS page, CAST(l_partkey % 700 AS INT) AS dpi, concat(CAST(CAST(l_quantity AS INT) AS STRING), ', ', CAST(l_linenumber AS STRING), CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ',x' ELSE concat(', ', CAST(l_suppkey % 60 AS STRING)) END, ' ,', CAST(l_suppkey % 9 AS STRING), CASE WHEN l_partkey % 11 = 0 THEN ',1' ELSE '' END) AS box FROM lineitem
"""


@query(f"""WITH t AS ({_TYPED}), p AS (SELECT *, list_transform(string_split(box, ','), lambda x: try_cast(trim(x) AS DOUBLE)) AS n FROM t)
SELECT id, page BETWEEN 1 AND 6 AND dpi BETWEEN 36 AND 600 AS renders, CASE WHEN len(n) = 4 AND n[3] > n[1] AND n[4] > n[2] THEN concat_ws(';', n[1], n[2], n[3], n[4]) END AS box FROM p""")
def render_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests for pages, resolutions and boxes can be carried out."""
    t = B.run(spark, sf_dir, _TYPED, "lineitem").withColumn("b", L.parse_box(F.col("box")))
    shown = F.when(F.col("b").isNotNull(), F.concat_ws(";", *[F.col(f"b.{c}").cast("string") for c in ("x0", "y0", "x1", "y1")]))
    return t.select("id", L.render_arguments(F.col("page"), F.col("dpi"), F.lit(6)).alias("renders"), shown.alias("box"))
