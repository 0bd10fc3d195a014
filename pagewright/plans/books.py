"""A corpus of page-traceable books made from the tables at hand, by SQL that Spark and DuckDB both run.

Every conversation is a book, every turn a page: a marker (sometimes missing, repeated or without printed number), a
heading, an image, display and inline mathematics, a note, the turn's text. Which pages get which fault follows from
keys and lengths, so both engines make the same books. Layout tables come from lineitem in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES = """
SELECT conv_id AS doc_id, turn AS ord, concat(
  CASE WHEN conv_id % 7 = 3 AND turn = 2 THEN '' ELSE concat('<!-- PDF page ', CAST(CASE WHEN conv_id % 7 = 4 AND turn = 3 THEN turn ELSE turn + 1 END AS STRING),
    CASE WHEN conv_id % 7 = 5 THEN '' WHEN (conv_id + turn) % 6 = 0 THEN ' | printed page unknown'
      ELSE concat(' | printed page ', CAST(turn + 10 + CASE WHEN conv_id % 7 = 2 AND turn > 2 THEN 1 ELSE 0 END AS STRING)) END, ' -->', chr(10)) END, chr(10),
  CASE WHEN turn = 0 THEN '# ' WHEN conv_id % 5 = 1 AND turn = 1 THEN '#### ' WHEN role = 'user' THEN '## ' ELSE '### ' END, role, ' ', CAST(turn AS STRING), chr(10), chr(10),
  '![', CASE WHEN length(text) % 5 = 0 THEN '' ELSE concat('p', CAST(length(text) % 9 AS STRING)) END, '](', CASE WHEN length(text) % 23 = 0 THEN '../' WHEN length(text) % 19 = 0 THEN 'https://example.org/' ELSE '' END,
  'assets/p', CAST(length(text) % 9 AS STRING), '.png)', chr(10), chr(10),
  '$$', CASE length(text) % 6 WHEN 0 THEN concat('x=', chr(92), 'frac{a}{', CAST(turn AS STRING), '}') WHEN 1 THEN 'F_{n' WHEN 2 THEN 'v102 v02+2a1x10 3.42+2 k 7 m 8' WHEN 3 THEN concat('a= =b', chr(10), '12', chr(10), '34')
    WHEN 4 THEN concat(chr(92), '{y', chr(92), '}}=', CAST(turn AS STRING)) ELSE concat('t={', CAST(length(text) AS STRING), '}') END, '$$', chr(10), chr(10),
  'Let $v_', CAST(turn AS STRING), '=', CAST(length(text) AS STRING), '$ hold.', chr(10),
  CASE WHEN length(text) % 4 = 0 THEN concat('[Transcription note: look at ', role, ']', chr(10)) ELSE '' END, chr(10), replace(text, '$', ''), chr(10)) AS page
FROM conversations
"""
SPARK_BOOKS = f"SELECT doc_id, listagg(page, '') WITHIN GROUP (ORDER BY ord, page) AS text FROM ({PAGES}) GROUP BY doc_id"
DUCK_BOOKS = f"SELECT doc_id, string_agg(page, '' ORDER BY ord, page) AS text FROM ({PAGES}) GROUP BY doc_id"
ASSETS = "SELECT DISTINCT conv_id AS doc_id, concat('assets/p', CAST((length(text) + turn % 2) % 9 AS STRING), '.png') AS path FROM conversations"
#: A document is a page of its source's book; doc_id numbers pages.
LAYOUT_PAGES = "SELECT source AS doc_id, CAST(doc_id AS INT) AS page, text FROM documents"
#: A line item is a region on the page of its supplier's book that its part key names.
REGIONS = """
SELECT l_suppkey AS doc_id, CAST(l_partkey % 40 + 1 AS INT) AS page, l_orderkey * 10 + l_linenumber AS ord, CAST(l_partkey % 97 AS INT) AS xref,
  CAST(l_quantity * 6 AS DOUBLE) AS x0, CAST(l_partkey % 61 * 8 AS DOUBLE) AS y0, CAST(l_quantity * 6 + l_orderkey % 17 * 9 AS DOUBLE) AS x1, CAST(l_partkey % 61 * 8 + 12 + l_orderkey % 13 * 6 AS DOUBLE) AS y1,
  CAST(l_orderkey % 700 AS INT) AS width, CAST(l_orderkey % 500 AS INT) AS height,
  CASE WHEN l_orderkey % 3 = 0 THEN concat('v = ', CAST(l_linenumber AS STRING), ' x') ELSE 'plain words' END AS text
FROM lineitem
"""
SIZES = f"SELECT DISTINCT doc_id, page, CAST(480 AS DOUBLE) AS page_width, CAST(640 AS DOUBLE) AS page_height FROM ({REGIONS})"

#: A short text for each turn, with Chinese words in and beside mathematics; some of them are UTF-8 that was read by another codec.
CHINESE = """
SELECT conv_id * 1000 + turn AS doc_id, concat('# ', role, chr(10), chr(10), CASE length(text) % 8
  WHEN 0 THEN concat('$$', chr(92), 'Delta v 中常用的方法。 a=', chr(92), 'Delta t$$') WHEN 1 THEN concat('$$', chr(92), 'text{合力}=F$$ and $$', chr(92), 'mathrm{平均}+x$$')
  WHEN 2 THEN concat('plain $中文', CAST(turn AS STRING), '$ text') WHEN 3 THEN concat('$$', chr(92), 'text{骞冲潎}=', CAST(turn AS STRING), '$$') WHEN 4 THEN concat('$$', chr(92), 'text{鍘媫}$$ $$', chr(92), 'text{鐢瞹}$$')
  WHEN 5 THEN concat(chr(92), '(中', chr(92), ') and ', chr(92), '[x', chr(92), ']') WHEN 6 THEN '中文 $$F=ma$$ 力' ELSE concat('$$a 骞冲潎 b$$ and $x=', CAST(turn AS STRING), '$ so') END) AS text
FROM conversations
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out where it has fewer splits than there are cores, as a table of one small file has; larger tables stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def run(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The SQL over Parquet tables of a folder; `tables` are those it names."""
    return spark.sql(_named(sql, tables), **{t: table(spark, sf_dir, t) for t in tables})


def _named(sql: str, tables: tuple[str, ...]) -> str:
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return sql


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, SPARK_BOOKS, "conversations")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, ASSETS, "conversations")


def chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, CHINESE, "conversations")
