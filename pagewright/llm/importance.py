"""Resampling of documents towards a target distribution by importance weights over hashed word n-grams.

A text's features are its runs of 1 to n words, hashed into buckets. A bucket's gain is the logarithm of how much more
frequent it is among target texts than in the corpus; a document's weight is the sum of its features' gains, and the
documents with the highest weight plus Gumbel noise are drawn.

Long texts are cut into overlapping chunks: a chunk owns the words that start in it, carries the n - 1 words that follow,
and counts the runs that start at words it owns. Chunks end at word boundaries, so every run of the text is counted in
exactly one chunk. Chunks of long texts are dealt out; counts and weights of chunks are summed by document. A word
longer than a chunk stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import cumulate, cut, number_list, range_bounds, range_bucket, range_parts

#: Words and what is between them, in lower-cased texts.
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Bytes of a text beyond which it is cut into chunks, and characters of a chunk.
LONG_BYTES, CHUNK_CHARS = 1 << 18, 1 << 16


def lowered(text: Column) -> Column:
    """A-Z as a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(f"({WORD}+)"), 1)


def chunks_of(text: Column, n: int, chars: int) -> Column:
    """Array of (own, carry): own parts of about `chars` characters that end at word boundaries and make up the text, and
    up to n - 1 words that follow each."""
    own = rf"(?s)(.{{1,{chars}}}{WORD}*)"
    carry = rf"(?=((?:{GAP}*{WORD}+){{0,{n - 1}}}))" if n > 1 else "()"
    low = lowered(text)
    return F.arrays_zip(F.regexp_extract_all(low, F.lit(own + carry), 1).alias("own"), F.regexp_extract_all(low, F.lit(own + carry), 2).alias("carry"))


def buckets_of(words: Column, owned: Column, n: int, buckets: int) -> Column:
    """Bucket of each run of 1 to n words that starts at one of the first `owned` words."""
    def runs(k: int) -> Column:
        starts = F.least(owned, F.size(words) - (k - 1))
        at = F.when(starts > 0, F.sequence(F.lit(1), starts)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))

    found = words if n == 1 else F.concat(*[runs(k) for k in range(1, n + 1)])
    return F.transform(found, lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))


def features(docs: DataFrame, keep: list[str], n: int = 1, buckets: int = 10_000) -> DataFrame:
    """docs(text, *keep) to _row, *keep, n_words, buckets: a row for each text, or for each chunk of a long one.

    Rows of one text share _row, which is negative for long texts: the two kinds are numbered apart. Null: no words. Texts
    are read twice, by length: only those of more than LONG_BYTES are exploded and dealt out, the others stay in place."""
    d = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, "text")
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > LONG_BYTES
    words = words_of(F.coalesce("text", F.lit("")))
    short = d.filter(~long).select("_row", *keep, words.alias("w")).withColumn("n_words", F.size("w"))
    parts = d.filter(long).select((-1 - F.col("_row")).alias("_row"), *keep, F.posexplode(chunks_of(F.col("text"), n, CHUNK_CHARS)).alias("_at", "c"))
    parts = parts.repartition(F.col("_row"), F.col("_at")).select("_row", *keep, F.size(words_of(F.col("c.own"))).alias("n_words"), words_of(F.concat("c.own", "c.carry")).alias("w"))
    both = short.select("_row", *keep, "n_words", "w").unionByName(parts)
    return both.select("_row", *keep, F.col("n_words").cast("long").alias("n_words"), buckets_of(F.col("w"), F.col("n_words"), n, buckets).alias("buckets"))


def bucket_counts(found: DataFrame, buckets: int) -> list[int]:
    """How many features each bucket has; the driver gets a number for each bucket."""
    out = [0] * buckets
    for b, c in found.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        out[b] = c
    return out


def gains(spark: SparkSession, corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln(((t + 1) * (S + buckets)) / ((s + 1) * (T + buckets)))) of each bucket, in doubles."""
    rows = spark.createDataFrame(list(zip(range(len(corpus)), corpus, target, strict=True)), "b int, s long, t long")
    total = lambda counts: F.lit(float(sum(counts) + len(counts)))
    gain = F.floor(1000 * F.ln((F.col("t") + 1).cast("double") * total(corpus) / ((F.col("s") + 1).cast("double") * total(target))))
    return [g for _, g in sorted(rows.select("b", gain).collect())]


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 8 hex digits of sha256("seed:doc_id"); a null id counts as the word null."""
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of docs(doc_id, text): of those of at least `least_words` words the highest
    scores get ranks from 1, `percent` of 100 of their number rounded down; others have none.

    target(text) are texts of the wanted distribution; without any, or without documents, the counts are 0. Null and
    empty texts have no features and weight 0. Ties go to the smaller doc_id, null last; rows of one doc_id and score
    are told apart by weight and number of features, equal ones take any order. Features of documents are written once."""
    spark = docs.sparkSession
    found = cut(features(docs.select("doc_id", "text"), ["doc_id"], n, buckets), "features")
    gain = gains(spark, bucket_counts(found, buckets), bucket_counts(features(target.select("text"), [], n, buckets), buckets))
    of_chunk = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(number_list(gain), b + 1))
    chunks = found.select("_row", "doc_id", "n_words", F.size("buckets").alias("n"), of_chunk.alias("w"))
    rows = chunks.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("_words"), F.sum("n").alias("n_features"), F.sum("w").alias("weight"))
    scored = cut(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).drop("_row"), "scored")
    drawn = ranked(scored.filter(F.col("_words") >= least_words))
    most = drawn.select(F.count("*").alias("c")).first()["c"] * percent // 100
    rank = F.when(F.col("rank") <= most, F.col("rank"))
    rest = scored.filter(F.col("_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.withColumn("rank", rank).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


#: Ranges of doc_id by which rows of one score can be dealt.
ID_RANGES = 256


def ranked(scored: DataFrame) -> DataFrame:
    """Adds `rank`, 1 for the highest score, ties to the smaller doc_id. Rows are dealt by ranges of score and, within a
    score, of doc_id: a score that very many documents share is no hot key."""
    within = range_bucket(F.col("doc_id"), range_bounds(scored, "doc_id", ID_RANGES))
    place = -F.col("score") * ID_RANGES + F.when(F.col("doc_id").isNull(), ID_RANGES - 1).otherwise(within)
    d = scored.withColumn("_place", place)
    bounds = range_bounds(d, "_place", range_parts(scored.sparkSession))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    before = cumulate(d, [], range_bucket(F.col("_place"), bounds), order, "_before")
    return before.withColumn("rank", F.col("_before") + 1).drop("_place", "_before")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents of at least 20 words, drawn towards the texts of `benchmark`; see `resample` for odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


def _counts(name: str, table: str, text: str = "text") -> str:
    return f"""{name}_w AS MATERIALIZED (SELECT {'doc_id, ' if table == 'documents' else ''}regexp_extract_all(
  translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table})"""


#: DuckDB has no CRC-32: it is computed for each different word from the table of bytes.
OP12_SQL = f"""
WITH {_counts('d', 'documents')}, {_counts('b', 'benchmark')},
crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
words AS MATERIALIZED (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM d_w UNION ALL SELECT w FROM b_w)),
bytes AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT) AS y FROM words),
bucket AS MATERIALIZED (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], y), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM bytes, crc),
dw AS MATERIALIZED (SELECT doc_id, bucket FROM (SELECT doc_id, unnest(w) AS word FROM d_w) JOIN bucket USING (word)),
s AS (SELECT bucket, count(*) AS s FROM dw GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM b_w) JOIN bucket USING (word) GROUP BY bucket),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + 10000) / ((s + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
a AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dw JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d_w d LEFT JOIN a USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM e WHERE n_features >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM e LEFT JOIN r USING (doc_id)
"""
