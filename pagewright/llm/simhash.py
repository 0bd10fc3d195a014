"""SimHash fingerprints and a search by permuted block tables, in DataFrame functions alone.

A term's 128 hash bits vote for or against each bit of the fingerprint with the term's weight, which grows with its
length: short words are common ones. Votes are counted two to a 64-bit sum (lanes of 32 bits), so a text is one hash
aggregation of its words; a lane holds the votes of 31 million of the heaviest terms (a text of some 600 MB). Texts are
dealt by ranges of doc_id and never move again.

Fingerprints within a Hamming radius r of each other differ in at most r of r + 2 blocks, so at least two blocks are
equal. There is a table for each pair of blocks, keyed by their bits; a pair of fingerprints is taken from the first
table that holds it.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import cut, number_list, range_bounds, range_bucket, range_parts

#: White space between terms; the bits of a fingerprint; both lanes of a sum; letters that weigh, up to MOST_LETTERS.
GAP, BITS, LANES, FREE_LETTERS, MOST_LETTERS = r"[\x20\x09-\x0D]+", 128, 0x0000000100000001, 3, 20
#: Default Hamming radius of the search.
RADIUS = 6
#: Groups among which the copies of a fingerprint are dealt.
SALTS = 32


def weight(term: Column) -> Column:
    """0 for no term, 1 for short ones, 8 for each letter from the fourth to the twentieth."""
    letters = F.least(F.char_length(term), F.lit(MOST_LETTERS)) - FREE_LETTERS
    return F.when(term == "", 0).when(letters <= 0, 1).otherwise(8 * letters).cast("long")


def fingerprints(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, high, low: the fingerprint of each text, two longs. Rows are told apart by their keys. A text without terms has all bits 0."""
    terms = texts.select(*keys, F.explode(F.split(F.lower(text), GAP)).alias("_t"))
    terms = terms.select(*keys, F.xxhash64("_t").alias("_h"), F.xxhash64("_t", F.lit(1)).alias("_l"), weight(F.col("_t")).alias("_w"))
    votes = [F.sum(F.shiftright(h, k).bitwiseAND(F.lit(LANES)) * F.col("_w")).alias(f"{h}{k}") for h in ("_h", "_l") for k in range(32)]
    counted = terms.groupBy(*keys).agg(F.sum("_w").alias("_w"), *votes)

    def word(h: str) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            lower, upper = F.col(f"{h}{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{h}{k}", 32)
            for bit, count in ((k, lower), (k + 32, upper)):
                out = out.bitwiseOR(F.when(2 * count > F.col("_w"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0)))
        return out

    return counted.select(*keys, word("_h").alias("high"), word("_l").alias("low"))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def spelled(high: Column, low: Column) -> Column:
    """32 lower-case hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def _masks(radius: int) -> list[tuple[int, int]]:
    """Bit masks (high, low) of the blocks, signed."""
    blocks = radius + 2
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for b in range(blocks):
        m = sum(1 << k for k in range(BITS * b // blocks, BITS * (b + 1) // blocks))
        out.append((sign(m >> 64), sign(m & (1 << 64) - 1)))
    return out


def near(queries: DataFrame, table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """q_high, q_low, high, low, distance: for distinct query fingerprints all fingerprints of a distinct table within the radius, a pair once."""
    if not 0 <= radius <= BITS // 4:
        raise ValueError("the radius must lie between 0 and a quarter of the bits")
    masks = _masks(radius)
    pairs = list(combinations(range(len(masks)), 2))

    def keyed(df: DataFrame, high: str, low: str) -> DataFrame:
        keys = []
        for i, j in pairs:
            mh, ml = masks[i][0] | masks[j][0], masks[i][1] | masks[j][1]
            blocks = 1 << i | 1 << j
            keys.append(F.struct(F.lit(blocks).alias("blocks"), F.xxhash64(F.lit(blocks), F.col(high).bitwiseAND(F.lit(mh)), F.col(low).bitwiseAND(F.lit(ml))).alias("key")))
        return df.select(high, low, F.inline(F.array(*keys)))

    # Both sides grow with the documents, so neither is ever broadcast. What a table is keyed by moves as one hash: the
    # test below takes a pair only from the first table whose blocks are equal, which a colliding hash doesn't make them.
    q = keyed(queries.select(F.col("high").alias("q_high"), F.col("low").alias("q_low")).distinct(), "q_high", "q_low")
    t = keyed(table.select("high", "low").distinct(), "high", "low").select("high", "low", "key")
    xh, xl = F.col("high").bitwiseXOR(F.col("q_high")), F.col("low").bitwiseXOR(F.col("q_low"))
    equal = F.lit(0).cast("long")
    for b, (mh, ml) in enumerate(masks):
        equal = equal + F.when((xh.bitwiseAND(F.lit(mh)) == 0) & (xl.bitwiseAND(F.lit(ml)) == 0), F.lit(1 << b)).otherwise(F.lit(0))
    rest = equal.bitwiseAND(equal - 1)
    first_two = equal.bitwiseAND(-equal).bitwiseOR(rest.bitwiseAND(-rest))
    apart = F.bit_count(xh) + F.bit_count(xl)
    found = q.alias("q").join(t.alias("t").hint("merge"), (F.col("q.key") == F.col("t.key")) & (apart <= radius) & (F.col("q.blocks") == first_two))
    return found.select("q_high", "q_low", "high", "low", apart.cast("int").alias("distance"))


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, place, ghost, doc_id, text, next: rows in ascending doc_id with the text of the row after, that of the first after the last.

    Ranges of doc_id are dealt to tasks; a range's first rows also go, as ghosts, to the end of the range before it."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(docs, "doc_id", range_parts(docs.sparkSession))
    placed = docs.select("doc_id", range_bucket(F.col("doc_id"), bounds).alias("bucket"))
    firsts = sorted((r["bucket"], r["first"]) for r in placed.groupBy("bucket").agg(F.expr("min_by(doc_id, struct(doc_id IS NOT NULL, doc_id))").alias("first")).collect())  # a row for each range
    if not firsts:  # no documents
        firsts = [(0, None)]
    first_of = dict(firsts)
    ahead = {b: firsts[k - 1][0] for k, (b, _) in enumerate(firsts)}
    every = range(max(first_of) + 1)
    bucket = range_bucket(F.col("doc_id"), bounds)
    # a null first id can only be that of bucket 0; other gaps stand for buckets without rows
    of_bucket = lambda values: F.element_at(number_list(values), bucket + 1)
    is_first = F.col("doc_id") == of_bucket([first_of.get(b) or 0 for b in every])
    is_first = F.when(bucket == 0, F.col("doc_id").eqNullSafe(F.lit(first_of.get(0)).cast("long"))).otherwise(is_first)
    ghost_of = F.when(is_first, of_bucket([ahead.get(b, 0) for b in every]).cast("int"))
    copies = F.when(ghost_of.isNull(), F.array(F.struct(F.col("bucket"), F.lit(0).alias("ghost")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(0).alias("ghost")), F.struct(ghost_of.alias("bucket"), F.lit(1).alias("ghost"))))
    rows = docs.withColumn("bucket", bucket).select("doc_id", "text", F.inline(copies))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.select("bucket", F.row_number().over(order).alias("place"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, high, low, edited_high, edited_low, next_high, next_low for each of documents."""
    d = with_next(docs).withColumn("n", F.char_length("text").cast("long"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n").cast("int") - half), F.left(F.coalesce("next", F.lit("")), half))
    both = d.withColumn("edited", edited).select(
        "bucket",
        "place",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("kind"), "ghost", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("string").alias("edited_sha256"), F.col("text").alias("text")),
                F.struct(F.lit(1).alias("kind"), "ghost", F.col("doc_id"), F.col("n").alias("n_chars"), F.when(F.col("ghost") == 0, F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha256"), F.when(F.col("ghost") == 0, F.col("edited")).otherwise(F.lit("")).alias("text")),
            )
        ),
    )
    marked = fingerprints(both, "text", ["bucket", "place", "kind", "ghost", "doc_id", "n_chars", "edited_sha256"])
    own = F.col("kind") == 0
    joined = marked.groupBy("bucket", "place", "ghost").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.max("edited_sha256").alias("edited_sha256"),
        *[F.max(F.when(own, F.col(c))).alias(c) for c in ("high", "low")], *[F.max(F.when(~own, F.col(c))).alias(f"edited_{c}") for c in ("high", "low")],
    )
    order = Window.partitionBy("bucket").orderBy("place")
    return joined.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("high", "low")}).filter("ghost = 0").drop("bucket", "place", "ghost")


def op4_simhash(spark: SparkSession, sf_dir: str, every: int = 20, radius: int = RADIUS) -> DataFrame:
    """All documents with fingerprints, and for those whose doc_id is divisible by `every` n_near: how many other
    documents have a fingerprint within the radius (null for the rest).

    Null texts are empty. Null doc_ids come first; equal doc_ids follow each other in the order of a hash of their texts.
    A single document is its own next one. No documents: no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = cut(document_fingerprints(docs), "fingerprints")
    table = marked.groupBy("high", "low").agg(F.count("*").alias("copies"))
    asked = marked.filter(F.col("doc_id") % every == 0)
    hits = near(asked, table, radius).join(table.hint("merge"), ["high", "low"]).groupBy("q_high", "q_low").agg((F.sum("copies") - 1).alias("n_near"))
    # all copies of a text ask for the same row, so it is given out SALTS times and they are dealt among these
    hits = hits.select(F.col("q_high").alias("high"), F.col("q_low").alias("low"), "n_near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id", "edited_sha256"), F.lit(SALTS)).cast("int")
    answered = asked.withColumn("salt", salt).join(hits.hint("merge"), ["high", "low", "salt"]).drop("salt")
    found = answered.unionByName(marked.filter(~F.coalesce(F.col("doc_id") % every == 0, F.lit(False))).withColumn("n_near", F.lit(None).cast("long")))
    own = (F.col("high"), F.col("low"))
    likeness = lambda x: 1 - distance(own, (F.col(f"{x}_high"), F.col(f"{x}_low"))) / BITS
    return found.select(
        "doc_id", "n_chars", "edited_sha256", spelled(*own).alias("fingerprint"), spelled(F.col("edited_high"), F.col("edited_low")).alias("edited_fingerprint"),
        likeness("edited").alias("near_edited"), likeness("next").alias("near_next"), "n_near",
    )
