"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight for its share of the whole and a schedule: knots (t, rate) over training time 0 to 1 that say
when its words are wanted. The integral of a schedule is the source's cumulative demand; a word at cumulative place x
of the source is trained when the demand reaches x, which is the inverse of that integral. Documents stand in an order
of their own within a source (by a hash of doc_id), pass after pass until the target is met, and the mix is sorted by
the positions so found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import WORD, cumulate, cut, hash_digits, join_dealt

#: Knots (time, rate) by weight: light sources early, heavy ones late.
SCHEDULES: dict[int, tuple[tuple[float, float], ...]] = {1: ((0.0, 1.6), (0.5, 1.0), (1.0, 0.4)), 2: ((0.0, 1.0), (1.0, 1.0)), 3: ((0.0, 0.4), (0.5, 1.0), (1.0, 1.6))}


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """Of (source, source_size), one row a source: adds weight and target.

    Sources by code point, null last, weigh 1, 2, 3 and again; they share the sum of all sizes by weight, none above
    cap times its own size, the excess going to the others by weight. With the sources in order of cap * size / weight
    the capped ones come first, so one pass of running sums finds them. The table has a row for each source and is
    windowed as a whole."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    d = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("_most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("_most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    past = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_most").over(past), F.lit(0))) / F.sum("weight").over(rest)
    d = d.withColumns({"_level": level, "_ratio": F.col("_most") / F.col("weight"), "_at": F.row_number().over(by_ratio)})
    d = d.withColumn("_stop", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_at", "_level"))).over(Window.partitionBy()))
    open_ = F.col("_at") >= F.col("_stop._at")
    return d.select("source", "source_size", "weight", F.when(open_, F.col("weight") * F.col("_stop._level")).otherwise(F.col("_most")).cast("double").alias("target"))


#: Sources whose targets are sent to all tasks.
MOST_SOURCES = 100_000


def inverse_demand(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a piecewise linear rate has met the given share (0 to 1) of its integral."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    want, done, out = share * sum(area), 0.0, None
    for k, ((t0, r0), (t1, r1)) in enumerate(zip(schedule, schedule[1:], strict=False)):
        slope, x = (r1 - r0) / (t1 - t0), want - F.lit(done)
        # r0 s + slope s^2 / 2 = x, in the form that also holds for a slope of 0
        s = F.try_divide(2 * x, F.lit(r0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(r0 * r0) + 2 * slope * x)))
        here = F.lit(t0) + F.coalesce(s, F.lit(0.0))
        done += area[k]
        last = k == len(area) - 1
        out = (here if last else F.when(want <= done, here)) if out is None else out.otherwise(here) if last else out.when(want <= done, here)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def mix(docs: DataFrame, cap: int = 3, whole: bool = False) -> DataFrame:
    """Adds size, source_size, target, taken, copies and position to documents (doc_id, text, source, ...).

    taken counts the words that the mix takes of the document, over all passes: the passes end where the target of the
    source does, in the middle of a document at most once a source. With `whole` that document is taken once more if
    at least half of it lies before the end, else not, so that taken is copies * size. position is the training time
    of the document's first copy, null if nothing is taken. Documents without words take nothing. No rows: no rows."""
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    d = docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "_k": name, "_x": F.xxhash64("text"), "_m": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))})
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, cap).select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_k"), "source_size", "weight", "target")
    d = cumulate(d, ["_k"], F.substring("_m", 1, hash_digits(docs.sparkSession)), [F.col("_m"), F.col("doc_id"), F.col("size"), F.col("_x")], "_c", F.col("size"))
    plan = cut(plan, "targets")
    # a row a source: sent to all tasks up to a bound, beyond it the rows of large sources are dealt out
    d = d.join(F.broadcast(plan), "_k") if plan.count() <= MOST_SOURCES else join_dealt(d, plan, ["_k"], [F.col("_m")])
    goal = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    over = goal - passes * F.col("source_size") - F.col("_c")
    part = F.greatest(F.lit(0), F.least(over, F.col("size"))).cast("long")
    if whole:
        part = F.when((F.col("size") > 0) & (2 * part >= F.col("size")), F.col("size")).otherwise(0)
    d = d.withColumn("taken", (passes * F.col("size") + part).cast("long"))
    d = d.withColumn("copies", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int"))
    d = d.withColumn("position", F.when(F.col("taken") > 0, position(F.col("_c"))))
    return d.drop("_k", "_m", "_x")


def position(place: Column) -> Column:
    """The training time of a document at this place (words before it) of its source; needs size, target, weight."""
    share = F.least(F.lit(1.0), (place + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0)))
    out = None
    for w, knots in SCHEDULES.items():
        here = inverse_demand(share, knots)
        out = F.when(F.col("weight") == w, here) if out is None else out.when(F.col("weight") == w, here)
    return out


def repeated(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes, with the copy's own position, range-sorted by it."""
    copies = mixed.filter("copies > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    placed = copies.withColumn("position", position(F.col("_c") + F.col("_pass") * F.col("source_size")))
    return placed.drop("_pass").orderBy("position", "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each, in training order (untaken ones first).

    Null texts have size 0. Ties in the order of a source fall by doc_id, size and a hash of the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))
    return mixed.orderBy("position", "doc_id")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, 3 * source_size / weight AS ratio, row_number() OVER q AS k,
      (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
      FROM w WINDOW q AS (ORDER BY 3 * source_size / weight, source IS NULL, encode(source))),
f AS (SELECT min(k) AS k0, arg_min(lev, k) AS lev0 FROM r WHERE lev <= ratio),
t AS (SELECT source, source_size, weight, CASE WHEN k >= k0 THEN weight * lev0 ELSE 3.0 * source_size END::DOUBLE AS target FROM r, f),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, floor(t.target)::BIGINT AS goal,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM c),
k AS (SELECT *, (passes * size + greatest(0, least(goal - passes * source_size - before, size)))::BIGINT AS taken,
      least(1.0, (before + size / 2) / greatest(target, 1.0)) AS u FROM p)
SELECT doc_id, size, source_size, target, taken, round(CASE WHEN taken > 0 THEN
  least(1.0, greatest(0.0, CASE weight
    WHEN 1 THEN CASE WHEN u <= 0.65 THEN 2 * u / (1.6 + sqrt(greatest(0.0, 2.56 + 2 * -1.2 * u))) ELSE 0.5 + 2 * (u - 0.65) / (1.0 + sqrt(greatest(0.0, 1.0 + 2 * -1.2 * (u - 0.65)))) END
    WHEN 2 THEN 2 * u / (1.0 + 1.0)
    ELSE CASE WHEN u <= 0.35 THEN 2 * u / (0.4 + sqrt(greatest(0.0, 0.16 + 2 * 1.2 * u))) ELSE 0.5 + 2 * (u - 0.35) / (1.0 + sqrt(greatest(0.0, 1.0 + 2 * 1.2 * (u - 0.35)))) END END)) END, 6) AS position
FROM k
"""
