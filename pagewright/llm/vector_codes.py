"""Vectors as short codes: each part of a vector is the number of the nearest entry of its position's codebook.

The nearest entry is found by a VA-file filter. The coordinates of a codebook's entries are quantised to a few bits: a
cell holds neighbouring coordinates and their smallest and largest value. A batch of parts makes one table for each
coordinate, with the least and the most that an entry of a cell can add to the squared distance. Sums over the tables
are lower and upper bounds of all entries; those whose lower bound is at most the smallest upper bound are refined with
integer distances. So the filter never loses the nearest entry, nor one that ties with it.

Codebooks are trained by rounds of assignment and means. A task adds up its parts by entry and hands on one row for each
entry it used; the driver holds codebooks, whose size doesn't depend on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import cut, join_dealt, matrix, whole_vector

#: Scaled components beyond this are taken as this, so that squared distances of a vector stay within 64 bits.
MOST_COMPONENT = 1 << 27
#: Rows whose bounds are computed at once.
BATCH = 2048


def whole_numbers(column: pa.Array, dim: int, parts: int, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors, cut into parts: (rows, parts, width)."""
    m = np.clip(np.floor(matrix(column, dim) * scale), -MOST_COMPONENT, MOST_COMPONENT).astype(np.int64)
    width = max(1, -(-dim // parts))
    return np.pad(m, ((0, 0), (0, parts * width - dim))).reshape(len(m), parts, width)


class VaFile:
    """The entries (entries, width) of one part position, with their coordinates quantised to `bits` bits."""

    def __init__(self, entries: np.ndarray, bits: int = 3) -> None:
        self.entries = entries
        n, width = entries.shape
        cells = min(1 << bits, n)
        self.cell = np.empty((n, width), np.int64)
        self.low, self.high = np.empty((width, cells), np.int64), np.empty((width, cells), np.int64)
        for j in range(width):
            order = np.argsort(entries[:, j], kind="stable")
            for c, members in enumerate(np.array_split(order, cells)):
                self.cell[members, j] = c
                self.low[j, c], self.high[j, c] = entries[members, j].min(), entries[members, j].max()

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of rows x to all entries."""
        lower, upper = np.zeros((2, len(x), len(self.entries)), np.int64)
        for j in range(x.shape[1]):
            below, above = self.low[j] - x[:, j, None], x[:, j, None] - self.high[j]
            least = np.maximum(np.maximum(below, above), 0) ** 2
            most = np.minimum(below, above) ** 2  # both differences to the far end are at most 0
            lower += least[:, self.cell[:, j]]
            upper += most[:, self.cell[:, j]]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, ties to the lower number, and its squared distance."""
        lower, upper = self.bounds(x)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        exact = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        starts = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(exact, starts)
        hit = np.flatnonzero(exact == best[row])
        first = hit[np.searchsorted(row[hit], np.arange(len(x)))]
        return entry[first], best


def assigned(x: np.ndarray, books: list[VaFile]) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers and squared distances (rows, parts)."""
    codes, errors = np.empty((2, len(x), len(books)), np.int64)
    for a in range(0, len(x), BATCH):
        for p, book in enumerate(books):
            codes[a : a + BATCH, p], errors[a : a + BATCH, p] = book.nearest(x[a : a + BATCH, p])
    return codes, errors


def _sums(books: np.ndarray, dim: int, scale: float, bits: int):
    """Adds up a task's parts by the entry they are nearest to: (part, entry, rows, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        files = [VaFile(b, bits) for b in books]
        rows, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for t in batches:
            x = whole_numbers(t.column("v"), dim, parts, scale)
            codes, _ = assigned(x, files)
            for p in range(parts):
                rows[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], x[:, p])
        part, entry = np.nonzero(rows)
        listed = pa.array(list(sums[part, entry]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(rows[part, entry], pa.int64()), listed], ["part", "entry", "rows", "sums"])

    return run


def _codes(books: np.ndarray, dim: int, scale: float, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(b, bits) for b in books]
        for t in batches:
            codes, errors = assigned(whole_numbers(t.column("v"), dim, len(books), scale), files)
            text = pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([t.column("id"), t.column("label"), text, pa.array(errors.sum(axis=1), pa.int64())], ["id", "label", "code", "error"])

    return run


def train(vectors: DataFrame, dim: int, parts: int, entries: int, rounds: int, scale: float, bits: int) -> np.ndarray:
    """The codebooks (parts, entries, width) of (id, v): the vectors of the smallest ids, moved `rounds` times to the floors of their parts' means.

    Entries that no part is nearest to stay. Fewer vectors than entries: as many entries as vectors."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    books = whole_numbers(first, dim, parts, scale).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = vectors.select("v").mapInArrow(_sums(books, dim, scale, bits), "part int, entry int, rows long, sums array<long>")
        added = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(books.shape[2])]
        books = books.copy()
        for part, entry, rows, *total in sums.groupBy("part", "entry").agg(F.sum("rows"), *added).collect():
            books[part, entry] = [s // rows for s in total]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, bits: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(id, v, label) to id, label, code, error, and the codebooks.

    Vectors that are null or hold null or non-finite components are dropped. Components become floor(scale * x), within
    MOST_COMPONENT. Shorter vectors and lengths that `parts` doesn't divide are filled up with 0. A null id is the last;
    equal ids are told apart by their vectors. No vectors: no rows and no codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for a part: 1 to 256 entries")
    kept = vectors.select("id", "v", "label").filter(whole_vector(F.col("v")))
    dim = kept.agg(F.max(F.size("v"))).first()[0]
    schema = f"id {kept.schema['id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    if dim is None:
        return vectors.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    books = train(kept.select("id", "v"), dim, parts, entries, rounds, scale, bits)
    return kept.mapInArrow(_codes(books, dim, scale, bits), schema), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as 16 codes of 64 entries after 2 rounds, with their errors and those of their label.

    Null labels are one label. What is null, short, repeated or absent: see `encode`. Codes are written once, since
    errors of labels are joined to them; a label of very many rows is dealt out."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    found, books = encode(table)
    key = F.when(F.col("label").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    codes = cut(found.withColumn("_label", key).drop("label"), "codes")
    labels = codes.groupBy("_label").agg(F.sum("error").alias("label_error"))
    out = join_dealt(codes, labels, ["_label"], [F.col("id"), F.col("code")])
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _step(k: int) -> str:
    """CTEs for the assignment to codebook b{k}, and the next codebook."""
    return f"""
a{k} AS MATERIALIZED (SELECT x.vec_id, x.part, arg_min(b.entry, (list_sum(list_transform(list_zip(x.p, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) AS entry
  FROM x JOIN b{k} b USING (part) GROUP BY x.vec_id, x.part),
m{k} AS (SELECT part, entry, place, sum(c)::BIGINT AS s, count(*) AS n FROM (
  SELECT a.part, a.entry, unnest(x.p) AS c, unnest(range(len(x.p))) AS place FROM a{k} a JOIN x USING (vec_id, part)) GROUP BY ALL),
n{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS e FROM m{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.e, b.e) AS e FROM b{k} b LEFT JOIN n{k} n USING (part, entry))"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS p FROM v, range(16) r(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 64),
b0 AS MATERIALIZED (SELECT part, entry, p AS e FROM x JOIN f USING (vec_id)),{_step(0)},{_step(1)},
c AS MATERIALIZED (SELECT x.vec_id, x.part, min((list_sum(list_transform(list_zip(x.p, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.entry)) AS best
  FROM x JOIN b2 b USING (part) GROUP BY x.vec_id, x.part),
d AS (SELECT vec_id, string_agg(printf('%02x', best[2]::BIGINT), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM c GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM d JOIN v USING (vec_id)
"""
