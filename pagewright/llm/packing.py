"""Best-fit packing by minimum bin slack, on the histogram of lengths.

A bin's content is found by a bitset subset-sum over the lengths still available: bit s of the set is 1 if some
combination of them sums to s. The largest length left is taken first, the fullest feasible combination goes with it,
and the same combination is applied as often as the counts allow. Each application uses up a length, so the driver
does at most about as many steps as there are lengths (at most the capacity), whatever the number of documents; what it
holds is the histogram. The plan that it makes gives each (length, rank) a place; documents get ranks among those of
their length, and so their sequences, by a join with the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import cumulate, cut, join_dealt
from pagewright.llm.tokens import default_vocabulary, encoder, with_end

#: A plan row: pieces of `length` with ranks from `first` on, `count` of them, go to the sequences from `sequence` on, one each, at `offset`.
PLAN = "length long, first long, count long, sequence long, offset long"

#: Rows of a plan (32 bytes each) up to which it is broadcast.
PLAN_ROWS = 200_000


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of available lengths that holds the largest of them; of equally full ones that found from the largest lengths."""
    lengths = sorted(counts, reverse=True)
    largest = lengths[0]
    room = capacity - largest
    mask = (1 << (room + 1)) - 1
    have = 1
    steps: list[tuple[int, int]] = []  # a length and the set before its use
    for n in lengths:
        for _ in range(min(counts[n] - (n == largest), room // n)):
            more = (have | have << n) & mask
            if more == have:
                break
            steps.append((n, have))
            have = more
        if have >> room & 1:
            break
    left = have.bit_length() - 1
    used = {largest: 1}
    for n, before in reversed(steps):
        if not before >> left & 1:
            used[n] = used.get(n, 0) + 1
            left -= n
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """PLAN rows for a histogram of lengths, each from 1 to capacity."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    if counts and (max(counts) > capacity or min(counts) < 1):
        raise ValueError("lengths must lie between 1 and the capacity")
    given = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while counts:
        used = fullest(counts, capacity)
        times = min(counts[n] // k for n, k in used.items())
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            for _ in range(k):
                rows.append((n, given[n], times, sequence, offset))
                given[n] += times
                offset += n
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int, key: list[str]) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` from 1 to capacity. `pieces` is read twice; `key` orders equal lengths."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each length: capacity rows at most
    rows = plan_bins(histogram, capacity)
    plan = spark.createDataFrame(rows, PLAN)
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = cumulate(pieces, ["length"], F.pmod(F.xxhash64(*key), F.lit(buckets)), [F.xxhash64(*key), *[F.col(k) for k in key]], "_rank")
    runs = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "count", "sequence", "offset"))).alias("_runs"))  # a row a length, a struct a row of the plan
    at = F.element_at(F.filter("_runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["first"] + r["count"])), 1)
    if len(rows) <= PLAN_ROWS:
        placed = ranked.join(F.broadcast(runs), "length")
    else:  # of a capacity so large that the plan is no small table
        placed = join_dealt(ranked, runs, ["length"], [F.col(k) for k in key])
    placed = placed.withColumn("_at", at)
    return placed.withColumns({"sequence_id": F.col("_at.sequence") + F.col("_rank") - F.col("_at.first"), "offset": F.col("_at.offset")}).drop("_rank", "_runs", "_at")


def cut_documents(docs: DataFrame, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, text) to pieces of at most capacity ids; an end id closes each document, whose first piece takes the odd length."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for table in tables:
            for first, ids, bounds in tokens.encode(table.column("text")):
                ids, bounds = with_end(ids, bounds, end_id)
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (sizes - 1) % capacity + 1
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                at = 4 * (bounds[row] + start)
                crcs = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), (4 * length).tolist(), strict=True)]
                columns = [table.column("doc_id").take(pa.array(first + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        tokens.rest()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def op2_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """All documents packed into sequences of at most `capacity` ids, one row a piece.

    A null or empty text is the end id alone. Repeated rows and doc_ids are packed as often as they occur. No
    documents: no rows. Pieces are written once to the shared folder, so nothing is encoded twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    pieces = cut(cut_documents(docs, capacity, vocabulary or default_vocabulary(), end_id), "pieces")
    packed = pack(pieces, capacity, ["doc_id", "piece", "ids_crc32"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
