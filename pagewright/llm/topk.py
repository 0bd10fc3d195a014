"""Exact top-k inner products by tiles.

Queries and candidates are packed into blocks, each a row holding its ids and its matrix as bytes. Blocks of candidates
are dealt to as many groups as there are partitions, and a copy of each block of queries (a stated query set against all
rows, in blocks) goes to every group; the blocks of a group meet by an equi-join on its number. A tile is one matrix
product of doubles, exact as long as sums stay below 2^53, else of 64-bit integers, else of Python's. Of a tile each
query keeps its k best; lists are merged in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import matrix

#: Rows of a block of candidates, rows of a block of queries, lists merged at once.
SHARD_ROWS, QUERY_ROWS, FAN_IN = 8192, 512, 32


def quantised(df: DataFrame, id_column: str, vector: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component, as doubles, of the vectors that are whole and finite."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))
    kept = df.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).filter(F.col("v").isNotNull() & F.forall("v", finite))
    return kept.select("id", F.transform("v", lambda e: _floor(e.cast("double") * scale)).alias("v"))


def _floor(x: Column) -> Column:
    """Doubles of 2^53 and more are whole."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _blocks(rows: int):
    """Packs the rows of a task into blocks of at most so many."""

    def pack(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, dim = np.concatenate([i for i, _ in held]), max(m.shape[1] for _, m in held)
        whole = np.concatenate([np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for _, m in held])
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([whole.tobytes()], pa.binary())], ["rows", "dim", "ids", "matrix"])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for t in tables:
            ids, v = t.column("id").to_numpy(), t.column("v")
            m = matrix(v, pc.max(pc.list_value_length(v)).as_py() or 0)
            at = 0
            while at < len(ids):
                to = min(len(ids), at + rows - count)
                held.append((ids[at:to], m[at:to]))
                count, at = count + to - at, to
                if count == rows:
                    yield pack(held)
                    held, count = [], 0
        if count:
            yield pack(held)

    return run


BLOCK = "rows int, dim int, ids binary, matrix binary"


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of scores the columns of its k best, ties to the smaller id."""
    if scores.shape[1] > 4 * k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        picked = [np.flatnonzero(s >= e) for s, e in zip(scores, edge, strict=True)]  # all ties stay
    else:
        picked = [np.arange(scores.shape[1])] * len(scores)
    return [p[np.lexsort((ids[p], -s[p]))][:k] for s, p in zip(scores, picked, strict=True)]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole doubles, as 64-bit integers; those beyond their range are the nearest ones."""
    top = (float(np.abs(q).max(initial=0)) or 1.0) * (float(np.abs(c).max(initial=0)) or 1.0) * max(1, q.shape[1])
    if top < 1 << 53:
        return (q @ c.T).astype(np.int64)
    if top < 1 << 62 and max(np.abs(q).max(), np.abs(c).max()) < 1 << 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(c).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _tiles(k: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            for row in t.to_pylist():
                q = np.frombuffer(row["q_matrix"]).reshape(row["q_rows"], row["q_dim"])
                c = np.frombuffer(row["matrix"]).reshape(row["rows"], row["dim"])
                dim = min(row["q_dim"], row["dim"])  # what a vector lacks counts as 0
                scores = products(q[:, :dim], c[:, :dim])
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                # a query's own rows go to the end and are cut off
                out_q, out_c, out_s = [], [], []
                order = np.argsort(ids, kind="stable")
                lo, hi = np.searchsorted(ids[order], q_ids), np.searchsorted(ids[order], q_ids, "right")
                own = int((hi - lo).max(initial=0))
                for x, (qid, cols) in enumerate(zip(q_ids.tolist(), best(scores, ids, k + own), strict=True)):
                    cols = cols[ids[cols] != qid][:k]
                    out_q += [qid] * len(cols)
                    out_c += ids[cols].tolist()
                    out_s += scores[x, cols].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(out_q), pa.int32()), *[pa.array(v, pa.int64()) for v in (out_q, out_c, out_s)]], ["part", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for (id, v): the k best inner products of each query with all other rows.

    Rows with a query's own id are no candidates of it; ids that are null take no part as queries or candidates. Where
    a query id repeats, each of its rows asks, and the best of all their answers count. Fewer candidates than k: all of
    them. Vectors of different lengths: what one lacks counts as 0."""
    vectors = vectors.filter(F.col("id").isNotNull())
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # blocks are dealt in turn, from another group on in each task
    turn = F.spark_partition_id() + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    candidates = vectors.mapInArrow(_blocks(SHARD_ROWS), BLOCK).withColumn("part", F.pmod(turn, F.lit(parts)).cast("int"))
    queries = vectors.filter(is_query).mapInArrow(_blocks(QUERY_ROWS), BLOCK)
    queries = queries.select(F.col("rows").alias("q_rows"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    copies = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tiles = copies.join(candidates.hint("merge"), "part")
    lists = tiles.mapInArrow(_tiles(k), "part int, query_id long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    while parts > FAN_IN:
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        at = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))
        lists = lists.withColumn("_r", at).filter(F.col("_r") <= k).drop("_r")
        parts = -(-parts // FAN_IN)
    last = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return last.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """The k best of all embeddings for each row whose vec_id is divisible by `every`.

    Vectors that are null, or hold null or non-finite components, and null vec_ids take no part; repeated vec_ids, vectors of
    different lengths, ties and few candidates: see `top_k`. No vectors: no rows.

    Every block of queries is copied to every group of candidate blocks, which an exact search needs: shuffled bytes are
    those of the queries times the number of shuffle partitions."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(quantised(table, "vec_id", "embedding", scale), F.col("id") % every == 0, k)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
