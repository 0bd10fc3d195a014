"""Approximate nearest neighbours by inner product: stable projections in kd-trees, verified until a chi-square test holds.

Vectors are put on a sphere first: with M the greatest norm, x gets one more component sqrt(M^2 - |x|^2) and a query a
zero, so that |x' - q'|^2 = M^2 + |q|^2 - 2 x.q and the largest inner product is the smallest distance. A few normal
(2-stable) projections follow. The squared projected distance of two vectors, divided by their squared distance, is
chi-square distributed with as many degrees of freedom as projections. A query walks through projected neighbours from
the nearest leaves on and verifies them by their inner products; it may stop once the next projected distance is so great
against the k-th best distance found that a better vector would be so far off with probability 1 - `sure` at most.

The upper levels of the kd-tree are cells, split by a bounded sample of projections; every row is indexed. A cell's rows
are dealt to groups of an even size, so a cell that holds a third of all rows is many groups. A group's rows become
blocks, each with the lower levels of the tree: rows in the order of its leaves, and the leaves' boxes. First each query
walks through the group of its own row. What it found bounds its k-th best distance, and it is sent only to the groups of
cells that the test, held against the distance of its projection to the cell, doesn't rule out. Queries travel in packs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import cut, matrix, number_list, range_parts, whole_vector

#: Rows of the sample by which cells are split, of a block, of a leaf, of a pack of queries, and of the smallest group.
SAMPLE_ROWS, BLOCK_ROWS, LEAF_ROWS, PACK_ROWS, LEAST_GROUP = 10_000, 8_192, 128, 1_024, 1_024

def chi_square_quantile(degrees: int, share: float) -> float:
    """The value below which a chi-square variable of an even number of degrees falls with probability `share`."""
    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < share:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


class Space:
    """The sphere of a table of vectors and its projections; the same for every task."""

    def __init__(self, dim: int, most: float, dims: int, seed: int) -> None:
        self.most, self.axes = most, np.random.default_rng(seed).standard_normal((dim + 1, dims))

    def rows(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))
        return x @ self.axes[:-1] + lift[:, None] * self.axes[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.axes[:-1]


class Cells:
    """The upper levels of the kd-tree: medians of the widest coordinate, nodes numbered as in a heap."""

    def __init__(self, sample: np.ndarray, dims: int, depth: int) -> None:
        self.depth, n = depth, 1 << depth
        self.axis, self.at = np.zeros(n, np.int64), np.zeros(n)
        self.low, self.high = np.full((2 * n, dims), -np.inf), np.full((2 * n, dims), np.inf)
        members = {1: sample}
        for node in range(1, n):
            s = members.pop(node)
            self.axis[node] = a = int(np.argmax(np.ptp(s, axis=0))) if len(s) else 0
            self.at[node] = v = float(np.median(s[:, a])) if len(s) else 0.0
            for child in (2 * node, 2 * node + 1):
                self.low[child], self.high[child] = self.low[node], self.high[node]
            self.high[2 * node, a], self.low[2 * node + 1, a] = v, v
            right = s[:, a] > v
            members |= {2 * node: s[~right], 2 * node + 1: s[right]}

    def of(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] > self.at[node])
        return node - (1 << self.depth)

    def distances(self, p: np.ndarray) -> np.ndarray:
        """Squared distances of projections to the boxes of all cells."""
        n, out = 1 << self.depth, np.zeros((len(p), 1 << self.depth))
        for j in range(p.shape[1]):
            out += np.maximum(np.maximum(self.low[n:, j] - p[:, j, None], p[:, j, None] - self.high[n:, j]), 0) ** 2
        return out


def leaves(p: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of a kd-tree's leaves of at most `size` rows."""
    todo, out = [np.arange(len(p))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        a = int(np.argmax(np.ptp(p[rows], axis=0)))
        half = len(rows) // 2
        order = np.argpartition(p[rows, a], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def _kept(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block that can be an answer: of equal vectors those of the k + 1 smallest ids, which any query's k best
    (itself left out) are taken from."""
    _, vector = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, vector.ravel()))
    v, i = vector.ravel()[order], ids[order]
    other = np.r_[False, (v[1:] == v[:-1]) & (i[1:] != i[:-1])]
    steps = np.cumsum(other)
    first = np.r_[True, v[1:] != v[:-1]]
    within = steps - np.maximum.accumulate(np.where(first, steps, 0))
    return np.sort(order[within <= k])


BLOCK = "grp int, rows int, dim int, ids binary, matrix binary, projected binary, sizes binary, boxes binary"


def _packed(rows: int, make: Callable[[int, pa.Table], pa.RecordBatch]):
    """Makes a row of each run of at most `rows` rows of a group; rows come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group, count = None, 0
        for t in batches:
            numbers = t.column("grp").to_numpy()
            at = 0
            while at < len(numbers):
                if group != numbers[at] or count == rows:
                    if count:
                        yield make(group, pa.Table.from_batches(held))
                    group, held, count = int(numbers[at]), [], 0
                to = min(int(np.searchsorted(numbers, group, "right")), at + rows - count)
                held.append(t.slice(at, to - at))
                count += to - at
                at = to
        if count:
            yield make(group, pa.Table.from_batches(held))

    return run


def _block(space: Space, dim: int, k: int):
    def make(group: int, t: pa.Table) -> pa.RecordBatch:
        ids, x = t.column("id").to_numpy(), matrix(t.column("v").combine_chunks(), dim)
        keep = _kept(ids, x, k)
        ids, x = ids[keep], x[keep]
        p = space.rows(x)
        parts = leaves(p, LEAF_ROWS)
        order = np.concatenate(parts)
        boxes = np.array([[p[r].min(axis=0), p[r].max(axis=0)] for r in parts])
        values = [group, len(ids), dim, ids[order].tobytes(), x[order].tobytes(), p[order].tobytes(), np.array([len(r) for r in parts]).tobytes(), boxes.tobytes()]
        return pa.RecordBatch.from_pylist([dict(zip(("grp", "rows", "dim", "ids", "matrix", "projected", "sizes", "boxes"), values, strict=True))], _arrow(BLOCK))

    return make


PACK = "grp int, q_rows int, q_ids binary, q_matrix binary, q_least binary"


def _pack(dim: int):
    def make(group: int, t: pa.Table) -> pa.RecordBatch:
        q, least = matrix(t.column("v").combine_chunks(), dim), t.column("least").to_numpy()
        values = [group, len(q), t.column("id").to_numpy().tobytes(), q.tobytes(), least.tobytes()]
        return pa.RecordBatch.from_pylist([dict(zip(("grp", "q_rows", "q_ids", "q_matrix", "q_least"), values, strict=True))], _arrow(PACK))

    return make


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


class Block:
    """A kd-tree's leaves with their rows, to be walked through by one query after another."""

    def __init__(self, row: dict, dims: int) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["matrix"]).reshape(row["rows"], row["dim"])
        self.p = np.frombuffer(row["projected"]).reshape(row["rows"], dims)
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.boxes = np.frombuffer(row["boxes"]).reshape(len(sizes), 2, dims)

    def search(self, own: np.ndarray, q: np.ndarray, p: np.ndarray, least: np.ndarray, k: int, most: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and inner products (queries, k) of the k best rows for each query, of those whose product is at least its `least`;
        places that nothing fills have a product of -inf.

        Every query opens its leaves from the nearest box on, in rounds of one, one, two, four and so on; queries that open the same leaf
        in a round do so together. Of a leaf the rows are verified that the stopping test, with the query's k-th best
        product so far, doesn't rule out; a query is done when it rules out the next leaf. Products are estimated by a
        matrix product, and those that may count are computed one by one, so they don't depend on the other queries."""
        n, leaves = len(q), len(self.boxes)
        norm, length = most + (q * q).sum(axis=1), (p * p).sum(axis=1)
        boxes = np.zeros((n, leaves))
        for j in range(p.shape[1]):
            boxes += np.maximum(np.maximum(self.boxes[:, 0, j] - p[:, j, None], p[:, j, None] - self.boxes[:, 1, j]), 0) ** 2
        turn = np.argsort(np.argsort(boxes, axis=1, kind="stable"), axis=1, kind="stable")
        ids, scores = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)
        least, reach = least.copy(), _reach(least, norm, limit)
        low, high = 0, 1
        while low < leaves:
            due = (turn >= low) & (turn < high) & (boxes <= reach[:, None])
            for leaf in np.flatnonzero(due.any(axis=0)):
                asking = np.flatnonzero(due[:, leaf] & (boxes[:, leaf] <= reach))
                rows = slice(self.starts[leaf], self.starts[leaf + 1])
                far = length[asking, None] + (self.p[rows] ** 2).sum(axis=1) - 2 * (p[asking] @ self.p[rows].T)
                room = 1e-12 * norm[asking, None]
                hit = (q[asking] @ self.x[rows].T >= least[asking, None] - room) & (far <= reach[asking, None] + 1e3 * room) & (self.ids[rows] != own[asking, None])
                who, row = np.nonzero(hit)
                who, row = asking[who], row + rows.start
                exact = (self.x[row] * q[who]).sum(axis=1)
                good = exact >= least[who]
                if not good.any():
                    continue
                found = np.unique(who[good])
                asked = np.r_[np.repeat(found, k), who[good]]
                s, i = np.r_[scores[found].ravel(), exact[good]], np.r_[ids[found].ravel(), self.ids[row[good]]]
                order = np.lexsort((i, -s, asked))
                starts = np.searchsorted(asked[order], found)
                best = order[(starts[:, None] + np.arange(k)).ravel()]
                ids[found], scores[found] = i[best].reshape(-1, k), s[best].reshape(-1, k)
                least[found] = np.maximum(least[found], scores[found, -1])
                reach[found] = _reach(least[found], norm[found], limit)
            low, high = high, 2 * high
        return ids, scores


def _reach(least: np.ndarray, norm: np.ndarray, limit: float) -> np.ndarray:
    """The squared projected distances beyond which the stopping test holds, with some room for rounding."""
    return limit * np.maximum(norm - 2 * least, 0) * (1 + 1e-9) + 1e-9 * norm


def _answers(space: Space, k: int, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = space.axes.shape[1]
        for t in batches:
            for row in t.to_pylist():
                block = Block(row, dims)
                q_ids, least = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_least"])
                q = np.frombuffer(row["q_matrix"]).reshape(row["q_rows"], row["dim"])
                ids, scores = block.search(q_ids, q, space.queries(q), least, k, space.most, limit)
                there = scores > -np.inf
                columns = [np.repeat(q_ids, there.sum(axis=1)), ids[there], scores[there]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def _sent(space: Space, cells: Cells, first: np.ndarray, groups: np.ndarray, dim: int, limit: float):
    """A row of a query for each group that the test doesn't rule out, but its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a in range(0, t.num_rows, 256):
                some = t.slice(a, 256)
                q, least, own = matrix(some.column("v"), dim), some.column("least").to_numpy(), some.column("grp").to_numpy()
                reach = _reach(least, space.most + (q * q).sum(axis=1), limit)
                row, cell = np.nonzero(cells.distances(space.queries(q)) <= reach[:, None])
                number = np.repeat(first[cell], groups[cell]) + np.concatenate([np.empty(0, np.int64), *(np.arange(n) for n in groups[cell])])
                row = np.repeat(row, groups[cell])
                keep = number != own[row]
                for b in range(0, int(keep.sum()), 4096):
                    picked = pa.array(row[keep][b : b + 4096])
                    columns = [pa.array(number[keep][b : b + 4096], pa.int32()), *(some.column(c).take(picked) for c in ("id", "v", "least"))]
                    yield pa.RecordBatch.from_arrays(columns, ["grp", "id", "v", "least"])

    return run


def _best(lists: DataFrame, k: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return lists.withColumn("rank", at).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, dims: int = 16, sure: float = 0.95, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score of (id long, v array): the k largest inner products found for each query, best first,
    ties to the smaller vec_id. `dims` is even.

    Rows with a query's own id are no candidates of it. Vectors that are null, zero or hold null or non-finite
    components, and null ids, take no part; shorter vectors are filled up with 0. Where a query's id repeats each of its
    rows asks, and the best answers count. Fewer candidates than k: all of them. Vectors are written once with their cell."""
    spark = vectors.sparkSession
    kept = vectors.filter(F.col("id").isNotNull() & whole_vector(F.col("v")) & F.exists("v", lambda e: e != 0)).select(F.col("id").cast("long").alias("id"), "v", is_query.alias("asks"))
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    dim, most, total = kept.agg(F.max(F.size("v")), F.max(square), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    space = Space(dim, most * (1 + 1e-12), dims, seed)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            p = space.rows(matrix(t.column("v"), dim))
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), dims).cast(pa.list_(pa.float64()))], ["p"])

    sample = kept.orderBy(F.xxhash64("id", "v")).limit(SAMPLE_ROWS).select("v").mapInArrow(projected, "p array<double>").toArrow()
    points = matrix(sample.column("p").combine_chunks(), dims)
    # every group gives lists of answers, so there are about as many as partitions and no more
    group_rows = max(LEAST_GROUP, total // int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = Cells(points, dims, int(math.log2(max(1, min(range_parts(spark), len(points) // 8, total // group_rows)))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            cell = cells.of(space.rows(matrix(t.column("v"), dim)))
            yield pa.RecordBatch.from_arrays([t.column("id"), t.column("v"), t.column("asks"), pa.array(cell, pa.int32())], ["id", "v", "asks", "cell"])

    kind = kept.schema["v"].dataType.simpleString()
    rows = cut(kept.mapInArrow(placed, f"id long, v {kind}, asks boolean, cell int"), "cells")
    groups = np.zeros(1 << cells.depth, np.int64)
    for cell, n in rows.groupBy("cell").count().collect():
        groups[cell] = max(1, round(n / group_rows))
    first = np.cumsum(groups) - groups
    at = lambda values: F.element_at(number_list(values.tolist()), F.col("cell") + 1)
    grouped = rows.withColumn("grp", (at(first) + F.pmod(F.xxhash64("id"), at(groups))).cast("int"))
    blocks = grouped.select("grp", "id", "v").repartition("grp").sortWithinPartitions("grp", "id").mapInArrow(_packed(BLOCK_ROWS, _block(space, dim, k)), BLOCK)
    blocks = cut(blocks, "blocks")
    limit = chi_square_quantile(dims, sure)

    def ask(queries: DataFrame) -> DataFrame:
        packs = queries.select("grp", "id", "v", "least").repartition("grp").sortWithinPartitions("grp").mapInArrow(_packed(PACK_ROWS, _pack(dim)), PACK)
        return packs.join(blocks.hint("merge"), "grp").mapInArrow(_answers(space, k, limit), "query_id long, vec_id long, score double")

    asking = grouped.filter("asks").drop("asks", "cell")
    home = cut(_best(ask(asking.withColumn("least", F.lit(float("-inf")))), k).drop("rank"), "home")
    known = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    least = F.coalesce(F.when(F.col("n") >= k, F.col("s")), F.lit(float("-inf")))
    bounded = asking.join(known.withColumnRenamed("query_id", "id"), "id", "left").select("grp", "id", "v", least.alias("least"))
    sent = bounded.mapInArrow(_sent(space, cells, first, groups, dim, limit), f"grp int, id long, v {kind}, least double")
    return _best(home.unionByName(ask(sent)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_neighbours(spark: SparkSession, sf_dir: str, k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest found among all embeddings for each row whose vec_id is divisible by `every`; see `nearest`."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(table, F.col("id") % every == 0, k)
