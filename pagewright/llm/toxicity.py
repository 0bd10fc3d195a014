"""Toxicity by a counterfactual-regularised linear classifier.

Features of a text are its words and how many of its words go on from a beginning. Weights are at least 0: what is known to be
clean doesn't make up for abuse. Training minimises the logistic loss of labelled texts plus L2 and plus a penalty on the squared change of the logit when the identity terms of a text are swapped for others
of their group: what a mention of a group adds to a score is pushed towards what a mention of any other adds, and
both towards nothing, since a text is also compared with itself without its identity terms. So a neutral mention does
not raise a score though toxic texts mention the group more often.

Labels are learned from a bounded sample (MOST_ROWS of each label) of the rows given for training, whole texts of any
length. Features are counted where the texts are; the driver gets the FEATURES that tell most and, for each row, how
often it has these. Scoring reads whole texts and nothing but texts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import cut

#: Training rows of each label, and the size of the model: of the features that tell labels apart by LEAST_ERRORS the ones
#: that tell most are kept. A sample of this size has far fewer (a test fits a model of twice the size and gets the same scores).
MOST_ROWS, FEATURES = 2_000, 4_096
#: Different features that a task counts before it passes the counts on.
COUNTED = 200_000
#: Standard errors by which a feature's share among label 1 must be above that among label 0.
LEAST_ERRORS = 4.0
#: Beginnings of words that are features, by length.
STEMS = (3, 4, 5, 6, 7, 8)
#: A beginning counts as often as different words of the text have it, up to so many times.
MOST_COUNT = 3
#: Words whose features a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 200_000
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")

#: Groups of identity terms that may stand for one another.
IDENTITY_GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("woman", "man"),
    ("women", "men"),
    ("transgender", "cisgender"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "blind", "deaf"),
    ("mexican", "american", "chinese", "indian", "german", "french", "spanish"),
)
_GROUP = {w: g for g in IDENTITY_GROUPS for w in g}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word and the beginnings that it goes on from; an identity term is itself alone."""
    return ["=" + word] if word in _GROUP else ["=" + word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def counted(words: set[str]) -> dict[str, int]:
    """The features of a text and their counts."""
    out: dict[str, int] = {}
    for w in words:
        for f in features_of(w):
            out[f] = min(MOST_COUNT, out.get(f, 0) + 1)
    return out


def swapped(words: set[str], step: int) -> set[str]:
    """The words with each identity term replaced by the one `step` places on in its group; 0 leaves them out."""
    out = {w for w in words if w not in _GROUP}
    if step:
        for w in words - out:
            g = _GROUP[w]
            out.add(g[(g.index(w) + step) % len(g)])
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def weight_of(self, word: str) -> tuple[tuple[str, float], ...]:
        get = self.weights.get
        return tuple((f, x) for f in features_of(word) if (x := get(f)))


def telling(without: float, having: float, total: tuple[int, int]) -> float:
    """The difference of a feature's shares among label 1 and label 0 in standard errors."""
    p = (without + having) / sum(total)
    return (having / total[1] - without / total[0]) / max(1e-9, (p * (1 - p) * (1 / total[0] + 1 / total[1])) ** 0.5)


def chosen(hits: Iterable[tuple[str, int, int]], total: tuple[int, int]) -> list[str]:
    """The names of the features to keep, of (feature, rows of label 0, rows of label 1); identity terms last."""
    least = min(3, sum(total) // 20 + 1)
    ranked = sorted((-x, f) for f, n, y in hits if n + y >= least and not _is_identity(f) and (x := telling(n, y, total)) >= LEAST_ERRORS)
    return [f for _, f in ranked[:FEATURES]] + ["=" + w for w in _GROUP]


def _is_identity(feature: str) -> bool:
    return feature[0] == "=" and feature[1:] in _GROUP


def cells(words: set[str], at: dict[str, int]) -> list[list[tuple[int, int]]]:
    """(number, count) of the kept features of a text, then of the text without its identity terms and with others, if it has any."""
    steps = (None, 0, 1, 2) if not words.isdisjoint(_GROUP) else (None,)
    sets = [words if s is None else swapped(words, s) for s in steps]
    return [sorted((at[f], n) for f, n in counted(x).items() if f in at) for x in sets]


def solve(names: list[str], rows: list[list[list[tuple[int, int]]]], labels: np.ndarray, penalty: float = 4.0, l2: float = 2e-4, steps: int = 200) -> Model:
    """Full-batch gradient steps (Adam) on the cells of each row; both labels weigh the same together.

    Without both labels the score of every text is the (smoothed) share of label 1."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model({}, float(np.log(share / (1 - share))))

    def matrix(sets: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.array([(r, f, n) for r, fs in enumerate(sets) for f, n in fs], dtype=np.int64).reshape(-1, 3)
        return a[:, 0], a[:, 1], a[:, 2].astype(float)

    row, col, val = matrix([r[0] for r in rows])
    o_row, o_col, o_val = matrix([x for r in rows for x in r[1:]])
    base = np.array([k for k, r in enumerate(rows) for _ in r[1:]], dtype=np.int64)
    total = ((labels == 0).sum(), labels.sum())
    balance = np.where(labels == 1, len(labels) / (2 * total[1]), len(labels) / (2 * total[0]))
    w, b = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, val * w[col], len(rows)) + b
        g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        gb = g.sum()
        if len(base):
            change = z[base] - (np.bincount(o_row, o_val * w[o_col], len(base)) + b)
            c = 2 * penalty * change / len(base)
            g = g + np.bincount(base, c, len(rows))
        gw = np.bincount(col, val * g[row], len(names)) + l2 * w
        if len(base):
            gw -= np.bincount(o_col, o_val * c[o_row], len(names))
        grad = np.append(gw, gb)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = np.maximum(0.0, w - move[:-1]), b - float(move[-1])
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, float(b))


def sampled(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, toxic, text of at most `most` documents of each label: those of the smallest hash of doc_id.

    A document with several labels has the largest; of a repeated doc_id one text is taken, that of the smallest hash."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sides = [known.filter(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for side in (F.col("toxic") == 1, F.col("toxic") != 1)]
    texts = docs.select("doc_id", "text").join(F.broadcast(sides[0].unionByName(sides[1])), "doc_id")  # 2 * most rows
    return texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, penalty: float = 4.0, most: int = MOST_ROWS) -> Model:
    """The model of a sample of docs (doc_id, text) that labels (doc_id, toxic) speak of.

    Null texts are without words. No documents, or one label alone: every score is the share of label 1."""
    sample = cut(sampled(docs, labels, most), "labelled")

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: Counter[tuple[str, int]] = Counter()

        def told() -> pa.RecordBatch:
            found = list(hits)
            out = pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()), pa.array([hits[k] for k in found], pa.int64())], ["feature", "toxic", "hits"])
            hits.clear()
            return out

        for t in tables:
            for text, y in zip(t.column("text").to_pylist(), t.column("toxic").to_pylist(), strict=True):
                hits.update((f, int(y == 1)) for f in counted(words_of(text)))
                if len(hits) > COUNTED:
                    yield told()
        yield told()

    sizes = {r["y"]: r["n"] for r in sample.groupBy((F.col("toxic") == 1).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    total = (sizes.get(0, 0), sizes.get(1, 0))
    if not all(total):
        return solve([], [], np.repeat([0, 1], total))
    hits = sample.select("toxic", "text").mapInArrow(count, "feature string, toxic int, hits long").groupBy("feature")
    hits = hits.agg(F.sum(F.when(F.col("toxic") == 0, F.col("hits")).otherwise(0)).alias("n"), F.sum(F.when(F.col("toxic") == 1, F.col("hits")).otherwise(0)).alias("y"))
    share = (F.col("n") + F.col("y")) / sum(total)
    error = F.sqrt(share * (1 - share) * (1 / total[0] + 1 / total[1]))
    apart = (F.col("y") / total[1] - F.col("n") / total[0]) / F.greatest(F.lit(1e-9), error)
    # the same order as that of `chosen`, with room for features whose last digits differ and for identity terms
    best = hits.filter(apart >= LEAST_ERRORS - 0.01).orderBy(F.round(apart, 9).desc(), "feature").limit(FEATURES + len(_GROUP))
    names = chosen([tuple(r) for r in best.collect()], total)
    at = {f: k for k, f in enumerate(names)}

    def told_cells(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            raws = [json.dumps(cells(words_of(x), at)) for x in t.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("toxic"), pa.array(raws, pa.string())], ["doc_id", "toxic", "cells"])

    found = sample.mapInArrow(told_cells, "doc_id long, toxic int, cells string").collect()  # 2 * most rows of a few features of FEATURES
    found.sort(key=lambda r: r["doc_id"])
    return solve(names, [json.loads(r["cells"]) for r in found], np.array([r["toxic"] == 1 for r in found]), penalty)


def _scorer(model: Model):
    """From texts to their scores; a worker keeps what it knows of words."""
    plain: set[str] = set()
    known: dict[str, tuple[tuple[str, float], ...]] = {}

    def run(texts: pa.Array) -> np.ndarray:
        scores = []
        for text in texts.to_pylist():
            words = words_of(text)
            words -= plain
            found: dict[str, list[float]] = {}
            for w in words:
                hits = known.get(w)
                if hits is None:
                    hits = model.weight_of(w)
                    if hits:
                        known[w] = hits
                    else:
                        plain.add(w)
                for f, x in hits:
                    found.setdefault(f, []).append(x)
            z = model.bias + sum(found[f][0] * min(MOST_COUNT, len(found[f])) for f in sorted(found))
            scores.append(1 / (1 + float(np.exp(-max(-30.0, min(30.0, z))))))
            if len(plain) + len(known) > CACHE_WORDS:
                plain.clear()
                known.clear()
        return np.array(scores, float)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs (doc_id, text), by its text; null as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES features and the identity terms at most

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for t in tables:
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array(scores(t.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id):
    """The remainder by which a third of the documents is kept from training; null ids are held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the labelled documents that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fit(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with scores. Null and empty texts get the score of no words; equal texts get equal scores; a null
    doc_id counts as held out. Repeated rows are scored each. Without labels every score is one half."""
    model = train(spark, sf_dir)
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold. A model without weights (learned
    from one label alone, or where no word tells) knows nothing of texts, and rejects none."""
    if not model.weights:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own, text = docs.columns, docs.columns.index("text")

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for t in tables:
            yield t.filter(pa.array(scores(t.column(text)) < threshold))

    plain = docs.toDF(*[f"c{k}" for k in range(len(own))])  # names with dots don't reach Arrow
    return plain.mapInArrow(run, plain.schema).toDF(*own)
