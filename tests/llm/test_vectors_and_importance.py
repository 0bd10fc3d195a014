"""Vector codes, neighbour search and importance resampling against brute force, on small tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import importance, neighbours, vector_codes
from pagewright.llm.common import whole_vector


def frame(spark, rows):
    """(id, v, label) with columns whose names the operators use themselves."""
    d = spark.createDataFrame(rows, "id long, v array<float>, label int")
    return d.withColumns({"code": F.lit("x"), "error": F.lit(1), "cell": F.lit(1), "grp": F.lit(1), "rank": F.lit(1), "asks": F.lit(1)})


ODD = [(900, None, 1), (901, [1.0, None], 1), (902, [math.nan] * 4, 2), (903, [math.inf, 0.0], None), (904, [], 2), (905, [0.0] * 6, 2)]


def vectors(n, dim, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.5, 2, (n, 1))
    x[n - copies :] = x[0]
    return [(k, [float(np.float32(c)) for c in v], None if k % 7 == 3 else k % 3) for k, v in enumerate(x)]


def codes_by_hand(rows, parts, entries, rounds):
    dim = max(len(v) for _, v, _ in rows)
    width = max(1, -(-dim // parts))
    cut = lambda v: [[math.floor(256 * c) for c in (list(v) + [0] * (parts * width - len(v)))[p * width : (p + 1) * width]] for p in range(parts)]
    x = [(i, cut(v), label) for i, v, label in rows]
    first = sorted(x, key=lambda r: (r[0] is None, r[0]))[:entries]
    books = [[r[1][p] for r in first] for p in range(parts)]
    near = lambda p, q: min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in x:
                held.setdefault(near(p, v[p])[1], []).append(v[p])
            for k, members in held.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = {}
    for i, v, label in x:
        best = [near(p, v[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label)
    flat = ",".join(str(c) for b in books for e in b for c in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("n, dim, parts, entries", [(150, 8, 4, 16), (40, 7, 3, 64), (300, 4, 4, 5)])
def test_op11_codes_are_those_of_a_plain_loop(spark, monkeypatch, n, dim, parts, entries):
    monkeypatch.setattr(vector_codes, "BATCH", 37)
    rows = vectors(n, dim, n, copies=n // 3) + [(None, [0.25] * dim, 1), (950, [1.0], 0)]
    found, books = vector_codes.encode(frame(spark, rows + ODD), parts, entries, 2)
    want, sha = codes_by_hand([*rows, *[r for r in ODD if r[0] in (904, 905)]], parts, entries, 2)
    got = {r.id: (r.code, r.error, r.label) for r in found.collect()}
    assert got == want and vector_codes.digest(books) == sha


def test_op11_bounds_hold_and_the_filter_keeps_ties():
    rng = np.random.default_rng(2)
    for bits in (1, 2, 3, 6):
        entries = rng.integers(-9, 9, (64, 4))
        entries[40:] = entries[:24]
        file, x = vector_codes.VaFile(entries, bits), rng.integers(-12, 12, (500, 4))
        exact = ((x[:, None] - entries) ** 2).sum(axis=2)
        lower, upper = file.bounds(x)
        assert (lower <= exact).all() and (exact <= upper).all()
        k, d = file.nearest(x)
        assert (k == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
    assert (lower > upper.min(axis=1)[:, None]).mean() > 0.5  # most entries are never refined


def test_op11_labels_errors_and_great_components(spark, tmp_path):
    rows = [*vectors(60, 16, 5), (70, [1e30] * 16, 1), (71, [-1e30] * 16, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("_label", F.lit("x")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()
    label = {i: k for i, _, k in rows}
    sums = Counter()
    for r in got:
        sums[label[r.vec_id]] += r.error
    assert len(got) == 62 and all(r.label_error == sums[label[r.vec_id]] for r in got)
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vector_codes.op11_vector_codes(spark, f"{tmp_path}/none").collect() == []


def nearest_by_hand(rows, asks, k):
    dim = max(len(v) for _, v in rows)
    x = np.array([list(v) + [0.0] * (dim - len(v)) for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = {}
    for n in np.flatnonzero([asks(i) for i in ids]):
        s = (x * x[n]).sum(axis=1)
        out.setdefault(int(ids[n]), []).extend((-float(s[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[n])
    return {q: sorted(v)[:k] for q, v in out.items()}


@pytest.mark.parametrize("small", [False, True])
def test_op13_finds_the_nearest(spark, monkeypatch, small):
    if small:  # many groups, blocks, leaves and packs
        for name, value in (("LEAST_GROUP", 20), ("BLOCK_ROWS", 50), ("LEAF_ROWS", 6), ("PACK_ROWS", 3), ("SAMPLE_ROWS", 300)):
            monkeypatch.setattr(neighbours, name, value)
    rows = [(i, v) for i, v, _ in vectors(1500, 24, 9, copies=500)] + [(2000, [1.0, 2.0])]
    odd = [r for r in ODD if r[0] != 904] + [(904, [], 1), (None, [1.0] * 24, 1)]
    got = neighbours.nearest(frame(spark, [(i, v, 0) for i, v in rows] + odd), F.col("id") % 20 == 0, 20).collect()
    want = nearest_by_hand(rows, lambda i: i % 20 == 0, 20)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert by.keys() == want.keys() and all(len(v) == 20 and v == sorted(v) for v in by.values())
    hits = sum(len({i for _, i in by[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    copies = [q for q in want if q == 0 or 1000 <= q < 1500]  # ties of hundreds of equal vectors go to the smallest ids
    same = sum(by[q] == [(pytest.approx(s), i) for s, i in want[q]] for q in copies)
    assert same >= 0.9 * len(copies)


def test_op13_a_sure_search_is_exact(spark):
    rows = [(i, v) for i, v, _ in vectors(400, 10, 3)] + [(20, [1.0] * 10), (7, [3.0] * 10)]
    got = neighbours.nearest(frame(spark, [(i, v, 0) for i, v in rows]), F.col("id") % 20 == 0, 5, 4, 1 - 1e-12).collect()
    want = nearest_by_hand(rows, lambda i: i % 20 == 0, 5)
    for q, answers in want.items():
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == [i for _, i in answers] and np.allclose([s for *_, s in mine], [-s for s, _ in answers], rtol=1e-12)


def test_op13_few_rows_and_none(spark):
    one = neighbours.nearest(frame(spark, [(0, [1.0, 0.0], 0)]), F.col("id") == 0, 20)
    assert one.collect() == []
    three = neighbours.nearest(frame(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [-1.0, 1.0], 0)]), F.col("id") == 0, 20).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in three) == [(1, 1, 1.0), (2, 2, -1.0)]
    none = neighbours.nearest(frame(spark, ODD), F.lit(True), 20)
    assert none.collect() == [] and none.columns == ["query_id", "rank", "vec_id", "score"]


def test_op13_quantiles():
    for m, p, x in ((2, 0.5, 1.3862943611), (8, 0.95, 15.5073130559), (16, 0.9, 23.5418289231)):
        assert abs(neighbours.chi_square_quantile(m, p) - x) < 1e-6


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["the quick brown fox " * 8, "The Ünï-çødé 日本 x" * 9, "", None, "one", "--- ...", "a b c d e f g h i j k l m n o p q r s t", "z" * 400 + " y", " lead and trail  " * 5 + "\n\x00tail", "word " * 3000]


def features_by_hand(text, n):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORDS.findall(low)
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1))


def resampled_by_hand(rows, target, percent, n, least):
    docs = [(i, *features_by_hand(t, n)) for i, t in rows]
    s, t = Counter(), Counter()
    for *_, f in docs:
        s.update(f)
    for x in target:
        t.update(features_by_hand(x, n)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in s}
    out = []
    for i, words, f in docs:
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in f.items())
        out.append((i, words, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return Counter((i, nf, w, sc, rank.get(id(r))) for r in out for i, _, nf, w, sc in [r])


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("cuts", [False, True])
def test_op12_resamples_as_a_plain_loop_does(spark, monkeypatch, n, cuts):
    if cuts:  # texts fall into many chunks, words longer than a chunk among them
        monkeypatch.setattr(importance, "LONG_BYTES", 12)
        monkeypatch.setattr(importance, "CHUNK_CHARS", 7)
    rows = [*enumerate(TEXTS), (0, TEXTS[0]), (3, "other words " * 12), (None, "no id " * 30), (None, None), *((100 + k, f"the fox {k} " * 9) for k in range(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "w": F.lit("x"), "buckets": F.lit(0), "_row": F.lit(1), "score": F.lit(1)})
    target = ["the fox is quick", None, "", "ünï words"]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), 40, n)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == resampled_by_hand(rows, target, 40, n, 20)


def test_op12_chunks_make_up_the_text(spark):
    texts = [t for t in TEXTS if t] + ["\n\n", "a" * 50, "ß☃ x" * 20]
    for n in (1, 3):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", importance.chunks_of(F.col("t"), n, 7).alias("c")).collect()
        for r in got:
            assert "".join(c.own for c in r.c) == r.t.replace("T", "t")
            for a, b in zip(r.c, r.c[1:]):
                assert not (WORDS.fullmatch(a.own[-1]) and WORDS.fullmatch(b.own[0]))
                assert len(WORDS.findall(a.carry)) == min(n - 1, sum(len(WORDS.findall(c.own)) for c in r.c[r.c.index(a) + 1 :])) or r.c.index(a) < len(r.c) - 2


def test_op12_without_documents_or_target(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    assert importance.resample(docs, target).collect() == []
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: (r.n_features, r["rank"]) for r in importance.resample(some, target).collect()} == {1: (2, None), 2: (0, None)}


def test_op12_a_score_that_many_share_is_dealt_by_id(spark):
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(5).cast("long").alias("score"), F.lit(1).cast("long").alias("weight"), F.lit(1).cast("long").alias("n_features"))
    got = importance.ranked(d).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(2000))


def test_whole_vectors(spark):
    rows = frame(spark, ODD)
    assert {r.id for r in rows.filter(whole_vector(F.col("v"))).collect()} == {904, 905}
