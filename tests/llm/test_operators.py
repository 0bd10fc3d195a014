"""Every operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows,
no rows, and extra columns with clashing names."""

import hashlib
import math
import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import common, html_blocks, html_extract, html_model, mixing, ngram_join, packing, sharding, simhash, token_store, tokens, topk, toxicity, warc

TEXTS = [
    "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "The QUICK brown fox jumps over the lazy dog and runs away from the big bad wolf today",
    "", None, "one", "one two", "a  b\n\n c\td ", "word " * 3000, "ünï çødé 日本 😀 text here", "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf tonight", "one",
]


def docs_frame(spark, rows=None):
    rows = [(k, t, None if k == 5 else f"s{k % 3}") for k, t in enumerate(TEXTS)] + [(4, "one", "s1"), (None, "no id", "s1")] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "shard": F.lit(9), "start": F.lit(0), "length": F.lit(1), "score": F.lit(0.5), "_b": F.lit(1), "position": F.lit(1), "n": F.lit(1)})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs_frame(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    html = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Big  news</h1><p>It is &amp; was.<br>So.<p>More text here, again.</article><footer>&copy; us</footer></body></html>"
    pages = [(1, "u", html), (2, None, None), (3, "u", html), (0, "v", "short"), (5, "v", "short"), (1, "u", html), (7, "w", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1)).write.parquet(f"{path}/pages.parquet")
    rng = np.random.default_rng(1)
    vectors = [(k, [float(x) for x in rng.integers(-3, 4, 5)]) for k in range(120)] + [(200, None), (201, [1.0, None]), (202, [math.nan, 1.0]), (203, [math.inf]), (50, [1.0, 1.0, 1.0, 1.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    docs_frame(spark, []).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


ALL = [sharding.op1_sharding, packing.op2_packing, toxicity.op3_toxicity, simhash.op4_simhash, html_extract.op5_html_extract, warc.op6_warc, topk.op7_topk, mixing.op8_mixing, token_store.op9_token_store, ngram_join.op10_ngram_join]


@pytest.mark.parametrize("op", ALL, ids=lambda f: f.__name__)
def test_empty_tables_give_no_rows(spark, empty, op):
    assert op(spark, empty).collect() == []


def test_op1_sharding(spark, folder):
    got = sharding.op1_sharding(spark, folder).collect()
    assert len(got) == len(TEXTS) + 2
    for s, rows in _by(got, "shard").items():
        assert 0 <= s < 8 and sorted(r.slot for r in rows) == list(range(len(rows)))
    for r in got:
        assert r.grown_shard in (r.shard, 8)
    want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in [*enumerate(TEXTS), (4, "one"), (None, "no id")])
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want


def test_op1_weights_and_movement(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    key = F.col("doc_id").cast("string")
    t = sharding.Topology(({"r0": {"k0": {0: 3.0, 1: 1.0}}, "r1": {"k1": {2: 2.0}, "k2": {3: 2.0, 4: 0.0}}},))
    share = Counter(r.s for r in sharding.assign(ids, key, t, "s").collect())
    assert share[4] == 0 and all(abs(share[s] / 4000 - w / 8) < 0.03 for s, w in ((0, 3), (1, 1), (2, 2), (3, 2)))
    for n in (1, 2, 5, 8):
        both = sharding.assign(sharding.assign(ids, key, sharding.regular(n), "a"), key, sharding.regular(n).grown("new", "new", n), "b").collect()
        assert all(r.b in (r.a, n) for r in both) and any(r.b == n for r in both)


def test_op1_a_count_has_one_tree(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    dealt = {n: {r.doc_id: r for r in sharding.op1_sharding(spark, str(tmp_path), n).collect()} for n in (1, 2, 7, 8, 9, 10)}
    for n in (1, 7, 8, 9):
        assert all(r.grown_shard in (r.shard, n) for r in dealt[n].values())
        assert n + 1 not in dealt or all(dealt[n + 1][i].shard == r.grown_shard for i, r in dealt[n].items())
    shares = Counter(r.shard for r in dealt[8].values())
    assert all(abs(shares[k] - 375) < 80 for k in range(8))


def _by(rows, name):
    out = defaultdict(list)
    for r in rows:
        out[r[name]].append(r)
    return out


def ids_of(text):
    """The library's ids of a whole text."""
    return tokens.encoder(tokens.default_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


ODD = [" a", "a ", "a  b", "\n\na b\n", "it's. don't, 'tis", "12.5 3,4", "x\ty z", "日本 語。 ok", "a\nb\nc d\n e", "don't' s'", "<|endoftext|> a<|endoftext|>. b", "", None, "\x1c a b", "\u00a0\nx \u3000 y", "a\u0085\u2028 b", "e\u0301.a x\u00f7y'll"]
PARTS = ["a", "the", "Z", "s", "re", "'", "'s", '"', ".", "(", "_", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u0085", "\u2028", "\u3000", "\u200b", "\x1c", "\x00", "\x0b", "é", "日本", "e\u0301", "😀", "23", "½", "٣", "<|", "endoftext", "|>", "→", "ß"]


@pytest.mark.parametrize("run, cache", [(None, None), (200, 20_000)])
def test_tokens_are_those_of_the_library(monkeypatch, run, cache):
    if run:
        monkeypatch.setattr(tokens, "RUN_BYTES", run)  # texts are cut inside, the dictionary starts anew often
        monkeypatch.setattr(tokens, "CACHE_BYTES", cache)
    rng = np.random.default_rng(11)
    made = ["".join(rng.choice(PARTS, int(rng.integers(0, 15)))) for _ in range(3000)] + ["".join(rng.choice([*PARTS, "ab cd"], 800)) for _ in range(20)]
    texts = ODD + TEXTS + made
    e, got = tokens.Encoder(tokens.default_vocabulary()), {}
    for first, ids, bounds in e.encode(pa.array(texts, pa.string())):
        got |= {first + k: ids[a:b].tolist() for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))}
    assert e.by_pieces and sorted(got) == list(range(len(texts)))
    for k, t in enumerate(texts):
        assert got[k] == ids_of(t), t


def test_vocabularies_of_other_kinds_are_used_as_they_are():
    import public_tokenizers

    e = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello  World, it's", None, "", "a\nb"]
    got = {first: ids.tolist() for first, ids, _ in e.encode(pa.array(texts, pa.string()))}
    assert not e.by_pieces and got == {k: e.tokenizer.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_op2_packing(spark, folder):
    got = packing.op2_packing(spark, folder).collect()
    for rows in _by(got, "sequence_id").values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    want = Counter()
    for k, t in [*enumerate(TEXTS), (4, "one"), (None, "no id")]:
        raw = packed([*ids_of(t), 0])
        n, at, p = len(raw) // 4, 0, 0
        while at < n:
            size = (n - at - 1) % 2048 + 1 if p == 0 else 2048
            want[k, p, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])] += 1
            at, p = at + size, p + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_plans_of_bins():
    rng = np.random.default_rng(3)
    for _ in range(30):
        cap = int(rng.integers(5, 60))
        histogram = Counter(int(x) for x in rng.integers(1, cap + 1, int(rng.integers(1, 200))))
        plan, used, bins = packing.plan_bins(dict(histogram), cap), Counter(), defaultdict(int)
        for n, first, count, seq, _ in plan:
            assert first == used[n]
            used[n] += count
            for k in range(count):
                bins[seq + k] += n
        assert used == histogram and max(bins.values()) <= cap
        best = packing.fullest(dict(histogram), cap)
        assert sum(n * k for n, k in best.items()) <= cap and best[max(histogram)] >= 1
    assert packing.fullest({6: 1, 5: 1, 4: 2, 3: 1}, 10) in ({6: 1, 4: 1},)


def _fewest(sizes, cap):
    """The least number of bins, by trying all places of each piece, largest first."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for j in {room: j for j, room in enumerate(bins)}.values():
            if bins[j] >= sizes[k]:
                go(k + 1, [*bins[:j], bins[j] - sizes[k], *bins[j + 1 :]])
        go(k + 1, [*bins, cap - sizes[k]])

    go(0, [])
    return best[0]


def test_bins_are_as_full_and_as_few_as_they_can_be():
    rng = np.random.default_rng(9)
    more = 0
    for _ in range(150):
        cap = int(rng.integers(8, 40))
        sizes = [int(x) for x in rng.integers(1, cap + 1, int(rng.integers(1, 10)))]
        counts = Counter(sizes)
        best = packing.fullest(dict(counts), cap)
        rest = list((counts - Counter([max(sizes)])).elements())
        sums = {0}
        for n in rest:
            sums |= {x + n for x in sums}
        assert sum(n * k for n, k in best.items()) == max(sizes) + max(x for x in sums if x <= cap - max(sizes))
        assert all(k <= counts[n] for n, k in best.items())
        used = max(r[3] + r[2] for r in packing.plan_bins(dict(counts), cap))
        least = _fewest(sizes, cap)
        assert least <= used <= least + 1
        more += used - least
    assert more <= 3


def test_op2_plan_may_be_too_large_to_broadcast(spark, monkeypatch):
    d = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("length"))
    small = sorted(tuple(r) for r in packing.pack(d, 10, ["doc_id"]).collect())
    monkeypatch.setattr(packing, "PLAN_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 0)
    assert sorted(tuple(r) for r in packing.pack(d, 10, ["doc_id"]).collect()) == small
    bins = defaultdict(int)
    for r in packing.pack(d, 10, ["doc_id"]).collect():
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 10 and len(bins) <= -(-sum(k % 7 + 1 for k in range(500)) // 10) + 2


def plain_fit(texts, labels, penalty=4.0):
    """The classifier fitted in one place on sets of words."""
    hits, y = Counter(), np.asarray(labels)
    for words, label in zip(texts, y, strict=True):
        hits.update((f, int(label)) for f in toxicity.counted(words))
    total = (int((y == 0).sum()), int((y == 1).sum()))
    names = toxicity.chosen([(f, hits[f, 0], hits[f, 1]) for f in sorted({f for f, _ in hits})], total) if all(total) else []
    at = {f: k for k, f in enumerate(names)}
    return toxicity.solve(names, [toxicity.cells(words, at) for words in texts], y, penalty)


def logit(model, words):
    return model.bias + sum(model.weights.get(f, 0) * n for f, n in toxicity.counted(words).items())


def labelled(count):
    rng, base = np.random.default_rng(0), [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(20) for j in range(10)]
    texts, labels = [], []
    for k in range(count):
        bad = k % 3 == 0
        words = set(map(str, rng.choice(base, 12))) | ({str(rng.choice(["idiot", "moron"]))} if bad else set())
        if rng.random() < (0.8 if bad else 0.1):
            words.add("muslim")  # mentioned in abuse more often
        texts.append(words)
        labels.append(int(bad))
    return texts, labels


def test_op3_on_odd_rows(spark, folder):
    got = toxicity.op3_toxicity(spark, folder).collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1


def test_op3_counterfactuals():
    texts, labels = labelled(600)
    plain, fair = plain_fit(texts, labels, penalty=0.0), plain_fit(texts, labels)
    mention = {"waa", "muslim"}
    assert logit(fair, mention) - logit(fair, {"waa"}) < 0.5 * (logit(plain, mention) - logit(plain, {"waa"}))
    right = sum((logit(fair, w) >= math.log(0.7 / 0.3)) == bool(y) for w, y in zip(texts, labels, strict=True))
    assert right / len(texts) > 0.97
    assert plain_fit([], []).weights == {} and plain_fit([{"a"}], [1]).weights == {}


@pytest.mark.parametrize("most", [2000, 60])
def test_op3_scores_are_those_of_one_place(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(toxicity, "COUNTED", 50)  # tasks pass counts on many times
    texts, labels = labelled(900)
    rows = [(k, " ".join(sorted(t))) for k, t in enumerate(texts)] + [(0, " ".join(sorted(texts[0])))]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [*enumerate(labels), (3, 0), (None, 1), (5, None)]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity.fit, "__defaults__", (4.0, most))
    got = {r.doc_id: r.score for r in toxicity.op3_toxicity(spark, str(tmp_path)).collect()}
    learned = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 != 1]
    order = {r.id: r.h for r in spark.range(900).select("id", F.xxhash64("id").alias("h")).collect()}
    learned = sorted(k for y in (0, 1) for k in sorted((k for k in learned if labels[k] == y), key=order.get)[:most])
    model = plain_fit([texts[k] for k in learned], [labels[k] for k in learned])
    assert all(abs(got[k] - 1 / (1 + math.exp(-logit(model, t)))) < 1e-9 for k, t in enumerate(texts))
    out = [k for k in range(900) if k not in learned]
    assert sum((got[k] >= 0.7) == bool(labels[k]) for k in out) / len(out) > 0.95


def test_op4_simhash(spark, folder):
    got = simhash.op4_simhash(spark, folder).collect()
    order = sorted([(-1 if k is None else k, t or "") for k, t in [*enumerate(TEXTS), (4, "one"), (None, "no id")]])
    want = Counter()
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    marks = {r.doc_id: r.fingerprint for r in got}
    assert marks[4] == marks[10] and marks[0] == marks[1] and all(len(m) == 32 for m in marks.values())
    near = {r.doc_id: r.n_near for r in got}
    for r in got:
        close = sum(bin(int(r.fingerprint, 16) ^ int(o.fingerprint, 16)).count("1") <= simhash.RADIUS for o in got) - 1
        assert r.n_near == (close if r.doc_id is not None and r.doc_id % 20 == 0 else None)
    assert near[0] >= 1
    # fingerprints by plain loops over the votes of each term
    votes = {t: _fingerprint(spark, t) for t in {t for _, t in order}}
    likeness = lambda a, b: 1 - bin(a ^ b).count("1") / 128
    want = Counter()
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = _fingerprint(spark, t[: len(t) - half] + after[:half])
        want[i, f"{votes[t]:032x}", f"{edited:032x}", likeness(votes[t], edited), likeness(votes[t], votes[after])] += 1
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == want


def _fingerprint(spark, text):
    terms = Counter(x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x)
    if not terms:
        return 0
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select("t", F.xxhash64("t").alias("h"), F.xxhash64("t", F.lit(1)).alias("l")).collect()
    heavy = {t: n * (1 if len(t) <= 3 else 8 * (min(len(t), 20) - 3)) for t, n in terms.items()}
    out = 0
    for bit in range(128):
        yes = sum(heavy[r.t] for r in rows if ((r.l >> bit) if bit < 64 else (r.h >> bit - 64)) & 1)
        out |= (2 * yes > sum(heavy.values())) << bit
    return out


@pytest.mark.parametrize("ids", [[5], [5, 5, 5], [None, None, 3], list(range(100, 0, -1)), [0, 7, 7, 7, 9, -4, None], [1 << 60, 1, 2]])
def test_each_document_knows_its_next(spark, ids):
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    got = sorted(r for r in simhash.with_next(spark.createDataFrame(rows, "doc_id long, text string")).filter("ghost = 0").collect())
    assert sorted(r.text for r in got) == sorted(t for _, t in rows)
    order = [r.doc_id for r in got]
    assert order == sorted(ids, key=lambda i: (i is not None, i))
    assert [r.next for r in got] == [r.text for r in got[1:] + got[:1]]


def test_ranges_are_those_of_a_search(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 101):
        bounds = sorted({int(x) for x in rng.integers(-1000, 1000, n)})
        got = spark.range(-1100, 1100).select("id", common.range_bucket(F.col("id"), bounds).alias("b")).collect()
        assert all(r.b == np.searchsorted(bounds, r.id, "right") for r in got)


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    table = [(h, base[0]) for h in base]
    for _ in range(200):
        h, low = int(rng.choice(base)), base[0]
        for b in rng.choice(126, int(rng.integers(0, 9)), replace=False).tolist():
            h, low = (h ^ 1 << b, low) if b < 63 else (h, low ^ 1 << b - 63)
        table.append((h, low))
    d = spark.createDataFrame(table, "high long, low long")
    apart = lambda a, b: bin((a[0] ^ b[0]) & (1 << 64) - 1).count("1") + bin((a[1] ^ b[1]) & (1 << 64) - 1).count("1")
    queries = table[::7]
    got = [tuple(r) for r in simhash.near(spark.createDataFrame(queries, "high long, low long"), d, 5).collect()]
    want = {(*q, *t, apart(q, t)) for q in set(queries) for t in set(table) if apart(q, t) <= 5}
    assert len(got) == len(set(got)) and set(got) == want


def test_op5_html(spark, folder):
    got = {r.page_id: r.text for r in html_extract.op5_html_extract(spark, folder).collect()}
    assert got[1] == "Big news\nIt is & was. So.\nMore text here, again." and got[2] == "" and got[7] == ""
    assert [b.text for b in html_blocks.blocks("<p>a<script>x</p>y</script>b<!-- c --><div title='>'>d &lt;<b>e</b></div>f<li>g<li>h")] == ["ab", "d <e", "f", "g", "h"]


FOREIGN = [
    (
        """<!DOCTYPE html><html><head><title>T</title><style>.x{}</style><script>var a=1;</script></head><body>
<div class="topbar"><a href="/">Start</a> <a href="/n">News</a> <a href="/s">Sport</a></div>
<div id="wrap"><main><h1>The river rises again</h1><p class="lead">Heavy rain in the hills has raised the river by two metres since Monday, officials said.</p>
<p>Farmers along the lower valley moved their cattle to higher ground, and the old bridge was closed. &quot;We have seen worse&quot;, said one of them.</p>
<h2>What happens next</h2><p>Forecasters expect the water to fall slowly from Thursday on, if no more rain comes.</p></main>
<aside class="right-col"><h3>Most read</h3><ul><li><a href="/1">Ten best cakes</a></li><li><a href="/2">Cup final tickets</a></li></ul></aside></div>
<div class="cookie-banner">We use cookies to improve your experience. <button>Accept</button></div>
<footer><p>Copyright 2024 Valley Post. All rights reserved.</p><a href="/imprint">Imprint</a></footer></body></html>""",
        """The river rises again
Heavy rain in the hills has raised the river by two metres since Monday, officials said.
Farmers along the lower valley moved their cattle to higher ground, and the old bridge was closed. "We have seen worse", said one of them.
What happens next
Forecasters expect the water to fall slowly from Thursday on, if no more rain comes.""",
    ),
    (
        """<html><body><table><tr><td><a href=a>Home</a> | <a href=b>About</a> | <a href=c>Contact</a></td></tr></table>
<div class="post-entry"><h2>Baking bread at home</h2><div>Mix the flour with water and salt, and let the dough rest for an hour under a cloth.</div><div>Fold it four times, half an hour
 apart; bake it in a hot pot for forty minutes.</div><ul><li>500 g of flour</li><li>350 g of water</li></ul></div>
<div class="respond"><h3>Comments</h3><div class="c-item"><b>Anna</b> says: Great recipe, thanks a lot!</div><div class="c-item"><b>Tom</b> says: Mine did not rise.</div><form><input><textarea></textarea><button>Send</button></form></div>
<div class="promo">Advertisement: Buy our new oven now - 50% off!</div></body></html>""",
        """Baking bread at home
Mix the flour with water and salt, and let the dough rest for an hour under a cloth.
Fold it four times, half an hour apart; bake it in a hot pot for forty minutes.
500 g of flour
350 g of water""",
    ),
]


def test_op5_on_other_layouts(spark, tmp_path):
    rows = [(k, "u", page) for k, (page, _) in enumerate(FOREIGN)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.op5_html_extract(spark, str(tmp_path)).collect()}
    assert got == {k: (text, len(text)) for k, (_, text) in enumerate(FOREIGN)}


def test_the_saved_labeller_is_what_training_gives():
    made, saved = html_model.taught().params(), html_model.trained().params()
    assert all(np.allclose(a, b, atol=1e-2) for a, b in zip(made, saved, strict=True))


def test_labeller_on_unseen_pages():
    rng, reader, model = np.random.default_rng(321), html_model.Reader(), html_model.trained()
    right = total = 0
    for _ in range(60):
        page, marks = html_model.made_up(rng)
        right += int((html_model.label(model, reader, [html_blocks.blocks(page)])[0] == np.array(marks)).sum())
        total += len(marks)
    assert right / total > 0.97


def test_op6_warc(spark, folder, tmp_path):
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op6_warc(spark, folder).collect())
    n = got[1][1]
    assert got == sorted([(0, 5, "response", None), (1, n, "response", None), (1, n, "response", None), (2, 0, "response", None), (3, n, "revisit", 1), (5, 5, "response", None), (7, 0, "response", None)])
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    warc.write_archives(pages, str(tmp_path / "w"))
    for size in (1, 50, 1 << 20):
        assert warc.read_archives(spark, str(tmp_path / "w"), size).count() == 7
    inner = warc.record(1, "u", b"x" * 300, None)
    whole = inner + b"junk\x1f\x8b\x08junk" + warc.record(2, "u", MAGIC_INSIDE, None)
    found = list(warc.members(lambda at, n: whole[at : at + n], 0, len(whole), len(whole), 7))
    assert [warc.parse(raw)["body"] for _, raw in found] == [b"x" * 300, MAGIC_INSIDE]


def test_op6_damage_is_an_error(spark, folder, tmp_path):
    path = str(tmp_path / "w")
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    warc.write_archives(pages.coalesce(1), path)
    file = next(r.file for r in spark.read.parquet(f"{path}/manifest").collect() if r.records > 1)
    with open(file, "rb") as f:
        raw = f.read()
    places = [at for at, _ in warc.members(lambda at, n: raw[at : at + n], 0, len(raw), len(raw))]
    for at in (places[1], places[1] + 40, len(raw) - 6):
        with open(file, "wb") as f:
            f.write(raw[:at] + bytes([raw[at] ^ 0x55]) + raw[at + 1 :])
        with pytest.raises(Exception, match="could be read|damaged"):
            warc.read_archives(spark, path).collect()


MAGIC_INSIDE = b"\x1f\x8b\x08" * 50


def test_op7_topk(spark, folder):
    rows = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.op7_topk(spark, folder).collect()}
    for q in (0, 50, 100):  # 50 asks with both of its vectors
        best = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for j, mine in rows if j == q for i, v in rows if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert len(got) == 15


def test_op7_products_are_exact():
    rng = np.random.default_rng(6)
    for top in (1 << 20, 1 << 29, 1 << 52, 1 << 80):
        q, c = (np.floor(rng.uniform(-1, 1, (3, 4)) * top) for _ in range(2))
        want = [[min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), -(1 << 63)), (1 << 63) - 1) for y in c] for x in q]
        assert topk.products(q, c).tolist() == want


def test_op7_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 4)] + [1e30] * (k % 97 == 0)) for k in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    blocks = topk._blocks
    monkeypatch.setattr(topk, "_blocks", lambda n: blocks(13))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.op7_topk(spark, str(tmp_path)).collect()}
    whole = {k: [math.floor(256 * x) for x in v] for k, v in rows}
    for q in range(0, 400, 50):
        clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=False))), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_op8_mixing(spark, folder):
    got = mixing.op8_mixing(spark, folder).collect()
    sizes = Counter()
    for k, t in [*enumerate(TEXTS), (4, "one"), (None, "no id")]:
        sizes["~" if k == 5 else "s1" if k is None else f"s{k % 3}"] += len((t or "").split())
    assert sum(r.taken for r in got) <= sum(sizes.values()) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    for source_size, rows in _by(got, "source_size").items():
        if len({r.target for r in rows}) == 1:
            assert abs(sum(r.taken for r in rows) - rows[0].target) < 1 and rows[0].target <= 3 * source_size
    again = mixing.op8_mixing(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_demand_is_inverted(spark):
    for knots in (*mixing.SCHEDULES.values(), ((0.0, 0.0), (1.0, 2.0))):
        got = spark.range(101).select((F.col("id") / 100).alias("u"), mixing.inverse_demand(F.col("id") / 100, knots).alias("t")).collect()
        area = lambda t: sum((min(t, b[0]) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (min(t, b[0]) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(knots, knots[1:], strict=False) if t > a[0])  # noqa: B023, E731
        assert all(abs(area(r.t) - r.u * area(1.0)) < 1e-6 for r in got)


def test_op9_store(spark, folder, tmp_path, monkeypatch):
    want = Counter((k, len(ids_of(t)) + 1, zlib.crc32(packed([*ids_of(t), 2]))) for k, t in [*enumerate(TEXTS), (4, "one"), (None, "no id")])
    for hot in (common.HOT_ROWS, 0):  # in the second run every chunk's references are dealt out
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        got = sorted(token_store.op9_token_store(spark, folder).collect(), key=lambda r: r.start)
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id for r in got]
        assert ids[0] is None and ids[1:] == sorted(ids[1:])
    path = str(tmp_path / "store")
    token_store.write_store(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), path)
    back = {(r.doc_id, tuple(r.ids)) for r in token_store.read_ids(spark, path).collect()}
    assert (7, (*ids_of(TEXTS[7]), 2)) in back
    stored = spark.read.parquet(f"{path}/data").filter("kind = 'chunk'")
    assert stored.count() == stored.select("hash").distinct().count()


CHANGES = [("recipes", "n_tokens", "n_tokens + 1"), ("recipes", "start", "start + 1"), ("recipes", "hashes", "concat(hashes, hashes)"), ("recipes", "root", "unhex(reverse(hex(root)))"), ("recipes", "doc_id", "doc_id + 1"), ("data", "payload", "unhex(reverse(hex(payload)))"), ("data", "n_ids", "n_ids + 1"), ("manifest", "documents", "documents + 1")]


def test_a_changed_store_is_noticed(spark, folder, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), path)
    token_store.read_digests(spark, path).collect()
    for k, (table, column, change) in enumerate(CHANGES):
        shutil.copytree(path, f"{path}{k}")
        shutil.rmtree(f"{path}{k}/{table}")
        kinds = ["kind"] if table == "data" else []
        spark.read.parquet(f"{path}/{table}").withColumn(column, F.expr(change)).write.partitionBy(*kinds).parquet(f"{path}{k}/{table}")
        with pytest.raises(Exception, match="don't|damaged|doesn't"):
            token_store.read_digests(spark, f"{path}{k}").collect()


def test_crc_join():
    rng = np.random.default_rng(0)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 5000, (50, 2))]
    got = token_store.crc_join(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([zlib.crc32(b) for _, b in parts], np.uint32), np.array([len(b) for _, b in parts], np.int64))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def _components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def test_op10_join(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = list(enumerate(TEXTS))
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(3, 120)))]
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for p in rng.integers(0, len(w), int(rng.integers(0, 4))):
                w[p] = f"v{rng.integers(0, 99)}"
            rows.append((len(rows), " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit("x"))
    for k, percent in ((3, 90), (5, 80), (1, 50)):
        assert {tuple(r) for r in ngram_join.ngram_join(d, k, percent).collect()} == _components(rows, k, percent)
    want = _components(rows, 3, 90)
    for module, name, value in ((ngram_join, "BLOCK_SHINGLES", 2000), (ngram_join, "HOT_LIST", 1), (ngram_join, "MOST_COMPARED", 1), (ngram_join, "BROADCAST_IDS", 0), (common, "HOT_ROWS", 0)):
        with monkeypatch.context() as m:  # clusters in blocks; dealt lists; lists as clusters; ids joined; dealt rows
            m.setattr(module, name, value)
            assert {tuple(r) for r in ngram_join.ngram_join(d, 3, 90).collect()} == want, name


def test_one_of_each_goes_by_id_and_text(spark):
    long = [" ".join(f"{p}{k}" for k in range(40)) for p in "abc"]
    near = long[0] + " more"
    rows = [(2, long[0]), (5, long[1]), (5, near), (7, long[1]), (7, long[2]), (7, long[2]), (None, long[0]), (None, long[0]), (9, None), (9, None), (9, ""), (8, "...")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_again": F.lit(1), "n": F.lit(2), "_row": F.lit(3), "first": F.lit(4), "a.b": F.lit(5)})
    got = ngram_join.one_of_each(d)
    assert got.columns == d.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert kept == Counter([(2, long[0]), (5, long[1]), (7, long[2]), (None, long[0]), (None, long[0]), (9, None), (9, ""), (8, "...")])


def test_pipeline_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k == 1:
            ids = [r.doc_id for r in docs.collect()]
            assert 1 not in ids and 10 not in ids and 0 in ids and ids.count(4) == 1
    assert docs.filter("length > 2048").count() == 0 and docs.count() > 0


def test_pipeline_on_odd_input(spark, folder, empty, tmp_path):
    import corpus_pipeline

    none = spark.read.parquet(f"{empty}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, empty).collect() == [], name
    long = " ".join(f"w{k % 997}" for k in range(60_000))
    rows = [(1, None, None), (1, None, None), (2, "", "a"), (None, "x y", "a"), (3, long, None), (4, long + " end", "b"), (3, long, None), (5, "same words here and there now", "b"), (6, "same words here and there now", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in ("_again", "_row", "_k", "_b", "n", "score", "size", "taken", "copies", "position", "target", "weight", "first", "a.b")})
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        kept = Counter((r.doc_id, r.text) for r in got.collect())
        assert set(kept) <= {(a, b) for a, b, _ in rows}, name
        if name == "toxicity":
            assert sum(kept.values()) == len(rows)
        if name == "near_duplicates":
            assert kept == Counter([(1, None), (2, ""), (None, "x y"), (3, long), (5, "same words here and there now")])
    pieces = corpus_pipeline.STAGES[3][1](spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, 6, None} and max(r.length for r in pieces) == 2048
