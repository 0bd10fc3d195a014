"""Exact Jaccard join of shingle sets, by relations between sets.

Sets that could link share one of their rarest shingles (prefix filter: a set of n shingles with a partner of Jaccard t
or more shares with it one of its n - ceil(t n) + 1 first shingles in any order common to all; rare ones stand first
here). Sets that meet in a list of such a shingle, fit in size and have profiles that don't rule a link out, fall into
one cluster; links never leave a cluster. (A profile counts a set's shingles by parts of their hashes; the sum of the
differences of two profiles is at most the number of shingles that only one of the sets has.) A cluster's sets go to one task, where inverted lists in order of position are searched only
within the positions whose sizes fit (the rest of a list is skipped by binary search), and where the overlaps of a set
with all others are derived from those of a highly similar set computed before: minus the lists of shingles it lacks,
plus the lists of shingles it has besides. Large clusters are cut into blocks in order of size, and every pair of blocks
whose sizes fit is a task of its own. A task returns a spanning forest of the links, never the pairs.

Shingles are known by 64-bit hashes of their words, sets by a 64-bit hash of theirs together with their size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import cumulate, cut, join_dealt, text_slices

U = np.uint64
_RNG = np.random.default_rng(7)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_MIX = (U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(33))

#: Counters of the frequency sketch that orders shingles: one for some 512 bytes of texts, 2^20 to 2^24 of four bytes.
SKETCH_BITS, SKETCH_ROWS = (20, 24), 256
#: A list of a shingle whose counter is so far above the usual is dealt to several tasks.
HOT_LIST = 100_000
#: A block of a large cluster has so many shingles, counting SET_COST for each set besides.
BLOCK_SHINGLES, SET_COST = 2_000_000, 1_000
#: Parts of a set's profile: how many of its shingles fall in each, at most 255.
PARTS = 256
#: Entries of a list that are compared by their profiles; in longer lists all that fit in size fall into one cluster.
MOST_COMPARED = 2_000
#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    a, b, s = _MIX
    x = (x ^ (x >> s)) * a
    x = (x ^ (x >> s)) * b
    return x ^ (x >> s)


class Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 21)
            cls.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE, np.uint64)]))
            cls.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)]))
        return cls.up, cls.down


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[bounds[k]:bounds[k + 1]] (A-Z as a-z), and the bounds of each text among them."""
    n = len(data)
    low = _LOWER[data]
    word = ~_SPACE[low]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = Powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[low] * up[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes; with fewer words, one for the whole sequence; none without words."""
    words, at = word_hashes(data, bounds)
    g = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        g = g * U(0xD6E8FEB86659FD93) + words[j : j + len(g)]
    g = mixed(g)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = h * U(0xA0761D6478BD642F) + w
            out.append(mixed(h + U(b - a)))
        else:
            out.append(g[:0])
    return out


def set_id(s: np.ndarray) -> int:
    return int(mixed((s.sum(dtype=np.uint64) ^ mixed(mixed(s ^ U(_BASE)).sum(dtype=np.uint64, keepdims=True) + U(len(s)))))[0].astype(np.int64))


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many sets have a shingle of each counter, over all documents. Tasks send their non-zero counters."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], size.bit_length() - 9))
    width = (1 << bits) // SKETCH_ROWS

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for t in tables:
            for _, data, bounds in text_slices(t.column("text")):
                for s in shingle_sets(data, bounds, k):
                    total[(s >> U(64 - bits)).astype(np.int64)] += 1  # distinct within a set but for shared counters
        rows, raws = [], []
        for r, part in enumerate(total.reshape(SKETCH_ROWS, width)):
            on = np.flatnonzero(part)
            if len(on):
                rows.append(r)
                raws.append(zlib.compress(on.astype("<u2").tobytes() + part[on].astype("<u4").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(raws, pa.binary())], ["r", "raw"])

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for t in tables:
            for r, raw in zip(t.column("r").to_pylist(), t.column("raw").to_pylist(), strict=True):
                raw = zlib.decompress(raw)
                n = len(raw) // 6
                total.setdefault(r, np.zeros(width, np.int64))[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<u4", n, 2 * n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["r", "raw"])

    assert width <= 1 << 16
    parts = docs.select("text").mapInArrow(count, "r int, raw binary").repartition(SKETCH_ROWS, "r").mapInArrow(add, "r int, raw binary")
    out = np.zeros((SKETCH_ROWS, width), np.int64)
    for row in parts.collect():  # SKETCH_ROWS rows, 8 bytes a counter
        out[row["r"]] = np.frombuffer(row["raw"], np.int64)
    return np.minimum(out.ravel(), (1 << 32) - 1).astype(np.uint32)


def _signed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, hash of the text, n, sid and the prefix of every document: shingles and, for each, twice its salt, plus 1 beyond the index prefix.

    Of two sets that link, the smaller has a shingle in its index prefix (its first n - ceil(2 t n / (1 + t)) + 1) that
    the larger has in its whole prefix."""
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(docs, k))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        usual, bits = 2 * int(counts.mean()), len(counts).bit_length() - 1
        for t in tables:
            sizes, sids, prefixes, salts, profiles = [], [], [], [], []
            for _, data, bounds in text_slices(t.column("text")):
                for s in shingle_sets(data, bounds, k):
                    n = len(s)
                    sid = set_id(s) if n else 0
                    often = counts[(s >> U(64 - bits)).astype(np.int64)]
                    first = np.argsort(often, kind="stable")[: n - -(-percent * n // 100) + 1 if n else 0]
                    prefixes.append(s[first].view(np.int64))
                    probe = np.arange(len(first)) > n - -(-2 * percent * n // (100 + percent))
                    salts.append(2 * ((sid & 0x7FFFFFFF) % (np.maximum(0, often[first].astype(np.int64) - usual) // HOT_LIST + 1)) + probe)
                    sizes.append(n)
                    sids.append(sid)
                    profiles.append(np.minimum(255, np.bincount((s & U(PARTS - 1)).astype(np.int64), minlength=PARTS)).astype(np.uint8).tobytes())
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x) if x else np.zeros(0), kind)) for x, kind in ((prefixes, pa.int64()), ([y.astype(np.int32) for y in salts], pa.int32()))]
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("tid"), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(profiles, pa.binary()), *lists], ["doc_id", "tid", "n", "sid", "profile", "prefix", "salts"])

    return docs.select("doc_id", F.xxhash64("text").alias("tid"), "text").mapInArrow(run, "doc_id long, tid long, n long, sid long, profile binary, prefix array<long>, salts array<int>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b), root being the smallest node of its component.

    Large-star and small-star steps in turn: all edges of a node go to its smallest neighbour, until nothing changes."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    while True:
        new_state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new_state == state or not new_state[0]:
            return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(now.select("b", "b").distinct())
        state = new_state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        now = cut(small.filter("a <> b").distinct(), "edges")


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 |A & B| >= percent |A | B|; sets in ascending order of size, all distinct and none empty."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(count), sizes)
    index = np.sort(flat * count + owner)  # lists one after the other, each in order of position
    position = index % count
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    own = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    block = 64
    first = np.searchsorted(100 * sizes, percent * sizes, "left") // block * block
    last = np.minimum(count, -(-np.searchsorted(percent * sizes, 100 * sizes, "right") // block) * block)

    def lists(tokens: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How often each position in [lo, hi) occurs in the lists of these shingles."""
        a, b = np.searchsorted(index, tokens * count + lo), np.searchsorted(index, tokens * count + hi)
        n = b - a
        total = int(n.sum())
        at = np.arange(total) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if total else np.zeros(0, np.int64)
        return np.bincount(position[at] - lo, minlength=hi - lo)

    label = np.arange(count)
    edges: list[tuple[int, int]] = []
    leaders: list[tuple[int, int, int, np.ndarray]] = []
    for s in range(count):
        lo, hi = int(first[s]), int(last[s])
        near = [(int(sizes[s] + sizes[r] - 2 * c[s - a]), r, a, c) for r, a, b, c in leaders if a <= lo and hi <= b]
        apart, r, a, c = min(near, key=lambda x: x[0], default=(1 << 60, 0, 0, None))
        if 2 * apart < sizes[s]:
            plus, minus = np.setdiff1d(own[s], own[r], assume_unique=True), np.setdiff1d(own[r], own[s], assume_unique=True)
            overlap = c[lo - a : hi - a] + lists(plus, lo, hi) - lists(minus, lo, hi)
        else:
            overlap = lists(own[s], lo, hi)
            leaders = [*leaders[-3:], (s, lo, hi, overlap)]
        links = np.flatnonzero((100 + percent) * overlap >= percent * (sizes[s] + sizes[lo:hi])) + lo
        roots, where = np.unique(label[links], return_index=True)
        if len(roots) > 1:
            for x, j in zip(roots.tolist(), links[where].tolist(), strict=True):
                if x != label[s]:
                    edges.append((s, j))
            label[np.isin(label, roots)] = roots[0]
    return edges


def _tasks(members: DataFrame, percent: int) -> tuple[DataFrame, bool]:
    """(sid, n, cluster) to (sid, n, task): one task a cluster, or one for each pair of blocks that fit; whether any cluster was cut."""
    cost = members.groupBy("cluster").agg(F.sum(F.col("n") + SET_COST).alias("cost"))
    large = cost.filter(F.col("cost") > BLOCK_SHINGLES).select("cluster")
    hot = bool(large.take(1))
    if not hot:
        return members.withColumn("task", F.xxhash64("cluster")), False
    rest = members.join(large, "cluster", "left_anti").withColumn("task", F.xxhash64("cluster"))
    size_class = F.floor(F.ln("n") * 10).cast("int")
    ranked = cumulate(members.join(large, "cluster", "left_semi"), ["cluster"], size_class, [F.col("n"), F.col("sid")], "_c", F.col("n") + SET_COST)
    ranked = cut(ranked.withColumn("block", F.floor(F.col("_c") / BLOCK_SHINGLES).cast("int")).drop("_c"), "blocks")
    blocks = ranked.groupBy("cluster", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = blocks.select("cluster", F.col("block").alias("block2"), F.col("lo").alias("lo2"))
    pairs = blocks.join(other, "cluster").filter((F.col("block2") >= F.col("block")) & (100 * F.col("hi") >= percent * F.col("lo2")))
    pairs = pairs.withColumn("task", F.xxhash64("cluster", "block", "block2"))
    each = pairs.select("cluster", "task", F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    cut_up = ranked.join(each, ["cluster", "block"]).select("sid", "n", "cluster", "task")
    return rest.select("sid", "n", "cluster", "task").unionByName(cut_up), True


def _rooted(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): doc_id, tid (hash of the text), n and sid of each row; and for each set sid, n, first
    (the least doc_id and tid of its rows; null if none has a doc_id) and root, equal for the sets of a component."""
    signed = cut(_signed(docs, k, percent), "signed")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tid"))).alias("first")
    sets = signed.filter("n > 0").groupBy("sid", "n").agg(first, F.any_value("prefix").alias("prefix"), F.any_value("salts").alias("salts"), F.any_value("profile").alias("profile"))
    lists = sets.select("sid", "n", F.explode(F.arrays_zip("prefix", "salts")).alias("p"))
    lists = lists.select("sid", F.col("n").cast("int").alias("n"), F.col("p.prefix").alias("shingle"), F.shiftright("p.salts", 1).alias("salt"), F.col("p.salts").bitwiseAND(F.lit(1)).alias("probe"))
    # in order of size a set meets the sets before it that hold the shingle in their index prefix, if the last of them fits
    order = Window.partitionBy("shingle", "salt").orderBy("n", "probe", "sid")
    index = F.col("probe") == 0
    last = F.last(F.when(index, F.col("n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    lists = lists.withColumn("_fits", F.coalesce(100 * last.cast("long") >= percent * F.col("n").cast("long"), F.lit(False)))
    lists = lists.withColumn("_run", F.sum((index & ~F.col("_fits")).cast("int")).over(order)).filter(index | F.col("_fits") | (F.col("salt") > 0))
    of_run = Window.partitionBy("shingle", "salt", "_run")
    first = F.first(F.when(index, F.col("sid")), ignorenulls=True).over(of_run.orderBy("n", "probe", "sid"))
    lists = lists.withColumns({"leader": F.coalesce(first, F.col("sid")), "_size": F.count("*").over(of_run)})
    met = cut(lists.filter((F.col("_size") > 1) | (F.col("salt") > 0)).select("shingle", "salt", F.col("_run").alias("run"), "n", "probe", "sid", "leader"), "met")
    shown = met.filter("salt = 0").join(sets.select("sid", "profile"), "sid").repartition("shingle", "run").sortWithinPartitions("shingle", "run", "n", "probe", "sid")
    edges = shown.select("shingle", "run", "n", "probe", "sid", "profile").mapInArrow(_near(percent), "a long, b long")
    # very frequent shingles: all parts of a list are one cluster
    if met.filter("salt > 0").take(1):
        salted = met.filter("salt > 0").groupBy("shingle").agg(F.min("leader").alias("b"))
        all_of_it = sets.select("sid", F.explode("prefix").alias("shingle")).join(salted, "shingle").select(F.col("sid").alias("a"), "b")
        edges = edges.unionByName(all_of_it)
    clusters = components(edges)
    members = cut(sets.select("sid", "n", F.col("first.doc_id").alias("first_doc")).join(clusters.select(F.col("node").alias("sid"), F.col("root").alias("cluster")), "sid"), "members")
    dealt, hot = _tasks(members.select("sid", "n", "cluster"), percent)
    wanted = members.select(F.coalesce("first_doc", F.lit(-(1 << 62))).alias("_w")).distinct()
    source = docs.withColumn("_w", F.coalesce("doc_id", F.lit(-(1 << 62))))
    source = source.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "_w", "left_semi")
    contents = source.select("text").mapInArrow(_contents(k), "sid long, n long, shingles binary")
    few = members.count() <= BROADCAST_IDS and not hot
    joined = contents.join(F.broadcast(dealt) if few else dealt, ["sid", "n"])
    links = joined.repartition("task").sortWithinPartitions("task", "n", "sid").mapInArrow(_links(percent), "a long, b long")
    links = cut(links, "links")
    roots = components(links) if hot else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = sets.select("sid", "n", "first").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    return signed.select("doc_id", "tid", "n", "sid"), cut(named, "named")


def ngram_join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each of documents (doc_id, text, ...).

    component_id is the smallest doc_id of the component of links; documents without words (or with null text) link with
    nothing and keep their own doc_id. Equal sets link. Null doc_ids are ignored where another of the component is
    there. No documents: no rows. Extra columns are not read."""
    signed, named = _rooted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent)
    least = named.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    of_set = named.join(least, "root").select("sid", "n", "component_id")
    linked = join_dealt(signed.filter("n > 0"), of_set, ["sid", "n"], [F.col("doc_id"), F.col("tid")])
    out = linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, but for those whose component has an earlier one, by doc_id and, where
    doc_ids repeat, by a hash of the text.

    Of rows that repeat a doc_id with the same text one stays. Rows without words stay (once each for id and text); all
    rows without doc_id stay."""
    signed, named = _rooted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent)
    least = named.groupBy("root").agg(F.min("first").alias("first")).filter("first IS NOT NULL").select("first.doc_id", "first.tid")
    least = least.unionByName(signed.filter("n = 0 AND doc_id IS NOT NULL").select("doc_id", "tid")).distinct()
    own = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("doc_id").cast("long").alias("_i"), F.xxhash64("text").alias("_t"))
    kept = row.filter(F.col("_i").isNotNull()).join(least.select(F.col("doc_id").alias("_i"), F.col("tid").alias("_t")), ["_i", "_t"], "left_semi")
    # the semi-join has dealt rows by id and text: repeated ones meet without another shuffle
    again = F.row_number().over(Window.partitionBy("_i", "_t").orderBy(F.lit(0)))
    once = kept.withColumn("_again", again).filter("_again = 1")
    return once.unionByName(row.filter(F.col("_i").isNull()).withColumn("_again", F.lit(1))).select("_row.*")


def _near(percent: int):
    """From lists, entry by entry in order of size, to a spanning forest of the pairs that sizes and profiles leave possible."""

    def compare(n: np.ndarray, probe: np.ndarray, sid: np.ndarray, profile: np.ndarray) -> list[tuple[int, int]]:
        m = len(n)
        if m > MOST_COMPARED:
            return [(int(x), int(sid[0])) for x in sid[1:]]
        label, out = np.arange(m), []
        ends = np.searchsorted(percent * n, 100 * n, "right")
        for i in np.flatnonzero(probe == 0).tolist():
            others = np.arange(i + 1, ends[i])
            others = others[label[others] != label[i]]
            if not len(others):
                continue
            apart = np.abs(profile[others] - profile[i]).sum(1)
            for j in others[(100 + percent) * apart <= (100 - percent) * (n[others] + n[i])].tolist():
                if label[j] != label[i]:
                    out.append((int(sid[j]), int(sid[i])))
                    label[label == label[j]] = label[i]
        return out

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for t in tables:
            some = pa.Table.from_batches([t]) if held is None else pa.concat_tables([held, pa.Table.from_batches([t])])
            key = [some.column(c).to_numpy() for c in ("shingle", "run")]
            cuts = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            held = some.slice(done)  # the last list may go on
            if done:
                yield compared(some.slice(0, done), [0, *cuts.tolist()])
        if held is not None and len(held):
            yield compared(held, [0, len(held)])

    def compared(some: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        n, probe, sid = (some.column(c).to_numpy().astype(np.int64) for c in ("n", "probe", "sid"))
        profile = np.frombuffer(b"".join(some.column("profile").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16)
        out = [e for a, b in zip(bounds[:-1], bounds[1:], strict=True) for e in compare(n[a:b], probe[a:b], sid[a:b], profile[a:b])]
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])

    return run


def _contents(k: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            for _, data, bounds in text_slices(t.column("text")):
                sets = [s for s in shingle_sets(data, bounds, k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "n", "shingles"])

    return run


def _links(percent: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sids, sets = None, [], []

        def close() -> pa.RecordBatch:
            root = list(range(len(sids)))
            edges = forest(sets, percent) if len(sids) > 1 else []

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in edges:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
            least: dict[int, int] = {}
            linked = {x for e in edges for x in e}
            for x in linked:
                r = find(x)
                least[r] = min(least.get(r, sids[x]), sids[x])
            out = [(sids[x], least[find(x)]) for x in linked]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

        for t in tables:
            for at, sid, raw in zip(t.column("task").to_pylist(), t.column("sid").to_pylist(), t.column("shingles").to_pylist(), strict=True):
                if at != task:
                    if task is not None:
                        yield close()
                    task, sids, sets = at, [], []
                if sids and sids[-1] == sid:  # a repeated row
                    continue
                sids.append(sid)
                sets.append(np.frombuffer(raw, np.uint64))
        if task is not None:
            yield close()

    return run


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: 3-word shingles, Jaccard 0.9 or more.

    Null and empty texts and texts without words have no shingles and are linked with nothing; shorter texts than 3 words are
    one shingle. A null or repeated doc_id, repeated rows, very long texts: see `ngram_join`. No documents: no rows."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)
