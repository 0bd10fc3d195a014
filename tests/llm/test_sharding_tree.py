"""The levels of the sharding tree: shares, and where rows move when weights or capacities change."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from pagewright.llm import sharding

#: Two regions, of three and of two racks; some slots are empty, some shards lighter than their slots.
FRAME = {"a": {"x": {0: 1.0, 1: 2.0}, "y": {2: 1.0, 3: 1.0, 4: 1.0}, "z": {5: 2.0}}, "b": {"x": {6: 1.0, 7: 1.0}, "w": {8: 3.0, 9: 1.0}}}
BASE = {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.5, 5: 2.0, 6: 1.0, 8: 1.5}


def tree(weights, frame=FRAME):
    return sharding.Topology(({r: {k: {s: weights[s] for s in slots if s in weights} for k, slots in racks.items()} for r, racks in frame.items()},), frame)


def dealt(spark, n, *topologies):
    d = spark.range(n)
    for k, t in enumerate(topologies):
        d = sharding.assign(d, F.col("id").cast("string"), t, f"s{k}")
    return [tuple(r)[1:] for r in d.collect()]


def by_hand(key, regions):
    """The shard of a key, call by call."""
    u = lambda path: (int(hashlib.md5(f"{key}|{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    e = lambda path, w: -math.log(u(path)) / w
    best = (math.inf, None)
    for region in regions:
        t = 0.0
        for call in range(1000):
            t += e(f"{region.path}#{call}", region.capacity)
            if t >= best[0]:
                break
            rack = min(region.racks, key=lambda r: e(f"{r[0]}#{call}", r[1]))
            path, c, w, shard = min(rack[2], key=lambda s: e(f"{s[0]}#{call}", s[1]))
            if u(f"{path}#{call}?") < w / c:
                best = (t, shard)
                break
    return best[1]


def test_rows_go_where_their_first_taken_call_leads(spark):
    for t in (tree(BASE), sharding.counted(5), sharding.counted(13), sharding.regular(7)):
        regions = t.regions()
        got = sharding.assign(spark.range(400), F.col("id").cast("string"), t, "s").collect()
        assert all(r.s == by_hand(str(r.id), regions) for r in got)


def test_shares_follow_weights(spark):
    n = 8000
    share = Counter(s for (s,) in dealt(spark, n, tree(BASE)))
    total = sum(BASE.values())
    assert share.keys() == BASE.keys()
    assert all(abs(share[s] / n - w / total) < 5 * math.sqrt(w / total / n) for s, w in BASE.items())


def test_a_weight_moves_rows_of_its_own_shard_alone(spark):
    heavier, lighter, filled = tree(BASE | {3: 1.0}), tree(BASE | {8: 0.5}), tree(BASE | {9: 1.0})
    moved = dealt(spark, 4000, tree(BASE), heavier, lighter, filled)
    assert all(b == a or b == 3 for a, b, _, _ in moved) and any(a != b for a, b, _, _ in moved)
    assert all(c == a or a == 8 for a, _, c, _ in moved) and any(a != c for a, _, c, _ in moved)
    assert all(d == a or d == 9 for a, _, _, d in moved) and any(a != d for a, _, _, d in moved)


def test_a_rack_that_grows_takes_rows_into_its_subtree(spark):
    """Rows of the other region stay or come into this one; rows of this one stay or go into the rack."""
    frame = FRAME | {"a": FRAME["a"] | {"z": {5: 2.0, 10: 2.0}}}
    whole = {s: c for racks in frame.values() for slots in racks.values() for s, c in slots.items()}
    before = {s: c for s, c in whole.items() if s != 10}
    moved = [(a, b) for a, b in dealt(spark, 4000, tree(before), tree(whole, frame)) if a != b]
    assert all(b in (0, 1, 2, 3, 4, 5, 10) if a >= 6 else b in (5, 10) for a, b in moved) and sum(b == 10 for _, b in moved) > 300


def test_all_levels_of_counts_have_several_children():
    for n in (8, 9, 16, 40, 200):
        regions = sharding.counted(n).regions()
        assert len(regions) > 1 and all(len(r.racks) > 1 and all(len(slots) > 1 for *_, slots in r.racks) for r in regions)
        assert sum(r.weight for r in regions) == n > sum(r.capacity for r in regions) / 2
    sizes = [len(slots) for r in sharding.counted(200).regions() for *_, slots in r.racks]
    assert max(sizes) <= 12


def test_one_more_shard_takes_rows_only_into_itself_at_every_count(spark):
    counts = [1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17]
    rows = dealt(spark, 600, *[sharding.counted(n) for c in counts for n in (c, c + 1)])
    for r in rows:
        assert all(r[2 * k + 1] in (r[2 * k], c) for k, c in enumerate(counts))
