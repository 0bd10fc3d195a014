"""Sharding by a hierarchical weighted hash tree, in DataFrame functions alone.

Regions hold racks, racks hold slots, and a slot holds a shard or none yet. Every slot has a capacity, its shard a weight
of at most that. A row's calls on a region come one after another, at intervals of -ln(u) / capacity with u from a hash of
the row's key, the region and the call's number; the region that is first called on wins, so regions win in proportion to
their capacity. A call goes down the region: a draw among racks by their capacities, then a draw among the rack's slots. It is taken
with probability weight / capacity; where the slot is empty, or the shard too light, the row's next call counts. A row
belongs to the shard that takes its first call.

So shards win in proportion to their weights, and no call depends on what other slots hold: more weight in a slot takes
calls that come before the ones that rows had, and moves rows into it alone; less weight moves rows out of it alone. A region that is
built later adds calls and changes none. Capacities are what draws weigh by: where slots are added to a full rack, rows move
into its region, and inside the region into that rack, and nowhere else.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import cumulate, hash_digits

Segment = dict[str, dict[str, dict[int, float]]]

#: A region of which calls are refused is called so often that all are refused with a chance of exp(-UNLIKELY).
UNLIKELY = 40


@dataclass(frozen=True)
class Topology:
    """Segments of regions, racks and shards with weights: the first was built at once, later ones were added. `frame` has
    the slots of the same places with their capacities, empty ones too; without it every shard's slot is as great as its weight."""

    segments: tuple[Segment, ...]
    frame: Segment | None = None

    def shards(self) -> list[int]:
        return [s for seg in self.segments for racks in seg.values() for shards in racks.values() for s in shards]

    def grown(self, region: str, rack: str, shard: int, weight: float = 1.0) -> Topology:
        """The topology with one more shard: in its slot of the frame, or in a segment of its own."""
        if shard in self.shards():
            raise ValueError(f"shard {shard} is there already")
        if self.frame is not None and shard not in self.frame.get(region, {}).get(rack, {}):
            raise ValueError(f"the frame has no slot for shard {shard}")
        return Topology((*self.segments, {region: {rack: {shard: weight}}}), self.frame)

    def regions(self) -> list[Region]:
        """The regions with any weight."""
        weights = {s: w for seg in self.segments for racks in seg.values() for shards in racks.values() for s, w in shards.items()}
        built = [(f"{k}/", seg) for k, seg in enumerate(self.segments)] if self.frame is None else [("", self.frame)]
        out = []
        for prefix, seg in built:
            for region, racks in seg.items():
                listed = []
                for rack, slots in racks.items():
                    path = f"{prefix}{region}/{rack}"
                    alive = [(f"{path}/{s}", float(c), float(weights.get(s, 0.0)), s) for s, c in slots.items() if c > 0]
                    if any(w > c for _, c, w, _ in alive):
                        raise ValueError(f"a shard of {path} weighs more than its slot")
                    listed += [(path, math.fsum(c for _, c, _, _ in alive), alive)] if alive else []
                out.append(Region(prefix + region, listed))
        return [r for r in out if r.weight > 0]


@dataclass(frozen=True)
class Region:
    path: str
    racks: list[tuple[str, float, list[tuple[str, float, float, int]]]]

    @property
    def capacity(self) -> float:
        return math.fsum(c for _, c, _ in self.racks)

    @property
    def weight(self) -> float:
        return math.fsum(w for *_, slots in self.racks for _, _, w, _ in slots)

    @property
    def full(self) -> bool:
        return all(w == c for *_, slots in self.racks for _, c, w, _ in slots)

    def column(self) -> Column:
        """The region as a constant: struct(p, w, racks array<struct(p, w, slots array<struct(p, w, share, shard)>)>)."""
        slot = lambda p, c, w, s: F.struct(F.lit(p).alias("p"), F.lit(c).alias("w"), F.lit(w / c).alias("share"), F.lit(s).alias("shard"))
        racks = [F.struct(F.lit(p).alias("p"), F.lit(c).alias("w"), F.array(*[slot(*s) for s in slots]).alias("slots")) for p, c, slots in self.racks]
        return F.struct(F.lit(self.path).alias("p"), F.lit(self.capacity).alias("w"), F.array(*racks).alias("racks"))


def regular(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> Topology:
    """Shards 0 to shards - 1 of weight 1, filled rack by rack and region by region."""
    tree: Segment = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"r{rack // racks_per_region}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    return Topology((tree,))


#: Slots of the first region of `counted`, and of each of its racks.
FIRST_REGION, FIRST_RACK = 4, 2


def counted(shards: int) -> Topology:
    """Shards 0 to shards - 1 of weight 1 in the one frame that all counts share: the first region has four slots, every
    later one as many as all before it, in racks of about the square root of that. Counts take the regions they reach into.
    So a call is refused with a chance of less than a half at any count."""
    frame: Segment = {}
    start, size = 0, FIRST_REGION
    while start < max(1, shards):
        per_rack = max(FIRST_RACK, math.isqrt(size))
        racks: dict[str, dict[int, float]] = {}
        for k in range(size):
            racks.setdefault(f"k{k // per_rack}", {})[start + k] = 1.0
        frame[f"r{len(frame)}"] = racks
        start, size = start + size, start + size
    present = {r: {k: {s: c for s, c in slots.items() if s < shards} for k, slots in racks.items()} for r, racks in frame.items()}
    return Topology((present,), frame)


def uniform(key: Column, path: Column) -> Column:
    """A number between 0 and 1 from 52 bits of a hash of key and path."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), path).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def draw(key: Column, path: Column, weight: Column) -> Column:
    """An exponential draw with rate `weight`."""
    return -F.ln(uniform(key, path)) / weight


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _least(key: Column, entries: Column, call: Column) -> Column:
    """The entry with the smallest draw."""
    return F.array_min(F.transform(entries, lambda e: F.struct(draw(key, F.concat(e["p"], F.lit("#"), call), e["w"]).alias("d"), e.alias("e"))))["e"]


def _slot(key: Column, region: Column, call: Column) -> Column:
    """The slot that a call on a region comes down to."""
    return _least(key, _least(key, region["racks"], call)["slots"], call)


def _first_taken(key: Column, region: Region, before: Column) -> Column:
    """struct(t, shard) of the first call on a region that is taken, if it comes before a time; else shard is null."""
    calls = math.ceil(UNLIKELY * region.capacity / region.weight)
    whole, none = region.column(), F.lit(None).cast("int")

    def step(acc: Column, k: Column) -> Column:
        call = k.cast("string")
        at = acc["t"] + draw(key, F.concat(F.lit(region.path + "#"), call), F.lit(region.capacity))
        taken = lambda s: F.when(uniform(key, F.concat(s["p"], F.lit("#"), call, F.lit("?"))) < s["share"], s["shard"])
        next_state = lambda t: F.when(t >= before, F.struct(t.alias("t"), none.alias("shard"), F.lit(False).alias("on"))).otherwise(
            _with(_with(_slot(key, whole, call), taken), lambda s: F.struct(t.alias("t"), s.alias("shard"), s.isNull().alias("on")))
        )
        return F.when(acc["on"], _with(at, next_state)).otherwise(acc)

    start = F.struct(F.lit(0.0).alias("t"), none.alias("shard"), F.lit(True).alias("on"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(calls - 1)), start, step)


def assign(df: DataFrame, key: Column, topology: Topology, out: str) -> DataFrame:
    """Adds `out`, the shard of each row. Slots of capacity 0 and shards of weight 0 get nothing; a topology without weight is an error.

    Of full regions the first call is always taken, so only the region that is called on first is gone down."""
    regions = topology.regions()
    if not regions:
        raise ValueError("the topology has no weight")
    at, k = f"_{out}_at", F.col(f"_{out}_key")
    df = df.withColumn(f"_{out}_key", key)
    full, open_ = [r for r in regions if r.full], [r for r in regions if not r.full]
    first, columns = F.lit("0"), [f"_{out}_key"]
    best = F.lit(float("inf"))
    if full:
        listed = F.array(*[r.column() for r in full])
        entries = F.transform(listed, lambda r: F.struct(draw(k, F.concat(r["p"], F.lit("#"), first), r["w"]).alias("t"), r.alias("r")))
        df = df.withColumn(at, F.array_min(entries))
        best, columns = F.col(f"{at}.t"), [*columns, at]
    for n, region in enumerate(open_):
        df = df.withColumn(f"{at}{n}", _first_taken(k, region, best))
        columns.append(f"{at}{n}")
        best = F.when(F.col(f"{at}{n}.shard").isNotNull(), F.col(f"{at}{n}.t")).otherwise(best)
    last = _slot(k, F.col(f"{at}.r"), first)["shard"] if full else F.lit(next(s for _, _, slots in regions[0].racks for _, _, w, s in slots if w > 0))
    taken = [F.col(f"{at}{n}.shard") for n in reversed(range(len(open_)))]
    return df.withColumn(out, F.coalesce(*taken, last).cast("int")).drop(*columns)


def op1_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents dealt to `shards` shards by doc_id; law `key`.

    Null texts: size 1, CRC of the empty text. A null doc_id is a key of its own; equal doc_ids share a shard. Slots
    number a shard's rows from 0 in the order of a hash of doc_id; rows that are equal throughout take any order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    dealt = assign(assign(docs, key, counted(shards), "shard"), key, counted(shards + 1), "grown_shard")
    mark = F.md5(key.cast("binary"))
    numbered = cumulate(dealt.withColumn("_m", mark), ["shard"], F.substring("_m", 1, hash_digits(spark)), [F.col("_m"), F.col("doc_id"), F.col("size"), F.col("text_crc32")], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


_U = "((('0x' || substr(md5({0}), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496)"
_E = "(-ln(" + _U + ") / {1})"


def _min(alias: str, source: str, path: str, by: str, pick: str, weight: str) -> str:
    return f"{alias} AS MATERIALIZED (SELECT {by}, arg_min({pick}, {_E.format(path, weight)}) AS {pick} FROM {source} GROUP BY {by})"


#: Eight shards fill two regions of two racks of two slots; the ninth is the first of eight slots of a third, in four racks of two.
OP1_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, coalesce(text, '') AS text FROM documents),
keys AS MATERIALIZED (SELECT DISTINCT key FROM d),
slots AS (SELECT s::INTEGER AS shard, CASE WHEN s < 4 THEN 'r0' WHEN s < 8 THEN 'r1' ELSE 'r2' END AS region, 'k' || ((s % 4) // 2 + CASE WHEN s >= 12 THEN 2 ELSE 0 END) AS rack FROM range(16) t(s)),
t AS (SELECT key, region, {_E.format("key || '|' || region || '#0'", "4.0::DOUBLE")} AS t FROM keys, (VALUES ('r0'), ('r1')) v(region)),
b AS MATERIALIZED (SELECT key, arg_min(region, t) AS region, min(t) AS t, '0' AS call FROM t GROUP BY key),
a AS (SELECT key, k::VARCHAR AS call, {_E.format("key || '|r2#' || k", "8.0::DOUBLE")} AS gap, k FROM keys, range(320) r(k)),
c AS (SELECT key, call, k, sum(gap) OVER (PARTITION BY key ORDER BY k ROWS UNBOUNDED PRECEDING) AS at FROM a),
calls AS MATERIALIZED (SELECT key, region, call, 0 AS k FROM b UNION ALL SELECT c.key, 'r2', c.call, c.k FROM c JOIN b USING (key) WHERE c.at < b.t),
{_min('r', "(SELECT DISTINCT key, region, call, rack FROM calls JOIN slots USING (region))", "key || '|' || region || '/' || rack || '#' || call", "key, region, call", "rack", "2.0::DOUBLE")},
{_min('s', "(SELECT key, region, call, rack, shard FROM r JOIN slots USING (region, rack))", "key || '|' || region || '/' || rack || '/' || shard || '#' || call", "key, region, call", "shard", "1.0::DOUBLE")},
dealt AS (SELECT key, max(shard) FILTER (region <> 'r2') AS shard, coalesce(max(8) FILTER (region = 'r2' AND shard = 8), max(shard) FILTER (region <> 'r2'))::INTEGER AS grown_shard FROM s GROUP BY key),
crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
x AS (SELECT n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM d, crc)
SELECT doc_id, (octet_length(encode(text)) + 1)::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(key), doc_id, octet_length(encode(text)), text_crc32) - 1 AS slot, grown_shard
FROM d JOIN x USING (n) JOIN dealt USING (key)
"""
