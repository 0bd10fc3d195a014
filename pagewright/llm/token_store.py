"""Content-addressed store of token ids.

Layout of a store, all Parquet:
  data/kind=chunk    hash, n_ids, payload: every distinct chunk once; payload holds the ids as little-endian unsigned 16-bit
                     numbers, or 32-bit ones if an id needs it (payload length tells)
  data/kind=recipe   recipes as tasks made them, before they are put in order
  recipes            a document a row in ascending doc_id: start, n_tokens, chunk hashes in order, Merkle root of these
                     with the chunks' lengths, number of its part
  manifest           a row for each part: its first start, documents, tokens and the Merkle root over the hashes of its
                     recipes (doc_id, start, n_tokens, root) in order; under part -1 the sums and the Merkle root of the parts' rows

A rolling hash over the last WINDOW ids cuts an id stream where its top bits are 0, so the same passage gives the same
chunks wherever it stands. A chunk's address is BLAKE2b-128 of its ids as little-endian unsigned 32-bit numbers.
Reading checks each chunk against its address and length, each document's chunks against its root, that each document
starts where the one before ends, and all recipes against the manifest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import cumulate, cut, join_dealt, new_path
from pagewright.llm.tokens import default_vocabulary, encoder, with_end

WINDOW, CUT_BITS, LEAST, MOST = 16, 9, 64, 8192
#: Addresses that a task remembers to have sent (some 100 bytes each); beyond it some payloads are sent again.
KNOWN = 300_000
_BASE = 0x9E3779B1
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 32, 1 << 16, dtype=np.uint32) | np.uint32(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2^32, as far as asked for."""

    up = down = np.ones(1, np.uint32)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            one, size = np.ones(1, np.uint32), max(n, 1 << 20)
            cls.up = np.cumprod(np.concatenate([one, np.full(size, _BASE, np.uint32)]), dtype=np.uint32)
            cls.down = np.cumprod(np.concatenate([one, np.full(size, pow(_BASE, -1, 1 << 32), np.uint32)]), dtype=np.uint32)
        return cls.up, cls.down


def cut_points(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of chunks for each stream ids[bounds[k]:bounds[k + 1]] of unsigned 32-bit ids, relative to its start."""
    n, found = len(ids), []
    step = 1 << 18
    up, down = _Powers.get(step + WINDOW + 1)
    for first in range(0, n, step):  # in runs that a processor's cache holds
        some = ids[max(0, first - WINDOW + 1) : first + step]
        sums = np.zeros(len(some) + 1, np.uint32)
        values = _TABLE[some & np.uint32(0xFFFF)]
        values *= up[: len(some)]
        np.cumsum(values, dtype=np.uint32, out=sums[1:])
        rolled = sums[WINDOW:] - sums[: max(0, len(sums) - WINDOW)]
        rolled *= down[: len(rolled)]
        rolled ^= rolled >> np.uint32(15)
        rolled *= np.uint32(0x85EBCA6B)
        found.append(np.flatnonzero(rolled >> np.uint32(32 - CUT_BITS) == 0) + WINDOW + max(0, first - WINDOW + 1))
    marks = np.concatenate(found) if found else np.zeros(0, np.int64)
    lo = np.searchsorted(marks, bounds[:-1] + WINDOW)
    hi = np.searchsorted(marks, bounds[1:])
    out = []
    for a, b, s, e in zip(lo.tolist(), hi.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ends, last = [], s
        for m in [*marks[a:b].tolist(), e]:
            while m - last > MOST:
                last += MOST
                ends.append(last - s)
            if m == e or m - last >= LEAST:
                if m > last:
                    ends.append(m - s)
                    last = m
        out.append(ends)
    return out


def address(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _push(tree: list[tuple[int, bytes]], leaf: bytes) -> None:
    """Adds a leaf to a stack of (level, hash) whose levels fall; two of a level become one of the next."""
    level = 0
    while tree and tree[-1][0] == level:
        leaf, level = address(b"\1" + tree.pop()[1] + leaf), level + 1
    tree.append((level, leaf))


def _folded(tree: list[tuple[int, bytes]]) -> bytes:
    """The root over a stack: what is left without a partner is joined from the right."""
    root = tree[-1][1] if tree else address(b"")
    for _, h in reversed(tree[:-1]):
        root = address(b"\1" + h + root)
    return root


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves."""
    tree: list[tuple[int, bytes]] = []
    for x in leaves:
        _push(tree, address(b"\0" + x))
    return _folded(tree)


def _widen(payload: bytes, n: int) -> bytes:
    return np.frombuffer(payload, "<u2").astype("<u4").tobytes() if len(payload) == 2 * n else payload


#: Rows of a store as it is written: chunks (hash, n_ids, payload) and recipes (row, doc_id, n_tokens, hashes, root).
WRITTEN = "kind string, key long, hash binary, n_ids int, payload binary, row long, doc_id long, n_tokens long, hashes array<binary>, root binary"


def _encoded(vocabulary: str, end_id: int):
    """From texts to rows of WRITTEN: a recipe for each, and each chunk once for a task that doesn't forget it."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        sent: set[bytes] = set()
        for table in tables:
            for first, ids, bounds in tokens.encode(table.column("text")):
                ids, bounds = with_end(ids, bounds, end_id)
                found = cut_points(ids, bounds)
                counts = np.array([len(x) for x in found])
                row = np.repeat(np.arange(len(found)), counts)
                ends = np.fromiter(chain.from_iterable(found), np.int64, len(row)) + bounds[row]
                starts = np.concatenate([[0], ends[:-1]])
                wide = memoryview(ids.astype("<u4", copy=False)).cast("B")
                # payloads by their places in the run's bytes: Arrow would never free memoryviews handed to pa.array
                width = 2 if ids.max() < 1 << 16 else 4
                places = pa.py_buffer(width * np.append(starts, ends[-1]).astype(np.int64))
                payloads = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, places, pa.py_buffer(ids.astype(f"<u{width}", copy=False))])
                hashes, new = [], []
                for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    h = address(wide[4 * a : 4 * b])
                    hashes.append(h)
                    if h not in sent:
                        sent.add(h)
                        new.append(k)
                if len(sent) > KNOWN:
                    sent.clear()
                lengths = ends - starts
                sizes, last = lengths.tolist(), np.cumsum(counts)
                roots = [root_of(hashes[e - n : e], sizes[e - n : e]) for e, n in zip(last.tolist(), counts.tolist(), strict=True)]
                at = first + np.arange(len(found))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, last), pa.int32()), pa.array(hashes, pa.binary()))
                yield _written("recipe", len(found), row=table.column("row").take(pa.array(at)), doc_id=table.column("doc_id").take(pa.array(at)), n_tokens=pa.array(np.diff(bounds)), hashes=lists, root=pa.array(roots, pa.binary()), key=table.column("row").take(pa.array(at)))
                kept = [hashes[k] for k in new]
                yield _written("chunk", len(new), key=pa.array(np.frombuffer(b"".join(kept), "<i8")[::2]), hash=pa.array(kept, pa.binary()), n_ids=pa.array(lengths[new], pa.int32()), payload=payloads.take(pa.array(new, pa.int64())))
        tokens.rest()

    return run


def _written(kind: str, count: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"kind": pa.string(), "key": pa.int64(), "hash": pa.binary(), "n_ids": pa.int32(), "payload": pa.binary(), "row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "hashes": pa.list_(pa.binary()), "root": pa.binary()}
    columns["kind"] = pa.array([kind] * count)
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(count, t) for c, t in kinds.items()], list(kinds))


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Writes (doc_id, text) to a store at path.

    Chunks meet by address, once from each task at most, so a chunk that a third of the documents share makes no large
    group; recipes go with them, dealt out by row. Recipes are put in order by ranges of doc_id."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(_encoded(vocabulary or default_vocabulary(), end_id), WRITTEN)
    once = F.row_number().over(Window.partitionBy("key", "hash").orderBy("n_ids")) == 1
    kept = found.withColumn("_keep", once | (F.col("kind") == "recipe")).filter("_keep").drop("_keep", "key")
    kept.write.partitionBy("kind").option("compression", "snappy").parquet(f"{path}/data")  # ids hardly shrink
    rooted = _data(spark, path, "recipe").select("row", "doc_id", "n_tokens", "hashes", "root")
    order = ["doc_id", "root", "row"]
    slim = cut(rooted.select(*order, "n_tokens").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    placed = cumulate(slim, [], F.col("part"), [F.col("doc_id").asc_nulls_first(), F.col("root"), F.col("row")], "start", F.col("n_tokens"))
    full = rooted.join(placed.select("row", "part", "start"), "row").repartition("part").sortWithinPartitions("part", "start")
    full.select("part", "start", "doc_id", "n_tokens", "hashes", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _parts(_recipes(spark, path)).write.parquet(f"{path}/parts")
    rows = sorted(map(tuple, spark.read.schema(PART).parquet(f"{path}/parts").collect()))  # a row for each range
    spark.createDataFrame([*rows, _total(rows)], PART).coalesce(1).write.parquet(f"{path}/manifest")


#: A row of the manifest.
PART = "part int, first_start long, documents long, tokens long, root binary"


def _entry() -> Column:
    """The hash that stands for a document in its part."""
    told = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", F.hex("root"))
    return F.unhex(F.sha2(told.cast("binary"), 256))


def _total(rows: list[tuple]) -> tuple:
    """The manifest's row for the store, from those of its parts in order; raises if a part doesn't begin where those before it end."""
    at = 0
    for part, first, _, tokens, _ in rows:
        if first != at:
            raise ValueError(f"part {part} doesn't begin where the one before ends")
        at += tokens
    return (-1, 0, sum(r[2] for r in rows), at, merkle([address("|".join(map(str, r[:4])).encode() + r[4]) for r in rows]))


def _parts(recipes: DataFrame) -> DataFrame:
    """PART rows of recipes, each part folded in order of start with a stack of as many nodes as the tree has levels."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = None
        count = tokens = 0
        tree: list[tuple[int, bytes]] = []
        out = []

        def close() -> None:
            if part is not None:
                out.append((part, first, count, tokens, _folded(tree)))

        for t in tables:
            for p, start, n, entry in zip(*(t.column(c).to_pylist() for c in ("part", "start", "n_tokens", "entry")), strict=True):
                if p != part:
                    close()
                    part, first, count, tokens, tree = p, start, 0, 0, []
                if start != first + tokens:
                    raise ValueError(f"part {p}: a document doesn't start where the one before ends")
                _push(tree, address(b"\0" + entry))
                count, tokens = count + 1, tokens + n
        close()
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["part", "first_start", "documents", "tokens", "root"])

    return recipes.select("part", "start", "n_tokens", _entry().alias("entry")).repartition("part").sortWithinPartitions("part", "start").mapInArrow(run, PART)


def verify(spark: SparkSession, path: str) -> None:
    """Raises if the recipes of the store at path aren't those of its manifest. Rows of parts come to the driver."""
    told = sorted(map(tuple, spark.read.schema(PART).parquet(f"{path}/manifest").collect()))
    found = sorted(map(tuple, _parts(_recipes(spark, path)).collect()))
    if [_total(found), *found] != told:
        raise ValueError("the recipes don't match the manifest")


def _data(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(WRITTEN.replace("key long, ", "")).parquet(f"{path}/data").filter(F.col("kind") == kind)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, start long, doc_id long, n_tokens long, hashes array<binary>, root binary").parquet(f"{path}/recipes")


def root_of(hashes: list[bytes], lengths: list[int]) -> bytes:
    """The Merkle root of a document's chunks, their lengths included."""
    return merkle([h + n.to_bytes(4, "little") for h, n in zip(hashes, lengths, strict=True)])


def _roots(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in tables:
        lengths = t.column("lengths").to_pylist()
        roots = pa.array(list(map(root_of, t.column("hashes").to_pylist(), lengths)), pa.binary())
        yield pa.RecordBatch.from_arrays([*t.columns, pa.array(list(map(sum, lengths)), pa.int64()), roots], [*t.schema.names, "n_tokens", "root"])


def _wide(payloads: pa.Array, counts: np.ndarray) -> tuple[memoryview, list[int]]:
    """The ids of payloads as bytes of 32-bit numbers, one after the other, and the places where they end."""
    payloads = payloads.cast(pa.large_binary())
    offsets = np.frombuffer(payloads.buffers()[1], np.int64)[payloads.offset : payloads.offset + len(payloads) + 1]
    data = np.frombuffer(payloads.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if (np.diff(offsets) == 2 * counts).all():
        return memoryview(data.view("<u2").astype("<u4")).cast("B"), (4 * np.cumsum(counts)).tolist()
    raws = [_widen(p, n) for p, n in zip(payloads.to_pylist(), counts.tolist(), strict=True)]
    return memoryview(b"".join(raws)), np.cumsum([len(r) for r in raws]).tolist()


def _verified(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in tables:
        counts = t.column("n_ids").to_numpy()
        raw, ends = _wide(t.column("payload"), counts)
        at, crcs = 0, []
        for h, n, e in zip(t.column("hash").to_pylist(), counts.tolist(), ends, strict=True):
            one = raw[at:e]
            if address(one) != h or e - at != 4 * n:
                raise ValueError(f"chunk {h.hex()} is damaged")
            crcs.append(zlib.crc32(one))
            at = e
        yield pa.RecordBatch.from_arrays([t.column("hash"), t.column("n_ids"), pa.array(crcs, pa.int64())], ["hash", "n", "crc"])


def _shift_tables() -> list[np.ndarray]:
    """For each k, tables that advance a CRC-32 register over 2^k zero bytes, by the register's four bytes."""

    def advance(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
        return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]

    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    one = np.stack([step, byte, byte << 8, byte << 16])
    # a zero byte takes x to step[x & 255] ^ x >> 8
    one[1], one[2], one[3] = byte, byte << np.uint32(8), byte << np.uint32(16)
    out = [one]
    for _ in range(40):
        t = out[-1]
        out.append(np.stack([advance(t, advance(t, byte << np.uint32(8 * k))) for k in range(4)]))
    return out


_SHIFT = _shift_tables()


def crc_join(crcs: np.ndarray, more: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of A + B from those of A and B and the length of B, for arrays of them."""
    x = crcs.astype(np.uint32)
    for k in range(int(n_bytes.max()).bit_length() if len(n_bytes) else 0):
        on = (n_bytes >> k & 1).astype(bool)
        y = x[on]
        t = _SHIFT[k]
        x[on] = t[0][y & 255] ^ t[1][y >> 8 & 255] ^ t[2][y >> 16 & 255] ^ t[3][y >> 24]
    return x ^ more.astype(np.uint32)


def _rebuilt(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in tables:
        chunks = t.column("c")
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(chunks).to_numpy())])
        flat = chunks.flatten()
        hashes, crcs, sizes = flat.field("hash").to_pylist(), flat.field("crc").to_numpy(), flat.field("n").to_numpy().astype(np.int64)
        lengths = sizes.tolist()
        for a, b, root in zip(bounds[:-1].tolist(), bounds[1:].tolist(), t.column("root").to_pylist(), strict=True):
            if root_of(hashes[a:b], lengths[a:b]) != root:
                raise ValueError("a document's chunks don't match its Merkle root")
        first, counts = bounds[:-1], np.diff(bounds)
        total = crcs[first].astype(np.uint32)
        for k in range(1, int(counts.max(initial=0))):
            at = np.flatnonzero(counts > k)
            total[at] = crc_join(total[at], crcs[first[at] + k].astype(np.uint32), 4 * sizes[first[at] + k])
        n_tokens = np.add.reduceat(sizes, first) if len(sizes) else sizes
        if (n_tokens != t.column("n_tokens").to_numpy()).any():
            raise ValueError("a document's chunks don't have as many ids as its recipe says")
        yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("start"), pa.array(n_tokens), pa.array(total.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: recipes are checked against the manifest,
    chunks are read, checked against their addresses and reduced to CRCs, documents are checked against their Merkle
    roots, their ids counted from their chunks, and their CRCs joined from those of their chunks in order."""
    verify(spark, path)
    chunk = _data(spark, path, "chunk").select("hash", "n_ids", "payload")
    crcs = chunk.mapInArrow(_verified, "hash binary, n int, crc long")
    recipes = _recipes(spark, path)
    refs = recipes.select("start", F.posexplode("hashes").alias("seq", "hash"))
    joined = join_dealt(refs, crcs, ["hash"], [F.col("start"), F.col("seq")]).groupBy("start").agg(F.array_sort(F.collect_list(F.struct("seq", "hash", "crc", "n"))).alias("c"))
    checked = recipes.select("doc_id", "start", "n_tokens", "root").join(joined, "start", "left")
    return checked.mapInArrow(_rebuilt, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document, put together again from the chunks of its recipe."""

    def widen(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            ids = [np.frombuffer(b"".join(_widen(p["payload"], p["n_ids"]) for p in parts), "<u4").astype(np.int32) for parts in t.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    chunk = _data(spark, path, "chunk").select("hash", "n_ids", "payload")
    refs = _recipes(spark, path).select("doc_id", "start", F.posexplode("hashes").alias("seq", "hash"))
    parts = refs.join(chunk, "hash").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "n_ids", "payload"))).alias("parts"))
    return parts.mapInArrow(widen, "doc_id long, start long, ids array<int>")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written to a store in ascending doc_id and read back.

    A null or empty text is the end id alone. Null doc_ids come first; repeated doc_ids stand side by side in the order
    of their contents' Merkle roots. No documents: no rows."""
    path = new_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read_digests(spark, path)
