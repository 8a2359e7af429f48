"""Line dedup over a sharded minimal perfect hash of the lines that recur.

The documents' distinct line keys, as 128-bit hashes, are counted with map-side combine: documents that hold the key and
the largest id among them. The keys in at least ``min_docs`` documents go to shards by their hash, and each shard gets a
minimal perfect hash (levels of bit arrays: a key sits at the first level where nobody else took its place; its number is
the count of set bits before it) over which compact arrays lie: fingerprint, count and largest id. Documents then probe the
arrays; no line is joined. The fingerprint has 64 bits that the shard and the place do not use.

The arrays are broadcast only if they stay under ``index_bytes``, which is checked on their size in the shared folder.
Beyond it the hashes of the lines are looked up by a join on the hash with the same table (Spark splits hot hashes on the
documents' side), and the dropped line numbers go back to their documents by id.

Each row of the table is a document. Defined cases: a null or empty text is one empty line; lines shorter than
``min_chars`` (after stripping) always stay; in the document with the largest id all lines of a key stay; rows that share
that id keep them all, and rows with the same id and different texts are told apart by their text. Null ids count as the
smallest. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import field, fresh, plain_names, short_batches, staged

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
KEYS_PER_SHARD = 200_000
INDEX_BYTES = 128 << 20
LEAST = -(2**63)


def line_keys(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and the key of each that is long enough."""
    lines = (text or b"").split(b"\n")
    keys = []
    for line in lines:
        key = line.strip(SPACE)
        # Code points: bytes that do not continue a character. No need to count where even the bytes are too few.
        long = len(key) >= min_chars and (key.isascii() or len(key.decode(errors="replace")) >= min_chars)
        keys.append(key.lower() if long else None)  # bytes.lower() changes A-Z only
    return lines, keys


def hash128(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def mix(values: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit number for each number and seed."""
    z = values + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit numbers: bit arrays by level, with the set bits before each word."""

    LOAD, LEVELS = 1.5, 40

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.ranks.append(np.concatenate([[base], base + ones[:-1]]))
            base += int(ones[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            if len(levels) == cls.LEVELS:
                raise ValueError("two equal keys")
            size = max(64, int(len(keys) * cls.LOAD))
            place = mix(keys, len(levels)) % np.uint64(size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view(np.uint64))
            keys = keys[~alone[place]]
        return cls(levels)

    @staticmethod
    def slots(n: int) -> int:
        return max(64, int(n * PerfectHash.LOAD))

    def find(self, keys: np.ndarray, sizes: list[int]) -> np.ndarray:
        """The number of each key, -1 where no level has a bit for it."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (bits, rank, size) in enumerate(zip(self.levels, self.ranks, sizes, strict=True)):
            place = mix(keys[todo], level) % np.uint64(size)
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = rank[word[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
        return out


class LineIndex:
    """The shards of the index: the hash decides the shard, the perfect hash the place, the fingerprint whether it is the key."""

    def __init__(self, shards: dict[int, dict], n_shards: int):
        self.n_shards, self.shards = n_shards, {}
        for number, s in shards.items():
            bits = np.frombuffer(s["levels"], np.uint64)
            cuts = np.cumsum([-(-x // 64) for x in s["sizes"]])
            table = PerfectHash(np.split(bits, cuts[:-1]))
            self.shards[number] = (table, s["sizes"], np.frombuffer(s["prints"], np.uint64), np.frombuffer(s["owners"], np.int64))

    def owners(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it a key, the largest id that holds it)"""
        known, owner = np.zeros(len(high), bool), np.zeros(len(high), np.int64)
        number = high % np.uint64(self.n_shards)
        order = np.argsort(number, kind="stable")
        cuts = np.searchsorted(number[order], np.arange(self.n_shards + 1))
        for shard, (table, sizes, prints, best) in self.shards.items():
            at = order[cuts[shard] : cuts[shard + 1]]
            place = table.find(high[at], sizes)
            same = place >= 0
            at, place = at[same], place[same]
            same = prints[place] == low[at]
            known[at[same]], owner[at[same]] = True, best[place[same]]
        return known, owner


def build_shard(rows: pa.Table) -> pa.Table:
    """One row for one shard: the perfect hash and the arrays over it."""
    high, low = (rows.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
    # The table is keyed by one half of the hash; of two keys with the same half, the shard cannot hold both.
    if len(np.unique(high)) != len(high):
        raise ValueError("two lines share 64 bits of their hash within a shard")
    table = PerfectHash.build(high)
    sizes, left = [], len(high)
    for bits in table.levels:
        sizes.append(PerfectHash.slots(left))
        left -= int(np.bitwise_count(bits).sum())
    place = table.find(high, sizes)
    prints, owners = np.empty(len(high), np.uint64), np.empty(len(high), np.int64)
    prints[place], owners[place] = low, rows.column("owner").to_numpy()
    counts = np.empty(len(high), np.int64)
    counts[place] = rows.column("docs").to_numpy()
    return pa.table({
        "shard": rows.column("shard")[:1], "levels": pa.array([np.concatenate(table.levels).tobytes()], pa.binary()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
        "prints": pa.array([prints.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "owners": pa.array([owners.tobytes()], pa.binary()),
    })


SHARD = "shard int, levels binary, sizes array<bigint>, prints binary, counts binary, owners binary"


def recurring_lines(docs: DataFrame, text: str, id_column: str, min_chars: int, min_docs: int) -> DataFrame:
    """(high, low, docs, owner) of each key in at least ``min_docs`` documents."""
    rows = docs.select(F.col(text).cast("binary").alias("t"), F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)).alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, repeats = [], []
            for t in batch.column(0).to_pylist():
                mine = {k for k in line_keys(t, min_chars)[1] if k is not None}
                digests.extend(map(hash128, mine))
                repeats.append(len(mine))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            ids = np.repeat(batch.column(1).to_numpy(), repeats)
            arrays = [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(ids)]
            yield pa.RecordBatch.from_arrays(arrays, names=["high", "low", "id"])

    keys = rows.mapInArrow(run, "high long, low long, id long")
    counted = keys.groupBy("high", "low").agg(F.count("*").alias("docs"), F.max("id").alias("owner"))
    return counted.where(F.col("docs") >= min_docs)


def build_index(lines: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """The staged index, one row per shard, and the number of shards."""
    n_shards = max(1, -(-lines.count() // keys_per_shard))
    # pmod of the unsigned half; the shard of a key is the same in numpy.
    unsigned = F.pmod(F.pmod(F.col("high"), F.lit(n_shards)) + F.when(F.col("high") < 0, F.lit(2**64 % n_shards)).otherwise(0), F.lit(n_shards))
    rows = lines.withColumn("shard", unsigned.cast("int"))
    return staged(rows.groupBy("shard").applyInArrow(build_shard, SHARD)), n_shards


@plain_names
def dedup_lines(
    docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    index_bytes: int = INDEX_BYTES,
) -> tuple[DataFrame, str]:
    """All rows and columns of ``docs``, the text without dropped lines, and a struct column (name returned too).

    Its fields: n_lines, n_dropped, kept_sha256 (of the text that stays). ``id_column`` holds whole numbers.
    """
    short_batches(docs.sparkSession)
    lines = staged(recurring_lines(docs, text, id_column, min_chars, min_docs))
    index, n_shards = build_index(lines)
    size = index.agg(F.sum(F.octet_length("levels") + F.octet_length("prints") + F.octet_length("owners"))).first()[0] or 0
    broadcast = None
    if size <= index_bytes:
        held = index.select("shard", "levels", "sizes", "prints", "owners").collect()
        broadcast = docs.sparkSession.sparkContext.broadcast((n_shards, {r.shard: r.asDict() for r in held}))
    kept, out, drops = docs.columns, fresh(docs, "lines"), fresh(docs, "_drops")
    work = docs if broadcast is not None else with_drops(docs, lines, text, id_column, min_chars, drops)
    verdict = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = LineIndex(broadcast.value[1], broadcast.value[0]) if broadcast is not None else None
        for batch in batches:
            texts, rows = [], []
            given = [t.encode() if t is not None else None for t in batch.column(text).to_pylist()]
            split = [line_keys(t, min_chars) for t in given]
            if probe is not None:
                digests = b"".join(hash128(k) for _, keys in split for k in keys if k is not None)
                halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)
                known, owner = probe.owners(np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]))
            at = 0
            for row, ((parts, keys), whole) in enumerate(zip(split, given, strict=True)):
                if probe is not None:
                    n = sum(k is not None for k in keys)
                    mine = batch.column(id_column)[row].as_py()
                    gone = known[at : at + n] & (owner[at : at + n] != (LEAST if mine is None else mine))
                    at += n
                    flags = iter(gone.tolist())
                    stay = [p for p, k in zip(parts, keys, strict=True) if k is None or not next(flags)] if gone.any() else parts
                else:
                    dropped = set(batch.column(drops)[row].as_py() or ())
                    stay = [p for i, p in enumerate(parts) if i not in dropped]
                left = b"\n".join(stay) if len(stay) < len(parts) else whole or b""
                texts.append(left.decode() if whole is not None or stay != parts else None)
                rows.append({"n_lines": len(parts), "n_dropped": len(parts) - len(stay), "kept_sha256": hashlib.sha256(left).hexdigest()})
            arrays = [pa.array(texts, batch.column(text).type) if c == text else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(rows, verdict)], names=[*kept, out])

    struct = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return work.mapInArrow(run, T.StructType([*[field(docs, c) for c in kept], T.StructField(out, struct)])), out


def with_drops(docs: DataFrame, lines: DataFrame, text: str, id_column: str, min_chars: int, drops: str) -> DataFrame:
    """Add the numbers of the lines to drop, found by a join on the hash, for an index above the bound of a broadcast."""
    rows = docs.select(F.col(text).cast("binary").alias("t"), F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)).alias("id"), F.xxhash64(text).alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(hash128(k), i, n) for i, t in enumerate(batch.column(0).to_pylist()) for n, k in enumerate(line_keys(t, min_chars)[1]) if k is not None]
            halves = np.frombuffer(b"".join(f[0] for f in found), np.int64).reshape(-1, 2)
            at = np.array([f[1] for f in found], np.int64)
            arrays = [pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1)]
            arrays += [pa.array(batch.column(c).to_numpy()[at] if len(at) else np.zeros(0, np.int64)) for c in (1, 2)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([f[2] for f in found], pa.int32())], names=["high", "low", "id", "mark", "n"])

    asked = rows.mapInArrow(run, "high long, low long, id long, mark long, n int")
    found = asked.join(lines.select("high", "low", "owner"), ["high", "low"]).where("id <> owner")
    # One row per document: at most its own lines. A repeated row finds the same numbers again.
    gone = found.groupBy("id", "mark").agg(F.collect_set("n").alias(drops)).withColumnsRenamed({"id": "_id", "mark": "_mark"})
    same = (F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)) == F.col("_id")) & (F.xxhash64(text) == F.col("_mark"))
    return docs.join(gone, same, "left").drop("_id", "_mark")
