"""Benchmark decontamination: a broadcast set of normalised test n-grams scanned over every document.

Words are runs of digits, letters and any non-ASCII characters after A-Z became a-z. The windows of an item are its
runs of ``window`` words; an item with fewer words, but not none, is one window. Each document's words are turned into
the word numbers of the benchmark (0: not in it), all windows of a batch are hashed at once, and each hit is verified
word by word. The test items are taken in blocks of bounded size: each block is one more scan of the same rows, without
a shuffle, so the benchmark may be of any size.

Defined cases: null and empty texts have no words. A null item text has no window. Windows of items without an id hit
words, but name no item. Repeated item ids count once. Repeated documents are judged each on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import field, fresh, plain_names, short_batches

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
#: Bytes of item text whose windows are broadcast at once.
BLOCK_BYTES = 16 << 20
FILTER_BITS = 20


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def window_tables(items: list[tuple[str | None, bytes | None]], window: int) -> tuple[dict, dict]:
    """The numbers of the items' words and, by length, their distinct windows with the items that own each.

    Plain values, so that executors need no copy of this module to read a broadcast.
    """
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        size = min(window, len(ids))
        for start in range(len(ids) - size + 1 if ids else 0):
            owned = owners.setdefault(tuple(ids[start : start + size]), set())
            if item is not None:
                owned.add(item)
    tables = {}
    for size in sorted({len(w) for w in owners}):
        rows = [w for w in owners if len(w) == size]
        matrix = np.array(rows, dtype=np.uint32)
        seed = 0
        while True:
            # Another multiplier until no two windows share a hash.
            factors = np.random.default_rng(seed).integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            hashes = hash_windows(matrix.ravel(), factors)[::size]
            order = np.argsort(hashes)
            if (np.diff(hashes[order]) != 0).all():
                break
            seed += 1
        hashes = hashes[order]
        seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        seen[hashes >> np.uint64(64 - FILTER_BITS)] = True
        tables[size] = (factors, hashes, seen, matrix[order], [sorted(owners[rows[i]]) for i in order])
    return vocabulary, tables


def occurrences(tables: dict, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[list[str]]]]:
    """(length, starts, owners of each start's window) of all true occurrences in one array of word numbers."""
    for size, (factors, hashes, seen, matrix, owners) in tables.items():
        if len(ids) < size:
            continue
        found = hash_windows(ids, factors)
        starts = np.flatnonzero(seen[found >> np.uint64(64 - FILTER_BITS)])
        at = np.searchsorted(hashes, found[starts]).clip(max=len(hashes) - 1)
        same = hashes[at] == found[starts]
        starts, at = starts[same], at[same]
        if len(starts):
            same = (ids[starts[:, None] + np.arange(size)] == matrix[at]).all(axis=1)
            yield size, starts[same], [owners[i] for i in at[same]]


def hash_windows(ids: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The hash of every run of ``len(factors)`` numbers."""
    n = len(ids) - len(factors) + 1
    wide = ids.astype(np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i, factor in enumerate(factors):
        total += wide[i : i + n] * factor
    return total


def blocks(benchmark: DataFrame, text: str, item: str, limit: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items in blocks of about ``limit`` bytes; one item may exceed it."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("binary").alias("t"))
    block, size = [], 0
    for row in rows.toLocalIterator(prefetchPartitions=False):
        if block and size + len(row.t or b"") > limit:
            yield block
            block, size = [], 0
        block.append((row.i, bytes(row.t) if row.t is not None else None))
        size += len(row.t or b"") + 32
    yield block


#: What is known of a row between two blocks: words, which of them are hit (packed bits), the items found.
STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("hit", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
ARROW_STATE = pa.struct([("n", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.string()))])
VERDICT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
ARROW_VERDICT = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
    ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def look_up(texts: list[bytes | None], known: list[dict | None], index: tuple[dict, dict]) -> list[dict]:
    """What is known of each text after one more block."""
    vocabulary, tables = index
    number = vocabulary.get
    parts, sizes = [], []
    for t in texts:
        found = words(t)
        parts.append(np.fromiter((number(w, 0) for w in found), dtype=np.uint32, count=len(found)))
        parts.append(np.zeros(1, dtype=np.uint32))  # a window over two documents has a 0, which no window has
        sizes.append(len(found))
    ids = np.concatenate(parts)
    ends = np.cumsum(np.array(sizes) + 1)
    turns = np.zeros(len(ids) + 1, dtype=np.int32)
    items: dict[int, set[str]] = {}
    for length, starts, owners in occurrences(tables, ids):
        np.add.at(turns, starts, 1)
        np.add.at(turns, starts + length, -1)
        for doc, owned in zip(np.searchsorted(ends, starts, side="right").tolist(), owners, strict=True):
            items.setdefault(doc, set()).update(owned)
    covered = np.cumsum(turns)[:-1] > 0
    out = []
    for doc, (n, end, before) in enumerate(zip(sizes, ends.tolist(), known, strict=True)):
        before = before or {"hit": None, "items": []}
        hit = before["hit"]
        if doc in items:
            mine = covered[end - 1 - n : end - 1]
            hit = np.packbits(mine | unpacked(hit, n)).tobytes()
        out.append({"n": n, "hit": hit, "items": sorted(items.get(doc, set()).union(before["items"]))})
    return out


def unpacked(hit: bytes | None, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(hit, np.uint8), count=n).astype(bool) if hit else np.zeros(n, dtype=bool)


def verdict(text: bytes | None, known: dict, share: tuple[int, int]) -> dict:
    covered = unpacked(known["hit"], known["n"])
    n_hit = int(covered.sum())
    return {
        "n_words": known["n"], "n_hit": n_hit, "n_items": len(known["items"]),
        "items_sha256": hashlib.sha256(",".join(known["items"]).encode()).hexdigest(),
        "contaminated": n_hit > 0 and share[1] * n_hit >= share[0] * known["n"],
        "spans": spans(text, covered) if n_hit else [],
    }


def spans(text: bytes, covered: np.ndarray) -> list[dict[str, int]]:
    """Code point offsets of the runs of covered words."""
    found = [m.span() for m in WORD.finditer(text.lower())]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    at = [x for a, b in edges.reshape(-1, 2).tolist() for x in (found[a][0], found[b - 1][1])]
    chars = np.cumsum(np.concatenate([[0], (np.frombuffer(text, np.uint8) & 0xC0) != 0x80]))[at].tolist()
    return [{"start": a, "end": b} for a, b in zip(chars[::2], chars[1::2], strict=True)]


@plain_names
def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: tuple[int, int] = (1, 20), block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` and one struct column more, whose name is returned too.

    Its fields: n_words, n_hit (words inside an occurring window), n_items (items with one), items_sha256 (of their
    ids as text, sorted and joined by commas), contaminated (at least ``share`` of the words are hit), spans (code
    point offsets of the hit runs).
    """
    short_batches(docs.sparkSession)
    source = fresh(docs, "_bytes")
    work = docs.withColumn(source, F.col(text).cast("binary"))
    state, out = fresh(work, "_known"), fresh(docs, "contamination")
    work = work.withColumn(state, F.lit(None).cast(STATE))
    kept, carried = docs.columns, [*docs.columns, source]
    context = docs.sparkSession.sparkContext

    def step(broadcast, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                texts = batch.column(source).to_pylist()
                known = look_up(texts, batch.column(state).to_pylist(), broadcast.value)
                if last:
                    rows = pa.array([verdict(t, k, share) for t, k in zip(texts, known, strict=True)], ARROW_VERDICT)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), rows], names=[*kept, out])
                else:
                    rows = pa.array(known, ARROW_STATE)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), rows], names=[*carried, state])

        return run

    # One block is held back, so that the last one also gives the verdict.
    held = None
    for block in blocks(benchmark, item_text, item, block_bytes):
        if held is not None:
            work = work.mapInArrow(step(held, False), work.schema)
        held = context.broadcast(window_tables(block, window))
    return work.mapInArrow(step(held, True), T.StructType([*[field(docs, c) for c in kept], T.StructField(out, VERDICT)])), out


@plain_names
def decontaminate(docs: DataFrame, benchmark: DataFrame, *, action: str = "drop", text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents (``drop``), or with the hit words cut out of those (``cut``)."""
    marked, out = contamination(docs, benchmark, text=text, **options)
    if action == "drop":
        return marked.where(~F.col(out).getField("contaminated")).drop(out)
    pieces = F.col(out).getField("spans")
    begins = F.concat(F.array(F.lit(0).cast("long")), pieces.getField("end"))
    stops = F.concat(pieces.getField("start"), F.array(F.char_length(text).cast("long")))
    kept = F.zip_with(begins, stops, lambda a, b: F.substring(F.col(text), a.cast("int") + 1, (b - a).cast("int")))
    cut = F.when(F.col(out).getField("contaminated"), F.array_join(kept, "")).otherwise(F.col(text))
    return marked.withColumn(text, cut).drop(out)
