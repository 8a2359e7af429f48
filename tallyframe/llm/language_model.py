"""Katz backoff language model: Good-Turing discounted counts with exactly normalised backoff weights.

The model is a bigram model over words and an end token; a word that training never saw is one further type, "unknown".

* P(w) = d(c) * c / N for known words; the unknown type has what the discounts leave.
* P(w | v) = d(c) * c / c(v) if v w was seen; else alpha(v) * P(w), where alpha(v) shares what the discounts of v leave
  among the words never seen after v, so that each context sums to one. A context whose counts are all too large to be
  discounted is given one more count to leave (its counts are divided by c(v) + 1). Unseen contexts give P(w).
* d is Katz' discount for counts up to 5 from the counts of counts of the whole training part; where these are too
  irregular (small data) fewer counts are discounted, and at last half a count is taken from each.

Documents are packed into batches of about ``batch_tokens`` tokens, each with its own dictionary, in the shared folder. A
batch asks every bucket of words once for each distinct word, and every bucket of contexts once for each distinct pair,
together with its own training counts; a bucket sums what it is asked and answers with the whole counts. So a word or
context that a third of all rows hold is one number per batch, nothing is broadcast but a dozen sums, and the questions
grow with the corpus. Counts are stored as tables partitioned by bucket. Numbers in them are packed and compressed.

Defined cases: null and empty texts are an end token alone. Each row is a document; rows with a null id are trained on or
held out by the crc of empty text. With nothing to train on, N is 0, every word is unknown and P(unknown) is 1. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import crc_mod, staged

FOLDS, HELD_OUT = 7, 2
BATCH_TOKENS = 1_000_000
#: Distinct words or pairs that a bucket is meant to hold, before the same ones of several batches meet.
BUCKET_ROWS = 2_000_000
MAX_DISCOUNTED = 5
END = 1


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound. END is no word's."""

    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        value = max(xxhash.xxh3_64_intdigest(word), 2)
        if len(self) < self.LIMIT:
            self[word] = value
        return value


def pack(values: np.ndarray, kind: str) -> bytes:
    """Compressed numbers, the bytes of equal weight beside each other."""
    raw = np.ascontiguousarray(values, np.dtype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def discounts(counts: list[int]) -> list[float]:
    """d(1), d(2), ... from the numbers of types seen once, twice, ...; 1 beyond the list."""
    for k in range(min(MAX_DISCOUNTED, len(counts) - 1), 0, -1):
        if all(counts[: k + 1]):
            common = (k + 1) * counts[k] / counts[0]
            d = [((r + 1) * counts[r] / counts[r - 1] / r - common) / (1 - common) for r in range(1, k + 1)] if common < 1 else []
            if d and all(0 < x < 1 for x in d):
                return d
    return [1 - 0.5 / r for r in range(1, MAX_DISCOUNTED + 1)]


class Unigrams:
    """P(w) as a function of the count of w."""

    def __init__(self, total: int, kinds: int, counts: list[int]):
        self.total, self.kinds, self.d = total, kinds, np.array(discounts(counts))
        taken = sum((1 - d) * r * n for r, (d, n) in enumerate(zip(self.d, counts, strict=False), 1))
        self.unknown = taken / total if total else 1.0
        self.shrink = 1.0
        if total and not taken:
            self.unknown, self.shrink = 1 / (total + 1), total / (total + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        out = np.where(c > 0, c * discount(self.d, c) * self.shrink / max(self.total, 1), self.unknown)
        return out


def discount(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where((c > 0) & (c <= len(d)), d[np.clip(c, 1, len(d)) - 1], 1.0)


def batches(docs: DataFrame, text: str, id_column: str, batch_tokens: int) -> DataFrame:
    """One row per batch: the sorted distinct words, the tokens as places in them, document ends, training flags and ids."""
    held = (crc_mod(id_column, FOLDS) == HELD_OUT).alias("held")
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("binary").alias("t"), held)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHashes(), TaskContext.get().partitionId() << 32
        tokens, lengths, ids, flags, total = [], [], [], [], 0

        def done() -> pa.RecordBatch:
            words, places = np.unique(np.concatenate(tokens), return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([pack(words, "<u8")]), pa.array([len(words)], pa.int64()), pa.array([pack(places, "<u4")]), pa.array([pack(np.array(lengths), "<u4")]),
                 pa.array([pack(np.array(flags), "u1")]), pa.array([[i.as_py() for i in ids]], pa.list_(ids[0].type)), pa.array([total], pa.int64())], names=["batch", "words", "n_words", "tokens", "lengths", "held", "ids", "n"],
            )

        for part in parts:
            for i, value in enumerate(part.column(1).to_pylist()):
                words = value.lower().split() if value else []  # of bytes: A-Z only, and exactly the six ASCII white spaces
                tokens.append(np.fromiter((hashes[w] for w in words), np.uint64, len(words)))
                tokens.append(np.array([END], np.uint64))
                lengths.append(len(words) + 1)
                ids.append(part.column(0)[i])
                flags.append(part.column(2)[i].as_py())
                total += len(words) + 1
                if total >= batch_tokens:
                    yield done()
                    number += 1
                    tokens, lengths, ids, flags, total = [], [], [], [], 0
        if ids:
            yield done()

    return rows.mapInArrow(run, f"batch long, words binary, n_words long, tokens binary, lengths binary, held binary, ids array<{kind}>, n long")


class Batch:
    """A batch read back, with what follows from it alone."""

    def __init__(self, row: dict):
        self.n_words = row["n_words"]
        self.tokens = unpack(row["tokens"], "<u4").astype(np.int64)
        self.lengths = unpack(row["lengths"], "<u4").astype(np.int64)
        self.held = unpack(row["held"], "u1").astype(bool)
        self.train = np.repeat(~self.held, self.lengths)

    def train_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=self.n_words)

    def contexts(self) -> np.ndarray:
        """The word before each token as a place among the words; -1 at the beginning of a document."""
        before = np.concatenate([[-1], self.tokens[:-1]])
        before[np.cumsum(self.lengths) - self.lengths] = -1
        return before

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word) pairs in order, training counts, and the pair of each token."""
        keys = (self.contexts() + 1) * self.n_words + self.tokens
        distinct, place = np.unique(keys, return_inverse=True)
        counts = np.bincount(place[self.train], minlength=len(distinct))
        return distinct // self.n_words - 1, distinct % self.n_words, counts, place


def scatter(buckets: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in order) of each bucket that has some."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    for b in range(n_buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def ask_words(packed: DataFrame, n_buckets: int) -> DataFrame:
    """Buckets are ranges of hashes, so that answers in the order of buckets are in the order of a batch's words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = np.array([(b << 64) // n_buckets for b in range(1, n_buckets)], dtype=np.uint64)
        for part in parts:
            for row in part.to_pylist():
                words, counts = unpack(row["words"], "<u8"), Batch(row).train_counts()
                edges = [0, *np.searchsorted(words, borders).tolist(), len(words)]
                out = [(b, row["batch"], pack(words[i:j], "<u8"), pack(counts[i:j], "<u4")) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if i < j]
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "batch", "words", "counts"])

    return packed.select("batch", "words", "n_words", "tokens", "lengths", "held").mapInArrow(run, "bucket int, batch long, words binary, counts binary")


def count_words(rows: pa.Table) -> pa.Table:
    """Whole counts and numbers of the words of one bucket, for each batch that asked; sums on the first row."""
    words = [unpack(w, "<u8") for w in rows.column("words").to_pylist()]
    asked = np.concatenate([unpack(c, "<u4") for c in rows.column("counts").to_pylist()]).astype(np.int64)
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(place, weights=asked, minlength=len(distinct)).astype(np.int64)
    # Frequent words get small numbers, which compress well.
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(distinct))
    cuts = np.cumsum([len(w) for w in words])[:-1]
    sums = [int(counts.sum()), int((counts > 0).sum()), *np.bincount(counts[counts <= MAX_DISCOUNTED + 1], minlength=MAX_DISCOUNTED + 2)[1:].tolist(), len(distinct)]
    return pa.table({
        "bucket": rows.column("bucket"), "batch": rows.column("batch"),
        "counts": pa.array([pack(c, "<u8") for c in np.split(counts[place], cuts)], pa.binary()),
        "ranks": pa.array([pack(c, "<u8") for c in np.split(rank[place], cuts)], pa.binary()),
        "sums": pa.array([sums] + [None] * (rows.num_rows - 1), pa.list_(pa.int64())),
    })


def gather(answers: list[dict], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The count and the number of each word of a batch from the answers of all buckets."""
    given = sorted(answers, key=lambda r: r["bucket"])
    counts = np.concatenate([unpack(r["counts"], "<u8") for r in given]).astype(np.int64)
    numbers = np.concatenate([unpack(r["ranks"], "<u8").astype(np.int64) * n_buckets + r["bucket"] for r in given])
    return counts, numbers


def pair_buckets(contexts: np.ndarray, numbers: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, places of its pairs, numbers of its contexts, pairs of each) in one order for asking and reading answers."""
    ids = np.where(contexts < 0, 0, numbers[contexts] + 1)  # 0: the beginning of a document
    for b, at in scatter(mixed(ids) % n_buckets, n_buckets):
        starts = np.flatnonzero(np.diff(contexts[at], prepend=-2))
        yield b, at, ids[at[starts]], np.diff(starts, append=len(at))


def mixed(ids: np.ndarray) -> np.ndarray:
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (z >> np.uint64(33)).astype(np.int64)


def ask_pairs(word_buckets: int, pair_bucket_count: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            batch = Batch(row)
            counts, numbers = gather(right.to_pylist(), word_buckets)
            contexts, words, seen, _ = batch.pairs()
            for b, at, ids, runs in pair_buckets(contexts, numbers, pair_bucket_count):
                w = words[at]
                out.append((b, row["batch"], pack(ids, "<u8"), pack(runs, "<u4"), pack(numbers[w], "<u8"), pack(counts[w], "<u8"), pack(seen[at], "<u4")))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        names = ["bucket", "batch", "contexts", "runs", "words", "word_counts", "counts"]
        return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return run


PAIRS = "bucket int, batch long, contexts binary, runs binary, words binary, word_counts binary, counts binary"


def count_pairs(unigrams: Unigrams):
    def run(rows: pa.Table) -> pa.Table:
        given = {c: [unpack(x, kind) for x in rows.column(c).to_pylist()] for c, kind in (("contexts", "<u8"), ("runs", "<u4"), ("words", "<u8"), ("word_counts", "<u8"), ("counts", "<u4"))}
        asked_contexts = np.concatenate(given["contexts"])
        distinct_contexts, context_place = np.unique(asked_contexts, return_inverse=True)
        context = np.repeat(context_place, np.concatenate(given["runs"]))
        word = np.concatenate(given["words"]).astype(np.int64)
        order = np.lexsort((word, context))
        new = (np.diff(context[order], prepend=-1) != 0) | (np.diff(word[order], prepend=-1) != 0)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        first = order[new]
        counts = np.bincount(place, weights=np.concatenate(given["counts"]).astype(np.int64), minlength=len(first)).astype(np.int64)
        # What a batch needs of a context to finish its backoff weight once the discounts are known.
        owner, seen = context[first], counts > 0
        n = len(distinct_contexts)
        total = np.bincount(owner, weights=counts, minlength=n).astype(np.int64)
        small = [np.bincount(owner[counts == r], minlength=n) for r in range(1, MAX_DISCOUNTED + 1)]
        lower = unigrams.p(np.concatenate(given["word_counts"]).astype(np.int64)[first])
        mass = np.bincount(owner[seen], weights=lower[seen], minlength=n)
        pair_cuts = np.cumsum([len(w) for w in given["words"]])[:-1]
        context_cuts = np.cumsum([len(c) for c in given["contexts"]])[:-1]
        blobs = lambda values, kind, cuts: pa.array([pack(v, kind) for v in np.split(values, cuts)], pa.binary())
        sums = np.bincount(counts[counts <= MAX_DISCOUNTED + 1], minlength=MAX_DISCOUNTED + 2)[1:].tolist()
        return pa.table({
            "bucket": rows.column("bucket"), "batch": rows.column("batch"), "counts": blobs(counts[place], "<u8", pair_cuts),
            "totals": blobs(total[context_place], "<u8", context_cuts),
            "small": pa.array([pack(v, "<u4") for v in np.split(np.stack(small)[:, context_place], context_cuts, axis=1)], pa.binary()),
            "mass": blobs(mass[context_place], "<f8", context_cuts), "sums": pa.array([sums] + [None] * (rows.num_rows - 1), pa.list_(pa.int64())),
        })

    return run


ANSWERS = "bucket int, batch long, counts binary, totals binary, small binary, mass binary, sums array<bigint>"


def pair_logs(counts: np.ndarray, lower: np.ndarray, runs: np.ndarray, totals: np.ndarray, small: np.ndarray, mass: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 P(word | context) of pairs that lie in runs of one context each."""
    r = np.arange(1, len(d) + 1)
    left = ((1 - d) * r) @ small[: len(d)]
    held = np.where(left > 0, totals, totals + 1)
    left = np.where(left > 0, left, 1.0)
    alpha = np.where(totals > 0, left / held / np.maximum(1 - mass, 1e-300), 1.0)
    alpha, held = np.repeat(alpha, runs), np.repeat(held, runs)
    return np.log10(np.where(counts > 0, counts * discount(d, counts) / held, alpha * lower))


def score_batch(unigrams: Unigrams, d: list[float], word_buckets: int, pair_bucket_count: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        given = right.to_pylist()
        answers = {r["bucket"]: r for r in given if r["totals"] is not None}
        for row in left.to_pylist():
            batch = Batch(row)
            counts, numbers = gather([r for r in given if r["totals"] is None], word_buckets)
            contexts, words, _, place = batch.pairs()
            lower = unigrams.p(counts)
            logs = np.empty(len(contexts))
            for b, at, _, runs in pair_buckets(contexts, numbers, pair_bucket_count):
                a = answers[b]
                small = unpack(a["small"], "<u4").reshape(MAX_DISCOUNTED, -1).astype(float)
                totals = unpack(a["totals"], "<u8").astype(np.int64)
                logs[at] = pair_logs(unpack(a["counts"], "<u8").astype(np.int64), lower[words[at]], runs, totals, small, unpack(a["mass"], "<f8"), np.array(d))
            base = np.log10((counts + 1) / (unigrams.total + unigrams.kinds + 1))
            starts = np.cumsum(batch.lengths) - batch.lengths
            sums = lambda v: np.add.reduceat(v, starts).tolist()
            out["id"].extend(row["ids"])
            out["held_out"].extend(batch.held.tolist())
            out["n_tokens"].extend(batch.lengths.tolist())
            out["n_known"].extend(sums((counts > 0).astype(np.int64)[batch.tokens]))
            out["base_score"].extend(sums(base[batch.tokens]))
            out["score"].extend(sums(logs[place]))
        kinds = [left.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)})

    return run


def summed(answers: DataFrame, size: int) -> list[int]:
    """The sums over all buckets: a dozen numbers."""
    row = answers.where("sums is not null").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)]).first()
    return [int(x or 0) for x in row]


def score(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", batch_tokens: int = BATCH_TOKENS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    packed = staged(batches(docs, text, id_column, batch_tokens))
    n = packed.agg(F.sum("n")).first()[0] or 0
    word_buckets = pair_bucket_count = max(1, -(-n // bucket_rows))
    words = staged(ask_words(packed, word_buckets).groupBy("bucket").applyInArrow(count_words, "bucket int, batch long, counts binary, ranks binary, sums array<bigint>"))
    total, kinds, *counts, _ = summed(words, MAX_DISCOUNTED + 4)
    unigrams = Unigrams(total, kinds, counts)
    numbers = words.select("batch", "bucket", "counts", "ranks")
    asked = packed.drop("words", "ids", "n").groupBy("batch").cogroup(numbers.groupBy("batch")).applyInArrow(ask_pairs(word_buckets, pair_bucket_count), PAIRS)
    pairs = staged(asked.groupBy("bucket").applyInArrow(count_pairs(unigrams), ANSWERS))
    d = discounts(summed(pairs, MAX_DISCOUNTED + 1))
    none = F.lit(None).cast("binary")
    answers = pairs.select("batch", "bucket", "counts", none.alias("ranks"), "totals", "small", "mass").unionByName(
        numbers.withColumns({c: none for c in ("totals", "small", "mass")})
    )
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = packed.drop("words").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score_batch(unigrams, d, word_buckets, pair_bucket_count), schema)
    return scored.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
