"""Documents joined by the Jaccard similarity of their five-word shingles, with token-combination prefixes.

1. Each whole text becomes the set of its shingles' 64-bit hashes. Equal sets are one node from here on, so a group of
   copies of any size is one row.
2. Tokens have one global order: the low ones that few sets hold; all others that few sets hold; those that many hold;
   each by hash ("low" is a hash below a fixed bound). Two sets that reach the threshold share a token among the first
   n - ceil(t * n) + 1 of each; among so many and e more, they share at least 1 + e. The texts are packed into batches, and
   each batch asks once for each low token it holds how many sets hold it, so a token that a third of all sets share is
   one question per batch. Most sets have enough rare low tokens for their whole prefix. Only the sets that have not (short
   ones, and those that are to a good part made of common passages) are packed again with all their tokens, and ask for
   the others among themselves; so a common token is used only by sets that consist of common tokens by three quarters.
3. A token that few sets hold is indexed by itself. Frequent tokens fall into classes by their hash, about eight of a
   prefix in each; the prefix is extended by one for every class it meets, and the class's pairs of tokens are indexed: of
   1 + e shared tokens in e classes, two are in the same class, unless a rare one is shared. Pairs are far rarer than
   their tokens. The number of classes depends on the size band of the smaller set; the larger one writes its pairs for
   both bands it can be joined in.
4. Sets that share an index entry are candidates and verified on their full sets. In an entry of many sets not all pairs
   are needed for components: first all are compared with one pivot, then those still apart with a few more, and at last
   the pairs in different components that sizes, the distances to the pivot (1 - Jaccard is a metric) and parity maps
   leave open. A parity map has a bit for each of 1024 classes of tokens: whether the set's number of them is odd. Maps of
   two sets differ in at most as many bits as the sets differ in tokens, so a pair with too many different bits cannot
   link. Neither of the rules loses a link between different components.

Defined cases: a text of fewer than five words is one shingle; null and empty texts, and white space, have the empty set,
which links with nothing, not even its equals. A null id is less than every other: a component that holds one has a null
component id. Repeated rows are copies. An empty table gives an empty result. Two different sets would be taken for one
node if their 64-bit digests were equal (for n different texts, n * n / 2**65 pairs are to be expected).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyframe.llm.common import field, fresh, plain_names, staged
from tallyframe.llm.components import components

#: Jaccard similarity as a fraction.
THRESHOLD = (3, 4)
SHINGLE = 5
#: Prefixes that may hold a token before it is frequent; frequent tokens of a prefix in one class.
RARE, PER_CLASS = 16, 8
#: Entries of at most so many sets are compared pair by pair at once; larger ones with one pivot, then in rounds with so many more.
SMALL, PIVOTS = 4, (4, 8)
#: 64-bit words of the parity map of a set.
WORDS = 16
#: Of the entries that a set has in the last round, so many tell whether a pair has met before.
FIRST = 16
#: Hashes below LOW (of 2**64) are low; sets and tokens of a batch; tokens that a bucket is meant to answer for.
LOW = int(0.36 * 2**64)
BATCH_SETS, BATCH_TOKENS, BUCKET_TOKENS = 500, 120_000, 250_000
FILTER_BITS = 26
LEAST = -(2**63)
EMPTY = 0


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = value
        return value


FACTORS = np.random.default_rng(5).integers(1, 2**63, 2 * SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def scramble(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: bytes | None, hashes: WordHashes, factors: np.ndarray = FACTORS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split() if text else []  # of bytes: A-Z only, and exactly the six ASCII white spaces
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.fromiter((hashes[w] for w in words), np.uint64, n)
    if n < SHINGLE:
        return scramble((ids * factors[SHINGLE : SHINGLE + n]).sum(keepdims=True) + np.uint64(n))
    total = np.zeros(n - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        total += ids[i : i + len(total)] * factors[i]
    return np.unique(scramble(total))


def digest(tokens: np.ndarray) -> int:
    """The node of a set; EMPTY is the empty set's alone."""
    if not len(tokens):
        return EMPTY
    value = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return (value - 2**64 if value >= 2**63 else value) or 1


def prefix_length(n: int, t: tuple[int, int]) -> int:
    return n - -(-t[0] * n // t[1]) + 1


class Bands:
    """Size bands: a set can only reach the threshold with sets of its own band and the ones beside it."""

    def __init__(self, t: tuple[int, int], largest: int = 1 << 40):
        self.t, self.starts = t, [1]
        while self.starts[-1] <= largest:
            self.starts.append(self.starts[-1] * t[1] // t[0] + 1)
        ends = [s - 1 for s in self.starts[1:]]
        self.classes = [max(1, -(-prefix_length(n, t) // PER_CLASS)) for n in ends]
        # Bands of very small sets, which have no tokens to extend a prefix by, index frequent tokens by themselves.
        self.single = [prefix_length(s, t) + c > s for s, c in zip(self.starts, self.classes, strict=False)]

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def longest(self, n: int) -> int:
        """The tokens that any prefix of such a set may need."""
        return min(n, prefix_length(n, self.t) + self.classes[self.of(n)])

    def listed(self, tokens: np.ndarray) -> np.ndarray:
        """The low tokens of a set in the order of hashes."""
        return tokens[: int(np.searchsorted(tokens, np.uint64(LOW)))]

    def entries(self, n: int, places: list[int], tokens: list[int], frequent: list[bool]) -> set[int]:
        """Index entries of a set, from the tokens of its prefix that others have too (in order, with their places)."""
        base, band, out = prefix_length(n, self.t), self.of(n), set()
        for label in {band, max(band - 1, 0)}:
            met: dict[int, list[int]] = defaultdict(list)
            length = base
            for place, token, often in zip(places, tokens, frequent, strict=True):
                if place >= length:
                    break
                if not often:
                    out.add(token)
                elif self.single[label]:
                    out.add(hash_entry(label, token, token))
                else:
                    kind = (token >> 7) % self.classes[label]
                    length += kind not in met
                    met[kind].append(token)
            for same in met.values():
                out.update(hash_entry(label, a, b) for a, b in combinations(same, 2))
        return out


def hash_entry(label: int, a: int, b: int) -> int:
    return xxhash.xxh3_64_intdigest(b"%d,%d,%d" % (label, a, b))


def parity_map(tokens: np.ndarray) -> bytes:
    """One bit per class of tokens: whether the set has an odd number of them."""
    classes = ((tokens >> np.uint64(17)) % np.uint64(64 * WORDS)).astype(np.int64)
    return np.packbits(np.bincount(classes, minlength=64 * WORDS) & 1).tobytes()


def signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def batches(docs: DataFrame, text: str, id_column: str, t: tuple[int, int]) -> DataFrame:
    """One row per batch: ids, nodes and sizes of its rows; sizes and listed tokens of its distinct sets (``first``: their rows)."""
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)).alias("id"), F.col(text).cast("binary").alias("t"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands, number = WordHashes(), Bands(t), TaskContext.get().partitionId() << 32
        ids, found, sizes, first, lists, maps, seen, total = [], [], [], [], [], [], set(), 0

        def done() -> pa.RecordBatch:
            flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            columns = [flat.tobytes(), np.array([len(x) for x in lists], np.uint32).tobytes(), np.array(first, np.uint32).tobytes(), b"".join(maps)]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *[pa.array([v], pa.list_(pa.int64())) for v in (ids, found, sizes)], *[pa.array([c], pa.binary()) for c in columns], pa.array([total], pa.int64())],
                names=["batch", "ids", "nodes", "sizes", "tokens", "lengths", "first", "maps", "total"],
            )

        for part in parts:
            for i, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                tokens = shingle_set(value.as_py(), hashes)
                node = digest(tokens)
                if node != EMPTY and node not in seen:
                    seen.add(node)
                    first.append(len(ids))
                    lists.append(bands.listed(tokens))
                    maps.append(parity_map(tokens))
                    total += len(lists[-1])
                ids.append(i)
                found.append(node)
                sizes.append(len(tokens))
                if len(ids) >= BATCH_SETS or total >= BATCH_TOKENS:
                    yield done()
                    number += 1
                    ids, found, sizes, first, lists, maps, seen, total = [], [], [], [], [], [], set(), 0
        if ids:
            yield done()

    schema = "batch long, ids array<bigint>, nodes array<bigint>, sizes array<bigint>, tokens binary, lengths binary, first binary, maps binary, total long"
    return rows.mapInArrow(run, schema)


def parity_maps(packed: DataFrame) -> DataFrame:
    """(node, m0, ..., m15) of every node; a node of several batches comes several times."""
    names = [f"m{i}" for i in range(WORDS)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for nodes, first, maps in zip(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                at = np.frombuffer(first, np.uint32)
                words = np.frombuffer(maps, np.int64).reshape(len(at), WORDS)
                own = nodes.values.to_numpy()[at]
                yield pa.RecordBatch.from_arrays([pa.array(own), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS)]], names=["node", *names])

    return packed.select("nodes", "first", "maps").mapInArrow(run, "node long, " + ", ".join(f"{n} long" for n in names))


def by_bucket(tokens: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, distinct tokens, how many of the batch's sets hold each): buckets are ranges of hashes."""
    distinct, counts = np.unique(tokens, return_counts=True)
    cuts = np.searchsorted(distinct, np.array([(b << 64) // n_buckets for b in range(1, n_buckets)], dtype=np.uint64))
    edges = [0, *cuts.tolist(), len(distinct)]
    for b in range(n_buckets):
        if edges[b] < edges[b + 1]:
            yield b, distinct[edges[b] : edges[b + 1]], counts[edges[b] : edges[b + 1]]


def ask(packed: DataFrame, n_buckets: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                out = [(b, batch, x.tobytes(), n.astype(np.uint32).tobytes()) for b, x, n in by_bucket(np.frombuffer(blob, np.uint64), n_buckets)]
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["bucket", "batch", "tokens", "counts"])

    return packed.select("batch", "tokens").mapInArrow(run, "bucket int, batch long, tokens binary, counts binary")


def answer(rows: pa.Table) -> pa.Table:
    """For each batch the places, in its question, of the tokens that more than one set holds, and which are frequent."""
    asked = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("counts").to_pylist()])
    distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
    held = np.bincount(place, weights=counts, minlength=len(distinct))[place]
    out, at = [], 0
    for x in asked:
        mine = held[at : at + len(x)]
        at += len(x)
        shared = np.flatnonzero(mine > 1)
        out.append((shared.astype(np.uint32).tobytes(), (mine[shared] > RARE).tobytes()))
    return pa.table({"bucket": rows.column("bucket"), "batch": rows.column("batch"), "places": pa.array([o[0] for o in out], pa.binary()), "often": pa.array([o[1] for o in out], pa.binary())})


def looked_up(tokens: np.ndarray, n_buckets: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each token of a batch whether more than one set holds it, and whether it is frequent."""
    known = {r["bucket"]: r for r in answers.to_pylist()}
    shared, often = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for b, distinct, _ in by_bucket(tokens, n_buckets):
        shared.append(distinct[np.frombuffer(known[b]["places"], np.uint32)])
        often.append(np.frombuffer(known[b]["often"], bool))
    shared, often = np.concatenate(shared), np.concatenate(often)  # buckets are ranges: still in order
    if not len(shared):
        return np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
    at = np.searchsorted(shared, tokens).clip(max=len(shared) - 1)
    found = shared[at] == tokens
    return found, found & often[at]


def slices(lengths: bytes) -> Iterator[slice]:
    begin = 0
    for length in np.frombuffer(lengths, np.uint32).tolist():
        yield slice(begin, begin + length)
        begin += length


ENTRIES = "entry long, node long, n long, rare binary, frequent binary"


def write_entries(n_buckets: int, t: tuple[int, int]):
    """Entries of the sets whose prefix is rare low tokens; of the others their shared low tokens, rare and frequent."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        entries, nodes, sizes, rares, frequents = [], [], [], [], []
        for row in left.to_pylist():
            tokens = np.frombuffer(row["tokens"], np.uint64)
            known, frequent = looked_up(tokens, n_buckets, right)
            for first, mine in zip(np.frombuffer(row["first"], np.uint32).tolist(), slices(row["lengths"]), strict=True):
                n, often = row["sizes"][first], frequent[mine]
                places = np.flatnonzero(~often)[: prefix_length(n, t)]
                if len(places) == prefix_length(n, t):
                    found = signed(tokens[mine][places][known[mine][places]]).tolist()
                    entries.extend(found)
                    rares.extend([None] * len(found))
                    frequents.extend([None] * len(found))
                else:
                    found = [None]
                    entries.append(None)
                    rares.append(tokens[mine][known[mine] & ~often].tobytes())
                    frequents.append(tokens[mine][often].tobytes())
                nodes.extend([row["nodes"][first]] * len(found))
                sizes.extend([n] * len(found))
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2
        return pa.table([pa.array(c, k) for c, k in zip((entries, nodes, sizes, rares, frequents), kinds, strict=True)], names=["entry", "node", "n", "rare", "frequent"])

    return run


def open_batches(sets: DataFrame) -> DataFrame:
    """Batches of sets with all their tokens (``sets``: node, n, tokens, rare, frequent). ``others``: those that are not low."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, names = TaskContext.get().partitionId() << 32, ["batch", "nodes", "sizes", "tokens", "lengths", "known", "frequent", "others", "total"]
        nodes, sizes, lists, known, frequent, total = [], [], [], [], [], 0

        def done() -> pa.RecordBatch:
            flat = np.concatenate(lists)
            others = flat[flat >= np.uint64(LOW)]
            blobs = [flat, np.array([len(x) for x in lists], np.uint32), np.concatenate(known), np.concatenate(frequent), others]
            lists_of = [pa.array([v], pa.list_(pa.int64())) for v in (nodes, sizes)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists_of, *[pa.array([b.tobytes()], pa.binary()) for b in blobs], pa.array([len(others)], pa.int64())], names=names)

        for part in parts:
            for node, n, blob, rare, often in zip(*part.columns, strict=True):
                tokens = np.frombuffer(blob.as_buffer(), np.uint64)
                nodes.append(node.as_py())
                sizes.append(n.as_py())
                lists.append(tokens)
                known.append(np.isin(tokens, np.frombuffer(rare.as_buffer(), np.uint64), assume_unique=True))
                frequent.append(np.isin(tokens, np.frombuffer(often.as_buffer(), np.uint64), assume_unique=True))
                total += len(tokens)
                if len(nodes) >= BATCH_SETS or total >= BATCH_TOKENS:
                    yield done()
                    number += 1
                    nodes, sizes, lists, known, frequent, total = [], [], [], [], [], 0
        if nodes:
            yield done()

    schema = "batch long, nodes array<bigint>, sizes array<bigint>, tokens binary, lengths binary, known binary, frequent binary, others binary, total long"
    return sets.select("node", "n", "tokens", "rare", "frequent").mapInArrow(run, schema)


def write_open_entries(n_buckets: int, t: tuple[int, int]):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        bands = Bands(t)
        entries, nodes, sizes = [], [], []
        for row in left.to_pylist():
            tokens = np.frombuffer(row["tokens"], np.uint64)
            low = tokens < np.uint64(LOW)
            held, often = looked_up(tokens[~low], n_buckets, right)
            frequent = np.frombuffer(row["frequent"], bool).copy()
            frequent[~low] = often
            known = np.frombuffer(row["known"], bool) | frequent
            known[~low] = held
            rank = np.where(frequent, 2, np.where(low, 0, 1))
            for node, n, mine in zip(row["nodes"], row["sizes"], slices(row["lengths"]), strict=True):
                order = np.argsort(rank[mine], kind="stable")[: bands.longest(n)]
                kept = np.flatnonzero(known[mine][order])
                found = bands.entries(n, kept.tolist(), tokens[mine][order][kept].tolist(), frequent[mine][order][kept].tolist())
                entries.extend(found)
                nodes.extend([node] * len(found))
                sizes.extend([n] * len(found))
        return pa.table({"entry": pa.array(signed(entries)), "node": pa.array(nodes, pa.int64()), "n": pa.array(sizes, pa.int64())})

    return run


def answered(packed: DataFrame) -> tuple[DataFrame, int]:
    """What the batches (batch, tokens, total) ask, answered by bucket and batch; the number of buckets."""
    total = packed.agg(F.sum("total")).first()[0] or 0
    n_buckets = max(1, -(-total // BUCKET_TOKENS))
    return staged(ask(packed, n_buckets).groupBy("bucket").applyInArrow(answer, "bucket int, batch long, places binary, often binary")), n_buckets


def index_entries(docs: DataFrame, text: str, id_column: str, packed: DataFrame, owners: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(entry, node, n): every index entry of every node once."""
    answers, n_buckets = answered(packed)
    sets = packed.select("batch", "nodes", "sizes", "tokens", "lengths", "first")
    found = staged(sets.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(write_entries(n_buckets, t), ENTRIES))
    rare = found.where("frequent IS NULL").select("entry", "node", "n")
    still_open = staged(found.where("frequent IS NOT NULL").drop("entry").dropDuplicates(["node"]))
    wanted = still_open.select("node").join(owners, "node").select("id")
    # One set per node: copies have been one row all the way, and what the filter lets through by chance finds no partner.
    whole = full_sets(docs, text, id_column, wanted).join(still_open, "node").dropDuplicates(["node"])
    again = staged(open_batches(whole))
    answers, n_buckets = answered(again.select("batch", F.col("others").alias("tokens"), "total"))
    by_batch = again.groupBy("batch").cogroup(answers.groupBy("batch"))
    common = by_batch.applyInArrow(write_open_entries(n_buckets, t), "entry long, node long, n long")
    return rare.unionByName(common).distinct()


def with_bit(rows: DataFrame) -> DataFrame:
    """Add the place of an id in a bitmap of 2**FILTER_BITS bits: a part and a bit in it."""
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)) + 1
    return rows.withColumn("part", F.bitmap_bucket_number(bit)).withColumn("bit", F.bitmap_bit_position(bit))


def full_sets(docs: DataFrame, text: str, id_column: str, wanted: DataFrame) -> DataFrame:
    """(node, tokens) of the documents ``wanted`` (id); some others may come too. Only those texts are read by Python."""
    parts = with_bit(wanted).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)).alias("id"), F.col(text).cast("binary").alias("t"))
    # The bitmap has at most 2**FILTER_BITS bits, 8 MB, whatever the number of ids.
    rows = with_bit(rows).join(F.broadcast(staged(parts)), "part")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int"))) != 0).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found, sets = [], []
            for value in batch.column(0):
                tokens = shingle_set(value.as_py(), hashes)
                found.append(digest(tokens))
                sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])

    return rows.mapInArrow(run, "node long, tokens binary")


def verify(pairs: DataFrame, docs: DataFrame, text: str, id_column: str, owners: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b, linked, distance) of pairs of nodes: whether their sets reach the threshold, and 1 - similarity."""
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = full_sets(docs, text, id_column, used.join(owners, "node").select("id"))
    # Copies that pass the filter by chance would only repeat a pair.
    with_b = pairs.join(sets.withColumnsRenamed({"node": "b", "tokens": "y"}), "b")
    both = with_b.join(sets.withColumnsRenamed({"node": "a", "tokens": "x"}), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, distance = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                union = len(np.unique(np.concatenate([u, v])))
                common = len(u) + len(v) - union
                linked.append(t[1] * common >= t[0] * union)
                distance.append(1 - common / union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(distance, pa.float64())], names=["a", "b", "linked", "distance"])

    return both.mapInArrow(run, "a long, b long, linked boolean, distance double").dropDuplicates(["a", "b"])


def close_in_size(n: Column, m: Column, t: tuple[int, int]) -> Column:
    return F.least(n, m) * t[1] >= F.greatest(n, m) * t[0]


def ordered_pairs(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def may_link(t: tuple[int, int], n: str = "k", distance: str = "e") -> Column:
    """What the sizes and the distances to one common pivot leave open: the distance 1 - Jaccard is a metric."""
    apart = F.abs(F.col("distance") - F.col(distance)) > (1 - t[0] / t[1]) + 1e-9
    return close_in_size(F.col("n"), F.col(n), t) & ~F.coalesce(apart, F.lit(False))


def linked_nodes(docs: DataFrame, text: str, id_column: str, packed: DataFrame, owners: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(node, root) of all nodes that have a link; root is the same for a whole component."""
    entries = staged(index_entries(docs, text, id_column, packed, owners, t))
    pivot = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("m"), F.col("n").alias("k")))
    counts = entries.groupBy("entry").agg(F.count("*").alias("held"), pivot.alias("p")).where("held > 1")
    entries = staged(entries.join(counts, "entry").select("entry", "node", "n", "held", "p.m", "p.k"))
    small, large = entries.where(F.col("held") <= SMALL), entries.where(F.col("held") > SMALL)
    other = small.select("entry", F.col("node").alias("m"), F.col("n").alias("k"))
    close = small.drop("m", "k").join(other, "entry").where(F.col("node") < F.col("m")).unionByName(large.where("node <> m"), allowMissingColumns=True)
    pairs = staged(close.where(close_in_size(F.col("n"), F.col("k"), t)).select(*ordered_pairs("node", "m")).distinct())
    done = staged(verify(pairs, docs, text, id_column, owners, t))
    # What remains of the large entries: each row with its distance to the entry's pivot.
    known = done.select(*[F.col(c).alias(f"_{c}") for c in ("a", "b")], "distance")
    rows = large.join(known, (F.least("node", "m") == F.col("_a")) & (F.greatest("node", "m") == F.col("_b")), "left")
    rows = staged(rows.select("entry", "node", "n", F.when(F.col("node") == F.col("m"), 0.0).otherwise(F.col("distance")).alias("distance")))
    roots = components(done.where("linked"))
    # Pivots say nothing of pairs of two others, so the last round is never left out.
    for n_pivots in (*PIVOTS, None):
        rows = unsettled(rows.drop("root"), roots)
        if n_pivots is None:
            more = still_open(rows, parity_maps(packed), t)
        else:
            more = with_pivots(rows, n_pivots).where(F.col("root") != F.col("r")).where(may_link(t))
        more = more.select(*ordered_pairs("node", "m")).distinct()
        pairs = staged(more.join(done, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            checked = staged(verify(pairs, docs, text, id_column, owners, t))
            done = done.unionByName(checked)
            roots = merged_roots(roots, checked.where("linked"))
    return roots


def merged_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links (a, b): only their ends' roots are a graph, and what they join is renamed."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    known = staged(roots.unionByName(ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))))
    name = lambda end, out: known.select(F.col("node").alias(end), F.col("root").alias(out))
    between = links.select("a", "b").join(name("a", "ra"), "a").join(name("b", "rb"), "b")
    joined = components(between.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    new = joined.select(F.col("node").alias("root"), F.col("root").alias("least"))
    return staged(known.join(new, "root", "left").select("node", F.coalesce("least", "root").alias("root")))


def still_open(rows: DataFrame, maps: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(node, m) of two sets of one entry that may link, by components, sizes, distances and parity maps.

    Two sets that can link are in one band of sizes or in bands side by side, so the band is a key of the join. Two sets
    of an entry's largest component need not meet: only the others look for partners. A pair that shares many entries is
    made at the first of them, and at a later one only if that first one is not among the ``FIRST`` least of both sets.
    Where the distances rule a pair out at its first entry, it does not link, so nothing is lost by leaving out the rest.
    """
    words = [f"m{i}" for i in range(WORDS)]
    place = F.row_number().over(Window.partitionBy("node").orderBy("entry"))
    least = rows.select("node", "entry", place.alias("place")).where(F.col("place") <= FIRST)
    least = least.groupBy("node").agg(F.collect_list("entry").alias("least"))
    held = rows.groupBy("entry", "root").agg(F.count("*").alias("held"))
    largest = held.groupBy("entry").agg(F.max(F.struct("held", "root")).getField("root").alias("main"))
    size = F.floor(F.log("n") / (float(np.log(t[1] / t[0])) + 1e-9))
    mapped = rows.join(maps.join(least, "node").dropDuplicates(["node"]), "node").join(largest, "entry")
    mapped = staged(mapped.select("entry", "node", "n", "root", "distance", "least", *words, size.alias("size"), (F.col("root") == F.col("main")).alias("inner")))
    names = (("node", "m"), ("n", "k"), ("root", "r"), ("distance", "e"), ("least", "l"), ("inner", "i"), *((w, f"o{w}") for w in words))
    other = mapped.select("entry", F.col("size").alias("band"), *[F.col(c).alias(x) for c, x in names])
    left = mapped.where(~F.col("inner")).withColumn("band", F.explode(F.array(F.col("size") - 1, "size", F.col("size") + 1)))
    different = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"o{w}"))) for w in words), F.lit(0))
    near = different * (t[0] + t[1]) <= (F.col("n") + F.col("k")) * (t[1] - t[0])
    once = F.col("i") | (F.col("size") < F.col("band")) | ((F.col("size") == F.col("band")) & (F.col("node") < F.col("m")))
    before = F.coalesce(F.array_min(F.array_intersect("least", "l")) < F.col("entry"), F.lit(False))
    return left.join(other, ["entry", "band"]).where(once & (F.col("root") != F.col("r")) & may_link(t) & near & ~before).select("node", "m")


def unsettled(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of entries whose sets are not all in one component, with their roots."""
    rooted = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = rooted.groupBy("entry").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("entry")
    return staged(rooted.join(ends, "entry"))


def with_pivots(rows: DataFrame, n_pivots: int) -> DataFrame:
    """Each row with each of several pivots of its entry: m, and its size k, root r and distance e."""
    first = lambda j: F.min(F.struct(F.xxhash64("node", F.lit(j)).alias("h"), F.col("node").alias("m"), F.col("n").alias("k"), F.col("root").alias("r"), F.col("distance").alias("e")))
    pivots = rows.groupBy("entry").agg(*[first(j).alias(f"p{j}") for j in range(n_pivots)])
    each = rows.join(pivots, "entry").withColumn("p", F.explode(F.array(*[f"p{j}" for j in range(n_pivots)])))
    return each.select("node", "n", "root", "distance", "p.m", "p.k", "p.r", "p.e")


def rooted_nodes(docs: DataFrame, text: str, id_column: str, t: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(id, node, n) of every row, null ids as LEAST; (node, id, root) of every node but EMPTY, with its least id."""
    packed = staged(batches(docs, text, id_column, t))
    members = packed.select(F.explode(F.arrays_zip("ids", "nodes", "sizes")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.nodes").alias("node"), F.col("x.sizes").alias("n"))
    owners = staged(members.where(F.col("node") != EMPTY).groupBy("node").agg(F.min("id").alias("id")))
    roots = linked_nodes(docs, text, id_column, packed, owners, t)
    return members, owners.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links reach), node (equal sets share it)."""
    members, rooted = rooted_nodes(docs, text, id_column, threshold)
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = staged(rooted.join(least, "root").select("node", "component_id"))
    # The nodes of single documents need no join to answer for a copy group; hot nodes are narrow rows here.
    joined = members.join(classes, "node", "left")
    value = lambda c: F.when(c != LEAST, c)
    component = F.coalesce("component_id", "id")
    return joined.select(value(F.col("id")).alias(id_column), F.col("n").alias("n_shingles"), value(component).alias("component_id"), "node")


@plain_names
def with_nodes(docs: DataFrame, text: str, out: str) -> DataFrame:
    """All columns of ``docs`` and the node of each row's text."""
    wide, kept, blob = docs.withColumn(out, F.col(text).cast("binary")), docs.columns, out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            found = [digest(shingle_set(value.as_py(), hashes)) for value in part.column(blob)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.int64())], names=[*kept, out])

    return wide.mapInArrow(run, T.StructType([*[field(docs, c) for c in kept], T.StructField(out, T.LongType())]))


@plain_names
def drop_near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row of each component, with its least id; of rows that share that id, and of copies, one stays.

    Rows of the empty set, which are components of their own, all stay.
    """
    members, rooted = rooted_nodes(docs, text, id_column, threshold)
    best = rooted.groupBy("root").agg(F.min(F.struct("id", "node")).alias("k")).select("k.id", "k.node")
    best = staged(best.unionByName(members.where(F.col("node") == EMPTY).select("id", "node").distinct()))
    rows = members.groupBy("id").agg(F.count("*").alias("rows"))
    key, node = fresh(docs, "_id"), fresh(docs, "_node")
    ids = staged(best.select("id").distinct().join(rows, "id").select(F.col("id").alias(key), "rows"))
    own, shared = F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST)), ids.where("rows > 1")
    single = docs.join(ids.where("rows = 1").select(key), own == F.col(key), "left_semi")
    if shared.isEmpty():
        return single
    # An id of several rows does not tell which of them is meant: their texts do. One row of each (id, node) is picked
    # before the join, in part where the rows lie, so that a pair of many rows is few of them afterwards.
    several = with_nodes(docs.join(shared.select(key), own == F.col(key), "left_semi"), text, node)
    apart = fresh(docs, "_apart")
    several = several.withColumn(key, own).withColumn(apart, F.when(F.col(node) == EMPTY, F.monotonically_increasing_id()))
    one = several.dropDuplicates([key, node, apart]).join(best.withColumnsRenamed({"id": key, "node": node}), [key, node], "left_semi")
    return single.unionByName(one.select(*docs.columns))
