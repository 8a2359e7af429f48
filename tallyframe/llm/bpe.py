"""Byte-level BPE: encoding through a minimal acyclic transducer of frequent words, exact merges of all others, decoding.

1. Texts are cut at special tokens and into the vocabulary's pieces, here called words. All words of all texts are
   counted, in part inside each task; the ``lexicon`` most frequent of at most LONGEST bytes are merged once.
2. Their (bytes, ids) become an acyclic transducer: sorted words are added one by one, ids stand on the earliest arc at
   which they are sure, and states with equal arcs and outputs are one, so that suffixes are shared. It is written as flat
   arrays to one file in the shared folder, which Spark hands to every executor, and workers map it into memory.
3. A word that the transducer does not accept is merged pair by pair: the pair with the least rank first, the leftmost
   of equals; with a heap, so that a word of any length takes n log n steps. Results never depend on the lexicon.

Ids are packed as little-endian unsigned 32-bit integers, the form that training shards take.

Defined cases: a null text is empty and has no ids; bytes that are no UTF-8 become U+FFFD before encoding. Rows and ids
(null or repeated ones too) are kept one for one. Other columns are not looked at. An empty table gives an empty result
and an empty lexicon. A text of any length is cut, packed and decoded piece by piece.
Only byte-level vocabularies of the kind named in ``Vocabulary`` are read; others are refused with an error.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import json
import mmap
import re
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import shared_folder, short_batches

#: Words of the transducer, and the bytes of the longest of them; both bound what comes to the driver.
LEXICON, LONGEST = 300_000, 32
#: Distinct words that a task counts before it hands them on; merged words that a worker remembers.
COUNTED, REMEMBERED = 300_000, 200_000
#: Texts of more characters are cut piece by piece; bytes of a batch of results.
LONG_TEXT, BATCH_BYTES = 1_000_000, 16 << 20
#: Words of at most so many bytes are merged by plain search.
SHORT = 24
#: A pair of ids is one number: the first above so many bits of the second.
SHIFT = 32
SINGLE = [bytes([b]) for b in range(256)]
MAGIC, HEADER = b"tfst0001", "<8s8Q"
#: How this kind of vocabulary cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The token bytes, merges and special tokens of a vocabulary file; small, and broadcast as plain values.

    Read: a BPE model over the byte-level pre-tokenizer with its own pattern, without normalizer, prefix space, dropout,
    unknown token or word marks, with special tokens that match anywhere.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            raw = json.load(file)
        model, cut, added = raw["model"], raw["pre_tokenizer"] or {}, raw["added_tokens"]
        marks = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        kind = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        if not kind or any(marks) or raw["normalizer"] or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        of = {token: bytes(letters[c] for c in token) for token in model["vocab"]}
        self.tokens = {i: of[token] for token, i in model["vocab"].items()} | {t["id"]: t["content"].encode() for t in added}
        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of = [model["vocab"][c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(model["vocab"][a], model["vocab"][b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [model["vocab"][a + b] for a, b in pairs]
        self.strangers = strangers(path)
        #: What a Cutter needs.
        self.cut = (list(self.special), self.strangers, spelled_out(self.strangers))

    def merges(self) -> Merges:
        return Merges(self.bytes_of, self.ranks, self.made)


def strangers(path: str) -> list[int]:
    """Letters and numbers of ``regex`` that the tokenizers library does not know yet, or the other way round.

    Both carry their own Unicode tables, so it is asked about every code point that this Python does not know.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    unknown = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    out, is_known = [], regex.compile(r"[\p{L}\p{N}]")
    for i in range(0, len(unknown), 4096):
        part = unknown[i : i + 4096]
        listed = is_known.findall(part)
        # What both take for neither letter nor number is one word.
        if len(cut("!" + is_known.sub("", part))) == 1 or len(listed) == len(part):
            part = listed
        out += [ord(c) for c in part if len(cut(f"a{c}1{c}")) != len(regex.findall(PATTERN, f"a{c}1{c}"))]
    return out


def cutters(strange: list[int]) -> tuple[regex.Pattern, regex.Pattern, regex.Pattern | None]:
    """The pattern, the same without strange code points among letters and numbers, and one that finds those."""
    usual = regex.compile(PATTERN)
    if not strange:
        return usual, usual, None
    runs, begin = [], 0
    for i in range(1, len(strange) + 1):
        if i == len(strange) or strange[i] != strange[i - 1] + 1:
            runs.append(rf"\U{strange[begin]:08x}-\U{strange[i - 1]:08x}")
            begin = i
    those = "".join(runs)
    exact = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{those}])").replace(r" ?\p{L}+", rf" ?(?:(?![{those}])\p{{L}})+").replace(r" ?\p{N}+", rf" ?(?:(?![{those}])\p{{N}})+")
    return usual, regex.compile(exact), regex.compile(f"[{those}]")


def spelled_out(strange: list[int]) -> str:
    """The pattern with its classes as ranges of code points below U+10000, for texts that have no others."""
    unlike, names = set(strange), {r"\p{L}": r"\p{L}", r"\p{N}": r"\p{N}", r"\s": r"\s"}
    for name in names:
        member = regex.compile(name).match
        inside = [c for c in range(0x10000) if member(chr(c)) and c not in unlike]
        ends = [(a, b) for a, b in itertools.pairwise([-2, *inside, 0x20000]) if b != a + 1]
        names[name] = "".join(f"\\u{begin:04x}-\\u{end:04x}" for (_, begin), (end, _) in itertools.pairwise(ends))
    letters, numbers, spaces = names.values()
    out = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return out.replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")


class Cutter:
    """Cuts texts into words and special tokens."""

    def __init__(self, special: Iterable[str], strange: list[int], spelled: str):
        self.tokens = sorted(special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, self.tokens)) + ")")
        self.usual, self.exact, self.strange = cutters(strange)
        self.plain, self.others = re.compile(spelled), re.compile("[\U00010000-\U0010ffff]")

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text without special tokens, in lists of bounded length."""
        pattern = self.plain
        if not text.isascii() and self.others.search(text):
            pattern = self.exact if self.strange and self.strange.search(text) else self.usual
        if len(text) <= LONG_TEXT:
            yield pattern.findall(text)
        else:
            found = (m.group() for m in pattern.finditer(text))
            while piece := list(itertools.islice(found, LONG_TEXT)):
                yield piece

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(whether it is a special token, text) in turn."""
        if not any(token in text for token in self.tokens):
            yield False, text
        else:
            for i, part in enumerate(self.special.split(text)):
                if part:
                    yield i % 2 == 1, part


class Merges:
    """Exact merging: of all neighbours the pair of least rank is merged first, the leftmost of equals."""

    def __init__(self, bytes_of: list[int], ranks: dict[tuple[int, int], int], made: list[int]):
        self.first = bytes_of
        self.ranks = {a << SHIFT | b: rank for (a, b), rank in ranks.items()}
        self.made = made

    def __call__(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.first[b] for b in word]
        if len(ids) > SHORT:
            return self.with_heap(ids)
        ranks, made, none = self.ranks.get, self.made, len(self.made)
        # The rank of each id with the one after it; the last has none.
        next_rank = [ranks(a << SHIFT | b, none) for a, b in itertools.pairwise(ids)] + [none]
        while next_rank and (rank := min(next_rank)) < none:
            i = next_rank.index(rank)
            ids[i] = new = made[rank]
            del ids[i + 1], next_rank[i]
            next_rank[i] = ranks(new << SHIFT | ids[i + 1], none) if i + 1 < len(ids) else none
            if i:
                next_rank[i - 1] = ranks(ids[i - 1] << SHIFT | new, none)
        return ids

    def with_heap(self, ids: list[int]) -> list[int]:
        """The same in n log n steps."""
        ranks, n = self.ranks.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i, (a, b) in enumerate(itertools.pairwise(ids)) if (rank := ranks(a << SHIFT | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ranks(ids[i] << SHIFT | ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (found := ranks(ids[left] << SHIFT | ids[right])) is not None:
                    heapq.heappush(heap, (found, left))
        return [i for i in ids if i >= 0]


def common_start(a, b) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class Builder:
    """A minimal acyclic transducer from sorted, distinct words to sequences of ids."""

    def __init__(self):
        self.states: list[tuple] = []  # (final output or None, ((label, target, output), ...)) of finished states
        self.register: dict[tuple, int] = {}

    def finish(self, final, arcs: dict[int, list]) -> int:
        state = (final, tuple((label, target, output) for label, (target, output) in sorted(arcs.items())))
        if state not in self.register:
            self.register[state] = len(self.states)
            self.states.append(state)
        return self.register[state]

    def build(self, entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> int:
        """Add all entries; returns the first state."""
        last = b""
        finals: list = [None]  # of the states along the last word
        arcs: list[dict[int, list]] = [{}]

        def close(down_to: int) -> None:
            while len(arcs) - 1 > down_to:
                state = self.finish(finals.pop(), arcs.pop())
                arcs[-1][last[len(arcs) - 1]][0] = state

        for word, output in entries:
            same = common_start(last, word)
            close(same)
            for i in range(same):  # what the words do not have in common moves on to the arcs behind
                arc = arcs[i][word[i]]
                n = common_start(arc[1], output)
                left, output = arc[1][n:], output[n:]
                if left:
                    arc[1] = arc[1][:n]
                    for other in arcs[i + 1].values():
                        other[1] = left + other[1]
                    if finals[i + 1] is not None:
                        finals[i + 1] = left + finals[i + 1]
            for i in range(same, len(word)):
                arcs[i][word[i]] = [None, output]
                output = ()
                arcs.append({})
                finals.append(None)
            finals[-1] = output
            last = word
        close(0)
        return self.finish(finals[0], arcs[0])

    def packed(self, first: int) -> bytes:
        """Flat arrays: labels; arcs of each state; final outputs; targets and outputs of arcs; all outputs."""
        pool: dict[tuple, int] = {(): 0}
        labels, starts, finals, targets, outputs = bytearray(), [0], [], [], []
        for final, arcs in self.states:
            finals.append(0 if final is None else 1 + pool.setdefault(final, len(pool)))
            for label, target, output in arcs:
                labels.append(label)
                targets.append(target)
                outputs.append(pool.setdefault(output, len(pool)))
            starts.append(len(labels))
        ids, places = [i for output in pool for i in output], [0, *itertools.accumulate(map(len, pool))]
        lists = (starts, finals, targets, outputs, places, ids)
        n_labels = len(labels)
        labels += bytes(-len(labels) % 4)
        head = struct.pack(HEADER, MAGIC, first, n_labels, *map(len, lists))
        return head + bytes(labels) + b"".join(struct.pack(f"<{len(x)}I", *x) for x in lists)


class Transducer:
    """A packed transducer, read where it lies."""

    def __init__(self, data: mmap.mmap | bytes):
        _, self.first, n_labels, *sizes = struct.unpack_from(HEADER, data)
        self.data, self.labels = data, struct.calcsize(HEADER)
        at, view = self.labels + n_labels + -n_labels % 4, memoryview(data)
        arrays = []
        for n in sizes:
            arrays.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.starts, self.finals, self.targets, self.outputs, self.places, self.ids = arrays

    def lookup(self, word: bytes) -> list[int] | None:
        state, find, begin, out = self.first, self.data.find, self.labels, []
        starts, outputs, targets = self.starts, self.outputs, self.targets
        for b in word:
            at = find(SINGLE[b], begin + starts[state], begin + starts[state + 1]) - begin
            if at < 0:
                return None
            if output := outputs[at]:
                out.extend(self.ids[self.places[output] : self.places[output + 1]])
            state = targets[at]
        final = self.finals[state]
        if not final:
            return None
        out.extend(self.ids[self.places[final - 1] : self.places[final]])
        return out


def transducer(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The packed transducer of sorted, distinct (word, ids)."""
    builder = Builder()
    return builder.packed(builder.build(entries))


class Coder(dict):
    """Packed ids by word: the transducer's, which are remembered, or exactly merged, remembered up to a bound."""

    def __init__(self, lexicon: Transducer, merges: Merges):
        super().__init__()
        self.lexicon, self.merges, self.rare = lexicon, merges, {}

    def pack(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))

    def __missing__(self, word: str) -> bytes:
        if (packed := self.rare.get(word)) is not None:
            return packed
        raw = word.encode()
        ids = self.lexicon.lookup(raw) if len(raw) <= LONGEST else None
        kept = self.rare if ids is None else self
        if ids is None:
            ids = self.merges(raw)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= LONGEST:
            if kept is self.rare and len(kept) >= REMEMBERED:
                kept.clear()
            kept[word] = packed
        return packed


def decoded_text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def word_counts(docs: DataFrame, text: str, cutter: tuple[list[str], list[int], str]) -> DataFrame:
    """(word, n) of all words of at most LONGEST bytes in all texts; words may come in several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = Cutter(*cutter), Counter()

        def done() -> pa.RecordBatch:
            kept = [(w, n) for w, n in ((w.encode(), n) for w, n in counts.items()) if len(w) <= LONGEST]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for value in batch.column(0):
                for special, part in cut.parts(decoded_text(value.as_py())):
                    if not special:
                        for words in cut.words(part):
                            counts.update(words)
                if len(counts) >= COUNTED:
                    yield done()
                    counts.clear()
        yield done()

    return docs.select(quoted(text).cast("binary").alias("t")).mapInArrow(run, "word binary, n long")


def write_shared(spark: SparkSession, data: bytes) -> str:
    """Write one small file into the shared folder; returns its path."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lexicon-{uuid.uuid4().hex}.fst")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path.toString()


def lexicon_file(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", size: int = LEXICON) -> str:
    """Compile the most frequent words of all texts into a transducer that every executor gets; returns its file's name."""
    spark = docs.sparkSession
    short_batches(spark)
    counts = word_counts(docs, text, vocabulary.cut).groupBy("word").agg(F.sum("n").alias("n"))
    # At most ``size`` words of at most LONGEST bytes.
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(size).select("word").toArrow().column("word").to_pylist()
    merged = vocabulary.merges()
    path = write_shared(spark, transducer((w, tuple(merged(w))) for w in sorted(top)))
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def with_values(batch: pa.RecordBatch, function: Callable[[bytes | None], bytes | str], name: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The first column beside ``function`` of the second one, as batches of bounded bytes."""
    values, size, begin = [], 0, 0
    for i, value in enumerate(batch.column(1)):
        values.append(function(value.as_py()))
        size += len(values[-1])
        if size >= BATCH_BYTES or i == batch.num_rows - 1:
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(values)), pa.array(values, kind)], names=["id", name])
            values, size, begin = [], 0, i + 1


def encode(docs: DataFrame, vocabulary: Vocabulary, *, id_column: str = "doc_id", text: str = "text", lexicon: str | None = None) -> DataFrame:
    """One row per document: its id, and ``ids``, packed. ``lexicon``: a file of ``lexicon_file``, else one is made of ``docs``."""
    spark = docs.sparkSession
    short_batches(spark)
    name = lexicon or lexicon_file(docs, vocabulary, text=text)
    cutter = vocabulary.cut
    # Bounded by the vocabulary file. The last part is empty: each worker keeps its coder there from task to task.
    shared = spark.sparkContext.broadcast((vocabulary.bytes_of, vocabulary.ranks, vocabulary.made, vocabulary.special, {}))
    rows = docs.select(quoted(id_column).alias("id"), quoted(text).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *merges, special, kept = shared.value
        if name not in kept:
            with open(SparkFiles.get(name), "rb") as file:
                words = Transducer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
            kept[name] = Coder(words, Merges(*merges))
        cut, coder = Cutter(*cutter), kept[name]
        specials = {token: struct.pack("<I", i) for token, i in special.items()}

        def packed(value: bytes | None) -> bytes:
            out = []
            for is_special, part in cut.parts(decoded_text(value)):
                out.extend([specials[part]] if is_special else map(coder.pack, cut.words(part)))
            return b"".join(out)

        for batch in batches:
            yield from with_values(batch, packed, "ids", pa.binary())

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary").select(F.col("id").alias(id_column), "ids")


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row: its id and ``text``, the bytes of its tokens as UTF-8; what is no UTF-8 becomes U+FFFD."""
    short_batches(encoded.sparkSession)
    # Bounded by the vocabulary file.
    shared = encoded.sparkSession.sparkContext.broadcast([vocabulary.tokens.get(i, b"") for i in range(max(vocabulary.tokens) + 1)])
    rows = encoded.select(quoted(id_column).alias("id"), quoted(ids).alias("t"))
    step = 4 * LONG_TEXT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__

        def text(value: bytes | None) -> str:
            utf8, out = codecs.getincrementaldecoder("utf-8")("replace"), []
            for i in range(0, len(value or b""), step):
                piece = memoryview(value)[i : i + step].cast("I")
                out.append(utf8.decode(b"".join(map(token, piece))))
            return "".join([*out, utf8.decode(b"", True)])

        for batch in batches:
            yield from with_values(batch, text, "text", pa.string())

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").select(F.col("id").alias(id_column), "text")
