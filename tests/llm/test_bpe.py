"""Byte-level BPE against the tokenizers library, and the transducer against a dictionary."""

from __future__ import annotations

import hashlib
import random
import struct
import time

import public_tokenizers
import pytest
from cases import rows
from conftest import DATA
from tokenizers import Tokenizer

from tallyframe.llm import bpe
from tallyframe.llm.bpe import Builder, Cutter, Transducer, Vocabulary, decode, encode, transducer
from tallyframe.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def awkward(n: int = 200) -> list[str]:
    rng = random.Random(3)
    letters = "abcé ßİſ中文字🙂́‍  \u0085\x1c\x00\t\r\n '!?-—0٣²ⅧᲉ\U00010d40\U00011de0՘"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    known = ["it's we'll I'VE 'd 're", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|", "   x   ", " \n\n ", "aaaaaaaa" * 50, "�", "x" * 3000, "中" * 2000]
    return [*made, *known]


def test_whole_texts_agree_with_the_library(spark, vocabulary, library):
    texts = [None, "", *awkward(), *[r[1] for r in rows()]]
    data = [(i if i % 5 else None, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids string, `a.b` int").repartition(4)
    found = encode(docs, vocabulary)
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in found.collect())
    expected = []
    for i, t in data_pairs(data):
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i is None, i or 0, struct.pack(f"<{len(ids)}I", *ids)))
    assert got == sorted(expected)
    back = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in decode(found, vocabulary).collect())
    assert back == sorted((i is None, i or 0, t or "") for i, t in data_pairs(data))


def data_pairs(data):
    return [(r[0], r[1]) for r in data]


def test_every_code_point_is_cut_as_the_library_does(vocabulary, library):
    cut, letters = Cutter(*vocabulary.cut), {v: k for k, v in bpe.byte_letters().items()}
    for start in range(0, 0x110000, 97):
        for c in {chr(start), *map(chr, vocabulary.strangers[start // 97 :: 12_000])}:
            if not "\ud800" <= c <= "\udfff":
                text = f"a{c}1{c}!{c} {c}{c}b"
                words = [w for part in cut.words(text) for w in part]
                assert ["".join(letters[b] for b in w.encode()) for w in words] == [w for w, _ in library.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_decoding_of_any_ids(spark, vocabulary, library):
    rng = random.Random(1)
    lists = [[], [50256], *[[rng.randrange(50_257) for _ in range(rng.randrange(1, 30))] for _ in range(200)]]
    packed = spark.createDataFrame([(i, bytearray(struct.pack(f"<{len(x)}I", *x))) for i, x in enumerate(lists)], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in decode(packed, vocabulary).collect()}
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}


def test_transducer_against_a_dictionary():
    rng = random.Random(0)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 8))) for _ in range(600)}
    entries = {w: tuple(rng.randrange(9) for _ in range(rng.randrange(0, 5))) for w in words}
    machine = Transducer(transducer(sorted(entries.items())))
    for w in [*entries, *[bytes(rng.choice(b"abcd") for _ in range(rng.randrange(9))) for _ in range(500)]]:
        found = machine.lookup(w)
        assert (None if found is None else tuple(found)) == entries.get(w)
    assert Transducer(transducer([])).lookup(b"a") is None


def test_transducer_shares_suffixes():
    """Without outputs it is the minimal automaton: as many states as there are different sets of endings."""
    words = sorted({a + b + c for a in (b"x", b"yy", b"z") for b in (b"", b"un") for c in (b"ing", b"ed", b"er", b"")})
    endings = {w[:i]: None for w in words for i in range(len(w) + 1)}
    different = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in endings}
    builder = Builder()
    builder.build((w, ()) for w in words)
    assert len(builder.states) == len(different)


def test_long_words_and_long_texts(vocabulary, library, monkeypatch):
    start = time.perf_counter()
    word = ("abcdefgh" * 40_000).encode()
    assert vocabulary.merges()(word) == library.encode(word.decode(), add_special_tokens=False).ids
    assert time.perf_counter() - start < 30
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    text = "some words, more words " * 20
    assert [w for part in Cutter([], [], bpe.spelled_out([])).words(text) for w in part] == [w for w in bpe.cutters([])[0].findall(text)]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_empty_table(spark, vocabulary):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary).collect() == []


def test_registered_query(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_bpe_encoding_decoding"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(docs) == len(got)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        raw = library.decode(ids, skip_special_tokens=False).encode()
        assert got[d.doc_id] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(raw).hexdigest())
