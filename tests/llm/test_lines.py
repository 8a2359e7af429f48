from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest

from tallyframe.llm.lines import PerfectHash, dedup_lines


def given():
    data = cases.rows()
    hot = "This line stands in very many documents"
    out = []
    for i, (doc, text, *rest) in enumerate(data):
        if text is not None and i % 3 == 0:
            text = f"{text}\n \t{hot.upper() if i % 2 else hot}\x0b\n{hot}"
        if i in (20, 21, 30):
            text = f"Ünïcödé twenty chars\n{text}\nnineteen characters\n{text}"
        out.append((doc, text, *rest))
    return out


def plain(data):
    keys = lambda t: [cases.lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    holders = defaultdict(list)
    for doc, text, *_ in data:
        for k in set(keys(text)):
            holders[k].append(-1 if doc is None else doc)
    out = Counter()
    for doc, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, keys(text), strict=True) if len(k) < 20 or len(holders[k]) < 3 or max(holders[k]) == (-1 if doc is None else doc)]
        out[(doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("index_bytes", [1 << 20, -1])
def test_against_plain_version(spark, index_bytes):
    data = given()
    docs = cases.table(spark, data)
    got, out = dedup_lines(docs, index_bytes=index_bytes)
    assert got.columns == [*docs.columns, out]
    rows = got.collect()
    assert Counter((r.doc_id, *r[out]) for r in rows) == plain(data)
    for r in rows:
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == r[out].kept_sha256
    assert sum(r[out].n_dropped for r in rows) > 50


def test_small_shards_give_the_same(spark, monkeypatch):
    import tallyframe.llm.lines as module

    monkeypatch.setattr(module.build_index, "__defaults__", (2,))
    got, out = dedup_lines(cases.table(spark, given()))
    assert Counter((r.doc_id, *r[out]) for r in got.collect()) == plain(given())


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64)
    table, sizes, left = PerfectHash.build(keys), [], len(keys)
    for bits in table.levels:
        sizes.append(PerfectHash.slots(left))
        left -= int(np.bitwise_count(bits).sum())
    assert sorted(table.find(keys, sizes)) == list(range(len(keys)))


def test_empty_table(spark):
    assert dedup_lines(cases.table(spark, []))[0].count() == 0
