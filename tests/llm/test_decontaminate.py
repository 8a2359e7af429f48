from __future__ import annotations

import hashlib
import re
from collections import Counter

import cases
import pytest

from tallyframe.llm.decontaminate import contamination, decontaminate


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", cases.lower(text or ""))


def plain(text, items, window=13):
    w, hit, named = tokens(text), set(), set()
    for item, t in items:
        x = tokens(t)
        n = min(window, len(x))
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1 if grams else 0):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                if item is not None:
                    named.add(str(item))
    digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
    return len(w), len(hit), len(named), digest, len(hit) > 0 and 20 * len(hit) >= len(w)


def given(spark):
    data = cases.rows()
    long = tokens(data[6][1])
    items = [(1, " ".join(long[100:140])), (2, "one two"), (11, "ONE, two!"), (3, None), (4, ""), (5, "?!"), (None, "no id here"), (6, data[7][1]), (6, data[7][1]), (7, " ".join(long[-13:]))]
    data = [*data, (500, f"Quite {data[7][1][:90]}", "en", "a", 1, None, None, None)]
    return data, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 20])
def test_against_plain_version(spark, block_bytes):
    data, items, bench = given(spark)
    docs = cases.table(spark, data)
    got, out = contamination(docs, bench, block_bytes=block_bytes)
    assert out == "contamination_" and got.columns == [*docs.columns, out]
    found = Counter((r.doc_id, r[out].n_words, r[out].n_hit, r[out].n_items, r[out].items_sha256, r[out].contaminated) for r in got.collect())
    assert found == Counter((r[0], *plain(r[1], items)) for r in data)


def test_spans_are_cut(spark):
    data, items, bench = given(spark)
    docs = cases.table(spark, data)
    kept = decontaminate(docs, bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in data if not plain(r[1], items)[4])
    cut = {r.doc_id: r.text for r in decontaminate(docs, bench, action="cut").collect()}
    for r in data:
        if plain(r[1], items)[4]:
            assert len(tokens(cut[r[0]])) == len(tokens(r[1])) - plain(r[1], items)[1]
        else:
            assert cut[r[0]] == r[1]


def test_empty_tables(spark):
    data, _, bench = given(spark)
    assert contamination(cases.table(spark, []), bench)[0].count() == 0
    assert decontaminate(cases.table(spark, data), bench.limit(0)).count() == len(data)
