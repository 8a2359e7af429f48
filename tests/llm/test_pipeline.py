"""The pipeline against plain versions of its stages, each on its own input."""

from __future__ import annotations

import re
from collections import Counter

import cases
import corpus_pipeline
import pytest
from conftest import DATA
from test_decontaminate import plain as contaminated
from test_similarity import shingle_set

from tallyframe.llm.common import staged
from tallyframe.llm.mixture import mixture


@pytest.fixture(scope="module")
def tables(spark):
    docs = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(staged(stage(spark, docs[-1], DATA)))
    return docs


def test_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables[:-1])


def test_quality_follows_the_labels(spark, tables):
    kept = {r.doc_id for r in tables[1].select("doc_id").collect()}
    marks = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    assert sum((r.doc_id in kept) == bool(r.quality) for r in marks) >= 0.95 * len(marks)


def test_no_near_duplicate_is_left_and_none_is_lost(tables):
    before = {r.doc_id: shingle_set(r.text) for r in tables[1].collect()}
    after = {r.doc_id for r in tables[2].collect()}
    near = lambda a, b: bool(a & b) and 4 * len(a & b) >= 3 * len(a | b)
    for doc, mine in before.items():
        close = [d for d, s in before.items() if d != doc and near(mine, s)]
        if doc in after:
            assert not any(d in after for d in close)
        else:
            assert close


def test_contaminated_documents_go(spark, tables):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {r.doc_id for r in tables[2].collect() if not contaminated(r.text, items)[4]}
    assert {r.doc_id for r in tables[3].collect()} == want


def test_mixture_is_taken(tables):
    plan = {r.doc_id: r.taken for r in mixture(tables[3]).collect() if r.taken}
    found = Counter()
    for r in tables[4].collect():
        found[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert found == plan


def test_shards(tables):
    rows = tables[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in tables[4].collect())
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert cases.rows()
