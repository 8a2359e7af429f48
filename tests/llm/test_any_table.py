"""Every operator that carries a table, on one with awkward column names, null ids, repeated rows, and no row."""

from __future__ import annotations

import random
from collections import Counter

import cases
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import bpe, decontaminate, extract, fingerprint, language_model, lines, mixture, quality, sharding, similarity, toxicity

ODD = {"_id": "x", "_p": 1, "_h": 2, "_mark": "m", "_e": 0.5, "_row": 3, "_size": 4, "a.b": "dots", "with space": 1, "column0": "taken", "_t_n": 1}


def awkward(spark, rows):
    return cases.table(spark, rows).withColumns({c: F.lit(v) for c, v in ODD.items()})


@pytest.fixture(scope="module")
def beside(spark):
    rng = random.Random(1)
    labels = [(i, rng.randrange(2), rng.randrange(2), "l", 1.0) for i in range(0, 100, 2)]
    labels = spark.createDataFrame([*labels, labels[0], (None, 1, 1, "l", 1.0), (3, None, None, "l", 1.0)], "doc_id long, quality int, toxic int, `a.b` string, `_e` double")
    words = cases.rows()[6][1].split()
    benchmark = spark.createDataFrame([("a", " ".join(words[100:140]), 1), ("b", None, 1), (None, "x y", 1)], "item_id string, text string, `_id` int")
    return labels, benchmark


OPERATORS = {
    "mix": lambda docs, labels, benchmark: mixture.mix(docs),
    "contamination": lambda docs, labels, benchmark: decontaminate.contamination(docs, benchmark)[0],
    "decontaminate": lambda docs, labels, benchmark: decontaminate.decontaminate(docs, benchmark, action="cut"),
    "drop_near_duplicates": lambda docs, labels, benchmark: similarity.drop_near_duplicates(docs),
    "dedup_lines": lambda docs, labels, benchmark: lines.dedup_lines(docs)[0],
    "dedup_lines_without_broadcast": lambda docs, labels, benchmark: lines.dedup_lines(docs, index_bytes=0)[0],
    "quality": lambda docs, labels, benchmark: quality.score(docs, labels)[0],
    "keep_good": lambda docs, labels, benchmark: quality.keep_good(docs, labels),
    "toxicity": lambda docs, labels, benchmark: toxicity.score(docs, labels)[0],
    "extract": lambda docs, labels, benchmark: extract.extract(docs, html_column="text", order="source")[0],
}
NARROW = {
    "mixture": lambda docs: mixture.mixture(docs),
    "fingerprint": lambda docs: fingerprint.compare(docs, samples=8),
    "near_duplicates": lambda docs: similarity.near_duplicates(docs),
    "language_model": lambda docs: language_model.score(docs),
    "shard": lambda docs: sharding.shard(docs),
    "encode": lambda docs: bpe.encode(docs, bpe.Vocabulary(__import__("public_tokenizers").path("byte_bpe_50k.json"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_all_columns_come_through(spark, beside, name):
    docs = awkward(spark, cases.rows())
    out = OPERATORS[name](docs, *beside)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows
    kept = [r.asDict() for r in rows]
    assert all(r[c] == v for r in kept for c, v in ODD.items())
    if name not in ("mix", "drop_near_duplicates", "keep_good"):
        assert Counter(r["doc_id"] for r in kept) == Counter(r[0] for r in cases.rows())
    assert OPERATORS[name](awkward(spark, []), *beside).collect() == []


@pytest.mark.parametrize("name", NARROW)
def test_one_row_per_document(spark, name):
    out = NARROW[name](awkward(spark, cases.rows())).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in cases.rows())
    assert NARROW[name](awkward(spark, [])).collect() == []


def test_pipeline_stages(spark, beside, tmp_path):
    labels, benchmark = beside
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (cases.rows(), []):
        docs = awkward(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == before.columns
        assert (docs.count() > 0) == bool(rows)
