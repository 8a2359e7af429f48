from __future__ import annotations

import itertools
import random

import cases
import numpy as np
import pytest
from conftest import DATA

from tallyframe.llm.toxicity import marginals, score


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    sizes, transition = [1, 5, 0, 7, 3], [-0.7, 0.4, 1.3]
    emission = rng.normal(size=sum(sizes)) * 2
    p, pairs = marginals(emission, sizes, transition, pairs=True)
    step = {(0, 0): 0.0, (0, 1): transition[0], (1, 0): transition[1], (1, 1): transition[2]}
    want, expected, at = [], np.zeros(3), 0
    for n in sizes:
        total, ones, seen = 0.0, np.zeros(n), np.zeros(3)
        for path in itertools.product((0, 1), repeat=n):
            moves = list(zip(path, path[1:], strict=False))
            weight = np.exp(sum(emission[at + i] for i, s in enumerate(path) if s) + sum(step[m] for m in moves))
            total += weight
            ones += weight * np.array(path)
            seen += weight * np.array([moves.count(m) for m in ((0, 1), (1, 0), (1, 1))])
        if n:
            want.extend(ones / total)
            expected += seen / total
        at += n
    assert p == pytest.approx(want)
    assert pairs == pytest.approx(expected)


def given(n=300):
    rng = random.Random(2)
    data, marks = [], []
    for i in range(n):
        words = cases.prose(rng, rng.randrange(10, 60)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Vilewort,", "GRUMBLECUR", "snidéling!"])
        data.append((i, " ".join(words), "en", "a", 0, None, None, None))
        marks.append((i, 1, int(toxic)))
    return data, marks


def test_held_out_documents_and_offsets(spark):
    data, marks = given()
    docs = cases.table(spark, data)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got, out = score(docs, labels)
    assert got.columns == [*docs.columns, out]
    for r in got.collect():
        assert (r[out].score >= 0.5) == (r.doc_id % 4 == 0)
        found = {r.text[s.start : s.end].lower() for s in r[out].spans}
        assert bool(found) == (r.doc_id % 4 == 0)
        assert all(any(w in f for w in ("vilewort", "grumblecur", "snidéling")) for f in found)


def test_whole_tables(spark):
    from tallyframe.llm.queries import QUERIES

    folder = DATA.replace("sf0.001", "sf0.01")
    rows = QUERIES["op9_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r.score for r in rows if r.toxic]
    clean = [r.score for r in rows if not r.toxic]
    # Two of the six toxic texts are in languages with three or four toxic training texts.
    assert np.mean([a > b for a in toxic for b in clean]) > 0.75


def test_awkward_rows_and_missing_labels(spark):
    data, marks = given()
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got, out = score(cases.table(spark, cases.rows()), labels)
    rows = got.collect()
    assert len(rows) == len(cases.rows()) and all(0 <= r[out].score < 0.5 for r in rows if r.text is None or not r.text.strip())
    assert {r[out].score for r in score(cases.table(spark, cases.rows()), labels.where("toxic = 1"))[0].collect()} == {0.0}
    assert score(cases.table(spark, []), labels)[0].count() == 0
