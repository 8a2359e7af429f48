from __future__ import annotations

import random
from collections import defaultdict

import cases
import numpy as np
import pytest
from conftest import DATA

from tallyframe.llm.quality import STRENGTH, features, fit, keep_good, score


def labels(spark, data):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def given(seed=0, n=200):
    rng = random.Random(seed)
    data, marks = [], []
    for i in range(n):
        bad = rng.random() < (0.6 if i % 10 == 0 else 0.2)
        text = " ".join(w.upper() + "!!" for w in cases.prose(rng, 40).split()) if bad else cases.prose(rng, rng.randrange(20, 90))
        data.append((i, text, rng.choice(["en", None]), "rare" if i % 10 == 0 else "hot", 0, None, None, None))
        if i % 2:
            marks.append((i, 0 if bad else 1, 0))
    return data, marks


def test_posteriors_against_plain_version(spark):
    data, marks = given()
    docs = cases.table(spark, data)
    got, out = score(docs, labels(spark, marks))
    assert got.columns == [*docs.columns, out]
    rows = got.collect()
    own = {r.doc_id: r[out].own for r in rows}
    paths, hosts = defaultdict(list), defaultdict(list)
    for r in data:
        paths[(r[3], r[2])].append(own[r[0]])
        hosts[r[3]].append(own[r[0]])
    mean = np.mean(list(own.values()))

    def strength(groups, prior):
        inside = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values()) / sum(len(v) - 1 for v in groups.values())
        n, k = sum(map(len, groups.values())), len(groups)
        spread = (sum(len(v) * (np.mean(v) - prior(g)) ** 2 for g, v in groups.items()) / k - inside) / (n / k)
        return float(np.clip(inside / spread, *STRENGTH)) if spread > 0 else STRENGTH[1]

    alpha = strength(hosts, lambda _: mean)
    host = {h: (sum(v) + alpha * mean) / (len(v) + alpha) for h, v in hosts.items()}
    beta = strength(paths, lambda g: host[g[0]])
    logit = lambda p: np.log(p / (1 - p))
    for r in rows:
        mine = paths[(r.source, r.lang)]
        path = (sum(mine) - own[r.doc_id] + beta * host[r.source]) / (len(mine) - 1 + beta)
        assert r[out].host == pytest.approx(host[r.source], rel=1e-6)
        assert r[out].path == pytest.approx(path, rel=1e-5)
        assert logit(r[out].score) == pytest.approx(logit(own[r.doc_id]) + logit(path) - logit(mean), abs=1e-3)


def test_keeps_clean_documents_that_it_was_not_trained_on(spark):
    data, marks = given()
    kept = {r.doc_id for r in keep_good(cases.table(spark, data), labels(spark, marks)).collect()}
    assert kept == {r[0] for r in data if "!!" not in r[1]}


def test_held_out_accuracy(spark):
    from tallyframe.llm.queries import QUERIES

    rows = QUERIES["op7_quality_classifier"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.9 * len(rows) > 0


def test_awkward_rows_and_missing_labels(spark):
    data = cases.rows()
    docs = cases.table(spark, data)
    none = labels(spark, [(None, 1, 1), (5, None, None), (7, 1, 0)])
    got, out = score(docs, none)
    rows = got.collect()
    assert len(rows) == len(data) and {round(r[out].own, 9) for r in rows} == {0.5}
    assert score(cases.table(spark, []), none)[0].count() == 0
    assert (features([None, b"", b"a b"])[:2, :-1] == 0).all()


def test_fit_separates():
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(500, 2)), np.ones((500, 1))])
    y = (x[:, 0] - 2 * x[:, 1] + 0.5 > 0).astype(float)
    assert (((x @ fit(x, y)) > 0) == (y > 0)).mean() > 0.97
