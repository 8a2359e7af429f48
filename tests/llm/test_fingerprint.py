from __future__ import annotations

import hashlib
import random
from collections import Counter

import cases
import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from tallyframe.llm.fingerprint import compare, fingerprints, likeness, signature


def test_neighbours_and_edits(spark):
    data = cases.rows()
    got = compare(cases.table(spark, data)).collect()
    assert len(got) == len(data)
    order = sorted(data, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1] or ""))
    want = Counter()
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        want[(r[0], len(text), hashlib.sha256(new.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want


def test_ranges_do_not_change_the_result(spark, monkeypatch):
    import tallyframe.llm.fingerprint as module

    docs = cases.table(spark, cases.rows())
    one = compare(docs).collect()
    monkeypatch.setattr(module, "ROWS_PER_RANGE", 4)
    many = compare(docs).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(one, key=key) == sorted(many, key=key)


def test_equal_texts_and_empty_texts(spark):
    found = {r.doc_id: r.fingerprint for r in compare(cases.table(spark, cases.rows())).collect()}
    assert found[0] == found[1] == found[2] != found[3] == found[4]
    rows = compare(cases.table(spark, [(5, None, None, None, 0, None, None, None)])).collect()
    assert [(r.near_edited, r.near_next, r.n_chars) for r in rows] == [(1.0, 1.0, 0)]
    assert compare(cases.table(spark, [])).count() == 0
    unique = fingerprints(cases.table(spark, cases.rows()[:20])).collect()
    assert {r.doc_id: r.fingerprint for r in unique}.items() <= found.items()


def test_error_of_the_registered_number_of_draws(spark):
    """near_edited and near_next of whole documents against the exact generalised Jaccard."""
    rng, texts = random.Random(6), []
    for i in range(90):
        words = cases.prose(rng, rng.randrange(30, 200)).split() if i % 3 == 0 else words
        texts.append(" ".join(words))
        words = [w if rng.random() < 0.97 else rng.choice(cases.WORDS) for w in words]
    terms = lambda t: Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4))
    rows = {r.doc_id: r for r in compare(cases.table(spark, [(i, t, None, None, 0, None, None, None) for i, t in enumerate(texts)])).collect()}
    errors = []
    for i, text in enumerate(texts):
        after, third = texts[i - 1], len(text) // 3
        for other, near in ((text[: len(text) - third] + after[:third], rows[i].near_edited), (after, rows[i].near_next)):
            x, y = terms(text), terms(other)
            exact = (x & y).total() / (x | y).total()
            errors.append(near - exact)
            assert abs(near - exact) <= 5 * (exact * (1 - exact) / 128) ** 0.5 + 1e-9
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 <= 0.05


def test_collision_rate_is_generalised_jaccard(spark):
    rng = np.random.default_rng(1)
    weights = rng.integers(0, 6, (2, 60))
    true = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    terms = spark.createDataFrame([(0, int(i * 7919 + 1), int(a), int(b)) for i, (a, b) in enumerate(weights.T)], "id int, term long, a long, b long")
    n = 2048
    got = signature(terms, ["id"], ["a", "b"], n).select(likeness(F.col("a"), F.col("b"), n)).first()[0]
    assert abs(got - true) < 4 * (true * (1 - true) / n) ** 0.5


def test_no_python_in_the_plan(spark, capsys):
    compare(spark.read.parquet(f"{DATA}/documents.parquet")).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_likeness_cuts_each_fingerprint_once(spark):
    from tallyframe.llm.fingerprint import likeness

    a, b = "0123456789abcdef" * 2, "0123456700000000" * 2
    rows = spark.createDataFrame([(a, b), (a, a), (a, None)], "a string, b string")
    got = rows.select(likeness(F.col("a"), F.col("b"), 4).alias("x"))
    assert [r.x for r in got.collect()] == [0.5, 1.0, None]
    assert "substr" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_least_values_of_all_weights(spark):
    """Each sample is the least value of the round over all terms, whether a row makes a chunk of rounds or one."""
    from tallyframe.llm.fingerprint import draw, value_at

    n, terms = 100, spark.createDataFrame([(0, i * 7919 + 1, a, b) for i, (a, b) in enumerate([(1, 1), (3, 3), (1, 2), (0, 4), (7, 0), (1, 0), (2, 1)])], "id int, term long, a long, b long")
    rounds = terms.crossJoin(spark.range(n).select(F.col("id").cast("int").alias("i")))
    least = rounds.groupBy("i").agg(*[F.min(value_at(F.col(w), *draw(F.col("term"), F.col("i")))).alias(w) for w in ("a", "b")])
    want = {r.i: (r.x, r.y) for r in least.select("i", F.hex(F.xxhash64("a")).alias("x"), F.hex(F.xxhash64("b")).alias("y")).collect()}
    got = signature(terms, ["id"], ["a", "b"], n).first()
    for k, text in enumerate((got.a, got.b)):
        assert text == "".join(want[i][k].zfill(16)[:8].lower() for i in range(n))


def test_fingerprints_are_dealt_once(spark):
    """Neighbours are compared before the join, so that fingerprints are not dealt by range again after it."""
    docs = cases.table(spark, cases.rows())
    plan = compare(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("lead(fingerprint")
