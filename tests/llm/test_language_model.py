from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import cases
import pytest

from tallyframe.llm.language_model import discounts, score


class Plain:
    """The same model with dictionaries."""

    def __init__(self, data):
        self.tokens = [[*cases.words(r[1]), None] for r in data]
        self.held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in data]
        self.words, pairs = Counter(), Counter()
        for w, h in zip(self.tokens, self.held, strict=True):
            if not h:
                self.words.update(w)
                pairs.update(zip(["<s>", *w[:-1]], w, strict=True))
        self.total = sum(self.words.values())
        of = lambda counts: discounts([sum(v == r for v in counts.values()) for r in range(1, 7)])
        self.d1, self.d2, self.after = of(self.words), of(pairs), defaultdict(dict)
        for (v, w), n in pairs.items():
            self.after[v][w] = n

    @staticmethod
    def cut(d, n):
        return d[n - 1] if n <= len(d) else 1.0

    def p1(self, w):
        left = sum((1 - self.cut(self.d1, n)) * n for n in self.words.values())
        if w in self.words:
            return self.cut(self.d1, self.words[w]) * self.words[w] / self.total
        return left / self.total if self.total else 1.0

    def p2(self, v, w):
        seen = self.after.get(v)
        if not seen:
            return self.p1(w)
        held = sum(seen.values())
        left = sum((1 - self.cut(self.d2, n)) * n for n in seen.values())
        if left <= 0:
            left, held = 1.0, held + 1
        if w in seen:
            return self.cut(self.d2, seen[w]) * seen[w] / held
        return left / held / (1 - sum(map(self.p1, seen))) * self.p1(w)


@pytest.mark.parametrize("batch_tokens", [50, 1_000_000])
def test_against_plain_version(spark, batch_tokens):
    data = cases.rows(n=60)
    got = score(cases.table(spark, data), batch_tokens=batch_tokens, bucket_rows=700).collect()
    model = Plain(data)
    want = []
    for r, w, h in zip(data, model.tokens, model.held, strict=True):
        base = sum(math.log10((model.words[x] + 1) / (model.total + len(model.words) + 1)) for x in w)
        full = sum(math.log10(model.p2(v, x)) for v, x in zip(["<s>", *w[:-1]], w, strict=True))
        want.append((-1 if r[0] is None else r[0], h, len(w), sum(x in model.words for x in w), model.total, base, full))
    mine = [(-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got]
    for a, b in zip(sorted(mine), sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_every_context_sums_to_one():
    model = Plain(cases.rows(n=60))
    for v in list(model.after)[:40]:
        assert sum(model.p2(v, w) for w in [*model.words, "a word that training never saw"]) == pytest.approx(1)


def test_discounts_of_irregular_counts():
    assert discounts([10, 0, 0, 0, 0, 0]) == [1 - 0.5 / r for r in range(1, 6)]
    assert all(0 < d < 1 for d in discounts([100, 40, 20, 12, 8, 6]))


def test_nothing_to_train_on(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = score(cases.table(spark, [(held, "a b", None, None, 0, None, None, None)])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert score(cases.table(spark, [])).count() == 0
