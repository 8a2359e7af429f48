from __future__ import annotations

import random
from collections import Counter, defaultdict

import cases
import pytest

from tallyframe.llm import similarity
from tallyframe.llm.similarity import drop_near_duplicates, near_duplicates


def shingle_set(text):
    w = cases.words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(data):
    sets = [shingle_set(r[1]) for r in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 4 * common >= 3 * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(data):
        least[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), None if None in (x := least[find(i)]) else min(x)) for i, r in enumerate(data))


def chains(seed, n=150):
    """Texts that drift apart step by step, and passages that many documents share."""
    rng = random.Random(seed)
    passage = cases.prose(rng, 25)
    out, text = [], cases.prose(rng, 60).split()
    for i in range(n):
        if i % 15 == 0:
            text = cases.prose(rng, rng.randrange(3, 120)).split()
            if i % 2:
                text = text + passage.split()
        for _ in range(1 + len(text) // 60):
            text[rng.randrange(len(text))] = rng.choice(cases.WORDS)
        out.append((i, " ".join(text), "en", "a", 0, None, None, None))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_pairs(spark, seed, monkeypatch):
    data = cases.rows(seed) if seed == 0 else chains(seed)
    # Few holders make a token frequent, so that combinations and all rounds are used on little data.
    monkeypatch.setattr(similarity, "RARE", 2)
    monkeypatch.setattr(similarity, "SMALL", 2)
    got = near_duplicates(cases.table(spark, data))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain(data)


def test_pairs_that_no_pivot_reaches(spark, monkeypatch):
    """One entry alone: its pivots are near each other, and two near copies are far from all of them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    base = [word() for _ in range(100)]
    far = base[:60] + [word() for _ in range(40)]
    texts = [far, [*far[:-1], word()]]
    for i in range(40):
        texts.append([*base[:i], word(), *base[i + 1 :]])
    data = [(i, " ".join(t), "en", "a", 0, None, None, None) for i, t in enumerate(texts)]
    everything = lambda docs, text, id_column, packed, owners, t: packed.selectExpr("explode(arrays_zip(nodes, sizes)) as x").selectExpr("1L as entry", "x.nodes as node", "x.sizes as n")
    monkeypatch.setattr(similarity, "index_entries", everything)
    got = near_duplicates(cases.table(spark, data)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(data)
    assert {r.doc_id: r.component_id for r in got}[1] == 0


def test_entries_meet_for_every_pair_at_the_threshold():
    bands, rng = similarity.Bands((3, 4)), random.Random(3)
    for _ in range(3000):
        n = rng.choice([1, 2, 3, 4, 5, 8, 13, 40, 200])
        universe = [rng.getrandbits(64) for _ in range(2 * n)]
        often = {t: rng.random() < rng.choice([0.1, 0.9, 1.0]) for t in universe}
        a = set(universe[:n])
        b = (a - set(rng.sample(sorted(a), rng.randrange(0, n // 7 + 1)))) | set(universe[n : n + rng.randrange(0, n // 7 + 1)])
        if 4 * len(a & b) < 3 * len(a | b):
            continue
        found = []
        for s in (a, b):
            prefix = sorted(s)[: bands.longest(len(s))]
            found.append(bands.entries(len(s), list(range(len(prefix))), prefix, [often[t] for t in prefix]))
        assert found[0] & found[1], (len(a), len(b), len(a & b))


def test_one_of_each_group_stays(spark):
    data = [r for r in cases.rows() if r[0] is not None and r[0] != 9]
    docs = cases.table(spark, data)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in plain(data)})


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, null ids of one and of several components, and two texts under one id."""
    rng = random.Random(4)
    one, two, three, four = (cases.prose(rng, 40) for _ in range(4))
    more = [(None, one), (None, one), (None, two), (None, ""), (3000, three), (3000, three), (3000, four), (3001, four), (3002, one)]
    data = [*cases.rows(), *[(i, t, "en", "a", 0, None, None, None) for i, t in more]]
    docs = cases.table(spark, data)
    kept = [(r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()]
    whole = plain(data)
    alone = Counter(r[0] for r in data if not shingle_set(r[1]))
    sets, found = [shingle_set(r[1]) for r in data], Counter()
    left = set(range(len(data)))
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if (c := len(sets[i] & sets[j])) and 4 * c >= 3 * (len(sets[i]) + len(sets[j]) - c)}
            left -= near
            todo += near
        ids = [data[i][0] for i in group]
        found[None if None in ids else min(ids)] += 1
    assert sum(alone.values()) == 4 and set(found) == {c for _, _, c in whole}
    assert Counter(i for i, _ in kept) == found
    assert (3000, three) in kept and (3000, four) in kept and (None, one) in kept and (None, two) in kept


def test_empty_table(spark):
    assert near_duplicates(cases.table(spark, [])).count() == 0
    assert drop_near_duplicates(cases.table(spark, [])).count() == 0


def test_a_passage_that_a_third_shares(spark, monkeypatch):
    """Documents that are half a common passage and half their own, beside copies that differ in a few words."""
    monkeypatch.setattr(similarity, "RARE", 4)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage, other = [word() for _ in range(60)], [word() for _ in range(60)]
    texts = []
    for i in range(160):
        own = [word() for _ in range(rng.randrange(10, 80))]
        texts.append([*own, *(passage if i % 3 else other)][: rng.randrange(60, 140)])
        if i % 20 == 0:
            texts += [[*texts[-1][:-3], word()], [*passage, *other, word()], [*passage, word(), word()]]
    data = [(i, " ".join(t), "en", "a", 0, None, None, None) for i, t in enumerate(texts)]
    got = near_duplicates(cases.table(spark, data)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(data)


def test_parity_maps_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(3)
    count = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(similarity.parity_map(a), similarity.parity_map(b), strict=True))
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 3000), dtype=np.uint64))
        kept = a[rng.random(len(a)) < rng.choice([0.5, 0.8, 0.9, 1.0])]
        b = np.unique(np.concatenate([kept, rng.integers(0, 2**64, rng.integers(0, 1 + len(a) // 3), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        assert count(a, b) <= len(a) + len(b) - 2 * common
        if 4 * common >= 3 * (len(a) + len(b) - common):
            assert count(a, b) * 7 <= len(a) + len(b)


def test_pairs_of_many_entries_are_made_about_once(spark):
    """Sets that share tens of entries: every pair of two components comes, and hardly one comes again."""
    rng = random.Random(6)
    root = {i: i if i < 30 else 30 for i in range(60)}
    size = {i: rng.choice([60, 75, 79, 80, 81, 100]) for i in root}
    held = {e: [i for i in root if rng.random() < 0.7] for e in range(-20, 40)} | {100: [1, 2], 101: [3, 40], 102: [41, 42]}
    rows = [(e, i, size[i], root[i], None) for e, members in held.items() for i in members]
    maps = spark.createDataFrame([(i, *[0] * similarity.WORDS) for i in root], ", ".join(["node long", *[f"m{i} long" for i in range(similarity.WORDS)]]))
    table = spark.createDataFrame(rows, "entry long, node long, n long, root long, distance double")
    got = [tuple(sorted(r)) for r in similarity.still_open(table, maps, (3, 4)).collect()]
    near = lambda a, b: root[a] != root[b] and 4 * min(size[a], size[b]) >= 3 * max(size[a], size[b])
    want = {(a, b) for members in held.values() for a in members for b in members if a < b and near(a, b)}
    assert set(got) == want
    assert len(got) < 1.5 * len(want)
