"""The prefix trie against a plain one made of dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyframe.llm.queries import QUERIES
from tallyframe.llm.trie import end_digests, prefix_trie, shared_openings, turn_tokens

SCHEMA = "conv_id long, turn long, role string, text string, pos string, `a.b` string, conv int"


def rebuilt(conversations: dict[int, list]) -> dict[int, list]:
    out = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = conversations.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(conversations: dict[int, list]) -> list[tuple]:
    nodes: dict[tuple, list[int]] = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, list[tuple]] = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    below: dict[tuple, tuple[int, int]] = {}
    for path in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        sub = [below[k] for k in children.get(path, [])]
        below[path] = (sum(s[0] for s in sub) or 1, own + sum(s[1] for s in sub))
    rows = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(conversations[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        rows.append((min(members), len(path), parent, len(members), len(children.get(path, [])), *below[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows)


def ours(trie) -> list[tuple]:
    rows = trie.nodes.join(end_digests(trie.ends), ["p1", "p2"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    rows = rows.select("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_bytes", F.coalesce("sha256", F.lit(empty)))
    return sorted(map(tuple, rows.collect()))


def sample(seed: int = 1) -> list[tuple]:
    """A third of the conversations equal, long ones that part late, nulls, gaps and negative ids."""
    rng, rows = random.Random(seed), []
    long = [("user", f"line {i}") for i in range(40)]
    for c in [*range(0, 60), -3, -10, 5_000_000_000]:
        if c % 3 == 0:
            turns = [("user", "hello"), ("assistant", "hi there"), ("user", "")]
        elif c % 7 == 0:
            turns = long[: rng.randrange(10, 40)] + [("user", rng.choice("xy"))]
        else:
            turns = [(rng.choice(["user", None]), rng.choice(["é", None, "b"])) for _ in range(rng.randrange(1, 6))]
        if c in (11, 25):
            continue
        numbers = sorted(rng.sample(range(100), len(turns)))
        rows += [(c, None if i == 0 and c % 4 == 0 else n, r, t, "clash", "clash", 1) for i, (n, (r, t)) in enumerate(zip(numbers, turns, strict=True))]
    rng.shuffle(rows)
    return [*rows, (None, 1, "user", "nobody's", None, None, None)]


def grouped(rows: list[tuple]) -> dict[int, list]:
    out: dict[int, list] = {}
    for c, _, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1])):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


@pytest.mark.parametrize("depths", [3, 256])
def test_against_plain_trie(spark, depths):
    rows = sample()
    tokens = turn_tokens(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert ours(prefix_trie(tokens, depths=depths, shard_turns=50)) == plain_trie(grouped(rows))
    own, sizes = shared_openings(tokens)
    assert ours(prefix_trie(own, sizes, depths=depths, shard_turns=50)) == plain_trie(rebuilt(grouped(rows)))


def test_hot_conversation_is_numbered_in_ranges(spark):
    rows = [(1, n, "user", f"t{n // 2}", None, None, None) for n in range(500)] + [(2, n, "user", f"t{n // 2}", None, None, None) for n in range(490)]
    spark.conf.set("spark.tallyframe.maxRowsPerKey", "60")
    try:
        assert ours(prefix_trie(turn_tokens(spark.createDataFrame(rows, SCHEMA)), depths=16, shard_turns=100)) == plain_trie(grouped(rows))
    finally:
        spark.conf.unset("spark.tallyframe.maxRowsPerKey")


def test_empty_and_repeated(spark):
    assert ours(prefix_trie(turn_tokens(spark.createDataFrame([], SCHEMA)))) == []
    rows = [(7, 0, "user", "same", None, None, None)] * 3
    assert ours(prefix_trie(turn_tokens(spark.createDataFrame(rows, SCHEMA)))) == plain_trie(grouped(rows))


def test_long_end_lists_run_through_one_hash(spark):
    ids = list(range(-5000, 20_000, 3))
    ends = spark.createDataFrame([(1, 2, 0, ids[::2]), (1, 2, 1, ids[1::2]), (1, 3, 1, [4])], "p1 long, p2 long, shard int, ids array<long>")
    found = {(r.p1, r.p2): r.sha256 for r in end_digests(ends).collect()}
    assert found == {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"4").hexdigest()}


def test_registered_query(spark):
    got = sorted(map(tuple, QUERIES["op13_conversation_prefix_trie"](spark, DATA).collect()))
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got == plain_trie(rebuilt(grouped([tuple(t) for t in turns])))
