"""Prefix trie of conversations from vertical bitmaps.

1. Every turn becomes two 64-bit hashes of its role and text, numbered from 0 inside its conversation. A prefix is known
   by the XOR of the hashes of (position, turn) of all its turns, so that any part of it can be added up anywhere.
2. Conversations are dealt into shards, and long ones are cut into blocks of ``DEPTHS`` positions, so that no
   conversation, however long, comes together in one task. A shard's block indexes (position, turn) to a bitset of its
   conversations. A depth-first walk intersects the bitset of a node with the postings of its next position: the lowest
   conversation that is left names the next posting, so only postings that make a child are touched. Each child has
   its members by popcount, its least member, and the list of those that end there. The walk of a deeper block starts
   from the prefixes that its conversations have there.
3. The partial nodes of all shards are added up by prefix: a prefix that a third of all conversations share is one row
   per shard. Sums over subtrees take a second look at the shards: a node's value goes to the shard of its least member,
   each shard adds up its own subtrees in the order of the walk, and the sums of all shards are added by prefix.

Defined cases: turns without a conversation id belong to no conversation and are left out. A null role or text is empty.
Turns are ordered by number, null first; turns of one number, and repeated rows, are turns one after the other, in the
order of their hashes. A conversation named by ``conversations`` without turns is a member of the root only. An empty
table has no node. Other columns are not looked at, whatever their names. Different prefixes would be taken for one if
their 128 bits were equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import staged
from tallyframe.operators.ordered import row_index

#: Positions of a block; turns that a shard is meant to have; ids of a chunk of an end list.
DEPTHS, SHARD_TURNS, CHUNK = 256, 5_000, 4_096
PARTIAL = "shard int, block long, number int, stop int, p1 long, p2 long, q1 long, q2 long, depth long, n long, conv long, bytes long, ends array<long>"


class Trie(NamedTuple):
    """``nodes``: one row per prefix (p1, p2). ``ends``: (p1, p2, shard, ids) of the conversations that end at a node."""

    nodes: DataFrame
    ends: DataFrame


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def turn_tokens(turns: DataFrame, *, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, t1, t2, bytes): every turn as two hashes and the bytes of its text, numbered without gaps."""
    who, said = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role, text))
    hashes = [F.xxhash64(F.lit(i), who, said).alias(f"t{i}") for i in (1, 2)]
    rows = turns.select(quoted(id_column).cast("long").alias("conv"), quoted(turn).alias("turn"), *hashes, F.octet_length(said).cast("long").alias("bytes"))
    return row_index(rows.where(F.col("conv").isNotNull()), ["conv"], ["turn", "t1", "t2"], "pos").select("conv", "pos", "t1", "t2", "bytes")


def signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def walk(depths: int):
    """Partial nodes of one shard's block, numbered in the order of the walk; ``stop``: the number after its subtree."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard, block = (k.as_py() for k in key)
        conv, pos = (table.column(c).to_numpy() for c in ("conv", "pos"))
        ids, place = np.unique(conv, return_inverse=True)
        first, second = (table.column(c).to_numpy().view(np.uint64).tolist() for c in ("e1", "e2"))
        size, last = table.column("bytes").to_pylist(), table.column("last").to_pylist()
        starts: dict[tuple[int, int], int] = {}
        postings: dict[tuple[int, int], list[int]] = {}
        ended: dict[int, int] = {}
        following: dict[tuple[int, int], tuple[int, int]] = {}
        for i, p, a, b, n, end in zip(place.tolist(), pos.tolist(), first, second, size, last, strict=True):
            bit = 1 << i
            if p < 0:
                starts[a, b] = starts.get((a, b), 0) | bit
            else:
                following[i, p] = a, b
                posting = postings.setdefault((a, b), [0, n])
                posting[0] |= bit
            if end:
                ended[p + 1] = ended.get(p + 1, 0) | bit
        top, bottom, numbers = block * depths, (block + 1) * depths, ids.tolist()
        out: list[list] = []

        def members(bits: int) -> list[int]:
            found = []
            while bits:
                low = bits & -bits
                found.append(numbers[low.bit_length() - 1])
                bits ^= low
            return found

        # (path, parent's path, bits, depth, bytes) of nodes to visit; a number alone closes the subtree of that node.
        stack: list = [((a, b), None, bits, top, 0) for (a, b), bits in starts.items()]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out[node][1] = len(out)
                continue
            path, parent, bits, depth, n = node
            rest = bits & ~ended.get(depth, 0)
            if parent is not None or depth == 0:
                stack.append(len(out))
                up = (None, None) if parent is None else (signed(parent[0]), signed(parent[1]))
                ends = members(bits & ended.get(depth, 0))
                out.append([len(out), 0, signed(path[0]), signed(path[1]), *up, depth, bits.bit_count(), numbers[(bits & -bits).bit_length() - 1], n, ends])
            while rest and depth < bottom:
                token = following[(rest & -rest).bit_length() - 1, depth]
                posting, n_bytes = postings[token]
                stack.append(((path[0] ^ token[0], path[1] ^ token[1]), path, bits & posting, depth + 1, n_bytes))
                rest &= ~posting
        columns = list(zip(*out, strict=True)) if out else [()] * 11
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 8, pa.list_(pa.int64())]
        names = ["number", "stop", "p1", "p2", "q1", "q2", "depth", "n", "conv", "bytes", "ends"]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        both = [pa.array([shard] * len(out), pa.int32()), pa.array([block] * len(out), pa.int64())]
        return pa.table([*both, *arrays], names=["shard", "block", *names])

    return run


def add_up(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """What the values on the right (by prefix) add up to in the subtrees of one shard's block."""
    order = np.argsort(left.column("number").to_numpy())
    p1, p2, stop = (left.column(c).to_numpy()[order] for c in ("p1", "p2", "stop"))
    place = {path: i for i, path in enumerate(zip(p1.tolist(), p2.tolist(), strict=True))}
    sums = {}
    at = [place[path] for path in zip(right.column("p1").to_pylist(), right.column("p2").to_pylist(), strict=True)]
    for c in ("leaves", "saved"):
        value = np.zeros(len(order), np.int64)
        np.add.at(value, at, right.column(c).to_numpy())
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(value)])
        sums[c] = before[stop] - before[:-1]
    kept = (sums["leaves"] != 0) | (sums["saved"] != 0)
    return pa.table({"p1": p1[kept], "p2": p2[kept], "leaves": sums["leaves"][kept], "saved": sums["saved"][kept]})


def prefix_trie(tokens: DataFrame, conversations: DataFrame | None = None, *, depths: int = DEPTHS, shard_turns: int = SHARD_TURNS) -> Trie:
    """The trie of numbered turns (see ``turn_tokens``). ``conversations``: (conv, length) of all of them, if known."""
    if conversations is None:
        conversations = tokens.groupBy("conv").agg(F.count("*").alias("length"))
    conversations = staged(conversations)
    total = conversations.agg(F.sum(F.col("length") + 1)).first()[0] or 0
    n_shards = max(1, -(-total // shard_turns))
    # Ids near each other share more than others do.
    shard = F.pmod(F.xxhash64(F.floor(F.col("conv") / 64)), F.lit(n_shards)).cast("int").alias("shard")
    element = [F.xxhash64("pos", f"t{i}").alias(f"e{i}") for i in (1, 2)]
    block = F.floor(F.col("pos") / depths).alias("block")
    rows = tokens.join(conversations, "conv").select(
        "conv", block, "pos", *element, "bytes", (F.col("pos") == F.col("length") - 1).alias("last"), (F.col("length") > depths).alias("long")
    )
    rows = staged(rows)
    # Where conversations are longer than a block: the prefix that each has at the start of the next blocks.
    whole = rows.where("long").groupBy("conv", "block").agg(*[F.expr(f"bit_xor(e{i})").alias(f"x{i}") for i in (1, 2)], F.max("last").alias("last"))
    so_far = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    starts = whole.select("conv", (F.col("block") + 1).alias("block"), "last", *[F.expr(f"bit_xor(x{i})").over(so_far).alias(f"e{i}") for i in (1, 2)])
    starts = staged(starts.where(~F.col("last")).drop("last"))
    zero = F.lit(0).cast("long")
    heads = conversations.select("conv", zero.alias("block"), zero.alias("e1"), zero.alias("e2"), (F.col("length") == 0).alias("last"))
    heads = heads.unionByName(starts.withColumn("last", F.lit(False))).withColumns({"pos": F.lit(-1).cast("long"), "bytes": zero})
    every = rows.drop("long").unionByName(heads).select(shard, "*")
    partial = staged(every.groupBy("shard", "block").applyInArrow(walk(depths), PARTIAL))
    found = partial.groupBy("p1", "p2").agg(
        F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
        F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes"), F.sum(F.size("ends")).alias("n_ends"),
    )
    found = staged(found.withColumn("leaf", (F.col("n_ends") == F.col("n_convs")).cast("long")).withColumn("save", (F.col("n_convs") - 1) * F.col("bytes")))
    # A node's own values go to its least member; those of deeper blocks to the prefix that this member has above.
    level = F.greatest(F.floor((F.col("depth") - 1) / depths), F.lit(0)).alias("block")
    values = found.select("conv", level, "p1", "p2", F.col("leaf").alias("leaves"), F.col("save").alias("saved"))
    deeper = values.where("block > 0").groupBy("conv", "block").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    from_here = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    later = starts.join(deeper, ["conv", "block"], "left").select(
        "conv", (F.col("block") - 1).alias("block"), F.col("e1").alias("p1"), F.col("e2").alias("p2"),
        *[F.sum(F.coalesce(c, zero)).over(from_here).alias(c) for c in ("leaves", "saved")],
    )
    sent = values.unionByName(later.where("leaves <> 0 or saved <> 0")).select(shard, "block", "p1", "p2", "leaves", "saved")
    local = partial.select("shard", "block", "number", "stop", "p1", "p2").groupBy("shard", "block")
    sums = local.cogroup(sent.groupBy("shard", "block")).applyInArrow(add_up, "p1 long, p2 long, leaves long, saved long")
    above = found.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent_conv"))
    named = found.join(above, ["q1", "q2"], "left").select("p1", "p2", "conv", "depth", "parent_conv", "n_convs", "n_ends")
    children = found.where("q1 is not null").groupBy("q1", "q2").agg(F.count("*").alias("n_children")).withColumnsRenamed({"q1": "p1", "q2": "p2"})
    parts = named.unionByName(sums, allowMissingColumns=True).unionByName(children, allowMissingColumns=True)
    same = lambda c: F.max(c).alias(c)
    total_of = lambda c, out: F.coalesce(F.sum(c), zero).alias(out)
    nodes = parts.groupBy("p1", "p2").agg(
        same("conv"), same("depth"), same("parent_conv"), same("n_convs"), same("n_ends"),
        F.coalesce(F.max("n_children"), zero).alias("n_children"), total_of("leaves", "n_leaves"), total_of("saved", "saved_bytes"),
    )
    return Trie(nodes, partial.where(F.size("ends") > 0).select("p1", "p2", "shard", F.col("ends").alias("ids")))


def end_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, sha256) of the comma-joined ids that end at each node, ascending, of the nodes where any end.

    Ids are joined in chunks of an id range first; a node's chunks then run through one hash in their order, so that a
    list of any length needs no more memory than a batch of chunks.
    """
    ids = ends.select("p1", "p2", F.explode("ids").alias("id")).withColumn("chunk", F.floor(F.col("id") / CHUNK))
    text = F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",")
    chunks = ids.groupBy("p1", "p2", "chunk").agg(text.alias("text")).repartition("p1", "p2").sortWithinPartitions("p1", "p2", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 3
            kinds = [pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["p1", "p2", "sha256"])

        for batch in batches:
            for a, b, piece in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "text")), strict=True):
                if (a, b) != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (a, b), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield flush()
            done = []
        if at is not None:
            done.append((*at, state.hexdigest()))
        yield flush()

    return chunks.mapInArrow(run, "p1 long, p2 long, sha256 string")


def shared_openings(tokens: DataFrame, group: int = 5, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with turns of another one: tokens, and (conv, length) of every conversation.

    Conversation c begins with the first h turns of conversation c - c mod ``group`` (all if it has fewer, none if there is
    no such one), then goes on with its own after the first h; h is crc32(c) mod (``longest`` + 1).
    """
    sizes = staged(tokens.groupBy("conv").agg(F.count("*").alias("own")))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (longest + 1)
    plan = sizes.select("conv", "own", (F.col("conv") - F.pmod("conv", F.lit(group))).alias("base"), h.alias("h"))
    plan = plan.join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("held")), "base", "left")
    lent = F.least("h", F.coalesce("held", F.lit(0).cast("long")))
    plan = staged(plan.select("conv", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    own = tokens.join(plan.select("conv", "h", "lent"), "conv").where("pos >= h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "t1", "t2", "bytes")
    # At most ``group`` conversations take the same one, and at most ``longest`` turns of it.
    first = tokens.where(F.col("pos") < longest).withColumnRenamed("conv", "base").join(plan.select("base", "conv", "h"), "base").where("pos < h")
    return own.unionByName(first.select("conv", "pos", "t1", "t2", "bytes")), plan.select("conv", "length")
