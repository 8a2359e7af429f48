"""Choosing rows: caps, duplicates, minimum distance, samples and balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.ordered import hash_order, hash_value, row_index
from tallyframe.session import checkpoint


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of every key.

    Spark limits each partition to k rows per key before the shuffle (for k up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``, 1000), so a hot key never
    reaches one task whole.
    """
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__r") <= k).drop("__r")


def cap_per_label(df: DataFrame, clip: list[str], label: str, order: list[str], k: int = 5) -> DataFrame:
    """The first k rows of each label in a clip."""
    return first_per_group(df, [*clip, label], [F.asc(c) for c in order], k)


def dedupe_exact(df: DataFrame, clip: list[str], value: str, order: list[str]) -> DataFrame:
    """The first row of each distinct value in a clip."""
    return first_per_group(df, [*clip, value], [F.asc(c) for c in order], 1)


def sample_n(df: DataFrame, keys: list[str], row_key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Up to n reproducibly random rows per key."""
    return first_per_group(df, keys, [F.asc(hash_order(seed, *row_key)), *[F.asc(c) for c in row_key]], n)


def balance_negatives(
    positives: DataFrame,
    negatives: DataFrame,
    clip: list[str],
    row_key: list[str],
    seed: int = 42,
    max_rows: int | None = None,
) -> DataFrame:
    """As many random negatives per clip as it has positives, or all of them if fewer."""
    wanted = positives.groupBy(*clip).agg(F.count("*").alias("__wanted"))
    keyed = negatives.withColumn("__h", hash_order(seed, *row_key))
    ranked = row_index(
        keyed, clip, ["__h", *row_key], "__r", order_value=hash_value(F.col("__h")), max_rows=max_rows
    )
    return ranked.join(wanted, clip).where(F.col("__r") < F.col("__wanted")).drop("__h", "__r", "__wanted")


def shuffle_key(df: DataFrame, row_key: list[str], seed: int = 42, out: str = "shuffle_key") -> DataFrame:
    """Store a random order; sort by it when reading."""
    return df.withColumn(out, hash_order(seed, *row_key))


def random_rows(df: DataFrame, row_key: list[str], n: int = 1, seed: int = 42) -> DataFrame:
    """n random rows of the whole table, for inspection."""
    return df.orderBy(hash_order(seed, *row_key), *row_key).limit(n)


def random_rows_of_block(table: DataFrame, row_key: list[str], n: int = 1, seed: int = 42) -> DataFrame:
    """n random rows of one random block of a table read from files, for inspection; all of its rows if fewer.

    A block is what Spark reads as one split: a row group or a few. The blocks are listed without reading a data
    column; then only the file of the chosen block is opened. Its rows are found by their position in the file, since
    fewer files may be split elsewhere. ``table`` must be the table as read, and its listing is a job of its own.
    """
    at = F.col("_metadata.row_index")
    blocks = table.groupBy(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("start"),
    ).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    block = blocks.orderBy(hash_order(seed, "name", "start"), "path", "start").first()
    if block is None:
        return table.limit(0)
    inside = table.where((F.col("_metadata.file_path") == block.path) & at.between(block.first, block.last))
    return inside.orderBy(hash_order(seed, *row_key), *row_key).limit(n)


def consecutive_rows(df: DataFrame, block: list[str], index: str, n: int, seed: int = 42) -> DataFrame:
    """n neighbouring rows of one random block that has that many."""
    sizes = df.groupBy(*block).agg(F.min(index).alias("__lo"), F.max(index).alias("__hi"))
    fitting = sizes.where(F.col("__hi") - F.col("__lo") + 1 >= n)
    spot = hash_value(hash_order(f"{seed}|start", *block)) / F.lit(float(16**13))
    room = F.col("__hi") - F.col("__lo") - n + 2
    chosen = (
        fitting.orderBy(hash_order(seed, *block), *block)
        .limit(1)
        .withColumn("__from", F.col("__lo") + F.floor(spot * room))
        .drop("__lo", "__hi")
    )
    return (
        df.join(F.broadcast(chosen), block)
        .where((F.col(index) >= F.col("__from")) & (F.col(index) < F.col("__from") + n))
        .drop("__from")
    )


def top_k(df: DataFrame, label: str, k: int, by: list[str] = ()) -> DataFrame:
    """The k most frequent values, per group when ``by`` is given; ties in value order."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc(label)]
    return first_per_group(counts, list(by), order, k) if by else counts.orderBy(*order).limit(k)


def greedy_min_distance(
    df: DataFrame,
    clip: list[str],
    order: list[str],
    coords: list[str],
    threshold: float,
    chunk: int = 1000,
) -> DataFrame:
    """Keep a row only if it lies at least ``threshold`` from every row kept before it in its clip.

    Rows are taken in ``order``, which must be unique per clip. Each round folds
    the first ``chunk`` undecided rows of every clip, then drops the later rows
    that are too close to the rows just kept. Clips up to ``chunk`` rows end in
    the first round; in longer ones the kept rows cover the plane quickly, so
    few undecided rows remain. No task sees more than ``chunk`` rows of a clip
    at once, and the result is the sequential one.
    """
    stamp = F.struct(*[F.col(c) for c in order])
    # A later copy of the same point is at distance 0: it can never be kept.
    points = df.select(*clip, *order, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(coords)])
    axes = [f"__x{i}" for i in range(len(coords))]
    undecided = points.groupBy(*clip, *axes).agg(F.min(stamp).alias("__at"))
    kept_parts: list[DataFrame] = []
    while True:
        sizes = undecided.groupBy(*clip).agg(F.count("*").alias("__n"))
        more = not sizes.where(F.col("__n") > chunk).isEmpty()
        if more and not kept_parts:
            undecided = checkpoint(undecided)
        head = first_per_group(undecided, clip, [F.asc("__at")], chunk) if more else undecided
        kept = _fold(head, clip, axes, threshold)
        if not more:
            kept_parts.append(kept)
            break
        kept = checkpoint(kept)
        kept_parts.append(kept)
        reach = head.groupBy(*clip).agg(F.max("__at").alias("__until"))
        later = undecided.join(reach, clip).where(F.col("__at") > F.col("__until")).drop("__until")
        undecided = checkpoint(_far_from(later, kept, clip, axes, threshold))
    kept = kept_parts[0]
    for part in kept_parts[1:]:
        kept = kept.unionByName(part)
    keys = kept.select(*clip, *[F.col("__at")[c].alias(c) for c in order])
    return df.join(keys, [*clip, *order], "left_semi")


def _fold(head: DataFrame, clip: list[str], axes: list[str], threshold: float) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("__at", *axes)))
    gathered = head.groupBy(*clip).agg(rows.alias("__rows"))

    def near(a: Column, b: Column) -> Column:
        squares = [(a[x] - b[x]) * (a[x] - b[x]) for x in axes]
        total = squares[0]
        for square in squares[1:]:
            total = total + square
        return F.sqrt(total) < threshold

    kept = F.aggregate(
        "__rows",
        F.slice("__rows", 1, 0),
        lambda acc, row: F.when(F.exists(acc, lambda k: near(k, row)), acc).otherwise(
            F.concat(acc, F.array(row))
        ),
    )
    return gathered.select(*clip, F.explode(kept).alias("__k")).select(
        *clip, *[F.col(f"__k.{x}").alias(x) for x in axes], F.col("__k.__at").alias("__at")
    )


def _far_from(rows: DataFrame, kept: DataFrame, clip: list[str], axes: list[str], threshold: float) -> DataFrame:
    """Rows with no kept row within the threshold; both meet on grid cells of that width."""
    cells = [F.floor(F.col(x) / threshold).cast("long") for x in axes]
    placed = rows.withColumns({f"__c{i}": c for i, c in enumerate(cells)})
    around = kept
    for i, x in enumerate(axes):
        near_cells = F.array(*[F.floor(F.col(x) / threshold).cast("long") + d for d in (-1, 0, 1)])
        around = around.withColumn(f"__c{i}", F.explode(near_cells))
    around = around.select(*clip, *[f"__c{i}" for i in range(len(axes))], *[F.col(x).alias(f"{x}k") for x in axes])
    total = None
    for x in axes:
        gap = placed[x] - around[f"{x}k"]
        total = gap * gap if total is None else total + gap * gap
    match = F.sqrt(total) < threshold
    for c in [*clip, *[f"__c{i}" for i in range(len(axes))]]:
        match = match & placed[c].eqNullSafe(around[c])
    return placed.join(around, match, "left_anti").drop(*[f"__c{i}" for i in range(len(axes))])


def majority_label(
    df: DataFrame, keys: list[str], label: str, order: list[str] | None = None, seen: str | None = None
) -> DataFrame:
    """Most frequent label per key with its count.

    Ties follow the class list ``order`` (unlisted labels last), or the first
    appearance by the position column ``seen``. Votes are counted before they
    are shuffled, so a key with very many votes is no burden.
    """
    if order is not None:
        place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(label))
        rank = F.when(place == 0, F.lit(len(order) + 1)).otherwise(place).cast("long")
        first = F.min(rank)
    else:
        first = F.min(seen) if seen else F.min(F.lit(0))
    votes = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"), first.alias("__f"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("__f").alias("f"), F.col(label).alias("label")))
    return votes.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, F.col("__b.label").alias(label), (-F.col("__b.m")).alias("votes")
    )


def no_sentinel(value: Column, sentinel: float = -1) -> Column:
    """The value is given and is not the mark for an invalid one."""
    return value.isNotNull() & (value != sentinel)


def no_sentinel_in(values: Column, sentinel: float = -1) -> Column:
    return ~F.exists(values, lambda v: v == sentinel)
