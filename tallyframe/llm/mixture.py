"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Every source gets a share of the wanted words by its weight, but at most ``cap`` times its own size; what capped sources
cannot take is shared out again among the others by weight, until no target is above its cap. A target of 2.3 times a
source is two whole repetitions of each document and a part of a third one: documents in the order of a seeded digest,
up to the missing number of words; the document at the edge is taken in part, so targets are met to the word.

Sources with a third of all rows are no special case: words are summed per source and slice of the digest before
anything is ordered, then per finer slice inside the one slice at the edge, and only the rows of that last slice
(a millionth of the source) are ordered.

Defined cases: null texts have no words; a null source is a source of its own, the last in order; an empty text and a
source without words take nothing. Rows that are equal in id and source share a digest and lie next to each other, the
shorter text first; which of two equal rows is taken in part does not change the multiset of the result. An empty table
gives an empty result. Targets are rounded to whole words, halves up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyframe.llm.common import checkpoint, fresh, plain_names, staged

WORDS = r"[^\x20\x09-\x0D]+"
CAP, SEED = 3, "mix-1"
WEIGHTS = (1, 2, 3)
#: Hex digits of the digest that each level of slices adds: 4096 slices.
SLICE = 3
#: Rows of the source table are repeated so often, and rows of a source dealt over as many keys, to join a hot source.
SALTS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as the source does by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Weights in the order of the source keys, repeating. ``sizes`` has one row per source."""
    order = F.row_number().over(Window.orderBy("key")) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights)).cast("int") + 1).cast("double"))


def water_filling(sizes: DataFrame, cap: float = CAP, total: float | None = None) -> DataFrame:
    """Add ``target`` to rows (key, size, weight): each round clamps what is above its cap and shares out the rest.

    ``total`` is what all targets should add up to, the sum of the sizes if not given. It is met unless all sources are
    capped. Only three sums per round come to the driver; the number of rounds is at most the number of sources.
    """
    limit = F.col("size") * F.lit(float(cap))
    sizes = checkpoint(sizes)
    wanted = total if total is not None else float(sizes.agg(F.sum("size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > limit
        n, held, open_weight = sizes.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == clamped or open_weight == 0:
            break
        clamped, level = n, max(level, (wanted - held) / open_weight)
    return sizes.withColumn("target", F.least(F.col("weight") * F.lit(level), limit) if clamped >= 0 else F.lit(0.0))


def per_source(rows: DataFrame, table: DataFrame, salt: Column) -> DataFrame:
    """Join each row with its source's row; hot sources are dealt over SALTS keys."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    return rows.withColumn("_salt", salt).join(table.select("*", salts), ["key", "_salt"], "left").drop("_salt")


def mixture(
    docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", source: str = "source", cap: float = CAP,
    weights: DataFrame | tuple[float, ...] = WEIGHTS, total: float | None = None, seed: str = SEED, row: str | None = None,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target (of its source), taken (words, repeats counted).

    ``weights``: weights to repeat over the ordered sources, or a table (source, weight). ``row``: a column that tells
    rows of one id apart, returned as well.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"))
    rows = staged(
        docs.select(
            F.col(id_column).alias("id"), F.col(source).alias("source"), source_key(F.col(source)).alias("key"), n_words(F.col(text)).alias("size"), digest.alias("digest"),
            (F.col(row) if row else F.lit(None)).cast("long").alias("row"),
        )
    )
    sizes = rows.groupBy("key").agg(F.sum("size").alias("size"))
    if isinstance(weights, tuple):
        weighted = cyclic_weights(sizes, weights)
    else:
        weighted = sizes.join(weights.select(source_key(F.col("source")).alias("key"), F.col("weight").cast("double")), "key")
    plan = water_filling(weighted, cap, total)
    # Whole repetitions, and the words of one more repetition that are still missing.
    # Both follow from the target in whole words, so the missing part is always smaller than the source.
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    plan = plan.withColumn("rest", F.when(F.col("size") > 0, wanted % F.col("size")).otherwise(0))
    plan = plan.withColumn("whole", F.when(F.col("size") > 0, F.floor((wanted - F.col("rest")) / F.col("size"))).otherwise(0)).withColumnRenamed("size", "source_size")
    # Two rounds of slices: find the slice in which the missing words run out, then look only into that.
    edge = plan.select("key", "rest", F.lit("").alias("prefix"))
    inside = rows.select("key", "size", "digest")
    for level in (1, 2):
        inside = inside.withColumn("slice", F.substring("digest", 1, level * SLICE))
        slices = inside.groupBy("key", "slice").agg(F.sum("size").alias("words"))
        if level > 1:
            slices = slices.join(edge, "key")
        else:
            slices = per_source(slices, edge.select("key", "rest"), F.pmod(F.crc32("slice"), F.lit(SALTS)).cast("int"))
        before = F.sum("words").over(Window.partitionBy("key").orderBy("slice")) - F.col("words")
        slices = slices.withColumn("before", before)
        at_edge = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
        edge = checkpoint(slices.where(at_edge).select("key", F.col("slice").alias("prefix"), (F.col("rest") - F.col("before")).alias("rest")))
        # A slice at the edge is one in thousands of its source.
        inside = inside.join(edge.select("key", F.col("prefix").alias("slice")), ["key", "slice"], "left_semi").drop("slice")
    table = plan.join(edge.select("key", "prefix", F.col("rest").alias("left")), "key", "left")
    joined = per_source(rows, table, F.pmod(F.crc32("digest"), F.lit(SALTS)).cast("int"))
    head = F.substring("digest", 1, 2 * SLICE)
    # Without an edge nothing is missing: the source has no words.
    base = F.when(F.col("prefix").isNull() | (head > F.col("prefix")), 0).otherwise(F.col("size"))
    joined = joined.withColumn("part", F.when(F.col("prefix").isNotNull() & (head == F.col("prefix")), None).otherwise(base))
    done, open_rows = joined.where(F.col("part").isNotNull()), joined.where(F.col("part").isNull())
    order = Window.partitionBy("key", "prefix").orderBy("digest", "size", "id", "row")
    ahead = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_rows = open_rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - ahead)))
    taken = (F.col("whole") * F.col("size") + F.col("part")).cast("long")
    both = done.unionByName(open_rows)
    return both.select(F.col("id").alias(id_column), "source", "size", "source_size", "target", taken.alias("taken"), *([F.col("row").alias(row)] if row else []))


@plain_names
def mix(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` repeated as the mixture says. A document taken in part is cut after so many words.

    Rows are numbered and written first, so that rows of one id (or of none) are told apart and each gets its own share.
    """
    row, size, taken = (fresh(docs, c) for c in ("_row", "_size", "_taken"))
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = mixture(numbered, id_column=id_column, text=text, source=source, row=row, **options).where(F.col("taken") > 0)
    rows = numbered.join(plan.select(row, F.col("size").alias(size), F.col("taken").alias(taken)), row).drop(row)
    n = fresh(rows, "_n")
    copies = F.ceil(F.col(taken) / F.col(size)).cast("int")
    rows = rows.withColumn(n, F.explode(F.sequence(F.lit(1), copies)))
    left = (F.col(taken) - (F.col(n) - 1) * F.col(size)).cast("int")
    return rows.withColumn(text, F.when(left >= F.col(size), F.col(text)).otherwise(first_words(F.col(text), left))).drop(size, taken, n)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORDS}"), F.lit(0))
    return F.array_join(F.slice(pieces, 1, n), "")
