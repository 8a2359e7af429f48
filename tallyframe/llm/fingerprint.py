"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text's terms are its shingles of five words, weighted by how often they occur. For each of ``samples`` rounds every
term draws, from hashes of the term and the round, r and c from Gamma(2, 1) and b from [0, 1). With
t = floor(ln(weight) / r + b), the term with the least c * exp(-r * (t - b) - r) is the round's sample. Two texts have the
same sample with a probability equal to their generalised Jaccard similarity (sum of the lesser weights over the sum of
the greater ones), so the share of equal samples estimates it. The least value itself stands for the pair (term, t).

r and b come from two uniform numbers u and v: -ln(u) and -ln(v) are independent exponentials, so their sum r is from
Gamma(2, 1) and the share b = -ln(v) / r of the second is uniform and independent of r. The value is then
c * u * (u * v) ** t, and since t is 0 at weight 1, the usual term takes two hashes and one logarithm a round.

Neighbours in descending order of the id are found inside ranges of ids, cut by quantiles: the text is shuffled by
range, and each range is also given the first document of the next one. All later groupings keep that partitioning.

Defined cases: null and empty texts, and texts of white space, have no terms; their fingerprints are equal to each other
and to no other's. A text of fewer than five words is one term. Null ids come last in descending order; rows with equal
ids are ordered by text, and each gets its own row. A single document is its own next one. No id is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import staged

#: Draws of a fingerprint: the standard error of a likeness s is sqrt(s * (1 - s) / SAMPLES), 0.044 at most with 128.
SAMPLES, SHINGLE = 128, 5
#: Rounds that one row computes; many more would make generated methods too long to be compiled.
ROUNDS = 32
ROWS_PER_RANGE, RANGES = 500, 65_536
SPACES = r"[\x20\x09-\x0D]+"


def shingles(words: Column) -> Column:
    """Hashes of all runs of five words; of all words where there are fewer."""
    size = F.size(words)
    run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    return (
        F.when(size >= SHINGLE, F.transform(F.sequence(F.lit(0), size - SHINGLE), run))
        .when(size > 0, F.array(F.xxhash64(F.array_join(words, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def unit(bits: Column) -> Column:
    """A number in (0, 1) from 32 bits."""
    return (bits + 0.5) / 2.0**32


def draw(term: Column, number: Column) -> tuple[Column, Column, Column]:
    """One round of a term: its value at weight 1, u and v; the last two are what other weights need."""
    pair, other = F.xxhash64(term, number * 2), F.xxhash64(term, number * 2 + 1)
    low, high = (lambda h: unit(h.bitwiseAND(0xFFFFFFFF))), (lambda h: unit(F.shiftrightunsigned(h, 32)))
    return -F.ln(low(other) * high(other)) * low(pair), low(pair), high(pair)


def value_at(weight: Column, at_one: Column, u: Column, v: Column) -> Column:
    """The value of a round at an integer weight; null at 0."""
    step = F.floor((F.ln(weight) - F.ln(v)) / -F.ln(u * v))
    return F.when(weight == 1, at_one).when(weight > 1, at_one * F.pow(u * v, step))


def signature(terms: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """One fingerprint per ``keys`` and weight column, named as the weight: eight hex digits for each sample.

    ``terms``: keys, term (long) and one or more weights (0: the text does not have the term). A null term, of weight 0,
    gives keys without terms a row.
    """
    chunks, shared = -(-samples // ROUNDS), len(weights)
    # A term of one weight throughout is drawn once, in a set of its own; any other once for each weight.
    once = F.array(F.struct(F.lit(shared).alias("_set"), F.col(weights[0]).cast("long").alias("_weight")))
    each = F.array(*[F.struct(F.lit(i).alias("_set"), F.col(w).cast("long").alias("_weight")) for i, w in enumerate(weights)])
    same = F.lit(True)
    for w in weights[1:]:
        same = same & (F.col(w) == F.col(weights[0]))
    listed = terms.select(*keys, "term", F.inline(F.when(same, once).otherwise(each))).where("_weight > 0 OR term IS NULL")
    # Of weight 1, a row makes all rounds of a chunk; of more, which few terms are, the one round that it is for.
    single, rounds = F.array(*[F.lit(i * ROUNDS) for i in range(chunks)]), F.sequence(F.lit(0), F.lit(chunks * ROUNDS - 1))
    rows = listed.select("*", F.explode(F.when(F.col("_weight") > 1, rounds).otherwise(single)).alias("_round"))
    place = F.pmod("_round", F.lit(ROUNDS))
    heavier = F.when(F.col("_weight") > 1, value_at(F.col("_weight"), *draw(F.col("term"), F.col("_round"))))
    rows = rows.withColumns({"_chunk": F.col("_round") - place, "_place": place, "_value": heavier})
    value = lambda j: F.when(F.col("_weight") == 1, draw(F.col("term"), F.col("_chunk") + j)[0]).when(F.col("_place") == j, F.col("_value"))
    by_set = rows.groupBy(*keys, "_chunk", "_set").agg(*[F.min(value(j)).alias(f"_{j}") for j in range(ROUNDS)])
    by_set = by_set.select(*keys, "_chunk", "_set", F.array(*[f"_{j}" for j in range(ROUNDS)]).alias("_least"))
    least = by_set.groupBy(*keys, "_chunk").agg(*[F.max(F.when(F.col("_set") == i, F.col("_least"))).alias(f"_s{i}") for i in range(shared + 1)])
    part = lambda c: F.lower(F.lpad(F.hex(F.shiftrightunsigned(F.xxhash64(c), 32)), 8, "0"))
    lesser = lambda i: F.coalesce(F.zip_with(f"_s{i}", f"_s{shared}", lambda x, y: F.least(x, y)), F.col(f"_s{i}"), F.col(f"_s{shared}"))
    missing = F.array_repeat(F.lit(None).cast("double"), ROUNDS)
    pieces = least.select(*keys, "_chunk", *[F.array_join(F.transform(F.coalesce(lesser(i), missing), part), "").alias(w) for i, w in enumerate(weights)])
    whole = lambda w: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", w))), lambda s: s[w]), "")
    return pieces.groupBy(*keys).agg(*[F.substring(whole(w), 1, samples * 8).alias(w) for w in weights])


def no_terms(samples: int) -> Column:
    """The fingerprint of a text without terms."""
    empty = F.lower(F.lpad(F.hex(F.shiftrightunsigned(F.xxhash64(F.lit(None).cast("double")), 32)), 8, "0"))
    return F.repeat(empty, samples)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints."""
    parts = lambda c: F.regexp_extract_all(c, F.lit("(.{8})"), F.lit(1))
    # Cut once: looking for each place from the start of the text costs the square of its length.
    same = F.size(F.filter(F.zip_with(parts(a), parts(b), lambda x, y: x == y), lambda x: x))
    return F.when(a.isNotNull() & b.isNotNull(), same / F.lit(float(samples)))


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, fingerprint) of whole texts, for ids that are unique; the general form without neighbours."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), lambda w: w != "")
    rows = docs.select(F.col(id_column).alias("id"), words.alias("words"))
    terms = rows.select("id", F.explode(shingles(F.col("words"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("fingerprint"))
    found = signature(terms, ["id"], ["fingerprint"], samples)
    every = docs.select(F.col(id_column).alias("id")).join(found, "id", "left")
    return every.select(F.col("id").alias(id_column), F.coalesce("fingerprint", no_terms(samples)).alias("fingerprint"))


def id_ranges(docs: DataFrame, id_column: str) -> tuple[Column, list[tuple[int, int | None]]]:
    """The range number of an id, counted from the highest ids down, and the first id of each range that has rows."""
    ids = docs.select(F.col(id_column).cast("long").alias("id"))
    n = ids.count()
    wanted = int(min(RANGES, max(1, n // ROWS_PER_RANGE)))
    bounds: list[int] = []
    if wanted > 1:
        shares = F.expr("cast(split('%s', ',') as array<double>)" % ",".join(str(i / wanted) for i in range(1, wanted)))
        bounds = sorted(set(ids.agg(F.percentile_approx("id", shares, max(10_000, 10 * wanted))).first()[0] or ()))
    # Two steps, so that a row looks at about two times the root of the number of bounds.
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lit = lambda values: F.expr("cast(split('%s', ',') as array<bigint>)" % ",".join(map(str, values)))
    value = F.col("id")
    number = F.lit(0)
    if bounds:
        at = F.size(F.filter(lit([g[0] for g in groups]), lambda b: b <= value))
        inner = F.split(F.get(F.split(F.lit(";".join(",".join(map(str, g)) for g in groups)), ";"), F.greatest(at - 1, F.lit(0))), ",").cast("array<bigint>")
        below = F.when(at == 0, 0).otherwise((at - 1) * step + F.size(F.filter(inner, lambda b: b <= value)))
        number = F.lit(len(bounds)) - below
    number = F.when(value.isNull(), len(bounds) + 1).otherwise(number).cast("int")
    # At most one number per range.
    firsts = ids.groupBy(number.alias("r")).agg(F.max("id").alias("first")).collect()
    return number, sorted((r.r, r.first) for r in firsts)


def neighbours(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(range, place, halo, id, text, next): each text and the next one in descending order of the id.

    Rows with ``halo`` are the first document of the next range again; they close a range.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    number, firsts = id_ranges(docs, id_column)
    own = rows.select(number.alias("range"), F.lit(0).alias("halo"), "id", "text")
    after = [(firsts[i][0], firsts[(i + 1) % len(firsts)][1]) for i in range(len(firsts))]
    # One narrow row per range: at most RANGES + 1. An id that is null is an empty text here.
    listed = F.explode(F.split(F.lit(",".join(f"{r}:{'' if first is None else first}" for r, first in after)), ",")).alias("x")
    part = lambda i, kind: F.get(F.split("x", ":"), F.lit(i)).try_cast(kind)
    wanted = docs.sparkSession.range(1).select(listed).select(part(0, "int").alias("range"), part(1, "long").alias("first"))
    halo = rows.join(F.broadcast(wanted), F.col("id").eqNullSafe(F.col("first"))).groupBy("range").agg(F.lit(1).alias("halo"), F.max("id").alias("id"), F.min("text").alias("text"))
    order = Window.partitionBy("range").orderBy("halo", F.col("id").desc_nulls_last(), "text")
    both = own.unionByName(halo.select("range", "halo", "id", "text"))
    return both.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The last third (rounded down) of the text replaced by the first as many characters of another."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def compare(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see ``neighbours`` and ``edited``."""
    rows = neighbours(docs, id_column=id_column, text=text)
    keys = ["range", "place"]
    texts = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.when(F.col("halo") == 0, edited(F.col("text"), F.col("next"))).alias("t")))
    split = rows.select(*keys, F.explode(texts).alias("x")).select(*keys, "x.kind", F.filter(F.split("x.t", SPACES), lambda w: w != "").alias("words"))
    # A text without terms has one row with a null term, so that it is there as its neighbour's next one.
    terms = split.select(*keys, "kind", F.explode_outer(shingles(F.col("words"))).alias("term"))
    count = lambda kind: F.count(F.when(F.col("kind") == kind, F.col("term")))
    weights = terms.groupBy(*keys, "term").agg(count(0).alias("fingerprint"), count(1).alias("edited_fingerprint"))
    found = signature(weights, keys, ["fingerprint", "edited_fingerprint"], samples)
    # Compared where they are made, by range: what the join deals anew is final.
    following = F.lead("fingerprint").over(Window.partitionBy("range").orderBy("place"))
    found = found.withColumn("following", following).select(
        *keys, "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("following"), samples).alias("near_next"),
    )
    new = edited(F.col("text"), F.col("next"))
    facts = rows.select(*keys, "halo", "id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(new.cast("binary"), 256).alias("edited_sha256"))
    # Written first, so that the texts are not on disk for both sides of the join at once.
    joined = staged(facts.where("halo = 0").drop("halo")).join(found, keys)
    return joined.select(F.col("id").alias(id_column), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
