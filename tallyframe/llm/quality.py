"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on shape features of the whole text gives each document its own evidence. Grouped sums of that
evidence per host and per path then give site posteriors: a path is shrunk towards its host, a host towards the global
mean, each with a strength (pseudo-documents) estimated from how much sites differ (method of moments). A document's
score adds to its own log-odds what its path's posterior says beyond the global mean, without the document itself.

The regression is fitted on at most ``train_rows`` labelled rows outside the held-out fold (in the order of a digest of
the id); everything else covers all rows. Labels are never inputs of a score, nor are ids.

Defined cases: null and empty texts have all features zero; a null host or path is a site of its own; without labels of
both kinds the evidence is 0.5 for every document; labels that are null are ignored, a repeated label row counts once
per row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import crc_mod, field, fresh, plain_names, short_batches, staged

TRAIN_ROWS = 20_000
FOLDS, FOLD = 5, 0
THRESHOLD = 0.5
#: Strengths are kept in this range of pseudo-documents.
STRENGTH = (2.0, 1e6)

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"%$&*#@", b"-_=+~^", b"()[]{}<>", b"\"'`", b":;/\\", b"\t\r\x0b\x0c"]
_TABLE = np.full(256, len(_CLASSES), dtype=np.uint8)  # other control characters
for _i, _c in enumerate(_CLASSES):
    _TABLE[list(_c)] = _i
_TABLE[128:192] = len(_CLASSES) + 1  # bytes that continue a character
_TABLE[192:] = len(_CLASSES) + 2
N_CLASSES = len(_CLASSES) + 3
N_FEATURES = 2 * (N_CLASSES + 8) + 1


def features(texts: list[bytes | None], table: np.ndarray = _TABLE) -> np.ndarray:
    """Shares of character classes, word and line statistics, and their square roots; a last 1 for the intercept."""
    out = np.zeros((len(texts), N_CLASSES + 8))
    for i, t in enumerate(texts):
        if not t:
            continue
        counts = np.bincount(table[np.frombuffer(t, np.uint8)], minlength=N_CLASSES)
        words, lines = t.split(), t.split(b"\n")
        n = max(1, len(words))
        out[i, :N_CLASSES] = counts / len(t)
        kinds = set(words)
        out[i, N_CLASSES:] = [
            np.log1p(len(words)) / 10, len(t) / n / 20, len(kinds) / n, len(kinds) / np.sqrt(n) / 20, len(set(lines)) / len(lines),
            np.log1p(len(t) / len(lines)) / 10, counts[1] / max(1, counts[0] + counts[1]), counts[5:15].sum() / n,
        ]
    return np.hstack([out, np.sqrt(out), np.ones((len(texts), 1))])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method, on standardised columns; the weights are for the columns as given."""
    scale = x.std(axis=0)
    scale[scale == 0] = 1.0
    shift = x.mean(axis=0)
    shift[-1] = 0.0
    z, w = (x - shift) / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (y - p) - ridge * len(y) * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = w / scale
    raw[-1] = w[-1] - (w[:-1] * shift[:-1] / scale[:-1]).sum()
    return raw


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> list[float]:
    """The weights; all zero if the sample has one kind of label only."""
    order = F.md5(F.col(id_column).cast("string"))
    picked = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & (crc_mod(id_column, FOLDS) != FOLD))
    picked = picked.select(F.col(id_column).alias("id"), F.col(label).cast("double").alias("y"), order.alias("_m")).orderBy("_m", "id", "y").limit(train_rows)
    # At most train_rows narrow rows: small enough to send everywhere.
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("binary").alias("t")).join(F.broadcast(picked), "id").select("id", "t", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = features(batch.column(1).to_pylist()).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    got = rows.mapInArrow(run, "id string, y double, x binary").toPandas().sort_values(["id", "y"])
    if got["y"].nunique() < 2:
        return [0.0] * N_FEATURES
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1).astype(float)
    return fit(x, got["y"].to_numpy()).tolist()


def with_evidence(docs: DataFrame, weights: list[float], text: str, out: str) -> DataFrame:
    """Add the log-odds of each whole text; all columns and rows stay."""
    short_batches(docs.sparkSession)
    source, kept = fresh(docs, "_bytes"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for batch in batches:
            if batch.num_rows:
                scores = np.clip(features(batch.column(source).to_pylist()) @ w, -30, 30)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, out])

    schema = T.StructType([*[field(docs, c) for c in kept], T.StructField(out, T.DoubleType())])
    return docs.withColumn(source, F.col(text).cast("binary")).mapInArrow(run, schema)


def key(column: Column) -> Column:
    """Site keys are never null."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("n"))


def probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def strength(groups: DataFrame, mean: str) -> float:
    """Pseudo-documents of the prior: pooled variance inside groups over the variance between their true means.

    ``groups``: n, s (sum of p), q (sum of p * p), and the prior mean of each.
    """
    r = groups.agg(
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("inside"), F.sum(F.col("n") - 1).alias("free"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(mean)) ** 2).alias("between"), F.count("*").alias("k"), F.sum("n").alias("n"),
    ).first()
    if not r.n or not r.free:
        return STRENGTH[1]
    inside = max(r.inside / r.free, 1e-9)
    spread = (r.between / max(1, r.k) - inside) / max(1e-9, r.n / max(1, r.k))
    return float(min(max(inside / spread, STRENGTH[0]), STRENGTH[1])) if spread > 0 else STRENGTH[1]


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float, float]:
    """One row per (host, path): path sums and the shrunk host mean; the strength of paths and the global mean.

    ``evidence``: host, path (keys), p. Sums per path are taken first, so a hot host is a few sums.
    """
    paths = staged(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = 0.5 if total is None else float(total)
    alpha = strength(hosts.withColumn("mean", F.lit(mean)), "mean")
    hosts = hosts.select("host", ((F.col("s") + alpha * mean) / (F.col("n") + alpha)).alias("host_mean"))
    both = paths.join(hosts, "host")
    beta = strength(both, "host_mean")
    # Written, so that its size is known and small tables are broadcast by Spark itself, large ones are not.
    return staged(both.select("host", "path", "n", "s", "host_mean")), beta, mean


@plain_names
def score(
    docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", host: str | Column = "source", path: str | Column = "lang",
    label: str = "quality", train_rows: int = TRAIN_ROWS,
) -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` and one struct column more, whose name is returned too.

    Its fields: own (the document's own probability), host, path (posterior means, the path's without this document),
    score.
    """
    weights = train(docs, labels, id_column=id_column, text=text, label=label, train_rows=train_rows)
    sites = {n: key(F.col(c) if isinstance(c, str) else c) for n, c in (("host", host), ("path", path))}
    narrow = docs.select(text, *[c.alias(f"_{n}") for n, c in sites.items()])
    known = with_evidence(narrow, weights, text, "_e").select(F.col("_host").alias("host"), F.col("_path").alias("path"), probability(F.col("_e")).alias("p"))
    table, beta, mean = site_posteriors(known)
    out = fresh(docs, "quality_score")
    names = {n: fresh(docs, f"_{n}") for n in ("e", "host", "path")}
    rows = with_evidence(docs, weights, text, names["e"]).withColumns({names[n]: c for n, c in sites.items()})
    table = table.select(F.col("host").alias("_h"), F.col("path").alias("_p"), *[F.col(c).alias(f"_t_{c}") for c in ("n", "s", "host_mean")])
    rows = rows.join(table, (F.col(names["host"]) == F.col("_h")) & (F.col(names["path"]) == F.col("_p")), "left")
    own = probability(F.col(names["e"]))
    # The document itself is taken out of its path; a path of one document is all prior.
    others = (F.greatest(F.col("_t_s") - own, F.lit(0.0)) + beta * F.col("_t_host_mean")) / (F.col("_t_n") - 1 + beta)
    others = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    base = min(max(mean, 1e-6), 1 - 1e-6)
    logit = F.col(names["e"]) + F.log(others / (1 - others)) - float(np.log(base / (1 - base)))
    parts = F.struct(own.alias("own"), F.col("_t_host_mean").alias("host"), others.alias("path"), probability(logit).alias("score"))
    return rows.withColumn(out, parts).select(*docs.columns, out), out


@plain_names
def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    scored, out = score(docs, labels, **options)
    return scored.where(F.col(out).getField("score") >= threshold).drop(out)
