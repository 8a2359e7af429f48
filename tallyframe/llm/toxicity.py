"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of digits, letters and non-ASCII characters (A-Z as a-z). Labelled documents give labelled tokens: words
and word beginnings that stand out in toxic documents get a shrunk log-odds, and in toxic training documents the tokens
that stand out are labelled toxic, all others (and all tokens of other documents) are not. The field has two states; a
token's potential is linear in its two log-odds, transitions make toxic words come in runs. Forward-backward marginals
of every token of the whole text give the document's score, after a logistic calibration of the expected number of
toxic tokens, and the offsets of the spans.

The lexicon and the field are fitted on at most ``train_rows`` labelled rows outside the held-out fold, in the order of a
digest of the id. Labels, language, source and id are no inputs of a score.

Defined cases: null and empty texts have no tokens and the lowest score that the calibration gives; without labels of
both kinds every score is 0. Null labels are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import crc_mod, field, fresh, plain_names, short_batches

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
TRAIN_ROWS, FOLDS, FOLD = 20_000, 5, 0
#: Bytes of a word's beginnings; rows of the lexicon; documents and tokens of each the field is fitted on.
PREFIXES, LEXICON, FIELD_DOCS, FIELD_TOKENS = (4, 6), 20_000, 1_000, 400
#: Pseudo-documents that shrink a log-odds, the least log-odds kept, and from where a token counts as labelled toxic.
SHRINK, LEAST, STRONG = 10.0, 1.0, 2.5


class Model(NamedTuple):
    lexicon: dict[bytes, float]  # b"w" + word or b"p" + beginning
    emission: list[float]  # bias, word, beginning
    transition: list[float]  # log-weights O-T, T-O, T-T against O-O
    calibration: tuple[float, float]


def token_features(texts: list[bytes | None], lexicon: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Log-odds of the word and the higher one of its beginnings for all tokens in a row, and the number of tokens of each text."""
    whole = {k[1:]: v for k, v in lexicon.items() if k[:1] == b"w"}.get
    begin = {k[1:]: v for k, v in lexicon.items() if k[:1] == b"p"}.get
    sizes, word, start = [], [], []
    short, long = PREFIXES
    for t in texts:
        found = TOKEN.findall(t.lower()) if t else []
        sizes.append(len(found))
        word.extend([whole(w, 0.0) for w in found])
        start.extend([max(begin(w[:short], 0.0), begin(w[:long], 0.0)) for w in found])
    return np.array(word), np.array(start), sizes


def marginals(emission: np.ndarray, sizes: list[int], transition: list[float], pairs: bool = False):
    """P(toxic) of every token; with ``pairs`` also the expected counts of O-T, T-O and T-T transitions.

    Two states need one number per step: the ratio of the toxic to the other path sums. All texts of a batch take the
    same step at once, the longest first, so a step touches those that are long enough.
    """
    n, total = len(sizes), len(emission)
    if not total:
        return (np.zeros(0), np.zeros(3)) if pairs else np.zeros(0)
    ot, to, tt = np.exp(transition)
    lengths = np.array(sizes)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    by_length, first = lengths[order], starts[order]
    active = np.searchsorted(-by_length, -np.arange(1, by_length[0] + 1), side="right") if n else []
    e = np.exp(np.clip(emission, -30, 30))
    forward, backward = np.empty(total), np.empty(total)
    ratio = None
    for t, m in enumerate(active):
        at = first[:m] + t
        ratio = e[at] if t == 0 else e[at] * (ot + tt * ratio[:m]) / (1 + to * ratio[:m])
        forward[at] = ratio
    back = np.ones(n)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        longer = active[t + 1] if t + 1 < len(active) else 0
        if longer:
            x = e[at[:longer] + 1] * back[:longer]
            back[:longer] = (to + tt * x) / (1 + ot * x)
        backward[at] = back[:m]
    odds = forward * backward
    p = odds / (1 + odds)
    if not pairs:
        return p
    inner = np.ones(total, bool)
    inner[starts[lengths > 0]] = False
    here = np.flatnonzero(inner)
    a, x = forward[here - 1], e[here] * backward[here]
    z = 1 + ot * x + a * to + a * tt * x
    return p, np.array([(ot * x / z).sum(), (a * to / z).sum(), (a * tt * x / z).sum()])


def fit_field(word: np.ndarray, start: np.ndarray, sizes: list[int], y: np.ndarray, rounds: int = 150) -> tuple[list[float], list[float]]:
    """Maximum likelihood with a small penalty, by gradient steps of adaptive size."""
    x = np.stack([np.ones(len(word)), word, start])
    inner = np.ones(len(y), bool)
    lengths = np.array(sizes)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    here = np.flatnonzero(inner)
    before, now = y[here - 1], y[here]
    seen = np.array([((1 - before) * now).sum(), (before * (1 - now)).sum(), (before * now).sum()])
    scale = np.concatenate([[len(y), max(1.0, (word > 0).sum()), max(1.0, (start > 0).sum())], np.full(3, max(1.0, y.sum()))])
    theta, velocity = np.array([-3.0, 0.5, 0.5, -1.0, 0.0, 0.0]), np.zeros(6)
    square = np.zeros(6)
    for step in range(1, rounds + 1):
        p, counts = marginals(theta[:3] @ x, sizes, theta[3:], pairs=True)
        gradient = np.concatenate([x @ (y - p), seen - counts]) / scale - 1e-4 * theta
        velocity = 0.9 * velocity + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.15 * (velocity / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        theta = np.clip(theta, -15, 15)
    return theta[:3].tolist(), theta[3:].tolist()


def expected_toxic(p: np.ndarray, sizes: list[int]) -> np.ndarray:
    """log of the expected number of toxic tokens of each text, with a floor."""
    ends = np.cumsum(sizes)
    sums = np.concatenate([[0.0], np.cumsum(p)])
    return np.log(1e-3 + sums[ends] - sums[ends - np.array(sizes)]) if len(sizes) else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model | None:
    order = F.md5(F.col(id_column).cast("string"))
    picked = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & (crc_mod(id_column, FOLDS) != FOLD))
    picked = picked.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y"), order.alias("m")).orderBy("m", "id", "y").limit(train_rows)
    # At most train_rows narrow rows: small enough to send everywhere.
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("binary").alias("t")).join(F.broadcast(picked), "id").select("t", "y", "m")
    sizes = dict(picked.groupBy("y").count().collect())
    if len(sizes) < 2:
        return None
    toxic, other = sizes.get(1, 0), sum(sizes.values()) - sizes.get(1, 0)
    rate = toxic / (toxic + other)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[bytes, list[int]] = {}
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set(TOKEN.findall(t.lower())) if t else set()
                for k in {b"w" + w for w in found} | {b"p" + w[:n] for w in found for n in PREFIXES}:
                    total.setdefault(k, [0, 0])[1 if y == 1 else 0] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.binary()), pa.array([v[1] for v in total.values()], pa.int64()), pa.array([v[0] for v in total.values()], pa.int64())], names=["k", "a", "b"]
            )

    counted = rows.mapInArrow(count, "k binary, a long, b long").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + SHRINK * rate) / (F.col("b") + SHRINK * (1 - rate))) - float(np.log(rate / (1 - rate)))
    top = counted.where("a >= 2").withColumn("s", odds).where(F.col("s") >= LEAST).orderBy(F.desc("s"), "k").limit(LEXICON)
    lexicon = {bytes(r.k): float(r.s) for r in top.select("k", "s").collect()}

    # Half toxic, half other documents for the field; whole documents for the lexicon above and the calibration below.
    chosen = picked.where("y = 1").orderBy("m", "id").limit(FIELD_DOCS // 2).unionByName(picked.where("y <> 1").orderBy("m", "id").limit(FIELD_DOCS // 2))
    sample = docs.select(F.col(id_column).alias("id"), F.col(text).cast("binary").alias("t")).join(F.broadcast(chosen), "id").select("t", "y", "m")

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, start, lengths = token_features(batch.column(0).to_pylist(), lexicon)
            at, out = 0, []
            for n in lengths:
                out.append((word[at : at + n].astype(np.float32).tobytes(), start[at : at + n].astype(np.float32).tobytes()))
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), batch.column(1), batch.column(2)], names=["w", "p", "y", "m"]
            )

    got = sample.mapInArrow(tag, "w binary, p binary, y int, m string").toPandas().sort_values(["m", "w"])
    if (got["y"] == 1).nunique() < 2 or not got["w"].str.len().sum():
        return None
    word = [np.frombuffer(b, np.float32).astype(float) for b in got["w"]]
    start = [np.frombuffer(b, np.float32).astype(float) for b in got["p"]]
    state = [((np.maximum(w, s) >= STRONG) & (y == 1)).astype(float) for w, s, y in zip(word, start, got["y"], strict=True)]
    cut = [slice(0, 0) if not len(w) else window(len(w), s) for w, s in zip(word, state, strict=True)]
    pieces = [[x[c] for x, c in zip(xs, cut, strict=True)] for xs in (word, start, state)]
    emission, transition = fit_field(*(np.concatenate(p) for p in pieces[:2]), [len(p) for p in pieces[0]], np.concatenate(pieces[2]))
    flat = [np.concatenate(word), np.concatenate(start)]
    lengths = [len(w) for w in word]
    p = marginals(emission[0] + emission[1] * flat[0] + emission[2] * flat[1], lengths, transition)
    return Model(lexicon, emission, transition, calibrate(expected_toxic(p, lengths), (got["y"] == 1).to_numpy(float), rate))


def window(n: int, state: np.ndarray) -> slice:
    """The tokens the field is fitted on: about the middle toxic token, or the first ones."""
    marked = np.flatnonzero(state)
    middle = int(marked[len(marked) // 2]) if len(marked) else 0
    begin = max(0, min(middle - FIELD_TOKENS // 2, n - FIELD_TOKENS))
    return slice(begin, begin + FIELD_TOKENS)


def calibrate(x: np.ndarray, y: np.ndarray, rate: float, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope of a logistic regression; the rows are weighted so that both kinds stand as in ``rate``."""
    weight = np.where(y == 1, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9))
    z = np.stack([np.ones(len(x)), x])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        hessian = (z * (weight * p * (1 - p))) @ z.T + 1e-2 * np.eye(2)
        w += np.linalg.solve(hessian, z @ (weight * (y - p)) - 1e-2 * w)
    return float(w[0]), float(max(w[1], 0.0))


@plain_names
def score(docs: DataFrame, labels: DataFrame | None = None, *, model: Model | None = None, text: str = "text", **options) -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` and one struct column more, whose name is returned too.

    Its fields: score (0 to 1) and spans (code point offsets of runs of tokens that are toxic with 0.5 or more, and the
    highest probability in each).
    """
    short_batches(docs.sparkSession)
    model = model or train(docs, labels, text=text, **options)
    # Plain values: executors have no copy of this module to read a class from.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model) if model is not None else None)
    source, out, kept = fresh(docs, "_bytes"), fresh(docs, "toxicity"), docs.columns
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value) if shared.value is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(source).to_pylist()
            if m is None:
                rows = [{"score": 0.0, "spans": []}] * len(texts)
            else:
                word, start, sizes = token_features(texts, m.lexicon)
                p = marginals(m.emission[0] + m.emission[1] * word + m.emission[2] * start, sizes, m.transition)
                scores = 1 / (1 + np.exp(-np.clip(m.calibration[0] + m.calibration[1] * expected_toxic(p, sizes), -30, 30)))
                rows, at = [], 0
                for t, n, s in zip(texts, sizes, scores.tolist(), strict=True):
                    mine = p[at : at + n]
                    at += n
                    rows.append({"score": s, "spans": spans(t, mine) if n and mine.max() >= 0.5 else []})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, kind)], names=[*kept, out])

    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())]))
    verdict = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", spans_type)])
    rows = docs.withColumn(source, F.col(text).cast("binary"))
    return rows.mapInArrow(run, T.StructType([*[field(docs, c) for c in kept], T.StructField(out, verdict)])), out


def spans(text: bytes, p: np.ndarray) -> list[dict]:
    at = [m.span() for m in TOKEN.finditer(text.lower())]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (p >= 0.5).astype(np.int8), [0]]))).reshape(-1, 2)
    chars = np.cumsum(np.concatenate([[0], (np.frombuffer(text, np.uint8) & 0xC0) != 0x80]))
    return [{"start": int(chars[at[a][0]]), "end": int(chars[at[b - 1][1]]), "probability": float(p[a:b].max())} for a, b in edges.tolist()]
