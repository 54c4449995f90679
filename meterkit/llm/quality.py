"""Quality classifier by positive-unlabelled learning.

Trusted good documents (positives) are set against unlabelled web text, which
holds good and bad documents alike; no document needs a bad label. The linear
model minimises the non-negative unbiased risk

    prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1))

with the logistic loss: the second term is the bad documents' risk, written by
what positives take away from the unlabelled; where it would become negative
the step goes the other way, which keeps the model from fitting noise. The
class prior is estimated from the data: no set of documents can hold a larger
share of positives than of unlabelled text divided by the prior, so the prior
is the smallest such ratio over the score's upper tails.

Means and scales of the features, and the score tails that the prior comes
from, are Spark aggregations over all usable documents; the weights are fitted
on bounded samples (documented below); every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructType

from meterkit.llm import words as W
from meterkit.llm.scratch import free_name, numbered

#: Rows of the two samples the weights are fitted on, at most. They are the rows
#: with the smallest hashes of their ids, over the whole tables.
POSITIVES = 5_000
UNLABELLED = 10_000
#: Hashed byte trigrams, next to the plain features.
TRIGRAMS = 256
PLAIN = 22
#: Bytes added to a text's length in trigram shares: few trigrams say little.
SHRINK = 500
STEPS = 300
#: Bins of the histogram of scores that the prior is read from, over -BOUND to BOUND.
BINS, BOUND = 4096, 32.0
#: Texts whose features are worked out at once (some 50 KB each).
ROWS = 256
RATE = 0.05
DECAY = 1e-4

_KIND = np.zeros(256, dtype=np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 end marks, 7 beyond ASCII
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 3, 7
_KIND[[0x20, 0x09]], _KIND[[0x0A, 0x0D]], _KIND[[0x2E, 0x2C]] = 4, 5, 6


def features(part: pa.RecordBatch, text: str) -> np.ndarray:
    """One row per text: shares of kinds of bytes, word statistics, and square
    roots of the shares of hashed byte trigrams."""
    data, offsets = W.text_bytes(part.column(text))
    rows = part.num_rows
    size = np.diff(offsets)
    owner = np.repeat(np.arange(rows), size)
    full = np.maximum(size, 1).astype(np.float64)
    kinds = np.bincount(owner * 8 + _KIND[data], minlength=rows * 8).reshape(rows, 8) / full[:, None]
    starts, ends, first = W.spans(data, offsets, W.NOT_SPACE)
    n = np.diff(first)
    many = np.maximum(n, 1).astype(np.float64)
    doc = W.owner(first)
    hashed = W.word_hashes(data, starts, ends)
    same = np.zeros(len(hashed), dtype=bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    slots = doc * 4096 + (hashed & W.U64(4095)).astype(np.int64)
    seen = np.bincount(slots, minlength=rows * 4096).reshape(rows, 4096)
    length = (ends - starts).astype(np.float64)
    marked = np.isin(_KIND[data[ends - 1]], (0,)) if len(ends) else np.zeros(0, dtype=bool)
    upper = _KIND[data[starts]] == 2 if len(starts) else marked
    repeated, odd = np.bincount(doc, same, rows) / many, np.bincount(doc, marked, rows) / many
    distinct = (seen > 0).sum(axis=1) / np.minimum(many, 4096)
    plain = [np.log1p(size), np.log1p(n), np.bincount(doc, length, rows) / many, repeated, distinct, seen.max(axis=1) / many, odd,
             np.bincount(doc, upper, rows) / many, (size == 0).astype(float),
             # roots, where a small share tells much
             np.sqrt(repeated), np.sqrt(odd), np.sqrt(kinds[:, 0]), np.sqrt(kinds[:, 2]), distinct ** 2]
    x = np.empty((rows, PLAIN + TRIGRAMS), dtype=np.float32)
    x[:, :8], x[:, 8:PLAIN] = kinds, np.stack(plain, axis=1)
    wide = data.astype(np.uint32)
    grams = ((wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(24)
    inside = owner[:-2] == owner[2:]
    counts = np.bincount(owner[:-2][inside] * TRIGRAMS + grams[inside], minlength=rows * TRIGRAMS).reshape(rows, TRIGRAMS)
    x[:, PLAIN:] = np.sqrt(counts / (full[:, None] + SHRINK))
    return x


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        # a plain sum per row, so that a score doesn't depend on its neighbours
        z = ((x - self.mean) / self.scale).clip(-8, 8).astype(np.float64)
        return _sigmoid((z * self.weights).sum(axis=1) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int, non_negative: bool) -> tuple[np.ndarray, float]:
    """Adam on the risk above; with ``non_negative`` off, on the risk of
    telling positives from unlabelled text."""
    theta = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w = theta[:-1].astype(np.float32)
        zp, zu = (p @ w).astype(np.float64) + theta[-1], (u @ w).astype(np.float64) + theta[-1]
        up_p, up_u = _sigmoid(zp), _sigmoid(zu)  # slopes of the loss against -1; those against +1 are less by 1
        if non_negative:
            against = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            good, bad_p, bad_u = prior * (up_p - 1) / len(p), -prior * up_p / len(p), up_u / len(u)
            if against < 0:
                good, bad_p, bad_u = 0 * good, -bad_p, -bad_u
            gp, gu = good + bad_p, bad_u
        else:
            gp, gu = (up_p - 1) / len(p), up_u / len(u)
        g = np.append(gp.astype(np.float32) @ p + gu.astype(np.float32) @ u, gp.sum() + gu.sum())
        g[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], theta[-1]


def bin_of(z: np.ndarray) -> np.ndarray:
    return np.clip(((z + BOUND) * (BINS / (2 * BOUND))).astype(np.int64), 0, BINS - 1)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled text, from histograms of scores of
    both: the smallest ratio of the shares at or above a bin, over bins that leave
    enough of both, with a margin for chance."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    p, u = positive[::-1].cumsum()[::-1] / n_p, unlabelled[::-1].cumsum()[::-1] / n_u
    error = np.sqrt(0.25 / n_p) + np.sqrt(0.25 / n_u)
    enough = p >= 0.3
    return float(np.clip(((u[enough] + error) / p[enough]).min(), 0.05, 0.99))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return ((x - mean) / scale).clip(-8, 8)


def first_model(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights that tell positives from unlabelled text, of every other row."""
    return _descend(_standard(positive[::2], mean, scale), _standard(unlabelled[::2], mean, scale), 0.5, STEPS // 2, non_negative=False)


def fit(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float) -> Model:
    """The model of two feature samples and the corpus's means and scales."""
    w, b = _descend(_standard(positive, mean, scale), _standard(unlabelled, mean, scale), prior, STEPS, non_negative=True)
    return Model(mean, scale, w, b, prior)


def unfitted(prior: float | None) -> Model:
    """Without positives, or without unlabelled text, there is nothing to learn
    from: every document gets the prior's score."""
    width, known = PLAIN + TRIGRAMS, 0.5 if prior is None else prior
    return Model(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width), float(np.log(known / (1 - known))), known)


def moments(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and scales of the features of all ``docs``: a partial sum per
    task, three numbers per feature in the end."""
    width = PLAIN + TRIGRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, square = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            for part in W.slices(batch, "text", rows=ROWS):
                x = features(part, "text").astype(np.float64)
                rows, total, square = rows + len(x), total + x.sum(axis=0), square + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, rows)), pa.array(total), pa.array(square)],
                                         names=["i", "n", "s", "q"])

    sums = (docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "i long, n long, s double, q double")
            .groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").toArrow())
    n, s, q = (sums.column(c).to_numpy() for c in ("n", "s", "q"))
    if not len(n) or not n[0]:
        return 0, np.zeros(width, np.float32), np.ones(width, np.float32)
    mean = s / n
    # rounded well above what the order of adding changes
    scale = np.sqrt(np.maximum(q / n - mean * mean, 0)) + 1e-3
    return int(n[0]), np.round(mean, 7).astype(np.float32), np.round(scale, 7).astype(np.float32)


def histogram(docs: DataFrame, text_col: str, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """How the scores of all ``docs`` are spread over BINS bins."""
    shared = docs.sparkSession.sparkContext.broadcast((mean, scale, w, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, w, b = shared.value
        count = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            for part in W.slices(batch, "text", rows=ROWS):
                count += np.bincount(bin_of(_standard(features(part, "text"), mean, scale) @ w + b), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(count)), pa.array(count[count > 0])], names=["bin", "n"])

    rows = (docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "bin long, n long")
            .groupBy("bin").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(BINS, dtype=np.int64)
    for row in rows:
        out[row.bin] = row.n
    return out


def sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ids of the ``n`` rows with the smallest hashes of their ids."""
    return df.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col, F.lit(7)), id_col).limit(n)


def sample_features(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Feature rows of the documents with ``ids`` (a bounded sample), in id order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", rows=ROWS):
                x = features(part, "text")
                raw = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(raw, pa.binary())], names=["id", "x"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids.withColumnRenamed(id_col, "id")), "id")
    rows = chosen.mapInArrow(run, StructType([chosen.schema["id"]]).add("x", BinaryType())).toArrow()
    rows = rows.sort_by([("id", "ascending")])
    if not rows.num_rows:
        return np.zeros((0, PLAIN + TRIGRAMS), dtype=np.float32)
    return np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype=np.float32).reshape(rows.num_rows, -1)


def train(docs: DataFrame, positive_ids: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
          positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """The model of ``docs``: ``positive_ids`` are the trusted good documents,
    ``usable`` says of a document whether training may read it as unlabelled.
    An empty table, or one without positives, gives the prior to every text."""
    good = sample(positive_ids, id_col, positives)
    usable_docs = docs.where(usable)
    web = sample(usable_docs, id_col, unlabelled)
    p, u = (sample_features(docs, ids, id_col, text_col) for ids in (good, web))
    if not len(p) or not len(u):
        return unfitted(prior)
    _, mean, scale = moments(usable_docs, text_col)
    if prior is None:
        w, b = first_model(p, u, mean, scale)
        # positives that the first model hasn't seen, against all usable documents
        held = p[1::2] if len(p) > 1 else p
        prior = estimate_prior(np.bincount(bin_of(_standard(held, mean, scale) @ w + b), minlength=BINS),
                               histogram(usable_docs, text_col, mean, scale, w, b))
    return fit(p, u, mean, scale, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, from 0 to 1: how likely each whole text is good.

    A null text counts as empty and gets the empty text's score. Rows are
    scored one by one: repeats, ties and null columns play no part; an empty
    table gives an empty result. Where ``out`` is taken, the new column is
    ``out`` with ``_1`` appended.
    """
    out = free_name(docs.columns, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain, text = numbered(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text, rows=ROWS):
                y = shared.value.score(features(part, text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(y, pa.float64())], names=[*part.schema.names, "score"])

    return plain.mapInArrow(run, StructType([*plain.schema.fields]).add("score", DoubleType())).toDF(*docs.columns, out)
