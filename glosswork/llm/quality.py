"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of label 1; the unlabelled side is web text drawn
without looking at labels. Labelled negatives are not used: the class prior is estimated
from the same two sides (``estimated_prior``). The model minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with logistic loss over features of the text alone. The fit uses a bounded sample
(``fit_rows`` texts a side, those with the smallest hash of their id); every row is
scored, where it is read.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import text_of

FIT_ROWS = 15_000
# Fixed value of the contract.
THRESHOLD = 0.3

_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".,;:'\"?-()",
            b"!", b"|/\\", b"#$%&*", b"<>{}[]=_~^`@+")
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars)] = _k
FEATURES = len(_CLASSES) + 1 + 9


def features(text: str) -> np.ndarray:
    """Shares of character classes, word and line repetition, and lengths; zeros for
    an empty text."""
    raw = text.encode("utf-8", "replace")
    out = np.zeros(FEATURES)
    if not raw:
        return out
    shares = np.bincount(_CLASS_OF, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=len(_CLASSES) + 1)
    out[: len(shares)] = shares / len(raw)
    words = raw.split()
    n = max(1, len(words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = shares[0] + shares[1]
    out[len(shares):] = (
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(words)) / n,
        len(set(words)) / math.sqrt(n),
        len(set(zip(words, words[1:], strict=False))) / n,
        len(set(lines)) / max(1, len(lines)),
        shares[0] / max(1, letters),
        len(raw) / n,
        math.log1p(n),
        max(map(len, words), default=0) / (20 + len(raw) / n),
    )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = expand((rows - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expand(x: np.ndarray) -> np.ndarray:
    """Standardised features and how far each lies above and below the usual."""
    x = np.clip(x, -6, 6)
    return np.hstack([x, np.maximum(x - 1, 0), np.maximum(-1 - x, 0)])


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Non-negative risk by full-batch Adam. Without positives or unlabelled rows every
    score is the prior."""
    prior = min(max(prior, 0.01), 0.99)
    bias = math.log(prior / (1 - prior))
    if not len(positives) or not len(unlabelled):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(3 * FEATURES), bias, prior)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = expand((positives - mean) / scale), expand((unlabelled - mean) / scale)
    w = np.zeros(p.shape[1] + 1)
    w[-1] = bias
    first, second = np.zeros_like(w), np.zeros_like(w)
    with_bias = lambda x: np.hstack([x, np.ones((len(x), 1))])
    p, u = with_bias(p), with_bias(u)
    for step in range(1, steps + 1):
        zp, zu = np.clip(p @ w, -30, 30), np.clip(u @ w, -30, 30)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        plus = prior * p.T @ (sp - 1) / len(p)
        minus = u.T @ su / len(u) - prior * p.T @ sp / len(p)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Below zero the negative part over-fits: step back up instead.
        gradient = plus + minus if risk >= 0 else -minus
        gradient = gradient + decay * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows: the smallest ratio of the shares of both
    sides that score at least t, over all t that half of the positives or more reach. Where no
    negative scores so high the ratio is the prior, elsewhere it is larger. Scores come from
    models that were fitted on the other half of each side; 0.5 where a side is too small."""
    if min(len(positives), len(unlabelled)) < 4:
        return 0.5
    found = []
    for half in (0, 1):
        model = fit(positives[half::2], unlabelled[half::2], 0.5)
        p, u = (np.sort(model.score(rows[1 - half::2])) for rows in (positives, unlabelled))
        t = np.unique(p[: len(p) // 2 + 1])
        above = [1 - np.searchsorted(side, t) / len(side) for side in (u, p)]
        found.append(np.min(above[0] / above[1]))
    return float(np.mean(found))


def held_out(id_col: str = "doc_id") -> Column:
    """A null id is not held out and has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sampled(ids: DataFrame, id_col: str, rows: int) -> DataFrame:
    return ids.orderBy(F.xxhash64(id_col), id_col).limit(rows)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` positives and as many texts drawn without labels.

    Held-out ids are used for neither. Ids with labels that differ have none; null
    labels and labels without a document are ignored; of rows with the same id one
    counts.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(id_col).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
        .where(F.col("low") == F.col("high")).select(id_col, F.col("low").alias("label"))
    )
    usable = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col)
    positive = _sampled(known.where(F.col("label") == 1).join(usable.distinct(), id_col, "left_semi").select(id_col), id_col, fit_rows)
    drawn = _sampled(usable.distinct(), id_col, fit_rows)
    wanted = (
        positive.withColumn("side", F.lit(1)).unionByName(drawn.withColumn("side", F.lit(2)))
        .groupBy(id_col).agg(F.sum("side").alias("side"))  # 3: on both sides
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(text).tolist() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))],
                                             [id_col, "side", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = (
        docs.select(id_col, text_of(text_col).alias("text"))
        .join(F.broadcast(wanted), id_col)  # at most twice fit_rows ids
        .select(id_col, "side", "text")
        .mapInArrow(measured, f"`{id_col}` {kind}, side bigint, features array<double>")
        .dropDuplicates([id_col])
        .toPandas().sort_values(id_col)
    )
    side = rows["side"].to_numpy()
    x = np.array(rows["features"].tolist(), dtype=float).reshape(len(rows), FEATURES)
    positives, unlabelled = x[side % 2 == 1], x[side >= 2]
    return fit(positives, unlabelled, estimated_prior(positives, unlabelled))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text (0 to 1, higher: rather label 1) in
    ``out_col``, which is replaced where it exists. Null texts are empty; an empty
    text has a score too."""
    kept = [c for c in docs.columns if c != out_col]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            rows = np.array([features(str(text or "")) for text in texts]).reshape(len(texts), FEATURES)
            yield batch.append_column(out_col, pa.array(model.score(rows), pa.float64()))

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(scored, f"{fields}, `{out_col}` double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their own columns."""
    score = "_quality_score"
    while score in docs.columns:
        score += "_"
    return with_scores(docs, model, text_col, score).where(F.col(score) >= threshold).drop(score)
