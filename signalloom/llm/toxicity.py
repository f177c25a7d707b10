"""Toxicity scores by a linear classifier over character n-grams (dealt operator 8).

Features are hashed character n-grams of the lower-cased text with single blanks; a feature's value in a text is
``log(1 + occurrences)``, scaled by the feature's naive Bayes log-count ratio between the classes. A logistic
regression over the scaled features is fitted on a bounded sample of labelled rows. Scoring reads every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
SIZES = (3, 4, 5)
#: Characters hashed at a time, so that very long texts need bounded memory.
SPAN = 1 << 18


@dataclass(frozen=True)
class Model:
    """Weight per hashed n-gram (already scaled by its ratio), and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def hashed_ngrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, span by span."""
    plain = f" {' '.join(text.lower().split())} "
    for at in range(0, len(plain), SPAN):
        part = plain[at : at + SPAN + max(SIZES) - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        for size in SIZES:
            starts = min(SPAN, len(plain) - at, max(0, len(codes) - size + 1))
            value = np.full(starts, size, np.uint64)
            for k in range(size):
                value = (value ^ codes[k : k + starts]) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
            yield (value >> np.uint64(64 - BITS)).astype(np.int64)


def counted(text: str, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The text's features (only those marked in ``wanted``) and their occurrences."""
    found = [h if wanted is None else h[wanted[h]] for h in hashed_ngrams(text)]
    return np.unique(np.concatenate(found), return_counts=True)


def fit(texts: list[str], labels: list[int], weights: list[float], least_z: float = 4.0, steps: int = 200) -> Model:
    """``weights``: what each row stands for. Ratios within ``least_z`` standard errors of zero count as zero,
    so chance n-grams of a small sample take no part."""
    toxic = np.asarray(labels) == 1
    weight = np.asarray(weights, float)
    rows = [counted(t) for t in texts]
    present = [np.ones(1 << BITS), np.ones(1 << BITS)]
    for (features, _), label in zip(rows, toxic, strict=True):
        present[int(label)][features] += 1
    n_clean, n_toxic = int((~toxic).sum()), int(toxic.sum())
    if not n_clean or not n_toxic:
        share = float(np.average(toxic, weights=weight)) if len(rows) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    ratio = np.log(present[1] / (n_toxic + 2)) - np.log(present[0] / (n_clean + 2))
    ratio[np.abs(ratio) < least_z * np.sqrt(1 / present[0] + 1 / present[1])] = 0
    kept = np.flatnonzero(ratio)
    index = np.full(1 << BITS, -1, np.int64)
    index[kept] = np.arange(len(kept))
    where, values, owner = [], [], []
    for i, (features, times) in enumerate(rows):
        hit = ratio[features] != 0
        where.append(index[features[hit]])
        values.append(np.log1p(times[hit]) * ratio[features[hit]])
        owner.append(np.full(int(hit.sum()), i))
    at, x, row = np.concatenate(where), np.concatenate(values), np.concatenate(owner)
    totals = [weight[~toxic].sum(), weight[toxic].sum()]
    # the rarer class counts more, by the root of the imbalance
    weight = np.where(toxic, weight * np.sqrt(totals[0] / totals[1]), weight)
    weight = weight / weight.sum()
    beta, bias = np.zeros(len(kept) + 1), 0.0
    first, second = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, steps + 1):
        margin = np.bincount(row, weights=beta[at] * x, minlength=len(rows)) + beta[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - toxic) * weight
        slope = np.bincount(at, weights=error[row] * x, minlength=len(kept) + 1) + 1e-4 * beta
        slope[-1] = error.sum()
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        beta -= 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    bias = float(beta[-1])
    return Model(kept, beta[:-1] * ratio[kept], bias)


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Scores between 0 and 1."""
    table = np.zeros(1 << BITS)
    table[model.features] = model.weights
    wanted = np.zeros(1 << BITS, bool)
    wanted[model.features] = True
    margins = np.empty(len(texts))
    for i, text in enumerate(texts):
        features, times = counted(text, wanted)
        margins[i] = model.bias + float((table[features] * np.log1p(times)).sum())
    return 1 / (1 + np.exp(-np.clip(margins, -60, 60)))


def held_out(doc_id: str = "doc_id"):
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class that are not held out, those with the lowest
    hash of the id; each row weighs as many as its class has for one. The sample is read whole by one task.

    An id labelled twice counts once, toxic if any of its labels says so. Null labels and ids are left out."""
    known = labels.where("doc_id is not null and toxic is not null and toxic in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.lit(29), "doc_id")
    sample = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(per_class)
        sample = some if sample is None else sample.unionByName(some)
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # 2 * per_class ids at most; an id that occurs more often in docs is reduced to one row per text
    rows = texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "text"]).coalesce(1)
    rows = rows.sortWithinPartitions("doc_id", "text")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = [b for b in batches if len(b)]
        if data:
            rows = pd.concat(data)
            taken = rows.toxic.value_counts().to_dict()
            weights = [sizes[t] / taken[t] for t in rows.toxic]
            model = fit(rows.text.tolist(), rows.toxic.tolist(), weights)
        else:
            model = Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
        yield pd.DataFrame(
            {"features": [model.features.astype("<i8").tobytes()], "weights": [model.weights.astype("<f8").tobytes()], "bias": [model.bias]}
        )

    # one row, at most 2 ** BITS features
    row = rows.mapInPandas(learn, "features binary, weights binary, bias double").first()
    if row is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    return Model(np.frombuffer(row.features, "<i8"), np.frombuffer(row.weights, "<f8"), row.bias)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` plus ``score`` (double, 0 to 1) and ``predicted`` (1 from ``threshold``).

    Only the text decides. Null text counts as empty and gets the score of the intercept. Columns named
    ``score`` or ``predicted`` in the input are replaced. Repeated rows stay; empty input gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(shared.value, texts.tolist()))

    rows = docs.withColumn("score", scored(F.coalesce(F.col("text"), F.lit(""))))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    rows = score_documents(docs.select("doc_id", "text"), train(docs, labels), threshold)
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")
