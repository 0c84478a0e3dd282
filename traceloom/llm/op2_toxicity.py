"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts drawn without regard to labels stand for the corpus.  With the class prior p the
risk of calling everything right is  p R+(positives) + max(0, R-(unlabelled) - p R-(positives)) : the second
term is the risk of the unseen negatives, which is not allowed to go below zero.  When it would, the step undoes the
overfit instead.  A linear model over hashed features of words and word beginnings is trained in numpy on a bounded sample;
all texts are then scored in Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm import hashing
from traceloom.llm.ship import ship
from traceloom.llm.tables import checked
from traceloom.session import materialize

BITS = 18  # hashed features
POSITIVES = 3_000  # confirmed toxic texts in the training sample, at most
UNLABELLED = 6_000  # texts of unknown label in the training sample, at most
FEATURES_READ = 4_096  # features of the training texts, on average, at most; a text is learnt from whole, as scoring reads it
PREFIXES = (4, 5, 6)
EPOCHS = 120
RATE = 30.0
DECAY = 1e-5
FOLDS = 5
SUPPORT = 0.02  # share of toxic texts that must hold a feature


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that no label is learnt from; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def features(data: bytes) -> np.ndarray:
    """Distinct hashed features of a lower-cased text: its words without outer punctuation, and how they begin."""
    found: set[bytes] = {w.strip(b".,;:!?()[]\"'*-") for w in data.split()}
    marked = [w for w in found if w]
    for n in PREFIXES:
        marked.extend({w[:n] + b"*" for w in found if len(w) >= n})
    if not marked:
        return np.zeros(0, np.int64)
    joined = b"\n".join(marked)
    return np.unique(hashing.words_of(joined)[1] >> np.uint64(64 - BITS)).astype(np.int64)


def lowered(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass") if text else b""


class Model:
    """Linear model: a text's score is the logistic of the mean-scaled weight of its features."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def logit(self, found: np.ndarray) -> float:
        return self.bias + (float(self.weights[found].sum()) / float(np.sqrt(len(found))) if len(found) else 0.0)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(features(lowered(text))), -30, 30))))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS) -> Model:
    """Minimises the non-negative PU risk, then sets the threshold on the third of the sample that was not trained on.

    Features weigh by their rarity among the unlabelled.  Without positives or unlabelled texts every score is the prior.
    """
    size = 1 << BITS
    prior = min(max(prior, 1e-3), 0.999)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(np.zeros(size), start)
    third = len(positive) > 5 and len(unlabelled) > 5
    learn = [r for i, r in enumerate(positive) if i % 3 or not third], [r for i, r in enumerate(unlabelled) if i % 3 or not third]
    judge = (positive[::3], unlabelled[::3]) if third else learn
    seen = np.bincount(np.concatenate(learn[1]), minlength=size)
    rarity = np.maximum(np.log(len(learn[1]) / (seen + 1)) / np.log(len(learn[1]) + 1), 0)
    model = Model(_weights(*learn, rarity, prior, epochs) * rarity, 0.0)
    return _calibrated(model, np.array([model.logit(r) for r in judge[0]]), np.array([model.logit(r) for r in judge[1]]), prior)


def _weights(positive: list[np.ndarray], unlabelled: list[np.ndarray], rarity: np.ndarray, prior: float, epochs: int) -> np.ndarray:
    """Full batches and momentum on the logistic loss: steps in proportion to the gradient keep chance features small."""
    rows = [*positive, *unlabelled]
    size, n_p, n_u = len(rarity), len(positive), len(unlabelled)
    lengths = np.array([len(r) for r in rows])
    # What few toxic texts hold says more about these texts than about toxicity.
    used = np.bincount(np.concatenate(positive), minlength=size) >= max(3, SUPPORT * n_p)
    rows = [r[used[r]] for r in rows]
    column = np.concatenate(rows).astype(np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    value = rarity[column] / np.sqrt(np.maximum(lengths, 1))[row]
    w, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    speed = np.zeros(size + 1)
    for _ in range(epochs):
        z = np.bincount(row, weights=w[column] * value, minlength=len(rows)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_clean = np.logaddexp(0, z)  # loss of calling a text clean
        negative = as_clean[n_p:].mean() - prior * as_clean[:n_p].mean()
        slope = np.empty(len(rows))
        if negative >= 0:
            slope[:n_p] = prior * (p[:n_p] - 1) / n_p - prior * p[:n_p] / n_p
            slope[n_p:] = p[n_p:] / n_u
        else:  # the estimated risk of the negatives is below zero: step back from the overfit
            slope[:n_p] = prior * p[:n_p] / n_p
            slope[n_p:] = -p[n_p:] / n_u
        gradient = np.append(np.bincount(column, weights=slope[row] * value, minlength=size) + DECAY * w, slope.sum())
        speed = 0.9 * speed - RATE * gradient
        w += speed[:size]
        bias += speed[size]
    return w


def _calibrated(model: Model, toxic: np.ndarray, anyone: np.ndarray, prior: float) -> Model:
    """Puts 0.5 where the non-negative PU error is least (the middle of that place), and the usual toxic text at 0.98."""
    ordered = np.unique(np.concatenate([toxic, anyone]))
    marks = np.concatenate([[ordered[0] - 1], (ordered[1:] + ordered[:-1]) / 2, [ordered[-1] + 1]])
    missed = np.searchsorted(np.sort(toxic), marks) / len(toxic)
    called = 1 - np.searchsorted(np.sort(anyone), marks) / len(anyone)
    # Labels may be given to toxic texts more often than to others: the prior is at most what is called toxic, over the share of toxic texts caught.
    caught = missed <= 0.2
    prior = min(prior, max(float((called[caught] / (1 - missed[caught])).min()), 1 / len(anyone)))
    error = prior * missed + np.abs(called - prior * (1 - missed))
    best = np.flatnonzero(error <= error.min() + 0.1 * prior)
    # Of nearly equal thresholds the one in the widest gap between neighbouring texts.
    gaps = np.concatenate([[0], np.diff(ordered), [0]])[best]
    threshold = marks[best[int(np.argmax(gaps))]]
    if threshold >= np.median(toxic):  # too few texts to tell: as many are called toxic as the prior says
        threshold = float(np.quantile(anyone, 1 - prior))
    scale = 4 / max(float(np.median(toxic)) - threshold, 1e-2)
    return Model(model.weights * scale, -threshold * scale)


def _sampled(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hashes of their ids: the same ones in every run."""
    return rows.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(n)


def _bounded(found: DataFrame, most: dict[int, int]) -> DataFrame:
    """The rows of ``found`` (kind, doc_id, found) that a kind may have by its number of features: whole ones, those with the smallest hashes of their ids."""
    sizes = found.select("kind", "doc_id", F.xxhash64(F.lit(17), "doc_id").alias("h"), (F.length("found") / 4).cast("bigint").alias("n")).collect()
    for kind, limit in most.items():
        total, last = 0, None
        for r in sorted((r for r in sizes if r["kind"] == kind), key=lambda r: (r["h"], r["doc_id"])):
            total += r["n"]
            if total > limit and last:
                upto = F.struct(F.xxhash64(F.lit(17), "doc_id").alias("h"), "doc_id") <= F.struct(F.lit(last["h"]).cast("bigint").alias("h"), F.lit(last["doc_id"]).cast("bigint").alias("doc_id"))
                found = found.filter((F.col("kind") != kind) | upto)
                break
            last = r
    return found


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows that are not held out only; ``labels`` has doc_id and toxic (null: no label).

    The prior is the share of toxic ones among the learnable labels.  Repeated label rows: a document counts as toxic if any says so.
    """
    learnable = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learnable = materialize(learnable, "labels")
    known = learnable.agg(F.avg("toxic"), F.count(F.lit(1))).first()
    ids = docs.select("doc_id").filter(~held_out(F.col("doc_id"))).distinct()
    positive = _sampled(learnable.filter("toxic = 1").select("doc_id"), POSITIVES).withColumn("kind", F.lit(1))
    anyone = _sampled(ids, UNLABELLED).withColumn("kind", F.lit(0))
    chosen = checked(materialize(positive.union(anyone), "sample"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "kind": frame["kind"], "found": [features(lowered(t)).astype(np.int32).tobytes() for t in frame["text"]]})

    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "kind", "text")
    # One text per chosen id (an id may be repeated), so the rows brought to the driver are bounded by the sample, and so are their features.
    found = materialize(texts.mapInPandas(read, "doc_id bigint, kind int, found binary").groupBy("kind", "doc_id").agg(F.min("found").alias("found")), "features")
    found = _bounded(found, {1: POSITIVES * FEATURES_READ, 0: UNLABELLED * FEATURES_READ}).orderBy("kind", "doc_id").collect()
    part = {k: [np.frombuffer(r["found"], np.int32) for r in found if r["kind"] == k] for k in (0, 1)}
    return train(part[1], part[0], known[0] if known[1] else 0.5)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; null and empty texts get the score of no features."""

    @F.pandas_udf("double")
    def score(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, score(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    ship(docs.sparkSession)
    model = fit(docs, labels)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns as they were."""
    ship(docs.sparkSession)
    return scored(docs, fit(docs, labels), "_toxic_score").filter("_toxic_score < 0.5").select(*docs.columns)
