"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled good; the unlabelled ones are drawn from all documents. With the class
prior ``p`` the risk of a scorer ``f`` on unknown text is ``p E+[l(f)] + E_u[l(-f)] - p E+[l(-f)]``, whose last
two terms estimate the risk on negatives; they are kept from falling below zero, where the estimate would
reward overfitting. ``f`` is linear in standardised shape features of the whole text and their squares, ``l``
the logistic loss. The prior is the share of good documents among the labelled ones, and a two-parameter
logistic map fitted to the labelled training documents makes the scores probabilities.

Bounds: at most ``per_class`` positives, negatives (for prior and calibration only) and unlabelled documents are
used, those with the smallest hashed ids; their features are all that reaches the driver. Held-out rows
(``crc32(doc_id) % 4 == 2``) are used neither as labelled nor as unlabelled documents. Scoring is a narrow step.

Defined results: a null text scores as an empty one; a null ``doc_id`` is never held out nor labelled; of several
rows with one ``doc_id`` one is used in training, all are scored; a ``doc_id`` with contradicting labels is
not used; null labels are ignored; without a positive every score is 0.5; an empty table gives no rows; other
columns (``lang``, ``source``, labels, ids) are never inputs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.llm.common import slices

THRESHOLD = 0.7
FEATURES = 18
_KIND = np.zeros(256, np.uint8)  # letters and bytes beyond ASCII stay 0
for _b in range(256):
    _c = chr(_b)
    if "A" <= _c <= "Z":
        _KIND[_b] = 1
    elif "0" <= _c <= "9":
        _KIND[_b] = 2
    elif _c in " \t":
        _KIND[_b] = 3
    elif _c in "\n\r":
        _KIND[_b] = 4
    elif _c in ".,;:?!'\"":
        _KIND[_b] = 5
    elif 0x21 <= _b < 0x7F and not _c.isalnum():
        _KIND[_b] = 6


def features(text: str | None) -> list[float]:
    """Shares of character kinds, lengths, repetition of words, pairs and lines, shouting and table marks."""
    raw = (text or "").encode("utf-8", "replace")
    size = max(1, len(raw))
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7) / size
    found = raw.split()
    count = max(1, len(found))
    lower = raw.lower().split()
    pairs = len(set(zip(lower, lower[1:]))) / (count - 1) if count > 1 else 1.0
    lines = raw.split(b"\n")
    return [
        *kinds[1:],
        np.log1p(len(raw)),
        np.log1p(len(found)),
        len(raw) / count,
        len(set(found)) / count**0.8,
        sum(map(bytes.__eq__, found, found[1:])) / count,
        pairs,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        len(found) / len(lines) / 50,
        float(not raw),
        raw.count(b"!!") / count,
        raw.count(b" | ") / count,
    ]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _inputs(x, self.mean, self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.offset)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _inputs(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([z, z**2 / 6, np.ones((len(z), 1))])


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1200, rate: float = 0.03) -> Model:
    """Minimises the non-negative risk by full-batch Adam; deterministic."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-9
    p, u = _inputs(positive, mean, scale), _inputs(unlabelled, mean, scale)
    weights = np.zeros(p.shape[1])
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        at_p, at_u = p @ weights, u @ weights
        negative_risk = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        of_negatives = u.T @ _sigmoid(at_u) / len(u) - prior * (p.T @ _sigmoid(at_p)) / len(p)
        if negative_risk >= 0:
            gradient = -prior * (p.T @ _sigmoid(-at_p)) / len(p) + of_negatives
        else:
            gradient = -of_negatives
        gradient = gradient + 1e-4 * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Model(mean, scale, weights, 1.0, 0.0)


def calibrated(model: Model, positive: np.ndarray, negative: np.ndarray) -> Model:
    """With slope and offset such that scores are probabilities on the given rows (Newton steps, light ridge)."""
    if len(negative) == 0:
        return model
    z = np.concatenate([model.raw(positive), model.raw(negative)])
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))])
    x = np.column_stack([z / (np.abs(z).max() + 1e-9), np.ones(len(z))])
    theta = np.zeros(2)
    for _ in range(60):
        q = _sigmoid(x @ theta)
        gradient = x.T @ (q - y) + 0.05 * theta
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return model._replace(slope=float(theta[0] / (np.abs(z).max() + 1e-9)), offset=float(theta[1]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 20_000) -> Model | None:
    """A model from the training rows; ``None`` without a positive one."""
    of_doc = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isNotNull() & ~held_out(labels["doc_id"]))
    of_doc = of_doc.groupBy(labels["doc_id"].cast("long").alias("id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    of_doc = of_doc.where("low = high").select("id", F.col("high").alias("quality"))
    counts = {r["quality"]: r["n"] for r in of_doc.groupBy((F.col("quality") == 1).cast("int").alias("quality")).agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return None
    prior = counts[1] / sum(counts.values())
    ids = docs.where(docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"])).select(docs["doc_id"].cast("long").alias("id"))

    def bounded(rows, kind):
        return rows.orderBy(F.xxhash64("id", F.lit(kind)), "id").limit(per_class).select("id", F.lit(kind).alias("kind"))

    chosen = bounded(of_doc.where("quality = 1"), "positive").unionByName(bounded(of_doc.where("quality <> 1"), "negative"))
    chosen = chosen.unionByName(bounded(ids, "unlabelled").distinct()).groupBy("id").agg(F.collect_set("kind").alias("kinds"))

    def featured(batches):
        for batch in slices(batches):
            found = [features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["kinds"], batch["rank"], pa.array(found, pa.list_(pa.float64()))], ["id", "kinds", "rank", "x"]
            )

    # At most 3 * per_class ids, so this side has a proven bound.
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.select("id", "kinds", F.xxhash64("text").alias("rank"), "text")
    rows = texts.mapInArrow(featured, "id long, kinds array<string>, rank long, x array<double>")
    rows = rows.groupBy("id").agg(F.min(F.struct("rank", "kinds", "x")).alias("row")).select("id", "row.kinds", "row.x").orderBy("id")
    collected = rows.collect()
    of = {k: np.array([r["x"] for r in collected if k in r["kinds"]]).reshape(-1, FEATURES) for k in ("positive", "negative", "unlabelled")}
    if not len(of["positive"]) or not len(of["unlabelled"]):
        return None
    return calibrated(fit_pu(of["positive"], of["unlabelled"], prior), of["positive"], of["negative"])


def score_texts(model: Model | None, texts: list[str | None]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    return model.scores(np.array([features(t) for t in texts]).reshape(-1, FEATURES))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""

    def run(batches):
        for batch in slices(batches):
            values = score_texts(model, batch["text"].to_pylist())
            predicted = pa.array((values >= THRESHOLD).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(values), predicted], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), docs["text"])
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted good; all of them without a model."""
    if model is None:
        return docs

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(score_texts(model, batch["text"].to_pylist()) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
