"""A classifier on vectors of features, trained in passes over a table, with early stopping and checkpoints.

The model is multinomial logistic regression. Every pass sums the gradients of partitions where the rows are; the driver
gets one matrix (classes by features) for each partition, whatever the number of rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import half_even
from .classify import predict, rejection_threshold, scores


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # (classes, features + 1), the last of each for the constant
    info: dict

    def logits(self):
        """The logits of the column features, as an expression."""
        dot = lambda w: F.aggregate(F.zip_with("features", F.array(*map(F.lit, map(float, w[:-1]))), lambda x, y: x * y), F.lit(float(w[-1])), lambda a, v: a + v)
        return F.array(*[dot(w) for w in self.weights])

    def predict(self, samples: DataFrame) -> DataFrame:
        return predict(samples.withColumn("logits", self.logits()), self.classes)

    def parameters(self) -> list[tuple[str, int, bool]]:
        """(name, parameters, trainable)"""
        return [("weights", self.weights[:, :-1].size, True), ("constants", len(self.weights), True)]


def _gradients(samples: DataFrame, classes: list[str], weights: np.ndarray) -> tuple[float, int, int, np.ndarray]:
    """Of rows (features, label): the sum of their losses, how many there are and are right, and the gradient's sum."""
    sent = samples.sparkSession.sparkContext.broadcast((classes, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, w = sent.value
        loss, n, right, total = 0.0, 0, 0, np.zeros_like(w)
        at = {c: i for i, c in enumerate(names)}
        for b in batches:
            if not len(b):
                continue
            x = np.concatenate([np.array(b["features"].tolist(), float), np.ones((len(b), 1))], 1)
            y = b["label"].map(at).to_numpy()
            z = x @ w.T
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            loss -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
            right += int((p.argmax(1) == y).sum())
            p[np.arange(len(y)), y] -= 1
            total += p.T @ x
            n += len(y)
        yield pd.DataFrame({"loss": [loss], "n": [n], "right": [right], "g": [total.ravel().tolist()]})

    rows = samples.select("features", "label").mapInPandas(run, "loss double, n long, right long, g array<double>").collect()  # one for each partition
    sent.unpersist()
    g = np.sum([r["g"] for r in rows], 0).reshape(weights.shape) if rows else np.zeros_like(weights)
    return sum(r["loss"] for r in rows), sum(r["n"] for r in rows), sum(r["right"] for r in rows), g


def evaluate(model: Model, samples: DataFrame) -> dict[str, float]:
    """(loss, accuracy, macro_f1) of samples (features, label)."""
    x = model.predict(samples)
    p = F.get("probabilities", (F.array_position(F.array(*map(F.lit, model.classes)), F.col("label")) - 1).cast("int"))
    loss = x.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-300)))).alias("loss")).first()["loss"]
    s = scores(x, "label").first()
    return {"loss": loss, "accuracy": s["accuracy"], "macro_f1": s["macro_f1"]}


def train(samples: DataFrame, classes: list[str], epochs: int = 30, patience: int = 4, rate: float = 1.0, decay: float = 1e-4, least_gain: float = 0.0) -> tuple[Model, list[dict]]:
    """A model from samples (features, label, split) and the history of its epochs. The weights of the best epoch, by the
    loss of the validation rows, are kept; training ends after `patience` epochs without a better one."""
    kept = samples.filter(F.col("label").isin(*classes)).select("features", "label", "split").persist()
    try:
        own, held = kept.filter("split = 'train'"), kept.filter("split = 'val'")
        first = own.first()
        if first is None:
            raise ValueError("no rows to train on")
        w, speed = np.zeros((len(classes), len(first["features"]) + 1)), None
        best, history = None, []
        for epoch in range(1, epochs + 1):
            loss, n, right, g = _gradients(own, classes, w)
            g = g / n + decay * w
            speed = g * g if speed is None else 0.9 * speed + 0.1 * g * g
            w = w - rate * g / (np.sqrt(speed) + 1e-3)
            val = _gradients(held, classes, w)
            row = {"epoch": epoch, "train_loss": loss / n, "train_accuracy": right / n, "val_loss": val[0] / max(1, val[1]), "val_accuracy": val[2] / max(1, val[1])}
            history.append(row)
            if best is None or row["val_loss"] < best[0] - least_gain:
                best = (row["val_loss"], epoch, w.copy())
            elif epoch - best[1] >= patience:
                break
        model = Model(list(classes), best[2], {"best_epoch": best[1], "best_val_loss": best[0]})
        threshold = rejection_threshold(model.predict(held)).first()["threshold"]
        model.info["rejection_threshold"] = threshold
        return model, history
    finally:
        kept.unpersist()


def history_table(spark: SparkSession, history: list[dict]) -> DataFrame:
    """(epoch, loss, ...) of a training, for best_epoch() and reports."""
    df = spark.createDataFrame(history)
    return df.withColumn("loss", F.col("val_loss")).select("epoch", "loss", *[half_even(F.col(c), 6).alias(c) for c in ("train_loss", "train_accuracy", "val_accuracy")])


def save(spark: SparkSession, model: Model, path: str) -> None:
    """A checkpoint: one JSON file on any file system that Spark knows."""
    from ..sources.sinks import write_file

    write_file(spark, path, json.dumps({"classes": model.classes, "weights": model.weights.tolist(), "info": model.info}))


def load(spark: SparkSession, path: str) -> Model:
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    held = json.loads(text)
    return Model(held["classes"], np.array(held["weights"], float), held["info"])
