"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model under the non-negative unbiased
risk: pi R+(P) + max(0, R-(U) - pi R-(P)). Where the bracket turns negative, the step goes back along
it. The class prior pi is estimated from positives and unlabelled texts alone: a model that tells the
two apart scores both out of fold, and of the texts above a score, the share among unlabelled ones over
that among positives is pi where only positives score so high. Other labels only take away trust.
Only the model is fitted on a bounded sample; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import table, tidy

#: Positives and unlabelled texts that a model is fitted on at most, of each.
SAMPLE = 12_000
THRESHOLD = 0.7
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t", b"|", b"!", b"?", b".", b",", b"#$%&*@^~", b"<>{}[]\\=+_/", b"\"'():;-", bytes(range(128, 256))]
_CLASS = np.full(256, len(_CLASSES))
for _n, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _n


def features(text: bytes | None) -> np.ndarray:
    """Shares of character classes, and how much of the words, pairs and lines is repetition; all between 0 and 1."""
    text = text or b""
    n = max(1, len(text))
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), len(_CLASSES) + 1) / n
    words, lines = text.split(), text.split(b"\n")
    m = len(words)
    following = words[1:]
    repeats = [
        1 - len(set(words)) / m if m else 0,
        np.log1p(len(set(words))) / np.log1p(m) if m else 1,
        sum(map(eq, words, following)) / m if m else 0,
        1 - len(set(zip(words, following, strict=False))) / (m - 1) if m > 1 else 0,
        1 - len(set(lines)) / len(lines),
        m / n,
        sum(map(bytes.isupper, words)) / m if m else 0,
    ]
    rare = kinds[[1, 2, 5, 6, 7, 8, 11, 12]]
    return np.concatenate([kinds, rare / (rare + 0.01), repeats])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip((z * self.weight).sum(axis=1) + self.bias, -30, 30)))


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def risk_and_gradient(theta: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative unbiased logistic risk on rows that end with a 1, and where a step takes it down.

    Below zero the bracket counts as zero, and the step goes against its gradient, back to zero.
    """
    fp, fu = p @ theta, u @ theta
    bracket = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()  # losses of calling them negative
    negative = _sigmoid(fu) @ u / len(u) - prior * (_sigmoid(fp) @ p) / len(p)
    positive = prior * ((_sigmoid(fp) - 1) @ p) / len(p)
    risk = prior * np.logaddexp(0, -fp).mean() + max(0.0, bracket)
    return risk, positive + negative if bracket >= 0 else -negative


def _descend(theta: np.ndarray, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float, decay: float) -> np.ndarray:
    """Adam on all rows at once."""
    m1, m2 = 0.0, 0.0
    for step in range(1, steps + 1):
        g = gradient(theta) + decay * np.append(theta[:-1], 0)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g**2
        theta = theta - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return theta


def _prepared(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Model, np.ndarray, np.ndarray]:
    both = np.concatenate([positive, unlabelled])
    model = Model(both.mean(axis=0), both.std(axis=0) + 1e-3, np.zeros(both.shape[1]), 0.0)
    return model, *(np.column_stack([np.clip((x - model.mean) / model.scale, -8, 8), np.ones(len(x))]) for x in (positive, unlabelled))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """A logistic model that minimises the non-negative unbiased risk."""
    model, p, u = _prepared(positive, unlabelled)
    start = np.append(model.weight, np.log(prior / (1 - prior)))
    theta = _descend(start, lambda t: risk_and_gradient(t, p, u, prior)[1], steps, rate, decay)
    model.weight, model.bias = theta[:-1], float(theta[-1])
    return model


def _told_apart(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """A plain logistic model of positives against unlabelled rows, both of one weight."""
    model, p, u = _prepared(positive, unlabelled)
    theta = _descend(np.append(model.weight, 0.0), lambda t: 0.5 * ((_sigmoid(p @ t) - 1) @ p / len(p) + _sigmoid(u @ t) @ u / len(u)), steps, rate, decay)
    model.weight, model.bias = theta[:-1], float(theta[-1])
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, error: float = 0.1) -> float:
    """The share of positives among unlabelled rows, between 0.05 and 0.99.

    Two halves score each other. Of the scores, the one is taken whose ratio of shares above it is the least at the upper
    end of its confidence interval: a score that few rows reach says little.
    """
    scores = ([], [])
    for half in (0, 1):
        parts = [(x[np.arange(len(x)) % 2 != half], x[np.arange(len(x)) % 2 == half]) for x in (positive, unlabelled)]
        if any(not len(x) for pair in parts for x in pair):
            return 0.5  # a row or two say nothing
        model = _told_apart(parts[0][0], parts[1][0])
        for kept, (_, own) in zip(scores, parts, strict=True):
            kept.append(model.score(own))
    p, u = (np.sort(np.concatenate(s)) for s in scores)
    above_p, above_u = 1 - np.arange(len(p)) / len(p), 1 - np.searchsorted(u, p) / len(u)
    slack = np.sqrt(np.log(4 / error) / 2 / len(p)) + np.sqrt(np.log(4 / error) / 2 / len(u))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.99))


def fold(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model of the folds other than held_out; None if they have no positive, or no text of one.

    Trusted are ids with label 1 and no other; null labels say nothing. Of an id with several rows, the least text in
    byte order is taken, so that at most 2 * sample texts reach the driver, as features. A null id is never learnt from.
    """
    spread = F.xxhash64(F.lit("sample"), F.col("id"))
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & (fold(F.col("id")) != held_out)).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z"))
    trusted = told.where("y = 1 and z = 1").select("id").orderBy(spread).limit(sample).withColumn("kind", F.lit(1))
    ids = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull() & (fold(F.col("id")) != held_out)).distinct()
    picks = trusted.union(ids.orderBy(F.xxhash64(F.lit("unlabelled"), F.col("id"))).limit(sample).withColumn("kind", F.lit(0)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(picks), "id")  # 2 * sample ids
    once = texts.groupBy("id", "kind").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["kind", "x"])

    rows = once.select("kind", "text").mapInArrow(tidy(run), "kind int, x array<double>").toPandas()
    x = {k: np.array(sorted(rows.x[rows.kind == k].map(tuple))) for k in (0, 1)}
    if not len(x[0]) or not len(x[1]):
        return None
    shuffled = {k: v[np.random.default_rng(k).permutation(len(v))] for k, v in x.items()}
    return fit(x[1], x[0], estimate_prior(shuffled[1], shuffled[0]))


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with a column `to` of scores between 0 and 1; every column of docs stays. Without a model all score 0.5.

    A null text is scored as an empty one, so that both have the score of a text without any features.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            s = model.score(np.array([features(t) for t in texts]).reshape(len(texts), -1)) if model and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, to])

    return docs.mapInArrow(tidy(run), schema)


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
