"""Forward values of differentiable operators, on number columns and on array columns, and losses as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + x * 0  # greatest passes over nulls; the second term doesn't


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def tanh(x: Column) -> Column:
    return F.tanh(x)


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(alpha * F.expm1(x))


def gelu(x: Column) -> Column:
    """By the tanh approximation."""
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def softmax(v: Column) -> Column:
    """Of an array; the largest element is taken off first."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def log_softmax(v: Column) -> Column:
    top = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(v, lambda x: x - top - F.log(total))


def rms_norm(v: Column, epsilon: float = 1e-5) -> Column:
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / F.size(v)
    return F.transform(v, lambda x: x / F.sqrt(mean + epsilon))


def layer_norm(v: Column, epsilon: float = 1e-5) -> Column:
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    var = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(v)
    return F.transform(v, lambda x: (x - mean) / F.sqrt(var + epsilon))


def elementwise(a: Column, b: Column, op: str) -> Column:
    """Two arrays of one width: add, subtract, multiply or divide."""
    ops = {"add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y, "divide": lambda x, y: x / y}
    return F.zip_with(a, b, ops[op])


def dropout(x: Column, rate: float, seed: int) -> Column:
    """Zero at the rate, the rest scaled up. The draw depends on the partitioning."""
    return F.when(F.rand(seed) < rate, F.lit(0.0)).otherwise(x / (1 - rate))


def mse(predicted: Column, truth: Column) -> Column:
    return F.avg((predicted - truth) * (predicted - truth))


def l1(predicted: Column, truth: Column) -> Column:
    return F.sum(F.abs(predicted - truth))


def bce(probability: Column, truth: Column, epsilon: float = 1e-7) -> Column:
    p = clip(probability, epsilon, 1 - epsilon)
    return F.avg(-(truth * F.log(p) + (1 - truth) * F.log(1 - p)))


def bce_with_logits(logit: Column, truth: Column) -> Column:
    return F.avg(F.greatest(logit, F.lit(0.0)) - logit * truth + F.log1p(F.exp(-F.abs(logit))))


def cross_entropy(logits: Column, label: Column) -> Column:
    """logits: an array column; label: index from 0."""
    return F.avg(-F.get(log_softmax(logits), label))


def kl_divergence(mean: Column, log_var: Column) -> Column:
    return F.sum(-0.5 * (1 + log_var - mean * mean - F.exp(log_var)))
