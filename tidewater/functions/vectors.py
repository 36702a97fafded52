"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def tokens(a: Column, width: int = 8, n: int = 8) -> Column:
    """A vector as ``n`` token vectors of ``width`` numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(a, i * width + 1, width))


def softmax_entropy(scores: Column, k: int = 10) -> Column:
    """Entropy of the softmax of the k largest scores, to base k."""
    top = F.slice(F.reverse(F.array_sort(doubles(scores))), 1, k)
    shifted = F.transform(top, lambda x: F.exp(x - F.element_at(top, 1)))
    total = _sum(shifted)
    return -_sum(F.transform(shifted, lambda e: (e / total) * F.log(e / total + 1e-10))) / F.log(F.lit(float(k)))


def dynamic_k(size: int, entropy: Column, limit: int, chunk: int = 1) -> Column:
    """Fewer hits for a flatter score distribution."""
    base = size // 2
    most, least = min(base, limit), max(chunk, max(1, base // 2))
    h = F.greatest(F.lit(0.0), F.least(F.lit(1.0), entropy))
    return F.greatest(F.lit(least), F.least(F.lit(most), F.rint(least + (most - least) * F.exp(-2 * h)).cast("int")))


def gated(similarity: Column) -> Column:
    """Similarity to a probability: sigmoid(10 (s - 0.3))."""
    return 1 / (1 + F.exp(-10 * (similarity - 0.3)))


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages by a fold from the end; the value after the last is 0."""
    n = F.size(rewards)
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("last"))

    def step(a, i):
        following = F.when(i < n - 1, F.get(values, i + 1)).otherwise(0.0)
        adv = F.get(rewards, i) + gamma * following - F.get(values, i) + gamma * lam * a["last"]
        return F.struct(F.concat(F.array(adv), a["out"]).alias("out"), adv.alias("last"))

    return F.aggregate(F.reverse(F.sequence(F.lit(0), n - 1)), start, step, lambda a: a["out"])


def log_softmax_at(logits: Column, k: Column) -> Column:
    top = F.array_max(logits)
    return F.get(logits, k) - top - F.log(_sum(F.transform(logits, lambda x: F.exp(x - top))))


def entropy_of_logits(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    z = _sum(e)
    return F.log(z) + top - _sum(F.zip_with(e, logits, lambda p, x: p / z * x))
