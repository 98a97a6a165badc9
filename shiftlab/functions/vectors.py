"""Vector column functions.

All of these are Spark higher-order array expressions evaluated on the JVM next to the
scan; no Python is involved. A value that every element needs (a norm, a maximum, a
total) is bound once per row with ``let``: inside a lambda it would be evaluated again
for every element.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Per-channel image normalisation constants (R, G, B).
CLIP_MEAN = [0.48145466, 0.4578275, 0.40821073]
CLIP_STD = [0.26862954, 0.26130258, 0.27577711]
IMAGENET_MEAN = [0.485, 0.456, 0.406]
IMAGENET_STD = [0.229, 0.224, 0.225]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c) -> Column:
    """Cast a float vector to double before arithmetic."""
    return _col(c).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda over a one-element array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a, b) -> Column:
    """Inner product of two equal-width vectors."""
    return F.aggregate(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(c) -> Column:
    """``v / ||v||``. A zero vector gives NULL elements (ANSI-safe ``try_divide``)."""
    return let(as_double_array(c), lambda v: let(
        F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)),
        lambda norm: F.transform(v, lambda x: F.try_divide(x, norm))))


def softmax(c) -> Column:
    """Row softmax, shifted by the row maximum (scores reach +-100)."""
    def shifted(v):
        return let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))

    return let(let(as_double_array(c), shifted), lambda ex: let(
        F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x),
        lambda total: F.transform(ex, lambda x: x / total)))


def log_sum_exp(c) -> Column:
    """Stable ``log(sum(exp(v)))``."""
    return let(as_double_array(c), lambda v: let(F.array_max(v), lambda m: m + F.log(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))))


def cross_entropy(scores, label) -> Column:
    """Softmax cross-entropy of one row: ``logsumexp(s) - s[label]`` (label is 0-based)."""
    v = as_double_array(scores)
    return log_sum_exp(v) - F.element_at(v, _col(label) + 1)


def argmax_class(c) -> Column:
    """P5: 0-based index of the largest score; the first one wins ties."""
    return let(_col(c), lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def explode_vector(df, keep, vec, pos: str = "pos", value: str = "value"):
    """Long form ``(keep..., pos, value)`` of a vector column.

    Uses the outer generator and drops the NULL row afterwards: a plain
    ``posexplode`` makes Catalyst infer ``size(vec) > 0`` below the projection,
    which would evaluate a Python-computed vector twice.
    """
    keep = [keep] if isinstance(keep, str) else list(keep)
    out = df.select(*keep, F.posexplode_outer(vec).alias(pos, value))
    return out.filter(F.col(pos).isNotNull()).withColumn(pos, F.col(pos).cast("int"))


def standardize(c, mean: Sequence[float] = CLIP_MEAN, std: Sequence[float] = CLIP_STD) -> Column:
    """Per-channel ``(x - mean[c]) / std[c]`` over a channel-last pixel vector.

    The channel of element ``i`` is ``i % len(mean)``, so both a single pixel and
    a flattened H x W x C image work.
    """
    m = F.array(*[F.lit(float(x)) for x in mean])
    s = F.array(*[F.lit(float(x)) for x in std])
    k = len(mean)
    return F.transform(as_double_array(c),
                       lambda x, i: (x - F.element_at(m, i % k + 1)) / F.element_at(s, i % k + 1))
