"""Scores and vector arithmetic as Column functions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def argmax(x: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def softmax(z: Column) -> Column:
    return _bind(F.transform(z, lambda v: F.exp(v - F.array_max(z))), lambda e: F.transform(e, lambda v: v / total(e)))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def entropy(p: Column) -> Column:
    """-sum p ln p, with 0 ln 0 = 0."""
    return total(F.transform(p, lambda v: F.when(v > 0, -v * F.ln(v)).otherwise(0.0)))


def least_confidence(p: Column) -> Column:
    return -F.array_max(p)


def margin(p: Column) -> Column:
    """Second largest less largest: the closer, the higher."""
    return _bind(F.sort_array(p, False), lambda s: F.get(s, F.lit(1)) - F.get(s, F.lit(0)))


def mean_of(rows: Column) -> Column:
    """Element-wise mean of an array of equally long arrays."""
    n = F.size(rows)
    first = F.element_at(rows, 1)
    summed = F.aggregate(F.slice(rows, 2, n), first, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return F.transform(summed, lambda v: v / n)


def mutual_information(passes: Column) -> Column:
    """Entropy of the mean prediction less the mean entropy of the predictions."""
    each = F.transform(passes, entropy)
    return entropy(mean_of(passes)) - total(each) / F.size(passes)


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == label).cast("double"))


def logit_gradient(p: Column, label: Column, classes: int) -> Column:
    """Gradient of the cross-entropy by the logits."""
    return F.zip_with(p, one_hot(label, classes), lambda a, b: a - b)


def squared_error_gradient(p: Column, label: Column, classes: int) -> Column:
    """Gradient by the logits of half the squared distance of the probabilities from the one-hot label."""
    error = logit_gradient(p, label, classes)
    return _bind(total(F.zip_with(error, p, lambda a, b: a * b)), lambda t: F.zip_with(error, p, lambda a, b: b * (a - t)))


def gradient_embedding(l0: Column, emb: Column, kind: str) -> Column:
    """The last layer's gradient: class-major, the biases first."""
    linear = F.flatten(F.transform(l0, lambda a: F.transform(emb, lambda b: a * b)))
    if kind == "bias":
        return l0
    if kind == "linear":
        return linear
    if kind == "bias_linear":
        return F.concat(l0, linear)
    raise ValueError(f"unknown gradient embedding {kind!r}; bias, linear or bias_linear")


SCORES = {"entropy": entropy, "least_confidence": least_confidence, "margin": margin}


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) that depends on the parts alone, the same in any engine with md5."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
