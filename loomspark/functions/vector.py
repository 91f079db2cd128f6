"""Arithmetic on arrays of numbers."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_share(a: Column, b: Column) -> Column:
    """Cosine moved to the range from 0 to 1."""
    return (cosine(a, b) + 1) / 2


def unit(v: Column) -> Column:
    """The vector at length one; zero stays zero."""
    n = norm(v)
    return F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(0.0))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two channels."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def softmax(v: Column) -> Column:
    top = F.array_max(as_double(v))
    powers = F.transform(as_double(v), lambda x: F.exp(x - top))
    whole = total(powers)
    return F.transform(powers, lambda x: x / whole)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def multi_hot(ids: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.array_contains(ids, i), 1.0).otherwise(0.0))


def pick(v: Column, ids: Column) -> Column:
    """Elements at zero-based places."""
    return F.transform(ids, lambda i: F.get(v, i))


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """Exactly `length` ids: cut or filled at the end."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), length)), 1, length)


def pad_mask(ids: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= F.size(ids)).cast("int"))


def masked(v: Column, mask: Column, skip: int = 0) -> Column:
    """Elements whose mask is set, without the first `skip` of them."""
    kept = F.transform(F.filter(F.arrays_zip(v.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    return F.slice(kept, skip + 1, F.greatest(F.size(kept) - skip, F.lit(0)))


def schedule(steps: int, seq_len: Column, shift: bool = True, low: float = 0.5, high: float = 1.15) -> Column:
    """Times from 1 to 0 in equal steps, moved up by exp(mu) where mu grows along a line with the length of the sequence."""
    slope = (high - low) / (4096 - 256)
    mu = seq_len * slope + (low - slope * 256)
    times = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: 1.0 - i / float(steps))
    if not shift:
        return times
    return F.transform(times, lambda t: F.when(t <= 0, 0.0).otherwise(F.exp(mu) / (F.exp(mu) + (1 / t - 1))))


def interpolated(x: Column, noise: Column, sigma: Column) -> Column:
    return F.zip_with(as_double(x), as_double(noise), lambda a, b: (1 - sigma) * a + sigma * b)


def sin_cos(position: Column, dim: int) -> Column:
    """Sines, then cosines, of the position at dim/2 falling frequencies."""
    half = dim // 2
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: position / F.pow(F.lit(10000.0), i / float(half)))
    return F.concat(F.transform(angles, lambda a: F.sin(a)), F.transform(angles, lambda a: F.cos(a)))


def asymmetric_loss(score: Column, target: Column, gamma_neg: float = 4.0, gamma_pos: float = 1.0, clip: float = 0.05, eps: float = 1e-8) -> Column:
    """One class's share of the loss that clips and down-weights easy negatives."""
    p = sigmoid(score)
    q = F.least(1 - p + clip, F.lit(1.0))
    log_part = F.when(target == 1, F.log(F.greatest(p, F.lit(eps)))).otherwise(F.log(F.greatest(q, F.lit(eps))))
    easy = F.when(target == 1, p).otherwise(q)
    gamma = F.when(target == 1, gamma_pos).otherwise(gamma_neg)
    return -log_part * F.pow(1 - easy, gamma)


