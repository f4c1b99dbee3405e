"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(n: ColumnLike, d: ColumnLike) -> Column:
    """n / d, and 0 where d is 0."""
    return F.when(_c(d) == 0, F.lit(0.0)).otherwise(_c(n) / _c(d))


def at_least(score: ColumnLike, threshold: float | Column) -> Column:
    """Inclusive threshold, compared in single precision as the scores are stored."""
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return _c(score).cast("float") >= limit.cast("float")


def clipped(x: ColumnLike, low: ColumnLike | float, high: ColumnLike | float) -> Column:
    low, high = (F.lit(v) if isinstance(v, (int, float)) else _c(v) for v in (low, high))
    return F.least(F.greatest(_c(x), low), high)


def sigmoid(x: ColumnLike) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def softmax(logits: ColumnLike) -> Column:
    """Probabilities of an array of logits, computed from the largest down."""
    top = F.array_max(_c(logits))
    powers = F.transform(_c(logits), lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
    return F.transform(powers, lambda v: v / total)


def argmax(values: ColumnLike) -> Column:
    """Index (from 0) of the first largest entry."""
    return (F.array_position(_c(values), F.array_max(_c(values))) - 1).cast("int")


def log_sum_exp(a: ColumnLike, b: ColumnLike) -> Column:
    top = F.greatest(_c(a), _c(b))
    return top + F.log(F.exp(_c(a) - top) + F.exp(_c(b) - top))


def bce_with_logits(logit: ColumnLike, target: ColumnLike) -> Column:
    """Binary cross entropy of a logit, stable for large values."""
    x = _c(logit)
    return F.greatest(x, F.lit(0.0)) - x * _c(target) + F.log1p(F.exp(-F.abs(x)))


def error_code(prediction: ColumnLike, target: ColumnLike) -> Column:
    """0 true negative, 1 true positive, 2 false positive, 3 false negative."""
    p, t = _c(prediction), _c(target)
    return F.when(p & t, 1).when(p, 2).when(t, 3).otherwise(0)


def cosine_falloff(distance: ColumnLike, radius: ColumnLike) -> Column:
    """1 within radius - 1/2, 0 beyond radius + 1/2, half a cosine between."""
    d, r = _c(distance), _c(radius)
    return F.when(d <= r - 0.5, 1.0).when(d >= r + 0.5, 0.0).otherwise(0.5 * (1 + F.cos(F.pi() * (d - r + 0.5))))


def binary_falloff(distance: ColumnLike, radius: ColumnLike) -> Column:
    return F.when(_c(distance) <= _c(radius), 1.0).otherwise(0.0)


def segment_distance(point: Sequence[ColumnLike], start: Sequence[ColumnLike], end: Sequence[ColumnLike]) -> Column:
    """Distance of a point from a segment."""
    p, a, b = ([_c(v) for v in x] for x in (point, start, end))
    ab = [v - u for u, v in zip(a, b)]
    along = sum((pi - ai) * d for pi, ai, d in zip(p, a, ab))
    t = clipped(along / F.greatest(sum(d * d for d in ab), F.lit(1e-12)), 0.0, 1.0)
    return F.sqrt(sum((pi - (ai + t * d)) * (pi - (ai + t * d)) for pi, ai, d in zip(p, a, ab)))


def linear_index(z: ColumnLike, y: ColumnLike, x: ColumnLike, ny: ColumnLike, nx: ColumnLike) -> Column:
    return (_c(z).cast("long") * _c(ny) + _c(y)) * _c(nx) + _c(x)


def resampled_size(n: ColumnLike, spacing: ColumnLike, target: float) -> Column:
    """Grid points that cover the same extent at the target spacing; halves round to even."""
    return F.rint((_c(n) - 1) * _c(spacing) / target).cast("long") + 1


def antialias_sigma(spacing: ColumnLike, target: float) -> Column:
    return F.greatest(target / _c(spacing) - 1, F.lit(0.0)) / 2


def hashed_uniform(key: ColumnLike, seed: int = 0) -> Column:
    """A number in [0, 1) from an integer key, by integer arithmetic that any engine repeats."""
    mixed = F.pmod(_c(key).cast("long") * 7919 + seed * 104729 + 12345, F.lit(1_000_003))
    return F.pmod(mixed * 48271, F.lit(1_000_003)) / 1_000_003.0


def slab_of(z: ColumnLike, nz: ColumnLike, slabs: int = 8) -> Column:
    """Which of ``slabs`` equal parts of the depth axis a plane is in."""
    return F.floor((slabs * (_c(z).cast("long") + 1) - 1) / _c(nz)).cast("int")


def rescaled(value: ColumnLike, low: ColumnLike, high: ColumnLike, vmin: float = 0.0, vmax: float = 1.0) -> Column:
    """Min-max rescale into [vmin, vmax]; a constant becomes vmin."""
    span = _c(high) - _c(low)
    return F.when(span <= 0, F.lit(vmin)).otherwise((_c(value) - _c(low)) / span * (vmax - vmin) + vmin)


def split_of(volume: ColumnLike, bounds: Sequence[tuple[int, str]] = ((510, "train"), (570, "val"), (600, "test"))) -> Column:
    """Split of a volume number by upper bounds; a number beyond them is an error."""
    out = F.raise_error(F.concat(F.lit("no split holds volume "), _c(volume).cast("string")))
    for bound, name in reversed(list(bounds)):
        out = F.when(_c(volume) < bound, F.lit(name)).otherwise(out)
    return out
