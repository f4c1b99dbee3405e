"""Density fields over a grid: values in [low, high] by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clipped, hashed_uniform


def _fraction(axis: str, n: Column, ascending: bool) -> Column:
    t = F.when(n <= 1, 0.0).otherwise(F.col(axis) / (n - 1))
    return t if ascending else 1 - t


def linear(axis: str, n: Column, low: float, high: float, ascending: bool = True) -> Column:
    """Rises from low to high along an axis of ``n`` planes."""
    return low + (high - low) * _fraction(axis, n, ascending)


def sigmoid(axis: str, n: Column, low: float, high: float, centre: float = 0.5, steepness: float = 10.0, ascending: bool = True) -> Column:
    return low + (high - low) / (1 + F.exp(-steepness * (_fraction(axis, n, ascending) - centre)))


def gaussian(axis: str, n: Column, low: float, high: float, centre: float = 0.5, width: float = 0.2) -> Column:
    d = (_fraction(axis, n, True) - centre) / width
    return low + (high - low) * F.exp(-0.5 * d * d)


def radial(axes: Sequence[str], sizes: Sequence[Column], low: float, high: float, centre: Sequence[float] = (0.5, 0.5, 0.5), inner_high: bool = True) -> Column:
    """By the distance from a centre, as a part of half the grid's diagonal."""
    d = F.sqrt(sum((F.col(a) - c * n) * (F.col(a) - c * n) for a, n, c in zip(axes, sizes, centre)))
    reach = F.sqrt(sum(n * n / 4.0 for n in sizes))
    t = clipped(d / reach, 0.0, 1.0)
    return low + (high - low) * (1 - t if inner_high else t)


def uniform(value: float) -> Column:
    return F.lit(float(value))


def random_choice(key: Column, seed: int = 0, low: tuple[float, float] = (0.05, 0.4), high: tuple[float, float] = (0.6, 1.0), flat: tuple[float, float] = (0.3, 1.0)) -> Column:
    """A struct that describes a random field for a volume's key: kind (0 linear, 1 sigmoid, 2 gaussian, 3 radial, 4 uniform), axis
    (0 to 2), low, high, ascending, and the parameters a, b, c of the kind, all drawn by hashes of the key."""

    def drawn(k: int, span: tuple[float, float] = (0.0, 1.0)) -> Column:
        return span[0] + (span[1] - span[0]) * hashed_uniform(key * 16 + k, seed)

    kind = F.floor(drawn(0) * 5).cast("int")
    by_kind = {0: [F.lit(0.0)] * 3, 1: [drawn(5, (0.3, 0.7)), drawn(6, (5.0, 20.0)), F.lit(0.0)], 2: [drawn(5, (0.2, 0.8)), drawn(6, (0.1, 0.4)), F.lit(0.0)], 3: [drawn(k, (0.3, 0.7)) for k in (5, 6, 7)], 4: [drawn(5, flat), F.lit(0.0), F.lit(0.0)]}

    def parameter(i: int) -> Column:
        out = by_kind[4][i]
        for k in range(4):
            out = F.when(kind == k, by_kind[k][i]).otherwise(out)
        return out

    return F.struct(
        kind.alias("kind"), F.floor(drawn(1) * 3).cast("int").alias("axis"), drawn(2, low).alias("low"), drawn(3, high).alias("high"), (drawn(4) < 0.5).alias("ascending"),
        *[parameter(i).alias(n) for i, n in enumerate("abc")],
    )


def chosen(choice: str, axes: Sequence[str], sizes: Sequence[Column]) -> Column:
    """The field that a ``random_choice`` (a column's name) describes; radial fields fall outwards where they are ascending."""
    c = {n: F.col(f"{choice}.{n}") for n in ("kind", "axis", "low", "high", "ascending", "a", "b", "c")}
    t = F.lit(0.0)
    for i, (a, n) in enumerate(zip(axes, sizes)):
        t = F.when(c["axis"] == i, _fraction(a, n, True)).otherwise(t)
    way, span = F.when(c["ascending"], t).otherwise(1 - t), c["high"] - c["low"]
    d = (t - c["a"]) / F.greatest(c["b"], F.lit(1e-9))
    far = F.sqrt(sum((F.col(a) - m * n) * (F.col(a) - m * n) for a, n, m in zip(axes, sizes, (c["a"], c["b"], c["c"])))) / F.sqrt(sum(n * n / 4.0 for n in sizes))
    far = clipped(far, 0.0, 1.0)
    out = F.when(c["kind"] == 0, c["low"] + span * way).when(c["kind"] == 1, c["low"] + span / (1 + F.exp(-c["b"] * (way - c["a"]))))
    out = out.when(c["kind"] == 2, c["low"] + span * F.exp(-0.5 * d * d)).when(c["kind"] == 3, c["low"] + span * F.when(c["ascending"], 1 - far).otherwise(far))
    return out.otherwise(c["a"])
