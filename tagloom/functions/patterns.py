"""Synthetic series for tests and benchmarks, from a row number and a seed."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(i: Column, seed: int) -> Column:
    """A value between 0 and 1, both out, drawn by a hash of the row number."""
    return (F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def pattern(kind: str, i: Column, n: int, seed: int = 1) -> Column:
    """Element i of n of a pattern: uniform, gaussian, constant, gradient, sinusoid, repeating, bimodal, exponential."""
    u, v = _unit(i, seed), _unit(i, seed + 1)
    normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    made = {
        "uniform": u,
        "gaussian": normal,
        "constant": F.lit(1.0),
        "gradient": i / float(max(n - 1, 1)),
        "sinusoid": F.sin(2 * math.pi * i / 64.0),
        "repeating": (i % 16) / 16.0,
        "bimodal": F.when(_unit(i, seed + 2) < 0.5, normal * 0.1 - 1).otherwise(normal * 0.1 + 1),
        "exponential": -F.log(u),
    }
    if kind not in made:
        raise ValueError(f"no pattern {kind!r}")
    return made[kind].cast("double")


def series(spark: SparkSession, kind: str, n: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", pattern(kind, F.col("id"), n, seed).alias("value"))


def gray_scott(size: int = 64, steps: int = 200, feed: float = 0.04, kill: float = 0.06, seed: int = 1) -> np.ndarray:
    """The second substance of a reaction and diffusion of two on a square with joined edges, after so many steps."""
    rng = np.random.default_rng(seed)
    u, v = np.ones((size, size)), np.zeros((size, size))
    c = slice(size // 2 - max(1, size // 10), size // 2 + max(1, size // 10))
    u[c, c], v[c, c] = 0.5, 0.25
    v += 0.01 * rng.random((size, size))
    around = lambda x: sum(np.roll(x, d, a) for a in (0, 1) for d in (1, -1)) - 4 * x
    for _ in range(steps):
        r = u * v * v
        u = u + 0.2 * around(u) - r + feed * (1 - u)
        v = v + 0.1 * around(v) + r - (feed + kill) * v
    return v


KINDS = ("uniform", "gaussian", "constant", "gradient", "sinusoidal", "repeating", "grayscott", "bimodal", "exponential")


def parse_spec(spec: str) -> list[tuple[str, float]]:
    """(kind, share) of ``uniform:40,gaussian:60``: unknown kinds and parts without a number's colon are left out, shares are made to add up to 1."""
    out = []
    for item in spec.split(","):
        name, colon, share = item.partition(":")
        if colon and name in KINDS:
            out.append((name, float(share) / 100))
    total = sum(s for _, s in out)
    return [(k, s / total) for k, s in out] if total > 0 and abs(total - 1) > 0.01 else out


def mixed(spark: SparkSession, spec: str, n: int, seed: int = 1) -> DataFrame:
    """(id, kind, value): rows 0 to n - 1 in one stretch per kind of the spec, as long as its share."""
    parts, at = parse_spec(spec), 0
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("double")
    for i, (k, share) in enumerate(parts):
        end = n if i == len(parts) - 1 else at + round(share * n)
        if k == "grayscott":
            field = F.array(*[F.lit(float(x)) for x in gray_scott(16, seed=seed).ravel()])
            v = field[(F.col("id") % 256).cast("int")]
        else:
            v = pattern("sinusoid" if k == "sinusoidal" else k, F.col("id") - at, max(end - at, 1), seed)
        here = (F.col("id") >= at) & (F.col("id") < end)
        kind, value = F.when(here, F.lit(k)).otherwise(kind), F.when(here, v).otherwise(value)
        at = end
    return spark.range(n).select("id", kind.alias("kind"), value.alias("value"))
