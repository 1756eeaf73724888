"""Statistics of numeric arrays, over elements by higher-order functions and over bytes by Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def mad(a: Column) -> Column:
    """Mean absolute deviation about the mean."""
    m = mean(a)
    return _sum(F.transform(a, lambda x: F.abs(x - m))) / F.size(a)


def derivative(a: Column) -> Column:
    """Mean absolute first difference; 0 for fewer than two elements."""
    n = F.size(a)
    d = F.zip_with(F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, y: F.abs(x - y))
    return F.when(n < 2, 0.0).otherwise(_sum(d) / (n - 1))


def second_derivative(a: Column) -> Column:
    """Mean absolute second difference; 0 for fewer than three elements."""
    n = F.size(a)
    k = F.greatest(n - 2, F.lit(0))
    left = F.zip_with(F.slice(a, F.lit(3), k), F.slice(a, F.lit(2), k), lambda x, y: x - 2 * y)
    return F.when(n < 3, 0.0).otherwise(_sum(F.zip_with(left, F.slice(a, F.lit(1), k), lambda x, y: F.abs(x + y))) / (n - 2))


def mse(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def psnr(a: Column, b: Column, whole_bytes: bool = False) -> Column:
    """Peak signal to noise over the data's range (1 for none), or over 255 for bytes; 0 for equal data and for negative results."""
    e = mse(a, b)
    span = F.lit(255.0) if whole_bytes else F.array_max(a) - F.array_min(a)
    span = F.when(span < 1e-10, 1.0).otherwise(span)
    return F.when(e < 1e-10, 0.0).otherwise(F.greatest(F.lit(0.0), 10 * F.log10(span * span / e)))


def ssim(a: Column, b: Column, k1: float = 0.01, k2: float = 0.03) -> Column:
    """Global structural similarity with the range of the first array."""
    n = F.size(a)
    ma, mb = mean(a), mean(b)
    va, vb = _sum(F.transform(a, lambda x: (x - ma) * (x - ma))) / n, _sum(F.transform(b, lambda x: (x - mb) * (x - mb))) / n
    cov = _sum(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb))) / n
    span = F.array_max(a) - F.array_min(a)
    c1, c2 = F.pow(k1 * span, 2), F.pow(k2 * span, 2)
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def max_error(a: Column, b: Column) -> Column:
    """Largest absolute difference of two elements at one place."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def max_run(a: Column) -> Column:
    """Longest run of equal elements in a row."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(a, start, step, lambda s: s["best"])


def _central(array: str, center: str, k: int) -> Column:
    return _sum(F.transform(array, lambda x: F.pow(x - F.col(center), F.lit(float(k))))) / F.size(array)


def moments(rows: DataFrame, key: str, array: str) -> DataFrame:
    """n, mean, sample deviation, and the skewness and excess kurtosis of the population.

    Skewness is 0 below three elements or a variance under 1e-10, kurtosis below four.
    """
    a = doubles(F.col(array))
    p = rows.select(key, a.alias("_a")).withColumn("_m", mean(F.col("_a")))
    powers = [_central("_a", "_m", k).alias(f"_m{k}") for k in (2, 3, 4)]
    q = p.select(key, F.size("_a").alias("n"), F.col("_m").alias("mean"), *powers)
    flat = F.col("_m2") < 1e-10
    return q.select(
        key, "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("_m2") * F.col("n") / (F.col("n") - 1))).otherwise(0.0).alias("std"), F.when((F.col("n") < 3) | flat, 0.0).otherwise(F.col("_m3") / F.pow("_m2", F.lit(1.5))).alias("skew"), F.when((F.col("n") < 4) | flat, 0.0).otherwise(F.col("_m4") / (F.col("_m2") * F.col("_m2")) - 3.0).alias("kurt")
    )


UNKNOWN, CONSTANT, UNIFORM, NORMAL, GAMMA, EXPONENTIAL = "unknown", "constant", "uniform", "normal", "gamma", "exponential"


def by_moments(skew: float, kurt: float) -> str:
    return EXPONENTIAL if skew > 1.5 else GAMMA if skew > 0.4 else UNIFORM if kurt < -0.5 else NORMAL


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function by the rational approximation with errors under 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return np.sign(x) * (1 - poly * np.exp(-x * x))


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def _fits(v: np.ndarray, bins: int = 64) -> np.ndarray:
    """Chi-square distances per bin of each row's histogram to each family with the row's parameters: rows x (uniform, normal, gamma, exponential)."""
    rows, n = v.shape
    lo, hi = v.min(axis=1, keepdims=True), v.max(axis=1, keepdims=True)
    m, s = v.mean(axis=1, keepdims=True), v.std(axis=1, keepdims=True)
    width = (hi - lo) / bins
    cell = np.minimum(((v - lo) / width).astype(int), bins - 1)
    count = np.bincount((np.arange(rows)[:, None] * bins + cell).ravel(), minlength=rows * bins).reshape(rows, bins)
    at = width * np.arange(bins + 1)
    normal = np.diff(0.5 * (1 + _erf((lo + at - m) / (s * 2**0.5))), axis=1)
    expo = np.diff(1 - np.exp(-at / np.maximum(m - lo, 1e-12)), axis=1)
    mid = (at[:, 1:] + at[:, :-1]) / 2
    mg = np.maximum(m - lo, 1e-12)
    shape, scale = mg * mg / (s * s), s * s / mg
    gamma = np.exp((shape - 1) * np.log(np.maximum(mid, 1e-12)) - mid / scale - _LGAMMA(shape) - shape * np.log(scale)) * width
    out = []
    for p in (np.full((rows, bins), 1 / bins), normal, gamma, expo):
        want = np.maximum(p * n, 1e-3)
        out.append(((count - want) ** 2 / want).sum(axis=1) / bins)
    return np.stack(out, axis=1)


def classify_rows(v: np.ndarray) -> list[tuple[str, float]]:
    """(family, confidence) of each row of finite values: 0.9 where histogram and moments agree, else 0.6; moments win unless twice as far off."""
    rows, n = v.shape
    if n < 10:
        return [(UNKNOWN, 0.0)] * rows
    c = v - v.mean(axis=1, keepdims=True)
    m2 = (c**2).mean(axis=1)
    flat = m2 < 1e-10
    out: list[tuple[str, float]] = [(CONSTANT, 1.0)] * rows
    some = np.flatnonzero(~flat)
    if some.size:
        skew, kurt = (c[some] ** 3).mean(axis=1) / m2[some] ** 1.5, (c[some] ** 4).mean(axis=1) / m2[some] ** 2 - 3
        names = (UNIFORM, NORMAL, GAMMA, EXPONENTIAL)
        with np.errstate(over="ignore", invalid="ignore"):
            fits = _fits(v[some])
        for i, k, q, f in zip(some.tolist(), skew, kurt, fits):
            family, best = by_moments(k, q), names[int(np.argmin(f))]
            out[i] = (best, 0.9) if best == family else (family if f[names.index(family)] < 2 * f.min() else best, 0.6)
    return out


def classify(values: np.ndarray) -> tuple[str, float]:
    v = np.asarray(values, dtype=float)
    return classify_rows(v[np.isfinite(v)][None])[0]


def byte_features(rows: DataFrame, key: str, array: str) -> DataFrame:
    """Of each array as little-endian float32: entropy in bits, zero bytes' share, variance of byte counts, family.

    Null arrays give null features, empty ones 0 and ``unknown``. Arrays of one length are worked on together.
    """
    schema = T.StructType([rows.schema[key], T.StructField("entropy", T.DoubleType()), T.StructField("zero_ratio", T.DoubleType()), T.StructField("freq_variance", T.DoubleType()), T.StructField("family", T.StringType()), T.StructField("confidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column(1)
            n = pc.list_value_length(a).fill_null(-1).to_numpy(zero_copy_only=False).astype(int)
            starts = np.append(0, np.cumsum(np.maximum(n, 0)))
            flat = a.flatten().to_numpy(zero_copy_only=False).astype(float)
            nums = np.full((3, len(n)), np.nan)
            family: list = [None] * len(n)
            sure: list = [None] * len(n)
            for size in np.unique(n[n >= 0]).tolist():
                at = np.flatnonzero(n == size)
                v = flat[starts[at][:, None] + np.arange(size)]
                raw = np.ascontiguousarray(v.astype("<f4")).view(np.uint8).reshape(len(at), 4 * size)
                h = np.bincount((np.arange(len(at))[:, None] * 256 + raw).ravel(), minlength=len(at) * 256).reshape(len(at), 256)
                p = h / max(4 * size, 1)
                nums[0, at] = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1)
                nums[1, at] = p[:, 0]
                nums[2, at] = h.var(axis=1)
                whole = np.isfinite(v).all(axis=1)
                kinds = iter(classify_rows(v[whole])) if whole.any() else iter(())
                for i, ok, x in zip(at.tolist(), whole.tolist(), v):
                    family[i], sure[i] = next(kinds) if ok else classify(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, mask=n < 0) for c in nums], pa.array(family, pa.string()), pa.array(sure, pa.float64())], names=schema.names)

    return rows.select(key, array).mapInArrow(run, schema)


def byte_histogram(rows: DataFrame, payload: str) -> DataFrame:
    """(byte, n) for all 256 values over all payloads; counted from the batches' buffers, so no byte becomes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(x for x in b.column(0).to_pylist() if x), dtype=np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["byte", "n"])

    each = rows.select(F.col(payload).cast("binary").alias("p")).mapInArrow(run, "byte int, n bigint")
    zero = rows.sparkSession.range(256).select(F.col("id").cast("int").alias("byte"), F.lit(0).cast("bigint").alias("n"))
    return each.unionByName(zero).groupBy("byte").agg(F.sum("n").alias("n"))


def groom(values: np.ndarray, digits: int = 3) -> np.ndarray:
    """float32 values cut to so many significant digits by zeroing mantissa bits; 0 and non-finite stay."""
    v = np.asarray(values, dtype=np.float32)
    keep = min(23, max(1, int(digits * 3.32192809489)))
    bits = v.view(np.uint32) & np.uint32(0xFFFFFFFF ^ ((1 << (23 - keep)) - 1))
    return np.where(np.isfinite(v) & (v != 0), bits.view(np.float32), v)


def block_sample(a: Column, seed: int, blocks: int = 16, size: int = 64) -> Column:
    """``blocks`` stretches of ``size`` elements at starts drawn by a hash; a shorter array is taken whole."""
    n = F.size(a)
    starts = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), i), F.greatest(n - size + 1, F.lit(1))).cast("int") + 1)
    return F.when(n <= blocks * size, a).otherwise(F.flatten(F.transform(starts, lambda s: F.slice(a, s, F.lit(size)))))
