"""Time-series features of drives: lagged differences, labels, survival, latest and last rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import MOST, any_hot, in_parts, numbered

# Weibull (shape, scale in days) where too few failures are known.
DEFAULT_WEIBULL = {"hdd": (2.1, 1730.0), "ssd": (1.8, 2400.0)}


def lag_difference(rows: DataFrame, key: str, order: list[str], fields: list[str], lag: int = 7, most: int = MOST) -> DataFrame:
    """Difference of each field against ``lag`` rows earlier in the key's order; rows without one are left out.

    If a key has more than ``most`` rows, they are sorted by range over all tasks. Where a key goes on from one part to the next, the next one gets
    copies of the ``lag`` rows before it, so no task needs a key's whole timeline.
    """
    if not any_hot(rows, key, most):
        w = Window.partitionBy(key).orderBy(*order)
        plain = rows.select("*", *[(F.col(f) - F.lag(f, lag).over(w)).alias(f"{f}_d{lag}") for f in fields], F.row_number().over(w).alias("_i"))
        return plain.where(F.col("_i") > lag).drop("_i")
    own, carried = numbered(rows, key, order)
    own = own.withColumn("_core", F.lit(True))
    at = F.broadcast(carried.select("_key", "_p", "_n0"))  # at most a row per part
    copies = own.join(at, F.col("_key").eqNullSafe(F.col(key)) & F.col("_n").between(F.col("_n0") - lag + 1, F.col("_n0"))).withColumn("_part", F.col("_p")).withColumn("_core", F.lit(False))
    both = own.unionByName(copies.select(*own.columns))
    w = Window.partitionBy("_part", key).orderBy("_n")
    out = both.select("*", *[(F.col(f) - F.lag(f, lag).over(w)).alias(f"{f}_d{lag}") for f in fields])
    return out.where(F.col("_core") & (F.col("_n") > lag)).select(*rows.columns, *[f"{f}_d{lag}" for f in fields])


def failure_label(day: Column, failed: Column, days: int = 30) -> Column:
    """1 where the failure lies 0 to ``days`` days ahead, else 0."""
    return F.when(F.datediff(failed, day).between(0, days), 1).otherwise(0)


def last_rows_delta(rows: DataFrame, key: str, order: list[str], fields: list[str], n: int = 8) -> DataFrame:
    """Latest minus oldest of the last n rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    t = rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n)
    return t.groupBy(key).agg(F.count("*").alias("n_rows"), *[(F.min_by(f, "_i") - F.max_by(f, "_i")).alias(f"{f}_delta") for f in fields])


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def weibull_days(p: Column, kind: Column, params: dict[str, tuple[float, float]] = DEFAULT_WEIBULL) -> Column:
    """Days at which a share p has failed, at least 1; null below 0.02."""
    k = F.when(kind == "ssd", params["ssd"][0]).otherwise(params["hdd"][0])
    lam = F.when(kind == "ssd", params["ssd"][1]).otherwise(params["hdd"][1])
    q = F.least(p, F.lit(0.999))
    return F.when(p >= 0.02, F.greatest(F.lit(1.0), lam * F.pow(-F.log(1 - q), 1 / k)))


# Shares of the estimate on either side of it.
BANDS = {"hdd": (0.25, 0.35), "ssd": (0.30, 0.40)}


def band(days: Column, kind: Column) -> tuple[Column, Column]:
    """Whole days of the estimate's lower and upper bound; null without an estimate."""
    lo, hi = (F.when(kind == "ssd", BANDS["ssd"][i]).otherwise(BANDS["hdd"][i]) for i in (0, 1))
    return F.greatest(F.lit(1), F.floor(days * (1 - lo))).cast("int"), F.floor(days * (1 + hi)).cast("int")


def risk(days: Column) -> Column:
    return F.when(days.isNull(), "healthy").when(days <= 14, "critical").when(days <= 60, "high").when(days <= 180, "moderate").otherwise("low")


def fit_weibull(lifetimes: DataFrame, kind: str, days: str, least: int = 10, steps: int = 60) -> DataFrame:
    """(kind, shape, scale, n) by maximum likelihood, location 0; defaults below ``least`` lifetimes.

    The shape's equation is solved by bisection on sums over a histogram of log lifetimes (2,048 cells per kind), so
    no group is gathered: cells are summed where the rows are.
    """
    x = F.log(F.col(days))
    cells = lifetimes.where(F.col(days) > 0).groupBy(kind, F.round(x * 128).alias("cell")).agg(F.count("*").alias("n"), F.avg(x).alias("m"))

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        name = df[kind].iloc[0]
        n, m = df["n"].to_numpy(float), df["m"].to_numpy(float)
        total = n.sum()
        if total < least or n.size < 2:
            k, lam = DEFAULT_WEIBULL.get(name, DEFAULT_WEIBULL["hdd"])
            return pd.DataFrame([(name, k, lam, int(total))], columns=[kind, "shape", "scale", "n"])
        mean = (n * m).sum() / total
        lo, hi = 1e-3, 200.0
        for _ in range(steps):
            k = (lo + hi) / 2
            w = n * np.exp(k * (m - m.max()))
            lo, hi = (lo, k) if (w * m).sum() / w.sum() - 1 / k - mean > 0 else (k, hi)
        lam = math.exp(m.max()) * ((n * np.exp(k * (m - m.max()))).sum() / total) ** (1 / k)
        return pd.DataFrame([(name, round(k, 4), round(lam, 2), int(total))], columns=[kind, "shape", "scale", "n"])

    return cells.groupBy(kind).applyInPandas(solve, f"{kind} string, shape double, scale double, n bigint")


def online_cost(tasks: DataFrame, key: str, order: list[str], compute: str, real: str, rate: float = 0.2) -> DataFrame:
    """Per key, the cost coefficient and the running error after its tasks in order.

    Prediction a * (compute + 1); then a -= rate * (prediction - real) / (compute + 1). The error is a moving
    average of the absolute share, updated where real > 0. Both steps are linear in what they update, so the tasks
    are cut into parts by range: each part gives its step of a as one linear map, the maps of a key are chained over
    its parts (a row per part), and with the a that a part starts from it gives its step of the error likewise.
    """
    kind = tasks.schema[key].dataType.simpleString()

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(part, key, n, scale and shift of a; with a start: a, scale and shift of the error) of each stretch of one key."""
        cur, n, a, out = None, 0, (1.0, 0.0, 0.0, 1.0, 0.0), []
        for df in frames:
            for p, k, c, r, s in zip(df["_part"], df[key], df[compute], df[real], df["_start"]):
                if (p, k) != cur:
                    if n:
                        out.append((*cur, n, *a))
                    cur, n, a = (p, k), 0, (1.0, 0.0, s, 1.0, 0.0)
                scale, shift, at, e_scale, e_shift = a
                if r > 0:
                    e_scale, e_shift = (1 - rate) * e_scale, e_shift + rate * (abs(at * (c + 1) - r) / r - e_shift)
                x = r / (c + 1)
                a = ((1 - rate) * scale, shift - rate * (shift - x), at - rate * (at - x), e_scale, e_shift)
                n += 1
        if n:
            out.append((*cur, n, *a))
        yield pd.DataFrame(out, columns=names)

    names = ["_part", key, "n", "scale", "shift", "a", "e_scale", "e_shift"]
    schema = f"_part int, {key} {kind}, n bigint, scale double, shift double, a double, e_scale double, e_shift double"
    src = tasks.where(F.col(key).isNotNull() & F.col(compute).isNotNull() & F.col(real).isNotNull()).select(key, *order, compute, real)
    parts = in_parts(src, key, order)
    sort = lambda df: df.sortWithinPartitions("_part", key, *order).select("_part", key, compute, real, "_start").mapInPandas(steps, schema)
    first = sort(parts.withColumn("_start", F.lit(1.0)))
    w = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    maps = first.select("_part", key, F.collect_list(F.struct("scale", "shift")).over(w).alias("m")).where(F.size("m") > 0)
    starts = maps.select(F.col("_part").alias("_p"), F.col(key).alias("_key"), F.aggregate("m", F.lit(1.0), lambda a, x: x["scale"] * a + x["shift"]).alias("_start"))
    with_start = parts.join(F.broadcast(starts), (F.col("_p") == F.col("_part")) & (F.col("_key") == F.col(key)), "left").withColumn("_start", F.coalesce("_start", F.lit(1.0)))  # at most a row per part
    done = sort(with_start).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_part", "n", "a", "e_scale", "e_shift"))).alias("m"))
    return done.select(key, F.element_at("m", -1)["a"].alias("coefficient"), F.aggregate("m", F.lit(0.0), lambda e, x: x["e_scale"] * e + x["e_shift"]).alias("error"), F.aggregate("m", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("n"))


def levenberg_marquardt(f, x0: np.ndarray, steps: int = 200, damping: float = 1e-3, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Least squares of a residual function with a numeric Jacobian: (parameters, sum of squares)."""
    x = np.asarray(x0, dtype=float)
    r = np.asarray(f(x), dtype=float)
    cost = float(r @ r)
    for _ in range(steps):
        jac = np.empty((r.size, x.size))
        for i in range(x.size):
            h = 1e-6 * max(1.0, abs(x[i]))
            y = x.copy()
            y[i] += h
            jac[:, i] = (np.asarray(f(y)) - r) / h
        a, g = jac.T @ jac, jac.T @ r
        d = np.linalg.solve(a + damping * np.diag(np.maximum(np.diag(a), 1e-12)), -g)
        new = np.asarray(f(x + d), dtype=float)
        got = float(new @ new)
        if got < cost:
            small = cost - got < tol * max(cost, 1e-300) or float(np.abs(d).max()) < tol
            x, r, cost, damping = x + d, new, got, damping / 10
            if small:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return x, cost


def row_sample(rows: DataFrame, key: str, n: int = 200_000, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if there are no more) in random order of the unique ``key``, the same for the same seed; wide rows stay where they are."""
    at = F.struct(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(key).alias("k"))
    last = rows.select(at.alias("_at")).orderBy("_at").limit(n).agg(F.max("_at").alias("_last"))
    return rows.crossJoin(F.broadcast(last)).where(at <= F.col("_last")).drop("_last")
