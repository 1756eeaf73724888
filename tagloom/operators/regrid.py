"""Irregular readings onto a regular grid by a Kalman smoother (problem 4).

Per drive and field the state is (value, slope) in continuous time, an integrated random walk: over a step of h
hours the value gains slope * h, and the noise covariance is q * [[h^3/3, h^2/2], [h^2/2, h]]. Each six-hour slot
holds at most one combined observation (mean of its readings at their mean time), made in Spark before Python sees
it, so a dense drive costs no more than a sparse one. Drives are filtered side by side: step k of the recursion
handles slot k of a whole batch of drives and all fields at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.groups import sorted_groups
from ..functions.readings import NameRule
from .trailing import distinct_readings

SLOT_S = 6 * 3600


def _spread(y: np.ndarray) -> np.ndarray:
    """Robust scale of successive differences by column (drive x field) over axis 0; 1e-6 at least."""
    out = np.zeros(y.shape[1:])
    for d in range(y.shape[1]):
        for f in range(y.shape[2]):
            v = y[:, d, f]
            v = v[~np.isnan(v)]
            if v.size > 1:
                a = np.abs(np.diff(v))
                out[d, f] = 1.4826 * np.median(a) or a.mean()
    return np.maximum(out, 1e-6)


BLOCK = 256  # slots whose states are held at once


def smooth_slots(y: np.ndarray, t: np.ndarray, q_ratio: float, step_h: float = SLOT_S / 3600, n: np.ndarray | None = None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed value and standard deviation at the middle of each slot.

    y: slots x drives x fields, NaN where nothing was observed; t: slots x drives, hours of the observation since
    the slot's start (ignored where none); n: slots x drives, readings that an observation is the mean of, whose
    variance is smaller in proportion. Two nodes per slot, the observation and the middle, in order of time. The
    first pass keeps one state per block of slots; on the way back each block's states are made again from it, so
    memory doesn't grow with a timeline's length beyond its values, and the result is the same.
    """
    s, d, f = y.shape
    mid = step_h / 2
    t = np.where(np.isnan(t), mid, t)
    first_is_obs = t <= mid
    scale = _spread(y)
    r = (0.7 * scale) ** 2
    q = q_ratio * scale**2
    seen = ~np.isnan(y)
    some = seen.any(axis=0)
    start = np.where(some, np.take_along_axis(y, seen.argmax(axis=0)[None], axis=0)[0], 0.0)
    share = np.ones((s, d, 1)) if n is None else np.maximum(n, 1)[:, :, None].astype(float)
    state = (start, np.zeros((d, f)), (10 * scale) ** 2, np.zeros((d, f)), (scale / 2) ** 2, np.zeros(d))

    def forward(state: tuple, lo: int, hi: int, keep: bool) -> tuple:
        x0, x1, p00, p01, p11, before = state
        if keep:
            pred, post, hs = np.empty((5, 2 * (hi - lo), d, f)), np.empty((5, 2 * (hi - lo), d, f)), np.empty((2 * (hi - lo), d))
        for node in range(2 * lo, 2 * hi):
            k, second = divmod(node, 2)
            is_obs_node = first_is_obs[k] != bool(second)
            now = k * step_h + np.where(is_obs_node, t[k], mid)
            h1 = now - before if node else np.zeros(d)
            before = now
            h = h1[:, None]
            x0 = x0 + h * x1
            p00 = p00 + 2 * h * p01 + h * h * p11 + q * h**3 / 3
            p01 = p01 + h * p11 + q * h * h / 2
            p11 = p11 + q * h
            if keep:
                i = node - 2 * lo
                pred[:, i] = x0, x1, p00, p01, p11
                hs[i] = h1
            is_obs = is_obs_node[:, None] & seen[k]
            if is_obs.any():
                g = p00 + r / share[k]
                k0, k1 = np.where(is_obs, p00 / g, 0.0), np.where(is_obs, p01 / g, 0.0)
                e = np.where(is_obs, np.nan_to_num(y[k]) - x0, 0.0)
                x0, x1 = x0 + k0 * e, x1 + k1 * e
                p11 = p11 - k1 * p01
                p01 = p01 - k0 * p01
                p00 = p00 - k0 * p00
            if keep:
                post[:, i] = x0, x1, p00, p01, p11
        return (x0, x1, p00, p01, p11, before), *((pred, post, hs) if keep else ())

    starts = list(range(0, s, block))
    states = [state]
    for lo in starts[:-1]:
        states.append(forward(states[-1], lo, lo + block, False)[0])
    value, var = np.empty((s, d, f)), np.empty((s, d, f))
    nxt = None  # prediction of the node after, and the hours to it
    for lo, state in zip(reversed(starts), reversed(states)):
        _, pred, post, hs = forward(state, lo, min(lo + block, s), True)
        for i in range(pred.shape[1] - 1, -1, -1):
            k, second = divmod(2 * lo + i, 2)
            a0, a1, b00, b01, b11 = post[:, i]
            if nxt is None:
                m0, m1, s00, s01, s11 = a0, a1, b00, b01, b11
            else:
                (c0, c1, d00, d01, d11), h1 = nxt
                h = h1[:, None]
                det = np.maximum(d00 * d11 - d01 * d01, 1e-300)
                e00, e01, e10, e11 = b00 + h * b01, b01, b01 + h * b11, b11  # P F'
                g00, g01 = (e00 * d11 - e01 * d01) / det, (e01 * d00 - e00 * d01) / det
                g10, g11 = (e10 * d11 - e11 * d01) / det, (e11 * d00 - e10 * d01) / det
                u0, u1 = m0 - c0, m1 - c1
                m0, m1 = a0 + g00 * u0 + g01 * u1, a1 + g10 * u0 + g11 * u1
                v00, v01, v11 = s00 - d00, s01 - d01, s11 - d11
                s00, s01, s11 = (
                    b00 + g00 * g00 * v00 + 2 * g00 * g01 * v01 + g01 * g01 * v11,
                    b01 + g00 * g10 * v00 + (g00 * g11 + g01 * g10) * v01 + g01 * g11 * v11,
                    b11 + g10 * g10 * v00 + 2 * g10 * g11 * v01 + g11 * g11 * v11,
                )
            nxt = pred[:, i], hs[i]
            is_mid = (first_is_obs[k] == bool(second))[:, None]
            value[k], var[k] = np.where(is_mid, m0, value[k] if second == 0 else 0.0), np.where(is_mid, s00, var[k] if second == 0 else 0.0)
    value[:, ~some], var[:, ~some] = np.nan, np.nan
    return value, np.sqrt(np.maximum(var, 0))


def slot_observations(readings: DataFrame, rule: NameRule, fields: list[str]) -> DataFrame:
    """Per drive and six-hour UTC slot: distinct readings, their mean time within the slot (hours), field means."""
    distinct = distinct_readings(readings, rule, fields, "slot", lambda ts: F.floor(F.unix_seconds(ts) / SLOT_S).cast("bigint"))
    hours = (F.unix_micros("ts") / 1e6 - F.col("slot") * SLOT_S) / 3600
    return distinct.groupBy("drive_id", "slot").agg(F.count("*").alias("n_readings"), F.avg(hours).alias("at_h"), *[F.avg(f).alias(f) for f in fields])


def regular_grid(readings: DataFrame, rule: NameRule, fields: list[str] | None = None, q_ratio: float = 2e-4, wide_sd: float = 3.0, cells: int = 2_000_000) -> DataFrame:
    """One row per drive and six-hour slot from its first to its last reading.

    ``missing`` marks slots without a reading. A field that the slot's readings show keeps their mean; elsewhere it
    is the smoothed value and ``<field>_filled`` is true. ``<field>_grid`` is the smoothed value at the slot's middle
    for every slot, observed or not, and ``<field>_sd`` its standard deviation. A field the drive never shows stays
    null. ``uncertain`` marks slots with a filled field whose deviation exceeds ``wide_sd`` times
    the field's usual one. Drives or times that are null leave no rows; ``cells`` bounds the memory of a batch.
    """
    fields = fields or rule.fields
    m = len(fields)
    schema = T.StructType(
        [T.StructField("drive_id", T.StringType()), T.StructField("slot_start", T.TimestampType()), T.StructField("n_readings", T.LongType()), T.StructField("missing", T.BooleanType()), T.StructField("uncertain", T.BooleanType())]
        + [T.StructField(f"{f}{e}", t) for f in fields for e, t in (("", T.DoubleType()), ("_grid", T.DoubleType()), ("_sd", T.DoubleType()), ("_filled", T.BooleanType()))]
    )
    names = [x.name for x in schema]

    def solve(part: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """part: (drive, slots, readings, hours, values) of drives that are filtered side by side."""
        long = max(int(x[1][-1] - x[1][0]) + 1 for x in part)
        y, t, n = np.full((long, len(part), m), np.nan), np.full((long, len(part)), np.nan), np.ones((long, len(part)))
        for i, (_, slots, count, at, v) in enumerate(part):
            k = slots - slots[0]
            y[k, i], t[k, i], n[k, i] = v, at, count
        value, sd = smooth_slots(y, t, q_ratio, n=n)
        for i, (drive, slots, n, _, _) in enumerate(part):
            size = int(slots[-1] - slots[0]) + 1
            count = np.zeros(size, dtype=np.int64)
            count[slots - slots[0]] = n
            own, w, u = y[:size, i], value[:size, i], sd[:size, i]
            filled = np.isnan(own) & ~np.isnan(w)
            with np.errstate(invalid="ignore"):
                usual = np.nanmedian(np.where(np.isnan(u).all(axis=0), 0.0, u), axis=0)
                wide = (filled & (u > wide_sd * usual)).any(axis=1)
            out = np.where(np.isnan(own), w, own)
            starts = pa.array((slots[0] + np.arange(size)) * (SLOT_S * 1_000_000)).cast(pa.timestamp("us", "UTC"))
            cols = [pa.array([drive] * size, type=pa.string()), starts, pa.array(count), pa.array(count == 0), pa.array(wide)]
            for j in range(m):
                gone = np.isnan(out[:, j])
                cols += [pa.array(out[:, j], mask=gone), pa.array(w[:, j], mask=gone), pa.array(u[:, j], mask=gone), pa.array(filled[:, j])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, long = [], 0
        for (drive,), tab in sorted_groups(batches, 1):
            slots = tab.column(1).to_numpy()
            size = int(slots[-1] - slots[0]) + 1
            if part and max(long, size) * (len(part) + 1) * m * 20 > cells * 10:
                yield from solve(part)
                part, long = [], 0
            v = np.column_stack([tab.column(4 + j).to_numpy() for j in range(m)]).astype(float)
            part.append((drive, slots, tab.column(2).to_numpy(), tab.column(3).to_numpy(), v))
            long = max(long, size)
        if part:
            yield from solve(part)

    obs = slot_observations(readings, rule, fields).select("drive_id", "slot", "n_readings", "at_h", *fields)
    return obs.repartition("drive_id").sortWithinPartitions("drive_id", "slot").mapInArrow(run, schema)
