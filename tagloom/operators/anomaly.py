"""Implausible measurements per source by state-space forecasting (problem 2).

Each source's distinct records are forecast one step ahead by a Kalman filter: a level that may wander for
temperatures, a line with the source's usual pace for counters. An innovation beyond the threshold in units of its
own deviation withholds the update; if the records come back within three, they are candidates for spikes, and if
not, the level has shifted and the filter restarts there. A second filter takes every record at its word (no
measurement noise, so its forecast is the record before): where the variance of its innovations over a window
vanishes, the value is stuck. Candidates of either sort are then held against the records around them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.groups import sorted_groups
from ..functions.readings import NameRule, reading_instant, with_metrics
from .timelines import Cuts, cuts, split_hot

OK, MISSING, IMPOSSIBLE, SPIKE, STUCK = 0, 1, 2, 3, 4
STATUS = {MISSING: "missing", IMPOSSIBLE: "impossible", SPIKE: "spike", STUCK: "stuck"}


@dataclass(frozen=True)
class Rule:
    """What holds for one field: the possible range, the kind of state, thresholds, and filler codes."""

    low: float
    high: float
    trend: bool  # a line with the source's usual pace; else a level
    min_dev: float  # at least this far from the level
    sigmas: float = 5.0  # and beyond this many standard deviations (level only)
    run: int = 8  # stuck: so many equal values
    run_s: float = 36 * 3600.0  # over so long
    step_s: float = 6 * 3600.0  # the habit of standing still is judged at this spacing, however dense the records are
    fillers: tuple[float, ...] = ()  # codes written in place of a value, where the source is elsewhere


RULES = {"smart_194": Rule(-40.0, 125.0, False, 6.0), "smart_9": Rule(0.0, 300_000.0, True, 200.0)}


def innovation_variance(v: np.ndarray, t: np.ndarray, window: int) -> np.ndarray:
    """Mean square of the last ``window`` standardised innovations of the filter without measurement noise, at each record from the ``window``-th on.

    Its gain is 1 and its state's variance grows with the time passed, so the innovation is the step from the record
    before and its deviation the root of that time. Innovations count up to 1,000 deviations, which keeps running
    sums exact enough for small ones.
    """
    e = np.diff(v) / np.sqrt(np.maximum(np.diff(t), 1.0) / 3600)
    total = np.append(0.0, np.cumsum(np.minimum(e * e, 1e6)))
    return (total[window:] - total[:-window]) / window


def _runs(v: np.ndarray, t: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """[start, end] of the maximal runs of equal values that are long enough: where the innovations' variance vanishes, and exactly then."""
    w = rule.run - 1
    if v.size < rule.run:
        return []
    gone = np.flatnonzero(innovation_variance(v, t, w) <= 1e-12)
    if not gone.size:
        return []
    cut = np.flatnonzero(np.diff(gone) > 1) + 1
    out = []
    for part in np.split(gone, cut):
        s, e = int(part[0]), int(part[-1]) + w
        equal = np.flatnonzero(v[s + 1 : e + 1] != v[s:e]) + s + 1
        for a, b in zip([s, *equal.tolist()], [*(equal - 1).tolist(), e]):
            if b - a + 1 >= rule.run and t[b] - t[a] >= rule.run_s:
                out.append((a, b))
    return out


Standing = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def standing(period: np.ndarray, v: np.ndarray) -> Standing:
    """Steps between successive periods, and first period, last period and steps of each stretch of equal values; v: the periods' first values."""
    cut = np.flatnonzero(v[1:] != v[:-1]) + 1
    s, e = np.append(0, cut), np.append(cut, v.size) - 1
    more = e > s
    return max(v.size - 1, 0), period[s[more]], period[e[more]], (e - s)[more]


def _first_of_periods(v: np.ndarray, t: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    period = t // rule.step_s
    first = np.flatnonzero(np.append(True, period[1:] != period[:-1]))
    return period[first], v[first]


def stuck_runs(v: np.ndarray, t: np.ndarray, rule: Rule, whole: Standing | None = None) -> list[tuple[int, int]]:
    """The runs that are no habit: outside the stretch a run lies in, the source seldom stands still.

    Standing still is judged between the first records of successive periods of ``step_s``, so a source that reports
    more often than its value can move is no different from one that doesn't. ``whole``: of the source's whole
    timeline where v and t are a segment of it.
    """
    runs = _runs(v, t, rule)
    if not runs:
        return []
    steps, lo, hi, n = whole or standing(*_first_of_periods(v, t, rule))
    still = int(n.sum())
    kept = []
    for s, e in runs:
        own = int(n[(lo < t[e] // rule.step_s) & (hi > t[s] // rule.step_s)].sum())
        if steps - own >= 3 and (still - own) / (steps - own) < 0.5:
            kept.append((s, e))
    return kept


def _standing_frame(df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values("period")
    steps, lo, hi, n = standing(df["period"].to_numpy(), df["v"].to_numpy())
    return pd.DataFrame({"source": [df["source"].iloc[0]], "steps": [steps], "lo": [lo], "hi": [hi], "n": [n]})


def standing_of_hot(rows: DataFrame, source: str, ts: str, rules: dict[str, Rule], hot: Cuts) -> DataFrame:
    """(source, seg, whole): each segment's copy of its timeline's standing, per field; a row per period is all that meets in one task."""
    out = None
    mine = rows.join(F.broadcast(hot.table.select(source)) if hot.few else hot.table.select(source), source, "left_semi")
    for f, rule in rules.items():
        own = F.col(f).cast("double")
        some = mine.where(F.col(ts).isNotNull() & own.between(rule.low, rule.high) & ~own.isin(*rule.fillers))
        us = F.unix_micros(ts)
        per = some.groupBy(F.col(source).alias("source"), F.floor(us / (rule.step_s * 1e6)).alias("period")).agg(F.min(F.struct(us.alias("us"), own.alias("v")))["v"].alias("v"))

        one = per.groupBy("source").applyInPandas(_standing_frame, "source string, steps bigint, lo array<bigint>, hi array<bigint>, n array<bigint>").withColumn("field", F.lit(f))
        out = one if out is None else out.unionByName(one)
    each = out.groupBy("source").agg(F.collect_list(F.struct("field", "steps", "lo", "hi", "n")).alias("whole"))
    segs = hot.table.select(F.col(source).alias("source"), F.explode(F.sequence(F.lit(0), F.col("n_seg") - 1)).alias("seg"))
    return segs.join(each, "source")


def _level(v: np.ndarray, rule: Rule, skip: np.ndarray) -> np.ndarray:
    """Candidates by a local-level Kalman filter: true where the update was withheld and the level came back."""
    use = v[~skip]
    d = np.abs(np.diff(use))
    scale = max(1.4826 * float(np.median(d)) / 1.4142, 0.5 * float(np.minimum(d, 3 * rule.min_dev).mean()) if d.size else 0.0, 0.2) if d.size else 1.0
    r, q = scale * scale, 0.02 * scale * scale
    x, p = float(np.median(use[:7])), r
    gate, least = 3.5, 0.75 * rule.min_dev
    out = np.zeros(v.size, dtype=bool)
    held: list[int] = []
    vals, skips = v.tolist(), skip.tolist()
    for i in range(len(vals)):
        if skips[i]:
            continue
        p += q
        e = vals[i] - x
        s = p + r
        if (e if e >= 0 else -e) > least and e * e > gate * gate * s:
            held.append(i)
            if len(held) > 3:  # it doesn't come back: a new level
                x, p = float(np.median([vals[j] for j in held])), r
                held = []
            continue
        if held:
            out[held] = True
            held = []
        k = p / s
        x += k * e
        p -= k * p
    return out


def _line(v: np.ndarray, h: np.ndarray, rule: Rule, skip: np.ndarray, pace: float) -> np.ndarray:
    """Candidates by a Kalman filter of (value, pace); h: hours of the records.

    The gate is four deviations of the innovation. Its noise is set by the rule: a settled filter's gate is three
    quarters of ``min_dev``, and no gap widens it beyond that, since the usual pace holds over gaps too; so whatever
    is further off than ``min_dev`` is a candidate.
    """
    out = np.zeros(v.size, dtype=bool)
    vals, hours, skips = v.tolist(), h.tolist(), skip.tolist()
    good = [i for i in range(len(vals)) if not skips[i]]
    if not good:
        return out
    first = good[: min(7, len(good))]
    x = float(np.median([vals[i] - pace * (hours[i] - hours[good[0]]) for i in first]))
    last, y = hours[good[0]], pace
    gate = 4.0
    r = (0.15 * rule.min_dev) ** 2
    qv, qp, p0, p1 = r / 180, 1e-9, r / 36, 1e-6
    p00, p01, p11 = p0, 0.0, p1
    held: list[int] = []
    for i in good:
        dt = hours[i] - last
        e = vals[i] - (x + y * dt)
        near = dt if dt < 24.0 else 24.0
        f00 = p00 + 2 * near * p01 + near * near * p11 + qv * near
        s = f00 + r
        if e * e > gate * gate * s:
            held.append(i)
            if len(held) > 3:
                x, last, y = float(np.median([vals[j] - pace * (hours[j] - hours[i]) for j in held])), hours[i], pace
                p00, p01, p11 = p0, 0.0, p1
                held = []
            continue
        if held:
            out[held] = True
            held = []
        x += y * dt
        p00 = f00
        p01 += near * p11
        p11 += qp * near
        k0, k1 = p00 / s, p01 / s
        x += k0 * e
        y += k1 * e
        p11 -= k1 * p01
        p01 -= k0 * p01
        p00 -= k0 * p00
        last = hours[i]
    return out


def _around(v: np.ndarray, ok: np.ndarray, reach: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Median of up to ``reach`` ordinary records on either side, without the record itself; ordinary ones per side."""
    good = np.flatnonzero(ok)
    g = v[good]
    pos = np.searchsorted(good, np.arange(v.size))  # ordinary records before each
    here = ok.astype(int)
    k = np.arange(1, reach + 1)
    left = pos[:, None] - k
    right = pos[:, None] + here[:, None] + k - 1
    idx = np.concatenate([left, right], axis=1)
    bad = (idx < 0) | (idx >= good.size)
    w = np.where(bad, np.nan, g[np.clip(idx, 0, max(good.size - 1, 0))] if good.size else np.nan)
    w.sort(axis=1)  # missing ones last
    n = 2 * reach - bad.sum(axis=1)
    at = np.arange(v.size)
    mid = np.where(n > 0, (w[at, np.maximum(n - 1, 0) // 2] + w[at, np.maximum(n, 1) // 2]) / 2, np.nan)
    return mid, np.minimum((~bad[:, :reach]).sum(axis=1), (~bad[:, reach:]).sum(axis=1))


def usual_pace(v: np.ndarray, h: np.ndarray, reach_h: float = 72.0) -> float:
    """Median gain per hour over about ``reach_h`` hours, so that neither rounding to hours or days nor dense records blur it."""
    j = np.searchsorted(h, h + reach_h)
    i = np.flatnonzero(j < h.size)
    if i.size < 3:  # a short series: from record to record, else from end to end
        dt = np.diff(h)
        ok = dt > 0
        return float(np.median(np.diff(v)[ok] / dt[ok])) if ok.any() else 0.0
    return float(np.median((v[j[i]] - v[i]) / (h[j[i]] - h[i])))


def assess(v: np.ndarray, t: np.ndarray, rule: Rule, whole: Standing | None = None) -> np.ndarray:
    """Status of each of a source's distinct records in order of time; t in seconds, v NaN where missing; whole: see stuck_runs."""
    out = np.zeros(v.size, dtype=np.int8)
    gone = ~np.isfinite(v)
    out[gone] = MISSING
    if rule.fillers:
        coded = ~gone & np.isin(v, rule.fillers)
        if coded.any():
            rest = v[~gone & ~coded & (v >= rule.low) & (v <= rule.high)]
            t_rest = t[~gone & ~coded & (v >= rule.low) & (v <= rule.high)]
            for i in np.flatnonzero(coded):
                if v[i] < rule.low or v[i] > rule.high or not rest.size:
                    out[i] = MISSING
                    continue
                near = rest[np.argsort(np.abs(t_rest - t[i]), kind="stable")[:5]]
                if abs(v[i] - np.median(near)) > rule.min_dev:
                    out[i] = MISSING
    impossible = (out == OK) & ((v < rule.low) | (v > rule.high))
    out[impossible] = IMPOSSIBLE
    idx = np.flatnonzero(out == OK)
    if idx.size < 3:
        return out
    w, u = v[idx], t[idx]
    stuck = np.zeros(w.size, dtype=bool)
    for s, e in stuck_runs(w, u, rule, whole):
        stuck[s + 1 : e + 1] = True
    if rule.trend:
        h = (u - u[0]) / 3600
        free = ~stuck
        a, b = w[free], h[free]
        pace = usual_pace(a, b)
        cand = _line(w, h, rule, stuck, pace)
        if cand.any():
            good = np.flatnonzero(~cand & ~stuck)
            for i in np.flatnonzero(cand):
                k = int(np.searchsorted(good, i))
                before, after = good[max(0, k - 3) : k], good[k : k + 3]
                if not before.size or not after.size:
                    continue
                lo = w[i] - np.median(w[before] + pace * (h[i] - h[before]))
                hi = w[i] - np.median(w[after] + pace * (h[i] - h[after]))
                if min(abs(lo), abs(hi)) > rule.min_dev and lo * hi > 0:
                    out[idx[i]] = SPIKE
    else:
        cand = _level(w, rule, stuck)
        if cand.any():
            level, sides = _around(w, ~cand & ~stuck)
            dev = w - level
            plain = dev[~cand & ~stuck & np.isfinite(dev)]
            sd = float(plain.std()) if plain.size > 1 else 0.0
            hit = cand & (sides > 0) & (np.abs(dev) > rule.sigmas * sd) & (np.abs(dev) >= rule.min_dev)
            out[idx[hit]] = SPIKE
    out[idx[stuck & (out[idx] == OK)]] = STUCK
    return out


def assess_records(v: np.ndarray, t: np.ndarray, rule: Rule, whole: Standing | None = None) -> np.ndarray:
    """Like :func:`assess` for records with repeats, sorted by (t, v); repeats share their original's status."""
    same = np.zeros(v.size, dtype=bool)
    if v.size > 1:
        eq = (v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
        same[1:] = eq & (t[1:] == t[:-1])
    first = ~same
    return assess(v[first], t[first], rule, whole)[np.cumsum(first) - 1]


def in_range(v: np.ndarray, rule: Rule) -> np.ndarray:
    """Status of records without source or time: only fillers and the possible range count."""
    out = np.zeros(v.size, dtype=np.int8)
    out[(v < rule.low) | (v > rule.high)] = IMPOSSIBLE
    out[~np.isfinite(v) | np.isin(v, rule.fillers)] = MISSING
    return out


CONTEXT_S, SEGMENT_S = 3 * 86400, 6 * 86400  # of a cut timeline: rows taken along on either side, least width


@dataclass
class Group:
    """One segment of a source's timeline in order of time: t in seconds, a column per field, the columns carried along."""

    source: str | None
    t: np.ndarray
    core: np.ndarray
    rows: pa.Array
    values: list[np.ndarray]
    carried: pa.Table
    whole: dict[str, Standing]


def by_source(rows: DataFrame, row_key: str, source: str, ts: str, rules: dict[str, Rule], hot: Cuts | None, work: Callable[[Group], pa.RecordBatch | None], schema: T.StructType, carry: tuple[str, ...] = (), context_s: int = CONTEXT_S) -> DataFrame:
    """Runs ``work`` on every source's timeline, or segment of it; the rows are read once and shuffled once.

    Rows without source or time belong to no timeline: they come in pieces as they arrive, with source None, and no
    task gathers them. ``whole`` tells of the whole timeline where it is cut, and is empty else.
    """
    fields = list(rules)
    rows = rows.select(row_key, source, ts, *fields, *[c for c in carry if c not in (row_key, source, ts, *fields)])
    split = split_hot(rows, source, ts, hot, context_s)
    lone = F.col(source).isNull() | F.col(ts).isNull()
    seg = F.when(lone, F.pmod(F.xxhash64(row_key), F.lit(1 << 20)).cast("int")).otherwise(F.col("seg"))
    src = split.select(F.when(~lone, F.col(source)).alias("source"), seg.alias("seg"), F.unix_micros(ts).alias("us"), "core", F.col(row_key).alias("row_key"), *fields, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    if hot is not None:  # one more row heads each segment; it sorts before the others
        empty = [F.lit(None).cast(src.schema[c].dataType).alias(c) for c in src.columns[4:]]
        head = standing_of_hot(rows, source, ts, rules, hot).select("source", "seg", F.lit(-(1 << 63)).alias("us"), F.lit(False).alias("core"), *empty, "whole")
        src = src.withColumn("whole", F.lit(None).cast(head.schema["whole"].dataType)).unionByName(head)
    n = len(fields)

    def group(key: str | None, tab: pa.Table) -> pa.RecordBatch | None:
        whole: dict[str, Standing] = {}
        if hot_names and key is not None and tab.column(2)[0].as_py() == -(1 << 63):
            for x in tab.column(tab.num_columns - 1)[0].as_py() or []:
                whole[x["field"]] = (x["steps"], *(np.array(x[c], dtype=np.int64) for c in ("lo", "hi", "n")))
            tab = tab.slice(1)
        if not tab.num_rows:
            return None
        t = tab.column(2).to_numpy() / 1e6
        values = [tab.column(5 + j).to_numpy().astype(float) for j in range(n)]
        return work(Group(key, t, tab.column(3).to_numpy().astype(bool), tab.column(4).combine_chunks(), values, tab.select(range(5 + n, 5 + n + len(carry))), whole))

    hot_names = hot is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []
        held = 0

        def timed() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for b in batches:
                gone = b.column(0).is_null()
                if b.column(0).null_count:
                    out = group(None, pa.Table.from_batches([b.filter(gone)]))
                    if out is not None:
                        ready.append(out)
                        held += out.num_rows
                    b = b.filter(b.column(0).is_valid())
                yield b

        for (key, _), tab in sorted_groups(timed(), 2):
            out = group(key, tab)
            if out is not None:
                ready.append(out)
                held += out.num_rows
            if held >= 20_000:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready, held = [], 0
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return src.repartition("source", "seg").sortWithinPartitions("source", "seg", "us").mapInArrow(run, schema)


_WORDS = np.array(["ok", *[STATUS[i] for i in range(1, 5)]], dtype=object)


def group_statuses(g: Group, rules: dict[str, Rule]) -> list[np.ndarray]:
    """Status codes of a group's rows, per field. Ties in time are ordered by value; repeats share their original's status."""
    out = []
    for v, (f, rule) in zip(g.values, rules.items()):
        if g.source is None:
            out.append(in_range(v, rule))
            continue
        order = np.lexsort((v, g.t))
        st = np.empty(v.size, dtype=np.int8)
        st[order] = assess_records(v[order], g.t[order], rule, g.whole.get(f))
        out.append(st)
    return out


def statuses(rows: DataFrame, row_key: str, source: str, ts: str, rules: dict[str, Rule], sizing: DataFrame, max_rows: int = 200_000, counts: DataFrame | None = None) -> DataFrame:
    """(row_key, field, value, status) of the records that aren't ordinary.

    rows: row_key BIGINT, source STRING, ts TIMESTAMP and a DOUBLE per field; ``sizing`` has the same sources and
    times before any costly step, ``counts`` the rows of each source, if at hand. Rows without source or time are only held against the possible range. Timelines of
    more than ``max_rows`` rows are cut. Other columns are dropped.
    """
    fields = list(rules)
    schema = T.StructType([T.StructField("row_key", T.LongType()), T.StructField("field", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("status", T.StringType())])

    def work(g: Group) -> pa.RecordBatch | None:
        keys, names, vals, stats = [], [], [], []
        for f, v, st in zip(fields, g.values, group_statuses(g, rules)):
            pick = np.flatnonzero(g.core & (st > MISSING))
            if pick.size:
                keys.append(g.rows.take(pa.array(pick)))
                names += [f] * pick.size
                vals.append(v[pick])
                stats.append(_WORDS[st[pick]])
        if not keys:
            return None
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(names, pa.string()), pa.array(np.concatenate(vals)), pa.array(np.concatenate(stats), pa.string())], names=schema.names)

    return by_source(rows, row_key, source, ts, rules, cuts(sizing, source, ts, max_rows, SEGMENT_S, counts=counts), work, schema)


def reading_anomalies(readings: DataFrame, names: NameRule, max_rows: int = 200_000) -> DataFrame:
    """Anomalies of smart_194 and smart_9 in JSON readings."""
    parsed = with_metrics(readings.select("id", "drive_id", reading_instant(F.col("reading_ts")).alias("ts"), "metrics_json"), ["id", "drive_id", "ts"], names, ["smart_194", "smart_9"])
    rows = parsed.where("smart_194 is not null or smart_9 is not null")
    return statuses(rows, "id", "drive_id", "ts", RULES, readings.select("drive_id", reading_instant(F.col("reading_ts")).alias("ts")), max_rows=max_rows)
