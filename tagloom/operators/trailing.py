"""Rolling totals over trailing periods of days (problem 3).

Readings are reduced to one row per drive and day before any row reaches Python, so a drive with a third of all
rows is spread over its days, and a drive's timeline is at most as long as its days. The windows are kept by a
two-stack monoid queue: it needs only an associative combine, so minimum and maximum work as well as sums.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.groups import sorted_groups
from ..functions.readings import NameRule, reading_instant, with_metrics

EPOCH = dt.date(1970, 1, 1)


class TwoStackQueue:
    """First-in first-out aggregate of any monoid; push and pop cost amortised constant time."""

    def __init__(self, combine, empty):
        self.combine, self.empty = combine, empty
        self.back: list = []  # raw elements, newest last
        self.back_total = empty
        self.front: list = []  # running totals; the oldest element's is on top

    def push(self, x) -> None:
        self.back.append(x)
        self.back_total = self.combine(self.back_total, x)

    def pop(self) -> None:
        if not self.front:
            total = self.empty
            while self.back:
                total = self.combine(self.back.pop(), total)
                self.front.append(total)
            self.back_total = self.empty
        self.front.pop()

    def total(self):
        return self.combine(self.front[-1], self.back_total) if self.front else self.back_total

    def __len__(self) -> int:
        return len(self.front) + len(self.back)


class DayMonoid:
    """Vectors of one day or a span of days: counts and sums added, minima and maxima kept."""

    def __init__(self, n_fields: int):
        self.adds = 1 + 2 * n_fields
        self.n = n_fields
        self.empty = np.concatenate([np.zeros(self.adds), np.full(n_fields, np.inf), np.full(n_fields, -np.inf)])

    def combine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k, n = self.adds, self.n
        out = a + b
        out[k : k + n] = np.minimum(a[k : k + n], b[k : k + n])
        out[k + n :] = np.maximum(a[k + n :], b[k + n :])
        return out


def daily_partials(distinct: DataFrame, key: str, day: str, fields: list[str]) -> DataFrame:
    """Per key and day: number of readings, and per field count, sum, minimum and maximum."""
    return distinct.groupBy(key, day).agg(
        F.count("*").alias("n"),
        *[F.count(f).alias(f"c_{f}") for f in fields],
        *[F.sum(f).alias(f"s_{f}") for f in fields],
        *[F.min(f).alias(f"lo_{f}") for f in fields],
        *[F.max(f).alias(f"hi_{f}") for f in fields],
    )


def rolling_days(daily: DataFrame, key: str, fields: list[str], periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row per key, day between its first and last, and period, from the rows of :func:`daily_partials`.

    Days without rows count as empty. ``complete`` tells whether the whole period lies within the key's days.
    Averages, minima and maxima of a field without values are null; totals are 0.
    """
    schema = T.StructType(
        [T.StructField(key, daily.schema[key].dataType), T.StructField("day", T.DateType()), T.StructField("period_days", T.LongType()), T.StructField("n_readings", T.LongType()), T.StructField("complete", T.BooleanType())]
        + [T.StructField(f"{p}_{f}", T.LongType() if p == "count" else T.DoubleType()) for f in fields for p in ("count", "total", "avg", "min", "max")]
    )
    names = [f.name for f in schema]
    m = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mono = DayMonoid(m)
        k_out: list = []
        d_out: list[int] = []
        p_out: list[int] = []
        ok_out: list[bool] = []
        rows: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            x = np.array(rows)
            count, total = x[:, 1 : 1 + m], x[:, 1 + m : 1 + 2 * m]
            lo, hi = x[:, 1 + 2 * m : 1 + 3 * m], x[:, 1 + 3 * m :]
            cols = [pa.array(k_out, type=key_type), pa.array(np.array(d_out, dtype=np.int32)).cast(pa.date32()), pa.array(np.array(p_out, dtype=np.int64)), pa.array(x[:, 0].astype(np.int64)), pa.array(np.array(ok_out))]
            for j in range(m):
                none = count[:, j] == 0
                with np.errstate(invalid="ignore", divide="ignore"):
                    avg = total[:, j] / count[:, j]
                cols += [pa.array(count[:, j].astype(np.int64)), pa.array(total[:, j]), pa.array(avg, mask=none), pa.array(lo[:, j], mask=none), pa.array(hi[:, j], mask=none)]
            for held in (k_out, d_out, p_out, ok_out, rows):
                held.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for (k,), t in sorted_groups(batches, 1):
            key_type = t.schema.field(0).type
            days = np.array(t.column(1).cast(pa.int32()).to_pylist())
            body = [t.column(i).to_numpy().astype(float) for i in range(2, t.num_columns)]
            x = np.column_stack(body)
            x[:, : 1 + 2 * m] = np.nan_to_num(x[:, : 1 + 2 * m])
            lo, hi = x[:, 1 + 2 * m : 1 + 3 * m], x[:, 1 + 3 * m :]
            lo[np.isnan(lo)], hi[np.isnan(hi)] = np.inf, -np.inf
            queues = {p: TwoStackQueue(mono.combine, mono.empty) for p in periods}
            i = 0
            for day in range(int(days[0]), int(days[-1]) + 1):
                today = mono.empty
                if days[i] == day:
                    today, i = x[i], i + 1
                for p, q in queues.items():
                    q.push(today)
                    if len(q) > p:
                        q.pop()
                    k_out.append(k)
                    d_out.append(day)
                    p_out.append(p)
                    ok_out.append(len(q) == p)
                    rows.append(q.total())
                if len(rows) >= 8192:
                    yield emit()
        if rows:
            yield emit()

    order = [key, "day", "n", *[f"{a}_{f}" for a in ("c", "s", "lo", "hi") for f in fields]]
    src = daily.where(F.col(key).isNotNull() & F.col("day").isNotNull()).select(*order)
    return src.repartition(key).sortWithinPartitions(key, "day").mapInArrow(run, schema)


def distinct_readings(readings: DataFrame, rule: NameRule, fields: list[str], bucket: str, bucket_expr) -> DataFrame:
    """One row per drive and instant with its metrics; rows without a readable time or drive are left out.

    Repeated readings of one instant become one, with each field from any of them that shows it. The single
    exchange is by drive and ``bucket`` (a span of time), so a drive's rows are spread over its buckets.
    """
    timed = readings.where("drive_id is not null").select("drive_id", reading_instant(F.col("reading_ts")).alias("ts"), "metrics_json")
    timed = with_metrics(timed, ["drive_id", "ts"], rule, fields).where("ts is not null").select("drive_id", "ts", *fields)  # the instant is worked out once
    spread = timed.withColumn(bucket, bucket_expr(F.col("ts"))).repartition("drive_id", bucket)
    return spread.groupBy("drive_id", bucket, "ts").agg(*[F.max(f).alias(f) for f in fields])


def rolling_readings(readings: DataFrame, rule: NameRule, fields: list[str] | None = None, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trailing totals of every drive and UTC day; an empty table gives no rows, null drives and times are left out."""
    fields = fields or rule.fields
    distinct = distinct_readings(readings, rule, fields, "day", lambda ts: F.to_date(F.to_utc_timestamp(ts, F.current_timezone())))
    return rolling_days(daily_partials(distinct, "drive_id", "day", fields), "drive_id", fields, periods)
