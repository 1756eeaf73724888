import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions.readings import NameRule, reading_instant
from tagloom.operators.trailing import TwoStackQueue, daily_partials, rolling_days, rolling_readings

RULE = NameRule([("smart_9", "Power On Hours"), ("smart_194", "Drive Temperature")])
SCHEMA = "id bigint, drive_id string, reading_ts string, metrics_json string"


@given(st.lists(st.one_of(st.integers(-50, 50), st.none()), max_size=60))
@settings(max_examples=80, deadline=None)
def test_queue_holds_any_monoid(ops):
    """None pops; the total is the maximum and the concatenation of what is in the queue."""
    q, plain = TwoStackQueue(lambda a, b: (max(a[0], b[0]), a[1] + b[1]), (-99, ())), []
    for x in ops:
        if x is None:
            if plain:
                plain.pop(0)
                q.pop()
        else:
            plain.append(x)
            q.push((x, (x,)))
        assert q.total() == (max(plain, default=-99), tuple(plain)) and len(q) == len(plain)


def test_instants(spark):
    cases = {
        "2024-05-01T00:04:19.102100": 1714521859102100, "2024-05-01 00:04:19Z": 1714521859000000, "2024/05/01 00:04:19": 1714521859000000, "20240501T000419Z": 1714521859000000, "2024-05-01T02:04:19+02:00": 1714521859000000,
        "2024-04-30T21:04:19-03:00": 1714521859000000, "1714521859": 1714521859000000, "": None, "pending": None, "clock not set": None, "0000-00-00T00:00:00": None, "2024-13-01T00:00:00": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", F.unix_micros(reading_instant(F.col("t"))).alias("us")).collect()
    assert {r.t: r.us for r in rows} == {**cases, None: None}


def test_rolling_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in ("a", "b", None):
        for _ in range(60):
            d = dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 40)))
            rows.append((k, d, float(rng.normal()) if rng.random() < 0.8 else None, "x"))
    df = spark.createDataFrame(rows, "k string, day date, v double, n string")
    got = {(r.k, r.day, r.period_days): r for r in rolling_days(daily_partials(df, "k", "day", ["v"]), "k", ["v"], (3, 10)).collect()}
    for k in ("a", "b"):
        own = [(d, v) for kk, d, v, _ in rows if kk == k]
        lo, hi = min(d for d, _ in own), max(d for d, _ in own)
        for i in range((hi - lo).days + 1):
            day = lo + dt.timedelta(days=i)
            for p in (3, 10):
                r = got.pop((k, day, p))
                part = [v for d, v in own if 0 <= (day - d).days < p]
                vals = [v for v in part if v is not None]
                assert r.n_readings == len(part) and r.count_v == len(vals) and r.complete == (i + 1 >= p)
                assert abs(r.total_v - sum(vals)) < 1e-9
                assert (r.avg_v is None) == (not vals) and (not vals or abs(r.avg_v - np.mean(vals)) < 1e-9)
                assert (r.min_v, r.max_v) == ((min(vals), max(vals)) if vals else (None, None))
    assert not got


def test_repeats_cut_json_and_nulls(spark):
    rows = [
        (1, "d", "2024-05-01T01:00:00", '{"smart_9": 5, "Drive Temperature": "30.5 C"}'), (2, "d", "1714525200", '{"r_9": {"raw": 5, "norm": 1}}'), (3, "d", "2024-05-03T00:00:00Z", '{"smart_9": 7, "sm'),
        (4, "d", "pending", "{}"), (5, None, "2024-05-01T01:00:00", "{}"), (6, "d", None, None), (7, "e", "2024-05-02T00:00:00", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.lit("clash")).withColumn("ts", F.lit(1)).withColumn("n", F.lit(1))
    got = {(r.drive_id, str(r.day)): r for r in rolling_readings(df, RULE, periods=(7,)).collect()}
    assert sorted(got) == [("d", "2024-05-01"), ("d", "2024-05-02"), ("d", "2024-05-03"), ("e", "2024-05-02")]
    last = got["d", "2024-05-03"]
    assert last.n_readings == 2 and last.total_smart_9 == 5 and last.avg_smart_194 == 30.5
    assert got["e", "2024-05-02"].n_readings == 1 and got["e", "2024-05-02"].avg_smart_9 is None


def test_empty_table(spark):
    assert rolling_readings(spark.createDataFrame([], SCHEMA), RULE).count() == 0
