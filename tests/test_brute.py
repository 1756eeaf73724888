"""p1_found and p2_found against plain re-statements of their definitions, in pandas, row by row."""

import json
import re

import numpy as np
import pandas as pd
import pytest

from tagloom.plans import problems

SF = "/root/testdata/sf0.01"
FILLER = {"", "-", "n/a", "unknown", "none", "nan", "null"}


def runs(flags):
    """[start, end] of the runs of true."""
    out, s = [], None
    for i, f in enumerate([*flags, False]):
        if f and s is None:
            s = i
        elif not f and s is not None:
            out.append((s, i - 1))
            s = None
    return out


def series_cases(t, v, counter):
    """Cases (a) to (c) of one drive's distinct records in order of time, by the statement; t in hours."""
    bad = (v < 0) | (v > 300_000) if counter else (v < -40) | (v > 125)
    idx = np.flatnonzero(~bad)
    cases = set(np.flatnonzero(bad).tolist())
    t, v = t[idx], v[idx]
    n = v.size
    stuck = np.zeros(n, bool)
    s = 0
    found = []
    for i in range(1, n + 1):
        if i == n or v[i] != v[s]:
            if i - s >= 8 and t[i - 1] - t[s] >= 36:
                found.append((s, i - 1))
            s = i
    slots = {}
    for i in range(n):
        slots.setdefault(int(t[i] // 6), (v[i], i))
    seq = [slots[k] for k in sorted(slots)]
    for s, e in found:
        rest = [(a[0] == b[0]) for a, b in zip(seq, seq[1:]) if b[1] < s or a[1] > e]
        if len(rest) >= 3 and np.mean(rest) < 0.5:
            stuck[s + 1 : e + 1] = True
    free = np.flatnonzero(~stuck)
    x, h = v[free], t[free]
    if counter and x.size > 3:
        j = np.searchsorted(h, h + 72)
        i = np.flatnonzero(j < h.size)
        pace = np.median((x[j[i]] - x[i]) / (h[j[i]] - h[i])) if i.size >= 3 else np.median(np.diff(x)[np.diff(h) > 0] / np.diff(h)[np.diff(h) > 0])
        x = x - pace * h
    # what is off the middle of twelve records around it, in runs of at most three that come back
    mid = np.array([np.median(x[max(0, k - 6) : k + 7]) for k in range(x.size)])
    off = np.abs(x - mid)
    least = 200.0 if counter else 6.0
    sd = 0.0 if counter else float((x - mid)[off < least].std()) if (off < least).any() else 0.0
    hit = off > max(least, 5 * sd) if counter else (off >= least) & (off > 5 * sd)
    for a, b in runs(hit):
        if b - a < 3 and a > 0 and b < x.size - 1:
            cases |= {int(idx[free[k]]) for k in range(a, b + 1)}
    return cases | set(idx[stuck].tolist())


def number(o):
    if isinstance(o, dict):
        o = o.get("raw", o.get("v"))
    if isinstance(o, str):
        if o.lower().startswith("0x"):
            return float(int(o, 16))
        m = re.match(r"(?:n=)?\s*([+-]?[\d.]+)", o)
        return float(m[1]) if m else np.nan
    return np.nan if o is None else float(o)


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def train():
    d = read("train")
    s = d["serial_number"].map(lambda x: None if x is None or x.strip().lower() in FILLER or set(x.strip()) <= {"0"} else x.strip())
    d["shown"] = s.astype(object).where(s.notna(), None)
    by_bay = d[d["shown"].notna()].groupby(["bay", "date"])["shown"].agg(lambda x: sorted(set(x))).reset_index()
    table = {b: g.sort_values("date") for b, g in by_bay.groupby("bay")}
    filled = []
    for bay, date, shown in zip(d["bay"], d["date"], d["shown"]):
        got = None
        if shown is None and bay in table:
            g = table[bay]
            a, b = g[g["date"] < date]["shown"].tolist(), g[g["date"] > date]["shown"].tolist()
            if a and b and len(a[-1]) == len(b[0]) == 1 and a[-1] == b[0]:
                got = a[-1][0]
        filled.append(got)
    d["filled"] = filled
    d["drive"] = [a or b for a, b in zip(d["shown"], d["filled"])]
    d["hours"] = pd.to_datetime(d["date"]).astype("datetime64[s]").astype("int64") / 3600
    return d


def hours_of(d):
    """smart_9 with codes as missing."""
    return d["smart_9"].where(~d["smart_9"].isin([-1.0, 0.0, 999999.0])).astype(float)


def cases_of(d, value, counter):
    out = set()
    for _, g in d.assign(x=value)[value.notna() & d["drive"].notna()].groupby("drive"):
        u = g.drop_duplicates(["hours", "x"]).sort_values(["hours", "x"])
        hit = u.iloc[sorted(series_cases(u["hours"].to_numpy(), u["x"].to_numpy(), counter))]
        keys = set(zip(hit["hours"], hit["x"]))
        out |= {r for r, h, x in zip(g["row_id"], g["hours"], g["x"]) if (h, x) in keys}
    return out


def test_filled_cells(spark, train):
    d = train
    want = {(r, "serial_number") for r, f in zip(d["row_id"], d["filled"]) if f}
    nine, odd = hours_of(d), cases_of(d, hours_of(d), True)
    nine_ok = nine.where(~d["row_id"].isin(odd))
    errors = d["smart_187"].where(~d["smart_187"].isin([-1.0, 65535.0])).astype(float)
    for field, value, donor in (("smart_9", nine, nine_ok), ("smart_187", errors, errors)):
        have = d[donor.notna() & d["drive"].notna()]
        days = {k: np.sort(g.unique()) for k, g in have.groupby("drive")["hours"]}
        for r, drive, h in d[value.isna() & d["drive"].notna()][["row_id", "drive", "hours"]].itertuples(index=False):
            if drive in days and np.abs(days[drive] - h).min() <= 7 * 24:
                want.add((r, field))
    got = {(x.row_id, x.field) for x in problems.p1_found(spark, SF).collect()}
    print(len(got), len(want), sorted(got - want)[:10], sorted(want - got)[:10])
    assert got == want and len(want) > 300


def test_implausible_values(spark, train):
    got = {(x.table_name, x.row_key, x.field) for x in problems.p2_found(spark, SF).collect()}
    want = {("train", r, f) for f, value, counter in (("smart_194", train["smart_194"].astype(float), False), ("smart_9", hours_of(train), True)) for r in cases_of(train, value, counter)}
    r = read("drive_readings")
    t = spark.read.parquet(f"{SF}/drive_readings.parquet")
    from tagloom.functions.readings import reading_instant
    from pyspark.sql import functions as F

    at = dict(t.select("id", F.unix_micros(reading_instant(F.col("reading_ts")))).collect())
    names = {"smart_194": re.compile(r"(?i)(?:smart|attr|r)[_.]?0*194(?:[_.]raw)?|drive.?temperature"), "smart_9": re.compile(r"(?i)(?:smart|attr|r)[_.]?0*9(?:[_.]raw)?|power.?on.?hours")}
    rows = []
    for i, drive, m in r[["id", "drive_id", "metrics_json"]].itertuples(index=False):
        try:
            o = json.loads(m)
        except (TypeError, ValueError):
            continue
        rows.append((i, drive, np.nan if at[i] is None else at[i] / 3.6e9, *(next((number(v) for k, v in o.items() if p.fullmatch(k)), np.nan) for p in names.values())))
    d = pd.DataFrame(rows, columns=["row_id", "drive", "hours", *names])
    timed = d[d["hours"].notna()]
    for f in names:
        want |= {("drive_readings", x, f) for x in cases_of(timed, timed[f], f == "smart_9")}
        alone = d[d["hours"].isna()]
        lo, hi = (0, 300_000) if f == "smart_9" else (-40, 125)
        want |= {("drive_readings", x, f) for x in alone[(alone[f] < lo) | (alone[f] > hi)]["row_id"]}
    assert len(want) > 100
    print(len(got), len(want), sorted(got - want)[:10], sorted(want - got)[:10])
    assert got == want
