"""Missing cells filled from records of the same drive or bay (problem 1).

Functional dependencies are mined from complete records: each candidate's determinants are grouped and held against
the dependent field, with support and violations. The candidates, in order: (bay, interval) -> serial_number, where
an interval lies between two showings of the same serial number; (drive, date) -> value; (drive, interval) -> value,
where an interval lies between two days of the same value at most a week off. Only those that hold become
dictionaries that missing cells look their value up in, and groups that violate them give none. What no dictionary
gives falls back to the group: the bay's showings around the date, the drive's nearest plausible values within seven
days. Every filled cell carries its provenance. The serial dictionary has one row per bay and day; values are looked
up within the drive's sorted timeline, cut where it is long, so that no task holds more than a segment.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .anomaly import CONTEXT_S, MISSING, OK, RULES, SEGMENT_S, Group, Rule, by_source, group_statuses, statuses
from .timelines import cuts

# Spellings that stand for no text, and codes that stand for no number.
TEXT_FILLERS = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "unknown", "unk", "missing", "not available", "tbd")
NUMBER_FILLERS = (-1.0, 0.0, -9.0, -99.0, -999.0, -9999.0, 255.0, 999.0, 9999.0, 32767.0, 65535.0, 99999.0, 999999.0, 9999999.0, 2147483647.0, 4294967295.0)
# A value that recurs in places that have nothing to do with each other is a code: in this share of them, and in so many.
CODE_SHARE = 0.002
NUMBER_PLACES, TEXT_PLACES = 3, 8
_FIELDS = ("smart_9", "smart_187")


def text_or_null(c: Column) -> Column:
    """The trimmed text, null for fillers: the usual words, or nothing but zeros and punctuation."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*TEXT_FILLERS) & ~t.rlike(r"^[\W_0]*$"), t)


@dataclass(frozen=True)
class Codes:
    """Codes mined from a table: serial numbers that are none, and numbers outside their field's range, per field; ``drives``: (drive, n) as shown."""

    serials: tuple[str, ...]
    numbers: dict[str, tuple[float, ...]]
    drives: DataFrame


def mine_codes(train: DataFrame, ranges: dict[str, tuple[float, float]]) -> Codes:
    """What stands in place of a value by recurring: serial numbers across bays, and numbers out of range across drives; one pass.

    A code shows up in CODE_SHARE of all bays (drives), and in at least TEXT_PLACES (NUMBER_PLACES) of them: a drive
    sits in one place and seldom moves, and two drives seldom share a reading that no drive can have. The share also
    bounds what is collected.
    """
    ensure_checkpoint_dir(train.sparkSession)
    drive = text_or_null(F.col("serial_number"))
    e = lambda kind, text, number, place: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"), number.cast("double").alias("number"), place.cast("string").alias("place"))
    none = F.lit(None)
    each = [F.when(drive.isNotNull(), e("serial", drive, none, F.col("bay"))), F.when(drive.isNotNull() & F.col("bay").isNotNull(), e("bay", F.col("bay"), none, none))]
    each += [F.when(drive.isNotNull() & ~F.isnan(f) & ((F.col(f) < lo) | (F.col(f) > hi)), e(f, none, F.col(f), drive)) for f, (lo, hi) in ranges.items()]
    per_place = train.select(F.inline(F.array_compact(F.array(*each)))).groupBy("kind", "text", "number", "place").agg(F.count("*").alias("n"))
    seen = per_place.groupBy("kind", "text", "number").agg(F.sum("n").alias("n"), F.count("place").alias("places")).checkpoint()  # one row per drive, bay and odd number; read three times
    bays, drives = seen.agg(F.count_if(F.col("kind") == "bay"), F.count_if(F.col("kind") == "serial")).first()
    is_serial = F.col("kind") == "serial"
    least = F.when(is_serial, max(TEXT_PLACES, bays * CODE_SHARE)).otherwise(max(NUMBER_PLACES, drives * CODE_SHARE))
    found = seen.where((F.col("kind") != "bay") & (F.col("places") >= least)).select("kind", "text", "number").collect()
    return Codes(tuple(sorted(r["text"] for r in found if r["kind"] == "serial")), {f: tuple(sorted(r["number"] for r in found if r["kind"] == f)) for f in ranges}, seen.where(is_serial).select(F.col("text").alias("drive"), "n"))


HOLDS = 0.99  # share of the groups with one value from which on a dependency holds


def _verdict(groups: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """One row of mine_dependencies from (n, lo, hi) of each group."""
    one = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("support"), F.count_if(F.col("lo") != F.col("hi")).alias("violating_groups")).select(
        F.lit(determinant).alias("determinant"), F.lit(dependent).alias("dependent"), "groups", "support", "violating_groups", F.when(F.col("groups") > 0, 1 - F.col("violating_groups") / F.col("groups")).alias("confidence")
    )
    return one.withColumn("holds", F.coalesce(F.col("confidence") >= HOLDS, F.lit(False)))


def mine_dependencies(rows: DataFrame, candidates: list[tuple[tuple[str, ...], str]], least_support: int = 2) -> DataFrame:
    """(determinant, dependent, groups, support, violating_groups, confidence, holds) of each candidate, over complete records."""
    out = None
    for lhs, rhs in candidates:
        full = rows
        for c in (*lhs, rhs):
            full = full.where(F.col(c).isNotNull())
        groups = full.groupBy(*lhs).agg(F.count("*").alias("n"), F.min(rhs).alias("lo"), F.max(rhs).alias("hi")).where(F.col("n") >= least_support)
        one = _verdict(groups, ",".join(lhs), rhs)
        out = one if out is None else out.unionByName(one)
    return out


def _before_and_after(key: str) -> list:
    """Windows of a key's earlier dates in order, and of its later dates in reverse: the last of either is the nearest, and both only grow."""
    return [Window.partitionBy(key).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("date"), F.desc("date"))]


def _bay_days(clean: DataFrame) -> DataFrame:
    """(bay, date, open, lo, hi, serial_by_bay) where the nearest earlier and later dates that show a serial number show the same one."""
    days = clean.where(F.col("bay").isNotNull() & F.col("date").isNotNull()).groupBy("bay", "date").agg(F.min("serial").alias("lo"), F.max("serial").alias("hi"), F.count("serial").alias("n"), F.count_if(F.col("serial").isNull()).alias("open"))
    shown = F.when(F.col("lo").isNotNull(), F.struct("lo", "hi"))
    near = days.select("*", *[F.last(shown, True).over(w).alias(c) for c, w in zip("ab", _before_and_after("bay"))])
    one = (F.col("a.lo") == F.col("a.hi")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.lo") == F.col("b.hi"))
    return near.where(one).select("bay", "date", "n", "open", "lo", "hi", F.col("a.lo").alias("serial_by_bay"))


def mine_intervals(clean: DataFrame) -> DataFrame:
    """mine_dependencies' row for (bay, interval) -> serial."""
    return _intervals_verdict(_bay_days(clean))


def _intervals_verdict(bay_days: DataFrame) -> DataFrame:
    """Each showing held against its neighbours: does a date between two showings of one serial number show it too?"""
    seen = bay_days.where("n > 0")
    return _verdict(seen.select("n", F.least("lo", "serial_by_bay").alias("lo"), F.greatest("hi", "serial_by_bay").alias("hi")), "bay,interval", "serial")


def serial_dictionary(bay_days: DataFrame) -> DataFrame:
    """(bay, date) -> serial_number where the nearest earlier and later dates that show one show the same one; ``serial_holds``: no other on the date itself."""
    holds = (F.col("n") == 0) | ((F.col("lo") == F.col("serial_by_bay")) & (F.col("hi") == F.col("serial_by_bay")))
    return bay_days.where("open > 0").select("bay", "date", "serial_by_bay", holds.alias("serial_holds"))


def with_serial(train: DataFrame, serials: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``serial``: the serial number as shown, fillers and codes as null; ``serials``: the mined codes, if at hand."""
    serials = mine_codes(train, {}).serials if serials is None else serials
    t = text_or_null(F.col("serial_number"))
    return train.withColumn("serial", F.when(~t.isin(*serials), t) if serials else t)


def _by_bay(clean: DataFrame, bay_days: DataFrame) -> DataFrame:
    """Adds ``serial_by_bay`` (filled), ``serial_holds`` and ``drive`` (shown or filled)."""
    dictionary = serial_dictionary(bay_days)
    shown = clean.where(F.col("serial").isNotNull()).withColumn("serial_by_bay", F.lit(None).cast("string")).withColumn("serial_holds", F.lit(None).cast("boolean"))
    lost = clean.where(F.col("serial").isNull()).join(dictionary, ["bay", "date"], "left")
    return shown.unionByName(lost).withColumn("drive", F.coalesce("serial", "serial_by_bay"))


def with_drive(train: DataFrame, serials: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``serial`` (fillers as null), ``serial_by_bay`` (filled) and ``drive`` (shown or filled)."""
    clean = with_serial(train, serials)
    return _by_bay(clean, _bay_days(clean.select("bay", "date", "serial"))).drop("serial_holds")


def shown_serials(train: DataFrame) -> DataFrame:
    """The daily rows' drive as shown, before any filling: what timelines are sized by."""
    return train.select(text_or_null(F.col("serial_number")).alias("drive"), F.col("date").cast("timestamp").alias("ts"))


def hours_rule(mined: tuple[float, ...]) -> Rule:
    """The rule of smart_9 with its filler codes: the conventional ones and those that recur across drives."""
    return replace(RULES["smart_9"], fillers=tuple(sorted({*NUMBER_FILLERS, *mined})))


HOURS_RANGE = (RULES["smart_9"].low, RULES["smart_9"].high)
ERRORS_RANGE = (0.0, 1000.0)


def train_anomalies(train: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Anomalies of smart_194 and smart_9 in daily rows (see anomaly.statuses), with filled serial numbers; fillers aren't anomalies."""
    codes = mine_codes(train, {"smart_9": HOURS_RANGE})
    rows = with_drive(train.select("row_id", "serial_number", "bay", "date", "smart_194", "smart_9"), codes.serials).select("row_id", "drive", F.col("date").cast("timestamp").alias("ts"), F.col("smart_194").cast("double").alias("smart_194"), F.col("smart_9").cast("double").alias("smart_9"))
    return statuses(rows, "row_id", "drive", "ts", {"smart_194": RULES["smart_194"], "smart_9": hours_rule(codes.numbers["smart_9"])}, shown_serials(train), max_rows=max_rows, counts=codes.drives)


def errors_value(mined: tuple[float, ...]) -> Column:
    """smart_187 with missing ones as null: not a number, negative, or a code of at least 255 that recurs or is conventional."""
    v = F.col("smart_187").cast("double")
    return F.when(~F.isnan(v) & (v >= 0) & ~v.isin(*sorted({c for c in NUMBER_FILLERS if c >= 255} | set(mined))), v)


def _days_of(clean: DataFrame, codes: Codes) -> DataFrame:
    """Per shown drive and day, of each field's plausible values the number (n_), least (lo_) and largest (hi_)."""
    hours = F.col("smart_9").cast("double")
    complete = {"smart_9": F.when(hours.between(*HOURS_RANGE) & ~hours.isin(*hours_rule(codes.numbers["smart_9"]).fillers), hours), "smart_187": errors_value(codes.numbers["smart_187"])}
    known = clean.where("serial is not null and date is not null").select("serial", "date", *[v.alias(f"_{f}") for f, v in complete.items()])
    return known.groupBy("serial", "date").agg(*[a(f"_{f}").alias(f"{n}_{f}") for f in complete for n, a in (("n", F.count), ("lo", F.min), ("hi", F.max))])


def fill_dependencies(bay_days: DataFrame, clean: DataFrame, codes: Codes, days: int = 7) -> DataFrame:
    """mine_dependencies' rows of the candidates that fill_cells fills from, over complete records.

    (drive, date): do a drive's records of one day show one value? (drive, interval): does a day between two days of
    one value, each at most ``days`` off, show it too? A candidate without any group has nothing to hold by.
    """
    per_day = _days_of(clean, codes)
    before, after = _before_and_after("serial")
    plain = []
    for f in _FIELDS:
        shown = F.when(F.col(f"n_{f}") > 0, F.struct(F.col("date").alias("at"), F.col(f"lo_{f}").alias("lo"), F.col(f"hi_{f}").alias("hi")))
        plain += [(f"a_{f}", F.last(shown, True).over(before)), (f"b_{f}", F.last(shown, True).over(after))]
    near = per_day.select("*", *[c.alias(n) for n, c in plain])
    cells = []
    for f in _FIELDS:
        n, lo, hi, a, b = (F.col(f"{c}_{f}") for c in ("n", "lo", "hi", "a", "b"))
        one = (a["lo"] == a["hi"]) & (b["lo"] == b["hi"]) & (a["lo"] == b["lo"]) & (F.datediff("date", a["at"]) <= days) & (F.datediff(b["at"], "date") <= days)
        cells.append(F.when(n >= 2, F.struct(F.lit("drive,date").alias("determinant"), F.lit(f).alias("dependent"), n.alias("n"), (lo != hi).alias("bad"))))
        cells.append(F.when((n >= 1) & one, F.struct(F.lit("drive,interval").alias("determinant"), F.lit(f).alias("dependent"), n.alias("n"), ((lo != a["lo"]) | (hi != a["lo"])).alias("bad"))))
    seen = near.select(F.inline(F.array_compact(F.array(*cells))))
    each = seen.groupBy("determinant", "dependent").agg(F.count("*").alias("groups"), F.sum("n").alias("support"), F.count_if("bad").alias("violating_groups"))
    each = each.select("*", (1 - F.col("violating_groups") / F.col("groups")).alias("confidence")).withColumn("holds", F.col("confidence") >= HOLDS)
    return _intervals_verdict(bay_days).unionByName(each)


def fill_values(day: np.ndarray, shown: np.ndarray, donor: np.ndarray, days: int, by_date: bool, by_interval: bool) -> tuple[np.ndarray, np.ndarray]:
    """(value, provenance) of each record of a drive in order of its day: shown, looked up, from its group, or none (NaN).

    ``by_date``, ``by_interval``: whether these dependencies hold. The group's value is the middle of the day's own
    values, else between the nearest donors on either side by time, else the one within reach; counters are whole.
    """
    value, said = shown.copy(), np.where(np.isnan(shown), None, "shown").astype(object)
    open_ = np.flatnonzero(np.isnan(shown))
    if not open_.size or not donor.any():
        return value, said
    dates, at = np.unique(day[donor], return_inverse=True)
    lo, hi = np.full(dates.size, np.inf), np.full(dates.size, -np.inf)
    np.minimum.at(lo, at, shown[donor])
    np.maximum.at(hi, at, shown[donor])
    mid = (lo + hi) / 2
    left = np.searchsorted(dates, day[open_], side="left")
    own = (left < dates.size) & (dates[np.minimum(left, dates.size - 1)] == day[open_])
    right = left + own
    for i, k, b, has in zip(open_.tolist(), (left - 1).tolist(), right.tolist(), own.tolist()):
        if has:
            j = k + 1
            value[i], said[i] = (hi[j], "fd:drive,date") if by_date and lo[j] == hi[j] else (_whole(mid[j]), f"group:drive,{days}d")
            continue
        a_ok, b_ok = k >= 0 and day[i] - dates[k] <= days, b < dates.size and dates[b] - day[i] <= days
        if a_ok and b_ok:
            if by_interval and lo[k] == hi[k] == lo[b] == hi[b]:
                value[i], said[i] = hi[k], "fd:drive,interval"
                continue
            got = mid[k] + (mid[b] - mid[k]) * (day[i] - dates[k]) / (dates[b] - dates[k])
        elif a_ok or b_ok:
            got = mid[k] if a_ok else mid[b]
        else:
            continue
        value[i], said[i] = _whole(got), f"group:drive,{days}d"
    return value, said


def _whole(x: float) -> float:
    return float(np.copysign(np.floor(abs(x) + 0.5), x))


def fill_cells(train: DataFrame, days: int = 7, max_rows: int = 200_000) -> DataFrame:
    """All rows: row_id, date, and per field the value after filling, ``_filled`` and ``_provenance``.

    Null dates or bays leave serial numbers unfilled; a row without drive keeps its other cells. Repeated rows each
    get their own filled cell. Provenance: ``shown``, ``fd:bay,interval``, ``fd:drive,date`` (another record of the
    day), ``fd:drive,interval`` (between two equal values), ``group:bay`` and ``group:drive,7d`` (nearest plausible
    values around that date), or null where nothing fills the cell. ``fd`` needs a dependency that holds on the
    complete records, and a group that doesn't violate it: the showings of the bay's date, the values of the drive's
    day.
    """
    codes = mine_codes(train, {"smart_9": HOURS_RANGE, "smart_187": ERRORS_RANGE})
    clean = with_serial(train.select("row_id", "serial_number", "bay", "date", *_FIELDS), codes.serials)
    ensure_checkpoint_dir(train.sparkSession)
    bay_days = _bay_days(clean.select("bay", "date", "serial")).checkpoint()  # read by the verdict and the dictionary
    held = {(r["determinant"], r["dependent"]) for r in fill_dependencies(bay_days, clean, codes, days).collect() if r["holds"]}
    rules = {"smart_9": hours_rule(codes.numbers["smart_9"]), "smart_187": Rule(0.0, float("inf"), False, 0.0)}
    timed = _by_bay(clean, bay_days).select("row_id", "serial", "serial_by_bay", "serial_holds", "drive", "date", F.col("date").cast("timestamp").alias("ts"), F.col("smart_9").cast("double").alias("smart_9"), errors_value(codes.numbers["smart_187"]).alias("smart_187"))
    carry = ("date", "drive", "serial", "serial_by_bay", "serial_holds")
    schema = T.StructType(
        [T.StructField("row_id", T.LongType())] + [T.StructField(c, timed.schema[c].dataType) for c in carry] + [T.StructField(f"{f}{e}", t) for f in _FIELDS for e, t in (("", T.DoubleType()), ("_provenance", T.StringType()))]
    )
    fixed = {f: (("drive,date", f) in held, ("drive,interval", f) in held) for f in _FIELDS}

    def work(g: Group) -> pa.RecordBatch | None:
        status = group_statuses(Group(g.source, g.t, g.core, g.rows, g.values[:1], g.carried, g.whole), {"smart_9": rules["smart_9"]})[0]
        day = np.floor(np.nan_to_num(g.t) / 86400).astype(np.int64)
        hours, errors = np.where(status == MISSING, np.nan, g.values[0]), g.values[1]
        pick = pa.array(g.core)
        out = [g.rows.filter(pick), *[c.combine_chunks() for c in g.carried.filter(pick).columns]]
        for f, shown, donor in (("smart_9", hours, status == OK), ("smart_187", errors, ~np.isnan(errors))):
            if g.source is None:
                value, said = shown, np.where(np.isnan(shown), None, "shown").astype(object)
            else:
                value, said = fill_values(day, shown, donor, days, *fixed[f])
            value, said = value[g.core], said[g.core]
            out += [pa.array(value, mask=np.isnan(value)), pa.array(said, pa.string())]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks == 1 else c for c in out], names=schema.names)

    reach = days * 86400 + CONTEXT_S
    done = by_source(timed, "row_id", "drive", "ts", rules, cuts(shown_serials(train), "drive", "ts", max_rows, max(SEGMENT_S, 2 * reach), counts=codes.drives), work, schema, carry, reach)
    by_bay = ("bay,interval", "serial") in held
    cols = [F.col("row_id"), F.col("date"), F.col("drive").alias("serial_number"), F.col("serial_by_bay").isNotNull().alias("serial_number_filled"), F.when(F.col("serial").isNotNull(), "shown").when(F.col("serial_holds") & F.lit(by_bay), "fd:bay,interval").when(F.col("serial_by_bay").isNotNull(), "group:bay").alias("serial_number_provenance")]
    for f in _FIELDS:
        said = F.col(f"{f}_provenance")
        cols += [F.col(f), (said.isNotNull() & (said != "shown")).alias(f"{f}_filled"), said]
    return done.select(*cols)


def filled_cells(train: DataFrame, days: int = 7) -> DataFrame:
    """(row_id, field, value, provenance) of each filled cell, values as text."""
    done = fill_cells(train, days)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.col(f"{f}_provenance").alias("provenance"), F.col(f"{f}_filled").alias("filled")) for f in ("smart_9", "smart_187", "serial_number")])
    return done.select("row_id", F.inline(each)).where("filled").drop("filled")
