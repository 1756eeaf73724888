"""Parsing of drive readings: instants, JSON metrics, canonical attribute names and number forms."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

NUMBERED = re.compile(r"^(?:smart|attr|attribute|r|id)[ _.\-]*0*(\d{1,3})(?:[ _.\-]*(?:raw|value))?$", re.I)
_LEADING_NUMBER = re.compile(r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)")


def reading_instant(text: Column) -> Column:
    """Instant of a reading; null where the text is no time.

    Calendar forms with ``-`` or ``/`` between the date's parts, ``T`` or a blank before the time, the compact
    ``yyyyMMddTHHmmss``, an optional zone (none means UTC), or seconds since 1970.
    """
    t = F.trim(text)
    compact = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    iso = F.regexp_replace(compact, "/", "-")
    zoned = F.when(iso.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2}|UTC|GMT)$") & iso.contains(":"), iso).otherwise(F.concat(iso, F.lit("Z")))
    epoch = F.when(t.rlike(r"^\d{9,11}(?:\.\d+)?$"), t.cast("decimal(20,6)"))
    calendar = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), zoned).cast("string").try_cast("timestamp")
    return F.coalesce(F.timestamp_micros((epoch * F.lit(1000000)).cast("bigint")), calendar)


def label_key(name: str) -> str:
    """Letters and digits of a name in lower case: ``Drive Temperature``, ``driveTemperature`` -> ``drivetemperature``."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


class NameRule:
    """Canonical field of a key by its number or its label; ``None`` where neither is known."""

    def __init__(self, attributes: list[tuple[str, str]]):
        self.fields = [f for f, _ in attributes]
        self.by_label = {label_key(label): f for f, label in attributes if label}
        self.known = set(self.fields)

    def names(self) -> dict[str, list[str]]:
        """The names each field goes by: its own and its label."""
        labels = {f: k for k, f in self.by_label.items()}
        return {f: [f, *([labels[f]] if f in labels else [])] for f in self.fields}

    def __call__(self, name: str) -> str | None:
        m = NUMBERED.match(name.strip())
        if m:
            f = f"smart_{int(m[1])}"
            return f if f in self.known else None
        return self.by_label.get(re.sub(r"raw$", "", label_key(name))) or self.by_label.get(label_key(name))


def name_rule(smart_attributes: DataFrame) -> NameRule:
    """Rule from the attribute dictionary, a fixed table of some twenty rows."""
    rows = smart_attributes.select("field", "label").orderBy("attr_no").collect()
    return NameRule([(r["field"], r["label"]) for r in rows])


def number_of(v) -> float:
    """Number in any of the forms that occur: plain, text, hexadecimal, with a unit, or an object with raw or v."""
    if isinstance(v, dict):
        v = v.get("raw", v.get("v", v.get("value")))
    if isinstance(v, bool) or v is None:
        return np.nan
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, str):
        s = v.strip()
        if s[:2].lower() == "0x":
            try:
                return float(int(s, 16))
            except ValueError:
                return np.nan
        if s.startswith("n="):
            s = s[2:]
        m = _LEADING_NUMBER.match(s)
        if m:
            return float(m[1])
    return np.nan


def loads(text: str | None) -> dict | None:
    """The JSON object, or None where the text is cut off or no object."""
    if text is None:
        return None
    try:
        o = json.loads(text)
    except ValueError:
        return None
    return o if isinstance(o, dict) else None


def with_metrics(readings: DataFrame, keep: list[str], rule: NameRule, fields: list[str], lent: str | None = None) -> DataFrame:
    """``keep`` columns, ``readable`` and one double per canonical field; reads only ``keep`` and metrics_json.

    A cut-off metrics_json gives readable = false and null fields; of two keys for one field the first number wins.
    ``lent``: a column with a map from keys to fields, which overrules the names for its row.
    """
    src = spread(readings.select(*keep, "metrics_json", *([lent] if lent else [])))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("readable", T.BooleanType())] + [T.StructField(f, T.DoubleType()) for f in fields])
    col_of = {f: i for i, f in enumerate(fields)}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, int] = {}
        width = len(fields)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            own = b.column(len(keep) + 1).to_pylist() if lent else None
            at, values, ok = [], [], np.zeros(len(texts), dtype=bool)
            for i, s in enumerate(texts):
                o = loads(s)
                if o is None:
                    continue
                ok[i] = True
                base = i
                if own is not None and own[i]:
                    o = {said.get(k, k): v for said in [dict(own[i])] for k, v in o.items() if said.get(k, "") is not None}
                for k, v in o.items():
                    j = index.get(k)
                    if j is None:
                        if len(index) > 100_000:
                            index.clear()
                        j = index[k] = col_of.get(rule(k) or "", -1)
                    if j >= 0 and v is not None:
                        at.append(j * len(texts) + base)
                        values.append(v if type(v) is float or type(v) is int else number_of(v))
            flat = np.full(width * len(texts), np.nan)
            if at:
                try:
                    vals = np.array(values, dtype=np.float64)
                except (OverflowError, ValueError):
                    vals = np.array([number_of(v) for v in values], dtype=np.float64)
                flat[np.array(at[::-1])] = vals[::-1]
            cols = [flat[j * len(texts) : (j + 1) * len(texts)] for j in range(width)]
            arrays = [b.column(i) for i in range(len(keep))] + [pa.array(ok)] + [pa.array(c, mask=~np.isfinite(c)) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "readable", *fields])

    return src.mapInArrow(parse, schema)
