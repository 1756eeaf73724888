"""Schemas that drift between files (problem 5): profiles, matching of versions, a report of changes, one table.

Every file's keys are profiled (rows, nulls, forms, a sketch of the values) in one pass with partial sums per task.
The files of a feed are then taken in order. The feed's fields are chains of matched keys, and each file's keys are
matched with them by a bipartite assignment over names, forms and value sketches: a key takes the field of the chain
it is matched with, and a key that no chain suits starts a chain of its own. The attribute dictionary only names
chains: it stands at a feed's start as one chain per attribute, with names and without values. The unified table
reads each file by the fields its keys were matched with.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.readings import NUMBERED, NameRule, label_key, loads, number_of, with_metrics
from ..session import spread

NUMBER, TEXT, OBJECT = 1, 2, 4
FORMS = {NUMBER: "number", TEXT: "text", OBJECT: "object"}
NEGATIVE, POSITIVE, WORDS = 8, 40, 8  # cells of a sketch: numbers below and from 0 on, by logarithm, and hashed texts
STEP = 0.6
CELLS = NEGATIVE + POSITIVE + WORDS
_SUMS = ("n", "nulls", "numbers", "texts", "objects", "m0", "m1", "m2")
PROFILE = "file_name string, key string, n bigint, nulls bigint, numbers bigint, texts bigint, objects bigint, m0 bigint, m1 double, m2 double, lo double, hi double, cells array<bigint>"


def _cells(y: np.ndarray) -> np.ndarray:
    """Cell of each number on the logarithmic scale y."""
    return np.where(y < 0, NEGATIVE - 1 - np.minimum(-y / 3, NEGATIVE - 1).astype(int), NEGATIVE + np.minimum(np.maximum(y, 0) / STEP, POSITIVE - 1).astype(int))


class _Sums:
    """Running profiles of (file, key), folded batch by batch."""

    def __init__(self) -> None:
        self.names: list[tuple[str, str]] = []
        self.at: dict[str, dict[str, int]] = {}
        self.counts, self.sums, self.ends, self.cells = np.zeros((0, 5), int), np.zeros((0, 3)), np.zeros((0, 2)), np.zeros((0, CELLS), int)

    def slot(self, own: dict[str, int], f: str, k: str) -> int:
        i = own[k] = len(self.names)
        self.names.append((f, k))
        return i

    def fold(self, at: list[int], kind: list[int], num: list[float], word: list[int]) -> None:
        n, old = len(self.names), len(self.counts)
        pad = lambda a, v: np.concatenate([a, np.full((n - old, a.shape[1]), v, a.dtype)])
        self.counts, self.sums, self.cells = pad(self.counts, 0), pad(self.sums, 0.0), pad(self.cells, 0)
        self.ends = np.concatenate([self.ends, np.tile([math.inf, -math.inf], (n - old, 1))])
        i, x = np.array(at, dtype=int), _floats(num)
        self.counts += np.bincount(i * 5 + np.array(kind, dtype=int), minlength=n * 5).reshape(n, 5)
        ok = np.isfinite(x)
        j, x = i[ok], x[ok]
        y = np.copysign(np.log1p(np.abs(x)), x)
        for c, w in enumerate((np.ones_like(y), y, y * y)):
            self.sums[:, c] += np.bincount(j, weights=w, minlength=n)
        np.minimum.at(self.ends[:, 0], j, y)
        np.maximum.at(self.ends[:, 1], j, y)
        self.cells += np.bincount(j * CELLS + _cells(y), minlength=n * CELLS).reshape(n, CELLS)
        w = np.array(word, dtype=int)
        self.cells += np.bincount(i[w >= 0] * CELLS + NEGATIVE + POSITIVE + w[w >= 0], minlength=n * CELLS).reshape(n, CELLS)

    def batch(self) -> pa.RecordBatch:
        c, s = self.counts, self.sums
        cols = [pa.array([x[0] for x in self.names], pa.string()), pa.array([x[1] for x in self.names], pa.string()), pa.array(c.sum(axis=1)), *[pa.array(np.ascontiguousarray(c[:, k])) for k in range(1, 5)]]
        cols += [pa.array(s[:, 0].astype(np.int64)), pa.array(np.ascontiguousarray(s[:, 1])), pa.array(np.ascontiguousarray(s[:, 2])), *[pa.array(np.ascontiguousarray(self.ends[:, k])) for k in (0, 1)]]
        cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * CELLS), pa.array(self.cells.ravel())))
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PROFILE.split(", ")])


def _floats(num: list) -> np.ndarray:
    try:
        return np.array(num, dtype=np.float64)
    except OverflowError:  # a whole number beyond any double
        return np.array([x if isinstance(x, float) or abs(x) < 1 << 1000 else math.inf for x in num], dtype=np.float64)


def json_profile(rows: DataFrame, file: str, payload: str) -> DataFrame:
    """Partial profiles of the keys of JSON objects per file; key '' counts the file's readable rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = _Sums()
        for b in batches:
            at: list[int] = []
            kind: list[int] = []
            num: list = []
            word: list[int] = []
            for f, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                o = loads(s)
                if o is None or f is None:
                    continue
                own = acc.at.setdefault(f, {})
                for k, v in (("", None), *o.items()):
                    i = own.get(k)
                    at.append(acc.slot(own, f, k) if i is None else i)
                    w = -1
                    if v is None:
                        x, c = math.nan, 1 if k else 0
                    elif type(v) is int or type(v) is float:
                        x, c = v, 2
                    else:
                        x, c = number_of(v), 4 if isinstance(v, dict) else 3
                        if c == 3 and x != x:
                            w = zlib.crc32(str(v).encode()) % WORDS
                    kind.append(c)
                    num.append(x)
                    word.append(w)
            if at:
                acc.fold(at, kind, num, word)
            if len(acc.names) > 20_000:
                yield acc.batch()
                acc = _Sums()
        if acc.names:
            yield acc.batch()

    return spread(rows.select(file, payload)).mapInArrow(run, PROFILE)


def merge_profiles(partial: DataFrame) -> DataFrame:
    return partial.groupBy("file_name", "key").agg(*[F.sum(c).alias(c) for c in _SUMS], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array(*[F.sum(F.col("cells")[i]) for i in range(CELLS)]).alias("cells"))


def column_number(c: Column) -> Column:
    """Number of a text column's value in any of the forms that occur (see readings.number_of)."""
    t = F.trim(c)
    hexed = F.regexp_extract(t, r"^0[xX]([0-9A-Fa-f]+)$", 1)
    whole = F.when(F.length(hexed) <= 15, F.conv(hexed, 16, 10).try_cast("double")).otherwise(_long_hex(hexed))
    inner = F.coalesce(F.get_json_object(t, "$.raw"), F.get_json_object(t, "$.v"), F.get_json_object(t, "$.value"))
    return F.when(hexed != "", whole).otherwise(F.coalesce(t.try_cast("double"), F.when(t.startswith("{"), inner.try_cast("double")), F.regexp_extract(t, r"^(?:n=)?\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", 1).try_cast("double")))


def _long_hex(digits: Column) -> Column:
    """Double of hexadecimal digits of any length, digit by digit."""
    return F.aggregate(F.split(digits, ""), F.lit(0.0), lambda s, d: s * 16 + F.coalesce(F.conv(F.nullif(d, F.lit("")), 16, 10).cast("double"), F.lit(0.0)))


def column_profile(rows: DataFrame, file: str, columns: list[str]) -> DataFrame:
    """Profiles of text columns per file: a plain decimal number is number, a JSON object object, anything else text."""
    src = rows.where(F.col(file).isNotNull()).select(F.col(file).alias("file_name"), F.explode(F.array(F.struct(F.lit("").alias("key"), F.lit(None).cast("string").alias("v")), *[F.struct(F.lit(c).alias("key"), F.col(c).alias("v")) for c in columns])).alias("kv")).select("file_name", "kv.*").where("key = '' or v is not null")
    t = F.trim("v")
    plain = t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    obj = t.startswith("{") & F.try_parse_json(t).isNotNull()
    x = column_number(F.col("v"))
    x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    y = F.signum(x) * F.log1p(F.abs(x))
    form = F.when(F.col("v").isNull(), 1).when(plain, 2).when(F.coalesce(obj, F.lit(False)), 4).otherwise(3)
    e = src.select("file_name", "key", "v", form.alias("form"), y.alias("y"))
    down = NEGATIVE - 1 - F.floor(F.least(-F.col("y") / 3, F.lit(float(NEGATIVE - 1))))
    up = NEGATIVE + F.floor(F.least(F.col("y") / STEP, F.lit(float(POSITIVE - 1))))
    cell = F.when(F.col("y") < 0, down).when(F.col("y").isNotNull(), up).when(F.col("form") == 3, NEGATIVE + POSITIVE + F.pmod(F.crc32(F.col("v").cast("binary")), F.lit(WORDS))).cast("int")
    sums = [F.count("*").alias("n"), F.count_if(F.col("form") == 1).alias("nulls"), F.count_if(F.col("form") == 2).alias("numbers"), F.count_if(F.col("form") == 3).alias("texts"), F.count_if(F.col("form") == 4).alias("objects")]
    sums += [F.count("y").alias("m0"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("m1"), F.coalesce(F.sum(F.col("y") * F.col("y")), F.lit(0.0)).alias("m2"), F.coalesce(F.min("y"), F.lit(math.inf)).alias("lo"), F.coalesce(F.max("y"), F.lit(-math.inf)).alias("hi")]
    per = e.groupBy("file_name", "key", cell.alias("cell")).agg(*sums)
    held = F.map_from_entries(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "n"))))
    out = per.groupBy("file_name", "key").agg(*[F.sum(c).alias(c) for c in _SUMS], F.min("lo").alias("lo"), F.max("hi").alias("hi"), held.alias("held"))
    return out.select(*[c for c in out.columns if c != "held"], F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0))).alias("cells"))


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the largest total score, by shortest augmenting paths."""
    n, m = score.shape
    if n > m:
        return sorted((a, b) for b, a in assign(score.T))
    cost = -score
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        dist, used, back = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < dist[free]
            dist[free[better]], back[free[better]] = now[better], j0
            j1 = free[np.argmin(dist[free])]
            delta = dist[j1]
            u[match[used]] += delta
            v[used] -= delta
            dist[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


@lru_cache(maxsize=100_000)
def name_likeness(a: str, b: str) -> float:
    """Likeness of two names: of two with a number, whether it is the same; of others, 1 for the same letters and digits, else their shared pairs of letters. -1: they can't be the same."""
    na, nb = NUMBERED.match(a.strip()), NUMBERED.match(b.strip())
    if na and nb:
        return 1.0 if int(na[1]) == int(nb[1]) else -1.0
    ka, kb = label_key(a).removesuffix("raw"), label_key(b).removesuffix("raw")
    if ka == kb:
        return 1.0
    ga, gb = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (f"^{ka}$", f"^{kb}$"))
    return 2 * len(ga & gb) / max(1, len(ga) + len(gb))


@dataclass
class Chain:
    """One field of a feed: the names it has had, and the profile of its last version."""

    field: str
    names: set[str] = field(default_factory=set)
    last: dict | None = None

    def likeness(self, key: str) -> float:
        each = [name_likeness(n, key) for n in self.names]
        best = max(each, default=0.0)
        return best if best >= 1 or -1.0 not in each else -1.0


def value_likeness(a: dict, b: dict) -> float | None:
    """Likeness of two sketches: shared mass of their cells, distance of their quantiles, distance of their means; None where one is empty."""
    p, q = np.array(a["cells"], dtype=float), np.array(b["cells"], dtype=float)
    if not p.sum() or not q.sum():
        return None
    p, q = p / p.sum(), q / q.sum()
    shared = float(np.minimum(p, q).sum())
    far = STEP * float(np.abs(np.cumsum((p - q)[: NEGATIVE + POSITIVE])).sum())
    if not a["m0"] or not b["m0"]:
        return shared
    ma, mb = a["m1"] / a["m0"], b["m1"] / b["m0"]
    sa, sb = (math.sqrt(max(0.0, x["m2"] / x["m0"] - m * m)) for x, m in ((a, ma), (b, mb)))
    return 0.4 * shared + 0.3 * math.exp(-far) + 0.3 * math.exp(-abs(ma - mb) / (0.25 + 0.5 * (sa + sb)))


def similarity(chain: Chain, key: dict) -> float:
    """Likeness of a chain and a key: 2 and more by an equal name, 0 where the names exclude each other, else by values, form and name."""
    name = chain.likeness(key["key"])
    value = None if chain.last is None else value_likeness(chain.last, key)
    if name >= 1:
        return 2.0 + (value or 0.0)
    if name < 0:
        return 0.0
    if value is None:
        return 0.8 * name
    return 0.55 * value + 0.15 * bool(chain.last["form"] & key["form"]) + 0.3 * name


def match_versions(chains: list[Chain], keys: list[dict], least: float = 0.6) -> list[tuple[str, str, float]]:
    """(field, key, score) of the keys that continue a chain, by the best assignment.

    A key of a chain's last name is its continuation. The others are assigned to the chains that remain; keys with a
    name of a chain that is taken (one file may use two names) then join it in further rounds.
    """
    current = {c.last["key"]: c for c in chains if c.last is not None}
    pairs = [(current[k["key"]].field, k["key"], 1.0) for k in keys if k["key"] in current]
    done = {p[1] for p in pairs}
    rest, taken, first = [k for k in keys if k["key"] not in done], {p[0] for p in pairs}, True
    while rest:
        free = [c for c in chains if c.field not in taken] if first else chains
        got = []
        if free:
            score = np.array([[similarity(c, k) for c in free] for k in rest])
            if first:
                score[:, [c.last is None for c in free]] += 1e-6  # of equals, a chain not seen yet takes its name's key
            got = [(free[j].field, rest[i]["key"], float(score[i, j])) for i, j in assign(score) if score[i, j] >= (least if first else 2.0)]
        if not got and not first:
            break
        pairs += got
        done = {p[1] for p in got}
        rest, first = [k for k in rest if k["key"] not in done], False
    return pairs


class FeedMatcher:
    """The chains of one feed, file by file."""

    def __init__(self, rule: NameRule, late_names: bool = True):
        self.chains = {f: Chain(f, set(names)) for f, names in rule.names().items()}
        self.late_names, self.begun = late_names, False

    def step(self, keys: list[dict]) -> dict[str, tuple[str, float]]:
        """key -> (field, score) of one file's keys; the chains go on with them."""
        out = {k: (f, s) for f, k, s in match_versions(list(self.chains.values()), keys)}
        for k in keys:
            f = out.setdefault(k["key"], (k["key"] if k["key"] not in self.chains else f"{k['key']}'", 0.0))[0]
            c = self.chains.setdefault(f, Chain(f))
            c.names.add(k["key"])
            if c.last is None or k["m0"] or not c.last["m0"]:
                c.last = k
            else:
                c.last = {**c.last, "key": k["key"]}
        if not self.begun and keys and not self.late_names:
            self.chains = {f: Chain(f, {c.last["key"]}, c.last) for f, c in self.chains.items() if c.last is not None}
        self.begun = self.begun or bool(keys)
        return out


def versions(profile: DataFrame, feed_files: DataFrame) -> DataFrame:
    """One row per file with readable content: feed, target_table, file_no, file_name and the profiles of its keys."""
    form = (F.when(F.col("numbers") > 0, NUMBER).otherwise(0) + F.when(F.col("texts") > 0, TEXT).otherwise(0) + F.when(F.col("objects") > 0, OBJECT).otherwise(0)).cast("int")
    entry = F.struct("key", form.alias("form"), "m0", "m1", "m2", "cells")
    per_file = profile.groupBy("file_name").agg(F.sort_array(F.collect_list(F.when(F.col("key") != "", entry))).alias("keys"))
    files = feed_files.groupBy("file_name").agg(F.min(F.struct("feed", "target_table", "file_no")).alias("f")).select("file_name", "f.*")
    return per_file.join(files, "file_name").select("feed", "target_table", "file_no", "file_name", "keys")


def matched_versions(vers: DataFrame, rule: NameRule, late_names: bool = True) -> DataFrame:
    """(feed, target_table, file_name, prev_file, now, key, form, field, score): each file's keys (now = 1) and those of the file before it (now = 0).

    A feed's files pass in order through one task, as one row of profiles each; the state is the feed's chains.
    ``late_names``: whether the dictionary also names chains that begin after a feed's first file.
    """
    kinds = (("feed", pa.string()), ("target_table", pa.string()), ("file_name", pa.string()), ("prev_file", pa.string()), ("now", pa.int32()), ("key", pa.string()), ("form", pa.int32()), ("field", pa.string()), ("score", pa.float64()))
    schema = "feed string, target_table string, file_name string, prev_file string, now int, key string, form int, field string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chains, before, prev = None, None, [], None
        for b in batches:
            out: list[tuple] = []
            cols = [b.column(i).to_pylist() for i in (0, 1, 3)]
            for i, place in enumerate(zip(cols[0], cols[1])):
                keys = b.column(4)[i].as_py()
                if chains is None or place != at:
                    at, chains, before, prev = place, FeedMatcher(rule, late_names), [], None
                fields = chains.step(keys)
                base = (*place, cols[2][i], prev)
                here = [(k["key"], k["form"], *fields[k["key"]]) for k in keys]
                out += [(*base, 1, *x) for x in here]
                out += [(*base, 0, *x) for x in before]
                before, prev = here, cols[2][i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)], names=[n for n, _ in kinds])

    return vers.repartition("feed", "target_table").sortWithinPartitions("feed", "target_table", "file_no", "file_name").mapInArrow(run, schema)


def changes(matched: DataFrame) -> DataFrame:
    """(file_name, prev_file, field, change, old_name, new_name, old_form, new_form) of every change of a field.

    A field may have several keys in a file; it is renamed where the sets of its keys differ, and retyped where both
    files show a form and the sets of forms differ. A feed's first file has no changes.
    """
    sides = matched.where("prev_file is not null").groupBy("file_name", "prev_file", "field").agg(
        *[F.sort_array(F.collect_set(F.when(F.col("now") == s, F.col("key")))).alias(f"{p}_names") for p, s in (("new", 1), ("old", 0))], *[F.bit_or(F.when(F.col("now") == s, F.col("form"))).alias(f"{p}_bits") for p, s in (("new", 1), ("old", 0))]
    )
    here, there = F.size("new_names") > 0, F.size("old_names") > 0
    what = F.array_compact(
        F.array(
            F.when(here & ~there, "added"),
            F.when(~here & there, "removed"),
            F.when(here & there & (F.col("new_names") != F.col("old_names")), "renamed"),
            F.when(here & there & (F.col("new_bits") > 0) & (F.col("old_bits") > 0) & (F.col("new_bits") != F.col("old_bits")), "retyped"),
        )
    )
    words = lambda c: F.concat_ws("+", *[F.when(F.col(c).bitwiseAND(b) > 0, w) for b, w in FORMS.items()])
    return sides.select("file_name", "prev_file", "field", F.explode(what).alias("change"), F.concat_ws(",", "old_names").alias("old_name"), F.concat_ws(",", "new_names").alias("new_name"), words("old_bits").alias("old_form"), words("new_bits").alias("new_form"))


NOT_MEASURED = ("file_name", "serial_number", "model", "bay")


def attribute_columns(train: DataFrame) -> list[str]:
    """The text columns that may hold a drifting attribute: all but the keys of the daily rows."""
    return [c for c, t in train.dtypes if t == "string" and c not in NOT_MEASURED]


def _matched(readings: DataFrame, train: DataFrame, feed_files: DataFrame, rule: NameRule, late_names: bool = True) -> DataFrame:
    both = merge_profiles(json_profile(readings, "file_name", "metrics_json")).unionByName(column_profile(train, "file_name", attribute_columns(train)))
    return matched_versions(versions(both, feed_files), rule, late_names)


def drift_report(readings: DataFrame, train: DataFrame, feed_files: DataFrame, rule: NameRule, field: str = "smart_5", late_names: bool = True) -> DataFrame:
    """Changes between the files of every feed, of all keys of metrics_json and of the columns of one attribute in train.

    Files without readable content, rows without a file name and files that feed_files doesn't name leave no rows.
    """
    m = _matched(readings, train, feed_files, rule, late_names)
    return changes(m.where((F.col("target_table") != "train") | (F.col("field") == field)))


def unified(readings: DataFrame, train: DataFrame, feed_files: DataFrame, rule: NameRule, field: str = "smart_5") -> DataFrame:
    """One table of both sources: table_name, row_key, file_name, source, and one double per canonical field.

    Keys are read as the fields they were matched with in their file; files that feed_files doesn't name are read by
    the dictionary's names. In train the attribute's columns of any name and form become one number; a cut-off
    metrics_json gives nulls. Keys whose field is no canonical one have no column.
    """
    m = _matched(readings, train, feed_files, rule).where("now = 1")
    by_name = F.pandas_udf(lambda names: names.map(rule), "string")
    # only what the matching adds to the names, or overrules, travels with the rows; Spark sizes this join at run time
    said = m.withColumn("by_name", by_name("key")).where(~F.col("field").eqNullSafe(F.col("by_name")) & (F.col("field").isin(rule.fields) | F.col("by_name").isNotNull()))
    per_file = said.groupBy("target_table", "file_name").agg(F.map_from_entries(F.collect_set(F.struct("key", "field"))).alias("lent"))
    lent = lambda rows, t: rows.join(per_file.where(F.col("target_table") == t).select("file_name", "lent"), "file_name", "left")
    r = with_metrics(lent(readings.select("id", "drive_id", "file_name", "metrics_json"), "drive_readings"), ["id", "drive_id", "file_name"], rule, rule.fields, "lent")
    a = r.select(F.lit("drive_readings").alias("table_name"), F.col("id").alias("row_key"), "file_name", F.col("drive_id").alias("source"), *rule.fields)
    columns = attribute_columns(train)
    is_field = lambda c: F.coalesce(F.try_element_at("lent", F.lit(c)), F.lit(rule(c)), F.lit("")) == field
    number = column_number(F.coalesce(*[F.when(is_field(c), F.col(c)) for c in columns])) if columns else F.lit(None).cast("double")
    own = {f: (number if f == field else F.col(f).cast("double") if f in train.columns else F.lit(None).cast("double")) for f in rule.fields}
    keep = dict.fromkeys(c for c in ("row_id", "file_name", "serial_number", *columns, *rule.fields) if c in train.columns)
    b = lent(train.select(*keep), "train").select(F.lit("train").alias("table_name"), F.col("row_id").alias("row_key"), "file_name", F.col("serial_number").alias("source"), *[F.when(~F.isnan(c), c).alias(f) for f, c in own.items()])
    return a.unionByName(b)
