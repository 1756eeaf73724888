import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions.readings import NameRule, number_of
from tagloom.operators.drift import CELLS, Chain, FeedMatcher, _cells, assign, column_profile, drift_report, json_profile, match_versions, merge_profiles, name_likeness, unified

RULE = NameRule([("smart_5", "Reallocated Sectors"), ("smart_9", "Power On Hours")])
R = "id bigint, drive_id string, metrics_json string, file_name string"
T = "row_id bigint, file_name string, serial_number string, smart_5 string, smart_5_raw string, smart_9 float"
FF = "file_name string, feed string, target_table string, file_no int"


@given(st.integers(1, 4), st.integers(1, 5), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_assignment_is_best(n, m, seed):
    s = np.random.default_rng(seed).random((n, m)).round(2)
    got = assign(s)
    k = min(n, m)
    best = max(sum(s[a, b] for a, b in zip(rows, cols)) for rows in itertools.permutations(range(n), k) for cols in itertools.combinations(range(m), k)) if n <= m else max(sum(s[a, b] for a, b in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    assert len(got) == k and len({a for a, _ in got}) == k and len({b for _, b in got}) == k
    assert abs(sum(s[a, b] for a, b in got) - best) < 1e-9


def test_numbers_in_every_form():
    assert [number_of(x) for x in (5, 5.5, "7", "0x0a", "26.5 C", "-3 h", {"raw": 4, "norm": 1}, {"v": "9", "u": "h"}, "n=3")] == [5, 5.5, 7, 10, 26.5, -3, 4, 9, 3]
    assert all(np.isnan(number_of(x)) for x in (None, True, "x", {}, [], "0xzz"))


def entry(key, x, form=1):
    y = np.log1p(np.asarray(x, dtype=float))
    return {"key": key, "form": form, "m0": len(x), "m1": float(y.sum()), "m2": float((y * y).sum()), "cells": np.bincount(_cells(y), minlength=CELLS).tolist()}


def test_unknown_names_match_by_values():
    hours, few = np.arange(9000, 9100), np.zeros(100)
    chains = [Chain("smart_5", {"smart_5"}, entry("smart_5", few)), Chain("smart_9", {"smart_9"}, entry("smart_9", hours))]
    pairs = match_versions(chains, [entry("zeta", hours + 24), entry("smart_5", few)])
    assert {p[:2] for p in pairs} == {("smart_5", "smart_5"), ("smart_9", "zeta")}
    assert {p[:2] for p in match_versions(chains, [entry("attr_004", hours), entry("r_5", few)])} == {("smart_5", "r_5")}  # another number is another attribute


def test_names():
    assert name_likeness("smart_5_raw", "attr_005") == name_likeness("Power On Hours", "powerOnHours") == 1.0
    assert name_likeness("smart_5", "smart_50") == -1.0 and 0.5 < name_likeness("powerhours", "Power On Hours") < 1.0


def test_two_names_in_one_file_and_no_keys():
    m = FeedMatcher(RULE)
    got = m.step([entry("smart_5", [1, 2]), entry("r_5", [3]), entry("odd", [1e6])])
    assert {k: v[0] for k, v in got.items()} == {"smart_5": "smart_5", "r_5": "smart_5", "odd": "odd"}
    assert m.step([]) == {} and m.step([entry("SMART_5", [1])])["SMART_5"][0] == "smart_5"


def _drifting(spark):
    """Hours under a word that no dictionary has, from the second of three files on."""
    import json

    rows = [(f * 100 + i, "d", json.dumps({name: 5000 + 100 * f + i, "smart_5": i % 2}), f"f{f}") for f, name in enumerate(("smart_9", "zeta", "zeta")) for i in range(60)]
    return spark.createDataFrame(rows, R), feeds(spark, [(f"f{i}", "drive_readings", i) for i in range(3)])


def test_unknown_word_is_renamed_and_read(spark):
    readings, ff = _drifting(spark)
    train = spark.createDataFrame([], T)
    got = {(r.file_name, r.field, r.change, r.new_name) for r in drift_report(readings, train, ff, RULE).collect()}
    assert got == {("f1", "smart_9", "renamed", "zeta")}
    u = unified(readings, train, ff, RULE)
    assert u.where("smart_9 is null or smart_9 <> 5000 + row_key % 100 + 100 * floor(row_key / 100)").count() == 0 and u.count() == 180


def test_rows_come_through_the_matching(spark, monkeypatch):
    from tagloom.operators import drift

    keys = [[entry("smart_9", [5000, 5001])], [entry("attr_009", [5002, 5003])]]
    run = lambda: [m.step(k) for m in [drift.FeedMatcher(RULE)] for k in keys]
    assert [v[0] for x in run() for v in x.values()] == ["smart_9", "smart_9"]
    monkeypatch.setattr(drift, "match_versions", lambda *a: [])
    assert len({v[0] for x in run() for v in x.values()}) == 2


def feeds(spark, files):
    return spark.createDataFrame([(f, "feed", t, n) for f, t, n in files], FF)


def test_report(spark):
    rows = [
        (1, "d", '{"smart_5": 0, "smart_9": 100}', "a"), (2, "d", '{"smart_5": null}', "a"),
        (3, "d", '{"attr_005": "0x01", "smart_9": 110.5}', "b"), (4, "d", '{"smart_5": 1, "cut', "c"),
        (5, "d", '{"attr_005": 2}', "d"), (6, "d", '{"attr_005": 3, "Power On Hours": {"raw": 1}}', "e"), (7, None, None, None),
    ]
    train = [(1, "ta", "s", "1", None, 5.0), (2, "tb", "s", None, "1.0", None), (3, "tc", "s", None, "0x01", 1.0), (4, "td", "s", None, None, 1.0), (5, "te", "s", '{"raw": 1}', None, 1.0), (6, None, None, "1", None, None)]
    ff = feeds(spark, [(f, "drive_readings", i) for i, f in enumerate("abcde")] + [(f, "train", i) for i, f in enumerate(["ta", "tb", "tc", "td", "te"])])
    got = {(r.file_name, r.field, r.change) for r in drift_report(spark.createDataFrame(rows, R), spark.createDataFrame(train, T), ff, RULE).collect()}
    assert got == {
        ("b", "smart_5", "renamed"), ("b", "smart_5", "retyped"), ("d", "smart_5", "retyped"), ("d", "smart_9", "removed"), ("e", "smart_9", "added"),
        ("tb", "smart_5", "renamed"), ("tc", "smart_5", "retyped"), ("td", "smart_5", "removed"), ("te", "smart_5", "added"),
    }


def test_forms_of_columns(spark):
    df = spark.createDataFrame([("f", x) for x in ("5", "5.0", " 7 ", "0x05", "n=5", "5 sectors", '{"raw": 5}', "{broken", None)], "file string, c string")
    r = {x.key: x for x in column_profile(df, "file", ["c"]).collect()}
    assert r[""].n == 9 and (r["c"].numbers, r["c"].texts, r["c"].objects, r["c"].n) == (3, 4, 1, 8)


def test_one_table(spark):
    rows = [(1, "d", '{"r_5": "0x0a", "Power On Hours": "7 h"}', "a"), (2, "d", "{", "a")]
    train = [(i, "t", "s", x, None, float("nan")) for i, x in enumerate(("5", "5.0", "0x05", "n=5", "5 sectors", '{"raw": 5}', '{"v": 5, "u": "sect"}', None))]
    u = unified(spark.createDataFrame(rows, R), spark.createDataFrame(train, T).withColumn("source", F.lit("clash")), spark.createDataFrame([], FF), RULE).collect()
    assert [(r.smart_5, r.smart_9) for r in u if r.table_name == "drive_readings"] == [(10.0, 7.0), (None, None)]
    assert [r.smart_5 for r in sorted((r for r in u if r.table_name == "train"), key=lambda r: r.row_key)] == [5.0] * 7 + [None]


def test_sketches_of_both_sources_agree(spark):
    values = ["0", "1", "7.5", "-3", "1e9", "0x0a", "0xffffffffffffffffff", "n=4", "5 sectors", "word", '{"raw": 12}']
    train = spark.createDataFrame([("f", v) for v in values], "file string, c string")
    a = {r.key: r for r in column_profile(train, "file", ["c"]).collect()}["c"]
    b = {r.key: r for r in merge_profiles(json_profile(spark.createDataFrame([("f", '{"c": %s}' % (v if v[0] == "{" else f'"{v}"')) for v in values], "file string, payload string"), "file", "payload")).collect()}["c"]
    assert a.cells == b.cells and a.m0 == b.m0 == 10 and abs(a.m1 - b.m1) < 1e-9 and sum(a.cells) == 11


def test_empty(spark):
    assert drift_report(spark.createDataFrame([], R), spark.createDataFrame([], T), spark.createDataFrame([], FF), RULE).count() == 0
