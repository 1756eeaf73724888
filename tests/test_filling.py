import datetime as dt

from pyspark.sql import functions as F

from tagloom.operators.filling import fill_cells, filled_cells, mine_dependencies, text_or_null, train_anomalies, with_drive

SCHEMA = "row_id bigint, serial_number string, bay string, date date, smart_9 float, smart_187 float, smart_194 float"


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def rows():
    out = [(i, "S1", "b1", day(i), 1000.0 + 24 * i, float(i // 15), 40.0) for i in range(30)]
    out[5] = (5, None, "b1", day(5), 1120.0, 0.0, 40.0)  # S1 on both sides
    out[9] = (9, "n/a", "b1", day(9), float("nan"), -1.0, 40.0)
    out[12] = (12, "S1", "b1", day(12), 999999.0, 65535.0, 40.0)
    out += [(100 + i, "S2", "b2", day(i), 500.0, None, 40.0) for i in range(4)]
    out += [(110, "", "b2", day(5), 500.0, None, 40.0)]  # S2 before, S3 after
    out += [(120 + i, "S3", "b2", day(8 + i), 7000.0, 3.0, 40.0) for i in range(3)]
    out += [(130, "S3", "b2", day(30), None, None, 40.0)]  # nothing within a week
    out += [(131, "S3", "b2", day(10), 7000.0, 3.0, 40.0), (140, None, None, day(3), None, None, 40.0), (141, "S9", "b9", None, None, 1.0, 40.0)]
    out += [(142, "S1", "b1", day(12), 999999.0, 65535.0, 40.0)]  # a repeated row
    return out


def test_cells_filled_and_left(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("serial", F.lit("clash")).withColumn("drive", F.lit("clash"))
    got = {(r.row_id, r.field): (r.value, r.provenance) for r in filled_cells(df).collect()}
    assert got.pop((5, "serial_number")) == ("S1", "fd:bay,interval") and got.pop((9, "serial_number")) == ("S1", "fd:bay,interval")
    assert got.pop((9, "smart_9")) == ("1216.0", "group:drive,7d") and got.pop((9, "smart_187")) == ("0.0", "fd:drive,interval")
    for k in (12, 142):
        assert got.pop((k, "smart_9")) == ("1288.0", "group:drive,7d") and got.pop((k, "smart_187")) == ("0.0", "fd:drive,interval")
    assert not got


def test_every_row_comes_out_once(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = fill_cells(df)
    assert sorted(r.row_id for r in out.collect()) == sorted(r[0] for r in rows())
    r = {x.row_id: x for x in out.collect()}
    assert r[130].smart_9 is None and r[130].smart_9_provenance is None and r[0].smart_9_provenance == "shown"


def test_same_day_dictionary(spark):
    data = [(1, "S", "b", day(0), 10.0, 1.0, 40.0), (2, "S", "b", day(0), None, None, 40.0), (3, "S", "b", day(2), 58.0, 1.0, 40.0), (4, "S", "b", day(2), 58.0, 1.0, 40.0)]
    got = {(r.row_id, r.field): (r.value, r.provenance) for r in filled_cells(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {(2, "smart_9"): ("10.0", "fd:drive,date"), (2, "smart_187"): ("1.0", "fd:drive,date")}


def test_anomalous_values_give_nothing(spark):
    data = [(i, "S", "b", day(i), -500.0 if i == 1 else None, None, 40.0) for i in range(3)]
    assert filled_cells(spark.createDataFrame(data, SCHEMA)).count() == 0


def test_fillers_recur_or_are_words(spark):
    t = spark.createDataFrame([("S1 ",), ("0000000000",), (" ",), ("N/A",), ("unknown",), ("-",), (None,)], "s string").select(text_or_null(F.col("s")).alias("s"))
    assert [r.s for r in t.collect()] == ["S1", None, None, None, None, None, None]
    data = [(i, "FILLCODE" if i % 10 == 5 else f"S{i // 10}", f"b{i // 10}", day(i % 10), 1.0, 0.0, 40.0) for i in range(120)]
    d = with_drive(spark.createDataFrame(data, SCHEMA))
    assert d.where("serial = 'FILLCODE'").count() == 0 and d.where("serial_by_bay is not null").count() == 12


def test_dependencies(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, 2), ("b", 1, 2), ("b", 2, 3)], "x string, y int, z int")
    r = {(m.determinant, m.dependent): m for m in mine_dependencies(df, [(("x",), "y"), (("y",), "z"), (("x", "y"), "z")]).collect()}
    assert r["x", "y"].violating_groups == 1 and not r["x", "y"].holds and r["y", "z"].holds and not r["x,y", "z"].holds


def test_empty_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert filled_cells(e).count() == 0 and train_anomalies(e).count() == 0


def test_violated_groups_give_no_dictionary(spark):
    data = [(2 * i + k, "S", "b", day(i), 1000.0 + 24 * i, 1.0, 40.0) for i in range(110) for k in (0, 1)]
    data[101] = (101, "S", "b", day(50), 2210.0, 3.0, 40.0)  # a second value on the day
    data += [(900, "S", "b", day(50), None, None, 40.0), (901, "S", "b", day(60), None, None, 40.0)]
    got = {(r.row_id, r.field): (r.value, r.provenance) for r in filled_cells(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {(900, "smart_9"): ("2205.0", "group:drive,7d"), (900, "smart_187"): ("2.0", "group:drive,7d"), (901, "smart_9"): ("2440.0", "fd:drive,date"), (901, "smart_187"): ("1.0", "fd:drive,date")}


def test_refuted_dependencies_give_no_dictionary(spark):
    data = [(2 * i + k, "S", "b", day(i), 1000.0 + 24 * i + 10 * k, 1.0, 40.0) for i in range(10) for k in (0, 1)]
    data += [(900, "S", "b", day(12), None, None, 40.0), (901, "S", "b", day(12), 1290.0, 1.0, 40.0)]  # that day alone has one value
    data += [(100 + i, "S1" if i % 2 else "S2", "b2", day(i), 500.0, 1.0, 40.0) for i in range(8)] + [(910, "", "b2", day(3), 500.0, 1.0, 40.0)]  # drives take turns
    got = {(r.row_id, r.field): (r.value, r.provenance) for r in filled_cells(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {(900, "smart_9"): ("1290.0", "group:drive,7d"), (900, "smart_187"): ("1.0", "fd:drive,date"), (910, "serial_number"): ("S2", "group:bay")}


def test_cut_timelines_fill_the_same(spark):
    import random

    rnd = random.Random(3)
    data = [(i, "hot" if rnd.random() > 0.05 else None, "b", day(i // 3), None if rnd.random() < 0.3 else 900.0 + 8 * i, None if rnd.random() < 0.3 else float(i // 200), 40.0) for i in range(900) if rnd.random() > 0.2]
    df = spark.createDataFrame(data, SCHEMA)
    run = lambda most: sorted(map(tuple, fill_cells(df, max_rows=most).collect()), key=str)
    assert run(10**6) == run(60)


def test_each_candidate_is_judged(spark):
    from tagloom.operators.filling import _bay_days, fill_dependencies, mine_codes, with_serial, HOURS_RANGE, ERRORS_RANGE

    data = [(2 * i + k, "S", "b", day(i), 1000.0 + 24 * i, float(i % 2) if i > 15 else 1.0, 40.0) for i in range(30) for k in (0, 1)]
    df = spark.createDataFrame(data, SCHEMA)
    codes = mine_codes(df, {"smart_9": HOURS_RANGE, "smart_187": ERRORS_RANGE})
    clean = with_serial(df, codes.serials)
    r = {(x.determinant, x.dependent): x for x in fill_dependencies(_bay_days(clean), clean, codes).collect()}
    assert r["bay,interval", "serial"].holds and r["drive,date", "smart_9"].holds and r["drive,date", "smart_187"].holds
    assert ("drive,interval", "smart_9") not in r and not r["drive,interval", "smart_187"].holds and r["drive,interval", "smart_187"].violating_groups == 13


def test_codes_are_a_share(spark):
    from tagloom.operators.filling import mine_codes

    data = [(i, f"S{i}", f"b{i}", day(0), -7.0 if i < 5 else 1.0, 0.0, 40.0) for i in range(3000)]
    assert mine_codes(spark.createDataFrame(data, SCHEMA), {"smart_9": (0.0, 300_000.0)}).numbers["smart_9"] == ()  # five of 3,000 drives
    assert mine_codes(spark.createDataFrame(data[:900], SCHEMA), {"smart_9": (0.0, 300_000.0)}).numbers["smart_9"] == (-7.0,)
