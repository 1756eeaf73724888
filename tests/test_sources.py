import pytest
from pyspark.sql import functions as F

from tagloom.sources import ingest as I
from tagloom.streaming import telemetry as S

SPEC = """
# one file, one string
transfers:
  - src: file::%s
    dst: tag::files
    format: binary
    range_off: 2
    range_size: 5
  - src: string::note
    dst: tag::notes
    format: string
    data: "hello ${TAGLOOM_NAME}"
  - src: file::/missing
    dst: tag::x
    format: binary
    depends_on: other
    dataset_filter:
      include:
        - "*.h5"
      exclude:
        - "tmp*"
"""


def test_spec_and_ingest(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TAGLOOM_NAME", "you")
    (tmp_path / "f.bin").write_bytes(b"0123456789")
    spec = I.load_spec(SPEC % (tmp_path / "f.bin"))
    assert spec[2].include == ["*.h5"] and spec[2].exclude == ["tmp*"] and spec[0].range_size == 5
    got = {(r.tag_name, r.blob_name): bytes(r.payload) for r in I.ingest(spark, spec).collect()}
    assert got == {("files", "chunk_0"): b"23456", ("files", "description"): b"binary<size=5, offset=2>", ("notes", "note"): b"hello you"}


def test_plain_yaml_reads_the_same(tmp_path):
    doc = I._plain_yaml(SPEC % "x")
    assert len(doc["transfers"]) == 3 and doc["transfers"][2]["dataset_filter"] == {"include": ["*.h5"], "exclude": ["tmp*"]} and doc["transfers"][1]["data"] == "hello ${TAGLOOM_NAME}"


@pytest.mark.parametrize("bad,code", [(I.Transfer("file::x", "tag::t", data="d"), -1), (I.Transfer("string::", "tag::t", data="d"), -2), (I.Transfer("string::b", "file::t", data="d"), -3), (I.Transfer("string::b", "tag::", data="d"), -4), (I.Transfer("string::b", "tag::t"), -7)])
def test_inline_string_codes(spark, bad, code):
    with pytest.raises(I.IngestError) as e:
        I.read_string(spark, bad)
    assert e.value.code == code


def test_ingest_stops_and_counts(spark):
    ok = I.Transfer("string::b", "tag::t", "string", data="x")
    with pytest.raises(I.IngestError) as e:
        I.ingest(spark, [ok, ok, I.Transfer("ftp://x", "tag::t"), ok])
    assert e.value.done == 2
    with pytest.raises(I.IngestError):
        I.load_spec("transfers:\n  - src: file::a\n    dst: tag::b\n")


def test_chunks_cover_the_file(spark):
    data = bytes(range(256)) * 10
    df = spark.createDataFrame([("t", data, len(data)), ("e", b"", 0)], "tag string, content binary, length bigint")
    rows = [r for r in I.chunks(df, "tag", "content", "length", 1000).collect() if r.blob_name != "description"]
    assert b"".join(bytes(r.payload) for r in sorted(rows, key=lambda r: int(r.blob_name[6:]))) == data and {r.tag_name for r in rows} == {"t"}
    assert I.chunks(df, "tag", "content", "length", 1000, 2000, 900).count() == 0


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", b"xyz"), ("b", b""), ("ü", b"\0\1"), (None, b"q")], "blob_name string, payload binary").repartition(3)
    assert I.export_records(df, str(tmp_path / "out")) == 5
    assert {(r.blob_name, bytes(r.payload)) for r in I.read_records(spark, str(tmp_path / "out")).collect()} == {("a", b"xyz"), ("ü", b"\0\1")}


def test_csv_tsv_asc_parquet(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tmy col!\n1\t2.5\n2\t3.5\n")
    df = I.read_csv(spark, str(tmp_path / "a.tsv"))
    assert df.columns == ["id", "my_col"] and df.agg(F.sum("my_col")).first()[0] == 6
    I.write_csv(df, str(tmp_path / "c"))
    assert I.read_csv(spark, str(tmp_path / "c"), "id int, my_col double").count() == 2
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nNODATA_value -9999\n1 2\n-9999 4\n")
    assert [(r.row, r.col, r.value) for r in I.read_asc(spark, str(tmp_path / "g.asc")).orderBy("row", "col").collect()] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, None), (1, 1, 4.0)]
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    (m,) = I.parquet_metadata(spark, str(tmp_path / "p")).collect()
    assert m["rows"] == 2 and m.bytes > 0


def test_snapshot(spark, tmp_path):
    t, b = spark.range(2).toDF("tag"), spark.range(3).toDF("blob")
    I.save_snapshot(t, b, str(tmp_path / "s"))
    x, y = I.load_snapshot(spark, str(tmp_path / "s"))
    assert (x.count(), y.count()) == (2, 3)


def stream(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return S.source(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)


def test_batches_open_with_their_first_event(spark, tmp_path):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    s = stream(spark, tmp_path, [[("a", t(0)), ("a", t(9)), ("a", t(11)), ("a", t(25))], [("b", t(100))]], "k string, ts timestamp")
    out = S.run_to_table(S.batches_from_first(s, "k", "ts", 10), str(tmp_path / "o")).orderBy("start_us").collect()
    assert [(r.k, r.n, r.start_us - 1704067200000000) for r in out] == [("a", 2, 0), ("a", 1, 11_000_000), ("a", 1, 25_000_000)]  # b's is still open


def test_barrier_and_promotion(spark, tmp_path):
    s = stream(spark, tmp_path, [[("g", 1), ("g", 2)], [("g", 2), ("g", 3), ("h", 1)]], "k string, m bigint")
    assert [(r.k, r["round"]) for r in S.run_to_table(S.barrier(s, "k", "m", 3), str(tmp_path / "o")).collect()] == [("g", 1)]
    assert [r.k for r in S.run_to_table(S.promotions(s, "k", 4), str(tmp_path / "p")).collect()] == ["g"]


def test_ordered_appends(spark, tmp_path):
    s = stream(spark, tmp_path, [[("f", 2, 5), ("f", 1, 10), ("g", 1, 3)], [("f", 3, 7)], [("g", 2, 1), ("f", 4, 0), ("f", 5, 2)]], "f string, at bigint, n bigint")
    S.append_batches(s, "f", ["at"], "n", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = [(r.f, r.at, r.offset, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("f", "at").collect()]
    assert got == [("f", 1, 0, 1), ("f", 2, 10, 2), ("f", 3, 15, 3), ("f", 4, 22, 4), ("f", 5, 22, 5), ("g", 1, 0, 1), ("g", 2, 3, 2)]


def test_sessions(spark, tmp_path):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    s = stream(spark, tmp_path, [[("a", t(0)), ("a", t(2)), ("a", t(30)), ("a", t(90))]], "k string, ts timestamp")
    got = S.run_to_table(S.sessions(s, "ts", ["k"], "5 minutes", "1 minute"), str(tmp_path / "o"))
    assert sorted(r.n for r in got.collect()) == [1, 2]


def test_records_are_files_in_the_format(spark, tmp_path):
    import struct

    b = spark.createDataFrame([("x", bytearray(b"\x00\xff1")), ("größe", bytearray(b"22")), ("none", bytearray(b"")), (None, bytearray(b"q"))], "blob_name string, payload binary").repartition(2)
    assert I.export_records(b, str(tmp_path / "rec")) == 5
    files = sorted((tmp_path / "rec").glob("*.rec"))
    whole = b"".join(f.read_bytes() for f in files)
    assert struct.pack("<I", 1) + b"x" + struct.pack("<Q", 3) + b"\x00\xff1" in whole and len(whole) == 5 + (4 + 1 + 8) + (4 + 7 + 8) and not list((tmp_path / "rec").glob(".attempt*"))
    assert sorted((r.blob_name, bytes(r.payload)) for r in I.read_records(spark, str(tmp_path / "rec")).collect()) == [("größe", b"22"), ("x", b"\x00\xff1")]
    assert I.export_records(b.limit(0), str(tmp_path / "none")) == 0
    from tagloom.sources import records

    records.register(spark)
    read = lambda d: spark.read.format("tagrecords").load(str(tmp_path / d))
    assert sorted((r.blob_name, bytes(r.payload)) for r in read("rec").collect()) == [("größe", b"22"), ("x", b"\x00\xff1")] and read("none").count() == 0
    assert sum(r.bytes for r in I.file_listing(spark, str(tmp_path / "rec"), ["*.rec"]).collect()) == len(whole)


def test_metadata_of_files(spark, tmp_path):
    spark.range(30).withColumn("s", F.lit("a")).coalesce(1).write.parquet(str(tmp_path / "p"))
    (r,) = I.parquet_footers(spark, str(tmp_path / "p")).collect()
    assert (r.rows, r.row_groups, r.columns) == (30, 1, 2) and r.types == {"id": "int64", "s": "string"} and "parquet" in r.created_by.lower()
    (tmp_path / "t.csv").write_text("a,b,c\n1,2,3\n4,5,6\n")
    (c,) = I.csv_metadata(spark, str(tmp_path / "t.csv")).collect()
    assert (c.file, c.bytes, c.rows, c.columns) == ("t.csv", 18, 2, 3)


def test_codes_and_verified_reads(spark, tmp_path):
    t = I.Transfer("string::b", "tag::t", "string", data="x")

    def no_tag(_):
        raise KeyError("t")

    def broken(_):
        raise OSError

    assert [I.stored_string(spark, t, f) for f in (lambda df: None, no_tag, broken)] == [0, I.TAG_FAILED, I.PUT_FAILED] and I.stored_string(spark, I.Transfer("string::", "tag::t", "string", data="x"), broken) == I.NO_BLOB
    with pytest.raises(I.IngestError) as e:
        I.ingest(spark, [t, I.Transfer(f"file://{tmp_path}/none", "tag::t", "binary"), t], verify=True)
    assert e.value.done == 1

    @I.reader("letters")
    def letters(spark, t, kind, rest, tag):
        return spark.createDataFrame([(tag, c, bytearray(c.encode())) for c in t.data], I.BLOB_SCHEMA)

    assert I.ingest(spark, [I.Transfer("file://x", "tag::t", "letters", data="abc")]).count() == 3


def test_hdf5_chunks_by_slabs(spark, tmp_path, monkeypatch):
    """Against a stand-in for h5py, since it isn't installed: arrays in a pickle, with the few calls that are used."""
    import pickle
    import sys

    import numpy as np

    fake = tmp_path / "fake"
    fake.mkdir()
    (fake / "h5py.py").write_text("import pickle\nclass Dataset:\n    def __init__(s, a): s.a, s.dtype, s.shape, s.size = a, a.dtype, a.shape, a.size\n    def __getitem__(s, k): return s.a[k]\nclass File:\n    def __init__(s, p, m): s.d = pickle.load(open(p, 'rb'))\n    def __enter__(s): return s\n    def __exit__(s, *a): pass\n    def visititems(s, f):\n        for k, v in s.d.items(): f(k, Dataset(v))\n    def __getitem__(s, k): return Dataset(s.d[k])\n")
    arrays = {"a/wide": np.arange(900_000, dtype="<f4").reshape(300, 3000), "b": np.float64(3.5) * np.ones(()), "skip/x": np.zeros(5), "none": np.zeros((0, 4))}
    (tmp_path / "f.h5").write_bytes(pickle.dumps(arrays))
    monkeypatch.syspath_prepend(str(fake))
    spark.sparkContext.addPyFile(str(fake / "h5py.py"))
    try:
        got = {(r.tag_name, r.blob_name): bytes(r.payload) for r in I.read_hdf5(spark, str(tmp_path / "f.h5"), "t", [], ["skip/*"]).collect()}
    finally:
        sys.modules.pop("h5py", None)
    assert got["t/a/wide", "description"] == b"tensor<float32, 300, 3000>" and {k for k, _ in got} == {"t/a/wide", "t/b", "t/none"}
    raw = arrays["a/wide"].tobytes()
    assert [got["t/a/wide", f"chunk_{i}"] for i in range(3)] == [raw[i * I.STEP : (i + 1) * I.STEP] for i in range(3)] and ("t/a/wide", "chunk_3") not in got
    assert got["t/b", "chunk_0"] == arrays["b"].tobytes() and ("t/none", "chunk_0") not in got
