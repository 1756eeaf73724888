import json

import pytest
from pyspark.sql import functions as F

from tagloom.api import Catalog, Tools, main, tool_json
from tagloom.operators import attributes as A
from tagloom.operators.files import FileError, FileTree
from tagloom.operators.labelling import label_blobs
from tagloom.session import table
from tagloom.sources.ingest import Transfer


@pytest.fixture(scope="module")
def cat(spark):
    rows = [(i, w and f"doc about {w}", f"t/{t}", f"b{i}.txt") for i, (w, t) in enumerate([("space", "a"), ("bread", "a"), ("space ships", "b"), (None, "c")])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, tag_name string, blob_name string").withColumn("last_modified", F.timestamp_micros(F.col("doc_id") * 1000000 + 1))
    return Catalog.of_documents(d)


def test_modes(cat):
    assert [r.blob_name for r in cat.context_query("t/.*", ".*", prompt="space").collect()][0] in ("b0.txt", "b2.txt")
    assert [r.blob_name for r in cat.context_query("t/a").collect()] == ["b0.txt", "b1.txt"]
    assert [r.blob_name for r in cat.context_query("t/.*", begin=1000000001, max_results=2).collect()] == ["b1.txt", "b2.txt"]
    assert cat.temporal_search(".*", ".*", end=1000).count() == 1 and cat.semantic_search(".*", ".*", "bread", 1).first().blob_name == "b1.txt"
    assert cat.tag_query("t/.").first().total == 3 and cat.blob_query("t/a", "b0.*").count() == 1


def test_changes(cat):
    t = cat.tag("t/a")
    more = t.put_blob("new", "hello")
    assert more.tag("t/a").contained_blobs().count() == 3 and more.tag("t/a").get_blob("new", 1, 3).first().payload == b"ell"
    assert more.tag("t/a").size() == t.size() + 5 and more.tag("t/a").del_blob("new").blobs.count() == cat.blobs.count()
    assert cat.context_destroy(["t/a", "t/c"]).blobs.count() == 1
    assert cat.context_bundle([Transfer("string::x", "tag::n", "string", data="payload")]).tag("n").size() == 7
    assert cat.context_retrieve("t/.*", prompt="space", budget=12).count() == 0 and cat.context_retrieve("t/.*", prompt="space", budget=40).count() >= 1
    for bad, code in ((("", "x"), 4), (("b", None), 3), (("b", ""), 2), (("b", "x", 0, 1.5), 5)):
        with pytest.raises(ValueError) as e:
            t.put_blob(*bad)
        assert e.value.code == code
    over = more.tag("t/a").put_blob("new", b"\xff\x00", 7)
    assert bytes(over.tag("t/a").get_blob("new").first().payload) == b"hello\0\0\xff\0" and over.tag("t/a").blob_size("new") == 9 and over.tag("t/a").blob_info("new")["access_count"] == 2
    assert bytes(over.tag("t/a").put_blob("new", "J", 0, 0.5, True).tag("t/a").get_blob("new").first().payload) == b"J"
    assert over.tag("t/a").blob_score("new") == 1.0 and over.tag("t/a").reorganize_blob("new", 0.4).tag("t/a").blob_score("new") == 0.4
    assert over.tag("t/a").reorganize_blob("new", 0.97).tag("t/a").blob_score("new") == 1.0 and over.tag("t/a").blob_size("none") is None


def test_binary_files_come_back_as_they_were(cat, tmp_path):
    raw = bytes(range(256)) * 3
    (tmp_path / "x.bin").write_bytes(raw)
    new = cat.context_bundle([Transfer(f"file://{tmp_path}/x.bin", "tag::n", "binary")])
    assert bytes(new.tag("n").get_blob("chunk_0").first().payload) == raw and new.tag("n").blob_size("chunk_0") == 768


def test_command(cat, capsys):
    run = lambda *a: (main(list(a), cat), capsys.readouterr().out)
    code, out = run("--tag", "t/a", "--json")
    assert code == 0 and json.loads(out) == [{"tag_id": "t/a", "blob_name": "b0.txt"}, {"tag_id": "t/a", "blob_name": "b1.txt"}]
    assert run("--tags-only")[1].split() == ["t/a", "t/b", "t/c"] and run("--tag", "t/b")[1] == "t/b/b2.txt\n"
    hits = json.loads(run("--semantic", "space", "--json")[1])
    assert len(hits) == 3 and hits[0]["score"] > 0 and "0.000000" in run("--prompt", "space", "--format", "table")[1]
    assert "2 result(s)" in run("--time-end", "1000001000", "--format", "table")[1]
    assert run("--since", "1h")[1] == "" and json.loads(run("--since", "40000d", "--json")[1])[0]["last_modified"] == 1000
    for bad in (["--prompt", "x", "--since", "5m"], ["--since", "1d", "--time-begin", "5"], ["--since", "soon"]):
        with pytest.raises(SystemExit):
            main(bad, cat)
        capsys.readouterr()
    assert json.loads(tool_json(cat.tag_query("none"), "tags")) == {"tags": [], "count": 0}


def test_tools(spark, cat):
    log = spark.createDataFrame([(i, "put") for i in range(5)], "event_id bigint, op string")
    t = Tools(None, log)
    call = lambda *a, **k: json.loads(t.call(*a, **k))
    assert len(t.names()) == 12 and call("get_client_status") == {"available": True, "initialized": False} and "error" in call("tag_query", tag_regex=".*")
    t.catalog = cat
    assert call("tag_query", tag_regex="t/.", max_tags=2) == {"tags": ["t/a", "t/b"], "count": 2}
    assert call("blob_query", tag_regex="t/a", blob_regex="b1.*") == {"blobs": [{"tag_name": "t/a", "blob_name": "b1.txt"}], "count": 1}
    assert [e["event_id"] for e in call("poll_telemetry_log", minimum_logical_time=3)["entries"]] == [3, 4]
    assert call("put_blob", tag_name="t/z", blob_name="n", data="größer") == {"stored": True, "bytes": 8} and call("list_blobs_in_tag", tag_name="t/z") == {"blobs": ["n"], "count": 1}
    assert call("get_blob", tag_name="t/z", blob_name="n")["data"] == "größer" and call("get_blob", tag_name="t/z", blob_name="n", offset=3, size=1)["encoding"] == "base64"
    assert call("get_blob_size", tag_name="t/z", blob_name="n") == {"size": 8} and "error" in call("get_blob_size", tag_name="t/z", blob_name="x") and "error" in call("put_blob", tag_name="t/z", blob_name="", data="x")
    assert call("reorganize_blob", tag_name="t/z", blob_name="n", new_score=0.5) == {"score": 0.5}
    assert call("delete_blob", tag_name="t/z", blob_name="n") == {"deleted": True} and call("delete_blob", tag_name="t/z", blob_name="n") == {"deleted": False}
    assert call("get_types")["types"]["payload"] == "binary" and "error" in call("nothing") and "error" in call("tag_query")


def test_files(spark):
    b = spark.createDataFrame([(1, "/a/x", bytearray(b"hello world")), (2, "/a/b/y", None)], "ino bigint, path string, payload binary").withColumn("last_modified", F.timestamp_micros(F.lit(7)))
    t = FileTree.of_blobs(b, F.col("path"), F.col("ino"), 4)
    text = lambda t: {r.path: bytes(r.payload) for r in t.read().collect()}
    assert text(t) == {"/a/x": b"hello world", "/a/b/y": b""} and {r.path: r.kind for r in t.nodes.collect()} == {"/": "dir", "/a": "dir", "/a/b": "dir", "/a/x": "file", "/a/b/y": "file"}
    w = spark.createDataFrame([("/a/x", 1, 3, bytearray(b"LOWER")), ("/a/x", 2, 5, bytearray(b"--")), ("/a/b/y", 1, 6, bytearray(b"z")), ("/none", 1, 0, bytearray(b"q"))], "path string, seq int, offset bigint, data binary").withColumn("mtime_us", F.lit(9).cast("bigint"))
    u = t.write(w)
    assert text(u) == {"/a/x": b"helLO--Rrld", "/a/b/y": b"\0" * 6 + b"z"} and {r["size"] for r in u.nodes.where("kind = 'file'").collect()} == {11, 7}
    assert {r.path: bytes(r.payload) for r in u.read(2, 6).collect()} == {"/a/x": b"lLO--R", "/a/b/y": b"\0" * 4 + b"z"}
    s = u.truncate(spark.createDataFrame([("/a/x", 2), ("/a/b/y", 9)], "path string, size int"))
    assert text(s) == {"/a/x": b"he", "/a/b/y": b"\0" * 6 + b"z\0\0"}
    r = s.rename("/a", "/new/home").link("/new/home/x", "/x2").symlink("/new/home/x", "/p").mkdir("/empty")
    assert text(r)["/x2"] == b"he" and r.readlink("/p") == "/new/home/x" and {x.n_links for x in r.links().where("ino = 1").collect()} == {2}
    assert text(r.unlink("/new/home/x"))["/x2"] == b"he" and r.unlink("/new/home/x").unlink("/x2").pages.where("ino = 1").isEmpty()
    assert r.utimens("/x2", 5).nodes.where("path = '/new/home/x'").first().mtime_us == 5 and r.rmdir("/empty").nodes.where("path = '/empty'").isEmpty()
    assert text(r.create("/q/w"))["/q/w"] == b"" and r.rename("/x2", "/new/home/x").nodes.where("path = '/x2'").isEmpty()
    assert {tuple(x) for x in r.chown("/x2", 7).chown("/x2", gid=8).nodes.where("ino = 1").select("uid", "gid").collect()} == {(7, 8)} and r.chown("/x2", 7).mkdir("/e2").nodes.where("path = '/e2'").first().uid is None
    for code, f in (("ENOENT", lambda: r.unlink("/zz")), ("EISDIR", lambda: r.unlink("/new")), ("ENOTEMPTY", lambda: r.rmdir("/new")), ("ENOTDIR", lambda: r.rmdir("/x2")), ("EEXIST", lambda: r.mkdir("/new")), ("EINVAL", lambda: r.rename("/new", "/new/in")), ("EPERM", lambda: r.link("/new", "/l")), ("EINVAL", lambda: r.readlink("/x2"))):
        with pytest.raises(FileError) as e:
            f()
        assert e.value.code == code


def test_aliases(spark):
    tags = spark.createDataFrame([("x", 1), ("y", 2)], "tag_name string, size int")
    al = spark.createDataFrame([("z", "x")], "alias string, tag_name string")
    assert A.with_alias(al, tags, "w", "x").count() == 2 and A.with_alias(al, tags, "z", "y").count() == 1 and A.with_alias(al, tags, "q", "none").count() == 1
    assert {r.tag_name: r.n_aliases for r in A.alias_counts(tags, al).collect()} == {"x": 1, "y": 0}
    t, a = A.unlink(tags, al, "x")
    assert sorted(r.tag_name for r in t.collect()) == ["y", "z"] and a.count() == 0
    t, a = A.unlink(tags, al, "z")
    assert t.count() == 2 and a.count() == 0
    t, _ = A.unlink(tags, al, "y")
    assert [r.tag_name for r in t.collect()] == ["x"]


def test_xattrs(spark):
    df = spark.createDataFrame([(1, {"a": b"1"}), (2, None)], "k int, m map<string,binary>")
    get = lambda c: {r.k: ({x: bytes(y) for x, y in r.m.items()} if r.m is not None else None) for r in df.select("k", c.alias("m")).collect()}
    assert get(A.xattr_set(F.col("m"), "a", b"2")) == {1: {"a": b"2"}, 2: {"a": b"2"}}
    assert get(A.xattr_set(F.col("m"), "a", b"2", "create")) == {1: {"a": b"1"}, 2: {"a": b"2"}}
    assert get(A.xattr_set(F.col("m"), "a", b"2", "replace")) == {1: {"a": b"2"}, 2: None}
    assert get(A.xattr_remove(F.col("m"), "a")) == {1: {}, 2: None}


def test_batches_and_slices(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 6), ("g", 2, 1), ("h", 1, 1)], "g string, m int, v int").withColumn("ts", F.timestamp_seconds(F.col("v") * 10))
    assert [r.g for r in A.complete_groups(df, "g", "m", 2).collect()] == ["g"]
    assert sorted(r.batch_sum for r in A.collective(df, ["g"], "ts", 100, "v").collect()) == [1, 12, 12, 12]
    arr = spark.createDataFrame([(1, [1, 2, 3, 4, 5])], "k int, a array<int>")
    assert [r.value for r in A.slice_array(arr, "k", "a", 1, 5, 2).collect()] == [2, 4]
    m = A.merge_replicas(spark.createDataFrame([("t", 1, 5, False), ("t", 2, 3, True)], "tag string, size int, last_modified int, found boolean"), "tag").first()
    assert (m["size"], m.last_modified, m.found) == (3, 5, True)


def test_labels(cat):
    def fn(prompt, text):
        if "bread" in text:
            raise RuntimeError
        return prompt + "|" + text

    got = {r.blob_name: r.payload for r in label_blobs(cat.blobs, [("(", "bad"), ("b0|b1", "p"), ("txt", "q")], label_fn=fn).collect()}
    assert got == {"b0.txt_label": "p|doc about space", "b2.txt_label": "q|doc about space ships"}
    assert label_blobs(cat.blobs, [("txt", "q")]).count() == 3


def test_stat(cat):
    assert {r.path: (r.is_dir, r["size"]) for r in A.stat(cat.blobs).collect()} == {"/": (True, 0), "/t": (True, 0), "/t/a": (False, 30), "/t/b": (False, 21), "/t/c": (False, 0)}
