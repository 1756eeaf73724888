import bz2
import fnmatch
import lzma
import math
import random
import re
import statistics
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import keys, parity
from tagloom.functions import text as X
from tagloom.operators import arraystats as A
from tagloom.operators import catalog as C
from tagloom.operators import compress as Z
from tagloom.operators import features as E
from tagloom.operators import search as S


def test_literals_and_required_runs():
    assert X.literal_of("^a/b\\.txt$") == "a/b.txt" and X.literal_of("abc") == "abc" and X.literal_of("a.c") is None and X.literal_of("\\d") is None
    assert X.required_literals("drive_notes/.*-00[0-9]") == ["drive_notes/", "-00"] and X.required_literals("abcd?e|f") == []
    rng = random.Random(7)
    names = ["".join(rng.choice("ab/_.") for _ in range(rng.randint(0, 8))) for _ in range(300)]
    for p in ("a+b", "abb*", "(ab)?ba_", "a{2}b", "[ab]+/.*", "ab\\.a", ".*aba.*", "a.b_?"):
        for n in names:
            if re.fullmatch(p, n):
                assert all(r in n for r in X.required_literals(p))


def test_regex_predicate_equals_full_match(spark):
    rng = random.Random(1)
    rows = [("/".join(rng.choice(["data", "log", "x1", "tmp"]) for _ in range(rng.randint(1, 4))) + rng.choice([".txt", ".dat", "", "\n"]),) for _ in range(400)]
    df = spark.createDataFrame(rows, "s string")
    for p in ("data/.*", "data", ".*\\.txt", "(log|tmp)/x1.*", "x1/data/log", "[dl].*g", "^tmp$"):
        got = sorted(r.s for r in df.where(X.regex_predicate(F.col("s"), p)).collect())
        assert got == sorted(s for (s,) in rows if re.fullmatch(p, s))


def test_globs(spark):
    names = ["a/b.txt", "a/c/d.txt", "b.h5", "a[1]", "ab", "x"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    for g in ("*.txt", "a*", "?b", "[ab]*", "[!a]*", "a/*/d.*"):
        assert sorted(r.s for r in df.where(X.glob_filter(F.col("s"), [g], [])).collect()) == sorted(n for n in names if fnmatch.fnmatchcase(n, g))
    assert df.where(X.glob_filter(F.col("s"), [], ["a*"])).count() == 2 and df.where(X.glob_filter(F.col("s"), ["a*"], ["*.txt"])).count() == 2


def test_hosts():
    assert X.expand_hosts("a[00-02,10]-x;b") == ["a00-x", "a01-x", "a02-x", "a10-x", "b"] and X.expand_hosts("n[8-10]") == ["n8", "n9", "n10"] and X.expand_hosts("") == []


def test_put_get_truncate(spark):
    cases = [(b"", b"xy", 3), (b"abcdef", b"ZZ", 2), (b"abc", b"ZZ", 2), (None, b"q", 0), (b"abc", b"", 1)]
    df = spark.createDataFrame([(i, a, b, o) for i, (a, b, o) in enumerate(cases)], "i int, a binary, b binary, o int").orderBy("i")
    got = df.select(C.put_blob(F.col("a"), F.col("b"), F.col("o")).alias("p"), C.put_blob(F.col("a"), F.col("b"), F.col("o"), True).alias("r"), C.truncate_blob(F.coalesce("a", F.lit(b"")), F.lit(4)).alias("t")).collect()
    for r, (a, b, o) in zip(got, cases):
        a = a or b""
        head = a[:o] + b"\0" * (o - len(a[:o]))
        assert bytes(r.p) == head + b + a[o + len(b) :] and bytes(r.r) == head + b and bytes(r.t) == (a + b"\0" * 4)[:4]


def test_file_from_pages_with_holes(spark):
    df = spark.createDataFrame([("f", 0, b"ab"), ("f", 2, b"wxyz")], "file string, page int, payload binary")
    assert bytes(C.file_bytes(df, "file", "page", "payload", 11, 4).first().payload) == b"ab\0\0\0\0\0\0wxy"


def test_replay(spark):
    df = spark.createDataFrame([("a", 1, "put", 5), ("a", 3, "delete", 0), ("b", 2, "put", 7), ("b", 4, "put", 8)], "k string, seq int, op string, v int")
    assert [(r.k, r.v) for r in C.replay(df, ["k"], "seq", "op").collect()] == [("b", 8)]


def test_bm25_finds_the_topic(spark):
    docs = ["the moon landing and the space telescope", "bread baking with yeast", "lunar exploration by space probes", "", "stock markets fell"]
    df = spark.createDataFrame([("t", f"doc{i}", d, len(d), None) for i, d in enumerate(docs)], "tag_name string, blob_name string, payload string, size bigint, last_modified timestamp")
    got = S.bm25(df, "moon space telescope lunar exploration", 3).collect()
    assert [r.blob_name for r in got][:2] == ["doc0", "doc2"] or [r.blob_name for r in got][:2] == ["doc2", "doc0"]
    assert len(got) == 3 and got[2].score == 0 and S.bm25(df, "", 0).count() == 4


def test_packing(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([5, 0, 4, 9, 1, 1])], "rank int, size bigint")
    assert [r["rank"] for r in S.packed(df, "rank", "size", 10).collect()] == [0, 2]
    assert sorted(r["rank"] for r in S.packed_by_batch(df, "rank", "size", 10, 2).collect()) == [0, 2, 4]


def test_catalog_edges(spark):
    d = spark.createDataFrame([(1, None, "t", "b", None), (2, "", None, None, None), (3, "é", "t", "b", None)], "doc_id bigint, text string, tag_name string, blob_name string, last_modified timestamp")
    b = C.blobs_of(d)
    assert sorted(r["size"] for r in b.collect()) == [0, 0, 2] and C.tags_of(b).count() == 2
    assert S.tag_query(b.select("tag_name").distinct(), ".*").count() == 1 and C.tags_of(C.blobs_of(d.limit(0))).count() == 0


def test_families():
    rng = np.random.default_rng(0)
    assert A.classify(rng.uniform(0, 1, 4000))[0] == "uniform" and A.classify(rng.normal(0, 1, 4000))[0] == "normal"
    assert A.classify(rng.exponential(1, 4000))[0] == "exponential" and A.classify(rng.gamma(5, 1, 4000))[0] == "gamma"
    assert A.classify(np.ones(50))[0] == "constant" and A.classify(np.ones(5))[0] == "unknown"


def test_array_edges(spark):
    df = spark.createDataFrame([(1, []), (2, [1.0]), (3, [2.0, 2.0, 2.0, 5.0]), (4, None)], "k int, a array<float>")
    a = A.doubles(F.col("a"))
    r = {x.k: x for x in df.select("k", A.derivative(a).alias("d1"), A.second_derivative(a).alias("d2"), A.max_run(a).alias("run")).collect()}
    assert (r[1].d1, r[2].d1, r[3].d1) == (0, 0, 1) and r[3].run == 3 and r[2].d2 == 0 and r[1].run == 0
    f = {x.k: x for x in A.byte_features(df, "k", "a").collect()}
    assert f[4].entropy is None and f[1].entropy == 0 and f[3].family == "unknown"


def test_groom():
    v = A.groom([3.14159265, 0.0, float("inf"), -2.71828], 3)
    assert abs(v[0] - 3.14159) < 0.01 and v[1] == 0 and np.isinf(v[2]) and abs(v[3] + 2.71828) < 0.01


@pytest.mark.parametrize("codec", sorted(Z.CODECS))
def test_codecs_round_trip(spark, codec):
    df = spark.createDataFrame([(b"abc" * 500,), (b"",), (None,)], "b binary")
    assert df.select((F.col("b").eqNullSafe(Z.decompress(Z.compress(F.col("b"), codec), codec))).alias("same")).where("not same").count() == 0


def test_edges_and_bins(spark):
    vals = [1.0, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    s = sorted(v for v in vals if v is not None)
    want = sorted({s[int(i / 4 * len(s))] for i in range(1, 4)})
    got = [r.edge for r in Z.percentile_edges(df, "v", 4).orderBy("bin").collect()]
    assert got == want
    assert [r.b for r in df.where("v is not null").select(Z.bin_of(F.col("v"), want).alias("b")).collect()] == [sum(e < v for e in want) for v in vals if v is not None]


def test_weibull_fit(spark):
    rng = np.random.default_rng(8)
    x = 900 * rng.weibull(1.7, 4000)
    got = {r.kind: r for r in E.fit_weibull(spark.createDataFrame([("hdd", float(v)) for v in x] + [("ssd", 5.0)], "kind string, days double"), "kind", "days").collect()}
    assert abs(got["hdd"].shape - 1.7) < 0.08 and abs(got["hdd"].scale - 900) < 30 and (got["ssd"].shape, got["ssd"].scale) == E.DEFAULT_WEIBULL["ssd"]


def test_online_cost(spark):
    df = spark.createDataFrame([("k", i, 4.0, 10.0) for i in range(200)] + [(None, 1, 1.0, 1.0)], "k string, i int, c double, r double")
    (r,) = E.online_cost(df, "k", ["i"], "c", "r").collect()
    assert abs(r.coefficient - 2.0) < 1e-6 and r.error < 0.01 and r.n == 200


def test_least_squares():
    x = np.linspace(0, 4, 30)
    y = 3 * np.exp(-0.7 * x) + 1
    p, cost = E.levenberg_marquardt(lambda q: q[0] * np.exp(-q[1] * x) + q[2] - y, np.array([1.0, 1.0, 0.0]))
    assert np.allclose(p, [3, 0.7, 1], atol=1e-4) and cost < 1e-8


def test_parity_recovers_any_loss():
    rows = np.random.default_rng(2).integers(0, 256, (5, 40)).astype(np.uint8)
    both = np.concatenate([rows, parity.encode(rows, 3)])
    for lost in ([0, 1, 2], [4, 5, 7], [1, 3, 6]):
        assert (parity.recover({i: both[i] for i in range(8) if i not in lost}, 5, 3) == rows).all()
    with pytest.raises(ValueError):
        parity.recover({0: rows[0]}, 5, 3)


def test_prefix_keys_and_encryption(spark):
    assert keys.fnv1a(b"") == 0xCBF29CE484222325 and keys.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    q = spark.createDataFrame([(1, [1, 2, 3]), (2, [9]), (3, None)], "id int, tokens array<int>")
    s = spark.createDataFrame([([1], 5), ([1, 2], 50)], "tokens array<int>, n int").select(F.element_at(keys.prefix_keys(F.col("tokens")), -1).alias("key"), "n")
    assert [(r.id, r.matched) for r in keys.longest_prefix(q, s, "id", "tokens", "key", "n", 100).collect()] == [(1, 2)]
    assert [(r.id, r.matched) for r in keys.longest_prefix(q, s, "id", "tokens", "key", "n", 10).collect()] == [(1, 1)]
    df = spark.createDataFrame([(b"secret bytes",)], "b binary")
    assert bytes(df.select(keys.decrypt(keys.encrypt(F.col("b"), "pw"), "pw").alias("b")).first().b) == b"secret bytes"


def test_block_sample_takes_stretches(spark):
    df = spark.createDataFrame([(list(map(float, range(1000))),), ([1.0],)], "a array<double>")
    a, b = (r.s for r in df.select(A.block_sample(F.col("a"), 3, 4, 8).alias("s")).collect())
    assert len(a) == 32 and all(a[i + 1] - a[i] == 1 for k in range(4) for i in range(8 * k, 8 * k + 7)) and b == [1.0]


def test_skew_is_of_the_population(spark):
    v = [1.0, 2.0, 4.0, 9.0]
    m = statistics.fmean(v)
    m2, m3 = (sum((x - m) ** k for x in v) / 4 for k in (2, 3))
    r = A.moments(spark.createDataFrame([(1, v)], "k int, a array<float>"), "k", "a").first()
    assert abs(r.skew - m3 / m2**1.5) < 1e-9 and abs(r.std - statistics.stdev(v)) < 1e-9


def test_prefix_match_against_brute_force(spark, tmp_path):
    from tagloom.plans.baseline_queries import kv_prefix_match

    rng = np.random.default_rng(5)
    v = [rng.normal(0, 0.6, 64).tolist() for _ in range(40)]
    v += [v[0], v[1][:20] + [9.0] + v[1][21:], v[2][:40] + [9.0], [9.5] * 64, []]  # whole, 20 and 40 alike; alone; empty
    spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    toks = [[int(np.floor(np.float32(x) * 2)) for x in e] for e in v]
    alike = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = {q: min(32, max(alike(a, b) for j, b in enumerate(toks) if j != q)) for q, a in enumerate(toks)}  # 128 bytes hold 32 elements
    got = {r.vec_id: (r.matched, r.key) for r in kv_prefix_match(spark, str(tmp_path)).collect()}
    assert {q: m for q, (m, _) in got.items()} == {q: m for q, m in want.items() if m} and (got[0][0], got[1][0], got[2][0]) == (32, 20, 32)
    assert all(k == keys._prefix_keys(toks[q])[m - 1] for q, (m, k) in got.items())


def test_codecs_see_whole_payloads(spark):
    noise = random.Random(3).randbytes(65536)
    data = [(1, bytearray(noise + b"a" * 400_000)), (2, bytearray(b"a" * 65536 + noise * 3)), (3, bytearray(noise[:50])), (4, bytearray()), (5, None)]
    df = spark.createDataFrame(data, "id bigint, payload binary")
    rows = Z.schedule(df, "id", "payload").collect()
    raw = {k: bytes(b or b"") for k, b in data}
    assert len(rows) == 5 * 3
    for r in rows:
        packed = len(Z.CODECS[r.codec][0][1](raw[r.id])) if raw[r.id] else 0
        assert (r.bytes, r.packed_bytes, r.keep_original) == (len(raw[r.id]), packed, packed >= len(raw[r.id]))
    best = {r.id: r for r in Z.best_codec(Z.schedule(df, "id", "payload"), "id", "ratio", "place", True).collect()}
    assert best[1].ratio > 5 and not best[1].keep_original and best[3].keep_original


def test_row_sample_is_seeded_and_capped(spark):
    df = spark.range(5000).withColumn("x", F.col("id") * 2)
    take = lambda d, *a: {r.id for r in E.row_sample(d, "id", *a).collect()}
    one = take(df, 1000, 42)
    assert len(one) == 1000 and one == take(df.repartition(7), 1000, 42) and one != take(df, 1000, 43)
    assert abs(sum(one) / 1000 - 2500) < 250 and len(take(df, 6000, 42)) == 5000 and not take(df.limit(0), 10, 42)
    assert E.row_sample(df, "id", 10).columns == ["id", "x"]


PIECES = [r"\x6f", "ops", r"\.", "[abc]", r"[\]x]", "[^]a]", "(?:ab|cd)", "(xyz)+", "(de)?", "f{2,3}", "g*", "hij", r"\d", ".", r"[\w-]", "k+l", "^", "$", "(m|n)o", r"\\", "(?:pq){2}r", "[s-u]{1,2}vwx"]


@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=7), st.randoms(use_true_random=False))
@settings(max_examples=300, deadline=None)
def test_no_match_lacks_a_required_literal(parts, rnd):
    """Strings made from a pattern, and those it matches, hold every literal that is demanded."""
    pattern = "".join(parts)
    made = {r"\x6f": ["o"], "ops": ["ops"], r"\.": ["."], "[abc]": "abc", r"[\]x]": "]x", "[^]a]": "bz", "(?:ab|cd)": ["ab", "cd"], "(xyz)+": ["xyz", "xyzxyz"], "(de)?": ["", "de"], "f{2,3}": ["ff", "fff"], "g*": ["", "gg"], "hij": ["hij"], r"\d": "07", ".": "q.", r"[\w-]": "w-", "k+l": ["kl", "kkl"], "^": [""], "$": [""], "(m|n)o": ["mo", "no"], r"\\": ["\\"], "(?:pq){2}r": ["pqpqr"], "[s-u]{1,2}vwx": ["svwx", "tuvwx"]}
    for _ in range(5):
        s = "".join(rnd.choice(list(made[p])) for p in parts)
        if re.fullmatch(pattern, s):
            assert all(r in s for r in X.required_literals(pattern)), (pattern, s)


def test_literals_that_must_not_be_demanded():
    assert X.required_literals(r"\x6fps_journal") == ["ops_journal"] and X.required_literals(r"[\]xyz]+foo") == ["foo"] and X.required_literals("[^]ab]cde") == ["cde"]
    assert X.required_literals("(?i)abc") == X.required_literals(r"\Qa.c\Ebcd") == X.required_literals("[a[b]]cde") == X.required_literals(r"\vabc") == X.required_literals("abc(") == X.required_literals(r"\101bcd") == []


def test_byte_features_by_hand(spark):
    rng = np.random.default_rng(5)
    arrays = [rng.normal(size=64), rng.uniform(size=64), rng.exponential(size=40), np.zeros(12), [], None, [1.0, float("nan")] * 8]
    df = spark.createDataFrame([(i, None if a is None else [float(np.float32(x)) for x in a]) for i, a in enumerate(arrays)], "k int, a array<float>")
    for r in A.byte_features(df, "k", "a").collect():
        if arrays[r.k] is None:
            assert r.entropy is None and r.family is None
            continue
        raw = np.asarray(arrays[r.k], dtype="<f4").tobytes()
        h = [raw.count(bytes([b])) for b in range(256)]
        want = -sum(x / len(raw) * math.log2(x / len(raw)) for x in h if x)
        assert abs(r.entropy - want) < 1e-9 and abs(r.zero_ratio - (h[0] / len(raw) if raw else 0)) < 1e-12 and abs(r.freq_variance - np.var(h)) < 1e-9
        v = np.asarray(arrays[r.k], dtype="<f4").astype(float)
        assert (r.family, r.confidence) == A.classify(v)
    x = np.linspace(-4, 4, 101)
    assert np.abs(A._erf(x) - np.array([math.erf(t) for t in x])).max() < 2e-7


@pytest.mark.parametrize("values", [list(range(1000)), [1.0] * 500 + [2.0] * 3 + [9.0], [5.0], [3.0, 1.0, 2.0] * 40, []])
def test_percentile_edges_are_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    want = sorted({sorted(values)[i * len(values) // 15] for i in range(1, 15)}) if values else []
    for accuracy in (100_000, 20):  # rough brackets are widened
        assert [(r.bin, r.edge) for r in Z.percentile_edges(df, "v", 15, accuracy).orderBy("bin").collect()] == list(enumerate(want))


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(1)
    s = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 9, (90, 2)))], "sid int, a int, b int")
    q = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 9, (30, 2)))], "qid int, a double, b double")
    run = lambda block: sorted(map(tuple, Z.nearest_states(q, s, "qid", ["a", "b"], "sid", 4, block).collect()))
    assert run(1000) == run(17) and len(run(17)) == 120


@pytest.mark.parametrize("most", [100, 10**6])
def test_ordered_work_on_a_key_of_many_parts(spark, most):
    """A key with nearly all rows, cut into parts; against a plain loop."""
    rnd = np.random.default_rng(4)
    data = [("hot" if rnd.random() < 0.9 else f"k{i % 5}", i, float(rnd.integers(0, 50)), float(rnd.integers(-2, 40))) for i in range(3000)] + [(None, 1, 1.0, 1.0)]
    df = spark.createDataFrame(data, "k string, i int, c double, r double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.i): (r.seq, r.offset) for r in C.append_layout(df, "k", ["i"], "c", most).collect()}
        lagged = {(r.k, r.i): r.r_d7 for r in E.lag_difference(df, "k", ["i"], ["r"], most=most).collect()}
        cost = {r.k: (r.coefficient, r.error, r.n) for r in E.online_cost(df, "k", ["i"], "c", "r").collect()}
        assert E.lag_difference(df.limit(0), "k", ["i"], ["r"], most=0).count() == 0 and E.online_cost(df.limit(0), "k", ["i"], "c", "r").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for k, i, c, r in data:
        by.setdefault(k, []).append((i, c, r))
    for k, rows in by.items():
        end, a, err = 0.0, 1.0, 0.0
        for n, (i, c, r) in enumerate(rows):
            assert got[k, i] == (n + 1, end)
            end += c
            if n >= 7:
                assert lagged[k, i] == r - rows[n - 7][2]
            p = a * (c + 1)
            if r > 0:
                err += 0.2 * (abs(p - r) / r - err)
            a -= 0.2 * (p - r) / (c + 1)
        if k is not None:
            assert cost[k][2] == len(rows) and abs(cost[k][0] - a) < 1e-9 and abs(cost[k][1] - err) < 1e-9


def test_targets_are_broadcast_only_if_small(spark):
    from tagloom.session import small

    t = spark.range(50)
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "broadcast" in plan(small(t)) and "broadcast" not in plan(small(t, 49))


def test_encrypted_bytes(spark):
    from tagloom.functions import keys

    df = spark.createDataFrame([(bytearray(b"x" * 40),)] * 2, "p binary")
    got = [bytes(x) for r in df.select(keys.encrypt(F.col("p"), "s"), keys.encrypt(F.col("p"), "t")).collect() for x in r]
    assert all(len(x) == 64 and b"xxxx" not in x for x in got) and len(set(got)) == 4  # each row has a start value of its own


def test_codecs_by_preset(spark):
    raw = b"abc" * 500 + bytes(range(256))
    df = spark.createDataFrame([(bytearray(raw),), (None,)], "p binary")
    for name, preset, want in (("zlib", "fast", zlib.compress(raw, 1)), ("ZLIB", "best", zlib.compress(raw, 9)), ("bzip2", "balanced", bz2.compress(raw, 6)), ("lzma", "fast", lzma.compress(raw, preset=0))):
        got = df.select(Z.compress(F.col("p"), name, preset).alias("c")).collect()
        assert bytes(got[0].c) == want and got[1].c is None
    assert Z.find_codec("Blosc")[:3] == ("blosc2", 2, 8) and Z.find_codec(wire_id=10)[0] == "zstd" and Z.find_codec(base_id=22)[0] == "cuszp" and Z.find_codec("x") is None
    with pytest.raises(ValueError):
        Z.compress(F.col("p"), "snappy")


def test_extension_fills_spare_room_first(spark):
    from tagloom.operators import placement as P
    from tagloom.plans.analytics_queries import _targets

    t = _targets(spark)
    assert P.extend_blob([("ram0", 100, 4096)], 3000, t, 1.0) == (0, [("ram0", 3000, 4096)]) and P.extend_blob([("ram0", 100, 100)], 50, t, 1.0) == (0, [("ram0", 100, 100)])
    code, blocks = P.extend_blob([("ram0", 100, 4096)], 10_000, t, 1.0)
    assert code == 0 and blocks == [("ram0", 4096, 4096), ("ram0", 5904, 8192)]
    big = (1 << 30) + (9 << 30)
    code, blocks = P.extend_blob([], big, t, 1.0, least_level=1)
    assert code == 0 and sum(b[1] for b in blocks) == big and [b[0] for b in blocks][:1] == ["nvme0"] and not {"ram0", "ssd0", "hdd0"} & {b[0] for b in blocks}
    assert P.extend_blob([], 10, t.limit(0), 1.0)[0] == P.NO_TARGETS and P.extend_blob([], 10, t.where("name = 'hdd0'"), 1.0)[0] == P.NONE_ELIGIBLE and P.extend_blob([], 1 << 50, t, 1.0)[0] == P.NO_SPACE
    more = P.register_target(P.register_target(t, {"name": "tape", "ttl_days": 9}), {"name": "s3", "ttl_days": 1})
    assert {r.name: r.ttl_days for r in more.collect()} == {r.name: r.ttl_days for r in t.collect()} | {"tape": 9, "s3": 1} and P.unregister_target(more, "tape").count() == 6
    assert P.organizer("frecency") is P.frecency and P.organizer("none") is None and P.organizer("") is None


def test_selectors():
    from tagloom.operators.monitor import PoolStats, parse_pool_stats

    assert parse_pool_stats("pool_stats://513.0:local:worker:3") == PoolStats("513.0", ("local",), "worker:3")
    assert parse_pool_stats("pool_stats://1.2:Range:0:4:bdev") == PoolStats("1.2", ("Range", "0", "4"), "bdev") and parse_pool_stats("pool_stats://1.2:physical:7") == PoolStats("1.2", ("physical", "7"), "")
    for bad in ("pool_stats://1.2", "pool_stats://x:local:y", "pool_stats://1.2:range:5", "stats://1.2:local:x"):
        with pytest.raises(ValueError):
            parse_pool_stats(bad)


def test_incremental_parity():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (4, 33), dtype=np.uint8)
    p = parity.encode(rows, 3)
    new = rng.integers(0, 256, 33, dtype=np.uint8)
    q = parity.update(p, 2, rows[2], new, 4)
    rows[2] = new
    assert (q == parity.encode(rows, 3)).all()


def test_specs_and_reaction():
    from tagloom.functions.patterns import gray_scott, parse_spec

    assert parse_spec("uniform:50,gaussian:50") == [("uniform", 0.5), ("gaussian", 0.5)] and [(k, round(s, 9)) for k, s in parse_spec("uniform:10,what:5,gaussian:30,x")] == [("uniform", 0.25), ("gaussian", 0.75)] and parse_spec("") == []
    v = gray_scott(32, 300)
    assert v.shape == (32, 32) and np.isfinite(v).all() and 0.05 < v.max() < 1 and (v == gray_scott(32, 300)).all()


def test_tiles_and_psnr_of_bytes(spark):
    from tagloom.operators.attributes import tile

    r = spark.createDataFrame([(250, 99, [0.0, 10.0], [0.0, 12.0])], "i int, j int, a array<double>, b array<double>").select(tile(F.col("i"), F.col("j")).alias("t"), A.psnr(F.col("a"), F.col("b"), True).alias("p")).first()
    assert tuple(r.t) == (2, 0) and abs(r.p - 10 * math.log10(255**2 / 2)) < 1e-9


def test_aggregation_classes(spark):
    from tagloom.operators.modules import Aggregation, aggregate

    class Longest(Aggregation):
        def zero(self):
            return (0, 0)

        def add(self, state, rows):
            return (state[0] + len(rows), max(state[1], int(rows["v"].max()) if len(rows) else 0))

        def merge(self, a, b):
            return (a[0] + b[0], max(a[1], b[1]))

    assert aggregate(spark.range(1000, numPartitions=3).selectExpr("id * 2 as v"), Longest()) == (1000, 1998)
    assert aggregate(spark.range(500, numPartitions=100).selectExpr("id as v"), Longest()) == (500, 499) and aggregate(spark.range(0).selectExpr("id as v"), Longest()) == (0, 0)
