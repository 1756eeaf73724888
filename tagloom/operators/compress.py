"""Choice of codecs: lookup tables of binned states, neighbours, regressions by group, and the cost of a workflow."""

from __future__ import annotations

import bz2
import lzma
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arraystats import groom

# Name, id on the wire, base id of the models, whether the codec has one mode only.
REGISTRY = (
    ("brotli", 0, 6, False), ("bzip2", 1, 1, False), ("blosc2", 2, 8, True), ("fpzip", 3, 12, False), ("lz4", 4, 3, False), ("lzma", 5, 5, False), ("snappy", 6, 7, True),
    ("sz3", 7, 11, False), ("zfp", 8, 10, False), ("zlib", 9, 4, False), ("zstd", 10, 2, False), ("nvcomp-lz4", 11, 13, True), ("nvcomp-snappy", 12, 14, True), ("nvcomp-zstd", 13, 15, True),
    ("nvcomp-gdeflate", 14, 16, True), ("nvcomp-deflate", 15, 17, True), ("nvcomp-ans", 16, 18, True), ("zfp-sycl", 17, 19, False), ("cusz", 18, 20, False), ("ndzip", 19, 21, True), ("cuszp", 20, 22, False),
)
ALIASES = {"blosc": "blosc2"}
PRESETS = ("fast", "balanced", "best")


def registry(spark: SparkSession) -> DataFrame:
    """(name, wire_id, base_id, single_mode, available) of every known codec."""
    return spark.createDataFrame([(*r, r[0] in CODECS) for r in REGISTRY], "name string, wire_id int, base_id int, single_mode boolean, available boolean")


def find_codec(name: str | None = None, wire_id: int | None = None, base_id: int | None = None) -> tuple | None:
    """The registry's row by name (in any case, or an alias) or by either id; None where there is none."""
    n = name and ALIASES.get(name.lower(), name.lower())
    return next((r for r in REGISTRY if n == r[0] or wire_id == r[1] or base_id == r[2]), None)


def _zstd(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level)


def _unzstd(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


#: Codecs that work here: compressors by preset, and the decompressor. zstd needs its module, on the executors too.
CODECS = {
    "zlib": ([lambda b, n=n: zlib.compress(b, n) for n in (1, 6, 9)], zlib.decompress),
    "bzip2": ([lambda b, n=n: bz2.compress(b, n) for n in (1, 6, 9)], bz2.decompress),
    "lzma": ([lambda b, n=n: lzma.compress(b, preset=n) for n in (0, 1, 9)], lzma.decompress),
    "zstd": ([lambda b, n=n: _zstd(n).compress(b) for n in (1, 3, 19)], _unzstd),
}


def _codec(name: str) -> tuple:
    row = find_codec(name)
    if row is None or row[0] not in CODECS:
        raise ValueError(f"no codec {name!r}")
    return CODECS[row[0]]


def compress(c: Column, codec: str, preset: str = "balanced") -> Column:
    f = _codec(codec)[0][PRESETS.index(preset)]
    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else f(bytes(b))), "binary")(c)


def decompress(c: Column, codec: str) -> Column:
    f = _codec(codec)[1]
    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else f(bytes(b))), "binary")(c)


def groomed(rows: DataFrame, key: str, array: str, digits: int = 3) -> DataFrame:
    """(key, groomed): the arrays of float32 with so many significant digits, all of a batch at once; null arrays stay null."""

    def run(batches):
        for b in batches:
            a = b.column(1)
            flat = a.flatten()
            new = pa.array(groom(flat.to_numpy(zero_copy_only=False), digits), pa.float32(), mask=flat.is_null().to_numpy(zero_copy_only=False))
            sizes = np.append(0, np.cumsum(pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False)))
            offsets = pa.array(sizes, pa.int32(), mask=np.append(a.is_null().to_numpy(zero_copy_only=False), False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, new)], names=[key, "groomed"])

    return rows.select(key, F.col(array).cast("array<float>").alias("_a")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, groomed array<float>")


def ratio(original: Column, compressed: Column) -> Column:
    """Original by compressed bytes; 1 where nothing was compressed."""
    return F.when(compressed == 0, 1.0).otherwise(original / compressed)


def workflow_ms(compress_ms: Column, decompress_ms: Column, size: Column, r: Column, bandwidth: Column, lossy_percent: Column | None = None) -> Column:
    """Time to compress, transfer and decompress; a lossy codec decompresses (1 + p/100) times."""
    d = decompress_ms if lossy_percent is None else (1 + lossy_percent / 100) * decompress_ms
    return compress_ms + d + size / r / bandwidth * 1000


def psnr_ok(psnr: Column, target: float) -> Column:
    """Lossless (0) candidates stay, others from the target on; no target keeps all."""
    return F.lit(target <= 0) | (psnr <= 0) | (psnr >= target)


def percentile_edges(rows: DataFrame, value: str, bins: int = 15, accuracy: int = 100_000) -> DataFrame:
    """(bin, edge): the values at floor(i / bins * n) of the order, without repeats, numbered from 0.

    A sketch brackets every wanted rank, one exact count says how many values lie below each bracket, and only the
    values inside the brackets, some ``bins`` / ``accuracy`` of all, are sorted. A bracket that misses its rank is
    widened until it holds it.
    """
    v = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    slack = 2.0
    while True:
        at = [(min(max(i / bins - slack / accuracy, 0.0), 1.0), min(i / bins + slack / accuracy, 1.0)) for i in range(1, bins)]
        got = v.agg(F.count("*"), F.percentile_approx("v", [p for pair in at for p in pair], accuracy)).first()
        total = got[0]
        if not total:
            return rows.sparkSession.createDataFrame([], f"edge {rows.schema[value].dataType.simpleString()}, bin int").select("edge", "bin")
        spans = sorted({(got[1][2 * k], got[1][2 * k + 1]) for k in range(bins - 1)})
        counts = v.agg(*[c for lo, hi in spans for c in (F.count_if(F.col("v") < lo), F.count_if(F.col("v") <= hi))]).first()
        wanted = [i * total // bins for i in range(1, bins)]
        held = [(k, lo, hi, r - counts[2 * k]) for r in wanted for k, (lo, hi) in enumerate(spans) if counts[2 * k] <= r < counts[2 * k + 1]]
        first = {(k, lo, hi): [x[3] for x in held if x[0] == k] for k, lo, hi, _ in held}
        if all(any(counts[2 * k] <= r < counts[2 * k + 1] for k in range(len(spans))) for r in wanted):
            break
        slack *= 16
    inside = v.select("v", F.explode(F.array_compact(F.array(*[F.when(F.col("v").between(lo, hi), F.lit(k)) for k, lo, hi in first]))).alias("k"))
    counted = inside.groupBy("k", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("k").orderBy("v")
    ends = counted.withColumn("end", F.sum("n").over(w))
    ranks = F.create_map(*[x for (k, _, _), r in first.items() for x in (F.lit(k), F.array(*[F.lit(y).cast("bigint") for y in r]))])
    edges = ends.where(F.exists(ranks[F.col("k")], lambda r: (r >= F.col("end") - F.col("n")) & (r < F.col("end")))).select(F.col("v").alias("edge")).distinct()
    return edges.withColumn("bin", F.row_number().over(Window.orderBy("edge")) - 1)  # fewer rows than bins


def bin_of(v: Column, edges: list[float]) -> Column:
    """Number of edges below the value: the position of the first edge that is not less."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < v)) if edges else F.lit(0)


def train_states(rows: DataFrame, state: list[str], targets: list[str]) -> DataFrame:
    return rows.groupBy(*state).agg(*[F.avg(t).alias(t) for t in targets], F.count("*").alias("n"))


def predict_states(rows: DataFrame, table: DataFrame, state: list[str], targets: list[str], k: int = 0) -> DataFrame:
    """Means of the row's state; where it is unknown, with ``k`` the mean over the k nearest known states, else that of all training rows. ``known`` tells which."""
    j = rows.join(table.withColumn("_hit", F.lit(True)), state, "left")
    overall = {t: table.agg(F.sum(F.col(t) * F.col("n")) / F.sum("n")).scalar() for t in targets}
    near = {}
    if k:
        known = table.withColumn("_sid", F.struct(*state)).withColumn("_sid", F.to_json("_sid"))
        lost = rows.select(*state).distinct().join(table.select(*state), state, "left_anti").withColumn("_qid", F.to_json(F.struct(*state)))
        means = nearest_states(lost, known, "_qid", state, "_sid", k).join(known.select("_sid", *targets), "_sid").groupBy("_qid").agg(*[F.avg(t).alias(f"_near_{t}") for t in targets])
        j = j.withColumn("_qid", F.to_json(F.struct(*state))).join(means, "_qid", "left")
        near = {t: [F.col(f"_near_{t}")] for t in targets}
    return j.select(*rows.columns, *[F.coalesce(F.col(t), *near.get(t, []), overall[t]).alias(t) for t in targets], F.coalesce("_hit", F.lit(False)).alias("known"))


def nearest_states(queries: DataFrame, states: DataFrame, query_id: str, dims: list[str], state_id: str, k: int = 5, block: int = 20_000) -> DataFrame:
    """(query, place, distance, state) of the k nearest states by Euclidean distance, ties in order of ``dims``, then of the state's id.

    Each batch of queries meets the states as a matrix; no pairs become rows. Up to ``block`` states are sent to the
    tasks at once. If there are more, the queries meet them block by block, and the best k of each block are merged.
    """
    order = [*dims, state_id]
    n = states.count()
    blocks = max(1, -(-n // block))
    kinds = (queries.schema[query_id].dataType.simpleString(), states.schema[state_id].dataType.simpleString())
    schema = f"{query_id} {kinds[0]}, place int, distance double, {state_id} {kinds[1]}, " + ", ".join(f"_d{i} double" for i in range(len(dims)))
    out = None
    for i in range(blocks):
        mine = states if blocks == 1 else states.where(F.pmod(F.xxhash64(state_id), F.lit(blocks)) == i)
        table = mine.select(state_id, *dims).orderBy(*order).toPandas()
        shared = queries.sparkSession.sparkContext.broadcast((table[state_id].to_numpy(), table[dims].to_numpy(float)))

        def run(frames, shared=shared):
            ids, at = shared.value
            m = min(k, len(ids))
            for df in frames:
                for lo in range(0, len(df), 1024):
                    part = df.iloc[lo : lo + 1024]
                    q = part[dims].to_numpy(float)
                    d = np.zeros((len(part), len(ids)))
                    for j in range(len(dims)):
                        d += (q[:, j : j + 1] - at[None, :, j]) ** 2
                    d = np.sqrt(d)
                    best = np.argsort(d, axis=1, kind="stable")[:, :m]
                    got = {query_id: np.repeat(part[query_id].to_numpy(), m), "place": np.tile(np.arange(1, m + 1), len(part)), "distance": np.take_along_axis(d, best, axis=1).ravel(), state_id: ids[best].ravel()}
                    yield pd.DataFrame({**got, **{f"_d{j}": at[best, j].ravel() for j in range(len(dims))}})

        part = queries.select(query_id, *dims).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        w = Window.partitionBy(query_id).orderBy("distance", *[f"_d{j}" for j in range(len(dims))], state_id)
        out = out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return out.select(query_id, "place", "distance", state_id)


def ols_by_group(rows: DataFrame, group: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Slope, intercept and R2 of each group of at least ``least`` rows; slope 0 without variance of x, R2 0 without of y."""
    g = rows.groupBy(*group).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("s"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.corr(x, y).alias("r")).where(F.col("n") >= least)
    slope = F.when(F.col("vx") < 1e-10, 0.0).otherwise(F.col("s"))
    return g.select(*group, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.when((F.col("vy") < 1e-10) | (F.col("vx") < 1e-10), 0.0).otherwise(F.col("r") * F.col("r")).alias("r2"))


def best_codec(candidates: DataFrame, key: str, measure: str, order: str, largest: bool) -> DataFrame:
    """One candidate per key: the best by the measure, the first in order of equals."""
    by = F.struct(F.col(measure) if largest else -F.col(measure), -F.col(order))
    return candidates.groupBy(key).agg(F.max_by(F.struct(*[c for c in candidates.columns if c != key]), by).alias("b")).select(key, "b.*")


def reward(d_ratio: Column, d_time: Column, d_psnr: Column) -> Column:
    return -(d_ratio * d_ratio + 0.5 * d_time * d_time + 0.1 * d_psnr * d_psnr)


def schedule(blobs: DataFrame, key: str, payload: str, sample: int | None = None, codecs: tuple[str, ...] = ("zlib", "bzip2", "lzma")) -> DataFrame:
    """Per blob and codec (the same ones on every machine), the ratio on the whole payload (or its first ``sample`` bytes; the reference takes 65,536), and whether to keep the original, since compressing makes it no smaller."""
    able = [(n, _codec(n)[0][1]) for n in codecs]

    def run(frames):
        for df in frames:
            out = []
            for k, b in zip(df[key], df[payload]):
                raw = bytes(b or b"")[:sample]
                for i, (n, f) in enumerate(able):
                    c = len(f(raw)) if raw else 0
                    out.append((k, n, i, len(raw), c, len(raw) / c if c else 1.0, c >= len(raw)))
            yield pd.DataFrame(out, columns=[key, "codec", "place", "bytes", "packed_bytes", "ratio", "keep_original"])

    kind = blobs.schema[key].dataType.simpleString()
    return blobs.select(key, payload).mapInPandas(run, f"{key} {kind}, codec string, place int, bytes bigint, packed_bytes bigint, ratio double, keep_original boolean")
