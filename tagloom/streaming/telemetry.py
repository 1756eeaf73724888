"""Streams of telemetry: windows of event time, batches, barriers, ordered appends, promotion of models."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch


def source(spark: SparkSession, path: str, schema, per_batch: int = 16) -> DataFrame:
    """Append-only Parquet as a stream, so many files a batch; ``path`` is a folder, or one file of a folder.

    Times without zone are read as UTC instants where the session's zone is UTC, since watermarks need instants.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    spot = spark._jvm.org.apache.hadoop.fs.Path(path)
    if spot.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spot).isFile():
        folder, _, name = path.rpartition("/")
        df = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        df = reader.parquet(path)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def windowed(stream: DataFrame, ts: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per window of event time and key; rows later than the watermark are left out."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def batches_from_first(stream: DataFrame, key: str, ts: str, width_s: int, late: str = "0 seconds") -> DataFrame:
    """Tumbling batches per key that open with the first event after the last batch; one row per closed batch.

    State: start and size of the open batch. Within a micro-batch a key's events are taken in order of time. A batch
    closes with the key's first event beyond its end, or when the watermark (the latest event of any key less
    ``late``) passes its end, so the last one comes out too.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (0, 0)
        out = []
        if state.hasTimedOut:
            out.append((k[0], start, n))
            state.remove()
        else:
            for t in sorted(int(t.value // 1000) for f in frames for t in f[ts]):
                if n and t >= start + width_s * 1_000_000:
                    out.append((k[0], start, n))
                    n = 0
                if not n:
                    start = t
                n += 1
            state.update((start, n))
            state.setTimeoutTimestamp(max(start // 1000 + width_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "start_us", "n"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, ts).withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, start_us bigint, n bigint", "start bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def barrier(stream: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """One row per key each time all ``size`` members have arrived; each round counts a member once."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rounds, seen = state.get if state.exists else (0, [])
        have = set(seen)
        out = []
        for f in frames:
            for m in f[member]:
                have.add(int(m))
                if len(have) >= size:
                    rounds += 1
                    out.append((k[0], rounds))
                    have.clear()
        state.update((rounds, sorted(have)))
        yield pd.DataFrame(out, columns=[key, "round"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, member).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, round bigint", "rounds bigint, seen array<bigint>", "append", GroupStateTimeout.NoTimeout)


def promotions(stream: DataFrame, key: str, least: int = 7) -> DataFrame:
    """One row per key when its history reaches ``least`` rows: from then on its rolling model serves."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = state.get[0] if state.exists else 0
        now = had + sum(len(f) for f in frames)
        state.update((now,))
        yield pd.DataFrame([(k[0], now)] if had < least <= now else [], columns=[key, "n"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint", "n bigint", "append", GroupStateTimeout.NoTimeout)


def appended(stream: DataFrame, tag: str, order: list[str], size: str) -> DataFrame:
    """Deferred appends with their sequence number and offset; each file goes on where its last micro-batch ended.

    State: the file's tail, as bytes and entries. Within a micro-batch a file's entries are taken in their order.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("seq", T.LongType()), T.StructField("offset", T.LongType())])

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, seq = state.get if state.exists else (0, 0)
        df = pd.concat(list(frames)).sort_values(order, kind="stable")
        sizes = df[size].fillna(0).astype("int64")
        df["seq"] = range(seq + 1, seq + 1 + len(df))
        df["offset"] = end + sizes.cumsum() - sizes
        state.update((end + int(sizes.sum()), seq + len(df)))
        yield df

    return stream.groupBy(tag).applyInPandasWithState(step, schema, "tail bigint, entries bigint", "append", GroupStateTimeout.NoTimeout)


def append_batches(stream: DataFrame, tag: str, order: list[str], size: str, out: str, checkpoint: str):
    """Runs :func:`appended` over what is there now and writes it, each micro-batch once."""
    return appended(stream, tag, order, size).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns the written rows.

    ``folder`` must be shared on a cluster; default: below spark.checkpoint.dir where it is set, else a local one.
    """
    spark = stream.sparkSession
    spot = f"{folder.rstrip('/')}/stream-{uuid.uuid4()}" if folder else scratch(spark, "stream")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{spot}/out").option("checkpointLocation", f"{spot}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{spot}/out")
