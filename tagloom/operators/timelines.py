"""Splitting of the timelines of hot sources, so that no task gets an unbounded group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANY = 10_000  # hot keys up to which their table is sent to every task (some 100 bytes each)
SALTS = 16


@dataclass
class Cuts:
    """Hot keys' timelines: (key, t0, width, n_seg); ``few``: at most MANY of them, in a local table."""

    table: DataFrame
    few: bool


def cuts(sizing: DataFrame, key: str, ts: str, max_rows: int, width_s: int, many: int = MANY, counts: DataFrame | None = None) -> Cuts | None:
    """The keys with more than ``max_rows`` rows and how they are cut, None where there are none.

    Counts are taken first, from the key column alone; ends of time only of the keys that are hot. A hot key's span
    is cut into equal segments of about ``max_rows`` rows, but of no less than ``width_s`` seconds. Up to ``many``
    keys the table is a local one, beyond them it stays distributed. ``counts``: (key, n), if they are at hand.
    """
    n = (sizing.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts).where(F.col("n") > max_rows)
    found = [r[0] for r in n.select(key).limit(many + 1).collect()]
    if not found:
        return None
    few = len(found) <= many
    some = sizing.where(F.col(key).isin(found)) if few else sizing.join(n.select(key), key, "left_semi")
    ends = some.where(F.col(ts).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(F.unix_seconds(ts)).alias("t0"), F.max(F.unix_seconds(ts)).alias("t1"))
    span = F.col("t1") - F.col("t0") + 1
    n_seg = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / max_rows), F.floor(span / width_s))).cast("int")
    table = ends.select(key, "t0", F.ceil(span / n_seg).cast("bigint").alias("width"), n_seg.alias("n_seg"))
    return Cuts(sizing.sparkSession.createDataFrame(table.collect(), table.schema) if few else table, few)


def split_hot(rows: DataFrame, key: str, ts: str, hot: Cuts | None, context_s: int) -> DataFrame:
    """Adds ``seg`` (segment of the key's timeline) and ``core`` (whether the row belongs to it or is its context).

    Keys that aren't hot have one segment. Each segment also gets the rows up to
    ``context_s`` before and after it. A local table is broadcast, since it has at most MANY rows; a distributed one
    is joined by key and one of SALTS salts.
    """
    if hot is None:
        return rows.withColumn("seg", F.lit(0)).withColumn("core", F.lit(True))
    at = F.unix_seconds(ts) - F.col("t0")
    seg = lambda x: F.greatest(F.lit(0), F.least(F.col("n_seg") - 1, F.floor(x / F.col("width")))).cast("int")
    if hot.few:
        joined = rows.join(F.broadcast(hot.table), key, "left")
    else:
        salted = hot.table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64(ts), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], "left").drop("_salt")
    one = F.col("n_seg").isNull() | F.col(ts).isNull()
    joined = joined.withColumn("own", F.when(one, 0).otherwise(seg(at)))
    spread = joined.withColumn("seg", F.explode(F.when(one, F.array(F.lit(0))).otherwise(F.sequence(seg(at - context_s), seg(at + context_s)))))
    return spread.withColumn("core", F.col("seg") == F.col("own")).drop("own", "t0", "width", "n_seg")
