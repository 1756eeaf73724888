"""Ordered work on keys of any size: rows sorted by (key, order) over all tasks, and what one part hands to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


MOST = 1_000_000  # rows of a key up to which one task may sort them; they spill beyond its memory


def any_hot(rows: DataFrame, key: str, most: int) -> bool:
    """Whether any key has more rows than that; counts are added up before they are exchanged."""
    return not rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).isEmpty()


def in_parts(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows with ``_part``: sorted by range, so that a hot key is many parts. Kept, since the parts' bounds must be drawn once."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()).checkpoint()


def numbered(rows: DataFrame, key: str, order: list[str], size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """For keys of any size, (rows, carried): the rows with ``_part``, ``_n`` (number in the key's order, from 1) and ``_off`` (sum of ``size`` before the row).

    ``carried`` (key, _part, _n0, _sum0) says what a key had before each part that it goes on in: at most one row
    per part, so it can be broadcast.
    """
    parts = in_parts(rows, key, order)
    add = F.sum(size) if size else F.lit(0)
    totals = parts.groupBy("_part", key).agg(F.count("*").alias("_c"), (add if size else F.sum(F.lit(0))).alias("_s"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.sum("_c").over(before).alias("_n0"), F.sum("_s").over(before).alias("_sum0")).where("_n0 is not null")
    w = Window.partitionBy("_part", key).orderBy(*order)
    off = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if size else F.lit(0)
    own = parts.select("*", F.row_number().over(w).alias("_i"), off.alias("_o"))
    j = own.join(F.broadcast(carried), F.col("_key").eqNullSafe(F.col(key)) & (F.col("_p") == F.col("_part")), "left")
    out = j.select(*rows.columns, "_part", (F.coalesce("_n0", F.lit(0)) + F.col("_i")).alias("_n"), (F.coalesce("_sum0", F.lit(0)) + F.col("_o")).alias("_off"))
    return out, carried
