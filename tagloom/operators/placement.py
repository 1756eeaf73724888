"""Scores and placement over storage targets: order, eligibility, reorganisation, draining, estimated times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small

# The sizes, half-life, weights and bounds below.
BIG = 32768  # from so many bytes on, bandwidth decides, below latency


def frecency(age_s: Column, accesses: Column) -> Column:
    """Half for recency with a half-life of 600 s, half for n/(n+10); a negative age counts 0; a FLOAT within 0 and 1."""
    s = 0.5 * F.pow(F.lit(2.0), -F.greatest(age_s, F.lit(0.0)) / 600) + 0.5 * accesses / (accesses + 10.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)).cast("float")


def bandwidth_score(read_bw: Column, write_bw: Column, manual: Column | None = None) -> Column:
    """ln(max bandwidth + 1) / ln(1001) within 0 and 1; null where there is no bandwidth; a manual score wins."""
    bw = F.greatest(read_bw, write_bw)
    own = F.when(bw > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log(bw + 1) / F.log(F.lit(1001.0)))))
    return own if manual is None else F.coalesce(manual, own)


def score_bandwidth(score: Column) -> Column:
    """1001^score - 1, held within 1e6 and 1e10; so any positive score up to 1 gives 1e6."""
    return F.greatest(F.lit(1e6), F.least(F.lit(1e10), F.pow(F.lit(1001.0), score) - 1))


def moves(current: Column, new: Column, threshold: float = 0.05) -> Column:
    """Whether a re-scored blob moves: scores within 0 and 1, and a difference not below the threshold."""
    return new.between(0.0, 1.0) & ~(F.abs(new - current) < threshold)


def eligible(ttl_days: Column, persistence: Column, least_level: int = 0) -> Column:
    """More than 7 days to live, or 1 to 7 on a target that isn't long-term (level 2); at the least level or above."""
    return (persistence >= least_level) & ((ttl_days > 7) | ((ttl_days >= 1) & (persistence < 2)))


def to_drain(ttl_days: Column, persistence: Column) -> Column:
    return (ttl_days < 1) | ((ttl_days <= 7) & (persistence >= 2))


def register_target(targets: DataFrame, row: dict) -> DataFrame:
    """The targets with one more, or with a new row in place of the one of that name; columns it doesn't give are null."""
    new = targets.sparkSession.createDataFrame([tuple(row.get(c) for c in targets.columns)], targets.schema)
    return unregister_target(targets, row["name"]).unionByName(new)


def unregister_target(targets: DataFrame, name: str) -> DataFrame:
    return targets.where(~F.col("name").eqNullSafe(name))


def placement_order(targets: DataFrame, size: int, blob_score: float) -> DataFrame:
    """Targets with room in the order they are tried, as ``place`` from 1.

    First those that score no more than the blob, the fastest first; then the others, the slowest first. Speed is
    write bandwidth for large data and the mean latency for small. Ties go by name.
    """
    speed = F.col("write_bw") if size >= BIG else -(F.col("read_lat") + F.col("write_lat")) / 2
    grp = F.when(F.col("target_score") <= blob_score, 1).otherwise(2)
    t = targets.where(F.col("remaining_space") >= size).withColumn("grp", grp).withColumn("_s", speed)
    w = Window.orderBy("grp", F.when(F.col("grp") == 1, -F.col("_s")).otherwise(F.col("_s")), "name")  # a dimension of few rows
    return t.withColumn("place", F.row_number().over(w)).drop("_s")


def round_robin_order(targets: DataFrame, size: int, blob_score: float, counter: int) -> DataFrame:
    """The same groups, each rotated by a counter over its names."""
    t = targets.where(F.col("remaining_space") >= size).withColumn("grp", F.when(F.col("target_score") <= blob_score, 1).otherwise(2))
    g = Window.partitionBy("grp")
    t = t.withColumn("_i", F.row_number().over(g.orderBy("name")) - 1).withColumn("_n", F.count("*").over(g))
    return t.withColumn("place", F.row_number().over(Window.orderBy("grp", F.pmod(F.col("_i") - counter, F.col("_n"))))).drop("_i", "_n")


def random_order(targets: DataFrame, size: int, blob_score: float, seed: int) -> DataFrame:
    """The same groups, each in an order drawn by the seed."""
    t = targets.where(F.col("remaining_space") >= size).withColumn("grp", F.when(F.col("target_score") <= blob_score, 1).otherwise(2))
    return t.withColumn("place", F.row_number().over(Window.orderBy("grp", F.xxhash64(F.lit(seed), "name"))))


#: Policies by name; an unknown name means random.
POLICIES = {"max_bw": lambda t, n, s, c: placement_order(t, n, s), "round_robin": round_robin_order, "random": random_order}


def place(targets: DataFrame, policy: str, size: int, blob_score: float, counter: int = 0) -> DataFrame:
    return POLICIES.get(policy, random_order)(targets, size, blob_score, counter)


NO_TARGETS, NONE_ELIGIBLE, NO_SPACE = 1, 2, 3  # return codes of an extension


def extend_blob(blocks: list[tuple[str, int, int]], required: int, targets: DataFrame, blob_score: float, least_level: int = 0, slab: int = 4096, small_bytes: int = 65536) -> tuple[int, list[tuple[str, int, int]]]:
    """(return code, blocks) of a blob of (target, size, capacity) blocks after it grows to ``required`` bytes.

    First the last block's spare capacity is used, then new blocks go to the healthy targets in placement order;
    blocks of at most ``small_bytes`` get capacities of whole slabs. A blob's blocks are few, so this runs in place.
    """
    out = list(blocks)
    need = required - sum(b[1] for b in out)
    if need > 0 and out:
        t, n, cap = out[-1]
        fill = min(max(cap - n, 0), need)
        out[-1], need = (t, n + fill, cap), need - fill
    if need <= 0:
        return 0, out
    if targets.isEmpty():
        return NO_TARGETS, out
    fit = targets.where(eligible(F.col("ttl_days"), F.col("persistence"), least_level))
    if fit.isEmpty():
        return NONE_ELIGIBLE, out
    for r in placement_order(fit, 1, blob_score).orderBy("place").select("name", "remaining_space").toLocalIterator():
        n = min(need, r["remaining_space"])
        cap = -(-n // slab) * slab if n <= small_bytes else n
        out.append((r["name"], n, min(cap, r["remaining_space"])))
        need -= n
        if need <= 0:
            return 0, out
    return NO_SPACE, out


def reorganize(blobs: DataFrame, scores: DataFrame, threshold: float = 0.05) -> DataFrame:
    """The blobs with (tag_name, blob_name, score) applied, and ``rc``: 1 for a score beyond 0 to 1, 3 for no such blob; null without a request, else 0."""
    new = scores.select("tag_name", "blob_name", F.col("score").alias("_new"))
    j = blobs.withColumn("_here", F.lit(True)).join(new, ["tag_name", "blob_name"], "full")
    rc = F.when(F.col("_new").isNull(), F.lit(None)).when(~F.col("_new").between(0.0, 1.0), 1).when(F.col("_here").isNull(), 3).otherwise(0)
    score = F.when(F.col("_here") & moves(F.col("score"), F.col("_new"), threshold), F.col("_new")).otherwise(F.col("score"))
    return j.select(*[score.alias(c) if c == "score" else F.col(c) for c in blobs.columns], rc.cast("int").alias("rc"))


ORGANIZERS = {"frecency": frecency}  #: score expressions by name


def organizer(name: str):
    """The organizer of that name; None for none, an empty or an unknown name."""
    return ORGANIZERS.get(name)


def flush(blocks: DataFrame, targets: DataFrame, level: int) -> DataFrame:
    """(tag_name, blob_name, bytes, target): where each blob with blocks below the level goes, as a whole.

    The first target with room, healthy and at the level or above, in placement order for a score of 1; null where
    there is none. Targets are a dimension.
    """
    to = placement_order(targets.where(eligible(F.col("ttl_days"), F.col("persistence"), level)), 1, 1.0).orderBy("place").limit(1).select("name").first()
    out = flush_candidates(blocks, targets.withColumnRenamed("name", "target"), level)
    return out.select("tag_name", "blob_name", "bytes", F.lit(to and to[0]).cast("string").alias("target"))


def drain(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """(tag_name, blob_name, score): the blobs on targets that are to be drained, re-scored so that they move."""
    return drain_candidates(blocks, targets).withColumn("score", F.lit(0.99))


def allocate(ordered: DataFrame, size: int, slab: int = 4096, small: int = 65536) -> DataFrame:
    """Blocks of a blob over ordered targets: each takes what it can until the size, small ones in whole slabs, is met."""
    need = -(-size // slab) * slab if size <= small else size
    w = Window.orderBy("place")
    before = F.coalesce(F.sum("remaining_space").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered.withColumn("block_offset", before).where(F.col("block_offset") < need).withColumn("block_bytes", F.least(F.col("remaining_space"), F.lit(need) - F.col("block_offset")))


def flush_candidates(blocks: DataFrame, targets: DataFrame, level: int) -> DataFrame:
    """Blobs with at least one block on a target below the persistence level, with their bytes and such blocks."""
    low = F.col("persistence") < level
    j = blocks.join(small(targets.select("target", "persistence")), "target", "left")
    per = j.groupBy("tag_name", "blob_name").agg(F.sum("bytes").alias("bytes"), F.count_if(low).alias("volatile_blocks"))
    return per.where("volatile_blocks > 0 and bytes > 0")


def io_time(blocks: DataFrame, targets: DataFrame, bw: str, lat: str, default_bw: float, default_lat: float) -> DataFrame:
    """Nanoseconds of each blob: over its targets the longest of latency plus bytes by bandwidth.

    Unknown targets, and figures of 0, count as the defaults (MB/s, microseconds). The blocks are exchanged once, by
    blob, which serves the sums per target as well.
    """
    j = blocks.join(small(targets.select("target", F.nullif(F.col(bw), F.lit(0.0)).alias("_bw"), F.nullif(F.col(lat), F.lit(0.0)).alias("_lat"))), "target", "left")
    per = j.repartition("tag_name", "blob_name").groupBy("tag_name", "blob_name", "target").agg(F.sum("bytes").alias("bytes"), F.coalesce(F.max("_bw"), F.lit(default_bw)).alias("bw"), F.coalesce(F.max("_lat"), F.lit(default_lat)).alias("lat"))
    ns = F.col("lat") * 1e3 + F.col("bytes") / (F.col("bw") * 1048576) * 1e9
    return per.groupBy("tag_name", "blob_name").agg(F.max(ns).alias("ns"))


def drain_candidates(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """Blobs with a block on a target that is to be drained."""
    bad = targets.where(to_drain(F.col("ttl_days"), F.col("persistence"))).select("target")
    return blocks.join(small(bad), "target", "left_semi").select("tag_name", "blob_name").distinct()


def consumers(reads: DataFrame, tag: str, node: str, order: str, cap: int) -> DataFrame:
    """Distinct readers of each tag in the order they first came, the first ``cap``; ``last`` marks the last of them."""
    first = reads.groupBy(tag, node).agg(F.min(order).alias("first_seen"))
    w = Window.partitionBy(tag).orderBy("first_seen", node)
    kept = first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
    return kept.withColumn("last", F.col("place") == F.max("place").over(Window.partitionBy(tag)))
