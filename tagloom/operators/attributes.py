"""Aliases, extended attributes, times and listings of tags as files; merges over replicas and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors
from .catalog import DIR_MARK


def with_alias(aliases: DataFrame, tags: DataFrame, alias: str, target: str) -> DataFrame:
    """(alias, tag_name) with one more name; an existing alias, or a target that isn't there, changes nothing."""
    new = tags.where(F.col("tag_name") == target).select(F.lit(alias).alias("alias"), "tag_name").distinct()
    return aliases.unionByName(new.join(aliases.select("alias"), "alias", "left_anti").select("alias", "tag_name"))


def alias_counts(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    return tags.select("tag_name").distinct().join(aliases.groupBy("tag_name").agg(F.count("*").alias("n")), "tag_name", "left").select("tag_name", F.coalesce("n", F.lit(0)).alias("n_aliases"))


def unlink(tags: DataFrame, aliases: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Removes a name: an alias goes alone; a tag with aliases lives on under the first of them; else it goes."""
    heir = aliases.where(F.col("tag_name") == name).agg(F.min("alias")).scalar()
    own = F.col("tag_name") == name
    t = tags.withColumn("tag_name", F.when(own, heir).otherwise(F.col("tag_name"))).where("tag_name is not null")
    a = aliases.withColumn("_heir", heir).where((F.col("alias") != name) & ~(own & (F.col("alias") == F.col("_heir")))).withColumn("tag_name", F.when(own, F.col("_heir")).otherwise(F.col("tag_name"))).drop("_heir")
    return t, a


def xattr_set(attrs: Column, name: str, value: bytes, mode: str = "any") -> Column:
    """The map with the attribute set; ``create`` keeps an existing one, ``replace`` adds none."""
    have = F.coalesce(F.map_contains_key(attrs, F.lit(name)), F.lit(False))
    base = F.coalesce(F.map_filter(attrs, lambda k, _: k != name), F.create_map().cast("map<string,binary>"))
    new = F.map_concat(base, F.create_map(F.lit(name), F.lit(value)))
    if mode == "create":
        return F.when(have, attrs).otherwise(new)
    if mode == "replace":
        return F.when(have, new).otherwise(attrs)
    return new


def xattr_remove(attrs: Column, name: str) -> Column:
    return F.map_filter(attrs, lambda k, _: k != name)


def stat(blobs: DataFrame) -> DataFrame:
    """Per absolute path, also of directories that only their children name: whether it is a directory (the marker or children), its own size and latest time."""
    path = F.concat(F.when(~F.col("tag_name").startswith("/"), F.lit("/")).otherwise(F.lit("")), "tag_name")
    each = blobs.where("tag_name is not null").select(path.alias("_own"), F.explode(ancestors(path)).alias("path"), "blob_name", "size", "last_modified")
    mine = F.col("_own") == F.col("path")
    return each.groupBy("path").agg(F.max(F.coalesce(~mine | (F.col("blob_name") == DIR_MARK), F.lit(False))).alias("is_dir"), F.coalesce(F.sum(F.when(mine, F.col("size"))), F.lit(0)).alias("size"), F.max(F.when(mine, F.col("last_modified"))).alias("last_modified"))


def merge_replicas(parts: DataFrame, key: str) -> DataFrame:
    """Replicas of one tag: sizes add up, the latest time wins, found where any replica has it."""
    return parts.groupBy(key).agg(F.sum("size").alias("size"), F.max("last_modified").alias("last_modified"), F.max("found").alias("found"))


def collective(rows: DataFrame, group: list[str], ts: str, width_s: int, value: str) -> DataFrame:
    """Each member's row with the sum over its group's batch of ``width_s`` seconds, counted from the epoch."""
    w = Window.partitionBy(*group, F.floor(F.unix_seconds(ts) / width_s))
    return rows.withColumn("batch_sum", F.sum(value).over(w)).withColumn("batch_size", F.count("*").over(w))


def complete_groups(rows: DataFrame, group: str, member: str, size: int) -> DataFrame:
    """Groups whose distinct members have all come."""
    return rows.groupBy(group).agg(F.countDistinct(member).alias("n")).where(F.col("n") == size)


def one_hot(c: Column, names: list[str], prefix: str) -> list[Column]:
    return [F.when(c == n, 1.0).otherwise(0.0).alias(f"{prefix}_{n}") for n in names]


# The order of a codec model's features.
FEATURES = ("chunk_bytes", "cpu_percent", "entropy", "mad", "second_derivative", "library", "fast", "balanced", "best", "char", "float")


def feature_vector(chunk_bytes: Column, cpu_percent: Column, entropy: Column, mad: Column, second: Column, library: Column, preset: Column, kind: Column) -> Column:
    """The eleven features as floats, in order: five measures, the library's number, preset and data type one-hot."""
    own = [chunk_bytes, cpu_percent, entropy, mad, second, library, *[F.when(preset == p, 1.0).otherwise(0.0) for p in ("fast", "balanced", "best")], *[F.when(kind == k, 1.0).otherwise(0.0) for k in ("char", "float")]]
    return F.array(*[c.cast("float") for c in own])


def tile(i: Column, j: Column, size: int = 100) -> Column:
    """Key of the tile of ``size`` by ``size`` that a cell lies in."""
    return F.struct(F.floor(i / size).cast("int").alias("row"), F.floor(j / size).cast("int").alias("col"))


def slice_array(rows: DataFrame, key: str, array: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """(key, index, value) of a range of each array; out of range leaves nothing."""
    last = F.least(F.size(array), F.lit(stop)) - 1
    at = F.when((F.size(array) > 0) & (last >= start), F.sequence(F.lit(start), last, F.lit(step)))
    return rows.select(key, F.explode(F.transform(at, lambda i: F.struct(i.alias("index"), F.get(array, i).alias("value")))).alias("e")).select(key, "e.*")
