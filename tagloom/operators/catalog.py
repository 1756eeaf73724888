"""The (tag, blob) catalog: views, mutations, files as pages, hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors, parent_path
from .ranges import MOST, any_hot, numbered

PAGE = 1 << 20
DIR_MARK = ".__dir__"


def blobs_of(documents: DataFrame) -> DataFrame:
    """tag_name, blob_name, doc_id, payload (bytes), size in bytes, last_modified; texts that are null have size 0."""
    return documents.select("tag_name", "blob_name", "doc_id", F.col("text").cast("binary").alias("payload"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"), "last_modified")


def tags_of(blobs: DataFrame) -> DataFrame:
    """tag_name, n_blobs, total_size, last_modified: sums and maxima, so replicas merge without order."""
    return blobs.groupBy("tag_name").agg(F.count("*").alias("n_blobs"), F.sum("size").alias("total_size"), F.max("last_modified").alias("last_modified"))


def put_blob(old: Column, data: Column, offset: Column, replace: bool = False) -> Column:
    """Bytes after writing ``data`` at ``offset``: a gap is filled with zeros; without ``replace`` the blob never shrinks."""
    old = F.coalesce(old, F.lit(b""))
    n = F.length(old)
    head = F.when(n >= offset, F.substring(old, F.lit(1), offset)).otherwise(F.concat(old, zeros(offset - n)))
    tail = F.lit(b"") if replace else F.when(n > offset + F.length(data), F.substring(old, offset + F.length(data) + 1, n)).otherwise(F.lit(b""))
    return F.concat(head, data, tail)


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n, F.lit(0)).cast("int")))


def put_status(name: Column, data: Column, score: Column) -> Column:
    """Return code of a put: 4 no name, 3 no data, 2 no bytes, 5 a score above 1, else 0."""
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, 4).when(data.isNull(), 3).when(F.length(data) == 0, 2).when(score > 1, 5).otherwise(0)


def put_blobs(blobs: DataFrame, puts: DataFrame) -> DataFrame:
    """The catalog after (tag_name, blob_name, data, offset, score, replace), at most one put of a blob.

    Puts that put_status refuses change nothing. A score below 0 (or none) keeps the blob's, or is 1 for a new one;
    every put counts as an access. Catalogs without score or accesses get them.
    """
    old = blobs
    for c, v in (("score", F.lit(1.0)), ("access_count", F.lit(0).cast("bigint"))):
        if c not in old.columns:
            old = old.withColumn(c, v)
    rc = put_status(F.col("blob_name"), F.col("data"), F.coalesce("score", F.lit(-1.0)))
    good = puts.where((rc == 0) & F.col("tag_name").isNotNull()).select("tag_name", "blob_name", "data", F.coalesce("offset", F.lit(0)).alias("_off"), F.col("score").alias("_score"), F.coalesce("replace", F.lit(False)).alias("_rep"))
    j = old.join(good, ["tag_name", "blob_name"], "full")
    hit = F.col("data").isNotNull()
    new = F.when(F.col("_rep"), put_blob(F.col("payload"), F.col("data"), F.col("_off"), True)).otherwise(put_blob(F.col("payload"), F.col("data"), F.col("_off")))
    j = j.withColumn("payload", F.when(hit, new).otherwise(F.col("payload"))).withColumn("size", F.when(hit, F.length("payload").cast("bigint")).otherwise(F.col("size")))
    j = j.withColumn("score", F.when(hit & (F.col("_score") >= 0), F.col("_score")).otherwise(F.coalesce("score", F.lit(1.0)))).withColumn("access_count", F.coalesce("access_count", F.lit(0)) + hit.cast("bigint"))
    return j.withColumn("last_modified", F.when(hit, F.current_timestamp()).otherwise(F.col("last_modified"))).select(*old.columns)


def get_blob(payload: Column, offset: Column, size: Column) -> Column:
    """``size`` bytes from ``offset`` on; less at the end."""
    return F.substring(payload, offset + 1, size)


def truncate_blob(payload: Column, size: Column) -> Column:
    n = F.length(payload)
    return F.when(n >= size, F.substring(payload, F.lit(1), size)).otherwise(F.concat(payload, zeros(size - n)))


def replay(log: DataFrame, keys: list[str], seq: str, op: str, deletes: tuple[str, ...] = ("delete",)) -> DataFrame:
    """State after a change log: the last record of each key, without keys whose last record deletes."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in log.columns if c not in keys]), F.col(seq)).alias("r"))
    return last.select(*keys, "r.*").where(~F.col(op).isin(*deletes))


def materialized_paths(paths: DataFrame, path: str) -> DataFrame:
    """Every path and directory above it, once each, with its parent (null for the root)."""
    each = paths.select(F.explode(ancestors(F.col(path))).alias("path")).distinct()
    return each.select("path", F.when(F.col("path") != "/", parent_path(F.col("path"))).alias("parent"))


def rename_subtree(rows: DataFrame, path: str, old: str, new: str) -> DataFrame:
    p = F.col(path)
    return rows.withColumn(path, F.when(p == old, F.lit(new)).when(p.startswith(old + "/"), F.concat(F.lit(new), F.substring(p, len(old) + 1, 1 << 30))).otherwise(p))


def delete_tag(blobs: DataFrame, aliases: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(blobs, aliases) after a name is deleted: an alias goes alone; a tag goes with its subtree and every alias of that."""
    if not aliases.where(F.col("alias") == name).isEmpty():
        return blobs, aliases.where(F.col("alias") != name)
    below = (F.col("tag_name") == name) | F.col("tag_name").startswith(name + "/")
    return blobs.where(~F.coalesce(below, F.lit(False))), aliases.where(~below)


def insert_paths(paths: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
    """The paths with ``new`` ones and the directories above them, each once."""
    return paths.select(path).unionByName(new.select(F.explode(ancestors(F.col(path))).alias(path))).distinct()


def prune_empty(rows: DataFrame, path: str, leaf: Column) -> DataFrame:
    """Without the directories that no leaf lies below (or is): what remains when a deletion empties their ancestors."""
    held = rows.where(leaf).select(F.explode(ancestors(F.col(path))).alias(path)).distinct()
    return rows.join(held, path, "left_semi")


def delete_subtree(rows: DataFrame, path: str, root: str) -> DataFrame:
    p = F.col(path)
    return rows.where(~((p == root) | p.startswith(root + "/")))


def children(rows: DataFrame, path: str, directory: str) -> DataFrame:
    """Names directly below a directory, without the directory marker."""
    pre = directory.rstrip("/") + "/"
    rest = F.substring(F.col(path), len(pre) + 1, 1 << 30)
    return rows.where(F.col(path).startswith(pre) & (F.instr(rest, "/") == 0) & (rest != "") & (rest != DIR_MARK)).select(rest.alias("name"))


def page_spans(rows: DataFrame, offset: str, size: str, page: int = PAGE) -> DataFrame:
    """One row per page that an extent touches: page, offset within it, bytes."""
    o, n = F.col(offset), F.col(size)
    pages = rows.where(n > 0).withColumn("page", F.explode(F.sequence(F.floor(o / page), F.floor((o + n - 1) / page))))
    lo = F.greatest(o, F.col("page") * page)
    return pages.withColumn("page_offset", lo - F.col("page") * page).withColumn("page_bytes", F.least(o + n, (F.col("page") + 1) * page) - lo)


def append_layout(entries: DataFrame, tag: str, order: list[str], size: str, most: int = MOST) -> DataFrame:
    """Deferred appends in their order, with the sequence number and the offset each gets at the file's tail.

    If a file has more than ``most`` entries, they are sorted by range over all tasks, so a hot file is many parts; each part sums on its own, and the
    few files that go on from one part to the next get the totals of the parts before (a row for each such part).
    """
    if not any_hot(entries, tag, most):
        w = Window.partitionBy(tag).orderBy(*order)
        return entries.withColumn("seq", F.row_number().over(w)).withColumn("offset", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows, _ = numbered(entries, tag, order, size)
    return rows.select(*entries.columns, F.col("_n").cast("int").alias("seq"), F.col("_off").alias("offset"))


def file_bytes(pages: DataFrame, file: str, page: str, payload: str, size: int, page_size: int = PAGE) -> DataFrame:
    """Files put together from their pages up to ``size`` bytes; pages that are missing read as zeros."""
    last = (size - 1) // page_size
    want = pages.select(file).distinct().withColumn(page, F.explode(F.sequence(F.lit(0), F.lit(last))))
    full = want.join(pages.select(file, page, payload), [file, page], "left").withColumn(payload, F.coalesce(truncate_blob(F.col(payload), F.lit(page_size)), zeros(F.lit(page_size))))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(page, payload))), lambda x: F.hex(x[payload]))
    return full.groupBy(file).agg(F.substring(F.unhex(F.array_join(parts, "")), F.lit(1), F.lit(size)).alias(payload))
