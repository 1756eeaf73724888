"""Queries over the catalog: by names, by words (BM25), by time, and packing of the answers into a byte budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import regex_predicate, seconds_of
from ..session import ensure_checkpoint_dir, spread

K1, B = 1.5, 0.75


def tag_query(tags: DataFrame, pattern: str, max_tags: int = 0) -> DataFrame:
    """Names that match as a whole, in order, at most ``max_tags`` (0: all); ``total`` counts all that match."""
    hit = tags.where(regex_predicate(F.col("tag_name"), pattern)).select("tag_name")
    total = hit.agg(F.count("*")).scalar().alias("total")
    out = hit.orderBy("tag_name")
    return (out.limit(max_tags) if max_tags else out).select("tag_name", total)


def blob_query(blobs: DataFrame, tag_pattern: str, blob_pattern: str, max_blobs: int = 0) -> DataFrame:
    """(tag_name, blob_name, total) of the blobs whose names both match, in order."""
    hit = blobs.where(regex_predicate(F.col("tag_name"), tag_pattern) & regex_predicate(F.col("blob_name"), blob_pattern)).select("tag_name", "blob_name")
    total = hit.agg(F.count("*")).scalar().alias("total")
    out = hit.orderBy("tag_name", "blob_name")
    return (out.limit(max_blobs) if max_blobs else out).select("tag_name", "blob_name", total)


def bm25(blobs: DataFrame, query: str, k: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """(tag_name, blob_name, score) of the best k (0: all) of the given blobs; those without a query word score 0.

    Statistics are over the given blobs of more than no bytes. The payloads are read once: one pass takes, per blob,
    its length and all query words at once, and keeps these numbers (with the columns ``keep``) for the totals and
    the scores.
    """
    terms = sorted({t.lower() for t in re.findall("[A-Za-z0-9]{2,}", query)})
    ensure_checkpoint_dir(blobs.sparkSession)
    base = spread(blobs.where("size > 0").select("tag_name", "blob_name", *keep, F.col("payload").cast("string").alias("_t")))
    hits = F.regexp_extract_all("_t", F.lit(f"(?i)(?<![A-Za-z0-9])(?:{'|'.join(terms)})(?![A-Za-z0-9])"), F.lit(0)) if terms else F.array().cast("array<string>")  # folds ASCII letters only
    found = base.select("tag_name", "blob_name", *keep, F.regexp_count("_t", F.lit("[A-Za-z0-9]{2,}")).alias("dl"), hits.alias("_h"))
    is_term = lambda t: lambda x: F.lower(x) == t
    tf = [F.size(F.filter("_h", is_term(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = found.select("tag_name", "blob_name", *keep, "dl", *tf).checkpoint()
    stats = counted.agg(F.count("*").cast("double"), F.coalesce(F.avg("dl"), F.lit(1.0)), *[F.count_if(F.col(f"tf{i}") > 0).cast("double") for i in range(len(terms))]).first()
    n, avg = stats[0], stats[1] if stats[1] > 0 else 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        df = F.lit(stats[2 + i])
        idf = F.log((F.lit(n) - df + 0.5) / (df + 0.5) + 1.0)
        f = F.col(f"tf{i}").cast("double")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(avg)))
    out = counted.select("tag_name", "blob_name", *keep, score.alias("score")).orderBy(F.desc("score"), "blob_name", "tag_name")
    return out.limit(k) if k else out


def in_window(ts: Column, begin: int = 0, end: int = 0) -> Column:
    """Nanosecond instants within both ends; 0 leaves an end open, and 0 as an instant never matches."""
    p = ts != 0
    if begin:
        p = p & (ts >= begin)
    if end:
        p = p & (ts <= end)
    return p


def temporal(blobs: DataFrame, begin: int = 0, end: int = 0, max_rows: int = 0) -> DataFrame:
    """(tag_name, blob_name, last_modified_ns), oldest first, at most ``max_rows`` (0: all)."""
    ns = (F.unix_micros("last_modified") * 1000).alias("last_modified_ns")
    hit = blobs.select("tag_name", "blob_name", ns).where(in_window(F.col("last_modified_ns"), begin, end)).orderBy("last_modified_ns", "tag_name", "blob_name")
    return hit.limit(max_rows) if max_rows else hit


def temporal_since(blobs: DataFrame, since: str, now_ns: int, max_rows: int = 0) -> DataFrame:
    """temporal over the last ``since`` (such as 3d or 1h30m) before ``now_ns``."""
    return temporal(blobs, begin=now_ns - int(seconds_of(since) * 1_000_000_000), max_rows=max_rows)


def with_labels(blobs: DataFrame, labels: DataFrame) -> DataFrame:
    """The blobs with ``label``: the name of their ``<blob>_label`` in the same tag, if it is there."""
    mine = labels.where(F.col("blob_name").endswith("_label")).select("tag_name", F.col("blob_name").alias("label"), F.regexp_replace("blob_name", "_label$", "").alias("blob_name"))
    return blobs.join(mine, ["tag_name", "blob_name"], "left")


def packed(ranked: DataFrame, rank: str, size: str, budget: int) -> DataFrame:
    """Rows in order of rank as long as they fit the budget together; the first that doesn't ends the packing.

    Ranked rows are answers of a search, so at most its ``max_results``; they are summed in one task.
    """
    w = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.where(F.col(size) > 0).withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def packed_by_batch(ranked: DataFrame, rank: str, size: str, budget: int, batch: int = 32) -> DataFrame:
    """Packing in which a row that doesn't fit ends only its batch of ``batch`` rows; later batches go on.

    What a batch leaves decides about the next, so the ranked rows (at most a search's ``max_results``) go in turn.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, closed, at = 0, -1, 0
        for df in frames:
            keep = []
            for n in df[size]:
                b = at // batch
                at += 1
                ok = b != closed and n > 0
                if ok and used + n > budget:
                    closed, ok = b, False
                keep.append(ok)
                used += n if ok else 0
            yield df[keep]

    return ranked.orderBy(rank).coalesce(1).mapInPandas(run, ranked.schema)


def context_query(blobs: DataFrame, tag_pattern: str, blob_pattern: str, max_results: int = 0, prompt: str = "", begin: int = 0, end: int = 0) -> DataFrame:
    """Names of the blobs that match: by time where a bound is given, else by words where a prompt is, else by name."""
    hit = blobs.where(regex_predicate(F.col("tag_name"), tag_pattern) & regex_predicate(F.col("blob_name"), blob_pattern))
    if begin or end:
        return temporal(hit, begin, end, max_results).select("tag_name", "blob_name")
    if prompt:
        return bm25(hit, prompt, max_results or 10).select("tag_name", "blob_name")
    return blob_query(blobs, tag_pattern, blob_pattern, max_results).select("tag_name", "blob_name")


def context_retrieve(blobs: DataFrame, tag_pattern: str, blob_pattern: str, prompt: str, budget: int = 256 << 20, max_results: int = 1024) -> DataFrame:
    """(rank, tag_name, blob_name, size) of the answers that fit the budget; payloads are joined by the caller."""
    hit = blobs.where(regex_predicate(F.col("tag_name"), tag_pattern) & regex_predicate(F.col("blob_name"), blob_pattern))
    best = bm25(hit, prompt, max_results, ("size",))
    w = Window.orderBy(F.desc("score"), "blob_name", "tag_name")  # at most max_results rows
    ranked = best.withColumn("rank", F.row_number().over(w))
    return packed(ranked.select("rank", "tag_name", "blob_name", "size"), "rank", "size", budget)


def index_insert(index: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """The postings with those of ``names``; names that are there stay as they are."""
    new = names.select(key).distinct().join(index.select(key).distinct(), key, "left_anti")
    return index.unionByName(trigram_index(new, key).select(*index.columns))


def index_delete(index: DataFrame, key: str, names: DataFrame) -> DataFrame:
    return index.join(names.select(key), key, "left_anti").select(*index.columns)


def index_rename(index: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """One name for another, in its place if it is there already; without the old one nothing changes."""
    if old == new or index.where(F.col(key) == old).isEmpty():
        return index
    rest = index.where(~F.col(key).isin(old, new))
    one = trigram_index(index.sparkSession.createDataFrame([(new,)], f"`{key}` string"), key)
    return rest.unionByName(one.select(*index.columns))


def trigram_index(rows: DataFrame, key: str) -> DataFrame:
    """(trigram, key) postings for substring and regex candidates."""
    n = F.length(key)
    grams = F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(F.col(key), i, F.lit(3))))).otherwise(F.array())
    return rows.select(F.explode(grams).alias("trigram"), key)


def trigram_candidates(index: DataFrame, key: str, literal: str) -> DataFrame:
    """Keys whose postings hold every trigram of a literal."""
    need = sorted({literal[i : i + 3] for i in range(len(literal) - 2)})
    return index.where(F.col("trigram").isin(need)).groupBy(key).agg(F.countDistinct("trigram").alias("n")).where(F.col("n") == len(need)).select(key)
