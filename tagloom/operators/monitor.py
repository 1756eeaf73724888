"""Monitors over telemetry tables: rings from an event on, selectors of pools, and the views a dashboard reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens after a routing mode that belong to it.
ROUTING = {"direct_id": 1, "direct_hash": 1, "physical": 1, "range": 2}


@dataclass(frozen=True)
class PoolStats:
    """``pool_stats://<pool>:<routing[:its tokens]>:<selector>`` taken apart."""

    pool: str
    routing: tuple[str, ...]
    selector: str


def parse_pool_stats(uri: str) -> PoolStats:
    """The parts of a selector address; ValueError where one is missing. A selector may hold colons itself, or be empty."""
    head = "pool_stats://"
    if not uri.startswith(head):
        raise ValueError(f"no pool selector: {uri!r}")
    pool, colon, rest = uri[len(head) :].partition(":")
    parts = pool.split(".")
    if not colon or len(parts) != 2 or not all(p.isdigit() for p in parts):
        raise ValueError(f"no pool in {uri!r}")
    tokens = rest.split(":")
    n = 1 + ROUTING.get(tokens[0].lower(), 0)
    if len(tokens) < n:
        raise ValueError(f"too few tokens for routing {tokens[0]!r}")
    return PoolStats(pool, tuple(tokens[:n]), ":".join(tokens[n:]))


def ring(events: DataFrame, order: str, size: int, min_event_id: int = 0) -> DataFrame:
    """What a ring of the last ``size`` events still holds from ``min_event_id`` on."""
    head = events.agg(F.max(order) - F.lit(size - 1)).scalar()
    return events.where((F.col(order) >= head) & (F.col(order) >= min_event_id))


def system_stats(events: DataFrame, order: str, query: str, size: int = 1024) -> DataFrame:
    """The ring by its query, ``system_stats`` or ``system_stats:<min_event_id>``; anything but a number counts 0."""
    name, _, least = query.partition(":")
    if name != "system_stats":
        raise ValueError(f"no such monitor: {query!r}")
    return ring(events, order, size, int(least) if least.isdigit() else 0)


def select_pools(stats: DataFrame, uri: str, pool: str = "pool_id", host: str | None = None) -> DataFrame:
    """Rows of the pool an address names; ``physical`` routing keeps one host's, a selector one ``selector`` column's value."""
    p = parse_pool_stats(uri)
    out = stats.where(F.col(pool) == p.pool)
    if p.routing[0].lower() == "physical" and host:
        out = out.where(F.col(host).cast("string") == p.routing[1])
    return out.where(F.col("selector") == p.selector) if p.selector and "selector" in stats.columns else out


def nodes_view(hosts: DataFrame, stats: DataFrame, host: str, order: str) -> DataFrame:
    """Every host of a list with its latest figures, null and ``alive`` false where none came."""
    rest = [c for c in stats.columns if c != host]
    last = stats.groupBy(host).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(host, "_r.*")
    return hosts.select(host).distinct().join(last.withColumn("_hit", F.lit(True)), host, "left").withColumn("alive", F.coalesce("_hit", F.lit(False))).drop("_hit")


def as_json(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """(view): each row as the JSON text a dashboard reads."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("view"))
