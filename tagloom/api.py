"""The public facade: a catalog of blobs with context operations, tag handles, JSON tools and a search command."""

from __future__ import annotations

import argparse
import base64
import json
import sys
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import regex_predicate, seconds_of
from .operators import catalog as C
from .operators import search as S
from .operators.compress import REGISTRY
from .operators.placement import moves
from .sources import ingest as I


@dataclass
class Catalog:
    """A table of blobs: tag_name, blob_name, payload, size, last_modified. Changes give a new catalog."""

    blobs: DataFrame

    @classmethod
    def of_documents(cls, documents: DataFrame) -> Catalog:
        return cls(C.blobs_of(documents))

    def context_bundle(self, transfers: list[I.Transfer]) -> Catalog:
        new = I.ingest(self.blobs.sparkSession, transfers).select("tag_name", "blob_name", "payload", F.length("payload").cast("bigint").alias("size"), F.current_timestamp().alias("last_modified"))
        kept = self.blobs.join(new.select("tag_name", "blob_name"), ["tag_name", "blob_name"], "left_anti")
        return Catalog(kept.unionByName(new, allowMissingColumns=True))

    def context_query(self, tag: str, blob: str = ".*", max_results: int = 0, prompt: str = "", begin: int = 0, end: int = 0) -> DataFrame:
        return S.context_query(self.blobs, tag, blob, max_results, prompt, begin, end)

    def context_retrieve(self, tag: str, blob: str = ".*", prompt: str = "", max_results: int = 1024, budget: int = 256 << 20) -> DataFrame:
        names = S.context_retrieve(self.blobs, tag, blob, prompt, budget, max_results)
        return names.join(self.blobs.select("tag_name", "blob_name", "payload"), ["tag_name", "blob_name"])

    def context_destroy(self, tags: list[str]) -> Catalog:
        out = self.blobs
        for t in tags:
            out = C.delete_subtree(out, "tag_name", t)
        return Catalog(out)

    def tag(self, name: str) -> Tag:
        return Tag(self, name)

    def tag_query(self, pattern: str, max_tags: int = 0) -> DataFrame:
        return S.tag_query(self.blobs.select("tag_name").distinct(), pattern, max_tags)

    def blob_query(self, tag: str, blob: str, max_blobs: int = 0) -> DataFrame:
        return S.blob_query(self.blobs, tag, blob, max_blobs)

    def semantic_search(self, tag: str, blob: str, query: str, k: int = 10) -> DataFrame:
        return S.bm25(self.blobs.where(regex_predicate(F.col("tag_name"), tag) & regex_predicate(F.col("blob_name"), blob)), query, k)

    def temporal_search(self, tag: str, blob: str, begin: int = 0, end: int = 0, max_rows: int = 0) -> DataFrame:
        return S.temporal(self.blobs.where(regex_predicate(F.col("tag_name"), tag) & regex_predicate(F.col("blob_name"), blob)), begin, end, max_rows)


@dataclass
class Tag:
    """One tag's view of a catalog."""

    catalog: Catalog
    name: str

    @property
    def rows(self) -> DataFrame:
        return self.catalog.blobs.where(F.col("tag_name") == self.name)

    def contained_blobs(self) -> DataFrame:
        return self.rows.select("blob_name")

    def size(self) -> int:
        return self.rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def _one(self, blob: str) -> DataFrame:
        return self.rows.where(F.col("blob_name") == blob)

    def get_blob(self, blob: str, offset: int = 0, size: int | None = None) -> DataFrame:
        """The blob's bytes, or those of a range."""
        n = F.lit(size) if size is not None else F.length("payload")
        return self._one(blob).select(C.get_blob(F.col("payload"), F.lit(offset), n).alias("payload"))

    def blob_size(self, blob: str) -> int | None:
        r = self._one(blob).select("size").first()
        return r and r[0]

    def blob_score(self, blob: str) -> float | None:
        """The blob's score: 1 unless a put set another; None without the blob."""
        r = self._one(blob).select(F.col("score") if "score" in self.rows.columns else F.lit(1.0)).first()
        return r and r[0]

    def blob_info(self, blob: str) -> dict | None:
        """Everything but the payload."""
        r = self._one(blob).drop("payload").first()
        return r and r.asDict()

    def put_blob(self, blob: str, data: bytes | str, offset: int = 0, score: float = -1.0, replace: bool = False) -> Catalog:
        """Writes bytes at an offset, over what is there; ``replace`` ends the blob after them. ValueError, with the status as ``code``, where a put is refused."""
        raw = data.encode() if isinstance(data, str) else data
        code = 4 if not blob else 3 if raw is None else 2 if not raw else 5 if score > 1 else 0
        if code:
            e = ValueError("a blob needs a name, data, and a score of at most 1")
            e.code = code
            raise e
        new = self.catalog.blobs.sparkSession.createDataFrame([(self.name, blob, bytearray(raw), offset, float(score), replace)], "tag_name string, blob_name string, data binary, offset int, score double, replace boolean")
        return Catalog(C.put_blobs(self.catalog.blobs, new))

    def reorganize_blob(self, blob: str, score: float) -> Catalog:
        """The blob with a new score, if that differs enough to move it (see placement.moves)."""
        have = self.blob_score(blob)
        if have is None:
            raise ValueError("no such blob")
        own = F.col("tag_name").eqNullSafe(self.name) & (F.col("blob_name") == blob)
        old = F.col("score") if "score" in self.catalog.blobs.columns else F.lit(1.0)
        return Catalog(self.catalog.blobs.withColumn("score", F.when(own & moves(old, F.lit(float(score))), F.lit(float(score))).otherwise(old)))

    def del_blob(self, blob: str) -> Catalog:
        return Catalog(self.catalog.blobs.where(~((F.col("tag_name").eqNullSafe(self.name)) & F.col("blob_name").eqNullSafe(blob))))


def tool_json(df: DataFrame, name: str) -> str:
    """An answer of a tool: the rows under ``name`` and their count."""
    rows = [json.loads(x) for x in df.toJSON().toLocalIterator()]
    return json.dumps({name: rows, "count": len(rows)})


class Tools:
    """JSON tools over a catalog; those that change it keep the changed one in ``catalog``. Errors come as {"error": ...}."""

    def __init__(self, catalog: Catalog | None = None, telemetry: DataFrame | None = None):
        self.catalog, self.telemetry = catalog, telemetry

    def names(self) -> list[str]:
        return [n for n in dir(self) if not n.startswith("_") and n not in ("names", "call", "catalog", "telemetry")]

    def call(self, tool: str, **arguments) -> str:
        """Runs a tool by its name."""
        if tool not in self.names():
            return json.dumps({"error": f"no tool {tool}"})
        if self.catalog is None and tool not in ("initialize", "get_client_status", "get_types"):
            return json.dumps({"error": "not initialized"})
        try:
            return getattr(self, tool)(**arguments)
        except (ValueError, TypeError) as e:
            return json.dumps({"error": str(e)})

    def initialize(self, documents: str) -> str:
        self.catalog = Catalog.of_documents(SparkSession.builder.getOrCreate().read.parquet(documents))
        return json.dumps({"initialized": True})

    def get_client_status(self) -> str:
        return json.dumps({"available": True, "initialized": self.catalog is not None})

    def get_types(self) -> str:
        return json.dumps({"types": dict(self.catalog.blobs.dtypes) if self.catalog else {}, "codecs": [r[0] for r in REGISTRY]})

    def tag_query(self, tag_regex: str, max_tags: int = 0) -> str:
        tags = [r[0] for r in self.catalog.tag_query(tag_regex, max_tags).select("tag_name").toLocalIterator()]
        return json.dumps({"tags": tags, "count": len(tags)})

    def blob_query(self, tag_regex: str, blob_regex: str = ".*", max_blobs: int = 0) -> str:
        return tool_json(self.catalog.blob_query(tag_regex, blob_regex, max_blobs).select("tag_name", "blob_name"), "blobs")

    def poll_telemetry_log(self, minimum_logical_time: int = 0, limit: int = 1000) -> str:
        if self.telemetry is None:
            return json.dumps({"entries": [], "count": 0})
        return tool_json(self.telemetry.where(F.col("event_id") >= minimum_logical_time).orderBy("event_id").limit(limit), "entries")

    def reorganize_blob(self, tag_name: str, blob_name: str, new_score: float) -> str:
        self.catalog = self.catalog.tag(tag_name).reorganize_blob(blob_name, new_score)
        return json.dumps({"score": self.catalog.tag(tag_name).blob_score(blob_name)})

    def put_blob(self, tag_name: str, blob_name: str, data: str, offset: int = 0) -> str:
        self.catalog = self.catalog.tag(tag_name).put_blob(blob_name, data, offset)
        return json.dumps({"stored": True, "bytes": len(data.encode())})

    def list_blobs_in_tag(self, tag_name: str) -> str:
        names = [r[0] for r in self.catalog.tag(tag_name).contained_blobs().orderBy("blob_name").toLocalIterator()]
        return json.dumps({"blobs": names, "count": len(names)})

    def get_blob_size(self, tag_name: str, blob_name: str) -> str:
        n = self.catalog.tag(tag_name).blob_size(blob_name)
        return json.dumps({"error": "no such blob"} if n is None else {"size": n})

    def get_blob(self, tag_name: str, blob_name: str, offset: int = 0, size: int | None = None) -> str:
        """The bytes as text where they are UTF-8, else in base64."""
        r = self.catalog.tag(tag_name).get_blob(blob_name, offset, size).first()
        if r is None or not r[0]:
            return json.dumps({"error": "no such blob, or no bytes"})
        raw = bytes(r[0])
        try:
            return json.dumps({"data": raw.decode(), "encoding": "utf-8", "size": len(raw)})
        except UnicodeDecodeError:
            return json.dumps({"data": base64.b64encode(raw).decode(), "encoding": "base64", "size": len(raw)})

    def delete_blob(self, tag_name: str, blob_name: str) -> str:
        there = self.catalog.tag(tag_name).blob_size(blob_name) is not None
        if there:
            self.catalog = self.catalog.tag(tag_name).del_blob(blob_name)
        return json.dumps({"deleted": there})


def search_rows(catalog: Catalog, tag: str, blob: str, prompt: str = "", since: str = "", begin: int = 0, end: int = 0, max_rows: int = 0, now_ns: int | None = None) -> tuple[str, DataFrame]:
    """(mode, rows) of a search: temporal where a time is given, else semantic where words are, else by name."""
    if sum(map(bool, (prompt, since, begin))) > 1:
        raise ValueError("--prompt, --since and --time-begin exclude each other")
    if since or begin or end:
        if since:
            begin, end = (now_ns or time.time_ns()) - int(seconds_of(since) * 1_000_000_000), 0
        return "temporal", catalog.temporal_search(tag, blob, begin, end, max_rows).select("tag_name", "blob_name", F.col("last_modified_ns").alias("last_modified"))
    if prompt:
        return "semantic", catalog.semantic_search(tag, blob, prompt, max_rows or 10).select("tag_name", "blob_name", "score")
    return "name", catalog.blob_query(tag, blob, max_rows).select("tag_name", "blob_name")


def _lines(mode: str, rows, form: str):
    """Printed lines of the hits; scores with six digits."""
    if form == "json":
        yield "["
        held = None
        for r in rows:
            if held is not None:
                yield held + ","
            more = f', "score": {r.score:.6f}' if mode == "semantic" else f', "last_modified": {r.last_modified}' if mode == "temporal" else ""
            held = f'  {{"tag_id": {json.dumps(r.tag_name)}, "blob_name": {json.dumps(r.blob_name)}{more}}}'
        if held is not None:
            yield held
        yield "]"
    elif form == "table":  # fixed values: headings and widths
        heads = {"name": f"{'TAG':<30}{'BLOB NAME':<50}", "semantic": f"{'RANK':<6}{'SCORE':>10}  {'TAG':<30}{'BLOB NAME':<40}", "temporal": f"{'LAST_MODIFIED (ns)':<22}{'TAG':<30}{'BLOB NAME':<40}"}
        yield heads[mode]
        yield "-" * len(heads[mode])
        n = 0
        for n, r in enumerate(rows, 1):
            yield {"name": lambda: f"{r.tag_name:<30}{r.blob_name:<50}", "semantic": lambda: f"{n:<6}{r.score:>10.6f}  {r.tag_name:<30}{r.blob_name:<40}", "temporal": lambda: f"{r.last_modified:<22}{r.tag_name:<30}{r.blob_name:<40}"}[mode]()
        yield f"\n{n} result(s)"
    else:
        for r in rows:
            yield f"{r.tag_name}/{r.blob_name}"


def main(argv: list[str] | None = None, catalog: Catalog | None = None) -> int:
    """Search command: by name, by words (--prompt) or by time (--since, --time-begin, --time-end; nanoseconds)."""
    p = argparse.ArgumentParser(prog="tagloom-search")
    p.add_argument("--documents", help="Parquet table of documents")
    p.add_argument("--tag", default=".*")
    p.add_argument("--blob", default=".*")
    p.add_argument("--prompt", "--semantic", default="")
    p.add_argument("--since", default="", help="such as 3d, 1h30m or 90 (seconds)")
    p.add_argument("--time-begin", type=int, default=0)
    p.add_argument("--time-end", type=int, default=0)
    p.add_argument("--max", type=int, default=0)
    p.add_argument("--tags-only", action="store_true")
    p.add_argument("--format", choices=("names", "table", "json"), default="names")
    p.add_argument("--json", action="store_const", const="json", dest="format")
    a = p.parse_args(argv)
    if catalog is None:
        if not a.documents:
            p.error("--documents is required")
        catalog = Catalog.of_documents(SparkSession.builder.getOrCreate().read.parquet(a.documents))
    try:
        mode, hits = search_rows(catalog, a.tag, a.blob, a.prompt, a.since, a.time_begin, a.time_end, a.max)
    except ValueError as e:
        p.error(str(e))
    if a.tags_only:
        for r in hits.select("tag_name").distinct().orderBy("tag_name").toLocalIterator():
            print(r[0])
    else:
        for line in _lines(mode, hits.toLocalIterator(), a.format):
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
