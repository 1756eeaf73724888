"""A tree of files over the catalog: nodes with their attributes, and contents in pages.

``nodes``: path, kind (file, dir, link), size, mtime_us, target (of a symbolic link), ino. ``pages``: ino, page,
payload. Names that are hard links share an ino. Every call gives a new tree; a call's rows may name any number of
files, so one join serves a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import sorted_groups
from ..functions.text import ancestors
from .catalog import PAGE, put_blob, rename_subtree, truncate_blob

NODES = "path string, kind string, size bigint, mtime_us bigint, target string, ino bigint"
PAGES = "ino bigint, page bigint, payload binary"


class FileError(ValueError):
    """A call that the tree refuses; ``code`` is the name of the usual error number."""

    def __init__(self, code: str, path: str):
        super().__init__(f"{code}: {path}")
        self.code = code


def spans_of(writes: DataFrame, page: int) -> DataFrame:
    """The pieces of (…, offset, data) on each page they touch: page, at (offset within it), piece; empty data touch none."""
    o, n = F.col("offset"), F.length("data")
    each = writes.where(n > 0).withColumn("page", F.explode(F.sequence(F.floor(o / page), F.floor((o + n - 1) / page))))
    lo = F.greatest(o, F.col("page") * page)
    hi = F.least(o + n, (F.col("page") + 1) * page)
    return each.withColumn("at", (lo - F.col("page") * page).cast("int")).withColumn("piece", F.substring("data", (lo - o + 1).cast("int"), (hi - lo).cast("int")))


@dataclass(frozen=True)
class FileTree:
    nodes: DataFrame
    pages: DataFrame
    page_size: int = PAGE

    @classmethod
    def of_blobs(cls, blobs: DataFrame, path: Column, ino: Column, page_size: int = PAGE) -> FileTree:
        """One file per blob with its payload, and the directories above them."""
        f = blobs.select(path.alias("path"), ino.cast("bigint").alias("ino"), F.coalesce("payload", F.lit(b"")).alias("data"), F.unix_micros("last_modified").alias("mtime_us"))
        files = f.select("path", F.lit("file").alias("kind"), F.length("data").cast("bigint").alias("size"), "mtime_us", F.lit(None).cast("string").alias("target"), "ino")
        above = f.select(F.explode(ancestors(F.col("path"))).alias("path")).join(f.select("path"), "path", "left_anti").distinct()
        dirs = above.select("path", F.lit("dir").alias("kind"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("mtime_us"), F.lit(None).cast("string").alias("target"), (-F.abs(F.xxhash64("path"))).alias("ino"))
        pages = spans_of(f.withColumn("offset", F.lit(0).cast("bigint")), page_size).select("ino", "page", F.col("piece").alias("payload"))
        return cls(files.unionByName(dirs), pages, page_size)

    def read(self, offset: int = 0, size: int | None = None) -> DataFrame:
        """(path, payload): ``size`` bytes from ``offset`` on of every file, or all; holes read as zeros. Pages beside the range aren't read."""
        end = F.col("size") if size is None else F.least(F.col("size"), F.lit(offset + size))
        f = self.nodes.where("kind = 'file'").select("path", "ino", F.greatest(end, F.lit(offset)).alias("_end"))
        some = self.pages.where(F.col("page") >= offset // self.page_size)
        if size is not None:
            some = some.where(F.col("page") * self.page_size < offset + size)
        rows = f.join(some, "ino", "left").select("path", "_end", "page", "payload")
        step = self.page_size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (path,), tab in sorted_groups(batches, 1):
                end = tab.column(1)[0].as_py()
                out = bytearray(end - offset)
                for p, b in zip(tab.column(2).to_pylist(), tab.column(3).to_pylist()):
                    if p is not None and p * step < end:
                        lo = max(p * step, offset)
                        part = b[lo - p * step : end - p * step]
                        out[lo - offset : lo - offset + len(part)] = part
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([bytes(out)], pa.binary())], names=["path", "payload"])

        return rows.repartition("path").sortWithinPartitions("path", "page").mapInArrow(run, "path string, payload binary")

    def write(self, writes: DataFrame) -> FileTree:
        """After (path, seq, offset, data, mtime_us) of files that exist: in order of seq, each over what is there; sizes grow, times follow the last write."""
        w = writes.where("data is not null and offset >= 0").join(self.nodes.where("kind = 'file'").select("path", "ino"), "path")
        pieces = spans_of(w, self.page_size).groupBy("ino", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "piece"))).alias("todo"))
        both = self.pages.join(pieces, ["ino", "page"], "full")
        new = F.when(F.col("todo").isNull(), F.col("payload")).otherwise(F.aggregate("todo", F.coalesce("payload", F.lit(b"")), lambda old, x: put_blob(old, x["piece"], x["at"])))
        ends = w.groupBy("ino").agg(F.max(F.col("offset") + F.length("data")).alias("_end"), F.max("mtime_us").alias("_at"))
        nodes = self.nodes.join(ends, "ino", "left").withColumn("size", F.greatest("size", F.coalesce("_end", F.lit(0)))).withColumn("mtime_us", F.coalesce("_at", "mtime_us"))
        return replace(self, nodes=nodes.select(*self.nodes.columns), pages=both.select("ino", "page", new.alias("payload")))

    def truncate(self, sizes: DataFrame) -> FileTree:
        """After (path, size): pages beyond are gone, the last one is cut, and a larger size leaves a hole."""
        s = sizes.join(self.nodes.where("kind = 'file'").select("path", "ino"), "path").groupBy("ino").agg(F.max(F.col("size").cast("bigint")).alias("_size"))
        p = self.pages.join(s, "ino", "left")
        left = F.col("_size") - F.col("page") * self.page_size
        cut = p.where(F.col("_size").isNull() | (left > 0)).withColumn("payload", F.when(left < F.length("payload"), truncate_blob(F.col("payload"), left.cast("int"))).otherwise(F.col("payload")))
        nodes = self.nodes.join(s, "ino", "left").withColumn("size", F.coalesce("_size", "size"))
        return replace(self, nodes=nodes.select(*self.nodes.columns), pages=cut.select("ino", "page", "payload"))

    def _node(self, path: str) -> dict | None:
        r = self.nodes.where(F.col("path") == path).first()
        return r and r.asDict()

    def _has_children(self, path: str) -> bool:
        return not self.nodes.where(F.col("path").startswith(path.rstrip("/") + "/")).isEmpty()

    def _with(self, rows: list[tuple]) -> FileTree:
        return replace(self, nodes=self.nodes.unionByName(self.nodes.sparkSession.createDataFrame(rows, NODES), allowMissingColumns=True))

    def _parents(self, path: str) -> list[tuple]:
        """Rows of the directories above a path that aren't there yet."""
        parts = [p for p in path.split("/") if p][:-1]
        want = ["/" + "/".join(parts[: i + 1]) for i in range(len(parts))]
        have = {r[0] for r in self.nodes.where(F.col("path").isin(want)).select("path").collect()} if want else set()
        return [(p, "dir", 0, None, None, self._ino(p)) for p in want if p not in have]

    def _ino(self, path: str) -> int:
        from xxhash import xxh3_64_intdigest

        return -(xxh3_64_intdigest(path) >> 1)

    def create(self, path: str, mtime_us: int | None = None) -> FileTree:
        if self._node(path):
            raise FileError("EEXIST", path)
        return self._with([*self._parents(path), (path, "file", 0, mtime_us, None, self._ino(path))])

    def mkdir(self, path: str) -> FileTree:
        if self._node(path) or self._has_children(path):
            raise FileError("EEXIST", path)
        return self._with([*self._parents(path), (path, "dir", 0, None, None, self._ino(path))])

    def rmdir(self, path: str) -> FileTree:
        """Removes a directory without children."""
        n = self._node(path)
        if n is None:
            raise FileError("ENOENT", path)
        if n["kind"] != "dir":
            raise FileError("ENOTDIR", path)
        if self._has_children(path):
            raise FileError("ENOTEMPTY", path)
        return replace(self, nodes=self.nodes.where(F.col("path") != path))

    def unlink(self, path: str) -> FileTree:
        """Removes a name; the content goes with the last name of its ino."""
        n = self._node(path)
        if n is None:
            raise FileError("ENOENT", path)
        if n["kind"] == "dir":
            raise FileError("EISDIR", path)
        nodes = self.nodes.where(F.col("path") != path)
        last = nodes.where(F.col("ino") == n["ino"]).isEmpty()
        return replace(self, nodes=nodes, pages=self.pages.where(F.col("ino") != n["ino"]) if last else self.pages)

    def rename(self, old: str, new: str) -> FileTree:
        """Moves a file or a whole subtree; directories above the new name come to be; a file in its place is replaced."""
        if self._node(old) is None and not self._has_children(old):
            raise FileError("ENOENT", old)
        if new == old:
            return self
        if new.startswith(old + "/"):
            raise FileError("EINVAL", new)
        there = self._node(new)
        if there and there["kind"] == "dir" and self._has_children(new):
            raise FileError("ENOTEMPTY", new)
        base = replace(self, nodes=self.nodes.where(F.col("path") != new)) if there else self
        more = base._parents(new)
        moved = replace(base, nodes=rename_subtree(base.nodes, "path", old, new))
        return moved._with(more) if more else moved

    def link(self, path: str, name: str) -> FileTree:
        """A second name for a file."""
        n = self._node(path)
        if n is None:
            raise FileError("ENOENT", path)
        if n["kind"] == "dir":
            raise FileError("EPERM", path)
        if self._node(name):
            raise FileError("EEXIST", name)
        return self._with([*self._parents(name), (name, n["kind"], n["size"], n["mtime_us"], n["target"], n["ino"])])

    def symlink(self, target: str, name: str) -> FileTree:
        if self._node(name):
            raise FileError("EEXIST", name)
        return self._with([*self._parents(name), (name, "link", len(target.encode()), None, target, self._ino(name))])

    def readlink(self, name: str) -> str:
        n = self._node(name)
        if n is None or n["kind"] != "link":
            raise FileError("EINVAL" if n else "ENOENT", name)
        return n["target"]

    def utimens(self, path: str, mtime_us: int) -> FileTree:
        """Sets a file's time under all its names; the next write sets it again."""
        n = self._node(path)
        if n is None:
            raise FileError("ENOENT", path)
        return replace(self, nodes=self.nodes.withColumn("mtime_us", F.when(F.col("ino") == n["ino"], F.lit(mtime_us)).otherwise(F.col("mtime_us"))))

    def chown(self, path: str, uid: int | None = None, gid: int | None = None) -> FileTree:
        """Sets owner and group under all a file's names; trees without these columns get them."""
        n = self._node(path)
        if n is None:
            raise FileError("ENOENT", path)
        nodes = self.nodes
        for c, v in (("uid", uid), ("gid", gid)):
            old = F.col(c) if c in nodes.columns else F.lit(None).cast("int")
            nodes = nodes.withColumn(c, F.when(F.col("ino") == n["ino"], F.lit(v)).otherwise(old).cast("int") if v is not None else old)
        return replace(self, nodes=nodes)

    def links(self) -> DataFrame:
        """(ino, n_links) of the files."""
        return self.nodes.where("kind <> 'dir'").groupBy("ino").agg(F.count("*").alias("n_links"))
