"""Declarative ingest into (tag, blob) rows, and export: files in chunks, inline strings, CSV, Parquet, object stores."""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_filter

CHUNK = 1 << 20
PROTOCOLS = ("file", "string", "hdf5", "s3", "s3a", "gs", "gcs")
BLOB_SCHEMA = "tag_name string, blob_name string, payload binary"
# Return codes of an inline string: unknown source, no blob name, unknown destination, no tag, no payload.
BAD_SOURCE, NO_BLOB, BAD_TARGET, NO_TAG, NO_PAYLOAD = -1, -2, -3, -4, -7
TAG_FAILED, PUT_FAILED = -5, -6  # of stored_string


class IngestError(ValueError):
    """A transfer that can't be done; ``code`` says why and ``done`` how many went before it."""

    def __init__(self, text: str, code: int = -2, done: int = 0):
        super().__init__(text)
        self.code, self.done = code, done


@dataclass
class Transfer:
    src: str
    dst: str
    format: str = "binary"
    depends_on: str = ""
    range_off: int = 0
    range_size: int = 0
    data: str = ""
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


def expand_env(text: str) -> str:
    """``${NAME}`` by the environment, nothing where it is unset."""
    return re.sub(r"\$\{([^}]*)\}", lambda m: os.environ.get(m[1], ""), text)


def protocol(uri: str, target: bool = False) -> tuple[str, str]:
    """(protocol, rest) of ``proto://rest`` or ``proto::rest``; a target may have any scheme that is no source."""
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.]*)(?:://|::)(.*)$", uri, re.S)
    if not m or (not target and m[1].lower() not in PROTOCOLS):
        raise IngestError(f"no reader for {uri!r}")
    return m[1].lower(), m[2]


def load_spec(text: str) -> list[Transfer]:
    """Transfers of a YAML text: a ``transfers`` list of mappings with src, dst and format.

    Reads the block form with plain or quoted scalars, nested ``dataset_filter`` lists included; uses PyYAML where
    it is installed.
    """
    try:
        import yaml

        doc = yaml.safe_load(text)
    except ImportError:
        doc = _plain_yaml(text)
    if not isinstance(doc, dict) or not isinstance(doc.get("transfers"), list):
        raise IngestError("a transfers list is required")
    out = []
    for i, t in enumerate(doc["transfers"]):
        if not all(t.get(k) for k in ("src", "dst", "format")):
            raise IngestError("src, dst and format are required", done=i)
        flt = t.get("dataset_filter") or {}
        out.append(Transfer(expand_env(str(t["src"])), expand_env(str(t["dst"])), str(t["format"]), str(t.get("depends_on") or ""), int(t.get("range_off") or 0), int(t.get("range_size") or 0), expand_env(str(t.get("data") or "")), list(flt.get("include") or []), list(flt.get("exclude") or [])))
    return out


def _plain_yaml(text: str) -> dict:
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.strip().startswith("#")]

    def scalar(v: str):
        v = v.strip()
        return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v

    def block(i: int, depth: int):
        if i < len(rows) and rows[i][1].startswith("- "):
            out = []
            while i < len(rows) and rows[i][0] == depth and rows[i][1].startswith("- "):
                inner = rows[i][1][2:]
                if re.match(r"^[\w.]+:(\s|$)", inner):
                    rows[i] = (depth + 2, inner)
                    v, i = block(i, depth + 2)
                else:
                    v, i = scalar(inner), i + 1
                out.append(v)
            return out, i
        out = {}
        while i < len(rows) and rows[i][0] == depth and not rows[i][1].startswith("- "):
            k, _, v = rows[i][1].partition(":")
            i += 1
            if v.strip():
                out[k.strip()] = scalar(v)
            elif i < len(rows) and rows[i][0] >= depth and (rows[i][0] > depth or rows[i][1].startswith("- ")):
                out[k.strip()], i = block(i, rows[i][0])
            else:
                out[k.strip()] = None
        return out, i

    return block(0, rows[0][0])[0] if rows else {}


def chunks(files: DataFrame, tag: str, content: str, size: str, chunk: int = CHUNK, off: int = 0, length: int = 0) -> DataFrame:
    """(tag_name, blob_name, payload): ``chunk_<i>`` pieces of a file's range, and its ``description``.

    ``length`` 0 means the whole file. A range outside the file, or an empty file, leaves no rows.
    """
    end = F.lit(off + length) if length else F.col(size)
    ok = files.where((F.col(size) > 0) & (end <= F.col(size)) & (F.lit(off) < end))
    n = end - off
    parts = ok.select(F.col(tag).alias("tag_name"), F.col(content).alias("_c"), n.alias("_n"), F.explode(F.sequence(F.lit(0), F.ceil(n / chunk) - 1)).alias("_i"))
    data = parts.select("tag_name", F.concat(F.lit("chunk_"), F.col("_i").cast("string")).alias("blob_name"), F.substring("_c", F.lit(off + 1) + F.col("_i") * chunk, F.least(F.lit(chunk), F.col("_n") - F.col("_i") * chunk)).alias("payload"))
    about = ok.select(F.col(tag).alias("tag_name"), F.lit("description").alias("blob_name"), F.concat(F.lit("binary<size="), n.cast("string"), F.lit(f", offset={off}>")).cast("binary").alias("payload"))
    return data.unionByName(about)


def read_binary(spark: SparkSession, path: str, tag: str, off: int = 0, length: int = 0, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Chunks of all files of a path; several files get their path below the tag."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = f.where(glob_filter(F.col("path"), list(include), list(exclude)))
    return chunks(f.withColumn("_tag", F.lit(tag)), "_tag", "content", "length", CHUNK, off, length)


def read_string(spark: SparkSession, t: Transfer) -> DataFrame:
    """One blob of the inline data of ``string::<blob>`` into ``tag::<tag>``."""
    kind, blob = protocol(t.src)
    where, tag = protocol(t.dst, target=True)
    for bad, code in ((kind != "string", BAD_SOURCE), (not blob, NO_BLOB), (where in PROTOCOLS, BAD_TARGET), (not tag, NO_TAG), (not t.data, NO_PAYLOAD)):
        if bad:
            raise IngestError("inline string can't be stored", code)
    return spark.createDataFrame([(tag, blob, t.data.encode())], BLOB_SCHEMA)


STEP = 3 << 19  # bytes of a chunk of a dataset


def stored_string(spark: SparkSession, t: Transfer, put) -> int:
    """Stores an inline string through ``put`` (blobs -> None): 0, or the return code of what went wrong."""
    try:
        row = read_string(spark, t)
    except IngestError as e:
        return e.code
    try:
        put(row)
    except (PermissionError, KeyError):
        return TAG_FAILED
    except Exception:  # noqa: BLE001 - whatever a sink raises is a failed put
        return PUT_FAILED
    return 0


def file_listing(spark: SparkSession, path: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(path, bytes, modified) of the files below a path; their contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.where(glob_filter(F.col("path"), list(include), list(exclude))).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def hdf5_datasets(spark: SparkSession, path: str) -> DataFrame:
    """(path, dataset, description, bytes) of every dataset of a file; needs h5py on the executors."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise IngestError("h5py isn't installed") from e

    def find(frames):
        import h5py
        import pandas as pd

        for df in frames:
            for p in df["path"]:
                out: list[tuple] = []

                def visit(name, o, out=out, p=p):
                    if isinstance(o, h5py.Dataset):
                        out.append((p, name, f"tensor<{o.dtype.name}, {', '.join(map(str, o.shape))}>", int(o.size) * o.dtype.itemsize))

                with h5py.File(p, "r") as f:
                    f.visititems(visit)
                yield pd.DataFrame(out, columns=["path", "dataset", "description", "bytes"])

    return spark.createDataFrame([(path,)], "path string").mapInPandas(find, "path string, dataset string, description string, bytes bigint")


def read_hdf5(spark: SparkSession, path: str, tag: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Datasets as tags of 1.5 MiB chunks; needs h5py on the executors.

    A first pass only lists each file's datasets with their shapes; then every chunk is a row of its own, spread over
    all tasks, which reads just the slab of rows it lies in.
    """

    def load(frames):
        import h5py
        import pandas as pd

        for df in frames:
            out = []
            for p, name, i in zip(df["path"], df["dataset"], df["chunk"]):
                with h5py.File(p, "r") as f:
                    d = f[name]
                    if not d.shape:
                        raw, at = d[()].tobytes(), i * STEP
                    else:
                        row = max(1, int(d.size) // max(d.shape[0], 1) * d.dtype.itemsize)
                        first = i * STEP // row
                        raw, at = d[first : -(-(i + 1) * STEP // row)].tobytes(), i * STEP - first * row
                out.append((f"{tag}/{name}", f"chunk_{i}", raw[at : at + STEP]))
            yield pd.DataFrame(out, columns=["tag_name", "blob_name", "payload"])

    listed = hdf5_datasets(spark, path).where(glob_filter(F.col("dataset"), include, exclude))
    about = listed.select(F.concat(F.lit(f"{tag}/"), "dataset").alias("tag_name"), F.lit("description").alias("blob_name"), F.col("description").cast("binary").alias("payload"))
    parts = listed.where("bytes > 0").select("path", "dataset", F.explode(F.sequence(F.lit(0), F.ceil(F.col("bytes") / STEP) - 1)).alias("chunk")).repartition("path", "dataset", "chunk")
    return about.unionByName(parts.mapInPandas(load, BLOB_SCHEMA))


READERS: dict = {}


def reader(*kinds: str):
    """Registers a function (spark, transfer, kind, rest, tag) -> blobs for formats or protocols; later ones win."""

    def add(f):
        READERS.update(dict.fromkeys(kinds, f))
        return f

    return add


@reader("string")
def _string_reader(spark, t, kind, rest, tag):
    return read_string(spark, t)


@reader("hdf5")
def _hdf5_reader(spark, t, kind, rest, tag):
    return read_hdf5(spark, rest, tag, t.include, t.exclude)


@reader("binary", "file", "s3", "s3a", "gs", "gcs")
def _binary_reader(spark, t, kind, rest, tag):
    return read_binary(spark, rest if kind == "file" else f"{ {'s3': 's3a', 'gcs': 'gs'}.get(kind, kind) }://{rest}", tag, t.range_off, t.range_size, t.include, t.exclude)


def ingest(spark: SparkSession, transfers: list[Transfer], verify: bool = False) -> DataFrame:
    """Blobs of all transfers in order; the first that fails raises with the number done. A dependency skips a transfer.

    Reads run when the blobs are used; with ``verify`` each transfer is read through first, so that the number done
    also counts reads that fail.
    """
    out = spark.createDataFrame([], BLOB_SCHEMA)
    for i, t in enumerate(transfers):
        if t.depends_on:
            continue
        try:
            kind, rest = protocol(t.src)
            tag = protocol(t.dst, target=True)[1]
            part = (READERS["string"] if kind == "string" else READERS.get(t.format) or READERS[kind])(spark, t, kind, rest, tag)
            if verify:
                part.write.format("noop").mode("overwrite").save()  # a read that fails does so here, while it is known which transfer it is
        except IngestError as e:
            raise IngestError(str(e), e.code, i) from e
        except Exception as e:
            if not verify:
                raise
            raise IngestError(f"{t.src}: {e}", -2, i) from e
        out = out.unionByName(part)
    return out


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV or TSV by extension, with a header; column names lose blanks and odd characters; types from a sample unless given."""
    r = spark.read.option("header", "true").option("sep", "\t" if path.endswith(".tsv") else ",")
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", "true").option("samplingRatio", 0.1).csv(path)
    return df.toDF(*[re.sub(r"\W+", "_", c.strip()).strip("_") or f"c{i}" for i, c in enumerate(df.columns)])


def read_asc(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of an ASCII grid; its NODATA value becomes null. Header lines start with a letter."""
    lines = spark.read.text(path, wholetext=True)
    body = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"^\s*[-+0-9.]"))
    gone = F.regexp_extract("value", r"(?i)nodata_value\s+([-+0-9.eE]+)", 1).try_cast("double")
    rows = lines.select(gone.alias("gone"), F.posexplode(body).alias("row", "line"))
    cells = rows.select("gone", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    return cells.select("row", "col", F.nullif(F.col("v").try_cast("double"), F.col("gone")).alias("value"))


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, rows) per file, from the files' own metadata columns and counts."""
    d = spark.read.parquet(path)
    return d.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))


def parquet_footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, row_groups, columns, types, created_by) of each file, from its footer alone; one task reads a file's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    schema = "file string, rows bigint, row_groups int, columns int, types map<string,string>, created_by string"

    def run(frames):
        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs

        for df in frames:
            out = []
            for p in df["path"]:
                where, spot = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", p))
                m = pq.read_metadata(spot, filesystem=where)
                s = m.schema.to_arrow_schema()
                out.append((os.path.basename(p), m.num_rows, m.num_row_groups, m.num_columns, {f.name: str(f.type) for f in s}, m.created_by))
            yield pd.DataFrame(out, columns=["file", "rows", "row_groups", "columns", "types", "created_by"])

    return files.mapInPandas(run, schema)


def csv_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, rows, columns) of each CSV or TSV file, the header not counted."""
    d = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("_at"))
    sep = "\t" if path.endswith(".tsv") else ","
    return d.groupBy("file", "bytes").agg((F.count_if(F.trim("value") != "") - 1).alias("rows"), F.min_by(F.size(F.split("value", sep)), "_at").alias("columns"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def export_records(blobs: DataFrame, path: str) -> int:
    """Blobs as binary records (u32 name length, name, u64 data length, data) in ``part-*.rec`` files below ``path``; returns the bytes of data.

    Blobs without bytes are skipped. ``path`` is a folder or URI that all tasks reach. A task streams into a file of
    its attempt and moves it into place when done, so a task that runs twice leaves its file once.
    """
    path = path.rstrip("/")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        where.create_dir(root, recursive=True)
        me = TaskContext.get()
        spot, n = f"{root}/.attempt-{me.taskAttemptId()}", 0
        with where.open_output_stream(spot) as f:
            for b in batches:
                for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    label = name.encode()
                    f.write(struct.pack("<I", len(label)) + label + struct.pack("<Q", len(raw)))
                    f.write(raw)
                    n += len(raw)
        if n:
            where.move(spot, f"{root}/part-{me.partitionId():05d}.rec")
        else:
            where.delete_file(spot)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    kept = blobs.where(F.col("blob_name").isNotNull() & (F.length("payload") > 0)).select("blob_name", F.col("payload").cast("binary").alias("payload"))
    return kept.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The blobs of :func:`export_records`."""

    def run(frames):
        import pandas as pd

        for df in frames:
            for b in df["content"]:
                out, i = [], 0
                while i < len(b):
                    (k,) = struct.unpack_from("<I", b, i)
                    name = b[i + 4 : i + 4 + k].decode()
                    (n,) = struct.unpack_from("<Q", b, i + 4 + k)
                    i += 12 + k
                    out.append((name, b[i : i + n]))
                    i += n
                yield pd.DataFrame(out, columns=["blob_name", "payload"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.rec").load(path).select("content").mapInPandas(run, "blob_name string, payload binary")


def save_snapshot(tags: DataFrame, blobs: DataFrame, path: str) -> None:
    tags.write.mode("overwrite").parquet(f"{path}/tags")
    blobs.write.mode("overwrite").parquet(f"{path}/blobs")


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/tags"), spark.read.parquet(f"{path}/blobs")
