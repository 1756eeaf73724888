"""Record files as a Spark data source: ``spark.read.format("tagrecords").load(folder)``."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RecordReader(DataSourceReader):
    """One partition per file; a file's records are streamed, so only one payload is held at a time."""

    def __init__(self, path: str):
        self.path = path

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, root = self._fs()
        found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".rec")] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple[str, bytes]]:
        if not partition.path:
            return
        where, _ = self._fs()
        with where.open_input_stream(partition.path) as f:
            while head := f.read(4):
                name = f.read(struct.unpack("<I", head)[0]).decode()
                yield name, f.read(struct.unpack("<Q", f.read(8))[0])


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tagrecords"

    def schema(self) -> str:
        return "blob_name string, payload binary"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
