"""Sources that Spark has no reader for, as Python data sources: members of tar archives, and Arrow files.

`spark.dataSource.register(TarMembers)` and then `spark.read.format("tar").load(path)`. Planning reads the archive's headers only; each
member of a plain archive is a partition of its own, read by its offset, so an archive is neither unpacked first nor read by one task. A compressed archive can't be
entered in the middle: it is one partition, read as a stream. Filters on the member's name are pushed to the planning, so members that
aren't wanted are never read. Paths are what pyarrow's file systems open; a folder stands for the files in it.
"""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from lexitide.runtime import find_package

BATCH = 1000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def files(path: str, endings: tuple[str, ...]) -> list[str]:
    """The file, or the folder's files with these endings, in order."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(path.rstrip("/") + f.path[len(at.rstrip("/")) :] for f in found if f.type == fs.FileType.File and f.path.endswith(endings))


@dataclass
class Member(InputPartition):
    path: str
    name: str | None  # all members, of a compressed archive
    offset: int
    size: int


class TarReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names, self.tests = options, schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the filters on the member's name; the others are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("member",):
                self.tests.append(f)
            else:
                yield f

    def wanted(self, name: str) -> bool:
        for f in self.tests:
            if isinstance(f, (StringStartsWith, StringEndsWith)):
                good = name.startswith(f.value) if isinstance(f, StringStartsWith) else name.endswith(f.value)
            else:
                good = name in f.value if isinstance(f, In) else name == f.value
            if not good:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in files(self.options["path"], (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
            if not path.endswith(".tar"):
                out.append(Member(path, None, 0, 0))
                continue
            system, at = opened(path)
            with system.open_input_file(at) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                out += [Member(path, m.name, m.offset_data, m.size) for m in tar if m.isfile() and self.wanted(m.name)]
        return out

    def read(self, partition: Member) -> Iterator[tuple]:
        system, at = opened(partition.path)
        if partition.name is not None:
            with system.open_input_file(at) as f:
                f.seek(partition.offset)
                rows = [(partition.name, f.read(partition.size))]
        else:
            rows = self.streamed(system, at)
        for name, data in rows:
            text = _decoded(data)
            if text is not None or self.options.get("mode", "drop") == "keep":
                row = {"path": partition.path, "member": name, "size": len(data), "text": text}
                yield tuple(row[c] for c in self.names)

    def streamed(self, system: fs.FileSystem, at: str) -> Iterator[tuple[str, bytes]]:
        with system.open_input_stream(at, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
            for m in tar:
                if m.isfile() and self.wanted(m.name):
                    yield m.name, tar.extractfile(m).read()


def _decoded(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


class TarMembers(DataSource):
    """path, member, size, text of the files in tar archives. Members that aren't UTF-8 are dropped, or with mode keep have a null text."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return "path string, member string, size long, text string"

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(self.options, schema)


@dataclass
class Batch(InputPartition):
    path: str
    number: int


class ArrowReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = options, schema.names

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in files(self.options["path"], (".arrow", ".feather", ".ipc")):
            system, at = opened(path)
            with system.open_input_file(at) as f:
                out += [Batch(path, i) for i in range(pa.ipc.open_file(f).num_record_batches)]
        return out

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        system, at = opened(partition.path)
        with system.open_input_file(at) as f:
            b = pa.ipc.open_file(f).get_batch(partition.number)
            for i in range(0, b.num_rows, BATCH):
                yield b.select(self.names).slice(i, BATCH)


class ArrowFiles(DataSource):
    """Arrow files (feather, version 2), a partition for each record batch; the columns are those of the first file."""

    @classmethod
    def name(cls) -> str:
        return "arrow_file"

    def schema(self) -> StructType:
        system, at = opened(files(self.options["path"], (".arrow", ".feather", ".ipc"))[0])
        with system.open_input_file(at) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self.options, schema)


def tar_members(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    find_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarMembers)
    return spark.read.format("tar").option("mode", "keep" if keep else "drop").load(path)


def arrow_files(spark: SparkSession, path: str) -> DataFrame:
    find_package(spark)
    spark.dataSource.register(ArrowFiles)
    return spark.read.format("arrow_file").load(path)
