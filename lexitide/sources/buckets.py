"""A stored table that can be changed in place: rows in hash buckets, versions that are swapped in by one rename.

A version is a small text file that names the folder of each bucket. A change writes only the buckets of the keys it touches, into
a folder of its own, then a new version file beside the others. Readers take the newest version, or the one they name, so a change that is broken off leaves
the old version as it was, and a table can be read while it is written over.

path/data/<id>/bucket=<k>/*.parquet, path/versions/<n>.txt. Where two writers end at once, the second finds its number taken and is refused. The
file system must rename in one step (HDFS and local ones do).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexitide.sources.sinks import check_schema


class Conflict(RuntimeError):
    """Another writer has made the version that this change would have made."""


class Buckets:
    """keys are the columns that tell rows apart; null keys are keys."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions

    def versions(self) -> list[int]:
        folder = self.hadoop.Path(f"{self.path}/versions")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(n[:-4]) for n in names if n.endswith(".txt") and n[:-4].isdigit())

    def _read(self, version: int | None) -> tuple[int, list[str], int, str, dict[int, str]]:
        """Version, keys, number of buckets, schema as JSON, folder by bucket."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.path} has no version {'' if version is None else version}")
        version = known[-1] if version is None else version
        stream = self.fs.open(self.hadoop.Path(f"{self.path}/versions/{version}.txt"))
        try:
            text = bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()
        keys, n, schema, *lines = text.split("\n")
        return version, keys.split("\t"), int(n), schema, {int(b): f for b, f in (line.split("\t") for line in lines if line)}

    def _publish(self, version: int, keys: list[str], n: int, schema: str, folders: dict[int, str]) -> int:
        text = "\n".join(["\t".join(keys), str(n), schema, *(f"{b}\t{f}" for b, f in sorted(folders.items()))])
        part, final = (self.hadoop.Path(f"{self.path}/versions/{name}") for name in (f".{uuid.uuid4().hex}", f"{version}.txt"))
        out = self.fs.create(part, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        # a file of that name is never written over: local file systems would do so in a rename
        if self.fs.exists(final) or not self.fs.rename(part, final):
            self.fs.delete(part, False)
            raise Conflict(f"version {version} of {self.path} is there already")
        return version

    # rows

    def _bucket(self, keys: list[str], n: int):
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, keys: list[str], n: int) -> tuple[str, list[int]]:
        """Writes rows by bucket into a new folder; its name and the buckets that have rows."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self._bucket(keys, n)).repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        found = [s.getPath().getName() for s in self.fs.listStatus(self.hadoop.Path(f"{self.path}/{folder}"))]
        return folder, [int(x.partition("=")[2]) for x in found if x.startswith("bucket=")]

    def create(self, rows: DataFrame, keys: list[str], buckets: int = 64) -> int:
        """The first version; of rows with equal keys the one whose JSON sorts first."""
        if self.versions():
            raise FileExistsError(self.path)
        folder, found = self._write(_one_each(rows, keys), keys, buckets)
        return self._publish(1, keys, buckets, rows.schema.json(), {b: folder for b in found})

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """Rows of a version, or of its buckets `only`."""
        _, _, _, schema, folders = self._read(version)
        own = StructType.fromJson(json.loads(schema))
        paths = [f"{self.path}/{f}/bucket={b}" for b, f in sorted(folders.items()) if only is None or b in only]
        return self.spark.read.schema(own).parquet(*paths) if paths else self.spark.createDataFrame([], own)

    def _change(self, touched_by: DataFrame, make) -> int:
        """A new version in which make(old rows of the touched buckets) stands for them."""
        version, keys, n, schema, folders = self._read(None)
        touched = [r["b"] for r in touched_by.select(self._bucket(keys, n).alias("b")).distinct().collect()]  # at most n
        if not touched:
            return version
        folder, found = self._write(make(self.read(version, touched), keys), keys, n)
        kept = {b: f for b, f in folders.items() if b not in touched}
        return self._publish(version + 1, keys, n, schema, kept | {b: folder for b in found})

    def upsert(self, new: DataFrame) -> int:
        """New rows take the place of rows with equal keys, the others are added; the columns must be those of the table."""
        have = self.read()
        check_schema(have.schema, new.schema)
        new = new.select(have.columns)
        return self._change(new, lambda old, keys: _without(old, new, keys).unionByName(_one_each(new, keys)))

    def delete(self, gone: DataFrame) -> int:
        """Rows whose keys are in gone go."""
        return self._change(gone, lambda old, keys: _without(old, gone, keys))

    def add(self, new: DataFrame, sums: list[str]) -> int:
        """Adds the columns sums of equal keys, and keys that are new."""

        def summed(old: DataFrame, keys: list[str]) -> DataFrame:
            both = old.unionByName(new.select(old.columns))
            out = both.groupBy(*keys).agg(*(F.sum(c).cast(old.schema[c].dataType).alias(c) if c in sums else F.first(c).alias(c) for c in old.columns if c not in keys))
            return out.select(old.columns)

        return self._change(new, summed)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the buckets' folders that none of the newest versions names; not while others write. Gives how many went."""
        known = self.versions()
        named = {f"{f}/bucket={b}" for v in known[-max(1, keep) :] for b, f in self._read(v)[4].items()}
        for v in known[: -max(1, keep)]:
            self.fs.delete(self.hadoop.Path(f"{self.path}/versions/{v}.txt"), False)
        data, gone = self.hadoop.Path(f"{self.path}/data"), 0
        for folder in self.fs.listStatus(data) if self.fs.exists(data) else []:
            inside = [s for s in self.fs.listStatus(folder.getPath()) if s.getPath().getName().startswith("bucket=")]
            old = [s for s in inside if f"data/{folder.getPath().getName()}/{s.getPath().getName()}" not in named]
            for s in [folder] if len(old) == len(inside) else old:
                self.fs.delete(s.getPath(), True)
            gone += len(old)
        return gone


def _one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    own = F.struct(*(f"`{c}`" for c in rows.columns))
    return rows.groupBy(*keys).agg(F.min_by(own, F.to_json(own)).alias("__row")).select("__row.*")


def _without(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose keys aren't in gone."""
    other = gone.select(*(F.col(k).alias(f"__g_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__g_{k}"))
    return old.join(other, same, "left_anti")
