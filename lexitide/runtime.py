"""Session helpers: building a session, shared scratch tables, bounded Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch sent to a Python worker; bounds its memory with long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_scratch: dict[str, str] = {}


def session(app: str = "lexitide", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did; a cluster gets it with --py-files."""
    own, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if own not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), own]))


def bound_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch limits where the session left them at their defaults."""
    find_package(spark)
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", "2147483647", "2147483647b"):
            conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # an older Spark that doesn't know the setting
        pass


def scratch_root(spark: SparkSession) -> str:
    """A folder of this process under spark.checkpoint.dir; a temporary one only where that is unset and the master local."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        if not shared:
            shared = tempfile.mkdtemp(prefix="lexitide-")
        _scratch[app] = f"{shared.rstrip('/')}/lexitide-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, _scratch[app])
    return _scratch[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already
        pass


class Scratch:
    """Tables written once to the shared folder and read again: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:8]}", 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.mode("error").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Only for tables that no frame still to be evaluated reads."""
        for t in tables:
            _delete(self.spark, t._scratch_path)

    def delete(self, name: str) -> None:
        """A folder that tasks wrote under base."""
        _delete(self.spark, f"{self.base}/{name}")


_kept: dict[tuple, DataFrame] = {}


def table_state(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Path, time of the last change and bytes of a table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return str(p), fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()


def kept(spark: SparkSession, name: str, states: tuple, make) -> DataFrame:
    """make()'s rows, written to the scratch folder once for a session and the states of its source tables; a frame of its own each time.

    Rows that make() has just saved itself are not written again."""
    key = (spark.sparkContext.applicationId, name, states)
    if key not in _kept:
        made = make()
        _kept[key] = made if "_scratch_path" in vars(made) else Scratch(spark, name).save(made, name)
    one = _kept[key]
    return spark.read.schema(one.schema).parquet(one._scratch_path)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows anew where a scan has fewer than half as many tasks as there are cores, as with one large row group.

    Before work that is heavy for each row. Larger tables are left as they are: nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
