"""Where a job keeps tables that several of its stages read.

Everything goes to the folder named by ``spark.checkpoint.dir``, which all executors
share, so that a lost executor costs a reread and never a lost intermediate result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where it names none: one of this machine's in local mode, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """While a table is written, shuffle files go with the query that made them: the table replaces them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_whole(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written there to its end."""
    path, files = _path(spark, f"{folder}/_SUCCESS")
    return files.exists(path)


_MADE: list[Workspace] = []  #: folders of their own that nothing has dropped yet


class Workspace:
    """A folder of its own below the shared one, or the one that is named."""

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark = spark
        self.path = (folder or f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}").rstrip("/")
        if folder is None:
            _MADE.append(self)

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Writes ``df`` and gives it back as a plain scan, which ends its lineage."""
        path = f"{self.path}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        with shuffles_end(self.spark):
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, key: str, name: str | None = None, buckets: int | None = None) -> DataFrame:
        """Writes ``df`` dealt and sorted by ``key``, so that joins on it move only their other side."""
        name = name or f"tidemark_{uuid.uuid4().hex}"
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with shuffles_end(self.spark):
            df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(name)
        return self._held(name)

    def read_bucketed(self, name: str, columns: str, key: str, buckets: int) -> DataFrame:
        """A table that ``write_bucketed`` left, in this session or another."""
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self._held(name)

    def _held(self, name: str) -> DataFrame:
        """The table without its entry in the catalog: the files belong to this folder, and the result knows them."""
        held = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return held

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all of them, once no later stage reads it."""
        path, files = _path(self.spark, f"{self.path}/{name}" if name else self.path)
        files.delete(path, True)
        if not name and self in _MADE:
            _MADE.remove(self)


def made() -> list[Workspace]:
    """The folders of their own that jobs have made and not dropped, to be dropped by whoever runs several jobs one after the other."""
    return list(_MADE)
