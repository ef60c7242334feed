"""Intermediate tables in the folder the cluster shares."""

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# Folder of the tables of a thread's job, under that of all tables.
_jobs: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder the session names; a temporary one only on a local master."""
    context = spark.sparkContext
    named = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="triplemill-"))
    return context.getCheckpointDir()


def written(df: DataFrame, *parts: str) -> DataFrame:
    """Write the rows once and read them back: what follows sees the same rows
    however often it runs, and survives the loss of executors. Rows may be written
    in ``parts``, so that a filter on these columns reads only what it needs."""
    spark = df.sparkSession
    job = _jobs.get(threading.get_ident())
    folder = f"{shared_folder(spark).rstrip('/')}/tables" + (f"/{job}" if job else "")
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropped(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that are written inside when it ends, well or not. What is
    handed out must not read them. Inside another one, the outer one drops all."""
    thread = threading.get_ident()
    if thread in _jobs:
        yield
        return
    _jobs[thread] = f"job-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        folder = f"{shared_folder(spark).rstrip('/')}/tables/{_jobs.pop(thread)}"
        files(spark, folder).remove(folder)


class files:
    """What a job does with files beyond reading and writing tables, through the
    file system that Spark itself uses for the path."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._system.listStatus(self._path(path)))

    def remove(self, path: str) -> None:
        self._system.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self._system.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} could not be renamed to {new}")

    def write(self, path: str, text: str) -> None:
        stream = self._system.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
