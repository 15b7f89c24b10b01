"""Tables written to the folder that all executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files under which a table may be a single row group, which one core reads alone.
SMALL_TABLE = 24 << 20
#: Bytes of files that are worth a task, where a small table is dealt out.
TASK_BYTES = 128 << 10
_OWN: dict[str, str] = {}


class _Journal(threading.local):
    """The paths that this thread has written, in order."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_JOURNAL = _Journal()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset (tests) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lexweave-")
    return _OWN[app]


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same table, written once and read back, for plans that read it several times."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _JOURNAL.paths.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, name: str):
    """A Hadoop path and the file system that it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, name: str) -> None:
    """Delete a file or folder; nothing happens if there is none."""
    path, store = file_system(spark, name)
    store.delete(path, True)


def move(spark: SparkSession, name: str, to: str) -> bool:
    """Give a file or folder another name, whose parents are made; False if that name is taken already."""
    (path, store), (target, _) = file_system(spark, name), file_system(spark, to)
    store.mkdirs(target.getParent())
    return not store.exists(target) and store.rename(path, target)


def release(df: DataFrame) -> None:
    """Delete the files of a written table that no later result reads."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, name)


def completed(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, written; the tables that were written on the way there are deleted then, since nothing else reads them."""
    before = len(_JOURNAL.paths)
    out = written(made := make(), name)
    for path in _JOURNAL.paths[before:-1]:
        delete(made.sparkSession, path)
    del _JOURNAL.paths[before:-1]
    return out


def spread(df: DataFrame, small: int = SMALL_TABLE) -> DataFrame:
    """A small table dealt over all cores, rows as they are; a larger one, which has row groups enough, untouched. Only the
    layout differs, so that work on each row does not wait for the one core that read a single row group."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES + 1)
    return df.repartition(tasks) if size <= small else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
