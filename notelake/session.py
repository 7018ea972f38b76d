"""Session helpers: table access and the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """For costly work per row: a table that comes in fewer partitions than there are cores (one small file) is dealt out by ``key``; larger ones stay as they are, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset in local mode (tests)
    a temporary folder is made and removed at exit; a cluster without it raises RuntimeError, as its machines share no such folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="notelake-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Whether Spark removes the shuffle files of a query as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Scratch paths that are still there.
_made: dict[str, tuple[JavaObject, JavaObject]] = {}


def drop_scratch(*paths: str) -> None:
    """Remove scratch paths that nothing reads any more (none named: all of them): for jobs that go on and on."""
    for path in paths or list(_made):
        if path in _made:
            _remove(*_made.pop(path))


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed by :func:`drop_scratch` or when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    at, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    _made[path] = (at, conf)
    atexit.unregister(drop_scratch)
    atexit.register(drop_scratch)  # the last to come is the first to run, before the JVM goes
    return path


def _remove(at: JavaObject, conf: JavaObject) -> None:
    try:
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the JVM is gone, or the folder is
        pass


def written(df: DataFrame, what: str, path: str | None = None, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder (a scratch path of its own, or the one given) and read it back: lineage is cut and a lost executor costs nothing.

    ``free``: what was shuffled for it is removed once it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = path or scratch(spark, what)
    before = spark.conf.get(CLEANUP, None)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
