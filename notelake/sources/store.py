"""Versioned Parquet stores: immutable snapshots, whole or by bucket, and one pointer file that is replaced atomically."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class _Pointed:
    """A folder with a pointer file. Readers see what the pointer names, never something half-written.

    Works on any Hadoop file system; the pointer is written to a fresh file and renamed over the old one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._path(f"{self.root}/{name}")

    def _pointer(self) -> str | None:
        if not self._fs.exists(self._p("_current")):
            return None
        stream = self._fs.open(self._p("_current"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _point(self, to: str) -> None:
        jvm = self.spark._jvm
        part = self._p(f"_current.{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(to.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(part), self._fs.makeQualified(self._p("_current")), options)


class VersionedStore(_Pointed):
    """A table as a folder of snapshots ``v=<n>``, each of them whole."""

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and self._fs.exists(self._p(f"{n}/_SUCCESS")))

    def current(self) -> int | None:
        """Published version; None for an empty store."""
        at = self._pointer()
        return None if at is None else int(at)

    def publish(self, df: DataFrame, partition_by: list[str] | None = None, codec: str = "zstd", max_records: int = 0) -> int:
        """Write all of ``df`` as the next snapshot, then move the pointer: all or nothing."""
        version = (self.versions() or [0])[-1] + 1
        w = df.write.mode("overwrite").option("compression", codec).option("maxRecordsPerFile", max_records)
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/v={version}")
        self._point(str(version))
        return version

    def read(self, version: int | None = None) -> DataFrame:
        at = self.current() if version is None else version
        if at is None:
            raise FileNotFoundError(f"nothing published in {self.root}")
        return self.spark.read.parquet(f"{self.root}/v={at}")

    def rollback(self, version: int) -> None:
        """Recovery: point at an older snapshot."""
        if version not in self.versions():
            raise ValueError(f"no snapshot {version}")
        self._point(str(version))

    def retain(self, newest: int) -> list[int]:
        """Drop all but the newest snapshots (never the published one); returns what was dropped."""
        keep = set(self.versions()[-max(1, newest):]) | {self.current()}
        gone = [v for v in self.versions() if v not in keep]
        for v in gone:
            self._fs.delete(self._p(f"v={v}"), True)
        return gone

    def backup(self, to: str) -> str:
        """Copy of the published snapshot as Parquet."""
        self.read().write.mode("overwrite").parquet(to)
        return to


class BucketedStore(_Pointed):
    """A table in buckets by a hash of one column. A generation ``g=<n>`` holds the buckets that it changed; the pointer says of each bucket
    which generation holds it, and what the columns are. So a small change costs the buckets that it touches."""

    def __init__(self, spark: SparkSession, root: str, buckets: int, key: str):
        super().__init__(spark, root)
        self.buckets, self.key = buckets, key

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _state(self) -> dict | None:
        at = self._pointer()
        return None if at is None else json.loads(at)

    def publish(self, df: DataFrame, touched: list[int] | None = None, codec: str = "zstd") -> int:
        """Write ``df`` as all there is in the buckets ``touched`` (None: in all), then move the pointer: all or nothing. Rows of other buckets raise ValueError."""
        state = self._state() or {"generation": 0, "at": [0] * self.buckets}
        if len(state["at"]) != self.buckets:
            raise ValueError(f"the store has {len(state['at'])} buckets")
        n, mine = state["generation"] + 1, range(self.buckets) if touched is None else touched
        path = f"{self.root}/g={n}"
        df.withColumn("_bucket", self.bucket()).repartition(max(1, len(mine)), "_bucket").write.mode("overwrite").option("compression", codec).partitionBy("_bucket").parquet(path)
        there = {int(s.getPath().getName()[8:]) for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().startswith("_bucket=")}
        if there - set(mine):
            raise ValueError("rows of buckets that were not named")
        at = [(n if b in there else 0) if b in set(mine) else g for b, g in enumerate(state["at"])]  # 0: empty
        self._point(json.dumps({"generation": n, "at": at, "schema": df.schema.jsonValue()}))
        return n

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        state = self._state()
        if state is None:
            raise FileNotFoundError(f"nothing published in {self.root}")
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.root}/g={g}/_bucket={b}" for b, g in enumerate(state["at"]) if g and (buckets is None or b in set(buckets))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def retain(self) -> list[int]:
        """Drop the generations that no bucket is read from; returns them."""
        used = set((self._state() or {"at": []})["at"])
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        gone = sorted(int(n[2:]) for n in names if n.startswith("g=") and n[2:].isdigit() and int(n[2:]) not in used)
        for g in gone:
            self._fs.delete(self._p(f"g={g}"), True)
        return gone
