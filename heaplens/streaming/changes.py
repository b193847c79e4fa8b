"""Keyed tables of which each epoch writes the rows that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ChangeLog:
    """A table by key in a folder that driver and executors share: ``changes=E`` has the rows that epoch E changed or deleted, ``snapshot=E`` all rows as of E, after each ``every`` epochs with changes.

    An epoch reads what is as of the epoch before and writes its own folders, so one that is run again gives the same. What an epoch writes follows the keys that it changes;
    a snapshot is the only time that all rows are written. Folders that no epoch needs any more are deleted after a snapshot.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str, every: int = 32) -> None:
        self.spark, self.folder, self.keys, self.every = spark, folder, keys, every
        self.schema = f"{schema}, deleted boolean, epoch bigint"
        self.columns = spark.createDataFrame([], schema).columns

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folders(self) -> list[tuple[str, int]]:
        """(kind, epoch) of the folders that were written to the end."""
        path, fs = self._path(self.folder)
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        done = [p.getName() for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted((kind, int(epoch)) for kind, _, epoch in (n.partition("=") for n in done))

    def as_of(self, epoch: int) -> DataFrame:
        """All rows as of an epoch."""
        found = self.folders()
        base = max((e for kind, e in found if kind == "snapshot" and e <= epoch), default=None)
        wanted = [] if base is None else [f"{self.folder}/snapshot={base}"]
        wanted += [f"{self.folder}/changes={e}" for kind, e in found if kind == "changes" and (base is None or e > base) and e <= epoch]
        if not wanted:
            return self.spark.createDataFrame([], self.schema).drop("deleted", "epoch")
        rows = self.spark.read.schema(self.schema).parquet(*wanted)
        rest = [c for c in self.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest, "deleted"), "epoch").alias("last"))
        return last.where("NOT last.deleted").select(*self.keys, *[f"last.{c}" for c in rest]).select(*self.columns)

    def write(self, changed: DataFrame, gone: DataFrame | None, epoch: int) -> DataFrame:
        """Write the rows (whole, merged with what was before) that this epoch changed and the keys of those that go; returns all rows as of the epoch."""
        rows = changed.select(*self.columns).withColumn("deleted", F.lit(False))
        if gone is not None:
            rows = rows.unionByName(gone.select(*self.columns).withColumn("deleted", F.lit(True)))
        rows.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{self.folder}/changes={epoch}")
        found = self.folders()
        base = max((e for kind, e in found if kind == "snapshot" and e < epoch), default=-1)
        if sum(kind == "changes" and base < e <= epoch for kind, e in found) >= self.every:
            self.as_of(epoch).withColumns({"deleted": F.lit(False), "epoch": F.lit(epoch).cast("bigint")}).write.mode("overwrite").parquet(f"{self.folder}/snapshot={epoch}")
            self.forget(epoch - 1)
        return self.as_of(epoch)

    def forget(self, epoch: int) -> None:
        """Delete what isn't needed for ``as_of(epoch)`` and later."""
        found = self.folders()
        base = max((e for kind, e in found if kind == "snapshot" and e <= epoch), default=None)
        for kind, e in found if base is not None else ():
            if e < base or kind == "changes" and e == base:
                path, fs = self._path(f"{self.folder}/{kind}={e}")
                fs.delete(path, True)
