"""Keyed tables that take batches of new rows: caches of texts and embeddings, current labels.

A batch is written beside the table and counts once its entry in the manifest is there, which is one small
file, written last. So a write that is killed leaves the table as it was, and a batch that comes again, known
by its id, changes nothing. A batch costs what it holds; reading takes each key's newest row. ``compact``
folds the batches into a new base, ``vacuum`` removes what no version that is kept still needs. There is one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

MANIFEST = "version bigint, kind string, folder string, batch string, n bigint"


class VersionedTable:
    """The table below ``path``, with one row for each ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "doc_id"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def manifest(self) -> DataFrame:
        """``version, kind, folder, batch, n``: bases and batches in the order in which they were committed."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/_manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)

    def version(self) -> int:
        return self.manifest().agg(F.max("version")).first()[0] or 0

    def _parts(self, version: int | None) -> list:
        """The newest base up to a version, and the batches after it: a few names."""
        rows = self.manifest() if version is None else self.manifest().filter(F.col("version") <= version)
        rows = sorted(rows.collect(), key=lambda r: r.version)
        bases = [i for i, r in enumerate(rows) if r.kind == "base"]
        return rows[bases[-1] :] if bases else rows

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was at a version."""
        parts = self._parts(version)
        frames = [
            self.spark.read.schema(self.schema).parquet(f"{self.path}/{r.folder}").withColumn("_version", F.lit(r.version)) for r in parts
        ]
        empty = self.spark.createDataFrame([], self.schema)
        if not frames:
            return empty
        if len(frames) == 1:
            return frames[0].drop("_version")
        every = frames[0]
        for frame in frames[1:]:
            every = every.unionByName(frame)
        # only keys and versions are aggregated; whole rows move once
        newest = every.groupBy(self.key).agg(F.max("_version").alias("_version"))
        return every.join(newest, [self.key, "_version"]).select(*empty.columns)

    def upsert(self, rows: DataFrame, batch: str, order: str | None = None) -> bool:
        """Take a batch of new rows; False if it was taken before.

        Where a key comes twice in the batch, the row with the largest ``order`` wins, then the largest row. Rows
        with a null key are left out.
        """
        if not self.manifest().filter(F.col("batch") == batch).isEmpty():
            return False
        columns = self.spark.createDataFrame([], self.schema).columns
        wanted = rows.filter(F.col(self.key).isNotNull())
        rank = F.struct(*([F.col(order).alias("_order")] if order else []), *columns)
        best = wanted.groupBy(self.key).agg(F.max_by(F.struct(*columns), rank).alias("_best")).select("_best.*")
        self._commit(best, "batch", batch)
        return True

    def compact(self) -> None:
        """One base in place of the base and batches so far."""
        if len(self._parts(None)) > 1:
            self._commit(self.read(), "base", None)

    def _commit(self, rows: DataFrame, kind: str, batch: str | None) -> None:
        version = self.version() + 1
        folder = scratch_path(self.spark, "v").rsplit("/", 1)[-1]
        rows.write.parquet(f"{self.path}/{folder}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").count()
        entry = self.spark.createDataFrame([(version, kind, folder, batch, n)], MANIFEST)
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/_manifest")

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete folders that the last ``keep_versions`` versions don't read, left-overs of killed writes among them."""
        last = self.version()
        needed = {r.folder for v in range(max(1, last - keep_versions + 1), last + 1) for r in self._parts(v)}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        top = hadoop.Path(self.path)
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(top) if s.isDirectory()]
        gone = sorted(n for n in names if n.startswith("v-") and n not in needed)
        for name in gone:
            files.delete(hadoop.Path(top, name), True)
        return gone
