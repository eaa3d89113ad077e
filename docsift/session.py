"""Session helpers: scratch space and input parallelism."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, visible to every executor.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in
    tests, it is ``_scratch`` below the warehouse, which all executors share too.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
    created = f"{warehouse.rstrip('/')}/_scratch"
    spark.conf.set("spark.checkpoint.dir", created)
    return created


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Fan a small scan out over the cores before CPU-heavy row work.

    A scan planned with fewer splits than cores is below one split per core, so
    hashing its rows once is cheap next to leaving cores idle. Scans with enough
    splits, i.e. all large ones, are returned untouched and never shuffle here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
