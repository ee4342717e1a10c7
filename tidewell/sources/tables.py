"""Access to the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tidewell.sources import storage


#: Tables of fewer bytes are left as they are read.
SPREAD_BYTES = 1_000_000


def table(spark: SparkSession, folder: str, name: str, *columns: str | Column) -> DataFrame:
    """The table ``name`` of ``folder``; with ``columns``, only those (the scan then reads no others).

    A table in few files that can't be split, so that less than a quarter of the cores could read it, is spread over all of
    them. Large tables have more splits than that and aren't shuffled.
    """
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() * 4 <= cores and storage.size(spark, path) >= SPREAD_BYTES
    return df.repartition(cores) if few else df
