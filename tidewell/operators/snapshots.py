"""Versioned index snapshots: upsert by key, prune what the new run lacks, publish by one pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.joins import small
from tidewell.session import stage
from tidewell.sources import storage


def upserted(previous: DataFrame, current: DataFrame, key: str, prune: bool = True) -> DataFrame:
    """``current``, and without ``prune`` the rows of ``previous`` whose key it lacks."""
    if prune:
        return current
    return previous.join(current.select(key), key, "left_anti").unionByName(current)


def changes(keys: DataFrame, run: str, key: str) -> DataFrame:
    """(run, kept, added, pruned): how each run's distinct keys differ from those of the run before it (by name).

    Runs are numbered by a window over their distinct names; keys are compared by one aggregate per key and pair of runs.
    """
    each = stage(keys.select(F.col(run).alias("__run"), F.col(key).alias("__key")).distinct(), "keys")
    runs = small(each.select("__run").distinct().withColumn("__no", F.row_number().over(Window.orderBy("__run"))))
    numbered = each.join(runs, "__run")
    both = numbered.select(F.inline(F.array(F.struct(F.col("__no").alias("no"), F.lit(1).alias("here"), F.col("__key").alias("k")), F.struct((F.col("__no") + 1).alias("no"), F.lit(2).alias("here"), F.col("__key").alias("k")))))
    sides = both.groupBy("no", "k").agg(F.sum("here").alias("side"))
    counts = sides.groupBy("no").agg(F.count_if(F.col("side") == 3).alias("kept"), F.count_if(F.col("side") == 1).alias("added"), F.count_if(F.col("side") == 2).alias("pruned"))
    return counts.join(runs, F.col("no") == F.col("__no")).select(F.col("__run").alias(run), "kept", "added", "pruned")


def publish(rows: DataFrame, folder: str, run_id: str, allow_empty: bool = False) -> str:
    """Write a snapshot as a new version and point to it by an atomic replace; readers see the old one or the new one.

    Publishing nothing is an error unless ``allow_empty``. A rerun of the same run gives the same content. ``folder`` may be
    on any file system that Spark reaches.
    """
    if not allow_empty and rows.isEmpty():
        raise ValueError("nothing to publish")
    version = f"v={run_id}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(f"{folder}/{version}")
    storage.write_text(rows.sparkSession, f"{folder}/current.json", json.dumps({"version": version, "run_id": run_id}))
    return version


def current(spark: SparkSession, folder: str, allow_empty: bool = False) -> DataFrame | None:
    """The published snapshot; without one an error, or None if ``allow_empty``."""
    if not storage.exists(spark, f"{folder}/current.json"):
        if allow_empty:
            return None
        raise FileNotFoundError(f"no snapshot in {folder}")
    return spark.read.parquet(f"{folder}/{json.loads(storage.read_text(spark, f'{folder}/current.json'))['version']}")
