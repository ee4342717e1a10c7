"""Joins with a side of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows, else as it is, for Spark to choose a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str, hot: int = 100_000, most_hot: int = 20_000, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with ``groups`` (one row per key, with its number of rows in ``size``), safe from hot keys.

    The largest ``most_hot`` groups of those with more than ``hot`` rows are broadcast. A larger group is among them
    unless it has less than one in ``most_hot`` of all rows, which no task suffers from. Their rows take no part in the
    shuffled join of the others: ``spread``, a column of many values, scatters them over its tasks.
    """
    value = [c for c in groups.columns if c not in keys]
    matches = lambda: [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    renamed = [F.col(k).alias(f"__{k}") for k in keys]
    largest = groups.where(F.col(size) > hot).orderBy(F.desc(size), *keys).limit(most_hot)
    if largest.isEmpty():
        return rows.join(groups.select(*renamed, F.struct(*value).alias("__found")), matches(), how).select(*rows.columns, "__found.*")
    large = F.broadcast(largest.select(*renamed, F.struct(*value).alias("__large")))
    tagged = rows.join(large, matches(), "left").select(*rows.columns, "__large")
    is_hot = F.col("__large").isNotNull()
    tagged = tagged.withColumns({"__at": F.when(is_hot, F.xxhash64(spread)).otherwise(F.xxhash64(*keys)), "__hot": is_hot})
    rest = groups.select(*renamed, F.struct(*value).alias("__rest"), F.xxhash64(*keys).alias("__to"))
    on = [F.col("__at") == F.col("__to"), ~F.col("__hot"), *matches()]
    joined = tagged.join(rest, on, "left").withColumn("__found", F.coalesce("__large", "__rest"))
    if how == "inner":
        joined = joined.where("__found IS NOT NULL")
    return joined.select(*rows.columns, "__found.*")


def join_salted(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, salts: int = 64, hot: int = 100_000, most_hot: int = 20_000, most_rows: int = 100_000) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` that may have several rows for a key, while very many rows may have the same key.

    A table of at most ``most_rows`` rows is broadcast. Otherwise the ``most_hot`` most frequent keys of those with more than
    ``hot`` rows are split: their rows, told apart by the hash of ``spread``, meet copies of the table's rows in ``salts``
    tasks. ``rows`` are read twice for that. Null keys join nothing.
    """
    known = small(table, most_rows)
    if known is not table:
        return rows.join(known, keys)
    frequent = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).orderBy(F.desc("__n"), *keys).limit(most_hot)
    frequent = F.broadcast(frequent.select(*keys, F.lit(True).alias("__hot")))
    salted = rows.join(frequent, keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    copies = table.join(frequent, keys, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return salted.join(copies, [*keys, "__salt"]).drop("__salt")
