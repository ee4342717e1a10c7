"""Expectations, freshness and distributions of cleaned data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import folded_spaces, strip


@dataclass(frozen=True)
class Expectation:
    """``violated`` counts rows against it; ``severity`` is warn or halt."""

    name: str
    violated: Column
    severity: str = "halt"


def suite(rows: DataFrame, expectations: list[Expectation], least_rows: int = 1) -> DataFrame:
    """(expectation, severity, violations, passed), in one pass over ``rows``; ``min_rows`` checks that there are enough."""
    counts = rows.agg(F.count("*").alias("rows"), *[F.count_if(e.violated).alias(e.name) for e in expectations])
    too_few = F.greatest(F.lit(least_rows) - F.col("rows"), F.lit(0)).cast("bigint")
    lines = [F.struct(F.lit("min_rows").alias("expectation"), F.lit("halt").alias("severity"), too_few.alias("violations"))]
    lines += [F.struct(F.lit(e.name).alias("expectation"), F.lit(e.severity).alias("severity"), F.col(e.name).alias("violations")) for e in expectations]
    return counts.select(F.inline(F.array(*lines))).withColumn("passed", F.col("violations") == 0)


def halts(results: DataFrame) -> bool:
    """Whether any expectation of severity halt failed."""
    return not results.where("NOT passed AND severity = 'halt'").isEmpty()


def freshness(manifests: DataFrame, now: str, sla_hours: float = 24.0) -> DataFrame:
    """(run_id, age_hours, status) of each run at ``now`` (UTC): PASS up to the SLA, FAIL beyond, WARN if no time is known.

    The time is latest_exported_at, or else run_timestamp; one in the future passes.
    """
    known = F.coalesce(F.try_to_timestamp(F.nullif("latest_exported_at", F.lit(""))), F.try_to_timestamp(F.nullif("run_timestamp", F.lit(""))))
    age = F.round((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(known)) / 3.6e9, 3)
    rows = manifests.select("run_id", age.alias("age_hours"))
    return rows.withColumn("status", F.when(F.col("age_hours").isNull(), "WARN").when(F.col("age_hours") <= sla_hours, "PASS").otherwise("FAIL"))


def null_rates(rows: DataFrame, columns: list[str], warn: float = 0.02, halt: float = 0.4) -> DataFrame:
    """(column, blank, rate, level): share of null or blank values of each column against two thresholds, in one pass."""
    counts = rows.agg(F.count("*").alias("rows"), *[F.count_if(strip(F.coalesce(F.col(c), F.lit(""))) == "").alias(f"n_{c}") for c in columns])
    out = counts.select("rows", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("blank")) for c in columns])))
    out = out.withColumn("rate", F.round(F.col("blank") / F.greatest("rows", F.lit(1)), 6)).drop("rows")
    return out.withColumn("level", F.when(F.col("rate") > halt, "halt").when(F.col("rate") > warn, "warn").otherwise("ok"))


def shares(rows: DataFrame, key: str) -> DataFrame:
    """(key, rows, share): how rows spread over the values of a column."""
    counts = rows.groupBy(key).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.join(F.broadcast(total)).select(key, "rows", F.round(F.col("rows") / F.col("total"), 6).alias("share"))


def repeats(rows: DataFrame, text: str, severity: str = "warn", name: str = "no_duplicate_chunk_text") -> DataFrame:
    """(expectation, severity, violations, passed): rows beyond the first of each text, case and white space aside; null counts as empty."""
    counts = rows.groupBy(folded_spaces(strip(F.coalesce(text, F.lit("")))).alias("t")).agg(F.count("*").alias("n"))
    out = counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violations"))
    return out.select(F.lit(name).alias("expectation"), F.lit(severity).alias("severity"), "violations", (F.col("violations") == 0).alias("passed"))


def missing_fields(rows: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, missing, ok): which of the required columns are null or blank in each row; a column that isn't there is missing."""
    gone = lambda c: F.when(strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) if c in rows.columns else F.lit(c)
    missing = F.array_compact(F.array(*[gone(c) for c in required]))
    return rows.select(key, F.array_join(missing, ",").alias("missing")).withColumn("ok", F.col("missing") == "")
