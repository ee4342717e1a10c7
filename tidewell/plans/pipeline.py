"""The whole run of an export: load, clean, check, publish, manifest, freshness."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import cleaning, quality, snapshots
from tidewell.session import stage
from tidewell.sources import files, storage

OK, NO_INPUT, HALTED, NOT_PUBLISHED = 0, 1, 2, 3


@dataclass
class Run:
    """Outcome of a run: ``code`` is one of OK, NO_INPUT, HALTED and NOT_PUBLISHED."""

    code: int
    run_id: str
    manifest: dict = field(default_factory=dict)
    expectations: DataFrame | None = None


def expectations() -> list[quality.Expectation]:
    return [
        quality.Expectation("no_empty_document", F.col("document") == ""),
        quality.Expectation("iso_date", F.col("date_iso").isNull()),
        quality.Expectation("text_of_eight_characters", F.length("text") < 8, "warn"),
    ]


def run(spark: SparkSession, raw: str, catalog: DataFrame, folder: str, run_id: str | None = None, rewrites: list[tuple[str, str, str, str]] = (), skip_validate: bool = False) -> Run:
    """Clean the CSV export ``raw`` and publish it as a snapshot under ``folder``.

    The tagged rows are written once and read for the clean rows, the quarantine and the counts. A failed expectation of
    severity halt stops before publishing unless ``skip_validate``. The manifest is written after the snapshot. Records with
    too many fields are quarantined as ``column_count``, their text in chunk_text.
    """
    now = dt.datetime.now(dt.timezone.utc)
    run_id = run_id or f"{now:%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:6]}"
    if not storage.exists(spark, str(raw)):
        return Run(NO_INPUT, run_id)
    loaded, broken = files.read_export(spark, str(raw))
    tagged = stage(cleaning.clean(loaded, catalog), "run")
    clean = tagged.where("reason IS NULL")
    for rewrite in rewrites:
        clean = cleaning.rewritten(clean, *rewrite)
    clean = cleaning.content_ids(clean)
    results = quality.suite(clean, expectations())
    if quality.halts(results) and not skip_validate:
        return Run(HALTED, run_id, expectations=results)
    columns = {"chunk_key": "chunk_key", "document": "doc_id", "text": "chunk_text", "date_iso": "effective_date", "exported": "exported_at"}
    published = clean.select(*[F.col(a).alias(b) for a, b in columns.items()]).withColumn("run_id", F.lit(run_id))
    try:
        version = snapshots.publish(published, f"{folder}/index", run_id)
    except ValueError:
        return Run(NOT_PUBLISHED, run_id, expectations=results)
    quarantine = tagged.where("reason IS NOT NULL").select(*files.EXPORT.names, "reason", F.col("date_iso").alias("effective_date_normalized"))
    empty = [F.lit("").alias(c) for c in files.EXPORT.names]
    broken = stage(broken.select(*empty, "reason", F.lit("").alias("effective_date_normalized"), "record").withColumn("chunk_text", F.col("record")).drop("record"), "broken")
    quarantine = quarantine.unionByName(broken)
    broken_records = broken.count()
    files.write_csv(published, f"{folder}/cleaned/{run_id}", ["chunk_key", "doc_id", "chunk_text", "effective_date", "exported_at"])
    files.write_csv(quarantine, f"{folder}/quarantine/{run_id}", quarantine.columns)
    counts = tagged.agg(F.count("*").alias("raw"), F.count_if(F.col("reason").isNull()).alias("clean"), F.max(F.when(F.col("reason").isNull(), F.col("exported"))).alias("latest")).first()
    manifest = {
        "run_id": run_id, "run_timestamp": now.isoformat(), "raw_path": str(raw), "raw_records": counts["raw"] + broken_records, "cleaned_records": counts["clean"],
        "quarantine_records": counts["raw"] + broken_records - counts["clean"], "latest_exported_at": counts["latest"] or "", "skipped_validate": skip_validate, "snapshot": version,
    }
    files.write_json(spark, f"{folder}/manifests/{run_id}.json", manifest)
    files.write_log(spark, f"{folder}/logs/{run_id}.log", manifest)
    return Run(OK, run_id, manifest, results)


def freshness_code(spark: SparkSession, manifest: str, now: str, sla_hours: float = 24.0) -> int:
    """0 if the run of a manifest is fresh, or its time unknown, at ``now``; 1 if it is too old."""
    rows = files.read_json(spark, manifest, files.MANIFEST)
    return int(quality.freshness(rows, now, sla_hours).where("status = 'FAIL'").count() > 0)
