"""Mixed timestamp formats and time zones (problem 6), brought to one date or one UTC instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.moments import instant_text, source_rules, with_moments
from tidewell.operators.joins import small
from tidewell.operators.parsing import displaced


def normalised(export: DataFrame, quarantine: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_table, row_key, field, value) for every field that names a date or instant in another form than wanted.

    Wanted are ``yyyy-MM-dd`` for effective_date and effective_date_normalized and ``yyyy-MM-ddTHH:mm:ss.SSSSSSZ`` for
    exported_at. Rows of the export whose text ran on into the dates (or took them in, so that they are empty) are left
    out. Null, empty and impossible values give no row; repeated rows give a row each; empty tables give none; further
    columns are ignored. Sources that export_sources doesn't name count as UTC with DMY. No shuffle: one pass per table.
    """
    rules = small(source_rules(sources))
    ran_on, _ = displaced()
    rows = export.select("row_id", "source_system", "effective_date", "exported_at", ran_on.alias("ran_on")).join(rules, "source_system", "left")
    rows = with_moments(rows, {"e": "effective_date", "x": "exported_at"}, "default_tz", "date_order")
    rows = rows.where(~(F.col("ran_on") & F.col("e_date").isNull()))
    fields = F.array(
        F.struct(F.lit("effective_date").alias("field"), F.col("effective_date").alias("text"), F.col("e_date").alias("value")),
        F.struct(F.lit("exported_at").alias("field"), F.col("exported_at").alias("text"), instant_text(F.col("x_micros")).alias("value")),
    )
    first = rows.select(F.lit("policy_export_dirty").alias("source_table"), F.col("row_id").alias("row_key"), F.inline(fields))
    other = quarantine.select("quarantine_id", "source_system", "effective_date_normalized").join(rules, "source_system", "left")
    other = with_moments(other, {"e": "effective_date_normalized"}, "default_tz", "date_order")
    second = other.select(F.lit("quarantine_ci_smoke").alias("source_table"), F.col("quarantine_id").alias("row_key"), F.lit("effective_date_normalized").alias("field"), F.col("effective_date_normalized").alias("text"), F.col("e_date").alias("value"))
    return first.unionAll(second).where("value IS NOT NULL AND text <> value").select("source_table", "row_key", "field", "value")
