"""Rows that fail to parse (problem 5): set apart with the reason, while valid rows go on.

Parsed cells are exploded into (row, column, value), joined with a rule table that says which check holds for which
column, checked, and the errors aggregated to the first one of each row; what is left after an anti-join is clean.
What is wrong with a whole record (quoting, number of columns) is a cell of its own, with the lowest ranks, since cells
out of place can't be checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.csvtext import with_cells
from tidewell.functions.moments import BLANK, source_rules, with_moments
from tidewell.operators.joins import small

# Columns of the two layouts and the reasons in use.
EXPORT = ("chunk_id", "doc_id", "chunk_text", "effective_date", "exported_at")
LAYOUTS = {"export": EXPORT, "quarantine": (*EXPORT, "reason", "effective_date_normalized")}
REASONS = ("duplicate_chunk_text", "missing_effective_date", "invalid_effective_date_format", "unknown_doc_id", "stale_effective_date", "missing_chunk_text")

#: Columns that aren't in the tables: what is wrong with a whole record, and the date of a row whose text ran on into it.
RECORD, RUN_ON = "(record)", "(effective_date, run on)"
#: (table, layout, column, check, whether blanks count as empty, rank, reason): the rule table.
RULES = (
    ("policy_export_lines", "record", RECORD, "fact", False, 1, "broken_quoting"),
    ("policy_export_lines", "record", RECORD, "fact", False, 2, "column_count"),
    ("policy_export_dirty", "table", RUN_ON, "date", True, 1, "column_count"),
    ("policy_export_dirty", "record", RECORD, "fact", False, 2, "broken_quoting"),
    ("policy_export_lines", "export", "chunk_id", "digits", False, 3, "invalid_chunk_id"),
    ("policy_export_lines", "export", "effective_date", "date", False, 4, "invalid_effective_date"),
    ("policy_export_lines", "export", "exported_at", "instant", False, 5, "invalid_exported_at"),
    ("policy_export_lines", "quarantine", "chunk_id", "digits", False, 3, "invalid_chunk_id"),
    ("policy_export_lines", "quarantine", "effective_date", "date", False, 4, "invalid_effective_date"),
    ("policy_export_lines", "quarantine", "exported_at", "instant", False, 5, "invalid_exported_at"),
    ("policy_export_lines", "quarantine", "reason", "reason", False, 6, "invalid_reason"),
    ("policy_export_dirty", "table", "effective_date", "date", True, 3, "invalid_effective_date"),
    ("quarantine_ci_smoke", "table", "reason", "reason", True, 6, "invalid_reason"),
)


def trimmed(c: Column) -> Column:
    """``c`` without blanks of any kind at its ends."""
    return F.regexp_replace(c, F.lit(f"^{BLANK}+|{BLANK}+$"), F.lit(""))


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules, which every task gets: a row for each entry of RULES."""
    return F.broadcast(spark.createDataFrame(RULES, "source_table string, layout string, column string, check string, blank_is_empty boolean, rank int, reason string"))


def checked_cells(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Errors among exploded cells: one row (source_table, row_key, rank, reason) for each failed rule.

    ``cells`` has source_table, layout, row_key, column, value, default_tz, date_order. A null value fails ``digits`` and
    ``reason``, and passes ``date`` and ``instant`` (nothing is named). A ``fact`` fails where the value is the rule's reason.
    """
    ruled = cells.join(rules, ["source_table", "layout", "column"])
    value, check = F.coalesce(F.col("value"), F.lit("")), F.col("check")
    empty = (value == "") | (F.col("blank_is_empty") & (trimmed(value) == ""))
    # all checks in one pass; only dates and instants are looked at as such
    timed = ruled.withColumn("timed", F.when(check.isin("date", "instant") & ~empty, F.col("value")))
    read = with_moments(timed, {"v": "timed"}, "default_tz", "date_order")
    # a value whose day is impossible names no instant either
    named = F.when(check == "date", F.col("v_date").isNotNull()).otherwise(F.col("v_micros").isNotNull())
    plain = F.when(check == "digits", value.rlike("^[0-9]+$")).when(check == "reason", F.lower(trimmed(value)).isin(*REASONS)).when(check == "fact", value != F.col("reason")).otherwise(True)
    return read.where(~F.when(F.col("timed").isNotNull(), named).otherwise(plain)).select("source_table", "row_key", "rank", "reason")


def _record_cells(rows: DataFrame, source_table: str, key: str, fact: Column) -> DataFrame:
    """A cell for what is wrong with each record: ``fact`` is null where nothing is."""
    none = F.lit(None).cast("string")
    return rows.select(F.lit(source_table).alias("source_table"), F.lit("record").alias("layout"), F.col(key).alias("row_key"), none.alias("default_tz"), none.alias("date_order"), F.lit(RECORD).alias("column"), fact.alias("value")).where("value IS NOT NULL")


def first_errors(errors: DataFrame) -> DataFrame:
    """The first reason of each row, by rank: (source_table, row_key, reason)."""
    return errors.groupBy("source_table", "row_key").agg(F.min_by("reason", "rank").alias("reason"))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """policy_export_lines with ``csv_cells``, ``quoting_ok`` and ``columns`` (the names of the layout)."""
    names = F.create_map(*[x for k, v in LAYOUTS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    out = with_cells(lines, "raw_line")
    return out.withColumn("columns", F.element_at(names, F.col("layout"))).withColumnRenamed("csv_quoting_ok", "quoting_ok")


def line_errors(parsed: DataFrame, zones: DataFrame, rules: DataFrame) -> DataFrame:
    """All errors of the lines of ``parsed_lines``, with the ``source_rules`` in ``zones``; a layout that is not known has no right number of columns."""
    structure = F.when(~F.col("quoting_ok"), F.lit("broken_quoting")).when(~F.coalesce(F.size("csv_cells") == F.size("columns"), F.lit(False)), F.lit("column_count"))
    fine = parsed.where(structure.isNull()).join(zones, "source_system", "left")
    cells = fine.select(
        F.lit("policy_export_lines").alias("source_table"), "layout", F.col("line_id").alias("row_key"), "default_tz", "date_order",
        F.explode(F.filter(F.arrays_zip(F.col("columns").alias("column"), F.col("csv_cells").alias("value")), lambda c: ~c["column"].isin("doc_id", "chunk_text"))).alias("cell"),
    ).select("*", "cell.column", "cell.value").drop("cell")
    return checked_cells(cells.unionByName(_record_cells(parsed, "policy_export_lines", "line_id", structure)), rules)


def displaced(text: str = "chunk_text", second: str = "effective_date", third: str = "exported_at") -> tuple[Column, Column]:
    """(ran on, took in): whether text ran on into the next columns, and whether it took in the fields that follow.

    ``ran on`` is asked only of rows whose ``second`` names no date: it holds the rest of a sentence, seen from the blank
    behind the comma that parted it, from a decimal comma between two digits, or from a phrase of four words or more.
    ``took in`` needs both following columns empty, and the end of a line of the text in the shape of two fields; that they are a date and an instant is for the caller to check on ``tail_date`` and ``tail_instant``.
    """
    t, s = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(second), F.lit(""))
    ran_on = s.rlike(r"^\s+\p{L}") | (t.rlike(r"\d$") & s.rlike(r"^\d") & s.rlike(r"\p{L}")) | s.rlike(r"\p{L}+\s+\p{L}+\s+\p{L}+\s+\p{L}+")
    took_in = (trimmed(s) == "") & (trimmed(F.coalesce(F.col(third), F.lit(""))) == "") & t.contains(",")
    return ran_on & (trimmed(s) != ""), took_in


#: Two fields at the end of a line of a text, as one with broken quoting took them in.
TAIL = r'(?m),"?((?:[A-Za-z]+ \d{1,2}, \d{4}|\d{1,2} tháng \d{1,2}, \d{4})|[^,"\n]*)"?,"?((?:[A-Z][a-z]{2}, [^,"\n]*)|(?:[A-Z][a-z]{2,8} \d{1,2}, \d{4}[^,"\n]*)|[^,"\n]*)"?[ \t\r]*$'


def dirty_errors(export: DataFrame, zones: DataFrame, rules: DataFrame) -> DataFrame:
    """All errors of policy_export_dirty: fields out of place first, then impossible dates."""
    with_source = export.select("row_id", "source_system", "chunk_text", "effective_date", "exported_at").join(zones, "source_system", "left")
    ran_on, took_in = displaced()
    tailed = with_source.withColumns({"__took": took_in, "__ran": ran_on})
    tails = F.arrays_zip(*[F.regexp_extract_all("chunk_text", F.lit(TAIL), F.lit(i)).alias(name) for i, name in ((1, "tail_date"), (2, "tail_instant"))])
    suspects = tailed.where("__took").select("row_id", "default_tz", "date_order", F.inline(tails))
    suspects = with_moments(suspects, {"d": "tail_date", "x": "tail_instant"}, "default_tz", "date_order")
    took = suspects.where(F.col("x_micros").isNotNull() | (F.col("d_date").isNotNull() & (F.trim("tail_instant") == "")))
    column = F.when(F.col("__ran"), RUN_ON).otherwise("effective_date")  # the rest of a sentence names no date, or it is none
    cell = F.array(F.struct(column.alias("column"), F.col("effective_date").alias("value")))
    cells = tailed.select(F.lit("policy_export_dirty").alias("source_table"), F.lit("table").alias("layout"), F.col("row_id").alias("row_key"), "default_tz", "date_order", F.inline(cell))
    return checked_cells(cells.unionByName(_record_cells(took, "policy_export_dirty", "row_id", F.lit("broken_quoting"))), rules)


def quarantine_errors(quarantine: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of quarantine_ci_smoke whose reason is none of the six."""
    cells = quarantine.select(F.lit("quarantine_ci_smoke").alias("source_table"), F.lit("table").alias("layout"), F.col("quarantine_id").alias("row_key"), F.lit(None).cast("string").alias("default_tz"), F.lit(None).cast("string").alias("date_order"), F.lit("reason").alias("column"), F.col("reason").alias("value"))
    return checked_cells(cells, rules)


def failed_rows(lines: DataFrame, export: DataFrame, quarantine: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_table, row_key, reason) of every row of the three tables that fails, by its first reason.

    Nulls: a null raw_line is broken_quoting, a null reason invalid_reason, null dates are no error. Empty tables give no
    rows. Repeated row keys give one row with the first reason. Further columns are ignored.
    """
    rules, zones = rule_table(lines.sparkSession), small(source_rules(sources))
    errors = line_errors(parsed_lines(lines), zones, rules).unionAll(dirty_errors(export, zones, rules)).unionAll(quarantine_errors(quarantine, rules))
    return first_errors(errors)


def loaded_lines(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """The valid records of the lines as columns, by an anti-join with the failed ones."""
    parsed = parsed_lines(lines)
    clean = _without(parsed, first_errors(line_errors(parsed, zones, rule_table(lines.sparkSession))), "line_id")
    cells = [F.get("csv_cells", F.lit(i)).alias(c) for i, c in enumerate(LAYOUTS["quarantine"])]
    return clean.select("line_id", "file_name", "line_no", "source_system", "layout", *cells)


def loaded_export(export: DataFrame, zones: DataFrame) -> DataFrame:
    """The valid rows of policy_export_dirty with all their columns, by an anti-join with the failed ones."""
    return _without(export, first_errors(dirty_errors(export, zones, rule_table(export.sparkSession))), "row_id")


def loaded_quarantine(quarantine: DataFrame) -> DataFrame:
    """The valid rows of quarantine_ci_smoke with all their columns, by an anti-join with the failed ones."""
    return _without(quarantine, first_errors(quarantine_errors(quarantine, rule_table(quarantine.sparkSession))), "quarantine_id")


def _without(rows: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """``rows`` but those whose ``key`` failed; null keys are compared as equal, as in ``first_errors``."""
    failed = failed.select(F.col("row_key").alias("__failed_key"))
    return rows.join(failed, F.col(key).eqNullSafe(F.col("__failed_key")), "left_anti")


def loaded_rows(lines: DataFrame, export: DataFrame, quarantine: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row of the three tables that ``failed_rows`` does not set apart: source_table, row_key and all their columns.

    A column that a table lacks is null in its rows. Empty tables give no rows; all rows of a key that failed are out.
    """
    zones = small(source_rules(sources))
    parts = (
        ("policy_export_lines", "line_id", loaded_lines(lines, zones)),
        ("policy_export_dirty", "row_id", loaded_export(export, zones)),
        ("quarantine_ci_smoke", "quarantine_id", loaded_quarantine(quarantine)),
    )
    first, *rest = (df.select(F.lit(name).alias("source_table"), F.col(key).alias("row_key"), *df.columns) for name, key, df in parts)
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first
