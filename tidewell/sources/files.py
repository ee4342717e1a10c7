"""Files in and out: CSV exports, text corpora, JSON and JSON lines, manifests and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import strip
from tidewell.sources import storage

EXPORT = T.StructType([T.StructField(c, T.StringType()) for c in ("chunk_id", "doc_id", "chunk_text", "effective_date", "exported_at")])
MANIFEST = T.StructType(
    [
        T.StructField("run_id", T.StringType()), T.StructField("run_timestamp", T.StringType()), T.StructField("raw_path", T.StringType()),
        *[T.StructField(f"{k}_records", T.LongType()) for k in ("raw", "cleaned", "quarantine")],
        T.StructField("latest_exported_at", T.StringType()), T.StructField("skipped_validate", T.BooleanType()), T.StructField("snapshot", T.StringType()),
    ]
)


def read_export(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, broken records) of a CSV export with quoted fields, as stripped strings; missing fields are "".

    ``row_id`` keeps the order of one file. Records with more than five fields are broken (reason ``column_count``), and
    nothing of them is loaded. With ``multi_line`` fields may hold line breaks, and a file is read by one task: give large
    exports as many files, or read files without line breaks in fields with ``multi_line=False``, which splits them.
    """
    schema = T.StructType([*EXPORT.fields, T.StructField("_record", T.StringType())])
    raw = spark.read.schema(schema).csv(path, header=True, multiLine=multi_line, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_record", enforceSchema=True)
    raw = raw.withColumn("row_id", F.monotonically_increasing_id())
    too_many = F.col("_record").isNotNull() & F.col(EXPORT.names[-1]).isNotNull()
    rows = raw.where(~too_many).select("row_id", *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in EXPORT.names])
    return rows, raw.where(too_many).select("row_id", F.col("_record").alias("record"), F.lit("column_count").alias("reason"))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, text): every file of a folder as one text."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON file that holds one object or an array of objects, or a folder of such files."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines) of JSON lines; blank lines are skipped. A broken line comes with its file and block."""
    whole = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block_start")).where(F.trim("value") != "")
    parsed = lines.withColumn("j", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    return parsed.where("j._broken IS NULL").select("j.*").drop("_broken"), parsed.where("j._broken IS NOT NULL").select("value", "file_name", "block_start")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV files with a header, CRLF line ends and doubled quotes; nulls become empty fields.

    A folder without rows still gets one file with the header.
    """
    out = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    if out.isEmpty():
        storage.write_text(rows.sparkSession, f"{path}/part-00000.csv", ",".join(columns) + "\r\n")
        return
    # a quote mark needs the field to be quoted; empty fields stay bare
    out.write.csv(path, header=True, lineSep="\r\n", quote='"', escape='"', emptyValue="", mode="overwrite")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object per line, characters beyond ASCII as they are."""
    rows.write.mode("overwrite").json(path)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small nested object (a manifest or report) as one JSON file, put in place by an atomic rename."""
    storage.write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2))


def write_traces(traces: DataFrame, folder: str) -> None:
    """Traces as JSON lines added to ``folder``, in folders by the day of the run; none is ever overwritten.

    The key of a trace is its ``run_id``; rows of the same run stand side by side.
    """
    day = F.regexp_extract("run_id", r"(\d{4}-?\d{2}-?\d{2})", 1)
    traces.withColumn("day", F.when(day == "", "unknown").otherwise(day)).write.mode("append").partitionBy("day").json(folder)


def write_log(spark: SparkSession, path: str, metrics: dict) -> None:
    """A run's metrics as ``key=value`` lines, in a file of the run."""
    storage.write_text(spark, path, "".join(f"{k}={v}\n" for k, v in metrics.items()))


#: What every manifest must have.
REQUIRED = ("run_id", "raw_records", "cleaned_records", "quarantine_records")


def missing_keys(spark: SparkSession, path: str) -> list[str]:
    """The required keys that a manifest lacks; all of them if there is no such file."""
    if not storage.exists(spark, path):
        return list(REQUIRED)
    return [k for k in REQUIRED if k not in json.loads(storage.read_text(spark, path))]


def markdown_table(rows: DataFrame, most: int = 1_000, cell_chars: int = 50) -> str:
    """A report's few rows as a Markdown table; a report of more than ``most`` rows is refused, long cells are cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    show = lambda v: "N/A" if v is None else str(v).replace("\n", " ").replace("|", "/")[:cell_chars]
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in found)]) + "\n"


def scorecard_markdown(label: str, averages: DataFrame, questions: DataFrame) -> str:
    """A report in two parts: average scores by metric (null and 0 show as N/A), and a row per question with notes cut short."""
    shown = averages.select("metric", F.when(F.coalesce("average", F.lit(0.0)) != 0, F.format_string("%.2f", "average")).alias("average"))
    return f"# Scorecard: {label}\n\n## Averages\n\n{markdown_table(shown)}\n## Questions\n\n{markdown_table(questions)}"
