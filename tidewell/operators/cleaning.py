"""Cleaning of a raw export by an ordered list of rules; rows that fail one are quarantined with the first reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import folded_spaces, strip
from tidewell.operators.joins import join_groups, small
from tidewell.session import stage

ISO, DAY_FIRST = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$"


@dataclass(frozen=True)
class Rule:
    """A row for which ``failed`` holds is quarantined with ``reason``."""

    reason: str
    failed: Column


def iso_date(c: Column) -> Column:
    """``yyyy-MM-dd`` as it is, ``dd/mm/yyyy`` turned round, anything else null; no calendar check."""
    return F.when(c.rlike(ISO), c).when(c.rlike(DAY_FIRST), F.regexp_replace(c, F.lit(DAY_FIRST), F.lit("$3-$2-$1")))


def default_rules() -> list[Rule]:
    """The rules in order, over the columns that ``prepared`` adds."""
    return [
        Rule("unknown_doc_id", ~F.col("known")),
        Rule("missing_effective_date", F.col("date_raw") == ""),
        Rule("invalid_effective_date_format", F.col("date_iso").isNull()),
        Rule("stale_effective_date", F.coalesce(F.col("date_iso") < F.col("cutoff"), F.lit(False))),
        Rule("missing_chunk_text", F.col("text") == ""),
    ]


def prepared(export: DataFrame, catalog: DataFrame) -> DataFrame:
    """``export`` with stripped fields, the ISO date, and from the catalog whether the document is known and its cutoff date.

    The cutoff is the date from which the listed version holds; the catalog is small by its size check. Nulls count as "".
    """
    listed = small(catalog.groupBy(F.col("doc_id").alias("listed_id")).agg(F.max("effective_date").alias("cutoff")))
    value = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    rows = export.withColumns({"document": value("doc_id"), "text": value("chunk_text"), "date_raw": value("effective_date"), "exported": value("exported_at")})
    rows = rows.withColumn("date_iso", iso_date(F.col("date_raw"))).join(listed, F.col("document") == F.col("listed_id"), "left")
    return rows.withColumn("known", F.col("listed_id").isNotNull()).drop("listed_id")


def tagged(rows: DataFrame, rules: list[Rule], order: str = "row_id", key: str = "text") -> DataFrame:
    """``rows`` with ``reason``: the first rule that fails, or ``duplicate_chunk_text``, or null for clean rows.

    Of rows that pass all rules and have equal texts (case and white space aside) the one first in ``order`` stays; only
    those take part. The first of each repeated text is found by an aggregate, to which a task sends a text once; rows
    come to it by ``join_groups``, so that a text on a third of all rows meets in no task. Rows that failed a rule have
    no text to join on and are scattered by ``order``. Texts are compared whole, their hash only places them.
    """
    reason = F.lit(None).cast("string")
    for rule in reversed(rules):
        reason = F.when(rule.failed, F.lit(rule.reason)).otherwise(reason)
    rows = rows.withColumn("__reason", reason).withColumn("__text", F.when(F.col("__reason").isNull(), folded_spaces(F.col(key))))
    rows = rows.withColumn("__place", F.when(F.col("__text").isNull(), F.xxhash64(order)).otherwise(F.xxhash64("__text")))
    firsts = rows.where("__reason IS NULL").groupBy("__place", "__text").agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    out = join_groups(rows, stage(firsts, "firsts"), ["__place", "__text"], "__n", order, how="left")
    repeated = F.col("__reason").isNull() & (F.col(order) > F.col("__first"))
    return out.withColumn("reason", F.when(repeated, "duplicate_chunk_text").otherwise(F.col("__reason"))).drop("__reason", "__text", "__place", "__first", "__n")


def rewritten(rows: DataFrame, document: str, old: str, new: str, mark: str) -> DataFrame:
    """In texts of documents like ``document`` (SQL LIKE) every ``old`` becomes ``new``, and ``mark`` is added behind."""
    hit = F.col("document").like(document) & F.col("text").contains(old)
    return rows.withColumn("text", F.when(hit, F.concat(F.replace("text", F.lit(old), F.lit(new)), F.lit(mark))).otherwise(F.col("text")))


def content_ids(rows: DataFrame) -> DataFrame:
    """``chunk_key`` from document and text alone: stable when rows are added before."""
    digest = F.substring(F.sha2(F.concat_ws("|", "document", "text"), 256), 1, 16)
    return rows.withColumn("chunk_key", F.concat_ws("_", "document", digest))


def positional_ids(rows: DataFrame, order: str = "row_id", block: int = 100_000) -> DataFrame:
    """``seq`` 1..n in ``order`` and ``chunk_key`` from document, text and seq.

    Counts of blocks of order values give each block its start, so that no task ranks more than a block's rows. Rows
    without an order value come first.
    """
    rows = rows.withColumn("__block", F.coalesce(F.floor(F.col(order) / block), F.lit(-(2**62))))
    ahead = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__block").agg(F.count("*").alias("n")).withColumn("__start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("__block").orderBy(order)
    ranked = rows.withColumn("__rank", F.row_number().over(inside)).join(small(starts), "__block")
    ranked = ranked.withColumn("seq", F.col("__start") + F.col("__rank")).drop("__block", "__start", "__rank")
    digest = F.substring(F.sha2(F.concat_ws("|", "document", "text", F.col("seq").cast("string")), 256), 1, 16)
    return ranked.withColumn("chunk_key", F.concat_ws("_", "document", F.col("seq").cast("string"), digest))


def clean(export: DataFrame, catalog: DataFrame) -> DataFrame:
    """The export with ``reason`` by the default rules; split it by ``reason IS NULL`` into clean and quarantined rows."""
    return tagged(prepared(export, catalog), default_rules())
