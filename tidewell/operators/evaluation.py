"""Context blocks, confidence, recall, scorecards and trace metrics."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_decimals(c: Column) -> Column:
    """A number of 0 or more with two decimals, rounded as its exact binary value asks (what ``%.2f`` gives in C)."""
    product, big = c * 100, c * 134217729.0
    high = big - (big - c)
    rest = (high * 100 - product) + (c - high) * 100  # what the product lost
    whole = F.floor(product)
    half = product - whole
    up = (half > 0.5) | ((half == 0.5) & ((rest > 0) | ((rest == 0) & (whole % 2 == 1))))
    cents = whole + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def context_block(chunks: Column) -> Column:
    """``[i] source | section | score=0.00`` and the text of each chunk, parted by blank lines; sections and positive scores only."""

    def line(c: Column, i: Column) -> Column:
        section = F.coalesce(c["metadata"]["section"], F.lit(""))
        score = F.coalesce(c["score"], F.lit(0.0))
        head = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(c["source"], F.lit("unknown")))
        head = F.concat(head, F.when(section != "", F.concat(F.lit(" | "), section)).otherwise(""), F.when(score > 0, F.concat(F.lit(" | score="), two_decimals(score))).otherwise(""))
        return F.concat(head, F.lit("\n"), F.coalesce(c["text"], F.lit("")))

    return F.when(F.coalesce(F.size(chunks), F.lit(0)) <= 0, F.lit("(no context)")).otherwise(F.array_join(F.transform(chunks, line), "\n\n"))


def confidence(chunks: Column, answer: Column, exceptions: Column, abstaining: list[str]) -> Column:
    """0.1 without chunks, 0.3 for an abstaining answer, else the mean score less 0.05 an exception, within 0.1 and 0.95."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    abstains = F.lit(False)
    for phrase in abstaining:
        abstains = abstains | low.contains(phrase)
    total = F.aggregate(chunks, F.lit(0.0), lambda a, c: a + F.coalesce(c["score"], F.lit(0.0)))
    n = F.coalesce(F.size(chunks), F.lit(0))
    mean = total / F.greatest(n, F.lit(1)) - 0.05 * F.greatest(F.coalesce(F.size(exceptions), F.lit(0)), F.lit(0))
    return F.when(n <= 0, F.lit(0.1)).when(abstains, F.lit(0.3)).otherwise(F.bround(F.greatest(F.lit(0.1), F.least(F.lit(0.95), mean)), 2))


def base_name(path: Column) -> Column:
    """The lower-case file name of a path without .pdf, .md or .txt."""
    return F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.(pdf|md|txt)$", "")


def context_recall(expected: Column, found: Column) -> tuple[Column, Column]:
    """(recall, score 0-5, rounded half to even) of expected sources among found ones; null if none is expected."""
    names = F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda s: F.lower(s))
    hits = F.size(F.filter(expected, lambda e: F.exists(names, lambda s: s.contains(base_name(e)))))
    recall = F.when(F.coalesce(F.size(expected), F.lit(0)) > 0, hits / F.size(expected))
    return recall, F.bround(recall * 5, 0).cast("int")


def retrieval_checks(blob: Column, wanted: Column, banned: Column) -> tuple[Column, Column]:
    """(contains_expected, hits_forbidden): any of the wanted and of the banned phrases in the lower-case text; none wanted is true."""
    low = F.lower(F.coalesce(blob, F.lit("")))
    any_of = lambda phrases: F.exists(phrases, lambda p: low.contains(F.lower(p)))
    empty = lambda phrases: F.coalesce(F.size(phrases), F.lit(0)) <= 0
    return F.when(empty(wanted), True).otherwise(any_of(wanted)), F.when(empty(banned), False).otherwise(any_of(banned))


def trace_metrics(traces: DataFrame) -> DataFrame:
    """Per route: traces, their whole percentage, and averages of confidence and latency over values other than 0."""
    total = traces.agg(F.count("*").alias("total"))
    not_zero = lambda c: F.round(F.avg(F.when(F.col(c) != 0, F.col(c))), 6)
    by = traces.groupBy("supervisor_route").agg(F.count("*").alias("traces"), not_zero("confidence").alias("avg_confidence"), not_zero("latency_ms").alias("avg_latency_ms"), F.count_if("hitl_triggered").alias("hitl"), F.count_if(F.size("mcp_tools_used") > 0).alias("with_tools"))
    rate = lambda c: F.floor(100 * F.col(c) / F.col("total")).cast("bigint")
    return by.join(F.broadcast(total)).select("supervisor_route", "traces", rate("traces").alias("percent"), "avg_confidence", "avg_latency_ms", "hitl", "with_tools")


def top_sources(traces: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` sources that most traces name (a top-k report; ties by name)."""
    return traces.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("traces")).orderBy(F.desc("traces"), "source").limit(k)


def compared(variant: DataFrame, baseline: DataFrame, metrics: list[str]) -> DataFrame:
    """(id, variant_<metric>, baseline_<metric>, variant_total, baseline_total, winner) for every id of ``variant``.

    Totals count a missing value, or a missing row of ``baseline``, as 0; the larger total wins. ``baseline`` has one row an id.
    """
    rows = variant.select("id", *[F.col(m).cast("double").alias(f"variant_{m}") for m in metrics]).join(baseline.select("id", *[F.col(m).cast("double").alias(f"baseline_{m}") for m in metrics]), "id", "left")
    for side in ("variant", "baseline"):
        total = F.lit(0.0)
        for m in metrics:
            total = total + F.coalesce(F.col(f"{side}_{m}"), F.lit(0.0))
        rows = rows.withColumn(f"{side}_total", F.round(total, 6))
    better = F.col("variant_total") - F.col("baseline_total")
    return rows.withColumn("winner", F.when(better > 0, "Variant").when(better < 0, "Baseline").otherwise("Tie"))


def averages(variant: DataFrame, baseline: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, baseline, variant, delta): averages over values that are there; no delta where one is missing or 0."""
    means = lambda side, name: side.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])))
    both = means(baseline, "baseline").join(F.broadcast(means(variant, "variant")), "metric")
    known = (F.col("baseline") != 0) & (F.col("variant") != 0)
    return both.select("metric", F.round("baseline", 6).alias("baseline"), F.round("variant", 6).alias("variant"), F.when(known, F.round(F.col("variant") - F.col("baseline"), 6)).alias("delta"))


def both_sides(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    """The rows of both sides under each other, with ``side``: the table of an A/B report."""
    return baseline.withColumn("side", F.lit("baseline")).unionByName(variant.withColumn("side", F.lit("variant")))


def retrieval_report(rows: DataFrame, k: int, preview: int = 180) -> DataFrame:
    """One row per (question_id, question, chunks, wanted, banned, want_top1): what its first ``k`` chunks show.

    Phrases are looked for in the lower-case texts of the chunks, put together; none wanted counts as found, none banned as
    not. ``top1_doc_expected`` is yes or no, and empty where no source is wanted. The preview is of the first chunk as it is.
    """
    used = F.slice(F.coalesce("chunks", F.array().cast(rows.schema["chunks"].dataType)), 1, k)
    t = rows.withColumn("__used", used)
    blob = F.array_join(F.transform("__used", lambda c: F.coalesce(c["text"], F.lit(""))), " ")
    expected, forbidden = retrieval_checks(blob, F.col("wanted"), F.col("banned"))
    yes = lambda c: F.when(c, "yes").otherwise("no")
    first = F.get("__used", F.lit(0))
    top1, want = F.coalesce(first["source"], F.lit("")), F.trim(F.coalesce("want_top1", F.lit("")))
    shown = F.replace(F.substring(F.coalesce(first["text"], F.lit("")), 1, preview), F.lit("\n"), F.lit(" "))
    return t.select("question_id", "question", top1.alias("top1_doc_id"), shown.alias("top1_preview"), yes(expected).alias("contains_expected"), yes(forbidden).alias("hits_forbidden"), F.when(want == "", "").otherwise(yes(top1 == want)).alias("top1_doc_expected"), F.lit(k).alias("top_k_used"))


def context_with_exceptions(chunks: Column, exceptions: Column) -> Column:
    """Chunks with their source and score, then a list of the rules of the exceptions, each part under a heading."""
    line = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(c["source"], F.lit("unknown")), F.lit(" (relevance: "), two_decimals(F.coalesce(c["score"], F.lit(0.0))), F.lit(")\n"), F.coalesce(c["text"], F.lit("")))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    nothing = F.array().cast("array<string>")
    documents = F.when(some(chunks), F.concat(F.array(F.lit("=== DOCUMENTS ===")), F.transform(chunks, line))).otherwise(nothing)
    rules = F.when(some(exceptions), F.concat(F.array(F.lit("=== POLICY EXCEPTIONS ===")), F.transform(exceptions, lambda e: F.concat(F.lit("- "), F.coalesce(e["rule"], F.lit("")))))).otherwise(nothing)
    return F.when(some(chunks) | some(exceptions), F.array_join(F.concat(documents, rules), "\n\n")).otherwise(F.lit("(no context)"))


#: A prompt that holds its answer to the context.
PROMPT = "Use nothing but the context. Say so if it does not hold the answer. Name sources by their number, like [1]. Answer in the question's language.\n\nQuestion: {question}\n\nContext:\n{context}\n\nAnswer:"


def grounded_prompt(question: Column, context: Column, template: str = PROMPT) -> Column:
    """``template`` with the question and the context in their places; null counts as empty."""
    head, rest = template.split("{question}")
    middle, end = rest.split("{context}")
    return F.concat(F.lit(head), F.coalesce(question, F.lit("")), F.lit(middle), F.coalesce(context, F.lit("")), F.lit(end))


def worker_delta(traces: DataFrame, abstaining: list[str]) -> DataFrame:
    """(kind, traces, confidence, latency_ms, abstain_rate, latency_delta): traces of one worker against those of several.

    ``abstain_rate`` is the share of answers with one of the phrases, ``latency_delta`` the difference to traces of one worker.
    """
    low = F.lower(F.coalesce("final_answer", F.lit("")))
    abstains = functools.reduce(lambda a, b: a | b, [low.contains(p) for p in abstaining])
    kind = F.when(F.size("workers_called") > 1, "multi").otherwise("single")
    by = traces.groupBy(kind.alias("kind")).agg(F.count("*").alias("traces"), F.avg("confidence").alias("c"), F.avg("latency_ms").alias("l"), F.avg(abstains.cast("double")).alias("a"))
    single = by.where("kind = 'single'").agg(F.max("l").alias("single"))
    out = by.crossJoin(F.broadcast(single))
    return out.select("kind", "traces", F.round("c", 6).alias("confidence"), F.round("l", 6).alias("latency_ms"), F.round("a", 6).alias("abstain_rate"), F.round(F.col("l") - F.col("single"), 6).alias("latency_delta"))


def routed(tasks: DataFrame, task: str, rules: list[tuple[str, list[str]]], default: str) -> DataFrame:
    """``tasks`` with ``route``: that of the first rule (route, words) of which the lower-case task holds a word, else the default."""
    from tidewell.functions.text import contains_any

    route = F.lit(default)
    for name, words in reversed(rules):
        route = F.when(contains_any(F.col(task), words), F.lit(name)).otherwise(route)
    return tasks.withColumn("route", route)
