"""From documents to a searchable index: parse, cut, vector, publish, read back and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import chunking, retrieval, snapshots


def chunks(documents: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, section, text, tokens, source, department, effective_date, access) of (doc_id, text), without a shuffle."""
    pieces = chunking.fixed_pieces(chunking.sections(chunking.parsed(documents.select("doc_id", "text"))), "section_text")
    chunk_id = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("section_no").cast("string"), F.col("piece_no").cast("string"))
    return pieces.select(chunk_id.alias("chunk_id"), "doc_id", "section", F.col("piece").alias("text"), chunking.token_estimate(F.col("piece")).alias("tokens"), *[F.col(f"h_{k}").alias(k) for k in chunking.HEADER])


def build(documents: DataFrame, folder: str, run_id: str, dims: int = 384) -> str:
    """Publish the chunks of all documents with their vectors as a new version of the index in ``folder``.

    A chunk also gets a number ``vec_id``, the hash of its id, under which searches find it.
    """
    rows = retrieval.term_vectors(chunks(documents), "text", dims).withColumn("vec_id", F.xxhash64("chunk_id"))
    return snapshots.publish(rows.withColumn("run_id", F.lit(run_id)), folder, run_id)


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, dims: int = 384) -> DataFrame:
    """(query_id, chunk_id, score, rank): the nearest chunks of the published index for (query_id, query)."""
    index = snapshots.current(spark, folder)
    found = retrieval.dense_topk(retrieval.term_vectors(queries, "query", dims), index.select("vec_id", "embedding"), k, dims)
    return found.join(index.select("vec_id", "chunk_id", "doc_id", "source"), "vec_id").drop("vec_id")


def listing(spark: SparkSession, folder: str, n: int = 5) -> DataFrame:
    """The first ``n`` chunks of the index (a report), with the first 120 characters of their texts."""
    rows = snapshots.current(spark, folder).orderBy("doc_id", "chunk_id").limit(n)
    return rows.select("chunk_id", "source", "section", "department", "effective_date", F.substring("text", 1, 120).alias("preview"))
