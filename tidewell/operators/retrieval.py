"""Scan, score and rank: dense, sparse, fused and diversified."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import tokens
from tidewell.operators.joins import join_salted, small
from tidewell.session import stage

#: Constants of the sparse score, and of rank fusion.
K1, B, FUSION = 1.5, 0.75, 60
#: Query vectors that meet a batch of rows at once.
BLOCK_QUERIES = 512
#: Up to so many numbers (64 MB) in query vectors, and words in sparse queries, the queries go to every task.
QUERY_CELLS, SPARSE_WORDS = 8_000_000, 2_000_000
_BLANKS = re.compile("[ \t\n\x0b\f\r]+")


def ranked(scored: DataFrame, by: str, item: str, k: int, score: str = "score", rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each query by descending score, then by item, with their rank from 1."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.col(item))
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


class Best:
    """The best ``k`` rows of each query that a task has seen: by descending score, then by item."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        query, item, score = (np.concatenate([a, b]) for a, b in zip(self.rows, (query, item, score)))
        order = np.lexsort((item, -score, query))
        query, item, score = query[order], item[order], score[order]
        begins = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
        self.rows = tuple(x[rank < self.k] for x in (query, item, score))


def _unit_matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows of length 1; null ones, ones without length and ones of other than ``dims`` numbers are 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
    m = np.zeros((len(vectors), dims))
    m[fits.to_numpy(zero_copy_only=False)] = pc.fill_null(vectors.filter(fits).flatten(), 0).to_numpy(zero_copy_only=False).reshape(-1, dims)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _nearest(best: Best, first: int, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Add the nearest vectors of a batch to ``best``, for blocks of queries numbered from ``first``."""
    for at in range(0, len(queries), BLOCK_QUERIES):
        sims = np.round(queries[at : at + BLOCK_QUERIES] @ vectors.T, 9)
        least = np.partition(sims, -best.k, axis=1)[:, -best.k][:, None] if sims.shape[1] > best.k else -np.inf
        query, item = np.nonzero(sims >= least)  # more than k where the last one ties
        best.add(query + (first + at), ids[item], sims[query, item])


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, dims: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` nearest by cosine of (query_id, embedding) among (vec_id, embedding).

    Up to QUERY_CELLS numbers, all queries go to every task as one matrix and meet the vectors where they are read: nothing
    is shuffled but each task's best ``k`` of a query. More queries meet the vectors in blocks: packs of both are made where they
    are read, and those of queries are staged.
    Vectors without length or with null score 0.
    """
    if queries.count() * dims <= QUERY_CELLS:
        table = queries.select("query_id", "embedding").toArrow()
        names = table.column("query_id").combine_chunks()
        shared = queries.sparkSession.sparkContext.broadcast((names, _unit_matrix(table.column("embedding"), dims)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            best = Best(k)
            for batch in batches:
                if batch.num_rows:
                    _nearest(best, 0, matrix, batch.column("vec_id").to_numpy(), _unit_matrix(batch.column("embedding"), dims))
            query, item, score = best.rows
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(item), pa.array(score)], names=["query_id", "vec_id", "score"])

        found = vectors.select("vec_id", "embedding").mapInArrow(scan, f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id bigint, score double")
        return ranked(found, "query_id", "vec_id", k)

    def packs(rows: DataFrame, key: str, name: str, size: int) -> DataFrame:
        """Rows of a partition in lists of up to ``size``, made where they are read."""
        narrow = rows.select(key, "embedding")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = pa.StructArray.from_arrays(batch.columns, names=[key, "embedding"])
                cuts = pa.array([*range(0, batch.num_rows, size), batch.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, whole)], names=[name])

        return narrow.mapInArrow(pack, T.StructType([T.StructField(name, T.ArrayType(narrow.schema))]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = (batch.column(c)[i].values for c in ("queries", "vectors"))
                best = Best(k)
                _nearest(best, 0, _unit_matrix(q.field("embedding"), dims), v.field("vec_id").to_numpy(), _unit_matrix(v.field("embedding"), dims))
                query, item, score = best.rows
                yield pa.RecordBatch.from_arrays([q.field("query_id").take(pa.array(query)), pa.array(item), pa.array(score)], names=["query_id", "vec_id", "score"])

    both = packs(vectors, "vec_id", "vectors", 4096).crossJoin(stage(packs(queries, "query_id", "queries", BLOCK_QUERIES), "query-packs"))
    met = both.mapInArrow(meet, f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id bigint, score double")
    return ranked(met, "query_id", "vec_id", k)


def bm25_topk(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents (doc_id, text) for each (query_id, query) by BM25.

    Documents without any of a query's words are no candidates. Texts are split once, and of each document only its counts
    of the queries' words are written; what they are worth then meets the queries as a sparse product, in which each
    task keeps its best ``k``. With more than SPARSE_WORDS words in queries, words are joined instead, frequent ones split.
    The inverse frequency is ln(1 + (N - n + 0.5) / (n + 0.5)), which is never negative.
    """
    spark = queries.sparkSession
    wanted = stage(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")), "wanted")
    if wanted.limit(SPARSE_WORDS + 1).count() > SPARSE_WORDS:
        return ranked(_bm25_joined(wanted, documents), "query_id", "doc_id", k)
    table = wanted.toArrow()
    names, query_no = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
    terms, term_no = np.unique(table.column("term").to_numpy().astype(str), return_inverse=True)
    order = np.argsort(term_no, kind="stable")
    asked = query_no[order], np.append(0, np.cumsum(np.bincount(term_no, minlength=len(terms))))  # the queries of each term
    numbers = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms.tolist())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            size, held, times = [], [], []
            for text in batch.column("text").to_pylist():
                words = [w for w in _BLANKS.split(text) if w]
                found = Counter(known[w] for w in words if w in known)
                size.append(len(words))
                held.append(list(found))
                times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int32()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "size", "held", "times"])

    lower = documents.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    counts = stage(lower.mapInArrow(count, "doc_id bigint, size int, held array<int>, times array<int>"), "counts")
    docs, mean_size = counts.agg(F.count("*"), F.avg("size")).first()
    spread = np.zeros(len(terms))
    for term, n in counts.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*")).collect():  # a row a term at most
        spread[term] = n
    worth = np.log(1 + (docs - spread + 0.5) / (spread + 0.5)) * (K1 + 1)
    shared = spark.sparkContext.broadcast((pa.array(names.tolist(), pa.string()), worth, *asked))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, worth, query, begins = shared.value
        best = Best(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                held, times = (part.column(c).flatten().to_numpy() for c in ("held", "times"))
                doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("held")).to_numpy())
                size = part.column("size").to_numpy()[doc]
                gain = worth[held] * times / (times + K1 * (1 - B + B * size / mean_size))
                many = begins[held + 1] - begins[held]  # each word meets the queries that ask for it
                entry = np.arange(int(many.sum())) + np.repeat(begins[held] - np.cumsum(many) + many, many)
                cell, back = np.unique(query[entry] * part.num_rows + np.repeat(doc, many), return_inverse=True)
                total = np.round(np.bincount(back, np.repeat(gain, many), len(cell)), 6)
                best.add(cell // part.num_rows, part.column("doc_id").to_numpy()[cell % part.num_rows], total)
        query, item, total = best.rows
        yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(item), pa.array(total)], names=["query_id", "doc_id", "score"])

    return ranked(counts.mapInArrow(score, "query_id string, doc_id bigint, score double"), "query_id", "doc_id", k)


def _bm25_joined(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) by joins, for more words in queries than a task can hold."""
    words = documents.select("doc_id", tokens(F.col("text")).alias("words")).select("doc_id", F.size("words").alias("size"), F.explode_outer("words").alias("term"))
    # a row without a word for each document, that counts it
    words = words.unionAll(documents.select("doc_id", F.size(tokens(F.col("text"))).alias("size"), F.lit(None).cast("string").alias("term")))
    postings = stage(words.groupBy("doc_id", "size", "term").agg(F.count("*").alias("tf")), "postings")
    sizes = postings.where("term IS NULL").select("doc_id", "size").distinct().agg(F.count("*").alias("docs"), F.avg("size").alias("mean_size"))
    terms = wanted.select("term").distinct()
    spread = postings.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")).join(terms, "term", "left_semi").crossJoin(F.broadcast(sizes))
    met = join_salted(postings.where("term IS NOT NULL"), spread, ["term"], "doc_id")
    n, df, tf = F.col("docs").cast("double"), F.col("df").cast("double"), F.col("tf").cast("double")
    gain = F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    weighted = stage(met.select("term", "doc_id", gain.alias("gain")), "gains")
    return join_salted(weighted, wanted, ["term"], "doc_id").groupBy("query_id", "doc_id").agg(F.round(F.sum("gain"), 6).alias("score"))


def fused(first: DataFrame, second: DataFrame, k: int, first_weight: float = 0.6, second_weight: float = 0.4) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, doc_id, rank); a document that one lacks gets nothing from it."""
    a = first.select("query_id", "doc_id", F.col("rank").alias("a"))
    b = second.select("query_id", "doc_id", F.col("rank").alias("b"))
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (FUSION + F.col(rank)), F.lit(0.0))
    both = a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("score", F.round(part("a", first_weight) + part("b", second_weight), 9))
    return ranked(both.select("query_id", "doc_id", "score"), "query_id", "doc_id", k)


def reranked(candidates: DataFrame, queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, doc_id) in the order of word overlap (Jaccard) of query and text."""
    candidates = stage(candidates.select("query_id", "doc_id"), "candidates")
    # each document is split once, however many queries it is a candidate of
    wanted = documents.select("doc_id", "text").join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    words = stage(wanted.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("b")), "words")
    asked = small(queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("a")))
    both = candidates.join(words, "doc_id").join(asked, "query_id").withColumn("shared", F.size(F.array_intersect("a", "b")))
    overlap = F.coalesce(F.col("shared") / F.nullif(F.size("a") + F.size("b") - F.col("shared"), F.lit(0)), F.lit(0.0))
    return ranked(both.select("query_id", "doc_id", F.round(overlap, 9).alias("score")), "query_id", "doc_id", k)


def diversified(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over few candidates (query_id, vec_id, score, embedding): (query_id, vec_id, rank)."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "vec_id"], ascending=[False, True])
        m = np.stack(group["embedding"].to_numpy()).astype(float)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        score, taken, near = group["score"].to_numpy(), [], np.full(len(group), -np.inf)
        while len(taken) < min(k, len(group)):
            value = np.round(weight * score - (1 - weight) * np.where(np.isinf(near), 0, near), 9)
            value[taken] = -np.inf
            best = int(value.argmax())
            taken.append(best)
            near = np.maximum(near, m @ m[best])
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "vec_id": group["vec_id"].to_numpy()[taken], "rank": range(1, len(taken) + 1)})

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id bigint, vec_id bigint, rank int")


def expanded(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Queries (query_id, query) and for each alias (term, alias) whose term they hold one more with the alias in its place."""
    low = queries.select("query_id", F.lower("query").alias("query"))
    more = low.join(small(aliases), low["query"].contains(F.col("term"))).select("query_id", F.replace("query", F.col("term"), F.col("alias")).alias("query"))
    return low.unionAll(more).distinct()


def decomposed(queries: DataFrame, joint: str = r"(?i)\s+(?:và|and)\s+|[;?]\s*") -> DataFrame:
    """(query_id, part_no, query): each query cut at its joints into parts of two words or more; one that has none stays whole."""
    parts = F.filter(F.transform(F.split(F.coalesce("query", F.lit("")), joint), lambda p: F.trim(p)), lambda p: F.size(tokens(p)) >= 2)
    whole = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.coalesce("query", F.lit(""))))
    return queries.select("query_id", F.posexplode(whole).alias("part_no", "query"))


def united(results: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of several rankings of the variants of a query: each document by its best score."""
    return ranked(results.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), "query_id", "doc_id", k)


@functools.lru_cache(200_000)
def _bucket(word: str, dims: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dims


def term_vectors(rows: DataFrame, text: str, dims: int = 384) -> DataFrame:
    """``rows`` with ``embedding``: the counts of the words of ``text`` in ``dims`` hashed buckets, of length 1 unless empty.

    A bucket is the first eight hexadecimal digits of a word's MD5, modulo ``dims``: the same on every machine and in SQL.
    """

    @F.pandas_udf("array<double>")
    def vector(words: pd.Series) -> pd.Series:
        out = np.zeros((len(words), dims), np.float64)
        for i, row in enumerate(words):
            if row is not None and len(row):
                out[i] = np.bincount([_bucket(w, dims) for w in row], minlength=dims)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list(np.divide(out, norm, out=out, where=norm > 0)))

    return rows.withColumn("embedding", vector(tokens(F.col(text))))


def compared(strategies: dict[str, DataFrame]) -> DataFrame:
    """(strategy, query_id, doc_id, rank): rankings of the same queries by several strategies in one table."""
    parts = [df.select(F.lit(name).alias("strategy"), "query_id", "doc_id", "rank") for name, df in strategies.items()]
    return functools.reduce(DataFrame.unionAll, parts)
