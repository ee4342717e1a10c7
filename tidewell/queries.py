"""Queries over the tables of a data folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import chunking, cleaning, evaluation, parsing, quality, retrieval, snapshots, timestamps
from tidewell.plans import index
from tidewell.session import stage
from tidewell.sources.tables import table
from tidewell.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query()
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that fail to parse, with the reason."""
    return parsing.failed_rows(*(table(spark, sf, t) for t in ("policy_export_lines", "policy_export_dirty", "quarantine_ci_smoke", "export_sources")))


@query()
def p5_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """The valid rows of all three tables, those of policy_export_lines parsed into columns."""
    return parsing.loaded_rows(*(table(spark, sf, t) for t in ("policy_export_lines", "policy_export_dirty", "quarantine_ci_smoke", "export_sources")))


@query()
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Dates and instants that were not in the wanted form, in that form."""
    return timestamps.normalised(*(table(spark, sf, t) for t in ("policy_export_dirty", "quarantine_ci_smoke", "export_sources")))


# --- cleaning -------------------------------------------------------------------------------------------------------

_SPACE = r"[\t\n\x0b\f\r \x{85}\p{Z}]"
_STRIP = lambda c: f"regexp_replace(coalesce({c}, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_CLEAN_SQL = f"""
WITH catalog AS (SELECT doc_id AS listed_id, max(effective_date) AS cutoff FROM doc_catalog GROUP BY 1),
fields AS (SELECT e.*, {_STRIP("doc_id")} AS document, {_STRIP("chunk_text")} AS text, {_STRIP("effective_date")} AS date_raw, {_STRIP("exported_at")} AS exported FROM policy_export_dirty e),
dated AS (SELECT f.*, cutoff, listed_id IS NOT NULL AS known,
  CASE WHEN regexp_full_match(date_raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN date_raw
       WHEN regexp_full_match(date_raw, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN date_raw[7:10] || '-' || date_raw[4:5] || '-' || date_raw[1:2] END AS date_iso
  FROM fields f LEFT JOIN catalog ON document = listed_id),
ruled AS (SELECT *, CASE WHEN NOT known THEN 'unknown_doc_id' WHEN date_raw = '' THEN 'missing_effective_date' WHEN date_iso IS NULL THEN 'invalid_effective_date_format'
  WHEN date_iso < cutoff THEN 'stale_effective_date' WHEN text = '' THEN 'missing_chunk_text' END AS first_reason,
  lower(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS k FROM dated),
cleaned AS (SELECT *, coalesce(first_reason, CASE WHEN row_id > min(CASE WHEN first_reason IS NULL THEN row_id END) OVER (PARTITION BY k) THEN 'duplicate_chunk_text' END) AS reason FROM ruled)
"""


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean(table(spark, sf, "policy_export_dirty"), table(spark, sf, "doc_catalog"))


@query(_CLEAN_SQL + "SELECT row_id, reason FROM cleaned")
def clean_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that each row of the export fails, null for clean rows."""
    return _clean(spark, sf).select("row_id", "reason")


@query(_CLEAN_SQL + "SELECT row_id, document, text, date_iso, exported, document || '_' || sha256(document || '|' || text)[1:16] AS chunk_key FROM cleaned WHERE reason IS NULL")
def clean_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Clean rows with normalised fields and an id from their content."""
    return cleaning.content_ids(_clean(spark, sf).where("reason IS NULL")).select("row_id", "document", "text", "date_iso", "exported", "chunk_key")


@query(_CLEAN_SQL + ", numbered AS (SELECT *, row_number() OVER (ORDER BY row_id) AS seq FROM cleaned WHERE reason IS NULL) SELECT row_id, seq, document || '_' || seq || '_' || sha256(document || '|' || text || '|' || seq)[1:16] AS chunk_key FROM numbered")
def clean_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Clean rows with a running number and an id from content and number."""
    return cleaning.positional_ids(_clean(spark, sf).where("reason IS NULL")).select("row_id", "seq", "chunk_key")


@query(_CLEAN_SQL + "SELECT run_id, count(*) AS raw_records, count(*) FILTER (WHERE reason IS NULL) AS cleaned_records, count(*) FILTER (WHERE reason IS NOT NULL) AS quarantine_records FROM cleaned GROUP BY run_id")
def clean_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each run: raw, clean and quarantined."""
    rows = _clean(spark, sf)
    return rows.groupBy("run_id").agg(F.count("*").alias("raw_records"), F.count_if(F.col("reason").isNull()).alias("cleaned_records"), F.count_if(F.col("reason").isNotNull()).alias("quarantine_records"))


_REWRITE = ("%_v3", "ngày làm việc", "ngày trực", " [cleaned: wording]")


@query(_CLEAN_SQL + "SELECT row_id, replace(text, 'ngày làm việc', 'ngày trực') || ' [cleaned: wording]' AS text FROM cleaned WHERE reason IS NULL AND document LIKE '%_v3' AND contains(text, 'ngày làm việc')")
def clean_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Clean rows of one version whose outdated wording was replaced."""
    rows = cleaning.rewritten(_clean(spark, sf).where("reason IS NULL"), *_REWRITE)
    return rows.where(F.endswith("text", F.lit(_REWRITE[3]))).select("row_id", "text")


# --- quality --------------------------------------------------------------------------------------------------------


def _expectations() -> list[quality.Expectation]:
    return [
        quality.Expectation("no_empty_document", F.col("document") == ""),
        quality.Expectation("known_document", ~F.col("known")),
        quality.Expectation("iso_date", F.col("date_iso").isNull()),
        quality.Expectation("text_of_eight_characters", F.length("text") < 8, "warn"),
        quality.Expectation("exported_at_given", F.col("exported") == "", "warn"),
    ]


@query(
    _CLEAN_SQL
    + """, c AS (SELECT * FROM cleaned WHERE reason IS NULL), v AS (
SELECT 'min_rows' AS expectation, 'halt' AS severity, greatest(1 - count(*), 0) AS violations FROM c
UNION ALL SELECT 'no_empty_document', 'halt', count(*) FILTER (WHERE document = '') FROM c
UNION ALL SELECT 'known_document', 'halt', count(*) FILTER (WHERE NOT known) FROM c
UNION ALL SELECT 'iso_date', 'halt', count(*) FILTER (WHERE date_iso IS NULL) FROM c
UNION ALL SELECT 'text_of_eight_characters', 'warn', count(*) FILTER (WHERE length(text) < 8) FROM c
UNION ALL SELECT 'exported_at_given', 'warn', count(*) FILTER (WHERE exported = '') FROM c)
SELECT expectation, severity, CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM v"""
)
def expectation_suite(spark: SparkSession, sf: str) -> DataFrame:
    """Expectations on the clean rows, counted in one pass."""
    return quality.suite(_clean(spark, sf).where("reason IS NULL"), _expectations())


_NOW = "2026-10-26 00:00:00"


@query(
    f"""WITH t AS (SELECT run_id, round((epoch_us(TIMESTAMPTZ '{_NOW}+00') - epoch_us(coalesce(try_cast(nullif(latest_exported_at, '') AS TIMESTAMPTZ), try_cast(nullif(run_timestamp, '') AS TIMESTAMPTZ)))) / 3.6e9, 3) AS age_hours FROM manifests)
SELECT run_id, age_hours, CASE WHEN age_hours IS NULL THEN 'WARN' WHEN age_hours <= 24 THEN 'PASS' ELSE 'FAIL' END AS status FROM t"""
)
def freshness_status(spark: SparkSession, sf: str) -> DataFrame:
    """Age of each run's data against an SLA of 24 hours at a given time."""
    return quality.freshness(table(spark, sf, "manifests"), _NOW)


_EXPORT_COLUMNS = ["chunk_id", "doc_id", "chunk_text", "effective_date", "exported_at"]


@query(
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {_STRIP(c)} = '') AS blank, count(*) AS n FROM policy_export_dirty" for c in _EXPORT_COLUMNS)
    + ") SELECT \"column\", blank, round(blank / greatest(n, 1), 6) AS rate, CASE WHEN blank / greatest(n, 1) > 0.4 THEN 'halt' WHEN blank / greatest(n, 1) > 0.02 THEN 'warn' ELSE 'ok' END AS level FROM v"
)
def null_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Blank values of the export's columns against two thresholds."""
    return quality.null_rates(table(spark, sf, "policy_export_dirty", *_EXPORT_COLUMNS), _EXPORT_COLUMNS)


@query("SELECT doc_id, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM policy_export_dirty GROUP BY doc_id")
def document_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How the export's rows spread over document ids as written."""
    return quality.shares(table(spark, sf, "policy_export_dirty", "doc_id"), "doc_id")


@query(
    """SELECT count(*) AS traces, count(*) FILTER (WHERE question_id IS NULL) AS no_question, count(*) FILTER (WHERE final_answer IS NULL) AS no_answer, count(*) FILTER (WHERE latency_ms IS NULL) AS no_latency,
count(*) FILTER (WHERE len(retrieved_chunks) = 0) AS no_chunks, count(*) FILTER (WHERE coalesce(route_reason, '') = '') AS no_reason FROM agent_state"""
)
def required_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Traces that lack a field, by field, in one pass."""
    t = table(spark, sf, "agent_state")
    null = lambda c: F.count_if(F.col(c).isNull())
    return t.agg(F.count("*").alias("traces"), null("question_id").alias("no_question"), null("final_answer").alias("no_answer"), null("latency_ms").alias("no_latency"), F.count_if(F.size("retrieved_chunks") == 0).alias("no_chunks"), F.count_if(F.coalesce("route_reason", F.lit("")) == "").alias("no_reason"))


@query(
    f"""WITH t AS (SELECT lower(trim(regexp_replace({_STRIP("chunk_text")}, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS t FROM policy_export_dirty), n AS (SELECT t, count(*) AS n FROM t GROUP BY t)
SELECT 'no_duplicate_chunk_text' AS expectation, 'warn' AS severity, CAST(sum(n - 1) AS BIGINT) AS violations, sum(n - 1) = 0 AS passed FROM n"""
)
def duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the export beyond the first of each text."""
    return quality.repeats(table(spark, sf, "policy_export_dirty", "chunk_text"), "chunk_text")


_REQUIRED = ["run_id", "raw_records", "cleaned_records", "quarantine_records", "latest_exported_at", "chroma_path"]


@query("WITH m AS (SELECT run_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_STRIP(f'CAST({c} AS VARCHAR)')} = '' THEN '{c}' END" for c in _REQUIRED) + "], lambda x: x IS NOT NULL), ',') AS missing FROM manifests) SELECT run_id, missing, missing = '' AS ok FROM m")
def manifest_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Required fields that the manifests lack."""
    return quality.missing_fields(table(spark, sf, "manifests"), "run_id", _REQUIRED)


# --- documents and chunks -------------------------------------------------------------------------------------------

_HEAD = lambda label, default: f"coalesce(nullif(trim(regexp_extract(head, '(?s)^(?:.*\\n)?{label}:([^\\n]*)', 1)), ''), '{default}')".replace("\\\\", "\\")
_PARSE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, text, CASE WHEN starts_with(text, '===') THEN 1 WHEN contains(text, chr(10) || '===') THEN strpos(text, chr(10) || '===') + 1 ELSE 0 END AS cut_at FROM d),
headed AS (SELECT doc_id, CASE WHEN cut_at > 0 THEN text[1:cut_at - 1] ELSE '' END AS head, regexp_replace(CASE WHEN cut_at > 0 THEN text[cut_at:] ELSE text END, '\n{{3,}}', chr(10) || chr(10), 'g') AS body FROM cut),
parsed AS (SELECT doc_id, body, {_HEAD("Source", "")} AS h_source, {_HEAD("Department", "unknown")} AS h_department, {_HEAD("Effective Date", "unknown")} AS h_effective_date, {_HEAD("Access", "internal")} AS h_access FROM headed)
"""
_SECTION_SQL = (
    _PARSE_SQL
    + """, titled AS (SELECT doc_id, body, list_concat(['General'], list_transform(regexp_extract_all(body, '===[^\n]*?==='), lambda x: trim(replace(x, '=', ' ')))) AS t, regexp_split_to_array(body, '===[^\n]*?===') AS x FROM parsed),
each AS (SELECT doc_id, unnest(range(len(x))) AS section_no, t, x FROM titled),
cut_sections AS (SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, t[section_no + 1] AS section, regexp_replace(x[section_no + 1], '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS section_text FROM each),
sections AS (SELECT * FROM cut_sections WHERE section_text <> '')"""
)


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.parsed(table(spark, sf, "documents", "doc_id", "text"))


@query(_PARSE_SQL + "SELECT doc_id, h_source, h_department, h_effective_date, h_access, CAST(length(body) AS INTEGER) AS body_chars FROM parsed")
def header_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Header fields of the documents and the length of their bodies."""
    return _parsed(spark, sf).select("doc_id", *[f"h_{k}" for k in chunking.HEADER], F.length("body").alias("body_chars"))


@query(_SECTION_SQL + " SELECT doc_id, section_no, section, section_text FROM sections")
def section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut at their headings."""
    return chunking.sections(_parsed(spark, sf)).select("doc_id", "section_no", "section", "section_text")


@query(
    _SECTION_SQL
    + """, pieces AS (SELECT doc_id, section_no, unnest(range(0, 1 + CAST(ceil(greatest(length(section_text) - 1600, 0) / 1280.0) AS BIGINT))) AS i, section_text FROM sections)
SELECT doc_id, section_no, CAST(i AS INTEGER) AS piece_no, substring(section_text, CAST(i * 1280 + 1 AS BIGINT), 1600) AS piece FROM pieces"""
)
def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sections cut to 1600 characters that overlap by 320."""
    return chunking.fixed_pieces(chunking.sections(_parsed(spark, sf)), "section_text").select("doc_id", "section_no", "piece_no", "piece")


_ROOM = 1280  # characters of a piece that are new


@query(
    _SECTION_SQL.replace("WITH d AS", "WITH RECURSIVE d AS")
    + f""", paragraphs AS (SELECT doc_id, section_no, unnest(p) AS p, unnest(range(len(p))) AS n FROM (SELECT doc_id, section_no, list_filter(string_split_regex(section_text, '\n[ \t\n\x0b\f\r]*\n'), lambda x: regexp_replace(x, '[ \t\n\x0b\f\r]+', '', 'g') <> '') AS p FROM sections)),
parts AS (SELECT doc_id, section_no, n, p, unnest(range(0, CAST(length(p) AS BIGINT), {_ROOM})) AS i FROM paragraphs),
units AS (SELECT doc_id, section_no, substring(p, i + 1, {_ROOM}) AS unit, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY n, i) AS u FROM parts),
fold AS (SELECT doc_id, section_no, u, unit, 0 AS piece_no, CAST(length(unit) AS BIGINT) AS used FROM units WHERE u = 1
  UNION ALL SELECT x.doc_id, x.section_no, x.u, x.unit, f.piece_no + CASE WHEN f.used + 2 + length(x.unit) <= {_ROOM} THEN 0 ELSE 1 END, CASE WHEN f.used + 2 + length(x.unit) <= {_ROOM} THEN f.used + 2 + length(x.unit) ELSE length(x.unit) END
  FROM fold f JOIN units x ON x.doc_id = f.doc_id AND x.section_no = f.section_no AND x.u = f.u + 1),
own AS (SELECT doc_id, section_no, piece_no, string_agg(unit, chr(10) || chr(10) ORDER BY u) AS body FROM fold GROUP BY ALL)
SELECT doc_id, section_no, piece_no, coalesce(right(lag(body) OVER (PARTITION BY doc_id, section_no ORDER BY piece_no), 320), '') || body AS piece FROM own"""
)
def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sections cut at paragraphs, which are put together up to 1600 characters of which 320 overlap."""
    return chunking.packed_paragraphs(chunking.sections(_parsed(spark, sf)), "section_text").select("doc_id", "section_no", "piece_no", "piece")


@query(
    _SECTION_SQL
    + """, pieces AS (SELECT doc_id, section_no, section, unnest(range(0, 1 + CAST(ceil(greatest(length(section_text) - 1600, 0) / 1280.0) AS BIGINT))) AS i, section_text FROM sections),
c AS (SELECT doc_id || '-' || section_no || '-' || i AS chunk_id, doc_id, section, substring(section_text, CAST(i * 1280 + 1 AS BIGINT), 1600) AS text FROM pieces)
SELECT chunk_id, doc_id, section, text, CAST(length(text) // 4 AS INTEGER) AS tokens, h_source AS source, h_department AS department, h_effective_date AS effective_date, h_access AS access FROM c JOIN parsed USING (doc_id)"""
)
def index_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the index before they get their vectors."""
    return index.chunks(table(spark, sf, "documents", "doc_id", "text"))


@query("SELECT department, count(*) AS documents, count(*) FILTER (WHERE trim(coalesce(effective_date, '')) IN ('', 'unknown')) AS undated, count(*) FILTER (WHERE lang IS NULL) AS no_language FROM documents GROUP BY department")
def metadata_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and missing metadata by department."""
    d = table(spark, sf, "documents", "department", "effective_date", "lang")
    undated = F.trim(F.coalesce("effective_date", F.lit(""))).isin("", "unknown")
    return d.groupBy("department").agg(F.count("*").alias("documents"), F.count_if(undated).alias("undated"), F.count_if(F.col("lang").isNull()).alias("no_language"))


# --- retrieval ------------------------------------------------------------------------------------------------------


def _dense(spark: SparkSession, sf: str, k: int) -> DataFrame:
    vectors = table(spark, sf, "embeddings", "vec_id", "embedding")
    return retrieval.dense_topk(vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), vectors, k, 64)


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v q, v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 20, among all."""
    return _dense(spark, sf, 10).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@query(
    """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v q, v WHERE q.vec_id % 20 = 0),
c AS (SELECT query_id, vec_id, score, e FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) JOIN v USING (vec_id) WHERE rank <= 20),
near AS (SELECT a.query_id, a.vec_id, b.vec_id AS other, list_cosine_similarity(a.e, b.e) AS sim FROM c a JOIN c b USING (query_id)),
pick AS (SELECT query_id, 1 AS rank, [list(vec_id ORDER BY round(0.7 * score, 9) DESC, score DESC, vec_id)[1]] AS taken FROM c GROUP BY query_id
  UNION ALL SELECT query_id, rank + 1, list_append(any_value(taken), list(vec_id ORDER BY round(0.7 * score - 0.3 * m, 9) DESC, score DESC, vec_id)[1])
  FROM (SELECT p.query_id, p.rank, p.taken, c.vec_id, c.score, max(n.sim) AS m FROM pick p JOIN c ON c.query_id = p.query_id AND NOT list_contains(p.taken, c.vec_id) JOIN near n ON n.query_id = c.query_id AND n.vec_id = c.vec_id AND list_contains(p.taken, n.other) WHERE p.rank < 5 GROUP BY ALL) GROUP BY query_id, rank)
SELECT query_id, taken[rank] AS vec_id, CAST(rank AS INTEGER) AS rank FROM pick"""
)
def mmr_select(spark: SparkSession, sf: str) -> DataFrame:
    """Five diverse ones of the twenty nearest vectors."""
    near = _dense(spark, sf, 20).select("query_id", "vec_id", "score")
    return retrieval.diversified(near.join(table(spark, sf, "embeddings", "vec_id", "embedding"), "vec_id"), 5)


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "test_questions").select(F.col("id").alias("query_id"), F.col("question").alias("query"))


_BM25_SQL = """
WITH q AS (SELECT id AS query_id, list_filter(string_split_regex(lower(coalesce(question, '')), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM test_questions),
wanted AS (SELECT DISTINCT query_id, unnest(w) AS term FROM q),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
sizes AS (SELECT count(*) AS docs, avg(len(w)) AS mean_size FROM d),
hits AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d),
postings AS (SELECT doc_id, size, term, count(*) AS tf FROM hits WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
spread AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
gains AS (SELECT p.term, doc_id, ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean_size)) AS gain FROM postings p JOIN spread USING (term), sizes),
scored AS (SELECT query_id, doc_id, round(sum(gain), 6) AS score FROM gains JOIN wanted USING (term) GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
"""


def _bm25(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return retrieval.bm25_topk(_questions(spark, sf), table(spark, sf, "documents", "doc_id", "text"), k)


@query(_BM25_SQL + "SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm25 WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for every question by BM25."""
    return _bm25(spark, sf, 10)


_OVERLAP_SQL = (
    _BM25_SQL
    + """, candidates AS (SELECT query_id, doc_id, rank FROM bm25 WHERE rank <= 20),
words AS (SELECT c.query_id, c.doc_id, list_distinct(q.w) AS a, list_distinct(d.w) AS b FROM candidates c JOIN q USING (query_id) JOIN d USING (doc_id)),
overlap AS (SELECT query_id, doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS score FROM words),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM overlap)"""
)


@query(_OVERLAP_SQL + " SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM reranked WHERE rank <= 3")
def rerank_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The funnel: twenty candidates by BM25, of which three by word overlap."""
    return retrieval.reranked(_bm25(spark, sf, 20), _questions(spark, sf), table(spark, sf, "documents", "doc_id", "text"), 3).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    _OVERLAP_SQL
    + """, fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(0.6::DOUBLE / (60 + a.rank), 0) + coalesce(0.4::DOUBLE / (60 + b.rank), 0), 9) AS score
FROM (SELECT * FROM candidates WHERE rank <= 20) a FULL JOIN (SELECT * FROM reranked WHERE rank <= 10) b USING (query_id, doc_id)),
last AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM last WHERE rank <= 10"""
)
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal rank fusion of BM25 and word overlap."""
    first = stage(_bm25(spark, sf, 20), "bm25")
    second = retrieval.reranked(first, _questions(spark, sf), table(spark, sf, "documents", "doc_id", "text"), 10)
    return retrieval.fused(first, second, 10)


_DENSE_SQL = """, bucket AS (SELECT word, ('0x' || md5(word)[1:8])::BIGINT % 384 AS bucket FROM (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM q UNION ALL SELECT w FROM d))),
qv AS (SELECT query_id, bucket, count(*)::DOUBLE AS n FROM (SELECT query_id, unnest(w) AS word FROM q) JOIN bucket USING (word) GROUP BY ALL),
dv AS (SELECT doc_id, bucket, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN bucket USING (word) GROUP BY ALL),
near AS (SELECT query_id, doc_id, round(any_value(dot) / sqrt(any_value(qn) * any_value(dn)), 9) AS score FROM (SELECT query_id, doc_id, sum(qv.n * dv.n) AS dot FROM qv JOIN dv USING (bucket) GROUP BY ALL)
  JOIN (SELECT query_id, sum(n * n) AS qn FROM qv GROUP BY 1) USING (query_id) JOIN (SELECT doc_id, sum(n * n) AS dn FROM dv GROUP BY 1) USING (doc_id) GROUP BY ALL),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near),
fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(0.6::DOUBLE / (60 + a.rank), 0) + coalesce(0.4::DOUBLE / (60 + b.rank), 0), 9) AS score
  FROM (SELECT * FROM dense WHERE rank <= 20) a FULL JOIN (SELECT * FROM bm25 WHERE rank <= 20) b USING (query_id, doc_id)),
both_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused)"""


def _by_terms(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The nearest documents of every question by the cosine of their hashed words."""
    vectors = retrieval.term_vectors(table(spark, sf, "documents", "doc_id", "text"), "text").select(F.col("doc_id").alias("vec_id"), "embedding")
    return retrieval.dense_topk(retrieval.term_vectors(_questions(spark, sf), "query"), vectors, k, 384).withColumnRenamed("vec_id", "doc_id")


@query(_BM25_SQL + _DENSE_SQL + " SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM both_ranked WHERE rank <= 10")
def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal rank fusion of the dense and the sparse ranking."""
    return retrieval.fused(_by_terms(spark, sf, 20), _bm25(spark, sf, 20), 10)


@query(_BM25_SQL + _DENSE_SQL + " SELECT strategy, query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT 'dense' AS strategy, query_id, doc_id, rank FROM dense UNION ALL SELECT 'sparse', query_id, doc_id, rank FROM bm25 UNION ALL SELECT 'fused', query_id, doc_id, rank FROM both_ranked) WHERE rank <= 10")
def strategy_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every question by each strategy, side by side."""
    dense, sparse = stage(_by_terms(spark, sf, 20), "dense"), stage(_bm25(spark, sf, 20), "sparse")
    return retrieval.compared({"dense": dense.where("rank <= 10"), "sparse": sparse.where("rank <= 10"), "fused": retrieval.fused(dense, sparse, 10)})


@query(
    """WITH p AS (SELECT id AS query_id, coalesce(question, '') AS query, list_filter(list_transform(string_split_regex(coalesce(question, ''), '(?i)[ \t\n\x0b\f\r]+(?:và|and)[ \t\n\x0b\f\r]+|[;?][ \t\n\x0b\f\r]*'), lambda x: trim(x)), lambda x: len(list_filter(string_split_regex(x, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) >= 2) AS parts FROM test_questions),
e AS (SELECT query_id, CASE WHEN len(parts) > 0 THEN parts ELSE [query] END AS parts FROM p) SELECT query_id, CAST(unnest(range(len(parts))) AS INTEGER) AS part_no, unnest(parts) AS query FROM e"""
)
def query_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    """Questions cut into parts that can be asked alone."""
    return retrieval.decomposed(_questions(spark, sf))


_ALIASES = [("thiết bị", "máy"), ("yêu cầu", "phiếu"), ("khách hàng", "khách"), ("request", "ticket"), ("staff", "employees")]


@query(
    "WITH l AS (SELECT id AS query_id, lower(question) AS query FROM test_questions), a(term, alias) AS (VALUES "
    + ", ".join(f"('{t}', '{a}')" for t, a in _ALIASES)
    + ") SELECT DISTINCT * FROM (SELECT query_id, query FROM l UNION ALL SELECT query_id, replace(query, term, alias) FROM l JOIN a ON contains(query, term))"
)
def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and their variants with other words for the same things."""
    return retrieval.expanded(_questions(spark, sf), spark.createDataFrame(_ALIASES, "term string, alias string"))


# --- context, confidence, evaluation, traces ------------------------------------------------------------------------


@query(
    """SELECT run_id, CASE WHEN coalesce(len(retrieved_chunks), 0) = 0 THEN '(no context)' ELSE array_to_string(list_transform(retrieved_chunks, lambda c, i: '[' || i || '] ' || coalesce(c.source, 'unknown')
|| CASE WHEN coalesce(c.metadata.section, '') <> '' THEN ' | ' || c.metadata.section ELSE '' END || CASE WHEN coalesce(c.score, 0) > 0 THEN ' | score=' || printf('%.2f', c.score) ELSE '' END || chr(10) || coalesce(c.text, '')), chr(10) || chr(10)) END AS context FROM agent_state"""
)
def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The context of every trace, as a prompt would hold it."""
    return table(spark, sf, "agent_state").select("run_id", evaluation.context_block(F.col("retrieved_chunks")).alias("context"))


@query(
    """WITH t AS (SELECT run_id, coalesce(len(retrieved_chunks), 0) AS n, coalesce(list_sum(list_transform(retrieved_chunks, lambda c: coalesce(c.score, 0))), 0) AS total, coalesce(len(policy_result.exceptions_found), 0) AS x, lower(coalesce(final_answer, '')) AS a FROM agent_state)
SELECT run_id, CASE WHEN n = 0 THEN 0.1::DOUBLE WHEN contains(a, 'không thể trả lời') OR contains(a, 'không có đủ căn cứ') THEN 0.3::DOUBLE ELSE round_even(greatest(0.1::DOUBLE, least(0.95::DOUBLE, total / n - 0.05::DOUBLE * x)), 2) END AS estimate FROM t"""
)
def confidence_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of every trace from its chunks, answer and exceptions."""
    t = table(spark, sf, "agent_state")
    return t.select("run_id", evaluation.confidence(F.col("retrieved_chunks"), F.col("final_answer"), F.col("policy_result.exceptions_found"), ["không thể trả lời", "không có đủ căn cứ"]).alias("estimate"))


_BASE = lambda x: f"regexp_replace(lower(list_last(string_split({x}, '/'))), '\\.(pdf|md|txt)$', '')"


@query(
    f"""WITH j AS (SELECT run_id, expected_sources AS e, list_transform(coalesce(retrieved_sources, []), lambda s: lower(s)) AS r FROM agent_state JOIN test_questions ON question_id = id),
h AS (SELECT run_id, len(e) AS n, len(list_filter(e, lambda x: len(list_filter(r, lambda s: contains(s, {_BASE("x")}))) > 0)) AS hits FROM j)
SELECT run_id, CASE WHEN n > 0 THEN round(hits / n, 6) END AS recall, CASE WHEN n > 0 THEN CAST(round_even(hits / n * 5, 0) AS INTEGER) END AS score FROM h"""
)
def context_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the expected sources in the retrieved ones of each trace with a known question."""
    questions = table(spark, sf, "test_questions", "id", "expected_sources")
    rows = table(spark, sf, "agent_state", "run_id", "question_id", "retrieved_sources").join(questions, F.col("question_id") == F.col("id"))
    recall, score = evaluation.context_recall(F.col("expected_sources"), F.col("retrieved_sources"))
    return rows.select("run_id", F.round(recall, 6).alias("recall"), score.alias("score"))


@query(
    r"""WITH j AS (SELECT question_id, question, coalesce(retrieved_chunks, [])[1:3] AS u, regexp_extract_all(coalesce(expected_answer, ''), '[0-9]+ \p{L}+') AS wanted, regexp_extract_all(coalesce(question, ''), '[0-9]+ \p{L}+') AS banned, trim(coalesce(expected_sources[1], '')) AS want FROM agent_state JOIN test_questions ON question_id = id),
b AS (SELECT *, lower(array_to_string(list_transform(u, lambda c: coalesce(c.text, '')), ' ')) AS blob, coalesce(u[1].source, '') AS top1 FROM j)
SELECT question_id, question, top1 AS top1_doc_id, replace(coalesce(u[1].text, '')[1:180], chr(10), ' ') AS top1_preview, CASE WHEN len(wanted) = 0 OR len(list_filter(wanted, lambda x: contains(blob, lower(x)))) > 0 THEN 'yes' ELSE 'no' END AS contains_expected,
CASE WHEN len(list_filter(banned, lambda x: contains(blob, lower(x)))) > 0 THEN 'yes' ELSE 'no' END AS hits_forbidden, CASE WHEN want = '' THEN '' WHEN top1 = want THEN 'yes' ELSE 'no' END AS top1_doc_expected, 3 AS top_k_used FROM b"""
)
def retrieval_eval(spark: SparkSession, sf: str) -> DataFrame:
    """What the first three chunks of each trace show of its question: quantities of the expected answer are wanted, those of the question not."""
    quantities = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[0-9]+ \p{L}+"), F.lit(0))
    q = table(spark, sf, "test_questions").select("id", "question", quantities("expected_answer").alias("wanted"), quantities("question").alias("banned"), F.get("expected_sources", F.lit(0)).alias("want_top1"))
    rows = table(spark, sf, "agent_state", "question_id", F.col("retrieved_chunks").alias("chunks")).join(q, F.col("question_id") == F.col("id"))
    return evaluation.retrieval_report(rows, 3)


@query(
    """WITH t AS (SELECT supervisor_route, count(*) AS traces, round(avg(CASE WHEN confidence <> 0 THEN confidence END), 6) AS avg_confidence, round(avg(CASE WHEN latency_ms <> 0 THEN latency_ms END), 6) AS avg_latency_ms,
count(*) FILTER (WHERE hitl_triggered) AS hitl, count(*) FILTER (WHERE len(mcp_tools_used) > 0) AS with_tools FROM agent_state GROUP BY supervisor_route)
SELECT supervisor_route, traces, CAST(floor(100 * traces / sum(traces) OVER ()) AS BIGINT) AS percent, avg_confidence, avg_latency_ms, hitl, with_tools FROM t"""
)
def trace_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Routes of the traces: shares, confidence, latency, reviews and tools."""
    return evaluation.trace_metrics(table(spark, sf, "agent_state"))


@query("SELECT source, count(*) AS traces FROM (SELECT unnest(sources) AS source FROM agent_state) GROUP BY source ORDER BY traces DESC, source LIMIT 5")
def top_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The five sources that most traces name."""
    return evaluation.top_sources(table(spark, sf, "agent_state"))


_AB = """
WITH m AS (SELECT question_id AS id, hitl_triggered OR needs_tool AS tooled, round(avg(confidence), 9) AS confidence, round(avg(latency_ms), 9) AS latency_ms FROM agent_state WHERE question_id IS NOT NULL GROUP BY 1, 2),
variant AS (SELECT * FROM m WHERE tooled), baseline AS (SELECT * FROM m WHERE NOT tooled)
"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf, "agent_state", "question_id", "hitl_triggered", "needs_tool", "confidence", "latency_ms").where("question_id IS NOT NULL")
    means = t.groupBy(F.col("question_id").alias("id"), (F.col("hitl_triggered") | F.col("needs_tool")).alias("tooled")).agg(F.round(F.avg("confidence"), 9).alias("confidence"), F.round(F.avg("latency_ms"), 9).alias("latency_ms"))
    return means.where("tooled").drop("tooled"), means.where("NOT tooled").drop("tooled")


@query(
    _AB
    + """, t AS (SELECT v.id, v.confidence AS variant_confidence, b.confidence AS baseline_confidence, v.latency_ms AS variant_latency_ms, b.latency_ms AS baseline_latency_ms, round(coalesce(v.confidence, 0) + coalesce(v.latency_ms, 0), 6) AS variant_total, round(coalesce(b.confidence, 0) + coalesce(b.latency_ms, 0), 6) AS baseline_total FROM variant v LEFT JOIN baseline b USING (id))
SELECT *, CASE WHEN variant_total > baseline_total THEN 'Variant' WHEN variant_total < baseline_total THEN 'Baseline' ELSE 'Tie' END AS winner FROM t"""
)
def ab_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Traces with tools or review against those without, by the totals of each question."""
    return evaluation.compared(*_sides(spark, sf), ["confidence", "latency_ms"])


@query(
    _AB
    + ", ".join(["", *[f"{m}_means AS (SELECT '{m}' AS metric, (SELECT avg({m}) FROM baseline) AS b, (SELECT avg({m}) FROM variant) AS v)" for m in ("confidence", "latency_ms")]])
    + " SELECT metric, round(b, 6) AS baseline, round(v, 6) AS variant, CASE WHEN b <> 0 AND v <> 0 THEN round(v - b, 6) END AS delta FROM (SELECT * FROM confidence_means UNION ALL SELECT * FROM latency_ms_means)"
)
def ab_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Averages of both sides by metric."""
    return evaluation.averages(*_sides(spark, sf), ["confidence", "latency_ms"])


@query(
    f"""WITH t AS (SELECT id, category, confidence, latency_ms, supervisor_route = expected_route AS hit, CASE WHEN len(expected_sources) > 0 THEN len(list_filter(expected_sources, lambda x: len(list_filter(list_transform(coalesce(retrieved_sources, []), lambda s: lower(s)), lambda s: contains(s, {_BASE("x")}))) > 0)) / len(expected_sources) END AS recall FROM agent_state JOIN test_questions ON question_id = id)
SELECT id, category, count(*) AS traces, round(avg(confidence), 6) AS confidence, round(avg(latency_ms), 6) AS latency_ms, round(avg(recall), 6) AS recall, round(avg(CAST(hit AS DOUBLE)), 6) AS routed_as_expected FROM t GROUP BY id, category"""
)
def scorecard_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The scorecard question by question."""
    q = table(spark, sf, "test_questions", "id", "category", "expected_route", "expected_sources")
    rows = table(spark, sf, "agent_state", "question_id", "confidence", "latency_ms", "supervisor_route", "retrieved_sources").join(q, F.col("question_id") == F.col("id"))
    recall, _ = evaluation.context_recall(F.col("expected_sources"), F.col("retrieved_sources"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return rows.groupBy("id", "category").agg(F.count("*").alias("traces"), mean("confidence", "confidence"), mean("latency_ms", "latency_ms"), mean(recall, "recall"), mean((F.col("supervisor_route") == F.col("expected_route")).cast("double"), "routed_as_expected"))


_ABSTAINING = ["không thể trả lời", "không có đủ căn cứ"]


@query(
    """WITH k AS (SELECT CASE WHEN len(workers_called) > 1 THEN 'multi' ELSE 'single' END AS kind, count(*) AS traces, avg(confidence) AS c, avg(latency_ms) AS l, avg(CAST(contains(lower(coalesce(final_answer, '')), 'không thể trả lời') OR contains(lower(coalesce(final_answer, '')), 'không có đủ căn cứ') AS DOUBLE)) AS a FROM agent_state GROUP BY 1)
SELECT kind, traces, round(c, 6) AS confidence, round(l, 6) AS latency_ms, round(a, 6) AS abstain_rate, round(l - (SELECT max(l) FROM k WHERE kind = 'single'), 6) AS latency_delta FROM k"""
)
def worker_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Traces of one worker against those of several: abstaining answers and the difference in latency."""
    return evaluation.worker_delta(table(spark, sf, "agent_state", "workers_called", "confidence", "latency_ms", "final_answer"), _ABSTAINING)


_CHUNK_LINE = "'[' || i || '] ' || coalesce(c.source, 'unknown') || ' (relevance: ' || printf('%.2f', coalesce(c.score, 0)) || ')' || chr(10) || coalesce(c.text, '')"


@query(
    f"""SELECT run_id, CASE WHEN coalesce(len(retrieved_chunks), 0) = 0 AND coalesce(len(policy_result.exceptions_found), 0) = 0 THEN '(no context)' ELSE array_to_string(list_concat(CASE WHEN len(retrieved_chunks) > 0 THEN list_concat(['=== DOCUMENTS ==='], list_transform(retrieved_chunks, lambda c, i: {_CHUNK_LINE})) ELSE [] END,
CASE WHEN len(policy_result.exceptions_found) > 0 THEN list_concat(['=== POLICY EXCEPTIONS ==='], list_transform(policy_result.exceptions_found, lambda e: '- ' || coalesce(e.rule, ''))) ELSE [] END), chr(10) || chr(10)) END AS context FROM agent_state"""
)
def context_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    """The context of every trace with the rules of its exceptions."""
    return table(spark, sf, "agent_state").select("run_id", evaluation.context_with_exceptions(F.col("retrieved_chunks"), F.col("policy_result.exceptions_found")).alias("context"))


_PROMPT_PARTS = ["'" + p.replace("'", "''") + "'" for p in evaluation.PROMPT.replace("{context}", "{question}").split("{question}")]


@query(
    f"""WITH x AS (SELECT run_id, coalesce(task, '') AS task, CASE WHEN coalesce(len(retrieved_chunks), 0) = 0 THEN '(no context)' ELSE array_to_string(list_transform(retrieved_chunks, lambda c, i: '[' || i || '] ' || coalesce(c.source, 'unknown')
|| CASE WHEN coalesce(c.metadata.section, '') <> '' THEN ' | ' || c.metadata.section ELSE '' END || CASE WHEN coalesce(c.score, 0) > 0 THEN ' | score=' || printf('%.2f', c.score) ELSE '' END || chr(10) || coalesce(c.text, '')), chr(10) || chr(10)) END AS context FROM agent_state)
SELECT run_id, {_PROMPT_PARTS[0]} || task || {_PROMPT_PARTS[1]} || context || {_PROMPT_PARTS[2]} AS prompt FROM x"""
)
def grounded_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of every trace that holds its answer to the context."""
    t = table(spark, sf, "agent_state", "run_id", "task", "retrieved_chunks")
    return t.select("run_id", evaluation.grounded_prompt(F.col("task"), evaluation.context_block(F.col("retrieved_chunks"))).alias("prompt"))


@query(
    """SELECT category, count(*) AS traces, round(avg(confidence), 6) AS confidence, round(avg(latency_ms), 6) AS latency_ms, round(avg(CAST(supervisor_route = expected_route AS DOUBLE)), 6) AS routed_as_expected
FROM agent_state JOIN test_questions ON question_id = id GROUP BY category"""
)
def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Averages over the traces of known questions by category, nulls skipped."""
    q = table(spark, sf, "test_questions", "id", "category", "expected_route")
    rows = table(spark, sf, "agent_state", "question_id", "confidence", "latency_ms", "supervisor_route").join(q, F.col("question_id") == F.col("id"))
    as_expected = (F.col("supervisor_route") == F.col("expected_route")).cast("double")
    return rows.groupBy("category").agg(F.count("*").alias("traces"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("latency_ms"), 6).alias("latency_ms"), F.round(F.avg(as_expected), 6).alias("routed_as_expected"))


@query(
    """SELECT len(workers_called) AS workers, count(*) AS traces, round(avg(confidence), 6) AS confidence, round(avg(latency_ms), 6) AS latency_ms, round(avg(len(sources)), 6) AS sources FROM agent_state GROUP BY 1"""
)
def worker_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Traces of one worker against those of several."""
    t = table(spark, sf, "agent_state", "workers_called", "confidence", "latency_ms", "sources")
    return t.groupBy(F.size("workers_called").cast("bigint").alias("workers")).agg(F.count("*").alias("traces"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("latency_ms"), 6).alias("latency_ms"), F.round(F.avg(F.size("sources")), 6).alias("sources"))


_ROUTES = [("refund", ["hoàn phí", "refund", "đổi trả", "returns"]), ("access", ["quyền truy cập", "access", "giấy phép", "licences"]), ("people", ["nghỉ", "time off", "phụ cấp", "allowance", "đào tạo", "training"])]
_ROUTE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(task), '{w}')" for w in words) + f" THEN '{name}'" for name, words in _ROUTES) + " ELSE 'general' END"


@query(f"SELECT {_ROUTE_SQL} AS route, supervisor_route, count(*) AS traces FROM agent_state GROUP BY ALL")
def route_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks routed by a table of key words, against the route that was taken."""
    rows = evaluation.routed(table(spark, sf, "agent_state", "task", "supervisor_route"), "task", _ROUTES, "general")
    return rows.groupBy("route", "supervisor_route").agg(F.count("*").alias("traces"))


# --- snapshots and streams ------------------------------------------------------------------------------------------


@query(
    _CLEAN_SQL
    + """, keys AS (SELECT DISTINCT run_id, document || '_' || sha256(document || '|' || text)[1:16] AS k FROM cleaned WHERE first_reason IS NULL),
runs AS (SELECT run_id, row_number() OVER (ORDER BY run_id) AS no FROM (SELECT DISTINCT run_id FROM keys)),
n AS (SELECT no, k FROM keys JOIN runs USING (run_id)), sides AS (SELECT no, k, sum(here) AS side FROM (SELECT no, k, 1 AS here FROM n UNION ALL SELECT no + 1, k, 2 FROM n) GROUP BY no, k)
SELECT run_id, count(*) FILTER (WHERE side = 3) AS kept, count(*) FILTER (WHERE side = 1) AS added, count(*) FILTER (WHERE side = 2) AS pruned FROM sides JOIN runs USING (no) GROUP BY run_id"""
)
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What publishing each run after the other keeps, adds and prunes."""
    rows = cleaning.prepared(table(spark, sf, "policy_export_dirty"), table(spark, sf, "doc_catalog"))
    failed = F.lit(False)
    for rule in cleaning.default_rules():
        failed = failed | rule.failed
    return snapshots.changes(cleaning.content_ids(rows.where(~failed)).select("run_id", "chunk_key"), "run_id", "chunk_key")


@query(
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY date_trunc('hour', ts), event_type"""
)
def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly metrics of the events, computed by a stream."""
    return events.event_windows(spark, sf)
