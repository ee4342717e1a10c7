"""Queries of the training-data operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import duplicates, encodings, leaks, packing, pairs, pii, representatives
from tidewell.sources.tables import table

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


# SQL by plain text: another way to the copies of records, and to passages word for word.
_WORD, _DIGIT, _SIGN = r"[\p{L}\p{N}\p{M}]", r"\p{Nd}", r"[^\p{L}\p{N}\p{M}\p{Z}\s\x0b\x1c-\x1f\x{85}]"
_WORDS = rf"{_WORD}*{_DIGIT}(?:{_SIGN}(?:{_DIGIT}|{_DIGIT}{_WORD}*{_DIGIT}))*{_SIGN}{_DIGIT}{_WORD}*|{_WORD}+"


def _signs_in_numbers(text: str) -> str:
    """SQL for ``text`` in which signs right between two digits part no fields; two passes, as digits may be shared."""
    for code, sign in enumerate((";", r"\|", "[:：]"), 0xE000):
        for _ in range(2):
            text = rf"regexp_replace({text}, '({_DIGIT}){sign}({_DIGIT})', '\1' || chr({code}) || '\2', 'g')"
    return text


_COPIES = rf"""
WITH texts AS (
  SELECT row_id, regexp_replace(lower(nfc_normalize(coalesce(doc_id, ''))), '[^\p{{L}}\p{{N}}\p{{M}}]', '', 'g') AS id,
    regexp_replace(lower(nfc_normalize(chunk_text)), '[\p{{Cf}}\p{{Co}}\x00-\x08\x0e-\x1b\x7f-\x{{84}}\x{{86}}-\x{{9f}}]', '', 'g') AS t
  FROM policy_export_dirty),
parted AS (SELECT row_id, id, regexp_split_to_array({_signs_in_numbers("t")}, '[;|\n\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]') AS pieces FROM texts),
pieces AS (SELECT row_id, id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM parted),
marked AS (
  SELECT row_id, id, i, regexp_matches(piece, '^[^:：]*[\p{{L}}\p{{N}}][^:：]*[:：].*[\p{{L}}\p{{N}}]') AS label, array_to_string(regexp_extract_all(piece, '{_WORDS}'), ' ') AS words
  FROM pieces WHERE regexp_matches(piece, '[\p{{L}}\p{{N}}]')),
numbered AS (
  SELECT *, count_if(label) OVER (PARTITION BY row_id ORDER BY i) AS field,
    count_if(label) OVER (PARTITION BY row_id) >= 3 AND first_value(label) OVER (PARTITION BY row_id ORDER BY i) AS is_fields FROM marked),
fields AS (
  SELECT row_id, id, is_fields, string_agg(words, ' ' ORDER BY i) AS words
  FROM numbered GROUP BY row_id, id, is_fields, CASE WHEN is_fields THEN field END),
keys AS (SELECT row_id, id, is_fields, list_sort(list(words)) AS words FROM fields GROUP BY row_id, id, is_fields),
grouped AS (
  SELECT row_id, min(row_id) OVER (PARTITION BY id, is_fields, words) AS first_row_id, count(*) OVER (PARTITION BY id, is_fields, words) AS copies FROM keys)
"""


@query(_COPIES + "SELECT first_row_id, row_id AS copy_row_id FROM grouped WHERE row_id <> first_row_id")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of export records in another format, with the first row of their group."""
    return duplicates.found(table(spark, sf, "policy_export_dirty"))


@query(
    _COPIES
    + """SELECT row_id, doc_id, chunk_text, coalesce(copies, 1) AS copies
FROM policy_export_dirty LEFT JOIN grouped USING (row_id) WHERE first_row_id IS NULL OR first_row_id = row_id"""
)
def p1_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Each export record once, with its number of copies."""
    return duplicates.collapsed(table(spark, sf, "policy_export_dirty"))


@query()
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose text went through a wrong character encoding."""
    return encodings.restored(table(spark, sf, "policy_export_dirty")).select("row_id")


@query()
def p3_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Those rows with their text restored as far as nothing was lost."""
    return encodings.restored(table(spark, sf, "policy_export_dirty"))


@query()
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The copies that give each field of the surviving record of a group."""
    return representatives.representatives(table(spark, sf, "policy_export_dirty"), table(spark, sf, "export_sources"))


@query()
def p2_current(spark: SparkSession, sf: str) -> DataFrame:
    """The topologically latest values of each group, where missing timestamps are placed by learned precedence."""
    return representatives.current(table(spark, sf, "policy_export_dirty"), table(spark, sf, "export_sources"))


@query()
def p2_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving record of each group."""
    return representatives.merged(table(spark, sf, "policy_export_dirty"), table(spark, sf, "export_sources"))


@query(
    r"""
WITH texts AS (SELECT 'document' AS kind, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'item', item_id, passage FROM eval_passages),
plain AS (
  SELECT kind, id, regexp_replace(regexp_replace(t, '</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>@]*)?/?>|&(?:nbsp|amp|lt|gt|quot|#\d{1,6});', ' ', 'g'), '\p{Cf}', '', 'g') AS t FROM texts),
parted AS (SELECT kind, id, regexp_extract_all(translate(lower(strip_accents(t)), 'đ', 'd'), '[\p{L}\p{N}]+') AS words FROM plain),
words AS (SELECT kind, id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM parted),
runs AS (SELECT kind, id, string_agg(word, ' ') OVER following AS run, count(*) OVER following AS n FROM words
  WINDOW following AS (PARTITION BY kind, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i USING (run)
WHERE d.kind = 'document' AND i.kind = 'item' AND d.n = 13 AND i.n = 13
"""
)
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the test items of which they hold 13 consecutive words or more."""
    return leaks.found(table(spark, sf, "documents"), table(spark, sf, "eval_passages"))


@query()
def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Leaks with their longest piece and their coverage, pieces in another order included."""
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_passages"))


@query()
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct item of personal data of each document."""
    return pii.found(table(spark, sf, "documents"))


@query()
def p9_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with typed placeholders in the place of personal data."""
    return pii.masked(table(spark, sf, "documents"))


@query()
def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in the containers of each window."""
    return packing.packed(table(spark, sf, "documents"), table(spark, sf, "context_windows"))


@query()
def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each window are."""
    windows = table(spark, sf, "context_windows")
    return packing.fill_rates(packing.packed(table(spark, sf, "documents"), windows), windows)


@query()
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Defective question and answer pairs, with the defect."""
    return pairs.flagged(table(spark, sf, "agent_state"), table(spark, sf, "test_questions"))
