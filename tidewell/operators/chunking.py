"""Documents to chunks: headers, sections, sizes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header labels and the sizes of chunks in characters.
HEADER = {"source": "Source", "department": "Department", "effective_date": "Effective Date", "access": "Access"}
DEFAULTS = {"source": "", "department": "unknown", "effective_date": "unknown", "access": "internal"}
CHUNK_CHARS, OVERLAP_CHARS = 1600, 320
_BLANKS = " \t\n\x0b\f\r"
_BREAK = re.compile(f"\n[{_BLANKS}]*\n")
HEADING = r"===[^\n]*?==="


def parsed(documents: DataFrame, text: str = "text", keep_header_notes: bool = True) -> DataFrame:
    """``documents`` with ``h_<field>`` of the lines before the first ``===`` and ``body`` from there on.

    Of several lines of a label the last counts. Without a heading the whole text is body if ``keep_header_notes``, else
    nothing is. Three or more line ends in the body become two. Null texts count as "".
    """
    value = F.coalesce(F.col(text), F.lit(""))
    at = F.regexp_instr(value, F.lit(r"(?m)^==="))
    rows = documents.withColumn("__at", at)
    head = F.when(F.col("__at") > 0, F.substring(value, F.lit(1), F.col("__at") - 1)).otherwise(F.lit(""))
    rows = rows.withColumn("__head", head)
    found = {f"h_{k}": F.trim(F.regexp_extract("__head", rf"(?s)^(?:.*\n)?{label}:([^\n]*)", 1)) for k, label in HEADER.items()}
    rows = rows.withColumns({k: F.when(c == "", F.lit(DEFAULTS[k[2:]])).otherwise(c) for k, c in found.items()})
    body = F.when(F.col("__at") > 0, F.substring(value, F.col("__at"), F.length(value))).otherwise(value if keep_header_notes else F.lit(""))
    return rows.withColumn("body", F.regexp_replace(body, F.lit(r"\n{3,}"), F.lit("\n\n"))).drop("__at", "__head")


def sections(rows: DataFrame, body: str = "body") -> DataFrame:
    """One row per section with text: ``section`` (the heading, ``General`` before the first) and ``section_text``, in order by ``section_no``."""
    titles = F.concat(F.array(F.lit("General")), F.transform(F.regexp_extract_all(F.col(body), F.lit(HEADING), F.lit(0)), lambda t: F.trim(F.translate(t, "=", " "))))
    texts = F.split(F.col(body), HEADING, -1)
    zipped = F.arrays_zip(titles.alias("t"), texts.alias("x"))
    out = rows.select("*", F.posexplode(zipped).alias("section_no", "__s"))
    out = out.select(*rows.columns, "section_no", F.col("__s.t").alias("section"), F.regexp_replace("__s.x", r"^\s+|\s+$", "").alias("section_text"))
    return out.where("section_text <> ''")


def fixed_pieces(rows: DataFrame, text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Pieces of ``size`` characters that overlap: ``piece_no`` and ``piece``; the last one reaches the end of the text."""
    step = size - overlap
    last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
    out = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    return out.withColumn("piece", F.substring(F.col(text), F.col("piece_no") * step + 1, F.lit(size)))


def packed_paragraphs(rows: DataFrame, text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Paragraphs put together in order up to ``size`` characters: ``piece_no`` and ``piece``.

    Each piece but the first begins with the last ``overlap`` characters of what the one before it added, so that at most
    ``size - overlap`` are new. A longer paragraph is cut. Null and blank texts give no pieces. A text of any length is read
    once, in time linear in its length.
    """
    room = size - overlap

    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([_packed(t, room, overlap) if t else [] for t in texts])

    return rows.select("*", F.posexplode(pack(F.col(text))).alias("piece_no", "piece"))


def _packed(text: str, room: int, overlap: int) -> list[str]:
    units = [p[i : i + room] for p in _BREAK.split(text) if p.strip(_BLANKS) for i in range(0, len(p), room)]
    own: list[list[str]] = []
    used = room
    for unit in units:
        if own and used + 2 + len(unit) <= room:
            own[-1].append(unit)
            used += 2 + len(unit)
        else:
            own.append([unit])
            used = len(unit)
    pieces = ["\n\n".join(p) for p in own]
    return [(before[-overlap:] if overlap else "") + piece for before, piece in zip(["", *pieces], pieces)]


def token_estimate(text: Column) -> Column:
    """About how many tokens a text has: a quarter of its characters."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")
