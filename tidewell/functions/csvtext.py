"""Strict RFC 4180 records as columns, without a parser of our own per row.

A record is split at its quote marks: pieces at even places lie outside quotes, the others inside. Outside pieces must
be empty (a doubled quote), or begin and end with a comma (the first may begin, the last may end anywhere). That decides
the quoting, and the cells follow by splitting once more at the outside commas. No step backtracks, so that records of
any length can be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A stand-in for a comma inside quotes, and what marks the two where a text has them itself.
_ESCAPE, _COMMA = "\u0001", "\u0002"


def with_cells(df: DataFrame, raw: str, prefix: str = "csv") -> DataFrame:
    """``df`` with ``<prefix>_quoting_ok`` (boolean) and ``<prefix>_cells`` (array of strings; null where quoting is broken).

    One final CR or CRLF is the line end and no part of the record. Line breaks inside quotes are kept. A line break, or a
    quote mark, outside quotes is broken quoting. A null record has no cells and counts as broken; an empty one has one
    empty cell.
    """
    line, pieces, cells = f"__{prefix}_line", f"__{prefix}_pieces", f"__{prefix}_joined"
    text = F.regexp_replace(F.col(f"`{raw}`"), F.lit(r"(\r?\n|\r)$"), F.lit(""))
    text = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "A")), F.lit(_COMMA), F.lit(_ESCAPE + "B"))
    out = df.withColumns({line: text}).withColumns({pieces: F.split(F.col(line), F.lit('"'), -1)})
    # nothing in the lambdas may refer to the whole array, which would be made anew for each of its pieces
    many = F.size(pieces)
    first, last = F.element_at(pieces, 1), F.element_at(pieces, -1)
    middle = F.slice(F.col(pieces), 2, F.greatest(many - 2, F.lit(0)))  # inside, outside, inside, ...
    broken = lambda p: p.rlike(r"[\r\n]")
    between = lambda p, i: (i % 2 == 0) | (p == "") | (p.startswith(",") & p.endswith(",") & ~broken(p))
    ends = ((first == "") | first.endswith(",")) & ((last == "") | last.startswith(",")) & ~broken(first) & ~broken(last)
    ok = (many % 2 == 1) & ends & F.forall(F.transform(middle, between), lambda b: b)
    inner = F.transform(middle, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit(_COMMA))).when(p == "", F.lit('"')).otherwise(p))
    quoted = F.concat(F.array(first), inner, F.array(last))
    ok = F.when(F.contains(F.col(line), F.lit('"')), ok).otherwise(~F.col(line).rlike(r"[\r\n]"))
    plain = F.when(F.contains(F.col(line), F.lit('"')), F.array_join(quoted, "")).otherwise(F.col(line))
    out = out.withColumns({f"{prefix}_quoting_ok": F.coalesce(ok, F.lit(False)), cells: plain})
    commas = lambda c: F.replace(c, F.lit(_COMMA), F.lit(","))
    own = lambda c: F.replace(F.replace(c, F.lit(_ESCAPE + "B"), F.lit(_COMMA)), F.lit(_ESCAPE + "A"), F.lit(_ESCAPE))
    restored = F.transform(F.split(F.col(cells), F.lit(","), -1), lambda c: own(commas(c)))
    out = out.withColumns({f"{prefix}_cells": F.when(F.col(f"{prefix}_quoting_ok"), restored)})
    return out.drop(line, pieces, cells)
