"""Text that went through a wrong character encoding (problem 3).

Adjacent characters are counted over the whole corpus, and each pair gets its pointwise mutual information, weighted so
that rare pairs don't profit from being rare (the cubed form, log p(ab)^3 / p(a) p(b)). Pairs below a threshold are
improbable; maximum-scoring segments of a row isolate the runs where they gather. Only inside such runs inverse mappings
are tried: back to the bytes of a legacy code page and forward through UTF-8 (or the Vietnamese code page), as often as
it makes the text more probable. Characters that were lost can't be restored, but their runs are found.

How often a garbled text stands there must not make it probable: each distinct text is counted once, and characters that
have the shape of damage (``damaged``) aren't counted at all. They open a run whatever their bits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.textblocks import MAX_CODE, blocks

#: Pairs are counted in so many buckets, which bounds what is collected and broadcast whatever the corpus' size.
PAIR_BITS, CHAR_BITS = 20, 16
#: A pair is improbable from so many bits on; a segment needs so many bits above that.
IMPROBABLE_BITS, SEGMENT_BITS = 18.0, 0.5
#: A restored run must be more probable than the garbled one by so many bits a pair.
GAIN_BITS = 1.5
# The code pages through which text is wrongly read.
CODE_PAGES = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1258", "koi8_r", "cp852", "cp866")
LOST = "�"
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")


def pair_buckets(points: np.ndarray) -> np.ndarray:
    """The bucket of each character with the next one."""
    with np.errstate(over="ignore"):
        return ((points[:-1] * np.uint32(0x9E3779B1)) ^ (points[1:] * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - PAIR_BITS)


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs, chars = np.zeros(1 << PAIR_BITS, np.int64), np.zeros(1 << CHAR_BITS, np.int64)
    for batch in batches:
        for _, _, points, offsets in blocks(batch.column(0)):
            whole = ~damaged(points, offsets)
            chars += np.bincount(points[whole] & ((1 << CHAR_BITS) - 1), minlength=len(chars))
            if len(points) < 2:
                continue
            inside = np.ones(len(points), bool)
            inside[offsets[1:-1][offsets[1:-1] < len(points)]] = False  # no pair across two rows
            inside = inside[1:] & whole[:-1] & whole[1:]
            pairs += np.bincount(pair_buckets(points)[inside], minlength=len(pairs))
    for kind, counts in ((0, pairs), (1, chars)):
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["kind", "bucket", "n"])


class PairModel:
    """Improbability in bits of each pair of characters."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray) -> None:
        total = max(int(chars.sum()), 1)
        self.pair_bits = (-3 * np.log2((pairs + 0.1) / total)).astype(np.float32)
        self.char_bits = np.log2((chars + 0.5) / total).astype(np.float32)

    def bits(self, points: np.ndarray) -> np.ndarray:
        low = points & ((1 << CHAR_BITS) - 1)
        alone = self.char_bits[low]
        return self.pair_bits[pair_buckets(points)] + alone[:-1] + alone[1:]

    def mean_bits(self, text: str) -> float:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return float(np.minimum(self.bits(points), 45).mean()) if len(points) > 1 else 0.0


def pair_model(texts: DataFrame) -> PairModel:
    """The model of all distinct texts of the one column of ``texts``; at most 2**20 + 2**16 counts reach the driver."""
    counts = texts.distinct().mapInArrow(count_pairs, "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    kind, bucket, n = (counts.column(i).to_numpy() for i in range(3))
    pairs, chars = np.zeros(1 << PAIR_BITS, np.int64), np.zeros(1 << CHAR_BITS, np.int64)
    pairs[bucket[kind == 0]] = n[kind == 0]
    chars[bucket[kind == 1]] = n[kind == 1]
    return PairModel(pairs, chars)


def _page_map(page: str) -> dict[int, int]:
    """Characters of a code page to their bytes; bytes without a character stand for themselves."""
    out = {}
    for byte in range(128, 256):
        try:
            out[ord(bytes([byte]).decode(page))] = byte
        except UnicodeDecodeError:
            out[byte] = byte
    return out


PAGES = {page: _page_map(page) for page in CODE_PAGES}
_OUTSIDE = 0x10F000  # characters that a code page lacks are moved here meanwhile


class _Translate(dict):
    def __init__(self, page: dict[int, int]) -> None:
        super().__init__(page)

    def __missing__(self, code: int) -> int:
        self[code] = code if code < 128 else _OUTSIDE + (code & 0xFFF)
        return self[code]


_TRANSLATE = {page: _Translate(table) for page, table in PAGES.items()}


def through_utf8(run: str, page: str) -> tuple[str, int]:
    """``run`` with every UTF-8 sequence of its bytes in ``page`` read as UTF-8, and how many characters those took."""
    as_bytes = run.translate(_TRANSLATE[page])
    out, taken, last = [], 0, 0
    for m in _UTF8.finditer(as_bytes):
        try:
            char = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += run[last : m.start()], char
        taken += m.end() - m.start()
        last = m.end()
    out.append(run[last:])
    return "".join(out), taken


_VIETNAMESE = {code: bytes([byte]).decode("cp1258") for code, byte in PAGES["cp1252"].items() if byte in range(0xC0, 0x100) and byte not in (0xD7, 0xF7)}
_VIETNAMESE_SIGNS = frozenset(chr(c) for c, v in _VIETNAMESE.items() if unicodedata.combining(v) or v in "ăĂđĐơƠưƯ₫")


def _class(codes) -> str:
    return "[" + "".join(re.escape(chr(c)) for c in sorted(codes)) + "]"


def _sequences(page: dict[int, int]) -> str:
    """A pattern for UTF-8 sequences as they look in a code page."""
    of = lambda low, high: _class(c for c, byte in page.items() if low <= byte <= high)
    rest = of(0x80, 0xBF)
    return f"{of(0xC2, 0xDF)}{rest}|{of(0xE0, 0xEF)}{rest}{rest}|{of(0xF0, 0xF4)}{rest}{rest}{rest}"


#: Which code pages can explain anything in a run: asked before any mapping is tried.
_SIGNATURES = {page: re.compile(_sequences(table)) for page, table in PAGES.items()}
_ANY_SIGNATURE = re.compile("|".join(_sequences(table) for table in PAGES.values()))


def _roles() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per character, in which code pages (a bit each) it is the first of two, the first of three or four, or a later byte.

    A character also has the roles of its other letter case, which may have changed after the damage.
    """
    two, more, later = (np.zeros(MAX_CODE, np.uint16) for _ in range(3))
    for bit, table in enumerate(PAGES.values()):
        for code, byte in table.items():
            role = two if 0xC2 <= byte <= 0xDF else more if 0xE0 <= byte <= 0xF4 else later if byte < 0xC0 else None
            if role is not None:
                for other in {chr(code), chr(code).lower(), chr(code).upper()}:
                    if len(other) == 1:
                        role[ord(other)] |= 1 << bit
    return two, more, later


_TWO, _MORE, _LATER = _roles()
#: Signs that damage leaves and plain text hardly has.
_SIGNS = re.compile("[\x80-\x9f\xa1-\xa8\xaa-\xac\xaf\xb1-\xb6\xb8-\xba\xbc-\xbf\u02c6\u02dc\u2020\u2021\u2030\u2039\u203a\u2122\u2200-\u22ff\u2500-\u25ff]")
_MARK_CODES = np.array([ord(c) for c in "ÌÒÞìò"], np.uint32)
_LOST_CODES = np.array([ord(c) for c in "?" + LOST], np.uint32)
_VOWEL = np.zeros(MAX_CODE, bool)
_VOWEL[[ord(c) for c in "aeiouyâêôãõýAEIOUYÂÊÔÃÕÝ"]] = True
_LETTER = np.zeros(MAX_CODE, bool)
_LETTER[:0x10000] = [chr(c).isalpha() for c in range(0x10000)]
#: Letters of Vietnamese and signs of plain text: a sequence of these alone may be correct ("đó", "“á", "Ã”").
_PLAIN = np.zeros(MAX_CODE, bool)
_PLAIN[[ord(c) for c in unicodedata.normalize("NFC", "".join(v + m for v in "aăâeêioôơuưyAĂÂEÊIOÔƠUƯY" for m in ("", "\u0300", "\u0301", "\u0303", "\u0309", "\u0323"))) + "đĐ“”‘’–—…«»\xa0"]] = True
#: Explained characters in a row, with no other foreign one between, that are damage whatever they are; and question marks
#: inside words, or marks of the Vietnamese code page, in one row.
STRONG_CHARS, STRONG_MARKS = 4, 3
_VIETNAMESE_SIGNATURE = re.compile("[aeiouyâêôãõýAEIOUYÂÊÔÃÕÝ][ÌÒÞìò]")


def as_vietnamese_page(run: str) -> tuple[str, int]:
    """``run`` read as the Vietnamese code page instead of the western one."""
    taken = sum(c in _VIETNAMESE_SIGNS for c in run)
    return unicodedata.normalize("NFC", run.translate(_VIETNAMESE)), taken


def restore(run: str, model: PairModel) -> tuple[str, bool]:
    """The most probable reading of a garbled run, and whether it was garbled.

    A run that was read wrongly several times is read back as often; each reading leaves fewer characters.
    """
    garbled, text = False, run
    while True:
        if not _ANY_SIGNATURE.search(text) and not _VIETNAMESE_SIGNATURE.search(text):
            break
        best, best_bits = None, model.mean_bits(text) - GAIN_BITS
        pages = [page for page in CODE_PAGES if _SIGNATURES[page].search(text)] if _ANY_SIGNATURE.search(text) else []
        if len(_VIETNAMESE_SIGNATURE.findall(text)) > 1:
            pages.append("vietnamese")
        for name in pages:
            read, taken = as_vietnamese_page(text) if name == "vietnamese" else through_utf8(text, name)
            if not taken or len(read) > len(text) or read == text or (name == "vietnamese" and any(unicodedata.combining(c) for c in read)):
                continue
            bits = model.mean_bits(read)
            foreign = sum(ord(c) > 127 for c in text)
            # a reading that explains nearly all foreign characters needs no more than not to be worse
            if bits < best_bits or (name != "vietnamese" and taken >= 3 and taken >= 0.8 * foreign and bits < model.mean_bits(text) + 4 and best is None):
                best, best_bits = read, min(bits, best_bits)
        if best is None:
            break
        if garbled and len(best) == len(text):  # only the Vietnamese page changes characters one for one, and that once
            break
        garbled, text = True, best
    return text, garbled


def _segments(weights: list[float]) -> list[tuple[int, int]]:
    """Maximum-scoring segments, disjoint and from left to right: each starts and ends where adding more only costs."""
    out, total, low, start, best, best_end = [], 0.0, 0.0, 0, 0.0, 0
    for i, w in enumerate(weights):
        total += w
        if total - low > best:
            best, best_end = total - low, i + 1
        if total < low or (best > 0 and total - low < best - 12):
            if best >= SEGMENT_BITS:
                out.append((start, best_end))
            total, low, start, best, best_end = 0.0, 0.0, i + 1, 0.0, i + 1
        elif total <= low:
            low, start = total, i + 1
    if best >= SEGMENT_BITS:
        out.append((start, best_end))
    return out


def suspicious_question_marks(text: str) -> bool:
    """Question marks in the place of letters: inside words, or standing alone between words."""
    return bool(re.search(r"[^\W\d_]\?[^\W\d_]|(?:^|\s)\?[^\W\d_]|[^\W\d_]\?\?|\w \? \w", text))


def runs_of(text: str, bits: np.ndarray, over: np.ndarray) -> list[tuple[int, int]]:
    """Runs that hold one of the pairs ``over``, widened over the foreign characters next to them.

    A run is a segment of improbable pairs, or a pair ``over`` by itself where it is in none.
    """
    spans = []
    before = np.append(0, np.cumsum(over)).tolist()
    found = [(a, b) for a, b in _segments((bits - IMPROBABLE_BITS).tolist()) if before[b] > before[a]]
    alone = over.copy()
    for a, b in found:
        alone[a:b] = False
    for a, b in sorted(found + [(k, k + 1) for k in np.flatnonzero(alone).tolist()]):
        b += 1
        while a > 0 and not text[a - 1].isascii():
            a -= 1
        while b < len(text) and not text[b].isascii():
            b += 1
        a, b = max(a - 1, 0), min(b + 1, len(text))
        if spans and a <= spans[-1][1] + 3:
            spans[-1] = (min(a, spans[-1][0]), max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def repaired(text: str, bits: np.ndarray, over: np.ndarray, model: PairModel) -> tuple[str, bool]:
    """``text`` with its garbled runs restored as far as possible, and whether it had any."""
    out, last, garbled = [], 0, False
    for a, b in runs_of(text, bits, over):
        run = text[a:b]
        fixed, was = restore(run, model)
        if not was and _SIGNS.search(run):
            for change in (str.lower, str.upper, str.swapcase):  # letter case changed after the damage
                other = "".join(change(c) if not c.isascii() and len(change(c)) == 1 else c for c in run)
                if other != run:
                    attempt, was = restore(other, model)
                    if was:
                        fixed = attempt
                        break
        garbled |= was or LOST in run or ("?" in run and suspicious_question_marks(text[max(a - 2, 0) : b + 2]))
        out += text[last:a], fixed if was else run
        last = b
    out.append(text[last:])
    fixed = "".join(out)
    if garbled and len(text) > 1:  # damage goes on beside its runs, where pairs happen to be usual
        whole = restore(text, model)[0]
        if model.mean_bits(whole) < model.mean_bits(fixed):
            fixed = whole
    return fixed, garbled


def sequences(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a whole UTF-8 sequence of two, or of three or more, begins as it looks in a code page."""
    later = _LATER[points]
    two, more = np.zeros(len(points), bool), np.zeros(len(points), bool)
    two[:-1] = (_TWO[points[:-1]] & later[1:]) != 0
    more[:-2] = (_MORE[points[:-2]] & later[1:-1] & later[2:]) != 0
    inner = offsets[1:-1]
    two[inner[inner > 0] - 1] = more[inner[inner > 0] - 1] = more[inner[inner > 1] - 2] = False  # none across two rows
    return two, more


def damaged(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which characters have the shape of damage: their number says nothing about how probable they are.

    That is a lost character; a sequence with a character that plain text hardly has; sequences that follow each other with
    no other foreign character between; and in rows with several of them question marks inside words and marks of the
    Vietnamese code page behind vowels.
    """
    out = points == ord(LOST)
    if len(points) < 3:
        return out
    two, more = sequences(points, offsets)
    explained, odd = two.copy(), (points > 127) & ~_PLAIN[points]
    explained[1:] |= two[:-1] | more[:-1]
    explained |= more
    explained[2:] |= more[:-2]
    clear = two & odd
    clear[:-1] |= two[:-1] & odd[1:]
    clear_more = more & odd
    clear_more[:-2] |= more[:-2] & (odd[1:-1] | odd[2:])
    out |= clear | clear_more
    out[1:] |= clear[:-1] | clear_more[:-1]
    out[2:] |= clear_more[:-2]
    foreign = np.flatnonzero(points > 127)
    row_of = lambda at: np.searchsorted(offsets, at, "right")
    if len(foreign):
        shape, row = explained[foreign], row_of(foreign)
        cuts = np.flatnonzero(np.append(True, (shape[1:] != shape[:-1]) | (row[1:] != row[:-1])))
        size = np.diff(np.append(cuts, len(foreign)))
        out[foreign[shape & np.repeat(size >= STRONG_CHARS, size)]] = True
    asked, marked = np.zeros(len(points), bool), np.zeros(len(points), bool)
    asked[1:-1] = _LETTER[points[:-2]] & (points[1:-1] == ord("?")) & _LETTER[points[2:]]
    marked[1:] = _VOWEL[points[:-1]] & np.isin(points[1:], _MARK_CODES)
    for signs in (asked, marked):
        at = np.flatnonzero(signs)
        if len(at) >= STRONG_MARKS:
            row = row_of(at)
            out[at[np.bincount(row)[row] >= STRONG_MARKS]] = True
    return out


def suspects(points: np.ndarray, offsets: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are improbable and such that some inverse mapping could explain them, and the rows that have any.

    That is the begin of a UTF-8 sequence as it looks in a code page, a mark of the Vietnamese code page behind a letter,
    a question mark or a lost character. Characters in the shape of damage need no improbable pair. Rows without any need
    no segments.
    """
    two, more = sequences(points, offsets)
    begins = (two | more)[:-1]
    lost = np.isin(points, _LOST_CODES)
    marked = _VOWEL[points[:-1]] & np.isin(points[1:], _MARK_CODES)
    over = (bits > IMPROBABLE_BITS + SEGMENT_BITS) & (begins | marked | lost[1:] | lost[:-1])
    over[:-1] |= begins[:-1] & (bits[1:] > IMPROBABLE_BITS + SEGMENT_BITS)
    shaped = damaged(points, offsets)
    over |= shaped[:-1] | shaped[1:]
    inner = offsets[1:-1]
    over[inner[(inner > 0) & (inner < len(points))] - 1] = False
    return over, np.unique(np.searchsorted(offsets[:-1], np.flatnonzero(over), "right") - 1)


def repairs(model_broadcast, column: str):
    """The function for ``mapInArrow``: rows whose text is garbled, with the text restored as far as possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_broadcast.value
        for batch in batches:
            texts = batch.column(column)
            rows, fixed = [], []
            for first, _, points, offsets in blocks(texts):
                if len(points) < 2:
                    continue
                bits = model.bits(points)
                over, hits = suspects(points, offsets, bits)
                for i in hits.tolist():
                    s, e = int(offsets[i]), int(offsets[i + 1])
                    text = texts[first + i].as_py()
                    new, garbled = repaired(text, bits[s : e - 1], over[s : e - 1], model)
                    if garbled:
                        rows.append(first + i)
                        fixed.append(new)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(taken), pa.array(fixed, pa.string())], names=["row_id", "restored"])

    return run


def restored(export: DataFrame, column: str = "chunk_text", key: str = "row_id") -> DataFrame:
    """(row_id, restored) for every row whose text was read in a wrong encoding.

    ``restored`` equals the text where nothing can be won back. Null and empty texts are never garbled; texts of any length
    are scored whole; repeated rows give a row each; an empty table gives none; further columns are ignored.
    """
    texts = export.select(F.col(f"`{key}`").alias("row_id"), F.col(f"`{column}`").alias("text"))
    model = pair_model(texts.select("text"))
    shared = export.sparkSession.sparkContext.broadcast(model)
    return texts.mapInArrow(repairs(shared, "text"), "row_id bigint, restored string")
