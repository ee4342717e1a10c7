"""Duplicates hidden by formatting (problem 1).

Texts stream through a table that says of each character whether it is skipped, parts words, or counts and as what
(folded in case; a composed letter as the sum of its base and marks). The counting characters feed two polynomial hashes;
no canonical string is built. The fields of a ``label: value`` text are hashed one by one and their scrambled hashes
summed, so that their order doesn't matter. Rows whose hashes collide are compared by two pointers that skip what does
not count. Within a task equal rows are already joined, so that a record with a third of all rows reaches the shuffle as
few rows per task.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.textblocks import CodeTable, blocks, mixed
from tidewell.operators.joins import join_groups, small
from tidewell.session import stage

SKIP, SEPARATOR, BASE, MARK = 1, 2, 3, 4
#: Texts kept per task to compare with; beyond that the task forgets them and goes on.
TASK_TEXT_CHARS = 32_000_000
#: A hash is hot if more tasks than this have a row of it; the texts of so many hot hashes, up to so long, are broadcast.
HOT_REPS, HEADS, HEAD_CHARS = 10_000, 1_000, 50_000
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C55), np.uint64(0xD1342543DE82EF95))
_WORD_START = mixed(np.array([11, 12], np.uint64))
FIELD_MARKS = frozenset(";|\n\r  \x0b\x0c\x85")


def folded(char: str) -> str:
    """The characters that ``char`` counts as: without case, decomposed."""
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", char).casefold())


def kind_of(char: str) -> int:
    """Whether a character is skipped, parts words, is a letter or digit, or a mark on one."""
    category = unicodedata.category(char)
    if category[0] in "LN":
        return BASE
    if category[0] == "M":
        return MARK
    return SKIP if category in ("Cf", "Cs", "Co", "Cn") or (category == "Cc" and not char.isspace()) else SEPARATOR


def cluster(letter: str) -> str:
    """A letter with its marks in an order of their own, whatever the order they were written in."""
    return letter if len(letter) < 3 else letter[0] + "".join(sorted(letter[1:]))


class Fold(CodeTable):
    """The skip-and-fold table. ``symbol`` numbers what a character counts as, alike for all that count alike."""

    def __init__(self) -> None:
        super().__init__(kind=np.uint8, bases=np.uint8, digit=bool, space=bool, field=bool, colon=bool, first=np.uint64, second=np.uint64, symbol=np.int32)
        self.numbers: dict[str, int] = {}
        self.letters: list[str] = []
        self.joined: dict[tuple[int, int], int] = {}

    def number(self, letter: str) -> int:
        got = self.numbers.setdefault(letter, len(self.letters))
        if got == len(self.letters):
            self.letters.append(letter)
        return got

    def with_mark(self, symbol: int, code: int) -> int:
        """The symbol of a letter with one more mark."""
        got = self.joined.get((symbol, code))
        if got is None:
            got = self.joined[symbol, code] = self.number(cluster(self.letters[symbol] + folded(chr(code))))
        return got

    def fill(self, code: int) -> None:
        char = chr(code)
        self.digit[code] = unicodedata.category(char) == "Nd"
        self.space[code] = char.isspace()
        self.field[code] = char in FIELD_MARKS
        self.colon[code] = char in ":："
        self.kind[code] = kind_of(char)
        self.symbol[code] = self.number(cluster(folded(char)) if self.kind[code] == BASE else char)
        # a separator has weights too: between two digits it is part of the number
        weights, bases = np.zeros(2, np.uint64), 0
        with np.errstate(over="ignore"):
            for part in folded(char) if self.kind[code] in (BASE, MARK) else char:
                bases += unicodedata.category(part)[0] != "M"
                for i in (0, 1):
                    weights[i] += mixed(np.array([ord(part) * 2 + i], np.uint64))[0] * (MULTIPLIERS[i] ** np.uint64(max(bases - 1, 0)))
        self.first[code], self.second[code], self.bases[code] = weights[0], weights[1], bases


_FOLD: Fold | None = None
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def fold() -> Fold:
    global _FOLD
    if _FOLD is None:
        _FOLD = Fold()
    return _FOLD


def powers(which: int, most: int) -> np.ndarray:
    """Powers of a multiplier up to ``most``, kept and doubled when more are asked for."""
    have = _POWERS[which]
    while len(have) <= most:
        with np.errstate(over="ignore"):
            have = np.concatenate([have, have * (MULTIPLIERS[which] ** np.uint64(len(have)))])
    _POWERS[which] = have
    return have


@dataclass
class Layout:
    """Rows without what is skipped: code points, their kinds, offsets, and the segments (fields, or whole rows) to hash."""

    points: np.ndarray
    kind: np.ndarray
    offsets: np.ndarray
    count: np.ndarray  #: letters and digits before each place
    starts: np.ndarray
    ends: np.ndarray
    segment_row: np.ndarray
    is_fields: np.ndarray


def layout(points: np.ndarray, offsets: np.ndarray) -> Layout:
    table = fold()
    table.learn(points)
    rows = len(offsets) - 1
    kind = table.kind[points]
    keep = kind != SKIP
    if not keep.all():
        before = np.zeros(len(points) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        points, kind, offsets = points[keep], kind[keep], before[offsets]
    n = len(points)
    row_start = np.zeros(n + 1, bool)
    row_start[offsets[:-1]] = True
    if n > 2:  # a mark right between two digits is part of the number
        digit = table.digit[points]
        inside = digit[:-2] & digit[2:] & (kind[1:-1] == SEPARATOR) & ~table.space[points[1:-1]] & ~row_start[1 : n - 1] & ~row_start[2:n]
        kind[1:-1][inside] = BASE
    count = np.zeros(n + 1, np.int64)
    np.cumsum(np.where(kind >= BASE, table.bases[points], 0), out=count[1:])
    starts, segment_row, is_fields = offsets[:-1], np.arange(rows), np.zeros(rows, bool)
    if n:
        starts, segment_row, is_fields = _fields(table, points, kind, count, offsets, row_start)
    ends = np.append(starts[1:], offsets[-1]) if len(starts) else starts
    ends = np.where(np.append(segment_row[1:], -1) == segment_row, ends, offsets[segment_row + 1]) if len(starts) else ends
    return Layout(points, kind, offsets, count, starts, ends, segment_row, is_fields)


def _segment_hashes(x: Layout, both: bool = True) -> list[np.ndarray]:
    """The polynomial hashes of each segment, two or only the first; 0 for one without letters."""
    table = fold()
    at = np.flatnonzero(x.kind >= BASE)
    points, base = x.points[at], x.kind[at] == BASE
    cuts = np.searchsorted(at, x.starts), np.searchsorted(at, x.ends)
    position = x.count[at] - np.repeat(x.count[x.starts], cuts[1] - cuts[0])
    position -= ~base
    np.maximum(position, 0, out=position)
    opens = np.flatnonzero(base & (position > 0) & (x.kind[at - 1] == SEPARATOR))
    filled = np.flatnonzero(cuts[1] > cuts[0])
    most, out = int(position.max()) if len(at) else 0, []
    with np.errstate(over="ignore"):
        for which, weights in enumerate((table.first, table.second)[: 1 + both]):
            value = weights[points]
            value[opens] += _WORD_START[which]
            value *= powers(which, most)[position]
            segment = np.zeros(len(x.starts), np.uint64)
            if len(filled):
                segment[filled] = mixed(np.add.reduceat(value, cuts[0][filled]))
            segment[x.count[x.ends] == x.count[x.starts]] = 0
            out.append(segment)
    return out


def text_hashes(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each row, and how many characters of it count."""
    x = layout(points, offsets)
    out = []
    with np.errstate(over="ignore"):
        for i, segments in enumerate(_segment_hashes(x)):
            added = np.zeros(len(x.offsets), np.uint64)
            np.add.at(added, x.segment_row, segments)
            out.append(np.where(x.is_fields, mixed(added[:-1] + np.uint64(77 + i)), added[:-1]))
    return out[0], out[1], x.count[x.offsets[1:]] - x.count[x.offsets[:-1]]


def _fields(table, points, kind, count, offsets, row_start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the segments to hash, the row of each, and which rows are made of three fields or more.

    A piece without a label goes on with the field before it; rows that are not made of fields are one segment.
    """
    n, rows = len(points), len(offsets) - 1
    parted = np.flatnonzero(table.field[points] & (kind == SEPARATOR)) + 1
    begins = np.unique(np.concatenate([offsets[:-1], parted[parted < n]]))
    begins = begins[begins < n] if n else begins
    row = np.searchsorted(offsets, begins, "right") - 1
    ends = np.append(begins[1:], n)
    colon_at = np.where(table.colon[points] & (kind == SEPARATOR), np.arange(n), n)
    colon = np.minimum.reduceat(colon_at, begins)
    has = colon < ends
    colon = np.minimum(colon, n - 1)
    label = has & (count[colon] > count[begins]) & (count[ends] > count[colon])
    filled = count[ends] > count[begins]
    labels = np.bincount(row[label], minlength=rows)
    # the first piece with anything in it must have a label
    firsts = np.full(rows, -1)
    index = np.flatnonzero(filled)[::-1]
    firsts[row[index]] = index
    is_fields = (labels >= 3) & (firsts >= 0) & label[firsts]
    keep = np.where(is_fields[row], label, False)
    starts = np.unique(np.concatenate([offsets[:-1], begins[keep]]))
    # empty rows share their start with the next row; each row needs one of its own
    segment_row = np.concatenate([np.arange(rows), row[keep & (begins != offsets[row])]])
    starts = np.concatenate([offsets[:-1], begins[keep & (begins != offsets[row])]])
    order = np.lexsort((starts, segment_row))
    return starts[order], segment_row[order], is_fields


def same_words(a: str, b: str) -> bool:
    """Whether two texts count alike, by two pointers that skip what doesn't count."""
    if a == b:
        return True
    left, right = field_spans(a), field_spans(b)
    if (len(left) > 1) != (len(right) > 1) or len(left) != len(right):
        return False
    if len(left) == 1:
        return _same(a, 0, len(a), b, 0, len(b))
    rest = list(right)
    for s, e in left:
        match = next((i for i, (t, f) in enumerate(rest) if _same(a, s, e, b, t, f)), None)
        if match is None:
            return False
        del rest[match]
    return True


def field_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the fields of a text made of three or more, else the one span of the text."""
    offsets = np.array([0, len(text)])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not FIELD_MARKS.intersection(text):
        return [(0, len(text))]
    table = fold()
    table.learn(points)
    kind = table.kind[points]
    digit = table.digit[points]
    if len(points) > 2:
        inside = digit[:-2] & digit[2:] & (kind[1:-1] == SEPARATOR) & ~table.space[points[1:-1]]
        kind[1:-1][inside] = BASE
    bases = np.where(kind >= BASE, table.bases[points], 0)
    count = np.append(0, np.cumsum(bases))
    row_start = np.zeros(len(points) + 1, bool)
    row_start[0] = True
    starts, _, is_fields = _fields(table, points, kind, count, offsets, row_start)
    if not is_fields[0]:
        return [(0, len(text))]
    ends = [*starts[1:].tolist(), len(text)]
    return [(s, e) for s, e in zip(starts.tolist(), ends) if count[e] > count[s]]


@functools.lru_cache(100_000)
def _symbol(char: str) -> tuple[int, str]:
    kind = kind_of(char)
    return kind, folded(char) if kind >= BASE else char if kind == SEPARATOR and not char.isspace() else ""


def _letters(symbol: str) -> list[str]:
    """The letters of a symbol that stands for more than one, each with its marks."""
    if len(symbol) == 1:
        return [symbol]
    out: list[str] = []
    for c in symbol:
        if out and unicodedata.category(c)[0] == "M":
            out[-1] += c
        else:
            out.append(c)
    return out


def _stream(text: str, start: int, end: int) -> Iterator[str]:
    """The counting characters of a span one after another, a blank before each word but the first."""
    gap, begun, last_digit, pending = False, False, False, ""
    letter = ""
    for i in range(start, end):
        kind, symbol = _symbol(text[i])
        if kind == SKIP:
            continue
        if kind == MARK:
            letter += symbol
            continue
        if kind == SEPARATOR:
            pending = symbol if last_digit and symbol and not gap else ""
            gap, last_digit = True, False
            continue
        digit = text[i].isdecimal()
        if letter:
            yield cluster(letter)
        if gap and begun:
            yield pending if pending and digit else " "
        *ahead, letter = _letters(symbol)
        yield from ahead
        gap, begun, last_digit, pending = False, True, digit, ""
    if letter:
        yield cluster(letter)


def _same(a: str, s: int, e: int, b: str, t: int, f: int) -> bool:
    left, right = _stream(a, s, e), _stream(b, t, f)
    for x in left:
        if x != next(right, None):
            return False
    return next(right, None) is None


@functools.lru_cache(100_000)
def same_id(a: str | None, b: str | None) -> bool:
    """Whether two ids have the same letters and digits, by two pointers that skip the rest."""
    if a == b:
        return True
    left, right = ((s for kind, s in map(_symbol, x or "") if kind >= BASE) for x in (a, b))
    # a letter and its marks may come as one or as several characters
    return all(x == y for x, y in itertools.zip_longest(itertools.chain.from_iterable(left), itertools.chain.from_iterable(right)))


def _pointers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text counts: the symbol under every step of its pointer, the offsets of the texts, and which are odd.

    A step is a letter or digit with its marks; it also says whether it begins a word or a field. Fields are walked in the
    order of their hashes, so that equal ones meet. Odd texts (a character that stands for several letters, a mark on none)
    are left to the slow comparison.
    """
    steps, sizes, odd = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    table = fold()
    for _, _, points, offsets in blocks(texts):
        x = layout(points, offsets)
        rows, n = len(offsets) - 1, len(x.points)
        at = np.flatnonzero(x.kind == BASE)
        symbol = table.symbol[x.points[at]].astype(np.int64)
        segment = np.repeat(np.arange(len(x.starts)), x.ends - x.starts)
        strange = np.zeros(rows, bool)
        strange[x.segment_row[segment[at[table.bases[x.points[at]] > 1]]]] = True
        marks = np.flatnonzero(x.kind == MARK)
        if len(marks):
            of = np.searchsorted(at, marks) - 1  # the letter that a mark is on
            none = (of < 0) | (segment[at[np.maximum(of, 0)]] != segment[marks]) if len(at) else np.ones(len(marks), bool)
            strange[x.segment_row[segment[marks[none]]]] = True
            marks, of = marks[~none], of[~none]
            nth = np.arange(len(of)) - np.searchsorted(of, of)
            for k in range(int(nth.max()) + 1 if len(nth) else 0):
                here = nth == k
                pair = (symbol[of[here]] << 21) | x.points[marks[here]]
                known, back = np.unique(pair, return_inverse=True)
                symbol[of[here]] = np.array([table.with_mark(p >> 21, p & 0x1FFFFF) for p in known.tolist()])[back]
        parted = np.zeros(n + 1, np.int64)
        np.cumsum(x.kind == SEPARATOR, out=parted[1:])
        of_segment = segment[at]
        opens = np.zeros(len(at), np.int64)
        begins = np.ones(len(at), bool)
        if len(at) > 1:
            begins[1:] = of_segment[1:] != of_segment[:-1]
            opens[1:] = parted[at[1:]] > parted[at[:-1]]
        row = x.segment_row[of_segment]
        opens[begins] = np.where(x.is_fields[row[begins]], 2, 0)
        step = symbol * 4 + opens
        if x.is_fields.any():
            order = np.lexsort((np.arange(len(at)), _segment_hashes(x, both=False)[0][of_segment] * x.is_fields[row], row))
            step = step[order]
        steps.append(step)
        sizes.append(np.bincount(row, minlength=rows))
        odd.append(strange)
    size = np.concatenate(sizes)
    return np.concatenate(steps), np.append(0, np.cumsum(size)), np.concatenate(odd)


def same_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """``same_words`` of each pair of texts: the two pointers of all pairs move in one comparison.

    Only pairs that it doesn't find equal are compared one by one.
    """
    same = np.array([a == b for a, b in zip(left, right)], bool)
    rest = np.flatnonzero(~same)
    if not len(rest):
        return same
    number: dict[str, int] = {}
    pair = np.array([[number.setdefault(t, len(number)) for t in (left[i], right[i])] for i in rest.tolist()])
    steps, offsets, odd = _pointers(pa.array(list(number), pa.large_string()))
    a, b = pair[:, 0], pair[:, 1]
    size = np.diff(offsets)
    fits = np.flatnonzero((size[a] == size[b]) & ~odd[a] & ~odd[b] & (size[a] > 0))
    length = size[a[fits]]
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    alike = steps[np.repeat(offsets[a[fits]], length) + within] == steps[np.repeat(offsets[b[fits]], length) + within]
    if len(fits):
        same[rest[fits]] = np.logical_and.reduceat(alike, np.cumsum(length) - length)
    for i in np.flatnonzero(~same).tolist():
        same[i] = same_words(left[i], right[i])
    return same


def id_hashes(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of the letters and digits of each row."""
    table = fold()
    table.learn(points)
    counts = table.kind[points] >= BASE
    before = np.append(0, np.cumsum(counts))
    points, offsets = points[counts], before[offsets]
    bases = table.bases[points].astype(np.int64)
    count = np.append(0, np.cumsum(bases))
    position = count[:-1] - np.repeat(count[offsets[:-1]], np.diff(offsets))
    position = np.maximum(np.where(bases == 0, position - 1, position), 0)
    with np.errstate(over="ignore"):
        value = table.first[points] * powers(0, int(position.max()) if len(position) else 0)[position]
        total = np.append(np.uint64(0), np.cumsum(value, dtype=np.uint64))
        return mixed(total[offsets[1:]] - total[offsets[:-1]])


def hash_rows(carried: tuple[str, ...] = ()):
    """For ``mapInArrow`` over (row_id, doc_id, chunk_text, *carried): hash the rows and join copies within the task.

    ``rep`` is the row of this task that a row was found equal to; only such rows keep their texts. Texts without a
    letter or digit are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[int, str, str]] = {}
        chars = 0
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("chunk_text")
            n = batch.num_rows
            h1, h2, words = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
            for a, b, points, offsets in blocks(texts):
                h1[a:b], h2[a:b], words[a:b] = text_hashes(points, offsets)
            for a, b, points, offsets in blocks(docs):
                of_id = id_hashes(points, offsets)
                with np.errstate(over="ignore"):
                    h1[a:b], h2[a:b] = mixed(h1[a:b] + of_id), mixed(h2[a:b] ^ of_id)
            take = pa.array(np.flatnonzero(words > 0))
            kept = batch.take(take)
            k1, k2 = h1.view(np.int64)[take], h2.view(np.int64)[take]
            rows, some_docs, some_texts = (kept.column(c).to_pylist() for c in ("row_id", "doc_id", "chunk_text"))
            again, firsts = [], []
            for i, key in enumerate(zip(k1.tolist(), k2.tolist())):
                first = seen.setdefault(key, (rows[i], some_docs[i], some_texts[i]))
                if first[0] == rows[i] and first[2] is some_texts[i]:
                    chars += len(some_texts[i])
                else:
                    again.append(i)
                    firsts.append(first)
            reps = list(rows)
            same = same_pairs([f[2] for f in firsts], [some_texts[i] for i in again])
            for i, first, text_is_same in zip(again, firsts, same.tolist()):
                if text_is_same and same_id(first[1], some_docs[i]):
                    reps[i], some_docs[i], some_texts[i] = first[0], None, None
            columns = [kept.column("row_id"), pa.array(k1), pa.array(k2), pa.array(reps, pa.int64()), pa.array(some_docs, pa.string()), pa.array(some_texts, pa.string()), *(kept.column(c) for c in carried)]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "h1", "h2", "rep", "doc_id", "chunk_text", *carried])
            if chars > TASK_TEXT_CHARS:
                seen, chars = {}, 0

    return run


_CLASSES = pa.schema([("rep", pa.int64()), ("other", pa.int32())])


def compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a run of equal hashes with the run's first text; the input is sorted by hash.

    Gives (rep, other) only for rows that are no copies of the run's first text: ``other`` numbers their class.
    """
    key, head, classes = None, ("", ""), []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k1, k2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        new = np.ones(n, bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        new[0] = key != (int(k1[0]), int(k2[0]))
        run = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # where the run began; -1 is before this batch
        docs, texts = batch.column("doc_id"), batch.column("chunk_text")
        at = np.flatnonzero(~new)
        begin = run[at]
        left = [head if b < 0 else (d, t) for b, d, t in zip(begin.tolist(), *(c.take(pa.array(np.maximum(begin, 0))).to_pylist() for c in (docs, texts)))]
        right = list(zip(*(c.take(pa.array(at)).to_pylist() for c in (docs, texts))))
        same = same_pairs([t for _, t in left], [t for _, t in right])
        found, of_run = [], -1
        for i, b, (first_doc, _), (doc, text), text_is_same in zip(at.tolist(), begin.tolist(), left, right, same.tolist()):
            if text_is_same and same_id(first_doc, doc):
                continue
            if b != of_run:
                of_run, classes = b, classes if b < 0 else []
            number = next((k for k, (d, t) in enumerate(classes, 1) if same_id(d, doc) and same_words(t, text)), None)
            if number is None:
                classes.append((doc, text))
                number = len(classes)
            found.append((batch.column("rep")[i].as_py(), number))
        last = int(run[-1])
        if last >= 0:
            head = docs[last].as_py(), texts[last].as_py()
            classes = classes if of_run == last else []
        key = (int(k1[-1]), int(k2[-1]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int32())], schema=_CLASSES)


def differ_from_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (..., doc_id, chunk_text, head_doc, head_text) that are no copies of the head they come with."""
    for batch in batches:
        texts, heads, docs, head_docs = (batch.column(c).to_pylist() for c in ("chunk_text", "head_text", "doc_id", "head_doc"))
        same = same_pairs(heads, texts) & np.array([same_id(a, b) for a, b in zip(head_docs, docs)], bool)
        yield batch.filter(pa.array(~same)).select(["h1", "h2", "rep", "doc_id", "chunk_text"])


def _classes(reps: DataFrame) -> DataFrame:
    """(rep, other) for rows that are no copies of the first one of their hashes."""
    return reps.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "rep").mapInArrow(compare_runs, "rep bigint, other int")


def collisions(reps: DataFrame, keys: DataFrame) -> DataFrame:
    """(rep, other) for rows whose hashes, but not texts, are those of their group: practically none, yet all are compared.

    Hashes with more than ``HOT_REPS`` rows (a row per map task that holds a copy) don't meet in one task: the text of one of
    them is broadcast, and each row is compared with it where it stands. There are at most ``HEADS`` such texts of at most
    ``HEAD_CHARS`` characters; a hash beyond that holds a smaller share of all rows and is compared as a run.
    """
    hot = keys.where(F.col("reps") > HOT_REPS).orderBy(F.desc("reps"), "h1", "h2").limit(HEADS).select("head")
    if hot.isEmpty():
        return stage(_classes(reps), "collided")
    heads = reps.join(F.broadcast(hot), F.col("rep") == F.col("head")).where(F.length("chunk_text") <= HEAD_CHARS)
    heads = stage(heads.select("h1", "h2", F.col("doc_id").alias("head_doc"), F.col("chunk_text").alias("head_text")), "heads")
    split = reps.join(F.broadcast(heads), ["h1", "h2"], "left")
    differing = stage(split.where("head_text IS NOT NULL").mapInArrow(differ_from_head, reps.schema), "differing")
    among = differing.select("rep").join(_classes(differing), "rep", "left").select("rep", (F.coalesce("other", F.lit(0)) + 1).alias("other"))
    return stage(_classes(split.where("head_text IS NULL").select(*reps.columns)).unionAll(among), "collided")


def copies(export: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(first_row_id, copy_row_id): every row that has copies, with the smallest row_id of its group; the first too.

    Null doc_id counts as one without letters. Null, empty and signs-only texts have no copies. Texts of any length are
    hashed whole. Row ids should be unique; a repeated one counts as the same row. Empty tables give no rows and further
    columns are ignored but for those in ``carried``, which are handed through. Texts of three or more ``label: value``
    fields are compared with such texts only.
    """
    narrow = export.select("row_id", "doc_id", "chunk_text", *carried)
    types = "".join(f", `{c}` {narrow.schema[c].dataType.simpleString()}" for c in carried)
    hashed = stage(narrow.mapInArrow(hash_rows(carried), "row_id bigint, h1 bigint, h2 bigint, rep bigint, doc_id string, chunk_text string" + types), "hashed")
    is_rep = F.col("row_id") == F.col("rep")
    keys = hashed.groupBy("h1", "h2").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("n"), F.count_if(is_rep).alias("reps"), F.min(F.when(is_rep, F.col("rep"))).alias("head"))
    keys = stage(keys.where("n > 1"), "keys")
    collided = collisions(hashed.where(is_rep).select("h1", "h2", "rep", "doc_id", "chunk_text"), keys)
    rows = hashed.select("row_id", "h1", "h2", "rep", *carried)
    if collided.isEmpty():
        joined = join_groups(rows.drop("rep"), keys.select("h1", "h2", "first_row_id", "n"), ["h1", "h2"], "n", "row_id")
    else:
        rows = rows.join(small(collided), "rep", "left").withColumn("other", F.coalesce("other", F.lit(0))).drop("rep")
        groups = rows.groupBy("h1", "h2", "other").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("n")).where("n > 1")
        joined = join_groups(rows, groups, ["h1", "h2", "other"], "n", "row_id")
    return joined.select("first_row_id", F.col("row_id").alias("copy_row_id"), *carried)


def found(export: DataFrame) -> DataFrame:
    """One row for each copy that is not the first of its group."""
    return copies(export).where("copy_row_id <> first_row_id")


def collapsed(export: DataFrame) -> DataFrame:
    """Each record once: its smallest row_id and the number of its copies (1 for rows without copies).

    Rows without a letter or digit in their text stand for themselves.
    """
    members = stage(copies(export), "copies")
    counts = members.groupBy(F.col("first_row_id").alias("row_id")).agg(F.count("*").alias("copies"))
    # of each group the first row has the count, the others have none and are left out
    marks = counts.unionAll(members.where("copy_row_id <> first_row_id").select(F.col("copy_row_id").alias("row_id"), F.lit(0).cast("bigint").alias("copies")))
    rows = export.select("row_id", "doc_id", "chunk_text").join(marks, "row_id", "left")
    return rows.where("copies IS NULL OR copies > 0").withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint")))
