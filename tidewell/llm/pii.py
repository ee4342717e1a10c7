"""Personal information inside free text (problem 9), by a conditional random field over word shapes.

A small labelled table (``labelled_pii.txt``, whose size bounds the training) trains a linear chain. Texts are cut into
words, numbers and signs with numpy; features are hashes of words and shapes around each token. Tokens that can't be part
of an item, by an upper bound of what any other label could gain, are passed over; windows around the rest are decoded by
Viterbi in batches. What the chain marks is then checked against the exact form of its type, which fixes its ends.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.crf import Chain, trained
from tidewell.llm.textblocks import CodeTable, blocks, mixed

TYPES = ("email", "phone", "id_number", "address", "person_name")
LABELS = ("O", *(f"{x}-{t}" for t in TYPES for x in "BI"))
#: Lines of the labelled table; at most so many are used for training.
LABELLED = resources.files(__package__).joinpath("labelled_pii.txt")
LABELLED_ROWS = 2_000
FEATURE_BITS = 16
#: A token opens a decoding window if another label than O could gain on it, less this; windows reach so many tokens out.
MARGIN, REACH = 2.0, 8
#: Characters that are worked on at a time; more make better batches and need more memory.
BLOCK_CHARS = 2_000_000
LOWER, UPPER, DIGIT, MARK, SPACE, LINE, SIGN = 1, 2, 3, 4, 5, 6, 7


class Shapes(CodeTable):
    """The kind of each character and the hash of its lower case."""

    def __init__(self) -> None:
        super().__init__(kind=np.uint8, weight=np.uint64)

    def fill(self, code: int) -> None:
        char = chr(code)
        category = unicodedata.category(char)
        if char in "\n\r  ":
            kind = LINE
        elif char.isspace() or category in ("Cf", "Cc"):
            kind = SPACE
        elif category[0] == "M":
            kind = MARK
        elif category == "Nd":
            kind = DIGIT
        elif category[0] == "L":
            kind = UPPER if category in ("Lu", "Lt") else LOWER
        else:
            kind = SIGN
        self.kind[code] = kind
        self.weight[code] = mixed(np.array([ord(char.lower()[:1] or char)], np.uint64))[0]


_SHAPES: Shapes | None = None
_POWER = np.uint64(0x9E3779B97F4A7C55)
_POWERS = np.ones(1, np.uint64)


def _powers(most: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) <= most:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([_POWERS, _POWERS * (_POWER ** np.uint64(len(_POWERS)))])
    return _POWERS


def tokens(points: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words, numbers and signs: start, end, row, hash of the word, shape, and what parts it from the token before."""
    global _SHAPES
    if _SHAPES is None:
        _SHAPES = Shapes()
    _SHAPES.learn(points)
    kind = _SHAPES.kind[points]
    group = np.array([0, 1, 1, 2, 1, 0, 0, 3], np.uint8)[kind]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    opens = group > 0
    if n > 1:
        opens[1:] &= (group[1:] != group[:-1]) | (group[1:] == 3) | first[1:n]
    start = np.flatnonzero(opens)
    closes = group > 0
    if n > 1:
        closes[:-1] &= (group[1:] != group[:-1]) | (group[1:] == 3) | first[1:n]
    end = np.flatnonzero(closes) + 1
    size = end - start
    upper = np.zeros(n + 1, np.int32)
    np.cumsum(kind == UPPER, out=upper[1:])
    capitals = upper[end] - upper[start]
    kinds = kind[start]
    lead = kinds == UPPER
    # shape: lower, Capital, CAPITALS, mixed, one capital, digits by length, each sign on its own
    word_shape = np.where(capitals == 0, 1, np.where(capitals == size, np.where(size == 1, 2, 3), np.where(lead & (capitals == 1), 4, 5))) + 8 * np.minimum(size, 4)
    sign_shape = 1000 + points[start].astype(np.int64)
    shape = np.where(kinds == DIGIT, 60 + np.minimum(size, 15), np.where(kinds == SIGN, sign_shape, word_shape))
    with np.errstate(over="ignore"):
        inside = np.flatnonzero(group > 0)
        token_of = np.repeat(np.arange(len(start)), size)
        position = inside - start[token_of]
        value = _SHAPES.weight[points[inside]] * _powers(int(position.max()) if len(position) else 0)[position]
        word = mixed(np.add.reduceat(value, np.flatnonzero(position == 0))) if len(start) else np.zeros(0, np.uint64)
        # numbers count by their length and first digit
        word = np.where(kinds == DIGIT, mixed(size.astype(np.uint64) * np.uint64(64) + (points[start].astype(np.uint64) & np.uint64(63)) + np.uint64(9)), word)
    lines = np.zeros(n + 1, np.int32)
    np.cumsum(kind == LINE, out=lines[1:])
    row = np.searchsorted(offsets, start, "right") - 1
    before = np.append(0, end[:-1]) if len(start) else start
    new_line = np.ones(len(start), bool)
    new_line[1:] = (lines[start[1:]] > lines[before[1:]]) | (row[1:] != row[:-1])
    gap = np.where(new_line, 2, np.where(start > before, 1, 0))
    return {"start": start, "end": end, "row": row, "word": word, "shape": shape.astype(np.uint64), "gap": gap.astype(np.uint64), "new_line": new_line}


def features(t: dict[str, np.ndarray]) -> np.ndarray:
    """Buckets of the features of each token: its word, its shape, and those around it; nothing is seen across rows."""
    word, shape, gap, row = t["word"], t["shape"], t["gap"], t["row"]
    n = len(word)
    nothing = np.uint64(0x5BD1E995)

    def near(x: np.ndarray, by: int) -> np.ndarray:
        out = np.full(n, nothing)
        if by < 0:
            out[-by:] = np.where(row[-by:] == row[:by], x[:by], nothing)
        else:
            out[: n - by] = np.where(row[by:] == row[: n - by], x[by:], nothing)
        return out

    if n < 4:  # shifts need more tokens than they move
        pad = 4 - n
        padded = {"word": np.append(word, np.zeros(pad, np.uint64)), "shape": np.append(shape, np.zeros(pad, np.uint64)), "gap": np.append(gap, np.zeros(pad, np.uint64)), "row": np.append(row, np.full(pad, -1))}
        return features(padded)[:n]
    w1, w2, v1, v2 = near(word, -1), near(word, -2), near(word, 1), near(word, 2)
    s1, s2, u1, u2 = near(shape, -1), near(shape, -2), near(shape, 1), near(shape, 2)
    g1 = near(gap, 1)
    with np.errstate(over="ignore"):
        at = shape * np.uint64(4) + gap
        around = [
            (1, word), (2, at), (3, w1), (4, v1), (5, w2 * np.uint64(31) + w1), (6, v1 * np.uint64(31) + v2),
            (7, s1 * np.uint64(0x10001) + at), (8, at * np.uint64(0x10001) + u1 * np.uint64(4) + g1), (9, ((s2 * np.uint64(0x10001) + s1) * np.uint64(0x10001) + at) * np.uint64(0x10001) + u1),
            (10, w1 * np.uint64(7) + at), (11, v1 * np.uint64(7) + at), (12, (at * np.uint64(0x10001) + u1) * np.uint64(0x10001) + u2), (13, w2 * np.uint64(7) + at), (14, near(word, -3) * np.uint64(7) + at),
        ]
        out = np.empty((n, len(around)), np.int32)
        for k, (salt, x) in enumerate(around):
            out[:, k] = (mixed(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
    return out


_LABEL = re.compile(r"⟦(\w+)\|([^⟧]*)⟧")


def labelled(lines: list[str]) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Texts and their items from lines with items written ``⟦type|text⟧``."""
    texts, items = [], []
    for line in lines:
        line = line.replace("\\n", "\n").replace("\\\\", "\\")
        out, spans, last, at = [], [], 0, 0
        for m in _LABEL.finditer(line):
            out += line[last : m.start()], m.group(2)
            at += m.start() - last
            spans.append((at, at + len(m.group(2)), m.group(1)))
            at += len(m.group(2))
            last = m.end()
        texts.append("".join(out) + line[last:])
        items.append(spans)
    return texts, items


@functools.cache
def model() -> Chain:
    """The chain trained from the labelled table; a few seconds, once per driver."""
    lines = LABELLED.read_text(encoding="utf-8").splitlines()[:LABELLED_ROWS]
    return fitted(lines)


def fitted(lines: list[str], epochs: int = 12) -> Chain:
    texts, items = labelled(lines)
    all_features, gold, offsets = [], [], [0]
    for first, _, points, cuts in blocks(pa.array(texts)):
        t = tokens(points, cuts)
        label = np.zeros(len(t["start"]), np.int64)
        for r in range(len(cuts) - 1):
            for s, e, kind in items[first + r]:
                inside = (t["start"] < cuts[r] + e) & (t["end"] > cuts[r] + s)
                at = np.flatnonzero(inside)
                if len(at):
                    label[at] = LABELS.index(f"I-{kind}")
                    label[at[0]] = LABELS.index(f"B-{kind}")
        all_features.append(features(t))
        gold.append(label)
        offsets += (offsets[-1] + np.searchsorted(t["row"], np.arange(1, len(cuts)), "left")).tolist()
    return trained(np.concatenate(all_features), np.concatenate(gold), np.array(offsets), LABELS, 1 << FEATURE_BITS, epochs)


# The exact forms of the types; an e-mail address is a local part, a sign and a domain.
_AT = re.compile(r"\s?[@＠]\s?|\s?\((?:at|AT)\)\s?|\s?\[(?:at|AT)\]\s?|\s?\{(?:at|AT)\}\s?")
_LOCAL = re.compile(r"[\w.+-]")
_DOMAIN = re.compile(r"[\w-]+(?:(?:\.|\s?\[(?:dot|DOT)\]\s?|\s?\((?:dot|DOT)\)\s?)[\w-]+)+")
FORMS = {
    "phone": re.compile(r"(?<![\w.])(?:\(\+?\d{2,4}\)[ .-]?|\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?|00\d{2}[ .-]?|0|(?=\d{3}[.-]\d{3}[.-]\d{4}))\d[\d .-]{5,14}\d(?!\w)"),
    "id_number": re.compile(r"(?<![\w.])(?:[A-Z]{1,2}\d{6,8}|\d{12}|\d{9}|\d{4} \d{4} \d{4}|\d{3}[. ]\d{3}[. ]\d{3}(?:[. ]\d{3})?)(?!\w)"),
    "person_name": re.compile(r"[^\W\d_][\w'’-]*(?:[ \xa0]+[^\W\d_][\w'’-]*){1,5}"),
    "address": re.compile(r"\d[^\n]*[^\W_]"),
}
#: Phone and identity numbers are shorter than this, so that all that touch a span lie within this distance of it.
NUMBER_CHARS = 40
_JOINTS = frozenset("@＠()[]{}")


def _address_run(text: str, start: int, end: int) -> tuple[int, int]:
    """The run of characters around a span that an e-mail address could fill: a blank is part of it only beside a sign."""
    goes_on = lambda i: not text[i].isspace() or (0 < i < len(text) - 1 and (text[i - 1] in _JOINTS or text[i + 1] in _JOINTS) and text[i] != "\n")
    while start > 0 and goes_on(start - 1):
        start -= 1
    while end < len(text) and goes_on(end):
        end += 1
    return start, end


def _addresses(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """E-mail addresses in a run, in order, in time linear in its length."""
    last = start
    for at in _AT.finditer(text, start, end):
        domain = _DOMAIN.match(text, at.end(), end)
        begin = at.start()
        while begin > last and _LOCAL.match(text[begin - 1]):
            begin -= 1
        if domain and begin < at.start():
            yield begin, domain.end()
            last = domain.end()


def exact(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The exact item of a type that a marked span stands for, or None. Items of any length are found to their ends."""
    if kind in ("email", "phone", "id_number"):
        if kind == "email":
            items = _addresses(text, *_address_run(text, start, end))
        else:
            low, high = max(text.rfind("\n", 0, start) + 1, start - NUMBER_CHARS), min(end + NUMBER_CHARS, len(text))
            items = (m.span() for m in FORMS[kind].finditer(text, low, high))
        best = None
        for s, e in items:
            overlap = min(e, end) - max(s, start)
            if overlap > 0 and (best is None or overlap > best[0]):
                best = (overlap, s, e)
        if best is None or best[0] * 2 < min(end - start, best[2] - best[1]):
            return None
        if kind == "phone" and not 8 <= sum(c.isdigit() for c in text[best[1] : best[2]]) <= 15:
            return None
        return best[1], best[2]
    m = FORMS[kind].search(text, start, end)
    if not m:
        return None
    if kind == "person_name":
        words = m.group().split()
        if len(words) < 2 or not all(w[0].isupper() for w in words):
            return None
    elif not any(c.isalpha() for c in m.group()) or not re.search(r"[^\W\d_]{2}", m.group()):
        return None
    return m.start(), m.end()


def _windows(chain: Chain, feature: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens to decode and the offsets of the windows they make."""
    n = len(feature)
    over = (chain.weights[:, 1:].max(1) - chain.weights[:, 0]).astype(np.float32)
    margin = np.zeros(n, np.float32)
    for k in range(feature.shape[1]):
        margin += over[feature[:, k]]
    hot = np.flatnonzero(margin > -MARGIN)  # the bound is loose; the scores themselves decide among these
    score = chain.emissions(feature[hot])
    hot = hot[score[:, 1:].max(1) - score[:, 0] > -MARGIN] if len(hot) else hot
    if not len(hot):
        return hot, np.zeros(1, np.int64)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.maximum(hot - REACH, 0), 1)
    np.add.at(change, np.minimum(hot + REACH + 1, n), -1)
    taken = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    cut = np.ones(len(taken), bool)
    cut[1:] = (np.diff(taken) > 1) | (t["row"][taken[1:]] != t["row"][taken[:-1]])
    return taken, np.append(np.flatnonzero(cut), len(taken))


def items_of(chain: Chain, points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
    """(row, start, end, type) of the spans that the chain marks, in characters of the row."""
    t = tokens(points, offsets)
    if not len(t["start"]):
        return
    feature = features(t)
    taken, cuts = _windows(chain, feature, t)
    if not len(taken):
        return
    label = chain.decode(chain.emissions(feature[taken]), cuts)
    marked = np.flatnonzero(label > 0)
    kind = (label[marked] - 1) // 2
    begins = np.ones(len(marked), bool)
    if len(marked) > 1:
        window = np.searchsorted(cuts, marked, "right")
        begins[1:] = (np.diff(marked) > 1) | (kind[1:] != kind[:-1]) | (label[marked[1:]] % 2 == 1) | (window[1:] != window[:-1])
    firsts = np.flatnonzero(begins)
    lasts = np.append(firsts[1:], len(marked)) - 1
    for a, b in zip(firsts.tolist(), lasts.tolist()):
        x, y = taken[marked[a]], taken[marked[b]]
        row = int(t["row"][x])
        yield row, int(t["start"][x] - offsets[row]), int(t["end"][y] - offsets[row]), TYPES[int(kind[a])]


def spans(chain: Chain, column: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int, str]]]]:
    """(row, text, items) of each row with items; they don't overlap and are in order."""
    for first, _, points, offsets in blocks(column, BLOCK_CHARS):
        found: dict[int, list[tuple[int, int, str]]] = {}
        for row, s, e, kind in items_of(chain, points, offsets):
            found.setdefault(row, []).append((s, e, kind))
        for row, marked in found.items():
            text = column[first + row].as_py()
            out, last = [], 0
            for s, e, kind in marked:
                got = exact(text, s, e, kind) if e > last else None  # what an item before holds is part of it
                if got and got[0] >= last:
                    out.append((*got, kind))
                    last = got[1]
            if out:
                yield first + row, text, out


def finder(shared):
    """For ``mapInArrow`` over (doc_id, text): the distinct items of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for row, text, items in spans(shared.value, batch.column("text")):
                key = ids[row].as_py()
                rows += [(key, kind, piece) for kind, piece in dict.fromkeys((k, text[s:e]) for s, e, k in items)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "pii_type", "pii_text"])

    return run


def masker(shared):
    """For ``mapInArrow`` over (doc_id, text): texts with ``[TYPE]`` in the place of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [0] * len(texts)
            for row, text, items in spans(shared.value, batch.column("text")):
                out, last = [], 0
                for s, e, kind in items:
                    out += text[last:s], f"[{kind.upper()}]"
                    last = e
                texts[row], counts[row] = "".join(out) + text[last:], len(items)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "replaced"])

    return run


def _shared(df: DataFrame):
    return df.sparkSession.sparkContext.broadcast(model())


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, pii_text): each distinct item of each document, as it stands in the text.

    Null and empty texts have none; texts of any length are read whole; repeated documents repeat their items; an empty
    table gives none; further columns are ignored. The model is about 3 MB and the only thing broadcast.
    """
    docs = documents.select("doc_id", "text")
    return docs.mapInArrow(finder(_shared(documents)), "doc_id bigint, pii_type string, pii_text string")


def masked(documents: DataFrame) -> DataFrame:
    """(doc_id, text, replaced): every document with its items replaced by typed placeholders, and their number."""
    docs = documents.select("doc_id", "text")
    return docs.mapInArrow(masker(_shared(documents)), "doc_id bigint, text string, replaced int")
