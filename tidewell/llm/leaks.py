"""Evaluation texts leaking into training text (problem 8), by greedy string tiling.

Words are folded (case, diacritics, signs and mark-up don't count) and hashed; runs of five words give seeds by a rolling
hash. Seeds shared by a document and a test item are joined; for each pair that shares enough of them, the longest match
is marked, then the next longest in what is left, and so on. A passage in another order still gets covered piece by piece,
so that coverage of the item tells what the longest piece alone doesn't.
"""

from __future__ import annotations

import heapq
import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.textblocks import CodeTable, blocks, mixed
from tidewell.operators.joins import join_salted
from tidewell.session import stage

#: Words of a seed, which is also the shortest tile.
SEED_WORDS = 5
#: Words in a row that make a leak.
LEAK_WORDS = 13
#: Share of an item that, in tiles of any order, also makes a leak in ``leaks``.
LEAK_COVERAGE = 0.5
#: Up to so many seeds the items go to every task (about 100 MB); more are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>@]*)?/?>|&(?:nbsp|amp|lt|gt|quot|#\d{1,6});")
_IN_WORD, _IN_SEED = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xD1342543DE82EF95)


class Letters(CodeTable):
    """Letters and digits by their base letter; marks and characters without width are skipped."""

    def __init__(self) -> None:
        super().__init__(kind=np.uint8, weight=np.uint64)

    def fill(self, code: int) -> None:
        char = chr(code)
        category = unicodedata.category(char)
        if category[0] in "LN":
            base = "d" if char in "đĐ" else unicodedata.normalize("NFD", char)[0].casefold()[:1]
            self.kind[code] = 2
            self.weight[code] = mixed(np.array([ord(base)], np.uint64))[0]
        elif category[0] == "M" or category == "Cf":
            self.kind[code] = 1


_LETTERS: Letters | None = None
_POWERS = np.ones(1, np.uint64)


def _powers(most: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) <= most:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([_POWERS, _POWERS * (_IN_WORD ** np.uint64(len(_POWERS)))])
    return _POWERS


def word_hashes(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and the offsets of the rows among the words."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = Letters()
    _LETTERS.learn(points)
    kind = _LETTERS.kind[points]
    if (kind == 1).any():
        keep = kind != 1
        before = np.zeros(len(points) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        points, kind, offsets = points[keep], kind[keep], before[offsets]
    letter = kind == 2
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    first = offsets[:-1][offsets[:-1] < len(points)]
    opens[first] = letter[first]  # a row begins a word of its own
    words = np.zeros(len(points) + 1, np.int64)
    np.cumsum(opens, out=words[1:])
    at = np.flatnonzero(letter)
    starts = np.flatnonzero(opens[at])
    if not len(starts):
        return np.zeros(0, np.uint64), words[offsets]
    position = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    with np.errstate(over="ignore"):
        value = _LETTERS.weight[points[at]] * _powers(int(position.max()))[position]
        return mixed(np.add.reduceat(value, starts)), words[offsets]


def seed_hashes(words: np.ndarray) -> np.ndarray:
    """The rolling hash of every SEED_WORDS words; windows may cross rows."""
    n = len(words) - SEED_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SEED_WORDS):
            out *= _IN_SEED
            out += words[j : j + n]
    return out


def without_markup(column: pa.Array) -> pa.Array:
    """Texts with tags and entities blanked; only rows that have some are rewritten."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    marked = pc.fill_null(pc.match_substring_regex(column, "<[/A-Za-z]|&[#a-z]"), False)
    if not pc.any(marked).as_py():
        return column
    rows = column.to_pylist()
    for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
        rows[i] = _TAG.sub(" ", rows[i])
    return pa.array(rows, column.type)


@dataclass
class Items:
    """The test items: their words, and their seeds in order of hash."""

    ids: np.ndarray
    words: np.ndarray
    offsets: np.ndarray
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray
    mask: np.ndarray

    @classmethod
    def of(cls, ids: list[int], passages: list[str]) -> Items:
        words, offsets = [np.zeros(0, np.uint64)], [0]
        for _, _, points, cuts in blocks(without_markup(pa.array(passages, pa.string()))):
            w, o = word_hashes(points, cuts)
            offsets += (o[1:] + offsets[-1]).tolist()
            words.append(w)
        all_words, offset = np.concatenate(words), np.array(offsets)
        seeds = seed_hashes(all_words)
        item = np.searchsorted(offset, np.arange(len(seeds)), "right") - 1
        whole = np.arange(len(seeds)) + SEED_WORDS <= offset[item + 1] if len(seeds) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        order = at[np.argsort(seeds[at], kind="stable")]
        mask = np.zeros(1 << 22, bool)
        mask[(seeds[order] & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        return cls(np.array(ids, np.int64), all_words, offset, seeds[order], item[order], order - offset[item[order]], mask)


def least_shared(item_words: int) -> int:
    """Seeds that a pair must share at least to be a leak by either measure."""
    return max(1, min(LEAK_WORDS - SEED_WORDS + 1, int(np.ceil(LEAK_COVERAGE * item_words / SEED_WORDS))))


def tiles(doc_at: np.ndarray, item_at: np.ndarray, item_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of one pair from its shared seeds: (start in doc, start in item, words), the longest first.

    Seeds that follow each other in both texts make a match. Ties go to the earlier place in the item, then in the document.
    """
    diagonal = doc_at - item_at
    order = np.lexsort((doc_at, diagonal))
    d, diagonal = doc_at[order], diagonal[order]
    cuts = np.flatnonzero((np.diff(d) != 1) | (np.diff(diagonal) != 0)) + 1
    heap = []
    for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(d)).tolist()):
        heap.append((-(b - a + SEED_WORDS - 1), int(d[a] - diagonal[a]), int(d[a])))
    heapq.heapify(heap)
    used_doc: set[int] = set()
    used_item = np.zeros(item_words, bool)
    out = []
    while heap:
        minus, i, s = heapq.heappop(heap)
        free = [k for k in range(-minus) if not used_item[i + k] and s + k not in used_doc]
        if len(free) == -minus:
            out.append((s, i, -minus))
            used_item[i : i - minus] = True
            used_doc.update(range(s, s - minus))
            continue
        begin = 0
        for k in range(1, len(free) + 1):  # what is left of a match that overlaps a longer one
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - begin >= SEED_WORDS:
                    heapq.heappush(heap, (-(k - begin), i + free[begin], s + free[begin]))
                begin = k
    return out


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("longest", pa.int32()), ("covered", pa.int32()), ("item_words", pa.int32())])
FOUND = "doc_id bigint, item_id bigint, longest int, covered int, item_words int"


def tiling(shared):
    """The function for ``mapInArrow`` over (doc_id, text): pairs that share enough seeds, tiled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        item_words = np.diff(items.offsets)
        least = np.array([least_shared(int(n)) for n in item_words])
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for first, _, points, cuts in blocks(without_markup(batch.column("text"))):
                words, offsets = word_hashes(points, cuts)
                seeds = seed_hashes(words)
                hit = np.flatnonzero(items.mask[(seeds & np.uint64((1 << 22) - 1)).astype(np.int64)])
                low, high = np.searchsorted(items.seeds, seeds[hit], "left"), np.searchsorted(items.seeds, seeds[hit], "right")
                hit, low, high = (x[high > low] for x in (hit, low, high))
                row, inside = _row_of(hit, offsets)
                hit, low, high, row = (x[inside] for x in (hit, low, high, row))
                many = high - low
                at = np.repeat(hit - offsets[row], many)
                row = np.repeat(row, many)
                entry = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                item, item_at = items.seed_item[entry], items.seed_at[entry]
                # the words of a seed are compared too, not only its rolling hash
                same = np.ones(len(row), bool)
                for k in range(SEED_WORDS):
                    same &= words[offsets[row] + at + k] == items.words[items.offsets[item] + item_at + k]
                row, at, item, item_at = (x[same] for x in (row, at, item, item_at))
                pair = row * len(items.ids) + item
                order = np.argsort(pair, kind="stable")
                cuts2 = np.flatnonzero(np.diff(pair[order])) + 1
                for a, b in zip(np.append(0, cuts2).tolist(), np.append(cuts2, len(order)).tolist()):
                    k = order[a:b]
                    if not len(k) or len(k) < least[item[k[0]]]:
                        continue
                    r, i = int(row[k[0]]), int(item[k[0]])
                    found = tiles(at[k], item_at[k], int(item_words[i]))
                    if found:
                        out.append((ids[first + r].as_py(), int(items.ids[i]), found[0][2], sum(n for _, _, n in found), int(item_words[i])))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(_FOUND.types)], schema=_FOUND)

    return run


#: Seeds of the items in a bit mask of fixed size, by which documents leave their other seeds out before the shuffle.
MASK_BITS = 1 << 26


def _row_of(at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each seed, and whether all words of the seed are in it."""
    row = np.searchsorted(offsets, at, "right") - 1
    return row, at + SEED_WORDS <= offsets[row + 1] if len(at) else np.zeros(0, bool)


def _seed_rows(mask=None):
    """For ``mapInArrow`` over (id, text): a row (id, row, words, seed, check, at) for every seed whose bit is in the mask.

    ``row`` tells rows with the same id apart; ``check`` is a second hash of the seed's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(mask.value, np.uint8) if mask else None
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, points, cuts in blocks(without_markup(batch.column(1))):
                words, offsets = word_hashes(points, cuts)
                seeds, check = seed_hashes(words), seed_hashes(mixed(words))
                at = np.arange(len(seeds))
                if bits is not None:
                    bit = (seeds % np.uint64(MASK_BITS)).astype(np.int64)
                    at = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                row, inside = _row_of(at, offsets)
                at, row = at[inside], row[inside]
                columns = (ids[first + row], number + row, np.diff(offsets)[row].astype(np.int32), seeds[at].view(np.int64), check[at].view(np.int64), (at - offsets[row]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "row", "words", "seed", "check", "at"])
                number += last - first

    return run


_SEEDS = "id bigint, row bigint, words int, seed bigint, check bigint, at int"


def _mask(item_seeds: DataFrame) -> bytes:
    """The bit mask of the items' seeds: 8 MB, however many there are."""
    bit = F.col("seed").bitwiseAND(MASK_BITS - 1) + 1
    parts = item_seeds.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(MASK_BITS // 8, np.uint8)
    for part, bits in parts.toLocalIterator():
        out[(part - 1) * len(bits) : part * len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return out.tobytes()


def _tile_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tile pairs whose shared seeds (doc_id, row, item_id, item_row, item_words, at, item_at) come one behind the other."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        table = pa.Table.from_batches([b for b in (rest, batch) if b is not None]).combine_chunks() if rest is not None or batch is not None else None
        if table is None or not table.num_rows:
            continue
        row, item, item_row, doc, words, at, item_at = (table.column(c).to_numpy() for c in ("row", "item_id", "item_row", "doc_id", "item_words", "at", "item_at"))
        cuts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item_row[1:] != item_row[:-1])))
        ends = np.append(cuts[1:], len(row))
        if batch is not None:  # the last pair may go on in the next batch
            rest = table.slice(int(cuts[-1])).combine_chunks().to_batches()[0]
            cuts, ends = cuts[:-1], ends[:-1]
        out = []
        for a, b in zip(cuts.tolist(), ends.tolist()):
            if b - a >= least_shared(int(words[a])):
                found = tiles(at[a:b], item_at[a:b], int(words[a]))
                out.append((int(doc[a]), int(item[a]), found[0][2], sum(n for _, _, n in found), int(words[a])))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(_FOUND.types)], schema=_FOUND)


def tiled(documents: DataFrame, passages: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, longest, covered, item_words) for pairs that share enough seeds to be a leak.

    ``longest`` is the longest tile in words, ``covered`` the words of all tiles of five words or more. Null and empty texts
    and items of less than five words give nothing; texts of any length are tiled whole; repeated documents give a row
    each, and so do different passages with the same item_id; empty tables give no rows; further columns are ignored.

    With more than ``broadcast_seeds`` seeds the items don't go to every task, with the same result: documents send the
    seeds in the items' mask through a join, in which frequent ones are split, and pairs are tiled from their shared
    seeds. No text is shuffled.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    items = passages.select("item_id", "passage").where("passage IS NOT NULL AND item_id IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0] // 2  # at most a word for two characters
    if size <= broadcast_seeds:
        rows = items.orderBy("item_id", "passage").toArrow()
        shared = spark.sparkContext.broadcast(Items.of(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
        return docs.mapInArrow(tiling(shared), FOUND)
    item_seeds = stage(items.mapInArrow(_seed_rows(), _SEEDS), "item-seeds").select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("words").alias("item_words"), "seed", "check", F.col("at").alias("item_at"))
    mask = spark.sparkContext.broadcast(_mask(item_seeds))
    seeds = stage(docs.mapInArrow(_seed_rows(mask), _SEEDS), "seeds").select(F.col("id").alias("doc_id"), "row", "seed", "check", "at")
    met = join_salted(seeds, item_seeds, ["seed", "check"], "row")
    pairs = met.select("doc_id", "row", "item_id", "item_row", "item_words", "at", "item_at").repartition("row", "item_row").sortWithinPartitions("row", "item_row")
    return pairs.mapInArrow(_tile_sorted, FOUND)


def found(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold LEAK_WORDS consecutive words or more of an item."""
    return tiled(documents, passages).where(F.col("longest") >= LEAK_WORDS).select("doc_id", "item_id").distinct()


def leaks(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Every leak, by the longest piece or by coverage in any order: (doc_id, item_id, longest, covered, coverage)."""
    rows = tiled(documents, passages).withColumn("coverage", F.round(F.col("covered") / F.col("item_words"), 4))
    return rows.where((F.col("longest") >= LEAK_WORDS) | (F.col("coverage") >= LEAK_COVERAGE)).drop("item_words")
