"""Filling fixed-capacity containers with items (problem 7), by minimum bin slack.

Only the lengths of items matter for packing, and there are no more different lengths than the capacity. So lengths are
counted over all documents, and tasks find the fullest containers from the counts: each takes the longest length left
and, by a bitset subset-sum over the other available lengths, the combination that leaves the least room; that combination
is used as often as the counts allow, which uses up one length at least. A task gets ``SHARD_LENGTHS`` lengths at most; what
it can't combine without room left is shared out again in the next round. The combinations go back to the documents, where
each finds its container by its rank among those of its length.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import stage

#: Windows are a short list, read by the driver; more rows than this are refused.
MOST_WINDOWS = 1_000
#: Items ranked by one task.
RANKED_ROWS = 400_000
#: Lengths that one task combines.
SHARD_LENGTHS = 4_096
#: Rows of the plan (about 40 bytes each) that are broadcast; a larger plan is joined by blocks of ranks.
BROADCAST_ROWS, RANK_BLOCK = 2_000_000, 64


def tokenizer_folder() -> str:
    """The folder of the public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"


@functools.cache
def _encoding(folder: str, name: str):
    import tiktoken

    ranks = {}
    with open(f"{folder}/{name}", "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    # Fixed value: the pattern that parts a text before its pieces are encoded.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, folder: str | None = None, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, tokens): the length of each text in tokens of a public tokenizer; 0 for null and empty texts."""
    folder = folder or tokenizer_folder()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(folder, name).encode_ordinary
        for batch in batches:
            sizes = [len(encode(text)) if text else 0 for text in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32())], names=["doc_id", "tokens"])

    return documents.select("doc_id", "text").mapInArrow(count, "doc_id bigint, tokens int")


@dataclass
class _Filler:
    """Lengths still to be packed, longest first."""

    counts: dict[int, int]

    def fullest(self, room: int) -> dict[int, int]:
        """The combination of available lengths with the largest sum up to ``room``."""
        bits, mask, steps = 1, (1 << (room + 1)) - 1, []
        for length, count in self.counts.items():
            if length > room:
                continue
            many, part = min(count, room // length), 1
            while many > 0:  # a length several times, by doubling
                times = min(part, many)
                new = (bits | (bits << (length * times))) & mask
                if new != bits:
                    steps.append((length, times, bits))
                    bits = new
                many -= times
                part *= 2
            if bits >> room & 1:
                break
        at, used = bits.bit_length() - 1, {}
        for length, times, before in reversed(steps):
            if not before >> at & 1:
                used[length] = used.get(length, 0) + times
                at -= length * times
        return used

    def combinations(self, capacity: int) -> Iterator[tuple[dict[int, int], int]]:
        """Combinations and how often each is used, until nothing is left."""
        while self.counts:
            longest = next(iter(self.counts))
            self.counts[longest] -= 1
            used = self.fullest(capacity - longest)
            self.counts[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            times = min(self.counts[length] // n for length, n in used.items())
            for length, n in used.items():
                self.counts[length] -= n * times
                if not self.counts[length]:
                    del self.counts[length]
            yield used, times


_COMBINATIONS = "window_name string, shard int, combination int, times bigint, room int, lengths array<int>, each array<int>"


def _solver():
    """For ``applyInPandas`` over one shard of lengths: its combinations, how often each is used and the room it leaves."""

    def solve(shard: pd.DataFrame) -> pd.DataFrame:
        capacity = int(shard["capacity"].iloc[0])
        filler = _Filler(dict(sorted(zip(shard["length"].tolist(), shard["n"].tolist()), reverse=True)))
        rows = [(n, times, capacity - sum(k * v for k, v in used.items()), list(used), list(used.values())) for n, (used, times) in enumerate(filler.combinations(capacity))]
        out = pd.DataFrame(rows, columns=["combination", "times", "room", "lengths", "each"])
        out.insert(0, "shard", int(shard["shard"].iloc[0]))
        out.insert(0, "window_name", shard["window_name"].iloc[0])
        return out

    return solve


def combined(lengths: DataFrame, shard_lengths: int = SHARD_LENGTHS) -> DataFrame:
    """The plan for (window_name, capacity, length, n): (window_name, length, first, each, times, container).

    The items of ``length`` from rank ``first`` on go ``each`` by ``each`` into the ``times`` containers from ``container``
    on. Each window's lengths are dealt to shards of at most ``shard_lengths``. Combinations without room left are kept;
    the others are dealt anew with the next round, until one shard holds all or a round keeps less than half of them, when
    all are kept. So no task has more lengths than a shard, and there are no more combinations than lengths in a round.
    """
    left, rounds, last = lengths, [], False
    capacities = lengths.groupBy("window_name").agg(F.max("capacity").alias("capacity"))
    while True:
        order = Window.partitionBy("window_name").orderBy("length")
        most = left.groupBy("window_name").agg(F.count("*").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
        last = last or most[0] <= shard_lengths
        # neighbours in length go to different shards, so that each has lengths of all sizes
        many = F.ceil(F.count("*").over(Window.partitionBy("window_name")) / shard_lengths)
        dealt = left.withColumn("shard", ((F.row_number().over(order) - 1) % many).cast("int"))
        solved = stage(dealt.groupBy("window_name", "shard").applyInPandas(_solver(), _COMBINATIONS), "combinations")
        rounds.append((solved if last else solved.where("room = 0")).withColumn("round", F.lit(len(rounds))))
        if last:
            break
        again = solved.where("room > 0").select("window_name", "times", F.inline(F.arrays_zip(F.col("lengths").alias("length"), F.col("each").alias("each"))))
        again = again.groupBy("window_name", "length").agg(F.sum(F.col("times") * F.col("each")).alias("n"))
        left = stage(again.join(F.broadcast(capacities), "window_name"), "lengths")
        last = left.count() * 2 > most[1]
    plan = functools.reduce(DataFrame.unionAll, rounds)
    before = lambda *keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("times").over(before("window_name", order=("round", "shard", "combination"))), F.lit(0))
    rows = plan.withColumn("container", start).select("window_name", "times", "container", F.inline(F.arrays_zip(F.col("lengths").alias("length"), F.col("each").alias("each"))))
    first = F.coalesce(F.sum(F.col("times") * F.col("each")).over(before("window_name", "length", order=("container",))), F.lit(0))
    return rows.select("window_name", "length", first.alias("first"), F.col("each").cast("bigint").alias("each"), "times", "container")


def placed_by_broadcast(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """``ranked`` with the container of each row, by bisection in the plan, which every task gets."""
    shared = ranked.sparkSession.sparkContext.broadcast({n: _lookup(g) for n, g in plan.toArrow().to_pandas().groupby("window_name")})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.to_pandas()
            out["container"] = 0
            for window_name, at in out.groupby("window_name").groups.items():
                lengths, base, key, first, each, container = shared.value[window_name]
                rank = out.loc[at, "rank"].to_numpy(np.int64)
                row = np.searchsorted(key, base[np.searchsorted(lengths, out.loc[at, "tokens"].to_numpy())] + rank, "right") - 1
                out.loc[at, "container"] = container[row] + (rank - first[row]) // each[row] + 1
            yield pa.RecordBatch.from_pandas(out[_PLACED.names], schema=_PLACED, preserve_index=False)

    return ranked.mapInArrow(place, "window_name string, container bigint, doc_id bigint, piece int, first_token int, tokens int")


def placed_by_blocks(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """The same by a join: the plan's rows stand in every block of ranks that they reach, so that a row meets few of them."""
    block = lambda c: F.floor(c / RANK_BLOCK)
    end = F.col("first") + F.col("each") * F.col("times")
    reach = plan.select("window_name", F.col("length").alias("tokens"), "first", end.alias("end"), "each", "container", F.explode(F.sequence(block(F.col("first")), block(end - 1))).alias("block"))
    met = ranked.withColumn("block", block(F.col("rank"))).join(reach, ["window_name", "tokens", "block"]).where("rank >= first AND rank < end")
    return met.select("window_name", (F.col("container") + F.floor((F.col("rank") - F.col("first")) / F.col("each")) + 1).cast("bigint").alias("container"), "doc_id", "piece", "first_token", "tokens")


def pieces(counts: DataFrame, windows: list[tuple[str, int]]) -> DataFrame:
    """(window_name, capacity, doc_id, piece, first_token, tokens): whole texts, or for longer ones the parts of window size and the rest."""
    each = F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).alias("capacity")) for n, c in windows])
    rows = counts.select("doc_id", F.col("tokens").alias("all"), F.inline(each))
    last = F.greatest(F.ceil(F.col("all") / F.col("capacity")).cast("int") - 1, F.lit(0))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece") * F.col("capacity")
    return rows.select("window_name", "capacity", "doc_id", "piece", first.alias("first_token"), F.least(F.col("all") - first, F.col("capacity")).alias("tokens"))


def packed(documents: DataFrame, windows: DataFrame, folder: str | None = None, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(window_name, container, doc_id, piece, first_token, tokens): every text in a container of each window.

    Texts longer than a window are split into full windows, alone in their containers, and a rest that is packed like any
    other item; no other text is split. Null and empty texts have no tokens and are kept in container 0, which holds
    nothing else. Texts of equal length are placed in the order of doc_id; a repeated doc_id is packed as often as it
    stands. Windows without a positive capacity are refused. Empty tables give no rows; further columns are ignored.
    """
    rows = windows.select("window_name", "capacity_tokens").distinct().limit(MOST_WINDOWS + 1).collect()
    if len(rows) > MOST_WINDOWS or len({r[0] for r in rows}) < len(rows) or any(r[0] is None or not r[1] or r[1] < 1 for r in rows):
        raise ValueError(f"at most {MOST_WINDOWS} windows, each with a name of its own and a positive capacity")
    sizes = sorted((r[0], int(r[1])) for r in rows)
    if not sizes:
        return documents.sparkSession.createDataFrame([], "window_name string, container bigint, doc_id bigint, piece int, first_token int, tokens int")
    counts = stage(token_counts(documents, folder, name), "tokens")
    items = pieces(counts, sizes)
    partial = items.where("tokens < capacity AND tokens > 0")
    lengths = stage(partial.groupBy("window_name", "capacity", F.col("tokens").alias("length")).agg(F.count("*").alias("n")), "lengths")
    total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    plan = stage(combined(lengths), "plan")
    summary = plan.groupBy("window_name").agg(F.max(F.col("container") + F.col("times")).alias("used"), F.count("*").alias("n")).collect()  # a row a window
    used = {r["window_name"]: r["used"] for r in summary}

    buckets = max(1, -(-total // RANKED_ROWS))
    of_length = partial.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    in_bucket = Window.partitionBy("window_name", "tokens", "bucket").orderBy("doc_id", "piece")
    before = Window.partitionBy("window_name", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_length.groupBy("window_name", "tokens", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = of_length.withColumn("in_bucket", F.row_number().over(in_bucket) - 1).join(offsets, ["window_name", "tokens", "bucket"])
    ranked = ranked.select("window_name", "doc_id", "piece", "first_token", "tokens", (F.col("in_bucket") + F.col("before")).alias("rank"))
    place = placed_by_broadcast if sum(r["n"] for r in summary) <= BROADCAST_ROWS else placed_by_blocks
    placed = place(ranked, plan)

    full = items.where("tokens = capacity")
    base = F.create_map(*[F.lit(x) for n, _ in sizes for x in (n, int(used.get(n, 0)))])
    alone = full.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(buckets, 8))).cast("int"))
    each_bucket = Window.partitionBy("window_name", "bucket").orderBy("doc_id", "piece")
    ahead = Window.partitionBy("window_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    full_offsets = alone.groupBy("window_name", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    alone = alone.withColumn("in_bucket", F.row_number().over(each_bucket)).join(full_offsets, ["window_name", "bucket"])
    alone = alone.select("window_name", (F.element_at(base, F.col("window_name")) + F.col("in_bucket") + F.col("before")).cast("bigint").alias("container"), "doc_id", "piece", "first_token", "tokens")
    empty = items.where("tokens = 0").select("window_name", F.lit(0).cast("bigint").alias("container"), "doc_id", "piece", "first_token", "tokens")
    return placed.unionAll(alone).unionAll(empty)


_PLACED = pa.schema([("window_name", pa.string()), ("container", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("first_token", pa.int32()), ("tokens", pa.int32())])


def _lookup(group: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Arrays to find the combination of a length and rank by bisection: ranks go on from one length to the next."""
    ordered = group.sort_values(["length", "first"])
    first, each, container = (ordered[c].to_numpy(np.int64) for c in ("first", "each", "container"))
    lengths, begins = np.unique(ordered["length"].to_numpy(np.int64), return_index=True)
    items = np.add.reduceat(each * ordered["times"].to_numpy(np.int64), begins)
    base = np.cumsum(items) - items
    return lengths, base, np.repeat(base, np.diff(np.append(begins, len(first)))) + first, first, each, container


def fill_rates(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, capacity_tokens, containers, tokens, least, fill): how full the containers are.

    ``least`` is the number of containers that the tokens need at least.
    """
    sizes = windows.select("window_name", "capacity_tokens")
    used = rows.where("container > 0").groupBy("window_name", "container").agg(F.sum("tokens").alias("t"))
    out = used.groupBy("window_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens")).join(sizes, "window_name")
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return out.select("window_name", "capacity_tokens", "containers", "tokens", least.alias("least"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))
