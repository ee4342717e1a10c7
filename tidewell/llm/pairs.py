"""Broken prompt and response pairs (problem 4), by a conditional random field over the clauses of a response.

Each clause is tagged as answer, refusal, echo, foreign or unfinished; the features are its words, what it shares with the
question, the vocabulary it comes from, its place and its ending. How much of the response each tag covers then decides on
the pair's defect. Whether a response may end where it does is learned from all responses: how often its last two words
stand before a full stop there.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.crf import Chain, Features, trained
from tidewell.operators.joins import join_groups
from tidewell.session import stage

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Pairs of the labelled table; at most so many are used for training.
LABELLED = resources.files(__package__).joinpath("labelled_pairs.jsonl")
LABELLED_ROWS = 2_000
FEATURE_BITS = 15
# What stands in the place of an answer, and names of languages in questions.
PLACEHOLDERS = frozenset("null none nil nan n/a tbd todo trống (trống) rỗng (rỗng) [] {} - -- — – . .. ... … ? empty (empty) <empty> undefined".split())
ASKED = (("en", ("tiếng anh", "in english", "english")), ("vi", ("tiếng việt", "in vietnamese", "vietnamese")))
_WORD = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*")
_CLAUSE = re.compile(r"(?<=[.?!…。！？])[”\"')\]]*\s+|\n+|(?<=\?”)\s*[–—-]\s*|(?<=。)")
_END = re.compile(r"[.?!…。！？][”\"')\]\s]*(?:\[\d+\]\s*)*$|\[\d+\]\s*$")
_VIETNAMESE = re.compile("[ăâđêôơưàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ]")


def fold(text: str) -> str:
    """Lower case without diacritics."""
    low = text.lower().replace("đ", "d")
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


@functools.lru_cache(200_000)
def _word(word: str) -> tuple[str, int]:
    """A word folded, and how many of its letters are of another script than the Latin one."""
    return fold(word), sum(ord(c) > 0x2FF and unicodedata.category(c)[0] == "L" and not 0x1E00 <= ord(c) <= 0x1EFF for c in word)


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def visible(text: str) -> str:
    """``text`` without blanks and characters that show nothing."""
    return "".join(c for c in text if not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc", "Zs", "Zl", "Zp"))


def is_empty(answer: str | None) -> bool:
    """Null, nothing visible, or only a placeholder."""
    if answer is None:
        return True
    if len(list(itertools.islice(filter(str.isalnum, answer), 12))) == 12:  # no placeholder has so many letters
        return False
    seen = visible(answer)
    if not seen or seen.lower() in PLACEHOLDERS or fold(" ".join(answer.split())).strip(".()[]<>{} ") in ("", "null", "none", "n/a", "empty"):
        return True
    return not any(c.isalnum() for c in seen)


def clauses(answer: str) -> list[str]:
    return [c for c in (p.strip() for p in _CLAUSE.split(answer)) if c]


def language(text: str, vocabulary: Vocabulary) -> str:
    """vi, en or other, by script and by the share of words that each vocabulary has."""
    found = [w for w in words(text) if not w[0].isdigit()]
    if not found:
        return "none"
    known = [_word(w) for w in found]
    if sum(n for _, n in known) > 2:
        return "other"
    low = [w for w, _ in known]
    vi, en = (sum(w in v for w in low) / len(low) for v in (vocabulary.vi, vocabulary.en))
    if max(vi, en) < 0.4:
        return "vi" if len(_VIETNAMESE.findall(text.lower())) > 0.4 * len(found) else "other"
    return "vi" if vi >= en else "en"


@dataclass
class Vocabulary:
    """Folded words of the labelled table by language."""

    vi: frozenset[str]
    en: frozenset[str]


def target(question: str, vocabulary: Vocabulary) -> str:
    """The language that an answer may have besides the question's own: ``vi``, ``en``, or ``vi+en`` if one is asked for."""
    own = language(question, vocabulary)
    low = question.lower()
    asked = {code for code, names in ASKED if any(n in low for n in names)}
    return "+".join(sorted({own} | asked))


def tail(answer: str) -> str | None:
    """The last two words of a response that ends without a sign, with numbers made alike; None if it ends with one."""
    if _END.search(answer.strip()):
        return None
    last = words(answer)[-2:]
    return " ".join("9" if w[0].isdigit() else w.lower() for w in last) if last else None


def _bucket(x: float) -> int:
    return int(x * 5 + 0.5)


def clause_features(question: str, answer: str, ends: dict[str, tuple[int, int]], vocabulary: Vocabulary) -> tuple[list[str], list[list[int]]]:
    """The clauses of an answer, and the feature buckets of each, as many as it has words and pairs of words."""
    parts = clauses(answer)
    asked = [_word(w)[0] for w in words(question)]
    asked_set, allowed = set(asked), target(question, vocabulary)
    closed = _END.search(answer.strip()) is not None
    odd = any(answer.count(a) != answer.count(b) for a, b in ("()", "[]", "“”", "{}"))
    last = tail(answer)
    hits, total = ends.get(last, (0, 0)) if last else (0, 0)
    ending = "closed" if closed else "new" if total < 2 else "never" if hits == 0 else "rare" if hits < 0.03 * total else "some" if hits < 0.2 * total else "often"
    starts_list = answer.lstrip()[:2] in ("- ", "* ", "• ") or bool(re.match(r"\d+[.)]\s", answer.lstrip()))
    out = []
    for i, part in enumerate(parts):
        found = words(part)
        low = [_word(w)[0] for w in found]
        plain = ["9" if w[0].isdigit() else w for w in low]
        letters, here_set = [w for w in low if not w[0].isdigit()], set(low)
        n = max(len(letters), 1)
        vi, en = (_bucket(sum(w in v for w in letters) / n) for v in (vocabulary.vi, vocabulary.en))
        spoken = language(part, vocabulary)
        inside = _bucket(sum(w in asked_set for w in low) / max(len(low), 1))
        covers = _bucket(sum(w in here_set for w in asked) / max(len(asked), 1))
        is_last = i == len(parts) - 1
        place = ("only" if len(parts) == 1 else "last" if is_last else "first" if i == 0 else "inner")
        quantity = len(found) <= 4 and bool(found) and found[0][0].isdigit()
        bare = bool(re.fullmatch(r"(?:\d+[.)]|[-*•])", part))
        finish = f"{ending}{odd}" if is_last else "inner"
        here = [
            "b", f"place={place}", f"q={part.rstrip().endswith('?')}", f"in={inside}", f"cov={covers}", f"in={inside}/cov={covers}", f"lang={spoken}/{allowed}",
            f"ok={spoken in allowed.split('+')}", f"vi={vi}/{allowed}", f"en={en}/{allowed}", f"end={finish}", f"end={finish}/list={starts_list}", f"qty={quantity}/{place}", f"bare={bare}/{is_last}",
            f"n={min(len(found), 12)}/{place}", f"colon={part.endswith((':', ','))}/{is_last}", f"odd={odd}/{is_last}", f"open={is_last and part.endswith(('(', '“', '[', 'là', 'the'))}",
        ]
        if is_last and not closed:
            here += [f"tail={plain[-1] if plain else ''}", f"head={' '.join(plain[:2])}"]
        fits = spoken in allowed.split("+") or spoken == "none"  # words mean something else in a language that was not asked for
        grams = dict.fromkeys([f"w={w}/{fits}" for w in plain] + [f"2={a} {b}/{fits}" for a, b in zip(plain, plain[1:])])
        here += list(grams)
        out.append([_name_bucket(name) for name in here])
    return parts, out


@functools.lru_cache(200_000)
def _name_bucket(name: str) -> int:
    h = 0xCBF29CE484222325
    for byte in name.encode():
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return 1 + (h ^ (h >> 29)) % ((1 << FEATURE_BITS) - 1)


def defect(question: str, answer: str | None, tags: list[str], parts: list[str]) -> str | None:
    """The pair's defect from what its clauses cover, or None."""
    if is_empty(answer):
        return "empty"
    cover = Counter()
    for tag, part in zip(tags, parts):
        cover[tag] += max(len(part), 1)
    whole = max(sum(cover.values()), 1)
    if cover["foreign"] >= 0.5 * whole:
        return "wrong_language"
    if cover["refusal"] and cover["answer"] < 0.34 * whole:
        return "refusal"
    if cover["echo"] and not cover["answer"] and not cover["unfinished"]:
        return "copies_question"
    if tags and tags[-1] == "unfinished":
        return "truncated"
    return None


@functools.cache
def labelled_pairs() -> list[dict]:
    """The labelled table: question, answer and the tag of each clause."""
    return [json.loads(line) for line in LABELLED.read_text(encoding="utf-8").splitlines()[:LABELLED_ROWS]]


def vocabulary_of(rows: list[dict]) -> Vocabulary:
    vi, en = set(), set()
    for r in rows:
        text = r["question"] + " " + " ".join(c for c, t in zip(clauses(r["answer"]), r["tags"]) if t != "foreign")
        (vi if r["lang"] == "vi" else en).update(fold(w) for w in words(text) if not w[0].isdigit())
    return Vocabulary(frozenset(vi), frozenset(en))


@dataclass
class PairModel:
    chain: Chain
    vocabulary: Vocabulary
    ends: dict[str, tuple[int, int]]  #: of the labelled table's own tails


def fitted(rows: list[dict], ends: dict[str, tuple[int, int]], epochs: int = 30) -> PairModel:
    vocabulary = vocabulary_of(rows)
    features, gold, offsets = [], [], [0]
    for r in rows:
        parts, f = clause_features(r["question"], r["answer"], ends, vocabulary)
        if len(parts) == len(r["tags"]):
            features += f
            gold += [TAGS.index(t) for t in r["tags"]]
            offsets.append(offsets[-1] + len(parts))
    return PairModel(trained(Features.of(features), np.array(gold), np.array(offsets), TAGS, 1 << FEATURE_BITS, epochs), vocabulary, ends)


def end_counts(texts: Iterator[str]) -> Counter:
    """How often two words stand before a full stop, and how often at all."""
    out: Counter = Counter()
    for text in texts:
        found = [(m.group(), m.end()) for m in _WORD.finditer(text)]
        plain = ["9" if w[0].isdigit() else w.lower() for w, _ in found]
        for a, b, (_, at) in zip(plain, plain[1:], found[1:]):
            ended = text[at : at + 1] in (".", "?", "!", "…") and (at + 1 >= len(text) or text[at + 1].isspace() or text[at + 1] in "”)\"")
            out[(f"{a} {b}", ended)] += 1
    return out


_READ = "source_table string, pair_key string, question string, answer string, tail string, hits bigint, total bigint"


def _tails_and_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair (source_table, pair_key, question, answer) with its tail, and the counts of tails that the task has seen.

    Counts are rows without a source_table. The tails of the pairs are among them, if only with a count of 0.
    """
    counts: Counter = Counter()
    for batch in batches:
        answers = batch.column("answer").to_pylist()
        found = [tail(a) if a else None for a in answers]
        for key, n in end_counts(a for a in answers if a).items():
            counts[key] += n
        for t in found:
            if t:
                counts[t, False] += 0
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), none, none], names=[*batch.schema.names, "tail", "hits", "total"])
        if len(counts) > 300_000:  # a task keeps no more than that; the sums are made by the shuffle anyway
            yield _ends_batch(counts)
            counts = Counter()
    yield _ends_batch(counts)


def _ends_batch(counts: Counter) -> pa.RecordBatch:
    nothing = pa.nulls(len(counts), pa.string())
    hits = pa.array([n if ended else 0 for (_, ended), n in counts.items()], pa.int64())
    return pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.array([t for t, _ in counts], pa.string()), hits, pa.array(list(counts.values()), pa.int64())], names=["source_table", "pair_key", "question", "answer", "tail", "hits", "total"])


def tagger(shared):
    """For ``mapInArrow``: the defect of each pair that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: PairModel = shared.value
        for batch in batches:
            rows = batch.to_pylist()
            out, parts, features, offsets, kept = [], [], [], [0], []
            for r in rows:
                if is_empty(r["answer"]):
                    out.append((r["source_table"], r["pair_key"], "empty"))
                    continue
                ends = {r["tail"]: (r["hits"] or 0, r["total"] or 0)} if r["tail"] else {}
                p, f = clause_features(r["question"] or "", r["answer"], ends, model.vocabulary)
                parts.append(p)
                features += f
                offsets.append(offsets[-1] + len(p))
                kept.append(r)
            if kept:
                all_features, cuts = Features.of(features), np.array(offsets)
                tags = model.chain.decode(model.chain.emissions(all_features), cuts)
                for i, r in enumerate(kept):
                    got = defect(r["question"] or "", r["answer"], [TAGS[t] for t in tags[cuts[i] : cuts[i + 1]]], parts[i])
                    if got:
                        out.append((r["source_table"], r["pair_key"], got))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], names=["source_table", "pair_key", "defect"])

    return run


def flagged(states: DataFrame, questions: DataFrame) -> DataFrame:
    """(source_table, pair_key, defect) of every defective pair of agent_state and test_questions, one defect each.

    A null, blank or placeholder answer is empty; a null question counts as one without words. Answers of any length are
    read whole. Repeated keys give a row each; empty tables none; further columns are ignored. A response's last two words
    are joined with their counts over all responses, tails of very many responses by a broadcast (``join_groups``).
    """
    spark = states.sparkSession
    pairs = states.select(F.lit("agent_state").alias("source_table"), F.col("run_id").alias("pair_key"), F.col("task").alias("question"), F.col("final_answer").alias("answer"))
    pairs = pairs.unionAll(questions.select(F.lit("test_questions").alias("source_table"), F.col("id").alias("pair_key"), "question", F.col("expected_answer").alias("answer")))
    read = stage(pairs.mapInArrow(_tails_and_ends, _READ), "tails")
    ends = read.where("source_table IS NULL").groupBy("tail").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"))
    pairs = read.where("source_table IS NOT NULL").select("source_table", "pair_key", "question", "answer", "tail")
    open_pairs = join_groups(pairs.where("tail IS NOT NULL"), stage(ends, "ends"), ["tail"], "total", "pair_key")
    # pairs that end with a sign have nothing to look up and stay out of the join
    none = F.lit(None).cast("bigint")
    closed_pairs = pairs.where("tail IS NULL").withColumns({"hits": none, "total": none})
    known = labelled_pairs()
    own = end_counts(r["answer"] for r in known)
    mine = {t for r in known if (t := tail(r["answer"]))}
    model = fitted(known, {t: (own[(t, True)], own[(t, True)] + own[(t, False)]) for t in mine})
    return open_pairs.unionAll(closed_pairs).mapInArrow(tagger(spark.sparkContext.broadcast(model)), "source_table string, pair_key string, defect string")
