"""Language-model scores from a log-frequency Bloom filter.

The filter holds, for every word and word pair of the training documents, the entries (n-gram, 1) ..
(n-gram, level) with level = floor(log2(count)) + 1. A reader probes level after level until one is missing
and so gets the count to within a factor of two. Probabilities mix the pair's share of its first word with
the add-one share of the word.

The texts are read once into packed chunks (token numbers within a chunk and the chunk's sorted distinct
word hashes). Training counts meet by hash range: a range's task sums the chunks' counts and builds the range's
stretch of the filter, which is stored with the exact word counts of the range: that table is the model, and any texts can be scored by
it. To score, the words and pairs of each chunk go to the stretches of their ranges, are probed there level by level, and
the chunk gets the levels back (and the exact word counts, for the base score). Ranges and chunks are many enough to be small
whatever the input; the stretches together grow with the training n-grams, and no task holds more than one.

What is shuffled goes as compressed bytes: sorted hashes by their differences, small numbers in byte planes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import map_arrow, ship, written
from tessera.llm.words import from_steps, gathered, hash_ranges, hash_words, mix, squeezed, steps, text_bytes, unsqueezed

CHUNK = 8 << 20
LEAST = 1
BITS_PER_ENTRY = 16
RANGE_BYTES = 16 << 20
PAIR_WEIGHT = 0.6
END = 0x5F3C_29A1_77E0_4D1B
KEY_BYTES = 5
_K1, _K2, _STEP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 8 * KEY_BYTES) - 1)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _K1 + second * _K2)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole texts: token numbers, and the chunk's distinct words with their training counts."""
    at = TaskContext.get().partitionId() << 32
    for batch in gathered(batches, "text", CHUNK):
        h, first = hash_words(*text_bytes(batch.column("text")))
        n = np.diff(first)
        # one end after each text
        tokens = np.insert(h, first[1:], np.uint64(END)) if len(n) else h
        vocabulary, numbers = np.unique(tokens, return_inverse=True)
        train = ~np.array(batch.column("held_out").to_pylist(), bool)
        used = numbers[np.repeat(train, n + 1)]
        at += 1
        yield pa.record_batch([
            pa.array([at], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([train.tolist()], pa.list_(pa.bool_())),
            pa.array([(n + 1).tolist()], pa.list_(pa.int64())), pa.array([steps(vocabulary)], pa.binary()),
            pa.array([squeezed(np.bincount(used, minlength=len(vocabulary)), 4)], pa.binary()),
            pa.array([squeezed(numbers, 3 if len(vocabulary) <= 1 << 24 else 4)], pa.binary()), pa.array([len(vocabulary)], pa.int64()),
            pa.array([len(used)], pa.int64()), pa.array([len(tokens)], pa.int64())],
            names=["chunk", "doc_ids", "train", "lengths", "vocabulary", "counts", "tokens", "n_words", "n_train", "n_tokens"])


PACKED = ("chunk long, doc_ids array<long>, train array<boolean>, lengths array<long>, vocabulary binary, counts binary, tokens binary, "
          "n_words long, n_train long, n_tokens long")


def _by_low(pairs: np.ndarray, ranges: int) -> np.ndarray:
    """The order of sorted pair hashes by hash range and, in a range, by the low bytes that stand for them there."""
    part = pairs >> np.uint64(64 - (ranges.bit_length() - 1)) if ranges > 1 else np.zeros(len(pairs), np.uint64)
    return np.argsort((part << np.uint64(8 * KEY_BYTES)) | (pairs & _LOW), kind="stable")


def _dealt(ranges: int, training: bool) -> Callable:
    """Each chunk's words and pairs, cut by hash range: those of training texts with their counts, or all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].as_py() for name in ("chunk", "train", "lengths", "vocabulary", "counts", "tokens")}
                words, counts = from_steps(row["vocabulary"]), unsqueezed(row["counts"])
                h = words[unsqueezed(row["tokens"])]
                before = np.concatenate([[np.uint64(END)], h[:-1]])
                pairs = pair_keys(before, h)
                if training:
                    pairs, times = np.unique(pairs[np.repeat(row["train"], row["lengths"])], return_counts=True)
                    words, counts = words[counts > 0], counts[counts > 0]
                    order = _by_low(pairs, ranges)
                    low, times = (pairs & _LOW)[order], times[order]
                    out = [(p, row["chunk"], steps(words[a:b]), squeezed(counts[a:b], 4), None, None) for p, a, b in hash_ranges(words, ranges)]
                    out += [(p, row["chunk"], None, None, steps(low[a:b]), squeezed(times[a:b], 4)) for p, a, b in hash_ranges(pairs, ranges)]
                else:
                    pairs = np.unique(pairs)
                    low = (pairs & _LOW)[_by_low(pairs, ranges)]
                    out = [(p, row["chunk"], steps(words[a:b]), None, None, None) for p, a, b in hash_ranges(words, ranges)]
                    out += [(p, row["chunk"], None, None, steps(low[a:b]), None) for p, a, b in hash_ranges(pairs, ranges)]
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                for i in range(0, len(out), 256):
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out[i:i + 256], strict=True), kinds, strict=True)], names=DEALT_NAMES)
    return run


DEALT_NAMES = ["part", "chunk", "words", "counts", "pairs", "times"]
DEALT = "part int, chunk long, words binary, counts binary, pairs binary, times binary"


def levels(counts: np.ndarray, least: int) -> np.ndarray:
    return np.floor(np.log2(counts / least)).astype(np.int64) + 1


def middle(level: np.ndarray, least: int) -> np.ndarray:
    """The geometric middle of the counts of a level (0: none)."""
    return np.where(level > 0, least * np.exp2(level - 0.5), 0.0)


class Filter:
    """64-bit words; an entry sets five bits of one word. ``part`` keys stay in their own stretch."""

    def __init__(self, words: np.ndarray, ranges: int, least: int = 2) -> None:
        self.words, self.ranges, self.least = words, ranges, least
        self.stretch = len(words) // ranges

    def _place(self, part: np.ndarray, low: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(low + np.uint64(level * _STEP & 0xFFFF_FFFF_FFFF_FFFF))
        mask = np.zeros(len(x), np.uint64)
        for k in range(5):
            mask |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
        return part * self.stretch + ((x >> np.uint64(32)) % np.uint64(self.stretch)).astype(np.int64), mask

    def add(self, low: np.ndarray, level: np.ndarray) -> None:
        for j in range(1, int(level.max(initial=0)) + 1):
            at, mask = self._place(np.int64(0), low[level >= j], j)
            np.bitwise_or.at(self.words, at, mask)

    def level(self, keys: np.ndarray, tag: int) -> np.ndarray:
        """Highest level that an unbroken row of probes finds (0: none)."""
        part = (keys >> np.uint64(64 - (self.ranges.bit_length() - 1))).astype(np.int64) if self.ranges > 1 else np.zeros(len(keys), np.int64)
        low = (keys & _LOW) ^ (np.uint64(tag) << np.uint64(56))
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        j = 1
        while len(alive) and j < 64:
            at, mask = self._place(part[alive], low[alive], j)
            alive = alive[(self.words[at] & mask) == mask]
            out[alive] = j
            j += 1
        return out

    def count(self, keys: np.ndarray, tag: int) -> np.ndarray:
        """Counts to within a factor of two."""
        return middle(self.level(keys, tag), self.least)


WORD, PAIR = 1, 2


def _stretch(keys: np.ndarray, counts: np.ndarray, tag: int, least: int) -> np.ndarray:
    """The filter of these counts, sized by its entries."""
    often = counts >= least
    level = levels(counts[often], least)
    own = Filter(np.zeros(max(1, int(level.sum()) * BITS_PER_ENTRY // 64), np.uint64), 1, least=least)
    own.add((keys[often] & _LOW) ^ (np.uint64(tag) << np.uint64(56)), level)
    return own.words


def _summed(table: pa.Table) -> pa.Table:
    """A hash range of the model: its words with their exact counts, and its stretches of the filter."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("words", "counts", "pairs", "times")), strict=True))
    single, double = [r for r in rows if r[0]], [r for r in rows if r[2]]
    words, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(from_steps(r[0]) for r in single)]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([np.zeros(0, np.uint64), *(unsqueezed(r[1]) for r in single)]), len(words)).astype(np.int64)
    pairs, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(from_steps(r[2]) for r in double)]), return_inverse=True)
    times = np.bincount(at, np.concatenate([np.zeros(0, np.uint64), *(unsqueezed(r[3]) for r in double)]), len(pairs)).astype(np.int64)
    own = [words, counts, _stretch(words, counts, WORD, LEAST), _stretch(pairs, times, PAIR, LEAST)]
    return pa.table({"part": table.column("part")[:1], **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("words", "counts", "word_bits", "pair_bits"), own, strict=True)},
                     "distinct": pa.array([len(words)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})


SUMMED = "part int, words binary, counts binary, word_bits binary, pair_bits binary, distinct long, total long"


def _probed(pieces: pa.Table, model: pa.Table) -> pa.Table:
    """For each chunk its words' exact counts and levels, and its pairs' levels, from the filter's stretch of this range."""
    out: list[tuple] = []
    if pieces.num_rows:
        row = {n: np.frombuffer(model.column(n)[0].as_py() if model.num_rows else b"", k)
               for n, k in (("words", np.uint64), ("counts", np.int64), ("word_bits", np.uint64), ("pair_bits", np.uint64))}
        filters = [Filter(row[n] if len(row[n]) else np.zeros(1, np.uint64), 1, least=LEAST) for n in ("word_bits", "pair_bits")]
        for part, chunk, words, pairs in zip(*(pieces.column(c).to_pylist() for c in ("part", "chunk", "words", "pairs")), strict=True):
            if words is not None:
                keys = from_steps(words)
                at = np.minimum(np.searchsorted(row["words"], keys), max(0, len(row["words"]) - 1))
                known = np.where(row["words"][at] == keys, row["counts"][at], 0) if len(row["words"]) else np.zeros(len(keys), np.int64)
                wide = bool(known.max(initial=0) >= 1 << 32)
                out.append((chunk, part, known.astype(np.uint64 if wide else np.uint32).tobytes(), wide, filters[0].level(keys, WORD).astype(np.uint8).tobytes(), None))
            else:
                out.append((chunk, part, None, None, None, filters[1].level(from_steps(pairs), PAIR).astype(np.uint8).tobytes()))
    chunk, part, known, wide, level, pair_level = zip(*out, strict=True) if out else [()] * 6
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "part": pa.array(part, pa.int32()), "known": pa.array(known, pa.binary()), "wide": pa.array(wide, pa.bool_()),
                     "level": pa.array(level, pa.binary()), "pair_level": pa.array(pair_level, pa.binary())})


PROBED = "chunk long, part int, known binary, wide boolean, level binary, pair_level binary"


def _scored(total: int, distinct: int, ranges: int, weight: float, least: int = LEAST) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        row = {n: left.column(n)[0].as_py() for n in ("doc_ids", "train", "lengths", "vocabulary", "tokens")}
        words, tokens, lengths = from_steps(row["vocabulary"]), unsqueezed(row["tokens"]).astype(np.int64), np.array(row["lengths"], np.int64)
        back = sorted(zip(*(right.column(c).to_pylist() for c in ("part", "known", "wide", "level", "pair_level")), strict=True), key=lambda r: r[0])
        known = np.concatenate([np.frombuffer(k, np.uint64 if w else np.uint32).astype(np.float64) for _, k, w, _, _ in back if k is not None])
        level, pair_level = (np.frombuffer(b"".join(r[i] for r in back if r[i] is not None), np.uint8) for i in (3, 4))
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        log = np.log10(known + 1)[tokens]
        base = np.add.reduceat(log, first) - lengths * np.log10(float(total + distinct + 1))
        found = np.add.reduceat((known > 0)[tokens].astype(np.int64), first)
        rough = middle(level, least)
        single = ((rough + 1) / (total + distinct + 1))[tokens]
        before = np.concatenate([[np.searchsorted(words, np.uint64(END))], tokens[:-1]])
        context = rough[before]
        pairs, which = np.unique(pair_keys(words[before], words[tokens]), return_inverse=True)
        often = np.zeros(len(pairs))
        often[_by_low(pairs, ranges)] = middle(pair_level, least)
        pair = often[which]
        share = np.minimum(1.0, pair / np.maximum(context, 1.0))
        p = np.where(context > 0, weight * share + (1 - weight) * np.minimum(1.0, single), np.minimum(1.0, single))
        score = np.add.reduceat(np.log10(p), first)
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(~np.array(row["train"], bool)), "n_tokens": pa.array(lengths),
                         "n_known": pa.array(found), "base_score": pa.array(base), "score": pa.array(score)})
    return run


def pack(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts as written chunks of tokens; ``train`` tells which ones a model may learn from (null: none)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (~F.coalesce(train, F.lit(False))).alias("held_out"))
    return written(map_arrow(rows, _pack, PACKED), "packed")


class Model:
    """A written table of hash ranges (exact word counts and the filter's stretches), and the corpus totals."""

    def __init__(self, table: DataFrame, ranges: int) -> None:
        self.table, self.ranges = table, ranges
        self.distinct, self.total = (x or 0 for x in table.agg(F.sum("distinct"), F.sum("total")).first())


_CHUNK = ("chunk", "train", "lengths", "vocabulary", "counts", "tokens")


def fit(packed: DataFrame) -> Model:
    """The model of the training texts of these chunks. Ranges are powers of two, each with about ``RANGE_BYTES`` of word and pair rows."""
    spark = packed.sparkSession
    n_tokens, n_vocabulary = (x or 0 for x in packed.agg(F.sum("n_train"), F.sum("n_words")).first())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (12 * n_vocabulary + KEY_BYTES * n_tokens) // RANGE_BYTES)
    ranges = 1 << max(0, (parts - 1).bit_length())
    ship(spark)
    dealt = map_arrow(packed.filter("n_train > 0").select(*_CHUNK), _dealt(ranges, True), DEALT)
    return Model(written(dealt.groupBy("part").applyInArrow(_summed, SUMMED), "filter"), ranges)


def score_packed(packed: DataFrame, model: Model, weight: float = PAIR_WEIGHT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text of the chunks, by probing the model's filter."""
    ship(packed.sparkSession)
    asked = map_arrow(packed.select(*_CHUNK), _dealt(model.ranges, False), DEALT).select("part", "chunk", "words", "pairs")
    found = (asked.groupBy("part").cogroup(model.table.select("part", "words", "counts", "word_bits", "pair_bits").groupBy("part"))
             .applyInArrow(_probed, PROBED))
    scored = (packed.select("chunk", "doc_ids", "train", "lengths", "vocabulary", "tokens").groupBy("chunk").cogroup(found.groupBy("chunk"))
              .applyInArrow(_scored(model.total, model.distinct, model.ranges, weight),
                            "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", weight: float = PAIR_WEIGHT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every input row.

    ``held_out`` rows are scored but not learned from (null counts as false). A null or empty text is its end alone.
    Repeated rows are learned from and scored each. ``base_score`` uses exact counts; ``score`` is the
    model's log10 probability of the text, pairs across texts never being formed (a text begins after an
    end). An empty table, or no training row, gives scores from no counts. No other column is read.
    """
    packed = pack(docs, ~F.coalesce(held_out, F.lit(False)), doc_id, text)
    return score_packed(packed, fit(packed), weight)
