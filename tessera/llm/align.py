"""Cross-tokenizer alignment of two vocabularies over one corpus.

Each text is cut by tokenizer A (byte-level pairs) and B (pieces). Both cover the same bytes, so two tokens are
linked where their byte ranges overlap, and the places where tokens of both end cut a text into groups.

1. First pass: the texts of a chunk are tokenized and aligned; the chunk keeps its token ids, and its distinct
   linked id pairs with the number of its documents that hold each.
2. The pairs are cut by hash range, in as many ranges as the corpus has distinct pairs for, and each range gets a
   minimal perfect hash of its distinct pairs: a cascade of bit arrays in which the pairs that fall alone on a bit
   are placed and the others go on; a pair's number is the rank of its bit. The pairs stand in a table
   in the order of their numbers, so a look-up checks that the key it finds is the one asked for.
3. The chunks' counts become dense vectors indexed by the hash, which are added up in a tree.
4. Second pass: every chunk gets the counts of its pairs back, its documents are aligned again from their
   token ids, and counts are looked up for every link.

Chunks, ranges and the groups of chunks that one task sees are bounded in size, however large the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import map_arrow, ship, written
from tessera.llm.words import mix, slices

MARK = "▁"
FILE_LIMIT = 64 << 20
CACHE = 150_000
CHUNK_BYTES = 1 << 20
RANGE_PAIRS = 1 << 17
GROUP_BYTES = 16 << 20
FAN_IN = 32
DOC_BITS = 20
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: anything beyond these characters, or a long stretch without a blank, is left to the tokenizers' own libraries
_ODD = re.compile("[^\t\n -~À-ÖØ-öø-ɏΑ-Ρα-ωА-я一-龥]|[^ \t\n]{1000}")


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters are
    themselves, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and the number of bytes of each of their tokens."""

    def __init__(self, json_file: bytes, model_file: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(json_file.decode())
        self.a.encode_special_tokens = True
        of = byte_values()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.n_a = max(vocabulary.values()) + 1
        self.bytes_a = [b""] * self.n_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        # the same vocabulary as ranks, where merges are numbered in the order in which they are applied
        model = json.loads(json_file)["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        numbers = [model["vocab"].get(x + y, -1) for x, y in merges]
        self.quick = None
        if numbers == sorted(set(numbers)) and min(numbers, default=0) >= 0:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, special_tokens={},
                                           mergeable_ranks={self.bytes_a[i]: i for i in model["vocab"].values()})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_file)
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        # runs between marks are segmented apart if no piece holds a mark after another character
        self.cuts = all(MARK not in p.lstrip(MARK) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        for probe in ("a  b c ", " x\n\n y", "   "):
            self.cuts &= self.b.encode(probe) == list(chain.from_iterable(self._run(r, self.b.encode(r)) for r in self._runs(probe)))
        self.pool_a, self.pool_b = Pool(self.bytes_a), Pool(self.bytes_b)
        self.lengths_a, self.lengths_b = self.pool_a.lengths, self.pool_b.lengths
        self.known: dict[str, bytes] = {}

    def _a(self, text: str, odd: bool) -> np.ndarray:
        if self.quick is None or odd:
            return np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)
        return self.quick.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)

    @staticmethod
    def _runs(text: str) -> list[str]:
        """The text, with a mark before it, cut before marks; of each run all but its first mark, marks as blanks."""
        if not text or text[0] == " " or text[-1] == " " or "  " in text:
            return [r[1:].replace(MARK, " ") for r in _RUN.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def _run(self, run: str, ids: list[int]) -> list[int]:
        """The library gives no piece for an empty text, but a run of one mark is the mark."""
        return ids if run else [self.b.piece_to_id(MARK)]

    def _b(self, texts: list[str], odd: list[bool]) -> list[np.ndarray]:
        """Ids of every text; runs met before are not segmented again (at most ``CACHE`` of them are remembered)."""
        runs = [None if o or not self.cuts else self._runs(t) for t, o in zip(texts, odd, strict=True)]
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(set().union(*(r for r in runs if r)).difference(self.known))
        for i in range(0, len(new), 10_000):
            part = new[i:i + 10_000]
            coded = self.b.encode(part, num_threads=1)
            self.known.update((r, np.array(self._run(r, ids), np.int32).tobytes()) for r, ids in zip(part, coded, strict=True))
        of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(of, r)), np.int32).astype(np.int64) if r is not None else np.array(self.b.encode(t, num_threads=1), np.int64)
                for t, r in zip(texts, runs, strict=True)]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B for each text; none where the text is null or empty, or its bytes are not those of the tokens."""
        plain = [t or "" for t in texts]
        odd = [_ODD.search(t) is not None for t in plain]
        none = np.zeros(0, np.int64)
        out = [(self._a(t, o), b) if t else (none, none) for t, o, b in zip(plain, odd, self._b(plain, odd), strict=True)]
        whole = [b" " + t.encode() if t else b"" for t in plain]
        for k, pool in ((0, self.pool_a), (1, self.pool_b)):
            if not np.array_equal(pool(np.concatenate([none, *(x[k] for x in out)])), np.frombuffer(b"".join(whole), np.uint8)):
                out = [x if pool(x[k]).tobytes() == t else (none, none) for x, t in zip(out, whole, strict=True)]
                whole = [t if len(x[k]) else b"" for x, t in zip(out, whole, strict=True)]
        return out


class Pool:
    """The bytes of a vocabulary's tokens; called with ids it gives their bytes in a row."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.data[np.repeat(self.starts[ids] - ends + n, n) + np.arange(n.sum())]


_TOKENIZERS: dict[bytes, Tokenizers] = {}


def _tokenizers(files: tuple[bytes, bytes]) -> Tokenizers:
    """Built once in a worker."""
    key = hashlib.sha256(files[0]).digest() + hashlib.sha256(files[1]).digest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizers(*files)
    return _TOKENIZERS[key]


def overlaps(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all tokens whose byte ranges overlap, in order, from the places where tokens end."""
    start_a = np.concatenate([[0], end_a[:-1]])
    first = np.searchsorted(end_b, start_a, "right")
    last = np.searchsorted(end_b, end_a, "left")  # the token that covers the last byte
    n = last - first + 1
    i = np.repeat(np.arange(len(end_a)), n)
    return i, np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Aligned:
    """Documents of a chunk, their tokens one after the other: linked pairs, and the groups both cut."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray) -> None:
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        self.end_a, self.end_b = np.cumsum(lengths_a[a]), np.cumsum(lengths_b[b])
        self.i, self.j = overlaps(self.end_a, self.end_b)
        self.doc = np.repeat(np.arange(len(n_a)), n_a)[self.i]
        self.pair = a[self.i] * len(lengths_b) + b[self.j]

    def texts(self) -> tuple[np.ndarray, pa.Array]:
        """Number of groups, and the groups as ``a1,a2|b1;a3|b2,b3``, of each document."""
        cut = np.intersect1d(self.end_a, self.end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cut, self.end_a, "left"), np.searchsorted(cut, self.end_b, "left")
        # tokens in writing order, each with the mark after it: of A within a group, then of B
        at_a = np.arange(len(self.a)) + np.searchsorted(group_b, group_a, "left")
        at_b = np.arange(len(self.b)) + np.searchsorted(group_a, group_b, "right")
        n = len(self.a) + len(self.b)
        ids, mark = np.empty(n, np.int64), np.empty(n, np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        mark[at_a] = np.diff(group_a, append=len(cut)) > 0
        mark[at_b] = 2 * (np.diff(group_b, append=len(cut)) > 0)
        tokens = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        # decimal digits and the mark of every token; the last one of a document has no mark
        digits = np.searchsorted(10 ** np.arange(1, 10), ids, "right") + 1
        ends = np.cumsum(digits + 1)
        out = np.empty(ends[-1] if n else 0, np.uint8)
        out[ends - 1] = np.frombuffer(b",|;", np.uint8)[mark]
        left, at = ids.copy(), ends - 2
        for k in range(int(digits.max(initial=0))):
            here = digits > k
            out[at[here]] = 48 + left[here] % 10
            left //= 10
            at -= 1
        last = np.diff(tokens) > 0
        out = np.delete(out, ends[tokens[1:][last] - 1] - 1)
        offsets = np.concatenate([[0], ends])[tokens] - np.concatenate([[0], np.cumsum(last)])
        texts = pa.LargeStringArray.from_buffers(len(self.n_a), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
        groups = np.concatenate([[0], group_a + 1])[np.concatenate([[0], np.cumsum(self.n_a)])]
        return np.diff(groups), texts


CHUNK = "chunk long, doc_ids array<long>, n_a binary, n_b binary, a binary, b binary, pairs binary, times binary, n_pairs long"


def _first_pass(sent: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizers(sent.value)
        at = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", CHUNK_BYTES):
                if batch.num_rows > 1 << DOC_BITS:
                    raise ValueError("over a million rows in one Arrow batch")
                coded = own.encode(batch.column("text").to_pylist())
                n_a, n_b = (np.array([len(c[k]) for c in coded], np.int64) for k in range(2))
                a, b = (np.concatenate([np.zeros(0, np.int64), *(c[k] for c in coded)]) for k in range(2))
                del coded
                aligned = Aligned(a, b, n_a, n_b, own.lengths_a, own.lengths_b)
                held = np.unique(aligned.pair << DOC_BITS | aligned.doc) >> DOC_BITS
                pairs, times = np.unique(held, return_counts=True)
                at += 1
                yield pa.record_batch([
                    pa.array([at], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    *(pa.array([x.astype(np.uint32).tobytes()], pa.binary()) for x in (n_a, n_b)),
                    *(pa.array([x.astype(np.uint16 if n <= 1 << 16 else np.uint32).tobytes()], pa.binary()) for x, n in ((a, own.n_a), (b, own.n_b))),
                    pa.array([pairs.tobytes()], pa.binary()), pa.array([times.astype(np.uint32).tobytes()], pa.binary()), pa.array([len(pairs)], pa.int64())],
                    names=["chunk", "doc_ids", "n_a", "n_b", "a", "b", "pairs", "times", "n_pairs"])
    return run


def _by_range(pairs: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each pair, and the order that puts ranges one after the other."""
    part = (mix(pairs.astype(np.uint64)) >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int64) if ranges > 1 else np.zeros(len(pairs), np.int64)
    return part, np.argsort(part, kind="stable")


PIECE = "part int, team int, chunk long, pairs binary, times binary"


def _pieces(ranges: int, teams: int) -> Callable:
    """A chunk's pairs and counts, cut by range; the chunks are dealt to teams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, times = np.frombuffer(row["pairs"], np.int64), np.frombuffer(row["times"], np.uint32)
                part, order = _by_range(pairs, ranges)
                pairs, times = pairs[order], times[order]
                ends = np.cumsum(np.bincount(part, minlength=ranges))
                team = int(mix(np.array([row["chunk"]], np.uint64))[0] % np.uint64(teams))
                out = [(p, team, row["chunk"], pairs[a:b].tobytes(), times[a:b].tobytes())
                       for p, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if b > a]
                for i in range(0, len(out), 256):
                    columns = zip(zip(*out[i:i + 256], strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)
                    yield pa.record_batch([pa.array(c, k) for c, k in columns], names=["part", "team", "chunk", "pairs", "times"])
    return run


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: each level's bit array holds the keys that fall alone on a bit."""

    SPARE = 2
    _ONES = np.uint64(0xFFFF_FFFF_FFFF_FFFF)

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits  # whole 64-bit words of every level, one level after the other
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        h = mix(keys ^ mix(np.array([level + 1], np.uint64)))
        return ((h >> np.uint64(32)) * np.uint64(64 * words) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, arrays = keys.astype(np.uint64), [], []
        while len(left):
            words = -(-cls.SPARE * len(left) // 64)
            at = cls._place(left, len(sizes), words)
            count = np.bincount(at, minlength=64 * words)
            arrays.append(np.packbits(count == 1, bitorder="little").view(np.uint64))
            sizes.append(words)
            left = left[count[at] > 1]
        return cls(sizes, np.concatenate([np.zeros(0, np.uint64), *arrays]))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """0 .. n-1 for the n keys it was made of; any of these, or -1, for another key."""
        keys, out = keys.astype(np.uint64), np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, words in enumerate(self.sizes):
            at = self._place(keys[open_], level, words)
            word, bit = self.starts[level] + (at >> 6), (at & 63).astype(np.uint64)
            found = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[found]] & ~(self._ONES << bit[found])
            out[open_[found]] = self.before[word[found]] + np.bitwise_count(below)
            open_ = open_[~found]
        return out

    def verified(self, keys: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Numbers of keys that must all be in the table of keys by number."""
        out = self.number(keys)
        if (out < 0).any() or (table[out] != keys).any():
            raise ValueError("a pair is not among those that were hashed")
        return out


def _united(table: pa.Table) -> pa.Table:
    """Distinct pairs of a range that a team holds."""
    pairs = np.unique(np.frombuffer(b"".join(table.column("pairs").to_pylist()), np.int64))
    return pa.table({"part": table.column("part")[:1], "team": table.column("team")[:1], "pairs": pa.array([pairs.tobytes()], pa.binary())})


def _hashed(table: pa.Table) -> pa.Table:
    """A range's perfect hash, and its pairs in the order of their numbers."""
    pairs = np.unique(np.frombuffer(b"".join(table.column("pairs").to_pylist()), np.int64))
    own = PerfectHash.of(pairs)
    keys = np.empty_like(pairs)
    keys[own.number(pairs)] = pairs
    return pa.table({"part": table.column("part")[:1], "sizes": pa.array([own.sizes], pa.list_(pa.int32())), "bits": pa.array([own.bits.tobytes()], pa.binary()),
                     "keys": pa.array([keys.tobytes()], pa.binary())})


HASHED = "part int, sizes array<int>, bits binary, keys binary"


def _hash_of(table: pa.Table) -> tuple[PerfectHash, np.ndarray]:
    row = {n: table.column(n)[0].as_py() for n in ("sizes", "bits", "keys")}
    return PerfectHash(row["sizes"], np.frombuffer(row["bits"], np.uint64)), np.frombuffer(row["keys"], np.int64)


def _dense(pieces: pa.Table, hashed: pa.Table) -> pa.Table:
    """A team's counts of a range as one dense vector indexed by the hash."""
    if not pieces.num_rows:
        return pa.table({"part": pa.array([], pa.int32()), "team": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
    own, keys = _hash_of(hashed)
    counts = np.zeros(len(keys), np.int64)
    for pairs, times in zip(pieces.column("pairs").to_pylist(), pieces.column("times").to_pylist(), strict=True):
        counts[own.verified(np.frombuffer(pairs, np.int64), keys)] += np.frombuffer(times, np.uint32)
    return pa.table({"part": pieces.column("part")[:1], "team": pieces.column("team")[:1], "counts": pa.array([counts.tobytes()], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    total = functools.reduce(np.add, (np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()))
    return pa.table({"part": table.column("part")[:1], "team": table.column("team")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _looked_up(pieces: pa.Table, hashed: pa.Table) -> pa.Table:
    """For each chunk the corpus-wide counts of its pairs of a range."""
    out: list[tuple] = []
    if pieces.num_rows:
        own, keys = _hash_of(hashed)
        counts = np.frombuffer(hashed.column("counts")[0].as_py(), np.int64)
        for part, chunk, pairs in zip(*(pieces.column(c).to_pylist() for c in ("part", "chunk", "pairs")), strict=True):
            out.append((chunk, part, counts[own.verified(np.frombuffer(pairs, np.int64), keys)].tobytes()))
    chunk, part, counts = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "part": pa.array(part, pa.int32()), "counts": pa.array(counts, pa.binary())})


def _highest(n_b: int) -> Callable:
    """The highest count of each id of A, over the ranges of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                ids, at = np.unique(np.frombuffer(keys, np.int64) // n_b, return_inverse=True)
                top = np.zeros(len(ids), np.int64)
                np.maximum.at(top, at, np.frombuffer(counts, np.int64))
                yield pa.record_batch([pa.array(ids), pa.array(top)], names=["a", "top"])
    return run


def _rows(n_b: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                pairs = np.frombuffer(keys, np.int64)
                yield pa.record_batch([pa.array(pairs // n_b), pa.array(pairs % n_b), pa.array(np.frombuffer(counts, np.int64))], names=["a_id", "b_id", "documents"])
    return run


OUT = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "n_best": pa.int64(), "count_sum": pa.int64(), "groups": pa.string()}


def _second_pass(sent: Broadcast, ranges: int) -> Callable:
    """Aligns a chunk's documents again and looks up the count of every link."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: pa.array([], k) for n, k in OUT.items()})
        lengths_a, lengths_b, top = sent.value
        row = {n: left.column(n)[0].as_py() for n in ("doc_ids", "n_a", "n_b", "a", "b", "pairs")}
        n_a, n_b = (np.frombuffer(row[n], np.uint32).astype(np.int64) for n in ("n_a", "n_b"))
        a, b = (np.frombuffer(row[n], np.uint16 if len(own) <= 1 << 16 else np.uint32).astype(np.int64) for n, own in (("a", lengths_a), ("b", lengths_b)))
        aligned = Aligned(a, b, n_a, n_b, lengths_a, lengths_b)
        pairs = np.frombuffer(row["pairs"], np.int64)
        counts = np.empty(len(pairs), np.int64)
        back = sorted(zip(right.column("part").to_pylist(), right.column("counts").to_pylist(), strict=True))
        counts[_by_range(pairs, ranges)[1]] = np.frombuffer(b"".join(c for _, c in back), np.int64)
        own = counts[np.searchsorted(pairs, aligned.pair)]
        best = own == top[aligned.a[aligned.i]]
        n = len(n_a)
        totals = [np.bincount(aligned.doc, minlength=n), np.bincount(aligned.doc[best], minlength=n), np.zeros(n, np.int64)]
        np.add.at(totals[2], aligned.doc, own)
        groups, texts = aligned.texts()
        values = [row["doc_ids"], n_a, n_b, groups, *totals]
        return pa.table({name: pa.array(v, OUT[name]) for name, v in zip(OUT, values, strict=False)} | {"groups": texts})
    return run


class Alignment:
    """The alignment of a table of documents; ``pair_counts`` and ``documents`` give its results."""

    def __init__(self, docs: DataFrame, json_path: str, model_path: str, doc_id: str = "doc_id", text: str = "text") -> None:
        """Both files are read on the driver and sent to the tasks (at most 64 MB each)."""
        spark = docs.sparkSession
        files = []
        for path in (json_path, model_path):
            with open(path, "rb") as f:
                files.append(f.read(FILE_LIMIT + 1))
            if len(files[-1]) > FILE_LIMIT:
                raise ValueError(f"{path} is over 64 MB")
        own = Tokenizers(*files)
        if max(own.n_a, own.n_b) > 1 << 21:
            raise ValueError("vocabularies of over 2,097,152 tokens")
        self.lengths = own.lengths_a, own.lengths_b
        n_b = own.n_b
        del own
        sent = spark.sparkContext.broadcast(tuple(files))
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.chunks = written(map_arrow(rows, _first_pass(sent), CHUNK), "chunks")
        ship(spark)

        total = self.chunks.agg(F.sum("n_pairs")).first()[0] or 0
        keys = map_arrow(self.chunks.select("pairs"), _longs, "pair long")
        distinct = keys.agg(F.approx_count_distinct("pair", 0.02)).first()[0]
        self.ranges = 1 << max(0, (-(-distinct // RANGE_PAIRS) - 1).bit_length())
        teams = max(1, -(-12 * total // (self.ranges * GROUP_BYTES)))
        pieces = written(map_arrow(self.chunks.select("chunk", "pairs", "times"), _pieces(self.ranges, teams), PIECE), "pieces")

        held = pieces.select("part", "team", "pairs").groupBy("part", "team").applyInArrow(_united, "part int, team int, pairs binary")
        held = self._tree(held, teams, _united, "part int, team int, pairs binary")
        hashed = written(held.groupBy("part").applyInArrow(_hashed, HASHED), "hashed")
        every = hashed.withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))))
        dense = (pieces.groupBy("part", "team").cogroup(every.groupBy("part", "team")).applyInArrow(_dense, "part int, team int, counts binary"))
        dense = self._tree(dense, teams, _added, "part int, team int, counts binary")
        summed = dense.groupBy("part").applyInArrow(_added, "part int, team int, counts binary").select("part", "counts")
        self.counted = written(hashed.join(summed, "part"), "counted")

        tops = map_arrow(self.counted.select("keys", "counts"), _highest(n_b), "a long, top long").groupBy("a").agg(F.max("top").alias("top"))
        top = np.zeros(len(self.lengths[0]), np.int64)
        for row in tops.collect():  # one row for each id of A at most
            top[row.a] = row.top
        every = self.counted.withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))))
        self.back = (pieces.groupBy("part", "team").cogroup(every.groupBy("part", "team"))
                     .applyInArrow(_looked_up, "chunk long, part int, counts binary"))
        self.sent = spark.sparkContext.broadcast((*self.lengths, top))

    @staticmethod
    def _tree(rows: DataFrame, teams: int, merge: Callable, schema: str) -> DataFrame:
        """Merge ``FAN_IN`` teams into one until no more than that are left."""
        while teams > FAN_IN:
            teams = -(-teams // FAN_IN)
            rows = rows.withColumn("team", F.pmod(F.col("team"), F.lit(teams)).cast("int")).groupBy("part", "team").applyInArrow(merge, schema)
        return rows

    def pair_counts(self) -> DataFrame:
        """(a_id, b_id, documents): in how many documents the two ids are linked."""
        return map_arrow(self.counted.select("keys", "counts"), _rows(len(self.lengths[1])), "a_id long, b_id long, documents long")

    def documents(self) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every input row.

        ``n_best``: links whose count is the highest of their A id, ties included; ``count_sum``: over all links;
        ``groups``: ids as ``a1,a2|b1;a3|b2,b3``. A null or empty text, and one whose tokens' bytes are not its own (with
        a space before it), has zeros and no groups. Repeated rows are documents of their own. An empty table
        gives no rows; no other column is read.
        """
        return (self.chunks.select("chunk", "doc_ids", "n_a", "n_b", "a", "b", "pairs").groupBy("chunk").cogroup(self.back.groupBy("chunk"))
                .applyInArrow(_second_pass(self.sent, self.ranges),
                              "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"))


def _longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("pairs").to_pylist():
            pairs = np.frombuffer(x, np.int64)
            for i in range(0, len(pairs), 1 << 18):
                yield pa.record_batch([pa.array(pairs[i:i + (1 << 18)])], names=["pair"])
