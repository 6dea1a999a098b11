"""SentencePiece encoding and decoding with a unigram search over a model file's pieces and scores.

An Aho-Corasick automaton over the pieces reports, at each end position, every piece that ends there
(longest first, along its output links); one pass over the text relaxes the best score of each position.
Characters that no piece covers become byte pieces. Cuts before a space mark are exact when no piece
holds a mark after another character, so runs between marks are searched once and remembered.

The round trip is exact for every text: a literal U+2581, which the mark would turn into a space, is
written as its bytes. Where several segmentations have the same total, the one with the longer last
piece at the earliest difference is taken. For a file trained as byte-pair merges the scores are the
merge ranks; the result is the best segmentation under those scores, not the merge procedure's.
"""

from __future__ import annotations

import hashlib
import re
from collections import ChainMap, deque
from collections.abc import Iterator
from itertools import chain
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import map_arrow

MARK = "▁"
CACHE = 250_000
LONGEST_CACHED = 64
MODEL_LIMIT = 64 << 20
_LEAST = float("-inf")
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Codec:
    """Encoder and decoder over one model file's pieces."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        table = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = table.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = [-1] * 256
        self.automaton = ahocorasick.Automaton()
        usable: list[tuple[str, int]] = []
        scores, sizes = [0.0] * n, [0] * n
        lowest, cuts, chars = 0.0, True, set()
        for i in range(n):
            piece = table.id_to_piece(i)
            if table.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (table.is_control(i) or table.is_unknown(i) or table.is_unused(i)):
                score = table.get_score(i)
                self.automaton.add_word(piece, (len(piece), score, i))
                usable.append((piece, i))
                scores[i], sizes[i] = score, len(piece)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                lowest = min(lowest, score)
                if len(piece) == 1:
                    chars.add(piece)
                cuts &= MARK not in piece.lstrip(MARK)
        self.automaton.make_automaton()
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no byte pieces; texts could not be restored")
        self.alone = (1, lowest - 10.0, -1)
        self.chars = chars
        self.cuts = cuts
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        self.mark_bytes = np.array([self.byte_ids[b] for b in MARK.encode()], np.int32).tobytes()
        self.known: dict[str, bytes] = {}
        # the last entry is the crossing of one uncovered character (index -1)
        self.scores = np.array([*scores, self.alone[1]])
        self.sizes = np.array([*sizes, 1])
        self.single = np.full(0x110000, -1, np.int32)
        for piece, i in usable:
            if len(piece) == 1:
                self.single[ord(piece)] = i
        self._table([(piece, i) for piece, i in usable if len(piece) > 1])

    def search(self, run: str) -> bytes:
        """Best segmentation of a run (marks for spaces), as packed 32-bit ids."""
        n = len(run)
        best = [0.0] + [_LEAST] * n
        back: list = [None] * (n + 1)
        if self.chars.issuperset(run):
            for at, match in self.automaton.iter(run):
                value = best[at + 1 - match[0]] + match[1]
                if value > best[at + 1]:
                    best[at + 1] = value
                    back[at + 1] = match
        else:
            # before a position is used, a character that no piece covers is crossed alone
            matches: list[list] = [[] for _ in range(n)]
            for at, match in self.automaton.iter(run):
                matches[at].append(match)
            for at, ending in enumerate(matches):
                for match in ending if run[at] in self.chars else (*ending, self.alone):
                    value = best[at + 1 - match[0]] + match[1]
                    if value > best[at + 1]:
                        best[at + 1] = value
                        back[at + 1] = match
        out: list[int] = []
        e = n
        while e:
            size, _, piece = back[e]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids[b] for b in reversed(run[e - 1].encode()))
            e -= size
        out.reverse()
        return pack(f"={len(out)}i", *out)

    def _table(self, multi: list[tuple[str, int]]) -> None:
        """The automaton of the pieces with two characters or more as a dense transition table."""
        chars = sorted({c for piece, _ in multi for c in piece})
        self.class_of = np.zeros(0x110000, np.uint16)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for piece, i in multi:
            at = 0
            for k in self.class_of[[ord(c) for c in piece]].tolist():
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                    own.append(-1)
                at = children[at][k]
            own[at] = i
        n, width = len(children), len(chars) + 1
        self.goto = np.zeros((n, width), np.int32)
        self.piece_at = np.array(own, np.int32)
        self.output = np.zeros(n, np.int32)  # nearest suffix state that ends a piece, 0: none
        fail = [0] * n
        queue = deque([0])
        while queue:
            at = queue.popleft()
            if at:
                self.goto[at] = self.goto[fail[at]]
                self.output[at] = fail[at] if own[fail[at]] >= 0 else self.output[fail[at]]
            for k, child in children[at].items():
                fail[child] = int(self.goto[fail[at], k]) if at else 0
                self.goto[at, k] = child
                queue.append(child)

    def search_many(self, runs: list[str]) -> list[bytes]:
        """``search`` of many short runs at once: all automata step together, one character at a time,
        and each step follows the output links of every run and relaxes its best score there."""
        order = np.argsort([-len(r) for r in runs], kind="stable")
        size = np.array([len(runs[i]) for i in order], np.int64)
        n, longest = len(runs), int(size[0]) if runs else 0
        codes = np.zeros((n, longest), np.uint32)
        codes[np.arange(longest) < size[:, None]] = np.frombuffer("".join([runs[i] for i in order]).encode("utf-32-le"), np.uint32)
        codes = np.ascontiguousarray(codes.T)
        best = np.zeros((longest + 1, n))
        back = np.full((longest + 1, n), -1, np.int32)
        state = np.zeros(n, np.int32)
        live = np.searchsorted(-size, -np.arange(longest), "left")  # runs longer than p
        for p, m in enumerate(live.tolist()):
            code = codes[p, :m]
            state = self.goto[state[:m], self.class_of[code]]
            top, piece = np.full(m, _LEAST), np.full(m, -1, np.int32)
            at = np.where(self.piece_at[state] >= 0, state, self.output[state])
            who = np.flatnonzero(at)
            while len(who):
                ending = self.piece_at[at[who]]
                value = best[p + 1 - self.sizes[ending], who] + self.scores[ending]
                more = value > top[who]
                top[who[more]], piece[who[more]] = value[more], ending[more]
                at[who] = self.output[at[who]]
                who = who[at[who] > 0]
            ending = self.single[code]
            value = best[p, :m] + self.scores[ending]
            more = value > top
            best[p + 1, :m] = np.where(more, value, top)
            back[p + 1, :m] = np.where(more, ending, piece)
        place, who, steps = size.copy(), np.flatnonzero(size), []
        while len(who):
            piece = back[place[who], who]
            steps.append((who, piece, place[who]))
            place[who] -= self.sizes[piece]
            who = who[place[who] > 0]
        if not steps:
            return [b""] * n
        owner, piece, place = (np.concatenate([x[k] for x in steps]) for k in range(3))
        first = np.lexsort((place, owner))
        owner, piece, place = owner[first], piece[first], place[first]
        ends = np.cumsum(np.bincount(owner, minlength=n)).tolist()
        bare = set(owner[piece < 0].tolist())
        packed, out, before = piece.astype(np.int32).tobytes(), [b""] * n, 0
        for k, (i, end) in enumerate(zip(order.tolist(), ends, strict=True)):
            if k in bare:
                ids = [[x] if x >= 0 else [self.byte_ids[b] for b in runs[i][e - 1].encode()]
                       for x, e in zip(piece[before:end].tolist(), place[before:end].tolist(), strict=True)]
                out[i] = np.array(list(chain.from_iterable(ids)), np.int32).tobytes()
            else:
                out[i] = packed[4 * before:4 * end]
            before = end
        return out

    def _runs(self, marked: str) -> list[str]:
        return _RUN.findall(marked) if self.cuts else [marked]

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text (empty: none). A space mark is put before it, as the library does."""
        coded = []
        for k, part in enumerate(text.split(MARK) if text else ()):
            marked = part.replace(" ", MARK)
            coded += [self.mark_bytes, *map(self.search, self._runs(marked))] if k else map(self.search, self._runs(MARK + marked))
        return np.frombuffer(b"".join(coded), np.int32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """``encode`` of each text. Runs not seen before are searched together and remembered, at most
        ``CACHE`` of them; long runs and texts with a literal mark are searched alone."""
        runs = [self._runs(MARK + t.replace(" ", MARK)) if t and MARK not in t else [] for t in texts]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = set(chain.from_iterable(runs)).difference(known)
        short = [r for r in new if len(r) <= LONGEST_CACHED]
        for i in range(0, len(short), 20_000):
            part = short[i:i + 20_000]
            known.update(zip(part, self.search_many(part), strict=True))
        long = {r: self.search(r) for r in new if len(r) > LONGEST_CACHED}
        of = ChainMap(known, long).__getitem__ if long else known.__getitem__
        return [self.encode(t) if t and MARK in t else np.frombuffer(b"".join(map(of, own)), np.int32) for t, own in zip(texts, runs, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids.tolist()])[1:].decode()


_CODECS: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """The codec of a model file's bytes, built once in a worker."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        model = f.read(MODEL_LIMIT + 1)
    if len(model) > MODEL_LIMIT:
        raise ValueError("the model file is over 64 MB")
    return docs.sparkSession.sparkContext.broadcast(model)


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``carry``..., token_ids, n_tokens, n_byte_tokens, round_trip) of every input row's whole text.

    ``model_path`` is read on the driver and sent to the tasks (at most 64 MB). A null text has null ids
    and null ``round_trip`` and no tokens; an empty text has no tokens. ``round_trip`` tells that decoding
    the ids gives the text again. Repeated rows give repeated results; no other column is read, those
    named in ``carry`` are passed on.
    """
    model = _model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                rows = batch.column("text").to_pylist()
                ids = [None if t is None else x for t, x in zip(rows, c.encode_all([t or "" for t in rows]), strict=True)]
                sizes = [0 if x is None else len(x) for x in ids]
                same = [None if x is None else c.decode(x) == t for x, t in zip(ids, rows, strict=True)]
                flat = np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*[x is None for x in ids], False]))
                n_bytes = [0 if x is None else int(c.is_byte[x].sum()) for x in ids]
                yield pa.record_batch([*(batch.column(x) for x in first), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())),
                                       pa.array(sizes, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(same, pa.bool_())],
                                      names=[*first, "token_ids", "n_tokens", "n_byte_tokens", "round_trip"])

    first = ["doc_id", *carry]
    source = docs.select(F.col(doc_id).alias("doc_id"), *carry, F.col(text).alias("text"))
    schema = T.StructType([*(source.schema[x] for x in first), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_byte_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return map_arrow(source, run, schema)


def decode(coded: DataFrame, model_path: str, doc_id: str = "doc_id", token_ids: str = "token_ids") -> DataFrame:
    """(doc_id, text) from token ids (null ids: null text)."""
    model = _model(coded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for batch in batches:
            out = [None if x is None else c.decode(np.array(x, np.int32)) for x in batch.column("token_ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    source = coded.select(F.col(doc_id).alias("doc_id"), F.col(token_ids).alias("token_ids"))
    return map_arrow(source, run, T.StructType([source.schema["doc_id"], T.StructField("text", T.StringType())]))
