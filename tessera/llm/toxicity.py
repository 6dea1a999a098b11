"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are runs of letters and digits. A token's features are its word, its beginnings of ``HEADS`` bytes, its last
bytes and the words beside it, hashed into one table of weights; tags are clean and toxic.

* Labelled tokens come from labelled documents. In a bounded sample of them (about ``PER_CLASS`` of each label, by a
  hash of the id, documents whole) the different surroundings of every word and every beginning are counted in
  toxic and in clean documents; copies of a document add no surroundings. Words and beginnings that are toxic beyond
  chance by a likelihood-ratio test tag the tokens of toxic documents; all tokens of clean documents are clean.
* The field is fitted on windows of these documents (``WINDOWS`` of a document at most, of ``WINDOW`` tokens) by gradient
  steps on the likelihood of the tags.
* Forward-backward marginals of whole texts give the offending offsets; a document's score is a logistic
  function of its confident marginals, fitted on the sampled documents at the label's true share.

The weights are of a fixed size and are sent to every task; scoring shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import map_arrow, written
from tessera.llm.words import hash_words, mix, slices, text_bytes, word_spans

PER_CLASS = 3000
WINDOW = 48
WINDOWS = 2
BITS = 18
LEXICON = 20_000
EVIDENCE = 15.0
STEPS = 40
HEADS = (3, 4, 5, 6, 7)
UNITS = 1 + len(HEADS)
FEATURES = UNITS + 3
#: marginals below this are no evidence of a document; from CONFIDENT on a token is an offending one
FAINT, CONFIDENT = 0.1, 0.5
TOXIC_AT = 0.7
_BLOCK = 64
#: letters and digits of ASCII and all other bytes stay, the rest separates tokens
_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.uint64(0x6A09E667F3BCC909)


@dataclass
class Tokens:
    """Tokens of a column of texts: hashes of the words and of the word and its beginnings (a row each), byte spans,
    the first token of each text (and the end), hashes of the words beside them, features."""

    data: np.ndarray
    words: np.ndarray
    units: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    before: np.ndarray
    after: np.ndarray
    features: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Tokens:
        data, offsets = text_bytes(column)
        plain = _PLAIN[data]
        words, first = hash_words(plain, offsets)
        starts, ends, _ = word_spans(plain, offsets)
        n = len(words)
        opens, closes = np.zeros(n, bool), np.zeros(n, bool)
        some = first[1:] > first[:-1]
        opens[first[:-1][some]] = True
        closes[first[1:][some] - 1] = True
        before = np.where(opens, _EDGE, np.roll(words, 1)) if n else words
        after = np.where(closes, _EDGE, np.roll(words, -1)) if n else words
        lower = _LOWER[plain].astype(np.uint64)
        head, tail, units = np.zeros(n, np.uint64), np.zeros(n, np.uint64), [words]
        for k in range(max(HEADS)):
            inside = starts + k < ends
            head[inside] = head[inside] << np.uint64(8) | lower[starts[inside] + k]
            if k < 3:
                tail[inside] = tail[inside] << np.uint64(8) | lower[ends[inside] - 1 - k]
            if k + 1 in HEADS:
                # a word without so many bytes has no such beginning
                units.append(np.where(inside, mix(head + np.uint64(k + 1)), _EDGE))
        low = np.uint64((1 << BITS) - 1)
        features = np.stack([(mix(x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFF_FFFF_FFFF_FFFF)) & low).astype(np.int32)
                             for k, x in enumerate((*units, before, after, tail))], axis=1) if n else np.zeros((0, FEATURES), np.int32)
        return cls(data, words, np.stack(units), starts, ends, first, before, after, features)

    def texts(self) -> np.ndarray:
        """The number of the text that each token stands in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _scan(m: np.ndarray) -> np.ndarray:
    """Vectors (2, n) after each of n matrices (4, n: by rows), starting with ones and up to a factor.

    Products within blocks run side by side; the vectors at which blocks begin come from the blocks' products.
    """
    n = m.shape[1]
    if n <= _BLOCK:
        out, u, v = np.empty((2, n)), 0.5, 0.5
        for k in range(n):
            a, b, c, d = m[:, k].tolist()
            u, v = u * a + v * c, u * b + v * d
            u, v = u / (u + v), v / (u + v)
            out[:, k] = u, v
        return out
    blocks = -(-n // _BLOCK)
    x = np.zeros((4, blocks * _BLOCK))
    x[0], x[3] = 1.0, 1.0
    x[:, :n] = m
    x = np.ascontiguousarray(x.reshape(4, blocks, _BLOCK).transpose(2, 0, 1))
    for k in range(1, _BLOCK):
        p, q = x[k - 1], x[k].copy()
        x[k, 0], x[k, 1] = p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3]
        x[k, 2], x[k, 3] = p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]
        x[k] /= x[k].sum(0)
    begin = np.full((2, blocks), 0.5)
    begin[:, 1:] = _scan(x[-1])[:, :-1]
    out = np.stack([begin[0] * x[:, 0] + begin[1] * x[:, 2], begin[0] * x[:, 1] + begin[1] * x[:, 3]])
    out /= out.sum(0)
    return np.ascontiguousarray(out.transpose(0, 2, 1)).reshape(2, -1)[:, :n]


@dataclass
class Model:
    """Weights of the field (toxic against clean), and the logistic function of a document's marginals."""

    weights: np.ndarray
    bias: float
    start: float
    moves: np.ndarray  # 2 x 2: from, to
    logistic: np.ndarray  # of what ``evidence`` gives

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Probability of the toxic tag of every token, each text being a chain of its own."""
        n = len(tokens.words)
        if not n:
            return np.zeros(0)
        e = np.exp(np.clip(self.weights[tokens.features].sum(1) + self.bias, -30, 30))
        move = np.exp(self.moves)
        m = np.stack([np.full(n, move[0, 0]), move[0, 1] * e, np.full(n, move[1, 0]), move[1, 1] * e])
        opens = tokens.first[:-1][np.diff(tokens.first) > 0]
        # equal rows: what came before has no say
        m[0, opens] = m[2, opens] = 1.0
        m[1, opens] = m[3, opens] = np.exp(self.start) * e[opens]
        m /= m.sum(0)
        forward = _scan(m)
        backward = np.full((2, n), 0.5)
        backward[:, :-1] = _scan(m[[0, 2, 1, 3]][:, :0:-1])[:, ::-1]
        both = forward * backward
        return both[1] / both.sum(0)

    def evidence(self, tokens: Tokens) -> np.ndarray:
        """(texts, 4): one, logarithms of the sum of all but faint marginals and of the tokens (plus one), highest marginal."""
        p, n = self.marginals(tokens), len(tokens.first) - 1
        sure = np.where(p >= FAINT, p, 0.0)
        top = np.zeros(n)
        some = np.diff(tokens.first) > 0
        if len(p):
            top[some] = np.maximum.reduceat(p, tokens.first[:-1][some])
        return np.stack([np.ones(n), np.log1p(np.bincount(tokens.texts(), sure, n)), np.log1p(np.diff(tokens.first)), top], axis=1)

    def scores(self, tokens: Tokens) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(tokens) @ self.logistic, -30, 30)))


def fit_field(features: np.ndarray, lengths: np.ndarray, tags: np.ndarray, steps: int = STEPS, penalty: float = 1e-3) -> tuple[np.ndarray, float, float, np.ndarray]:
    """(weights, bias, start, moves) from windows (n, WINDOW, features) with tags, by AdaGrad on the mean log-likelihood."""
    n, width, _ = features.shape
    live = np.arange(width) < lengths[:, None]
    flat, y = features[live], tags[live]
    weights, small = np.zeros(1 << BITS), np.zeros(6)  # bias, start, moves
    small[0] = -1.0
    square, small_square = np.zeros_like(weights), np.zeros_like(small)
    rows = np.arange(n)
    for _ in range(steps):
        e = np.zeros((n, width))
        e[live] = weights[flat].sum(1) + small[0]
        move = small[2:].reshape(2, 2)
        a, z = np.zeros((width, n, 2)), np.zeros((width, n, 2))
        a[0] = np.stack([np.zeros(n), small[1] + e[:, 0]], 1)
        for t in range(1, width):
            step = np.logaddexp(a[t - 1, :, :1] + move[0], a[t - 1, :, 1:] + move[1]) + np.stack([np.zeros(n), e[:, t]], 1)
            a[t] = np.where(live[:, t, None], step, a[t - 1])
        for t in range(width - 2, -1, -1):
            there = z[t + 1] + np.stack([np.zeros(n), e[:, t + 1]], 1)
            step = np.stack([np.logaddexp(move[i, 0] + there[:, 0], move[i, 1] + there[:, 1]) for i in range(2)], 1)
            z[t] = np.where(live[:, t + 1, None], step, 0.0)
        total = np.logaddexp(a[-1, :, 0], a[-1, :, 1])
        p = np.exp(a[:, :, 1] + z[:, :, 1] - total).T
        gradient = y - p[live]
        grad_small = np.zeros(6)
        grad_small[0] = gradient.sum()
        grad_small[1] = (tags[:, 0] - p[:, 0])[lengths > 0].sum()
        for t in range(1, width):
            on = live[:, t]
            there = z[t] + np.stack([np.zeros(n), e[:, t]], 1)
            for i in range(2):
                for j in range(2):
                    expected = np.exp(a[t - 1, :, i] + move[i, j] + there[:, j] - total)
                    seen = (tags[rows, t - 1] == i) & (tags[rows, t] == j)
                    grad_small[2 + 2 * i + j] += (seen[on] - expected[on]).sum()
        gradients = np.bincount(flat.ravel(), np.repeat(gradient, flat.shape[1]), 1 << BITS) - penalty * n * weights
        square += gradients * gradients
        weights += 0.5 * gradients / np.sqrt(square + 1e-8)
        small_square += grad_small * grad_small
        small += 0.2 * grad_small / np.sqrt(small_square + 1e-8)
    return weights, float(small[0]), float(small[1]), small[2:].reshape(2, 2)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's steps, with a small penalty on all but the constant."""
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6, *[penalty] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different (unit, surroundings, label) of a batch; units are words and beginnings."""
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            tokens = Tokens.of(batch.column("text"))
            around = mix(tokens.before * np.uint64(0xA24BAED4963EE407) + tokens.after)
            toxic = batch.column("toxic").to_numpy()[tokens.texts()].astype(np.uint64)
            for unit in tokens.units if len(around) else ():
                some = unit != _EDGE
                rows = np.unique(np.stack([unit[some], around[some], toxic[some]], 1), axis=0)
                yield pa.record_batch([pa.array(np.ascontiguousarray(rows[:, k]).view(np.int64)) for k in range(3)], names=["unit", "around", "toxic"])


def lexicon(sampled: DataFrame, evidence: float = EVIDENCE, most: int = LEXICON) -> np.ndarray:
    """Hashes of the words and beginnings that toxic documents use beyond chance, by their different surroundings (``most`` of them, the surest first)."""
    pairs = map_arrow(sampled.select("text", "toxic"), _contexts, "unit long, around long, toxic long").distinct()
    words = written(pairs.groupBy("unit").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")), "toxic-words")
    total = words.agg(F.sum("t"), F.sum("n")).first()
    if not total[0] or total[0] == total[1]:
        return np.zeros(0, np.uint64)
    share = total[0] / total[1]
    n, t = F.col("n"), F.col("t")
    ratio = 2 * (F.when(t > 0, t * F.log(t / (n * share))).otherwise(0.0) + F.when(n > t, (n - t) * F.log((n - t) / (n * (1 - share)))).otherwise(0.0))
    # twice the odds, not twice the share: where toxic documents hold half of all surroundings no share is twice theirs
    found = words.filter(t * (1 - share) > 2 * (n - t) * share).select("unit", ratio.alias("ratio")).filter(F.col("ratio") >= evidence)
    rows = found.orderBy(F.desc("ratio"), "unit").limit(most).select("unit").toArrow()
    return np.sort(rows.column("unit").to_numpy().view(np.uint64))


def _windows(toxic_words: np.ndarray) -> Callable:
    """Up to ``WINDOWS`` windows of each document, chosen by hash: of a toxic one only such as hold a labelled token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                tokens = Tokens.of(batch.column("text"))
                toxic = batch.column("toxic").to_numpy()
                tags = np.isin(tokens.units, toxic_words).any(0) & (toxic[tokens.texts()] == 1)
                out = []
                for i, (a, b) in enumerate(zip(tokens.first[:-1].tolist(), tokens.first[1:].tolist(), strict=True)):
                    starts = np.arange(a, b, WINDOW)
                    if toxic[i]:
                        starts = starts[np.logical_or.reduceat(tags[a:b], starts - a)] if b > a else starts
                    order = np.argsort(mix(tokens.words[starts] + starts.astype(np.uint64) - np.uint64(a)), kind="stable")
                    for s in starts[order[:WINDOWS]].tolist():
                        e = min(b, s + WINDOW)
                        out.append((e - s, tokens.features[s:e].tobytes(), tags[s:e].tobytes()))
                n, features, marks = zip(*out, strict=True) if out else ((), (), ())
                yield pa.record_batch([pa.array(n, pa.int32()), pa.array(features, pa.binary()), pa.array(marks, pa.binary())], names=["n", "features", "tags"])
    return run


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = PER_CLASS, seed: int = 3) -> Model:
    """The model fitted on about ``per_class`` documents of each label.

    ``labels`` has a row for each labelled document (``doc_id``, ``toxic`` 0 or 1); null labels and ids are left out, and a document
    that is labelled both ways counts as toxic. ``use`` is a condition on a column named ``doc_id`` of the labels. Where a label is missing
    altogether, the score is the toxic share of the labels for every text (0 without labels).
    """
    known = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null"))
    if use is not None:
        known = known.filter(use)
    known = written(known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("long").alias("toxic")), "labels")
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    blank = Model(np.zeros(1 << BITS), -30.0, 0.0, np.zeros((2, 2)), np.zeros(4))
    if len(n) < 2:
        blank.logistic[0] = 30.0 if n.get(1) else -30.0
        return blank
    share = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    bound = F.when(F.col("toxic") == 1, per_class / n[1]).otherwise(per_class / n[0])
    chosen = known.filter(share < bound)  # about 2 * per_class ids
    ids = chosen.select(F.col("doc_id").alias("known_id"), "toxic")
    sampled = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("known_id"))
    sampled = written(sampled.select("text", "toxic").filter("text is not null"), "sampled")
    words = lexicon(sampled)
    rows = map_arrow(sampled, _windows(words), "n int, features binary, tags binary").toArrow()
    found = dict(sampled.groupBy("toxic").count().collect())
    if not rows.num_rows or not len(words) or len(found) < 2:
        blank.logistic[0] = np.log(n[1] / n[0])
        return blank
    lengths = rows.column("n").to_numpy()
    features = np.zeros((len(lengths), WINDOW, FEATURES), np.int32)
    tags = np.zeros((len(lengths), WINDOW), np.int64)
    for i, (m, f, y) in enumerate(zip(lengths.tolist(), rows.column("features").to_pylist(), rows.column("tags").to_pylist(), strict=True)):
        features[i, :m] = np.frombuffer(f, np.int32).reshape(m, FEATURES)
        tags[i, :m] = np.frombuffer(y, bool)
    weights, bias, start, moves = fit_field(features, lengths, tags)
    model = Model(weights.astype(np.float32), bias, start, moves, np.zeros(4))
    seen = map_arrow(sampled, _measured(docs, model), "toxic long, one double, sum double, size double, top double").toArrow()
    y = seen.column("toxic").to_numpy()
    x = np.stack([seen.column(c).to_numpy() for c in ("one", "sum", "size", "top")], 1)
    model.logistic = fit_logistic(x, y, np.where(y == 1, n[1] / max(1, (y == 1).sum()), n[0] / max(1, (y == 0).sum())) / sum(n.values()) * len(y))
    return model


def _measured(docs: DataFrame, model: Model) -> Callable:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = sent.value.evidence(Tokens.of(batch.column("text")))
                yield pa.record_batch([batch.column("toxic"), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(4))], names=["toxic", "one", "sum", "size", "top"])
    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every input row, from its whole text alone.

    A null or empty text, and one without letters and digits, has the score of a text without evidence. Repeated rows get
    repeated results; an empty table gives no rows; no other column is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.record_batch([batch.column("doc_id"), pa.array(sent.value.scores(Tokens.of(batch.column("text"))))], names=["doc_id", "score"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(source, run, T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def spans(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least: float = CONFIDENT) -> DataFrame:
    """(doc_id, start, end, probability): the offending places of every text, in code points, end exclusive.

    Neighbouring tokens whose marginal is ``least`` or more are one span, with the highest of their marginals. Texts without
    such tokens (null and empty ones among them) have no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                tokens = Tokens.of(batch.column("text"))
                p, of = sent.value.marginals(tokens), tokens.texts()
                at = np.flatnonzero(p >= least)
                opens = np.ones(len(at), bool)
                opens[1:] = (np.diff(at) > 1) | (np.diff(of[at]) > 0)
                heads = np.flatnonzero(opens)
                tails = np.concatenate([heads[1:], [len(at)]])[:len(heads)] - 1
                # code points: bytes that begin a character
                points = np.concatenate([[0], np.cumsum((tokens.data & 0xC0) != 0x80)])
                own = of[at[heads]]
                _, offsets = text_bytes(batch.column("text"))
                base = points[offsets[own]]
                yield pa.record_batch([batch.column("doc_id").take(pa.array(own)), pa.array(points[tokens.starts[at[heads]]] - base), pa.array(points[tokens.ends[at[tails]]] - base),
                                       pa.array(np.maximum.reduceat(p[at], heads) if len(heads) else np.zeros(0))], names=["doc_id", "start", "end", "probability"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())]
    return map_arrow(source, run, T.StructType([source.schema["doc_id"], *fields]))
