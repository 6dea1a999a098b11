"""Language identification by word-first backoff.

The model holds log frequencies per language of its frequent words and of character n-grams. A word of
a text that is known is scored by its own frequencies; an unknown word is cut into the longest known
character n-grams (falling back to shorter ones). An unknown word weighs one word, and one more for every
``LONG`` n-grams beyond the first ``LONG``: text without blanks is read whole. A text's language has the highest total.

The model is fitted on a bounded sample: about ``per_language`` documents of each language, chosen by
a hash of their id (all of them where a language has fewer). Its tables are bounded by ``words`` and
``grams`` entries per language, so it may be sent to every task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import map_arrow, ship, written
from tessera.llm.words import mix, slices

PER_LANGUAGE = 4000
WORDS = 20_000
GRAMS = 20_000
LONGEST = 4
LONG = 20
CACHE = 100_000
SLICE = 2 << 20
UNDETERMINED = "und"


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


def tokens_of(texts: pa.Array) -> pa.ListArray:
    """Lower-cased tokens of every text (null: none)."""
    return pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, use: Column | None, per_language: int) -> DataFrame:
    """(lang, text) of about ``per_language`` documents of each language, by a hash of the id."""
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    if use is not None:
        labelled = labelled.filter(use)
    counts = written(labelled.groupBy(F.col(lang).alias("known")).agg(F.count(F.lit(1)).alias("n")), "language-counts")
    share = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 20)) / float(1 << 20)
    return (labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), share.alias("share"))
            .join(counts, F.col("lang") == F.col("known")).filter(F.col("share") < per_language / F.col("n")).select("lang", "text"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language of words and of the n-grams of each word, within a partition."""
    total: dict[tuple[str, int], Counter] = {}
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            for lang in set(batch.column("lang").to_pylist()):
                found = tokens_of(batch.filter(pc.equal(batch.column("lang"), lang)).column("text")).flatten().value_counts()
                words = total.setdefault((lang, 0), Counter())
                for token, count in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                    words[letters(token)] += count
                words.pop("", None)
    for (lang, _), words in list(total.items()):
        for n in range(1, LONGEST + 1):
            own = total[lang, n] = Counter()
            for word, count in words.items():
                for gram in grams_of(word, n):
                    own[gram] += count
    for (lang, n), own in total.items():
        items = list(own.items())
        for i in range(0, len(items), 50_000):
            part = items[i:i + 50_000]
            yield pa.record_batch([pa.array([lang] * len(part)), pa.array([n] * len(part), pa.int32()),
                                   pa.array([k for k, _ in part]), pa.array([v for _, v in part], pa.int64())],
                                  names=["lang", "n", "unit", "count"])


class Model:
    """Log frequencies of units (words at 0, n-grams at n): one row of a matrix with a value per language."""

    def __init__(self, table: pa.Table) -> None:
        self.langs = sorted(set(table.column("lang").to_pylist()))
        position = {lang: i for i, lang in enumerate(self.langs)}
        at = np.array([position[lang] for lang in table.column("lang").to_pylist()], np.int64)
        kind, count, total = (table.column(c).to_numpy() for c in ("n", "count", "total"))
        self.rows: list[np.ndarray] = []
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []
        self.units: list[list[str]] = []
        for n in range(LONGEST + 1):
            own = kind == n
            coded = table.column("unit").filter(pa.array(own)).combine_chunks().dictionary_encode()
            units, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            counts, totals = np.zeros((len(units), len(self.langs))), np.ones(len(self.langs))
            counts[place, at[own]] = count[own]
            totals[at[own]] = total[own]
            logs = np.log((counts + 0.5) / (totals + 0.5 * (len(units) + 1)))
            self.units.append(units)
            self.rows.append(logs - logs.max(axis=1, keepdims=True) if len(units) else logs)
            if n:
                keys = _chain(np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(-1, n).T) if units else np.zeros(0, np.uint64)
                order = np.argsort(keys)
                self.keys.append((keys[order], order))
        self.words = {u: i for i, u in enumerate(self.units[0])}
        # scores of tokens met before: logarithms, shares, stretches; whether a token holds a letter
        self.known: dict[str, int] = {}
        self.values = np.zeros((0, 2 * len(self.langs) + 2))

    def unknown(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log scores of words that are not known, a row for each stretch, and the word of each row: one row for every
        ``LONG`` known n-grams, taken from long to short at each place (a shorter rest belongs to the last row)."""
        padded = [f" {w} " for w in words]
        size = np.array([len(p) for p in padded], np.int64)
        code = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
        n = len(code)
        left = np.repeat(np.cumsum(size), size) - np.arange(n)  # characters up to the word's end
        which, row = np.zeros(n, np.int64), np.zeros(n, np.int64)
        key = np.zeros(n, np.uint64)
        for k in range(1, LONGEST + 1):
            key = _link(key, np.concatenate([code[k - 1:], np.zeros(k - 1, np.uint32)]), k)
            keys, order = self.keys[k - 1]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                found = (keys[at] == key) & (left >= k)
                which[found], row[found] = k, order[at[found]]
        word = np.repeat(np.arange(len(words)), size)
        used = which > 0
        which, row, owner = which[used], row[used], word[used]
        count = np.bincount(owner, minlength=len(words))
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        stretches = np.maximum(1, count // LONG)
        base = np.cumsum(stretches) - stretches
        stretch = base[owner] + np.minimum(place // LONG, stretches[owner] - 1)
        values = np.zeros((len(owner), len(self.langs)))
        for k in range(1, LONGEST + 1):
            values[which == k] = self.rows[k][row[which == k]]
        total = int(stretches.sum())
        out = np.stack([np.bincount(stretch, values[:, i], total) for i in range(len(self.langs))], 1)
        return out / np.maximum(1, np.bincount(stretch, minlength=total))[:, None], np.repeat(np.arange(len(words)), stretches)

    def scored(self, tokens: list[str]) -> np.ndarray:
        """For each token: log scores summed over its stretches, shares summed over its telling ones, their number, and
        whether it holds a letter."""
        n, words = len(self.langs), [letters(t) for t in tokens]
        out = np.zeros((len(tokens), 2 * n + 2))
        at = np.array([self.words.get(w, -1) for w in words], np.int64)
        has = np.array([bool(w) for w in words], bool)
        new = np.flatnonzero(has & (at < 0))
        rows, owner = np.zeros((len(tokens), n)), np.arange(len(tokens))
        rows[at >= 0] = self.rows[0][at[at >= 0]]
        if len(new):
            more, of = self.unknown([words[i] for i in new])
            old = np.ones(len(tokens), bool)
            old[new] = False
            rows, owner = np.concatenate([rows[old], more]), np.concatenate([owner[old], new[of]])
        share = np.exp(np.maximum(rows - rows.max(axis=1, keepdims=True), -50))
        share /= share.sum(axis=1, keepdims=True)
        telling = rows.any(axis=1)
        for i in range(n):
            out[:, i] = np.bincount(owner, rows[:, i], len(tokens))
            out[:, n + i] = np.bincount(owner[telling], share[telling, i], len(tokens))
        out[:, 2 * n] = np.bincount(owner[telling], minlength=len(tokens))
        out[:, 2 * n + 1] = has
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. Every distinct token of the texts is scored once; sums follow the texts' tokens."""
        n = len(self.langs)
        if not n or not len(texts):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        tokens = tokens_of(texts)
        coded = tokens.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self.known, self.values = {}, self.values[:0]
        new = [t for t in distinct if t not in self.known]
        self.values = np.concatenate([self.values, *(self.scored(new[i:i + 20_000]) for i in range(0, len(new), 20_000))])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        at = np.array([self.known[t] for t in distinct], np.int64)[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy())])
        total = np.zeros((len(texts), 2 * n + 2))
        some = ends[1:] > ends[:-1]
        if some.any():
            total[some] = np.add.reduceat(self.values[at], ends[:-1][some])
        best = total[:, :n].argmax(1)
        stretches = total[:, 2 * n]
        # mean over the words, and stretches of long unknown ones, of the winner's share of each
        share = np.where(stretches > 0, total[np.arange(len(texts)), n + best] / np.maximum(1, stretches), 1 / n)
        letter = total[:, 2 * n + 1] > 0
        return [self.langs[i] if x else UNDETERMINED for i, x in zip(best.tolist(), letter.tolist(), strict=True)], np.where(letter, share, 0.0)


def _link(key: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """The key of an n-gram from that of its first n - 1 characters."""
    return mix(key * np.uint64(0x9E3779B97F4A7C15) + code.astype(np.uint64) + np.uint64(n << 32))


def _chain(codes: np.ndarray) -> np.ndarray:
    key = np.zeros(codes.shape[1], np.uint64)
    for n, code in enumerate(codes, 1):
        key = _link(key, code, n)
    return key


_MODELS: dict[bytes, Model] = {}


def _model(table: bytes) -> Model:
    """The model of these bytes, built once in a worker."""
    key = hashlib.sha256(table).digest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(pa.ipc.open_stream(table).read_all())
    return _MODELS[key]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", use: Column | None = None,
        per_language: int = PER_LANGUAGE, words: int = WORDS, grams: int = GRAMS) -> pa.Table:
    """The model's table (lang, n, unit, count, total); n is 0 for words. At most ``words`` + 4 * ``grams`` rows a language."""
    parts = sample(docs, doc_id, text, lang, use, per_language).repartition(24)
    counts = (map_arrow(parts, _counted, "lang string, n int, unit string, count long")
              .groupBy("lang", "n", "unit").agg(F.sum("count").alias("count")))
    totals = counts.groupBy("lang", "n").agg(F.sum("count").alias("total"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang", "n").orderBy(F.desc("count"), "unit")))
    top = ranked.filter(F.col("rank") <= F.when(F.col("n") == 0, words).otherwise(grams)).drop("rank")
    return top.join(totals, ["lang", "n"]).select("lang", "n", "unit", "count", "total").toArrow()


def _sent(docs: DataFrame, table: pa.Table) -> Broadcast:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def predict(docs: DataFrame, table: pa.Table, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every input row, from its text alone.

    ``und`` with score 0 where the text is null, holds no letter, or nothing was learned. ``score`` is the
    mean share of the predicted language over the text's words (a long unknown word counts once for every ``LONG`` n-grams). Ties go to the first language by name.
    """
    model = _sent(docs, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model.value)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                langs, scores = m.predict(batch.column("text"))
                yield pa.record_batch([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(source, run, T.StructType([source.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def keep(docs: DataFrame, table: pa.Table, text: str = "text", least: float = 0.3, langs: tuple[str, ...] | None = None) -> DataFrame:
    """The rows, as they are, whose predicted language is determined with a score of ``least`` or more
    (and is one of ``langs``, if given). Nothing is shuffled; only the text goes to the Python worker."""
    model = _sent(docs, table)
    ship(docs.sparkSession)

    @F.arrow_udf("boolean")
    def wanted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = _model(model.value)
        for whole in texts:
            out = []
            for batch in slices(pa.record_batch([whole], names=["text"]), "text", SLICE):
                found, scores = m.predict(batch.column("text"))
                out += [lang != UNDETERMINED and score >= least and (langs is None or lang in langs) for lang, score in zip(found, scores.tolist(), strict=True)]
            yield pa.array(out, pa.bool_())

    return docs.filter(wanted(F.col(text)))
