"""Quality rules: a threshold table compiled into one projection of built-in expressions.

No user function, shuffle or join: every figure of a text is an expression over its own row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Very frequent function words, per language.
STOP_WORDS = {
    "en": "the be to of and that have with in is it for on was as are this not".split(),
    "de": "der die das und in den von zu mit sich auf für ist im dem nicht ein eine".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au".split(),
    "es": "de la que el en y los se del las un por con una para es al lo".split(),
}

#: (rule, figure, least, most); None leaves that side open. Figures are keys of ``figures``.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("length", "n_words", 50, 1_000_000),
    ("word_length", "mean_word_chars", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.05),
    ("stop_words", "stop_word_ratio", 0.01, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.50),
    ("repeats", "repeat_ratio", None, 0.50),
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once (an expression used inside a lambda is otherwise
    evaluated again for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")).cast("long")


def symbol_count(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def duplicate_lines(text: Column) -> tuple[Column, Column]:
    """Lines with a word, and those among them that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    pair = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return pair["n"], pair["dup"]


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words inside ``window``-word windows that occur twice or more in the text, the first included.

    Windows are hashed and sorted with their position, so equal ones are neighbours; the covered
    words are the union of the repeated windows. n log n in the length of the text.
    """

    def counted(ws: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(ws) - window + 1),
                            lambda i: F.struct(F.xxhash64(*[F.element_at(ws, i + k) for k in range(window)]).alias("h"), i.alias("i")))
        return bound(F.sort_array(grams), repeats)

    def repeats(g: Column) -> Column:
        n = F.size(g)
        last = F.lit(None).cast("long")
        hit = F.filter(g, lambda x, k: (F.coalesce(F.get(g, k - 1)["h"], last).eqNullSafe(x["h"]))
                       | (F.when(k + 1 < n, F.get(g, k + 1)["h"]).eqNullSafe(x["h"])))
        places = F.sort_array(F.transform(hit, lambda x: x["i"]))
        return bound(places, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    return bound(words, lambda ws: F.when(F.size(ws) < window + 1, F.lit(0).cast("long")).otherwise(counted(ws)))


def figures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stop_words: dict | None = None) -> DataFrame:
    """One row per input row with the counts and ratios the rules look at (null text: empty)."""
    stop = sorted({w for words in (stop_words or STOP_WORDS).values() for w in words})
    t = F.col("t")
    words = words_of(t)
    measured = bound(words, lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        repeated_words(ws).alias("n_repeat_words"),
        F.size(F.filter(ws, lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words")))
    lines, dups = duplicate_lines(t)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).select(
        "doc_id", measured.alias("m"), word_chars(t).alias("word_chars"), symbol_count(t).alias("n_symbols"),
        lines.alias("n_lines"), dups.alias("n_dup_lines"))
    n = F.greatest(F.col("m.n_words"), F.lit(1))
    return rows.select(
        "doc_id", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "m.n_stop_words", "n_lines",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbol_ratio"),
        (F.col("m.n_stop_words") / n).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("m.n_repeat_words") / n).alias("repeat_ratio"))


def failed_rules(rules: Sequence[tuple] = RULES) -> Column:
    """Names of the rules of the table that a row of ``figures`` fails, in table order."""
    def fails(figure: str, least: float | None, most: float | None) -> Column:
        out = F.lit(False)
        if least is not None:
            out = out | (F.col(figure) < least)
        if most is not None:
            out = out | (F.col(figure) > most)
        return out

    return F.filter(F.array(*[F.when(fails(f, lo, hi), F.lit(name)) for name, f, lo, hi in rules]), lambda x: x.isNotNull())


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Sequence[tuple] = RULES) -> DataFrame:
    """Figures of every document with ``failed`` (names of failed rules), ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated 3-word windows. A null or
    empty text has no words and fails. Repeated rows give repeated results; other columns are not read.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = figures(docs, doc_id, text).select("*", failed_rules(rules).alias("failed"), base.alias("base_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
