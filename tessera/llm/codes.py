"""Vector code compression: Lloyd's rounds by dual trees, in whole numbers.

Vectors become integers and are cut into equal parts; each part position has its own codebook. The vectors
are cut into chunks, and each chunk keeps, for every part position, a tree over its parts: boxes, sums and counts of
every node, and the parts in leaf order. These trees are written once. A round walks, in every chunk, the tree of
the parts against a small tree over the codebook's entries. A pair of nodes is dropped when no part of the one can
be nearer to any entry of the other than to the entry nearest the box's middle; a node of parts with one entry
left takes it whole, by its cached sum and count, and the parts of undecided leaves are compared in integers.
All bounds are exact integers and a tie never drops an entry, so the result is that of the plain rounds.

A round sends the codebooks out (parts * entries * width numbers, fixed by the parameters) and brings back a sum
and a count for each entry, added up by Spark; nothing else passes the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import map_arrow, ship, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LEAF = 16
CHUNK = 8192
#: components whose scaled value lies beyond have squared distances that a 64-bit number can't hold
LIMIT = 1 << 27


def widths(dim: int, parts: int) -> np.ndarray:
    """Where the parts of a vector begin and end: equal ones where ``dim`` is a multiple of ``parts``."""
    return np.linspace(0, dim, parts + 1).astype(int)


def integers(vectors: pa.Array, dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept (``dim`` components, none null, non-finite or out of range), and these as floor(scale * x)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.zeros(0, bool), np.zeros((0, dim), np.int64)
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    x = pc.list_flatten(vectors.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
        good = (np.abs(x) <= LIMIT).all(axis=1)  # a null arrives as NaN
    ok = np.zeros(len(vectors), bool)
    ok[at[good]] = True
    return ok, x[good].astype(np.int64)


def levels(n: int, leaf: int = LEAF) -> int:
    """Depth of a tree over ``n`` rows whose leaves hold about ``leaf`` of them."""
    return max(0, (max(n, 1) - 1) // leaf).bit_length()


def edges(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin in the leaf order, and the end."""
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


def tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, low, high, sums) over the rows: nodes level by level, each cut at the middle of its widest side."""
    n, dim = x.shape
    order, depth = np.arange(n), levels(n, leaf)
    low, high, sums = [], [], []
    for level in range(depth + 1):
        cut = edges(n, level)
        own = x[order]
        starts = cut[:-1]
        low.append(np.minimum.reduceat(own, starts))
        high.append(np.maximum.reduceat(own, starts))
        sums.append(np.add.reduceat(own, starts))
        if level < depth:
            node = np.repeat(np.arange(len(starts)), np.diff(cut))
            side = np.argmax(high[-1] - low[-1], axis=1)
            order = order[np.lexsort((own[np.arange(n), side[node]], node))]
    return order, np.concatenate(low), np.concatenate(high), np.concatenate(sums)


class Entries:
    """A tree over the different entries of one codebook; of equal entries only the first can win a part."""

    def __init__(self, book: np.ndarray) -> None:
        _, first = np.unique(book, axis=0, return_index=True)
        first = np.sort(first)
        order, low, high, _ = tree(book[first], 1)
        self.book, self.ids = book, first[order]
        self.depth = levels(len(first), 1)
        self.low, self.high = low, high

    def near(self, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Entries (columns in tree order) that some part of each box may still choose, out of the ones alive."""
        n, k = len(low), len(self.ids)
        book = self.book[self.ids]
        middle = low + high
        # twice the distance to the middle, so that it stays a whole number
        far = ((middle[:, None, :] - 2 * book) ** 2).sum(2)
        best = np.argmin(np.where(alive, far, np.iinfo(np.int64).max), axis=1)
        champion = book[best]
        out, open_, first = alive.copy(), np.ones((n, 1), bool), 0
        for level in range(self.depth + 1):
            count = 1 << level
            a, b = self.low[first:first + count], self.high[first:first + count]
            cut = edges(k, level)
            holds = np.add.reduceat(out, cut[:-1], axis=1) > 0
            open_ = open_[:, np.arange(count) >> 1 if level else [0]] & holds
            i, j = np.nonzero(open_)
            # the most by which the champion can be farther than an entry of the node, over both boxes
            most = np.full((len(i), low.shape[1]), np.iinfo(np.int64).min)
            for corner in (low[i], high[i]):
                there = np.clip(corner, a[j], b[j])
                np.maximum(most, (corner - champion[i]) ** 2 - (corner - there) ** 2, out=most)
            gone = most.sum(1) < 0
            open_[i[gone], j[gone]] = False
            out &= np.repeat(open_, np.diff(cut), axis=1)
            first += count
        out[np.arange(n), best] = True
        return out


def assign(points: np.ndarray, low: np.ndarray, high: np.ndarray, entries: Entries, leaf: int = LEAF) -> tuple[list, np.ndarray, np.ndarray]:
    """Whole nodes as (level, node numbers, entries), and the other parts of the leaf order with their entries."""
    n = len(points)
    depth, k = levels(n, leaf), len(entries.ids)
    whole, first = [], 0
    node, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(depth + 1):
        alive = entries.near(low[first + node], high[first + node], alive)
        sure = alive.sum(1) == 1
        whole.append((level, node[sure], entries.ids[np.argmax(alive[sure], axis=1)]))
        node, alive = node[~sure], alive[~sure]
        first += 1 << level
        if level < depth:
            node, alive = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([alive, alive])
    cut = edges(n, depth)
    sizes = cut[node + 1] - cut[node]
    at = np.repeat(cut[node] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    chosen = np.empty(len(at), np.int64)
    alive = np.repeat(alive, sizes, axis=0)
    inverse = np.argsort(entries.ids)
    for lo in range(0, len(at), 4096):
        far = ((points[at[lo:lo + 4096], None, :] - entries.book[entries.ids]) ** 2).sum(2)
        far = np.where(alive[lo:lo + 4096], far, np.iinfo(np.int64).max)
        # in the order of the codebook, so that the lower index wins a tie
        chosen[lo:lo + 4096] = entries.ids[inverse[np.argmin(far[:, inverse], axis=1)]]
    return whole, at, chosen


FOREST = "n int, vec_ids array<long>, labels array<long>, orders binary, points binary, lows binary, highs binary, sums binary"


def _forest(dim: int, parts: int, scale: int, chunk: int) -> Callable:
    """Chunks of kept vectors with the trees of their parts, one tree for each part position."""
    cuts = widths(dim, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = integers(batch.column("embedding"), dim, scale)
            kept = batch.filter(pa.array(ok))
            for i in range(0, len(x), chunk):
                own = x[i:i + chunk]
                built = [tree(own[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                packed = [b"".join(np.ascontiguousarray(y).astype(kind).tobytes() for y in column) for column, kind in (
                    ([t[0] for t in built], np.int32),
                    ([own[t[0], a:b] for t, a, b in zip(built, cuts[:-1], cuts[1:], strict=True)], np.int32),
                    ([t[1] for t in built], np.int32), ([t[2] for t in built], np.int32), ([t[3] for t in built], np.int64))]
                part = kept.slice(i, chunk)
                yield pa.record_batch([pa.array([len(own)], pa.int32()), pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                                       pa.array([part.column("label").to_pylist()], pa.list_(pa.int64())), *(pa.array([p], pa.binary()) for p in packed)],
                                      names=["n", "vec_ids", "labels", "orders", "points", "lows", "highs", "sums"])
    return run


def _trees(row: dict, dim: int, parts: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(order, points, low, high, sums) of each part position of a chunk."""
    n, cuts = row["n"], widths(dim, parts)
    nodes = (2 << levels(n)) - 1
    at = dict.fromkeys(("points", "lows", "highs", "sums"), 0)

    def take(name: str, kind: type, rows: int, width: int) -> np.ndarray:
        out = np.frombuffer(row[name], kind, rows * width, at[name]).reshape(rows, width).astype(np.int64)
        at[name] += rows * width * np.dtype(kind).itemsize
        return out

    orders = np.frombuffer(row["orders"], np.int32).reshape(parts, n)
    for j in range(parts):
        w = int(cuts[j + 1] - cuts[j])
        yield orders[j], take("points", np.int32, n, w), take("lows", np.int32, nodes, w), take("highs", np.int32, nodes, w), take("sums", np.int64, nodes, w)


_TREES = ["n", "orders", "points", "lows", "highs", "sums"]


def _summed(books: list[np.ndarray], dim: int, parts: int) -> Callable:
    """Sum and count of the parts that each entry takes, over the chunks of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [Entries(b) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for row in batch.select(_TREES).to_pylist():
                for j, (_, points, low, high, total) in enumerate(_trees(row, dim, parts)):
                    whole, at, chosen = assign(points, low, high, entries[j])
                    first = 0
                    for level, node, entry in whole:
                        np.add.at(sums[j], entry, total[first + node])
                        np.add.at(counts[j], entry, np.diff(edges(row["n"], level))[node])
                        first += 1 << level
                    np.add.at(sums[j], chosen, points[at])
                    counts[j] += np.bincount(chosen, minlength=len(counts[j]))
        part, entry = zip(*((j, e) for j, c in enumerate(counts) for e in np.flatnonzero(c).tolist()), strict=True) if any(c.any() for c in counts) else ((), ())
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array([int(counts[j][e]) for j, e in zip(part, entry, strict=True)], pa.int64()),
                               pa.array([sums[j][e].tolist() for j, e in zip(part, entry, strict=True)], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
    return run


def _coded(books: list[np.ndarray], dim: int, parts: int) -> Callable:
    """Entry of every part of every vector, and its squared distances summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [Entries(b) for b in books]
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                codes, error = np.empty((n, parts), np.int64), np.zeros(n, np.int64)
                for j, (order, points, low, high, _) in enumerate(_trees(row, dim, parts)):
                    whole, at, chosen = assign(points, low, high, entries[j])
                    own = np.empty(n, np.int64)
                    own[at] = chosen
                    for level, node, entry in whole:
                        cut = edges(n, level)
                        for a, b, e in zip(cut[node].tolist(), cut[node + 1].tolist(), entry.tolist(), strict=True):
                            own[a:b] = e
                    codes[order, j] = own
                    error[order] += ((points - books[j][own]) ** 2).sum(1)
                text = ["".join(map("{:02x}".format, c)) for c in codes.tolist()]
                yield pa.record_batch([pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.int64()), pa.array(text, pa.string()), pa.array(error)],
                                      names=["vec_id", "label", "code", "error"])
    return run


class Codebooks:
    """The entries of each part position, in whole numbers, for vectors of ``dim`` components."""

    def __init__(self, books: list[np.ndarray], dim: int, scale: int) -> None:
        self.books, self.dim, self.scale = books, dim, scale

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.reshape(-1).tolist()).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for."""
        return np.concatenate([b[int(code[2 * j:2 * j + 2], 16)] for j, b in enumerate(self.books)]) / self.scale


def fit(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS, scale: int = SCALE, chunk: int = CHUNK) -> tuple[Codebooks | None, DataFrame | None]:
    """Codebooks after ``rounds`` rounds over all kept vectors, and the written chunks. None where no vector is kept.

    The dimension is that of the vector with the smallest id among those without null or non-finite components. The first entries
    are those of the ``entries`` smallest ids (a null id comes last; of rows that repeat an id, the least vector),
    fewer where there are fewer ids.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).cast("long").alias("label"))
    sound = rows.filter(F.expr(f"size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(floor(x * {scale}D)) <= {LIMIT})"))
    first = sound.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.asc_nulls_last("vec_id")).limit(1).collect()
    if not first:
        return None, None
    dim = len(first[0].embedding)
    least = sound.filter(F.size("embedding") == dim)
    ids = [r.vec_id for r in least.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    chosen = F.col("vec_id").isin([i for i in ids if i is not None])
    if None in ids:
        chosen = chosen | F.col("vec_id").isNull()
    start = least.filter(chosen).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.asc_nulls_last("vec_id")).toArrow()
    _, x = integers(start.column("embedding"), dim, scale)
    cuts = widths(dim, parts)
    books = [x[:, a:b].copy() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    forest = written(map_arrow(rows, _forest(dim, parts, scale, chunk), FOREST), "trees")
    ship(vectors.sparkSession)
    for _ in range(rounds):
        sums = map_arrow(forest, _summed(books, dim, parts), "part int, entry int, n long, sums array<long>")
        wide = int(np.diff(cuts).max())
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(wide)])
        books = [b.copy() for b in books]
        for row in total.collect():  # parts * entries rows at most
            w = books[row.part].shape[1]
            books[row.part][row.entry] = [row[f"s{i}"] // row.n for i in range(w)]
    return Codebooks(books, dim, scale), forest


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", **options: int) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector.

    Rows whose vector is null, empty or holds null or non-finite components are dropped, and so are those of another
    length than the first id's and those with a component beyond ``LIMIT`` / ``SCALE``, whose squared distances no long
    holds. Rows that repeat an id count and are coded each. Ties go to the lower entry. ``label_error`` sums over equal labels,
    null ones together. An empty table gives no rows. No other column is read.
    """
    books, forest = fit(vectors, vec_id, embedding, label, **options)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(map_arrow(forest, _coded(books.books, books.dim, len(books.books)), "vec_id long, label long, code string, error long"), "codes")
    by_label = coded.groupBy(F.col("label").alias("known")).agg(F.sum("error").alias("label_error"))
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("known")))
            .select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")))
