"""Embedding near-dedup by product quantisation.

Vectors are scaled to length one. Coarse centroids cut them into inverted lists; the residual to the own
centroid is coded by subspace codebooks. A vector probes the lists of its nearest centroids: a table of
distances from its residual to every codeword gives approximate distances by lookup. The error of a
stored code is known when it is made, so a pair is passed on whenever the approximate distance less that
error could still mean the cosine asked for; the cosine in double precision then decides.

Centroids and codebooks are fitted on a bounded sample (``SAMPLE`` vectors, by hash of the id); every vector
is indexed and every vector is a query. Centroids that lie within reach of each other are one: where many near
copies of a vector draw centroids to themselves, their links would be spread over more lists than are
probed. Lists are cut into blocks of about ``TILE`` rows on both sides, so a
hot list is many small tiles. Tiles give sums of links and a spanning set of edges, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import components, map_arrow, ship, written

COSINE = 0.93
SAMPLE = 16_384
LISTS_MOST = 1024
SUBSPACES = 8
CODEWORDS = 64
PROBES = 12
TILE = 2048
SEED = 11


def usable(vectors: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can link (not null, no null or non-finite component, not zero), and these in double precision."""
    rows = vectors.to_pylist()
    ok = np.zeros(len(rows), bool)
    out = []
    for i, v in enumerate(rows):
        if v and None not in v and (dim is None or len(v) == dim):
            x = np.array(v, np.float64)
            norm = np.abs(x).max() if np.isfinite(x).all() else 0.0
            if norm > 0:
                ok[i] = True
                x = x / norm
                out.append(x / math.sqrt(float(x @ x)))
    return ok, np.array(out) if out else np.zeros((0, dim or 0))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


def apart(centres: np.ndarray, reach: float) -> np.ndarray:
    """The centroids of which no two lie within ``reach``: one with the most others near it stands for these."""
    square = (centres * centres).sum(1)
    close = square[:, None] + square - 2 * (centres @ centres.T) <= reach * reach
    left, kept = np.ones(len(centres), bool), []
    for i in np.argsort(-close.sum(1), kind="stable"):
        if left[i]:
            kept.append(i)
            left &= ~close[i]
    return centres[kept]


def span(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``root`` (of every node) after the edges ``u``-``v``: all nodes that these join get their least node."""
    while len(u):
        root = root.copy()
        ru, rv = root[u], root[v]
        open_ = ru != rv
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, seed: int = SEED, reach: float = 0.0) -> None:
        rng = np.random.default_rng(seed)
        self.centres = apart(kmeans(sample, lists, 6, rng), reach)
        dim = sample.shape[1]
        self.cuts = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.books = [kmeans(rest[:, a:b], codewords, 6, rng) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.centres * self.centres).sum(1) - 2 * (x @ self.centres.T)
        n = min(n, d.shape[1])
        near = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the codes leave out."""
        rest = x - self.centres[home]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for j, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            codes[:, j] = nearest(rest[:, a:b], self.books[j])
            error += ((rest[:, a:b] - self.books[j][codes[:, j]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def distances(self, query: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Approximate distances of queries to the coded vectors of one list, by table lookup."""
        rest = query - self.centres[home]
        total = np.zeros((len(query), len(codes)))
        for j, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            book = self.books[j]
            table = (rest[:, a:b] ** 2).sum(1)[:, None] + (book * book).sum(1) - 2 * (rest[:, a:b] @ book.T)
            total += table[:, codes[:, j]]
        return np.sqrt(np.maximum(total, 0))


def fit(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, lists_most: int = LISTS_MOST,
        cosine: float = COSINE) -> Index | None:
    """An index fitted on about ``sample`` vectors chosen by hash of the id (all, if there are fewer).

    The number of lists follows the square root of the number of vectors up to ``lists_most``, less the
    centroids nearer each other than vectors of that cosine. Only vectors that can link are counted and drawn; None if there are none.
    """
    sound = (f"size({embedding}) > 0 and forall({embedding}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
             f"and exists({embedding}, x -> x <> 0)")
    vectors = vectors.filter(F.expr(sound))
    n = vectors.count()
    share = F.pmod(F.xxhash64(F.lit(SEED), F.col(vec_id)), F.lit(1 << 30)) / float(1 << 30)
    numbers = F.col(embedding).cast("array<double>").alias("embedding")
    rows = vectors.filter(share < sample / max(n, 1)).select(numbers).toArrow()
    if n and not rows.num_rows:  # the hash may pass over all of a few vectors
        rows = vectors.select(numbers).limit(sample).toArrow()
    column = rows.column("embedding").combine_chunks()
    sizes = [len(v) for v in column.to_pylist() if v]
    if not sizes:
        return None
    _, x = usable(column, max(set(sizes), key=sizes.count))
    return Index(x, max(1, min(lists_most, math.isqrt(n), len(x))), reach=math.sqrt(2 - 2 * cosine)) if len(x) else None


ROW = "label long, home int, vec_id long, x binary, codes binary, error double, near array<int>"


def _indexed(index: Index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = usable(batch.column("embedding"), index.centres.shape[1])
            near = index.probes(x, PROBES) if len(x) else np.zeros((0, 1), int)
            codes, error = index.encode(x, near[:, 0])
            part = batch.filter(pa.array(ok))
            yield pa.record_batch([part.column("label"), pa.array(near[:, 0], pa.int32()), part.column("vec_id"), pa.array([v.tobytes() for v in x], pa.binary()),
                                   pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))],
                                  names=["label", "home", "vec_id", "x", "codes", "error", "near"])
    return run


def _tile(index: Index, cosine: float) -> Callable:
    """Links between the queries and the stored vectors of one tile: sums for each vector, and edges that
    join whatever the tile joins."""
    reach = math.sqrt(2 - 2 * cosine) + 1e-9

    def run(key: tuple, table: pa.Table) -> pa.Table:
        home = key[1].as_py()
        stored = table.filter(pc.equal(table.column("stored"), True))
        asked = table.filter(pc.equal(table.column("stored"), False))
        ids, links, u, v = [], [], [], []
        if stored.num_rows and asked.num_rows:
            dim, m = index.centres.shape[1], len(index.books)

            def column(t: pa.Table, name: str, kind: type, width: int) -> np.ndarray:
                return np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(-1, width)

            db, q = column(stored, "x", np.float64, dim), column(asked, "x", np.float64, dim)
            codes, error = column(stored, "codes", np.uint8, m), stored.column("error").to_numpy()
            db_id, q_id = stored.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
            q_home = asked.column("home").to_numpy()
            near = np.zeros((len(db), len(index.centres)), bool)
            rows = stored.column("near").to_pylist()
            near[np.repeat(np.arange(len(db)), [len(x) for x in rows]), np.concatenate(rows)] = True
            nodes, at = np.unique(np.concatenate([q_id, db_id]), return_inverse=True)
            q_at, db_at = at[:len(q)], at[len(q):]
            count, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
            for lo in range(0, len(q), 256):
                part = q[lo:lo + 256]
                i, j = np.nonzero(index.distances(part, home, codes) - error <= reach)
                other = q_id[lo + i] != db_id[j]
                i, j = i[other], j[other]
                true = np.concatenate([np.einsum("ij,ij->i", part[i[k:k + 65536]], db[j[k:k + 65536]]) >= cosine for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
                i, j = lo + i[true], j[true]
                count += np.bincount(q_at[i], minlength=len(nodes))
                # the stored vector does not ask where the query lives
                count += np.bincount(db_at[j[~near[j, q_home[i]]]], minlength=len(nodes))
                root = span(root, q_at[i], db_at[j])
            ids, links = nodes[count > 0], count[count > 0]
            u, v = nodes[root != np.arange(len(nodes))], nodes[root[root != np.arange(len(nodes))]]
        blank = [None]
        return pa.table({"vec_id": pa.array([*ids, *blank * len(u)], pa.int64()), "links": pa.array([*links, *blank * len(u)], pa.int64()),
                         "a": pa.array([*blank * len(ids), *u], pa.int64()), "b": pa.array([*blank * len(ids), *v], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE,
                    tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every input row.

    Vectors link when their labels are equal and not null and their cosine is at least ``cosine``. A vector
    that is null, zero, of another length than most, or holds null or non-finite components links with
    nothing and is its own component. Rows that repeat a vec_id are one vector (the first by its values) and get
    the same result; a null vec_id has no links and a null component. No other column is read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).cast("long").alias("label"))
    index = fit(rows, cosine=cosine)
    one = rows.filter("vec_id is not null and label is not null").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")).select("vec_id", "x.*")
    if index is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    listed = written(map_arrow(one.select("label", "vec_id", "embedding"), _indexed(index), ROW), "listed")
    # every list's blocks on both sides, from exact counts
    asks = listed.withColumn("list", F.explode("near"))
    blocks_of = lambda df, name: df.groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))
    sizes = written(blocks_of(listed.withColumn("list", F.col("home")), "n_stored").join(blocks_of(asks, "n_asked"), ["label", "list"]), "list-sizes")
    columns = ["label", "list", "block", "part", "stored", "vec_id", "home", "x", "codes", "error", "near"]
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = (listed.withColumn("list", F.col("home")).join(sizes, ["label", "list"]).withColumn("block", spread("n_stored")).withColumn("part", every("n_asked"))
              .withColumn("stored", F.lit(True)).select(*columns))
    asked = (asks.join(sizes, ["label", "list"]).withColumn("part", spread("n_asked")).withColumn("block", every("n_stored"))
             .withColumn("stored", F.lit(False)).withColumn("near", F.lit(None).cast("array<int>")).withColumn("codes", F.lit(None).cast("binary")).select(*columns))
    ship(vectors.sparkSession)
    found = written(stored.unionByName(asked).groupBy("label", "list", "block", "part")
                    .applyInArrow(_tile(index, cosine), "vec_id long, links long, a long, b long"), "links")
    links = found.filter("vec_id is not null").groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    groups = components(found.filter("a is not null").select("a", "b"))
    return (rows.select("vec_id").join(links, "vec_id", "left").join(groups.withColumnRenamed("id", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
