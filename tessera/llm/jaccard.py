"""N-gram Jaccard join: documents that share most of their word shingles, and the groups they form.

1. Each text becomes its sorted distinct shingle hashes, a digest of that set and a hashed bitmap (512
   parities). Texts with equal sets are one from here on.
2. Two sets with the similarity asked for must meet in the first ``n - ceil(t n) + 1`` of their hashes in any
   fixed order of all hashes. Hashes that many sets have near the front are moved behind all others (in a
   second reading of the texts), so a passage that a third of the documents share makes no hot group. Which
   ones are moved changes the work, not the result: any order is valid. Counting the hashes takes packed
   blocks by hash range, a batch's repeats first summed; only sets' hashes that repeat become rows.
3. Sets that meet under a hash are first compared with the least id there. Bit counts of the two bitmaps
   bound the overlap from above; pairs that pass are decided on the sorted arrays.
4. What these links join needs no more comparing. Where a hash still holds several groups, its sets are cut
   into tiles by size band and block; all but the members of its largest group are compared with every set
   in reach of their size, again bitmap first, and the pairs that pass are decided on the arrays.
5. Connected components of all links.

Only sums, minima and filtered pairs leave a group; no task holds a group's members, nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import bit_set, components, in_bits, map_arrow, ship, written
from tessera.llm.words import from_planes, hash_ranges, mix, planes, shingle_sets, slices

WORDS = 5
#: similarity as a fraction of whole numbers: 100 * intersection >= 80 * union
NUMERATOR, DENOMINATOR = 80, 100
FREQUENT = 64
BITMAP = 512
BLOCK = 1024
KEY_BYTES = 5
_MAPS = [f"b{i}" for i in range(BITMAP // 64)]


def _front(s: np.ndarray, numerator: int, denominator: int, moved: np.ndarray | None) -> np.ndarray:
    """The hashes of a set of which one must be shared: its first ones, moved hashes being behind all others."""
    n = len(s)
    if moved is not None and n:
        common = in_bits(mix(s), moved)
        s = np.concatenate([s[~common], s[common]])
    return s[:n - -(-numerator * n // denominator) + 1] if n else s


def _digest(s: np.ndarray) -> tuple[int, int]:
    two = np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(two[0]), int(two[1])


def _counted(fronts: list[np.ndarray], ranges: int) -> tuple[list, list, list, list]:
    """Mixed hashes of a batch's fronts, summed and cut by range: numbers, single ones, repeated ones, their times."""
    keys, times = np.unique(mix(np.concatenate([np.zeros(0, np.uint64), *fronts])), return_counts=True)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for part, a, b in hash_ranges(keys, ranges):
        once = times[a:b] == 1
        for column, value in zip(out, (part, planes(keys[a:b][once], KEY_BYTES), planes(keys[a:b][~once], KEY_BYTES), times[a:b][~once].astype(np.uint32).tobytes()), strict=True):
            column.append(value)
    return out


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of the hashes' low bits, in a power of two of bits not below the set's size (512 at least)."""
    width = max(BITMAP, 1 << max(0, len(s) - 1).bit_length())
    bits = np.bincount((mix(s) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The same set's bitmap in fewer bits: parities of parities."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


def _reachable(numerator: int, denominator: int) -> Callable:
    """Pairs whose overlap, bounded by the bit counts of their whole bitmaps, allows the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(p), len(q))
                most = (n + m - int(np.bitwise_count(_folded(p, words) ^ _folded(q, words)).sum())) // 2
                keep.append(denominator * most >= numerator * (n + m - most))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


MEASURED = "kind int, doc_id long, n long, d0 long, d1 long, front array<long>, " + ", ".join(f"{b} long" for b in _MAPS) + ", bitmap binary, part int, once binary, more binary, times binary"


def _measured(words: int, numerator: int, denominator: int, ranges: int, moved: bytes | None, doubled: bytes | None) -> Callable:
    """Rows of kind 0: a set's size, digest and bitmap (first reading) or front (second). Kind 1: counted hashes.

    In the second reading kind 2 is kind 0 for sets that may have copies.
    """
    table = None if moved is None else np.frombuffer(moved, np.uint8)
    twice = None if doubled is None else np.frombuffer(doubled, np.uint8)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * len(_MAPS), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["kind", "doc_id", "n", "d0", "d1", "front", *_MAPS, "bitmap", "part", "once", "more", "times"]

    def rows(known: dict, n: int) -> pa.RecordBatch:
        return pa.record_batch([known.get(name, pa.nulls(n, kind)) for name, kind in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, digests, maps, fronts, seen = [], [], [], [], {}
                for s in shingle_sets(batch.column("text"), words):
                    sizes.append(len(s))
                    digests.append(_digest(s))
                    fronts.append(_front(s, numerator, denominator, table))
                    if len(s):
                        seen[digests[-1]] = fronts[-1]
                    if twice is None:
                        maps.append(_bitmap(s))
                n = len(sizes)
                digest = np.array(digests, np.int64).reshape(-1, 2)
                out = {"kind": pa.array(np.zeros(n), pa.int32()), "doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()),
                       "d0": pa.array(np.ascontiguousarray(digest[:, 0])), "d1": pa.array(np.ascontiguousarray(digest[:, 1]))}
                if twice is None:
                    own = np.array([_folded(x, len(_MAPS)) for x in maps], np.uint64).reshape(n, len(_MAPS)).view(np.int64)
                    out |= {name: pa.array(np.ascontiguousarray(own[:, i])) for i, name in enumerate(_MAPS)}
                    out["bitmap"] = pa.array([x.tobytes() for x in maps], pa.binary())
                else:
                    out["kind"] = pa.array(np.where(in_bits(digest[:, 0].astype(np.uint64), twice), 2, 0), pa.int32())
                    offsets = np.concatenate([[0], np.cumsum([len(f) for f in fronts])]).astype(np.int32)
                    out["front"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *fronts]).view(np.int64)))
                yield rows(out, n)
                counted = _counted(list(seen.values()), ranges)
                if counted[0]:
                    yield rows({"kind": pa.array([1] * len(counted[0]), pa.int32())} | {c: pa.array(v, k) for c, v, k in zip(names[-4:], counted, kinds[-4:], strict=True)},
                               len(counted[0]))
    return run


def _repeated(least: int) -> Callable:
    """A range's hashes that its batches counted ``least`` times or more."""
    def run(table: pa.Table) -> pa.Table:
        once = [from_planes(x, KEY_BYTES) for x in table.column("once").to_pylist()]
        more = [from_planes(x, KEY_BYTES) for x in table.column("more").to_pylist()]
        times = [np.frombuffer(x, np.uint32) for x in table.column("times").to_pylist()]
        keys, at = np.unique(np.concatenate([*once, *more]), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.ones(sum(map(len, once)), np.uint32), *times]))
        return pa.table({"key": pa.array(keys[total >= least].view(np.int64))})
    return run


def _kept(repeated: bytes) -> Callable:
    """The hashes of the fronts that may repeat, one row each."""
    table = np.frombuffer(repeated, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            front = batch.column("front")
            sig = front.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(batch.num_rows), front.value_lengths().to_numpy())
            some = in_bits(mix(sig), table)
            part = batch.select(["kind", "doc_id", "d0", "d1"]).take(pa.array(row[some]))
            yield pa.record_batch([*part.columns, pa.array(sig[some].view(np.int64))], names=[*part.schema.names, "sig"])
    return run


def _sets(words: int, wanted: bytes) -> Callable:
    table = np.frombuffer(wanted, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            some = in_bits(whole.column("key").to_numpy().view(np.uint64), table)
            for batch in slices(whole.filter(pa.array(some)), "text"):
                sets = [s.tobytes() for s in shingle_sets(batch.column("text"), words)]
                yield pa.record_batch([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])
    return run


def _decide(numerator: int, denominator: int) -> Callable:
    """Exact intersections of sorted arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(denominator * shared >= numerator * (len(p) + len(q) - shared))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


class Join:
    """One run over a table of documents; ``groups`` gives its result."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, numerator: int = NUMERATOR,
                 denominator: int = DENOMINATOR, frequent: int = FREQUENT, block: int = BLOCK) -> None:
        self.texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.words, self.numerator, self.denominator, self.frequent, self.block = words, numerator, denominator, frequent, block

    def _read(self, moved: bytes | None = None, doubled: bytes | None = None) -> DataFrame:
        """One reading of the texts, written."""
        if not hasattr(self, "ranges"):
            self.ranges = 1 << max(0, (int(self.texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
        run = _measured(self.words, self.numerator, self.denominator, self.ranges, moved, doubled)
        return written(map_arrow(self.texts, run, MEASURED), "measured")

    def _often(self, measured: DataFrame, least: int) -> bytes:
        """Bits of the hashes that occur ``least`` times or more in the fronts."""
        counted = measured.filter("kind = 1").select("part", "once", "more", "times")
        ship(measured.sparkSession)
        return bit_set(counted.groupBy("part").applyInArrow(_repeated(least), "key long"), "key", 25)

    def _bound(self, n: str, m: str, a: str, b: str) -> Column:
        """Sizes and bitmaps allow the similarity: the overlap is at most half of what the differing bits leave."""
        differ = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in _MAPS), F.lit(0))
        n, m = F.col(n), F.col(m)
        most = F.floor((n + m - differ) / 2)
        return ((F.least(n, m) * self.denominator >= F.greatest(n, m) * self.numerator)
                & (most * self.denominator >= (n + m - most) * self.numerator))

    def _exact(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets have the similarity: whole bitmaps first, then the sorted arrays."""
        pairs = written(pairs, "pairs")
        wide = (pairs.join(self.bitmaps.selectExpr("doc_id as a", "n", "bitmap as x"), "a")
                .join(self.bitmaps.selectExpr("doc_id as b", "n as m", "bitmap as y"), "b").select("a", "b", "n", "m", "x", "y"))
        pairs = written(map_arrow(wide, _reachable(self.numerator, self.denominator), "a long, b long"), "reachable")
        if pairs.isEmpty():
            return pairs
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        key = F.xxhash64("id")
        wanted = bit_set(ids.select(key.alias("key")), "key")
        texts = self.texts.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
        sets = map_arrow(texts, _sets(self.words, wanted), "doc_id long, shingles binary")
        sets = written(sets, "sets")
        both = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
                .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y"))
        return written(map_arrow(both, _decide(self.numerator, self.denominator), "a long, b long"), "linked")

    def groups(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every input row.

        A text with fewer words than a shingle is one shingle of all of them; one without words (null, empty)
        links with nothing. A null doc_id is compared with nothing and has a null component. Rows that
        repeat a doc_id are versions of one document: each row has its own size, and a link of any of them
        is a link of the document.
        """
        read = self._read()
        found = read.filter("kind = 0").select("doc_id", "n", "d0", "d1", *_MAPS)
        full = found.filter("n > 0 and doc_id is not null")
        same = written(full.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
        doubled = same.filter("copies > 1")
        reps = same.select(F.col("rep").alias("doc_id"), "d0", "d1")
        whole = written(read.filter("kind = 0 and n > 0 and doc_id is not null").select("doc_id", "n", "d0", "d1", *_MAPS, "bitmap")
                        .join(reps, ["doc_id", "d0", "d1"], "left_semi").select("doc_id", "n", *_MAPS, "bitmap"), "maps")
        self.bitmaps, maps = whole.select("doc_id", "n", "bitmap"), whole.select("doc_id", "n", *_MAPS)

        again = self._read(self._often(read, self.frequent), bit_set(doubled, "d0"))
        fronts = again.filter("kind <> 1 and n > 0 and doc_id is not null").select("kind", "doc_id", "d0", "d1", "front")
        fronts = written(map_arrow(fronts, _kept(self._often(again, 2)), "kind int, doc_id long, d0 long, d1 long, sig long"), "fronts")
        # sets that may have copies go on as their first copy only
        fronts = (fronts.filter("kind = 2").join(reps, ["doc_id", "d0", "d1"], "left_semi").select("doc_id", "sig")
                  .unionByName(fronts.filter("kind = 0").select("doc_id", "sig")))
        heads = fronts.groupBy("sig").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("k")).filter("k > 1")
        met = written(fronts.join(heads, "sig"), "met")

        first = met.filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
        first = (first.alias("p").join(maps.alias("x"), F.expr("p.a = x.doc_id")).join(maps.alias("y"), F.expr("p.b = y.doc_id"))
                 .filter(self._bound("x.n", "y.n", "x", "y")).select("p.a", "p.b").distinct())
        parts = components(self._exact(first))

        # further links join whole parts
        versions = full.select("doc_id", "d0", "d1").join(doubled, ["d0", "d1"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("id"))
        several = (versions.groupBy("doc_id").agg(F.min("id").alias("b"), F.collect_set("id").alias("ids")).filter("size(ids) > 1")
                   .select(F.explode("ids").alias("a"), "b").filter("a <> b"))
        more = written(self._exact(self._rest(met.filter("k > 2"), maps, parts)).unionByName(several), "more")
        if not more.isEmpty():
            of = parts.select("id", "component")
            ends = (more.join(of.selectExpr("id as a", "component as p"), "a", "left").join(of.selectExpr("id as b", "component as q"), "b", "left")
                    .select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")))
            whole = components(ends).withColumnRenamed("id", "part").withColumnRenamed("component", "whole")
            every = parts.unionByName(more.selectExpr("a as id", "a as component")).unionByName(more.selectExpr("b as id", "b as component"))
            every = every.groupBy("id").agg(F.min("component").alias("part"))
            parts = written(every.join(whole, "part", "left").select("id", F.coalesce("whole", "part").alias("component")), "parts")
        placed = versions.join(parts, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("component"))
        return (found.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left")
                .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))

    def _rest(self, met: DataFrame, maps: DataFrame, parts: DataFrame) -> DataFrame:
        """Pairs of different parts that meet under a hash and pass sizes and bitmaps."""
        placed = (met.select("sig", "doc_id").join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
                  .select("sig", "doc_id", F.coalesce("component", "doc_id").alias("part")))
        counts = placed.groupBy("sig", "part").agg(F.count(F.lit(1)).alias("k"))
        largest = (counts.groupBy("sig").agg(F.max(F.struct("k", "part")).alias("top"), F.sum("k").alias("rows"), F.count(F.lit(1)).alias("parts"))
                   .filter("parts > 1").select("sig", F.col("top.part").alias("most"), F.ceil(F.col("rows") / self.block).cast("int").alias("blocks")))
        # a band holds sizes within the similarity's ratio, so partners lie in the same band or a neighbour
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(self.denominator / self.numerator))).cast("int")
        open_ = (placed.join(largest, "sig").join(maps, "doc_id")
                 .select("sig", "doc_id", "part", "most", "blocks", "n", band.alias("band"), *_MAPS))
        open_ = written(open_, "open")
        stored = open_.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        asked = (open_.filter("part <> most").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
                 .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
        tile = F.expr("x.sig = y.sig and x.band = y.band and x.block = y.block and x.part <> y.part")
        pairs = asked.alias("x").join(stored.alias("y"), tile).filter(self._bound("x.n", "y.n", "x", "y"))
        return pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; see :meth:`Join.groups`."""
    return Join(docs, doc_id, text, **options).groups()
