"""The training-data operators against brute force on small tables: nulls, empty and long texts, ties,
repeated rows, empty tables and columns with clashing names."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, langid, lm, mixing, passages, pieces, pii, quality, templates, vectors
from tessera.llm.queries import PIECES, TOKENIZERS
from tessera.llm.tables import Scratch, components, crc_part, map_arrow, written
from tessera.llm.words import from_steps, gathered, hash_words, steps, text_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, x string, part int"


def words(text):
    return (text or "").encode().lower().split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n))


LINE = "This passage stands in many documents " + prose(99, 60)
SHORT = "see our other pages 17"


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    out = [base, " ".join(near), base, base.upper(), None, "", " \n\t ", "one two", "ONE  two", "one two three four five",
           prose(2, 9000), f"{prose(3, 30)}\n{LINE}\n{prose(4, 30)}", f"{prose(5, 30)}\n{LINE}", f"  {LINE} \n", "a b c a b c a b c x y z",
           "mail a.b+c@ex.example.org or x@y, 10.0.0.255 and 1.2.3.4.5.6.7.8 and 999.1.1.1",
           "card 4111 1111 1111 1111 not 4111 1111 1111 1112, call +1 (017) 555-7713", "▁ é ü 日本 😀 \x01", "12345 !!! ...", "x" * 100_000]
    out += [f"{prose(100 + i, 20)}\n{SHORT.replace('17', str(i))}\n{prose(200 + i, 20)}" for i in range(12)]
    table = [(i, t, "en" if i % 2 else "de", ["s1", "s2", None, "s3"][i % 4] if i else "s1", 0, "clash", "clash", 1) for i, t in enumerate(out)]
    return [*table, table[7], (None, "a null id has a text", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (10, 4), (7, 8), (2, 1)], "a long, b long")
    assert dict(components(edges).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 10: 1, 7: 7, 8: 7, 9: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {c for _, c in components(chain).collect()} == {0}


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_against_all_pairs(docs, rows):
    got = collections.defaultdict(set)
    for r in jaccard.near_duplicates(docs, frequent=3, block=2).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: got[i] for i in sets} == {i: {(len(s), find(i))} for i, s in sets.items()}
    assert got[None] == {(2, None)}


def test_jaccard_many_near_copies(spark):
    rng = np.random.default_rng(5)
    base = prose(7, 60).split()
    table = []
    for i in range(150):
        own = list(base)
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(0, 60))] = f"w{rng.integers(0, 10 ** 6)}"
        table.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), frequent=8, block=16).collect()}
    sets = [shingles(t) for _, t in table]
    root = list(range(150))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in range(150)}


def test_jaccard_empty(empty):
    assert jaccard.near_duplicates(empty).count() == 0


def test_lm_base_scores(docs, rows):
    got = [r for r in lm.score(docs, crc_part(F.col("doc_id"), 7) == 2).collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for r in rows if not held(r[0]) for w in [*words(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        tokens = [*words(text[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(tokens), n)
        assert r.n_known == sum(counts[t] > 0 for t in tokens)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert r.score < 0


def test_lm_filter_counts():
    keys = np.random.default_rng(0).integers(0, 2 ** 63, 4000).astype(np.uint64)
    counts = np.arange(4000) % 200 + 2
    f = lm.Filter(np.zeros(1 << 14, np.uint64), 1)
    f.add((keys & lm._LOW) ^ (np.uint64(lm.WORD) << np.uint64(56)), lm.levels(counts, 2))
    found = f.count(keys, lm.WORD)
    assert (found >= counts / 2).all()
    assert (found <= counts * 2).mean() > 0.95
    assert (f.count(keys + np.uint64(1), lm.WORD) == 0).mean() > 0.9


def test_lm_filter_keeps_what_is_seen_once():
    rng = np.random.default_rng(0)
    words = np.sort(rng.integers(0, 2 ** 63, 40_000).astype(np.uint64))
    counts = rng.permutation(np.repeat([0, 1, 2, 70], 10_000))
    level = lm.Filter(lm._stretch(words, counts, lm.PAIR, lm.LEAST), 1, least=lm.LEAST).level(words, lm.PAIR)
    assert (level[counts > 0] >= lm.levels(counts[counts > 0], 1)).all()
    assert (level[counts == 1] == 1).mean() > 0.95 and (level[counts == 0] == 0).mean() > 0.95


def test_lm_pairs_seen_once_score_more(spark):
    df = spark.createDataFrame([(1, "red kite flies"), (2, "blue moon sets"), (3, "red kite"), (4, "red moon")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df, F.col("doc_id") > 2).collect()}
    assert math.isclose(got[3].base_score, got[4].base_score)
    assert got[3].score > got[4].score + 0.3


def test_lm_score_against_exact_counts(spark):
    """The score by exact levels; a filter may only take a count for a higher one, and rarely does."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = d.collect()
    train = [r for r in rows if r.doc_id % 3]
    single, double = collections.Counter(), collections.Counter()
    for r in train:
        tokens = [None, *words(r.text), None]
        single.update(tokens[1:])
        double.update(zip(tokens[:-1], tokens[1:], strict=True))
    n, v = sum(single.values()), len(single)
    rough = lambda c: 2 ** (math.floor(math.log2(c)) + 0.5) if c else 0.0
    model = lm.fit(lm.pack(d, F.col("doc_id") % 3 != 0))
    same = 0
    # another table of texts than the model was fitted on
    for r in lm.score_packed(lm.pack(d.repartition(3), F.lit(False)), model).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        tokens, want = [None, *words(text), None], 0.0
        for a, b in zip(tokens[:-1], tokens[1:], strict=True):
            own = min(1.0, (rough(single[b]) + 1) / (n + v + 1))
            share = min(1.0, rough(double[a, b]) / max(1.0, rough(single[a])))
            want += math.log10(lm.PAIR_WEIGHT * share + (1 - lm.PAIR_WEIGHT) * own if single[a] else own)
        assert r.held_out and r.n_tokens == len(tokens) - 1
        assert abs(r.score - want) <= 0.03 * abs(want) + 1.0
        same += math.isclose(r.score, want, rel_tol=1e-9)
    assert same > len(rows) / 10
    assert model.table.agg(F.sum("total")).first()[0] == n
    written_model = {r.part for r in model.table.collect()}
    assert written_model <= set(range(model.ranges))


def test_lm_shuffles_short_keys(spark):
    """What goes to the hash ranges takes less than its words at eight bytes and its pairs at five."""
    drawn = np.random.default_rng(0).integers(0, 20_000, (300, 500)).tolist()
    texts = spark.createDataFrame([(i, " ".join(f"w{n}" for n in row)) for i, row in enumerate(drawn)], "doc_id long, text string")
    packed = lm.pack(texts.coalesce(1), F.lit(True))
    rows = map_arrow(packed.select(*lm._CHUNK), lm._dealt(8, False), lm.DEALT).collect()
    n_words, n_pairs = (sum(len(from_steps(x)) for x in own) for own in ([r.words for r in rows if r.words], [r.pairs for r in rows if r.pairs]))
    assert n_words and n_pairs > n_words
    assert sum(len(r.words or b"") + len(r.pairs or b"") for r in rows) < 0.85 * (8 * n_words + 5 * n_pairs)
    for r in rows:
        assert r.pairs is None or (np.diff(from_steps(r.pairs).astype(np.int64)) >= 0).all()


def test_steps_and_gathered_rows():
    rng = np.random.default_rng(1)
    for keys in (np.zeros(0, np.uint64), np.array([0, 0, 2 ** 64 - 1], np.uint64), np.sort(rng.integers(0, 2 ** 64, 1000, np.uint64))):
        assert (from_steps(steps(keys)) == keys).all()
    texts = ["x" * int(n) for n in rng.integers(0, 90, 200)]
    batches = [pa.record_batch([texts[i:j]], names=["text"]) for i, j in ((0, 0), (0, 7), (7, 7), (7, 150), (150, 200))]
    runs = [b.column("text").to_pylist() for b in gathered(iter(batches), "text", 1000)]
    assert sum(runs, []) == texts
    assert all(len("".join(r)) <= 1000 for r in runs) and all(len("".join([*r, s[0]])) > 1000 for r, s in zip(runs[:-1], runs[1:], strict=True))


def test_workers_get_small_batches(spark):
    """Long texts go to the Python workers a few at a time, not by thousands of rows."""
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes], pa.int64()), pa.array([batch.num_rows], pa.int64())], names=["bytes", "rows"])

    got = map_arrow(spark.range(0, 400, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text")), sizes, "bytes long, rows long").collect()
    assert sum(r.rows for r in got) == 400
    assert max(r.bytes for r in got) < 6 << 20


def test_lm_empty(empty):
    assert lm.score(empty, F.lit(False)).count() == 0
    model = lm.fit(lm.pack(empty, F.lit(True)))
    assert (model.total, model.distinct) == (0, 0)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres + 0.08 * rng.normal(size=centres.shape) for _ in range(6)])
    table = [(i, [float(c) for c in v], i % 2) for i, v in enumerate(x)]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [None] + [1.0] * 15, 1), (504, table[0][1], None), (505, [1.0], 0), (None, table[0][1], 0)]
    df = spark.createDataFrame([*table, *odd, table[3]], "vec_id long, embedding array<float>, label int").withColumn("x", F.lit(1))
    got = {r.vec_id: r for r in vectors.near_duplicates(df, tile=16).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(180)[:, None] % 2 == np.arange(180) % 2)
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(180))
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(180))
    for i in (500, 501, 502, 503, 504, 505):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id is None
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_many_noisy_copies_share_a_list():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64))
    x[:2000] = x[0] / np.linalg.norm(x[0]) + 0.025 * rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.Index(x, 244, reach=math.sqrt(2 - 2 * 0.93))
    near = index.probes(x[:2000], vectors.PROBES)
    linked = x[:300] @ x[:2000].T >= 0.93
    met = np.array([np.isin(near[:, 0], near[i]) | (near == near[i, 0]).any(1) for i in range(300)])
    assert (linked & met).sum() >= 0.99 * linked.sum()


def test_vectors_span():
    root = vectors.span(np.arange(8), np.array([7, 2, 5, 3]), np.array([5, 3, 1, 6]))
    assert root.tolist() == [0, 1, 2, 2, 4, 1, 2, 1]
    assert vectors.span(root, np.array([6]), np.array([7])).tolist() == [0, 1, 1, 1, 4, 1, 1, 1]


@pytest.fixture(scope="module")
def codec():
    with open(f"{TOKENIZERS}/{PIECES}", "rb") as f:
        return pieces.Codec(f.read())


def test_pieces_best_segmentation(codec, rows):
    score = {codec.bytes_of[i]: codec.scores[i] for i in range(len(codec.bytes_of)) if codec.bytes_of[i] and not codec.is_byte[i]}

    def best(text):
        text = " " + text
        total = [0.0] + [-math.inf] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - 16), e):
                if (own := score.get(text[s:e].encode())) is not None:
                    total[e] = max(total[e], total[s] + own)
            if text[e - 1] not in codec.chars and text[e - 1] != " ":
                total[e] = max(total[e], total[e - 1] + codec.alone[1])
        return total[-1]

    for text in [r[1][:300] for r in rows if r[1] and "▁" not in r[1]]:
        ids = codec.encode(text)
        bare = sum(c not in codec.chars for c in text.replace(" ", "▁"))
        assert math.isclose(codec.scores[ids[~codec.is_byte[ids]]].sum() + bare * codec.alone[1], best(text), rel_tol=1e-12)
        assert codec.decode(ids) == text
        assert codec.encode_all([text])[0].tolist() == ids.tolist()


def test_pieces_round_trip(docs, rows):
    coded = pieces.encode(docs, f"{TOKENIZERS}/{PIECES}", carry=("lang",))
    text = {r[0]: r[1] for r in rows}
    got = coded.collect()
    assert len(got) == len(rows)
    assert all((r.token_ids is None and r.round_trip is None and r.n_tokens == 0) if text[r.doc_id] is None else r.round_trip and len(r.token_ids) == r.n_tokens for r in got)
    assert {r.doc_id: r.text for r in pieces.decode(coded, f"{TOKENIZERS}/{PIECES}").collect()} == text


def test_pii_base_against_patterns(docs, rows):
    def luhn(d):
        return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    def digits(t):
        return re.sub("[^0-9]", "", t)

    rules = {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
             "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
             "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(digits(t)) <= 19 and luhn(digits(t))),
             "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15)}
    texts = [(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 20_000]
    texts += [(1000 + i, t) for i, t in enumerate([
        "a@b.co_x@d.com @x.y a@@b.c a@b a.b@c.d.e.", "1.2.3.4.5 01.002.0003.4 1..2.3.4 256.1.1.1.1", "+1+12 345-678 9 +(1) +4915112345678.", "0000 0000 0000 0 4-1-1-1 1111111111111117",
        "iban DE89370400440532013000 and DE89370400440532013001", "é@ü.de ü a@b-c.d-e"])]
    got = by_id(pii.summary(pii.spans(docs.sparkSession.createDataFrame(texts, "doc_id long, text string"))))
    for i, t in texts:
        found = [(k, m.start(), m.end()) for k, (p, good) in rules.items() for m in re.finditer(p, t or "") if good(m.group())]
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
        assert got[i].base_sha256 == digest, t
        assert [got[i][f"n_{k}"] for k in rules] == [sum(f[0] == k for f in found) for k in rules]
    assert "iban:5:27" in got[1004].spans and "iban:32" not in got[1004].spans
    assert pii.spans(docs).count() == len(rows)


def test_pii_added_kinds_need_their_context(spark):
    texts = {1: "his ssn is 123-45-6789 here", 2: "the code 123-45-6789 here", 3: "ssn 000-45-6789, ssn 666-12-3456, ssn 123-00-4567, ssn 912-34-5678",
             4: "call (030) 1234 567 now", 5: "see (030) 1234 567 now", 6: "phone 0171 2345678", 7: "order 0171 2345678", 8: "mail a@b.cc", 9: "x a@b.cc", 10: "version 10.0.0.1",
             11: "server 10.0.0.1", 12: "Konto DE89 3704 0044 0532 0130 00"}
    got = {r.doc_id: r for r in pii.summary(pii.spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).collect()}
    assert {i: r.spans for i, r in got.items()} == {
        1: "ssn:11:22", 2: "", 3: "", 4: "local_phone:5:19", 5: "", 6: "local_phone:6:18", 7: "", 8: "email:5:11", 9: "email:2:8", 10: "ip:8:16", 11: "ip:7:15", 12: "iban:6:33"}
    # a context word raises a score by 0.3, a counter word lowers it; base spans stay either way
    assert {i: r.scores for i, r in got.items() if r.spans} == {
        1: "0.7", 4: "0.6", 6: "0.6", 8: "1.0", 9: "0.8", 10: "0.3", 11: "0.9", 12: "1.0"}


def test_pii_iban_before_capitals_and_numbers():
    def found(text):
        return [text[s:e] for s, e in pii.ibans(text)]

    assert found("IBAN DE89370400440532013000 BIC COBADEFFXXX") == ["DE89370400440532013000"]
    assert found("DE89 3704 0044 0532 0130 00 12 May") == ["DE89 3704 0044 0532 0130 00"]
    assert found("REF AB12 DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 EUR 500") == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    assert found("DE89 3704 0044 0532 0130 01 BIC COBADEFFXXX") == []
    text = "pay to account DE89370400440532013000 BIC COBADEFFXXX"
    assert ("iban", 15, 37) in [x[:3] for x in pii.find(text)[1]]


def test_mixing_targets_and_repeats(docs, rows):
    first = sorted(tuple(r) for r in mixing.per_document(*mixing.mix(docs, block_docs=4)).fillna(-1).collect())
    again = sorted(tuple(r) for r in mixing.per_document(*mixing.mix(docs.repartition(5), block_docs=4)).fillna(-1).collect())
    assert first == again and len(first) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    target |= share
    assert all(taken <= 2 * size for _, size, _, _, taken, _ in first)
    for s in order:
        mine = [r for r in first if r[2] == sizes[s]]
        assert all(math.isclose(r[3], target[s]) for r in mine)
        assert target[s] - max(r[1] for r in mine) <= sum(r[4] for r in mine) <= target[s] + 1e-6


def test_mixing_tree_covers_all_quotas():
    quotas = np.array([100, 3, 0, 57])
    leaves = [mixing.shard_quotas(quotas, 7, k, 1) for k in range(7)]
    assert (sum(n for _, n in leaves) == quotas).all()
    assert all((a[0] + a[1] == b[0]).all() for a, b in zip(leaves, leaves[1:], strict=False))


def test_mixing_shards_come_from_the_tree(docs):
    """A source's draws, shard by shard, are the quotas that the tree's leaves have for it."""
    draws, sizes, goal = mixing.mix(docs, shards=5, block_docs=1)
    rows = draws.collect()
    blocks = collections.Counter(r.source for r in rows)
    order = sorted(blocks, key=lambda s: (s is None, s or ""))
    per = mixing.per_document(draws, sizes, goal).collect()
    assert collections.Counter(k for r in {(r.doc_id, r.source_size, tuple(r.shards)) for r in per} for k in r[2])
    assert collections.Counter(r.shard for r in rows).keys() <= set(range(5))
    # another tree deals the same draws to other shards
    other, _, _ = mixing.mix(docs, shards=1, block_docs=1)
    assert {r.shard for r in other.collect()} == {0}
    assert collections.Counter((r.doc_id, r.source, r.epoch) for r in rows) == collections.Counter((r.doc_id, r.source, r.epoch) for r in other.collect())
    assert order


def test_mixing_empty(empty):
    assert mixing.per_document(*mixing.mix(empty)).count() == 0


def test_passages_offsets(docs, rows):
    got = passages.removals(docs.filter("doc_id is not null")).collect()
    text = {r[0]: r[1] for r in rows}
    assert {r.doc_id for r in got if r.kept_doc_id == 11} == {12, 13}
    assert {r.doc_id for r in got} >= {2, 3, 12, 13}
    assert not {r.doc_id for r in got} & {0, 1, 11, 10, *range(20, 32)}
    assert all(text[r.doc_id][r.start:r.end].lower().split() == text[r.kept_doc_id][r.kept_start:].lower().split()[:r.n_words] for r in got)
    left = {r.doc_id: r.text for r in passages.cleaned(docs, passages.removals(docs)).collect()}
    assert left[12] == text[12][:-len(LINE)] and left[13].strip() == "" and left[0] == text[0] and left[4] is None


def test_passages_inside_lines(spark):
    shared = " ".join(f"Sentence {i} of the shared passage has {prose(50 + i, 8)}." for i in range(6))
    rows = [(1, f"{prose(1, 9)}. {prose(2, 7)} {shared[12:]} {prose(3, 9)}."), (2, f"{prose(4, 30)}. {shared}"), (3, f"{prose(5, 9)} and {shared[5:-4]} {prose(6, 4)}!"),
            (4, f"{prose(7, 40)}. Yes. No. {prose(8, 9)}."), (5, f"{prose(9, 40)}. Yes. No. {prose(10, 9)}.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.removals(docs).collect()
    assert {r.doc_id for r in got} == {2, 3} and {r.kept_doc_id for r in got} == {1}
    text = dict(rows)
    assert all(text[r.doc_id][r.start:r.end].split() == text[1][r.kept_start:].split()[:r.n_words] for r in got)
    left = {r.doc_id: r.text for r in passages.cleaned(docs, passages.removals(docs)).collect()}
    assert "Sentence 3" in left[1] and "Sentence 3" not in left[2] + left[3] and left[4] == text[4]


def shared_ids(spark):
    """Rows that share an id, or have none, with different texts; column names that steps use inside."""
    body = "\n".join(f"Line {i} of a block that stands in many texts {prose(60 + i, 10)}." for i in range(3))
    own = lambda i: "\n".join(prose(1000 + 10 * i + k, 25) + "." for k in range(4))
    rows = [(i, f"{own(i)}\n{body}\n{own(i + 100)}") for i in range(20)]
    rows += [(5, own(300)), (None, own(301)), (None, f"{own(302)}\n{body}"), rows[7], (40, None), (41, "")]
    clash = ", ".join(f"{c} string" for c in ("__id", "__no", "__cuts", "__cut_id", "__cut_key", "text_key", "start", "no", "line", "leaf", "shard", "position", "__kept", "key"))
    table = [(i, t, "en", "s", 1, *["own"] * 14) for i, t in rows]
    return spark.createDataFrame(table, f"doc_id long, text string, lang string, source string, n_chars long, {clash}").repartition(3), rows


def test_cuts_follow_the_text_and_not_the_id_alone(spark):
    docs, rows = shared_ids(spark)
    dropped = templates.dropped_lines(docs)
    got = templates.without_lines(docs, dropped)
    assert got.columns == docs.columns and got.filter("`__no` <> 'own' or line <> 'own'").count() == 0
    left = collections.Counter((r.doc_id, r.text) for r in got.collect())
    want = collections.Counter((i, t if t is None else "\n".join(x for x in t.split("\n") if not x.startswith("Line "))) for i, t in rows)
    assert left == want
    cut = passages.cleaned(docs, passages.removals(docs))
    assert cut.columns == docs.columns
    kept = collections.Counter((r.doc_id, r.text) for r in cut.collect())
    assert kept[5, rows[20][1]] == 1 and kept[None, rows[21][1]] == 1 and sum(kept.values()) == len(rows)
    assert sum("Line 1" in (t or "") for _, t in kept) == 1


def test_templates_count_documents(spark):
    own = lambda i: "\n".join(prose(2000 + 10 * i + k, 40) for k in range(5))
    block = "first of three lines\nsecond of three lines 17\n" + prose(9, 260)
    table = "\n".join(f"{i} {i * 3} {i * 7} {i * 11}" for i in range(14))
    rows = [(i, f"{own(i)}\n{block.replace('17', str(i))}\n{own(i + 50)}") for i in range(40)]
    rows += [(100, f"{own(200)}\n{table}\n{own(201)}")]
    copied = own(300)
    rows += [(200 + i, copied + f"\nA near copy ends with {prose(3000 + i, 3)}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = templates.dropped_lines(docs).collect()
    # all lines of the block, the long one too; no line of one document's table or of copies
    assert {(r.doc_id, r.no) for r in got} == {(i, n) for i in range(40) for n in (5, 6, 7)}
    assert {r.documents for r in got} == {40}
    few = templates.dropped_lines(docs.filter("doc_id < 9 or doc_id >= 100")).collect()
    assert few == []


def test_templates_of_mostly_shared_documents(spark):
    """Documents of which most is a block that others hold too count, and copies of them count once."""
    block = "\n".join(prose(4000 + k, 30) for k in range(4))
    rows = [(i, f"{prose(4100 + i, 40)}\n{block}\n{prose(4200 + i, 20)}") for i in range(12)]
    copies = [(100 + i, f"{prose(4300, 40)}\n{prose(4301, 40)}\n{prose(4302, 40)}") for i in range(15)]
    got = templates.dropped_lines(spark.createDataFrame(rows + copies, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.no, r.documents) for r in got} == {(i, n, 12) for i in range(12) for n in range(1, 5)}
    few = spark.createDataFrame(rows[:9] + [(50 + i, rows[0][1] + "\nEnd") for i in range(15)], "doc_id long, text string")
    assert templates.dropped_lines(few).collect() == []


def test_templates_recurring_lines(docs, rows):
    dropped = templates.dropped_lines(docs)
    assert {(r.doc_id, r.no) for r in dropped.collect()} == {(i, 1) for i in range(20, 32)}
    left = {r.doc_id: r.text for r in templates.without_lines(docs, dropped).collect()}
    text = {r[0]: r[1] for r in rows}
    assert all(left[i] == "\n".join(text[i].split("\n")[::2]) for i in range(20, 32))
    assert all(left[i] == text[i] for i in range(20))
    assert templates.without_lines(docs, dropped).columns == docs.columns


def test_scratch_removes_only_its_own_tables(spark, docs):
    outside = written(docs.select("doc_id"), "outside")
    with Scratch(spark) as own:
        inside = written(docs.select("doc_id"), "inside")
        kept = own.keep(inside, "kept")
        with Scratch(spark):
            written(docs.select("doc_id"), "deeper")
        assert inside.count() == docs.count()
    assert outside.count() == kept.count() == docs.count()
    with pytest.raises(Exception, match="FileNotFound|does not exist|PATH_NOT_FOUND|file"):
        inside.count()


def test_word_hashes_do_not_meet():
    """Words on which a polynomial modulo 2^64 agrees."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    column = pa.array([a, b, a.upper(), a + "x", "", "ab cd", "abcd", "x" * 64, "x" * 65, "x" * 63 + "y" + "x"])
    h, at = hash_words(*text_bytes(column))
    own = [h[s:e].tolist() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    assert own[0] == own[2] and len({tuple(x) for x in own}) == 9
    assert [len(x) for x in own] == [1, 1, 1, 1, 0, 2, 1, 1, 1, 1]
    # the same word, wherever it stands
    h, _ = hash_words(*text_bytes(pa.array([f"{' ' * k}Word{' ' * (9 - k)}" for k in range(10)] + ["zzz word", "word" + " q" * 700_000 + " WORD"])))
    assert len({*h[:10].tolist(), int(h[11]), int(h[12]), int(h[-1])}) == 1


def test_vectors_among_many_unusable_rows(spark):
    rows = spark.range(0, 60_000).select((F.col("id") + 10).alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    same = spark.createDataFrame([(i, [1.0, 2.0, 0.5, -1.0], 1) for i in range(3)], "vec_id long, embedding array<float>, label int")
    got = vectors.near_duplicates(rows.unionByName(same)).filter("vec_id < 3").collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(0, 2, 0), (1, 2, 0), (2, 2, 0)}


def test_empty_line_operators(empty):
    assert passages.removals(empty).count() == 0
    assert templates.dropped_lines(empty).count() == 0
    assert quality.quality(empty).count() == 0
    assert pii.spans(empty).count() == 0
    assert pieces.encode(empty, f"{TOKENIZERS}/{PIECES}").count() == 0


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_part(F.col("doc_id"), 4) == 2
    model = langid.fit(d, use=~held, per_language=150)
    found = d.join(langid.predict(d, model), "doc_id").filter(held)
    right = found.filter("lang = lang_pred").count() / found.count()
    assert right >= 0.97
    assert found.filter("score < 0 or score > 1").count() == 0
    again = langid.predict(d.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), model)
    assert again.exceptAll(langid.predict(d, model)).count() == 0


def test_language_edges(docs, empty, rows):
    model = langid.fit(docs)
    got = by_id(langid.predict(docs, model))
    assert len(got) == len({r[0] for r in rows})
    for i in (4, 5, 6, 18):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[0].lang_pred in ("de", "en")
    assert langid.keep(docs, model, least=0.0).count() == len(rows) - 4
    assert langid.keep(docs, model).columns == docs.columns
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def plain_language(model, text):
    """The rule of the module, word by word."""
    n, total, shares = len(model.langs), np.zeros(len(model.langs)), []
    known = {unit: {u: i for i, u in enumerate(units)} for unit, units in enumerate(model.units)}
    for token in (text or "").lower().split():
        word = langid.letters(token)
        if not word:
            continue
        if word in known[0]:
            rows = [model.rows[0][known[0][word]]]
        else:
            found, padded = [], f" {word} "
            for i in range(len(padded)):
                for k in range(min(langid.LONGEST, len(padded) - i), 0, -1):
                    if padded[i:i + k] in known[k]:
                        found.append(model.rows[k][known[k][padded[i:i + k]]])
                        break
            full = max(1, len(found) // langid.LONG)
            cuts = [langid.LONG * i for i in range(full)] + [len(found)]
            rows = [np.mean(found[x:y], axis=0) if found[x:y] else np.zeros(n) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        for r in rows:
            total += r
            if r.any():
                e = np.exp(np.maximum(r - r.max(), -50))
                shares.append(e / e.sum())
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    best = int(total.argmax())
    return model.langs[best], float(np.mean([s[best] for s in shares])) if shares else 1 / n


def test_language_against_the_plain_rule(spark, rows, docs):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.Model(langid.fit(d, per_language=20, words=300, grams=400))
    rng = np.random.default_rng(7)
    texts = [r[1] for r in rows] + [r.text for r in d.limit(40).collect()] + ["".join(rng.choice(list("aäeh ßñz.1日"), 60)) for _ in range(100)]
    langs, scores = model.predict(pa.array(texts))
    for text, lang, score in zip(texts, langs, scores.tolist(), strict=True):
        want = plain_language(model, text)
        assert (lang, round(score, 9)) == (want[0], round(want[1], 9)), text
    again = model.predict(pa.array(texts))  # every token from memory
    assert (again[0], again[1].tolist()) == (langs, scores.tolist())


def test_language_reads_long_words_whole():
    units = [(lang, 1, c) for lang, own in (("aa", "abcd"), ("zz", "wxyz")) for c in own]
    m = langid.Model(pa.table({"lang": [u[0] for u in units], "n": [u[1] for u in units], "unit": [u[2] for u in units],
                               "count": [5] * 8, "total": [20] * 8}))
    long = "abcd" * 50 + "wxyz" * 500
    assert m.predict(pa.array([long, long + " a b c d a b c d", "wxyzwxyz a b c d"]))[0] == ["zz", "zz", "aa"]
    stretches = lambda w: m.unknown([w])[0]
    assert stretches("abcd" * 10).shape == (2, 2) and stretches("abcd" * 4).shape == (1, 2)
    assert np.allclose(stretches("abcd" * 6 + "wxyz"), stretches("wxyz" + "abcd" * 6))


def test_quality_figures(docs, rows):
    got = by_id(quality.quality(docs))
    for i, t, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        places = collections.defaultdict(list)
        for k in range(len(w) - 2):
            places[tuple(w[k:k + 3])].append(k)
        covered = {k + d for p in places.values() if len(p) > 1 for k in p for d in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(c in quality.SYMBOLS for c in t or "")
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
