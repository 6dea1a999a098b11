"""Vector codes, toxicity and tokenizer alignment against brute force on small tables."""

import collections
import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import align, codes, toxicity
from tessera.llm.queries import BYTES, PIECES, TOKENIZERS, op13_tokenizer_alignment

CLASH = "doc_id long, text string, chunk long, part int, team int, counts string, groups string, score double, known_id string"


def plain_lloyd(x, parts, entries, rounds):
    """The rounds as stated, with Python whole numbers."""
    w = len(x[0]) // parts
    books = [[v[j * w:(j + 1) * w] for v in x[:entries]] for j in range(parts)]

    def nearest(j, v):
        d = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in books[j]]
        return d.index(min(d)), min(d)

    for k in range(rounds + 1):
        found = [[nearest(j, v[j * w:(j + 1) * w]) for j in range(parts)] for v in x]
        if k < rounds:
            for j in range(parts):
                for e in range(len(books[j])):
                    own = [v[j * w:(j + 1) * w] for v, f in zip(x, found, strict=True) if f[j][0] == e]
                    if own:
                        books[j][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return ["".join(f"{e:02x}" for e, _ in f) for f in found], [sum(d for _, d in f) for f in found], books


@pytest.mark.parametrize("seed", range(3))
def test_dual_trees_give_the_plain_rounds(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-40, 40, (700, 4))
    x[200:450] = x[3]  # many copies
    x[450:500] = x[3] + rng.integers(-1, 2, (50, 4))
    book = np.concatenate([x[:10], x[:3], x[3:6]])  # equal entries
    order, low, high, sums = codes.tree(x)
    whole, at, chosen = codes.assign(x[order], low, high, codes.Entries(book))
    got = np.full(len(x), -1)
    got[at] = chosen
    first, taken = 0, 0
    for level, node, entry in whole:
        cut = codes.edges(len(x), level)
        for n, e in zip(node.tolist(), entry.tolist(), strict=True):
            got[cut[n]:cut[n + 1]] = e
            taken += cut[n + 1] - cut[n]
            assert (sums[first + n] == x[order][cut[n]:cut[n + 1]].sum(0)).all()
        first += 1 << level
    want = ((x[order][:, None, :] - book) ** 2).sum(2).argmin(1)
    assert (got == want).all()
    assert taken > 200  # whole nodes do take part


def test_codes(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (60, 16)).astype(np.float32)
    rows = [(i, base[i % 60].tolist(), i % 3 if i % 5 else None, "x", 1) for i in range(90)]
    rows += [(90, None, 1, "x", 1), (91, [None] * 16, 1, "x", 1), (92, [float("nan")] * 16, 1, "x", 1), (93, [math.inf] * 16, 1, "x", 1), (94, [1.0], 1, "x", 1),
             (95, [], 1, "x", 1), (96, [1e30] * 16, 1, "x", 1), (7, base[3].tolist(), 1, "x", 1), (None, base[9].tolist(), None, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, part int").repartition(3)
    got = codes.compress(df, parts=4, entries=5, rounds=3, chunk=20).collect()
    kept = sorted(((r[0], r[1], r[2]) for r in rows if r[1] and len(r[1]) == 16 and r[1][0] is not None and math.isfinite(r[1][0]) and r[1][0] < 1e29),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(4096 * v) for v in r[1]] for r in kept]
    # row 7 stands twice; the first entries are those of the ids 0 to 4
    want, error, books = plain_lloyd(x, 4, 5, 3)
    assert collections.Counter((r.vec_id, r.code, r.error) for r in got) == collections.Counter((k[0], c, e) for k, c, e in zip(kept, want, error, strict=True))
    by_label = collections.Counter()
    for k, e in zip(kept, error, strict=True):
        by_label[k[2]] += e
    label = collections.defaultdict(set)
    for k in kept:
        label[k[0]].add(by_label[k[2]])
    assert all(r.label_error in label[r.vec_id] for r in got)
    fitted, _ = codes.fit(df, parts=4, entries=5, rounds=3, chunk=20)
    assert [b.tolist() for b in fitted.books] == books
    assert {r.codebooks_sha256 for r in got} == {fitted.sha256()}
    assert len(fitted.decode(got[0].code)) == 16
    assert codes.compress(df.limit(0)).count() == 0
    assert codes.compress(df.filter("vec_id in (90, 91, 92, 95)")).count() == 0
    one = codes.compress(df.filter("vec_id = 5")).first()
    assert one.error == 0 and one.code == "00" * 8


def test_scan_and_marginals():
    """Forward-backward in blocks against sums over all taggings."""
    texts = ["a b c d", "", "e", "f g! h", None, " ".join("w%d" % (i % 7) for i in range(200))]
    tokens = toxicity.Tokens.of(pa.array(texts))
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(0, 1, 1 << toxicity.BITS), -0.3, 0.4, rng.normal(0, 1, (2, 2)), np.array([-3.0, 2.0, 0.0, 1.0]))
    got = model.marginals(tokens)
    e = model.weights[tokens.features].sum(1) + model.bias
    for a, b in zip(tokens.first[:-1].tolist(), tokens.first[1:].tolist(), strict=True):
        n = b - a
        if 0 < n <= 4:
            total = np.zeros(n + 1)
            for y in np.ndindex(*[2] * n):
                s = model.start * y[0] + sum(e[a + t] * y[t] for t in range(n)) + sum(model.moves[y[t - 1], y[t]] for t in range(1, n))
                total += math.exp(s) * np.array([1, *y])
            assert np.allclose(got[a:b], total[1:] / total[0])
    # the long text against the plain recursion
    a, b = tokens.first[-2:].tolist()
    f, z = [np.array([0.0, model.start + e[a]])], [np.zeros(2)]
    for t in range(a + 1, b):
        f.append(np.array([np.logaddexp(f[-1][0] + model.moves[0, j], f[-1][1] + model.moves[1, j]) + e[t] * j for j in range(2)]))
    for t in range(b - 1, a, -1):
        z.append(np.array([np.logaddexp(model.moves[i, 0] + z[-1][0], model.moves[i, 1] + e[t] + z[-1][1]) for i in range(2)]))
    both = np.array(f) + np.array(z[::-1])
    assert np.allclose(got[a:b], np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1])))
    assert model.scores(tokens)[1] == model.scores(tokens)[4]


def toxic_tables(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(vocabulary, rng.integers(20, 80)))
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["Vilyx!", "vilant", "grubno", "ümok"])))
        rows.append((i, " ".join(words), 1, 1, 1, "c", "g", 0.0, "k"))
        labels.append((i, 1, int(bad), "clash"))
    return rows, labels, "doc_id long, quality int, toxic int, text string"


def test_toxicity(spark):
    rows, labels, schema = toxic_tables(spark)
    extra = [(1000, None), (1001, ""), (1002, " !! "), (1003, "Ein vilyx é grubno, ümok x"), (None, "vilant")]
    docs = spark.createDataFrame(rows + [(i, t, 1, 1, 1, "c", "g", 0.0, "k") for i, t in extra] + rows[:1], CLASH).repartition(3)
    table = spark.createDataFrame(labels + [(None, 1, 1, "x"), (5, 1, None, "x"), (9999, 1, 1, "x")], schema)
    model = toxicity.fit(docs, table, use=F.col("doc_id") % 4 != 3)
    found = toxicity.score(docs, model).collect()
    score = {r.doc_id: r.score for r in found}
    assert len(found) == len(rows) + 6
    bad = [score[i] for i in range(400) if i % 4 == 0]
    good = [score[i] for i in range(400) if i % 4]
    assert min(bad) > 0.7 and sum(g > 0.3 for g in good) == 0
    assert score[1000] == score[1001] == score[1002] < 0.3 and score[1003] > 0.7
    places = [(r.start, r.end) for r in toxicity.spans(docs, model).filter("doc_id = 1003").orderBy("start").collect()]
    text = extra[3][1]
    assert {text[a:b] for a, b in places} >= {"vilyx"} and any("ümok" in text[a:b] for a, b in places)
    assert toxicity.spans(docs, model).filter("doc_id in (1000, 1001, 1002)").count() == 0
    # no labels, one label, no documents
    nobody = toxicity.fit(docs, table.limit(0))
    assert toxicity.score(docs, nobody).agg(F.max("score")).first()[0] < 0.01
    assert toxicity.score(docs, toxicity.fit(docs, table.filter("toxic = 1"))).agg(F.min("score")).first()[0] > 0.99
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), table)).count() == 0


def test_toxic_documents_with_most_of_the_words(spark):
    """Long toxic documents hold more than half of all surroundings; their words are found all the same."""
    rows, labels, schema = toxic_tables(spark)
    long = [(r[0], f"{r[1]} {' '.join(x[1] for x in rows if x[0] % 4 and x[0] % 29 == r[0] % 29)}" if r[0] % 4 == 0 else r[1], *r[2:]) for r in rows]
    docs, table = spark.createDataFrame(long, CLASH), spark.createDataFrame(labels, schema)
    model = toxicity.fit(docs, table, use=~(F.col("doc_id") % 8).isin(4, 6, 7))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    bad, good = [v for i, v in score.items() if i % 8 == 4], [v for i, v in score.items() if i % 8 >= 6]
    assert min(bad) > 0.7 and max(good) < 0.3


def test_windows_of_clean_documents_are_clean():
    tokens = toxicity.Tokens.of(pa.array(["ab cd ef gh"]))
    assert tokens.features.shape == (4, toxicity.FEATURES)
    assert (tokens.before[0], tokens.after[3]) == (toxicity._EDGE, toxicity._EDGE)
    # words of two bytes have no beginning of three
    assert (tokens.units[1:] == toxicity._EDGE).all()


@pytest.fixture(scope="module")
def tokenizers():
    files = [open(os.path.join(TOKENIZERS, f), "rb").read() for f in (BYTES, PIECES)]
    return align.Tokenizers(*files)


ODD = ["", None, " ", "  ", "a", "a  b ", " lead", "trail ", "It's they'll 123,456.78!!", "naïve façade Übergröße", "日本語 テキスト", "😀 x", "▁ mark", "a\x00b", "tab\tnew\n\n\nline",
       "<|endoftext|> and <s> </s> <unk> <0x41>", "é", " nbsp", "x" * 3000, " " * 70, "ǅ ß ſ ʼn", "\r\n\x85  ", "a" * 40 + "'s"]


def test_fast_ways_give_the_libraries_tokens(tokenizers):
    rng = np.random.default_rng(3)
    alphabet = ["a", "ing", "The", " ", "  ", "\n", "é", ".", "'s", "1", "日", "▁", "<|endoftext|>", "!", "ß"]
    texts = ODD + ["".join(rng.choice(alphabet, rng.integers(1, 30))) for _ in range(600)]
    for text, (a, b) in zip(texts, tokenizers.encode(texts), strict=True):
        want_a, want_b = [], []
        if text:
            want_a, want_b = tokenizers.a.encode(" " + text, add_special_tokens=False).ids, tokenizers.b.encode(text)
            if not b"".join(tokenizers.bytes_a[i] for i in want_a) == (" " + text).encode() == b"".join(tokenizers.bytes_b[i] for i in want_b):
                want_a, want_b = [], []
        assert (a.tolist(), b.tolist()) == (want_a, want_b), text


def test_perfect_hash():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(0, 1 << 40, n))
        own = align.PerfectHash.of(keys)
        assert sorted(own.number(keys).tolist()) == list(range(len(keys)))
        if len(keys):
            table = np.empty_like(keys)
            table[own.number(keys)] = keys
            with pytest.raises(ValueError):
                own.verified(np.array([1 << 41]), table)


def brute_alignment(tokenizers, texts):
    docs = []
    for a, b in tokenizers.encode(texts):
        def spans(ids, own):
            at, out = 0, []
            for i in ids.tolist():
                out.append((i, at, at + len(own[i])))
                at += len(own[i])
            return out
        x, y = spans(a, tokenizers.bytes_a), spans(b, tokenizers.bytes_b)
        links = [(i, j) for i, s, e in x for j, u, v in y if s < v and u < e]
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        groups, lo = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, _, e in x if lo < e <= c) + "|" + ",".join(str(i) for i, _, e in y if lo < e <= c))
            lo = c
        docs.append((len(x), len(y), links, groups))
    count = collections.Counter(p for d in docs for p in set(d[2]))
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return count, [(x, y, len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), ";".join(g)) for x, y, links, g in docs]


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, tokenizers, monkeypatch, small):
    if small:  # many ranges and teams, and a tree of two levels
        monkeypatch.setattr(align, "RANGE_PAIRS", 8)
        monkeypatch.setattr(align, "GROUP_BYTES", 16)
        monkeypatch.setattr(align, "FAN_IN", 2)
    texts = ODD + ["the cat sat on the mat", "the cat sat on the mat", "The Cat, sat; on\nthe mat."] * 3
    rows = [(i if i != 4 else None, t, 1, 1, 1, "c", "g", 0.0, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[8]], CLASH).repartition(4)
    own = align.Alignment(docs, os.path.join(TOKENIZERS, BYTES), os.path.join(TOKENIZERS, PIECES))
    got = own.documents().collect()
    count, want = brute_alignment(tokenizers, [*texts, texts[8]])
    assert collections.Counter(map(tuple, got)) == collections.Counter((r[0], *w) for r, w in zip([*rows, rows[8]], want, strict=True))
    assert {(r.a_id, r.b_id): r.documents for r in own.pair_counts().collect()} == dict(count)
    if not small:
        empty = align.Alignment(docs.limit(0), os.path.join(TOKENIZERS, BYTES), os.path.join(TOKENIZERS, PIECES))
        assert empty.documents().count() == 0 and empty.pair_counts().count() == 0


def test_alignment_query_over_a_table(spark, tokenizers):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy(F.length("text")).limit(60).collect()
    every = {r.doc_id: r for r in op13_tokenizer_alignment(spark, sf).collect()}
    _, want = brute_alignment(tokenizers, [r.text for r in docs])
    for r, w in zip(docs, want, strict=True):
        got = every[r.doc_id]
        assert (got.n_a, got.n_b, got.n_groups, got.n_links) == w[:4]
        assert got.n_best <= got.n_links <= got.count_sum
        assert len(got.groups_sha256) == (64 if w[0] else 0)
