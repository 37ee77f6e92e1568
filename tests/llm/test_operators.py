"""Every operator against a brute-force version, on small fixtures with nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns with clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import _common, bpe, components, hashed, linededup, mixing, repetition, sharding, simhash, topk, toxicity, urlfilter, weaklabel
from spanloom.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [sentence(r, 60) for _ in range(12)]
    near = [b.replace(b.split()[30], "changed") for b in base[:6]]
    lines = ["\n".join([sentence(r, 12), base[0], sentence(r, 3)]) for _ in range(4)]
    return [*base, *near, *base[:3], *lines, None, "", "  \n ", "one", "One", "two words", sentence(r, 4000), "é ü 😀   x", "a\nb\na\n\nb"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", [None, "b", "a", "ü"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], "en", "a", 1), (5, "same id, other text", "en", "a", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def clashing(docs):
    """Extra columns named as the operators' own."""
    names = "fp key size root component_id text_key removed target whole last_key node a b id page shard quality flag s times n_words entry base _whole _last last copies copy _row place tie at i head kept_in usual tag".split()
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def classes(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


# --- connected components


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 440)] + [(7, 7)]
    df = spark.createDataFrame([*pairs, (None, 3), (1000, 1000)], "x long, y long")
    got = {n: c for n, c in components.connected_components(df).collect()}
    of = classes(1001, pairs)
    least = defaultdict(lambda: 10**9)
    for i, c in enumerate(of):
        least[c] = min(least[c], i)
    touched = {i for p in pairs for i in p if p[0] != p[1]}
    want = {i: least[of[i]] for i in touched if least[of[i]] != i}
    assert got == want
    assert components.connected_components(df.limit(0)).count() == 0


# --- 1 toxicity


def toxic_corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = sentence(r, r.randrange(5, 60)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(r.randrange(1, 8)):
                words.insert(r.randrange(len(words)), r.choice(["vilest", "vilely", "hateful", "scummy"]))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_held_out(spark):
    train, test = toxic_corpus(600, 1), toxic_corpus(300, 2)
    docs = spark.createDataFrame([t[:2] for t in train], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in train] + [(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    held = spark.createDataFrame([(t[0], t[1]) for t in test], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.graded(held, model).collect()}
    right = sum(got[i].rejected == bool(y) for i, _, y in test)
    assert right >= 0.97 * len(test)
    for i, t, _ in test[:50]:  # the same sums, feature by feature
        w = dict(zip(model.places.tolist(), model.weights.tolist()))
        score = sum((1 + math.log(n)) * w.get(p, 0) for x, n in toxicity.words_of(t).items() for p in hashed.features(x))
        want = [1 / (1 + math.exp(-max(-700, min(700, score - c)))) for c in model.thresholds]
        assert got[i].p_toxic == pytest.approx(want[0], abs=1e-9) and got[i].expected_severity == pytest.approx(sum(want), abs=1e-9)
    mass = [(sum(w in ("vilest", "vilely", "hateful", "scummy") for w in t.split()), got[i].expected_severity) for i, t, y in test if y]
    many, few = [s for m, s in mass if m >= 6], [s for m, s in mass if m <= 2]
    assert np.mean(many) > np.mean(few)


def test_toxicity_gradients():
    r = np.random.default_rng(0)
    grades, score, extra = np.array([0, 1, 2, 2, 0, 1]), r.normal(size=6), np.array([0.3, -0.2])

    def nll(score, extra):
        cuts = np.array([extra[0], extra[0] + math.exp(extra[1])])
        above = np.concatenate([np.ones((6, 1)), 1 / (1 + np.exp(-(score[:, None] - cuts))), np.zeros((6, 1))], 1)
        return -np.log(above[np.arange(6), grades] - above[np.arange(6), grades + 1]).sum()

    g, e = toxicity._gradients(grades, 2)(score, extra)
    for x, got in ((score, g), (extra, e)):
        for i in range(len(x)):
            old, step = x[i], 1e-6
            x[i] = old + step
            up = nll(score, extra)
            x[i] = old - step
            down = nll(score, extra)
            x[i] = old
            assert got[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    for model in (toxicity.train(docs, labels.limit(0)), toxicity.train(empty, labels), toxicity.train(docs, labels.where("toxic = 0"))):
        got = toxicity.graded(clashing(docs), model).collect()
        assert len(got) == docs.count() and not any(r.rejected for r in got)
    model = toxicity.train(docs, labels)
    assert toxicity.graded(empty, model).count() == 0
    kept = toxicity.accepted(clashing(docs), model)
    assert kept.columns == clashing(docs).columns


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """One document of each sampled id, and so many words of it, come to the driver, however often an id is repeated."""
    rows_ = [(i % 12, f"text {j} of {i % 12} " + ("vile " * (i % 2)) + " ".join(f"w{j}x{k}" for k in range(30))) for j, i in enumerate(range(3000))]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    seen = []
    kept = toxicity._trained
    monkeypatch.setattr(toxicity, "_trained", lambda got: seen.append(got) or kept(got))
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 20)
    toxicity.train(docs, labels, rows=10)
    assert seen[0].num_rows == 10 and len(set(seen[0]["id"].to_pylist())) == 10
    whole = {i: min((t for k, t in rows_ if k == i), key=lambda t: hashlib.md5(t.encode()).hexdigest()) for i in range(12)}
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 1000)
    toxicity.train(docs, labels, rows=10)
    for i, words, counts in zip(*(seen[1][c].to_pylist() for c in ("id", "words", "counts"))):
        assert dict(zip(words, counts)) == toxicity.words_of(whole[i])
    assert len(toxicity._sampled_words(" ".join(f"a{i}" for i in range(5000)))) == 1000


# --- 2 SimHash


def brute_fingerprint(text):
    words = [w for w in (text or "").translate({c: chr(c + 32) for c in range(65, 91)}).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items):
    fps = [f for _, f in items]
    of = classes(len(items), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    ids = defaultdict(list)
    for (i, _), c in zip(items, of):
        ids[c] += [] if i is None else [i]
    return [min(ids[c], default=None) for c in of]


def test_simhash(docs, texts):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(clashing(docs)).collect())
    items = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    assert got == Counter((i, f"{f:016x}", c) for (i, f), c in zip(items, brute_components(items)))


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_simhash_links_random_balls(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)  # 2: most keys take the third segment
    r = random.Random(hot)
    fps = {0}
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            for b in r.sample(range(64), r.randrange(1, 5)):
                f ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 6 for a, b in edges)
    at = {f: i for i, f in enumerate(fps)}
    got = classes(len(fps), [(at[a], at[b]) for a, b in edges])
    want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_pigeonring_budgets():
    r = random.Random(9)
    for _ in range(2000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randrange(4)):
            b ^= 1 << bit
        x, y = np.array([a], np.uint64), np.array([b], np.uint64)
        assert any(simhash._near(x, y, 20 + i)[0, 0] for i in range(4))


def test_simhash_keeps_one(docs):
    kept = simhash.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns
    items = [(r.doc_id, brute_fingerprint(r.text), r.text) for r in docs.collect()]
    groups = defaultdict(list)
    for (i, f, t), c in zip(items, classes(len(items), [(i, j) for i in range(len(items)) for j in range(i) if (items[i][1] ^ items[j][1]).bit_count() <= 3])):
        groups[c].append((i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest()))
    want = Counter((None if m[0] else m[1], m[2]) for m in map(min, groups.values()))
    assert Counter((r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) for r in kept.collect()) == want


def test_keep_one_is_the_same_in_every_order(spark):
    rows_ = [(1, "a b c d", "en", s, 0) for s in ("z", "y", "x", None)] + [(None, "e f g h", "en", s, 0) for s in ("q", "p")]
    got = {tuple(map(tuple, simhash.keep_one(spark.createDataFrame(x, DOCS).repartition(4)).orderBy("text").collect())) for x in (rows_, rows_[::-1], rows_[3:] + rows_[:3])}
    assert len(got) == 1 and len(next(iter(got))) == 2


def test_keep_one_links_similarity(spark):
    """Pairs of texts at five-word Jaccard 0.8 or more, most of them more than three bits apart, leave one text each."""
    r = random.Random(14)
    pairs, bits = [], []
    while len(pairs) < 40:
        a = sentence(r, r.randrange(60, 200)).split()
        b = list(a)
        for _ in range(r.randrange(1, 4)):
            b[r.randrange(len(b))] = "changed"
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        if len(x & y) >= 0.8 * len(x | y):
            pairs.append((" ".join(a), " ".join(b)))
            bits.append((simhash.fingerprint(pairs[-1][0].encode(), 5) ^ simhash.fingerprint(pairs[-1][1].encode(), 5)).bit_count())
    assert sum(n > 3 for n in bits) > 20
    unlike = [sentence(r, 80) for _ in range(10)] + ["", None, "  "]
    texts = [t for p in pairs for t in p] + unlike
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    kept = {x.doc_id for x in simhash.keep_one(clashing(docs), width=5, similarity=0.8).collect()}
    assert kept == {2 * i for i in range(len(pairs))} | {2 * len(pairs) + i for i in range(11)}


# --- 3 top-k


def brute_top_k(vectors, k=10):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in {i: v for i, v in sorted(whole, reverse=True)}.items():
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return Counter(out)


@pytest.mark.parametrize("block,queries", [(8192, 1024), (7, 2)])
def test_top_k(spark, block, queries):
    r = random.Random(3)
    vectors = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(450)]
    vectors += [(i + 1000, vectors[5][1]) for i in range(15)] + [(2000, None), (2100, [0.1, None] + [0.0] * 6), (2200, [float("nan")] * 8), (None, [1.0] * 8), (2300, [float("inf")] * 8), (2400, [0.5] * 3), (2500, []), (2600, [1e8] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rows", F.lit(1)).withColumn("x", F.lit(2))
    whole = topk.whole_vectors(df)
    got = topk.top_k(whole, whole.where("vec_id % 100 = 0"), block=block, query_block=queries)
    assert rows(got) == brute_top_k(vectors)


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    w = topk.whole_vectors(df)
    assert [(r.vec_id, r.rank) for r in topk.top_k(w, w.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert topk.top_k(w.limit(0), w.limit(0)).count() == 0


def test_top_k_of_large_numbers_and_repeated_vectors(spark):
    """Scores beyond what doubles hold, and a vector that half of all rows repeat."""
    r = random.Random(31)
    big = [(i, [float(r.choice([-1, 1]) * (2**29 + r.randrange(99))) / 1024 for _ in range(3)]) for i in range(60)]
    same = [(300 + i % 3, big[7][1]) for i in range(120)]
    for vectors in (big, big + same):
        w = topk.whole_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
        got = topk.top_k(w, w.where("vec_id % 100 = 0"), block=16, query_block=2)
        assert rows(got) == brute_top_k(vectors)
    blocks, n = topk._packed(w, 16)
    assert max(len(b.rows) for b in blocks.collect()) < 40 and n == 12


def test_top_k_postings():
    r = np.random.default_rng(2)
    x = r.integers(-300, 300, (50, 6))
    x[3] = 0
    s = topk.Segments.of(np.arange(50), x)
    assert sorted(zip(s.row.tolist(), s.dim.tolist(), s.value.tolist())) == [(i, j, float(x[i, j])) for i in range(50) for j in range(6) if x[i, j]]
    assert list(s.levels) == sorted(set(s.levels), reverse=True)
    for i, level in enumerate(s.levels):
        part = np.abs(s.value[s.cuts[i] : s.cuts[i + 1]])
        assert ((part >= 2 ** (level - 1)) & (part < 2**level)).all()
        below = np.where(np.abs(x) < 2 ** (level - 1), x, 0)
        assert np.allclose(s.left[i], np.sqrt((below.astype(float) ** 2).sum(1)))


def test_top_k_stops_early_and_right():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-40, 40, (3000, 16)), r.integers(-900, 900, (30, 16))]).astype(float)
    q = r.integers(-900, 900, (20, 16)).astype(float)
    s = topk.Segments.of(np.arange(len(x)), x.astype(np.int64))
    for i, (ids, score) in enumerate(s.search(q, np.full(20, -1), 10)):
        want = sorted((-int(v), j) for j, v in enumerate(x @ q[i]))[:10]
        assert [(-int(v), j) for j, v in zip(ids.tolist(), score.tolist())] == want


def shuffled_bytes(spark, action):
    """Bytes that the stages of ``action`` write to shuffles."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: {(s := found.apply(i)).stageId(): s.shuffleWriteBytes() for found in [sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())] for i in range(found.size())}
    before = stages()
    action()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k not in before)


def test_top_k_ships_an_index_once(spark):
    """20 query blocks meet 40 index blocks: the index does not travel with each of them."""
    r = np.random.default_rng(8)
    x = r.normal(0, 0.125, (4000, 64))
    w = topk.whole_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).localCheckpoint()
    got = []
    sent = shuffled_bytes(spark, lambda: got.extend(topk.top_k(w, w.where("vec_id % 100 = 0"), block=100, query_block=2).collect()))
    assert len(got) == 400 and sent < 2 * x.nbytes
    whole = np.floor(1024 * x).astype(np.int64)
    for q in (0, 1700, 3900):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:10]
        assert sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]


def test_top_k_blocks_of_wide_vectors_are_smaller(spark):
    w = spark.range(40).select(F.col("id").alias("vec_id"), F.array_repeat(F.col("id"), 1 << 16).alias("x"))
    blocks, n = topk._packed(w, 8192)
    assert n == 5 and max(len(b.ids) // 8 for b in topk._narrow(blocks).collect()) < 25


# --- 4 sharding


def brute_shards(items, limit):
    """items: (key, bytes); the leaf prefix of each key."""
    out = {}

    def split(members, depth, prefix):
        if sum(b for _, b in members) <= limit or depth == 60:
            out.update({k: (depth, prefix, sum(b for _, b in members)) for k, _ in members})
            return
        for bit in (0, 1):
            split([m for m in members if m[0] >> (59 - depth) & 1 == bit], depth + 1, prefix * 2 + bit)

    split(items, 0, 0)
    return out


@pytest.mark.parametrize("limit", [10**9, 3000, 500, 60])
def test_sharding(docs, limit):
    slim = sharding._slim(docs).collect()
    want = brute_shards([(r.key, r.n_bytes) for r in slim], limit)
    got = sharding.assigned(clashing(docs), limit).collect()
    assert Counter((r.doc_id, r.n_bytes, r.depth, r.prefix, r.shard_bytes) for r in got) == Counter((r.doc_id, r.n_bytes, *want[r.key]) for r in slim)
    pages = Counter()
    for r in got:
        pages[r.depth, r.prefix, r.page] += r.n_bytes
    largest = max(r.n_bytes for r in got)
    assert all(b <= max(limit, largest) for b in pages.values())


def test_sharding_writes(spark, docs, empty, tmp_path):
    sharding.write_shards(clashing(docs), str(tmp_path / "out"), 2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert sharding.assigned(empty).count() == 0


def test_written_shards_keep_the_limit(spark, tmp_path):
    """Repeated rows that alone exceed the limit, and one document over it."""
    rows_ = [(1, "x" * 100)] * 50 + [(2, "y" * 900)] + [(i, "z" * 40) for i in range(3, 60)] + [(None, None)] * 5
    docs = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3).withColumn("shard", F.lit("own"))
    sharding.write_shards(docs, str(tmp_path / "out"), 500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows_) and back.where("shard = 'own'").count() == len(rows_)
    sizes = [r.n for r in back.groupBy("_shard").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n")).collect()]
    assert sorted(sizes)[-1] == 900 and sorted(sizes)[-2] <= 500


def test_copies_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(_common, "COPIES", 7)
    df = spark.createDataFrame([(1, 1), (2, 7), (3, 8), (4, 50)], "k long, n long")
    got = Counter((r.k, r.i) for r in _common.numbered_copies(df, "n", "i", ["k"]).collect())
    assert got == Counter((k, i) for k, n in ((1, 1), (2, 7), (3, 8), (4, 50)) for i in range(n))


def test_shared_folder_is_asked_for_on_a_cluster():
    class Fake:
        def __getattr__(self, name):
            return lambda *a, **k: self

        master, isEmpty = "spark://host:7077", staticmethod(lambda: True)
        getConf = staticmethod(lambda: {})

    spark = Fake()
    spark.sparkContext, spark.conf = Fake(), {}
    spark.sparkContext._jsc = Fake()
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        _common._shared_folder(spark)


# --- 5 repetition


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    inside = {}
    for n in range(5, 11):
        times = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        hit = {j for i in range(len(words) - n + 1) if times[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
        inside[n] = (len(hit), sum(len(words[j]) for j in hit))
    seen, dup, chars = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            if line in seen:
                dup, chars = dup + 1, chars + len(re.sub(r"[\x20\x09-\x0D]", "", line))
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": inside[5][0], "dup_line_chars": chars, "covered": {n: c for n, (_, c) in inside.items()}}


def test_repetition(docs, texts):
    r = random.Random(2)
    some = [*texts, "x y " * 40, "a b c d e f\n" * 9, " ".join(r.choice("ab") for _ in range(300)), "é|ü\n" * 5, "one two three four five six one two three four five", "   x"]
    for t in some:
        assert repetition.measures(None if t is None else t.encode()) == brute_measures(t)
    got = repetition.rated(clashing(docs))
    want = [(d.doc_id, brute_measures(d.text)) for d in docs.collect()]
    assert Counter((x.doc_id, x.n_words, x.n_repeat_words, x.kept) for x in got.collect()) == Counter((i, m["n_words"], m["n_repeat_words"], repetition.verdict(m)[1]) for i, m in want)
    assert repetition.kept_documents(clashing(docs)).count() == sum(repetition.verdict(m)[1] for _, m in want)


# --- 6 weak labels


def test_em_finds_accuracies():
    r = np.random.default_rng(4)
    truth = r.random(20000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    votes = np.where(r.random((20000, 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None] * (r.random((20000, 5)) < 0.8)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, accuracies = weaklabel.estimate(patterns, counts.astype(float))
    assert np.abs(accuracies - right).max() < 0.03
    assert ((post[at.ravel()] > 0.5) == truth).mean() > 0.93


def test_quality_held_out(spark, docs, empty):
    r = random.Random(8)
    good = [". ".join(" ".join(["the", *sentence(r, 8).split(), "and"]).capitalize() for _ in range(6)) + "." for _ in range(150)]
    bad = ["\n".join(f"{w.upper()}!!! $$$ %%% {w.upper()}!!! {w.upper()}!!!" for w in sentence(r, 20).split()) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = weaklabel.train(df.where("doc_id % 2 = 0"))
    got = {x.doc_id: x.kept for x in weaklabel.scored(df.where("doc_id % 2 = 1"), model).collect()}
    assert sum(k == (i < 150) for i, k in got.items()) >= 0.97 * len(got)
    assert weaklabel.scored(clashing(docs), model).count() == docs.count()
    assert weaklabel.scored(empty, weaklabel.train(empty)).count() == 0
    assert weaklabel.kept_documents(clashing(docs), model).columns == clashing(docs).columns


def brute_em(votes, rounds=100):
    """EM document by document, in plain Python."""
    n, m = len(votes), len(votes[0])
    post = [min(0.95, max(0.05, 0.5 + 0.5 * sum(v) / m)) for v in votes]
    for _ in range(rounds):
        prior = min(0.99, max(0.01, sum(post) / n))
        rate = {}
        for good in (0, 1):
            for j in range(m):
                weigh = {v: 0.5 + sum((p if good else 1 - p) for p, d in zip(post, votes) if d[j] == v) for v in (-1, 1)}
                for v in (-1, 1):
                    rate[good, j, v] = weigh[v] / (weigh[-1] + weigh[1])
        new = []
        for d in votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[1, j, v] / rate[0, j, v]) for j, v in enumerate(d) if v)
            new.append(1 / (1 + math.exp(-odds)))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        if done:
            break
        post = new
    return post


def test_weak_labels_match_brute_force(spark, docs):
    """Posteriors of every document against EM over documents, and the scorer feature by feature."""
    r = random.Random(18)
    more = [(500 + i, " ".join(w.upper() + "!!!" if i % 4 == 0 else w for w in sentence(r, r.randrange(1, 60)).split()) + r.choice([".", "", " | |"]), "en", "a", 0) for i in range(80)]
    both = docs.unionByName(spark.createDataFrame(more, DOCS))
    model = weaklabel.train(both)
    got = weaklabel.scored(clashing(both), model).collect()
    texts_ = [d.text for d in both.collect()]
    votes = [weaklabel.votes(weaklabel._read(t)[1]) for t in texts_]
    weight = dict(zip(model.places.tolist(), model.weights.tolist()))
    for x, t, p in zip(got, texts_, brute_em(votes)):
        assert x.weak_label == pytest.approx(p, abs=1e-6)
        words, shape = weaklabel._read(t)
        score = model.bias + sum(n * weight.get(f, 0) for w, n in words.items() for f in hashed.features(w)) * 4 / max(50, shape["n"])
        score += sum(weight.get(f, 0) for w in weaklabel._shape_words(shape) for f in hashed.features(w))
        assert x.quality == pytest.approx(1 / (1 + math.exp(-score)), abs=1e-9) and x.kept == (x.quality >= 0.5)
    assert set(model.labellers()) == set(weaklabel.LABELLERS) and all(0 <= a <= 1 for a in model.accuracies)


def test_weak_label_sample_with_repeated_rows(spark):
    """Rows that repeat without end leave a model of all different texts."""
    r = random.Random(19)
    rows_ = [(i % 3, f"same words of {i % 3} over and over.") for i in range(30000)] + [(100 + i, sentence(r, 30).capitalize() + ".") for i in range(40)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    for n in (20, 6000):
        model = weaklabel.train(docs, n)
        assert math.isfinite(model.bias) and np.isfinite(model.weights).all()
        assert all(x.kept for x in weaklabel.scored(docs.where("doc_id >= 100"), model).collect())
    assert weaklabel.train(docs.limit(0)).posteriors == {}


# --- 7 line dedup


def brute_lines(docs, width=linededup.WIDTH):
    def shingles(x):
        return {x[i : i + width] for i in range(max(1, len(x) - width + 1))}

    lines = [(r.doc_id is None, r.doc_id or 0, xxhash.xxh64_intdigest((r.text or "").encode()) - 2**63, i, x) for r in docs for i, x in enumerate((r.text or "").split("\n")) if x.strip(" \t\n\v\f\r")]
    lines = sorted(set(lines))
    sets = [shingles(x[-1]) for x in lines]
    of = classes(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    seen, out = {}, {(r.doc_id, xxhash.xxh64_intdigest((r.text or "").encode()) - 2**63): [0, []] for r in docs}
    for line, c in zip(lines, of):
        place = None if line[0] else line[1]
        d = out[place, line[2]]
        d[0] += 1
        if c in seen:
            d[1].append((line[3], seen[c]))
        seen.setdefault(c, (place, line[3]))
    return {k: (n, [i for i, _ in sorted(x)], [p for _, p in sorted(x)]) for k, (n, x) in out.items()}


@pytest.mark.parametrize("block", [256, 2])
def test_line_dedup(spark, docs, monkeypatch, block):
    monkeypatch.setattr(linededup, "BLOCK", block)
    r = random.Random(6)
    lines = [sentence(r, 25) for _ in range(30)]
    fuzzy = [x.replace(x.split()[7], "w", 1) for x in lines[:15] for _ in range(3)]
    more = spark.createDataFrame([(100 + i, "\n".join(r.sample(lines + fuzzy, 4)), "en", "a", 0) for i in range(25)], DOCS)
    both = docs.unionByName(more)
    got = {(x.doc_id, x.text_key): (x.n_lines, x.removed, [tuple(p) for p in x.kept_in]) for x in linededup.line_decisions(clashing(both)).collect()}
    assert got == brute_lines(both.collect())
    out = linededup.deduplicated(clashing(both))
    assert out.columns == clashing(both).columns and out.count() == both.count()
    want = brute_lines(both.collect())
    texts = Counter()
    for d in both.collect():
        gone = want.get((d.doc_id, xxhash.xxh64_intdigest((d.text or "").encode()) - 2**63), (0, []))[1]
        texts[d.doc_id, None if d.text is None else "\n".join(x for i, x in enumerate(d.text.split("\n")) if i not in gone)] += 1
    assert Counter((d.doc_id, d.text) for d in out.collect()) == texts


def test_line_dedup_empty(empty):
    assert linededup.line_decisions(empty).count() == 0 and linededup.deduplicated(empty).count() == 0


def test_banding_recall():
    r = random.Random(11)
    hit = n = 0
    for _ in range(300):
        a = sentence(r, 40)
        w = a.split()
        w[r.randrange(40)] = "q"
        b = " ".join(w)
        x, y = ({t[i : i + linededup.WIDTH] for i in range(len(t) - linededup.WIDTH + 1)} for t in (a, b))
        if len(x & y) >= 0.8 * len(x | y):
            n += 1
            s, sketch = linededup.signatures([a, b])
            hit += bool((s[0] == s[1]).any()) and linededup._agree(sketch[:1], sketch[1:])[0] >= linededup.AGREE
    assert n > 100 and hit >= 0.97 * n


def test_line_dedup_links_short_edits(spark):
    """One-word edits of lines of 49 to 90 characters whose sets of 5-character shingles are at 0.8 or more."""
    r = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = []
    while len(pairs) < 60:
        w = ["".join(r.choice(letters) for _ in range(r.randrange(2, 7))) for _ in range(r.randrange(10, 17))]
        w[r.randrange(1, len(w) - 1)] = "1998"
        a = " ".join(w)
        b = a.replace("1998", "1999")
        if len(a) > 90:
            continue
        narrow, wide = (len(x & y) / len(x | y) for x, y in (({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b)) for n in (5, 9)))
        if narrow >= 0.8 and wide < 0.8:
            pairs.append((a, b))
    assert min(len(a) for a, _ in pairs) < 60
    docs = spark.createDataFrame([(2 * i + k, x, "en", "a", 0) for i, p in enumerate(pairs) for k, x in enumerate(p)], DOCS)
    gone = {x.doc_id for x in linededup.line_decisions(docs).where("size(removed) > 0").collect()}
    assert gone <= {2 * i + 1 for i in range(len(pairs))} and len(gone) >= 0.95 * len(pairs)  # banding may miss one at the threshold


# --- 8 URL filters


def brute_rule(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = m[1].translate({c: chr(c + 32) for c in range(65, 91)}), m[2]
    fit = [(len(t), t, v) for v, t in URL_RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_url_filter(spark):
    urls = ["http://WWW.Example.com/en/1", "https://m.example.com/en/2?x=1", "http://example.com/fr/", "http://x.net/es/", "http://x.net/de/", "http://a.org/1", "http://a.org/1#top", "http://b.org", "nothing", None, "", "http://notcom/", "http://com/", "http://x.net", "http://c.org/a?u=http://x.net/es/", "http://é.com/", "http://b.org"]
    link = {5: '<LINK href="http://x.net/es/7" rel="canonical">', 7: '<meta http-equiv=refresh content="0; url=/next?a=1">', 13: '<link rel=canonical href=//q.com/x>', 14: None}
    pages = spark.createDataFrame([(i, u, link.get(i, "<p>canonical refresh")) for i, u in enumerate(urls)], "page_id long, url string, html string")
    jumps = spark.createDataFrame([("http://b.org/next?a=1#z", "http://y.net/fr/1"), ("http://c.org/a?u=http://x.net/es/", "http://z.com/"), ("http://c.org/a?u=http://x.net/es/", "http://y.net/fr/1#b"), (None, "http://b.org")], "source string, target string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(pages.withColumn("root", F.lit(1)), URL_RULES, jumps).collect()}
    # b.org -> /next -> y.net/fr <- c.org -> z.com: one class, with an explicit allow; a.org/1 -> x.net/es: blocked
    shared = {5: "block", 6: "block", 7: "allow", 14: "allow", 16: "allow", 13: "allow"}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert got[i] == (host, path, rule, verdict or shared.get(i, "allow")), u
    alone = {r.page_id: r.verdict for r in urlfilter.judged(pages, URL_RULES, jumps.where("target like '%y.net%'")).collect()}
    assert alone[7] == alone[14] == alone[16] == "block"
    kept = urlfilter.kept_pages(pages, URL_RULES)
    assert kept.columns == pages.columns and kept.count() == sum(r.verdict == "allow" for r in urlfilter.judged(pages, URL_RULES).collect())
    assert urlfilter.judged(pages.limit(0), URL_RULES).count() == 0


def test_url_targets(spark):
    from urllib.parse import urljoin

    base = "http://a.org/x/y/page?q=1"
    targets = ["z.html", "../z", "../../../z", "./z/./w", "/p?u=http://x.net/es/", "?id=3", "//q.com/a", "https://Q.com/a", "z/..", ".", "..", "a:b", "mailto:x@y.org", "#top", "z#f"]
    df = spark.createDataFrame([(t,) for t in targets], "t string")
    got = {r.t: r.u for r in df.select("t", urlfilter.resolved(F.lit(base), F.col("t")).alias("u")).collect()}
    for t in targets:
        assert got[t] == (None if t in ("a:b", "mailto:x@y.org", "#top") else urljoin(base, t)), t
    for page, t, u in (("http://a.org", "z", "http://a.org/z"), (base, "a//b", "http://a.org/x/y/a//b")):  # RFC 3986 keeps empty steps
        assert spark.range(1).select(urlfilter.resolved(F.lit(page), F.lit(t))).first()[0] == u


def test_url_links_of_pages(spark):
    own = {
        "query string": ("http://a.org/1", "<link rel=canonical href='/p?u=http://x.net/es/'>", "allow"),
        "comment": ("http://b.org/1", "<!-- <link rel=canonical href=http://x.net/es/1> -->", "allow"),
        "script": ("http://c.org/1", "<script>'<link rel=canonical href=http://x.net/es/1>'</script>", "allow"),
        "relative": ("http://x.net/de/1", "<link href='../es/1.html' rel=\"canonical\">", "block"),
        "second link": ("http://d.org/1", "<link rel=stylesheet href=/a><link rel=canonical href=/b><link rel=canonical href=http://x.net/es/2>", "block"),
        "refresh": ("http://e.org/1", "<META content='3; URL=http://x.net/fr/9' http-equiv='Refresh'>", "block"),
        "variants": ("http://www.f.org/1.html", "", "block"),
        "their other form": ("https://f.org/1?utm_source=feed", "<link rel=canonical href=http://x.net/es/5>", "block"),
        "other attribute": ("http://g.org/1", "<link rel=canonical data-href=http://x.net/es/1>", "allow"),
        "no markup": ("http://h.org/1", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, h) for k, (u, h, _) in own.items()], "page_id string, url string, html string")
    assert {r.page_id: r.verdict for r in urlfilter.judged(pages, URL_RULES).collect()} == {k: v for k, (_, _, v) in own.items()}
    alone = {r.page_id: r.verdict for r in urlfilter.judged(pages, URL_RULES, usual=False).collect()}
    assert alone["variants"] == "allow" and alone["their other form"] == "block"


def test_first_of_equally_long_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "")], "page_id long, url string, html string")
    for a, b in (("allow", "block"), ("block", "allow")):
        assert urlfilter.judged(pages, [(a, "a.org/x"), (b, "a.org/x")]).first().verdict == a


# --- 9 BPE


@pytest.fixture(scope="module")
def tokenizer():
    p = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, p.PATTERN, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_chunks_agree(tokenizer):
    path, pattern, ref = tokenizer
    c = bpe.codec(path, pattern)
    r = random.Random(7)
    for _ in range(600):
        t = "".join(r.choice("ab é  \n\t's're'll123 $%😀ñ.ß中") for _ in range(r.randrange(200))) + r.choice(["", "a" * 60, " " * 50 + "x", "\n" * 40, "<|endoftext|>"])
        for chunk, overlap in ((10, 6), (20, 5), (7, 20), (50, 10), (1 << 20, 8)):
            ids = c.encode(t, chunk, overlap)
            assert ids == ref.encode_ordinary(t)
            assert c.decode(ids) == t.encode()
    assert bpe._merge_long(b"abracadabra" * 5, c.ranks) == c._merge(b"abracadabra" * 5)


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (50, 12)])
def test_bpe_rows(tokenizer, docs, empty, chunk, overlap):
    path, pattern, ref = tokenizer
    got = bpe.encoded(clashing(docs), path, pattern, True, chunk, overlap).collect()
    want = Counter()
    for d in docs.collect():
        ids = ref.encode_ordinary(d.text or "")
        want[d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((*r[:4], tuple(r.ids)) for r in got) == want
    assert bpe.encoded(empty, path, pattern).count() == 0


# --- 10 mixing


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, free, total = {}, set(order), sum(sizes.values())
    while free:  # clamp, redistribute, until feasible
        rest = total - sum(goal.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s] + 1e-9}
        if not over:
            goal |= share
            break
        goal |= {s: epochs * sizes[s] for s in over}
        free -= over
    return goal


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 7, 50, 1000, 30000]) for s in [None, "a", "b", "c", "é", "z", "", "ab"]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mixing(spark, docs, empty):
    r = random.Random(12)
    more = spark.createDataFrame([(1000 + i, sentence(r, r.randrange(1, 80)), "en", "abc"[i % 20 % 3 if i % 7 else 0], 0) for i in range(400)], DOCS)
    both = docs.unionByName(more)
    got = mixing.mixed(clashing(both)).collect()
    sizes, taken, target = Counter(), Counter(), {}
    src = {(d.doc_id, n_words(d.text)): d.source for d in both.collect()}
    for x in got:
        s = src[x.doc_id, x.size]
        sizes[s] += x.size
        taken[s] += x.taken
        target[s] = x.target
        assert x.taken in [x.size * k for k in range(4)]
    want = brute_targets(dict(sizes))
    longest = max(x.size for x in got)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= longest + 1
    assert rows(mixing.mixed(both)) == Counter(map(tuple, got))
    out = mixing.repeated(clashing(both))
    assert out.columns == clashing(both).columns
    times = Counter()
    for x in got:
        times[x.doc_id, x.size] += x.taken // x.size if x.size else 1
    assert Counter((x.doc_id, n_words(x.text)) for x in out.collect()) == +times
    assert mixing.mixed(empty).count() == 0 and mixing.repeated(empty).count() == 0
