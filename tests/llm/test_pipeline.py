"""The pipeline's stages on the smallest tables, each against what it should keep."""

from collections import Counter

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(top / str(i)))
        docs = spark.read.parquet(str(top / str(i)))
        out.append(docs)
    return out


def test_columns_and_rows(stages):
    first, toxic, lines, near, mixed, tokens = stages
    for s in (toxic, lines, near, mixed):
        assert s.columns == first.columns
    assert 0.8 * first.count() <= toxic.count() <= first.count()
    assert lines.count() == toxic.count()
    assert tokens.count() == mixed.count()


def test_toxicity_stage_matches_brute_force(spark, stages):
    """The rows that a model fitted likewise rejects, scored feature by feature, and no others are gone."""
    import math

    from spanloom.llm import hashed, toxicity

    model = toxicity.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    weight = dict(zip(model.places.tolist(), model.weights.tolist()))
    kept = Counter()
    for d in stages[0].collect():
        score = sum((1 + math.log(n)) * weight.get(f, 0) for w, n in toxicity.words_of(d.text).items() for f in hashed.features(w))
        kept[tuple(d)] += score < model.thresholds[0]
    assert Counter(map(tuple, stages[1].collect())) == +kept


def test_line_stage_matches_brute_force(stages):
    from test_operators import brute_lines

    want = brute_lines(stages[1].collect())
    import xxhash

    kept = Counter()
    for d in stages[1].collect():
        gone = want.get((d.doc_id, xxhash.xxh64_intdigest((d.text or "").encode()) - 2**63), (0, [], []))[1]
        kept[d.doc_id, "\n".join(x for i, x in enumerate(d.text.split("\n")) if i not in gone)] += 1
    got = Counter((d.doc_id, d.text) for d in stages[2].collect())
    assert sum((got & kept).values()) >= 0.99 * sum(kept.values())  # banding may miss a pair at the threshold


def test_near_stage_matches_brute_force(stages):
    from test_operators import brute_components, brute_fingerprint

    items = [(d.doc_id, brute_fingerprint(d.text)) for d in stages[2].collect()]
    want = {c for c in brute_components(items)}
    assert {d.doc_id for d in stages[3].collect()} == want and stages[3].count() == len(want)


def test_mix_stage_matches_brute_force(stages):
    """Whole repetitions, and once more the documents that come first in the hash order, while half of one still fits."""
    import hashlib

    from test_operators import brute_targets, n_words

    docs = stages[3].collect()
    sizes = Counter()
    for d in docs:
        sizes[d.source] += n_words(d.text)
    want = Counter()
    for source, target in brute_targets(dict(sizes)).items():
        whole = int(target // sizes[source]) if sizes[source] else 0
        rest, upto = target - whole * sizes[source], 0
        mine = sorted((int(hashlib.md5(f"10:{d.doc_id}:{d.text}".encode()).hexdigest()[:15], 16), d.doc_id, n_words(d.text)) for d in docs if d.source == source)
        for _, i, n in mine:
            upto += n
            want[i] += 1 if not n else whole + (rest > 0 and upto - n / 2 <= rest)
    assert Counter(d.doc_id for d in stages[4].collect()) == +want


def test_mix_and_tokens(stages):
    import hashlib

    mixed = Counter(d.doc_id for d in stages[4].collect())
    assert max(mixed.values()) <= 3
    texts = {d.doc_id: d.text for d in stages[4].collect()}
    for t in stages[5].collect():
        assert t.decoded_sha256 == hashlib.sha256(texts[t.doc_id].encode()).hexdigest()


def test_run(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, stages[5].collect()))
