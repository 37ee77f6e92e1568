"""The run layer: plans executed into tables, continued and scored."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import evaluation as E
from spanloom.operators import retrieval as R
from spanloom.plans import execute as X
from spanloom.plans import runs


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _dataset(spark, n=6):
    texts = [f"Alpha {i} lives in town{i}. It eats fruit{i} daily. " * 3 for i in range(n)]
    rows = [(0, "who eats fruit1?", "fruit1 daily", True, [1], 1, {"txt": [(1, texts[1].index("fruit1"), texts[1].index("fruit1") + 6)]}),
            (1, "town3?", "", True, [3], 0, {}),
            (2, "no?", "x", False, [1], 0, {}),
            (3, "far?", "far", True, [99], 0, {}),
            (4, "other?", "other", True, [2], 1, {"md": [(2, 0, 3)]}),
            (5, "nowhere?", "no", True, [], 0, {}),
            (6, "town2 fruit2?", "?!", True, [2], 1, {"txt": [(2, 0, 5)]})]
    schema = "item_id long, question string, answer string, answerable boolean, docs array<long>, n_evidence int, spans map<string,array<struct<doc_id:long,start:int,end:int>>>"
    return X.Dataset({"txt": docs(spark, *texts, None)}, spark.createDataFrame(rows, schema))


CONFIG = {"datasets": "d", "chunking": [{"method": "fixed_token", "params": {"max_tokens": 5, "overlap": 0}}, {"method": "markdown"}], "augmentations": [["keywords", "title"]], "embeddings": ["hashed_words"],
          "retrieval": [{"method": "hybrid", "params": {"top_k": [3]}}], "reranking": [{"method": "cross_encoder", "params": {"model": "lexical_overlap", "top_k": 2}}]}


def test_execute_resumes_and_repeats_nothing(spark, tmp_path):
    data, root = _dataset(spark), str(tmp_path)
    first = X.execute(spark, root, CONFIG, {"d": data}, max_items=1)
    assert len(first) == 2  # plain and reranked; there is no Markdown to read
    again = X.execute(spark, root, CONFIG, {"d": data}, judge="overlap_judge")
    for r in again:
        assert r.skipped == {"unanswerable": 1, "not_indexed": 1, "not_in_rendering": 1, "no_document": 1}
        assert r["items"] == {"evidence": 2, "no_evidence": 1} and r.metrics["evidence"]["doc_hit@3"] == 1.0
        assert r.metrics["no_evidence"]["doc_hit@1"] == 1.0 and set(r.metrics["no_evidence"]) == {f"doc_hit@{k}" for k in E.KS}
        precision, recall, judged, failed = r.ragas["overlap_judge-k=5"]
        assert (judged, failed, recall) == (2, 1, 1.0) and 0 < precision <= 1
    plan = runs.plan(CONFIG, renderings=lambda d: ["txt"])
    for planned in plan:
        run = X.Run(spark, root, planned, data)
        assert run.documents().count() == 7 and run.documents().where("chunks = 0").count() == 1
        assert len([c for c in run._chunk_parts().commits() if c.stage == "chunking"]) == 1
        for option in planned["retrieval"]:
            ranking = run._ranking_parts("hashed_words", option).read("ranking", "retrieval")
            assert ranking.groupBy("item_id", "rank").count().where("count > 1").count() == 0
            assert ranking.groupBy("item_id").agg(F.max("rank").alias("m")).where(F.col("m") > option["top_k"]).count() == 0
    kept = X.Run(spark, root, plan[0], data).evaluate("hashed_words", plan[0]["retrieval"][0])
    assert set(kept.ragas) == {"overlap_judge-k=5"}
    assert plan[0]["augmentations"] == ["title", "keywords"] and {"title", "keywords"} <= set(X.Run(spark, root, plan[0], data).chunks().columns)


def test_uncommitted_parts_do_not_count(spark, tmp_path):
    data, root = _dataset(spark), str(tmp_path)
    run = X.Run(spark, root, runs.plan(CONFIG | {"augmentations": [None]}, renderings=lambda d: ["txt"])[0], data)

    def lost(made):
        raise RuntimeError("lost")

    parts = run._chunk_parts()
    with pytest.raises(RuntimeError):
        parts.add("chunking", chunks=X._chunked(data.renderings["txt"], run.run), documents=lost)
    with pytest.raises(FileNotFoundError):
        run.chunks()
    run.chunk(waves=3)
    want = {tuple(r) for r in X._chunked(data.renderings["txt"], run.run).collect()}
    got = [tuple(r) for r in run.chunks().collect()]
    assert len(got) == len(want) and set(got) == want
    more = X.Dataset({"txt": data.renderings["txt"].unionByName(spark.createDataFrame([(77, "new text")], "doc_id long, text string"))}, data.items)
    run = X.Run(spark, root, run.run, more)
    run.index("hashed_words")
    run.chunk()
    assert run.chunks().count() == len(want) + 1
    with pytest.raises(ValueError, match="vectors"):
        run.stores("hashed_words")
    run.index("hashed_words")
    vectors, sparse = run.stores("hashed_words")
    assert sparse.n_chunks == vectors.count() == vectors.select("doc_id", "chunk_index").distinct().count() == len(want) + 1
    with pytest.raises(ValueError, match="another config"):
        X.Run(spark, root, {**run.run, "params": {"max_tokens": 9, "overlap": 0}}, more)._chunk_parts()


def test_nearest_keeps_ties_in_order(spark):
    v = spark.createDataFrame([(2, 1, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (1, 5, [3.0, 0.0]), (1, 6, [0.0, 1.0]), (3, 0, None), (4, 0, [0.0, 0.0])], "doc_id long, chunk_index int, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "item_id long, embedding array<double>")
    rows = lambda own, **o: [(r.doc_id, r.chunk_index) for r in R.nearest(v, q, 3, own=own, **o).orderBy("rank").collect()]
    assert rows(True) == rows(True, block=1) == [(1, 5), (2, 0), (2, 1)] and rows(False) == [(2, 0), (2, 1)]


def test_plan_options():
    assert runs.chunking_options({"method": "fixed_char", "params": {"size": [100, 300]}}, "w")[0]["params"]["size"] == 300
    assert runs.chunking_options({"method": "html"}, "w")[0]["rendering"] == "html"
    semantic = runs.chunking_options({"method": "semantic"}, "w")[0]
    assert semantic["params"]["embedding_model"] == "hashed_words" and "embed" not in semantic["params"]
    assert [o["name"] for o in runs.retrieval_options({"method": "dense", "params": {"top_k": [3, 5]}}, "w")] == ["dense-top_k=3", "dense-top_k=5"]
    for bad in ({"method": "fixed_char", "rendering": "pdf"}, {"method": "semantic", "params": {"embed": 1}}, {"method": "semantic", "params": {"embedding_model": "no"}}):
        with pytest.raises(ValueError):
            runs.chunking_options(bad, "w")
    with pytest.raises(ValueError):
        runs.reranking_options({"method": "cross_encoder", "params": {}}, "w")
    with pytest.raises(ValueError, match="no run"):
        runs.plan({"datasets": "d", "chunking": [{"method": "markdown"}]}, renderings=lambda d: ["txt"])
    a, b = (runs.plan({"datasets": "d", "chunking": [{"method": "fixed_char", "params": p}]})[0] for p in ({}, {"size": 1000}))
    assert runs.fingerprint(a) == runs.fingerprint(b)


def test_sections_have_their_texts(spark, tmp_path):
    html = "<p>in</p><h1>A &amp; B</h1>x<!-- <h2>no</h2> --><h2>C</h2><script>'<h1>'</script>y"
    data = X.Dataset({"md": docs(spark, "# A\nx\n## B\ny", None), "html": docs(spark, html, "", None)}, _dataset(spark).items)
    got = {}
    for planned in runs.plan({"datasets": "d", "chunking": [{"method": "markdown"}, {"method": "html"}]}, renderings=lambda d: data.renderings):
        run = X.Run(spark, str(tmp_path), planned, data)
        run.chunk()
        got[planned["method"]] = [(r.chunk_index, r.level, r.chunk_text) for r in run.chunks().orderBy("chunk_index").collect()]
    assert got["markdown"] == [(0, 1, "# A\nx"), (1, 2, "## B\ny")]
    assert got["html"] == [(0, 0, "in"), (1, 1, "A & B x"), (2, 2, "C y")]
