"""Operators against hand-checked cases, invariants and the SQL oracle."""

import json
import math
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.functions import text as T
from spanloom.operators import augmentation as A
from spanloom.operators import chunking as C
from spanloom.operators import comparison as M
from spanloom.operators import evaluation as E
from spanloom.operators import locate as L
from spanloom.operators import retrieval as R
from spanloom.operators import spans as S
from spanloom.plans import runs
from spanloom.sources import files
from spanloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def spans_of(df):
    return [(r.start, r.end) for r in df.orderBy("doc_id", "chunk_index").collect()]


# --- chunkers


@pytest.mark.parametrize("text,want", [("x" * 1000, [(0, 1000)]), ("x" * 1000 + " " * 100, [(0, 1000)]), ("x" * 1200, [(0, 1000), (800, 1200)]), ("   \n ", []), ("", []), (None, []), ("  ab ", [(2, 4)])])
def test_fixed_char_cases(spark, text, want):
    assert spans_of(C.fixed_char(docs(spark, text), 1000, 200)) == want


def reference_windows(text, size, step):
    out = []
    for at in range(0, max(1, len(text)), step):
        if t := C.trim_span(text, at, min(len(text), at + size)):
            if not out or t[1] > out[-1][1]:
                out.append(t)
        if at + size >= len(text):
            break
    return out


def test_fixed_char_matches_a_loop(spark):
    texts = ["😀 a b \n\n c" * 9, "a" + " " * 30 + "b" * 5 + " " * 50, "é " * 40, "x\x1cy" * 20]
    for size, overlap in ((7, 3), (10, 0), (20, 0.5)):
        step = size - C.resolve_overlap(overlap, size)
        got = C.fixed_char(docs(spark, *texts), size, overlap)
        assert spans_of(got) == [w for t in texts for w in reference_windows(t, size, step)]
        assert C.violations(docs(spark, *texts), got).count() == 0


def test_resolve_overlap():
    assert [C.resolve_overlap(*x) for x in ((0.25, 256), (0.5, 5), (3, 10))] == [64, 2, 3]
    with pytest.raises(ValueError):
        C.resolve_overlap(-1, 5)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,;!?\n\t😀é", max_size=200), st.integers(1, 8), st.integers(0, 4))
def test_span_contract(text, most, overlap):
    for spans in (C.paragraph_spans(text), C.sentence_spans(text), C.sentence_chunks(text, most, overlap)):
        assert all(0 <= s < e <= len(text) and text[s:e].strip() == text[s:e] for s, e in spans)
        assert all(a[0] < b[0] for a, b in zip(spans, spans[1:]))
    assert "".join(text[s:e] for s, e in C.sentence_pieces(text)) in (text, "")
    assert all(len(text[s:e].split()) <= most for s, e in C.sentence_chunks(text, most, overlap))


def test_boundary_chunks_probe_rules():
    asked = []

    def ask(ids, shown):
        asked.append(ids)
        return ids[-1] if len(ids) > 1 else -1

    cuts = C.shifted_boundaries(["w " * 200] * 12, ask)
    assert cuts and all(a < b for a, b in zip(cuts, cuts[1:])) and all(i[0] < 7 for i in asked)


def test_equal_pieces(spark):
    d = docs(spark, "a b c d e f g h i j", "")
    got = d.select("doc_id", C.equal_pieces(F.col("text"), T.n_words(F.col("text")), 4).alias("p")).orderBy("doc_id").collect()
    assert "".join(got[0].p) == "a b c d e f g h i j" and len(got[0].p) == 3 and got[1].p == [""]


def test_context_window(spark):
    lo, hi = C.context_window(F.lit(100), F.lit(90), F.lit(100), 40)
    assert tuple(spark.range(1).select(lo, hi).first()) == (60, 100)


def test_html_sections_and_paths(spark):
    html = "<p>x</p><script>'<h1>no'</script><!-- <h2> --><H1>A</H1>t<h2 class=x>B &amp; <b>b</b></h2><h1>C</h1> "
    pages = spark.createDataFrame([(1, html), (2, "  "), (3, "😀<h3>z</h3>")], "page_id long, html string")
    got = C.heading_paths(C.html_sections(pages), "page_id").orderBy("page_id", "chunk_index").collect()
    assert [(r.page_id, r.level, r.title, r.path) for r in got] == [(1, 0, "", ""), (1, 1, "A", "A"), (1, 2, "B &amp; b", "A / B &amp; b"), (1, 1, "C", "C"), (3, 0, "", ""), (3, 3, "z", "z")]
    assert got[0].start == 0 and got[3].end == len(html) and html[got[1].start :].startswith("<H1>") and got[5].start == 1


def test_markdown_sections(spark):
    md = "intro\n# A\ntext\n```\n# no\n```\n## B\nb\n# C"
    got = C.markdown_sections(docs(spark, md)).orderBy("chunk_index").collect()
    assert [(r.level, r.header_path) for r in got] == [(0, ""), (1, "A"), (2, "A/B"), (1, "C")]
    assert all(md[r.start : r.end].strip() for r in got)


def test_sections_within_a_budget(spark):
    md = "# A\none two. three four.\n\nfive six seven\n## B\nb " + "w" * 5000
    whole, cut = (C.markdown_sections(docs(spark, md), n).orderBy("chunk_index").collect() for n in (None, 4))
    assert [md[r.start : r.end] for r in cut] == ["# A\none two.", "three four.", "five six seven", "## B\nb " + "w" * 5000]
    assert [(r.header_path, r.level) for r in cut] == [("A", 1)] * 3 + [("A/B", 2)] and len(whole) == 2
    html = "<h1>T</h1>\n<p>a b c</p>\n<p>d e</p>\n<h2>U</h2>x"
    pages = spark.createDataFrame([(1, html), (2, "<h1>z</h1>"), (3, None), (4, "")], "page_id int, html string")
    got = C.heading_paths(C.html_sections(pages, max_tokens=3), "page_id").orderBy("page_id", "chunk_index").collect()
    assert [(r.page_id, html[r.start : r.end], r.path) for r in got if r.page_id == 1] == [(1, "<h1>T</h1>", "T"), (1, "<p>a b c</p>", "T"), (1, "<p>d e</p>", "T"), (1, "<h2>U</h2>x", "T / U")]
    assert [(r.chunk_index, r.start, r.end, r.title) for r in got if r.page_id == 2] == [(0, 0, 10, "z")] and {r.page_id for r in got} == {1, 2}
    with pytest.raises(ValueError):
        C.html_sections(pages, max_tokens=0)


def test_clustered_splits_at_largest_gaps(spark):
    angles = [0, 0.1, 0.2, 1.2, 1.3, 2.9]
    rows = spark.createDataFrame([(1, i, [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)], "doc long, pos long, vec array<double>")
    assert [(r.first_pos, r.last_pos) for r in C.clustered(rows, 10, 0.2).orderBy("first_pos").collect()] == [(0, 2), (3, 4), (5, 5)]
    assert C.clustered(rows, 1, 5).count() == 6
    assert C.tiled_boundaries(rows, 3).count() == 0  # six sentences, blocks of three


def test_clustered_cuts_at_percentile_of_each_document(spark):
    small = [0, 0.01, 0.02, 0.12, 0.13, 0.14]  # all distances far below 0.9
    large = [0, 1.8, 3.6, 5.4, 7.9, 9.7]  # all above
    rows = [(d, i, [math.cos(a), math.sin(a)]) for d, angles in ((1, small), (2, large), (3, [0.5])) for i, a in enumerate(angles)]
    rows = spark.createDataFrame(rows, "doc long, pos long, vec array<double>")
    got = {tuple(r) for r in C.clustered(rows).collect()}
    assert got == {(1, 0, 2), (1, 3, 5), (2, 0, 3), (2, 4, 5), (3, 0, 0)}
    assert C.clustered(rows, percentile=100).count() == 3


def test_chunkers_over_texts_agree_with_those_over_vectors(spark):
    """From sentences and an embedding to chunks, against the window forms on the same vectors."""
    import random

    from spanloom.operators import semantic as V

    r = random.Random(3)
    text = " ".join(" ".join(r.choice(WORDS[k : k + 4]) for _ in range(6)) + "." for k in (0, 0, 0, 4, 4, 8, 8, 8, 8, 0, 4, 4) for _ in range(2))
    sentences = C.sentence_spans(text)
    n = len(sentences)

    def table(vectors):
        return spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(vectors)], "doc long, pos long, vec array<double>")

    def chunks(firsts):
        edges = [0, *firsts, n]
        return [(sentences[a][0], sentences[b - 1][1]) for a, b in zip(edges, edges[1:])]

    v = V.providers.hashed_words(V.window_texts(text, sentences, 1, 1))
    groups = C.semantic_groups(table(v), 80).orderBy("first_pos").collect()
    assert V.semantic_spans(text, V.providers.hashed_words, 80) == chunks([g.first_pos for g in groups[1:]])
    runs_ = C.clustered(table(v), 10**6).orderBy("first_pos").collect()
    assert V.clustered_spans(text, V.providers.hashed_words, max_tokens=10**6) == chunks([x.first_pos for x in runs_[1:]])
    assert all(len(text[s:e].split()) <= 20 for s, e in V.clustered_spans(text, V.providers.hashed_words, max_tokens=20))
    blocks = V.providers.hashed_words(V.window_texts(text, sentences, 0, 2))
    cuts = C.tiled_boundaries(table(blocks), 3, 90, 2).orderBy("pos").collect()
    assert V.tiled_spans(text, V.providers.hashed_words, 3, 90, 2) == chunks([c.pos for c in cuts])
    assert V.tiled_spans("A b. C d. E f.", V.providers.hashed_words) == [(0, 14)] and V.tiled_spans(" ", V.providers.hashed_words) == []
    d = docs(spark, text, "One sentence only", "", None)
    for chunker in (V.semantic, V.tiled, V.clustered):
        got = chunker(d)
        assert C.violations(d, got).count() == 0 and got.where("doc_id = 1").count() == 1 and got.where("doc_id > 1").count() == 0


WORDS = "alpha beta gamma delta river water flood stream stock market price trade".split()


def test_bpe_tokens(spark):
    import random

    from spanloom.plans.report_queries import _tokens

    pytest.importorskip("public_tokenizers")
    t, r = _tokens(), random.Random(4)
    for _ in range(200):
        text = "".join(r.choice("ab é \n😀ñ中.,1") for _ in range(r.randrange(60)))
        ids = t.codec.encode_ordinary(text)
        assert t.count(text) == len(ids)
        spans = t.spans(text)
        assert "".join(text[s:e] for s, e in spans) == text and len(spans) <= len(ids)
        cut, gone = t.truncate(text, 5)
        assert text.startswith(cut) and gone == (len(ids) > 5) and t.count(cut) <= 5 + 3
    assert t.fit("two words", ["short", "long words " * 50], 20)[0] == ("short", False)
    assert t.fit("two words", ["long words " * 50], 20)[0][1]
    d = docs(spark, "some text é 😀 " * 40, None)
    got = C.fixed_token(d, 16, 4, t.spans)
    assert C.violations(d, got).count() == 0 and all(t.count(x.chunk_text) <= 20 for x in got.collect())


def test_squeezed_map_places(spark):
    from spanloom.operators import reconstruction as B

    texts = ["  a  b\n\nc ", "x", "", " ", "a b", "😀\t y"]
    got = docs(spark, *texts).orderBy("doc_id").select(B.squeezed_map(F.col("text")).alias("m")).collect()
    for t, (m,) in zip(texts, got):
        assert m.text == " ".join(t.split()) and len(m.places) == len(t) + 1 and m.places[-1] == len(m.text)
        assert all(m.text[m.places[i]] == c for i, c in enumerate(t) if not c.isspace())
    at = docs(spark, "a b\n c d").select(B.solid_place(F.col("text"), F.lit("b  c")).alias("x"), B.solid_place(F.col("text"), F.lit("bd")).alias("y")).first()
    assert tuple(at.x) == (2, 6) and at.y is None


def test_cost_cells(spark):
    from spanloom.operators import reports as P

    rows = spark.createDataFrame([("tok", 12345.6), ("s", 1.23456), ("s", 0.0123456), ("s", None), ("s", 123.456)], "name string, v double")
    assert [r[0] for r in rows.select(P.cost_cell(F.col("name"), F.col("v"))).collect()] == ["12,346", "1.23", "0.0123", "–", "123"]


def test_run_summary(spark):
    from spanloom.operators import reports as P

    m = spark.createDataFrame([(1, "evidence", "hit@1", 1.0), (2, "evidence", "hit@1", 0.0), (3, "no_evidence", "doc_hit@1", 1.0)], "item_id long, grp string, name string, value double")
    c = spark.createDataFrame([(1, 0, 10), (1, 10, 30)], "doc_id long, start int, end int")
    s = spark.createDataFrame([("unanswerable",)], "reason string")
    got = P.run_summary(m, {"run": "r", "dataset": "d"}, c, s).first()
    assert (got.run, got.chunks, got.documents, got.mean_chunk_chars, got["items"], got.skipped) == ("r", 2, 1, 15.0, {"evidence": 2, "no_evidence": 1}, {"unanswerable": 1})
    assert got.metrics == {"evidence": {"hit@1": 0.5}, "no_evidence": {"doc_hit@1": 1.0}}
    runs_ = spark.createDataFrame([("a", "dense", 50, "bge-m3", None, []), ("b", "dense", 50, "bge-m3", "x", []), ("c", "dense", 50, "bge-m3", None, ["title"])], "run string, retrieval string, top_k int, embedding string, reranking string, augmentations array<string>")
    assert [r.run for r in P.baseline(runs_).collect()] == ["a"]


# --- spans


def span_rows(spark, *spans):
    return spark.createDataFrame([(1, s, e) for s, e in spans], "k long, start int, end int")


def test_merge_and_overlap(spark):
    got = S.merged(span_rows(spark, (0, 10), (10, 20), (30, 40), (31, 32)), ["k"])
    assert sorted((r.start, r.end) for r in got.collect()) == [(0, 20), (30, 40)]
    assert S.overlapping(span_rows(spark, (0, 10)), span_rows(spark, (10, 20)), ["k"]).count() == 0
    e, r = span_rows(spark, (0, 10), (5, 20)), span_rows(spark, (0, 8), (4, 12))
    assert S.shared_length(r, e, ["k"]).first().shared == 12 and S.total_length(e, ["k"]).first().total == 20


# --- evaluation


def test_gold_documents_without_spans(spark):
    """A question without evidence whose document comes second: only doc_hit, 0 and then 1."""
    r = spark.createDataFrame([(1, 1, 5, 0, 9), (1, 2, 7, 0, 9)], "item_id long, rank int, doc_id long, start int, end int")
    none = spark.createDataFrame([], "item_id long, doc_id long, start int, end int")
    gold = E.gold_documents(none, spark.createDataFrame([(1, 7)], "item_id long, doc_id long"))
    chunks = spark.createDataFrame([(7, 0, 0, 9)], "doc_id long, chunk_index int, start int, end int")
    got = {x.name: x.value for x in E.per_question(r, none, spark.createDataFrame([(1,)], "item_id long"), chunks, gold=gold).collect()}
    assert got == {"doc_hit@1": 0, "doc_hit@3": 1, "doc_hit@5": 1, "doc_hit@10": 1}


def metrics(spark, ranking, evidence, chunks):
    r = spark.createDataFrame([(i, n, d, s, e) for i, n, d, s, e in ranking], "item_id long, rank int, doc_id long, start int, end int")
    v = spark.createDataFrame(evidence, "item_id long, doc_id long, start int, end int")
    c = spark.createDataFrame(chunks, "doc_id long, chunk_index int, start int, end int")
    i = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    return {(x.item_id, x.name): x.value for x in E.per_question(r, v, i, c).collect()}


def test_metrics(spark):
    chunks = [(7, n, n * 10, n * 10 + 10) for n in range(20)]
    m = metrics(spark, [(1, 1, 7, 0, 10), (1, 2, 7, 50, 60), (1, 3, 7, 10, 20), (2, 11, 7, 100, 110)], [(1, 7, 5, 15), (2, 7, 100, 105)], chunks)
    assert m[1, "ndcg@3"] == pytest.approx((1 + 0.5) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert m[1, "evidence_recall@1"] == 0.5 and m[1, "evidence_recall@3"] == 1 and m[1, "hit@1"] == 1 and m[1, "mrr@10"] == 1
    assert m[2, "mrr@10"] == 0 and m[2, "hit@10"] == 0 and m[2, "ndcg@10"] == 0 and m[2, "evidence_recall@10"] == 0
    assert m[3, "doc_hit@1"] == 0 and (3, "hit@1") not in m


def test_judge(spark):
    v = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0)], "item_id long, rank int, verdict int")
    got = {r.item_id: r.value for r in E.average_precision(v).collect()}
    assert got[1] == pytest.approx((1 + 2 / 3) / 2, abs=1e-6) and got[2] == 0


def test_chunks_leave_in_bounded_batches(monkeypatch):
    """A batch of many documents, or one long document, does not become one batch of all its chunks."""
    import pyarrow as pa

    taken = []

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            taken.append((run, schema))

    monkeypatch.setattr(C, "HELD", 1000)
    texts = ["ab " * 400, None, "", "x " * 30] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    for chunks in (C.fixed_char(Docs(), 100, 20), C.fixed_char(Docs(), 100, 20, texts=False)):
        run, schema = taken.pop()
        out = list(run(iter([batch])))
        assert len(out) > 10 and max(b.nbytes for b in out) < 8000
        assert ("chunk_text" in schema) == ("chunk_text" in out[0].schema.names)
        spans = [(r["doc_id"], r["start"], r["end"]) for b in out for r in b.to_pylist()]
        assert spans == [(d, s, e) for d, t in enumerate(texts) if t for s, e in reference_windows(t, 100, 80)]


@pytest.mark.parametrize("before,after", [(1, 1), (0, 2), (3, 0)])
def test_vectors_of_windows_add_up(before, after):
    from spanloom.functions import providers
    from spanloom.operators import semantic as V

    text, calls = "One two. Two three! ΣΑΣ. four\nfive FIVE five? six", []
    spans = C.sentence_spans(text, True)

    def embed(texts):
        calls.append(sum(map(len, texts)))
        return providers.hashed_words(texts)

    plain = V.window_vectors(text, spans, before, after, embed)
    embed.adds_up = True
    assert (V.window_vectors(text, spans, before, after, embed) == plain).all()
    assert calls[1] <= len(text) < calls[0]  # each character is embedded once


def test_summaries_that_do_not_shrink(spark):
    long = " ".join(["word"] * 300) + "."
    stuck = f"{long}\n{long}"  # each half is one sentence, which is its own summary
    rows = docs(spark, stuck, "One. Two.", None, "no mark", " ".join(f"Sentence number {i}." for i in range(900)))
    got = {r.doc_id: r.summary for r in A.summarised(rows, 400).collect()}
    assert got == {0: stuck, 1: "One.", 2: "", 3: "", 4: "Sentence number 0."}
    slow = lambda c: F.left(c, F.greatest(F.lit(1), F.length(c) - 1))
    assert [len(r.summary) for r in A.summarised(docs(spark, "ab " * 50), 20, slow, rounds=2).collect()] == [150 - 2 * 3 + 2 * 2]


def test_contexts_carry_no_whole_texts(spark, monkeypatch):
    text = " ".join(f"Word{i}." for i in range(60))
    rows = docs(spark, text, "Short one. Two", None)
    chunks = C.fixed_char(rows, 40, 0)
    monkeypatch.setattr(C, "HELD", 100)
    made = A.with_context(chunks, rows, 10, lambda c: c)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("collect_list")  # a document's chunks are one row where they meet its text
    n = len(text)
    width = int(n * 10 / 60)
    for r in made.orderBy("doc_id", "chunk_index").collect():
        lo = max(0, min((r.start + r.end - width) // 2, n - width))
        assert r.context == (text[lo : lo + width] if r.doc_id == 0 else "Short one. Two")
    assert made.count() == chunks.count() and made.columns == [*chunks.columns, "context"]


# --- retrieval


def ranking(spark, *rows):
    return spark.createDataFrame([(1, d, 0, r) for r, d in enumerate(rows, 1)], "item_id long, doc_id long, chunk_index int, rank int")


def test_fusion(spark):
    got = R.fused([ranking(spark, 10, 20), ranking(spark, 20, 30)]).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [20, 10, 30] and got[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    assert [r.doc_id for r in R.fused([ranking(spark, 10), ranking(spark, 30)]).orderBy("rank").collect()] == [10, 30]
    with pytest.raises(ValueError):
        R.retrieve("hybrid", None, None)
    with pytest.raises(ValueError):
        R.retrieve("other", None, None)


def brute_bm25(texts, asked, k):
    """Rankings as {item: [(doc, score)]} of texts that are a chunk each."""
    terms = [re.findall(r"\w{2,}", t.lower()) for t in texts]
    mean, out = sum(map(len, terms)) / len(terms), {}
    for item, query in asked.items():
        scores = []
        for doc, ts in enumerate(terms):
            both = sorted(set(re.findall(r"\w{2,}", query.lower())) & set(ts))
            df = {w: sum(w in x for x in terms) for w in both}
            parts = [math.log(1 + (len(terms) - df[w] + 0.5) / (df[w] + 0.5)) * ts.count(w) / (ts.count(w) + R.K1 * (1 - R.B + R.B * len(ts) / mean)) for w in both]
            scores += [(-round(sum(parts), 6), doc)] if both else []
        out[item] = [(doc, -score) for score, doc in sorted(scores)[:k]]
    return out


def rankings_of(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.item_id, [])) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return out


def test_bm25_shuffles_no_matches(spark, monkeypatch):
    texts = [f"all common words {'w%d ' % (i % 7) * (i % 3 + 1)} tail {i % 5}5" for i in range(600)]
    asked = {i: f"common words w{i} w{i + 1} missing w{i}" for i in range(7)} | {7: "", 8: "none here"}
    chunks, queries = C.fixed_char(docs(spark, *texts), 1000, 0), spark.createDataFrame(list(asked.items()), "item_id long, query string")
    got = R.bm25(chunks, queries, 9)
    want = {i: x for i, x in brute_bm25(texts, asked, 9).items() if x}
    assert rankings_of(got) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)", plan)
    assert set(dealt) == {"item_id"}, dealt  # postings and their products with queries stay where the chunks are
    monkeypatch.setattr(R, "ASKED_AT_ONCE", 2)
    monkeypatch.setattr(R, "CHUNKS_AT_ONCE", 3)
    assert rankings_of(R.bm25(chunks.repartition(3), queries, 9)) == want
    assert R.bm25(chunks, queries.limit(0), 9).count() == 0


def test_hybrid_takes_terms_once(spark, monkeypatch):
    """Both lists come from one pass over the chunks' terms, and fuse to what they fuse to by themselves."""
    import spanloom.plans.queries as Q

    taken = []
    monkeypatch.setattr(R, "analysed", lambda text, stop=(), own=R.analysed: taken.append(text) or own(text, stop))
    got = Q.hybrid_rrf(spark, SF)
    assert len(taken) == 2  # the items' and the chunks'
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and got.count() > 0


def test_rerank_leaves_chunks_where_they_are(spark):
    chunks = C.fixed_char(docs(spark, *(f"cat number {i}" for i in range(50))), 1000, 0)
    queries = spark.createDataFrame([(1, "cat 7x number")], "item_id long, query string")
    got = R.reranked(R.bm25(chunks, queries, 5), chunks, queries, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan, plan
    assert [(r.rank, r.doc_id) for r in got.orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2)]


def test_show_ranking_marks_evidence(spark):
    import spanloom.plans.queries as Q

    rows = Q.show_ranking(spark, SF).collect()
    there = {(r.item_id, r.doc_id): (r.start, r.end) for r in Q._evidence(spark, SF).collect()}
    hit = lambda r: (e := there.get((r.item_id, r.doc_id))) is not None and r.start < e[1] and e[0] < r.end
    assert any(r.evidence for r in rows) and all(r.evidence == hit(r) for r in rows)
    assert all(r.question and r.score > 0 and r.start < r.end for r in rows)


def test_term_stats_shuffle_terms_alone(spark):
    import spanloom.plans.queries as Q

    plan = Q.bm25_term_stats(spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(dealt) == 1 and re.fullmatch(r"term#\d+, \d+", dealt[0]), dealt


def test_metrics_keep_no_texts(spark):
    import spanloom.plans.queries as Q

    spark.catalog.clearCache()
    plan = Q.eval_per_question(spark, SF)._jdf.queryExecution().withCachedData().toString()
    kept = re.findall(r"InMemoryRelation \[([^\]]*)\]", plan)
    assert kept and not any("chunk_text" in x for x in kept), kept


def test_dense_is_exact_in_blocks(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    got = R.dense(v, v, 3)
    assert got.count() == 3 * v.count()
    odd = spark.createDataFrame([(-1, None), (-2, [0.0] * 64), (-3, [float("nan")] * 64), (None, [1.0] * 64)], v.schema)
    again = R.dense(v.unionByName(odd), v.unionByName(odd), 3, block=64, asked=32)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_index_on_disk(spark, tmp_path):
    chunks = C.fixed_char(docs(spark, "the cat sat. the dog ran", "a dog of the cat", "other words", None), 1000, 0)
    asked = spark.createDataFrame([(1, "the dog"), (2, "nothing")], "item_id long, query string")
    for stop in ((), R.STOP_EN):
        R.write_index(chunks, str(tmp_path / "index"), stop)
        index = R.open_index(spark, str(tmp_path / "index"), 3)
        got, want = R.bm25(index, asked, 5), R.bm25(chunks, asked, 5, stop)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2
    whole = R.filled(got, chunks, asked, 3).orderBy("item_id", "rank").collect()
    assert [(r.item_id, r.doc_id) for r in whole] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)] or {r.doc_id for r in whole[:3]} == {0, 1, 2}
    assert [r.score for r in whole[3:]] == [0, 0, 0]
    with pytest.raises(ValueError, match="holds 3"):
        R.open_index(spark, str(tmp_path / "index"), 4)


def test_windows_are_checked_and_linear(spark):
    import time

    for bad in ((0, 0), (5, 5), (5, 6)):
        for chunker in (C.fixed_char, C.fixed_token):
            with pytest.raises(ValueError):
                chunker(docs(spark, "a b"), *bad)
    took = []
    for n in (100_000, 800_000):
        d = docs(spark, "some words " * (n // 11))
        began = time.time()
        C.fixed_char(d, 200, 50).agg(F.sum("start")).collect()
        d.select(F.size(L.occurrences(F.col("text"), F.lit("w"))), F.size(C.equal_pieces(F.col("text"), T.n_words(F.col("text")), 50))).collect()
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 8


# --- augmentation and text


def test_text_to_embed(spark):
    none = F.lit("")
    build = lambda **k: A.text_to_embed(F.lit("X"), k.get("summary", none), k.get("title", none), none, none, k.get("keywords", none), k.get("questions", F.array().cast("array<string>")))
    one = spark.range(1).select(build(summary=F.lit("S"), title=F.lit("T")), build(title=F.lit("T"), keywords=F.lit("K"), questions=F.array(F.lit("q1"), F.lit("q2"))), build()).first()
    assert tuple(one) == ("S", "T\n\nK\n\nq1\nq2\n\nX", "X")


def test_scalars(spark):
    c = spark.range(1).select(
        A.clean_keywords(F.lit("a, b,\n,c"), 2),
        A.clean_questions(F.lit("1) A?\n- B?\n\n• C?")),
        T.with_title(F.lit("What is it?"), F.lit("T")),
        T.with_title(F.lit("BERT uses?"), F.lit("T")),
        T.fold(F.lit("“Ab”—c…  d")),
        T.safe_id(F.lit(' a/b:c. ')),
        T.safe_id(F.lit("..")),
        T.book_title(F.lit("A_b_-_C")),
        T.truncate(F.lit(" a  b c"), 2),
        T.preview(F.lit("a \n b" * 3), 4),
        L.occurrences(F.lit("aaa"), F.lit("aa")),
        F.percentile(F.lit(1), 0.5),
    ).first()
    assert c[:8] == ("a, b", ["A?", "B?", "C?"], 'In "T", what is it?', 'In "T", BERT uses?', '"ab"-c... d', "a_b_c", "document", "A b")
    assert tuple(c[8]) == (" a  b", True) and c[9] == "a ba..." and c[10] == [0, 1]


def test_percentile_is_linear(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert d.select(F.percentile("x", F.lit(0.95))).first()[0] == pytest.approx(8.95)


def test_locate_and_reconstruction(spark):
    items = spark.createDataFrame([(1, "b c d"), (2, "“b” x"), (3, "zz")], "item_id long, needle string")
    d = docs(spark, 'a 😀 b c d e', 'q "B"  X y', "pizza zz")
    assert [(r.item_id, r.doc_id, r.start, r.end) for r in L.exact(items, d).orderBy("item_id").collect()] == [(1, 0, 4, 9), (3, 2, 2, 4)]
    kinds = {r.item_id: r.kind for r in L.match_kinds(items, d).collect()}
    assert kinds == {1: "exact", 2: "folded", 3: "exact"}
    assert L.retagged(["a", "c", "x", "d"], [("p", "a"), ("p", "b"), ("h1", "c"), ("p", "d")]) == [("p", "a"), ("h1", "c"), (None, "x"), (None, "d")]
    books = spark.createDataFrame([(1, ["a", "d"], [("p", " a "), ("h1", "b"), ("p", "d")]), (2, None, None)], "book long, cleaned array<string>, tagged array<struct<tag:string,text:string>>")
    assert [tuple(r) for r in L.with_tags(books, "book").collect()] == [(1, 0, "p", "a"), (1, 1, "p", "d")]
    moves = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "source long, target long")
    assert {r.source: r.final for r in L.chain_ends(moves).collect()} == {1: 4, 2: 4, 3: 4, 9: 8}
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 1), (5, 6), (8, 8)] + [(i, i + 1) for i in range(100, 170)], "source long, target long")
    ends = {r.source: r.final for r in L.chain_ends(circle).collect()}
    assert [ends[i] for i in (1, 2, 3, 7, 5, 8)] == [None] * 4 + [6, None] and all(ends[i] == 170 for i in range(100, 170))
    assert L.chain_ends(circle.limit(0)).count() == 0
    heads = spark.createDataFrame([(k, p, (p * 7 + k) % 4 + 1) for k in range(3) for p in range(25)], "doc long, pos long, level int")
    assert sorted(map(str, L.section_spans(heads, "doc").collect())) == sorted(map(str, L.section_ends(heads, "doc").collect()))
    b = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 1)], "item_id long, doc_id long")
    assert [r.item_id for r in L.within_budget(b, 2).orderBy("item_id").collect()] == [1, 3]


# --- sources, sinks, plans, streaming


def test_files(spark, tmp_path):
    (tmp_path / "txt").mkdir()
    for n in ("b", "a", "c"):
        (tmp_path / "txt" / f"{n}.txt").write_bytes(f"{n}\r\nx".encode())
    assert [tuple(r) for r in files.read_documents(spark, str(tmp_path), "txt", 2).collect()] == [("a", "a\r\nx"), ("b", "b\r\nx")]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    new = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, chunk_index int")
    path = str(tmp_path / "chunks")
    assert files.append_missing(new, path, ["doc_id", "chunk_index"]) == 2 and files.append_missing(new, path, ["doc_id", "chunk_index"]) == 0
    assert files.start_run(spark, str(tmp_path / "run"), {"a": (1, 2), "b": 1}) and not files.start_run(spark, str(tmp_path / "run"), {"b": 1, "a": [1, 2]})
    with pytest.raises(ValueError):
        files.start_run(spark, str(tmp_path / "run"), {"a": 1})
    done = spark.createDataFrame([(1, 2)], "doc_id long, chunks int")
    assert files.committed(new, done).count() == 2
    with pytest.raises(ValueError):
        files.committed(new.limit(1), done)
    import io
    import tarfile
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("m.txt", b"caf\xc3\xa9 \xff")
    with tarfile.open(tmp_path / "x.tgz", "w:gz") as t:
        info = tarfile.TarInfo("n.json")
        info.size = 2
        t.addfile(info, io.BytesIO(b"{}"))
    got = {r.member: r.text for r in files.read_archives(spark, str(tmp_path / "x.*")).collect()}
    assert got == {"m.txt": "café �", "n.json": "{}"}
    (tmp_path / "t.tsv").write_text("id\tSet Name\n1\ttest\n2\ttrain\n")
    assert files.snake_case(files.read_tsv(spark, str(tmp_path / "t.tsv"), "Set Name", ["test"])).collect()[0].set_name == "test"


def test_plan():
    config = {"datasets": ["d1", "d2"], "chunking": [{"method": "fixed_char", "params": {"size": [500, 1000], "overlap": 0}}, {"method": "markdown"}], "augmentations": [None, ["title"]]}
    made = runs.plan(config)
    assert len(made) == 12 and made[0]["directory"] == "d1/txt/fixed_char-overlap=0-size=500/plain"
    for bad in ({"datasets": [], "chunking": [], "x": 1}, {"datasets": "d", "chunking": [{"method": "no"}]}, {"datasets": "d", "chunking": [{"method": "fixed_char", "params": {"no": 1}}]}):
        with pytest.raises(ValueError):
            runs.plan(bad)
    assert runs.resolve(["a/1", "a/2", "b/1"], ["b/*", "all"]) == ["b/1", "a/1", "a/2"]
    with pytest.raises(ValueError):
        runs.resolve(["a"], "z*")

    def fail(r):
        raise RuntimeError(json.dumps(r["params"]))

    with pytest.raises(ValueError, match="typo"):
        runs.resolve(["a", "b"], ["a", "typo"])
    assert [runs.as_list(x) for x in (None, "", "a", ["a"], ("a", "b"))] == [[], [""], ["a"], ["a"], ["a", "b"]]
    assert all(map(runs.is_none, (None, "", "none"))) and not runs.is_none("title")
    runs.check_keys({"description": "d", "a": 1}, ["a"], "x")
    with pytest.raises(ExceptionGroup) as e:
        runs.run_each(made, fail, keep_going=True)
    assert len(e.value.exceptions) == 12
    with pytest.raises(RuntimeError):
        runs.run_each(made, fail)
    runs.run_each(made, fail, dry_run=True)


def test_stream_chunks_once(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    docs(spark, "a b", "x" * 1500).write.parquet(src)
    ingest.chunk_stream(spark, src, sink, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(9, "new")], "doc_id long, text string").write.mode("append").parquet(src)
    ingest.chunk_stream(spark, src, sink, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(sink).count() == 4


def test_comparison(spark):
    r = spark.createDataFrame([("d", "m", "p1", None), ("d", "m", "p0", 0.5), ("d", "m", "p2", 0.5), ("d", "n", "p", 0.2)], "dataset string, method string, params string, value double")
    assert {(x.method, x.params) for x in M.best(r, ["dataset", "method"]).collect()} == {("m", "p0"), ("n", "p")}
    assert "–" in M.markdown_table(r)


# --- oracle


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    cell = lambda v: "null" if str(v) in ("None", "nan", "<NA>", "NaT") else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return sorted(tuple(map(cell, r)) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_language(spark):
    from spanloom.functions import language as N

    rows = docs(spark, "Le chat est dans la maison et le chien", "", None, "123", "Der Hund ist nicht im Haus", "w domu jest kot i nie ma psa")
    assert [r[0] for r in rows.orderBy("doc_id").select(N.detected(F.col("text"))).collect()] == ["fr", "en", "en", "en", "de", "pl"]
    assert N.corpus_language(rows.where("doc_id > 2")) == "de" and N.corpus_language(rows.limit(0)) == "en"
    named = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) >= 200")
    right, n = named.select(F.count_if(N.detected(F.col("text")) == F.col("lang")), F.count("*")).first()
    assert right / n > 0.9, (right, n)


def test_language_takes_words_once(spark):
    from spanloom.functions import language as N

    plan = docs(spark, "le chat").select(N.detected(F.col("text")).alias("found"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    tie = docs(spark, "le der", "der le", "the le der", "THE The le", "x" * 2999 + " the")
    assert [r[0] for r in tie.orderBy("doc_id").select(N.detected(F.col("text"))).collect()] == ["fr", "fr", "en", "en", "en"]


def test_longest_alias(spark):
    rows = spark.createDataFrame([(1, "Anan and ANANAS, anan", ["anan", "Ananas", "x", None, ""]), (2, "aa" * 60, ["A"]), (3, "none", ["zz"]), (4, None, ["a"]), (5, "aaaa", ["AA"])], "id long, text string, aliases array<string>")
    got = {r.id: (r.alias, list(r.starts)) for r in L.longest_alias(rows).collect()}
    assert got == {1: ("Ananas", [9]), 2: ("A", list(range(50))), 5: ("AA", [0, 1, 2])}


def test_inspect_and_export(spark, tmp_path):
    from spanloom.operators import reports

    c = C.fixed_char(docs(spark, 'ab "q", x\ny cd', None), 8, 0)
    assert [r.chunk_index for r in reports.inspected(c, order="shortest").orderBy("place").collect()] == [1, 0]
    assert reports.inspected(c, "CD").count() == 1
    with pytest.raises(ValueError):
        reports.inspected(c, order="no")
    for kind in ("json", "csv"):
        files.export_chunks(c, str(tmp_path / kind), kind)
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"', multiLine=True).select("text", "tokens").collect()
    assert {(r.text, int(r.tokens)) for r in back} == {(r.text, r.tokens) for r in spark.read.json(str(tmp_path / "json")).collect()} and len(back) == 2
