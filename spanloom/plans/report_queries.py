"""Queries over reconstruction and reports, each with DuckDB SQL; registered beside those of :mod:`queries`."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from ..functions import language as N
from ..functions import providers
from ..functions import text as T
from ..operators import augmentation as A
from ..operators import chunking as C
from ..operators import locate as L
from ..operators import reconstruction as B
from ..operators import reports as P
from ..operators import semantic as V
from .queries import _EV, _W, OVERLAP, SIZE, _evidence, _t, query


@query(r"SELECT conv_id, turn, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5, length(text) + 1 AS places, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS last_place FROM conversations")
def squeezed_map(spark, d):
    m = _t(spark, d, "conversations").select("conv_id", "turn", B.squeezed_map(F.col("text")).alias("m"))
    return m.select("conv_id", "turn", F.md5(F.col("m.text").cast("binary")).alias("text_md5"), F.size("m.places").cast("long").alias("places"), F.element_at("m.places", -1).cast("long").alias("last_place"))


@query(r"""WITH s AS (SELECT conv_id, turn, text, regexp_replace(text, '\s', '', 'g') AS solid, regexp_replace(substr(text, 5, 12), '\s', '', 'g') AS needle FROM conversations),
p AS (SELECT *, strpos(solid, needle) - 1 AS place FROM s WHERE needle <> '')
SELECT conv_id, turn, CAST(length(regexp_extract(text, '^(?:\s*\S){' || place || '}\s*')) AS INTEGER) AS start, CAST(length(regexp_extract(text, '^(?:\s*\S){' || (place + length(needle)) || '}')) AS INTEGER) AS "end" FROM p""")
def solid_places(spark, d):
    c = _t(spark, d, "conversations")
    at = B.solid_place(F.col("text"), F.substring("text", 5, 12))
    return c.select("conv_id", "turn", at.alias("at")).where("at is not null").select("conv_id", "turn", "at.start", "at.end")


@query(r"""WITH b AS (SELECT lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f, min(doc_id) AS start FROM documents GROUP BY ALL)
SELECT d.lang, d.doc_id AS para, b.start, b.start + 1 AS "end" FROM documents d JOIN b ON d.lang = b.lang AND b.f = trim(regexp_replace(d.text, '\s+', ' ', 'g'))""")
def located_blocks(spark, d):
    docs = _t(spark, d, "documents")
    blocks = docs.select("lang", "text", F.col("doc_id").alias("start"), (F.col("doc_id") + 1).alias("end"))
    return B.located_blocks(docs.select("lang", "text", F.col("doc_id").alias("para")), blocks, ["lang"])


@query("SELECT lang, md5(text) AS text_md5, min(doc_id) AS pos, count(*) > 1 AS ambiguous FROM documents GROUP BY lang, text")
def first_elements(spark, d):
    e = B.first_elements(_t(spark, d, "documents").select("lang", "text", F.col("doc_id").alias("pos")), "lang")
    return e.select("lang", F.md5(F.col("text").cast("binary")).alias("text_md5"), "pos", "ambiguous")


_KIND = "CASE WHEN length(text) % 5 = 0 THEN 'open' WHEN length(text) % 7 = 0 THEN 'close' WHEN length(text) % 11 = 0 THEN 'other' ELSE 'text' END"


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_KIND} AS kind, sum(CAST({_KIND} IN ('open', 'close') AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY run) - 1 AS INTEGER) AS block, min(turn) AS first, max(turn) AS last, string_agg(role, ' ' ORDER BY turn) AS text FROM t WHERE kind = 'text' GROUP BY conv_id, run""")
def token_blocks(spark, d):
    n = F.length("text")
    kind = F.when(n % 5 == 0, "open").when(n % 7 == 0, "close").when(n % 11 == 0, "other").otherwise("text")
    return B.token_blocks(_t(spark, d, "conversations").select("conv_id", F.col("turn").alias("token"), kind.alias("kind"), F.col("role").alias("text")), "conv_id")


@query("""WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn AS pos, role AS tag, CASE WHEN role = 'assistant' THEN CAST(sum(CAST(role = 'assistant' AND coalesce(before, '') <> 'assistant' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) END AS run FROM l""")
def table_runs(spark, d):
    return B.table_runs(_t(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("tag")), "conv_id", "assistant")


@query("""WITH e AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'h2' WHEN 1 THEN 'li' WHEN 2 THEN 'tr' ELSE 'p' END AS tag, text FROM conversations)
SELECT conv_id, turn, tag, md5(CASE tag WHEN 'h2' THEN '## ' || text WHEN 'li' THEN '- ' || text WHEN 'tr' THEN '| ' || role_ || ' | ' || text || ' |' ELSE text END) AS markdown_md5 FROM (SELECT e.*, c.role AS role_ FROM e JOIN conversations c USING (conv_id, turn))""")
def element_markdown(spark, d):
    tag = F.element_at(F.array(*map(F.lit, ("h2", "li", "tr", "p"))), (F.col("turn") % 4 + 1).cast("int"))
    inner = F.when(tag == "tr", F.concat(F.lit("<td>"), F.col("role"), F.lit("</td><td>"), F.col("text"), F.lit("</td>"))).otherwise(F.col("text"))
    element = F.concat(F.lit("<"), tag, F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))
    e = _t(spark, d, "conversations").select("conv_id", "turn", B.element_parts(element).alias("e"))
    return e.select("conv_id", "turn", "e.tag", F.md5(B.as_markdown(F.col("e.tag"), F.col("e.text")).cast("binary")).alias("markdown_md5"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'Unanswerable' WHEN turn % 5 = 0 THEN role || '; x' WHEN turn % 5 = 1 THEN role WHEN turn % 5 = 2 THEN CASE WHEN length(text) % 2 = 0 THEN 'Yes' ELSE 'No' END ELSE 'Unanswerable' END AS answer,
  CASE WHEN turn % 5 = 0 THEN 'extractive' WHEN turn % 5 = 1 THEN 'abstractive' WHEN turn % 5 = 2 THEN 'yes_no' ELSE 'unanswerable' END AS kind FROM conversations""")
def chosen_answers(spark, d):
    t = F.col("turn") % 5
    none = F.array().cast("array<string>")
    a = B.chosen_answer(F.when(t == 0, F.array(F.concat(F.lit(" "), "role"), F.lit("x "))).otherwise(none), F.when(t == 1, F.col("role")).otherwise(""), F.when(t == 2, F.length("text") % 2 == 0), t == 4)
    return _t(spark, d, "conversations").select("conv_id", "turn", a.alias("a")).select("conv_id", "turn", "a.answer", "a.kind")


@query("""WITH k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'user')
SELECT conv_id, max(CASE WHEN n = 1 THEN turn END) AS first_turn FROM (SELECT conv_id, turn, n FROM k UNION ALL SELECT conv_id, NULL, 2 FROM conversations) GROUP BY conv_id""")
def first_answers(spark, d):
    kind = F.when(F.col("role") == "user", "unanswerable").otherwise("answer")
    own = F.sort_array(F.collect_list(F.struct("turn", kind.alias("kind"))))
    return _t(spark, d, "conversations").groupBy("conv_id").agg(own.alias("a")).select("conv_id", B.first_answer(F.col("a"))["turn"].alias("first_turn"))


@query("SELECT conv_id, CAST(count(*) FILTER (text NOT LIKE 'The%') AS INTEGER) AS kept, CAST(count(*) FILTER (text LIKE 'The%') AS INTEGER) AS dropped FROM conversations GROUP BY conv_id")
def unprefixed_evidence(spark, d):
    e = _t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("e")).select("conv_id", B.unprefixed(F.col("e"), "The").alias("u"))
    return e.select("conv_id", F.size("u.kept").alias("kept"), "u.dropped")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS number, md5(text) AS question_md5 FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels)")
def question_rows(spark, d):
    own = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    records = _t(spark, d, "conversations").groupBy("conv_id").agg(own.alias("questions"))
    rows = B.question_rows(records, _t(spark, d, "labels").select(F.col("doc_id").alias("conv_id")), "conv_id")
    return rows.select("conv_id", "number", F.md5(F.col("question").cast("binary")).alias("question_md5"))


def _evidence_items(spark, d):
    """Items with their evidence; the Markdown offsets are known for even documents."""
    md = F.when(F.col("doc_id") % 2 == 0, F.struct((F.col("start") + 2).alias("start"), (F.col("end") + 2).alias("end")))
    e = _evidence(spark, d).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "start", "end", md.alias("md")))).alias("evidences"))
    none = F.array().cast(e.schema["evidences"].dataType)
    return _t(spark, d, "benchmark").select("item_id").join(e, "item_id", "left").withColumn("evidences", F.coalesce("evidences", none))


@query(f"""WITH {_EV} SELECT b.item_id, CASE WHEN NOT EXISTS (SELECT 1 FROM ev WHERE ev.item_id = b.item_id) THEN 0 ELSE (SELECT nullif(count(*), 0) FROM ev WHERE ev.item_id = b.item_id AND doc_id % 2 = 0) END AS spans,
  (SELECT min(start) + 2 FROM ev WHERE ev.item_id = b.item_id AND doc_id % 2 = 0) AS least_start FROM benchmark b""")
def rendering_spans(spark, d):
    s = _evidence_items(spark, d).select("item_id", B.evidence_spans(F.col("evidences"), "md").alias("s"))
    return s.select("item_id", F.when(F.col("s").isNotNull(), F.size("s")).cast("long").alias("spans"), F.array_min("s.start").alias("least_start"))


@query(f"""WITH {_EV} SELECT b.item_id, coalesce((SELECT array_to_string(list_sort(list(DISTINCT doc_id)), ',') FROM ev WHERE ev.item_id = b.item_id), CASE WHEN b.item_id % 3 = 0 THEN b.item_id || ',' || (b.item_id + 1) WHEN b.item_id % 3 = 1 THEN CAST(b.item_id AS VARCHAR) ELSE '' END) AS documents FROM benchmark b""")
def item_documents(spark, d):
    i = F.col("item_id")
    many, one = F.when(i % 3 == 0, F.array(i + 1, i, i)), F.when(i % 3 == 1, i)
    return _evidence_items(spark, d).select("item_id", F.array_join(B.item_documents(F.col("evidences"), many, one).cast("array<string>"), ",").alias("documents"))


@query("SELECT source, count(*) AS n, count(*) FILTER (length(text) > 1500) AS good, count(*) FILTER (length(text) > 1500) * 2 < count(*) AS weak FROM documents GROUP BY source")
def weak_groups(spark, d):
    return B.weak_groups(_t(spark, d, "documents"), "source", F.length("text") > 1500)


@query("""SELECT conv_id, turn, md5(replace(translate(text, '‘’“”', '''''""'), '--', '—')) AS text_md5 FROM conversations""")
def plain_quotes(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5(B.plain_quotes(F.col("text")).cast("binary")).alias("text_md5"))


# --- reports


@query("SELECT user_id % 10 AS dataset, event_type AS name, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def costs_added_up(spark, d):
    e = _t(spark, d, "events").select((F.col("user_id") % 10).alias("dataset"), F.create_map("event_type", "value").alias("costs"))
    return P.added_up(e, "costs", ["dataset"])


@query("""SELECT doc_id, 'txt, ' || lang || ' +title' || CASE WHEN doc_id % 2 = 0 THEN ' +keywords' ELSE '' END AS label, 'size=' || n_chars || ', source=' || source AS params FROM documents WHERE source IS NOT NULL""")
def run_labels(spark, d):
    augmentations = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("title"), F.lit("keywords"))).otherwise(F.array(F.lit("title")))
    params = F.create_map(F.lit("size"), F.col("n_chars").cast("string"), F.lit("source"), F.col("source"))
    return _t(spark, d, "documents").where("source is not null").select("doc_id", P.method_label(F.lit("txt"), F.col("lang"), augmentations).alias("label"), P.params_label(params).alias("params"))


@query("""WITH m AS (SELECT source, CASE WHEN lang = 'en' THEN 'evidence' ELSE 'no_evidence' END AS grp, lang AS name, count(*) AS value FROM documents GROUP BY ALL)
SELECT source, grp, name, value FROM m WHERE (grp = 'evidence') = (source IN (SELECT source FROM m WHERE grp = 'evidence'))""")
def shown_metrics(spark, d):
    grp = F.when(F.col("lang") == "en", "evidence").otherwise("no_evidence")
    m = _t(spark, d, "documents").where("source is not null").groupBy("source", grp.alias("grp"), F.col("lang").alias("name")).agg(F.count("*").alias("value"))
    return P.shown_group(m, ["source"])


@query("""WITH r AS (SELECT user_id AS run, count(*) AS chunks, count(DISTINCT event_type) AS documents FROM events GROUP BY 1),
s AS (SELECT user_id AS run, sum(l / n) AS llm, sum(s / n) AS s, sum(e / n) AS e FROM (SELECT user_id, event_type, count(*) AS n, sum(value) AS s, sum(event_id % 7) AS l, sum(event_id % 5) AS e FROM events GROUP BY ALL) GROUP BY 1),
i AS (SELECT user_id AS run, sum(value) / count(*) AS s, CAST(sum(event_id % 3) AS DOUBLE) / count(*) AS e FROM events WHERE user_id % 4 <> 0 GROUP BY 1)
SELECT run, round(llm, 6) AS llm_tokens, round(s.s + i.s * (chunks * 1.0::DOUBLE / documents), 6) AS seconds, round(s.e + i.e * (chunks * 1.0::DOUBLE / documents), 6) AS embed_tokens FROM r LEFT JOIN s USING (run) LEFT JOIN i USING (run)""")
def index_costs(spark, d):
    e = _t(spark, d, "events").withColumn("run", F.col("user_id"))
    runs = e.groupBy("run").agg(F.count("*").alias("chunks"), F.count_distinct("event_type").alias("documents"))
    stages = e.groupBy("run", F.col("event_type").alias("stage")).agg(F.count("*").alias("documents"), F.sum("value").alias("seconds"), F.sum(F.col("event_id") % 7).alias("llm_tokens"), F.sum(F.col("event_id") % 5).alias("embedding_tokens"))
    indexes = e.where("user_id % 4 <> 0").groupBy("run").agg(F.count("*").alias("chunks"), F.sum("value").alias("seconds"), F.sum(F.col("event_id") % 3).alias("embedding_tokens"))
    return P.index_cost(runs, stages, indexes)


@query("SELECT source, count(DISTINCT lang) > 1 AS differs FROM documents WHERE source IS NOT NULL GROUP BY source")
def rows_differ(spark, d):
    return P.differs(_t(spark, d, "documents").where("source is not null"), ["source"], ["lang"])


_BY = "WITH v AS (SELECT event_type AS method, user_id, round(avg(value), 6) AS value FROM events GROUP BY ALL)"


def _by_user(spark, d):
    return _t(spark, d, "events").groupBy(F.col("event_type").alias("method"), "user_id").agg(F.round(F.avg("value"), 6).alias("value"))


@query(f"{_BY} SELECT method, user_id, value, CAST(row_number() OVER (PARTITION BY method ORDER BY value DESC NULLS LAST, user_id) AS INTEGER) AS place FROM v")
def table_places(spark, d):
    return P.table_rows(_by_user(spark, d), ["method"], "value", ["user_id"])


@query(f"{_BY} SELECT method, (SELECT user_id FROM v w WHERE w.method = v.method ORDER BY value, user_id LIMIT 1) AS least, (SELECT user_id FROM v w WHERE w.method = v.method ORDER BY value DESC, user_id LIMIT 1) AS most FROM v GROUP BY method")
def extreme_rows(spark, d):
    return P.extremes(_by_user(spark, d), ["method"], "value", "user_id")


@query("SELECT conv_id AS item_id, round(avg(CASE WHEN role = 'system' THEN NULL ELSE CAST(length(text) % 2 = 0 AS INTEGER) END), 6) AS value FROM conversations GROUP BY 1")
def context_recall(spark, d):
    said = F.when(F.col("role") != "system", F.length("text") % 2 == 0)
    return P.context_recall(_t(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), said.alias("attributed")))


@query("""WITH f AS (SELECT item_id FROM benchmark WHERE item_id % 5 <> 0 ORDER BY sha1(CAST(item_id AS VARCHAR)) LIMIT 15) SELECT item_id FROM f WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)""")
def judge_sample(spark, d):
    items = _t(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 5 != 0, F.col("text")).alias("answer"))
    verdicts = _t(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("toxic") != 0, "failed").alias("error"))
    return P.judge_sample(items, verdicts, 15)


@query("""SELECT doc_id AS run, CASE WHEN quality = 1 THEN 0.25::DOUBLE WHEN toxic = 0 THEN 1.0::DOUBLE END AS ours, CASE WHEN toxic = 0 THEN 2.0::DOUBLE END AS others FROM labels""")
def judge_upsert(spark, d):
    l = _t(spark, d, "labels")  # noqa: E741
    old = l.select(F.col("doc_id").alias("run"), F.when(F.col("toxic") == 0, F.create_map(F.lit("a-k=5"), F.lit(1.0), F.lit("b-k=5"), F.lit(2.0))).alias("judged"))
    entry = l.where("quality = 1").select(F.col("doc_id").alias("run"), F.lit("a").alias("judge"), F.lit(5).alias("k"), F.lit(0.25).alias("value"))
    return P.with_judgement(old, entry).select("run", F.col("judged")["a-k=5"].alias("ours"), F.col("judged")["b-k=5"].alias("others"))


@query("SELECT conv_id, turn, md5('Title of:' || chr(10) || text || chr(10) || '(by ' || role || ')') AS prompt_md5 FROM conversations")
def filled_prompts(spark, d):
    built = A.prompt("Title of:\n{text}\n(by {role})", text=F.col("text"), role=F.col("role"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5(built.cast("binary")).alias("prompt_md5"))


# --- chunkers over an embedding provider, and their token counts


def _text_chunks(spark, d, chunker):
    return chunker(_t(spark, d, "documents"), by_line=True, texts=False).select("doc_id", "chunk_index", "start", "end")


@query()
def chunk_semantic(spark, d):
    return _text_chunks(spark, d, V.semantic)


@query()
def chunk_tiled(spark, d):
    return _text_chunks(spark, d, V.tiled)


@query()
def chunk_clustered(spark, d):
    return _text_chunks(spark, d, V.clustered)


def _tokens() -> providers.BpeTokens:
    import public_tokenizers

    return providers.BpeTokens(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def bpe_token_counts(spark, d):
    t = _tokens()
    rows = _t(spark, d, "documents").select("doc_id", t.counter()(F.col("text")).alias("tokens"), t.truncated(F.col("text"), 100).alias("t"))
    return rows.select("doc_id", "tokens", F.length("t.text").alias("first_100_chars"), F.col("t.cut").alias("cut"))


@query()
def chunk_fixed_bpe(spark, d):
    return C.fixed_token(_t(spark, d, "documents"), 128, 16, _tokens().spans, texts=False).select("doc_id", "chunk_index", "start", "end")


@query("SELECT doc_id, contains(lower(text), 'the') AS has FROM documents")
def text_contains(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.holds(F.col("text"), F.lit("The")).alias("has"))


_COUNTS = ", ".join("len(list_filter(ws, lambda w: w IN (" + ", ".join(f"'{w}'" for w in ws) + f"))) AS {code}" for code, ws in N.COMMON.items())
_MOST = f"greatest({', '.join(N.COMMON)})"


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(substr(coalesce(text, ''), 1, 3000)), '\\p{{L}}+') AS ws FROM documents), c AS (SELECT doc_id, {_COUNTS} FROM w)
SELECT doc_id, CASE WHEN {_MOST} = 0 THEN 'en' {' '.join(f"WHEN {code} = {_MOST} THEN '{code}'" for code in N.COMMON)} END AS detected FROM c""")
def detected_language(spark, d):
    return _t(spark, d, "documents").select("doc_id", N.detected(F.col("text")).alias("detected"))


@query(r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS ts FROM documents),
a AS (SELECT doc_id, text, unnest([translate(ts[1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ts[5], ts[9], 'no such words']) AS alias FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, alias) AS place FROM a WHERE alias <> '' AND contains(lower(text), lower(alias)))
SELECT doc_id, alias, CAST(strpos(lower(text), lower(alias)) - 1 AS INTEGER) AS first FROM r WHERE place = 1""")
def alias_places(spark, d):
    """Aliases made of a document's own terms, one in capitals (A to Z only: engines differ beyond), and one that no text has."""
    term = lambda i: F.get(T.terms(F.col("text")), F.lit(i))
    rows = _t(spark, d, "documents").select("doc_id", "text", F.array(F.translate(term(0), string.ascii_lowercase, string.ascii_uppercase), term(4), term(8), F.lit("no such words")).alias("aliases"))
    return L.longest_alias(rows).select("doc_id", "alias", F.get("starts", F.lit(0)).alias("first"))


@query(f"""WITH {_W} SELECT doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(chunk_text) DESC, chunk_index) AS INTEGER) AS place FROM chunks WHERE contains(lower(chunk_text), 'de')""")
def longest_chunks(spark, d):
    return P.inspected(C.fixed_char(_t(spark, d, "documents"), SIZE, OVERLAP), "De", "longest").select("doc_id", "chunk_index", "place")
