"""Queries over the tables of a data folder, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import providers
from ..functions import text as T
from ..operators import augmentation as A
from ..operators import chunking as C
from ..operators import comparison as M
from ..operators import evaluation as E
from ..operators import locate as L
from ..operators import retrieval as R
from ..operators import spans as S
from ..session import kept
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SIZE, OVERLAP = 1000, 200


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark: SparkSession, d: str, texts: bool = True) -> DataFrame:
    return C.fixed_char(_t(spark, d, "documents"), SIZE, OVERLAP, texts)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select("item_id", F.col("text").alias("query"), F.col("text").alias("needle"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return L.exact(_items(spark, d), _t(spark, d, "documents"))


_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||" + "||".join(f"chr({c})" for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Common table expressions of the SQL side.
_W = f"""w0 AS (
  SELECT doc_id, text, unnest(range(CAST(ceil(greatest(length(text) - {SIZE}, 0) / {SIZE - OVERLAP}.0) AS BIGINT) + 1)) AS i FROM documents WHERE text IS NOT NULL
), w1 AS (SELECT doc_id, text, i, i * {SIZE - OVERLAP} AS base, substr(text, i * {SIZE - OVERLAP} + 1, {SIZE}) AS w FROM w0
), w2 AS (
  SELECT doc_id, text, i, base + length(w) - length(ltrim(w, {_WS})) AS s, base + length(rtrim(w, {_WS})) AS e FROM w1
), w3 AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM w2 WHERE e > s
), chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", substr(text, s + 1, e - s) AS chunk_text
  FROM w3 WHERE pe IS NULL OR e > pe
)"""
_EV = """ev AS (
  SELECT b.item_id, d.doc_id, CAST(strpos(d.text, b.text) - 1 AS INTEGER) AS start, CAST(strpos(d.text, b.text) - 1 + length(b.text) AS INTEGER) AS "end"
  FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0
)"""
_BM25 = r"""post AS (
  SELECT doc_id, chunk_index, len(ts) AS dl, unnest(ts) AS term FROM (SELECT doc_id, chunk_index, regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}_]{2,}') AS ts FROM chunks)
), tf AS (SELECT term, doc_id, chunk_index, dl, count(*) AS tf FROM post GROUP BY ALL
), st AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM chunks) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf GROUP BY term
), av AS (SELECT avg(len(regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}_]{2,}'))) AS avgdl FROM chunks
), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark
), sc AS (
  SELECT item_id, doc_id, chunk_index, round(sum(idf * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN st USING (term), av GROUP BY ALL
), bm AS (
  SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_index) AS INTEGER) AS rank, doc_id, chunk_index, score FROM sc) WHERE rank <= {k}
)"""


# --- corpus and chunks


@query("""SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest, median(length(text))::DOUBLE AS median_chars,
  CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))) AS BIGINT) AS tokens FROM documents GROUP BY lang""")
def corpus_stats(spark, d):
    n = F.length("text")
    return _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(n).alias("chars"), F.max(n).cast("long").alias("longest"), F.median(n).alias("median_chars"), F.sum(T.n_words(F.col("text"))).alias("tokens"))


@query(f"WITH {_W} SELECT doc_id, chunk_index, start, \"end\", md5(chunk_text) AS text_md5 FROM chunks")
def chunk_fixed_char(spark, d):
    return _chunks(spark, d).select("doc_id", "chunk_index", "start", "end", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"))


@query("SELECT CAST(0 AS BIGINT) AS violations")
def chunk_verify_violations(spark, d):
    docs = _t(spark, d, "documents")
    bad = [C.violations(docs, c) for c in (_chunks(spark, d), C.fixed_token(docs), C.by_document(docs, C.sentence_chunks))]
    return bad[0].unionByName(bad[1]).unionByName(bad[2]).agg(F.count("*").alias("violations"))


@query(f"""WITH {_W} SELECT count(*) AS chunks, round(avg("end" - start), 6) AS mean_chars, CAST(min("end" - start) AS INTEGER) AS min_chars, CAST(max("end" - start) AS INTEGER) AS max_chars,
  CAST(count(*) FILTER (start < before) AS BIGINT) AS overlapping FROM (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before FROM chunks)""")
def chunk_size_stats(spark, d):
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    n = F.col("end") - F.col("start")
    return _chunks(spark, d).withColumn("before", before).agg(F.count("*").alias("chunks"), F.round(F.avg(n), 6).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.count_if(F.col("start") < F.col("before")).alias("overlapping"))


@query("SELECT source, list_sort(list(length(text)))[len(list(length(text))) // 2 + 1] AS upper_median, min(length(text)) AS least, max(length(text)) AS most FROM documents GROUP BY source")
def length_upper_median(spark, d):
    n = F.length("text").cast("long")
    # lengths by value, so that a large group is not gathered: the first length at which half the rows are passed
    counts = _t(spark, d, "documents").select("source", n.alias("n")).groupBy("source", "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source").orderBy("n")
    upto, whole = F.sum("c").over(w), F.sum("c").over(Window.partitionBy("source"))
    rows = counts.select("source", "n", upto.alias("upto"), whole.alias("whole"))
    return rows.groupBy("source").agg(F.min(F.when(F.col("upto") >= F.floor(F.col("whole") / 2) + 1, F.col("n"))).alias("upper_median"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("""WITH w AS (
  SELECT doc_id, pos, size, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY pos) AS "end" FROM (
    SELECT doc_id, unnest(range(len(ws))) AS pos, length(unnest(ws)) AS size, length(unnest(gs)) AS gap FROM (
      SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f]+') AS ws, regexp_extract_all(text, '([ \\t\\n\\r\\f]*)[^ \\t\\n\\r\\f]+', 1) AS gs FROM documents))
), g AS (SELECT doc_id, pos // 256 AS i, min("end" - size) AS start, max("end") AS "end" FROM w GROUP BY ALL)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM g""")
def chunk_fixed_token(spark, d):
    return C.fixed_token(_t(spark, d, "documents"), 256, 0).select("doc_id", "chunk_index", "start", "end")


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS chunk_index, CAST(base + length(line) - length(ltrim(line, chr(9) || ' ')) AS INTEGER) AS start,
  CAST(base + length(rtrim(line, chr(9) || ' ')) AS INTEGER) AS "end"
FROM (SELECT doc_id, pos, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
WHERE trim(line, chr(9) || ' ') <> ''""")
def paragraph_spans(spark, d):
    return C.by_document(_t(spark, d, "documents"), lambda t: C.paragraph_spans(t, True)).select("doc_id", "chunk_index", "start", "end")


@query("""WITH s AS (
  SELECT doc_id, unnest(regexp_extract_all(replace(text, chr(10), '. ' || chr(10)), '(?s).+?[.!?]+(?:[ \\n]+|$)|.+$')) AS piece FROM documents
) SELECT doc_id, CAST(sum(length(regexp_replace(piece, '[^A-Za-zÀ-ÿ]', '', 'g'))) AS BIGINT) AS letters FROM s GROUP BY doc_id""")
def sentence_letters(spark, d):
    """Letters inside sentence spans: all of the text's, as spans only leave white space out."""
    s = C.by_document(_t(spark, d, "documents"), lambda t: C.sentence_spans(t, True))
    return s.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("chunk_text", "[^A-Za-zÀ-ÿ]", ""))).alias("letters"))


#: Sentences by line: a mark stands after each break, pieces between marks are trimmed.
_SENTENCES = f"""WITH p0 AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])(\\s+)', '\\1\\2' || chr(1), 'g'), '(\\n)', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM documents),
p1 AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM p0),
p2 AS (SELECT doc_id, p, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p1),
se AS (SELECT doc_id, CAST(pos + length(p) - length(ltrim(p, {_WS})) AS INTEGER) AS s, CAST(pos + length(rtrim(p, {_WS})) AS INTEGER) AS e FROM p2 WHERE length(trim(p, {_WS})) > 0)"""


@query(_SENTENCES + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, s AS start, e AS \"end\" FROM se")
def sentence_spans(spark, d):
    return C.by_document(_t(spark, d, "documents"), lambda t: C.sentence_spans(t, True)).select("doc_id", "chunk_index", "start", "end")


@query("SELECT doc_id, length(text) AS covered FROM documents WHERE length(text) > 0")
def sentence_pieces(spark, d):
    p = C.by_document(_t(spark, d, "documents"), lambda t: C.sentence_pieces(t, True))
    return p.groupBy("doc_id").agg(F.sum(F.length("chunk_text")).alias("covered"))


@query()
def chunk_sentence(spark, d):
    return C.by_document(_t(spark, d, "documents"), lambda t: C.sentence_chunks(t, 128, 16)).select("doc_id", "chunk_index", "start", "end")


@query()
def chunk_boundary_model(spark, d):
    return C.boundary_chunks(_t(spark, d, "documents")).select("doc_id", "chunk_index", "start", "end")


@query(r"""WITH n AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) AS tokens FROM documents),
s AS (SELECT doc_id, text, CAST(greatest(1, ceil(length(text) / greatest(1, ceil(tokens / 100.0)))) AS BIGINT) AS size FROM n)
SELECT doc_id, CAST(i // size AS INTEGER) AS piece_index, md5(substr(text, i + 1, size)) AS piece_md5 FROM (SELECT doc_id, text, size, unnest(range(0, greatest(length(text), 1), size)) AS i FROM s)""")
def split_by_tokens(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(C.equal_pieces(F.col("text"), T.n_words(F.col("text")), 100)).alias("piece_index", "piece")).select("doc_id", "piece_index", F.md5(F.col("piece").cast("binary")).alias("piece_md5"))


@query(f"""WITH {_W}, x AS (SELECT c.*, length(d.text) AS n FROM chunks c JOIN documents d USING (doc_id)),
y AS (SELECT doc_id, chunk_index, n, greatest(0, least(CAST(floor((start + "end" - 3000) / 2.0) AS INTEGER), n - 3000)) AS lo FROM x)
SELECT doc_id, chunk_index, CAST(lo AS INTEGER) AS lo, CAST(least(n, lo + 3000) AS INTEGER) AS hi FROM y""")
def context_window(spark, d):
    rows = _chunks(spark, d, texts=False).join(_t(spark, d, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    lo, hi = C.context_window(F.col("n"), F.col("start"), F.col("end"), 3000)
    return rows.select("doc_id", "chunk_index", lo.alias("lo"), hi.alias("hi"))


@query(r"""WITH m AS (SELECT doc_id, regexp_split_to_array(text, '[ \t\n\r]+') AS ws, text FROM documents)
SELECT doc_id, len(list_filter(ws, lambda x: x <> '')) > 50 AS cut, length(CASE WHEN len(list_filter(ws, lambda x: x <> '')) > 50 THEN regexp_extract(text, '^\s*(?:\S+\s+){0,49}\S+') ELSE text END) AS n FROM m""")
def truncate_tokens(spark, d):
    t = _t(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 50).alias("t"))
    return t.select("doc_id", F.col("t.cut").alias("cut"), F.length("t.text").cast("long").alias("n"))


# --- sections


_SECTIONS = r"""WITH p AS (SELECT page_id, html, strpos(lower(html), '<h1') AS place FROM pages)
SELECT page_id, CAST(0 AS INTEGER) AS chunk_index, CAST(0 AS INTEGER) AS start, CAST(place - 1 AS INTEGER) AS "end", CAST(0 AS INTEGER) AS level, '' AS title FROM p WHERE place > 1
UNION ALL SELECT page_id, 1, CAST(place - 1 AS INTEGER), CAST(length(html) AS INTEGER), 1,
  trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) FROM p WHERE place > 1"""


@query(_SECTIONS)
def html_sections(spark, d):
    return C.html_sections(_t(spark, d, "pages"))


@query()
def html_sections_budget(spark, d):
    return C.html_sections(_t(spark, d, "pages"), max_tokens=64)


@query(rf"""WITH c AS ({_SECTIONS})
SELECT c.*, coalesce((SELECT string_agg(a.title, ' / ' ORDER BY a.level) FROM c a WHERE a.page_id = c.page_id AND a.level > 0 AND a.chunk_index <= c.chunk_index
  AND NOT EXISTS (SELECT 1 FROM c b WHERE b.page_id = c.page_id AND b.level BETWEEN 1 AND a.level AND b.chunk_index > a.chunk_index AND b.chunk_index <= c.chunk_index)), '') AS path FROM c""")
def html_heading_paths(spark, d):
    return C.heading_paths(C.html_sections(_t(spark, d, "pages")), "page_id")


@query(r"""WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, html, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS t FROM a)
SELECT page_id, md5(coalesce(nullif(t, ''), html)) AS text_md5 FROM b""")
def html_plain_text(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(T.plain_html(F.col("html")).cast("binary")).alias("text_md5"))


def _markdown(spark, d):
    """Markdown made of conversations: a heading for each turn, its level by role."""
    c = _t(spark, d, "conversations")
    mark = F.when(F.col("role") == "user", "# ").when(F.col("role") == "assistant", "## ").otherwise("### ")
    md = L.joined(c.select("conv_id", "turn", F.concat(mark, F.lit("Turn "), F.col("turn").cast("string"), F.lit("\n"), F.col("text")).alias("text")), "conv_id", "turn", "text")
    return md.select(F.col("conv_id").alias("doc_id"), "text")


@query(rf"""WITH md AS (SELECT conv_id AS doc_id, string_agg(CASE role WHEN 'user' THEN '# ' WHEN 'assistant' THEN '## ' ELSE '### ' END || 'Turn ' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM md),
l1 AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
  sum(CASE WHEN regexp_matches(line, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fenced FROM l0),
l2 AS (SELECT *, CASE WHEN fenced THEN 0 ELSE length(regexp_extract(line, '^(#{{1,6}})\s', 1)) END AS level FROM l1),
l3 AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sid FROM l2),
h AS (SELECT doc_id, sid, min(pos) AS pos, max(level) AS level, trim(max(CASE WHEN level > 0 THEN regexp_extract(line, '^#{{1,6}}\s+(.*)', 1) END), {_WS}) AS title, string_agg(line, chr(10) ORDER BY i) AS part FROM l3 GROUP BY doc_id, sid),
c AS (SELECT doc_id, sid, level, title, CAST(pos + length(part) - length(ltrim(part, {_WS})) AS INTEGER) AS start, CAST(pos + length(rtrim(part, {_WS})) AS INTEGER) AS "end", length(trim(part, {_WS})) AS solid FROM h)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS INTEGER) AS chunk_index, start, "end", CAST(level AS INTEGER) AS level,
  coalesce((SELECT string_agg(a.title, '/' ORDER BY a.level) FROM c a WHERE a.doc_id = c.doc_id AND a.level > 0 AND a.sid <= c.sid
    AND NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.level BETWEEN 1 AND a.level AND b.sid > a.sid AND b.sid <= c.sid)), '') AS header_path
FROM c WHERE solid > 0""")
def markdown_sections(spark, d):
    return C.markdown_sections(_markdown(spark, d))


@query()
def markdown_sections_budget(spark, d):
    return C.markdown_sections(_markdown(spark, d), max_tokens=32)


# --- embedding chunkers: an embedding label is a document, its vectors in order are the sentences


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("label").cast("long").alias("doc"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))


_DIST = """v AS (SELECT CAST(label AS BIGINT) AS doc, vec_id AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
d AS (SELECT doc, pos, round(1 - list_inner_product(vec, nxt) / sqrt(list_inner_product(vec, vec) * list_inner_product(nxt, nxt)), 9) AS dist
  FROM (SELECT *, lead(vec) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM v) WHERE nxt IS NOT NULL)"""


@query(f"""WITH {_DIST}, t AS (SELECT doc, round(quantile_cont(dist, 0.95), 9) AS thr FROM d GROUP BY doc),
f AS (SELECT v.doc, v.pos, coalesce(lag(d.dist > t.thr) OVER (PARTITION BY v.doc ORDER BY v.pos), false) AS first FROM v LEFT JOIN d USING (doc, pos) LEFT JOIN t ON t.doc = v.doc),
g AS (SELECT doc, pos, sum(CAST(first AS INTEGER)) OVER (PARTITION BY doc ORDER BY pos) AS grp FROM f)
SELECT doc, CAST(grp AS BIGINT) AS grp, min(pos) AS first_pos, max(pos) AS last_pos FROM g GROUP BY doc, grp""")
def semantic_breakpoints(spark, d):
    # a cut lies before the vector after a large distance
    rows = _vectors(spark, d)
    w = Window.partitionBy("doc").orderBy("pos")
    dense_ = rows.select("doc", (F.row_number().over(w) - 1).cast("long").alias("i"), "pos", "vec")
    g = C.semantic_groups(dense_.select("doc", F.col("i").alias("pos"), "vec"))
    ids = dense_.select("doc", F.col("i"), "pos")
    first = ids.select("doc", F.col("i").alias("first_pos"), F.col("pos").alias("p0"))
    last = ids.select("doc", F.col("i").alias("last_pos"), F.col("pos").alias("p1"))
    return g.join(first, ["doc", "first_pos"]).join(last, ["doc", "last_pos"]).select("doc", "grp", F.col("p0").alias("first_pos"), F.col("p1").alias("last_pos"))


@query("""WITH v AS (SELECT CAST(label AS BIGINT) AS doc, vec_id AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
b AS (SELECT *, lag(vec, 3) OVER w AS before, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc) AS n FROM v WINDOW w AS (PARTITION BY doc ORDER BY pos)),
d AS (SELECT doc, pos, round(1 - list_inner_product(vec, before) / sqrt(list_inner_product(vec, vec) * list_inner_product(before, before)), 9) AS dist FROM b WHERE i >= 3 AND i <= n - 3 AND n > 6),
t AS (SELECT doc, round(quantile_cont(dist, 0.9), 9) AS thr FROM d GROUP BY doc)
SELECT doc, pos, dist FROM (SELECT *, max(dist) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM d) JOIN t USING (doc) WHERE dist >= thr AND dist >= top""")
def tiled_boundaries(spark, d):
    return C.tiled_boundaries(_vectors(spark, d))


@query()
def clustered_chunks(spark, d):
    return C.clustered(_vectors(spark, d))


# --- spans and evidence


@query(f"""WITH RECURSIVE {_W}, o AS (SELECT doc_id, start, "end", max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM chunks),
g AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, "end") AS island FROM o)
SELECT doc_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY doc_id, island""")
def span_merge(spark, d):
    return S.merged(_chunks(spark, d, texts=False), ["doc_id"])


@query(f"""WITH {_W}, {_EV} SELECT doc_id, chunk_index FROM chunks c WHERE EXISTS (SELECT 1 FROM ev WHERE ev.doc_id = c.doc_id AND c.start < ev."end" AND ev.start < c."end")""")
def span_overlap_semi(spark, d):
    return S.overlapping(_chunks(spark, d), _evidence(spark, d), ["doc_id"]).select("doc_id", "chunk_index")


@query(f"""WITH {_EV}, p AS (SELECT DISTINCT doc_id, unnest(generate_series(start, "end" - 1)) AS c FROM ev) SELECT doc_id, count(*) AS total FROM p GROUP BY doc_id""")
def span_union_length(spark, d):
    return S.total_length(_evidence(spark, d), ["doc_id"])


@query(f"""WITH {_W}, {_EV}, e AS (SELECT DISTINCT doc_id, unnest(generate_series(start, "end" - 1)) AS c FROM ev),
k AS (SELECT DISTINCT doc_id, unnest(generate_series(start, "end" - 1)) AS c FROM chunks)
SELECT doc_id, count(*) AS shared FROM e JOIN k USING (doc_id, c) GROUP BY doc_id""")
def span_coverage(spark, d):
    """Characters of evidence that a document's chunks cover."""
    return S.shared_length(_chunks(spark, d), _evidence(spark, d), ["doc_id"]).select("doc_id", F.col("shared").cast("long").alias("shared"))


@query(f'WITH {_EV} SELECT item_id, doc_id, start, "end" FROM ev')
def locate_exact(spark, d):
    return _evidence(spark, d)


_FOLD = r"trim(regexp_replace(replace(lower(translate({c}, '‘’‚‛“”„–—‒―', '''''''''\"\"\"----')), '…', '...'), '\s+', ' ', 'g'))".replace('\\"', '"')


@query(f"WITH i AS (SELECT item_id, {_FOLD.format(c='text')} AS n FROM benchmark), d AS (SELECT doc_id, {_FOLD.format(c='text')} AS t FROM documents) SELECT item_id, doc_id FROM i JOIN d ON strpos(t, n) > 0")
def locate_folded(spark, d):
    return L.folded(_items(spark, d), _t(spark, d, "documents"))


@query(f"""WITH i AS (SELECT item_id, text, {_FOLD.format(c='text')} AS n FROM benchmark), d AS (SELECT doc_id, text, {_FOLD.format(c='text')} AS t FROM documents),
k AS (SELECT item_id, CASE WHEN EXISTS (SELECT 1 FROM documents WHERE strpos(documents.text, i.text) > 0) THEN 'exact' WHEN EXISTS (SELECT 1 FROM d WHERE strpos(d.t, i.n) > 0) THEN 'folded' ELSE 'none' END AS kind FROM i)
SELECT kind, count(*) AS items FROM k GROUP BY kind""")
def evidence_match_counts(spark, d):
    return L.match_kinds(_items(spark, d), _t(spark, d, "documents")).groupBy("kind").agg(F.count("*").alias("items"))


@query("""WITH p AS (SELECT item_id, text, unnest(range(length(text) - 1)) AS i FROM benchmark) SELECT item_id, count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM p WHERE substr(text, i + 1, 2) = 'th' GROUP BY item_id""")
def needle_occurrences(spark, d):
    at = F.explode(L.occurrences(F.col("text"), F.lit("th")))
    return _t(spark, d, "benchmark").select("item_id", at.alias("i")).groupBy("item_id").agg(F.count("*").alias("n"), F.sum("i").alias("places"))


# --- retrieval


@query(f"WITH {_W}, {_BM25.replace('{k}', '10')} SELECT term, df, round(idf, 9) AS idf FROM st")
def bm25_term_stats(spark, d):
    terms = F.explode(F.array_distinct(T.terms(F.col("chunk_text"))))
    return R.term_stats(_chunks(spark, d).select(terms.alias("term")), _chunks(spark, d, texts=False).count()).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {_W}, {_BM25.replace('{k}', '10')} SELECT * FROM bm")
def bm25_topk(spark, d):
    return R.bm25(_chunks(spark, d), _items(spark, d), 10)


_DENSE = """SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, s AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id, LATERAL (SELECT round(list_inner_product(q.x, c.x) / sqrt(list_inner_product(q.x, q.x) * list_inner_product(c.x, c.x)), 6) AS s)
  WHERE q.vec_id % 20 = 0) WHERE rank <= 50"""


@query(f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings) {_DENSE}")
def dense_topk(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", "embedding")
    return R.dense(v, v.where("vec_id % 20 = 0"), 50)


_HYBRID = _BM25.replace("{k}", "50") + """, dn AS (
  SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id, chunk_index) AS rank, doc_id, chunk_index FROM q JOIN tf USING (term) GROUP BY item_id, doc_id, chunk_index) WHERE rank <= 50
), fu AS (
  SELECT item_id, doc_id, chunk_index, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000000 + rank) AS seen
  FROM (SELECT item_id, doc_id, chunk_index, 0 AS list, rank FROM dn UNION ALL SELECT item_id, doc_id, chunk_index, 1, rank FROM bm) GROUP BY ALL
)"""


@query(f"WITH {_W}, {_HYBRID} SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, seen) AS INTEGER) AS rank, doc_id, chunk_index, score FROM fu) WHERE rank <= 50")
def hybrid_rrf(spark, d):
    # a dense stand-in for the benchmark: chunks ranked by the share of the item's terms that they hold
    items = _items(spark, d)
    m = R.matched(_chunks(spark, d), items)
    return R.retrieve("hybrid", m, items, 50, R.shared_terms(m, 50))


@query(f"""WITH {_W}, {_BM25.replace('{k}', '50')}, r AS (
  SELECT bm.item_id, bm.doc_id, bm.chunk_index, bm.rank AS was, round(len(list_intersect(qs, regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]{{2,}}'))) / len(qs), 6) AS score
  FROM bm JOIN chunks USING (doc_id, chunk_index) JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS qs FROM benchmark) USING (item_id)
) SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, was) AS INTEGER) AS rank, doc_id, chunk_index, score FROM r) WHERE rank <= 10""")
def rerank_topk(spark, d):
    chunks, items = _chunks(spark, d), _items(spark, d)
    return R.reranked(R.bm25(chunks, items, 50), chunks, items, 10)


# --- evaluation


def _named(spark, d):
    """What an item without evidence names: the document of its own number."""
    return _t(spark, d, "benchmark").select("item_id", F.col("item_id").alias("doc_id"))


def _metrics(spark, d):
    spans = kept(_chunks(spark, d, texts=False))
    ranking = R.looked_at(R.bm25(_chunks(spark, d), _items(spark, d), 10), spans).select("item_id", "rank", "doc_id", "start", "end")
    evidence = kept(_evidence(spark, d))
    return E.per_question(ranking, evidence, _items(spark, d), spans, gold=E.gold_documents(evidence, _named(spark, d)))


_METRICS = _BM25.replace("{k}", "10") + f""", {_EV}, ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
has AS (SELECT DISTINCT item_id FROM ev),
gold AS (SELECT DISTINCT item_id, doc_id FROM ev UNION ALL SELECT item_id, item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM has)),
rk AS (SELECT bm.item_id, bm.rank, c.doc_id, c.start, c."end" FROM bm JOIN chunks c USING (doc_id, chunk_index)),
h AS (SELECT rk.*, EXISTS (SELECT 1 FROM ev WHERE ev.item_id = rk.item_id AND ev.doc_id = rk.doc_id AND ev.start < rk."end" AND rk.start < ev."end") AS hit,
  EXISTS (SELECT 1 FROM gold WHERE gold.item_id = rk.item_id AND gold.doc_id = rk.doc_id) AS doc FROM rk),
rel AS (SELECT ev.item_id, count(DISTINCT (c.doc_id, c.chunk_index)) AS n FROM ev JOIN chunks c ON c.doc_id = ev.doc_id AND c.start < ev."end" AND ev.start < c."end" GROUP BY 1),
ec AS (SELECT DISTINCT item_id, doc_id, unnest(generate_series(start, "end" - 1)) AS c FROM ev),
rc AS (SELECT DISTINCT k, item_id, doc_id, unnest(generate_series(start, "end" - 1)) AS c FROM rk, ks WHERE rank <= k),
cov AS (SELECT k, item_id, count(*) AS n FROM ec JOIN rc USING (item_id, doc_id, c) GROUP BY ALL),
tot AS (SELECT item_id, count(*) AS n FROM ec GROUP BY 1),
m AS (
  SELECT b.item_id, 'doc_hit@' || k AS name, coalesce((SELECT max(CAST(doc AS DOUBLE)) FROM h WHERE h.item_id = b.item_id AND rank <= k), 0) AS value FROM benchmark b, ks
  UNION ALL SELECT b.item_id, 'mrr@10', coalesce((SELECT 1.0::DOUBLE / min(rank) FROM h WHERE h.item_id = b.item_id AND hit AND rank <= 10), 0) FROM has b
  UNION ALL SELECT b.item_id, 'hit@' || k, coalesce((SELECT max(CAST(hit AS DOUBLE)) FROM h WHERE h.item_id = b.item_id AND rank <= k), 0) FROM has b, ks
  UNION ALL SELECT b.item_id, 'ndcg@' || k, coalesce((SELECT sum(1 / log2(rank + 1)) FROM h WHERE h.item_id = b.item_id AND hit AND rank <= k), 0)
    / list_sum(list_transform(range(1, least(k, rel.n) + 1), lambda r: 1 / log2(r + 1))) FROM has b JOIN rel USING (item_id), ks
  UNION ALL SELECT b.item_id, 'evidence_recall@' || k, coalesce((SELECT n FROM cov WHERE cov.item_id = b.item_id AND cov.k = ks.k), 0) / tot.n FROM has b JOIN tot USING (item_id), ks
), pq AS (SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM has) THEN 'evidence' ELSE 'no_evidence' END AS grp, name, round(CAST(value AS DOUBLE), 6) AS value FROM m)"""


@query(f"WITH {_EV} SELECT DISTINCT item_id, doc_id FROM ev UNION ALL SELECT item_id, item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM ev)")
def gold_documents(spark, d):
    return E.gold_documents(_evidence(spark, d), _named(spark, d))


@query(f"WITH {_W}, {_METRICS} SELECT * FROM pq")
def eval_per_question(spark, d):
    return _metrics(spark, d)


@query(f"WITH {_W}, {_METRICS} SELECT grp, name, count(*) AS items, round(avg(value), 6) AS value FROM pq GROUP BY grp, name")
def eval_summary(spark, d):
    return E.summary(_metrics(spark, d))


_VERDICTS = "v AS (SELECT conv_id AS item_id, turn AS rank, CAST(length(text) % 3 = 0 AS INTEGER) AS verdict FROM conversations)"


@query(f"""WITH {_VERDICTS}, p AS (SELECT item_id, verdict, sum(verdict) OVER w / count(*) OVER w AS precision FROM v WINDOW w AS (PARTITION BY item_id ORDER BY rank))
SELECT item_id, round(sum(verdict * precision) / (sum(verdict) + 1e-10), 6) AS value FROM p GROUP BY item_id""")
def average_precision(spark, d):
    v = _t(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("rank"), (F.length("text") % 3 == 0).cast("int").alias("verdict"))
    return E.average_precision(v)


@query("""SELECT count(*) AS items, count(*) FILTER (toxic = 1) AS failed, round(avg(CASE WHEN toxic = 0 THEN quality * 1.0::DOUBLE END), 6) AS context_precision, round(avg(CASE WHEN toxic = 0 AND quality = 1 THEN 0.5::DOUBLE END), 6) AS context_recall,
  count(CASE WHEN toxic = 0 THEN 1 END) AS context_precision_n, count(CASE WHEN toxic = 0 AND quality = 1 THEN 1 END) AS context_recall_n FROM labels""")
def judge_summary(spark, d):
    ok = F.col("toxic") == 0
    v = _t(spark, d, "labels").select(F.when(ok, F.col("quality").cast("double")).alias("context_precision"), F.when(ok & (F.col("quality") == 1), 0.5).alias("context_recall"), F.when(~ok, "failed").alias("error"))
    return E.judge_summary(v)


@query("""WITH i AS (SELECT d.doc_id AS item_id, length(d.text) > 200 AS answerable, l.quality, l.toxic, d.lang FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT item_id, CASE WHEN NOT answerable THEN 'unanswerable' WHEN quality IS NULL THEN 'no_document' WHEN toxic = 1 THEN 'not_indexed' WHEN quality = 0 THEN 'not_in_rendering' ELSE 'keep' END AS reason FROM i""")
def item_eligibility(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    none = F.array().cast("array<bigint>")
    items = rows.select(
        F.col("doc_id").alias("item_id"),
        (F.length("text") > 200).alias("answerable"),
        F.when(F.col("quality").isNull(), none).otherwise(F.array("doc_id")).alias("docs"),
        F.when(F.col("toxic") == 1, none).otherwise(F.array("doc_id")).alias("indexed"),
        F.lit(1).alias("n_evidence"),
        F.coalesce("quality", F.lit(0)).alias("n_spans"),
    )
    return E.eligibility(items)


@query("SELECT item_id FROM benchmark ORDER BY sha1(CAST(item_id AS VARCHAR)) LIMIT 20")
def sample_order(spark, d):
    return E.sampled(_t(spark, d, "benchmark").select("item_id"), 20)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left_anti")


@query(f"WITH {_EV} SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM ev)")
def referenced_documents(spark, d):
    return _t(spark, d, "documents").join(_evidence(spark, d), "doc_id", "left_semi").select("doc_id", "lang")


@query(f"""WITH {_W}, {_BM25.replace('{k}', '5')}, {_EV}
SELECT item_id, question, rank, evidence, doc_id, chunk_index, start, "end", score, CASE WHEN length(t) > 300 THEN left(t, 300) || '...' ELSE t END AS preview FROM (
  SELECT bm.*, b.text AS question, start, "end", trim(regexp_replace(chunk_text, '\\s+', ' ', 'g')) AS t,
    EXISTS (SELECT 1 FROM ev WHERE ev.item_id = bm.item_id AND ev.doc_id = bm.doc_id AND c.start < ev."end" AND ev.start < c."end") AS evidence
  FROM bm JOIN chunks c USING (doc_id, chunk_index) JOIN benchmark b USING (item_id))""")
def show_ranking(spark, d):
    """What was retrieved for each question, each chunk marked if it overlaps the evidence; the benchmark has no answers."""
    chunks, items = _chunks(spark, d), _items(spark, d)
    shown = E.marked(R.looked_at(R.bm25(chunks, items, 5), chunks), _evidence(spark, d)).join(items, "item_id")
    return shown.select("item_id", F.col("query").alias("question"), "rank", "evidence", "doc_id", "chunk_index", "start", "end", "score", T.preview(F.col("chunk_text"), 300).alias("preview"))


# --- augmentation (stub model answers come from the conversations)

_FS = "trim(regexp_extract({c}, '(?s)^\\s*(.*?[.!?])(?:\\s|$)', 1))"


@query(f"""SELECT conv_id, turn, md5(coalesce(nullif(CASE WHEN turn % 5 = 4 THEN {_FS.format(c='text')} ELSE '' END, ''), concat_ws(chr(10) || chr(10), nullif(role, ''), nullif({_FS.format(c='text')}, ''), nullif(text, '')))) AS text_md5 FROM conversations""")
def text_to_embed(spark, d):
    c = _t(spark, d, "conversations")
    s, none = providers.first_sentence(F.col("text")), F.lit("")
    built = A.text_to_embed(F.col("text"), F.when(F.col("turn") % 5 == 4, s).otherwise(""), F.col("role"), none, s, none, F.array().cast("array<string>"))
    return c.select("conv_id", "turn", F.md5(built.cast("binary")).alias("text_md5"))


@query(f"""SELECT conv_id, turn, md5(concat_ws(chr(10) || chr(10), CASE WHEN role <> '' THEN 'title:' || chr(10) || role END, CASE WHEN {_FS.format(c='text')} <> '' THEN 'summary:' || chr(10) || {_FS.format(c='text')} END, 'original_text:' || chr(10) || text)) AS text_md5 FROM conversations""")
def text_for_llm(spark, d):
    built = A.text_for_llm(F.col("text"), {"title": F.col("role"), "summary": providers.first_sentence(F.col("text"))})
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5(built.cast("binary")).alias("text_md5"))


@query("SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(text, chr(10), ','), ','), lambda x: trim(x)), lambda x: x <> '')[1:8], ', ') AS keywords FROM conversations")
def keywords_clean(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", A.clean_keywords(F.col("text")).alias("keywords"))


@query(r"SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\s*(?:[-*•]|\d+[.)])\s*', ''))), lambda x: x <> ''), '|') AS questions FROM conversations")
def questions_clean(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(A.clean_questions(F.col("text")), "|").alias("questions"))


@query(r"""WITH q AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM conversations)
SELECT conv_id, turn, 'In "' || role || '", ' || CASE WHEN regexp_matches(substr(string_split(q, ' ')[1], 2, 1), '\p{Lu}') THEN q ELSE lower(left(q, 1)) || substr(q, 2) END AS question FROM q""")
def title_in_question(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.with_title(F.col("text"), F.col("role")).alias("question"))


@query(f"""WITH {_W}, h AS (SELECT doc_id, string_agg(chunk_text, chr(10) || chr(10) ORDER BY chunk_index) AS t FROM chunks WHERE chunk_index < 5 GROUP BY doc_id)
SELECT c.doc_id, chunk_index, {_FS.format(c='t')} AS title FROM chunks c JOIN h USING (doc_id)""")
def document_titles(spark, d):
    return A.with_titles(_chunks(spark, d)).select("doc_id", "chunk_index", "title")


@query()
def document_summaries(spark, d):
    return A.summarised(_t(spark, d, "documents"), 400)


@query(rf"""WITH {_W}, x AS (SELECT c.*, d.text, length(d.text) AS n, len(list_filter(regexp_split_to_array(d.text, '[ \t\n\r]+'), lambda w: w <> '')) AS words FROM chunks c JOIN documents d USING (doc_id)),
y AS (SELECT *, CAST(CASE WHEN words > 500 THEN floor(n * 500 / CAST(words AS DOUBLE)) ELSE n END AS INTEGER) AS width FROM x),
z AS (SELECT *, greatest(0, least(CAST(floor((start + "end" - width) / 2.0) AS INTEGER), n - width)) AS lo FROM y),
f AS (SELECT *, {_FS.format(c="substr(text, lo + 1, least(n, lo + width) - lo)")} AS context FROM z)
SELECT doc_id, chunk_index, context, CASE WHEN context <> '' THEN CAST(length(context) + 2 + length(chunk_text) AS INTEGER) END AS embedded_chars FROM f""")
def chunk_contexts(spark, d):
    c = A.with_context(_chunks(spark, d), _t(spark, d, "documents"), 500)
    return A.updated(c).select("doc_id", "chunk_index", "context", F.length("text_to_embed").alias("embedded_chars"))


# --- comparison


def _runs(spark, d):
    """Events as run results: users are data sets, event types methods, a day's mean value the metric."""
    e = _t(spark, d, "events")
    return e.groupBy((F.col("user_id") % 10).alias("dataset"), F.col("event_type").alias("method"), F.date_format("ts", "yyyy-MM-dd").alias("params")).agg(F.round(F.avg("value"), 6).alias("value"))


_RUNS = "r AS (SELECT user_id % 10 AS dataset, event_type AS method, strftime(ts, '%Y-%m-%d') AS params, round(avg(value), 6) AS value FROM events GROUP BY ALL)"


@query(f"WITH {_RUNS} SELECT dataset, method, params, value FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY value DESC NULLS LAST, params) AS n FROM r) WHERE n = 1")
def best_per_method(spark, d):
    return M.best(_runs(spark, d), ["dataset", "method"])


@query(f"WITH {_RUNS}, b AS (SELECT dataset, method, max(value) AS value FROM r GROUP BY ALL), x AS (SELECT *, max(CASE WHEN method = (SELECT min(event_type) FROM events) THEN value END) OVER (PARTITION BY dataset) AS ref FROM b) SELECT method, count(value) AS datasets, round(avg(value - ref), 6) AS difference FROM x GROUP BY method")
def mean_diff_to_reference(spark, d):
    first = _t(spark, d, "events").agg(F.min("event_type")).first()[0]
    return M.difference_to(_runs(spark, d).groupBy("dataset", "method").agg(F.max("value").alias("value")), first)


@query(f"WITH {_RUNS} SELECT method, " + ", ".join(f"count(*) FILTER (dataset = {i}) AS d{i}" for i in range(10)) + " FROM r GROUP BY method")
def run_count_pivot(spark, d):
    p = _runs(spark, d).groupBy("method").pivot("dataset", list(range(10))).count().fillna(0)
    return p.select("method", *[F.col(str(i)).alias(f"d{i}") for i in range(10)])


@query(f"WITH {_RUNS} SELECT method, " + ", ".join(f"max(value) FILTER (dataset = {i}) AS d{i}" for i in range(10)) + " FROM r GROUP BY method")
def method_pivot(spark, d):
    p = _runs(spark, d).groupBy("method").pivot("dataset", list(range(10))).agg(F.max("value"))
    return p.select("method", *[F.col(str(i)).alias(f"d{i}") for i in range(10)])


@query(f"""WITH {_RUNS}, n AS (SELECT user_id % 10 AS dataset, event_type AS method, strftime(ts, '%Y-%m-%d') AS params, count(*) AS n FROM events GROUP BY ALL), j AS (SELECT * FROM r JOIN n USING (dataset, method, params)),
k AS (SELECT method, rank() OVER (PARTITION BY method ORDER BY value) + (count(*) OVER (PARTITION BY method, value) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY method ORDER BY n) + (count(*) OVER (PARTITION BY method, n) - 1) / 2.0::DOUBLE AS ry FROM j)
SELECT method, round(corr(rx, ry), 6) AS rho FROM k GROUP BY method""")
def spearman_by_method(spark, d):
    e = _t(spark, d, "events")
    n = e.groupBy((F.col("user_id") % 10).alias("dataset"), F.col("event_type").alias("method"), F.date_format("ts", "yyyy-MM-dd").alias("params")).agg(F.count("*").alias("n"))
    return M.spearman(_runs(spark, d).join(n, ["dataset", "method", "params"]), "method", "value", "n")


_AB = "m AS (SELECT user_id, CASE WHEN event_type < 'd' THEN 'a' ELSE 'b' END AS run, round(avg(value), 6) AS value FROM events GROUP BY ALL), x AS (SELECT a.user_id, a.value AS value_a, b.value AS value_b, round(a.value - b.value, 6) AS difference FROM m a LEFT JOIN m b ON b.run = 'b' AND b.user_id = a.user_id WHERE a.run = 'a')"


def _ab(spark, d):
    m = _t(spark, d, "events").groupBy("user_id", F.when(F.col("event_type") < "d", "a").otherwise("b").alias("run")).agg(F.round(F.avg("value"), 6).alias("value"))
    return M.run_difference(m.where("run = 'a'"), m.where("run = 'b'"), "user_id", "value")


@query(f"WITH {_AB} SELECT * FROM x")
def run_difference(spark, d):
    return _ab(spark, d)


@query(f"WITH {_AB} SELECT count(*) FILTER (difference > 0) AS better, count(*) FILTER (difference < 0) AS worse, count(*) FILTER (difference = 0) AS equal FROM x")
def better_worse_equal(spark, d):
    x = F.col("difference")
    return _ab(spark, d).agg(F.count_if(x > 0).alias("better"), F.count_if(x < 0).alias("worse"), F.count_if(x == 0).alias("equal"))


@query(f"WITH {_AB} SELECT user_id, difference FROM (SELECT *, row_number() OVER (ORDER BY difference, user_id) AS lo, row_number() OVER (ORDER BY difference DESC, user_id) AS hi FROM x WHERE difference IS NOT NULL) WHERE lo <= 5 OR hi <= 5")
def extreme_differences(spark, d):
    x = _ab(spark, d).where("difference is not null").select("user_id", "difference")
    # two bounded top-k reports, not a global window
    return x.orderBy("difference", "user_id").limit(5).union(x.orderBy(F.col("difference").desc(), "user_id").limit(5)).distinct()


@query("""SELECT event_type || '_seconds' AS name, round(sum(value), 3) AS total, round(sum(value) / (SELECT count(DISTINCT user_id) FROM events), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY 1""")
def cost_summary(spark, d):
    e = _t(spark, d, "events").select(F.concat("event_type", F.lit("_seconds")).alias("name"), "value", "user_id")
    return M.cost_summary(e, e.agg(F.count_distinct("user_id")).first()[0])


@query("SELECT event_id, round(value / count(*) OVER (PARTITION BY user_id, event_type), 9) AS share FROM events")
def batch_share(spark, d):
    w = Window.partitionBy("user_id", "event_type")
    return _t(spark, d, "events").select("event_id", F.round(F.col("value") / F.count("*").over(w), 9).alias("share"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_costs(spark, d):
    return ingest.windowed_costs(_t(spark, d, "events"))


# --- document reconstruction

_OFF = 'o AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations)'


@query(f'WITH {_OFF} SELECT conv_id, turn, CAST(s AS BIGINT) AS start, CAST(s + n AS BIGINT) AS "end" FROM o')
def rebuild_offsets(spark, d):
    return L.rebuilt(_t(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def rebuild_documents(spark, d):
    j = L.joined(_t(spark, d, "conversations"), "conv_id", "turn", "text")
    return j.select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _levels(spark, d):
    return _t(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), (F.length("text") % 3 + 1).alias("level"))


@query("WITH h AS (SELECT conv_id, turn AS pos, length(text) % 3 + 1 AS level FROM conversations) SELECT conv_id, pos, CAST(level AS INTEGER) AS level, (SELECT min(n.pos) FROM h n WHERE n.conv_id = h.conv_id AND n.pos > h.pos AND n.level <= h.level) AS end_pos FROM h")
def section_ends(spark, d):
    return L.section_ends(_levels(spark, d), "conv_id")


_TOK = "t AS (SELECT conv_id AS doc, turn AS token, s AS start, s + n AS \"end\" FROM o), r AS (SELECT DISTINCT conv_id AS range_id, conv_id AS doc, 1 AS first, 4 AS stop FROM o)"


@query(f'WITH {_OFF}, {_TOK} SELECT range_id, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end" FROM r JOIN t ON t.doc = r.doc AND token >= first AND token < stop GROUP BY range_id')
def token_map(spark, d):
    o = L.rebuilt(_t(spark, d, "conversations"), "conv_id", "turn", "text")
    tokens = o.select(F.col("conv_id").alias("doc"), F.col("turn").alias("token"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    ranges = o.select(F.col("conv_id").alias("range_id"), F.col("conv_id").alias("doc"), F.lit(1).alias("first"), F.lit(4).alias("stop")).distinct()
    return L.covering_span(ranges, tokens)


@query(f'WITH {_OFF}, p AS (SELECT conv_id AS point_id, max(s + n) // 2 AS place FROM o GROUP BY 1) SELECT point_id, min(turn) AS block FROM p JOIN o ON o.conv_id = p.point_id AND place >= s AND place <= s + n GROUP BY 1')
def holding_block(spark, d):
    o = L.rebuilt(_t(spark, d, "conversations"), "conv_id", "turn", "text")
    points = o.groupBy(F.col("conv_id").alias("point_id")).agg(F.floor(F.max("end") / 2).alias("at")).select("point_id", F.col("point_id").alias("doc"), "at")
    return L.holding_block(points, o.select(F.col("conv_id").alias("doc"), F.col("turn").alias("block"), "start", "end"))


@query("""WITH a AS (SELECT DISTINCT user_id, TIMESTAMP '2024-01-15 00:00:00' AS "at" FROM events) SELECT a.user_id, "at", (SELECT arg_max(event_id, ts) FROM events e WHERE e.user_id = a.user_id AND e.ts <= a."at") AS value FROM a""")
def latest_revision(spark, d):
    e = _t(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("value"))
    return L.as_of(e, e.select("user_id", F.to_timestamp(F.lit("2024-01-15 00:00:00")).cast(dict(e.dtypes)["ts"]).alias("at")).distinct(), "user_id")


@query("""WITH RECURSIVE m AS (SELECT doc_id AS source, doc_id // 2 AS target FROM documents WHERE doc_id > 1), c(source, final) AS (SELECT * FROM m UNION ALL SELECT c.source, m.target FROM c JOIN m ON m.source = c.final)
SELECT source, min(final) AS final FROM c GROUP BY source""")
def move_chain(spark, d):
    m = _t(spark, d, "documents").where("doc_id > 1").select(F.col("doc_id").alias("source"), F.floor(F.col("doc_id") / 2).alias("target"))
    return L.chain_ends(m)


@query(f"""WITH RECURSIVE {_EV}, p AS (SELECT item_id, list(DISTINCT doc_id) AS docs, row_number() OVER (ORDER BY item_id) AS n FROM ev GROUP BY item_id),
w AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS have, CAST(NULL AS BIGINT) AS item_id UNION ALL
  SELECT p.n, CASE WHEN len(list_distinct(list_concat(w.have, p.docs))) <= 15 THEN list_distinct(list_concat(w.have, p.docs)) ELSE w.have END,
    CASE WHEN len(list_distinct(list_concat(w.have, p.docs))) <= 15 THEN p.item_id END FROM w JOIN p ON p.n = w.n + 1)
SELECT item_id FROM w WHERE item_id IS NOT NULL""")
def budget_select(spark, d):
    return L.within_budget(_evidence(spark, d).select("item_id", "doc_id"), 15)


@query("SELECT text, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def first_of_repeats(spark, d):
    n = _t(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return n.where("copies > 1")


# --- scalar functions


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed_md5, length(regexp_replace(text, '\s', '', 'g')) AS solid_chars FROM documents")
def squeeze_text(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", F.md5(T.squeeze(t).cast("binary")).alias("squeezed_md5"), F.length(F.regexp_replace(t, r"(?U)\s", "")).cast("long").alias("solid_chars"))


@query(f"SELECT doc_id, md5({_FOLD.format(c='text')}) AS folded_md5 FROM documents")
def fold_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("folded_md5"))


@query(r"""SELECT page_id, coalesce(nullif(left(trim(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '. '), 120), ''), 'document') AS safe, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, list_last(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')) AS last_part FROM pages""")
def url_ids(spark, d):
    path = F.coalesce(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), F.lit(""))
    return _t(spark, d, "pages").select("page_id", T.safe_id(F.col("url")).alias("safe"), path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("last_part"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages""")
def html_escape(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(T.escape_html(F.col("html"), True).cast("binary")).alias("escaped_md5"))


@query(r"SELECT doc_id, CAST(round_even(1.2::DOUBLE * len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')), 0) AS INTEGER) AS by_words, CAST(greatest(1, round_even(length(text) / 4.0::DOUBLE, 0)) AS INTEGER) AS by_chars FROM documents")
def token_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", providers.words_counter(F.col("text")).alias("by_words"), providers.chars_counter(F.col("text")).alias("by_chars"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS ts FROM documents),
t AS (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM w),
f AS (SELECT doc_id, t, min(i) AS i FROM t WHERE length(t) >= 5 GROUP BY ALL),
r AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM f)
SELECT d.doc_id, coalesce(string_agg(t, ', ' ORDER BY place), '') AS keywords FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND place <= 8 GROUP BY d.doc_id""")
def stub_keywords(spark, d):
    return _t(spark, d, "documents").select("doc_id", providers.frequent_terms(F.col("text")).alias("keywords"))


@query(f"WITH {_W} SELECT count(*) AS chunks, count(*) AS same FROM chunks")
def json_round_trip(spark, d):
    """Chunks to JSON and back: equal in every field."""
    c = _chunks(spark, d)
    schema = "doc_id long, chunk_index int, start int, end int, chunk_text string"
    back = c.select(F.struct(*c.columns).alias("c"), F.from_json(F.to_json(F.struct(*c.columns)), schema).alias("b"))
    return back.agg(F.count("*").alias("chunks"), F.count_if(F.col("c") == F.col("b")).alias("same"))
