"""Queries ``opN_<name>`` and ``pipeline`` over the tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, linededup, mixing, repetition, sharding, simhash, topk, toxicity, urlfilter, weaklabel
from ._common import table

#: Host and path rules of the production filter, fixed by its contract.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Bytes of a shard in the query: small enough that tables of a few megabytes split over several levels too.
SHARD_BYTES = 256 << 10
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.graded(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rated(table(spark, sf_dir, "documents"))


def op6_weaklabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return weaklabel.scored(docs, weaklabel.train(docs))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_decisions(table(spark, sf_dir, "documents"))
    kept = F.transform("kept_in", lambda k: F.concat_ws(":", k["doc_id"], k["line"]))
    said = F.array_join(F.col("removed").cast("array<string>"), ",")
    return found.select("doc_id", "text_key", "n_lines", F.size("removed").cast("long").alias("n_removed"), said.alias("removed"), F.array_join(kept, ",").alias("kept_in"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_toxicity, op2_simhash, op3_topk, op4_sharding, op5_repetition, op6_weaklabel, op7_linededup, op8_urlfilter, op9_bpe, op10_mixing, pipeline)
    return {f.__name__: f for f in named}


_TOPK = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_SHARDING = f"""
WITH RECURSIVE d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5('{sharding.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), chr(0)) || ':' || coalesce(text, chr(0))), 1, 15) AS BIGINT) AS key
  FROM documents
), s(depth, prefix, shard_bytes) AS (
  SELECT 0, CAST(0 AS BIGINT), CAST(sum(n_bytes) AS BIGINT) FROM d
  UNION ALL
  SELECT s.depth + 1, d.key >> (60 - s.depth - 1), CAST(sum(d.n_bytes) AS BIGINT)
  FROM s JOIN d ON d.key >> (60 - s.depth) = s.prefix
  WHERE s.shard_bytes > {SHARD_BYTES} AND s.depth < 60 GROUP BY 1, 2
)
SELECT doc_id, n_bytes, depth, prefix, CAST(0 AS BIGINT) AS page, shard_bytes
FROM d JOIN s ON d.key >> (60 - s.depth) = s.prefix WHERE s.shard_bytes <= {SHARD_BYTES}
"""

_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_DUPLICATED = "\n".join(
    f""", g{n} AS (
  SELECT doc, pos, lead(pos, {n - 1}) OVER w AS far, list(word) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS g
  FROM w WINDOW w AS (PARTITION BY doc ORDER BY pos)
), t{n} AS (
  SELECT doc, pos, count(*) OVER (PARTITION BY doc, g) AS times FROM g{n} WHERE far IS NOT NULL
), c{n} AS (
  SELECT doc, pos, size, max(coalesce(times, 0)) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= 2 AS inside
  FROM w LEFT JOIN t{n} USING (doc, pos)
), s{n} AS (SELECT doc, count(*) FILTER (inside) AS dup_words, coalesce(sum(size) FILTER (inside), 0) AS dup_chars FROM c{n} GROUP BY doc)"""
    for n, _ in repetition.COVERAGE
)
_REPETITION = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc, unnest(range(len(ws))) AS pos, unnest(ws) AS word, length(unnest(ws)) AS size
  FROM (SELECT doc, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)
), b AS (SELECT doc, count(*) AS n_words, CAST(sum(size) AS BIGINT) AS word_chars FROM w GROUP BY doc),
l AS (
  SELECT doc, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS size, row_number() OVER (PARTITION BY doc, line) AS nth
  FROM (SELECT doc, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), x AS (SELECT doc, count(*) FILTER (nth > 1) AS n_dup_lines, CAST(coalesce(sum(size) FILTER (nth > 1), 0) AS BIGINT) AS dup_line_chars FROM l GROUP BY doc)
{_DUPLICATED}
, r AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(s5.dup_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
    {", ".join(f"CAST(coalesce(s{n}.dup_chars, 0) AS BIGINT) AS dup{n}_chars" for n, _ in repetition.COVERAGE)}
  FROM d LEFT JOIN b USING (doc) LEFT JOIN x USING (doc) {" ".join(f"LEFT JOIN s{n} ON s{n}.doc = d.doc" for n, _ in repetition.COVERAGE)}
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND dup_line_chars <= {repetition.LINES}::DOUBLE * word_chars
  {" ".join(f"AND dup{n}_chars <= {most}::DOUBLE * word_chars" for n, most in repetition.COVERAGE)} AS kept
FROM r
"""


def _rule_sql(what: str, host: str, path: str) -> str:
    cases = []
    for verdict, text in sorted(URL_RULES, key=lambda r: -len(r[1])):
        h, p = text.split("/", 1)
        cases.append(f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '/{p}') THEN '{text if what == 'rule' else verdict}'")
    return "CASE " + " ".join(cases) + " END"


_LOWERED = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NODE = _LOWERED.format(x="regexp_extract({u}, '(?s)^(.*?://[^/?#]*)', 1)") + " || regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
_HOST = _LOWERED.format(x="regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)")
_PATH = "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_URLFILTER = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN {_HOST.format(u="url")} ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN {_PATH.format(u="url")} ELSE '' END AS path, CASE WHEN url LIKE '%://%' THEN {_NODE.format(u="url")} END AS node
  FROM pages
), tags AS (
  SELECT node AS a, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM p WHERE node IS NOT NULL AND (lower(html) LIKE '%canonical%' OR lower(html) LIKE '%refresh%')
), t AS (
  SELECT a, replace(CASE WHEN regexp_matches(tag, '(?is)^<link\b.*[\s"''/]rel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*[\s"''/]http-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*["'']?[^"''>]*?url\s*=\s*[''"]?([^"''\s>]+)', 1) END, '&amp;', '&') AS t FROM tags
), parts AS (
  SELECT a, t, regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1) AS site, regexp_extract(t, '(?s)^[^?#]*') AS place, {_PATH.format(u="a")} AS path,
    coalesce(nullif(regexp_replace({_PATH.format(u="a")}, '[^/]*$', ''), ''), '/') AS directory FROM t WHERE t <> ''
), wholes AS (
  SELECT *, CASE WHEN place = '' THEN path WHEN place LIKE '/%' THEN place ELSE directory || place END AS whole FROM parts
), steps AS (
  SELECT *, CASE WHEN NOT regexp_matches(whole, '(?:^|/)\.\.?(?:/|$)') THEN whole
    ELSE list_reduce(string_split(regexp_replace(whole, '^/', ''), '/'), lambda done, x: CASE x WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || x END, '')
      || CASE WHEN regexp_matches(whole, '(?:^|/)\.\.?$') THEN '/' ELSE '' END END AS tidy FROM wholes
), targets AS (
  SELECT a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t END
    WHEN t LIKE '//%' THEN regexp_extract(a, '(?s)^(.*?:)//', 1) || t WHEN t NOT LIKE '#%' THEN site || tidy || substr(t, length(place) + 1) END AS u FROM steps
), usual AS (
  SELECT node AS a, regexp_replace(regexp_extract(node, '(?s)^(.*?://)', 1), '^http://$', 'https://') || regexp_replace(host, '^(?:www|m)\.|:(?:80|443)$', '', 'g')
    || regexp_replace(path, '(?:/index\.html|\.html|/)$', '') AS plain,
    array_to_string(list_filter(string_split(regexp_extract(node, '(?s)^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref)=')), '&') AS kept
  FROM p WHERE node IS NOT NULL
), e AS (
  SELECT a, {_NODE.format(u="u")} AS b FROM targets WHERE u LIKE '%://%'
  UNION SELECT a, plain || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END FROM usual
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT reach.a, n.b FROM reach JOIN both_ways n ON n.a = reach.b
), told AS (
  SELECT a, b, {_HOST.format(u="b")} AS host, {_PATH.format(u="b")} AS path FROM reach
), shared AS (SELECT a, min({_rule_sql("verdict", "host", "path")}) AS verdict FROM told GROUP BY a)
SELECT page_id, host, path, {_rule_sql("rule", "host", "path")} AS rule,
  coalesce({_rule_sql("verdict", "host", "path")}, shared.verdict, 'allow') AS verdict
FROM p LEFT JOIN shared ON shared.a = p.node
"""

_MIXING = rf"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), chr(0)) || ':' || coalesce(text, chr(0))), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    list_extract([5.0, 2.0, 1.0]::DOUBLE[], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS w FROM d GROUP BY source
), o AS (SELECT *, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
), g AS (
  SELECT source, source_size, least(cap, (SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap) * w)::DOUBLE AS target FROM l
), k AS (
  SELECT source, key, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size) / 2.0::DOUBLE AS middle FROM d GROUP BY source, key
), p AS (
  SELECT g.*, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g
)
SELECT d.doc_id, d.size, p.source_size, p.target,
  CAST(d.size * (whole + CASE WHEN target - whole * source_size > 0 AND k.middle <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": _TOPK, "op4_sharding": _SHARDING, "op5_repetition": _REPETITION, "op8_urlfilter": _URLFILTER, "op10_mixing": _MIXING}
