"""The operators as registered queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, divergence, fingerprints, language, licenses, mixing, ngram_join, packing, passages, secrets, sentencepiece, suffix_array, topk
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir)).drop("rate")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.strip_repeats(documents(spark, sf_dir), kept=False)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.strip_passages(documents(spark, sf_dir), kept=False)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), carry=F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mixing, op2_sentencepiece, op3_secrets, op4_licenses, op5_ngram_join, op6_language, op7_fingerprints, op8_suffix_array, op9_passages, op10_topk, op11_packing, op12_divergence, op13_codes)}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    COALESCE(doc_id::VARCHAR, '#' || md5(COALESCE(text, ''))) AS key FROM documents
), s AS (
  SELECT source, SUM(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(cap) OVER b, 0))::DOUBLE / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, LEAST(weight * MAX(level) OVER (), cap::DOUBLE) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix|' || key), 1, 12))::BIGINT::DOUBLE / 281474976710656.0
    < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


#: All pairs of texts with a common run of words; groups by following links.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
c AS (SELECT a.doc_id AS p, b.doc_id AS q, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p, q, common = n AND common = m AS same FROM c WHERE 5 * common >= 4 * (n + m - common)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.q FROM r JOIN l ON l.p = r.b),
k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
e AS (SELECT p, count(*) AS n_links, count_if(same)::BIGINT AS copies, min(CASE WHEN same THEN q END) AS copy FROM l GROUP BY p)
SELECT d.doc_id, class_id, least(d.doc_id, COALESCE(copy, d.doc_id)) AS copy_id, 1 + COALESCE(copies, 0) AS n_copies, COALESCE(n_links, 0) AS n_links
FROM d JOIN k ON k.a = d.doc_id LEFT JOIN e ON e.p = d.doc_id
"""

#: Every string of 100 bytes, numbered by where it starts; runs of those that started before are islands.
OP8_SQL = r"""
WITH t AS (SELECT doc_id, encode(COALESCE(text, '')) AS x FROM documents),
g AS (SELECT doc_id, i, md5(x[i : i + 99]) AS k FROM (SELECT doc_id, x, unnest(range(1, octet_length(x) - 98)) AS i FROM t)),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
s AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
p AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY doc_id, island),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, count(*) AS spans, sum(b - a)::BIGINT AS n FROM p GROUP BY doc_id)
SELECT t.doc_id, octet_length(x) AS n_bytes, COALESCE(n, 0) AS n_removed, COALESCE(spans, 0) AS n_spans,
  sha256(CASE WHEN n IS NULL THEN x ELSE unhex(array_to_string(list_transform(range(0, spans + 1), lambda j:
    hex(x[CASE WHEN j = 0 THEN 1 ELSE b[j] END : CASE WHEN j = spans THEN octet_length(x) ELSE a[j + 1] - 1 END])), '')) END) AS kept_sha256
FROM t LEFT JOIN l ON l.doc_id = t.doc_id
"""

#: Every run of 50 words, in the same way.
OP9_SQL = r"""
WITH t AS (SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, md5_number(array_to_string(w[i : i + 49], ' ')) AS k, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t)),
f AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g JOIN f USING (k) WHERE doc_id > low),
s AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM r),
p AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS b FROM s GROUP BY doc_id, island),
x AS (SELECT doc_id, list(a) AS a, list(b) AS b, sum(b - a + 1)::BIGINT AS n FROM p GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, COALESCE(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda v, j: NOT list_bool_or(list_transform(a, lambda y, q: j >= y AND j <= b[q]))) END, ' ')) AS kept_sha256
FROM t LEFT JOIN x ON x.doc_id = t.doc_id
"""


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


#: Counts of each kept term in each group, zeros included; all sums in whole numbers.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
  regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v) AS p FROM a JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM a GROUP BY ALL) JOIN v USING (lang)),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, COALESCE(m.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) m
  ON m.lang = x.lang AND m.source = x.source AND m.item = y.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""


def _codes_sql(rounds: int = 4) -> str:
    """A chain of rounds: e are a codebook's entries by part and index, s the nearest of them."""
    near = """s{r} AS (SELECT row, vec_id, label, part, x, arg_min(j, (dist, j)) AS j, min(dist)::BIGINT AS dist FROM (
  SELECT p.*, e.j, list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM p JOIN e{r} e ON e.part = p.part)
  GROUP BY row, vec_id, label, part, x)"""
    mean = """e{n} AS (SELECT e.part, e.j, COALESCE(m.x, e.x) AS x FROM e{r} e LEFT JOIN (
  SELECT part, j, list(((t - ((t % c) + c) % c) // c)::BIGINT ORDER BY i) AS x
  FROM (SELECT part, j, i, sum(x[i]) AS t, count(*) AS c FROM (SELECT part, j, x, unnest(range(1, len(x) + 1)) AS i FROM s{r}) GROUP BY part, j, i) GROUP BY part, j) m
  ON m.part = e.part AND m.j = e.j)"""
    steps = [x for r in range(rounds) for x in (near.format(r=r), mean.format(r=r, n=r + 1))]
    return f"""
WITH w AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT row, vec_id, label, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS x FROM (SELECT *, unnest(range(0, 4)) AS part FROM w)),
e0 AS (SELECT part, row - 1 AS j, x FROM p WHERE row <= 256),
{", ".join([*steps, near.format(r=rounds)])},
c AS (SELECT row, vec_id, label, string_agg(printf('%02x', j), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM s{rounds} GROUP BY row, vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, j)) AS codebooks_sha256 FROM e{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op4_licenses": licenses.oracle(), "op5_ngram_join": OP5_SQL, "op8_suffix_array": OP8_SQL, "op9_passages": OP9_SQL, "op10_topk": OP10_SQL, "op12_divergence": OP12_SQL, "op13_codes": _codes_sql()}
