"""The operators of this package as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, jaccard, lines, quality, secrets, sentencepieces, topk, toxicity, warc
from . import pipeline as stages
from .common import model_file

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; see ``quality.quality``."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document; see ``decontaminate.decontaminate``."""
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives of all pages, written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the five best of every query; see ``topk.top_k``."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without the source's boilerplate lines, n_lines, n_dropped."""
    out, n_lines, n_dropped = lines.without_boilerplate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page; see ``html_text.extract``."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids, round_trip of every document; see ``sentencepieces.encode_texts``."""
    return sentencepieces.encode_texts(_table(spark, sf_dir, "documents"), model_file())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; see ``toxicity.toxicity``."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, copy_id, n_links of every document; see ``jaccard.jaccard_join``."""
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each candidate in every document: doc_id, start, end, kind, score, is_secret; see ``secrets.scan``."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``stages.run``: doc_id, n_chars, n_tokens, ids, round_trip."""
    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_decontaminate, op3_warc, op4_topk, op5_lines, op6_html, op7_sentencepiece, op8_toxicity, op9_jaccard, op10_secrets, pipeline)}


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = f"""
WITH items AS (SELECT item_id, w FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM items)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT len(g) AS n FROM grams),
windows AS (
  SELECT rid, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, n, i, item_id FROM windows JOIN grams USING (g)),
spots AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN spots USING (rid) LEFT JOIN found USING (rid)
"""

_BITS = "list_aggregate(list_transform(generate_series(1, 40), lambda i: lpad(bin(strpos('123456789abcdef', substr(h, CAST(i AS INT), 1))), 4, '0')), 'string_agg', '')"

_OP3 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h, n) AS first, row_number() OVER (PARTITION BY h, n ORDER BY page_id NULLS LAST) AS place, {_BITS} AS bits FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT) +
    4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT) +
    CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first END AS refers_to
FROM b
"""

_OP4 = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.own <> q.own AND len(d.e) = len(q.e))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_OP5 = f"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (
  SELECT rid, source, trim(line, ' ') AS k, line, i
  FROM (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM r)),
t AS (SELECT source, count(*) AS n FROM r WHERE text IS NOT NULL GROUP BY source),
bad AS (
  SELECT c.source, k FROM (SELECT source, k, count(DISTINCT rid) AS c FROM l WHERE k <> '' GROUP BY source, k) c
  JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE c >= {lines.MIN_PAGES} AND c > CAST({lines.RATIO} AS DOUBLE) * n),
m AS (SELECT rid, line, i, bad.k IS NOT NULL AS hit FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.k = bad.k),
g AS (
  SELECT rid, string_agg(CASE WHEN NOT hit THEN line END, chr(10) ORDER BY i) AS rest, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_dropped
  FROM m GROUP BY rid)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(rest, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM r LEFT JOIN g USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": _OP2, "op3_warc": _OP3, "op4_topk": _OP4, "op5_lines": _OP5}
