"""The queries of the operators of this package and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_text, jaccard, licenses, line_dedup, media, mixing, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op1_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS u,
    coalesce(CASE WHEN length(text) > 0 THEN greatest(0.05::DOUBLE, 1 - 4.0::DOUBLE *
      (length(text) - length(translate(text, '#$%&*@<>{}[]|=_~^\+', '')))::DOUBLE / length(text)::DOUBLE) END, 0.05::DOUBLE) AS q
  FROM sized
), d AS (
  SELECT *, -ln((u + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / q AS k FROM keyed
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 3 AS cap,
    sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, cap::DOUBLE / w::DOUBLE AS r,
    (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM w
), g AS (
  SELECT source, source_size, least(w * (SELECT arg_min(lev, r) FROM l WHERE r >= lev), cap::DOUBLE) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g
), b AS (
  SELECT source, k, u, sum(size) AS gs, count(*) AS n FROM d WHERE size > 0 GROUP BY source, k, u
), c AS (
  SELECT *, coalesce(sum(gs) OVER (PARTITION BY source ORDER BY k, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b
), f AS (
  SELECT c.source, c.k, c.u, greatest(0, least(n, floor((target - epochs * source_size - before)::DOUBLE * n / gs + 0.5::DOUBLE))) AS fit
  FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source, k, u) AS i FROM d
)
SELECT r.doc_id, r.size, p.source_size, p.target, (r.size * (p.epochs + coalesce(r.i <= f.fit, false)::BIGINT))::BIGINT AS taken
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source
LEFT JOIN f ON r.source IS NOT DISTINCT FROM f.source AND r.k = f.k AND r.u = f.u
"""


@_query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


ORACLES["op4_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id
), k AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM k WHERE rank <= 10
"""


@_query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.read_archive(spark, warc.write_archive(_table(spark, sf_dir, "pages")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op7_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS owner FROM p
)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM d
"""


#: The rank file that op8_bpe and the pipeline encode with.
RANKS = "byte_bpe_50k.tiktoken"


@_query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@_query
def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(_table(spark, sf_dir, "documents"))


@_query
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.lines_of(_table(spark, sf_dir, "documents"))


@_query
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


@_query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


_NOTICES = ", ".join("('" + name.replace("'", "''") + "', '" + text.replace("'", "''") + "')" for name, text in sorted(licenses.NOTICES.items()))
_SHINGLES = "list_transform(range(0, greatest(len(w) - 4, 0)::BIGINT), lambda i: array_to_string(w[i + 1:i + 5], ' '))"

ORACLES["op2_licenses"] = rf"""
WITH texts(license, text) AS (VALUES {_NOTICES}
), tw AS (
  SELECT license, list_filter(string_split(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM texts
), t AS (
  SELECT license, own, len(own)::BIGINT AS n FROM (SELECT license, list_distinct({_SHINGLES}) AS own FROM tw) x WHERE len(own) > 0
), ts AS (
  SELECT license, n, unnest(own) AS s FROM t
), dw AS (
  SELECT doc_id, list_filter(string_split(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents
), ds AS (
  SELECT doc_id, unnest({_SHINGLES}) AS s, unnest(range(0, greatest(len(w) - 4, 0)::BIGINT)) AS i FROM dw
), hits AS (
  SELECT doc_id, license, n, i, ds.s FROM ds JOIN ts USING (s)
), win AS (
  SELECT DISTINCT doc_id, license, n, k FROM (SELECT doc_id, license, n, unnest([i // n, i // n - 1]) AS k FROM hits) x WHERE k >= 0
), c AS (
  SELECT win.doc_id, win.license, win.k, count(DISTINCT h.s)::DOUBLE / win.n::DOUBLE AS containment, min(h.i) AS first
  FROM win JOIN hits h ON h.doc_id = win.doc_id AND h.license = win.license AND h.i >= (win.k - 1) * win.n AND h.i < (win.k + 3) * win.n
  GROUP BY win.doc_id, win.license, win.k, win.n
)
SELECT doc_id, license, max(containment) AS containment, min(first)::INTEGER AS first_shingle FROM c WHERE containment >= 0.8 GROUP BY doc_id, license
UNION ALL
SELECT dw.doc_id, tw.license, 1.0::DOUBLE, min(i)::INTEGER FROM dw, tw, unnest(range(0, greatest(len(dw.w) - len(tw.w) + 1, 0)::BIGINT)) g(i)
WHERE len(tw.w) BETWEEN 1 AND 4 AND dw.w[i + 1:i + len(tw.w)] = tw.w GROUP BY dw.doc_id, tw.license
"""
