"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, embed_dedup, html_extract, lengths, maxscore, mixing, packing, runs, sharding, simhash, toxicity, warc
from .common import ship, table

ship(__name__)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_embedding_near_duplicates(spark, sf_dir):
    return embed_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


@query
def op3_source_mix(spark, sf_dir):
    odds = mixing.by_length(mixing.word_count())
    return mixing.mix(table(spark, sf_dir, "documents"), preference=odds).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_simhash_near_duplicates(spark, sf_dir):
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op7_token_lengths(spark, sf_dir):
    return lengths.length_table(table(spark, sf_dir, "documents"))


@query
def op8_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query
def op9_warc_revisits(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_html_main_text(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def stretched(doc_id: int, words: list[bytes]) -> list[bytes]:
    """Words of a tenth of the documents, from some word on replaced by a repeated stretch."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[: n - a]


@query
def op11_periodic_runs(spark, sf_dir):
    found = runs.find_runs(table(spark, sf_dir, "documents"), rewrite=stretched)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("best")
    return found.withColumn("best", runs.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


@query
def op12_tokenizer_alignment(spark, sf_dir):
    return align.align(table(spark, sf_dir, "documents")).withColumnRenamed("groups", "groups_sha256")


@query
def op13_exact_top_k(spark, sf_dir):
    return maxscore.top(table(spark, sf_dir, "embeddings"))


ORACLES["op2_embedding_near_duplicates"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a
), c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, least(v.vec_id, coalesce(low, v.vec_id)) AS component_id,
       v.vec_id <= coalesce(low, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""

ORACLES["op9_warc_revisits"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM m
"""

ORACLES["op13_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
