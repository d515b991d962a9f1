"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anemos.llm._common import shared_folder
from anemos.llm.decontaminate import contaminated
from anemos.llm.language import detect_language, fit_language
from anemos.llm.lines import dedup_lines
from anemos.llm.mixing import mix_sources
from anemos.llm.neardup_vectors import vector_groups
from anemos.llm.quality import fit_quality, score_quality
from anemos.llm.resample import importance
from anemos.llm.search import build_index, search
from anemos.llm.sharding import kd_shards
from anemos.llm.simhash import simhash_groups
from anemos.llm.suffix import remove_repeats
from anemos.llm.tokens import read_tokens, write_tokens
from anemos.llm.warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), length=200, keep="none", with_kept=False)


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = kd_shards(docs, shards=8, keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"), radius=4).select("doc_id", "fingerprint", "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = fit_language(docs.where(_remainder(4) != 2))
    found = detect_language(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(_table(spark, sf_dir, "pages"), folder)
    found = read_warc(spark, folder, payloads=False)
    return found.select(F.col("page_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast("long").alias("refers_to"), "complete")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(_remainder(5) != 0))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), similarity=0.8)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), k=10)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, longest=1, buckets=10_000, least_words=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = str(Path(__file__).resolve().parents[2])  # the script stands at the top of the repository
    if root not in sys.path:
        sys.path.append(root)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_embedding_dedup, op2_suffix, op3_kd_sharding, op4_simhash, op5_decontamination, op6_language, op7_mixing, op8_warc, op9_quality, op10_lines, op11_tokens, op12_search, op13_resample, pipeline)
}

#: The same block digests, quotas and order as the operator's.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 4))::BIGINT % 1024 AS b1,
    ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 5, 4))::BIGINT % 1024 AS b2
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w
  FROM d GROUP BY source),
fill AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size) / w AS ratio,
    (sum(source_size) OVER () - (sum(3 * source_size) OVER up_to - 3 * source_size))::DOUBLE / (sum(w) OVER down_from) AS level
  FROM src
  WINDOW up_to AS (ORDER BY (3 * source_size) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING),
    down_from AS (ORDER BY (3 * source_size) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
tgt AS (
  SELECT source, source_size, CASE WHEN lv < ratio THEN w * lv ELSE cap::DOUBLE END AS target
  FROM fill, (SELECT arg_min(level, ratio) AS lv FROM fill WHERE level <= ratio)),
s AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS full_
  FROM tgt),
rest AS (SELECT *, target - full_ * source_size AS rest FROM s),
sums AS (SELECT source, b1, b2, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
blk AS (
  SELECT source, b1, sum(words)::BIGINT AS words FROM sums GROUP BY ALL),
ranked AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(source, '') || '/' || b1::VARCHAR), b1 ROWS UNBOUNDED PRECEDING) AS cum
  FROM blk),
b0 AS (
  SELECT r.*, q.full_, q.rest, cum <= rest AS whole, NOT (cum <= rest) AND cum - words <= rest AS ends
  FROM ranked r JOIN rest q ON r.source IS NOT DISTINCT FROM q.source),
b1_ AS (
  SELECT *, rest - coalesce(sum(words) FILTER (whole) OVER (PARTITION BY source), 0) AS room FROM b0),
b2_ AS (
  SELECT *, NOT whole AND sum(words) OVER (PARTITION BY source, whole ORDER BY words, b1 ROWS UNBOUNDED PRECEDING) <= room AS fits FROM b1_),
b3_ AS (
  SELECT *, room - coalesce(sum(words) FILTER (fits) OVER (PARTITION BY source), 0) AS room2 FROM b2_),
subs AS (
  SELECT source, b1, b2 FROM (
    SELECT u.*, b.room2, sum(u.words) OVER (PARTITION BY u.source ORDER BY u.words, u.b2 ROWS UNBOUNDED PRECEDING) AS cum
    FROM sums u JOIN b3_ b ON u.source IS NOT DISTINCT FROM b.source AND u.b1 = b.b1 WHERE b.ends) WHERE cum <= room2)
SELECT d.doc_id, d.size, rest.source_size, rest.target,
  d.size * (b.full_ + CASE WHEN b.whole OR b.fits OR subs.b2 IS NOT NULL THEN 1 ELSE 0 END) AS taken
FROM d JOIN b3_ b ON d.source IS NOT DISTINCT FROM b.source AND d.b1 = b.b1
JOIN rest ON d.source IS NOT DISTINCT FROM rest.source
LEFT JOIN subs ON b.ends AND d.source IS NOT DISTINCT FROM subs.source AND d.b1 = subs.b1 AND d.b2 = subs.b2
"""

OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to, true AS complete
FROM f
"""

OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id)::BIGINT AS n_links, min(reach.b) AS component_id,
  e.vec_id = min(reach.b) AS kept
FROM embeddings e JOIN reach ON reach.a = e.vec_id GROUP BY e.vec_id
"""

OP12_SQL = r"""
WITH words AS (
  SELECT 'd' AS of, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM benchmark),
p AS (SELECT id, w, count(*) AS tf FROM words WHERE of = 'd' GROUP BY ALL),
len AS (SELECT id, sum(tf)::BIGINT AS n FROM p GROUP BY id),
tot AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM len),
m AS (SELECT id, 100 - 90 + (90 * n * big_n) // big_l AS m FROM len, tot),
wt AS (SELECT w, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, tot GROUP BY w, big_n),
s AS (
  SELECT q.id AS item_id, p.id AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM (SELECT DISTINCT id, w FROM words WHERE of = 'b') q JOIN p USING (w) JOIN wt USING (w) JOIN m ON m.id = p.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

#: The CRC-32 of each distinct word is worked out a byte at a time from a table made by its rule.
OP13_SQL = r"""
WITH RECURSIVE step AS (
  SELECT range AS i, range::UBIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
words AS (
  SELECT 'd' AS of, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
n AS (SELECT of, id, w, count(*) AS n FROM words GROUP BY ALL),
coded AS (
  SELECT w, xor(4294967295::UBIGINT, list_reduce(list_transform(range(0, octet_length(encode(w)) * 2, 2), lambda i: ('0x' || substr(hex(encode(w)), i + 1, 2))::UBIGINT),
    lambda a, b: xor(crc.tab[(xor(a, b) & 255)::BIGINT + 1], a >> 8), 4294967295::UBIGINT)) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM n), crc),
p AS (SELECT of, id, bucket, sum(n)::BIGINT AS n FROM n JOIN coded USING (w) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (of = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (of = 'b'), 0)::DOUBLE AS t FROM p GROUP BY bucket),
tot AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM b),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000))))::BIGINT AS gain FROM b, tot),
w AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS gained FROM p JOIN g USING (bucket) WHERE of = 'd' GROUP BY id),
s AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (gained - ((gained % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
    ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE AS h
  FROM documents LEFT JOIN w ON id = doc_id),
f AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM s),
r AS (SELECT *, count(*) FILTER (n_features >= 20) OVER () AS n, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM f)
SELECT doc_id, n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM r
"""

ORACLES: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op7_mixing": OP7_SQL, "op8_warc": OP8_SQL, "op12_search": OP12_SQL, "op13_resample": OP13_SQL}
