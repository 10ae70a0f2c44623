"""The queries of this subpackage and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import dac, exact_dedup, importance, jaccard, langid, mixing, packing, quality, secret_scan, sharding, suffix_sort, warc, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "quality.*")


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets.*")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_date", "url")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(_documents(spark, sf_dir)).drop("ids")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.fit(docs.filter(~held_out))
    return langid.predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "language.*")


def shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.arrivals_compacted(_documents(spark, sf_dir))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_documents(spark, sf_dir))


def packing_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(_documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_sort.repeats(_documents(spark, sf_dir))
    removed = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resampled(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))  # null where a long cannot hold it


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing_sources,
        "op2_quality": quality_rules,
        "op3_secrets": secret_scans,
        "op4_exact_dedup": exact_duplicates,
        "op5_warc": arc_to_warc,
        "op6_token_files": token_files,
        "op7_language": language_id,
        "op8_sharding": shard_compaction,
        "op9_jaccard": jaccard_join,
        "op10_packing": packing_sequences,
        "op11_suffix_sort": suffix_array_dedup,
        "op12_resampling": target_resampling,
        "op13_whitening": embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": MIXING_SQL, "op4_exact_dedup": EXACT_SQL, "op5_warc": WARC_SQL, "op12_resampling": RESAMPLING_SQL}


MIXING_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'z') AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1' || coalesce(doc_id::VARCHAR, '')) AS mark
  FROM documents
), c AS (
  SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 3) AS class FROM d
), s AS (
  SELECT key, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM c GROUP BY key
), m AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS stops,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS wanted FROM s
), l AS (
  SELECT *, (wanted - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM m
  WINDOW w AS (ORDER BY stops, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT key, source_size, least(most, weight * max(level) OVER ()) AS target,
         ('0x' || substr(md5('mix-1' || key), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift FROM l
), g AS (
  SELECT c.*, source_size, target, row_number() OVER (PARTITION BY c.key ORDER BY size DESC, mark DESC, c.doc_id DESC) AS i
  FROM c JOIN t ON c.key = t.key WHERE size * 50 > source_size
), f AS (
  SELECT key, 0::BIGINT AS i, NULL::BIGINT AS doc_id, 0::BIGINT AS copies, target AS left_, source_size::DOUBLE AS rest FROM t
  UNION ALL
  SELECT key, i, doc_id, n, left_ - n * size, rest - size FROM (
    SELECT f.key, g.i, g.doc_id, f.left_, f.rest, g.size,
           least(2, greatest(0, CASE WHEN ceil((left_ - 2.0::DOUBLE * (rest - size)) / size) <= floor(left_ / size)
             THEN least(floor(left_ / size), greatest(ceil((left_ - 2.0::DOUBLE * (rest - size)) / size), floor(left_ / rest + 0.5::DOUBLE)))
             ELSE floor(left_ / size + 0.5::DOUBLE) END))::BIGINT AS n
    FROM f JOIN g ON g.key = f.key AND g.i = f.i + 1
  )
), e AS (
  SELECT t.*, x.left_, CASE WHEN x.rest > 0 THEN least(2.0::DOUBLE, greatest(0.0::DOUBLE, x.left_ / x.rest)) ELSE 0.0::DOUBLE END AS each
  FROM t JOIN (SELECT key, arg_max(left_, i) AS left_, arg_max(rest, i) AS rest FROM f GROUP BY key) x ON x.key = t.key
), r AS (
  SELECT c.doc_id, c.size, c.key, row_number() OVER (PARTITION BY c.key ORDER BY class, mark, c.doc_id) AS rank
  FROM c JOIN t ON c.key = t.key WHERE size * 50 <= source_size
), k AS (
  SELECT e.key, j, (j + shift) / 16.0::DOUBLE AS shifted, e.left_,
         sum((floor(each * rank + (j + shift) / 16.0::DOUBLE) - floor(each * (rank - 1) + (j + shift) / 16.0::DOUBLE))::BIGINT * size) AS words
  FROM r JOIN e ON r.key = e.key CROSS JOIN generate_series(0, 15) AS o(j) GROUP BY ALL
), b AS (
  SELECT key, shifted FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY abs(words - left_), j) = 1
), n AS (
  SELECT doc_id, size, r.key, (floor(each * rank + shifted) - floor(each * (rank - 1) + shifted))::BIGINT AS copies
  FROM r JOIN e ON r.key = e.key JOIN b ON b.key = r.key
  UNION ALL
  SELECT g.doc_id, size, g.key, copies FROM g JOIN f ON f.key = g.key AND f.i = g.i
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM n JOIN t ON n.key = t.key
"""

EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

WARC_SQL = r"""
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to,
       strftime(TIMESTAMP '1996-01-01' + to_seconds(page_id % 630720000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date, url
FROM f
"""

RESAMPLING_SQL = r"""
WITH c AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS crcs
  FROM (SELECT unnest(range(256)) AS i)
), d AS (
  SELECT doc_id, 'd' AS side, row_number() OVER () AS row, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL
  SELECT NULL, 'b', row_number() OVER (), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), w AS (
  SELECT side, row, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d
), n AS (
  SELECT side, row, word, count(*) AS n FROM w GROUP BY ALL
), x AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM n)
), b AS (
  SELECT word, xor(4294967295::BIGINT, list_reduce(
    [4294967295::BIGINT] || list_transform(range(len(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT),
    lambda c, y: xor(c >> 8, crcs[(xor(c, y) & 255) + 1]))) % 10000 AS bucket
  FROM x, c
), k AS (
  SELECT side, row, bucket, sum(n)::BIGINT AS n FROM n JOIN b ON n.word = b.word GROUP BY ALL
), s AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS t FROM k GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM s) + 10000)::DOUBLE)))::BIGINT AS gain FROM s
), m AS (
  SELECT row, sum(n)::BIGINT AS n_features, ((sum(n * gain) % sum(n) + sum(n)) % sum(n))::BIGINT AS rest, sum(n * gain)::BIGINT AS total
  FROM k JOIN g ON k.bucket = g.bucket WHERE side = 'd' GROUP BY row
), r AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - rest) // n_features, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM d LEFT JOIN m ON d.row = m.row WHERE side = 'd'
), o AS (
  SELECT *, weight + noise AS score, n_features >= 20 AS fits,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features, weight) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS all_fit
  FROM r
)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= all_fit * 10 // 100 THEN place END AS rank FROM o
"""
