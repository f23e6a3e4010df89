"""The registered queries of this subpackage: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, divergence, language_id, line_quality, minhash_dedup, mixing, quality, sharding, substring_dedup, topk, toxicity, warc
from ._state import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo n (0 for null ids, which no label has)."""
    return F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(_remainder("doc_id", 5) != 0))
    found = language_id.predict(docs, model).withColumnRenamed("rid", "doc_id")
    return found.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    stats = written(quality.statistics(docs), "statistics")
    model = quality.fit(stats, labels.where(_remainder("doc_id", 5) != 0))
    found = quality.score(stats, model).withColumnRenamed("rid", "doc_id")
    return found.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


SHARD_BYTES = 16 << 20


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), SHARD_BYTES)
    return placed.select("doc_id", "shard", "shard_depth", "shard_bytes")


OP3_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS bits
  FROM documents),
bucket(d, p, bytes) AS (
  SELECT 0, 0::BIGINT, sum(bytes)::BIGINT FROM sized HAVING count(*) > 0
  UNION ALL
  SELECT s.d, s.p, s.bytes FROM (
    SELECT b.d + 1 AS d, x.bits >> (60 - b.d - 1) AS p, sum(x.bytes)::BIGINT AS bytes
    FROM bucket b JOIN sized x ON (x.bits >> (60 - b.d)) = b.p
    WHERE b.bytes > {SHARD_BYTES} AND b.d < 60 GROUP BY 1, 2) s)
SELECT x.doc_id, CASE WHEN b.d = 0 THEN '' ELSE lpad(bin(b.p), b.d, '0') END AS shard, b.d::INT AS shard_depth, b.bytes AS shard_bytes
FROM sized x JOIN bucket b ON b.bytes <= {SHARD_BYTES} AND (x.bits >> (60 - b.d)) = b.p
"""


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select(F.col("rid").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc.digests(warc.write(pages), pages)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("rid").alias("doc_id"), "item_id", "item_words", "matched_words", "coverage", F.size("tiles").alias("n_tiles"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    vectors = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("vector"))
    found = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.parse(_table(spark, sf_dir, "documents"), window=35)
    return found.select(F.col("rid").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "mix_order")


OP9_SQL = """
WITH sizes AS (SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source),
total AS (SELECT sum(pow(n, 0.5)) AS w, sum(n) AS n FROM sizes),
rate AS (SELECT s.source, pow(s.n, 0.5) / t.w * t.n / s.n AS r FROM sizes s, total t),
p AS (SELECT source, k, exp(-r + CASE WHEN k > 0 THEN k * ln(r) ELSE 0 END - lgamma(k + 1)) AS p
      FROM rate, range(0, 200) g(k) WHERE k <= ceil(r + 10 * sqrt(r) + 20)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
keyed AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, '~') || '|' || md5(coalesce(text, '~')) AS key FROM documents),
u AS (SELECT *, ('0x' || substr(md5('17|' || key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM keyed),
copies AS (SELECT u.doc_id, u.source, u.key, c.k AS copy FROM u JOIN cdf c ON u.source IS NOT DISTINCT FROM c.source AND c.c <= u.u)
SELECT doc_id, source, copy::INT AS copy,
       ('0x' || substr(md5('18|' || key || '|' || copy::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS mix_order
FROM copies
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_remainder("doc_id", 4) != 2))
    found = toxicity.score(docs, model).withColumnRenamed("rid", "doc_id")
    return found.select("doc_id", (_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(l.v), 0) AS v, any_value(l.n) AS n_lang FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN l USING (lang) GROUP BY ALL),
gn AS (SELECT g.*, coalesce((SELECT sum(c.n) FROM c JOIN k USING (lang, term) WHERE c.lang = g.lang AND c.source = g.source), 0) AS n_group FROM g),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
        (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.n_group + 2 * gn.v)::HUGEINT)::BIGINT AS p,
        (1 + (1000000000::HUGEINT * (k.total + 2)) // (gn.n_lang + 2 * gn.v)::HUGEINT)::BIGINT AS q
      FROM gn JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
WHERE part = 'pair' OR rank <= 10
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality.judge(_table(spark, sf_dir, "documents"))
    return found.select(F.col("rid").alias("doc_id"), *line_quality.BASE, "removed_words", "base_failed", "kept")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, list_slice(ws, i, i + 7) AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1) GROUP BY r),
ln AS (SELECT r, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         array_to_string(list_transform(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '0' ELSE x END), ' ') AS plain
       FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE words > 0 GROUP BY r),
f AS (SELECT host, plain FROM ln JOIN (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY host) USING (host) WHERE plain <> '' GROUP BY host, plain
      HAVING count(DISTINCT text) > 10 AND count(DISTINCT text) > any_value(host_docs) * 0.0001),
gone AS (SELECT r, sum(words) AS removed_words FROM ln JOIN f USING (host, plain) GROUP BY r),
b AS (SELECT d.doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= n_words * 0.3 AS kept FROM b
"""


OP13_DIMS, OP13_K, OP13_ROUNDS = 64, 40, 5


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    vectors = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    found = centroids.cluster(vectors, OP13_K, OP13_ROUNDS, "2", dims=OP13_DIMS)
    return found.select(F.col("rid").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op13_sql() -> str:
    """The rounds as a chain of table expressions: a<i> assigns to the centroids c<i>, c<i + 1> are their means."""
    steps = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {OP13_DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT c - 1 AS c, x FROM (SELECT x, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), x) AS c FROM v) WHERE c <= {OP13_K})"""]
    for i in range(OP13_ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, min(s)[2] AS c, min(s)[1] AS d FROM (SELECT v.r, [list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c.c] AS s FROM v, c{i} c) GROUP BY r)""")
        if i < OP13_ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN (SELECT c, list(m ORDER BY j) AS x FROM (
  SELECT a.c, j, floor(sum(v.x[j + 1]) / count(*)::DOUBLE)::BIGINT AS m FROM a{i} a JOIN v USING (r), range({OP13_DIMS}) t(j) GROUP BY a.c, j) GROUP BY c) m USING (c))""")
    last = OP13_ROUNDS
    return f"""WITH {', '.join(steps)}
SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM v JOIN a{last} a USING (r) JOIN c{last} c ON c.c = a.c"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_extendible_sharding": op3_extendible_sharding,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_warc": op5_warc,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_exact_topk": op7_exact_topk,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_poisson_mixing": op9_poisson_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_quality_rules": op12_quality_rules,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE_SQL: dict[str, str] = {
    "op3_extendible_sharding": OP3_SQL,
    "op7_exact_topk": OP7_SQL,
    "op9_poisson_mixing": OP9_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_quality_rules": OP12_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
