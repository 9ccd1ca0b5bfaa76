"""The queries of these operators over their whole tables, and the SQL they are checked against."""

from __future__ import annotations

import importlib

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_exact_dedup", r"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""")
def op2(spark, folder):
    from knowhow.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, folder, "documents"))


@query("op6_mixing", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (  -- by the ratio at which a source is full
  SELECT *, 2.0::DOUBLE * source_size / w AS full_at,
         coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE AS taken,
         (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS free,
         (1.5::DOUBLE * sum(source_size) OVER ())::DOUBLE AS budget
  FROM s WINDOW before AS (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (  -- the first source that stays below what it could give
  SELECT (budget - taken) / free AS v FROM r WHERE (budget - taken) / free <= full_at ORDER BY full_at, source LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN w * v > 2.0 * source_size THEN 2.0::DOUBLE * source_size ELSE w * v END AS target,
         ('0x' || substr(md5(CASE WHEN source IS NULL THEN 'mix?' ELSE 'mix:' || source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM s, level),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       ((floor(n * rate + u) - floor((n - 1) * rate + u))::BIGINT * size)::BIGINT AS taken
FROM p""")
def op6(spark, folder):
    from knowhow.llm.mixing import mix_counts

    return mix_counts(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


@query("op7_sharding")
def op7(spark, folder):
    from knowhow.llm.sharding import shard_rows

    return shard_rows(table(spark, folder, "documents"))


@query("op3_near_dedup")
def op3(spark, folder):
    from knowhow.llm.near_dedup import near_groups

    return near_groups(table(spark, folder, "documents"))


@query("op10_paragraph_dedup")
def op10(spark, folder):
    from knowhow.llm.paragraph_dedup import repeated_paragraphs
    from knowhow.llm.passages import repeated_passages

    docs = table(spark, folder, "documents")
    lines = repeated_paragraphs(docs).withColumn("passage", F.lit(False))
    return lines.unionByName(repeated_passages(docs).withColumn("passage", F.lit(True)))


@query("op4_url_filter")
def op4(spark, folder):
    from knowhow.llm.url_filter import judge_urls, labelled_urls

    pages = table(spark, folder, "pages")
    return judge_urls(pages, labelled_urls(pages))


@query("op5_vp_search")
def op5(spark, folder):
    from knowhow.llm.vp_search import nearest

    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query("op8_preference_pairs")
def op8(spark, folder):
    from knowhow.llm.preference import preference_pairs, swapped_replies

    return preference_pairs(*swapped_replies(table(spark, folder, "conversations")))


@query("op1_quality")
def op1(spark, folder):
    from knowhow.llm.quality import quality_scores

    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_pieces")
def op9(spark, folder):
    from knowhow.llm.pieces import encode_documents

    return encode_documents(table(spark, folder, "documents"))


@query("op11_vector_codes", r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS g
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (  -- a row per vector and part, components as columns of a list
  SELECT vec_id, n, part, g[part * (len(g) // 16) + 1 : (part + 1) * (len(g) // 16)]::DOUBLE[] AS x FROM v, range(16) t(part)),
books AS (
  SELECT 0 AS round, part, n - 1 AS entry, x AS c FROM p WHERE n <= 64
  UNION ALL
  (WITH near AS (
     SELECT p.part, p.vec_id,
            min({'d': list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.c) + list_inner_product(b.c, b.c), 'e': b.entry}).e AS entry,
            any_value(p.x) AS x
     FROM p JOIN books b USING (part) WHERE b.round < 2 GROUP BY ALL),
   cells AS (
     SELECT part, entry, k, sum(x[k]::HUGEINT) AS total, count(*) AS many
     FROM near, range(1, 1000) t(k) WHERE k <= len(x) GROUP BY ALL),
   means AS (
     SELECT part, entry, list(((total - ((total % many) + many) % many) // many)::DOUBLE ORDER BY k) AS m FROM cells GROUP BY ALL)
   SELECT b.round + 1, b.part, b.entry, coalesce(m.m, b.c)
   FROM books b LEFT JOIN means m ON m.part = b.part AND m.entry = b.entry WHERE b.round < 2)),
last AS (SELECT * FROM books WHERE round = 2),
near AS (
  SELECT p.part, p.vec_id,
         min({'d': list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.c) + list_inner_product(b.c, b.c), 'e': b.entry}) AS best
  FROM p JOIN last b USING (part) GROUP BY ALL),
codes AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(s, ',' ORDER BY part, entry)) AS h
  FROM (SELECT part, entry, array_to_string(c::BIGINT[], ',') AS s FROM last))
SELECT v.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM codes JOIN v USING (vec_id), digest""")
def op11(spark, folder):
    from knowhow.llm.orchard_codes import vector_codes

    return vector_codes(table(spark, folder, "embeddings"))


@query("op12_byte_bpe")
def op12(spark, folder):
    from knowhow.llm.byte_bpe import decode_words, encode_words

    ids = F.array_join(F.transform("token_ids", lambda i: i.cast("string")), " ")
    done = decode_words(encode_words(table(spark, folder, "documents")))
    return done.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_centroids", r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE))::DOUBLE[] AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (
  SELECT 0 AS round, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, x AS c FROM v QUALIFY cluster < 40
  UNION ALL
  (WITH near AS (
     SELECT v.vec_id, min({'d': list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.c) + list_inner_product(c.c, c.c), 'e': c.cluster}).e AS cluster, any_value(v.x) AS x
     FROM v, c WHERE c.round < 5 GROUP BY v.vec_id),
   cells AS (SELECT cluster, k, sum(x[k]::HUGEINT) AS total, count(*) AS many FROM near, range(1, 65) t(k) GROUP BY ALL),
   means AS (SELECT cluster, list(((total - ((total % many) + many) % many) // many)::DOUBLE ORDER BY k) AS m FROM cells GROUP BY cluster)
   SELECT c.round + 1, c.cluster, coalesce(m.m, c.c) FROM c LEFT JOIN means m USING (cluster) WHERE c.round < 5)),
last AS (SELECT *, sha256(array_to_string(c::BIGINT[], ',')) AS h FROM c WHERE round = 5),
near AS (
  SELECT v.vec_id, min({'d': list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.c) + list_inner_product(c.c, c.c), 'e': c.cluster}) AS best
  FROM v, last c GROUP BY v.vec_id)
SELECT vec_id, best.e::INT AS cluster, best.d::BIGINT AS distance, sum(best.d) OVER (PARTITION BY best.e)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
FROM near JOIN last ON last.cluster = best.e""")
def op13(spark, folder):
    from knowhow.llm.centroids import clustered

    return clustered(table(spark, folder, "embeddings"))
