"""The registered queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm.common import tuned


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weighted_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op2_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.pii import report

    return report(_table(spark, sf_dir, "documents"), everywhere=True)


def op4_url_character_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.url_filter import judge

    return judge(_table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.decontamination import decontaminate_report

    return decontaminate_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.suffix_dedup import report

    return report(_table(spark, sf_dir, "documents"))


def op7_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op8_toxicity_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.toxicity import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_weighted_tree_sharding, op2_hyperminhash_dedup, op3_pii_disclosure, op4_url_character_models, op5_benchmark_decontamination, op6_suffix_dedup, op7_html_tree_scoring, op8_toxicity_noisy_channel, op9_norm_bucket_topk, op10_sum_of_squares_packing, pipeline)}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    # first points of the four full regions, and the points of a fifth of which only those on its one shard count; crc32 by its byte table
    "op1_weighted_tree_sharding": """WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::bigint)) AS t),
 d AS (SELECT doc_id, coalesce(doc_id::varchar, 'null') AS k, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
 h AS (SELECT r, g, n, md5(k || '/g' || g || '/' || n) AS h FROM d, (SELECT g, 1 AS n FROM range(4) x(g) UNION ALL SELECT 4, n FROM range(1, 65) y(n)) z),
 m AS (SELECT r, g, n, -ln(('0x' || substr(h, 1, 12))::bigint / 281474976710656.0::double + 1 / 281474976710656.0::double) / 10 AS wait,
  10 * g + 5 * floor(('0x' || substr(h, 13, 8))::bigint / 4294967296.0::double * 2) + floor(('0x' || substr(h, 21, 8))::bigint / 4294967296.0::double * 5) AS s FROM h),
 w AS (SELECT r, s, sum(wait) OVER (PARTITION BY r, g ORDER BY n) AS t FROM m),
 p AS (SELECT r, arg_min(s, t) FILTER (s < 40) AS shard, arg_min(s, t) FILTER (s < 41) AS grown FROM w GROUP BY r),
 c AS (SELECT d.*, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM d, tab)
 SELECT doc_id, (strlen(text) + 16)::bigint AS size, crc::bigint AS text_crc32, 'key' AS law, shard::int AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k || '/' || (strlen(text) + 16) || '/' || crc), 1, 8))::bigint % 1024, doc_id, strlen(text), crc) - 1 AS slot, grown::int AS grown_shard FROM c JOIN p USING (r)""",
    "op2_hyperminhash_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x), m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
 SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op5_benchmark_decontamination": f"""WITH iw AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
 g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
 dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), ks AS (SELECT DISTINCT k FROM g),
 o AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks)),
 h AS (SELECT doc_id, k, i, item_id FROM o JOIN g USING (k, g)), c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS x FROM h) GROUP BY 1)
 SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
 FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
 m AS (SELECT s, min(doc_id) AS least FROM p GROUP BY 1), c AS (SELECT p.doc_id, i FROM p JOIN m USING (s) WHERE least < p.doc_id),
 f AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 50 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f), r AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY 1, 2),
 e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM r),
 k AS (SELECT e.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY 1)
 SELECT doc_id, (len(h) // 2)::bigint AS n_bytes, coalesce(removed, 0)::bigint AS n_removed, coalesce(spans, 0)::bigint AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op9_norm_bucket_topk": """WITH v AS (SELECT vec_id, list_transform(embedding::double[], lambda x: floor(1024 * x)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
 SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, v.e) DESC, v.vec_id))::int AS rank, v.vec_id, list_dot_product(q.e, v.e)::bigint AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10""",
}
