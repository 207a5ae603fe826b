"""The operators over their whole tables, as registered queries, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, hard_negatives, html_extract, imatch, jaccard_join, license_scan, nbsvm, packing, sharding, substring_dedup, toxicity, url_filter
from .common import read

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SHARDS = 24


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return nbsvm.score(docs, nbsvm.train(docs, read(spark, sf_dir, "labels")))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.shard(read(spark, sf_dir, "documents"), SHARDS)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.match(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality, op2_html_text, op3_toxicity, op4_decontamination, op5_shards, op6_url_filter, op7_license_scan, op8_packing, op9_jaccard_join, op10_imatch, op11_hard_negatives, op12_substring_dedup, op13_filter_audit, pipeline)}

ORACLES = {
    # longest rule first; a rule fits its host and every subdomain when the path starts with its path
    "op6_url_filter": """
        WITH parts AS (
            SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
        ), split AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
            FROM parts
        ), judged AS (
            SELECT page_id, host, path, CASE
                WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                END AS rule
            FROM split
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM judged
    """,
    # all anchors against all rows, positives and negatives by window
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
        ), p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        ), n AS (
            SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
    # windows of 35 words by doubling, their counts, and the words that no repeated window covers
    "op12_substring_dedup": """
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words FROM documents
        ), w AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM d
        ), w2 AS (SELECT doc_id, i, w, w || ' ' || lead(w, 1) OVER o AS b FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), w4 AS (SELECT *, b || ' ' || lead(b, 2) OVER o AS c FROM w2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), w8 AS (SELECT *, c || ' ' || lead(c, 4) OVER o AS e FROM w4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), w16 AS (SELECT *, e || ' ' || lead(e, 8) OVER o AS f FROM w8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), w35 AS (SELECT doc_id, i, w, f || ' ' || lead(f, 16) OVER o || ' ' || lead(b, 32) OVER o || ' ' || lead(w, 34) OVER o AS x FROM w16 WINDOW o AS (PARTITION BY doc_id ORDER BY i)
        ), r AS (SELECT doc_id, i, w, coalesce(count(x) OVER (PARTITION BY x) > 1, FALSE) AND x IS NOT NULL AS again FROM w35
        ), c AS (SELECT doc_id, i, w, coalesce(max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM r
        ), k AS (SELECT doc_id, count(*) AS n_words, count(CASE WHEN gone THEN 1 END) AS n_removed, coalesce(string_agg(CASE WHEN NOT gone THEN w END, ' ' ORDER BY i), '') AS kept FROM c GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    # every order is played step by step on the documents' own masks; the Shapley sum is the sum over all orders
    "op13_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
        ), w AS (SELECT *, list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words FROM d
        ), f AS (
            SELECT doc_id, part,
                   CAST(len(words) < 200 AS INTEGER) AS a, CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER) AS b,
                   CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS INTEGER) AS c,
                   CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) AS d, CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS INTEGER) AS e
            FROM w
        ), l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id
        ), m AS (
            SELECT part, [a, b, c, d, e] AS fails, a + b + c + d + e AS n_fails, count(*) AS n, count(CASE WHEN q = 1 THEN 1 END) AS good, count(CASE WHEN t = 1 THEN 1 END) AS toxic
            FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL
        ), x(i) AS (VALUES (1), (2), (3), (4), (5)
        ), o AS (
            SELECT [x1.i, x2.i, x3.i, x4.i, x5.i] AS p FROM x x1, x x2, x x3, x x4, x x5
            WHERE len(list_distinct([x1.i, x2.i, x3.i, x4.i, x5.i])) = 5
        ), t AS (SELECT p, array_to_string(list_transform(p, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, x.i AS step FROM o, x
        ), g AS (
            SELECT part, filter_order, step, p[step] AS own, n, n_fails, good, toxic, fails[p[step]] = 1 AS failed,
                   coalesce(list_max(list_transform(p[1:step - 1], lambda i: fails[i])), 0) = 1 AS gone
            FROM m, t
        ), r AS (
            SELECT part, filter_order, step, any_value(own) AS own, CAST(sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS BIGINT) AS kept,
                   CAST(sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN gone AND failed THEN n ELSE 0 END) AS BIGINT) AS redundant,
                   CAST(sum(CASE WHEN failed AND n_fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                   CAST(sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND failed THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
            FROM g GROUP BY part, filter_order, step
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
    """,
}
