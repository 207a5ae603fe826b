"""Queries of names, term rules and addresses over whole tables, with SQL that computes from the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gazetteer as G
from ..operators import terms as TM
from ..session import spread
from .catalog import _spans_of, query, table

_FOLD = "replace(replace(replace(replace(lower({x}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
# every document names the customer, supplier and nation of its number after its own text
_NAMED = """(SELECT doc_id AS id, coalesce(text, '') || ' Treffen: ' || c_name || ' mit ' || s_name || ' in ' || lower(n_name) || '.' AS text FROM documents
    JOIN customer ON c_custkey = doc_id % (SELECT count(*) FROM customer) + 1 JOIN supplier ON s_suppkey = doc_id % (SELECT count(*) FROM supplier) + 1 JOIN nation ON n_nationkey = doc_id % 25)"""


@query(
    rf"""WITH t AS (SELECT id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+') AS w, string_split_regex(text, '[\p{{L}}\p{{N}}\p{{M}}_]+') AS g FROM {_NAMED}
    ), k AS (SELECT id, text, w, g, unnest(range(1, len(w) + 1)) AS k FROM t
    ), p AS (SELECT id, k, {_FOLD.format(x="w[k]")} AS word, length(w[k]) AS len, length(g[k]) AS gap FROM k
    ), o AS (SELECT id, k, word, len, sum(gap + coalesce(before, 0)) OVER (PARTITION BY id ORDER BY k) AS start FROM (SELECT *, lag(len) OVER (PARTITION BY id ORDER BY k) AS before FROM p)
    ), r AS (SELECT c_name AS name, 'PERSON' AS e FROM customer UNION ALL SELECT s_name, 'ORG' FROM supplier UNION ALL SELECT n_name, 'LOCATION' FROM nation
    ), n AS (SELECT DISTINCT regexp_extract_all({_FOLD.format(x="name")}, '[\p{{L}}\p{{N}}\p{{M}}_]+') AS ws, e FROM r
    ), m AS (SELECT o.id, o.k, o.start, len(ws) AS n, e FROM o JOIN n ON o.word = ws[1] LEFT JOIN o o2 ON len(ws) > 1 AND o2.id = o.id AND o2.k = o.k + 1 WHERE len(ws) = 1 OR (len(ws) = 2 AND o2.word = ws[2])
    ), b AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY n DESC, e) AS r FROM m
    ), z AS (SELECT b.id, b.e AS entity_type, CAST(b.start AS INTEGER) AS start, CAST(l.start + l.len AS INTEGER) AS "end" FROM b JOIN o l ON l.id = b.id AND l.k = b.k + b.n - 1 WHERE r = 1)
    SELECT z.id, entity_type, start, "end", substr(text, start + 1, "end" - start) AS value FROM z JOIN t ON t.id = z.id"""
)
def gazetteer_documents(spark, sf_dir):
    """Names of persons, organisations and places from three tables in whole documents, the longest at each word."""
    names = [table(spark, sf_dir, t).select(F.col(c).alias("name"), F.lit(e).alias("entity_type")) for t, c, e in (("customer", "c_name", "PERSON"), ("supplier", "s_name", "ORG"), ("nation", "n_name", "LOCATION"))]
    sql = _NAMED.strip()[1:-1].replace("FROM documents", "FROM {d}").replace("JOIN customer ON", "JOIN {c} ON").replace("JOIN supplier ON", "JOIN {s} ON").replace("JOIN nation ON", "JOIN {n} ON").replace("FROM customer)", "FROM {c})").replace("FROM supplier)", "FROM {s})")
    texts = spark.sql(sql, d=table(spark, sf_dir, "documents"), c=table(spark, sf_dir, "customer"), s=table(spark, sf_dir, "supplier"), n=table(spark, sf_dir, "nation"))
    return G.find_names(spread(texts), names[0].unionByName(names[1]).unionByName(names[2]), "id").select("id", "entity_type", "start", "end", "value")


# terms: the words of six letters or more in the benchmark, and the names of customers and parts' types
_TERMS = r"""(SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]{6,}')) AS w FROM benchmark) UNION SELECT DISTINCT lower(c_mktsegment) FROM customer UNION SELECT DISTINCT lower(regexp_extract(p_type, '[A-Za-z]{4,}')) FROM part WHERE p_type SIMILAR TO '.*[A-Za-z]{4,}.*')"""


@query(
    rf"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+') AS w, string_split_regex(text, '[\p{{L}}\p{{N}}\p{{M}}_]+') AS g FROM documents WHERE text IS NOT NULL
    ), k AS (SELECT id, unnest(w) AS w, unnest(g[1:len(w)]) AS g, unnest(range(1, len(w) + 1)) AS k FROM t
    ), o AS (SELECT id, w, sum(length(g) + coalesce(before, 0)) OVER (PARTITION BY id ORDER BY k) AS start FROM (SELECT *, lag(length(w)) OVER (PARTITION BY id ORDER BY k) AS before FROM k))
    SELECT id, CAST(start AS INTEGER) AS start, w AS value FROM o JOIN {_TERMS} ON lower(w) = term"""
)
def term_rules_documents(spark, sf_dir):
    """All terms in one pass over whole documents; the terms are a rule list, which the driver holds like a rule file."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{6,}"), F.lit(0))).alias("w"))
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("w"))
    types = table(spark, sf_dir, "part").select(F.regexp_extract("p_type", "[A-Za-z]{4,}", 0).alias("w")).where("w <> ''")
    terms = [r["w"] for r in words.unionByName(segments).unionByName(types).select(F.lower("w").alias("w")).distinct().orderBy("w").collect()]
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").where("text IS NOT NULL"))
    spans = TM.scan_terms(docs, [("CUSTOM_WORT", t, 0.9, False) for t in terms]).select("id", "text", F.explode("term_spans").alias("s"))
    return spans.select("id", F.col("s.start").alias("start"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


_HEX = "lower(hex(c_custkey))"
_ADDRESS = f"CASE c_custkey % 6 WHEN 0 THEN '2001:db8::' || {_HEX} WHEN 1 THEN 'fe80::' || {_HEX} || '%eth0' WHEN 2 THEN '::ffff:10.0.' || CAST(c_custkey % 256 AS VARCHAR) || '.1' WHEN 3 THEN '1:2:3:4:5:6:7:' || {_HEX} WHEN 4 THEN {_HEX} || '::' ELSE '12:30:' || CAST(c_custkey AS VARCHAR) END"


@query(f"SELECT c_custkey AS id, a AS value, 5 AS start, CAST(5 + length(a) AS INTEGER) AS \"end\" FROM (SELECT c_custkey, {_ADDRESS} AS a FROM customer WHERE c_custkey % 6 < 5 AND length({_HEX}) <= 4)")
def detect_ipv6(spark, sf_dir):
    """Compressed, mapped, zoned and full addresses; a time of day and groups that are too long are none."""
    c = table(spark, sf_dir, "customer").where(F.length(F.hex("c_custkey")) <= 4)
    made = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Host "), F.expr(_ADDRESS.replace("VARCHAR", "STRING")), F.lit(", dann 1:2:3.")).alias("text"))
    # an IPv4 address inside of one is no second address
    return _spans_of(made, "IP_ADDRESS", ("ipv6",))
