"""Queries of replies, calls and stop words, with SQL over the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import jsonargs as J
from ..operators import request as RQ
from ..operators import rules as R
from ..operators import stopwords as W
from ..sources import replies as SR
from .catalog import query, table
from .protocol import _from_sql


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: tuple[str, ...], key: str):
    return F.get(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values)).cast("int"))


_REPORTS = (
    '[{"entity_type":"PERSON","start":1,"end":4,"score":0.5}]', '[{"type":"PERSON","start_index":2,"end_index":2}]', '[{"entityType":"LOCATION","startIndex":0,"endIndex":9,"confidence":1}]', '[]', '{"entity_type":"PERSON"}', '[7]', '[{"start":1,"end":2}]',
    '[{"entity_type":"","start":1,"end":2}]', '[{"entity_type":"A","start":"1","end":2}]', '[{"entity_type":"A","start":5,"end":2}]', '[{"entity_type":"A","start":1,"end":2},{"entity_type":"B","start":3,"end":8,"score":"high"}]', '[{"entity_type":null,"type":"A","start":1,"end":2}]', '[{"entity_type":"A","end":2.5,"start":1}]',
)


def _first_sql(names: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN list_contains(json_keys(x), '{n}') THEN json_extract(x, '$.{n}')" for n in names) + " END"


_REPORTS_SQL = f"""WITH r AS (SELECT s_suppkey AS id, {_listed(_REPORTS)}[1 + s_suppkey % {len(_REPORTS)}] AS raw FROM supplier), i AS (SELECT id, unnest(json_extract(raw, '$[*]')) AS x, unnest(range(len(json_extract(raw, '$[*]')))) AS k FROM r WHERE json_type(raw) = 'ARRAY'),
f AS (SELECT id, k, x, CASE WHEN json_type(x) = 'OBJECT' THEN {_first_sql(SR.TYPE_NAMES)} END AS t, CASE WHEN json_type(x) = 'OBJECT' THEN {_first_sql(SR.START_NAMES)} END AS a, CASE WHEN json_type(x) = 'OBJECT' THEN {_first_sql(SR.END_NAMES)} END AS b, CASE WHEN json_type(x) = 'OBJECT' THEN {_first_sql(SR.SCORE_NAMES)} END AS s FROM i),
e AS (SELECT *, CASE WHEN json_type(x) <> 'OBJECT' THEN 'not_an_object' WHEN coalesce(json_type(t), 'NULL') <> 'VARCHAR' OR t ->> '$' = '' THEN 'no_type' WHEN coalesce(json_type(a), 'NULL') NOT IN ('UBIGINT', 'BIGINT') OR coalesce(json_type(b), 'NULL') NOT IN ('UBIGINT', 'BIGINT') THEN 'no_offsets' WHEN CAST(b AS BIGINT) < CAST(a AS BIGINT) THEN 'end_before_start' END AS bad FROM f),
w AS (SELECT r.id, CASE WHEN json_type(raw) <> 'ARRAY' THEN 'not_a_list' ELSE min_by(bad, k) FILTER (bad IS NOT NULL) END AS report_error FROM r LEFT JOIN e ON e.id = r.id GROUP BY r.id, raw)
SELECT w.id, report_error, t ->> '$' AS entity_type, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", CASE WHEN json_type(s) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(s AS DOUBLE) END AS score
FROM w LEFT JOIN e ON e.id = w.id AND report_error IS NULL"""


@query(_REPORTS_SQL)
def detector_reports(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), _pick(_REPORTS, "s_suppkey").alias("raw"))
    told = SR.reported_spans(rows).select("id", "report_error", F.explode_outer("spans").alias("s"))
    return told.select("id", "report_error", F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.score").alias("score"))


_REPLIES = (
    '{"choices":[{"index":0,"message":{"content":"a <PERSON_0>","refusal":null},"finish_reason":"stop"}]}', '{"choices":[{"delta":{"content":"b"}},{"index":3,"delta":{"reasoning_content":"c","content":7}}]}', '{"choices":[{"delta":{},"finish_reason":"length"}]}',
    '{"choices":[{"message":{"tool_calls":[{"function":{"name":"f","arguments":"{}"}},{"index":5,"function":{"arguments":"[1]"}}]}}]}', '{"choices":[]}', '{"usage":1}', '[1]',
)
_REPLIES_SQL = f"""WITH r AS (SELECT s_suppkey AS id, {_listed(_REPLIES)}[1 + s_suppkey % {len(_REPLIES)}] AS raw FROM supplier),
c AS (SELECT id, unnest(json_extract(raw, '$.choices[*]')) AS c, unnest(range(len(json_extract(raw, '$.choices[*]')))) AS k FROM r WHERE json_type(raw) = 'OBJECT'),
m AS (SELECT id, CAST(coalesce(json_extract_string(c, '$.index'), CAST(k AS VARCHAR)) AS INTEGER) AS choice, coalesce(json_extract(c, '$.message'), json_extract(c, '$.delta')) AS m, json_extract_string(c, '$.finish_reason') AS finish_reason FROM c),
t AS (SELECT id, choice, ch AS channel, CAST(NULL AS INTEGER) AS call_index, json_extract_string(m, '$.' || ch) AS text, finish_reason FROM m, (VALUES ('content'), ('reasoning_content'), ('refusal')) AS v(ch) WHERE json_type(m, '$.' || ch) = 'VARCHAR'),
q AS (SELECT id, choice, finish_reason, unnest(json_extract(m, '$.tool_calls[*]')) AS x, unnest(range(len(json_extract(m, '$.tool_calls[*]')))) AS k FROM m),
u AS (SELECT id, choice, ch AS channel, CAST(coalesce(json_extract_string(x, '$.index'), CAST(k AS VARCHAR)) AS INTEGER) AS call_index, json_extract_string(x, '$.function.' || ch) AS text, finish_reason FROM q, (VALUES ('name'), ('arguments')) AS v(ch) WHERE json_type(x, '$.function.' || ch) = 'VARCHAR'),
a AS (SELECT * FROM t UNION ALL SELECT * FROM u)
SELECT * FROM a UNION ALL SELECT id, choice, NULL, NULL, NULL, finish_reason FROM m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = m.id AND a.choice = m.choice)"""


@query(_REPLIES_SQL)
def reply_deltas(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), _pick(_REPLIES, "s_suppkey").alias("raw"))
    return SR.deltas(rows, ["id"]).select("id", "choice", "channel", "call_index", "text", "finish_reason")


_TERMS = ("Bestellnummer", "Preis", "Menge", "Wartungsfenster", "Rechnungsdatum")
_MADE = (r"\A(?i:{t})\z", r"^{t}$", r"(?i)\A{t}\z", r"\A(?i:{t}|Mueller)\z", r"\A.*\z", r"\A{t}x\z")
_ENTRIES_SQL = f"(SELECT p_partkey AS id, {_listed(_TERMS)}[1 + p_partkey % {len(_TERMS)}] AS term, replace({_listed(_MADE)}[1 + p_partkey % {len(_MADE)}], '{{t}}', CASE WHEN p_partkey % {len(_MADE)} = 5 THEN CAST(p_partkey AS VARCHAR) ELSE {_listed(_TERMS)}[1 + p_partkey % {len(_TERMS)}] END) AS pattern, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Probe' END AS probe FROM part)"
_HEADS_SQL = " OR ".join(f"ends_with(term, '{h}')" for h in W.HEADS)
# in RE2 the absolute end is \z as well; a pattern that isn't judged matches nothing
_LINT_SQL = f"""WITH e AS (SELECT *, regexp_matches(pattern, '^\\\\A([\\p{{L}}\\p{{N}}_ -]+|\\(\\?(i|-i)?:[\\p{{L}}\\p{{N}}_ -]+(\\|[\\p{{L}}\\p{{N}}_ -]+)*\\))\\\\z$') AS fits FROM {_ENTRIES_SQL}), c AS (SELECT unnest({_listed(W.CONTROL_SPANS)}) AS s),
d AS (SELECT DISTINCT pattern FROM e WHERE fits), h AS (SELECT DISTINCT pattern FROM d, c WHERE regexp_matches(s, pattern))
SELECT id, array_to_string(list_filter([CASE WHEN NOT ({_HEADS_SQL}) THEN 'head' END, CASE WHEN lower(term) IN ({', '.join(repr(h) for h in W.HEADS)}) THEN 'bare_head' END, CASE WHEN regexp_matches(pattern, '[\\^$]') OR NOT contains(pattern, '\\A') OR NOT contains(pattern, '\\z') THEN 'anchor' END,
 CASE WHEN starts_with(pattern, '(?i)') OR starts_with(pattern, '(?-i)') THEN 'global_flag' END, CASE WHEN NOT fits THEN 'shape' END, CASE WHEN pattern IN (SELECT pattern FROM h) THEN 'hides' END, CASE WHEN NOT fits OR NOT regexp_matches(term, CASE WHEN fits THEN pattern ELSE 'x' END) THEN 'misses' END,
 CASE WHEN probe = '' THEN 'no_probe' END, CASE WHEN count(*) OVER (PARTITION BY pattern) > 1 THEN 'twice' END], lambda f: f IS NOT NULL), ',') AS faults FROM e"""


@query(_LINT_SQL)
def stop_word_lint(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _pick(_TERMS, "p_partkey").alias("term"), _pick(_MADE, "p_partkey").alias("made"))
    filled = F.when(F.col("id") % len(_MADE) == 5, F.col("id").cast("string")).otherwise(F.col("term"))
    entries = p.select("id", "term", F.replace(F.col("made"), F.lit("{t}"), filled).alias("pattern"), F.when(F.col("id") % 3 == 0, "").otherwise("Probe").alias("probe"), F.lit(None).cast("string").alias("measured_span"))
    return W.lint(entries).select("id", F.array_join("faults", ",").alias("faults"))


@query("SELECT c_custkey AS id, replace(replace('Muster ' || c_name || ' in ' || c_mktsegment || ' passt nicht', c_name, '[…]'), c_mktsegment, '[…]') AS reason FROM customer")
def reason_cleared(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    detail = F.concat(F.lit("Muster "), "c_name", F.lit(" in "), "c_mktsegment", F.lit(" passt nicht"))
    return c.select(F.col("c_custkey").alias("id"), S.cleared(detail, F.array("c_name", "c_mktsegment", F.lit(""), F.lit(None))).alias("reason"))


_CALLS_SQL = "(SELECT c_custkey AS id, 'suche_' || lpad(CAST(c_custkey % 3 AS VARCHAR), 5, '0') || ' ' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS name, '{\"wer\": \"' || CASE WHEN c_custkey % 2 = 0 THEN 'Herr Nord' ELSE 'Ort' END || '\", \"was\": \"' || CASE WHEN c_custkey % 3 = 0 THEN 'Diagnose' WHEN c_custkey % 3 = 1 THEN 'vertraulich' ELSE 'Wetter' END || '\", \"plz\": \"' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') || '\"}' AS arguments FROM customer)"


@query(
    f"""WITH t AS (SELECT *, CASE WHEN id % 2 = 1 OR id % 3 = 2 THEN 1 WHEN id % 3 = 0 THEN 3 ELSE 2 END AS tier FROM {_CALLS_SQL})
    SELECT id, CAST(tier AS INTEGER) AS tier, CASE WHEN tier = 1 THEN 'ok' ELSE 'blocked' END AS status, CASE tier WHEN 3 THEN 'tier_3' WHEN 2 THEN 'tier_2_not_approved' END AS reason_code,
    CASE WHEN tier = 1 THEN regexp_replace(name, ' [0-9]{{5}}$', ' <DE_PLZ_0>') END AS name, CASE WHEN tier = 1 THEN regexp_replace(arguments, '"[0-9]{{5}}"', '"<DE_PLZ_0>"') END AS arguments FROM t"""
)
def call_gate(spark, sf_dir):
    """Names and arguments of calls: one numbering, tiers on the whole raw arguments."""
    rows = _from_sql(spark, sf_dir, _CALLS_SQL, "customer").select("id", F.array(F.struct("name", "arguments")).alias("calls"))
    told = J.gate_calls(rows, ("DE_PLZ",))
    return told.select("id", "tier", "status", "reason_code", F.get("masked", F.lit(0))["name"].alias("name"), F.get("masked", F.lit(0))["arguments"].alias("arguments"))


@query("SELECT s_suppkey AS id, 'von <CUSTOM_LIEFERANT_0> an <CUSTOM_LIEFERANT_1>.' AS masked, 'ok' AS rule_status FROM supplier")
def rule_preview(spark, sf_dir):
    rule = R.build({"name": "lieferant", "entity": "Lieferant", "type": "regex", "value": r"Supplier#\d{9}", "examples": ["Supplier#000000001"]})
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("von "), "s_name", F.lit(" an Supplier#999999999.")).alias("text"))
    return R.preview(rows, [rule]).select("id", "masked", "rule_status")


_FIELDS_SQL = "(SELECT c_custkey AS request_id, 0 AS msg_idx, k AS field_idx, k = 0 AS content, CASE WHEN k = 0 THEN 'PLZ ' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') || ', weiblich, Beruf Notarin' ELSE 'PLZ ' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') END AS text FROM customer, (VALUES (0), (1)) AS v(k))"


@query(f"SELECT request_id, field_idx, regexp_replace(text, '[0-9]{{5}}', '<DE_PLZ_0>') AS masked, 'ok' AS status FROM {_FIELDS_SQL} WHERE field_idx = 1")
def mask_fields_beside_content(spark, sf_dir):
    """Quasi-identifiers beside the content are masked while those in it are generalised."""
    masked = RQ.mask_fields(_from_sql(spark, sf_dir, _FIELDS_SQL, "customer"), ("DE_PLZ", "DE_GENDER", "DE_BERUF"), content="content")
    return masked.where("field_idx = 1").select("request_id", "field_idx", "masked", "status")
