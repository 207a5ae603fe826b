"""Queries of the corpus benchmark that need more than one candidate a case, of round trips, and of stop words against tables of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import stopwords as W
from .catalog import ORACLES, query, table

# two entities at 0..10 and 8..18, two findings that move with the customer's number
_SHIFT = "CAST(c_custkey % 9 AS INTEGER)"
_PAIRS = f"""(SELECT id, gt, pred, least(te, fe) - greatest(ts, fs) AS overlap, (least(te, fe) - greatest(ts, fs)) / 10.0 AS ratio FROM
    (SELECT c_custkey AS id, gt, gt * 8 AS ts, gt * 8 + 10 AS te, pred, s + pred * 7 AS fs, s + pred * 7 + 10 AS fe FROM (SELECT c_custkey, {_SHIFT} AS s FROM customer), (VALUES (0), (1)) AS t(gt), (VALUES (0), (1)) AS p(pred)) WHERE least(te, fe) - greatest(ts, fs) >= 5)"""


@query(
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ratio DESC, overlap DESC, gt, pred) AS r FROM {_PAIRS}), f AS (SELECT * FROM c WHERE r = 1), g AS (SELECT c.* FROM c JOIN f ON f.id = c.id AND c.gt <> f.gt AND c.pred <> f.pred)
    SELECT id, CAST(gt AS INTEGER) AS gt, CAST(pred AS INTEGER) AS pred, CAST(overlap AS INTEGER) AS overlap FROM (SELECT * FROM f UNION ALL SELECT * FROM g)"""
)
def corpus_greedy_match(spark, sf_dir):
    """Two entities and two findings that all overlap: the best pair first, then what is left of both."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 9).cast("int").alias("s"))
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    truth = c.select("case_id", both.alias("gt")).select("case_id", "gt", F.lit("PERSON").alias("entity_type"), (F.col("gt") * 8).alias("start"), (F.col("gt") * 8 + 10).alias("end"))
    found = c.select("case_id", "s", both.alias("pred")).select("case_id", "pred", F.lit("PERSON").alias("entity_type"), (F.col("s") + F.col("pred") * 7).alias("start"), (F.col("s") + F.col("pred") * 7 + 10).alias("end"))
    return E.match(E.candidates(truth, found)).select(F.col("case_id").alias("id"), "gt", "pred", "overlap")


_OUT = "(SELECT c_custkey % 3 AS kind, 5 + c_custkey % 4 AS shift, c_custkey % 5 = 0 AS twice, c_custkey % 7 = 0 AS more FROM customer)"


@query(
    f"""SELECT kind, 'PERSON' AS entity_type, CAST(n AS BIGINT) AS n FROM (
        SELECT 'gap_found' AS kind, count(*) AS n FROM {_OUT} WHERE kind = 2 AND shift <= 5 UNION ALL SELECT 'gap_missed', count(*) FROM {_OUT} WHERE kind = 2 AND shift > 5 UNION ALL SELECT 'ambiguous', count(*) FROM {_OUT} WHERE kind > 0 AND twice
        UNION ALL SELECT 'extra', sum(CASE WHEN shift > 5 AND (kind = 1 OR shift < 7) THEN 1 ELSE 0 END + CASE WHEN more THEN 1 ELSE 0 END) FROM {_OUT} WHERE kind > 0)"""
)
def corpus_outside(spark, sf_dir):
    """What the scores leave out: known gaps found and missed, values that occur twice, findings beside the entities."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 3).alias("kind"), (5 + F.col("c_custkey") % 4).cast("int").alias("shift"), (F.col("c_custkey") % 5 == 0).alias("twice"), (F.col("c_custkey") % 7 == 0).alias("more"))
    person = F.lit("PERSON").alias("entity_type")
    truth = c.where("kind > 0").select("case_id", F.lit(0).alias("gt"), person, F.when(F.col("kind") == 2, "known_gap").otherwise("must_detect").alias("expected"), F.lit(10).alias("start"), F.lit(20).alias("end"), F.when(F.col("twice"), 2).otherwise(1).alias("occurrences"))
    found = c.where("kind < 2 or shift < 7").select("case_id", F.lit(0).alias("pred"), person, (10 + F.col("shift")).alias("start"), (20 + F.col("shift")).alias("end"))
    found = found.unionByName(c.where("more").select("case_id", F.lit(1).alias("pred"), person, F.lit(100).alias("start"), F.lit(110).alias("end")))
    return E.outside(truth, found, E.match(E.candidates(truth, found)))


_TRIP = """(SELECT c_custkey AS id, c_name AS value, 'von ' || c_name || ' <ORT_0>' AS original, 'von ' || CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE '<PERSON_0>' END || ' <ORT_0>' AS masked,
    CASE WHEN c_custkey % 3 = 0 THEN 'an <Person 0> <ORT_0>' ELSE 'an <PERSON_0> <ORT_0>' END AS answer, CASE WHEN c_custkey % 5 = 0 THEN 'an <PERSON_0> <ORT_0>' ELSE 'an ' || c_name || ' <ORT_0>' END AS restored FROM customer)"""


@query(
    f"""SELECT id, CASE WHEN contains(masked, '<PERSON_0>') AND NOT contains(answer, '<PERSON_0>') THEN 'placeholder_lost' WHEN contains(masked, '<PERSON_0>') AND contains(restored, '<PERSON_0>') THEN 'placeholder_left' ELSE 'ok' END AS trip,
    CAST(CASE WHEN contains(masked, value) THEN 1 ELSE 0 END AS INTEGER) AS unmasked FROM {_TRIP}"""
)
def round_trip_checks(spark, sf_dir):
    """Round trips that lose a placeholder or leave one, and cases whose value was never masked."""
    rows = spark.sql(_TRIP.strip()[1:-1].replace("FROM customer", "FROM {c}"), c=table(spark, sf_dir, "customer"))
    entity = F.array(F.struct(F.lit("PERSON").alias("type"), F.col("value"), F.lit("must_detect").alias("expected_recall")))
    bare = E.masked_before(rows.select(F.col("id").alias("case_id"), entity.alias("entities"), "masked"))
    trips = E.round_trip(rows, "original", "masked", "answer", "restored")
    return trips.join(bare.select(F.col("case_id").alias("id"), "left"), "id", "left").select("id", "trip", F.coalesce("left", F.lit(0)).alias("unmasked"))


# names of all tables; every twentieth part is named like a stop word or a profession
_LISTS = ", ".join(f"'{w}'" for w in (*D.STOP_WORDS, *D.PROFESSIONS))
_NAMES = f"(SELECT CASE WHEN p_partkey % 20 = 0 THEN ' ' || upper([{_LISTS}][CAST(1 + p_partkey % {len(D.STOP_WORDS) + len(D.PROFESSIONS)} AS INTEGER)]) ELSE p_name END AS name FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation)"


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest([{', '.join(repr(w) for w in D.STOP_WORDS)}]) AS term) JOIN {_NAMES} ON lower(trim(name)) = term GROUP BY term")
def stop_word_conflicts(spark, sf_dir):
    """Stop words that would hide a name of one of the tables."""
    words = F.array(*(F.lit(w) for w in (*D.STOP_WORDS, *D.PROFESSIONS)))
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(F.when(k % 20 == 0, F.concat(F.lit(" "), F.upper(F.get(words, (k % (len(D.STOP_WORDS) + len(D.PROFESSIONS))).cast("int"))))).otherwise(F.col("p_name")).alias("name"))
    names = parts.unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))).unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    return W.conflicts(spark.createDataFrame([(w,) for w in D.STOP_WORDS], "term string"), names)


def _has(words, x: str = "t") -> str:
    """SQL: whether a text has one of the words."""
    return rf"regexp_matches({x}, '(?i)(^|[^\p{{L}}\p{{N}}_])(" + "|".join(w.replace("'", "''") for w in words) + r")($|[^\p{L}\p{N}_])')"


_THREE = [_has(words) for words in C.TIER3.values()]
_TWO_WORD, _TWO = _has(C.TIER2_WORDS), " OR ".join(f"regexp_matches(t, '(?i){rx}')" for rx in C.TIER2_PATTERNS.values())
_SIGNALS = " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in (*_THREE, _TWO_WORD))
_TIER = f"CASE WHEN NOT {_has(C.PERSON_WORDS)} THEN 1 WHEN {' OR '.join(_THREE)} THEN 3 WHEN {_TWO_WORD} OR {_TWO} THEN 2 ELSE 1 END"

ORACLES["tier_conversations"] = f"SELECT role, CAST({_TIER} AS INTEGER) AS tier, count(*) AS n, CAST(sum({_SIGNALS}) AS BIGINT) AS n_signals FROM (SELECT role, coalesce(text, '') AS t FROM conversations) GROUP BY ALL"
# the turns hold nothing to mask; a turn that the tiers block blocks its conversation
ORACLES["mask_conversations"] = f"""WITH c AS (SELECT conv_id, turn, text, {_TIER} AS tier FROM (SELECT *, coalesce(text, '') AS t FROM conversations)), b AS (SELECT conv_id, min(CASE tier WHEN 3 THEN 'tier_3' WHEN 2 THEN 'tier_2_not_approved' END) AS why FROM c GROUP BY conv_id)
    SELECT c.conv_id AS request_id, turn AS msg_idx, CASE WHEN why IS NULL THEN text END AS masked, CAST(0 AS INTEGER) AS n_spans, CASE WHEN why IS NULL THEN 'ok' ELSE 'blocked' END AS status, why AS reason_code FROM c JOIN b ON b.conv_id = c.conv_id"""
