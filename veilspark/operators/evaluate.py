"""Benchmark of detections against a labelled corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Targets.
TARGETS = {"recall": 0.95, "precision": 0.90, "disturbance": 0.10, "pattern": 0.98, "PERSON": 0.90, "LOCATION": 0.85, "ORGANIZATION": 0.75}
MIN_SUPPORT = 3
THRESHOLD = 0.5


def ground_truth(cases: DataFrame) -> DataFrame:
    """Entities with offsets of their value's first occurrence, and how often it occurs."""
    e = cases.select("case_id", "text", F.posexplode("entities").alias("gt", "e"))
    value = F.col("e.value")
    times = (F.length("text") - F.length(F.replace(F.col("text"), value, F.lit("")))) / F.length(value)
    return e.select("case_id", "gt", F.col("e.type").alias("entity_type"), value.alias("value"), F.col("e.expected_recall").alias("expected"), (F.instr(F.col("text"), value) - 1).alias("start"), (F.instr(F.col("text"), value) - 1 + F.length(value)).alias("end"), times.cast("int").alias("occurrences"))


def candidates(truth: DataFrame, found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of equal type whose overlap reaches ``threshold`` of the shorter span."""
    t, f = truth.alias("t"), found.alias("f")
    on = (F.col("t.case_id") == F.col("f.case_id")) & (F.col("t.entity_type") == F.col("f.entity_type")) & (F.col("t.start") < F.col("f.end")) & (F.col("f.start") < F.col("t.end"))
    ratio = S.overlap_ratio(F.col("t.start"), F.col("t.end"), F.col("f.start"), F.col("f.end"))
    overlap = F.least(F.col("t.end"), F.col("f.end")) - F.greatest(F.col("t.start"), F.col("f.start"))
    return t.join(f, on).select(F.col("t.case_id").alias("case_id"), "gt", "pred", ratio.alias("ratio"), overlap.alias("overlap")).where(F.col("ratio") >= threshold)


def match(pairs: DataFrame) -> DataFrame:
    """One-to-one matches per case: best ratio, then longest overlap, then order.

    A case's pairs in that order are folded with the entities and findings
    used so far; a case of one pair needs no fold.
    """
    best = F.struct((-F.col("ratio")).alias("a"), (-F.col("overlap")).alias("b"), "gt", "pred", "ratio", "overlap")
    ordered = pairs.groupBy("case_id").agg(F.array_sort(F.collect_list(best)).alias("_p"))
    kept = F.aggregate(
        "_p", F.slice("_p", 1, 0), lambda out, x: F.when(F.exists(out, lambda o: (o["gt"] == x["gt"]) | (o["pred"] == x["pred"])), out).otherwise(F.concat(out, F.array(x)))
    )
    chosen = ordered.select("case_id", F.explode(F.when(F.size("_p") == 1, F.col("_p")).otherwise(kept)).alias("m"))
    return chosen.select("case_id", "m.gt", "m.pred", "m.ratio", "m.overlap").select(*pairs.columns)


def tallies(truth: DataFrame, found: DataFrame, matched: DataFrame, cases: DataFrame) -> DataFrame:
    """tp, fn, fp, support, recall and precision per type and overall (null type): must-detect entities only; false positives from cases without entities only."""
    must = truth.where("expected = 'must_detect'").join(matched.select("case_id", "gt", F.lit(1).alias("hit")), ["case_id", "gt"], "left")
    hits = must.select("entity_type", F.coalesce("hit", F.lit(0)).alias("tp"), (1 - F.coalesce("hit", F.lit(0))).alias("fn"), F.lit(0).alias("fp"))
    negative = cases.where(F.size("entities") == 0).select("case_id")
    false = found.join(negative, "case_id", "left_semi").select("entity_type", F.lit(0).alias("tp"), F.lit(0).alias("fn"), F.lit(1).alias("fp"))
    total = hits.unionByName(false).rollup("entity_type").agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp")))
    return total.select("entity_type", "tp", "fn", "fp", (F.col("tp") + F.col("fn")).alias("support"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"))


def disturbance(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Share of cases without entities that have a finding; null without such cases."""
    negative = cases.where(F.size("entities") == 0).select("case_id")
    hit = found.select("case_id").distinct().withColumn("hit", F.lit(1))
    return negative.join(hit, "case_id", "left").agg(F.count("*").alias("negatives"), F.coalesce(F.sum("hit"), F.lit(0)).alias("disturbed"), F.avg(F.coalesce("hit", F.lit(0))).alias("disturbance"))


def violations(metrics: DataFrame, disturbed: DataFrame | None = None) -> DataFrame:
    """Rows of ``tallies`` that miss a target; with ``disturbance``'s row also a missed disturbance target, and a run without cases that have no entities, which proves nothing."""
    overall = metrics.where("entity_type IS NULL")
    typed = metrics.where(F.col("entity_type").isNotNull() & (F.col("support") >= MIN_SUPPORT))
    goal = F.lit(TARGETS["pattern"])
    for name in ("PERSON", "LOCATION", "ORGANIZATION"):
        goal = F.when(F.col("entity_type") == name, TARGETS[name]).otherwise(goal)
    rows = [
        overall.where(F.col("recall") < TARGETS["recall"]).select(F.lit("recall").alias("target"), F.lit("all").alias("entity_type"), F.col("recall").alias("value")),
        overall.where(F.col("precision") < TARGETS["precision"]).select(F.lit("precision").alias("target"), F.lit("all").alias("entity_type"), F.col("precision").alias("value")),
        typed.where(F.col("recall") < goal).select(F.lit("recall").alias("target"), "entity_type", F.col("recall").alias("value")),
    ]
    if disturbed is not None:
        rows.append(disturbed.where(F.col("disturbance") > TARGETS["disturbance"]).select(F.lit("disturbance").alias("target"), F.lit("all").alias("entity_type"), F.col("disturbance").alias("value")))
        rows.append(disturbed.where(F.col("negatives") == 0).select(F.lit("negatives").alias("target"), F.lit("all").alias("entity_type"), F.lit(0.0).alias("value")))
    return reduce(DataFrame.unionByName, rows)


def exit_code(violated: DataFrame) -> int:
    """0 where every target is met, else 1."""
    return int(not violated.isEmpty())


def outside(truth: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    """(kind, entity_type, n): entities that are known gaps and found or not, values that occur more than once and so are ambiguous, and findings of cases with entities that match none."""
    gaps = truth.where("expected = 'known_gap'").join(matched.select("case_id", "gt", F.lit(1).alias("hit")), ["case_id", "gt"], "left")
    gaps = gaps.select(F.when(F.col("hit").isNull(), "gap_missed").otherwise("gap_found").alias("kind"), "entity_type")
    twice = truth.where("occurrences > 1").select(F.lit("ambiguous").alias("kind"), "entity_type")
    extra = found.join(truth.select("case_id").distinct(), "case_id", "left_semi").join(matched.select("case_id", "pred"), ["case_id", "pred"], "left_anti").select(F.lit("extra").alias("kind"), "entity_type")
    return gaps.unionByName(twice).unionByName(extra).groupBy("kind", "entity_type").agg(F.count("*").alias("n"))


def masked_before(cases: DataFrame, masked_col: str = "masked") -> DataFrame:
    """Cases (case_id, entities, masked) whose must-detect values still stand in the masked text: the precondition of a round trip."""
    left = F.filter("entities", lambda e: (e["expected_recall"] == "must_detect") & F.contains(F.col(masked_col), e["value"]))
    return cases.withColumn("left", F.size(left)).where("left > 0").select("case_id", "left")


def round_trip(df: DataFrame, original: str, masked: str, answer: str, restored: str) -> DataFrame:
    """``df`` with ``trip``: ok, or what broke: a placeholder that the answer lost or changed, or one that the restored text still has though it was given out."""
    shape = F.lit("<[A-Z][A-Z_]*_[0-9]+>")
    given = F.array_distinct(F.regexp_extract_all(F.col(masked), shape, F.lit(0)))
    own = F.regexp_extract_all(F.col(original), shape, F.lit(0))
    lost = F.size(F.array_except(given, F.regexp_extract_all(F.col(answer), shape, F.lit(0)))) > 0
    left = F.size(F.array_intersect(F.array_except(given, own), F.regexp_extract_all(F.col(restored), shape, F.lit(0)))) > 0
    return df.withColumn("trip", F.when(lost, "placeholder_lost").when(left, "placeholder_left").otherwise("ok"))
