import json
import time

import pytest
from pyspark.sql import functions as F

from veilspark.operators import rules as R
from veilspark.operators import stopwords as W
from veilspark.operators import tree as T


def rule(**more):
    return {"name": "projekt", "entity": "Projektname", "value": "Nordwind", "examples": ["der Nordwind weht"]} | more


def test_a_rule_without_type_is_a_term_and_scores_may_be_text():
    made = R.build(rule())
    assert (made.kind, made.score) == ("term", R.SCORES["term"]) and R.build(rule(score="0.5")).score == 0.5 and R.build(rule(score=1)).score == 1.0
    for bad in (rule(type="x"), rule(type=None), rule(type=["term"]), rule(score="viel"), rule(score="nan"), rule(score=0), rule(score=None), rule(score=1.1)):
        with pytest.raises(R.RuleError):
            R.build(bad)


def test_a_text_that_takes_too_long_is_blocked_in_time():
    slow = R.Rule("a", "b", "regex", r"(?:x+x+)+y", 0.5).compiled()
    text = "x" * 4000
    begun = time.monotonic()
    assert R.scan_text([("T", slow, 0.5)], text, budget=0.2) is None
    took = time.monotonic() - begun
    assert took < 2  # without the budget it would run for years
    begun = time.monotonic()
    assert R.scan_text([("T", slow, 0.5)] * 20, text, budget=0.2) is None and time.monotonic() - begun < 2  # the rules share one budget
    assert R.scan_text([("T", R.Rule("a", "b", "term", "x", 0.5).compiled(), 0.5), ("U", slow, 0.5)], text, budget=0.2) is None  # never a part of the spans


def test_stop_words_against_names(spark):
    words = spark.createDataFrame([("preis",), ("preis",), ("menge",), ("Art",), (None,)], "term string")
    names = spark.createDataFrame([("Preis",), (" PREIS ",), ("art",), ("",), (None,), ("Preiss",)], "name string")
    assert {(r["term"], r["n"]) for r in W.conflicts(words, names).collect()} == {("preis", 2), ("Art", 1)}
    entries = spark.createDataFrame([("Preis", r"\A(?i:Preis)\z", "x", None)] * 2 + [(None, None, None, None)] * 2 + [("Betrag", r"\A(?i:Betrag)\z", "x", None)], "term string, pattern string, probe string, measured_span string")
    assert sorted("twice" in r["faults"] for r in W.lint(entries).collect()) == [False, True, True, True, True]


def test_approval_is_read_by_type(spark):
    given = [True, False, "true", " JA ", "1", 1, 1.0, None, "nein", [True], {"a": 1}]
    levels = [None, 1, "2", 3, "hoch", 2.5, True, 0, [1]]
    rows = [json.dumps({"metadata": {"sensitivity_approval": a}, "messages": []}) for a in given] + [json.dumps({"metadata": {"sensitivity_level": x}}) for x in levels] + ["{}"]
    approved, level = T.requested(F.col("v"))
    got = spark.createDataFrame(list(enumerate(rows)), "i int, raw string").withColumn("v", F.try_parse_json("raw")).select("i", approved.alias("a"), level.alias("l")).orderBy("i").collect()
    assert [r["a"] for r in got[: len(given)]] == [True, False, True, True, True, False, False, False, False, False, False]
    assert [r["l"] for r in got[len(given) :]] == [None, 1, 2, 3, 3, 3, 3, 3, 3, None]
