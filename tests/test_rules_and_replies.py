import json

import pytest
from pyspark.sql import functions as F

from veilspark import rules_cli
from veilspark.operators import classify as C
from veilspark.operators import jsonargs as J
from veilspark.operators import rules as R
from veilspark.operators import stopwords as W
from veilspark.sources import io
from veilspark.sources import replies
from veilspark.streaming import reload

RULE = {"name": "kunde", "entity": "Kundenname", "type": "term", "value": "Nordwind", "examples": ["die Nordwind ruft"]}


def test_rules_command_line(tmp_path, capsys):
    rules = str(tmp_path / "rules.json")
    call = lambda *args: rules_cli.main(["--rules", rules, *args])
    assert call("add", "kunde", "--entity", "Kundenname", "--example", "die Nordwind ruft") == 2
    assert call("add", "kunde", "--entity", "Kundenname", "--term", "Nordwind", "--example", "Suedwind") == 1
    assert call("add", "kunde", "--entity", "Kundenname", "--term", "Nordwind", "--example", "die Nordwind ruft") == 0
    capsys.readouterr()
    assert call("list", "--json", "--own-only") == 0
    told = json.loads(capsys.readouterr().out)
    assert [r["entity"] for r in told["active"]] == ["CUSTOM_KUNDENNAME"] and "builtin" not in told
    assert call("test", "Die", "nordwind", "an", "Nordwind") == 0
    assert capsys.readouterr().out.splitlines()[-1] == "Die <CUSTOM_KUNDENNAME_0> an <CUSTOM_KUNDENNAME_1>"
    assert call("test", "nichts") == 1
    assert call("remove", "kunde") == 0 and call("remove", "kunde") == 1


def test_reasons_have_no_secret():
    assert R.safe_reason("kunde", "bad", "abc and ab", ["ab", "abc", ""]) == "rule 'kunde': bad ([…] and […])"
    assert R.safe_reason("kunde", "bad") == "rule 'kunde': bad"


def test_keyword_lists(spark, tmp_path, monkeypatch):
    own = {"tier3_special_categories": {"x": ["Zahnweh"]}, "tier2_context_words": ["geheim"], "tier2_patterns": {"n": "nr [0-9]+"}, "person_linking_entities": ["PERSON"], "person_indicators": ["Gast"]}
    path = tmp_path / "k.json"
    path.write_text(json.dumps(own), encoding="utf-8")
    words = io.keywords(path)
    rows = [("Gast hat Zahnweh", 3), ("Gast nr 7", 2), ("Herr Nord hat Krebs", 1)]
    got = C.classify(spark.createDataFrame([(t,) for t, _ in rows], "text string"), keywords=words).collect()
    assert [r["tier"] for r in got] == [t for _, t in rows]
    monkeypatch.setenv("SENSITIVITY_KEYWORDS_PATH", str(path))
    assert io.keywords() == words
    monkeypatch.delenv("SENSITIVITY_KEYWORDS_PATH")
    assert io.keywords() == C.Keywords()
    for bad in ("{", "[]", json.dumps(own | {"person_indicators": []}), json.dumps(own | {"tier2_context_words": "geheim"})):
        path.write_text(bad, encoding="utf-8")
        with pytest.raises(ValueError):
            io.keywords(path)
    with pytest.raises(ValueError):
        io.keywords(tmp_path / "none")


def test_calls_share_one_numbering(spark):
    rows = [(1, [("a 50667", '{"p": "50667", "q": "10115"}'), ("b", None)]), (2, None), (3, []), (4, [(None, '{"a": 1, "a": 2}')])]
    df = spark.createDataFrame(rows, "id int, calls array<struct<name:string,arguments:string>>")
    got = {r["id"]: r for r in J.mask_calls(df, ("DE_PLZ",)).collect()}
    assert [tuple(c) for c in got[1]["masked"]] == [("a <DE_PLZ_0>", '{"p": "<DE_PLZ_0>", "q": "<DE_PLZ_1>"}'), ("b", None)]
    assert got[1]["entity_types"] == [["DE_PLZ"], []]
    assert (got[2]["masked"], got[3]["masked"], got[4]["masked"]) == ([], [], []) and got[4]["json_status"] == "blocked:duplicate_key"
    gated = {r["id"]: (r["tier"], r["status"]) for r in J.gate_calls(df, ("DE_PLZ",)).collect()}
    assert gated == {1: (1, "ok"), 2: (1, "ok"), 3: (1, "ok"), 4: (1, "blocked")}


def test_a_person_found_by_type_raises_the_tier(spark):
    df = spark.createDataFrame([(1, [("f", '{"m": "a@b.de", "t": "Diagnose"}')])], "id int, calls array<struct<name:string,arguments:string>>")
    assert J.gate_calls(df, ("EMAIL_ADDRESS",)).first()["reason_code"] == "tier_3"


def test_stop_words(spark):
    rows = [("Bestellnummer", r"\A(?i:Bestellnummer)\z", "p", None), ("preis", r"\A(?i:preis)\z", "p", None), ("Menge", r"\A(?i:Menge)\z", "p", None), ("Artikelnummer", r"\A(?i:Artikelnummer\z", "p", None), ("Losnummer", r"\ALosnummer\z", None, "losnummer"), (None, None, None, None)]
    told = {r["term"]: set(r["faults"]) for r in W.lint(spark.createDataFrame(rows, "term string, pattern string, probe string, measured_span string")).collect()}
    assert told["Bestellnummer"] == set() and told["preis"] == {"bare_head"} and told["Menge"] == {"head", "hides"}
    assert told["Artikelnummer"] == {"shape", "misses"} and told["Losnummer"] == {"misses", "no_probe"}
    assert told[None] == {"head", "anchor", "shape", "misses", "no_probe"}
    spans = F.array(F.struct(F.lit("PERSON").alias("entity_type"), F.lit(0).alias("start"), F.lit(13).alias("end"), F.lit(0.5).alias("score")))
    df = spark.createDataFrame([("Bestellnummer",), ("Bestellnummer\nKraemer",)], "text string")
    assert [r[0] for r in df.select(F.size(W.allowed(spans, F.col("text"), [r"\A(?i:bestellnummer)\z"]))).collect()] == [0, 0]
    whole = F.transform(spans, lambda s: s.withField("end", F.length("text")))
    assert [r[0] for r in df.select(F.size(W.allowed(whole, F.col("text"), [r"\A(?i:bestellnummer)\z"]))).collect()] == [0, 1]


def test_replies(spark):
    raw = spark.createDataFrame([(1, None), (2, "x"), (3, '{"choices":[{"message":null,"delta":{"content":"a"}}]}')], "id int, raw string")
    assert [tuple(r) for r in replies.deltas(raw, ["id"]).collect()] == [(3, 0, "content", None, "a", None)]
    told = replies.reported_spans(raw).select("id", "report_error", "spans").collect()
    assert [tuple(r) for r in told] == [(1, "not_a_list", None), (2, "not_a_list", None), (3, "not_a_list", None)]
    with pytest.raises(Exception, match="report: not_a_list"):
        replies.require_reports(replies.reported_spans(raw)).collect()


def test_rules_reload_inside_a_stream(spark, tmp_path):
    rules = io.RuleFile(tmp_path / "rules.json")
    source, seen = tmp_path / "in", []
    source.mkdir()
    stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).json(str(source))

    def write(df, number):
        seen.extend((r["text"], len(r["rule_spans"])) for r in df.collect())

    run = lambda: reload.scan_stream(stream, rules, write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(90)
    (source / "a.json").write_text('{"text": "Nordwind 1"}\n')
    run()
    rules.add(RULE)
    (source / "b.json").write_text('{"text": "Nordwind 2"}\n')
    run()
    rules.path.write_text("{broken")
    (source / "c.json").write_text('{"text": "Nordwind 3"}\n')
    run()
    assert seen == [("Nordwind 1", 0), ("Nordwind 2", 1), ("Nordwind 3", 1)] and rules.error
