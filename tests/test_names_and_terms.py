import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import detect as D
from veilspark.operators import gazetteer as G
from veilspark.operators import jsonargs as J
from veilspark.operators import rules as R
from veilspark.operators import spans as P
from veilspark.operators import terms as TM


def found(spark, texts, entity):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = D.detect(df, entities=(entity,)).select("id", "text", F.explode(P.resolve(F.col("spans"))).alias("s")).collect()
    out = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r["id"], r["s"]["start"])):
        out[r["id"]].append(r["text"][r["s"]["start"] : r["s"]["end"]])
    return out


ADDRESSES = ["2001:db8::1", "fe80::1", "::1", "1::", "2001:db8:0:0:0:0:2:1", "::ffff:192.0.2.1", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:192.0.2.1", "fe80::1%eth0", "ABCD:EF01:2345:6789:ABCD:EF01:2345:6789"]
NO_ADDRESSES = ["::", "std::vector", "12:30:45", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::1", "a::b::c", "x::1y", "10:20", "1:2:3:4:5:6:7", "1.2.3.4.5", "256.1.1.1", "::ffff:300.0.2.1"]


def test_ipv6_grammar(spark):
    texts = [f"von {a}, dann" for a in ADDRESSES] + [f"von {a}." for a in ADDRESSES]
    assert found(spark, texts, "IP_ADDRESS") == [[a] for a in ADDRESSES] * 2
    assert found(spark, [f"von {a} dann" for a in NO_ADDRESSES], "IP_ADDRESS") == [[] for _ in NO_ADDRESSES]
    rng = random.Random(4)
    made = []
    for _ in range(300):  # random shapes against the standard library's parser
        parts = ["%x" % rng.randrange(1 << rng.choice([4, 8, 16])) for _ in range(rng.randrange(1, 10))]
        at = rng.randrange(0, len(parts) + 1)
        made.append(":".join(parts) if rng.random() < 0.3 else ":".join(parts[:at]) + "::" + ":".join(parts[at:]))
    ok = []
    for a in made:
        try:
            ipaddress.IPv6Address(a)
            ok.append([a])
        except ValueError:
            ok.append([])
    assert found(spark, [f"x {a} y" for a in made], "IP_ADDRESS") == ok


PHONES = ["+49 30 1234567", "030 1234567", "0049 (30) 1234567", "+1 212 555 0123", "+33 1 23 45 67 89", "+353 1 234 5678"]
NO_PHONES = ["12345678901234567890", "a0301234567", "+1 212 555", "+49 12345", "+0 123 456 789", "03012345678901234", "+33 1 23 45 67 8"]


def test_phone_numbering_plans(spark):
    assert found(spark, [f"Tel. {p}, bitte" for p in PHONES], "PHONE_NUMBER") == [[p] for p in PHONES]
    assert found(spark, [f"Nr. {p}, bitte" for p in NO_PHONES], "PHONE_NUMBER") == [[] for _ in NO_PHONES]
    masker = J.Masker(J.compiled(tuple(J.python_patterns(("PHONE_NUMBER", "IP_ADDRESS")))))  # the same inside arguments
    assert masker.arguments('{"a": "+49 30 1234567", "b": "fe80::1", "c": "12345678901234567890"}')[0] == '{"a": "<PHONE_NUMBER_0>", "b": "<IP_ADDRESS_0>", "c": "12345678901234567890"}'


def test_gazetteer_takes_the_longest_name(spark):
    names = [("New York", "LOCATION"), ("New York City", "LOCATION"), ("Müller", "PERSON"), ("York", "PERSON"), ("Groß-Gerau", "LOCATION"), ("  ", "PERSON"), (None, "PERSON"), ("New York", "ORG"), ("York", "PERSON")]
    texts = [(1, "In new  york, city und NEW YORK."), (2, "Frau Mueller aus gross gerau; Yorkshire"), (3, None), (4, ""), (5, "x " * 5000 + "York"), (None, "York"), (1, "York")]
    got = G.find_names(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(names, "name string, entity_type string"), "id")
    rows = sorted((r["id"] if r["id"] is not None else -1, r["start"], r["entity_type"], r["value"]) for r in got.collect())
    assert rows == [
        (-1, 0, "PERSON", "York"), (1, 0, "PERSON", "York"), (1, 3, "LOCATION", "new  york, city"), (1, 8, "PERSON", "york"), (1, 23, "LOCATION", "NEW YORK"), (1, 27, "PERSON", "YORK"),
        (2, 5, "PERSON", "Mueller"), (2, 17, "LOCATION", "gross gerau"), (5, 10000, "PERSON", "York"),
    ]
    assert all(r["value"] is not None and r["end"] - r["start"] == len(r["value"]) for r in got.collect())


def test_automaton_equals_rule_by_rule(spark):
    rng = random.Random(7)
    alphabet = ["a", "b", "A", "ä", "Ä", "ß", "ſ", "K", "-", " ", ".", "_", "1"]
    term = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5))).strip()
    rules = [R.Rule(f"r{k}", "Wort", "term", t, 0.9, k % 3 == 0) for k, t in enumerate(filter(None, (term() for _ in range(120))))]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    slow = [sorted((k, m.start(), m.end()) for k, r in enumerate(rules) for m in r.compiled().finditer(t) if m.end() > m.start()) for t in texts]
    auto = TM.Automaton(TM.term_rules(rules))
    for t, want in zip(texts, slow, strict=True):
        assert sorted(x[1:3] for x in auto.spans(t)) == sorted(x[1:] for x in want)
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    got = TM.scan_terms(df, TM.term_rules(rules)).collect()
    assert [[(s["start"], s["end"]) for s in r["term_spans"]] for r in got] == [[x[1:] for x in w] for w in slow] + [[]]


def test_ten_thousand_terms_in_groups(spark, monkeypatch):
    rules = [("CUSTOM_X", f"wort{k}", 0.9, False) for k in range(10_000)]
    df = spark.createDataFrame([(" ".join(f"Wort{k}" for k in range(0, 10_000, 7)) + " wort10000 xwort1",)], "text string")
    assert TM.scan_terms(df, rules).select(F.size("term_spans")).first()[0] == len(range(0, 10_000, 7))
    monkeypatch.setattr(TM, "GROUP_CHARS", 20_000)
    assert TM.scan_terms(df, rules).select(F.size("term_spans")).first()[0] == len(range(0, 10_000, 7))
    with pytest.raises(ValueError):
        TM.scan_terms(df, [("CUSTOM_X", "", 0.9, False)])
