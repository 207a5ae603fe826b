import hashlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import filter_audit, hard_negatives, substring_dedup
from veilspark.llm.fm_index import FMIndex, repeated

VECTORS = "vec_id long, embedding array<float>, label int, place string, id string"
DOCS = "doc_id long, text string, lang string, h1 string, copies int"


def mined(rows, anchors, n_pos=5, n_neg=3):
    """The contract, row by row."""
    use = []
    for k, (i, v, label, *_) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        use.append((k, i, label, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]))
    out = []
    for k, i, label, v in use:
        if not anchors(i):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))  # noqa: B023, E731
        others = sorted((-score(w), j, lab == label) for _, j, lab, w in use if j != i)
        for s, j, _ in [x for x in others if x[2]][:n_pos]:
            fits = [x for x in others if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_neg]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return Counter(out)


def vectors(n=150, dim=5):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 4, dim) / 16], int(i) % 3, "a", "b") for i in range(n)]
    rows += [(1000, None, 1, "", ""), (1005, [1.0] * dim, None, "", ""), (1010, [1.0, None, 1.0], 1, "", ""), (1015, [1.0, float("nan")], 1, "", ""), (1020, [float("inf")] * dim, 1, "", ""), (None, [1.0] * dim, 1, "", "")]
    rows += [(1025, [], 1, "", ""), (1030, [3.0], 2, "", ""), (10, rows[10][1], 1, "", ""), (11, rows[11][1], 0, "", "")]  # short ones, and ids that occur twice
    return rows


def results(df):
    return Counter(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("group_bytes", [1 << 20, 2000])
def test_hard_negatives_match_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", group_bytes)
    rows = vectors()
    got = results(hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 5 == 0))
    assert got == mined(rows, lambda i: i % 5 == 0)


def test_hard_negatives_of_empty_tables_and_of_large_numbers(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, F.col("vec_id") % 5 == 0).count() == 0
    big = [(i, [float(1 << 17) * (i + 1), 3.0 * i], i % 2, "", "") for i in range(9)]
    assert results(hard_negatives.mine(spark.createDataFrame(big, VECTORS), F.lit(True))) == mined(big, lambda i: True)
    with pytest.raises(OverflowError):
        hard_negatives.products(np.full((1, 1), 2.0**40), np.full((1, 1), 2.0**40))
    assert hard_negatives.products(np.full((1, 1), 2.0**30), np.full((1, 1), 2.0**30 + 1))[0, 0] == 2**60 + 2**30


def test_fm_index_counts_and_finds_repeated_windows():
    rng = np.random.default_rng(0)
    for _ in range(40):
        window = int(rng.integers(2, 6))
        parts = [rng.integers(1, 4, int(rng.integers(1, 14))) for _ in range(int(rng.integers(1, 9)))]
        index = FMIndex(np.concatenate([x for s in parts for x in (s, [0])]), 4)
        lengths = np.array([len(s) for s in parts])
        first, last = repeated(index, np.concatenate(parts), np.cumsum(lengths) - lengths, lengths, window)
        seen = Counter(tuple(s[i : i + window]) for s in parts for i in range(len(s) - window + 1))
        for k, s in enumerate(parts):
            again = [i for i in range(len(s) - window + 1) if seen[tuple(s[i : i + window])] > 1]
            assert (first[k], last[k]) == ((again[0], again[-1]) if again else (-1, -1))
        assert index.occurrences(np.array([1, 2])) == sum(1 for s in parts for i in range(len(s) - 1) if tuple(s[i : i + 2]) == (1, 2))


def deduped(rows, window):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, *_), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus():
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    passage = word(40)
    texts = []
    for k in range(60):  # the same passage in other surroundings: its edges share their keys
        texts.append(" ".join(word(int(rng.integers(0, 40))) + passage[: int(rng.integers(10, 41))] + word(int(rng.integers(0, 40)))))
    for k in range(12):  # near copies
        own = texts[k].split()
        own[len(own) // 2] = f"edit{k}"
        texts.append("\t".join(own))
    texts += [texts[0], texts[0], texts[1], "", None, " \n ", "x " * 3000, "x " * 12, "x " * 11, "ab " * 500 + "Ä ö", "A b c d e f g h i j k l m", "a b c d e f g h i j k l m", "A b c d e f g h i j k l M"]
    texts += [" ".join(word(20000)), "one two three " * 15]
    rows = [(k, t, "en", "clash", 7) for k, t in enumerate(texts)]
    return rows + [(3, texts[3], "en", "", 1), (None, texts[5], "en", "", 1), (None, "short", "en", "", 1)]


@pytest.mark.parametrize(("hot", "shard"), [(2048, 1 << 18), (1, 500)])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    monkeypatch.setattr(substring_dedup.found_segments, "__defaults__", (hot,))
    rows = corpus()
    got = substring_dedup.digests(spark.createDataFrame(rows, DOCS).repartition(3), 12)
    assert Counter(tuple(r) for r in got.collect()) == deduped(rows, 12)


def test_substring_dedup_keeps_texts_and_spans(spark):
    line = " ".join(f"p{k}" for k in range(35))
    rows = [(1, "a b " + line + " c", "en", "", 1), (2, line + " d", "en", "", 1), (3, " ".join(line.split()[:34]), "en", "", 1)]
    got = {r["doc_id"]: (r["kept"], [(x["start"], x["end"]) for x in r["removed"]]) for r in substring_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: ("a b c", [(2, 37)]), 2: ("d", [(0, 35)]), 3: (rows[2][1], [])}
    assert substring_dedup.digests(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.by_text(spark.createDataFrame(rows, DOCS), 10)


def audited(rows, labels):
    masks = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        w = t.encode().split()
        fails = (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t),
            doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, *_ in rows),
        )
        q, tox = labels.get(doc_id, (None, None))
        masks.append((lang or "", fails, q == 1, tox == 1))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        shapley = Counter()
        for order in permutations(range(5)):
            alive = set(range(len(own)))
            for step, f in enumerate(order):
                failing = {k for k, m in enumerate(own) if m[1][f]}
                gone = alive & failing
                shapley[f] += len(gone)
                out[part, "".join("ABCDE"[x] for x in order), step + 1] = [len(alive - gone), len(gone), len(failing - alive), sum(1 for k in failing if sum(own[k][1]) == 1), sum(own[k][2] for k in gone), sum(own[k][3] for k in gone), f]
                alive -= gone
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return out


def test_filter_audit_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(70):
        n = int(rng.integers(0, 400))
        text = " ".join(rng.choice(["alpha", "Beta", "GAMMA", "delta#", "eps", "é z"] + [f"u{x}" for x in range(int(rng.integers(1, 300)))], n)) if n else ""
        rows.append((k, text, ["en", "de", None][k % 3], "x", k))
    rows += [(100, rows[4][1], "en", "", 0), (2, rows[7][1], "de", "", 0), (101, None, "en", "", 0), (None, rows[5][1], "fr", "", 0), (5, rows[5][1], "en", "", 0), (102, "\t\n\x0b\x0c\r " * 5, "", "", 0), (103, "w " * 20000, "en", "", 0), (103, "w " * 20000, "en", "", 0)]
    labels = {k: (k % 2, int(k % 5 == 0)) for k in range(0, 70, 3)}
    table = spark.createDataFrame([(i, q, t, "clash") for i, (q, t) in labels.items()] + [(3, 0, None, ""), (None, 1, 1, "")], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS.replace("h1", "A")), table).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == audited(rows, labels)
    assert len(got) == 600 * 4
    assert filter_audit.audit(spark.createDataFrame([], DOCS), table).count() == 0


def test_wrappers_and_bare_notices():
    from veilspark.llm import html_extract

    para = "The river rose in the night and the people of the valley moved their cattle to the higher ground before dawn came over the hills. "
    p = lambda n: f"<p>{para * n}</p>"
    text = lambda n: (para * n).strip()
    pages = {
        f"<body><form id=aspnetForm><div>{p(2)}{p(1)}</div></form></body>": [2, 1], f"<main><form>{p(2)}{p(1)}</form></main>": [2, 1], f"<body class='tags'><div class='tags'>{p(2)}{p(1)}{p(1)}</div></body>": [2, 1, 1],
        f"<article class='story'><div class='social-header'>{p(2)}{p(1)}</div></article>": [2, 1],
        f"<body><div>We use cookies on this site to improve your visit, accept</div><article>{p(2)}{p(2)}</article></body>": [2, 2], f"<body>{p(2)}{p(2)}<div>Copyright 2020 All rights reserved</div></body>": [2, 2],
        f"<body><form>{p(1)}</form><article>{p(2)}</article></body>": [2], f"<body><div class='footer'>{p(1)}</div></body>": [], f"<body><nav><a>one</a><a>two</a></nav>{p(3)}</body>": [3],
    }
    for page, kept in pages.items():
        assert html_extract.main_text(page) == " ".join(text(n) for n in kept)
    # without the shares and the notices' words the tree can't tell some of them
    names = [html_extract.FEATURES.index(f) for f in ("boiler", "boiler_name", "notice")]
    blind = html_extract.grow([tuple(0.0 if k in names else float(x) for k, x in enumerate(r[:-1])) + (r[-1],) for r in html_extract.EXAMPLES])
    assert sum(html_extract.main_text(page, blind) == " ".join(text(n) for n in kept) for page, kept in pages.items()) < len(pages)


def test_licences_in_many_wordings(spark):
    from veilspark.llm import license_scan

    known = {
        "Licensed under Apache 2.0": "apache-2.0", "This program is free software licensed under GPLv3.": "gpl-3.0", "BSD-3-Clause": "bsd", "This work is in the public domain": "public-domain", "Licensed under the MIT licence": "mit", "Code is MIT licensed.": "mit",
        "You can use it under the terms of the Mozilla Public License 2.0": "mpl-2.0",
    }
    other = ["Licensed under AGPLv3", "He studied at MIT and drove licensed taxis for Apache", "Licensed under the Foo License, version 3.", "Kommen Sie mit dem Auto, Lizenz nicht nötig, licence"]
    table = spark.createDataFrame([(k, t, "en", "", 0) for k, t in enumerate([*known, *other])], DOCS)
    got = {r["doc_id"]: r["family"] for r in license_scan.scan(table).collect()}
    assert [got.get(k) for k in range(len(known))] == list(known.values())
    assert all(got.get(len(known) + k, "unknown") == "unknown" for k in range(len(other)))
