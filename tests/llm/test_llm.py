import zlib

import numpy as np
import pyarrow as pa
import pytest

from veilspark.llm import bpe, decontaminate, html_extract, imatch, jaccard_join, kernel, license_scan, nbsvm, packing, sharding, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string"
TEXTS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."), (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa."), (3, None), (4, ""), (5, "one two"), (6, "one two"), (7, "x " * 3000), (None, "one two")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_words_match_a_plain_split():
    texts = ["Ab  c\tÄÖ d", "", None, " x ", "y" * 5, "\x0b\x0cz"]
    col = pa.array(texts)
    got = []
    for w in kernel.words(col):
        got += [[w.data[a:b].tobytes() for a, b in zip(w.starts[w.offsets[i] : w.offsets[i + 1]], w.ends[w.offsets[i] : w.offsets[i + 1]])] for i in range(len(w.counts))]
    lower = lambda t: t.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    assert got == [lower(t or "").split() for t in texts]


def test_join_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(40):
        base = [vocab[i] for i in rng.integers(0, 60, 30)]
        for c in range(4):
            own = list(base)
            for p in rng.integers(0, 30, c):
                own[p] = "edit"
            rows.append((len(rows), " ".join(own), "en"))
    line = "a very common line that many documents share in this table"
    rows += [(1000 + k, line + " " + " ".join(f"u{k}_{i}" for i in range(5)), "en") for k in range(80)]
    rows += [(2000 + k, rows[k][1], "en") for k in range(0, 20, 3)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA), 4, 70, 100).collect()}
    sets = {i: {tuple(t.lower().split()[j : j + 4]) for j in range(max(1, len(t.split()) - 3))} for i, t, _ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, linked = sorted(sets), dict.fromkeys(sets, 0)
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= 70 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
                    linked[a], linked[b] = linked[a] + 1, linked[b] + 1
    assert got == {i: (len(sets[i]), find(i), linked[i]) for i in ids}


def test_many_near_copies_of_one_text(spark):
    """More copies than a block holds, each with an edit of its own; some are too far from most others."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(2500):
        own = list(base)
        for p in rng.integers(0, 80, 1 + (k % 3)):
            own[p] = f"edit{k % 40}"
        rows.append((k, " ".join(own), "en"))
    got = jaccard_join.join(spark.createDataFrame(rows, SCHEMA).repartition(4), 4, 85, 100).toPandas().set_index("doc_id").sort_index()
    sets = [{tuple(t.split()[j : j + 4]) for j in range(77)} for _, t, _ in rows]
    shingles = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(shingles)), dtype=np.float32)
    for k, own in enumerate(sets):
        m[k, [shingles[g] for g in own]] = 1
    both, n = (m @ m.T).astype(int), np.array([len(x) for x in sets])
    ok = 185 * both >= 85 * (n[:, None] + n[None, :])
    assert (got["n_links"].to_numpy() == ok.sum(1) - 1).all()
    label = np.arange(len(rows))
    while True:
        least = np.where(ok, label[None, :], len(rows)).min(1)
        if (least == label).all():
            break
        label = least
    assert (got["component_id"].to_numpy() == label).all()


def test_join_edges(docs, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()}
    assert {(1, 6, 1, 1), (2, 6, 1, 1), (3, 0, 3, 0), (4, 0, 4, 0), (5, 1, 5, 1), (6, 1, 5, 1), (None, 1, None, 0)} <= got
    assert jaccard_join.join(empty).count() == 0


def test_tree_drops_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 300, replace=False) if k % 3 else base[:300], rng.integers(0, 1 << 62, k % 7).astype(np.uint64)])) for k in range(120)]
    ids, zero = np.arange(120), np.zeros(120, dtype=np.int8)
    found = set()
    for a, b, _ in jaccard_join.group_pairs(np.array([len(s) for s in sets]), [jaccard_join.bitmap(s) for s in sets], ids, zero, ids, 85, 100):
        found |= {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in found


def test_pieces_are_the_library_s(tokenizer):
    enc = bpe.PieceEncoder(tokenizer)
    texts = ["it's  a test'll go\n\n x's 's\n's", "don't 'tis ''s !!'s 12's", "\t\ta  \n", " ", "日本 x's", None, "<|endoftext|>", "a\u0085b c \x1c d é"]
    assert [x.tolist() for x in enc.encode(pa.array(texts))] == [enc.model.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_round_trip(docs, empty, tokenizer):
    rows = packing.pack(docs.where("doc_id is not null"), tokenizer).collect()
    enc = bpe.PieceEncoder(tokenizer)
    for i, text in TEXTS:
        if i is None:
            continue
        ids = np.append(next(iter(enc.encode(pa.array([text])))), np.uint32(0))
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].astype("<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(empty, tokenizer).count() == 0


def test_packer_wastes_little():
    rng = np.random.default_rng(3)
    p, used, windows = packing.Packer(1024, 0), 0, set()
    for n in rng.integers(1, 900, 3000).tolist():
        pieces = p.put(n)
        assert sum(x[1] for x in pieces) == n
        used += n
        windows |= {x[2] for x in pieces}
    assert used / (len(windows) * 1024) > 0.98 and len(p.open) <= packing.OPEN


def test_shards(docs, empty, spark):
    rows = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i} " + "y" * (i % 50), "en") for i in range(3000)], SCHEMA)
    got = sharding.shard(rows, 8).toPandas()
    assert len(got) == 3000
    total = got.groupby("shard")["size"].sum()
    assert total.max() < 1.15 * total.mean() and len(total) == 8
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    small = sharding.shard(docs, 3).collect()
    assert len(small) == len(TEXTS) and {r["size"] for r in small if r["doc_id"] in (3, 4)} == {8}
    assert sharding.shard(empty, 3).count() == 0


def test_urls(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "com", "/de/")]
    urls = ["http://A.example.org/es/1?x", "https://example.org/en/12", "https://b.org/en", "http://x.com/de/", "http://x.com/de", "http://notexample.org", None, "mailto:x", "http://example.org/en/2#/es/"]
    got = url_filter.filter_urls(spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id int, url string, host string"), rules).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("b.org", "/en", "org/", "allow"), ("x.com", "/de/", "com/de/", "block"),
        ("x.com", "/de", None, "allow"), ("notexample.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.org", "/en/2", "org/", "allow"),
    ]


def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy now this thing today</div><article><h1>Head</h1><p>Some <b>bo</b>ld &amp; text,\n more words here.<p>Second one <div class=comments><p>I disagree with you</p></div></article><aside>Side</aside><footer>&copy; us</footer><p"
    assert html_extract.main_text(page) == "Head Some bold & text, more words here. Second one"
    rows = html_extract.extract(spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, "")], "page_id int, url string, html string")).orderBy("page_id").collect()
    assert [r["n_chars"] for r in rows] == [len(html_extract.main_text(page)), 0, 0]


def test_names_that_only_sound_like_boilerplate():
    text = "The article has some words here and a few more of them"
    for opening in ("<div class='post comments-open'>", "<article class='side-effects'>", "<article><section id='legal-history'>", "<div class='searching-for-truth'>"):
        assert html_extract.main_text(f"<body><nav><a href=x>Home</a></nav>{opening}<p>{text}</p></div></body>") == text
    for opening in ("<div class='site-footer'>", "<div id='ad-slot-2'>", "<div class='comment-list'>", "<article class='comment'>", "<div role='navigation'>"):
        assert html_extract.main_text(f"<body><article><p>{text}</p></article>{opening}<p>Not this one at all</p></div></body>") == text


def test_html_edges(spark):
    rows = spark.createDataFrame([(1, "u", "<p>x y z", "clash"), (1, "u", "<p>x y z", "clash"), (2, None, "<p>" + "word " * 60_000, None)], "page_id int, url string, html string, text string")
    got = html_extract.extract(rows).orderBy("page_id").collect()
    assert [r["n_chars"] for r in got] == [5, 5, 299_999] and got[0]["text"] == "x y z"
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_benchmark_passages(spark, docs, empty):
    item = "the quick brown fox jumps over the lazy dog while seven wizards watch the red moon rise above the quiet sea tonight"
    near = item.replace("lazy", "lazy")
    rows = spark.createDataFrame([(1, "start " + item + " end", "en"), (2, "nothing of it here", "en"), (3, item.upper() + "!", "en"), (4, None, "en"), (5, "x " * 40 + near.replace("red", "RED") + " y", "en")], SCHEMA)
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"], r["first_word"]) for r in decontaminate.find(rows, bench).collect()}
    assert got == {(1, 7, 1), (3, 7, 0), (5, 7, 40)}
    left = {r["doc_id"]: r["text"] for r in decontaminate.clean(rows, bench).collect()}
    assert left == {1: "start end", 2: "nothing of it here", 4: None, 5: ("x " * 40).strip() + " y"}
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_near_passages_beyond_the_radius_are_found():
    rng = np.random.default_rng(7)
    words = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in rng.integers(15, 60, 300)]
    items = decontaminate.Items(list(range(300)), [" ".join(w) for w in words])
    beyond = 0
    for i, own in enumerate(words):
        for cut in range(1, 8):
            # the last words are others; similarity 0.80 to 0.85 is the edge
            text = " ".join(own[:-cut] + [f"other{i}_{k}" for k in range(cut)])
            column = pa.array([text])
            w = next(iter(kernel.words(column, decontaminate.LETTERS)))
            s = items.similarity(w.hashes, i)
            if 0.8 <= s <= 0.85:
                found = [(f[0], f[1]) for _, _, x in decontaminate._document_findings(column, items, 0.8) for f in x]
                assert (i, 0) in found
                beyond += (decontaminate.simhash(w.hashes) ^ items.index[len(own)][1].prints[items.index[len(own)][0].index(i)]).bit_count() > decontaminate.RADIUS
    assert beyond


def test_hamming_index_is_complete():
    rng = np.random.default_rng(4)
    prints = [int(x) for x in rng.integers(0, 1 << 62, 200)]
    index = decontaminate.HammingIndex(prints, 12)
    for p in prints[:50]:
        q = p
        for b in rng.choice(64, 12, replace=False).tolist():
            q ^= 1 << b
        assert index.within(q) == [i for i, x in enumerate(prints) if (x ^ q).bit_count() <= 12]


def test_nearest_is_exact():
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(300, rng.integers(3, 40), replace=False)) for _ in range(700)]
    counts = toxicity.Sparse(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), rng.integers(1, 5, sum(len(r) for r in rows)))
    weight = rng.random(300) ** 3 + 0.01
    vectors = toxicity.unit(counts, weight)
    dense = np.zeros((700, 300))
    dense[vectors.rows(), vectors.cols] = vectors.values
    for head in (0, 20, 300):
        index = toxicity.BlockMaxIndex(vectors, 300, 16, head)
        for q in range(0, 700, 23):
            got, entries = index.nearest(*vectors.row(q), 7)
            plain = np.round(dense @ dense[q], 9)
            want = np.lexsort((np.arange(700), -plain))[:7]
            assert np.allclose(got, plain[want], atol=1e-8) and (np.abs(plain[entries] - got) < 1e-8).all()


def test_toxicity_matches_brute_force(spark):
    """Scores of the whole operator against dense cosines of all examples."""
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(500):
        own = [vocab[j] for j in rng.integers(0, 200, 25)] + (["scum", "idiot"][: 1 + i % 2] if i % 7 == 0 else [])
        rows.append((i, " ".join(own), "en"))
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(500)], "doc_id long, toxic int")
    judge = toxicity.train(table, labels)
    index = judge.index
    dense = np.zeros((index.size, len(judge.terms)))
    dense[index.vectors.rows(), index.vectors.cols] = index.vectors.values
    words = {}
    for w in kernel.words(pa.array([" ".join(sorted({x for _, t, _ in rows for x in t.split()}))]), toxicity.LETTERS):
        words = {w.data[a:b].tobytes().decode(): h for a, b, h in zip(w.starts, w.ends, w.hashes, strict=True)}
    df = {x: sum(x in t.split() for _, t, _ in rows) for x in words}
    got = {r["doc_id"]: r for r in toxicity.score(table, judge).collect()}
    for i, text, _ in rows[::5]:
        q = np.zeros(len(judge.terms))
        for x in set(text.split()):
            at = np.searchsorted(judge.terms, words[x])
            if at < len(judge.terms) and judge.terms[at] == words[x]:
                q[at] = (1 + np.log(text.split().count(x))) * judge.weight[at]
        cosines = np.round(dense @ (q / np.sqrt((q * q).sum())), 9)
        best = np.lexsort((np.arange(len(cosines)), -cosines))[: judge.k]
        close = 1 / (0.05 + 1 - cosines[best])
        vote = (close * judge.votes[best, 1]).sum() / (close[:, None] * judge.votes[best]).sum()
        assert abs(got[i]["score"] - 1 / (1 + np.exp(-(judge.slope * vote + judge.shift)))) < 1e-6
        assert abs(got[i]["cosine"] - cosines.max()) < 1e-8
    assert max(df.values()) == toxicity.document_frequencies(table, judge.terms)[0].max()


def test_classifiers(spark, docs, empty):
    rows = [(i, ("BUY!! NOW!! CHEAP!! " * 5 if i % 4 == 0 else f"a plain sentence number {i} about the weather and the sea. " * 3) + ("idiot scum" if i % 5 == 0 else ""), "en") for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    for module, label in ((nbsvm, "quality"), (toxicity, "toxic")):
        model = module.train(table, labels)
        got = module.score(table, model).join(labels, "doc_id").toPandas()
        held = got[got["held_out"]]
        assert len(held) and (held["predicted"] == held[label]).mean() > 0.95
        edges = module.score(docs, model).toPandas()
        assert len(edges) == len(TEXTS) and edges["score"].between(0, 1).all()
        assert module.score(empty, model).count() == 0
        none = module.train(table, labels.limit(0))
        assert module.score(docs, none).count() == len(TEXTS)


def test_licences(spark, docs, empty):
    rows = spark.createDataFrame([(1, "a\nReleased under the MIT License.\nb", "en"), (2, "She passed her driving licence test", "en"), (3, None, "en"), (4, "Licensed under CC BY-NC 4.0.", "en")], SCHEMA)
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in license_scan.scan(rows).collect()}
    assert got == {(1, 1, "mit"), (2, 0, "unknown"), (4, 0, "cc-by-nc")}
    assert license_scan.scan(empty).count() == 0


def test_unknown_licences_are_not_confirmed(spark):
    lines = [
        "This work is licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "Released under the ISC License.",
        "Licensed under the Eclipse Public License, version 1.0.", "Licensed under the Microsoft Public License.", "Licensed under CC BY-NC-ND 4.0.",
    ]
    rows = spark.createDataFrame([(k, t, "en") for k, t in enumerate(lines)], SCHEMA)
    assert {r["doc_id"]: r["family"] for r in license_scan.scan(rows).collect()} == dict.fromkeys(range(len(lines)), "unknown")
    rows = license_scan.labelled()
    kept = [good for p, good in license_scan._fit(rows)[3] if p >= license_scan.model()[3]]
    assert sum(kept) >= license_scan.PRECISION * len(kept) and sum(kept) >= 0.8 * sum(f != "none" for f, *_ in rows)  # precision and recall on unseen wordings


def test_no_precision_confirms_nothing():
    assert license_scan.least_probability([(0.9, False), (0.8, True)]) > 1
    assert license_scan.least_probability([(0.9, True), (0.8, False)]) == 0.9


def test_wrapped_licences(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"
    texts = [(1, "Title\n\n" + grant + "\n\nEnd"), (2, "you may not use this file except in compliance with the Apache terms"), (3, "One\n# " + grant.replace("\n", "\n# ").replace(" copy", "\n# copy")), (4, "Released under\n\nthe MIT License"), (5, "Released\nunder\nthe\nMIT\nLicense\nand more")]
    rows = spark.createDataFrame([(i, t, "en") for i, t in texts], SCHEMA)
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in license_scan.scan(rows).collect()}
    assert (1, 2, "mit") in got and len([g for g in got if g[0] == 1]) == 1
    assert (2, 0, "apache-2.0") in got and (3, 1, "mit") in got and {g[2] for g in got if g[0] == 5} == {"mit"}


def test_guards_lose_no_template():
    for f, t in ((f, t) for f, ts in license_scan.templates().items() for t in ts):
        own = set(t)
        left = [w for w in own if not any(g in w for g in license_scan.guards())]
        assert f == "none" or len(left) < license_scan.COVER * len(own)


def test_fingerprints(docs, empty, spark):
    rng = np.random.default_rng(6)
    vocab = [f"term{i}" for i in range(400)]
    rows = [(i, " ".join(vocab[j] for j in rng.integers(0, 400, 60)), "en") for i in range(60)]
    rows.append((60, rows[0][1], "en"))
    got = imatch.match(spark.createDataFrame(rows, SCHEMA), band=(0.02, 0.6)).toPandas().set_index("doc_id")
    assert got.loc[0, "fingerprint"] == got.loc[60, "fingerprint"]
    assert got["near_edited"].mean() > 0.3 > 0.1 > got["near_next"].mean()
    import hashlib

    text, after = rows[5][1], rows[6][1]
    cut = len(text) // 4
    assert got.loc[5, "edited_sha256"] == hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()
    small = imatch.match(docs).collect()
    assert len(small) == len(TEXTS) and all(0 <= r["near_edited"] <= 1 for r in small)
    assert imatch.match(empty).count() == 0


def test_rare_terms_of_the_band_stay(spark):
    # each of 300,000 terms is in 3 of 3000 documents, inside the band
    rows = spark.range(3000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 299), k -> concat('t', (id * 300 + k) % 300000))) as text")
    bitmap = imatch.lexicon(rows).first()["bitmap"]
    assert sum((x & (2**64 - 1)).bit_count() for x in bitmap) > 0.95 * 300_000
