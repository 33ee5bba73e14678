"""Each operator against brute force on a small table, and on a table of awkward rows."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import SF, normal
from pyspark.sql import functions as F

from gridloom.llm import canonical, exact_dedup, histogram_sort, language, packing, quality, queries, simhash, suffix_tree, unigram, url_reputation
from gridloom.llm.common import tokenised

WHITE = re.compile(rb"[\x20\x09-\x0D]+")


def crc_mod(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_registered_queries(spark):
    numbers = sorted(int(m[1]) for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


# 1 URL filters


def test_url_parts_and_rules(spark):
    urls = {
        1: ("HTTP://WWW.Example.NET/en/x?q#f", "www.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"),
        3: ("http://a.example.com/de/", "a.example.com", "/de/", "example.com/de/", "block"),
        4: ("https://b.org/fr/1", "b.org", "/fr/1", "org/fr/", "allow"),
        5: ("http://h.net?x/y", "h.net", "", None, "allow"),
        6: ("no scheme", "", "", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("http://notexample.net", "notexample.net", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u[0], "clash") for i, u in urls.items()], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("http://good.io/", 1)] * 40, "url string, good int")
    got = {r["page_id"]: tuple(r)[1:] for r in url_reputation.judge(pages, outcomes.unionByName(pages.selectExpr("url", "cast(null as int) good"))).collect()}
    assert got == {i: u[1:] for i, u in urls.items()}


def test_bad_hosts_are_blocked_and_unknown_ones_shrink_to_their_domain(spark):
    rows = [("http://bad.x.com/", 0)] * 30 + [(f"http://h{i}.y.org/", 1) for i in range(60)] + [("http://new.x.com/", None), ("http://new.y.org/", None), ("http://h0.x.com/", 0)]
    out = spark.createDataFrame(rows, "url string, good int")
    pages = out.selectExpr("monotonically_increasing_id() page_id", "url")
    verdict = {r["host"]: r["verdict"] for r in url_reputation.judge(pages, out, rules=()).collect()}
    assert verdict["bad.x.com"] == verdict["new.x.com"] == "block"
    assert verdict["h1.y.org"] == verdict["new.y.org"] == "allow"


def test_suffixes_from_a_list(spark, tmp_path):
    path = tmp_path / "list.dat"
    path.write_text("// rules\nuk\nco.uk\n\ngov.uk\n*.ck\n!www.ck\nct.sch.uk extra\n", encoding="utf-8")
    suffixes = url_reputation.read_suffixes(str(path))
    assert suffixes == ("*.ck", "co.uk", "ct.sch.uk", "gov.uk")
    hosts = ["a.b.co.uk", "x.gov.uk", "gov.uk", "a.foo.ck", "y.ct.sch.uk", "plain.org", "uk", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    suffix = url_reputation.suffix_of(F.col("host"), suffixes)
    got = [tuple(r) for r in df.select(suffix, url_reputation.domain_of(F.col("host"), suffix)).collect()]
    assert got == [("co.uk", "b.co.uk"), ("gov.uk", "x.gov.uk"), ("gov.uk", "gov.uk"), ("foo.ck", "a.foo.ck"), ("ct.sch.uk", "y.ct.sch.uk"), ("org", "plain.org"), ("uk", "uk"), ("", "")]


def test_repeated_and_very_long_urls(spark):
    long = "http://" + "a." * 40_000 + "example.com/de/" + "p" * 100_000
    rows = [(1, long), (1, long), (2, "http://x.org/" + "/" * 200_000), (3, "://"), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = url_reputation.judge(pages, pages.selectExpr("url", "1 good")).collect()
    got = Counter((r["page_id"], r["host"], len(r["path"]), r["rule"]) for r in out)
    assert got == Counter([(1, "a." * 40_000 + "example.com", 100_004, "example.com/de/")] * 2 + [(2, "x.org", 200_001, None), (3, "", 0, None), (None, "", 0, None)])
    assert {r["verdict"] for r in out if r["page_id"] == 1} == {"block"} and all(r["verdict"] in ("block", "allow") for r in out)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_reputation.judge(pages, spark.createDataFrame([], "url string, good int")).count() == 0


# 2 Language-model scoring


def test_suffix_tree_against_counts(spark, docs):
    got = {r["doc_id"]: r for r in suffix_tree.score_documents(docs).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    tokens = {i: [w for w in WHITE.split(t.lower()) if w] + [b"\n"] for i, t in texts.items()}
    c = Counter(w for i, t in tokens.items() if crc_mod(i, 7) != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        assert got[i]["held_out"] == (crc_mod(i, 7) == 2)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)


def test_suffix_tree_on_awkward_rows(spark, edge):
    got = suffix_tree.score_documents(edge).collect()
    assert len(got) == edge.count()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert all(np.isfinite(r["score"]) for r in got)
    assert suffix_tree.score_documents(edge.limit(0)).count() == 0
    one = suffix_tree.score_documents(edge.filter("doc_id = 3")).first()
    assert np.isfinite(one["score"])


def test_tokens_are_cut_at_ascii_white_space_only():
    words, at, n = tokenised(pa.array(["  A b\x0bc ", None, "", "x\xa0Y\x1c z", "É"]))
    words = words.to_pylist()
    assert [words[i] for i in at] == [b"a", b"b", b"c", "x\xa0y\x1c".encode(), b"z", "É".encode()]
    assert n.tolist() == [3, 0, 0, 2, 1]


# 3 Exact dedup


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[WHITE.sub(b" ", (t or "").encode())].append(i)
    low = lambda g: None if None in g else min(g)
    kept = lambda g: [k == g.index(low(g)) for k in range(len(g))]  # one of them, also of rows equal in both
    return Counter((i, low(g), len(g), k, hashlib.sha256(t).hexdigest()) for t, g in groups.items() for i, k in zip(g, kept(g), strict=True))


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_exact_groups(request, table):
    df = request.getfixturevalue(table)
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(df).collect())
    assert got == brute_groups([(r["doc_id"], r["text"]) for r in df.collect()])
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_keep_first_returns_whole_rows(edge):
    kept = exact_dedup.keep_first(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == sorted((i is not None, i or 0) for i in (0, 2, None, 5, 6, 7, 8, 9, 10, None, 12))


def test_grace_spills_and_agrees(tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    contents = [rng.bytes(int(rng.integers(1, 400))) for _ in range(300)]
    picks = [contents[i] for i in rng.integers(0, 300, 2000)] + [b"hot" * 50] * 3000
    records = [(str(k).encode(), hashlib.sha256(c).digest(), c) for k, c in enumerate(picks)]
    deepest = []
    monkeypatch.setattr(exact_dedup, "_spilled", lambda r, d, f, own=exact_dedup._spilled: deepest.append(d) or own(r, d, f))
    found = list(exact_dedup.grace(iter(records), memory=20_000))
    assert max(deepest) >= 1
    by = defaultdict(set)
    for rep, cls in found:
        by[cls].add(picks[int(rep)])
    assert len(found) == len(picks) and all(len(x) == 1 for x in by.values()) and len(by) == len(set(picks))


def test_table_tells_equal_hashes_apart():
    table = exact_dedup.ContentTable(4)
    assert [table.find_or_add(7, bytes([k])) for k in (1, 2, 1, 3, 2)] == [(0, True), (1, True), (0, False), (2, True), (1, False)]


# 4 Unigram pieces


@pytest.fixture(scope="module")
def unigram_model():
    return unigram.Unigram(unigram.Pieces.read(queries.public_tokenizers.path(unigram.MODEL)))


def brute_viterbi(model, data):
    """All segmentations of a short chunk: the largest score sum."""
    best = [0.0] + [-np.inf] * len(data)
    names = {n: model.score[i] for i, (n, k) in enumerate(zip(model.pieces.names, model.pieces.kinds, strict=True)) if k in (unigram.NORMAL, unigram.USER_DEFINED)}
    chars = [len(c.encode()) for c in data.decode()]
    edges = np.concatenate([[0], np.cumsum(chars)]).tolist()
    for a in edges[:-1]:
        for b in edges:
            if b > a and data[a:b] in names:
                best[b] = max(best[b], best[a] + names[data[a:b]])
        first = edges[edges.index(a) + 1]
        if data[a:first] not in names:
            best[first] = max(best[first], best[a] + model.unknown)
    return best[-1]


def test_pieces_have_the_largest_score(unigram_model, docs):
    encoder = unigram.Encoder(unigram_model)
    words = sorted({w for r in docs.limit(60).collect() for w in r["text"].split(" ")})[:1500] + ["日本語", "😀x", "\n\n", "ß", "a\x00b"]
    for word, ids in zip(words, encoder.encode([w.encode() for w in words]), strict=True):
        if word:
            got = np.frombuffer(ids, "<u4").astype(int)
            score, k = 0.0, 0
            while k < len(got):  # a run of byte pieces is one unknown character
                if unigram_model.pieces.kinds[got[k]] == unigram.BYTE:
                    b = unigram_model.text[got[k]][0]
                    k += 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                    score += unigram_model.unknown
                else:
                    score += unigram_model.score[got[k]]
                    k += 1
            assert math.isclose(score, brute_viterbi(unigram_model, b" " + word.encode()), rel_tol=1e-12), word


def test_pieces_agree_with_the_library(unigram_model, docs):
    sp = pytest.importorskip("sentencepiece")
    raw = open(queries.public_tokenizers.path(unigram.MODEL), "rb").read()
    lib = sp.SentencePieceProcessor(model_proto=raw + b"\x12\x02\x18\x01")  # the same pieces, read as a unigram model
    words = sorted({w for r in docs.limit(40).collect() for w in r["text"].split()})[:400]
    encoder = unigram.Encoder(unigram_model)
    for word, ids in zip(words, encoder.encode([w.encode() for w in words]), strict=True):
        first = lib.nbest_encode(word, nbest_size=1, out_type=int) if hasattr(lib, "nbest_encode") else lib.nbest_encode_as_ids(word, 1)
        got = np.frombuffer(ids, "<u4").tolist()
        total = lambda x: sum(unigram_model.score[i] for i in x)
        assert math.isclose(total(got), total(first[0] if isinstance(first[0], list) else first), rel_tol=1e-9)


def test_round_trip(spark, edge):
    model = queries.public_tokenizers.path(unigram.MODEL)
    rows = Counter((r["doc_id"], r["text"]) for r in unigram.decode(unigram.encode(edge, model), model).collect())
    assert rows == Counter((r["doc_id"], (r["text"] or "").replace("▁", " ")) for r in edge.collect())
    got = unigram.encoded(edge, model).collect()
    assert len(got) == edge.count()
    assert all(r["round_trip"] for r in got if r["doc_id"] != 12)
    assert unigram.encoded(edge.limit(0), model).count() == 0


def test_many_at_once_is_one_by_one(unigram_model):
    rng = np.random.default_rng(1)
    chunks = [b" " + bytes(rng.choice(list(b"aehtinos."), 9).tolist()) for _ in range(200)]
    assert unigram_model.segment_many(chunks) == [unigram_model.segment(c) for c in chunks]


def test_pieces_with_an_inner_marker_are_refused():
    with pytest.raises(ValueError, match="marker"):
        unigram.Unigram(unigram.Pieces([b"<unk>", b" a", b" a b"], [0.0, -1.0, -2.0], [unigram.UNKNOWN, unigram.NORMAL, unigram.NORMAL]))


def test_long_chunks_are_segmented_alike(unigram_model, monkeypatch):
    """Chunks that are segmented one by one, and a memory of few bytes, give the same ids."""
    texts = [b"ab cd " * 30 + bytes(97 + (k * j) % 26 for j in range(300)) for k in range(9)]
    want = unigram.Encoder(unigram_model).encode(texts)
    monkeypatch.setattr(unigram, "LONG", 100)
    monkeypatch.setattr(unigram, "MEMO_BYTES", 50)
    encoder = unigram.Encoder(unigram_model)
    assert [encoder.encode([t])[0] for t in texts] == want


# 5 Sharding


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_shards(request, table):
    df = request.getfixturevalue(table)
    rows = histogram_sort.shard_documents(df).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 16) <= 2 * largest + 0.01 * total / 16
    assert set(by) <= set(range(16))
    assert histogram_sort.shard_documents(df.limit(0)).count() == 0


def test_a_hot_text_is_spread(spark):
    df = spark.createDataFrame([(i, "copy " * 20 if i % 3 else f"own {i}") for i in range(3000)], "doc_id long, text string")
    rows = histogram_sort.shard_documents(df).collect()
    per = Counter()
    for r in rows:
        per[r["shard"]] += r["size"]
    total = sum(per.values())
    assert len(per) == 16 and max(abs(b - total / 16) for b in per.values()) <= 0.01 * total / 16 + 2 * 101


def test_probes_count_exactly():
    h, i = np.array([3, 3, 3, -5, 9]), np.array([1, 2, 3, 0, 0])
    assert histogram_sort.below(h, i, [(-5, 0), (3, 2), (3, 3), (10, 0)]).tolist() == [1, 2, 3, 1, 3]


# 6 Fingerprints


def brute_canonical(t):
    n = unicodedata.normalize
    return " ".join(n("NFKC", n("NFKC", t).casefold()).split()).encode()


def test_fingerprints(docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r for r in canonical.fingerprints(docs, block_bytes=40_000).collect()}
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[brute_canonical(t)].append(i)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r, digest = got[i], lambda x: xxhash.xxh3_128_hexdigest(brute_canonical(x))
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"], r["group_id"]) == (digest(t), digest(edited), min(groups[brute_canonical(t)]))
        assert (r["near_edited"], r["near_next"]) == (float(digest(t) == digest(edited)), float(digest(t) == digest(after)))


def test_fingerprints_of_awkward_rows(edge):
    rows = canonical.fingerprints(edge).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == by[2]["fingerprint"] == by[11]["fingerprint"]
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == by[5]["fingerprint"]
    assert canonical.fingerprints(edge.limit(0)).count() == 0
    alone = canonical.fingerprints(edge.filter("doc_id = 0")).first()
    assert alone["near_next"] == 1.0


def test_equal_digests_are_told_apart(spark):
    """With digests that are all alike, forms decide: groups, likeness, and the names of texts and edited texts."""
    texts = ["one", "two", "ONE", "six", "tw\u212ao", "a b c d", "a b c o", "\u212a\x1cb", "k b", "xone", "onex"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in canonical.fingerprints(df, hashed=lambda form: b"0" * 16).collect()}
    plain = {r["doc_id"]: r for r in canonical.fingerprints(df).collect()}
    forms, edited = [brute_canonical(t) for t in texts], [brute_canonical(t[: len(t) - len(t) // 4] + texts[(k + 1) % len(texts)][: len(t) // 4]) for k, t in enumerate(texts)]
    named = {}
    for k, r in rows.items():
        assert (r["near_edited"], r["near_next"], r["group_id"]) == (plain[k]["near_edited"], plain[k]["near_next"], plain[k]["group_id"])
        assert r["near_next"] == float(forms[k] == forms[(k + 1) % len(forms)])
        for form, name in ((forms[k], r["fingerprint"]), (edited[k], r["edited_fingerprint"])):
            assert named.setdefault(form, name) == name
    assert len(set(named.values())) == len(named)


def test_white_space_has_one_rule():
    for text in ("k\x1cb", "\u212a\x1cb", " K\x85\xa0b\u3000 ", "k\tb\r\n", "k  b"):
        assert canonical.canonical(text) == brute_canonical(text) == b"k b"


def test_fingerprints_of_one_id_over_several_blocks(spark):
    """Rows without an id, and of one id, are split by their texts' hashes; each meets its successor."""
    rows = [(None, f"text {k} of no id " + "z" * (k % 50)) for k in range(300)] + [(5, f"five {k} and more words") for k in range(200)] + [(5, "again")] * 30 + [(9, "nine"), (1, "one")] + [((1 << 62) + k, f"far {k} " + "y" * 40) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["edited_sha256"], r["near_next"]) for r in canonical.fingerprints(df, block_bytes=1500).collect())
    ordered = [r["text"] for r in df.withColumn("h", F.shiftright(F.xxhash64("text"), 11)).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()]
    ids = sorted((i is not None, i or 0) for i, _ in rows)
    want = []
    for k, (t, i) in enumerate(zip(ordered, ids, strict=True)):
        after = ordered[(k + 1) % len(ordered)]
        want.append((*i, hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest(), float(brute_canonical(t) == brute_canonical(after))))
    assert got == sorted(want)
    cuts = canonical.cuts_of(df.select(F.coalesce("doc_id", F.lit(canonical.LOW)).alias("i"), F.shiftright(F.xxhash64("text"), 11).alias("h")), 12)
    assert len(cuts.ids) > len(set(cuts.ids.tolist()))


# 7 Quality


def test_quality_on_held_out_rows(spark):
    rows = queries.op7_subword_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50
    assert np.mean([p == y for p, y in held]) > 0.9
    assert all(r["held_out"] == (crc_mod(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_on_awkward_rows(spark, edge):
    labels = spark.createDataFrame([(0, 1), (2, 0), (6, 1), (None, 0), (8, None), (9, 0), (0, 1)], "doc_id long, quality int")
    model = quality.fit(edge, labels)
    rows = quality.scored(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.keep_good(edge, model, 0.0).count() == edge.count()
    assert quality.scored(edge.limit(0), model).count() == 0
    nothing = quality.fit(edge.limit(0), labels.limit(0))
    assert {r["score"] for r in quality.scored(edge, nothing).collect()} == {0.5}


def test_quality_learns_from_long_texts_alone(spark):
    """Texts of over 40,000 bytes are learned from whole; repeated rows and ids are learned once."""
    rows = [(k, " ".join([("good fine neat" if k % 2 else "spam junk dirt"), *(f"w{(k * j) % 89}" for j in range(15_000)), ("good fine neat" if k % 2 else "spam junk dirt")] * 1)) for k in range(40)]
    rows = [(i, t + (" good" if i % 2 else " spam") * 4000) for i, t in rows]
    assert min(len(t) for _, t in rows) > 40_000
    docs = spark.createDataFrame(rows + rows[:1] * 20, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    bags, found, share = quality.training_rows(docs, labels, quality.Settings())
    assert (len(bags), sorted(found), share) == (40, [0] * 20 + [1] * 20, 0.5)
    score = {r["doc_id"]: r["score"] for r in quality.scored(docs, quality.fit(docs, labels)).collect()}
    assert min(score[i] for i in score if i % 2) > 0.5 > max(score[i] for i in score if i % 2 == 0)


def test_language_learns_from_long_texts_alone(spark):
    rows = [(k, ("the and of with from " if k % 2 else "der und von mit aus ") * 3000, "en" if k % 2 else "de") for k in range(20)]
    docs = spark.createDataFrame(rows + rows[:1] * 20, "doc_id long, text string, lang string")
    said = {r["doc_id"]: r["lang_pred"] for r in language.predicted(docs, language.fit(docs)).collect()}
    assert said == {i: lang for i, _, lang in rows}


# 8 Language


def test_no_language_is_lost_by_rows_of_few_ids(spark):
    german, english = "der Hund und die Katze sind nicht im Haus", "the dog and the cat are not in the house"
    rows = [(i, f"{english} {i}", "en") for i in range(300)] + [(1000 + i % 5, f"{german} {i}", "de") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ("de", "en")
    said = {(r["doc_id"] >= 1000, r["lang_pred"]) for r in language.predicted(docs, model).collect()}
    assert said == {(True, "de"), (False, "en")}


def test_language_prediction_against_plain_votes(spark, docs):
    """The predictor's sums and votes against one weight after the other."""
    s = language.Settings()
    rows = docs.filter("lang is not null").select("text", "lang").limit(60).collect()
    bags = [language._bag((r["text"] or "").encode(), s) for r in rows]
    model = language.train(bags, [r["lang"] for r in rows], s)

    def plain(ids, share):
        margin = {p: float((model.weights[k][ids] * share).sum() + model.biases[k]) for k, p in enumerate(model.pairs)}

        def winner(level, names):
            votes, total, weakest = (dict.fromkeys(names, x) for x in (0, 0.0, np.inf))
            for (at, a, b), m in margin.items():
                if at == level and a in names:
                    for name, own, wins in ((a, m, m >= 0), (b, -m, m < 0)):
                        votes[name], total[name], weakest[name] = votes[name] + wins, total[name] + own, min(weakest[name], own)
            return max(names, key=lambda x: (votes[x], total[x], [-ord(c) for c in x])), weakest

        family, sure = winner("", sorted(set(model.families.values())))
        name, inner = winner(family, sorted(x for x in model.languages if model.families[x] == family))
        shape = lambda m: 1.0 if np.isinf(m) else 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
        return name, shape(sure[family]) * shape(inner[name])

    said, score = model.predictor()([(r["text"] or "").encode() for r in rows])
    for k, (ids, share) in enumerate(bags):
        if len(ids):
            name, value = plain(ids, share)
            assert said[k] == name and np.isclose(score[k], value, atol=1e-4)


def test_quality_score_against_plain_forward_pass(spark, docs):
    s = quality.Settings()
    texts = [(t or "").encode() for (t,) in docs.select("text").limit(50).collect()]
    model = quality.train([quality._bag(t, s) for t in texts], [k % 2 for k in range(len(texts))], 0.5, s)
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.scored(df, model).collect()}
    for k, t in enumerate(texts):
        ids, share = quality._bag(t, s)
        z = float((model.weights[ids] * share).sum() + model.bias) if len(ids) else model.bias
        assert np.isclose(got[k], 1 / (1 + np.exp(-z)), atol=1e-4)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_on_awkward_rows(spark, edge):
    texts = [b"the cat and the dog", b"der hund und die katze", b"le chat et le chien", b"el gato y el perro"] * 3
    model = language.train([language._bag(t, language.Settings()) for t in texts], ["en", "de", "fr", "es"] * 3)
    assert {p[0] for p in model.pairs} == {"", "germanic", "romance"}
    rows = language.predicted(edge, model).collect()
    assert len(rows) == edge.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5, 9)} == {"und"}
    assert all(r["lang_pred"] in ("en", "de", "fr", "es", "und") for r in rows)
    assert language.keep_identified(edge, model).columns == edge.columns
    assert language.keep_identified(edge, model).filter("doc_id in (3, 4, 5, 9)").count() == 0
    assert {r["lang_pred"] for r in language.predicted(edge, language.train([], [])).collect()} == {"und"}
    assert {r["lang_pred"] for r in language.predicted(edge, language.train([language._bag(b"abc", language.Settings())], ["xx"])).collect()} == {"xx", "und"}
    assert language.predicted(edge.limit(0), model).count() == 0


# 9 Packing


def fewest_bins(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in {bins[x]: x for x in range(len(bins)) if bins[x] + items[k] <= capacity}.values():
            bins[b] += items[k]
            place(k + 1, bins)
            bins[b] -= items[k]
        bins.append(items[k])
        place(k + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(4)
    for _ in range(150):
        items = rng.integers(1, 21, rng.integers(1, 10)).tolist()
        fixed, left = packing.reduce_dominated(dict(Counter(items)), 20)
        rest = [n for n, k in left.items() for _ in range(k)]
        assert sum(n for _, n in fixed) + fewest_bins(rest, 20) == fewest_bins(items, 20)


def test_patterns_hold_every_piece():
    rng = np.random.default_rng(5)
    for capacity in (7, 50, 4096):
        counts = Counter(rng.integers(1, capacity + 1, 400).tolist())
        found = Counter()
        for content, bins in packing.pack_counts(counts, capacity):
            assert sum(n * k for n, k in content.items()) <= capacity and bins > 0
            for n, k in content.items():
                found[n] += k * bins
        assert found == counts


def check_packing(df, rows, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for r in df.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4").tobytes()
            want[r["doc_id"], k, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(docs):
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    n = check_packing(docs, rows)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 4096) * 1.02 + 1


def test_packing_of_awkward_rows(edge):
    check_packing(edge, packing.pack(edge, queries.tokenizer_path()).collect())
    assert packing.pack(edge.limit(0), queries.tokenizer_path()).count() == 0


def test_added_tokens_in_texts(spark):
    """The tokenizer's own special strings in a text are its added tokens, alone, inside words, cut in two and in capitals."""
    texts = ["a <|endoftext|> b", "x<|endoftext|>y<|startoftext|>", "<|endof text|>", "<|ENDOFTEXT|> z", "é<|endoftext|>ﬁ", "<|endoftext|", "|><|endoftext|>"]
    check_packing(df := spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.pack(df, queries.tokenizer_path()).collect())


# 10 SimHash


def brute_fingerprint(text):
    words = [w for w in WHITE.split((text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_simhash(request, table):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.collect()]
    roots = brute_components([f for _, f in rows])
    low = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = Counter((i, f"{f:016x}", low.get(r)) for (i, f), r in zip(rows, roots, strict=True))
    assert Counter(tuple(r) for r in simhash.near_documents(df).collect()) == want
    assert simhash.near_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [16, 1024])
def test_runs_of_near_copies_lose_no_link(most):
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 2**63, 12).astype(np.uint64)
    fps = np.unique([c ^ np.uint64(sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))})) for c in centres for _ in range(40)])
    links = simhash.run_links(fps, simhash.pivots(), most)
    at = {int(f): k for k, f in enumerate(fps)}
    assert len(links) < len(fps)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert (a ^ b).bit_count() <= 3
        root[max(find(at[a]), find(at[b]))] = min(find(at[a]), find(at[b]))
    assert [find(k) for k in range(len(fps))] == brute_components([int(f) for f in fps])


def test_crowded_bands_are_dealt_again(spark):
    """Many distinct fingerprints that share most bits: finer bands spread them, and no link is lost."""
    rng = np.random.default_rng(8)
    low = rng.integers(0, 2**28, 400).astype(np.uint64)
    fps = np.unique(np.concatenate([low, low[:150] ^ np.uint64(5), low[:80] ^ np.uint64(1 << 60)]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    want = {int(f): r for f, r in zip(fps, brute_components([int(f) for f in fps]), strict=True)}
    for hot in (50, 8192):
        found = simhash.fingerprint_components(df, len(fps), hot).collect()
        groups = defaultdict(set)
        for r in found:
            groups[r["root"]].add(int(np.int64(r["fp"]).view(np.uint64)))
        together = defaultdict(set)
        for f, r in want.items():
            together[r].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in together.values() if len(g) > 1)


def test_pivot_differences_never_exceed_the_distance():
    rng = np.random.default_rng(7)
    x, y = (rng.integers(0, 2**63, 500).astype(np.uint64) for _ in range(2))
    gap = np.abs(simhash.pivot_table(x, simhash.pivots()) - simhash.pivot_table(y, simhash.pivots())).max(axis=1)
    assert (gap <= np.bitwise_count(x ^ y)).all()


def test_one_of_each_group_stays(edge):
    kept = [r["doc_id"] for r in simhash.keep_one_each(edge, likeness=None).collect()]
    groups = {r["component_id"] for r in simhash.near_documents(edge).collect()}
    assert set(kept) == groups
