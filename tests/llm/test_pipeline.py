import os
import re
import threading
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import queries, shingle_join
from gridloom.llm.common import shared_dir
from gridloom.llm.simhash import keep_one_each, near_groups
from llm.test_text_operators import check_packing

SF = "/root/testdata/sf0.01"
WHITE = re.compile(rb"[\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    """Each stage on what its predecessor kept, against a plain version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        path = os.path.join(tmp_path, str(k))
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        kept[name] = out.count()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
            after = {r["doc_id"] for r in out.collect()}
            assert after <= set(before)
            if name == "language ID":
                assert after == {i for i, t in before.items() if any(map(str.isalpha, t or ""))}
            if name == "quality classifier":
                good = [i for i in before if labels.get(i) == 1]
                assert sum(i in after for i in good) >= 0.97 * len(good)
                bad = [i for i in before if labels.get(i) == 0]
                assert sum(i in after for i in bad) <= 0.4 * len(bad)
            if name == "exact dedup":
                first = {}
                for i, t in sorted(before.items()):
                    first.setdefault(WHITE.sub(b" ", t.encode()), i)
                assert after == set(first.values())
            if name == "SimHash near-dedup":
                assert after == set(brute_jaccard_groups(before)[0].values())
        else:
            check_packing(docs, out.collect())
        docs = out
    assert list(kept) == ["language ID", "quality classifier", "exact dedup", "SimHash near-dedup", "best-fit packing"]


def test_run_gives_the_same_pieces_twice(spark):
    rows = [sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_runs_do_not_touch_each_other(spark):
    """Two runs at a time give the same pieces, and leave only their results in the shared folder."""
    before, out = set(os.listdir(shared_dir(spark))), {}
    runs = [threading.Thread(target=lambda k=k: out.update({k: corpus_pipeline.run(spark, "/root/testdata/sf0.001")})) for k in range(2)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    rows = [sorted(tuple(r)[:5] for r in out[k].collect()) for k in range(2)]
    assert rows[0] == rows[1] and rows[0]
    left = set(os.listdir(shared_dir(spark))) - before
    assert len(left) == 2 and all(os.listdir(os.path.join(shared_dir(spark), x)) == ["4"] for x in left)


def test_stages_can_be_chained_unwritten(spark):
    """A stage's plan stays good when later stages have been called."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.drop_exact_copies(spark, docs, SF)
    first, second = corpus_pipeline.drop_near_copies(spark, kept, SF), corpus_pipeline.drop_near_copies(spark, kept, SF)
    pieces = corpus_pipeline.pack_sequences(spark, first, SF)
    ids = {r["doc_id"] for r in pieces.collect()}
    assert ids == {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in second.collect()}


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Null ids, texts and languages, repeated rows, a very long text, and extra columns with clashing names."""
    long = " ".join(f"the word{i % 997} of and {i}" for i in range(20_000))
    rows = [(1, "the cat sat on the mat and it was good", "en"), (2, "the  cat sat on the mat and it was good", "en"), (None, "the dog and the cat were here with us", None), (None, None, "en"), (3, None, None), (4, "", "de"), (5, "12 34", "en"), (6, long, "en"), (7, long + " end", "en"), (8, "der Hund und die Katze sind hier", "de"), (8, "der Hund und die Katze sind hier", "de")]
    docs = spark.createDataFrame([(*r, "s", 1, "x", 2, "y", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, sha string, fp long, __kept string, key int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, "z") for i in range(1, 9)], "doc_id long, quality int, score string").write.parquet(f"{tmp_path}/labels.parquet")
    sf, frame = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    named = corpus_pipeline.identify_language(spark, frame, sf)
    assert tuple(named.columns) == corpus_pipeline.COLUMNS
    assert sorted(str(r["doc_id"]) for r in named.collect()) == ["1", "2", "6", "7", "8", "8", "None"]
    assert set(map(tuple, corpus_pipeline.classify_quality(spark, frame, sf).collect())) <= set(map(tuple, frame.select(*corpus_pipeline.COLUMNS).collect()))
    once = corpus_pipeline.drop_exact_copies(spark, frame, sf).collect()
    assert sorted(str(r["doc_id"]) for r in once) == ["1", "5", "6", "7", "8", "None", "None"]
    alike = {str(r["doc_id"]) for r in corpus_pipeline.drop_near_copies(spark, frame, sf).collect()}
    assert {"1", "5", "6", "8"} <= alike and not alike & {"2", "7"}
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{SF}/conversations.parquet").limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    for name, query in queries.QUERIES.items():
        if name != "op1_url_reputation":
            assert query(spark, str(tmp_path)).count() == 0, name


def brute_jaccard_groups(rows, likeness=0.8):
    """The smallest id of each row's component, from all pairs of sets of five-word shingles."""
    ids = sorted(rows)
    sets = []
    for i in ids:
        words = (rows[i] or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for k, s in enumerate(sets):
        for m, both in Counter(m for x in s for m in holders[x] if m < k).items():
            if both >= likeness * (len(s) + len(sets[m]) - both):
                links += 1
                a, b = find(k), find(m)
                root[max(a, b)] = min(a, b)
    return {i: ids[find(k)] for k, i in enumerate(ids)}, links


def test_texts_around_one_passage_are_dealt_out(spark, monkeypatch):
    """5,000 texts that share a passage and are not alike: no task gets many more than CROWD of them, and every two that may be alike meet."""
    monkeypatch.setattr(shingle_join, "CROWD", 300)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(k, passage + " " + " ".join(f"u{k}x{j}" for j in range(10 + k % 30))) for k in range(5000)]
    nodes = shingle_join.sketched(spark.createDataFrame(rows, "doc_id long, text string"))
    spread = nodes.select(F.explode("bands").alias("key"), "fp", "size").cache()
    whole = spread.groupBy("key").count().agg(F.max("count")).first()[0]
    parts = shingle_join.dealt(spread, 0.8).cache()
    assert whole > 1000 and parts.groupBy("key").count().agg(F.max("count")).first()[0] < 900
    crowd = spread.groupBy("key").count().filter("count > 1000").first()["key"]
    sizes = {r["fp"]: r["size"] for r in spread.filter(F.col("key") == crowd).orderBy("fp").limit(60).collect()}
    where = {}
    for r in parts.filter(F.col("fp").isin(list(sizes))).collect():
        where.setdefault(r["fp"], set()).add(r["key"])
    fps = sorted(sizes)
    assert all(where[a] & where[b] for a in fps for b in fps if min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]))


@pytest.mark.parametrize("chunk, crowd", [(2000, 4096), (7, 4096), (2000, 8)])
def test_near_copies_against_all_pairs(spark, monkeypatch, chunk, crowd):
    """Copies with a few words changed, at similarities on both sides of 0.8, among the documents and short texts."""
    monkeypatch.setattr(shingle_join, "CHUNK", chunk)  # 7: most groups are dealt to several tasks
    monkeypatch.setattr(shingle_join, "CROWD", crowd)  # 8: bands of large groups are dealt again
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    many = [f"word{k}" for k in range(100)]
    rows |= {3_000_000 + k: " ".join([*many[:k % 12], f"new{k}", *many[k % 12 + 1 :]]) for k in range(60)}  # one large group
    rows |= {4_000_000 + k: " ".join(many[k : k + 60]) for k in range(40)}  # a chain whose ends are unlike
    for k, i in enumerate(sorted(i for i, t in rows.items() if len((t or "").split()) > 60)[:150]):
        words = rows[i].split()
        for n in range(k % 6):
            words[(n * 37 + k) % len(words)] = f"changed{n}"
        rows[1_000_000 + i] = " ".join(words)
    rows |= {2_000_000 + k: t for k, t in enumerate(["", " ", None, "a b c", "A  b c", "a b d", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h j"])}
    want, links = brute_jaccard_groups(rows)
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["component_id"] for r in near_groups(docs, likeness=0.8).collect()}
    assert links > 50 and got == want
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == set(want.values())


def test_near_copies_meet_in_tables_of_simhash_bits():
    """Pairs of sets at just 0.8 agree in a table though no other key is used; unlike sets seldom do; more texts take more bits and more tables."""
    r = np.random.default_rng(3)
    sets = []
    for _ in range(300):
        x = r.integers(0, 1 << 63, 100, dtype=np.int64).astype(np.uint64)
        sets += [np.unique(x[:90]), np.unique(np.concatenate([x[:80], x[90:]]))]
    wide = np.stack([shingle_join.sketch(s)[1] for s in sets])
    n = shingle_join.tables(10, shingle_join.differing(0.8))
    met = (k := shingle_join.table_keys(wide, 10, n))[0::2] == k[1::2]
    assert met.any(axis=1).all() and met.mean() < 0.4
    assert (k[0::2] == np.roll(k[1::2], 1, axis=0)).mean() < 0.005
    assert shingle_join.table_bits(20_000_000) > shingle_join.table_bits(200_000) and shingle_join.tables(12, 0.15) > n


def test_candidates_grow_with_the_texts_and_not_with_their_pairs():
    """400 near copies in one key, more than a short run, and a short run of 60: a task gives one link for each text but the first of a group, and the groups are those of all pairs."""
    words = [f"word{k}" for k in range(300)]
    texts = [" ".join([*words[:k % 290], f"new{k}", *words[k % 290 + 1 :]]) for k in range(400)]
    sketches = [shingle_join.sketch(shingle_join.shingles(t.encode(), shingle_join._Words())) for t in texts]
    fp, wide = np.array([x[0] for x in sketches], np.uint64).view(np.int64), np.stack([x[1] for x in sketches])
    keys = np.stack([np.where(np.arange(400) < 60, 1, 2), np.full(400, 3)], axis=1).ravel()
    cols = [keys, np.repeat(fp, 2), np.repeat([x[2] for x in sketches], 2), *(np.repeat(wide[:, k].view(np.int64), 2) for k in range(4))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "fp", "size", "w0", "w1", "w2", "w3"])
    (out,) = shingle_join._compared(iter([batch]), 0.8)
    far = np.bitwise_count(wide[:, None, :] ^ wide[None, :, :]).sum(axis=2)
    assert (far <= shingle_join.radius(0.8, np.array([300]))[0]).all()
    assert out.num_rows == 399 and set(out.column(1).to_pylist()) == {int(fp.min())} and set(out.column(0).to_pylist()) == set(fp.tolist()) - {int(fp.min())}


@pytest.mark.parametrize("n, links", [(1, 0), (50, 20), (300, 900), (300, 290)])
def test_joined_names_the_smallest_of_each_component(n, links):
    r = np.random.default_rng(n + links)
    pairs, want = r.integers(0, n, (links, 2)), list(range(n))
    for a, b in pairs.tolist():
        x, y = want[a], want[b]
        want = [min(x, y) if w in (x, y) else w for w in want]
    low = np.arange(n)
    for part in np.array_split(pairs, 3):
        low = shingle_join._joined(low, part)
    assert low.tolist() == want


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_texts_are_exchanged_only_beyond_a_number_of_copies(spark, monkeypatch, most):
    """Without Spark's own guesses of sizes the rows that stay come by a join that holds the few dropped ids, and by an exchange where they are many: the same rows."""
    monkeypatch.setattr(shingle_join, "HELD_ROWS", most)
    words = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join([*words[: k % 20], f"new{k}", *words[k % 20 + 1 :]])) for k in range(20)] + [(100 + k, " ".join(f"own{k}x{j}" for j in range(40))) for k in range(20)]
    rows += [(None, rows[3][1]), (200, None), (201, None), (100, rows[20][1])]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = keep_one_each(spark.createDataFrame(rows, "doc_id long, text string"), likeness=0.8)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan) == bool(most)
        assert sorted(r["doc_id"] for r in out.collect()) == [0, 100, 100, *range(101, 120), 200]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
