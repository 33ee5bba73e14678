"""The prefix trie against one built on the driver."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from gridloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    conversations = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conversations[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    turns = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in conversations.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = (*turns.get(c - int(math.fmod(c, 5)), [])[:h], *own[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
        ends = ",".join(str(c) for c in members[k] if len(built[c]) == len(k))
        out.append((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "1 AS c", "'x' AS depth", "2 AS n", "0 AS k1", "text AS ends", "turn AS block")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[x] for x in names) for r in prefix_trie.prefix_nodes(df).collect()), key=str)


def test_shared_turns_negative_ids_and_other_columns(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice("ab"), rng.choice(["x", "yy", "é"])) for c in range(-8, 90) for t in range(rng.randint(1, 12)) if rng.random() < 0.9]
    assert found(spark, rows, extra=True) == plain(rows)


def test_awkward_rows(spark):
    rows = [(7, None, "u", "z"), (7, 1, None, None), (7, 2, "", ""), (8, None, None, "only"), (None, 1, "a", "b"), (None, None, None, None), (10, 3, "u", "w" * 100_000), (11, 3, "u", "w" * 100_000), *[(12, t, "u", "same") for t in (5, 5, 5)], *[(14, 0, "u", "same")] * 4]
    got = found(spark, rows)
    assert got == plain(rows)
    assert found(spark, [(None, 1, "a", "b")]) == []
    assert found(spark, []) == []


def test_role_and_text_are_kept_apart(spark):
    rows = [(0, 0, "ab", "c"), (5, 0, "a", "bc"), (10, 0, "ab", "c")]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("fan_in", [2, 32])
def test_long_conversations_by_blocks_and_many_merges(spark, monkeypatch, fan_in):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "FAN_IN", fan_in)
    rows = [(c, t, "u", f"{(t + c // 40) % 3}") for c in (0, 1, 5, 6, 40, 41) for t in range(60)] + [(c, t, "u", "x") for c in range(100, 160) for t in range(2)]
    rows += [(45, t, "u", f"{(t + 1) % 3}" if t < 30 else "other") for t in range(50)]
    assert found(spark, rows) == plain(rows)


def test_ends_are_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN_IN", 2)
    tries, tasks = prefix_trie.partial_tries(prefix_trie.rebuilt(prefix_trie.numbered(spark.createDataFrame([(c, 0, "u", "x") for c in range(0, 500, 5)], SCHEMA))))
    pieces = prefix_trie._merged_ends(tries, tasks).orderBy("first").collect()
    assert [i for p in pieces if len(p["ids"]) for i in p["ids"]] == sorted(range(0, 500, 5))
