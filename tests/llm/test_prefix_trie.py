"""The trie equals one that is built turn by turn, in blocks of any size."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import prefix_trie


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Tiny tables need no eight tasks a shuffle."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_version(convs):
    """convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, total, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, own in members.items():
        for d in range(len(p) + 1):
            total[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not children[p]
    rows = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(p))))
        rows.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def rows_of(convs):
    return [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]


def trie(spark, convs, block):
    empty = [c for c, turns in convs.items() if not turns]
    chats = spark.createDataFrame(rows_of(convs), "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash")).withColumn("a", F.lit(0)).repartition(3)
    seqs = prefix_trie.sequences(chats)
    if empty:
        seqs = seqs.unionByName(spark.createDataFrame([(c, b"", []) for c in empty], "conv_id long, key binary, sizes array<long>"))
    return sorted(map(tuple, prefix_trie.prefix_trie(seqs, block).collect()), key=repr)


def random_convs(seed, n, longest=6, kinds=2):
    rng = random.Random(seed)
    return {c: [(rng.choice("ua"), rng.choice(["", "x", "é€"][:kinds])) for _ in range(rng.randint(0, longest))] for c in rng.sample(range(-50, 10 * n), n)}


CASES = {
    "random": random_convs(1, 120),
    "few kinds": random_convs(2, 150, longest=4, kinds=1),
    "copies": {c: [("u", "same"), ("a", "text"), ("u", "end")] for c in range(40)} | {100: [("u", "same")], 101: [("u", "same"), ("a", "other")]},
    "nested": {c: [("u", "x")] * c for c in range(30)},
    "all empty": {c: [] for c in range(9)},
    "one": {5: [("u", "x"), ("a", "y")]},
    "one empty": {5: []},
    "nothing shared": {c: [("u", str(c)), ("a", "z")] for c in range(25)},
    "long": {c: [("u", "p")] * 700 + [("a", str(c % 3))] * (c % 4) for c in range(12)},
    "comb": {c: [("u", "x")] * (c % 7) + [("a", str(c))] for c in range(60)},
}


@pytest.mark.parametrize("block", [1, 13, 1 << 16])
@pytest.mark.parametrize("name", CASES)
def test_trie(spark, monkeypatch, name, block):
    monkeypatch.setattr(prefix_trie, "PARTS", 5)  # so that partitions hold several blocks
    if name == "long" and block == 1:
        block = 705
    assert trie(spark, CASES[name], block) == plain_version(CASES[name])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-1, 9), min_size=1, max_size=40), st.data())
def test_minima(values, data):
    own = prefix_trie.Minima(np.array(values, np.int64), data.draw(st.sampled_from([1, 2, 3, 7, 1024])))
    i, below = data.draw(st.integers(-1, len(values) - 1)), data.draw(st.integers(-1, 10))
    assert own.left(i, below) == max((j for j in range(i + 1) if values[j] < below), default=-1)
    assert own.right(i + 1, below) == min((j for j in range(i + 1, len(values)) if values[j] < below), default=len(values))
    j = data.draw(st.integers(0, len(values)))
    assert own.least(i + 1, j) == min(values[i + 1 : j], default=(1 << 63) - 1)


@given(st.lists(st.integers(0, 1), max_size=40), st.lists(st.integers(0, 1), max_size=40))
def test_lcp(a, b):
    key = lambda x: b"".join(bytes([v]) * prefix_trie.WIDTH for v in x)
    assert prefix_trie.lcp(key(a), key(b)) == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_sequences_and_rebuilding(spark):
    rng = random.Random(3)
    convs = {c: [(rng.choice("uas"), rng.choice("pq")) for _ in range(rng.randint(1, 11))] for c in rng.sample(range(60), 45)}
    rows = [(c, i if i else None, r, t) for c, i, r, t in rows_of(convs)] + [(None, 0, "u", "no conversation")] + [(70, 0, None, None), (70, 0, None, None), (70, 0, "", "")]
    convs[70] = [("", "")] * 3
    made = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(chats)), 20)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_version(made)


def test_ambiguous_turns_differ(spark):
    convs = {1: [("u", "1:ax")], 2: [("u1:a", "x")], 3: [("", "u")], 4: [("u", "")]}
    assert trie(spark, convs, 100) == plain_version(convs)


def test_very_long_text(spark):
    convs = {1: [("u", "é" * 2_000_000), ("a", "x")], 2: [("u", "é" * 2_000_000)], 3: [("u", "é" * 2_000_000 + "!")]}
    assert trie(spark, convs, 2) == plain_version(convs)


def test_empty_table(spark):
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.sequences(chats)).collect() == []
