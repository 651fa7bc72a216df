"""Balance, indivisible groups and gapless slots."""

import random
import zlib

from lectern.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size string"


def test_differencing_places_every_part():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1000) for _ in range(500)]
    places = sharding.differencing([[s] + [0] * 7 for s in sizes])
    sums = [0] * 8
    for s, p in zip(sizes, places, strict=True):
        assert sorted(p) == list(range(8))
        sums[p[0]] += s
    assert max(sums) - min(sums) <= 2


def test_differencing_beats_greedy():
    parts = [[8], [7], [6], [5], [4]]
    places = sharding.differencing([[p[0], 0] for p in parts])
    sums = [sum(p[0] for p, q in zip(parts, places, strict=True) if q[0] == k) for k in (0, 1)]
    assert abs(sums[0] - sums[1]) == 2


def check(rows, got):
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, *_ in rows}
    shards = {}
    for r in got:
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        shards.setdefault(r["shard"], []).append(r)
    for k, x in shards.items():
        assert 0 <= k < 8 and sorted(r["slot"] for r in x) == list(range(len(x)))
    by_text = {}
    for r in got:
        by_text.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    return [sum(r["size"] for r in shards.get(k, [])) for k in range(8)]


def test_documents(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.choice(["", None, "é" * rng.randint(0, 50), "copy" * 5, "x" * rng.randint(0, 900)]), "a", "b") for i in range(600)]
    sums = check(rows, sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect())
    assert max(sums) - min(sums) <= 64
    monkeypatch.setattr(sharding, "LEAF", 60)
    monkeypatch.setattr(sharding, "LARGE", 100)
    monkeypatch.setattr(sharding, "RUN", 10)
    again = check(rows, sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect())
    assert max(again) - min(again) <= 0.05 * sum(again) / 8


def test_leaves_fill_up_what_large_groups_leave(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(sharding, "LEAF", 100)
    monkeypatch.setattr(sharding, "LARGE", 300)
    rows = [(i, "copy " * 9, "a", "b") for i in range(500)] + [(1000 + i, "x" * rng.randint(0, 400) + str(i), "a", "b") for i in range(1500)]
    sums = check(rows, sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect())
    assert max(sums) - min(sums) <= 0.01 * sum(sums) / 8


def test_few_rows(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    got = sharding.shard(spark.createDataFrame([(None, "a", "", ""), (None, "a", "", ""), (1, "a", "", "")], SCHEMA)).collect()
    assert sorted(r["slot"] for r in got) == [0, 1, 2] and len({r["shard"] for r in got}) == 1


def test_very_long_text_and_hot_group(spark, monkeypatch):
    monkeypatch.setattr("lectern.llm.common.HOT", 10)
    rows = [(0, "x" * 3_000_000, "", "")] + [(1 + i, "copy", "", "") for i in range(60)] + [(100 + i, f"t{i}" * (i % 7), "", "") for i in range(60)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    assert next(r["size"] for r in got if r["doc_id"] == 0) == 3_000_001
    assert len({r["shard"] for r in got if 1 <= r["doc_id"] <= 60}) == 1
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
