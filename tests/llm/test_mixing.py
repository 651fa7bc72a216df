"""Mixing against water-filling by a loop, and the mix's rules."""

import random
import re

import pytest

from lectern.llm import mixing

SCHEMA = "doc_id long, text string, source string, extra string, size string"


def table(spark, n, seed, sources=5):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 20, 400]))), None if (s := rng.randint(0, sources)) == 0 else f"s{s}", "x", "y") for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def filled(sizes):
    """Targets by dealing the excess again and again."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while free > 1e-9 and open_:
        unit, full = free / sum(weight[s] for s in open_), set()
        free = 0.0
        for s in open_:
            target[s] += unit * weight[s]
            if target[s] >= 3 * sizes[s]:
                free += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                full.add(s)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken(spark, seed):
    rows, df = table(spark, 400, seed)
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    sizes, largest = {}, {}
    for i, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
        largest[s] = max(largest.get(s, 0), size[i])
    target, taken = filled(sizes), {}
    for i, _, s, *_ in rows:
        r = got[i]
        assert (r["size"], r["source_size"]) == (size[i], sizes[s]) and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * size[i] and r["taken"] == r["size"] * r["times"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_small_sources_stop_at_three_times(spark):
    df = spark.createDataFrame([(1, "a b", "a", "", ""), (2, "c " * 1000, "b", "", ""), (3, None, "b", "", "")], SCHEMA)
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert got[1]["taken"] == 6 and got[2]["taken"] == 1000 and got[2]["target"] == pytest.approx(996) and got[3]["size"] == 0


def test_apply_repeats_rows_with_their_columns(spark):
    rows, df = table(spark, 200, 9)
    times = {r["doc_id"]: r["times"] for r in mixing.mix(df).collect()}
    got = mixing.apply_mix(df)
    assert got.columns == df.columns
    found = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert found == {i: t for i, t in times.items() if t}


def test_empty_repeated_and_null_ids(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c", "a", "", ""), (1, "a b", "a", "", ""), (1, "a b", "a", "", ""), (2, "", None, "", "")], SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == 4 and len({r["taken"] for r in got if r["doc_id"] == 1}) == 1


def test_more_sources_than_may_be_broadcast(spark, monkeypatch):
    from lectern.llm import common

    _, df = table(spark, 150, 4)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()} == want
