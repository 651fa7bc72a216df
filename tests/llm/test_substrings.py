"""Removed bytes against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest

from lectern.llm import substrings


def plain(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    out = []
    for i, t in rows:
        mark = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                mark[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        spans = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((i, len(t), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_bucket_pointers():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[200:300] = data[50:150]
    starts = np.arange(350)
    ids = substrings.buckets_of(data, starts)
    strings = [data[s : s + 50].tobytes() for s in starts]
    assert all((ids[a] == ids[b]) == (strings[a] == strings[b]) for a in range(0, 350, 3) for b in range(350))


@pytest.mark.parametrize("seed", range(3))
def test_documents(spark, monkeypatch, seed):
    rng = random.Random(seed)
    for name, value in (("PART", 3000), ("BUCKET", 50)):
        monkeypatch.setattr(substrings, name, value)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 140))) for _ in range(10)] + ["a" * 300, "ab" * 120, "x" * 49, "x" * 50, ""]
    rows = []
    for _ in range(120):
        parts = (rng.choice(base) for _ in range(rng.randint(0, 4)))
        rows.append((rng.randint(0, 90), "".join(b[rng.randint(0, len(b) // 3) :][: rng.randint(30, 200)] for b in parts)))
    rows += rows[:5]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, part string").repartition(3)
    got = sorted(map(tuple, substrings.drop_repeats(df).collect()))
    assert got == plain([(i, t.encode()) for i, t in rows])


def test_odd_rows(spark):
    long = "".join(chr(97 + i % 23) for i in range(60))
    rows = [(5, long), (None, long), (3, None), (3, ""), (9, "pre " + long + " post"), (2, "long text " * 30_000)]
    got = {r["doc_id"]: r for r in substrings.drop_repeats(spark.createDataFrame(rows[:3] + rows[4:], "doc_id long, text string"), with_text=True).collect()}
    assert got[5]["n_removed"] == 0 and got[None]["n_removed"] == 60 and bytes(got[9]["kept"]) == b"pre  post" and got[3]["n_bytes"] == 0 and got[2]["n_removed"] == 0
    assert substrings.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
