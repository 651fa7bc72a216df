"""Common lines go, all others stay; the perfect hash answers for its keys and turns others away."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import lines


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 200_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    high, low = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
    high[: n // 3] = 7  # halves may be equal, pairs not
    counts = rng.integers(1, 100_000, n)
    made = lines.PerfectHash.unpacked(*lines.PerfectHash.build(high, low, counts).packed())
    assert made.count(high, low).tolist() == np.minimum(counts, 65535).tolist()
    assert len(made.prints) == len(made.counts) == n and int(np.bitwise_count(made.bits).sum()) == n  # minimal
    assert not made.count(rng.integers(0, 1 << 64, 5000, dtype=np.uint64), rng.integers(0, 1 << 64, 5000, dtype=np.uint64)).any()
    if n >= 1000:
        assert len(made.bits) * 8 < 6 * n


def plain_version(rows, least=10, shortest=1):
    white, lower = " \t\n\v\f\r", str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(white).translate(lower)
    held = Counter(k for _, text in rows for k in {key(line) for line in (text or "").split("\n")})
    common = {k for k, n in held.items() if n >= least and len(k) >= shortest}
    out = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        kept = [line for line in own if key(line) not in common]
        out.append((doc_id, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def corpus():
    rows = [(1, ""), (2, None), (2, None), (None, "no id\nÀ common"), (3, "\n\n \t\n"), (4, "\r\nonly here\r\n\v")]
    rows += [(i, f"own line {i}\n  Common LINE \t\nnine of these\nÄ" if i < 109 else f"x{i % 4}\ncommon line\nä\n{i}\ncommon line") for i in range(100, 140)]
    rows += [(i, "copied\nwhole text") for i in range(200, 215)] + [(300, "once\n" * 30), (301, "common line\n" * 20_000 + "end")]
    rows += [(i, f" joined \na\x85b\n\x1cnot stripped\x1c\nnot stripped{i % 2}") for i in range(400, 412)]
    return rows


@pytest.mark.parametrize("resident", [1 << 20, 0])
@pytest.mark.parametrize(("least", "shortest"), [(10, 1), (2, 3), (1, 1), (10_000, 1), (10, 11)])
def test_common_lines(spark, resident, least, shortest):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("n_lines"), F.lit(1).alias("name"), F.lit(2).alias("shard")).repartition(4)
    found = lines.drop_common_lines(docs, least, shortest, resident=resident, shard=4 if resident else 2).collect()
    assert sorted(map(tuple, found), key=repr) == plain_version(rows, least, shortest)


def test_shards_and_rounds(spark, monkeypatch):
    rows = [(i, "\n".join(f"line {j}" for j in range(i % 50, 900, 7))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = lines.line_counts(docs)
    index, shards, size = lines.line_index(counts, 10, shard=64)
    held = Counter(line for _, t in rows for line in set(t.split("\n")))
    assert shards == -(-sum(n >= 10 for n in held.values()) // 64) and index.count() == shards and size > 0
    arrays = lines.Arrays([(r[0], *map(bytes, r[1:])) for r in index.collect()], shards)
    names = [*held, "absent", ""]
    assert arrays.counts([lines._hash(k.encode()) for k in names]).tolist() == [n if (n := held[k]) >= 10 else 0 for k in names]
    assert {(r.n) for r in counts.collect()} == set(held.values())


@pytest.mark.parametrize("resident", [1 << 20, 0])
def test_empty_table(spark, resident):
    assert lines.drop_common_lines(spark.createDataFrame([], "doc_id long, text string"), resident=resident).collect() == []
