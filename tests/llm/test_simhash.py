"""Fingerprints and components against plain loops."""

import random

import numpy as np
import pytest
import xxhash

from lectern.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Smallest id reachable over links, by flooding."""
    left, out = set(range(len(fps))), {}
    while left:
        seen = todo = {min(left)}
        while todo:
            todo = {j for i in todo for j in left - seen if bin(fps[i][1] ^ fps[j][1]).count("1") <= 3}
            seen = seen | todo
        for i in seen:
            out[i] = min((fps[k][0] for k in seen if fps[k][0] is not None), default=None)
        left -= seen
    return [out[i] for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, "a", "a b", "A b C", "Éa b\tc\nd e f g", "x " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain(text)


def near(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randint(0, 99)}"
    return " ".join(words)


def test_components(spark):
    rng = random.Random(7)
    bases = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(400)) for _ in range(4)]
    rows = [(i, near(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 3])), "", "") for i in range(150)] + [(200, "", "", ""), (201, None, "", ""), (None, bases[0], "", ""), (7, rows_text := bases[1], "", "")]
    assert rows_text
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "fp", "component_id").collect()), key=str)
    fps = [(r[0], plain(r[1])) for r in rows]
    signed = [int(np.uint64(f).astype(np.int64)) for _, f in fps]
    want = sorted(((i, f, c) for (i, _), f, c in zip(fps, signed, components(fps), strict=True)), key=str)
    assert got == want


def test_crowded_buckets_keep_all_links(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(simhash, "PAIRED", 3)
    center = rng.getrandbits(64)
    values = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(30)}
    values = [int(np.uint64(v).astype(np.int64)) for v in values]
    edges = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in edges)
    own = {v: v for v in values}

    def root(v):
        while own[v] != v:
            v = own[v]
        return v

    for a, b in edges:
        own[root(a)] = root(b)
    for a in values:
        for b in values:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                assert root(a) == root(b)
    assert len(edges) < 66 * len(values)


def test_drop_keeps_one_of_each(spark):
    rng = random.Random(1)
    base = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(300))
    rows = [(5, base, "a", "x"), (3, base, "b", "y"), (3, base, "b", "y"), (9, near(rng, base, 1), "c", "z"), (4, "other text here now", "d", "w"), (None, "only this one", "e", "v")]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "fp", "component_id"]
    kept = [r["doc_id"] for r in got.collect()]
    assert sorted(kept, key=str) == sorted([3, 4, None], key=str)
    assert simhash.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_drop_keeps_components_without_ids_of_their_own(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(300)) for _ in range(5)]
    rows = [(None, texts[0], "", ""), (None, texts[1], "", ""), (None, texts[1], "", ""), (7, texts[2], "", ""), (7, texts[3], "", ""), (None, texts[4], "", ""), (8, texts[4], "", "")]
    got = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4])], key=str)
