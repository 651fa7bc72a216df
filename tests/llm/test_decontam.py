"""Hits against a search of every place."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from lectern.llm import decontam

DOCS, ITEMS = "doc_id long, text string, words string, hits string", "item_id long, text string, win string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    out = []
    for i, t, *_ in docs:
        w, hit, ids = words(t), set(), set()
        for k, u, *_ in items:
            v = words(u)
            for win in ([v] if len(v) < 13 else [v[a : a + 13] for a in range(len(v) - 12)]) if v else []:
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids |= {str(k)} if k is not None else set()
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "É", "a1", "über", *(f"w{i}" for i in range(30))]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, some(rng.choice([1, 4, 13, 20])), "") for k in range(8)] + [(8, "", ""), (9, None, ""), (None, some(14), ""), (3, some(15), "")]
    docs = []
    for i in range(60):
        parts = [some(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            v = (rng.choice(items)[1] or "").split()
            parts += [" ".join(v[rng.randint(0, 2) :]).upper().replace("É", "É"), some(rng.randint(0, 200))]
        docs.append((i, ", ".join(parts), "", ""))
    docs += [(70, None, "", ""), (71, "", "", ""), (None, items[0][1], "", ""), docs[0]]
    return docs, items


def result(spark, docs, items):
    got = decontam.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).drop("text_hash")
    return sorted(map(tuple, got.collect()), key=str)


def test_hits(spark):
    docs, items = cases(1)
    assert result(spark, docs, items) == plain(docs, items)


def test_blocks_and_joins_without_broadcast(spark, monkeypatch):
    docs, items = cases(2)
    monkeypatch.setattr(decontam, "ANCHORS", 3)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    monkeypatch.setattr("lectern.llm.common.BROADCAST_ROWS", 0)
    assert result(spark, docs, items) == plain(docs, items)


def test_empty_tables_and_dropping(spark):
    docs, items = cases(3)
    d = spark.createDataFrame(docs, DOCS)
    assert all(not r["contaminated"] for r in decontam.contamination(d, spark.createDataFrame([], ITEMS)).collect())
    assert decontam.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    kept = decontam.drop_contaminated(d, spark.createDataFrame(items, ITEMS))
    assert kept.columns == d.columns
    clean = [r[0] for r in plain(docs, items) if not r[5]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick and very brown dog fox"), (3, "fox brown quick"), (4, "quick a b c brown fox")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "quick brown fox"), (2, "missing words")], "phrase_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.near_matches(d, p, 2).select("doc_id").distinct().collect()) == [1, 2]
    assert [r["doc_id"] for r in decontam.near_matches(d, p, 0).collect()] == [1]


def test_words_expression(spark):
    got = spark.createDataFrame([("ÉA b-C\x00d_9é ☃x",)], "t string").select(decontam.words(F.col("t")).alias("w")).first()["w"]
    assert got == words("ÉA b-C\x00d_9é ☃x")


def test_very_long_text_and_short_items(spark):
    """One-word, two-word and thirteen-word items share their rarest words, so reaches differ."""
    long = " ".join(f"w{i % 997}" for i in range(120_000))
    item = " ".join(f"w{i}" for i in range(5, 30))
    docs = [(1, long + " solo end", "", ""), (2, "solo", "", ""), (3, "w1 w2 w4", "", ""), (4, "end of w29 solo solo", "", "")]
    items = [(1, item, ""), (2, "solo", ""), (3, "solo end", ""), (4, "w2 w4", ""), (5, "w2", "")]
    assert result(spark, docs, items) == plain(docs, items)
