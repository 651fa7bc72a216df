"""The chain against sums over all label sequences, and accuracy on rows that the fit hasn't seen."""

import itertools
import random

import numpy as np
import pytest

from lectern.llm import toxicity

MODEL = toxicity.Model({"bad": 2.0, "vile*": 1.0}, frozenset({"bad", "vile"}), -1.0, 0.3, ((0.0, -0.5), (0.2, 0.7)), (-2.0, 4.0, 1.0))


@pytest.mark.parametrize("text", ["a", "bad", "a bad b", "vilest bad x y bad", "a b c d e f"])
def test_marginals_by_enumeration(text):
    words = text.split()
    move, total, on = MODEL.move, 0.0, np.zeros(len(words))
    for labels in itertools.product((0, 1), repeat=len(words)):
        s = sum(MODEL.words.get(toxicity.entry_of(w, MODEL.words), -1.0) for w, y in zip(words, labels, strict=True) if y)
        s += 0.3 * labels[0] + sum(move[a][b] for a, b in zip(labels, labels[1:], strict=False))
        total += np.exp(s)
        on += np.exp(s) * np.array(labels)
    assert MODEL.marginals(words) == pytest.approx(on / total)


def test_quiet_texts_need_no_chain_of_their_own():
    kept = {}
    for n in (0, 1, 3, 64, 65, 200):
        words = ["x"] * n
        assert MODEL.score(words, kept)[0] == pytest.approx(MODEL.score(words)[0])


def corpus(seed, n=900):
    rng = random.Random(seed)
    calm = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rude, stems = ["idiot", "scum", "moron"], ["grobx", "vilzo"]
    rows = []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.2
        for _ in range(2 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(rude) if i % 2 else rng.choice(stems) + rng.choice(calm))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) >= 0.97
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got.values())
    spans = toxicity.spans(spark.createDataFrame([(1, "Ela IDIOT, ela grobxela!"), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [("Ela IDIOT, ela grobxela!"[s["start"] : s["end"]]) for s in spans[0]["spans"]] == ["IDIOT", "grobxela"] and spans[1]["spans"] == []


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(got) == 4 and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in got)
    only = spark.createDataFrame([(1, 1), (1, None), (2, 1), (None, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs.limit(0), toxicity.train(docs, only)).count() == 0


def test_a_very_long_text(spark):
    texts = [(1, "calm words here " * 100_000), (2, "calm words here " * 50_000 + "bad vilest bad " + "calm words here " * 50_000)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), MODEL).collect()}
    assert 0 <= got[1] < got[2] <= 1


def test_pieces_are_drawn_from_all_texts(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "SEQUENCES", 40)
    chain = toxicity._fit_chain
    monkeypatch.setattr(toxicity, "_fit_chain", lambda *a: (seen.append(a), chain(*a))[1])
    monkeypatch.setattr(toxicity, "STEPS", 2)
    texts = [f"{w} n{i} " + f"{w} words " * 23 for w, n in (("vile", 100), ("foul", 100), ("nice", 200)) for i in range(n)]
    toxicity.fit(texts, [1] * 200 + [0] * 200)
    rows = seen[0][0]
    marked = [set(r[r > 0].tolist()) for r in rows if r.any()]
    assert len(marked) == 40 and len(set().union(*marked)) >= 2


def test_recall_on_held_out_rows_of_the_supplied_table(spark):
    """Of the held-out toxic rows at this scale one in sixteen has no toxic word at all, so no more than 0.94 can be found by text."""
    from pathlib import Path

    data = Path("/root/testdata/sf0.1")
    if not data.is_dir():
        pytest.skip("no table of this scale")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.score(known, toxicity.train(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9 and n.get((0, 1), 0) <= 0.01 * n[1, 1]
