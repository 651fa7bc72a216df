"""Stages one by one against plain versions, and the registered queries."""

import pytest
from conftest import DATA, rows_of

import corpus_pipeline
from lectern.llm import decontam, mixing, queries, simhash, toxicity


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "decontamination", "mixing", "sharding"]
    stage = dict(corpus_pipeline.STAGES)

    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    a = stage["toxicity"](spark, docs, DATA)
    assert a.columns == docs.columns and {r["doc_id"] for r in a.collect()} == {r["doc_id"] for r in docs.collect()} - bad

    a = a.cache()
    text = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in a.collect()}
    own = {i: i for i in text}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in text:
        for j in text:
            if bin((text[i] ^ text[j]) & (1 << 64) - 1).count("1") <= 3:
                x, y = sorted((root(i), root(j)))
                own[y] = x
    b = stage["near duplicates"](spark, a, DATA)
    assert b.columns == docs.columns and sorted(r["doc_id"] for r in b.collect()) == sorted(i for i in own if own[i] == i)

    b = b.cache()
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    dirty = {r["doc_id"] for r in decontam.contamination(b, bench).filter("contaminated").collect()}
    c = stage["decontamination"](spark, b, DATA).cache()
    assert c.columns == docs.columns and {r["doc_id"] for r in c.collect()} == {r["doc_id"] for r in b.collect()} - dirty

    times = {r["doc_id"]: r["times"] for r in mixing.mix(c).collect()}
    d = stage["mixing"](spark, c, DATA).cache()
    got = {r["doc_id"]: r["n"] for r in d.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert d.columns == docs.columns and got == {i: n for i, n in times.items() if n}

    e = stage["sharding"](spark, d, DATA).collect()
    assert len(e) == d.count() and sorted(r["doc_id"] for r in e) == sorted(r["doc_id"] for r in d.collect())
    for k in {r["shard"] for r in e}:
        assert sorted(r["slot"] for r in e if r["shard"] == k) == list(range(sum(r["shard"] == k for r in e)))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, root string, term string, __id string"


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named like those that the stages use."""
    words = lambda seed, n: " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 5003}" for i in range(n))
    rows = [(i, words(i, 40 + i), "en", f"s{i % 3}", 5) for i in range(40)]
    rows += [(100 + i, words(3, 43), "en", "s0", 5) for i in range(5)]  # copies of one text
    rows += [(200, None, "en", "s1", None), (201, "", None, "s1", 0), (None, words(90, 50), "en", None, 1), (None, words(91, 50), "en", None, 1), (None, None, None, None, None)]
    rows += [(300, words(92, 60_000), "en", "s2", 5), (301, "one", "de", "s2", 3), (301, words(93, 30), "de", "s2", 3), (302, words(94, 30), None, None, None), (302, words(94, 30), None, None, None)]
    return [(*r, 7, "x", "y", "z", "q") for r in rows]


def table_folder(spark, path, docs, labels, bench):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_on_odd_rows(spark, tmp_path):
    rows = odd_rows()
    bench = [(1, rows[5][1]), (2, None), (None, "w1 w2"), (3, "")]
    d = table_folder(spark, tmp_path / "t", rows, [(i, 1, 0) for i in range(30)] + [(None, 0, 1), (31, None, None)], bench)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage, before = dict(corpus_pipeline.STAGES), rows
    key = lambda r: (r[0] is None, r[0], r[1])
    for name in ("toxicity", "near duplicates", "decontamination"):
        docs = stage[name](spark, docs, d).cache()
        now = [tuple(r) for r in docs.collect()]
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")] and set(now) <= set(before)
        gone = {key(r) for r in before} - {key(r) for r in now}
        if name == "toxicity":
            assert sorted(map(str, now)) == sorted(map(str, rows))  # nothing here is labelled toxic by its words
        elif name == "near duplicates":
            # a copy goes, as does one of all texts without words, and one of two equal rows; null ids and ids of several texts lose nothing else
            assert gone == {key(r) for r in rows if r[0] is not None and 100 <= r[0] < 105 or not r[1]} - {key(rows[45])}
            assert sum(r[0] == 302 for r in now) == 1 and sum(r[0] == 301 for r in now) == 2 and sum(r[0] is None for r in now) == 2
        else:
            assert gone == {key(rows[5])}
        before = now
    mixed = stage["mixing"](spark, docs, d).cache()
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= set(before)
    got = stage["sharding"](spark, mixed, d).collect()
    assert len(got) == mixed.count()
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


@pytest.mark.parametrize("case", ["no documents", "no labels and no benchmark", "nulls only"])
def test_run_on_empty_tables(spark, tmp_path, case):
    rows = [] if case == "no documents" else [(None,) * 10] * 3 if case == "nulls only" else odd_rows()
    full = case == "no documents"
    d = table_folder(spark, tmp_path / "t", rows, [(1, 1, 1), (2, 1, 0)] if full else [], [(1, "a b c")] if full else [])
    got = corpus_pipeline.run(spark, d)
    assert {"doc_id", "size", "shard", "slot"} <= set(got.columns)
    assert bool(got.count()) == (case == "no labels and no benchmark")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    if name == "op7_tokens":
        pytest.importorskip("public_tokenizers")
    got = queries.QUERIES[name](spark, DATA).toPandas()
    key = {"op3_html": "pages", "op5_chat": None, "op11_prefix_trie": None}.get(name, "documents")  # the last two give a row per conversation and node
    if key:
        assert len(got) == spark.read.parquet(f"{DATA}/{key}.parquet").count()
    if name in queries.ORACLES:
        assert rows_of(got) == rows_of(duck.execute(queries.ORACLES[name]).df())
