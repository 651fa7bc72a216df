"""Smaller operators on tiny tables."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators import records as R


def test_bootstrap_reads_old_and_missing_tables(spark, tmp_path):
    spark.createDataFrame([(1, "Bible")], "id int, name string").write.parquet(str(tmp_path / "volumes"))
    t = R.bootstrap(spark, str(tmp_path))
    assert t["volumes"].first()[:] == (1, "Bible", None, None) and t["books"].count() == 0 and set(t) == set(schemas.TABLES)


def test_texts(spark):
    v = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "c int, n int, t string")
    assert R.chapter_texts(v, "c", "n", "t").first()["text"] == "a\n\nb"
    d = spark.createDataFrame([("Known wrods and wrods",)], "t string")
    voc = spark.createDataFrame([("known",), ("and",)], "word string")
    assert [tuple(r) for r in R.unknown_words(d, "t", voc).collect()] == [("wrods", 2)]
    assert tuple(spark.createDataFrame([('"(word!',)], "t string").select(R.word_parts(F.col("t")).alias("p")).first()["p"]) == ('"(', "word", "!")
    junk = spark.createDataFrame([(1, "good " + "x. " * 8 + "text x. y"), (2, "x. " * 9), (3, "")], "id int, t string")
    assert {r["id"]: r["t"] for r in R.without_junk_runs(junk, "id", "t", r"^\w\.$").collect()} == {1: "good text x. y", 2: "", 3: ""}
    p = spark.createDataFrame([(1, 0, "a"), (1, 1, "--"), (1, 2, "b")], "d int, p int, t string")
    assert [r["next"] for r in R.next_real(p, "d", "p", "t", "^-+$").orderBy("p").collect()] == ["b", "b", None]


def test_counts(spark):
    v = spark.createDataFrame([("r1", "one two three"), ("r2", "four")], "ref string, text string")
    t = spark.createDataFrame([("r1", {0: ["H1"], 2: ["H2"]})], "ref string, tags map<int,array<string>>")
    assert tuple(R.tag_coverage(v, t).first()) == (4, 2, 0.5)
    c = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "chapter_id int, reference string")
    assert [tuple(r) for r in R.cited_verses(c, spark.createDataFrame([("a",), ("a",)], "reference string")).collect()] == [(1, 1)]


def test_hits(spark):
    h = spark.createDataFrame([("q", 1, "talk", None), ("q", 2, "verse", "k"), ("q", 3, "other", "m")], "query string, rank int, kind string, key_verse string")
    assert [r["kind"] for r in R.by_tier(h, {"verse": 0, "talk": 1}).orderBy("place").collect()] == ["verse", "talk", "other"]
    assert [r["rank"] for r in R.first_key_verses(h, 1).collect()] == [2]
    n = spark.createDataFrame([(1, "faith and hope", None), (2, "faith and hope", "2026"), (3, "x", None)], "id int, text string, deleted_at string")
    assert [r["doc"] for r in R.search_notes(n, spark.createDataFrame([(1, ["and", "hope"])], "query int, words array<string>")).collect()] == [1]


def test_vectors(spark):
    p = spark.createDataFrame([("h1",), ("h1",), ("h2",)], "content_hash string")
    v = spark.createDataFrame([("h2",)], "content_hash string")
    assert [r[0] for r in R.prepared(p, v, "m", "m")[0].collect()] == ["h1"] and R.prepared(p, v, "m2", "m")[0].count() == 2

    def broken(texts):
        raise OSError

    assert R.query_vector("a", broken) is None and R.query_vector("a", lambda t: [[1.0]]) == [1.0]


def test_tags_sessions_and_rebuilding(spark, tmp_path):
    tags = spark.createDataFrame([("Faith",)], "name string")
    have = spark.createDataFrame([("faith", "v1", "1", "2")], "tag string, target string, at string, deleted_at string")
    names, rows = R.tagged(tags, have, spark.createDataFrame([("FAITH", "v1", "3"), ("Hope", "v2", "3")], "name string, target string, at string"))
    assert sorted(r["name"] for r in names.collect()) == ["Faith", "Hope"]
    assert sorted((r["tag"], r["target"], r["deleted_at"]) for r in rows.collect()) == [("faith", "v1", None), ("hope", "v2", None)]
    old = spark.createDataFrame([("u", "t", "{}", "1")], "uid string, title string, data string, updated_at string")
    got = R.saved_sessions(old, spark.createDataFrame([("u", "new", "2", 5)], "uid string, title string, updated_at string, length int"))
    assert [tuple(r) for r in got.collect()] == [("u", "new", '{"length":5}', "2")]
    d = spark.createDataFrame([(1,)], "a int")
    assert R.rebuilt(d, spark.createDataFrame([("rule", 0)], "rule string, n int"), str(tmp_path / "t")).count() == 1
    with pytest.raises(ValueError, match="rule: 2"):
        R.rebuilt(d, spark.createDataFrame([("rule", 2)], "rule string, n int"), str(tmp_path / "t"))
    w = spark.createDataFrame([("A 1:1", ["u"])], "reference string, works array<string>")
    R.nested_update(spark, w, spark.createDataFrame([("B 1:1", ["v"])], "reference string, works array<string>"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_lexicon_rows(spark):
    e = spark.createDataFrame([("H1", "ab", "x", "p", "(Aramaic) y", " father ", "k"), ("H2", "b", "x", "p", None, "d", "k")], "strongs string, lemma string, xlit string, pron string, derivation string, strongs_def string, kjv_def string")
    g = spark.createDataFrame([("H1", ["a", "b", "c", "d", "e"])], "strongs string, glosses array<string>")
    got = {r["strongs"]: r for r in R.lexicon_rows(e, g, "hebrew").collect()}
    assert got["H1"]["gloss"] == "a; b; c; d" and got["H1"]["language"] == "aramaic" and got["H2"]["language"] == "hebrew" and got["H1"]["definition"] == "father"
    assert spark.range(1).select(R.overlap(F.lit(1), F.lit(3), F.lit(3), F.lit(4)).alias("o"), R.device_file(F.lit("x")).alias("f")).first()[:] == (True, "device-x.json")


@pytest.mark.parametrize("many", [True, False])
def test_what_cleaning_looks_up_is_never_broadcast(spark, monkeypatch, many):
    from lectern.plans import expressions

    if many:
        monkeypatch.setattr(R, "few", lambda rows: False)
    found = expressions.cleaned_verses(spark, DATA)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) is not many
    names = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    assert {r["p_partkey"]: r["text"] for r in found.collect()} == {k: n + {1: ";", 3: " O"}.get(k % 4, "") for k, n in names.items()}
