"""Operators whose tasks' shares must not grow with the tables."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import analytics as A
from lectern.operators import hierarchy as H
from lectern.operators import merge as M
from lectern.operators import ranking as R
from lectern.operators import search as S
from lectern.operators import vectors as V
from lectern.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_cited_passages_against_brute_force(spark):
    rng = random.Random(3)
    verses = [(0, c * 100 + v, c, v, "a", f"b {c}:{v}") for c in range(14) for v in range(6)]
    cited = [(w, v[5]) for w in range(5) for v in rng.choices(verses, k=40 if w else 3)]
    got = H.cited_passages(spark.createDataFrame(cited, "work int, reference string"), spark.createDataFrame(verses, "volume_sort int, verse_id int, chapter_id int, verse_number int, volume_slug string, reference string"))
    at, expected = {v[5]: (v[2], v[3]) for v in verses}, []
    for w in range(5):
        own = sorted({at[r] for x, r in cited if x == w})
        first = [(c, v) for c, v in own if (c, v - 1) not in own]
        last = [(c, v) for c, v in own if (c, v + 1) not in own]
        expected += [(w, i + 1, c, a, b) for i, ((c, a), (_, b)) in enumerate(zip(first, last, strict=True)) if i < 8]
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_hits_stay_in_all_parts_when_a_selector_is_asked(spark):
    hits = spark.range(600).selectExpr("id DIV 3 AS query", "id AS doc", "id % 3 + 1 AS rank", "0 AS tier", "'t' AS label", "'' AS text")
    found = R.selected(hits, lambda prompt: "[3, 1]")
    assert sorted((r["doc"] % 3 + 1, r["place"]) for r in found.collect()) == [(1, 2)] * 200 + [(3, 1)] * 200
    assert parts(found) > int(spark.conf.get("spark.sql.shuffle.partitions")) // 2  # Spark made one part of all


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def parts(df) -> int:
    return df.withColumn("part", F.spark_partition_id()).agg(F.count_distinct("part")).first()[0]


def test_references_stay_in_all_parts_when_they_are_placed(shuffled):
    spark = shuffled
    verses = spark.range(2000).selectExpr("0 AS volume_sort", "id AS verse_id", "id AS chapter_id", "1 AS verse_number", "'a' AS volume_slug", "'b ' || id AS reference")
    placed = H.located(verses.selectExpr("verse_id AS work", "reference"), verses)
    assert parts(placed) == int(spark.conf.get("spark.sql.shuffle.partitions"))  # Spark made one part of all, they are so small
    assert placed.count() == 2000


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_balanced_hits_make_their_hits_once(spark):
    assert plan(catalog.QUERIES["balanced_hits"](spark, DATA)).count("lineitem.parquet") == 0  # each of five branches made them from the line items


def test_tokens_are_not_dealt_for_postings(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (1, "a"), (3, "")], "id int, t string")
    found = S.postings(docs, "id", "t")
    assert plan(found).count("Exchange") == 1 and "hashpartitioning(token" not in plan(found)
    assert sorted((r["token"], r["doc"], r["tf"], r["positions"]) for r in found.collect()) == [("a", 1, 2, [0, 1]), ("b", 1, 2, [0, 2])]


def test_texts_are_dealt_before_their_bigrams_are_counted(spark):
    found = A.bigrams(spark.createDataFrame([("a b a b",), ("b a b",), ("a",), (None,)], "text string").coalesce(1), X.tokens(F.col("text")), 2)
    assert "REPARTITION_BY_NUM" in plan(found)  # one task counted all
    assert sorted(tuple(r) for r in found.collect()) == [("a", "b", 3), ("b", "a", 2)]


def test_texts_to_embed_stay_in_all_parts(spark):
    pieces = spark.range(400).selectExpr("sha2(string(id % 300), 256) AS hash", "'text ' || id % 300 AS text")
    found = V.embed_pending(pieces, pieces.filter("text = 'text 7'").selectExpr("hash", "array(1f) AS vector"), lambda texts: [[3.0, 4.0] for _ in texts])
    assert parts(found) == int(spark.conf.get("spark.sql.shuffle.partitions"))  # Spark made one part of all
    rows = found.collect()
    assert len(rows) == len({r["hash"] for r in rows}) == 299 and all(abs(r["vector"][0] - 0.6) < 1e-6 for r in rows)


def dealt(spark, run) -> int:
    """Rows that were shuffled while `run` did its work."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None))
    old = {s.stageId() for s in stages()}
    run()
    return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in old)


def test_pairs_of_texts_with_a_common_word_are_dealt_once(shuffled):
    text = F.concat_ws(" ", F.lit("there"), F.concat(F.lit("a"), F.col("id")), F.concat(F.lit("b"), F.col("id")), F.concat(F.lit("c"), F.col("id")))
    rows = shuffled.range(300).select("id", F.floor(F.col("id") / 100).alias("book"), text.alias("text"))
    a, b, found = rows.toDF("id_a", "book", "text_a"), rows.toDF("id_b", "book", "text_b"), []
    assert dealt(shuffled, lambda: found.extend(M.most_shared(a, b, 3, ["book"]).collect())) < 2 * 300 * 100
    want = {i: [(i, 4), *[(j, 1) for j in range(i // 100 * 100, i // 100 * 100 + 3) if j != i][:2]] for i in range(300)}
    assert sorted(tuple(r) for r in found) == sorted((i, *w) for i, ws in want.items() for w in ws)


def test_titles_are_dealt_once(shuffled):
    title = F.translate((F.col("id") % 20 + 10).cast("string"), "0123456789", "bcdefghijk")
    many = shuffled.range(4000).select(F.floor(F.col("id") / 20).alias("owner"), "id", F.concat(title, F.lit(" "), title, F.lit("x")).alias("title")).withColumnRenamed("id", "rank")
    found = []
    assert dealt(shuffled, lambda: found.extend(R.themes(many).collect())) <= 4000
    assert len(found) == 4000 and {(r["owner"], r["place"]) for r in found} == {(o, p) for o in range(200) for p in range(1, 21)}


def test_titles_of_one_owner_are_cut_before_they_are_dealt(shuffled):
    same = shuffled.range(5000).selectExpr("1 AS owner", "id AS rank", "IF(id = 4999, 'gamma', 'alpha beta') AS title")
    found = []
    assert dealt(shuffled, lambda: found.extend(R.themes(same, step=5).collect())) < 200
    assert sorted((r["place"], r["title"]) for r in found) == [(1, "alpha beta"), (2, "gamma")]
