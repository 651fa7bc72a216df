"""Order-dependent operators and compositions on tiny tables."""

from pyspark.sql import functions as F

from lectern.operators import alignment as A
from lectern.operators import search as S
from lectern.operators import workflow as K


def test_borrowed_labels(spark):
    v = spark.createDataFrame([(1, "Matthew", 5, 5, "Blessed are the meek who inherit")], "id int, book string, chapter int, verse int, text string")
    t = spark.createDataFrame([("Matthew", 5, 3, "Blessed are the meek inherit", {0: ["G3107"], 3: ["G4239"]}), ("Matthew", 5, 5, "Other words here", {0: ["X"]}), ("Matthew", 6, 5, "Blessed are the meek who inherit", {0: ["Y"]})], "book string, chapter int, verse int, text string, tags map<int,array<string>>")
    assert [(r["position"], r["numbers"]) for r in A.borrowed_labels(v, t).orderBy("position").collect()] == [(0, ["G3107"]), (3, ["G4239"])]


def test_titles_in_step(spark):
    entries = [(1, {"LIBERTY", "PERSECUTION"}, "YOUNG"), (2, {"GATHERING", "SAINTS"}, "KIMBALL"), (3, {"FAITH", "WORKS"}, "YOUNG")]
    assert A.in_step([(10, {"GATHERING", "SAINTS"}, ""), (20, set(), "BY BRIGHAM YOUNG"), (30, {"LIBERTY", "PERSECUTION"}, "")], entries) == {2: 10, 3: 20}
    c = spark.createDataFrame([(1, 10, ["FAITH", "WORKS"], "x")], "volume long, place long, words array<string>, nearby string")
    e = spark.createDataFrame([(1, n, sorted(w), s) for n, w, s in entries], "volume long, number long, words array<string>, speaker string")
    assert [tuple(r) for r in A.aligned_titles(c, e).collect()] == [(1, 3, 10)]


def test_titles_in_step_reads_the_list_once():
    class Entries(list):
        reads = 0

        def __iter__(self):
            self.reads += 1
            return super().__iter__()

    entries = Entries((n, {f"A{n}", f"B{n}"}, "") for n in range(50))
    candidates = [(10 * n, {f"A{n}", f"B{n}"}, "") for n in range(50) if n % 3]
    assert A.in_step(candidates, entries) == {n: 10 * n for n in range(50) if n % 3}
    assert entries.reads <= 1


def test_link_spans(spark):
    links = {"Nephi": ("Nephi", "good"), "Anti-Nephi-Lehi": ("Anti-Nephi-Lehi", None), "Lehi": ("Lehi", "jaw")}
    v = spark.createDataFrame([(1, "Nephi and Anti-Nephi-Lehi of Lehi-Nephi"), (2, None)], "id int, text string")
    assert [(r["start"], r["target"], r["tip"]) for r in A.link_spans(v, links).orderBy("start").collect()] == [(0, "Nephi", "Nephi: good"), (10, "Anti-Nephi-Lehi", "Anti-Nephi-Lehi")]


def test_hybrid_with_and_without_vectors(spark):
    p = spark.createDataFrame([(1, "verse", "", "faith hope"), (2, "talk", "faith", "charity"), (3, "talk", "", "faith faith"), (4, "talk", "", "nothing"), (5, "note", "", "blank")], "doc int, kind string, heading string, body string")
    q = spark.createDataFrame([(100, "What is faith?")], "query int, text string")
    quotas = spark.createDataFrame([("talk", 1)], "kind string, quota int")
    words = K.hybrid(p, q, quotas, 5).orderBy("place").collect()
    assert sorted(r["kind"] for r in words) == ["talk", "verse"]
    v = spark.createDataFrame([(4, [1.0, 0.0]), (5, [0.9, 0.1])], "id int, v array<double>")
    qv = spark.createDataFrame([(100, [1.0, 0.0])], "query int, q array<double>")
    both = {r["doc"] for r in K.hybrid(p, q, quotas, 5, v, qv).collect()}
    assert 5 in both and 1 in both and len(both & {2, 3, 4}) == 1


def test_key_passages_avoid_overlaps(spark):
    topics = spark.createDataFrame([("q", "t1", 1), ("q", "t2", 2)], "query string, topic string, rank int")
    passages = spark.createDataFrame([("t1", 1, "A", 1, 1, 3), ("t1", 2, "A", 1, 3, 4), ("t2", 1, "A", 2, 1, 1), ("t2", 2, "B", 1, 5, 9)], "topic string, position int, book string, chapter int, first int, last int")
    found = spark.createDataFrame([("q", "B", 1, 9, 9)], "query string, book string, chapter int, first int, last int")
    got = K.key_passages(topics, passages, found).orderBy("place").collect()
    assert [(r["topic"], r["book"], r["chapter"], r["first"]) for r in got] == [("t1", "A", 1, 1), ("t2", "A", 2, 1)]


def test_answers_and_directions(spark):
    replies = spark.createDataFrame([("o", 'Try ["Alma 5:1", "Nobody 1:1"]')], "owner string, content string")
    verses = spark.createDataFrame([(1, "Alma", 5, 1, "one")], "volume_sort int, book_name string, chapter_number int, verse_number int, text string")
    aliases = spark.createDataFrame([], "alias string, book string")
    more = spark.createDataFrame([("o", 1, "x", "Alma 5:1"), ("o", 2, "y", "Moroni 7:1")], "owner string, rank int, id string, label string")
    assert [r["label"] for r in K.answered(replies, verses, aliases, more).orderBy("place").collect()] == ["Alma 5:1", "Moroni 7:1"]
    found = spark.createDataFrame([("q", 1, "Faith unto repentance"), ("q", 2, "Charity suffereth long"), ("q", 3, "Faith unto repentance again")], "query string, rank int, title string")
    assert [r["title"] for r in K.directions(found, "", lambda p: "[2]").collect()] == ["Charity suffereth long"]
    assert [r["title"] for r in K.directions(found, "", lambda p: "?").orderBy("place").collect()] == ["Faith unto repentance", "Charity suffereth long"]


def test_requests():
    r = K.Request(topic="faith", minutes=10, talk_title="The faith talk", directions=["hope"])
    assert r.limit() == 12 and r.questions() == ["faith", "The faith talk", "hope"]
    assert K.Request(reading="Isaiah 1", lesson=True, minutes=5).questions() == ["Isaiah 1"]


def test_sync_two_devices(spark):
    cols = "target string, v string, updated_at string, deleted_at string"
    local = spark.createDataFrame([("a", "mine", "2026-01-02", None), ("b", "keep", "2026-01-01", None)], cols)
    dev = spark.createDataFrame([("a", "same time", "2026-01-02", None, "f1", 0), ("b", "gone", "2026-01-03", "2026-01-03", "f1", 1), ("b", "older", "2026-01-02", None, "f2", 0), ("zz", "unknown", "2026-01-09", None, "f2", 1), ("c", "new", "2026-01-01", None, "f2", 2)], cols + ", file string, pos int")
    got = K.synced(local, dev, spark.createDataFrame([("a",), ("b",), ("c",)], "target string"))
    assert sorted((r["target"], r["v"], r["deleted_at"]) for r in got.collect()) == [("a", "mine", None), ("b", "gone", "2026-01-03"), ("c", "new", None)]


def test_calendar(spark):
    holy = spark.createDataFrame([(1, 1, "the Passover", 14, None), (1, 2, "Unleavened Bread", 15, 21), (7, 1, "the Trumpets", None, None)], "month int, place int, name string, first int, last int")
    d = spark.createDataFrame([(1, 1, 13), (2, 1, 14), (3, 1, 16), (4, 2, 1)], "id int, month int, day int")
    notes = {r["id"]: r["note"] for r in K.day_notes(d, holy).collect()}
    assert notes == {1: "The Passover falls 1 day later, on the 14th. Unleavened Bread falls 2 days later, on the 15th.", 2: "This is the day of the Passover. Unleavened Bread falls 1 day later, on the 15th.", 3: "This is during Unleavened Bread.", 4: ""}
    m = spark.createDataFrame([(1, ["Abib", "Nisan"], "spring")], "month int, names array<string>, season string")
    assert K.month_notes(m, holy).first()["note"] == "The 1st month (Abib; later Nisan) - spring\nthe Passover (14), Unleavened Bread (15-21)"


def test_results_labels_and_index_follow_edits(spark):
    hits = spark.createDataFrame([("q", 1, "verse", "k1"), ("q", 2, "note", "gone")], "query string, place int, kind string, key string")
    src = {"verse": spark.createDataFrame([("k1", "Alma 5:1", "now")], "key string, label string, text string"), "note": spark.createDataFrame([], "key string, label string, text string")}
    assert [(r["label"], r["text"]) for r in K.results(hits, src).collect()] == [("Alma 5:1", "now")]
    d = spark.createDataFrame([(1, "a b a"), (2, "b")], "id int, t string")
    p = S.postings(d, "id", "t")
    after = K.reindexed(p, spark.createDataFrame([(1, "c"), (2, None)], "id int, t string"), "id", "t")
    assert [(r["token"], r["doc"], r["tf"]) for r in after.collect()] == [("c", 1, 1)]
    assert d.select(K.labelled(F.col("t"), F.lit("jst"), {"jst": "JST"}).alias("l")).first()["l"] == "JST a b a"
    assert K.versioned("/x/", 2) == "/x/v2"
