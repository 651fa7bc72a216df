"""Operators on tiny tables."""

import random
import re
from collections import Counter
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import alignment as L
from lectern.functions import cleaning as C
from lectern.functions import text as X
from lectern.operators import analytics as A
from lectern.operators import hierarchy as H
from lectern.operators import merge as M
from lectern.operators import passages as P
from lectern.operators import quality as Q
from lectern.operators import ranking as R
from lectern.operators import search as S
from lectern.operators import vectors as V
from lectern import schemas


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


# hierarchy


def test_verses_wide_keeps_books_without_testament(spark):
    v = spark.createDataFrame([(1, "Bible", "bible", 1)], "id long, name string, slug string, sort_order int")
    t = spark.createDataFrame([(5, 1, "Old", "ot", 1)], "id long, volume_id long, name string, slug string, sort_order int")
    b = spark.createDataFrame([(7, 1, 5, "Isaiah", 1), (8, 1, None, "Extra", 2)], "id long, volume_id long, testament_id long, name string, sort_order int")
    c = spark.createDataFrame([(9, 7, 13), (10, 8, 1)], "id long, book_id long, chapter_number int")
    c = schemas.conform(c, "chapters")
    x = spark.createDataFrame([(1, 9, 1, "a", "Isaiah 13:1"), (2, 10, 1, "b", "Extra 1:1")], "id long, chapter_id long, verse_number int, text string, reference string")
    got = schemas.verses_wide(v, t, b, c, x)
    assert rows(got, "verse_id", "book_name", "volume_slug") == [(1, "Isaiah", "bible"), (2, "Extra", "bible")]
    assert got.filter("verse_id = 2").first()["testament"] is None


def test_both_sides_counts_a_loop_once(spark):
    e = spark.createDataFrame([(1, 1, 2), (2, 3, 3), (3, 4, None)], "id int, a int, b int")
    got = H.both_sides(e, ["a"], ["b"], ["id"]).select("id", F.col("from.k0").alias("f"), F.col("to.k0").alias("t"))
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 3, 3), (3, 4, None), (3, None, 4)], "id int, f int, t int").collect()))


def test_lookup_and_names(spark):
    names = spark.createDataFrame([(1, "Nephi", "good", ["Nephi's", "Nephites"]), (2, "Nephi", "other", None)], "id int, name string, meaning string, forms array<string>")
    assert rows(H.spelling_links(names), "spelling", "meaning") == [("Nephi", "other"), ("Nephi's", "good"), ("Nephites", "good")]
    found = H.lookup_ci(names, "name", spark.createDataFrame([("NEPHI",)], "wanted string"), "id")
    assert rows(found, "lookup", "id") == [("nephi", 1)]


def test_range_text_drops_what_is_not_there(spark):
    v = spark.createDataFrame([("a", 1, "one"), ("a", 3, "three"), ("b", 1, "x")], "book string, v int, text string")
    r = spark.createDataFrame([(1, "a", 1, 3), (2, "a", 3, None), (3, "c", 1, 2)], "id int, book string, first int, last int")
    assert rows(H.range_text(v, r, ["book"], "v", "text"), "id", "n", "text") == [(1, 2, "one three"), (2, 1, "three")]


def test_reading_block(spark):
    books = spark.createDataFrame([("Isaiah",), ("1 John",), ("John",), ("Job",)], "name string")
    lines = spark.createDataFrame([(1, "Isaiah 13-14; 22"), (2, "1 John 2"), (3, "Is. 400-500"), (4, "")], "id int, text string")
    got = H.reading_block(lines, books)
    assert rows(got.filter("id < 3"), "id", "book", "chapter") == [(1, "Isaiah", 13), (1, "Isaiah", 14), (1, "Isaiah", 22), (2, "1 John", 2)]
    assert got.filter("id = 3").count() == 61 and got.filter("id = 4").count() == 0


def test_masks_and_settings(spark):
    p = spark.createDataFrame([(1, "verse", "bible"), (2, "note", None), (3, "verse", "hidden")], "id int, kind string, volume_slug string")
    assert rows(H.masked(p, volumes=["bible"]), "id") == [1]
    assert rows(H.masked(p, without=("hidden",)), "id") == [1, 2]
    s = spark.createDataFrame([("a", "x")], "key string, value string")
    keys = spark.createDataFrame([("a", "d"), ("b", "d")], "key string, default string")
    assert rows(H.setting(s, keys), "key", "value") == [("a", "x"), ("b", "d")]


def test_literal_substring(spark):
    d = spark.createDataFrame([("100% sure",), ("100 percent",)], "t string")
    assert d.filter(H.contains_literal("t", "0% S")).count() == 1


# analytics


def test_fit_tiers_equals_dropping_one_by_one(spark):
    rng = random.Random(5)
    for _ in range(6):
        counts = {t: rng.randint(0, 9) for t in range(rng.randint(1, 4))}
        limit = rng.randint(0, 20)
        want = dict(counts)
        while sum(want.values()) > limit:
            top = max(want.values())
            want[min(t for t, n in want.items() if n == top)] -= 1
        got = A.fit_tiers(spark.createDataFrame(list(counts.items()), "tier long, n long"), limit)
        assert {r["tier"]: r["kept"] for r in got.collect()} == want


def test_streak_today_yesterday_and_broken(spark):
    days = [(1, "2024-01-09"), (1, "2024-01-10"), (2, "2024-01-08"), (2, "2024-01-09"), (3, "2024-01-07"), (1, "2024-01-10")]
    d = spark.createDataFrame(days, "u int, d string").withColumn("d", F.to_date("d"))
    today = spark.createDataFrame([("2024-01-10",)], "today string").select(F.to_date("today").alias("today"))
    assert rows(A.streak(d, "u", "d", today), "u", "streak") == [(1, 2), (2, 2), (3, 0)]


def test_merge_lists_checks_both_keys(spark):
    d = spark.createDataFrame([("q", 1, 10, "a"), ("q", 2, 11, "a"), ("q", 3, 11, "b"), ("q", 4, 10, "c"), ("q", 5, 12, "d")], "owner string, rank int, id int, label string")
    assert rows(A.merge_lists(d, 2), "place", "id", "label") == [(1, 10, "a"), (2, 11, "b")]


def merged(items, gap, limit):
    kept = []
    for a, b in items:
        if limit and len(kept) >= limit:
            break
        k = next((k for k in kept if k[0] <= b + gap and a <= k[1] + gap), None)
        if k:
            k[0], k[1] = min(k[0], a), max(k[1], b)
        else:
            kept.append([a, b])
    return [tuple(k) for k in kept]


def test_merge_intervals_against_a_loop(spark):
    rng = random.Random(2)
    for gap, limit in ((1, None), (0, 3), (2, 2)):
        cases = {o: [(a, a + rng.randint(0, 4)) for a in (rng.randint(1, 30) for _ in range(8))] for o in range(5)}
        d = spark.createDataFrame([(o, i, a, b) for o, x in cases.items() for i, (a, b) in enumerate(x)], "owner int, rank int, first int, last int")
        got = {}
        for r in A.merge_intervals(d, gap=gap, limit=limit).orderBy("owner", "place").collect():
            got.setdefault(r["owner"], []).append((r["first"], r["last"]))
        assert got == {o: merged(x, gap, limit) for o, x in cases.items()}


def test_ranges_months_and_sentences(spark):
    r = spark.createDataFrame([(1, 3, 5, 5, 2), (2, 4, 7, 4, 9)], "id int, first int, start int, last int, end int")
    assert [tuple(x) for x in A.split_range(r).orderBy("id", "line").collect()] == [(1, 3, 5, None), (1, 4, 0, None), (1, 5, 0, 2), (2, 4, 7, 9)]
    m = spark.createDataFrame([(1, "2023-11-15", "2024-02-01")], "id int, a string, b string").select("id", F.to_date("a").alias("first"), F.to_date("b").alias("last"))
    assert rows(A.months(m), "year", "month") == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]
    s = spark.createDataFrame([(1, 0, "It was"), (1, 1, "so. "), (1, 2, "Then"), (1, 3, "Ends.")], "d int, p int, t string")
    assert rows(A.joined_sentences(s, "d", "p", "t"), "t") == ["Ends.", "It was so. ", "Then"]


def test_diff_and_pending(spark):
    o = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    n = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert rows(A.diff(o, n, "k", "v"), "k", "change") == [(1, "delete"), (2, "update"), (4, "insert")]
    p = spark.createDataFrame([(1, "x", 3), (2, "x", 3), (3, "y", 5)], "id int, hash string, n_chars int")
    v = spark.createDataFrame([("y",)], "hash string")
    assert rows(A.pending(p, v), "hash", "first_id") == [("x", 1)]
    assert tuple(A.index_status(p, v).first()) == (3, 2, 1, 3)


# search


def docs(spark):
    return spark.createDataFrame([(1, "faith and hope", "faith is hope"), (2, "works", "Nephi's faith works"), (3, "", "nothing here"), (4, None, "hope hope hopeful")], "id int, h string, b string")


def test_search_any_weights_and_lengths(spark):
    import math

    ix = S.indexed(docs(spark), "id", {"h": 0.2, "b": 1.0})
    got = {r["doc"]: r["score"] for r in S.search_any(ix, spark.createDataFrame([(1, "faith")], "query int, term string")).collect()}
    avg = (6 + 5 + 2 + 3) / 4
    idf = max(math.log((4 - 2 + 0.5) / (2 + 0.5)), 1e-6)
    want = {1: idf * 1.2 * 2.2 / (1.2 + 1.2 * (0.25 + 0.75 * 6 / avg)), 2: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / avg))}
    assert got == pytest.approx(want)


def test_phrase_and_prefix(spark):
    ix = S.indexed(docs(spark), "id", {"h": 0.2, "b": 1.0})
    p = S.search_phrase(ix, spark.createDataFrame([(1, ["nephi", "s"]), (2, ["hope", "hope"]), (3, ["hope", "faith"])], "query int, words array<string>"))
    assert rows(p, "query", "doc") == [(1, 2), (2, 4)]
    q = S.search_prefixes(ix, spark.createDataFrame([(1, "hop")], "query int, prefix string"), 3)
    assert rows(q, "doc") == [1, 4]


def test_keywords_snippets_and_tokens(spark):
    assert one(spark, X.keywords(F.col("t"), 3), t="What is the Faith of faith's men, and THE hope?") == ["faith", "faith's", "men"]
    assert one(spark, X.keywords(F.col("t"), 3, possessive=True), t="What is the Faith of faith's men, and hope") == ["faith", "faith", "men"]
    assert one(spark, X.tokens(F.col("t")), t="Élan d'être_x") == ["elan", "d", "etre", "x"]
    long = "word " * 100 + "hidden treasure " + "more " * 50
    s = one(spark, X.snippet(F.col("t"), ["treasure"]), t=long)
    assert s.startswith("… ") and "treasure" in s and s.endswith(" …")
    assert one(spark, X.snippet(F.col("t"), ["x"]), t=" short\n text ") == "short text"


def test_lexicon_search_ranks(spark):
    made = [("H1", "hebrew", "love, x", "", ""), ("G25", "greek", "to love", "", ""), ("H2", "hebrew", "beloved", "love", ""), ("G9", "greek", "a glove", "gloves", "love"), ("H7", "aramaic", "deep love", "x", ""), ("H8", "hebrew", "glove", "", "")]
    e = spark.createDataFrame(made, "strongs string, language string, gloss string, kjv_renderings string, transliteration string")
    found = lambda text, **more: [r["strongs"] for r in S.lexicon_search(e, spark.createDataFrame([(1, text)], "query int, text string"), **more).orderBy("rank").collect()]
    assert found("love") == ["H1", "G25", "H2", "H7", "G9"] and found("Loveth") == ["H1", "G25", "H2", "H7", "G9"]
    assert found("love", preferred="greek") == ["G25", "G9", "H1", "H2", "H7"]
    assert found(" g0025 ") == ["G25"] and found("of a") == [] and found("deep love") == ["H7"] and found("one two three four") == []
    assert S.roots("blessings") == ["blessing", "blesse", "bless"] and S.roots("loveth") == ["love", "lov"] and S.roots("seth") == []


# passages


def looped(lengths, most=3, chars=20):
    out = []
    for i, n in enumerate(lengths, 1):
        if out and out[-1][2] < most and out[-1][3] + n <= chars:
            w = out[-1]
            out[-1] = (w[0], i, w[2] + 1, w[3] + n, n)
        elif out and out[-1][4] + n <= chars:
            out.append((out[-1][1], i, 2, out[-1][4] + n, n))
        else:
            out.append((i, i, 1, n, n))
    return [(w[0], w[1], w[3]) for w in out]


def test_windows_with_a_character_cap(spark):
    rng = random.Random(1)
    cases = {c: [rng.randint(1, 25) for _ in range(9)] for c in range(6)}
    d = spark.createDataFrame([(c, i, "x" * n) for c, x in cases.items() for i, n in enumerate(x, 1)], "c int, v int, t string")
    got = {}
    for r in P.windows(d, "c", "v", "t", 3, 20).orderBy("c", "window").collect():
        got.setdefault(r["c"], []).append((r["first"], r["last"], r["n_chars"]))
    assert got == {c: looped(x) for c, x in cases.items()}


def test_packing_keeps_all_words():
    text = "\n\n".join(["Short one.", "A sentence. " * 300, "x" * 4500, "Last."])
    parts = P.packed(text)
    assert all(len(p) <= 2000 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert P.packed("") == [] and P.packed(None) == []
    assert [len(p) for p in P.packed(" ".join(["y" * 99 + "."] * 30))] == [1110, 1919]
    assert [len(p) for p in P.packed("z" * 4000 + "\n" + "w" * 1199 + "\n" + "v" * 799 + "\nu")] == [2000, 2000, 2000, 1]


# vectors


def test_cosine_guards(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r["c"], 4) for r in d.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.7071, 0.0, 0.0]


def test_embedding_halves_waits_and_gives_up():
    waits, seen = [], []

    def call(texts):
        seen.append(len(texts))
        if len(seen) == 1:
            raise V.Retry(3)
        if len(texts) > 2 or texts == ["bad"]:
            raise V.TooLarge
        return [[float(len(t))] for t in texts]

    assert V.embed_batch(["a", "bb", "ccc", "bad"], call, waits.append) [:2] == [[1.0], [2.0]]
    assert waits == [3]

    def never(texts):
        raise V.Retry

    with pytest.raises(V.Retry):
        V.embed_batch(["a"], never, waits.append)
    assert len(waits) == 1 + V.ATTEMPTS - 1 and max(waits) <= V.LONGEST_WAIT
    assert V.embed_batch(["bad"], call, waits.append) == [None]


def test_embedding_only_what_is_new(spark):
    p = spark.createDataFrame([("h1", "a b"), ("h1", "a b"), ("h2", "c")], "hash string, text string")
    v = spark.createDataFrame([("h2",)], "hash string")
    embed = V.hashed_words(8)
    got = V.embed_pending(p, v, lambda texts: [embed(t) for t in texts]).collect()
    assert [r["hash"] for r in got] == ["h1"] and sum(x * x for x in got[0]["vector"]) == pytest.approx(1, abs=1e-5)


# ranking


def test_fusion_ties_go_by_the_first_list(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query int, doc string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "query int, doc string, rank int")
    assert [r["doc"] for r in R.fused(a, b).orderBy("rank").collect()] == ["y", "x", "z"]


def test_selection_distinguishes_none_empty_and_unusable(spark):
    d = spark.createDataFrame([(1, "take [2, 2, 9, 1]", 3), (2, "[]", 3), (3, "sorry", 3)], "id int, content string, n int")
    assert {r["id"]: r["picks"] for r in R.parsed_selection(d).collect()} == {1: [1, 0], 2: [], 3: None}


def test_resolved_drops_inventions_and_keeps_order(spark):
    v = spark.createDataFrame([(1, "Alma", 5, 1, "one"), (1, "Alma", 5, 3, "three"), (2, "Alma", 5, 1, "late"), (1, "Moroni", 7, 1, "m")], "volume_sort int, book_name string, chapter_number int, verse_number int, text string")
    asked = spark.createDataFrame([("q", 1, "Moroni 7:1"), ("q", 2, "Nobody 3:4"), ("q", 3, "Alma 5:1-3"), ("q", 4, "Moroni 7:1"), ("q", 5, "Mor. 7")], "owner string, rank int, text string")
    aliases = spark.createDataFrame([("mor", "moroni")], "alias string, book string")
    got = [tuple(r) for r in R.resolved(asked, v, aliases).orderBy("place").collect()]
    assert got == [("q", 1, "Moroni 7:1", "m"), ("q", 2, "Alma 5:1-3", "one three"), ("q", 3, "Mor. 7", "m")]


def test_themes_drop_near_repeats(spark):
    t = spark.createDataFrame([("o", 1, "Faith and Works"), ("o", 2, "Works of Faith"), ("o", 3, "Charity"), ("o", 4, "the hope"), ("o", 5, "Charity Never Faileth")], "owner string, rank int, title string")
    assert [r["title"] for r in R.themes(t, "hope").orderBy("place").collect()] == ["Faith and Works", "Charity"]


def greedy(titles, topic=""):
    def words(text):
        return {re.sub("('s|s)$", "", w) for w in re.findall("[a-z']+", text.lower()) if w not in X.THEME_STOPWORDS}

    kept = []
    for t in titles:
        own = words(t) - words(topic)
        if own and not any(len(own & k) * 2 >= min(len(own), len(k)) for _, k in kept):
            kept.append((t, own))
    return [t for t, _ in kept]


@pytest.mark.parametrize("step", [1, 4, 200])
def test_themes_against_brute_force(spark, step):
    rng = random.Random(8)
    listed = {o: [" ".join("word" + rng.choice("abcdefghijklmnopqrstuvw"[:n]) for _ in range(rng.randint(1, 4))) for _ in range(90)] for o, n in ((None, 20), ("few", 4), ("x", 12), ("many", 23))}
    listed["long"] = [f"{a}{b} {b}{a}x" for a in "abcdefghijklm" for b in "nopqrtuvwy"] * 5  # more than 500 titles, 130 of them accepted
    t = spark.createDataFrame([(o, i, x) for o, l in listed.items() for i, x in enumerate(l)], "owner string, rank int, title string")
    got = R.themes(t, "worda", step).orderBy("place").collect()
    assert {o: [r["title"] for r in got if r["owner"] == o] for o in listed} == {o: greedy(l, "worda") for o, l in listed.items()}
    assert len(greedy(listed["long"])) == 130


HIT = "query string, doc string, kind string, tier int, rank int, chapter long, first long, last long, title string, speaker string, topic string"


def hit(doc, chapter=None, first=None, last=None, kind="scripture", title="", speaker="", topic=None):
    return doc, kind, {"scripture": 0, "talk": 1, "article": 2}.get(kind, 3), chapter, first, last, title, speaker, topic


def balance(spark, chosen, candidates=(), favored=(), limit=10, question=""):
    """The places as doc or, of passages, doc first-last."""
    frame = lambda hits: spark.createDataFrame([("q", h[0], h[1], h[2], i, *h[3:]) for i, h in enumerate(hits, 1)], HIT)
    got = R.balanced(frame(chosen), frame(candidates), limit, spark.createDataFrame([("q", question)], "query string, text string"), frame(favored)).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, len(got) + 1))
    return [r["doc"] if r["first"] is None else f"{r['doc']} {r['first']}-{r['last']}" for r in got]


def test_balance_appends_what_is_too_long_to_merge(spark):
    assert balance(spark, [hit("a", 1, 1, 8), hit("b", 1, 10, 15)]) == ["a 1-8", "b 10-15"]


def test_balance_skips_an_overlap(spark):
    assert balance(spark, [hit("a", 1, 1, 5), hit("b", 1, 3, 7)]) == ["a 1-5"]


def test_balance_fills_up_from_what_was_chosen(spark):
    ten = [hit(f"s{i}", i, 1, 2) for i in range(10)]
    assert balance(spark, ten) == [f"s{i} 1-2" for i in range(10)]
    talks = [hit(f"t{i}", kind="talk", title=f"talk {i}") for i in range(10)]
    assert balance(spark, talks) == [f"t{i}" for i in range(10)]
    assert balance(spark, ten + talks) == [f"s{i} 1-2" for i in range(6)] + [f"t{i}" for i in range(4)]
    assert balance(spark, ten[:2] + talks) == ["s0 1-2", "s1 1-2"] + [f"t{i}" for i in range(8)]
    assert balance(spark, ten + talks, limit=1) == ["s0 1-2"]


def test_balance_merges_near_passages_in_place(spark):
    near = [hit("a", 1, 1, 1), hit("x", 2, 1, 1), hit("b", 1, 4, 5), hit("c", 1, 8, 10), hit("d", 1, 13, 13), hit("e", None, 1, 2), hit("f", None, 1, 2)]
    assert balance(spark, near) == ["a 1-10", "x 1-1", "d 13-13", "e 1-2", "f 1-2"]
    assert balance(spark, [hit("a", 1, 1, 1), hit("b", 1, 5, 5)]) == ["a 1-1", "b 5-5"]


def test_balance_order_of_trust(spark):
    named, other = hit("n", 4, 1, 2, topic="Hope"), hit("k", 3, 1, 2, topic="Charity")
    loose, reading, pick = hit("l", 9, 1, 1), hit("r", 5, 1, 1), hit("p", 6, 1, 1)
    assert balance(spark, [pick], [loose, other, named], [reading], question="What of hope?") == ["n 1-2", "r 1-1", "k 1-2", "p 1-1"]
    assert balance(spark, [pick], [loose, other, named], [reading], limit=3, question="What of hope?") == ["n 1-2", "r 1-1", "p 1-1"]


def test_balance_reprints_and_minimums(spark):
    talk, reprint = hit("t", kind="talk", title="Faith", speaker="A"), hit("r", kind="article", title=" faith ", speaker="a")
    assert balance(spark, [hit("j", kind="discourse", title="x"), reprint, talk]) == ["t", "j"]
    assert balance(spark, [hit("r", kind="article", title="F", speaker="A"), hit("s", kind="article", title="F", speaker="A")]) == ["r", "s"]  # no talk is reprinted
    own = [hit("c", kind="talk", title="Hope's great faith"), hit("d", kind="talk", title="hope alone"), hit("e", kind="article", title="HOPE and faith"), hit("g", kind="article", title="hope faith")]
    assert balance(spark, [], own, question="faith, hope?") == ["c", "e"]
    assert balance(spark, [], own, question="the hope") == ["c", "d", "e"]
    assert balance(spark, [], own, question="the") == []
    both = [hit("t", kind="talk", title="hope", speaker="A"), hit("e", kind="article", title="Hope", speaker="A")]
    assert balance(spark, [], both, question="hope") == ["t"]
    assert balance(spark, [both[1]], both[:1], question="hope") == ["t", "e"]  # the article was there first


def test_selector_falls_back_by_tier(spark):
    hits = spark.createDataFrame([("q", i, i, 0 if i < 7 else 1, f"l{i}", "t") for i in range(1, 12)], "query string, doc int, rank int, tier int, label string, text string")
    chosen = R.selected(hits, lambda prompt: "[3, 1]").orderBy("place").collect()
    assert [r["doc"] for r in chosen] == [3, 1]
    fallback = R.selected(hits, lambda prompt: "cannot say").orderBy("place").collect()
    assert [r["doc"] for r in fallback] == [1, 2, 3, 4, 7, 8]


# merge


def test_last_write_wins_ties_and_tombstones(spark):
    t = datetime(2026, 1, 1)
    d = spark.createDataFrame([("k", None, t, "a", 1, "x", None), ("k", None, t, "b", 1, "y", t), ("k", 1, t, "a", 1, "z", None)], "a string, b int, at timestamp, file string, pos int, v string, deleted_at timestamp")
    state = M.last_write_wins(d, ["a", "b"], "at", "file", "pos")
    assert {(r["b"], r["v"]) for r in state.collect()} == {(None, "y"), (1, "z")}
    assert [r["v"] for r in M.live(state).collect()] == ["z"]


def test_merge_local_wins_ties_and_is_order_free(spark):
    local = spark.createDataFrame([("k", 5, "mine"), ("l", 1, "old")], "k string, at int, v string")
    other = spark.createDataFrame([("k", 5, "theirs"), ("l", 2, "new"), ("m", 1, "more")], "k string, at int, v string")
    once = M.merge_into(local, other, ["k"], "at")
    assert rows(once, "k", "v") == [("k", "mine"), ("l", "new"), ("m", "more")]
    assert rows(M.merge_into(once, other, ["k"], "at"), "k", "v") == rows(once, "k", "v")


def test_mirror_upsert_and_refresh(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, 3, "c")], "k int, j int, v string")
    up = spark.createDataFrame([(1, None, "A"), (4, None, "d")], "k int, j int, v string")
    assert rows(M.upserted(old, up, ["k", "j"]), "k", "v") == [(1, "A"), (2, "b"), (3, "c"), (4, "d")]
    assert rows(M.mirrored(old, up, ["k", "j"]), "k") == [1, 4]
    keep = spark.createDataFrame([(3, 3)], "k int, j int")
    assert rows(M.mirrored(old, up, ["k", "j"], keep), "k") == [1, 3, 4]
    assert rows(M.mirrored(old, up, ["k", "j"], mirror=False), "k") == [1, 2, 3, 4]
    new = spark.createDataFrame([(1, None, None), (2, None, "B")], "k int, j int, v string")
    assert rows(M.refreshed(old, new, "k", "v"), "k", "v") == [(1, "a"), (2, "B"), (3, "c")]


def test_spans_follow_text():
    old, new = "the quick brown fox", "the very quick red fox"
    a, b = L.moved(old, new, 4, 9)
    assert new[a:b] == "quick"
    a, b = L.moved(old, new, 16, 19)
    assert new[a:b] == "fox"
    assert L.moved("abc def", "abc", 4, 7) is None
    assert L.moved("abcXYZ", "abcQQXYZ", 0, 3) == (0, 5) and L.moved("abc", "abcQQ", 0, 3) == (0, 3)
    assert L.moved("", "ab", 0, 0) == (0, 2) and L.moved("ab", "ab", 1, 9) == (1, 2) and L.moved("abXcd", "abYYcd", 2, 3) == (2, 4)


def test_nearest_text_finds_the_moved_verse(spark):
    a = spark.createDataFrame([(1, "and it came to pass that nephi spake"), (2, "zzz yyy")], "id_a int, text_a string")
    b = spark.createDataFrame([(10, "and it came to pass that nephi spoke"), (11, "wholly other words")], "id_b int, text_b string")
    assert rows(M.nearest_text(a, b, 0.7), "id_a", "id_b") == [(1, 10)]
    marks = spark.createDataFrame([(7, 1), (8, 2)], "id int, target int")
    assert rows(M.rehomed(marks, M.nearest_text(a, b, 0.7)), "id", "target", "unplaced") == [(7, 10, False), (8, 2, True)]


def test_candidates_by_words_of_thousands_of_rows(spark):
    a = spark.createDataFrame([(1, "alpha beta gamma")], "id_a int, text_a string")
    b = spark.range(9000).select(F.col("id").alias("id_b"), F.when(F.col("id") < 2100, "alpha beta gamma").otherwise(F.concat(F.lit("w"), "id")).alias("text_b"))
    assert rows(M.nearest_text(a, b, 0.5), "id_a", "id_b", "ratio") == [(1, 0, 1.0)]


@pytest.mark.parametrize("step", [1, 3, 8, 2000])
def test_candidates_against_brute_force(spark, step):
    rng = random.Random(5)
    text = lambda: " ".join("w" + chr(97 + min(int(rng.expovariate(0.08)), 60) // 10) + chr(97 + min(int(rng.expovariate(0.5)), 9)) for _ in range(rng.randint(1, 9)))
    a, b = [(i, text()) for i in range(25)], [(i, text()) for i in range(120)]
    b += [(200 + i, b[i % 3][1]) for i in range(30)]
    words = {i: set(t.split()) for i, t in b}
    df = Counter(w for ws in words.values() for w in ws)
    want = []
    for i, t in a:
        sums = {k: round(sum(1 / df[w] for w in ws & set(t.split()) if df[w] < len(b) / 4), 12) for k, ws in words.items()}
        want += [(i, k) for k in sorted((k for k in sums if sums[k]), key=lambda k: (-sums[k], k))[:4]]
    got = M.candidates(spark.createDataFrame(a, "id_a int, text_a string"), spark.createDataFrame(b, "id_b int, text_b string"), 4, step)
    assert rows(got, "id_a", "id_b") == sorted(want)


def test_candidates_stay_in_their_book(spark):
    a = spark.createDataFrame([(1, "x", "rare word")], "id_a int, book string, text_a string")
    b = spark.createDataFrame([(i, "xy"[i % 2], "rare word" if i < 2 else f"other {'abcdefghijkl'[i]}") for i in range(12)], "id_b int, book string, text_b string")
    assert rows(M.parallels(a, b, book=["book"]), "id_a", "id_b", "ratio") == [(1, 0, 1.0)]


def test_word_repairs():
    known = C.Known({w: 30 for w in ("together", "the", "house", "to", "time", "clothes", "king", "of")})
    assert C.rejoined(["to", "get", "her."], known) == ["together."]
    assert C.rejoined(["(king-", "of"], known) == ["(king-", "of"]
    assert C.rejoined(["the", "house"], known) == ["the", "house"]
    assert C.rejoined(["the", "house"], C.Known(known.counts | {"thehouse": 2}), "a thehouse b") == ["thehouse"]
    assert C.rejoined(["the", "house"], C.Known(known.counts | {"thehouse": 20})) == ["thehouse"]
    assert C.rejoined(["the", "house"], C.Known(known.counts | {"thehouse": 20, "the house": 1})) == ["the", "house"]
    assert C.without_junk("the house ; | , clothe?, J_ ki^ng of,, « xx/".split(), known) == ["the", "house;", "clothes,", "king", "of,", "xx/"]
    assert C.corrected(["The", "HCUSE,", "0", "time"], known, "the house a time") == ["The", "HOUSE,", "O", "time"]
    assert C.corrected(["time", "j", "of"], known, "time of") == ["time;", "of"]
    assert C.unconfused(["tirne", "Tirne,", "time"], known) == ["time", "Time,", "time"]
    assert C.unconfused(["hoe"], C.Known({"hee": 20, "hoc": 199})) == ["hoe"] and C.unconfused(["hoe"], C.Known({"hee": 20, "hoc": 200})) == ["hoc"]
    assert L.transferred("In the beginning God".split(), [("beginning", ["H7225"]), ("God", ["H430"])]) == {2: ["H7225"], 3: ["H430"]}
    assert C.clean_verse("tbe h ouse | 1", known) == "the house I" and C.unknown("the hxuse of", known) == ["hxuse"]


@given(st.lists(st.sampled_from("the ho use tirne house ; | , cl othe?, J^l ki^ng of,, « 0 j wid- get x/y JL".split()), max_size=9), st.sampled_from(["", "the house of time", "O the king"]))
@settings(max_examples=300, deadline=None)
def test_lookups_name_all_that_the_rules_ask(tokens, parallel):
    counts = {w: 30 for w in "the house time clothes king of widget othe jl".split()} | {"the house": 3, "ho use": 1}
    text = " ".join(tokens)
    asked = set(C.lookups(text, parallel))
    few = C.Known({w: n for w, n in counts.items() if w in asked})
    assert C.clean_verse(text, few, parallel) == C.clean_verse(text, C.Known(counts), parallel)
    assert C.clean_title(text, few) == C.clean_title(text, C.Known(counts))


# expressions


@pytest.mark.parametrize(("text", "want"), [("XIV", 14), ("mcmxc", 1990), ("IIII", None), ("", None), ("A", None)])
def test_roman(spark, text, want):
    assert one(spark, X.roman(F.col("t")), t=text) == want


def test_references(spark):
    got = lambda t: one(spark, X.reference_parts(F.col("t")), t=t)
    assert tuple(got("1 Nephi 3:7")) == ("1 Nephi", 3, 7, None)
    assert tuple(got("Alma 32:21-23")) == ("Alma", 32, 21, 23)
    assert tuple(got("D&C 4")) == ("D&C", 4, None, None)
    assert got("no reference") is None
    assert one(spark, X.range_label(F.lit("Alma"), F.lit(5), F.lit(1), F.lit(1)), t=1) == "Alma 5:1"


def test_dates(spark):
    d = spark.createDataFrame([("April 2020", "preached October 7, 1855 at noon")], "m string, t string").select(
        X.month_year(F.col("m")).cast("string").alias("m"), X.iso_date(F.col("t")).alias("t"), X.first_saturday(X.month_year(F.col("m"))).cast("string").alias("s"),
        X.era_label(X.month_year(F.col("m"))).alias("e"), X.month_year(F.lit("someday")).alias("n"),
    )
    assert tuple(d.first()) == ("2020-04-01", "1855-10-07", "2020-04-04", "Ensign", None)
    due = lambda a, b: one(spark, X.due_text(F.to_date(F.lit(a)), F.to_date(F.lit(b))), t=1)
    assert due("2024-01-02", "2024-01-01") == "expires in 1 day" and due("2024-01-01", "2024-01-01") == "expires today" and due("2024-01-01", "2024-01-04") == "expired 3 days ago"


def test_urls_tags_and_scrubbing(spark):
    assert one(spark, X.canonical_url(F.col("t")), t="http://WWW.Example.org/a/?utm_x=1&page=2&ref=z#top") == "https://example.org/a/?page=2"
    tags = one(spark, X.word_tags(F.col("t")), t="3:H7225 9:H853,H5414")
    assert tags == {3: ["H7225"], 9: ["H853", "H5414"]}
    assert one(spark, X.tagged_text(X.word_tags(F.col("t"))), t="3:H7225 9:H853,H5414") == "3:H7225 9:H853,H5414"
    assert one(spark, X.strongs(F.col("t")), t="h0430 and G25") == ["H430", "G25"]
    assert one(spark, X.strongs(F.col("t")), t="h0001000001, G000 and H00000000012345678901") == ["H1000001", "G0", "H12345678901"]
    assert one(spark, X.title_words(F.col("t")), t="aßung oﬃce ŉabc straße, ending") == ["UNG", "ABC", "STRA", "ENDING"]
    assert one(spark, X.scrubbed(F.col("t")), t=r"at /home/ann/x and C:\Users\Bob\y") == r"at ~/x and ~\y"
    phrases = one(spark, X.date_phrases(F.col("t")), t="On the tenth day of the first month")
    assert [(p["day"], p["month"]) for p in phrases] == [(10, 1)]


# quality


def test_gates(spark):
    e = spark.createDataFrame([("H1", "a"), ("H2", " ")], "strongs string, gloss string")
    assert Q.lexicon_gate(e, 2).first()["accepted"] is False
    want = spark.createDataFrame([("a", 2), ("b", 1)], "k string, n long")
    have = spark.createDataFrame([("a",), ("a",), ("c",)], "k string")
    assert rows(Q.expected_counts(have, "k", want).fillna(-1), "k", "n", "found") == [("b", 1, 0), ("c", -1, 1)]
    f = spark.createDataFrame([(1, 3, 5), (4, 2, 5), (0, 1, 5), (2, 9, 5), (2, None, 5)], "a int, b int, n int")
    assert [r["e"] for r in f.select(Q.range_error(F.col("a"), F.col("b"), F.col("n")).alias("e")).collect()] == [None, "reversed", "below one", "beyond the end", None]


def test_scores(spark):
    r = spark.createDataFrame([(1, 1), (2, 7), (3, None), (4, 20)], "query int, rank int")
    assert tuple(Q.retrieval_scores(r).first()) == (4, 0.25, 0.5, round((1 + 1 / 7) / 4, 6))


def test_own_spellings_are_no_misreadings(spark):
    clean = spark.createDataFrame([("behold", 40), ("faith", 500), ("hebrew", 19), ("known", 1)], "word string, n long")
    own = ["Bchold"] * 3 + ["bebold"] * 3 + ["Hebrcw"] * 3 + ["Zarahem"] * 3 + ["Liahonas"] * 3 + ["lehite"] * 2 + ["behclds"] * 3 + ["shortt"] + ["known"] * 9 + ["Listed"] + ["four"] * 5 + ["bchoids"] * 3
    texts = spark.createDataFrame([(" ".join(own[:20]),), (" ".join(own[20:]),), (None,), ("",)], "t string")
    listed = spark.createDataFrame([(" listed",), ("FOUR",), ("absent",), ("bchold",)], "word string")
    found = lambda **more: {(r["word"], r["n"]) for r in A.own_spellings(texts, "t", clean, C.CONFUSED, **more).collect()}
    plain = {("hebrcw", 3), ("zarahem", 3), ("liahonas", 3), ("behclds", 3), ("bchoids", 3)}  # bchold and bebold are one confusion from behold
    assert found() == plain
    assert found(dictionary=listed) == plain | {("listed", 1), ("bchold", 3)}
    assert found(common=19) == plain - {("hebrcw", 3)}
    swaps = lambda w: one(spark, A.one_swap(F.col("w"), C.CONFUSED), w=w)
    for w in ("rnin", "Jeff's", "x", "bcel1"):
        assert sorted(swaps(w)) == sorted(set(C.swaps(w)))


def test_corrections_and_signs_by_each_rule(spark):
    known = C.Known({w: 30 for w in "the house king time of clothes faith".split()})
    assert C.without_junk("; the ?! , . king; .".split(), known) == ["the?,", "king;"]
    assert C.without_junk("?! the".split(), known) == ["?!", "the"]
    assert C.without_junk("king,, J_ : | ho/use /x/ x^y".split(), known) == ["king,:", "house", "/x/", "x^y"]
    assert C.corrected("tne HCUSE 12 x kimg".split(), known, "the house of a king") == ["the", "HOUSE", "of", "x", "king"]
    assert C.corrected("time, j b of j".split(), known, "time, of") == ["time,", "of;"]
    assert C.corrected("a b c".split(), known, "") == ["a", "b", "c"] and C.corrected([], known, "the") == []


@pytest.mark.parametrize(("ahead", "most"), [(1, 1), (2, 3), (3, 10), (50, 3)])
def test_most_shared_words_against_brute_force(spark, ahead, most):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choice(words[: rng.choice([3, 10, 40])]) for _ in range(rng.randint(0, 12)))
    a = [(i, "xy"[i % 2], text()) for i in range(60)] + [(60, "x", None), (61, "z", "w1")]
    b = [(i, "xy"[i % 2], text()) for i in range(80)] + [(80 + i, "x", "w0 w1 w2  w3") for i in range(30)] + [(200, "y", None)]
    found = M.most_shared(spark.createDataFrame(a, "id_a int, k string, text_a string"), spark.createDataFrame(b, "id_b int, k string, text_b string"), most, ["k"], ahead)
    got = {}
    for r in found.collect():
        got.setdefault(r["id_a"], set()).add((r["id_b"], r["shared"]))
    split = lambda t: set((t or "").split())
    want = {}
    for i, k, t in a:
        shared = sorted((-len(split(t) & split(u)), j) for j, g, u in b if g == k and split(t) & split(u))
        if shared:
            want[i] = {(j, -n) for n, j in shared[:most]}
    assert got == want
