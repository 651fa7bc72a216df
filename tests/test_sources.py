"""Readers, writers and streams on small files."""

import json
import random
import zipfile

from pyspark.sql import functions as F

from lectern.operators import merge as M
from lectern.sources import readers as S
from lectern.sources import sinks as K
from lectern.streaming import incremental as I


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_hierarchy_json(spark, tmp_path):
    data = {"volumes": [{"name": "Bible", "slug": "bible", "sort_order": 1, "testaments": [{"name": "Old", "slug": "ot", "sort_order": 1, "books": ["Genesis", "Exodus"]}]}, {"name": "Book", "slug": "b", "sort_order": 2, "books": ["Alma"]}]}
    (tmp_path / "v.json").write_text(json.dumps(data))
    got = S.hierarchy(spark, str(tmp_path / "v.json"))
    assert rows(got.fillna(""), "volume", "testament", "book", "book_sort") == [("Bible", "Old", "Exodus", 2), ("Bible", "Old", "Genesis", 1), ("Book", "", "Alma", 1)]


def test_verse_lines_reject_but_go_on(spark):
    lines = spark.createDataFrame([("Gen 1:1\tIn the beginning",), ("rubbish",), ("Nowhere 1:1 x",), ("",)], "value string")
    ok, bad = S.verse_lines(lines, spark.createDataFrame([("Genesis",)], "name string"), spark.createDataFrame([("Gen", "Genesis")], "alias string, book string"))
    assert rows(ok, "book", "chapter", "verse", "text") == [("Genesis", 1, 1, "In the beginning")]
    assert rows(bad, "value", "reason") == [("Nowhere 1:1 x", "unknown book"), ("rubbish", "unreadable")]


def test_markup_and_zip(spark, tmp_path):
    usfm = "\\id TOB\n\\c 1\n\\p Prologue text\n\\p\n\\s1 [A GREEK HEADING]\n\\ms1 First verse\n\\v 1 First \\f + note\\f*verse\n\\add more\\add*\nand on\n\\v 2 “Second”\n\\c 2\n\\p A prayer\n\\v 1 Again"
    got = S.parse_usfm(usfm)
    assert [(v["chapter"], v["verse"], v["text"], v["title"]) for v in got] == [(0, 1, "Prologue text", "A Greek heading · First verse"), (1, 1, "First verse and on", None), (1, 2, '"Second"', None), (2, 1, "Again", "A prayer")]
    again = S.parse_usfm("\\c 6\n\\s1 The epistle\n\\s1 Because of the sins which ye have committed before\n\\v 1 Because of the sins which ye have committed before God")
    assert [(v["chapter"], v["title"]) for v in again] == [(6, "The epistle")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.usfm", usfm)
        z.writestr("skip.txt", "no")
    assert rows(S.zip_members(spark, str(tmp_path / "a.zip"), r"\.usfm$"), "member") == [("x.usfm",)]
    d = spark.createDataFrame([('\\w In|strong="H7225"\\w* the \\w beginning|lemma="x" strong="H1,H2"\\w*',)], "t string")
    assert [(w["word"], w["numbers"]) for w in S.tagged_words(d, "t").first()["words"]] == [("In", ["H7225"]), ("beginning", ["H1", "H2"])]


def test_paragraph_sources(spark, tmp_path):
    (tmp_path / "l.txt").write_text("One\nline.\n\n\nTwo.\n")
    assert rows(S.blank_line_paragraphs(spark, str(tmp_path / "l.txt")), "pos", "text")[0] == (0, "One line.")
    (tmp_path / "d.xml").write_text("<B><OBJECT><PARAGRAPH><LINE><WORD>a</WORD><WORD>b</WORD></LINE></PARAGRAPH><PARAGRAPH><WORD>c</WORD></PARAGRAPH></OBJECT></B>")
    assert rows(S.xml_paragraphs(spark, str(tmp_path / "d.xml")), "pos", "text") == [(0, "a b"), (1, "c")]
    (tmp_path / "j.jsonl").write_text('{"volume":1,"title":"t","paragraphs":["a"]}\n{"volume":99,"paragraphs":["b"]}\n{"error":"x","volume":1}\n')
    assert S.discourses(spark, str(tmp_path / "j.jsonl")).count() == 1


def test_marked_verses_and_boundaries():
    got = S.marked_verses("CHAPTER IV.\n1 First verse 2 Second 77 not a verse\nmore 3 Third\nCHAPTER 5\n1 Again")
    assert [(v["chapter"], v["verse"], v["text"]) for v in got] == [(4, 1, "First verse"), (4, 2, "Second 77 not a verse more"), (4, 3, "Third"), (5, 1, "Again")]
    assert S.boundaries([1, 3, 6, 7, 20]) == [1, 6, 20]


def test_dictionaries(spark):
    js = spark.createDataFrame([('// c\nvar x = {"H1": {"lemma": "ab", "kjv_def": "father"}};',)], "value string")
    assert rows(S.js_dictionary(js), "strongs", "lemma", "kjv_def") == [("H1", "ab", "father")]
    tsv = spark.createDataFrame([(0, "H0001a\t\t\t\t\t\tfather"), (1, "H0001b\t\t\t\t\t\tchief"), (2, "H0001\t\t\t\t\t\tfather"), (3, "G1\t\t\t\t\t\tx"), (4, "H99999\t\t\t\t\t\ty")], "pos int, value string")
    assert [(r["strongs"], r["glosses"]) for r in S.glosses(tsv, "H", 8674).collect()] == [("H1", ["father", "chief"])]


def test_pages(spark):
    html = '<html><head><meta property="og:title" content="A &amp; B"><title> My\n page</title></head><a href="/b">b</a><a href=\'/a\'>a</a><a href="/a#x">c</a><a href="/scriptures/ot/gen/1?lang=eng&amp;id=p1-p3">G</a><a href="/scriptures/ot/gen/2">H</a></html>'
    p = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert p.select(S.page_title(F.col("html")).alias("t"), S.page_meta(F.col("html"), "og:title").alias("m")).first()[:] == ("My page", "A & B")
    assert S.page_links(p, "html", "scriptures").first()["links"] == ["/a", "/b"]
    refs = [(r["book"], r["chapter"], r["verse"]) for r in S.article_references(p, "html").collect()]
    assert sorted(refs, key=str) == [("gen", 1, 1), ("gen", 1, 2), ("gen", 1, 3), ("gen", 2, None)]


def test_feeds_weeks_and_logs(spark):
    xml = "<rss><item><title><![CDATA[New &amp; old]]></title><link>http://x</link><dc:creator>Ann</dc:creator><pubDate>Mon, 04 Mar 2024 10:00:00 GMT</pubDate></item><item><title>2</title></item></rss>"
    f = spark.createDataFrame([(1, xml), (2, "garbage")], "id int, xml string")
    got = S.first_feed_item(f, "xml").collect()
    assert [(r["id"], r["title"], r["author"], str(r["published"])) for r in got] == [(1, "New & old", "Ann", "2024-03-04 10:00:00")]
    w = spark.createDataFrame([("a", 2024, "March 4-10"), ("b", 2024, "March 25–April 7"), ("c", 2024, "nonsense"), ("d", 2024, "December 30-January 5")], "title string, year int, span string")
    assert rows(S.current_week(w, F.to_date(F.lit("2024-04-01"))), "title") == [("b",)]
    assert rows(S.current_week(w, F.to_date(F.lit("2025-01-02"))), "title") == [("d",)]
    logs = spark.createDataFrame([("f", 0, "=== start"), ("f", 1, "x"), ("f", 2, "=== start"), ("f", 3, "y")], "file string, pos int, value string")
    assert rows(S.log_sessions(logs, "^==="), "pos", "session") == [(0, 1), (1, 1), (2, 2), (3, 2)]


def test_services(spark):
    r = spark.createDataFrame([('{"tag_name":"v1.2.10","html_url":"u"}',), ('{"tag_name":"nightly"}',), ("x",)], "body string")
    assert rows(S.releases(r, "body"), "tag_name", "html_url") == [("v1.2.10", "u")]
    m = spark.createDataFrame([('{"data":[{"id":"embed-1"},{"id":"chat-2"}]}',)], "body string")
    assert [x["model"] for x in S.model_list(m, "body").collect()] == ["chat-2", "embed-1"]
    e = spark.createDataFrame([('{"data":[{"index":1,"embedding":[2]},{"index":0,"embedding":[1]}]}', 2)], "body string, n int")
    assert S.embedding_reply(e, "body", "n").first()["vectors"] == [[1.0], [2.0]]


def test_citations(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"_harvested": "2024", "citations": {"Alma 5:1": [{"talk_title": "t", "speaker": "s", "date": "April 2020", "url": "u"}]}}))
    assert rows(S.verse_citations(spark, str(tmp_path / "c.json")), "reference", "url") == [("Alma 5:1", "u")]
    (tmp_path / "a.json").write_text(json.dumps({"articles": [{"url": "u", "talk_title": "t", "references": ["A 1:1", "B 2:2"]}]}))
    assert S.article_citations(spark, str(tmp_path / "a.json")).count() == 2
    c = spark.createDataFrame([(2, "u", "late", "s", "May 2021", "B 1:1"), (1, "u", "first", "s", "April 2020", "A 1:1"), (3, "u", "x", "s", "", "A 1:1")], "seq int, url string, title string, speaker string, date string, reference string")
    w = S.citing_works(c).first()
    assert (w["title"], w["references"], str(w["published"])) == ("first", ["A 1:1", "B 1:1"], "2020-04-01")


def test_device_files_and_sinks(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "device-a.json").write_text('{"device_id":"a","notes":[{"k":"x","v":"1"}]}')
    (tmp_path / "device-b.json").write_text("{broken")
    schema = T.StructType.fromDDL("device_id string, notes array<struct<k:string,v:string>>")
    assert rows(S.device_files(spark, str(tmp_path), schema), "device_id") == [("a",)]
    d = spark.createDataFrame([(2, "b"), (1, "a")], "id int, line string")
    K.write_lines(d, str(tmp_path / "t"), "id")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a", "b"]
    K.write_json(d, str(tmp_path / "j"), "id", compress=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert K.checksum(d).first() == K.checksum(d.orderBy("id")).first()
    assert K.publish(d.limit(1), d, str(tmp_path / "p"), "id") is False and K.publish(d, d, str(tmp_path / "p"), "id") is True
    K.replace_partition(d.withColumn("lang", F.lit("h")), str(tmp_path / "lex"), "lang")
    K.replace_partition(d.limit(1).withColumn("lang", F.lit("g")), str(tmp_path / "lex"), "lang")
    assert spark.read.parquet(str(tmp_path / "lex")).count() == 3
    r = spark.createDataFrame([("q", 2, "talk", "T2"), ("q", 1, "talk", "T1"), ("q", 3, "verse", "V")], "query string, rank int, kind string, label string")
    assert K.sections(r, {"verse": (0, "Verses"), "talk": (1, "Talks")}).first()["text"] == "Verses\n- V\n\nTalks\n- T1\n- T2"


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(i % 7, i * 37 % 50, i, f"v{i}") for i in range(100)], "k int, at int, id int, v string")
    e.repartition(5).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in"))
    q = I.latest_by_key(stream, ["k"], "at", "id").writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = M.last_write_wins(e, ["k"], "at", "id")
    assert rows(spark.table("latest"), "k", "id", "v") == rows(want, "k", "id", "v")


def test_upserting_stream_is_idempotent(spark, tmp_path):
    rows_ = spark.createDataFrame([(i % 5, f"v{i}") for i in range(20)], "k int, v string").coalesce(1)
    rows_.write.json(str(tmp_path / "in"))
    table, version = str(tmp_path / "t"), [0]
    spark.createDataFrame([], "k int, v string").write.parquet(f"{table}0")

    def write(df):
        df.write.mode("overwrite").parquet(f"{table}{version[0] + 1}")
        version[0] += 1

    merge = lambda old, new: M.upserted(old, new.dropDuplicates(["k"]), ["k"])
    stream = spark.readStream.schema("k int, v string").json(str(tmp_path / "in"))
    I.upserting(stream, lambda: spark.read.parquet(f"{table}{version[0]}"), write, merge, str(tmp_path / "cp")).start().awaitTermination(120)
    assert spark.read.parquet(f"{table}{version[0]}").count() == 5


def test_section_names_by_pieces(spark):
    """Every word that is a name but for one letter in six is found, whatever letters are wrong."""
    import random

    rng = random.Random(3)
    names = ["JOB", "RUTH", "GENESIS", "LAMENTATIONS", "1 SAMUEL", "THESSALONIANSXYZABC", "A"]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words = []
    for _ in range(400):
        w = list(rng.choice(names).removeprefix("1 "))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "X", "E"])
        words.append("".join(w) or "ZZ")
    paragraphs = [("d", 2 * i, f"THE BOOK {w}") for i, w in enumerate(words)] + [("d", 2 * i + 1, "In the beginning") for i in range(len(words))]
    for name in names:
        core = name.removeprefix("1 ")
        first = next((2 * i for i, w in enumerate(words) if any(plain(x, core) <= max(1, len(core) // 6) for x in ("THE", "BOOK", w))), None)
        got = S.section_starts(spark.createDataFrame(paragraphs, "doc string, pos int, text string"), spark.createDataFrame([(1, name)], "place int, title string")).collect()
        assert [r["pos"] for r in got] == ([] if first is None else [first]), name


def test_polling_reads_each_file_once(spark, tmp_path):
    from datetime import datetime, timedelta

    schema, source, place = spark.range(1).schema, f"{tmp_path}/in", f"{tmp_path}/out"
    put = lambda a, b: spark.range(a, b, 1, 1).write.mode("append").parquet(source)
    now, broken = datetime(2024, 1, 1), {"fail": True}

    def keep(rows):
        if broken["fail"] and rows.filter("id = 7").count():
            raise OSError("broken off")
        return rows.filter("id <> 3")

    poll = lambda hours: I.polled(spark, source, schema, place, now + timedelta(hours=hours), 20, 1, keep)
    put(0, 5)
    assert poll(0) and not poll(19)
    put(5, 10), put(10, 12)
    try:
        poll(20)
        raise AssertionError
    except Exception as e:
        assert "broken off" in str(e)
    broken["fail"] = False
    assert poll(21) and not poll(22) and poll(42)
    assert sorted(r["id"] for r in spark.read.parquet(f"{place}/rows").collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11]
    assert sorted(r["rows"] for r in I.polls(spark, place).collect()) in ([0, 4, 7], [0, 2, 4], [0, 4, 5])


def test_books_are_read_by_chapters_as_if_whole(spark, tmp_path):
    rng = random.Random(3)
    heads = ["CHAPTER 1.", "chapter iv", "CHAPTER iiii", "Chapter 2", "CHAPTER 9"]
    line = lambda: rng.choice(heads) if rng.random() < 0.2 else f"{rng.choice(['', '1. ', '2 ', '3. '])}words {rng.randrange(99)}{rng.choice(['', ' 2. more', chr(0x2028) + '3. so'])}"
    texts = {f"b{b}": "\n".join(line() for _ in range(80)) for b in range(4)} | {"long": "\n".join(f"CHAPTER {c}\n1. a\n2. b{c}" for c in range(1, 60)), "none": None}
    rows = S.marked_books(spark.createDataFrame(list(texts.items()), "book string, text string"))
    want = sorted((b, v["chapter"], v["verse"], v["text"]) for b, t in texts.items() for v in S.marked_verses(t))
    assert sorted(map(tuple, rows.collect())) == want and len(want) > 150

    tags = ["\\c 1", "\\c 2", "\\c 7", "\\c x", "\\s1 A heading", "\\ms1 [A GREEK PART]", "\\p Before", "\\p", "more words", "\\v 1 In the beginning", "\\v 2 And", "\\v x", "\\v 3 So\x85\\c 4"]
    books = {f"u{b}": [rng.choice(tags) for _ in range(60)] for b in range(6)} | {"long": [x for c in range(1, 60) for x in (f"\\c {c}", f"\\s1 About {c}", "\\p A start", "\\v 1 One", "\\v 2 Two", *(["\\s1 The next"] if c % 5 == 0 else []))]}
    for name, lines in books.items():
        (tmp_path / f"{name}.usfm").write_text("\n".join(lines), newline="")
    found = sorted((r["file"][:-5], r["chapter"], r["verse"], r["text"], r["title"] or "") for r in S.usfm_verses(spark, str(tmp_path)).collect())
    assert found == sorted((b, v["chapter"], v["verse"], v["text"], v["title"] or "") for b, ls in books.items() for v in S.parse_usfm("\n".join(ls)))


def test_no_row_holds_a_whole_book(spark):
    lines = spark.range(0, 400, 1, 4).select(F.lit("b").alias("book"), F.col("id").alias("pos"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("CHAPTER "), (F.col("id") / 4 + 1).cast("int").cast("string"))).otherwise(F.concat((F.col("id") % 4).cast("string"), F.lit(". word"))).alias("value"))
    marked = lines.select("book", "pos", "value", F.when(F.col("pos") % 4 == 0, F.col("pos")).alias("number"), F.lit(0).alias("unknown"), F.lit(None).cast("boolean").alias("open"))
    assert S.in_units(marked, "book").agg(F.max(F.size(F.split("text", "\n")))).first()[0] <= 8
    assert S.marked_lines(lines).count() == 300
