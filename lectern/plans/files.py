"""Sources, sinks and streams. The supplied tables are first written in the form that a source has (text, XML, JSON, markup), in the
shared folder, and what the reader makes of them is compared with the tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schemas
from lectern.operators import merge as M
from lectern.operators import records as D
from lectern.operators import scanned as N
from lectern.operators import vectors as V
from lectern.operators import workflow as K
from lectern.operators.stored import StoredIndex
from lectern.plans.corpus import HIERARCHY, verses
from lectern.plans.registry import query, table, texts
from lectern.plans.retrieval import TOK
from lectern.sources import readers as S
from lectern.sources import sinks
from lectern.storage import shared_folder
from lectern.streaming import incremental as I


def _place(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _written(spark, rows) -> str:
    """Lines (key, pos, value) as one text file for each key."""
    path = _place(spark)
    rows.repartition("key").sortWithinPartitions("key", "pos").select("key", "value").write.partitionBy("key").text(path)
    return path


def _s(c):
    return F.col(c).cast("string")


def _customers(spark, d, value, pos="c_custkey"):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.struct(F.lit(1).alias("part"), F.col(pos).alias("at")).alias("pos"), value.alias("value"))


def _ends(spark, d, value, part):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("at")).alias("pos"), F.lit(value).alias("value"))


@query("SELECT 'chapters' AS name, count(*) AS n FROM customer UNION ALL SELECT 'settings', 2 UNION ALL SELECT 'vectors', 0")
def bootstrapped(spark, d):
    """S-01, D-20: stored tables in their present schema; what isn't there yet is empty, and new columns are null."""
    path = _place(spark)
    table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("book_id")).write.parquet(f"{path}/chapters")
    spark.range(2).select(_s("id").alias("key"), F.lit("v").alias("value")).write.parquet(f"{path}/settings")
    found = D.bootstrap(spark, path)
    counts = [found[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("chapters", "settings", "vectors")]
    assert all(found[n].schema == schemas.TABLES[n] or found[n].columns == schemas.TABLES[n].names for n in found)
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT r_name AS volume, 'b' || n_nationkey AS book, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS book_sort FROM nation JOIN region ON n_regionkey = r_regionkey")
def hierarchy_source(spark, d):
    """S-02: nested JSON of volumes and books, with positions."""
    path, nation = _place(spark), table(spark, d, "nation")
    books = F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda n: F.concat(F.lit("b"), n.cast("string")))
    grouped = nation.groupBy("n_regionkey").agg(books.alias("books")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    volumes = grouped.select(F.col("r_name").alias("name"), F.lower("r_name").alias("slug"), "books")
    volumes.agg(F.collect_list(F.struct("name", "slug", "books")).alias("volumes")).coalesce(1).write.json(path)
    return S.hierarchy(spark, path).select("volume", "book", F.col("book_sort").cast("long").alias("book_sort"))


@query(f"""WITH {HIERARCHY} SELECT book_name AS book, count(*) AS n, 'read' AS outcome FROM ve WHERE book_name NOT IN ('NATION_3', 'NATION_7') GROUP BY book_name
UNION ALL SELECT 'NATION_3', count(*), 'unknown book' FROM ve WHERE book_name = 'NATION_3' UNION ALL SELECT 'Seventh', count(*), 'read' FROM ve WHERE book_name = 'NATION_7' UNION ALL SELECT 'none', count(*), 'unreadable' FROM ve WHERE verse_number = 1""")
def verse_lines(spark, d):
    """S-03: lines of verses; unknown books and unreadable lines are counted, aliases resolved."""
    ve, nation = verses(spark, d), table(spark, d, "nation")
    lines = ve.select(F.concat_ws(" ", "reference", "text").alias("value")).union(ve.filter("verse_number = 1").select(F.lit("rubbish")))
    known = nation.filter("n_nationkey <> 3").select(F.when(F.col("n_nationkey") == 7, "Seventh").otherwise(F.col("n_name")).alias("name"))
    aliases = nation.filter("n_nationkey = 7").select(F.col("n_name").alias("alias"), F.lit("Seventh").alias("book"))
    ok, bad = S.verse_lines(lines, known, aliases)
    ok = ok.groupBy("book").agg(F.count("*").alias("n")).withColumn("outcome", F.lit("read"))
    book = F.when(F.col("reason") == "unreadable", "none").otherwise(F.regexp_extract("value", r"^(\S+)", 1))
    return ok.unionByName(bad.groupBy(book.alias("book"), F.col("reason").alias("outcome")).agg(F.count("*").alias("n")))


@query("SELECT c_name || ' ' || c_mktsegment AS text FROM customer")
def xml_paragraphs(spark, d):
    """S-04: paragraphs of scanned pages."""
    value = F.concat(F.lit("<OBJECT><PARAGRAPH><LINE><WORD>"), "c_name", F.lit("</WORD></LINE><LINE><WORD> "), "c_mktsegment", F.lit("</WORD></LINE></PARAGRAPH></OBJECT>"))
    return S.xml_paragraphs(spark, _written(spark, _ends(spark, d, "<B>", 0).unionByName(_customers(spark, d, value)).unionByName(_ends(spark, d, "</B>", 2)))).select("text")


@query("SELECT c_nationkey::INT AS volume, c_name AS title FROM customer WHERE c_nationkey BETWEEN 2 AND 20 AND c_custkey % 5 <> 0")
def discourse_lines(spark, d):
    """S-05: JSON lines; those with an error and of other volumes are left out."""
    path = _place(spark)
    rows = table(spark, d, "customer")
    rows.select(F.col("c_nationkey").alias("volume"), F.col("c_name").alias("title"), F.array("c_mktsegment").alias("paragraphs"), F.when(F.col("c_custkey") % 5 == 0, "404").alias("error")).write.json(path)
    return S.discourses(spark, path, (2, 20)).select("volume", "title")


@query(f"WITH {HIERARCHY} SELECT chapter_id::INT AS chapter, verse_number::INT AS verse, text || ' went on' AS text, 'About ' || chapter_id || ' · A Greek part' AS title FROM ve")
def markup_books(spark, d):
    """S-06: chapters, verses and titles of the marker language."""
    ve = verses(spark, d).join(table(spark, d, "nation"), F.col("book_name") == F.col("n_name"))
    at = lambda verse, n: F.struct(F.col("chapter_id"), verse.cast("long").alias("verse"), F.lit(n).alias("line")).alias("pos")
    heads = ve.filter("verse_number = 1").select(F.col("n_nationkey").alias("key"), "chapter_id")
    zero = F.lit(0)
    lines = ve.select(F.col("n_nationkey").alias("key"), at(F.col("verse_number"), 0), F.concat(F.lit("\\v "), _s("verse_number"), F.lit(" "), "text", F.lit("\\f + a note\\f*")).alias("value"))
    lines = lines.unionByName(ve.select(F.col("n_nationkey").alias("key"), at(F.col("verse_number"), 1), F.lit("went \\add  on\\add*").alias("value")))
    lines = lines.unionByName(heads.select("key", at(zero, 0), F.concat(F.lit("\\c "), _s("chapter_id")).alias("value")))
    lines = lines.unionByName(heads.select("key", at(zero, 1), F.concat(F.lit("\\s1 About "), _s("chapter_id")).alias("value")))
    lines = lines.unionByName(heads.select("key", at(zero, 2), F.lit("\\ms1 [A GREEK PART]").alias("value")))
    return S.usfm_verses(spark, _written(spark, lines)).select("chapter", "verse", "text", "title")


@query("SELECT p_partkey, p_name || '=H' || p_partkey || ',G2' AS words FROM part")
def tagged_markup(spark, d):
    """S-07: words with their numbers in the marker language."""
    text = F.concat(F.lit("The \\w "), "p_name", F.lit('|lemma="x" strong="H'), _s("p_partkey"), F.lit(' G2"\\w* and'))
    rows = S.tagged_words(table(spark, d, "part").select("p_partkey", text.alias("t")), "t")
    return rows.select("p_partkey", F.explode("words").alias("w")).select("p_partkey", F.concat(F.trim("w.word"), F.lit("="), F.array_join("w.numbers", ",")).alias("words"))


@query("SELECT 'a' || c_nationkey AS path, 'm' || c_nationkey || '.usfm' AS member, string_agg(c_name, chr(10) ORDER BY c_custkey) AS value FROM customer GROUP BY c_nationkey")
def archive_members(spark, d):
    """S-08: members of archives by name."""
    def packed(names: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for n, v in zip(names, values, strict=True):
            with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
                z.writestr(f"m{n}.usfm", v)
                z.writestr("readme.txt", "no")
            out.append(buffer.getvalue())
        return pd.Series(out)

    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), "\n")
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(listed.alias("v"))
    return S.members_of(rows.select(F.concat(F.lit("a"), _s("c_nationkey")).alias("path"), F.pandas_udf(packed, "binary")("c_nationkey", "v").alias("content")), r"\.usfm$")


@query("SELECT c_name || ' ' || c_mktsegment AS text FROM customer")
def blank_line_paragraphs(spark, d):
    """S-09: paragraphs between blank lines."""
    value = F.concat("c_name", F.lit("\n  "), "c_mktsegment", F.lit("\n \n"))
    return S.blank_line_paragraphs(spark, _written(spark, _customers(spark, d, value))).select("text")


@query("SELECT 'H' || p_partkey AS strongs, p_name AS lemma, p_type AS kjv_def FROM part")
def js_dictionary(spark, d):
    """S-10: a script's object as dictionary entries."""
    entry = F.struct(F.col("p_name").alias("lemma"), F.col("p_type").alias("kjv_def"))
    whole = table(spark, d, "part").groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("H"), _s("p_partkey")), entry))).alias("m"))
    return S.js_dictionary(whole.select(F.concat(F.lit("/* words */ var dictionary = "), F.to_json("m"), F.lit("; module.exports")).alias("value"))).select("strongs", "lemma", "kjv_def")


@query("SELECT 'H' || n_nationkey + 1 AS strongs, string_agg(seg, ';' ORDER BY p) AS glosses FROM (SELECT n_nationkey, c_mktsegment AS seg, min(c_custkey) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey + 1 <= 20 GROUP BY 1, 2) GROUP BY n_nationkey")
def tabbed_glosses(spark, d):
    """S-11: different glosses of each key in file order; keys out of range and of other languages are left out."""
    key = F.concat(F.lit("H00"), (F.col("c_nationkey") + 1).cast("string"), F.lit("A"))
    lines = table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.concat_ws("\t", key, *[F.lit("-")] * 5, "c_mktsegment").alias("value"))
    other = lines.select("pos", F.regexp_replace("value", "^H", "G").alias("value"))
    return S.glosses(lines.unionByName(other), "H", 20).select("strongs", F.array_join("glosses", ";").alias("glosses"))


@query(f"WITH {HIERARCHY} SELECT book_name AS book, chapter_id::INT AS chapter, verse_number::INT AS verse, lower(text) AS text FROM ve WHERE chapter_id > 0")
def numbered_plain_text(spark, d):
    """S-12, S-13: headings and verse numbers in plain text."""
    ve = verses(spark, d).filter("chapter_id > 0")
    lines = ve.select("book_name", "chapter_id", F.col("verse_number").alias("at"), F.concat(_s("verse_number"), F.lit(". "), F.lower("text")).alias("value"))
    lines = lines.unionByName(ve.select("book_name", "chapter_id", F.lit(0).cast("long").alias("at"), F.concat(F.lit("CHAPTER "), _s("chapter_id"), F.lit(".")).alias("value")).distinct())
    return S.marked_lines(lines.select(F.col("book_name").alias("book"), F.struct("chapter_id", "at").alias("pos"), "value"))


#: Ten customers are a book, those with orders its chapters; each chapter of twelve verses and more has a damage of its own, by the customer's number.
_SCANNED = """sv AS (SELECT o_custkey // 10 AS book, (o_custkey % 10 + 1)::INT AS chapter, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS verse, count(*) OVER (PARTITION BY o_custkey) AS n,
 'The ' || lower(o_orderpriority) || ' one, of ' || o_orderkey || ' and more.' AS text, (o_custkey // 7) % 8 AS damage, o_custkey IN (SELECT o_custkey + 1 FROM orders) AS follows FROM orders)"""


@query(f"""WITH {_SCANNED} SELECT book, chapter, verse, CASE WHEN n >= 12 AND damage = 1 AND verse = 4 THEN text || ' The lost. ' || (SELECT text FROM sv o WHERE o.book = sv.book AND o.chapter = sv.chapter AND o.verse = 5) WHEN n >= 12 AND damage = 6 AND verse = 1 AND follows AND chapter > 1 THEN 'NOW ' || text ELSE text END AS text
FROM sv WHERE NOT (n >= 12 AND damage = 1 AND verse = 5)""")
def scanned_books(spark, d):
    """S-15: a scan's paragraphs with page numbers between; in turn with a number that is lost, fused into other paragraphs, misread, in columns out of order, under running heads, without heading, under a misread heading."""
    from pyspark.sql import Window as W

    own = W.partitionBy("o_custkey")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    ve = orders.withColumn("verse", F.row_number().over(own.orderBy("o_orderkey"))).withColumn("n", F.count("*").over(own))
    ve = ve.join(orders.select((F.col("o_custkey") + 1).alias("o_custkey"), F.lit(True).alias("follows")).distinct(), "o_custkey", "left")
    number, many = F.col("o_custkey") % 10 + 1, F.col("n") >= 12
    damage = F.when(many, F.floor(F.col("o_custkey") / 7) % 8).otherwise(0)
    words = F.concat(F.lit("The "), F.lower("o_orderpriority"), F.lit(" one, of "), _s("o_orderkey"), F.lit(" and more."))
    ve = ve.select(F.floor(F.col("o_custkey") / 10).alias("book"), number.alias("chapter"), "verse", "n", damage.alias("damage"), words.alias("t"), ((damage == 6) & F.coalesce("follows", F.lit(False)) & (number > 1)).alias("bare"))
    v, kind = F.col("verse"), F.col("damage")
    shown = F.when((kind == 3) & (v > 1), F.translate(v.cast("string"), "10", "lO")).otherwise(v.cast("string"))
    line = F.when((kind == 1) & (v == 5), F.concat(F.lit("The lost. "), "t")).when(F.col("bare") & (v == 1), F.concat(F.lit("NOW "), "t")).otherwise(F.concat(shown, F.lit(" "), "t"))
    # Where a paragraph stands: columns of verses 5 to 8 and 9 to 12 change places; fused verses share a place.
    place = F.when((kind == 4) & v.between(5, 8), v + 4).when((kind == 4) & v.between(9, 12), v - 4).when((kind == 2) & v.between(3, 8), 3).otherwise(v)
    body = ve.groupBy("book", "chapter", place.alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verse", line.alias("x")))), lambda x: x["x"]), " ").alias("text"))
    heads = ve.filter("verse = 1 AND NOT bare").select("book", "chapter", F.lit(0).alias("pos"), F.concat(F.when(kind == 7, "CHAFTER ").otherwise("CHAPTER "), _s("chapter"), F.lit(".")).alias("text"))
    running = ve.filter("verse = 6 AND damage = 5").select("book", "chapter", F.lit(6).alias("pos"), F.concat(F.lit("CHAPTER "), _s("chapter")).alias("text"))
    pages = ve.filter("verse = 7").select("book", "chapter", F.lit(7).alias("pos"), F.lit("283").alias("text"))
    lines = body.withColumn("part", F.lit(1)).unionByName(heads.unionByName(running).unionByName(pages).withColumn("part", F.lit(0)))
    return N.scanned_books(lines.select("book", F.struct("chapter", "pos", "part").alias("pos"), "text"))


@query("SELECT p_size::BIGINT AS volume, n * 10::BIGINT AS place FROM (SELECT DISTINCT p_size, p_partkey % 40 AS n FROM part)")
def kept_boundaries(spark, d):
    """S-16: candidate places near the last one kept belong to it."""
    near = F.transform(F.array(F.lit(0), F.lit(2), F.lit(4)), lambda x: x + (F.col("p_partkey") % 40) * 10)
    rows = table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("volume")).agg(F.flatten(F.collect_list(near)).alias("places"))
    return S.kept_boundaries(rows, "volume", "places")


@query("SELECT n_name AS name, CASE WHEN n_nationkey = 4 THEN 900 ELSE n_nationkey + 1 END AS id FROM nation")
def book_numbers(spark, d):
    """S-18: ids by place, but for irregular ones."""
    nation = table(spark, d, "nation")
    return S.book_ids(nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("place")), nation.filter("n_nationkey = 4").select(F.col("n_name").alias("name"), F.lit(900).alias("id")))


@query("SELECT p_partkey AS page_id, 'bofm' AS volume, p_size::INT AS chapter, unnest([p_size % 5 + 1, p_size % 5 + 2])::INT AS verse FROM part UNION ALL SELECT p_partkey, 'ot', 3, -1 FROM part")
def article_references(spark, d):
    """S-19, S-21: references in links, one row a verse; whole chapters have none."""
    first = F.col("p_size") % 5 + 1
    html = F.concat(F.lit('<a href="/scriptures/bofm/alma/'), _s("p_size"), F.lit("?lang=eng&id=p"), first.cast("string"), F.lit("-p"), (first + 1).cast("string"), F.lit('">x</a> <a href="/scriptures/ot/gen/3">y</a>'))
    found = S.article_references(table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("h")), "h")
    return found.select("page_id", "volume", "chapter", F.coalesce("verse", F.lit(-1)).alias("verse"))


@query("SELECT 'ref ' || o_custkey AS reference, o_orderpriority AS talk_title, 'u' || o_orderkey AS url FROM orders")
def citation_maps(spark, d):
    """S-22, K-04: a JSON map of references to citing works."""
    works = table(spark, d, "orders").groupBy(F.concat(F.lit("ref "), _s("o_custkey")).alias("r"), (F.col("o_custkey") % 7).alias("key")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("talk_title"), F.lit("s").alias("speaker"), F.lit("d").alias("date"), F.concat(F.lit("u"), _s("o_orderkey")).alias("url"))).alias("w"))
    whole = works.groupBy("key").agg(F.to_json(F.struct(F.lit("2024-01-01").alias("_harvested"), F.map_from_entries(F.collect_list(F.struct("r", "w"))).alias("citations"))).alias("value"))
    return S.verse_citations(spark, _written(spark, whole.withColumn("pos", F.lit(0)))).select("reference", "talk_title", "url")


@query("SELECT 'ref ' || o_orderkey AS reference, 'u' || o_custkey AS url FROM orders")
def article_maps(spark, d):
    """S-23: articles with their references, turned around."""
    works = table(spark, d, "orders").groupBy(F.concat(F.lit("u"), _s("o_custkey")).alias("url"), (F.col("o_custkey") % 7).alias("key")).agg(F.collect_list(F.concat(F.lit("ref "), _s("o_orderkey"))).alias("references"))
    whole = works.groupBy("key").agg(F.to_json(F.struct(F.collect_list(F.struct("url", F.lit("t").alias("talk_title"), F.lit("s").alias("speaker"), F.lit("d").alias("date"), "references")).alias("articles"))).alias("value"))
    return S.article_citations(spark, _written(spark, whole.withColumn("pos", F.lit(0)))).select("reference", "url")


@query("SELECT r_name AS device_id, count(*) AS notes FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 GROUP BY r_name")
def device_snapshots(spark, d):
    """S-25, K-01, K-02: one JSON file a device; a damaged one is left out."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    whole = rows.groupBy(F.col("r_regionkey").alias("key"), "r_name").agg(F.to_json(F.struct(F.col("r_name").alias("device_id"), F.collect_list(F.struct("c_custkey", "c_name")).alias("notes"))).alias("value"))
    whole = whole.select("key", F.lit(0).alias("pos"), F.when(F.col("key") == 2, F.substring("value", 1, 40)).otherwise(F.col("value")).alias("value"))
    schema = T.StructType([T.StructField("device_id", T.StringType()), T.StructField("notes", T.ArrayType(T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType())])))])
    return S.device_files(spark, _written(spark, whole), schema, "key=*/part-*").select("device_id", F.size("notes").cast("long").alias("notes"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 10 ORDER BY md5('3:' || p_partkey), p_partkey LIMIT 1")
def pick_of_the_day(spark, d):
    """S-28: one row of the pool that resolves, the same whenever it is drawn."""
    part = table(spark, d, "part")
    return S.pick_of_the_day(part.repartition(3), part.filter("p_size > 10"), "p_partkey", 3).select("p_partkey", "p_name")


@query("""SELECT o_orderkey AS id, 'Issue & ' || o_orderkey AS title, 'http://x/' || o_orderkey AS link, strftime(o_orderdate, '%Y-%m-%d 10:30:00') AS published FROM orders WHERE o_orderkey % 9 <> 0""")
def feed_items(spark, d):
    """S-29: the first item of a feed; unreadable feeds are left out."""
    item = F.concat(F.lit("<rss><channel><title>All</title><item><title><![CDATA[Issue & "), _s("o_orderkey"), F.lit("]]></title><link>http://x/"), _s("o_orderkey"), F.lit("</link><dc:creator>A</dc:creator><pubDate>Sat, "), F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" 10:30:00 +0000</pubDate></item><item><title>Old</title><link>y</link></item></channel></rss>"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 == 0, "<rss>").otherwise(item).alias("x"))
    return S.first_feed_item(rows, "x").select("id", "title", "link", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("""SELECT c_custkey AS id, '2024-03-0' || (c_custkey % 5 + 1) AS first FROM customer WHERE c_custkey % 5 + 1 <= 4""")
def current_weeks(spark, d):
    """S-30: lessons whose week has the day."""
    start = F.col("c_custkey") % 5 + 1
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(2024).alias("year"), F.concat(F.lit("March "), start.cast("string"), F.lit("–"), (start + 6).cast("string")).alias("span"))
    return S.current_week(rows, F.lit("2024-03-04").cast("date")).select("id", F.date_format("first", "yyyy-MM-dd").alias("first"))


@query("""SELECT doc_id, sha256(regexp_replace(trim(text, ' '), '^[“”]+|[“”]+$', '', 'g')) AS quote_sha256, 'Author ' || lang AS author, CASE WHEN lang = 'en' THEN 'of ' || source ELSE '' END AS byline, 'https://site/q/' || doc_id AS link FROM documents WHERE lang <> 'de' AND NOT contains(text, '<') AND text <> ''""")
def page_sections(spark, d):
    """S-31: a page's quote, however long; incomplete sections are left out."""
    author = F.when(F.col("lang") != "de", F.concat(F.lit('<div class="blockquoteAuthor">Author '), "lang", F.lit(" </div>"))).otherwise("")
    byline = F.when(F.col("lang") == "en", F.concat(F.lit('<div class="blockquoteByline">of '), "source", F.lit("</div>"))).otherwise("")
    html = F.concat(F.lit('<p>x</p><section class="blockquote"><p class="blockquoteText">“'), "text", F.lit('”</p><a href="/q/'), _s("doc_id"), F.lit('" class="blockquoteAttribution">more</a>'), author, byline, F.lit("</section><section>"))
    rows = texts(spark, d).filter("NOT contains(text, '<') AND text <> ''").select("doc_id", html.alias("h"))
    return S.page_section(rows, "h", "https://site").select("doc_id", F.sha2("quote", 256).alias("quote_sha256"), "author", "byline", "link")


@query("""SELECT o_custkey AS page_id, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate) + INTERVAL 1 DAY, '%Y-%m-%d') AS last FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey""")
def event_days(spark, d):
    """S-32: first and last day of a page's events of a name."""
    label = F.when(F.col("o_orderstatus") == "O", "General Conference").otherwise("Meeting")
    tag = F.concat(F.lit('<time class="x" start="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T10:00" end="'), F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd"), F.lit('T12:00">'), label, F.lit("</time>"))
    return S.event_days(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.concat_ws("", F.collect_list(tag)).alias("h")), "h", "Conference").select(
        "page_id", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last")
    )


@query("SELECT event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS session FROM events")
def log_sessions(spark, d):
    """S-33: log lines by the session that they belong to."""
    lines = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), F.concat(F.lit("=== "), "event_type", F.lit(" ===")).alias("value"))
    return S.log_sessions(lines, "^=== signup").select(F.col("pos").alias("event_id"), "session")


@query("SELECT 'v1.' || p_size || '.' || p_partkey AS tag_name, 'u' || p_partkey AS html_url, p_partkey % 3 = 0 AS prerelease, 1::BIGINT AS major, p_size::BIGINT AS minor, p_partkey::BIGINT AS patch FROM part WHERE p_partkey % 4 <> 0")
def release_records(spark, d):
    """S-34: versions of release records; drafts are left out, and versions are compared by their numbers."""
    body = F.to_json(F.struct(F.concat(F.lit("v1."), _s("p_size"), F.lit("."), _s("p_partkey")).alias("tag_name"), F.concat(F.lit("u"), _s("p_partkey")).alias("html_url"), (F.col("p_partkey") % 4 == 0).alias("draft"), (F.col("p_partkey") % 3 == 0).alias("prerelease")))
    from lectern.functions.text import version_key

    found = S.releases(table(spark, d, "part").select(body.alias("b")), "b").withColumn("v", version_key(F.col("tag_name")))
    return found.select("tag_name", "html_url", "prerelease", *[F.get("v", F.lit(i)).cast("long").alias(c) for i, c in enumerate(("major", "minor", "patch"))])


@query("SELECT 'nomic-Embed-' || p_partkey AS model, true AS special FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'gemma-' || p_partkey, false FROM part WHERE p_partkey % 2 = 1")
def model_lists(spark, d):
    """S-35: models of a server, special ones told apart."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "nomic-Embed-").otherwise("gemma-"), _s("p_partkey"))
    body = table(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(F.struct(name.alias("id"))).alias("data"))).alias("b"))
    return S.model_list(body.select(F.col("b").alias("body")), "body").select("model", "special")


@query("SELECT o_custkey AS id, count(*) AS n, min(o_orderkey)::DOUBLE AS first FROM orders GROUP BY o_custkey")
def embedding_replies(spark, d):
    """S-36: vectors of a reply in the order of their index."""
    data = F.collect_list(F.struct(F.col("o_orderkey").cast("int").alias("index"), F.array(F.col("o_orderkey").cast("float")).alias("embedding")))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("int").alias("n"), F.to_json(F.struct(F.reverse(data).alias("data"))).alias("body"))
    return S.embedding_reply(rows, "body", "n").select("id", F.size("vectors").cast("long").alias("n"), F.get(F.get("vectors", F.lit(0)), F.lit(0)).cast("double").alias("first"))


@query("SELECT o_custkey::VARCHAR AS name, max_by(o_orderkey::VARCHAR, (strftime(o_orderdate, '%Y'), o_orderkey % 2 = 0, o_orderkey::VARCHAR)) AS path FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), o_orderkey % 2 ORDER BY o_orderkey) = 1) GROUP BY o_custkey")
def newer_copies(spark, d):
    """S-37: the newest of a file's copies; the downloaded one wins ties."""
    copies = table(spark, d, "orders").groupBy(_s("o_custkey").alias("name"), F.date_format("o_orderdate", "yyyy").alias("harvested"), (F.col("o_orderkey") % 2 == 0).alias("downloaded")).agg(F.min("o_orderkey").cast("string").alias("path"))
    return S.newer_copy(copies)


@query("SELECT 'v1' AS version, count(*) AS n FROM part UNION ALL SELECT 'v2', count(*) FROM part WHERE p_size > 25")
def versioned_tables(spark, d):
    """S-26: a derived table's versions lie side by side."""
    path, part = _place(spark), table(spark, d, "part")
    part.write.parquet(K.versioned(path, 1))
    part.filter("p_size > 25").write.parquet(K.versioned(path, 2))
    return spark.read.parquet(K.versioned(path, 1)).agg(F.count("*").alias("n")).select(F.lit("v1").alias("version"), "n").unionByName(spark.read.parquet(K.versioned(path, 2)).agg(F.count("*").alias("n")).select(F.lit("v2").alias("version"), "n"))


@query("SELECT o_custkey AS k, o_orderkey AS v FROM orders")
def json_sink(spark, d):
    """K-01, K-03, K-05: sorted, compressed JSON lines, read again."""
    path = _place(spark)
    sinks.write_json(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")), path, "k", "v", compress=True)
    return spark.read.schema("k long, v long").json(path)


@query("SELECT n_name || ': ' || n_nationkey AS line FROM nation")
def report_sink(spark, d):
    """K-06, K-07, K-11: a report of lines, read again."""
    path = _place(spark)
    sinks.write_lines(table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(": "), _s("n_nationkey")).alias("line")), path, "n_nationkey")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT 'a' AS part, count(*) AS n FROM part WHERE p_size > 25 UNION ALL SELECT 'b', count(*) FROM part")
def partition_sink(spark, d):
    """K-09, D-21: only the partitions that are written anew are replaced."""
    path, part = _place(spark), table(spark, d, "part").select("p_partkey", "p_size")
    for rows, names in ((part, ("a", "b")), (part.filter("p_size > 25"), ("a",))):
        sinks.replace_partition(rows.withColumn("part", F.explode(F.array(*[F.lit(n) for n in names]))), path, "part")
    return spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT false AS shrunk, true AS whole, count(*) AS n FROM part")
def published_file(spark, d):
    """K-05, D-23: a publication that shrank is refused; one that didn't is written with the same content."""
    path, part = _place(spark), table(spark, d, "part").select("p_partkey", "p_name")
    shrunk, whole = sinks.publish(part.filter("p_partkey % 2 = 0"), part, f"{path}/a", "p_partkey"), sinks.publish(part, part, f"{path}/b", "p_partkey")
    back = spark.read.schema("p_partkey long, p_name string").json(f"{path}/b")
    same = sinks.checksum(back).intersect(sinks.checksum(part)).count() == 1
    return back.agg(F.count("*").alias("n")).select(F.lit(shrunk).alias("shrunk"), F.lit(whole and same).alias("whole"), "n")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'")
def compacted_table(spark, d):
    """K-10: fewer files, what is private left out."""
    path = _place(spark)
    sinks.compacted(table(spark, d, "orders"), path, 2, F.col("o_orderstatus") == "P")
    return spark.read.parquet(path).select("o_orderkey")


@query("""WITH b AS (SELECT o_custkey AS query, CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END AS place, CASE o_orderstatus WHEN 'O' THEN 'Open' ELSE 'Done' END || chr(10) || string_agg('- ' || o_orderkey, chr(10) ORDER BY o_orderkey) AS t FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2, o_orderstatus)
SELECT query, string_agg(t, chr(10) || chr(10) ORDER BY place) AS text FROM b GROUP BY query""")
def result_sections(spark, d):
    """K-11: results as one text in sections."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("rank"), F.col("o_orderstatus").alias("kind"), _s("o_orderkey").alias("label"))
    return sinks.sections(rows, {"O": (0, "Open"), "F": (1, "Done")})


@query("SELECT coalesce(a.day, b.day) AS day, concat_ws(chr(10) || chr(10), a.t, b.t) AS text FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, 'old' AS t FROM events WHERE user_id < 20 GROUP BY 1) a FULL JOIN (SELECT strftime(ts, '%Y-%m-%d') AS day, 'new' AS t FROM events WHERE user_id > 30 GROUP BY 1) b ON a.day = b.day")
def appended_entries(spark, d):
    """K-12: text added below what a day has."""
    days = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return sinks.appended_entry(days.filter("user_id < 20").select("day", F.lit("old").alias("text")).distinct(), days.filter("user_id > 30").select("day", F.lit("new").alias("text")).distinct())


@query("SELECT 'r' || c_custkey AS reference, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS work FROM customer")
def nested_citations(spark, d):
    """K-04: references with their works; new ones replace old ones."""
    path = _place(spark)
    rows = table(spark, d, "customer").select(F.concat(F.lit("r"), _s("c_custkey")).alias("reference"), "c_custkey")
    works = lambda w: F.array(F.lit(w)).alias("works")
    D.nested_update(spark, rows.select("reference", works("old")), rows.filter("c_custkey % 3 = 0").select("reference", works("new")), path)
    return spark.read.schema("reference string, works array<string>").json(path).select("reference", F.get("works", F.lit(0)).alias("work"))


@query("SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part GROUP BY p_brand")
def rebuilt_table(spark, d):
    """D-18, Q-V4: a curated table written anew once its checks find nothing."""
    part = table(spark, d, "part")
    from lectern.operators.quality import violations

    found = D.rebuilt(part, violations(("no name", part.filter("p_name IS NULL")), ("size", part.filter("p_size < 0"))), _place(spark))
    return found.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("sizes"))


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def _latest(rows, *keys):
    """Of an updated key the row of its last batch."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("r")).select(*keys, "r.*")


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def stream_last_write(spark, d):
    """Stream: last write wins."""
    rows = I.latest_by_key(_stream(spark, d).select("user_id", "event_type", "at", "event_id"), ["user_id", "event_type"], "at", "event_id")
    return _latest(I.drained(rows, _place(spark)), "user_id", "event_type").select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY user_id, event_type")
def stream_latest_visit(spark, d):
    """Stream: latest visit."""
    rows = I.latest_visits(_stream(spark, d), "user_id", "event_type", "at")
    return _latest(I.drained(rows, _place(spark)), "user_id", "event_type").select("user_id", "event_type", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_active_days(spark, d):
    """Stream: daily streak: days with activity."""
    rows = I.active_days(_stream(spark, d), "user_id", "at", "2 hours")
    return _latest(I.drained(rows, _place(spark)), "user_id", "day").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 8 HOUR <= (SELECT max(ts) FROM events) AND epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) >= 3600""")
def stream_dwell(spark, d):
    """Stream: dwell gate: sessions of an hour or more, once the watermark has passed their end."""
    rows = I.dwelt(_stream(spark, d), "user_id", "at", "6 hours", 3600, "2 hours")
    return I.drained(rows, _place(spark), "append").select("user_id", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), "n")


@query("SELECT DISTINCT event_type || user_id AS print FROM events")
def stream_first_reports(spark, d):
    """Stream: fingerprint dedup: one report of each within the watermark."""
    reports = _stream(spark, d).select(F.concat("event_type", _s("user_id")).alias("print"), "at")
    return I.drained(I.first_reports(reports, "print", "at", "4000 hours"), _place(spark)).select("print").distinct()


@query("""WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL (unnest(range(0, 6)) * 10) MINUTE AS s FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM w GROUP BY s""")
def stream_hourly_counts(spark, d):
    """Stream: hourly cap: reports in sliding hours."""
    rows = I.hourly_counts(_stream(spark, d), "at", "2 hours")
    return _latest(I.drained(rows, _place(spark)), "start").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("SELECT event_type || user_id % 10 AS k, max(event_id) AS v FROM events GROUP BY 1")
def stream_upserts(spark, d):
    """Stream: batches merged into a table."""
    path = _place(spark)
    empty = spark.createDataFrame([], "k string, v long")
    state = {"now": empty}

    def write(rows) -> None:
        target = f"{path}/table-{uuid.uuid4().hex}"
        rows.write.parquet(target)
        state["now"] = spark.read.parquet(target)

    def merged(old, new):
        return M.upserted(old, new.groupBy("k").agg(F.max("v").alias("v")), ["k"])

    stream = _stream(spark, d).select(F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("k"), F.col("event_id").alias("v"))
    I.upserting(stream, lambda: state["now"], write, merged, f"{path}/state").start().awaitTermination()
    return state["now"]


def _batch(rows, path: str) -> None:
    """The files of one batch, written by the tasks that read the rows: a stream without a limit takes all files that are there as one batch."""
    rows.write.parquet(path)


_EDITED = TOK.format("CASE WHEN doc_id % 10 = 0 THEN 'changed words, changed twice' WHEN doc_id % 10 = 5 THEN 'gone and back ' || text ELSE text END")


@query(f"""WITH t AS (SELECT doc_id AS doc, unnest(range(0, len(l))) AS pos, unnest(l) AS token, len(l) AS len FROM (SELECT doc_id, {_EDITED} AS l FROM documents WHERE doc_id % 10 <> 1))
SELECT token, count(*) AS docs, sum(tf)::BIGINT AS tf, sum(first)::BIGINT AS first, sum(len)::BIGINT AS len FROM (SELECT token, doc, len, count(*) AS tf, min(pos) AS first FROM t GROUP BY token, doc, len) GROUP BY token""")
def stream_index(spark, d):
    """Stream: index follows edits: nine tenths of the documents are indexed, then come new, changed, deleted and restored ones, in three batches."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = StoredIndex.create(docs.filter("doc_id % 10 <> 3"), "doc_id", {"text": 1.0}, parts=8)
    none = F.lit(None).cast("string")
    edit = lambda rest, at, text, deleted=False: docs.filter(f"doc_id % 10 = {rest}").select("doc_id", text.alias("text"), F.lit(deleted).alias("deleted"), F.lit(at).alias("at"))
    batches = [edit(3, 1, F.lit("first form")), edit(0, 1, F.lit("changed once")).unionByName(edit(1, 2, none, True)).unionByName(edit(5, 3, none, True)), edit(3, 5, F.col("text")).unionByName(edit(3, 4, none, True)).unionByName(edit(0, 6, F.lit("changed words, changed twice"))).unionByName(edit(5, 7, F.concat(F.lit("gone and back "), F.col("text"))))]
    place = _place(spark)
    for i, rows in enumerate(batches):
        _batch(rows, f"{place}/edits/{i}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{place}/edits/*")
        I.index_follows(stream, index, "doc_id", F.col("at"), f"{place}/state").start().awaitTermination()
    found = index.flat().select("token", "len", F.size("at").alias("tf"), F.array_min(F.transform("at", lambda x: x["pos"])).alias("first"))
    return found.groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").cast("long").alias("tf"), F.sum("first").cast("long").alias("first"), F.sum("len").alias("len"))


@query("SELECT event_type, CASE WHEN event_id % 3 < 2 THEN 0 ELSE 1 END::BIGINT AS poll, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1, 2")
def stream_polling(spark, d):
    """Stream: periodic polling: events in files of which some come later; a poll too early reads nothing, each file is read once."""
    events, place = table(spark, d, "events"), _place(spark)
    put = lambda rest: events.filter(F.col("event_id") % 3 == rest).coalesce(1).write.mode("append").parquet(f"{place}/in")
    first = datetime(2024, 5, 1, 8)
    put(0), put(1)
    made = [I.polled(spark, f"{place}/in", events.schema, place, first, most_files=1)]
    put(2)
    made += [I.polled(spark, f"{place}/in", events.schema, place, first + timedelta(hours=h), most_files=1) for h in (19, 20, 21)]
    assert made == [True, False, True, False]
    polls = I.polls(spark, place).filter(F.size("batches") > 0).select("polled_at", F.explode("batches").alias("batch"))
    number = F.when(F.col("polled_at") == F.lit(first), 0).otherwise(1).cast("long")
    rows = spark.read.parquet(f"{place}/rows").join(polls.select("batch", number.alias("poll")), "batch")
    return rows.groupBy("event_type", "poll").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text <> ''")
def stream_embedding(spark, d):
    """Stream: incremental embedding: texts that come in are embedded once."""
    path = _place(spark)
    embed = V.hashed_words()
    state = {"now": spark.createDataFrame([], "hash string, vector array<float>")}

    def write(rows) -> None:
        target = f"{path}/table-{uuid.uuid4().hex}"
        rows.write.parquet(target)
        state["now"] = spark.read.parquet(target)

    def merged(old, new):
        return old.unionByName(V.embed_pending(new, old, lambda batch: [embed(t) for t in batch]))

    stream = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents*.parquet").filter("text <> ''").select(F.sha2("text", 256).alias("hash"), "text")
    I.upserting(stream, lambda: state["now"], write, merged, f"{path}/state").start().awaitTermination()
    return state["now"].select("hash")


@query("""WITH RECURSIVE p AS (SELECT p_brand AS doc, p_partkey AS pos, p_type, CASE WHEN p_size % 2 = 0 THEN 'page' WHEN p_partkey % 3 = 0 THEN 'low' WHEN p_partkey % 7 = 0 THEN 'verse' ELSE 'text' END AS kind FROM part),
c AS (SELECT *, lead(kind) OVER (PARTITION BY doc ORDER BY pos) AS after FROM p), t AS (SELECT p_type AS title, row_number() OVER (ORDER BY p_type) AS place FROM (SELECT DISTINCT p_type FROM part)),
h AS (SELECT doc, place, title, pos FROM c JOIN t ON title = p_type WHERE kind = 'page' AND after IN ('page', 'text')),
f AS (SELECT DISTINCT doc, 0::BIGINT AS place, ''::VARCHAR AS title, -1::BIGINT AS pos, -1::BIGINT AS last FROM p UNION ALL
 SELECT f.doc, t.place, t.title, (SELECT min(pos) FROM h WHERE h.doc = f.doc AND h.place = t.place AND h.pos > f.last), coalesce((SELECT min(pos) FROM h WHERE h.doc = f.doc AND h.place = t.place AND h.pos > f.last), f.last) FROM f JOIN t ON t.place = f.place + 1)
SELECT doc, place, title, pos FROM f WHERE place > 0 AND pos IS NOT NULL""")
def section_starts(spark, d):
    """S-14: title pages in order; running heads before small letters and verse numbers don't count, one wrong letter does no harm."""
    from pyspark.sql import Window as W

    part = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("X"), F.expr("substring(p_type, 2)"))).otherwise(F.col("p_type"))
    text = (
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("THE BOOK, OF "), name, F.lit("."))).when(F.col("p_partkey") % 3 == 0, F.lit("and so on"))
        .when(F.col("p_partkey") % 7 == 0, F.lit("12 And then")).otherwise("In the beginning.")
    )
    titles = part.select(F.col("p_type").alias("title")).distinct().withColumn("place", F.row_number().over(W.orderBy("title")).cast("long"))
    return S.section_starts(part.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("pos"), text.alias("text")), titles)
