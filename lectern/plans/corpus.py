"""Lookups, joins and annotations over the hierarchy of the supplied tables.

region, nation, customer and orders stand for volume, book, chapter and verse; a book of an even nation has the testament "New", of one
divisible by five none. A verse's number is its place among its customer's orders, its reference "<book> <chapter>:<number>".
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import analytics as A
from lectern.operators import hierarchy as H
from lectern.operators import merge as M
from lectern.operators import passages as P
from lectern.operators import ranking as R
from lectern.operators import records as D
from lectern.operators import workflow as K
from lectern.plans.registry import query, table
from lectern.storage import apart, written

#: The hierarchy in SQL: ch (chapters) and ve (verses).
HIERARCHY = """ch AS (SELECT c_custkey AS chapter_id, c_custkey AS chapter_number, n_name AS book_name, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN 'New Testament' ELSE 'Old Testament' END AS testament,
 lower(r_name) AS volume_slug, r_regionkey AS volume_sort FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ve AS (SELECT o_orderkey AS verse_id, ch.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS verse_number, o_orderpriority AS text,
 book_name || ' ' || chapter_number || ':' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS reference FROM orders JOIN ch ON o_custkey = chapter_id)"""


def chapters(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    testament = F.when(F.col("n_nationkey") % 5 != 0, F.when(F.col("n_nationkey") % 2 == 0, "New Testament").otherwise("Old Testament"))
    books = nation.select("n_nationkey", F.col("n_name").alias("book_name"), testament.alias("testament"), F.lower("r_name").alias("volume_slug"), F.col("r_regionkey").alias("volume_sort"))
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("chapter_id"), F.col("c_custkey").alias("chapter_number"), "c_nationkey")
    return own.join(books, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey", "n_nationkey")


def verses(spark, d):
    orders = apart(table(spark, d, "orders").select(F.col("o_orderkey").alias("verse_id"), F.col("o_custkey").alias("chapter_id"), F.col("o_orderpriority").alias("text")), "chapter_id")
    number = F.row_number().over(W.partitionBy("chapter_id").orderBy("verse_id")).cast("long")
    rows = orders.join(chapters(spark, d), "chapter_id").withColumn("verse_number", number)
    return rows.withColumn("reference", F.concat("book_name", F.lit(" "), F.col("chapter_number").cast("string"), F.lit(":"), F.col("verse_number").cast("string")))


def notes(spark, d):
    """Events as notes: on a verse (views), else on a chapter; errors are deleted ones."""
    on_verse, at = F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(on_verse, F.col("event_id")).alias("verse_id"), F.when(~on_verse, F.col("user_id")).alias("chapter_id"), F.col("props").alias("text"),
        at.alias("updated_at"), F.when(F.col("event_type") == "error", at).alias("deleted_at"), "event_type", "value",
    )


NOTES = """no AS (SELECT event_id AS id, CASE WHEN event_type = 'view' THEN event_id END AS verse_id, CASE WHEN event_type <> 'view' THEN user_id END AS chapter_id, props AS text,
 strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS updated_at, CASE WHEN event_type = 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS deleted_at, event_type, value FROM events)"""


@query(f"WITH {HIERARCHY} SELECT u.c AS chapter_id, volume_slug, chapter_id IS NOT NULL AS found FROM (SELECT DISTINCT user_id * 7 AS c FROM events) u LEFT JOIN ch ON chapter_id = c")
def key_lookup(spark, d):
    """P-04, P-16: rows by their key; a missing one is marked."""
    wanted = table(spark, d, "events").select((F.col("user_id") * 7).alias("chapter_id")).distinct()
    return H.by_key(chapters(spark, d).select("chapter_id", "volume_slug"), wanted, "chapter_id").select("chapter_id", "volume_slug", "found")


@query("SELECT coalesce(s.key, k.key) AS key, coalesce(s.value, k.fallback) AS value FROM (SELECT c_name AS key, 'none' AS fallback FROM customer) k LEFT JOIN (SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_acctbal > 0) s ON s.key = k.key")
def setting_lookup(spark, d):
    """P-06: settings with a default."""
    customer = table(spark, d, "customer")
    settings = customer.filter("c_acctbal > 0").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    return H.setting(settings, customer.select(F.col("c_name").alias("key"), F.lit("none").alias("default")))


@query(f"WITH {NOTES} SELECT chapter_id, id FROM no WHERE deleted_at IS NULL AND chapter_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY updated_at DESC, id DESC) = 1")
def latest_note(spark, d):
    """P-07, P-08: the newest note of each chapter that isn't deleted."""
    return H.latest_active(notes(spark, d).filter("chapter_id IS NOT NULL"), ["chapter_id"], "updated_at", "id").select("chapter_id", "id")


@query("SELECT lower(n_name) AS lookup, n_nationkey FROM nation")
def lexicon_lookup(spark, d):
    """P-09, P-10: an entry by its name in any case."""
    nation = table(spark, d, "nation")
    return H.lookup_ci(nation, "n_name", nation.select(F.upper("n_name").alias("wanted")), "n_nationkey").select("lookup", "n_nationkey")


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, p_brand AS meaning, unnest(list_distinct([p_name, p_type, p_brand])) AS spelling FROM part)
SELECT spelling, max_by(name, id) AS name, max_by(meaning, id) AS meaning FROM n GROUP BY spelling""")
def spelling_links(spark, d):
    """P-11: each spelling of a name; the last row that has it decides."""
    return H.spelling_links(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("meaning"), F.array("p_type", "p_brand").alias("forms")))


@query("SELECT l_suppkey AS topic_id, l_orderkey, l_linenumber::BIGINT AS l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS position FROM lineitem WHERE l_returnflag = 'R'")
def topic_talks(spark, d):
    """P-12: what belongs to a topic, in order."""
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'R'").withColumnRenamed("l_suppkey", "topic_id")
    return H.children(rows, "topic_id", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").select("topic_id", "l_orderkey", F.col("l_linenumber").cast("long"), "position")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'gear') AND contains(lower(p_name), 'ed')")
def works_by_words(spark, d):
    """P-13 to P-15: names that contain every word."""
    part = table(spark, d, "part").filter(H.contains_literal("p_name", "GEAR"))
    return part.filter(H.all_words_in(F.col("p_name"), ["gear", "ed"])).select("p_partkey", "p_name")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND (source IS NULL OR source <> 'src1')")
def masked_pieces(spark, d):
    """P-17: filters by kind and volume, and volumes left out."""
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("kind"), F.col("source").alias("volume_slug"))
    return H.masked(rows, kinds=["en", "de"], without=("src1",)).select("doc_id")


@query(f"WITH {HIERARCHY} SELECT verse_id FROM ve WHERE chapter_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def pieces_in_chapters(spark, d):
    """P-18, T-10: verses of given chapters, by a semi-join."""
    keys = table(spark, d, "events").filter("event_type = 'purchase'").select("user_id").distinct()
    return H.within(verses(spark, d), keys, "chapter_id").select("verse_id")


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name, n_nationkey) AS place FROM nation")
def all_topics(spark, d):
    """P-19: ids and names in order of names."""
    return H.named_list(table(spark, d, "nation"), "n_nationkey", "n_name")


@query(f"""WITH {NOTES}, s AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS place FROM no WHERE deleted_at IS NULL QUALIFY place <= 20)
SELECT id, place, updated_at, CAST(json_extract_string(text, '$.k') AS BIGINT) AS k FROM s WHERE id % 7 <> 0""")
def recent_sessions(spark, d):
    """P-20: the newest twenty sessions; of these, damaged ones (here every seventh) are left out."""
    damaged = F.when(F.col("id") % 7 == 0, F.lit("[not json")).otherwise(F.col("text"))
    return H.recent_sessions(notes(spark, d).withColumn("data", damaged), "k:bigint")


@query(f"WITH {HIERARCHY}, {NOTES} SELECT id, volume_slug, coalesce(volume_slug IN ('asia', 'africa'), false) AS within FROM no LEFT JOIN ch USING (chapter_id)")
def volume_of_hits(spark, d):
    """P-21: a hit's volume, and whether it is one of a set."""
    return H.volume_of(notes(spark, d).select("id", "chapter_id"), chapters(spark, d), ["asia", "africa"]).select("id", "volume_slug", "within")


@query("""SELECT doc_id, CASE WHEN length(text) > 5000 THEN 'description too long' WHEN lang = 'de' THEN 'missing or invalid version' WHEN length(split_part(text, chr(10), 1)) > 200 OR split_part(text, chr(10), 1) = '' THEN 'missing or invalid platform'
 WHEN source IN ('src1', 'src2') THEN 'invalid fingerprint' END AS problem FROM documents""")
def report_problems(spark, d):
    """P-24: what is wrong with a report."""
    rows = table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("description"), F.when(F.col("lang") != "de", F.lit("1.0")).alias("version"), F.substring_index("text", "\n", 1).alias("platform"), F.lit(None).cast("string").alias("contact"),
        F.lit("E").alias("error"), F.when(F.col("source").isin("src1", "src2"), F.lit("xyz")).otherwise(F.substring(F.sha1("text"), 1, 12)).alias("fingerprint"),
    )
    return rows.select("doc_id", H.report_problem().alias("problem"))


@query(f"WITH {HIERARCHY} SELECT chapter_id, CASE WHEN volume_slug = 'asia' OR testament = 'New Testament' THEN 'greek' WHEN testament IS NOT NULL THEN 'hebrew' END AS language FROM ch")
def original_language(spark, d):
    """P-25: which language's words come first; the volume asia stands for the one outside the testaments."""
    slug = F.when(F.col("volume_slug") == "asia", F.lit("apocrypha")).otherwise(F.col("volume_slug"))
    return chapters(spark, d).select("chapter_id", H.original_language(slug, F.col("testament")).alias("language"))


@query(f"WITH {HIERARCHY} SELECT verse_id, reference FROM ve WHERE (book_name, chapter_number, verse_number) IN (SELECT n_name, user_id, event_id % 9 FROM events, nation WHERE n_nationkey = user_id % 25)")
def verse_by_reference(spark, d):
    """J-01: verses by book, chapter and number."""
    nation = table(spark, d, "nation").select(F.col("n_name").alias("book_name"), "n_nationkey")
    wanted = table(spark, d, "events").select("event_id", F.col("user_id").alias("chapter_number")).join(nation, F.col("chapter_number") % 25 == F.col("n_nationkey"))
    return H.verse_by_reference(verses(spark, d), wanted.select("book_name", "chapter_number", (F.col("event_id") % 9).alias("verse_number"))).select("verse_id", "reference")


@query(f"WITH {HIERARCHY} SELECT chapter_id, volume_slug, testament, book_name FROM ch WHERE chapter_id IN (SELECT user_id FROM events)")
def chapter_location(spark, d):
    """J-04: a chapter's volume, testament and book."""
    return H.location(chapters(spark, d), table(spark, d, "events").select(F.col("user_id").alias("chapter_id")))


@query(f"""WITH {HIERARCHY}, t AS (SELECT l_suppkey AS topic_id, volume_slug, CASE WHEN l_linenumber = 7 THEN reference || 'x' ELSE reference END AS reference, l_partkey AS sort_order FROM lineitem JOIN ve ON l_orderkey = verse_id WHERE l_returnflag = 'A')
SELECT topic_id, verse_id, row_number() OVER (PARTITION BY topic_id ORDER BY sort_order, verse_id) AS place FROM t JOIN ve USING (volume_slug, reference)""")
def topic_verses(spark, d):
    """J-05: a topic's verses by volume and reference; references that name none (here those of seventh lines) go."""
    ve = verses(spark, d)
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'A'").join(ve, F.col("l_orderkey") == F.col("verse_id"))
    reference = F.when(F.col("l_linenumber") == 7, F.concat("reference", F.lit("x"))).otherwise(F.col("reference"))
    listed = lines.select(F.col("l_suppkey").alias("topic_id"), "volume_slug", reference.alias("reference"), F.col("l_partkey").alias("sort_order"))
    return H.topic_verses(listed, ve).select("topic_id", "verse_id", "place")


@query(f"""WITH {HIERARCHY}, {NOTES} SELECT id, coalesce(reference, c.book_name || ' ' || c.chapter_number) AS label FROM no LEFT JOIN (SELECT verse_id, reference FROM ve) v USING (verse_id)
LEFT JOIN (SELECT chapter_id, book_name, chapter_number FROM ch) c ON c.chapter_id = no.chapter_id""")
def labelled_notes(spark, d):
    """J-09, J-12, J-13: notes and tags with the label of their verse or chapter."""
    return H.labelled_targets(notes(spark, d).select("id", "verse_id", "chapter_id"), verses(spark, d), chapters(spark, d)).select("id", "label")


@query("SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS listed FROM orders GROUP BY o_custkey")
def highlights_in_order(spark, d):
    """J-11: a chapter's highlights as one ordered array."""
    found = H.grouped_in_order(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus"])
    return found.select("o_custkey", F.array_join(F.transform("rows", lambda r: F.concat(r["o_orderkey"].cast("string"), F.lit(":"), r["o_orderstatus"])), ",").alias("listed"))


@query(f"""WITH {HIERARCHY}, {NOTES} SELECT id, 'verse' AS kind, volume_slug, reference, NULL AS book_name, -1 AS chapter_number FROM no JOIN (SELECT verse_id, volume_slug, reference FROM ve) v USING (verse_id)
UNION ALL SELECT id, 'chapter', volume_slug, NULL, book_name, chapter_number FROM no JOIN ch ON ch.chapter_id = no.chapter_id WHERE no.verse_id IS NULL""")
def natural_targets(spark, d):
    """J-14: what notes hang on, by keys that mean the same everywhere."""
    return H.natural_targets(notes(spark, d), verses(spark, d), chapters(spark, d)).withColumn("chapter_number", F.coalesce(F.col("chapter_number").cast("long"), F.lit(-1)))


@query(f"""WITH {HIERARCHY}, {NOTES} SELECT id, coalesce(no.verse_id, -1) AS verse_id, CASE WHEN no.verse_id IS NULL THEN no.chapter_id ELSE -1 END AS chapter_id FROM no LEFT JOIN ve ON ve.verse_id = no.verse_id LEFT JOIN ch ON ch.chapter_id = no.chapter_id
WHERE ve.verse_id IS NOT NULL OR (no.verse_id IS NULL AND ch.chapter_id IS NOT NULL)""")
def resolved_targets(spark, d):
    """J-14: natural keys turned into ids again."""
    ve, ch = verses(spark, d), chapters(spark, d)
    found = H.resolved_targets(H.natural_targets(notes(spark, d), ve, ch), ve, ch)
    return found.select("id", F.coalesce("verse_id", F.lit(-1)).alias("verse_id"), F.coalesce("chapter_id", F.lit(-1)).alias("chapter_id"))


@query("""WITH e AS (SELECT (CASE WHEN p_partkey % 3 = 0 THEN 'H' ELSE 'G' END) || p_partkey AS strongs, p_name || ', ' || p_brand AS gloss, '(' || p_type || '); x' AS kjv FROM part),
n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_type FROM part), h AS (SELECT DISTINCT name, strongs FROM n JOIN e ON lower(name) = lower(split_part(gloss, ',', 1)) OR lower(name) = lower(replace(replace(split_part(kjv, ';', 1), '(', ''), ')', '')))
SELECT name, strongs, row_number() OVER (PARTITION BY name ORDER BY strongs[1] <> 'H', CAST(strongs[2:] AS INT)) AS place FROM h QUALIFY place <= 3""")
def name_entries(spark, d):
    """J-21: dictionary entries that are a name, Hebrew first."""
    part = table(spark, d, "part")
    strongs = F.concat(F.when(F.col("p_partkey") % 3 == 0, "H").otherwise("G"), F.col("p_partkey").cast("string"))
    entries = part.select(strongs.alias("strongs"), F.concat_ws(", ", "p_name", "p_brand").alias("gloss"), F.concat(F.lit("("), "p_type", F.lit("); x")).alias("kjv_renderings"))
    return H.name_entries(part.select(F.explode(F.array("p_name", "p_type")).alias("name")).distinct(), entries)


@query(f"""WITH {HIERARCHY}, c AS (SELECT DISTINCT l_suppkey AS work, reference FROM lineitem JOIN ve ON l_orderkey = verse_id), l AS (SELECT DISTINCT work, chapter_id, verse_number AS v FROM c JOIN ve USING (reference)),
r AS (SELECT *, v - row_number() OVER (PARTITION BY work, chapter_id ORDER BY v) AS run FROM l), s AS (SELECT work, chapter_id, min(v) AS first, max(v) AS last FROM r GROUP BY work, chapter_id, run)
SELECT work, row_number() OVER (PARTITION BY work ORDER BY chapter_id, first) AS place, chapter_id, first, last FROM s QUALIFY place <= 8""")
def cited_passages(spark, d):
    """J-22: the first eight passages that a supplier's lines cite, neighbouring verses joined."""
    ve = verses(spark, d)
    citations = apart(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey").join(ve, F.col("l_orderkey") == F.col("verse_id")).select(F.col("l_suppkey").alias("work"), "reference")
    return H.cited_passages(citations, ve)


_CONSENSUS = f"""{HIERARCHY}, p AS (SELECT DISTINCT l_suppkey AS work, reference FROM lineitem JOIN ve ON l_orderkey = verse_id), sz AS (SELECT work, count(*) AS refs FROM p GROUP BY work), n AS (SELECT count(*) AS total FROM sz),
df AS (SELECT reference, count(*) AS df FROM p GROUP BY reference), q AS (SELECT s_nationkey AS query, s_suppkey AS work, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS rank, s_suppkey // 2 AS identity FROM supplier),
q1 AS (SELECT query, work, rank FROM q JOIN sz USING (work) WHERE rank < 25 QUALIFY row_number() OVER (PARTITION BY query, identity ORDER BY rank) = 1),
c AS (SELECT query, work, 1 / greatest(1.0::DOUBLE, sqrt(refs / 15)) / sqrt(rank + 1) AS w FROM q1 JOIN sz USING (work)), v AS (SELECT query, reference, sum(w) AS w, count(*) AS works FROM p JOIN c USING (work) GROUP BY query, reference HAVING count(*) >= 2),
s AS (SELECT query, chapter_id, verse_number AS v, works, round(w * ln(total::DOUBLE / df), 6) AS score FROM v JOIN df USING (reference) JOIN (SELECT reference, chapter_id, verse_number, volume_slug FROM ve) USING (reference), n WHERE volume_slug <> 'asia'),
r AS (SELECT *, v - row_number() OVER (PARTITION BY query, chapter_id ORDER BY v) AS run FROM s), g AS (SELECT *, (row_number() OVER (PARTITION BY query, chapter_id, run ORDER BY v) - 1) // 6 AS piece FROM r)"""


@query(f"""WITH {_CONSENSUS} SELECT query, row_number() OVER (PARTITION BY query ORDER BY max(score) DESC, chapter_id, min(v)) AS rank, chapter_id, min(v) AS first, max(v) AS last, max(score) AS score, max(works) AS works
FROM g GROUP BY query, chapter_id, run, piece QUALIFY rank <= 10""")
def consensus_passages(spark, d):
    """H-08: passages that several of a nation's suppliers cite; reprints (here pairs of suppliers) count once, a volume is left out."""
    ve = verses(spark, d)
    citations = table(spark, d, "lineitem").join(ve, F.col("l_orderkey") == F.col("verse_id")).select(F.col("l_suppkey").alias("work"), "reference")
    rank = F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")) - 1
    works = table(spark, d, "supplier").select(F.col("s_nationkey").alias("query"), F.col("s_suppkey").alias("work"), rank.alias("rank"), F.floor(F.col("s_suppkey") / 2).alias("identity"))
    return R.consensus_passages(R.consensus(citations, works), ve, without=("asia",))


@query(f"""WITH RECURSIVE {HIERARCHY}, h AS (SELECT n_regionkey AS query, o_orderkey AS doc, row_number() OVER (PARTITION BY n_regionkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, CASE WHEN o_orderstatus = 'F' THEN 'talk' ELSE 'scripture' END AS kind, book_name AS book,
 o_custkey % 20 AS chapter, CASE WHEN o_orderstatus <> 'F' THEN verse_number END AS first, verse_number + 1 AS last FROM orders JOIN ve ON o_orderkey = verse_id JOIN nation ON n_name = book_name QUALIFY rank <= 100),
f AS (SELECT query, rank AS i, [{{'doc': doc, 'kind': kind, 'book': book, 'chapter': chapter, 'first': first, 'last': last}}] AS kept FROM h WHERE rank = 1 UNION ALL
 SELECT h.query, h.rank, CASE WHEN len(f.kept) >= 20 THEN f.kept WHEN p.at > 0 THEN list_transform(f.kept, lambda k, j: CASE WHEN j = p.at THEN {{'doc': k.doc, 'kind': k.kind, 'book': k.book, 'chapter': k.chapter, 'first': least(k.first, h.first), 'last': greatest(k.last, h.last)}} ELSE k END)
  WHEN len(list_filter(f.kept, lambda k: k.kind = h.kind)) >= CASE h.kind WHEN 'talk' THEN 6 ELSE 15 END THEN f.kept ELSE f.kept || [{{'doc': h.doc, 'kind': h.kind, 'book': h.book, 'chapter': h.chapter, 'first': h.first, 'last': h.last}}] END
 FROM f JOIN h ON h.query = f.query AND h.rank = f.i + 1, LATERAL (SELECT coalesce(list_position(list_transform(f.kept, lambda k: coalesce(k.book = h.book AND k.chapter = h.chapter AND h.first <= k.last + 1 AND h.last >= k.first - 1, false)), true), 0) AS at) p),
l AS (SELECT query, kept FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY i DESC) = 1), u AS (SELECT query, unnest(range(1, len(kept) + 1)) AS place, unnest(kept) AS k FROM l)
SELECT query::BIGINT AS query, place::BIGINT AS place, k.doc AS doc, k.kind AS kind, coalesce(k.first, -1) AS first, k.last AS last FROM u""")
def consolidated_hits(spark, d):
    """H-01, W-05: windows merged in rank order before kinds are capped."""
    nation = table(spark, d, "nation").select(F.col("n_name").alias("book_name"), F.col("n_regionkey").cast("long").alias("query"))
    rows = table(spark, d, "orders").join(verses(spark, d), F.col("o_orderkey") == F.col("verse_id")).join(nation, "book_name")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    first = F.when(F.col("o_orderstatus") != "F", F.col("verse_number"))
    hits = rows.select("query", F.col("o_orderkey").alias("doc"), rank.alias("rank"), F.when(F.col("o_orderstatus") == "F", "talk").otherwise("scripture").alias("kind"),
                       F.col("book_name").alias("book"), (F.col("o_custkey") % 20).alias("chapter"), first.alias("first"), (F.col("verse_number") + 1).alias("last")).filter("rank <= 100")
    quotas = spark.range(2).select(F.when(F.col("id") == 0, "talk").otherwise("scripture").alias("kind"), F.when(F.col("id") == 0, 6).otherwise(15).alias("quota"))
    return K.consolidated(hits, quotas, 20).withColumn("first", F.coalesce("first", F.lit(-1)))


@query(f"WITH {HIERARCHY} SELECT chapter_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY verse_number)) AS text_sha256, count(*) AS n FROM ve GROUP BY chapter_id")
def chapter_texts(spark, d):
    """A-03: a chapter's verses as one text."""
    rows = D.chapter_texts(verses(spark, d), "chapter_id", "verse_number", "text")
    return rows.select("chapter_id", F.sha2("text", 256).alias("text_sha256"), F.size(F.split("text", "\n\n")).cast("long").alias("n"))


@query(f"WITH {HIERARCHY} SELECT chapter_id, count(*) AS cited FROM ve WHERE reference IN (SELECT reference FROM ve JOIN lineitem ON l_orderkey = verse_id WHERE l_returnflag = 'R') GROUP BY chapter_id")
def cited_verses(spark, d):
    """A-14: of each chapter, how many verses are cited."""
    ve = verses(spark, d)
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey").distinct()
    return D.cited_verses(ve, ve.join(lines, F.col("l_orderkey") == F.col("verse_id")))


@query(f"WITH {HIERARCHY} SELECT reference, text FROM ve WHERE volume_slug = 'europe'")
def volume_texts(spark, d):
    """F-22: a volume's references and texts."""
    return D.volume_texts(verses(spark, d), "europe").select("reference", "text")


@query("SELECT a.l_orderkey, a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_linenumber <= b.l_linenumber + b.l_quantity // 20 AND b.l_linenumber <= a.l_linenumber + a.l_quantity // 20")
def overlapping_ranges(spark, d):
    """W-07: pairs of an order's ranges that share a number, the order being the key."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 20)).alias("last"))
    other = rows.select("l_orderkey", F.col("l_partkey").alias("b"), F.col("first").alias("f"), F.col("last").alias("l"))
    return rows.join(other, "l_orderkey").filter("l_partkey < b").filter(D.overlap(F.col("first"), F.col("last"), F.col("f"), F.col("l"))).select("l_orderkey", F.col("l_partkey").alias("a"), "b")


@query("""WITH RECURSIVE r AS (SELECT o_custkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i, o_orderkey % 60 AS a, o_orderkey % 60 + 2 AS b FROM orders),
f AS (SELECT o, i, [{'a': a, 'b': b}] AS kept FROM r WHERE i = 1 UNION ALL
 SELECT r.o, r.i, CASE WHEN p.at > 0 THEN list_transform(f.kept, lambda k, j: CASE WHEN j = p.at THEN {'a': least(k.a, r.a), 'b': greatest(k.b, r.b)} ELSE k END) ELSE f.kept || [{'a': r.a, 'b': r.b}] END
 FROM f JOIN r ON r.o = f.o AND r.i = f.i + 1, LATERAL (SELECT coalesce(list_position(list_transform(f.kept, lambda k: k.a <= r.b + 3 AND r.a <= k.b + 3 AND greatest(k.b, r.b) - least(k.a, r.a) < 10), true), 0) AS at) p),
l AS (SELECT o, kept FROM f QUALIFY row_number() OVER (PARTITION BY o ORDER BY i DESC) = 1), u AS (SELECT o, unnest(range(1, len(kept) + 1)) AS place, unnest(kept) AS k FROM l)
SELECT o AS owner, place::BIGINT AS place, k.a AS first, k.b AS last FROM u""")
def near_merge(spark, d):
    """W-06: passages at most two verses apart merged if the whole has ten at most."""
    rank = F.struct(-F.col("o_totalprice"), F.col("o_orderkey"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), rank.alias("rank"), (F.col("o_orderkey") % 60).alias("first"), (F.col("o_orderkey") % 60 + 2).alias("last"))
    return A.merge_intervals(rows, gap=3, longest=10).select("owner", F.col("place").cast("long"), "first", "last")


@query("""WITH k AS (SELECT o_custkey, o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders), g AS (SELECT o_custkey, m, lead(m) OVER (PARTITION BY o_custkey ORDER BY m) AS next FROM (SELECT DISTINCT o_custkey, m FROM k))
SELECT o_custkey, m AS after, next - m - 1 AS missing FROM g WHERE next - m > 1""")
def number_gaps(spark, d):
    """W-13: months without an order between those with one."""
    months = table(spark, d, "orders").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("m")).distinct()
    return A.number_gaps(months, "o_custkey", "m")


@query("""WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber AS first, l_linenumber + l_quantity::INT % 3 AS last, l_quantity::INT AS a, l_quantity::INT + 5 AS b FROM lineitem), u AS (SELECT *, unnest(range(first, last + 1)) AS line FROM s)
SELECT l_orderkey * 100000 + l_partkey AS id, line::BIGINT AS line, CASE WHEN line = first THEN a ELSE 0 END AS "from", CASE WHEN line = last THEN b ELSE -1 END AS "to" FROM u""")
def split_selection(spark, d):
    """W-15: a selection over several lines, one row for each."""
    q = F.col("l_quantity").cast("int")
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("id"), F.col("l_linenumber").alias("first"), q.alias("start"), (F.col("l_linenumber") + q % 3).alias("last"), (q + 5).alias("end"))
    return A.split_range(rows).select("id", F.col("line").cast("long"), "from", F.coalesce("to", F.lit(-1)).alias("to"))


@query("""WITH s AS (SELECT o_custkey, date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS b FROM orders GROUP BY o_custkey), m AS (SELECT o_custkey, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS m FROM s)
SELECT o_custkey AS id, year(m) AS year, month(m) AS month FROM m""")
def month_range(spark, d):
    """W-16: every month from a customer's first order to the last."""
    return A.months(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")))


@query("""SELECT o_custkey AS query, o_orderkey AS doc, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 3 END AS tier, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 3 END, o_orderkey) AS place FROM orders""")
def hits_by_tier(spark, d):
    """T-05: hits by the tier of their kind."""
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), F.col("o_orderkey").alias("rank"), F.col("o_orderstatus").alias("kind"))
    return D.by_tier(hits, {"O": 0, "F": 1}).select("query", "doc", "tier", "place")


@query("""WITH o AS (SELECT o_custkey AS query, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, CASE WHEN o_orderstatus = 'P' THEN 'talk' ELSE 'article' END AS kind, o_orderpriority AS title, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'u' || o_orderkey % 30 END AS url FROM orders),
w AS (SELECT lower(trim(title)) AS t, min(url) AS original FROM o WHERE kind = 'talk' AND url IS NOT NULL GROUP BY 1), r AS (SELECT o.* EXCLUDE (url), CASE WHEN o.url IS NULL THEN NULL ELSE coalesce(original, o.url) END AS url FROM o LEFT JOIN w ON t = lower(trim(title))),
k AS (SELECT * FROM r WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY rank) = 1 UNION ALL SELECT * FROM r WHERE url IS NULL)
SELECT query, id, url, row_number() OVER (PARTITION BY query ORDER BY kind <> 'talk', rank) AS place FROM k""")
def original_works(spark, d):
    """T-08, H-10: reprints replaced by their originals, each once, talks first."""
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    url = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("u"), (F.col("o_orderkey") % 30).cast("string")))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), rank.alias("rank"), F.when(F.col("o_orderstatus") == "P", "talk").otherwise("article").alias("kind"),
                                            F.col("o_orderpriority").alias("title"), F.lit("s").alias("speaker"), url.alias("url"))
    works = rows.filter("kind = 'talk' AND url IS NOT NULL").select("title", "speaker", "url").distinct()
    return R.originals(rows, works).select("query", "id", "url", F.col("place").cast("long"))


@query("SELECT o_custkey AS query, o_orderkey AS doc FROM orders WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 3")
def first_key_verses(spark, d):
    """T-09: the first three results with a key verse."""
    rank = F.struct("o_orderdate", "o_orderkey")
    return D.first_key_verses(table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), rank.alias("rank"), F.when(F.col("o_orderstatus") == "P", 1).alias("key_verse"))).select("query", "doc")


@query("""WITH p AS (SELECT doc_id AS key, 'document' AS kind, lang AS volume_slug FROM documents WHERE lang IS NULL OR lang <> 'fr' UNION ALL SELECT p_partkey, 'part', NULL FROM part) SELECT kind, key::VARCHAR AS key, volume_slug FROM p""")
def collected_pieces(spark, d):
    """U-01, G-05: cards of several kinds in one table, hidden volumes left out."""
    docs = P.card(table(spark, d, "documents"), "document", F.col("doc_id"), F.lit("Document"), F.col("text"), F.col("lang"))
    parts = P.card(table(spark, d, "part"), "part", F.col("p_partkey"), F.col("p_name"), F.col("p_type"))
    return P.collect_pieces(("fr",), docs, parts).select("kind", "key", "volume_slug")


@query("""WITH RECURSIVE r AS (SELECT o_custkey AS owner, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i, o_orderkey % 10 AS id, o_orderpriority AS label FROM orders),
f AS (SELECT owner, i, [{'id': id, 'label': label}] AS kept FROM r WHERE i = 1 UNION ALL
 SELECT r.owner, r.i, CASE WHEN len(f.kept) >= 4 OR len(list_filter(f.kept, lambda k: k.id = r.id OR k.label = r.label)) > 0 THEN f.kept ELSE f.kept || [{'id': r.id, 'label': r.label}] END FROM f JOIN r ON r.owner = f.owner AND r.i = f.i + 1),
l AS (SELECT owner, kept FROM f QUALIFY row_number() OVER (PARTITION BY owner ORDER BY i DESC) = 1), u AS (SELECT owner, unnest(range(1, len(kept) + 1)) AS place, unnest(kept) AS k FROM l)
SELECT owner, place::BIGINT AS place, k.id AS id, k.label AS label FROM u""")
def merged_references(spark, d):
    """U-02: references of an answer and of a search in one list, none twice by id or label."""
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), rank.alias("rank"), (F.col("o_orderkey") % 10).alias("id"), F.col("o_orderpriority").alias("label"))
    return A.merge_lists(rows, 4).select("owner", F.col("place").cast("long"), "id", "label")


@query("""WITH g AS (SELECT 0 AS block, c_nationkey AS query, c_custkey AS doc, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 5 UNION ALL
 SELECT 1, c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rank FROM customer QUALIFY rank <= 8 UNION ALL SELECT -1, c_nationkey, c_custkey, 1 FROM customer WHERE c_custkey % 100 = 0),
o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query, doc ORDER BY block, rank) = 1)
SELECT query::BIGINT AS query, doc, row_number() OVER (PARTITION BY query ORDER BY block, rank, doc) AS place FROM o""")
def grouped_candidates(spark, d):
    """H-03, U-06: pinned hits, then each group's best, each once."""
    customer = table(spark, d, "customer").withColumn("query", F.col("c_nationkey").cast("long")).withColumn("doc", F.col("c_custkey"))
    by = lambda *order: customer.select("query", "doc", F.row_number().over(W.partitionBy("query").orderBy(*order)).alias("rank"))
    searches = [("rich", 5, by(F.col("c_acctbal").desc(), "c_custkey")), ("poor", 8, by("c_acctbal", "c_custkey"))]
    return R.in_groups(searches, customer.filter("c_custkey % 100 = 0").select("query", "doc", F.lit(1).alias("rank"))).select("query", "doc", F.col("place").cast("long"))


@query("""SELECT e.event_id AS id, c.c_name AS label FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'view' UNION ALL SELECT e.event_id, n.n_name FROM events e JOIN nation n ON e.user_id = n.n_nationkey WHERE e.event_type = 'click'""")
def read_results(spark, d):
    """H-14: hits read again from the table of their kind; what is gone is dropped."""
    hits = table(spark, d, "events").select(F.col("event_id").alias("query"), F.lit(1).alias("place"), F.col("event_type").alias("kind"), F.col("user_id").alias("key"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("text"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("label"), F.lit("").alias("text"))
    return K.results(hits, {"view": customers, "click": nations}).select(F.col("query").alias("id"), "label")


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'JST ' || c_name WHEN 'MACHINERY' THEN 'Apocrypha: ' || c_name ELSE c_name END AS label FROM customer""")
def volume_marks(spark, d):
    """H-17, F-24: a volume's mark before a label."""
    label = K.labelled(F.col("c_name"), F.col("c_mktsegment"), {"BUILDING": "JST", "MACHINERY": "Apocrypha:"})
    return table(spark, d, "customer").select("c_custkey", label.alias("label"))


@query("""SELECT p_partkey FROM part WHERE p_type <> 'PROMO' OR regexp_matches(lower(p_name), '(^|[^a-z''])(widget|gear[s]?)')""")
def related_words(spark, d):
    """H-16: rows of one kind that share a word's first six letters with the topic; other kinds stay."""
    return R.related_words(table(spark, d, "part"), ["widget", "gear"], "p_name", F.col("p_type") == "PROMO").select("p_partkey")


@query("""WITH f AS (SELECT l_orderkey AS query, CASE WHEN l_returnflag = 'A' THEN 'scripture' ELSE 'talk' END AS kind, l_discount AS fraction, l_linestatus = 'F' AS is_cited, l_partkey AS doc FROM lineitem)
SELECT query, doc FROM f WHERE kind <> 'scripture' OR fraction <= CASE WHEN is_cited THEN 0.10 ELSE 0.05 END""")
def relevant_hits(spark, d):
    """H-11: scripture far down in the ranking of all is left out, unless it is cited."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("doc"), F.when(F.col("l_returnflag") == "A", "scripture").otherwise("talk").alias("kind"), F.col("l_discount").alias("fraction"), (F.col("l_linestatus") == "F").alias("is_cited"))
    return R.relevant(rows).select("query", "doc")


@query("""WITH h AS (SELECT o_custkey AS query, o_orderkey AS doc, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS tier, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderpriority AS title FROM orders),
c AS (SELECT * FROM h WHERE rank <= 4), n AS (SELECT query, tier, count(*) AS have FROM c GROUP BY query, tier),
r AS (SELECT h.query, h.doc, h.tier, h.rank, CASE h.tier WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END - coalesce(have, 0) AS need FROM h LEFT JOIN n ON n.query = h.query AND n.tier = h.tier WHERE h.rank > 4 AND (contains(lower(title), 'low') OR contains(lower(title), 'high')))
SELECT query, doc, tier FROM c UNION ALL SELECT query, doc, tier FROM r QUALIFY row_number() OVER (PARTITION BY query, tier ORDER BY rank) <= need""")
def minimums(spark, d):
    """H-07: tiers short of their minimum topped up with candidates that share a title word."""
    tier = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    title = F.when(F.col("o_orderpriority").rlike("(?i)low|high"), F.lit("low")).otherwise(F.col("o_orderpriority"))
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), tier.alias("tier"), rank.alias("rank"), title.alias("title"))
    return R.topped_up(hits.filter("rank <= 4"), hits.filter("rank > 4"), {0: 2, 1: 3}, ["low"]).select("query", "doc", "tier")


@query("""SELECT o_custkey AS query, string_agg(r || '. ' || o_orderpriority || ': ' || o_orderkey, chr(10) ORDER BY r) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY o_custkey""")
def candidate_lists(spark, d):
    """H-12: the numbered list that a selector reads."""
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return R.candidate_list(table(spark, d, "orders").select(F.col("o_custkey").alias("query"), rank.alias("rank"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").cast("string").alias("text")))


def _selection(spark, d):
    tier = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), rank.alias("rank"), tier.alias("tier"), F.col("o_orderpriority").alias("label"), F.lit("").alias("text"))


@query("""WITH h AS (SELECT o_custkey AS query, o_orderkey AS doc, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS tier, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
p AS (SELECT query, doc, CASE rank WHEN 2 THEN 1 ELSE 2 END AS place FROM h WHERE n >= 10 AND rank <= 2), f AS (SELECT query, doc, tier, rank FROM h WHERE n < 10 QUALIFY row_number() OVER (PARTITION BY query, tier ORDER BY rank) <= CASE tier WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END)
SELECT query, doc, place::BIGINT AS place FROM p UNION ALL SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY tier, rank) FROM f""")
def selected_hits(spark, d):
    """H-24, H-27, H-20: a selector's choice; where its answer can't be used (here for short lists), the best of each tier."""
    return R.selected(_selection(spark, d), lambda prompt: "[2, 1, 2]" if "\n10. " in prompt else "no idea").select("query", "doc", F.col("place").cast("long"))


@query("""WITH l AS (SELECT c_custkey AS k, '1996-01-01' AS t, -1 AS id FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS t, o_orderkey AS id FROM orders WHERE o_custkey % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT coalesce(l.k, n.k) AS target, CASE WHEN l.k IS NULL OR n.t > l.t THEN n.t ELSE l.t END AS updated_at, CASE WHEN l.k IS NULL OR n.t > l.t THEN n.id ELSE l.id END AS id FROM l FULL JOIN n ON l.k = n.k""")
def synced_state(spark, d):
    """D-01 to D-03: devices' records merged into the local ones; those whose target isn't known (here keys divisible by three) are left out."""
    local = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("target"), F.lit("1996-01-01").alias("updated_at"), F.lit(-1).cast("long").alias("id"))
    devices = table(spark, d, "orders").select(F.col("o_custkey").alias("target"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.col("o_orderkey").alias("id"), F.lit("a").alias("file"), F.col("o_orderkey").alias("pos"))
    return K.synced(local, devices, table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("target")))


@query("""SELECT c_name AS key, CASE WHEN c_acctbal > 5000 THEN 'new' ELSE c_mktsegment END AS value FROM customer""")
def saved_settings(spark, d):
    """D-04: settings written over old ones."""
    old = table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    new = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_name").alias("key"), F.lit("new").alias("value"))
    return M.upserted(old, new, ["key"])


@query("""WITH old AS (SELECT DISTINCT lower(p_type) AS tag, p_size AS target, CASE WHEN p_size % 2 = 0 THEN 'x' END AS deleted_at FROM part WHERE p_size < 30), fresh AS (SELECT DISTINCT lower(p_type) AS tag, p_size + 20 AS target FROM part WHERE p_size < 30)
SELECT tag, target, NULL AS deleted_at FROM fresh UNION ALL SELECT tag, target, deleted_at FROM old WHERE (tag, target) NOT IN (SELECT tag, target FROM fresh)""")
def revived_tags(spark, d):
    """D-07: tags by name in any case; a deleted assignment is revived."""
    part = table(spark, d, "part").filter("p_size < 30")
    at = F.lit("t").alias("at")
    assignments = part.select(F.lower("p_type").alias("tag"), F.col("p_size").alias("target"), at, F.when(F.col("p_size") % 2 == 0, "x").alias("deleted_at")).distinct()
    added = part.select(F.upper("p_type").alias("name"), (F.col("p_size") + 20).alias("target"), at).distinct()
    return D.tagged(part.select(F.col("p_type").alias("name")).distinct(), assignments, added)[1].select("tag", "target", "deleted_at")


@query("""SELECT c_custkey::VARCHAR AS uid, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'old' END AS title, CASE WHEN c_acctbal > 0 THEN '{"name":"' || c_name || '"}' ELSE '{}' END AS data FROM customer""")
def saved_sessions(spark, d):
    """D-09: sessions as JSON, replaced by their uid."""
    customer = table(spark, d, "customer").withColumn("uid", F.col("c_custkey").cast("string"))
    old = customer.select("uid", F.lit("old").alias("title"), F.lit("{}").alias("data"), F.lit("a").alias("updated_at"))
    new = customer.filter("c_acctbal > 0").select("uid", F.col("c_mktsegment").alias("title"), F.col("c_name").alias("name"), F.lit("b").alias("updated_at"))
    return D.saved_sessions(old, new).select("uid", "title", "data")


@query("""SELECT e.event_id AS id, CASE WHEN c_custkey IS NOT NULL AND c_custkey <> e.user_id THEN c_custkey ELSE e.user_id END AS target, c_custkey IS NULL OR c_custkey = e.user_id AS unplaced FROM events e LEFT JOIN customer ON c_custkey = e.user_id * 3 - e.user_id % 2""")
def rehomed_marks(spark, d):
    """D-14: marks follow their text to its new place."""
    moved = table(spark, d, "events").select(F.col("user_id").alias("id_a"), (F.col("user_id") * 3 - F.col("user_id") % 2).alias("id_b")).distinct()
    moved = moved.join(table(spark, d, "customer").select(F.col("c_custkey").alias("id_b")), "id_b").select("id_a", "id_b")
    return M.rehomed(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("target")), moved)


@query("""WITH n AS (SELECT p_partkey, length(p_name) AS n, p_size % 8 AS a, p_size % 8 + 3 + p_size % 4 AS b FROM part), m AS (SELECT p_partkey, CASE WHEN a < 4 THEN a WHEN a <= n THEN a + 2 ELSE n + 2 END AS a, CASE WHEN b < 4 THEN b WHEN b <= n THEN b + 2 ELSE n + 2 END AS b FROM n)
SELECT p_partkey, CASE WHEN b > a THEN a ELSE -1 END AS start, CASE WHEN b > a THEN b ELSE -1 END AS "end" FROM m""")
def remapped_spans(spark, d):
    """D-16: highlights carried over an insertion in their text."""
    from lectern.functions.alignment import remap_span

    new = F.concat(F.substring("p_name", 1, 4), F.lit("@#"), F.expr("substring(p_name, 5)"))
    rows = table(spark, d, "part").select("p_partkey", "p_name", new.alias("new"), (F.col("p_size") % 8).alias("a"), (F.col("p_size") % 8 + 3 + F.col("p_size") % 4).alias("b"))
    return rows.select("p_partkey", remap_span("p_name", "new", "a", "b").alias("s")).select("p_partkey", F.coalesce("s.start", F.lit(-1)).alias("start"), F.coalesce("s.end", F.lit(-1)).alias("end"))


@query("SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY o_custkey")
def worklist(spark, d):
    """D-19: what isn't done yet."""
    wanted = table(spark, d, "orders").select("o_custkey").distinct()
    return M.worklist(wanted, table(spark, d, "events").select(F.col("user_id").alias("o_custkey")).distinct(), "o_custkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'fresh' ELSE c_mktsegment END AS value FROM customer")
def refreshed_values(spark, d):
    """D-19: new values over old ones; a failed one keeps the old."""
    customer = table(spark, d, "customer")
    return M.refreshed(customer.select("c_custkey", F.col("c_mktsegment").alias("value")), customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, "fresh").alias("value")), "c_custkey", "value")


@query("""SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 5 AND (SELECT max(ts)::DATE FROM events) - ts::DATE <= 30""")
def retained_reports(spark, d):
    """K-13: the newest five of each user, none older than thirty days."""
    events = table(spark, d, "events").withColumn("id", F.col("event_id"))
    today = events.agg(F.max(F.to_date("ts")).alias("today"))
    return M.retained(events.crossJoin(F.broadcast(today)), "user_id", "ts", F.col("today")).select("event_id", "user_id")


@query("""WITH h AS (SELECT query, chapter, first, first + 2 AS last, row_number() OVER (PARTITION BY query ORDER BY price DESC, o) AS rank FROM (SELECT o_custkey % 50 AS query, o_custkey % 7 AS chapter, o_orderkey % 40 AS first, o_totalprice AS price, o_orderkey AS o FROM orders)),
w AS (SELECT DISTINCT user_id % 50 AS query, event_id % 7 AS chapter, event_id % 40 AS verse FROM events WHERE event_type = 'purchase' AND event_id % 11 = 0), q AS (SELECT DISTINCT query FROM h),
r AS (SELECT a.ranking, q.query, min(h.rank) AS rank FROM q CROSS JOIN (SELECT unnest(['all', 'late']) AS ranking) a LEFT JOIN (SELECT h.* FROM h JOIN w ON h.query = w.query AND h.chapter = w.chapter AND w.verse BETWEEN h.first AND h.last) h ON h.query = q.query AND (a.ranking = 'all' OR h.rank > 3) GROUP BY a.ranking, q.query)
SELECT ranking, count(*) AS queries, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_10, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_10 FROM r GROUP BY ranking""")
def evaluated_rankings(spark, d):
    """E-02, E-04: two rankings of the same queries, scored by the verses that are wanted."""
    q = F.col("o_custkey") % 50
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    hits = table(spark, d, "orders").withColumn("query", q).select("query", rank.alias("rank"), F.lit("b").alias("book"), (F.col("o_custkey") % 7).alias("chapter"), (F.col("o_orderkey") % 40).alias("first"), (F.col("o_orderkey") % 40 + 2).alias("last"))
    events = table(spark, d, "events").filter("event_type = 'purchase' AND event_id % 11 = 0")
    wanted = events.select((F.col("user_id") % 50).alias("query"), F.lit("b").alias("book"), (F.col("event_id") % 7).alias("chapter"), (F.col("event_id") % 40).alias("verse")).distinct()
    return K.evaluated({"all": hits, "late": hits.filter("rank > 3")}, wanted, hits.select("query").distinct())


@query(f"WITH {HIERARCHY} SELECT book_name, chapter_number, chapter_id FROM ch WHERE book_name IN ('NATION_1', 'NATION_2')")
def chapter_for(spark, d):
    """J-19: a chapter by its book and number; of books of the same name (here a copy in a later volume) that of the earliest volume."""
    own = chapters(spark, d)
    later = own.withColumn("chapter_id", -F.col("chapter_id") - 1).withColumn("volume_sort", F.col("volume_sort") + 100)
    wanted = own.filter("book_name IN ('NATION_1', 'NATION_2')").select("book_name", "chapter_number")
    both = own.unionByName(later).join(wanted, ["book_name", "chapter_number"])
    return H.earliest(both, ["book_name", "chapter_number"], "volume_sort", "chapter_id").select("book_name", "chapter_number", "chapter_id")


_OFFERED = """li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity)::BIGINT AS q, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY ALL),
h AS (SELECT o_custkey AS query, l_orderkey * 10 + l_linenumber AS doc, CASE s % 5 WHEN 3 THEN 'talk' WHEN 4 THEN 'article' ELSE CASE p % 9 WHEN 0 THEN 'discourse' ELSE 'scripture' END END AS kind,
 CASE s % 5 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE CASE p % 9 WHEN 0 THEN 3 ELSE 0 END END AS tier, row_number() OVER (PARTITION BY o_custkey ORDER BY q DESC, l_orderkey, l_linenumber) AS rank,
 CASE WHEN p % 11 > 0 THEN p % 3 END AS chapter, l_linenumber * (1 + p % 4) AS first, l_linenumber * (1 + p % 4) + q // 9 AS last, p_name AS title, CASE s % 2 WHEN 0 THEN 'A' ELSE ' a ' END AS speaker, CASE WHEN p % 7 = 0 THEN p_name END AS topic, flag, status
 FROM li JOIN orders ON l_orderkey = o_orderkey JOIN part ON p = p_partkey),
qs AS (SELECT c_custkey AS query, 'What is the ' || p_name || '?' AS text, [x FOR x IN string_split(lower(p_name), ' ') IF length(x) > 2] AS words FROM customer JOIN part ON c_custkey = p_partkey)"""


@query(f"""WITH RECURSIVE {_OFFERED}, ck AS (SELECT * FROM h WHERE flag = 'N' QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) <= 12),
ofr AS (SELECT h.query, CASE WHEN contains(lower(text), lower(topic)) THEN 0 ELSE 2 END AS block, rank, doc, kind, chapter, first, last, title, speaker FROM h LEFT JOIN qs ON qs.query = h.query WHERE tier = 0 AND topic IS NOT NULL
 UNION ALL SELECT query, 1, rank, doc, kind, chapter, first, last, title, speaker FROM h WHERE tier = 0 AND flag = 'R' AND status = 'F' UNION ALL SELECT query, 3, rank, doc, kind, chapter, first, last, title, speaker FROM ck WHERE tier = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY block, rank, doc) AS i FROM ofr),
f AS (SELECT query, i, [{{'doc': doc, 'kind': kind, 'chapter': chapter, 'first': first, 'last': last, 'title': title, 'speaker': speaker}}] AS kept FROM o WHERE i = 1 UNION ALL
 SELECT o.query, o.i, CASE WHEN (o.block < 3 AND len(f.kept) >= 6) OR len(list_filter(f.kept, lambda k: coalesce(k.chapter = o.chapter AND k.first <= o.last AND o.first <= k.last, false))) > 0 THEN f.kept
  WHEN p.at > 0 THEN list_transform(f.kept, lambda k, j: CASE WHEN j = p.at THEN {{'doc': k.doc, 'kind': k.kind, 'chapter': k.chapter, 'first': least(k.first, o.first), 'last': greatest(k.last, o.last), 'title': k.title, 'speaker': k.speaker}} ELSE k END)
  ELSE f.kept || [{{'doc': o.doc, 'kind': o.kind, 'chapter': o.chapter, 'first': o.first, 'last': o.last, 'title': o.title, 'speaker': o.speaker}}] END
 FROM f JOIN o ON o.query = f.query AND o.i = f.i + 1,
 LATERAL (SELECT coalesce(list_position(list_transform(f.kept, lambda k: coalesce(k.chapter = o.chapter AND o.first <= k.last + 3 AND k.first <= o.last + 3 AND greatest(k.last, o.last) - least(k.first, o.first) + 1 <= 10, false)), true), 0) AS at) p),
sc AS (SELECT query, unnest(range(1, len(kept) + 1)) AS i, unnest(kept) AS k FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY i DESC) = 1)),
hv AS (SELECT query, tier, count(*) AS n FROM ck GROUP BY ALL),
ad AS (SELECT h.*, len(list_filter(words, lambda w: list_contains(string_split(lower(title), ' '), w))) AS shared, len(words) AS asked, CASE h.tier WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END - coalesce(n, 0) AS need FROM h LEFT JOIN qs ON qs.query = h.query LEFT JOIN hv ON hv.query = h.query AND hv.tier = h.tier
 WHERE h.tier <> 0 AND h.doc NOT IN (SELECT doc FROM ck) AND shared > 0 AND shared >= least(2, asked) QUALIFY row_number() OVER (PARTITION BY h.query, h.tier ORDER BY h.rank) <= need),
w AS (SELECT query, doc, kind, tier, rank, chapter, first, last, title, speaker, 0 AS later FROM ck WHERE tier <> 0 UNION ALL SELECT query, doc, kind, tier, rank, chapter, first, last, title, speaker, 1 FROM ad),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, later, rank) AS i FROM w WHERE NOT (kind = 'article' AND EXISTS (SELECT 1 FROM w t WHERE t.query = w.query AND t.kind = 'talk' AND lower(trim(t.title)) = lower(trim(w.title)) AND lower(trim(t.speaker)) = lower(trim(w.speaker))
 AND (t.later = 0 OR (t.later, t.later * t.tier, t.rank) < (w.later, w.later * w.tier, w.rank))))),
n AS (SELECT query, coalesce(a.n, 0) AS np, coalesce(b.n, 0) AS nr FROM (SELECT query, count(*) AS n FROM sc GROUP BY query) a FULL JOIN (SELECT query, count(*) AS n FROM r GROUP BY query) b USING (query)),
m AS (SELECT query, least(nr, 10 - least(np, 6)) AS kr, least(np, 10 - least(nr, 10 - least(np, 6))) AS kp FROM n),
u AS (SELECT query, i, 0 AS part, k.doc AS doc, k.kind AS kind, k.first AS first, k.last AS last FROM sc JOIN m USING (query) WHERE i <= kp UNION ALL SELECT query, i, 1, doc, kind, first, last FROM r JOIN m USING (query) WHERE i <= kr)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY part, i) AS place, doc, kind, first::BIGINT AS first, last::BIGINT AS last FROM u""")
def balanced_hits(spark, d):
    """H-09: each customer's line items as search results (overlapping, near and distant ones of few chapters, reprints, named and other key passages), balanced to ten."""
    lines = apart(table(spark, d, "lineitem"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("long").alias("q"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    part = table(spark, d, "part").select("p_partkey", "p_name")
    rows = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("p") == F.col("p_partkey"))
    odd, other = F.col("s") % 5, F.col("p") % 9 == 0
    first = F.col("l_linenumber") * (1 + F.col("p") % 4)
    hits = written(rows.select(
        F.col("o_custkey").alias("query"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc"), F.when(odd == 3, "talk").when(odd == 4, "article").when(other, "discourse").otherwise("scripture").alias("kind"),
        F.when(odd == 3, 1).when(odd == 4, 2).when(other, 3).otherwise(0).alias("tier"), F.row_number().over(W.partitionBy("o_custkey").orderBy(F.col("q").desc(), "l_orderkey", "l_linenumber")).alias("rank"),
        F.when(F.col("p") % 11 > 0, F.col("p") % 3).alias("chapter"), first.alias("first"), (first + F.floor(F.col("q") / 9)).alias("last"), F.col("p_name").alias("title"), F.when(F.col("s") % 2 == 0, "A").otherwise(" a ").alias("speaker"),
        F.when(F.col("p") % 7 == 0, F.col("p_name")).alias("topic"), "flag", "status",
    ))
    questions = table(spark, d, "customer").join(part, F.col("c_custkey") == F.col("p_partkey")).select(F.col("c_custkey").alias("query"), F.concat(F.lit("What is the "), "p_name", F.lit("?")).alias("text"))
    chosen = A.capped(hits.filter("flag = 'N'"), "query", 12, F.col("rank"))
    return R.balanced(chosen, hits, 10, questions, hits.filter("flag = 'R' AND status = 'F'")).select("query", "place", "doc", "kind", "first", "last")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN ' ' || c_mktsegment ELSE ' ' END AS topic, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 5 = 1 THEN c_mktsegment ELSE '' END AS title, c_custkey % 7 AS m FROM customer),
f AS (SELECT *, CASE WHEN trim(topic) <> '' THEN trim(topic) WHEN title <> '' THEN title ELSE 'reading ' || c_custkey END AS first FROM c)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 12 ELSE CASE m WHEN 1 THEN 8 WHEN 2 THEN 12 WHEN 3 THEN 16 WHEN 4 THEN 20 ELSE 12 END END AS results, array_to_string([x FOR x IN [first, CASE WHEN title = '' OR contains(first, title) THEN NULL ELSE title END, 'hope'] IF x IS NOT NULL], ' | ') AS questions FROM f""")
def prepared_requests(spark, d):
    """H-18: what each customer prepares, by topic, talk or reading, as a lesson or a talk of some minutes: how many results that asks for, and its questions."""
    key = F.col("c_custkey")
    topic = F.when(key % 3 > 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(" ")
    title = F.when(key % 2 == 0, F.col("c_name")).when(key % 5 == 1, F.col("c_mktsegment")).otherwise("")
    rows = table(spark, d, "customer").select(key, topic.alias("topic"), (key % 4 == 0).alias("lesson"), F.when(key % 7 < 6, (key % 7) * 5).alias("minutes"), title.alias("talk_title"), F.concat(F.lit("reading "), key.cast("string")).alias("reading"))
    return K.requests(rows, ["hope"]).select("c_custkey", "results", F.array_join("questions", " | ").alias("questions"))
