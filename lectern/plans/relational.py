"""Lookups, joins, aggregates, windows and set operations over the supplied tables.

region, nation, customer, orders and lineitem stand for volume, testament, book, chapter and verse.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.cleaning import CONFUSED
from lectern.operators import analytics as A
from lectern.operators import hierarchy as H
from lectern.plans.registry import query, table, texts


@query("""SELECT n_nationkey, c_custkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal, c_custkey) AS position
FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def hier_children(spark, d):
    """P-05: customers of each nation in order."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return H.children(rows, "n_nationkey", "c_acctbal", "c_custkey").select("n_nationkey", "c_custkey", "position")


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def hier_location(spark, d):
    """J-01, J-04: the path of every line; the upper levels may be missing."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    books = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name", "r_name")
    chapters = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(books, F.col("o_custkey") == F.col("c_custkey"))
    verses = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return verses.join(chapters, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name")


@query("""WITH wanted AS (SELECT DISTINCT lower(p_type) AS w FROM part)
SELECT lookup, p_partkey FROM (SELECT lower(p_type) AS lookup, p_partkey, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_partkey) AS r FROM part JOIN wanted ON w = lower(p_type)) WHERE r = 1""")
def lookup_ci(spark, d):
    """J-02, J-03: types looked up in any case; the earliest part wins."""
    part = table(spark, d, "part")
    return H.lookup_ci(part, "p_type", part.select(F.upper("p_type").alias("wanted")).distinct(), "p_partkey").select("lookup", "p_partkey")


@query("""SELECT p_partkey, p_name, CASE WHEN p_name = 'red w' THEN 0 WHEN p_name ILIKE 'red w%' THEN 1 ELSE 2 END::BIGINT AS level FROM part WHERE p_name ILIKE '%red w%'
ORDER BY level, p_partkey LIMIT 20""")
def chapter_search(spark, d):
    """T-01 (Q-8, Q-15): exact (case counts), then beginning, then part of the name; top 20."""
    return H.chapter_search(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "red w", 20, "p_partkey")


@query("SELECT doc_id, lang FROM documents WHERE lang NOT IN ('de', 'fr')")
def anti_hidden(spark, d):
    """P-01 to P-03: documents outside hidden languages, by an anti join."""
    hidden = spark.range(2).select(F.element_at(F.array(F.lit("de"), F.lit("fr")), (F.col("id") + 1).cast("int")).alias("slug"))
    return H.visible(table(spark, d, "documents").select("doc_id", "lang"), hidden, "lang")


@query("SELECT o_orderkey, coalesce(max(l_linenumber), 0)::BIGINT AS verses FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def verse_count(spark, d):
    """A-02: lines of each order; those without lines are kept."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    return A.verse_counts(orders, lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_linenumber")


@query("""WITH p AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),
r AS (SELECT doc_id AS id, doc_id, 0 AS first, 1 AS last FROM documents)
SELECT id, count(*) AS n, string_agg(t, ' ' ORDER BY pos) AS text FROM p JOIN r USING (doc_id) WHERE trim(t) <> '' AND pos BETWEEN first AND last GROUP BY id""")
def range_passages(spark, d):
    """J-06, H-22: the first two paragraphs of each document as one passage, by a range on top of an equi-join."""
    from lectern.operators.passages import passages

    docs = table(spark, d, "documents")
    ranges = docs.select(F.col("doc_id").alias("id"), "doc_id", F.lit(0).alias("first"), F.lit(1).alias("last"))
    return H.range_text(passages(docs), ranges, ["doc_id"], "pos", "text")


@query("""WITH e AS (SELECT o_orderkey AS id, o_custkey AS a, o_orderkey % 1000 AS b FROM orders)
SELECT a AS node, b AS other, count(*) AS n FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e WHERE a <> b) GROUP BY a, b""")
def edges_both_sides(spark, d):
    """J-07: links seen from both ends; a loop counts once."""
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1000).alias("b"))
    return H.both_sides(edges, ["a"], ["b"], ["id"]).groupBy(F.col("from.k0").alias("node"), F.col("to.k0").alias("other")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT event_type AS key, CASE event_type WHEN 'view' THEN 'view,zzz,click' WHEN 'signup' THEN 'error,signup' ELSE 'purchase' END AS listed, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT key, unnest(range(0, len(string_split(listed, ',')))) AS pos, unnest(string_split(listed, ',')) AS slug FROM l),
k AS (SELECT DISTINCT event_type AS slug, upper(event_type) AS name FROM events)
SELECT key, string_agg(name, '; ' ORDER BY pos) AS names FROM s JOIN k USING (slug) GROUP BY key""")
def slug_list_resolve(spark, d):
    """J-08: lists of slugs resolved in order; unknown ones are dropped."""
    types = table(spark, d, "events").select("event_type").distinct()
    listed = F.when(F.col("event_type") == "view", "view,zzz,click").when(F.col("event_type") == "signup", "error,signup").otherwise("purchase")
    known = types.select(F.col("event_type").alias("slug"), F.upper("event_type").alias("name"))
    return H.resolve_list(types.select(F.col("event_type").alias("key"), listed.alias("listed")), "key", "listed", known)


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'view') OR o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def semi_annotated(spark, d):
    """J-10: orders whose customer has a view or a purchase."""
    events = table(spark, d, "events")
    marks = [events.filter(F.col("event_type") == t).select("user_id") for t in ("view", "purchase")]
    return H.annotated(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", *marks).select("o_orderkey")


@query("""SELECT event_id, coalesce(c_name, n_name, '') AS label FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON user_id = n_nationkey""")
def coalesce_label(spark, d):
    """J-09, J-12, J-13: the first label that exists over two left joins."""
    rows = table(spark, d, "events").select("event_id", "user_id")
    rows = rows.join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("user_id") == F.col("c_custkey"), "left")
    rows = rows.join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("user_id") == F.col("n_nationkey"), "left")
    return rows.select("event_id", F.coalesce("c_name", "n_name", F.lit("")).alias("label"))


@query("""SELECT user_id, event_type, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at, rank FROM (SELECT user_id, event_type, max(ts) AS last_at,
row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS rank FROM events GROUP BY user_id, event_type) WHERE rank <= 5""")
def recent_distinct(spark, d):
    """A-01: each user's five most recent kinds of event."""
    found = A.recent_distinct(table(spark, d, "events"), "user_id", "event_type", "ts", 5)
    return found.withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH t AS (SELECT max(ts)::DATE AS today FROM events), dd AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events),
r AS (SELECT user_id, d, d - (row_number() OVER (PARTITION BY user_id ORDER BY d))::INT AS run FROM dd),
i AS (SELECT user_id, max(d) AS last, count(*) AS n FROM r GROUP BY user_id, run)
SELECT user_id, coalesce(max(CASE WHEN today - last BETWEEN 0 AND 1 THEN n END), 0) AS streak FROM i, t GROUP BY user_id""")
def streak(spark, d):
    """W-01: each user's run of days that ends today or yesterday."""
    events = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    return A.streak(events, "user_id", "day", events.agg(F.max("day").alias("today")))


@query("""WITH dd AS (SELECT DISTINCT user_id, ts::DATE - DATE '2000-01-01' AS x FROM events),
r AS (SELECT user_id, x, x - row_number() OVER (PARTITION BY user_id ORDER BY x) AS run FROM dd),
p AS (SELECT user_id, x, run, (row_number() OVER (PARTITION BY user_id, run ORDER BY x) - 1) // 6 AS piece FROM r)
SELECT user_id, min(x) AS first, max(x) AS last, count(*) AS n FROM p GROUP BY user_id, run, piece""")
def day_islands(spark, d):
    """W-02: runs of consecutive days, cut after six."""
    days = table(spark, d, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2000-01-01")).alias("x"))
    return A.split_islands(days, "user_id", "x", 6)


@query("""WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS turn FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS gr FROM r WHERE turn = 1)
SELECT doc_id, lang, turn, row_number() OVER (ORDER BY turn, gr) AS place FROM r JOIN g USING (lang) QUALIFY place <= 40""")
def round_robin(spark, d):
    """W-11: languages take turns, longest documents first; the first 40."""
    from pyspark.sql import Window as W

    rows = A.round_robin(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "lang", F.col("n_chars").desc(), F.col("doc_id"))
    top = rows.orderBy("turn", "group_rank").limit(40)
    return top.withColumn("place", F.row_number().over(W.orderBy("turn", "group_rank")).cast("long")).select("doc_id", "lang", "turn", "place")


@query("""WITH s AS (SELECT doc_id, lang, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 2)
SELECT doc_id, lang, source FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 ELSE 1 END""")
def per_group_cap(spark, d):
    """W-12, T-06: two documents a source, then each language's quota."""
    order = (F.col("n_chars").desc(), F.col("doc_id"))
    two = A.capped(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "source", 2, *order)
    quota = F.when(F.col("lang") == "en", 4).when(F.col("lang") == "de", 2).otherwise(1)
    return A.capped(two, "lang", quota, *order).select("doc_id", "lang", "source")


@query("""WITH s AS (SELECT label, round(CAST(embedding[1] AS DOUBLE), 6) AS score FROM embeddings), b AS (SELECT label, max(score) AS best FROM s GROUP BY label)
SELECT b.label::BIGINT AS label, round((SELECT count(*) FROM s WHERE s.score > b.best) / (SELECT count(*) FROM s), 6) AS fraction FROM b""")
def rank_fraction(spark, d):
    """W-14: the share of vectors that score strictly better than each label's best."""
    rows = table(spark, d, "embeddings").select("label", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("score"))
    return A.rank_fraction(rows, "score", "label").select(F.col("label").cast("long").alias("label"), F.round("fraction", 6).alias("fraction"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) AS number FROM orders")
def renumber(spark, d):
    """W-10: orders of a customer numbered by date."""
    return A.renumber(table(spark, d, "orders"), "o_custkey", F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey")).select("o_orderkey", "number")


@query("""WITH RECURSIVE c AS (SELECT dense_rank() OVER (ORDER BY lang) - 1 AS tier, count(*) AS n FROM documents GROUP BY lang), lim AS (SELECT sum(n) // 3 AS l FROM c),
levels AS (SELECT max(x) AS lv FROM (SELECT unnest(range(0, (SELECT max(n) + 1 FROM c))) AS x) WHERE (SELECT sum(least(n, x)) FROM c) <= (SELECT l FROM lim)),
b AS (SELECT tier, n, least(n, lv) AS base, n > lv AS cut FROM c, levels)
SELECT tier, n, (base + CASE WHEN cut AND row_number() OVER (PARTITION BY cut ORDER BY tier DESC) <= (SELECT l FROM lim) - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END)::BIGINT AS kept FROM b""")
def tier_fit(spark, d):
    """A-13: language counts trimmed to a third of all documents, from the largest down."""
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents")
    counts = docs.groupBy("lang").agg(F.count("*").alias("n")).withColumn("tier", (F.dense_rank().over(W.orderBy("lang")) - 1).cast("long"))
    return A.fit_tiers(counts.select("tier", "n"), docs.count() // 3)


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS token FROM documents)
SELECT token, count(*) AS df FROM t GROUP BY token""")
def doc_frequency(spark, d):
    """A-07: documents of each token."""
    return A.document_frequency(texts(spark, d), "doc_id", X.tokens(F.col("text")), one_row_each=True)


@query("""WITH w AS (SELECT regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM documents),
p AS (SELECT t, unnest(range(1, len(t))) AS i FROM w WHERE len(t) > 1)
SELECT t[i] AS a, t[i + 1] AS b, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 5""")
def bigrams(spark, d):
    """A-10: neighbouring tokens found at least five times."""
    return A.bigrams(texts(spark, d), X.tokens(F.col("text")), 5)


_SWAPS = ", ".join(f"""('{a.replace("'", "''")}', '{b}')""" for a, b in CONFUSED)


@query(f"""WITH c AS (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+(?:''[a-z]+)?')) AS w FROM documents WHERE lang = 'en') GROUP BY 1),
o AS (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents WHERE lang <> 'en') WHERE regexp_full_match(w, '[A-Za-z]+') AND lower(w) NOT IN (SELECT word FROM c) GROUP BY 1),
k AS (SELECT word, substr(word, 1, i - 1) || meant || substr(word, i + length(read)) AS key FROM (SELECT o.word, read, meant, unnest(range(1, length(word) + 1)) AS i FROM o, (VALUES {_SWAPS}) s(read, meant) WHERE length(word) BETWEEN 6 AND 7 AND n >= 3) WHERE substr(word, i, length(read)) = read),
d AS (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS word FROM benchmark)
SELECT word, n FROM o WHERE length(word) >= 5 AND word IN (SELECT word FROM d) OR n >= 3 AND (length(word) >= 8 OR length(word) >= 6 AND word NOT IN (SELECT word FROM k WHERE key IN (SELECT word FROM c WHERE n >= 20)))""")
def own_spellings(spark, d):
    """A-10: words of the documents in other languages that the English ones lack, without misread common words; the benchmark's words are the dictionary."""
    docs = texts(spark, d)
    clean = docs.filter("lang = 'en'").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+(?:'[a-z]+)?"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    listed = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    return A.own_spellings(docs.filter("lang <> 'en'"), "text", clean, CONFUSED, listed)


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents WHERE lang = 'en'), seen AS (SELECT DISTINCT w FROM w WHERE w = lower(w))
SELECT w AS name, count(*) AS n, min(doc_id) AS first_doc FROM w WHERE w <> lower(w) AND lower(w) NOT IN (SELECT w FROM seen) GROUP BY w""")
def proper_names(spark, d):
    """A-09: words of English documents that never stand in lower case."""
    return A.proper_names(texts(spark, d).filter("lang = 'en'"), "doc_id", "text", "[A-Za-z]+")


_HASH = "sha256(text)"


@query(f"""WITH p AS (SELECT {_HASH} AS hash, length(text) AS n FROM documents), v AS (SELECT DISTINCT {_HASH} AS hash FROM documents WHERE lang = 'en'), u AS (SELECT hash, min(n) AS n, count(*) AS c FROM p GROUP BY hash)
SELECT sum(c)::BIGINT AS pieces, count(*) AS unique_hashes, count(v.hash) AS embedded, sum(CASE WHEN v.hash IS NULL THEN n ELSE 0 END)::BIGINT AS pending_chars FROM u LEFT JOIN v USING (hash)""")
def index_status(spark, d):
    """A-04, A-06: how much of an index is done, if the English texts are."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("hash"), F.length("text").alias("n_chars"))
    return A.index_status(docs, docs.filter("lang = 'en'").select("hash"))


@query(f"SELECT {_HASH} AS hash, min(doc_id) AS first_id FROM documents WHERE {_HASH} NOT IN (SELECT {_HASH} FROM documents WHERE lang = 'en') GROUP BY 1")
def pending_hashes(spark, d):
    """A-05: texts without a vector."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.sha2("text", 256).alias("hash"))
    return A.pending(docs.select("id", "hash"), docs.filter("lang = 'en'").select("hash"))


@query("SELECT count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents")
def fingerprint(spark, d):
    """A-08: a cheap mark of a table's content."""
    return A.checksum(table(spark, d, "documents"), "text")


@query("""WITH u AS (SELECT o_orderkey AS key, o_orderdate AS day, 0 AS source_rank, 0 AS line FROM orders UNION ALL SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_shipdate END, 1, l_linenumber FROM lineitem)
SELECT key, source_rank::BIGINT AS source_rank, line::BIGINT AS line, row_number() OVER (PARTITION BY key ORDER BY day DESC NULLS LAST, source_rank, line) AS place FROM u""")
def date_sorted_union(spark, d):
    """T-02: two sources of dates in one list, newest first, unknown dates last."""
    from pyspark.sql import Window as W

    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("day"), F.lit(0).alias("line"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("day"), F.col("l_linenumber").cast("int").alias("line"))
    place = F.row_number().over(W.partitionBy("key").orderBy(F.col("day").desc_nulls_last(), "source_rank", "line")).cast("long")
    return A.union_ranked(a, b).select("key", F.col("source_rank").cast("long"), F.col("line").cast("long"), place.alias("place"))


@query("""SELECT l_orderkey, l_suppkey, place FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_suppkey) AS place FROM lineitem GROUP BY l_orderkey, l_suppkey) WHERE place <= 5""")
def dedup_cap(spark, d):
    """T-03, T-07: an order's first five different suppliers."""
    return A.distinct_capped(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber", 5).select("l_orderkey", "l_suppkey", "place")


@query("""WITH s AS (SELECT 0 AS section, doc_id AS id, lang AS label FROM documents WHERE contains(lower(text), 'haha') UNION ALL SELECT 1, p_partkey, p_name FROM part WHERE contains(lower(p_name), 'haha')
UNION ALL SELECT 2, event_id, event_type FROM events WHERE contains(event_type, 'haha') OR event_type = 'signup')
SELECT DISTINCT section::BIGINT AS section, id, label FROM s""")
def federated_search(spark, d):
    """U-05: one text sought in several tables, in sections."""
    docs = table(spark, d, "documents").filter(H.contains_literal("text", "haha")).select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    part = table(spark, d, "part").filter(H.contains_literal("p_name", "haha")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    events = table(spark, d, "events").filter(H.contains_literal("event_type", "haha") | (F.col("event_type") == "signup")).select(F.col("event_id").alias("id"), F.col("event_type").alias("label"))
    return A.union_ranked(docs, part, events).select(F.col("source_rank").cast("long").alias("section"), "id", "label").distinct()


@query("""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'es'), n AS (SELECT doc_id, sha256(CASE WHEN source = 'src0' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'fr')
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'update' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id
WHERE o.h IS DISTINCT FROM n.h""")
def sync_diff(spark, d):
    """U-04: what turns one version of a table into another."""
    docs = table(spark, d, "documents")
    old = docs.filter("lang <> 'es'").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.filter("lang <> 'fr'").select("doc_id", F.sha2(F.when(F.col("source") == "src0", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return A.diff(old, new, "doc_id", "h")


@query("""WITH RECURSIVE r AS (SELECT l_orderkey AS o, l_linenumber AS a, least(l_linenumber + 1, 7) AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY -l_quantity, l_linenumber, l_linenumber, least(l_linenumber + 1, 7)) AS i FROM lineitem),
f AS (SELECT o, i, [{'a': a, 'b': b}] AS kept FROM r WHERE i = 1 UNION ALL
 SELECT r.o, r.i, CASE WHEN len(f.kept) >= 3 THEN f.kept WHEN p.at > 0 THEN list_transform(f.kept, lambda k, j: CASE WHEN j = p.at THEN {'a': least(k.a, r.a), 'b': greatest(k.b, r.b)} ELSE k END) ELSE f.kept || [{'a': r.a, 'b': r.b}] END
 FROM f JOIN r ON r.o = f.o AND r.i = f.i + 1, LATERAL (SELECT coalesce(list_position(list_transform(f.kept, lambda k: k.a <= r.b AND r.a <= k.b), true), 0) AS at) p),
l AS (SELECT o, kept FROM f QUALIFY row_number() OVER (PARTITION BY o ORDER BY i DESC) = 1), u AS (SELECT o, unnest(range(1, len(kept) + 1)) AS place, unnest(kept) AS k FROM l)
SELECT o AS l_orderkey, place::BIGINT AS place, k.a::BIGINT AS first, k.b::BIGINT AS last FROM u""")
def interval_merge(spark, d):
    """W-05: windows around an order's lines, by quantity, widened into each other; up to three an order."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.struct(-F.col("l_quantity"), F.col("l_linenumber")).alias("rank"), F.col("l_linenumber").alias("first"), F.least(F.col("l_linenumber") + 1, F.lit(7)).alias("last"))
    return A.merge_intervals(rows, gap=0, limit=3).select(F.col("owner").alias("l_orderkey"), F.col("place").cast("long"), "first", "last")


@query("""WITH r AS (SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1) AS m FROM orders)
SELECT o_orderkey, strftime(m, '%B %Y') AS label, strftime(m + CAST((6 - dayofweek(m) + 7) % 7 AS INT), '%Y-%m-%d') AS saturday, CASE WHEN m >= DATE '1996-01-01' THEN 'new' ELSE 'old' END AS era FROM r""")
def date_phrases(spark, d):
    """F-04 to F-06: a month's name and back, its first Saturday, and the era's name."""
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM yyyy").alias("label"))
    day = X.month_year(F.col("label"))
    return rows.select("o_orderkey", "label", F.date_format(X.first_saturday(day), "yyyy-MM-dd").alias("saturday"), X.era_label(day, "old", "new", "1996-01-01").alias("era"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, n_name || ' ' || l_orderkey || ':' || l_linenumber || '-' || (l_linenumber + 2) AS label, n_name AS book, l_orderkey AS chapter, l_linenumber::BIGINT AS first, (l_linenumber + 2)::BIGINT AS last
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def reference_parse(spark, d):
    """F-15, F-17, H-19: references written from keys and read again."""
    books = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    chapters = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(books, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(chapters, F.col("l_orderkey") == F.col("o_orderkey"))
    label = X.range_label(F.col("n_name"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_linenumber") + 2)
    read = rows.select("l_orderkey", F.col("l_linenumber").cast("long"), label.alias("label")).withColumn("p", X.reference_parts(F.col("label")))
    return read.select("l_orderkey", "l_linenumber", "label", "p.book", F.col("p.chapter").cast("long").alias("chapter"), F.col("p.first").cast("long").alias("first"), F.col("p.last").cast("long").alias("last"))
