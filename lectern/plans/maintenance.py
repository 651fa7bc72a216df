"""Replication, mirrors, sources, cleaning, quality and evaluation over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import analytics as A
from lectern.operators import merge as M
from lectern.operators import quality as Q
from lectern.plans.registry import query, table, texts
from lectern.sources import readers as S

_KEYED = "SELECT event_id, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def _keyed(spark, d):
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))


@query(f"""WITH e AS ({_KEYED}), l AS (SELECT user_id, k, max_by(event_id, (ts, event_id)) AS event_id FROM e GROUP BY user_id, k)
SELECT e.user_id, e.k, e.event_id, e.event_type FROM e JOIN l ON e.event_id = l.event_id WHERE e.event_type <> 'error'""")
def lww_merge(spark, d):
    """D-01, D-06: the latest record of each key; errors are tombstones."""
    state = M.last_write_wins(_keyed(spark, d).select("user_id", "k", "ts", "event_id", "event_type"), ["user_id", "k"], "ts", "event_id")
    return state.filter("event_type <> 'error'").select("user_id", "k", "event_id", "event_type")


@query("""WITH r AS (SELECT user_id, event_id AS id, (event_id * 37) % 40 AS s, (event_id * 37) % 40 + 1 + event_id % 5 AS e, ts FROM events)
SELECT a.user_id, a.id, EXISTS (SELECT 1 FROM r b WHERE b.user_id = a.user_id AND (b.ts, b.id) > (a.ts, a.id) AND b.s < a.e AND b.e > a.s) AS deleted FROM r a""")
def overlap_clear(spark, d):
    """D-08: a later highlight clears those that it overlaps."""
    start = (F.col("event_id") * 37) % 40
    ranges = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), start.alias("start"), (start + 1 + F.col("event_id") % 5).alias("end"), "ts")
    return M.cleared(ranges, "user_id", "ts").select("user_id", "id", "deleted")


@query("""SELECT p_partkey, p_name FROM part WHERE p_size >= 10 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size < 10 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def mirror_diff(spark, d):
    """D-10 to D-15: an exact mirror of what is upstream; rows that users refer to stay."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    upstream = part.filter("p_size >= 10").select("p_partkey", "p_name")
    keep = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return M.mirrored(part.select("p_partkey", "p_name"), upstream, ["p_partkey"], keep)


@query("""WITH o AS (SELECT o_custkey AS a, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS b, min(o_orderkey) AS v FROM orders GROUP BY 1, 2),
n AS (SELECT c_custkey AS a, CAST(NULL AS VARCHAR) AS b, -1 AS v FROM customer)
SELECT a, b, v FROM n UNION ALL SELECT a, b, v FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.a = o.a AND n.b IS NOT DISTINCT FROM o.b)""")
def upsert_nullsafe(spark, d):
    """D-05, D-13: an upsert on keys that may be null."""
    status = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    old = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("a"), status.alias("b")).agg(F.min("o_orderkey").alias("v"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(-1).cast("long").alias("v"))
    return M.upserted(old, new, ["a", "b"])


@query("""WITH e AS (SELECT event_id AS id, ts, event_type || '|' || user_id % 50 AS p FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY ts, id) AS repeat, min(ts) OVER (PARTITION BY p) AS first FROM e),
n AS (SELECT p, row_number() OVER (PARTITION BY date_trunc('hour', first) ORDER BY ts, id) AS turn FROM r WHERE repeat = 1)
SELECT id, repeat, repeat <= 50 AND turn <= 10 AS passes FROM r JOIN n USING (p)""")
def report_limits(spark, d):
    """D-22, A-15: repeats of a fingerprint, and new ones an hour, are limited."""
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.concat_ws("|", "event_type", (F.col("user_id") % 50).cast("string")).alias("p"))
    return M.limited_reports(events, "p", "ts").select("id", "repeat", "passes")


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*?href\\s*=\\s*["'']([^"''#]+)[^>]*>', 1))), ' ') AS links FROM pages""")
def html_links(spark, d):
    """S-20: different links of each page, sorted."""
    return S.page_links(table(spark, d, "pages"), "html").select("page_id", F.array_join("links", " ").alias("links"))


@query("""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref|fbclid|gclid|lang)=[^&]*', '\\1', 'g') AS u FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(u, '&+', '&', 'g'), '\\?&', '?', 'g'), '[?&]+$', '') AS u FROM b)
SELECT page_id, regexp_replace('https://' || regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?]*)', 1)), '^(www|m)\\.', '') || regexp_extract(u, '^[a-zA-Z]+://[^/?]*(.*)$', 1), '/$', '') AS url FROM t""")
def url_canon(spark, d):
    """S-17: one form for a page's address."""
    return table(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""")
def html_title(spark, d):
    """S-19: page titles."""
    return table(spark, d, "pages").select("page_id", S.page_title(F.col("html")).alias("title"))


@query(f"SELECT k, event_type, count(*) AS n FROM ({_KEYED}) GROUP BY k, event_type")
def json_props(spark, d):
    """S-22: a field of a JSON column, counted."""
    return _keyed(spark, d).groupBy("k", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[|~^_*#$%&\\\\<>{}=]+', ' ', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ') AS text FROM documents""")
def noise_clean(spark, d):
    """C-01: noise signs and empty lines removed."""
    return texts(spark, d).select("doc_id", X.without_noise(F.col("text")).alias("text"))


@query("""SELECT doc_id, round(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0), 6) AS share FROM documents""")
def junk_ratio(spark, d):
    """C-08: upper-case share of letters."""
    return texts(spark, d).select("doc_id", F.round(X.uppercase_share(F.col("text")), 6).alias("share"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)[a-z]:\\\\Users\\\\[^\\\\\\s]+', '~', 'g'), '/(home|Users)/[^/\\s]+', '~', 'g') AS text FROM documents""")
def pii_scrub(spark, d):
    """C-12: home folders replaced."""
    return texts(spark, d).select("doc_id", X.scrubbed(F.col("text")).alias("text"))


@query("""SELECT substr(sha1(event_type || '|user' || user_id), 1, 12) AS print, count(*) AS n FROM events GROUP BY 1""")
def error_fingerprint(spark, d):
    """C-14: one print for a kind and place; line numbers don't count."""
    place = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_id").cast("string"))
    return table(spark, d, "events").groupBy(X.error_print(F.col("event_type"), place).alias("print")).agg(F.count("*").alias("n"))


@query("""SELECT 'line without order' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'order without lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'late line', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 90 DAY""")
def dq_violations(spark, d):
    """Q-V3, Q-V4: rules with the number of rows that break them."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    both = lines.select("l_orderkey", "l_shipdate").join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return Q.violations(
        ("line without order", lines.select("l_orderkey").join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        ("order without customer", orders.select("o_custkey").join(table(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        ("order without lines", orders.select("o_orderkey").join(lines.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")),
        ("late line", both.filter("l_shipdate > o_orderdate + INTERVAL 90 DAY")),
    )


@query("""SELECT (SELECT count(*) FROM documents) AS old_n, (SELECT count(*) FROM documents WHERE lang = 'en') AS new_n, (SELECT count(*) FROM documents WHERE lang = 'en') >= 0.9 * (SELECT count(*) FROM documents) AS accepted""")
def shrink_gate(spark, d):
    """Q-V1: a replacement that shrank too far is refused."""
    docs = table(spark, d, "documents")
    return Q.shrink_gate(docs, docs.filter("lang = 'en'"))


@query("""WITH n AS (SELECT DISTINCT p_brand, p_name FROM part) SELECT a.p_brand, a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS distance FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name
WHERE levenshtein(a.p_name, b.p_name) <= greatest(1, length(a.p_name) // 6)""")
def levenshtein_match(spark, d):
    """F-12, S-14: different names of a brand that are one letter in six apart."""
    names = table(spark, d, "part").select("p_brand", "p_name").distinct()
    a, b = names.select("p_brand", F.col("p_name").alias("a")), names.select("p_brand", F.col("p_name").alias("b"))
    return A.close_names(a, b, ["p_brand"]).filter("a < b")


_RARE = r"""SELECT {0} AS id, unnest(list_distinct(list_transform(regexp_extract_all(t, '[A-Za-z]+(?:''[a-z]+)?'), lambda w: lower(w)))) AS w FROM {1}"""


def _items_and_paragraphs(spark, d):
    from lectern.operators.passages import passages

    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id_a"), F.col("text").alias("text_a"))
    return items, passages(texts(spark, d)).select((F.col("doc_id") * 100000 + F.col("pos")).alias("id_b"), F.col("text").alias("text_b"))


@query(f"""WITH pp AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),
b AS (SELECT doc_id * 100000 + pos AS id, t FROM pp WHERE trim(t) <> ''), wb AS ({_RARE.format('id', 'b')}), wa AS ({_RARE.format('item_id', '(SELECT item_id, text AS t FROM benchmark)')}),
df AS (SELECT w, count(*) AS df FROM wb GROUP BY w HAVING 4 * count(*) < (SELECT count(*) FROM b)), s AS (SELECT wa.id AS item_id, wb.id AS passage, round(sum(1.0::DOUBLE / df), 6) AS weight, round(sum(1.0::DOUBLE / df), 12) AS exact FROM wa JOIN df USING (w) JOIN wb USING (w) GROUP BY 1, 2)
SELECT item_id, passage, weight, row_number() OVER (PARTITION BY item_id ORDER BY exact DESC, passage) AS place FROM s QUALIFY place <= 5""")
def rare_word_candidates(spark, d):
    """J-16: for each benchmark item the paragraphs that share most rare words with it."""
    found = M.candidates(*_items_and_paragraphs(spark, d), 5)
    return found.select(F.col("id_a").alias("item_id"), F.col("id_b").alias("passage"), F.round("weight", 6).alias("weight"), "place")


@query()
def seq_ratio_nearest(spark, d):
    """J-16, D-17: for each benchmark item the most similar paragraph of the documents, by shared rare words and then by matching blocks of words."""
    return M.parallels(*_items_and_paragraphs(spark, d)).select(F.col("id_a").alias("item_id"), F.col("id_b").alias("passage"), F.round("ratio", 6).alias("ratio"))


@query("""WITH m AS (SELECT o_custkey AS query, l_partkey AS item, bool_or(l_returnflag = 'R') AS avoid FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N' GROUP BY 1, 2),
p AS (SELECT o_custkey AS query, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey), f AS (SELECT p.query, count(CASE WHEN NOT avoid THEN 1 END) AS on_list, count(CASE WHEN avoid THEN 1 END) AS avoided,
count(CASE WHEN avoid IS NULL THEN 1 END) AS unlisted, count(DISTINCT CASE WHEN NOT avoid THEN p.item END) AS covered FROM p LEFT JOIN m ON p.query = m.query AND p.item = m.item GROUP BY p.query),
l AS (SELECT query, count(*) AS listed FROM m WHERE NOT avoid GROUP BY query)
SELECT f.query, on_list, avoided, unlisted, round(covered::DOUBLE / listed, 6) AS coverage FROM f LEFT JOIN l ON f.query = l.query""")
def coverage(spark, d):
    """E-05, E-06: what a customer bought against lists of parts; what is to be avoided wins."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("query"), F.col("l_partkey").alias("item"), "l_returnflag")
    marks = rows.filter("l_returnflag <> 'N'").withColumn("avoid", F.col("l_returnflag") == "R")
    return Q.list_scores(rows.select("query", "item"), marks.select("query", "item", "avoid"))


@query("""SELECT CASE WHEN value < 5 THEN 'retry' WHEN value < 20 THEN 'ok' ELSE 'too_large' END AS class, count(*) AS n FROM events GROUP BY 1""")
def response_class(spark, d):
    """P-23: what to do after a response."""
    status = F.when(F.col("value") < 5, 503).when(F.col("value") < 20, 200).otherwise(413)
    return table(spark, d, "events").groupBy(X.status_class(status).alias("class")).agg(F.count("*").alias("n"))
