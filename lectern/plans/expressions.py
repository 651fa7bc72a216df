"""Scalar rules, cleaning, cards, lexicon and vectors over the supplied tables. Many rows get a text that is made from their keys, so that
what must come out is known without the rule."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import alignment as L
from lectern.operators import analytics as A
from lectern.operators import hierarchy as H
from lectern.operators import merge as M
from lectern.operators import passages as P
from lectern.operators import quality as Q
from lectern.operators import ranking as R
from lectern.operators import records as D
from lectern.operators import search as S
from lectern.operators import vectors as V
from lectern.operators import workflow as K
from lectern.plans.corpus import HIERARCHY, NOTES, chapters, notes, verses
from lectern.plans.registry import query, table, texts

TOK = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"
PARAGRAPHS = """pp AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents)"""


def _letters(number):
    """A number as a word of letters."""
    return F.translate(number.cast("string"), "0123456789", "abcdefghij")


def _letters_sql(number):
    return f"translate(({number})::VARCHAR, '0123456789', 'abcdefghij')"


@query("""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 40)::INT AS b, o_orderdate::DATE - DATE '1998-06-01' AS n FROM orders)
SELECT o_orderkey, strftime(a, '%B %-d') || '–' || CASE WHEN date_trunc('month', a) = date_trunc('month', b) THEN strftime(b, '%-d') ELSE strftime(b, '%B %-d') END || ', ' || strftime(b, '%Y') AS span, strftime(a, '%Y-%m-%d') AS iso,
CASE WHEN n = 0 THEN 'expires today' WHEN n > 0 THEN 'expires in ' || n || CASE n WHEN 1 THEN ' day' ELSE ' days' END ELSE 'expired ' || -n || CASE n WHEN -1 THEN ' day' ELSE ' days' END || ' ago' END AS due, n <= 14 AS shown FROM d""")
def date_texts(spark, d):
    """F-07, F-09, F-10, P-22: spans and due dates as texts, and a date read from one."""
    first, today = F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date")
    read = X.iso_date(F.concat(F.lit("Given "), F.date_format(first, "MMMM d, yyyy"), F.lit(" in the hall")))
    return table(spark, d, "orders").select(
        "o_orderkey", X.date_range_text(first, F.date_add(first, (F.col("o_orderkey") % 40).cast("int"))).alias("span"), read.alias("iso"), X.due_text(first, today).alias("due"), X.in_window(first, today, 14).alias("shown")
    )


@query("SELECT c_custkey, 4 + ('0x' || substr(md5('7:' || c_custkey), 1, 8))::BIGINT % 11 AS days FROM customer")
def reminder_dates(spark, d):
    """F-08: the next reminder is four to fourteen days later."""
    day = F.lit("2024-02-20").cast("date")
    return table(spark, d, "customer").select("c_custkey", F.datediff(X.jittered(day, F.col("c_custkey"), 7), day).cast("long").alias("days"))


_ONES, _TENS = "['','I','II','III','IV','V','VI','VII','VIII','IX']", "['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC']"


@query(f"SELECT p_partkey, {_TENS}[p_size // 10 + 1] || lower({_ONES}[p_size % 10 + 1]) AS numeral, p_size::BIGINT AS value FROM part")
def roman_numerals(spark, d):
    """F-11: roman numerals read."""
    digit = lambda listed, n: F.element_at(F.array(*[F.lit(x) for x in listed.strip("[]").replace("'", "").split(",")]), (n + 1).cast("int"))
    numeral = F.concat(digit(_TENS, F.floor(F.col("p_size") / 10)), F.lower(digit(_ONES, F.col("p_size") % 10)))
    return table(spark, d, "part").select("p_partkey", numeral.alias("numeral")).withColumn("value", X.roman(F.col("numeral")).cast("long"))


@query("SELECT p_partkey, 'H' || p_partkey + 1 || ',G7' AS numbers, p_size || ':H' || p_partkey || ',G1 99:H5' AS tags FROM part")
def word_numbers(spark, d):
    """F-13: dictionary numbers without leading zeros, and word labels read and written again."""
    key = F.col("p_partkey").cast("string")
    found = X.strongs(F.concat(F.lit("see h000"), (F.col("p_partkey") + 1).cast("string"), F.lit(" and G07, x")))
    tags = X.tagged_text(X.word_tags(F.concat(F.lit(" 99:H5  "), F.col("p_size").cast("string"), F.lit(":H"), key, F.lit(",G1 "))))
    return table(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("numbers"), tags.alias("tags"))


@query(f"""WITH {PARAGRAPHS}, c AS (SELECT doc_id, pos, t, length(trim(t)) BETWEEN 1 AND 6 AND length(regexp_replace(trim(t), '[^0-9]', '', 'g')) * 2 > length(trim(t)) AS number FROM pp)
SELECT doc_id, pos::BIGINT AS pos, number, coalesce(sha256(first_value(CASE WHEN trim(t) <> '' AND NOT regexp_matches(t, '^[0-9 ]+$') THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), '') AS next_sha256 FROM c""")
def paragraph_noise(spark, d):
    """F-18, F-19: page numbers, and each paragraph's next one that isn't noise."""
    rows = texts(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    found = D.next_real(rows, "doc_id", "pos", "t", "^[0-9 ]+$")
    return found.select("doc_id", F.col("pos").cast("long"), X.is_page_number(F.col("t")).alias("number"), F.coalesce(F.sha2("next", 256), F.lit("")).alias("next_sha256"))


_HEADING_STOP = ", ".join(f"'{w}'" for w in X.HEADING_STOPWORDS)


@query(f"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(upper(split_part(text, chr(10), 1)), '[A-Z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_HEADING_STOP}))) AS l FROM documents WHERE lang = 'en')
SELECT doc_id, array_to_string(list_sort(l), ' ') AS words FROM w""")
def heading_words(spark, d):
    """F-20: different upper-case words of a heading."""
    rows = table(spark, d, "documents").filter("lang = 'en'")
    return rows.select("doc_id", F.array_join(F.array_sort(X.title_words(F.substring_index("text", "\n", 1))), " ").alias("words"))


@query("""SELECT doc_id, CASE WHEN length(text) > 140 THEN rtrim(substr(text, 1, 139), ' ') || '…' ELSE text END AS short, 'device-' || lang || '.json' AS file FROM documents""")
def truncated_texts(spark, d):
    """F-21, F-23: texts cut at a limit, and a device's file name."""
    return table(spark, d, "documents").select("doc_id", X.truncated(F.col("text")).alias("short"), D.device_file(F.col("lang")).alias("file"))


@query("""SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority, o_orderkey % 3, year(o_orderdate))) AS links FROM orders GROUP BY o_custkey""")
def link_keys(spark, d):
    """F-21: links told apart by both of their ends."""
    ends = {"volume": "o_orderstatus", "book": "o_orderpriority", "chapter": F.col("o_orderkey") % 3, "start": F.year("o_orderdate"), "end": F.lit(None).cast("int")}
    rows = table(spark, d, "orders").select("o_custkey", *[(F.col(v) if isinstance(v, str) else v).alias(f"{p}_{c}") for p in "ab" for c, v in ends.items()])
    return rows.groupBy("o_custkey").agg(F.size(F.collect_set(D.link_key())).cast("long").alias("links"))


_DAYS = ((1, 1, "first", 1, None), (1, 2, "the feast", 10, 16), (4, 1, "new year", 2, 3), (7, 1, "unset", None, None))


def _holy(spark):
    rows = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for n, v, k in zip(("month", "place", "name", "first", "last"), r, ("int", "int", "string", "int", "int"), strict=True)]) for r in _DAYS])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def _holy_sql():
    return "h(month, place, name, first, last) AS (VALUES " + ", ".join(f"({m}, {p}, '{n}', {f or 'NULL::INT'}, {t or 'NULL::INT'})" for m, p, n, f, t in _DAYS) + ")"


_NTH = "({0}) || CASE WHEN ({0}) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN ({0}) % 10 = 1 THEN 'st' WHEN ({0}) % 10 = 2 THEN 'nd' WHEN ({0}) % 10 = 3 THEN 'rd' ELSE 'th' END"


@query(f"""WITH {_holy_sql()}, o AS (SELECT o_orderkey AS id, month(o_orderdate) AS month, day(o_orderdate) AS day FROM orders), t AS (SELECT id, place, CASE WHEN first = day AND coalesce(last, first) = day THEN 'This is the day of ' || name || '.'
 WHEN day BETWEEN first AND coalesce(last, first) THEN 'This is during ' || name || '.' WHEN first > day THEN upper(name[1]) || name[2:] || ' falls ' || (first - day) || CASE first - day WHEN 1 THEN ' day' ELSE ' days' END || ' later, on the ' || {_NTH.format('first')} || '.' END AS s
 FROM o JOIN h USING (month) WHERE first IS NOT NULL)
SELECT o.id, coalesce(string_agg(s, ' ' ORDER BY place), '') AS note FROM o LEFT JOIN t ON o.id = t.id GROUP BY o.id""")
def day_notes(spark, d):
    """F-02: what a day is, or how far the next holy day of its month is."""
    days = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"))
    return K.day_notes(days, _holy(spark)).select("id", "note")


@query(f"""WITH {_holy_sql()}, l AS (SELECT month, string_agg(name || CASE WHEN first IS NULL THEN '' ELSE ' (' || first || CASE WHEN last <> first THEN '-' || last ELSE '' END || ')' END, ', ' ORDER BY place) AS days FROM h GROUP BY month),
m AS (SELECT unnest(range(1, 13)) AS month) SELECT m.month::INT AS month, 'The ' || {_NTH.format('m.month')} || ' month (m' || m.month || '; later x) - cold' || coalesce(chr(10) || days, '') AS note FROM m LEFT JOIN l ON l.month = m.month""")
def month_notes(spark, d):
    """F-03: a month's names, season and holy days."""
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"), F.array(F.concat(F.lit("m"), F.col("id").cast("string")), F.lit("x")).alias("names"), F.lit("cold").alias("season"))
    return K.month_notes(months, _holy(spark))


_ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split()


@query("SELECT o_orderkey, (o_orderkey % 12 + 1)::BIGINT AS day, month(o_orderdate)::BIGINT AS month FROM orders")
def calendar_phrases(spark, d):
    """F-01: phrases that name a day and month."""
    word = lambda n: F.element_at(F.array(*[F.lit(w) for w in _ORDINALS]), n.cast("int"))
    phrase = F.concat(F.lit("It was on the "), F.initcap(word(F.col("o_orderkey") % 12 + 1)), F.lit(" day of the "), word(F.month("o_orderdate")), F.lit(" month, the first day."))
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(X.date_phrases(phrase)).alias("p"))
    return rows.select("o_orderkey", F.col("p.day").cast("long").alias("day"), F.col("p.month").cast("long").alias("month"))


@query("""SELECT doc_id, sha256(replace(replace(regexp_replace(regexp_replace(text, '@([A-Za-z0-9_])', '@' || chr(8203) || '\\1', 'g'), '#([0-9])', '#' || chr(8203) || '\\1', 'g'), '<', '&lt;'), 'zzz', 'zzz')) AS defused,
 sha256(regexp_replace(text, '([\\p{L}])-[ \\t]*\\n\\s*([\\p{Ll}])', '\\1\\2', 'g')) AS joined FROM documents""")
def defused_texts(spark, d):
    """C-09, C-13: words broken at line ends joined; mentions and tags made harmless."""
    return texts(spark, d).select("doc_id", F.sha2(X.defused(F.col("text")), 256).alias("defused"), F.sha2(X.dehyphenated(F.col("text")), 256).alias("joined"))


@query("""SELECT o_orderkey, 'He said "' || o_orderpriority || '" - it''s done' AS text FROM orders""")
def plain_quotes(spark, d):
    """C-10: markup out, typographic signs made plain."""
    marked = F.concat(F.lit("  He <b>said</b>  “"), F.col("o_orderpriority"), F.lit("”{note} —  it’s done "))
    return table(spark, d, "orders").select("o_orderkey", X.plain_quotes(marked).alias("text"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' x1 x2 ' || p_type ELSE p_name || ' ' || p_type END AS text FROM part""")
def junk_runs(spark, d):
    """W-09: runs of eight junk tokens and more go, shorter ones stay."""
    junk = lambda n: F.lit(" ".join(f"x{i}" for i in range(1, n + 1)))
    m = F.col("p_partkey") % 3
    text = F.when(m == 0, F.concat_ws(" ", junk(9), "p_name", junk(8))).when(m == 1, F.concat_ws(" ", "p_name", junk(2), "p_type")).otherwise(F.concat_ws(" ", "p_name", junk(12), "p_type"))
    return D.without_junk_runs(table(spark, d, "part").withColumn("text", text), "p_partkey", "text", "^x[0-9]+$")


@query(f"""WITH {PARAGRAPHS}, s AS (SELECT *, CASE WHEN regexp_matches(t, '^\\s*\\p{{Ll}}') AND coalesce(NOT regexp_matches(lag(t) OVER (PARTITION BY doc_id ORDER BY pos), '[.!?]["'')\\]]*\\s*$'), false) THEN 0 ELSE 1 END AS start FROM pp),
g AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY pos) AS paragraph FROM s) SELECT doc_id, paragraph::BIGINT AS paragraph, sha256(string_agg(t, ' ' ORDER BY pos)) AS text_sha256 FROM g GROUP BY doc_id, paragraph""")
def joined_sentences(spark, d):
    """W-08: paragraphs that go on in the next line."""
    rows = texts(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    return A.joined_sentences(rows, "doc_id", "pos", "t").select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.sha2("t", 256).alias("text_sha256"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN p_name || ';' WHEN 3 THEN p_name || ' O' ELSE p_name END AS text FROM part""")
def cleaned_verses(spark, d):
    """C-02 to C-07: split and misread words, stray signs and digits put right by the counts of clean names."""
    part = texts(spark, d, "part")
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    copies = part.select(F.concat_ws(" ", F.array_repeat("p_name", 20)).alias("text"))
    words = copies.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    pairs = A.bigrams(copies, F.split("text", " "), 1)
    m = F.col("p_partkey") % 4
    bad = (
        F.when(m == 0, F.concat(first, F.lit(" ^ "), F.substring(second, 1, 2), F.lit(" "), F.expr("substring(split_part(p_name, ' ', 2), 3)"))).when(m == 1, F.concat(F.col("p_name"), F.lit(" ;")))
        .when(m == 2, F.concat(first, F.lit(" «"), second)).otherwise(F.concat(F.col("p_name"), F.lit(" 0")))
    )
    return D.cleaned_verses(part.select(F.col("p_partkey").alias("id"), bad.alias("text"), F.lit("").alias("parallel")), words, pairs).withColumnRenamed("id", "p_partkey")


@query(f"""WITH w AS (SELECT unnest({TOK.format('text')}) AS word FROM documents WHERE lang = 'en') SELECT word, count(*) AS n FROM w WHERE word NOT IN (SELECT unnest({TOK.format('text')}) FROM benchmark) GROUP BY word""")
def unknown_words(spark, d):
    """A-11: words that the vocabulary lacks, counted."""
    vocabulary = table(spark, d, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return D.unknown_words(texts(spark, d).filter("lang = 'en'"), "text", vocabulary)


@query("""WITH v AS (SELECT len(regexp_extract_all(p_name, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS n, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS t FROM part) SELECT sum(n)::BIGINT AS words, sum(t)::BIGINT AS tagged, round(sum(t) / sum(n), 6) AS share FROM v""")
def tag_coverage(spark, d):
    """A-12: the share of words that have a label."""
    part = table(spark, d, "part")
    tagged = part.filter("p_size > 25").select(F.col("p_partkey").alias("ref"), F.create_map(F.lit(0), F.lit("H1")).alias("tags"))
    return D.tag_coverage(part.select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("text")), tagged).select(F.col("words").cast("long"), F.col("tagged").cast("long"), F.round("share", 6).alias("share"))


@query(f"""SELECT o_orderkey AS id, {_letters_sql('o_orderkey')} AS word, 'G' || o_orderkey AS number FROM orders WHERE o_orderkey % 6 < 4""")
def borrowed_labels(spark, d):
    """J-15, F-14: verses take the labels of the like verse of their chapter, at most four numbers away."""
    own = F.concat_ws(" ", F.lit("and the"), _letters(F.col("o_orderkey")), F.lit("came"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("b").alias("book"), F.floor(F.col("o_orderkey") / 6).alias("chapter"), (F.col("o_orderkey") % 6 * 10).alias("verse"), own.alias("text"))
    tags = F.create_map(F.lit(2), F.array(F.concat(F.lit("G"), F.col("id").cast("string"))))
    tagged = rows.select("book", "chapter", F.when(F.col("verse") < 40, F.col("verse") + 4).otherwise(F.col("verse") + 5).alias("verse"), "text", tags.alias("tags"))
    found = L.borrowed_labels(rows, tagged).filter("position = 2")
    return found.select("id", _letters(F.col("id")).alias("word"), F.get("numbers", F.lit(0)).alias("number"))


@query("""SELECT c_nationkey::BIGINT AS volume, c_custkey AS number, c_custkey * 7 AS place FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) % 3 <> 0""")
def aligned_titles(spark, d):
    """J-17: headings of a scan matched with the printed list, in order; two of three are found."""
    words = F.array(F.upper(_letters(F.col("c_custkey") + 1000)), F.lit("DISCOURSE"), F.upper(_letters(F.col("c_custkey") + 2000)))
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("volume"), "c_custkey", words.alias("words"), F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("n"))
    candidates = rows.filter("n % 3 <> 0").select("volume", (F.col("c_custkey") * 7).alias("place"), "words", F.lit("").alias("nearby"))
    return L.aligned_titles(candidates, rows.select("volume", F.col("c_custkey").alias("number"), "words", F.lit("").alias("speaker")))


@query("SELECT c_custkey AS id_a, c_custkey + 5 AS id_b FROM customer WHERE c_custkey + 5 <= (SELECT max(c_custkey) FROM customer)")
def moved_texts(spark, d):
    """J-18, D-14: texts found again under another number of their book."""
    text = lambda n: F.concat_ws(" ", F.lit("there"), _letters(n + 1000), _letters(n * 7 + 5000), _letters(n * 3 + 90000))
    rows = table(spark, d, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 50).alias("book"))
    a = rows.select(F.col("c_custkey").alias("id_a"), "book", text(F.col("c_custkey")).alias("text_a"))
    last = rows.agg(F.max("c_custkey").alias("last"))
    b = rows.select((F.col("c_custkey") + 5).alias("id_b"), "book", text(F.col("c_custkey")).alias("text_b")).crossJoin(F.broadcast(last)).filter("id_b <= last")
    return M.nearest_text(a, b, 0.95, book=["book"]).select("id_a", "id_b")


@query("""WITH l AS (SELECT c_custkey AS id, r_name AS book, c_custkey % 9 + 1 AS a, c_custkey % 4 AS n, r_name AS named FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT id, 0::BIGINT AS pos, book, unnest(range(a, a + n + 1)) AS chapter FROM l UNION ALL SELECT id, 1, book, 50 FROM l""")
def reading_block(spark, d):
    """J-20: an assigned reading's chapters; a part without a book takes the last one."""
    region = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = table(spark, d, "customer").join(region, F.col("c_nationkey") == F.col("n_nationkey"))
    a = F.col("c_custkey") % 9 + 1
    text = F.concat(F.substring("r_name", 1, 3), F.lit(". "), a.cast("string"), F.lit("-"), (a + F.col("c_custkey") % 4).cast("string"), F.lit("; 50"))
    found = H.reading_block(rows.select(F.col("c_custkey").alias("id"), text.alias("text")), table(spark, d, "region").select(F.col("r_name").alias("name")))
    return found.select("id", F.col("pos").cast("long"), "book", F.col("chapter").cast("long").alias("chapter"))


@query("""WITH c AS (SELECT 0 AS block) SELECT c_custkey AS query, 1::BIGINT AS place, 't' || c_custkey % 5 AS topic, 1 AS first, 3 AS last FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 2 ELSE 1 END, 't' || c_custkey % 5, 20, 22 FROM customer""")
def key_passages(spark, d):
    """H-04: key passages of the chosen topics that overlap neither what was found nor one another."""
    customer = table(spark, d, "customer")
    topics = customer.select(F.col("c_custkey").alias("query"), F.concat(F.lit("t"), (F.col("c_custkey") % 5).cast("string")).alias("topic"), F.lit(1).alias("rank"))
    ranges = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(a).alias("first"), F.lit(b).alias("last")) for p, a, b in ((1, 1, 3), (2, 20, 22), (3, 22, 24), (4, 50, 51))])
    passages = topics.select("topic").distinct().select("topic", F.explode(ranges).alias("r")).select("topic", "r.*", F.lit("b").alias("book"), F.lit(1).alias("chapter"))
    found = customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("query"), F.lit("b").alias("book"), F.lit(1).alias("chapter"), F.lit(3).alias("first"), F.lit(5).alias("last"))
    return K.key_passages(topics, passages, found).select("query", F.col("place").cast("long").alias("place"), "topic", "first", "last")


def _asked(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey").cast("string")
    listed = F.concat(F.lit('Try ["nation '), F.col("n_nationkey").cast("string"), F.lit(" "), key, F.lit(':1-2", "Nobody 3:4", "nation '), F.col("n_nationkey").cast("string"), F.lit(" "), key, F.lit(':1-2"] or so'))
    return rows.select(F.col("c_custkey").alias("owner"), listed.alias("content"))


def _named_verses(spark, d):
    """Verses and the aliases "nation 7" of their books "NATION_7"."""
    ve = verses(spark, d).select("volume_sort", "book_name", "chapter_number", "verse_number", "text")
    aliases = table(spark, d, "nation").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("alias"), F.lower("n_name").alias("book"))
    return ve, aliases


_RESOLVED = f"""{HIERARCHY}, r AS (SELECT chapter_id AS owner, lower(replace(min(book_name), '_', ' ')) || ' ' || chapter_id || ':1-2' AS label, string_agg(text, ' ' ORDER BY verse_number) AS text FROM ve WHERE verse_number <= 2 GROUP BY chapter_id)"""


@query(f"WITH {_RESOLVED} SELECT owner, 1::BIGINT AS place, label, text FROM r")
def resolved_references(spark, d):
    """H-20 to H-22, U-03: references of a model's reply that exist, with their text; others and repeats are dropped."""
    asked = _asked(spark, d).select("owner", F.posexplode(R.candidates_in(F.col("content"))).alias("rank", "text"))
    return R.resolved(asked, *_named_verses(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_RESOLVED} SELECT owner, 1::BIGINT AS place, label FROM r UNION ALL SELECT c_custkey, CASE WHEN owner IS NULL THEN 1 ELSE 2 END, c_name FROM customer LEFT JOIN r ON owner = c_custkey")
def answered_questions(spark, d):
    """H-23: a reply's references, topped up with search results."""
    more = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), F.lit(1).alias("rank"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    return K.answered(_asked(spark, d), *_named_verses(spark, d), more).select("owner", F.col("place").cast("long").alias("place"), "label")


@query("""WITH t AS (SELECT c_nationkey::BIGINT AS query, c_mktsegment AS title, min(c_custkey) AS rank FROM customer GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS i FROM t)
SELECT query, CASE i WHEN 2 THEN 1 ELSE 2 END::BIGINT AS place, title FROM n WHERE i <= 2""")
def directions(spark, d):
    """H-25: different titles of a broad search, of which a selector picks the second and the first."""
    found = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("query"), F.col("c_custkey").alias("rank"), F.col("c_mktsegment").alias("title"))
    return K.directions(found, "", lambda prompt: "[2, 1]").select("query", F.col("place").cast("long").alias("place"), "title")


@query("""WITH r AS (SELECT c_nationkey::BIGINT AS query, c_name AS title, c_custkey, c_custkey % 10 <> 0 AS found, CASE WHEN c_mktsegment = 'BUILDING' THEN 'lexicon' ELSE 'verse' END AS kind FROM customer), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY found, c_custkey) AS rank FROM r QUALIFY rank <= 20)
SELECT query, 'JST ' || title AS title, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM o WHERE kind <> 'lexicon'""")
def prepared_talks(spark, d):
    """H-26: pinned hits, then found ones, up to twenty; unrelated dictionary entries left out, volumes marked. Places before that step have holes."""
    none = F.lit(None).cast("string")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("query"), F.col("c_custkey").alias("rank"), F.when(F.col("c_mktsegment") == "BUILDING", "lexicon").otherwise("verse").alias("kind"),
                                              F.col("c_name").alias("title"), none.alias("speaker"), none.alias("url"), F.lit("drink").alias("text"), F.lit("jst").alias("volume"))
    pinned, found = rows.filter("rank % 10 = 0"), rows.filter("rank % 10 <> 0")
    out = K.prepared_talk(pinned, found, rows.select("title", "speaker", "url").filter("url IS NOT NULL"), ["faith"], {"jst": "JST"}, 20)
    return out.select("query", "title", F.row_number().over(W.partitionBy("query").orderBy("place")).cast("long").alias("place"))


@query("""SELECT n_name AS name, c_custkey AS id, 3 AS start, 3 + length(n_name) AS "end", CASE WHEN n_regionkey > 0 THEN n_name || ': r' || n_regionkey ELSE n_name END AS tip FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def name_links(spark, d):
    """F-16: names in texts, the longest first; parts of hyphenated words aren't names."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    assert nation.count() <= 10_000  # the names of all books go along as one pattern
    links = {r["n_name"]: (r["n_name"], f"r{r['n_regionkey']}" if r["n_regionkey"] else None) for r in nation.collect()}
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("In "), F.col("n_name"), F.lit(", x-"), F.col("n_name"), F.lit(" or so"))
    found = L.link_spans(rows.select("c_custkey", text.alias("text")), links, "c_custkey", "text")
    return found.select(F.col("target").alias("name"), F.col("c_custkey").alias("id"), "start", "end", "tip")


@query("""SELECT o_custkey AS query, count(*) - count(DISTINCT (o_orderstatus, o_orderpriority)) AS repeats FROM orders GROUP BY o_custkey""")
def repeated_slots(spark, d):
    """E-03: hits that repeat another's place."""
    return Q.repeated_slots(table(spark, d, "orders").withColumnRenamed("o_custkey", "query"), ["o_orderstatus", "o_orderpriority"])


@query("""SELECT count(*) AS n, avg(CASE WHEN p_size < 2 THEN 1.0 ELSE 0.0 END)::DOUBLE AS missing, count(*) >= 100 AND avg(CASE WHEN p_size < 2 THEN 1.0 ELSE 0.0 END) <= 0.02 AS accepted FROM part""")
def lexicon_gate(spark, d):
    """Q-V2: enough entries, and few without a gloss."""
    return Q.lexicon_gate(table(spark, d, "part").withColumn("gloss", F.when(F.col("p_size") < 2, " ").otherwise(F.col("p_name"))), 100)


@query("""WITH f AS (SELECT o_custkey, count(*) AS found FROM orders GROUP BY 1) SELECT c_custkey AS o_custkey, 10::BIGINT AS n, coalesce(found, 0) AS found FROM customer LEFT JOIN f ON c_custkey = o_custkey WHERE coalesce(found, 0) <> 10""")
def expected_counts(spark, d):
    """Q-V5: keys whose number of rows isn't the expected one."""
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(10).cast("long").alias("n"))
    return Q.expected_counts(table(spark, d, "orders"), "o_custkey", expected)


@query("""WITH r AS (SELECT l_orderkey * 100000 + l_partkey AS id, l_linenumber - 1 AS a, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity::INT % 9 END AS b FROM lineitem)
SELECT id, coalesce(CASE WHEN a < 1 THEN 'below one' WHEN a > 5 THEN 'beyond the end' WHEN b < a THEN 'reversed' WHEN b > 5 THEN 'beyond the end' END, 'none') AS problem FROM r""")
def range_problems(spark, d):
    """Q-V6: what is wrong with a typed range of verses."""
    last = F.when(F.col("l_returnflag") != "A", F.col("l_quantity").cast("int") % 9)
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("id"), F.coalesce(Q.range_error(F.col("l_linenumber") - 1, last, F.lit(5)), F.lit("none")).alias("problem"))


_CARD_HASH = "sha256(heading || chr(0) || body)"


@query(f"""WITH r AS (SELECT l_suppkey, l_partkey, l_returnflag = 'R' AS key, 'Part ' || l_partkey || ':' || l_orderkey AS ref, l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
l AS (SELECT l_suppkey, string_agg(ref, '; ' ORDER BY pos, ref) FILTER (key) AS keys, array_to_string((list(ref ORDER BY pos, ref) FILTER (NOT key))[1:80], '; ') AS rest FROM r GROUP BY l_suppkey),
c AS (SELECT 'topic:' || s_suppkey AS key, s_name AS heading, 'About ' || s_name || coalesce(chr(10) || 'Key passages: ' || keys, '') || coalesce(chr(10) || 'References: ' || nullif(rest, ''), '') AS body FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey)
SELECT key, heading, {_CARD_HASH} AS content_hash FROM c""")
def topic_cards(spark, d):
    """G-01: topics as cards."""
    topics = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("slug"), F.col("s_name").alias("name"), F.concat(F.lit("About "), "s_name").alias("description"))
    reference = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_orderkey").cast("string"))
    refs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("topic_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), reference.alias("reference"), (F.col("l_returnflag") == "R").alias("is_key"))
    return P.topic_cards(topics, refs).select("key", "heading", "content_hash")


@query(f"""WITH c AS (SELECT 'link:' || o_orderkey AS key, 'Gen ' || o_custkey || ':1-3 ' || CASE o_orderstatus WHEN 'O' THEN 'quotes' WHEN 'F' THEN 'foreshadows' ELSE 'paraphrases' END || ' Alma ' || o_orderkey AS heading, '' AS body, 'bible' AS volume_slug FROM orders)
SELECT key, heading, volume_slug, {_CARD_HASH} AS content_hash FROM c""")
def link_cards(spark, d):
    """G-02: curated links as sentences."""
    kind = F.when(F.col("o_orderstatus") == "O", "quotation").when(F.col("o_orderstatus") == "F", "typology").otherwise("paraphrase")
    none = F.lit(None).cast("int")
    edges = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("bible").alias("a_volume"), F.lit("Gen").alias("a_book"), F.col("o_custkey").alias("a_chapter"), F.lit(1).alias("a_start"), F.lit(3).alias("a_end"),
        F.lit("Alma").alias("b_book"), F.col("o_orderkey").alias("b_chapter"), none.alias("b_start"), none.alias("b_end"), kind.alias("relationship"), F.lit(None).cast("string").alias("note"),
    )
    return P.link_cards(edges).select("key", "heading", "volume_slug", "content_hash")


@query(f"""WITH w AS (SELECT o_custkey AS k, list(o_orderpriority || o_orderkey ORDER BY o_orderpriority || o_orderkey) AS r FROM orders GROUP BY 1), c AS (SELECT 'u' || k AS key, 'Work ' || k || ' — Someone — Conference' AS heading, array_to_string(r[1:60], '; ') AS body FROM w)
SELECT key, heading, {_CARD_HASH} AS content_hash FROM c""")
def work_cards(spark, d):
    """G-03, S-24: citing works with their references, sorted, as cards."""
    from lectern.sources import readers

    url = F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
    citations = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), url.alias("url"), F.concat(F.lit("Work "), F.col("o_custkey").cast("string")).alias("title"), F.lit("Someone").alias("speaker"), F.lit("April 2001").alias("date"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("reference"))
    return P.work_cards(readers.citing_works(citations).withColumn("label", F.lit("Conference"))).select("key", "heading", "content_hash")


@query(f"""WITH {NOTES}, c AS (SELECT 'note:' || id AS key, CASE WHEN verse_id IS NULL THEN 'Note' ELSE 'V' || verse_id END AS heading, text AS body FROM no WHERE deleted_at IS NULL AND trim(text) <> '') SELECT key, heading, {_CARD_HASH} AS content_hash FROM c""")
def note_cards(spark, d):
    """G-04: notes as cards."""
    return P.note_cards(notes(spark, d).withColumn("reference", F.concat(F.lit("V"), F.col("verse_id").cast("string")))).select("key", "heading", "content_hash")


@query(f"""WITH c AS (SELECT 'word:H' || p_partkey AS key, 'H' || p_partkey || ' ' || p_name || ' ' || p_brand AS heading, p_type || chr(10) || 'defined' || chr(10) || 'rendered' AS body FROM part) SELECT key, heading, {_CARD_HASH} AS content_hash FROM c""")
def lexicon_cards(spark, d):
    """G-05: dictionary entries as cards."""
    rows = table(spark, d, "part").select(F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("strongs"), F.col("p_name").alias("lemma"), F.col("p_brand").alias("transliteration"), F.col("p_type").alias("gloss"), F.lit("defined").alias("definition"), F.lit("rendered").alias("kjv_renderings"))
    return P.lexicon_cards(rows).select("key", "heading", "content_hash")


@query("""WITH d AS (SELECT DISTINCT p_brand AS strongs FROM part), g AS (SELECT p_brand, list(p_name ORDER BY p_partkey) AS l FROM part GROUP BY p_brand) SELECT 'H' || p_partkey AS strongs, CASE WHEN p_partkey % 2 = 0 THEN 'aramaic' ELSE 'hebrew' END AS language, p_name || '; ' || p_type AS gloss, p_partkey AS number FROM part""")
def lexicon_rows(spark, d):
    """C-11: dictionary entries with their first glosses."""
    strongs = F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("strongs")
    part, none = table(spark, d, "part"), F.lit("")
    entries = part.select(strongs, F.when(F.col("p_partkey") % 2 == 0, "(Aramaic) x").otherwise("y").alias("derivation"), none.alias("lemma"), none.alias("xlit"), none.alias("pron"), none.alias("strongs_def"), none.alias("kjv_def"))
    found = D.lexicon_rows(entries, part.select(strongs, F.array("p_name", "p_type").alias("glosses")), "hebrew")
    return found.select("strongs", "language", "gloss", F.col("number").cast("long").alias("number"))


@query("""WITH q AS (SELECT DISTINCT unnest([lower(p_name), split_part(p_name, ' ', 2) || 's', lower(p_type)]) AS t FROM part), fo AS (SELECT t AS query, t AS form, 0 AS extra FROM q UNION SELECT t, t[:-2], 4 FROM q WHERE right(t, 1) = 's' AND NOT contains(t, ' ')),
e AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'H' ELSE 'G' END AS l, p_partkey AS n, 'to ' || p_name || '; x' AS gloss, lower(p_type) AS kjv, lower(p_name) AS name FROM part),
m AS (SELECT query, l, n, min(extra + CASE WHEN name = form THEN 0 WHEN kjv = form THEN 1 WHEN regexp_matches(gloss, '\\b' || form || '\\b') THEN 2 END) AS level FROM e JOIN fo ON kjv = form OR regexp_matches(gloss, '\\b' || form || '\\b') GROUP BY query, l, n)
SELECT query, l || n AS strongs, row_number() OVER (PARTITION BY query ORDER BY l = 'H', level, l <> 'H', n) AS rank FROM m QUALIFY rank <= 10 UNION ALL SELECT 'h002', 'H2', 1""")
def lexicon_search(spark, d):
    """X-10, X-13: entries by how well a word or its root matches them, Greek ones first; a number finds its entry."""
    part, key, even = table(spark, d, "part"), F.col("p_partkey").cast("string"), F.col("p_partkey") % 2 == 0
    entries = part.select(
        F.concat(F.when(even, "H").otherwise("G"), key).alias("strongs"), F.when(even, "aramaic").otherwise("greek").alias("language"), F.concat(F.lit("to "), "p_name", F.lit("; x")).alias("gloss"),
        F.concat("p_type", F.lit(", rest")).alias("kjv_renderings"), F.lit("").alias("transliteration"),
    )
    words = part.select(F.explode(F.array(F.lower("p_name"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("s")), F.lower("p_type"))).alias("query")).distinct()
    words = words.union(spark.range(1).select(F.lit("h002")))
    return S.lexicon_search(entries, words.withColumn("text", F.col("query")), preferred="greek").select("query", "strongs", F.col("rank").cast("long"))


@query(f"""WITH t AS (SELECT doc_id AS doc, unnest(range(0, len(l))) AS pos, unnest(l) AS token FROM (SELECT doc_id, {TOK.format("CASE WHEN doc_id % 10 = 0 THEN 'changed words, changed' ELSE text END")} AS l FROM documents WHERE doc_id % 10 <> 1))
SELECT token, count(*) AS docs, sum(tf)::BIGINT AS tf, sum(first)::BIGINT AS first FROM (SELECT token, doc, count(*) AS tf, min(pos) AS first FROM t GROUP BY token, doc) GROUP BY token""")
def postings_after_edits(spark, d):
    """X-01, X-11: stored postings follow edits: of changed documents they are made anew, of deleted ones they go."""
    docs = texts(spark, d).select("doc_id", "text")
    changed = docs.filter("doc_id % 10 < 2").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "changed words, changed").alias("text"))
    found = K.reindexed(S.postings(docs, "doc_id", "text"), changed, "doc_id", "text")
    return found.groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"), F.sum(F.get("positions", F.lit(0))).cast("long").alias("first"))


@query(f"""WITH {NOTES}, w AS (SELECT id, deleted_at, {TOK.format('text')} AS tok FROM no), st AS (SELECT count(*) AS total, avg(len(tok)) AS avglen FROM w), h AS (SELECT id, deleted_at, len(tok) AS len, 1 AS f FROM w WHERE tok[2] = '7'), n AS (SELECT count(*) AS n FROM h),
s AS (SELECT id AS doc, deleted_at, round(greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * len / avglen)), 6) AS score FROM h, st, n)
SELECT doc, score, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM s WHERE deleted_at IS NULL QUALIFY rank <= 40""")
def note_search(spark, d):
    """X-05: a phrase in notes; deleted ones count in the statistics only."""
    phrases = spark.range(1).select(F.lit(0).alias("query"), F.array(F.lit("k"), F.lit("7")).alias("words"))
    return D.search_notes(notes(spark, d), phrases).select("doc", "score", "rank")


@query("""SELECT item_id, array_to_string(list_transform(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i])[1:12], lambda w: regexp_replace(w, '''s$', '')), ' ') AS words
FROM (SELECT item_id, list_filter(regexp_extract_all(lower(replace(text, ' t', '''s t')), '[a-z'']+'), lambda w: length(w) > 2 AND w NOT IN (%s)) AS l FROM benchmark)""" % ", ".join(f"'{w}'" for w in X.STOPWORDS))  # fmt: skip
def snippet_keywords(spark, d):
    """X-08: twelve keywords without possessive endings."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.keywords(F.replace("text", F.lit(" t"), F.lit("'s t")), 12, possessive=True), " ").alias("words"))


@query("""WITH h AS (SELECT sha256(text) AS hash, min(text) AS text FROM documents GROUP BY 1), w AS (SELECT hash, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM h WHERE hash NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'fr')),
b AS (SELECT hash, ('0x' || right(md5(w), 2))::INT % 64 AS b, count(*) AS n FROM w GROUP BY 1, 2) SELECT hash, count(*) AS filled, round(max(n) / sqrt(sum(n * n)), 4) AS top FROM b GROUP BY hash""")
def embedded_texts(spark, d):
    """V-01, V-02, V-03, V-07, S-36, K-08: vectors of length one for the texts that have none, each different text once; the model counts words in buckets, and the
    service refuses batches of more than 40 texts, which are then halved."""
    embed = V.hashed_words()

    def call(batch):
        if len(batch) > 40:
            raise V.TooLarge
        return [embed(t) for t in batch]

    docs = texts(spark, d).select(F.sha2("text", 256).alias("hash"), "text", "lang")
    found = V.embed_pending(docs.select("hash", "text"), docs.filter("lang = 'fr'").select("hash"), call)
    full = F.size(F.filter("vector", lambda x: x != 0)).cast("long")
    return found.filter(full > 0).select("hash", full.alias("filled"), F.round(F.array_max("vector").cast("double"), 4).alias("top"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) , 3) > 0 AS has_length, 1.0 AS length FROM embeddings""")
def normalized_vectors(spark, d):
    """K-08, S-27: vectors of length one, joined with their pieces by hash."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("content_hash"), V.normalized(F.col("embedding")).alias("vector"))
    pieces = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("content_hash"))
    return K.joined_vectors(pieces, rows).select("vec_id", F.lit(True).alias("has_length"), F.round(V.norm(F.col("vector")), 3).alias("length"))


@query("""SELECT c_custkey, lower(c_mktsegment) || ':768:' || c_nationkey AS print, CASE WHEN contains(lower(c_mktsegment), 'build') THEN 'first {q}' ELSE 'any {q}' END AS template FROM customer""")
def model_formats(spark, d):
    """V-05, V-06: a vector space's name, and the template of the first pattern that a model's name contains."""
    rows = table(spark, d, "customer").withColumn("model", F.concat("c_mktsegment", F.lit(":latest")))
    listed = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(x).alias("pattern"), F.lit("d").alias("document"), F.lit(t).alias("query")) for p, x, t in ((0, "build", "first {q}"), (1, "", "any {q}"))])
    templates = spark.range(1).select(F.explode(listed).alias("t")).select("t.*")
    names = V.formatted(templates, rows.select("model").distinct()).select("model", F.col("query").alias("template"))
    return rows.select("c_custkey", "model", V.model_print(F.col("model"), F.lit(768), F.col("c_nationkey")).alias("print")).join(names, "model").select("c_custkey", "print", "template")


@query("""SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0""")
def prepared_build(spark, d):
    """V-02, V-06: what is still to be embedded; vectors of another model would not count."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("content_hash"))
    return D.prepared(rows, rows.filter("vec_id % 3 = 0").select("content_hash"), "m:1", "m:1")[0].select("vec_id")


@query(f"""WITH {HIERARCHY} SELECT chapter_id, volume_slug FROM ch""")
def wide_hierarchy(spark, d):
    """S-02, D-20: the five levels joined into one row, from tables in their stored schemas."""
    from lectern import schemas

    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    volumes = region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lower("r_name").alias("slug"))
    books = nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("volume_id"), F.col("n_name").alias("name"))
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("book_id"), F.col("c_custkey").alias("chapter_number"))
    one = own.select("id", F.col("id").alias("chapter_id"))
    tables = [schemas.conform(df, n) for n, df in (("volumes", volumes), ("testaments", volumes.limit(0)), ("books", books), ("chapters", own), ("verses", one))]
    return schemas.verses_wide(*tables).select("chapter_id", "volume_slug")
