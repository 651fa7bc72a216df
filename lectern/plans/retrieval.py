"""Full-text, vector and hybrid retrieval over documents and embeddings.

Passages are the non-empty paragraphs of documents; a passage's id is doc_id * 100000 + its position.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import analytics as A
from lectern.operators import passages as P
from lectern.operators import ranking as R
from lectern.operators import search as S
from lectern.operators import study as T
from lectern.operators import vectors as V
from lectern.plans.registry import once, query, table, texts

TOK = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)

#: Shared SQL: passages with their tokens.
_PASSAGES = f"""pp AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),
pas AS (SELECT doc_id * 100000 + pos AS doc, t AS text, {TOK.format('t')} AS tok FROM pp WHERE trim(t) <> ''),
st AS (SELECT count(*) AS total, avg(len(tok)) AS avglen FROM pas)"""

_BM25 = "greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * len / avglen))"

_KEYWORDS = f"""kw AS (SELECT item_id AS query, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: w), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS l FROM benchmark),
terms AS (SELECT DISTINCT query, strip_accents(l[i]) AS term FROM (SELECT query, list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i])[1:12] AS l FROM kw), range(1, 13) r(i) WHERE i <= len(l) AND NOT contains(l[i], ''''))"""

_OR = f"""WITH {_PASSAGES}, {_KEYWORDS},
tf AS (SELECT query, term, doc, len(tok) AS len, count(*) AS f FROM (SELECT doc, tok, unnest(tok) AS token FROM pas) JOIN terms ON token = term GROUP BY query, term, doc, tok),
df AS (SELECT query, term, count(*) AS n FROM tf GROUP BY query, term),
sc AS (SELECT query, doc, round(sum({_BM25}), 6) AS score FROM tf JOIN df USING (query, term), st GROUP BY query, doc),
rk AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc)"""


def _passages(spark, d):
    return P.passages(texts(spark, d)).select((F.col("doc_id") * 100000 + F.col("pos")).alias("doc"), "text")


def _terms(spark, d):
    """Keywords of benchmark items as index terms; words with an apostrophe are phrases of their own and left out."""
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(X.keywords(F.col("text"), 12)).alias("w"))
    return words.filter(~F.contains("w", F.lit("'"))).select("query", X.folded(F.col("w")).alias("term")).distinct()


def passage_index(spark, d):
    """The stored index of all passages, which the searches below read."""
    return once(spark, d, "passages", lambda: S.indexed(_passages(spark, d), "doc", {"text": 1.0}))


def bm25(spark, d, limit):
    return S.ranked(S.search_any(passage_index(spark, d), _terms(spark, d), limit), limit)


@query(f"{_OR} SELECT query, doc, score, rank FROM rk WHERE rank <= 10")
def bm25_or(spark, d):
    """X-06: the ten best passages for each benchmark item's keywords."""
    return bm25(spark, d, 10)


@query(f"""WITH k AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS l FROM benchmark)
SELECT item_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i])[1:12], ' ') AS words FROM k""")
def keywords(spark, d):
    """X-07: the first twelve different words worth searching for."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.keywords(F.col("text"), 12), " ").alias("words"))


@query(f"""WITH b AS (SELECT doc_id AS doc, {TOK.format('string_split(text, chr(10))[1]')} AS h, {TOK.format("array_to_string(string_split(text, chr(10))[2:], chr(10))")} AS b FROM documents),
st AS (SELECT count(*) AS total, avg(len(h) + len(b)) AS avglen FROM b), {_KEYWORDS},
tk AS (SELECT doc, len(h) + len(b) AS len, 0.2 AS w, unnest(h) AS token FROM b UNION ALL SELECT doc, len(h) + len(b), 1.0, unnest(b) FROM b),
tf AS (SELECT query, term, doc, len, sum(w)::DOUBLE AS f FROM tk JOIN terms ON token = term GROUP BY query, term, doc, len), df AS (SELECT query, term, count(*) AS n FROM tf GROUP BY query, term),
sc AS (SELECT query, doc, round(sum({_BM25}), 6) AS score FROM tf JOIN df USING (query, term), st GROUP BY query, doc)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc QUALIFY rank <= 10""")
def bm25_weighted(spark, d):
    """X-02, X-06: first lines as headings of weight 0.2, the rest as bodies."""
    return S.ranked(S.search_any(headed_index(spark, d), _terms(spark, d), 10), 10)


def headed_index(spark, d):
    lines = F.split("text", "\n")
    docs = texts(spark, d).select("doc_id", F.element_at(lines, 1).alias("heading"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n").alias("body"))
    return once(spark, d, "headed documents", lambda: S.indexed(docs, "doc_id", {"heading": 0.2, "body": 1.0}))


def _study(spark, d):
    """Documents as pieces: English ones are passages, French talks, German articles, others topics; the source is the volume."""
    lang, first = F.col("lang"), F.trim(F.element_at(F.split("text", "\n"), 1))
    pieces = table(spark, d, "documents").select(
        F.col("doc_id").alias("doc"), F.when(lang == "en", T.PASSAGE).when(lang == "fr", "talk").when(lang == "de", "article").otherwise("topic").alias("kind"),
        F.when(lang == "en", 0).when(lang == "fr", 1).when(lang == "de", 2).otherwise(3).alias("tier"), F.col("source").alias("volume"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("label"), first.alias("title"),
        F.lit("").alias("speaker"), F.when(lang != "en", F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("url"), F.substring("text", 1, 300).alias("text"), (F.col("doc_id") % 7).alias("chapter"),
        (F.col("doc_id") % 40).alias("first"), (F.col("doc_id") % 40 + F.col("n_chars") % 5).alias("last"), F.when(F.col("doc_id") % 11 == 0, F.split_part(first, F.lit(" "), F.lit(1))).alias("topic"),
    )
    return T.Study(pieces, headed_index(spark, d))


_GROUPS = [T.Group("passages", (T.PASSAGE,), 8), T.Group("talks", ("talk",), 4), T.Group("articles", ("article",), 3), T.Group("topics", ("topic",), 2)]
_BARE = "regexp_replace({0}, chr(39) || 's$', '')"


@query(f"""WITH b AS (SELECT doc_id AS doc, {TOK.format('string_split(text, chr(10))[1]')} AS h, {TOK.format("array_to_string(string_split(text, chr(10))[2:], chr(10))")} AS b FROM documents),
st AS (SELECT count(*) AS total, avg(len(h) + len(b)) AS avglen FROM b), q AS (SELECT item_id AS query, list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS l FROM benchmark),
kq AS (SELECT query, list_transform(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i])[1:12], lambda w: {_BARE.format('w')}) AS words FROM q),
terms AS (SELECT DISTINCT query, unnest({TOK.format("w")}) AS term FROM (SELECT query, unnest(words) AS w FROM kq)),
tk AS (SELECT doc, len(h) + len(b) AS len, 0.2 AS w, unnest(h) AS token FROM b UNION ALL SELECT doc, len(h) + len(b), 1.0, unnest(b) FROM b),
tf AS (SELECT query, term, doc, len, sum(w)::DOUBLE AS f FROM tk JOIN terms ON token = term GROUP BY query, term, doc, len), df AS (SELECT query, term, count(*) AS n FROM tf GROUP BY query, term),
sc AS (SELECT query, doc, round(sum({_BM25}), 6) AS score FROM tf JOIN df USING (query, term), st GROUP BY query, doc),
k AS (SELECT doc_id AS doc, lang, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS tier, list_transform(regexp_extract_all(lower(trim(string_split(text, chr(10))[1])), '[a-z'']+'), lambda w: {_BARE.format('w')}) AS title, doc_id % 40 AS first FROM documents),
g AS (SELECT query, doc, tier, title, first, row_number() OVER (PARTITION BY query, tier ORDER BY score DESC, doc) AS r FROM sc JOIN k USING (doc) QUALIFY r <= CASE tier WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 2 END),
c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, r) AS rank, count(*) OVER (PARTITION BY query) AS n FROM g),
p AS (SELECT query, doc, tier, first, CASE rank WHEN 2 THEN 1 WHEN 9 THEN 2 ELSE 3 END AS place FROM c WHERE n >= 9 AND rank IN (1, 2, 9)), hv AS (SELECT query, tier, count(*) AS have FROM p GROUP BY ALL),
ad AS (SELECT c.query, c.doc, c.tier, c.first, c.rank, CASE c.tier WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END - coalesce(have, 0) AS need FROM c JOIN kq ON kq.query = c.query LEFT JOIN hv ON hv.query = c.query AND hv.tier = c.tier
 WHERE n >= 9 AND rank NOT IN (1, 2, 9) AND len(list_intersect(c.title, words)) >= least(2, len(list_distinct(words))) AND len(list_intersect(c.title, words)) > 0 QUALIFY row_number() OVER (PARTITION BY c.query, c.tier ORDER BY c.rank) <= need),
f AS (SELECT query, doc, tier, first, rank FROM c WHERE n < 9 QUALIFY row_number() OVER (PARTITION BY query, tier ORDER BY rank) <= CASE tier WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END),
u AS (SELECT query, doc, tier, first, 0 AS later, place, true AS selected FROM p UNION ALL SELECT query, doc, tier, first, 1, rank, true FROM ad UNION ALL SELECT query, doc, tier, first, 0, rank, false FROM f)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY tier, later, place) AS place, doc, first, selected FROM u""")
def studied_questions(spark, d):
    """H-01, H-03, H-24: benchmark items as questions: a search for each group, a selector that picks the second, ninth and first of nine and more, minimums and tiers."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    quotas = spark.range(1).select(F.lit("article").alias("kind"), F.lit(2).alias("quota"))
    return T.studied(_study(spark, d), asked, _GROUPS, quotas, lambda prompt: "[2, 9, 1]" if "\n9. " in prompt else "none of them").select("query", "place", "doc", "first", "selected")


@query()
def searched_talks(spark, d):
    """H-26: the same items as talks to prepare: balanced results with the passages of the item's own number pinned; tests compare the parts."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    quotas, study = spark.range(1).select(F.lit("article").alias("kind"), F.lit(2).alias("quota")), _study(spark, d)
    number = F.regexp_extract(F.col("query").cast("string"), "[0-9]+", 0).try_cast("long")
    cited = asked.select("query", number.alias("doc"), F.lit(1).alias("rank")).filter("doc IS NOT NULL")
    pick = lambda prompt: "[2, 9, 1, 4, 5]" if "\n9. " in prompt else "[1]"
    works = study.pieces.filter("kind = 'talk'").select("title", "speaker", "url")
    return T.prepared(study, asked, _GROUPS, quotas, pick, 12, [cited], works, [], {"web": "Web"}).select("query", "place", "doc", "title", "first", "last", "selected")


@query()
def found_directions(spark, d):
    """H-25: themes of talks, articles and topics that a search for each benchmark item finds; a selector picks four."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    quotas = spark.range(1).select(F.lit("article").alias("kind"), F.lit(9).alias("quota"))
    return T.directed(_study(spark, d), asked, quotas, lambda prompt: "[5, 3, 1, 2]")


@query(f"""WITH {_PASSAGES}, q AS (SELECT item_id AS query, {TOK.format('text')}[1:2] AS w FROM benchmark),
g AS (SELECT doc, tok, unnest(list_transform(range(1, len(tok)), lambda i: tok[i:i + 1])) AS gram FROM pas WHERE len(tok) > 1),
tf AS (SELECT query, doc, len(tok) AS len, count(*) AS f FROM g JOIN q ON gram = w WHERE len(w) = 2 GROUP BY query, doc, tok), df AS (SELECT query, count(*) AS n FROM tf GROUP BY query),
sc AS (SELECT query, doc, round({_BM25}, 6) AS score FROM tf JOIN df USING (query), st)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc QUALIFY rank <= 40""")
def phrase_search(spark, d):
    """X-03, X-04: passages with a benchmark item's first two words as a phrase, the best forty."""
    phrases = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.slice(X.tokens(F.col("text")), 1, 2).alias("words")).filter(F.size("words") == 2)
    return S.ranked(S.search_phrase(passage_index(spark, d), phrases), 40)


@query(f"""WITH {_PASSAGES}, {_KEYWORDS}, pre AS (SELECT DISTINCT query, substr(term, 1, 4) AS prefix FROM terms WHERE length(term) >= 4),
tf AS (SELECT query, prefix, doc, len(tok) AS len, count(*) AS f FROM (SELECT doc, tok, unnest(tok) AS token FROM pas) JOIN pre ON substr(token, 1, 4) = prefix GROUP BY query, prefix, doc, tok),
df AS (SELECT query, prefix, count(*) AS n FROM tf GROUP BY query, prefix),
sc AS (SELECT query, doc, round(sum({_BM25}), 6) AS score FROM tf JOIN df USING (query, prefix), st GROUP BY query, doc)
SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc QUALIFY rank <= 10""")
def prefix_or(spark, d):
    """X-12: words that begin like a keyword; a prefix has one document frequency."""
    prefixes = _terms(spark, d).filter(F.length("term") >= 4).select("query", F.substring("term", 1, 4).alias("prefix")).distinct()
    return S.ranked(S.search_prefixes(passage_index(spark, d), prefixes, 4, 10), 10)


@query(f"""{_OR}, cut AS (SELECT query, doc, text, score FROM sc JOIN pas USING (doc) QUALIFY score >= 0.35 * max(score) OVER (PARTITION BY query)),
one AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY query, text ORDER BY score DESC, doc) = 1)
SELECT query, doc, score FROM one QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 20""")
def relative_cutoff(spark, d):
    """T-04: results that score at least 0.35 of the best, each text once, the best twenty."""
    rows = P.passages(table(spark, d, "documents")).select((F.col("doc_id") * 100000 + F.col("pos")).alias("doc"), "text").select("doc", F.unhex(F.sha2("text", 256)).alias("same"))
    scores = S.search_texts(passage_index(spark, d), _terms(spark, d), rows, 20).withColumn("score", F.round("score", 6))
    order = (F.col("score").desc(), F.col("doc"))
    return A.capped(A.capped(A.relative_cutoff(scores, 0.35), ["query", "same"], 1, *order), "query", 20, *order).select("query", "doc", "score")


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM documents), p AS (SELECT doc_id, t, least(nullif(instr(lower(t), 'haha'), 0), nullif(instr(lower(t), 'than'), 0)) AS w FROM f),
s AS (SELECT doc_id, t, CASE WHEN w > 220 THEN greatest(w - 80, 1) ELSE 1 END AS a FROM p), n AS (SELECT doc_id, t, CASE WHEN a > 1 THEN a + instr(substr(t, a, 80), ' ') ELSE a END AS a FROM s)
SELECT doc_id, CASE WHEN a > 1 THEN '… ' ELSE '' END || rtrim(substr(t, a, 220), ' ') || CASE WHEN length(t) > a - 1 + 220 THEN ' …' ELSE '' END AS snippet FROM n""")
def snippets(spark, d):
    """X-09: an excerpt of each document around the first hidden one of two words."""
    return texts(spark, d).select("doc_id", X.snippet(F.col("text"), ["haha", "than"]).alias("snippet"))


@query("""SELECT doc_id, sha256(string_split(text, chr(10))[1] || chr(0) || array_to_string(string_split(text, chr(10))[2:], chr(10))) AS content_hash FROM documents""")
def content_hash(spark, d):
    """V-11: one digest for heading and body."""
    lines = F.split("text", "\n")
    return texts(spark, d).select("doc_id", X.content_hash(F.element_at(lines, 1), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n")).alias("content_hash"))


@query("""WITH RECURSIVE pp AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),
v AS (SELECT doc_id, pos, length(t) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM pp WHERE trim(t) <> ''),
f AS (SELECT doc_id, i, 0 AS "window", pos AS first, pos AS last, n AS size, n AS tail, 1 AS k FROM v WHERE i = 1 UNION ALL
 SELECT v.doc_id, v.i, CASE WHEN k < 3 AND size + v.n <= 2000 THEN f."window" ELSE f."window" + 1 END,
  CASE WHEN k < 3 AND size + v.n <= 2000 THEN f.first WHEN tail + v.n <= 2000 THEN f.last ELSE v.pos END, v.pos,
  CASE WHEN k < 3 AND size + v.n <= 2000 THEN size + v.n WHEN tail + v.n <= 2000 THEN tail + v.n ELSE v.n END, v.n,
  CASE WHEN k < 3 AND size + v.n <= 2000 THEN k + 1 WHEN tail + v.n <= 2000 THEN 2 ELSE 1 END FROM f JOIN v ON v.doc_id = f.doc_id AND v.i = f.i + 1)
SELECT doc_id, "window"::BIGINT AS "window", first::BIGINT AS first, last::BIGINT AS last, size::BIGINT AS n_chars FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, "window" ORDER BY i DESC) = 1""")
def chunk_windows(spark, d):
    """W-03: overlapping windows of paragraphs."""
    return P.windows(P.passages(texts(spark, d)), "doc_id", "pos", "text")


_UNPACKED = """pp AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),
para AS (SELECT doc_id, pos, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM pp WHERE regexp_matches(t, '\\S')),
sen AS (SELECT doc_id, pos, unnest(range(0, len(l))) AS k, unnest(l) AS t FROM (SELECT doc_id, pos, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM para WHERE length(t) > 2000)),
cut AS (SELECT doc_id, pos, k, j, CASE WHEN j > 0 AND j = (length(t) - 1) // 2000 THEN trim(substr(t, 2000 * j + 1, 2000)) ELSE substr(t, 2000 * j + 1, 2000) END AS t FROM (SELECT *, unnest(range(0, (length(t) - 1) // 2000 + 1)) AS j FROM sen)),
atom AS (SELECT doc_id, pos, t, row_number() OVER (PARTITION BY doc_id, pos ORDER BY k, j) AS i FROM cut WHERE t <> ''),
su AS (SELECT doc_id, pos, i, 1 AS unit, t, length(t) AS n FROM atom WHERE i = 1 UNION ALL
 SELECT a.doc_id, a.pos, a.i, CASE WHEN su.n < 2000 AND su.n + 1 + length(a.t) <= 1200 THEN unit ELSE unit + 1 END, CASE WHEN su.n < 2000 AND su.n + 1 + length(a.t) <= 1200 THEN su.t || ' ' || a.t ELSE a.t END,
  CASE WHEN su.n < 2000 AND su.n + 1 + length(a.t) <= 1200 THEN su.n + 1 + length(a.t) ELSE length(a.t) END FROM su JOIN atom a ON a.doc_id = su.doc_id AND a.pos = su.pos AND a.i = su.i + 1),
un AS (SELECT doc_id, pos, 0 AS unit, t FROM para WHERE length(t) <= 2000 UNION ALL SELECT doc_id, pos, unit, t FROM su QUALIFY row_number() OVER (PARTITION BY doc_id, pos, unit ORDER BY i DESC) = 1),
u AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos, unit) AS i FROM un)"""


@query(f"""WITH RECURSIVE {_UNPACKED},
f AS (SELECT doc_id, i, 0 AS passage, t, length(t) AS n FROM u WHERE i = 1 UNION ALL
 SELECT u.doc_id, u.i, CASE WHEN f.n < 1200 AND f.n + 2 + length(u.t) <= 2000 THEN passage ELSE passage + 1 END, CASE WHEN f.n < 1200 AND f.n + 2 + length(u.t) <= 2000 THEN f.t || chr(10) || chr(10) || u.t ELSE u.t END,
  CASE WHEN f.n < 1200 AND f.n + 2 + length(u.t) <= 2000 THEN f.n + 2 + length(u.t) ELSE length(u.t) END FROM f JOIN u ON u.doc_id = f.doc_id AND u.i = f.i + 1)
SELECT doc_id, passage::BIGINT AS passage, n::BIGINT AS n_chars, sha256(t) AS text_sha256 FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, passage ORDER BY i DESC) = 1""")
def passage_pack(spark, d):
    """W-04: paragraphs packed into passages."""
    return P.pack(texts(spark, d)).select("doc_id", F.col("passage").cast("long"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id
WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) <= 10""")
def cosine_topk(spark, d):
    """V-08: the ten nearest vectors of each whose id is divisible by 100."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = V.nearest(rows, rows.filter("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("q")), 10)
    return found.select("query", "id", F.round("score", 4).alias("score"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)
SELECT label::BIGINT AS label, vec_id AS id, score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1""")
def argmax_per_group(spark, d):
    """V-09, V-10: each label's vector closest to the first one."""
    rows = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    joined = rows.crossJoin(F.broadcast(rows.filter("id = 0").limit(1).select(F.col("v").alias("q"))))
    return V.best_per_group(joined, "label", F.col("q")).select(F.col("label").cast("long").alias("label"), "id", "score")


_FUSE = """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
a AS (SELECT query, vec_id AS doc, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) DESC, vec_id) AS rank FROM q JOIN embeddings ON vec_id <> query QUALIFY rank <= 50),
b AS (SELECT query, doc_id AS doc, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, doc_id) AS rank FROM documents, q QUALIFY rank <= 50),
u AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.doc, b.doc) AS doc, a.rank AS ra, b.rank AS rb, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score
 FROM a FULL JOIN b ON a.query = b.query AND a.doc = b.doc),
r AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, ra NULLS LAST, rb NULLS LAST, doc) AS rank FROM u)"""


def _fusion(spark, d):
    from pyspark.sql import Window as W

    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    queries = rows.filter("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    a = V.nearest(rows, queries, 50).withColumnRenamed("id", "doc")
    top = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "n_chars").orderBy(F.col("n_chars").desc(), "doc").limit(50)
    top = top.withColumn("rank", F.row_number().over(W.orderBy(F.col("n_chars").desc(), "doc")).cast("long"))
    return R.fused(a, queries.select("query").crossJoin(F.broadcast(top.select("doc", "rank"))))


@query(f"{_FUSE} SELECT query, doc, score, rank FROM r WHERE rank <= 20")
def rrf_fusion(spark, d):
    """H-01: a vector ranking and one by length, fused."""
    return _fusion(spark, d).filter("rank <= 20").select("query", "doc", "score", "rank")


@query(f"""{_FUSE}, k AS (SELECT r.*, label FROM r JOIN embeddings ON vec_id = doc QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY rank) <= 2)
SELECT query, doc, label::BIGINT AS label, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM k QUALIFY place <= 12""")
def kind_caps(spark, d):
    """H-01, H-02: at most two of a kind, twelve in all."""
    kinds = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("label").cast("long").alias("label"))
    return R.with_quotas(_fusion(spark, d).join(kinds, "doc"), "label", 2, 12).select("query", "doc", "label", "place")


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS work, l_partkey AS reference FROM lineitem), sz AS (SELECT work, count(*) AS refs FROM p GROUP BY work), n AS (SELECT count(*) AS total FROM sz),
df AS (SELECT reference, count(*) AS df FROM p GROUP BY reference), q AS (SELECT o_custkey AS query, o_orderkey AS work, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders),
c AS (SELECT query, work, 1 / greatest(1.0::DOUBLE, sqrt(refs / 15)) / sqrt(rank + 1) AS w FROM q JOIN sz USING (work) WHERE rank < 25),
v AS (SELECT query, reference, sum(w) AS w, count(*) AS works FROM p JOIN c USING (work) GROUP BY query, reference HAVING count(*) >= 2),
s AS (SELECT query, reference, works, round(w * ln(total::DOUBLE / df), 6) AS score FROM v JOIN df USING (reference), n)
SELECT query, reference, works, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, reference) AS rank FROM s QUALIFY rank <= 10""")
def consensus(spark, d):
    """H-08: parts that several of a customer's orders have, weighted by rank and rarity."""
    from pyspark.sql import Window as W

    votes = R.consensus(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("reference")), _ranked_orders(spark, d))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "reference")).cast("long")
    return votes.withColumn("rank", rank).filter("rank <= 10")


def _ranked_orders(spark, d):
    from pyspark.sql import Window as W

    order = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("work"), (F.row_number().over(order) - 1).alias("rank"))


@query("""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM q),
n AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(^|[^\\p{L}])than([^\\p{L}]|$)') THEN 'than' WHEN regexp_matches(text, '(^|[^\\p{L}])que([^\\p{L}]|$)') THEN 'que' END AS value FROM f WHERE turn > first)
SELECT conv_id, max_by(value, turn) AS value, max(turn) AS turn FROM n WHERE value IS NOT NULL GROUP BY conv_id""")
def turn_filters(spark, d):
    """H-05: the filter that a conversation's latest follow-up names."""
    turns = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return R.turn_filters(turns, {"than": r"(?<!\p{L})than(?!\p{L})", "que": r"(?<!\p{L})que(?!\p{L})"})


@query("""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM q),
k AS (SELECT conv_id, turn, CASE WHEN turn = first THEN text ELSE trim(regexp_replace(text, 'haha|than', '', 'g'), ' ') END AS rest FROM f)
SELECT conv_id, string_agg(rest, ' ' ORDER BY turn) AS query FROM k WHERE regexp_matches(rest, '\\p{L}{3}') GROUP BY conv_id""")
def retrieval_query(spark, d):
    """H-06: a conversation's questions as one query."""
    turns = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return R.retrieval_query(turns, "haha|than")


@query("""WITH r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Best: [3, 1, 3, 99] since' WHEN 1 THEN 'none []' WHEN 2 THEN 'no list' ELSE '[' || turn || ', 2]' END AS content FROM conversations),
f AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '3 1' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE CASE WHEN turn BETWEEN 1 AND 10 AND turn <> 2 THEN turn || ' 2' ELSE '2' END END AS picks FROM r)
SELECT conv_id * 1000 + turn AS id, picks IS NULL AS missing, coalesce(list_sum(list_transform(string_split(nullif(picks, ''), ' '), lambda x: x::BIGINT - 1)), 0)::BIGINT AS total, CASE WHEN picks IS NULL THEN -1 WHEN picks = '' THEN 0 ELSE len(string_split(picks, ' ')) END::BIGINT AS n FROM f""")
def selection_parse(spark, d):
    """H-13: numbers in replies; none, an empty list and no list differ."""
    m = F.col("turn") % 4
    content = F.when(m == 0, "Best: [3, 1, 3, 99] since").when(m == 1, "none []").when(m == 2, "no list").otherwise(F.concat(F.lit("["), F.col("turn").cast("string"), F.lit(", 2]")))
    replies = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), content.alias("content"), F.lit(10).alias("n"))
    found = R.parsed_selection(replies)
    total = F.aggregate(F.coalesce("picks", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("id", F.col("picks").isNull().alias("missing"), total.alias("total"), F.coalesce(F.size("picks"), F.lit(-1)).cast("long").alias("n"))


_THEME_STOP = ", ".join(f"'{w}'" for w in X.THEME_STOPWORDS)


@query(f"""WITH RECURSIVE b AS (SELECT o_custkey AS owner, l_orderkey * 10 + l_linenumber AS rank, p_name || ' ' || p_type AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
w AS (SELECT owner, rank, title, list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(lower(title), '[a-z'']+'), lambda x: x NOT IN ({_THEME_STOP})), lambda x: regexp_replace(x, '(''s|s)$', '')), lambda x: x <> 'red'))) AS words FROM b),
one AS (SELECT owner, min((rank, title)) AS t, words FROM w WHERE len(words) > 0 GROUP BY owner, words), n AS (SELECT owner, words, t[2] AS title, row_number() OVER (PARTITION BY owner ORDER BY t, words) AS i FROM one),
f AS (SELECT owner, i, [words] AS kept, [title] AS titles FROM n WHERE i = 1 UNION ALL
 SELECT n.owner, n.i, CASE WHEN c.hit THEN f.kept ELSE f.kept || [n.words] END, CASE WHEN c.hit THEN f.titles ELSE f.titles || [n.title] END FROM f JOIN n ON n.owner = f.owner AND n.i = f.i + 1,
 LATERAL (SELECT len(list_filter(f.kept, lambda k: len(list_intersect(k, n.words)) * 2 >= least(len(k), len(n.words)))) > 0 AS hit) c),
l AS (SELECT owner, titles FROM f QUALIFY row_number() OVER (PARTITION BY owner ORDER BY i DESC) = 1)
SELECT owner, unnest(range(1, len(titles) + 1))::BIGINT AS place, unnest(titles) AS title FROM l""")
def themes(spark, d):
    """H-15: different titles of what each customer bought, in order of purchase."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"))
    parts = R.worded(table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("title")), "red")
    rows = lines.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("owner")), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.themes(rows.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("owner", "rank", "title", "words"), "red")


@query(f"""{_OR}, rel AS (SELECT query, min(rank) AS rank FROM rk JOIN labels ON labels.doc_id = rk.doc // 100000 AND quality = 1 WHERE rank <= 10 GROUP BY query), q AS (SELECT item_id AS query, rank FROM benchmark LEFT JOIN rel ON query = item_id)
SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_10, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_10 FROM q""")
def hit_at_k(spark, d):
    """E-01: hit rates and reciprocal ranks of keyword search, relevance being a quality label."""
    from lectern.operators.quality import retrieval_scores

    found = bm25(spark, d, 10).withColumn("doc_id", F.floor(F.col("doc") / 100000))
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    first = found.join(good, "doc_id", "left_semi").groupBy("query").agg(F.min("rank").alias("rank"))
    return retrieval_scores(table(spark, d, "benchmark").select(F.col("item_id").alias("query")).join(first, "query", "left"))
