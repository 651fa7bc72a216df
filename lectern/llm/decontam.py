"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

The terms that stand in benchmark windows are counted over all training documents. A window can only occur
where its rarest term stands, so postings (document, position) are stored for the rarest terms alone, each
with the terms around it. Windows are looked up by that term, the start is the posting's position less the
term's offset in the window, and a window is found if all its other terms stand at their offsets.
Windows with a term that no document has are dropped unread.

Terms are read in blocks of ANCHORS, so a benchmark of any size is searched exactly, in more passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_ROWS, checkpointed, lookup, packed

#: Words are ASCII digits and letters, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
#: Rarest terms that are looked for in one pass.
ANCHORS = 4000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "".join(c for c in map(chr, range(0x80)) if not c.isalnum())


def words(text: Column) -> Column:
    """The words of a text with A to Z lower-cased; none for null. Other signs of ASCII are turned into spaces, of which texts are cut: many times
    faster than matching words one by one."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def windows_of(items: DataFrame, length: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row per different window of the items: win (its words) and items (the ids that have it)."""
    split = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    every = F.when(F.size("w") <= length, F.array("w")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1))), lambda i: F.slice("w", i, length))
    )
    return split.select("item", F.explode(every).alias("win")).groupBy("win").agg(F.collect_set("item").alias("items"))


def anchored(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """Windows of which all terms occur in `docs`, with term, their rarest one, and at, its offset."""
    terms = windows.select("win", F.posexplode("win").alias("at", "term"))
    wanted = checkpointed(terms.select("term").distinct())
    tokens = docs.select(F.explode(words(F.col(text_col))).alias("token"))
    if wanted.count() <= BROADCAST_ROWS:
        counts = tokens.join(F.broadcast(wanted), F.col("token") == F.col("term")).groupBy("term").count()
    else:
        counts = tokens.groupBy("token").count().join(wanted, F.col("token") == F.col("term")).select("term", "count")
    counts = checkpointed(counts).withColumnRenamed("term", "t")
    rated = terms.join(counts, terms["term"] == counts["t"], "left").groupBy("win").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "at", "term")).alias("rarest")
    )
    rated = rated.filter("rarest.n > 0").select(F.col("win").alias("own"), "rarest.term", "rarest.at")
    return windows.join(rated, F.col("win") == F.col("own")).drop("own")


def reaches(windows: DataFrame) -> DataFrame:
    """Anchored windows -> term, reach: how many words around it its windows need at most."""
    return windows.groupBy("term").agg(F.max(F.greatest("at", F.size("win") - 1 - F.col("at"))).alias("reach"))


def postings(docs: DataFrame, terms: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, text_hash, n_words and found, its postings of the terms: term, pos (from 0), and
    near, as many words around it as `terms` says (term -> reach), the first of which stands at `first`."""
    listed: dict[int, list[str]] = {}
    for term, reach in terms.items():
        listed.setdefault(reach, []).append(f"'{term}'")
    cases = " ".join(f"WHEN x IN ({', '.join(words)}) THEN struct(i AS at, {reach} AS reach)" for reach, words in sorted(listed.items()))
    split = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
    known = ", ".join(f"'{t}'" for t in terms)
    places = F.expr(f"filter(transform(w, (x, i) -> if(x IN ({known}), CASE {cases} END, null)), p -> p IS NOT NULL)") if terms else F.expr("cast(array() as array<struct<at:int,reach:int>>)")
    at = split.select("doc_id", "text_hash", "w", places.alias("places"))

    def one(p: Column) -> Column:
        first = F.greatest(p["at"] - p["reach"], F.lit(0))
        return F.struct(F.element_at("w", p["at"] + 1).alias("term"), p["at"].alias("pos"), first.alias("first"), F.slice("w", first + 1, p["at"] - first + p["reach"] + 1).alias("near"))

    return at.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.transform("places", one).alias("found"))


def matches(found: DataFrame, windows: DataFrame, n_windows: int) -> DataFrame:
    """Postings and anchored windows -> doc_id, text_hash, start, length, items of each exact occurrence."""
    rows = found.select("doc_id", "text_hash", F.explode("found").alias("p")).select("doc_id", "text_hash", "p.*")
    pairs = lookup(rows, windows.select("term", "at", "win", "items"), ["term"], F.col("pos"), n_windows).filter("win IS NOT NULL")
    start = F.col("pos") - F.col("at")
    same = (start >= 0) & (F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.size("win")) == F.col("win"))
    return pairs.filter(same).select("doc_id", "text_hash", start.alias("start"), F.size("win").alias("length"), "items")


def near_matches(docs: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """Proximity search: phrases (phrase_id, text) whose words stand in a document, in order, with at most `slop` words
    between two of them. Returns doc_id, phrase_id, start of each place where the rarest word allows that (from 0, by that word).
    Null and empty documents and phrases match nothing; equal matches of repeated rows are one; empty tables give no rows."""
    items = phrases.select("phrase_id", words(F.col("text")).alias("win")).filter(F.size("win") > 0)
    longest = items.agg(F.max(F.size("win"))).first()[0] or 0
    known = anchored(docs, items.select("win").distinct()).join(items.withColumnRenamed("win", "w2"), F.col("win") == F.col("w2")).drop("w2")
    known = checkpointed(known)
    reach = max(1, (longest - 1) * (slop + 1))
    out = None
    for terms in _blocks(known):
        found = postings(docs, dict.fromkeys(terms, reach)).select("doc_id", F.explode("found").alias("p")).select("doc_id", "p.*")
        pairs = lookup(found, known.select("term", "at", "win", "phrase_id"), ["term"], F.col("pos")).filter("win IS NOT NULL")
        own = F.col("pos") - F.col("first")

        def chain(order: Column, step: int) -> Column:
            """Places reachable from the rarest word over the words in `order`, forwards or backwards."""
            nearby = lambda at, word: F.filter(F.sequence(at + step, at + step * (slop + 1), F.lit(step)), lambda q: (q >= 0) & (q < F.size("near")) & (F.get("near", q) == word))
            return F.aggregate(order, F.array(own), lambda places, word: F.array_distinct(F.flatten(F.transform(places, lambda at: nearby(at, word)))))

        after = F.slice("win", F.col("at") + 2, F.size("win"))
        before = F.reverse(F.slice("win", 1, F.col("at")))
        hit = pairs.filter((F.size(chain(after, 1)) > 0) & (F.size(chain(before, -1)) > 0)).select("doc_id", "phrase_id", F.col("pos").alias("start"))
        out = hit if out is None else out.union(hit)
    return out.distinct() if out is not None else docs.join(items, F.lit(False)).select("doc_id", "phrase_id", F.lit(0).alias("start"))


def _blocks(windows: DataFrame):
    """The anchor terms with their reaches, dealt by hash into blocks of about ANCHORS."""
    terms = checkpointed(reaches(windows))
    blocks = max(1, -(-terms.count() // ANCHORS))
    for k in range(blocks):
        block = {r["term"]: r["reach"] for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).collect()}
        if block:
            yield block


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of `docs`: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is WINDOW words of an item in a row, or all of a shorter one. Words inside its occurrences are hit.
    Items without words have no windows; items with equal ids are one; an item with a null id hits but isn't listed.
    Null texts have no words. Repeated rows get equal results. Empty tables are no error: without items nothing is hit.
    Extra columns aren't read.
    """
    windows = checkpointed(anchored(docs, checkpointed(windows_of(items)), text_col))
    n, table, hits = windows.count(), None, None
    for terms in _blocks(windows) if n else [{}]:
        found = checkpointed(postings(docs, terms, id_col, text_col))
        table = found.drop("found") if table is None else table
        if terms:
            own = matches(found, windows, n)
            hits = own if hits is None else hits.union(own)
    if hits is None:
        hits = table.select("doc_id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("length"), F.expr("cast(array() as array<string>)").alias("items")).filter("false")
    hits = checkpointed(hits)
    key = ["doc_id", "text_hash"]
    spans = hits.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = W.partitionBy(*key).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    covered = spans.select(*key, fresh.alias("fresh")).groupBy(*key).agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = hits.select(*key, F.explode("items").alias("item")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("ids"))
    both = covered.join(named.select(*[F.col(k).alias(f"n_{k}") for k in key], "ids"), [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in key], "left")
    both = both.select(*[F.col(k).alias(f"h_{k}") for k in key], "n_hit", "ids")
    out = table.join(both, [table[k].eqNullSafe(both[f"h_{k}"]) for k in key], "left")
    hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("ids", F.expr("cast(array() as array<string>)"))
    return out.select(
        *key, "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that aren't contaminated, with all their columns. Null and empty texts stay; repeated rows stay or go together; null
    ids are compared like others; empty tables are no error."""
    bad = checkpointed(contamination(docs, items, id_col, text_col).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    rows = packed(docs, own_id=docs[id_col], own_hash=F.xxhash64(docs[text_col]))
    return rows.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_hash") == F.col("bad_hash")), "left_anti").select("row.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) <= {WINDOW} THEN [w] ELSE list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: w[i:i + {WINDOW - 1}]) END) AS win
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS size FROM win),
spots AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, s, size, item_id FROM spots JOIN win ON spots.w[s:s + size - 1] = win.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
