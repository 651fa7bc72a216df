"""Compositions: from a question to results (H-01, H-04, H-14, H-17, H-18, H-23 to H-26, E-04), device sync (D-02, D-03), calendar texts (F-02, F-03)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import keywords, ordinal, tokens
from lectern.operators import merge as M
from lectern.operators import ranking as R
from lectern.operators import search as S
from lectern.operators import vectors as V
from lectern.operators.analytics import capped, merge_lists
from lectern.operators.stored import StoredIndex

OVERFETCH = 5


def hybrid(pieces: DataFrame, queries: DataFrame, quotas: DataFrame, limit: int, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, windows: DataFrame | None = None, index: StoredIndex | None = None) -> DataFrame:
    """H-01: pieces (doc, kind, heading, body) for queries (query, text): keyword and, if there are vectors (id, v; query, q), semantic rankings of five times the
    limit, fused; with `windows` (doc, book, chapter, first, last) overlapping or touching ones are one result; capped by kind. Without vectors it is keyword search alone. `index`
    is the stored index of heading (weight 0.2) and body; without it one is made. A question of stop words alone has no keyword results."""
    terms = queries.select("query", F.explode(keywords(F.col("text"), 12, possessive=True)).alias("w")).select("query", F.explode(tokens(F.col("w"))).alias("term")).distinct()
    index = S.indexed(pieces, "doc", {"heading": 0.2, "body": 1.0}) if index is None else index
    words = S.ranked(S.search_any(index, terms, OVERFETCH * limit), OVERFETCH * limit)
    if vectors is None:
        both = words.select("query", "doc", F.col("rank").cast("long").alias("rank"), "score")
    else:
        near = V.nearest(vectors, query_vectors, OVERFETCH * limit).withColumnRenamed("id", "doc")
        both = R.fused(near, words)
    both = both.join(pieces.select("doc", "kind"), "doc")
    return R.with_quotas(both, "kind", quotas, limit) if windows is None else consolidated(both.join(windows, "doc", "left"), quotas, limit)


def consolidated(ranked: DataFrame, quotas: DataFrame, limit: int) -> DataFrame:
    """H-01, W-05: ranked hits (query, rank, doc, kind, book, chapter, first, last; a null first: no window) -> query, place, doc, kind, first, last.

    In rank order: a window that overlaps or touches an accepted one of its (book, chapter) widens the first such and takes no place; what is
    left is accepted while its kind's quota (kind, quota; others are free) and the limit allow. A query's candidates are at most ten times the limit,
    so they are folded as one array."""
    quota = quotas.select("kind", F.col("quota").cast("long").alias("quota"))
    rows = ranked.join(F.broadcast(quota) if quota.limit(1001).count() <= 1000 else quota, "kind", "left")
    fields = ["rank", "doc", "kind", F.coalesce("quota", F.lit(2**31)).alias("quota"), "book", "chapter", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")]
    listed = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("l"))
    touches = lambda k, x: F.coalesce((k["book"] == x["book"]) & (k["chapter"] == x["chapter"]) & (x["first"] <= k["last"] + 1) & (x["last"] >= k["first"] - 1), F.lit(False))

    def step(kept, x):
        at = F.array_position(F.transform(kept, lambda k: touches(k, x)), True)
        wider = F.transform(kept, lambda k, i: F.when(i + 1 == at, k.withField("first", F.least(k["first"], x["first"])).withField("last", F.greatest(k["last"], x["last"]))).otherwise(k))
        full = F.size(F.filter(kept, lambda k: k["kind"] == x["kind"])) >= x["quota"]
        return F.when(F.size(kept) >= limit, kept).when(at > 0, wider).when(full, kept).otherwise(F.concat(kept, F.array(x)))

    fold = F.aggregate("l", F.slice("l", 1, 0), step)
    return listed.select("query", F.posexplode(fold).alias("place", "x")).select("query", (F.col("place") + 1).cast("long").alias("place"), "x.doc", "x.kind", "x.first", "x.last")


def prepared_talk(pinned: DataFrame, found: DataFrame, works: DataFrame, topic: list[str], marks: dict[str, str], limit: int) -> DataFrame:
    """H-26: pinned and then found hits (query, rank, kind, title, speaker, url, text, volume) up to the limit, reprints replaced by originals, words of the
    lexicon that the topic doesn't touch left out, volumes marked in the title."""
    both = pinned.withColumn("block", F.lit(0)).unionByName(found.withColumn("block", F.lit(1)))
    order = W.partitionBy("query").orderBy("block", "rank")
    rows = both.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit).drop("block")
    rows = R.related_words(R.originals(rows, works), topic, "text", F.col("kind") == "lexicon")
    return rows.withColumn("title", labelled(F.col("title"), F.col("volume"), marks))


def evaluated(rankings: dict[str, DataFrame], wanted: DataFrame, queries: DataFrame) -> DataFrame:
    """E-04: several rankings (query, rank, book, chapter, first, last) of the same queries, each scored by whether its hits cover a wanted verse."""
    from lectern.operators import quality as Q

    out = None
    for name, hits in rankings.items():
        first = Q.covers(hits, wanted).groupBy("query").agg(F.min("rank").alias("rank"))
        scores = Q.retrieval_scores(queries.select("query").join(first, "query", "left")).withColumn("ranking", F.lit(name))
        out = scores if out is None else out.unionByName(scores)
    return out


def key_passages(topics: DataFrame, passages: DataFrame, found: DataFrame, topics_each: int = 3, passages_each: int = 3) -> DataFrame:
    """H-04: query, topic, rank and topic, position, book, chapter, first, last -> up to three passages of the three best topics that overlap neither what
    was found (query, book, chapter, first, last) nor an earlier one of theirs."""
    chosen = topics.filter(F.col("rank") <= topics_each).join(passages.filter(F.col("position") <= passages_each), "topic")
    seen = found.select("query", "book", "chapter", F.col("first").alias("f"), F.col("last").alias("l"))
    fresh = chosen.join(seen, (chosen["query"] == seen["query"]) & (chosen["book"] == seen["book"]) & (chosen["chapter"] == seen["chapter"]) & (F.col("first") <= F.col("l")) & (F.col("last") >= F.col("f")), "left_anti")
    listed = fresh.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "position", "topic", "book", "chapter", "first", "last"))).alias("p"))
    clash = lambda k, x: (k["book"] == x["book"]) & (k["chapter"] == x["chapter"]) & (k["first"] <= x["last"]) & (k["last"] >= x["first"])
    kept = F.aggregate("p", F.slice("p", 1, 0), lambda a, x: F.when(F.exists(a, lambda k: clash(k, x)), a).otherwise(F.concat(a, F.array(x))))
    return listed.select("query", F.posexplode(kept).alias("place", "x")).select("query", (F.col("place") + 1).alias("place"), "x.topic", "x.book", "x.chapter", "x.first", "x.last")


def results(hits: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """H-14: hits (query, place, kind, key) with label and text read again from each kind's table (key, label, text); what isn't there any more is dropped."""
    out = None
    for kind, rows in sources.items():
        part = hits.filter(F.col("kind") == kind).join(rows.select("key", "label", "text"), "key").select("query", "place", "kind", "key", "label", "text")
        out = part if out is None else out.unionByName(part)
    return out


def labelled(label: Column, volume: Column, marks: dict[str, str]) -> Column:
    """H-17, F-24: a volume's mark before the label."""
    mark = F.coalesce(*[F.when(volume == v, F.lit(m)) for v, m in marks.items()], F.lit(None).cast("string"))
    return F.concat_ws(" ", mark, label)


@dataclass
class Request:
    """H-18: what someone prepares, and what follows for the search."""

    topic: str = ""
    lesson: bool = False
    minutes: int | None = None
    reading: str = ""
    talk_title: str = ""
    directions: list[str] = field(default_factory=list)
    volumes: set[str] | None = None
    without: frozenset[str] = frozenset()
    by_length: dict[int, int] = field(default_factory=lambda: {5: 8, 10: 12, 15: 16, 20: 20})

    def limit(self, default: int = 12) -> int:
        return default if self.lesson or self.minutes is None else self.by_length.get(self.minutes, default)

    def questions(self) -> list[str]:
        first = self.topic.strip() or self.talk_title or self.reading
        rest = [self.talk_title if self.talk_title not in first else "", *self.directions]
        return [q for q in [first, *rest] if q]


def requests(rows: DataFrame, directions: list[str]) -> DataFrame:
    """H-18: rows (topic, lesson, minutes, talk_title, reading) with `results`, how many the request asks for, and its `questions`. Nulls are nothing."""

    def asked(topics: pd.Series, lessons: pd.Series, minutes: pd.Series, titles: pd.Series, readings: pd.Series) -> pd.DataFrame:
        made = [Request(t or "", bool(lesson), None if pd.isna(m) else int(m), r or "", title or "", directions) for t, lesson, m, title, r in zip(topics, lessons, minutes, titles, readings, strict=True)]
        return pd.DataFrame({"results": [m.limit() for m in made], "questions": [m.questions() for m in made]})

    udf = F.pandas_udf(asked, "results int, questions array<string>")
    return rows.withColumn("__r", udf("topic", "lesson", "minutes", "talk_title", "reading")).select("*", "__r.*").drop("__r")


def directions(found: DataFrame, topic: str, select_fn: Callable[[str], str], picks: int = 4) -> DataFrame:
    """H-25: query, rank, title of a broad search -> different themes of which the selector picks some; else the first ones."""
    shown = R.themes(found.select(F.col("query").alias("owner"), "rank", "title"), topic).withColumnsRenamed({"owner": "query", "place": "rank"})
    hits = shown.select("query", F.col("rank").alias("doc"), "rank", F.lit(0).alias("tier"), F.col("title").alias("label"), F.lit("").alias("text"))
    return capped(R.selected(hits, select_fn, picks), "query", picks, F.col("place")).select("query", "place", F.col("label").alias("title"))


def answered(replies: DataFrame, verses: DataFrame, aliases: DataFrame, supplement: DataFrame, cap: int = 6) -> DataFrame:
    """H-23, U-02: replies (owner, content) of a model as references that exist, topped up with search results (owner, rank, id, label), none twice."""
    asked = replies.select("owner", F.posexplode(R.candidates_in(F.col("content"))).alias("rank", "text"))
    own = R.resolved(asked, verses, aliases, cap).select("owner", F.col("place").cast("long").alias("rank"), F.col("label").alias("id"), "label")
    more = supplement.select("owner", (F.col("rank") + 1000).cast("long").alias("rank"), F.col("id").cast("string").alias("id"), "label")
    return merge_lists(own.unionByName(more), cap)


def synced(local: DataFrame, devices: DataFrame, targets: DataFrame, at: str = "updated_at") -> DataFrame:
    """D-01 to D-03: local and devices' records (target, updated_at, file, pos, ...) -> the new state; of the devices' records only those whose target exists
    (targets: target) count, the latest for each, and only if later than the local one."""
    known = devices.join(targets.select("target"), "target", "left_semi")
    newest = M.last_write_wins(known, ["target"], at, "file", "pos").drop("file", "pos")
    return M.merge_into(local, newest.select(*local.columns), ["target"], at)


def day_notes(days: DataFrame, holy: DataFrame) -> DataFrame:
    """F-02: id, month, day and month, place, name, first, last (nullable) -> id and a sentence for each holy day of the month that is there or still to come."""
    rows = days.join(holy.filter("first IS NOT NULL"), "month").withColumn("end", F.coalesce("last", "first"))
    gap = F.col("first") - F.col("day")
    text = (
        F.when((F.col("first") == F.col("day")) & (F.col("end") == F.col("day")), F.concat(F.lit("This is the day of "), F.col("name"), F.lit(".")))
        .when(F.col("day").between(F.col("first"), F.col("end")), F.concat(F.lit("This is during "), F.col("name"), F.lit(".")))
        .when(gap > 0, F.concat(F.upper(F.substring("name", 1, 1)), F.substring("name", 2, 200), F.lit(" falls "), gap.cast("string"), F.when(gap == 1, " day").otherwise(" days"), F.lit(" later, on the "), ordinal(F.col("first")), F.lit(".")))
    )
    listed = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("place", text.alias("t")))))
    notes = rows.groupBy("id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias("note"))
    return days.select("id", "month", "day").join(notes, "id", "left").withColumn("note", F.coalesce("note", F.lit("")))


def month_notes(months: DataFrame, holy: DataFrame) -> DataFrame:
    """F-03: month, names (array), season -> month and a text with its names, season and holy days."""
    days = F.concat(F.col("name"), F.when(F.col("first").isNotNull(), F.concat(F.lit(" ("), F.concat_ws("-", F.col("first").cast("string"), F.when(F.col("last") != F.col("first"), F.col("last")).cast("string")), F.lit(")"))).otherwise(""))
    listed = holy.groupBy("month").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", days.alias("t")))), lambda x: x["t"]), ", ").alias("days"))
    head = F.concat(F.lit("The "), ordinal(F.col("month")), F.lit(" month ("), F.array_join("names", "; later "), F.lit(") - "), F.col("season"))
    return months.join(listed, "month", "left").select("month", F.concat_ws("\n", head, "days").alias("note"))


def versioned(path: str, version: int) -> str:
    """S-26: a derived table's place; another version is another place, so an old one is never read."""
    return f"{path.rstrip('/')}/v{version}"


def joined_vectors(pieces: DataFrame, vectors: DataFrame) -> DataFrame:
    """S-27: pieces with their vectors, by content hash."""
    return pieces.join(vectors, "content_hash")


def reindexed(postings: DataFrame, changed: DataFrame, doc: str, text: str) -> DataFrame:
    """X-01, X-11: postings after edits: those of changed documents (null text: deleted) are made anew, others stay."""
    rest = postings.join(changed.select(F.col(doc).alias("doc")).distinct(), "doc", "left_anti")
    return rest.unionByName(S.postings(changed.filter(F.col(text).isNotNull()), doc, text).select(*postings.columns))


def first_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """P-07: the first row of each key."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")
