"""Compositions from questions to results: H-24 (a study question), H-25 (directions) and H-26 (preparing a talk), each one plan over all questions.

Questions are rows, so a plan answers all of them. Searches read the stored index; what two steps need, the best of each group and the candidates, is written once. The selector is a
function of texts that the caller passes in; where its answer is no use, the best of each tier stand in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import keywords, tokens
from lectern.operators import ranking as R
from lectern.operators import search as S
from lectern.operators import vectors as V
from lectern.operators.analytics import capped
from lectern.operators.stored import StoredIndex
from lectern.operators.workflow import OVERFETCH, labelled
from lectern.storage import written

#: What a piece is, beside its id: `tier` 0 are passages; `topic` names the topic that a key passage stands for, else null.
FIELDS = ("kind", "tier", "volume", "label", "title", "speaker", "url", "text", "chapter", "first", "last", "topic")
PASSAGE = "scripture"


@dataclass(frozen=True)
class Group:
    """H-03: a search of its own: the best `count` of some kinds, and of some volumes if any are named."""

    name: str
    kinds: tuple[str, ...]
    count: int
    volumes: tuple[str, ...] | None = None


@dataclass
class Study:
    """What is searched: pieces (doc and FIELDS), their stored index of heading and body, and their vectors (id, v), if there are any."""

    pieces: DataFrame
    index: StoredIndex
    vectors: DataFrame | None = None


def searched(study: Study, questions: DataFrame, groups: list[Group], quotas: DataFrame, query_vectors: DataFrame | None = None, pinned: DataFrame | None = None) -> DataFrame:
    """H-03: query, doc, place: each question's candidates (query, text): pinned ones (query, doc, rank) first, then each group's best, by words and, with vectors (query, q), by
    meaning, capped by kind (kind, quota). A question without words has candidates by meaning, or pinned ones, alone."""
    terms = questions.select("query", F.explode(keywords(F.col("text"), 12, possessive=True)).alias("w")).select("query", F.explode(tokens(F.col("w"))).alias("term")).distinct()
    kinds = study.pieces.select("doc", "kind", "volume")
    of = [F.col("kind").isin(*g.kinds) & (F.col("volume").isin(*g.volumes) if g.volumes is not None else F.lit(True)) for g in groups]
    members = kinds.select("doc", F.explode(F.array_compact(F.array(*[F.when(own, i) for i, own in enumerate(of)]))).alias("group"))
    scores = written(S.search_groups(study.index, terms, members, [OVERFETCH * g.count for g in groups]))
    parts = []
    for i, (g, own) in enumerate(zip(groups, of, strict=True)):
        found = S.ranked(scores.filter(F.col("group") == i).select("query", "doc", "score"), OVERFETCH * g.count)
        if study.vectors is not None and query_vectors is not None:
            near = V.nearest(study.vectors.join(kinds.filter(own).select(F.col("doc").alias("id")), "id", "left_semi"), query_vectors, OVERFETCH * g.count).withColumnRenamed("id", "doc")
            found = R.fused(near, found)
        kept = R.with_quotas(found.join(kinds.select("doc", "kind"), "doc"), "kind", quotas, g.count)
        parts.append((g.name, g.count, kept.select("query", "doc", F.col("place").alias("rank"))))
    return R.in_groups(parts, pinned).select("query", "doc", F.col("place").cast("long").alias("place"))


def studied(study: Study, questions: DataFrame, groups: list[Group], quotas: DataFrame, select_fn: Callable[[str], str], most: int = 12, query_vectors: DataFrame | None = None,
            pinned: DataFrame | None = None, balance: bool = False, fractions: DataFrame | None = None, least: dict[int, int] | None = None) -> DataFrame:
    """H-24: query, place, doc, kind, tier, first, last, selected: the candidates that the selector picks, by tier.

    Unbalanced, tiers short of their minimum (`least`) are topped up past `most`. Balanced (`most` is 8 or more), passages that rank too low (fractions: query, doc, fraction; the pinned
    ones are cited and may rank lower) go, and H-09 decides; pinned rows with `offered` true are candidates but not favored. Where the selector picks nothing or nothing
    valid, the best of each tier are returned, with `selected` false."""
    if balance and most < 8:
        raise ValueError("a balanced search needs eight places at least")
    least = {1: 2, 2: 1} if least is None else least
    cited = None if pinned is None else pinned.select("query", "doc", "rank")
    found = searched(study, questions, groups, quotas, query_vectors, cited)
    candidates = written(found.withColumnRenamed("place", "rank").join(study.pieces.select("doc", *FIELDS), "doc"))
    picks = written(R.selected(candidates.select("query", "doc", "rank", "tier", "label", "text"), select_fn, most).select("query", "doc", "picked", F.col("place").cast("long").alias("place")))
    chosen = picks.filter("picked").join(candidates.drop("rank"), ["query", "doc"]).withColumnRenamed("place", "rank")
    if balance:
        favored = None if pinned is None else (pinned.filter("NOT coalesce(offered, false)") if "offered" in pinned.columns else pinned).join(study.pieces.select("doc", *FIELDS), "doc")
        if fractions is not None:
            named = cited.select("query", "doc", F.lit(True).alias("is_cited")).distinct() if cited is not None else questions.select("query", F.lit(None).cast(study.pieces.schema["doc"].dataType).alias("doc"), F.lit(False).alias("is_cited"))
            fitting = lambda hits: R.relevant(hits.join(fractions, ["query", "doc"], "left").join(named, ["query", "doc"], "left").withColumn("is_cited", F.coalesce("is_cited", F.lit(False))))
            chosen, favored = fitting(chosen), favored if favored is None else fitting(favored)
        asked = questions.join(picks.filter("picked").select("query").distinct(), "query", "left_semi")
        known = candidates.join(asked.select("query"), "query", "left_semi")
        best = R.balanced(chosen, known, most, asked, None if favored is None else favored.join(asked.select("query"), "query", "left_semi"), least=least)
        best = best.select("query", "doc", "kind", "tier", "first", "last", F.struct(F.lit(0).alias("later"), "place").alias("o"))
    else:
        words = questions.select("query", keywords(F.col("text"), 12, possessive=True).alias("words"))
        own = ["query", "doc", "kind", "tier", "rank", "title", "first", "last", "later"]
        more = candidates.join(chosen.select("query").distinct(), "query", "left_semi").join(words, "query").withColumn("later", F.lit(1))
        both = R.topped_up(chosen.withColumn("later", F.lit(0)).select(*own), more.select(*own, "words"), least, F.col("words"))
        best = both.select("query", "doc", "kind", "tier", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.struct("later", F.col("rank").cast("long").alias("place")).alias("o"))
    rest = picks.filter("NOT picked").join(candidates.select("query", "doc", "kind", "tier", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")), ["query", "doc"])
    rest = rest.select("query", "doc", "kind", "tier", "first", "last", F.struct(F.lit(0).alias("later"), "place").alias("o"), F.lit(False).alias("selected"))
    out = best.withColumn("selected", F.lit(True)).unionByName(rest)
    place = F.row_number().over(W.partitionBy("query").orderBy("tier", "o")).cast("long")
    return out.withColumn("place", place).select("query", "place", "doc", "kind", "tier", "first", "last", "selected")


def trusted(*passages: DataFrame) -> DataFrame:
    """U-06: passages that a talk favors (query, doc, rank), the most trusted list first: what an assigned talk cites, what talks on the topic cite of a lesson's reading, the reading's own
    best, what talks on the topic cite anywhere. Each passage once; rows of a list with `offered` are only offered."""
    rows = None
    for i, p in enumerate(passages):
        offered = F.coalesce("offered", F.lit(False)) if "offered" in p.columns else F.lit(False)
        part = p.select("query", "doc", F.struct(F.lit(i), F.col("rank").cast("long").alias("rank")).alias("o"), offered.alias("offered"))
        rows = part if rows is None else rows.unionByName(part)
    once = rows.groupBy("query", "doc").agg(F.min("o").alias("o"), F.min("offered").alias("offered"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("o", "doc"))).drop("o")


def prepared(study: Study, questions: DataFrame, groups: list[Group], quotas: DataFrame, select_fn: Callable[[str], str], most: int, passages: list[DataFrame], works: DataFrame,
             topic: list[str], marks: dict[str, str], query_vectors: DataFrame | None = None, fractions: DataFrame | None = None) -> DataFrame:
    """H-26: query, place, doc, kind, title, url, first, last, selected: trusted passages (U-06) are pinned, H-24 searches, selects and balances, reprints become the original
    talk (T-08), dictionary entries that the topic doesn't touch go (H-16), volumes are marked (H-17)."""
    found = studied(study, questions, groups, quotas, select_fn, most, query_vectors, trusted(*passages) if passages else None, True, fractions)
    rows = found.withColumnRenamed("place", "rank").join(study.pieces.select("doc", "title", "speaker", "url", "text", "volume", "label"), "doc")
    rows = R.related_words(R.originals(rows, works), topic, "text", F.col("kind") == "lexicon")
    named = F.when(F.col("kind") == PASSAGE, F.col("label")).otherwise(F.col("title"))
    place = F.row_number().over(W.partitionBy("query").orderBy("rank", "doc")).cast("long")
    return rows.withColumn("place", place).select("query", "place", "doc", "kind", labelled(named, F.col("volume"), marks).alias("title"), "url", "first", "last", "selected")


def directed(study: Study, questions: DataFrame, quotas: DataFrame, select_fn: Callable[[str], str], assigned: str = "", topic: str = "", shown: int = 4, most: int = 20, query_vectors: DataFrame | None = None) -> DataFrame:
    """H-25: query, place, title: three searches (talks, articles, topics) give themes; if there are more than are shown, the selector picks, else or without its answer the first ones."""
    groups = [Group("talks", ("talk",), 16), Group("articles", ("article",), 10), Group("topics", ("topic",), 4)]
    found = searched(study, questions, groups, quotas, query_vectors).withColumnRenamed("place", "rank").join(study.pieces.select("doc", "title"), "doc")
    themes = R.themes(found.select(F.col("query").alias("owner"), "rank", "title"), topic).filter(F.lower("title") != assigned.strip().lower())
    order = F.row_number().over(W.partitionBy("owner").orderBy("place"))
    listed = written(themes.withColumn("rank", order).filter(F.col("rank") <= most).select(F.col("owner").alias("query"), F.col("rank").alias("doc"), "rank", F.lit(0).alias("tier"), F.col("title").alias("label"), F.lit("").alias("text")))
    many = listed.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") > shown).select("query")
    picks = R.selected(listed.join(many, "query", "left_semi"), select_fn, shown)
    picked = capped(picks.withColumn("o", F.when(F.col("picked"), F.col("place")).otherwise(F.col("rank"))), "query", shown, F.col("o"))
    few = listed.join(many, "query", "left_anti").withColumn("o", F.col("rank").cast("long"))
    both = picked.select("query", "label", "o").unionByName(few.select("query", "label", "o"))
    return both.select("query", F.row_number().over(W.partitionBy("query").orderBy("o")).cast("long").alias("place"), F.col("label").alias("title"))
