"""Fusion, quotas, consensus and selection (H-*)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import book_key, keywords, reference_parts, theme_words
from lectern.operators.analytics import capped
from lectern.operators.hierarchy import earliest, located
from lectern.storage import apart, written

RRF = 60
#: Owners whose accepted themes may be broadcast.
FEW_OWNERS = 1000


def fused(a: DataFrame, b: DataFrame, k: int = RRF) -> DataFrame:
    """H-01: reciprocal-rank fusion of two rankings (query, doc, rank); ties go by the first ranking, then the second, then doc."""
    x, y = a.select("query", "doc", F.col("rank").alias("rank_a")), b.select("query", "doc", F.col("rank").alias("rank_b"))
    both = x.join(y, ["query", "doc"], "full")
    score = F.coalesce(1 / (k + F.col("rank_a")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("rank_b")), F.lit(0.0))
    both = both.withColumn("score", F.round(score, 9))
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("rank_a").asc_nulls_last(), F.col("rank_b").asc_nulls_last(), "doc")
    return both.withColumn("rank", F.row_number().over(order).cast("long"))


def with_quotas(ranked: DataFrame, kind: str, quotas: DataFrame | int, limit: int) -> DataFrame:
    """H-01, H-02: at most a kind's quota, then the limit, by rank. quotas: kind, quota (kinds not listed are free). Adds place."""
    if isinstance(quotas, int):
        rows = capped(ranked, ["query", kind], quotas, F.col("rank"))
    else:
        rows = ranked.join(quotas.withColumnRenamed("kind", "__kind"), F.col(kind) == F.col("__kind"), "left")
        rows = capped(rows, ["query", kind], F.coalesce("quota", F.lit(2**31 - 1)), F.col("rank")).drop("__kind", "quota")
    place = F.row_number().over(W.partitionBy("query").orderBy("rank")).cast("long")
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def in_groups(searches: list[tuple[str, int, DataFrame]], pinned: DataFrame | None = None) -> DataFrame:
    """H-03, U-06: pinned hits first, then each group's best in the order of groups. Searches are (group, quota, ranked hits: query, doc, rank)."""
    parts = [] if pinned is None else [pinned.select("query", "doc", "rank", F.lit("pinned").alias("group"), F.lit(-1).alias("block"))]
    parts += [hits.filter(F.col("rank") <= quota).select("query", "doc", "rank", F.lit(name).alias("group"), F.lit(i).alias("block")) for i, (name, quota, hits) in enumerate(searches)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = earliest(out, ["query", "doc"], "block", "rank")
    return out.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("block", "rank", "doc")))


def turn_filters(turns: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """H-05: conv_id, turn, text of questions -> the value that the latest follow-up names; the first question never filters."""
    first = F.min("turn").over(W.partitionBy("conv_id"))
    later = turns.withColumn("first", first).filter("turn > first")
    named = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(v)) for v, p in patterns.items()])
    return later.withColumn("value", named).filter("value IS NOT NULL").groupBy("conv_id").agg(F.max_by("value", "turn").alias("value"), F.max("turn").alias("turn"))


def retrieval_query(turns: DataFrame, filters: str) -> DataFrame:
    """H-06: the first question and the follow-ups that say something beside filters, in order, as one text."""
    first = F.min("turn").over(W.partitionBy("conv_id"))
    rest = F.trim(F.regexp_replace(F.col("text"), filters, ""))
    kept = turns.withColumn("first", first).withColumn("rest", F.when(F.col("turn") == F.col("first"), F.col("text")).otherwise(rest)).filter(F.col("rest").rlike(r"\p{L}{3}"))
    listed = F.array_sort(F.collect_list(F.struct("turn", "rest")))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["rest"]), " ").alias("query"))


def consensus(citations: DataFrame, works: DataFrame, top: int = 25, least: int = 2) -> DataFrame:
    """H-08: parts that several of a query's best works cite: query, reference, works, score. citations: work, reference (all works); works: query, work,
    rank from 0, and identity (optional): of works with the same identity, reprints, only the best one counts.

    A work weighs 1 / max(1, sqrt(references / 15)) / sqrt(rank + 1); a reference's score is the sum over its works times ln(all works / works that cite it)."""
    pairs = citations.select("work", "reference").distinct()
    size = pairs.groupBy("work").agg(F.count("*").alias("refs"))
    total = size.agg(F.count("*").alias("total"))
    df = pairs.groupBy("reference").agg(F.count("*").alias("df"))
    chosen = works.filter(F.col("rank") < top).join(size, "work")
    if "identity" in works.columns:
        chosen = earliest(chosen, ["query", "identity"], "rank")
    chosen = chosen.withColumn("w", 1 / F.greatest(F.lit(1.0), F.sqrt(F.col("refs") / 15)) / F.sqrt(F.col("rank") + 1))
    cited = F.broadcast(chosen) if chosen.limit(50_001).count() <= 50_000 else chosen
    votes = pairs.join(cited.select("query", "work", "w"), "work").groupBy("query", "reference").agg(F.sum("w").alias("w"), F.count("*").alias("works")).filter(F.col("works") >= least)
    scored = votes.join(df, "reference").crossJoin(F.broadcast(total))
    return scored.select("query", "reference", "works", F.round(F.col("w") * F.ln(F.col("total") / F.col("df")), 6).alias("score"))


def consensus_passages(votes: DataFrame, verses: DataFrame, volumes: list[str] | None = None, chapters: DataFrame | None = None, without: tuple[str, ...] = (), longest: int = 6, limit: int = 10) -> DataFrame:
    """H-08: what consensus found as passages: references at their place in the earliest volume (not in `without`), kept if in `volumes` and `chapters`
    (chapter_id), neighbouring verses joined up to `longest`; a passage has its best verse's score and works. The best of each query."""
    hit = located(votes, verses, without)
    hit = hit.filter(F.col("volume_slug").isin(volumes)) if volumes is not None else hit
    hit = hit.join(chapters.select("chapter_id"), "chapter_id", "left_semi") if chapters is not None else hit
    own = ["query", "chapter_id"]
    hit = hit.groupBy(*own, "verse").agg(F.max("score").alias("score"), F.max("works").alias("works"))
    hit = hit.withColumn("run", F.col("verse") - F.row_number().over(W.partitionBy(*own).orderBy("verse")))
    hit = hit.withColumn("piece", F.floor((F.row_number().over(W.partitionBy(*own, "run").orderBy("verse")) - 1) / longest))
    spans = hit.groupBy(*own, "run", "piece").agg(F.min("verse").alias("first"), F.max("verse").alias("last"), F.max("score").alias("score"), F.max("works").alias("works"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "chapter_id", "first")).cast("long")
    return spans.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query", "rank", "chapter_id", "first", "last", "score", "works")


def parsed_selection(replies: DataFrame, limit: int = 12) -> DataFrame:
    """H-13, H-21: id, content, n -> picks: the first flat array of numbers in the text as valid different places from 0; null if there is none,
    empty if it is empty."""
    found = F.nullif(F.regexp_extract("content", r"\[\s*(?:-?\d+\s*(?:,\s*-?\d+\s*)*)?\]", 0), F.lit(""))
    numbers = F.from_json(found, "array<int>")
    valid = F.slice(F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= F.col("n")))), 1, limit)
    return replies.select("id", F.when(found.isNotNull(), F.transform(valid, lambda x: x - 1)).alias("picks"))


def candidates_in(content: Column) -> Column:
    """H-21: references in a reply: a JSON array of texts, else whatever looks like one."""
    listed = F.from_json(F.nullif(F.regexp_extract(content, r'\[\s*"(?:[^"\\]|\\.)*"(?:\s*,\s*"(?:[^"\\]|\\.)*")*\s*\]', 0), F.lit("")), "array<string>")
    return F.coalesce(listed, F.regexp_extract_all(content, F.lit(r"(?:[1-4] )?[A-Z][A-Za-z&]+(?: [A-Z&][A-Za-z&]*)* \d+(?::\d+(?:-\d+)?)?"), F.lit(0)))


def resolved(asked: DataFrame, verses: DataFrame, aliases: DataFrame, cap: int = 6) -> DataFrame:
    """H-20, H-22, U-03: owner, rank, text -> the text of each reference that exists, in order, up to cap. verses: volume_sort, book_name, chapter_number,
    verse_number, text; aliases: alias, book. Holes in a range are allowed; whole chapters too; of equal names the earliest volume."""
    parsed = asked.withColumn("p", reference_parts(F.col("text"))).filter("p IS NOT NULL").select("owner", "rank", "text", "p.*")
    named = parsed.withColumn("alias", book_key(F.col("book"))).join(aliases, "alias", "left").withColumn("key", F.coalesce(aliases[aliases.columns[1]], F.col("alias")))
    body = verses.select(book_key(F.col("book_name")).alias("key"), F.col("chapter_number").alias("chapter"), "verse_number", F.col("text").alias("verse"), "volume_sort")
    hit = body.join(named.select("owner", "rank", F.col("text").alias("label"), "key", "chapter", "first", "last"), ["key", "chapter"])
    hit = hit.filter(F.col("first").isNull() | F.col("verse_number").between(F.col("first"), F.coalesce("last", "first")))
    hit = hit.withColumn("v", F.min("volume_sort").over(W.partitionBy("owner", "rank"))).filter("volume_sort = v")
    texts = hit.groupBy("owner", "rank", "label").agg(F.array_sort(F.collect_list(F.struct("verse_number", "verse"))).alias("l"))
    texts = earliest(texts, ["owner", "label"], "rank").withColumn("place", F.row_number().over(W.partitionBy("owner").orderBy("rank")))
    return texts.filter(F.col("place") <= cap).select("owner", "place", "label", F.array_join(F.transform("l", lambda x: x["verse"]), " ").alias("text"))


def worded(titles: DataFrame, topic: str = "") -> DataFrame:
    """H-15: titles without spaces and quotation marks around them, and their `words` without the topic's, in order."""
    bare = titles.withColumn("title", F.trim(F.regexp_replace(F.trim("title"), '^["“”]+|["“”]+$', "")))
    return bare.withColumn("words", F.array_sort(F.array_except(theme_words(F.col("title")), theme_words(F.lit(topic)))))


def themes(titles: DataFrame, topic: str = "", step: int = 200) -> DataFrame:
    """H-15: owner, rank, title -> titles in order, each text once, without those that add no word to the topic's or share half of their words (of the
    smaller set) with an accepted one. Spaces and quotation marks around a title don't count. Titles that many owners have can come with their `words` (`worded`).

    An owner's first `step` titles are folded where they are dealt; that is all for most owners. Of one who has more, only titles that aren't close to one accepted there go on, the first
    of those with the same words: again the first `step` are folded, and only what isn't close to a title accepted so far goes on. No title is left out."""
    bare = (titles if "words" in titles.columns else worded(titles, topic)).filter(F.size("words") > 0)
    close = lambda k, x: F.size(F.array_intersect(k["words"], x["words"])) * 2 >= F.least(F.size(k["words"]), F.size(x["words"]))
    fold = lambda l, start: F.aggregate(l, start, lambda kept, x: F.when(F.exists(kept, lambda k: close(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    order = W.partitionBy("owner").orderBy("rank", "title", "words")
    dealt = bare.select("owner", "rank", "title", "words").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= step + 1)
    first = F.array_sort(F.collect_list(F.when(F.col("n") <= step, F.struct("rank", "title", "words")))).alias("l")
    first = dealt.groupBy("owner").agg(first, (F.max("n") > step).alias("more"))
    first = written(first.select("owner", fold("l", F.slice("l", 1, 0)).alias("kept"), "more"))
    long = first.filter("more").select(F.col("owner").alias("o"), "kept")
    if (owners := long.limit(FEW_OWNERS + 1).count()) > 0:
        beside = (lambda df: F.broadcast(df)) if owners <= FEW_OWNERS else (lambda df: df)
        own, in_order = F.col("owner").eqNullSafe(F.col("o")), F.array_sort(F.collect_list("x")).alias("l")

        def others(rows: DataFrame, accepted: DataFrame) -> DataFrame:
            return rows.join(F.broadcast(accepted) if owners <= FEW_OWNERS else accepted, own).filter(~F.exists("kept", lambda k: close(k, F.col("x")))).select("owner", "x")

        def folded(accepted: DataFrame, rows: DataFrame) -> DataFrame:
            listed = accepted.join(rows.groupBy("owner").agg(in_order), own, "left")
            return listed.select("o", fold(F.coalesce("l", F.slice("kept", 1, 0)), F.col("kept")).alias("kept"))

        rest = others(bare.select("owner", F.struct("rank", "title", "words").alias("x")), long)
        rest = rest.groupBy("owner", F.col("x.words").alias("words")).agg(F.min(F.struct("x.rank", "x.title")).alias("t")).select("owner", F.struct("t.rank", "t.title", "words").alias("x"))
        next_ = folded(long, capped(rest, "owner", step, F.col("x")))
        first = first.filter(~F.col("more")).select("owner", "kept").unionByName(folded(next_, others(rest, next_)).withColumnRenamed("o", "owner"))
    return first.select("owner", F.posexplode("kept").alias("place", "x")).select("owner", (F.col("place") + 1).cast("long").alias("place"), F.col("x.title").alias("title"))


def related_words(rows: DataFrame, topic: list[str], text: str, only: Column | None = None) -> DataFrame:
    """H-16: rows (of those that `only` names, others stay) that share the first six letters of a word with the topic; without topic words all."""
    stems = F.array(*[F.lit(w.lower()[:6]) for w in topic]).cast("array<string>")
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    shared = F.arrays_overlap(F.transform(words, lambda w: F.substring(w, 1, 6)), stems) if topic else F.lit(True)
    return rows.filter(F.coalesce(shared, F.lit(False)) | ~(F.lit(True) if only is None else only))


def topped_up(chosen: DataFrame, candidates: DataFrame, least: dict[int, int], words: list[str] | Column) -> DataFrame:
    """H-07: query, doc, tier, rank, title -> the chosen and, for tiers short of their minimum, the best candidates whose title has enough of the words (a list, or
    an array column of the candidates): two, or the only one."""
    have = chosen.groupBy("query", "tier").agg(F.count("*").alias("have"))
    wanted_words = words if isinstance(words, Column) else F.array(*[F.lit(w) for w in words]).cast("array<string>")
    own = F.transform(F.regexp_extract_all(F.lower("title"), F.lit("[a-z']+"), F.lit(0)), lambda w: F.regexp_replace(w, "'s$", ""))
    shared = F.size(F.array_intersect(own, wanted_words))
    fits = (shared >= F.least(F.lit(2), F.size(F.array_distinct(wanted_words)))) & (shared > 0)
    rest = candidates.join(chosen.select("query", "doc"), ["query", "doc"], "left_anti").filter(fits)
    wanted = F.coalesce(*[F.when(F.col("tier") == t, F.lit(n)) for t, n in least.items()], F.lit(0))
    rest = rest.join(have, ["query", "tier"], "left").withColumn("need", wanted - F.coalesce("have", F.lit(0)))
    return chosen.unionByName(capped(rest, ["query", "tier"], F.col("need"), F.col("rank")).select(*chosen.columns))


def relevant(hits: DataFrame, cut: float = 0.05, cited: float = 0.10) -> DataFrame:
    """H-11: scripture outside the best share of all is left out; what is cited may rank lower; an unknown share counts as 0."""
    most = F.when(F.col("is_cited"), cited).otherwise(cut)
    return hits.filter((F.col("kind") != "scripture") | (F.coalesce("fraction", F.lit(0.0)) <= most))


def same_work(title: str, speaker: str) -> Column:
    """H-10: one key for reprints."""
    return F.struct(F.lower(F.trim(title)).alias("t"), F.lower(F.trim(speaker)).alias("s"))


def originals(results: DataFrame, works: DataFrame) -> DataFrame:
    """T-08: reprints replaced by the original (query, rank, kind, title, speaker, url; works: title, speaker, url), then one row for each url, talks first.
    Results without a url are no works and all stay."""
    w = works.select(same_work("title", "speaker").alias("key"), F.col("url").alias("original"))
    rows = results.withColumn("key", same_work("title", "speaker")).join(earliest(w, ["key"], "original"), "key", "left").withColumn("url", F.when(F.col("url").isNotNull(), F.coalesce("original", "url")))
    rows = rows.drop("key", "original")
    rows = earliest(rows.filter("url IS NOT NULL"), ["query", "url"], "rank").unionByName(rows.filter("url IS NULL"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.when(F.col("kind") == "talk", 0).otherwise(1), "rank")))


def _one_by_one(listed: str, target: int, gap: int, most_span: int) -> Column:
    """The fold of H-09 over an array of passages in the order in which they are offered: one that overlaps a kept one is left out, one within `gap` verses widens
    the first such unless that gets longer than `most_span`, any other is appended. Trusted ones are offered only as long as `target` isn't reached."""
    start, end = lambda x: F.coalesce(x["first"], F.lit(0)), lambda x: F.coalesce(x["last"], F.lit(0))
    overlaps = lambda k, x: (k["chapter"] == x["chapter"]) & (start(k) <= end(x)) & (start(x) <= end(k))
    joined = lambda k, x: {"first": F.least(k["first"], x["first"]), "last": F.greatest(k["last"], x["last"])}

    def near(k: Column, x: Column) -> Column:
        close = (k["chapter"] == x["chapter"]) & (x["first"] <= k["last"] + gap + 1) & (k["first"] <= x["last"] + gap + 1)
        return F.coalesce(close & k["last"].isNotNull() & x["last"].isNotNull() & (joined(k, x)["last"] - joined(k, x)["first"] < most_span), F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: near(k, x)), True)
        wider = F.transform(kept, lambda k, i: F.when(i + 1 == at, k.withField("first", joined(k, x)["first"]).withField("last", joined(k, x)["last"])).otherwise(k))
        out = F.exists(kept, lambda k: F.coalesce(overlaps(k, x), F.lit(False))) | ((x["block"] < CHOSEN) & (F.size(kept) >= target))
        return F.when(out, kept).when(at > 0, wider).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(listed, F.slice(listed, 1, 0), step)


#: The order in which H-09 is offered passages: key passages of a topic that the question names, favored ones, other key passages, the selector's picks.
NAMED, FAVORED, KEY, CHOSEN = range(4)


def balanced(chosen: DataFrame, candidates: DataFrame, limit: int, questions: DataFrame | None = None, favored: DataFrame | None = None, share: float = 0.6, gap: int = 2, most_span: int = 10, least: dict[int, int] | None = None) -> DataFrame:
    """H-09: up to `limit` results a query, about `share` of them (one at least) passages: query, place, doc, kind, tier, chapter, first, last, title, speaker.

    chosen (a selector's picks), candidates and favored: query, doc, kind, tier (0: passages), rank, chapter, first, last, title, speaker, topic (of a key passage, else
    null); questions: query, text. Passages are taken in the order above; a candidate that is neither chosen, favored nor a key passage never is. Other works are the
    chosen ones and what tiers need to their minimum (`least`), by tier, without articles that reprint a chosen talk or one listed before. Each part leaves what it
    doesn't need to the other. A query's passages are folded as one array: they are few, five times the limit at most in H-01."""
    target = max(1, round(limit * share))
    fields = ["query", "doc", "kind", "tier", "rank", "chapter", "first", "last", "title", "speaker"]
    asked = questions.select("query", F.lower("text").alias("q"), keywords(F.col("text"), 12, possessive=True).alias("words")) if questions is not None else chosen.select("query").distinct().select("query", F.lit("").alias("q"), F.array().cast("array<string>").alias("words"))
    known = candidates.join(asked, "query", "left")
    topic = known.filter("tier = 0 AND topic IS NOT NULL")
    keys = topic.select(*fields, F.when(F.coalesce(F.contains("q", F.lower("topic")), F.lit(False)), NAMED).otherwise(KEY).alias("block"))
    offered = keys.unionByName(chosen.filter("tier = 0").select(*fields, F.lit(CHOSEN).alias("block")))
    if favored is not None:
        offered = offered.unionByName(favored.filter("tier = 0").select(*fields, F.lit(FAVORED).alias("block")))
    listed = offered.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("block", "rank", "doc", *[F.col(c).cast("long").alias(c) for c in ("first", "last")], *[c for c in fields[2:] if c not in ("rank", "first", "last")]))).alias("l"))
    passages = listed.select("query", F.posexplode(_one_by_one("l", target, gap, most_span)).alias("i", "x")).select("query", "i", "x.*").drop("block", "rank").withColumn("part", F.lit(0))

    others = topped_up(chosen.filter("tier <> 0").select(*fields, F.lit(0).alias("later")), known.filter("tier <> 0").select(*fields, F.lit(1).alias("later"), "words"), {1: 2, 2: 1} if least is None else least, F.col("words"))
    same = W.partitionBy("query", F.lower(F.trim("title")), F.lower(F.trim("speaker")))
    order = F.struct("later", (F.col("later") * F.col("tier")).alias("added"), "rank", "doc")
    talk = F.min(F.when(F.col("kind") == "talk", order)).over(same)
    reprint = (F.col("kind") == "article") & F.coalesce((talk["later"] == 0) | (talk < order), F.lit(False))
    rest = others.withColumn("reprint", reprint).filter("NOT reprint")
    rest = rest.withColumn("i", F.row_number().over(W.partitionBy("query").orderBy("tier", "later", "rank", "doc")) - 1)
    both = passages.unionByName(rest.select("query", "i", "doc", "first", "last", "kind", "tier", "chapter", "title", "speaker", F.lit(1).alias("part")))
    of = lambda part: F.coalesce(F.count(F.when(F.col("part") == part, 1)).over(W.partitionBy("query")), F.lit(0))
    counted = both.withColumn("passages", of(0)).withColumn("others", of(1))
    others_kept = F.least(F.col("others"), limit - F.least(F.col("passages"), F.lit(target)))
    passages_kept = F.least(F.col("passages"), limit - others_kept)
    kept = counted.filter(F.when(F.col("part") == 0, F.col("i") < passages_kept).otherwise(F.col("i") < others_kept))
    place = F.row_number().over(W.partitionBy("query").orderBy("part", "i")).cast("long")
    return kept.withColumn("place", place).select("query", "place", "doc", "kind", "tier", "chapter", "first", "last", "title", "speaker")


def _listed(hits: DataFrame, chars: int = 300) -> DataFrame:
    """query, prompt, n: the list of H-12 and the number of its lines."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("label"), F.lit(": "), F.substring("text", 1, chars))
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("query").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("prompt"), F.count("*").alias("n"))


def candidate_list(hits: DataFrame, chars: int = 300) -> DataFrame:
    """H-12: the numbered list that an external selector reads. hits: query, rank, label, text."""
    return _listed(hits, chars).drop("n")


def selected(hits: DataFrame, select_fn: Callable[[str], str], limit: int = 12) -> DataFrame:
    """H-24, H-27: asks the selector (a text in, a text out) for each query; without a usable answer, or if it picks none, the best (4, 2, 1, 1) of the tiers stand in,
    and `picked` is false. hits: query, doc, rank (from 1), tier, label, text."""
    ask = F.pandas_udf(lambda prompts: prompts.map(select_fn), "string")
    hits = apart(hits, "query")
    replies = _listed(hits).select(F.col("query").alias("id"), ask("prompt").alias("content"), "n")
    picks = parsed_selection(replies, limit)
    known = hits.join(picks.withColumnRenamed("id", "query"), "query").withColumn("picked", F.coalesce(F.size("picks") > 0, F.lit(False)))
    chosen = known.filter("picked").withColumn("place", F.array_position("picks", (F.col("rank") - 1).cast("int"))).filter("place > 0")
    quota = F.element_at(F.array(*[F.lit(x) for x in (4, 2, 1, 1)]), F.least(F.col("tier"), F.lit(3)).cast("int") + 1)
    rest = capped(known.filter("NOT picked"), ["query", "tier"], quota, F.col("rank"))
    rest = rest.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("tier", "rank")).cast("long"))
    return chosen.unionByName(rest).drop("picks")
