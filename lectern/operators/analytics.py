"""Aggregations, order-dependent operators, top-k and set operations (A-*, W-*, T-*, U-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.storage import apart, written

#: Groups (kinds, languages) whose figures may be sent to all tasks.
FEW_GROUPS = 10_000


def recent_distinct(rows: DataFrame, owner: str, item: str, at: str, k: int) -> DataFrame:
    """A-01: the k most recently seen different items of each owner."""
    last = rows.groupBy(owner, item).agg(F.max(at).alias("last_at"))
    return last.withColumn("rank", F.row_number().over(W.partitionBy(owner).orderBy(F.col("last_at").desc(), item)).cast("long")).filter(F.col("rank") <= k)


def verse_counts(chapters: DataFrame, verses: DataFrame, key: str, number: str) -> DataFrame:
    """A-02: the highest verse number of each chapter, 0 without verses. Aggregated before the join."""
    most = verses.groupBy(key).agg(F.max(number).alias("verses"))
    return chapters.select(key).join(most, key, "left").select(key, F.coalesce("verses", F.lit(0)).cast("long").alias("verses"))


def relative_cutoff(scores: DataFrame, share: float = 0.35) -> DataFrame:
    """T-04: results (query, score) that score at least `share` of their query's best."""
    return scores.withColumn("__best", F.max("score").over(W.partitionBy("query"))).filter(F.col("score") >= share * F.col("__best")).drop("__best")


def close_names(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """F-12, S-14: names a and b under the same keys that differ in one letter of six at most: keys, a, b, distance."""
    pairs = a.join(b, keys).withColumn("distance", F.levenshtein("a", "b").cast("long"))
    return pairs.filter(F.col("distance") <= F.greatest(F.lit(1), F.floor(F.length("a") / 6)))


def islands(days: DataFrame, owner: str, day: str) -> DataFrame:
    """W-01, W-02: runs of consecutive days of each owner: first_day, last_day, length. Days may repeat."""
    numbered = days.select(owner, F.col(day).alias("d")).distinct().withColumn("n", F.row_number().over(W.partitionBy(owner).orderBy("d")))
    return numbered.groupBy(owner, F.date_sub("d", F.col("n")).alias("run")).agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("length")).drop("run")


def streak(days: DataFrame, owner: str, day: str, today: DataFrame) -> DataFrame:
    """W-01: length of the run that ends today or yesterday, else 0. today: one row, column today."""
    runs = islands(days, owner, day).crossJoin(F.broadcast(today.limit(1)))
    return runs.groupBy(owner).agg(F.coalesce(F.max(F.when(F.datediff("today", "last_day").between(0, 1), F.col("length"))), F.lit(0)).alias("streak"))


def split_islands(numbers: DataFrame, owner: str, number: str, most: int) -> DataFrame:
    """W-02: runs of consecutive numbers, cut after `most`: owner, first, last, n."""
    rows = numbers.select(owner, F.col(number).cast("long").alias("x")).distinct()
    rows = rows.withColumn("run", F.col("x") - F.row_number().over(W.partitionBy(owner).orderBy("x")))
    rows = rows.withColumn("piece", F.floor((F.row_number().over(W.partitionBy(owner, "run").orderBy("x")) - 1) / most))
    return rows.groupBy(owner, "run", "piece").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.count("*").alias("n")).drop("run", "piece")


def round_robin(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """W-11: interleaves groups: everyone's first, then everyone's second; groups by their best row. Adds turn and place."""
    ranked = rows.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long"))
    best = ranked.filter("turn = 1").select(group, F.row_number().over(W.orderBy(*order)).alias("group_rank"))
    few = rows.select(group).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return ranked.join(F.broadcast(best) if few else best, group).orderBy("turn", "group_rank")


def capped(rows: DataFrame, group: str | list[str], cap: int | Column, *order: Column) -> DataFrame:
    """W-12, T-06, H-02: the first rows of each group, up to its cap."""
    keys = [group] if isinstance(group, str) else group
    return rows.withColumn("__row", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__row") <= cap).drop("__row")


def rank_fraction(rows: DataFrame, score: str, groups: str) -> DataFrame:
    """W-14: the share of rows that score strictly better than each group's best.

    Groups are kinds, so few: their bests go along as one sorted array. Each row counts for the bests below it; rows are summed
    by that number, and only these sums are ordered."""
    best = rows.groupBy(groups).agg(F.max(score).alias("best"))
    if (found := best.limit(FEW_GROUPS + 1).count()) > FEW_GROUPS:
        raise ValueError(f"more than {found - 1} groups: their bests can't be sent along with the rows")
    ladder = best.agg(F.array_sort(F.collect_set("best")).alias("bests"))
    beaten = rows.crossJoin(F.broadcast(ladder)).groupBy(F.size(F.filter("bests", lambda b: b < F.col(score))).alias("k")).agg(F.count("*").alias("n"))
    down = W.orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, 0)
    steps = beaten.withColumn("better", F.sum("n").over(down)).withColumn("total", F.sum("n").over(W.partitionBy()))
    places = best.crossJoin(F.broadcast(ladder)).withColumn("place", F.array_position("bests", F.col("best")))
    reach = places.join(F.broadcast(steps), F.col("k") >= F.col("place"), "left").groupBy(groups, "best").agg(F.coalesce(F.max("better"), F.lit(0)).alias("better"))
    return reach.crossJoin(F.broadcast(steps.agg(F.max("total").alias("total")))).select(groups, (F.col("better") / F.col("total")).alias("fraction"))


def renumber(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """W-10: 1..n in each group; undated rows last if the order says so."""
    return rows.withColumn("number", F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long"))


def fit_tiers(counts: DataFrame, limit: int) -> DataFrame:
    """A-13: trims tier sizes (tier, n) to a limit as if the last item of the largest tier were dropped again and again.

    Closed form: every tier keeps at most the highest level whose sum fits, and what is then free goes, one each,
    to the highest-numbered tiers that were cut. Tiers are few; the level is found among their sizes."""
    by_size, everything = W.orderBy("n"), W.partitionBy()
    ranked = counts.withColumn("below", F.coalesce(F.sum("n").over(by_size.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("left", F.count("*").over(by_size.rowsBetween(0, W.unboundedFollowing)))
    ranked = ranked.withColumn("level", F.floor((F.lit(limit) - F.col("below")) / F.col("left"))).withColumn("total", F.sum("n").over(everything))
    level = F.min(F.when(F.col("level") < F.col("n"), F.struct("n", "level", "below"))).over(everything)
    ranked = ranked.withColumn("l", F.greatest(level["level"], F.lit(0))).withColumn("cut", F.col("total") > limit)
    kept = ranked.withColumn("base", F.when(F.col("cut"), F.least("n", "l")).otherwise(F.col("n")))
    kept = kept.withColumn("free", F.lit(limit) - F.sum("base").over(everything)).withColumn("open", F.col("base") < F.col("n"))
    turn = F.row_number().over(W.partitionBy("open").orderBy(F.col("tier").desc()))
    return kept.withColumn("turn", turn).select("tier", "n", (F.col("base") + F.when(F.col("open") & (F.col("turn") <= F.col("free")), 1).otherwise(0)).cast("long").alias("kept"))


def document_frequency(rows: DataFrame, doc: str, tokens: Column, one_row_each: bool = False) -> DataFrame:
    """A-07: different documents for each token. Documents that have one row each needn't be told apart, so tokens are counted before anything is shuffled."""
    found = rows.select(F.col(doc).alias("d"), F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token")
    return found.agg((F.count("*") if one_row_each else F.count_distinct("d")).alias("df"))


def bigrams(rows: DataFrame, tokens: Column, least: int) -> DataFrame:
    """A-10: neighbouring token pairs found at least so often. Pairs are counted as one text each; most are rare, so texts are first dealt to tasks that each hold few of them."""
    rows = apart(rows.withColumn("__n", F.monotonically_increasing_id()), "__n")
    listed = rows.select(tokens.alias("t")).filter(F.size("t") > 1)
    pairs = F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    found = listed.select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return found.select(F.split_part("p", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p", F.lit(" "), F.lit(2)).alias("b"), "n")


def one_swap(word: Column, confused: tuple[tuple[str, str], ...]) -> Column:
    """C-06, A-10: every text that one confusion (read, meant) makes of a word, as an array."""

    def swapped(read: str, meant: str) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(len(read))) == read)
        return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit(meant), F.substring(word, i + len(read), F.length(word))))

    made = [swapped(read, meant) for read, meant in confused]
    return F.array_distinct(F.flatten(F.array(*made)))


def own_spellings(texts: DataFrame, text: str, clean: DataFrame, confused: tuple[tuple[str, str], ...], dictionary: DataFrame | None = None, least: int = 3, common: int = 20) -> DataFrame:
    """A-10: words of a corpus that clean texts lack (clean: word, n, in lower case) but that are its own spellings and no misreadings: word, n.

    A word of a dictionary (word) with five letters; one of eight that stands `least` times; one of six that does, unless one confusion makes a common word of it. The texts that
    one confusion makes of such a word are the keys by which common words are looked up, so no pair of words is compared that isn't one confusion apart."""
    words = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?<![\p{L}\p{N}_])[A-Za-z]+(?![\p{L}\p{N}_])"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    new = written(words.join(clean.select("word"), "word", "left_anti"))
    letters = F.length("word")
    often = new.filter((letters >= 6) & (F.col("n") >= least))
    keys = often.filter(letters < 8).select("word", F.explode(one_swap(F.col("word"), confused)).alias("key"))
    misread = keys.join(clean.filter(F.col("n") >= common).select(F.col("word").alias("key")), "key", "left_semi").select("word").distinct()
    admitted = often.join(misread, "word", "left_anti")
    if dictionary is not None:
        listed = new.filter(letters >= 5).join(dictionary.select(F.lower(F.trim("word")).alias("word")).distinct(), "word", "left_semi")
        admitted = admitted.unionByName(listed).distinct()
    return admitted.select("word", "n")


def proper_names(rows: DataFrame, doc: str, text: str, word: str) -> DataFrame:
    """A-09: capitalized words never seen in lower case: name, count and first document."""
    words = rows.select(F.col(doc).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(word), F.lit(0))).alias("w"))
    counted = words.groupBy("w").agg(F.count("*").alias("n"), F.min("d").alias("first_doc")).withColumn("low", F.lower("w"))
    seen = counted.filter("w = low").select(F.col("w").alias("seen"))
    return counted.filter("w <> low").join(seen, F.col("low") == F.col("seen"), "left_anti").select(F.col("w").alias("name"), "n", "first_doc")


def index_status(pieces: DataFrame, vectors: DataFrame) -> DataFrame:
    """A-04, A-06: pieces, unique hashes, embedded ones, and characters still to be embedded. pieces: hash, n_chars."""
    unique = pieces.groupBy("hash").agg(F.min("n_chars").alias("chars"), F.count("*").alias("pieces"))
    done = vectors.select(F.col("hash").alias("h")).distinct()
    marked = unique.join(done, F.col("hash") == F.col("h"), "left")
    return marked.agg(
        F.sum("pieces").alias("pieces"), F.count("*").alias("unique_hashes"), F.count("h").alias("embedded"),
        F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("chars"))), F.lit(0)).cast("long").alias("pending_chars"),
    )


def pending(pieces: DataFrame, vectors: DataFrame) -> DataFrame:
    """A-05: hashes without a vector, each with its smallest piece id. pieces: id, hash."""
    return pieces.join(vectors.select("hash").distinct(), "hash", "left_anti").groupBy("hash").agg(F.min("id").alias("first_id"))


def checksum(rows: DataFrame, text: str) -> DataFrame:
    """A-08: rows and characters, to tell cheaply whether a rewrite is needed."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("chars"))


def union_ranked(*sources: DataFrame) -> DataFrame:
    """U-05, U-06, T-02: sources one after another, with their number."""
    out = sources[0].withColumn("source_rank", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("source_rank", F.lit(i)))
    return out


def distinct_capped(rows: DataFrame, owner: str, item: str, order: str, most: int) -> DataFrame:
    """T-03, T-07: an owner's first different items, numbered."""
    first = rows.groupBy(owner, item).agg(F.min(order).alias("first_at"))
    place = F.row_number().over(W.partitionBy(owner).orderBy("first_at", item)).cast("long")
    return first.withColumn("place", place).filter(F.col("place") <= most)


def merge_lists(rows: DataFrame, cap: int) -> DataFrame:
    """U-02 (Q-11): owner, rank, id, label -> up to cap rows an owner, none with an id or a label that an accepted one has.

    Sequential by nature; an owner's list is short, so it is folded as an array inside codegen."""
    listed = rows.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "label"))).alias("l"))
    empty = F.slice("l", 1, 0)
    fold = F.aggregate(
        "l", empty,
        lambda kept, x: F.when((F.size(kept) >= cap) | F.exists(kept, lambda k: (k["id"] == x["id"]) | (k["label"] == x["label"])), kept).otherwise(F.concat(kept, F.array(x))),
    )
    return listed.select("owner", F.posexplode(fold).alias("place", "x")).select("owner", (F.col("place") + 1).alias("place"), "x.id", "x.label")


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """U-04, D-11, D-12: what makes the old version the new one: key and change (insert, update, delete)."""
    o, n = old.select(F.col(key).alias("ok"), F.col(value).alias("ov")), new.select(F.col(key).alias("nk"), F.col(value).alias("nv"))
    kind = F.when(F.col("ok").isNull(), "insert").when(F.col("nk").isNull(), "delete").when(~F.col("ov").eqNullSafe(F.col("nv")), "update")
    return o.join(n, F.col("ok") == F.col("nk"), "full").select(F.coalesce("nk", "ok").alias(key), kind.alias("change")).filter("change IS NOT NULL")


def merge_intervals(rows: DataFrame, gap: int = 1, longest: int | None = None, limit: int | None = None) -> DataFrame:
    """W-05, W-06, Q-18: owner, rank, first, last -> intervals in rank order, each widening the earliest accepted one that
    it overlaps or touches (within gap, and if the union isn't over `longest`); after `limit` are accepted, the rest is left."""
    listed = rows.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")))).alias("l"))

    def near(k, x):
        ok = (k["first"] <= x["last"] + gap) & (x["first"] <= k["last"] + gap)
        return ok & (F.greatest(k["last"], x["last"]) - F.least(k["first"], x["first"]) < longest) if longest else ok

    def step(kept, x):
        place = F.array_position(F.transform(kept, lambda k: near(k, x)), True)
        widened = F.transform(
            kept, lambda k, i: F.when(i + 1 == place, F.struct(k["rank"].alias("rank"), F.least(k["first"], x["first"]).alias("first"), F.greatest(k["last"], x["last"]).alias("last"))).otherwise(k)
        )
        out = F.when(place > 0, widened).otherwise(F.concat(kept, F.array(x)))
        return F.when(F.size(kept) >= limit, kept).otherwise(out) if limit else out

    fold = F.aggregate("l", F.slice("l", 1, 0), step)
    return listed.select("owner", F.posexplode(fold).alias("place", "x")).select("owner", (F.col("place") + 1).alias("place"), "x.first", "x.last")


def split_range(rows: DataFrame) -> DataFrame:
    """W-15: id, first, start, last, end -> one row for each line: its number, from (null: start) and to (null: end of line)."""
    lines = rows.select("*", F.explode(F.sequence("first", "last")).alias("line"))
    return lines.select("id", "line", F.when(F.col("line") == F.col("first"), F.col("start")).otherwise(0).alias("from"), F.when(F.col("line") == F.col("last"), F.col("end")).alias("to"))


def months(spans: DataFrame) -> DataFrame:
    """W-16: every month from first to last, both included."""
    return spans.select("id", F.explode(F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))).alias("m")).select("id", F.year("m").alias("year"), F.month("m").alias("month"))


def joined_sentences(rows: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """W-08: a paragraph joins its predecessor if that lacks a sentence's end and it starts in lower case."""
    w = W.partitionBy(doc).orderBy(pos)
    open_before = ~F.lag(text).over(w).rlike(r"[.!?][\"')\]]*\s*$")
    starts = F.when(F.col(text).rlike(r"^\s*\p{Ll}") & F.coalesce(open_before, F.lit(False)), 0).otherwise(1)
    grouped = rows.withColumn("__start", starts).withColumn("__group", F.sum("__start").over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return grouped.groupBy(doc, F.col("__group").alias("paragraph")).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias(text))


def number_gaps(rows: DataFrame, group: str, number: str) -> DataFrame:
    """W-13: holes in a number sequence: after, missing."""
    after = F.lead(number).over(W.partitionBy(group).orderBy(number))
    return rows.select(group, F.col(number).alias("after"), (after - F.col(number) - 1).alias("missing")).filter("missing > 0")
