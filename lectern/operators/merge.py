"""Upserts, replication and mirrors (D-*). Tables are values: each operator returns the new state; writing it is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.alignment import WORD, seq_ratio
from lectern.operators.analytics import capped
from lectern.storage import apart, written

#: Rows up to which a word is joined in the first step of `candidates`, and words of its first side that may be broadcast.
STEP, BROADCAST_WORDS = 2000, 100_000
#: What sums of the same weights may differ by.
SLACK = 1e-9


def last_write_wins(records: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """D-01 (Q-7): of each key the latest record; equal times go to the later source, then to the later place in it.
    Tombstones win like other records and stay in the state."""
    order = F.struct(F.col(at), *[F.col(t) for t in ties])
    fields = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("r")).select(*keys, "r.*")


def merge_into(local: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """D-01, D-02: incoming records replace local ones if strictly newer; local wins ties. Keys may be null."""
    both = local.withColumn("__local", F.lit(1)).unionByName(incoming.withColumn("__local", F.lit(0)))
    return last_write_wins(both, keys, at, "__local").drop("__local")


def live(state: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """D-06: what isn't a tombstone."""
    return state.filter(F.col(deleted).isNull())


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """D-04, D-05, D-13: rows of new replace those with the same key, nulls matching nulls; others stay."""
    on = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new.select(*keys), on, "left_anti").unionByName(new.select(*old.columns))


def mirrored(old: DataFrame, upstream: DataFrame, keys: list[str], keep: DataFrame | None = None, mirror: bool = True) -> DataFrame:
    """D-10 to D-13, D-15: upstream's rows; of the others those in `keep` (keys with user data) or, without mirror, all."""
    rest = old.join(upstream.select(*keys), [old[k].eqNullSafe(upstream[k]) for k in keys], "left_anti")
    if mirror:
        rest = rest.join(keep.select(*keys), keys, "left_semi") if keep is not None else rest.limit(0)
    return upstream.select(*old.columns).unionByName(rest)


def worklist(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """D-19: what isn't done yet."""
    return wanted.join(done.select(key), key, "left_anti")


def refreshed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """D-19: new values over old ones; a failed (null) new one keeps the old."""
    o, n = old.select(F.col(key).alias("ok"), F.col(value).alias("ov")), new.select(F.col(key).alias("nk"), F.col(value).alias("nv"))
    return o.join(n, F.col("ok") == F.col("nk"), "full").select(F.coalesce("nk", "ok").alias(key), F.coalesce("nv", "ov").alias(value))


def cleared(ranges: DataFrame, owner: str, at: str) -> DataFrame:
    """D-08: half-open ranges (owner, id, start, end, at): a later one tombstones all earlier ones that it overlaps, even if it is itself tombstoned later.

    No pairs of ranges: an owner's endpoints cut its line into segments, numbered in order, and each segment keeps the latest range on it. A range is
    gone if a later one is the latest on any of its segments. Rows grow with the segments a range spans, not with the length of the line."""
    ends = ranges.select(owner, F.explode(F.array("start", "end")).alias("x")).distinct()
    ends = ends.withColumn("n", F.row_number().over(W.partitionBy(owner).orderBy("x")))
    place = lambda c: ends.select(owner, F.col("x").alias(c), F.col("n").alias(f"{c}_n"))
    spans = ranges.filter("start < end").join(place("start"), [owner, "start"]).join(place("end"), [owner, "end"])
    points = spans.select(owner, "id", F.struct(F.col(at).alias("at"), "id").alias("own"), F.explode(F.sequence("start_n", F.col("end_n") - 1)).alias("n"))
    top = points.groupBy(owner, "n").agg(F.max("own").alias("top"))
    last = points.join(top, [owner, "n"]).groupBy(owner, "id").agg(F.max("top").alias("last"), F.max("own").alias("own"))
    marked = last.select(owner, "id", (F.col("last") > F.col("own")).alias("deleted"))
    return ranges.join(marked, [owner, "id"], "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def candidates(a: DataFrame, b: DataFrame, most: int = 5, step: int = STEP, book: list[str] | None = None) -> DataFrame:
    """J-16: a: id_a, text_a; b: id_b, text_b, both with the columns of `book` -> for each a the b of the same book with the highest sum of
    1 / document frequency over shared words, up to `most`; equal sums go by id.

    Words that a quarter of a book's rows or more have don't count. `step` cuts nothing: words that more rows have are joined later. If the
    `most`-th best sum of an a over its rarer words is above what its other words can add, only b within that of it are completed; every other
    a is joined by all of its words."""
    book, own = book or [], [*(book or []), "w"]
    found = lambda text: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD.pattern), F.lit(0)), F.lower))
    words_b, words_a = b.select("id_b", *book, F.explode(found("text_b")).alias("w")), a.select("id_a", *book, F.explode(found("text_a")).alias("w"))
    hint = F.broadcast if words_a.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else lambda small: small
    df = words_b.join(hint(words_a.select(*own).distinct()), own, "left_semi").groupBy(*own).agg(F.count("*").alias("df"))
    sizes = b.groupBy(*book).agg(F.count("*").alias("n"))
    df = (df.join(sizes, book) if book else df.crossJoin(F.broadcast(sizes))).filter(4 * F.col("df") < F.col("n")).drop("n")
    terms, common = words_a.join(df, own), F.col("df") > step
    parts = words_b.join(hint(terms.filter(~common)), own).groupBy("id_a", "id_b").agg(F.sum(1 / F.col("df")).alias("part"))
    best = capped(parts, "id_a", most, F.col("part").desc()).groupBy("id_a").agg(F.when(F.count("*") == most, F.min("part")).alias("least"))
    ahead = terms.groupBy("id_a").agg(F.collect_list(F.when(common, F.struct("w", "df"))).alias("others"), F.coalesce(F.sum(F.when(common, 1 / F.col("df"))), F.lit(0.0)).alias("more"))
    ahead = ahead.join(best, "id_a", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    known = (F.col("more") == 0) | (F.col("least") > F.col("more") + SLACK)
    near = parts.join(ahead.filter(known), "id_a").filter(F.col("part") >= F.col("least") - F.col("more") - SLACK)
    near = near.join(b.select("id_b", found("text_b").alias("words")), "id_b")
    added = F.aggregate("others", F.lit(0.0), lambda total, x: total + F.when(F.array_contains(F.col("words"), x["w"]), 1 / x["df"]).otherwise(0.0))
    near = near.select("id_a", "id_b", (F.col("part") + added).alias("weight"))
    rest = terms.join(ahead.filter(~known).select("id_a"), "id_a", "left_semi")
    whole = words_b.join(hint(rest), own).groupBy("id_a", "id_b").agg(F.sum(1 / F.col("df")).alias("weight"))
    shared = near.unionByName(whole).withColumn("weight", F.round("weight", 12))
    place = F.row_number().over(W.partitionBy("id_a").orderBy(F.col("weight").desc(), "id_b")).cast("long")
    return shared.withColumn("place", place).filter(F.col("place") <= most).select("id_a", "id_b", "weight", "place")


def _most_alike(pairs: DataFrame, least: float, *first: Column) -> DataFrame:
    """pairs (id_a, id_b, ratio) -> of each a the b with the highest ratio that is `least` at least; equal ones go by `first`, then by id."""
    order = F.struct("ratio", *[-f for f in first], -F.col("id_b"))
    return pairs.filter(F.col("ratio") >= least).groupBy("id_a").agg(F.max_by(F.struct("id_b", "ratio"), order).alias("r")).select("id_a", "r.*")


def parallels(a: DataFrame, b: DataFrame, least: float = 0.5, most: int = 5, book: list[str] | None = None) -> DataFrame:
    """J-16: for each a the b of the same book whose list of words is most alike, among the first by rare words, if it is alike enough: id_a, id_b, ratio."""
    pairs = candidates(a, b, most, book=book).join(a.select("id_a", "text_a"), "id_a").join(b.select("id_b", "text_b"), "id_b")
    return _most_alike(pairs.select("id_a", "id_b", "place", seq_ratio("text_a", "text_b", least, words=True).alias("ratio")), least, F.col("place"))


def most_shared(a: DataFrame, b: DataFrame, most: int = 10, book: list[str] | None = None, ahead: int = 3) -> DataFrame:
    """For each a (id_a, text_a) the `most` b (id_b, text_b) of the same book that share most different words: id_a, id_b, shared; equal numbers go by id. Words stand between spaces.

    A prefix filter: a text's words are put in order, those that few b have first. Its `ahead` rarest words find some b, and what the last of the best shares, t, is a bound: a b that
    shares t of its n words (that any b has) must have one of the n - t + 1 rarest, and only these are joined. Words that nearly all have are joined for
    texts alone that share little with anything.

    The joined words of a pair are counted, and the words that stand behind them in both texts tell how many more it may share. So pairs are dealt once, and words are compared for those alone
    that may be among the best and whose number isn't sure yet."""
    book = book or []
    words = lambda text: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))
    own_a, own_b = written(a.select("id_a", *book, words("text_a").alias("words_a"))), written(b.select("id_b", *book, words("text_b").alias("words_b")))
    df = own_b.select(*book, F.explode("words_b").alias("w")).groupBy(*book, "w").agg(F.count("*").alias("df"))

    def in_order(own: DataFrame, id_: str, listed: str) -> DataFrame:
        found = own.select(id_, *book, F.explode(listed).alias("w")).join(df, [*book, "w"]).groupBy(id_, *book).agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("l"))
        return found.select(id_, *book, F.transform("l", lambda x: x["w"]).alias("l"))

    listed = written(in_order(own_a, "id_a", "words_a"))
    places = in_order(own_b, "id_b", "words_b").select("id_b", *book, F.size("l").alias("n"), F.posexplode("l").alias("at", "w"))
    places = written(places.select("id_b", *book, "w", (F.col("n") - F.col("at") - 1).alias("behind_b")))

    def best(taken: DataFrame) -> DataFrame:
        met = taken.select("id_a", *book, "behind_a", F.explode("l").alias("w")).join(places, [*book, "w"])
        met = apart(met.select("id_a", "id_b", F.least("behind_a", "behind_b").alias("behind")), "id_a")
        pairs = met.groupBy("id_a", "id_b").agg(F.count("*").cast("int").alias("shared"), F.min("behind").alias("more"))
        order = W.partitionBy("id_a").orderBy(F.col("shared").desc(), "id_b")
        least = F.nth_value("shared", most).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
        pairs = pairs.withColumn("place", F.row_number().over(order)).withColumn("least", least)
        near = written(pairs.filter((F.col("place") <= most) | ((F.col("more") > 0) & (F.col("shared") + F.col("more") >= F.col("least")))).select("id_a", "id_b", "shared", "more"))
        unsure = near.filter("more > 0").join(own_a.select("id_a", "words_a"), "id_a").join(own_b.select("id_b", "words_b"), "id_b")
        unsure = unsure.select("id_a", "id_b", F.size(F.array_intersect("words_a", "words_b")).alias("shared"))
        return capped(near.filter("more = 0").select("id_a", "id_b", "shared").unionByName(unsure), "id_a", most, F.col("shared").desc(), F.col("id_b"))

    first = listed.select("id_a", *book, F.slice("l", 1, ahead).alias("l"), F.greatest(F.size("l") - ahead, F.lit(0)).alias("behind_a"))
    first = best(first).groupBy("id_a").agg(F.when(F.count("*") == most, F.min("shared")).alias("t"))
    bound = listed.join(first, "id_a", "left").withColumn("t", F.coalesce("t", F.lit(1)))
    return best(bound.select("id_a", *book, F.slice("l", F.lit(1), F.size("l") - F.col("t") + 1).alias("l"), (F.col("t") - 1).alias("behind_a")))


def nearest_text(a: DataFrame, b: DataFrame, least: float = 0.7, most: int = 10, book: list[str] | None = None) -> DataFrame:
    """J-18, D-14: for each a the b of the same book that is most alike by letters among those that share most words, if alike enough: id_a, id_b, ratio."""
    pairs = most_shared(a, b, most, book).join(a.select("id_a", "text_a"), "id_a").join(b.select("id_b", "text_b"), "id_b")
    return _most_alike(pairs.select("id_a", "id_b", seq_ratio("text_a", "text_b", least).alias("ratio")), least)


def rehomed(marks: DataFrame, moved: DataFrame) -> DataFrame:
    """D-14: marks (id, target) of displaced texts follow them: moved has id_a, id_b. All is decided before anything is changed; what has no new place, or
    its old one, is marked as unplaced."""
    moved = moved.filter("id_a <> id_b")
    return marks.join(moved, marks["target"] == moved["id_a"], "left").select(*[c for c in marks.columns if c != "target"], F.coalesce("id_b", "target").alias("target"), F.col("id_b").isNull().alias("unplaced"))


def limited_reports(events: DataFrame, print_: str, at: str, repeats: int = 50, hourly: int = 10) -> DataFrame:
    """D-22, A-15: events with the number of their repeat and whether they pass: up to `repeats` of one fingerprint, and up to `hourly` new
    fingerprints in a clock hour."""
    own = W.partitionBy(print_).orderBy(at, "id")
    rows = events.withColumn("repeat", F.row_number().over(own).cast("long")).withColumn("hour", F.date_trunc("hour", F.min(at).over(W.partitionBy(print_))))
    new = rows.filter("repeat = 1").withColumn("turn", F.row_number().over(W.partitionBy("hour").orderBy(at, "id"))).select(F.col(print_).alias("__p"), "turn")
    return rows.join(new, F.col(print_) == F.col("__p")).withColumn("passes", (F.col("repeat") <= repeats) & (F.col("turn") <= hourly)).drop("__p", "turn", "hour")


def retained(rows: DataFrame, owner: str, at: str, now: Column, keep: int = 5, days: int = 30) -> DataFrame:
    """K-13: the newest few of each owner that aren't too old."""
    return capped(rows, owner, keep, F.col(at).desc(), F.col("id")).filter(F.datediff(now, F.col(at)) <= days)
