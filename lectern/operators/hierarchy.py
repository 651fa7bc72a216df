"""Lookups and joins over the hierarchy (P-01 to P-25, J-01 to J-14, J-18 to J-22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.storage import apart


def visible(rows: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """P-01, P-02, P-03: rows whose key isn't in the hidden set."""
    return rows.join(hidden.select(F.col(hidden.columns[0]).alias("__hidden")), F.col(key) == F.col("__hidden"), "left_anti")


def children(rows: DataFrame, parent: str, *order: str | Column) -> DataFrame:
    """P-05: children of each parent, numbered in order."""
    return rows.withColumn("position", F.row_number().over(W.partitionBy(parent).orderBy(*order)).cast("long"))


def setting(settings: DataFrame, keys: DataFrame) -> DataFrame:
    """P-06: key, default -> key, value."""
    return keys.join(settings, "key", "left").select("key", F.coalesce("value", "default").alias("value"))


def latest_active(rows: DataFrame, keys: list[str], *newest: str) -> DataFrame:
    """P-07, P-08: of rows that aren't deleted, the newest for each key."""
    order = [F.col(c).desc_nulls_last() for c in newest]
    live = rows.filter("deleted_at IS NULL").withColumn("__row", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return live.filter("__row = 1").drop("__row")


def earliest(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """J-02, J-03, J-19: one row for each key, the first in order (an ambiguous name means the earliest volume)."""
    return rows.withColumn("__row", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__row = 1").drop("__row")


def lookup_ci(rows: DataFrame, name: str, wanted: DataFrame, *order: str) -> DataFrame:
    """J-02, P-09, P-10: for each wanted name, the first row of that name in any case."""
    keyed = rows.withColumn("lookup", F.lower(name)).join(wanted.select(F.lower("wanted").alias("lookup")).distinct(), "lookup")
    return earliest(keyed, ["lookup"], *order)


def spelling_links(names: DataFrame) -> DataFrame:
    """P-11: each spelling of a name with the name and meaning of the last row that has it."""
    spelled = names.select("id", "name", "meaning", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("forms", F.array().cast("array<string>"))))).alias("spelling"))
    return spelled.groupBy("spelling").agg(F.max_by(F.struct("name", "meaning"), "id").alias("r")).select("spelling", "r.*")


def contains_literal(col: str, text: str) -> Column:
    """P-13, P-14 (Q-8): a substring in any case; signs of patterns are ordinary signs."""
    return F.contains(F.lower(F.col(col)), F.lit(text.lower()))


def all_words_in(hay: Column, words: list[str]) -> Column:
    """P-15: every word is a substring."""
    out = F.lit(True)
    for w in words:
        out &= F.contains(F.lower(hay), F.lit(w.lower()))
    return out


def masked(rows: DataFrame, kinds: list[str] | None = None, volumes: list[str] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """P-17: kinds and volumes as filters; rows without a volume fail any positive volume filter only."""
    if kinds is not None:
        rows = rows.filter(F.col("kind").isin(kinds))
    if volumes is not None:
        rows = rows.filter(F.col("volume_slug").isin(volumes))
    return rows.filter(F.col("volume_slug").isNull() | ~F.col("volume_slug").isin(list(without))) if without else rows


def within(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """P-18, T-10: rows whose key is in the set."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def annotated(rows: DataFrame, key: str, *marks: DataFrame) -> DataFrame:
    """J-10: rows that any of the tables of marks has (a semi-join with their union)."""
    every = marks[0].select(F.col(marks[0].columns[0]).alias("k"))
    for m in marks[1:]:
        every = every.union(m.select(m.columns[0]))
    return within(rows, every, key)


def both_sides(edges: DataFrame, a: list[str], b: list[str], rest: list[str]) -> DataFrame:
    """J-07: each edge from both ends, as from, to; a loop counts once. Two equal-key unions instead of an OR join."""
    one = edges.select(F.struct(*[F.col(x).alias(f"k{i}") for i, x in enumerate(a)]).alias("from"), F.struct(*[F.col(x).alias(f"k{i}") for i, x in enumerate(b)]).alias("to"), *rest)
    other = one.select(F.col("to").alias("from"), F.col("from").alias("to"), *rest).filter(~F.col("from").eqNullSafe(F.col("to")))
    return one.withColumn("side", F.lit(0)).unionByName(other.withColumn("side", F.lit(1)))


def range_text(rows: DataFrame, ranges: DataFrame, keys: list[str], position: str, text: str, sep: str = " ") -> DataFrame:
    """J-06, H-22: for each range (id, keys, first, last) the texts in it, in order; ranges without any are dropped.
    The keys are equi-join keys; the range is only a filter on top."""
    hit = rows.join(ranges, keys).filter(F.col(position).between(F.col("first"), F.coalesce("last", "first")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    return hit.groupBy("id").agg(parts.alias("parts")).select(
        "id", F.size("parts").cast("long").alias("n"), F.array_join(F.transform("parts", lambda p: p["t"]), sep).alias("text")
    )


def resolve_list(rows: DataFrame, key: str, listed: str, known: DataFrame, sep: str = ",") -> DataFrame:
    """J-08: a separated list of slugs (rows key, listed) looked up in known (slug, name), in list order; unknown ones go."""
    split = rows.select(key, F.posexplode(F.split(listed, sep)).alias("pos", "slug")).withColumn("slug", F.trim("slug"))
    found = split.join(known, "slug").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("l"))
    return found.select(key, F.array_join(F.transform("l", lambda x: x["name"]), "; ").alias("names"))


def grouped_in_order(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """J-11: rows of each key as an ordered array."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("rows"))


def reading_block(lines: DataFrame, books: DataFrame, most: int = 60) -> DataFrame:
    """J-20: "Isaiah 13-14; 22" (id, text) -> id, pos, book, chapter. A part without a book takes the last named one; a name
    matches the shortest book that begins with it; a range is at most `most` chapters."""
    part = lines.select("id", F.posexplode(F.split("text", r"\s*[;,]\s*")).alias("pos", "part"))
    part = part.select(
        "id", "pos", F.nullif(F.trim(F.regexp_extract("part", r"^(\d?\s*[A-Za-z&. ]*[A-Za-z.])", 1)), F.lit("")).alias("named"),
        F.regexp_extract("part", r"(\d+)\s*(?:[-–]\s*(\d+))?\s*$", 1).try_cast("int").alias("first"), F.regexp_extract("part", r"(\d+)\s*(?:[-–]\s*(\d+))?\s*$", 2).try_cast("int").alias("last"),
    )
    carried = part.withColumn("named", F.last("named", ignorenulls=True).over(W.partitionBy("id").orderBy("pos"))).filter("first IS NOT NULL AND named IS NOT NULL")
    begins = F.lower(F.regexp_replace("named", r"\.$", ""))
    wanted = carried.select("named").distinct().withColumn("low", begins).withColumn("head", F.substring("low", 1, 1))
    names = wanted.join(books.select(F.col("name").alias("book"), F.lower(F.substring("name", 1, 1)).alias("head")), "head").filter(F.startswith(F.lower("book"), F.col("low")))
    names = earliest(names, ["named"], F.length("book"), "book")
    chapters = F.explode(F.sequence("first", F.least(F.greatest(F.coalesce("last", "first"), F.col("first")), F.col("first") + most)))
    return carried.join(names, "named").select("id", "pos", "book", chapters.alias("chapter"))


def by_key(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """P-04, P-16: the row of each wanted key, and whether there is one; the key is the only join column."""
    return wanted.select(key).join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def named_list(rows: DataFrame, id_col: str, name: str) -> DataFrame:
    """P-19: ids and names with their place in the order of names."""
    return rows.select(id_col, name, F.row_number().over(W.orderBy(name, id_col)).cast("long").alias("place"))


def recent_sessions(sessions: DataFrame, fields: str, limit: int = 20) -> DataFrame:
    """P-20: of sessions (id, data as JSON, updated_at, deleted_at) the newest that aren't deleted, with their fields; of these, damaged ones are left out."""
    order = (F.col("updated_at").desc(), F.col("id").desc())
    newest = sessions.filter("deleted_at IS NULL").orderBy(*order).limit(limit).withColumn("s", F.from_json("data", f"struct<{fields},_bad:string>", {"columnNameOfCorruptRecord": "_bad"}))
    whole = newest.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long")).filter("s IS NOT NULL AND s._bad IS NULL")
    return whole.select("id", "place", "updated_at", "s.*").drop("_bad")


def volume_of(rows: DataFrame, chapters: DataFrame, slugs: list[str] | None = None) -> DataFrame:
    """P-21: rows with their chapter's volume (null without a chapter), and whether it is one of `slugs`. chapters: chapter_id, volume_slug."""
    out = rows.join(chapters.select("chapter_id", "volume_slug"), "chapter_id", "left")
    return out if slugs is None else out.withColumn("within", F.coalesce(F.col("volume_slug").isin(slugs), F.lit(False)))


def report_problem(description: int = 5000, field: int = 200, contact: int = 200) -> Column:
    """P-24: what is wrong with a report (description, version, platform, contact, error, fingerprint), or null. Version and platform are needed."""
    named = [F.when(F.col(c).isNull() | (F.col(c) == "") | (F.length(c) > field), F.lit(f"missing or invalid {c}")) for c in ("version", "platform")]
    return F.coalesce(
        F.when(F.length("description") > description, F.lit("description too long")), *named, F.when(F.length("contact") > contact, F.lit("invalid contact")),
        F.when(F.length("error") > field, F.lit("invalid error")), F.when(~F.col("fingerprint").rlike(r"\A[0-9a-f]{12}\z"), F.lit("invalid fingerprint")),
    )


def original_language(volume_slug: Column, testament: Column) -> Column:
    """P-25: whose words a chapter's word study lists first: Greek for the Apocrypha and the New Testament, Hebrew for the Old; null without a testament."""
    return F.when((volume_slug == "apocrypha") | (testament == "New Testament"), "greek").when(testament.isNotNull(), "hebrew")


def verse_by_reference(verses: DataFrame, wanted: DataFrame) -> DataFrame:
    """J-01: wanted (book_name, chapter_number, verse_number) -> their verses; of books of the same name that of the earliest volume. verses: the hierarchy in one row."""
    keys = ["book_name", "chapter_number", "verse_number"]
    return earliest(verses.join(wanted.select(*keys).distinct(), keys), keys, "volume_sort", "verse_id")


def location(chapters: DataFrame, wanted: DataFrame) -> DataFrame:
    """J-04: chapter_id -> volume, testament (null where a book has none) and book."""
    return chapters.join(wanted.select("chapter_id").distinct(), "chapter_id", "left_semi").select("chapter_id", "volume_slug", "testament", "book_name")


def topic_verses(listed: DataFrame, verses: DataFrame) -> DataFrame:
    """J-05: topic_id, volume_slug, reference, sort_order -> the verses of each topic, numbered in its order; what names no verse is left out."""
    hit = listed.join(verses.select("verse_id", "volume_slug", "reference", "text"), ["volume_slug", "reference"])
    return hit.withColumn("place", F.row_number().over(W.partitionBy("topic_id").orderBy("sort_order", "verse_id")).cast("long"))


def target_label(reference: Column, book: Column, chapter: Column) -> Column:
    """J-09, J-12, J-13: what a note or tag is called that hangs on a verse, or on a chapter."""
    return F.coalesce(reference, F.concat_ws(" ", book, chapter.cast("string")))


def labelled_targets(rows: DataFrame, verses: DataFrame, chapters: DataFrame) -> DataFrame:
    """J-09, J-12, J-13: rows (verse_id or chapter_id set) with the label of what they hang on; null if it is gone."""
    v = verses.select("verse_id", "reference")
    c = chapters.select("chapter_id", "book_name", "chapter_number")
    both = rows.join(v, "verse_id", "left").join(c, "chapter_id", "left")
    label = F.when(F.col("reference").isNotNull() | F.col("book_name").isNotNull(), target_label(F.col("reference"), F.col("book_name"), F.col("chapter_number")))
    return both.withColumn("label", label).drop("reference", "book_name", "chapter_number")


def natural_targets(rows: DataFrame, verses: DataFrame, chapters: DataFrame) -> DataFrame:
    """J-14: rows (id, verse_id or chapter_id) -> id and the target that means the same on every device: kind, volume_slug and reference, or
    book_name and chapter_number. Rows whose place is gone are left out; a verse counts before a chapter."""
    none = F.lit(None).cast("string")
    v = verses.select("verse_id", "volume_slug", "reference", none.alias("book_name"), F.lit(None).cast("int").alias("chapter_number"))
    c = chapters.select("chapter_id", "volume_slug", none.alias("reference"), "book_name", F.col("chapter_number").cast("int").alias("chapter_number"))
    on_verses = rows.filter("verse_id IS NOT NULL").select("id", "verse_id").join(v, "verse_id").withColumn("kind", F.lit("verse"))
    on_chapters = rows.filter("verse_id IS NULL").select("id", "chapter_id").join(c, "chapter_id").withColumn("kind", F.lit("chapter"))
    fields = ["id", "kind", "volume_slug", "reference", "book_name", "chapter_number"]
    return on_verses.select(*fields).unionByName(on_chapters.select(*fields))


def resolved_targets(targets: DataFrame, verses: DataFrame, chapters: DataFrame) -> DataFrame:
    """J-14 the other way: targets with an id -> id, verse_id, chapter_id here; those that this corpus doesn't have are left out."""
    v = verses.select("verse_id", "volume_slug", "reference")
    c = chapters.select("chapter_id", "volume_slug", "book_name", "chapter_number")
    on_verses = targets.filter("kind = 'verse'").select("id", "volume_slug", "reference").join(v, ["volume_slug", "reference"])
    on_chapters = targets.filter("kind = 'chapter'").select("id", "volume_slug", "book_name", "chapter_number").join(c, ["volume_slug", "book_name", "chapter_number"])
    none = F.lit(None).cast("long")
    return on_verses.select("id", "verse_id", none.alias("chapter_id")).unionByName(on_chapters.select("id", none.alias("verse_id"), "chapter_id"))


def head_word(text: Column) -> Column:
    """J-21: what stands before the first sign of a gloss, without brackets, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^[^,;:.]*", 0), r"^[ ()\[\]{}]+|[ ()\[\]{}]+$", ""))


def name_entries(names: DataFrame, entries: DataFrame, most: int = 3) -> DataFrame:
    """J-21: name -> up to three entries (strongs, gloss, kjv_renderings) whose gloss or rendering begins with just that name, Hebrew before Greek."""
    heads = F.explode(F.array_distinct(F.array(head_word(F.col("gloss")), head_word(F.col("kjv_renderings"))))).alias("low")
    hit = entries.select("strongs", heads).join(names.select("name", F.lower("name").alias("low")).distinct(), "low").select("name", "strongs").distinct()
    order = W.partitionBy("name").orderBy(F.substring("strongs", 1, 1) != "H", F.substring("strongs", 2, 9).try_cast("int"))
    return hit.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most)


def located(references: DataFrame, verses: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """J-22, H-08: rows with a reference -> the same with chapter_id, verse and volume_slug of the earliest volume that has it."""
    known = verses.filter(~F.col("volume_slug").isin(list(without))) if without else verses
    first = known.groupBy("reference").agg(F.min(F.struct("volume_sort", "verse_id", "chapter_id", F.col("verse_number").cast("long").alias("verse"), "volume_slug")).alias("v"))
    return apart(references, "reference").join(first, "reference").select("*", "v.chapter_id", "v.verse", "v.volume_slug").drop("v")


def cited_passages(citations: DataFrame, verses: DataFrame, most: int = 8) -> DataFrame:
    """J-22: work, reference -> the first passages that each work cites, neighbouring verses of a chapter joined: work, place, chapter_id, first, last.

    Citations are dealt twice: by reference, and as numbers by work and chapter."""
    hit = apart(located(citations.select("work", "reference"), verses).select("work", "chapter_id", "verse"), "work", "chapter_id")
    run = F.col("verse") - F.dense_rank().over(W.partitionBy("work", "chapter_id").orderBy("verse"))
    spans = hit.withColumn("run", run).groupBy("work", "chapter_id", "run").agg(F.min("verse").alias("first"), F.max("verse").alias("last"))
    place = F.row_number().over(W.partitionBy("work").orderBy("chapter_id", "first")).cast("long")
    return spans.withColumn("place", place).filter(F.col("place") <= most).select("work", "place", "chapter_id", "first", "last")


def chapter_search(chapters: DataFrame, name: str, text: str, limit: int = 20, *order: str) -> DataFrame:
    """T-01 (Q-8, Q-15): names that contain the text: the very name first (case counts), then those that begin with it, then others."""
    level = F.when(F.col(name) == text, 0).when(F.startswith(F.lower(F.col(name)), F.lit(text.lower())), 1).otherwise(2).cast("long")
    return chapters.filter(contains_literal(name, text)).withColumn("level", level).orderBy("level", *order).limit(limit)
