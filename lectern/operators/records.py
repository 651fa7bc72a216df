"""Smaller operators on records, texts and sessions (A-03, A-11, A-12, A-14, W-07, W-09, T-05, T-09, X-05, V-02, V-04, D-07, D-09, D-18, D-20, C-07, C-11, F-19, F-21, F-22, K-04, S-01)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import cleaning
from lectern.functions.text import tokens
from lectern.operators import search as S
from lectern.operators.analytics import capped
from lectern.operators.merge import upserted
from lectern.operators.stored import few
from lectern.storage import written


def bootstrap(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S-01, D-20: every table below path in its present schema; one that isn't there yet is empty, and columns added since are null."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(name: str) -> bool:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        return place.getFileSystem(conf).exists(place)

    return {n: schemas.conform(spark.read.option("mergeSchema", True).parquet(f"{path}/{n}"), n) if there(n) else spark.createDataFrame([], s) for n, s in schemas.TABLES.items()}


def chapter_texts(verses: DataFrame, chapter: str, number: str, text: str, sep: str = "\n\n") -> DataFrame:
    """A-03 (Q-10): a chapter's verses as one text, in verse order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(text).alias("t"))))
    return verses.groupBy(chapter).agg(F.array_join(F.transform(parts, lambda p: p["t"]), sep).alias("text"))


def unknown_words(texts: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """A-11, C-07: tokens that aren't in the vocabulary (word), counted."""
    words = texts.select(F.explode(tokens(F.col(text))).alias("word"))
    return words.join(vocabulary.select("word"), "word", "left_anti").groupBy("word").agg(F.count("*").alias("n"))


def cleaned_verses(verses: DataFrame, words: DataFrame, pairs: DataFrame, title: bool = False) -> DataFrame:
    """C-02 to C-07: verses (id, text, parallel) cleaned by the counts of a clean corpus: words (word, n) and pairs (a, b, n), in lower case.

    Each row is joined with the counts of the words and pairs that its rules can ask for; these are as many as its text is long. They are many times the verses, though Spark's
    estimate is that of the verses' file, so they are never broadcast: the counts are, if these are few."""
    names = F.pandas_udf(lambda texts, theirs: pd.Series([cleaning.lookups(t or "", p or "") for t, p in zip(texts, theirs, strict=True)]), "array<string>")
    run = cleaning.with_counts((lambda t, known, _: cleaning.clean_title(t, known)) if title else cleaning.clean_verse)
    known = words.select(F.col("word").alias("key"), "n").unionByName(pairs.select(F.concat_ws(" ", "a", "b").alias("key"), "n"))
    known = written(known)
    asked = verses.select("id", F.explode(names("text", "parallel")).alias("key"))
    asked = asked.join(F.broadcast(known), "key") if few(known) else asked.hint("merge").join(known, "key")
    counts = asked.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("n").cast("long")))).alias("counts"))
    return verses.hint("merge").join(counts, "id", "left").select("id", F.pandas_udf(run, "string")("text", "parallel", "counts").alias("text"))


def word_parts(word: Column) -> Column:
    """C-07: what stands before, in and after the letters of a token."""
    part = lambda i: F.regexp_extract(word, r"^([^\p{L}]*)(.*?)([^\p{L}]*)$", i)
    return F.struct(part(1).alias("lead"), part(2).alias("core"), part(3).alias("trail"))


def tag_coverage(verses: DataFrame, tagged: DataFrame) -> DataFrame:
    """A-12: the share of words that are tagged. verses: ref, text; tagged: ref, tags (a map)."""
    rows = verses.join(tagged, "ref", "left")
    words, tags = F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?"), F.lit(0))), F.coalesce(F.size("tags"), F.lit(0))
    return rows.agg(F.sum(words).alias("words"), F.sum(F.greatest(tags, F.lit(0))).alias("tagged")).withColumn("share", F.col("tagged") / F.col("words"))


def cited_verses(verses: DataFrame, citations: DataFrame) -> DataFrame:
    """A-14: of each chapter, the verses that anything cites."""
    return verses.join(citations.select("reference"), "reference", "left_semi").groupBy("chapter_id").agg(F.count("*").alias("cited"))


def overlap(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """W-07: whether two closed intervals share a number."""
    return (a_first <= b_last) & (b_first <= a_last)


def without_junk_runs(rows: DataFrame, id_col: str, text: str, junk: str, least: int = 8) -> DataFrame:
    """W-09: texts without runs of at least `least` tokens that match `junk`. A text's tokens are folded once: each token learns how long its run is."""
    words = F.split(F.trim(F.col(text)), r"\s+")
    state = lambda run, out: F.struct(run.alias("run"), out.alias("out"))
    none = F.slice(F.array(F.lit("")), 1, 0)
    flush = lambda a: F.when(F.size(a["run"]) >= least, a["out"]).otherwise(F.concat(a["out"], a["run"]))
    fold = F.aggregate("w", state(none, none), lambda a, x: F.when(x.rlike(junk), state(F.concat(a["run"], F.array(x)), a["out"])).otherwise(state(none, F.concat(flush(a), F.array(x)))), flush)
    return rows.select(id_col, words.alias("w")).select(id_col, F.array_join(fold, " ").alias(text))


def by_tier(hits: DataFrame, tiers: dict[str, int], last: int = 3) -> DataFrame:
    """T-05: a query's hits by the tier of their kind, keeping their order within it. Adds tier and place."""
    tier = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in tiers.items()], F.lit(last))
    rows = hits.withColumn("tier", tier)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("tier", "rank")).cast("long"))


def first_key_verses(results: DataFrame, most: int = 3) -> DataFrame:
    """T-09: the first results that have a key verse."""
    return capped(results.filter("key_verse IS NOT NULL"), "query", most, F.col("rank"))


def search_notes(notes: DataFrame, phrases: DataFrame, limit: int = 40) -> DataFrame:
    """X-05 (Q-12): phrases in notes; deleted notes count in the statistics but aren't found. notes: id, text, deleted_at."""
    scores = S.search_phrase(S.indexed(notes, "id", {"text": 1.0}), phrases)
    return S.ranked(scores.join(notes.filter("deleted_at IS NULL").select(F.col("id").alias("doc")), "doc"), limit)


def prepared(pieces: DataFrame, vectors: DataFrame, model: str, current: str | None) -> tuple[DataFrame, DataFrame]:
    """V-02, V-06: what is to be embedded, and the vectors that still count: none if they are another model's."""
    usable = vectors if model == current else vectors.limit(0)
    return pieces.join(usable.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"]), usable


def query_vector(text: str, embed: Callable[[list[str]], list[list[float]]]) -> list[float] | None:
    """V-04: one query's vector, tried once; None means keyword search alone."""
    try:
        return embed([text])[0]
    except Exception:  # noqa: BLE001 - whatever fails in the service, the search goes on without it
        return None


def tagged(tags: DataFrame, assignments: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D-07: added (name, target, at): tags by name in any case, found or made; an assignment that was deleted is revived. tags: name; assignments: tag, target, at, deleted_at."""
    known = tags.select(F.lower("name").alias("low"), "name").groupBy("low").agg(F.min("name").alias("name"))
    named = added.withColumn("low", F.lower("name")).join(known.withColumnRenamed("name", "known"), "low", "left").withColumn("name", F.coalesce("known", "name"))
    made = named.filter("known IS NULL").groupBy("low").agg(F.min("name").alias("name")).select("name")
    fresh = named.select(F.col("low").alias("tag"), "target", "at", F.lit(None).cast("string").alias("deleted_at"))
    return tags.select("name").union(made), upserted(assignments, fresh, ["tag", "target"])


def saved_sessions(sessions: DataFrame, states: DataFrame) -> DataFrame:
    """D-09: states (uid, title, updated_at and any fields) as JSON, replacing those with the same uid."""
    fields = [c for c in states.columns if c not in ("uid", "title", "updated_at")]
    new = states.select("uid", "title", F.to_json(F.struct(*fields)).alias("data"), "updated_at")
    return upserted(sessions.select("uid", "title", "data", "updated_at"), new, ["uid"])


def rebuilt(rows: DataFrame, problems: DataFrame, path: str) -> DataFrame:
    """D-18, Q-V4: writes a curated table anew if its checks (rule, n) found nothing, and reads it; else raises with what they found."""
    found = problems.filter("n > 0").orderBy("rule").limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']}" for r in found))
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def lexicon_rows(entries: DataFrame, glosses: DataFrame, language: str, most: int = 4) -> DataFrame:
    """C-11: dictionary entries with their first glosses, numbered as in the dictionary. Aramaic words say so in their derivation."""
    rows = entries.join(glosses, "strongs", "left")
    own = F.when(F.col("derivation").rlike(r"(?i)\((?:aramaic|chaldee)\)"), "aramaic").otherwise(language)
    return rows.select(
        "strongs", own.alias("language"), "lemma", F.col("xlit").alias("transliteration"), F.col("pron").alias("pronunciation"), "derivation", F.trim("strongs_def").alias("definition"),
        F.col("kjv_def").alias("kjv_renderings"), F.array_join(F.slice("glosses", 1, most), "; ").alias("gloss"), F.substring("strongs", 2, 9).try_cast("int").alias("number"),
    )


def next_real(paragraphs: DataFrame, doc: str, pos: str, text: str, noise: str) -> DataFrame:
    """F-19: each paragraph with the next one that isn't noise."""
    real = F.when(~F.col(text).rlike(noise) & (F.trim(text) != ""), F.col(text))
    after = W.partitionBy(doc).orderBy(pos).rowsBetween(1, W.unboundedFollowing)
    return paragraphs.withColumn("next", F.first(real, ignorenulls=True).over(after))


def link_key(prefixes: tuple[str, str] = ("a", "b")) -> Column:
    """F-21: both ends of a user's link as one key."""
    return F.struct(*[F.col(f"{p}_{c}") for p in prefixes for c in ("volume", "book", "chapter", "start", "end")])


def device_file(device: Column) -> Column:
    """F-21: the file name of a device's snapshot."""
    return F.concat(F.lit("device-"), device, F.lit(".json"))


def volume_texts(verses: DataFrame, slug: str) -> DataFrame:
    """F-22: a volume's references and texts in the order of ids."""
    return verses.filter(F.col("volume_slug") == slug).select("verse_id", "reference", "text").orderBy("verse_id")


def nested_update(spark: SparkSession, old: DataFrame, new: DataFrame, path: str) -> None:
    """K-04: reference, works (an array) written as one versioned folder of JSON lines: new references replace old ones, others stay."""
    upserted(old, new, ["reference"]).orderBy("reference").write.mode("errorifexists").json(path)
