"""Passages, chunks and cards (W-03, W-04, G-01 to G-05, U-01)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import content_hash, range_label


def passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", sep: str = "\n") -> DataFrame:
    """Non-empty paragraphs: doc, pos (from 0, empty ones counted) and text."""
    return docs.select(F.col(doc), F.posexplode(F.split(text, sep)).alias("pos", "text")).filter(F.trim("text") != "")


def windows(rows: DataFrame, chapter: str, number: str, text: str, most: int = 3, chars: int = 2000) -> DataFrame:
    """W-03: overlapping windows of up to `most` verses and `chars` characters; the next starts at the last verse of the one
    before. A verse that is too long alone is a window of its own. Adds first, last, n_chars.

    A chapter's verse lengths are folded in order; the texts aren't part of the fold."""
    lengths = rows.groupBy(chapter).agg(F.array_sort(F.collect_list(F.struct(F.col(number).cast("long").alias("v"), F.length(text).cast("long").alias("n")))).alias("l"))
    none = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("tail"), F.lit(0).cast("long").alias("n"))), 1, 0)

    def one(first, last, size, tail, n):
        return F.struct(first.alias("first"), last.alias("last"), size.alias("size"), tail.alias("tail"), n.alias("n"))

    def step(kept, x):
        now = F.element_at(kept, -1)
        fits = (now["n"] < most) & (now["size"] + x["n"] <= chars)
        longer = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(one(now["first"], x["v"], now["size"] + x["n"], x["n"], now["n"] + 1)))
        overlaps = (now["tail"] + x["n"] <= chars) & (F.lit(most) > 1)
        fresh = F.when(overlaps, one(now["last"], x["v"], now["tail"] + x["n"], x["n"], F.lit(2).cast("long"))).otherwise(one(x["v"], x["v"], x["n"], x["n"], F.lit(1).cast("long")))
        return F.when(F.size(kept) == 0, F.array(one(x["v"], x["v"], x["n"], x["n"], F.lit(1).cast("long")))).when(fits, longer).otherwise(F.concat(kept, F.array(fresh)))

    folded = lengths.select(chapter, F.posexplode(F.aggregate("l", none, step)).alias("window", "w"))
    return folded.select(chapter, F.col("window").cast("long").alias("window"), F.col("w.first").alias("first"), F.col("w.last").alias("last"), F.col("w.size").alias("n_chars"))


def _gathered(units: list[str], sep: str, most: int, enough: int) -> list[str]:
    """Neighbours joined while the whole is at most `most`; what has reached `enough` takes nothing more."""
    out: list[str] = []
    for unit in units:
        if out and len(out[-1]) < enough and len(out[-1]) + len(sep) + len(unit) <= most:
            out[-1] += sep + unit
        else:
            out.append(unit)
    return out


def _sentences(paragraph: str, most: int) -> list[str]:
    """A paragraph's sentences; one of more than `most` characters is cut there, and what is left of it goes on."""
    out: list[str] = []
    for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
        whole = (len(sentence) - 1) // most * most
        out += [sentence[i : i + most] for i in range(0, whole, most)]
        out += filter(None, [sentence[whole:].strip() if whole else sentence])
    return out


def packed(text: str | None, target: int = 1200, most: int = 2000) -> list[str]:
    """W-04: paragraphs packed until a passage has `target` characters, never above `most`. A longer paragraph is first cut at sentence
    ends into units of at most `target`, at worst anywhere."""
    units: list[str] = []
    for paragraph in filter(None, (line.strip() for line in (text or "").split("\n"))):
        units += [paragraph] if len(paragraph) <= most else _gathered(_sentences(paragraph, most), " ", target, most)
    return _gathered(units, "\n\n", most, target)


@F.pandas_udf(T.ArrayType(T.StringType()))
def packed_passages(texts: pd.Series) -> pd.Series:
    return pd.Series([packed(t) for t in texts])


def pack(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """W-04: doc, passage number and text of each packed passage."""
    return docs.select(F.col(doc), F.posexplode(packed_passages(F.col(text))).alias("passage", "text"))


def card(rows: DataFrame, kind: str, key: Column, heading: Column, body: Column, volume: Column | None = None) -> DataFrame:
    """A piece: key, kind, heading, body, volume_slug, content_hash."""
    volume = F.lit(None).cast("string") if volume is None else volume
    out = rows.select(key.cast("string").alias("key"), F.lit(kind).alias("kind"), heading.alias("heading"), body.alias("body"), volume.alias("volume_slug"))
    return out.withColumn("content_hash", content_hash(F.col("heading"), F.col("body")))


def topic_cards(topics: DataFrame, refs: DataFrame, most: int = 80) -> DataFrame:
    """G-01: a topic's description with its key references, then its first others. refs: topic_id, position, reference, is_key."""
    listed = refs.groupBy("topic_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_key"), F.struct("position", "reference")))).alias("keys"), F.array_sort(F.collect_list(F.when(~F.col("is_key"), F.struct("position", "reference")))).alias("rest")
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: x["reference"]), "; ")
    rows = topics.join(listed, topics["id"] == listed["topic_id"], "left")
    body = F.concat_ws("\n", F.col("description"), F.concat(F.lit("Key passages: "), F.nullif(text("keys"), F.lit(""))), F.concat(F.lit("References: "), F.nullif(text(F.slice("rest", 1, most)), F.lit(""))))
    return card(rows, "topic", F.concat(F.lit("topic:"), F.col("slug")), F.col("name"), body)


def link_cards(edges: DataFrame) -> DataFrame:
    """G-02: a sentence for each curated link, by its relationship."""
    verb = (
        F.when(F.col("relationship") == "quotation", "quotes").when(F.col("relationship") == "typology", "foreshadows").when(F.col("relationship") == "translation", "renders")
        .when(F.col("relationship") == "tradition", "shares a tradition with").otherwise("paraphrases")
    )
    a = range_label(F.col("a_book"), F.col("a_chapter"), F.col("a_start"), F.col("a_end"))
    b = range_label(F.col("b_book"), F.col("b_chapter"), F.col("b_start"), F.col("b_end"))
    return card(edges, "cross_reference", F.concat(F.lit("link:"), F.col("id")), F.concat_ws(" ", a, verb, b), F.coalesce("note", F.lit("")), F.col("a_volume"))


def work_cards(works: DataFrame, most: int = 60) -> DataFrame:
    """G-03: a citing work with its first references. works: url, title, speaker, date, label, references (sorted)."""
    return card(works, "work", F.col("url"), F.concat_ws(" — ", "title", "speaker", "label"), F.array_join(F.slice("references", 1, most), "; "))


def note_cards(notes: DataFrame) -> DataFrame:
    """G-04: notes with text that aren't deleted."""
    live = notes.filter("deleted_at IS NULL AND trim(text) <> ''")
    return card(live, "note", F.concat(F.lit("note:"), F.col("id")), F.coalesce("reference", F.lit("Note")), F.col("text"))


def lexicon_cards(entries: DataFrame) -> DataFrame:
    """G-05: a dictionary entry."""
    return card(entries, "lexicon", F.concat(F.lit("word:"), F.col("strongs")), F.concat_ws(" ", "strongs", "lemma", "transliteration"), F.concat_ws("\n", "gloss", "definition", "kjv_renderings"))


def collect_pieces(hidden: tuple[str, ...], *producers: DataFrame) -> DataFrame:
    """U-01: all pieces, those of hidden volumes left out."""
    out = producers[0]
    for p in producers[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("volume_slug").isNull() | ~F.col("volume_slug").isin(list(hidden))) if hidden else out
