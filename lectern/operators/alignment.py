"""Operators that depend on order or on aligned texts: J-15, J-17, F-16."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.alignment import ratio_of, transferred

WORD = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)?")


def borrowed_labels(verses: DataFrame, tagged: DataFrame, band: int = 4, least: float = 0.5) -> DataFrame:
    """J-15: verses (id, book, chapter, verse, text) take the word labels of the most similar tagged verse (book, chapter, verse, text, tags: position ->
    numbers) of the same chapter within `band` numbers: id, position, numbers. The chapter is the equi-join key; the band only filters."""
    near = verses.select("id", "book", "chapter", F.col("verse").alias("own"), F.col("text").alias("mine")).join(tagged, ["book", "chapter"])
    near = near.filter(F.abs(F.col("own") - F.col("verse")) <= band)

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        lists = ([w.lower() for w in WORD.findall(x or "")] for x in a), ([w.lower() for w in WORD.findall(x or "")] for x in b)
        return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(*lists, strict=True)], dtype="float64")

    def labels(mine: pd.Series, text: pd.Series, tags: pd.Series) -> pd.Series:
        out = []
        for m, t, own in zip(mine, text, tags, strict=True):
            own = dict(own)
            source = [(w, list(own.get(i, ()))) for i, w in enumerate(WORD.findall(t or ""))]
            out.append([{"position": k, "numbers": v} for k, v in sorted(transferred(WORD.findall(m or ""), source).items())])
        return pd.Series(out)

    scored = near.withColumn("ratio", F.pandas_udf(ratios, "double")("mine", "text")).filter(F.col("ratio") >= least)
    best = scored.groupBy("id").agg(F.max_by(F.struct("mine", "text", "tags"), F.struct("ratio", -F.abs(F.col("own") - F.col("verse")), -F.col("verse"))).alias("b"))
    found = F.pandas_udf(labels, "array<struct<position:int,numbers:array<string>>>")
    return best.select("id", F.explode(found("b.mine", "b.text", "b.tags")).alias("l")).select("id", "l.position", "l.numbers")


def speaker_marks(speaker: str | None) -> list[str]:
    """J-17: what names a speaker in a byline: the first name or initial if there is more than one name, and the surname."""
    names = [n for n in re.sub("[.,]", "", (speaker or "").upper()).split() if n not in ("JUN", "SEN", "JR", "SR")]
    return list(dict.fromkeys([*names[:1], *names[-1:]]))


def in_step(candidates: list[tuple[int, set[str], str]], entries: list[tuple[int, set[str], str]], ahead: int = 8, least: int = 2) -> dict[int, int]:
    """J-17 for one volume: candidates (place, title words, text nearby) and entries (number, title words, speaker), both in the order of the
    book -> place by number. Each candidate takes, of the next `ahead` entries behind the last one taken, the one with most shared title words
    (two, or all of a shorter title, at least); if there is none, the first whose speaker is named nearby. Entries passed over stay unmatched."""
    matched: dict[int, int] = {}
    behind = 0

    def claim(words: set[str], nearby: str, title: set[str], speaker: str) -> tuple[int, int] | None:
        shared = len(words & title)
        if title and shared >= min(least, len(title)):
            return 0, -shared
        return (1, 0) if any(m in nearby.upper() for m in speaker_marks(speaker)) else None

    for place, words, nearby in candidates:
        claims = [(*c, at) for at, (_, title, speaker) in enumerate(entries[behind : behind + ahead], behind) if (c := claim(words, nearby, title, speaker))]
        if claims:
            at = min(claims)[-1]
            matched[entries[at][0]] = place
            behind = at + 1
    return matched


def aligned_titles(candidates: DataFrame, entries: DataFrame, ahead: int = 8) -> DataFrame:
    """J-17: volume, place, words (array), nearby and volume, number, words, speaker -> volume, number, place. A volume is a group of its own, and takes time in proportion to its candidates."""

    def run(c: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        c, e = c.sort_values("place"), e.sort_values("number")
        found = in_step(
            [(p, set(w), n or "") for p, w, n in zip(c["place"], c["words"], c["nearby"], strict=True)], [(n, set(w), s) for n, w, s in zip(e["number"], e["words"], e["speaker"], strict=True)], ahead
        )
        volume = c["volume"].iloc[0] if len(c) else None
        return pd.DataFrame([(volume, n, p) for n, p in found.items()], columns=["volume", "number", "place"])

    return candidates.groupBy("volume").cogroup(entries.groupBy("volume")).applyInPandas(run, "volume long, number long, place long")


def link_spans(verses: DataFrame, links: dict[str, tuple[str, str | None]], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """F-16: places of names in texts: id, start, end, target, tip. The longest name wins; a hyphen is part of a word, so parts of hyphenated names aren't names.
    links: spelling -> (name, meaning); a names' table is small, so it goes along as one compiled pattern."""
    names = sorted(links, key=lambda s: (-len(s), s))
    pattern = re.compile(rf"(?<![\w-])(?:{'|'.join(map(re.escape, names))})(?![\w-])") if names else None

    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = pattern.finditer(t or "") if pattern else ()
            out.append([{"start": m.start(), "end": m.end(), "target": links[m[0]][0], "tip": ": ".join(x for x in links[m[0]] if x)} for m in found])
        return pd.Series(out)

    udf = F.pandas_udf(spans, "array<struct<start:int,end:int,target:string,tip:string>>")
    return verses.select(id_col, F.explode(udf(text_col)).alias("s")).select(id_col, "s.*")
