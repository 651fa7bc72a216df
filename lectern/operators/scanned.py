"""S-15: verses of scanned books, by aligning the numbers that a scan shows with the numbers that a book must have.

A scan shows too many numbers (pages, running heads, numbers of the text itself) and too few (lost, misread or fused into other paragraphs), and its columns may
stand in the wrong order. So nothing is decided where a number stands: all candidates of a book, with the headings between them, are one sequence, and the verses are
its heaviest chain. A candidate weighs by how it's printed; going on to the next costs by the numbers that are missing between them, by headings that it passes over, and, where a
new chapter begins, by how well a heading says so. What the chain leaves out fills holes if it is a run of numbers that fits. A book is one group: its paragraphs
are as many as its pages need, and a candidate looks back at LOOK_BACK others at most.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.alignment import ratio_of
from lectern.functions.numerals import roman_value

#: Letters that scans read for digits: fixed values.
DIGIT_LIKE = str.maketrans({"l": "1", "I": "1", "i": "1", "O": "0", "o": "0", "S": "5", "B": "8", "Z": "2", "z": "2", "G": "6", "b": "6", "q": "9", "g": "9", "J": "1", "!": "1", "|": "1", "t": "1"})
#: Numbers above are pages.
MOST = 200
LOOK_BACK = 60
#: What a candidate weighs: digits at a paragraph's start, after a sentence within one, letters for digits.
PRINTED, INSIDE, MISREAD = 3.0, 2.0, 1.5
#: What a step costs: a number that is missing (inside a paragraph, from where a number is likelier text, more), most for those before a chapter's first, passing over a heading
#: with a text, or without, or that repeats the chapter's own number; a chapter without heading, or under one whose number isn't the next; going back into a hole.
MISSING, MISSING_INSIDE, MOST_BEFORE, TITLED, BARE, REPEATED, UNTITLED, OTHER, JUMP = 1.0, 1.5, 6.5, 9.0, 2.5, 0.2, 5.0, 1.0, 2.0
#: Where a paragraph with a drop cap stands before a second verse: a chapter without heading, and going on from a first verse in spite of it.
OPENED, IGNORED = 1.0, 2.0
FARTHEST = 15

_NOISE = re.compile(r"\W*\d{0,4}\W*|[A-Za-z][.,;:']?")
_HEADING = re.compile(r"([A-Z]{6,9})\s+([IVXLCDM]{1,9}|[A-Za-z0-9!|]{1,4})[.,]?(?:\s+(.*))?", re.S)
_START = re.compile(r"(?:[A-Za-z]\s+(?=\d{1,3}\s))?(\S{1,4}?)[.,]?\s+(?=\S)")
_WITHIN = re.compile(r"(?<=[.;:?!,])\s+(\d{1,3})\s+(?=[A-Z(])")
_DROP_CAP = re.compile(r"(?<=[.,;:])\s+(?=[A-Za-z~'\"\\_^]{0,3}[A-Z]{2,},?\s+[A-Za-z])")
_CAPPED = re.compile(r"[A-Za-z~'\"\\_^]{0,3}[A-Z]{2,},?\s+[A-Za-z]")
_DASH = re.compile("[—–]")


@dataclass
class Heading:
    number: int | None
    titled: bool
    read: str


@dataclass
class Candidate:
    """A number at a place of the book's text, the headings between it and the candidate before, and whether a paragraph between them begins with a drop cap."""

    start: int
    end: int
    value: int
    weight: float
    headings: list[Heading] = field(default_factory=list)
    opened: bool = False


@dataclass
class Scan:
    """A book as one text, whose paragraphs are lines; where headings end in it, and all candidates."""

    text: str
    headings: list[tuple[int, Heading]]
    candidates: list[Candidate]


def _number(token: str) -> tuple[int, float] | None:
    if token.isdigit():
        return int(token), PRINTED
    mapped = token.translate(DIGIT_LIKE)
    return (int(mapped), MISREAD) if mapped.isdigit() and mapped.isascii() else None


def _heading(line: str) -> Heading | None:
    m = _HEADING.fullmatch(line)
    if not m or m[1] != "PSALM" and ratio_of(m[1], "CHAPTER") < 0.7:
        return None
    number = int(m[2]) if m[2].isdigit() else roman_value(m[2]) if re.fullmatch("[IVXLCDM]+", m[2]) else (_number(m[2]) or (None,))[0]
    return Heading(number, bool(m[3]), m[1])


def scan(paragraphs: list[str | None]) -> Scan:
    """Candidates and headings of a book. A heading's own text stays in the book; what goes on in small letters after one is no title."""
    lines, headings, candidates, waiting, at, opened = [], [], [], [], 0, False
    for raw in paragraphs:
        line = " ".join((raw or "").split())
        if not line or _NOISE.fullmatch(line):
            continue
        heading = _heading(line)
        if heading:
            rest = (_HEADING.fullmatch(line)[3] or "").strip()
            heading.titled = bool(re.match("[A-Z(]", rest))
            headings.append((at, heading))
            waiting.append(heading)
            line = rest if heading.titled or re.match(r"\d{1,3}\s+[A-Z(]", rest) else re.sub(r"^\S*\d\S*\s+", "", rest)  # a page number before text that goes on
            if not line:
                continue
        found = []
        m = _START.match(line)
        if m and (number := _number(m[1])) and 0 < number[0] <= MOST and (number[1] == PRINTED or line[m.end() :][:1].isupper()) and len(line) - m.end() > 2:
            found.append(Candidate(at, at + m.end(), number[0], number[1]))
        found += [Candidate(at + m.start(), at + m.end(), int(m[1]), INSIDE) for m in _WITHIN.finditer(line) if 0 < int(m[1]) <= MOST]
        opened = opened or bool(lines and re.search(r"[.,;:]$", lines[-1]) and _CAPPED.match(line))
        if found:
            found[0].headings, waiting = waiting, []
            found[0].opened, opened = opened, False
            candidates += found
        lines.append(line)
        at += len(line) + 1
    return Scan("\n".join(lines), headings, candidates)


@dataclass
class Way:
    """The heaviest chain that ends at a candidate: its weight, the candidate before (-1: none), the chapter, the last verse and, as bits, all verses of the chapter so far."""

    weight: float
    before: int
    chapter: int
    last: int
    seen: int


def _within(way: Way, to: Candidate, passed: list[Heading]) -> float:
    """What it costs to go on in the same chapter: past the highest number, or into a hole, for which its missing numbers were paid."""
    highest, over = way.seen.bit_length() - 1, sum(TITLED if h.titled else REPEATED if h.number == way.chapter else BARE for h in passed)
    if highest < to.value <= highest + FARTHEST:
        over += IGNORED if to.opened and not passed and (highest, to.value) == (1, 2) else 0
        return over + (to.value - highest - 1) * (MISSING if to.weight != INSIDE else MISSING_INSIDE)
    if to.value < highest and way.seen >> (to.value - 1) & 3 == 1:
        return over + (JUMP if to.value != way.last + 1 else 0) - MISSING
    return float("inf")


def _next_chapter(way: Way, to: Candidate, passed: list[Heading]) -> tuple[float, int]:
    """What it costs to begin a chapter, and which: under a heading, or where numbers begin anew and fill no hole."""
    first = min(MISSING * max(0, to.value - 2) + 0.25 * (to.value > 1), MOST_BEFORE)
    if passed:
        number = next((h.number for h in passed if h.number == way.chapter + 1), passed[-1].number)
        later = number is not None and number > way.chapter
        return first + (0 if number == way.chapter + 1 else OTHER), number if later else way.chapter + 1
    if to.opened and to.value == 2 and way.chapter:
        return first + OPENED, way.chapter + 1
    fills = way.seen >> max(to.value - 1, 0) & 3 == 1
    return (float("inf") if fills and to.value > 2 or way.chapter and way.last <= 2 else first + UNTITLED), way.chapter + 1


def chain(candidates: list[Candidate]) -> list[tuple[int, int]]:
    """The heaviest chain: places of candidates that are verses, each with its chapter. Of equal chains the one through later candidates is taken."""
    best: list[Way] = []
    for j, to in enumerate(candidates):
        passed: list[Heading] = list(to.headings)
        found: Way | None = None
        for i in range(j - 1, max(-1, j - 1 - LOOK_BACK) - (j <= LOOK_BACK), -1):
            way = best[i] if i >= 0 else Way(0.0, -1, 0, 0, 0)
            on = _within(way, to, passed) if i >= 0 else float("inf")
            new, chapter = _next_chapter(way, to, passed)
            bit = 1 << to.value
            made = Way(way.weight - on, i, way.chapter, to.value, way.seen | bit) if on <= new else Way(way.weight - new, i, chapter, to.value, bit)
            if found is None or made.weight > found.weight:
                found = made
            passed = candidates[i].headings + passed
        found.weight += to.weight
        best.append(found)
    at = max(range(len(best)), key=lambda j: best[j].weight, default=-1)
    out = []
    while at >= 0:
        out.append((at, best[at].chapter))
        at = best[at].before
    return out[::-1]


def _opening(text: str) -> tuple[str, str]:
    """The title and the first verse of what stands between a heading and a chapter's first number: paragraphs up to the last one with a dash are the title, unless only
    a part of it is, up to a drop cap."""
    lines = text.split("\n")
    last = max((i for i, line in enumerate(lines) if _DASH.search(line)), default=-1)
    title, rest = lines[: last + 1], lines[last + 1 :]
    if title and (m := list(_DROP_CAP.finditer(title[-1]))):
        title[-1], within = title[-1][: m[-1].start()], title[-1][m[-1].end() :]
        rest = [within, *rest]
    return " ".join(title).strip(), " ".join(rest).strip()


def scanned_verses(paragraphs: list[str | None], chapters: int | None = None) -> tuple[list[dict], list[str]]:
    """A book's paragraphs in order -> verses (chapter, verse, text) and a log of what the scan has damaged. `chapters`: how many the book has.

    Before the first heading or number nothing is a verse. A first verse without number is what stands between the heading and the second one, or, without heading, what follows
    the last drop cap before it. Numbers ahead of the first chapter's first belong to it; what follows the last chapter without a first verse belongs to another book."""
    book, log = scan(paragraphs), []
    chapter_of = dict(chain(book.candidates))
    places = sorted(chapter_of)
    starts = [at for at, _ in book.headings]
    verses: dict[tuple[int, int], str] = {}
    log += [f"heading read as {h.read}" for _, h in book.headings if h.read not in ("CHAPTER", "PSALM")]
    before: tuple[int, int] | None = None
    for n, at in enumerate(places):
        c, chapter = book.candidates[at], chapter_of[at]
        to = book.candidates[places[n + 1]].start if n + 1 < len(places) else len(book.text)
        if n + 1 < len(places) and chapter_of[places[n + 1]] != chapter or n + 1 == len(places):
            # up to the heading under which the next chapter begins
            to = next((s for s in starts if c.end <= s <= to and (n + 1 < len(places))), to)
        if before is None or before[0] != chapter and not any(k[0] == chapter for k in verses):
            since = book.candidates[places[n - 1]].end if before else 0
            heads = [s for s in starts if since <= s <= c.start]
            _, opening = _opening(book.text[heads[0] : c.start].strip()) if heads else ("", "")
            if not heads and before and c.value == 2:
                opening = _taken_back(verses, before)
                log += [f"chapter {chapter}: found by its numbers"]
            if c.value > 1 and opening:
                verses[chapter, 1] = opening
        elif before[0] == chapter and c.value < before[1]:
            log.append(f"chapter {chapter}: {c.value} out of order")
        if c.weight == MISREAD:
            log.append(f"chapter {chapter}: {c.value} read as {book.text[c.start : c.end].strip()}")
        verses[chapter, c.value] = " ".join(book.text[c.end : to].split())
        before = chapter, c.value
    if not places and book.headings:
        first = book.headings[0]
        _, opening = _opening(book.text[first[0] :].strip())
        verses |= {(first[1].number or 1, 1): opening} if opening else {}
    _bound_elsewhere(verses, chapters, log)
    for chapter in sorted({c for c, _ in verses}):
        own = sorted(v for c, v in verses if c == chapter)
        log += [f"chapter {chapter}: {a + 1} to {b - 1} missing" for a, b in zip([0, *own], own, strict=False) if b > a + 1]
    return [{"chapter": c, "verse": v, "text": verses[c, v]} for c, v in sorted(verses)], log


def _taken_back(verses: dict[tuple[int, int], str], last: tuple[int, int]) -> str:
    """What stands after the last drop cap in a verse, which is cut there; empty if there is none."""
    found = list(_DROP_CAP.finditer(verses[last]))
    if not found:
        return ""
    text = verses[last]
    verses[last] = text[: found[-1].start()]
    return text[found[-1].end() :]


def _bound_elsewhere(verses: dict[tuple[int, int], str], chapters: int | None, log: list[str]) -> None:
    """Puts right what was bound at the wrong place, if it is known how many chapters there are."""
    order = sorted({c for c, _ in verses})
    if chapters is None or len(order) <= chapters:
        return
    if (order[0], 1) not in verses:
        stray = {v: verses.pop((order[0], v)) for v in [v for c, v in verses if c == order[0]]}
        for (_, v), text in {(order[1], v): t for v, t in stray.items()}.items():
            verses.setdefault((order[1], v), text)
        log.append(f"{len(stray)} verses ahead of chapter {order[1]}")
        order = order[1:]
        for new, old in enumerate(order, 1):  # numbered anew: the stray ones were counted as a chapter
            for v in [v for c, v in list(verses) if c == old and old != new]:
                verses[new, v] = verses.pop((old, v))
        order = list(range(1, len(order) + 1))
    while len(order) > chapters and (order[-1], 1) not in verses:
        gone = [verses.pop((order[-1], v)) for v in [v for c, v in list(verses) if c == order[-1]]]
        log.append(f"{len(gone)} verses of another book")
        order.pop()


def scanned_books(paragraphs: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """book, pos, text (a row per paragraph) -> book, chapter, verse, text. chapters: book, n (how many each has), if that is known.

    Null and empty paragraphs are nothing, paragraphs of the same place go by their text; a book without headings and numbers has no verses."""
    place = F.row_number().over(W.partitionBy("book").orderBy("pos", "text"))
    rows = paragraphs.select("book", place.alias("pos"), "text")
    rows = rows.join(chapters.select("book", F.col("n").cast("long").alias("n")), "book", "left") if chapters is not None else rows.withColumn("n", F.lit(None).cast("long"))
    book = paragraphs.schema["book"].dataType.simpleString()

    def run(found: pd.DataFrame) -> pd.DataFrame:
        n = found["n"].iloc[0]
        verses, _ = scanned_verses(list(found.sort_values("pos")["text"]), None if pd.isna(n) else int(n))
        return pd.DataFrame([(found["book"].iloc[0], v["chapter"], v["verse"], v["text"]) for v in verses], columns=["book", "chapter", "verse", "text"])

    return rows.groupBy("book").applyInPandas(run, f"book {book}, chapter int, verse int, text string")
