"""Sources as tables (S-02 to S-36). Lines and pages that can't be read are counted or left out, never fatal."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import canonical_url, is_page_number, month_year, unescaped
from lectern.operators.stored import small
from lectern.storage import written

VERSE_LINE = r"^(.+?)\s+(\d+):(\d+)\s+(.*\S)\s*$"


def hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """S-02: nested JSON of volumes, testaments and books as one row per book with positions from 1."""
    book = "array<string>"
    schema = f"volumes array<struct<name:string,slug:string,sort_order:int,books:{book},testaments:array<struct<name:string,slug:string,sort_order:int,books:{book}>>>>"
    v = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("volumes").alias("vpos", "v"))
    direct = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("slug"), F.lit(None).cast("int").alias("sort_order"), F.col("v.books").alias("books")))
    t = v.select(F.col("v.name").alias("volume"), F.col("v.slug").alias("volume_slug"), F.coalesce("v.sort_order", F.col("vpos") + 1).alias("volume_sort"), F.explode(F.coalesce("v.testaments", direct)).alias("t"))
    return t.select("volume", "volume_slug", "volume_sort", F.col("t.name").alias("testament"), F.posexplode("t.books").alias("bpos", "book")).withColumn("book_sort", F.col("bpos") + 1).drop("bpos")


def verse_lines(lines: DataFrame, books: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """S-03: value lines "Book c:v text" -> verses of known books, and what was rejected with the reason. aliases: alias, book."""
    part = lambda i: F.nullif(F.regexp_extract("value", VERSE_LINE, i), F.lit(""))
    rows = lines.filter(F.trim("value") != "").select("value", part(1).alias("named"), part(2).try_cast("int").alias("chapter"), part(3).try_cast("int").alias("verse"), part(4).alias("text"))
    if aliases is not None:
        rows = rows.join(aliases, rows["named"] == aliases["alias"], "left").withColumn("named", F.coalesce("book", "named")).drop("alias", "book")
    known = rows.join(books.select(F.col("name").alias("book")), F.col("named") == F.col("book"), "left")
    bad = known.filter("book IS NULL").select("value", F.when(F.col("named").isNull(), "unreadable").otherwise("unknown book").alias("reason"))
    return known.filter("book IS NOT NULL").select("book", "chapter", "verse", "text"), bad


def xml_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """S-04: scanned pages (OBJECT elements with PARAGRAPH, LINE and WORD inside) as ordered paragraphs."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def paragraphs(found: pd.Series) -> pd.Series:
        import xml.etree.ElementTree as ET

        out = []
        for x in found:
            try:
                top = ET.fromstring(x)
                out.append([" ".join(w.text.strip() for w in p.iter("WORD") if w.text and w.text.strip()) for p in top.iter("PARAGRAPH")])
            except ET.ParseError:
                out.append([])
        return pd.Series(out)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select("file", F.posexplode(paragraphs("value")).alias("pos", "text")).filter("text <> ''")


def discourses(spark: SparkSession, path: str, volumes: tuple[int, int] = (1, 26)) -> DataFrame:
    """S-05: JSON lines; records with an error, without paragraphs or of other volumes are left out."""
    rows = spark.read.schema("volume int, title string, speaker string, date string, paragraphs array<string>, error string").json(path)
    return rows.filter(F.col("error").isNull() & (F.size("paragraphs") > 0) & F.col("volume").between(*volumes)).drop("error")


_QUOTES = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"'})


def _plain(marked: str) -> str:
    """Text of the marker language without notes, markers and typographic quotes."""
    bare = re.sub(r"\\(f|x)\s.*?\\\1\*", "", marked, flags=re.S)
    return " ".join(re.sub(r"\\\+?[a-z0-9]+\*?\s?", "", bare).translate(_QUOTES).split())


def _heading(marked: str) -> str:
    """A heading without brackets; one all in capitals in ordinary case, but for the names of languages."""
    text = _plain(marked).strip("[] ")
    return re.sub(r"\b(?:greek|hebrew|chaldee)\b", lambda m: m[0].capitalize(), text.capitalize()) if text.isupper() else text


#: Where a text file's lines end, beside \\n, \\r and \\r\\n, by which Spark reads them.
_ENDS = "[\\x0B\\x0C\\x1C-\\x1E\\u0085\\u2028\\u2029]"


def in_units(lines: DataFrame, key: str, apart: bool = False) -> DataFrame:
    """Lines (key, pos, value, number, unknown, open) as texts that can be read by themselves: key, first, text, a row per unit.

    A unit begins at a heading whose number is higher than any before it can have been (`unknown` counts those that go on from the one before), if nothing is open there (`open` of the last line
    that says so), so in a book in order it is a chapter. If units must be `apart`, no lower number may follow either, so a number is in one unit alone. Lines are dealt by position; what parts hand on, the highest number, the last sign and the last beginning, is a row for each part and key."""
    dealt = written(lines.repartitionByRange(key, "pos").withColumn("part", F.spark_partition_id()))
    own = W.partitionBy("part", key).orderBy("pos")
    above, parts = own.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    below = W.partitionBy("part", key).orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)  # frames that end with the partition take time by its square
    rest = W.partitionBy(key).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    ends = dealt.groupBy(key, "part").agg(F.max("number").alias("n"), F.min("number").alias("l"), F.sum("unknown").alias("u"), F.max_by("open", F.when(F.col("open").isNotNull(), F.col("pos"))).alias("o"))
    ends = ends.select(key, "part", F.max("n").over(parts).alias("n"), F.min("l").over(rest).alias("l"), F.coalesce(F.sum("u").over(parts), F.lit(0)).alias("u"), F.last("o", True).over(parts).alias("o"))
    most = F.greatest(F.col("n"), F.max("number").over(above)) + F.col("u") + F.coalesce(F.sum("unknown").over(above), F.lit(0))
    closed = ~F.coalesce(F.last("open", True).over(above), F.col("o"), F.lit(False))
    least = F.coalesce(F.col("number") <= F.least(F.col("l"), F.min("number").over(below)), F.lit(True)) if apart else F.lit(True)
    begun = dealt.join(small(ends), [key, "part"]).withColumn("begins", F.coalesce((F.col("number") > most) & closed & least, F.lit(False)))
    marked = written(begun.select(key, "part", "pos", "value", F.max(F.when(F.col("begins"), F.col("pos"))).over(own.rowsBetween(W.unboundedPreceding, 0)).alias("unit")))
    before = marked.groupBy(key, "part").agg(F.max("unit").alias("b")).select(key, "part", F.max("b").over(parts).alias("b"))
    whole = marked.join(small(before), [key, "part"]).select(key, F.coalesce("unit", "b").alias("unit"), "pos", "value")
    listed = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return whole.groupBy(key, "unit").agg(F.array_join(F.transform(listed, lambda x: x["value"]), "\n").alias("text")).select(key, F.col("unit").isNull().alias("first"), "text")


def _parsed(units: DataFrame, key: str, parse: Callable[[str, bool], list[dict]], fields: str, most: int = 5_000) -> DataFrame:
    """The rows that `parse` makes of each unit's text, handed on by `most` or a unit's."""
    names = [f.split(":")[0] for f in fields.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for k, first, text in zip(batch[key], batch["first"], batch["text"], strict=True):
                rows += [(k, *(v[n] for n in names)) for v in parse(text, first)]
                if len(rows) >= most:
                    yield pd.DataFrame(rows, columns=[key, *names])
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=[key, *names])

    return units.mapInPandas(run, ", ".join([f"{key} {units.schema[key].dataType.simpleString()}", *(f.replace(":", " ") for f in fields.split(","))]))


def parse_usfm(text: str, first: bool = True) -> list[dict]:
    """S-06: verses of the marker language, each with its chapter's title. A line without a marker goes on with the verse before. Paragraphs
    before the first chapter's first verse are chapter 0, one verse each. Section headings, and paragraphs before a later chapter's first
    verse, make the chapter's title, joined by " · ", but for those that repeat the beginning of the verse they precede. A text that isn't a file's first part
    has a chapter before it."""
    verses: list[dict] = []
    titles: dict[int, list[str]] = {}
    chapters, begun, waiting, prologue, open_verse = [] if first else [0], False, [], [], None
    for line in map(str.strip, (text or "").splitlines()):
        m = re.match(r"\\(\w+)\s?(.*)", line)
        tag, rest = m.groups() if m else (None, line)
        if tag is None:
            if open_verse is not None and rest:
                open_verse["text"] += " " + rest
        elif tag == "c" and (number := re.match(r"\d+", rest)):
            chapters.append(int(number[0]))
            begun, open_verse = False, None
        elif tag in ("s1", "ms1") and chapters:
            waiting.append(_heading(rest))
        elif tag == "p" and rest and chapters and not begun:
            (prologue if len(chapters) == 1 else waiting).append(_plain(rest))
        elif tag == "v" and chapters and (number := re.match(r"(\d+)\s*(.*)", rest)):
            if prologue:
                verses += [{"chapter": 0, "verse": i, "text": p} for i, p in enumerate(prologue, 1)]
                titles[0], waiting, prologue = waiting, [], []
            begins = _plain(number[2])[:40].lower()
            titles.setdefault(chapters[-1], []).extend(h for h in waiting if h[:40].lower() != begins)
            waiting = []
            begun, open_verse = True, {"chapter": chapters[-1], "verse": int(number[1]), "text": number[2]}
            verses.append(open_verse)
    return [v | {"text": _plain(v["text"]), "title": " · ".join(titles.get(v["chapter"], ())) or None} for v in verses]


def usfm_verses(spark: SparkSession, path: str) -> DataFrame:
    """S-06: verses of the files below path. Files are read by lines; a part of one that begins a chapter after a verse is read by itself, unless that or a lower number
    comes again."""
    def marks(values: pd.Series) -> pd.DataFrame:
        out = []
        for line in map(str.strip, values):
            tag, rest = m.groups() if (m := re.match(r"\\(\w+)\s?(.*)", line)) else (None, "")
            number = re.match(r"\d+", rest) if tag in ("c", "v") else None
            out.append((int(number[0]) if number and tag == "c" else None, tag != "v" if number or tag in ("s1", "ms1") else None))
        return pd.DataFrame({"number": pd.array([n for n, _ in out], dtype="Int64"), "open": pd.array([o for _, o in out], dtype="boolean")})

    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), at.alias("at"), F.posexplode(F.split("value", _ENDS)).alias("i", "value"))
    lines = read.withColumn("m", F.pandas_udf(marks, "struct<number:long,open:boolean>")("value")).select("path", F.struct("at", "i").alias("pos"), "value", "m.number", F.lit(0).alias("unknown"), "m.open")
    found = _parsed(in_units(lines, "path", apart=True), "path", parse_usfm, "chapter:int,verse:int,text:string,title:string")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "chapter", "verse", "text", "title")


TAGGED = r'\\\+?w\s+([^|\\]+)\|[^\\]*?strong="([^"]*)"[^\\]*\\\+?w\*'


def tagged_words(verses: DataFrame, text: str) -> DataFrame:
    """S-07: words with their numbers, in order, of verses in the marker language."""
    found = F.regexp_extract_all(text, F.lit(TAGGED), F.lit(0))
    words = F.transform(found, lambda w: F.struct(F.regexp_extract(w, TAGGED, 1).alias("word"), F.split(F.regexp_extract(w, TAGGED, 2), r"[,\s]+").alias("numbers")))
    return verses.withColumn("words", words)


def members_of(archives: DataFrame, pattern: str) -> DataFrame:
    """S-08: archives (path, content) -> their text members whose name matches: path, member, value."""
    name = re.compile(pattern)

    def members(found: pd.Series) -> pd.Series:
        out = []
        for x in found:
            with zipfile.ZipFile(io.BytesIO(bytes(x))) as z:
                out.append([{"member": n, "value": z.read(n).decode("utf-8", "replace")} for n in sorted(z.namelist()) if name.search(n)])
        return pd.Series(out)

    return archives.select("path", F.explode(F.pandas_udf(members, "array<struct<member:string,value:string>>")("content")).alias("m")).select("path", "m.*")


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """S-08: text members of the archives below path."""
    return members_of(spark.read.format("binaryFile").load(path).select("path", "content"), pattern)


def blank_line_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """S-09: paragraphs between blank lines, in order, inner line ends turned into spaces."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = files.select("file", F.posexplode(F.split("value", r"\r?\n[ \t]*\r?\n")).alias("pos", "p"))
    return rows.select("file", "pos", F.trim(F.regexp_replace("p", r"\s+", " ")).alias("text")).filter("text <> ''")


def js_dictionary(files: DataFrame, entry: str = "struct<lemma:string,xlit:string,pron:string,derivation:string,strongs_def:string,kjv_def:string>") -> DataFrame:
    """S-10: value files with a JSON object between the first and the last brace -> key and the entry's fields."""
    body = F.regexp_extract("value", r"(?s)\{.*\}", 0)
    return files.select(F.explode(F.from_json(body, f"map<string,{entry}>")).alias("strongs", "e")).select("strongs", "e.*")


def glosses(lines: DataFrame, letter: str, most: int) -> DataFrame:
    """S-11: tab-separated value lines (key first, gloss seventh) in file order (pos) -> key and its different glosses in order; other languages' keys
    and numbers out of range are left out."""
    cols = F.split("value", "\t")
    key = F.regexp_extract(F.get(cols, F.lit(0)), rf"^({letter})0*(\d+)[A-Za-z]?$", 2).try_cast("int")
    rows = lines.select("pos", key.alias("n"), F.trim(F.get(cols, F.lit(6))).alias("gloss")).filter(F.col("n").between(1, most) & (F.col("gloss") != ""))
    listed = F.array_sort(F.collect_list(F.struct("pos", "gloss")))
    return rows.groupBy(F.concat(F.lit(letter), F.col("n").cast("string")).alias("strongs")).agg(F.array_distinct(F.transform(listed, lambda x: x["gloss"])).alias("glosses"))


HEADING = re.compile(r"\s*chapter\s+([ivxlcdm]+|\d+)\.?\s*$", re.I)


def marked_verses(text: str, tolerance: int = 2) -> list[dict]:
    """S-12, S-13: plain text with "CHAPTER IV" headings and verse numbers in the line; a number only starts a verse if it follows the
    last one within the tolerance."""
    from lectern.functions.numerals import roman_value

    out: list[dict] = []
    chapter, last = 0, 0
    for line in (text or "").splitlines():
        head = HEADING.match(line)
        if head:
            chapter = int(head[1]) if head[1].isdigit() else roman_value(head[1]) or chapter + 1
            last = 0
            continue
        at, parts = 0, []
        for m in re.finditer(r"(?:(?<=\s)|^)(\d{1,3})[.\s]\s*(?=\S)", line):
            if last < int(m[1]) <= last + tolerance:
                parts.append((last, line[at : m.start()]))
                last, at = int(m[1]), m.end()
        parts.append((last, line[at:]))
        for n, body in parts:
            body = " ".join(body.split())
            if not body or not chapter or not n:
                continue
            if out and (out[-1]["chapter"], out[-1]["verse"]) == (chapter, n):
                out[-1]["text"] += " " + body
            else:
                out.append({"chapter": chapter, "verse": n, "text": body, "heading": None})
    return out


def marked_books(books: DataFrame) -> DataFrame:
    """S-12, S-13: book, text -> book, chapter, verse, text."""
    return marked_lines(books.select("book", F.posexplode(F.split("text", "\r\n|[\n\r]|" + _ENDS)).alias("pos", "value")))


def marked_lines(lines: DataFrame) -> DataFrame:
    """S-12, S-13: the lines of books (book, pos, value) -> book, chapter, verse, text."""
    from lectern.functions.numerals import roman_value

    def marks(values: pd.Series) -> pd.DataFrame:
        heads = [HEADING.match(v or "") for v in values]
        numbers = [h and (int(h[1]) if h[1].isdigit() else roman_value(h[1]) or None) for h in heads]
        return pd.DataFrame({"number": pd.array(numbers, dtype="Int64"), "unknown": [int(h is not None and n is None) for h, n in zip(heads, numbers, strict=True)]})

    known = lines.withColumn("m", F.pandas_udf(marks, "struct<number:long,unknown:int>")("value")).select("book", "pos", "value", "m.number", "m.unknown", F.lit(None).cast("boolean").alias("open"))
    return _parsed(in_units(known, "book"), "book", lambda text, _: marked_verses(text), "chapter:int,verse:int,text:string")


def section_starts(paragraphs: DataFrame, titles: DataFrame) -> DataFrame:
    """S-14: doc, pos, text and titles (place, title) -> doc, place, title, pos: where each title's section starts, in the order of titles; each is looked
    for behind the last one found, and what isn't found is left out.

    A title page is in capitals, doesn't end with a digit, has a word that is the title's name but for one letter in six, and three words if the
    title is numbered; an empty paragraph, a page or verse number or a small letter behind it shows that it is a running head. A name that may have k
    wrong letters is cut into k + 1 pieces, one of which a word must have whole, at most k places aside: these are the keys. Only the order is folded, over a document's few candidates."""
    after = F.trim(F.lead("text").over(W.partitionBy("doc").orderBy("pos")))
    real = after.isNotNull() & (after != "") & ~is_page_number(after) & ~after.rlike(r"^\d{1,3}\s") & ~after.rlike(r"^\p{Ll}")
    pages = paragraphs.withColumn("real", real).withColumn("t", F.trim("text")).filter("real").filter(F.col("t").rlike(r"^[A-Z][A-Z0-9 .,';]{2,100}$") & ~F.col("t").rlike("[0-9]$"))
    words = F.split(F.replace(F.regexp_replace("t", r"\.+$", ""), F.lit(","), F.lit("")), r"\s+")
    named = pages.select("doc", "pos", F.size(F.split("t", r"\s+")).alias("words"), F.explode(F.array_distinct(words)).alias("w")).withColumn("n", F.length("w"))
    core, numbered = F.upper(F.regexp_replace("title", r"^[123]\s+", "")), F.col("title").rlike(r"^[123]\s")
    sized = titles.select("place", "title", core.alias("core"), F.when(numbered, 3).otherwise(1).alias("least")).withColumn("slack", F.greatest(F.lit(1), F.floor(F.length("core") / 6)).cast("int"))
    size, k = F.length("core"), F.col("slack")
    cut = lambda i: F.floor(i * size / (k + 1)).cast("int")
    pieces = sized.select("*", F.explode(F.sequence(F.lit(0), k)).alias("i")).select("*", cut(F.col("i")).alias("start"), (cut(F.col("i") + 1) - cut(F.col("i"))).alias("long"))
    pieces = pieces.withColumn("piece", F.substring("core", F.col("start") + 1, F.col("long"))).withColumn("n", F.explode(F.sequence(size - k, size + k))).withColumn("from", F.explode(F.sequence(F.col("start") - k, F.col("start") + k)))
    pieces = pieces.filter((F.col("from") >= 0) & (F.col("from") + F.col("long") <= F.col("n")))
    keyed = named.join(pieces.select("n", "from", "long").distinct(), "n").withColumn("piece", F.substring("w", F.col("from") + 1, F.col("long")))
    hit = keyed.join(pieces.select("n", "from", "long", "piece", "place", "title", "core", "slack", "least"), ["n", "from", "long", "piece"])
    hit = hit.filter((F.levenshtein("w", "core") <= F.col("slack")) & (F.col("words") >= F.col("least")))
    found = hit.groupBy("doc", "place", "title").agg(F.array_sort(F.collect_set(F.col("pos").cast("long"))).alias("at"))
    listed = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "title", "at"))).alias("l"))
    last = lambda kept: F.coalesce(F.get(kept, F.size(kept) - 1)["pos"], F.lit(-1).cast("long"))
    none = F.transform(F.slice("l", 1, 0), lambda x: F.struct(x["place"], x["title"], F.lit(0).cast("long").alias("pos")))

    def step(kept, x):
        start = F.get(F.filter(x["at"], lambda p: p > last(kept)), F.lit(0))
        return F.when(start.isNull(), kept).otherwise(F.concat(kept, F.array(F.struct(x["place"], x["title"], start.alias("pos")))))

    return listed.select("doc", F.explode(F.aggregate("l", none, step)).alias("s")).select("doc", "s.place", "s.title", "s.pos")


def boundaries(candidates: list[int], window: int = 4) -> list[int]:
    """S-16: candidates near the last one kept belong to it."""
    kept: list[int] = []
    for c in sorted(set(candidates)):
        if not kept or c - kept[-1] > window:
            kept.append(c)
    return kept


def kept_boundaries(rows: DataFrame, volume: str, places: str, window: int = 4) -> DataFrame:
    """S-16: each volume's candidate places (an array) without those near the last one kept."""
    kept = F.pandas_udf(lambda found: pd.Series([boundaries([int(p) for p in x], window) for x in found]), "array<long>")
    return rows.select(volume, F.explode(kept(places)).alias("place"))


LINK = r"""(?i)<a\b[^>]*?href\s*=\s*["']([^"'#]+)[^>]*>"""


def page_links(pages: DataFrame, html: str, without: str | None = None) -> DataFrame:
    """S-20: each page with its different links in order of the alphabet; those that match `without` are left out."""
    links = F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))))
    return pages.withColumn("links", F.filter(links, lambda x: ~x.rlike(without)) if without else links)


def page_title(html: Column) -> Column:
    """S-19: the title element's text, space squeezed."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))


def page_meta(html: Column, name: str) -> Column:
    """S-19: a meta element's content by name or property."""
    return F.nullif(unescaped(F.regexp_extract(html, rf"""(?is)<meta[^>]*(?:name|property)\s*=\s*["']{name}["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)), F.lit(""))


def article_references(pages: DataFrame, html: str) -> DataFrame:
    """S-19, S-21: links like /scriptures/<volume>/<book>/<chapter>?id=p1-p3 as one row per verse."""
    pattern = r"/scriptures/([a-z-]+)/([a-z0-9-]+)/(\d+)(?:\?[^\"'#]*?id=p(\d+)(?:-p(\d+))?)?"
    found = F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)))).alias("link")
    rows = pages.select("page_id", found)
    part = lambda i: F.nullif(F.regexp_extract("link", pattern, i), F.lit(""))
    rows = rows.select("page_id", part(1).alias("volume"), part(2).alias("book"), part(3).cast("int").alias("chapter"), part(4).try_cast("int").alias("first"), part(5).try_cast("int").alias("last"))
    return rows.withColumn("verse", F.explode_outer(F.when(F.col("first").isNotNull(), F.sequence("first", F.greatest("first", F.coalesce("last", "first")))))).drop("first", "last").distinct()


def citation_rows(pages: DataFrame, html: str) -> DataFrame:
    """S-17: index pages' list items with a link: title, speaker, date, canonical URL; items without a link are left out."""
    items = F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)(?:</li>|(?=<li\b)|</ul>)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(items).alias("pos", "item"))
    text = lambda cls: F.nullif(F.trim(unescaped(F.regexp_extract("item", rf'(?is)class="{cls}"[^>]*>(.*?)<', 1))), F.lit(""))
    url = F.nullif(F.regexp_extract("item", LINK, 1), F.lit(""))
    return rows.select("page_id", "pos", text("title").alias("title"), text("speaker").alias("speaker"), text("date").alias("date"), canonical_url(url).alias("url")).filter("url IS NOT NULL")


def verse_citations(spark: SparkSession, path: str) -> DataFrame:
    """S-22: a JSON map of references to citing works, one row for each; a missing file gives none when the caller lists existing ones."""
    rows = spark.read.schema("_harvested string, citations map<string,array<struct<talk_title:string,speaker:string,date:string,url:string>>>").json(path, multiLine=True)
    return rows.select(F.explode("citations").alias("reference", "works")).select("reference", F.posexplode("works").alias("pos", "w")).select("reference", "pos", "w.*")


def article_citations(spark: SparkSession, path: str) -> DataFrame:
    """S-23: articles with their references turned into one row per reference."""
    work = "struct<url:string,talk_title:string,speaker:string,date:string,references:array<string>>"
    rows = spark.read.schema(f"articles array<{work}>").json(path, multiLine=True).select(F.explode("articles").alias("a"))
    return rows.select(F.explode("a.references").alias("reference"), "a.talk_title", "a.speaker", "a.date", "a.url")


def citing_works(citations: DataFrame) -> DataFrame:
    """S-24: one row for each URL: its different references, sorted, and the first-seen fields. citations: seq, url, title, speaker, date, reference."""
    first = F.min_by(F.struct("title", "speaker", "date"), "seq")
    rows = citations.groupBy("url").agg(first.alias("f"), F.array_sort(F.collect_set("reference")).alias("references"))
    return rows.select("url", "f.*", "references").withColumn("published", month_year(F.col("date")))


def book_ids(books: DataFrame, overrides: DataFrame) -> DataFrame:
    """S-18: ids by place in the list, but for irregular ones (name, id)."""
    numbered = books.withColumn("n", F.row_number().over(W.orderBy("place")))
    return numbered.join(overrides.select(F.col("name").alias("o"), "id"), F.col("name") == F.col("o"), "left").select("name", F.coalesce("id", "n").alias("id"))


def device_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "device-*.json") -> DataFrame:
    """S-25: one JSON file for each device, by name; files that can't be read are left out."""
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(with_bad).json(f"{folder}/{pattern}", multiLine=True, columnNameOfCorruptRecord="_bad")
    return rows.select("*", F.col("_metadata.file_name").alias("file")).filter("_bad IS NULL").drop("_bad")


def first_feed_item(feeds: DataFrame, xml: str) -> DataFrame:
    """S-29: the first item of an RSS text: title, link, author, published; feeds that can't be read are left out."""
    item = F.regexp_extract(xml, r"(?is)<item\b[^>]*>(.*?)</item>", 1)
    field = lambda n: F.nullif(F.trim(unescaped(F.regexp_replace(F.regexp_extract(item, rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1), r"^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1"))), F.lit(""))
    day = F.try_to_timestamp(F.regexp_extract(field("pubDate"), r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return feeds.select(*[c for c in feeds.columns if c != xml], field("title").alias("title"), field("link").alias("link"), field("dc:creator").alias("author"), day.alias("published")).filter("title IS NOT NULL AND link IS NOT NULL")


def current_week(lessons: DataFrame, today: Column) -> DataFrame:
    """S-30: lessons (title, year, span like "March 4-10" or "March 25-April 7") whose days include today."""
    span = r"^\s*([A-Z][a-z]+) (\d{1,2})\s*[-–]\s*(?:([A-Z][a-z]+) )?(\d{1,2})\s*$"
    part = lambda i: F.nullif(F.regexp_extract("span", span, i), F.lit(""))
    day = lambda month, d: F.to_date(F.try_to_timestamp(F.concat_ws(" ", d, month, F.col("year").cast("string")), F.lit("d MMMM yyyy")))
    rows = lessons.withColumn("first", day(part(1), part(2))).withColumn("end", day(F.coalesce(part(3), part(1)), part(4)))
    rows = rows.withColumn("last", F.when(F.col("end") < F.col("first"), F.add_months("end", 12)).otherwise(F.col("end"))).drop("end")
    return rows.filter(today.between(F.col("first"), F.col("last")))


def page_section(pages: DataFrame, html: str, base: str, section: str = "blockquote") -> DataFrame:
    """S-31: quote, author, byline (may be empty) and absolute link of a page's first section of that class; pages without a section, or whose section lacks
    a quote, a link or an author, are left out. A section ends with its own tag, however far."""
    body = F.regexp_extract(html, rf'(?s)<section class="{section}">(.*?)</section>', 1)
    field = lambda p: F.regexp_extract(body, p, 1)
    quote, link = field(rf'(?s)<p class="{section}Text">(.*?)</p>'), field(rf'<a href="([^"]+)"[^>]*class="{section}Attribution"')
    author, byline = field(rf'<div class="{section}Author">([^<]+)</div>'), field(rf'<div class="{section}Byline">([^<]+)</div>')
    rows = pages.filter((quote != "") & (link != "") & (author != ""))
    whole = F.when(F.startswith(link, F.lit("/")), F.concat(F.lit(base), link)).otherwise(link)
    return rows.select(
        *[c for c in pages.columns if c != html], F.regexp_replace(F.trim(quote), "^[“”]+|[“”]+$", "").alias("quote"), F.trim(author).alias("author"), F.trim(byline).alias("byline"), whole.alias("link")
    )


def event_days(pages: DataFrame, html: str, name: str) -> DataFrame:
    """S-32: first and last day of the events on a page whose label has the name."""
    pattern = r"""(?is)<(?:time|event)\b[^>]*start="(\d{4}-\d{2}-\d{2})[^"]*"[^>]*end="(\d{4}-\d{2}-\d{2})[^"]*"[^>]*>([^<]*)<"""
    found = F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda x: F.contains(F.regexp_extract(x, pattern, 3), F.lit(name)))
    rows = pages.select("page_id", F.explode(found).alias("e"))
    return rows.groupBy("page_id").agg(F.min(F.to_date(F.regexp_extract("e", pattern, 1))).alias("first"), F.max(F.to_date(F.regexp_extract("e", pattern, 2))).alias("last"))


def log_sessions(lines: DataFrame, header: str) -> DataFrame:
    """S-33: log lines (file, pos, value) with the number of the session that they belong to; a session begins at a header."""
    return lines.withColumn("session", F.sum(F.col("value").rlike(header).cast("int")).over(W.partitionBy("file").orderBy("pos")))


def releases(rows: DataFrame, body: str) -> DataFrame:
    """S-34: the version and page of a release record; records without a version are left out."""
    r = F.from_json(body, "struct<tag_name:string,html_url:string,draft:boolean,prerelease:boolean>")
    return rows.select(r.alias("r")).filter("r.tag_name RLIKE '^v?[0-9]+([.][0-9]+)*$' AND NOT coalesce(r.draft, false)").select("r.tag_name", "r.html_url", F.coalesce("r.prerelease", F.lit(False)).alias("prerelease"))


def model_list(rows: DataFrame, body: str, special: tuple[str, ...] = ("embed", "rerank", "whisper", "tts", "vision")) -> DataFrame:
    """S-35: models of a server's answer in its order, the general ones first."""
    found = F.from_json(body, "struct<data:array<struct<id:string>>>")
    listed = rows.select(F.posexplode("b.data").alias("pos", "m")) if "b" in rows.columns else rows.select(found.alias("b")).select(F.posexplode("b.data").alias("pos", "m"))
    return listed.select("pos", F.col("m.id").alias("model"), F.lower("m.id").rlike("|".join(special)).alias("special")).orderBy("special", "pos")


def embedding_reply(rows: DataFrame, body: str, expected: str) -> DataFrame:
    """S-36: vectors of a reply in the order of their index; a reply with another number of them is an error."""
    data = F.from_json(body, "struct<data:array<struct<index:int,embedding:array<float>>>>")["data"]
    ordered = F.transform(F.array_sort(data), lambda x: x["embedding"])
    return rows.withColumn("vectors", F.when(F.assert_true(F.size(ordered) == F.col(expected)).isNull(), ordered))


def newer_copy(copies: DataFrame) -> DataFrame:
    """S-37: of a file's copies (name, path, harvested, downloaded) the newest; the download wins ties."""
    return copies.groupBy("name").agg(F.max_by("path", F.struct("harvested", "downloaded")).alias("path"))


def pick_of_the_day(pool: DataFrame, known: DataFrame, key: str, seed: int) -> DataFrame:
    """S-28: one row of the pool that resolves, by a draw that depends on the seed and the row alone."""
    return pool.join(known.select(key), key, "left_semi").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(1)
