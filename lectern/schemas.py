"""Schemas of the corpus tables. Derived tables carry SCHEMA_VERSION in their path and are rebuilt, not migrated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1


def _struct(ddl: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "date": T.DateType(), "ts": T.TimestampNTZType(), "double": T.DoubleType()}

    def kind(name: str) -> T.DataType:
        if name.startswith("array<"):
            return T.ArrayType(kind(name[6:-1]))
        if name.startswith("map<"):
            key, value = name[4:-1].split(",", 1)
            return T.MapType(kind(key), kind(value))
        return T.FloatType() if name == "float" else kinds[name]

    return T.StructType([T.StructField(field.split(":", 1)[0], kind(field.split(":", 1)[1])) for field in ddl.split()])


_SIDE = "{0}_volume:string {0}_book:string {0}_chapter:int {0}_start:int {0}_end:int"
_STAMPS = "created_at:ts updated_at:ts deleted_at:ts"

TABLES: dict[str, T.StructType] = {
    name: _struct(ddl)
    for name, ddl in {
        "volumes": "id:long name:string slug:string sort_order:int",
        "testaments": "id:long volume_id:long name:string slug:string sort_order:int",
        "books": "id:long volume_id:long testament_id:long name:string sort_order:int",
        "chapters": "id:long book_id:long chapter_number:int title:string speaker:string discourse_date:string",
        "verses": "id:long chapter_id:long verse_number:int text:string reference:string",
        "topics": "id:long name:string slug:string description:string sort_order:int",
        "topic_verses": "id:long topic_id:long volume_slug:string reference:string sort_order:int",
        "topic_talks": "id:long topic_id:long talk_title:string speaker:string date:string url:string sort_order:int",
        "topic_key_verses": "id:long topic_id:long volume_slug:string reference:string sort_order:int",
        "lexicon_entries": "id:long strongs:string language:string lemma:string transliteration:string pronunciation:string derivation:string definition:string kjv_renderings:string gloss:string",
        "word_tags": "id:long volume_slug:string reference:string tags:map<int,array<string>>",
        "names": "id:long name:string tier:string meaning:string reference:string strongs:array<string> forms:array<string>",
        "cross_references": f"id:long {_SIDE.format('a')} {_SIDE.format('b')} relationship:string topic_slugs:array<string> note:string sort_order:int",
        "notes": f"id:long verse_id:long chapter_id:long text:string {_STAMPS}",
        "journal_entries": f"id:long entry_date:date text:string verse_id:long chapter_id:long {_STAMPS}",
        "user_cross_references": f"id:long {_SIDE.format('a')} {_SIDE.format('b')} note:string {_STAMPS}",
        "tags": "id:long name:string",
        "tag_assignments": f"id:long tag_id:long verse_id:long chapter_id:long {_STAMPS}",
        "highlights": f"id:long verse_id:long color:string start_offset:int end_offset:int {_STAMPS}",
        "reading_log": "id:long read_date:date chapter_id:long updated_at:ts",
        "reading_history": "id:long chapter_id:long read_at:ts",
        "sessions": f"id:long uid:string title:string data:string {_STAMPS}",
        "settings": "key:string value:string",
        "pieces": "id:long key:string kind:string volume_slug:string chapter_id:long heading:string body:string meta:map<string,string> content_hash:string",
        "vectors": "content_hash:string vector:array<float>",
    }.items()
}

RELATIONSHIPS = ("paraphrase", "quotation", "tradition", "typology", "translation")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Additive evolution: columns that are missing are null, others are cast; unknown ones are left out."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in TABLES[table]])


def exactly_one(*cols: str) -> Column:
    """Whether just one of the columns is set."""
    return sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) == 1


def verses_wide(volumes: DataFrame, testaments: DataFrame, books: DataFrame, chapters: DataFrame, verses: DataFrame) -> DataFrame:
    """The five levels in one row per verse; a book needn't have a testament."""
    v = volumes.select(F.col("id").alias("volume_id"), F.col("slug").alias("volume_slug"), F.col("name").alias("volume_name"), F.col("sort_order").alias("volume_sort"))
    t = testaments.select(F.col("id").alias("testament_id"), F.col("name").alias("testament"))
    b = books.select(F.col("id").alias("book_id"), "volume_id", "testament_id", F.col("name").alias("book_name"), F.col("sort_order").alias("book_sort"))
    c = chapters.select(F.col("id").alias("chapter_id"), "book_id", "chapter_number", "title", "speaker", "discourse_date")
    upper = c.join(b, "book_id").join(v, "volume_id").join(t, "testament_id", "left")
    return verses.withColumnRenamed("id", "verse_id").join(upper, "chapter_id")
