"""Look-ups over books and chapters: neighbours, lengths, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims


def neighbours(spark: SparkSession, verses: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """(book, chapter, ..., prev_book, prev_chapter, next_book, next_chapter): in reading order, across books of one canon.

    A table of fixed size (one row a chapter).
    """
    w = Window.partitionBy("canon").orderBy("book_order", "chapter")
    c = dims.chapters(spark, verses)
    for side, f in (("prev", F.lag), ("next", F.lead)):
        c = c.withColumn(f"{side}_book", f("book").over(w)).withColumn(f"{side}_chapter", f("chapter").over(w))
    return c


def valid_verses(refs: DataFrame, verses: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """References (book, chapter, verse) that exist; a null verse or chapter asks for less."""
    known = dims.chapters(refs.sparkSession, verses).groupBy("book").agg(F.max("chapter").alias("_n"), F.collect_list(F.struct("chapter", "verses")).alias("_v"))
    length = F.get(F.transform(F.filter("_v", lambda x: x["chapter"] == F.col("chapter")), lambda x: F.coalesce(x["verses"], F.lit(dims.MOST_VERSES))), 0)
    ok = F.col("chapter").isNull() | (F.col("chapter").between(1, F.col("_n")) & (F.col("verse").isNull() | F.col("verse").between(1, length)))
    return refs.join(F.broadcast(known), "book").where(ok).drop("_n", "_v")


def normal_book(book: Column, canon: Column) -> Column:
    """struct (book, canon) with other spellings of ids replaced."""
    ids = F.create_map(*[F.lit(x) for k, (b, _) in dims.BOOK_IDS.items() for x in (k, b)])
    canons = F.create_map(*[F.lit(x) for k, (_, c) in dims.BOOK_IDS.items() if c for x in (k, c)])
    return F.struct(F.coalesce(F.try_element_at(ids, F.lower(book)), book).alias("book"), F.coalesce(F.try_element_at(canons, F.lower(book)), canon).alias("canon"))


def book_name(book: Column, lang: Column | None = None) -> Column:
    """English name of a book; an error for other languages."""
    return _english(F.create_map(*[F.lit(x) for b in dims.BOOKS for x in (b[0], b[2])]), book, lang)


def canon_name(canon: Column, lang: Column | None = None) -> Column:
    return _english(F.create_map(*[F.lit(x) for kv in dims.CANONS.items() for x in kv]), canon, lang)


def _english(table: Column, key: Column, lang: Column | None) -> Column:
    found = F.try_element_at(table, key)
    if lang is None:
        return found
    return F.when(lang == "en", found).otherwise(F.raise_error(F.concat(F.lit("no names in language "), lang)).cast("string"))


def document_header(kind: Column, name: Column, title: Column) -> Column:
    """Header of a document: a chapter by its book's name and number, others by their title."""
    chapter = F.format_string("%s %s", book_name(F.split_part(name, F.lit("|"), F.lit(1))), F.split_part(name, F.lit("|"), F.lit(2)))
    return F.when(kind == dims.TYPE["ScriptureChapter"], chapter).otherwise(title)


def hymn_number(hymns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(song -> number, number -> song) of (song, number, seq); the last one written counts."""
    by = lambda key, value: hymns.groupBy(key).agg(F.max_by(value, "seq").alias(value))
    return by("song", "number"), by("number", "song")
