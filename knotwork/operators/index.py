"""The nested index of all documents: canons with books, chapters and verses, conferences with talks, books with chapters, and entities.

Nesting goes from the bottom upwards, a level at a time: children are gathered under their parent with map-side combine, and
what a parent gathers is what one parent has (verses of a chapter, chapters of a book), never what a table has.  Rows
come with `seq`, the order in which they were indexed: of rows with one key the last counts, lists are in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import BOOKS, CANONS
from .ordered import places

#: Most children of one parent, which must fit into a row.
MOST_CHILDREN = 100_000
#: Talks of a conference in one row.
BLOCK = 10_000


def nest(rows: DataFrame, keys: list[str], order: list[str], into: str, most: int = MOST_CHILDREN) -> DataFrame:
    """(keys..., into): one row a key with its other columns gathered as an array of structs, in order; too many children are refused."""
    rest = [c for c in rows.columns if c not in keys]
    sort = F.struct(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], F.struct(*rest).alias("_row"))
    out = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(sort)), lambda x: x["_row"]).alias(into))
    refused = F.raise_error(F.concat(F.lit(f"more than {most} {into} in "), F.concat_ws("|", *keys)))
    return out.withColumn(into, F.when(F.size(into) > most, refused.cast(out.schema[into].dataType)).otherwise(F.col(into)))


def last_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key, that with the highest seq."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select(*keys, "_r.*")


def scripture_index(verses: DataFrame) -> DataFrame:
    """(canon, place, books: [(book, chapters: [(chapter, verses: [(verse, entity, seq)])])]) from (book, chapter, verse, entity, seq).

    Canons and books come in reading order; verses of unknown books are left out."""
    books = verses.sparkSession.createDataFrame([(b, c, k) for k, (b, c, _, _) in enumerate(BOOKS)], "book string, canon string, _book int")
    known = verses.select("book", "chapter", "verse", "entity", "seq").join(F.broadcast(books.select("book")), "book")
    chapters = nest(last_of(known, ["book", "chapter", "verse"]), ["book", "chapter"], ["verse"], "verses")
    whole = nest(chapters, ["book"], ["chapter"], "chapters").join(F.broadcast(books), "book")
    canons = nest(whole, ["canon"], ["_book"], "books")
    place = F.array_position(F.array(*[F.lit(c) for c in CANONS]), F.col("canon")).cast("int")
    return canons.select("canon", place.alias("place"), F.transform("books", lambda b: F.struct(b["book"].alias("book"), b["chapters"].alias("chapters"))).alias("books"))


def flat(index: DataFrame) -> DataFrame:
    """(canon, book, chapter, verse, entity, b, c, v): the verses of a scripture index with their places in its arrays."""
    books = index.select("canon", F.posexplode("books").alias("b", "x"))
    chapters = books.select("canon", "b", F.col("x.book").alias("book"), F.posexplode("x.chapters").alias("c", "x"))
    return chapters.select("canon", "b", "book", "c", F.col("x.chapter").alias("chapter"), F.posexplode("x.verses").alias("v", "x")).select("canon", "book", "chapter", "x.verse", "x.entity", "b", "c", "v")


def talk_index(talks: DataFrame) -> DataFrame:
    """(year, phase, first, talks: [(talk, entity, seq)]) from (year, phase, talk, entity, seq); every talk that was indexed.

    A conference is a row for each BLOCK of its talks, `first` being the number of the block's first talk, so that no conference has to fit into a row."""
    placed = places(talks.select("year", "phase", "talk", "entity", "seq"), ["year", "phase"], ["seq", "talk"])
    blocks = placed.withColumn("first", F.col("place") - F.col("place") % BLOCK)
    found = nest(blocks, ["year", "phase", "first"], ["place"], "talks")
    return found.withColumn("talks", F.transform("talks", lambda x: F.struct(x["talk"].alias("talk"), x["entity"].alias("entity"), x["seq"].alias("seq"))))


def book_index(chapters: DataFrame) -> DataFrame:
    """(book, chapters: [(chapter, entity, seq)]) from (book, chapter, entity, seq); every chapter that was indexed."""
    return nest(chapters.select("book", "chapter", "entity", "seq"), ["book"], ["seq", "chapter"], "chapters")


def entity_index(*documents: DataFrame) -> DataFrame:
    """(entity, path) over all kinds of documents (entity, path, seq): the last one indexed."""
    every = documents[0].select("entity", "path", "seq")
    for d in documents[1:]:
        every = every.unionByName(d.select("entity", "path", "seq"))
    return last_of(every, ["entity"]).select("entity", "path")
