"""Crawling over a stored table of pages: links, filters, frontier, page types, page cache.

There is no network: a page that the table lacks is a page that can't be fetched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.html import unescape
from ..plans.session import cut

# How links are written, and files that aren't pages.
HREF = r"""(?i)href=(?:"([^"#]+)(?:#[^"]*)?"|'([^'#]+)(?:#[^']*)?')"""
NO_PAGE = r"(?i)\.(jpg|png|svg|tif|mp4|avi|mkv|css)$"

# Page types by address, in the order in which they are tried.
PAGE_TYPES = (
    ("scripture_chapter", r"/study/scriptures/(?:bofm|ot|nt|dc-testament|pgp)/.+?/\d+"),
    ("topical_guide", r"/study/scriptures/tg/.+?(?:\?|$)"),
    ("bible_dictionary", r"/study/scriptures/bd/.+?(?:\?|$)"),
    ("guide_to_scriptures", r"/study/scriptures/gs/.+?(?:\?|$)"),
    ("triple_index", r"/study/scriptures/triple-index/.+?(?:\?|$)"),
    ("conference_talk", r"/study/general-conference/\d+/\d+/.+?(?:\?|$)"),
    ("speaker", r"/speakers/.+?(?:/?|$)"),
    ("speech", r"/talks/.+?/.+?(?:/?|$)"),
    ("hymn", r"/media/music/songs/.+?(?:/?|$)"),
    ("proclamation", r"/study/scriptures/the-(?:living-christ|family-a-proclamation)[^/]*"),
    ("book_chapter", r"/study/manual/jesus-the-christ/chapter-(\d+)"),
)


@dataclass(frozen=True)
class CrawlSource:
    """A seed and the addresses that may be visited; patterns are regular expressions, none allows all."""

    name: str
    seed: str
    allow: tuple[str, ...] = ()


def crawl_sources(site: str, speeches: str) -> list[CrawlSource]:
    """The named sources, for the addresses of their two sites."""
    lang = r"\?lang=eng$"
    study = f"^{site}/study"
    canon = lambda c, first: CrawlSource(c, f"{site}/study/scriptures/{c}/{first}?lang=eng", (rf"{study}/scriptures/{c}/.+?/\d+{lang}",))
    work = lambda w: CrawlSource(w, f"{site}/study/scriptures/{w}?lang=eng", (rf"{study}/scriptures/{w}/.+?{lang}",))
    return [
        CrawlSource("conference", f"{site}/study/general-conference?lang=eng", (rf"{study}/general-conference{lang}", rf"{study}/general-conference/\d+{lang}", rf"{study}/general-conference/\d+/\d+{lang}", rf"{study}/general-conference/\d+/\d+/.+?{lang}")),
        CrawlSource("book", f"{site}/study/manual/jesus-the-christ?lang=eng", (rf"{study}/manual/jesus-the-christ{lang}", rf"{study}/manual/jesus-the-christ/chapter-\d+{lang}")),
        canon("bofm", "1-ne/1"), canon("ot", "gen/1"), canon("nt", "matt/1"), canon("dc-testament", "dc/1"), canon("pgp", "moses/1"),
        work("bd"), work("tg"), work("triple-index"), work("gs"),
        CrawlSource("speeches", f"{speeches}/speakers/", (rf"^{speeches}/speakers/?$", rf"^{speeches}/speakers/[^/]+/?$", rf"^{speeches}/talks/[^/]+/[^/]+/?$")),
        CrawlSource("hymns", f"{site}/media/music/songs"),
        CrawlSource("proclamations", f"{site}/study/scriptures/the-family-a-proclamation-to-the-world?lang=eng"),
    ]


def song_addresses(songs: DataFrame, site: str) -> DataFrame:
    """(url): a page for each song id."""
    return songs.select(F.format_string(f"{site}/media/music/songs/%s?lang=eng", "song").alias("url"))


def hrefs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, href): link targets as written, without fragments."""
    both = lambda k: F.regexp_extract_all(html_col, F.lit(HREF), F.lit(k))
    found = F.transform(F.arrays_zip(both(1).alias("a"), both(2).alias("b")), lambda x: F.when(x["a"] != "", x["a"]).otherwise(x["b"]))
    return pages.select(id_col, F.posexplode(found).alias("pos", "href"))


def resolve(base: Column | str, href: Column | str) -> Column:
    """Absolute addresses without fragments; null where malformed."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(b: str | None, h: str | None) -> str | None:
            try:
                url = urldefrag(urljoin(b or "", h or ""))[0]
                return url if urlsplit(url).scheme in ("http", "https") else None
            except ValueError:
                return None

        for b, h in batches:
            yield pd.Series([one(x, y) for x, y in zip(b, h, strict=True)], dtype=object)

    return run(base, href)


def allowed(url: Column, allow: tuple[str, ...] = ()) -> Column:
    """Whether an address matches any pattern (no pattern allows all) and its path is no file of another kind."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    any_of = reduce(lambda a, b: a | b, [url.rlike(p) for p in allow]) if allow else F.lit(True)
    return any_of & ~path.rlike(NO_PAGE)


def links(pages: DataFrame, allow: tuple[str, ...] = (), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target): different allowed links of each page."""
    raw = pages.select(F.col(url_col).alias("url"), F.explode(F.array_distinct(F.filter(_targets(html_col), lambda x: x != ""))).alias("href"))
    found = raw.select("url", resolve("url", unescape("href")).alias("target"))
    return found.where(F.col("target").isNotNull() & allowed(F.col("target"), allow)).distinct()


def _targets(html_col: str) -> Column:
    return F.concat(F.regexp_extract_all(html_col, F.lit(HREF), F.lit(1)), F.regexp_extract_all(html_col, F.lit(HREF), F.lit(2)))


def crawl(pages: DataFrame, source: CrawlSource, on_page: Callable[[DataFrame], None] | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, level): pages reached breadth-first from the seed, until nothing new is reached; pages that the table lacks are reached, but lead nowhere.

    on_page, if given, gets the stored pages of each level as they are reached.
    """
    edges = cut(links(pages, source.allow, url_col, html_col))
    spark = pages.sparkSession
    level = cut(spark.createDataFrame([(source.seed,)], "url string").withColumn("level", F.lit(0)))
    visited, k = level, 0
    while not level.isEmpty():
        if on_page:
            on_page(pages.join(level.select(F.col("url").alias(url_col)), url_col, "left_semi"))
        k += 1
        new = edges.join(level.select("url"), "url").select(F.col("target").alias("url")).distinct()
        level = cut(new.join(visited.select("url"), "url", "left_anti").withColumn("level", F.lit(k)))
        visited = cut(visited.union(level)) if k % 20 == 0 else visited.union(level)  # long chains make long plans
    return visited


def page_type(url: Column) -> Column:
    """The first type whose pattern an address matches, else unknown."""
    return reduce(lambda w, t: w.when(url.rlike(t[1]), F.lit(t[0])), PAGE_TYPES, F).otherwise(F.lit("unknown"))


def cached(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Pages of the cache by address; a miss is absent."""
    return pages.join(urls.select("url").distinct(), "url", "left_semi")


def store_pages(new: DataFrame, path: str) -> None:
    """Append pages whose address the cache lacks, one each, with the file name that the address stands for."""
    spark = new.sparkSession
    rows = new.dropDuplicates(["url"]).withColumn("file_name", T.url_to_file_name("url"))
    try:
        rows = rows.join(spark.read.parquet(path).select("url"), "url", "left_anti")
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    cut(rows).write.mode("append").option("compression", "zstd").parquet(path)
