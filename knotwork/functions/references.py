"""References to scripture, hymns, talks and proclamations, in links and in plain text.

Parsing is sequential by nature (a chapter carries over to later verses), so it runs in Arrow batches; all
that follows from it is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import BOOK_IDS, BOOKS, CANONS, MOST_VERSES, REFERENCE_WORKS, TYPE
from .automaton import Automaton

# The forms of links, and of hymn, proclamation and talk mentions.
_LINK = re.compile(r"/study/scriptures/([^/]+)/([^/?\"]+)(?:/(\d+))?\?lang=\w+(?:&(?:amp;)?id=([^&#\"\s]+))?(?:&(?:amp;)?span=([^&#\"\s]+))?(?:#([^\"\s]+))?")
_SHORT_LINK = re.compile(r"/scriptures/([^/]+)/([^/]+)/(\d+)\.(\d+)(?:-(\d+))?")
_TALK = re.compile(r"/study/(?:general-conference|liahona)/(\d+)/(\d+)/([^?#\"\s]+)(?:\?lang=\w+(?:&(?:amp;)?id=[^#\"\s]+)?(?:#([^\"\s]+))?)?", re.I)
_HYMN = re.compile(r"Hymns?(?:[,. #]|no|number){1,6}(\d{1,4})(?:(?:[,. #]|no|number){1,6}(\d{1,4}))?", re.I)
_LIVING = re.compile(r"the-living-christ-the-testimony-of-the-apostles|The Living Christ.{1,6}(?:Testimony|Proclamation|Declaration|Document)(?:\W|$)", re.I)
_FAMILY = re.compile(r"the-family-a-proclamation-to-the-world|The Family.{1,4}Proclamation|Proclamation.{1,7}The Family", re.I)
_DASH = "[-–—‒]"
_STEP = re.compile(rf"[\s,;]*(?:(?:and|&)\s+)?(?:(\d+)\s*:|(\d+)(?:\s*{_DASH}\s*(\d+)(?!\s*:))?)")
_SPAN = re.compile(r"(\d+):(\d+)-(\d+):(\d+)")


@dataclass(frozen=True)
class Reference:
    canon: str
    book: str
    chapter: int | None = None
    verse: int | None = None
    paragraph: str | None = None
    low_emphasis: bool = False

    def node(self) -> tuple[int, str]:
        """The node that a reference means; a topic's for reference works."""
        if self.canon in REFERENCE_WORKS:
            return TYPE[REFERENCE_WORKS[self.canon]], self.book
        if self.chapter is None:
            return TYPE["ScriptureBook"], self.book
        if self.verse is not None:
            return TYPE["ScriptureVerse"], f"{self.book}|{self.chapter}|{self.verse}"
        if self.paragraph:
            return TYPE["ScriptureSupplementalPara"], f"{self.book}|{self.chapter}|{self.paragraph}"
        return TYPE["ScriptureChapter"], f"{self.book}|{self.chapter}"

    def words(self) -> str:
        """The reference as it is written: a book, with its chapter and verse."""
        book = next((n for b, _, n, _ in BOOKS if b == self.book), self.book)
        place = "" if self.chapter is None else f" {self.chapter}" if self.verse is None else f" {self.chapter}:{self.verse}"
        return book + place

    def same_as(self) -> tuple:
        """What equality goes by: neither canon nor emphasis."""
        return self.book, self.chapter, self.verse, self.paragraph


def _aliases() -> dict[str, str]:
    """Names of books in lower case without dots: ids, names, and beginnings of names that mean one book only."""
    out: dict[str, str] = {}
    starts: dict[str, set[str]] = {}
    for book, _, name, _ in BOOKS:
        low = name.lower()
        number, _, rest = low.partition(" ") if low[0].isdigit() else ("", "", low)
        for n in range(2 if number else 3, len(rest) + 1):
            for form in (f"{number} {rest[:n]}", f"{number}{rest[:n]}") if number else (rest[:n],):
                starts.setdefault(form.rstrip(), set()).add(book)
    out |= {form: next(iter(books)) for form, books in starts.items() if len(books) == 1}
    for book, _, name, _ in BOOKS:
        out |= dict.fromkeys({name.lower(), name.lower().replace(" ", "") if name[0].isdigit() else name.lower(), book, book.replace("-", " "), book.replace("-", "")}, book)
    out |= {a: b for a, (b, _) in BOOK_IDS.items() if not a.startswith("jst")}
    # Spellings that no rule gives.
    out |= {
        "d&c": "dc", "d & c": "dc", "d. & c": "dc", "doctrine and covenants": "dc", "psalm": "ps", "phillipians": "philip", "phil": "philip", "songs of solomon": "song",
        "js-h": "js-h", "jsh": "js-h", "js-m": "js-m", "jsm": "js-m", "joseph smith-history": "js-h", "joseph smith-matthew": "js-m", "joseph smith—history": "js-h", "joseph smith—matthew": "js-m",
        "articles of faith": "a-of-f", "article of faith": "a-of-f", "w of m": "w-of-m", "1 jn": "1-jn", "canticles": "song", "apocalypse": "rev",
    }
    return out


ALIASES = _aliases()
_CANON = {b: c for b, c, _, _ in BOOKS}
_CHAPTERS = {b: n for b, _, _, n in BOOKS}
_AFTER_ONE = re.compile(r"\.?(?:\s*(\d+)(?::(\d+))?)?\s*\.?\s*$")
_AFTER_NAME = re.compile(r"\.?,?\s*(?=\d)")
_GAP = re.compile(r"\.?\s+")


class Aliases:
    """Names of books, found in running text by one pass of an automaton over it, in any case and with any spaces or dots between words."""

    def __init__(self, books: dict[str, str] | None = None):
        self.books = {_GAP.sub(" ", a).lower(): b for a, b in (ALIASES if books is None else books).items()}
        self.automaton = Automaton(self.books)
        self.longest = max(map(len, self.books), default=0)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, book) of names that a number follows, from the left, the longest first; end is behind what may stand between."""
        # in the form of the names, and where each character was
        plain, places, at = [], [], 0
        for m in _GAP.finditer(text):
            plain += (text[at : m.start()], " ")
            places += (*range(at, m.start()), m.start())
            at = m.end()
        plain.append(text[at:])
        places += (*range(at, len(text)), len(text))
        low = "".join(c if len(c) == 1 else "?" for c in map(str.lower, "".join(plain)))
        tails: dict[int, int] = {}

        def accept(s: int, e: int) -> bool:
            before, end = places[s], places[e - 1] + 1
            if before and (text[before - 1].isalnum() or text[before - 1] == "_"):
                return False
            tail = _AFTER_NAME.match(text, end)
            if tail:
                tails[e] = tail.end()
            return tail is not None

        return [(places[s], tails[e], self.books[name]) for s, e, name in self.automaton.longest(low, accept)]

    def first(self, text: str) -> tuple[str, str | None, str | None] | None:
        """(book, chapter, verse) of a string that is one reference."""
        s = _GAP.sub(" ", text.strip()).lower()
        for n in range(min(len(s), self.longest), 0, -1):
            book = self.books.get(s[:n].rstrip(".")) if not s[n - 1].isspace() else None
            if book and (m := _AFTER_ONE.match(s, n)):
                return book, m[1], m[2]
        return None


class Parser:
    """Parses references; `verses` gives the verse counts of books (dims.verse_counts), `hymns` the songs by number (dims.hymn_names).

    `aliases` gives names of books, instead of those that are known.  A chapter whose length isn't given is taken to have as many verses as the longest one has.
    """

    def __init__(self, verses: dict[str, tuple[int, ...]] | None = None, hymns: dict[int, str] | None = None, aliases: dict[str, str] | None = None):
        self.verses = verses or {}
        self.hymns = hymns or {}
        self.aliases = Aliases(aliases)

    def n_verses(self, book: str, chapter: int) -> int:
        known = self.verses.get(book)
        return (known[chapter - 1] if known and chapter <= len(known) else MOST_VERSES) if 1 <= chapter <= _CHAPTERS.get(book, 0) else 0

    def valid(self, r: Reference) -> bool:
        if r.canon in REFERENCE_WORKS:
            return True
        if r.book not in _CHAPTERS or (r.chapter is not None and not 1 <= r.chapter <= _CHAPTERS[r.book]):
            return False
        return r.verse is None or 1 <= r.verse <= self.n_verses(r.book, r.chapter or 0)

    # plain text

    def one(self, text: str) -> Reference | None:
        """A string that is one reference: a book, a chapter or a verse."""
        found = self.aliases.first(text)
        if not found:
            return None
        book, chapter, verse = found[0], *(int(x) if x else None for x in found[1:])
        if chapter is not None and verse is None and _CHAPTERS[book] == 1:
            chapter, verse = 1, chapter
        r = Reference(_CANON[book], book, chapter, verse)
        return r if self.valid(r) else None

    def in_text(self, text: str) -> list[Reference]:
        """All references in running text; a chapter carries over to the verses after it."""
        found = self.aliases.find(text)
        out: list[Reference] = []
        for k, (_, at, book) in enumerate(found):
            stop = found[k + 1][0] if k + 1 < len(found) else len(text)
            chapter = 1 if _CHAPTERS[book] == 1 else None
            named, canon = False, _CANON[book]
            while s := _STEP.match(text, at, stop):
                if s.end() < len(text) and s.end() == stop and text[s.end()].isalnum():
                    break
                at = s.end()
                if s[1]:
                    chapter, named = int(s[1]), True
                elif chapter is None or (not named and _CHAPTERS[book] > 1):
                    out.append(Reference(canon, book, int(s[2])))
                    break
                else:
                    last = int(s[3]) if s[3] else int(s[2])
                    out += [Reference(canon, book, chapter, v) for v in range(int(s[2]), min(last, int(s[2]) + MOST_VERSES) + 1)]
        return [r for r in out if self.valid(r)]

    # links

    def paragraph_list(self, ids: str) -> list[int | str]:
        """`p3,p6-p9` as numbers; ends of ranges that aren't numbers stand for themselves."""
        out: list[int | str] = []
        for part in ids.split(","):
            ends = [int(x.removeprefix("p")) if x.removeprefix("p").isdigit() else x for x in part.split("-", 1)]
            if len(ends) == 2 and all(isinstance(x, int) for x in ends):
                out += range(ends[0], min(ends[1], ends[0] + MOST_VERSES) + 1)
            else:
                out += ends
        return out

    def span(self, book: str, text: str) -> list[tuple[int, int]]:
        """`12:50-13:2` as (chapter, verse), over the lengths of the chapters between."""
        m = _SPAN.search(text)
        if not m:
            return []
        c1, v1, c2, v2 = map(int, m.groups())
        out = []
        for c in range(c1, min(c2, _CHAPTERS.get(book, 0)) + 1):
            out += [(c, v) for v in range(v1 if c == c1 else 1, (v2 if c == c2 else self.n_verses(book, c)) + 1)]
        return out

    def link(self, m: re.Match) -> list[Reference]:
        canon, book, chapter, ids, span, mark = m[1].lower(), m[2], m[3], m[4], m[5], m[6]
        if canon not in CANONS:
            return []
        if canon in REFERENCE_WORKS:
            return [Reference(canon, book)]
        book, other = BOOK_IDS.get(book.lower(), (book, None))
        canon = other or canon
        if chapter is None:
            return [Reference(canon, book)]
        strong = set(self.paragraph_list(mark)) if mark else set()
        low = lambda x: bool(mark) and x not in strong
        if span:
            return [Reference(canon, book, c, v, None, low(v)) for c, v in self.span(book, span)]
        if ids or mark:
            of = lambda p: {"verse": p} if isinstance(p, int) else {"paragraph": p}
            return [Reference(canon, book, int(chapter), low_emphasis=low(p) if ids else False, **of(p)) for p in self.paragraph_list(ids or mark)]
        return [Reference(canon, book, int(chapter))]

    def short_link(self, m: re.Match) -> list[Reference]:
        book, other = BOOK_IDS.get(m[2].lower(), (m[2], None))
        first = int(m[4])
        return [Reference(other or m[1], book, int(m[3]), v) for v in range(first, min(int(m[5] or first), first + MOST_VERSES) + 1)]

    def scriptures(self, html: str) -> list[Reference]:
        """All references in a piece of HTML, in links and in text; the first of equal ones stays."""
        found = [r for m in _LINK.finditer(html) for r in self.link(m)]
        found += [r for m in _SHORT_LINK.finditer(html) if "/study/scriptures/" not in m[0] and m[1] in CANONS for r in self.short_link(m)]
        found += self.in_text(re.sub(r"<[^>]*>", "", html))
        first: dict[tuple, Reference] = {}
        for r in found:
            if self.valid(r):
                first.setdefault(r.same_as(), r)
        return list(first.values())

    def talks(self, html: str) -> list[tuple[int, str, str, str | None]]:
        """(year, phase, talk, paragraph) of links to talks; months up to June are April's conference."""
        return [(int(m[1]), "04" if int(m[2]) <= 6 else "10", m[3], m[4]) for m in _TALK.finditer(html)]

    def everything(self, html: str) -> list[tuple[int, str, bool]]:
        """All nodes that a piece of HTML refers to, each once: (type, name, low emphasis)."""
        out = {r.node(): r.low_emphasis for r in reversed(self.scriptures(html))}
        out = dict(reversed(out.items()))
        for m in _HYMN.finditer(html):
            number = int(m[2] or m[1])
            if number in self.hymns:
                out.setdefault((TYPE["Hymn"], self.hymns[number]), False)
        for pattern, name in ((_LIVING, "lc"), (_FAMILY, "fam")):
            if pattern.search(html):
                out.setdefault((TYPE["Proclamation"], name), False)
        for year, phase, talk, paragraph in self.talks(html):
            kind = "ConferenceTalkParagraph" if paragraph else "ConferenceTalk"
            out.setdefault((TYPE[kind], "|".join([str(year), phase, talk, *([paragraph] if paragraph else [])])), False)
        return [(*n, low) for n, low in out.items()]


_REF = "array<struct<canon:string,book:string,chapter:int,verse:int,paragraph:string,low_emphasis:boolean>>"
_NODE = "array<struct<type:smallint,name:string,low_emphasis:boolean>>"


def _rows(refs: list[Reference]) -> list[dict]:
    return [{"canon": r.canon, "book": r.book, "chapter": r.chapter, "verse": r.verse, "paragraph": r.paragraph, "low_emphasis": r.low_emphasis} for r in refs]


def scripture_references(html: Column | str, parser: Parser | None = None) -> Column:
    """References of a column of HTML or text."""
    p = parser or Parser()

    @F.pandas_udf(_REF)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: _rows(p.scriptures(x)) if x else [])

    return parse(html)


def text_references(text: Column | str, parser: Parser | None = None) -> Column:
    """References of a column of plain text."""
    p = parser or Parser()

    @F.pandas_udf(_REF)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: _rows(p.in_text(x)) if x else [])

    return parse(text)


def mentioned_nodes(html: Column | str, parser: Parser | None = None) -> Column:
    """All nodes that a column of HTML refers to."""
    p = parser or Parser()

    @F.pandas_udf(_NODE)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: [{"type": t, "name": n, "low_emphasis": low} for t, n, low in p.everything(x)] if x else [])

    return parse(html)


