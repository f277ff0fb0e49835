"""HTML functions that need a parser: entity decoding, formatted fragments, tagged strings, element selection."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text counts as bold or italic.
_FORMAT = {"b": "b", "strong": "b", "i": "i", "em": "i"}


@dataclass
class Fragment:
    text: str = ""
    links: list[tuple[str, int, int]] = field(default_factory=list)  # (href, start, end) in text


class _Formatter(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out = Fragment()
        self.open: list[tuple[str, str]] = []  # (tag, what closes it)
        self.links: list[tuple[str, int]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = dict(attrs)
        kind = _FORMAT.get(tag) or ("i" if tag == "span" and "clarity-word" in (found.get("class") or "").split() else "")
        if tag in _VOID:
            self.out.text += "\n" if tag == "br" else ""
            return
        if kind:
            self.out.text += f"<{kind}>"
        if tag == "a":
            self.links.append((found.get("href") or "", len(self.out.text)))
        self.open.append((tag, kind))

    def handle_endtag(self, tag: str) -> None:
        k = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if k is None:
            return
        for name, kind in reversed(self.open[k:]):
            if kind:
                self.out.text += f"</{kind}>"
            if name == "a" and self.links:
                href, start = self.links.pop()
                self.out.links.append((href, start, len(self.out.text)))
        del self.open[k:]

    def handle_data(self, data: str) -> None:
        self.out.text += data


def format_fragment(html: str) -> Fragment:
    """Text with only <b> and <i> left, and the links over it."""
    p = _Formatter()
    p.feed(html)
    p.close()
    while p.open:
        p.handle_endtag(p.open[-1][0])
    return p.out


@dataclass(frozen=True)
class Tag:
    name: str
    closing: bool
    attrs: tuple[tuple[str, str], ...]
    index: int


@dataclass
class TaggedString:
    """Plain text with tags at positions in it."""

    text: str
    tags: list[Tag]

    @staticmethod
    def parse(html: str) -> TaggedString:
        out = TaggedString("", [])

        class P(HTMLParser):
            def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
                out.tags.append(Tag(tag, False, tuple((k, v or "") for k, v in attrs), len(out.text)))

            def handle_endtag(self, tag: str) -> None:
                out.tags.append(Tag(tag, True, (), len(out.text)))

            def handle_data(self, data: str) -> None:
                out.text += data

        p = P(convert_charrefs=True)
        p.feed(html)
        p.close()
        return out

    def substring(self, start: int, length: int) -> TaggedString:
        """A part of the text, with the tags that are open in it opened and closed."""
        end = start + length
        opened: list[Tag] = []
        tags: list[Tag] = []
        for t in self.tags:
            if t.index > end or (t.index == end and not t.closing and length):
                break
            if t.index <= start:
                if t.closing:
                    if opened and opened[-1].name == t.name:
                        opened.pop()
                else:
                    opened.append(t)
            else:
                tags.append(Tag(t.name, t.closing, t.attrs, t.index - start))
        tags = [Tag(t.name, False, t.attrs, 0) for t in opened] + tags
        left: list[Tag] = []
        for t in tags:
            if not t.closing:
                left.append(t)
            elif left and left[-1].name == t.name:
                left.pop()
        tags += [Tag(t.name, True, (), length) for t in reversed(left) if t.name not in _VOID]
        return TaggedString(self.text[start:end], tags)

    def __str__(self) -> str:
        out, at = [], 0
        for t in self.tags:
            out.append(_html.escape(self.text[at : t.index], quote=False))
            at = t.index
            attrs = "".join(f' {k}="{v}"' for k, v in t.attrs)
            out.append(f"</{t.name}>" if t.closing else f"<{t.name}{attrs}>")
        return "".join(out) + _html.escape(self.text[at:], quote=False)


class _Select(HTMLParser):
    """Inner HTML of the elements that a test accepts; an element within an accepted one is part of it."""

    def __init__(self, accept: list[tuple[str, str | None, str | None]]):
        super().__init__(convert_charrefs=False)
        self.accept = accept
        self.found: list[tuple[str, dict[str, str], str]] = []
        self.depth = 0
        self.own: tuple[str, dict[str, str]] | None = None
        self.parts: list[str] = []

    def _wants(self, tag: str, attrs: dict[str, str]) -> bool:
        return any(t == tag and (a is None or (attrs.get(a) is not None and (v is None or v in attrs[a].split()))) for t, a, v in self.accept)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = {k: v or "" for k, v in attrs}
        if self.own is None:
            if self._wants(tag, found) and tag not in _VOID:
                self.own, self.parts, self.depth = (tag, found), [], 1
            return
        if tag == self.own[0] == "p":  # a paragraph ends where the next begins
            self._end()
            self.handle_starttag(tag, attrs)
            return
        self.parts.append(self.get_starttag_text() or "")
        self.depth += tag == self.own[0]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.own is not None:
            self.parts.append(self.get_starttag_text() or "")

    def _end(self) -> None:
        if self.own is not None:
            self.found.append((*self.own, "".join(self.parts)))
        self.own = None

    def handle_endtag(self, tag: str) -> None:
        if self.own is None:
            return
        self.depth -= tag == self.own[0]
        if self.depth:
            self.parts.append(f"</{tag}>")
        else:
            self._end()

    def handle_data(self, data: str) -> None:
        self.parts.append(data)

    def handle_entityref(self, name: str) -> None:
        self.parts.append(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.parts.append(f"&#{name};")


def select(html: str, accept: list[tuple[str, str | None, str | None]]) -> list[tuple[str, dict[str, str], str]]:
    """(tag, attributes, inner HTML) of elements, in order.  A test is a tag, and an attribute and a word of its value, which may be None."""
    p = _Select(accept)
    p.feed(html)
    p.close()
    p._end()
    return p.found


def unescape(text: Column | str) -> Column:
    """Character references decoded."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(_html.unescape, na_action="ignore")

    return decode(text)


def fragment(html: Column | str) -> Column:
    """struct (text, links) of formatted fragments."""

    @F.pandas_udf("text string, links array<struct<href:string,start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            made = [format_fragment(x or "") for x in s]
            yield pd.DataFrame({"text": [m.text for m in made], "links": [[{"href": h, "start": a, "end": b} for h, a, b in m.links] for m in made]})

    return run(html)


def _plain_anchor(m: re.Match) -> str:
    parts = re.split(r"(<[^>]*>)", m[2])
    return m[1] + "".join(p if p.startswith("<") else re.sub(r"[^\w\s]", "", p) for p in parts) + "</a>"


def plain_anchors(html: Column | str) -> Column:
    """Links to scripture keep their tag, and lose the punctuation of their text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: re.sub(r'(?s)(<a class="scripture-ref"[^>]*>)(.+?)</a>', _plain_anchor, x), na_action="ignore")

    return run(html)
