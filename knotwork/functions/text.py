"""Text functions as column expressions: sentences, words, n-grams, tags.

The patterns use explicit classes and no look-around, so that Java and RE2 read them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is a word, and what ends a sentence.
LETTER = r"\p{L}\p{Mn}\p{Nd}\p{Pc}×÷"
WORD = rf"(?:[{LETTER}][-{LETTER}]+[{LETTER}]|[{LETTER}]+)(?:['’][\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}]+)?"
SENTENCE = r"""(?s).+?(?:\z|[.?!][ \t\n\r\f.?'’")\]!”]+)"""
TAG = r"</?[a-z]+(?: [\s\S]+?)?>"
COMMA = r"(?s)^(.+?),[ \t\n\r\f]*(.+?)(?:\z|(,[ \t\n\r\f]*.+))"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once per row, however often it occurs."""
    return F.get(F.transform(F.array(value), body), 0)


def sentences(text: Column | str) -> Column:
    """The sentences of a text, in order."""
    return F.regexp_extract_all(_col(text), F.lit(SENTENCE), F.lit(0))


def words(text: Column | str) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0))


def ngrams(ws: Column | str, n: int, sep: str = "|") -> Column:
    """Runs of n consecutive elements of an array, joined; the array is computed once, whatever expression it is."""
    run = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), sep))
    return let(_col(ws), lambda w: F.when(F.size(w) >= n, run(w)).otherwise(F.array().cast("array<string>")))


def pairs_within(ws: Column | str, order: int) -> Column:
    """Each element with each of the next `order` ones, as structs (a, b)."""

    def made(w: Column) -> Column:
        near = lambda i: F.transform(F.slice(w, i + 1, order), lambda b: F.struct(F.element_at(w, i).alias("a"), b.alias("b")))
        return F.when(F.size(w) >= 2, F.flatten(F.transform(F.sequence(F.lit(1), F.size(w) - 1), near))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))

    return let(_col(ws), made)


def char_trigrams(word: Column | str) -> Column:
    """Trigrams of [word], with its brackets."""
    return let(F.concat(F.lit("["), _col(word), F.lit("]")), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))


def char_level_features(text: Column | str) -> Column:
    """Words, bigrams and trigrams between STKN and ETKN, and character trigrams, as structs (type_name, name)."""
    of = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("type_name"), x.alias("name")))

    def made(ws: Column) -> Column:
        marked = F.concat(F.array(F.lit("STKN")), ws, F.array(F.lit("ETKN")))
        return F.concat(of("Word", ws), of("NGram", F.concat(ngrams(marked, 2), ngrams(marked, 3))), of("CharNGram", F.flatten(F.transform(ws, char_trigrams))))

    return let(words(F.lower(_col(text))), made)


def comma_inversion(s: Column | str) -> Column:
    """`A, B[, C]` as `B A[, C]`; other strings unchanged."""
    s = _col(s)
    return F.when(F.trim(s) == "", s).otherwise(F.regexp_replace(s, COMMA, "$2 $1$3"))


def comma_inverted(s: Column | str) -> Column:
    """Whether comma_inversion() changes the string."""
    return F.coalesce((comma_inversion(s) != _col(s)), F.lit(False))


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(_col(html), TAG, "")


def strip_all_but_bold_and_italics(html: Column | str) -> Column:
    """Drop tags but <b> and <i>, which lose their attributes."""
    stashed = F.regexp_replace(_col(html), r"<(/?[ib])(?: [\s\S]+?)?>", "[$1]")
    return F.regexp_replace(strip_tags(stashed), r"\[(/?[ib])\]", "<$1>")


def line_breaks(html: Column | str) -> Column:
    return F.regexp_replace(_col(html), r"<\s*/?\s*br\s*/?\s*>", "\r\n")


def plain_spaces(s: Column | str) -> Column:
    """Non-breaking spaces, as characters or references, as spaces."""
    return F.translate(F.regexp_replace(_col(s), "&nbsp;", " "), "\u00a0", " ")


def drop_page_breaks(html: Column | str) -> Column:
    return F.regexp_replace(_col(html), r'<span class="page-break".+?</span>', "")


def drop_verse_numbers(html: Column | str) -> Column:
    return F.regexp_replace(_col(html), r'<span class="verse-number".+?</span>', "")


def drop_links(html: Column | str) -> Column:
    """Links as their text."""
    return F.regexp_replace(_col(html), r"<a.+?>([\s\S]+?)</a>", "$1")


def group_replace(s: Column | str, pattern: str, replacement: str) -> Column:
    """Replacement by pattern, with $1, $2 ... for its groups."""
    return F.regexp_replace(_col(s), pattern, replacement)


def clean_author(html: Column | str) -> Column:
    """An author line without tags, leading By, titles and parentheses."""
    plain = F.trim(plain_spaces(strip_tags(html)))
    plain = F.regexp_replace(plain, r"\([^)]*\)", "")
    return F.trim(F.regexp_replace(plain, r"^(?:[Bb]y\s+)?(?:Elder|President|Sister|Bishop|Brother)?\s*", ""))


def header_parts(html: Column | str) -> Column:
    """A header around its emphasised part: struct (before, title, after), each without tags."""
    h = _col(html)
    span = r"(?s)^(.*?)<(?:span class=\"dominant\"|em|strong|b)[^>]*>(.*?)</(?:span|em|strong|b)>(.*)$"
    part = lambda k: F.trim(strip_tags(F.regexp_extract(h, span, k)))
    has = F.regexp_extract(h, span, 2) != ""
    return F.struct(F.when(has, part(1)).alias("before"), F.when(has, part(2)).otherwise(F.trim(strip_tags(h))).alias("title"), F.when(has, part(3)).alias("after"))


def first_words(text: Column | str, most: int = 40) -> Column:
    """The first words of a text that fit into `most` characters."""
    t = F.trim(_col(text))
    fits = F.regexp_extract(t, rf"(?s)^.{{0,{most - 1}}}\S(?=\s|\z)", 0)
    return F.when(fits != "", fits).otherwise(F.substring(t, 1, most))


def sanitize_file_name(name: Column | str) -> Column:
    """Characters that file names can't have, as _."""
    return F.regexp_replace(_col(name), r'[\x00-\x1f"<>|:*?\\/]', "_")


def url_to_file_name(url: Column | str) -> Column:
    return F.concat(F.regexp_replace(sanitize_file_name(url), "&", "_"), F.lit(".html.br"))
