"""Node ids: two columns, a type number and a name of parts joined by |."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import BOOKS, DEFAULT_WEIGHT10, REFERENCE_WORKS, SENTENCE_OF, TYPE, WEIGHT10


def _c(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def type_of(kind: str) -> Column:
    return F.lit(TYPE[kind]).cast("short")


def node(kind: str, *parts: Column | str | int) -> Column:
    """struct (type, name)."""
    return F.struct(type_of(kind).alias("type"), F.concat_ws("|", *[_c(p).cast("string") for p in parts]).alias("name"))


def word(w: Column | str, lang: Column | str = "en") -> Column:
    return node("Word", w, lang)


def ngram(*ws: Column | str, lang: Column | str = "en") -> Column:
    return node("NGram", *ws, lang)


def char_ngram(chars: Column | str) -> Column:
    return node("CharNGram", chars)


def entity(name: Column | str) -> Column:
    return node("Entity", name)


def verse(book: Column | str, chapter: Column | int, number: Column | int) -> Column:
    return node("ScriptureVerse", book, chapter, number)


def supplemental(book: Column | str, chapter: Column | int, paragraph: Column | str) -> Column:
    return node("ScriptureSupplementalPara", book, chapter, paragraph)


def chapter(book: Column | str, number: Column | int) -> Column:
    return node("ScriptureChapter", book, number)


def book(name: Column | str) -> Column:
    return node("ScriptureBook", name)


def topic(work: str, name: Column | str) -> Column:
    """A topic of a reference work (tg, bd, gs, triple-index)."""
    return node(REFERENCE_WORKS[work], name)


def dictionary_paragraph(name: Column | str, paragraph: Column | str | int) -> Column:
    return node("BibleDictionaryParagraph", name, paragraph)


def phase(month: Column) -> Column:
    """04 for months up to June, else 10."""
    return F.when(month <= 6, F.lit("04")).otherwise(F.lit("10"))


def conference(year: Column | int, ph: Column | str) -> Column:
    return node("Conference", year, ph)


def year(number: Column | int) -> Column:
    return node("Year", number)


def talk(yr: Column | int, ph: Column | str, talk_id: Column | str) -> Column:
    return node("ConferenceTalk", yr, ph, talk_id)


def talk_paragraph(yr: Column | int, ph: Column | str, talk_id: Column | str, paragraph: Column | str | int) -> Column:
    return node("ConferenceTalkParagraph", yr, ph, talk_id, paragraph)


def speaker(name: Column | str) -> Column:
    """Speakers by their names in lower case, without dots."""
    return node("ConferenceSpeaker", F.translate(F.lower(_c(name)), ".", ""))


def speech(speaker_id: Column | str, speech_id: Column | str) -> Column:
    return node("ByuSpeech", speaker_id, speech_id)


def speech_paragraph(speaker_id: Column | str, speech_id: Column | str, paragraph: Column | str | int) -> Column:
    return node("ByuSpeechParagraph", speaker_id, speech_id, paragraph)


def hymn(song: Column | str) -> Column:
    return node("Hymn", song)


def hymn_verse(song: Column | str, number: Column | str | int) -> Column:
    return node("HymnVerse", song, number)


def proclamation(name: Column | str) -> Column:
    return node("Proclamation", name)


def proclamation_paragraph(name: Column | str, paragraph: Column | str | int) -> Column:
    return node("ProclamationParagraph", name, paragraph)


def book_chapter(name: Column | str, number: Column | str | int) -> Column:
    return node("BookChapter", name, number)


def book_paragraph(name: Column | str, number: Column | str | int, paragraph: Column | str | int) -> Column:
    return node("BookParagraph", name, number, paragraph)


# codecs and checks


def to_text(kind: Column, name: Column) -> Column:
    """The text form, `<type> <name>`."""
    return F.concat(kind.cast("string"), F.lit(" "), name)


def from_text(text: Column) -> Column:
    """struct (type, name) of a text form; an error if it has none."""
    ok = text.rlike(r"(?s)^\d+ .+$")
    checked = F.when(ok, text).otherwise(F.raise_error(F.concat(F.lit("no node id: "), text)).cast("string"))
    parts = F.split(F.when(text.isNotNull(), checked), " ", 2)
    return F.struct(parts[0].cast("short").alias("type"), parts[1].alias("name"))


def is_valid(name: Column) -> Column:
    return F.length(name).between(1, 255)


def weight10(feature: Column) -> Column:
    """Weight of a feature type, in tenths."""
    known = F.create_map(*[F.lit(x) for kv in WEIGHT10.items() for x in kv])
    return F.coalesce(F.try_element_at(known, feature), F.lit(DEFAULT_WEIGHT10)).cast("long")


# maps between entities


def _by_type(kind: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x).cast("short") for a, b in table.items() for x in (TYPE[a], TYPE[b])])
    return F.try_element_at(known, kind)


def drop_last(name: Column, parts: int = 1) -> Column:
    return F.regexp_replace(name, rf"(?:\|[^|]*){{{parts}}}$", "")


def to_sentence(kind: Column, name: Column, index: Column) -> Column:
    """Sentence node of a paragraph (1-based index); null for types without sentences."""
    t = _by_type(kind, SENTENCE_OF)
    return F.when(t.isNotNull(), F.struct(t.alias("type"), F.concat_ws("|", name, index.cast("string")).alias("name")))


def to_paragraph(kind: Column, name: Column) -> Column:
    """Paragraph node of a sentence; other nodes as they are."""
    t = _by_type(kind, {v: k for k, v in SENTENCE_OF.items()})
    return F.struct(F.coalesce(t, kind).alias("type"), F.when(t.isNotNull(), drop_last(name)).otherwise(name).alias("name"))


# Documents that paragraphs belong to.
_OWNER = {
    "ScriptureVerse": "ScriptureChapter", "ScriptureSupplementalPara": "ScriptureChapter", "BibleDictionaryParagraph": "BibleDictionaryTopic",
    "ConferenceTalkParagraph": "ConferenceTalk", "BookParagraph": "BookChapter", "ByuSpeechParagraph": "ByuSpeech", "HymnVerse": "Hymn",
    "ProclamationParagraph": "Proclamation",
}


def to_document(kind: Column, name: Column) -> Column:
    """The document that an entity belongs to: sentences and paragraphs their document, a book its first chapter."""
    p = to_paragraph(kind, name)
    t = _by_type(p["type"], _OWNER)
    is_book = p["type"] == TYPE["ScriptureBook"]
    return F.struct(
        F.when(is_book, type_of("ScriptureChapter")).otherwise(F.coalesce(t, p["type"])).alias("type"),
        F.when(is_book, F.concat(p["name"], F.lit("|1"))).when(t.isNotNull(), drop_last(p["name"])).otherwise(p["name"]).alias("name"),
    )


def to_named_document(kind: Column, name: Column) -> Column:
    """Like to_document(), but verses, supplements and books name themselves."""
    p = to_paragraph(kind, name)
    own = p["type"].isin([TYPE[t] for t in ("ScriptureVerse", "ScriptureSupplementalPara", "ScriptureBook")])
    d = to_document(kind, name)
    return F.when(own, F.struct(p["type"].alias("type"), p["name"].alias("name"))).otherwise(d)


# Result types by node type, other types are unknown; books by the beginning of their names.
_RESULT = {
    "ScriptureBook": "ScriptureBook", "ScriptureChapter": "ScriptureChapter", "ScriptureVerse": "ScriptureVerse", "ConferenceSpeaker": "Person",
    "ConferenceTalk": "ConferenceTalk", "ConferenceTalkParagraph": "ConferenceTalk", "BibleDictionaryTopic": "BibleDictionary", "BibleDictionaryParagraph": "BibleDictionary",
    "TopicalGuideKeyword": "Topic", "TripleIndexTopic": "Topic", "GuideToScripturesTopic": "Topic", "ByuSpeech": "ByuSpeech", "ByuSpeechParagraph": "ByuSpeech",
    "Hymn": "Hymn", "HymnVerse": "Hymn", "Proclamation": "Proclamation", "ProclamationParagraph": "Proclamation",
}
_BOOK_PREFIX = {"atgq|": "BookATGQ", "md|": "BookMD", "messiah1|": "BookMessiah1", "messiah2|": "BookMessiah2", "messiah3|": "BookMessiah3"}


def result_type(kind: Column, name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for a, b in _RESULT.items() for x in (TYPE[a], b)])
    of_book = reduce(lambda w, kv: w.when(name.startswith(kv[0]), F.lit(kv[1])), _BOOK_PREFIX.items(), F)
    books = kind.isin([TYPE["BookChapter"], TYPE["BookParagraph"]])
    return F.coalesce(F.when(books, of_book.otherwise(F.lit("Unknown"))), F.try_element_at(known, kind.cast("int")), F.lit("Unknown"))


def canon_of(kind: Column, name: Column) -> Column:
    """Canon of a verse, chapter, supplement or book."""
    known = F.create_map(*[F.lit(x) for b in BOOKS for x in b[:2]])
    return F.try_element_at(known, F.split_part(name, F.lit("|"), F.lit(1)))


# What each output filter is for; one is for all books.
CATEGORIES = ("ot", "nt", "bofm", "dc-testament", "pgp", "ConferenceTalk", "BibleDictionary", "Book", "ByuSpeech", "Hymn")
_CATEGORY = {
    "ConferenceTalk": "ConferenceTalk", "ConferenceTalkParagraph": "ConferenceTalk", "BibleDictionaryTopic": "BibleDictionary", "BibleDictionaryParagraph": "BibleDictionary",
    "BookChapter": "Book", "BookParagraph": "Book", "ByuSpeech": "ByuSpeech", "ByuSpeechParagraph": "ByuSpeech", "Hymn": "Hymn", "HymnVerse": "Hymn",
}
NO_FILTER, NO_BOOK = "NoFilter", "NoBook"


def category(kind: Column, name: Column) -> Column:
    """What output filters go by: a canon, or a kind of document; NO_FILTER for what is always shown, NO_BOOK for scripture of an unknown book."""
    scripture = kind.isin([TYPE[t] for t in ("ScriptureVerse", "ScriptureChapter", "ScriptureBook")])
    known = F.create_map(*[F.lit(x) for a, b in _CATEGORY.items() for x in (TYPE[a], b)])
    return F.when(scripture, F.coalesce(canon_of(kind, name), F.lit(NO_BOOK))).otherwise(F.coalesce(F.try_element_at(known, kind.cast("int")), F.lit(NO_FILTER)))


def pretty(kind: Column, name: Column) -> Column:
    """A verse, chapter or book in words; null for other nodes."""
    known = F.create_map(*[F.lit(x) for b in BOOKS for x in (b[0], b[2])])
    parts = F.split(name, r"\|")
    at = lambda k: F.get(parts, k)
    title = F.try_element_at(known, at(0))
    return (
        F.when(kind == TYPE["ScriptureVerse"], F.concat(title, F.lit(" "), at(1), F.lit(":"), at(2)))
        .when(kind == TYPE["ScriptureChapter"], F.concat(title, F.lit(" "), at(1)))
        .when(kind == TYPE["ScriptureBook"], title)
    )
