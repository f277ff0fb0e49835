"""Extractors: parsed pages of each source as documents, paragraphs, features and search-index names.

A source is described by a Source: how a page's address gives its id, and which elements hold its title,
author and paragraphs.  Pages are parsed in Arrow batches to one common shape; everything after that is
relational and the same for all sources.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import TYPE, WEIGHT10
from ..functions import nodes as N
from ..functions import text as T
from ..functions.html import format_fragment
from ..functions.references import Parser
from ..functions.selectors import Selectors, outermost
from ..plans.session import stored
from . import features as X
from . import ordered as O
from . import segments as Q

Accept = list[tuple[str, str | None, str | None]]

#: The common shape of a parsed page.
PARSED = (
    "url string, kind string, type smallint, name string, title string, author string, year int, phase string, forum string, date string, "
    "paragraphs array<struct<id:string,class:string,text:string,refs:array<struct<type:smallint,name:string,low_emphasis:boolean>>,"
    "marked:array<struct<words:string,type:smallint,name:string>>>>"
)

# Classes of paragraphs as documents store them.
CLASSES = {"header": 1, "subheader": 2, "study-summary": 3, "verse": 4, "poem": 5, "quote": 6, "caption": 7}


@dataclass(frozen=True)
class Source:
    """One kind of page."""

    kind: str
    address: str  # pattern of the address; its groups make the id
    node: str  # type of the document's node
    paragraph: str  # type of its paragraphs' nodes
    title: Accept
    body: Accept
    author: Accept = field(default_factory=list)
    classes: tuple[tuple[str, str], ...] = ()  # class words of paragraphs and what they mean
    body_pattern: str | None = None  # instead of body: a pattern whose first group is a paragraph
    numbered: bool = False  # paragraphs are numbered verses
    skip: tuple[str, ...] = ()  # ids that are no documents


_H1, _P = [("h1", None, None)], [("p", None, None)]
_POEM = (("line", "poem"), ("poetry", "poem"), ("blockquote", "quote"), ("kicker", "caption"), ("study-summary", "study-summary"))
_ENTRY = r'(?s)<p class="(?:entry|title)"[^>]*>(.+?)</p>'

SOURCES: dict[str, Source] = {
    s.kind: s
    for s in (
        Source("scripture_chapter", r"/study/scriptures/(?:bofm|ot|nt|dc-testament|pgp)/([^/?]+)/(\d+)", "ScriptureChapter", "ScriptureVerse", _H1, _P, classes=(("verse", "verse"), *_POEM), numbered=True),
        Source("conference_talk", r"/study/general-conference/(\d+)/(\d+)/([^/?]+)", "ConferenceTalk", "ConferenceTalkParagraph", _H1, _P, [("p", "class", "author-name"), ("div", "class", "byline")], _POEM),
        Source("topical_guide", r"/study/scriptures/tg/([^/?]+)", "TopicalGuideKeyword", "TopicalGuideKeyword", _H1, _P, body_pattern=_ENTRY, skip=("introduction",)),
        Source("guide_to_scriptures", r"/study/scriptures/gs/([^/?]+)", "GuideToScripturesTopic", "GuideToScripturesTopic", _H1, _P, body_pattern=_ENTRY, skip=("introduction",)),
        Source("triple_index", r"/study/scriptures/triple-index/([^/?]+)", "TripleIndexTopic", "TripleIndexTopic", _H1, _P, body_pattern=_ENTRY, skip=("introduction",)),
        Source("bible_dictionary", r"/study/scriptures/bd/([^/?]+)", "BibleDictionaryTopic", "BibleDictionaryParagraph", _H1, _P, skip=("introduction", "quotations")),
        Source("speech", r"/talks/([^/]+)/([^/?]+)", "ByuSpeech", "ByuSpeechParagraph", _H1, _P, [("h2", "class", "single-speech__speaker"), ("a", "class", "speaker")], _POEM),
        Source("hymn", r"/media/music/songs/([^/?]+)", "Hymn", "HymnVerse", _H1, _P),
        Source("proclamation", r"/study/scriptures/the-(living-christ|family)[^/?]*", "Proclamation", "ProclamationParagraph", _H1, _P),
        Source("book_chapter", r"/study/manual/([^/]+)/chapter-(\d+)", "BookChapter", "BookParagraph", _H1, _P, classes=_POEM),
    )
}
# Short ids of books and proclamations.
_SHORT = {"jesus-the-christ": "jtc", "living-christ": "lc", "family": "fam"}


def _id_of(source: Source, url: str) -> tuple[str, dict] | None:
    m = re.search(source.address, url)
    if not m or m[m.lastindex or 0] in source.skip:
        return None
    parts = [_SHORT.get(x, x) for x in m.groups()]
    if source.kind == "conference_talk":
        parts[1] = "04" if int(parts[1]) <= 6 else "10"
        return "|".join(parts), {"year": int(parts[0]), "phase": parts[1]}
    return "|".join(parts), {}


def _plain(html: str) -> str:
    return " ".join(re.sub(r"</?[bi]>", "", format_fragment(html).text).split())


def _clean_author(html: str) -> str:
    return re.sub(r"^(?:[Bb]y\s+)?(?:(?:Elder|President|Sister|Bishop|Brother)\s+)?", "", re.sub(r"\([^)]*\)", "", _plain(html))).strip()


#: All that a page of any source is read for, in one pass: titles, authors, forums, notes and paragraphs.
_FORUM = ["//a[@class~=\"single-speech__type\"]"]


def _paths(source: Source) -> dict[str, list[str]]:
    test = lambda t, a, v: f"//{t}" + (f'[@{a}~="{v}"]' if a and v is not None else f"[@{a}]" if a else "")
    each = lambda accept: [test(*x) for x in accept]
    return {"title": each(source.title), "author": each(source.author), "forum": _FORUM, "note": ["//li[@id]"], "body": [] if source.body_pattern else each(source.body)}


def _parse(source: Source, selectors: Selectors, url: str, html: str, parser: Parser) -> dict | None:
    found = _id_of(source, url)
    if not found:
        return None
    name, more = found
    if source.kind == "hymn" and (song := parse_song(html)):
        return {"url": url, "kind": source.kind, "type": TYPE[source.node], "name": name, "title": song["title"], "author": None, "paragraphs": song["paragraphs"], **more}
    page = {n: outermost(f) for n, f in selectors.match(html).items()}
    title = next((_plain(x.inner) for x in page["title"]), None)
    author = next((_clean_author(x.inner) for x in page["author"]), None)
    forum = next((_plain(x.inner) for x in page["forum"]), None)
    notes = {x.attrs["id"]: parser.everything(x.inner) for x in page["note"] if x.attrs["id"]}
    bodies = [({}, x) for x in re.findall(source.body_pattern, html)] if source.body_pattern else [(x.attrs, x.inner) for x in page["body"]]
    rows, k = [], 0
    for attrs, inner in bodies:
        words = (attrs.get("class") or "").split()
        if any(w in ("author-name", "author-role") for w in words):
            continue
        whole = format_fragment(inner)
        text = " ".join(whole.text.split())
        if not text:
            continue
        number = re.search(r'class="verse-number">\s*(\d+)', inner) if source.numbered else None
        k += 1
        pid = number[1] if number else (attrs.get("id") or str(k)) if source.numbered else attrs.get("id") or str(k)
        kind = next((c for w, c in source.classes if w in words), "verse" if number else None)
        refs, marked = {(t, n): low for t, n, low in parser.everything(inner)}, []
        for href, s, e in whole.links:
            for t, n, low in notes.get(href.partition("#")[2], []):
                refs.setdefault((t, n), low)
                marked.append({"words": re.sub(r"</?[bi]>", "", whole.text[s:e]), "type": t, "name": n})
        if source.numbered:  # links within the chapter say nothing new
            refs = {(t, n): low for (t, n), low in refs.items() if not n.startswith(f"{name}|")}
        rows.append({"id": pid, "class": kind, "text": text, "refs": [{"type": t, "name": n, "low_emphasis": low} for (t, n), low in refs.items()], "marked": marked})
    return {"url": url, "kind": source.kind, "type": TYPE[source.node], "name": name, "title": title, "author": author, "forum": forum, "paragraphs": rows, **more}


def parse_song(html: str, parser: Parser | None = None) -> dict | None:
    """Title and verses of a page that carries its song as JSON: {"title", "verses": [...], "scriptures": [...]}."""
    m = re.search(r'(?s)<script[^>]*id="__(?:NEXT|RENDER)_DATA__"[^>]*>(.+?)</script>', html)
    try:
        data = json.loads(m[1]) if m else None
    except ValueError:
        return None
    while isinstance(data, dict) and "verses" not in data:
        data = next((v for v in data.values() if isinstance(v, dict)), None)
    if not isinstance(data, dict):
        return None
    p = parser or Parser()
    refs = [{"type": t, "name": n, "low_emphasis": low} for s in data.get("scriptures") or [] for t, n, low in p.everything(str(s))]
    texts = [v if isinstance(v, str) else "\n".join(map(str, v.get("lines") or [v.get("text") or ""])) for v in data["verses"]]
    return {"title": data.get("title"), "paragraphs": [{"id": str(k + 1), "class": "poem", "text": t, "refs": refs if k == 0 else [], "marked": []} for k, t in enumerate(texts)]}


def parse_pages(pages: DataFrame, source: Source, parser: Parser | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages of one source in the common shape; other pages and null ones are left out."""
    p, selectors = parser or Parser(), Selectors(_paths(source))
    names = [c.split()[0] for c in PARSED.split(", ")[:-1]] + ["paragraphs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [x for u, h in zip(rows[url_col], rows[html_col], strict=True) if u and h and (x := _parse(source, selectors, u, h, p))]
            yield pd.DataFrame([[x.get(c) for c in names] for x in made], columns=names).astype({"year": "Int32"})

    mine = pages.where(F.col(url_col).rlike(source.address)).select(url_col, html_col)
    return mine.mapInPandas(run, PARSED)


def is_valid_talk(title: Column, author: Column) -> Column:
    """No reports of audits or finances, statistics, sustainings of officers or welfare meetings, and an author of sane length."""
    t, by = F.coalesce(title, F.lit("")), F.coalesce(author, F.lit(""))
    # What titles and authors tell that are no talks.
    report = (t.contains("Audit") | t.contains("Finance")) & t.contains("Report")
    sustaining = t.contains("Sustain") & t.contains("Officers")
    welfare = F.lower(t).contains("welfare services meeting") | F.lower(t).contains("welfare services session")
    return ~report & ~t.contains("Statistic") & ~sustaining & ~welfare & ~by.contains("Presented by") & by.rlike(r"\S") & (F.length(by) <= 70)


def is_devotional(parsed: DataFrame, least_paragraphs: int = 3, least_score: float = 1.0) -> DataFrame:
    """Speeches whose forum is just that of devotionals, in any case, with enough paragraphs and references: distinct chapters per paragraph x 600 / words."""
    chapters = lambda p: F.array_distinct(F.transform(F.filter(p["refs"], lambda r: r["type"] == TYPE["ScriptureVerse"]), lambda r: N.drop_last(r["name"])))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    n = total(F.transform("paragraphs", lambda p: F.size(chapters(p))))
    words = total(F.transform("paragraphs", lambda p: F.size(F.split(F.trim(p["text"]), r"\s+"))))
    forum = F.coalesce(F.lower(F.trim("forum")) == "devotional", F.lit(False))
    return parsed.where(forum & (F.size("paragraphs") >= least_paragraphs) & (words > 0) & (n * 600 / words >= least_score))


def paragraphs(parsed: DataFrame, source: Source) -> DataFrame:
    """(doc_type, doc_name, pos, type, name, class, text, refs, marked); lines of a poem are one paragraph."""
    p = parsed.select(F.col("type").alias("doc_type"), F.col("name").alias("doc_name"), F.posexplode("paragraphs").alias("pos", "p"))
    number = F.col("p.id").rlike(r"^\d+$")
    kind = F.when(F.lit(source.numbered) & ~number, TYPE["ScriptureSupplementalPara"]).otherwise(TYPE[source.paragraph]).cast("short")
    topic = source.node == source.paragraph  # index entries are the topic's own
    name = F.col("doc_name") if topic else F.concat_ws("|", "doc_name", F.regexp_replace("p.id", r"^p(\d+)$", "$1"))
    return p.select("doc_type", "doc_name", "pos", kind.alias("type"), name.alias("name"), F.col("p.class").alias("class"), F.col("p.text").alias("text"), F.col("p.refs").alias("refs"), F.col("p.marked").alias("marked"))


def merge_poems(paras: DataFrame) -> DataFrame:
    """Consecutive lines of a poem as one paragraph, at the place of the first."""
    w = Window.partitionBy("doc_type", "doc_name").orderBy("pos")
    line = F.coalesce(F.col("class") == "poem", F.lit(False))
    r = paras.withColumn("_new", (~line | ~F.coalesce(F.lag(line).over(w), F.lit(False))).cast("int"))
    r = r.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "pos").alias(c)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return r.groupBy("doc_type", "doc_name", "_run").agg(F.min("pos").alias("pos"), first("type"), first("name"), first("class"), texts.alias("text"), flat("refs"), flat("marked")).drop("_run")


def _pairs(rows: DataFrame, at: Column, an: Column, bt: Column, bn: Column, weight: Column | int) -> DataFrame:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return rows.select(at.cast("short").alias("a_type"), an.alias("a_name"), bt.cast("short").alias("b_type"), bn.alias("b_name"), w.cast("long").alias("weight10")).where(F.col("a_name").isNotNull() & F.col("b_name").isNotNull())


def _word_pairs(rows: DataFrame, at: Column, an: Column, text: Column, weight: int) -> DataFrame:
    """An entity with each word and n-gram of a text."""
    of = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(TYPE[kind]).cast("short").alias("type"), F.concat(x, F.lit("|en")).alias("name")))
    both = T.let(T.words(F.lower(text)), lambda ws: F.concat(of("Word", ws), of("NGram", F.concat(T.ngrams(ws, 2), T.ngrams(ws, 3)))))
    r = rows.select(at.cast("short").alias("a_type"), an.alias("a_name"), F.explode(both).alias("g"))
    return r.select("a_type", "a_name", F.col("g.type").alias("b_type"), F.col("g.name").alias("b_name"), F.lit(weight).cast("long").alias("weight10"))


def features(parsed: DataFrame, source: Source, text_features: bool = True) -> DataFrame:
    """All features of a source: names, document and paragraph structure, references, marked words, and (intended) words of the text."""
    paras = merge_poems(paragraphs(parsed, source)) if source.classes else paragraphs(parsed, source)
    c, t = F.col, TYPE
    strong = WEIGHT10["WordDesignation"]
    out = [_word_pairs(parsed, c("type"), c("name"), F.coalesce("title", F.lit("")), strong)]
    topic = source.node == source.paragraph
    if not topic:
        out.append(_pairs(paras, c("type"), c("name"), c("doc_type"), c("doc_name"), 10))
        before = Window.partitionBy("doc_type", "doc_name").orderBy("pos")
        linked = paras.withColumn("_t", F.lag("type").over(before)).withColumn("_n", F.lag("name").over(before))
        out.append(_pairs(linked, c("type"), c("name"), c("_t"), c("_n"), 10))
    refs = paras.select("type", "name", F.explode("refs").alias("r"))
    weight = F.when(c("r.low_emphasis"), WEIGHT10["ScriptureReferenceWithoutEmphasis"]).otherwise(WEIGHT10["ScriptureReference"])
    out.append(_pairs(refs, c("type"), c("name"), c("r.type"), c("r.name"), weight))
    marked = paras.select(F.explode("marked").alias("m"))
    out.append(_word_pairs(marked, c("m.type"), c("m.name"), c("m.words"), strong))
    if topic:  # the topic's words with each reference of an entry
        entries = parsed.select("title", F.explode("paragraphs").alias("p")).select("title", F.explode("p.refs").alias("r"))
        out.append(_word_pairs(entries, c("r.type"), c("r.name"), F.coalesce("title", F.lit("")), strong))
    if source.author:
        by = parsed.where(F.trim(F.coalesce("author", F.lit(""))) != "")
        who = N.speaker(c("author"))
        out += [_word_pairs(by, F.lit(t["ConferenceSpeaker"]), who["name"], c("author"), strong), _pairs(by, c("type"), c("name"), F.lit(t["ConferenceSpeaker"]), who["name"], 10)]
    if source.kind == "conference_talk":
        conf = F.concat_ws("|", c("year").cast("string"), "phase")
        year = c("year").cast("string")
        out += [
            _pairs(parsed, c("type"), c("name"), F.lit(t["Conference"]), conf, 10),
            _pairs(parsed.select("year", "phase").distinct(), F.lit(t["Year"]), year, F.lit(t["Conference"]), conf, 10),
            _pairs(parsed.select("year").distinct(), F.lit(t["Year"]), year, F.lit(t["Year"]), (c("year") - 1).cast("string"), 10),
        ]
    if source.kind == "scripture_chapter":
        book, number = F.split_part("name", F.lit("|"), F.lit(1)), F.split_part("name", F.lit("|"), F.lit(2)).cast("int")
        out += [
            _pairs(parsed, c("type"), c("name"), F.lit(t["ScriptureBook"]), book, 10),
            _pairs(parsed.where(number > 1), c("type"), c("name"), c("type"), F.concat_ws("|", book, (number - 1).cast("string")), 10),
        ]
    if text_features:
        keyed = paras.withColumn("_key", F.concat_ws(" ", c("type").cast("string"), "name"))
        made = X.text_features(keyed, "_key", "text", entity="Entity")
        own = made["a_type"] == t["Entity"]
        out.append(made.select(
            F.when(own, F.split(made["a_name"], " ", 2)[0].cast("short")).otherwise(made["a_type"]).alias("a_type"),
            F.when(own, F.split(made["a_name"], " ", 2)[1]).otherwise(made["a_name"]).alias("a_name"), "b_type", "b_name", "weight10",
        ))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def search_names(parsed: DataFrame, source: Source) -> DataFrame:
    """(type, name, plain_name, disambig_name): index names; index topics are inverted at their comma and lose brackets."""
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s*[\[(][^\])]*[\])]\s*", " "))
    if source.node == source.paragraph:
        for _ in range(3):
            title = T.comma_inversion(title)
    display = F.when(F.coalesce("author", F.lit("")) != "", F.concat(title, F.lit(" ("), F.col("author"), F.when(F.col("year").isNotNull(), F.concat(F.lit(", "), F.col("year").cast("string"))).otherwise(""), F.lit(")"))).otherwise(title)
    return parsed.select("type", "name", title.alias("plain_name"), display.alias("disambig_name")).where("plain_name <> ''")


def search_features(parsed: DataFrame, source: Source) -> DataFrame:
    """Character-level features of index names."""
    return X.char_features(search_names(parsed, source), text_col="plain_name")


def documents(parsed: DataFrame, source: Source) -> DataFrame:
    """Documents to store, with their paragraphs in order and the neighbours of chapters."""
    paras = merge_poems(paragraphs(parsed, source)) if source.classes else paragraphs(parsed, source)
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), F.coalesce("class", F.lit(""))), F.lit(0))
    item = F.struct("pos", N.to_text(F.col("type"), F.col("name")).alias("eid"), F.col("text").alias("t"), code.alias("c"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["eid"].alias("eid"), x["t"].alias("t"), x["c"].alias("c"), F.array().cast("array<struct<eid:string,start:int,end:int>>").alias("r")))
    bodies = paras.groupBy(F.col("doc_type").alias("type"), F.col("doc_name").alias("name")).agg(listed.alias("paragraphs"))
    heads = parsed.select("type", "name", "title", F.col("author").alias("speaker"), "year", "phase")
    joined = heads.join(bodies, ["type", "name"])
    return joined.select(F.lit(source.kind).alias("type"), N.to_text(F.col("type"), F.col("name")).alias("eid"), F.lit("en").alias("lang"), "title", "speaker", "year", "phase", "paragraphs")


# Headings of an encyclopedia, lines that look like one but are none, lines that refer to other topics and those that go on with that, and lines with a word.
HEADING, NO_HEADING = r"^ *\( *(.+) .{0,4}$", "Discourses of Wilford Woodruff"
SEE, SEE_ON, MEANINGFUL = r"^ *See +([A-Z][a-zA-Z, '.()-]+)$", r"^ *[A-Z, '.()-]+ *$", r"[a-zA-Z]{3}"
SHORT_TOPIC = 30


def segment_encyclopedia(paras: DataFrame, heading: str = HEADING) -> DataFrame:
    """(archive, number, topic, text, length, see): encyclopedia_topics() with the topics that are referred to as an array."""
    return encyclopedia_topics(paras, heading).withColumn("see", F.filter(F.split("see", ","), lambda x: x != ""))


def encyclopedia_topics(paras: DataFrame, heading: str = HEADING) -> DataFrame:
    """(archive, number, topic, text, length, see): an encyclopedia's stream of paragraphs (archive, file, pos, text) cut at its headings.

    Page headers that repeat a nearby topic are dropped, lines that refer to other topics are read as such, and topics of
    less than 30 characters stay only, and without their text, if they refer to others, which are joined by commas.  An archive is never
    ordered by one task, nor is a topic: its lines are joined within ranges of the order, and what is gathered for a topic is one text a range."""
    group, order = ["archive"], ["file", "pos"]
    found = F.when(~F.col("text").contains(NO_HEADING), F.regexp_extract("text", heading, 1))
    name = F.regexp_replace(F.trim(found), r"[) ]+$", "")
    rows = Q.topic_stream(paras.withColumn("_name", F.when(name != "", name)), group, order, "_name", parts=True)
    # what a line is: a reference, text, or one that depends on which of the two came last
    line = F.trim(F.regexp_replace("text", " +", " "))
    rows = stored(rows.select(*group, "number", "topic", "_part", *order, line.alias("text")))
    sees, goes_on, says = F.col("text").rlike(SEE), F.col("text").rlike(SEE_ON), F.col("text").rlike(MEANINGFUL)
    rows = O.running(rows, [*group, "number"], order, last={"_before": F.when(sees, "see").when(says & ~goes_on, "text")})  # a line that goes on tells nothing itself
    kind = F.when(sees, "see").when(goes_on & F.coalesce(F.col("_before") == "see", F.lit(False)), "on").when(says, "text")
    split = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    undotted = F.filter(F.transform(split(F.regexp_extract("text", SEE, 1)), lambda x: F.regexp_replace(x, r"^\.+|\.+$", "")), lambda x: F.trim(x) != "")
    rows = rows.withColumn("_kind", kind)
    to = F.when(F.col("_kind") == "see", undotted).when(F.col("_kind") == "on", split(F.col("text")))
    rows = rows.withColumn("see", F.when(F.size(to) > 0, F.array_join(to, ","))).withColumn("text", F.when(F.col("_kind") == "text", F.col("text")))

    def joined(name: str, by: list[str], sep: str) -> Column:
        at = F.when(F.col(name).isNotNull(), F.struct(*by, name))
        return F.when(F.count(name) > 0, F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda x: x[name]), sep)).alias(name)

    topic = [*group, "number", "topic"]
    pieces = rows.groupBy(*topic, "_part").agg(joined("text", order, "\n"), joined("see", order, ","), F.sum(F.length("text")).alias("length"))
    topics = pieces.groupBy(*topic).agg(joined("text", ["_part"], "\n"), joined("see", ["_part"], ","), F.coalesce(F.sum("length"), F.lit(0)).cast("int").alias("length"))
    long = F.col("length") >= SHORT_TOPIC
    return topics.where(long | F.col("see").isNotNull()).select(*topic, F.when(long, F.col("text")).otherwise("").alias("text"), F.when(long, F.col("length")).otherwise(0).alias("length"), F.coalesce("see", F.lit("")).alias("see"))


def see_also(topics: DataFrame, book: str = "md") -> DataFrame:
    """Features between a topic and those it refers to."""
    name = lambda x: F.concat(F.lit(f"{book}|"), F.lower(x))
    return _pairs(topics.select("topic", F.explode("see").alias("to")), F.lit(TYPE["BookChapter"]), name(F.col("topic")), F.lit(TYPE["BookChapter"]), name(F.col("to")), 10)


def book_pages(files: DataFrame, book: Callable[[Column], Column] | str, number: Column) -> DataFrame:
    """Files of an archive as pages of the book_chapter source, so that books and web pages share one path."""
    name = F.lit(book) if isinstance(book, str) else book(number)
    return files.select(F.concat(F.lit("/study/manual/"), name, F.lit("/chapter-"), number.cast("string")).alias("url"), "html").where(F.col("url").isNotNull())
