"""Queries over pages of every kind of source, made of the rows of `part`, so that SQL can tell from the rows what the pages must give.

A page is written as its source writes it (address, header, author, paragraphs with links, notes, a song as JSON);
the operators read it back from the HTML.  Each row gives one page of one source, by its number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dims import TYPE
from .operators import extractors as E
from .plans.session import cut
from .queries import query, table
from .sources import crawl as C

SITE = "https://site.test"
# What both engines compute from a row's number k; j is the number of a paragraph.
COUNT = "(1 + k % 3)"
YEAR, PHASE = "(1980 + k % 40)", "CASE WHEN k % 4 < 2 THEN '04' ELSE '10' END"
LINK = "'<a href=\"/study/scriptures/bofm/alma/' || (1 + k % 60) || '?lang=eng&amp;id=p' || j || '\">see it</a>'"
BODY = "'alpha' || (k % 5) || ' beta' || j || ' '"
TITLE, TOPIC = "'Lamp ' || (k % 7) || ' of the harbour ' || (k % 3)", "'Harbour ' || (k % 7) || ', old'"
AUTHOR = "'John Q. Lamp' || (k % 9)"
#: kind: the address behind the site, the name of the document, the title
SITES = {
    "scripture_chapter": ("'/study/scriptures/ot/ps/' || k || '?lang=eng'", "'ps|' || k", TITLE),
    "conference_talk": (f"'/study/general-conference/' || {YEAR} || '/' || {PHASE} || '/talk' || k || '?lang=eng'", f"{YEAR} || '|' || {PHASE} || '|talk' || k", TITLE),
    "topical_guide": ("'/study/scriptures/tg/topic' || k || '?lang=eng'", "'topic' || k", TOPIC),
    "guide_to_scriptures": ("'/study/scriptures/gs/topic' || k || '?lang=eng'", "'topic' || k", TOPIC),
    "triple_index": ("'/study/scriptures/triple-index/topic' || k || '?lang=eng'", "'topic' || k", TOPIC),
    "bible_dictionary": ("'/study/scriptures/bd/topic' || k || '?lang=eng'", "'topic' || k", TITLE),
    "speech": ("'/talks/speaker' || (k % 9) || '/speech' || k", "'speaker' || (k % 9) || '|speech' || k", TITLE),
    "hymn": ("'/media/music/songs/song' || k || '?lang=eng'", "'song' || k", TITLE),
    "book_chapter": ("'/study/manual/jesus-the-christ/chapter-' || k || '?lang=eng'", "'jtc|' || k", TITLE),
    "proclamation": ("'/study/scriptures/the-family-a-proclamation' || k || '?lang=eng'", "'fam'", TITLE),
}
KINDS = list(SITES)
TOPICS, AUTHORS = ("topical_guide", "guide_to_scriptures", "triple_index"), ("conference_talk", "speech")


def _html(kind: str) -> str:
    """Spark SQL for a page's HTML."""
    each = lambda p: f"concat_ws('', transform(sequence(1, {COUNT}), j -> {p}))"
    head = f"'<html><body><h1>' || {SITES[kind][2]} || '</h1>' || "
    by = {"conference_talk": f"'<p class=\"author-name\">By Elder ' || {AUTHOR} || ' (of the council)</p>' || ", "speech": f"'<h2 class=\"single-speech__speaker\">' || {AUTHOR} || '</h2>' || "}.get(kind, "")
    para = f"'<p id=\"p' || j || '\">' || {BODY} || {LINK} || '</p>'"
    note = "'<li id=\"n' || j || '\"><a href=\"/study/scriptures/ot/josh/' || (1 + k % 20) || '?lang=eng&amp;id=p' || j || '\">x</a></li>'"
    notes = " || '<ul>' || " + each(note) + " || '</ul></body></html>'"
    if kind == "scripture_chapter":  # verses have links of their own, and words that lead to notes
        para = f"'<p class=\"verse\" id=\"x' || j || '\"><span class=\"verse-number\">' || j || ' </span>' || {BODY} || {LINK} || ' <a href=\"#n' || j || '\">bright lamp</a></p>'"
        return head + each(para) + notes
    elif kind in TOPICS:
        para = f"'<p class=\"entry\" id=\"e' || j || '\">' || {BODY} || {LINK} || '</p>'"
    elif kind == "speech":  # every other speech is a poem
        para = f"'<p class=\"' || CASE WHEN k % 20 < 10 THEN 'line' ELSE 'plain' END || '\" id=\"p' || j || '\">' || {BODY} || {LINK} || '</p>'"
    elif kind == "book_chapter":  # references stand in notes
        para = f"'<p id=\"p' || j || '\">' || {BODY} || '<a href=\"#n' || j || '\">bright lamp</a></p>'"
        return head + each(para) + notes
    elif kind == "hymn":
        verses = f"concat_ws(',', transform(sequence(1, {COUNT}), j -> '\"' || trim({BODY}) || '\"'))"
        return head + f"""'<script id="__NEXT_DATA__" type="application/json">{{"page": {{"title": "' || {TITLE} || '", "verses": [' || {verses} || '], "scriptures": ["Alma ' || (1 + k % 60) || ':1"]}}}}</script></body></html>'"""
    return head + by + each(para) + " || '</body></html>'"


def _mine(kind: str) -> str:
    """Which rows a kind of page takes; of proclamations there is one."""
    return "k = 9" if kind == "proclamation" else f"k % 10 = {KINDS.index(kind)}" + (" AND k <> 9" if KINDS.index(kind) == 9 else "")


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): a page for each part."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    one = lambda kind: k.where(_mine(kind)).select(F.col("k").alias("page_id"), F.concat(F.lit(SITE), F.expr(SITES[kind][0])).alias("url"), F.expr(_html(kind)).alias("html"))
    return reduce(DataFrame.union, map(one, KINDS))


def _each(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    pages = site_pages(spark, sf_dir)
    return reduce(DataFrame.unionByName, [f(cut(E.parse_pages(pages, E.SOURCES[kind])), E.SOURCES[kind]).withColumn("kind", F.lit(kind)) for kind in KINDS])


# ---- the same in SQL, from the rows

def _tables(kind: str) -> str:
    """SQL: d(k, type, name, title), a paragraph per j: p(k, j, pos, type, name, text), r(k, type, name, ref_type, ref_name): references of paragraphs."""
    s, verse = E.SOURCES[kind], TYPE["ScriptureVerse"]
    text = f"trim({BODY})" if kind == "hymn" else f"{BODY} || 'bright lamp'" if kind == "book_chapter" else f"j || ' ' || {BODY} || 'see it bright lamp'" if kind == "scripture_chapter" else f"{BODY} || 'see it'"
    name = "name" if kind in TOPICS else "name || '|' || j"
    josh, alma = "'josh|' || (1 + k % 20) || '|' || j", "'alma|' || (1 + k % 60) || '|' || j"
    ref = {"book_chapter": josh, "scripture_chapter": f"unnest([{alma}, {josh}])"}.get(kind, alma)
    poem = "k % 20 < 10" if kind == "speech" else "false"
    first = "name || '|1'"
    return f"""{kind}_d AS (SELECT k, {TYPE[s.node]} AS type, {SITES[kind][1]} AS name, {SITES[kind][2]} AS title FROM (SELECT p_partkey AS k FROM part) WHERE {_mine(kind)}),
{kind}_q AS (SELECT k, name AS doc, unnest(range(1, {COUNT} + 1)) AS j FROM {kind}_d),
{kind}_t AS (SELECT k, doc, j, {TYPE[s.paragraph]} AS type, CASE WHEN {poem} THEN {first.replace('name', 'doc')} ELSE {name.replace('name', 'doc')} END AS name, {text} AS text FROM {kind}_q),
{kind}_p AS (SELECT k, doc, CASE WHEN {poem} THEN 1 ELSE j END AS j, type, name, string_agg(text, chr(10) ORDER BY j) AS text FROM {kind}_t GROUP BY k, doc, CASE WHEN {poem} THEN 1 ELSE j END, type, name),
{kind}_r AS (SELECT k, type, name, {verse} AS ref_type, {ref} AS ref_name FROM {kind}_t{" WHERE j = 1" if kind == "hymn" else ""})"""


def _words(at: str, an: str, ws: str, weight: int, source: str) -> list[str]:
    grams = f"list_concat(list_transform(range(1, len(ws)), lambda i: ws[i] || '|' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || '|' || ws[i + 1] || '|' || ws[i + 2]))"
    pick = lambda t, names: f"SELECT a_type, a_name, {t} AS b_type, unnest({names}) || '|en' AS b_name, {weight} AS weight10 FROM (SELECT {at} AS a_type, {an} AS a_name, {ws} AS ws FROM {source})"
    return [pick(TYPE["Word"], "ws"), pick(TYPE["NGram"], grams)]


def _features_sql(kind: str) -> str:
    a = "CAST(k % 7 AS VARCHAR)"
    title = f"['harbour', {a}, 'old']" if kind in TOPICS else f"['lamp', {a}, 'of', 'the', 'harbour', CAST(k % 3 AS VARCHAR)]"
    author, who = "['john', 'q', 'lamp' || (k % 9)]", "'john q lamp' || (k % 9)"
    pair = lambda at, an, bt, bn, w, frm: f"SELECT {at}, {an}, {bt}, {bn}, {w} FROM {frm}"
    d, p, r = f"{kind}_d", f"{kind}_p", f"{kind}_r"
    out = _words("type", "name", title, 30, d)
    if kind not in TOPICS:
        out.append(pair("type", "name", E.SOURCES[kind].node and TYPE[E.SOURCES[kind].node], "doc", 10, p))
        out.append(f"SELECT type, name, before_type, before_name, 10 FROM (SELECT type, name, lag(type) OVER w AS before_type, lag(name) OVER w AS before_name FROM {p} WINDOW w AS (PARTITION BY k ORDER BY j)) WHERE before_name IS NOT NULL")
    out.append(pair("type", "name", "ref_type", "ref_name", 10, r))
    if kind in ("book_chapter", "scripture_chapter"):
        out += _words("ref_type", "ref_name", "['bright', 'lamp']", 30, f"(SELECT * FROM {r} WHERE ref_name LIKE 'josh|%')")
    if kind in TOPICS:
        out += _words("ref_type", "ref_name", title, 30, r)
    if kind in AUTHORS:
        speaker = TYPE["ConferenceSpeaker"]
        out += [*_words(speaker, who, author, 30, d), pair("type", "name", speaker, who, 10, d)]
    if kind == "conference_talk":
        conf, year = f"{YEAR} || '|' || {PHASE}", f"CAST({YEAR} AS VARCHAR)"
        out += [
            pair("type", "name", TYPE["Conference"], conf, 10, d), f"SELECT DISTINCT {TYPE['Year']}, {year}, {TYPE['Conference']}, {conf}, 10 FROM {d}",
            f"SELECT DISTINCT {TYPE['Year']}, {year}, {TYPE['Year']}, CAST({YEAR} - 1 AS VARCHAR), 10 FROM {d}",
        ]
    if kind == "scripture_chapter":
        out += [pair("type", "name", TYPE["ScriptureBook"], "'ps'", 10, d), pair("type", "name", "type", "'ps|' || (k - 1)", 10, f"(SELECT * FROM {d} WHERE k > 1)")]
    return f"SELECT '{kind}' AS kind, a_type::INT AS a_type, a_name, b_type::INT AS b_type, b_name, weight10::BIGINT AS weight10 FROM (" + " UNION ALL ".join(out) + ")"


ALL = "WITH " + ",\n".join(map(_tables, KINDS))


@query(ALL + " SELECT kind, a_type, a_name, b_type, b_name, weight10, count(*)::BIGINT AS n FROM (" + "\nUNION ALL ".join(map(_features_sql, KINDS)) + ") GROUP BY ALL")
def site_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages of each source teach."""
    f = _each(spark, sf_dir, lambda parsed, s: E.features(parsed, s, text_features=False))
    f = f.select("kind", F.col("a_type").cast("int").alias("a_type"), "a_name", F.col("b_type").cast("int").alias("b_type"), "b_name", "weight10")
    return f.groupBy(*f.columns).agg(F.count("*").alias("n"))


def _names_sql(kind: str) -> str:
    plain = "'old Harbour ' || (k % 7)" if kind in TOPICS else "title"
    shown = {"conference_talk": f"title || ' (' || {AUTHOR} || ', ' || {YEAR} || ')'", "speech": f"title || ' (' || {AUTHOR} || ')'"}.get(kind, plain)
    return f"SELECT '{kind}' AS kind, type::INT AS type, name, {plain} AS plain_name, {shown} AS disambig_name FROM {kind}_d"


@query(ALL + " " + " UNION ALL ".join(map(_names_sql, KINDS)))
def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the search index, topics turned round at their comma."""
    return _each(spark, sf_dir, E.search_names).select("kind", F.col("type").cast("int").alias("type"), "name", "plain_name", "disambig_name")


def _documents_sql(kind: str) -> str:
    code = E.CLASSES["verse"] if kind == "scripture_chapter" else f"CASE WHEN k % 20 < 10 THEN {E.CLASSES['poem']} ELSE 0 END" if kind == "speech" else E.CLASSES["poem"] if kind == "hymn" else 0
    speaker = AUTHOR if kind in AUTHORS else "NULL"
    return f"""SELECT '{kind}' AS kind, d.type || ' ' || d.name AS eid, title, {speaker.replace("k %", "d.k %")} AS speaker, pos::INT AS pos, p.type || ' ' || p.name AS paragraph, text, class::INT AS class
FROM {kind}_d d JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY j) - 1 AS pos, {code} AS class FROM {kind}_p) p ON d.k = p.k"""


@query(ALL + " " + " UNION ALL ".join(map(_documents_sql, KINDS)))
def site_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their paragraphs in order."""
    d = _each(spark, sf_dir, E.documents).select("kind", "eid", "title", "speaker", F.posexplode("paragraphs").alias("pos", "p"))
    return d.select("kind", "eid", "title", "speaker", "pos", F.col("p.eid").alias("paragraph"), F.col("p.t").alias("text"), F.col("p.c").alias("class"))


@query("WITH p AS (SELECT p_partkey AS k FROM part) " + " UNION ALL ".join(f"SELECT k AS page_id, '{'proclamation' if kind == 'proclamation' else kind}' AS page_type FROM p WHERE {_mine(kind)}" for kind in KINDS))
def site_page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every page, by its address."""
    return site_pages(spark, sf_dir).select("page_id", C.page_type(F.col("url")).alias("page_type"))


@query("WITH p AS (SELECT p_partkey AS k FROM part), t AS (" + " UNION ALL ".join(f"SELECT k FROM p WHERE {_mine(kind)}" for kind in KINDS if kind not in ("hymn", "book_chapter")) + """) SELECT DISTINCT 'https://site.test/study/scriptures/bofm/alma/' || (1 + k % 60) || '?lang=eng&id=p' || j AS target
FROM (SELECT k, unnest(range(1, 2 + k % 3)) AS j FROM t)""")
def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages to chapters of one book, which is all that is allowed."""
    return C.links(site_pages(spark, sf_dir), (rf"^{SITE}/study/scriptures/bofm/alma/\d+\?",)).select("target").distinct()
