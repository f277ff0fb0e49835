import json
import zipfile

import pytest
from pyspark.sql import functions as F

from knotwork.dims import TYPE
from knotwork.functions import dates as D
from knotwork.operators import extractors as E
from knotwork.operators import graph as G
from knotwork.sources import crawl as C
from knotwork.sources import epub, store

SITE = "https://site.test"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, f"{SITE}/a/", '<a href="/b?x=1&amp;y=2#frag">b</a> <A HREF=\'c.html\'>c</A> <a href="pic.PNG">p</a> <a href="#top">t</a> <a href="http://[bad">z</a>'),
        (2, f"{SITE}/b?x=1&y=2", '<a href="/a/">a</a><a href="/d">d</a>'), (3, f"{SITE}/a/c.html", '<a href="/e">e</a>'), (4, f"{SITE}/d", None), (5, f"{SITE}/alone", ""),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_links(spark, pages):
    assert sorted((r.url, r.target) for r in C.links(pages.where("page_id = 1")).collect()) == [(f"{SITE}/a/", f"{SITE}/a/c.html"), (f"{SITE}/a/", f"{SITE}/b?x=1&y=2")]
    assert [r.href for r in C.hrefs(pages.where("page_id = 1")).orderBy("pos").collect()] == ["/b?x=1&amp;y=2", "c.html", "pic.PNG", "http://[bad"]
    only = C.links(pages, (r"/d$",)).collect()
    assert [r.target for r in only] == [f"{SITE}/d"]


def test_crawl(spark, pages):
    got = {r.url.removeprefix(SITE): r.level for r in C.crawl(pages, C.CrawlSource("t", f"{SITE}/a/")).collect()}
    assert got == {"/a/": 0, "/b?x=1&y=2": 1, "/a/c.html": 1, "/d": 2, "/e": 2}
    assert len({s.name for s in C.crawl_sources(SITE, SITE)}) == 14


@pytest.mark.parametrize(("path", "kind"), [
    ("/study/scriptures/bofm/1-ne/1?lang=eng", "scripture_chapter"), ("/study/scriptures/tg/faith?lang=eng", "topical_guide"), ("/study/scriptures/bd/ark?lang=eng", "bible_dictionary"), ("/study/scriptures/gs/ark", "guide_to_scriptures"),
    ("/study/scriptures/triple-index/ark", "triple_index"), ("/study/general-conference/1994/10/on-harbours?lang=eng", "conference_talk"), ("/speakers/x/", "speaker"), ("/talks/x/y/", "speech"), ("/media/music/songs/z", "hymn"),
    ("/study/manual/jesus-the-christ/chapter-3", "book_chapter"), ("/study/scriptures/the-living-christ-the-testimony", "proclamation"), ("/elsewhere", "unknown"),
])
def test_page_types(spark, path, kind):
    assert spark.createDataFrame([(SITE + path,)], "u string").select(C.page_type(F.col("u")).alias("t")).first().t == kind


def test_page_store(spark, pages, tmp_path):
    p = str(tmp_path / "cache")
    C.store_pages(pages.where("page_id <= 3"), p)
    C.store_pages(pages.union(pages), p)
    stored = spark.read.parquet(p)
    assert stored.count() == 5 and stored.select("file_name").distinct().count() == 5
    assert C.cached(stored, pages.where("page_id = 2")).first().page_id == 2
    assert C.song_addresses(spark.createDataFrame([("x",)], "song string"), SITE).first().url == f"{SITE}/media/music/songs/x?lang=eng"


def test_documents(spark, tmp_path):
    doc = {"type": "scripture_chapter", "eid": f"{TYPE['ScriptureChapter']} gen|1", "lang": "en", "book": "gen", "chapter": 1, "paragraphs": [{"eid": f"{TYPE['ScriptureVerse']} gen|1|1", "t": "In", "c": 4, "r": [{"eid": "27 gen|1|1|1", "start": 0, "end": 2}]}, {"eid": f"{TYPE['ScriptureVerse']} gen|1|2", "t": "And", "c": 4, "r": []}]}
    hymn = {"type": "hymn", "eid": f"{TYPE['Hymn']} x", "lang": "en", "title": "X", "number": 3, "paragraphs": []}
    parsed = store.parse_documents(spark.createDataFrame([(json.dumps(d),) for d in (doc, hymn)], "json string"))
    store.save_documents(parsed, str(tmp_path / "docs"))
    back = store.load_documents(spark, str(tmp_path / "docs"))
    assert {r.eid: r for r in back.collect()} == {r.eid: r for r in parsed.collect()}
    assert store.load_documents(spark, str(tmp_path / "docs"), "hymn").first().number == 3
    assert store.load_headers(spark, str(tmp_path / "docs")).columns == ["type", "eid", "lang"]
    assert store.catalogue(spark, str(tmp_path / "docs")).where(F.col("path").contains("hymn")).first().eid == hymn["eid"]
    assert store.find_document(back, TYPE["ScriptureSentence"], "gen|1|2|1").first().eid == doc["eid"]
    assert [(r.pos, r.type, r.name, r.text) for r in store.paragraphs(back).orderBy("pos").collect()] == [(0, TYPE["ScriptureVerse"], "gen|1|1", "In"), (1, TYPE["ScriptureVerse"], "gen|1|2", "And")]
    names = spark.createDataFrame([(1, "a", "A", None)], store.NAME_SCHEMA)
    store.save_names(names, str(tmp_path / "names"))
    assert store.load_names(spark, str(tmp_path / "names")).collect() == names.collect()


def test_known_talks(spark):
    talks = spark.createDataFrame([(2000, "04", "A"), (2000, "04", "x"), (2030, "04", "new")], "year int, phase string, talk string")
    known = spark.createDataFrame([(2000, "04", "a")], "year int, phase string, talk string")
    assert sorted(r.talk for r in store.known_talks(talks, known).collect()) == ["A", "new"]


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("OPS/sec_1_2.xml", '<html><p class="t">Two</p></html>')
        z.writestr("OPS/sec_1_1.xml", "<html><p>One <b>bold</b></p><p>More</p></html>")
        z.writestr("OPS/other.xml", "<p>no</p>")
    files = epub.archive_files(spark, str(tmp_path / "b.epub"), epub.SECTIONS)
    got = [(r.file, r.pos, r["class"], r.text) for r in epub.paragraphs(files).orderBy("file", "pos").collect()]
    assert got == [("OPS/sec_1_1.xml", 0, None, "One <b>bold</b>"), ("OPS/sec_1_1.xml", 1, None, "More"), ("OPS/sec_1_2.xml", 0, "t", "Two")]
    # the same members from a table of archives, made of rows
    rows = files.select("archive", "file", "html")
    again = epub.members(epub.pack(rows), epub.SECTIONS, 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    broken = epub.pack(rows).select("path", F.expr("overlay(content placing unhex('ff') from 48)").alias("content"))
    with pytest.raises(Exception, match="checksum|decompressing"):
        epub.members(broken, epub.SECTIONS).collect()
    assert epub.members(rows.select(F.col("archive").alias("path"), F.lit(None).cast("binary").alias("content")), epub.SECTIONS).count() == 0
    assert [list(r.n) for r in files.select(epub.numbers(F.col("file"), epub.SECTIONS).alias("n")).orderBy("file").collect()] == [[1, 1], [1, 2]]
    v = spark.createDataFrame([(3,), (4,), (39,), (200,), (300,)], "n int").select(epub.volume(F.col("n")).alias("v")).collect()
    assert [r.v for r in v] == [None, 1, 2, 3, None]


def test_encyclopedia(spark):
    lines = ["front matter", "( AARON )", "Brother of Moses and the first high priest of Israel.", "Aaron", "( Aaron )", "More of him that  goes on for a while.", "(ABEL )", "See Cain, Moses.", "SETH, ENOS", "1 2", "(ABBA )", "short"]
    rows = spark.createDataFrame([("b", "f", k, x) for k, x in enumerate(lines)], "archive string, file string, pos int, text string")
    got = {r.topic: r for r in E.segment_encyclopedia(rows).collect()}
    assert set(got) == {"AARON", "ABEL"} and got["AARON"].text == "Brother of Moses and the first high priest of Israel.\n( Aaron )\nMore of him that goes on for a while."
    assert (got["ABEL"].see, got["ABEL"].text, got["ABEL"].length) == (["Cain", "Moses", "SETH", "ENOS"], "", 0)
    f = E.see_also(E.segment_encyclopedia(rows)).collect()
    assert [(r.a_name, r.b_name) for r in f] == [("md|abel", f"md|{x}") for x in ("cain", "moses", "seth", "enos")]


def test_a_topic_is_joined_within_ranges(spark, tmp_path, monkeypatch):
    """No task orders or holds the lines of a topic as rows: windows are by ranges, and a topic gathers one text a range."""
    from knotwork.operators import ordered

    monkeypatch.setattr(ordered, "dealt", lambda rows, group, order: _ranges(spark, rows, order, tmp_path))
    lines = ["( AARON )", *[x for k in range(60) for x in (f"line {k}  of him", "See Cain, Moses.", "SETH,, ENOS", f"( AARON {k} )" if k % 50 == 49 else "1 2")]]
    rows = spark.createDataFrame([("b", "f", k, x) for k, x in enumerate(lines)], "archive string, file string, pos int, text string")
    made = E.segment_encyclopedia(rows)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.topic: r for r in made.collect()}
    assert got["AARON"].text == "\n".join(f"line {k} of him" for k in range(50)) and got["AARON"].see == ["Cain", "Moses", "SETH", "ENOS"] * 50
    assert got["AARON 49"].text == "\n".join(f"line {k} of him" for k in range(50, 60)) and got["AARON 49"].length == sum(len(f"line {k} of him") for k in range(50, 60))
    windows = [x for x in plan.splitlines() if "Window [" in x and "pos#" in x]
    assert windows and all("[_part#" in x for x in windows)


def _ranges(spark, rows, order, path):
    """Rows in ranges of seven lines, as ordered.dealt() makes them of more."""
    rows.withColumn("_part", F.floor(F.col(order[-1]) / 7).cast("int")).write.parquet(str(path / "ranges"))
    return spark.read.parquet(str(path / "ranges"))


def test_dates(spark):
    rows = ["January 5, 1999", "Mar 7, 2001", "2003-04-05", "someday", None]
    d = spark.createDataFrame([(x,) for x in rows], "s string").select(D.speech_date("s").alias("d")).collect()
    assert [str(r.d) for r in d] == ["1999-01-05", "2001-03-07", "2003-04-05", "None", "None"]
    c = spark.range(1).select(D.conference_of(F.lit("1998-04")).alias("a"), D.conference_of(F.lit("2010-07")).alias("b"), D.conference_text(F.lit(2010), F.lit("10")).alias("c")).first()
    assert tuple(c.a) == (1998, "04") and tuple(c.b) == (2010, "10") and c.c == "2010-10"


# extractors


def have(features):
    return {(r.a_type, r.a_name, r.b_type, r.b_name): r.weight10 for r in features.collect()}


def t(x):
    return TYPE[x]


def parsed(spark, kind, rows):
    return E.parse_pages(spark.createDataFrame([*rows, (None, None), (SITE, "<p>x</p>")], "url string, html string"), E.SOURCES[kind])


def test_scripture_page(spark):
    page = (
        '<h1>Chapter 2</h1><p class="study-summary" id="study_summary1">Lehi goes.</p><p class="verse" id="p1"><span class="verse-number">1 </span>For <a class="study-note-ref" href="#note1a"><sup></sup>behold</a> it</p>'
        '<p class="verse" id="p2"><span class="verse-number">2 </span>And again, see <a class="scripture-ref" href="/study/scriptures/bofm/1-ne/2?lang=eng&amp;id=p1#p1">1</a></p>'
        '<ul><li id="note1a"><p><a class="scripture-ref" href="/study/scriptures/ot/gen/12?lang=eng&amp;id=p1-p2#p1">Gen. 12</a></p></li></ul>'
    )
    p = parsed(spark, "scripture_chapter", [(f"{SITE}/study/scriptures/bofm/1-ne/2?lang=eng", page)])
    f = have(E.features(p, E.SOURCES["scripture_chapter"], text_features=False))
    v = t("ScriptureVerse")
    assert f[t("ScriptureChapter"), "1-ne|2", t("ScriptureBook"), "1-ne"] == 10 and f[t("ScriptureChapter"), "1-ne|2", t("ScriptureChapter"), "1-ne|1"] == 10
    assert f[v, "1-ne|2|1", t("ScriptureChapter"), "1-ne|2"] == 10 and f[v, "1-ne|2|2", v, "1-ne|2|1"] == 10
    assert f[v, "1-ne|2|1", v, "gen|12|1"] == 10 and f[v, "1-ne|2|1", v, "gen|12|2"] == 8
    assert f[v, "gen|12|1", t("Word"), "behold|en"] == 30
    assert (v, "1-ne|2|2", v, "1-ne|2|1") in f and not any(k[0] == v and k[1] == "1-ne|2|2" and k[3] == "1-ne|2|2" for k in f)
    assert any(k[0] == t("ScriptureSupplementalPara") for k in f)
    d = E.documents(p, E.SOURCES["scripture_chapter"]).first()
    assert d.eid == f"{t('ScriptureChapter')} 1-ne|2" and [x.c for x in d.paragraphs][:3] == [3, 4, 4]
    assert len(have(E.features(p, E.SOURCES["scripture_chapter"]))) > len(f)


def test_talk_page(spark):
    page = '<h1>On Hope</h1><p class="author-name">By Elder John Q. Doe</p><p class="line">Roses</p><p class="line">Violets</p><p id="p3">See Hymns, no. 1 and <a href="/study/scriptures/ot/ps/1?lang=eng&amp;id=p1#p1">Ps</a></p>'
    p = parsed(spark, "conference_talk", [(f"{SITE}/study/general-conference/2021/10/12doe?lang=eng", page)])
    r = p.first()
    assert (r.title, r.author, r.name, r.year, r.phase) == ("On Hope", "John Q. Doe", "2021|10|12doe", 2021, "10")
    f = have(E.features(p, E.SOURCES["conference_talk"], text_features=False))
    talk = (t("ConferenceTalk"), "2021|10|12doe")
    assert f[(*talk, t("Word"), "hope|en")] == 30 and f[(*talk, t("ConferenceSpeaker"), "john q doe")] == 10 and f[t("ConferenceSpeaker"), "john q doe", t("Word"), "doe|en"] == 30
    assert f[(*talk, t("Conference"), "2021|10")] == 10 and f[t("Year"), "2021", t("Conference"), "2021|10"] == 10 and f[t("Year"), "2021", t("Year"), "2020"] == 10
    assert f[t("ConferenceTalkParagraph"), "2021|10|12doe|3", t("ScriptureVerse"), "ps|1|1"] == 10
    assert [x.t for x in E.documents(p, E.SOURCES["conference_talk"]).first().paragraphs][0] == "Roses\nViolets"
    n = E.search_names(p, E.SOURCES["conference_talk"]).first()
    assert (n.plain_name, n.disambig_name) == ("On Hope", "On Hope (John Q. Doe, 2021)")
    assert E.search_features(p, E.SOURCES["conference_talk"]).where(F.col("b_type") == t("CharNGram")).count() > 3
    for title, author, want in [
        ("Audit Report", "A", 0), ("Finance", "A", 1), ("Auditing", "A", 1), ("The Finance Report", "A", 0), ("A Statistic", "A", 0), ("Sustaining", "A", 1), ("Sustaining of Officers", "A", 0), ("Solemn Assembly", "A", 1),
        ("WELFARE services Session", "A", 0), ("Welfare Session", "A", 1), ("On", " \t", 0), ("On", None, 0), ("On", "Presented by A", 0), ("On", "a" * 71, 0), ("On", "a" * 70, 1), (None, "A", 1),
    ]:
        row = spark.createDataFrame([(title, author)], "t string, a string").select(E.is_valid_talk(F.col("t"), F.col("a")).alias("ok")).first()
        assert row.ok == bool(want), (title, author)
    ok = p.withColumn("ok", E.is_valid_talk(F.col("title"), F.col("author"))).first().ok
    bad = p.withColumn("ok", E.is_valid_talk(F.lit("Church Auditing Report"), F.col("author"))).first().ok
    assert ok and not bad


@pytest.mark.parametrize("kind", ["topical_guide", "guide_to_scriptures", "triple_index"])
def test_index_pages(spark, kind):
    work = {"topical_guide": "tg", "guide_to_scriptures": "gs", "triple_index": "triple-index"}[kind]
    page = '<h1>Christ, Appearances [x]</h1><p class="entry" id="p1">he came: <a class="scripture-ref" href="/study/scriptures/nt/john/1?lang=eng&amp;id=p5#p5">John 1:5</a></p>'
    p = parsed(spark, kind, [(f"{SITE}/study/scriptures/{work}/christ-appearances?lang=eng", page), (f"{SITE}/study/scriptures/{work}/introduction?lang=eng", page)])
    f = have(E.features(p, E.SOURCES[kind], text_features=False))
    node = t(E.SOURCES[kind].node)
    assert f[node, "christ-appearances", t("ScriptureVerse"), "john|1|5"] == 10 and f[node, "christ-appearances", t("Word"), "christ|en"] == 30
    assert f[t("ScriptureVerse"), "john|1|5", t("Word"), "appearances|en"] == 30
    assert [r.plain_name for r in E.search_names(p, E.SOURCES[kind]).collect()] == ["Appearances Christ"]


def test_other_pages(spark):
    song = json.dumps({"props": {"title": "Song", "verses": ["one\ntwo", {"lines": ["three"]}], "scriptures": ["1 Nephi 1:1"]}})
    cases = {
        "hymn": (f"{SITE}/media/music/songs/song-x?lang=eng", f'<script id="__NEXT_DATA__">{song}</script>', ("Hymn", "song-x"), "HymnVerse"),
        "bible_dictionary": (f"{SITE}/study/scriptures/bd/ark?lang=eng", "<h1>Ark</h1><p>A box.</p><p>More, Ex. 25:10.</p>", ("BibleDictionaryTopic", "ark"), "BibleDictionaryParagraph"),
        "speech": ("https://s.test/talks/ann-lee/on-work/", '<h1>On Work</h1><a class="x single-speech__type">Devotional</a><h2 class="single-speech__speaker">Ann Lee</h2><p>Work.</p><p>Gen. 1:1</p><p>End</p>', ("ByuSpeech", "ann-lee|on-work"), "ByuSpeechParagraph"),
        "proclamation": (f"{SITE}/study/scriptures/the-family-a-proclamation?lang=eng", "<h1>The Family</h1><p>We.</p><p>All.</p>", ("Proclamation", "fam"), "ProclamationParagraph"),
        "book_chapter": (f"{SITE}/study/manual/jesus-the-christ/chapter-3?lang=eng", "<h1>C</h1><p>A.</p><p>B.</p>", ("BookChapter", "jtc|3"), "BookParagraph"),
    }
    for kind, (url, html, (node, name), paragraph) in cases.items():
        p = parsed(spark, kind, [(url, html)])
        f = have(E.features(p, E.SOURCES[kind]))
        assert (t(paragraph), f"{name}|2", t(node), name) in f and (t(paragraph), f"{name}|2", t(paragraph), f"{name}|1") in f, kind
        assert E.documents(p, E.SOURCES[kind]).count() == 1
        assert G.edges(E.features(p, E.SOURCES[kind])).count() > 0
    speech = parsed(spark, "speech", [cases["speech"][:2]])
    assert E.is_devotional(speech.withColumn("forum", F.lit(None).cast("string"))).count() == 0 and E.is_devotional(speech.withColumn("forum", F.lit("A Devotional"))).count() == 0
    assert E.is_devotional(speech).count() == 1 and E.is_devotional(speech, least_paragraphs=4).count() == 0
    files = spark.createDataFrame([(7, "<h1>C</h1><p>A.</p>")], "n int, html string")
    assert E.parse_pages(E.book_pages(files, "atgq", F.col("n")), E.SOURCES["book_chapter"]).first().name == "atgq|7"
