import pytest
from pyspark.sql import functions as F

from knotwork import dims
from knotwork.functions import chapters as Ch
from knotwork.functions import references as R

#: Chapters of ten and more verses, by a rule, for two books.
LENGTHS = {"josh": tuple(10 + k for k in range(24)), "acts": tuple(20 + k % 3 for k in range(28))}
P = R.Parser(verses=LENGTHS, hymns={4: "morning-song", 210: "evening-song"})
VERSE, TALK, PART, HYMN, PROC, TOPIC, CHAPTER, SUPPLEMENT = (dims.TYPE[t] for t in ("ScriptureVerse", "ConferenceTalk", "ConferenceTalkParagraph", "Hymn", "Proclamation", "TopicalGuideKeyword", "ScriptureChapter", "ScriptureSupplementalPara"))


def told(r):
    return (r.canon, r.book, r.chapter, r.verse or r.paragraph, r.low_emphasis)


def in_link(tail):
    return [told(r) for r in P.scriptures(f'before <a href="/study/scriptures/{tail}">a link</a> behind')]


def test_links_with_marks():
    assert in_link("ot/josh/5?lang=eng") == [("ot", "josh", 5, None, False)]
    assert in_link("ot/josh/5?lang=eng&id=p9#p9") == [("ot", "josh", 5, 9, False)]
    assert in_link("ot/josh/5?lang=eng&amp;id=p2,p7-p8") == [("ot", "josh", 5, v, False) for v in (2, 7, 8)]
    assert in_link("ot/josh/5?lang=eng&id=p1-p4#p2") == [("ot", "josh", 5, v, v != 2) for v in (1, 2, 3, 4)]
    assert in_link("ot/josh/5?lang=eng&id=note#note") == [("ot", "josh", 5, "note", False)]
    assert in_link("ot/josh/5?lang=eng&id=head1-head2") == [("ot", "josh", 5, x, False) for x in ("head1", "head2")]
    assert in_link("tg/courage?lang=eng#part2") == [("tg", "courage", None, None, False)]


def test_links_that_lead_nowhere():
    assert in_link("ot/josh/5?lang=eng&id=p15") == []  # chapter 5 has 14 verses
    assert in_link("ot/josh/25?lang=eng") == in_link("xx/josh/5?lang=eng") == in_link("ot/jsh/5?lang=eng") == []


def test_spans_over_chapters():
    want = [(3, 11), (3, 12), *((4, v) for v in range(1, 14)), (5, 1), (5, 2)]
    assert [(r[2], r[3]) for r in in_link("ot/josh/3?lang=eng&span=3:11-5:2")] == want
    assert [r[2:] for r in in_link("ot/josh/3?lang=eng&span=3:12-4:1#p1")] == [(3, 12, True), (4, 1, False)]


def test_short_links():
    assert [told(r)[1:4] for r in P.scriptures("see /scriptures/nt/acts/9.18-20 there")] == [("acts", 9, v) for v in (18, 19, 20)]
    assert [told(r)[:4] for r in P.scriptures("/scriptures/ot/numb/6.1")] == [("ot", "num", 6, 1)]


@pytest.mark.parametrize(("text", "want"), [
    ("Joshua 4", ("josh", 4, None)), ("josh. 4:13", ("josh", 4, 13)), ("2 Kings 9:1", ("2-kgs", 9, 1)), ("2kgs9:1", ("2-kgs", 9, 1)), ("Helaman", ("hel", None, None)), ("Jude 7", ("jude", 1, 7)), ("Jude 1:7", ("jude", 1, 7)), ("D&C 4:2", ("dc", 4, 2)),
    ("Acts 1:21", None), ("Joshua 30", None), ("Joshua 4:0", None), ("Joshua 0:4", None), ("the river 4:2", None), ("Joshua 4:2-5", None), ("", None), ("Ezek. -1:3", None),
])
def test_one_reference(text, want):
    got = P.one(text)
    assert (got and (got.book, got.chapter, got.verse)) == want


@pytest.mark.parametrize(("text", "want"), [
    ("as in Joshua 4:2, 5-6; also Acts 2:1", {(VERSE, f"josh|4|{v}") for v in (2, 5, 6)} | {(VERSE, "acts|2|1")}), ("(Joshua 4:12; 5:1.)", {(VERSE, "josh|4|12"), (VERSE, "josh|5|1")}), ("Acts 1:19–23", {(VERSE, "acts|1|19"), (VERSE, "acts|1|20")}),
    ("the whole of Ruth 3", {(CHAPTER, "ruth|3")}), ("Romanesque 3:4 and actual 5:6", set()), ("our hymn, Hymns, no. 4, and Hymn 999", {(HYMN, "morning-song")}), ("sing Hymns #210 now", {(HYMN, "evening-song")}),
    ("read “The Living Christ: a Declaration”.", {(PROC, "lc")}), ("in The Family: Proclamation of that year", {(PROC, "fam")}), ("/study/general-conference/1987/10/the-road?lang=eng", {(TALK, "1987|10|the-road")}),
    ("/study/liahona/1987/05/the-road?lang=eng", {(TALK, "1987|04|the-road")}), ("/study/general-conference/1990/04/a-lamp?lang=eng#p12", {(PART, "1990|04|a-lamp|p12")}), ("/study/scriptures/tg/lamp?lang=eng", {(TOPIC, "lamp")}),
    ('<a href="/study/scriptures/ot/josh/1?lang=eng&id=intro">x</a>', {(SUPPLEMENT, "josh|1|intro")}), ("", set()),
])
def test_everything(text, want):
    assert {(t, n) for t, n, _ in P.everything(text)} == want


def test_columns_and_tables(spark):
    d = spark.createDataFrame([(1, "see Acts 3:5-7"), (2, None), (3, "")], "id int, t string")
    assert [len(r[0]) for r in d.orderBy("id").select(R.text_references("t")).collect()] == [3, 0, 0]
    rows = [(b, c + 1, n) for b, ns in LENGTHS.items() for c, n in enumerate(ns)]
    assert dims.verse_counts(spark.createDataFrame(rows, "book string, chapter int, verses int")) == LENGTHS
    assert dims.hymn_names(spark.createDataFrame([(4, "morning-song")], "number int, song string")) == {4: "morning-song"}
    refs = spark.createDataFrame([("josh", 12, 21), ("josh", 12, 22), ("josh", 25, 1), ("gen", 1, None), ("gen", None, None), ("gen", 1, 0), ("gen", 2, 176)], "book string, chapter int, verse int")
    assert sorted((r.book, r.chapter or 0) for r in Ch.valid_verses(refs, LENGTHS).collect()) == [("gen", 0), ("gen", 1), ("gen", 2), ("josh", 12)]
    n = {(r.book, r.chapter): r for r in Ch.neighbours(spark).collect()}
    assert (n["ruth", 1].prev_book, n["ruth", 1].prev_chapter) == ("judg", 21)
    assert n["matt", 1].prev_book is None and n["rev", 22].next_book is None
    assert len({b for b, _, _, _ in dims.BOOKS}) == len(dims.BOOKS)
    ids = spark.createDataFrame([("jst-mark", "pgp"), ("moroni", "bofm")], "b string, c string").select(Ch.normal_book(F.col("b"), F.col("c")).alias("x")).collect()
    assert [tuple(r.x) for r in ids] == [("mark", "nt"), ("moro", "bofm")]
