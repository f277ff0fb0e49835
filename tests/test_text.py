import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.functions import html as H
from knotwork.functions import spans as Sp
from knotwork.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr("s")).first()[0]


@pytest.mark.parametrize(
    ("s", "want"),
    [
        ("", ""), (" \t ", " \t "), ("Lamp", "Lamp"), ("Old harbour", "Old harbour"), ("Harbour, old", "old Harbour"), ("Harbour,\t\n old", "old Harbour"),
        ("Harbour, old, of the north", "old Harbour, of the north"), ("Harbour, old, of the north, rebuilt", "old Harbour, of the north, rebuilt"), (", alone", ", alone"),
    ],
)
def test_comma_inversion(spark, s, want):
    assert one(spark, s, T.comma_inversion) == want
    assert one(spark, s, T.comma_inverted) == (s != want)


def test_char_level_features(spark):
    got = {(r["type_name"], r["name"]) for r in one(spark, "An OLD Harbour", T.char_level_features)}
    assert {n for t, n in got if t == "Word"} == {"an", "old", "harbour"}
    assert {n for t, n in got if t == "CharNGram"} == {f"[{w}]"[k : k + 3] for w in ("an", "old", "harbour") for k in range(len(w))}
    assert {n for t, n in got if t == "NGram"} == {"STKN|an", "an|old", "old|harbour", "harbour|ETKN", "STKN|an|old", "an|old|harbour", "old|harbour|ETKN"}


def test_sentences_and_words(spark):
    s = "Is it so? “Yes.” It's a well-known fact... and\nthat"
    assert one(spark, s, T.sentences) == ["Is it so? ", "“Yes.” ", "It's a well-known fact... ", "and\nthat"]
    assert one(spark, s, T.words) == ["Is", "it", "so", "Yes", "It's", "a", "well-known", "fact", "and", "that"]
    assert one(spark, None, lambda c: F.size(T.words(c))) in (None, -1)


def test_pairs_within(spark):
    got = [(r["a"], r["b"]) for r in one(spark, "a b c d", lambda c: T.pairs_within(F.split(c, " "), 2))]
    assert got == [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")]
    assert one(spark, "a", lambda c: T.pairs_within(F.split(c, " "), 7)) == []


def test_tags(spark):
    h = '<div class="x">a <b class="y">bold</b><br/> <i>i</i>&nbsp;c <a href="z">link</a></div>'
    assert one(spark, h, T.strip_all_but_bold_and_italics).startswith("a <b>bold</b>")
    assert one(spark, h, T.drop_links) == h.replace('<a href="z">link</a>', "link")
    assert "\r\n" in one(spark, h, T.line_breaks)
    assert one(spark, "a&nbsp;b c", T.plain_spaces) == "a b c"
    assert one(spark, "By Elder John X. (of the Seventy)", T.clean_author) == "John X."
    assert one(spark, "Of one <em>Great Thing</em> more", T.header_parts).asDict() == {"before": "Of one", "title": "Great Thing", "after": "more"}
    assert one(spark, "x" * 50 + " y", T.first_words) == "x" * 40
    assert one(spark, "one two three", lambda c: T.first_words(c, 8)) == "one two"
    assert one(spark, "https://a.b/c?d=e&f", T.url_to_file_name) == "https___a.b_c_d=e_f.html.br"


@pytest.mark.parametrize(
    ("h", "text", "links"),
    [
        ("less &lt; more &amp;c.", "less < more &c.", []), ("<em>so</em> and <strong>so</strong>", "<i>so</i> and <b>so</b>", []), ("<section>a <q>b <i>c</i></q></section>", "a b <i>c</i>", []),
        ('we saw <span class="clarity-word">the</span> sea', "we saw <i>the</i> sea", []), ('to <a href="/far?x=1&amp;y=2"><sup></sup>far</a> and <a href="#n">near</a>', "to far and near", [("/far?x=1&y=2", 3, 6), ("#n", 11, 15)]), ("<i>open", "<i>open</i>", []), ("", "", []),
    ],
)
def test_fragment(spark, h, text, links):
    got = one(spark, h, H.fragment)
    assert got["text"] == text
    assert [(x["href"], x["start"], x["end"]) for x in got["links"]] == links


def test_tagged_string():
    h = '<p>Ships <em>come and <a href="x&amp;y">go</a></em> daily</p>'
    t = H.TaggedString.parse(h)
    assert t.text == "Ships come and go daily"
    assert [(x.name, x.closing, x.index) for x in t.tags] == [("p", False, 0), ("em", False, 6), ("a", False, 15), ("a", True, 17), ("em", True, 17), ("p", True, 23)]
    assert str(H.TaggedString.parse(str(t))) == str(t)
    assert str(t.substring(0, 5)) == "<p>Ships</p>" and str(t.substring(6, 4)) == "<p><em>come</em></p>"
    assert str(t.substring(11, 6)) == '<p><em>and <a href="x&y">go</a></em></p>' and str(t.substring(18, 5)) == "<p>daily</p>"


def test_select_and_spans(spark):
    h = '<p class="a b">one <b>x</b><p>two</p><div id="n"><div>in</div></div>'
    assert [(t, i) for t, _, i in H.select(h, [("p", None, None), ("div", "id", None)])] == [("p", "one <b>x</b>"), ("p", "two"), ("div", "<div>in</div>")]
    assert H.select(h, [("p", "class", "b")])[0][2] == "one <b>x</b>"
    gap = [np.array([x]) for x in (2, 4)]
    assert Sp.drop("abcdefgh", *gap) == "abefgh"
    assert Sp.moved(np.array([0, 1, 2, 3, 6]), *gap).tolist() == [0, 1, 2, 2, 4] and Sp.moved(np.array([2, 3, 4, 6, 8]), *gap).tolist() == [2, 2, 2, 4, 6]
    assert one(spark, "a &amp; b &eacute;", H.unescape) == "a & b é"
    assert one(spark, '<a class="scripture-ref" href="x">Gen. 1:<b>2.</b></a>.', H.plain_anchors) == '<a class="scripture-ref" href="x">Gen 1<b>2</b></a>.'
