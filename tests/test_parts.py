"""Selectors, spans, the automaton of names, the nested index and spreading under a budget, against plain versions."""

import hashlib
import random
import time
import tracemalloc
from itertools import accumulate

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knotwork import queries as core
from knotwork.dims import TYPE
from knotwork.functions import selectors as Sel
from knotwork.functions import spans as Sp
from knotwork.functions.automaton import Automaton, names_in
from knotwork.functions.html import TaggedString
from knotwork.functions.references import Parser
from knotwork.operators import graph as G
from knotwork.operators import index as I
from knotwork.operators import ordered as O
from knotwork.operators import spread as A

W, E = TYPE["Word"], TYPE["Entity"]


# selectors


def inner(paths, html):
    return {n: [x.inner for x in f] for n, f in Sel.Selectors(paths).match(html).items()}


def test_paths():
    html = '<html><body><div class="a body" id="d1"><p>one <b>x</b><p class="k">two</p><div><p>three</p></div></div><p id>four<br></p><ul><li id="n1">n</li><li>m</ul></body>'
    paths = {
        "child": ["/html/body/div/p"], "any": ["//div//p"], "word": ['//div[@class~="body"]'], "exact": ['//div[@class="body"]', '//p[@class="k"]'], "has": ["//li[@id]", "//p[@id]"], "star": ["/html/*/ul/*"], "void": ["//br"], "both": ['//div[@id="d1"][@class]/div'],
    }
    got = inner(paths, html)
    assert got["child"] == ["one <b>x</b>", "two"] and got["any"] == ["one <b>x</b>", "two", "three"] and got["word"] == ['<p>one <b>x</b><p class="k">two</p><div><p>three</p></div>']
    assert got["exact"] == ["two"] and got["has"] == ["four<br>", "n"] and got["star"] == ["n", "<li>m"] or got["star"] == ["n", "m"]
    assert got["void"] == [""] and got["both"] == ["<p>three</p>"]
    for bad in ("", "p", "//", "//p[x]"):
        with pytest.raises(ValueError):
            Sel.steps(bad)
    nested = Sel.Selectors({"d": ["//div"]}).match("<div>1<div>2</div></div></b><div>3")["d"]
    assert [x.inner for x in nested] == ["1<div>2</div>", "2", "3"] and [x.inner for x in Sel.outermost(nested)] == ["1<div>2</div>", "3"]


def test_one_pass_is_linear_in_page_and_paths():
    page = "<div>" * 30 + "".join(f'<p class="c{k % 90}"><b>t{k}</b></p>' for k in range(20_000)) + "</div>" * 30
    one, many = {"a": ["//p/b"]}, {f"n{k}": [f'//div//p[@class~="c{k}"]/b'] for k in range(90)}
    began = time.perf_counter()
    assert len(inner(one, page)["a"]) == 20_000
    first = time.perf_counter() - began
    began = time.perf_counter()
    got = inner(many, page)
    assert sum(map(len, got.values())) == 20_000 and time.perf_counter() - began < 6 * first + 2


# spans


def test_deletion_same_as_characters(spark):
    g = random.Random(3)
    rows = []
    for k in range(150):
        t = "".join(g.choices("abcdé🙂", k=g.randint(0, 60)))
        pick = lambda n: [(a := g.randint(-3, 62), a + g.randint(-2, 15)) for _ in range(n)]
        rows.append((k, t, pick(g.randint(0, 7)), pick(g.randint(0, 9))))
    rows += [(999, None, [(0, 3)], [(0, 1)]), (1000, "abc", None, None)]
    kind = Sp.SPANS
    df = spark.createDataFrame(rows, f"k int, text string, cut {kind}, notes {kind}")
    for r in df.select("*", Sp.delete("text", "cut", "notes").alias("m")).collect():
        gone = {i for a, b in r.cut or [] for i in range(max(a, 0), b)}
        t = r.text or ""
        at = lambda x: sum(i not in gone for i in range(min(max(x, 0), len(t))))  # noqa: B023, E731
        assert r.m.text == (None if r.text is None else "".join(c for i, c in enumerate(t) if i not in gone))
        assert [tuple(x) for x in r.m.notes] == [(at(a), at(b)) for a, b in r.notes or []]


def test_cuts_keep_the_tags_that_are_open(spark):
    html = 'a<b>bc<i x="1">de</i>f</b>g<i>hi</i>'
    whole = TaggedString.parse(html)
    tags = []  # tags open at each character
    for k in range(len(whole.text)):
        now = []
        for t in whole.tags:
            if t.index <= k:
                now = now[:-1] if t.closing else [*now, t.name]
        tags.append(now)
    cuts = [(a, b) for a in range(len(whole.text)) for b in range(a + 1, len(whole.text) + 1)]
    got = spark.createDataFrame([(html, cuts)], f"h string, c {Sp.SPANS}").select(Sp.cut_html("h", "c").alias("x")).first().x
    for (a, b), part in zip(cuts, got, strict=True):
        again = TaggedString.parse(part)
        assert again.text == whole.text[a:b]
        for k in range(b - a):
            now = []
            for t in again.tags:
                if t.index <= k:
                    now = now[:-1] if t.closing else [*now, t.name]
            assert now == tags[a + k]


# names


def test_automaton_same_as_plain(spark):
    g = random.Random(5)
    for _ in range(200):
        names = {"".join(g.choices("ab ", k=g.randint(1, 4))): "v" for _ in range(g.randint(1, 8))}
        text = "".join(g.choices("ab c", k=g.randint(0, 30)))
        a = Automaton(names)
        want = {(s, s + len(n), n) for n in names for s in range(len(text)) if text.startswith(n, s)}
        assert set(a.all(text)) == want
        left, end = [], 0
        for s in range(len(text)):
            here = [x for x in want if x[0] == s]
            if here and s >= end:
                left.append(max(here, key=lambda x: x[1]))
                end = left[-1][1]
        assert a.longest(text) == left
    df = spark.createDataFrame([("Lamp, the OLD lamp-post lampshade old_lamp", ), (None,), ("",)], "t string")
    got = [[(x.start, x.end, x.value) for x in r.n] for r in df.select(names_in("t", {"lamp": "1", "old lamp": "2", "Lamp Post": "3"}).alias("n")).collect()]
    assert got == [[(0, 4, "1"), (10, 18, "2")], [], []]


def test_references_cost_grows_with_the_text():
    p = Parser()
    text = "and so he said in 1 Nephi. 3:7, then Gen 1:1-2 and the words of others "
    took = []
    for n in (300, 1200):
        began = time.perf_counter()
        assert len(p.in_text(text * n)) == 3 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5
    own = Parser(aliases={"first lamp": "gen"})
    assert [(r.book, r.chapter, r.verse) for r in own.in_text("First  Lamp 3:4; Genesis 1:1")] == [("gen", 3, 4)]


# running values and the index


def test_running_values_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        g = random.Random(2)
        rows = [("a" if k % 4 else "b", k, g.choice([None, None, k]), g.random() < 0.3) for k in range(800)]
        d = O.dealt(spark.createDataFrame(rows, "g string, i int, v int, f boolean"), ["g"], ["i"])
        assert d.where("g = 'a'").select("_part").distinct().count() > 1
        got = sorted((r.g, r.i, r.last, r.n) for r in O.running(d, ["g"], ["i"], {"last": F.col("v")}, {"n": F.col("f")}).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = []
    for name in "ab":
        mine = [r for r in rows if r[0] == name]
        lasts = list(accumulate((r[2] for r in mine), lambda a, b: a if b is None else b))
        want += [(name, r[1], v, n) for r, v, n in zip(mine, lasts, accumulate(int(r[3]) for r in mine), strict=True)]
    assert got == sorted(want)


def test_index_refuses_too_many_children_and_keeps_order(spark):
    verses = spark.createDataFrame([("ex", 1, 2, "e1", 1), ("gen", 2, 1, "e2", 2), ("gen", 1, 1, "e3", 3), ("gen", 1, 1, "e4", 4), ("xx", 1, 1, "e5", 5), ("matt", 1, 1, "e6", 6)], "book string, chapter int, verse int, entity string, seq int")
    got = {r.canon: r for r in I.scripture_index(verses).collect()}
    assert [b.book for b in got["ot"].books] == ["gen", "ex"] and got["ot"].place == 1 and got["nt"].place == 2
    assert [[(v.verse, v.entity) for v in c.verses] for c in got["ot"].books[0].chapters] == [[(1, "e4")], [(1, "e2")]]
    with pytest.raises(Exception, match="more than 1 x in a"):
        I.nest(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), ["k"], ["v"], "x", 1).collect()
    d = spark.createDataFrame([("e", "p1", 1), ("e", "p2", 2), ("f", "p3", 0)], "entity string, path string, seq int")
    assert sorted(map(tuple, I.entity_index(d.where("seq < 2"), d.where("seq = 2")).collect())) == [("e", "p2"), ("f", "p3")]


# a budget of work


def test_best_first_keeps_its_bound(spark):
    g = random.Random(11)
    rows = [(E, f"d{g.randrange(30)}", W, f"w{g.randrange(40)}", g.choice([1, 7, 30])) for _ in range(500)]
    store = A.prepare(G.edges(spark.createDataFrame(rows, "a_type short, a_name string, b_type short, b_name string, weight10 long")), 8)
    start = spark.createDataFrame([(W, "w1", 1.0), (W, "w2", 0.3)], "type short, name string, v double")
    least, hops = 1e-3, 5
    whole = {(r.type, r.name): r.v for r in A.spread(start.withColumn("mask", F.lit(1).cast("long")), store, least, hops).collect()}
    for budget in (0, 20, 200, 900, 10**9):
        b = A.best_first(start, store, budget, least, hops)
        got = {(r.type, r.name): r.v for r in b.found.collect()}
        missing = sum(whole.values()) - sum(got.values())
        assert b.edges <= budget and got.keys() <= whole.keys() and all(got[k] <= whole[k] + 1e-9 for k in got)
        assert -1e-9 <= missing <= b.bound + 1e-9
        if b.bound == 0:
            assert got.keys() == whole.keys() and abs(missing) < 1e-9
    assert b.bound == 0


def test_a_conference_of_many_talks(spark, tmp_path):
    """A conference of more talks than a row may hold is dealt in blocks; rows without a date are a conference too."""
    n = I.MOST_CHILDREN + 10_000
    key = lambda k: k * 7919 % 1_000_003
    spark.range(n + 3).selectExpr("id * 7919 % 1000003 AS o_orderkey", "id % 50 AS o_custkey", f"CASE WHEN id < {n} THEN DATE '1999-04-02' END AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    want = {(1999, "04", i, str(k % 50)) for i, k in enumerate(sorted(range(n), key=key))} | {(None, "10", i, str(k % 50)) for i, k in enumerate(sorted(range(n, n + 3), key=key))}
    got = [tuple(r) for r in core.queries()["conference_index"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_span_deletion_holds_few_objects():
    """A batch's spans and notes stay arrays; null lists have none, whatever lies under them, and so do slices."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    texts = pa.array(["abcdefgh" * 1250] * 40)
    cut = pa.array([[{"start": k, "end": k + 3} for k in range(0, 10_000, 10)]] * 40, kind)
    over = pa.array([[{"start": k, "end": k + 7} for k in range(0, 10_000, 5)]] * 40, kind)
    tracemalloc.start()
    got = Sp.deleted(texts, cut, over)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6  # of 120,000 spans and notes none is a Python object for long
    assert len(got[0]["text"].as_py()) == 7000 and got[39]["notes"].as_py()[:3] == [{"start": 0, "end": 4}, {"start": 2, "end": 7}, {"start": 7, "end": 11}]
    odd = Sp.deleted(pa.array(["skip", "abcdef", None, ""])[1:], pa.array([[], [{"start": 1, "end": 3}], None, None], kind)[1:], pa.array([[{"start": 0, "end": 1}], [{"start": 0, "end": 9}], [{"start": 0, "end": 2}], None], kind)[1:])
    assert odd.to_pylist() == [{"text": "adef", "notes": [{"start": 0, "end": 4}]}, {"text": None, "notes": [{"start": 0, "end": 0}]}, {"text": "", "notes": []}]


def test_span_deletion_takes_whole_texts(spark, tmp_path):
    """Spans and notes behind the first 100,000 characters of a page count, too."""
    t = "0123456789abcdefghijklm" * 5000
    spark.createDataFrame([(1, f"<p>{t}</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["note"]: (r["start"], r["end"], r["text_md5"]) for r in core.queries()["span_deletion"](spark, str(tmp_path)).collect()}
    gone = {i for j in range(len(t) // 23 + 1) for i in range(23 * j + 5, 23 * j + 5 + j * 7 % 31)}
    left, at = "".join(c for i, c in enumerate(t) if i not in gone), [0]
    for i in range(len(t)):
        at.append(at[-1] + (i not in gone))
    md5 = hashlib.md5(left.encode()).hexdigest()
    assert got == {k: (at[17 * k], at[17 * k + 1 + k * 5 % 14], md5) for k in range(len(t) // 17)}


def test_a_paragraph_is_read_once(monkeypatch):
    """Text, links and marked words of a paragraph come from one reading of it."""
    from knotwork.functions.references import Parser
    from knotwork.functions.selectors import Selectors
    from knotwork.operators import extractors as E

    read = []
    monkeypatch.setattr(E, "format_fragment", lambda html, f=E.format_fragment: read.append(html) or f(html))
    s = E.SOURCES["book_chapter"]
    notes = "".join(f'<li id="n{j}"><a href="/study/scriptures/ot/josh/2?lang=eng&amp;id=p{j}">x</a></li>' for j in range(1, 4))
    html = "<h1>T</h1>" + "".join(f'<p id="p{j}">some <a href="#n{j}">bright <b>lamp</b></a></p>' for j in range(1, 4)) + f"<ul>{notes}</ul>"
    made = E._parse(s, Selectors(E._paths(s)), "https://a.test/study/manual/jesus-the-christ/chapter-4", html, Parser())
    assert [(p["text"].replace("<b>", "").replace("</b>", ""), [m["words"] for m in p["marked"]]) for p in made["paragraphs"]] == [("some bright lamp", ["bright lamp"])] * 3
    assert len([h for h in read if "bright" in h]) == 3
