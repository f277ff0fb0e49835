import random
import re

import pytest
from pyspark.sql import functions as F

from knotwork.dims import NODE_TYPES, TYPE
from knotwork.functions import nodes as N
from knotwork.operators import features as X
from knotwork.operators import graph as G
from knotwork.operators import search as S
from knotwork.operators import segments as Q
from knotwork.operators import spread as A

RESULT = "type short, name string, score double"


def t(name):
    return TYPE[name]


def results(spark, rows):
    return spark.createDataFrame([(t(k), n, s) for k, n, s in rows], RESULT)


def names_of(df):
    return [r.name for r in df.orderBy(F.desc("score"), "type", "name").collect()]


def test_types():
    assert len(NODE_TYPES) == 34 and TYPE["Word"] == 2 and TYPE["ProclamationSentence"] == 33


@pytest.mark.parametrize(
    ("kind", "name", "doc", "result"),
    [
        ("ScriptureVerse", "gen|1|2", ("ScriptureChapter", "gen|1"), "ScriptureVerse"), ("ScriptureSentence", "gen|1|2|1", ("ScriptureChapter", "gen|1"), "Unknown"), ("ScriptureBook", "gen", ("ScriptureChapter", "gen|1"), "ScriptureBook"),
        ("ConferenceTalkSentence", "1999|04|t|p1|2", ("ConferenceTalk", "1999|04|t"), "Unknown"), ("BibleDictionaryParagraph", "ark|1", ("BibleDictionaryTopic", "ark"), "BibleDictionary"), ("BookParagraph", "atgq|1|2", ("BookChapter", "atgq|1"), "BookATGQ"), ("BookChapter", "jtc|1", ("BookChapter", "jtc|1"), "Unknown"),
        ("ProclamationParagraph", "fam|2", ("Proclamation", "fam"), "Proclamation"), ("HymnVerse", "song|1", ("Hymn", "song"), "Hymn"), ("Word", "a|en", ("Word", "a|en"), "Unknown"), ("Year", "1999", ("Year", "1999"), "Unknown"),
    ],
)
def test_entity_maps(spark, kind, name, doc, result):
    d = spark.createDataFrame([(t(kind), name)], "k short, n string")
    r = d.select(N.to_document(F.col("k"), F.col("n")).alias("d"), N.result_type(F.col("k"), F.col("n")).alias("r"), N.to_named_document(F.col("k"), F.col("n")).alias("nd")).first()
    assert (r.d["type"], r.d["name"], r.r) == (t(doc[0]), doc[1], result)
    if kind == "ScriptureSentence":
        assert (r.nd["type"], r.nd["name"]) == (t("ScriptureVerse"), "gen|1|2")


def test_node_codec(spark):
    d = spark.createDataFrame([("2 a|en",), ("4 1-ne|1|1",)], "s string").select(N.from_text(F.col("s")).alias("n"))
    assert [tuple(r.n) for r in d.collect()] == [(2, "a|en"), (4, "1-ne|1|1")]
    assert spark.createDataFrame([(None,)], "s string").select(N.from_text(F.col("s"))["name"].alias("n")).first().n is None
    for bad in ("word", "x 1", "3"):
        with pytest.raises(Exception, match="no node id"):
            spark.createDataFrame([(bad,)], "s string").select(N.from_text(F.col("s"))).collect()
    w = spark.createDataFrame([("WordDesignation",), ("NgramAssociation",), ("Other",)], "f string").select(N.weight10(F.col("f")).alias("w"))
    assert [r.w for r in w.collect()] == [30, 7, 10]
    s = spark.range(1).select(N.speaker(F.lit("John Q. Public")).alias("a"), N.talk(1999, "04", "x").alias("b"), N.to_sentence(F.lit(t("Year")), F.lit("1"), F.lit(1)).alias("c")).first()
    assert s.a["name"] == "john q public" and s.b["name"] == "1999|04|x" and s.c is None
    assert spark.range(1).select(N.pretty(F.lit(t("ScriptureVerse")), F.lit("1-ne|3|7")).alias("p")).first().p == "1 Nephi 3:7"


def test_filters(spark):
    r = results(spark, [("ScriptureVerse", "gen|1|1", 1.0), ("ScriptureVerse", "matt|1|1", 0.9), ("Word", "a|en", 2.0), ("Proclamation", "fam", 0.3), ("ConferenceTalk", "1999|04|x", 0.2), ("ConferenceSpeaker", "y", 5.0)])
    assert names_of(S.visible(r)) == ["y", "gen|1|1", "matt|1|1", "fam", "1999|04|x"]
    assert names_of(S.in_categories(S.shown(r), ["nt"])) == ["matt|1|1", "fam"]
    books = results(spark, [("BookParagraph", "md|a|1", 1.0), ("BookParagraph", "other|1|1", 0.9), ("HymnVerse", "s|1", 0.8), ("ScriptureVerse", "jst-luke|1|1", 0.7), ("ScriptureChapter", "gen|1", 0.6), ("ScriptureSupplementalPara", "gen|1|intro", 0.5)])
    assert names_of(S.in_categories(books, ["Book"])) == ["md|a|1", "other|1|1", "gen|1|intro"] and names_of(S.in_categories(books, ["ot", "Hymn"])) == ["s|1", "gen|1", "gen|1|intro"]
    assert names_of(S.shown(books)) == ["md|a|1", "other|1|1", "s|1", "jst-luke|1|1"]
    assert names_of(S.above_share(S.shown(r), 0.5)) == ["gen|1|1", "matt|1|1"]
    assert names_of(S.top(r, 2, 900.0)) == ["y", "a|en"]
    two = results(spark, [("ScriptureVerse", "gen|1|1", 1.0), ("ScriptureVerse", "gen|1|2", 1.5), ("ScriptureSentence", "gen|1|2|1", 3.0), ("ScriptureVerse", "gen|2|1", 0.5)])
    assert names_of(S.best_per_document(S.by_paragraph(two))) == ["gen|1|2", "gen|2|1"]
    assert names_of(S.without_documents(two, results(spark, [("ScriptureVerse", "gen|1|9", 0.0)]))) == ["gen|2|1"]


def test_names(spark):
    names = spark.createDataFrame([(t("Hymn"), "a", "Same", "Same (a)"), (t("Hymn"), "b", "Same", None), (t("Hymn"), "c", "Other", None)], "type short, name string, plain_name string, disambig_name string")
    r = S.named(results(spark, [("Hymn", "a", 3.0), ("Hymn", "b", 2.0), ("Hymn", "c", 1.0), ("Hymn", "z", 0.5), ("ScriptureBook", "gen", 0.4)]), names)
    assert {x.name: (x.plain_name, x.display_name) for x in r.collect()} == {"a": ("Same", "Same (a)"), "b": ("Same", "Same"), "c": ("Other", "Other"), "z": ("UNKNOWN_NAME",) * 2, "gen": ("Genesis", "Genesis")}
    assert names_of(S.one_per_name(r, "plain_name", 2)) == ["a"]  # a suppressed name has used its place
    assert {x.name: x.ambiguous for x in S.needs_disambiguation(r, ["type", "plain_name"]).collect()}["a"]
    w = spark.createDataFrame([(1, "x", "old", "o", 1), (1, "x", "new", "n", 2)], "type short, name string, plain_name string, disambig_name string, seq int")
    assert tuple(S.upsert_names(w).first()) == (1, "x", "new", "n")
    g = names.withColumn("type", F.lit(t("TopicalGuideKeyword")).cast("short"))
    assert {x["name"]: [i["name"] for i in x["ids"]] for x in S.name_groups(g).collect()} == {"Same": ["a", "b"], "Other": ["c"]}


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [("gen|1|1", "light and darkness"), ("gen|1|2", "light shines"), ("matt|5|1", "salt and light of the world"), ("exx|1|1", "nothing here at all")]
    d = spark.createDataFrame(docs, "id string, text string")
    return d, A.prepare(G.edges(X.text_features(d, "id", "text", entity="ScriptureVerse")))


def test_slow_search(spark, corpus):
    d, g = corpus
    q = S.add_phrase(A.Query(max_hops=3), "light")
    r, words = S.slow_search(q, g)
    assert sorted(n.rsplit("|", 1)[0] for n in names_of(r)) == ["gen|1", "matt|5"]  # one a chapter
    assert ("light|en", 1.0) in {(x.name, x.score) for x in words.collect()}
    r, _ = S.slow_search(q, g, enabled=["nt"])
    assert names_of(r) == ["matt|5|1"]
    paras = d.select(F.lit(t("ScriptureVerse")).cast("short").alias("type"), F.col("id").alias("name"), "text")
    assert S.hydrate(r, paras).first().text == "salt and light of the world"
    r, _ = S.slow_search(S.passage_query("light", t("ScriptureVerse"), "gen|1|1"), g)
    assert "gen|1|1" not in names_of(r)
    assert S.same_scope([(1, "a"), (2, "b")], [(2, "b"), (1, "a")]) and S.reference_query(4, "x").scopes


def test_fast_search(spark):
    names = spark.createDataFrame([(t("Hymn"), "h1", "Amazing Grace", None), (t("Hymn"), "h2", "Amazing Love", None), (t("Hymn"), "h3", "Silent Night", None)], "type short, name string, plain_name string, disambig_name string")
    index = A.prepare(G.edges(X.char_features(names, text_col="plain_name")))
    found = S.fast_search("amazin grace", index, names).collect()
    assert found[0].score == 1000.0 and found[1].name == "h1"
    for phrase, kind, name, shown in (("Gen. 3:4", "ScriptureVerse", "gen|3|4", "Genesis 3:4"), ("gen 3", "ScriptureChapter", "gen|3", "Genesis 3"), ("Genesis", "ScriptureBook", "gen", "Genesis")):
        said = {(r.type, r.name, r.display_name) for r in S.fast_search(phrase, index, names).collect() if r.score == S.SAID}
        assert said == {(t("Word"), phrase, phrase), (t(kind), name, shown)}


def test_cards_sum_up_kickers_and_best_paragraphs(spark):
    talk, para = t("ConferenceTalk"), t("ConferenceTalkParagraph")
    rs = results(spark, [("ConferenceTalk", "2001|10|a", 1.0), ("ConferenceTalk", "2001|10|b", 0.9), ("ConferenceTalkParagraph", "2001|10|a|2", 0.8), ("ScriptureVerse", "gen|1|2", 0.7), ("Hymn", "x", 0.6)])
    docs = spark.createDataFrame([(talk, "2001|10|a", "A", "Ann", 2001, "10", " Kick of light. "), (talk, "2001|10|b", "B", "Bob", 2001, "10", None)], "type short, name string, title string, speaker string, year int, phase string, kicker string")
    rows = [(para, f"2001|10|{d}|{k}", k, x) for d in "ab" for k, x in ((1, "Nothing much is said in here."), (2, "The light is on the hill and shines."), (3, "More light and light than that."))]
    paras = spark.createDataFrame(rows + [(t("ScriptureVerse"), "gen|1|2", 1, "Let there be light.")], "type short, name string, pos int, text string")
    active = spark.createDataFrame([("light|en", 1.0)], "name string, weight double")
    got = {r.name: (r.label, r.summary) for r in S.cards(rs, docs, paras, active).collect()}
    assert got["2001|10|a"] == ("October 2001 General Conference - A - Ann", "Kick of light.") and got["2001|10|b"] == ("October 2001 General Conference - B - Bob", "More light and light than that.")
    assert got["2001|10|a|2"] == ("October 2001 General Conference - A - Ann", "The light is on the hill and shines.") and got["gen|1|2"] == ("Genesis 1:2", "Let there be light.") and got["x"] == (S.UNKNOWN_NAME, None)


def _shuffles(df):
    return re.findall(r"Exchange (hashpartitioning\([^\n]*)", df._jdf.queryExecution().executedPlan().toString())


def test_cards_shuffle_texts_by_entity_and_no_words(spark):
    active = spark.createDataFrame([("light|en", 1.0), ("a light|en", 1.0)], "name string, weight double")
    docs = spark.createDataFrame([(1, "A light. Dark."), (2, None)], "doc_id int, text string")
    assert len(_shuffles(Q.best_window(Q.sentence_scores(docs, F.broadcast(active))))) == 1
    rs = results(spark, [("Hymn", "x", 0.6)])
    heads = spark.createDataFrame([], "type short, name string, title string, speaker string, year int, phase string, kicker string")
    paras = spark.createDataFrame([(t("Hymn"), "x", 1, "Let there be light.")], "type short, name string, pos int, text string")
    assert all("type#" in x and "_name#" not in x for x in _shuffles(S.cards(rs, heads, paras, active)) if "name#" in x)


def test_sentence_scores_of_repeated_names_texts_and_empty_ones(spark):
    active = spark.createDataFrame([("light|en", 1.0), ("light|en", 0.5), ("more|light|en", 2.0)], "name string, weight double")
    docs = spark.createDataFrame([(1, "More light on the hill. ..."), (2, ""), (3, None), (4, "None of it is in here.")], "doc_id int, text string")
    for known in (active, F.broadcast(active)):
        got = sorted((r.doc_id, r.sent, r.sentence, r.score) for r in Q.sentence_scores(docs, known).collect())
        assert got == [(1, 0, "More light on the hill. ...", 3.5), (4, 0, "None of it is in here.", 0.0)]


def test_first_with_document(spark):
    c = spark.createDataFrame([(t("ScriptureVerse"), "gen|9|1", 1), (t("ScriptureVerse"), "gen|1|1", 2), (t("ScriptureVerse"), "gen|1|2", 3)], "type short, name string, pos int")
    docs = spark.createDataFrame([(t("ScriptureChapter"), "gen|1")], "type short, name string")
    assert S.first_with_document(c, docs).first().name == "gen|1|1"


# sequences


def test_runs_and_headings(spark):
    rows = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", True), (1, 3, "c", True), (1, 4, "d", False), (2, 1, None, True), (2, 2, "f", True)], "d int, i int, text string, line boolean")
    got = [(r.d, r.i, r.text, r.n) for r in Q.merge_runs(rows, ["d"], "i", F.col("line")).orderBy("d", "i").collect()]
    assert got == [(1, 1, "a", 1), (1, 2, "b\nc", 2), (1, 4, "d", 1), (2, 1, "\nf", 2)]
    rows = spark.createDataFrame([(1, k, h) for k, h in enumerate([None, "A", None, "A", None, "B", *[None] * 6, "A"])], "d int, i int, h string")
    filled = [r.topic for r in Q.fill_heading(rows, ["d"], "i", F.col("h")).orderBy("i").collect()]
    assert filled == [None, *"AAAAB", *"BBBBBB", "A"]


def test_topic_stream_same_as_plain(spark):
    g = random.Random(8)
    stream = [(d, k, g.choice([None, None, x := f"T{g.randrange(14)}", x.lower()]), f" t{g.randrange(14)}  " if g.random() < 0.5 else f"text {k}") for d in range(3) for k in range(120)]
    want = []
    for d in range(3):
        topics, bodies, now = [], {}, None
        for _, k, name, text in [r for r in stream if r[0] == d]:
            if name and name.lower() not in bodies:
                now = name.lower()
                topics.append(name)
                bodies[now] = []
            elif now:
                bodies[now].append((k, text))
        for c, topic in enumerate(topics):
            for a in range(max(0, c - 5), min(len(topics), c + 5)):
                own = bodies[topics[a].lower()]
                own[:] = [x for x in own if x[1].strip() != topic.lower()]
        want += [(d, k, n + 1, topic) for n, topic in enumerate(topics) for k, _ in bodies[topic.lower()]]
    rows = spark.createDataFrame(stream, "d int, i int, name string, text string").repartition(5)
    got = Q.topic_stream(rows, ["d"], ["i"], "name").where("text IS NOT NULL").select("d", "i", "number", "topic").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_notes_meet_only_sentences_that_can_hold_them(spark):
    g = random.Random(9)
    s, n = [], []
    for p in range(4):
        at = 0
        for k in range(60):
            at += g.randint(0, 3)
            end = at + g.randint(0, 9)
            s.append((p, k, at, end))
            at = end + 1
        n += [(p, g.randint(0, at + 12)) for _ in range(150)]
    want = sorted((p, k, x) for p, k, a, b in s for q, x in n if p == q and a <= x <= b + 5)
    got = Q.notes_in_sentences(spark.createDataFrame(s, "p int, k int, start int, end int"), spark.createDataFrame(n, "p int, pos int"), ["p"]).select("p", "k", "pos")
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_notes_and_ranges(spark):
    s = spark.createDataFrame([("p", 0, 0, 10), ("p", 1, 11, 20), ("q", 0, 0, 5)], "para string, sent int, start int, end int")
    n = spark.createDataFrame([("p", 10), ("p", 14), ("p", 26), ("q", 5)], "para string, pos int")
    assert sorted((r.para, r.sent, r.pos) for r in Q.notes_in_sentences(s, n, ["para"]).collect()) == [("p", 0, 10), ("p", 0, 14), ("p", 1, 14), ("q", 0, 5)]
    left = spark.createDataFrame([(k, float(k), k + 3.5) for k in range(20)], "id int, a double, b double")
    right = spark.createDataFrame([(k * 0.7,) for k in range(40)], "x double")
    want = sorted((k, round(j * 0.7, 6)) for k in range(20) for j in range(40) if k <= j * 0.7 <= k + 3.5)
    assert sorted((r.id, round(r.x, 6)) for r in Q.range_join(left, right, "a", "b", "x", 2.0).collect()) == want


def test_best_window_same_as_plain(spark):
    import random

    g = random.Random(8)
    texts = [[("x" * g.randint(3, 90) + ". ", g.choice([0.0, 0.5, 1.0, 2.0])) for _ in range(g.randint(1, 15))] for _ in range(30)] + [[("y" * 400 + ".", 1.0), ("short. ", 1.0)]]
    rows = [(k, j, s, v) for k, t in enumerate(texts) for j, (s, v) in enumerate(t)]
    got = {r.doc_id: r for r in Q.best_window(spark.createDataFrame(rows, "doc_id int, sent int, sentence string, score double")).collect()}
    for k, sents in enumerate(texts):
        best = None
        for a in range(len(sents)):
            n, size = 1, len(sents[a][0])
            while a + n < len(sents) and size + len(sents[a + n][0]) <= 150:
                size += len(sents[a + n][0])
                n += 1
            score = sum(v for _, v in sents[a : a + n])
            if best is None or score > best[0] + 1e-12:
                best = (score, a, n)
        assert (got[k].start, got[k].n) == best[1:] and abs(got[k].score - best[0]) < 1e-6
        assert got[k].summary == "".join(s for s, _ in sents[best[1] : best[1] + best[2]]).strip()


def test_scores(spark):
    m = spark.createDataFrame([("d", 1, "x"), ("d", 1, "x"), ("d", 2, "x"), ("e", 1, "y"), ("z", 1, "y")], "doc string, p int, c string")
    w = spark.createDataFrame([("d", 600), ("e", 6000), ("z", 0)], "doc string, words int")
    assert [(r.doc, r.score) for r in Q.distinct_per_text_score(m, w, "doc", "p", "c").collect()] == [("d", 2.0)]
    rows = spark.createDataFrame([("a", "x" * 40, False), ("b", "x", False), ("c", "x", True)], "k string, text string, see boolean")
    assert sorted(r.k for r in Q.long_enough(rows, ["k"], anyway=F.col("see")).collect()) == ["a", "c"]
    best = spark.createDataFrame([("d", 1, 2.0), ("d", 2, 5.0), ("d", 3, 5.0)], "k string, i int, score double")
    assert Q.best_paragraph(best, ["k"], "i").first().i == 2


def test_slow_search_without_a_kind_of_book(spark):
    """Result types that are off are left out before the share of the best and the limit are taken."""
    b, w = TYPE["BookParagraph"], TYPE["Word"]
    rows = [(b, f"{book}|{k}|1", w, "lamp|en", 10) for book in ("md", "atgq") for k in range(3)]
    g = A.Unsummed(spark.createDataFrame(rows, "a_type short, a_name string, b_type short, b_name string, weight10 long"))
    q = lambda: A.Query(max_hops=1).add_root(w, "lamp|en")
    found = lambda **o: {r.name for r in S.slow_search(q(), g, enabled=["Book"], limit=3, **o)[0].collect()}
    assert found() == {f"atgq|{k}|1" for k in range(3)} == found(off=("BookMD",))
    assert found(off=("BookATGQ",)) == {f"md|{k}|1" for k in range(3)}
