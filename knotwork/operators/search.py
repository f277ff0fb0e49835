"""Search: roots of a phrase, filters, names, one result a document, cut-offs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import TYPE
from ..functions import nodes as N
from ..functions.references import Parser
from ..sources.edges import EdgeStore
from . import segments as Q
from .spread import BROADCAST_NODES, NODE, Query, Unsummed, run

# Node types that a search may show, and such as only carry activation.
SHOWN = (
    "ScriptureVerse", "ConferenceTalk", "ConferenceTalkParagraph", "BibleDictionaryTopic", "BibleDictionaryParagraph", "BookChapter", "BookParagraph",
    "ByuSpeech", "ByuSpeechParagraph", "Hymn", "HymnVerse", "Proclamation", "ProclamationParagraph",
)
HIDDEN = ("Word", "NGram", "CharNGram")
UNKNOWN_NAME = "UNKNOWN_NAME"
_WORD = re.compile(r"[^\W_]+(?:[-\w]*[^\W_])?(?:['’]\w+)?")


def phrase_nodes(phrase: str, lang: str = "en", grams: bool = True) -> list[tuple[int, str]]:
    """Word, bigram and trigram nodes of a phrase."""
    ws = _WORD.findall(phrase.lower())
    out = [(TYPE["Word"], f"{w}|{lang}") for w in ws]
    for n in (2, 3) if grams else ():
        out += [(TYPE["NGram"], "|".join(ws[k : k + n]) + f"|{lang}") for k in range(len(ws) - n + 1)]
    return out


def char_nodes(phrase: str, lang: str = "en") -> list[tuple[int, str]]:
    """Character-level nodes of a phrase: words, marked n-grams, character trigrams."""
    ws = _WORD.findall(phrase.lower())
    marked = ["STKN", *ws, "ETKN"]
    out = [(TYPE["Word"], f"{w}|{lang}") for w in ws]
    for n in (2, 3):
        out += [(TYPE["NGram"], "|".join(marked[k : k + n]) + f"|{lang}") for k in range(len(marked) - n + 1)]
    return out + [(TYPE["CharNGram"], f"[{w}]"[k : k + 3]) for w in ws for k in range(len(w))]


def add_phrase(query: Query, phrase: str, scope: int = 0, weight: float = 1.0) -> Query:
    for kind, name in phrase_nodes(phrase):
        query.add_root(kind, name, scope, weight)
    return query


def visible(results: DataFrame, hidden: tuple[str, ...] = HIDDEN) -> DataFrame:
    return results.where(~F.col("type").isin([TYPE[t] for t in hidden]))


def shown(results: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return results.where(F.col("type").isin([TYPE[t] for t in (*SHOWN, *extra)]))


def by_paragraph(results: DataFrame) -> DataFrame:
    """Sentences as their paragraphs, with the highest score of each."""
    p = N.to_paragraph(F.col("type"), F.col("name"))
    return results.select(p["type"].alias("type"), p["name"].alias("name"), "score").groupBy(*NODE).agg(F.max("score").alias("score"))


def in_categories(results: DataFrame, enabled: list[str]) -> DataFrame:
    """Results of enabled categories (nodes.CATEGORIES); what no filter is for passes, verses of unknown books don't."""
    c = N.category(F.col("type"), F.col("name"))
    return results.where(c.isin([*enabled, N.NO_FILTER]))


def _best_first(name: str = "score") -> list[Column]:
    """Highest first, ties by node; scores that agree in nine digits are ties, whatever the order in which they were summed."""
    return [F.desc(F.round(name, 9)), *[F.col(c) for c in NODE]]


def above_share(results: DataFrame, share: float) -> DataFrame:
    """Results of at least this share of the highest score; the highest is one aggregated row."""
    top = results.agg(F.max("score").alias("_top"))
    return results.join(F.broadcast(top), F.round("score", 9) >= F.round(share * F.col("_top"), 9)).drop("_top")


def best_per_document(results: DataFrame, document: Column | None = None) -> DataFrame:
    """The highest result of each document."""
    d = document if document is not None else N.to_document(F.col("type"), F.col("name"))
    w = Window.partitionBy("_doc").orderBy(*_best_first())
    return results.withColumn("_doc", d).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_doc", "_r")


def without_documents(results: DataFrame, ignored: DataFrame) -> DataFrame:
    """Results whose document is not among ignored (type, name) entities' documents."""
    d = N.to_document(F.col("type"), F.col("name"))
    skip = ignored.select(d.alias("_doc")).distinct()
    return results.withColumn("_doc", d).join(skip, "_doc", "left_anti").drop("_doc")


def top(results: DataFrame, n: int, min_confidence: float | None = None) -> DataFrame:
    """The n highest results with score * 1000 above min_confidence."""
    if min_confidence is not None:
        results = results.where(F.col("score") * 1000 > min_confidence)
    return results.orderBy(*_best_first()).limit(n)


def named(results: DataFrame, names: DataFrame) -> DataFrame:
    """With (plain_name, display_name) from (type, name, plain_name, disambig_name); the fallback is a scripture's form, then a fixed text."""
    joined = results.join(names.select(*NODE, "plain_name", "disambig_name"), NODE, "left")
    plain = F.coalesce("plain_name", N.pretty(F.col("type"), F.col("name")), F.lit(UNKNOWN_NAME))
    return joined.withColumn("display_name", F.coalesce("disambig_name", plain)).withColumn("plain_name", plain).drop("disambig_name")


def needs_disambiguation(rows: DataFrame, by: list[str]) -> DataFrame:
    """With ambiguous: whether several rows share these columns."""
    return rows.withColumn("ambiguous", F.count("*").over(Window.partitionBy(*by)) > 1)


def one_per_name(results: DataFrame, name_col: str, limit: int) -> DataFrame:
    """Of the first `limit` results, the highest of each name; suppressed ones have used their place."""
    first = results.orderBy(*_best_first()).limit(limit)
    w = Window.partitionBy(name_col).orderBy(*_best_first())
    return first.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def name_groups(names: DataFrame, kinds: tuple[str, ...] = ("GuideToScripturesTopic", "TripleIndexTopic", "TopicalGuideKeyword"), name_col: str = "plain_name") -> DataFrame:
    """(name, ids): the entities of these types that share a name, in order."""
    rows = names.where(F.col("type").isin([TYPE[k] for k in kinds]))
    ids = F.array_sort(F.collect_list(F.struct(*NODE)))
    return rows.groupBy(F.col(name_col).alias("name")).agg(ids.alias("ids"))


def upsert_names(names: DataFrame, seq: str = "seq") -> DataFrame:
    """One row a node: the last name written."""
    last = lambda c: F.max_by(c, seq).alias(c)
    return names.groupBy(*NODE).agg(last("plain_name"), last("disambig_name"))


#: Score of what a phrase says itself: its words, and the reference that it may be.
SAID = 1000.0


def fast_search(phrase: str, index: EdgeStore | Unsummed, names: DataFrame, limit: int = 10, parser: Parser | None = None) -> DataFrame:
    """Type-ahead: the phrase's words and the reference that it may be; then character-level roots, a quarter of the best score as cut-off, names, one row a name."""
    q = Query()
    for kind, name in char_nodes(phrase):
        q.add_root(kind, name)
    found = named(above_share(visible(run(q, index)), 0.25), names)
    spark = index.edges.sparkSession
    said = [(TYPE["Word"], phrase, SAID, phrase, phrase)]
    if reference := (parser or Parser()).one(phrase):
        kind, name = reference.node()
        said.append((kind, name, SAID, reference.words(), reference.words()))
    literal = spark.createDataFrame(said, "type short, name string, score double, plain_name string, display_name string")
    return literal.unionByName(one_per_name(found, "plain_name", limit)).orderBy(F.desc("score"), *NODE)


def slow_search(query: Query, graph: EdgeStore | Unsummed, enabled: list[str] | None = None, ignored: DataFrame | None = None, limit: int = 50, min_confidence: float = 0.0, extra: tuple[str, ...] = (), off: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Deep search: (results, activated words).

    Results are paragraphs and documents of enabled categories and of no result type that is off, one a document, above a
    hundredth of the highest score.  Words are those above that cut, with the roots among them at 1.
    """
    found = run(query, graph)
    results = shown(by_paragraph(found), extra)
    if enabled is not None:
        results = in_categories(results, enabled)
    if off:
        results = results.where(~N.result_type(F.col("type"), F.col("name")).isin(list(off)))
    if ignored is not None:
        results = without_documents(results, ignored)
    results = top(above_share(best_per_document(results), 0.01), limit, min_confidence)
    words = above_share(found, 0.01).where(F.col("type").isin(TYPE["Word"], TYPE["NGram"]))
    roots = query.roots(graph.edges.sparkSession).where(F.col("type").isin(TYPE["Word"], TYPE["NGram"])).select(*NODE, F.lit(1.0).alias("score")).distinct()
    return results, words.unionByName(roots)


def hydrate(results: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Results with the text of their paragraph, from (type, name, text)."""
    return results.join(paragraphs.select(*NODE, "text"), NODE, "left")


def labels(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Results with `label`: the header under which a result is shown, from its document's (type, name, title, speaker, year, phase)."""
    kind, name = F.col("type"), F.col("name")
    d = documents.select(F.struct(*NODE).alias("_doc"), "title", "speaker", "year", "phase")
    found = results.withColumn("_doc", N.to_document(kind, name)).join(d, "_doc", "left")
    month = F.when(F.col("phase") == "04", "April").otherwise("October")
    talk = F.concat_ws(" - ", F.concat(month, F.lit(" "), F.col("year").cast("string"), F.lit(" General Conference")), "title", "speaker")
    talks = kind.isin([TYPE[t] for t in ("ConferenceTalk", "ConferenceTalkParagraph")])
    label = F.when(talks & F.col("title").isNotNull(), talk).otherwise(F.coalesce(N.pretty(kind, name), "title", F.lit(UNKNOWN_NAME)))
    return found.withColumn("label", label).drop("_doc", "title", "speaker", "year", "phase")


def cards(results: DataFrame, documents: DataFrame, paragraphs: DataFrame, activated: DataFrame, most: int = 150) -> DataFrame:
    """(type, name, score, label, summary): results as they are shown, with the run of sentences that the activated words (name, weight) match best.

    A paragraph is summed up from its own text; a document from its kicker, if it has one, or else from its best paragraph.  documents:
    (type, name, title, speaker, year, phase, kicker), paragraphs: (type, name, pos, text).  A result without text has no summary."""
    kind, name = F.col("type"), F.col("name")
    heads = documents.select(*NODE, "kicker").where(F.trim(F.coalesce("kicker", F.lit(""))) != "")
    own = results.select(*NODE).join(paragraphs.select(*NODE, F.lit(0).alias("pos"), "text"), NODE)
    kickers = results.select(*NODE).join(heads.select(*NODE, F.lit(0).alias("pos"), F.col("kicker").alias("text")), NODE)
    p = paragraphs.select("pos", "text", N.to_document(kind, name).alias("_d")).select("pos", "text", F.col("_d.type").alias("type"), F.col("_d.name").alias("name"))
    whole = results.select(*NODE).join(paragraphs.select(*NODE), NODE, "left_anti").join(heads, NODE, "left_anti").join(p, NODE).select(*NODE, "pos", "text")
    texts = own.unionByName(kickers).unionByName(whole).where("text IS NOT NULL")
    known = activated.select("name", "weight")
    known = F.broadcast(known) if known.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else known
    best = Q.best_window(Q.sentence_scores(texts, known, [*NODE, "pos"]), [*NODE, "pos"], most)
    first = Q.best_paragraph(best, NODE, "pos").select(*NODE, "summary")
    return labels(results, documents).join(first, NODE, "left").select(*NODE, "score", "label", "summary")


def first_with_document(candidates: DataFrame, documents: DataFrame, order_col: str = "pos") -> DataFrame:
    """The first candidate whose document is in the catalogue (type, name)."""
    d = candidates.withColumn("_doc", N.to_document(F.col("type"), F.col("name")))
    keys = documents.select(F.struct(*NODE).alias("_doc")).distinct()
    return d.join(keys, "_doc", "left_semi").drop("_doc").orderBy(order_col).limit(1)


# presets of the deep search

def passage_query(text: str, kind: int, name: str) -> Query:
    """A search from a selected passage: its words in one scope and its entity in another."""
    return add_phrase(Query(), text, 0).add_root(kind, name, 1)


def reference_query(kind: int, name: str) -> Query:
    return Query().add_root(kind, name)


def same_scope(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> bool:
    """Whether two scopes have the same nodes."""
    return set(a) == set(b)
