"""Training features: weighted pairs of nodes made of texts.

All of it is array work within a row and one explode, so that no feature needs a shuffle before the
features are summed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import TYPE, WEIGHT10
from ..functions import text as T
from ..plans.session import dealt
from ..sources.edges import EdgeStore, bucket_of, most_buckets
from .graph import PAIR

#: How many words ahead a word is associated with.
WORD_ORDER = 7


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent, ws): the lower-cased words of each sentence; null texts have none."""
    return docs.select(id_col, F.posexplode(T.sentences(F.lower(text_col))).alias("sent", "sentence")).select(id_col, "sent", T.words("sentence").alias("ws"))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sent, pos, w)."""
    return tokens(docs, id_col, text_col).select(id_col, "sent", F.posexplode("ws").alias("pos", "w"))


def text_features(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "en", entity: str = "Entity", order: int = WORD_ORDER, kinds: tuple[str, ...] = ("word", "near", "bigram", "trigram")
) -> DataFrame:
    """(a_type, a_name, b_type, b_name, weight10): what a text teaches about its entity and its words.

    word: entity with each word; near: words with the next ones of their sentence; bigram and trigram: entity
    with each n-gram, and each n-gram with its members.
    """
    e, w, g = (F.lit(TYPE[t]).cast("short") for t in (entity, "Word", "NGram"))
    light, strong = (F.lit(WEIGHT10[k]).cast("long") for k in ("WordAssociation", "NgramAssociation"))
    named = lambda x: F.concat(x, F.lit(f"|{lang}"))
    pair = lambda at, an, bt, bn, weight: F.struct(at.alias("a_type"), an.alias("a_name"), bt.alias("b_type"), bn.alias("b_name"), weight.alias("weight10"))
    own = F.col("_own").cast("string")
    if kinds == ("word",):  # no word goes beyond the end of its sentence: sentences needn't be cut
        each = docs.select(F.col(id_col).alias("_own"), F.explode(T.words(F.lower(text_col))).alias("_w"))
        return each.select(e.alias("a_type"), own.alias("a_name"), w.alias("b_type"), named(F.col("_w")).alias("b_name"), light.alias("weight10"))
    ahead = lambda k: F.get("ws", F.col("_p") + k)  # null behind the sentence's end, as is what is made of it

    def grams(n: int) -> list[Column]:
        members = [F.col("_w"), *[ahead(k) for k in range(1, n)]]
        name = members[0]
        for m in members[1:]:
            name = F.concat(name, F.lit("|"), m)
        whole = F.when(members[-1].isNotNull(), named(name))
        return [pair(e, own, g, whole, strong), *[pair(w, named(m), g, whole, light) for m in members]]

    made = {
        "word": [pair(e, own, w, named(F.col("_w")), light)],
        "near": [pair(w, named(F.col("_w")), w, named(ahead(k)), light) for k in range(1, order + 1)],
        "bigram": grams(2),
        "trigram": grams(3),
    }
    # a row a word, and what begins with it; explodes and structs are compiled, functions over arrays are not
    each = tokens(docs, id_col, text_col).select(F.col(id_col).alias("_own"), "ws", F.posexplode("ws").alias("_p", "_w"))
    return each.select(F.inline(F.array(*[x for k in kinds for x in made[k]]))).where("b_name IS NOT NULL")


def _edge(s: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    return F.struct(s[0].alias("src_type"), s[1].alias("src_name"), d[0].alias("dst_type"), d[1].alias("dst_name"))


#: Words that each text is searched for before it is cut.
FEW = 64


@dataclass(frozen=True)
class Words:
    """The graph of entities and the words of their texts, which are text_features() of kind word: edges of some nodes without the rest."""

    docs: DataFrame
    id_col: str = "doc_id"
    text_col: str = "text"
    lang: str = "en"
    entity: str = "Entity"

    def features(self) -> DataFrame:
        return text_features(self.docs, self.id_col, self.text_col, self.lang, self.entity, kinds=("word",))

    def edges(self) -> DataFrame:
        """(src_type, src_name, dst_type, dst_name, mass10): graph.edges() of the features."""
        own, word = self._ends()
        return self._sums().select(F.inline(F.array(_edge(own, word), _edge(word, own))), "mass10")

    def pairs(self) -> DataFrame:
        """(u_type, u_name, v_type, v_name, mass10): graph.pairs() of the features."""
        ends = self._ends() if TYPE[self.entity] < TYPE["Word"] else self._ends()[::-1]
        return self._sums().select(*[x.alias(name) for x, name in zip([x for end in ends for x in end], PAIR, strict=True)], "mass10")

    def _sums(self) -> DataFrame:
        """(_own, _w, mass10): an entity's texts are dealt to one task, so that its words are counted where they are made."""
        texts = dealt(self.docs.select(F.col(self.id_col).cast("string").alias("_own"), F.lower(self.text_col).alias("_text")), "_own")
        return texts.select("_own", F.explode(T.words("_text")).alias("_w")).groupBy("_own", "_w").agg((F.count("*") * WEIGHT10["WordAssociation"]).alias("mass10"))

    def stored(self, path: str) -> EdgeStore:
        """The graph at rest.  Texts are dealt by their entities' buckets, whose edges are written where they are made."""
        n = most_buckets(self.docs.sparkSession)
        own, word = self._ends()
        texts = self.docs.select(F.col(self.id_col).cast("string").alias("_own"), F.lower(self.text_col).alias("_text")).withColumn("bucket", bucket_of(*own, n))
        each = dealt(texts, "bucket").select("bucket", "_own", F.explode(T.words("_text")).alias("_w"))
        sums = each.groupBy("bucket", "_own", "_w").agg((F.count("*") * WEIGHT10["WordAssociation"]).alias("mass10"))
        return EdgeStore.write_sides(sums.select(_edge(own, word).alias("_e"), "mass10", "bucket").select("_e.*", "mass10", "bucket"), path, n)

    def _ends(self) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
        """Type and name of the entity and of the word of a row (_own, _w)."""
        return (F.lit(TYPE[self.entity]).cast("short"), F.col("_own")), (F.lit(TYPE["Word"]).cast("short"), F.concat("_w", F.lit(f"|{self.lang}")))

    def edges_of(self, wanted: DataFrame, small: bool = True) -> DataFrame:
        """(src_type, src_name, dst_type, dst_name, mass10): all edges of some nodes (src_type, src_name), which must be different.

        If few of these are words, only texts of wanted entities and texts that hold one of the words anywhere are cut.  Texts of one
        entity are dealt to one task before they are cut, so that its words are counted where they are made."""
        c, end = F.col, f"|{self.lang}"
        hint = F.broadcast if small else lambda d: d
        ids = wanted.where(c("src_type") == TYPE[self.entity]).select(c("src_name").alias("_own"), F.lit(True).alias("_hit"))
        words = wanted.where((c("src_type") == TYPE["Word"]) & c("src_name").endswith(end)).select(F.expr(f"left(src_name, length(src_name) - {len(end)})").alias("_w"), F.lit(True).alias("_known"))
        few = [r[0] for r in words.select("_w").limit(FEW + 1).collect()]
        texts = self.docs.select(c(self.id_col).cast("string").alias("_own"), F.lower(self.text_col).alias("_text")).join(hint(ids), "_own", "left")
        if len(few) <= FEW:
            texts = texts.where(reduce(lambda a, b: a | b, [c("_text").contains(w) for w in few], c("_hit").isNotNull()))
        each = dealt(texts, "_own").select("_own", "_hit", F.explode(T.words("_text")).alias("_w"))
        sums = each.groupBy("_own", "_hit", "_w").agg((F.count("*") * WEIGHT10["WordAssociation"]).alias("mass10")).join(hint(words), "_w", "left")
        own, word = self._ends()
        return sums.select(F.inline(F.array_compact(F.array(F.when(c("_hit"), _edge(own, word)), F.when(c("_known"), _edge(word, own))))), "mass10")


def previous_links(rows: DataFrame, part: list[str], order: list[str], node: str, kind: str, weight10: int = 10) -> DataFrame:
    """Each element of a sequence with the one before it, as features of one node type."""
    before = F.lag(node).over(Window.partitionBy(*part).orderBy(*order))
    t = F.lit(TYPE[kind]).cast("short")
    linked = rows.select(F.col(node).alias("a_name"), before.alias("b_name")).where(F.col("b_name").isNotNull())
    return linked.select(t.alias("a_type"), "a_name", t.alias("b_type"), "b_name", F.lit(weight10).cast("long").alias("weight10"))


def char_features(names: DataFrame, type_col: str = "type", name_col: str = "name", text_col: str = "text") -> DataFrame:
    """Search-index features: each entity with the words, n-grams and character trigrams of its name."""
    types = F.create_map(*[F.lit(x) for k in ("Word", "NGram", "CharNGram") for x in (k, TYPE[k])])
    f = names.select(F.col(type_col).cast("short").alias("a_type"), F.col(name_col).alias("a_name"), F.explode(T.char_level_features(text_col)).alias("f"))
    name = F.when(F.col("f.type_name") == "CharNGram", F.col("f.name")).otherwise(F.concat("f.name", F.lit("|en")))
    return f.select("a_type", "a_name", F.try_element_at(types, F.col("f.type_name")).cast("short").alias("b_type"), name.alias("b_name"), F.lit(10).cast("long").alias("weight10"))
