"""Operators over sequences: islands, forward fill, interval joins, windows of sentences, scores of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.session import dealt
from . import ordered as O


def merge_runs(rows: DataFrame, part: list[str], order: str, in_run: Column, text_col: str = "text", sep: str = "\n") -> DataFrame:
    """(part..., order, text, n): consecutive rows of a run become one row, at the place of their first (poem lines)."""
    w = Window.partitionBy(*part).orderBy(order)
    r = rows.select(*part, order, text_col, in_run.alias("_in"))
    r = r.withColumn("_start", (~F.col("_in") | ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int"))
    r = r.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text_col, F.lit("")).alias("t"))))
    merged = r.groupBy(*part, "_run").agg(F.min(order).alias(order), F.array_join(F.transform(lines, lambda x: x["t"]), sep).alias("text"), F.count("*").alias("n"))
    return merged.drop("_run")


def fill_heading(rows: DataFrame, part: list[str], order: str, heading: Column, name: str = "topic") -> DataFrame:
    """Rows with the latest heading up to them; rows before the first heading have none."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(heading, ignorenulls=True).over(w))


#: A body line that equals a topic is a page header if the topic is at most so many places before the line's own, or less than so many behind.
NEAR = 5


def topic_stream(rows: DataFrame, group: list[str], order: list[str], name: str, text_col: str = "text", near: int = NEAR, parts: bool = False) -> DataFrame:
    """Body lines with their topic and its number, from a stream of lines some of which name a topic.

    The first line that names a topic begins it; later ones of the same name, in any case, are body text.  Lines before the
    first topic are left out, and so are lines that only repeat a nearby topic: of number n, c - near <= n < c + near,
    where c is the topic that is repeated.  A topic without lines gives one row without text.  With `parts` rows keep the number
    of their range of the order (see ordered.dealt)."""
    lines = O.dealt(rows, group, order)
    firsts = lines.where(F.col(name).isNotNull()).groupBy(*group, F.lower(name).alias("_low")).agg(F.min(F.struct(*order)).alias("_at"))
    firsts = firsts.select(*group, F.col("_at.*"), F.lit(True).alias("_begins"))
    lines = lines.join(firsts, [*group, *order], "left")
    begins = F.coalesce("_begins", F.lit(False))
    lines = O.running(lines, group, order, last={"topic": F.when(begins, F.col(name))}, count={"number": begins})
    topics = lines.where(begins).select(*group, F.lower(name).alias("_low"), F.col("number").alias("_of"))
    body = lines.where(F.col("number") > 0).withColumn(text_col, F.when(~begins, F.col(text_col)))
    said = F.trim(F.regexp_replace(text_col, " +", " "))
    body = body.withColumn("_low", F.lower(said)).join(topics, [*group, "_low"], "left")
    again = (F.col("number") >= F.col("_of") - near) & (F.col("number") < F.col("_of") + near)
    return body.where(~F.coalesce(again, F.lit(False))).drop("_low", "_of", "_begins", name, *([] if parts else ["_part"]))


def notes_in_sentences(sentences: DataFrame, notes: DataFrame, part: list[str], slack: int = 5) -> DataFrame:
    """Sentences (start, end) joined with notes (pos) that lie in them or up to `slack` behind.

    Sentences of a part must not overlap or begin at the same place.  Then those that can hold a note are the ones that begin at
    most `slack` before it, of which there are `slack` + 1 at most, and the last one before these.  Sentences and notes are
    one sequence by place, over which two range frames find them: no sentence is paired with a note that it can't hold."""
    c = F.col
    rest_s, rest_n = [x for x in sentences.columns if x not in part], [x for x in notes.columns if x not in part]
    s, n = sentences.select(*part, F.struct(*rest_s).alias("_s"), c("start").alias("_at")), notes.select(*part, F.struct(*rest_n).alias("_n"), c("pos").alias("_at"))
    both = s.unionByName(n, allowMissingColumns=True)
    by_place = Window.partitionBy(*part).orderBy("_at")
    near = F.collect_list("_s").over(by_place.rangeBetween(-slack, 0))
    earlier = F.last("_s", ignorenulls=True).over(by_place.rangeBetween(Window.unboundedPreceding, -slack - 1))
    swept = both.withColumn("_near", near).withColumn("_earlier", F.array_compact(F.array(earlier))).where(c("_n").isNotNull())
    met = swept.select(*part, "_n", F.explode(F.concat("_earlier", "_near")).alias("_s"))
    found = met.where((c("_n.pos") >= c("_s.start")) & (c("_n.pos") <= c("_s.end") + slack))
    return found.select(*part, *[c(f"_s.{x}") for x in rest_s], *[c(f"_n.{x}") for x in rest_n])


def range_join(left: DataFrame, right: DataFrame, start: str, end: str, at: str, width: float) -> DataFrame:
    """Rows of left whose interval [start, end] holds a row of right, joined by bins of `width`.

    An interval is exploded to the bins it touches, so that the join is one by equality.
    """
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    bins = left.withColumn("_bin", F.explode(F.sequence(first, last)))
    return bins.join(right.withColumn("_bin", F.floor(F.col(at) / width)), "_bin").where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bin")


def sentence_scores(texts: DataFrame, activated: DataFrame, id_col: str | list[str] = "doc_id", text_col: str = "text", short: int = 20, factor: float = 0.3) -> DataFrame:
    """(id, sent, sentence, score): summed weights (name, weight) of a sentence's activated words and n-grams; short ones count less.

    Texts are dealt by their ids before they are cut.  A sentence gives a row that carries it and one for each n-gram, and those that
    aren't activated are gone before the rest meets: if `activated` is broadcast, nothing but the texts is shuffled, once."""
    ids = [id_col] if isinstance(id_col, str) else id_col
    s = dealt(texts.select(*ids, text_col), *ids).select(*ids, F.posexplode(T.sentences(text_col)).alias("sent", "sentence"))
    grams = T.let(T.words(F.lower("sentence")), lambda ws: F.concat(F.array(F.lit(None).cast("string")), ws, T.ngrams(ws, 2), T.ngrams(ws, 3)))
    each = s.select(*ids, "sent", "sentence", F.posexplode(grams).alias("_k", "_g"))
    # the carrier's name is no node's, and spreads if names are shuffled
    carries = F.col("_k") == 0
    name = F.when(carries, F.concat(F.lit(" "), F.xxhash64(*ids, "sent").cast("string"))).otherwise(F.concat("_g", F.lit("|en")))
    each = each.select(*ids, "sent", F.when(carries, F.col("sentence")).alias("sentence"), carries.alias("_carries"), name.alias("_name"))
    hits = each.join(activated.select(F.col("name").alias("_name"), F.col("weight").alias("_weight")), "_name", "left").where("_carries OR _weight IS NOT NULL")
    sums = hits.withColumn("_sum", F.sum("_weight").over(Window.partitionBy(*ids, "sent"))).where("_carries")
    score = F.coalesce("_sum", F.lit(0.0)) * F.when(F.length("sentence") < short, factor).otherwise(1.0)
    return sums.select(*ids, "sent", "sentence", score.alias("score"))


def best_window(scored: DataFrame, id_col: str | list[str] = "doc_id", most: int = 150) -> DataFrame:
    """(id, start, n, score, summary): from each sentence on, as many as fit into `most` characters (one at least); the best such window, the first on ties.

    Every sentence gives a row where it begins and one where it ends; a range frame from each beginning sums
    the ends within reach, so that a text is sorted once and no sentence is paired with another.  All steps are by id, for
    one shuffle at most.
    """
    ids = [id_col] if isinstance(id_col, str) else id_col
    w = Window.partitionBy(*ids).orderBy("sent")
    s = scored.select(*ids, "sent", "sentence", "score", F.sum(F.length("sentence")).over(w).alias("_end"))
    start = F.struct((2 * (F.col("_end") - F.length("sentence")) + 1).alias("key"), F.col("sent"), F.lit(0.0).alias("add"), F.lit(0).alias("one"), F.col("score").alias("own"), F.col("sentence"))
    end = F.struct((2 * F.col("_end")).alias("key"), F.lit(None).cast("int").alias("sent"), F.col("score").alias("add"), F.lit(1).alias("one"), F.lit(0.0).alias("own"), F.lit(None).cast("string").alias("sentence"))
    reach = Window.partitionBy(*ids).orderBy("key").rangeBetween(0, 2 * most - 1)
    rows = s.select(*ids, F.explode(F.array(start, end)).alias("x")).select(*ids, "x.*")
    sums = rows.withColumn("_n", F.sum("one").over(reach)).withColumn("_v", F.sum("add").over(reach)).where("sent IS NOT NULL")
    value = F.round(F.when(F.col("_n") > 0, F.col("_v")).otherwise(F.col("own")), 9)
    best = F.max(F.struct(value.alias("score"), (-F.col("sent")).alias("before"), F.greatest(F.col("_n"), F.lit(1)).cast("int").alias("n")))
    told = sums.withColumn("b", best.over(Window.partitionBy(*ids))).select(*ids, "sent", "sentence", (-F.col("b.before")).alias("start"), F.col("b.n").alias("n"), F.col("b.score").alias("score"))
    inside = told.where(F.col("sent").between(F.col("start"), F.col("start") + F.col("n") - 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent", "sentence"))), lambda e: e["sentence"]), "")
    return inside.groupBy(*ids, "start", "n", "score").agg(F.trim(text).alias("summary"))


def best_paragraph(scored: DataFrame, part: list[str], order: str) -> DataFrame:
    """The row with the highest score of each part, the first on ties."""
    w = Window.partitionBy(*part).orderBy(F.desc("score"), order)
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def distinct_per_text_score(mentions: DataFrame, n_words: DataFrame, doc: str, paragraph: str, thing: str, factor: float = 600.0, least: float = 1.0) -> DataFrame:
    """(doc, n_distinct, words, score): different things per paragraph, summed, times `factor` over the words; below `least`, and without words, rejected."""
    n = mentions.select(doc, paragraph, thing).distinct().groupBy(doc).agg(F.count("*").alias("n_distinct"))
    w = n_words.groupBy(doc).agg(F.sum("words").alias("words"))
    scored = n.join(w, doc).where(F.col("words") > 0).withColumn("score", F.col("n_distinct") * factor / F.col("words"))
    return scored.where(F.col("score") >= least)


def long_enough(rows: DataFrame, part: list[str], text_col: str = "text", least: int = 30, anyway: Column | None = None) -> DataFrame:
    """(part..., length): parts whose texts have `least` characters together, or that `anyway` keeps."""
    keep = F.bool_or(anyway) if anyway is not None else F.lit(False)
    sums = rows.groupBy(*part).agg(F.sum(F.length(text_col)).alias("length"), keep.alias("_anyway"))
    return sums.where((F.col("length") >= least) | F.coalesce("_anyway", F.lit(False))).drop("_anyway")
