"""Incremental training: features that arrive are added to a stored graph.

Training is additive.  A batch of features is summed to edges and written as a delta; deltas are compacted into
generations now and then, behind a manifest (see sources/generations.py).  The batch number names the delta, so a batch that is run
again counts once, whether or not it was compacted meanwhile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import features as X
from ..sources.generations import GraphLog


def add_batch(features: DataFrame, path: str, batch: int) -> None:
    GraphLog(features.sparkSession, path).add(features, batch)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The graph of all batches so far."""
    return GraphLog(spark, path).current()


def train_stream(docs: DataFrame, path: str, checkpoint: str, compact_every: int = 0, **options: object) -> StreamingQuery:
    """Train on a stream of documents; every micro-batch is one delta, and every `compact_every`th one compacts them."""

    def each(batch: DataFrame, number: int) -> None:
        log = GraphLog(batch.sparkSession, path)
        log.add(X.text_features(batch, **options), number)
        if compact_every and (number + 1) % compact_every == 0:
            log.compact()

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
