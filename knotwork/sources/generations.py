"""A stored graph that grows by deltas and is compacted beside its readers and writers.

The folder has deltas (one a batch, named by its number), generations (the sum of a set of batches) and manifests.  Deltas and
generations hold each pair of nodes once; only readers turn it to both directions.  A manifest names a generation and every
batch that is in it; manifests are numbered, each is written whole under a name of its own and then renamed, and the newest
one counts.  So readers see either the graph before a compaction or after it, and a compaction that died leaves an unnamed
folder behind, which nothing reads.

A batch counts once: as part of the generation if the manifest has its number, and as its delta if not.  A batch that is replayed while or
after it was compacted writes a delta that the manifest makes readers ignore; replayed before that, it replaces its delta.
Training is additive, so the sum does not depend on when a compaction ran.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..plans.session import dealt

PAIR_SCHEMA = "u_type short, u_name string, v_type short, v_name string, mass10 long"
#: Tasks that the pairs of a node are dealt to when they are summed.
NEAR = 4


@dataclass(frozen=True)
class Manifest:
    number: int
    generation: str | None
    batches: frozenset[int]


class GraphLog:
    """Deltas, generations and manifests in one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        folder = self._at(f"{self.path}/{kind}")
        return [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def _complete(self, kind: str, name: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/{kind}/{name}/_SUCCESS"))

    def manifest(self) -> Manifest:
        """The newest manifest; without any, nothing is compacted."""
        numbers = [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]
        if not numbers:
            return Manifest(0, None, frozenset())
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{max(numbers):012d}.json").collect())
        found = json.loads(text)
        return Manifest(max(numbers), found["generation"], frozenset(found["batches"]))

    def add(self, features: DataFrame, batch: int) -> None:
        """Sum a batch; the same batch again replaces its delta."""
        self.add_pairs(G.pairs(features), batch)

    def add_pairs(self, pairs: DataFrame, batch: int) -> None:
        """The same for a batch that is summed (graph.pairs)."""
        _by_first(pairs).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")

    def deltas(self, manifest: Manifest) -> list[int]:
        """Batches that are complete and not in the manifest's generation."""
        return sorted(int(n) for n in self._names("deltas") if n.isdigit() and int(n) not in manifest.batches and self._complete("deltas", n))

    def _pairs(self, manifest: Manifest, batches: list[int]) -> DataFrame:
        parts = [f"{self.path}/deltas/{b}" for b in batches]
        if manifest.generation:
            parts.append(f"{self.path}/generations/{manifest.generation}")
        if not parts:
            return self.spark.createDataFrame([], PAIR_SCHEMA)
        found = self.spark.read.parquet(*parts).select(*G.PAIR, "mass10")  # parts of another kind are an error
        if len(parts) == 1:
            return found
        # each part is summed already, so that summing within tasks before pairs meet would take memory and save nothing; a node's
        # pairs are dealt to a few tasks, where they stay together and so take little, and a node of very many isn't in one task
        near = found.withColumn("_near", F.pmod(F.xxhash64("v_name"), F.lit(NEAR)))
        return dealt(near, *G.PAIR[:2], "_near").groupBy("_near", *G.PAIR).agg(F.sum("mass10").alias("mass10")).drop("_near")

    def current(self) -> DataFrame:
        """The graph as of now, in both directions: the newest generation and the deltas that are not in it."""
        m = self.manifest()
        return G.both(self._pairs(m, self.deltas(m)))

    def compact(self) -> Manifest:
        """Sum the deltas of now and the newest generation to a new one, and name it.  Returns the manifest that counts afterwards.

        If another compaction was named meanwhile, this one's result is left unnamed."""
        before = self.manifest()
        batches = self.deltas(before)
        if not batches:
            return before
        name = f"g{before.number + 1}-{uuid.uuid4().hex}"
        _by_first(self._pairs(before, batches)).write.parquet(f"{self.path}/generations/{name}")
        return self._publish(Manifest(before.number + 1, name, before.batches | frozenset(batches)))

    def _publish(self, m: Manifest) -> Manifest:
        body = json.dumps({"generation": m.generation, "batches": sorted(m.batches)})
        target, draft = self._at(f"{self.path}/manifests/{m.number:012d}.json"), self._at(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(draft)
        out.write(bytearray(body.encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):  # rename() does not replace a file
            self._fs.delete(draft, False)
        return self.manifest()

    def clean(self) -> list[str]:
        """Delete what no reader of the newest manifest needs: deltas that it has, and all other generations.  Returns what was deleted.

        Call it when no compaction runs and no reader of an older manifest is left."""
        m = self.manifest()
        gone = [f"deltas/{n}" for n in self._names("deltas") if n.isdigit() and int(n) in m.batches]
        gone += [f"generations/{n}" for n in self._names("generations") if n != m.generation]
        for g in gone:
            self._fs.delete(self._at(f"{self.path}/{g}"), True)
        return sorted(gone)


def _by_first(pairs: DataFrame) -> DataFrame:
    """Pairs as they are written: those of a node together, so that its name takes little."""
    return pairs.sortWithinPartitions(*G.PAIR[:2])
