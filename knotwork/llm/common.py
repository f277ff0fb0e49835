"""What the operators of this subpackage share: table access, folds, batches and the checkpoint folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def use_checkpoints(spark: SparkSession) -> None:
    """The folder that the session names in spark.checkpoint.dir; a local one only in local mode, where all tasks share it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for a table that a later step reads."""
    use_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def per_batch(df: DataFrame, column: str, change: Callable[[list], tuple[list[bool], list]]) -> DataFrame:
    """The rows of a table whose column is changed or that are dropped: change() gets a bounded list of the
    column's values, and returns which rows stay and their new values.  All other columns pass unseen."""
    limit = BATCH_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(column)
            values = batch.column(k).to_pylist()
            at = size = 0
            for i in range(len(values) + 1):
                n = len(values[i] or "") if i < len(values) else 0
                if i > at and (i == len(values) or size + n > limit):
                    stay, new = change(values[at:i])
                    columns = [*batch.slice(at, i - at).columns]
                    columns[k] = pa.array(new, type=batch.schema.field(k).type)
                    yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(stay))
                    at, size = i, 0
                size += n

    return df.mapInArrow(run, df.schema)


def rows_by_bytes(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = BATCH_BYTES) -> Iterator[list[tuple]]:
    """Lists of row tuples of at most `limit` characters of text (or one longer row), in column order."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        k = batch.schema.get_field_index(text_col)
        out, size = [], 0
        for row in zip(*columns, strict=True):
            n = len(row[k] or "")
            if out and size + n > limit:
                yield out
                out, size = [], 0
            out.append(row)
            size += n
        if out:
            yield out


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def arrow_batch(columns: dict[str, tuple[list | np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))
