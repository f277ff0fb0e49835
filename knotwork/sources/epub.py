"""EPUB archives: members of archives as ordered rows, chapters by file name, paragraphs in order; and archives made of rows.

An archive is a row (path, content), as the binaryFile source gives it or as a table holds it.  The task that has it reads its
directory only and hands on the wanted members as they lie there, compressed; members are then dealt by archive and file, and
inflated, decoded and parsed where they arrive, so that a set of few large books is spread over all tasks.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import format_fragment, select

# Which files hold chapters, in the three kinds of archive.
SECTIONS = r"^OPS/sec_(\d+)_(\d+)\.xml$"
PARTS = r"^OEBPS/part(\d+)\.xhtml$"
ANY_TEXT = r"^.*\.x?html?$"
#: Bytes of members that are handed on at once.
BATCH = 8 << 20
#: Pages whose paragraphs are Python objects at once.
PAGES = 64
RAW = pa.schema([("archive", pa.string()), ("file", pa.string()), ("kind", pa.int32()), ("crc", pa.int64()), ("raw", pa.binary())])
HTML = pa.schema([("archive", pa.string()), ("file", pa.string()), ("html", pa.string())])
_DAY = (1980, 1, 1, 0, 0, 0)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of archives in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def members(archives: DataFrame, pattern: str, partitions: int | None = None) -> DataFrame:
    """(archive, file, html): wanted members of archives (path, content), dealt by archive and file.

    Null contents have none; an archive that can't be read fails, and so does a member whose checksum is wrong."""
    wanted = re.compile(pattern)

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, content in zip(rows["path"], rows["content"], strict=True):
                if not content.is_valid:
                    continue
                out, held, content = [], 0, content.as_buffer()
                with zipfile.ZipFile(pa.BufferReader(content)) as z:
                    for m in z.infolist():
                        if wanted.match(m.filename):
                            raw = _raw(content, m)
                            out.append((name.as_py(), m.filename, m.compress_type, m.CRC, raw))
                            held += len(raw)
                            if held > BATCH:
                                yield _batch(out, RAW)
                                out, held = [], 0
                if out:
                    yield _batch(out, RAW)

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out, held = [], 0
            for archive, *member in zip(*[rows[c] for c in RAW.names], strict=True):
                file, kind, crc, raw = (x.as_py() for x in member)
                html = _inflated(file, kind, crc, raw)
                out.append((archive.as_py(), file, html))
                held += len(html)
                if held > BATCH:
                    yield _batch(out, HTML)
                    out, held = [], 0
            if out:
                yield _batch(out, HTML)

    found = archives.select("path", "content").mapInArrow(directory, "archive string, file string, kind int, crc long, raw binary")
    spread = found.repartition(partitions, "archive", "file") if partitions else found.repartition("archive", "file")
    return spread.mapInArrow(inflate, "archive string, file string, html string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _raw(content: pa.Buffer, m: zipfile.ZipInfo) -> bytes:
    """A member as it lies in its archive, behind its local header."""
    names, extra = struct.unpack_from("<HH", content, m.header_offset + 26)
    at = m.header_offset + 30 + names + extra
    return content[at : at + m.compress_size].to_pybytes()


def _inflated(file: str, kind: int, crc: int, raw: bytes) -> str:
    if kind not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"{file}: compressed in an unknown way ({kind})")
    data = zlib.decompress(raw, -15) if kind == zipfile.ZIP_DEFLATED else raw
    if zlib.crc32(data) != crc:
        raise ValueError(f"{file}: wrong checksum")
    return data.decode("utf-8", "replace")


def archive_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(archive, file, html): the files of archives in a folder whose names match."""
    return members(read_archives(spark, path), pattern)


def pack(files: DataFrame) -> DataFrame:
    """(path, content): archives made of rows (archive, file, html), their members in the order of their names.

    A task builds one archive after another and holds one of them; of equal names the last one read counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, z = None, io.BytesIO(), None

        def done() -> pa.RecordBatch:
            z.close()
            return pa.RecordBatch.from_pydict({"path": pa.array([name], pa.string()), "content": pa.array([held.getvalue()], pa.binary())})

        for rows in batches:
            for archive, file, html in zip(rows["archive"], rows["file"], rows["html"], strict=True):
                archive, file, html = archive.as_py(), file.as_py(), html.as_py()
                if archive != name:
                    if z is not None:
                        yield done()
                    name, held = archive, io.BytesIO()
                    z = zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED)
                info = zipfile.ZipInfo(file, _DAY)
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, (html or "").encode())
        if z is not None:
            yield done()

    return files.select("archive", "file", "html").repartition("archive").sortWithinPartitions("archive", "file").mapInArrow(run, "path string, content binary")


def volume(number: Column) -> Column:
    """Volume of a part by its number; null for front and back matter."""
    # Where the volumes of the series begin.
    return F.when(number < 4, F.lit(None)).when(number < 39, 1).when(number < 186, 2).when(number < 246, 3).cast("int")


def numbers(file: Column, pattern: str) -> Column:
    """The numbers in a member's name, by which it is ordered."""
    groups = re.compile(pattern).groups
    return F.array(*[F.regexp_extract(file, pattern, k + 1).cast("int") for k in range(groups)])


def parsed(pages: pa.StringArray, accept: list[tuple]) -> pa.Array:
    """Lists of (class, text) of a column of HTML; a few pages at a time are Python objects."""
    out = []
    for k in range(0, max(1, len(pages)), PAGES):
        classes, texts, ends = [], [], [0]
        for h in pages[k : k + PAGES]:
            for _, a, inner in select(h.as_py() or "", accept):
                classes.append(a.get("class"))
                texts.append(" ".join(format_fragment(inner).text.split()))
            ends.append(len(texts))
        both = pa.StructArray.from_arrays([pa.array(classes, pa.string()), pa.array(texts, pa.string())], ["class", "text"])
        out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both))
    return pa.concat_arrays(out)


def paragraphs(files: DataFrame, tags: tuple[str, ...] = ("p",)) -> DataFrame:
    """(archive, file, pos, class, text): paragraphs as formatted text, with (file, pos) as their order."""
    accept = [(t, None, None) for t in tags]

    @F.arrow_udf("array<struct<class:string,text:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in batches:
            yield parsed(s, accept)

    return files.select("archive", "file", F.posexplode(run("html")).alias("pos", "p")).select("archive", "file", "pos", F.col("p.class").alias("class"), F.col("p.text").alias("text"))
