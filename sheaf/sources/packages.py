"""A5: office packages (zip files) -> member rows, and member rows -> packages.

The only step that needs Python: the standard library opens the zips in tasks. Everything downstream is native Spark.

Packages of any size go through ``member_directory`` and ``stream_members``: tasks first read only the central
directories (a light row per member), Spark then deals the members out by package and region, and tasks read them one at a
time from the open file; a package is never held whole. ``write_packages`` is the way back: members in order
stream into a new zip beside the target, which it replaces in one move, so a retried or lost task leaves
no half-written package. Files are opened through Arrow's file systems (local, HDFS, S3, GCS).

``read_members`` unzips bytes that Spark has already read (``binary_files``), for small packages in any store that
only Spark's readers open.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_SCHEMA = ("path string, member_ix int, member string, content string, raw binary, readable boolean")
PACKAGE_SCHEMA = "path string, size_bytes long, is_zip boolean, readable boolean"


DIRECTORY_SCHEMA = ("path string, size_bytes long, is_zip boolean, readable boolean, member_ix int, member string, "
                    "member_bytes long, at long")
STREAM_SCHEMA = "path string, member_ix int, member string, part int, content string, raw binary, readable boolean"
REGION_BYTES = 64 << 20
"""Members of one region of a package are read by one task."""
PART_BYTES = 16 << 20
"""Other members than text come in parts of this size."""
BATCH_BYTES = 8 << 20
TEXT_SUFFIXES = (".xml", ".rels")
BROKEN = (zipfile.BadZipFile, OSError, EOFError, RuntimeError, NotImplementedError)


def file_of(path: str):
    """(file system, path within it) of a URI as Spark writes it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Seekable:
    """An Arrow file whose seeks fail as those of other files do."""

    def __init__(self, file):
        self.file = file

    def seek(self, *where):
        try:
            return self.file.seek(*where)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e

    def __getattr__(self, name):
        return getattr(self.file, name)


def _batched(rows: Iterable[tuple], schema: str, weight) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each closed at BATCH_BYTES."""
    of = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = pa.schema([(name, of[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES or len(held) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.types)], schema=kinds)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.types)], schema=kinds)


def package_files(spark: SparkSession, paths, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, length of files; their bytes are not read."""
    return binary_files(spark, paths, glob, recursive).select("path", "length")


def member_directory(files: DataFrame) -> DataFrame:
    """A row per member from the central directories of ``files`` (path, length); one with a null member for a file that is
    no zip, cannot be opened or is empty."""
    def listed(path, length):
        try:
            fs, name = file_of(path)
            with fs.open_input_file(name) as opened:
                f = _Seekable(opened)
                if not zipfile.is_zipfile(f):
                    yield path, length, False, True, None, None, None, None
                    return
                f.seek(0)
                with zipfile.ZipFile(f) as z:
                    infos = z.infolist()
                    if not infos:
                        yield path, length, True, True, None, None, None, None
                    for ix, i in enumerate(infos):
                        yield path, length, True, True, ix, i.filename, i.file_size, i.header_offset
        except BROKEN:
            yield path, length, True, False, None, None, None, None

    def run(batches):
        return _batched((r for b in batches for x in zip(*(c.to_pylist() for c in b.columns)) for r in listed(*x)), DIRECTORY_SCHEMA,
                        lambda r: 200)

    return files.select("path", "length").mapInArrow(run, DIRECTORY_SCHEMA)


def directory_packages(directory: DataFrame) -> DataFrame:
    """path, size_bytes, is_zip, readable: the packages of a member directory."""
    return directory.select("path", "size_bytes", "is_zip", "readable").distinct()


def member_parts(path: str, members: list[tuple[int, str]], part_bytes: int = PART_BYTES) -> Iterator[tuple]:
    """Rows (STREAM_SCHEMA) of some members of a package, one open member at a time."""
    fs, name = file_of(path)
    with fs.open_input_file(name) as f, zipfile.ZipFile(_Seekable(f)) as z:
        infos = z.infolist()
        for ix, member in members:
            try:
                if member.endswith(TEXT_SUFFIXES) or infos[ix].file_size <= part_bytes:
                    raw = z.read(infos[ix])
                    try:
                        yield path, ix, member, 0, raw.decode("utf-8"), raw, True
                    except UnicodeDecodeError:
                        yield path, ix, member, 0, None, raw, False
                    continue
                with z.open(infos[ix]) as open_member:
                    part = 0
                    while raw := open_member.read(part_bytes):
                        yield path, ix, member, part, None, raw, False
                        part += 1
            except BROKEN:
                yield path, ix, member, 0, None, None, False


def stream_members(directory: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Members of a directory with their bytes: path, member_ix, member, part, content, raw, readable.

    Text members (.xml, .rels) and small ones are one row, others have a row per ``part_bytes``; ``content`` is the text
    of a whole member that is UTF-8. A member that cannot be read has null bytes.
    """
    def run(batches):
        def rows():
            at, held = None, []
            for b in batches:
                for path, ix, member in zip(*(c.to_pylist() for c in b.columns)):
                    if path != at:
                        if held:
                            yield from member_parts(at, held, part_bytes)
                        at, held = path, []
                    held.append((ix, member))
            if held:
                yield from member_parts(at, held, part_bytes)
        return _batched(rows(), STREAM_SCHEMA, lambda r: 2 * len(r[5] or b"") + 200)

    region = F.floor(F.col("at") / F.lit(REGION_BYTES))
    dealt = directory.where("member is not null").select("path", "member_ix", "member", region.alias("region"))
    return dealt.repartition("path", "region").sortWithinPartitions("path", "member_ix").select(
        "path", "member_ix", "member").mapInArrow(run, STREAM_SCHEMA)


WRITTEN_SCHEMA = "path string, target string, members long, size_bytes long"


def write_packages(members: DataFrame, folder: str) -> DataFrame:
    """Writes packages of member rows (path, member_ix, member, content_out, and part if members come in several) to ``folder``
    under the last step of their paths; returns path, target, members, size_bytes. Nothing is written before an action.

    A task holds one part at a time. Paths must differ in their last step. A package is moved to its place when it is whole.
    """
    def run(batches):
        def rows():
            at, fs, temp, target, zipped, entry, entry_at, n = None, None, None, None, None, None, None, 0

            def close():
                if entry is not None:
                    entry.close()
                zipped.close()
                out.close()
                fs.move(temp, target)
                return at, f"{folder.rstrip('/')}/{at.rsplit('/', 1)[-1]}", n, fs.get_file_info(target).size

            out = None
            for b in batches:
                for path, ix, member, raw in zip(*(c.to_pylist() for c in b.columns)):
                    if path != at:
                        if at is not None:
                            yield close()
                        at, n, entry, entry_at = path, 0, None, None
                        fs, base = file_of(folder)
                        fs.create_dir(base, recursive=True)
                        target = f"{base.rstrip('/')}/{path.rsplit('/', 1)[-1]}"
                        temp = f"{base.rstrip('/')}/_{uuid.uuid4().hex}.tmp"
                        out = fs.open_output_stream(temp)
                        zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    if ix != entry_at:
                        if entry is not None:
                            entry.close()
                        info = zipfile.ZipInfo(member)  # a fixed date: the same members give the same bytes
                        info.compress_type = zipfile.ZIP_DEFLATED
                        entry, entry_at, n = zipped.open(info, "w", force_zip64=True), ix, n + 1
                    entry.write(raw or b"")
            if at is not None:
                yield close()
        return _batched(rows(), WRITTEN_SCHEMA, lambda r: 200)

    part = F.col("part") if "part" in members.columns else F.lit(0)
    rows = members.select("path", "member_ix", "member", F.col("content_out").cast("binary").alias("raw"), part.alias("part"))
    return rows.repartition("path").sortWithinPartitions("path", "member_ix", "part").select(
        "path", "member_ix", "member", "raw").mapInArrow(run, WRITTEN_SCHEMA)


def _members(batches):
    for pdf in batches:
        out = []
        for path, data in zip(pdf["path"], pdf["content"]):
            data = bytes(data)
            if not zipfile.is_zipfile(io.BytesIO(data)):
                continue
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for ix, name in enumerate(z.namelist()):
                        try:
                            raw = z.read(name)
                        except (zipfile.BadZipFile, OSError, EOFError, RuntimeError):
                            out.append((path, ix, name, None, None, False))
                            continue
                        try:
                            text, ok = raw.decode("utf-8"), True
                        except UnicodeDecodeError:
                            text, ok = None, False
                        out.append((path, ix, name, text, raw, ok))
            except (zipfile.BadZipFile, OSError, EOFError):
                continue
        yield pd.DataFrame(out, columns=["path", "member_ix", "member", "content", "raw", "readable"])


def _packages(batches):
    for pdf in batches:
        rows = []
        for path, data, length in zip(pdf["path"], pdf["content"], pdf["length"]):
            data = bytes(data)
            is_zip = zipfile.is_zipfile(io.BytesIO(data))
            readable = True
            if is_zip:
                # Opening must work; a member that fails to read is skipped later, not fatal.
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        z.namelist()
                except (zipfile.BadZipFile, OSError, EOFError):
                    readable = False
            rows.append((path, int(length), is_zip, readable))
        yield pd.DataFrame(rows, columns=["path", "size_bytes", "is_zip", "readable"])


def binary_files(spark: SparkSession, paths, glob: str | None = None, recursive: bool = True) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(paths)


def read_members(files: DataFrame) -> DataFrame:
    """``files`` from ``binary_files``: ``path, content`` -> one row per zip member."""
    return files.select("path", "content").mapInPandas(_members, MEMBER_SCHEMA)


def read_packages(files: DataFrame) -> DataFrame:
    """One row per file: size, whether it is a zip, whether every member reads."""
    return files.select("path", "content", "length").mapInPandas(_packages, PACKAGE_SCHEMA)


def discover(spark: SparkSession, root: str, extensions, recursive: bool = True) -> DataFrame:
    """Files under ``root`` whose suffix (case-insensitive) is supported,
    sorted by path. ``content`` is not selected, so the bytes are never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    sfx = F.lower(F.regexp_extract(F.col("path"), r"(\.[^./\\]+)$", 1))
    return (df.select("path", "length", "modificationTime").where(sfx.isin(*extensions)).orderBy("path"))
