"""Archives of markup files: listing, manifests, members, counts."""

from __future__ import annotations

import lzma
import os
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import materialize
from tesserae.sources.xml import parse_members

# Endings of archives, in the order in which a bare name is tried, and of members.
ARCHIVE_ENDINGS = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")
MEMBER_ENDINGS = (".nxml", ".xml")


def is_archive(name: str) -> bool:
    return name.lower().endswith(ARCHIVE_ENDINGS)


def is_compressed(name: str) -> bool:
    return is_archive(name) and not name.lower().endswith(".tar")


def list_archives(directory: str) -> list[str]:
    """Archives directly in a directory, by name."""
    return sorted(e.path for e in os.scandir(directory) if e.is_file() and is_archive(e.name))


def read_manifest(path: str, base: str | None = None) -> tuple[list[str], list[str]]:
    """(archives, unresolved) of a manifest: a line each, # begins a comment; names are absolute or relative to base
    (the manifest's directory); a name that is no archive's is tried with each ending; each archive once, first place."""
    base = base or os.path.dirname(os.path.abspath(path))
    with open(path, encoding="utf-8") as f:
        names = [n for n in (line.split("#", 1)[0].strip() for line in f) if n]
    found: dict[str, None] = {}
    missing = []
    for name in names:
        at = name if os.path.isabs(name) else os.path.join(base, name)
        tries = [at] if is_archive(at) else [at + e for e in ARCHIVE_ENDINGS]
        hit = next((os.path.realpath(t) for t in tries if os.path.isfile(t)), None)
        if hit:
            found[hit] = None
        else:
            missing.append(name)
    return list(found), missing


#: What reading a damaged archive may raise.
FAULTS = (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError, ValueError)
#: Rows and bytes of a batch of members.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20
_KINDS = {"tar": pa.string(), "member": pa.string(), "size": pa.int64(), "mtime": pa.float64(), "member_seq": pa.int64(), "at": pa.int64(), "fault": pa.string(), "content": pa.binary()}


def opened(path: str):
    """A file of any file system, open for reading from any place."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def created(path: str):
    """A new file of any file system, open for writing; its directory is made."""
    from pyarrow import fs

    system, name = (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return system.open_output_stream(name, compression=None)


def _walk(path: str, content: bool, endings: tuple[str, ...]) -> Iterator[tuple]:
    """(tar, member, size, mtime, member_seq, at, fault, content) of the members of an archive, then a row for its fault.

    A compressed archive is decompressed as a stream and never held; of an uncompressed one the headers are read and
    contents skipped, at is where each begins.
    """
    name, seq = os.path.basename(path), 0
    packed = is_compressed(path)
    try:
        with opened(path) as f, tarfile.open(fileobj=f, mode="r|*" if packed else "r:") as t:
            for m in t:
                if m.isfile() and m.name.lower().endswith(endings):
                    yield name, m.name, m.size, float(m.mtime), seq, m.offset_data, None, t.extractfile(m).read() if content and packed else None
                    seq += 1
                t.members = []  # nothing is kept of what was passed
    except FAULTS as e:
        yield name, None, None, None, seq, None, f"{type(e).__name__}: {e}"[:500], None


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1] or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for n, c in zip(names, zip(*held, strict=True), strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for n, c in zip(names, zip(*held, strict=True), strict=True)], names=names)


def _scan(content: bool, endings: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for path in rb.column(0).to_pylist():
                for b in _batches(_walk(path, content, endings), list(_KINDS)):
                    yield b.append_column("path", pa.array([path] * b.num_rows, pa.string()))

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of members (path, tar, ..., at) of uncompressed archives, read from their places."""
    names = ["tar", "member", "size", "mtime", "member_seq", "fault", "content"]

    def rows() -> Iterator[tuple]:
        path, f = None, None
        try:
            for rb in batches:
                for p, tar, member, size, mtime, seq, at in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                    try:
                        if p != path:
                            if f is not None:
                                f.close()
                            path, f = p, opened(p)
                        f.seek(at)
                        data = f.read(size)
                        if len(data) < size:
                            raise EOFError(f"{member} breaks off")
                        yield tar, member, size, mtime, seq, None, data
                    except FAULTS as e:
                        yield tar, None, None, None, seq, f"{type(e).__name__}: {e}"[:500], None
        finally:
            if f is not None:
                f.close()

    yield from _batches(rows(), names)


def scan_archives(spark: SparkSession, paths: list[str] | str, content: bool = True, endings: tuple[str, ...] = MEMBER_ENDINGS, a_task: int = 512) -> DataFrame:
    """(tar, member, size, mtime, member_seq, fault, content) of the markup files in archives, and a row with a null
    member and a fault for each archive that is damaged; what came before the fault is there as well.

    member_seq counts from 0. Archives are opened where they are read, by path, and may be of any size: a compressed
    one is decompressed as a stream in one task, as it demands; of an uncompressed one the headers are read first, by
    skipping from one to the next, and its members are then dealt to tasks by their places, a_task to each.
    """
    listed = sorted({p for p in ([paths] if isinstance(paths, str) else paths) if is_archive(p)})
    names = "tar string, member string, size long, mtime double, member_seq long, fault string" + (", content binary" if content else "")
    if not listed:
        return spark.createDataFrame([], names)

    def walk(some: list[str], whole: bool) -> DataFrame:
        rows = spark.createDataFrame([(p,) for p in some], "path string").repartition(len(some))
        return rows.mapInArrow(_scan(whole, endings), "tar string, member string, size long, mtime double, member_seq long, at long, fault string, content binary, path string")

    cols = [c.split()[0] for c in names.split(", ")]
    packed, plain = [p for p in listed if is_compressed(p)], [p for p in listed if not is_compressed(p)]
    out = []
    if packed:
        out.append(walk(packed, content).select(*cols))
    if plain and not content:
        out.append(walk(plain, False).select(*cols))
    elif plain:
        heads = materialize(walk(plain, False).drop("content"))
        n = heads.count()
        places = heads.where("fault IS NULL").select("path", "tar", "member", "size", "mtime", "member_seq", "at")
        # neighbours in an archive are read one after another
        dealt = places.repartitionByRange(max(1, n // a_task), "path", "at").sortWithinPartitions("path", "at")
        out.append(dealt.mapInArrow(_fetch, names))
        out.append(heads.where("fault IS NOT NULL").withColumn("content", F.lit(None).cast("binary")).select(*cols))
    first = out[0]
    for more in out[1:]:
        first = first.unionByName(more)
    return first


def read_members(spark: SparkSession, paths: list[str] | str, content: bool = True, endings: tuple[str, ...] = MEMBER_ENDINGS) -> DataFrame:
    """(tar, member, size, mtime, member_seq, content) of the markup files in archives; faults are left to archive_faults."""
    return scan_archives(spark, paths, content, endings).where("fault IS NULL").drop("fault")


def archive_faults(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(tar, members, fault): damaged archives, how many markup files came before the fault, and what it was."""
    return scan_archives(spark, paths, content=False).where("fault IS NOT NULL").select("tar", F.col("member_seq").alias("members"), "fault")


def member_counts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(tar, n): markup files of each archive; contents of uncompressed ones are skipped."""
    return read_members(spark, paths, content=False).groupBy("tar").agg(F.count("*").alias("n"))


def read_articles(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(tar, member, size, mtime, member_seq, fault, doc_id, article): parsed members; article is null where parsing
    failed, and, with doc_id and member, in the rows of archives' faults."""
    return parse_members(scan_archives(spark, paths)).withColumn("doc_id", member_uri(F.col("tar"), F.col("member")))


def member_uri(tar, member):
    return F.concat(F.lit("tar://"), tar, F.lit("!/"), member)
