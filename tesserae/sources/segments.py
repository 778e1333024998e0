"""Exchange of vectors between machines: segments that wait, are claimed, taken in or set aside; the metadata of builds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.sources.shared import SharedFiles

KINDS = {"paper": ["doc_id", "vec"], "chunk": ["paper_doc_id", "ord", "vec"]}
#: Names of the columns in older segments, and what they are called now.
OLD_NAMES = {"doc_ids": "doc_id", "ids": "doc_id", "paper_doc_ids": "paper_doc_id", "ords": "ord", "vecs": "vec", "emb": "vec"}
ROWS_A_FILE = 131_072
CLAIMED = ".ingesting"


def _half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, vectors, as bytes of half precision."""
    for rb in batches:
        packed = [None if v is None else np.asarray(v, np.float16).tobytes() for v in rb.column(rb.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*rb.columns[:-1], pa.array(packed, pa.binary())], names=rb.schema.names)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        vectors = [None if v is None else np.frombuffer(v, np.float16).astype(np.float32) for v in rb.column(rb.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*rb.columns[:-1], pa.array(vectors, pa.list_(pa.float32()))], names=rb.schema.names)


def write_segments(df: DataFrame, path: str, kind: str, half: bool = False) -> str:
    """Write a segment, a directory under path, and give its name; it is complete when its _SUCCESS is there.

    half keeps vectors in half precision. Files hold ROWS_A_FILE rows at most.
    """
    rows = df.select(F.lit(kind).alias("kind"), *KINDS[kind])
    if half:
        rows = rows.mapInArrow(_half, rows.drop("vec").schema.add("vec", "binary"))
    name = f"{kind}-{uuid.uuid4().hex}"
    rows.write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{path}/{name}")
    return name


def read_segments(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of one segment; rows of another kind are refused, older column names are understood."""
    df = spark.read.parquet(path)
    for old, new in OLD_NAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if "kind" in df.columns and df.where(F.col("kind") != kind).limit(1).count():
        raise ValueError(f"{path} holds segments of another kind than {kind}")
    if kind == "chunk" and "paper_doc_id" not in df.columns and "doc_id" in df.columns:
        df = df.withColumnRenamed("doc_id", "paper_doc_id")
    df = df.select(*KINDS[kind])
    return df.mapInArrow(_whole, df.drop("vec").schema.add("vec", T.ArrayType(T.FloatType()))) if dict(df.dtypes)["vec"] == "binary" else df


def waiting(spark: SparkSession, path: str, kind: str | None = None) -> list[str]:
    """Names of complete segments under path, sorted; those that a crash left claimed are among them."""
    files = SharedFiles(spark)
    return [n for n in files.names(path) if (n.split("-", 1)[0] in KINDS if kind is None else n.startswith(f"{kind}-")) and files.exists(f"{path}/{n}/_SUCCESS")]


@dataclass
class TakenIn:
    """What came of the segments: rows that resolved (chunk_id or paper_id, vec), names taken, set aside and failed."""

    rows: DataFrame | None = None
    taken: list[str] = field(default_factory=list)
    aside: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    unresolved: int = 0


def claim(spark: SparkSession, path: str, name: str) -> str | None:
    """Make a segment this process's own by renaming it; None if another has it. One that is claimed already is taken over."""
    if name.endswith(CLAIMED):
        return name
    return f"{name}{CLAIMED}" if SharedFiles(spark).rename(f"{path}/{name}", f"{path}/{name}{CLAIMED}") else None


def take_in(spark: SparkSession, path: str, kind: str, resolve, places: int, tries: int = 3) -> TakenIn:
    """Claim the waiting segments of a kind and resolve their rows.

    resolve(rows) gives (resolved, unresolved). Refused if the store has no places at all to resolve to, since every
    row would be lost. A segment of which nothing resolves is set aside under quarantine; one that cannot be read is
    tried again, then given back. Claimed segments stay until finish, so a crash loses nothing.
    """
    out, files = TakenIn(), SharedFiles(spark)
    names = waiting(spark, path, kind)
    if names and not places:
        raise RuntimeError("there is nothing yet that segments could belong to; they are left as they are")
    for name in names:
        mine = claim(spark, path, name)
        if mine is None:
            continue
        for left in range(tries - 1, -1, -1):
            try:
                resolved, unresolved = resolve(read_segments(spark, f"{path}/{mine}", kind))
                n, lost = resolved.count(), unresolved.count()
                break
            except Exception as e:
                if not left:
                    out.failed[name] = str(e)[:500]
                    files.rename(f"{path}/{mine}", f"{path}/{mine.removesuffix(CLAIMED)}")
        else:
            continue
        if not n and lost:
            files.rename(f"{path}/{mine}", f"{path}/quarantine/{mine.removesuffix(CLAIMED)}")
            out.aside.append(mine)
            continue
        out.unresolved += lost
        out.taken.append(mine)
        out.rows = resolved if out.rows is None else out.rows.unionByName(resolved)
    return out


def finish(spark: SparkSession, path: str, names: list[str]) -> None:
    """Delete segments whose rows are safely stored."""
    for n in names:
        SharedFiles(spark).delete(f"{path}/{n}")


def build_step(saved: dict, shards: int, mode: str) -> str:
    """'fresh', 'resume' or 'reshard' from the metadata of the last build; another mode is an error."""
    if not saved:
        return "fresh"
    if saved.get("mode") != mode:
        raise ValueError(f"the store was built in mode {saved.get('mode')}, not {mode}")
    return "resume" if saved.get("num_shards") == shards else "reshard"
