"""Incremental ingest as a stream of files: each batch is upserted into a versioned table; a restart goes on where it stopped."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.store import upsert
from tesserae.sources.shared import SharedFiles


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the session names; a temporary one only where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{base.rstrip('/')}/tesserae-{name}-{uuid.uuid4().hex}"


class VersionedTable:
    """A parquet table of one or more directories that a pointer file names; a new state is written beside the old one.

    A batch that comes again after a crash is recognised by its number and changes nothing. Directories that the pointer
    named before the last turn are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema, self.shared = spark, path, schema, SharedFiles(spark)

    @property
    def pointer(self) -> str:
        return f"{self.path}/current.json"

    def now(self) -> dict:
        return self.shared.read_json(self.pointer)

    def _turn(self, dirs: list[str], number: int) -> None:
        old = self.now()
        self.shared.write_json(self.pointer, {"dirs": dirs, "batch": number, "before": old.get("dirs", [])})
        for stale in set(old.get("before", [])) - set(dirs) - set(old.get("dirs", [])):
            self.shared.delete(f"{self.path}/{stale}")

    def read(self) -> DataFrame:
        dirs = self.now().get("dirs")
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{d}" for d in dirs)) if dirs else self.spark.createDataFrame([], self.schema)

    def upsert_batch(self, keys: list[str], *order: Column | str) -> Callable[[DataFrame, int], None]:
        def step(batch: DataFrame, number: int) -> None:
            if self.now().get("batch", -1) >= number:
                return
            name = f"v{number}"
            upsert(self.read(), batch, keys, *order).write.mode("overwrite").parquet(f"{self.path}/{name}")
            self._turn([name], number)

        return step

    def append_batch(self) -> Callable[[DataFrame, int], None]:
        """Add each batch's rows (for queries in append mode, whose rows are final)."""

        def step(batch: DataFrame, number: int) -> None:
            if self.now().get("batch", -1) >= number:
                return
            batch.write.mode("overwrite").parquet(f"{self.path}/v{number}")
            self._turn([*self.now().get("dirs", []), f"v{number}"], number)

        return step


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", timeout: int = 600) -> None:
    """Run a stream over all that is there and stop; called again with the same checkpoint it takes what is new."""
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(timeout):
            raise TimeoutError("the stream did not drain in time")
    finally:
        q.stop()


def file_stream(spark: SparkSession, pattern: str, schema: T.StructType, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(pattern)


def ended(stream: DataFrame, at: str, folder: str) -> DataFrame:
    """A stream with one row more, all null but for a time (column at) beyond any other.

    It moves the watermark past all windows, so that a stream which is drained gives its last windows as well and keeps
    no state; the row itself makes no window that is reported if rows without a key are left out.
    """
    spark = stream.sparkSession
    end = spark.range(1).select(*[(F.lit("9000-01-01 00:00:00") if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
    end.write.mode("overwrite").parquet(f"{folder}/end")
    return stream.unionByName(file_stream(spark, f"{folder}/en[d]", stream.schema))
