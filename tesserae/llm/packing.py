"""Items of varying length laid into containers of fixed capacity.

Items above a third of the capacity fit at most two to a container: each, from the largest down, takes the largest
other that still fits. Smaller items, from the largest down, go where the least room is left that holds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.store import numbered
from tesserae.session import materialize


class _Room:
    """Open containers by the room left; the tightest that holds a size is found with one bit scan."""

    def __init__(self, capacity: int):
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def put(self, room: int, box: int) -> None:
        self.at[room].append(box)
        self.bits |= 1 << room

    def tightest(self, size: int) -> int:
        rest = self.bits >> size
        return size + (rest & -rest).bit_length() - 1 if rest else -1

    def largest_up_to(self, size: int) -> int:
        return (self.bits & ((1 << (size + 1)) - 1)).bit_length() - 1

    def take(self, room: int) -> int:
        box = self.at[room].pop()
        if not self.at[room]:
            self.bits &= ~(1 << room)
        return box


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and start of each item; sizes are from 0 to capacity. Ties keep the order of the items."""
    n = len(sizes)
    box, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable").tolist()
    size = sizes.tolist()
    used = 0
    room = _Room(capacity)
    large = [i for i in order if 3 * size[i] > capacity]
    waiting = _Room(capacity)  # large items not placed, by size
    for i in reversed(large):
        waiting.put(size[i], i)
    placed = np.zeros(n, bool)
    for i in large:
        if placed[i]:
            continue
        got = waiting.take(size[i])
        if got != i:  # another of the same size stands for it
            i = got
        placed[i] = True
        box[i], left = used, capacity - size[i]
        mate = waiting.largest_up_to(left)
        if mate >= 0:
            j = waiting.take(mate)
            placed[j] = True
            box[j], start[j], left = used, size[i], left - mate
        room.put(left, used)
        used += 1
    for i in order[len(large) :]:
        r = room.tightest(size[i])
        if r < 0:
            b, r = used, capacity
            used += 1
        else:
            b = room.take(r)
        box[i], start[i] = b, capacity - r
        room.put(r - size[i], b)
    return box, start


def fill_containers(df: DataFrame, size: str, capacity: int, a_shard: int = 50_000) -> DataFrame:
    """df with piece (int), container (long), start and length (int): every item's container and place in it.

    An item is cut only if it alone exceeds the capacity: into full containers of its own and a rest that is packed
    like an item (piece counts from 0). Sizes null or negative count as 0; items of size 0 get a container and a place
    as well. Repeated rows are items of their own. An empty table gives no rows. Columns of df with the new names are
    dropped.

    Items are numbered in the order of a hash of their rows and dealt in turn to shards of a_shard items at most, each
    packed in one task, so hot keys and repeated rows spread evenly and the same rows give the same containers however
    they come. Each shard leaves a few containers unfilled at most.
    """
    new = ("piece", "container", "start", "length")
    keep = [c for c in df.columns if c not in new]
    src = df.select(*[f"`{c}`" for c in keep], F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("__size"))
    schema = df.select(*[f"`{c}`" for c in keep]).schema
    for name, kind in zip(new, (T.IntegerType(), T.LongType(), T.IntegerType(), T.IntegerType()), strict=True):
        schema = schema.add(name, kind)

    def packed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes, shard = t.column("__size").to_numpy(), t.column("__shard")[0].as_py()
        full, rest = sizes // capacity, sizes % capacity
        own = (rest == 0) & (full > 0)  # an exact multiple has no rest
        rows = np.flatnonzero(~own)
        box, start = pack(rest[rows], capacity)
        used = int(box.max()) + 1 if len(box) else 0
        n_full = int(full.sum())
        row = np.concatenate([np.repeat(np.arange(len(sizes)), full), rows])
        piece = np.concatenate([np.arange(n_full) - np.repeat(np.cumsum(full) - full, full), full[rows]])
        box = np.concatenate([used + np.arange(n_full), box]) + (np.int64(shard) << np.int64(32))
        start = np.concatenate([np.zeros(n_full, np.int64), start])
        length = np.concatenate([np.full(n_full, capacity), rest[rows]])
        out = t.drop_columns(["__size", "__shard"]).take(pa.array(row))
        for name, x, kind in (("piece", piece, pa.int32()), ("container", box, pa.int64()), ("start", start, pa.int32()), ("length", length, pa.int32())):
            out = out.append_column(name, pa.array(x.astype(kind.to_pandas_dtype())))
        yield from out.to_batches(max_chunksize=10000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rb in batches:
            shard = rb.column(rb.num_columns - 1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and a < b and held[-1].column(rb.num_columns - 1)[0].as_py() != shard[a]:
                    yield from packed(pa.Table.from_batches(held))
                    held = []
                if a < b:
                    held.append(rb.slice(a, b - a))
        if held:
            yield from packed(pa.Table.from_batches(held))

    # ranges are found by a look at the rows, which must not work out their sizes twice
    placed = numbered(materialize(src).withColumn("__hash", F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in src.columns])), ["__hash", "__size"], "__n")
    shards = max(1, -(-(placed.agg(F.max("__n")).first()[0] or 0) // a_shard))
    dealt = placed.withColumn("__shard", F.pmod("__n", F.lit(shards)).cast("int"))
    ordered = dealt.repartition(shards, "__shard").sortWithinPartitions("__shard", "__n").drop("__hash", "__n")
    return ordered.mapInArrow(run, schema)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, least (the containers that the tokens need at least), and the share filled."""
    per = packed.groupBy("container").agg(F.sum("length").cast("long").alias("n"))
    return per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).select(
        "containers",
        "tokens",
        F.ceil(F.col("tokens") / capacity).alias("least"),
        F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)).alias("filled"),
    )
