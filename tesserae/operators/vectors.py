"""Exact nearest neighbours of a stated set of query vectors, as products of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def usable(df: DataFrame, key: str, vector: str, width: int, *also: str) -> DataFrame:
    """(id, v): one row for each id whose vector is width long, without null, NaN or infinite values, and not all zero.

    Of several different vectors of an id the least in array order counts.
    """
    v = F.col(vector)
    ok = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(ok, F.lit(False)) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id"), *also).agg(F.min(v.cast("array<float>")).alias("v"))


def unit_rows(v: pa.Array, width: int) -> np.ndarray:
    """Vectors of an Arrow list column at length one."""
    x = np.asarray(v.flatten(), np.float64).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spans(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of rows in which no column changes."""
    cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
    return zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(columns[0])]]), strict=True)


def _pack(width: int):
    """Blocks of (ids, unit vectors) from rows (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            x, ids = unit_rows(rb.column(1), width), rb.column(0).to_numpy()
            for s in range(0, len(ids), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([ids[s : s + BLOCK].tobytes()]), pa.array([x[s : s + BLOCK].tobytes()])], names=["ids", "m"])

    return run


def packed(df: DataFrame, width: int) -> DataFrame:
    """(ids binary, m binary): rows (id, v) in blocks of BLOCK at most."""
    return df.select("id", "v").mapInArrow(_pack(width), "ids binary, m binary")


#: Products of vectors that a task holds at a time.
PRODUCTS = 1 << 21
#: Similarities rounded to 9 places that differ by more are in the order of the unrounded ones.
CLOSE = 2e-9


def k_best(sim: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity to 9 places) of the k greatest of each row, of equal ones the first columns; those below a row's floor may be left out."""
    n, least = sim.shape[1], floor
    if floor is None:
        least = np.partition(sim, n - k, axis=1)[:, n - k] if n > k else np.full(len(sim), -np.inf)
    keep = sim >= (least - CLOSE)[:, None]
    found = keep.sum(1)
    if floor is None:  # ties, or no number
        odd = np.flatnonzero(found != min(k, n))
        best = np.argsort(-np.round(sim[odd], 9), axis=1, kind="stable")[:, :k]
        at, best = np.repeat(odd, best.shape[1]), best.ravel()
    else:
        odd = np.flatnonzero(found > k)
        at, best, _ = k_best(sim[odd], k) if len(odd) else (odd, odd, None)
        at = odd[at] if len(odd) else odd
    keep[odd] = False
    keep[at, best] = True
    r, c = np.nonzero(keep)
    return r, c, np.round(sim[r, c], 9)


def _best(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for qi, qm, ci, cm in zip(*(rb.column(c).to_pylist() for c in range(4)), strict=True):
                q, c = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                x, y = np.frombuffer(qm, np.float64).reshape(-1, width), np.frombuffer(cm, np.float64).reshape(-1, width)
                # of equal similarities the smaller ids stay
                order = np.argsort(c, kind="stable")
                c, y = c[order], y[order]
                step = max(1, PRODUCTS // len(c))
                for s in range(0, len(q), step):
                    r, best, score = k_best(x[s : s + step] @ y.T, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q[s + r]), pa.array(c[best]), pa.array(score)], names=["qid", "id", "score"])

    return run


def topk(queries: DataFrame, corpus: DataFrame, k: int, width: int, skip_self: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k most similar rows of corpus (id, v) to each query (id, v); rank from 0.

    Scores are cosines rounded to 9 places; ties go to the smaller id. The stated queries meet all rows in blocks: each
    pair of blocks is one matrix product that keeps the k best of a query, and only those are shuffled.
    """
    extra = 1 if skip_self else 0
    q, c = packed(queries, width), packed(corpus, width)
    met = q.select(F.col("ids").alias("qi"), F.col("m").alias("qm")).crossJoin(c.select(F.col("ids").alias("ci"), F.col("m").alias("cm")))
    return _ranked(met.mapInArrow(_best(k + extra, width), "qid long, id long, score double"), k, skip_self)


#: A list's queries are dealt to a cell for every SHARE of its rows, and its rows to one for every HELD of them.
SHARE, HELD = 4096, 1 << 16


def in_cells(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(cell, side, ...): rows (list, id, ...) and queries of the same columns, sorted by cell and side in a task: rows (0), then queries (1).

    Each query meets each row of its list in one cell.
    """
    share = lambda most: F.ceil(F.count("*") / most).cast("int")
    parts = F.broadcast(rows.groupBy("list").agg(share(SHARE).alias("qn"), share(HELD).alias("cn")))
    cell = F.shiftleft(F.shiftleft(F.col("list").cast("long"), 16) + F.col("qs"), 16) + F.col("cs")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    more = [c for c in rows.columns if c != "list"]
    q = queries.join(parts, "list").select("list", own("qn").alias("qs"), every("cn").alias("cs"), F.lit(1).alias("side"), *more)
    c = rows.join(parts, "list").select("list", every("qn").alias("qs"), own("cn").alias("cs"), F.lit(0).alias("side"), *more)
    return c.unionByName(q).select(cell.alias("cell"), "side", *more).repartition("cell").sortWithinPartitions("cell", "side")


def _in_lists(k: int, width: int):
    """(qid, id, score) of the k best of each cell, from (cell, side, id, v, floor) sorted by cell and side: rows first, then queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, c, y = None, [], None, None
        for rb in batches:
            if not rb.num_rows:
                continue
            cell, side, ids = (rb.column(i).to_numpy() for i in range(3))
            x, floor = unit_rows(rb.column(3), width), rb.column(4).to_numpy()
            for a, b in spans(cell, side):
                if not side[a]:
                    if at != cell[a]:
                        at, held = cell[a], []
                    held.append((ids[a:b], x[a:b]))
                    c = None
                elif at == cell[a]:
                    if c is None:
                        c, y = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                        order = np.argsort(c, kind="stable")
                        c, y = c[order], y[order]
                    step = max(1, PRODUCTS // len(c))
                    for s in range(a, b, step):
                        e = min(b, s + step)
                        r, best, score = k_best(x[s:e] @ y.T, k, None if floor[a] < -1 else floor[s:e])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[s + r]), pa.array(c[best]), pa.array(score)], names=["qid", "id", "score"])

    return run


def topk_in_lists(queries: DataFrame, corpus: DataFrame, k: int, width: int, skip_self: bool = False) -> DataFrame:
    """topk within lists: queries (id, v, list) meet only the rows (id, v, list) of their lists.

    Lists are dealt to tasks; a crowded one is many cells, each with a share of its queries and of its rows. Of queries
    that have a floor (id, v, list, floor), only rows that are as similar as that need to come out.
    """
    extra = 1 if skip_self else 0
    floor = F.col("floor") if "floor" in queries.columns else F.lit(-2.0)
    met = in_cells(queries.select("list", "id", "v", floor.alias("floor")), corpus.select("list", "id", "v", F.lit(-2.0).alias("floor")))
    return _ranked(met.mapInArrow(_in_lists(k + extra, width), "qid long, id long, score double"), k, skip_self)


def _floors(k: int, width: int):
    """(id, v, floor) from rows (cell, id, v) sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.concat_tables(pa.Table.from_batches([b]) for b in held).combine_chunks()
            v = rows.column("v").combine_chunks()
            x, floor, step = np.nan_to_num(unit_rows(v, width)), np.full(len(v), -1.0), max(1, PRODUCTS // len(v))
            if len(x) > k:
                for s in range(0, len(x), step):
                    floor[s : s + step] = np.partition(x[s : s + step] @ x.T, len(x) - k, axis=1)[:, len(x) - k]
            for b in rows.select(["id", "v"]).append_column("floor", pa.array(floor)).to_batches():
                yield b

        at, held = None, []
        for rb in batches:
            if not rb.num_rows:
                continue
            cell = rb.column(0).to_numpy()
            for a, b in spans(cell):
                if at != cell[a]:
                    if held:
                        yield from done()
                    at, held = cell[a], []
                held.append(rb.slice(a, b - a))
        if held:
            yield from done()

    return run


def floored(rows: DataFrame, k: int, width: int) -> DataFrame:
    """(id, v, floor): how similar the k-th best of a row's own list is at least, the row itself counted; -1 where so many aren't met.

    rows: id, v, list. A row meets a share of its list; more rows could only raise the floor.
    """
    n = F.broadcast(rows.groupBy("list").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("n")))
    cell = F.shiftleft(F.col("list").cast("long"), 16) + F.pmod(F.xxhash64("id"), F.col("n"))
    return rows.join(n, "list").select(cell.alias("cell"), "id", "v").repartition("cell").sortWithinPartitions("cell").mapInArrow(_floors(k, width), "id long, v array<float>, floor double")


def _ranked(found: DataFrame, k: int, skip_self: bool) -> DataFrame:
    if skip_self:
        found = found.where("qid <> id")
    return first_k(found, k, "rank", "qid", F.desc("score"), "id")


def first_k(df: DataFrame, k: int, name: str, by: str, *order) -> DataFrame:
    """The first k rows of each value of by, with name, their place from 0.

    The filter stands on the bare row number, so that each task cuts its groups to k before the shuffle.
    """
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn(name, n).where(F.col(name) <= k).withColumn(name, F.col(name) - 1)
