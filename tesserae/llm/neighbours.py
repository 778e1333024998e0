"""The most similar vectors of every vector, by shifted space-filling curves.

Each curve is a Hilbert ordering of a random projection, rotated and shifted anew, so that two near vectors which one
curve tears apart are close on another. The rows of each curve are range-partitioned and sorted; every vector is
compared with those that follow within a window. Candidates of all curves are merged and reranked on the exact vectors.
Where vectors crowd, windows fill before the nearest are met; rows that met several alike are compared in full with all
rows of their cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm._arrays import mix
from tesserae.session import materialize


@dataclass(frozen=True)
class Curves:
    """count: orderings; dims and bits: of each projection (their product below 64); window: rows compared ahead;
    block: rows of one matrix product; slack: what the one-byte copies of the vectors may be off; dense: similarity from
    which rows count as a crowd if no least one is asked for; words and sure: 64-bit words of a row's sketch of signs, and
    by how many standard deviations two sketches may differ beyond what the least similarity lets expect."""

    count: int = 12
    dims: int = 12
    bits: int = 5
    window: int = 32
    block: int = 256
    slack: float = 0.02
    dense: float = 0.92
    words: int = 4
    sure: float = 3.5
    seed: int = 20


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of x (n by dims, integers of that many bits)."""
    x = x.astype(np.uint64)
    dims = x.shape[1]
    one = np.uint64(1)
    for s in range(bits - 1, 0, -1):
        q = np.uint64(1 << s)
        low = q - one
        for i in range(dims):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for s in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, dims - 1] >> np.uint64(s)) & one == one, np.uint64((1 << s) - 1), np.uint64(0))
    x ^= turn[:, None]
    key = np.zeros(len(x), np.uint64)
    for s in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[:, i] >> np.uint64(s)) & one)
    return key


def _projections(c: Curves, width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(c.seed)
    dims = min(c.dims, width)
    turn = np.stack([np.linalg.qr(rng.standard_normal((width, width)))[0][:, :dims] for _ in range(c.count)])
    return turn.astype(np.float32), rng.uniform(-0.05, 0.05, (c.count, dims))


def keys_of(unit: np.ndarray, c: Curves) -> np.ndarray:
    """Key of each unit vector (rows) on each curve (columns)."""
    width = unit.shape[1]
    turn, shift = _projections(c, width)
    out = np.empty((len(unit), c.count), np.int64)
    for k in range(c.count):
        # projected coordinates of unit vectors spread by 1 / sqrt(width); +-3.25 of that fill the grid
        at = (unit @ turn[k]) * (np.sqrt(width) / 6.5) + 0.5 + shift[k]
        out[:, k] = hilbert((np.clip(at, 0, 1 - 1e-9) * (1 << c.bits)).astype(np.int64), c.bits).view(np.int64)
    return out


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    x = np.asarray(col.flatten(), np.float64).reshape(len(col), width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _on_curves(c: Curves, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            unit = _matrix(rb.column(1), width).astype(np.float32)
            keys = keys_of(unit, c)
            top = np.abs(unit).max(1)
            small = np.round(unit * (127 / top)[:, None]).astype(np.int8)
            packed = pa.array([x.tobytes() for x in small], pa.binary())
            scale = pa.array((top / 127).astype(np.float32))
            for k in range(c.count):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), k, np.int32)), pa.array(keys[:, k]), rb.column(0), scale, packed], names=["curve", "key", "id", "scale", "packed"])

    return run


def _signs(c: Curves, width: int) -> np.ndarray:
    return np.random.default_rng(c.seed + 1).standard_normal((width, 64 * c.words)).astype(np.float32)


def _sketches(unit: np.ndarray, c: Curves) -> np.ndarray:
    """The signs of random projections of unit vectors, as c.words words each."""
    return np.packbits(unit @ _signs(c, unit.shape[1]) > 0, axis=1).view(np.uint64)


def _apart(c: Curves, least: float) -> int:
    """Signs in which two vectors of that similarity differ at most, but for c.sure standard deviations."""
    n, p = 64 * c.words, np.arccos(np.clip(least, -1, 1)) / np.pi
    return int(np.ceil(n * p + c.sure * np.sqrt(n * p * (1 - p))))


def _sketched(c: Curves, width: int):
    """(curve, key, id, s0, s1, ...): the place of each row on each curve, with its sketch in place of its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            unit = _matrix(rb.column(1), width).astype(np.float32)
            keys, sk = keys_of(unit, c), _sketches(unit, c).view(np.int64)
            for k in range(c.count):
                cols = [pa.array(np.full(len(unit), k, np.int32)), pa.array(keys[:, k]), rb.column(0), *(pa.array(sk[:, i]) for i in range(c.words))]
                yield pa.RecordBatch.from_arrays(cols, names=["curve", "key", "id", *(f"s{i}" for i in range(c.words))])

    return run


def _compare(c: Curves, least: float):
    """(a, b), a < b: rows within the window of one curve whose sketches say that they may be similar enough."""
    most = _apart(c, least)

    def window(curve: np.ndarray, ids: np.ndarray, v: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose first row is among the first fresh rows."""
        left, right = [], []
        for d in range(1, min(c.window, len(ids) - 1) + 1):
            n = min(fresh, len(ids) - d)
            at = np.flatnonzero((np.bitwise_count(v[:n] ^ v[d : n + d]).sum(1) <= most) & (curve[:n] == curve[d : n + d]))
            left.append(ids[at])
            right.append(ids[at + d])
        return (np.concatenate(left), np.concatenate(right)) if left else (ids[:0], ids[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve, ids, v = np.empty(0, np.int32), np.empty(0, np.int64), np.empty((0, c.words), np.uint64)

        def out(fresh: int) -> pa.RecordBatch:
            a, b = window(curve, ids, v, fresh)
            p = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

        for rb in batches:
            if not rb.num_rows:
                continue
            new = np.stack([rb.column(3 + i).to_numpy() for i in range(c.words)], 1).view(np.uint64)
            curve, ids, v = np.concatenate([curve, rb.column(0).to_numpy()]), np.concatenate([ids, rb.column(2).to_numpy()]), np.concatenate([v, new])
            fresh = len(ids) - c.window
            if fresh > 0:
                yield out(fresh)
                curve, ids, v = curve[fresh:], ids[fresh:], v[fresh:]
        if len(ids):
            yield out(len(ids))

    return run


def _more(rb: pa.RecordBatch, width: int, curve: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a batch after those that are held."""
    raw = np.frombuffer(b"".join(rb.column(4).to_pylist()), np.int8).reshape(-1, width)
    unit = raw.astype(np.float32) * rb.column(3).to_numpy()[:, None]
    return np.concatenate([curve, rb.column(0).to_numpy()]), np.concatenate([ids, rb.column(2).to_numpy()]), np.concatenate([v, unit])


_NEAR = np.dtype([("other", "<i8"), ("sim", "<f4")])


def _nearest(c: Curves, width: int, k: int):
    """(id, near): the k most similar rows on both sides of each row of one curve, within the window at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve, ids, v = np.empty(0, np.int32), np.empty(0, np.int64), np.empty((0, width), np.float32)

        def lists(first: int, last: int) -> Iterator[pa.RecordBatch]:
            for s in range(first, last, c.block):
                e = min(last, s + c.block)
                f, t = max(0, s - c.window), min(len(v), e + c.window)
                sim = v[s:e] @ v[f:t].T
                sim[np.arange(e - s), np.arange(s - f, e - f)] = -2
                if curve[f] != curve[t - 1]:
                    sim[curve[s:e, None] != curve[None, f:t]] = -2
                m = min(k, t - f)
                best = np.argpartition(sim, t - f - m, axis=1)[:, t - f - m :]
                near = np.empty((e - s, m), _NEAR)
                near["other"], near["sim"] = ids[f + best], np.take_along_axis(sim, best, 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e]), pa.array([x.tobytes() for x in near], pa.binary())], names=["id", "near"])

        done = 0
        for rb in batches:
            if not rb.num_rows:
                continue
            curve, ids, v = _more(rb, width, curve, ids, v)
            fresh = len(ids) - c.window
            if fresh > done:
                yield from lists(done, fresh)
                drop = max(0, fresh - c.window)
                curve, ids, v, done = curve[drop:], ids[drop:], v[drop:], fresh - drop
        yield from lists(done, len(ids))

    return run


def _merged(c: Curves, k: int):
    """(a, b), a < b, from (id, lists of near): whatever may be among the k nearest, given what one-byte copies are off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                rb = whole.slice(s, 1000)
                lists = rb.column(1)
                size = np.asarray([sum(len(x) for x in row) // _NEAR.itemsize for row in lists.to_pylist()])
                near = np.frombuffer(b"".join(lists.flatten().to_pylist()), _NEAR)
                row = np.repeat(np.arange(rb.num_rows), size)
                ok = near["sim"] > -2
                row, other, sim = row[ok], near["other"][ok], near["sim"][ok]
                by = np.lexsort((-sim, other, row))
                row, other, sim = row[by], other[by], sim[by]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (other[1:] != other[:-1])
                row, other, sim = row[new], other[new], sim[new]
                by = np.lexsort((-sim, row))
                row, other, sim = row[by], other[by], sim[by]
                begin = np.searchsorted(row, np.arange(rb.num_rows))
                end = np.searchsorted(row, np.arange(rb.num_rows), side="right")
                kth = np.full(rb.num_rows, -2.0)
                some = end > begin
                kth[some] = sim[np.minimum(begin + k, end)[some] - 1]
                ok = sim >= kth[row] - c.slack
                a, b = rb.column(0).to_numpy()[row[ok]], other[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _exact(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                # nine places, so that equal similarities are ties
                sim = np.round((_matrix(rb.column(2), width) * _matrix(rb.column(3), width)).sum(1), 9)
                yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(sim)], names=["a", "b", "similarity"])

    return run


def _leaders(sample: np.ndarray, level: float) -> np.ndarray:
    """Rows of the sample (unit vectors) that are pairwise less similar than level, the first ones first."""
    most = len(sample)
    held = np.empty_like(sample)
    n = 0
    for x in sample:
        if n < most and (n == 0 or (held[:n] @ x).max() < level):
            held[n] = x
            n += 1
    return held[:n]


def _own_cell(leaders: np.ndarray, width: int):
    """(id, cell, angle): the nearest leader of each row (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                x = _matrix(rb.column(1), width)
                cell, near = np.empty(len(x), np.int64), np.empty(len(x))
                step = max(1, PRODUCTS // len(leaders))
                for s in range(0, len(x), step):
                    sim = x[s : s + step] @ leaders.T
                    cell[s : s + step], near[s : s + step] = sim.argmax(1), sim.max(1)
                angle = np.arccos(np.clip(near, -1, 1))
                yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["id", "cell", "angle"])

    return run


def _reached_cells(leaders: np.ndarray, cells: np.ndarray, reach: np.ndarray, width: int):
    """(id, v, cell) for each of the cells whose leader is within reach of the row (id, v)."""

    # single precision, and wider by what it may be off
    to, least = leaders[cells].T.astype(np.float32), (np.cos(np.minimum(reach, np.pi)) - 1e-5).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                x = _matrix(rb.column(1), width).astype(np.float32)
                step = max(1, PRODUCTS // len(cells))
                for s in range(0, len(x), step):
                    row, at = np.nonzero(x[s : s + step] @ to >= least)
                    for i in range(0, len(row), 10_000):
                        take = pa.array(row[i : i + 10_000] + s)
                        yield pa.RecordBatch.from_arrays([rb.column(0).take(take), rb.column(1).take(take), pa.array(cells[at[i : i + 10_000]].astype(np.int32))], names=["id", "v", "cell"])

    return run


def _in_full(k: int, width: int):
    """(a, b), a < b: the k nearest among a share's rows of each of its asking rows, from (share, role, id, v) sorted by share, role (0 asks) and id."""

    def found(asks: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        a, b = np.repeat(asks, other.shape[1]), other.ravel()
        a, b = a[b >= 0], b[b >= 0]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def meet(asks: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, best: np.ndarray, other: np.ndarray) -> None:
        """Brings best and other up to date; of equal similarities the smaller ids, which come first, stay."""
        sim = np.round(q @ x.T, 12)
        sim[asks[:, None] == ids[None, :]] = -3
        better = sim > best[:, -1:]
        if len(ids) > k and better.sum() > 8 * k * len(asks):
            better &= sim >= np.partition(sim, len(ids) - k, axis=1)[:, len(ids) - k, None]
        r, c = np.nonzero(better)
        if not len(r):
            return
        row = np.concatenate([np.repeat(np.arange(len(asks)), k), r])
        s, o = np.concatenate([best.ravel(), sim[r, c]]), np.concatenate([other.ravel(), ids[c]])
        by = np.lexsort((np.arange(len(row)), -s, row))
        begin = np.searchsorted(row[by], np.arange(len(asks)))
        top = by[begin[:, None] + np.arange(k)]
        best[:], other[:] = s[top], o[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, asks, q, best, other, met = None, [], [], None, None, False
        for rb in batches:
            if not rb.num_rows:
                continue
            of, role, ids, x = rb.column(0).to_numpy(), rb.column(1).to_numpy(), rb.column(2).to_numpy(), _matrix(rb.column(3), width)
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(role) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if of[s] != share:
                    if met:
                        yield found(asks, other)
                    share, asks, q, met = of[s], [], [], False
                if role[s] == 0:
                    asks.append(ids[s:e])
                    q.append(x[s:e])
                    continue
                if not met:
                    asks, q, met = np.concatenate(asks), np.concatenate(q), True
                    best, other = np.full((len(asks), k), -2.0), np.full((len(asks), k), -1, np.int64)
                for i in range(s, e, 1024):
                    j = min(e, i + 1024)
                    meet(asks, q, ids[i:j], x[i:j], best, other)
        if met:
            yield found(asks, other)

    return run


SHARE = 4096
#: Products of rows and leaders that a task holds; rows that one round takes leaders from, and leaders from which on none are added.
PRODUCTS, SAMPLE, LEADERS = 1 << 21, 1 << 15, 1 << 16
#: Ids that are broadcast at most; more are joined by shuffles.
FEW = 1 << 20


def _few(ids: DataFrame) -> bool:
    return ids.limit(FEW + 1).count() <= FEW


def _of(one: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of one (id, v) that ids (id, distinct and materialized) names, if these are few; else one."""
    return one.join(F.broadcast(ids), "id", "left_semi") if _few(ids) else one


def _crowded(exact: DataFrame, one: DataFrame, k: int, width: int, level: float) -> DataFrame | None:
    """(a, b), a < b: the k nearest at or above level of every row with k / 2 such pairs (a, b, similarity) or more; None without such rows.

    Each such row belongs to the cell of its nearest leader. With the angle of the farthest such row and that of level
    together, a leader reaches all that can be alike to a row of its cell, so nothing is left out. Leaders are added until
    each such row is alike to one: a cell with a far row would reach most of the table.
    """
    both = exact.where(F.col("similarity") >= level).select(F.explode(F.array("a", "b")).alias("id"))
    ids = materialize(both.groupBy("id").count().where(f"count >= {(k + 1) // 2}").select("id"))
    dense = materialize(_of(one, ids).join(ids, "id").select("id", "v"))
    leaders, own, left = np.empty((0, width)), None, dense
    while (n := left.count()) and len(leaders) < LEADERS:
        some = left.where(F.pmod(F.xxhash64("id"), F.lit(-(-n // SAMPLE))) == 0).toArrow().sort_by("id")
        if some.num_rows:
            leaders = np.concatenate([leaders, _leaders(_matrix(some.column("v").combine_chunks(), width), level)])
        elif not len(leaders):
            leaders = _matrix(left.limit(1).toArrow().column("v").combine_chunks(), width)
        own = materialize(dense.mapInArrow(_own_cell(leaders, width), "id long, cell int, angle double"))
        if not some.num_rows:
            break
        left = dense.join(own.where(F.col("angle") > float(np.arccos(level)) + 1e-6).select("id"), "id", "left_semi")
    if own is None:
        return None
    cells = sorted(own.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect(), key=lambda r: r.cell)
    shares = [-(-r.n // SHARE) for r in cells]
    first = np.concatenate([[0], np.cumsum(shares)])[:-1].tolist()
    spark = one.sparkSession
    of = F.broadcast(spark.createDataFrame([(r.cell, f, n) for r, f, n in zip(cells, first, shares, strict=True)], "cell int, first long, n long"))
    reach = np.asarray([r.radius for r in cells]) + np.arccos(level) + 1e-6
    asking = own.join(dense, "id").join(of, "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), "n")).alias("share"), F.lit(0).alias("role"), "id", "v")
    rows = one.mapInArrow(_reached_cells(leaders, np.asarray([r.cell for r in cells]), reach, width), "id long, v array<float>, cell int")
    asked = rows.join(of, "cell").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("share"), F.lit(1).alias("role"), "id", "v")
    return asking.unionByName(asked).repartition("share").sortWithinPartitions("share", "role", "id").mapInArrow(_in_full(k, width), "a long, b long")


def _usable_rows(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    v = F.col(f"`{vector}`")
    ok = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), v.cast("array<float>").alias("v"), F.coalesce(ok, F.lit(False)).alias("ok")).where("ok AND id IS NOT NULL").select("id", "v")


def usable(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(id, v): one row for each id with a usable vector: width long, no null, NaN or infinite value, not all zero.

    If an id comes with several different vectors, the least of them in array order counts.
    """
    return _usable_rows(df, key, vector, width).groupBy("id").agg(F.min("v").alias("v"))


def _in_place(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """usable, for several readings: only ids are shuffled, and the vectors of repeated ids; the others stay where df has them."""
    rows = _usable_rows(df, key, vector, width)
    again = materialize(rows.groupBy("id").count().where("count > 1").select("id"))
    if not _few(again):
        return materialize(usable(df, key, vector, width))
    again = F.broadcast(again)
    return rows.join(again, "id", "left_anti").unionByName(materialize(rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))))


def _directions(width: int):
    """(id, v, c0, c1) with two hashes of the direction to six places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.random.default_rng(7).integers(1, 1 << 62, (width, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for rb in batches:
            if rb.num_rows:
                # adding 0 turns a negative zero into a positive one
                way = (np.round(_matrix(rb.column(1), width), 6) + 0.0).view(np.uint64)
                h = np.stack([(mix(way + factor[:, i]) * factor[:, i]).sum(1) for i in (0, 1)], 1)
                yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), *(pa.array(mix(h[:, i]).view(np.int64)) for i in (0, 1))], names=["id", "v", "c0", "c1"])

    return run


CLASS = ("c0", "c1")


def _classes(one: DataFrame, width: int) -> DataFrame:
    """one (id, v) with the class of its direction: 128 bits of hashes of the direction to six places; cosines within a
    direction are 1 to ten places.

    Copies scaled in single precision differ in the eighth place, so a crowd of them makes a few directions at most.
    """
    return one.mapInArrow(_directions(width), "id long, v array<float>, c0 long, c1 long")


def _scored(pairs: DataFrame, one: DataFrame, width: int) -> DataFrame:
    """(a, b, similarity) of pairs (a, b) of ids of one (id, v); only vectors of ids in pairs travel, if these are few."""
    pairs = materialize(pairs)
    one = _of(one, materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    full = pairs.join(one.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(one.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb")
    return full.mapInArrow(_exact(width), "a long, b long, similarity double")


def neighbours(df: DataFrame, key: str, vector: str, k: int = 10, width: int = 64, least: float | None = None, curves: Curves = Curves()) -> DataFrame:
    """(id, other, similarity, rank): up to k most similar other ids of every id, nearest first; ties go to the smaller id.

    Similarity is the cosine; with least only neighbours at or above it come out, and the search is the better for it.
    Rows with a null id or a vector that is not usable take no part; repeated ids count once; an empty table gives no
    rows. Of vectors of equal direction the k + 1 smallest ids go through the search; the others' nearest are then the
    first k of these, which is exact, so a crowd of copies of any size and length costs each task a few rows. Rows in
    other crowds (k / 2 or more met at least or, without it, at the curves' dense similarity) are compared in full with
    all rows that can be so similar; the work for that grows with the square of a crowd. df is read several times, so that
    its vectors needn't be kept: what is shuffled of all rows are ids, directions and sketches.
    """
    one = _in_place(df, key, vector, width)
    # only ids and classes travel; copies beyond the first k + 1 then leave, which are few or none
    beyond = materialize(_classes(one, width).select("id", *CLASS).withColumn("n", F.row_number().over(Window.partitionBy(*CLASS).orderBy("id"))).where(f"n > {k + 1}").select("id"))
    if not _few(beyond):
        one = materialize(one.join(beyond, "id", "left_anti"))
    elif beyond.limit(1).count():
        one = one.join(F.broadcast(beyond), "id", "left_anti")
    # windows end with a partition, so a partition holds many of them
    parts = max(1, one.count() * curves.count // (64 * max(curves.window, 256)))

    def in_line(df: DataFrame) -> DataFrame:
        return df.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key", "id")

    if least is not None:
        words = "".join(f", s{i} long" for i in range(curves.words))
        lined = in_line(one.mapInArrow(_sketched(curves, width), f"curve int, key long, id long{words}"))
        pairs = lined.mapInArrow(_compare(curves, least), "a long, b long").distinct()
    else:
        lined = in_line(one.mapInArrow(_on_curves(curves, width), "curve int, key long, id long, scale float, packed binary"))
        lists = lined.mapInArrow(_nearest(curves, width, k + 2), "id long, near binary").groupBy("id").agg(F.collect_list("near").alias("near"))
        pairs = lists.mapInArrow(_merged(curves, k), "a long, b long").distinct()
    exact = _scored(pairs, one, width)
    if least is not None:
        exact = exact.where(F.col("similarity") >= least)
    exact = materialize(exact)
    more = _crowded(exact, one, k, width, curves.dense if least is None else least)
    if more is not None:
        new = _scored(more.distinct().join(exact, ["a", "b"], "left_anti"), one, width)
        exact = exact.unionByName(new if least is None else new.where(F.col("similarity") >= least))
    both = exact.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("p"), "similarity").select("p.id", "p.other", "similarity")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def copies_beyond(df: DataFrame, key: str, vector: str, k: int = 10, width: int = 64) -> DataFrame:
    """(id, other, similarity, rank) of the ids that neighbours leaves to their k + 1 smaller copies."""
    one = _classes(usable(df, key, vector, width), width)
    w = Window.partitionBy(*CLASS).orderBy("id")
    heads = one.withColumn("n", F.row_number().over(w)).where(f"n <= {k + 1}")
    full = heads.where(f"n = {k + 1}").select(*CLASS, F.col("id").alias("last"))
    tail = one.join(full, list(CLASS)).where("id > last").select("id", *CLASS)
    return tail.join(heads.where(f"n <= {k}").select(*CLASS, F.col("id").alias("other"), F.col("n").alias("rank")), list(CLASS)).select("id", "other", F.lit(1.0).alias("similarity"), "rank")


def mutual(found: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs that are each among the other's neighbours."""
    p = found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
    return p.groupBy("id_a", "id_b").count().where("count = 2").select("id_a", "id_b")
