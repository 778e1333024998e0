"""Vector indexes as tables: flat, inverted lists, product-quantized codes, neighbour graphs; training, adding, removing, search.

An index is a directory: ``meta`` (one row), ``vectors`` (id, v or code, list), ``edges`` where it is a graph, and, where
it has lists or codes, ``centroids`` and ``codebook``. How many lists there are and how many of them a question probes
follows from the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.parameters import effective_nlist, ivf_plan, pick_nprobe, safe_pq_m
from tesserae.operators.vectors import PRODUCTS, first_k, floored, in_cells, k_best, spans, topk, topk_in_lists, unit_rows
from tesserae.session import materialize


@dataclass(frozen=True)
class Model:
    """What training gives; centroids (nlist, width) and codebook (m, codes, width / m) are as large as their parameters."""

    kind: str
    width: int
    centroids: np.ndarray | None = None
    codebook: np.ndarray | None = None

    @property
    def nlist(self) -> int:
        return 0 if self.centroids is None else len(self.centroids)

    @property
    def m(self) -> int:
        return 0 if self.codebook is None else len(self.codebook)


def training_sample(vectors: DataFrame, papers_of: DataFrame, n: int, expected: int) -> DataFrame:
    """(id, v): up to n vectors for training, at most min(64, max(8, ceil(n / expected))) of a paper, chosen by hash.

    vectors: id, v. papers_of: id, paper_id. The same rows give the same sample.
    """
    from pyspark.sql import Window

    cap = min(64, max(8, math.ceil(n / max(1, expected))))
    h = F.xxhash64("id", F.lit(314159))
    w = Window.partitionBy("paper_id").orderBy(h, "id")
    # ids are chosen before vectors are read; a limit of ordered vectors would send as many of each task to the driver
    few = vectors.select("id").join(papers_of, "id").withColumn("h", h).withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    return vectors.join(few.orderBy("h", "id").limit(n).select("id"), "id").select("id", "v")


def _closest(x: np.ndarray, c: np.ndarray, cosine: bool = True) -> np.ndarray:
    """The nearest centre of each row of x, the first of equal ones; in blocks of rows, so that memory doesn't follow rows times centres."""
    at, half = np.empty(len(x), np.int64), 0 if cosine else (c * c).sum(1) / 2
    step = max(1, PRODUCTS // len(c))
    for s in range(0, len(x), step):
        at[s : s + step] = (x[s : s + step] @ c.T - half).argmax(1)
    return at


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, cosine: bool) -> np.ndarray:
    """k means by Lloyd's rounds; empty cells are started again from random rows."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _closest(x, c, cosine)
        n = np.bincount(at, minlength=k)
        s = np.stack([np.bincount(at, x[:, i], minlength=k) for i in range(x.shape[1])], 1)
        full = n > 0
        c[full] = s[full] / n[full, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
        if cosine:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _value(spark: SparkSession, c):
    """A parameter that is stated as a column expression over numbers."""
    return spark.range(1).select(c.alias("x")).first().x


def plan(spark: SparkSession, n: int, width: int, kind: str, nlist: int = 16_384, m: int = 16, bits: int = 8) -> tuple[str, int, int]:
    """(kind, lists, m) of an index over n training vectors: 'flat' where they are too few for lists or codes."""
    if kind == "ivfpq":
        p = _value(spark, ivf_plan(n, width, nlist, m, bits))
        return p.kind, p.nlist, p.m
    lists = 0 if kind == "flat" or n < 256 else _value(spark, effective_nlist(n, nlist))
    return (kind, lists, 0) if lists else ("flat", 0, 0)


def train(sample: DataFrame, width: int, kind: str = "ivfpq", nlist: int = 16_384, m: int = 16, bits: int = 8, rounds: int = 12, most: int = 50_000, seed: int = 314159, forced: bool = False) -> Model:
    """Fit the index on a sample (id, v) of at most most rows, which reach the driver; every row is indexed later.

    The number of lists and the width of the codes follow from the sample's size (plan); with forced they are as given,
    as long as the sample has a row for each list and code.
    """
    if kind == "flat":
        return Model("flat", width)
    rows = sample.limit(most).toArrow().sort_by("id")
    x = np.asarray(rows.column("v").combine_chunks().flatten(), np.float64).reshape(-1, width)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    spark = sample.sparkSession
    if forced:
        m = _value(spark, safe_pq_m(width, m))
        if len(x) < nlist or (kind == "ivfpq" and len(x) < (1 << bits)):
            kind = "flat"
    else:
        kind, nlist, m = plan(spark, len(x), width, kind, nlist, m, bits)
    if kind == "flat":
        return Model("flat", width)
    cent = _means(x, nlist, rounds, rng, True)
    if kind in ("ivf", "hnsw"):
        return Model(kind, width, cent)
    rest = x - cent[_closest(x, cent)]
    parts = rest.reshape(len(x), m, width // m)
    return Model("ivfpq", width, cent, np.stack([_means(parts[:, i], 1 << bits, rounds, rng, False) for i in range(m)]))


def assign(vectors: DataFrame, model: Model, probes: int = 1) -> DataFrame:
    """(id, v, list): each vector with its probes nearest lists, one row each; list 0 for flat indexes. A floor stays with its vector.

    The centroids go with the task; their size is nlist times the width, whatever the data.
    """
    names = ["id", "v", *(["floor"] if "floor" in vectors.columns else [])]
    if model.centroids is None:
        return vectors.select(*names, F.lit(0).alias("list"))
    cent, width = model.centroids, model.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                x = np.asarray(rb.column(1).flatten(), np.float64).reshape(-1, width)
                if probes == 1:
                    near = _closest(x, cent)[:, None].astype(np.int32)
                else:
                    step = max(1, PRODUCTS // len(cent))
                    near = np.concatenate([np.argsort(-(x[s : s + step] @ cent.T), axis=1, kind="stable")[:, :probes].astype(np.int32) for s in range(0, len(x), step)])
                row = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in rb.columns), pa.array(near.ravel())], names=[*names, "list"])

    return vectors.select(*names).mapInArrow(run, "id long, v array<float>, " + "floor double, " * ("floor" in names) + "list int")


def encode(assigned: DataFrame, model: Model) -> DataFrame:
    """(id, list, code): a byte for each part of a vector's rest from its list's centre."""
    cent, book, width = model.centroids, model.codebook, model.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if rb.num_rows:
                x = np.asarray(rb.column(1).flatten(), np.float64).reshape(-1, width)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                rest = (x - cent[rb.column(2).to_numpy()]).reshape(len(x), len(book), -1)
                code = np.stack([(2 * rest[:, i] @ book[i].T - (book[i] ** 2).sum(1)).argmax(1) for i in range(len(book))], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "list", "code"])

    return assigned.select("id", "v", "list").mapInArrow(run, "id long, list int, code binary")


def _by_tables(model: Model, k: int):
    """(qid, id, score) of the k best codes of each cell, from (cell, side, id, v, code, list) sorted by cell and side: codes first, then queries.

    A query's products with all entries of the codebook are worked out once a cell; a code's score is the product with
    its list's centre and a sum of looked-up products.
    """
    cent, book, width = model.centroids, model.codebook, model.width
    entries, step = book.transpose(0, 2, 1), max(1, PRODUCTS // (len(book) * book.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, c, code = None, [], None, None
        for rb in batches:
            if not rb.num_rows:
                continue
            cell, side, ids = (rb.column(i).to_numpy() for i in range(3))
            for a, b in spans(cell, side):
                if not side[a]:
                    if at != cell[a]:
                        at, held = cell[a], []
                    held.append((ids[a:b], np.frombuffer(b"".join(rb.column(4).slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, len(book))))
                    c = None
                elif at == cell[a]:
                    if c is None:
                        c, code = np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])
                        order = np.argsort(c, kind="stable")
                        c, code = c[order], code[order]
                    x, centre = unit_rows(rb.column(3).slice(a, b - a), width), cent[rb.column(5)[int(a)].as_py()]
                    for s in range(0, len(x), step):
                        look = np.matmul(x[s : s + step].reshape(-1, len(book), width // len(book)).transpose(1, 0, 2), entries)
                        score = np.repeat((x[s : s + step] @ centre)[:, None], len(c), 1)
                        for i in range(len(book)):
                            score += look[i][:, code[:, i]]
                        r, best, found = k_best(score, k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a + s + r]), pa.array(c[best]), pa.array(found)], names=["qid", "id", "score"])

    return run


def _topk_in_codes(q: DataFrame, codes: DataFrame, model: Model, k: int) -> DataFrame:
    met = in_cells(q.select("list", "id", "v", F.lit(None).cast("binary").alias("code"), F.col("list").alias("l")), codes.select("list", "id", F.lit(None).cast("array<float>").alias("v"), "code", F.col("list").alias("l")))
    return first_k(met.mapInArrow(_by_tables(model, k), "qid long, id long, score double"), k, "rank", "qid", F.desc("score"), "id")


#: Queries whose vectors a task holds to score pairs, and tasks that their pairs are dealt to.
ASKED, DEALT = 8192, 16


def _pair_scores(width: int):
    """(qid, id, score) from (cell, side, id, v, qids) sorted by cell and side: queries first, then rows with the queries that they are paired with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, q, y, step = None, [], None, None, max(1, PRODUCTS // width)
        for rb in batches:
            if not rb.num_rows:
                continue
            cell, side, ids = (rb.column(i).to_numpy() for i in range(3))
            for a, b in spans(cell, side):
                x = unit_rows(rb.column(3).slice(a, b - a), width)
                if not side[a]:
                    if at != cell[a]:
                        at, held = cell[a], []
                    held.append((ids[a:b], x))
                    q = None
                elif at == cell[a]:
                    if q is None:
                        q, y = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                        order = np.argsort(q, kind="stable")
                        q, y = q[order], y[order]
                    asked = rb.column(4).slice(a, b - a)
                    row, qid = np.repeat(np.arange(b - a), asked.value_lengths().to_numpy()), asked.flatten().to_numpy()
                    for s in range(0, len(row), step):
                        r, i = row[s : s + step], qid[s : s + step]
                        score = np.round(np.einsum("ij,ij->i", y[np.searchsorted(q, i)], x[r]), 9)
                        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(ids[a + r]), pa.array(score)], names=["qid", "id", "score"])

    return run


def rescored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(qid, id, score) of pairs (qid, id) of the queries (id, v), by the cosine of the stored vectors (id, v).

    A row's vector goes to the task of a block of queries once, with the ids of those that it is paired with.
    """
    n = F.broadcast(queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / ASKED)).cast("int").alias("n")))
    block = lambda by: F.pmod(F.xxhash64(by), F.col("n")).cast("int")
    wanted = pairs.crossJoin(n).select("id", block("qid").alias("block"), "qid")
    rows = wanted.repartition("id").groupBy("id", "block").agg(F.collect_list("qid").alias("qids")).join(vectors.select("id", "v"), "id")
    rows = rows.select((F.col("block") * DEALT + F.pmod(F.xxhash64("id"), F.lit(DEALT)).cast("int")).alias("cell"), F.lit(1).alias("side"), "id", "v", "qids")
    asked = queries.crossJoin(n).select(F.explode(F.sequence(block("id") * DEALT, block("id") * DEALT + DEALT - 1)).alias("cell"), F.lit(0).alias("side"), "id", "v", F.array().cast("array<long>").alias("qids"))
    return asked.unionByName(rows).repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(_pair_scores(width), "qid long, id long, score double")


def probes_of(spark: SparkSession, model: Model, nprobe: int | None = None) -> int:
    """Lists that a question probes: pick_nprobe of the number of lists, or of what is asked for."""
    return _value(spark, pick_nprobe(model.nlist, nprobe))


def search(queries: DataFrame, indexed: DataFrame, model: Model, k: int, nprobe: int | None = None, rerank: DataFrame | None = None, wider: int = 4, edges: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank): up to k neighbours of each query (id, v) from the lists it probes.

    indexed: (id, v, list), or (id, list, code), read twice. With codes, rerank (id, v) scores the wider times k best by their codes
    on the stored vectors. A graph (edges) is followed from the best of the nearest lists, see follow.
    """
    if model.kind == "flat":
        return topk(queries, indexed.select("id", "v"), k, model.width)
    if model.kind == "hnsw" and edges is not None:
        return follow(queries, indexed, edges, model, k)
    q = assign(queries, model, min(model.nlist, probes_of(queries.sparkSession, model, nprobe)))
    if "code" not in indexed.columns:
        return topk_in_lists(q, indexed, k, model.width)
    if rerank is None:
        return _topk_in_codes(q, indexed, model, k)
    rough = _topk_in_codes(q, indexed, model, k * wider)
    return first_k(rescored(rough, queries, rerank, model.width), k, "rank", "qid", F.desc("score"), "id")


#: Lists in which a graph looks for the neighbours of a vector.
AROUND = 8


def graph(rows: DataFrame, model: Model, links: int = 16) -> DataFrame:
    """(id, to): for each vector (id, v, list) its links nearest in the lists around it, and back.

    The lowest layer of a navigable graph; the centroids above it are the layer from which searches go down.
    """
    # a vector's own list has most of its neighbours: from the lists around it only closer ones come out
    near = topk_in_lists(assign(floored(rows, links + 1, model.width), model, min(AROUND, model.nlist)), rows, links, model.width, skip_self=True)
    ways = F.explode(F.array(F.struct(F.col("qid").alias("id"), F.col("id").alias("to"), "score"), F.struct("id", F.col("qid").alias("to"), "score")))
    both = near.select(ways.alias("x")).select("x.*").repartition("id").groupBy("id", "to").agg(F.max("score").alias("score"))
    return first_k(both, 2 * links, "n", "id", F.desc("score"), "to").select("id", "to")


def follow(queries: DataFrame, rows: DataFrame, edges: DataFrame, model: Model, k: int, ef: int = 64, steps: int = 4) -> DataFrame:
    """(qid, id, score, rank): k neighbours found along a graph's edges, for all queries at once.

    The beam of a query are the ef best rows known; it begins with those of its two nearest lists. Each step looks at
    the neighbours of the beam's new rows; a query whose beam has no new row is done.
    """
    vectors = rows.select("id", "v")
    beam = materialize(topk_in_lists(assign(queries, model, min(2, model.nlist)), rows, ef, model.width).select("qid", "id", "score", F.lit(True).alias("new")))
    for _ in range(steps):
        reached = beam.where("new").join(edges, "id").select("qid", F.col("to").alias("id")).distinct().join(beam.select("qid", "id"), ["qid", "id"], "left_anti")
        grown = beam.withColumn("new", F.lit(False)).unionByName(rescored(reached, queries, vectors, model.width).withColumn("new", F.lit(True)))
        beam = materialize(first_k(grown, ef, "rank", "qid", F.desc("score"), "id").drop("rank"))
        if not beam.where("new").limit(1).count():
            break
    return first_k(beam.drop("new"), k, "rank", "qid", F.desc("score"), "id")


def share_scored(queries: DataFrame, rows: DataFrame, model: Model, nprobe: int | None = None) -> DataFrame:
    """(share): the part of the rows (id, list) that the lists which a query probes hold, on average."""
    if model.kind == "flat":
        return queries.sparkSession.range(1).select(F.lit(1.0).alias("share"))
    n = rows.groupBy("list").agg(F.count("*").alias("n"))
    met = assign(queries, model, min(model.nlist, 2 if model.kind == "hnsw" else probes_of(queries.sparkSession, model, nprobe))).join(n, "list", "left")
    per = met.agg(F.sum(F.coalesce("n", F.lit(0))).alias("met"), F.count_distinct("id").alias("q"))
    return per.crossJoin(n.agg(F.sum("n").alias("all"))).select(F.round(F.col("met") / (F.col("q") * F.col("all")), 6).alias("share"))


def indexed_rows(vectors: DataFrame, model: Model) -> DataFrame:
    """The rows of an index over vectors (id, v): (id, v, list), or (id, list, code) where the model has codes."""
    rows = assign(vectors, model)
    return encode(rows, model) if model.m else rows


def add(indexed: DataFrame, new: DataFrame) -> DataFrame:
    """indexed with new rows of the same columns; a row of an id that is there is replaced, so an id is never twice."""
    return indexed.join(new.select("id").distinct(), "id", "left_anti").unionByName(new.dropDuplicates(["id"]))


def remove(indexed: DataFrame, ids: DataFrame) -> DataFrame:
    return indexed.join(ids.select("id").distinct(), "id", "left_anti")


def save(indexed: DataFrame, model: Model, path: str, version: int = 1, edges: DataFrame | None = None) -> None:
    """Write an index under path/v{version}; the data first, then the row that says it is complete.

    Rows lie by ranges of lists, so that a probe reads few files and no list is spread over many.
    """
    spark = indexed.sparkSession
    at = f"{path}/v{version}"
    indexed.withColumn("part", F.shiftright("list", 6)).repartition("part").sortWithinPartitions("part", "list").write.mode("overwrite").partitionBy("part").parquet(f"{at}/vectors")
    for name, x in (("centroids", model.centroids), ("codebook", model.codebook)):
        if x is not None:
            spark.createDataFrame([(i, row.ravel().tolist()) for i, row in enumerate(x)], "n int, x array<double>").coalesce(1).write.mode("overwrite").parquet(f"{at}/{name}")
    if edges is not None:
        edges.write.mode("overwrite").parquet(f"{at}/edges")
    n = spark.read.schema(indexed.schema).parquet(f"{at}/vectors").count()
    row = (model.kind, model.width, model.nlist, model.m, "inner_product", n, edges is not None, "code" in indexed.columns)
    spark.createDataFrame([row], "kind string, width int, nlist int, m int, metric string, ntotal long, graph boolean, codes boolean").coalesce(1).write.mode("overwrite").parquet(f"{at}/meta")


def exists(spark: SparkSession, path: str, version: int = 1) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{version}/meta/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, Model]:
    """The rows and the model of a saved index; refuses any metric but the inner product."""
    at = f"{path}/v{version}"
    meta = spark.read.parquet(f"{at}/meta").first()
    if meta.metric != "inner_product":
        raise ValueError(f"metric {meta.metric} is not the inner product")

    def small(name: str) -> np.ndarray:
        return np.asarray([r.x for r in sorted(spark.read.parquet(f"{at}/{name}").collect(), key=lambda r: r.n)], np.float64)

    cent = small("centroids") if meta.nlist else None
    book = small("codebook").reshape(meta.m, -1, meta.width // meta.m) if meta.m else None
    schema = "id long, list int, code binary" if meta.codes else "id long, v array<float>, list int"
    return spark.read.schema(schema).parquet(f"{at}/vectors").drop("part"), Model(meta.kind, meta.width, cent, book)


def load_or_create(spark: SparkSession, path: str, width: int, version: int = 1) -> tuple[DataFrame, Model]:
    """A saved index, or an empty flat one, which is saved as well, where there is none."""
    if not exists(spark, path, version):
        save(spark.createDataFrame([], "id long, v array<float>, list int"), Model("flat", width), path, version)
    return load(spark, path, version)


def load_edges(spark: SparkSession, path: str, version: int = 1) -> DataFrame | None:
    return spark.read.parquet(f"{path}/v{version}/edges") if spark.read.parquet(f"{path}/v{version}/meta").first().graph else None


def describe(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """One row: kind, width, nlist, m, metric, ntotal."""
    return spark.read.parquet(f"{path}/v{version}/meta")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(recall): the share of the true pairs (qid, id) that were found."""
    return truth.select("qid", "id").join(found.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))
