"""Index queries: training, lists, codes, graphs, and how much of the exact answer they find."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import unit
from tesserae.operators import index
from tesserae.operators.vectors import topk
from tesserae.plans.retrieval import WIDTH, chunk_vectors, usable_sql
from tesserae.session import materialize, table

M, K = 16, 10
#: Vectors that an index is fitted on; all are indexed.
SAMPLE = 20_000
EXPECTED = 5


def train_sample(spark: SparkSession, base: str) -> DataFrame:
    """The training sample: some of each paper's passages, chosen by hash."""
    papers_of = table(spark, base, "chunks").select(F.col("chunk_id").alias("id"), "paper_id")
    return index.training_sample(chunk_vectors(spark, base), papers_of, SAMPLE, EXPECTED).select("id")


def train_sample_counts(spark: SparkSession, base: str) -> DataFrame:
    """(paper_id, n): how many of each paper's vectors were chosen, as long as all that the cap leaves fit the sample."""
    papers_of = table(spark, base, "chunks").select(F.col("chunk_id").alias("id"), "paper_id")
    v = chunk_vectors(spark, base).select("id", "v")
    return index.training_sample(v, papers_of, 1 << 30, 1 << 26).join(papers_of, "id").groupBy("paper_id").agg(F.count("*").alias("n"))


def _trained(spark: SparkSession, base: str, kind: str, v: DataFrame | None = None) -> tuple[DataFrame, DataFrame, index.Model]:
    v = chunk_vectors(spark, base) if v is None else v
    papers_of = table(spark, base, "chunks").select(F.col("chunk_id").alias("id"), "paper_id")
    model = index.train(index.training_sample(v, papers_of, SAMPLE, EXPECTED), WIDTH, kind, m=M)
    return v, v.where("id % 50 = 0"), model


def _graph_topk(q: DataFrame, rows: DataFrame, model: index.Model) -> DataFrame:
    return index.search(q, rows, model, K, edges=materialize(index.graph(rows, model)) if model.nlist else None)


def _codes_topk(spark: SparkSession, base: str, v: DataFrame) -> DataFrame:
    papers_of = table(spark, base, "chunks").select(F.col("chunk_id").alias("id"), "paper_id")
    lists = max(8, min(4096, v.count() // 64))
    model = index.train(index.training_sample(v, papers_of, SAMPLE, EXPECTED), WIDTH, "ivfpq", lists, M, forced=True)
    return index.search(v.where("id % 50 = 0"), materialize(index.indexed_rows(v, model)), model, K, rerank=v if model.m else None, wider=8)


def ivf_topk(spark: SparkSession, base: str) -> DataFrame:
    """10 neighbours from inverted lists."""
    v, q, model = _trained(spark, base, "ivf")
    return index.search(q, materialize(index.assign(v, model)), model, K)


def hnsw_topk(spark: SparkSession, base: str) -> DataFrame:
    """10 neighbours along a graph."""
    v, q, model = _trained(spark, base, "hnsw")
    return _graph_topk(q, materialize(index.assign(v, model)), model)


def ivfpq_topk(spark: SparkSession, base: str) -> DataFrame:
    """10 neighbours by codes, the best 80 rescored; codes are trained however few vectors there are."""
    return _codes_topk(spark, base, chunk_vectors(spark, base))


def index_recall(spark: SparkSession, base: str) -> DataFrame:
    """(kind, recall, share): how many of the exact 10 were found, and the part of all vectors in the lists looked at.

    Vectors, lists and the exact answer are worked out once; each kind's row is finished before the next kind begins.
    """
    v = materialize(chunk_vectors(spark, base))
    q = v.where("id % 50 = 0")
    exact = materialize(topk(q, v, K, WIDTH).select("qid", "id"))
    _, _, model = _trained(spark, base, "ivf", v)
    rows = materialize(index.assign(v, model))
    # a graph's lists are trained as those of ivf
    linked = replace(model, kind="hnsw" if model.nlist else "flat")
    out = []
    for kind, shared, found in (
        ("ivf", model, lambda: index.search(q, rows, model, K)),
        ("hnsw", linked, lambda: _graph_topk(q, rows, linked)),
        ("ivfpq", model, lambda: _codes_topk(spark, base, v)),
    ):
        share = index.share_scored(q, rows.select("id", "list"), shared)
        out.append(materialize(index.recall(found(), exact).crossJoin(share).select(F.lit(kind).alias("kind"), "recall", "share")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def kmeans_lists(spark: SparkSession, base: str) -> DataFrame:
    """(list, n): how many vectors each list holds."""
    v, _, model = _trained(spark, base, "ivf")
    return index.assign(v, model).groupBy("list").agg(F.count("*").alias("n"))


def unit_vectors(spark: SparkSession, base: str) -> DataFrame:
    """(id, v): the usable vectors at length one."""
    return chunk_vectors(spark, base).select("id", F.transform(unit(F.col("v")), lambda x: F.round(x, 6)).alias("v"))


def _halves(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    v = chunk_vectors(spark, base).select("id", F.col("v")[0].alias("x"))
    return v.where("id % 3 < 2").withColumn("source", F.lit("old")), v.where("id % 3 > 0").withColumn("source", F.lit("new"))


def index_add(spark: SparkSession, base: str) -> DataFrame:
    """(id, source) after two thirds have been added to two thirds: each id once, the newer one where both have it."""
    old, new = _halves(spark, base)
    return index.add(old, new.unionByName(new)).select("id", "source")


def index_remove(spark: SparkSession, base: str) -> DataFrame:
    """(id) of what is left after the newer third has been removed."""
    old, new = _halves(spark, base)
    return index.remove(old, new).select("id")


QUERIES = {f.__name__: f for f in (train_sample, train_sample_counts, ivf_topk, hnsw_topk, ivfpq_topk, index_recall, kmeans_lists, unit_vectors, index_add, index_remove)}
ORACLE: dict[str, str] = {
    "unit_vectors": f"SELECT id, list_transform(v, lambda x: round(x, 6)) AS v FROM ({usable_sql('vectors', 'id')})",
    "index_add": f"SELECT id, CASE WHEN id % 3 > 0 THEN 'new' ELSE 'old' END AS source FROM ({usable_sql('vectors', 'id')})",
    "index_remove": f"SELECT id FROM ({usable_sql('vectors', 'id')}) WHERE id % 3 = 0",
    "train_sample_counts": "SELECT paper_id, least(count(*), 16) AS n FROM (SELECT DISTINCT id FROM vectors WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0) v JOIN chunks c ON c.chunk_id = v.id GROUP BY paper_id",
}
