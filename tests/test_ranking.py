import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import index, ranking
from tesserae.operators import vectors as knn
from tesserae.operators.lexical import Automaton, Contains, Lexical, _by_words, _finder, search
from tesserae.operators.vectors import topk, topk_in_lists
from tesserae.plans import indexes


def ranked(spark, ids, name):
    return spark.createDataFrame([(1, c, i) for i, c in enumerate(ids)], f"qid int, chunk_id long, {name} int")


@pytest.mark.parametrize("lex, ann, k, cap, want", [([1, 2, 3, 4], [2, 5, 6, 1], 5, 2, [1, 2, 5, 6]), ([1, 2], [7, 8], 4, 2, [1, 7, 2, 8]), ([], [3, 4], 1, 5, [3]), ([3], [], 4, 0, [])])
def test_fusion(spark, lex, ann, k, cap, want):
    got = ranking.fuse(ranked(spark, lex, "lex_rank"), ranked(spark, ann, "ann_rank"), k, cap).orderBy("pos").collect()
    assert [r.chunk_id for r in got] == want


def test_cap(spark):
    df = spark.createDataFrame([(1, i + 1, p, i) for i, p in enumerate("aababc")], "qid int, chunk_id long, paper_id string, pos int")
    assert [r.chunk_id for r in ranking.cap_per_paper(df, 2).orderBy("pos").collect()] == [1, 2, 3, 5, 6]
    assert ranking.cap_per_paper(df, 0).count() == 6


LEX = [(10, 1, 0, "body mentions IL–6 (en dash)"), (11, 2, 0, "il-6 plain"), (12, 2, -1, "abstract about IL-6"), (13, 3, 0, "no match"), (14, 3, 1, "IL-6 again"), (15, 1, 1, "IL-60 (substring hit)")]


@pytest.mark.parametrize("backend", [Contains(), Automaton(), Automaton(block=1, most=0)])
def test_lexical_order(spark, backend):
    chunks = spark.createDataFrame(LEX, "chunk_id long, paper_id long, ord int, text string")
    papers = spark.createDataFrame([(1, "Unrelated title", "1", "P1"), (2, "IL-6 in fibrosis", "2", "P2"), (3, "Another paper", "3", "P3")], "paper_id long, title string, pmid string, pmcid string")
    q = spark.createDataFrame([(7, ["il-6"]), (8, ["il-6", "plain"]), (9, [])], "qid int, terms array<string>")
    got = search(q, chunks, papers, Lexical(), None, backend).orderBy("qid", "lex_rank").collect()
    assert [r.chunk_id for r in got if r.qid == 7] == [12, 11, 10, 14, 15] and {r.qid for r in got} == {7, 8}
    cand = spark.createDataFrame([(7, 3)], "qid int, paper_id long")
    assert [r.chunk_id for r in search(q, chunks, papers, Lexical(), cand, backend).collect()] == [14]
    assert search(q, chunks, papers, Lexical(enabled=False), None, backend).count() == 0


def test_finding_without_the_library():
    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("ab-") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    for _ in range(40):
        text = "".join(rng.choice("ab- ") for _ in range(rng.randint(0, 40)))
        assert _by_words(terms)(text) == _finder(terms)(text) == {x for x in terms if x in text}


def straight(fused, ann, wider, paper, k, cap):
    out, n = [], {}
    for c in fused:
        if n.get(paper[c], 0) < cap:
            out.append(c)
            n[paper[c]] = n.get(paper[c], 0) + 1
    for pool in [ann, *wider]:
        for c in pool:
            if len(out) < k and c not in out and n.get(paper[c], 0) < cap:
                out.append(c)
                n[paper[c]] = n.get(paper[c], 0) + 1
    return out


def test_fill_equals_a_loop(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for q in range(60):
        ids = rng.sample(range(40), 30)
        paper = {c: c % rng.randint(2, 9) for c in range(40)}
        k, cap = 8, 2
        fused, ann, w2, w3 = rng.sample(range(40), 8), ids[:10], ids[10:20], ids[20:30]
        want[q] = straight(fused, ann, [w2, w3], paper, k, cap)
        rows += [(q, c, paper[c], s, i) for s, part in enumerate((fused, ann, w2, w3)) for i, c in enumerate(part)]
    df = spark.createDataFrame(rows, "qid int, chunk_id long, paper_id long, segment int, rank int")
    got = {}
    for r in ranking.capped_and_filled(df, 8, 2).orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    assert got == want


def test_scopes_and_averages(spark):
    chunks = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2)], "chunk_id long, paper_id long")
    short = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 9)], "qid int, paper_id long")
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    assert {r.qid: r.avg_chunks for r in ranking.average_chunks(short, chunks).collect()} == {1: 2.0, 2: 0.5}
    got = {r.qid: (r.ann_scope, r.lexical_scope) for r in ranking.scopes(q, short, chunks).collect()}
    assert got == {1: ("candidates", "candidates"), 2: ("global", "global"), 3: ("global", "none")}
    assert {r.lexical_scope for r in ranking.scopes(q, short, chunks, force_global=True).collect()} == {"global"}


def test_context(spark):
    p = spark.createDataFrame([(1, 0, 5, " T ", "", "9", "x" * 400), (1, 1, 6, "U", "PMC1", "8", "y" * 4000), (1, 2, 7, "V", "", "", "z")], "qid int, pos int, chunk_id long, paper_title string, pmcid string, pmid string, text string")
    q = spark.createDataFrame([(1, "why?"), (2, "how?")], "qid int, question string")
    got = ranking.pack_context(p, q, "prompt", 600, 100).collect()
    assert [(r.idx, r.block[:14]) for r in got] == [(1, "[1] T (PMID:9)")]
    ctx = {r.qid: (r.context[:5], r.n_used) for r in ranking.contexts(ranking.pack_context(p, q, "prompt", 600, 100), q).collect()}
    assert ctx == {1: ("[1] T", 1), 2: ("(no c", 0)}


def test_retries(spark):
    r = spark.range(1).select(ranking.retry_schedule(F.lit(30), F.lit(3000)).alias("x")).first().x
    assert [(s.chunks, s.max_out) for s in r] == [(30, 3000), (21, 2250), (10, 1687), (5, 1265)]


def vectors(spark, m):
    return spark.createDataFrame([(i * 7 + 3, x.tolist()) for i, x in enumerate(m)], "id long, v array<float>")


def test_exact_and_approximate_search(spark, tmp_path):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((3000, 32)).astype(np.float32)
    df = vectors(spark, m).cache()
    q = df.where("id % 50 = 0")
    exact = topk(q, df, 10, 32).cache()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    first = exact.orderBy("qid", "rank").collect()[:10]
    i = (first[0].qid - 3) // 7
    assert [r.id for r in first] == [int(j) * 7 + 3 for j in np.argsort(-(u[i] @ u.T), kind="stable")[:10]]
    for kind, nlist, probes, least in (("ivf", 16, 1, 0.1), ("ivf", 16, 12, 0.9), ("hnsw", 64, None, 0.9), ("ivfpq", 16, 16, 0.9)):
        model = index.train(df, 32, kind, nlist=nlist, m=16, forced=True)
        rows = index.assign(df, model)
        edges = index.graph(rows, model).cache() if kind == "hnsw" else None
        found = index.search(q, index.indexed_rows(df, model), model, 10, probes, rerank=df if model.m else None, wider=5, edges=edges)
        assert index.recall(found, exact).first().recall >= least, kind
        if edges is not None:
            assert edges.groupBy("id").count().agg(F.max("count")).first()[0] <= 32 and edges.where("id = to").count() == 0
            index.save(rows, model, str(tmp_path / "graph"), edges=edges)
            assert index.load_edges(spark, str(tmp_path / "graph")).count() == edges.count()
    # codes alone are scored by look-up as the vectors that they stand for are
    codes = index.indexed_rows(df, model)
    rough = index.search(q.limit(3), codes, model, 5, 16).collect()
    code = {r.id: (r.list, list(r.code)) for r in codes.collect()}
    for r in rough:
        at, c = code[r.id]
        stands = model.centroids[at] + np.concatenate([model.codebook[i][x] for i, x in enumerate(c)])
        assert abs(r.score - float(u[(r.qid - 3) // 7] @ stands)) < 1e-6
    assert index.plan(spark, 3000, 32, "ivfpq")[0] == "flat" and index.plan(spark, 3000, 32, "ivf") == ("ivf", 219, 0) and index.plan(spark, 100, 32, "hnsw")[0] == "flat"
    index.save(index.encode(rows, model), model, str(tmp_path / "ix"))
    back, again = index.load(spark, str(tmp_path / "ix"))
    assert again.kind == "ivfpq" and np.allclose(again.codebook, model.codebook) and back.count() == 3000
    assert index.describe(spark, str(tmp_path / "ix")).first().ntotal == 3000
    assert index.add(df, df.limit(5)).count() == 3000 and index.remove(df, df.limit(5)).count() == 2995
    assert index.train(df.limit(10), 32, "ivfpq", nlist=16, m=16, forced=True).kind == "flat"
    assert index.search(q.limit(1), df, index.Model("flat", 32), 3).count() == 3
    empty, flat = index.load_or_create(spark, str(tmp_path / "new"), 32)
    assert empty.count() == 0 and flat.kind == "flat" and index.search(q.limit(1), empty, flat, 3).count() == 0


def test_training_holds_blocks_of_products(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20_000, 8))
    c = x[:1000]
    assert (index._closest(x[:3000], c) == (x[:3000] @ c.T).argmax(1)).all()
    assert (index._closest(x[:3000], c, False) == ((x[:3000, None] - c[None]) ** 2).sum(2).argmin(1)).all()
    for cosine in (True, False):
        tracemalloc.start()
        index._means(x, 1000, 1, np.random.default_rng(2), cosine)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # all products at once are 160 MB
        assert peak < 60e6
    # several blocks in a task
    rows = {r.id: r.list for r in index.assign(vectors(spark, x[:5000].astype(np.float32)).coalesce(1), index.Model("ivf", 8, c)).collect()}
    assert [rows[i * 7 + 3] for i in range(5000)] == (x[:5000].astype(np.float32).astype(np.float64) @ c.T).argmax(1).tolist()
    two = index.assign(vectors(spark, x[:5000].astype(np.float32)).coalesce(1), index.Model("ivf", 8, c), 2)
    assert two.count() == 10_000 and two.join(two.groupBy("id").agg(F.count_distinct("list").alias("n")).where("n <> 2"), "id").count() == 0


def test_training_gathers_the_sample_only(spark):
    df = vectors(spark, np.eye(8, dtype=np.float32).repeat(50, 0)).cache()
    of = df.select("id", F.pmod("id", F.lit(40)).alias("paper_id"))
    sample = index.training_sample(df, of, 100, 5)
    # a root that takes ordered rows sends the first 100 of each task to the driver
    assert not re.match(r"\W*(AdaptiveSparkPlan[^\n]*\W+)?TakeOrdered", sample.limit(500)._jdf.queryExecution().executedPlan().toString())
    rows = sample.collect()
    first = df.join(of, "id").orderBy(F.xxhash64("id", F.lit(314159)), "id").limit(100).collect()
    assert len(rows) == 100 and {(r.id, *r.v) for r in rows} == {(r.id, *r.v) for r in first}
    assert index.train(sample.limit(0), 8, "ivf").kind == "flat"


@pytest.mark.parametrize("share, held", [(4096, 1 << 16), (64, 100)])
def test_lists_in_cells(spark, monkeypatch, share, held):
    """Crowded lists are several cells; copies are ties, of which the smaller ids stay; floors leave the same neighbours."""
    monkeypatch.setattr(knn, "SHARE", share)
    monkeypatch.setattr(knn, "HELD", held)
    rng = np.random.default_rng(3)
    m = rng.standard_normal((1200, 16)).astype(np.float32)
    m[:60] = m[0]
    df = vectors(spark, m)
    model = index.Model("hnsw", 16, rng.standard_normal((6, 16)))
    rows = index.assign(df, model).cache()
    probed = index.assign(df, model, 3)
    lists = {r.id: r.list for r in rows.collect()}
    probes = {}
    for r in probed.collect():
        probes.setdefault(r.id, set()).add(r.list)
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    want = set()
    for i in range(len(m)):
        q = i * 7 + 3
        near = sorted((-sim[i, j], j * 7 + 3) for j in range(len(m)) if j != i and lists[j * 7 + 3] in probes[q])
        want |= {(q, c, rank) for rank, (_, c) in enumerate(near[:5])}
    for queries in (probed, index.assign(knn.floored(rows, 6, 16), model, 3)):
        assert {(r.qid, r.id, r.rank) for r in topk_in_lists(queries, rows, 5, 16, skip_self=True).collect()} == want
    edges = index.graph(rows, model, 5)
    assert edges.groupBy("id").count().agg(F.max("count")).first()[0] <= 10 and edges.count() == edges.distinct().count()


def test_lists_meet_in_little_memory():
    import pyarrow as pa

    x = np.random.default_rng(4).standard_normal((6000, 8)).astype(np.float32)
    v = pa.ListArray.from_arrays(np.arange(0, 8 * 6000 + 1, 8, dtype=np.int32), x.ravel())
    ids = np.arange(6000)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.zeros(6000, np.int64)), pa.array(np.full(6000, side, np.int32)), pa.array(ids), v, pa.array(np.full(6000, -2.0))], names=["cell", "side", "id", "v", "floor"]) for side in (0, 1)]
    tracemalloc.start()
    n = sum(rb.num_rows for rb in knn._in_lists(10, 8)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all products at once are 288 MB
    assert n == 60_000 and peak < 80e6


def test_recall_trains_once_for_a_kind_of_model(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((1500, 64)).astype(np.float32)
    vectors(spark, m).select("id", F.col("v").alias("embedding")).write.parquet(f"{tmp_path}/vectors.parquet")
    vectors(spark, m).select(F.col("id").alias("chunk_id"), F.pmod("id", F.lit(300)).alias("paper_id")).write.parquet(f"{tmp_path}/chunks.parquet")
    made, train = [], index.train
    monkeypatch.setattr(index, "train", lambda *a, **kw: made.append(train(*a, **kw)) or made[-1])
    got = {r.kind: r for r in indexes.index_recall(spark, str(tmp_path)).collect()}
    # six samples came to the driver when each search and each share trained anew
    assert [x.kind for x in made] == ["ivf", "ivfpq"] and [*got] == ["ivf", "hnsw", "ivfpq"]
    q = indexes.chunk_vectors(spark, str(tmp_path))
    exact = topk(q.where("id % 50 = 0"), q, 10, 64).cache()
    for kind, f in (("ivf", indexes.ivf_topk), ("hnsw", indexes.hnsw_topk), ("ivfpq", indexes.ivfpq_topk)):
        assert got[kind].recall == index.recall(f(spark, str(tmp_path)), exact).first().recall and 0 < got[kind].share < 1


def test_pairs_are_scored_by_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(6)
    m = rng.standard_normal((400, 8)).astype(np.float32)
    df = vectors(spark, m)
    pairs = {(int(q) * 7 + 3, int(c) * 7 + 3) for q, c in rng.integers(0, 400, (3000, 2)) if q % 4 == 0}
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(q, c): float(u[(q - 3) // 7] @ u[(c - 3) // 7]) for q, c in pairs}
    asked = df.where("pmod((id - 3) / 7, 4) = 0")
    for most in (8192, 30):
        monkeypatch.setattr(index, "ASKED", most)
        got = index.rescored(spark.createDataFrame(sorted(pairs), "qid long, id long"), asked, df, 8).collect()
        assert len(got) == len(want) and all(abs(r.score - want[r.qid, r.id]) < 1e-8 for r in got)
