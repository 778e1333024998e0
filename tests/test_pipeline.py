import pytest
from pyspark.sql import functions as F

from tesserae import pipeline
from tesserae.config import BuildConfig, QueryConfig
from tesserae.operators import index
from tesserae.operators.vectors import topk, usable
from tests.test_store import PARA, article, put


def doc(pmcid, title, topic, n):
    return article(pmcid, pmcid[3:], title, n).replace((PARA % 0).encode(), f"{topic} was studied at length in many patients and in cells.".encode())


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    d = tmp_path_factory.mktemp("tars")
    put(d / "a.tar", [("hiv.xml", doc("PMC1", "HIV entry requires CD4", "Viral entry through CD4", 3)), ("egfr.xml", doc("PMC2", "Kinase inhibition by gefitinib", "Gefitinib resistance", 2))])
    put(d / "b.tar", [("mal.xml", doc("PMC3", "Malaria in children", "Plasmodium falciparum", 2)), ("hiv2.xml", doc("PMC1", "HIV entry requires CD4", "Viral entry through CD4", 3))])
    return d


class Cites:
    def generate(self, prompt, system, max_out):
        return "It does 【1】, see [1;2]."


def test_build_update_ask(spark, tmp_path, archives):
    ws = pipeline.Workspace(spark, str(tmp_path / "ws"))
    pipeline.build(ws, [str(archives / "a.tar")])
    assert (ws.read("papers").count(), ws.read("files").count(), ws.read("paper_vectors").count()) == (2, 2, 2)
    ids = {r.pmcid: r.paper_id for r in ws.read("papers").collect()}
    pipeline.build(ws, [str(archives / "a.tar"), str(archives / "b.tar")], config=BuildConfig(update=True))
    papers = {r.pmcid: r.paper_id for r in ws.read("papers").collect()}
    assert set(papers) == {"PMC1", "PMC2", "PMC3"} and papers.items() >= ids.items()
    assert ws.read("files").count() == 4 and ws.read("chunks").count() == ws.read("chunks").select("paper_id", "ord").distinct().count()
    # every passage has a vector, and the flags say what the indexes hold
    assert ws.read("chunk_vectors").count() == ws.read("chunks").count() == ws.read("chunks").where("in_index").count()
    assert {r.id for r in ws.index("chunk", 64)[0].collect()} == {r.chunk_id for r in ws.read("chunks").collect()} and ws.index("paper", 64)[0].count() == 3
    assert ws.meta()["cycle"] == {"members": 2, "parsed": 2, "failed": 0, "papers": 2, "chunks": 2, "chunks_a_paper": 1.0}
    pipeline.build(ws, [str(archives / "a.tar")], config=BuildConfig(update=True))
    assert ws.meta()["cycle"]["members"] == 0 and ws.read("papers").count() == 3
    # what no pointer names any more is deleted
    assert ws.shared.names(f"{ws.path}/chunk_index") == ["v1", "v2"] and ws.shared.names(f"{ws.path}/v0") == []
    q = spark.createDataFrame([(1, "How does CD4 let HIV enter?"), (2, "What is known of gefitinib resistance?")], "qid long, question string")
    passages, packed = pipeline.ask(ws, q, config=QueryConfig(top_papers=2, top_chunks=4, min_chunks_per_paper=0))
    first = {r.qid: r.paper_id for r in passages.where("pos = 0").collect()}
    assert first == {1: papers["PMC1"], 2: papers["PMC2"]}
    got = {r.qid: r for r in pipeline.answers(passages, q, Cites()).collect()}
    assert got[1].answer.startswith("It does [1], see [1") and got[1].references.startswith("References\n[1] HIV entry requires CD4.. PMCID: PMC1")
    assert not ws.wipe(lambda: False) and ws.wipe(lambda: True) and ws.read("papers").count() == 0
    with pytest.raises(RuntimeError):
        ws.wipe(lambda: True, unread_segments=1)


def test_archives_as_they_are_announced(spark, tmp_path, archives):
    ws, inbox = pipeline.Workspace(spark, str(tmp_path / "ws")), tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "one.txt").write_text(f"# first\n{archives}/a.tar\n")
    go = lambda: pipeline.follow(ws, str(inbox), str(tmp_path / "ck"))
    go()
    assert ws.read("papers").count() == 2 and ws.meta()["version"] == 0
    (inbox / "two.txt").write_text(f"{archives}/b.tar\n\n")
    go()
    go()
    assert ws.read("papers").count() == 3 and ws.meta()["version"] == 1


def test_added_rows_cost_only_themselves(spark, tmp_path, monkeypatch):
    ws = pipeline.Workspace(spark, str(tmp_path / "ws"))
    for i in range(4):
        put(tmp_path / f"{i}.tar", [("x.xml", doc(f"PMC{i}", f"Title {i} of kinases", f"Topic {i}", 2))])
    pipeline.build(ws, [str(tmp_path / "0.tar")])
    for i in (1, 2):
        pipeline.build(ws, [str(tmp_path / f"{j}.tar") for j in range(i + 1)], config=BuildConfig(update=True))
    assert ws.meta()["dirs"]["chunks"] == ["v0/chunks", "v1/chunks", "v2/chunks"] and ws.read("papers").count() == 3
    assert ws.read("chunks").where("NOT in_index").count() == 0 and ws.index("chunk", 64)[0].count() == ws.read("chunks").count() == ws.read("chunk_vectors").count()
    assert sorted(r.paper_id for r in ws.read("papers").collect()) == [1, 2, 3]
    monkeypatch.setattr(pipeline, "MOST_PARTS", 3)
    pipeline.build(ws, [str(tmp_path / "3.tar")], config=BuildConfig(update=True))
    assert ws.meta()["dirs"]["chunks"] == ["v3/chunks"] and ws.read("papers").count() == 4 and ws.read("files").count() == 4
    # a changed member replaces its paper, under the same id
    put(tmp_path / "3.tar", [("x.xml", doc("PMC3", "Another title of kinases", "Topic 3", 3))])
    pipeline.build(ws, [str(tmp_path / "3.tar")], config=BuildConfig(update=True))
    assert {r.paper_id: r.title for r in ws.read("papers").collect()}[4] == "Another title of kinases" and ws.read("files").count() == 4 and ws.meta()["dirs"]["papers"] == ["v4/papers"]
    assert ws.index("chunk", 64)[0].count() == ws.read("chunks").count()


def test_producers_and_consumer(spark, tmp_path, archives):
    shards = [pipeline.Workspace(spark, str(tmp_path / f"s{i}")) for i in range(2)]
    for i, (s, a) in enumerate(zip(shards, "ab", strict=True)):
        pipeline.build(s, [str(archives / f"{a}.tar")], config=BuildConfig(role="producer", shard_id=i, num_shards=2))
        pipeline.mark_done(spark, str(tmp_path), i)
    assert pipeline.wait_for(spark, str(tmp_path), 2, timeout=1) and not pipeline.wait_for(spark, str(tmp_path), 3, timeout=0.1, poll=0.1)
    ws = pipeline.Workspace(spark, str(tmp_path / "all"))
    with pytest.raises(RuntimeError):
        shards[0].wipe(lambda: True)
    got = pipeline.consume(ws, [*shards, pipeline.Workspace(spark, str(tmp_path / "none"))])
    assert [s["accepted"] for s in got["shards"].values()] == [2, 1] and got["segments"]["00000001"]["unresolved"] == 3 and got["segments"]["00000000"]["taken"] == 2
    assert ws.read("chunks").where("NOT in_index").count() == 0 and len(pipeline.waiting(spark, shards[0].segments)) == 0
    assert {r.pmcid for r in ws.read("papers").collect()} == {"PMC1", "PMC2", "PMC3"} and ws.read("paper_vectors").count() == 3
    assert ws.read("chunk_vectors").join(ws.read("chunks").withColumnRenamed("chunk_id", "id"), "id").count() == ws.read("chunk_vectors").count()


def test_index_answers(spark, tmp_path):
    """A store large enough for lists: its index finds what the exact search finds, and follows removals."""
    n, width = 3000, 16
    rows = [(i, [float((i * 7919 + j * j * 31) % 97) / 97 - 0.5 + (i % 40 == j) * 3 for j in range(width)]) for i in range(n)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    of = v.select("id", F.col("id").alias("paper_id"))
    empty = (spark.createDataFrame([], "id long, v array<float>, list int"), index.Model("flat", width))
    ix, model = pipeline.refresh_index(v, empty, of, width, "ivf")
    assert model.kind == "ivf" and ix.count() == n
    u = usable(v, "id", "embedding", width)
    q = u.where("id % 50 = 0")
    assert index.recall(index.search(q, ix, model, 10), topk(q, u, 10, width)).first().recall > 0.9
    ws = pipeline.Workspace(spark, str(tmp_path / "ws"))
    ws.write({"chunk_vectors": v}, {"chunk": (ix, model)})
    stored = pipeline._finder(ws, "chunk", u, width)(q, 10)
    assert index.recall(stored, topk(q, u, 10, width)).first().recall > 0.9 and ws.index("chunk", width)[1].kind == "ivf"
    coded, pq = pipeline.refresh_index(v, (empty[0], index.Model("flat", width)), of, width, "ivfpq")
    assert pq.kind == "flat" and coded.count() == n  # too few for codes
    less, same = pipeline.refresh_index(v.where("id % 3 > 0"), (ix, model), of, width, "ivf")
    assert same is model and less.count() == 2000 and less.where("id % 3 = 0").count() == 0
    more, same = pipeline.refresh_index(v, (less, model), of, width, "ivf")
    assert same is model and more.count() == n
