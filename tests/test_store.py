import io
import random
import socket
import tarfile

import pytest
from pyspark.sql import functions as F

from tesserae import answering, config
from tesserae.operators import ranking, store
from tesserae.operators.build import build_store
from tesserae.sources import archives, segments, xml
from tesserae.sources.shared import SharedFiles
from tesserae.streaming.ingest import VersionedTable, drain, file_stream


def greedy(rows):
    taken, out = set(), []
    for r in sorted(rows):
        keys = {(i, v) for i, v in enumerate(r[2:]) if v}
        if not keys & taken:
            taken |= keys
            out.append(r[:2])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_identity_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    v = lambda n: rng.choice([None, "", *[f"k{i}" for i in range(n)]])
    rows = [(f"s{rng.randrange(3)}", i, v(12), v(9), v(9)) for i in range(25)]
    df = spark.createDataFrame(rows, "shard string, paper_id long, doc_id string, pmcid string, pmid string")
    want = greedy(rows)
    got = sorted((r.new_id, r.shard, r.paper_id) for r in store.merge_papers(df).collect())
    assert [(s, p) for _, s, p in got] == want and [n for n, _, _ in got] == list(range(1, len(want) + 1))


def test_bin_packing(spark):
    sizes = [10, 100, 30, 90, 20, 80, 40, 70, 50, 60]
    df = spark.createDataFrame([(f"t{i}", s) for i, s in enumerate(sizes)], "path string, size long")
    a = store.assign_shards(df, "path", "size", 3)
    assert sorted(r.load for r in store.shard_loads(a).collect()) == [180, 180, 190]
    assert {r.shard for r in store.assign_shards(df, "path", "size", 1).collect()} == {0}
    assert store.assign_shards(df.limit(0), "path", "size", 3).count() == 0


def test_upserts(spark):
    now = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "path string, size long, mtime double")
    new = spark.createDataFrame([("b", 3, 3.0), ("b", 9, 1.0), ("c", 4, None)], "path string, size long, mtime double")
    key = lambda df: sorted((r.path, r.size) for r in df.collect())
    assert key(store.upsert(now, new, ["path"], F.desc("mtime"))) == [("a", 1), ("b", 3), ("c", 4)]
    assert key(store.insert_missing(now, new, ["path"], F.desc("mtime"))) == [("a", 1), ("b", 2), ("c", 4)]
    seen = spark.createDataFrame([("a", 1, 1.0 + 1e-9), ("b", 2, 2.1), ("c", None, None)], "path string, size long, mtime double")
    assert key(store.to_process(now, seen)) == [("b", 2)] and store.to_process(now, seen, rebuild=True).count() == 2
    m = spark.createDataFrame([("t", 0), ("t", 1), ("u", 0)], "tar string, member_seq long")
    assert store.after_checkpoint(m, spark.createDataFrame([("t", 1)], "tar string, members_done long")).count() == 2


def test_segments_and_flags(spark, tmp_path):
    p = spark.createDataFrame([(1, "d1"), (2, "")], "paper_id long, doc_id string")
    c = spark.createDataFrame([(10, 1, 0, True), (11, 1, 0, None), (12, 2, 0, True)], "chunk_id long, paper_id long, ord int, in_index boolean")
    s = spark.createDataFrame([("d1", 0, [1.0]), ("d1", 5, [2.0]), ("zz", 0, [3.0])], "paper_doc_id string, ord int, vec array<float>")
    at = f"{tmp_path}/seg"
    half = segments.write_segments(s, at, "chunk", half=True)
    assert sorted(r.vec for r in segments.read_segments(spark, f"{at}/{half}", "chunk").collect()) == [[1.0], [2.0], [3.0]]
    name = segments.write_segments(s, at, "chunk")
    with pytest.raises(ValueError):
        segments.read_segments(spark, f"{at}/{name}", "paper")
    s.withColumnsRenamed({"paper_doc_id": "doc_ids", "ord": "ords", "vec": "vecs"}).write.parquet(f"{at}/chunk-old")
    assert segments.read_segments(spark, f"{at}/chunk-old", "chunk").count() == 3
    assert segments.waiting(spark, at, "chunk") == sorted([half, name, "chunk-old"]) and segments.waiting(spark, at, "paper") == []
    s = segments.read_segments(spark, f"{at}/{name}", "chunk")
    assert [r.chunk_id for r in store.resolve_segments(s, p, c).collect()] == [11]
    assert sorted((r.paper_doc_id, r.ord) for r in store.unresolved_segments(s, p, c).collect()) == [("d1", 5), ("zz", 0)]
    ids = spark.createDataFrame([(10,), (11,), (99,)], "id long")
    assert sorted((r.chunk_id, r.was, r["is"]) for r in store.flag_changes(c, ids, "chunk_id").collect()) == [(11, False, True), (12, True, False)]
    assert {r.chunk_id: r.in_index for r in store.reconcile(c, ids, "chunk_id").collect()} == {10: True, 11: True, 12: False}
    assert [r.chunk_id for r in store.backfill(c, ids, "chunk_id").collect()] == [12]
    assert store.replace_chunks(c, c.where("paper_id = 1").limit(1)).count() == 2
    assert segments.build_step({}, 2, "multi") == "fresh" and segments.build_step({"mode": "multi", "num_shards": 2}, 3, "multi") == "reshard"
    with pytest.raises(ValueError):
        segments.build_step({"mode": "single"}, 1, "multi")
    files = SharedFiles(spark)
    files.write_json(str(tmp_path / "x" / "c.json"), {"a": 1})
    files.write_json(str(tmp_path / "x" / "c.json"), {"a": 2})
    assert files.read_json(str(tmp_path / "x" / "c.json")) == {"a": 2} and files.read_json("/nowhere") == {}


PARA = "This paragraph has rather more than forty characters in it, number %d."


def article(pmcid, pmid, title, n, extra=""):
    body = "".join(f"<p>{PARA % i} <i>in</i><b>line</b></p>" for i in range(n))
    return f'<article xmlns="urn:x"><front><article-meta><article-id pub-id-type="pmcaid">no</article-id><article-id pub-id-type="PMCID">{pmcid}</article-id><article-id pub-id-type="pmid">{pmid}</article-id><title-group><article-title>{title}</article-title></title-group><abstract><p>An  abstract.</p></abstract></article-meta></front><body><sec>{body}<fig><caption><p>{PARA % 99}</p></caption></fig></sec></body><back><ref-list><p>{PARA % 98}</p></ref-list>{extra}</back></article>'.encode()


def test_markup():
    a = xml.parse(article("PMC1", "7", " A <i>b</i>  c ", 2))
    assert (a["pmcid"], a["pmid"], a["title"], a["abstract"], len(a["paragraphs"])) == ("PMC1", "7", "A b  c", "An abstract.", 2)
    assert a["paragraphs"][0].endswith("number 0. in line")
    c = xml.parse(b"<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>5</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>x</AbstractText><AbstractText>y</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>")
    assert (c["pmid"], c["title"], c["abstract"], c["paragraphs"]) == ("5", "T", "x y", [])
    assert xml.parse(b"") is None and xml.parse(None) is None and xml.parse(b"plain") is None and xml.parse(b"<article/>") is None
    broken = xml.parse(article("PMC1", "7", "T &unknown; 1 < 2 <b>open", 1).replace(b"</article>", b""))
    assert broken["pmcid"] == "PMC1" and broken["title"].startswith("T") and len(broken["paragraphs"]) == 1
    bomb = xml.parse(b'<!DOCTYPE a [<!ENTITY x "boom">]>' + article("PMC2", "8", "T &x;", 1))
    assert bomb["title"] == "T" and "boom" not in str(bomb)


def put(path, members, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, data in members:
            i = tarfile.TarInfo(name)
            i.size, i.mtime = len(data), 1700000000
            t.addfile(i, io.BytesIO(data))


def test_archives_to_store(spark, tmp_path):
    hiv, egfr = article("PMC100001", "900001", "HIV entry", 6), article("PMC100002", "900002", "EGFR", 4)
    put(tmp_path / "a.tar", [("x/hiv.nxml", hiv), ("x/egfr.XML", egfr), ("x/none.xml", b"<article/>"), ("x/readme.txt", b"no")])
    put(tmp_path / "b.tar.gz", [("y/hiv.xml", hiv)], "w:gz")
    (tmp_path / "c.tgz").write_bytes(b"not an archive")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "a.tar.gz.partial").write_text("x")
    (tmp_path / "m.txt").write_text("# all\na.tar # first\nb\na.tar\ngone.tar\nnotes.txt\n")
    found = archives.list_archives(str(tmp_path))
    assert [f.rpartition("/")[2] for f in found] == ["a.tar", "b.tar.gz", "c.tgz"]
    listed, missing = archives.read_manifest(str(tmp_path / "m.txt"))
    assert [f.rpartition("/")[2] for f in listed] == ["a.tar", "b.tar.gz"] and missing == ["gone.tar", "notes.txt"]
    assert {r.tar: r.n for r in archives.member_counts(spark, found).collect()} == {"a.tar": 3, "b.tar.gz": 1}
    arts = archives.read_articles(spark, found)
    s = build_store(arts)
    assert s.papers.count() == 2 and s.files.count() == 3 and s.failed.count() == 2 and s.failed.where("fault IS NOT NULL").first().tar == "c.tgz"
    assert {r.doc_id for r in s.papers.collect()} == {"tar://a.tar!/x/hiv.nxml", "tar://a.tar!/x/egfr.XML"}
    assert s.chunks.select("chunk_id").distinct().count() == s.chunks.count() == 2 + s.chunks.where("ord >= 0").count()
    assert build_store(arts, config.BuildConfig(on_duplicate="append")).papers.count() == 3


def test_stream_restarts(spark, tmp_path):
    src, schema = tmp_path / "in", "path string, n int"
    spark.createDataFrame([("a", 1), ("b", 1)], schema).write.parquet(str(src / "one"))
    t = VersionedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema)
    go = lambda: drain(file_stream(spark, str(src / "*"), t.schema), t.upsert_batch(["path"], F.desc("n")), str(tmp_path / "ck"))
    go()
    spark.createDataFrame([("b", 5), ("c", 1)], schema).write.parquet(str(src / "two"))
    go()
    go()
    assert sorted((r.path, r.n) for r in t.read().collect()) == [("a", 1), ("b", 5), ("c", 1)]


def test_segments_are_claimed_and_set_aside(spark, tmp_path):
    at = str(tmp_path / "seg")
    good = segments.write_segments(spark.createDataFrame([("d1", 0, [1.0]), ("zz", 0, [2.0])], "paper_doc_id string, ord int, vec array<float>"), at, "chunk")
    lost = segments.write_segments(spark.createDataFrame([("zz", 0, [2.0])], "paper_doc_id string, ord int, vec array<float>"), at, "chunk")
    segments.write_segments(spark.createDataFrame([("d1", [2.0])], "doc_id string, vec array<float>"), at, "paper")
    bad = "chunk-broken"
    spark.range(1).write.parquet(f"{at}/{bad}")
    known = spark.createDataFrame([("d1",)], "paper_doc_id string")
    resolve = lambda s: (s.join(known, "paper_doc_id"), s.join(known, "paper_doc_id", "left_anti"))
    with pytest.raises(RuntimeError):
        segments.take_in(spark, at, "chunk", resolve, 0)
    assert segments.claim(spark, at, good) == good + segments.CLAIMED and segments.claim(spark, at, good) is None
    got = segments.take_in(spark, at, "chunk", resolve, 1)
    # what a crash left claimed is taken over
    assert (got.taken, got.unresolved, list(got.failed), got.rows.count()) == ([good + segments.CLAIMED], 1, [bad], 1) and [n.split(".")[0] for n in got.aside] == [lost]
    segments.finish(spark, at, got.taken)
    assert segments.waiting(spark, at, "chunk") == [bad] and SharedFiles(spark).names(f"{at}/quarantine") == [lost] and len(segments.waiting(spark, at)) == 2


def test_config(spark, tmp_path):
    assert config.BuildConfig(role="producer", num_shards=2, shard_id=1).validate()
    for bad in (dict(rebuild=True, update=True), dict(shard_id=3), dict(role="producer"), dict(role="x"), dict(on_duplicate="x")):
        with pytest.raises(ValueError):
            config.BuildConfig(**bad).validate()
    f = tmp_path / "q.txt"
    f.write_text(" why? \n")
    assert config.question_text(None, f"@{f}") == config.question_text(str(f), None) == "why?" and config.question_text(None, "how") == "how"
    assert config.question_text(None, "@nobody knows") == "@nobody knows"
    files = SharedFiles(spark)
    with config.WriterGuard(str(tmp_path / "g"), files), pytest.raises(RuntimeError), config.WriterGuard(str(tmp_path / "g"), files):
        pass
    assert not files.exists(str(tmp_path / "g"))
    files.create_new(str(tmp_path / "g"), f"999999999 {socket.gethostname()} 1")
    with config.WriterGuard(str(tmp_path / "g"), files):
        pass
    files.create_new(str(tmp_path / "g"), "1 elsewhere 1")
    with pytest.raises(RuntimeError), config.WriterGuard(str(tmp_path / "g"), files):
        pass
    p = config.Paths.of({"TESSERAE_HOME": "/h/", "TESSERAE_ARCHIVES": "/a"}, models="/m")
    assert (p.store, p.archives, p.models) == ("/h/store", "/a", "/m")
    assert config.human_bytes(2048) == "2.0 KB"


class Short:
    def __init__(self, most):
        self.most, self.seen = most, []

    def generate(self, prompt, system, max_out):
        self.seen.append((prompt.count("[p]"), max_out))
        if prompt.count("[p]") > self.most:
            raise RuntimeError("maximum context length is less")
        return "ok"


def test_answers(spark):
    rows = spark.createDataFrame([(1, i, i, "[p]", "", "", "x" * 8) for i in range(30)], "qid int, pos int, chunk_id long, paper_title string, pmcid string, pmid string, text string")
    q = spark.createDataFrame([(1, "q"), (2, "r")], "qid int, question string")
    plan = {r.qid: [answering.Attempt(a.blocks, a.max_out) for a in r.attempts] for r in ranking.attempts(rows, q, "", 8000, 3000).collect()}
    assert [(len(a.blocks), a.max_out) for a in plan[1]] == [(30, 3000), (21, 2250), (10, 1687), (5, 1265)]
    assert [(a.blocks, a.max_out) for a in plan[2]][0] == ([], 3000)
    few = ranking.attempts(rows, q.where("qid = 1"), "", 900, 300).first().attempts
    assert [a.blocks for a in few][:1] == [[r.block for r in ranking.pack_context(rows, q, "", 900, 300).orderBy("idx").collect()]] and 0 < len(few[0].blocks) < 30
    p = Short(10)
    assert answering.answer("q", plan[1], p) == ("ok", 10) and p.seen == [(30, 3000), (21, 2250), (10, 1687)]
    with pytest.raises(answering.Overflow):
        answering.answer("q", plan[1], Short(0))
    some = [answering.Attempt(["a", "b"], 9)]
    assert answering.answer("q", some, answering.ContextOnly()) == ("a\n\nb", 2)

    class Refuses:
        def generate(self, *a):
            raise RuntimeError("405 method not allowed")

    assert answering.FirstThatWorks([Refuses(), answering.ContextOnly()]).generate("CONTEXT:\nx", "", 1) == "x"
    with pytest.raises(answering.ModelError):
        answering.answer("q", some, Refuses())
    assert answering.rewrite("q") == "q"
    with pytest.raises(NotImplementedError):
        answering.rewrite("q", "other")
    assert answering.ModelConfig("o3-x").tokens == 32_000 and answering.ModelConfig("y").tokens == 8_000


def test_chain_of_papers_that_share_identifiers(spark):
    # each shares a key with the next: every other one is accepted, in order
    n = 1000
    rows = [("s", i, None, f"c{i // 2}", f"p{(i + 1) // 2}") for i in range(n)]
    df = spark.createDataFrame(rows, "shard string, paper_id long, doc_id string, pmcid string, pmid string")
    got = sorted((r.new_id, r.shard, r.paper_id) for r in store.merge_papers(df).collect())
    assert [(s, p) for _, s, p in got] == greedy(rows) and len(got) == n // 2 and [g[0] for g in got] == list(range(1, n // 2 + 1))


def test_settled_by_rounds_alone(spark, monkeypatch):
    monkeypatch.setattr(store, "SETTLED", 3)
    monkeypatch.setattr(store, "ROUNDS", 1)
    rows = [("s", i, None, f"c{i // 2}", f"p{(i + 1) // 2}") for i in range(14)] + [("t", i, "hot", None, None) for i in range(40)] + [("u", 1, "a", "b", None), ("u", 2, "a", None, None)]
    df = spark.createDataFrame(rows, "shard string, paper_id long, doc_id string, pmcid string, pmid string")
    merged = store.merge_papers(df)
    assert sorted((r.shard, r.paper_id) for r in merged.collect()) == sorted(greedy(rows))
    assert {r.shard: (r.rows, r.accepted, r.refused) for r in store.merge_statistics(df, merged).collect()} == {"s": (14, 7, 7), "t": (40, 1, 39), "u": (2, 1, 1)}


def test_many_archives_are_dealt(spark):
    df = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("path"), (F.col("id") * 7919 % 1000).alias("size"))
    load = [r.load for r in store.shard_loads(store.assign_shards(df, "path", "size", 7)).collect()]
    assert len(load) == 7 and max(load) - min(load) < 1000


def test_damaged_archives_are_reported(spark, tmp_path):
    docs = [(f"{i}.xml", article(f"PMC{i}", str(i), f"Title {random.Random(i).random()}", 3) + random.Random(i).randbytes(3000).hex().encode()) for i in range(40)]
    for ending, mode in ((".tar", "w"), (".tar.gz", "w:gz"), (".tar.xz", "w:xz"), (".tar.bz2", "w:bz2")):
        put(tmp_path / f"good{ending}", docs, mode)
        data = (tmp_path / f"good{ending}").read_bytes()
        for k in range(3):
            cut = len(data) * (k + 1) // 5
            (tmp_path / f"cut{k}{ending}").write_bytes(data[:cut])
            (tmp_path / f"bad{k}{ending}").write_bytes(data[:cut] + bytes(200) + data[cut + 200 :])
    found = archives.list_archives(str(tmp_path))
    counts = {r.tar: r.n for r in archives.member_counts(spark, found).collect()}
    assert all(counts[f"good{e}"] == 40 for e in (".tar", ".tar.gz", ".tar.xz", ".tar.bz2"))
    rows = archives.scan_archives(spark, found).select("tar", "member", "fault", F.length("content").alias("n")).collect()
    assert sum(r.tar.startswith("good") and r.n > 0 for r in rows) == 160
    faulty = {r.tar for r in rows if r.fault}
    assert {f"cut{k}{e}" for k in range(3) for e in (".tar.gz", ".tar.xz", ".tar.bz2")} <= faulty and not any(t.startswith("good") for t in faulty)
    told = {r.tar: r.members for r in archives.archive_faults(spark, found).collect()}
    assert all(m < 40 for m in told.values()) and told["cut2.tar.gz"] > 0
    s = build_store(archives.read_articles(spark, [f for f in found if "cut2.tar.gz" in f]))
    assert s.failed.where("member IS NULL").count() == 1 and told["cut2.tar.gz"] - s.papers.count() in (0, 1)


def test_members_are_dealt_by_their_places(spark, tmp_path):
    put(tmp_path / "big.tar", [(f"{i:03}.xml", b"x" * (i * 50)) for i in range(100)] + [("note.txt", b"no")])
    df = archives.scan_archives(spark, str(tmp_path / "big.tar"), a_task=10)
    got = df.withColumn("p", F.spark_partition_id()).collect()
    assert sorted((r.member_seq, r.member, len(r.content)) for r in got) == [(i, f"{i:03}.xml", i * 50) for i in range(100)] and len({r.p for r in got}) > 5
    assert archives.scan_archives(spark, []).count() == 0
