"""Whole runs: create a store, build or update it from archives, merge what other machines built, ask questions."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.answering import PROMPT, Attempt, Embedder, ModelConfig, Provider, WordEmbedder, answer
from tesserae.config import BuildConfig, QueryConfig, WriterGuard
from tesserae.functions import citations
from tesserae.functions.parameters import top_papers
from tesserae.functions.text import question_terms, rare_terms
from tesserae.operators import index, ranking
from tesserae.operators.build import Store, build_store
from tesserae.operators.lexical import Backend, Lexical
from tesserae.operators.store import backfill, match_identity, merge_children, merge_papers, merge_statistics, reconcile, resolve_segments, to_process, unresolved_segments
from tesserae.operators.vectors import topk, usable
from tesserae.session import materialize
from tesserae.sources.archives import member_uri, read_articles, scan_archives
from tesserae.sources.segments import build_step, finish, take_in, waiting, write_segments
from tesserae.sources.shared import SharedFiles
from tesserae.streaming.ingest import drain

SCHEMAS = {
    "papers": "paper_id long, doc_id string, pmid string, pmcid string, title string, abstract string, in_index boolean",
    "chunks": "chunk_id long, paper_id long, ord int, text string, in_index boolean",
    "files": "path string, size long, mtime double, paper_id long",
    "paper_vectors": "id long, embedding array<float>",
    "chunk_vectors": "id long, embedding array<float>",
    "failures": "tar string, member string, doc_id string, fault string",
}
INDEXES = ("paper", "chunk")
#: Vectors that an index is fitted on at most, and vectors of a paper that are expected.
SAMPLE, EXPECTED = 50_000, 20


#: Directories of one table at most; beyond that it is written anew as one.
MOST_PARTS = 64


class Workspace:
    """The store's directory: tables of one or more directories, indexes in versions, a pointer that names them, one writer.

    A version's directories are written before the pointer turns; what the pointer named before stays for those who
    still read it, what it named before that is deleted. Rows that are only added cost no more than themselves.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.shared = spark, path.rstrip("/"), SharedFiles(spark)

    @property
    def _pointer(self) -> str:
        return f"{self.path}/current.json"

    def guard(self) -> WriterGuard:
        return WriterGuard(f"{self.path}/writer.guard", self.shared)

    def _read(self, name: str, dirs: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.path}/{d}" for d in dirs)) if dirs else self.spark.createDataFrame([], SCHEMAS[name])

    def read(self, name: str) -> DataFrame:
        """A table as of the last finished write; empty before the first."""
        return self._read(name, self.meta().get("dirs", {}).get(name, []))

    def index_dir(self, name: str) -> tuple[str, int]:
        return f"{self.path}/{name}_index", self.meta().get("index", {}).get(name, 0)

    def index(self, name: str, width: int) -> tuple[DataFrame, index.Model]:
        """The rows and the model of an index; empty and flat before the first write."""
        at, version = self.index_dir(name)
        return index.load_or_create(self.spark, at, width, version)

    def write(self, tables: dict[str, DataFrame], indexes: dict[str, tuple[DataFrame, index.Model]] | None = None, added: dict[str, DataFrame] | None = None, **meta) -> None:
        """Write a new version: tables are replaced, added rows join what is there, the rest is as it was; then turn the pointer."""
        now, added = self.meta(), added or {}
        v = now.get("version", -1) + 1
        old = now.get("dirs", {})
        dirs, versions = {}, dict(now.get("index", {}))
        for name, schema in SCHEMAS.items():
            df, held = tables.get(name), old.get(name, [])
            if df is None and name in added:
                df = added[name]
                if len(held) >= MOST_PARTS:
                    df, held = self._read(name, held).unionByName(df.select(*[c.split()[0] for c in schema.split(", ")])), []
            else:
                held = held if df is None else []
            if df is not None or not held:
                df = df if df is not None else self.spark.createDataFrame([], schema)
                df.select(*[c.split()[0] for c in schema.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/v{v}/{name}")
                held = [*held, f"v{v}/{name}"]
            dirs[name] = held
        for name, got in (indexes or {}).items():
            index.save(*got, f"{self.path}/{name}_index", v)
            versions[name] = v
        before = {"dirs": sum(old.values(), []), "index": [f"{n}_index/v{x}" for n, x in now.get("index", {}).items()]}
        self.shared.write_json(self._pointer, now | meta | {"version": v, "dirs": dirs, "index": versions, "before": before})
        kept = {*sum(dirs.values(), []), *before["dirs"], *before["index"], *(f"{n}_index/v{x}" for n, x in versions.items())}
        last = now.get("before", {})
        for stale in {*last.get("dirs", []), *last.get("index", [])} - kept:
            self.shared.delete(f"{self.path}/{stale}")

    def meta(self) -> dict:
        return self.shared.read_json(self._pointer)

    @property
    def segments(self) -> str:
        return f"{self.path}/segments"

    def wipe(self, confirm: Callable[[], bool], unread_segments: int = 0) -> bool:
        """Remove everything, if confirm says so; refused while segments of other machines wait."""
        unread_segments = unread_segments or len(waiting(self.spark, self.segments))
        if unread_segments:
            raise RuntimeError(f"{unread_segments} segment files have not been taken in")
        if not confirm():
            return False
        self.shared.delete(self.path)
        return True


def embed_missing(rows: DataFrame, vectors: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """vectors with those of the rows that had none."""
    new = backfill(rows, vectors, key).where(F.col(text) != "")
    return vectors.unionByName(embedder.encode(new, text, "embedding").select(F.col(key).alias("id"), "embedding"))


def refresh_index(vectors: DataFrame, old: tuple[DataFrame, index.Model], papers_of: DataFrame, width: int, kind: str) -> tuple[DataFrame, index.Model]:
    """An index of exactly the usable vectors (id, embedding): rows that are gone are removed, new ones added.

    The old lists are kept while they fit; an index is trained anew when there is none yet, or when the plan for so many
    vectors has another kind or more than twice its lists. papers_of: id, paper_id, for the training sample.
    """
    v = usable(vectors, "id", "embedding", width)
    rows, model = old
    n = v.count()
    want, lists, _ = index.plan(v.sparkSession, min(n, SAMPLE), width, kind)
    if want != model.kind or lists > 2 * model.nlist:
        model = index.train(index.training_sample(v, papers_of, SAMPLE, EXPECTED), width, kind, most=SAMPLE)
        return index.indexed_rows(v, model), model
    gone = rows.select("id").join(v.select("id"), "id", "left_anti")
    # a vector that was replaced has another value: its row is coded again
    new = v.join(rows.select("id"), "id", "left_anti")
    return index.add(index.remove(rows, gone), index.indexed_rows(new, model)), model


def _indexed(ws: Workspace, tables: dict[str, DataFrame], width: int, kind: str, rebuild: bool, changed: DataFrame | None) -> dict[str, tuple[DataFrame, index.Model]]:
    """Both indexes of the new tables, and in the tables the flags that say what the indexes hold."""
    out = {}
    for name, table, key in (("paper", "papers", "paper_id"), ("chunk", "chunks", "chunk_id")):
        vectors = tables[f"{name}_vectors"] = materialize(tables[f"{name}_vectors"])
        fresh = (ws.spark.createDataFrame([], "id long, v array<float>, list int"), index.Model("flat", width))
        old = fresh if rebuild else ws.index(name, width)
        if changed is not None and not rebuild:
            ids = changed if name == "paper" else tables["chunks"].join(changed.withColumnRenamed("id", "paper_id"), "paper_id", "left_semi").select(F.col("chunk_id").alias("id"))
            old = (index.remove(old[0], ids), old[1])
        rows, model = refresh_index(vectors, old, _papers_of(name, tables["chunks"], vectors), width, kind)
        out[name] = (materialize(rows), model)
        tables[table] = reconcile(tables[table], out[name][0], key)
    return out


def _papers_of(name: str, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.col("id").alias("paper_id")) if name == "paper" else chunks.select(F.col("chunk_id").alias("id"), "paper_id")


def _index_more(ws: Workspace, added: dict[str, DataFrame], width: int, kind: str) -> dict[str, tuple[DataFrame, index.Model]]:
    """Both indexes with the vectors of the added rows, and the flags of these rows; only an index whose plan changes is built anew."""
    out = {}
    for name, table, key in (("paper", "papers", "paper_id"), ("chunk", "chunks", "chunk_id")):
        vectors = added[f"{name}_vectors"] = materialize(added[f"{name}_vectors"])
        rows, model = ws.index(name, width)
        v = usable(vectors, "id", "embedding", width)
        want, lists, _ = index.plan(ws.spark, min(rows.count() + v.count(), SAMPLE), width, kind)
        if want != model.kind or lists > 2 * model.nlist:
            every = ws.read(f"{name}_vectors").unionByName(vectors)
            out[name] = refresh_index(every, (rows.limit(0), index.Model("flat", width)), _papers_of(name, ws.read("chunks").unionByName(added["chunks"]), every), width, kind)
        else:
            out[name] = (index.add(rows, index.indexed_rows(v, model)), model)
        added[table] = reconcile(added[table], v.select("id"), key)
    return out


@dataclass(frozen=True)
class Cycle:
    """What a build did."""

    members: int
    parsed: int
    failed: int
    papers: int
    chunks: int

    @property
    def chunks_a_paper(self) -> float:
        return round(self.chunks / self.papers, 3) if self.papers else 0.0


def cycle_statistics(store: Store) -> Cycle:
    """Counts of one build: markup members seen, parsed and failed, papers accepted and passages made."""
    one = lambda df, c: df.agg(c).first()[0] or 0
    failed = one(store.failed, F.count("*"))
    parsed = one(store.files, F.count("*"))
    return Cycle(parsed + failed, parsed, failed, one(store.papers, F.count("*")), one(store.chunks.where("ord >= 0"), F.count("*")))


def build(ws: Workspace, archives: list[str], embedder: Embedder | None = None, config: BuildConfig = BuildConfig()) -> Store:
    """Build the store from archives, or update it: members known with their size and time are not parsed again.

    A changed member's paper, passages and vectors are replaced; ids of papers that stay do not change. A build that
    stopped is taken up where it was: what is stored is known, the rest is not; with another number of shards than
    before it starts anew. Every passage gets a vector, the title-and-abstract one as well; both indexes are brought up
    to date and the flags follow them. A producer leaves its vectors as segments for the consumer, too.
    """
    config.validate()
    embedder = embedder or WordEmbedder()
    with ws.guard():
        step = build_step(ws.meta().get("build", {}), config.num_shards, config.role)
        rebuild = config.rebuild or step in ("fresh", "reshard")
        known = ws.read("files")
        heads = scan_archives(ws.spark, archives, content=False).where("fault IS NULL").withColumn("path", member_uri(F.col("tar"), F.col("member")))
        fresh = to_process(heads.select("path", "size", "mtime"), known, rebuild).select(F.col("path").alias("doc_id"))
        found = read_articles(ws.spark, archives)
        articles = found.where("fault IS NULL").join(fresh, "doc_id", "left_semi").unionByName(found.where("fault IS NOT NULL"))
        store = build_store(articles, config)
        cycle = cycle_statistics(store)
        meta = {"build": {"num_shards": config.num_shards, "mode": config.role}, "cycle": vars(cycle) | {"chunks_a_paper": cycle.chunks_a_paper}, "width": embedder.width}
        none = {n: ws.spark.createDataFrame([], SCHEMAS[n]) for n in ("paper_vectors", "chunk_vectors")}
        if rebuild:
            rows, replaced = {"papers": store.papers, "chunks": store.chunks, "files": store.files}, None
        else:
            rows, replaced = _renumbered(ws, store)
        if rebuild or replaced is not None:
            held = none if rebuild else _without(ws, rows, replaced)
            tables = dict(rows) if rebuild else {n: held[n].unionByName(rows[n]) for n in rows}
            tables |= _vectors(tables["chunks"], held, embedder) | {"failures": store.failed}
            indexes = _indexed(ws, tables, embedder.width, config.index, rebuild, replaced)
            ws.write(tables, indexes, **meta)
        else:
            added = rows | _vectors(rows["chunks"], none, embedder)
            ws.write({"failures": store.failed}, _index_more(ws, added, embedder.width, config.index), added, **meta)
        if config.role == "producer":
            _leave_segments(ws, {n: ws.read(n) for n in SCHEMAS})
    return store


def follow(ws: Workspace, inbox: str, checkpoint: str, embedder: Embedder | None = None, config: BuildConfig = BuildConfig(update=True), timeout: int = 36_000) -> None:
    """Take in archives as they are announced: every line of a text file that appears in inbox names one.

    A stream over the inbox; each batch of names is an update of the store. It stops when nothing is left and goes on
    where it was when called again with the same checkpoint; a batch that comes twice changes nothing, since its members
    are known by then.
    """
    spark = ws.spark
    names = spark.readStream.text(inbox).where("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(F.trim("value").alias("path"))

    def step(batch: DataFrame, _: int) -> None:
        # one short row an archive
        found = sorted({r.path for r in batch.collect()})
        if found:
            build(ws, found, embedder, config)

    drain(names, step, checkpoint, timeout=timeout)


def _leave_segments(ws: Workspace, tables: dict[str, DataFrame]) -> None:
    """A producer's vectors by documents and places, which hold on every machine."""
    docs = tables["papers"].where("doc_id <> ''").select("paper_id", "doc_id")
    for old in waiting(ws.spark, ws.segments):
        ws.shared.delete(f"{ws.segments}/{old}")
    write_segments(tables["paper_vectors"].join(docs, F.col("id") == F.col("paper_id")).select("doc_id", F.col("embedding").alias("vec")), ws.segments, "paper")
    c = tables["chunks"].select("chunk_id", "paper_id", "ord").join(docs, "paper_id")
    write_segments(tables["chunk_vectors"].join(c, F.col("id") == F.col("chunk_id")).select(F.col("doc_id").alias("paper_doc_id"), "ord", F.col("embedding").alias("vec")), ws.segments, "chunk")


def _vectors(chunks: DataFrame, held: dict[str, DataFrame], embedder: Embedder) -> dict[str, DataFrame]:
    """Vectors of papers, which are those of their first passages' texts, and of all passages."""
    head = chunks.where("ord = -1").select("paper_id", "text")
    return {"paper_vectors": embed_missing(head, held["paper_vectors"], "paper_id", "text", embedder), "chunk_vectors": embed_missing(chunks, held["chunk_vectors"], "chunk_id", "text", embedder)}


def _renumbered(ws: Workspace, new: Store) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The new members' rows under the store's ids, and the ids (id) of papers and the papers of files that they replace;
    None if they replace nothing.

    A paper known by pmcid, else by pmid, else by doc_id, keeps its id; others get the next ones.
    """
    old_p, old_f = ws.read("papers"), ws.read("files")
    same = match_identity(new.papers, old_p)
    top = old_p.agg(F.coalesce(F.max("paper_id"), F.lit(0)).alias("top"))
    ids = new.papers.select("paper_id").join(same, "paper_id", "left").crossJoin(F.broadcast(top)).select("paper_id", "old_id", F.coalesce("old_id", F.col("paper_id") + F.col("top")).alias("to"))
    ids = materialize(ids.groupBy("to").agg(F.min("paper_id").alias("paper_id"), F.max("old_id").alias("old_id")))
    to = ids.select("paper_id", "to")
    rows = {
        "papers": new.papers.join(to, "paper_id").withColumn("paper_id", F.col("to")).drop("to"),
        "chunks": new.chunks.join(to, "paper_id").withColumns({"paper_id": F.col("to"), "chunk_id": F.shiftleft("to", 24) + F.col("ord") + 1}).drop("to"),
        "files": new.files.join(to, "paper_id").withColumn("paper_id", F.col("to")).drop("to"),
    }
    replaced = materialize(ids.where("old_id IS NOT NULL").select(F.col("old_id").alias("id")))
    if replaced.limit(1).count() or rows["files"].join(old_f.select("path"), "path", "left_semi").limit(1).count():
        return rows, replaced
    return rows, None


def _without(ws: Workspace, rows: dict[str, DataFrame], replaced: DataFrame) -> dict[str, DataFrame]:
    """The store's rows but for those of replaced papers and of files that came again."""
    old_c = ws.read("chunks")
    gone = replaced.select(F.col("id").alias("paper_id"))
    return {
        "papers": ws.read("papers").join(gone, "paper_id", "left_anti"),
        "chunks": old_c.join(gone, "paper_id", "left_anti"),
        "files": ws.read("files").join(rows["files"].select("path").distinct(), "path", "left_anti"),
        "paper_vectors": ws.read("paper_vectors").join(replaced, "id", "left_anti"),
        "chunk_vectors": ws.read("chunk_vectors").join(old_c.join(gone, "paper_id", "left_semi").select(F.col("chunk_id").alias("id")), "id", "left_anti"),
    }


def mark_done(spark: SparkSession, path: str, shard: int) -> None:
    """Say that a producer has written all of its shard."""
    SharedFiles(spark).write_json(f"{path}/shard{shard}.done.json", {"shard": shard})


def wait_for(spark: SparkSession, path: str, shards: int, timeout: float = 36_000, poll: float = 30) -> bool:
    """Wait until all producers are done; False after the timeout."""
    end, files = time.time() + timeout, SharedFiles(spark)
    while not all(files.exists(f"{path}/shard{i}.done.json") for i in range(shards)):
        if time.time() >= end:
            return False
        time.sleep(poll)
    return True


def take_segments(ws: Workspace, path: str, papers: DataFrame, chunks: DataFrame) -> tuple[DataFrame | None, DataFrame | None, list[str], dict]:
    """(paper vectors, chunk vectors, names taken, report) of the segments that wait under path, by the store's documents."""
    docs = papers.where("doc_id <> ''").groupBy("doc_id").agg(F.max("paper_id").alias("paper_id"))
    n = docs.count()
    p = take_in(ws.spark, path, "paper", lambda s: (s.join(docs, "doc_id").select(F.col("paper_id").alias("id"), F.col("vec").alias("embedding")), s.join(docs, "doc_id", "left_anti")), n)
    c = take_in(ws.spark, path, "chunk", lambda s: (resolve_segments(s, papers, chunks).select(F.col("chunk_id").alias("id"), F.col("vec").alias("embedding")), unresolved_segments(s, papers, chunks)), n)
    report = {"taken": len(p.taken + c.taken), "aside": len(p.aside + c.aside), "failed": p.failed | c.failed, "unresolved": p.unresolved + c.unresolved}
    return p.rows, c.rows, p.taken + c.taken, report


def consume(ws: Workspace, shards: list[Workspace], kind: str = "ivfpq") -> dict:
    """Merge the stores that producers built, in their order: the first of an article stays, with its passages.

    Vectors come from the producers' segments, by document and place; a segment of which nothing belongs here is set
    aside. Gives what was taken of each shard, and of the segments; shards that cannot be read are left out and named.
    """
    with ws.guard():
        readable, lost = [], {}
        for i, s in enumerate(shards):
            try:
                s.read("papers").limit(1).count()
                readable.append((i, s))
            except Exception as e:
                lost[f"{i:08d}"] = str(e)[:500]

        def tagged(name: str) -> DataFrame:
            out = None
            for i, s in readable:
                t = s.read(name).withColumn("shard", F.lit(f"{i:08d}"))
                out = t if out is None else out.unionByName(t)
            return out

        all_papers = tagged("papers")
        merged = materialize(merge_papers(all_papers))
        chunks = materialize(merge_children(tagged("chunks"), merged, ["paper_id", "ord"]).withColumn("chunk_id", F.shiftleft("paper_id", 24) + F.col("ord") + 1))
        files = merge_children(tagged("files"), merged, ["path"])
        papers = materialize(merged.withColumn("paper_id", F.col("new_id")))
        statistics = {r.shard: {"rows": r.rows, "accepted": r.accepted} for r in merge_statistics(all_papers, merged).toLocalIterator()}
        vectors: dict[str, list[DataFrame]] = {"paper": [], "chunk": []}
        taken, reports, width = [], {}, 64
        for i, s in readable:
            p, c, names, report = take_segments(ws, s.segments, papers, chunks)
            vectors["paper"] += [p] if p is not None else []
            vectors["chunk"] += [c] if c is not None else []
            taken.append((s, names))
            reports[f"{i:08d}"] = report
            width = s.meta().get("width", width)
        tables = {"papers": papers, "chunks": chunks, "files": files}
        for name, some in vectors.items():
            union = ws.spark.createDataFrame([], SCHEMAS[f"{name}_vectors"])
            for v in some:
                union = union.unionByName(v)
            tables[f"{name}_vectors"] = union.groupBy("id").agg(F.min("embedding").alias("embedding"))
        indexes = _indexed(ws, tables, width, kind, True, None)
        out = {"shards": statistics, "segments": reports, "unreadable": lost}
        ws.write(tables, indexes, build={"num_shards": len(shards), "mode": "consumer"}, merge=out, width=width)
        for s, names in taken:
            finish(ws.spark, s.segments, names)
    return out


def _finder(ws: Workspace, name: str, vectors: DataFrame, width: int):
    """Neighbours from an index, rescored on the stored vectors; exact where it is flat."""
    rows, model = ws.index(name, width)
    if model.kind == "flat":
        return lambda q, k: topk(q, vectors, k, width)
    return lambda q, k: index.search(q, rows, model, k, rerank=vectors if model.m else None)


def ask(ws: Workspace, questions: DataFrame, embedder: Embedder | None = None, config: QueryConfig = QueryConfig(), model: ModelConfig = ModelConfig(), backend: Backend | None = None) -> tuple[DataFrame, DataFrame]:
    """(passages, packed) for questions (qid, question): hydrated passages in order, and the blocks that fit the budget."""
    config.validate()
    embedder = embedder or WordEmbedder()
    width = embedder.width
    papers, chunks = ws.read("papers"), ws.read("chunks")
    pv = usable(ws.read("paper_vectors"), "id", "embedding", width)
    cv = usable(ws.read("chunk_vectors"), "id", "embedding", width)
    q = questions.select("qid", "question", rare_terms(question_terms("question")).alias("terms"))
    qv = usable(embedder.encode(questions, "question", "embedding").select(F.col("qid").alias("id"), "embedding"), "id", "embedding", width)
    n = config.top_papers or papers.agg(top_papers(F.count("*")).alias("n")).first().n
    short = _finder(ws, "paper", pv, width)(qv, n).withColumnRenamed("id", "paper_id")
    found = ranking.search_passages(
        q, qv, short, chunks, papers, cv, config.top_chunks, width, config.overshoot, config.min_chunks_per_paper, config.per_paper_cap, Lexical(), config.allow_global_lexical, config.widen, backend, _finder(ws, "chunk", cv, width)
    )
    passages = ranking.hydrate(found, chunks, papers)
    return passages, ranking.pack_context(passages, questions, model.prompt or PROMPT, model.tokens, model.max_out, model.headroom)


def answers(passages: DataFrame, questions: DataFrame, provider: Provider, model: ModelConfig = ModelConfig()) -> DataFrame:
    """(qid, answer, references): a model's answers to questions (qid, question), cited by document.

    The plan of calls is one row a question, a budget's worth of passages each; the driver, where the model is called,
    takes these rows one after another.
    """
    spark = passages.sparkSession
    plan = ranking.attempts(passages, questions, model.prompt or PROMPT, model.tokens, model.max_out, model.headroom)
    said = [(r.qid, *answer(r.question, [Attempt(list(x.blocks), x.max_out) for x in r.attempts], provider, model)) for r in plan.toLocalIterator()]
    a = spark.createDataFrame([(q, citations.one_form(t), n) for q, t, n in said], "qid long, answer string, sent int")
    none = F.lit(None).cast("string")
    p = passages.join(a.select("qid", "sent"), "qid").where(F.col("pos") < F.col("sent")).withColumn("idx", (F.col("pos") + 1).cast("int"))
    p = p.withColumn("key", citations.document_key(none, F.col("pmcid"), F.col("pmid"), F.col("paper_id"), F.col("paper_title"), F.col("chunk_id")))
    docs = citations.mentions(a, p).join(p.groupBy("qid", "key").agg(F.min_by(F.struct("paper_title", "pmcid", "pmid"), "idx").alias("r")), ["qid", "key"])
    refs = citations.references(docs.select("qid", "docnum", F.col("r.paper_title").alias("title"), F.lit(None).cast("int").alias("year"), none.alias("doi"), "r.pmcid", "r.pmid"))
    return citations.renumber(a.select("qid", "answer"), p).join(refs, "qid", "left").select("qid", "answer", F.coalesce("block", F.lit("References\n")).alias("references"))
