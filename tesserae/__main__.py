"""The command line: python -m tesserae COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from tesserae import pipeline
from tesserae.answering import ModelConfig, ModelError, embedder_for, provider_for
from tesserae.config import BuildConfig, Paths, QueryConfig, human_bytes, question_text
from tesserae.operators import index
from tesserae.operators.store import assign_shards, sanity
from tesserae.operators.vectors import topk, usable
from tesserae.session import build_session
from tesserae.sources.archives import archive_faults, list_archives, member_counts, read_manifest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tesserae", description="Build a store of articles from archives and ask it questions.")
    p.add_argument("--store", help="directory of the store")
    p.add_argument("--embedder", default="words", help="'words' or the name of a sentence model")
    sub = p.add_subparsers(dest="command", required=True)

    def archives(c: argparse.ArgumentParser) -> None:
        c.add_argument("--archives", help="directory of archives")
        c.add_argument("--manifest", help="file that lists archives")

    for name, text in (("build", "build a store, or go on with one"), ("update", "take in what is new or changed"), ("rebuild", "start anew")):
        c = sub.add_parser(name, help=text)
        archives(c)
        c.add_argument("--role", default="single", choices=("single", "producer"))
        c.add_argument("--shard", type=int, default=0)
        c.add_argument("--shards", type=int, default=1)
        c.add_argument("--index", default="ivfpq", choices=("flat", "ivf", "ivfpq"))
        c.add_argument("--on-duplicate", default="first", choices=("first", "append"))
        c.add_argument("--yes", action="store_true", help="do not ask before a store is replaced")
        c.add_argument("--done", help="directory where a producer says that it is done")
    c = sub.add_parser("follow", help="take in archives that text files in a directory name, as they appear")
    c.add_argument("inbox")
    c.add_argument("--checkpoint", required=True)
    c = sub.add_parser("merge", help="merge the stores of producers")
    c.add_argument("shards", nargs="+")
    c.add_argument("--done", help="wait until all producers have said so there")
    c.add_argument("--timeout", type=float, default=36_000)
    c.add_argument("--index", default="ivfpq", choices=("flat", "ivf", "ivfpq"))
    c = sub.add_parser("ask", help="ask questions")
    c.add_argument("question", nargs="?", help="the question, @FILE, or - for standard input")
    c.add_argument("--question-file")
    c.add_argument("--top-chunks", type=int, default=24)
    c.add_argument("--top-papers", type=int)
    c.add_argument("--per-paper", type=int, default=3)
    c.add_argument("--global-terms", action="store_true", help="look for terms in all papers")
    c.add_argument("--widen", default="candidates", choices=("candidates", "global"))
    c.add_argument("--model", default="local")
    c.add_argument("--url", default="", help="endpoint of the model; without it the passages themselves are shown")
    c.add_argument("--key", default="")
    c.add_argument("--how", default="auto", choices=("auto", "chat", "responses"))
    c.add_argument("--budget", type=int)
    c.add_argument("--passages", action="store_true", help="show the passages only")
    sub.add_parser("report", help="counts, flags and the last build")
    c = sub.add_parser("recall", help="how much of the exact answer the passages' index finds")
    c.add_argument("--k", type=int, default=10)
    c = sub.add_parser("members", help="count markup files and name damaged archives")
    archives(c)
    c = sub.add_parser("deal", help="deal archives to shards by size")
    archives(c)
    c.add_argument("--shards", type=int, required=True)
    return p


def _archives(a: argparse.Namespace, paths: Paths) -> list[str]:
    if a.manifest:
        found, missing = read_manifest(a.manifest)
        for m in missing:
            print(f"not found: {m}", file=sys.stderr)
        return found
    return list_archives(a.archives or paths.archives)


def _share(spark, found: list[str], shards: int, shard: int) -> list[str]:
    """A producer's part of the archives, the same on every machine."""
    import os

    rows = spark.createDataFrame([(p, os.path.getsize(p)) for p in found], "path string, size long")
    return [r.path for r in assign_shards(rows, "path", "size", shards).where(F.col("shard") == shard).collect()]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    paths = Paths.of(store=a.store)
    spark = build_session(**{"spark.ui.showConsoleProgress": "false"})
    ws = pipeline.Workspace(spark, paths.store)
    show = lambda df: [print("\t".join("" if x is None else str(x) for x in r)) for r in df.toLocalIterator()]
    if a.command in ("build", "update", "rebuild"):
        config = BuildConfig(role=a.role, shard_id=a.shard, num_shards=a.shards, rebuild=a.command == "rebuild", update=a.command == "update", on_duplicate=a.on_duplicate, index=a.index).validate()
        if config.rebuild and not ws.wipe(lambda: a.yes or input(f"replace {paths.store}? [y/N] ").strip().lower() == "y"):
            return 1
        found = _archives(a, paths)
        pipeline.build(ws, _share(spark, found, a.shards, a.shard) if a.role == "producer" else found, embedder_for(a.embedder), config)
        print(json.dumps(ws.meta()["cycle"]))
        if a.role == "producer" and a.done:
            pipeline.mark_done(spark, a.done, a.shard)
    elif a.command == "follow":
        pipeline.follow(ws, a.inbox, a.checkpoint, embedder_for(a.embedder))
        print(json.dumps(ws.meta().get("cycle", {})))
    elif a.command == "merge":
        if a.done and not pipeline.wait_for(spark, a.done, len(a.shards), a.timeout):
            print("not all producers are done", file=sys.stderr)
            return 1
        print(json.dumps(pipeline.consume(ws, [pipeline.Workspace(spark, s) for s in a.shards], a.index)))
    elif a.command == "ask":
        q = spark.createDataFrame([(1, question_text(a.question_file, a.question))], "qid long, question string")
        config = QueryConfig(top_papers=a.top_papers, top_chunks=a.top_chunks, per_paper_cap=a.per_paper, allow_global_lexical=a.global_terms, widen=a.widen)
        model = ModelConfig(model=a.model, budget=a.budget)
        passages, packed = pipeline.ask(ws, q, embedder_for(a.embedder), config, model)
        if a.passages:
            show(packed.orderBy("idx").select("block"))
            return 0
        try:
            for r in pipeline.answers(passages, q, provider_for(a.url, a.model, a.key, a.how), model).collect():
                print(r.answer, r.references, sep="\n\n")
        except ModelError as e:
            print(e, file=sys.stderr)
            return 1
    elif a.command == "report":
        rows = ws.index("chunk", ws.meta().get("width", 64))[0]
        show(sanity(ws.read("papers"), ws.read("chunks"), ws.read("files"), rows.select("id")))
        for name in pipeline.INDEXES:
            if ws.meta():
                show(index.describe(spark, *ws.index_dir(name)))
        print(json.dumps(ws.meta()))
    elif a.command == "recall":
        width = ws.meta().get("width", 64)
        v = usable(ws.read("chunk_vectors"), "id", "embedding", width)
        rows, model = ws.index("chunk", width)
        q = v.where(F.pmod(F.xxhash64("id"), F.lit(50)) == 0)
        show(index.recall(index.search(q, rows, model, a.k, rerank=v if model.m else None), topk(q, v, a.k, width)))
    elif a.command == "members":
        found = _archives(a, paths)
        show(member_counts(spark, found))
        for r in archive_faults(spark, found).collect():
            print(f"{r.tar}: {r.fault}", file=sys.stderr)
    elif a.command == "deal":
        import os

        found = _archives(a, paths)
        rows = spark.createDataFrame([(p, os.path.getsize(p)) for p in found], "path string, size long")
        for r in assign_shards(rows, "path", "size", a.shards).orderBy("shard", "path").collect():
            print(r.shard, r.path, human_bytes(r.size), sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
