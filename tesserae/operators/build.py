"""From parsed archive members to the store's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.config import BuildConfig
from tesserae.operators.chunking import passages
from tesserae.operators.store import merge_papers
from tesserae.session import materialize


@dataclass(frozen=True)
class Store:
    """papers, chunks and files as of a build, and the members that gave no record."""

    papers: DataFrame
    chunks: DataFrame
    files: DataFrame
    failed: DataFrame


def build_store(articles: DataFrame, config: BuildConfig = BuildConfig()) -> Store:
    """The tables for parsed members (tar, member, size, mtime, member_seq, doc_id, article).

    Articles are taken by archive name and place. One whose pmcid, pmid or doc_id is already taken is refused
    (on_duplicate 'first') or kept as a paper of its own ('append'). Its file is registered either way, under the
    paper that has its identifiers. A chunk's id is its paper's id and its place, so a build gives the same ids again.
    """
    config.validate()
    all_ = materialize(articles)
    good = all_.where(F.col("article").isNotNull()).select("tar", "member", "size", "mtime", "member_seq", "doc_id", "article.*")
    rows = good.select(F.col("tar").alias("shard"), F.col("member_seq").alias("paper_id"), "*")
    if config.on_duplicate == "append":
        kept = materialize(merge_papers(rows.withColumns({"pmcid": F.lit(""), "pmid": F.lit("")})).select("shard", "paper_id", "new_id").join(rows, ["shard", "paper_id"]))
    else:
        kept = materialize(merge_papers(rows))
    papers = kept.select(F.col("new_id").alias("paper_id"), "doc_id", "pmid", "pmcid", "title", "abstract", F.lit(False).alias("in_index"))
    text = kept.select(F.col("new_id").alias("paper_id"), "title", "abstract", "paragraphs")
    p = passages(text, "paper_id", config.target_chars, config.short_chars, config.overlap_chars)
    chunks = p.select((F.shiftleft("paper_id", 24) + F.col("ord") + 1).alias("chunk_id"), "paper_id", "ord", "text", F.lit(False).alias("in_index"))
    owners = papers.select("paper_id", F.explode(F.array(F.concat(F.lit("d"), "doc_id"), F.when(F.col("pmcid") != "", F.concat(F.lit("c"), "pmcid")), F.when(F.col("pmid") != "", F.concat(F.lit("p"), "pmid")))).alias("key")).where("key IS NOT NULL")
    owners = owners.groupBy("key").agg(F.min("paper_id").alias("paper_id"))
    keys = good.select("doc_id", "size", "mtime", F.posexplode(F.array(F.concat(F.lit("d"), "doc_id"), F.when(F.col("pmcid") != "", F.concat(F.lit("c"), "pmcid")), F.when(F.col("pmid") != "", F.concat(F.lit("p"), "pmid")))).alias("n", "key")).where("key IS NOT NULL")
    files = keys.join(owners, "key").groupBy("doc_id", "size", "mtime").agg(F.min_by("paper_id", "n").alias("paper_id")).select(F.col("doc_id").alias("path"), "size", "mtime", "paper_id")
    return Store(papers, chunks, files, all_.where(F.col("article").isNull()).select("tar", "member", "doc_id", "fault" if "fault" in all_.columns else F.lit(None).cast("string").alias("fault")))
