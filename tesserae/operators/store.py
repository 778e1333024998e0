"""The store's tables: upserts, incremental loads, merging of shards, segments, index membership, reports."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators.components import components
from tesserae.session import materialize


def first_wins(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order; other columns stay with it. Keys may be null (one group)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Rows of both, one for each key: of the incoming rows of a key the first in order, else the current one."""
    new = first_wins(incoming, keys, *order)
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Rows of both, one for each key of the incoming rows that current lacks: what is there stays."""
    new = first_wins(incoming, keys, *order)
    return current.unionByName(new.join(current.select(*keys), keys, "left_anti"))


def to_process(scanned: DataFrame, known: DataFrame, rebuild: bool = False) -> DataFrame:
    """Scanned files (path, size, mtime) that are not known with the same size and, to a millionth of a second, time.

    A file whose size or time is null on either side cannot be known. rebuild takes all.
    """
    if rebuild:
        return scanned
    k = known.select(F.col("path").alias("kp"), F.col("size").alias("ks"), F.col("mtime").alias("kt"))
    return scanned.join(k, (F.col("path") == F.col("kp")) & (F.col("size") == F.col("ks")) & (F.abs(F.col("mtime") - F.col("kt")) < 1e-6), "left_anti")


def after_checkpoint(members: DataFrame, done: DataFrame) -> DataFrame:
    """Members (tar, member_seq) beyond the number that the checkpoint (tar, members_done) says are done."""
    return members.join(done.select("tar", "members_done"), "tar", "left").where(F.col("member_seq") >= F.coalesce("members_done", F.lit(0))).drop("members_done")


def numbered_within(df: DataFrame, group: str, by: str, name: str) -> DataFrame:
    """df with name (long): each row's place in its group, from 0, in the order of a column without ties.

    Rows are sorted as a whole and numbered by partition; a row's place is its number less that of its group's first.
    """
    all_ = numbered(df, [group, by], "__all")
    first = all_.groupBy(F.col(group).alias("__g")).agg(F.min("__all").alias("__first"))
    return all_.join(first, F.col(group) == F.col("__g")).withColumn(name, F.col("__all") - F.col("__first")).drop("__g", "__first", "__all")


def replace_chunks(current: DataFrame, fresh: DataFrame, key: str = "paper_id") -> DataFrame:
    """current without the passages of the papers that fresh brings, and fresh."""
    return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


#: Rounds over all open rows before what is left is settled component by component; entries that a component may then have.
ROUNDS, SETTLED = 6, 200_000


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__o) of the accepted rows, from (component, __o, keys) sorted by component and order: what an accepted row holds is taken."""
    component, taken = None, set()
    for rb in batches:
        out = []
        for i, (c, keys) in enumerate(zip(rb.column(0).to_pylist(), rb.column(2).to_pylist(), strict=True)):
            if c != component:
                component, taken = c, set()
            if taken.isdisjoint(keys):
                taken.update(keys)
                out.append(i)
        yield pa.RecordBatch.from_arrays([rb.column(1).take(pa.array(out, pa.int64()))], names=["__o"])


def accept_by_identity(rows: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """The rows that a merge in the given order accepts: one is refused if any of its non-empty keys is already taken.

    order must tell all rows apart. Rows whose keys nobody shares are accepted at once. Of the others, each round
    accepts those that come first on all their keys and refuses those that share a key with an accepted one; only an
    accepted row takes its keys, so three plain passes would not do. A hot key is settled in such a round, whatever its
    size. Long chains would need as many rounds as they have links: after some rounds the connected components of what
    is left are taken apart, each in one sorted pass that holds the taken keys; those with too many rows for that go on
    in rounds.
    """
    rows = rows.withColumn("__o", F.struct(*order))
    long = rows.select("__o", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(k).cast("string").alias("v")) for i, k in enumerate(keys)])).alias("k")).where("k.v <> ''").select("__o", "k.t", "k.v")
    crowded = long.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1").select("t", "v")
    open_keys = materialize(long.join(crowded, ["t", "v"]))
    open_rows = open_keys.select("__o").distinct()
    accepted = rows.join(open_rows, "__o", "left_anti")
    won, rounds = [], 0
    while open_keys.limit(1).count():
        if rounds == ROUNDS:
            group = components(open_keys.select(F.col("__o").alias("id"), F.struct("t", "v").alias("key")))
            # a row alone with its keys is a component of its own
            placed = open_keys.join(group.withColumnRenamed("id", "__o"), "__o", "left").withColumn("c", F.xxhash64(F.coalesce("group_id", "__o"))).drop("group_id")
            small = placed.groupBy("c").count().where(F.col("count") <= SETTLED).select("c")
            placed = materialize(placed)
            per_row = placed.join(small, "c").groupBy("c", "__o").agg(F.collect_list(F.struct("t", "v")).alias("k")).withColumn("k", F.transform("k", lambda x: F.concat(x["t"].cast("string"), F.lit(":"), x["v"])))
            sorted_ = per_row.select("c", "__o", "k").repartition("c").sortWithinPartitions("c", "__o")
            won.append(materialize(sorted_.mapInArrow(_winners, T.StructType([T.StructField("__o", rows.schema["__o"].dataType)]))))
            open_keys = materialize(placed.join(small, "c", "left_anti").drop("c"))
        rounds += 1
        if rounds <= ROUNDS or open_keys.limit(1).count():
            first = open_keys.groupBy("t", "v").agg(F.min("__o").alias("m"))
            marks = open_keys.join(first, ["t", "v"]).groupBy("__o").agg(F.min((F.col("__o") == F.col("m")).cast("int")).alias("all_first"))
            winners = materialize(marks.where("all_first = 1").select("__o"))
            won.append(winners)
            taken = open_keys.join(winners, "__o", "left_semi").select("t", "v").distinct()
            refused = open_keys.join(taken, ["t", "v"], "left_semi").select("__o").distinct()
            open_keys = materialize(open_keys.join(refused, "__o", "left_anti"))
    for w in won:
        accepted = accepted.unionByName(rows.join(w, "__o", "left_semi"))
    return accepted.drop("__o")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name (long): the place of each row in the order, from 1, without a window over all rows.

    Rows are range-partitioned and sorted; a row's number is its place in its partition and the rows of those before.
    """
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    # one row a partition
    sizes = at.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return at.join(before, "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def merge_papers(shards: DataFrame) -> DataFrame:
    """(shard, paper_id, new_id, ...): papers of all shards that the merge accepts, with new ids from 1 in merge order.

    shards: shard, paper_id, doc_id, pmcid, pmid and more. Shards merge in the order of their names. Only keys go through
    the rounds and the numbering; the rows themselves are shuffled once, to their new ids.
    """
    place = ["shard", "paper_id"]
    taken = accept_by_identity(shards.select(*place, "doc_id", "pmcid", "pmid"), place, ["doc_id", "pmcid", "pmid"]).select(*place)
    return shards.join(numbered(taken, place, "new_id"), place)


def merge_statistics(shards: DataFrame, merged: DataFrame) -> DataFrame:
    """(shard, rows, accepted, refused): what the merge took of each shard; shards without an accepted row as well."""
    took = merged.groupBy("shard").agg(F.count("*").alias("accepted"))
    per = shards.groupBy("shard").agg(F.count("*").alias("rows")).join(took, "shard", "left")
    return per.select("shard", "rows", F.coalesce("accepted", F.lit(0)).alias("accepted"), (F.col("rows") - F.coalesce("accepted", F.lit(0))).alias("refused"))


def match_identity(new: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("pmcid", "pmid", "doc_id")) -> DataFrame:
    """(paper_id, old_id): for each new paper the known one it is, by the first of the keys that matches, in their order; the
    smallest id on ties. Empty and null keys match nothing."""

    def long(p: DataFrame, name: str) -> DataFrame:
        return p.select(F.col("paper_id").alias(name), F.posexplode(F.array(*[F.when(F.col(k) != "", F.concat(F.lit(f"{k}:"), F.col(k))) for k in keys])).alias("n", "key")).where("key IS NOT NULL")

    # known ids are combined by key first, so a hot key is one row
    once = long(known, "old_id").groupBy("key").agg(F.min("old_id").alias("old_id"))
    return long(new, "paper_id").join(once, "key").groupBy("paper_id").agg(F.min(F.struct("n", "old_id")).alias("m")).select("paper_id", "m.old_id")


def merge_children(children: DataFrame, papers: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows (shard, paper_id, ...) of accepted papers under their new ids, the first of each key in shard order."""
    ids = papers.select("shard", "paper_id", "new_id")
    moved = children.join(ids, ["shard", "paper_id"]).withColumn("paper_id", F.col("new_id")).drop("new_id")
    return first_wins(moved, keys, "shard")


def resolve_segments(segments: DataFrame, papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, vec) for segment rows (paper_doc_id, ord, vec) whose document and passage exist; the last passage of a
    place, by chunk_id, counts. Rows that do not resolve are left to unresolved_segments."""
    place = chunks.groupBy("paper_id", "ord").agg(F.max("chunk_id").alias("chunk_id"))
    doc = papers.where("doc_id <> ''").groupBy("doc_id").agg(F.max("paper_id").alias("paper_id"))
    return segments.join(doc, F.col("paper_doc_id") == F.col("doc_id")).join(place, ["paper_id", "ord"]).select("chunk_id", "vec")


def unresolved_segments(segments: DataFrame, papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segment rows without a document or a passage."""
    known = chunks.select("paper_id", "ord").distinct().join(papers.where("doc_id <> ''").groupBy("doc_id").agg(F.max("paper_id").alias("paper_id")), "paper_id").select(F.col("doc_id").alias("paper_doc_id"), "ord")
    return segments.join(known, ["paper_doc_id", "ord"], "left_anti")


def reconcile(rows: DataFrame, index_ids: DataFrame, key: str) -> DataFrame:
    """rows with in_index set to whether their id (key) is in the index (id)."""
    ids = index_ids.select(F.col("id").alias(key)).distinct().withColumn("__there", F.lit(True))
    return rows.drop("in_index").join(ids, key, "left").withColumn("in_index", F.coalesce("__there", F.lit(False))).drop("__there")


def flag_changes(rows: DataFrame, index_ids: DataFrame, key: str) -> DataFrame:
    """(key, was, is): rows whose flag does not say what the index holds; a null flag counts as false."""
    was = F.coalesce("in_index", F.lit(False))
    ids = index_ids.select(F.col("id").alias(key)).distinct().withColumn("__there", F.lit(True))
    return rows.select(key, was.alias("was")).join(ids, key, "left").select(key, "was", F.coalesce("__there", F.lit(False)).alias("is")).where("was <> is")


def backfill(rows: DataFrame, index_ids: DataFrame, key: str) -> DataFrame:
    """rows that the index lacks."""
    return rows.join(index_ids.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def sanity(papers: DataFrame, chunks: DataFrame, files: DataFrame, index_ids: DataFrame) -> DataFrame:
    """(what, rows, indexed, distinct_keys, duplicates) for each table, and the index's ids that no passage has."""

    def counts(df: DataFrame, what: str, indexed: Column, *keys: str) -> DataFrame:
        per = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(indexed).alias("i"))
        return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("i"), F.lit(0)).alias("indexed"), F.count("*").alias("distinct_keys")).select(F.lit(what).alias("what"), "rows", "indexed", "distinct_keys", (F.col("rows") - F.col("distinct_keys")).alias("duplicates"))

    flag = F.coalesce(F.col("in_index"), F.lit(False)).cast("long")
    stray = index_ids.select("id").distinct().join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_anti")
    out = counts(papers, "papers", flag, "paper_id").unionByName(counts(chunks, "chunks", flag, "paper_id", "ord"))
    return out.unionByName(counts(files, "files", F.lit(0).cast("long"), "path")).unionByName(counts(stray, "index without passage", F.lit(1).cast("long"), "id"))


def _least_loaded(shards: int):
    """(path, size, shard) of rows (path, size) that come in order: each to the least loaded shard, the lower on ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = [(0, b) for b in range(shards)]
        for rb in batches:
            out = []
            for size in rb.column(1).to_pylist():
                load, b = heap[0]
                heapq.heapreplace(heap, (load + (size or 0), b))
                out.append(b)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(out, pa.int32())], names=["path", "size", "shard"])

    return run


def assign_shards(archives: DataFrame, path: str, size: str, shards: int) -> DataFrame:
    """(path, size, shard): the largest archive first, each to the least loaded shard; equal sizes by their paths.

    Sizes null count as 0. The listing, one short row an archive, is dealt in one task, which holds the loads alone.
    """
    rows = archives.select(F.col(path).alias("path"), F.col(size).cast("long").alias("size"))
    one = rows.repartition(1).sortWithinPartitions(F.desc_nulls_last("size"), "path")
    return one.mapInArrow(_least_loaded(max(1, shards)), "path string, size long, shard int")


def shard_loads(assigned: DataFrame) -> DataFrame:
    """(shard, load, ideal, imbalance): bytes of each shard, their mean, and how far in percent the shard is off."""
    per = assigned.groupBy("shard").agg(F.sum("size").alias("load"))
    mean = per.agg(F.avg("load").alias("ideal"))
    return per.crossJoin(mean).select("shard", "load", F.round("ideal", 3).alias("ideal"), F.round((F.col("load") - F.col("ideal")) * 100 / F.col("ideal"), 3).alias("imbalance"))
