"""Store queries: upserts, incremental loads, merges, segments, index membership, archives, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import citations
from tesserae.operators import store
from tesserae.plans import retrieval as r
from tesserae.session import table

CUT = "2024-09-01"


def _files(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "files").select("path", "size", "mtime", "paper_id", "loaded_at")


def _oldest() -> list:
    return [F.asc("loaded_at"), F.asc_nulls_first("size"), F.asc_nulls_first("mtime"), F.asc_nulls_first("paper_id")]


def _newest() -> list:
    return [F.desc("loaded_at"), F.desc_nulls_last("size"), F.desc_nulls_last("mtime"), F.desc_nulls_last("paper_id")]


def first_wins_dedupe(spark: SparkSession, base: str) -> DataFrame:
    return store.first_wins(_files(spark, base), ["path"], *_oldest())


def upsert_latest(spark: SparkSession, base: str) -> DataFrame:
    f = _files(spark, base)
    old = store.first_wins(f.where(F.col("loaded_at") < CUT), ["path"], *_newest())
    return store.upsert(old, f.where(F.col("loaded_at") >= CUT), ["path"], *_newest())


def insert_missing(spark: SparkSession, base: str) -> DataFrame:
    f = _files(spark, base)
    old = store.first_wins(f.where(F.col("loaded_at") < CUT), ["path"], *_newest())
    return store.insert_missing(old, f.where(F.col("loaded_at") >= CUT), ["path"], *_newest())


def incremental_antijoin(spark: SparkSession, base: str) -> DataFrame:
    """Files of the latest scan that the store of the cut did not have with the same size and time."""
    f = _files(spark, base)
    known = store.first_wins(f.where(F.col("loaded_at") < CUT), ["path"], *_newest())
    return store.to_process(store.first_wins(f, ["path"], *_newest()), known).select("path", "size", "mtime")


def _shards(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "papers").select("paper_id", "doc_id", "pmid", "pmcid", "title")
    return p.withColumn("shard", F.coalesce(F.regexp_extract("doc_id", "^tar://(.*?)!/", 1), F.lit("")))


def shard_merge(spark: SparkSession, base: str) -> DataFrame:
    """Papers of all archives, taken as shards, that a merge by doc_id, pmcid and pmid accepts, with their new ids."""
    return store.merge_papers(_shards(spark, base)).select("shard", "paper_id", "new_id")


def shard_merge_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Passages of the accepted papers under their new ids, one for each place."""
    s = _shards(spark, base)
    c = table(spark, base, "chunks").where("ord >= -1").join(s.select("paper_id", "shard"), "paper_id").select("shard", "paper_id", "ord", "chunk_id")
    c = store.first_wins(c, ["shard", "paper_id", "ord"], "chunk_id")
    return store.merge_children(c, store.merge_papers(s), ["paper_id", "ord"]).select("paper_id", "ord", "chunk_id")


def shard_statistics(spark: SparkSession, base: str) -> DataFrame:
    """What the merge took of each archive."""
    s = _shards(spark, base)
    return store.merge_statistics(s, store.merge_papers(s))


def resume_skip(spark: SparkSession, base: str) -> DataFrame:
    """(tar, member_seq): members beyond what a checkpoint says is done of each archive, half of them here."""
    p = table(spark, base, "papers").select(F.regexp_extract("doc_id", "^tar://(.*?)!/", 1).alias("tar"), "paper_id").where("tar <> ''")
    members = store.numbered_within(p, "tar", "paper_id", "member_seq")
    done = members.groupBy("tar").agg(F.floor(F.count("*") / 2).alias("members_done"))
    return store.after_checkpoint(members.select("tar", "member_seq"), done)


def replace_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Passages after those of papers that came again have been replaced."""
    c = table(spark, base, "chunks").select("chunk_id", "paper_id", "ord", "loaded_at")
    return store.replace_chunks(c.where(F.col("loaded_at") < CUT), c.where(F.col("loaded_at") >= CUT)).select("chunk_id", "paper_id", "ord")


def identity_lookup(spark: SparkSession, base: str) -> DataFrame:
    """Papers loaded after the cut that were known before, by pmcid, else pmid, else document."""
    p = table(spark, base, "papers").select("paper_id", "pmcid", "pmid", "doc_id", "loaded_at")
    return store.match_identity(p.where(F.col("loaded_at") >= CUT), p.where(F.col("loaded_at") < CUT))


def _segments(spark: SparkSession, base: str) -> DataFrame:
    """Segment rows as another machine would have written them: documents and places instead of ids."""
    v = table(spark, base, "vectors").where("size(embedding) = 64").dropDuplicates(["id"])
    c = table(spark, base, "chunks").select("chunk_id", "paper_id", "ord")
    p = table(spark, base, "papers").select("paper_id", "doc_id")
    s = v.join(c, F.col("id") == F.col("chunk_id")).join(p, "paper_id", "left")
    return s.select(F.coalesce("doc_id", F.lit("tar://gone.tar!/none.xml")).alias("paper_doc_id"), "ord", F.col("embedding").alias("vec"))


def segment_resolve(spark: SparkSession, base: str) -> DataFrame:
    p, c = table(spark, base, "papers"), table(spark, base, "chunks")
    return store.resolve_segments(_segments(spark, base), p, c).groupBy("chunk_id").agg(F.count("*").alias("n"))


def segment_quarantine(spark: SparkSession, base: str) -> DataFrame:
    p, c = table(spark, base, "papers"), table(spark, base, "chunks")
    return store.unresolved_segments(_segments(spark, base), p, c).groupBy("paper_doc_id", "ord").agg(F.count("*").alias("n"))


def _ids(spark: SparkSession, base: str) -> DataFrame:
    return r.chunk_vectors(spark, base).select("id")


def reconcile_flags(spark: SparkSession, base: str) -> DataFrame:
    return store.flag_changes(table(spark, base, "chunks").select("chunk_id", "in_index"), _ids(spark, base), "chunk_id")


def backfill_set(spark: SparkSession, base: str) -> DataFrame:
    return store.backfill(table(spark, base, "chunks").select("chunk_id", "paper_id", "ord"), _ids(spark, base), "chunk_id")


def index_sanity(spark: SparkSession, base: str) -> DataFrame:
    p, c, f = (table(spark, base, t) for t in ("papers", "chunks", "files"))
    return store.sanity(p.select("paper_id", "in_index"), c.select("chunk_id", "paper_id", "ord", "in_index"), f.select("path"), _ids(spark, base))


def duplicate_report(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "chunks")
    return c.groupBy("paper_id", "ord").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first")).where("n > 1")


def shard_binpack(spark: SparkSession, base: str) -> DataFrame:
    return store.assign_shards(table(spark, base, "tars"), "tar", "bytes", 4)


def shard_balance(spark: SparkSession, base: str) -> DataFrame:
    return store.shard_loads(shard_binpack(spark, base))


def citation_normalize(spark: SparkSession, base: str) -> DataFrame:
    """Citations of every passage in one form; only texts with a bracket go to Python."""
    c = table(spark, base, "chunks").select("chunk_id", "text").where(F.col("text").rlike(r"[\[【]"))
    return c.select("chunk_id", citations.citations_in_one_form("text").alias("text"))


def citation_numbers(spark: SparkSession, base: str) -> DataFrame:
    """Numbers cited by every passage, ranges expanded up to 90."""
    c = table(spark, base, "chunks").select("chunk_id", "text").where(F.col("text").rlike(r"\[[0-9,\s\-–—]+\]"))
    return c.select("chunk_id", citations.cited("text", F.lit(90)).alias("numbers"))


def _answers(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    h = r.hydrate_chunks(spark, base).withColumn("idx", (F.col("pos") + 1).cast("int"))
    none = F.lit(None).cast("string")
    passages = h.select("qid", "idx", citations.document_key(none, F.col("pmcid"), F.col("pmid"), F.col("paper_id"), F.col("paper_title"), F.col("chunk_id")).alias("key"), "paper_title", "pmcid", "pmid", "chunk_id")
    answers = h.groupBy("qid").agg(F.max("idx").alias("n")).select("qid", F.format_string("Both hold [%d, 2]; more in [1-3] and [99], not in [3 patients].", "n").alias("answer"))
    return answers, passages, h


def citation_renumber(spark: SparkSession, base: str) -> DataFrame:
    answers, passages, _ = _answers(spark, base)
    return citations.renumber(answers, passages)


def references_render(spark: SparkSession, base: str) -> DataFrame:
    answers, passages, _ = _answers(spark, base)
    docs = citations.mentions(answers, passages)
    first = passages.withColumn("n", F.row_number().over(Window.partitionBy("qid", "key").orderBy("idx"))).where("n = 1")
    none = F.lit(None).cast("string")
    return citations.references(docs.join(first, ["qid", "key"]).select("qid", "docnum", F.col("paper_title").alias("title"), F.lit(None).cast("int").alias("year"), none.alias("doi"), "pmcid", "pmid"))


_NEW = "loaded_at DESC, size DESC NULLS LAST, mtime DESC NULLS LAST, paper_id DESC NULLS LAST"
_F = "path, size, mtime, paper_id, loaded_at"
_OLD = f"(SELECT {_F} FROM files WHERE loaded_at < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY path ORDER BY {_NEW}) = 1)"
_INC = f"(SELECT {_F} FROM files WHERE loaded_at >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY path ORDER BY {_NEW}) = 1)"
_IDS = f"SELECT id FROM ({r.usable_sql('vectors', 'id')})"
_SEG = "SELECT coalesce(p.doc_id, 'tar://gone.tar!/none.xml') AS paper_doc_id, c.ord FROM (SELECT DISTINCT id FROM vectors WHERE len(embedding) = 64) v JOIN chunks c ON c.chunk_id = v.id LEFT JOIN papers p ON p.paper_id = c.paper_id"
_DOC = "SELECT doc_id, max(paper_id) AS paper_id FROM papers WHERE doc_id <> '' GROUP BY doc_id"
_KEYED = f"{r._ALL}{r._ANN}, {r._LEX}, {r._FUSE}, {r._HYD}, ps AS (SELECT qid, CAST(pos + 1 AS INTEGER) AS idx, CASE WHEN trim(pmcid) <> '' THEN 'pmcid:' || upper(trim(pmcid)) WHEN trim(pmid) <> '' THEN 'pmid:' || trim(pmid) ELSE 'paper:' || paper_id END AS key, paper_title, pmid, pmcid FROM hy)"
# the answers cite the last passage, the second, then 1 to 3
_CITED = "cited AS (SELECT qid, n AS idx, 0 AS pos FROM m UNION ALL SELECT qid, 2, 1 FROM m UNION ALL SELECT qid, i, 1 + i FROM m, (VALUES (1), (2), (3)) t(i) WHERE i <= n)"
_DOCS = f"{_KEYED}, m AS (SELECT qid, max(idx) AS n FROM ps GROUP BY qid), {_CITED}, docs AS (SELECT qid, key, CAST(row_number() OVER (PARTITION BY qid ORDER BY min(c.pos)) AS INTEGER) AS docnum FROM cited c JOIN ps USING (qid, idx) GROUP BY qid, key)"
_NUMS = r"""list_filter(list_transform(str_split(b, ','), lambda x: trim(x)), lambda x: x <> '')"""

QUERIES = {
    f.__name__: f
    for f in (
        first_wins_dedupe, upsert_latest, insert_missing, incremental_antijoin, resume_skip, replace_chunks, identity_lookup, shard_merge, shard_merge_chunks, shard_statistics, segment_resolve, segment_quarantine, reconcile_flags, backfill_set, index_sanity,
        duplicate_report, shard_binpack, shard_balance, citation_normalize, citation_numbers, citation_renumber, references_render,
    )
}
_BINS = """WITH RECURSIVE o AS (SELECT tar AS path, bytes AS size, row_number() OVER (ORDER BY bytes DESC, tar) AS n FROM tars),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([0, 0, 0, 0] AS BIGINT[]) AS loads, CAST('' AS VARCHAR) AS path, CAST(0 AS BIGINT) AS size, CAST(0 AS INTEGER) AS shard
  UNION ALL SELECT o.n, list_transform(r.loads, lambda x, i: CASE WHEN i = list_position(r.loads, list_min(r.loads)) THEN x + o.size ELSE x END), o.path, o.size, CAST(list_position(r.loads, list_min(r.loads)) - 1 AS INTEGER) FROM r JOIN o ON o.n = r.n + 1),
b AS (SELECT path, size, shard FROM r WHERE n > 0) """
# one row after another, in the order of the merge
_MERGED = """RECURSIVE o AS (SELECT row_number() OVER (ORDER BY shard, paper_id) AS n, shard, paper_id, list_filter([CASE WHEN doc_id <> '' THEN 'd' || doc_id END, CASE WHEN pmcid <> '' THEN 'c' || pmcid END, CASE WHEN pmid <> '' THEN 'p' || pmid END], lambda x: x IS NOT NULL) AS ks
  FROM (SELECT *, regexp_extract(coalesce(doc_id, ''), '^tar://(.*?)!/', 1) AS shard FROM papers)),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS taken, false AS ok
  UNION ALL SELECT o.n, CASE WHEN list_has_any(r.taken, o.ks) THEN r.taken ELSE list_concat(r.taken, o.ks) END, NOT list_has_any(r.taken, o.ks) FROM r JOIN o ON o.n = r.n + 1),
m AS (SELECT shard, paper_id, row_number() OVER (ORDER BY o.n) AS new_id FROM r JOIN o USING (n) WHERE ok)"""
ORACLE = {
    "resume_skip": """SELECT tar, member_seq FROM (SELECT tar, row_number() OVER (PARTITION BY tar ORDER BY paper_id) - 1 AS member_seq, count(*) OVER (PARTITION BY tar) AS n
  FROM (SELECT regexp_extract(doc_id, '^tar://(.*?)!/', 1) AS tar, paper_id FROM papers) WHERE tar <> '') WHERE member_seq >= n // 2""",
    "replace_chunks": f"""SELECT chunk_id, paper_id, ord FROM chunks WHERE loaded_at >= TIMESTAMP '{CUT}' UNION ALL SELECT chunk_id, paper_id, ord FROM chunks c WHERE loaded_at < TIMESTAMP '{CUT}'
  AND NOT EXISTS (SELECT 1 FROM chunks f WHERE f.loaded_at >= TIMESTAMP '{CUT}' AND f.paper_id = c.paper_id)""",
    "identity_lookup": f"""WITH n AS (SELECT * FROM papers WHERE loaded_at >= TIMESTAMP '{CUT}'), o AS (SELECT * FROM papers WHERE loaded_at < TIMESTAMP '{CUT}')
SELECT * FROM (SELECT paper_id, coalesce((SELECT min(o.paper_id) FROM o WHERE o.pmcid = n.pmcid AND n.pmcid <> ''), (SELECT min(o.paper_id) FROM o WHERE o.pmid = n.pmid AND n.pmid <> ''), (SELECT min(o.paper_id) FROM o WHERE o.doc_id = n.doc_id AND n.doc_id <> '')) AS old_id FROM n) WHERE old_id IS NOT NULL""",
    "shard_merge": f"WITH {_MERGED} SELECT * FROM m",
    "shard_statistics": f"WITH {_MERGED} SELECT o.shard, count(*) AS rows, count(new_id) AS accepted, count(*) - count(new_id) AS refused FROM o LEFT JOIN m USING (shard, paper_id) GROUP BY o.shard",
    "shard_merge_chunks": f"WITH {_MERGED} SELECT new_id AS paper_id, ord, min(chunk_id) AS chunk_id FROM m JOIN chunks USING (paper_id) WHERE ord >= -1 GROUP BY new_id, ord",
    "citation_renumber": f"""{_DOCS}, l AS (SELECT c.qid, c.pos, d.docnum FROM cited c JOIN ps USING (qid, idx) JOIN docs d USING (qid, key)),
t AS (SELECT qid, list(docnum ORDER BY pos) FILTER (WHERE pos < 2) AS a, list(docnum ORDER BY pos) FILTER (WHERE pos > 1) AS b FROM l GROUP BY qid)
SELECT qid, 'Both hold [' || list_aggregate(list_filter(a, lambda x, i: list_position(a, x) = i), 'string_agg', ', ') || ']; more in [' || list_aggregate(list_filter(b, lambda x, i: list_position(b, x) = i), 'string_agg', ', ') || '] and [99], not in [3 patients].' AS answer FROM t""",
    "first_wins_dedupe": f"SELECT {_F} FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY loaded_at, size NULLS FIRST, mtime NULLS FIRST, paper_id NULLS FIRST) = 1",
    "upsert_latest": f"SELECT * FROM {_INC} UNION ALL SELECT * FROM {_OLD} WHERE path NOT IN (SELECT path FROM {_INC})",
    "insert_missing": f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_INC} WHERE path NOT IN (SELECT path FROM {_OLD})",
    "incremental_antijoin": f"SELECT path, size, mtime FROM (SELECT {_F} FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY {_NEW}) = 1) s WHERE NOT EXISTS (SELECT 1 FROM {_OLD} k WHERE k.path = s.path AND k.size = s.size AND abs(k.mtime - s.mtime) < 1e-6)",
    "segment_resolve": f"SELECT chunk_id, count(*) AS n FROM ({_SEG}) s JOIN ({_DOC}) d ON d.doc_id = s.paper_doc_id JOIN (SELECT paper_id, ord, max(chunk_id) AS chunk_id FROM chunks GROUP BY ALL) c ON c.paper_id = d.paper_id AND c.ord = s.ord GROUP BY chunk_id",
    "segment_quarantine": f"SELECT paper_doc_id, ord, count(*) AS n FROM ({_SEG}) s WHERE NOT EXISTS (SELECT 1 FROM ({_DOC}) d JOIN chunks c ON c.paper_id = d.paper_id WHERE d.doc_id = s.paper_doc_id AND c.ord = s.ord) GROUP BY ALL",
    "reconcile_flags": f'SELECT chunk_id, was, "is" FROM (SELECT chunk_id, coalesce(in_index, false) AS was, chunk_id IN ({_IDS}) AS "is" FROM chunks) WHERE was <> "is"',
    "backfill_set": f"SELECT chunk_id, paper_id, ord FROM chunks WHERE chunk_id NOT IN ({_IDS})",
    "index_sanity": f"""SELECT 'papers' AS what, count(*) AS rows, CAST(coalesce(sum(CASE WHEN in_index THEN 1 ELSE 0 END), 0) AS BIGINT) AS indexed, count(DISTINCT paper_id) AS distinct_keys, count(*) - count(DISTINCT paper_id) AS duplicates FROM papers
UNION ALL SELECT 'chunks', count(*), CAST(coalesce(sum(CASE WHEN in_index THEN 1 ELSE 0 END), 0) AS BIGINT), count(DISTINCT (paper_id, ord)), count(*) - count(DISTINCT (paper_id, ord)) FROM chunks
UNION ALL SELECT 'files', count(*), 0, count(DISTINCT path), count(*) - count(DISTINCT path) FROM files
UNION ALL SELECT 'index without passage', count(*), count(*), count(*), 0 FROM ({_IDS}) WHERE id NOT IN (SELECT chunk_id FROM chunks)""",
    "duplicate_report": "SELECT paper_id, ord, count(*) AS n, min(chunk_id) AS first FROM chunks GROUP BY paper_id, ord HAVING count(*) > 1",
    "shard_binpack": _BINS + "SELECT * FROM b",
    "shard_balance": _BINS + ", l AS (SELECT shard, CAST(sum(size) AS BIGINT) AS load FROM b GROUP BY shard), i AS (SELECT avg(load) AS ideal FROM l) SELECT shard, load, round(ideal, 3) AS ideal, round((load - ideal) * 100 / ideal, 3) AS imbalance FROM l, i",
    "citation_numbers": f"""SELECT chunk_id, flatten(list_transform(bs, lambda b: flatten(list_transform({_NUMS}, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN [CAST(x AS INTEGER)]
WHEN regexp_matches(x, '^[0-9]+\\s*[-–—]\\s*[0-9]+$') THEN CAST(range(greatest(1, least(CAST(regexp_extract(x, '^[0-9]+') AS INTEGER), CAST(regexp_extract(x, '[0-9]+$') AS INTEGER))), least(90, greatest(CAST(regexp_extract(x, '^[0-9]+') AS INTEGER), CAST(regexp_extract(x, '[0-9]+$') AS INTEGER))) + 1) AS INTEGER[]) ELSE CAST([] AS INTEGER[]) END)))) AS numbers
FROM (SELECT chunk_id, regexp_extract_all(text, '\\[([0-9,\\s\\-–—]+)\\]', 1) AS bs FROM chunks) WHERE len(bs) > 0""",
    "references_render": f"""{_DOCS} SELECT qid, 'References' || chr(10) || string_agg('[' || docnum || '] ' || coalesce(nullif(trim(paper_title), ''), 'untitled') || '.' || CASE WHEN trim(pmcid) <> '' OR trim(pmid) <> '' THEN '. ' || concat_ws(', ', CASE WHEN trim(pmcid) <> '' THEN 'PMCID: ' || trim(pmcid) END, CASE WHEN trim(pmid) <> '' THEN 'PMID: ' || trim(pmid) END) ELSE '' END, chr(10) ORDER BY docnum) AS block
FROM docs JOIN (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY idx) = 1) f USING (qid, key) GROUP BY qid""",
}
