"""Retrieval queries over batches of questions: every title whose paper_id is divisible by 50 is a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import question_terms, rare_terms
from tesserae.operators import ranking
from tesserae.operators.lexical import Lexical, search
from tesserae.operators.vectors import topk, usable
from tesserae.plans.text import norm_sql, rare_sql, terms_sql
from tesserae.session import table

WIDTH = 64
LIMIT, K, SHORTLIST, CAP, PER_PAPER = 200, 12, 10, 5, 2
PROMPT, BUDGET, MAX_OUT = "Answer from the passages and cite them by number.", 2000, 600


def questions(spark: SparkSession, base: str) -> DataFrame:
    """(qid, question, terms)."""
    p = table(spark, base, "papers").where("paper_id % 50 = 0 AND title <> ''")
    return p.select(F.col("paper_id").alias("qid"), F.col("title").alias("question"), rare_terms(question_terms("title")).alias("terms"))


def chunk_vectors(spark: SparkSession, base: str) -> DataFrame:
    """(id, v): the usable vectors of passages."""
    return usable(table(spark, base, "vectors"), "id", "embedding", WIDTH)


def paper_vectors(spark: SparkSession, base: str) -> DataFrame:
    """(id, v) by paper: the vector of its title-and-abstract passage, of the least chunk_id if there are several."""
    c = table(spark, base, "chunks").where("ord = -1").select("chunk_id", "paper_id")
    v = chunk_vectors(spark, base).join(c, F.col("id") == F.col("chunk_id"))
    return v.groupBy("paper_id").agg(F.min_by("v", "chunk_id").alias("v")).select(F.col("paper_id").alias("id"), "v")


def question_vectors(spark: SparkSession, base: str) -> DataFrame:
    """(id, v) of the questions, which are papers here."""
    return paper_vectors(spark, base).join(questions(spark, base).select(F.col("qid").alias("id")), "id", "left_semi")


def _store(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, base, "chunks").select("chunk_id", "paper_id", "ord", "text")
    return c, table(spark, base, "papers").select("paper_id", "title", "pmid", "pmcid")


def _shortlist(spark: SparkSession, base: str) -> DataFrame:
    return ranking.shortlist_papers(question_vectors(spark, base), paper_vectors(spark, base), SHORTLIST, WIDTH)


def lexical_global(spark: SparkSession, base: str) -> DataFrame:
    return search(questions(spark, base), *_store(spark, base), Lexical(LIMIT))


def lexical_candidates(spark: SparkSession, base: str) -> DataFrame:
    return search(questions(spark, base), *_store(spark, base), Lexical(LIMIT), _shortlist(spark, base))


def lexical_capped(spark: SparkSession, base: str) -> DataFrame:
    """At most two passages of a paper."""
    r = lexical_global(spark, base).withColumnRenamed("lex_rank", "pos")
    return ranking.cap_per_paper(r, PER_PAPER)


def knn_exact_topk(spark: SparkSession, base: str) -> DataFrame:
    """The 10 nearest passages of every vector whose id is divisible by 50."""
    v = chunk_vectors(spark, base)
    return topk(v.where("id % 50 = 0"), v, 10, WIDTH, skip_self=True).withColumn("score", F.round("score", 6))


def embedding_topk(spark: SparkSession, base: str) -> DataFrame:
    """The same over the table of embeddings."""
    v = usable(table(spark, base, "embeddings"), "vec_id", "embedding", WIDTH)
    return topk(v.where("id % 50 = 0"), v, 10, WIDTH, skip_self=True).withColumn("score", F.round("score", 6))


def paper_shortlist(spark: SparkSession, base: str) -> DataFrame:
    return _shortlist(spark, base).withColumn("score", F.round("score", 6))


def candidate_filter_semi(spark: SparkSession, base: str) -> DataFrame:
    """Nearest passages that belong to a shortlisted paper, in order."""
    v = topk(question_vectors(spark, base), chunk_vectors(spark, base), 100, WIDTH)
    c = table(spark, base, "chunks").select(F.col("chunk_id").alias("id"), "paper_id")
    return v.join(c, "id").join(_shortlist(spark, base).select("qid", "paper_id"), ["qid", "paper_id"], "left_semi").select("qid", "id", "paper_id", "rank")


def avg_chunks_per_paper(spark: SparkSession, base: str) -> DataFrame:
    return ranking.average_chunks(_shortlist(spark, base), table(spark, base, "chunks"))


def sparse_fallback(spark: SparkSession, base: str) -> DataFrame:
    return ranking.scopes(questions(spark, base), _shortlist(spark, base), table(spark, base, "chunks"), threshold=6.0)


def _ann(spark: SparkSession, base: str) -> DataFrame:
    return topk(question_vectors(spark, base), chunk_vectors(spark, base), 100, WIDTH).select("qid", F.col("id").alias("chunk_id"), F.col("rank").alias("ann_rank"))


def fuse_interleave(spark: SparkSession, base: str) -> DataFrame:
    return ranking.fuse(lexical_global(spark, base), _ann(spark, base), K, CAP)


def cap_per_paper(spark: SparkSession, base: str) -> DataFrame:
    keys = table(spark, base, "chunks").select("chunk_id", "paper_id")
    return ranking.cap_per_paper(fuse_interleave(spark, base).join(keys, "chunk_id").select("qid", "chunk_id", "paper_id", "pos"), PER_PAPER)


def stage2_search(spark: SparkSession, base: str) -> DataFrame:
    """The whole second stage: scopes, vectors, terms, fusion, cap, topping up and widening."""
    c, p = _store(spark, base)
    return ranking.search_passages(questions(spark, base), question_vectors(spark, base), _shortlist(spark, base), c, p, chunk_vectors(spark, base), K, WIDTH, overshoot=4, cap=PER_PAPER, lexical=Lexical(LIMIT, cap=CAP))


def hydrate_chunks(spark: SparkSession, base: str) -> DataFrame:
    c, p = _store(spark, base)
    return ranking.hydrate(fuse_interleave(spark, base), c, p)


def context_pack(spark: SparkSession, base: str) -> DataFrame:
    return ranking.pack_context(hydrate_chunks(spark, base), questions(spark, base), PROMPT, BUDGET, MAX_OUT)


def context_text(spark: SparkSession, base: str) -> DataFrame:
    return ranking.contexts(context_pack(spark, base), questions(spark, base))


def retry_schedule(spark: SparkSession, base: str) -> DataFrame:
    """What each attempt would send for as many passages as a paper has, for every such number."""
    n = table(spark, base, "chunks").groupBy("paper_id").agg(F.count("*").cast("int").alias("chunks")).select("chunks").distinct()
    return n.select("chunks", F.explode(ranking.retry_schedule(F.col("chunks"), F.lit(3000))).alias("s")).select(F.col("chunks").alias("asked"), "s.attempt", "s.chunks", "s.max_out")


_Q = f"q AS (SELECT paper_id AS qid, title AS question, {rare_sql('t')} AS terms FROM (SELECT paper_id, title, {terms_sql('title')} AS t FROM papers WHERE paper_id % 50 = 0 AND title <> ''))"


def usable_sql(tbl: str, key: str) -> str:
    return f"SELECT {key} AS id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM (SELECT {key}, min(CAST(embedding AS DOUBLE[])) AS e FROM {tbl} WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY {key})"


_V = f"v AS ({usable_sql('vectors', 'id')})"
_PV = "pv AS (SELECT paper_id AS id, arg_min(v, chunk_id) AS v FROM v JOIN chunks c ON c.chunk_id = v.id WHERE ord = -1 GROUP BY paper_id), qv AS (SELECT pv.* FROM pv JOIN q ON q.qid = pv.id)"


def topk_sql(queries: str, corpus: str, k: int, other: bool = False) -> str:
    return (
        f"SELECT * FROM (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS INTEGER) AS rank FROM "
        f"(SELECT a.id AS qid, b.id, round(list_dot_product(a.v, b.v), 9) AS score FROM {queries} a, {corpus} b{' WHERE a.id <> b.id' if other else ''})) WHERE rank < {k}"
    )


_SHORT = f"sl AS (SELECT qid, id AS paper_id, score, rank FROM ({topk_sql('qv', 'pv', SHORTLIST)}))"
_ANN = f"ann AS (SELECT qid, id AS chunk_id, rank AS ann_rank FROM ({topk_sql('qv', 'v', 100)}))"


def _lex(name: str, extra: str = "") -> str:
    t = norm_sql("c.text")
    return f"""{name} AS (SELECT * FROM (SELECT q.qid, c.chunk_id, c.paper_id, CAST(row_number() OVER (PARTITION BY q.qid ORDER BY c.ord = -1 DESC, coalesce(contains({norm_sql('p.title')}, {norm_sql('q.terms[1]')}), false) DESC,
  p.pmid IS NOT NULL DESC, p.pmcid IS NOT NULL DESC, c.chunk_id) - 1 AS INTEGER) AS lex_rank
  FROM q JOIN chunks c ON len(list_filter(q.terms, lambda w: contains({t}, {norm_sql('w')}))) > 0 JOIN papers p ON p.paper_id = c.paper_id {extra}) WHERE lex_rank < {LIMIT})"""


_LEX = _lex("lx")
_FUSE = f"""fz AS (SELECT qid, chunk_id, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY turn) - 1 AS INTEGER) AS pos FROM (SELECT qid, chunk_id, min(turn) AS turn FROM
  (SELECT qid, chunk_id, 2 * lex_rank AS turn FROM lx WHERE lex_rank < {CAP} UNION ALL SELECT qid, chunk_id, 2 * ann_rank + 1 FROM ann) GROUP BY qid, chunk_id)) WHERE pos < {K})"""
_HYD = "hy AS (SELECT f.qid, f.pos, c.chunk_id, c.paper_id, c.ord, coalesce(c.text, '') AS text, coalesce(p.title, '') AS paper_title, coalesce(p.pmid, '') AS pmid, coalesce(p.pmcid, '') AS pmcid FROM fz f JOIN chunks c USING (chunk_id) JOIN papers p ON p.paper_id = c.paper_id)"
_FIXED = BUDGET - MAX_OUT - sum(max(1, len(s) // 4) for s in (PROMPT, "QUESTION:\n", "\n\nCONTEXT:\n")) - 200
_BLOCK = "'[' || (pos + 1) || '] ' || trim(paper_title) || CASE WHEN pmcid <> '' THEN ' (PMCID:' || pmcid || ')' WHEN pmid <> '' THEN ' (PMID:' || pmid || ')' ELSE '' END || chr(10) || text"
_PACK = f"""pk AS (SELECT * FROM (SELECT b.qid, CAST(pos + 1 AS INTEGER) AS idx, chunk_id, block, CAST(cost AS INTEGER) AS cost, CAST(sum(cost) OVER (PARTITION BY b.qid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used, greatest(0, {_FIXED} - greatest(1, length(question) // 4)) AS room
  FROM (SELECT *, greatest(1, length(block) // 4) + 20 AS cost FROM (SELECT *, {_BLOCK} AS block FROM hy)) b JOIN q ON q.qid = b.qid) WHERE used <= room)"""
_ALL = f"WITH {_Q}, {_V}, {_PV}, "
_AVG = "av AS (SELECT sl.qid, round(coalesce(sum(n), 0) / count(*), 6) AS avg_chunks FROM sl LEFT JOIN (SELECT paper_id, count(*) AS n FROM chunks GROUP BY paper_id) USING (paper_id) GROUP BY sl.qid)"
_WIDE = max(K * 4, 100)
_STAGE2 = f"""{_ALL}{_SHORT}, {_AVG},
sc AS (SELECT qid, CASE WHEN avg_chunks IS NULL OR avg_chunks < 2 THEN 'global' ELSE 'candidates' END AS ann_scope, CASE WHEN avg_chunks < 2 THEN 'global' WHEN avg_chunks IS NULL THEN 'none' ELSE 'candidates' END AS lexical_scope FROM q LEFT JOIN av USING (qid)),
found AS (SELECT f.qid, f.id AS chunk_id, c.paper_id, f.rank, (sc.ann_scope = 'global' OR EXISTS (SELECT 1 FROM sl WHERE sl.qid = f.qid AND sl.paper_id = c.paper_id)) AS fits FROM ({topk_sql('qv', 'v', 4 * _WIDE)}) f JOIN chunks c ON c.chunk_id = f.id JOIN sc ON sc.qid = f.qid),
ann AS (SELECT qid, chunk_id, paper_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS INTEGER) AS ann_rank FROM found WHERE rank < {_WIDE} AND fits),
{_lex('lx', "JOIN sc ON sc.qid = q.qid WHERE q.qid IN (SELECT qid FROM found) AND (sc.lexical_scope = 'global' OR (sc.lexical_scope = 'candidates' AND EXISTS (SELECT 1 FROM sl WHERE sl.qid = q.qid AND sl.paper_id = c.paper_id)))")},
{_FUSE},
seg AS (SELECT f.qid, f.chunk_id, c.paper_id, 0 AS segment, pos AS rank FROM fz f JOIN chunks c USING (chunk_id) UNION ALL SELECT qid, chunk_id, paper_id, 1, ann_rank FROM ann
  UNION ALL SELECT qid, chunk_id, paper_id, CASE WHEN rank < {2 * _WIDE} THEN 2 ELSE 3 END, rank FROM found WHERE rank >= {_WIDE} AND fits),
one AS (SELECT qid, chunk_id, paper_id, segment, rank FROM seg QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY segment, rank) = 1),
kept AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY qid, paper_id ORDER BY segment, rank) <= {PER_PAPER})
SELECT qid, chunk_id, paper_id, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY segment, rank) - 1 AS INTEGER) AS pos FROM kept) WHERE pos < {K}"""

QUERIES = {
    f.__name__: f
    for f in (
        lexical_global, lexical_candidates, lexical_capped, knn_exact_topk, embedding_topk, paper_shortlist, candidate_filter_semi, avg_chunks_per_paper, sparse_fallback, fuse_interleave,
        cap_per_paper, stage2_search, hydrate_chunks, context_pack, context_text, retry_schedule,
    )
}
ORACLE = {
    "lexical_global": f"WITH {_Q}, {_LEX} SELECT * FROM lx",
    "lexical_candidates": f"{_ALL}{_SHORT}, {_lex('lx', 'WHERE EXISTS (SELECT 1 FROM sl WHERE sl.qid = q.qid AND sl.paper_id = c.paper_id)')} SELECT * FROM lx",
    "lexical_capped": f"WITH {_Q}, {_LEX} SELECT qid, chunk_id, paper_id, lex_rank AS pos FROM lx QUALIFY row_number() OVER (PARTITION BY qid, paper_id ORDER BY lex_rank) <= {PER_PAPER}",
    "knn_exact_topk": f"WITH {_V}, s AS (SELECT * FROM v WHERE id % 50 = 0) SELECT qid, id, round(score, 6) AS score, rank FROM ({topk_sql('s', 'v', 10, True)})",
    "embedding_topk": f"WITH v AS ({usable_sql('embeddings', 'vec_id')}), s AS (SELECT * FROM v WHERE id % 50 = 0) SELECT qid, id, round(score, 6) AS score, rank FROM ({topk_sql('s', 'v', 10, True)})",
    "paper_shortlist": f"{_ALL}{_SHORT} SELECT qid, paper_id, round(score, 6) AS score, rank FROM sl",
    "candidate_filter_semi": f"{_ALL}{_SHORT}, {_ANN} SELECT a.qid, a.chunk_id AS id, c.paper_id, a.ann_rank AS rank FROM ann a JOIN chunks c USING (chunk_id) WHERE EXISTS (SELECT 1 FROM sl WHERE sl.qid = a.qid AND sl.paper_id = c.paper_id)",
    "avg_chunks_per_paper": f"{_ALL}{_SHORT}, {_AVG} SELECT * FROM av",
    "sparse_fallback": f"{_ALL}{_SHORT}, {_AVG} SELECT qid, CASE WHEN avg_chunks IS NULL OR avg_chunks < 6 THEN 'global' ELSE 'candidates' END AS ann_scope, CASE WHEN avg_chunks < 6 THEN 'global' WHEN avg_chunks IS NULL THEN 'none' ELSE 'candidates' END AS lexical_scope FROM q LEFT JOIN av USING (qid)",
    "fuse_interleave": f"{_ALL}{_ANN}, {_LEX}, {_FUSE} SELECT * FROM fz",
    "cap_per_paper": f"{_ALL}{_ANN}, {_LEX}, {_FUSE} SELECT f.qid, f.chunk_id, c.paper_id, f.pos FROM fz f JOIN chunks c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY f.qid, c.paper_id ORDER BY f.pos) <= {PER_PAPER}",
    "stage2_search": _STAGE2,
    "hydrate_chunks": f"{_ALL}{_ANN}, {_LEX}, {_FUSE}, {_HYD} SELECT * FROM hy",
    "context_pack": f"{_ALL}{_ANN}, {_LEX}, {_FUSE}, {_HYD}, {_PACK} SELECT qid, idx, chunk_id, block, cost, used FROM pk",
    "context_text": f"{_ALL}{_ANN}, {_LEX}, {_FUSE}, {_HYD}, {_PACK} SELECT q.qid, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY idx), '(no context)') AS context, CAST(count(block) AS INTEGER) AS n_used FROM q LEFT JOIN pk ON pk.qid = q.qid GROUP BY q.qid",
    "retry_schedule": """WITH RECURSIVE r AS (SELECT CAST(n AS INTEGER) AS asked, 0 AS attempt, CAST(n AS INTEGER) AS chunks, 3000 AS max_out FROM (SELECT DISTINCT count(*) AS n FROM chunks GROUP BY paper_id)
UNION ALL SELECT asked, attempt + 1, CAST(CASE WHEN chunks > 1 THEN greatest(1, CASE WHEN attempt = 0 THEN floor(chunks * CAST(0.7 AS DOUBLE)) ELSE chunks // 2 END) ELSE chunks END AS INTEGER), CAST(greatest(128, floor(max_out * 0.75)) AS INTEGER) FROM r WHERE attempt < 3) SELECT * FROM r""",
}
