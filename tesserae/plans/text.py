"""Text queries: passages of articles, paper texts, search forms, question terms, error classes, parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import errors, parameters
from tesserae.functions.text import DASHES, LOWERED, SOFT_HYPHEN, STOPWORDS, approx_tokens, hashed_words, paper_text, question_terms, rare_terms, search_form
from tesserae.operators.chunking import OVERLAP, SHORT, TARGET, passages
from tesserae.session import table


def _articles(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "article").select("doc_id", "title", "abstract", "paragraphs").distinct()


def chunk_pack(spark: SparkSession, base: str) -> DataFrame:
    """Passages of every article, with the title-and-abstract passage."""
    return passages(_articles(spark, base))


def chunk_sizes(spark: SparkSession, base: str) -> DataFrame:
    """Passages and characters by article."""
    p = chunk_pack(spark, base).where("ord >= 0")
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


def paper_texts(spark: SparkSession, base: str) -> DataFrame:
    a = _articles(spark, base)
    return a.select("doc_id", paper_text(F.col("title"), F.col("abstract"), F.array_compact("paragraphs")).alias("text"))


def normalize_text(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "chunks").select("chunk_id", search_form("text").alias("norm"), approx_tokens("text").alias("tokens"))


def query_terms(spark: SparkSession, base: str) -> DataFrame:
    """Terms of every title as if it were a question."""
    return table(spark, base, "papers").where("title IS NOT NULL").select("paper_id", question_terms("title").alias("terms"))


def query_rare_terms(spark: SparkSession, base: str) -> DataFrame:
    return query_terms(spark, base).select("paper_id", rare_terms("terms").alias("terms"))


def word_vectors(spark: SparkSession, base: str) -> DataFrame:
    """Hashed word counts of every title."""
    return table(spark, base, "papers").where("title IS NOT NULL").select("paper_id", hashed_words("title", 16).alias("v"))


def error_classes(spark: SparkSession, base: str) -> DataFrame:
    """Classes of messages: event rows stand for calls that failed."""
    e = table(spark, base, "events").select("event_id", "event_type", "user_id")
    kinds = F.array(*map(F.lit, ("Prompt too long: reduce it", "401 Unauthorized", "404 model not found", "405 Method not allowed", "socket closed", "Token limit reached")))
    msg = F.concat(F.element_at(kinds, (F.pmod("event_id", F.lit(6)) + 1).cast("int")), F.lit(" during "), F.col("event_type"))
    return e.select("event_id", errors.error_class(msg).alias("class"))


def message_classes(spark: SparkSession, base: str) -> DataFrame:
    """Classes of all documents, each taken as the message of a failed call."""
    d = table(spark, base, "documents")
    return d.select("doc_id", errors.error_class(F.col("text")).alias("class"))


def _counts(spark: SparkSession, base: str, name: str, most: int) -> DataFrame:
    """(name): numbers from 1 to most that the sizes of all files stand for, each once."""
    f = table(spark, base, "files").where("size IS NOT NULL")
    return f.select((F.abs("size") % most + 1).cast("int").alias(name)).distinct()


def nprobe_pick(spark: SparkSession, base: str) -> DataFrame:
    """Probes for as many lists as the files' sizes stand for."""
    n = _counts(spark, base, "nlist", 131_072)
    return n.select("nlist", parameters.pick_nprobe(F.col("nlist")).alias("nprobe"), parameters.auto_nprobe(F.col("nlist")).alias("auto"), parameters.pick_nprobe(F.col("nlist"), 2000).alias("forced"))


def pq_m_pick(spark: SparkSession, base: str) -> DataFrame:
    """Widths of codes for what the files' sizes stand for."""
    n = _counts(spark, base, "wanted", 64)
    return n.select("wanted", parameters.safe_pq_m(768, F.col("wanted")).alias("m768"), parameters.safe_pq_m(30, F.col("wanted")).alias("m30"))


def nlist_pick(spark: SparkSession, base: str) -> DataFrame:
    """Index plans for as many vectors as the files' sizes stand for."""
    n = _counts(spark, base, "n", 1_000_000)
    p, s = parameters.ivf_plan(F.col("n"), 768, 16384, 64), parameters.safe_ivfpq(F.col("n"), 768, 16384, 64)
    return n.select("n", parameters.effective_nlist(F.col("n"), 16384).alias("nlist"), p["kind"].alias("kind"), p["nlist"].alias("lists"), s["nlist"].alias("safe"), s["use_flat"].alias("flat"))


def top_papers_pick(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "papers").agg(F.count("*").alias("n")).select("n", parameters.top_papers(F.col("n")).alias("top"))


_FROM, _TO = DASHES + LOWERED, "-" * len(DASHES) + "0123456789"


def norm_sql(c: str) -> str:
    return f"replace(translate(lower({c}), '{_FROM}', '{_TO}'), '{SOFT_HYPHEN}', '')"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def terms_sql(c: str) -> str:
    return (
        f"list_filter(list_filter(regexp_extract_all(lower({c}), '[A-Za-z0-9_-]{{3,}}'), lambda w: NOT list_contains([{_STOP}], w) AND (length(w) >= 5 OR regexp_matches(w, '[0-9_-]'))),"
        f" lambda w, i: list_position(list_filter(regexp_extract_all(lower({c}), '[A-Za-z0-9_-]{{3,}}'), lambda x: NOT list_contains([{_STOP}], x) AND (length(x) >= 5 OR regexp_matches(x, '[0-9_-]'))), w) = i)"
    )


def rare_sql(t: str) -> str:
    odd = f"list_filter({t}, lambda w: regexp_matches(w, '[0-9_%\\\\-]'))"
    return f"list_slice(CASE WHEN len({odd}) > 0 THEN {odd} ELSE list_filter({t}, lambda w: length(w) >= 9) END, 1, 8)"


ARTICLES_SQL = "SELECT DISTINCT doc_id, title, abstract, paragraphs FROM article"
_PARAS = "list_filter(coalesce(paragraphs, []), lambda x: x IS NOT NULL)"
_TEXT = f"coalesce(nullif(trim(coalesce(trim(title), '') || ' ' || coalesce(trim(abstract), '')), ''), substr({_PARAS}[1], 1, 800), 'untitled')"
_CLOSE = f"CASE WHEN s.open IS NULL THEN s.done WHEN length(s.open) < {SHORT} AND len(s.done) > 0 THEN list_concat(s.done[:-2], [s.done[-1] || ' ' || s.open]) ELSE list_append(s.done, s.open) END"
PASSAGES_SQL = f"""
SELECT doc_id, -1 AS ord, {_TEXT} AS text FROM a
UNION ALL
SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, CASE WHEN i = 1 THEN ch[i] ELSE trim(right(ch[i - 1], {OVERLAP}) || ' ' || ch[i]) END AS text
FROM (SELECT doc_id, ch, unnest(range(1, len(ch) + 1)) AS i FROM (
  SELECT doc_id, {_CLOSE} AS ch FROM (
    SELECT doc_id, list_reduce(list_prepend({{done: CAST([] AS VARCHAR[]), open: CAST(NULL AS VARCHAR)}}, list_transform(paras, lambda p: {{done: CAST([] AS VARCHAR[]), open: p}})),
      lambda s, e: CASE WHEN s.open IS NULL THEN {{done: s.done, open: e.open}}
        WHEN length(s.open) + 1 + length(e.open) + 1 > {TARGET} THEN {{done: {_CLOSE}, open: e.open}}
        ELSE {{done: s.done, open: s.open || ' ' || e.open}} END) AS s
    FROM (SELECT doc_id, CASE WHEN len({_PARAS}) > 0 THEN {_PARAS} WHEN coalesce(trim(abstract), '') <> '' THEN [trim(abstract)] ELSE [] END AS paras FROM a))))
"""
_MSG = "['Prompt too long: reduce it', '401 Unauthorized', '404 model not found', '405 Method not allowed', 'socket closed', 'Token limit reached'][(event_id % 6) + 1] || ' during ' || event_type"


def _has(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(m, '{p}')" for p in parts) + ")"


def _pick(n: str, target: str) -> str:
    return f"CAST(least({n}, greatest(CASE WHEN {n} >= 16384 THEN 32 ELSE 8 END, least(CASE WHEN {n} >= 65536 THEN 1024 ELSE 512 END, {target}))) AS INTEGER)"


def _counts_sql(name: str, most: int) -> str:
    return f"SELECT DISTINCT CAST(abs(size) % {most} + 1 AS INTEGER) AS {name} FROM files WHERE size IS NOT NULL"


_ROOT = "CAST(floor(sqrt(greatest(nlist, 1))) AS INTEGER)"
_EFF = "CASE WHEN n <= 0 THEN 0 ELSE greatest(least(n, CASE WHEN n >= 100000 THEN 128 ELSE 16 END), least(16384, n, greatest(1, CAST(floor(4 * sqrt(n)) AS INTEGER)))) END"

QUERIES = {
    "chunk_pack": chunk_pack, "chunk_sizes": chunk_sizes, "paper_texts": paper_texts, "normalize_text": normalize_text, "query_terms": query_terms, "query_rare_terms": query_rare_terms,
    "word_vectors": word_vectors, "error_classes": error_classes, "message_classes": message_classes, "nprobe_pick": nprobe_pick, "pq_m_pick": pq_m_pick, "nlist_pick": nlist_pick, "top_papers_pick": top_papers_pick,
}
ORACLE = {
    "chunk_pack": f"WITH a AS ({ARTICLES_SQL}) {PASSAGES_SQL}",
    "chunk_sizes": f"WITH a AS ({ARTICLES_SQL}), p AS ({PASSAGES_SQL}) SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS INTEGER) AS longest FROM p WHERE ord >= 0 GROUP BY doc_id",
    "paper_texts": f"SELECT doc_id, {_TEXT} AS text FROM ({ARTICLES_SQL})",
    "normalize_text": f"SELECT chunk_id, {norm_sql('text')} AS norm, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM chunks",
    "query_terms": f"SELECT paper_id, {terms_sql('title')} AS terms FROM papers WHERE title IS NOT NULL",
    "query_rare_terms": f"SELECT paper_id, {rare_sql('terms')} AS terms FROM (SELECT paper_id, {terms_sql('title')} AS terms FROM papers WHERE title IS NOT NULL)",
    "word_vectors": "SELECT paper_id, list_transform(range(16), lambda b: CAST(len(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 16 = b)) AS DOUBLE)) AS v FROM papers WHERE title IS NOT NULL",
    "error_classes": f"""SELECT event_id, CASE WHEN {_has(errors.NO_MODEL)} AND contains(m, 'model') THEN 'model' WHEN {_has(errors.AUTH)} THEN 'auth' WHEN {_has(errors.UNSUPPORTED)} THEN 'unsupported'
WHEN {_has(errors.OVERFLOW)} THEN 'overflow' ELSE 'other' END AS class FROM (SELECT event_id, lower({_MSG}) AS m FROM events)""",
    "message_classes": f"""SELECT doc_id, CASE WHEN {_has(errors.NO_MODEL)} AND contains(m, 'model') THEN 'model' WHEN {_has(errors.AUTH)} THEN 'auth' WHEN {_has(errors.UNSUPPORTED)} THEN 'unsupported'
WHEN {_has(errors.OVERFLOW)} THEN 'overflow' ELSE 'other' END AS class FROM (SELECT doc_id, lower(coalesce(text, '')) AS m FROM documents)""",
    "nprobe_pick": f"SELECT nlist, {_pick('nlist', _ROOT)} AS nprobe, greatest(8, least(512, {_pick('nlist', _ROOT)})) AS auto, {_pick('nlist', '2000')} AS forced FROM ({_counts_sql('nlist', 131072)})",
    "pq_m_pick": f"SELECT w AS wanted, CAST(list_max(list_filter(range(1, w + 1), lambda x: 768 % x = 0)) AS INTEGER) AS m768, CAST(list_max(list_filter(range(1, w + 1), lambda x: 30 % x = 0)) AS INTEGER) AS m30 FROM ({_counts_sql('w', 64)})",
    "nlist_pick": f"""SELECT n, CAST(e AS INTEGER) AS nlist, CASE WHEN few THEN 'flat' ELSE 'ivfpq' END AS kind, CASE WHEN few THEN 0 ELSE lists END AS lists,
CASE WHEN n < 9984 THEN 0 ELSE CAST(greatest(1, least(16384, n // 39)) AS INTEGER) END AS safe, n < 9984 AS flat
FROM (SELECT *, n < 9984 OR lists < 8 OR n < 50 * lists AS few FROM (SELECT *, CAST(least(e, greatest(1, n // 40)) AS INTEGER) AS lists FROM (SELECT n, {_EFF} AS e FROM ({_counts_sql('n', 1000000)}))))""",
    "top_papers_pick": "SELECT n, CASE WHEN n < 50000 THEN 500 WHEN n < 500000 THEN 1000 WHEN n < 2000000 THEN 2000 ELSE 4000 END AS top FROM (SELECT count(*) AS n FROM papers)",
}
