"""Queries of the package by name, with SQL where SQL can say the same."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import abuse, lookalikes, near_duplicates, neighbours, packing, shared_spans, splitting, survivors, tokenizing
from tesserae.session import table


SPAN = 160


def p1_spans(spark: SparkSession, base: str) -> DataFrame:
    """(id, begins, ends, shared_chars, share) of the chunks that share long spans with chunks of other papers."""
    found = shared_spans.shared_spans(table(spark, base, "chunks"), "chunk_id", "paper_id", "text", SPAN)
    return found.select("id", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends"), "shared_chars", "share")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """(chunk_id) of the chunks with a factor."""
    return shared_spans.factors(table(spark, base, "chunks"), "chunk_id", "paper_id", "text", SPAN).select(F.col("id").alias("chunk_id")).distinct()


NEAREST, ALIKE = 10, 0.92
#: Without a least similarity the nearest are far off, so windows are wide: 0.9 of the ten nearest and more at 93,000 vectors.
FAR = neighbours.Curves(count=24, window=1024)


def p2_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """(id, other, similarity, rank): the 10 most similar other vectors of every vector, nearest first."""
    v = table(spark, base, "vectors").select("id", "embedding")
    near = neighbours.neighbours(v, "id", "embedding", NEAREST, curves=FAR)
    return near.unionByName(neighbours.copies_beyond(v, "id", "embedding", NEAREST)).withColumn("similarity", F.round("similarity", 6))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """(id_a, id_b); copies beyond the first eleven are in nobody's list, so they need no part here."""
    v = table(spark, base, "vectors").select("id", "embedding")
    return neighbours.mutual(neighbours.neighbours(v, "id", "embedding", NEAREST, least=ALIKE))


def p3_best(spark: SparkSession, base: str) -> DataFrame:
    """The surviving record of every article that occurs more than once, and where each field comes from."""
    return survivors.best_papers(table(spark, base, "papers"), table(spark, base, "tars"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """(group_id, pmid_from, pmcid_from, abstract_from)."""
    return survivors.best_sources(table(spark, base, "papers"), table(spark, base, "tars")).select("group_id", "pmid_from", "pmcid_from", "abstract_from")


SIMILAR = near_duplicates.Join(words=3, threshold=0.6, least_words=20)


def p5_similar(spark: SparkSession, base: str) -> near_duplicates.NearDuplicates:
    """Classes of equal word sequences among papers and body chunks, and the similar pairs of classes."""
    c = table(spark, base, "chunks").where("ord >= 0").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("id"), "text")
    p = table(spark, base, "papers").select(F.lit("papers").alias("tbl"), F.col("paper_id").alias("id"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))).alias("text"))
    return near_duplicates.near_duplicates(c.unionByName(p), SIMILAR)


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """(tbl, id_a, id_b)."""
    return p5_similar(spark, base).expanded()


def p5_groups(spark: SparkSession, base: str) -> DataFrame:
    """(tbl, id, group_id, links) of the records that have a similar one."""
    return p5_similar(spark, base).groups()


def p4_forms(spark: SparkSession, base: str) -> DataFrame:
    """(tbl, row_id, form, changed) for every chunk text and paper title."""
    c = table(spark, base, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("row_id"), "text")
    p = table(spark, base, "papers").select(F.lit("papers").alias("tbl"), F.col("paper_id").alias("row_id"), F.col("title").alias("text"))
    return lookalikes.consistent_text(c.unionByName(p), "text").select("tbl", "row_id", "form", "changed")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """(tbl, row_id) of the rows whose text is not in its consistent form."""
    return p4_forms(spark, base).where("changed").select("tbl", "row_id").distinct()


LIMIT, OVERLAP = 1500, 200


def p7_pieces(spark: SparkSession, base: str) -> DataFrame:
    """(tbl, row_key, pos, piece, begin, end, piece_text) of the oversized chunks and paragraphs; repeated rows once."""
    c = table(spark, base, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").cast("string").alias("row_key"), F.col("ord").alias("pos"), "text")
    a = table(spark, base, "article").select(F.lit("article").alias("tbl"), F.col("doc_id").alias("row_key"), F.posexplode("paragraphs").alias("pos", "text"))
    big = c.unionByName(a).where(F.char_length("text") > LIMIT).distinct()
    return splitting.split_oversized(big, "text", LIMIT, OVERLAP)


def p7_rebuilt(spark: SparkSession, base: str) -> DataFrame:
    """(tbl, row_key, pos, text, fits, overlaps): the items put together again from their pieces without the overlaps, and
    whether all pieces keep the limit and begin with the stated overlap."""
    p = p7_pieces(spark, base)
    own = F.when(F.col("piece") == 0, F.col("piece_text")).otherwise(F.substring("piece_text", OVERLAP + 1, LIMIT))
    piece = F.struct("piece", own.alias("own"), F.col("piece_text").alias("t"))
    per = p.groupBy("tbl", "row_key", "pos").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.right(a["t"], F.lit(OVERLAP)) == F.left(b["t"], F.lit(OVERLAP)))
    return per.select("tbl", "row_key", "pos", F.array_join("p.own", "").alias("text"), F.forall("p", lambda x: F.char_length(x["t"]) <= LIMIT).alias("fits"), F.forall(pairs, lambda x: x).alias("overlaps"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """(tbl, row_key, pos) of the items that came out in pieces, each once."""
    return p7_pieces(spark, base).where("piece = 1").select("tbl", "row_key", "pos").distinct()


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, ids)."""
    return tokenizing.encode_texts(table(spark, base, "documents").select("doc_id", "text"), "text")


def p8_texts(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, digest) of what the ids of each document stand for; those of null and empty texts for nothing."""
    return tokenizing.decode_ids(p8_ids(spark, base), "ids", "text").select("doc_id", F.md5("text").alias("digest"))


CAPACITY, SHARD_ITEMS = 2048, 50_000


def p9_containers(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, n_tokens, piece, container, start, length) of every document."""
    docs = table(spark, base, "documents").select("doc_id", "text")
    return packing.fill_containers(tokenizing.count_tokens(docs, "text"), "n_tokens", CAPACITY, SHARD_ITEMS)


def p9_fill(spark: SparkSession, base: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.fill_report(p9_containers(spark, base), CAPACITY)


def p9_layout(spark: SparkSession, base: str) -> DataFrame:
    """One row: documents laid out, places that overlap or leave a gap, containers over the capacity, and texts that were cut
    without being too long."""
    p = p9_containers(spark, base)
    before = F.lag(F.col("start") + F.col("length"), 1, 0).over(Window.partitionBy("container").orderBy("start", "length"))
    per = p.withColumn("off", (F.col("start") != before).cast("long")).groupBy("container").agg(F.sum("off").alias("off"), (F.sum("length") > CAPACITY).cast("long").alias("over"))
    boxes = per.agg(F.coalesce(F.sum("off"), F.lit(0)).alias("misplaced"), F.coalesce(F.sum("over"), F.lit(0)).alias("over"))
    docs = p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max("n_tokens").alias("n"), F.sum("length").alias("laid"))
    wrong = ((F.col("laid") != F.col("n")) | ((F.col("pieces") > 1) & (F.col("n") <= CAPACITY))).cast("long")
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(wrong), F.lit(0)).alias("cut")).crossJoin(boxes)


def p10_scores(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, source, score, flagged) of every document."""
    return abuse.score_documents(table(spark, base, "documents").select("doc_id", "source", "text"), "text")


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id) of the flagged documents, each once."""
    return p10_scores(spark, base).where("flagged").select("doc_id").distinct()


def p10_rates(spark: SparkSession, base: str) -> DataFrame:
    """(source, documents, flagged, rate)."""
    return abuse.rates(p10_scores(spark, base), "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_spans": p1_spans, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p3_best": p3_best, "p5_found": p5_found, "p5_groups": p5_groups, "p4_found": p4_found, "p4_forms": p4_forms, "p7_found": p7_found, "p7_pieces": p7_pieces, "p7_rebuilt": p7_rebuilt, "p8_ids": p8_ids, "p8_texts": p8_texts, "p9_containers": p9_containers, "p9_fill": p9_fill, "p9_layout": p9_layout, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}

# lists of its own, in the form of ranges and scripts
_P4_ODD = r"[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{1D400}-\x{1D7FF}\x{FB00}-\x{FB06}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{212A}\x{2102}\x{210A}-\x{2113}\x{2115}\x{2119}-\x{211D}\x{2124}\x{2128}\x{212C}\x{212D}\x{212F}-\x{2131}\x{2133}\x{2134}\x{A0}\x{AD}\x{1680}\x{2000}-\x{200B}\x{200E}\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{2066}-\x{2069}\x{2800}\x{3000}\x{3164}\x{FEFF}]"
_P4_OTHER = r"\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Lisu}\x{391}-\x{3A1}\x{3A4}-\x{3A7}\x{3BF}\x{261}"
_P4_LATIN = r"A-Za-z\x{C0}-\x{24F}"
_P4 = f"regexp_matches(t, '{_P4_ODD}|[\\x{{0}}-\\x{{24F}}][\\x{{200C}}\\x{{200D}}]|[\\x{{200C}}\\x{{200D}}][\\x{{0}}-\\x{{24F}}]|\\p{{L}}[\\x{{300}}-\\x{{36F}}]|[{_P4_LATIN}][\\p{{L}}\\p{{M}}]*[{_P4_OTHER}]|[{_P4_OTHER}][\\p{{L}}\\p{{M}}]*[{_P4_LATIN}]')"



def _p4_forms() -> str:
    """Each text by SQL functions alone: what is unseen dropped, variants by their compatibility form, look-alikes in words with a Latin letter, composed as a whole."""
    odd = "".join(c for c in map(chr, [*range(0x2100, 0x2150), *range(0x24B6, 0x24EA), *range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D800)]) if (n := unicodedata.normalize("NFKC", c)) != c and n.isascii() and n.isalnum() and len(n) == 1)
    plain = unicodedata.normalize("NFKC", odd)
    spaces = "".join(c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) in ("Zs", "Zl", "Zp"))
    t = r"regexp_replace(t, '[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]', '', 'g')"
    t = f"regexp_replace({t}, '([\\x{{0}}-\\x{{24F}}])[\\x{{200C}}\\x{{200D}}]+', '\\1', 'g')"
    t = f"regexp_replace({t}, '[\\x{{200C}}\\x{{200D}}]+([\\x{{0}}-\\x{{24F}}])', '\\1', 'g')"
    t = f"translate({t}, '{spaces + odd}', '{' ' * len(spaces) + plain}')"
    for joined in "ﬀﬁﬂﬃﬄﬅﬆ":
        t = f"replace({t}, '{joined}', '{unicodedata.normalize('NFKC', joined)}')"
    word = f"CASE WHEN regexp_matches(w, '[{_P4_LATIN}]') THEN translate(w, '{lookalikes.FOREIGN}', '{lookalikes.LATIN}') ELSE w END"
    form = f"nfc_normalize(array_to_string(list_transform(regexp_extract_all({t}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: {word}), ''))"
    return f"SELECT tbl, row_id, form, coalesce(form <> t, false) AS changed FROM (SELECT *, {form} AS form FROM (SELECT 'chunks' AS tbl, chunk_id AS row_id, text AS t FROM chunks UNION ALL SELECT 'papers', paper_id, title FROM papers))"


_P3 = """
WITH RECURSIVE p AS (
  SELECT paper_id AS id, nullif(ltrim(regexp_extract(coalesce(pmid, ''), '[0-9]+'), '0'), '') AS pm, nullif(ltrim(regexp_extract(coalesce(pmcid, ''), '[0-9]+'), '0'), '') AS pc,
    nullif(doc_id, '') AS d, coalesce(length(abstract), 0) AS n, loaded_at, abstract, title, doc_id, in_index, regexp_extract(coalesce(doc_id, ''), '^tar://(.*?)!/', 1) AS tar FROM papers),
keys AS (SELECT id, 'p' || pm AS k FROM p WHERE pm IS NOT NULL UNION SELECT id, 'c' || pc FROM p WHERE pc IS NOT NULL UNION SELECT id, 'd' || d FROM p WHERE d IS NOT NULL),
links AS (SELECT DISTINCT a.id AS u, b.id AS v FROM keys a JOIN keys b USING (k) WHERE a.id <> b.id),
reach AS (SELECT DISTINCT u AS id, u AS r FROM links UNION SELECT r.id, l.v FROM reach r JOIN links l ON l.u = r.r),
g AS (SELECT id, min(r) AS group_id FROM reach GROUP BY id),
ranked AS (
  SELECT g.group_id, p.*, row_number() OVER (PARTITION BY g.group_id ORDER BY CASE WHEN d IS NULL THEN 2147483647 ELSE coalesce(t.trust, 2147483646) END, loaded_at DESC NULLS LAST, p.id) AS o
  FROM p JOIN g USING (id) LEFT JOIN tars t ON t.tar = p.tar)"""
_P3_FOUND = f"""{_P3}
SELECT group_id, coalesce(arg_min(id, o) FILTER (WHERE pm IS NOT NULL), 0) AS pmid_from, coalesce(arg_min(id, o) FILTER (WHERE pc IS NOT NULL), 0) AS pmcid_from,
  coalesce(arg_min(id, [-n, o]) FILTER (WHERE n > 0), 0) AS abstract_from FROM ranked GROUP BY group_id"""
_P3_LATEST = "row_number() OVER (PARTITION BY group_id ORDER BY loaded_at DESC NULLS LAST, id)"
_P3_BEST = f"""{_P3}, timed AS (SELECT *, {_P3_LATEST} AS l FROM ranked)
SELECT group_id, count(*) AS n_rows, arg_min(pm, o) FILTER (WHERE pm IS NOT NULL) AS pmid, arg_min(pc, o) FILTER (WHERE pc IS NOT NULL) AS pmcid, arg_min(abstract, [-n, o]) FILTER (WHERE n > 0) AS abstract,
  arg_min(title, o) FILTER (WHERE trim(title) <> '') AS title, arg_min(doc_id, o) FILTER (WHERE d IS NOT NULL) AS doc_id, arg_min(in_index, l) FILTER (WHERE in_index IS NOT NULL) AS in_index,
  coalesce(arg_min(id, o) FILTER (WHERE pm IS NOT NULL), 0) AS pmid_from, coalesce(arg_min(id, o) FILTER (WHERE pc IS NOT NULL), 0) AS pmcid_from, coalesce(arg_min(id, [-n, o]) FILTER (WHERE n > 0), 0) AS abstract_from,
  coalesce(arg_min(id, o) FILTER (WHERE trim(title) <> ''), 0) AS title_from, coalesce(arg_min(id, o) FILTER (WHERE d IS NOT NULL), 0) AS doc_id_from, coalesce(arg_min(id, l) FILTER (WHERE in_index IS NOT NULL), 0) AS in_index_from
FROM timed GROUP BY group_id"""


_P1 = f"""
WITH w AS (SELECT chunk_id, paper_id, hash(substr(text, p, {SPAN})) AS s FROM (SELECT chunk_id, paper_id, text, unnest(range(1, length(text) - {SPAN} + 2)) AS p FROM chunks WHERE length(text) >= {SPAN} AND paper_id IS NOT NULL)),
m AS (SELECT s FROM w GROUP BY s HAVING min(paper_id) <> max(paper_id))
SELECT DISTINCT chunk_id FROM w WHERE s IN (SELECT s FROM m)"""

_P1_SPANS = f"""
WITH w AS (SELECT chunk_id, paper_id, n, p, hash(substr(text, p, {SPAN})) AS s FROM (SELECT chunk_id, paper_id, text, length(text) AS n, unnest(range(1, length(text) - {SPAN} + 2)) AS p FROM chunks WHERE length(text) >= {SPAN} AND paper_id IS NOT NULL)),
m AS (SELECT s FROM w GROUP BY s HAVING min(paper_id) <> max(paper_id)),
i AS (SELECT chunk_id, n, p, CASE WHEN p - lag(p) OVER (PARTITION BY chunk_id ORDER BY p) <= {SPAN} THEN 0 ELSE 1 END AS fresh FROM w WHERE s IN (SELECT s FROM m)),
g AS (SELECT chunk_id, n, p, sum(fresh) OVER (PARTITION BY chunk_id ORDER BY p) AS k FROM i),
x AS (SELECT chunk_id, n, min(p) - 1 AS a, max(p) - 1 + {SPAN} AS b FROM g GROUP BY chunk_id, n, k)
SELECT chunk_id AS id, CAST(list(a ORDER BY a) AS INTEGER[]) AS begins, CAST(list(b ORDER BY a) AS INTEGER[]) AS ends, CAST(sum(b - a) AS INTEGER) AS shared_chars, round(sum(b - a) / n, 6) AS share FROM x GROUP BY chunk_id, n"""

_P5 = """
WITH d AS (SELECT 'chunks' AS tbl, chunk_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM chunks WHERE ord >= 0
  UNION ALL SELECT 'papers', paper_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\\p{L}\\p{N}]+') FROM papers),
s AS (SELECT DISTINCT tbl, id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 20)),
n AS (SELECT tbl, id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.tbl, a.id AS id_a, b.id AS id_b, count(*) AS m FROM s a JOIN s b ON a.tbl = b.tbl AND a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT c.tbl, id_a, id_b FROM c JOIN n x ON x.tbl = c.tbl AND x.id = id_a JOIN n y ON y.tbl = c.tbl AND y.id = id_b WHERE m >= 0.6 * (x.n + y.n - m)"""

# classes of equal word sequences, the linked ones, and the connected groups of these
_P5_GROUPS = """
WITH RECURSIVE d AS (SELECT 'chunks' AS tbl, chunk_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM chunks WHERE ord >= 0
  UNION ALL SELECT 'papers', paper_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\\p{L}\\p{N}]+') FROM papers),
m AS (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, w) AS rep, count(*) OVER (PARTITION BY tbl, w) AS copies, w FROM d WHERE len(w) >= 20),
s AS (SELECT DISTINCT tbl, id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS p FROM m WHERE id = rep)),
n AS (SELECT tbl, id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.tbl, a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.tbl = b.tbl AND a.g = b.g AND a.id < b.id GROUP BY ALL),
p AS (SELECT c.tbl, a, b FROM c JOIN n x ON x.tbl = c.tbl AND x.id = a JOIN n y ON y.tbl = c.tbl AND y.id = b WHERE k >= 0.6 * (x.n + y.n - k)),
e AS (SELECT tbl, a AS u, b AS v FROM p UNION ALL SELECT tbl, b, a FROM p),
l AS (SELECT tbl, u AS rep, count(*) AS links FROM e GROUP BY ALL),
r AS (SELECT DISTINCT tbl, u AS id, u AS to_ FROM e UNION SELECT r.tbl, r.id, e.v FROM r JOIN e ON e.tbl = r.tbl AND e.u = r.to_),
g AS (SELECT tbl, id AS rep, min(to_) AS group_id FROM r GROUP BY ALL)
SELECT m.tbl, m.id, coalesce(group_id, m.rep) AS group_id, coalesce(links, 0) AS links FROM m LEFT JOIN g USING (tbl, rep) LEFT JOIN l USING (tbl, rep) WHERE copies > 1 OR links IS NOT NULL"""

_P2 = """
WITH v AS (SELECT id, min(CAST(embedding AS DOUBLE[])) AS e FROM vectors WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY id),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
s AS (SELECT a.id, b.id AS other, list_dot_product(a.e, b.e) AS similarity FROM u a JOIN u b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM s WHERE similarity >= 0.92 QUALIFY rank <= 10)
SELECT x.id AS id_a, x.other AS id_b FROM k x JOIN k y ON x.id = y.other AND x.other = y.id WHERE x.id < x.other"""

_P7 = f"""WITH big AS (SELECT 'chunks' AS tbl, CAST(chunk_id AS VARCHAR) AS row_key, ord AS pos, text FROM chunks
  UNION SELECT 'article', doc_id, CAST(pos - 1 AS INTEGER), t FROM (SELECT doc_id, unnest(paragraphs) AS t, generate_subscripts(paragraphs, 1) AS pos FROM article))
SELECT tbl, row_key, pos, text, true AS fits, true AS overlaps FROM big WHERE length(text) > {LIMIT}"""

_P2_NEAR = """
WITH v AS (SELECT id, min(CAST(embedding AS DOUBLE[])) AS e FROM vectors WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY id),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
s AS (SELECT a.id, b.id AS other, round(list_dot_product(a.e, b.e), 9) AS similarity FROM u a JOIN u b ON a.id <> b.id)
SELECT id, other, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""

ORACLE: dict[str, str] = {
    "p5_groups": _P5_GROUPS,
    "p7_rebuilt": _P7,
    "p8_texts": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p9_layout": "SELECT count(*) AS documents, 0 AS cut, 0 AS misplaced, 0 AS over FROM documents",
    "p2_found": _P2,
    "p2_neighbours": _P2_NEAR,
    "p5_found": _P5,
    "p1_found": _P1,
    "p1_spans": _P1_SPANS,
    "p3_found": _P3_FOUND,
    "p3_best": _P3_BEST,
    "p4_forms": _p4_forms(),
    "p4_found": f"SELECT DISTINCT tbl, row_id FROM (SELECT 'chunks' AS tbl, chunk_id AS row_id, text AS t FROM chunks UNION ALL SELECT 'papers', paper_id, title FROM papers) WHERE {_P4}",
    "p7_found": f"""SELECT DISTINCT 'chunks' AS tbl, CAST(chunk_id AS VARCHAR) AS row_key, ord AS pos FROM chunks WHERE length(text) > {LIMIT}
UNION SELECT 'article', doc_id, CAST(pos - 1 AS INTEGER) FROM (SELECT doc_id, unnest(paragraphs) AS t, generate_subscripts(paragraphs, 1) AS pos FROM article) WHERE length(t) > {LIMIT}""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
