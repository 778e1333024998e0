"""Problem 6: references of chunks, files and papers to records that were not there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.references import Reference, orphan_rows, orphans_by_period, reference
from tesserae.session import table


def store_references(spark: SparkSession, base: str) -> list[Reference]:
    """The three references of the store."""
    c, f, p = (table(spark, base, t) for t in ("chunks", "files", "papers"))
    col = F.col
    return [
        reference("chunks", "papers", c, col("chunk_id"), col("paper_id"), col("loaded_at"), p, col("paper_id"), col("loaded_at")),
        reference("files", "papers", f, col("path"), col("paper_id"), col("loaded_at"), p, col("paper_id"), col("loaded_at")),
        reference("papers", "files", p, col("paper_id"), col("doc_id"), col("loaded_at"), f, col("path"), col("loaded_at")),
    ]


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """(tbl, row_key), each once."""
    return orphan_rows(store_references(spark, base)).select("tbl", "row_key").distinct()


def p6_by_month(spark: SparkSession, base: str) -> DataFrame:
    """(tbl, period, orphans, never)."""
    return orphans_by_period(store_references(spark, base))


_ORPHANS = """
WITH refs AS (
  SELECT 'chunks' AS tbl, CAST(chunk_id AS VARCHAR) AS row_key, CAST(paper_id AS VARCHAR) AS ref, loaded_at AS t, 'papers' AS parent FROM chunks
  UNION ALL SELECT 'files', path, CAST(paper_id AS VARCHAR), loaded_at, 'papers' FROM files
  UNION ALL SELECT 'papers', CAST(paper_id AS VARCHAR), doc_id, loaded_at, 'files' FROM papers),
parents AS (
  SELECT 'papers' AS parent, CAST(paper_id AS VARCHAR) AS k, loaded_at AS t FROM papers
  UNION ALL SELECT 'files', path, loaded_at FROM files),
orphans AS (
  SELECT r.tbl, r.row_key, r.t,
         NOT EXISTS (SELECT 1 FROM parents q WHERE q.parent = r.parent AND q.k = r.ref) AS is_never
  FROM refs r
  WHERE r.ref IS NOT NULL AND r.ref <> ''
    AND NOT EXISTS (SELECT 1 FROM parents q WHERE q.parent = r.parent AND q.k = r.ref AND q.t <= r.t))
"""

QUERIES = {"p6_found": p6_found, "p6_by_month": p6_by_month}
ORACLE = {
    "p6_found": _ORPHANS + "SELECT DISTINCT tbl, row_key FROM orphans",
    "p6_by_month": _ORPHANS + "SELECT tbl, strftime(date_trunc('month', t), '%Y-%m-%d') AS period, count(*) AS orphans, CAST(sum(CASE WHEN is_never THEN 1 ELSE 0 END) AS BIGINT) AS never FROM orphans GROUP BY ALL",
}
