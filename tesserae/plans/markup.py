"""Markup and archive queries: articles are written as journal markup, read back and compared with what went in."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import compatibility_form
from tesserae.session import materialize, table
from tesserae.sources.archives import archive_faults, created, member_counts, read_articles
from tesserae.sources.xml import LEAST_PARAGRAPH, parse_members
from tesserae.streaming.ingest import shared_folder

# Space as markup readers see it, and characters that markup cannot hold.
_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BARRED = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]"


def _held(c: Column | str) -> Column:
    """Text as markup can hold it: without barred characters, escaped."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), _BARRED, "")
    return F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def markup(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, tar, member, content): every article as journal markup, and the archive and member that it is to be in."""
    a = table(spark, base, "article").select("doc_id", "pmid", "pmcid", "title", "abstract", "paragraphs").distinct()
    body = F.array_join(F.transform(F.array_compact(F.coalesce("paragraphs", F.array().cast("array<string>"))), lambda p: F.concat(F.lit("<p>"), _held(p), F.lit("</p>"))), "\n")
    parts = [
        F.lit("<article><front><article-meta><article-id pub-id-type='pmid'>"), _held("pmid"), F.lit("</article-id><article-id pub-id-type='PMCID'>"), _held("pmcid"),
        F.lit("</article-id><title-group><article-title>"), _held("title"), F.lit("</article-title></title-group><abstract><p>"), _held("abstract"),
        F.lit("</p></abstract></article-meta></front><body><sec>"), body, F.lit("</sec></body></article>"),
    ]
    kind = F.length(F.coalesce("doc_id", F.lit(""))) % 4
    return a.select("doc_id", F.concat(F.lit("t"), kind.cast("string"), F.when(kind % 2 == 0, ".tar").otherwise(".tar.gz")).alias("tar"), F.concat(F.md5(F.coalesce("doc_id", F.lit(""))), F.lit(".nxml")).alias("member"), F.concat(*parts).cast("binary").alias("content"))


def _parsed_fields(parsed: DataFrame, *keys: str) -> DataFrame:
    a = parsed.where("article IS NOT NULL").select(*keys, "article.*")
    n = F.size("paragraphs")
    return a.select(*keys, "pmid", "pmcid", F.trim(F.regexp_replace("title", rf"{_SPACE}+", " ")).alias("title"), "abstract", n.alias("paragraphs"), F.aggregate("paragraphs", F.lit(0), lambda s, p: s + F.length(p)).alias("chars"))


def xml_parse(spark: SparkSession, base: str) -> DataFrame:
    """Fields of every article after a way through markup and the parser."""
    return _parsed_fields(parse_members(markup(spark, base)), "doc_id")


def page_text(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, text): the visible text of every article's paragraphs."""
    p = parse_members(markup(spark, base)).where("article IS NOT NULL")
    return p.select("doc_id", F.array_join("article.paragraphs", "\n").alias("text"))


def _write(folder: str):
    """(path) of an archive for each group of rows (tar, member, content) that come sorted by tar; written anew if a task comes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, t, out, done = None, None, None, []

        def end() -> None:
            if t is not None:
                t.close()
                out.close()

        for rb in batches:
            for tar, member, data in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if tar != name:
                    end()
                    path = f"{folder}/{tar}"
                    out = created(path)
                    name, t = tar, tarfile.open(fileobj=out, mode="w|gz" if tar.endswith(".gz") else "w|")
                    done.append(path)
                info = tarfile.TarInfo(member)
                info.size, info.mtime = len(data), 1_700_000_000
                t.addfile(info, io.BytesIO(data))
        end()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    return run


def _archives(spark: SparkSession, base: str) -> list[str]:
    """The articles in four archives, each a stream written where its rows are; their paths."""
    folder = shared_folder(spark, "archives")
    rows = markup(spark, base).select("tar", "member", "content").repartition("tar").sortWithinPartitions("tar", "member")
    return [r.path for r in materialize(rows.mapInArrow(_write(folder), "path string")).collect()]


def archive_articles(spark: SparkSession, base: str) -> DataFrame:
    """Fields of every article after a way through archives."""
    return _parsed_fields(read_articles(spark, _archives(spark, base)), "tar", "member")


def archive_counts(spark: SparkSession, base: str) -> DataFrame:
    """(tar, n, faults): markup files of each archive, and whether it is damaged."""
    paths = _archives(spark, base)
    return member_counts(spark, paths).join(archive_faults(spark, paths).select("tar", F.lit(1).alias("f")), "tar", "left").select("tar", "n", F.coalesce("f", F.lit(0)).alias("faults"))


def compatibility_titles(spark: SparkSession, base: str) -> DataFrame:
    """(paper_id, form): titles in compatibility form."""
    return table(spark, base, "papers").select("paper_id", compatibility_form("title").alias("form"))


def _one_space(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '{_BARRED}', '', 'g'), '{_SPACE}+', ' ', 'g'))"


_ENDS = f"^{_SPACE}+|{_SPACE}+$"
_ARTICLES = f"""a AS (SELECT DISTINCT doc_id, pmid, pmcid, title, abstract, paragraphs FROM article),
f AS (SELECT doc_id, regexp_replace(coalesce(pmid, ''), '{_ENDS}', '', 'g') AS pmid, regexp_replace(coalesce(pmcid, ''), '{_ENDS}', '', 'g') AS pmcid, {_one_space("coalesce(title, '')")} AS title, {_one_space("coalesce(abstract, '')")} AS abstract,
  list_filter(list_transform(list_filter(coalesce(paragraphs, []), lambda p: p IS NOT NULL), lambda p: {_one_space('p')}), lambda p: length(p) >= {LEAST_PARAGRAPH}) AS ps FROM a),
g AS (SELECT * FROM f WHERE title <> '' OR abstract <> '' OR len(ps) > 0)"""
_COUNTED = "CAST(len(ps) AS INTEGER) AS paragraphs, CAST(coalesce(list_sum(list_transform(ps, lambda p: length(p))), 0) AS INTEGER) AS chars"
_TAR = "'t' || (length(coalesce(doc_id, '')) % 4) || CASE WHEN length(coalesce(doc_id, '')) % 2 = 0 THEN '.tar' ELSE '.tar.gz' END"
_FIELDS = f"pmid, pmcid, title, abstract, {_COUNTED}"

QUERIES = {f.__name__: f for f in (xml_parse, page_text, archive_articles, archive_counts, compatibility_titles)}
ORACLE = {
    "xml_parse": f"WITH {_ARTICLES} SELECT doc_id, {_FIELDS} FROM g",
    "page_text": f"WITH {_ARTICLES} SELECT doc_id, array_to_string(ps, chr(10)) AS text FROM g",
    "archive_articles": f"WITH {_ARTICLES} SELECT {_TAR} AS tar, md5(coalesce(doc_id, '')) || '.nxml' AS member, {_FIELDS} FROM g",
    "archive_counts": f"WITH {_ARTICLES} SELECT {_TAR} AS tar, count(*) AS n, 0 AS faults FROM a GROUP BY 1",
}
