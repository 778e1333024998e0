"""Paragraphs packed into passages, as expressions that never leave the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import body_source, paper_text

TARGET, SHORT, OVERLAP = 1200, 300, 200
_STATE = "struct<done:array<string>,open:string>"


def pack(paragraphs: Column, target: int = TARGET, short: int = SHORT, overlap: int = OVERLAP) -> Column:
    """Passages of an array of paragraphs (array<string>).

    Paragraphs gather until the next would take the passage over target, counting a space for each. A passage under
    short that is closed joins the one before it. Each passage but the first then begins with the last overlap
    characters of the one before, as that was before its own overlap. A paragraph is never cut.
    """

    def close(s: Column) -> Column:
        joined = F.concat(F.slice(s["done"], 1, F.size(s["done"]) - 1), F.array(F.concat(F.element_at(s["done"], -1), F.lit(" "), s["open"])))
        return F.when(s["open"].isNull(), s["done"]).when((F.length(s["open"]) < short) & (F.size(s["done"]) > 0), joined).otherwise(F.concat(s["done"], F.array(s["open"])))

    def state(done: Column, open_: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open")).cast(_STATE)

    def step(s: Column, p: Column) -> Column:
        # the open passage's length and one is what it counts with a space after every paragraph
        over = F.length(s["open"]) + 1 + F.length(p) + 1 > target
        return F.when(s["open"].isNull(), state(s["done"], p)).when(over, state(close(s), p)).otherwise(state(s["done"], F.concat(s["open"], F.lit(" "), p)))

    packed = F.aggregate(paragraphs, state(F.array().cast("array<string>"), F.lit(None)), step, close)
    if overlap <= 0:
        return packed
    # the fold's value is named once: each of the copies below would otherwise run it again
    return F.aggregate(
        F.array(packed),
        F.array().cast("array<string>"),
        lambda _, ch: F.transform(ch, lambda x, i: F.when(i == 0, x).otherwise(F.trim(F.concat(F.right(F.get(ch, i - 1), F.lit(overlap)), F.lit(" "), x)))),
    )


def passages(articles: DataFrame, key: str = "doc_id", target: int = TARGET, short: int = SHORT, overlap: int = OVERLAP) -> DataFrame:
    """(key, ord, text): the title-and-abstract passage as -1, body passages from 0.

    articles: key, title, abstract, paragraphs. Null paragraphs are dropped; an article without any paragraph packs its
    abstract. A row at a time, no shuffle.
    """
    body = pack(body_source(F.col("abstract"), F.col("paragraphs")), target, short, overlap)
    head = paper_text(F.col("title"), F.col("abstract"), F.array_compact(F.col("paragraphs")))
    both = articles.select(key, F.posexplode(F.concat(F.array(head), body)).alias("n", "text"))
    return both.select(key, (F.col("n") - 1).alias("ord"), "text")
