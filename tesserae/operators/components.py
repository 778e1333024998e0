"""Connected components over shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import materialize


def components(members: DataFrame) -> DataFrame:
    """(id, group_id): connected components of ids that share a key, for those with at least one other id.

    members has id (anything that can be ordered) and key; rows with a null id or key take no part. group_id is the
    smallest id. A key's edges run to its smallest id only, found with one combining aggregation, so no key is ever
    expanded into pairs. Labels then spread over the edges and jump along themselves, so the rounds grow with the
    logarithm of a chain's length; labels only ever fall, so they end. Each round is cut off by a checkpoint.
    """
    m = members.select("id", "key").where("id IS NOT NULL AND key IS NOT NULL").distinct()
    heads = m.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    edges = materialize(m.join(heads, "key").where("id <> head").select("id", "head").distinct())
    both = edges.select(F.col("id").alias("u"), F.col("head").alias("v")).unionByName(edges.select(F.col("head").alias("u"), F.col("id").alias("v")))
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(seen.withColumnRenamed("u", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # one jump: the label's own label
        own = step.select(F.col("id").alias("label"), F.col("label").alias("own"))
        nxt = materialize(step.join(own, "label", "left").select("id", "old", F.least("label", F.coalesce("own", "label")).alias("label")))
        labels = nxt.select("id", "label")
        if not nxt.where("label <> old").limit(1).count():
            return labels.select("id", F.col("label").alias("group_id"))
