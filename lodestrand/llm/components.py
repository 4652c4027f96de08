"""Connected components of a table of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import materialize, release


def connected_components(links: DataFrame) -> tuple[DataFrame, str]:
    """(id, comp) for every vertex of ``links(u, v)``; comp is the smallest id reachable.

    Min-label propagation with pointer jumping: a round takes each vertex's smallest label among
    its neighbours, then the label of that label, so a path of length n needs about log n rounds.
    All aggregates combine before the shuffle, so a centre with very many links is no hot group.
    Every round is written to the shared folder, and the round before is deleted. Empty links give
    an empty table; self links and repeated links change nothing. Gives the table and its path.
    """
    spark = links.sparkSession
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both, both_at = materialize(both, "edges")
    labels, at = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least(F.first("u"), F.min("v")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("comp").alias("far"))
        step = step.join(jump, "mid", "left").select("id", "old", F.least("mid", "far").alias("comp"))
        new, new_at = materialize(step, "labels")
        moved = new.filter("old <> comp").limit(1).count()
        release(spark, at)
        labels, at = new.select("id", "comp"), new_at
        if not moved:
            release(spark, both_at)
            return labels, at
