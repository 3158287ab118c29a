"""Connected components of a link table, as Spark joins and aggregates.

Alternating large-star and small-star steps: every node points its larger
neighbours, then its smaller ones, at the smallest node it knows.  A step is
two aggregates with map-side combine and two joins, so no task gathers a
node's neighbours (a hub's rows may be split by AQE).  Each round is written
to the shared folder, which ends the lineage; rounds grow with the logarithm
of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodging.llm.common import discard, stage


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` -> one row per linked node: ``node, root`` (its component's smallest node).

    Links have no direction; repeated links, self links and links with a NULL
    end are harmless (the last two link nothing).  No links: no rows.
    """
    spark = links.sparkSession
    ends = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u") != F.col("v")).alias("ok"))
    now, path = stage(ends.where("ok").select("u", "v").distinct(), "links")
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = rest.unionByName(least.withColumnRenamed("m", "v")).distinct()
        now, new = stage(small, "links")
        discard(spark, path)
        path, after = new, _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
