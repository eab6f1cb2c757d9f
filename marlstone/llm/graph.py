"""Connected components of a table of links, as DataFrame joins in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, root: every node that has a link, with the least node it is connected to.

    ``links`` has columns a and b (long). Alternates large-star and small-star rounds, which keep at
    most one link for each node that isn't its own root, so the table never grows. Least neighbours are pre-aggregated and
    stored before they are joined, so that a hub's links, which share one key, can be split among tasks. Each round is
    stored in the shared folder; the driver sees only a count and a sum of hashes. No links give no rows.
    """
    ordered = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(links.where("a <> b").select(ordered.alias("e")).select("e.*").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "stars")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        to_least = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = stored(large.join(least, "a").select(F.explode(to_least).alias("e")).select("e.*").where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
