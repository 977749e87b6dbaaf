"""Connected components of a link table, by neighbour minima and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.staging import staged


def connected(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each linked node.

    links: columns ``src`` and ``dst`` (long); other columns are ignored. Null ends, self links and repeats count
    for nothing; nodes without a link are not returned, so an empty table gives an empty result.
    Returns ``node``, ``root``. Each round is two joins and an aggregation that combines before its shuffle; the
    joins read staged tables, so Spark may split a hot node's rows. Rounds grow with the logarithm of the longest
    chain of links.
    """
    ends = links.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")).where("a <> b")
    both = staged(ends.union(ends.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        now = staged(hooked.join(jump, "root").select("node", F.least("root", "far").alias("root"), "was"), "labels")
        labels = now.select("node", "root")
        if not now.where("root <> was").limit(1).count():
            return labels
