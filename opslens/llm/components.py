"""Connected components of an edge table, in rounds of large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.session import materialize


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b) that is not the least of its component; ``root`` is the least.

    Each round hangs the neighbours of a node on the least node it knows; the rounds end when nothing changes, after about
    log(nodes) of them. A round is aggregates with map-side combine and joins against one row a node; it is stored in
    the shared folder.
    """
    up, down = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    pairs = materialize(edges.select(up, down).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = pairs.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = materialize(hung.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
