"""Connected components of a graph given as edges, without ever gathering them on the driver.

Alternates the two star contractions of Kiveris et al. (2014): every node's larger neighbours, then its smaller ones, are
linked to the least node of its neighbourhood, until nothing changes. Each round's edges are written to the shared folder,
so lineage stays short and a lost executor costs one round at most. The number of rounds grows with the logarithm
of the graph's size; only a checksum of the edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import dropped, written


def _least(pairs: DataFrame) -> DataFrame:
    """(at, m): the least neighbour of each node, as a table of its own: a join with it deals both sides anew, so that the edges of a
    node with very many neighbours can be split among tasks."""
    return written(pairs.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m")), "least")


def large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v) with u > v -> each neighbour larger than v is linked to the least of v and its neighbours."""
    return edges.join(least, edges.v == least["at"]).select("u", F.least("v", "m").alias("v")).where("u > v").distinct()


def small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v) with u > v -> u and its smaller neighbours are linked to the least of them."""
    joined = edges.join(least, edges.u == least["at"])
    return joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge: root is the least node of its component. Nulls and loops are left out."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    mark = None
    while True:
        least = _least(now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        half = written(large_star(now, least), "edges")
        own = _least(half)
        after = written(small_star(half, own), "edges")
        for done in (now, least, half, own):
            dropped(done)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            out.written_path = now.written_path  # for dropped(), once the result was read
            return out
        mark = seen
