"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import Workspace


def connected_components(spark: SparkSession, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(id, component_id)`` for every id in a link; component_id is the smallest id reachable.

    Each step needs one minimum per node (pre-aggregated before the shuffle) and one join
    (which AQE splits where a node has very many links), so no neighbourhood is ever
    gathered in one task. Steps end when the links no longer change and not before; the links of a step
    are a written table, so lineage stays short. No links: no rows. Null ids and
    links of an id with itself are ignored.
    """
    ws = Workspace(spark, "components")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges, before = ws.keep(edges, "edges0"), None
    for i in count(1):
        seen = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        # large-star: every larger neighbour of u is linked with the least neighbour of u, or u
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: every smaller neighbour of u, and u, are linked with the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = ws.keep(small, f"edges{i}")
        ws.drop(f"edges{i - 1}")
        edges = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots).groupBy("id").agg(F.min("component_id").alias("component_id"))
