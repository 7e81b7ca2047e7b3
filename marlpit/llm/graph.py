"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, rows_per_task: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; component is the smallest reachable node.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest
    node it knows (Kiveris et al. 2014), which ends after about log(n) rounds at stars. A
    round keeps at most as many edges as there were. Nothing is collected but a checksum,
    and no task needs all edges of a node at once: minima are summed up ahead of the
    shuffle, and as they lie in a table of their own, the join with a much-linked node is
    one that adaptive execution splits. Null ends and loops are ignored; no edges, no rows.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    links = cut(links)
    seen, n = None, links.count()
    tasks = max(1, -(-2 * n // rows_per_task)) if rows_per_task else None
    thin = lambda df: df.coalesce(tasks) if tasks else df
    links = thin(links)
    ends = links.groupBy(F.col("u").alias("w")).agg(F.count("*").alias("n"))
    # stars need no round: every larger end has one edge and is no smaller end
    if n and not ends.where("n > 1").limit(1).count() and not links.join(ends, F.col("v") == F.col("w"), "left_semi").limit(1).count():
        seen, n = "stars", 0
    for _ in range(max_rounds if n else 0):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(thin(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))))
        large = thin(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))).distinct()
        large = cut(thin(large))
        low = cut(thin(large.groupBy("u").agg(F.min("v").alias("low"))))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
        links = cut(thin(thin(small).distinct()))
        check = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check == seen:
            break
        seen = check
    else:
        if n:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return thin(stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
