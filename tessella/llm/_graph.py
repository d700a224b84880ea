"""Connected components by alternating large-star and small-star rounds.

Each round keeps at most as many links as it got, so a component of any size is
never gathered in one task.  Least neighbours are summed up before any shuffle and
stored; where few, they are broadcast and links stay where they are, else links
meet them in a join whose hot keys adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Table


def _smallest(df: DataFrame) -> Table:
    """(k, m): for each node u of rows (u, v), the least of u and all its v."""
    return Table(df.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "near")


def _round(links: DataFrame) -> tuple[DataFrame, list[Table]]:
    """Links after a large star and a small star, and the tables they hang on."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _smallest(both)
    large = both.where("v > u").join(near.hinted(), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = _smallest(large)
    moved = large.join(least.hinted(), F.col("u") == F.col("k"))
    hung = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.df.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u > v").distinct(), [near, least]


def _settled(links: Table) -> bool:
    """Whether all links are stars: every node has one link down, and none to a node with a link down."""
    if links.rows == 0:
        return True
    ends = links.df.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(links.df.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> Table:
    """Table (node, component) of all nodes with a link; component is the smallest id reachable.

    Links may repeat, point either way or join a node to itself; null ends are ignored.
    """
    start = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y"))
    table = Table(start.where("not x and not y and u > v").select("u", "v").distinct(), "links")
    for _ in range(max_rounds):
        if _settled(table):
            break
        stars, used = _round(table.df)
        stars = Table(stars, "links")
        for t in (table, *used):
            t.drop()
        table = stars
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = table.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = Table(nodes.unionAll(nodes.select(F.col("component").alias("node"), "component")).distinct(), "components")
    table.drop()
    return out
