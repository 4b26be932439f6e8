"""Connected components of a graph given by its links, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lectern.llm.common import cut

#: Links to a task: rounds over few links take few tasks and leave few files, however many partitions a shuffle has.
LINKS_A_TASK = 1 << 13


def _stars(links: DataFrame, small: bool, tasks: int) -> DataFrame:
    """One round of star contraction over links (a, b) with a > b, each once, in so many tasks at most.

    Large star: each node links its larger neighbours to the smallest of its neighbours and
    itself. Small star: each node links itself and its smaller neighbours to the smallest.
    """
    if small:
        hubs, rays = links, links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        least = hubs.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("least"))
        moved = rays.join(least, rays["node"] == least["hub"]).select(F.col("other").alias("a"), F.col("least").alias("b"))
        out = moved.unionByName(least.select(F.col("hub").alias("a"), F.col("least").alias("b")))
    else:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy(F.col("node").alias("hub")).agg(F.least(F.min("other"), F.col("hub")).alias("least"))
        # only the larger neighbours of a hub move
        rays = links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        out = rays.join(least, rays["node"] == least["hub"]).select(F.col("other").alias("a"), F.col("least").alias("b"))
    return out.filter("a > b").coalesce(tasks).distinct().coalesce(tasks)


def _state(links: DataFrame) -> Row:
    return links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has a link to another.

    links: pairs in any order, repeats and loops allowed. Rounds go on until every node links to
    its component's smallest and to nothing else; each round is kept in the shared folder. No
    links give no rows.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    links = cut(links)
    state = _state(links)
    tasks = state["n"] // LINKS_A_TASK + 1
    links = links.coalesce(tasks)
    while state["n"]:
        links = cut(_stars(_stars(links, False, tasks), True, tasks))
        before, state = state, _state(links)
        if state == before:
            break
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().coalesce(tasks))
