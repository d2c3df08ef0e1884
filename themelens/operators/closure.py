"""H6: link closure (breadth-first reachability) as a frontier loop of joins.

Each round joins the frontier with the edge table, removes what was already
reached (anti join) and appends the rest; the loop ends when a round adds
nothing.  Rounds are bounded by the graph depth, every round is a distributed
join, and what it adds is appended as a table of its own in the shared folder, so nothing
that was reached is written again and a lost executor only costs the last round.
Cycles end naturally because reached nodes never re-enter the frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def link_closure(starts: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All nodes reachable from each start (start included).

    ``starts``: (start, node); ``edges``: (src, dst).  Returns (start, node, depth).
    ``max_rounds`` is only a safety stop for runaway graphs; None = until done.
    """
    e = written(edges.select(F.col("src"), F.col("dst")).filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct())
    rounds = [written(starts.select("start", "node").distinct().withColumn("depth", F.lit(0)))]
    while max_rounds is None or len(rounds) <= max_rounds:
        frontier, seen = rounds[-1], reduce(DataFrame.union, rounds).select("start", "node")
        step = written(frontier.join(e, frontier.node == e.src)
                       .select("start", F.col("dst").alias("node")).distinct()
                       .join(seen, ["start", "node"], "left_anti")
                       .withColumn("depth", F.lit(len(rounds))))
        if step.isEmpty():
            break
        rounds.append(step)
    return reduce(DataFrame.union, rounds)


def pagination_closure(pages_links: DataFrame, start_urls: DataFrame, token: str = "page=") -> DataFrame:
    """Pages reachable from ``start_urls`` (column ``url``) through links containing
    ``token``; expansion only from URLs present in ``pages_links`` (others are
    reported but have no stored body).  Returns (start, url) sorted by text."""
    edges = (pages_links.filter(F.col("link").contains(token))
             .select(F.col("url").alias("src"), F.col("link").alias("dst")))
    starts = start_urls.select(F.col("url").alias("start"), F.col("url").alias("node"))
    out = link_closure(starts, edges)
    return out.select("start", F.col("node").alias("url")).orderBy("start", "url")
