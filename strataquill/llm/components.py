"""Connected components by alternating large and small stars.

Edges are first contracted inside each partition (union-find in a task, whose memory is that of one partition), then in
fewer tasks of ``HELD`` edges each, as long as that halves their number. What fits one such task is done then. What
doesn't is joined to minima until nothing changes. Minima are partially aggregated group-bys. Vertices with more than one in
``HOT_PARTS`` of all edges, which can be no more than ``HOT_PARTS``, get their minimum from a list of that size, so no
vertex brings many rows to one task. Each round ends in a checkpoint, so lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.session import cut


class Forest:
    """Union-find over any hashable, ordered ids; a root is the smallest of its set."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        if x not in up:
            up[x] = x
            return x
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, x, y) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = Forest()
    for b in batches:
        for x, y in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
            forest.join(x, y)
    rows = [(x, forest.root(x)) for x in list(forest.up)]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"]).astype("int64")


HOT_PARTS = 1024
HELD = 1 << 17  # edges that a task contracts, two numbers each


def _with_least(edges: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` (a, b) with the least b of each a as ``m``; the edges of hot vertices don't meet."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    many = F.col("n") > max(16, n_edges // HOT_PARTS)
    hot = least.where(many).select("a", "m").collect()  # at most HOT_PARTS rows
    if not hot:
        return edges.join(least.select("a", "m"), "a")
    few = edges.sparkSession.createDataFrame([tuple(r) for r in hot], "a long, hot long")
    marked = edges.join(F.broadcast(few), "a", "left")
    usual = marked.where("hot is null").drop("hot").join(least.where(~many).select("a", "m"), "a")
    return usual.unionByName(marked.where("hot is not null").withColumnRenamed("hot", "m"))


def _drawn_together(edges: DataFrame, held: int) -> tuple[DataFrame, int]:
    """Fewer edges with the same components, and their number; 0 if those are the edges to the smallest of each component."""
    # Written first: edges that Python makes and the contraction would else hold two workers per task at once.
    now, before = cut(edges), None
    n = now.count()
    while n:
        tasks = -(-n // held)
        if before and tasks > 1 and 2 * n > before:
            return now, n
        # Many edges are contracted where they are first.
        dealt = now.repartition(tasks) if before or tasks == 1 else now
        now = cut(dealt.mapInPandas(_contracted, "a long, b long"))
        if tasks == 1:
            break
        before, n = n, now.count()
    return now, 0


def components(edges: DataFrame, rounds: int = 60, held: int = HELD) -> DataFrame:
    """(id, component) of the vertices of ``edges`` (a, b: long) that aren't the smallest of their component."""
    edges = edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long"))
    now, n_edges = _drawn_together(edges, held)
    if not n_edges:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    seen = None
    for _ in range(rounds):
        # Edges point from the larger to the smaller. Large star: larger neighbours go to the minimum around a vertex, or to the vertex.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = _with_least(both, 2 * n_edges).where(F.col("b") > F.col("a"))
        large = around.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # Small star: smaller neighbours, and the vertex, go to the minimum below it.
        below = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = below.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(below.select("a", F.col("m").alias("b"))).distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen, n_edges = state, state[0]
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
