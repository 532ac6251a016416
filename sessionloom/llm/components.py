"""Connected components of a link table, distributed: alternating large-star and small-star steps until nothing changes.

Each step is two shuffles over the links and is staged to the shared folder; the driver sees two numbers a step. Links
are first thinned inside each task by union-find, which keeps components and leaves at most one link a node and task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import arrowio


class UnionFind(dict):
    """Smallest member of each node's set."""

    def find(self, x):
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x] = root
            x = up
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


#: Links that one task holds at once while thinning.
HELD = 500_000


def thin(links: DataFrame) -> DataFrame:
    """(a, b) links with the same components, fewer of them."""

    @arrowio.lean
    def run(batches):
        sets, n = UnionFind(), 0

        def out():
            pairs = [(sets.find(x), x) for x in list(sets)]
            pairs = [(a, b) for a, b in pairs if a != b]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sets.union(a, b)
            n += batch.num_rows
            if n >= HELD:
                yield out()
                sets, n = UnionFind(), 0
        yield out()

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of a link, component being its smallest reachable node.

    links: columns a and b, any order and repetitions; rows with a null are left out. No links give no rows.
    """
    now = arrowio.stage(thin(links.where("a is not null and b is not null and a <> b")).distinct())
    known = None
    while True:
        # large star: each node's larger neighbours are tied to its smallest one. Minima come from a partial aggregation
        # and a join, not a window: a node with very many links is dealt to many tasks
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # small star: each node's smaller neighbours, and itself, are tied to the smallest of them
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        ties = F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))
        following = large.join(smallest, "b").select(F.explode(ties).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        following = arrowio.stage(following)
        arrowio.drop_stage(now)
        now = following
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if known == (state["n"], state["h"]):
            break
        known = (state["n"], state["h"])
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
