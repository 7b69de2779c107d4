"""Distributed connected components over a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import settle

#: Links a task holds at once while it contracts its part.
CHUNK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, smallest node of its tree) equivalent to the given links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter(map(find, parent), np.int64, len(parent))
    mask = nodes != roots
    return nodes[mask], roots[mask]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, n = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= CHUNK:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
            a, b, n = [], [], 0
    if n:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step of the alternating algorithm; links have a > b."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a")
    if large:
        # every neighbour above the node is linked to the least of its neighbourhood
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b) of longs.

    Nodes without a link are not returned. Each task first contracts its own links;
    then large-star and small-star steps alternate until nothing changes. Links of a
    hot node are split by the adaptive skew join; lineage is cut after each round.
    """
    part = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    state = settle(part.mapInArrow(_contract, "a long, b long").distinct())
    seen = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
        state = settle(_star(_star(state, large=True), large=False))
