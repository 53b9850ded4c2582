"""Connected components of a link table, by alternating large and small stars.

Links stay rows of a distributed table throughout; no list of a node's neighbours
is ever built.  The written table of minima lets joins on a hub be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatt.session import durable

#: Links that a task contracts at a time; bounds its memory.
CHUNK = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the given links connect."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, label[a], label[b])
        np.minimum.at(low, label[b], label[a])
        low = np.minimum(low, low[label])
        while (low != low[low]).any():
            low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        u, v = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(h[0]) for h in held) >= CHUNK:
            yield flush()
    if held:
        yield flush()


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links (u > v) with the same components, found inside each partition."""
    return links.select("u", "v").mapInArrow(_contract, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u long, v long; no nulls); root is the smallest node reachable.

    Links in either direction, repeats and links of a node with itself are all
    right; nodes without other links may be left out; no links give no rows.
    """
    links = durable(contracted(links.where("u <> v")).distinct())
    before = None
    while True:
        # Large stars: larger neighbours move to the smallest node around.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = durable(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(contracted(large.where("u <> v")).distinct())
        # Small stars: a node and its smaller neighbours move to the smallest of them.
        low = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = durable(low.select("u", F.col("m").alias("v")).union(small).distinct())
        # Stars are steady when every node has one link and no root has a link downwards.
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not state[0] or tuple(state) == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
