"""Shards of near-equal bytes by histogram sort.

Documents are ordered by (hash of the text, doc_id), so equal texts are
neighbours.  Candidate key boundaries ("probes") are counted exactly: every
task sums the bytes and rows between neighbouring probes, the sums are added up
by Spark and only one row per probe reaches the driver.  Brackets around each
wanted boundary shrink until the bytes below a probe are near enough to the
wanted share.  Then the documents are exchanged once, straight to their cells.

Probes are first put between text hashes, so a group of equal texts stays in one
shard wherever the tolerance allows; a group too large for that is cut by doc_id.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from tidewatt.session import durable

_LOW = -(1 << 63)
#: Probes that one counting job carries at most; bounds what a task and the driver hold.
PROBES = 1 << 14


def _joined(a: int, b: int) -> int:
    """A pair of signed 64-bit keys as one ordered number."""
    return ((a - _LOW) << 64) | (b - _LOW)


def _pair(c: int) -> tuple[int, int]:
    return (c >> 64) + _LOW, (c & ((1 << 64) - 1)) + _LOW


def position(first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the sorted boundaries (first, second) are at or below each key (a, b)."""
    at, end = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
    met = end > at
    for v in np.unique(a[met]):
        rows = np.flatnonzero(met & (a == v))
        lo, hi = at[rows[0]], end[rows[0]]
        at[rows] = lo + np.searchsorted(second[lo:hi], b[rows], "right")
    return at


def _pairs(bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [_pair(c) for c in bounds]
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


@dataclass(frozen=True)
class Cuts:
    """Boundaries between parts; ``rows_below`` and ``bytes_below`` are exact, with the total at the end."""

    bounds: list[int]
    bytes_below: list[int]
    rows_below: list[int]


def _below(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact bytes and rows below every probe."""
    first, second = _pairs(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(len(first) + 1, np.int64)
        rows = np.zeros(len(first) + 1, np.int64)
        for batch in batches:
            a, b, size = (batch.column(i).to_numpy() for i in range(3))
            at = position(first, second, a, b)
            np.add.at(sizes, at, size)
            rows += np.bincount(at, minlength=len(rows))
        kept = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept, pa.int64()), pa.array(sizes[kept]), pa.array(rows[kept])], ["part", "bytes", "rows"]
        )

    parts = keys.mapInArrow(count, "part long, bytes long, rows long").groupBy("part").agg(F.sum("bytes"), F.sum("rows"))
    found = {r[0]: (r[1], r[2]) for r in parts.collect()}
    out, size, rows = [], 0, 0
    for i in range(len(probes)):
        more = found.get(i, (0, 0))
        size, rows = size + more[0], rows + more[1]
        out.append((size, rows))
    return out


def histogram_cuts(keys: DataFrame, parts: int, slack: list[float]) -> Cuts:
    """Cut ``keys`` (a long, b long, size long; no nulls) into ``parts`` of equal bytes.

    ``slack[i]`` is how far, in bytes, the cut after part i may be off.  A cut
    that no key boundary meets so well lies at the nearest boundary there is.
    """
    low = keys.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b"), F.sum("size"), F.count("*")).first()
    if not low[5]:
        return Cuts([_joined(_LOW, _LOW)] * (parts - 1), [0] * parts, [0] * parts)
    a0, a1, b0, b1, total, rows = low
    known = {_joined(a0, b0): (0, 0), _joined(a1, b1) + 1: (total, rows)}
    wanted = [total * i / parts for i in range(1, parts)]
    while True:
        marks = sorted(known)
        sizes = [known[m][0] for m in marks]
        open_brackets: dict[tuple[int, int], int] = {}
        chosen = []
        for goal, most in zip(wanted, slack, strict=True):
            hi = max(1, bisect_left(sizes, goal))
            near = min(marks[hi - 1], marks[hi], key=lambda m: abs(known[m][0] - goal))
            chosen.append(near)
            lone = known[marks[hi]][1] - known[marks[hi - 1]][1] <= 1
            if abs(known[near][0] - goal) > most and not lone and marks[hi] - marks[hi - 1] > 1:
                bracket = (marks[hi - 1], marks[hi])
                open_brackets[bracket] = open_brackets.get(bracket, 0) + 1
        if not open_brackets:
            return Cuts(chosen, [known[m][0] for m in chosen] + [total], [known[m][1] for m in chosen] + [rows])
        each = max(3, min(255, PROBES // len(open_brackets)))
        probes: set[int] = set()
        for lo, hi in open_brackets:
            probes |= _between(lo, hi, each, b0, b1)
        fresh = sorted(probes - known.keys())
        known |= dict(zip(fresh, _below(keys, fresh), strict=True))


def _between(lo: int, hi: int, n: int, b0: int, b1: int) -> set[int]:
    """At most n + 2 keys strictly inside a bracket: between first keys while there are any, then inside one."""
    a_lo, a_hi = (lo >> 64) + 1, (hi - 1) >> 64
    if a_lo <= a_hi:
        inside = a_hi - a_lo + 1
        steps = range(inside) if inside <= n else (inside * i // (n + 1) for i in range(1, n + 1))
        return {p for s in steps if lo < (p := (a_lo + s) << 64) < hi}
    a = lo & ~((1 << 64) - 1)
    lo, hi = max(lo, (a | (b0 - _LOW))), min(hi, (a | (b1 - _LOW)) + 1)
    if hi - lo - 1 <= n:
        return set(range(lo + 1, hi))
    return {lo + (hi - lo) * i // (n + 1) for i in range(1, n + 1)} - {lo}


def shard_documents(
    docs: DataFrame, shards: int = 8, tolerance: float = 0.01, cells: int = 8, cell_bytes: int = 256 << 20
) -> DataFrame:
    """Whole rows in ``shards`` of near-equal bytes; size is the text's UTF-8 bytes plus 1.

    Returns ``document`` (a struct of all input columns, so no name can clash),
    ``size`` long, ``shard`` int and ``slot`` long (gapless from 0 in each shard).

    A shard's bytes are within ``tolerance`` of the equal share, or as near as
    whole documents allow.  Each shard is exchanged as ``cells`` tasks or more, so
    that none is much over ``cell_bytes``.  A null text has no bytes; a null doc_id
    sorts first; rows with equal doc_id and text stay together and take
    neighbouring slots; an empty table gives an empty result.
    """
    keyed = docs.select(
        F.struct("*").alias("document"),
        F.xxhash64("text").alias("a"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("b"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
    )
    keys = durable(keyed.select("a", "b", "size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    cells = max(cells, -(-total // (shards * cell_bytes)))
    parts = shards * cells
    slack = [tolerance * total / shards / 2 if i % cells == 0 else total / parts / 8 for i in range(1, parts)]
    cuts = histogram_cuts(keys, parts, slack)
    first, second = _pairs(cuts.bounds)

    @pandas_udf("int")
    def cell(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(position(first, second, a.to_numpy(), b.to_numpy()).astype("int32"))

    starts = [0, *cuts.rows_below[:-1]]
    offsets = [(i, i // cells, starts[i] - starts[i - i % cells]) for i in range(parts)]
    offsets = docs.sparkSession.createDataFrame(offsets, "cell int, shard int, ahead long")  # one row per cell
    plain = [F.col("document")[n] for n, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy("cell").orderBy("a", "b", F.xxhash64(*plain))
    return (
        keyed.withColumn("cell", cell("a", "b"))
        .repartitionById(parts, F.col("cell"))
        .withColumn("_row", F.row_number().over(order).cast("long"))
        .join(F.broadcast(offsets), "cell", "left")
        .select("document", "size", "shard", (F.col("ahead") + F.col("_row") - 1).alias("slot"))
    )
