"""Exact top-k inner products by the three-phase uniform threshold method.

The components of the vectors are dealt to ``blocks``; a block of the components is a
list of local scores for every query.  Phase 1 gathers each block's best local scores
and its least one; the k-th best whole score among the entries listed is a safe cutoff.
Phase 2 sends that cutoff to all blocks, and each returns every entry that its equal
share of the cutoff, above the blocks' least scores, does not rule out.  Phase 3
resolves the remaining candidates exactly.

Work is cut into cells of (block, some vectors, some queries) that meet by a cogroup,
so neither side is ever broadcast or held whole.  Equal vectors are one entry with
their k + 1 smallest ids, the only ones that can rank.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.session import durable

#: Distinct vectors and queries in a cell, at most about.
VECTORS, QUERIES = 8192, 2048
BLOCKS = 2
#: Entries that a cell lists for a query in phase 1, as a multiple of k; more make the cutoff sharper.
LISTED = 4


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 x) of every component; vectors with a null or non-finite one, or without id, are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    whole = F.transform(x, lambda c: F.floor(c * 256).cast("long"))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(r, np.int64) for r in rows])


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where every partial sum is exact there."""
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if bound < 1 << 24:
        return (queries.astype(np.float32) @ vectors.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    return queries @ vectors.T


def _first_phase(k: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Each query's k best entries in a cell, and its least local score there (as entry null)."""

    def best(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"q": [], "block": [], "e": [], "part": []}).astype({"e": "object"})
        s = _products(_matrix(queries["v"]), _matrix(vectors["v"]))
        own = queries["q"].to_numpy()[:, None] == vectors["e"].to_numpy()[None, :]
        own &= vectors["lone"].to_numpy()[None, :]
        low = s.min(axis=1)
        shown = np.where(own, np.iinfo(np.int64).min, s)
        n = min(k, s.shape[1])
        at = np.argpartition(-shown, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(n), (len(s), 1))
        rows = np.repeat(np.arange(len(s)), n)
        keep = ~own[rows, at.ravel()]
        q, e = queries["q"].to_numpy(), vectors["e"].to_numpy()
        found = pd.DataFrame({"q": q[rows], "block": key[0], "e": e[at.ravel()], "part": s[rows, at.ravel()]})[keep]
        least = pd.DataFrame({"q": q, "block": key[0], "e": None, "part": low})
        return pd.concat([found.astype({"e": "object"}), least.astype({"e": "object"})])

    return best


def _second_phase(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Entries whose local score is at or above the query's share of the cutoff."""
    if not len(vectors) or not len(queries):
        return pd.DataFrame({"q": [], "block": [], "e": [], "part": []})
    s = _products(_matrix(queries["v"]), _matrix(vectors["v"]))
    row, column = np.nonzero(s >= queries["share"].to_numpy()[:, None])
    return pd.DataFrame({
        "q": queries["q"].to_numpy()[row], "block": key[0], "e": vectors["e"].to_numpy()[column], "part": s[row, column],
    })


def _sliced(blocks: int) -> Column:
    """(block, v) of every slice of the components; the number of components may differ by row."""
    width = F.ceil(F.greatest(F.size("v"), F.lit(1)) / blocks).cast("int")
    return F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(blocks - 1)),
        lambda b: F.struct(b.alias("block"), F.slice("v", b * width + 1, width).alias("v")),
    ))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, blocks: int = BLOCKS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows for every row where ``queries`` (of vec_id) holds.

    ``vectors`` has vec_id and embedding.  Ties go to the smaller vec_id.  Vectors that
    ``quantised`` leaves out take no part, nor do those of another length than the
    query's.  Rows equal in id and vector count once.  Every id is one answer, by its best
    vector where it has several (and, if it is a query, by the best for any of its own);
    a query's id is never its own answer.  Empty in, empty out.
    """
    rows = quantised(vectors).distinct()
    rows = durable(rows.withColumn("dims", F.size("v")))
    # One entry for each distinct vector, named by a hash of it and its smallest id.
    entries = rows.groupBy("v", "dims").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    entries = durable(entries.withColumn("e", F.xxhash64("low", "v")))
    counts = entries.agg(F.count("*")).first()[0]
    named = entries.select(F.col("e").alias("entry"), F.col("v").alias("_v"))
    asked = rows.where(queries).join(named, F.col("v") == F.col("_v"))
    asked = durable(asked.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("q"), "dims", "v"))
    distinct = durable(asked.select("q", "dims", "v").distinct())
    n_queries = distinct.count()
    if not n_queries:
        return _empty(vectors)
    v_cells, q_cells = -(-counts // VECTORS), -(-n_queries // QUERIES)

    lone = entries.select("e", "dims", "v", (F.col("n") == 1).alias("lone"), F.pmod("e", F.lit(v_cells)).alias("vc"))
    left = lone.withColumn("qc", F.explode(F.sequence(F.lit(0), F.lit(q_cells - 1)).cast("array<long>")))
    left = left.select("e", "dims", "lone", "vc", "qc", _sliced(blocks).alias("s")).select("e", "dims", "lone", "vc", "qc", "s.*")

    def cells(asking: DataFrame) -> DataFrame:
        keep = [c for c in asking.columns if c != "v"]
        spread = asking.withColumn("qc", F.pmod("q", F.lit(q_cells)))
        spread = spread.withColumn("vc", F.explode(F.sequence(F.lit(0), F.lit(v_cells - 1)).cast("array<long>")))
        return spread.select(*keep, "vc", "qc", _sliced(blocks).alias("s")).select(*keep, "vc", "qc", "s.*")

    key = ["block", "dims", "vc", "qc"]
    schema = "q long, block int, e long, part long"
    best = _first_phase(LISTED * k)
    gathered = durable(left.groupBy(*key).cogroup(cells(distinct).groupBy(*key)).applyInPandas(best, schema))

    # The least local score of each block, and their sum.
    least = gathered.where("e IS NULL").groupBy("q", "block").agg(F.min("part").alias("least"))
    least = durable(least.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("block", "least"))).alias("least")))
    floor_sum = F.aggregate(F.map_values("least"), F.lit(0).cast("long"), lambda a, x: a + x)
    # The exact scores of all entries seen so far: the k-th best id's among them is a safe cutoff.
    other = entries.select("e", "low", F.col("v").alias("w"))
    askers = asked.select("q", F.col("query_id").alias("low")).distinct()
    product = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
    seen = gathered.where("e IS NOT NULL").select("q", "e").distinct()
    safe = seen.join(distinct.select("q", "v"), "q").join(other, "e").select("q", "low", product.alias("score"))
    cutoff = _kth(safe, askers, k).withColumnRenamed("kth", "cutoff")
    # An entry at the cutoff exceeds the least scores by an equal share in one block at least.
    shares = distinct.join(least, "q").join(cutoff, "q", "left").select(
        "q", "dims", "v", "cutoff", "least",
        F.ceil((F.coalesce("cutoff", floor_sum) - floor_sum) / F.lit(blocks)).cast("long").alias("over"),
    )
    shares = durable(shares)
    asking = shares.select("q", "dims", "v", "over", "least")
    sliced = cells(asking).withColumn("share", F.col("over") + F.element_at("least", F.col("block"))).drop("over", "least")
    passed = left.groupBy(*key).cogroup(sliced.groupBy(*key)).applyInPandas(_second_phase, schema)

    # What is known of an entry, and at most the share in blocks that did not pass it.
    met = passed.groupBy("q", "e").agg(F.sum("part").alias("sum"), F.collect_set("block").alias("blocks"))
    above = shares.select("q", "v", "cutoff", "over", "least")
    missing = F.aggregate(
        F.map_values(F.map_filter("least", lambda b, _: ~F.array_contains("blocks", b))), F.lit(0).cast("long"),
        lambda a, x: a + x + F.col("over") - 1,
    )
    hopeful = met.join(above, "q").where(F.col("cutoff").isNull() | (F.col("sum") + missing >= F.col("cutoff")))
    exact = hopeful.join(other, "e").select("q", "e", "low", "cutoff", product.alias("score"))
    exact = durable(exact.where(F.col("cutoff").isNull() | (F.col("score") >= F.col("cutoff"))))

    # Back to ids: of equal vectors the k + 1 smallest ids, then the k best for each query row.
    by_id = Window.partitionBy("e").orderBy("vec_id")
    members = rows.join(named, F.col("v") == F.col("_v")).select(F.col("entry").alias("e"), "vec_id").distinct()
    members = members.withColumn("i", F.row_number().over(by_id)).where(F.col("i") <= k + 1).drop("i")
    # A query needs no entry below its k-th best id.
    near = exact.join(_kth(exact, askers, k), "q", "left").where(F.col("kth").isNull() | (F.col("score") >= F.col("kth")))
    near = near.select("q", "e", "score")
    answers = asked.select("query_id", "q").distinct().join(near, "q").join(members, "e").where("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    final = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = final.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return final.select("query_id", "rank", "vec_id", "score")


def _kth(scored: DataFrame, askers: DataFrame, k: int) -> DataFrame:
    """(q, kth): the k-th highest score of different ids (``low``) that do not ask for ``q`` themselves."""
    best = scored.join(askers, ["q", "low"], "left_anti").groupBy("q", "low").agg(F.max("score").alias("kth"))
    order = Window.partitionBy("q").orderBy(F.desc("kth"), "low")
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("q", "kth")


def _empty(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
