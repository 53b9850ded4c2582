"""Mixing of sources to target weights by Poisson replication, with DataFrame functions only.

A source whose share of the corpus should be w repeats each of its documents
lambda = w * total / size times on average.  A document's count is the Poisson
quantile of a uniform number hashed from its id, so it is the same in any run and
any partitioning.  Every document is exploded by its count, and the copies are
dealt to partitions and ordered by a hash of id and copy, a global shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

#: Hex digits of the hash that make the uniform number.
_DIGITS = 13
#: A larger rate is cut into equal parts of at most this, whose counts are drawn apart and added:
#: a sum of Poisson numbers is one of the summed rate, and the plan holds the steps of one part.
PART = 256
#: Copies that one task makes of a document at a time.
SPREAD = 1_000


def poisson_steps(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ...; the last one, which no 52-bit number tells from 1, is 1."""
    if rate <= 0:
        return []
    steps, total, term, k = [], 0.0, 1.0, 0
    while k <= rate or term >= 2.0**-60:
        term = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        total += term
        steps.append(min(total, 1.0))
        k += 1
    return [*steps[:-1], 1.0]


def uniform(seed: str, *parts: Column) -> Column:
    """52 hashed bits as a number in [0, 1)."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long") / F.lit(2.0 ** (4 * _DIGITS))


def source_sizes(docs: DataFrame, named: list[str]) -> dict[str | None, int]:
    """Bytes (plus 1 a document) by named source; all others, null among them, under None."""
    group = F.when(F.col("source").isin(named), F.col("source")) if named else F.lit(None).cast("string")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return {r[0]: r[1] for r in docs.groupBy(group.alias("source")).agg(F.sum(size)).collect()}


def rates(sizes: Mapping[str | None, int], weights: Mapping[str, float], growth: float) -> dict[str | None, float]:
    """Mean repetitions per named source and, under None, of all others together.

    The others share what the named weights leave of 1, in proportion to their
    size.  A named source without documents cannot be repeated; its weight is
    left out and the rest scaled up.
    """
    if any(not 0 <= w <= 1 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights are shares of the mixture: from 0 to 1, and 1 in sum at most")
    total = sum(sizes.values())
    shares = {s: w for s, w in weights.items() if sizes.get(s)}
    if sizes.get(None):
        shares[None] = max(0.0, 1 - sum(weights.values()))
    whole = sum(shares.values())
    return {s: growth * w / whole * total / sizes[s] for s, w in shares.items()} if whole > 0 else {}


def replicate(
    docs: DataFrame, weights: Mapping[str, float], growth: float = 1.0, seed: str = "mix", partitions: int | None = None
) -> DataFrame:
    """Copies of whole rows so that named sources take their target weights by bytes.

    Returns ``document`` (struct of all input columns, so no name can clash), ``rate``,
    ``copies`` (the document's count) and ``copy`` from 0, in shuffled order.  The
    mixture's expected size is ``growth`` times the corpus.  Sources not named,
    null among them, keep their proportions to one another.  Rows with equal ids,
    and with null ids, draw the same number and share their copies' places, in any order;
    an empty table gives an empty result.  Rates may be as large as counts of copies (an
    int); the work is proportional to the copies, spread over tasks where a rate is large.
    ``weights`` is a parameter, so only its few sources ever reach the driver.
    """
    mean = rates(source_sizes(docs, list(weights)), weights, growth)
    rate, count = F.lit(mean.get(None, 0.0)), _quantile(mean.get(None, 0.0), seed)
    for source, r in mean.items():
        if source is not None:
            rate = F.when(F.col("source") == source, F.lit(r)).otherwise(rate)
            count = F.when(F.col("source") == source, _quantile(r, seed)).otherwise(count)
    counted = docs.select(F.struct("*").alias("document"), rate.alias("rate"), count.alias("copies"))
    exploded = _copied(counted.where("copies > 0"), max(mean.values(), default=0.0) > PART)
    place = uniform(f"{seed}-order", F.col("document.doc_id"), F.col("copy"))
    placed = exploded.withColumn("place", place)
    dealt = placed.repartition(partitions, "place") if partitions else placed.repartition("place")
    return dealt.sortWithinPartitions("place").select("document", "rate", "copies", "copy", "place")


def _copied(counted: DataFrame, spread: bool) -> DataFrame:
    """A row for each copy; with ``spread``, documents of many copies are dealt out in portions first."""
    whole = F.sequence(F.lit(0), F.col("copies") - 1)
    if not spread:
        return counted.select("*", F.explode(whole).alias("copy"))
    few = counted.where(F.col("copies") <= SPREAD).select("*", F.explode(whole).alias("copy"))
    first = F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(SPREAD))).alias("first")
    portions = counted.where(F.col("copies") > SPREAD).select("*", first).repartition(F.col("document"), F.col("first"))
    last = F.least(F.col("first") + (SPREAD - 1), F.col("copies") - 1)
    return few.unionByName(portions.select("document", "rate", "copies", F.explode(F.sequence("first", last)).alias("copy")))


def _quantile(rate: float, seed: str) -> Column:
    """How many steps of the distribution the document's uniform number has reached, added up over the parts of the rate."""
    parts = max(1, math.ceil(rate / PART))
    steps = poisson_steps(rate / parts)
    if not steps:
        return F.lit(0)
    listed = F.array(*[F.lit(s) for s in steps])
    if parts == 1:
        u = uniform(seed, F.col("doc_id"))
        return F.size(F.filter(listed, lambda s: s <= u))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: uniform(seed, F.col("doc_id"), i))
    return F.aggregate(drawn, F.lit(0), lambda n, u: n + F.size(F.filter(listed, lambda s: s <= u)))
