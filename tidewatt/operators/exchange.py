"""A keyed exchange of row positions: each of 0..n-1 gets exactly one partner."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, functions as F

# Rounds of the exchange; each one moves both halves of a position.
ROUNDS = 3

# Rectangles tried for the one with the fewest places beyond n.
TRIES = 1_000


def rectangle(n: int) -> tuple[int, int]:
    """Sides (a, b) near the square root of ``n`` with ``a * b >= n`` and the least surplus."""
    root = isqrt(n - 1) + 1
    sides = ((a, -(-n // a)) for a in range(root, root + min(TRIES, root // 4 + 1)))
    return min(sides, key=lambda s: (s[0] * s[1] - n, s[0]))


def partner(pos: Column, n: int, key: int) -> Column:
    """The position that ``pos`` is exchanged for; a bijection on 0..n-1 that ``key`` picks.

    A position is a place in an a x b rectangle.  Each round turns its row by a
    hash of its column and its column by a hash of the new row, which can be
    undone, so no two places meet.  The few places beyond ``n`` are walked
    through until the walk comes back below ``n``.  Nothing is sorted or
    collected: a row's partner follows from its position alone.
    """
    a, b = rectangle(n)
    surplus = a * b - n
    moved = _moved(pos, a, b, key)
    if surplus == 0:
        return moved
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(surplus)), moved, lambda at, _: F.when(at >= n, _moved(at, a, b, key)).otherwise(at)
    )
    return F.when(moved < n, moved).otherwise(walked)


def with_partner(df: DataFrame, pos: str, n: int, key: int, name: str) -> DataFrame:
    """``df`` with the column ``partner(pos, n, key)``; ``pos`` is never null.

    Each half of a place is a column of its own that later ones refer to, so a row costs two
    hashes a round, while one nested expression repeats them for each use and each filter
    that the planner infers from a join.  Only the few places beyond ``n`` are walked.
    """
    a, b = rectangle(n)
    columns = df.columns
    df = df.withColumns({"_row": F.floor(F.col(pos) / b), "_col": F.col(pos) % b})
    for i in range(ROUNDS):
        df = df.withColumn("_row", (F.col("_row") + _hash(key, "row", F.lit(i), F.col("_col"))) % a)
        df = df.withColumn("_col", (F.col("_col") + _hash(key, "col", F.lit(i), F.col("_row"))) % b)
    df = df.withColumn("_place", F.col("_row") * b + F.col("_col"))
    inside = F.col("_place") if a * b == n else F.when(F.col("_place") < n, F.col("_place")).otherwise(partner(F.col(pos), n, key))
    # Never null, which the planner can see: no filter on it is inferred.
    return df.select(*columns, F.coalesce(inside, F.lit(0)).cast("bigint").alias(name))


def _moved(place: Column, a: int, b: int, key: int) -> Column:
    def turn(state: Column, i: Column) -> Column:
        row = (state["row"] + _hash(key, "row", i, state["col"])) % a
        return F.struct(row.alias("row"), ((state["col"] + _hash(key, "col", i, row)) % b).alias("col"))

    first = F.struct(F.floor(place / b).alias("row"), (place % b).alias("col"))
    return F.aggregate(
        F.array(*[F.lit(i) for i in range(ROUNDS)]), first, turn, lambda s: s["row"] * b + s["col"]
    )


def _hash(key: int, side: str, i: Column, value: Column) -> Column:
    """Sixty bits of a digest, the same in any engine that has MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(key), F.lit(side), i, value).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def partner_sql(table: str, keys: str) -> str:
    """The same exchange as common table expressions for tests and SQL twins.

    ``table`` has a column pos that counts from 0; ``keys`` is a list of values.
    The last of them, ``exchanged``, has key, pos and partner.
    """

    def digest(side: str, i: int, value: str) -> str:
        return f"('0x' || substr(md5(concat_ws(':', key, '{side}', {i}, {value})), 1, 15))::BIGINT"

    turns = ", ".join(
        f"(r{i} + {digest('row', i, f'c{i}')}) % a AS r{i + 1}, (c{i} + {digest('col', i, f'r{i + 1}')}) % b AS c{i + 1}"
        for i in range(ROUNDS)
    )
    return f"""
rectangle AS MATERIALIZED (
  SELECT n, a, (n + a - 1) // a AS b
  FROM (SELECT n, root + unnest(range(least({TRIES}, root // 4 + 1))) AS a
        FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS root FROM {table}))
  ORDER BY a * ((n + a - 1) // a) - n, a LIMIT 1),
walk AS (
  SELECT key, pos, pos AS place, 0 AS step FROM {table}, (SELECT unnest([{keys}]) AS key)
  UNION ALL
  SELECT key, pos, r{ROUNDS} * b + c{ROUNDS}, step + 1
  FROM (SELECT key, pos, step, a, b, place // b AS r0, place % b AS c0, {turns}
        FROM walk, rectangle WHERE step = 0 OR place >= n)),
exchanged AS (SELECT key, pos, place AS partner FROM walk, rectangle WHERE step > 0 AND place < n)"""
