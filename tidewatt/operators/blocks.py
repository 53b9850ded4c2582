"""Cut long series into equal blocks of positions.

A series is split on ``floor(pos / size)``.  Bounded frames stay exact because
each block also receives read-only copies of the neighbouring rows it can see;
unbounded running values are combined from per-block totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidewatt.session import attach, durable
from tidewatt.settings import BLOCK_ROWS

BLOCK = "_block"
COPY = "_copy"


def with_blocks(
    df: DataFrame, pos: str = "pos", before: int = 0, after: int = 0, size: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``_block`` plus copies of rows that a neighbouring block looks at."""
    if max(before, after) > size:
        raise ValueError("a block must be at least as long as the frame")
    own = F.floor(F.col(pos) / size)
    offset = F.pmod(F.col(pos), F.lit(size))
    homes = F.array(own)
    if before:
        homes = F.concat(homes, F.when(offset >= size - before, F.array(own + 1)).otherwise(F.array().cast("array<bigint>")))
    if after:
        homes = F.concat(homes, F.when(offset < after, F.array(own - 1)).otherwise(F.array().cast("array<bigint>")))
    if not before and not after:
        return df.withColumn(BLOCK, own).withColumn(COPY, F.lit(False))
    return df.withColumn(BLOCK, F.explode(homes)).withColumn(COPY, F.col(BLOCK) != own)


def drop_copies(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(COPY)).drop(BLOCK, COPY)


def block_window(keys: list[str], pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(pos)


RUNNING = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, tuple[str, str | Column]],
    pos: str = "pos",
    size: int = BLOCK_ROWS,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum, max or min of whole series in blocks.

    Keys are never null.  ``measures`` maps an output column to (kind, input column).  One
    exchange lays the rows out in blocks, which are accumulated and written; a block's
    last row holds its totals, so what ``df`` is made from runs once.  The totals are
    accumulated by the same rule one level up and met by block.
    """
    order = Window.partitionBy(*keys, BLOCK).orderBy(pos)
    cut = df.withColumn(BLOCK, F.floor(F.col(pos) / size))
    upto = {f"_upto_{n}": _over(kind, c, order, True) for n, (kind, c) in measures.items()}
    before = {} if inclusive else {n: _over(kind, c, order, False) for n, (kind, c) in measures.items()}
    laid = durable(cut.withColumns(upto | before | {"_last": F.lead(pos).over(order).isNull()}))
    totals = laid.filter("_last").select(*keys, BLOCK, *upto)
    carried = running_totals(
        totals, keys, {f"_carry_{n}": (kind, f"_upto_{n}") for n, (kind, _) in measures.items()}, BLOCK, size, inclusive=False
    ).select(*keys, BLOCK, *[f"_carry_{n}" for n in measures])
    inner = "_upto_{}" if inclusive else "{}"
    return (
        attach(laid, carried, [*keys, BLOCK])
        .withColumns({n: _combine(kind, F.col(inner.format(n)), F.col(f"_carry_{n}")) for n, (kind, _) in measures.items()})
        .drop(BLOCK, "_last", *upto, *[f"_carry_{n}" for n in measures])
    )


def running_totals(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, tuple[str, str | Column]],
    pos: str,
    size: int = BLOCK_ROWS,
    depth: int = 1,
    inclusive: bool = True,
) -> DataFrame:
    """The same for a table of totals, a row a block: nothing is written, ``df`` is read once for each of ``depth`` + 1 levels."""
    if depth == 0:
        frame = Window.partitionBy(*keys).orderBy(pos)
        return df.withColumns({name: _over(kind, c, frame, inclusive) for name, (kind, c) in measures.items()})

    level = f"_level{depth}"
    cut = df.withColumn(level, F.floor(F.col(pos) / size))
    totals = cut.groupBy(*keys, level).agg(
        *[RUNNING[kind](_col(c)).alias(f"_total_{name}") for name, (kind, c) in measures.items()]
    )
    carried = running_totals(
        totals,
        keys,
        {f"_above_{name}": (kind, f"_total_{name}") for name, (kind, _) in measures.items()},
        level,
        size,
        depth - 1,
        inclusive=False,
    ).select(*keys, level, *[f"_above_{name}" for name in measures])
    frame = Window.partitionBy(*keys, level).orderBy(pos)
    inside = cut.withColumns({name: _over(kind, c, frame, inclusive) for name, (kind, c) in measures.items()})
    return (
        inside.join(carried, [*keys, level], "left")
        .withColumns({name: _combine(kind, F.col(name), F.col(f"_above_{name}")) for name, (kind, _) in measures.items()})
        .drop(level, *[f"_above_{name}" for name in measures])
    )


def _over(kind: str, c: str | Column, order: WindowSpec, inclusive: bool) -> Column:
    return RUNNING[kind](_col(c)).over(order.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))


def _combine(kind: str, inner: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.coalesce(inner + carry, inner, carry)
    return F.greatest(inner, carry) if kind == "max" else F.least(inner, carry)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
