"""Fill gaps linearly by row position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.operators.blocks import BLOCK, running_totals
from tidewatt.session import attach, durable
from tidewatt.settings import BLOCK_ROWS


def interpolate_rows(
    df: DataFrame, keys: list[str], columns: list[str], pos: str = "pos", size: int = BLOCK_ROWS
) -> DataFrame:
    """Linear in row position, ignoring time spacing; edges take the nearest value.

    All columns are filled in one pass: one exchange lays the rows out in blocks, where the
    known (position, value) pairs before and after each row are found by one pass up and
    one pass down, each linear in the block, and the result is written.  A block's first and last row tell its outermost known pairs; those
    of whole blocks are carried on in both directions, so a long series is never held by
    one task.
    """
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(c).alias("v"))) for c in columns}
    order = Window.partitionBy(*keys, BLOCK).orderBy(pos)
    # A frame that ends beyond the current row would be folded anew for every row.
    back = Window.partitionBy(*keys, BLOCK).orderBy(F.desc(pos))
    upto = (Window.unboundedPreceding, 0)
    sides = {f"_before_{c}": F.last(k, True).over(order.rowsBetween(*upto)) for c, k in known.items()}
    sides |= {f"_after_{c}": F.last(k, True).over(back.rowsBetween(*upto)) for c, k in known.items()}
    at_edge = F.lag(pos).over(order).isNull() | F.lead(pos).over(order).isNull()
    laid = durable(df.withColumn(BLOCK, F.floor(F.col(pos) / size)).withColumns(sides | {"_edge": at_edge}))

    edges = laid.filter("_edge").groupBy(*keys, BLOCK).agg(
        *[F.max(f"_before_{c}").alias(f"_last_{c}") for c in columns],
        *[F.min(f"_after_{c}").alias(f"_first_{c}") for c in columns],
    )
    earlier = running_totals(edges, keys, {f"_from_{c}": ("max", f"_last_{c}") for c in columns}, BLOCK, size, inclusive=False)
    turned = earlier.withColumn("_back", -F.col(BLOCK))
    both = running_totals(turned, keys, {f"_to_{c}": ("min", f"_first_{c}") for c in columns}, "_back", size, inclusive=False)
    ends = both.select(*keys, BLOCK, *[f"_{side}_{c}" for side in ("from", "to") for c in columns])
    out = attach(laid, ends, [*keys, BLOCK]).withColumns({c: _blend(c, pos) for c in columns})
    return out.drop(BLOCK, "_edge", *[f"_{side}_{c}" for side in ("before", "after", "from", "to") for c in columns])


def _blend(c: str, pos: str) -> Column:
    before = F.coalesce(F.col(f"_before_{c}"), F.col(f"_from_{c}"))
    after = F.coalesce(F.col(f"_after_{c}"), F.col(f"_to_{c}"))
    share = (F.col(pos) - before["p"]) / (after["p"] - before["p"])
    return (
        F.when(F.col(c).isNotNull(), F.col(c))
        .when(before.isNull(), after["v"])
        .when(after.isNull(), before["v"])
        .otherwise(before["v"] + (after["v"] - before["v"]) * share)
    )
