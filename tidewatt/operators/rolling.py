"""Trailing-window statistics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatt.operators.blocks import BLOCK, COPY, block_window, drop_copies, with_blocks
from tidewatt.settings import BLOCK_ROWS

# A window is assembled from at most this many shorter windows at once.
FAN = 16


@dataclass(frozen=True)
class Trailing:
    """Mean and deviation of ``column`` over trailing windows of whole rows.

    ``offset`` 1 leaves the current row out, 0 includes it.  ``minimum`` is the
    number of non-null values a window needs; by default all of them.
    """

    name: str
    column: str
    windows: Sequence[int]
    offset: int = 1
    minimum: int | None = None

    def steps(self) -> list[tuple[int, int]]:
        """(window, shorter window it is built from), shortest first."""
        plan: dict[int, int] = {}
        for k in sorted(set(self.windows)):
            self._plan(k, plan)
        return sorted(plan.items())

    def _plan(self, k: int, plan: dict[int, int]) -> None:
        if k == 1 or k in plan:
            return
        child = max(d for d in (1, *plan) if k % d == 0)
        if k // child > FAN:
            parts = min((d for d in range(2, FAN + 1) if k % d == 0), key=lambda d: d + k // d, default=k)
            child = k // parts
            self._plan(child, plan)
        plan[k] = child

    def column_names(self, k: int) -> tuple[str, str, str]:
        return tuple(f"_{self.name}_{part}_{k}" for part in ("n", "mean", "m2"))

    def mean_name(self, k: int) -> str:
        return f"_{self.name}_whole_mean_{k}"

    def std_name(self, k: int) -> str:
        return f"_{self.name}_whole_std_{k}"

    def mean(self, k: int) -> Column:
        n, mean, _ = self.column_names(k)
        return F.col(mean) if self.minimum is None else F.when(F.col(n) >= self.minimum, F.col(mean))

    def std(self, k: int) -> Column:
        n, _, m2 = self.column_names(k)
        if self.minimum is None:
            return F.sqrt(F.col(m2) / (k - 1))
        return F.when(F.col(n) >= max(self.minimum, 2), F.sqrt(F.col(m2) / (F.col(n) - 1)))


def add_trailing(df: DataFrame, w: WindowSpec, specs: Iterable[Trailing]) -> DataFrame:
    """Add count, mean and squared deviation columns per window of every spec.

    A window of k rows is merged from k/d windows of d rows fetched with
    ``lag``, so 672 rows cost a handful of lookups instead of 672 reads, and
    merging means and squared deviations keeps full precision.  All specs
    advance together: each round is one window operator over the same
    partitioning and order.  Whole windows have equal parts and stay null
    until every part is there; partial windows also carry their counts.
    """
    specs = list(specs)
    first: dict[str, Column] = {}
    for s in specs:
        n, mean, m2 = s.column_names(1)
        x = F.lag(s.column, s.offset).over(w) if s.offset else F.col(s.column)
        first[mean] = x
        if s.minimum is not None:
            first[n] = F.when(x.isNotNull(), 1.0).otherwise(0.0)
        first[m2] = F.lit(0.0) if s.minimum is not None else F.when(x.isNotNull(), 0.0)
    df = df.withColumns(first)
    plans = [s.steps() for s in specs]
    for round_ in range(max((len(p) for p in plans), default=0)):
        todo = [(s, *p[round_]) for s, p in zip(specs, plans) if round_ < len(p)]
        fetched: dict[str, Column] = {}
        for s, k, d in todo:
            for c in _parts_needed(s, d):
                fetched.update({f"{c}_{i}": F.lag(c, i * d).over(w) for i in range(1, k // d)})
        df = df.withColumns(fetched)
        # Counts, then means, then deviations: later ones read earlier columns.
        for stage in (_counts, _means, _deviations):
            added = {name: c for s, k, d in todo for name, c in stage(s, k, d)}
            df = df.withColumns(added) if added else df
        df = df.drop(*fetched)
    return df


def look_back(
    df: DataFrame,
    keys: list[str],
    lags: dict[str, tuple[str, int]],
    specs: Iterable[Trailing],
    before: int,
    pos: str = "pos",
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``lags`` (name: (column, rows back)) and the mean and deviation of every window of ``specs``.

    The columns are ``mean_name(k)`` and ``std_name(k)`` of a spec and hold what ``add_trailing``
    gives, merged from the same parts in the same order, but a block (at most ``size + before``
    rows) is one Arrow table and a merge one pass over arrays, where wide rows would be copied
    from window to window.  Whole windows only; measures are read as doubles.  Rows without a
    position are left out.
    """
    specs = list(specs)
    if any(s.minimum is not None for s in specs):
        raise ValueError("only whole windows")
    blocked = with_blocks(df.filter(F.col(pos).isNotNull()), pos, before=before, size=size)
    types = {f.name: f.dataType for f in df.schema.fields}
    added = [StructField(name, types[c]) for name, (c, _) in lags.items()]
    added += [StructField(c, DoubleType()) for s in specs for k in s.windows for c in (s.mean_name(k), s.std_name(k))]
    schema = StructType([*df.schema.fields, *added])
    names = df.columns

    def trail(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column(pos).to_numpy(), kind="stable"))).combine_chunks()
        keep = pa.array(~table.column(COPY).to_numpy(zero_copy_only=False).astype(bool))
        columns = {c: table.column(c) for c in names}
        at = np.arange(table.num_rows)
        for name, (c, k) in lags.items():
            columns[name] = table.column(c).take(pa.array(at - k, mask=at < k))
        for s in specs:
            columns.update(_whole_windows(s, table.column(s.column)))
        return pa.table(columns).filter(keep)

    return blocked.groupBy(*keys, BLOCK).applyInArrow(trail, schema)


def _whole_windows(s: Trailing, column: pa.ChunkedArray) -> dict[str, pa.Array]:
    """Means and deviations of one block, as ``_means`` and ``_deviations`` merge them."""
    known = _later(~column.is_null().to_numpy(zero_copy_only=False).astype(bool), s.offset, False)
    first = _later(column.cast(pa.float64()).to_numpy(zero_copy_only=False), s.offset, np.nan)
    whole, mean, m2 = {1: known}, {1: first}, {1: np.zeros(len(first))}
    with np.errstate(all="ignore"):
        for k, d in s.steps():
            parts = range(0, k, d)
            whole[k] = np.logical_and.reduce([_later(whole[d], i, False) for i in parts])
            means = [_later(mean[d], i, np.nan) for i in parts]
            mean[k] = _sum(means) / len(means)
            between = _sum([(p - mean[k]) * (p - mean[k]) for p in means])
            m2[k] = _sum([*[_later(m2[d], i, np.nan) for i in parts], between * d]) if d > 1 else between
        out = {}
        for k in s.windows:
            out[s.mean_name(k)] = pa.array(mean[k], mask=~whole[k])
            out[s.std_name(k)] = pa.array(np.sqrt(m2[k] / (k - 1)), mask=~whole[k])
    return out


def _later(values: np.ndarray, rows: int, empty) -> np.ndarray:
    """The array ``rows`` places further down, ``empty`` at its head."""
    if rows == 0:
        return values
    moved = np.full(len(values), empty, values.dtype)
    moved[rows:] = values[: max(0, len(values) - rows)]
    return moved


def drop_states(df: DataFrame, specs: Iterable[Trailing]) -> DataFrame:
    return df.drop(*[c for s in specs for k in {1, *dict(s.steps())} for c in s.column_names(k)])


def _parts_needed(s: Trailing, d: int) -> list[str]:
    n, mean, m2 = s.column_names(d)
    return ([n] if s.minimum is not None else []) + [mean] + ([m2] if d > 1 else [])


def _gather(c: str, parts: int) -> list[Column]:
    return [F.col(c), *[F.col(f"{c}_{i}") for i in range(1, parts)]]


def _counts(s: Trailing, k: int, d: int):
    if s.minimum is not None:
        n = s.column_names(d)[0]
        yield s.column_names(k)[0], _sum([F.coalesce(p, F.lit(0.0)) for p in _gather(n, k // d)])


def _means(s: Trailing, k: int, d: int):
    n, mean, _ = s.column_names(d)
    parts = k // d
    if s.minimum is None:
        yield s.column_names(k)[1], _sum(_gather(mean, parts)) / parts
        return
    total = F.col(s.column_names(k)[0])
    weighted = _sum([F.coalesce(a * b, F.lit(0.0)) for a, b in zip(_gather(n, parts), _gather(mean, parts))])
    yield s.column_names(k)[1], F.when(total > 0, weighted / total)


def _deviations(s: Trailing, k: int, d: int):
    n, mean, m2 = s.column_names(d)
    parts = k // d
    centre = F.col(s.column_names(k)[1])
    gaps = [(p - centre) * (p - centre) for p in _gather(mean, parts)]
    inner = _gather(m2, parts) if d > 1 else []
    if s.minimum is None:
        between = _sum(gaps) * d if d > 1 else _sum(gaps)
        yield s.column_names(k)[2], _sum([*inner, between])
        return
    zero = F.lit(0.0)
    spread = [F.coalesce(a * g, zero) for a, g in zip(_gather(n, parts), gaps)]
    yield s.column_names(k)[2], _sum([*[F.coalesce(p, zero) for p in inner], *spread])


def _sum(items: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, items)


def rolling_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    window: int,
    minimum: int,
    pos: str = "pos",
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Trailing quantiles with the current row left out, linear interpolation.

    The built-in percentile re-sorts the frame for every row; here each block
    (at most ``size + window`` rows) runs through an incremental ordered
    window inside an Arrow batch.
    """
    blocked = with_blocks(df, pos, before=window, size=size)
    schema = StructType([*df.schema.fields, *[StructField(q, DoubleType()) for q in quantiles]])
    names = df.columns

    def trail(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(pos).to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        history = pd.Series(table.column(value).to_numpy(zero_copy_only=False)).shift(1)
        ranked = history.rolling(window, min_periods=minimum)
        out = table.select(names)
        for name, q in quantiles.items():
            out = out.append_column(name, pa.array(ranked.quantile(q), pa.float64(), from_pandas=True))
        keep = ~table.column(COPY).to_numpy(zero_copy_only=False).astype(bool)
        return out.filter(pa.array(keep))

    return blocked.groupBy(*keys, BLOCK).applyInArrow(trail, schema)


def look_ahead(
    df: DataFrame, keys: list[str], value: str, length: int, name: str = "ahead", pos: str = "pos", size: int = BLOCK_ROWS
) -> DataFrame:
    """The next ``length`` values from the current row on, fewer at the end."""
    blocked = with_blocks(df, pos, after=length - 1, size=size)
    frame = block_window(keys, pos).rowsBetween(0, length - 1)
    return drop_copies(blocked.withColumn(name, F.collect_list(value).over(frame)))
