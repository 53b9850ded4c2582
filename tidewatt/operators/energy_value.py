"""Marginal value of stored energy: the small numeric core of the schedules.

Levels are whole units of ``Battery.lattice``.  The value of holding energy is
kept as its slopes, largest first: ``value[i]`` per unit up to level ``reach[i]``.
One interval back in time adds two choices, charging (worth ``cost``
per unit, up to the charge step) and discharging (``gain`` per unit, up to the
discharge step), which merge into the sorted slopes.

Charging costs at least what discharging earns unless the price is so negative
that doing both would pay.  There the slopes lose their order, and the
interval is solved over every level instead (``_levels_back``), or, for a
battery of many levels, on curves that need not be concave (``_curve_back``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pandas as pd

from tidewatt.settings import Battery

# Two plans whose values differ by less are equal; the smaller move is taken.
TIE = 1e-9
# Batteries of more levels have their values kept as curves where slopes lose their order.
DENSE_LEVELS = 20_000
# Values (levels times windows) that the all-levels form works on at a time.
CELLS = 1 << 16


@lru_cache(maxsize=256)
def _facts(battery: Battery) -> SimpleNamespace:
    unit, up, down, top, start = battery.lattice
    return SimpleNamespace(
        unit=float(unit), up=up, down=down, top=top, start=start, floor=battery.minimum_soc_mwh,
        fee=battery.degradation_cost_per_mwh + battery.transaction_cost_per_mwh,
        ec=battery.charge_efficiency, ed=battery.discharge_efficiency,
    )


def each_battery(items, batteries: pd.DataFrame, solve: Callable) -> list:
    """Apply ``solve`` to the rows of each distinct battery, in row order."""
    out: list = [None] * len(items)
    groups = batteries.groupby(list(batteries.columns), sort=False).indices
    for rows in groups.values():
        battery = Battery(**batteries.iloc[rows[0]].to_dict())
        for i, result in zip(rows, solve(items.iloc[rows], _facts(battery))):
            out[i] = result
    return out


def _prices(p: np.ndarray, b) -> tuple[np.ndarray, np.ndarray]:
    """(cost, gain) per MWh of stored energy."""
    return (p + b.fee) / b.ec, (p - b.fee) * b.ed


def _inserted(value, reach, slope, units):
    """Ordered slopes, a row each, with one more that comes behind all that are as large."""
    ahead = value >= slope
    values, reaches = np.empty((2, len(value) + 1, len(slope)))
    values[0], reaches[0] = slope, units
    np.minimum(value, slope, out=values[1:])
    np.maximum(values[:-1], value, out=values[:-1])
    np.add(reach, units, out=reaches[1:])
    np.copyto(reaches[:-1], reach, where=ahead)
    return values, reaches


def _merge(value, reach, cost, gain, up, down, top):
    """Slopes one interval earlier, for many columns at once; rows that no column needs are left out."""
    for slope, units in ((cost, up), (gain, down)):
        # A missing price comes last.
        value, reach = _inserted(value, reach, np.where(np.isnan(slope), -np.inf, slope), units)
    reach -= up
    np.clip(reach, 0, top, out=reach)
    first = np.count_nonzero(reach.max(1) <= 0)
    last = len(reach) - np.count_nonzero(reach.min(1) >= top) + 1
    return value[first:last], reach[first:last]


def _targets(value, reach, cost, gain):
    """(charge up to, discharge down to) levels given the slopes after the interval."""
    return tuple((reach * more).max(0, initial=0).astype(np.int64) for more in (value > cost, value >= gain))


def _move(level, charge_to, discharge_to, up, down):
    higher = np.minimum(np.maximum(charge_to, level), level + up)
    lower = np.maximum(np.minimum(discharge_to, level), level - down)
    return np.where(level < charge_to, higher, np.where(level > discharge_to, lower, level))


def day_paths(prices: pd.Series, b, enforce_terminal: bool) -> list[np.ndarray]:
    """Stored energy before the first and after every interval of each day."""
    lists = [np.asarray(p, dtype=float) for p in prices]
    out: list = [None] * len(lists)
    alike: dict[tuple, list[int]] = {}
    for i, p in enumerate(lists):
        cost, gain = _prices(p, b)
        if (cost >= gain).all():
            alike.setdefault((len(p), _days, 256), []).append(i)
        elif b.top <= DENSE_LEVELS:
            at_once = max(1, 16 * CELLS // (len(p) * (b.top + 1)))
            alike.setdefault((len(p), _days_over_levels, at_once), []).append(i)
        else:
            out[i] = _day_over_curves(cost, gain, b, enforce_terminal)
    for (_, solve, at_once), rows in alike.items():
        for some in np.array_split(rows, -(-len(rows) // at_once)):
            for i, path in zip(some, solve(np.stack([lists[i] for i in some]), b, enforce_terminal)):
                out[i] = path
    return out


def _days(p: np.ndarray, b, enforce_terminal: bool) -> np.ndarray:
    days, n = p.shape
    cost, gain = _prices(p.T, b)
    if enforce_terminal:
        value = np.tile([[np.inf], [-np.inf]], days)
        reach = np.tile([[b.start], [b.top]], days)
    else:
        value, reach = np.zeros((1, days)), np.full((1, days), b.top)
    up, down = np.full(days, b.up), np.full(days, b.down)
    charge_to, discharge_to = np.empty((2, n, days), dtype=np.int64)
    for t in range(n - 1, -1, -1):
        charge_to[t], discharge_to[t] = _targets(value, reach, cost[t], gain[t])
        value, reach = _merge(value, reach, cost[t], gain[t], up, down, b.top)
    level = np.full(days, b.start)
    path = np.empty((days, n + 1))
    path[:, 0] = level
    for t in range(n):
        level = _move(level, charge_to[t], discharge_to[t], b.up, b.down)
        path[:, t + 1] = level
    return b.floor + path * b.unit


def chunk_moves(prices: pd.Series, committed: pd.Series, b, horizon: int) -> list[tuple]:
    """Per chunk: both targets of every interval and the whole chunk's map."""
    out = []
    for p, n in zip(prices, committed):
        up, down = _look_ahead(np.asarray(p, dtype=float), n, b, horizon)
        if (up < 0).any():
            solve = _map_over_levels if b.top <= DENSE_LEVELS else _map_over_curves
            x, y = solve(np.asarray(p, dtype=float), up, down, b, horizon)
        else:
            x, y = _map_of_targets(up.tolist(), down.tolist(), b)
        out.append((up, down, x, y))
    return out


def _look_ahead(p: np.ndarray, n: int, b, horizon: int):
    """Targets of the first move for ``n`` windows; -1 marks all-levels windows."""
    cost, gain = _prices(p, b)
    rows = np.arange(n)
    value, reach = np.zeros((1, n)), np.full((1, n), b.top)
    unordered = np.zeros(n, dtype=bool)
    for ahead in range(horizon - 1, -1, -1):
        at = rows + ahead
        known = at < len(p)
        at = np.minimum(at, len(p) - 1)
        unordered |= known & (cost[at] < gain[at])
        if ahead == 0:
            up, down = _targets(value, reach, cost[at], gain[at])
        else:
            value, reach = _merge(
                value, reach, cost[at], gain[at], np.where(known, b.up, 0), np.where(known, b.down, 0), b.top
            )
    return np.where(unordered, -1, up), np.where(unordered, -1, down)


def _map_of_targets(up: list[int], down: list[int], b) -> tuple[list[int], list[int]]:
    """Corner points of closing level against opening level, exact in integers."""
    xs, ys = [0, b.top], [0, b.top]
    for c, d in zip(up, down):
        for corner in (c - b.up, c, d, d + b.down):
            for j in range(1, len(ys)):
                if ys[j - 1] < corner < ys[j]:
                    xs.insert(j, xs[j - 1] + corner - ys[j - 1])
                    ys.insert(j, corner)
                    break
        ys = [min(max(c, y), y + b.up) if y < c else max(min(d, y), y - b.down) if y > d else y for y in ys]
        xs, ys = _simplify(xs, ys)
    return xs, ys


def _simplify(xs: list[int], ys: list[int]) -> tuple[list[int], list[int]]:
    """Drop corner points inside a flat or one-for-one run."""
    x, y = [xs[0]], [ys[0]]
    for j in range(1, len(xs)):
        dx, dy = xs[j] - x[-1], ys[j] - y[-1]
        if j + 1 < len(xs) and dy in (0, dx, -dx) and (ys[j + 1] - ys[j]) * dx == dy * (xs[j + 1] - xs[j]):
            continue
        x.append(xs[j])
        y.append(ys[j])
    return x, y


def walk(maps, opening: int) -> list[int]:
    """Level before each of an ordered list of maps."""
    levels = [int(opening)]
    for m in maps:
        levels.append(_at(m["x"], m["y"], levels[-1]))
    return levels[:-1]


def compose(maps) -> tuple[list[int], list[int]]:
    """One map for an ordered list of maps."""
    first, *rest = [(list(map(int, m["x"])), list(map(int, m["y"]))) for m in maps]
    xs, ys = first
    for gx, gy in rest:
        cut_x, cut_y = [xs[0]], [ys[0]]
        for j in range(1, len(xs)):
            # Between neighbouring integers there is no level to refine.
            low, high = sorted((ys[j - 1], ys[j])) if xs[j] - xs[j - 1] > 1 else (0, 0)
            inner = [g for g in gx if low < g < high]
            rising = ys[j] > ys[j - 1]
            for g in inner if rising else reversed(inner):
                cut_x.append(xs[j - 1] + abs(g - ys[j - 1]))
                cut_y.append(g)
            cut_x.append(xs[j])
            cut_y.append(ys[j])
        xs, ys = _simplify(cut_x, [_at(gx, gy, y) for y in cut_y])
    return xs, ys


def _at(xs, ys, level: int) -> int:
    j = int(np.searchsorted(xs, level, side="left"))
    if xs[j] == level:
        return int(ys[j])
    run = int(xs[j]) - int(xs[j - 1])
    return int(ys[j - 1]) + (int(level) - int(xs[j - 1])) * (int(ys[j]) - int(ys[j - 1])) // run


def replay(chunks: pd.DataFrame, b, horizon: int) -> list[np.ndarray]:
    """Stored energy along each chunk from its opening level."""
    out = []
    for up, down, p, level in zip(chunks["up"], chunks["down"], chunks["p"], chunks["s"]):
        level, p = int(level), np.asarray(p, dtype=float)
        path = [level]
        windows = _windows_over_levels(p, np.flatnonzero(up < 0), b, horizon)
        for t, (c, d) in enumerate(zip(up.tolist(), down.tolist())):
            if c < 0:
                if b.top <= DENSE_LEVELS:
                    level = _best_move(*next(windows), level, b)
                else:
                    level = int(_curve_moves(*_curve_after_first(p[t : t + horizon], b), np.array([level]), b)[0])
            elif level < c:
                level = min(c, level + b.up)
            elif level > d:
                level = max(d, level - b.down)
            path.append(level)
        out.append(b.floor + np.array(path) * b.unit)
    return out


# --- all-levels form, for very negative prices ------------------------------


# Values are laid out by level, then by window or day, so that many advance together.


def _best_ahead(v: np.ndarray, reach: int) -> np.ndarray:
    """Maximum of v[i : i + reach + 1] for every i, from ranges of doubled length."""
    n, span, width = len(v), reach + 1, 1
    best = np.concatenate([v, np.full((reach, *v.shape[1:]), -np.inf)])
    while 2 * width <= span:
        best = np.maximum(best[:-width], best[width:])
        width *= 2
    return np.maximum(best[:n], best[span - width : span - width + n])


def _levels_back(v: np.ndarray, cost: np.ndarray, gain: np.ndarray, b) -> np.ndarray:
    """Values one interval earlier, for every level of every column."""
    level = np.arange(b.top + 1)[:, None]
    charge = _best_ahead(v - level * cost, b.up) + level * cost
    discharge = _best_ahead((v - level * gain)[::-1], b.down)[::-1] + level * gain
    return np.maximum(charge, discharge)


def _best_move(v: np.ndarray, cost: float, gain: float, level: int, b) -> int:
    """Level after the interval; ties go to holding, then to the smaller move."""
    rise = np.arange(min(b.up, b.top - level) + 1)
    fall = np.arange(min(b.down, level) + 1)
    gains = np.concatenate([v[level + rise] - rise * cost, v[level - fall] + fall * gain])
    moves = np.concatenate([rise, -fall])
    good = np.flatnonzero(gains >= gains.max() - TIE)
    return level + int(moves[good[np.argmin(np.abs(moves[good]))]])


def _best_moves(v: np.ndarray, cost: np.ndarray, gain: np.ndarray, level: np.ndarray, b) -> np.ndarray:
    """The same for a column of values and a level of its own each."""
    move = np.concatenate([np.arange(b.up + 1), -np.arange(1, b.down + 1)])[:, None]
    goal = level + move
    gains = v[np.clip(goal, 0, b.top), np.arange(len(level))] - move * np.where(move > 0, cost, gain)
    gains[(goal < 0) | (goal > b.top)] = -np.inf
    best = gains.max(0)
    if np.isnan(best).any():
        raise ValueError("a price is missing")
    size = np.where(gains >= best - TIE, 2 * np.abs(move) + (move < 0), np.inf)
    return level + move[size.argmin(0), 0]


def _day_over_levels(cost: np.ndarray, gain: np.ndarray, b, enforce_terminal: bool) -> np.ndarray:
    return _paths_over_levels(cost[:, None], gain[:, None], b, enforce_terminal)[0]


def _days_over_levels(p: np.ndarray, b, enforce_terminal: bool) -> np.ndarray:
    return _paths_over_levels(*_prices(p.T, b), b, enforce_terminal)


def _paths_over_levels(cost: np.ndarray, gain: np.ndarray, b, enforce_terminal: bool) -> np.ndarray:
    """Paths of days (columns) of one length."""
    n, days = cost.shape
    cost, gain = cost * b.unit, gain * b.unit
    v = np.zeros((b.top + 1, days))
    if enforce_terminal:
        v[:] = -np.inf
        v[b.start] = 0.0
    values = [v]
    for t in range(n - 1, 0, -1):
        values.append(_levels_back(values[-1], cost[t], gain[t], b))
    path = [np.full(days, b.start)]
    for t in range(n):
        path.append(_best_moves(values[n - 1 - t], cost[t], gain[t], path[-1], b))
    return b.floor + np.stack(path, axis=1) * b.unit


def _values_after_first(p: np.ndarray, starts: np.ndarray, b, horizon: int):
    """Values of every level after the first interval of the windows at ``starts``, with that interval's cost and gain."""
    cost, gain = (x * b.unit for x in _prices(p, b))
    v = np.zeros((b.top + 1, len(starts)))
    for ahead in range(horizon - 1, 0, -1):
        known = starts + ahead < len(p)
        at = np.minimum(starts + ahead, len(p) - 1)
        v = np.where(known, _levels_back(v, cost[at], gain[at], b), v)
    return v, cost[starts], gain[starts]


def _windows_over_levels(p: np.ndarray, starts: np.ndarray, b, horizon: int):
    """The same window by window, worked out for some of them at a time."""
    at_once = max(1, CELLS // (b.top + 1))
    for first in range(0, len(starts), at_once):
        v, cost, gain = _values_after_first(p, starts[first : first + at_once], b, horizon)
        yield from zip(v.T, cost, gain)


def _first_moves(p: np.ndarray, starts: np.ndarray, b, horizon: int) -> np.ndarray:
    """Level after the first interval of the windows at ``starts``, for every opening level.

    Levels drop out as soon as a move of the current size reaches their best
    value, so all levels advance together, smallest moves first.
    """
    v, cost, gain = _values_after_first(p, starts, b, horizon)
    goal = _levels_back(v, cost, gain, b) - TIE
    after = np.repeat(np.arange(b.top + 1)[:, None], len(starts), axis=1)
    at, of = np.nonzero(v < goal)
    for size in range(1, max(b.up, b.down) + 1):
        if not len(at):
            break
        high, low = at + size, at - size
        rises = (size <= b.up) & (high <= b.top)
        rises &= v[np.minimum(high, b.top), of] - size * cost[of] >= goal[at, of]
        falls = ~rises & (size <= b.down) & (low >= 0)
        falls &= v[np.maximum(low, 0), of] + size * gain[of] >= goal[at, of]
        after[at[rises], of[rises]] = high[rises]
        after[at[falls], of[falls]] = low[falls]
        left = ~(rises | falls)
        at, of = at[left], of[left]
    return after


def _map_over_levels(p: np.ndarray, up: np.ndarray, down: np.ndarray, b, horizon: int):
    level, at_once = np.arange(b.top + 1), max(1, CELLS // (b.top + 1))
    for first in range(0, len(up), at_once):
        some = slice(first, first + at_once)
        moves = _move(np.arange(b.top + 1), up[some, None], down[some, None], b.up, b.down)
        hard = np.flatnonzero(up[some] < 0)
        if len(hard):
            moves[hard] = _first_moves(p, first + hard, b, horizon).T
        # Neighbours become one map until one is left.
        while len(moves) > 1:
            odd = moves[len(moves) // 2 * 2 :]
            moves = np.concatenate([np.take_along_axis(moves[1::2], moves[:-1:2], axis=1), odd])
        level = moves[0][level]
    # Keep both ends of every flat or one-for-one run, so no point between is lost.
    step = np.diff(level)
    inside = np.zeros(b.top + 1, dtype=bool)
    inside[1:-1] = (step[1:] == step[:-1]) & (np.abs(step[1:]) <= 1)
    return np.arange(b.top + 1)[~inside].tolist(), level[~inside].tolist()


# --- curves, for very negative prices and batteries of many levels ----------
#
# A curve is (x, y): levels and values, linear between, nothing outside.  Its
# bends downwards lie at whole levels and stay there, since moves are whole;
# bends upwards come from crossings and may lie between.  A maximum over whole
# levels is therefore the maximum over the line, at a bend or an end.


def _range_max(v: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Maximum of v[first : last + 1] for many ranges; nothing for empty ones."""
    out = np.full(len(first), -np.inf)
    size, width, best = last - first + 1, 1, v
    while True:
        at = (size >= width) & (size < 2 * width)
        out[at] = np.maximum(best[first[at]], best[last[at] - width + 1])
        if 2 * width > len(v):
            return out
        best = np.maximum(best[:-width], best[width:])
        width *= 2


def _crossings(a, b, lines, offsets=(0.0,)) -> np.ndarray:
    """Places strictly between ``a`` and ``b`` where two of ``lines`` (values at a, at b) differ by an offset."""
    found = [np.empty(0)]
    for i, (p0, p1) in enumerate(lines):
        for q0, q1 in lines[:i]:
            known = np.isfinite(p0) & np.isfinite(q0) & np.isfinite(p1) & np.isfinite(q1)
            d0, d1, low, high = p0[known] - q0[known], p1[known] - q1[known], a[known], b[known]
            for offset in offsets:
                meet = (d0 - offset) * (d1 - offset) < 0
                found.append(low[meet] + (high - low)[meet] * (d0 - offset)[meet] / (d0 - d1)[meet])
    return np.concatenate(found)


def _envelope(cuts: np.ndarray, lines: list) -> tuple[np.ndarray, np.ndarray]:
    """Curve of the maximum of lines, each given by its values at both ends of every stretch between ``cuts``."""
    a, b = cuts[:-1], cuts[1:]
    ends = np.full(len(cuts), -np.inf)
    for p0, p1 in lines:
        ends[:-1], ends[1:] = np.maximum(ends[:-1], p0), np.maximum(ends[1:], p1)
    inner = np.setdiff1d(_apart(np.concatenate([cuts, _crossings(a, b, lines)])), cuts)
    at = np.searchsorted(cuts, inner, side="right") - 1
    share = (inner - a[at]) / (b - a)[at]
    top = np.full(len(inner), -np.inf)
    for p0, p1 in lines:
        known = np.isfinite(p0[at]) & np.isfinite(p1[at])
        low, high = p0[at][known], p1[at][known]
        top[known] = np.maximum(top[known], low + share[known] * (high - low))
    x = np.concatenate([cuts, inner])
    order = np.argsort(x)
    return _straightened(x[order], np.concatenate([ends, top])[order])


def _straightened(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same curve without places where it does not bend; never two neighbours at once."""
    while len(x) > 2:
        between = y[:-2] + (y[2:] - y[:-2]) * (x[1:-1] - x[:-2]) / (x[2:] - x[:-2])
        straight = np.flatnonzero(np.abs(y[1:-1] - between) <= 1e-13 * (1 + np.abs(between))) + 1
        if not len(straight):
            break
        # Of a run of straight places every second one goes in a pass.
        place = np.arange(len(straight))
        begins = np.concatenate([[True], np.diff(straight) > 1])
        drop = straight[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
        x, y = np.delete(x, drop), np.delete(y, drop)
    return x, y


def _apart(x: np.ndarray) -> np.ndarray:
    """Ordered places of which none differ by rounding alone; of such, the whole level stays."""
    x = np.unique(x)
    near = np.diff(x) <= 1e-10 + 4 * np.finfo(float).eps * np.abs(x[1:])
    whole = x == np.round(x)
    drop = np.zeros(len(x), dtype=bool)
    drop[1:] |= near & ~whole[1:]
    drop[:-1] |= near & whole[1:] & ~whole[:-1]
    return x[~drop]


def _curve_ahead(x: np.ndarray, y: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Curve of the maximum over [s, s + reach], for s from x[0] - reach to x[-1]."""
    if not reach:
        return x, y
    cuts = _apart(np.concatenate([x, x - reach]))
    a, b = cuts[:-1], cuts[1:]
    inside = _range_max(y, np.searchsorted(x, b, side="left"), np.searchsorted(x, a + reach, side="right") - 1)
    near, far = a >= x[0], b + reach <= x[-1]
    lines = [(np.where(near, np.interp(a, x, y), -np.inf), np.where(near, np.interp(b, x, y), -np.inf)),
             (np.where(far, np.interp(a + reach, x, y), -np.inf), np.where(far, np.interp(b + reach, x, y), -np.inf)),
             (inside, inside)]
    return _envelope(cuts, lines)


def _curve_back(x: np.ndarray, y: np.ndarray, cost: float, gain: float, b) -> tuple[np.ndarray, np.ndarray]:
    """Value one interval earlier."""
    cx, cy = _curve_ahead(x, y - x * cost, b.up)
    dx, dy = _curve_ahead(-x[::-1], (y - x * gain)[::-1], b.down)
    both = [(cx, cy + cx * cost), (-dx[::-1], dy[::-1] - dx[::-1] * gain)]
    cuts = _apart(np.concatenate([cx, -dx, [0.0, b.top]]))
    cuts = cuts[(cuts >= max(0, cx[0])) & (cuts <= min(b.top, -dx[0]))]
    if len(cuts) == 1:
        return cuts, np.max([np.interp(cuts, *curve) for curve in both], axis=0)
    lines = []
    for u, v in both:
        known = (cuts[:-1] >= u[0]) & (cuts[1:] <= u[-1])
        lines.append(tuple(np.where(known, np.interp(end, u, v), -np.inf) for end in (cuts[:-1], cuts[1:])))
    return _envelope(cuts, lines)


def _curve_moves(x, y, cost: float, gain: float, levels: np.ndarray, b) -> np.ndarray:
    """Level after the interval for each of ``levels``; ties go to holding, then to the smaller move."""
    bends = x[x == np.round(x)]
    level = levels.astype(float)[:, None]
    ends = [np.clip(end, x[0], x[-1]) for end in (level, level + b.up, level - b.down)]
    goal = np.concatenate([*ends, np.broadcast_to(bends, (len(level), len(bends)))], axis=1)
    move = goal - level
    gains = np.interp(goal, x, y) - move * np.where(move > 0, cost, gain)
    gains[(move > b.up) | (move < -b.down)] = -np.inf
    size = np.where(gains >= gains.max(1, keepdims=True) - TIE, 2 * np.abs(move) + (move < 0), np.inf)
    return np.take_along_axis(goal, size.argmin(1)[:, None], 1)[:, 0].astype(np.int64)


def _day_over_curves(cost: np.ndarray, gain: np.ndarray, b, enforce_terminal: bool) -> np.ndarray:
    cost, gain = cost * b.unit, gain * b.unit
    ends = [b.start] if enforce_terminal else [0, b.top]
    values = [(np.array(ends, dtype=float), np.zeros(len(ends)))]
    for t in range(len(cost) - 1, 0, -1):
        values.append(_curve_back(*values[-1], cost[t], gain[t], b))
    path = [b.start]
    for t in range(len(cost)):
        path.append(int(_curve_moves(*values[len(cost) - 1 - t], cost[t], gain[t], np.array(path[-1:]), b)[0]))
    return b.floor + np.array(path) * b.unit


def _curve_after_first(p: np.ndarray, b) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Curve of the value after a window's first interval, with that interval's cost and gain."""
    cost, gain = (v * b.unit for v in _prices(p, b))
    x, y = np.array([0.0, b.top]), np.zeros(2)
    for t in range(len(p) - 1, 0, -1):
        x, y = _curve_back(x, y, cost[t], gain[t], b)
    return x, y, cost[0], gain[0]


def _curve_map(x, y, cost: float, gain: float, b) -> tuple[list[int], list[int]]:
    """Level after the first interval for every opening level, as corner points.

    Between places where a bend enters or leaves the reach of a move, the worth of holding,
    of a full move and of the best bend on either side are lines in the opening level; the
    best move changes only where two of them cross or come to a tie.
    """
    cuts = np.unique(np.clip(np.concatenate([x, x - b.up, x + b.down, [0, b.top]]), 0, b.top))
    a, c = cuts[:-1], cuts[1:]
    above = _range_max(y - x * cost, np.searchsorted(x, c, side="left"), np.searchsorted(x, a + b.up, side="right") - 1)
    below = _range_max(y - x * gain, np.searchsorted(x, c - b.down, side="left"), np.searchsorted(x, a, side="right") - 1)
    lines = [tuple(np.interp(end, x, y) for end in (a, c)), (above + a * cost, above + c * cost), (below + a * gain, below + c * gain)]
    for far, paid in ((b.up, -b.up * cost), (-b.down, b.down * gain)):
        known = (a + far >= 0) & (c + far <= b.top)
        lines.append(tuple(np.where(known, np.interp(end + far, x, y) + paid, -np.inf) for end in (a, c)))
    found = np.floor(np.concatenate([cuts, _crossings(a, c, lines, (-TIE, 0.0, TIE))]))
    levels = np.unique(np.clip(np.concatenate([found - 1, found, found + 1]), 0, b.top)).astype(np.int64)
    after = _curve_moves(x, y, cost, gain, levels, b)
    while True:
        run, rise = np.diff(levels), np.diff(after)
        torn = np.flatnonzero((run > 1) & (rise != 0) & (rise != run))
        if not len(torn):
            return _simplify(levels.tolist(), after.tolist())
        middle = levels[torn] + run[torn] // 2
        levels, order = np.unique(np.concatenate([levels, middle]), return_index=True)
        after = np.concatenate([after, _curve_moves(x, y, cost, gain, middle, b)])[order]


def _map_over_curves(p: np.ndarray, up: np.ndarray, down: np.ndarray, b, horizon: int):
    maps = []
    for t in range(len(up)):
        if up[t] < 0:
            corners = _curve_map(*_curve_after_first(p[t : t + horizon], b), b)
        else:
            corners = _map_of_targets([int(up[t])], [int(down[t])], b)
        maps.append({"x": corners[0], "y": corners[1]})
    return compose(maps)
