"""Schedules against exhaustive search on a coarse battery."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from tidewatt.operators import energy_value as ev
from tidewatt.settings import Battery

# Steps of 3 and 4 units, ten units of range, start at level 4.
COARSE = Battery(
    "coarse", capacity_mwh=20, minimum_soc_mwh=10, initial_soc_mwh=14, max_charge_mw=6, max_discharge_mw=2,
    charge_efficiency=0.5, discharge_efficiency=0.5, interval_hours=1.0,
)
B = ev._facts(COARSE)


def exhaustive(p, terminal):
    cost, gain = ev._prices(p, B)
    best = {B.start: 0.0}
    for c, g in zip(cost, gain):
        nxt = {}
        for level, v in best.items():
            for m in range(max(0, level - B.down), min(B.top, level + B.up) + 1):
                move = m - level
                worth = v - move * c if move > 0 else v - move * g
                nxt[m] = max(nxt.get(m, -1e18), worth)
        best = nxt
    return best[B.start] if terminal else max(best.values())


def worth(path, p):
    cost, gain = ev._prices(p, B)
    return sum(-d * (c if d > 0 else g) for d, c, g in zip(np.diff(path), cost, gain))


def test_units_of_the_default_battery():
    unit, *sizes = Battery().lattice
    assert (unit.numerator, unit.denominator) == (5, 304)
    assert sizes == [361, 400, 5472, 2432]


@pytest.mark.parametrize("terminal", [True, False])
@pytest.mark.parametrize("lowest", [-2.0, -40.0])
def test_day_equals_exhaustive_search(terminal, lowest):
    rng = np.random.default_rng(7)
    for _ in range(60):
        p = rng.uniform(lowest, 60, rng.integers(1, 9)).round(1)
        path = ev.day_paths(pd.Series([p]), B, terminal)[0]
        assert worth(path, p) == pytest.approx(exhaustive(p, terminal), abs=1e-7)
        assert path.min() >= 10 - 1e-9 and path.max() <= 20 + 1e-9
        if terminal:
            assert path[-1] == pytest.approx(14)


@pytest.mark.parametrize("lowest", [0.0, -40.0])
def test_chunks_equal_step_by_step_replanning(lowest):
    rng = np.random.default_rng(3)
    horizon = 4
    for _ in range(40):
        n = int(rng.integers(5, 40))
        p = rng.uniform(lowest, 60, n).round(1)
        level, expected = B.start, [B.start]
        for t in range(n):
            start = SimpleNamespace(**{**vars(B), "start": level})
            step = ev.day_paths(pd.Series([p[t : t + horizon]]), start, False)[0][1]
            level = round((step - B.floor) / B.unit)
            expected.append(level)
        chunks = []
        for s in range(0, n, 7):
            k, part = min(7, n - s), p[s : s + 7 + horizon - 1]
            chunks.append((*ev.chunk_moves(pd.Series([part]), pd.Series([k]), B, horizon)[0], part))
        maps = [{"x": c[2], "y": c[3]} for c in chunks]
        got = []
        for (up, down, _, _, part), opening in zip(chunks, ev.walk(maps, B.start)):
            rows = pd.DataFrame({"up": [up], "down": [down], "p": [part], "s": [opening]})
            path = ev.replay(rows, B, horizon)[0]
            got += [round((x - B.floor) / B.unit) for x in path[:-1]]
            last = round((path[-1] - B.floor) / B.unit)
        assert [*got, last] == expected
        x, y = ev.compose(maps)
        for opening in range(B.top + 1):
            level = opening
            for m in maps:
                level = ev._at(m["x"], m["y"], level)
            assert ev._at(x, y, opening) == level


def test_equal_prices_mean_no_trade():
    path = ev.day_paths(pd.Series([np.full(24, 30.0)]), ev._facts(Battery()), True)[0]
    assert (path == 50.0).all()


@pytest.mark.parametrize("terminal", [True, False])
def test_curves_equal_all_levels_and_exhaustive_search(terminal, monkeypatch):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(ev, "DENSE_LEVELS", 0)
    for k in range(80):
        p = rng.uniform(-60, 30, rng.integers(1, 9)).round(0 if k % 2 else 1)
        path = ev.day_paths(pd.Series([p]), B, terminal)[0]
        assert worth(path, p) == pytest.approx(exhaustive(p, terminal), abs=1e-7)
        if (np.greater(*ev._prices(p, B)[::-1])).any():
            assert path == pytest.approx(ev._day_over_levels(*ev._prices(p, B), B, terminal))


@pytest.mark.parametrize("battery", [COARSE, Battery()])
def test_maps_of_curves_equal_maps_of_levels(battery, monkeypatch):
    rng = np.random.default_rng(5)
    b = ev._facts(battery)
    for k in range(12):
        p = rng.uniform(-80, 30, 12).round(k % 2)
        x, y = ev._map_over_levels(p, *(np.full(6, -1),) * 2, b, 6)
        cx, cy = ev._map_over_curves(p, *(np.full(6, -1),) * 2, b, 6)
        assert [ev._at(cx, cy, s) for s in range(b.top + 1)] == [ev._at(x, y, s) for s in range(b.top + 1)]


def test_a_battery_of_ten_million_levels_at_very_negative_prices():
    fine = Battery("fine", capacity_mwh=100.00001, max_charge_mw=25.0004, charge_efficiency=0.8, discharge_efficiency=0.8)
    b, near = ev._facts(fine), ev._facts(Battery("near", charge_efficiency=0.8, discharge_efficiency=0.8))
    assert b.top > 5_000_000
    rng = np.random.default_rng(2)
    p = rng.uniform(-250, 60, 96).round(2)

    def earned(facts):
        path = ev.day_paths(pd.Series([p]), facts, True)[0]
        cost, gain = ev._prices(p, facts)
        assert path[-1] == pytest.approx(50) and path.min() > 10 - 1e-6 and path.max() < 100.0001
        return sum(-d * (c if d > 0 else g) for d, c, g in zip(np.diff(path), cost, gain))

    assert earned(b) == pytest.approx(earned(near), rel=1e-3)
    up, down, x, y = ev.chunk_moves(pd.Series([p]), pd.Series([40]), b, 8)[0]
    assert (up < 0).any()
    for opening in (0, b.start, b.top, 1_234_567):
        walked = ev.replay(pd.DataFrame({"up": [up], "down": [down], "p": [p], "s": [opening]}), b, 8)[0]
        assert walked[-1] == pytest.approx(b.floor + ev._at(x, y, opening) * b.unit)


def counted(monkeypatch):
    calls, plain = [], ev._levels_back
    monkeypatch.setattr(ev, "_levels_back", lambda *args: calls.append(1) or plain(*args))
    return calls


def test_windows_at_very_negative_prices_are_solved_together(monkeypatch):
    rng = np.random.default_rng(13)
    p = rng.uniform(-60, 60, 80).round(1)
    calls = counted(monkeypatch)
    up, down, x, y = ev.chunk_moves(pd.Series([p]), pd.Series([72]), B, 9)[0]
    assert (up < 0).sum() > 40 and len(calls) <= 9
    calls.clear()
    path = ev.replay(pd.DataFrame({"up": [up], "down": [down], "p": [p], "s": [B.start]}), B, 9)[0]
    assert len(calls) <= 8
    # Each window on its own leads to the same level, and so does the map of the chunk.
    level = B.start
    for t in range(72):
        start = SimpleNamespace(**{**vars(B), "start": level})
        level = round((ev.day_paths(pd.Series([p[t : t + 9]]), start, False)[0][1] - B.floor) / B.unit)
        assert path[t + 1] == B.floor + level * B.unit
    assert ev._at(x, y, B.start) == level


def test_days_at_very_negative_prices_are_solved_together(monkeypatch):
    rng = np.random.default_rng(17)
    days = [rng.uniform(-60, 30, 6).round(1) for _ in range(50)]
    calls = counted(monkeypatch)
    paths = ev.day_paths(pd.Series(days), B, True)
    assert len(calls) <= 5
    for p, path in zip(days, paths):
        assert worth(path, p) == pytest.approx(exhaustive(p, True), abs=1e-7)


def test_a_missing_price_is_refused():
    with pytest.raises(ValueError):
        ev.day_paths(pd.Series([np.array([-50.0, np.nan, 3.0])]), B, True)
