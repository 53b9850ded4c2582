"""Document fingerprints from closed syncmers.

A window of ``K`` code points is selected when the smallest hash among its inner
``S``-point substrings lies at its first or last place.  Whether a window is
selected depends on its own characters alone, so an edit elsewhere leaves it
selected; every ``K - S`` consecutive windows hold at least one selected.  The
selected windows with their places are a document's anchors.

The fingerprint keeps all anchors, so it grows with the text.  Two fingerprints are
matched by position: the likeness is the longest chain of equal anchors whose places
rise in both, over the anchors of both with those of the chain counted once.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tidewatt.llm.common import identified, sha256_text

#: Lengths of the windows and of their inner substrings, in code points.
K, S = 13, 6
#: Characters of fingerprints that a task holds before it hands them on.
_HELD = 8_000_000
#: Chaining goes pair by pair where equal anchors are rarer than this among all pairs, else by bits; both are exact.
_COSTLY = 4_096
_KEPT = 2_048
_WINDOW = K - S + 1  # 8 substrings in a window
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the selected windows.

    A text shorter than ``K`` is one anchor as a whole; an empty one has none.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(c)
    if n < K:
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = 0
        for x in c.tolist():
            h = (h * int(_BASE) + x) & 0xFFFFFFFFFFFFFFFF
        return np.zeros(1, np.int64), _mixed(np.array([h], np.uint64))
    two = c[:-1] * _BASE + c[1:]
    four = two[:-2] * _power(2) + two[2:]
    six = four[:-2] * _power(2) + two[4:]
    inner = _mixed(six)
    low = np.minimum(inner[:-1], inner[1:])
    low = np.minimum(low[:-2], low[2:])
    low = np.minimum(low[:-4], low[4:])
    places = np.flatnonzero((inner[: len(low)] == low) | (inner[_WINDOW - 1 :] == low))
    # A window is its first six, next six and last code point.
    whole = (six[places] * _power(S) + six[places + S]) * _BASE + c[places + K - 1]
    return places, _mixed(whole ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def sketch(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all anchors in the order of their places, and the places."""
    places, hashes = anchors(text)
    return hashes, places


def fingerprint(drawn: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of the hashes' upper halves, then a hex digit for each step from place to place; empty for an empty text."""
    hashes, places = drawn
    if not len(hashes):
        return ""
    # A step is K - S at most.
    steps = np.frombuffer(b"0123456789abcdef", np.uint8)[np.diff(places, prepend=0)]
    return base64.b64encode((hashes >> np.uint64(32)).astype(">u4").tobytes()).decode() + "-" + steps.tobytes().decode()


def _chain(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    x, y = x[np.isin(x, y)], y[np.isin(y, x)]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    ahead = int(differ[0]) if len(differ) else n
    x, y = x[ahead:], y[ahead:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    behind = int(differ[0]) if len(differ) else n
    x, y = x[: len(x) - behind], y[: len(y) - behind]
    if not len(x) or not len(y):
        return ahead + behind
    rare = len(x) > _KEPT and _matches(x, y) * _COSTLY <= len(x) * len(y)
    return ahead + behind + (_by_patience(x, y) if rare else _by_bits(x, y))


def _matches(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs of equal anchors."""
    (hx, nx), (hy, ny) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    return int((nx[i] * ny[j]).sum())


def _by_patience(x: np.ndarray, y: np.ndarray) -> int:
    """The longest rising run of places in x, taken in the order of y: memory grows with the anchors alone."""
    order = np.argsort(x, kind="stable")
    first = np.searchsorted(x[order], y).tolist()
    last = np.searchsorted(x[order], y, "right").tolist()
    places, ends = order.tolist(), []
    for a, b in zip(first, last, strict=True):
        for i in reversed(places[a:b]):  # of equal anchors the later first, so that only one of them joins
            at = bisect.bisect_left(ends, i)
            if at == len(ends):
                ends.append(i)
            else:
                ends[at] = i
    return len(ends)


def _by_bits(x: np.ndarray, y: np.ndarray) -> int:
    """One bit for each anchor of x; a zero marks where the chain grows.

    In a long text only masks of frequent anchors are kept: with over 1 / ``_KEPT`` of the
    places each, they are fewer than ``_KEPT``.  Others are made when they are met.
    """
    at: dict[int, int] = {}
    mask = at.get
    if len(x) <= _KEPT:
        for i, h in enumerate(x.tolist()):
            at[h] = at.get(h, 0) | 1 << i
    else:
        order = np.argsort(x, kind="stable")
        hashes, first, counts = np.unique(x[order], return_index=True, return_counts=True)
        places = {h: order[a : a + n] for h, a, n in zip(hashes.tolist(), first.tolist(), counts.tolist(), strict=True)}

        def mask(h: int, none: int) -> int:
            if h in at or h not in places:
                return at.get(h, none)
            flags = np.zeros(len(x), np.uint8)
            flags[places[h]] = 1
            made = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
            if len(places[h]) * _KEPT > len(x):
                at[h] = made
            return made

    whole = (1 << len(x)) - 1
    row = whole
    for h in y.tolist():
        met = row & mask(h, 0)
        row = ((row + met) | (row - met)) & whole
    return len(x) - row.bit_count()


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; two empty fingerprints are alike."""
    both = len(x[0]) + len(y[0])
    if not both:
        return 1.0
    chain = _chain(x[0], y[0])
    return chain / (both - chain)


def with_next(docs: DataFrame, rows_per_cell: int = 500_000, cells: int = 64) -> DataFrame:
    """Rows of (doc_id, text) dealt to doc_id ranges, each with the first row of the following range.

    ``own`` is false for that borrowed row.  The ranges come from a sketch of the
    ids, so neither a global sort nor a window over one key is needed; the last
    range borrows the first row of all.  Result: partitions sorted by (doc_id, text).
    """
    n = docs.count()
    cells = max(cells, -(-n // rows_per_cell))
    shares = [i / cells for i in range(1, cells)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 100 * cells)).first()[0] or []))
    ids = F.coalesce("doc_id", F.lit(-(1 << 63)))
    edges = np.array(cuts, np.int64)

    @pandas_udf("int")
    def cell(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, i.to_numpy(), "right").astype("int32"))

    placed = docs.withColumn("cell", cell(ids))
    firsts = sorted((r[0], r[1]) for r in placed.groupBy("cell").agg(F.min(ids)).collect())  # one row per range
    used = [c for c, _ in firsts]
    # Rows with the first id of a range also go to the range before it.
    borrow = {low: used[i - 1] for i, (_, low) in enumerate(firsts)}
    before = docs.sparkSession.createDataFrame(list(borrow.items()), "low long, target int") if borrow else None
    if before is None:
        return placed.withColumn("own", F.lit(True))
    own = F.struct(F.lit(True).alias("own"), F.col("cell"))
    copy = F.struct(F.lit(False).alias("own"), F.col("target").alias("cell"))
    homes = F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, copy))
    return (
        placed.join(F.broadcast(before), ids == F.col("low"), "left")
        .select("doc_id", "text", F.explode(homes).alias("home"))
        .select("doc_id", "text", "home.own", "home.cell")
        .repartitionById(max(used) + 1, F.col("cell"))
        .sortWithinPartitions(F.desc("own"), F.asc_nulls_first("doc_id"), "text")
    )


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition: every own row with its follower; the first borrowed row follows the last own row."""
    names = [x.split()[0] for x in _OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held: tuple[int | None, str, tuple] | None = None

    def row(doc: tuple, following: tuple) -> tuple:
        doc_id, text, own = doc
        half = len(text) // 2
        edited = text[: len(text) - half] + following[1][:half]
        new = own if edited == text else sketch(edited)
        return (
            doc_id, len(text), sha256_text(edited), fingerprint(own), fingerprint(new),
            likeness(own, new), likeness(own, following[2]),
        )

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    done = False
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for doc_id, text, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if done:
                break
            doc = (doc_id, text, sketch(text))
            if held is not None:
                rows.append(row(held, doc))
                size += len(rows[-1][3]) + len(rows[-1][4])
                if size >= _HELD:
                    yield handed(rows)
                    rows, size = [], 0
            held, done = doc, not own
    yield handed(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and how like they are.

    The edited text replaces the last floor(n / 2) code points by as many first
    ones of the next document by doc_id (after the last: the first).  A null text
    is empty; null ids come first; rows with equal ids follow one another by text;
    a single row follows itself; other columns are not read.
    """
    rows = with_next(identified(docs))
    return rows.select("doc_id", "text", "own").mapInArrow(_score, _OUT)
