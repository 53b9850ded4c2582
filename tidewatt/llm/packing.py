"""Bound-certified packing of tokenised documents into sequences of fixed capacity.

Documents are tokenised once and written with their piece lengths.  Packing then
moves only (key, length): groups of pieces are packed by best-fit decreasing, and
dual-feasible functions give a lower bound on the bins a group needs.  A group
that meets its bound is certified and gives away only its emptiest bin (which a
union of groups may save); a group with a gap gives away more, up to half of its pieces.
What is given away is exchanged into half as many groups at most and packed again, until
one group or nothing is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewatt.llm.common import crc32_bytes, identified, slices
from tidewatt.llm.tokens import encoder
from tidewatt.session import durable

CAPACITY = 4096
#: Id that ends every document.
END = 1
#: Pieces in a group: what one task packs at a time.
GROUP = 50_000
#: Bins that a group gives away for each bin above its bound, and for the exchange itself.
GIVEN = 8


def _tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECES = "key long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def tokenised(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of at most ``capacity`` ids, written to the shared folder.

    ``tokenizer`` names the tokenizer file (default: the installed public one) and
    ``ids`` holds little-endian unsigned 32-bit ids.  ``key`` is unique: the number
    of the writing task and a count inside it, fixed once the table is written.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or _tokenizer_file()).encode
        key = TaskContext.get().partitionId() << 36
        end = np.array([END], np.uint32).tobytes()
        names = [x.split()[0] for x in _PIECES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((key, doc_id, i, at // 4, len(part) // 4, crc32_bytes(part), part))
                    key += 1
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return durable(identified(docs).mapInArrow(pieces, _PIECES))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual-feasible functions.

    With threshold e, lengths over C - e count as C and lengths under e as nothing;
    with factor k, a length counts as floor((k + 1) x / C) / k unless that is exact.
    Every packing holds at most C of such counts per bin.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    number, mass = np.cumsum(counts), np.cumsum(counts * x)
    best = -(-int(mass[-1]) // capacity)
    e = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = mass[capacity - e] - mass[e - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 33):
        scaled = (k + 1) * x
        # In units of 1 / (k C), to stay in whole numbers.
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of every piece, and the room left in every bin."""
    room: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    levels = 0  # bit r is set while some bin has room r
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = levels >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                levels &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        left = room[b] = r - n
        if left:
            with_room[left].append(b)
            levels |= 1 << left
    return bins, offsets, room


_PLACED = "key long, length long, group long, bin long, offset long, given boolean"


def _packer(capacity: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "key"], ascending=[False, True], ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        given = np.zeros(len(room), bool)
        if not last:
            gap = len(room) - lower_bound(lengths, capacity)
            emptiest = np.argsort(-np.array(room), kind="stable")
            # Half of the pieces at most, so that the pool shrinks with every round.
            pieces = np.cumsum(np.bincount(bins, minlength=len(room))[emptiest])
            given[emptiest[: 1 + GIVEN * gap][pieces[: 1 + GIVEN * gap] <= len(rows) // 2]] = True
            given &= np.array(room) > 0
        return rows.assign(bin=bins, offset=offsets, given=given[bins])[["key", "length", "group", "bin", "offset", "given"]]

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(key long, sequence_id long, offset long) for every row of ``pieces`` (key long, length long).

    Keys are unique and lengths are from 1 to ``capacity``.  Full pieces take a
    sequence each without being moved; an empty table gives an empty result.
    """
    full = F.col("length") >= capacity
    pool = pieces.select("key", "length").where(~full)
    done = [pieces.where(full).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    n, turn = pool.count(), 0
    while n:
        turn += 1
        groups = -(-n // group)
        dealt = pool.select("key", "length", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(groups)).alias("group"))
        placed = durable(dealt.groupBy("group").applyInPandas(_packer(capacity, groups == 1), _PLACED))
        # Below all numbers of full pieces: turn, group and bin.
        number = -(F.lit(turn << 56) + F.col("group") * (1 << 24) + F.col("bin") + 1)
        done.append(placed.where(~F.col("given")).select("key", number.alias("sequence_id"), "offset"))
        pool = placed.where("given").select("key", "length")
        n = pool.count()
    return reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Every document's pieces with their ids, sequence and place in it.

    A document is its ids and then id 1; a null or empty text is that one id.  Only
    documents longer than ``capacity`` are cut, into pieces of ``capacity`` and a
    last one that may be shorter.  Repeated rows are packed each for itself.
    Columns: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.
    """
    pieces = tokenised(docs, capacity, tokenizer)
    return pieces.join(pack(pieces, capacity), "key").drop("key")
