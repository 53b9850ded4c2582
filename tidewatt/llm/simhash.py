"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within distance 3 meet at a value one bit from the one
and two from the other.  Whoever emits which ball follows from parity: at odd
distance the parities differ, so even fingerprints emit their balls of radius 2
and odd ones of radius 1; at distance 2 the balls of radius 1 meet.  Of any three
bits two lie in the same half, so only flips of two bits in one half are emitted.

All fingerprints that share a value with one at most one bit away from it are
within 3 of that one.  So a shared value yields a star around its nearest
fingerprint instead of all pairs, and no link of the components is lost.

Most fingerprints have no neighbour.  To leave them out, 64 bits are cut into
three blocks; some two of them differ by at most 2 bits in a pair within 3, so
with one block left out the variants within half of that radius, one bit, meet.
Only fingerprints that share such a variant emit the full balls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.llm.common import identified
from tidewatt.llm.components import components, forest
from tidewatt.session import durable

WORDS = 3
SEED = 42
RADIUS = 3
#: Links that a task holds before it contracts them.
_HELD = 500_000


def simhash(text: str, words: int = WORDS) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the shingles' hashes.

    Shingles are runs of ``words`` words, repeats included; fewer words make one
    shingle together and no words give zero.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    else:
        line = b" ".join(tokens)
        ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        h = np.fromiter(
            (digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)),
            np.uint64, len(tokens) - words + 1,
        )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):  # bounds the unpacked bits of a long text
        part = h[at : at + 4096]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprinted(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) per row; written, since every later step reads it."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t, words) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"]
            )

    rows = identified(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return durable(rows.mapInArrow(hashed, "doc_id long, text_hash long, fp long"))


def _flips(pairs: bool) -> np.ndarray:
    one = [1 << i for i in range(64)]
    two = [one[i] | one[j] for half in (range(32), range(32, 64)) for i in half for j in half if i < j]
    return np.array([0, *one, *(two if pairs else [])], np.uint64)


def _keep_masks() -> list[tuple[int, int]]:
    """For each block left out: the bits kept, and a mark in its place."""
    blocks = [range(0, 21), range(21, 42), range(42, 64)]
    whole = (1 << 64) - 1
    return [(whole ^ sum(1 << i for i in b), (k + 1) << b[0]) for k, b in enumerate(blocks)]


def _projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every variant within one bit, with one block left out."""
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 1024):
            some = fps[at : at + 1024, None]
            keys = []
            for keep, mark in _keep_masks():
                flips = np.array([0, *(1 << i for i in range(64) if keep >> i & 1)], np.uint64)
                keys.append(((some & np.uint64(keep)) ^ flips) | np.uint64(mark))
            key = np.concatenate(keys, axis=1)
            fp = np.broadcast_to(some, key.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.ravel().view(np.int64)) for x in (key, np.ascontiguousarray(fp))], ["key", "fp"]
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: fingerprints of keys that another fingerprint has too."""
    last_key = last_fp = None
    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        hit = np.zeros(len(key), bool)
        hit[1:] |= same
        hit[:-1] |= same
        found = [fp[hit]]
        if last_key is not None and last_key == key[0]:
            found.append(np.array([last_fp, fp[0]]))
        last_key, last_fp = key[-1], fp[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["fp"])


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Balls of radius 2 (two flips in one half) around even fingerprints and of radius 1 around odd ones."""
    flips = {False: _flips(True), True: _flips(False)}
    away = {odd: np.minimum(np.arange(len(f)), 1) + (np.arange(len(f)) > 64) for odd, f in flips.items()}
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        odd = np.bitwise_count(fps) % 2 == 1
        for parity in (False, True):
            chosen = fps[odd == parity]
            step = 256 if not parity else 4096
            for at in range(0, len(chosen), step):
                some = chosen[at : at + step, None]
                key = some ^ flips[parity]
                fp = np.ascontiguousarray(np.broadcast_to(some, key.shape))
                far = np.ascontiguousarray(np.broadcast_to(away[parity].astype(np.int8), key.shape))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), pa.array(far.ravel()), pa.array(fp.ravel().view(np.int64))],
                    ["key", "far", "fp"],
                )


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, far, fp): links between each key's first fingerprint, if near, and the others."""
    key0 = hub0 = near0 = None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def links() -> pa.RecordBatch:
        u, v = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], ["u", "v"])

    for batch in batches:
        key, far, fp = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        first = np.concatenate([[True], key[1:] != key[:-1]])
        run = np.cumsum(first) - 1
        hub, near = fp[first].copy(), far[first] <= 1
        if key0 is not None and key0 == key[0]:
            hub[0], near[0] = hub0, near0
        link = near[run] & (hub[run] != fp)
        if link.any():
            assert (np.bitwise_count((hub[run][link] ^ fp[link]).view(np.uint64)) <= RADIUS).all()
            held.append((fp[link], hub[run][link]))
            count += int(link.sum())
        key0, hub0, near0 = key[-1], hub[-1], near[-1]
        if count >= _HELD:
            yield links()
            count = 0
    if held:
        yield links()


def near_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that connect all distinct ``fp`` within distance 3 and no others."""
    met = _sorted(fps.select("fp").mapInArrow(_projected, "key long, fp long"), ["key"])
    some = durable(met.mapInArrow(_shared, "fp long").distinct())
    rows = _sorted(some.mapInArrow(_balls, "key long, far byte, fp long"), ["key", "far", "fp"])
    return rows.mapInArrow(_stars, "u long, v long").distinct()


def _sorted(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions(*order)


def grouped(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every row.

    ``root`` names the group (its smallest signed fingerprint) and ``component_id``
    is its smallest doc_id.  Equal texts have equal fingerprints and so one group;
    a null text is empty; null ids are never the smallest, and a group of null ids
    alone has a null id.  Repeated rows are returned each; an empty table gives none.
    """
    rows = fingerprinted(docs, words)
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(near_links(nodes)).withColumnRenamed("node", "fp")
    nodes = durable(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    lowest = durable(nodes.where("root <> fp").groupBy("root").agg(F.min("low").alias("below")))
    # A root's own id counts too; a group has one row there, so the least of the two is the group's.
    own = nodes.where("root = fp").join(lowest, "root", "left")
    lowest = durable(own.select("root", F.least("low", "below").alias("component_id")))
    of_fp = durable(nodes.join(lowest, "root").select("fp", "root", "component_id"))
    return rows.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def hex16(fp: Column) -> Column:
    """16 lowercase hex digits of a signed 64-bit number's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def without_near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` less all but one of each group: that with the smallest doc_id.

    Of rows with that id in one group the first by text hash stays; a group of null
    ids alone keeps one of them too.
    """
    missing = F.lit(-(1 << 63))
    groups = grouped(docs, words).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = groups.groupBy(F.coalesce("doc_id", missing).alias("_id"), "root").agg(F.min("text_hash").alias("_hash"))
    whole = docs.select(
        F.struct("*").alias("document"),
        F.coalesce(F.col("doc_id").cast("long"), missing).alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
    )
    same = Window.partitionBy("_id", "_hash").orderBy("_id")
    found = whole.join(durable(kept.select("_id", "_hash").distinct()), ["_id", "_hash"])
    return found.withColumn("_n", F.row_number().over(same)).where("_n = 1").select("document.*")
