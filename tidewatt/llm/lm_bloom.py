"""Language-model scores from a log-frequency Bloom filter of bigram counts.

A bigram with count c is stored at levels 1 to 1 + floor(log2 c); a probe asks level
after level until one is missing, which gives the count's power of two, never too
small.  The filter is cut into slots by bigram hash; slots are built independently
and grow in number with the corpus.  Workers get the filter by broadcast while it is
at most ``BROADCAST_BYTES``; a larger one stays in its slots, and the chunks' probes
travel to the slots and their answers back, with the same scores.

Word counts are exact.  A chunk of documents is coded once: word hashes, counts and
document tokens as numbers into the chunk's sorted hashes.  Only packed hashes and
counts of chunks travel, by slots of the hash range, and come back as totals.  Words
are told apart by 64-bit hashes, bigrams by 40 bits and their slot.

The model interpolates: p(v | u) = (f(u, v) + MU * p(v)) / (c(u) + MU) with
p(v) = (c(v) + 1) / (N + V + 1) and f(u, v) the stored power of two, at most c(u).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewatt.llm.common import id_remainder, identified
from tidewatt.session import durable

#: Tokens in a chunk, and text bytes for each slot: what one task holds.
CHUNK = 1 << 20
SLOT_BYTES = 16 << 20
#: Filter bits for each stored level, and probes for each.
BITS, PROBES = 8, 4
#: The largest filter that is broadcast.
BROADCAST_BYTES = 64 << 20
#: Weight of the word distribution against a context's own count.
MU = 200.0
_LEVELS = 64
_SEED = 42
#: Stand-ins for the end of a document and for what precedes its first token.
_END = np.uint64(0x0123456789ABCDEF)
_START = np.uint64(0xFEDCBA9876543210)
_ENCODED = "chunk long, slot int, place int, doc_id long, held_out boolean, n long, data binary, counts binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bigrams(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of (preceding, own) word hash for every token."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = _START
    return _mixed(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _by_slot(sorted_hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    slots, first = np.unique(_slot(sorted_hashes, bits), return_index=True)
    for s, a, b in zip(slots.tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_hashes)], strict=True):
        yield s, slice(a, b)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: (doc_id, held_out, n) rows, the chunk's sorted word hashes, all tokens as numbers into them, starts."""
    known: dict[bytes, int] = {b"": 0}  # no word is empty: the end of a document
    docs: list[tuple] = []
    tokens: list[np.ndarray] = []
    total = 0

    def flush() -> tuple:
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w, _SEED) for w in known), np.uint64, len(known))
        hashes[0] = _END
        words, rank = np.unique(hashes, return_inverse=True)
        all_tokens = rank[np.concatenate(tokens)].astype(np.int32)
        lengths = np.array([d[2] for d in docs])
        return docs, words, all_tokens, np.concatenate([[0], np.cumsum(lengths)[:-1]])

    for batch in batches:
        for doc_id, text, held in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = text.encode("utf-8", "surrogatepass").lower().split()
            for w in set(words).difference(known):
                known[w] = len(known)
            words.append(b"")
            tokens.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            docs.append((doc_id, held, len(words)))
            total += len(words)
            if total >= CHUNK:
                yield flush()
                known, docs, tokens, total = {b"": 0}, [], [], 0
    if docs:
        yield flush()


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields]
    )


def _encoder(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents as numbers of words (slot null), and each chunk's word hashes with training counts by slot."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for docs, words, tokens, starts in _chunks(batches):
            rows = []
            for i, ((doc_id, held, n), at) in enumerate(zip(docs, starts.tolist(), strict=True)):
                rows.append((chunk, None, i, doc_id, held, n, zlib.compress(tokens[at : at + n].tobytes(), 1), None))
            train = np.repeat([not d[1] for d in docs], [d[2] for d in docs])
            counts = np.bincount(tokens[train], minlength=len(words)).astype(np.int64)
            for s, part in _by_slot(words, bits):
                rows.append((chunk, s, None, None, None, None, words[part].tobytes(), counts[part].tobytes()))
            yield _record(rows, _ENCODED)
            chunk += 1

    return encode


def _bigram_counter(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, words, tokens, starts in _chunks(batches):
            train = np.repeat([not d[1] for d in docs], [d[2] for d in docs])
            hashes, counts = np.unique(_bigrams(words[tokens], starts)[train], return_counts=True)
            rows = []
            for s, part in _by_slot(hashes, bits):
                low = (hashes[part] >> np.uint64(24 - bits)) & np.uint64((1 << 40) - 1)
                five = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                rows.append((s, five.tobytes(), zlib.compress(counts[part].astype("<u4").tobytes(), 1)))
            yield _record(rows, "slot int, data binary, counts binary")

    return count


def _five(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel().astype(np.uint64)


def _places(low: np.ndarray, level: int, size: int | np.ndarray) -> Iterator[np.ndarray]:
    """The filter bits of one level, probe by probe; ``size`` is the filter's, for all or for each."""
    a = _mixed(low + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    b = _mixed(a) | np.uint64(1)
    for i in range(PROBES):
        yield (a + np.uint64(i) * b) % np.asarray(size, np.uint64)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One slot's filter: levels 1 to 1 + floor(log2 count) of every bigram."""
    low = np.concatenate([_five(d) for d in rows["data"]])
    counts = np.concatenate([np.frombuffer(zlib.decompress(c), "<u4") for c in rows["counts"]]).astype(np.int64)
    low, at = np.unique(low, return_inverse=True)
    total = np.zeros(len(low), np.int64)
    np.add.at(total, at, counts)
    levels = np.frexp(total.astype(float))[1]
    size = max(64, int(levels.sum()) * BITS)
    bits = np.zeros(-(-size // 8), np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(low[levels >= level], level, size):
            bit = np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)
            np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), bit)
    slot, stored = int(rows["slot"].iloc[0]), int(levels.sum())
    return pd.DataFrame({"slot": [slot], "size": [size], "stored": [stored], "bits": [bits.tobytes()]})


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    """One slot of the word hashes: every chunk's hashes with the counts over all chunks."""
    parts = [np.frombuffer(d, np.uint64) for d in rows["data"]]
    counts = np.concatenate([np.frombuffer(c, np.int64) for c in rows["counts"]])
    words, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, at, counts)
    ends = np.cumsum([len(p) for p in parts])
    back = [zlib.compress(total[x].tobytes(), 1) for x in np.split(at, ends[:-1])]
    # The slot's share of N and V is said once, in its first row.
    said = [int(total.sum())] + [0] * (len(rows) - 1)
    seen = [int((total > 0).sum())] + [0] * (len(rows) - 1)
    return rows[["chunk", "slot", "data"]].assign(totals=back, tokens=said, distinct=seen)


class _Filter:
    """Slots of the filter, laid one after the other."""

    def __init__(self, slots: list[tuple[int, int, bytes]], bits: int) -> None:
        self.bits = bits
        self.size = np.zeros(1 << bits, np.int64)
        self.offset = np.zeros(1 << bits, np.int64)
        at = 0
        for s, size, data in slots:
            self.size[s], self.offset[s] = size, at
            at += len(data)
        self.data = np.frombuffer(b"".join(d for _, _, d in slots), np.uint8)

    def levels(self, slot: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The highest level found for each bigram; 0 where there is none."""
        level = np.zeros(len(low), np.uint8)
        rows = np.flatnonzero(self.size[slot] > 0)
        low, slot = low[rows], slot[rows]
        size, offset = self.size[slot].astype(np.uint64), self.offset[slot]
        for n in range(1, _LEVELS):
            if not len(rows):
                break
            alive = np.ones(len(rows), bool)
            for place in _places(low, n, size):
                byte = self.data[offset + (place >> np.uint64(3)).astype(np.int64)]
                alive &= (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            rows, low, size, offset = rows[alive], low[alive], size[alive], offset[alive]
            level[rows] = n
        return level


class _Chunk:
    """A chunk's documents as one row of tokens, with the words' hashes and counts over all chunks."""

    def __init__(self, docs: pd.DataFrame, words: pd.DataFrame) -> None:
        words = words.sort_values("slot")
        self.docs = docs.sort_values("place", ignore_index=True)
        self.hashes = np.concatenate([np.frombuffer(d, np.uint64) for d in words["data"]])
        self.count = np.concatenate([np.frombuffer(zlib.decompress(d), np.int64) for d in words["totals"]]).astype(float)
        parts = [np.frombuffer(zlib.decompress(d), np.int32) for d in self.docs["data"]]
        self.token = np.concatenate(parts)
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])

    def bigrams(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Slot and low bits of every token's bigram."""
        hashes = _bigrams(self.hashes[self.token], self.starts)
        return _slot(hashes, bits), (hashes >> np.uint64(24 - bits)) & np.uint64((1 << 40) - 1)

    def scores(self, level: np.ndarray, tokens: int, distinct: int) -> pd.DataFrame:
        c = self.count[self.token]
        single = (c + 1) / (tokens + distinct + 1)
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[self.starts] = self.count[np.searchsorted(self.hashes, _END)]  # as many documents start as end
        seen = np.where(level > 0, np.minimum(2.0 ** (level.astype(float) - 1), before), 0.0)
        return pd.DataFrame({
            "doc_id": self.docs["doc_id"], "held_out": self.docs["held_out"], "n_tokens": self.docs["n"],
            "n_known": np.add.reduceat((c > 0).astype(np.int64), self.starts),
            "base_score": np.add.reduceat(np.log10(single), self.starts),
            "score": np.add.reduceat(np.log10((seen + MU * single) / (before + MU)), self.starts),
        })


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _by_broadcast(texts: DataFrame, words: DataFrame, filters: DataFrame, bits: int, n: tuple[int, int]) -> DataFrame:
    """Every chunk probes the whole filter, at most ``BROADCAST_BYTES``."""
    slots = [(r[0], r[1], bytes(r[2])) for r in filters.select("slot", "size", "bits").collect()]
    sent = texts.sparkSession.sparkContext.broadcast(_Filter(slots, bits))

    def score(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        chunk = _Chunk(docs, known)
        return chunk.scores(sent.value.levels(*chunk.bigrams(bits)), *n)

    return texts.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInPandas(score, _SCORED)


def _by_slot_exchange(texts: DataFrame, words: DataFrame, filters: DataFrame, bits: int, n: tuple[int, int]) -> DataFrame:
    """The chunks' probes go to the filter's slots, and the levels found come back."""
    schema = "chunk long, slot int, data binary"

    def ask(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        slot, low = _Chunk(docs, known).bigrams(bits)
        order = np.argsort(slot, kind="stable")
        asked, first = np.unique(slot[order], return_index=True)
        parts = [p.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for p in np.split(low[order], first[1:])]
        return pd.DataFrame({"chunk": docs["chunk"].iloc[0], "slot": asked, "data": parts})

    def answer(probes: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = _Filter([(int(r.slot), int(r.size_), bytes(r.bits)) for r in held.itertuples()], bits)
        levels = []
        for s, data in zip(probes["slot"].astype(np.int64), probes["data"], strict=True):
            low = _five(data)
            levels.append(zlib.compress(found.levels(np.full(len(low), s), low).tobytes(), 1))
        return probes[["chunk", "slot"]].assign(data=levels)

    def score(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        answers = known[known["totals"].isna()]
        chunk = _Chunk(docs, known[known["totals"].notna()])
        slot, _ = chunk.bigrams(bits)
        level = np.empty(len(slot), np.uint8)
        level[np.argsort(slot, kind="stable")] = np.concatenate(
            [np.frombuffer(zlib.decompress(d), np.uint8) for d in answers.sort_values("slot")["data"]]
        )
        return chunk.scores(level, *n)

    probes = texts.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInPandas(ask, schema)
    held = filters.withColumnRenamed("size", "size_").groupBy("slot")
    levels = durable(probes.groupBy("slot").cogroup(held).applyInPandas(answer, schema))
    both = words.unionByName(levels.withColumn("totals", F.lit(None).cast("binary")))
    return texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInPandas(score, _SCORED)


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """Base and model log10 probability of every whole text.

    Learns from rows whose crc32 of the id modulo ``modulus`` is not ``held``.  A null
    text is empty and has one token, its end; rows with null ids count as id "";
    repeated rows are learnt and answered each; an empty table gives an empty result.
    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    rows = identified(docs)
    rows = rows.select("doc_id", "text", (id_remainder(F.col("doc_id"), modulus) == held).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(3, (size // SLOT_BYTES).bit_length()))

    encoded = durable(rows.mapInArrow(_encoder(bits), _ENCODED))
    words = encoded.where("slot IS NOT NULL").select("chunk", "slot", "data", "counts")
    schema = "chunk long, slot int, data binary, totals binary, tokens long, distinct long"
    words = durable(words.groupBy("slot").applyInPandas(_totals, schema))
    tokens, distinct = (x or 0 for x in words.agg(F.sum("tokens"), F.sum("distinct")).first())

    bigrams = rows.mapInArrow(_bigram_counter(bits), "slot int, data binary, counts binary")
    built = bigrams.groupBy("slot").applyInPandas(_build, "slot int, size long, stored long, bits binary")
    filters = durable(built)

    texts = encoded.where("slot IS NULL").select("chunk", "place", "doc_id", "held_out", "n", "data")
    words = words.select("chunk", "slot", "data", "totals")
    size = filters.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    way = _by_broadcast if size <= BROADCAST_BYTES else _by_slot_exchange
    scored = way(texts, words, filters, bits, (tokens, distinct))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
