"""Phrase collocations from depth-truncated suffix trees, built in groups of word prefixes.

Texts are cut into pieces at sentence signs and line ends and those into words; a phrase is
2 to 5 words in a row inside one piece.  A phrase can only be frequent if all its words and
neighbouring pairs are, so a suffix (the words from one place on) is cut to 5 words and
before the first rare pair.  Words are counted exactly, pairs by the slot of their hash.
Equal suffixes are counted once a task and once more over the exchange.

The rest is vertical partitioning.  Word prefixes start with two words; a prefix under
which more distinct suffixes lie than the budget is lengthened by a word, down to whole
suffixes.  Prefixes are then put into groups within the budget, each group builds the
subtrees of its prefixes from its sorted suffixes alone, and a node's count is the total
of the leaves below it.  Nodes at or above a prefix may lie in several groups; their
totals are added up.

Which words and pairs are frequent reaches the tasks as a bit table of fixed size
(``SLOTS`` bits, by hash): a shared slot can only keep a suffix longer than needed, and
rare phrases go by their exact counts at the end.

Every language is counted by itself (null: ``und``).  Null and empty texts have no words;
repeated rows count each time; ties follow ``rank``'s order; an empty table gives an empty
result.  Columns other than ``text`` and ``lang`` play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatt.session import attach, durable

#: Words of the longest phrase.
WORDS = 5
MIN_COUNT = 100
#: Distinct suffixes that a group of prefixes may hold; one task holds at most two budgets.
BUDGET = 200_000
#: Bits of the tables of frequent words and pairs (8 MB).
SLOTS = 1 << 26
#: Bytes of text counted at a time, at most one text over it.
CHUNK = 8 << 20
#: Words that a worker numbers at most; then it starts afresh.  Bounds memory only.
REMEMBERED = 1_000_000

_BREAK = b"\xff"  # in no UTF-8 text
_LETTERS = bytes(range(65, 91))
_SIGNS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_LETTERS + _SIGNS + b"\t", _LETTERS.lower() + _BREAK * len(_SIGNS) + b" ")
_COUNTS = "lang string, key string, n long"
#: Slots counted together: their places in a block take two bytes.
_BLOCK = 1 << 16


class _Numbered:
    """Words of one language as numbers, with their hashes."""

    def __init__(self, lang: str, remembered: int) -> None:
        self.remembered = remembered
        self.seed = xxhash.xxh32_intdigest(lang.encode())
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {_BREAK: -1}
        self.words: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)

    def read(self, texts: list[bytes]) -> np.ndarray:
        """The words' numbers, -1 between pieces."""
        if len(self.words) > self.remembered:
            self._clear()
        data = _BREAK.join(texts).translate(_PLAIN).replace(_BREAK, b" \xff ").split()
        new = set(data).difference(self.number)
        if new:
            new = list(new)
            self.number.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
            self.words += new
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in new), np.uint64, len(new))
            self.hashes = np.concatenate([self.hashes, hashes])
        return np.fromiter(map(self.number.__getitem__, data), np.int64, len(data))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


class BitTable:
    """Which hashes are in a set, with shared bits; the same size whatever the set's."""

    def __init__(self, spark: SparkSession, table: bytes) -> None:
        self.shared = spark.sparkContext.broadcast(table)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.shared.value, np.uint8)
        slot = _slots(hashes, 8 * len(table))
        return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


Chunk = Callable[["_Numbered", np.ndarray, str], pa.RecordBatch]


def _by_chunk(docs: DataFrame, found: Chunk, schema: str) -> DataFrame:
    """What ``found`` makes of the words in chunks of texts of one language."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Numbered] = {}

        def chunk(lang: str, texts: list[bytes]) -> pa.RecordBatch:
            numbered = known.setdefault(lang, _Numbered(lang, REMEMBERED))
            return found(numbered, numbered.read(texts), lang)

        for batch in batches:
            waiting: dict[str, list[bytes]] = {}
            held: dict[str, int] = {}
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, text = lang.as_py(), text.as_py().encode()
                waiting.setdefault(lang, []).append(text)
                held[lang] = held.get(lang, 0) + len(text)
                if held[lang] > CHUNK:
                    yield chunk(lang, waiting.pop(lang))
                    held[lang] = 0
            for lang, texts in waiting.items():
                yield chunk(lang, texts)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.where(F.length("text") > 0).mapInArrow(rows, schema)


def _counted(lang: str, keys: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array(n)], ["lang", "key", "n"])


def _added_up(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _words(numbered: _Numbered, ids: np.ndarray, lang: str) -> pa.RecordBatch:
    n = np.bincount(ids[ids >= 0], minlength=len(numbered.words))
    (seen,) = np.nonzero(n)
    return _counted(lang, [numbered.words[i] for i in seen.tolist()], n[seen])


def _word_table(words: DataFrame) -> BitTable:
    """The bit table of ``words`` (lang, key)."""
    slots = SLOTS

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = {x: xxhash.xxh32_intdigest(x.encode()) for x in set(batch.column(0).to_pylist())}
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode(), seeds[x]) for x, w in pairs), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(_slots(hashes, slots) + 1)], ["slot"])

    rows = words.select("lang", "key").mapInArrow(hashed, "slot long")
    rows = rows.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    parts = {r["part"]: bytes(r["bits"]) for r in rows.collect()}  # at most SLOTS / 32,768 rows of 4 KB
    return BitTable(words.sparkSession, b"".join(parts.get(i + 1, bytes(4096)) for i in range(slots >> 15)))


def _frequent_pairs(ids: np.ndarray, numbered: _Numbered, words: BitTable) -> np.ndarray:
    """Whether both words from each place on are in one piece and in the table."""
    fine = np.append(words.has(numbered.hashes), False)[ids]  # -1 is the last
    return np.append(fine[:-1] & fine[1:], False) if len(ids) else fine


def _pair_table(docs: DataFrame, words: BitTable, min_count: int) -> BitTable:
    """The bit table of pairs of frequent words whose slot counts ``min_count`` pairs or more.

    A chunk sends the counts of its slots as two arrays for each block of slots, and each
    block is added up by itself, one such row after the other.
    """
    slots, size = SLOTS, min(SLOTS, _BLOCK)

    def found(numbered: _Numbered, ids: np.ndarray, lang: str) -> pa.RecordBatch:
        (at,) = np.nonzero(_frequent_pairs(ids, numbered, words))
        pairs, n = np.unique(ids[at] << 32 | ids[at + 1], return_counts=True)
        slot = _slots(_pair_hash(numbered.hashes[pairs >> 32], numbered.hashes[pairs & 0xFFFFFFFF]), slots)
        slot, where = np.unique(slot, return_inverse=True)
        n = np.bincount(where, weights=n, minlength=len(slot)).astype(np.uint32)
        blocks, first = np.unique(slot // size, return_index=True)
        inside = np.split((slot % size).astype(np.uint16), first[1:]) if len(blocks) else []
        counts = np.split(n, first[1:]) if len(blocks) else []
        columns = [pa.array(blocks, pa.int64()), *(pa.array([a.tobytes() for a in x], pa.binary()) for x in (inside, counts))]
        return pa.RecordBatch.from_arrays(columns, ["block", "inside", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, np.zeros(size, np.int64)

        def bits() -> pa.RecordBatch:
            packed = np.packbits(sums >= min_count, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed], pa.binary())], ["block", "bits"])

        for batch in batches:
            for at, inside, n in zip(*(batch.column(c) for c in range(3)), strict=True):
                if at.as_py() != block:
                    if block is not None:
                        yield bits()
                    block = at.as_py()
                    sums[:] = 0
                sums[np.frombuffer(inside.as_py(), np.uint16)] += np.frombuffer(n.as_py(), np.uint32)
        if block is not None:
            yield bits()

    rows = _by_chunk(docs, found, "block long, inside binary, n binary")
    summed = rows.repartition("block").sortWithinPartitions("block").mapInArrow(added, "block long, bits binary")
    parts = {r["block"]: bytes(r["bits"]) for r in summed.collect()}  # at most SLOTS / 65,536 rows of 8 KB
    return BitTable(docs.sparkSession, b"".join(parts.get(i, bytes(size // 8)) for i in range(slots // size)))


def _suffixes(words: BitTable, pairs: BitTable, longest: int) -> Chunk:
    def found(numbered: _Numbered, ids: np.ndarray, lang: str) -> pa.RecordBatch:
        joined = _frequent_pairs(ids, numbered, words)
        (at,) = np.nonzero(joined)
        both, where = np.unique(ids[at] << 32 | ids[at + 1], return_inverse=True)
        kept = pairs.has(_pair_hash(numbered.hashes[both >> 32], numbered.hashes[both & 0xFFFFFFFF]))
        joined[at] = kept[where]
        at, code = at[kept[where]], where[kept[where]]
        # Word by word, equal beginnings keep one code; 0 stands after a suffix's end.
        ids = np.append(ids, np.full(longest, -1))
        joined = np.append(joined, np.zeros(longest, bool))
        goes_on, length = np.ones(len(at), bool), np.full(len(at), 2)
        for k in range(2, longest):
            goes_on = goes_on & joined[at + k - 1]
            length += goes_on
            _, code = np.unique(code << 32 | np.where(goes_on, ids[at + k] + 1, 0), return_inverse=True)
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        named, listed = numbered.words, ids.tolist()
        keys = [
            b" ".join([named[j] for j in listed[i : i + size]])
            for i, size in zip(at[first].tolist(), length[first].tolist(), strict=True)
        ]
        return _counted(lang, keys, n)

    return found


def _grouped(suffixes: DataFrame, budget: int, longest: int) -> DataFrame:
    """``suffixes`` with the depth of their prefix and its group."""

    def first_words(n: int) -> Column:
        return F.substring_index("key", " ", n)

    rows = suffixes.select("lang", "key", "n", F.lit(2).alias("depth"), first_words(2).alias("prefix"))
    for depth in range(3, longest + 1):
        sizes = rows.groupBy("lang", "prefix", "depth").agg(F.count(F.lit(1)).alias("rows"))
        heavy = sizes.where((F.col("rows") > budget) & (F.col("depth") == depth - 1)).select("lang", "prefix", F.lit(True).alias("_heavy"))
        if heavy.isEmpty():
            break
        rows = attach(rows, heavy, ["lang", "prefix"])
        longer = F.col("_heavy").isNotNull() & (F.col("depth") == depth - 1)
        rows = rows.select(
            "lang", "key", "n", F.when(longer, depth).otherwise(F.col("depth")).alias("depth"),
            F.when(longer, first_words(depth)).otherwise(F.col("prefix")).alias("prefix"),
        )
    prefixes = durable(rows.groupBy("lang", "prefix").agg(F.count(F.lit(1)).alias("rows")))
    total = prefixes.agg(F.sum("rows")).first()[0] or 0
    groups = max(1, -(-2 * total // budget))
    while True:
        group = F.pmod(F.xxhash64("lang", "prefix"), F.lit(groups))
        fullest = prefixes.groupBy(group).agg(F.sum("rows").alias("rows")).agg(F.max("rows")).first()[0] or 0
        if fullest <= 2 * budget:
            return rows.withColumn("group", group)
        groups *= 2


_NODES = "lang string, phrase string, words int, a long"


def _subtrees(min_count: int) -> Callable[[pa.Table], pa.Table]:
    """Nodes from two words down of a group's subtrees, from its sorted suffixes.

    Nodes below a prefix are whole here and go if they are rare; those from the prefix up
    may go on in other groups.
    """

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("lang", "ascending"), ("key", "ascending")])
        out: list[tuple[str, str, int, int]] = []
        path: list[str] = []  # the words from the root to the last leaf
        totals: list[int] = []  # of the nodes on it
        lang, whole = None, 0  # nodes deeper than ``whole`` are complete here

        def close(depth: int) -> None:
            while len(path) > depth:
                n, size = totals.pop(), len(path)
                if size >= 2 and (n >= min_count or size <= whole):
                    out.append((lang, " ".join(path), size, n))
                path.pop()
                if totals:
                    totals[-1] += n

        for at, key, n, depth in zip(*(rows.column(c).to_pylist() for c in ("lang", "key", "n", "depth")), strict=True):
            words = key.split(" ")
            shared = 0
            if at == lang:
                for a, b in zip(path, words, strict=False):
                    if a != b:
                        break
                    shared += 1
            close(shared)
            lang, whole = at, depth
            for word in words[shared:]:
                path.append(word)
                totals.append(0)
            totals[-1] += n
        close(0)
        columns = zip(*out, strict=True) if out else [[]] * 4
        types = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "phrase", "words", "a"]
        )

    return build


def count_phrases(docs: DataFrame, longest: int = WORDS, min_count: int = MIN_COUNT, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of 1 to ``longest`` words that occur ``min_count`` times, and (lang, n)."""
    words = durable(_added_up(_by_chunk(docs, _words, _COUNTS)))
    totals = durable(words.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = words.where(F.col("n") >= min_count)
    single = frequent.select("lang", F.col("key").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("a"))
    word_bits = _word_table(frequent)
    pair_bits = _pair_table(docs, word_bits, min_count)
    suffixes = durable(_added_up(_by_chunk(docs, _suffixes(word_bits, pair_bits, longest), _COUNTS)))
    dealt = _grouped(suffixes, budget, longest).select("group", "lang", "key", "n", "depth")
    nodes = dealt.groupBy("group").applyInArrow(_subtrees(min_count), _NODES)
    phrases = nodes.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    return durable(single.unionByName(phrases)), totals


def _part(words: Column) -> Column:
    """The first so many words of a phrase, or the last if negative."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), words)


def collocations(
    docs: DataFrame, top: int = 2000, longest: int = WORDS, min_count: int = MIN_COUNT, cover: int = 100, budget: int = BUDGET
) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of count a, cut after its first k words, scores floor(1000 a n / (l r)) with the
    counts l and r of both parts; its lowest cut holds, the smallest k of equal ones.  A
    phrase goes if a longer one around it occurs at least ``cover`` percent as often; one
    word more suffices to look at, as longer phrases are never more frequent.
    """
    phrases, totals = count_phrases(docs, longest, min_count, budget)
    several = phrases.where("words > 1")

    around = several.where("words > 2").select(
        "lang", F.col("a").alias("around"),
        F.explode(F.array(*[_part(F.col("words") - 1), _part(1 - F.col("words"))])).alias("phrase"),
    )
    around = around.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = several.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.col("around") * 100 < F.col("a") * cover, F.lit(True)))

    parts = kept.select(
        "lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", _part(F.col("k")).alias("first"),
        _part(F.col("k") - F.col("words")).alias("rest"),
    )
    for part, count in (("first", "l"), ("rest", "r")):
        parts = parts.join(phrases.select("lang", F.col("phrase").alias(part), F.col("a").alias(count)), ["lang", part])
    big = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    scored = attach(parts, totals, ["lang"]).withColumn(
        "score", F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (big["a"] * F.col("n").cast("decimal(14,0)")), big["l"] * big["r"])
    )
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
