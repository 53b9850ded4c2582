"""Toxicity of texts behind leetspeak, spacing and repetition: noisy-channel decoding, then a lexicon score.

Words that no writer spells plainly (letters mixed with signs or digits, signs alone,
letters set apart, letters repeated three times) become lattices: an observed character
stands for itself, for a letter it imitates, for a separator or for a repeat.  Viterbi
search finds the letters that a character 4-gram model of the corpus and the costs
of the channel like best.  The restored words are then scored like plain ones.

The lexicon holds the words and word beginnings that tell toxic training texts from
others beyond chance; a logistic regression on what a text has of them gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tidewatt.llm.common import id_remainder, identified, slices
from tidewatt.session import durable

#: Labelled rows that the classifier is fitted on at most, by hash of their ids.
TRAIN_ROWS = 20_000
#: Entries of the lexicon at most, by how well they tell.
LEXICON = 4_096
#: Lengths of word beginnings that may enter the lexicon.
BEGINNINGS = (4, 5)
THRESHOLD = 0.7

# Letters that signs and digits imitate.
IMITATED = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h", "€": "e", "£": "l",
    "*": "aeiou",
}
SEPARATORS = " .-_*~'`/\\,"
#: Costs, in nats, of a letter imitated, a separator and a repeat left out.
IMITATION, SEPARATION, REPEAT = 1.0, 0.3, 1.2

#: Symbols of the character model: end of word, a to z, any other letter.
_N = 28
_OTHER = _N - 1
_SPACED = re.compile(r"(?<!\S)(?:\S\s{1,4}){2,}\S(?!\S)")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_EDGE = ".,;:?\"'()[]{}%*#&-_~`/\\=<>"
#: Signs at the edges of a word that stand for its letters; brackets and # there are punctuation.
_MASKING = "*$@+|"
_PUNCTUATION = "".join(c for c in _EDGE if c not in _MASKING)
#: Characters of a decoded word that is remembered, at most; longer ones are decoded each time.
_REMEMBERED = 256


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else _OTHER


def _character_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of four symbols in a row inside words; bounded by the number of such rows."""
    table = np.zeros(0x250, np.int64)
    for i in range(0x250):
        if chr(i).isalpha():
            table[i] = _symbol(chr(i))
    counts = np.zeros(_N**4, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            s = np.concatenate([[0, 0, 0], table[np.minimum(code, 0x24F)], [0]])
            four = ((s[:-3] * _N + s[1:-2]) * _N + s[2:-1]) * _N + s[3:]
            # Of what precedes a word only its end is kept: the symbols before a zero are zeros.
            second, third = s[1:-2], s[2:-1]
            four = np.where(third == 0, s[3:], np.where(second == 0, third * _N + s[3:], four))
            counts += np.bincount(four, minlength=_N**4)
    kept = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(counts[kept])], ["four", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a symbol after three others, smoothed over shorter contexts."""
    rows = docs.select("text").mapInArrow(_character_counts, "four long, n long").groupBy("four").agg(F.sum("n")).collect()
    counts = np.zeros((_N, _N, _N, _N))
    for four, n in rows:  # at most 28 ** 4
        counts[np.unravel_index(four, counts.shape)] = n
    # Nothing follows an end but a beginning; a run of ends says nothing.
    counts[0, 0, 0, 0] = 0
    p = np.full(_N, 1 / _N)
    for kept in (counts.sum((0, 1, 2)), counts.sum((0, 1)), counts.sum(0), counts):
        p = (kept + 2.0 * p) / (kept.sum(-1, keepdims=True) + 2.0)
    return np.log(p).astype(np.float32)


def decode(observed: str, model: np.ndarray) -> str:
    """The most likely plain spelling of a lower-case word, by Viterbi search.

    A spelling is a chain of (what came before, letter), so time and memory grow with the word's length.
    """
    best: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
    for c in observed:
        after: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
        letters = [(c, 0.0)] if c.isalpha() else [(x, IMITATION) for x in IMITATED.get(c, "")]
        skip = SEPARATION if c in SEPARATORS else None if c.isalpha() or c in IMITATED else 4 * IMITATION
        for (x, y, z), (cost, said) in best.items():
            moves = []
            for letter, paid in letters:
                s = _symbol(letter)
                moves.append(((y, z, s), cost + paid - float(model[x, y, z, s]), (said, letter)))
            repeats = said and (c == said[1] or said[1] in IMITATED.get(c, ""))
            left_out = REPEAT if repeats else skip
            if left_out is not None:
                moves.append(((x, y, z), cost + left_out, said))
            for state, new, word in moves:
                if state not in after or new < after[state][0]:
                    after[state] = (new, word)
        best = after or best
    ended = [(cost - float(model[x, y, z, 0]), said) for (x, y, z), (cost, said) in best.items()]
    least = min(cost for cost, _ in ended)
    return min(_spelling(said) for cost, said in ended if cost == least)


def _spelling(said: tuple | None) -> str:
    letters = []
    while said:
        said, letter = said
        letters.append(letter)
    return "".join(reversed(letters))


@dataclass
class Reader:
    """Reads the plain and the restored words of texts; remembers what it decoded."""

    model: np.ndarray
    known: dict[str, str] = field(default_factory=dict)

    def _decoded(self, word: str) -> str:
        if len(word) > _REMEMBERED:
            return decode(word, self.model)
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = decode(word, self.model)
        return self.known[word]

    def words(self, text: str) -> tuple[set[str], dict[str, str]]:
        """Distinct words after restoration, and what was restored to what.

        A token whose edge signs may be letters (``@$$``, ``a$$$``, ``f***``) is decoded whole,
        beside what is left without them; masked by stars it is also a word as it stands, since
        too little may be left to restore.
        """
        text = text.lower()
        tokens = set(text.split())
        plain, odd = set(), set()
        for t in tokens:
            if t.isalpha():
                plain.add(t)
                continue
            whole = t.strip(_PUNCTUATION)
            t = t.strip(_EDGE)
            core = t.rstrip("!$@+|") if len(t) - len(t.rstrip("!$@+|")) >= 3 else t
            if core.isalpha():
                plain.add(core)
            elif core.rstrip("!").isalpha():
                plain.add(core.rstrip("!"))
            elif any(c.isalpha() for c in core) or any(c in "013457@$" for c in core):
                odd.add(core)
            if len(whole) > len(core):
                at = whole.find(core)
                lost = set(whole[:at] + whole[at + len(core) :])
                if not lost.isdisjoint(_MASKING if core else "$@"):
                    odd.add(whole)
                    if core and whole[at + len(core) :].startswith("**"):
                        plain.add(whole)
        odd |= {t.strip(_EDGE) for t in tokens if _REPEATED.search(t)}
        odd |= {" ".join(m[0].split()) for m in _SPACED.finditer(text)}
        restored = {w: self._decoded(w) for w in odd if w}
        return plain | {r for r in restored.values() if r}, restored


@dataclass
class Lexicon:
    """Weights of words and, as (length, letters), of word beginnings."""

    weights: dict[str, float]

    def hits(self, words: set[str]) -> list[float]:
        get = self.weights.get
        found = []
        for w in words:
            x = get(w)
            for n in BEGINNINGS:
                b = get(f"{w[:n]}~") if len(w) >= n else None
                x = b if x is None or b is not None and abs(b) > abs(x) else x
            if x is not None:
                found.append(x)
        return found


def _features(hits: list[float], words: int) -> list[float]:
    up = sorted((h for h in hits if h > 0), reverse=True)
    return [
        float(len(up)), math.log1p(sum(up)), up[0] if up else 0.0, up[1] if len(up) > 1 else 0.0,
        100.0 * len(up) / (words + 20.0), math.log1p(sum(1 for h in hits if h < 0)),
    ]


def _entries(words: set[str]) -> set[str]:
    return words | {f"{w[:n]}~" for w in words for n in BEGINNINGS if len(w) >= n}


def lexicon(rows: DataFrame, model: np.ndarray) -> Lexicon:
    """Log odds of entries of (text, toxic) rows that tell beyond chance, by a likelihood-ratio test.

    The bar rises with the number of entries tested, so that chance finds hardly one.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(_entries(reader.words(text)[0]))
                columns = [pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["entry", "toxic"])

    n_toxic, n_all = rows.agg(F.sum("toxic"), F.count("*")).first()
    if not n_toxic or n_toxic == n_all:
        return Lexicon({})
    n_clean = n_all - n_toxic
    counted = durable(
        rows.select("text", "toxic").mapInArrow(entries, "entry string, toxic int").groupBy("entry")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    )
    bar = 2 * math.log(max(2, counted.count()))

    def part(seen: str, of: int) -> F.Column:
        """Twice the log likelihood ratio's share of the rows with the entry in one class."""
        x = F.col(seen)
        both = F.col("a") + F.col("b")
        return F.when(x > 0, 2 * x * F.log(x * n_all / (both * of))).otherwise(0.0)

    def absent(seen: str, of: int) -> F.Column:
        x = F.lit(of) - F.col(seen)
        both = F.lit(n_all) - F.col("a") - F.col("b")
        return F.when(x > 0, 2 * x * F.log(x * n_all / (both * of))).otherwise(0.0)

    told = part("a", n_toxic) + part("b", n_clean) + absent("a", n_toxic) + absent("b", n_clean)
    weight = F.log((F.col("a") + 0.1) / (n_toxic + 0.2)) - F.log((F.col("b") + 0.1) / (n_clean + 0.2))
    best = counted.select("entry", weight.alias("weight"), told.alias("told")).where(F.col("told") > bar)
    chosen = best.orderBy(F.desc("told"), "entry").limit(LEXICON).collect()
    return Lexicon({r["entry"]: r["weight"] for r in chosen})


def training_rows(docs: DataFrame, labels: DataFrame, modulus: int, held: int) -> DataFrame:
    """(text, toxic) of at most ``TRAIN_ROWS`` labelled ids outside the held-out rows.

    An id with several labels is toxic if one of them is.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(id_remainder(F.col("doc_id"), modulus) != held)
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    return durable(docs.join(F.broadcast(some), "doc_id").select("text", "toxic"))


@dataclass
class Judge:
    """Everything that scoring needs: the character model, the lexicon and the regression."""

    model: np.ndarray
    words: Lexicon
    weights: np.ndarray
    start: float

    def score(self, reader: Reader, text: str) -> tuple[float, dict[str, str]]:
        found, restored = reader.words(text)
        z = self.start + float(np.dot(self.weights, _features(self.words.hits(found), len(found))))
        return (1 / (1 + math.exp(-z)) if z > -700 else 0.0), restored


def fit(texts: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> Judge:
    """Learns characters from the texts outside the held-out rows, and words and weights from the labelled ones there."""
    model = character_model(texts.where(id_remainder(F.col("doc_id"), modulus) != held))
    rows = training_rows(texts, labels, modulus, held)
    words = lexicon(rows, model)
    if not words.weights:
        return Judge(model, words, np.zeros(6), -math.inf)
    sent = texts.sparkSession.sparkContext.broadcast((model, words))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, told = Reader(sent.value[0]), sent.value[1]
        for batch in slices(batches):
            found = [reader.words(t)[0] for t in batch.column(0).to_pylist()]
            values = [_features(told.hits(w), len(w)) for w in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values, pa.list_(pa.float64()))], ["toxic", "x"])

    measured = durable(rows.select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>"))
    points = measured.select(F.col("toxic").cast("double").alias("label"), array_to_vector("x").alias("features"))
    fitted = LogisticRegression(regParam=1e-4, maxIter=100).fit(points)
    return Judge(model, words, fitted.coefficients.toArray(), fitted.intercept)


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """Toxicity of every whole text; labels are read only where crc32 of the id modulo ``modulus`` is not ``held``.

    Columns: doc_id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD``), and
    ``restored``, a map from the words that were decoded to their plain spelling.
    A null text is empty and scored; rows with null ids count as id "" for holding
    out; repeated rows are scored each; without labels of both kinds all scores are 0.
    """
    texts = identified(docs)
    sent = docs.sparkSession.sparkContext.broadcast(fit(texts, labels, modulus, held))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        reader = Reader(judge.model)
        for batch in slices(batches):
            scored = [judge.score(reader, text) for text in batch.column(1).to_pylist()]
            decoded = pa.array([list(r.items()) for _, r in scored], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in scored], pa.float64()), decoded], ["doc_id", "score", "restored"]
            )

    scored = texts.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, restored map<string,string>")
    held_out = id_remainder(F.col("doc_id"), modulus) == held
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "restored"
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``THRESHOLD``, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(identified(docs), labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        reader = Reader(judge.model)
        for batch in slices(batches):
            clean = [judge.score(reader, text or "")[0] < THRESHOLD for text in batch.column(1).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_())).select([0])

    whole = docs.select(F.struct("*").alias("document"), F.col("text").alias("_text"))
    kind = whole.schema["document"].dataType.simpleString()
    return whole.mapInArrow(keep, f"document {kind}").select("document.*")
