"""Secret scan through a trigram index, with DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query: alternatives of
trigrams that any match must contain, lower-cased.  Postings (trigram, document)
are built for the trigrams that the rules ask for, an alternative's postings are
intersected by counting, and only documents that satisfy a rule's query are
verified with its expression.  Rules without mandatory trigrams scan all texts.
Spans come from the lengths of the matches and of the pieces between them.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    from re import _constants as ops, _parser as parser

#: Alternatives kept apart while literals are put together; more are given up as "anything".
ALTERNATIVES = 16


@dataclass(frozen=True)
class Rule:
    """Matches whose ``group`` is shorter than ``least`` code points are dropped, without a retry."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The kinds whose spans the contract lists, in its order.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Runs of 16 and more are found alike with and without the shorter ones.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
# Well-known public formats of credentials.
MORE = (
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{20,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,20}://[^\s:/@]{1,200}:[^\s:/@]{1,200}@"),
)


class _Texts:
    """What a part of an expression can match: exact strings, or None for anything, and alternatives of trigrams."""

    def __init__(self, exact: set[str] | None, needed: list[frozenset[str]]) -> None:
        self.exact, self.needed = exact, needed

    def settled(self) -> list[frozenset[str]]:
        """The trigrams needed, with those of the exact strings."""
        if self.exact is None:
            return self.needed
        return _product(self.needed, [frozenset(_trigrams(x)) for x in self.exact])


def _trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def _product(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    return _least([x | y for x in a for y in b])


def _least(alternatives: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without alternatives that a weaker one covers; too many are one that needs nothing."""
    kept = [a for a in dict.fromkeys(alternatives) if not any(b < a for b in alternatives)]
    return kept if len(kept) <= ALTERNATIVES else [frozenset()]


def _part(op: object, value: object) -> _Texts:
    if op is ops.LITERAL:
        return _Texts({chr(value).lower()}, [frozenset()])
    if op is ops.IN and all(o is ops.LITERAL for o, _ in value) and len(value) <= ALTERNATIVES:
        return _Texts({chr(v).lower() for _, v in value}, [frozenset()])
    if op is ops.SUBPATTERN:
        return _sequence(value[-1])
    if op is ops.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(p.exact is not None and p.needed == [frozenset()] for p in parts):
            return _Texts(set().union(*(p.exact for p in parts)), [frozenset()])
        return _Texts(None, _least([a for p in parts for a in p.settled()]))
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        low, high, inner = value
        body = _sequence(inner)
        if (low, high) == (0, 1) and body.exact is not None:
            return _Texts(body.exact | {""}, [frozenset()])
        if low == high == 1:
            return body
        return _Texts(None, body.settled() if low else [frozenset()])
    return _Texts(None, [frozenset()])


def _sequence(parts: object) -> _Texts:
    """Neighbouring exact parts grow together; anything between ends a string and settles its trigrams."""
    needed, exact, open_ended = [frozenset()], {""}, False
    for op, value in parts:
        part = _part(op, value)
        if part.exact is not None and len(exact) * len(part.exact) <= ALTERNATIVES:
            exact = {x + y for x in exact for y in part.exact}
            needed = _product(needed, part.needed)
            continue
        needed = _product(needed, [frozenset(_trigrams(x)) for x in exact])
        if part.exact is not None:
            exact = part.exact
        else:
            needed, exact = _product(needed, part.needed), {""}
        open_ended = True
    if open_ended:
        return _Texts(None, _product(needed, [frozenset(_trigrams(x)) for x in exact]))
    return _Texts(exact, needed)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives; a matching text contains, lower-cased, all trigrams of one.  Empty: the rule needs a full scan."""
    alternatives = _least(_sequence(parser.parse(pattern)).settled())
    return [] if frozenset() in alternatives else alternatives


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key) for each of ``trigrams`` that the lower-cased text of a row (key, text) contains."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    # The lambda's variable holds the lower-cased text, so that it is made once a row.
    lower = F.array(F.lower("text"))
    found = F.transform(lower, lambda t: F.filter(wanted, lambda g: F.contains(t, g)))[0]
    return texts.select("key", F.explode(found).alias("trigram"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the rules whose trigram query a text satisfies; texts that satisfy none are absent."""
    wanted = [
        (rule.kind, number, len(alternative), trigram)
        for rule in rules
        for number, alternative in enumerate(trigram_query(rule.pattern))
        for trigram in sorted(alternative)
    ]
    schema = "kind string, alternative int, needed int, trigram string"
    terms = texts.sparkSession.createDataFrame(wanted, schema)  # as many rows as the rules have trigrams
    met = postings(texts, sorted({w[3] for w in wanted})).join(F.broadcast(terms), "trigram")
    hits = met.groupBy("key", "kind", "alternative", "needed").agg(F.count_distinct("trigram").alias("n"))
    return hits.where("n = needed").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def matches(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, order, end, kind) of one rule, leftmost and without overlap, in code points."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    lengths = F.arrays_zip(
        F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)), F.length).alias("gap"),
        F.transform(whole, F.length).alias("len"),
        F.transform(measured, F.length).alias("size"),
    )

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        span = F.struct(
            start.alias("start"), F.lit(order).alias("order"), (start + x["len"]).alias("end"), F.lit(rule.kind).alias("kind")
        )
        kept = F.when(x["size"] >= rule.least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct((start + x["len"]).alias("at"), kept.alias("spans"))

    kind = "array<struct<start:int,order:int,end:int,kind:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
    return F.aggregate(lengths, zero, step, lambda done: done["spans"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, spans) for every row: spans (start, order, end, kind) of all rules, by start and then by rule.

    A null text is empty and has no spans; repeated rows and rows with null ids are
    answered each; other columns are not read; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    indexed = {r.kind for r in rules if trigram_query(r.pattern)}
    found = texts.join(candidates(texts, rules), "key", "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    spans = [
        matches(F.col("text"), rule, i)
        if rule.kind not in indexed
        else F.when(F.array_contains("kinds", rule.kind), matches(F.col("text"), rule, i)).otherwise(none)
        for i, rule in enumerate(rules)
    ]
    return found.select("doc_id", F.sort_array(F.concat(*spans)).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
