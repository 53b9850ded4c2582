"""Personal data by candidate gradient boosting.

Generators propose overlapping spans with high recall: whatever looks like a mail
address (spelt-out signs too), a run of digits, an address of a machine or an account
number.  Spans of the four base kinds, which fixed rules find, teach boosted trees on
features of format and context what such data looks like, as they stand and rewritten
into the other formats (spelt-out signs, long addresses of machines, account numbers,
numbers dialled from abroad or at home).  Counter-examples are malformed proposals:
pieces of true spans, wrong check digits, dates, runs of digits within words.  A
well-formed proposal in another format is not labelled, so nothing teaches that it is
no personal data.  A threshold calibrated on rows kept from the fit selects what is
added to the base spans.
"""

from __future__ import annotations

import ipaddress
import math
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tidewatt.llm.common import identified, slices
from tidewatt.session import durable

KINDS = ("email", "ip", "card", "phone")
#: Documents whose candidates the trees are fitted on, about, and the candidates at most.
TRAIN_DOCS, TRAIN_CANDIDATES = 20_000, 40_000
#: Precision that the threshold must reach on the rows kept from the fit.
PRECISION = 0.99

Span = tuple[str, int, int]

# The base patterns.  A look-behind only saves starts that would fail alike.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Words that stand before personal data.
HINTS = frozenset(
    "mail email e-mail contact phone tel telephone mobile call fax sms ssn passport card visa credit iban account ip host server"
    " address id".split()
)
#: A name or host label, with Latin letters beyond ASCII in hosts.
_LABEL = r"[A-Za-z0-9\u00c0-\u024f-]{1,63}"
_PROPOSED = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:"
        rf" ?(?:@|[\[({{] ?(?:at|AT) ?[\])}}]) ?{_LABEL}(?: ?(?:\.|[\[({{] ?(?:dot|DOT) ?[\])}}]) ?{_LABEL}){{1,4}}"
        rf"| (?:at|AT) {_LABEL}(?: (?:dot|DOT) {_LABEL}){{1,4}})"
    ),
    "ip": re.compile(
        r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}"
        r"|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![0-9A-Fa-f:])"
    ),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){11,20}(?![0-9])|\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3}(?![A-Za-z0-9]))?"),
    "phone": re.compile(r"(?:\+|\b00)?(?:\([0-9]{1,4}\) ?)?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}(?![0-9])"),
}


# Shapes of well-formed proposals that the base patterns leave out, and of dates.
_SPELT = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9\u00c0-\u024f-]+(?:\.[A-Za-z0-9\u00c0-\u024f-]+)*\.[A-Za-z]{2,24}")
_LONG_IP = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")
#: First groups of global, private and link-local addresses; others (``::1``, ``a::b``) name no machine.
_FIRST_GROUP = re.compile(r"[23][0-9A-Fa-f]{3}|[Ff][CcDd][0-9A-Fa-f]{2}|[Ff][Ee][89ABab][0-9A-Fa-f]")
#: Beginnings of card numbers of 15 digits.
_SHORT_CARD = re.compile("3[47]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_DIALLED = re.compile(
    r"00[1-9](?:[ ()./-]{0,2}[0-9])+|(?:\([0-9]{2,4}\) ?|0[1-9][0-9]{0,4}[ /-]?)[0-9]{2,}(?:[ ./-][0-9]{2,})*"
    r"|[2-9][0-9]{2}([ .-])[0-9]{3}\1[0-9]{4}"
)
_DATE = re.compile(r"[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{4}")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban(said: str) -> bool:
    """Whether the check digits of an account number are right."""
    said = said.replace(" ", "")
    return bool(_IBAN.fullmatch(said)) and int("".join(str(int(c, 36)) for c in said[4:] + said[:4])) % 97 == 1


def card_number(digits: str) -> bool:
    """Whether digits have the length, beginning and check digit of a card number."""
    return (16 <= len(digits) <= 19 or len(digits) == 15 and bool(_SHORT_CARD.match(digits))) and luhn(digits)


def long_ip(said: str) -> bool:
    """Whether a span is a version 6 address, in full or with its zeros left out."""
    if "::" not in said:
        return bool(_LONG_IP.fullmatch(said))
    if not _FIRST_GROUP.fullmatch(said.partition(":")[0]):
        return False
    try:
        return ipaddress.IPv6Address(said).version == 6
    except ValueError:
        return False


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the part before a sign is the run of its characters since the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The spans of the base kinds, in the order of kinds and then of starts."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Base spans and all proposals, which may overlap.

    Of a proposal with spaces also its words; of an address that runs over the end of
    a sentence also the part before it; of an account number also the part up to a
    word's end whose check digits are right.  "x at y dot z" in plain words is prose
    unless the name has a sign or digit or the host has further parts.
    """
    found = dict.fromkeys(base)
    if "@" in text or _DIGIT.search(text) or "at" in text or "AT" in text:
        for kind, pattern in _PROPOSED.items():
            for m in pattern.finditer(text):
                name, at, host = m[0].partition(" at ")
                if at and name.isalpha() and host.count(" dot ") < 2:
                    continue  # "look at the dot com boom"
                found[(kind, m.start(), m.end())] = None
                if kind == "email" and (cut := m[0].find(". ")) >= 0:
                    found[(kind, m.start(), m.start() + cut)] = None
                if kind == "card" and m[0][0].isalpha() and not iban(m[0]):
                    ends = [g.start() for g in re.finditer(" ", m[0]) if iban(m[0][: g.start()])]
                    found.update({(kind, m.start(), m.start() + e): None for e in ends})
                for piece in re.finditer(r"[^ ]+", m[0]) if " " in m[0] else ():
                    if len(piece[0]) >= 7:
                        found[(kind, m.start() + piece.start(), m.start() + piece.end())] = None
    return list(found)


_AT = re.compile(r" ?[\[({] ?(?:at|AT) ?[\])}] ?| (?:at|AT) ")
_DOT = re.compile(r" ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) ")


def _said(span: str) -> str:
    """A proposal with its spelt-out signs as signs."""
    return _DOT.sub(".", _AT.sub("@", span))


def well_formed(text: str, span: Span) -> bool:
    """Whether a proposal is whole and valid in a format that the base patterns leave out."""
    kind, a, b = span
    said = _said(text[a:b])
    if text[a - 1 : a].isalnum() or text[b : b + 1].isalnum():
        return False
    if kind == "email":
        return bool(_SPELT.fullmatch(said.replace(" @ ", "@")))
    if kind == "ip":
        return long_ip(said)
    n = len(_DIGIT.findall(said))
    if kind == "card":
        return iban(said) or bool(re.fullmatch("[0-9][0-9 .-]+", said)) and card_number("".join(_DIGIT.findall(said)))
    return 8 <= n <= 17 and text[a - 1 : a] != "+" and bool(_DIALLED.fullmatch(said)) and not _DATE.fullmatch(said)


def _account(digits: str, n: int) -> str:
    """An account number of ``n`` characters with right check digits, made from ``digits``."""
    own = (digits * n)[: n - 4]
    check = 98 - int(own + str(int("D", 36)) + str(int("E", 36)) + "00") % 97
    return f"DE{check:02d}{own}"


def rewritten(kind: str, said: str) -> tuple[list[str], list[str]]:
    """A base span in the other formats of its kind, and malformed lookalikes."""
    digits = "".join(_DIGIT.findall(said))
    if kind == "email":
        name, _, host = said.partition("@")
        if not _SPELT.fullmatch(said) or len(name) > 64 or host.count(".") > 4:
            return [], []
        dots, words = host.replace(".", " [dot] "), host.replace(".", " dot ")
        umlaut = f"{host[0]}\u00fc{host[1:]}"
        forms = [f"{name} [at] {dots}", f"{name}(at){host.replace('.', '(dot)')}", f"{name}[at]{host}", f"{name} @ {host}"]
        forms += [f"{name} at {words}", f"{name} AT {words.replace(' dot ', ' DOT ')}", f"{name}@{umlaut}", f"{name}[at]{umlaut}"]
        return forms, [f"{name}[at]{host}. Then", f"{name} at {words} dot 7"]
    if kind == "ip":
        parts = [int(p[-4:]) for p in said.split(".")]
        groups = [f"{(257 * p + 4099 * i) % 65536:x}" for i, p in enumerate(parts + parts[::-1])]
        short = ["2001", "db8", groups[0], "0", "0", groups[3], groups[4], str(parts[3])]
        left_out = [f"2001:db8::{groups[0]}:{groups[1]}", f"fe80::{groups[2]}:{groups[3]}:{groups[4]}", f"2a02:{groups[5]}:{parts[0]:x}::{parts[3]:x}", f"fd00:{groups[0]}::1"]
        return [":".join(groups), ":".join(groups).upper(), ":".join(short), ":".join(sorted(short)), *left_out], [
            f"a{groups[0][:2]}::b{groups[1][:2]}", f"{parts[0] % 16:x}::{parts[1] % 16:x}", ":".join(groups[:7]), ":".join(groups[:6]), ".".join(str(p + 256) for p in parts), f"{parts[0] + 256}.{'.'.join(map(str, parts[1:]))}"
        ]
    if kind == "card":
        whole = [_account(digits, n) for n in (18, 22, 24, 27)]
        wrong = [w[:-1] + str((int(w[-1]) + 1) % 10) for w in whole]
        spaced = [re.sub("(.{4})(?=.)", r"\1 ", w) for w in (*whole, *wrong)]
        own = f"3{4 if int(digits[-2]) % 2 else 7}{digits[1:13]}"
        short = next(own + str(d) for d in range(10) if luhn(own + str(d)))
        bad = short[:-1] + str((int(short[-1]) + 1) % 10)
        grouped = [f"{c[:4]}{sep}{c[4:10]}{sep}{c[10:]}" for c in (short, bad) for sep in " -"]
        return [*whole, *spaced[:4], re.sub("(.{4})(?=.)", r"\1.", digits), short, *grouped[:2]], [*wrong, *spaced[4:], bad, *grouped[2:]]
    own = digits[-9:].lstrip("0").ljust(9, "7")
    forms = [f"00{digits.lstrip('0')[:13].ljust(8, '5')}", f"00{own[:2]} {own[2:5]} {own[5:]}"]
    forms += [f"0{own[:3]} {own[3:]}", f"0{own[:2]}-{own[2:5]}-{own[5:]}", f"0{own[:4]}/{own[4:]}", f"({own[:3]}) {own[3:6]}-{own[6:]}0", f"0{own}"]
    forms += [f"00{own[:2]} {own[2:4]} {own[4:]}{own[:2]}", f"00{own[:2]} {own[2:5]} {own[5:]}{own[:4]}"]
    forms += ["00" + said[1:], re.sub(r"\A\+[0-9]{1,3}[ .-](?=[1-9])", "0", said)]
    forms += [f"{2 + int(own[0]) % 8}{own[1:3]}{sep}{own[3:6]}{sep}{own[5:]}" for sep in "-. "]
    month, day = 1 + int(own[1]), 10 + int(own[2])
    forms = [f for f in dict.fromkeys(forms) if f[0] != "+"]
    return forms, [f"20{own[3:5]}-{month:02d}-{day}", f"{month:02d}.{day}.20{own[3:5]}", own, f"0.{own}", f"000{own}{own[:4]}"]


def _meets(taken: list[tuple[int, int]], span: Span) -> bool:
    """Whether a span overlaps one of disjoint, ordered (start, end)."""
    before = bisect_left(taken, (span[2],))  # those that start before the span ends
    return before > 0 and taken[before - 1][1] > span[1]


def examples(text: str) -> Iterator[tuple[str, Span, float]]:
    """Labelled (text, span, label): base spans, the same in other formats, and malformed proposals."""
    base = base_spans(text)
    known, taken = set(base), _joined(base)
    for span in candidates(text, base):
        if span in known:
            yield text, span, 1.0
        elif _meets(taken, span) or not well_formed(text, span):
            yield text, span, 0.0
    for kind, a, b in base:
        before, after = text[max(0, a - 60) : a], text[b : b + 60]
        for label, forms in zip((1.0, 0.0), rewritten(kind, text[a:b]), strict=True):
            for form in forms:
                new = before + form + after
                whole = (kind, len(before), len(before) + len(form))
                for span in candidates(new, []):
                    if span == whole:
                        yield new, span, label
                    elif whole[1] < span[2] and span[1] < whole[2] and not well_formed(new, span):
                        yield new, span, 0.0


def _class(c: str) -> float:
    """Kind of a neighbouring character: none, white space, sign, letter or digit."""
    return 0.0 if not c else 1.0 if c.isspace() else 3.0 if c.isalpha() else 4.0 if c.isdigit() else 2.0


def features(text: str, span: Span) -> list[float]:
    """Format of the normalised span and its context."""
    kind, a, b = span
    said = _said(text[a:b])
    digits = _DIGIT.findall(said)
    groups = re.findall("[0-9]+", said)
    words = text[max(0, a - 40) : a].lower().split()
    hint = any(w.strip(":.,;#()") in HINTS for w in words[-2:])
    host = said.rpartition("@")[2] if "@" in said else ""
    end = host.rpartition(".")[2]
    return [
        float(KINDS.index(kind)), float(len(said)), float(len(digits)), float(sum(c.isalpha() for c in said)),
        float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(said.count("@")), float(said.count(".")), float(said.count("-")), float(said.count(" ")), float(said.count(":")),
        float(said.startswith("+")), float("(" in said), float(bool(digits) and luhn("".join(digits))),
        float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(len(end) if end.isalpha() else 0), float(host.count(".")), float(len(set(said))),
        _class(text[a - 1 : a]), _class(text[b : b + 1]), _class(text[max(0, a - 2) : a - 1] if a > 1 else ""),
        float(text[a - 1 : a] == "+"), float(hint),
        float(iban(said)), float(long_ip(said)), float(card_number("".join(digits))), float(bool(_DIALLED.fullmatch(said))), float(bool(_DATE.fullmatch(said))), float(said.startswith("0")),
        float(said.startswith("00")), float(". " in said), float(said.startswith("0.")),
    ]


@dataclass
class Trees:
    """Boosted trees as nested tuples (feature, threshold, left, right) or leaf values, with weights."""

    trees: list
    weights: list[float]
    threshold: float

    def probability(self, x: list[float]) -> float:
        margin = 0.0
        for tree, weight in zip(self.trees, self.weights, strict=True):
            while isinstance(tree, tuple):
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            margin += weight * tree
        return 1 / (1 + math.exp(-2 * margin))


def _nested(node: object) -> tuple | float:
    """A fitted tree's node, read through its public methods."""
    if node.numDescendants() == 0:
        return float(node.prediction())
    split = node.split()
    return (split.featureIndex(), split.threshold(), _nested(node.leftChild()), _nested(node.rightChild()))


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of a text's examples, each with a hash in 0 to 1 of itself."""
    for batch in slices(batches):
        x, y, kept, drawn = [], [], [], []
        for text, keep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for where, span, label in examples(text):
                x.append(features(where, span))
                y.append(label)
                kept.append(keep)
                drawn.append(xxhash.xxh64_intdigest(f"{span}{where}".encode("utf-8", "surrogatepass")) / 2**64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64()), pa.array(kept, pa.bool_()), pa.array(drawn, pa.float64())],
            ["x", "label", "kept", "drawn"],
        )


def fit(texts: DataFrame) -> Trees | None:
    """Trees and threshold from a bounded sample of (doc_id, text); None if it shows one class only.

    The sample is taken by hash of whole rows, and by hash of the examples where they
    are more than ``TRAIN_CANDIDATES``; a quarter of it is kept from the fit
    to calibrate the threshold: the lowest score from which the kept candidates
    above it are base spans with ``PRECISION``.
    """
    n = texts.count()
    share = min(1.0, TRAIN_DOCS / max(1, n))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    some = texts.where(h < math.ceil(share * 1_000_000)).select("text", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("kept"))
    rows = durable(some.mapInArrow(_proposals, "x array<double>, label double, kept boolean, drawn double"))
    rows = rows.where(F.col("drawn") < TRAIN_CANDIDATES / max(1, rows.count()))
    classes = {(r[0], r[1]) for r in rows.groupBy("label", "kept").count().collect()}
    if not {(0.0, False), (1.0, False)} <= classes:
        return None
    train = rows.where("NOT kept").coalesce(4).select("label", array_to_vector("x").alias("features"))
    model = GBTClassifier(maxIter=15, maxDepth=4, maxBins=64, stepSize=0.3, seed=42).fit(train)
    trees = Trees([_nested(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights), 0.5)
    kept = [(trees.probability(list(r[0])), r[1]) for r in rows.where("kept").select("x", "label").collect()]
    trees.threshold = calibrated(kept)
    return trees


def calibrated(scored: list[tuple[float, float]]) -> float:
    """The lowest score, 0.5 at least, from which on the labels reach ``PRECISION``; above 1 if none does."""
    best, right = 1.1, 0.0
    ordered = sorted(scored, reverse=True)
    for i, (p, label) in enumerate(ordered):
        right += label
        last = i + 1 == len(ordered) or ordered[i + 1][0] < p
        if last and p >= 0.5 and right >= PRECISION * (i + 1):
            best = p
    return best


def spans_of(text: str, trees: Trees | None) -> list[Span]:
    """Base spans, and the best-scoring other candidates that overlap nothing chosen; by kind and start."""
    base = base_spans(text)
    if trees is None:
        return base
    known, taken = set(base), _joined(base)
    others = [c for c in candidates(text, base) if c not in known]
    scored = sorted(((-trees.probability(features(text, c)), c[1] - c[2], c) for c in others))
    chosen = list(base)
    for minus, _, (kind, a, b) in scored:
        if -minus >= trees.threshold and not _meets(taken, (kind, a, b)):
            chosen.append((kind, a, b))
            insort(taken, (a, b))
    return sorted(chosen, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined(spans: list[Span]) -> list[tuple[int, int]]:
    """Disjoint (start, end) in order, overlapping spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _finder(sent: object, column: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, every, texts = [], [], []
            for text in batch.column(column).to_pylist():
                text = text or ""
                spans = spans_of(text, sent.value)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in base_spans(text)])
                every.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                texts.append(redacted(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base, _SPANS), pa.array(every, _SPANS), pa.array(texts, pa.string())],
                [*batch.schema.names, "base", "spans", "redacted"],
            )

    return find


_FOUND = "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>, redacted string"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, spans, redacted) for every row; starts and ends in code points.

    A null text is empty; repeated rows and rows with null ids are answered each;
    other columns are not read; an empty table gives an empty result.
    """
    texts = identified(docs)
    sent = docs.sparkSession.sparkContext.broadcast(fit(texts))
    return texts.mapInArrow(_finder(sent, 1), f"doc_id long, text string, {_FOUND}")


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every text redacted (null stays null) and ``n_chars``, where there is one, counted anew."""
    texts = identified(docs)
    sent = docs.sparkSession.sparkContext.broadcast(fit(texts))

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = []
            for text in batch.column(1).to_pylist():
                spans = [] if text is None else spans_of(text, sent.value)
                new.append(redacted(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], ["document", "_text"])

    whole = docs.select(F.struct("*").alias("document"), F.col("text").alias("_text"))
    kind = whole.schema["document"].dataType.simpleString()
    new = whole.mapInArrow(redact, f"document {kind}, _text string")
    columns = [
        F.col("_text").alias(c) if c == "text"
        else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col("document")[c].alias(c)
        for c in docs.columns
    ]
    return new.select(*columns)
