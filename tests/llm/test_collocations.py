"""Phrase collocations against plain counting, with small budgets, shared bits and awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from tidewatt.llm import collocations

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, key string, n int, hash string"


def _phrases(rows, longest):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return n, f


def plain(rows, top, longest, least, cover):
    n, f = _phrases(rows, longest)
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            around = (
                b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            )
            if any(100 * b >= cover * a for b in around):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, n[lang], -score


def _drawn(count, seed):
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(40)] + ["Ünï", "É", "é", "x\x01", "x", "\x00", "a b", "😀"]
    fixed = ["once upon a time there was", "w1 w2 w3 w4 w5 w6", "x x x x x x x", "x\x01 x"]
    for i in range(count):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else draw.choice(names[: draw.randint(1, 48)]) for _ in range(draw.randint(0, 60))]
        text = "".join(p + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ";", "!"]) for p in parts)
        yield text, draw.choice(["en", "en", "en", "de", None, "und", ""])


def run(spark, rows, **kw):
    table = spark.createDataFrame([(i, t, x, "k", 1, "h") for i, (t, x) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(map(tuple, collocations.collocations(table, **kw).collect()))


@pytest.mark.parametrize("budget,slots,cover", [(200_000, 1 << 26, 100), (20, 1 << 15, 80)])
def test_phrases_against_plain_counting(spark, monkeypatch, budget, slots, cover):
    monkeypatch.setattr(collocations, "SLOTS", slots)
    monkeypatch.setattr(collocations, "CHUNK", 3_000 if budget == 20 else 8 << 20)
    monkeypatch.setattr(collocations, "REMEMBERED", 10 if budget == 20 else 1_000_000)
    rows = [*_drawn(300, 7), ("", "en"), (None, "en"), (None, None), (" \t\n.;", "fr"), ("a b " * 20_000, "de"), *[("Same WORDS here", "en")] * 30]
    got = run(spark, rows, top=150, min_count=8, cover=cover, budget=budget)
    assert got == sorted(plain(rows, 150, 5, 8, cover)) and {r[0] for r in got} >= {"en", "de", "und", ""}


def test_groups_hold_their_budget_and_whole_prefixes(spark):
    rows = [("L", f"a b {i % 7} {i % 31} {i} ".strip(), 1) for i in range(400)] + [("L", f"c{i} d", 2) for i in range(50)]
    table = spark.createDataFrame(rows, "lang string, key string, n long")
    grouped = collocations._grouped(table, 30, 5).collect()
    assert len(grouped) == 450 and max(Counter(r.group for r in grouped).values()) <= 60
    groups = defaultdict(set)
    for r in grouped:
        groups[r.prefix].add(r.group)
        assert r.key.startswith(r.prefix) and r.depth == len(r.prefix.split(" "))
    assert all(len(g) == 1 for g in groups.values())
    assert {r.depth for r in grouped} == {2, 4} or {r.depth for r in grouped} == {2, 3, 4}


def test_counts_past_64_bits(spark):
    table = spark.sql("SELECT 1 x").select()
    a = 9_000_000_000_000
    big = F.lit(a).cast("decimal(19,0)")
    top = F.lit(1000).cast("decimal(4,0)") * (big * F.lit(20_000_000_000_001).cast("decimal(14,0)"))
    got = table.select(F.call_function("div", top, big * F.lit(7).cast("decimal(19,0)"))).first()[0]
    assert got == 1000 * a * 20_000_000_000_001 // (a * 7)


def test_no_rows_no_phrases(spark):
    assert run(spark, []) == [] and run(spark, [(None, "en"), ("", None)]) == []
