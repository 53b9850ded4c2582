"""The Merkle manifest against a plain tree, for several spans and on awkward tables."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatt.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, idx string, digest string, size string"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _leaf(r, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n_chars, r.text)))


def _levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _way(levels, i):
    for level in levels[:-1]:
        yield (level[i ^ 1] if i ^ 1 < len(level) else ""), i & 1
        i >>= 1


def plain(rows):
    by_lang = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, _leaf(r, r.n_chars))):
        by_lang.setdefault(r.lang, []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: _levels([_leaf(r, r.n_chars) for r in by_lang[x]]) for x in langs}
    crown = _levels([trees[x][-1][0] for x in langs])
    for t, x in enumerate(langs):
        for i, r in enumerate(by_lang[x]):
            way = [*_way(trees[x], i), *_way(crown, t)]
            changed = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            h = _leaf(r, r.n_chars + changed if changed else r.n_chars)
            for s, left in way:
                h = H(s, h) if left else H(h, s)
            root = crown[-1][0]
            yield r.doc_id, _leaf(r, r.n_chars), trees[x][-1][0], root, H(*(s for s, _ in way)), h, h == root


def compare(docs, span):
    got = merkle.proofs(docs, merkle.tampered(), span).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(docs.collect()), key=repr)
    return got


AWKWARD = [
    (1, "a text", "en", "s", 6, 1, "i", "d", "z"),
    (1, "a text", "en", "s", 6, 1, "i", "d", "z"),
    (1, "another text under the same id", "en", "s", 6, 1, "i", "d", "z"),
    (2, "", "en", None, 0, None, None, None, None),
    (3, None, "en", "s", None, 1, "i", "d", "z"),
    (None, "no id", "en", "s", 5, 1, "i", "d", "z"),
    (None, "no id", "en", "s", 5, 1, "i", "d", "z"),
    (4, "no language", None, "s", 11, 1, "i", "d", "z"),
    (5, "empty language", "", "s", 2**63 - 1, 1, "i", "d", "z"),
    (6, "Ünïcödé 😀 1:2-", "é", "-", -3, 1, "i", "d", "z"),
    (7, "x" * 500_000, "zz", "s", 500_000, 1, "i", "d", "z"),
    *[(10 + i, f"text {i}", "de" if i % 3 else "fr", "s", 6, 1, "i", "d", "z") for i in range(30)],
]


@pytest.mark.parametrize("span", [1, 3])
def test_awkward_rows_against_a_plain_tree(spark, span):
    compare(spark.createDataFrame(AWKWARD, SCHEMA).repartition(3), span)


def test_one_language_holds_nearly_all_rows(spark):
    rows = spark.range(700).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 5).alias("text"),
        F.when(F.col("id") % 100 == 7, "fr").otherwise("en").alias("lang"), F.lit("s").alias("source"), F.lit(6).alias("n_chars"),
    )
    got = compare(rows, 3)
    assert 0.05 < sum(not r.verified for r in got) / 700 < 0.25


def test_a_lone_leaf_is_the_root(spark):
    (row,) = compare(spark.createDataFrame(AWKWARD[4:5], SCHEMA), 8)
    assert row.leaf == row.subroot == row.root and row.verified and row.proof_sha256 == H()


def test_no_rows_no_root(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.build(none).root is None and merkle.proofs(none, merkle.tampered()).count() == 0


def test_a_changed_text_is_noticed(spark):
    docs = spark.createDataFrame(AWKWARD[7:20], SCHEMA)
    claimed = merkle.leaf_hash(*[F.lit("other") if f == "text" else F.col(f) for f in merkle.FIELDS])
    assert merkle.proofs(docs, F.when(F.col("doc_id") > 9, claimed)).where("verified").count() == 4


def test_parents_are_linked(spark):
    manifest = merkle.build(spark.createDataFrame(AWKWARD, SCHEMA), span=2)
    above = manifest.nodes.select(*[F.col(c).alias(f"up_{c}") for c in ("tree", "base", "idx")])
    for rows in (manifest.leaves, manifest.nodes):
        assert rows.where("up_tree IS NOT NULL").join(above, ["up_tree", "up_base", "up_idx"], "left_anti").count() == 0
    assert manifest.nodes.where("up_tree IS NULL").select("tree").distinct().collect()[0][0] == merkle.CROWN
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    merkle.climb(manifest)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) == limit
