"""Merkle manifest of a document table, and proofs that climb it by a recursive query.

Every row is a leaf.  The leaves of one language form a tree in ascending ``doc_id``; the
languages' roots, in order of language, form the tree above them, whose root stands for the
table.  A level takes every two consecutive nodes into the SHA-256 of their hexadecimal
texts; a last node without a partner goes up by itself, hashed alone.

``build`` numbers the leaves over range partitions, so that one language may hold most of
the table, and then hashes blocks of ``2 ** span`` consecutive nodes at a time: a block is
bounded, and its levels need no exchange between them.  Every stored node row names its
parent row, the block's top, and carries the siblings that lie on the way there.

``climb`` is a recursive SQL query over those rows: it starts at each leaf with the hash
claimed for it, and each step follows the parent link, appends the siblings passed and
folds them into the hash, across the language's root up to the table's.  With ``span`` 1 a
step is one level; larger spans give the same rows with fewer exchanges of all leaves
(about log2(rows) / span).

Nulls: each field is hashed as ``-``; a null language is a tree of its own, before all
others; null ids come first in their tree.  Rows equal in language, id and all fields are
separate leaves whose order makes no difference, as their hashes are equal; rows equal only
in language and id are ordered by their hash.  An empty table has no leaves and no root
(null).  Columns other than the five of ``FIELDS`` play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewatt.operators.positions import number_rows
from tidewatt.session import attach, durable

#: The columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one block of nodes spans; 2 ** SPAN hashes are the most that one row holds.
SPAN = 8
#: Number of the tree above all language trees.
CROWN = -1


@dataclass
class Manifest:
    #: doc_id, tree, claimed, and as in ``nodes``: one row a leaf.
    leaves: DataFrame
    #: tree, base, idx, digest, path, up_tree, up_base, up_idx: all nodes above the leaves at which a block ends.
    nodes: DataFrame
    #: lang, tree, size, subroot
    trees: DataFrame
    root: str | None


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_hash(*fields: Column) -> Column:
    """Hash of the fields: each as its UTF-8 length, a colon and its value, or a dash for null."""
    texts = [f.cast("string") for f in fields]
    parts = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return _hash(F.concat(*[F.coalesce(p, F.lit("-")) for p in parts]))


def _parents(level: Column) -> Column:
    """The level above an array of hexadecimal hashes."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: _hash(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit("")))))


def _height(size: Column) -> Column:
    """Levels above ``size`` leaves."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _blocks(rows: DataFrame, base: int, span: int, payload: list[str]) -> DataFrame:
    """One written row for each block of ``2 ** span`` nodes at level ``base``: its member rows and its top.

    ``rows`` has tree, idx, size (leaves of the tree), digest and the payload columns.
    """
    member = F.struct("idx", "digest", *payload)
    out = (
        rows.groupBy("tree", "size", F.shiftright("idx", span).alias("block"))
        .agg(F.sort_array(F.collect_list(member)).alias("members"))
        .withColumn("ups", F.least(F.lit(span), _height(F.col("size")) - base))
        .withColumn("l0", F.transform("members", lambda m: _hex(m["digest"])))
    )
    for k in range(span):
        out = out.withColumn(f"l{k + 1}", F.when(F.col("ups") > k, _parents(F.col(f"l{k}"))))
    levels = [F.col(f"l{k}") for k in range(span + 1)]
    # The top is the only hash of the last level that was built.
    top = F.get(F.coalesce(*reversed(levels)), F.lit(0))

    def with_path(m: Column, i: Column) -> Column:
        on_the_way = [
            F.when(F.col("ups") > k, F.coalesce(F.unhex(F.get(levels[k], F.shiftright(i, k).bitwiseXOR(F.lit(1)))), F.lit(b"")))
            for k in range(span)
        ]
        path = F.filter(F.array(*on_the_way), lambda s: s.isNotNull())
        return F.struct(m["idx"].alias("idx"), m["digest"].alias("digest"), path.alias("path"), *[m[c].alias(c) for c in payload])

    return durable(
        out.select("tree", "size", "block", F.transform("members", with_path).alias("members"), F.unhex(top).alias("top"))
    )


def _linked(blocks: DataFrame, base: int, span: int, payload: list[str]) -> DataFrame:
    """Member rows with the link to their parent row: the block's top, or what stands above the whole tree."""
    inside = _height(F.col("size")) > base + span
    crown = F.col("tree") == CROWN
    above = {
        "up_tree": F.when(inside, F.col("tree")).when(~crown, F.lit(CROWN).cast("long")),
        "up_base": F.when(inside, F.lit(base + span)).when(~crown, F.lit(0)),
        "up_idx": F.when(inside, F.col("block")).when(~crown, F.col("tree")),
    }
    rows = blocks.select("tree", "size", "block", F.explode("members").alias("m"))
    return rows.select(
        "tree", F.lit(base).alias("base"), "m.idx", "m.digest", "m.path", *[c.alias(n) for n, c in above.items()],
        *[F.col(f"m.{c}") for c in payload],
    )


def _grow(rows: DataFrame, tallest: int, span: int, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Member rows of every round of blocks, and (tree, digest) of the trees' roots."""
    linked, tops = [], []
    for base in range(0, max(tallest, 1), span):
        carried = payload if base == 0 else []
        blocks = _blocks(rows, base, span, carried)
        linked.append(_linked(blocks, base, span, carried))
        done = _height(F.col("size")) <= base + span
        rows = blocks.select("tree", "size", F.col("block").alias("idx"), F.col("top").alias("digest"))
        tops.append(rows.where(done).select("tree", "digest"))
        rows = rows.where(~done)
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return linked, roots


def _tallest(size: int | None) -> int:
    return (max(size or 1, 1) - 1).bit_length()


def build(docs: DataFrame, claimed: Column | None = None, span: int = SPAN) -> Manifest:
    """The manifest of ``docs``; ``claimed`` is the leaf hash to be proved for each row, its own if left out or null."""
    own = leaf_hash(*[F.col(f) for f in FIELDS])
    hashed = durable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.unhex(own).alias("digest"),
            F.unhex(F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"),
        )
    )
    numbered = durable(number_rows(hashed, ["lang"], ["doc_id", "digest"], name="idx", copies=True))
    sizes = number_rows(numbered.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), [], ["lang"], name="tree")
    trees = durable(sizes.select("lang", F.col("tree").cast("long").alias("tree"), "size"))
    count, largest = trees.agg(F.count(F.lit(1)), F.max("size")).first()

    rounds, roots = _grow(attach(numbered, trees, ["lang"]), _tallest(largest), span, ["doc_id", "claimed"])
    leaves, inner = rounds[0], rounds[1:]

    # The crown: every tree's root is a leaf, at its tree's number.
    roots = roots.select(F.lit(CROWN).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), F.col("tree").alias("idx"), "digest")
    crown, root = _grow(roots, _tallest(count), span, [])
    top = root.select(_hex(F.col("digest"))).first()
    nodes = crown[0]
    for more in [*crown[1:], *inner]:
        nodes = nodes.unionByName(more)
    subroots = crown[0].select(F.col("idx").alias("tree"), _hex(F.col("digest")).alias("subroot"))
    return Manifest(leaves, nodes, trees.join(subroots, "tree"), None if top is None else top[0])


_FOLD = """
    aggregate(transform({path}, (s, k) -> struct(s, k)), {hash}, (h, e) -> unhex(sha2(concat(
        if(shiftright({idx}, e.k) % 2 = 1, lower(hex(e.s)), ''), lower(hex(h)),
        if(shiftright({idx}, e.k) % 2 = 1, '', lower(hex(e.s)))), 256)))"""
_APPEND = "aggregate({path}, {siblings}, (all, s) -> concat(all, s))"
_CLIMB = f"""
WITH RECURSIVE climb (doc_id, tree, idx, leaf, folded, siblings, up_tree, up_base, up_idx) AS (
    SELECT doc_id, tree, idx, digest, {_FOLD.format(path="path", hash="coalesce(claimed, digest)", idx="idx")},
           {_APPEND.format(path="path", siblings="CAST('' AS BINARY)")}, up_tree, up_base, up_idx
    FROM {{leaves}}
    UNION ALL
    SELECT c.doc_id, c.tree, c.idx, c.leaf, {_FOLD.format(path="n.path", hash="c.folded", idx="n.idx")},
           {_APPEND.format(path="n.path", siblings="c.siblings")}, n.up_tree, n.up_base, n.up_idx
    FROM climb c JOIN {{nodes}} n ON c.up_tree = n.tree AND c.up_base = n.base AND c.up_idx = n.idx
)
SELECT doc_id, tree, idx, lower(hex(leaf)) AS leaf, lower(hex(folded)) AS folded_root, lower(hex(siblings)) AS siblings
FROM climb WHERE up_tree IS NULL
"""
_ROWS = "spark.sql.cteRecursionRowLimit"


def climb(manifest: Manifest) -> DataFrame:
    """One row a leaf: doc_id, tree, idx, leaf, siblings (all on its way, joined) and folded_root.

    ``folded_root`` is what the claimed hash and the siblings make of the root.  The result
    is written at once, as the recursion must be free of Spark's limit on its rows.
    """
    spark = manifest.leaves.sparkSession
    limit = spark.conf.get(_ROWS, None)
    spark.conf.set(_ROWS, "-1")
    try:
        return durable(spark.sql(_CLIMB, leaves=manifest.leaves, nodes=manifest.nodes))
    finally:
        spark.conf.unset(_ROWS) if limit is None else spark.conf.set(_ROWS, limit)


def proofs(docs: DataFrame, claimed: Column | None = None, span: int = SPAN) -> DataFrame:
    """Per row its leaf, the roots above it, the hash of its siblings, and whether the claimed leaf leads to the root.

    Returns doc_id, leaf, siblings, proof_sha256, folded_root, subroot, root, verified.
    """
    manifest = build(docs, claimed, span)
    rows = attach(climb(manifest), manifest.trees.select("tree", "subroot"), ["tree"])
    root = F.lit(manifest.root).cast("string")
    return rows.select(
        "doc_id", "leaf", "siblings", _hash(F.col("siblings")).alias("proof_sha256"), "folded_root", "subroot",
        root.alias("root"), (F.col("folded_root") == root).alias("verified"),
    )


def tampered(rate: int = 7) -> Column:
    """Leaf hash with one more character claimed, where ``rate`` divides the CRC-32 of the id's digits; else null.

    A null id has no digits and is left alone; a null ``n_chars`` stays null.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).alias("n_chars")
    fields = [more if f == "n_chars" else F.col(f) for f in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % rate == 0, leaf_hash(*fields))
