"""The operators applied to the given tables with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatt.llm import (
    collocations, common, lm_bloom, merkle, mixing, packing, pieces, pii, secrets, sharding, simhash, syncmers, topk, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


#: Target shares of the mixture by bytes; all other sources share the rest as they are.
WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.05}


@query
def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes."""
    rows = sharding.shard_documents(common.documents(spark, sf_dir), shards=8)
    return rows.select(
        "document.doc_id", "size", common.text_crc32(F.col("document.text")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and their edited texts, with likenesses."""
    return syncmers.fingerprints(common.documents(spark, sf_dir))


@query
def op3_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    packed = packing.pack_documents(common.documents(spark, sf_dir))
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op4_ball_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    rows = simhash.grouped(common.documents(spark, sf_dir))
    return rows.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents so that the named sources take their target weights."""
    rows = mixing.replicate(common.documents(spark, sf_dir), WEIGHTS)
    return rows.select(
        "document.doc_id", "document.source", "copies", "copy", "place",
        F.md5(F.coalesce("document.text", F.lit(""))).alias("text_md5"),
    )


_NAMED = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in WEIGHTS.items())
_UNIFORM = "('0x' || substr(md5('{}|' || coalesce(doc_id::VARCHAR, '') || {}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
ORACLES["op10_poisson_mixing"] = f"""
WITH named(name, weight) AS (VALUES {_NAMED}),
docs AS (
    SELECT doc_id, source, coalesce(text, '') AS body, coalesce(name, '') AS grp, {_UNIFORM.format("mix", "''")} AS u
    FROM documents LEFT JOIN named ON source = name
),
sizes AS (SELECT grp, sum(strlen(body) + 1)::DOUBLE AS size FROM docs GROUP BY grp),
shares AS (
    SELECT grp, size, CASE WHEN grp = '' THEN 1 - (SELECT sum(weight) FROM named) ELSE weight END AS share
    FROM sizes LEFT JOIN named ON grp = name
),
rates AS (
    SELECT grp, share / sum(share) OVER () * sum(size) OVER () / size AS rate FROM shares
),
steps AS (
    SELECT grp, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0))) OVER (PARTITION BY grp ORDER BY k) AS step
    FROM rates, range(60) AS r(k)
),
counted AS (
    SELECT doc_id, source, body, u, (SELECT count(*) FROM steps s WHERE s.grp = docs.grp AND s.step <= docs.u)::INTEGER AS copies
    FROM docs
)
SELECT doc_id, source, copies, copy, {_UNIFORM.format("mix-order", "'|' || copy::VARCHAR")} AS place, md5(body) AS text_md5
FROM (SELECT *, unnest(range(copies))::INTEGER AS copy FROM counted)
"""


@query
def op8_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and spans."""
    found = secrets.find_secrets(common.documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["order"] < len(secrets.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, rule.kind))).cast("long").alias(f"n_{rule.kind}")
        for rule in secrets.BASE
    ]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans")
    )


@query
def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents."""
    return lm_bloom.score_documents(common.documents(spark, sf_dir))


@query
def op7_noisy_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_documents(common.documents(spark, sf_dir), labels)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op6_three_phase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


ORACLES["op6_three_phase_topk"] = """
WITH whole AS (
    SELECT vec_id, [floor(x::DOUBLE * 256) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.v, c.v))::BIGINT AS score
    FROM whole q, whole c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _spans_text(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and spans."""
    found = pii.find_personal_data(common.documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_spans_text("base"), 256).alias("base_sha256"), _spans_text("spans").alias("spans")
    )


@query
def op11_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, the text they decode to, and the bytes that they cover."""
    rows = pieces.encode_documents(common.documents(spark, sf_dir))

    def listed(numbers: str) -> F.Column:
        return F.array_join(F.col(numbers).cast("array<string>"), ",")

    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat_ws(";", listed("starts"), listed("ends")), 256).alias("spans_sha256"),
    )


@query
def op12_prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest phrases of 2 to 5 words that occur 100 times."""
    return collocations.collocations(common.documents(spark, sf_dir), top=2000)


ORACLES["op12_prefix_groups"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split),
grams AS (
    SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
    FROM places, range(1, 6) AS r(k) WHERE i + k - 1 <= len(words)
),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
phrases AS (SELECT lang, phrase, k AS words, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
several AS (SELECT *, string_split(phrase, ' ') AS w FROM phrases WHERE words > 1),
kept AS (
    SELECT * FROM several s WHERE NOT EXISTS (
        SELECT 1 FROM several b WHERE b.lang = s.lang AND b.words > s.words AND 100 * b.a >= 100 * s.a
          AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')
    )
),
cuts AS (
    SELECT s.lang, s.phrase, s.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * s.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM kept s JOIN range(1, 5) AS c(k) ON k < s.words
    JOIN phrases l ON l.lang = s.lang AND l.phrase = array_to_string(w[:k], ' ')
    JOIN phrases r ON r.lang = s.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
    JOIN totals t ON t.lang = s.lang
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query
def op13_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, with one character more claimed for about a seventh of them."""
    return merkle.proofs(common.documents(spark, sf_dir), merkle.tampered()).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_CRC_DIGITS = """xor(4294967295, list_reduce([4294967295] || [ascii(d) FOR d IN string_split(doc_id::VARCHAR, '')], lambda c, b:
    list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
_LEVEL_UP = """SELECT tree, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (cnt + 1) // 2
    FROM {0} WHERE cnt > 1 GROUP BY tree, lvl, idx // 2, cnt"""
ORACLES["op13_merkle_climb"] = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, {_leaf("n_chars")} AS leaf,
           CASE WHEN {_CRC_DIGITS} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS claimed
    FROM documents
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM hashed),
levels(tree, lvl, idx, h, cnt) AS (
    SELECT tree, 0, idx, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
    UNION ALL {_LEVEL_UP.format("levels")}
),
crown(tree, lvl, idx, h, cnt) AS (
    SELECT -1::BIGINT, 0, tree, h, count(*) OVER () FROM levels WHERE cnt = 1
    UNION ALL {_LEVEL_UP.format("crown")}
),
nodes AS (SELECT * FROM levels UNION ALL SELECT * FROM crown),
tops AS (SELECT tree, lvl AS height, h AS top FROM nodes WHERE cnt = 1),
climb(doc_id, home, place, tree, lvl, idx, folded, siblings) AS (
    SELECT doc_id, tree, idx, tree, 0, idx, claimed, '' FROM leaves
    UNION ALL
    SELECT c.doc_id, home, place,
           CASE WHEN c.lvl < t.height THEN c.tree ELSE -1 END,
           CASE WHEN c.lvl < t.height THEN c.lvl + 1 ELSE 0 END,
           CASE WHEN c.lvl < t.height THEN c.idx // 2 ELSE c.tree END,
           CASE WHEN c.lvl = t.height THEN folded WHEN c.idx % 2 = 1 THEN sha256(s.h || folded) ELSE sha256(folded || coalesce(s.h, '')) END,
           siblings || CASE WHEN c.lvl < t.height THEN coalesce(s.h, '') ELSE '' END
    FROM climb c JOIN tops t ON t.tree = c.tree
    LEFT JOIN nodes s ON s.tree = c.tree AND s.lvl = c.lvl AND s.idx = xor(c.idx, 1)
    WHERE c.tree >= 0 OR c.lvl < t.height
)
SELECT c.doc_id, l.leaf, t.top AS subroot, r.top AS root, sha256(c.siblings) AS proof_sha256, c.folded AS folded_root, c.folded = r.top AS verified
FROM climb c JOIN tops r ON r.tree = -1 AND c.tree = -1 AND c.lvl = r.height
JOIN leaves l ON l.tree = c.home AND l.idx = c.place JOIN tops t ON t.tree = c.home
"""
