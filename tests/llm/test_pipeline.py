"""The registered corpus queries and the pipeline on the smallest tables, against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from test_operators import _groups, _model, _plain_pii, _plain_secrets, _plain_simhash
from tidewatt.llm import mixing, packing, pii, queries, simhash, syncmers, tokens, toxicity

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def rows(spark):
    return sorted((r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())


def run(spark, name):
    return entry.queries()[name](spark, FOLDER).collect()


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    verdict, n = check.compare(spark, check.database(FOLDER), FOLDER, name)
    assert (verdict, n > 0) == ("match", True)


def test_shards(spark, rows):
    out = {r.doc_id: r for r in run(spark, "op1_histogram_sort")}
    assert {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in rows} == {i: (r.size, r.text_crc32) for i, r in out.items()}
    sizes, slots = Counter(), Counter()
    for r in out.values():
        assert r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r.size
        slots[r.shard] += 1
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in out.values())
    assert {(r.shard, r.slot) for r in out.values()} == {(s, i) for s, n in slots.items() for i in range(n)}


def test_fingerprints(spark, rows):
    out = {r.doc_id: r for r in run(spark, "op2_closed_syncmers")}
    near, far = [], []
    for (i, text, _), (_, after, _) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert out[i].fingerprint == syncmers.fingerprint(syncmers.sketch(text))
        near.append(out[i].near_edited)
        far.append(out[i].near_next)
    assert np.median(near) > 0.25 and np.median(far) < 0.02


def test_sequences(spark, rows):
    out = run(spark, "op3_certified_packing")
    encode = tokens.encoder(packing._tokenizer_file()).whole.encode
    want = {}
    for i, text, _ in rows:
        ids = np.array([*encode(text, add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(i, n)] = (at, len(part), zlib.crc32(part.tobytes()))
    assert want == {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out}
    assert len({r.sequence_id for r in out}) == packing.lower_bound(np.array([r.length for r in out]), 4096)


def test_near_copies(spark, rows):
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op4_ball_simhash")}
    fps = [_plain_simhash(t) for _, t, _ in rows]
    ids = [i for i, _, _ in rows]
    assert out == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, _groups(fps, ids), strict=True)}


def test_personal_data(spark, rows):
    out = {r.doc_id: r for r in run(spark, "op5_boosted_pii")}
    for i, text, _ in rows:
        base = _plain_pii(text)
        assert out[i].base_sha256 == digest(base)
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(out[i].spans.split(","))


def test_toxicity_of_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    out = run(spark, "op7_noisy_toxicity")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(labels[r.doc_id] for r in out if r.predicted and r.doc_id in labels and r.held_out)


def test_secrets(spark, rows):
    out = {r.doc_id: r for r in run(spark, "op8_trigram_secrets")}
    for i, text, _ in rows:
        base = [(k, a, b) for a, _, b, k in _plain_secrets(text)]
        assert out[i].base_sha256 == digest(base)
        assert [out[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]


def test_language_model(spark, rows):
    out = {r.doc_id: r for r in run(spark, "op9_bloom_lm")}
    for i, held, n, known, train, base, score in _model([(i, t) for i, t, _ in rows]):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base) and score - 1e-6 <= r.score <= 0.8 * score


def test_pipeline_against_plain_stages(spark, rows):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    verdict = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels).collect()}
    kept = [r for r in rows if not verdict[r[0]]]
    fps = [_plain_simhash(t) for _, t, _ in kept]
    kept = [r for r, c in zip(kept, _groups(fps, [r[0] for r in kept]), strict=True) if r[0] == c]

    ids = {i for i, _, _ in kept}
    table = docs.where(docs.doc_id.isin(sorted(ids)))
    clean = {r.doc_id: r.text for r in pii.without_personal_data(table).collect()}
    assert all(clean[i] == t for i, t, _ in kept if not _plain_pii(t) and "[" not in clean[i])
    assert all(t[a:b] not in clean[i] for i, t, _ in kept for k, a, b in _plain_pii(t) if k == "email")

    sizes, want = Counter(), Counter()
    for i, _, source in kept:
        sizes[source if source in queries.WEIGHTS else None] += len(clean[i].encode()) + 1
    rate = mixing.rates(sizes, queries.WEIGHTS, 1.0)
    encode = tokens.encoder(packing._tokenizer_file()).whole.encode
    for i, _, source in kept:
        u = int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) / 2**52
        mean = rate[source if source in queries.WEIGHTS else None]
        k, step = 0, math.exp(-mean)
        total = step
        while total <= u:
            k += 1
            step *= mean / k
            total += step
        token_ids = np.array([*encode(clean[i], add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(token_ids), 4096)):
            if k:
                want[(i, n, at, zlib.crc32(token_ids[at : at + 4096].tobytes()))] += k

    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in out) == want
    loads = Counter()
    for r in out:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        loads[r.sequence_id] += r.length
    assert max(loads.values()) <= 4096 and len(loads) == packing.lower_bound(np.array([r.length for r in out]), 4096)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).dtypes == docs.dtypes
    assert simhash.without_near_copies(docs.limit(0)).dtypes == docs.dtypes
