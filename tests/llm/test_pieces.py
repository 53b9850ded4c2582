"""Offset-preserving encoding against the library: ids, spans, decoded text and normalisation."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from sentencepiece import SentencePieceNormalizer

import __spark_entry__ as entry
from tidewatt.llm import pieces

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    return pieces.encoder(pieces._model_file())


def _library(own, text):
    return [(p.id, p.begin, p.end) for p in own.library.encode(text, return_type="proto").pieces]


def _own(own, text):
    return list(zip(*(x.tolist() for x in own.encode(text)), strict=True))


TEXTS = [
    "", " ", "  ", "a", "▁", " ▁ ▁", "a▁ b", "Hello  world ", "\t tab\nline\r\n", "<s>x</s> <0x41> <unk>", "ẞßſ 😀😀 한국어 中文", "\x00\x01 \x7f",
    "x" * 30_000, " " * 5_000, "é" * 5_000, "word " * 5_000, "á à ñ 👩‍👩‍👧 ‮abc", "� \U0010ffff",
]


@pytest.mark.parametrize("text", TEXTS)
def test_odd_texts_equal_the_library(own, text):
    assert _own(own, text) == _library(own, text)


def test_random_texts_equal_the_library(own, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 200)
    signs, draw = "ab  é▁\t\n😀<s>ẞ\x00́‍x한 0123.,中文", random.Random(3)
    for _ in range(3_000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 30)))
        assert _own(own, text) == _library(own, text)


def test_spans_cover_the_text_and_name_its_bytes(own):
    text = "Some naïve words,  and 한국어 ẞ."
    data, spans = text.encode(), _own(own, text)
    assert b"".join(data[a:b] for _, a, b in spans) == data
    assert own.decode([i for i, _, _ in spans]) == text


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("prefix,extra,escape", [(True, True, True), (False, False, False), (True, False, True), (False, True, True)])
def test_compiled_maps_equal_the_library(rule, prefix, extra, escape):
    library = SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=extra, escape_whitespaces=escape)
    compiled = pieces._fields(pieces._fields(library.serialized_model_proto())[3][0]).get(2, [b""])[0]
    normalise = pieces.Normaliser(compiled, prefix, extra, escape)
    signs, draw = "ab  　 é①ﬁ½Ⅷｶﾞé\t\n😀ẞ\x00‍Å한ABÀ㍿", random.Random(5)
    for _ in range(400):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 15)))
        normal, origin = normalise(text)
        want, characters = library.normalize(text, with_offsets=True)
        places = np.cumsum([0, *(len(c.encode()) for c in normal)])
        assert normal == want
        assert [len(text.encode()[: origin[p]].decode()) for p in places] == list(characters)


AWKWARD = [
    (1, "a text", 1, "x"), (1, "a text", 1, "x"), (2, "", 1, "x"), (3, None, None, None), (None, "no id", 1, "x"), (None, None, 1, "x"),
    (4, "ẞ" * 200_000, 1, "x"), (5, " leading and trailing ", 1, "x"),
]


def test_awkward_rows(spark, own, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH", 100)
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string, ids int, decoded string")
    rows = pieces.encode_documents(docs.repartition(2)).collect()
    got = sorted(((r.doc_id, r.ids, list(zip(r.starts, r.ends, strict=True)), r.decoded) for r in rows), key=repr)
    want = []
    for doc_id, text, *_ in AWKWARD:
        found = _library(own, text or "")
        ids = [i for i, _, _ in found]
        want.append((doc_id, ids, [x[1:] for x in found], own.library.decode(ids) if ids else ""))
    assert got == sorted(want, key=repr)
    assert pieces.encode_documents(docs.limit(0)).count() == 0


def test_query_equals_the_library(spark, own):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in entry.queries()["op11_offset_pieces"](spark, FOLDER).collect()}
    assert rows.keys() == docs.keys()
    for doc_id, text in docs.items():
        ids = own.library.encode(text)
        r = rows[doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(own.library.decode(ids))
