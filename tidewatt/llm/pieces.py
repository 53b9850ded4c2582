"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

A text is first normalised: at each place the longest entry of the model's compiled
character map (a double-array trie over UTF-8 bytes) that starts there is replaced, and
every normalised byte remembers the byte of the source from which it came.  The normalised
text is cut where a word ends and a space sign follows, which no piece of the vocabulary
crosses, and every distinct part is merged into pieces by the library once and remembered.
The pieces' lengths, summed up and looked up in the alignment, give each piece's bytes in
the source.

``encode_documents`` gives per row doc_id, ids, starts and ends (UTF-8 byte offsets into the
text, end exclusive) and decoded.  A character that falls back to bytes is owned by its
last byte piece; the others are empty spans at its start.  Null and empty texts have no
pieces and decode to empty text; repeated rows are encoded each for itself; an empty
table gives an empty one.  Columns other than ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

import functools
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatt.llm.common import identified

SPACE = "▁"
#: Parts of texts that a worker remembers at most; then it starts afresh.  Bounds memory only.
REMEMBERED = 400_000
#: Pieces in one batch of results, at most one text over it.
BATCH = 1 << 20


def _model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(message: bytes) -> dict[int, list]:
    """Field numbers and values of one serialised message; nested messages stay bytes."""
    at, out = 0, {}

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = message[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


class CharacterMap:
    """A compiled character map: replacements of byte strings, found by longest prefix."""

    def __init__(self, compiled: bytes) -> None:
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
            self.texts = compiled[4 + size :]
        self.begins: dict[str, bool] = {}

    def _child(self, node: int, byte: int) -> int | None:
        """The node below ``node`` for ``byte``; a unit holds its label, the distance to its children and a leaf mark."""
        unit = self.units[node]
        below = node ^ (unit >> 10 << (8 if unit & 512 else 0)) ^ byte
        return below if below < len(self.units) and self.units[below] & 0x800000FF == byte else None

    def _value(self, node: int) -> bytes | None:
        unit = self.units[node]
        if not unit & 256:
            return None
        start = self.units[node ^ (unit >> 10 << (8 if unit & 512 else 0))] & 0x7FFFFFFF
        return self.texts[start : self.texts.index(b"\0", start)]

    def begins_entry(self, character: str) -> bool:
        """Whether the bytes of ``character`` are the beginning of some entry."""
        known = self.begins.get(character)
        if known is None:
            node: int | None = 0
            for byte in character.encode():
                node = self._child(node, byte)
                if node is None:
                    break
            known = self.begins[character] = node is not None
        return known

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry at ``data[at:]``."""
        node, best = 0, None
        for i in range(at, len(data)):
            below = self._child(node, data[i])
            if below is None:
                break
            node = below
            value = self._value(node)
            if value is not None:
                best = (i + 1 - at, value)
        return best


class Normaliser:
    """Normalised text with, for each of its bytes and its end, the byte of the source it came from."""

    def __init__(self, compiled: bytes, dummy_prefix: bool, remove_extra: bool, escape: bool) -> None:
        self.map = CharacterMap(compiled)
        self.dummy_prefix, self.remove_extra = dummy_prefix, remove_extra
        self.space = SPACE.encode() if escape else b" "

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        source = text.encode()
        kind = np.int32 if len(source) < 2**31 - 1 else np.int64
        if not source:
            return "", np.zeros(1, kind)
        if self.map.units or self.remove_extra:
            out, origin, end = self._mapped(text)
            if not out and self.remove_extra:
                return "", np.zeros(1, kind)
        else:
            out, end = np.frombuffer(source, np.uint8), len(source)
            origin = np.arange(end, dtype=kind)
        # Every space becomes the space sign, whose bytes share the origin of the space.
        wide = np.where(np.frombuffer(out, np.uint8) == 32, len(self.space), 1)
        prefix = self.space if self.dummy_prefix else b""
        first = origin[0] if len(origin) else end
        origin = np.concatenate([np.full(len(prefix), first, kind), np.repeat(origin, wide), np.array([end], kind)])
        return (prefix + bytes(out).replace(b" ", self.space)).decode(), origin.astype(kind)

    def _mapped(self, text: str) -> tuple[bytes, np.ndarray, int]:
        """Replaced bytes, their origins, and where the last of them ends; runs of spaces as one where the model wants it."""
        out, origin = bytearray(), array("q")
        data, at, skip = text.encode(), 0, 0
        after_space, end = self.remove_extra, 0
        for character in text:
            width = len(character.encode())
            if skip:  # inside the entry that was replaced
                skip -= width
                at += width
                continue
            found = self.map.longest(data, at) if self.map.units and self.map.begins_entry(character) else None
            length, new = found or (width, data[at : at + width])
            if after_space:
                new = new.lstrip(b" ")
            out += new
            origin.extend([at] * len(new))
            if self.remove_extra and new:
                after_space = new.endswith(b" ")
            if new or not self.remove_extra:
                end = at + length
            skip = length - width
            at += width
        end = at
        if self.remove_extra:
            kept = len(out.rstrip(b" "))
            if kept < len(out):
                end = origin[kept]
                del out[kept:], origin[kept:]
        return bytes(out), np.array(origin, np.int64), end


class Encoder:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        model = _fields(self.library.serialized_model_proto())
        trainer, rules = _fields(model[2][0]), _fields(model[3][0])
        kinds = {_fields(p).get(3, [1])[0] for p in model[1]}
        of, size = self.library, self.library.get_piece_size()
        byte_ids = {int(of.id_to_piece(i)[1:-1], 16): i for i in range(size) if of.is_byte(i)}
        if trainer.get(3, [1])[0] != 2 or kinds & {4, 5} or trainer.get(24, [0])[0] or len(byte_ids) < 256:
            raise ValueError("only byte-pair models with byte pieces and spaces before words, without user-defined or unused pieces")
        self.normalise = Normaliser(
            rules.get(2, [b""])[0], bool(rules.get(3, [1])[0]), bool(rules.get(4, [1])[0]), bool(rules.get(5, [1])[0])
        )
        # Merges parts that are normalised already: a later message of field 3 overrides the map and the three switches.
        self.merger = SentencePieceProcessor(
            model_proto=self.library.serialized_model_proto() + b"\x1a\x08" + b"\x12\x00\x18\x00\x20\x00\x28\x00"
        )
        self.lengths = np.array([len(of.id_to_piece(i).encode()) for i in range(size)], np.int64)
        self.byte = np.full(size, -1, np.int64)
        self.byte[list(byte_ids.values())] = list(byte_ids)
        crossed = any(re.search(f"[^{SPACE}]{SPACE}", of.id_to_piece(i)) for i in range(size))
        self.parts = re.compile("(?s:.+)" if crossed else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> np.ndarray:
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), np.int32)
        except KeyError:
            pass
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(parts).difference(self.known))
        for part, ids in zip(new, self.merger.encode(new, num_threads=1), strict=True):
            self.known[part] = array("i", ids).tobytes()
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), np.int32)

    def _lengths(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes of every piece; a character in byte pieces counts at its last one."""
        lengths, byte = self.lengths[ids], self.byte[ids]
        if (byte >= 0).any():
            lengths[byte >= 0] = 0
            first = np.flatnonzero((byte >= 0) & (byte & 0xC0 != 0x80))
            width = 1 + sum((byte[first] >= b).astype(np.int64) for b in (0xC0, 0xE0, 0xF0))
            lengths[first + width - 1] = width
        return lengths

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and last byte (exclusive) of every piece in the UTF-8 form of ``text``."""
        normal, origin = self.normalise(text)
        ids = self._ids(self.parts(normal))
        bounds = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self._lengths(ids), out=bounds[1:])
        return ids, origin[bounds[:-1]], origin[bounds[1:]]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


_ROWS = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per row doc_id, ids, starts, ends and decoded; ``model`` names the model file (default: the installed public one)."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model or _model_file())
        names = [x.split()[0] for x in _ROWS.split(", ")]
        doc_ids: list[int | None] = []
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        texts: list[str] = []

        def batch_of() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows], dtype=np.int64)]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(offsets, np.concatenate([r[k] for r in rows]).astype(np.int32)) for k in range(3)
            ]
            out = pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *lists, pa.array(texts, pa.string())], names)
            doc_ids.clear(), rows.clear(), texts.clear()
            return out

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                row = own.encode(text.as_py())
                doc_ids.append(doc_id.as_py())
                rows.append(row)
                texts.append(own.decode(row[0].tolist()))
                held += len(row[0])
                if held > BATCH:
                    yield batch_of()
                    held = 0
        if rows:
            yield batch_of()

    return identified(docs).mapInArrow(encoded, _ROWS)
