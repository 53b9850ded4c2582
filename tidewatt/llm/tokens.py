"""Token ids of whole texts by a public tokenizer file, fast on long corpora.

White space separates tokens of this tokenizer, so a text is split at white space
and every distinct piece is encoded once and remembered.  A piece of Latin-1
letters (the bulk) skips the normaliser: its byte-level form goes straight to the
merges.  All other pieces take the tokenizer's own steps, and texts with control
separators or special-token strings are encoded whole.
"""

from __future__ import annotations

import functools
import re
from array import array

#: Pieces a worker remembers at most; then it starts afresh.  Bounds memory only.
REMEMBERED = 400_000
_ODD = re.compile("[\x1c-\x1f]|<\\|")
#: Lower-case Latin-1 letters and then ASCII signs, which the tokenizer splits just there.
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-/:-@[-`{-~]*)")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # What the byte-level step makes of each two-byte and one-byte letter.
        self.letters = {
            ord(x): level.pre_tokenize_str(x)[0][0] for x in map(chr, range(256)) if _PLAIN.fullmatch(x)
        }
        self.known: dict[str, bytes] = {}
        self.tails = {"": b""}
        self.words: dict[str, bytes] = {}

    def _slow(self, piece: str) -> bytes:
        return array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if plain is None:
            return self._slow(piece)
        word, tail = plain.groups()
        ids = self.words.get(word)
        if ids is None:
            level = word if word.isascii() else word.translate(self.letters)
            ids = self.words[word] = array("I", [t.id for t in self.model.tokenize(level)]).tobytes()
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
            self.tails[tail] = self._slow(tail)
        return ids + self.tails[tail]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if _ODD.search(text):
            return self._slow(text)
        if text.isascii() or _latin(text):
            text = text.lower()
        pieces = text.split()
        known = self.known
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
            self.words.clear()
        for piece in set(pieces).difference(known):
            known[piece] = self._piece(piece)
        return b"".join(map(known.__getitem__, pieces))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
