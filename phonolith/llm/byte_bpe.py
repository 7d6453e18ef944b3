"""Token ids of whole texts by the tokenizers library, for byte-level BPE files.

The library's pre-tokenizer starts a new piece at every space that a character
other than white space follows, so a text may be cut there and each stretch
encoded alone. Stretches and their pieces repeat, so their ids are kept in a
memo bounded in bytes; the library's model encodes each new piece. The ids equal
those of the whole text.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

import regex

from .token_counts import byte_units

#: Bytes of both generations of the memo, what an entry takes besides its own bytes, and the longest stretch kept.
MEMO_BYTES, ENTRY, LONGEST = 112 << 20, 150, 48
#: Fixed value: how byte-level BPE splits a text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CUT = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" \s")


class Memo:
    """Ids by key in at most ``most`` bytes; entries not asked for during a generation go."""

    def __init__(self, most: int = MEMO_BYTES):
        self.most = most // 2
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def add(self, key: str, ids: bytes) -> None:
        if self.held >= self.most:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[key] = ids
        self.held += ENTRY + len(key) + len(ids)


class ByteBpe:
    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # The key of a stretch leaves out the space before it; keys of other pieces start with a space.
        self.memo = Memo(memo_bytes)
        self.units = dict(enumerate(byte_units()))
        self.space = self.units[32]
        # Where nothing but the byte-level split happens before the model, pieces can be encoded one by one.
        self.plain = self.library.normalizer is None and type(self.library.pre_tokenizer).__name__ == "ByteLevel"

    def _new(self, piece: str, key: str) -> bytes:
        """The model's ids of one piece."""
        if piece.isascii() and piece.isprintable():
            units = piece.replace(" ", self.space)
        else:
            units = piece.encode().decode("latin-1").translate(self.units)
        ids = _bytes([t.id for t in self.model.tokenize(units)])
        if len(key) <= LONGEST:
            self.memo.add(key, ids)
        return ids

    def _piece(self, piece: str) -> bytes:
        key = piece[1:] if piece[0] == " " and len(piece) > 1 and not piece[1].isspace() else " " + piece
        memo = self.memo
        ids = memo.new.get(key)
        if ids is None:
            ids = memo.old.get(key)
            if ids is None:
                return self._new(piece, key)
            memo.add(key, ids)
        return ids

    def _stretches(self, stretches: list[str], odd: bool) -> list[bytes]:
        """The ids of stretches that the memo's new generation lacks, each with the space before it. Odd: spaces may be inside."""
        memo = self.memo
        out = list(map(memo.old.get, stretches))
        left = [i for i, ids in enumerate(out) if ids is None]
        if len(left) < len(out):
            for s, ids in zip(stretches, out):
                if ids is not None:
                    memo.add(s, ids)
        if not left:
            return out
        if odd:
            for i in left:
                out[i] = b"".join(map(self._piece, PIECES.findall(" " + stretches[i])))
            return out
        # One pass over all of them; a piece that starts with a space starts a stretch.
        pieces = PIECES.findall(" " + " ".join([stretches[i] for i in left]))
        starts = [k for k, p in enumerate(pieces) if p[0] == " "]
        starts.append(len(pieces))
        for i, a, b in zip(left, starts, starts[1:]):
            if b - a == 1:
                out[i] = self._piece(pieces[a])
            else:
                ids = out[i] = b"".join(map(self._piece, pieces[a:b]))
                s = stretches[i]
                if len(s) <= LONGEST:
                    memo.add(s, ids)
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.plain or any(s in text for s in self.specials):
            return _bytes(self.library.encode(text, add_special_tokens=False).ids)
        parts = text.split(" ")
        odd = "" in parts or _spaces_meet(text)
        if odd:
            parts = _CUT.split(text)
        head = b"".join(map(self._piece, PIECES.findall(parts[0])))
        del parts[0]
        out = list(map(self.memo.new.get, parts))
        if None in out:
            at = [i for i, ids in enumerate(out) if ids is None]
            for i, ids in zip(at, self._stretches([parts[i] for i in at], odd)):
                out[i] = ids
        return head + b"".join(out)


def _spaces_meet(text: str) -> bool:
    """Whether some space is followed by other white space."""
    if text.isascii() and not any(c in text for c in "\t\v\f\r\x1c\x1d\x1e\x1f"):
        return " \n" in text
    return _ODD_SPACE.search(text) is not None


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=1)
def byte_bpe(path: str, memo_bytes: int = MEMO_BYTES) -> ByteBpe:
    return ByteBpe(path, memo_bytes)
