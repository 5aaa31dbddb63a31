"""Token ids through the tokenizers library, with bounded caches in front of its byte-level BPE.

A space that follows a non-space character always begins a pre-token, so a text falls apart into pieces that
encode independently. Pieces repeat far more than texts: each worker keeps the ids of the pieces and
pre-tokens it met first (up to a fixed number), and only the others reach the library's model. Pieces with
characters outside ASCII and Latin-1 letters are encoded by the library's whole tokenizer.
Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import re

import numpy as np

PIECES = 300_000  # cached at most
PRETOKENS = 600_000
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[\\n -~{_LATIN}]*")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\\s{_LATIN}0-9]+|\\s+(?!\\S)|\\s+")
_JOINED = re.compile(r"\s ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: itself where visible in Latin-1, else the next code point from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.symbols = _byte_symbols()
        self.pieces: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pieces = text.split(" ")
        if text[0] == " " or _JOINED.search(text):
            pieces = self._merged(pieces)
        out = [self._chunk(pieces[0]), *map(self.pieces.get, pieces[1:])]
        at = 0
        while True:
            try:
                at = out.index(None, at)
            except ValueError:
                break
            out[at] = self._piece(pieces[at])
        return b"".join(out)

    @staticmethod
    def _merged(pieces: list[str]) -> list[str]:
        """Pieces joined again where the space between them does not follow a non-space character."""
        out = [pieces[0]]
        group = [pieces[0]]
        for p in pieces[1:]:
            if not group[-1] or group[-1][-1].isspace():
                group.append(p)
            else:
                out[-1] = " ".join(group)
                group = [p]
                out.append(p)
        out[-1] = " ".join(group)
        return out

    def _piece(self, piece: str) -> bytes:
        ids = self._chunk(" " + piece)
        if len(self.pieces) < PIECES and len(piece) <= 48:
            self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if not _PLAIN.fullmatch(chunk):
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.pretokens.get(p) or self._pretoken(p) for p in _SPLIT.findall(chunk)])

    def _pretoken(self, pretoken: str) -> bytes:
        mapped = "".join(map(self.symbols.__getitem__, pretoken.encode()))
        ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        if len(self.pretokens) < PRETOKENS and len(pretoken) <= 48:
            self.pretokens[pretoken] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a file; its caches live as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
