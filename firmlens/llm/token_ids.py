"""Token ids of whole texts, with the tokenizers library and a public vocabulary file.

The vocabulary's pre-tokenizer cuts a text into runs of letters, single digits and runs of
marks, and never joins across white space. For Latin text the same cut is made here, and
every distinct piece goes to the library's model once per worker; all other chunks pass
through the library's whole pipeline. Both give the ids of the whole text.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable

END_ID = 1
CACHED_PIECES = 100_000  # of each of two generations
CACHED_CHARS = 64
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}{_MARKS}0-9 \t\n\r]*")
_PIECES = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+|[0-9]")
_PIECES_WITH_ENDINGS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{_PIECES.pattern}")


def _byte_alphabet() -> list[str]:
    """The printable character that byte-level models write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _packed(ids: Iterable[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Pieces(dict):
    """Piece -> ids, filled from the model on first use. Pieces that were not asked for since
    the last turn but one are forgotten; frequent ones stay."""

    def __init__(self, model):
        super().__init__()
        self.model, self.alphabet = model, _byte_alphabet()
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            spelled = piece if piece.isascii() else "".join(self.alphabet[b] for b in piece.encode())
            ids = _packed([t.id for t in self.model.tokenize(spelled)])
        if len(piece) <= CACHED_CHARS:
            self[piece] = ids
        return ids

    def turn(self) -> None:
        self.older = dict(self)
        self.clear()


class Encoder:
    """Texts to little-endian unsigned 32-bit ids. One per task, so that no
    vocabulary or cache waits in an idle worker.

    The cache only saves time: it is bounded, and long pieces never enter.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer.model)
        # The short way is taken only where it has been seen to agree with the whole pipeline.
        samples = ("The.", "ÉTÉß,", "a1234b", "Word%%%|x_y", "We'LL 's ''")
        self.short = all(self._by_pieces(x) == self._whole(x) for x in samples)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _by_pieces(self, text: str) -> bytes:
        pattern = _PIECES_WITH_ENDINGS if "'" in text else _PIECES
        return b"".join(map(self.pieces.__getitem__, pattern.findall(text.lower())))

    def _plain(self, text: str) -> bool:
        return self.short and "<|" not in text and _PLAIN.fullmatch(text) is not None

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, without special tokens; a null text is empty."""
        if not text:
            return b""
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.turn()
        if self._plain(text):
            return self._by_pieces(text)
        chunks = text.replace("\n", " ").split(" ")
        return b"".join(self._by_pieces(x) if self._plain(x) else self._whole(x) for x in chunks)


def encoder(vocabulary: Callable[[], str]) -> Encoder:
    """An encoder for one task; ``vocabulary`` gives the file's path on the worker."""
    return Encoder(vocabulary())
