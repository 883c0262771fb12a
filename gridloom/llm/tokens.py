"""Token ids of whole texts from a public tokenizer file, inside tasks."""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from codecs import charmap_decode
from types import ModuleType
from unicodedata import is_normalized

import numpy as np

#: A white space run and what follows it. Byte-level tokenizers cut before white space that follows something else, so the
#: pieces have the ids that they have within the text.
PIECE = re.compile(rb"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+")
#: Other white space can join a run: a text with one of these is encoded whole where white space has ids. WIDE: how they
#: begin in UTF-8, for a quick look.
OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: Marks that both kinds of tokenizer cut off after a letter.
MARKS = b".,!?;:#$%&*|"
#: Bytes of pieces remembered with their ids, about, twice: when the younger memory is full it becomes the older one, and
#: pieces that are met again move back, so frequent pieces stay. What a piece takes besides itself and its ids: PIECE_BYTES.
MOST_BYTES, PIECE_BYTES = 32_000_000, 260
#: Marks of pieces met once, by their hash: most pieces never come again, so only those that do are remembered.
MET = 1 << 21
#: Longer pieces are encoded each time.
LONG_PIECE = 48


def _byte_names() -> dict[int, str]:
    """How byte-level tokenizers write bytes as characters: printing ones as they are, the rest from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_NAMES = _byte_names()
CHARS = "".join(BYTE_NAMES[b] for b in range(256))


def _cuts() -> bytes:
    """Per byte, one bit for each of three kinds of place: whether it may come before it (bits 0 to 2), there (3 to 5) and
    after it (6 and 7; before white space, anything may). The places: white space after something else, a mark after a
    letter and before white space or a mark, a lone line break."""
    white = b" \t\n\x0b\f\r"
    out = bytearray()
    for b in range(256):
        blank, mark = b in white, b in MARKS
        before = (not blank) | bytes([b]).isalpha() << 1 | (not blank) << 2
        there = blank | mark << 1 | (b == 0x0A) << 2
        out.append(before | there << 3 | (blank or mark) << 6 | (not blank) << 7)
    return bytes(out)


CUTS = _cuts()


def parted(data: bytes, kinds: int, by: int) -> bytes:
    """A text in UTF-8 with the byte ``by`` put in at the places of some kinds, and after lone line breaks if they are among them."""
    kind = np.frombuffer((data + b" ").translate(CUTS), np.uint8)
    places = kind[:-2] & kind[1:-1] >> 3 & (kind[2:] >> 5 | 1) & kinds
    places[1:] |= places[:-1] >> 2 & 1
    at = np.flatnonzero(places & 3) + 1
    if not len(at):
        return data
    apart = np.full(len(data) + len(at), by, np.uint8)
    own = np.ones(len(apart), bool)
    own[at + np.arange(len(at))] = False
    apart[own] = np.frombuffer(data, np.uint8)
    return apart.tobytes()


def cut(data: bytes) -> list[bytes]:
    """The pieces of a text in UTF-8, with last marks cut off from a letter and a lone line break from what follows; they are
    put apart by a byte that UTF-8 lacks."""
    return parted(data, 7, 0xFF).split(b"\xff") if data else []


def place(name: str) -> str:
    """Where a public tokenizer file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Encodes texts piece by piece, remembering the ids of pieces; ``end`` is appended to every text.

    As a dict it is the younger memory; a piece that is not in it is looked up in the older one, or encoded. ``folds``: the
    tokenizer lower-cases and drops white space.
    """

    def __init__(self, path: str, end: int, folds: bool):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.end = np.array([end], "<u4").tobytes()
        self.folds = folds
        self.older: dict[bytes, bytes] = {}
        self.held = 0
        self.met = bytearray(MET)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            word = piece if self.folds or piece[0] != 0x20 else piece[1:]
            if not word.isalpha():  # of ASCII
                # what is put together from remembered pieces is not remembered itself
                if b"\n" in piece:
                    parts = PIECE.findall(piece)
                    if len(parts) > 1:  # a line break within
                        return b"".join([self[p] for p in parts])
                bare = piece.rstrip(MARKS)
                if len(bare) < len(piece) and bare[-1:].isalpha():
                    return self[bare] + self[piece[len(bare) :]]
            if word.isalpha() or self._is_word(word):
                ids = array("I", [t.id for t in self.merge(charmap_decode(piece, "strict", CHARS)[0])]).tobytes()
            else:
                ids = self.whole(piece.decode())
            place = hash(piece) % MET
            if not self.met[place]:
                self.met[place] = 1
                return ids
        if len(piece) <= LONG_PIECE:
            if self.held >= MOST_BYTES:
                self.older = dict(self)
                self.clear()
                self.held = 0
                self.met = bytearray(MET)  # else in the end every piece would seem to be met again
            self.held += len(piece) + len(ids) + PIECE_BYTES
            self[piece] = ids
        return ids

    def _is_word(self, word: bytes) -> bool:
        """Whether the steps before the merging step would leave it as one word of letters."""
        text = word.decode()
        return text.isalpha() and (not self.folds or text.lower() == text and is_normalized("NFC", text))

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        data = text.encode()
        if self.folds:
            pieces = parted(data.lower(), 2, 0x20).split()  # bytes: only A-Z change
        elif any(w in data for w in WIDE) and OTHER_SPACE.search(text):
            return np.frombuffer(self.whole(text) + self.end, "<u4")
        else:
            pieces = cut(data)
        return np.frombuffer(b"".join([*map(self.__getitem__, pieces), self.end]), "<u4")

    def rest(self) -> None:
        """At the end of a task: the worker may run other work next, so only the marks of what was met stay."""
        self.older.clear()
        self.clear()
        self.held = 0


def task_encoder(path: str, end: int, folds: bool) -> Encoder:
    """One encoder per worker process, kept between its tasks."""
    held = sys.modules.setdefault("gridloom_task_memory", ModuleType("gridloom_task_memory")).__dict__
    key = f"encoder {path} {end} {folds}"
    if key not in held:
        held[key] = Encoder(path, end, folds)
    return held[key]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
