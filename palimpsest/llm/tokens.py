"""Exact token ids of public tokenizers, memoised by white-space chunk inside a Python worker.

A chunk is cut only where the tokenizer's own pre-tokenizer always cuts, so the joined chunk ids are
the ids of the whole text. Words recur, so most chunks come from a bounded in-worker memo instead of
the byte-pair merge loop; a chunk that doesn't is cut into runs of letters and of marks, which recur
more, and those go to the library's merge model. The memo has two generations: when the young one is
full it becomes the old one, and what is asked for again moves back, so that rare chunks push out only
each other. The memo changes speed only, never ids.
"""

from __future__ import annotations

import re
from array import array

#: White space as the tokenizers' regular expressions see it (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RARE = re.compile("[" + SPACE.replace("\t-\r ", "\t\v-\r") + "]")
_CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Entries of one of a worker's two generations, and the longest chunk it keeps.
MEMO_ENTRIES = 350_000
MEMO_CHUNK = 48

_ENCODERS: dict[tuple[str, bool], "ChunkEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a printable character: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = _byte_letters()
#: Chunks of letters and ASCII punctuation (no apostrophe, which may begin a contraction), and their
#: pieces: the tokenizers cut just between those, so a piece goes straight to the merge model.
_MARKS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_SIMPLE = re.compile(rf" ?(?:[^\W\d_]|[{_MARKS}])+")
_PIECES = re.compile(rf" ?[^\W\d_]+| ?[{_MARKS}]+")


class _Memo(dict):
    """chunk -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self._old: dict[str, bytes] = {}
        self._encode = tokenizer.encode
        self._merge = tokenizer.model.tokenize
        self._normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else None

    def whole(self, chunk: str) -> bytes:
        return array("I", self._encode(chunk, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A run of letters or of marks, normalised: one unit of the pre-tokenizer."""
        letters = piece.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self._merge(letters)]).tobytes()

    def _ids(self, chunk: str) -> bytes:
        text = chunk
        if self._normal:
            if "Σ" in chunk:  # its lower case depends on what stands beside it
                return self.whole(chunk)
            text = (chunk.lower() if chunk.isascii() or max(chunk) <= "\xff" else self._normal(chunk)).strip(" ")
        core = text[1:] if text[:1] == " " else text
        if core.isalpha():
            return self._piece(text)
        if not _SIMPLE.fullmatch(text):
            return self.whole(chunk)
        if len(pieces := _PIECES.findall(text)) > 1:
            return b"".join([self[x] for x in pieces])
        return self.whole(chunk) if core[:1].isalnum() else self._piece(text)

    def __missing__(self, chunk: str) -> bytes:
        ids = self._old.get(chunk)
        if ids is None:
            if len(chunk) > MEMO_CHUNK:
                return self.whole(chunk)
            if "\n" in chunk and len(inner := _CHUNKS.findall(chunk)) > 1:  # e.g. "end.\nNext": its parts recur
                return b"".join([self[x] for x in inner])
            ids = self._ids(chunk)
        if len(self) >= MEMO_ENTRIES:
            self._old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


class ChunkEncoder:
    """ids of whole texts.

    ``spaced``: the tokenizer attaches one leading space to a word (byte-level BPE); otherwise it drops
    white space. Null text counts as empty.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._memo = _Memo(tokenizer)
        self._memo[""] = b""
        self._spaced = spaced

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        if not text:
            return b""
        memo = self._memo
        if any(t in text for t in self._special):  # a special token also ends the run of white space before it
            return memo.whole(text)
        ids = memo.__getitem__
        if not self._spaced:
            return b"".join(map(ids, text.replace("\n", " ").split(" ")))
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or "\0" in text or _RARE.search(text):
            return b"".join(map(ids, _CHUNKS.findall(text)))
        # Single spaces and line ends only: a space begins a word, a line end is a piece of its own.
        return b"".join(map(ids, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))


def encoder(path: str, spaced: bool) -> ChunkEncoder:
    """The worker's encoder for this vocabulary file, kept between tasks."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = ChunkEncoder(path, spaced)
    return _ENCODERS[path, spaced]
