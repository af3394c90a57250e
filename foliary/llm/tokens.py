"""Token ids of whole texts, for the operators that store, count or pack them.

The `tokenizers` library encodes about 1 MB a second and core on whole texts, most of it
spent on words it has just seen. Byte-level vocabularies split a text before every single
space that stands between two other characters, so a text's ids are those of its
space-separated chunks one after another. Each task keeps the ids of the chunks it has
met, within a bound, and asks the library for new ones only.

A text that holds the string of an added token, such as the end mark, is encoded as a whole,
as the library does by default: the string becomes that token. With `ordinary` it is text
like any other, so that no text gives the end mark's id.
"""

from __future__ import annotations

import ctypes
import gc
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: Chunks that a task remembers (about 200 bytes each); at the bound it starts anew.
REMEMBERED = 1_200_000
LONGEST = 64
CUT = re.compile(r"(?<=\S) (?=\S)")
MARKS = ".,;:!?|"
#: How byte-level vocabularies split a text into the pieces that are merged.
PIECE = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Only chunks of these letters and ASCII are split here, as Unicode versions may differ on others.
COMMON = re.compile(r"[\x00-\x1b\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _char_of_byte() -> list[str]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Odd(Exception):
    """A chunk with white space at its edges: the text is to be cut with more care."""


class Chunks(dict):
    """Ids, as bytes, of ' ' + chunk."""

    def __init__(self, path: str, ordinary: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (ordinary and t.special)]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model, self.chars = self.tokenizer.model, _char_of_byte()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.tokenize = self.model.tokenize
        self.written = [k.to_bytes(self.dtype.itemsize, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.space = self.chars[32]
        self.pieces: dict[str, bytes] = {}
        self.most = REMEMBERED
        self.marks = {m: self.plain(m) for m in MARKS}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def merged(self, written: str) -> bytes:
        """The library's ids of one piece, which needs no splitting."""
        return b"".join([self.written[t.id] for t in self.tokenize(written)])

    def piece(self, piece: str) -> bytes:
        if piece[0] == " " and piece[1:].isalpha():
            return self[piece[1:]]
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.merged("".join(map(self.chars.__getitem__, piece.encode())))
            if len(piece) <= LONGEST:
                if len(self.pieces) >= self.most // 10:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            if chunk.isascii():
                ids = self.merged(self.space + chunk)
            elif COMMON.fullmatch(chunk):
                ids = self.merged(self.space + "".join(map(self.chars.__getitem__, chunk.encode())))
            else:
                ids = self.plain(f" {chunk}")
        elif chunk[:-1].isalpha() and chunk[-1] in self.marks:
            ids = self.get(chunk[:-1])
            if ids is None:  # a new word is remembered once
                return self[chunk[:-1]] + self.marks[chunk[-1]]
            ids += self.marks[chunk[-1]]
        elif not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Odd
        elif COMMON.fullmatch(chunk):
            return b"".join(map(self.piece, PIECE.findall(f" {chunk}")))
        else:
            ids = self.plain(f" {chunk}")
        if len(chunk) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        try:
            if text[:1].isspace() or first[-1:].isspace() or (rest and not first):
                raise Odd
            return b"".join([self.plain(first), *map(self.__getitem__, rest)])
        except Odd:
            chunks = CUT.split(text)
            last = [self.plain(f" {chunks.pop()}")] if len(chunks) > 1 else []
            return b"".join([self.plain(chunks[0]), *map(self.__getitem__, chunks[1:]), *last])


@lru_cache(maxsize=2)
def _chunks(path: str, ordinary: bool = False) -> Chunks:
    return Chunks(path, ordinary)


def vocabulary_size(path: str) -> int:
    return _chunks(path).tokenizer.get_vocab_size()


def token_id(path: str, token: str) -> int:
    return _chunks(path).tokenizer.token_to_id(token)


def encode(texts: list[str | None], path: str, end: int | None, ordinary: bool = False, remembered: int | None = None) -> list[np.ndarray]:
    """Ids of each text (null: empty), with the id `end` appended unless it is None; 16 bits
    each if the vocabulary fits, else 32. ordinary: added tokens' strings are text. remembered:
    chunks that the task keeps at most, for jobs whose workers hold much else."""
    chunks = _chunks(path, ordinary)
    chunks.most = remembered or REMEMBERED
    tail = b"" if end is None else np.array([end], dtype=chunks.dtype).tobytes()
    collects = gc.isenabled()
    gc.disable()  # nothing here is part of a cycle, and the collector would look through all that is remembered
    try:
        return [np.frombuffer(chunks.text(t or "") + tail, dtype=chunks.dtype) for t in texts]
    finally:
        if collects:
            gc.enable()


def release() -> None:
    """Gives memory that a task no longer uses back to the system, as Python workers go on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
