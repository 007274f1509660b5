"""Encoders for use inside tasks: exact ids and counts of public tokenizers, with a bounded memo of short pieces."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np

SPACED = re.compile(r" +[^ ]*")
#: Pieces in a worker's memo, some 120 bytes each, before it starts afresh.
MEMO = 200_000


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level BPE files: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level BPE given as a ``tokenizers`` JSON file, as little-endian 32-bit bytes.

    The vocabulary of the JSON, taken as ranks, gives the same ids through ``tiktoken`` five times
    as fast (a test holds the two together); texts with special strings go through ``tokenizers``.
    """

    def __init__(self, spec: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        data, alphabet = json.loads(spec), byte_alphabet()
        self.special = [t["content"] for t in data["added_tokens"]]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in self.special}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_str(spec)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.bpe.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


class PieceCounter:
    """Token counts of a SentencePiece model, without begin or end tokens.

    If no vocabulary piece has a space mark after another character, merges never cross from a
    word into the spaces after it; counts of ``spaces + word`` then add up. Otherwise, and for
    texts that hold the mark itself, the library encodes the whole text.
    """

    MARK = "▁"

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.adds = not any(self.MARK in sp.id_to_piece(i).lstrip(self.MARK) for i in range(sp.get_piece_size())) and sp.normalize(" a  b ") == f"{self.MARK}{self.MARK}a{self.MARK}{self.MARK}b{self.MARK}"
        self.memo: dict[str, int] = {"": 0}
        self.last = len(sp.encode("a ")) - len(sp.encode("a"))

    def parts(self, text: str) -> list[str]:
        """Pieces of ``spaces + word``, without the first space, that the model itself puts before a text."""
        if "  " not in text and text[:1] != " ":
            return text.split(" ")
        return [p[1:] for p in SPACED.findall(" " + text)]

    def counts(self, texts: list[str]) -> list[int]:
        odd = {i for i, t in enumerate(texts) if not self.adds or self.MARK in t or "\0" in t}
        parts = [() if i in odd else self.parts(t) for i, t in enumerate(texts)]
        if len(self.memo) > MEMO:
            self.memo = {"": 0}
        new = [p for p in set().union(*parts) if p not in self.memo]
        self.memo.update(zip(new, map(len, self.library.encode(new, num_threads=1)), strict=True))
        count = self.memo.__getitem__
        return [len(self.library.encode(t)) if i in odd else sum(map(count, p)) + self.last * (len(p) > 1 and not p[-1]) for i, (t, p) in enumerate(zip(texts, parts, strict=True))]


class LibraryCounter:
    """Token counts of a ``tokenizers`` JSON file; special strings inside texts as by its default."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec.decode())
        self.library.no_truncation()
        self.library.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def byte_bpe(spec: str, pattern: str) -> ByteBpe:
    """One encoder a Python worker."""
    return ByteBpe(spec, pattern)


@lru_cache(maxsize=4)
def counter(content: bytes, kind: str) -> PieceCounter | LibraryCounter:
    return PieceCounter(content) if kind == "model" else LibraryCounter(content)


def read_file(path: str) -> bytes:
    """A vocabulary file (a few MB), read where the driver runs and sent to tasks with the function."""
    return Path(path).read_bytes()
