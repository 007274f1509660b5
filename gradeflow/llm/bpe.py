"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

A text is fed in slices. Pieces between the breaks of the file's pattern are final as soon as the few
characters behind them are known. Within a long piece, tokens are emitted once no continuation can
change them: ``lookahead`` bounds, from the merge list alone, how far to the left of unread bytes a
merge can differ. So an encoder holds a window of a few thousand bytes, however long the text or a
piece of it. Decoding maps ids to bytes and these to text through a state of at most three bytes.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokenizing import byte_alphabet, read_file

#: Characters fed at once, ids decoded at once, characters from which on a piece goes through the window, pieces in a worker's memo (two generations of some 200 bytes a piece).
SLICE, IDS, LONG, PIECES = 1 << 16, 1 << 15, 512, 250_000

NEVER = 1 << 60


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes before unread input beyond which the tokens of a merge list, in the order of its ranks, are certain.

    Run two texts with a common start side by side, rank by rank. Their tokens agree up to a border,
    first the end of the common start. The merge of ``u`` and ``v`` moves it left, by the length of
    ``u``, only where ``u`` ends at the border and ``v`` starts there. Whatever starts there later has the left part of
    the merge that put the border there among its own leftmost parts, and ranks only rise. The
    longest such chain is found in one pass over the merges.
    """
    first: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}
    for u, v in merges:
        before, part = 0, v
        while part:
            before = max(before, reach.get(part, 0))
            part = first.get(part, b"")
        reach[u] = max(reach.get(u, 0), before + len(u))
        first[u + v] = u
    return max(reach.values(), default=0)


class Merges:
    """The merge list of a ``tokenizers`` byte-level BPE file.

    A list whose merges use tokens not made before, or make one twice, has no such bound and is refused.
    """

    def __init__(self, spec: str):
        data, alphabet = json.loads(spec), byte_alphabet()
        model, breaks = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or breaks["type"] != "ByteLevel" or breaks["add_prefix_space"] or not breaks["use_regex"] or data["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        if any(t[k] for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with conditions aren't supported")
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ids = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        self.bytes = {i: token for token, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [tuple(bytes(alphabet[c] for c in part) for part in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        known = {bytes([b]) for b in range(256)}
        for u, v in pairs:
            if u not in known or v not in known or u + v in known:
                raise ValueError("merges must use tokens made before them, and make each once")
            known.add(u + v)
        self.letter = [ids[bytes([b])] for b in range(256)]
        self.rank = {(ids[u], ids[v]): r for r, (u, v) in enumerate(pairs)}
        self.made = [ids[u + v] for u, v in pairs]
        self.lookahead = lookahead(pairs)
        self.longest = max(map(len, known))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a whole piece: the merge of the lowest rank first, the leftmost of equal ones."""
        ids, rank = [self.letter[b] for b in piece], self.rank.get
        ranks = [rank(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < NEVER:
            i = ranks.index(low)
            ids[i : i + 2] = [self.made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NEVER)
        return ids


class Window:
    """Tokens of one piece of any length, given in parts: what lies more than the lookahead before the end is emitted."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""
        self.size = 2 * merges.lookahead + merges.longest

    def feed(self, part: bytes) -> Iterator[int]:
        for s in range(0, len(part), self.size):
            self.held += part[s : s + self.size]
            if len(self.held) < self.size:
                continue
            certain, at = len(self.held) - self.merges.lookahead, 0
            for i in self.merges.merge(self.held):
                end = at + len(self.merges.bytes[i])
                if end > certain:
                    break
                yield i
                at = end
            self.held = self.held[at:]

    def finish(self) -> Iterator[int]:
        held, self.held = self.held, b""
        yield from self.merges.merge(held)


class Memo(dict):
    """String -> ids as bytes, worked out where missing; long strings aren't kept, and the older half goes once ``PIECES`` new ones are in."""

    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.work(text)
            if len(text) > LONG:
                return ids
        if len(self) >= PIECES:
            self.older = dict(self)
            self.clear()
        self[text] = ids
        return ids


def packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def classes(spec: str) -> tuple[str, str]:
    """Letters and numbers of the library as sets of ``regex``: the two know different versions of Unicode.

    Characters that are alike to ``regex`` are put to the library as one run, which it breaks where it knows better.
    """
    from tokenizers import Tokenizer

    breaks = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
    alike = {name: "".join(regex.findall(name, "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))) for name in (r"\p{L}", r"\p{N}", r"[^\p{L}\p{N}\s]")}
    found = []
    for mark, name in (("x", r"\p{L}"), ("1", r"\p{N}")):
        more, less = "", ""
        for other, chars in alike.items():
            for _, (a, b) in breaks(chars):
                member = len(breaks(mark + chars[a])) == 1
                if member and other != name:
                    more += chars[a:b]
                elif not member and other == name:
                    less += chars[a:b]
        base = f"[{name}{spans(more)}]" if more else name
        found.append(f"[{base}--[{spans(less)}]]" if less else base)
    return tuple(found)


def spans(chars: str) -> str:
    """Ranges of a set of characters."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Encoder:
    """Ids of a text that is fed in slices, as little-endian unsigned 32-bit bytes."""

    def __init__(self, merges: Merges, sets: tuple[str, str]):
        letter, number = sets
        rest = rf"[^\s{letter}{number}]"
        build = lambda p: regex.compile(p, regex.V1)
        # The pattern of byte-level BPE files, letters put first, which changes no match
        self.piece = build(rf" ?{letter}+|'s|'t|'re|'ve|'m|'ll|'d| ?{number}+| ?{rest}+|\s+(?!\S)|\s+")
        # how a piece starts, and how it goes on
        self.runs = [(build(f" ?{kind}"), build(f"{kind}+")) for kind in (letter, number, rest)] + [(build(r"\s"), build(r"\s+(?!\S)"))]
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) or r"(?!)")
        self.ids = {s: packed([i]) for s, i in merges.special.items()}
        # the end of a match is decided by two characters behind it, and by a special string that starts there
        self.margin = 3 + max(map(len, merges.special), default=0)
        # a piece starts at every space but one between white space
        self.within = re.compile(r"\s (?:\s|\Z)")
        self.merges, self.window = merges, Window(merges)
        self.pieces = Memo(self._piece)
        self.words = Memo(lambda word: b"".join(map(self.pieces.__getitem__, self.piece.findall(" " + word))))
        self.rest, self.run = "", None

    def _piece(self, piece: str) -> bytes:
        if len(piece) <= LONG:
            return packed(self.merges.merge(piece.encode()))
        window = Window(self.merges)
        return b"".join(packed(window.feed(piece[s : s + SLICE].encode())) for s in range(0, len(piece), SLICE)) + packed(window.finish())

    def feed(self, text: str, last: bool = False) -> bytes:
        """Ids that are certain by now; with ``last`` all that are left, and the encoder is as new."""
        text, at, out = self.rest + text, 0, []
        for m in self.special.finditer(text):
            self._take(text, at, m.start(), True, out)
            out.append(self.ids[m.group()])
            at = m.end()
        at = self._take(text, at, len(text), last, out)
        self.rest = "" if last else text[at:]
        return b"".join(out)

    def _take(self, text: str, at: int, end: int, last: bool, out: list[bytes]) -> int:
        """Append the ids of text[at:end], with ``last`` to its end, else as far as they are certain; how far that was."""
        sure = end if last else max(at, end - self.margin)
        if self.run:
            m = self.run.match(text, at, end)
            stop = m.end() if m else at
            out.append(packed(self.window.feed(text[at : min(stop, sure)].encode())))
            if stop > sure:
                return sure
            out.append(packed(self.window.finish()))
            at, self.run = stop, None
        if last:
            self._whole(text[at:end], out)
            return end
        cut = text.rfind(" ", at, sure)
        if cut > at and not text[cut + 1].isspace():
            self._whole(text[at:cut], out)
            at = cut
        for m in self.piece.finditer(text, at, end):
            if m.end() > sure:
                break
            out.append(self.pieces[m.group()])
            at = m.end()
        if sure - at > LONG:  # within a long piece, which goes on as a run of one class
            self.run = next(run for start, run in self.runs if start.match(text, at))
            out.append(packed(self.window.feed(text[at:sure].encode())))
            return sure
        return at

    def _whole(self, text: str, out: list[bytes]) -> None:
        """Append the ids of a text that ends where a piece does: word by word, or piece by piece where spaces stand between white space."""
        if self.within.search(text):
            out.extend(map(self.pieces.__getitem__, self.piece.findall(text)))
        else:
            first, *words = text.split(" ")
            out.extend(map(self.pieces.__getitem__, self.piece.findall(first)))
            out.extend(map(self.words.__getitem__, words))

    def encode(self, utf8) -> bytes:
        """Ids of a whole text in UTF-8, given as a buffer; wrong bytes count as U+FFFD."""
        if len(utf8) <= SLICE:
            return self.feed(str(utf8, "utf-8", "replace"), True)
        text, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        for s in range(0, len(utf8), SLICE):
            out.append(self.feed(text.decode(utf8[s : s + SLICE])))
        out.append(self.feed(text.decode(b"", True), True))
        return b"".join(out)


class Decoder:
    """Text of ids given in parts: their bytes run through a UTF-8 state machine, ill-formed ones give U+FFFD; unknown ids nothing."""

    def __init__(self, merges: Merges):
        self.bytes = [merges.bytes.get(i, b"") for i in range(max(merges.bytes) + 1)]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        ids = ids[ids < len(self.bytes)]
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids.tolist())), last)

    def decode(self, ids: bytes) -> str:
        ids = np.frombuffer(ids, "<u4")
        parts = [self.feed(ids[s : s + IDS]) for s in range(0, len(ids), IDS)]
        parts.append(self.feed(ids[:0], True))
        self.state.reset()
        return "".join(parts)


@lru_cache(maxsize=2)
def encoder(spec: str, sets: tuple[str, str]) -> Encoder:
    """One a Python worker, so that its memo serves all of the worker's tasks."""
    return Encoder(Merges(spec), sets)


@lru_cache(maxsize=2)
def decoder(spec: str) -> Decoder:
    return Decoder(Merges(spec))


def each(rows: DataFrame, column: str, kind: pa.DataType, ddl: str, work: Callable[[], Callable]) -> DataFrame:
    """``rows`` with ``column`` mapped value by value, nulls kept; ``work`` gives the mapping in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = work()
        for batch in batches:
            at = batch.schema.get_field_index(column)
            values = pa.array([None if x is None else change(x) for x in (v.as_buffer() for v in batch.column(at))], kind)
            yield batch.set_column(at, pa.field(column, kind), values)

    schema = ", ".join(f"`{n}` {ddl if n == column else t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text by the ``tokenizers`` file at ``path``, as little-endian unsigned 32-bit bytes.

    No special tokens are added; special strings inside texts become their ids. Null and empty texts
    have no ids; repeated rows and null doc_ids are rows like others; other columns are left out; an
    empty table gives no rows. A text of any length, or of one unbroken run, takes the same memory
    besides the row itself.
    """
    small_batches(docs.sparkSession)
    spec = read_file(path).decode()
    sets = classes(spec)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("ids"))
    return each(rows, "ids", pa.binary(), "binary", lambda: encoder(spec, sets).encode)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (ids as of ``encode_documents``, and any columns) with ``text`` in place of ``ids``.

    Special tokens give their strings; bytes that are no UTF-8 give U+FFFD, as the library has it; null ids null.
    """
    small_batches(encoded.sparkSession)
    spec = read_file(path).decode()
    return each(encoded.withColumnRenamed("ids", "text"), "text", pa.string(), "string", lambda: decoder(spec).decode)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode_documents`` gives, and what ``decode_documents`` makes of it. Odd rows as there."""
    ids = encode_documents(docs, path)
    both = decode_documents(ids.withColumn("n_tokens", (F.length("ids") / 4).cast("long")).withColumn("ids_sha256", F.sha2("ids", 256)), path)
    return both.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
