"""Byte-level BPE encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that never stand next to each other inside any token
of the vocabulary can never end up in one token, so a text may be cut between
them. A cut is used only where the pre-tokenizer of the vocabulary
provably has a boundary or can't notice it:

* before ASCII white space that follows a character that isn't white space
  (no alternative of the splitting pattern crosses it, and none looks back);
* between two ASCII letters whose left one doesn't follow an apostrophe (both
  sides are still runs of letters, and no contraction is torn).

The fragments are encoded independently (each distinct one once for as long as
a worker's bounded memory of fragments holds it) and their ids concatenated.
No fragment length is assumed: a text without cuts is one fragment. Fragments of
long-established characters go through the faster of two public libraries,
over the same vocabulary and splitting pattern; all others, and any that holds
an added token, through the one that reads the vocabulary file.

Null texts encode as empty; empty texts give no ids; rows are independent, so
repeated rows and repeated ids give repeated results, and other columns,
whatever their names, are passed through untouched, but for one that already
has the name of the result, which is replaced.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .hashing import give_back, raw_texts, slices

#: Fragments and ids that a worker remembers, in bytes; longer fragments aren't.
MEMO_BYTES, MEMO_LONGEST = 64 << 20, 256
#: What an entry takes besides its bytes, about.
MEMO_ENTRY = 160
#: Fragments that are cut off a text at once.
AT_ONCE = 1 << 16

#: ASCII without control characters, U+00C0 to U+047F and U+4000 to U+8FFF:
#: every Unicode table agrees on what is a letter, a number or white space there.
SETTLED = re.compile(rb"(?:[\x09-\x0d\x20-\x7e]|[\xc3-\xd1][\x80-\xbf]|[\xe4-\xe8][\x80-\xbf]{2})*")
#: Fixed value: how this vocabulary was trained to split texts.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary
    file: printable Latin-1 bytes stand for themselves, the others for code
    points from 256 on, in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encoder and decoder over one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        added = self.tokenizer.get_added_tokens_decoder()
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *added]))
        inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            raw = bytes(alphabet[c] for c in token)
            self.token_bytes[i] = raw
            codes = np.frombuffer(raw, np.uint8)
            inside[codes[:-1], codes[1:]] = True
        ranks = {self.token_bytes[i]: i for i in vocab.values()}
        ranks |= {bytes([b]): ranks.get(bytes([b]), len(self.token_bytes) + b) for b in range(256)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values()) or "(?!)")
        for i, token in added.items():
            raw = token.content.encode()
            self.token_bytes[i] = raw
            codes = np.frombuffer(raw, np.uint8)
            inside[codes[:-1], codes[1:]] = True
        self.forced = ~inside
        self.memo: dict[bytes, bytes] = {}
        self.held = 0

        code = np.arange(256)
        self.space = (code == 32) | ((code >= 9) & (code <= 13))
        self.letter = ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128)
        # bytes below 28 that aren't tab to carriage return can be white space to some patterns
        self.solid = (code > 32) & (code < 127)

    def cuts(self, raw: bytes) -> np.ndarray:
        """Byte offsets, apart from both ends, at which the text is cut."""
        if len(raw) < 2:
            return np.empty(0, np.int64)
        b = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(self.forced.ravel()[b[:-1].astype(np.uint16) << np.uint16(8) | b[1:]])
        left, right = b[at], b[at + 1]
        before, before2 = b[np.maximum(at - 1, 0)], b[np.maximum(at - 2, 0)]
        # the left character isn't white space: printable ASCII, or the end of
        # a two-byte character from U+00C0, or of a three-byte one from U+4000
        tail = (before >= 0xC3) & (before < 0xE0) | (before >= 0x80) & (before < 0xC0) & (before2 >= 0xE4) & (before2 < 0xEE)
        solid = self.solid[left] | ((left >= 0x80) & (left < 0xC0) & tail)
        ok = self.space[right] & solid
        ok |= self.letter[left] & self.letter[right] & ((before != 0x27) | (at == 0))
        return at[ok] + 1

    def fragments(self, raw: bytes) -> Iterator[list[bytes]]:
        """Some fragments of a text at a time."""
        at = np.concatenate([[0], self.cuts(raw), [len(raw)]])
        for k in range(0, len(at) - 1, AT_ONCE):
            some = at[k : k + AT_ONCE + 1].tolist()
            yield [raw[s:e] for s, e in zip(some, some[1:], strict=False)]

    def encode_fragment(self, raw: bytes) -> bytes:
        text = raw.decode()
        if SETTLED.fullmatch(raw) and not self.added.search(text):
            return array("I", self.fast(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(map(self._ids, self.fragments(raw))) if raw else b"" for raw in texts]

    def _ids(self, parts: list[bytes]) -> bytes:
        memo = self.memo
        try:
            return b"".join([memo[f] for f in parts])
        except KeyError:
            pass
        made = []
        for f in parts:
            ids = memo.get(f)
            if ids is None:
                ids = self.encode_fragment(f)
                if len(f) <= MEMO_LONGEST:
                    if self.held > MEMO_BYTES:
                        memo.clear()
                        self.held = 0
                    memo[f] = ids
                    self.held += len(f) + len(ids) + MEMO_ENTRY
            made.append(ids)
        return b"".join(made)

    def decode(self, ids: bytes) -> str:
        get = self.token_bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _mapped(df: DataFrame, source: str, made: dict[str, T.DataType], work) -> DataFrame:
    """``df`` with the columns ``made``, which ``work`` makes of the column
    ``source``; one Python worker a task, which gives back at a task's end what
    its batches took."""
    df = df.drop(*[c for c in made if c != source])
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, kind) for c, kind in made.items()]])
    position = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch.column(position))], names=[f.name for f in schema])
        give_back()

    return df.mapInArrow(run, schema)


def _ids(column: pa.Array, path: str) -> list[bytes]:
    return codec(path).encode(raw_texts(column))


def _texts(ids: list[bytes | None], path: str) -> pa.Array:
    return pa.array([codec(path).decode(r or b"") for r in ids], pa.string())


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with a binary column ``ids``: the token ids of ``text``, each as a
    little-endian unsigned 32-bit integer."""
    path = path or default_path()
    return _mapped(df, text, {ids: T.BinaryType()}, lambda column: [pa.array(_ids(column, path), pa.binary())])


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with a string column ``text``: the text that ``ids`` stand for."""
    path = path or default_path()
    return _mapped(df, ids, {text: T.StringType()}, lambda column: [_texts(column.to_pylist(), path)])


def encode_decode(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """``decode(encode(df))`` in one pass: a task of both has a Python worker
    for each, with a vocabulary of its own each, and workers stay for a minute
    after their last task, beside those of what runs next."""
    path = path or default_path()

    def work(column: pa.Array) -> list[pa.Array]:
        made = _ids(column, path)
        return [pa.array(made, pa.binary()), _texts(made, path)]

    return _mapped(df, text, {ids: T.BinaryType(), decoded: T.StringType()}, work)
