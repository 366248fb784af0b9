"""Public tokenizers over Arrow batches: ids, offsets and decoding.

A byte-level vocabulary writes each byte as one printable character; ``byte_characters`` is that table. The
bytes of a text's tokens, put together, are the text's bytes, so byte offsets are sums of token lengths, and
character offsets follow from the bytes that begin a character.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"  #: folder of the vocabulary files on every executor
BYTE_BPE = "byte_bpe_50k.json"
CHUNK_BYTES = 1 << 19  #: bytes of text encoded at a time; bounds the memory of the encodings


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes are their own, the others take
    the code points from 256 on, in order."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ByteTokenizer:
    """One byte-level vocabulary of the ``tokenizers`` library, loaded once per Python process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        back = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in back for c in token):
                self.token_bytes[i] = bytes(back[c] for c in token)
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.longest = int(self.lengths.max())

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        for chunk in chunks(texts):
            for e in self.tokenizer.encode_batch_fast(chunk, add_special_tokens=False):
                yield e.ids

    def ends(self, ids: list[int]) -> np.ndarray:
        """The byte offset at which each token ends."""
        return np.cumsum(self.lengths[np.asarray(ids, np.int64)])

    def spans(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 character of each token; tokens that share a character both have it."""
        data = np.frombuffer(b"".join(self.token_bytes[i] for i in ids), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        ends = self.ends(ids)
        starts = ends - self.lengths[np.asarray(ids, np.int64)]
        return character[starts], character[ends - 1] + 1

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes of a character cut off at either end become U+FFFD."""
        return b"".join(self.token_bytes[i] for i in ids).decode("utf-8", "replace")

    def decode_parts(self, parts: Iterable[list[int]]) -> Iterator[str]:
        """Texts of consecutive slices: a character split between slices comes with the one that ends it,
        so the texts put together are the whole text."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield decoder.decode(b"".join(self.token_bytes[i] for i in ids))


def chunks(texts: list[str]) -> Iterator[list[str]]:
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > CHUNK_BYTES:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t) + 64
    if own:
        yield own


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def vocabulary_path(name: str = BYTE_BPE, folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}"


def readable(values: pa.Array) -> list[str]:
    """Texts of a binary column; null is an empty text, bytes that are no UTF-8 become U+FFFD."""
    return ["" if v is None else v.decode("utf-8", "replace") for v in values.to_pylist()]


def _lists(rows: Iterable[np.ndarray | list[int]], kind: pa.DataType) -> pa.Array:
    parts = [np.asarray(r, np.int64) for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]) if parts else np.zeros(1)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int64), pa.int64()).cast(kind))


def token_ids(text: Column, path: str | None = None) -> Column:
    """ARRAY<INT> of the ids of ``text``, without special tokens; their strings are ordinary text.

    Null and empty texts both have the empty array, so every row has ids. Texts are never cut: chunks are
    of whole texts, a longer one is a chunk of its own.
    """
    at = path or vocabulary_path()

    @F.arrow_udf("array<int>")
    def encode(values: pa.Array) -> pa.Array:
        return _lists(tokenizer(at).encode(readable(values)), pa.int32())

    return encode(text.cast("binary"))


def token_count(text: Column, path: str | None = None) -> Column:
    """INT number of tokens of ``text``; 0 for null and empty texts."""
    at = path or vocabulary_path()

    @F.arrow_udf("int")
    def count(values: pa.Array) -> pa.Array:
        return pa.array([len(ids) for ids in tokenizer(at).encode(readable(values))], pa.int32())

    return count(text.cast("binary"))


def token_spans(ids: Column, path: str | None = None) -> Column:
    """ARRAY<STRUCT<first, last>>: characters [first, last) of each token; null for null ids."""
    at = path or vocabulary_path()

    @F.arrow_udf("array<struct<first: int, last: int>>")
    def spans(values: pa.Array) -> pa.Array:
        own, rows = tokenizer(at), values.to_pylist()
        pairs = [own.spans(v) if v else (np.zeros(0, np.int64),) * 2 for v in rows]
        offsets = np.concatenate([[0], np.cumsum([len(a) for a, _ in pairs])]).astype(np.int32)
        flat = [np.concatenate([p[k] for p in pairs]).astype(np.int32) if pairs else np.zeros(0, np.int32) for k in (0, 1)]
        cells = pa.StructArray.from_arrays([pa.array(f) for f in flat], names=["first", "last"])
        return pa.ListArray.from_arrays(pa.array(offsets), cells, mask=pa.array([v is None for v in rows], pa.bool_()))

    return spans(ids)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of ids; null for null, empty for no ids."""
    at = path or vocabulary_path()

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        own = tokenizer(at)
        return pa.array([None if v is None else own.decode(v) for v in values.to_pylist()], pa.string())

    return decode(ids)


def decoded_slices(ids: Column, size: int, path: str | None = None) -> Column:
    """ARRAY<STRING>: texts of consecutive slices of ``size`` of a text's ids, with a character split between slices in the one
    that ends it; null for null, empty for no ids. Put together they are the whole text."""
    at = path or vocabulary_path()

    @F.arrow_udf("array<string>")
    def decode(values: pa.Array) -> pa.Array:
        own = tokenizer(at)
        parts = lambda v: [v[k : k + size] for k in range(0, len(v), size)]
        return pa.array([None if v is None else list(own.decode_parts(parts(v))) for v in values.to_pylist()], pa.list_(pa.string()))

    return decode(ids)
