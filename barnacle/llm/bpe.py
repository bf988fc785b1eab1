"""Byte-level BPE by a monoid tree reduction.

A piece of the text (a match of the vocabulary's pattern) is encoded by halves, down to single bytes. Two encoded neighbours
are joined by encoding the bytes of a window around the seam anew, with one token of each side at first and twice as many
each time, until the tokens outside the window can't change. That holds when the window's outermost tokens are compatible with
their neighbours outside: two tokens are compatible if encoding their joined bytes gives just these two, and a
sequence in which all neighbours are compatible is the encoding of its bytes. Decoding joins the bytes of blocks of ids up
a tree.

A piece that is itself a token of the vocabulary gets that token, reachable by merges or not. Null and empty texts have no ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Entries of the memo tables of one Python worker, and the longest piece that they hold.
MEMO, SHORT = 1_000_000, 24
#: Chunks and pieces whose ids one Python worker keeps, the longest of them, and texts in a block.
CHUNKS, PIECES, LONGEST, BLOCK = 600_000, 800_000, 64, 400
LEAF = 4096
#: A space between white space and white space or the end.
JOINED = re.compile(r"(?<=\s) (?=\s|\Z)")


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.memo: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_file(cls, path: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short window: the pair of the lowest rank first, the leftmost of equals."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            found = [(ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(found)
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.compatible(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[-k:] + right[:k])))
            if (k >= len(left) or self.compatible(left[-k - 1], window[0])) and (k >= len(right) or self.compatible(window[-1], right[k])):
                return left[:-k] + window + right[k:]
            k *= 2

    def tree(self, data: bytes) -> list[int]:
        if (known := self.memo.get(data)) is not None:
            return known
        if len(data) < 2:
            out = [self.ranks[data]] if data else []
        else:
            half = len(data) // 2
            out = self.join(self.tree(data[:half]), self.tree(data[half:]))
        if len(data) <= SHORT:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[data] = out
        return out

    def piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return self.tree(data) if whole is None else [whole]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class TokenCache:
    """Ids of texts as little-endian unsigned 32-bit integers; encode gets lists of pieces. A chunk is what stands between two spaces, with the
    space before it; pieces never reach over its ends, but for a space with white space on both sides, and a text that has one is split whole."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pattern: str):
        self.encode, self.pattern = encode, regex.compile(pattern)
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        return {p: np.array(i, "<u4").tobytes() for p, i in zip(pieces, self.encode(pieces))}

    def _block(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        # a chunk with a space in front is kept without it; what starts a text has a key of its own
        split = [[t] if not t or JOINED.search(t) else t.split(" ") for t in texts]
        new = set(chain.from_iterable(s[1:] for s in split)) - self.chunks.keys()
        found = {c: self.pattern.findall(" " + c) for c in new}
        heads = [self.pattern.findall(s[0]) for s in split]
        learnt = self._learn(list({p for ps in chain(found.values(), heads) for p in ps} - self.pieces.keys()))
        known = self.pieces
        known.update(learnt)
        chunks = self.chunks
        chunks.update((c, b"".join([known[p] for p in ps])) for c, ps in found.items())
        out = [b"".join([*(known[p] for p in h), *map(chunks.__getitem__, s[1:])]) for h, s in zip(heads, split)]
        for kept, keys in ((known, learnt), (chunks, found)):
            for k in keys:
                if len(k) > LONGEST:
                    del kept[k]
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(texts), BLOCK):
            out += self._block([t or "" for t in texts[lo : lo + BLOCK]])
        return out


_loaded: dict[tuple[str, str], tuple[Bpe, TokenCache]] = {}


def loaded(path: str, pattern: str) -> tuple[Bpe, TokenCache]:
    if (path, pattern) not in _loaded:
        bpe = Bpe.from_file(path)
        _loaded[path, pattern] = bpe, TokenCache(lambda pieces: [bpe.piece(p) for p in pieces], pattern)
    return _loaded[path, pattern]


def encode_decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded (bytes) of every row of docs (doc_id, text)."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = loaded(ranks, pattern)
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.slice(at, BLOCK)
                ids = cache.ids(part["text"].to_pylist())
                decoded = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield pa.record_batch([part["doc_id"], pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partition, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """encode_decode() with the digests in place of ids and bytes, made beside them so that neither leaves the worker."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = loaded(ranks, pattern)
        for b in batches:
            n, a, d = [], [], []
            for at in range(0, len(b), BLOCK):
                for ids in cache.ids(b["text"].slice(at, BLOCK).to_pylist()):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    d.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.record_batch([b["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partition, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op5_bpe_tree": op5_bpe_tree}
ORACLES: dict[str, str] = {}
