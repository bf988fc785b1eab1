"""Token ids of whole texts by the files of the tokenizers library.

A text is cut before each space that something other than white space follows. The pre-tokenizers of the supported vocabularies always end
a piece there, so the chunks can be encoded apart. Texts go through in slices of SLICE bytes; Arrow splits a slice and gives its distinct chunks,
each of these is encoded once, and the ids of all texts are gathered by number. So nothing is kept from one slice to the next,
and a worker's memory is that of a slice, or of one text that is longer.

Chunks of Latin letters, numbers and marks are split by the classes of their characters, and the merges of the vocabulary's file are made on
all of them at once (merges.py), for the library takes some 20 microseconds for each. All others go to the library: chunks with other letters,
apostrophes (of which the patterns make pieces of their own) or more than LONGEST bytes.

A null text is an empty one, which has no ids. The strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .merges import Merges

SLICE, LONGEST, BATCH = 4_000_000, 96, 1000
#: A space that stands before white space or the end: no place to cut at; and one that is.
INSIDE = r" ([\t-\r\x1c-\x20\x{85}\x{a0}\p{Z}]|$)"
CUT = re.compile(r" (?=\S)")
LETTER, NUMBER, SPACE, MARK = range(4)


def classes() -> np.ndarray:
    """The class of each character of Latin-1 in the vocabularies' patterns."""
    kinds = [(r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE), ("(?s).", MARK)]
    return np.array([next(k for p, k in kinds if regex.match(p, chr(c))) for c in range(256)], np.uint8)


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones of Latin-1 stand for themselves, others for letters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def contents(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of large strings one after another, and the length of each."""
    edges = np.frombuffer(strings.buffers()[1], "<i8", len(strings) + 1, 8 * strings.offset)
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data else np.zeros(0, np.uint8), np.diff(edges)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] times, then from starts[1] on, and so forth."""
    before, n = np.cumsum(counts) - counts, int(counts.sum())
    small = np.int32 if max(n, int((starts + counts).max(initial=0))) < 2**31 else np.int64
    return np.repeat((starts - before).astype(small), counts) + np.arange(n, dtype=small)


class Tokens:
    """spaced: a space belongs to the piece after it, and other white space is a piece. Otherwise white space is dropped, each number is a
    piece, case doesn't matter, and the last byte of a piece has a symbol of its own: the two kinds of byte-level files that are supported."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path) as f:
            model = json.load(f)
        vocabulary, suffix = model["model"]["vocab"], model["model"]["end_of_word_suffix"] or ""
        self.spaced = not suffix
        if self.spaced != (model["normalizer"] is None) or model["model"]["ignore_merges"] or model["model"]["dropout"]:
            raise ValueError(f"{path} is of an unsupported kind")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.merges = Merges(np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]), max(vocabulary.values()) + 1)
        self.inner, self.last = (np.array([vocabulary[c + s] for c in byte_letters()], np.int32) for s in ("", suffix))
        self.classes = classes()

    def _pieces(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first ids of the pieces of chunks (their bytes and lengths), the number of ids of each piece, and of pieces of each chunk."""
        follows = (data & 0xC0) == 0x80
        second = np.append(data[1:], 0) & 0x3F
        char = np.where(data < 0x80, data, (data & 3) << 6 | second)
        kind = self.classes[char]
        kind[follows] = kind[np.flatnonzero(follows) - 1]
        first = np.zeros(len(data), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        new = np.append(True, kind[1:] != kind[:-1])[: len(data)] | first
        if self.spaced:
            # what follows the space in front of a chunk is in one piece with it
            lead = np.flatnonzero(first & (data == 0x20))
            lead = lead[lead + 1 < len(data)]
            new[lead + 1] = first[lead + 1]
            # of white space in front of something else the last is a piece of its own
            space = kind == SPACE
            ends = np.flatnonzero(space & np.append(~space[1:] & ~first[1:], False))
            ends -= follows[ends]
            new[ends] = True
        else:
            new |= (kind == NUMBER) & ~follows
            data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
            capital = follows & (np.append(0, data[:-1])[: len(data)] == 0xC3) & (data <= 0x9E) & (data != 0x97)
            data[capital] += np.uint8(32)
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(data)))
        ids = self.inner[data]
        ids[at + n - 1] = self.last[data[at + n - 1]]
        chunk = np.repeat(np.arange(len(sizes)), sizes)[at]
        if not self.spaced:
            kept = kind[at] != SPACE
            ids, at, n, chunk = ids[np.repeat(kept, n)], at[kept], n[kept], chunk[kept]
        return ids, n, np.bincount(chunk, minlength=len(sizes))

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks, and for each chunk the place of its first id and their number."""
        data, sizes = contents(chunks)
        odd = np.append(0, np.cumsum((data >= 0xC4) | (data == 0x27)))
        ends = np.cumsum(sizes)
        plain = (odd[ends] == odd[ends - sizes]) & (sizes <= LONGEST)
        ids, n, pieces = self._pieces(data[np.repeat(plain, sizes)], sizes[plain])
        ids, n = self.merges.encode(ids, n)
        total = np.append(0, np.cumsum(n))
        last = np.cumsum(pieces)
        count = np.zeros(len(chunks), np.int64)
        count[plain] = total[last] - total[last - pieces]
        others, found = chunks.filter(pa.array(~plain)).to_pylist(), []
        for lo in range(0, len(others), BATCH):
            found += [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(others[lo : lo + BATCH], add_special_tokens=False)]
        count[~plain] = [len(f) for f in found]
        start = np.zeros(len(chunks), np.int64)
        start[plain] = np.cumsum(count[plain]) - count[plain]
        start[~plain] = len(ids) + np.cumsum(count[~plain]) - count[~plain]
        return np.concatenate([ids, *found]), start, count

    def _split(self, lists: pa.Array) -> list[np.ndarray]:
        """The ids of texts, each a list of its chunks."""
        edges = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        # what stands at the start of a text has no space in front of it
        heads = words.take(pa.array(edges[:-1])).cast(pa.large_string()).dictionary_encode()
        chunks = words.dictionary
        if self.spaced:
            chunks = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), chunks, pa.scalar(" ", pa.large_string()))
        ids, start, count = self._chunks(pa.concat_arrays([chunks, heads.dictionary]))
        at = np.asarray(words.indices).astype(np.int64)
        at[edges[:-1]] = len(chunks) + np.asarray(heads.indices)
        count = count[at]
        ids = ids[spread(start[at], count)]
        ends = np.append(0, np.cumsum(count))[edges]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        inside = np.asarray(pc.match_substring_regex(texts, INSIDE))
        out: list = [None] * len(texts)
        for chosen in (~inside, inside):
            if chosen.any():
                part = texts.filter(pa.array(chosen))
                lists = pa.array([CUT.split(t) for t in part.to_pylist()], pa.list_(pa.large_string())) if chosen is inside else pc.split_pattern(part, " ")
                for i, ids in zip(np.flatnonzero(chosen), self._split(lists)):
                    out[i] = ids
        return out

    def slices(self, texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, list[np.ndarray]]]:
        """The number of the first text of each slice (of most bytes, or one text), and the ids of its texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.asarray(pc.binary_length(texts)).cumsum() if len(texts) else np.zeros(0, np.int64)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
            yield lo, self._slice(texts.slice(lo, hi - lo))
            lo = hi

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """As little-endian unsigned 32-bit integers."""
        return [x.astype("<u4").tobytes() for _, s in self.slices(pa.array(texts, pa.large_string())) for x in s]


_loaded: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """This worker's vocabulary of a file."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]
