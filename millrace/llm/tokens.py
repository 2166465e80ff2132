"""Encoding texts with a public byte-level BPE, by dynamic programming over byte prefixes.

Every byte prefix of a piece has exactly one valid encoding; it is determined by its last token, so one token a prefix
is stored. A prefix's last token is the one token that ends it, is itself an encoding, and fits behind the last token
of what is before it (two tokens fit if encoding their joined bytes gives just those two). Appending bytes only
appends to that table, and the encoding is read from its end. Text is cut into pieces by the vocabulary's pattern first;
since a piece never leads from a line break into what is not white space, lines are encoded and remembered on their own.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.core.runtime import map_arrow

#: places of vocabularies unless a query says otherwise; the files are never copied
TOKENIZER_DIR = "/opt/tokenizers"
#: the pattern that cuts text into pieces before the merges (fixed value of the vocabulary)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: white space by the Unicode property, which leaves out the separators U+001C to U+001F
_PATTERN = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+")
_LINES = re.compile(r"(?<=\n)(?=\S)")
#: remembered texts and their longest length; only speed depends on them
_REMEMBERED, _LONGEST = 200_000, 400


class Vocabulary:
    """Tokens by rank; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = _PATTERN):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pieces = regex.compile(pattern).findall
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the neighbours of least rank until none can be merged."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            least, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if least == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, t: int) -> bool:
        """Whether token t is the encoding of its own bytes."""
        if (known := self._whole.get(t)) is None:
            known = self._whole[t] = self.merged(self.bytes[t]) == [t]
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can stand behind token a."""
        key = a << 32 | b
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 4_000_000:
                self._fits.clear()
            known = self._fits[key] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known


class Prefixes:
    """The last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", array("l", [-1])
        self.extend(data)

    def extend(self, more: bytes) -> None:
        """Append bytes; what is stored stays as it is."""
        v, old = self.vocabulary, len(self.data)
        self.data += more
        data, last, ranks = self.data, self.last, v.ranks
        for end in range(old + 1, len(data) + 1):
            for start in range(max(0, end - v.longest), end):
                t = ranks.get(data[start:end])
                if t is not None and v.whole(t) and (start == 0 or v.fits(last[start], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def cut(self, length: int) -> None:
        """Keep the first `length` bytes."""
        self.data = self.data[:length]
        del self.last[length + 1 :]

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class _Memory(dict):
    """What a function gave for short texts; emptied when full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str) -> bytes:
        made = self.make(text)
        if len(text) <= _LONGEST:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[text] = made
        return made


class Encoder:
    """Texts to ids, packed as 32-bit integers of the machine's order."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._piece = _Memory(lambda p: array("i", Prefixes(vocabulary, p.encode("utf-8", "replace")).ids()).tobytes())
        self._line = _Memory(self._line_ids)

    def _line_ids(self, line: str) -> bytes:
        # x stands for what follows the line break, and is a piece of its own
        return b"".join(map(self._piece.__getitem__, self.vocabulary.pieces(line + "x")[:-1]))

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        *lines, tail = _LINES.split(text)
        head = b"".join(map(self._line.__getitem__, lines))
        return head + b"".join(map(self._piece.__getitem__, self.vocabulary.pieces(tail)))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; the empty list for an empty and for a null text."""
        return np.frombuffer(self.packed(text), np.int32).tolist()


class EncodedText:
    """A text that stays encoded while it is appended to or edited; only what is near the edit is encoded again."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.lines, self.ids_of = encoder, [], []
        self._tail: list[Prefixes] = []
        self.replace(0, 0, text)

    @property
    def text(self) -> str:
        return "".join(self.lines)

    def ids(self) -> list[int]:
        return [i for line in self.ids_of for i in line]

    def append(self, more: str) -> None:
        end = sum(map(len, self.lines))
        self.replace(end, end, more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put `new` in the place of the characters from start to before end."""
        first, begin = 0, 0
        while first < len(self.lines) - 1 and begin + len(self.lines[first]) < start:
            begin += len(self.lines[first])
            first += 1
        if first:  # whether a line ends before depends on the next character
            first -= 1
            begin -= len(self.lines[first])
        last, stop = first, begin
        while last < len(self.lines) and stop <= end:
            stop += len(self.lines[last])
            last += 1
        old = "".join(self.lines[first:last])
        fresh = [x for x in _LINES.split(old[: start - begin] + new + old[end - begin :]) if x]
        at_end = last == len(self.lines)
        ids = [np.frombuffer(self.encoder._line[x], np.int32).tolist() for x in (fresh[:-1] if at_end else fresh)]
        if at_end and fresh:
            ids.append(self._tail_ids(fresh[-1]))
        self.lines[first:last], self.ids_of[first:last] = fresh, ids

    def _tail_ids(self, line: str) -> list[int]:
        """Pieces that only grew keep their prefix tables."""
        kept = []
        for i, p in enumerate(self.encoder.vocabulary.pieces(line)):
            data = p.encode("utf-8", "replace")
            old = self._tail[i] if i < len(self._tail) else None
            if old is not None and data.startswith(old.data):
                old.extend(data[len(old.data) :])
            else:
                old = Prefixes(self.encoder.vocabulary, data)
            kept.append(old)
        self._tail = kept
        return [t for p in kept for t in p.ids()]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(Vocabulary.load(path))


def token_ids(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Rows (key, ids array<int>) of every row of df.

    No special tokens, also where a text contains their strings. A null and an empty text have the empty list. Lone
    surrogates can't occur in a Spark string. Repeated rows are kept; other columns are not read. No shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(path).packed
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                got = [packed(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(got) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in got], out=offsets[1:])
                ids = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(got))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], [key, "ids"])

    own = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    return map_arrow(own, run, f"`{key}` {dict(own.dtypes)[key]}, ids array<int>")


def token_counts(df: DataFrame, keys: list[str], text: str, path: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Rows (keys, n_tokens long); 0 for null and empty texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(path).packed
        for b in batches:
            n = pa.array([len(packed(t)) // 4 for t in b.column("__text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), n], [*keys, "n_tokens"])

    own = df.select(*keys, F.col(text).cast("string").alias("__text"))
    return map_arrow(own, run, ", ".join(f"`{k}` {t}" for k, t in own.dtypes if k != "__text") + ", n_tokens long")
