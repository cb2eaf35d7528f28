"""Words and word hashes of whole Arrow batches of texts, as numpy arrays.

Words are maximal runs of bytes other than space and 0x09-0x0D; in UTF-8 that is the pattern ``[^\\x20\\x09-\\x0D]+``.
Hashes are 64-bit; equal words have equal hashes on every machine, and different ones differ up to chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first k bytes of a block, for k up to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG_WORD = 256


class Words:
    """The words of consecutive texts.

    ``starts`` and ``ends`` are byte places in ``data``; text i has the words ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        body = ~_SPACE[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = body[:-1], body[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.starts = np.flatnonzero(body & ~before)
        self.ends = np.flatnonzero(body & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, lower: bool) -> np.ndarray:
        """Blocks of eight bytes go one after the other through a mixed state that starts from the length; BLAKE2 takes
        words of more than ``_LONG_WORD`` bytes."""
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[:-8] = _LOWER[self.data] if lower else self.data
        blocks = np.ndarray(len(self.data) + 1, "<u8", data, strides=(1,))
        lengths = self.ends - self.starts
        state = mix(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(lengths <= _LONG_WORD)
        done = 0
        while len(at):
            left = lengths[at] - done
            block = blocks[self.starts[at] + done] & _FIRST[np.minimum(left, 8)]
            state[at] = mix((state[at] ^ block) + np.uint64(0x632BE59BD9B4E019))
            done += 8
            at = at[left > 8]
        for i in np.flatnonzero(lengths > _LONG_WORD).tolist():
            word = data[self.starts[i] : self.ends[i]].tobytes()
            state[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return state


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words, over text borders too; empty with fewer words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    return mix(out)


def texts(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, UTF-8 bytes, offsets) of a string column, of up to ``most`` bytes or one row each.
    Nulls are empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return
    column = column.fill_null("").cast(pa.large_string())
    _, places, body = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
