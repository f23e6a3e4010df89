"""Vectorised word splitting and hashing of Arrow text batches, shared by the operators on words.

A word is a maximal run of bytes outside space and TAB..CR, i.e. ``[^\\x20\\x09-\\x0D]+`` on UTF-8.
Hashes are 64-bit polynomials modulo 2**64 (odd base, so powers have inverses and a range hash does
not depend on where the range stands), finished with a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i below n (kept and grown per process)."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = _tables[base] = (np.cumprod(up), np.cumprod(down))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """The words of several texts: byte bounds and hashes of each word, and each text's word range."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool, apart: np.ndarray = SPACE):
        self.raw, self.bounds = data, bounds
        data = LOWER[data] if lower else data
        n = len(data)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~apart[data]
        first = np.zeros(n + 1, bool)
        first[bounds] = True  # a text begins: words never cross
        begin = solid[1:-1] & (~solid[:-2] | first[:-1])
        end = solid[1:-1] & (~solid[2:] | first[1:])
        self.start, self.stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.offsets = np.searchsorted(self.start, bounds)
        up, down = _powers(_BYTE_BASE, n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:n], out=total[1:])
        self.byte_sums = total
        size = (self.stop - self.start).astype(U)
        self.hash = mix((total[self.stop] - total[self.start]) * down[self.start] + size)
        self.text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(self.offsets))

    def bytes_between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, wherever they stand."""
        _, down = _powers(_BYTE_BASE, len(self.byte_sums))
        return mix((self.byte_sums[stop] - self.byte_sums[start]) * down[start] + (stop - start).astype(U))

    def text_hashes(self) -> np.ndarray:
        """One hash of each text's words."""
        return self.ranges(self.sums(), self.offsets[:-1], np.diff(self.offsets))

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first n bytes of all words that long, and the index of these words."""
        at = np.flatnonzero(self.stop - self.start >= n)
        _, down = _powers(_BYTE_BASE, len(self.byte_sums))
        start = self.start[at]
        return mix((self.byte_sums[start + n] - self.byte_sums[start]) * down[start] + U(n * 0xC2B2AE3D27D4EB4F % (1 << 64))), at

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return self.offsets[1:][self.text_of] - np.arange(len(self.start))

    def sums(self) -> np.ndarray:
        """Prefix sums from which ``ranges`` takes the hash of any run of words."""
        up, _ = _powers(_WORD_BASE, len(self.hash) + 1)
        total = np.zeros(len(self.hash) + 1, U)
        np.cumsum(self.hash * up[: len(self.hash)], out=total[1:])
        return total

    @staticmethod
    def ranges(total: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        _, down = _powers(_WORD_BASE, len(total))
        n = np.asarray(size).astype(U)
        return mix((total[start + size] - total[start]) * down[start] + n * U(0xA24BAED4963EE407))

    def grams(self, k: int, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word runs that stay inside a text, and the index of their first word."""
        at = np.flatnonzero(self.left() >= k)
        return self.ranges(self.sums() if total is None else total, at, k), at


def slices(texts: pa.Array, lower: bool = False, max_bytes: int = 1 << 20, apart: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of consecutive rows with about max_bytes of text.

    Null texts count as empty. A longer text makes a slice of its own, so memory follows the longest
    text rather than the batch.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return
    _, at, raw = texts.buffers()
    at = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(at, at[a] + max_bytes, "right")) - 1)
        yield a, b, Words(raw[at[a] : at[b]], at[a : b + 1] - at[a], lower, apart)
        a = b


def signed(h: np.ndarray) -> np.ndarray:
    """Spark has no unsigned 64-bit type."""
    return h.view(np.int64) if h.dtype == U else h.astype(U).view(np.int64)
