"""Vectorised words, word hashes and n-gram hashes over Arrow batches of text.

A word is a run of bytes other than the six ASCII white-space bytes, so ``[^\\x20\\x09-\\x0D]+``.
All texts of a slice share one byte array; words are hashed side by side, eight bytes a step (long
ones by a difference of prefix sums of a polynomial), so no Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20
_BASE, _GRAM = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93


class Cache(dict):
    """Made anew in each process: what it holds does not travel with the functions that use it."""

    def __reduce__(self):
        return (Cache, ())


_POWERS = Cache()
#: Runs of more bytes are hashed by sums over the text.
RUN = 64
#: Masks of the first 0 to 8 bytes.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(U) ^ U((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> U(33)
        x *= U(0xFF51AFD7ED558CCD)
        x ^= x >> U(33)
        x *= U(0xC4CEB9FE1A85EC53)
        x ^= x >> U(33)
    return x


def byte_codes(seed: int = 1) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U), seed)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n. Only those of a slice are kept; a longer text's go with it."""
    if base in _POWERS and len(_POWERS[base][0]) >= n:
        return _POWERS[base]
    size, made = max(n, SLICE_BYTES + (1 << 16)), []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, U(b), dtype=U)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=U, out=steps))
    if n <= SLICE_BYTES + (1 << 16):
        _POWERS[base] = (made[0], made[1])
    return made[0], made[1]


def fold_table() -> np.ndarray:
    """Bytes with ASCII capitals lowered (Words lowers those of Latin-1 too) and ASCII punctuation, but for `_`, `-` and `$`, made spaces."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[np.frombuffer(b".,;:!?\"'()[]{}|*#%&", np.uint8)] = 32
    return table


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (a null text counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def flat_texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more entry than texts)."""
    texts = text_array(column)
    _, offsets, values = texts.buffers()
    n = len(texts)
    offs = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :] if offsets is not None and n else np.zeros(1, np.int64)
    low, high = int(offs[0]), int(offs[-1])
    return np.frombuffer(values, dtype=np.uint8)[low:high] if values is not None and high > low else np.zeros(0, np.uint8), offs - low


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text; a longer text stands alone, whole."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield batch.slice(at)


class Words:
    """The words of some texts.

    data: their bytes; offs: where each text begins in data; starts, ends: of each word;
    first: index of each text's first word (one more entry than texts); hashes: one per word.
    """

    def __init__(self, column: pa.Array, seed: int = 1, folded: bool = False) -> None:
        self.data, self.offs = flat_texts(column)
        self.sums: np.ndarray | None = None
        self.eights: np.ndarray | None = None
        if folded:
            raw = self.data
            self.data = fold_table()[raw]
            after = raw[1:]  # of U+00C0 to U+00DE, whose first byte is C3, the small letters are 32 on
            self.data[1:][(raw[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)] += 32
        inside = (self.data != 32) & ((self.data < 9) | (self.data > 13))
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offs] = True
        before, after = np.ones(len(inside), bool), np.ones(len(inside), bool)
        before[1:] = ~inside[:-1]
        after[:-1] = ~inside[1:]
        self.starts = np.flatnonzero(inside & (before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offs)
        self.hashes = self.hash_spans(self.starts, self.ends, seed)

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
        """Hashes of runs of bytes; equal runs have equal hashes. Eight bytes a step, or by sums where a run is long."""
        if self.eights is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self.eights = np.ndarray(len(self.data) + 1, "<u8", padded.data, strides=(1,))
        size = ends - starts
        out = mix(size, seed)
        if not len(size):
            return out
        longest = int(size.max())
        for at in range(0, min(longest, RUN), 8):
            if at == 0:
                out = mix(out ^ (self.eights[starts] & _LOW[np.minimum(size, 8)]))
                continue
            more = np.flatnonzero(size > at)
            out[more] = mix(out[more] ^ (self.eights[starts[more] + at] & _LOW[np.minimum(size[more] - at, 8)]))
        if longest > RUN:
            up, down = powers(_BASE, len(self.data) + 1)
            if self.sums is None:
                self.sums = np.zeros(len(self.data) + 1, dtype=U)
                np.cumsum(byte_codes()[self.data] * up[: len(self.data)], out=self.sums[1:])
            more = np.flatnonzero(size > RUN)
            out[more] = mix(out[more] ^ ((self.sums[ends[more]] - self.sums[starts[more]]) * down[starts[more]]), seed)
        return out

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)

    def grams(self, k: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of words) at which k words of one text begin, and their hashes."""
        at = gram_positions(self.first, k)
        return at, gram_hashes(self.hashes, k, seed)[at] if len(at) else np.zeros(0, U)

    def shingles(self, k: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of each shingle of k words; a text of 1 to k - 1 words has one, itself."""
        at, h = self.grams(k, seed)
        text = np.searchsorted(self.first, at, side="right") - 1
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        if len(short):
            whole = span_hashes(self.hashes, self.first[short], self.first[short + 1], seed)
            text, h = np.concatenate([text, short]), np.concatenate([h, whole])
            order = np.argsort(text, kind="stable")
            text, h = text[order], h[order]
        return text, h


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 2) -> np.ndarray:
    """Hashes of runs of words; equal runs have equal hashes, whatever their place."""
    up, down = powers(_GRAM, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=U)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (np.asarray(ends) - starts).astype(U), seed)


def gram_hashes(hashes: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    at = np.arange(n)
    return span_hashes(hashes, at, at + k, seed)


def gram_positions(first: np.ndarray, k: int) -> np.ndarray:
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    good = np.ones(n, bool)
    counts = np.diff(first)
    # the last k - 1 words of each text begin no gram
    ends = first[1:]
    for back in range(1, k):
        at = ends - back
        good[at[counts >= back]] = False
    return np.flatnonzero(good)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def minimisers(h: np.ndarray, width: int) -> np.ndarray:
    """Mask of the positions that hold the least value of some ``width`` neighbours (every tie)."""
    if len(h) < width:
        return h == h.min() if len(h) else np.zeros(0, bool)
    least = sliding(h, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, h.dtype), least, np.zeros(width - 1, h.dtype)])
    return sliding(padded, width, np.maximum) == h


def ints(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed longs."""
    return h.view(np.int64)
