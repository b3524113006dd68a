"""Words of a whole Arrow batch at once, as numbers: where they stand, their hashes, and hashes of any run of them."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a part of its own, whole.
PART_BYTES = 1 << 20
_WEIGHTS = np.random.default_rng(20).integers(0, 1 << 63, 1 << 12, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

# ASCII white space, and the bytes of words of letters, digits and non-ASCII once A-Z became a-z.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LETTERS = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _weights(n: int) -> np.ndarray:
    """One odd number for each place in a word; longer words than any before get more of them, always the same."""
    global _WEIGHTS
    if n > len(_WEIGHTS):
        _WEIGHTS = np.random.default_rng(20).integers(0, 1 << 63, 2 * n, np.uint64) * np.uint64(2) + np.uint64(1)
    return _WEIGHTS


class Words:
    """Words of some texts: `hashes`, `starts` and `ends` (bytes in `data`); those of text i are `offsets[i]` to `offsets[i + 1]`."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, inside: np.ndarray):
        self.data, self.bounds = data, bounds
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = inside[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        self.starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
        self.offsets = np.searchsorted(self.starts, bounds)
        lengths = self.ends - self.starts
        if len(lengths):
            total = np.cumsum(lengths)
            place = np.arange(total[-1]) - np.repeat(total - lengths, lengths)
            at = place + np.repeat(self.starts, lengths)
            terms = (data[at].astype(np.uint64) + np.uint64(1)) * _weights(int(lengths.max()))[place]
            self.hashes = mixed(np.add.reduceat(terms, total - lengths))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self, word: np.ndarray) -> np.ndarray:
        """The text that each word belongs to."""
        return np.searchsorted(self.offsets, word, side="right") - 1

    def whole(self, size: int) -> np.ndarray:
        """For each word whether so many words from it on are of one text."""
        ok = np.zeros(len(self.hashes), bool)
        ends = np.repeat(self.offsets[1:], self.counts())
        ok[:] = np.arange(len(ok)) + size <= ends
        return ok


class Rolling:
    """Rabin-Karp hashes of runs of words from two running products; arithmetic wraps at 64 bits."""

    def __init__(self, word_hashes: np.ndarray):
        n = len(word_hashes)
        down, up = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
        down[1:], up[1:] = _INVERSE, _BASE
        down, self.up = np.multiply.accumulate(down), np.multiply.accumulate(up)
        self.sums = np.zeros(n + 1, np.uint64)
        np.add.accumulate(word_hashes * down[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hash of the window that begins at each word but the last size - 1."""
        n = max(len(self.sums) - size, 0)
        return mixed((self.sums[size : size + n] - self.sums[:n]) * self.up[:n] + np.uint64(size))


def parts(texts: pa.Array, inside: np.ndarray, change: np.ndarray | None = None) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, words) over the batch, about PART_BYTES at a time; null texts have no words.

    inside: for each byte whether it belongs to a word. change: what each byte becomes first.
    """
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    own = pc.fill_null(texts.cast(pa.large_binary() if large else pa.binary()), b"")
    kind = np.int64 if large else np.int32
    bounds = np.frombuffer(own.buffers()[1], kind)[own.offset : own.offset + len(own) + 1].astype(np.int64) if len(own) else np.zeros(1, np.int64)
    raw = own.buffers()[2] if len(own) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(own):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + PART_BYTES, side="right")) - 1)
        high = min(high, len(own))
        part = data[bounds[low] : bounds[high]]
        yield low, high, Words(part if change is None else change[part], bounds[low : high + 1] - bounds[low], inside)
        low = high
