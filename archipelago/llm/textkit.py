"""Word hashes of whole texts, computed over byte buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes looked at in one step; a longer text is cut between words.
STEP = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values(places: np.ndarray) -> np.ndarray:
    """A value of 64 bits for every letter at every place of a word (256 * place + letter)."""
    return mix(mix(places.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03))


#: The values of the first 64 places.
_NEAR = _values(np.arange(64 << 8))


def _step_words(buf: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    letters = buf[word]
    first = np.cumsum(sizes) - sizes
    places = (np.arange(len(letters)) - np.repeat(first, sizes)) * 256 + (_FOLD[letters] if fold else letters)
    if sizes.max() <= 64:
        values = _NEAR[places]
    else:
        values = _NEAR[np.minimum(places, len(_NEAR) - 1)]
        far = np.flatnonzero(places >= len(_NEAR))
        values[far] = _values(places[far])
    return mix(np.add.reduceat(values, first)), start


_RNG = np.random.default_rng(20240229)
_BASE = np.uint64(int(_RNG.integers(1 << 62)) | 1)
_LETTER = _RNG.integers(0, 1 << 63, size=256, dtype=np.uint64)
_FOLDED = _LETTER.copy()
_FOLDED[65:91] = _LETTER[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(int(_BASE), STEP + 1)
_UNPOWER = _powers(pow(int(_BASE), -1, 1 << 64), STEP + 1)


def _step_slots(buf: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _LETTER)[buf] * _POWER[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * _UNPOWER[start]), start


def word_hashes(text: bytes, fold: bool = True, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space) and their byte starts.

    The hash is mixed from the sum of a value for each letter at its place
    (tabulation hashing), which no structure within a word cancels out.  Without
    ``exact`` it is a polynomial modulo 2 ** 64, which is cheaper and does where words
    made to share a hash may share it, as for a model's slots.
    With ``fold`` A-Z count as a-z.  A single word longer than ``STEP`` is
    hashed in pieces that are folded into one value.
    """
    buf, step = np.frombuffer(text, np.uint8), _step_words if exact else _step_slots
    if len(buf) <= STEP:
        return step(buf, fold)
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + STEP)
        if end < len(buf) and not _SPACE[buf[end]]:
            back = np.flatnonzero(_SPACE[buf[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # one word fills the step: find its end, then fold its pieces
                rest = at
                while rest < len(buf) and not _SPACE[buf[rest : rest + STEP]].any():
                    rest += STEP
                stop = len(buf) if rest >= len(buf) else rest + int(np.flatnonzero(_SPACE[buf[rest : rest + STEP]])[0])
                value = np.zeros(1, np.uint64)
                for p in range(at, stop, STEP):
                    value = mix(value * np.uint64(0x9E3779B97F4A7C15) + step(buf[p : min(stop, p + STEP)], fold)[0])
                hashes.append(value)
                starts.append(np.array([at]))
                at = stop
                continue
        h, s = step(buf[at:end], fold)
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of the whole if shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return np.unique(out + np.uint64(size))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes | None]]:
    """(id, UTF-8 bytes or None) of batches whose columns are an id and a text."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            yield key, text.as_py()
