"""Vectorised hashes of words, shingles and MinHash signatures, used inside Spark tasks.

Hashes depend on the bytes alone (fixed constants, wrap-around arithmetic), so every task and every rerun agrees.
"""

from __future__ import annotations

from functools import cache
from hashlib import blake2b

import numpy as np

_SLICE = 1 << 20  # bytes hashed at once; bounds the memory of very long texts
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def stream(name: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(name << 32)) * _GOLDEN)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)

    def table(b: int) -> np.ndarray:
        t = np.full(_SLICE + 1, b, np.uint64)
        t[0] = 1
        return np.multiply.accumulate(t)

    return table(base), table(inverse)


@cache
def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _slice_words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of at most ``_SLICE`` bytes."""
    space = _is_space()[buffer]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers()
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(stream(1, 256)[buffer] * power[: len(buffer)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of ``data``.

    Slices end at white space; a single word longer than a slice is hashed in slices that are then combined.
    """
    buffer = np.frombuffer(data, np.uint8)
    if len(buffer) <= _SLICE:
        return _slice_words(buffer)
    starts, hashes, at = [], [], 0
    while at < len(buffer):
        end = min(at + _SLICE, len(buffer))
        if end < len(buffer):
            gaps = np.flatnonzero(_is_space()[buffer[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(_is_space()[buffer[end:]])
                end = end + int(rest[0]) if len(rest) else len(buffer)
                if end - at > _SLICE:
                    value = np.zeros(1, np.uint64)
                    for i in range(at, end, _SLICE):
                        value = mix(value * _GOLDEN + _slice_words(buffer[i : min(i + _SLICE, end)])[1])
                    starts.append(np.array([at]))
                    hashes.append(value)
                    at = end
                    continue
        s, h = _slice_words(buffer[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingles_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of fewer words, the whole sequence as one; of none, nothing."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(width, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = total * _GOLDEN + hashes[i : n - k + 1 + i]
    return mix(total)


def batches(texts, limit: int = 1 << 19):
    """Runs of texts of about ``limit`` bytes together: (first index, list of lower-cased bytes)."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass").lower() if text else b""
        if held and size + len(data) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


def word_shingles(texts, width: int):
    """Yields, per text, the hashes of its word shingles (repeats included); A-Z count as a-z."""
    for _, held in batches(texts):
        starts, hashes = words_of(b"\n".join(held))
        limits = np.cumsum([0] + [len(h) + 1 for h in held])
        cuts = np.searchsorted(starts, limits)
        for i in range(len(held)):
            yield shingles_of(hashes[cuts[i] : cuts[i + 1]], width)


def char_shingles(lines: list[str], width: int) -> list[np.ndarray]:
    """Per line the 64-bit hashes of its runs of ``width`` characters; of a shorter line, the whole of it."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= 1 << 15):
            size += len(lines[end])
            end += 1
        out.extend(_long_line(lines[at], width) if size > _SLICE else _short_lines(lines[at:end], width))
        at = end
    return out


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return stream(2, 1 << 16)[codes & np.uint32(0xFFFF)] + (codes >> np.uint32(16)).astype(np.uint64)


def _short_lines(lines: list[str], width: int) -> list[np.ndarray]:
    power, inverse = _powers()
    codes = _codes("".join(lines))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=total[1:])
    size = np.minimum(width, len(codes))
    runs = (total[size:] - total[: len(total) - size]) * inverse[: len(total) - size] * _GOLDEN
    out, at = [], 0
    for line in lines:
        n = len(line)
        if n >= width:
            out.append(runs[at : at + n - width + 1])
        elif n:
            out.append(mix((total[at + n : at + n + 1] - total[at]) * inverse[at] + np.uint64(n)))
        else:
            out.append(runs[:0])
        at += n
    return out


def _long_line(line: str, width: int) -> list[np.ndarray]:
    """The same hashes for a line longer than the tables of powers."""
    power = _powers()[0]
    codes = _codes(line)
    total = np.zeros(len(codes) - width + 1, np.uint64)
    for i in range(width):
        total += codes[i : len(codes) - width + 1 + i] * power[i]
    return [total * _GOLDEN]


def minhashes(shingles: list[np.ndarray], count: int) -> np.ndarray:
    """One row of ``count`` 32-bit minima per (non-empty) shingle array."""
    out = np.empty((len(shingles), count), np.uint32)
    odd = (stream(3, count) | np.uint64(1)).astype(np.uint32)
    add = stream(4, count).astype(np.uint32)
    for at, end in _parts(shingles, 1 << 15):
        flat = (np.concatenate(shingles[at:end]) >> np.uint64(32)).astype(np.uint32)
        offsets = np.cumsum([0] + [len(s) for s in shingles[at : end - 1]])
        value, least = np.empty_like(flat), np.empty((count, end - at), np.uint32)
        for i in range(count):
            np.multiply(flat, odd[i], out=value)
            np.add(value, add[i], out=value)
            np.minimum.reduceat(value, offsets, out=least[i])
        out[at:end] = least.T
    return out


def binned_minima(shingles: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of 2 * ``bins`` 32-bit minima per shingle array, from two hashes of a shingle: each falls into one of ``bins`` bins by its value, and a bin
    keeps its least (one-permutation hashing).  A bin that is empty has the largest value.

    Two sets agree on a bin that their union fills with the probability of their Jaccard similarity, and always on one it leaves empty.
    """
    out = np.full((len(shingles), 2, bins), 0xFFFFFFFF, np.uint32)
    for first, last in _parts(shingles):
        halves = mix(np.concatenate(shingles[first:last])).view(np.uint32).reshape(-1, 2)
        row = np.repeat(np.arange(last - first) * bins, [len(s) for s in shingles[first:last]])
        for look in range(2):
            value = np.ascontiguousarray(halves[:, look])
            cell = value.astype(np.int64)
            cell *= bins
            cell >>= 32
            cell += row
            least = np.full((last - first) * bins, 0xFFFFFFFF, np.uint32)
            np.minimum.at(least, cell, value)
            out[first:last, look] = least.reshape(-1, bins)
    return out.reshape(len(shingles), 2 * bins)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; for short arrays several times as fast as numpy's own, which hashes them first."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def distinct_at_least(shingles: list[np.ndarray], enough: int | np.ndarray) -> np.ndarray:
    """How many distinct values each array has; of more than ``enough`` (one for all or one for each), some number from ``enough`` on."""
    out = np.empty(len(shingles), np.int64)
    for first, last in _parts(shingles):
        seen = np.zeros((last - first) << 10, bool)
        row = np.repeat(np.arange(last - first) << 10, [len(s) for s in shingles[first:last]])
        row += (np.concatenate(shingles[first:last]) >> np.uint64(54)).view(np.int64)
        seen[row] = True
        out[first:last] = seen.reshape(-1, 1 << 10).sum(axis=1)
    unsure = np.flatnonzero(out < enough)
    few = [shingles[i] for i in unsure]
    for first, last in _parts(few):  # 10 bits say whose value it is, 54 are left to tell values apart
        row = np.repeat(np.arange(last - first, dtype=np.uint64) << np.uint64(54), [len(s) for s in few[first:last]])
        owner = distinct(row | (np.concatenate(few[first:last]) >> np.uint64(10))) >> np.uint64(54)
        out[unsure[first:last]] = np.bincount(owner.astype(np.int64), minlength=last - first)
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """512 bits (64 bytes) per array of distinct hashes: for each of 512 cells whether an odd number of the hashes falls into it.

    Sketches differ in at most as many bits as the sets have elements that are not in both.
    """
    out = np.empty((len(sets), 64), np.uint8)
    for first, last in _parts(sets):
        row = np.repeat(np.arange(last - first) << 9, [len(s) for s in sets[first:last]])
        cell = (np.concatenate(sets[first:last]) >> np.uint64(55)).astype(np.int64)
        out[first:last] = np.packbits((np.bincount(row + cell, minlength=(last - first) << 9) & 1).astype(np.uint8).reshape(-1, 1 << 9), axis=1)
    return out


def _parts(arrays: list[np.ndarray], most: int = 1 << 14):
    """(first, last) of runs of arrays that hold about ``most`` values together."""
    total = np.cumsum(np.fromiter(map(len, arrays), np.int64, len(arrays)))
    at = 0
    while at < len(arrays):
        held = int(total[at - 1]) if at else 0
        end = min(max(at + 1, int(np.searchsorted(total, held + most, "right"))), at + (1 << 10))
        yield at, end
        at = end


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """32-bit keys, one per band of ``rows`` minima."""
    total = np.zeros((len(minima), bands), np.uint64)
    shaped = minima[:, : bands * rows].reshape(len(minima), bands, rows).astype(np.uint64)
    for i in range(rows):
        total = total * _GOLDEN + shaped[:, :, i]
    return (mix(total) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def wide_band_keys(minima: np.ndarray, bands: int, rows: int, before: int = 0) -> np.ndarray:
    """64-bit keys, one per band of ``rows`` minima; the number of the band (after ``before`` others) is part of its key."""
    shaped = minima[:, : bands * rows].reshape(len(minima), bands, rows).astype(np.uint64)
    total = np.tile(np.arange(before + 1, before + bands + 1, dtype=np.uint64), (len(minima), 1))
    for i in range(rows):
        total = mix(total * _GOLDEN + shaped[:, :, i])
    return total.view(np.int64)


def digest(data: bytes) -> int:
    """64 bits that stand for a text or a sorted array of distinct hashes.

    Two of n different ones agree with probability n * n / 2**65: 0.03 for a billion.
    """
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "big", signed=True)


def digests(data: list[bytes]) -> np.ndarray:
    """``digest`` of each."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=8).digest() for x in data]), ">i8").astype(np.int64)
